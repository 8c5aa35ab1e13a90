"""SentencePiece encoding and decoding by vectorised merge rounds."""

from __future__ import annotations

import codecs
import functools
import heapq
import re
from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waterspark.llm.shared import map_slices, text_of

SPACE_PIECE = "▁"
NONE = np.iinfo(np.int64).max
#: Words whose ids a worker remembers before it starts afresh; only speed depends on it.
REMEMBERED = 200_000
#: Characters of text a worker handles at a time.
SLICE_CHARS = 1_000_000

codecs.register_error("piece_bytes", lambda e: ("�" * (e.end - e.start), e.end))


class PieceModel:
    """Tables of a BPE model of the sentencepiece library: pieces, and all ways in which
    two symbols join to a piece, with the piece's rank."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        read = sentencepiece.SentencePieceProcessor(model_file=path)
        size = read.get_piece_size()
        self.size, self.end, self.unknown = size, read.eos_id(), read.unk_id()
        self.text: list[str | None] = [None] * size  # of ordinary pieces
        self.byte_of: dict[int, int] = {}
        for i in range(size):
            if read.is_byte(i):
                self.byte_of[i] = int(read.id_to_piece(i)[1:-1], 16)
            elif not (read.is_control(i) or read.is_unknown(i) or read.is_unused(i)):
                self.text[i] = read.id_to_piece(i)
        self.byte_id = {b: i for i, b in self.byte_of.items()}
        ids = {t: i for i, t in enumerate(self.text) if t}
        # Characters inside pieces that are no piece of their own get ids beyond the model's.
        inner = sorted(set("".join(ids)) - set(ids))
        symbols = ids | {c: size + n for n, c in enumerate(inner)}
        self.symbols = len(symbols) + size
        self.char = np.full(0x110000, -1, dtype=np.int64)
        for c, i in symbols.items():
            if len(c) == 1:
                self.char[ord(c)] = i
        order = {s: r for r, s in enumerate(sorted({read.get_score(i) for i in ids.values()}, reverse=True))}
        pairs = {}
        for t, i in ids.items():
            for cut in range(1, len(t)):
                a, b = symbols.get(t[:cut]), symbols.get(t[cut:])
                if a is not None and b is not None:
                    pairs[(a, b)] = (order[read.get_score(i)], i)
        self.pairs = pairs
        keys = np.array([a * self.symbols + b for a, b in pairs], dtype=np.int64)
        by = np.argsort(keys)
        self.keys = keys[by]
        self.rank = np.append(np.array([r for r, _ in pairs.values()], dtype=np.int64)[by], NONE)
        self.joined = np.append(np.array([i for _, i in pairs.values()], dtype=np.int64)[by], -1)
        # No merge crosses a place where no piece has these neighbours: before a space
        # symbol, and around a line feed if no piece holds one.
        inside = any(SPACE_PIECE in t.lstrip(SPACE_PIECE) for t in ids)
        feed = "" if any("\n" in t and len(t) > 1 for t in ids) else "\\n"
        s = SPACE_PIECE
        self.words = re.compile("(?s).+" if inside else f"{s}*[^{s}{feed}]+|{s}+" + (f"|{feed}" if feed else ""))
        self.known: dict[str, tuple[int, ...]] = {}

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place in the pair table, its end where two symbols do not join."""
        want = left * self.symbols + right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where((self.keys[at] == want) & (left >= 0) & (right >= 0), at, len(self.keys))

    def merge_words(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of each word.

        All words lie in one array of symbols. A round finds the smallest pair rank of
        each word, joins all its occurrences from the left, and closes the gaps; a word
        without pairs leaves. A join that makes a pair of no larger rank could have come
        before the round's later joins, so such a word is done one join at a time.
        """
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        symbol = self.char[codes]
        word = np.repeat(np.arange(len(words)), lengths)
        origin = np.arange(len(symbol))
        none = len(self.keys)
        at = np.full(len(symbol), none)
        same = np.flatnonzero(word[1:] == word[:-1])
        at[same] = self.pair(symbol[same], symbol[same + 1])
        left_symbol, left_origin, slow = [], [], set()
        while len(symbol):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            rank = self.rank[at]
            best = np.minimum.reduceat(rank, first)
            best = np.repeat(best, np.diff(np.append(first, len(symbol))))
            over = best == NONE
            left_symbol.append(symbol[over])
            left_origin.append(origin[over])
            go = ~over
            symbol, word, origin, at, rank, best = (x[go] for x in (symbol, word, origin, at, rank, best))
            if not len(symbol):
                break
            hit = np.flatnonzero(rank == best)
            # Of overlapping occurrences every second one is joined, from the left.
            start = np.append(True, np.diff(hit) > 1)
            run = np.maximum.accumulate(np.where(start, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            bar = best[hit]
            symbol[hit] = self.joined[at[hit]]
            stay = np.ones(len(symbol), dtype=bool)
            stay[hit + 1] = False
            moved = np.cumsum(stay) - 1
            symbol, word, origin, at = (x[stay] for x in (symbol, word, origin, at))
            hit = moved[hit]
            for place in (hit, hit[hit > 0] - 1):
                right = np.minimum(place + 1, len(symbol) - 1)
                joins = (right > place) & (word[right] == word[place])
                at[place] = np.where(joins, self.pair(symbol[place], symbol[right]), none)
            fresh = self.rank[at[hit]] <= bar
            back = hit > 0
            fresh[back] |= (self.rank[at[hit[back] - 1]] <= bar[back]) & (word[hit[back] - 1] == word[hit[back]])
            if fresh.any():
                many = np.bincount(word[hit], minlength=len(words))
                odd = np.unique(word[hit[fresh]])
                odd = odd[many[odd] > 1]
                if len(odd):
                    slow.update(odd.tolist())
                    go = ~np.isin(word, odd)
                    symbol, word, origin, at = (x[go] for x in (symbol, word, origin, at))
        symbol, origin = np.concatenate(left_symbol), np.concatenate(left_origin)
        by = np.argsort(origin)
        symbol, origin = symbol[by], origin[by]
        ends = np.searchsorted(origin, np.cumsum(lengths))
        symbols, origins, out, begin = symbol.tolist(), origin.tolist(), [], 0
        for n, end in enumerate(ends.tolist()):
            if n in slow:
                out.append(self.merge_word(words[n]))
            else:
                ids = symbols[begin:end]
                if not ids or min(ids) < 0 or max(ids) >= self.size:
                    ids = list(chain.from_iterable((i,) if 0 <= i < self.size else self.spelled(chr(codes[o])) for i, o in zip(ids, origins[begin:end])))
                out.append(tuple(ids))
            begin = end
        return out

    def merge_word(self, word: str) -> tuple[int, ...]:
        """One word, the best pair at a time, the leftmost of equals."""
        symbol = [int(self.char[ord(c)]) for c in word]
        after, before = list(range(1, len(word))) + [-1], list(range(-1, len(word) - 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] >= 0 and (found := self.pairs.get((symbol[i], symbol[after[i]]))):
                heapq.heappush(heap, (found[0], i, found[1], symbol[i], symbol[after[i]]))

        for i in range(len(word)):
            offer(i)
        gone = [False] * len(word)
        while heap:
            _, i, made, a, b = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j < 0 or symbol[i] != a or symbol[j] != b:
                continue
            symbol[i], gone[j], after[i] = made, True, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return tuple(chain.from_iterable((s,) if 0 <= s < self.size else self.spelled(word[i]) for i, s in enumerate(symbol) if not gone[i]))

    def spelled(self, char: str) -> tuple[int, ...]:
        """Ids of a character that is no piece: its bytes, or the unknown id."""
        return tuple(self.byte_id.get(b, self.unknown) for b in char.encode()) if self.byte_id else (self.unknown,)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text without an end id."""
        cut = [self.words.findall((SPACE_PIECE + t).replace(" ", SPACE_PIECE)) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list(set(chain.from_iterable(cut)).difference(self.known))
        if new:
            self.known.update(zip(new, self.merge_words(new)))
        known = self.known
        return [list(chain.from_iterable(map(known.__getitem__, words))) for words in cut]

    @functools.cached_property
    def shown(self) -> list[str]:
        return ["" if t is None else t.replace(SPACE_PIECE, " ") for t in self.text]

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids: control ids are silent, runs of byte ids are UTF-8, the space that
        encoding adds in front is taken away."""
        ids = ids if isinstance(ids, list) else list(ids)
        odd = self.odd
        if odd.isdisjoint(ids):
            whole = "".join(map(self.shown.__getitem__, ids))
            return whole[1:] if whole.startswith(" ") else whole
        out, raw, start = [], bytearray(), True
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "piece_bytes"))
                raw, start = bytearray(), False
            part = " ⁇ " if i == self.unknown else self.shown[i]
            if start and part:
                start = False
                if part[0] == " " and i != self.unknown:
                    part = part[1:]
            out.append(part)
        out.append(raw.decode("utf-8", "piece_bytes"))
        return "".join(out)

    @functools.cached_property
    def odd(self) -> frozenset[int]:
        return frozenset([*self.byte_of, self.unknown])


@functools.lru_cache(maxsize=2)
def model_at(path: str) -> PieceModel:
    """The model's tables, built once in a worker."""
    return PieceModel(path)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", end: bool = True) -> DataFrame:
    """(doc_id, ids, decoded) of every row: the ids of its whole text, with an end id if
    wanted, and the text that these ids decode to.

    Exactly the ids of the sentencepiece library for a BPE model without normalisation
    rules. A null or empty text has the end id alone and decodes to an empty text; repeated
    rows repeat; other columns do not matter. The work is row by row in Arrow slices, so
    there is no shuffle; a worker holds the model, the words it remembers and one slice.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = model_at(model_path)
        ids = model.encode(batch.column(1).to_pylist())
        if end:
            for x in ids:
                x.append(model.end)
        sizes = np.fromiter(map(len, ids), dtype=np.int32, count=len(ids))
        flat = np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(sizes.sum()))
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(flat))
        decoded = pa.array([model.decode(x) for x in ids], pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0), lists, decoded], names=[batch.schema.names[0], "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return map_slices(slim, "text", SLICE_CHARS, f"doc_id {kind}, ids array<int>, decoded string", work)
