"""How the tokens of two tokenizers lie over one another, and which pairs go together.

Texts are cut where both tokenizers cut, so each distinct chunk is encoded and aligned once.
A slice of documents writes its pair-document records side-major: for each radix of the first
id a sorted run of pairs, and for each pair the documents that hold it. Runs are merged with
a heap, up a tree with bounded fan-in, until each radix has the count of every pair and the
largest count of every first id; the answers go down the same tree to the slices, whose
records then add up to each document's share. Only pairs travel, each once for a slice.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waterspark.llm.shared import slices, stored, text_of

SLICE_CHARS = 2_000_000
#: Rows of a slice, so that a document's place fits its bits.
SLICE_ROWS = 1 << 14
#: Runs by first id modulo this; runs merged at once, on average; pairs in a block of a run.
RADIX, FAN, BLOCK = 64, 64, 8192
#: Chunks that a worker remembers.
REMEMBERED = 200_000
#: Between two signs that are no white space, a space starts a new word for both tokenizers:
#: the first one's words begin with at most one space, and no piece of the second holds a
#: space after another sign.
CUT = re.compile(r"(?<=\S) (?=\S)")
SPACE_PIECE = "▁"


def byte_alphabet() -> dict[str, int]:
    """The printable sign that stands for each byte in a byte-level vocabulary: itself where
    it is printable, else the next free one from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Pair:
    """Both tokenizers, and what is known of the chunks met so far."""

    def __init__(self, first: str, second: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(first)
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_file=second)
        alphabet = byte_alphabet()
        entries = self.first.get_vocab(with_added_tokens=True)
        special = {t.content for t in self.first.get_added_tokens_decoder().values()}
        self.a_bytes = [b""] * (1 + max(entries.values()))
        for entry, i in entries.items():
            self.a_bytes[i] = entry.encode() if entry in special else bytes(alphabet[c] for c in entry)
        pieces = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.second.is_byte(i) else p.replace(SPACE_PIECE, " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array(list(map(len, x)), dtype=np.int64) for x in (self.a_bytes, self.b_bytes))
        # Every id with what follows it: another of its side, the other side, another group.
        names = [str(i) for x in (self.a_bytes, self.b_bytes) for i in range(len(x))]
        self.written = [n + mark for n in names for mark in ",|;"]
        self.written_size = np.array(list(map(len, self.written)), dtype=np.int64)
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.groups: list[str] = []
        #: By chunk: tokens of both sides, groups, and where its links begin.
        self.counts, self.begin = np.zeros((0, 3), dtype=np.int64), np.zeros(1, dtype=np.int64)
        self.links = np.zeros(0, dtype=np.int64)

    def laid(self, a: list[list[int]], b: list[list[int]], whole: list[bytes]) -> tuple:
        """Ids of both sides in one line and where each ends, where chunks end, and whether
        both sides give every chunk back."""
        sides = [np.fromiter(chain.from_iterable(x), dtype=np.int64) for x in (a, b)]
        ends = np.cumsum(list(map(len, whole)))
        out, same, line = [], True, b"".join(whole)
        for given, ids, size, entries in zip((a, b), sides, (self.a_size, self.b_size), (self.a_bytes, self.b_bytes)):
            out.append(np.cumsum(size[ids]))
            stops = np.cumsum(list(map(len, given)))
            same &= bool(len(ids) and stops[0] and (out[-1][stops - 1] == ends).all()) and b"".join(map(entries.__getitem__, ids.tolist())) == line
        return *sides, *out, ends, same

    def learn(self, chunks: list[str]) -> None:
        """Aligns new chunks; one whose bytes differ gets the place -1."""
        whole = [(" " + c).encode() for c in chunks]
        a = [e.ids for e in self.first.encode_batch([" " + c for c in chunks], add_special_tokens=False)]
        b = self.second.encode(chunks, num_threads=1)
        a_ids, b_ids, a_ends, b_ends, ends, same = self.laid(a, b, whole)
        good = range(len(chunks))
        if not same:
            good = [i for i, w in enumerate(whole) if b"".join(map(self.a_bytes.__getitem__, a[i])) == w == b"".join(map(self.b_bytes.__getitem__, b[i]))]
            self.place.update((chunks[i], -1) for i in set(range(len(chunks))).difference(good))
            if not good:
                return
            a, b = [a[i] for i in good], [b[i] for i in good]
            a_ids, b_ids, a_ends, b_ends, ends, _ = self.laid(a, b, [whole[i] for i in good])
        common = np.intersect1d(a_ends, b_ends, assume_unique=True)
        # Between two neighbouring cuts of either side lies exactly one overlapping pair.
        cuts = np.union1d(a_ends, b_ends)
        links = a_ids[np.searchsorted(a_ends, cuts)] << 16 | b_ids[np.searchsorted(b_ends, cuts)]
        n_groups, n_links = (np.diff(np.searchsorted(x, ends, side="right"), prepend=0) for x in (common, cuts))
        counts = np.stack([list(map(len, a)), list(map(len, b)), n_groups], axis=1)
        side = np.concatenate([2 * np.searchsorted(common, a_ends), 2 * np.searchsorted(common, b_ends) + 1])
        order = np.argsort(side, kind="stable")
        side, ids = side[order], np.concatenate([a_ids, len(self.a_bytes) + b_ids])[order]
        after = np.append(side[1:], side[-1] + 1)
        marked = 3 * ids + np.where(after == side, 0, np.where(after // 2 == side // 2, 1, 2))
        text, stops = "".join(map(self.written.__getitem__, marked.tolist())), np.cumsum(self.written_size[marked])
        stops = stops[np.cumsum(counts[:, 0] + counts[:, 1]) - 1].tolist()
        self.groups += [text[i : j - 1] for i, j in zip([0, *stops], stops)]
        self.place.update((chunks[i], len(self.counts) + n) for n, i in enumerate(good))
        self.counts = np.concatenate([self.counts, counts])
        self.begin = np.append(self.begin, self.begin[-1] + np.cumsum(n_links))
        self.links = np.concatenate([self.links, links])

    def places(self, texts: list[str]) -> list[list[int]]:
        """The chunks of each text; none of a text that is empty or whose bytes differ."""
        if len(self.place) > REMEMBERED:
            self.forget()
        cut = [CUT.split(t) if t else [] for t in texts]
        if new := set(chain.from_iterable(cut)).difference(self.place):
            self.learn(list(new))
        out = [list(map(self.place.__getitem__, c)) for c in cut]
        if -1 in chain.from_iterable(out):
            for i, found in enumerate(out):
                if -1 in found:
                    # Only the joined bytes count, so the text is tried as one chunk.
                    if texts[i] not in self.place:
                        self.learn([texts[i]])
                    whole = self.place[texts[i]]
                    out[i] = [whole] if whole >= 0 else []
        return out


@functools.lru_cache(maxsize=2)
def pair_at(first: str, second: str) -> Pair:
    """The tokenizers, loaded once in a worker."""
    return Pair(first, second)


def squeezed(values: np.ndarray) -> bytes:
    """Numbers with their like bytes together, compressed."""
    kind = values.dtype.itemsize
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, kind).T).tobytes())


def unsqueezed(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def run_of(keys: np.ndarray, values: np.ndarray) -> bytes:
    """A sorted run in blocks that can be read one by one."""
    out = []
    for at in range(0, len(keys), BLOCK):
        block = [squeezed(np.diff(keys[at : at + BLOCK], prepend=0)), squeezed(values[at : at + BLOCK].astype(np.int64))]
        out += [struct.pack("<II", *map(len, block)), *block]
    return b"".join(out)


def blocks_of(run: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, values) block by block."""
    at = 0
    while at < len(run):
        m, n = struct.unpack_from("<II", run, at)
        at += 8
        yield np.cumsum(unsqueezed(run[at : at + m], np.int64)), unsqueezed(run[at + m : at + m + n], np.int64)
        at += m + n


def merged(runs: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The runs' pairs in order with the sums of their values; one block of a run is open.

    A heap has the last key of each open block: up to the smallest of them all is known.
    """
    streams = [blocks_of(r) for r in runs]
    open_: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    heap: list[tuple[int, int]] = []

    def advance(i: int) -> None:
        block = next(streams[i], None)
        if block is None:
            open_.pop(i, None)
        else:
            open_[i] = block
            heapq.heappush(heap, (int(block[0][-1]), i))

    for i in range(len(runs)):
        advance(i)
    while heap:
        bound = heap[0][0]
        parts = []
        for i, (keys, values) in list(open_.items()):
            n = int(np.searchsorted(keys, bound, side="right"))
            if n:
                parts.append((keys[:n], values[:n]))
                open_[i] = keys[n:], values[n:]
        while heap and heap[0][0] == bound:
            advance(heapq.heappop(heap)[1])
        keys, values = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(keys, kind="stable")
        keys, values = keys[order], values[order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        yield keys[first], np.add.reduceat(values, first)


def merged_run(runs: list[bytes]) -> bytes:
    return runs[0] if len(runs) == 1 else b"".join(run_of(k, v) for k, v in merged(runs))


def judged(run: bytes) -> bytes:
    """Each pair's count doubled, plus one where no pair of its first id has more. The pairs
    of a first id are neighbours, so one of them at a time is held."""
    out, held = [], (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))

    def flush(keys: np.ndarray, values: np.ndarray) -> None:
        first = np.flatnonzero(np.diff(keys >> 16, prepend=-1))
        if len(first):
            most = np.repeat(np.maximum.reduceat(values, first), np.diff(np.append(first, len(keys))))
            out.append(run_of(keys, 2 * values + (values == most)))

    for block in blocks_of(run):
        keys, values = (np.concatenate(x) for x in zip(held, block))
        cut = int(np.searchsorted(keys, keys[-1] >> 16 << 16))
        flush(keys[:cut], values[:cut])
        held = keys[cut:], values[cut:]
    flush(*held)
    return b"".join(out)


def answered(run: bytes, answer: bytes) -> bytes:
    """The run with its values taken from an answer that has all its keys."""
    out, source = [], blocks_of(answer)
    keys, values = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    for asked, _ in blocks_of(run):
        have = [(keys, values)]
        while not len(have[-1][0]) or have[-1][0][-1] < asked[-1]:
            have.append(next(source))
        keys, values = (np.concatenate(x) for x in zip(*have))
        at = np.searchsorted(keys, asked)
        out.append(run_of(asked, values[at]))
        keys, values = keys[at[-1] :], values[at[-1] :]
    return b"".join(out)


def records(docs: DataFrame, first: str, second: str, id_col: str, text_col: str) -> DataFrame:
    """One row for each slice: its documents' own numbers, its runs, and the documents and
    multiplicities of each pair of the runs."""
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_at(first, second)
        for piece in slices(batches, "text", SLICE_CHARS):
            for at in range(0, piece.num_rows, SLICE_ROWS):
                yield one(pair, piece.slice(at, SLICE_ROWS))

    def one(pair: Pair, rows: pa.RecordBatch) -> pa.RecordBatch:
        found = pair.places(rows.column(1).to_pylist())
        n, sizes = len(found), np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        chunk, doc = np.fromiter(chain.from_iterable(found), dtype=np.int64), np.repeat(np.arange(n), sizes)
        sums = np.zeros((n, 4), dtype=np.int64)
        n_links = np.diff(pair.begin)
        for i, x in enumerate([*pair.counts.T, n_links]):
            sums[:, i] = np.bincount(doc, x[chunk], minlength=n)
        named = [hashlib.sha256(";".join(map(pair.groups.__getitem__, c)).encode()).hexdigest() if c else "" for c in found]
        # Equal chunks of a document are one, with a multiplicity.
        code, times = np.unique(doc * len(pair.groups) + chunk, return_counts=True)
        doc, chunk = np.divmod(code, max(1, len(pair.groups)))
        size = n_links[chunk]
        at = np.repeat(pair.begin[chunk] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        link = pair.links[at]
        # Radix, first id, second id, document: one sort puts all in place.
        code = ((link >> 16) % RADIX << 32 | link) << 14 | np.repeat(doc, size)
        order = np.argsort(code, kind="stable")
        code, times = code[order], np.repeat(times, size)[order]
        head = np.flatnonzero(np.diff(code, prepend=-1))
        times, code = np.add.reduceat(times, head) if len(head) else times, code[head]
        doc, code = code & (SLICE_ROWS - 1), code >> 14
        head = np.flatnonzero(np.diff(code, prepend=-1))
        held = np.diff(np.append(head, len(code)))
        keys, radix = code[head] & (1 << 32) - 1, code[head] >> 32
        cuts = np.searchsorted(radix, np.arange(RADIX + 1))
        runs = [run_of(keys[a:b], held[a:b]) for a, b in zip(cuts, cuts[1:])]
        posts = [squeezed(held.astype(np.uint16)), squeezed(doc.astype(np.uint16)), squeezed(times.astype(np.uint32))]
        columns = [pa.array([x], t) for x, t in ((sums.T.reshape(-1), pa.list_(pa.int64())), (named, pa.list_(pa.string())), (runs, pa.list_(pa.binary())), (posts, pa.list_(pa.binary())))]
        ids = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), rows.column(0))
        return pa.RecordBatch.from_arrays([ids, *columns], names=["ids", "sums", "named", "runs", "posts"])

    slim = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    made = slim.mapInArrow(work, f"ids array<{kind}>, sums array<bigint>, named array<string>, runs array<binary>, posts array<binary>")
    return stored(made.withColumn("slice", F.monotonically_increasing_id()), "alignment-slices")


def by_key(rows: DataFrame, keys: list[str], last: list[str], schema: str, fn) -> DataFrame:
    """``fn(key, rows)`` over the whole groups of a key, streamed in order within tasks."""
    width = len(keys)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns))

        now, held = None, []
        for row in each():
            if row[:width] != now:
                if held:
                    yield from fn(now, held)
                now, held = row[:width], []
            held.append(row[width:])
        if held:
            yield from fn(now, held)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *last).mapInArrow(work, schema)


LEVEL = "radix int, node long, run binary"


def level_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary()))], names=["radix", "node", "run"])


def raised(level: DataFrame, parent: Column) -> DataFrame:
    """The runs of each parent merged to one."""

    def merge(key: tuple, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        yield level_rows([(*key, merged_run([r[0] for r in rows if r[0]]))])

    return stored(by_key(level.filter(F.length("run") > 0).select("radix", parent.alias("node"), "run"), ["radix", "node"], [], LEVEL, merge), "pair-counts")


def lowered(level: DataFrame, parent: Column, answers: DataFrame) -> DataFrame:
    """The answers of each run of a level, from those of its parents."""

    def answer(key: tuple, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        for own, run in rows[1:]:
            yield level_rows([(key[0], own, answered(run, rows[0][1]))])

    asked = level.filter(F.length("run") > 0).select("radix", parent.alias("parent"), "node", "run")
    both = answers.select("radix", F.col("node").alias("parent"), F.lit(None).cast("long").alias("node"), "run").union(asked)
    return stored(by_key(both, ["radix", "parent"], ["node"], LEVEL, answer), "pair-answers")


def align(
    docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text", fan: int = FAN
) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    ``first`` is a byte-level tokenizer file, which encodes a space and the text; ``second``
    a sentencepiece model, which adds that space itself. Null and empty texts and texts that
    either tokenizer does not give back byte for byte have no tokens: zeros and an empty
    digest. Every row counts as a document, a repeated one and one without an id too; other
    columns do not matter; an empty table gives none.

    A task holds one slice, the chunks it remembers, or the compressed runs of one node of
    the tree, of ``fan`` children on average; a first id that a third of all links have is as
    long as its different partners.
    """
    made = records(docs, first, second, id_col, text_col)
    count = made.count()
    leaf = made.select(F.posexplode("runs").alias("radix", "run"), F.col("slice").alias("node"))
    # Nodes are numbered by the last bits of a hash, fewer on each level.
    step = max(1, (fan - 1).bit_length())
    bits = max(0, -(-count // fan) - 1).bit_length()
    levels: list[tuple[DataFrame, Column]] = [(leaf, F.xxhash64("node").bitwiseAND((1 << bits) - 1))]
    while True:
        made_up = raised(*levels[-1])
        if not bits:
            break
        bits = max(0, bits - step)
        levels.append((made_up, F.col("node").bitwiseAND((1 << bits) - 1)))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                yield level_rows([(row[0], row[1], judged(row[2]))])

    answers = stored(made_up.repartition("radix").mapInArrow(judge, LEVEL), "pair-answers")
    for level, parent in reversed(levels):
        answers = lowered(level, parent, answers)

    # A slice has RADIX answers at most.
    known = answers.groupBy(F.col("node").alias("slice")).agg(F.sort_array(F.collect_list(F.struct("radix", "run"))).getField("run").alias("known"))
    whole = made.select("slice", "ids", "sums", "named", "posts").join(known, "slice", "left")
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield total(batch.slice(i, 1))

    def total(row: pa.RecordBatch) -> pa.RecordBatch:
        ids, sums, named, posts, runs = (row.column(i) for i in range(1, 6))
        n = len(ids.flatten())
        share = np.zeros((2, n), dtype=np.int64)
        held, doc, times = (unsqueezed(x, t) for x, t in zip(posts[0].as_py(), (np.uint16, np.uint16, np.uint32)))
        if len(held):
            judged_ = np.concatenate([v for r in runs[0].as_py() for _, v in blocks_of(r)])
            of_post, times, doc = np.repeat(judged_, held), times.astype(np.int64), doc.astype(np.int64)
            np.add.at(share[0], doc, times * (of_post & 1))
            np.add.at(share[1], doc, times * (of_post >> 1))
        numbers = np.concatenate([sums.flatten().to_numpy().reshape(4, n), share])
        return pa.RecordBatch.from_arrays([ids.flatten(), *map(pa.array, numbers), named.flatten()], names=["doc_id", *names, "groups_sha256"])

    fields = ", ".join(f"{x} long" for x in names)
    return whole.select("slice", "ids", "sums", "named", "posts", "known").mapInArrow(add, f"doc_id {kind}, {fields}, groups_sha256 string")
