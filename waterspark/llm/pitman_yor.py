"""Language-model scores by a hierarchical Pitman-Yor process.

Restaurants form four levels: one for each word before (the context), one for each class of
contexts, one for each coarse class, and one root above them all, over a uniform base. The
``CONTEXTS`` classes tell short words, which carry the grammar, by a hash of their own, and
long words by their endings. Contexts are as many as the corpus has words, and so are the
dishes.

All state of a dish lies in one shard, so seating needs no exchange but the number of tables
of each restaurant: a few thousand sums of the classes, and the sums of the contexts, which
shards send to blocks of contexts and get back for those they hold. Words are only ever
counted in chunks of documents first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waterspark.llm.shared import discard, slices, stored, text_of

SHORT, SHORT_KINDS, ENDINGS, ENDING_KINDS = 4, 512, 64, 32
CONTEXTS = 1 + SHORT * SHORT_KINDS + ENDINGS * ENDING_KINDS
PARENTS = 1 + SHORT + ENDINGS
STRENGTH = 1.0
#: Sweeps that are thrown away, and sweeps whose predictions are averaged.
BURN, SAMPLES = 1, 3
#: Tokens that a task counts together, and counted cells that a shard merges, about.
CHUNK_TOKENS = 3_000_000
SHARD_CELLS = 2_000_000
LEAST_SHARDS = 24
#: Contexts of shards whose sums a block adds up, about.
BLOCK_KEYS = 1_000_000
LEAST_BLOCKS = 8
SLICE_CHARS = 4_000_000
#: Key of the context at the start of a text.
START = np.uint64(0)


def parent_of(context: np.ndarray) -> np.ndarray:
    """Coarse class of a context."""
    long = 1 + SHORT + (context - 1 - SHORT * SHORT_KINDS) // ENDING_KINDS
    return np.where(context == 0, 0, np.where(context <= SHORT * SHORT_KINDS, 1 + (context - 1) // SHORT_KINDS, long))


def context_of(word: bytes, digest: int) -> int:
    """Class of the context that a word makes for its follower; 0 stands for the start of a
    text."""
    import xxhash

    if len(word) <= SHORT:
        return 1 + (len(word) - 1) * SHORT_KINDS + digest % SHORT_KINDS
    return 1 + SHORT * SHORT_KINDS + word[-1] % ENDINGS * ENDING_KINDS + xxhash.xxh64_intdigest(word[-3:]) % ENDING_KINDS


def pack(values: np.ndarray) -> bytes:
    """Compressed, byte planes apart."""
    import zstandard

    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(values.dtype.char.encode() + planes.tobytes())


def pack_steps(ascending: np.ndarray) -> bytes:
    """Compressed, each value as the distance from the one before."""
    return pack(np.diff(ascending, prepend=ascending.dtype.type(0)))


def unpack_steps(raw: bytes) -> np.ndarray:
    steps = unpack(raw)
    return np.cumsum(steps, dtype=steps.dtype)


def unpack(raw: bytes) -> np.ndarray:
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(raw)
    kind = np.dtype(data[:1].decode())
    return np.frombuffer(data, dtype=np.uint8, offset=1).reshape(kind.itemsize, -1).T.copy().view(kind).ravel()


class Numbered(dict):
    """Numbers words in the order they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class Chunk:
    """Tokens of some documents, and what becomes of them: distinct (word, context) cells
    in the order of word hashes, with training counts, and each document's cells."""

    def __init__(self) -> None:
        self.words, self.ids, self.docs, self.train, self.size = Numbered({b"": 0}), [], [], [], 0

    def add(self, doc_id: object, text: bytes, train: bool) -> None:
        tokens = list(map(self.words.__getitem__, text.lower().split()))
        tokens.append(0)  # the end, hashed as the empty word
        self.ids.append(np.array(tokens, dtype=np.int32))
        self.docs.append(doc_id)
        self.train.append(train)
        self.size += len(tokens)

    def row(self) -> dict:
        import xxhash

        digest = np.array([xxhash.xxh64_intdigest(w) for w in self.words], dtype=np.uint64)
        classes = np.array([0, *(context_of(w, int(d)) for w, d in zip(list(self.words)[1:], digest[1:]))], dtype=np.uint16)
        order = np.argsort(digest, kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        sizes = np.fromiter(map(len, self.ids), dtype=np.int64, count=len(self.ids))
        tokens = np.concatenate(self.ids)
        # The place of the word before, from 1; 0 is the start of a text.
        before = np.append(0, place[tokens[:-1]] + 1)
        before[np.append(0, np.cumsum(sizes)[:-1])] = 0
        width = len(order) + 1
        cells, cell = np.unique(place[tokens] * width + before, return_inverse=True)
        train = np.repeat(np.array(self.train), sizes)
        counts = np.bincount(cell[train], minlength=len(cells))
        # Cells of a document in order, each as the distance from the one before.
        doc = np.repeat(np.arange(len(sizes)), sizes)
        cell = cell[np.lexsort((cell, doc))]
        steps = np.diff(cell, prepend=0)
        first = np.append(0, np.cumsum(sizes)[:-1])
        steps[first] = cell[first]
        return {
            "words": pack_steps(digest[order]),
            "classes": pack(classes[order]),
            "spread": pack(np.bincount(cells // width, minlength=len(order)).astype(np.uint32)),
            "contexts": pack((cells % width).astype(np.uint32)),
            "counts": pack(counts.astype(np.uint32)),
            "cells": len(cells),
            "trained": int(counts.sum()),
            "refs": pack(steps.astype(np.uint32)),
            "sizes": sizes.tolist(),
            "docs": self.docs,
            "held": [not t for t in self.train],
        }


def count_chunks(slim: DataFrame) -> DataFrame:
    """One row for each chunk of documents of a task."""
    kind = slim.schema["doc_id"].dataType.simpleString()
    names = ["chunk", "words", "classes", "spread", "contexts", "counts", "cells", "trained", "refs", "sizes", "docs", "held"]
    blobs = {"words", "classes", "spread", "contexts", "counts", "refs"}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, chunk = TaskContext.get().partitionId() << 24, Chunk()
        doc_kind = None

        def made() -> pa.RecordBatch:
            row = chunk.row()
            arrays = [pa.array([number], pa.int64())]
            for name in names[1:]:
                arrays.append(pa.array([row[name]], pa.binary() if name in blobs else pa.int64() if name in ("cells", "trained") else pa.list_(pa.int64() if name == "sizes" else pa.bool_() if name == "held" else doc_kind)))
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in slices(batches, "text", SLICE_CHARS):
            doc_kind = batch.schema.field("doc_id").type
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for doc_id, text, held in zip(batch.column("doc_id").to_pylist(), texts, batch.column("held").to_pylist()):
                chunk.add(doc_id, text, not held)
                if chunk.size >= CHUNK_TOKENS:
                    yield made()
                    number, chunk = number + 1, Chunk()
        if chunk.size:
            yield made()

    schema = (
        "chunk long, words binary, classes binary, spread binary, contexts binary, counts binary, cells long, trained long, "
        f"refs binary, sizes array<long>, docs array<{kind}>, held array<boolean>"
    )
    return slim.mapInArrow(work, schema)


def scatter(chunks: DataFrame, shards: int) -> DataFrame:
    """The cells of each chunk dealt to shards by ranges of the word hash, with the hashes and
    classes of the contexts among them."""
    names = ["shard", "chunk", "words", "spread", "keys", "classes", "contexts", "counts"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, spread = unpack_steps(row["words"]), unpack(row["spread"])
                contexts, counts = unpack(row["contexts"]), unpack(row["counts"])
                key, kind = np.append(START, words), np.append(np.uint16(0), unpack(row["classes"]))
                shard = (words >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
                cut = np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64))
                edge = np.append(0, np.cumsum(spread, dtype=np.int64))
                out = []
                for s in range(shards):
                    a, b = cut[s], cut[s + 1]
                    if a < b:
                        c = slice(edge[a], edge[b])
                        used, index = np.unique(contexts[c], return_inverse=True)
                        out.append((
                            s, row["chunk"], pack_steps(words[a:b]), pack(spread[a:b]), pack_steps(key[used]), pack(kind[used]), pack(index.astype(np.uint32)), pack(counts[c]),
                        ))
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[2:])],
                    names=names,
                )

    slim = chunks.select("chunk", "words", "classes", "spread", "contexts", "counts")
    return slim.mapInArrow(work, "shard int, chunk long, " + ", ".join(f"{n} binary" for n in names[2:]))


def merge_shard(table: pa.Table) -> pa.Table:
    """All chunks' cells of a shard as one: contexts, words and their cells with summed
    counts, and for each chunk the places of its cells."""
    rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
    parts = [(unpack_steps(r["words"]), unpack(r["spread"]), unpack_steps(r["keys"]), unpack(r["contexts"])) for r in rows]
    words = np.unique(np.concatenate([p[0] for p in parts]))
    keys, one = np.unique(np.concatenate([p[2] for p in parts]), return_index=True)
    classes = np.concatenate([unpack(r["classes"]) for r in rows])[one]
    width = len(keys)
    ids = [np.repeat(np.searchsorted(words, w), s) * width + np.searchsorted(keys, k)[c] for w, s, k, c in parts]
    cells, at = np.unique(np.concatenate(ids), return_inverse=True)
    counts = np.bincount(at, np.concatenate([unpack(r["counts"]) for r in rows]).astype(np.float64), len(cells)).astype(np.uint32)
    ends = np.cumsum([len(k) for k in ids])
    places = [{"chunk": r["chunk"], "at": pack(np.diff(at[e - len(k) : e], prepend=0).astype(np.uint32)), "spread": r["spread"]} for r, k, e in zip(rows, ids, ends)]
    kind = pa.list_(pa.struct([("chunk", pa.int64()), ("at", pa.binary()), ("spread", pa.binary())]))
    word = cells // width
    known = np.bincount(word, counts, len(words)) > 0
    return pa.table({
        "shard": pa.array([rows[0]["shard"]], pa.int32()),
        "known": pa.array([int(known.sum())], pa.int64()),
        "width": pa.array([width], pa.int64()),
        "spread": pa.array([pack(np.bincount(word, minlength=len(words)).astype(np.uint32))], pa.binary()),
        "keys": pa.array([pack_steps(keys)], pa.binary()),
        "classes": pa.array([pack(classes)], pa.binary()),
        "contexts": pa.array([pack((cells % width).astype(np.uint32))], pa.binary()),
        "counts": pa.array([pack(counts)], pa.binary()),
        "places": pa.array([places], kind),
    })


SHARD_SCHEMA = (
    "shard int, known long, width long, spread binary, keys binary, classes binary, contexts binary, counts binary, "
    "places array<struct<chunk:bigint,at:binary,spread:binary>>"
)


@dataclass
class Totals:
    """Customers and tables of every restaurant: classes of contexts, coarse classes, root."""

    customers: np.ndarray
    tables: np.ndarray

    @staticmethod
    def of(flat: np.ndarray, customers: np.ndarray) -> Totals:
        """From the tables of classes, coarse classes and root; the tables of a restaurant
        are the customers of its parent."""
        contexts, classes = flat[:CONTEXTS], flat[CONTEXTS : CONTEXTS + PARENTS]
        above = np.bincount(parent_of(np.arange(CONTEXTS)), contexts, PARENTS)
        return Totals(np.concatenate([customers, above, [classes.sum()]]), flat)


@dataclass
class Model:
    """What every shard needs: discounts of the levels of classes, totals after each sweep,
    the number of words, and the discount of the contexts."""

    discounts: tuple[float, float, float]
    sweeps: list[Totals]
    words: int
    seed: int
    leaf: float = 0.5


class Seating:
    """Tables of one shard above the contexts. A cell is a dish in a restaurant; ``mine`` leads
    from a cell of a class to its cell of the coarse class, ``word`` from there to the root's."""

    def __init__(self, spread: np.ndarray, contexts: np.ndarray, counts: np.ndarray) -> None:
        words = len(spread)
        word = np.repeat(np.arange(words), spread)
        self.context, self.count = contexts.astype(np.int64), counts
        keys, self.mine = np.unique(word * PARENTS + parent_of(self.context), return_inverse=True)
        self.parent, self.word, self.words = keys % PARENTS, keys // PARENTS, words
        # At first every dish has one table.
        self.tables = (counts > 0).astype(np.int64)
        self.class_tables = (np.bincount(self.mine, self.tables, len(keys)) > 0).astype(np.int64)
        self.root_tables = (np.bincount(self.word, self.class_tables, words) > 0).astype(np.int64)
        self.recount()

    def recount(self) -> None:
        """Customers of the upper levels: the tables below them."""
        self.class_count = np.bincount(self.mine, self.tables, len(self.parent)).astype(np.int64)
        self.root_count = np.bincount(self.word, self.class_tables, self.words).astype(np.int64)

    def totals(self) -> np.ndarray:
        return np.concatenate([
            np.bincount(self.context, self.tables, CONTEXTS), np.bincount(self.parent, self.class_tables, PARENTS), [self.root_tables.sum()],
        ])

    def predict(self, model: Model, totals: Totals) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Predictive probability of the dish of every cell of contexts, classes and root."""
        d, base = model.discounts, 1 / (model.words + 1)
        last = CONTEXTS + PARENTS

        def level(count: np.ndarray, tables: np.ndarray, house: np.ndarray | int, discount: float, above: np.ndarray | float) -> np.ndarray:
            seated, t = totals.customers[house], totals.tables[house]
            return (count - discount * tables + (STRENGTH + discount * t) * above) / (STRENGTH + seated)

        root = level(self.root_count, self.root_tables, last, d[2], base)
        classes = level(self.class_count, self.class_tables, CONTEXTS + self.parent, d[1], root[self.word])
        return level(self.count, self.tables, self.context, d[0], classes[self.mine]), classes, root

    def sweep(self, model: Model, totals: Totals, random: np.random.Generator) -> None:
        """One Gibbs sweep: the customers of every dish leave and are seated again, given
        the other dishes' tables, from the contexts up to the root."""
        d, last = model.discounts, CONTEXTS + PARENTS
        _, classes, root = self.predict(model, totals)

        def house(place: np.ndarray | int, tables: np.ndarray, discount: float) -> np.ndarray:
            return STRENGTH + discount * np.maximum(totals.tables[place] - tables, 0)

        self.tables = seat(self.count, house(self.context, self.tables, d[0]) * classes[self.mine], d[0], random)
        self.class_count = np.bincount(self.mine, self.tables, len(self.parent)).astype(np.int64)
        self.class_tables = seat(self.class_count, house(CONTEXTS + self.parent, self.class_tables, d[1]) * root[self.word], d[1], random)
        self.root_count = np.bincount(self.word, self.class_tables, self.words).astype(np.int64)
        self.root_tables = seat(self.root_count, house(last, self.root_tables, d[2]) / (model.words + 1), d[2], random)


def seat(customers: np.ndarray, new: np.ndarray, discount: float, random: np.random.Generator) -> np.ndarray:
    """Tables that the customers of each dish take one after another: a new one with weight
    ``new``, one of theirs with its customers less the discount.

    All dishes are seated side by side. Where n sit already the next n / 16 are seated at
    once, so the number of steps grows with the logarithm of the customers.
    """
    tables = (customers > 0).astype(np.int64)
    at = np.flatnonzero(customers > 1)
    seated, goal, weight, t = np.ones(len(at), dtype=np.int64), customers[at], new[at], np.ones(len(at), dtype=np.int64)
    while len(at):
        come = np.minimum(goal - seated, np.maximum(1, seated >> 4))
        t += random.binomial(come, weight / (weight + seated - discount * t))
        seated += come
        done = seated >= goal
        if done.any():
            tables[at[done]] = t[done]
            at, seated, goal, weight, t = (x[~done] for x in (at, seated, goal, weight, t))
    return tables


class Leaves:
    """Tables of the contexts of one shard, and the seating of their classes above them."""

    def __init__(self, row: dict) -> None:
        spread, classes = unpack(row["spread"]), unpack(row["classes"]).astype(np.int64)
        self.words, self.width = len(spread), len(classes)
        self.word = np.repeat(np.arange(self.words), spread)
        self.context, self.count = unpack(row["contexts"]), unpack(row["counts"]).astype(np.int64)
        cells, self.mine = np.unique(self.word * CONTEXTS + classes[self.context], return_inverse=True)
        self.tables = (self.count > 0).astype(np.int64)
        seated = np.bincount(self.mine, self.tables, len(cells)).astype(np.int64)
        self.above = Seating(np.bincount(cells // CONTEXTS, minlength=self.words), cells % CONTEXTS, seated)

    def state(self) -> list[bytes]:
        up = self.above
        return [pack(t.astype(np.uint32)) for t in (self.tables, up.tables, up.class_tables, up.root_tables)]

    def resume(self, state: list[bytes]) -> None:
        up = self.above
        self.tables, up.tables, up.class_tables, up.root_tables = (unpack(t).astype(np.int64) for t in state)
        up.count = np.bincount(self.mine, self.tables, len(up.context)).astype(np.int64)
        up.recount()

    def sums(self) -> np.ndarray:
        """Tables of the classes' restaurants, customers of the classes, and dishes with one
        and with two customers on each level."""
        up = self.above
        few = [float((c == n).sum()) for c in (self.count, up.count, up.class_count, up.root_count) for n in (1, 2)]
        return np.concatenate([up.totals(), np.bincount(up.context, up.count, CONTEXTS), few])

    def own(self) -> tuple[np.ndarray, np.ndarray]:
        """Customers and tables of each context in this shard."""
        return tuple(np.bincount(self.context, n, self.width).astype(np.uint32) for n in (self.count, self.tables))

    def predict(self, model: Model, totals: Totals, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Predictive probability of the dish of every cell, given the customers and tables
        of the contexts over all shards."""
        up = self.above.predict(model, totals)[0][self.mine]
        new = STRENGTH + model.leaf * tables[self.context]
        return (self.count - model.leaf * self.tables + new * up) / (STRENGTH + customers[self.context])

    def sweep(self, model: Model, totals: Totals, tables: np.ndarray, random: np.random.Generator) -> None:
        """One Gibbs sweep, from the contexts up to the root."""
        up = self.above.predict(model, totals)[0][self.mine]
        others = np.maximum(tables[self.context] - self.tables, 0)
        self.tables = seat(self.count, (STRENGTH + model.leaf * others) * up, model.leaf, random)
        self.above.count = np.bincount(self.mine, self.tables, len(self.above.context)).astype(np.int64)
        self.above.sweep(model, totals, random)


#: What shards tell after a sweep: sums of contexts for a block, or (block STATE) their own
#: tables and the sums of the classes.
STATE = -1
NEWS = "sweep int, block int, shard int, ids binary, customers binary, tables binary, state array<binary>, at array<int>, n array<long>"
NEWS_TYPES = [pa.int32()] * 3 + [pa.binary()] * 3 + [pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int64())]


def told(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(NEWS_TYPES)
    return pa.table([pa.array(c, t) for c, t in zip(columns, NEWS_TYPES)], names=[f.split()[0] for f in NEWS.split(", ")])


def heard(news: list[dict]) -> tuple[list[dict], np.ndarray, np.ndarray, list[bytes]]:
    """Block rows in order, customers and tables of the shard's contexts, and its state."""
    blocks = sorted((r for r in news if r["block"] != STATE), key=lambda r: r["block"])
    customers, tables = (np.concatenate([unpack(r[c]) for r in blocks]).astype(np.int64) for c in ("customers", "tables"))
    return blocks, customers, tables, next(r["state"] for r in news if r["block"] == STATE)


def tell(row: dict, leaves: Leaves, sweep: int, edges: list[tuple[int, int, int, bytes]]) -> pa.Table:
    customers, tables = leaves.own()
    total = leaves.sums()
    at = np.flatnonzero(total)
    out = [(sweep, block, row["shard"], ids, pack(customers[a:b]), pack(tables[a:b]), None, None, None) for block, a, b, ids in edges]
    out.append((sweep, STATE, row["shard"], None, None, None, leaves.state(), at.astype(np.int32), total[at].astype(np.int64)))
    return told(out)


def open_tables(shards: DataFrame, blocks: int) -> DataFrame:
    """What shards tell before the first sweep; contexts go to blocks by ranges of their key."""

    def work(table: pa.Table) -> pa.Table:
        row = table.to_pylist()[0]
        keys = unpack_steps(row["keys"])
        cut = np.searchsorted((keys >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32), np.arange(blocks + 1, dtype=np.uint64))
        edges = [(n, a, b, pack_steps(keys[a:b])) for n, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if a < b]
        return tell(row, Leaves(row), 0, edges)

    return shards.select("shard", "spread", "keys", "classes", "contexts", "counts").groupBy("shard").applyInArrow(work, NEWS)


def add_up(table: pa.Table) -> pa.Table:
    """A block's sums of contexts, back to each shard for the contexts it holds, which are
    numbered in the block from then on."""
    rows = table.to_pylist()
    ids = [unpack_steps(r["ids"]) for r in rows]
    _, number = np.unique(np.concatenate(ids), return_inverse=True)
    customers, tables = (np.bincount(number, np.concatenate([unpack(r[c]) for r in rows])).astype(np.uint32) for c in ("customers", "tables"))
    ends = np.cumsum([len(i) for i in ids])
    out = []
    for r, e, i in zip(rows, ends, ids):
        mine = number[e - len(i) : e]
        out.append((r["sweep"], r["block"], r["shard"], pack_steps(mine.astype(np.uint32)), pack(customers[mine]), pack(tables[mine]), None, None, None))
    return told(out)


def summed(news: DataFrame) -> DataFrame:
    """News with the contexts' sums over all shards."""
    return news.where(F.col("block") != STATE).groupBy("sweep", "block").applyInArrow(add_up, NEWS).unionAll(news.where(F.col("block") == STATE))


def swept(shards: DataFrame, news: DataFrame, model: Model, sweep: int) -> DataFrame:
    """What shards tell after one more sweep."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        blocks, _, tables, state = heard(right.to_pylist())
        leaves = Leaves(row)
        leaves.resume(state)
        leaves.sweep(model, model.sweeps[sweep - 1], tables, np.random.default_rng([model.seed, sweep, row["shard"]]))
        edges, a = [], 0
        for r in blocks:
            b = a + len(unpack(r["ids"]))
            edges.append((r["block"], a, b, r["ids"]))
            a = b
        return tell(row, leaves, sweep, edges)

    own = shards.select("shard", "spread", "classes", "contexts", "counts")
    return own.groupBy("shard").cogroup(news.groupBy("shard")).applyInArrow(work, NEWS)


def class_totals(news: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over all shards: tables of the classes' restaurants, customers of the classes, and
    dishes with one and two customers on each level."""
    width = CONTEXTS + PARENTS + 1
    sums = news.where(F.col("block") == STATE).select(F.explode(F.arrays_zip("at", "n")).alias("s"))
    total = np.zeros(width + CONTEXTS + 8)
    for r in sums.groupBy("s.at").agg(F.sum("s.n").alias("n")).collect():  # one row for each class
        total[r["at"]] = r["n"]
    return total[:width], total[width:-8], total[-8:]


def answer(shards: DataFrame, news: list[DataFrame], model: Model) -> DataFrame:
    """For each chunk and shard the log probability of the chunk's cells, and the training
    count of its words. ``news`` are those of the sweeps whose predictions are averaged."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        leaves, mean = Leaves(row), 0.0
        rows = right.to_pylist()
        for n in sorted({r["sweep"] for r in rows}):
            _, customers, tables, state = heard([r for r in rows if r["sweep"] == n])
            leaves.resume(state)
            mean = mean + leaves.predict(model, model.sweeps[n], customers, tables) / SAMPLES
        score = np.log10(mean).astype(np.float32)
        count = np.bincount(leaves.word, leaves.count, leaves.words).astype(np.int64)
        scores, known = [], []
        for place in row["places"]:
            at = np.cumsum(unpack(place["at"]), dtype=np.uint32)
            first = np.append(0, np.cumsum(unpack(place["spread"]), dtype=np.int64)[:-1])
            scores.append(pack(score[at]))
            known.append(pack(count[leaves.word[at[first]]]))
        return pa.table({
            "chunk": pa.array([p["chunk"] for p in row["places"]], pa.int64()),
            "shard": pa.array([row["shard"]] * len(scores), pa.int32()),
            "scores": pa.array(scores, pa.binary()),
            "known": pa.array(known, pa.binary()),
        })

    own = shards.select("shard", "spread", "classes", "contexts", "counts", "places")
    rest = news[0]
    for more in news[1:]:
        rest = rest.unionAll(more)
    return own.groupBy("shard").cogroup(rest.groupBy("shard")).applyInArrow(work, "chunk long, shard int, scores binary, known binary")


def language_scores(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", seed: int = 11) -> DataFrame:  # noqa: ANN001
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Rows where ``held_out`` (a column condition) is true are scored but not learned from.
    Tokens are the words of the whole text in lower case (A-Z) and one end; a null text
    counts as empty and has the end alone; repeated rows count and are scored as rows. The
    base score is the add-one unigram log10 probability, the score that of the Pitman-Yor
    model, its predictive probabilities averaged over ``SAMPLES`` sweeps. Without training
    tokens both are 0. An empty table gives an empty result.

    Texts are read once, into stored chunks of compressed counts. Their cells go to shards
    by word hash, and the answers come back by chunk; sweeps exchange only sums. The tables
    of each sweep are stored, compressed to a fraction of the cells.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    chunks = stored(count_chunks(slim), "lm-chunks")
    seen = chunks.agg(F.sum("cells").alias("cells"), F.sum("trained").alias("trained")).first()
    count = max(LEAST_SHARDS, -(-(seen["cells"] or 0) // SHARD_CELLS))
    shards = stored(scatter(chunks, count).groupBy("shard").applyInArrow(merge_shard, SHARD_SCHEMA), "lm-shards")
    made = shards.agg(F.sum("known").alias("known"), F.sum("width").alias("width")).first()
    words, trained = made["known"] or 0, seen["trained"] or 0
    model = Model((0.5, 0.5, 0.5), [], words, seed)
    news = []
    for n in range(BURN + SAMPLES + 1):
        blocks = max(LEAST_BLOCKS, -(-(made["width"] or 0) // BLOCK_KEYS))
        raw = stored(swept(shards, news[-1], model, n) if n else open_tables(shards, blocks), "lm-told")
        tables, customers, few = class_totals(raw)
        if n == 0:
            # The usual estimate of a discount from dishes seen once and twice.
            model.leaf, *rest = (float(np.clip(one / max(one + 2 * two, 1), 0.05, 0.95)) for one, two in few.reshape(4, 2))
            model.discounts = tuple(rest)
        model.sweeps.append(Totals.of(tables, customers))
        news.append(stored(summed(raw), "lm-news"))
        discard(raw, *news[n - 1 : n] if n <= BURN + 1 else ())
    divisor = float(trained + words + 1)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"doc_id": [], "held_out": [], "n_tokens": [], "n_known": [], "base_score": [], "score": []}
        answers = sorted(right.to_pylist(), key=lambda r: r["shard"])
        for row in left.to_pylist():
            scores = np.concatenate([unpack(r["scores"]) for r in answers]).astype(np.float64)
            known = np.concatenate([unpack(r["known"]) for r in answers])
            word = np.repeat(np.arange(len(known)), unpack(row["spread"]))
            sizes = np.array(row["sizes"])
            first = np.append(0, np.cumsum(sizes)[:-1])
            steps = unpack(row["refs"]).astype(np.int64)
            along = np.cumsum(steps)
            cell = along - np.repeat(along[first] - steps[first], sizes)
            there = known[word[cell]]
            out["doc_id"] += row["docs"]
            out["held_out"] += row["held"]
            out["n_tokens"].append(sizes)
            out["n_known"].append(np.add.reduceat((there > 0).astype(np.int64), first))
            out["base_score"].append(np.add.reduceat(np.log10((there + 1) / divisor), first))
            out["score"].append(np.add.reduceat(scores[cell], first))
        wide = {c: pa.array(np.concatenate(v) if v else []) if c not in ("doc_id", "held_out") else pa.array(v, left.schema.field("docs").type.value_type if c == "doc_id" else pa.bool_()) for c, v in out.items()}
        return pa.table(wide)

    own = chunks.select("chunk", "spread", "refs", "sizes", "docs", "held")
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    made = own.groupBy("chunk").cogroup(answer(shards, news[BURN + 1 :], model).groupBy("chunk")).applyInArrow(finish, schema)
    return made.withColumn("train_tokens", F.lit(trained).cast("long")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
