"""Near-duplicates by SimHash: blocks that close pairs share, join on blocks, verified
distance.

``near_duplicates`` links 64-bit fingerprints a few bits apart, exactly, by the pigeonhole
principle. Texts of a Jaccard similarity of 0.8 are some ten of 64 bits apart, too many for
that. ``similar_documents`` (module ``similar``) therefore links by the exact similarity of
the shingle sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waterspark.llm.components import components
from waterspark.llm.shared import map_slices, stored, text_of

WORDS = 4
DISTANCE = 4
BITS = 64
#: A fingerprint is cut in DISTANCE + SHARED blocks, so a linked pair agrees in SHARED of them.
SHARED = 2
#: A crowded block value is compared in pieces of so many fingerprints.
PIECE = 4096
SLICE_CHARS = 1_000_000
#: Groups are compared in runs of about so many rows or bytes.
HELD_ROWS, HELD_BYTES = 100_000, 1 << 22


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included; of a shorter text as a whole."""
    import xxhash

    cut = text.lower().split()
    if not cut:
        return np.array([], dtype=np.uint64)
    joined = b" ".join(cut)
    if len(cut) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], dtype=np.uint64)
    lengths = np.fromiter(map(len, cut), dtype=np.int64, count=len(cut))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(cut) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[words - 1 :].tolist())], dtype=np.uint64)


def majority(hashes: np.ndarray) -> bytes:
    """The bits that are set in over half of the hashes, as eight bytes."""
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        # Eight one-byte counters to a word; 255 rows cannot overflow them.
        lanes = np.add.reduceat(bits.view(np.uint64), np.arange(0, len(bits), 255), axis=0)
        counts += lanes.view(np.uint8).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes), bitorder="little").tobytes()


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """SimHash of a text's word shingles, as a signed 64-bit number; no words: 0."""
    return int.from_bytes(majority(shingle_hashes(text, words)), "little", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, fp) of every row over its whole text; null text counts as empty."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [fingerprint(t, words) for t in batch.column(1).cast(pa.binary()).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.int64())], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return map_slices(slim, "text", SLICE_CHARS, f"doc_id {kind}, fp long", work)


def block_keys(fp: Column, distance: int = DISTANCE, shared: int = SHARED) -> Column:
    """All keys made of ``shared`` of ``distance + shared`` blocks: fingerprints at most
    ``distance`` bits apart have at least one in common."""
    n = distance + shared
    cuts = [BITS * i // n for i in range(n + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(n), shared)):
        key = F.lit(number).cast("long")
        for i in chosen:
            width = cuts[i + 1] - cuts[i]
            block = F.shiftrightunsigned(fp, cuts[i]).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
            key = F.shiftleft(key, width).bitwiseOR(block)
        keys.append(key)
    return F.array(*keys)


def joined_roots(fp: np.ndarray, group: np.ndarray, distance: int) -> np.ndarray:
    """Within each run of equal ``group``, the first position that every position is linked
    to, directly or through others.

    Position i is compared with i + 1, i + 2, ... of its run, all runs at once; links go
    into a forest right away and are never listed.
    """
    n = len(fp)
    ends = np.append(np.flatnonzero(np.diff(group)) + 1, n)
    end = np.repeat(ends, np.diff(np.append(0, ends)))
    root, active, step = np.arange(n), np.arange(n), 1
    while True:
        active = active[active + step < end[active]]
        if not len(active):
            return root
        near = active[np.bitwise_count(fp[active] ^ fp[active + step]) <= distance]
        a, b = root[near], root[near + step]
        while (apart := a != b).any():
            a, b = a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (up := root[root]) is not root and (up != root).any():
                root = up
            a, b = root[a], root[b]
        step += 1


def links(distinct: DataFrame, distance: int = DISTANCE, piece: int = PIECE) -> DataFrame:
    """(fp, other): links that connect what pairs within ``distance`` bits connect.

    ``distinct`` holds each fingerprint once. Block values with one fingerprint fall away;
    one with more than ``piece`` is cut in pieces, and each pair of pieces is compared in a
    group of its own, so a group is bounded and no pair of fingerprints is missed. A group
    gives a forest, at most one row per fingerprint.
    """
    members = distinct.select("fp", F.explode(block_keys(F.col("fp"), distance)).alias("key"))
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    placed = in_pieces(members.join(sizes, "key"), piece).select("fp", "grp")
    return placed.repartition("grp").sortWithinPartitions("grp", "fp").mapInArrow(by_group(partial(forest, distance=distance)), "fp long, other long")


def in_pieces(members: DataFrame, piece: int) -> DataFrame:
    """Adds ``grp``: rows of a ``key`` shared by ``n`` once for each pair of pieces that
    their piece is in."""
    mine = F.pmod(F.xxhash64("fp"), F.col("pieces"))
    return (
        members.withColumn("pieces", F.ceil(F.col("n") / piece).cast("long"))
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
        .withColumn("grp", F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")))
    )


def forest(rows: pa.RecordBatch, distance: int) -> Iterator[pa.RecordBatch]:
    """Links (fp, other) within the groups of rows (fp, grp), one row per fingerprint at most."""
    fp = rows.column(0).to_numpy()
    root = joined_roots(fp.view(np.uint64), rows.column(1).to_numpy(), distance)
    at = np.flatnonzero(root != np.arange(len(root)))
    yield linked(fp, at, root[at])


def linked(fp: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], names=["fp", "other"])


def by_group(compare: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]) -> Callable:
    """Arrow function over rows (fp, grp, ...) sorted by group, which ``compare`` gets in
    runs of whole groups."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) >= HELD_ROWS or sum(b.nbytes for b in held) >= HELD_BYTES:
                # The last group may go on in the next batch.
                whole, last = pa.Table.from_batches(held).combine_chunks().to_batches()[0], batch.column(1)[-1].as_py()
                cut = int(np.flatnonzero(whole.column(1).to_numpy() == last)[0])
                if cut:
                    yield from compare(whole.slice(0, cut))
                held = [whole.slice(cut)]
        if held:
            yield from compare(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return work


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id): fingerprint of every row, and the smallest id that links
    of at most ``distance`` differing bits lead to, its own included.

    Null and empty texts have fingerprint 0 and link like any other; equal fingerprints are
    one node, so copies cost nothing; a row without an id joins its component, and a
    component without any id has a null one. Other columns do not matter.
    """
    marked = stored(fingerprints(docs, id_col, text_col, words), "fingerprints")
    nodes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    return with_components(marked, nodes, links(nodes.select("fp"), distance)).select("doc_id", "fp", "component_id")


def with_components(marked: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Adds the smallest id of the component to rows (doc_id, fp); ``nodes`` has each
    fingerprint with its ``first`` id."""
    stars = components(pairs, "fp", "other")
    rooted = nodes.join(stars, nodes["fp"] == stars["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp")
