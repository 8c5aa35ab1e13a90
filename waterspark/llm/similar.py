"""Near-duplicates by the exact similarity of shingle sets.

Two sets of the similarity t share an element among the first ``n - ceil(t n) + 1`` of each,
in any order that all sets keep. Frequent shingles come last in the order, so that passages
which many texts share bring few of them together. Groups of texts that share an early
shingle are compared inside the group, in two steps: bounds that need no sets mark the few
members that can have a partner there, and only those bring their sets. A group yields a
forest, at most one row per member.

Before that, the fingerprints of ``simhash`` bring together what lies within its few bits.
``keep_one_of_near`` takes all those links as they are, as ``simhash.near_duplicates`` does;
``similar_documents`` has them compared first, by their sets. Texts of the similarity 0.8 are
often further apart, so the early shingles find what fingerprints miss.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waterspark.llm.components import components
from waterspark.llm.shared import discard, map_slices, stored, text_of
from waterspark.llm.simhash import PIECE, by_group, fingerprint, in_pieces, links, shingle_hashes

#: Documents of this similarity (of the sets of their shingles of so many words) are linked.
WORDS, SIMILARITY = 5, 0.8
#: Shingles found so often twice in a slice are frequent; so many of them at most are known
#: by name. They only set the order, any order gives the same links.
FREQUENT, MAX_FREQUENT = 16, 1 << 16
#: A set's elements are counted in so many classes; the smaller counts bound an intersection.
CLASSES = 128
#: Members that are compared with the first of their group at once.
FOLLOWERS = 128
#: Rows of 24 bytes that may be broadcast, after they are counted; beyond, texts are shuffled.
SMALL_SIDE = 500_000
SLICE_CHARS = 500_000
TINY = 1e-6


def digest_of(text_col: str) -> Column:
    return F.unhex(F.md5(text_of(text_col).cast("binary")))


def shingle_sets(batch: pa.RecordBatch, column: int, words: int) -> list[np.ndarray]:
    return [np.unique(shingle_hashes(t, words)) for t in batch.column(column).cast(pa.binary()).to_pylist()]


def frequent_shingles(docs: DataFrame, text_col: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that texts share most, and how often: what occurs once in a slice is not
    counted, so this follows the passages and not the words. At most ``MAX_FREQUENT`` come
    to the driver."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, n = np.unique(np.concatenate([np.array([], np.uint64), *shingle_sets(batch, 0, words)]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(found[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["key", "n"])

    counted = map_slices(docs.select(text_of(text_col).alias("text")), "text", SLICE_CHARS, "key long, n long", work)
    often = counted.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "key").limit(MAX_FREQUENT)
    rows = sorted((r["key"] % 2**64, r["n"]) for r in often.collect())
    return np.array([r[0] for r in rows], dtype=np.uint64), np.array([r[1] for r in rows], dtype=np.int64)


def in_common_order(items: np.ndarray, often: np.ndarray, times: np.ndarray) -> np.ndarray:
    """A sorted set with its frequent elements last, the most frequent at the end."""
    if not len(often):
        return items
    at = np.minimum(np.searchsorted(often, items), len(often) - 1)
    weight = np.where(often[at] == items, times[at], 0)
    return items[np.argsort(weight, kind="stable")]


def class_counts(items: np.ndarray) -> bytes:
    """Elements by class, a byte each; 255 stands for any number from there on."""
    counts = np.bincount((items & np.uint64(CLASSES - 1)).astype(np.int64), minlength=CLASSES)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def outlined(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float) -> DataFrame:
    """(doc_id, digest, fp, print, size, counts, keys) of every row: its text's digest, a number
    for its set, its SimHash, and the bounds and the early shingles of the set."""
    often, times = frequent_shingles(docs, text_col, words)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        import xxhash

        sets = shingle_sets(batch, 2, words)
        fp = np.array([xxhash.xxh64_intdigest(h.tobytes(), 7) for h in sets], dtype=np.uint64).view(np.int64)
        first = [in_common_order(h, often, times)[: len(h) - math.ceil(similarity * len(h) - 1e-9) + 1].view(np.int64) for h in sets]
        prints = pa.array([fingerprint(t) for t in batch.column(2).cast(pa.binary()).to_pylist()], pa.int64())
        ends = np.cumsum([0, *map(len, first)]).astype(np.int32)
        keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(first)))
        counts, size = pa.array(list(map(class_counts, sets)), pa.binary()), pa.array(list(map(len, sets)), pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp), prints, size, counts, keys], names=["doc_id", "digest", "fp", "print", "size", "counts", "keys"])

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("doc_id"), digest_of(text_col).alias("digest"), text_of(text_col).alias("text"))
    return stored(map_slices(slim, "text", SLICE_CHARS, f"doc_id {kind}, digest binary, fp long, print long, size long, counts binary, keys array<long>", work), "outlined")


def needed(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Common elements that sets of these sizes need."""
    return similarity / (1 + similarity) * (a + b) - TINY


def fits(size: np.ndarray, counts: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the members at places a and b can be similar, by their sizes and classes."""
    ok = np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b]) - TINY
    for at in np.array_split(np.flatnonzero(ok), 1 + ok.sum() // (1 << 16)):
        low = np.minimum(counts[a[at]], counts[b[at]])
        # Full classes have no bound.
        ok[at] = (low.sum(axis=1, dtype=np.int64) >= needed(size[a[at]], size[b[at]], similarity)) | (low == 255).any(axis=1)
    return ok


def counts_of(column: pa.Array) -> np.ndarray:
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]].reshape(-1, CLASSES)


def partners(similarity: float):
    """Marks the members that can have a partner of another root in a group and no common
    shingle before it; rows (fp, grp, size, root, place, before, counts) sorted by size."""

    def compare(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        group, size, root, place = (rows.column(i).to_numpy() for i in (1, 2, 3, 4))
        before, counts = rows.column(5), counts_of(rows.column(6))
        ends = np.append(np.flatnonzero(np.diff(group)) + 1, rows.num_rows)
        end = np.repeat(ends, np.diff(np.append(0, ends)))
        marked, known = np.zeros(rows.num_rows, dtype=bool), {}

        def earlier(i: int) -> frozenset:
            if i not in known:
                known[i] = frozenset(before[i].as_py())
            return known[i]

        active, step = np.arange(rows.num_rows), 1
        while True:
            # Sizes rise within a group, so a member is done where the next is too large.
            active = active[active + step < end[active]]
            active = active[similarity * size[active + step] <= size[active] + TINY]
            if not len(active):
                break
            a, b = active[root[active] != root[active + step]], active[root[active] != root[active + step]] + step
            rest = np.minimum(size[a] - place[a], size[b] - place[b])
            close = rest >= needed(size[a], size[b], similarity)
            a, b = a[close], b[close]
            close = fits(size, counts, a, b, similarity)
            for i, j in zip(a[close].tolist(), b[close].tolist()):
                if not (marked[i] and marked[j]) and earlier(i).isdisjoint(earlier(j)):
                    marked[i] = marked[j] = True
            step += 1
        yield rows.filter(pa.array(marked)).select(["fp", "grp", "root", "before"])

    return compare


def verified_forest(similarity: float):
    """Exact links within groups of rows (fp, grp, root, before, items), as a forest."""

    def compare(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        group = rows.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), rows.num_rows]
        fp, pairs = rows.column(0).to_numpy(), []
        for lo, hi in zip(cuts, cuts[1:]):
            pairs += [(lo + i, lo + j) for i, j in one(rows.slice(lo, hi - lo))]
        if pairs:
            a, b = np.array(pairs).T
            yield pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], names=["fp", "other"])

    def one(rows: pa.RecordBatch) -> list[tuple[int, int]]:
        sets = [np.frombuffer(x, dtype=np.uint64) for x in rows.column(4).to_pylist()]
        size = np.array(list(map(len, sets)))
        counts, before = counts_of(pa.array(list(map(class_counts, sets)), pa.binary())), [frozenset(x) for x in rows.column(3).to_pylist()]
        # Members of one root are united already.
        names = {r: i for i, r in reversed(list(enumerate(rows.column(2).to_pylist())))}
        root = np.array([names[r] for r in rows.column(2).to_pylist()])
        _, codes = np.unique(np.concatenate(sets), return_inverse=True)
        begin, found = np.cumsum(np.append(0, size)), []
        mark = np.zeros(int(codes.max(initial=-1)) + 1, dtype=np.int64)
        for i in range(rows.num_rows - 1):
            later = np.arange(i + 1, rows.num_rows)
            later = later[root[later] != root[i]]
            later = later[fits(size, counts, np.full(len(later), i), later, similarity)]
            later = [j for j in later.tolist() if before[i].isdisjoint(before[j])]
            if not later:
                continue
            mark[codes[begin[i] : begin[i + 1]]] = 1
            for j in later:
                if root[i] != root[j]:
                    both = int(mark[codes[begin[j] : begin[j + 1]]].sum())
                    if both >= similarity * (size[i] + size[j] - both) - 1e-9:
                        found.append((i, j))
                        old, new = max(root[i], root[j]), min(root[i], root[j])
                        root[root == old] = new
            mark[codes[begin[i] : begin[i + 1]]] = 0
        return found

    return compare


def sets_of(docs: DataFrame, text_col: str, nodes: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(fp, items) of the wanted nodes; each text is opened once."""

    def opened(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [h.tobytes() for h in shingle_sets(batch, 1, words)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["fp", "items"])

    asked = stored(nodes.join(wanted.select("fp").distinct(), "fp").select("fp", "digest"), "asked-sets")
    if asked.count() <= SMALL_SIDE:
        asked = F.broadcast(asked)
    texts = docs.select(digest_of(text_col).alias("digest"), text_of(text_col).alias("text"))
    once = texts.join(asked, "digest").dropDuplicates(["digest"]).select("fp", "text")
    return stored(map_slices(once, "text", SLICE_CHARS, "fp long, items binary", opened), "shingle-sets")


def first_links(docs: DataFrame, text_col: str, nodes: DataFrame, shared: DataFrame, words: int, similarity: float, piece: int) -> DataFrame:
    """Links (fp, other) of nodes with the first of each of their groups: a pair for each
    member at most, which connects most crowds."""
    part = F.pmod(F.xxhash64("fp", "key"), F.ceil(F.col("n") / piece).cast("long"))
    dealt = shared.select("fp", F.xxhash64("key", part).alias("grp"))
    pairs = dealt.join(dealt.groupBy("grp").agg(F.min("fp").alias("other")), "grp").filter("fp <> other").select("fp", "other").distinct()
    outline = nodes.select("fp", "size", "counts")
    theirs = outline.toDF("other", "their_size", "their_counts")

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, counts = (np.concatenate([f(batch.column(i)), f(batch.column(i + 2))]) for i, f in ((2, pa.Array.to_numpy), (3, counts_of)))
            at = np.arange(batch.num_rows)
            yield batch.select(["fp", "other"]).filter(pa.array(fits(size, counts, at, at + batch.num_rows, similarity)))

    met = pairs.join(outline, "fp").join(theirs, "other").select("fp", "other", "size", "counts", "their_size", "their_counts")
    pairs = stored(met.mapInArrow(bounded, "fp long, other long"), "first-pairs")
    # A first member and some of those that met it are a group.
    sizes = pairs.groupBy("other").agg(F.count(F.lit(1)).alias("n"))
    part = F.pmod(F.xxhash64("fp", "other"), F.ceil(F.col("n") / FOLLOWERS).cast("long"))
    grouped = stored(pairs.join(sizes, "other").select("fp", "other", F.xxhash64("other", part).alias("grp")), "first-groups")
    members = grouped.select("fp", "grp").union(grouped.select("other", "grp").distinct())
    alone = F.array().cast("array<bigint>")
    made = compared(docs, text_col, nodes, members.select("fp", "grp", F.col("fp").alias("root"), alone.alias("before")), words, similarity, "first-links")
    discard(pairs, grouped)
    return made


def compared(docs: DataFrame, text_col: str, nodes: DataFrame, members: DataFrame, words: int, similarity: float, label: str) -> DataFrame:
    """Exact links inside the groups of members (fp, grp, root, before)."""
    sets = sets_of(docs, text_col, nodes, members, words)
    dealt = members.join(sets, "fp").select("fp", "grp", "root", "before", "items").repartition("grp").sortWithinPartitions("grp", "fp")
    made = stored(dealt.mapInArrow(by_group(verified_forest(similarity)), "fp long, other long"), label)
    discard(sets)
    return made


def with_partners(rows: DataFrame, similarity: float) -> DataFrame:
    """The rows (key, root, size, place, ...) that can have a partner of another root in
    their group whose first common shingle is the key.

    Such a partner is of about their size, and of two partners the smaller has the key early:
    it needs all but a ninth of its elements from there on (at 0.8). Sizes fall in classes so
    wide that similar sets are neighbours at most; only sums of classes meet.
    """
    step, ends = -math.log(similarity), ("a", "b")
    early = F.col("place") <= F.col("size") - similarity / (1 + similarity) * 2 * F.col("size") + TINY
    rows = rows.withColumn("class", F.floor(F.log(F.greatest("size", F.lit(1))) / step + TINY).cast("long")).withColumn("early", early)

    def roots(which: str, when: Column) -> list[Column]:
        return [fn(F.when(when, F.col(c))).alias(f"{which}_{e}") for e, fn, c in zip(ends, (F.min, F.max), (f"{which}_a", f"{which}_b"))]

    own = [fn(F.when(w, F.col("root"))).alias(f"{n}_{e}") for n, w in (("early", F.col("early")), ("any", F.lit(True))) for e, fn in zip(ends, (F.min, F.max))]
    held = rows.groupBy("key", "class").agg(*own).withColumn("d", F.explode(F.sequence(F.lit(-1), F.lit(1))))
    # Early ones count for larger sets, all for smaller ones.
    reached = held.withColumn("class", F.col("class") + F.col("d")).groupBy("key", "class").agg(*roots("early", F.col("d") >= 0), *roots("any", F.col("d") <= 0))
    reached = reached.filter("early_a <> early_b OR any_a <> any_b OR early_a <> any_a")

    def other(which: str) -> Column:
        return F.coalesce((F.col(f"{which}_a") != F.col("root")) | (F.col(f"{which}_b") != F.col("root")), F.lit(False))

    met = rows.join(reached, ["key", "class"])
    return met.filter(other("early") | (F.col("early") & other("any"))).select("fp", "place", "key", "n", "root")


def further_links(docs: DataFrame, text_col: str, nodes: DataFrame, rooted: DataFrame, words: int, similarity: float, piece: int) -> DataFrame:
    """Links (fp, other) between nodes of unlike roots, a forest of each group; ``rooted``
    has the groups' rows (fp, place, key, n, size, root)."""
    rows = with_partners(rooted, similarity)
    # Each row knows the earlier common shingles of its node.
    listed = rows.groupBy("fp", "root").agg(F.sort_array(F.collect_list(F.struct("place", "key", "n"))).alias("all"))
    told = listed.select("fp", "root", "all", F.posexplode("all").alias("i", "own"))
    told = told.select("fp", "root", "own.*", F.transform(F.slice("all", F.lit(1), F.col("i")), lambda x: x["key"]).alias("before"))
    placed = in_pieces(told, piece).join(nodes.select("fp", "size", "counts"), "fp").select("fp", "grp", "size", "root", "place", "before", "counts")
    dealt = placed.repartition("grp").sortWithinPartitions("grp", "size", "fp")
    marked = stored(dealt.mapInArrow(by_group(partners(similarity)), "fp long, grp long, root long, before array<long>"), "possible-partners")
    made = compared(docs, text_col, nodes, marked, words, similarity, "further-links")
    discard(marked)
    return made


def distinct_sets(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, digest, fp), and the distinct sets with their bounds and keys."""
    wide = outlined(docs, id_col, text_col, words, similarity)
    nodes = stored(wide.groupBy("fp").agg(F.min("digest").alias("digest"), *[F.first(c).alias(c) for c in ("print", "size", "counts", "keys")]), "distinct-sets")
    marked = stored(wide.select("doc_id", "digest", "fp"), "set-of-row")
    discard(wide)
    return marked, nodes


def shared_shingles(nodes: DataFrame) -> DataFrame:
    """(fp, size, place, key, n): the early shingles that n > 1 nodes have."""
    members = nodes.select("fp", "size", F.posexplode("keys").alias("place", "key"))
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return stored(members.join(sizes, "key"), "shared-shingles")


def print_groups(nodes: DataFrame) -> DataFrame:
    """(fp, key, n): the nodes that SimHash links, directly or through others, in groups of n."""
    distinct = stored(nodes.select(F.col("print").alias("fp")).distinct(), "distinct-prints")
    stars = components(links(distinct), "fp", "other").withColumnRenamed("node", "print")
    rooted = nodes.select("fp", "print").join(stars, "print", "left").select("fp", F.xxhash64(F.lit("print"), F.coalesce("root", "print")).alias("key"))
    sizes = rooted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    made = stored(rooted.join(sizes, "key").select("fp", "key", "n"), "print-groups")
    discard(distinct)
    return made


def print_links(close: DataFrame) -> DataFrame:
    """Links (fp, other) of the nodes of ``print_groups`` with the first of their group."""
    return close.join(close.groupBy("key").agg(F.min("fp").alias("other")), "key").filter("fp <> other").select("fp", "other")


def similar_rows(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float, piece: int, prints: bool = False) -> DataFrame:
    """(doc_id, digest, root) of every row: the digest of its text, and a number that the
    rows of a component share.

    A node is a distinct set of shingles. First each node meets the first of every group
    that it shares an early shingle or close fingerprints with; then the groups that still hold unlike roots are
    compared inside. Groups of more than ``piece`` nodes are cut, and each pair of pieces
    is a group.

    With ``prints``, what SimHash links is linked, whatever the similarity of the sets.
    """
    marked, nodes = distinct_sets(docs, id_col, text_col, words, similarity)
    shared = shared_shingles(nodes)
    close = print_groups(nodes)
    groups = shared.select("fp", "key", "n")
    near = first_links(docs, text_col, nodes, groups if prints else groups.unionByName(close), words, similarity, piece)
    known = near.union(print_links(close)) if prints else near
    stars = components(known, "fp", "other")
    rooted = stored(shared.join(stars.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted-shingles")
    discard(shared)
    far = further_links(docs, text_col, nodes, rooted, words, similarity, piece)
    stars = components(known.union(far), "fp", "other")
    discard(rooted, nodes, close, near, far)
    return marked.join(stars.withColumnRenamed("node", "fp"), "fp", "left").select("doc_id", "digest", F.coalesce("root", "fp").alias("root"))


def similar_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY, piece: int = PIECE
) -> DataFrame:
    """(doc_id, component_id): the smallest id that links of similar documents lead to.

    Two texts are linked if their sets of shingles have at least this similarity; texts
    without words are alike. A null text counts as empty; copies are one node; a row without
    an id joins its component, and a component without any id has a null one. Other columns
    do not matter; an empty table gives none.
    """
    rows = similar_rows(docs, id_col, text_col, words, similarity, piece)
    least = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "root").select("doc_id", "component_id")


def row_key(id_col: str, digest: Column) -> Column:
    """A row's id, which may be missing, and the digest of its text."""
    return F.concat(F.coalesce(F.concat(F.lit("id "), F.col(id_col).cast("string")), F.lit("none")), F.lit(" "), F.hex(digest))


def keep_one_of_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay: of each component of near-duplicates one, whole: that with
    the smallest id, and of rows with that id the text with the smallest digest. A row
    without an id stays only if its component has no id.

    Two texts are linked if their fingerprints are (``simhash.near_duplicates``), or if
    their sets of shingles are similar (``similar_documents``).
    """
    rows = similar_rows(docs, id_col, text_col, WORDS, SIMILARITY, PIECE, prints=True)
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest")).alias("least")
    kept = rows.groupBy("root").agg(least).select(row_key("least.doc_id", F.col("least.digest")).alias("_key"))
    keyed = docs.select(row_key(id_col, digest_of(text_col)).alias("_key"), F.struct("*").alias("_row"))
    return keyed.join(kept, "_key", "left_semi").dropDuplicates(["_key"]).select("_row.*")
