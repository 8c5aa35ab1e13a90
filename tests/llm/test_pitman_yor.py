import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from waterspark.llm import pitman_yor as py
from waterspark.llm.shared import crc_fold


def base_of(rows, held):
    tokens = [(t or "").encode().lower().split() + [b""] for _, t, *_ in rows]
    counts = Counter(w for ws, h in zip(tokens, held) if not h for w in ws)
    n, v = sum(counts.values()), len(counts)
    return [(len(ws), sum(w in counts for w in ws), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)) for ws in tokens]


def compare(docs, rows, monkeypatch, **sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(py, name, value)
    made = py.language_scores(docs, crc_fold("doc_id", 7) == 2).collect()
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in rows]
    got = sorted((r["doc_id"] or -1, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in made)
    want = sorted((row[0] or -1, h, a, b, n, round(s, 6)) for row, h, (a, b, n, s) in zip(rows, held, base_of(rows, held)))
    assert got == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in made)
    return made


def test_odd_rows(odd_docs, odd_rows, no_docs, monkeypatch):
    compare(odd_docs, odd_rows, monkeypatch)
    assert py.language_scores(no_docs, F.lit(False)).collect() == []


def test_chunks_and_better_than_unigrams(spark, monkeypatch):
    rng = np.random.default_rng(5)
    names = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(400):
        out = []
        for _ in range(40):  # after "the" comes another kind of word than after "to"
            kind = rng.integers(2)
            out += [("the", "to")[kind], names[int(rng.zipf(1.6)) % 150 + 150 * kind]]
        rows.append((i, " ".join(out)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    made = compare(docs, rows, monkeypatch, CHUNK_TOKENS=3000, SHARD_CELLS=100)
    held = [r for r in made if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def seating(counts):
    """Every context with every word, so that predictions can be summed."""
    words, contexts = counts.shape
    used = np.array([0, 1, 2, 600, py.CONTEXTS - 1])[:contexts]
    return py.Seating(np.full(words, contexts), np.tile(used, words), counts.ravel()), contexts


def test_predictions_sum_to_one():
    counts = np.random.default_rng(1).integers(0, 9, size=(30, 5))
    counts[3] = 0
    seats, contexts = seating(counts)
    customers = np.bincount(seats.context, seats.count, py.CONTEXTS)
    known = int((counts.sum(axis=1) > 0).sum())
    model = py.Model((0.7, 0.6, 0.5), [], known, 3)
    for n in range(4):
        totals = py.Totals.of(seats.totals(), customers)
        p = seats.predict(model, totals)[0].reshape(30, contexts)
        # The unseen word of the fixture has the mass of all unknown words.
        assert np.allclose(p.sum(axis=0), 1)
        assert ((seats.tables <= seats.count) & ((seats.tables > 0) == (seats.count > 0))).all()
        seats.sweep(model, totals, np.random.default_rng(n))


def test_seats_follow_the_process():
    rng = np.random.default_rng(2)
    weight, discount, n = 2.0, 0.5, 12
    got = py.seat(np.full(20_000, n), np.full(20_000, weight), discount, rng).mean()
    chance = np.zeros(n + 2)
    chance[1] = 1.0
    for seated in range(1, n):
        nxt = np.zeros_like(chance)
        for t in range(1, seated + 1):
            new = weight / (weight + seated - discount * t)
            nxt[t + 1] += chance[t] * new
            nxt[t] += chance[t] * (1 - new)
        chance = nxt
    assert abs(got - (chance * np.arange(n + 2)).sum()) < 0.05


def test_packing():
    for values in (np.arange(1000, dtype=np.uint64), np.array([], dtype=np.uint32), np.array([1.5, -2], dtype=np.float32)):
        assert (py.unpack(py.pack(values)) == values).all()


def test_parents():
    seen = py.parent_of(np.arange(py.CONTEXTS))
    assert seen.min() == 0 and seen.max() == py.PARENTS - 1 and (np.diff(seen) >= 0).all()
    assert py.context_of(b"of", 5) < py.context_of(b"water", 5) < py.CONTEXTS


def test_words_of_one_class_are_contexts_apart(spark, monkeypatch):
    monkeypatch.setattr(py, "LEAST_BLOCKS", 3)
    assert py.context_of(b"sailing", 1) == py.context_of(b"failing", 2)
    rows = [(i, ("sailing north " if i % 2 else "failing south ") * 20) for i in range(200)]
    asked = [(1000, "sailing north"), (1001, "sailing south"), (1002, "failing south"), (1003, "failing north")]
    docs = spark.createDataFrame(rows + asked, "doc_id long, text string").repartition(3)
    made = py.language_scores(docs, F.col("doc_id") >= 1000).where("held_out").collect()
    score = {r["doc_id"]: r["score"] for r in made}
    assert score[1000] > score[1001] + 1 and score[1002] > score[1003] + 1


def leaf_row(counts, classes):
    """A shard of every context with every word."""
    words, contexts = counts.shape
    parts = {"spread": np.full(words, contexts, np.uint32), "classes": classes, "contexts": np.tile(np.arange(contexts, dtype=np.uint32), words), "counts": counts.astype(np.uint32).ravel()}
    return {"shard": 0, **{k: py.pack(v) for k, v in parts.items()}}


def test_word_contexts_sum_to_one():
    counts = np.random.default_rng(3).integers(0, 9, size=(30, 6))
    counts[3] = 0
    leaves = py.Leaves(leaf_row(counts, np.array([0, 1, 1, 600, 600, py.CONTEXTS - 1], np.uint16)))
    model = py.Model((0.7, 0.6, 0.5), [], int((counts.sum(axis=1) > 0).sum()), 3, 0.8)
    width = py.CONTEXTS + py.PARENTS + 1
    for n in range(4):
        sums = leaves.sums()
        totals, (customers, tables) = py.Totals.of(sums[:width], sums[width:-8]), leaves.own()
        p = leaves.predict(model, totals, customers, tables).reshape(counts.shape)
        assert np.allclose(p.sum(axis=0), 1)
        assert ((leaves.tables <= leaves.count) & ((leaves.tables > 0) == (leaves.count > 0))).all()
        again = py.Leaves(leaf_row(counts, np.array([0, 1, 1, 600, 600, py.CONTEXTS - 1], np.uint16)))
        again.resume(leaves.state())
        assert np.array_equal(again.predict(model, totals, customers, tables).reshape(counts.shape), p)
        leaves.sweep(model, totals, tables.astype(np.int64), np.random.default_rng(n))


def test_blocks_add_up_contexts_of_shards():
    def row(shard, keys, customers, tables):
        packed = py.pack(np.array(customers, np.uint32)), py.pack(np.array(tables, np.uint32))
        return (0, 5, shard, py.pack_steps(np.array(keys, np.uint64)), *packed, None, None, None)

    table = py.told([row(0, [3, 9, 2**63], [1, 2, 3], [1, 1, 1]), row(1, [9, 2**64 - 1], [5, 7], [2, 0])])
    for _ in range(2):  # by keys, then by the numbers that they get
        made = py.add_up(table).to_pylist()
        assert [py.unpack(r["tables"]).tolist() for r in made] == [[1, 3, 1], [3, 0]]
        assert [py.unpack_steps(r["ids"]).tolist() for r in made] == [[0, 1, 2], [1, 3]]
        table = py.told([(0, 5, r["shard"], r["ids"], t[4], t[5], None, None, None) for r, t in zip(made, [row(0, [], [1, 2, 3], [1, 1, 1]), row(1, [], [5, 7], [2, 0])])])
