import random
from itertools import product

import numpy as np
import pytest

from waterspark.llm import quality


def test_forward_backward_sums_over_all_labellings():
    random.seed(1)
    unary, pair = np.array([[0.3, -1.2, 0.7, 0.1], [1.0, 2.0, 0, 0]]), np.array([[0.5, -0.3], [0.2, 0.9]])
    there = np.array([[True] * 4, [True, True, False, False]])
    good, pairs, total = quality.forward_backward(unary, there, pair)
    want_pairs = np.zeros((2, 2))
    for d, n in enumerate((4, 2)):
        weights = {y: np.exp(sum(u for u, l in zip(unary[d], y) if l) + sum(pair[a, b] for a, b in zip(y, y[1:]))) for y in product((0, 1), repeat=n)}
        z = sum(weights.values())
        assert np.isclose(total[d], np.log(z))
        assert np.allclose(good[d, :n], [sum(w for y, w in weights.items() if y[t]) / z for t in range(n)])
        for y, w in weights.items():
            for a, b in zip(y, y[1:]):
                want_pairs[a, b] += w / z
    assert np.allclose(pairs, want_pairs) and (good[1, 2:] == 0).all()


def test_neighbours_stay_within_the_document():
    own, _, counts = quality.line_features([b"a b c\nd e f", b"", b"x"])
    wide = quality.with_neighbours(own, counts)
    width = quality.WIDTH
    assert counts.tolist() == [2, 1, 1]
    before, after = wide[:, 2 * width : 3 * width], wide[:, 3 * width : 4 * width]
    assert (before[[0, 2, 3]] == 0).all() and (after[[1, 2, 3]] == 0).all()
    assert (before[1] == own[0]).all() and (after[0] == own[1]).all()


@pytest.fixture(scope="module")
def labelled(spark):
    random.seed(4)
    words = ["river", "lake", "shore", "water", "deep", "calm", "wide"]
    rows = []
    for i in range(400):
        bad = i % 4 == 0
        lines = [" ".join(random.choices(words, k=random.randint(3, 9))) + "." for _ in range(random.randint(1, 6))]
        rows.append((i, "\n".join(x.upper().replace(" ", "!! ") if bad else x for x in lines), 1 - bad))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int"), {i: y for i, _, y in rows}


def test_held_out_accuracy(labelled):
    docs, labels, truth = labelled
    model = quality.train(docs, labels.filter("doc_id % 5 != 0"))
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, model).collect()}
    right = [(got[i] >= quality.THRESHOLD) == (y == 1) for i, y in truth.items() if i % 5 == 0]
    assert np.mean(right) >= 0.95
    kept = {r["doc_id"] for r in quality.keep_good(docs, model).collect()}
    assert kept == {i for i, s in got.items() if s >= quality.THRESHOLD}


def test_odd_rows(labelled, odd_docs, odd_rows, no_docs):
    docs, labels, _ = labelled
    odd_labels = labels.unionByName(labels.limit(5)).selectExpr("doc_id", "quality").union(labels.selectExpr("cast(null as long)", "7").limit(2))
    model = quality.train(docs, odd_labels)
    got = quality.score_quality(odd_docs, model).collect()
    assert len(got) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in got)
    assert quality.score_quality(no_docs, model).collect() == []
    assert quality.keep_good(odd_docs, model, threshold=0.0).count() == len(odd_rows)
    plain = quality.train(docs, labels.filter("quality = 1"))
    assert len({round(r["score"], 9) for r in quality.score_quality(odd_docs, plain).collect()}) == 1
    none = quality.train(docs, labels.filter("doc_id < 0"))
    assert {r["score"] for r in quality.score_quality(odd_docs, none).collect()} == {0.5}


def test_one_id_on_most_rows_is_one_row_of_the_sample(labelled, spark, monkeypatch):
    docs, labels, truth = labelled
    crowd = spark.range(0, 3000, 1, 7).selectExpr("0L AS doc_id", "concat('!! text ', id % 50) AS text")
    taken = []
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda own, lengths, counts, y: taken.append(len(counts)) or fit(own, lengths, counts, y))
    model = quality.train(docs.unionByName(crowd), labels)
    assert taken == [len(truth)]
    # The large ids are still learned from: their kinds are told apart.
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, model).collect()}
    assert np.mean([(got[i] >= quality.THRESHOLD) == (y == 1) for i, y in truth.items() if i]) >= 0.95
    assert quality.train(docs.unionByName(crowd).repartition(3), labels).score([b"calm lake"]).tolist() == model.score([b"calm lake"]).tolist()
