import random
from collections import Counter, defaultdict

import numpy as np

from waterspark.llm.mixing import MOST_COPIES, WEIGHTS, fit_budget, mix, take_mix


def reachable(sizes, counts):
    sums = {0}
    for s, c in zip(sizes, counts):
        sums = {a + s * k for a in sums for k in range(c + 1)}
    return sums


def test_small_budgets_are_met_where_sums_meet_them():
    random.seed(2)
    for _ in range(300):
        sizes = np.array(sorted(random.sample(range(0, 40), random.randint(1, 6))))
        counts = np.array([random.randint(1, 3) for _ in sizes])
        total = int((sizes * counts).sum())
        budget = random.randint(0, total)
        take = fit_budget(sizes, counts, budget, 1)
        assert ((take >= 0) & (take <= counts)).all()
        share = np.array([c * budget // total if s else 0 for s, c in zip(sizes, counts)]) if 0 < budget < total else np.where(budget >= total, counts, 0)
        # Beyond the proportional start the best sum of the rest is found.
        rest = budget - int((share * sizes).sum())
        best = min(abs(rest - r) for r in reachable(sizes.tolist(), (counts - share).tolist()))
        assert abs(int((take * sizes).sum()) - budget) == best


def test_large_budgets():
    random.seed(3)
    sizes = np.arange(1, 5000)
    counts = np.array([random.randint(1, 200) for _ in sizes])
    for part in (0.1, 0.5, 0.9):
        budget = int((sizes * counts).sum() * part) + 1
        take = fit_budget(sizes, counts, budget, 1)
        assert int((take * sizes).sum()) == budget and (take <= counts).all()


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        free = [s for s in order if s not in full]
        rest = total - sum(3 * sizes[s] for s in full)
        target = {s: 3 * sizes[s] if s in full else rest * weight[s] / sum(weight[f] for f in free) for s in order}
        over = {s for s in free if target[s] > 3 * sizes[s]}
        if not over:
            return target
        full |= over


def check(docs, rows):
    got = mix(docs).collect()
    assert len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").encode().split())
    targets = brute_targets(sizes)
    longest = max(len((t or "").encode().split()) for _, t, _ in rows)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - targets[r["source"]]) < 1e-6 * max(1, r["target"])
        assert 0 <= r["taken"] == r["copies"] * r["size"] <= MOST_COPIES * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - targets[s]) <= longest for s in sizes)
    return got, taken, targets


def test_odd_rows(odd_docs, odd_rows, no_docs):
    got, _, _ = check(odd_docs, odd_rows)
    assert Counter(r["size"] for r in got) == Counter(len((t or "").encode().split()) for _, t, _ in odd_rows)
    assert mix(no_docs).collect() == []
    kept = take_mix(odd_docs)
    assert kept.schema == odd_docs.schema
    assert Counter(r["doc_id"] for r in kept.collect()) == +Counter({i: sum(r["copies"] for r in got if r["doc_id"] == i) for i in {r["doc_id"] for r in got}})


def test_hot_sizes_meet_targets(spark):
    rows = [(i, "w " * (7 if i % 3 else 1 + i % 50), f"s{i % 4}" if i % 2 else "hot") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    _, taken, targets = check(docs, rows)
    assert all(abs(taken[s] - targets[s]) <= 1 for s in taken)
    again = {(r["doc_id"], r["taken"]) for r in mix(docs.repartition(7)).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in mix(docs).collect()}


def test_no_words_at_all(spark):
    docs = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [(r["taken"], r["target"]) for r in mix(docs).collect()] == [(0, 0.0), (0, 0.0)]
