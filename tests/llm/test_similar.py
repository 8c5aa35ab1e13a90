import random
from collections import Counter

import numpy as np

from waterspark.llm import similar, simhash
from waterspark.llm.shared import stored


def test_similar_documents(spark):
    """Copies with a few words changed are linked, texts that share half are not."""
    random.seed(12)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(120):
        text = random.choices(vocabulary, k=random.choice([60, 200, 600]))
        near = list(text)
        near[len(near) // 3] = "changed"
        half = text[: len(text) // 2] + random.choices(vocabulary, k=len(text) // 2)
        rows += [(3 * i, " ".join(text)), (3 * i + 1, " ".join(near)), (3 * i + 2, " ".join(half))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for piece in (4096, 3):
        got = {r["doc_id"]: r["component_id"] for r in similar.similar_documents(docs, piece=piece).collect()}
        linked = [got[3 * i + 1] == 3 * i for i in range(120)]
        assert sum(linked) >= 115 and all(got[3 * i + 2] == 3 * i + 2 for i in range(120))


def test_one_of_each_component_stays(odd_docs, odd_rows):
    kept = similar.keep_one_of_near(odd_docs)
    assert kept.schema == odd_docs.schema
    shingles = [frozenset(brute_shingles(t)) for _, t, _ in odd_rows]
    group = list(range(len(odd_rows)))
    for i, a in enumerate(shingles):
        for j in range(i):
            if len(a & shingles[j]) >= 0.8 * len(a | shingles[j]):
                group = [group[j] if g == group[i] else g for g in group]
    least = {g: min((r[0] for r, h in zip(odd_rows, group) if h == g and r[0] is not None), default=-1) for g in set(group)}
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == sorted(least.values())


def test_unlike_rows_without_an_id_or_with_the_same_id_stay(spark):
    texts = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcde"]
    rows = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (7, texts[3] + " more"), (9, texts[3]), (8, texts[4]), (None, texts[4]), (8, texts[4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r["doc_id"], r["text"].split()[0]) for r in similar.keep_one_of_near(docs).collect())
    assert got == Counter([(None, "a0"), (None, "b0"), (7, "c0"), (7, "d0"), (8, "e0")])


def test_similarity_decides_exactly(spark):
    """Pairs around 0.8, and a crowd of copies at about the threshold, against all pairs."""
    random.seed(3)
    rows = []
    for size in (6, 9, 24, 84, 204, 604):
        for _ in range(12):
            text = [f"w{random.randrange(10**6)}" for _ in range(size)]
            other = list(text)
            at = random.randrange(1, size)
            cut = random.randint(0, max(1, size // 4))
            other[at : at + cut] = ["x"] * len(other[at : at + cut])
            rows += [text, other]
    centre = [f"c{i}" for i in range(104)]
    for i in range(60):
        copy = list(centre)
        for at in random.sample(range(104), 2):
            copy[at] = f"new{i}-{at}"
        rows.append(copy)
    rows = [(i, " ".join(t)) for i, t in enumerate(rows)]
    sets, group = [frozenset(brute_shingles(t)) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if group[i] != group[j] and len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    assert 20 < len(set(group)) < len(rows) - 20
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for piece in (4096, 3):
        got = {r["doc_id"]: r["component_id"] for r in similar.similar_documents(docs, piece=piece).collect()}
        assert [got[i] for i in range(len(rows))] == group


def brute_shingles(text, words=5):
    w = (text or "").encode().lower().split()
    return [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []


def brute_groups(texts):
    sets, group = [frozenset(brute_shingles(t)) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if group[i] != group[j] and len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return group


def test_common_passages_and_crowds_below_the_threshold(spark, monkeypatch):
    """Many texts share a passage, many lie just below or above the threshold."""
    monkeypatch.setattr(similar, "FREQUENT", 4)
    random.seed(8)
    passage, rows = [f"p{i}" for i in range(60)], []
    for i in range(60):
        own = [f"o{i}-{j}" for j in range(random.randrange(2, 90))]
        rows.append(own + passage if i % 2 else passage + own)
    centre = [f"c{i}" for i in range(124)]
    for i in range(70):
        copy = list(centre)
        for at in random.sample(range(0, 124, 6), random.choice([1, 2, 3])):
            copy[at] = f"n{i}-{at}"
        rows.append(copy)
    texts = [" ".join(t) for t in rows]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = brute_groups(texts)
    assert 50 < len(set(want)) < len(want) - 20
    for piece in (4096, 5):
        got = {r["doc_id"]: r["component_id"] for r in similar.similar_documents(docs, piece=piece).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_bounds_never_refuse_a_similar_pair():
    random.seed(9)
    for _ in range(300):
        a = np.array(sorted(random.sample(range(2000), random.randrange(1, 400))), dtype=np.uint64)
        b = np.unique(np.concatenate([a[random.randrange(len(a) // 5 + 1) :], np.array(random.sample(range(2000), random.randrange(0, 30)), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        size, counts = np.array([len(a), len(b)]), np.stack([np.frombuffer(similar.class_counts(x), np.uint8) for x in (a, b)])
        if both >= 0.8 * (len(a) + len(b) - both) - 1e-9:
            assert similar.fits(size, counts, np.array([0]), np.array([1]), 0.8).all()
    big, more = (np.arange(n, dtype=np.uint64) * np.uint64(similar.CLASSES) for n in (5_000, 5_500))
    counts = np.stack([np.frombuffer(similar.class_counts(x), np.uint8) for x in (big, more)])
    assert similar.fits(np.array([5_000, 5_500]), counts, np.array([0]), np.array([1]), 0.8).all()


def test_order_keeps_frequent_last():
    often, times = np.array([3, 7], dtype=np.uint64), np.array([9, 5])
    assert similar.in_common_order(np.array([1, 3, 5, 7, 8], dtype=np.uint64), often, times).tolist() == [1, 5, 8, 7, 3]


def test_close_fingerprints_meet_first(spark, monkeypatch):
    """What SimHash links is compared by its sets before any shingle is looked at."""
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join([*words[:-1], "other"]), " ".join(f"v{i}" for i in range(400))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    close = simhash.near_duplicates(docs).select("doc_id", "component_id").orderBy("doc_id").collect()
    assert [r.component_id for r in close] == [0, 0, 2]
    shared = similar.shared_shingles
    monkeypatch.setattr(similar, "shared_shingles", lambda nodes: stored(shared(nodes).filter("false"), "none"))
    got = similar.similar_documents(docs).orderBy("doc_id").collect()
    assert [r.component_id for r in got] == [0, 0, 2]


def test_what_simhash_links_stays_once(spark):
    """Texts within 4 bits are near-duplicates in the pipeline, also where their sets are not
    similar."""
    passage = " ".join(f"p{i}" for i in range(31))
    texts = [" ".join([passage] * 6 + [f"{c}{i}" for i in range(n)]) for c, n in (("a", 30), ("b", 30), ("c", 26))]
    texts += [" ".join(f"d{i}" for i in range(60))]
    sets = [frozenset(brute_shingles(t)) for t in texts]
    assert all(len(a & b) < 0.8 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    docs = spark.createDataFrame([(i + 5, t) for i, t in enumerate(texts)] + [(None, texts[0] + " more")], "doc_id long, text string").repartition(3)
    want = {r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert want == {5, 8}
    assert sorted(r["doc_id"] for r in similar.keep_one_of_near(docs).collect()) == [5, 8]
    # By their sets alone they are four.
    assert {r["component_id"] for r in similar.similar_documents(docs).collect()} == {5, 6, 7, 8}
