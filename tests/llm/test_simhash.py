import random
from collections import Counter

import numpy as np
import xxhash

from waterspark.llm import simhash


def brute_fingerprint(text, words=4):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + words]), 42) for i in range(max(1, len(w) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, distance=4):
    """(fingerprint, smallest linked id) of each row."""
    prints = [brute_fingerprint(t) for _, t, *_ in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {g: min((r[0] for r, h in zip(rows, group) if h == g and r[0] is not None), default=None) for g in set(group)}
    return [(r[0], format(p, "016x"), least[g]) for r, p, g in zip(rows, prints, group)]


def test_odd_rows(odd_docs, odd_rows, no_docs):
    got = Counter((r["doc_id"], format(r["fp"] & (2**64 - 1), "016x"), r["component_id"]) for r in simhash.near_duplicates(odd_docs).collect())
    assert got == Counter(brute_components(odd_rows))
    assert simhash.near_duplicates(no_docs).collect() == []


def chained(n):
    """Fingerprints in chains of small steps, in crowds around a centre, and at random."""
    random.seed(5)
    out, at = [], random.getrandbits(64)
    for i in range(n):
        at = random.getrandbits(64) if i % 37 == 0 else at ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64))
        out.append(at)
    centre = random.getrandbits(64)
    return sorted({*out, *(centre ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64)) for _ in range(n)), *(random.getrandbits(64) for _ in range(n))})


def test_links_connect_what_all_pairs_connect(spark):
    prints = chained(300)
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    distinct = spark.createDataFrame([(p,) for p in signed], "fp long")
    parent = {p: p for p in signed}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for i, p in enumerate(prints):
        for j in range(i):
            if (p ^ prints[j]).bit_count() <= 4:
                parent[root(signed[i])] = root(signed[j])
    want = Counter(Counter(root(p) for p in signed).values())
    for piece in (4096, 7):
        stars = simhash.components(simhash.links(distinct, piece=piece), "fp", "other")
        roots = {r["node"]: r["root"] for r in stars.collect()}
        groups = {p: roots.get(p, p) for p in signed}
        assert Counter(Counter(groups.values()).values()) == want
        assert all(root(p) == root(g) and g <= p for p, g in groups.items())


def test_local_roots():
    fp = np.array([0, 1, 3, 7 << 40, (7 << 40) + 1, 0, 255], dtype=np.uint64)
    group = np.array([1, 1, 1, 1, 1, 2, 2])
    assert simhash.joined_roots(fp, group, 1).tolist() == [0, 0, 0, 3, 3, 5, 6]
