import hashlib
import re
from collections import Counter, defaultdict

from waterspark.llm import exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for n, (i, t, *_) in enumerate(rows):
        t = t or ""
        groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t).encode()).hexdigest()].append((-len(t), i is None, i or 0, n, i))
    out = []
    for digest, members in groups.items():
        best = min(members)
        out += [(m[4], best[4], len(members), digest) for m in members]
    return Counter(out), len(groups)


def check(made, rows):
    got = made.collect()
    want, groups = brute(rows)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == groups == len({r["text_sha256"] for r in kept})
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_odd_rows(odd_docs, odd_rows, no_docs):
    check(exact_dedup.exact_duplicates(odd_docs), odd_rows)
    assert exact_dedup.exact_duplicates(no_docs).collect() == []


def test_heavy_groups_and_light_ones_agree(spark, monkeypatch):
    rows = [(i, "hot text" if i % 3 else f"text {i % 40}{' ' * (i % 2)}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    check(exact_dedup.exact_duplicates(docs), rows)
    monkeypatch.setattr(exact_dedup, "HEAVY", 1)
    monkeypatch.setattr(exact_dedup, "TRACKED", 8)
    check(exact_dedup.exact_duplicates(docs), rows)


def test_main_path_is_native(odd_docs):
    made = exact_dedup.exact_duplicates(odd_docs)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_kept_rows_are_whole(odd_docs, odd_rows):
    kept = exact_dedup.keep_distinct(odd_docs)
    assert kept.columns == odd_docs.columns and kept.schema == odd_docs.schema
    got = kept.collect()
    assert len(got) == brute(odd_rows)[1] and all(r["_row"] == 1 and r["_key"] == "k" for r in got)
