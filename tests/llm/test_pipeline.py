"""The pipeline's stages on the smallest tables, each against brute force on its input."""

from collections import Counter, defaultdict

import pytest
import sentencepiece

import corpus_pipeline
from waterspark.llm.queries import quality_model, tokenizer_path
from waterspark.llm.shared import stored, table
from waterspark.llm.quality import THRESHOLD, score_quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        made = stored(stage(spark, docs, SF), f"test-{name}")
        out.append((name, docs, made))
        docs = made
    return {name: (before, after) for name, before, after in out}


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text", "source").collect()]


def test_order_and_columns(spark, steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "source_mix", "pieces"]
    want = table(spark, SF, "documents").columns
    assert all(steps[n][1].columns == want for n in list(steps)[:-1])


def test_quality_stage_drops_what_scores_low(spark, steps):
    before, after = steps["quality"]
    scores = score_quality(before, quality_model(spark, SF)).collect()
    assert Counter(r[0] for r in rows(after)) == Counter(r["doc_id"] for r in scores if r["score"] >= THRESHOLD)
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    kept = {r[0] for r in rows(after)}
    good = [i for i, y in labels.items() if y == 1]
    assert sum(i in kept for i in good) >= 0.99 * len(good)


def test_exact_stage_keeps_one_of_each_text(steps):
    before, after = map(rows, steps["exact_dedup"])
    groups = defaultdict(list)
    for i, t, _ in before:
        groups["".join((t or "").encode().decode().split())].append((-len(t or ""), i))
    assert sorted(r[0] for r in after) == sorted(min(g)[1] for g in groups.values())


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_near_stage_keeps_one_of_each_component(steps):
    before, after = map(rows, steps["near_dedup"])
    sets, kept = {i: shingles(t) for i, t, _ in before}, {i for i, _, _ in after}

    def similarity(i, j):
        both = len(sets[i] | sets[j])
        return len(sets[i] & sets[j]) / both if both else 1.0

    ids = sorted(sets)
    assert all(similarity(i, j) < 0.8 for n, i in enumerate(ids) if i in kept for j in ids[:n] if j in kept)
    assert all(any(similarity(i, j) >= 0.8 for j in ids if j != i) for i in ids if i not in kept)


def test_mix_stage_meets_its_targets(steps):
    before, after = map(rows, steps["source_mix"])
    copies, known = Counter(after), set(before)
    assert set(copies) <= known and max(copies.values()) <= 3
    size = lambda t: len((t or "").encode().split())
    assert abs(sum(size(r[1]) * n for r, n in copies.items()) - sum(size(t) for _, t, _ in before)) <= 20 * max(size(t) for _, t, _ in before)


def test_last_stage_encodes_as_the_library(steps):
    before, after = steps["pieces"]
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    want = Counter((i, tuple(library.encode(t or "") + [library.eos_id()])) for i, t, _ in rows(before))
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in after.collect()) == want


def test_run_is_the_stages(spark, steps):
    got = Counter((r["doc_id"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == Counter((r["doc_id"], r["decoded_sha256"]) for r in steps["pieces"][1].collect())


def test_odd_rows_pass_through(spark, odd_docs, no_docs):
    docs = odd_docs
    for name, stage in corpus_pipeline.STAGES[1:]:
        docs = stored(stage(spark, docs, SF), f"odd-{name}")
        assert name == "pieces" or docs.dtypes == odd_docs.dtypes
    assert docs.count() > 0
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, SF).count() == 0
