import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from waterspark.llm import alignment
from waterspark.llm.queries import tokenizer_path
from waterspark.llm.shared import table

FIRST, SECOND = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


def brute(rows):
    """Whole texts, token by token."""
    a_lib, b_lib = Tokenizer.from_file(FIRST), sentencepiece.SentencePieceProcessor(model_file=SECOND)
    a_lib.encode_special_tokens = True
    alphabet = alignment.byte_alphabet()
    made, counts = [], Counter()
    for i, text in rows:
        whole = (" " + (text or "")).encode()
        a, b = (a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text)) if text else ([], [])
        a_part = [bytes(alphabet[c] for c in a_lib.id_to_token(t)) for t in a]
        b_part = [bytes([int(b_lib.id_to_piece(t)[3:5], 16)]) if b_lib.is_byte(t) else b_lib.id_to_piece(t).replace("▁", " ").encode() for t in b]
        if b"".join(a_part) != whole or b"".join(b_part) != whole:
            made.append((i, [], [], [], []))
            continue
        spans = [[(sum(map(len, p[:n])), sum(map(len, p[: n + 1]))) for n in range(len(p))] for p in (a_part, b_part)]
        links = [(x, y) for x, (s, e) in zip(a, spans[0]) for y, (u, v) in zip(b, spans[1]) if s < v and u < e]
        both, groups = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]}), []
        for lo, hi in zip([0, *both], both):
            groups.append("|".join(",".join(str(t) for t, (s, e) in zip(ids, sp) if lo <= s and e <= hi) for ids, sp in zip((a, b), spans)))
        counts.update(set(links))
        made.append((i, a, b, groups, links))
    most = defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    return Counter(
        (i, len(a), len(b), len(g), len(links), sum(counts[x] == most[x[0]] for x in links), sum(counts[x] for x in links), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "")
        for i, a, b, g, links in made
    )


TEXTS = [
    "Hello world, it's fine. Isn't it?  two  spaces\n\nlines \n and\ttabs ", " leading", "trailing ", " ", "\n", "a", "<s> </s> <|endoftext|> <unk> <0x41>", "under▁score ▁ x", "éa 中文 \U0001f600\U0001f601  nbsp　wide \x1c x\x85y",
    "x" * 300, "naïve café İstanbul " * 40, "1234567 89 0.5%", "​ zero", "no" + " " * 40 + "more",
]


@pytest.mark.parametrize("fan", [64, 2])
def test_as_token_by_token(spark, monkeypatch, fan):
    random.seed(1)
    words = [w for t in TEXTS for w in t.split(" ")]
    rows = list(enumerate(TEXTS + [" ".join(random.choices(words, k=random.randrange(1, 30))) for _ in range(60)]))
    rows += [(None, "no id"), (900, None), (901, ""), (5, TEXTS[5]), (5, TEXTS[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS slice", "'x' AS runs", "2 AS n_a").repartition(4)
    monkeypatch.setattr(alignment, "SLICE_CHARS", 300 if fan == 2 else 2_000_000)
    got = Counter(tuple(r) for r in alignment.align(docs, FIRST, SECOND, fan=fan).collect())
    assert got == brute(rows)


def test_given_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    short = docs.filter("length(text) < 3000")
    got = Counter(tuple(r) for r in alignment.align(short, FIRST, SECOND).collect())
    assert got == brute([(r["doc_id"], r["text"]) for r in short.collect()])


def test_odd_rows(odd_docs, odd_rows, no_docs):
    short = [r for r in odd_rows if not r[1] or len(r[1]) < 5000]
    got = Counter(tuple(r) for r in alignment.align(odd_docs.filter("text IS NULL OR length(text) < 5000"), FIRST, SECOND).collect())
    assert got == brute([r[:2] for r in short])
    long = [tuple(r) for r in alignment.align(odd_docs, FIRST, SECOND).collect() if r["n_a"] > 5000]
    assert sorted(r[0] for r in long) == [8, 9] and all(r[3] > 0 and r[4] >= max(r[1], r[2]) for r in long)
    assert alignment.align(no_docs, FIRST, SECOND).collect() == []


def test_merge_counts_and_answers(monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK", 5)
    random.seed(4)
    runs, total = [], Counter()
    for _ in range(7):
        own = Counter({random.randrange(6) << 16 | random.randrange(20): random.randrange(1, 9) for _ in range(random.randrange(1, 60))})
        total.update(own)
        keys = np.array(sorted(own))
        runs.append(alignment.run_of(keys, np.array([own[k] for k in keys.tolist()])))
    whole = alignment.merged_run(runs)
    got = {int(k): int(v) for keys, values in alignment.blocks_of(whole) for k, v in zip(keys, values)}
    assert got == dict(total) and list(got) == sorted(got)
    judged = alignment.judged(whole)
    most = {k >> 16: max(n for j, n in total.items() if j >> 16 == k >> 16) for k in total}
    for run in (whole, *runs):
        for keys, values in alignment.blocks_of(alignment.answered(run, judged)):
            assert [(total[k], total[k] == most[k >> 16]) for k in keys.tolist()] == [(v >> 1, bool(v & 1)) for v in values.tolist()]
