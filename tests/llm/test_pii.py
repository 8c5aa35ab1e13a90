import random
import re

import numpy as np

from waterspark.llm import pii


def brute(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in re.sub("[^0-9]", "", m.group())]
        if 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out)


def test_base_spans_as_the_plain_patterns():
    random.seed(1)
    for _ in range(20_000):
        text = "".join(random.choices("ab1@.+-( )0259é\n", k=random.randint(0, 80)))
        assert pii.base_spans(text) == brute(text)
    for text in ("a@b@c.de", "1.2.3.4.5.6.7.8", "x@y.z.", "4111-1111 1111-1111", "+1(2)3.4-5 678901"):
        assert pii.base_spans(text) == brute(text)


def test_trees_learn_and_their_threshold_holds():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.2) & (x[:, 2] < 0.5) | (x[:, 1] > 1.5)).astype(float)
    trees = pii.Trees()
    trees.fit(x, y)
    fresh = rng.normal(size=(2000, 4))
    truth = (fresh[:, 0] > 0.2) & (fresh[:, 2] < 0.5) | (fresh[:, 1] > 1.5)
    p = trees.probability(fresh)
    assert ((p >= 0.5) == truth).mean() > 0.95
    assert truth[p >= trees.threshold].mean() > 0.93


def samples(n):
    random.seed(11)
    out = []
    for i in range(n):
        key = "".join(random.choices("0123456789abcdef", k=32))
        out.append((i, random.choice([f'set token = "{key}" here', f"mail me at u{i}@example.com now", "Licensed under version 2.0 of 1999", f"order {random.randint(10**7, 10**8)} shipped", "plain words only"])))
    return out


def test_base_stays_and_secrets_are_added(spark, odd_docs, odd_rows, no_docs):
    rows = samples(600)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    trees = pii.train(docs)
    texts = dict(rows)
    for r in pii.find_pii(docs, trees).collect():
        text, base, spans = texts[r["doc_id"]], [tuple(s) for s in r["base"]], [tuple(s) for s in r["spans"]]
        assert base == [(pii.KINDS[k], a, b) for a, k, b in brute(text)] and set(base) <= set(spans)
        assert ("token" in text) == any(k == "secret" for k, _, _ in spans)
        assert spans or "token" not in text and "@" not in text
        if "version" in text or "plain" in text:
            assert spans == []
    odd = pii.find_pii(odd_docs, trees).collect()
    assert len(odd) == len(odd_rows)
    rich = next(r for r in odd if r["doc_id"] == 10)
    assert [s["kind"] for s in rich["base"]] == ["email", "phone", "ip", "card"]
    assert pii.find_pii(no_docs, pii.train(no_docs)).collect() == []


def test_named_numbers_and_long_values_are_found(spark):
    random.seed(2)
    long = "9f3c71ab" * 80
    texts = {1: "please call 555-123-4567 today", 2: "phone (555) 123-4567", 3: "her ssn 123-45-6789 is here", 4: "licensed under version 2001 2002 2003", 5: f'token = "{long}"'}
    rows = samples(400) + [(1000 + i, re.sub("[0-9]", lambda _: random.choice("23456789"), random.choice([texts[1], texts[2], texts[3], texts[4]]))) for i in range(400)]
    trees = pii.train(spark.createDataFrame(rows, "doc_id long, text string"))
    found = {i: {(pii.KINDS[k], t[a:b]) for a, k, b in pii.all_spans(t, trees)[1]} for i, t in texts.items()}
    assert ("contact", "555-123-4567") in found[1] and any(k == "contact" for k, _ in found[2])
    assert any(w == "123-45-6789" for _, w in found[3]) and not found[4]
    assert ("secret", long) in found[5]
    digits = "1234567890" * 4
    assert any(digits == t[a:b] and pii.KINDS[k] == "number" for t in (f"account {digits}.",) for a, k, b in pii.candidates(t, []))


def test_redaction():
    text = "a b@c.de and 1.2.3.4"
    assert pii.redact(text, pii.base_spans(text)) == "a [email] and [ip]"
    assert pii.redact("", []) == ""
