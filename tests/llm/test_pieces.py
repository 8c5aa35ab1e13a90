import random

import pytest
import sentencepiece

from waterspark.llm.pieces import PieceModel, encode
from waterspark.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())


@pytest.fixture(scope="module")
def model():
    return PieceModel(tokenizer_path())


def test_random_texts_as_the_library(model, library):
    random.seed(7)
    signs = " ▁\n\tabctheiongé中文😀​<>0x1.ñ\x00"
    texts = ["", " ", "  two  spaces "] + ["".join(random.choices(signs, k=random.randint(1, 60))) for _ in range(3000)]
    texts += [" " * 3000 + "x", "a" * 5000, "ab" * 2000 + " " * 40, "".join(random.choices("abcDEF0123+/", k=8000)), "中" * 500]
    got = model.encode(texts)
    assert got == library.encode(texts)
    assert [model.decode(x) for x in got] == [library.decode(x) for x in got]


def test_any_ids_decode_as_in_the_library(model, library):
    random.seed(8)
    for _ in range(2000):
        ids = random.choices([0, 1, 2, 3, 50, 200, 258, 259, 260, 1000, 28705, 5000], k=random.randint(0, 8))
        assert model.decode(ids) == library.decode(ids)


def test_rounds_and_single_joins_agree(model):
    random.seed(9)
    words = ["".join(random.choices("▁abeinrst", k=random.randint(1, 30))) for _ in range(500)]
    assert model.merge_words(words) == [model.merge_word(w) for w in words]


def test_odd_rows(odd_docs, odd_rows, library, no_docs):
    got = sorted((r["doc_id"] or -1, r["ids"], r["decoded"]) for r in encode(odd_docs, tokenizer_path()).collect())
    want = sorted((i or -1, library.encode(t or "") + [library.eos_id()], t or "") for i, t, _ in odd_rows)
    assert got == want
    assert encode(no_docs, tokenizer_path()).collect() == []
