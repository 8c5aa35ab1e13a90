import pytest

CLASHES = {"_row": 1, "_key": "k", "_n": 2, "fp": 3, "id": 4, "size": 5, "target": 6.0, "score": 7.0, "ids": "x", "kept": True, "text_sha256": "y", "grp": 8, "copies": 9}


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text, source): nulls, empty and very long texts, ties and repeated rows."""
    long = "lorem ipsum dolor sit amet " * 8000
    return [
        (1, None, "a"), (2, "", "a"), (3, " \t\n\r\x0b\x0c", None), (4, "one two three four five six", "a"), (5, "one  two three\nfour five six", "b"),
        (6, "onetwothreefourfivesix", "b"), (7, "One two three four five six", None), (7, "One two three four five six", None), (8, long, "b"), (9, long + "x", "c"),
        (None, "no id here", "c"), (None, None, None), (10, "é中😀 mail a.b@c.de or +1 (555) 010-9999, 10.0.0.1, 4111 1111 1111 1111", "c"), (11, "\n\n\n", "c"), (12, "x", "c"),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(odd_rows, "doc_id long, text string, source string").repartition(3)
    docs = docs.withColumn("lang", F.lit(None).cast("string")).withColumn("n_chars", F.length("text").cast("long"))
    return docs.withColumns({c: F.lit(v) for c, v in CLASHES.items()})


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.filter("doc_id < 0")
