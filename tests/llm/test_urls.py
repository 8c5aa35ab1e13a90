import re

import duckdb
import pytest

from waterspark.llm import url_filter
from waterspark.session import new_shared_path

URLS = [
    None, "", "no scheme", "http://", "http://WWW.Example.COM/en/5?x#y", "https://a.example.com/en/5", "https://example.com/en/", "https://example.com/en",
    "https://example.com/de/7", "http://x.net/es/1", "http://x.net/en/1", "http://notnet/es/1", "http://net/es/a", "ftp://y.org/fr/1", "http://h.com", "http://h.com?q=/en/",
    "http://h.com:80/en/1", "x://a://b.net/fr/2", "http://a.net/es/1\n/x", "http://é.net/fr/9", "http://x.net/a/b/c/d/e/f/g", "http://x.net//es///1/",
]


@pytest.fixture(scope="module")
def pages(spark):
    urls = URLS + [f"http://hot.net/{['es', 'en', 'blog'][i % 3]}/post-{i}/{'x' if i % 2 else 'y'}" for i in range(300)]
    urls += [f"http://wild.org/{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + [f"http://mixed.net/{'es/' if i % 4 else 'es'}" for i in range(40)]
    rows = [(i, u) for i, u in enumerate(urls)] + [(5, urls[5]), (None, urls[9])]
    return spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'h' AS host", "1 AS shape", "'v' AS verdict", "2 AS n", "'t' AS node")


def test_as_sql(spark, pages):
    made = url_filter.judge_urls(pages)
    assert not re.search("Python|Pandas|Arrow", made._jdf.queryExecution().executedPlan().toString())
    path = new_shared_path(spark, "pages")
    pages.write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{path.removeprefix('file:')}/*.parquet'")
    cur = con.execute(url_filter.oracle_sql())
    names = [d[0] for d in cur.description]
    assert sorted(map(repr, (tuple(r[n] for n in names) for r in made.collect()))) == sorted(map(repr, cur.fetchall()))


def test_rules(pages):
    got = {r["page_id"]: r for r in url_filter.judge_urls(pages).collect()}
    want = {4: ("www.example.com", "/en/5", "www.example.com/en/", "allow"), 5: ("a.example.com", "/en/5", "example.com/en/", "block"), 7: ("example.com", "/en", "com/", "allow"),
            8: ("example.com", "/de/7", "com/", "allow"), 9: ("x.net", "/es/1", "net/es/", "block"), 10: ("x.net", "/en/1", None, "allow"), 11: ("notnet", "/es/1", None, "allow"),
            12: ("net", "/es/a", "net/es/", "block"), 14: ("h.com", "", None, "allow"), 0: ("", "", None, "allow"), 2: ("", "", None, "allow"), 16: ("h.com:80", "/en/1", None, "allow")}
    for i, (host, path, rule, verdict) in want.items():
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, rule, verdict)


def test_impure_template_goes(pages):
    verdicts = {r["verdict"] for r in url_filter.judge_urls(pages).filter("host = 'mixed.net' AND rule IS NULL").collect()}
    assert verdicts == {"block"} or verdicts == {"allow"}  # one template, one verdict
    assert url_filter.judge_urls(pages).filter("host = 'wild.org'").select("purity").distinct().count() == 1


def test_no_pages(pages):
    assert url_filter.judge_urls(pages.filter("page_id < 0")).collect() == []
