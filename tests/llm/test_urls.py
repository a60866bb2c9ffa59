import duckdb
import pytest

from kinweave.llm import urls

URLS = [
    (1, "http://a.example.com/en/5"), (2, "https://WWW.Example.COM/en/5?x=/fr/"), (3, "https://m.www.example.com/en/"),
    (4, "https://b.net/es/1"), (5, "https://net/fr/1#x"), (6, "https://b.net/en"), (7, None), (8, ""), (9, "no scheme casino"),
    (10, "http://cheap-pills.org/x"), (11, "http://cheap.org/free"), (12, "http://casinos.org"), (13, "x://CASINO.org?y"), (14, "http://com"),
    (15, "http://com/"), (16, "http://notcom/en/"), (17, "a://b://c/d"), (18, "http://é.com/ü?"), (1, "http://a.example.com/en/5"),
]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame(URLS, "page_id long, url string").selectExpr("*", "'q' AS host", "'q' AS verdict", "'q' AS terms")


def test_against_sql(spark, pages):
    found = urls.filter_urls(pages).drop("url", "terms")
    table = pages.select("page_id", "url").toPandas()  # noqa: F841
    con = duckdb.connect()
    con.register("pages", table)
    rows = con.execute(urls.oracle()).fetchall()
    names = [x[0] for x in con.description]
    assert sorted(tuple(r[n] for n in names) for r in found.collect()) == sorted(rows, key=lambda r: tuple(str(x) for x in r)) or sorted(
        (tuple(r[n] for n in names) for r in found.collect()), key=repr
    ) == sorted(rows, key=repr)


def test_cases(pages):
    rows = {r.page_id: r for r in urls.filter_urls(pages).collect()}
    assert (rows[1].rule, rows[1].verdict) == ("example.com/en/", "block")
    assert (rows[2].host, rows[2].path, rows[2].verdict) == ("www.example.com", "/en/5", "allow")
    assert (rows[4].rule, rows[5].rule, rows[6].rule, rows[14].rule, rows[15].rule, rows[16].rule) == ("net/es/", "net/fr/", None, None, "com/", None)
    assert (rows[7].host, rows[7].path, rows[7].verdict) == ("", "", "allow")
    assert [rows[i].verdict for i in (9, 10, 11, 12, 13)] == ["block", "block", "block", "allow", "block"]


def test_empty(spark):
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
