import re

import pytest
from pyspark.sql import functions as F

from cloudgrain.llm import url_filter as uf

URLS = [
    None, "", "no scheme.example.com/en/", "http://Example.COM/en/1?x#y", "https://www.example.com/en/1", "https://example.com", "http://a.net/es/", "http://a.net/espresso",
    "http://net/fr/x#/es/", "x://y://z/w", "http://?q", "http://example.com?/en/", "http://notexample.com/en/", "https://m.www.example.com/en", "http://b.org/a\nb?c",
]


def brute(url):
    host = path = ""
    if url and "://" in url:
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(r), r, a) for a, r in uf.RULES if (host + ".").endswith("." + r.split("/")[0] + ".") or host == r.split("/")[0] if path.startswith(r[r.index("/"):])]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_rules(spark):
    df = spark.createDataFrame([(i, u, None, "mine") for i, u in enumerate(URLS)], "page_id long, url string, bad int, rule string")
    for r in uf.filter_urls(df, uf.RULES).collect():
        assert (r.host, r.path, r.rule, r.verdict) == (*brute(r.url)[:3], brute(r.url)[3] or "allow"), r.url
    assert uf.filter_urls(df.where("false"), uf.RULES).count() == 0


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(f"http://h{h}.good.org/p{i}", int(i == 0)) for h in range(30) for i in range(20)]
    rows += [(f"http://s{h}.bad.org/p{i}", int(i > 0)) for h in range(30) for i in range(20)]
    rows += [("http://one.good.org/x", 1), ("http://one.bad.org/x", 0), ("http://new.bad.org/x", None), ("http://new.good.org/x", None), ("http://fresh.com/", None)]
    return spark.createDataFrame(rows, "url string, bad int")


def test_shrinkage(pages):
    got = {r.host: r for r in uf.host_reputation(pages).collect()}
    # A single outcome hardly moves a host from its domain; hosts without labels get the domain's rate.
    assert got["one.good.org"].mean < 0.5 < got["one.bad.org"].mean
    assert got["new.bad.org"].mean > 0.8 and got["new.good.org"].mean < 0.2
    assert got["s1.bad.org"].reputed == "block" and got["h1.good.org"].reputed == "allow"
    assert all(r.bound <= r.mean for r in got.values())


def test_nothing_labelled_and_one_kind(pages):
    for bad in (None, 0):
        got = uf.host_reputation(pages.withColumn("bad", F.lit(bad).cast("int"))).collect()
        assert {r.reputed for r in got} == {"allow"}


def test_registered_domains(spark):
    want = {
        "www.a.example.com": ("example.com", "com"), "example.com:8080": ("example.com", "com"), "x.shop.co.uk": ("shop.co.uk", "co.uk"), "other.co.uk:80": ("other.co.uk", "co.uk"),
        "me.github.io": ("me.github.io", "github.io"), "10.1.2.3:80": ("10.1.2.3", "(ip)"), "[::1]:80": ("[::1]", "(ip)"), "co.uk": ("co.uk", "co.uk"), "": ("", ""), "local": ("local", "local"),
    }
    df = spark.createDataFrame([(h,) for h in want], "h string")
    rows = df.select("h", uf.domain_of(df.h).alias("d"), uf.suffix_of(df.h).alias("s")).collect()
    assert {r.h: (r.d, r.s) for r in rows} == want


def test_own_columns_keep_their_values(spark):
    names = ["_rule", "_host", "_row", "reputed", "n", "bound"]
    df = spark.createDataFrame([(1, "http://a.net/es/", None, *names), (2, None, 1, *names[::-1])], "page_id long, url string, bad int, " + ", ".join(f"`{n}` string" for n in names))
    rows = {r.page_id: r for r in uf.filter_urls(df, uf.RULES).collect()}
    assert [rows[1][n] for n in names] == names and [rows[2][n] for n in names] == names[::-1]
    assert rows[1].verdict == "block" and rows[1].rule == "net/es/" and rows[2].host == ""


def test_sql_on_hosts_of_all_kinds(spark, tmp_path, monkeypatch):
    """Listed suffixes, ports and IP addresses: the SQL judges like the operator."""
    import duckdb
    from oracle import compare

    hosts = ["a.shop.co.uk", "b.shop.co.uk:8080", "other.co.uk", "me.github.io", "you.github.io:80", "10.1.2.3", "10.1.2.3:80", "10.9.9.9", "x.plain.org", "plain.org", "com", "local"]
    pages = [(i, f"http://{h}/p/{i}", "") for i, h in enumerate(h for h in hosts for _ in range(40))]
    labels = [(i, 0 if (i // 40) % 3 == 0 else 1, int((i // 40) % 3 == 1 and i % 4 == 0)) for i in range(len(pages)) if i % 7]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    assert compare(spark, con, uf.op10_url_filter, uf.ORACLE, str(tmp_path)) is None
