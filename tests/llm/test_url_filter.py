import duckdb
from pyspark.sql import functions as F

import compare
from factsheet.llm import queries, url_filter

PAGES = "page_id long, url string, verdict string"


def judged(spark, urls, outcomes=(), **options):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], PAGES)
    labels = spark.createDataFrame(list(outcomes), "page_id long, bad boolean")
    return {r.page_id: r for r in url_filter.judge(pages, labels, **options).collect()}


def test_hosts_paths_and_rules(spark):
    urls = [None, "no scheme", "http://WWW.Example.com/en/1?x#y", "https://a.EXAMPLE.com/en/", "http://example.com", "http://b.net/es/x", "http://bnet/es/x", "x://h.net?q=/es/", "http://a.net/fr/#://b"]
    got = judged(spark, urls)
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(len(urls))] == [
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("a.example.com", "/en/", "example.com/en/", "block"),
        ("example.com", "", None, "allow"),
        ("b.net", "/es/x", "net/es/", "block"),
        ("bnet", "/es/x", None, "allow"),
        ("h.net", "", None, "allow"),
        ("a.net", "/fr/", "net/fr/", "block"),
    ]


def test_reputation_shrinks_to_the_levels_above(spark):
    urls = [f"http://{h}/x" for h in ["bad.org"] * 60 + ["good.org"] * 60 + ["few.org"] * 2 + ["new.bad.org"]]
    outcomes = [(i, i < 60 or 120 <= i < 121) for i in range(122)]
    got = judged(spark, urls, outcomes)
    assert {got[i].verdict for i in range(60)} == {"block"} and {got[i].verdict for i in range(60, 122)} == {"allow"}
    assert 0 < got[60].bad_rate < 0.1 < got[120].bad_rate < 0.9 < got[0].bad_rate < 1
    assert got[122].bad_rate > got[60].bad_rate and got[122].bad_at_least < got[0].bad_at_least


def test_domains_and_suffixes(spark):
    hosts = {
        "www.example.com": ("example.com", "com"), "blog.good.co.uk": ("good.co.uk", "co.uk"), "xco.uk": ("xco.uk", "uk"), "co.uk": ("co.uk", "co.uk"),
        "a.b.com.au:8080": ("b.com.au", "com.au"), "me@x.org.": ("x.org", "org"), "10.0.0.1:80": ("10.0.0.1", "[ip]"), "[::1]:80": ("[::1]", "[ip]"),
        "localhost": ("localhost", "localhost"), "": ("", ""), "1.2.3.example": ("3.example", "example"), "commerce.uk": ("commerce.uk", "uk"),
    }
    domain, suffix = url_filter.levels(F.col("host"))
    rows = spark.createDataFrame([(h,) for h in hosts], "host string").select("host", domain.alias("d"), suffix.alias("s")).collect()
    assert {r.host: (r.d, r.s) for r in rows} == hosts
    sql = queries.ORACLES["op4_url_filter"]
    made = duckdb.connect()
    made.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    made.execute("CREATE TABLE labels (doc_id BIGINT, quality INT)")
    made.executemany("INSERT INTO pages VALUES (?, ?)", [(i, f"http://{h}/") for i, h in enumerate(hosts)])
    found = {h: (d, x) for h, d, x in made.execute(sql[: sql.index("), domains AS")] + ") SELECT host, domain, suffix FROM hosts").fetchall()}
    assert found == hosts


def test_owners_under_one_registry_stand_apart(spark):
    urls = [f"http://{h}/x" for h in ["www.bad.co.uk"] * 60 + ["www.good.co.uk"] * 60 + ["blog.bad.co.uk", "blog.good.co.uk", "blog.other.co.uk"]]
    got = judged(spark, urls, [(i, i < 60) for i in range(120)])
    assert got[120].bad_rate > 0.75 > 0.6 > got[122].bad_rate > 0.25 > got[121].bad_rate
    assert {got[i].verdict for i in range(60)} == {"block"} and got[121].verdict == got[122].verdict == "allow"


def test_null_repeated_and_no_rows(spark):
    got = judged(spark, ["http://a.org/", "http://a.org/"], [(0, None), (None, True), (0, True), (0, False)])
    assert got[0].verdict == got[1].verdict == "allow"
    empty = spark.createDataFrame([], PAGES)
    assert url_filter.judge(empty, spark.createDataFrame([], "page_id long, bad boolean")).count() == 0


def test_query_against_sql(spark):
    folder = "/root/testdata/sf0.01"
    df = queries.QUERIES["op4_url_filter"](spark, folder)
    names, rows = compare.oracle_rows(compare.connect(folder), queries.ORACLES["op4_url_filter"])
    assert compare.spark_rows(df) == (names, rows)


def test_plan_is_native_and_pairs_nothing(spark):
    plan = queries.QUERIES["op4_url_filter"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    assert "html" not in plan
