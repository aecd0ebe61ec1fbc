import duckdb

from chronofold.llm import queries, url_reputation as ur
from pyspark.sql import functions as F


def verdicts(spark, urls, outcomes=()):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    known = spark.createDataFrame(list(outcomes) or [("", None)], "host string, bad int")
    return {r["page_id"]: r for r in ur.judge_urls(pages, known).collect()}


def test_hosts_paths_and_rules(spark):
    cases = [
        ("http://A.Example.com/en/1?x#y", "a.example.com", "/en/1", "example.com/en/", "block"),
        ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("https://x.www.example.com/en/2", "x.www.example.com", "/en/2", "www.example.com/en/", "allow"),
        ("https://notexample.com/en/2", "notexample.com", "/en/2", "com/", "allow"),
        ("http://a.net/es/1", "a.net", "/es/1", "net/es/", "block"),
        ("http://a.net/fr", "a.net", "/fr", None, "allow"),
        ("http://a.com?x=/en/", "a.com", "", None, "allow"),
        ("http://É.org/p?://z/", "É.org", "/p", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("x://", "", "", None, "allow"),
        ("a://b://c/d", "b:", "//c/d", None, "allow"),
        ("http://h\n/p\nq", "h\n", "/p\nq", None, "allow"),
    ]
    got = verdicts(spark, [c[0] for c in cases])
    assert [(c[0], *(got[i][x] for x in ("host", "path", "rule", "verdict"))) for i, c in enumerate(cases)] == cases


def test_domains(spark):
    hosts = ["a.b.example.com", "example.com", "localhost", "x.y.co.uk", "co.uk", "u@h.example.org:80", "10.0.0.1", ""]
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    d = ur.registered_domain(F.col("h"))
    assert [tuple(r) for r in df.select(d, ur.suffix(d)).collect()] == [("example.com", "com"), ("example.com", "com"), ("localhost", ""), ("y.co.uk", "co.uk"), ("co.uk", "uk"), ("example.org", "org"), ("10.0.0.1", "0.0.1"), ("", "")]


def test_reputation_blocks_hosts_with_enough_bad_pages(spark):
    outcomes = [("bad.site.org", 1)] * 40 + [("good.site.org", 0)] * 40 + [("few.other.org", 1)] + [("x.fine.org", 0)] * 60 + [("new.evil.io", None)] + [(f"h{i}.evil.io", 1) for i in range(40)]
    got = verdicts(spark, ["http://bad.site.org/a", "http://good.site.org/a", "http://few.other.org/a", "http://new.evil.io/"], outcomes)
    assert [got[i]["verdict"] for i in range(4)] == ["block", "allow", "allow", "block"]
    bounds = {r["host"]: r["bound"] for r in ur.host_reputation(spark.createDataFrame(outcomes, "host string, bad int")).collect()}
    assert bounds["bad.site.org"] > bounds["few.other.org"] > bounds["x.fine.org"]


def test_no_python_in_the_plan_and_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    out = ur.judge_urls(pages, pages.select(F.col("url").alias("host"), F.lit(1).alias("bad")))
    assert out.count() == 0
    assert not any(x in out._jdf.queryExecution().executedPlan().toString() for x in ("Python", "Arrow", "Pandas"))


def test_query_against_its_sql(spark):
    d = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in ("pages", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    want = sorted(db.execute(queries.ORACLE_SQL["op8_url_reputation"]).fetchall(), key=str)
    cols = [c[0] for c in db.execute(queries.ORACLE_SQL["op8_url_reputation"]).description]
    assert sorted((tuple(r[c] for c in cols) for r in queries.op8_url_reputation(spark, d).collect()), key=str) == want


def test_query_blocks_hosts_by_reputation_as_its_sql(spark, tmp_path):
    """A table in which the method decides: hosts with mostly bad pages, without any rule."""
    pages, labels = [], []
    for host, n, bad in (("bad.evil.org", 60, 57), ("new.evil.org", 3, 3), ("fine.good.org", 300, 9), ("few.mixed.org", 2, 1), ("x.y.co.uk", 40, 39), ("unknown.io", 0, 0)):
        for i in range(max(n, 1)):
            number = len(pages) + 1
            pages.append((number, f"https://{host}/p/{number}.html"))
            if i < n:
                labels.append((number, int(i >= bad), 0))
    pages += [(9000, None), (9001, "bad.evil.org"), (9002, "https://bad.evil.org/nothing"), (9002, "https://bad.evil.org/nothing"), (None, "https://fine.good.org/" + "x" * 50_000)]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    db = duckdb.connect()
    for t in ("pages", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    found = db.execute(queries.ORACLE_SQL["op8_url_reputation"])
    cols = [c[0] for c in found.description]
    rows = queries.op8_url_reputation(spark, str(tmp_path)).collect()
    assert sorted((tuple(r[c] for c in cols) for r in rows), key=str) == sorted(found.fetchall(), key=str)
    verdict = {r["host"]: r["verdict"] for r in rows}
    assert {h for h, v in verdict.items() if v == "block"} == {"bad.evil.org", "new.evil.org", "x.y.co.uk"}
    assert all(r["rule"] is None for r in rows)
