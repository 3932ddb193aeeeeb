"""Registered queries against their SQL, on the small tables and on tables of odd rows."""

from __future__ import annotations

import os

import pytest
from compare import database, difference

from tunefathom.llm import url_templates
from tunefathom.llm.queries import QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LONG = " ".join(f"word{i % 900} of" for i in range(30_000))
TEXTS = [
    None, "", " \t\n ", "one", "one two", "One TWO", "a b c", "A B C", "a b c d", "x " * 200, LONG, LONG + " end", "ÄÖÜ straße ÄÖÜ", "a\u00a0b c\u2003d e",
    "the quick brown fox of the hill\nthe quick brown fox of the hill\n\n", "the quick brown fox of the hill", "the quick brown fox of tha hill",
    "the quack brown fox of tha hill", "the quick brown fox of the hill!", "hequick brown fox of the hill", "short line", "short line",
    "#*$%&|<> " * 30, "• a\n• b\n- c\n" * 10, "done...\nmore…\n" * 20, "ALL CAPS TEXT HERE NOW " * 12, "tab\tseparated\vwords\fhere\r\nnext",
    " ".join(f"t{i}" for i in range(100)), " ".join(f"t{i}" for i in range(101)), " ".join(f"t{i}" for i in range(2, 101)), " ".join(f"t{i}" for i in range(95)),
    "rep a b rep a b rep a b", "z" * 400 + "\n" + "z" * 401 + "\n" + "z" * 403,
]
URLS = [None, "", "no scheme", "http://", "http://WWW.Example.COM/en/a", "https://example.com/en/1", "https://sub.example.com/en/x?y#z", "ftp://x.net/es/1", "ftp://x.net/de/1",
        "x://y://z.com/a", "http://net/fr/", "http://notexample.com/en/1", "http://a.com?x=/", "http://a.com#f", "http://user@a.org/a/b/c/d/e/f/g", "http://a.org//en//1/", "http://É.net/es/ü"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Documents and pages with nulls, empty and long texts, ties and repeats."""
    folder = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(i * 3 % 101, t, ("en", "de", None, "")[i % 4], ("s", "t", None)[i % 3], None) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(folder + "/documents.parquet")
    spark.createDataFrame([(1, None), (2, ""), (3, "the quick brown fox of the hill"), (3, "one two three")], "item_id long, text string").write.parquet(folder + "/benchmark.parquet")
    pages = [(i, u, None) for i, u in enumerate(URLS)] + [(100 + i, f"http://h{i % 3}.net/{'de' if i % 2 else 'es'}/{i}.html", None) for i in range(120)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(folder + "/pages.parquet")
    return folder


def _frames(folder):
    import duckdb
    db = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    return db


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_small_tables(spark, name):
    assert difference(spark, QUERIES[name], FOLDER, database(FOLDER)) is None


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_odd_rows(spark, odd, name):
    assert difference(spark, QUERIES[name], odd, _frames(odd)) is None


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if not q.sql])
def test_runs_on_whole_tables(spark, name):
    got = QUERIES[name].run(spark, FOLDER)
    if name.startswith("op1_"):
        assert got.count() > 0
    else:
        assert got.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()


@pytest.mark.parametrize("name", ["op2_line_dedup", "op5_url_templates", "op6_quality_rules"])
def test_native_plans_run_no_python(spark, name):
    plan = QUERIES[name].run(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))


def test_clashing_columns_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x", "own")], "page_id long, url string, host string")
    row = url_templates.judge_urls(pages).first()
    assert row["host"] == "a.com" and row["verdict"] == "allow" and row["rule"] == "com/"
    assert url_templates.judge_urls(pages.limit(0)).count() == 0


def test_unlabelled_hosts_are_judged_alike_beside_blocks_and_allows(spark):
    clean = [(i, f"http://clean.org/about/{w}") for i, w in enumerate(["me", "us", "them"] * 5)]
    blocked = [(100 + i, f"http://h{i % 4}.net/es/{i}") for i in range(40)]
    allowed = [(200 + i, f"http://h{i % 4}.com/x/{i}") for i in range(40)]
    for most in (blocked + allowed[:5], allowed + blocked[:5]):
        rows = url_templates.judge_urls(spark.createDataFrame(clean + most, "page_id long, url string")).collect()
        assert {r["verdict"] for r in rows if r["host"] == "clean.org"} == {"allow"}
    # frequent unlabelled siblings of blocked segments are not taken for them; rare ones under a mostly blocked wildcard are
    pages = [(i, f"http://a.net/{'es' if i % 2 else 'de'}/{i}") for i in range(60)]
    pages += [(500 + i, f"http://b.net/es/{'abcdefghijklmnop'[i]}") for i in range(8)] + [(600, "http://b.net/zz/q")]
    got = {r["page_id"]: r for r in url_templates.judge_urls(spark.createDataFrame(pages, "page_id long, url string")).collect()}
    assert got[0]["verdict"] == "allow" and got[0]["template"].startswith("/?") and got[1]["verdict"] == "block"
    assert got[600]["template"] == got[500]["template"] == "/*/*" and got[600]["verdict"] == "block"


def test_the_template_plan_grows_with_its_levels_only(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 3}.net/a/{i}/b") for i in range(50)], "page_id long, url string")
    plans = [url_templates.grow_templates(_labelled(pages), levels)._jdf.queryExecution().executedPlan().toString().count("Exchange") for levels in (2, 4)]
    assert plans[0] == plans[1]


def _labelled(pages):
    from pyspark.sql import functions as F
    host, path = url_templates.host_and_path(F.col("url"))
    rows = pages.select(host.alias("host"), path.alias("path"))
    return rows.withColumns({"rule_verdict": url_templates.fitting_rule(F.col("host"), F.col("path"))[1], "general": url_templates.general_path(F.col("path"))})
