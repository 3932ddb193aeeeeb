"""Every registered query against its SQL on the small tables, and the shape of every plan."""

from __future__ import annotations

import os

import pytest
from compare import database, difference

from tunefathom.queries import load

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = load()


@pytest.fixture(scope="module")
def db():
    return database(FOLDER)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_matches_sql(spark, db, name):
    assert difference(spark, QUERIES[name], FOLDER, db) is None


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if not q.sql])
def test_runs_without_sql(spark, name):
    assert QUERIES[name].run(spark, FOLDER).count() > 0


@pytest.mark.parametrize("name", ["a3_histogram", "a17_normalise_envelope", "m2_minmax", "f3_threshold_filter", "j6_in_library", "j7_title_in_library",
                                  "j15_backfill_finished", "m6_standardise", "a12_label_rows", "j8_candidate_fits", "e8_near_debut"])
def test_plan_has_no_cross_join(spark, name):
    plan = QUERIES[name].run(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["w1_top_n_labels", "a10_detailed_genre_counts", "a32_tag_genres"])
def test_top_n_is_limited_before_the_shuffle(spark, name):
    plan = QUERIES[name].run(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and "WindowGroupLimit" in plan


def test_scan_reads_only_what_it_needs(spark):
    plan = QUERIES["f5_mood_filter"].run(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_tax), GreaterThanOrEqual(l_tax" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_tax:double>" in plan


def test_song_scan_reads_only_its_columns(spark):
    plan = QUERIES["s1_scan_songs"].run(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<song_id:string,label:string,score:double>" in plan
    assert "reviewed" not in plan and "original_name" not in plan


@pytest.mark.parametrize("name", ["t1_song_id", "j5_resolve_tracks", "j5_candidate_ids", "j6_in_library"])
def test_song_ids_run_no_python(spark, name):
    plan = QUERIES[name].run(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan
    assert name == "j6_in_library" or not any(word in plan for word in ("Python", "Arrow", "Pandas"))


@pytest.mark.parametrize("name", ["j6_in_library", "j7_title_in_library"])
def test_texts_are_searched_without_a_row_per_place(spark, name):
    plan = QUERIES[name].run(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "posexplode" not in plan and "sequence(" not in plan


def test_contract():
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())
