"""Texts are normalised once, and only where cheaper conditions hold; work is dealt out."""

from __future__ import annotations

import pytest

from tunefathom.operators import catalogue as ca, matching as ma
from tunefathom.sources import catalogue as sc


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


TRACKS = "track_id bigint, title string, artists array<string>, duration_ms bigint"


def test_names_in_credits_are_normalised_once(spark):
    credits = spark.createDataFrame([(1, "Ána & Bo"), (2, " ")], "k int, a string")
    names = ma.artist_keys(credits, "k", "a")
    assert plan_of(names).count("without_accents(") == 1
    assert {(r["k"], r["_name"]) for r in names.collect()} == {(1, "ana bo"), (1, "ana"), (1, "bo")}


def test_titles_are_read_only_where_an_artist_is_shared(spark):
    tracks = spark.createDataFrame([(1, "Long Title Here", ["Ana"], 1000), (2, "Other", ["Bo"], 1000)], TRACKS)
    heard = spark.createDataFrame([(1, 10, "Long Title Hare", "Ana"), (1, 11, "Long Title Here", "Nobody"), (1, 12, "Long Title 2", "Ana"), (2, 13, "OTHER", "Bo"), (2, 14, None, "Bo")],
                                  "track_id bigint, found_id bigint, title string, artist string")
    found = ma.identity_matches(tracks, heard)
    assert {(r["track_id"], r["found_id"]) for r in found.collect()} == {(1, 10), (2, 13)}
    lines = plan_of(found).splitlines()
    above = [i for i, line in enumerate(lines) if "without_accents" in line]
    assert min(above) < next(i for i, line in enumerate(lines) if "LeftSemi, ((track_id" in line)


def test_lengths_are_compared_before_texts_are_read(spark):
    tracks = spark.createDataFrame([(1, "Song", ["Ana"], 100_000)], TRACKS)
    hits = spark.createDataFrame([(1, "a", "Ana - Song", "Fan", 100), (1, "b", "Ana - Song", "Fan", 500), (1, "c", "Ana - Else", "Fan", 100)],
                                 "track_id bigint, video_id string, video_title string, uploader string, duration int")
    fits = ma.candidate_fits(tracks, hits)
    assert [r["video_id"] for r in fits.collect()] == ["a"]
    lines = plan_of(fits).splitlines()
    assert next(i for i, line in enumerate(lines) if "without_accents" in line) < next(i for i, line in enumerate(lines) if "Join Inner" in line)


def test_the_first_tier_is_found_in_one_reading(spark):
    tracks = spark.createDataFrame([(1, "s", ["a"], 100_000), (2, "s", ["a"], None)], TRACKS)
    rows = [(1, "x", "Fan", 100, 5, 2), (1, "y", "Fan", 130, 6, 1), (1, "z", "B - Topic", 190, 7, 1), (1, "v", "Fan", 101, 8, 1), (1, "n", "Fan", 100, 9, None), (2, "w", "Fan", None, 1, 3)]
    fitting = spark.createDataFrame(rows, "track_id bigint, video_id string, uploader string, duration int, input_pos bigint, tier int")
    first = ma.first_fitting(fitting, tracks, attempts=2)
    assert sorted((r["track_id"], r["video_id"], r["attempt"]) for r in first.collect()) == [(1, "v", 2), (1, "z", 1), (2, "w", 1)]
    assert plan_of(first).count("LogicalRDD") + plan_of(first).count("LocalRelation") == 2


def test_channels_are_compared_before_titles_are_read(spark):
    tracks = spark.createDataFrame([(1, "Song", ["Ana"], 100_000)], TRACKS)
    videos = spark.createDataFrame([(1, "a", "Ana - Song (Official Video) 2011", "AnaVEVO"), (1, "b", "Ana - Song", "Fan"), (1, "c", "Ana - Song drum cam", "Ana - Topic")],
                                   "track_id bigint, video_id string, video_title string, uploader string")
    found = ma.trusted_upload(tracks, videos)
    assert [r["video_id"] for r in found.collect()] == ["a"]
    lines = plan_of(found).splitlines()
    assert next(i for i, line in enumerate(lines) if "video_title" in line and "without_accents" in line) < next(i for i, line in enumerate(lines) if "Join Inner" in line)


def test_similar_tracks_are_parsed_once(spark):
    documents = spark.createDataFrame([(1, '[{"name": "T", "match": "0.5", "artist": "A"}, {"name": "U"}]'), (2, "[]"), (3, None), (4, '{"name": "V"}')], "k int, text string")
    rows = sc.similar_tracks(documents, "k", "text")
    assert plan_of(rows).count("from_json") == 1
    assert sorted((r["k"], r["position"], r["title"], r["similarity"]) for r in rows.collect()) == [(1, 0, "T", 0.5), (1, 1, "U", 0.0), (4, 0, "V", 0.0)]


def test_credits_are_sorted_in_bounded_parts(spark, monkeypatch):
    monkeypatch.setattr(ca, "PERFORMANCES", 10)
    performances = spark.createDataFrame([(r, w, w) for r in range(50) for w in (r % 7, 7)], "recording_id int, work_id int, work_pos int")
    credits = spark.createDataFrame([(w, p, f"C{(w + p) % 5}") for w in range(8) for p in (0, 1)], "work_id int, credit_pos int, composer string")
    found = ca.composers(performances, credits)
    assert found.rdd.getNumPartitions() == 10
    want = {}
    for r in range(50):
        for w in (r % 7, 7):
            for p in (0, 1):
                key = (r, f"C{(w + p) % 5}")
                want[key] = min(want.get(key, (w, p)), (w, p))
    assert {(r["recording_id"], r["composer"]): (r["work_pos"], r["credit_pos"]) for r in found.collect()} == want


def _first_exchange(spark, name: str) -> str:
    from tunefathom.queries import load
    return load()[name].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["j6_in_library", "t22_similar_tracks"])
def test_heavy_rows_are_dealt_out(spark, name):
    assert "Repartition" in _first_exchange(spark, name)
