"""Cases the registered tables do not reach: gaps, late updates, several pages, many labels, blocks of new songs."""

from __future__ import annotations

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F
from test_streams import micro_batches, paths

from tunefathom import schemas, session
from tunefathom.operators import features as fe, ranking as rk, rollups as ro
from tunefathom.plans import shapes
from tunefathom.session import work_path
from tunefathom.sources import catalogue as sc, library as li
from tunefathom.streaming import jobs


def test_queue_with_gaps_keeps_every_row(spark):
    rows = [("q", p, f"i{p}") for p in (0, 1, 3, 4, 9)] + [("one", 7, "only")]
    df = spark.createDataFrame(rows, "list_id string, position int, item string").repartition(3)
    for chunk in (None, shapes.chunks_of(lambda p: F.floor(p / 2))):
        got = {(r["list_id"], r["position"]): (r["previous_item"], r["next_item"]) for r in rk.queue_moves(df, "list_id", "position", "item", chunk).collect()}
        assert got == {("q", 0): ("i9", "i1"), ("q", 1): ("i0", "i3"), ("q", 3): ("i1", "i4"), ("q", 4): ("i3", "i9"), ("q", 9): ("i4", "i0"), ("one", 7): ("only", "only")}


def test_every_label_of_a_song_is_read(spark):
    root = work_path(spark, "library")
    li.create_library(spark, root)
    spark.createDataFrame([("s", f"g{i:02d}", None if i == 3 else i / 20) for i in range(15)], schemas.LABELS).write.mode("append").parquet(f"{root}/parent_genres")
    spark.createDataFrame([("s",)], "song_id string").join(li.read_table(spark, root, "songs"), "song_id", "left").write.mode("append").parquet(f"{root}/songs")
    labels = [e["label"] for e in li.scan_songs(spark, root).first()["parent_genres"]]
    assert labels == [f"g{i:02d}" for i in range(14, -1, -1) if i != 3] + ["g03"]
    assert len(li.song_detail(spark, root, "s").first()["parent_genres"]) == 15


def test_playlist_pages_in_both_shapes(spark):
    def track(i, **more):
        return {"id": i, "name": "n", "type": "track", "artists": [{"name": "a"}], **more}
    rows = [("p", 1, [{"track": track("c")}, {"item": track("d")}]), ("p", 0, [{"item": track("a")}, {"item": track("x", type="episode")}, None, {"track": track("b")}]), ("q", 0, [{"track": None, "item": None}])]
    pages = spark.createDataFrame(rows, schemas.PLAYLIST_PAGE)
    got = sorted((r["playlist_id"], r["position"], r["track_id"]) for r in sc.flatten_playlist_items(pages).collect())
    assert got == [("p", 0, "a"), ("p", 1, "b"), ("p", 2, "c"), ("p", 3, "d")]


def test_results_written_after_a_failure(spark):
    """The first run stopped before ``songs``; the second completes it and takes all rows from the same result."""
    root = work_path(spark, "library")
    li.create_library(spark, root)
    import json
    results = [{"title": "T", "artist": "A", "dsp": {"bpm": b}, "files": {"duration_seconds": b}, "instruments": [{"label": "x", "score": b}]} for b in (2.0, 1.0)] + [{"title": "T", "artist": "A"}]
    path = work_path(spark, "results")
    spark.createDataFrame([(json.dumps(r),) for r in results], "value string").write.text(path)
    frame = spark.read.schema(schemas.ANALYSIS_RESULT).json(path).withColumn("order", F.when(F.col("dsp").isNull(), 9).otherwise(F.col("dsp.bpm").cast("int")))
    fresh = li.new_songs(frame, li.read_table(spark, root, "songs"), "order")
    li.split_results(fresh, li.read_table(spark, root, "artists"))["dsp"].write.mode("append").parquet(f"{root}/dsp")
    for _ in range(2):
        li.write_songs(frame, root, "order")
    row = li.scan_songs(spark, root).collect()
    assert len(row) == 1 and row[0]["bpm"] == row[0]["duration_seconds"] == row[0]["instruments"][0]["score"] == 1.0


def test_late_updates_and_finished_jobs(spark):
    start = dt.datetime(2024, 1, 1)
    def at(minutes):
        return start + dt.timedelta(minutes=minutes)
    batches = [[(1, "queued", at(0)), (2, "queued", at(0))], [(1, "analyzing", at(10)), (2, "finished", at(11))], [(1, "queued", at(5)), (2, "searching", at(6))], [(1, "finished", at(20)), (3, None, at(21))]]
    schema = "job_id bigint, stage string, ts timestamp"
    expected = [{(1, "queued"), (2, "queued")}, {(1, "analyzing")}, {(1, "analyzing")}, set()]
    for n, want in enumerate(expected, 1):
        rows = [r for b in batches[:n] for r in b]
        out, checkpoint = paths(spark, "stages")
        path = work_path(spark, "stage-input")
        for b in batches[:n]:
            spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(path)
        jobs.stream_job_stage(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path), out, checkpoint).awaitTermination()
        assert {(r["job_id"], r["stage"]) for r in jobs.current_stages(spark, out).collect()} == want, rows
    # forgotten once the newest update is a day ahead
    view = jobs.merge_stages(spark.createDataFrame([(2, "finished", at(11), at(11)), (4, "queued", at(11), at(11))], jobs.STAGE_VIEW), spark.createDataFrame([(5, "queued", at(3000))], schema))
    assert {r["job_id"] for r in view.collect()} == {4, 5}


def test_new_songs_in_several_blocks(spark):
    random.seed(9)
    library = spark.createDataFrame([(i, [random.random(), random.random()]) for i in range(60)], "song_id bigint, features array<double>")
    new = spark.createDataFrame([(100 + i, [random.random(), random.random()]) for i in range(25)], "song_id bigint, features array<double>")
    want = {tuple(r) for r in fe.knn(library.unionByName(new), 4).filter("song_id >= 100").collect()}
    for rows in (4, 4096):
        assert {tuple(r) for r in fe.knn_of_new(new, library, 4, block_rows=rows).collect()} == want
    assert fe.knn_of_new(new, library, 4, block_bytes=64).count() == 100 and fe.knn_of_new(new.limit(0), library, 4).count() == 0


def test_arousal_comes_first_and_series_follow_the_model(spark):
    rows = spark.createDataFrame([("s", m, 0, [0.9, 0.1]) for m in ("gender", "mood_sad", "mood_happy")], "song_id string, model string, patch_idx int, probs array<double>")
    assert {(r["model"], r["value"]) for r in ro.class_series(rows).collect()} == {("gender", 0.9), ("mood_sad", 0.1), ("mood_happy", 0.9)}
    av = ro.arousal_valence(rows.withColumn("probs", F.array(F.lit(5.0), F.lit(2.0)))).first()
    assert (av["arousal"], av["valence"]) == (5.0, 2.0)


def test_a_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    class Context:
        master, applicationId = "spark://host:7077", "app"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)
    with pytest.raises(ValueError):
        session.shared_folder(Session())


def test_case_folding(spark):
    from tunefathom.functions import text as tx
    words = ["Straße", "ΟΔΟΣ", "ﬁn", "ﬄ", "ABC", "Ünï"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(tx.casefold(F.col("w"))).collect()
    assert [r[0] for r in got] == [w.casefold() for w in words]


def test_library_of_the_queries_holds_a_row_of_every_part(spark):
    from tunefathom.queries.registry import Tables
    from tunefathom.queries.sources import _library
    t = Tables(spark, os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
    root, n = _library(t), t.part.count()
    assert [li.read_table(spark, root, name).count() for name in ("songs", "dsp", "tracks")] == [n, n, n]


def test_micro_batches_helper_is_ordered(spark):
    assert micro_batches(spark, [(1,), (2,)], "a int", 2).isStreaming
