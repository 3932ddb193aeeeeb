"""Streams over several micro-batches against their batch twins, with repeats across batches."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from tunefathom.operators import features as fe, playlists as pl, ranking as rk
from tunefathom.session import work_path
from tunefathom.sources import library as li
from tunefathom.streaming import jobs, runs


def micro_batches(spark, rows, schema, batches):
    """Rows as a file stream of one file per batch, in order."""
    path = work_path(spark, "stream-input")
    size = -(-len(rows) // batches)
    for i in range(batches):
        spark.createDataFrame(rows[i * size:(i + 1) * size], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def paths(spark, name):
    base = work_path(spark, name)
    return f"{base}/out", f"{base}/checkpoint"


def test_job_stages_over_batches(spark):
    random.seed(4)
    start = dt.datetime(2024, 1, 1)
    rows = [(random.randrange(12), random.choice(["queued", "queued", "searching", "analyzing"]), start + dt.timedelta(seconds=31 * i)) for i in range(400)]
    rows += [(3, "finished", start + dt.timedelta(days=2)), (4, None, start + dt.timedelta(days=2))]
    schema = "job_id bigint, stage string, ts timestamp"
    out, checkpoint = paths(spark, "stages")
    jobs.stream_job_stage(micro_batches(spark, rows, schema, 5), out, checkpoint).awaitTermination()
    got = {tuple(r) for r in jobs.current_stages(spark, out).select("job_id", "stage", "stage_since").collect()}
    want = rk.stage_since(spark.createDataFrame(rows, schema)).filter("stage <> 'finished'").select("job_id", "stage", "stage_since")
    assert got == {tuple(r) for r in want.collect()} and len(got) == 11


def test_dedup_over_batches(spark):
    random.seed(5)
    start = dt.datetime(2024, 1, 1)
    rows = [(f"s{random.randrange(60)}", random.choice([None, f"r{random.randrange(20)}"]), start + dt.timedelta(minutes=i)) for i in range(300)]
    schema = "song_id string, recording_id string, ts timestamp"
    library = spark.createDataFrame([("s1", "r1"), ("s2", None), ("other", "r5")], "song_id string, recording_id string")
    songs, recordings, want = {"s1", "s2", "other"}, {"r1", "r5"}, set()
    for song, recording, _ in rows:  # in the order of arrival, which here is that of time
        if song not in songs:
            songs.add(song)
            if recording is None or recording not in recordings:
                recordings.add(recording)
                want.add((song, recording))
    for batches in (1, 20):
        out, checkpoint = paths(spark, "dedup")
        query = jobs.stream_dedup_songs(micro_batches(spark, rows, schema, batches), library, out, checkpoint)
        query.awaitTermination()
        got = [tuple(r) for r in jobs.written(spark, out, "song_id string, recording_id string").collect()]
        assert len(got) == len(set(got)) and set(got) == want
    # a batch reads its own arrivals, and the first one the library besides; not what was written before
    assert len([p for p in query.recentProgress if p.numInputRows]) == 20 and {p.numInputRows for p in query.recentProgress if p.numInputRows} == {15}


def test_links_over_many_batches(spark):
    random.seed(7)
    new = [(random.choice("pqr"), f"s{random.randrange(9)}", random.randrange(100)) for _ in range(50)]
    schema = "playlist_id string, song_id string, position int"
    links = spark.createDataFrame([("p", "s1", 5), ("p", "s2", 1), ("x", "gone", 3)], schema)
    songs = spark.createDataFrame([(f"s{i}",) for i in range(8)], "song_id string")
    out, checkpoint = paths(spark, "links")
    jobs.stream_playlist_links(micro_batches(spark, new, schema, 25), links, songs, out, checkpoint, fan=3).awaitTermination()
    want = pl.upsert_links(links, spark.createDataFrame(new, schema), songs)
    got = jobs.current_links(spark, out, links)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.select("playlist_id", "song_id", "position").collect()}
    assert len(runs.live_runs(spark, out)) <= 2 * 3 and len(runs.live_runs(spark, out, 9)) == 1
    # a batch that is run again starts from the list before it
    again = spark.createDataFrame([("q", "s0", -1)], schema)
    runs.add_run(spark, out, 24, again, jobs._lowest, 3)
    assert jobs.current_links(spark, out, links).filter("position = -1").count() == 1


def test_suggestions_come_back_after_their_memory(spark):
    random.seed(8)
    start = dt.datetime(2024, 1, 1)
    rows = sorted(
        [(start + dt.timedelta(seconds=random.randrange(200_000)), random.choice("abc")) for _ in range(200)] + [(start, "edge"), (start + dt.timedelta(hours=6), "edge"), (start + dt.timedelta(hours=12, microseconds=-1), "edge")])
    last, want = {}, set()
    for ts, video in rows:
        if video not in last or ts >= last[video] + dt.timedelta(hours=6):
            last[video] = ts
            want.add((video, ts))
    for batches in (1, 7):
        out, checkpoint = paths(spark, "suggestions")
        stream = micro_batches(spark, [(v, ts) for ts, v in rows], "video_id string, ts timestamp", batches)
        jobs.stream_suggestions(stream, out, checkpoint).awaitTermination()
        got = [tuple(r) for r in spark.read.parquet(out).select("video_id", "ts").collect()]
        assert len(got) == len(want) and set(got) == want


def test_new_songs_meet_the_library_and_each_other(spark):
    random.seed(6)
    keys = ["bpm", "happy"]
    library = spark.createDataFrame([(i, random.uniform(60, 180), random.random()) for i in range(1, 40)], "song_id bigint, bpm double, happy double")
    statistics = fe.feature_statistics(library, keys)
    vectors = fe.standardise(library, keys, statistics)
    model = fe.fit_map(vectors, 2)
    new = [(100 + i, random.uniform(60, 180), random.random()) for i in range(9)] + [(5, 1.0, 1.0), (100, 70.0, 0.5)]
    out, checkpoint = paths(spark, "add")
    stream = micro_batches(spark, new, "song_id bigint, bpm double, happy double", 3)
    jobs.stream_add_songs(stream, vectors, statistics, model, keys, f"{out}/map", f"{out}/edges", checkpoint, k=4, cell_rows=8).awaitTermination()
    placed = jobs.written(spark, f"{out}/map", "song_id bigint, features array<double>, x double, y double").collect()
    assert sorted(r["song_id"] for r in placed) == list(range(100, 109))
    edges = jobs.written(spark, f"{out}/edges", "song_id bigint, rank int, neighbor_id bigint, distance double")
    # the last batch has seen everybody, so its neighbours are those of the whole set
    everybody = vectors.unionByName(spark.createDataFrame([(r["song_id"], r["features"]) for r in placed], vectors.schema))
    want = {tuple(r) for r in fe.knn(everybody, 4).filter("song_id = 108").select("rank", "neighbor_id").collect()}
    assert {tuple(r) for r in edges.filter("song_id = 108").select("rank", "neighbor_id").collect()} == want


def test_a_new_song_costs_neither_a_state_per_library_song_nor_a_pass_over_the_library(spark):
    random.seed(10)
    keys, size, schema = ["bpm", "happy"], 2000, "song_id bigint, bpm double, happy double"
    library = spark.createDataFrame([(i, random.uniform(60, 180), random.random()) for i in range(size)], schema)
    statistics = fe.feature_statistics(library, keys)
    vectors = fe.standardise(library, keys, statistics)
    new = [(size + i, random.uniform(200, 900), random.uniform(1, 9)) for i in range(600)] + [(size, 1.0, 1.0), (5, 70.0, 0.5), (None, 70.0, 0.5)]
    out, checkpoint = paths(spark, "add")
    query = jobs.stream_add_songs(micro_batches(spark, new, schema, 1), vectors, statistics, fe.fit_map(vectors, 2), keys, f"{out}/map", f"{out}/edges", checkpoint, k=3, cell_rows=16)
    query.awaitTermination()
    assert sum(o.numRowsTotal for p in query.recentProgress for o in p.stateOperators) <= len(new)  # what the stream keeps as state
    placed = {r["song_id"]: r["features"] for r in jobs.written(spark, f"{out}/map", "song_id bigint, features array<double>").collect()}
    assert sorted(placed) == list(range(size, size + 600))
    songs = {**{r["song_id"]: r["features"] for r in vectors.collect()}, **placed}
    ids, points = np.array(list(songs)), np.array(list(songs.values()))
    got: dict = {}
    for r in jobs.written(spark, f"{out}/edges", "song_id bigint, rank int, neighbor_id bigint, distance double").collect():
        got.setdefault(r["song_id"], {})[r["rank"]] = r["neighbor_id"]
    for song, vector in placed.items():
        far = np.sqrt(((points - vector) ** 2).sum(1))
        far[ids == song] = np.inf
        assert [got[song][i] for i in (1, 2, 3)] == list(ids[np.lexsort((ids, far))[:3]])


def test_new_songs_visit_few_cells_also_where_the_library_has_none(spark):
    rng = np.random.default_rng(11)
    def vectors(first, n, at):
        return spark.createDataFrame([(first + i, rng.normal(at, 1, 2).tolist()) for i in range(n)], "song_id bigint, features array<double>")
    met = {}
    for n in (500, 4000):
        library, new = vectors(0, n, 0), vectors(n, n, 30)
        index = fe.CellIndex.of(np.concatenate([fe.pivots_of(x.toDF("_rep", "_vec"), 16) for x in (library, new)]), even=True)
        held = fe.songs_in_cells(library, index)
        cells = fe.stored_cells(index, fe.balls(held), lambda wanted: held.filter(F.col("_cell").isin(wanted)).drop("_far"))
        _, there, own = fe.new_in_cells(fe.songs_in_cells(new, index), cells, 3)
        sizes = there.groupBy("_cell").count()
        met[n] = own.select(F.explode("visits").alias("_cell")).join(sizes, "_cell").agg(F.sum("count")).first()[0]
        assert there.filter(F.col("_rep") < n).count() < n / 4  # cells that no new song may reach are not read
    assert met[4000] < 8**1.75 * met[500] and met[4000] < 4000**2 / 10


def test_library_rows_that_come_twice_are_neighbours_twice_in_any_cells(spark):
    schema = "song_id bigint, features array<double>"
    library = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(60)] * 2 + [(7, [7.4, 0.0]), (None, [9.0, 0.0])], schema)
    new = spark.createDataFrame([(100, [7.3, 0.0]), (101, [20.0, 0.0]), (102, [20.0, 0.0])], schema)
    for rows in (8, 4096):
        got = fe.knn_of_new(new, fe.cells_of(library, cell_rows=rows), 3).collect()
        assert sorted((r["song_id"], r["rank"], r["neighbor_id"]) for r in got) == [
            (100, 1, 7), (100, 2, 7), (100, 3, 7), (101, 1, 20), (101, 2, 20), (101, 3, 102), (102, 1, 20), (102, 2, 20), (102, 3, 101)]


def test_failures_over_batches(spark):
    rows = [("bulk", "x" * 600, "v", "saved", "duplicate", None), ("bulk", "x" * 600, "v", "error", "write_error: disk", "raw"), ("bulk", "l", None, None, None, None)]
    out, checkpoint = paths(spark, "failures")
    schema = "source string, label string, video_id string, status string, reason string, message string"
    jobs.stream_failures(micro_batches(spark, rows, schema, 3), out, checkpoint).awaitTermination()
    got = sorted((len(r["label"]), r["status"], r["reason"], r["detail"]) for r in spark.read.parquet(out).collect())
    assert got == [(1, "error", "error", "unknown"), (512, "error", "write_error", "disk — raw")]


def test_library_round_trip(spark):
    from tunefathom import schemas
    root = work_path(spark, "library")
    li.create_library(spark, root)
    result = {"title": "Hello", "artist": "Adele", "dsp": {"bpm": 79.0, "loudness_short_term_timeseries": [-9.0, -8.0]}, "files": {"duration_seconds": 295.0},
              "parent_genres": [{"label": "Pop", "score": 0.7}, {"label": "Soul", "score": 0.2}], "artist_info": {"bio": "x"}}
    import json
    path = work_path(spark, "results")
    spark.createDataFrame([(json.dumps(r),) for r in (result, {**result, "title": " hello "}, {"title": "", "artist": "A"})], "value string").write.text(path)
    for _ in range(2):  # the second run finds the song stored
        li.write_songs(spark.read.schema(schemas.ANALYSIS_RESULT).json(path), root)
    rows = li.scan_songs(spark, root).collect()
    assert len(rows) == 1 and rows[0]["bpm"] == 79.0 and [e["label"] for e in rows[0]["parent_genres"]] == ["Pop", "Soul"] and rows[0]["instruments"] is None
    assert li.scan_feature(spark, root, "loudness").collect()[0]["values"] == [-9.0, -8.0]
    assert li.song_detail(spark, root, rows[0]["song_id"]).count() == 1 and li.read_table(spark, root, "artists").count() == 1
    plan = li.scan_feature(spark, root, "happy")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<song_id:string,happy_timeseries:array<double>>" in plan
    li.truncate_library(spark, root)
    assert li.scan_songs(spark, root).count() == 0


def test_batches_of_a_stream_are_written_by_several_tasks(spark):
    from tunefathom.queries.registry import Tables
    from tunefathom.queries.streams import _in_batches
    rows, out, checkpoint, seen = spark.range(0, 4000, 1, 4).withColumnRenamed("id", "n"), work_path(spark, "out"), work_path(spark, "checkpoint"), []

    def run(stream):
        def add(batch, batch_id):
            seen.append((batch_id, sorted(r["n"] for r in batch.collect()), len(batch.select("_metadata.file_path").distinct().collect())))
        return stream.select("n", "_metadata").writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    _in_batches(Tables(spark, "/root/testdata/sf0.001"), rows.withColumn("n", (F.col("n") * 1337) % 4000), "n", 3, run)
    assert [b for b, _, _ in seen] == [0, 1, 2] and all(files == 4 for _, _, files in seen)
    assert sorted(sum((n for _, n, _ in seen), [])) == list(range(4000)) and all(a[1][-1] < b[1][0] for a, b in zip(seen, seen[1:]))


def test_landed_documents_are_compressed(spark):
    from tunefathom.queries.registry import Tables
    from tunefathom.queries.sources import _landed
    landed = _landed(Tables(spark, "/root/testdata/sf0.001"), spark.range(3).select(F.col("id").cast("string").alias("playlist_id")), "playlist_id string")
    assert landed.count() == 3 and all(f.endswith(".json.gz") for f in landed.inputFiles())
