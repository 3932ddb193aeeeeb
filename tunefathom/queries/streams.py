"""Streams run to completion over the driver tables and read back; the SQL is the batch twin's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from tunefathom.operators import features as fe
from tunefathom.plans.shapes import rounded
from tunefathom.queries.registry import Tables, key_if, query, sql_round
from tunefathom.queries.sources import FAILURE_ROWS_SQL, failure_stream
from tunefathom.session import settled, work_path
from tunefathom.streaming import jobs


def _stream(t: Tables, name: str) -> DataFrame:
    """A driver table as a file stream."""
    schema = getattr(t, name).schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(t.folder)


def _in_batches(t: Tables, rows: DataFrame, order: str, batches: int, run: Callable[[DataFrame], StreamingQuery]) -> None:
    """Rows as a stream of several micro-batches, cut by ranks of a column: ``run`` starts the job again for each.

    A run takes all files it has not seen as one batch, so a batch may be as many files as tasks write.
    """
    path = work_path(t.spark, "stream-input")
    cuts = rows.agg(F.percentile_approx(F.col(order).cast("double"), [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    number = sum([F.when(F.col(order).cast("double") > c, 1).otherwise(0) for c in cuts], F.lit(0))
    for i in range(batches):
        rows.filter(number == i).write.mode("append").parquet(path)
        run(t.spark.readStream.schema(rows.schema).parquet(path)).awaitTermination()


def _paths(t: Tables, name: str) -> tuple[str, str]:
    base = work_path(t.spark, name)
    return f"{base}/out", f"{base}/checkpoint"


_KEYS = ["p_size", "p_retailprice"]


@query("x1_stream_add_songs", f"""
    WITH s AS (SELECT avg(p_size) AS ma, stddev_pop(p_size) AS sa, avg(p_retailprice) AS mb, stddev_pop(p_retailprice) AS sb FROM part),
    n AS (SELECT -1 - s_suppkey AS song_id, (s_nationkey + 1.37 - ma) / sa AS a, (s_acctbal / 9 + 700 - mb) / sb AS b FROM supplier, s),
    l AS (SELECT p_partkey AS song_id, (p_size - ma) / sa AS a, (p_retailprice - mb) / sb AS b FROM part, s UNION ALL FROM n),
    p AS (SELECT n.song_id, l.song_id AS neighbor_id, sqrt((n.a - l.a) ** 2 + (n.b - l.b) ** 2) AS d FROM n, l WHERE n.song_id <> l.song_id)
    SELECT song_id, CAST(row_number() OVER (PARTITION BY song_id ORDER BY d, neighbor_id) AS INTEGER) AS rank, neighbor_id, {sql_round('d', 4)} AS distance FROM p QUALIFY rank <= 3""")
def _add_songs(t: Tables):
    library = t.spread("part").withColumnRenamed("p_partkey", "song_id").select("song_id", *_KEYS)
    statistics = settled(fe.feature_statistics(library, _KEYS), "song-statistics")
    vectors = settled(fe.standardise(library, _KEYS, statistics), "song-vectors")
    model = fe.fit_map(vectors, 2)
    new = _stream(t, "supplier").select((-1 - F.col("s_suppkey")).alias("song_id"), (F.col("s_nationkey") + 1.37).alias("p_size"), (F.col("s_acctbal") / 9 + 700).alias("p_retailprice"))
    out, checkpoint = _paths(t, "add-songs")
    jobs.stream_add_songs(new, vectors, statistics, model, _KEYS, f"{out}/map", f"{out}/edges", checkpoint, k=3).awaitTermination()
    edges = jobs.written(t.spark, f"{out}/edges", "song_id bigint, rank int, neighbor_id bigint, distance double")
    return edges.withColumn("distance", rounded(F.col("distance"), 4))


@query("x2_stream_job_stage", """
    WITH s AS (SELECT user_id AS job_id, event_type AS stage, ts, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events)
    SELECT job_id, arg_max(stage, ts) AS stage, epoch_us(max(ts) FILTER (WHERE stage IS DISTINCT FROM before)) AS since_us, epoch_us(max(ts)) AS last_us FROM s GROUP BY job_id HAVING arg_max(stage, ts) <> 'signup'""")
def _job_stage(t: Tables):
    stage = F.when(F.col("event_type") == "signup", jobs.FINISHED).otherwise(F.col("event_type"))
    updates = _stream(t, "events").select(F.col("user_id").alias("job_id"), stage.alias("stage"), F.col("ts").cast("timestamp").alias("ts"))
    out, checkpoint = _paths(t, "job-stage")
    jobs.stream_job_stage(updates, out, checkpoint).awaitTermination()
    return jobs.current_stages(t.spark, out).select("job_id", "stage", F.unix_micros("stage_since").alias("since_us"), F.unix_micros("last_update").alias("last_us"))


@query("x3_stream_dedup_songs", """
    WITH f AS (SELECT user_id AS song_id, arg_min(CAST(json_extract(props, '$.k') AS BIGINT), ts) AS recording_id, min(ts) AS ts FROM events WHERE user_id NOT IN (SELECT n_nationkey FROM nation) GROUP BY 1),
    w AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY ts, song_id) = 1)
    SELECT song_id, recording_id FROM w WHERE recording_id NOT IN (SELECT n_nationkey + 30 FROM nation)""")
def _dedup(t: Tables):
    arrivals = _stream(t, "events").select(F.col("user_id").alias("song_id"), F.get_json_object("props", "$.k").cast("bigint").alias("recording_id"), F.col("ts").cast("timestamp").alias("ts"))
    library = t.nation.select(F.col("n_nationkey").cast("bigint").alias("song_id"), (F.col("n_nationkey") + 30).cast("bigint").alias("recording_id"))
    out, checkpoint = _paths(t, "dedup-songs")
    jobs.stream_dedup_songs(arrivals, library, out, checkpoint).awaitTermination()
    return jobs.written(t.spark, out, "song_id bigint, recording_id bigint")


@query("x4_stream_playlist_links", """
    SELECT playlist_id, song_id, min(p) AS position FROM (
        SELECT CASE WHEN l_returnflag <> 'R' THEN l_orderkey ELSE -1 - l_orderkey END AS playlist_id, l_partkey AS song_id, l_linenumber + 1 AS p FROM lineitem UNION ALL
        SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 20)) GROUP BY 1, 2""")
def _links(t: Tables):
    def links(rows: DataFrame, step: int, playlist) -> DataFrame:
        return rows.select(playlist.alias("playlist_id"), F.col("l_partkey").alias("song_id"), (F.col("l_linenumber") + step).alias("position"))
    stored = links(t.lineitem, 1, key_if("l_returnflag <> 'R'", "l_orderkey"))
    songs = t.part.select(key_if("p_size > 20", "p_partkey").alias("song_id"))
    out, checkpoint = _paths(t, "playlist-links")
    _in_batches(t, links(t.lineitem, 0, F.col("l_orderkey")), "position", 5,
                lambda arriving: jobs.stream_playlist_links(arriving, stored, songs, out, checkpoint, fan=2))
    return jobs.current_links(t.spark, out, stored)


@query("x5_stream_suggestions", """
    WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT CAST(json_extract(props, '$.k') AS BIGINT) AS video_id, CAST(ts AS TIMESTAMP) AS ts FROM events),
    n AS MATERIALIZED (SELECT e.video_id, e.ts, f.ts AS later FROM e ASOF JOIN e f ON e.video_id = f.video_id AND e.ts + INTERVAL 6 HOUR <= f.ts),
    served AS (SELECT video_id, min(ts) AS ts FROM e GROUP BY 1 UNION ALL SELECT video_id, n.later FROM served JOIN n USING (video_id, ts))
    SELECT video_id, epoch_us(ts) AS served_us FROM served""")
def _suggestions(t: Tables):
    rows = t.events.select(F.get_json_object("props", "$.k").cast("bigint").alias("video_id"), F.col("ts").cast("timestamp").alias("ts"))
    out, checkpoint = _paths(t, "suggestions")
    _in_batches(t, rows, "ts", 4, lambda suggested: jobs.stream_suggestions(suggested, out, checkpoint))
    return t.spark.read.schema("video_id bigint, ts timestamp").parquet(out).select("video_id", F.unix_micros("ts").alias("served_us"))


@query("x6_stream_failures", FAILURE_ROWS_SQL)
def _failures(t: Tables):
    out, checkpoint = _paths(t, "failures")
    jobs.stream_failures(failure_stream(_stream(t, "events")), out, checkpoint).awaitTermination()
    return t.spark.read.schema("source string, label string, video_id string, status string, reason string, detail string, title string, artist string, song_id string").parquet(out).withColumn(
        "event_id", F.col("video_id").cast("bigint")).drop("video_id")
