"""Incremental jobs as structured streams.

Every start function returns the running query; the caller chooses the trigger. Output and checkpoint paths belong
below the cluster's shared folder. Batches are written under their batch id, so a batch that is run again after
a failure replaces its own output instead of adding to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from tunefathom.operators.features import CELL_ROWS, PIVOT_BYTES, CellIndex, apply_map, balls, knn_of_new, pivots_of, songs_in_cells, standardise, stored_cells
from tunefathom.operators.playlists import upsert_links
from tunefathom.plans.shapes import Chunker, even_chunks, previous_value, top_n
from tunefathom.sources.library import failure_rows
from tunefathom.session import settled
from tunefathom.streaming.runs import add_run, live_runs

AVAILABLE_NOW = {"availableNow": True}
#: Parts that the ids and the cells of added songs lie in; the stored runs depend on it.
PARTS = 32


def _batch_path(path: str, batch_id: int) -> str:
    return f"{path}/batch={batch_id}"


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def written(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """Everything the batches of a stream have written so far; only batches before ``before`` where given.

    A batch that is run again must not see its own earlier output.
    """
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, batch bigint").parquet(path)
    return (rows if before is None else rows.filter(F.col("batch") < before)).drop("batch")


def _start(stream: DataFrame, each, checkpoint: str, trigger: dict) -> StreamingQuery:
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def stream_failures(results: DataFrame, path: str, checkpoint: str, trigger: dict = AVAILABLE_NOW) -> StreamingQuery:
    """Append categorised failures as they come in; the file sink commits each batch once."""
    return failure_rows(results).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**trigger).start()


class _FirstRow(StatefulProcessor):
    """Passes the first row of every key: of several in a batch the one that sorts first by ``order``."""

    def __init__(self, order: list[str]) -> None:
        self.order = order

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", StructType([StructField("times", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known, best = self.seen.exists(), None
        for batch in rows:
            if not known and len(batch):  # a key of the initial state alone comes with no rows
                best = pd.concat([best, batch]).sort_values(self.order, kind="stable").head(1)
        if best is not None:
            self.seen.update((1,))
            yield best

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        if not self.seen.exists():
            self.seen.update((1,))

    def close(self) -> None:
        pass


def first_of(stream: DataFrame, key: str, order: list[str], known: DataFrame) -> DataFrame:
    """The first row of every key of a stream that ``known`` (a table with the same key) does not have.

    What has been seen is one value per key in the stream's own state, so no batch reads what was written before.
    """
    seen = known.select(F.col(key).cast(stream.schema[key].dataType).alias(key)).filter(F.col(key).isNotNull()).distinct().groupBy(key)
    rows = stream.select(key, *[c for c in stream.columns if c != key])
    return rows.groupBy(key).transformWithStateInPandas(_FirstRow(order), rows.schema, "Append", "None", initialState=seen)


def stream_add_songs(
    new: DataFrame, library: DataFrame, statistics: DataFrame, model: dict, keys: list[str], map_path: str, edge_path: str,
    checkpoint: str, k: int = 10, song: str = "song_id", trigger: dict = AVAILABLE_NOW, cell_rows: int = CELL_ROWS,
) -> StreamingQuery:
    """New songs enter the stored feature space; their neighbours among the library and earlier arrivals are written.

    ``library``: song_id, features (standardised by the same statistics). Of a song that comes several times the first
    batch counts, and in it the row whose columns sort first; songs of the library are left out. What the stream has seen
    lies in runs beside the map: ids by parts of their hash (``<map_path>-ids``), of which a batch reads those that its own
    ids fall into, and vectors in cells around pivots (``<map_path>-cells``, ``-pivots``, ``-balls``): a batch is compared with the
    cells its songs fall into, and then only with those whose ball comes within the reach found there. Pivots are songs of the
    library and one of ``cell_rows`` arrivals, by the hash of its id, so that arrivals unlike the library get cells of their own.
    """
    spark = library.sparkSession
    ids, store, centres, extents = (f"{map_path}-{name}" for name in ("ids", "cells", "pivots", "balls"))
    id_type, new_type = dict(library.dtypes)[song], dict(new.dtypes)[song]
    statistics = settled(statistics, "statistics")  # a row: no batch reads the library for it
    part = F.pmod(F.xxhash64(song), F.lit(PARTS)).cast("int").alias("_part")
    def live(path: str, schema: str, batch_id: int) -> DataFrame:
        return reduce(DataFrame.unionByName, [spark.read.schema(schema).parquet(run) for run in live_runs(spark, path, batch_id)])

    def keep(batch_id: int, placed: DataFrame, pivots: np.ndarray, known: int) -> None:
        cell = F.pmod("_cell", F.lit(PARTS)).alias("_part")
        add_run(spark, store, batch_id, placed.select("_rep", "_vec", "_cell", cell), None, by="_part", order=["_cell", "_rep"])
        add_run(spark, extents, batch_id, balls(placed), lambda rows: rows.groupBy("_cell").agg(F.max("_far").alias("_far"), F.sum("_n").alias("_n")))
        rows = pd.DataFrame({"_cell": range(known, known + len(pivots)), "_vec": list(pivots)})
        add_run(spark, centres, batch_id, spark.createDataFrame(rows, "_cell int, _vec array<double>"), None)

    def keep_ids(batch_id: int, songs: DataFrame) -> None:
        add_run(spark, ids, batch_id, songs.select(song, part), None, by="_part", order=[song])

    if not all(live_runs(spark, path) for path in (store, extents, centres)):
        first = pivots_of(library.select(F.col(song).alias("_rep"), F.col("features").alias("_vec")), cell_rows)
        keep(-1, settled(songs_in_cells(library, CellIndex.of(first), song), "library-cells"), first, 0)
    if not live_runs(spark, ids):
        keep_ids(-1, library.filter(F.col(song).isNotNull()).select(F.col(song).cast(new_type)))

    def in_cells(batch_id: int, cells: list[int]) -> DataFrame:
        rows = live(store, f"_rep {id_type}, _vec array<double>, _cell int, _part int", batch_id)
        return rows.filter(F.col("_part").isin(sorted({c % PARTS for c in cells})) & F.col("_cell").isin(cells)).drop("_part")

    def pivots_before(batch_id: int) -> np.ndarray:
        rows = live(centres, "_cell int, _vec array<double>", batch_id).collect()  # PIVOT_BYTES at most
        return np.array([r["_vec"] for r in sorted(rows, key=lambda r: r["_cell"])], dtype=float)

    def pivots_among(vectors: DataFrame, known: np.ndarray) -> np.ndarray:
        rate, room = max(cell_rows, int(np.sqrt(vectors.count()))), max(0, PIVOT_BYTES // (8 * known.shape[1]) - len(known))
        drawn = vectors.filter(F.pmod(F.xxhash64(song), F.lit(rate)) == 0).orderBy(F.xxhash64(song), song).limit(room).select("features").collect()
        return np.array([r["features"] for r in drawn], dtype=float).reshape(-1, known.shape[1])

    def unseen(batch: DataFrame, batch_id: int) -> DataFrame:
        order = [F.col(c).asc_nulls_last() for c in batch.columns if c != song]
        first = settled(top_n(batch.filter(F.col(song).isNotNull()), [song], order or [song], 1, "_first").drop("_first"), "first-arrivals")
        parts = [r["_part"] for r in first.select(part).distinct().collect()]
        known = live(ids, f"{song} {new_type}, _part int", batch_id).filter(F.col("_part").isin(parts))
        return settled(first.join(known.select(song), song, "left_anti"), "arrivals")

    def add(batch: DataFrame, batch_id: int) -> None:
        vectors = settled(standardise(unseen(batch, batch_id), keys, statistics, song=song), "arrival-vectors")
        vectors.join(apply_map(vectors, model, song), song).write.mode("overwrite").parquet(_batch_path(map_path, batch_id))
        known = pivots_before(batch_id)
        drawn = pivots_among(vectors, known)
        index = CellIndex.of(np.concatenate([known, drawn]), even=True)
        here = settled(songs_in_cells(vectors.withColumn(song, F.col(song).cast(id_type)), index, song), "arrival-cells")
        cells = stored_cells(index, live(extents, "_cell int, _far double, _n bigint", batch_id), lambda wanted: in_cells(batch_id, wanted))
        near = knn_of_new(here.select(F.col("_rep").alias(song), F.col("_vec").alias("features")), cells, k, song)
        near.write.mode("overwrite").parquet(_batch_path(edge_path, batch_id))
        keep(batch_id, here, drawn, len(known))
        keep_ids(batch_id, vectors)

    return _start(new, add, checkpoint, trigger)


STAGE_VIEW = "job_id bigint, stage string, stage_since timestamp, last_update timestamp"
FINISHED = "finished"
#: How long, in event time, a finished job is remembered, so that updates that come late do not bring it back.
REMEMBERED = "1 day"


def merge_stages(view: DataFrame, updates: DataFrame, chunk: Chunker | None = None, remembered: str = REMEMBERED) -> DataFrame:
    """A stage view (STAGE_VIEW) brought forward by a batch of updates (job_id, stage, ts).

    The batch is first reduced to one row per job: its first and last stage and its last change. An update
    that repeats the known stage keeps the known start; one older than what is known of its job is left out.
    Finished jobs stay in the view until ``remembered`` before the newest update.
    """
    chunk = even_chunks(updates, "ts") if chunk is None else chunk
    timely = updates.filter(F.col("stage").isNotNull()).select("job_id", "stage", "ts").join(
        view.select("job_id", F.col("last_update").alias("_known")), "job_id", "left").filter(F.col("_known").isNull() | (F.col("ts") >= F.col("_known")))
    rows = previous_value(timely.drop("_known"), ["job_id"], "ts", chunk, "stage", "_before")
    changed = F.col("_before").isNotNull() & (F.col("stage") != F.col("_before"))
    jobs = rows.groupBy("job_id").agg(
        F.min_by("stage", "ts").alias("_first"), F.min("ts").alias("_start"), F.max_by("stage", "ts").alias("_stage"),
        F.max(F.when(changed, F.col("ts"))).alias("_change"), F.max("ts").alias("_last"))
    both = view.join(jobs, "job_id", "full")
    since = F.coalesce("_change", F.when(F.col("_first") == F.col("stage"), F.col("stage_since")), "_start")
    touched = F.col("_stage").isNotNull()
    merged = both.select(
        "job_id", F.when(touched, F.col("_stage")).otherwise(F.col("stage")).alias("stage"), F.when(touched, since).otherwise(F.col("stage_since")).alias("stage_since"),
        F.coalesce("_last", "last_update").alias("last_update"))
    newest = updates.select(F.col("ts").alias("t")).unionByName(view.select(F.col("last_update").alias("t"))).agg(F.max("t")).scalar()
    return merged.filter((F.col("stage") != FINISHED) | (F.col("last_update") >= newest - F.expr(f"interval {remembered}")))


def _newest_batch(spark: SparkSession, path: str, before: int | None = None) -> int | None:
    """The highest batch (below ``before``) that a stream has written whole, from the folders and not from their rows."""
    if not _exists(spark, path):
        return None
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [f.getPath().getName() for f in target.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(target)]
    numbers = [int(n.removeprefix("batch=")) for n in names if n.startswith("batch=") and _exists(spark, f"{path}/{n}/_SUCCESS")]
    return max((n for n in numbers if before is None or n < before), default=None)


def _stage_view(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    batch = _newest_batch(spark, path, before)
    return spark.createDataFrame([], STAGE_VIEW) if batch is None else spark.read.schema(STAGE_VIEW).parquet(_batch_path(path, batch))


def stream_job_stage(updates: DataFrame, path: str, checkpoint: str, trigger: dict = AVAILABLE_NOW) -> StreamingQuery:
    """Latest stage per job: each batch writes the view as it then stands; read it with :func:`current_stages`.

    ``updates``: job_id, stage, ts. Only the view of the batch before is read: running jobs and those finished lately.
    """
    def advance(batch: DataFrame, batch_id: int) -> None:
        batch = settled(batch, "stage-updates")
        merge_stages(_stage_view(batch.sparkSession, path, batch_id), batch).write.mode("overwrite").parquet(_batch_path(path, batch_id))

    return _start(updates, advance, checkpoint, trigger)


def current_stages(spark: SparkSession, path: str) -> DataFrame:
    """The running jobs of the newest view a stage stream has written."""
    return _stage_view(spark, path).filter(F.col("stage") != FINISHED)


def stream_dedup_songs(arrivals: DataFrame, library: DataFrame, path: str, checkpoint: str, trigger: dict = AVAILABLE_NOW) -> StreamingQuery:
    """First arrival of a song wins, then the first of these with a recording, against the library and all arrivals before.

    ``arrivals``: song_id, recording_id, ts. ``library``: song_id, recording_id. What has been seen is state of the
    stream, one value per song and one per recording; of several arrivals in one batch the earliest ``ts`` counts. A song
    without a recording stands for itself. Read the result with :func:`written`.
    """
    key = F.coalesce(F.concat(F.lit("recording "), F.col("recording_id").cast("string")), F.concat(F.lit("song "), F.col("song_id").cast("string")))
    songs = first_of(arrivals.select("song_id", "recording_id", "ts"), "song_id", ["ts", "recording_id"], library)
    known = library.filter(F.col("recording_id").isNotNull()).withColumn("entity", key)
    fresh = first_of(songs.withColumn("entity", key), "entity", ["ts", "song_id"], known).select("song_id", "recording_id")
    return fresh.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _lowest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("playlist_id", "song_id").agg(F.min("position").alias("position"))


def stream_playlist_links(results: DataFrame, links: DataFrame, songs: DataFrame, path: str, checkpoint: str, trigger: dict = AVAILABLE_NOW, fan: int = 8) -> StreamingQuery:
    """Link songs as results arrive (playlist_id, song_id, position); read the merged links with :func:`current_links`.

    Each batch is a run; ``fan`` runs of a level are merged by key into one of the next, so a reader opens fewer than
    ``fan`` runs per level, and there are as many levels as ``fan`` goes into the batches by powers.
    """
    def add(batch: DataFrame, batch_id: int) -> None:
        add_run(batch.sparkSession, path, batch_id, upsert_links(links.limit(0), batch, songs), _lowest, fan)
    return _start(results, add, checkpoint, trigger)


def current_links(spark: SparkSession, path: str, links: DataFrame) -> DataFrame:
    """Stored links merged with the stream's: the smallest position wins."""
    columns = ["playlist_id", "song_id", "position"]
    types = dict(links.dtypes)
    runs = live_runs(spark, path)
    stored = links.select(*columns)
    return _lowest(stored.unionByName(spark.read.schema(", ".join(f"{c} {types[c]}" for c in columns)).parquet(*runs)) if runs else stored)


class _NotLately(StatefulProcessor):
    """Passes a key's rows that lie at least ``memory`` after the last one passed; forgets the key by a timer."""

    def __init__(self, memory: pd.Timedelta) -> None:
        self.memory = memory // pd.Timedelta(1, "us")

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", StructType([StructField("us", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = np.sort(np.concatenate([batch["ts"].to_numpy().astype("datetime64[us]").astype(np.int64) for batch in rows if len(batch)] or [[]]).astype(np.int64))
        last, passed = self.last.get()[0] if self.last.exists() else None, []
        at = 0
        while at < len(times):
            if last is None or times[at] >= last + self.memory:
                last = int(times[at])
                passed.append(last)
            at = max(at + 1, int(np.searchsorted(times, last + self.memory)))
        if passed:
            self.last.update((last,))
            # event time has millisecond timers; the next one after the memory ends
            self.handle.registerTimer(-(-(last + self.memory) // 1000))
            yield pd.DataFrame({"video_id": [key[0]] * len(passed), "ts": pd.to_datetime(passed, unit="us")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists() and self.last.get()[0] + self.memory <= expiredTimerInfo.getExpiryTimeInMs() * 1000:
            self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_suggestions(suggestions: DataFrame, path: str, checkpoint: str, memory: str = "6 hours", lateness: str = "1 hour", trigger: dict = AVAILABLE_NOW) -> StreamingQuery:
    """Never repeat an id within ``memory`` of event time after it was last served. ``suggestions``: video_id, ts.

    An id comes back with its first suggestion at or after that, whatever the batches are: the rule is kept per id in
    the stream's state, which a timer of event time forgets. Suggestions that come ``lateness`` behind the newest are
    left out.
    """
    timed = suggestions.select("video_id", "ts").withWatermark("ts", lateness)
    fresh = timed.groupBy("video_id").transformWithStateInPandas(_NotLately(pd.Timedelta(memory)), timed.schema, "Append", "EventTime")
    return fresh.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**trigger).start()
