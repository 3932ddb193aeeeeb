"""Ranking, neighbours in ordered lists, sorting, sampling and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tunefathom import fixed_values as fv
from tunefathom.plans.shapes import Chunker, even_chunks, neighbour_values, previous_value, top_n
from tunefathom.session import settled


def ranked_moods(moods: list[str] = fv.MOODS) -> Column:
    """The song's moods by score, highest first, ties in the fixed mood order; missing scores are skipped."""
    entries = F.array(*[F.struct((-F.col(m)).alias("key"), F.lit(i).alias("position"), F.lit(m).alias("mood"), F.col(m).alias("score"))
                        for i, m in enumerate(moods)])
    return F.transform(F.array_sort(F.filter(entries, lambda e: e["score"].isNotNull())), lambda e: F.struct(e["mood"], e["score"]))


def dominant_mood(moods: list[str] = fv.MOODS) -> Column:
    return F.get(ranked_moods(moods), F.lit(0))["mood"]


def top_genre(labels: DataFrame, song: str = "song_id", label: str = "label", score: str = "score", position: str | None = None) -> DataFrame:
    """Largest share per song; the first one wins a tie (by ``position``, else by name). One partial aggregate."""
    tie = F.col(position) if position else F.col(label)
    first = F.min_by(F.struct(F.col(label).alias("top_genre"), F.col(score).alias("share")), F.struct((-F.col(score)).alias("a"), tie.alias("b")))
    return labels.filter(F.col(score).isNotNull()).groupBy(song).agg(first.alias("_f")).select(song, "_f.*")


def queue_moves(queue: DataFrame, list_id: str, position: str, item: str, chunk: Chunker | None = None) -> DataFrame:
    """Next and previous item of every queue position, wrapping around; positions may have gaps but not repeat.

    Neighbours are carried from chunk to chunk of the positions, so one endless queue still spreads over all tasks.
    """
    chunk = even_chunks(queue, position) if chunk is None else chunk
    both = neighbour_values(queue, [list_id], position, chunk, item)
    return both.select(*queue.columns, F.coalesce("_after", "_first").alias("next_item"), F.coalesce("_before", "_last").alias("previous_item"))


def start_of_queue(queue: DataFrame, list_id: str, position: str, item: str) -> DataFrame:
    """Where an unknown current item leads: next is the first item, previous the last."""
    return queue.groupBy(list_id).agg(F.min_by(item, position).alias("next_item"), F.max_by(item, position).alias("previous_item"))


def next_neighbour(plays: DataFrame, edges: DataFrame, session: str = "session_id", song: str = "song_id", order: str = "played_at", memory: int = 10) -> DataFrame:
    """Per session the closest neighbour of the current song outside its last ``memory`` distinct plays; else the closest.

    ``edges``: (song_id, rank, neighbor_id) with at most k rows per song.
    """
    latest = plays.groupBy(session, song).agg(F.max(order).alias("_at"))
    recent = top_n(latest, [session], [F.desc("_at"), F.desc(song)], memory, "_r")
    current = recent.filter("_r = 1").select(session, F.col(song).alias("current_id"))
    options = current.join(edges, current["current_id"] == edges[song]).select(session, "current_id", "rank", "neighbor_id")
    marked = options.join(recent.select(session, F.col(song).alias("neighbor_id"), F.lit(True).alias("_played")), [session, "neighbor_id"], "left")
    choice = F.min_by("neighbor_id", F.struct(F.coalesce("_played", F.lit(False)).alias("p"), F.col("rank").alias("r")))
    return marked.groupBy(session, "current_id").agg(choice.alias("next_id"))


def stage_since(updates: DataFrame, job: str = "job_id", stage: str = "stage", at: str = "ts", chunk: Chunker | None = None) -> DataFrame:
    """Current stage per job and when it began: the last update whose stage differs from the one before."""
    chunk = even_chunks(updates, at) if chunk is None else chunk
    steps = previous_value(updates.filter(F.col(stage).isNotNull()).select(job, stage, at), [job], at, chunk, stage, "_before")
    changed = ~F.col(stage).eqNullSafe(F.col("_before"))
    return steps.groupBy(job).agg(
        F.max_by(stage, at).alias("stage"), F.max(F.when(changed, F.col(at))).alias("stage_since"), F.max(at).alias("last_update"))


def stage_order(stage: Column, stages: list[str] = fv.JOB_STAGES) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in stages]), stage)


def latest_per(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """The row with the highest ``order`` in each group, as one partial aggregate."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(*by, "_r.*")


def sort_songs(songs: DataFrame, column: str, descending: bool = False, tie: str = "song_id", collation: str | None = None) -> DataFrame:
    """Missing values last in both directions; text by the given collation."""
    key = F.collate(F.col(column), collation) if collation else F.col(column)
    return songs.orderBy(F.desc_nulls_last(key) if descending else F.asc_nulls_last(key), tie)


def sorted_places(songs: DataFrame, column: str, descending: bool = False, tie: str = "song_id", collation: str | None = None) -> DataFrame:
    """The order of :func:`sort_songs` as a ``place`` (1, 2, ...) of every row."""
    key = F.collate(F.col(column), collation) if collation else F.col(column)
    sort = settled(songs, "songs").repartitionByRange(F.col(column).isNull(), F.desc(key) if descending else F.asc(key), tie)
    order = [F.col(column).isNull(), F.desc(key) if descending else F.asc(key), F.col(tie)]
    placed = settled(sort.sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    slices = placed.groupBy(F.shiftright("_at", 33).alias("_slice")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    shifts = slices.select("_slice", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    both = placed.withColumn("_slice", F.shiftright("_at", 33)).join(F.broadcast(shifts), "_slice")
    return both.select(*songs.columns, (F.col("_at") + F.col("_shift")).cast("int").alias("place"))


def page(sorted_rows: DataFrame, pages: int, size: int = 50) -> DataFrame:
    """The first ``pages`` pages of an ordered result."""
    return sorted_rows.limit(pages * size)


def random_sample(df: DataFrame, n: int, seed: int, key: str, weight: str | None = None) -> DataFrame:
    """``n`` rows drawn without replacement: those of lowest seeded hash of ``key``, the same under any partitioning.

    With ``weight`` (above 0, else never drawn) a row's chance is in proportion to it. Every task keeps ``n`` rows.
    """
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    if weight is None:
        return df.orderBy(hashed, key).limit(n)
    share = (F.conv(F.substring(hashed, 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)
    return df.filter(F.col(weight) > 0).orderBy(-F.log(share) / F.col(weight), key).limit(n)


def union_recordings(broad: DataFrame, narrow: DataFrame, query: str = "query_id", recording: str = "recording_id", total: str = "total_hits") -> DataFrame:
    """Broad hits, plus narrow ones of queries whose broad page was cut off; one row per query and recording."""
    cut = broad.groupBy(query).agg(F.count("*").alias("_n"), F.max(total).alias("_total")).filter("_total > _n").select(query)
    extra = narrow.join(cut, query, "left_semi").join(broad.select(query, recording), [query, recording], "left_anti")
    return broad.select(query, recording).unionByName(extra.select(query, recording)).dropDuplicates([query, recording])


def pool_add(pool: DataFrame, new: DataFrame, served: DataFrame, item: str = "video_id") -> DataFrame:
    """New ids neither pooled nor recently served, each once."""
    known = pool.select(item).unionByName(served.select(item))
    return new.select(item).join(known, item, "left_anti").dropDuplicates([item])


def label_top(labels: DataFrame, n: int, song: str = "song_id", label: str = "label", score: str = "score") -> DataFrame:
    return top_n(labels, [song], [F.desc(score), F.col(label)], n)
