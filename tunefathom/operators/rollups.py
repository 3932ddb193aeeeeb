"""Roll-ups of frame, patch and segment rows to songs. Inputs are long tables with an index column."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType

from tunefathom import fixed_values as fv
from tunefathom.plans.shapes import chunks_of, previous_value, rounded, top_n

# rows per window task of an ordered scan over one song
CHUNK = 65536


def seconds_from_frames(frames: DataFrame, value: str, per: int = fv.FRAMES_PER_SECOND_VALUE, song: str = "song_id", index: str = "frame_idx") -> DataFrame:
    """``(song_id, second, value)``: mean of every ``per`` frames, the last partial group included."""
    return frames.groupBy(song, F.floor(F.col(index) / per).alias("second")).agg(rounded(F.avg(value), 4).alias("value"))


def song_means_from_frames(frames: DataFrame, values: list[str], song: str = "song_id") -> DataFrame:
    return frames.groupBy(song).agg(*[rounded(F.avg(v), 4).alias(f"{v}_mean") for v in values])


def vector_mean(frames: DataFrame, vector: str, size: int, song: str = "song_id") -> DataFrame:
    """Element-wise mean of fixed-length vectors, as one pass of ``size`` averages (no explode)."""
    means = [F.avg(F.get(F.col(vector), F.lit(i)).cast("double")).alias(f"_m{i}") for i in range(size)]
    counted = frames.groupBy(song).agg(F.count(vector).alias("_n"), *means)
    return counted.select(song, F.when(F.col("_n") > 0, F.array(*[F.col(f"_m{i}") for i in range(size)])).alias(f"{vector}_mean"))


def chord_changes(frames: DataFrame, chord: str = "chord", song: str = "song_id", index: str = "frame_idx") -> DataFrame:
    """Every frame with whether its chord differs from the one before (false on the first frame)."""
    rows = previous_value(frames, [song], index, chunks_of(lambda i: F.floor(i / CHUNK)), chord, "_before")
    first = F.col("_before").isNull()
    return rows.withColumn("changed", ~first & ~F.col(chord).eqNullSafe(F.col("_before"))).drop("_before")


def chord_stats(frames: DataFrame, chord: str = "chord", strength: str = "strength", song: str = "song_id", index: str = "frame_idx") -> DataFrame:
    """Most frequent chord (first seen wins ties), mean strength, changes per frame."""
    per_chord = chord_changes(frames, chord, song, index).groupBy(song, chord).agg(
        F.count("*").alias("_n"), F.min(index).alias("_first"), F.sum(strength).alias("_s"), F.count(strength).alias("_sn"),
        F.sum(F.col("changed").cast("long")).alias("_c"))
    return per_chord.groupBy(song).agg(
        F.min_by(chord, F.struct((-F.col("_n")).alias("n"), F.col("_first").alias("f"))).alias("chord"),
        rounded(F.try_divide(F.sum("_s"), F.sum("_sn")), 4).alias("strength_mean"),
        rounded(F.sum("_c") / F.sum("_n"), 4).alias("change_rate"))


def positive_index(model: Column) -> Column:
    """Column of the class a mood model is named after: the first for four of them, else the second."""
    return F.when(model.isin(fv.POSITIVE_CLASS_FIRST), 0).otherwise(1)


def class_scores(patches: DataFrame, song: str = "song_id", model: str = "model", probs: str = "probs") -> DataFrame:
    """Mean of both classes and of the chosen one per song and model."""
    chosen = F.get(F.col(probs), positive_index(F.col(model)))
    return patches.groupBy(song, model).agg(
        rounded(F.avg(F.get(F.col(probs), F.lit(0))), 4).alias("first_mean"),
        rounded(F.avg(F.get(F.col(probs), F.lit(1))), 4).alias("second_mean"),
        rounded(F.avg(chosen), 4).alias("score"))


def class_series(patches: DataFrame, song: str = "song_id", model: str = "model", index: str = "patch_idx", probs: str = "probs") -> DataFrame:
    """The chosen class's value of every patch, in long form (rows keep their order column).

    Models that report both classes have the first one as their series.
    """
    chosen = F.when(F.col(model).isin(fv.FIRST_CLASS_SERIES), 0).otherwise(positive_index(F.col(model)))
    return patches.select(song, model, index, rounded(F.get(F.col(probs), chosen).cast("double"), 4).alias("value"))


def arousal_valence(patches: DataFrame, song: str = "song_id", pair: str = "probs") -> DataFrame:
    """Mean arousal and valence (first and second entry of a patch), as predicted."""
    return patches.groupBy(song).agg(
        rounded(F.avg(F.get(F.col(pair), F.lit(0))), 4).alias("arousal"), rounded(F.avg(F.get(F.col(pair), F.lit(1))), 4).alias("valence"))


def arousal_valence_series(patches: DataFrame, song: str = "song_id", index: str = "patch_idx", pair: str = "probs") -> DataFrame:
    """Arousal and valence of every patch, in long form."""
    return patches.select(song, index, *[rounded(F.get(F.col(pair), F.lit(i)).cast("double"), 4).alias(name) for i, name in enumerate(("arousal", "valence"))])


def class_means(patches: DataFrame, labels: list[str], song: str = "song_id", probs: str = "probs") -> DataFrame:
    """``(song_id, label, score)``: mean of every class, one pass of averages, then one row per label."""
    wide = patches.groupBy(song).agg(*[F.avg(F.get(F.col(probs), F.lit(i)).cast("double")).alias(f"_m{i}") for i in range(len(labels))])
    entries = F.array(*[F.struct(F.lit(name).alias("label"), F.col(f"_m{i}").alias("score")) for i, name in enumerate(labels)])
    return wide.select(song, F.inline(entries))


def parent_genre_shares(means: DataFrame, song: str = "song_id", label: str = "label", score: str = "score") -> DataFrame:
    """Share of every parent genre (text before ``---``) in the song's total score, from one percent up."""
    parents = means.groupBy(song, F.substring_index(label, "---", 1).alias("genre")).agg(F.sum(score).alias("_s"))
    # a song's parents are few: their sum is windowed, the means are read once
    totals = parents.withColumn("_t", F.sum("_s").over(Window.partitionBy(song)))
    share = F.try_divide(F.col("_s"), F.col("_t"))
    return totals.filter(share >= 0.01).select(song, "genre", rounded(share, 4).alias("share"))


def top_classes(means: DataFrame, n: int = 10, song: str = "song_id", label: str = "label", score: str = "score") -> DataFrame:
    return top_n(means, [song], [F.desc(score), F.col(label)], n).withColumn(score, rounded(F.col(score), 4))


def music_span(segments: DataFrame, song: str = "song_id", index: str = "idx", label: str = "label", start: str = "start", end: str = "end") -> DataFrame:
    """From the first to the last music segment, widened over directly attached noise; short edges stay.

    Three partial aggregations per song; no window has to hold a song's segments.
    """
    i = F.col(index)
    music = F.col(label) == "music"
    edges = segments.groupBy(song).agg(
        F.min(F.when(music, i)).alias("_first"), F.max(F.when(music, i)).alias("_last"),
        F.min_by(start, index).alias("_track_start"), F.max_by(end, index).alias("_track_end"))
    marked = segments.join(edges.filter(F.col("_first").isNotNull()), song)
    quiet = ~F.col(label).isin("music", "noise")
    stops = marked.groupBy(song).agg(
        F.max(F.when(quiet & (i < F.col("_first")), i)).alias("_stop_before"), F.min(F.when(quiet & (i > F.col("_last")), i)).alias("_stop_after"))
    spans = marked.join(stops, song).groupBy(song).agg(
        F.min_by(start, F.when(F.col("_stop_before").isNull() | (i > F.col("_stop_before")), i)).alias("_start"),
        F.max_by(end, F.when(F.col("_stop_after").isNull() | (i < F.col("_stop_after")), i)).alias("_end"),
        F.first("_track_start").alias("_ts"), F.first("_track_end").alias("_te"))
    return spans.select(
        song,
        F.when(F.col("_start") - F.col("_ts") < fv.MIN_CUT_SECONDS, F.col("_ts")).otherwise(F.col("_start")).alias("start"),
        F.when(F.col("_te") - F.col("_end") < fv.MIN_CUT_SECONDS, F.col("_te")).otherwise(F.col("_end")).alias("end"))


# --- chorus -----------------------------------------------------------------------

#: Starts on both sides of a tile of similarities, which stays in the processor's cache.
TILE_ROWS, TILE_COLUMNS = 128, 512

def _window_sums(values: np.ndarray, width: int) -> np.ndarray:
    total = np.concatenate([[0.0], values.cumsum()])
    return total[width:] - total[:-width]


def _diagonal_sums(products: np.ndarray, width: int) -> np.ndarray:
    """Sums of ``width`` neighbours along every diagonal: sums of 1, 2, 4, ... of them, put together as ``width`` is."""
    rows, columns = products.shape[0] - width + 1, products.shape[1] - width + 1
    total, at, size = np.zeros((rows, columns)), 0, 1
    while True:
        if width & size:
            total += products[at:at + rows, at:at + columns]
            at += size
        if at == width:
            return total
        products = products[:-size, :-size] + products[size:, size:]
        size *= 2


def _recurrence(signals: np.ndarray, width: int, inverse: np.ndarray) -> np.ndarray:
    """For every window the highest cosine with one that it does not overlap, -1 without one.

    Windows are vectors of length one; a product of two blocks of them is a tile of similarities, and one tile is all
    that is held.
    """
    starts = len(inverse)
    windows = np.lib.stride_tricks.sliding_window_view(signals, width, axis=0)[:starts].reshape(starts, -1) * inverse[:, None]
    alike = np.full(starts, -1.0)
    for low in range(0, starts - width - 1, TILE_ROWS):
        high = min(low + TILE_ROWS, starts - width - 1)
        # from the earliest window beside the first row's
        for left in range(low + width + 1, starts, TILE_COLUMNS):
            right = min(left + TILE_COLUMNS, starts)
            cosines = windows[low:high] @ windows[left:right].T
            if left - high < width:  # a later row overlaps the first of these windows
                cosines[np.arange(left, right) - np.arange(low, high)[:, None] <= width] = -1.0
            np.maximum(alike[low:high], cosines.max(axis=1), out=alike[low:high])
            np.maximum(alike[left:right], cosines.max(axis=0), out=alike[left:right])
    return alike


def _recurrence_of(signals: np.ndarray, width: int, inverse: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The same for the windows ``at`` (ascending) alone, second by second: equal sections get equal values."""
    starts, alike = len(inverse), np.full(len(inverse), -1.0)
    rest = at
    while len(rest):
        low, high = rest[0], min(rest[0] + TILE_ROWS, rest[-1] + 1)
        rest = rest[rest >= high]
        rows, of_row = np.arange(low, high)[:, None], inverse[low:high, None]
        for left in range(0, starts, TILE_COLUMNS):
            right = min(left + TILE_COLUMNS, starts)
            columns, of_column = np.arange(left, right), inverse[left:right]
            sums = _diagonal_sums(signals[low:high + width - 1] @ signals[left:right + width - 1].T, width)
            cosines = np.where(columns > rows, sums * of_column * of_row, sums * of_row * of_column)
            cosines[np.abs(columns - rows) <= width] = -1.0
            np.maximum(alike[low:high], cosines.max(axis=1), out=alike[low:high])
    return alike[at]


def _section(signals: np.ndarray, width: int) -> int:
    """Start of the window that recurs most and is loud, from standardised signals (rows are seconds)."""
    seconds = len(signals)
    starts = seconds - width
    inverse = 1 / (np.sqrt(np.maximum(_window_sums((signals**2).sum(1), width)[:starts], 0)) + fv.CHORUS_EPSILON)
    alike = _recurrence(signals, width, inverse)
    loud = signals[:, 0]
    share = (_window_sums(loud, width)[:starts] / width - loud.min()) / (loud.max() - loud.min() + fv.CHORUS_EPSILON)
    edge = max(fv.CHORUS_EDGE_SECONDS, int(seconds * fv.CHORUS_EDGE_SHARE))
    if starts - 2 * edge < 1:
        return 0
    score = fv.CHORUS_REPETITION_WEIGHT * alike + fv.CHORUS_ENERGY_WEIGHT * share
    # the products propose, sums by second decide between what lies as close as rounding
    near = edge + np.flatnonzero(score[edge:starts - edge] >= score[edge:starts - edge].max() - 1e-9)
    alike[near] = _recurrence_of(signals, width, inverse, near)
    best = int(near[(fv.CHORUS_REPETITION_WEIGHT * alike[near] + fv.CHORUS_ENERGY_WEIGHT * share[near]).argmax()])
    # the same section may come earlier; the first place counts
    if best - width > edge:
        window = signals[best:best + width]
        cosines = sum(np.correlate(signals[edge:best - 1, c], window[:, c], "valid") for c in range(signals.shape[1])) * inverse[edge:best - width] * inverse[best]
        same = np.flatnonzero(cosines >= alike[best] * fv.CHORUS_SAME_SECTION)
        if len(same):
            return edge + int(same[0])
    return best


def _chorus_start(series: list, duration: float | None) -> int | None:
    """Start second of one song's chorus; the middle of a short song, nothing of one shorter than two windows."""
    if duration is None or duration <= 0:
        return None
    width = fv.CHORUS_SECONDS
    columns = [np.asarray(s[:int(duration)], dtype=float) for s in series if s is not None and len(s)]
    length = min((len(c) for c in columns), default=0)
    if length < 2 * width:
        return None
    if length < fv.CHORUS_MIN_ANALYSABLE_SECONDS:
        return max(0, (length - width) // 2)
    signals = np.stack([(c[:length] - c[:length].mean()) / (c[:length].std() + fv.CHORUS_EPSILON) for c in columns], axis=1)
    return _section(signals, width)


def chorus_segment(songs: DataFrame, series: list[str], duration: str = "duration_seconds", song: str = "song_id") -> DataFrame:
    """``(song_id, start_seconds, length_seconds)``; the first non-empty series is the energy signal.

    A song is one row with its own series, so the job is narrow: no shuffle, one Arrow batch at a time.
    """
    @F.pandas_udf(IntegerType())
    def locate(durations: pd.Series, *columns: pd.Series) -> pd.Series:
        found = [_chorus_start(list(values), None if pd.isna(d) else float(d)) for d, *values in zip(durations, *columns)]
        return pd.Series(found, dtype="Int64")

    def usable(name: str) -> Column:
        # arrays are cut to the song's length before they leave the JVM
        cut = F.slice(F.transform(name, lambda v: v.cast("double")), 1, F.greatest(F.coalesce(F.floor(duration).cast("int"), F.lit(0)), F.lit(0)))
        return F.when(F.size(F.col(name)) > 0, cut)
    used = [usable(s) for s in series]
    shortest = F.array_min(F.array(*[F.when(F.size(c) > 0, F.size(c)) for c in used])) if len(used) > 1 else F.size(used[0])
    return songs.select(song, locate(F.col(duration), *used).alias("start_seconds"), shortest.alias("_n")).select(
        song, "start_seconds", F.when(F.col("start_seconds").isNotNull(), F.least(F.lit(fv.CHORUS_SECONDS), F.col("_n"))).alias("length_seconds"))
