"""Library totals, histograms, distributions and correlations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tunefathom import fixed_values as fv
from tunefathom.plans.shapes import one_row, rounded, top_n


def song_count(songs: DataFrame) -> DataFrame:
    return songs.agg(F.count("*").alias("songs"))


def library_totals(songs: DataFrame, artist: str = "artist", bpm: str = "bpm", duration: str = "duration_seconds") -> DataFrame:
    """Songs, artists (all without one count as "Unknown"), means and hours.

    Songs are first summed per artist, so the distinct count needs no second copy of the rows.
    """
    per_artist = songs.groupBy(F.coalesce(F.col(artist), F.lit("Unknown")).alias("_artist")).agg(
        F.count("*").alias("_n"), F.sum(bpm).alias("_bpm"), F.count(bpm).alias("_bpm_n"),
        F.sum(duration).alias("_dur"), F.count(duration).alias("_dur_n"))
    return per_artist.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("songs"), F.count("*").alias("artists"),
        F.try_divide(F.sum("_bpm"), F.sum("_bpm_n")).alias("mean_bpm"),
        F.try_divide(F.sum("_dur"), F.sum("_dur_n")).alias("mean_duration"),
        (F.coalesce(F.sum("_dur"), F.lit(0.0)) / 3600).alias("hours"))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width bins over the value range; the maximum falls in the last bin, empty bins stay."""
    rows = df.filter(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("_v"))
    limits = one_row(rows.agg(F.min("_v").alias("lo"), F.max("_v").alias("hi")))
    lo = F.col("_s.lo")
    step = F.when(F.col("_s.hi") == lo, F.lit(1.0)).otherwise((F.col("_s.hi") - lo) / bins)
    counts = rows.withColumn("_s", limits).groupBy(
        F.least(F.floor((F.col("_v") - lo) / step), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).withColumn("_s", limits)
    return frame.join(counts, "bin", "left").select(
        "bin", (lo + F.col("bin") * step).alias("low"), (lo + (F.col("bin") + 1) * step).alias("high"),
        F.coalesce("n", F.lit(0)).alias("n")).filter(F.col("low").isNotNull())


def unit_histogram(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """Counts in fixed bins on 0-1; empty bins stay."""
    v = F.col(value)
    index = F.greatest(F.lit(0), F.least(F.floor(v * bins), F.lit(bins - 1))).cast("int")
    counts = df.filter(v.isNotNull()).groupBy(index.alias("bin")).agg(F.count("*").alias("n"))
    return df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").select(
        "bin", F.coalesce("n", F.lit(0)).alias("n"))


def key_distribution(songs: DataFrame, key: str = "key", keys: list[str] = fv.PITCH_CLASSES) -> DataFrame:
    """Songs per key in the fixed order, keys without songs included."""
    counts = songs.filter(F.col(key).isin(keys)).groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"))
    frame = songs.sparkSession.range(len(keys)).select(
        F.col("id").cast("int").alias("position"), F.get(F.array(*[F.lit(k) for k in keys]), F.col("id").cast("int")).alias("key"))
    return frame.join(counts, "key", "left").select("position", "key", F.coalesce("n", F.lit(0)).alias("n"))


def share_distribution(songs: DataFrame, value: str) -> DataFrame:
    """Count of each value and its share of all songs that have one."""
    counts = songs.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    total = one_row(songs.agg(F.count(value).alias("total")))
    return counts.withColumn("_t", total).select(value, "n", (F.col("n") / F.col("_t.total")).alias("share"))


def value_counts(df: DataFrame, value: str) -> DataFrame:
    return df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n")).orderBy(F.desc("n"), value)


def release_years(songs: DataFrame, year: str = "year") -> DataFrame:
    """Songs per year from the first to the last one, years without songs as 0."""
    counts = songs.filter(F.col(year).isNotNull()).groupBy(F.col(year).alias("year")).agg(F.count("*").alias("n"))
    span = counts.agg(F.min("year").alias("lo"), F.max("year").alias("hi")).filter(F.col("lo").isNotNull())
    years = span.select(F.explode(F.sequence("lo", "hi")).alias("year"))
    return years.join(counts, "year", "left").select("year", F.coalesce("n", F.lit(0)).alias("n"))


def top_artists(songs: DataFrame, n: int = 15, artist: str = "artist") -> DataFrame:
    name = F.coalesce(F.col(artist), F.lit("Unknown"))
    return songs.groupBy(name.alias("artist")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "artist").limit(n)


def detail_of(label: Column) -> Column:
    """Detailed part of a "Parent---Detail" label."""
    return F.substring_index(label, "---", -1)


def genre_counts(labels: DataFrame, per_song: int, detailed: bool = False, song: str = "song_id", label: str = "label", score: str = "score") -> DataFrame:
    """How often each genre is among a song's first ``per_song``; prefixes go after ranking."""
    best = top_n(labels, [song], [F.desc(score), F.col(label)], per_song)
    name = detail_of(F.col(label)) if detailed else F.col(label)
    return best.groupBy(name.alias("genre")).agg(F.count("*").alias("n"))


def instrument_family(name: Column) -> Column:
    low = F.lower(name)
    family = None
    for key, words in fv.INSTRUMENT_FAMILIES.items():
        if words:
            found = F.rlike(low, F.lit("|".join(words)))
            family = F.when(found, key) if family is None else family.when(found, key)
    return family.otherwise("other")


def instrument_counts(labels: DataFrame, per_song: int = 10, song: str = "song_id", label: str = "label", score: str = "score") -> DataFrame:
    """Instruments among a song's first ten, with their family; families in the fixed order, then by count."""
    best = top_n(labels, [song], [F.desc(score), F.col(label)], per_song)
    order = F.array_position(F.array(*[F.lit(k) for k in fv.INSTRUMENT_FAMILIES]), F.col("family"))
    return best.groupBy(F.col(label).alias("instrument")).agg(F.count("*").alias("n")).withColumn(
        "family", instrument_family(F.col("instrument"))).orderBy(order, F.desc("n"), "instrument")


def label_rows(labels: DataFrame, per_song: int, rows: int = 25, bins: int = 20, song: str = "song_id", label: str = "label", score: str = "score") -> DataFrame:
    """Score histogram, over all songs having them, of the labels most often in a song's first ``per_song``."""
    best = top_n(labels, [song], [F.desc(score), F.col(label)], per_song)
    chosen = best.groupBy(label).agg(F.count("*").alias("top_count")).orderBy(F.desc("top_count"), label).limit(rows)
    index = F.greatest(F.lit(0), F.least(F.floor(F.col(score) * bins), F.lit(bins - 1))).cast("int")
    counts = labels.groupBy(label, index.alias("bin")).agg(F.count("*").alias("n"))
    # ``chosen`` has at most ``rows`` rows
    return counts.join(F.broadcast(chosen), label).select(label, "top_count", "bin", "n")


def axis_stats(songs: DataFrame, axes: list[str]) -> DataFrame:
    """One row per axis with its range, (0, 1) without values; all axes in one pass."""
    wide = songs.agg(*[f(a).cast("double").alias(f"{p}{i}") for i, a in enumerate(axes) for p, f in (("lo", F.min), ("hi", F.max))])
    entries = F.array(*[F.struct(
        F.lit(a).alias("axis"), F.coalesce(F.col(f"lo{i}"), F.lit(0.0)).alias("low"), F.coalesce(F.col(f"hi{i}"), F.lit(1.0)).alias("high"),
    ) for i, a in enumerate(axes)])
    return wide.select(F.inline(entries))


def axis_stats_row(songs: DataFrame, axes: list[str]) -> Column:
    """The same ranges as one struct column ``{axis: {lo, hi}}`` for normalising."""
    return one_row(songs.agg(*[F.struct(
        F.coalesce(F.min(a).cast("double"), F.lit(0.0)).alias("lo"), F.coalesce(F.max(a).cast("double"), F.lit(1.0)).alias("hi")).alias(a) for a in axes]))


def mean_profile(songs: DataFrame, axes: dict[str, Column]) -> DataFrame:
    """Mean normalised value per axis; axes without values are absent."""
    wide = songs.select(*[c.alias(a) for a, c in axes.items()]).agg(*[F.avg(a).alias(a) for a in axes])
    entries = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("mean")) for a in axes])
    return wide.select(F.inline(entries)).filter(F.col("mean").isNotNull())


_MOMENTS = ["n", "sx", "sy", "sxx", "syy", "sxy"]


def correlations(songs: DataFrame, features: list[str] = fv.CORRELATION_FEATURES, zero_is_missing: tuple[str, ...] = ("playcount", "listeners")) -> DataFrame:
    """Pearson coefficient of every feature pair over the songs having both, rounded to three digits.

    Every record batch is reduced to one matrix of pair moments where it is read, so the shuffle carries
    features² sums per batch instead of the songs. Values are shifted by the feature's minimum, which keeps
    the sums well-conditioned and a constant feature at exactly zero variance.
    """
    values = songs.select(*[
        (F.nullif(F.col(f).cast("double"), F.lit(0.0)) if f in zero_is_missing else F.col(f).cast("double")).alias(f) for f in features])
    first = values.agg(F.count("*").alias("_n"), *[F.count(f).alias(f"_c_{f}") for f in features], *[F.min(f).alias(f"_m_{f}") for f in features]).first()
    enough = max(2, first["_n"] // 3)
    kept = [f for f in features if first[f"_c_{f}"] >= enough]
    shift = np.array([first[f"_m_{f}"] for f in kept])

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(_MOMENTS), len(kept), len(kept)))
        for batch in batches:
            x = batch.to_numpy(dtype=float) - shift
            there = ~np.isnan(x)
            x, v = np.where(there, x, 0.0), there.astype(float)
            total += np.stack([v.T @ v, x.T @ v, v.T @ x, (x * x).T @ v, v.T @ (x * x), x.T @ x])
        rows = [(kept[i], kept[j], *total[:, i, j]) for i in range(len(kept)) for j in range(len(kept))]
        yield pd.DataFrame(rows, columns=["feature_x", "feature_y", *_MOMENTS])

    schema = "feature_x string, feature_y string, " + ", ".join(f"{m} double" for m in _MOMENTS)
    if not kept:
        return songs.sparkSession.createDataFrame([], "feature_x string, feature_y string, r double")
    sums = values.select(*kept).mapInPandas(moments, schema).groupBy("feature_x", "feature_y").agg(
        *[F.sum(m).alias(m) for m in _MOMENTS])
    n = F.col("n")
    vx = F.col("sxx") - F.try_divide(F.col("sx") * F.col("sx"), n)
    vy = F.col("syy") - F.try_divide(F.col("sy") * F.col("sy"), n)
    cov = F.col("sxy") - F.try_divide(F.col("sx") * F.col("sy"), n)
    # below this share of the raw sum of squares a variance is rounding noise of a constant
    noise = 1e-13
    defined = (n >= 2) & (vx > F.col("sxx") * noise) & (vy > F.col("syy") * noise)
    r = F.when(defined, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(cov, F.sqrt(vx) * F.sqrt(vy)))))
    return sums.select("feature_x", "feature_y", rounded(r, 3).alias("r"))


def genre_legend(points: DataFrame, genre: str = "top_genre") -> DataFrame:
    return value_counts(points, genre)


def upload_summary(results: DataFrame, status: str = "status") -> DataFrame:
    return results.agg(*[F.count_if(F.col(status) == s).alias(s) for s in ("saved", "skipped", "error")])
