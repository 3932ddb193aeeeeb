"""Per-song value series: resampling jobs, envelopes over songs, overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tunefathom import fixed_values as fv
from tunefathom.functions import numeric as nu
from tunefathom.operators.filters import is_valid_series
from tunefathom.plans.shapes import exact_quantiles, one_row
from tunefathom.session import settled

MODES = ("relative", "absolute")


def timebase(feature: str) -> tuple[float, float]:
    if feature not in fv.FEATURE_FAMILY:
        raise ValueError(f"no time base for feature {feature!r}, known: {sorted(fv.FEATURE_FAMILY)}")
    return fv.TIMEBASES[fv.FEATURE_FAMILY[feature]]


def resampled(values: Column, duration: Column, feature: str, mode: str) -> Column:
    """The song's values on the relative (100 points) or absolute (whole seconds) grid."""
    hop, window = timebase(feature)
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    values = nu.floor_values(values) if feature == "loudness" else values
    grid = nu.resample_relative if mode == "relative" else nu.resample_absolute
    return grid(values, duration, hop, window)


def resample_long(songs: DataFrame, feature: str, mode: str, values: str = "values", duration: str = "duration_seconds", song: str = "song_id") -> DataFrame:
    """``(song_id, position, value)`` of every usable song; narrow, nothing is shuffled."""
    # Validity is part of the expression and empty results go afterwards: a filter in front, or the one the plain
    # posexplode adds, would compute a derived series a second time.
    usable = F.when(is_valid_series(F.col(values), F.col(duration)), resampled(F.col(values), F.col(duration), feature, mode))
    return songs.select(song, F.posexplode_outer(usable).alias("position", "value")).filter(F.col("position").isNotNull())


def with_centres(songs: DataFrame, feature: str, values: str = "values", song: str = "song_id") -> DataFrame:
    """Every stored value with the time it stands for."""
    hop, window = timebase(feature)
    return songs.select(song, F.posexplode(values).alias("idx", "value")).withColumn(
        "seconds", F.col("idx") * F.lit(hop) + F.lit(window / 2))


def envelope(points: DataFrame, min_songs: int = fv.MIN_SERIES_SONGS, position: str = "position", value: str = "value") -> DataFrame:
    """Mean, quartiles and count per grid position; values are null below ``min_songs`` songs."""
    rows = exact_quantiles(points, [position], value, [0.25, 0.75], also=[F.avg(value).alias("mean")])
    enough = F.col("n") >= min_songs
    return rows.select(
        position, F.when(enough, F.col("mean")).alias("mean"), F.when(enough, F.col("q0")).alias("p25"),
        F.when(enough, F.col("q1")).alias("p75"), F.col("n").alias("songs"))


def timeseries_envelope(songs: DataFrame, feature: str, mode: str, values: str = "values", duration: str = "duration_seconds", song: str = "song_id") -> DataFrame:
    """The envelope of a library. The grid points are settled, as the quantiles read them twice and they are
    far smaller and cheaper than the series they come from."""
    return envelope(settled(resample_long(songs, feature, mode, values, duration, song).select("position", "value"), "grid-points"))


def normalise_envelope(env: DataFrame) -> DataFrame:
    """One min-max over the three curves together; a constant envelope is 0.5, missing points stay missing."""
    limits = one_row(env.agg(F.min(F.least("mean", "p25", "p75")).alias("lo"), F.max(F.greatest("mean", "p25", "p75")).alias("hi")))
    lo, hi = F.col("_s.lo"), F.col("_s.hi")

    def scaled(c: str) -> Column:
        return F.when(F.col(c).isNull(), F.lit(None).cast("double")).when(hi == lo, F.lit(fv.CONSTANT_LEVEL)).otherwise(
            F.try_divide(F.col(c) - lo, hi - lo)).alias(c)
    return env.withColumn("_s", limits).select("position", scaled("mean"), scaled("p25"), scaled("p75"), "songs")


def overlay_songs(songs: DataFrame, ids: list, song: str = "song_id") -> DataFrame:
    """At most three distinct requested songs, in request order; other filters do not apply to them."""
    wanted = list(dict.fromkeys(ids))
    if len(wanted) > 3:
        raise ValueError("at most three overlay songs")
    order = F.array_position(F.array(*[F.lit(i) for i in wanted]), F.col(song)) if wanted else F.lit(0)
    return songs.filter(F.col(song).isin(wanted)).withColumn("overlay", order.cast("int")).orderBy("overlay")


def chart_rows(env: DataFrame, overlays: DataFrame) -> DataFrame:
    """Envelope and up to three overlays on one gapless axis; the band exists only with both quartiles.

    ``overlays``: (overlay 1..3, position, value). The axis is as long as the longest series; ``songs`` is how many songs
    have a value there, 0 where none has.
    """
    curves = overlays.groupBy("position").agg(*[F.max(F.when(F.col("overlay") == i, F.col("value"))).alias(f"overlay_{i}") for i in (1, 2, 3)])
    last = env.select("position").unionByName(overlays.select("position")).agg(F.max("position").alias("last")).filter(F.col("last").isNotNull())
    axis = last.select(F.explode(F.sequence(F.lit(0), F.col("last"))).alias("position"))
    band = F.col("p25").isNotNull() & F.col("p75").isNotNull()
    return axis.join(env, "position", "left").join(curves, "position", "left").select(
        "position", "mean", F.when(band, F.col("p25")).alias("band_low"), F.when(band, F.col("p75")).alias("band_high"), F.coalesce("songs", F.lit(0)).alias("songs"),
        "overlay_1", "overlay_2", "overlay_3")
