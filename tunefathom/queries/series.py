"""Per-song series: documents are songs, word lengths their series, the word count their length in seconds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tunefathom import fixed_values as fv
from tunefathom.functions import numeric as nu
from tunefathom.operators import timeseries as ts
from tunefathom.plans.shapes import exact_quantiles, rounded
from tunefathom.queries.registry import Tables, query, sql_round, whole_words


def series_songs(t: Tables):
    """Every document with the lengths of its words; documents without words have an empty series."""
    values = F.transform(whole_words(F.col("text")), lambda w: F.length(w).cast("double"))
    return t.spread("documents").select(F.col("doc_id").alias("song_id"), values.alias("values")).withColumn("duration_seconds", F.size("values") * 1.5)


# words are split at the ASCII white space both engines agree on
SERIES_SQL = r"""
    SELECT doc_id AS song_id, list_transform(list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda w: w <> ''), lambda w: length(w)::DOUBLE) AS values FROM documents"""
_USABLE_SQL = f"SELECT song_id, values, len(values) AS n, len(values) * 1.5 AS d FROM ({SERIES_SQL}) WHERE len(values) > 0"


def _at(seconds: str, feature: str) -> str:
    """Linear interpolation at ``seconds`` with flat ends, on a row with ``values`` and ``n``."""
    hop, window = fv.TIMEBASES[fv.FEATURE_FAMILY[feature]]
    x = f"greatest(0::DOUBLE, least((n - 1)::DOUBLE, ({seconds} - {window / 2!r}::DOUBLE) / {hop!r}::DOUBLE))"
    lo = f"CAST(floor({x}) AS BIGINT)"
    return f"(values[{lo} + 1] + ({x} - {lo}) * (values[least({lo} + 2, n)] - values[{lo} + 1]))"


_RELATIVE_SQL = f"SELECT song_id, CAST(i AS INTEGER) AS position, {_at('i / 99::DOUBLE * d', 'spectral_flux')} AS value FROM ({_USABLE_SQL}), range(100) r(i)"
_ABSOLUTE_SQL = f"SELECT song_id, CAST(i AS INTEGER) AS position, {_at('i::DOUBLE', 'valence')} AS value FROM (SELECT *, unnest(range(CAST(ceil(d) AS BIGINT))) AS i FROM ({_USABLE_SQL}))"


@query("m11_resample_relative", f"SELECT song_id, position, {sql_round('value', 4)} AS value FROM ({_RELATIVE_SQL})")
def _relative(t: Tables):
    return ts.resample_long(series_songs(t), "spectral_flux", "relative").withColumn("value", rounded(F.col("value"), 4))


@query("m12_resample_absolute", f"SELECT song_id, count(*) AS points, {sql_round('sum(value)', 3)} AS total, {sql_round('max(value)', 4)} AS highest FROM ({_ABSOLUTE_SQL}) GROUP BY song_id")
def _absolute(t: Tables):
    points = ts.resample_long(series_songs(t), "valence", "absolute")
    return points.groupBy("song_id").agg(F.count("*").alias("points"), rounded(F.sum("value"), 3).alias("total"), rounded(F.max("value"), 4).alias("highest"))


_HOP, _WINDOW = fv.TIMEBASES["loudness"]


@query("m13_window_centres", f"""
    SELECT song_id, n AS values, {sql_round(f'(n - 1) * {_HOP!r}::DOUBLE + {_WINDOW / 2!r}::DOUBLE', 6)} AS last_centre FROM ({_USABLE_SQL})""")
def _centres(t: Tables):
    rows = ts.with_centres(series_songs(t), "loudness")
    return rows.groupBy("song_id").agg(F.count("*").alias("values"), rounded(F.max("seconds"), 6).alias("last_centre"))


def _summary(c) -> list:
    return [F.size(c).cast("bigint").alias("n"), rounded(F.aggregate(c, F.lit(0.0), lambda a, v: a + v), 3).alias("total"), rounded(F.array_max(c), 4).alias("highest")]


@query("m14_floor_values", f"""
    SELECT song_id, len(v) AS n, {sql_round('list_sum(v)', 3)} AS total, {sql_round('list_max(v)', 4)} AS highest FROM (
        SELECT song_id, list_transform(values, lambda x: greatest(-20 * x + 10, -70)) AS v FROM ({SERIES_SQL}) WHERE len(values) > 0)""")
def _floor_values(t: Tables):
    quiet = F.transform("values", lambda v: v * -20 + 10)
    return series_songs(t).filter(F.size("values") > 0).select("song_id", *_summary(nu.floor_values(quiet)))


@query("m15_normalise_series", f"""
    SELECT song_id, len(v) AS n, {sql_round('list_sum(v)', 3)} AS total, {sql_round('list_max(v)', 4)} AS highest FROM (
        SELECT song_id, list_transform(values, lambda x: CASE WHEN hi = lo THEN 0.5 ELSE (x - lo) / (hi - lo) END) AS v
        FROM (SELECT *, list_min(values) AS lo, list_max(values) AS hi FROM ({SERIES_SQL}) WHERE len(values) > 0))""")
def _normalise_series(t: Tables):
    return series_songs(t).filter(F.size("values") > 0).select("song_id", *_summary(nu.normalise_series(F.col("values"))))


@query("m16_stretch_series", f"""
    SELECT song_id, len(v) AS n, {sql_round('list_sum(v)', 3)} AS total, {sql_round('list_max(v)', 4)} AS highest FROM (
        SELECT song_id, list_transform(range(n + n // 2), lambda i: values[least(CAST(floor(i * n / (n + n // 2) + 0.5) AS BIGINT), n - 1) + 1]) AS v FROM ({_USABLE_SQL}))""")
def _stretch(t: Tables):
    longer = F.size("values") + F.floor(F.size("values") / 2)
    return series_songs(t).filter(F.size("values") > 0).select("song_id", *_summary(nu.stretch_series(F.col("values"), longer)))


@query("m18_flip_series", f"""
    SELECT song_id, len(v) AS n, {sql_round('list_sum(v)', 3)} AS total, {sql_round('list_max(v)', 4)} AS highest FROM (
        SELECT song_id, list_transform(values, lambda x: round((1 - x / 7)::DECIMAL(20, 10), 4)::DOUBLE) AS v FROM ({SERIES_SQL}) WHERE len(values) > 0)""")
def _flip_series(t: Tables):
    return series_songs(t).filter(F.size("values") > 0).select("song_id", *_summary(nu.flip_series(F.transform("values", lambda v: v / 7))))


def _envelope_sql(points: str) -> str:
    return f"""
    SELECT position, CASE WHEN count(*) >= 5 THEN avg(value) END AS mean, CASE WHEN count(*) >= 5 THEN quantile_cont(value, 0.25) END AS p25,
        CASE WHEN count(*) >= 5 THEN quantile_cont(value, 0.75) END AS p75, count(*) AS songs FROM ({points}) GROUP BY position"""


def _rounded_envelope(env):
    return env.select("position", *[rounded(F.col(c), 4).alias(c) for c in ("mean", "p25", "p75")], "songs")


_ROUNDED = ", ".join(f"{sql_round(c, 4)} AS {c}" for c in ("mean", "p25", "p75"))


@query("a16_envelope_relative", f"SELECT position, {_ROUNDED}, songs FROM ({_envelope_sql(_RELATIVE_SQL)})")
def _envelope_relative(t: Tables):
    return _rounded_envelope(ts.timeseries_envelope(series_songs(t), "spectral_flux", "relative"))


@query("a16_envelope_absolute", f"SELECT position, {_ROUNDED}, songs FROM ({_envelope_sql(_ABSOLUTE_SQL)})")
def _envelope_absolute(t: Tables):
    return _rounded_envelope(ts.timeseries_envelope(series_songs(t), "valence", "absolute"))


@query("a16_exact_quantiles", f"""
    SELECT l_returnflag, count(*) AS n, {", ".join(f"{sql_round(f'quantile_cont(l_extendedprice, {p})', 4)} AS q{i}" for i, p in enumerate((0, 0.25, 0.5, 0.999, 1)))} FROM lineitem GROUP BY l_returnflag""")
def _quantiles(t: Tables):
    rows = exact_quantiles(t.lineitem, ["l_returnflag"], "l_extendedprice", [0.0, 0.25, 0.5, 0.999, 1.0])
    return rows.select("l_returnflag", "n", *[rounded(F.col(f"q{i}"), 4).alias(f"q{i}") for i in range(5)])


@query("a17_normalise_envelope", f"""
    WITH e AS ({_envelope_sql(_RELATIVE_SQL)}), s AS (SELECT min(least(mean, p25, p75)) AS lo, max(greatest(mean, p25, p75)) AS hi FROM e)
    SELECT position, {", ".join(f"{sql_round(f'({c} - lo) / (hi - lo)', 4)} AS {c}" for c in ("mean", "p25", "p75"))}, songs FROM e, s""")
def _normalised_envelope(t: Tables):
    return _rounded_envelope(ts.normalise_envelope(ts.timeseries_envelope(series_songs(t), "spectral_flux", "relative")))


_OVERLAYS = [11, 3, 7]


@query("j17_overlay_songs", f"""
    SELECT song_id, CAST(list_position({_OVERLAYS}, song_id) AS INTEGER) AS overlay, len(values) AS n FROM ({SERIES_SQL}) WHERE song_id IN (11, 3, 7)""")
def _overlays(t: Tables):
    return ts.overlay_songs(series_songs(t), [*_OVERLAYS, 11]).select("song_id", "overlay", F.size("values").cast("bigint").alias("n"))


@query("m19_chart_rows", f"""
    WITH e AS ({_envelope_sql(_RELATIVE_SQL)}), o AS (SELECT * FROM ({_RELATIVE_SQL}) WHERE song_id IN (11, 3, 7))
    SELECT e.position, {sql_round('mean', 4)} AS mean, {sql_round('p25', 4)} AS band_low, {sql_round('p75', 4)} AS band_high, e.songs,
        {", ".join(f"{sql_round(f'(SELECT value FROM o WHERE o.position = e.position AND song_id = {s})', 4)} AS overlay_{i + 1}" for i, s in enumerate(_OVERLAYS))} FROM e""")
def _chart_rows(t: Tables):
    songs = series_songs(t)
    chosen = ts.overlay_songs(songs, _OVERLAYS)
    points = ts.resample_long(chosen, "spectral_flux", "relative").join(chosen.select("song_id", "overlay"), "song_id")
    rows = ts.chart_rows(ts.timeseries_envelope(songs, "spectral_flux", "relative"), points)
    return rows.select("position", "songs", *[rounded(F.col(c), 4).alias(c) for c in rows.columns if c not in ("position", "songs")])
