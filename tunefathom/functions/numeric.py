"""Column expressions on scalars and on per-song value arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from tunefathom import fixed_values as fv
from tunefathom.plans.shapes import rounded


def _between_zero_and_one(v: Column) -> Column:
    # least and greatest skip nulls, so a missing value has to be kept apart
    return F.when(v.isNotNull() & ~F.isnan(v.cast("double")), F.greatest(F.lit(0.0), F.least(F.lit(1.0), v.cast("double"))))


def clamp01(v: Column) -> Column:
    return _between_zero_and_one(v)


def minmax(v: Column, low: Column, high: Column) -> Column:
    """Position inside the library's range; a library with one value only sits in the middle."""
    return F.when(v.isNull(), F.lit(None).cast("double")).when(high == low, F.lit(fv.CONSTANT_LEVEL)).otherwise(
        _between_zero_and_one(F.try_divide(v - low, high - low)))


def z_to_unit(v: Column) -> Column:
    return _between_zero_and_one((v + 2) / 4)


def normalise_av(v: Column) -> Column:
    """Arousal and valence come as shares or on the raw 1-9 scale."""
    return _between_zero_and_one(F.when(v <= 1, v).otherwise((v - 1) / 8))


def loudness_gain(lufs: Column) -> Column:
    return F.coalesce(F.least(F.lit(1.0), F.pow(F.lit(10.0), (F.lit(fv.TARGET_LUFS) - lufs) / 20)), F.lit(1.0))


def flip_score(v: Column) -> Column:
    return rounded(1 - v, 4)


def flip_series(values: Column) -> Column:
    return F.transform(values, lambda v: rounded(1 - v, 4))


def release_year(date: Column) -> Column:
    """Leading digits of the first four characters, within the accepted years."""
    year = F.regexp_extract(F.substring(date, 1, 4), r"^\s*(\d{1,4})", 1).try_cast("int")
    return F.when((year > fv.FIRST_YEAR) & (year <= fv.LAST_YEAR), year)


# --- arrays -----------------------------------------------------------------------

def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row.

    Inside a lambda an outer expression runs again for every element; a lambda variable does not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))

def floor_values(values: Column, floor: float = fv.LOUDNESS_FLOOR_DB) -> Column:
    return F.transform(values, lambda v: F.when(v.isNotNull(), F.greatest(v, F.lit(floor))))


def normalise_series(values: Column, digits: int | None = None) -> Column:
    """Min-max of one array; a constant one is 0.5."""
    def scaled(box: Column) -> Column:
        span = box["high"] - box["low"]
        return F.transform(box["values"], lambda v: F.when(span == 0, F.lit(fv.CONSTANT_LEVEL)).otherwise(F.try_divide(v - box["low"], span)))
    boxed = F.struct(values.alias("values"), F.array_min(values).alias("low"), F.array_max(values).alias("high"))
    result = F.when(values.isNotNull(), let(boxed, scaled))
    return result if digits is None else F.transform(result, lambda v: rounded(v, digits))


def window_centres(n: Column, hop: float, window: float) -> Column:
    """Time of each stored value: the middle of the window it was computed over."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: i * F.lit(hop) + F.lit(window / 2))).otherwise(
        F.array().cast("array<double>"))


def value_at(values: Column, seconds: Column, hop: float, window: float) -> Column:
    """Linear interpolation on the centres; flat before the first and after the last one."""
    last = F.size(values) - 1
    x = F.greatest(F.lit(0.0), F.least(last.cast("double"), (seconds - F.lit(window / 2)) / F.lit(hop)))
    lo = F.floor(x).cast("int")
    hi = F.least(lo + 1, last)
    a, b = F.get(values, lo), F.get(values, hi)
    return a + (x - lo) * (b - a)


def resample_relative(values: Column, duration: Column, hop: float, window: float) -> Column:
    """100 values at 0 %, 1 %, ... of the song, ending at 100 %."""
    return let(values, lambda vs: F.transform(
        F.sequence(F.lit(0), F.lit(99)), lambda i: value_at(vs, i / F.lit(99.0) * duration, hop, window)))


def resample_absolute(values: Column, duration: Column, hop: float, window: float) -> Column:
    """One value per whole second before the song's end."""
    seconds = F.sequence(F.lit(0), F.greatest(F.ceil(duration) - 1, F.lit(0)).cast("int"))
    return let(values, lambda vs: F.transform(
        F.filter(seconds, lambda s: s < duration), lambda s: value_at(vs, s.cast("double"), hop, window)))


def stretch_series(values: Column, length: Column) -> Column:
    """Nearest-index stretch to ``length`` values (rounding half up)."""
    def stretched(vs: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), length.cast("int") - 1),
            lambda i: F.get(vs, F.least(F.floor(i * F.size(vs) / length + 0.5).cast("int"), F.size(vs) - 1)))
    return F.when((F.size(values) > 0) & (length > 0), let(values, stretched)).otherwise(values)
