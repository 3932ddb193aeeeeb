"""Plan shapes shared by the operators: scalar attach, top-k, ordered neighbours, exact quantiles.

Each one keeps a hot key spread out: what is grouped is either pre-aggregated on the map
side, limited on the map side, or keyed by more than the hot key.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from tunefathom.session import settled


def one_row(aggregate: DataFrame) -> Column:
    """The single row of a global aggregate as a struct, attached as a scalar subquery (no join)."""
    return aggregate.select(F.struct("*").alias("row")).scalar()


def rounded(value: Column, digits: int) -> Column:
    """Round half-up after removing binary noise, so 0.12345000000000001 and 0.12345 agree."""
    return F.round(F.round(value, digits + 6), digits)


def bound(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once and where they stand.

    A filter on a plain column is moved below it, with a second copy of all its work; one on a generated column is not.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def top_n(df: DataFrame, by: list, order: list, n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group. Spark limits every group before the shuffle already."""
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def place_in_group(df: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """Rank of every row in its group (1, 2, ...) when all ranks are wanted, not a first few.

    ``df`` is evaluated once: its rows and order are settled, and only groups, order and row ids are range-partitioned
    and sorted. The id of a sorted row holds its slice and its place there; the slices before it are added up, so a
    group holding a third of the rows spans a third of the partitions. ``order`` must be total.
    """
    keys = [f"_o{i}" for i in range(len(order))]
    rows = settled(df.withColumns({**dict(zip(keys, order)), "_row": F.monotonically_increasing_id()}), "ranked")
    sort = [*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], *keys]
    thin = rows.select(*sort, "_row")
    groups, ranges = [f"_g{i}" for i in range(len(by))], [f"_g{i}" for i in range(len(by))] + keys
    placed = thin.repartitionByRange(*ranges).sortWithinPartitions(*ranges).withColumn("_at", F.monotonically_increasing_id())
    slices = settled(placed.select(F.struct(*groups, F.shiftright("_at", 33).alias("slice")).alias("_part"), "_row", "_at"), "places")
    counts = slices.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*[F.col(f"_part.{g}") for g in groups]).orderBy("_part.slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    places = slices.join(offsets, "_part").select("_row", (F.col("_at") + F.col("_shift")).cast("int").alias(name))
    return rows.join(places, "_row").select(*df.columns, name)


Chunker = Callable[[DataFrame, str], DataFrame]


def chunks_of(bucket: Callable[[Column], Column]) -> Chunker:
    """Adds ``_chunk`` as a plain expression of the order column."""
    return lambda rows, order: rows.withColumn("_chunk", bucket(F.col(order)))


#: Cuts that the driver holds at most; beyond them chunks are cut evenly by value.
MAX_CUTS = 4096


def even_chunks(df: DataFrame, order: str, rows_per_chunk: int = 50_000, most: int = MAX_CUTS) -> Chunker:
    """Adds ``_chunk`` such that every chunk holds about equally many rows of ``df``, whatever their spread.

    The cuts are at most ``most`` approximate quantiles, searched by bisection in the JVM. Where more chunks are wanted,
    what lies between two cuts is divided into equal ranges of the value.
    """
    def number(rows: DataFrame, column: str) -> Column:
        kind = dict(rows.dtypes)[column]
        return (F.unix_micros(F.col(column).cast("timestamp")) if "timestamp" in kind else F.col(column)).cast("double")

    wanted = -(-df.count() // rows_per_chunk)
    cuts, parts = min(wanted, most), -(-wanted // most)
    # the lowest and highest value are cuts too where the ranges between cuts are divided
    shares = [i / cuts for i in (range(cuts + 1) if parts > 1 else range(1, cuts))]
    edges = sorted(set(df.select(number(df, order).alias("v")).approxQuantile("v", shares, 0.25 / cuts))) if cuts > 1 else []
    splits = [-math.inf, *edges, math.inf]

    def add(rows: DataFrame, column: str) -> DataFrame:
        if len(splits) < 3:
            return rows.withColumn("_chunk", F.lit(0))
        bucketizer = Bucketizer(splits=splits, inputCol="_number", outputCol="_chunk", handleInvalid="keep")
        cut = bucketizer.transform(rows.withColumn("_number", number(rows, column)))
        if parts > 1:
            low, high = (F.get(F.array(*[F.lit(v) for v in ends]), F.col("_chunk").cast("int")) for ends in ([edges[0], *edges], [*edges, edges[-1]]))
            share = F.coalesce(F.try_divide(F.col("_number") - low, high - low), F.lit(0.0))
            cut = cut.withColumn("_chunk", F.col("_chunk") * parts + F.least(F.greatest(F.floor(share * parts), F.lit(0)), F.lit(parts - 1)))
        return cut.drop("_number")
    return add


def neighbour_values(df: DataFrame, group: list[str], order: str, chunk: Chunker, value: str) -> DataFrame:
    """Adds the values of the rows before and after inside an ordered group, and of its first and last row.

    Columns ``_before``, ``_after`` (null at the ends), ``_first``, ``_last``. ``chunk`` buckets the order column. Rows
    are windowed once per (group, chunk); one summary row per chunk, with its first and last value, is windowed per group
    to carry values across chunk borders, so a group holding a third of the table is still spread over all its chunks.
    """
    keys = [*group, "_chunk"]
    boxed = F.struct(F.col(value).alias("v"))
    inside = Window.partitionBy(*keys).orderBy(order)
    rows = chunk(df, order).withColumns({"_behind": F.lag(boxed).over(inside), "_ahead": F.lead(boxed).over(inside)})
    ends = chunk(df, order).groupBy(*keys).agg(F.min_by(boxed, order).alias("_low"), F.max_by(boxed, order).alias("_high"))
    across, whole = Window.partitionBy(*group).orderBy("_chunk"), Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = ends.select(*keys, F.lag("_high").over(across).alias("_from"), F.lead("_low").over(across).alias("_to"),
                          F.first("_low").over(whole).alias("_start"), F.last("_high").over(whole).alias("_end"))
    joined = rows.join(carried, keys, "left")
    return joined.select(*df.columns, F.coalesce("_behind", "_from")["v"].alias("_before"), F.coalesce("_ahead", "_to")["v"].alias("_after"),
                         F.col("_start.v").alias("_first"), F.col("_end.v").alias("_last"))


def previous_value(df: DataFrame, group: list[str], order: str, chunk: Chunker, value: str, name: str) -> DataFrame:
    """The value of the row before inside an ordered group, carried across chunks as in :func:`neighbour_values`."""
    keys = [*group, "_chunk"]
    rows = chunk(df, order)
    boxed = F.struct(F.col(value).alias("v"))
    rows = rows.withColumn("_inner", F.lag(boxed).over(Window.partitionBy(*keys).orderBy(order)))
    chunks = rows.groupBy(*keys).agg(F.max_by(boxed, order).alias("_edge"))
    across = F.lag("_edge").over(Window.partitionBy(*group).orderBy("_chunk"))
    joined = rows.join(chunks.select(*keys, across.alias("_across")), keys, "left")
    return joined.withColumn(name, F.coalesce("_inner", "_across")["v"]).drop("_chunk", "_inner", "_across")


def following_event(
    asked: DataFrame, events: DataFrame, key: str, since: str, at: str, chunk: Chunker, name: str,
) -> DataFrame:
    """Adds to ``asked`` the time of the first event of the same key at or after ``since`` (null without one).

    Both sides are merged in time order instead of being joined pair by pair. ``chunk`` buckets a time column;
    rows meet per (key, chunk), and one summary per chunk carries the first event of later chunks back, so a
    key with a third of all rows is spread over its chunks. ``key`` must not be null.
    """
    columns = asked.columns
    rows = asked.select(F.struct(*columns).alias("_row"), F.col(key).alias("_key"), F.col(since).alias("_t"), F.lit(None).cast(events.schema[at].dataType).alias("_e"))
    marks = events.select(F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), F.col(key).alias("_key"), F.col(at).alias("_t"), F.col(at).alias("_e")).distinct()
    merged = chunk(rows.unionByName(marks), "_t")
    # latest first: a frame growing from the start is one pass, a frame shrinking to the end is not
    ahead = Window.partitionBy("_key", "_chunk").orderBy(F.desc("_t")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = merged.withColumn("_inside", F.min("_e").over(ahead)).filter(F.col("_row").isNotNull())
    firsts = merged.groupBy("_key", "_chunk").agg(F.min("_e").alias("_first"))
    later = Window.partitionBy("_key").orderBy(F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    carried = firsts.select("_key", "_chunk", F.min("_first").over(later).alias("_later"))
    found = inside.join(carried, ["_key", "_chunk"])
    return found.select("_row.*", F.coalesce("_inside", "_later").alias(name))


def exact_quantiles(df: DataFrame, by: list[str], value: str, probs: list[float], accuracy: int = 1000, also: list[Column] = ()) -> DataFrame:
    """Exact linear-interpolated quantiles, one row per group, without holding a group in one task.

    A mergeable sketch brackets every wanted rank; only values inside a bracket (about four parts in
    ``accuracy`` of a group) are ranked, as distinct values with counts, so equal values collapse first.
    All values below a bracket collapse to one count on the map side. The values are read twice.
    Columns: the keys, ``n``, ``q0..`` in the order of ``probs``, and the aggregates in ``also``.
    """
    values = df.filter(F.col(value).isNotNull()).withColumn("_v", F.col(value).cast("double"))
    margin = 2.0 / accuracy
    grid = [g for p in probs for g in (max(0.0, p - margin), min(1.0, p + margin))]
    sketch = values.groupBy(*by).agg(
        F.count("*").alias("n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        F.percentile_approx("_v", grid, accuracy).alias("_cut"), *also)
    extra = [c for c in sketch.columns if c not in (*by, "n", "_min", "_max", "_cut")]
    # groups no larger than the accuracy are bracketed by their whole range
    small = F.col("n") <= accuracy
    brackets = F.array(*[
        F.struct(
            F.lit(i).alias("q"),
            F.when(small | F.lit(p - margin <= 0), F.col("_min")).otherwise(F.col("_cut")[2 * i]).alias("lo"),
            F.when(small | F.lit(p + margin >= 1), F.col("_max")).otherwise(F.col("_cut")[2 * i + 1]).alias("hi"),
            (F.lit(float(p)) * (F.col("n") - 1)).alias("h"),
        )
        for i, p in enumerate(probs)
    ])
    bounds = sketch.select(*by, F.struct("n", *extra).alias("_g"), brackets.alias("_b"))
    tagged = values.select(*by, "_v").join(bounds.select(*by, "_b"), by).select(*by, "_v", F.explode("_b").alias("_b"))
    below = F.col("_v") < F.col("_b.lo")
    counts = tagged.filter(F.col("_v") <= F.col("_b.hi")).groupBy(
        *by, F.col("_b.q").alias("_q"), F.col("_b.h").alias("_h"), F.when(~below, F.col("_v")).alias("_v")).agg(F.count("*").alias("_c"))
    # nulls first: everything below the bracket is counted before its first value
    ranked = counts.withColumn("_upto", F.sum("_c").over(
        Window.partitionBy(*by, "_q").orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, 0)))
    # order statistic r (0-based) is the smallest value whose cumulative count exceeds r
    picked = ranked.groupBy(*by, "_q").agg(
        F.first("_h").alias("_h"),
        F.min(F.when(F.col("_upto") > F.floor("_h"), F.col("_v"))).alias("_lo"),
        F.min(F.when(F.col("_upto") > F.ceil("_h"), F.col("_v"))).alias("_hi"),
    ).withColumn("_value", F.col("_lo") + (F.col("_h") - F.floor("_h")) * (F.col("_hi") - F.col("_lo")))
    wide = picked.groupBy(*by).agg(*[F.max(F.when(F.col("_q") == i, F.col("_value"))).alias(f"q{i}") for i in range(len(probs))])
    return wide.join(bounds.select(*by, "_g"), by).select(*by, "_g.n", *[f"q{i}" for i in range(len(probs))], *[f"_g.{c}" for c in extra])
