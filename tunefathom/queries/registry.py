"""Registry of queries and the small SQL pieces their checks share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tunefathom.session import TABLE_DEFAULTS, apply_defaults


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


class Tables:
    """The driver tables below one folder, read on first use."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        """A table dealt out to the session's shuffle partitions: the driver writes files of one split, and the work per row is heavy."""
        return getattr(self, name).repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")))


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of :class:`Tables` under ``name``."""
    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            apply_defaults(spark, TABLE_DEFAULTS)
            return build(Tables(spark, folder))
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = Query(name, run, sql)
        return build
    return register


def sql_round(expression: str, digits: int) -> str:
    """The SQL twin of ``plans.shapes.rounded``."""
    return f"CAST(ROUND(CAST({expression} AS DECIMAL(30, {digits + 6})), {digits}) AS DOUBLE)"


def key_if(condition: Column | str, key: Column | str) -> Column:
    """The key where the condition holds, else a number that matches nothing: the row is read, and misses."""
    column = F.col(key) if isinstance(key, str) else key
    return F.when(F.expr(condition) if isinstance(condition, str) else condition, column).otherwise(-1 - column)


def name_if(condition: Column | str, name: Column | str) -> Column:
    """The same for a name."""
    column = F.col(name) if isinstance(name, str) else name
    return F.when(F.expr(condition) if isinstance(condition, str) else condition, column).otherwise(F.concat(F.lit("unmatched "), column))


def whole_words(text: Column) -> Column:
    """White-space separated tokens of a text, none of them empty."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


# Parts as songs: five names per brand make titles and artists repeat, as they do in a library.
def songs_from_part(t: Tables) -> DataFrame:
    return t.part.select(
        F.col("p_partkey").alias("song_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("artist"),
        F.col("p_type").alias("top_genre"), F.col("p_size").cast("double").alias("bpm"), F.col("p_retailprice").alias("duration_seconds"))


SONGS_SQL = ("SELECT p_partkey AS song_id, p_name AS title, p_brand AS artist, p_type AS top_genre, "
             "CAST(p_size AS DOUBLE) AS bpm, p_retailprice AS duration_seconds FROM part")


# Line items as scored labels of a song: the order is the song, the part's type the parent, its name the detail.
def labels_from_lineitem(t: Tables) -> DataFrame:
    """One row per order and part, the highest discount its score."""
    rows = t.lineitem.groupBy("l_orderkey", "l_partkey").agg(F.max(F.col("l_extendedprice") / 105000).alias("score"))
    return rows.select(F.col("l_orderkey").alias("song_id"), F.format_string("P%d---D%d", F.col("l_partkey") % 7, F.col("l_partkey")).alias("label"), "score")


LABELS_SQL = ("SELECT l_orderkey AS song_id, 'P' || CAST(l_partkey % 7 AS VARCHAR) || '---D' || CAST(l_partkey AS VARCHAR) AS label, "
              "max(l_extendedprice / 105000) AS score FROM lineitem GROUP BY l_orderkey, l_partkey")
