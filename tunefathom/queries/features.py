"""Feature matrix, z-scores, neighbours and map on the embeddings and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tunefathom.operators import features as fe
from tunefathom.plans.shapes import rounded
from tunefathom.queries.registry import Tables, query, sql_round

_KEYS = ["p_size", "p_retailprice", "gappy", "constant", "empty"]


def _songs(t: Tables):
    return t.part.select(
        F.col("p_partkey").alias("song_id"), "p_size", "p_retailprice", F.when(F.col("p_size") > 9, (F.col("p_size") - 10).cast("double")).alias("gappy"),
        F.lit(2.5).alias("constant"), F.lit(None).cast("double").alias("empty"))


_SONGS_SQL = """
    SELECT p_partkey AS song_id, CAST(p_size AS DOUBLE) AS p_size, p_retailprice, nullif(CASE WHEN p_size > 9 THEN CAST(p_size - 10 AS DOUBLE) END, 0) AS gappy FROM part"""
_FILLED_SQL = f"SELECT song_id, p_size, p_retailprice, coalesce(gappy, avg(gappy) OVER ()) AS gappy FROM ({_SONGS_SQL})"


@query("m5_feature_matrix", f"""
    SELECT song_id, {sql_round('p_size', 4)} AS p_size, {sql_round('p_retailprice', 4)} AS p_retailprice, {sql_round('gappy', 4)} AS gappy, 2.5::DOUBLE AS constant, 0::DOUBLE AS empty FROM ({_FILLED_SQL})""")
def _matrix(t: Tables):
    return fe.feature_matrix(_songs(t), _KEYS).select("song_id", *[rounded(F.col(k), 4).alias(k) for k in _KEYS])


def _z(column: str) -> str:
    return sql_round(f"({column} - avg({column}) OVER ()) / stddev_pop({column}) OVER ()", 4)


@query("m6_standardise", f"SELECT song_id, {_z('p_size')} AS z0, {_z('p_retailprice')} AS z1, {_z('gappy')} AS z2, 0::DOUBLE AS z3, 0::DOUBLE AS z4 FROM ({_FILLED_SQL})")
def _standardise(t: Tables):
    return fe.standardise(_songs(t), _KEYS).select("song_id", *[rounded(F.get("features", F.lit(i)), 4).alias(f"z{i}") for i in range(5)])


_MEANS = [round(0.001 * i, 3) for i in range(64)]
_DEVIATIONS = [0.0 if i == 5 else round(0.1 + 0.001 * i, 3) for i in range(64)]


@query("m7_zscore_fixed", f"""
    SELECT vec_id, {sql_round('list_sum(z)', 4)} AS total, {sql_round('z[1]', 4)} AS first, {sql_round('z[6]', 4)} AS sixth FROM (
        SELECT vec_id, [{", ".join("0" if s == 0 else f"(embedding[{i + 1}]::DOUBLE - {m}::DOUBLE) / {s}::DOUBLE" for i, (m, s) in enumerate(zip(_MEANS, _DEVIATIONS)))}] AS z FROM embeddings)""")
def _zscore_fixed(t: Tables):
    z = fe.zscore_fixed(t.embeddings, _MEANS, _DEVIATIONS, "embedding", "z")
    total = F.aggregate("z", F.lit(0.0), lambda a, v: a + v)
    return z.select("vec_id", rounded(total, 4).alias("total"), rounded(F.get("z", F.lit(0)), 4).alias("first"), rounded(F.get("z", F.lit(5)), 4).alias("sixth"))


def _vectors(t: Tables):
    return t.embeddings.select(F.col("vec_id").alias("song_id"), F.col("embedding").alias("features"))


def _knn_sql(k: int) -> str:
    return f"""
    WITH p AS (SELECT a.vec_id AS song_id, b.vec_id AS neighbor_id, array_distance(a.embedding::DOUBLE[64], b.embedding::DOUBLE[64]) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY song_id ORDER BY d, neighbor_id) AS INTEGER) AS rank FROM p)
    SELECT song_id, rank, neighbor_id, {sql_round('d', 4)} AS distance FROM r WHERE rank <= {k}"""


@query("m8_knn", _knn_sql(10))
def _knn(t: Tables):
    return fe.knn(_vectors(t)).withColumn("distance", rounded(F.col("distance"), 4))


@query("o6_map_neighbours", _knn_sql(5))
def _map_neighbours(t: Tables):
    return fe.knn(_vectors(t), 5).withColumn("distance", rounded(F.col("distance"), 4))


@query("m8_knn_copies", f"""
    WITH v AS (SELECT l_orderkey * 8 + l_linenumber AS song_id, min(l_quantity) AS q, min(floor(l_discount * 20)) AS d FROM lineitem GROUP BY 1),
    g AS (SELECT q, d, song_id FROM v QUALIFY row_number() OVER (PARTITION BY q, d ORDER BY song_id) <= 4),
    c AS (SELECT DISTINCT q, d FROM v),
    n AS (SELECT c.q, c.d, g.song_id AS neighbor_id, sqrt((c.q - g.q) ** 2 + (c.d - g.d) ** 2) AS distance FROM c, g
        QUALIFY row_number() OVER (PARTITION BY c.q, c.d ORDER BY distance, g.song_id) <= 4)
    SELECT v.song_id, CAST(row_number() OVER (PARTITION BY v.song_id ORDER BY distance, neighbor_id) AS INTEGER) AS rank, neighbor_id, {sql_round('distance', 4)} AS distance
    FROM v JOIN n USING (q, d) WHERE neighbor_id <> v.song_id QUALIFY rank <= 3""")
def _knn_copies(t: Tables):
    # two coarse features: nearly every song has exact copies
    songs = t.lineitem.groupBy((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("song_id")).agg(
        F.array(F.min("l_quantity"), F.min(F.floor(F.col("l_discount") * 20)).cast("double")).alias("features"))
    return fe.knn(songs, 3).withColumn("distance", rounded(F.col("distance"), 4))


_NUMBERS = ["p_size", "p_retailprice"]


@query("m9_project_2d", f"""
    WITH z AS (SELECT p_partkey AS song_id, (p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER () AS a, (p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER () AS b FROM part),
    s AS (SELECT sign(covar_pop(a, b)) AS s FROM z)
    SELECT song_id, {sql_round('abs(a + s * b) / sqrt(2)', 4)} AS x, {sql_round('abs(a - s * b) / sqrt(2)', 4)} AS y FROM z, s""")
def _project(t: Tables):
    # two standardised features have the diagonals as axes; which end is positive is free when both loadings tie
    points = fe.project_2d(t.part.withColumnRenamed("p_partkey", "song_id"), ["p_retailprice", "unknown", "p_size"], known=_NUMBERS)
    return points.select("song_id", rounded(F.abs("x"), 4).alias("x"), rounded(F.abs("y"), 4).alias("y"))


@query("m10_add_songs", f"""
    WITH s AS (SELECT avg(p_size) AS ma, stddev_pop(p_size) AS sa, avg(p_retailprice) AS mb, stddev_pop(p_retailprice) AS sb, sign(corr(p_size, p_retailprice)) AS s FROM part),
    n AS (SELECT l_orderkey AS song_id, max(l_quantity) AS a, max(l_extendedprice / 50) AS b FROM lineitem WHERE l_orderkey NOT IN (SELECT p_partkey FROM part) GROUP BY 1)
    SELECT song_id, {sql_round('abs((a - ma) / sa + s * (b - mb) / sb) / sqrt(2)', 3)} AS x, {sql_round('abs((a - ma) / sa - s * (b - mb) / sb) / sqrt(2)', 3)} AS y FROM n, s""")
def _add_songs(t: Tables):
    library = t.part.withColumnRenamed("p_partkey", "song_id")
    statistics = fe.feature_statistics(library, _NUMBERS)
    model = fe.fit_map(fe.standardise(library, _NUMBERS, statistics), 2)
    new = t.lineitem.groupBy(F.col("l_orderkey").alias("song_id")).agg(F.max("l_quantity").alias("p_size"), F.max(F.col("l_extendedprice") / 50).alias("p_retailprice"))
    points = fe.add_songs(new, library, statistics, model, _NUMBERS)
    return points.select("song_id", rounded(F.abs("x"), 3).alias("x"), rounded(F.abs("y"), 3).alias("y"))


@query("j18_neighbour_songs", f"""
    WITH k AS ({_knn_sql(5)})
    SELECT k.song_id, k.rank, k.neighbor_id, k.distance, s.label = n.label AS same_label, s.label % 3 = n.label % 3 AS same_group
    FROM k JOIN embeddings s ON s.vec_id = k.song_id JOIN embeddings n ON n.vec_id = k.neighbor_id""")
def _neighbour_songs(t: Tables):
    songs = t.embeddings.select(F.col("vec_id").alias("song_id"), "label", (F.col("label") % 3).alias("group"))
    edges = fe.knn(_vectors(t), 5).withColumn("distance", rounded(F.col("distance"), 4))
    return fe.neighbour_songs(edges, songs, songs, attributes=("label", "group"))
