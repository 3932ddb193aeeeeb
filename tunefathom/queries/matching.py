"""Matching of videos, files and tracks with the library, on names made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tunefathom.operators import filters as fi, matching as ma
from tunefathom.plans.shapes import rounded
from tunefathom.queries.registry import Tables, key_if, name_if, query, sql_round
from tunefathom.queries.texts import _VIDEOS_PARSED_SQL, song_id_sql, videos


@query("j3_has_audio", """
    SELECT c_custkey, coalesce(lower(c_name) IN (SELECT lower('customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0')) FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '5-LOW'), false) AS has_audio
    FROM customer""")
def _has_audio(t: Tables):
    files = t.orders.select(name_if("o_orderstatus = 'F' and o_orderpriority = '5-LOW'", F.concat(F.lit("CUSTOMER#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))).alias("basename"))
    songs = t.customer.select("c_custkey", F.when(F.col("c_nationkey") >= 0, F.col("c_name")).alias("filename"))
    return ma.with_audio(songs, files).select("c_custkey", "has_audio")


@query("j4_already_saved", """
    SELECT o_orderkey AS row_id FROM orders WHERE o_custkey IN (SELECT l_suppkey * 7 FROM lineitem WHERE l_tax > 0.06)
        OR (o_orderpriority <> '5-LOW' AND CAST(floor(o_totalprice) AS BIGINT) IN (SELECT CAST(floor(l_extendedprice) AS BIGINT) FROM lineitem WHERE l_tax > 0.06 AND l_returnflag <> 'N'))""")
def _already_saved(t: Tables):
    new = t.orders.select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("song_id"),
                          F.when(F.col("o_orderpriority") != "5-LOW", F.floor("o_totalprice")).alias("recording_id"))
    songs = t.lineitem.select(key_if("l_tax > 0.06", F.col("l_suppkey") * 7).alias("song_id"), F.when(F.col("l_returnflag") != "N", key_if("l_tax > 0.06", F.floor("l_extendedprice"))).alias("recording_id"))
    return ma.already_saved(new, songs).select("row_id")


_RESOLVE_SQL = """
    WITH songs AS (SELECT p_partkey AS song_id FROM part WHERE p_size > 25), tracks AS (SELECT DISTINCT l_partkey AS track_id FROM lineitem),
    linked AS (SELECT l_partkey AS track_id, arg_max(l_suppkey * 3, l_orderkey * 100000 + l_linenumber * 10000 + l_suppkey) AS song_id FROM lineitem
        WHERE l_returnflag = 'A' AND l_quantity > 44 AND l_suppkey * 3 IN (FROM songs) GROUP BY 1),
    named AS (SELECT track_id, arg_min(c, i) AS song_id FROM (SELECT track_id, i, track_id + i * 3 AS c FROM tracks, range(3) r(i)) WHERE c IN (FROM songs) GROUP BY 1)
    SELECT track_id, coalesce(l.song_id, n.song_id) AS song_id FROM tracks LEFT JOIN linked l USING (track_id) LEFT JOIN named n USING (track_id) WHERE coalesce(l.song_id, n.song_id) IS NOT NULL"""


def resolve_inputs(t: Tables):
    part = F.col("l_partkey")
    tracks = t.lineitem.select(part.alias("track_id"), F.array(part, part + 3, part + 6).alias("candidates"))
    imports = t.lineitem.select(
        (F.col("l_orderkey") * 100000 + F.col("l_linenumber") * 10000 + F.col("l_suppkey")).alias("id"), key_if("l_returnflag = 'A' and l_quantity > 44", part).alias("track_id"), (F.col("l_suppkey") * 3).alias("song_id"))
    songs = t.part.select(key_if("p_size > 25", "p_partkey").alias("song_id"))
    return tracks, imports, songs


@query("j5_resolve_tracks", _RESOLVE_SQL)
def _resolve(t: Tables):
    return ma.resolve_tracks(*resolve_inputs(t))


_CANDIDATES_SQL = " UNION ALL ".join(f"SELECT p_partkey * 2 + {i} AS track_id, p_name AS title, {artist} AS artist FROM part" for i, artist in enumerate(("p_brand", "p_type")))


@query("j5_candidate_ids", f"SELECT track_id // 2 AS track_id, string_agg(song_id, ' ' ORDER BY track_id) AS candidates FROM ({song_id_sql(_CANDIDATES_SQL, 'track_id')}) GROUP BY ALL")
def _candidates(t: Tables):
    tracks = t.part.select(F.col("p_partkey").alias("track_id"), F.concat("p_name", F.lit(" (feat. Guest) - Remastered 2009")).alias("title"), F.array("p_brand", "p_type").alias("artists"))
    return ma.with_candidates(tracks).select("track_id", F.array_join("candidates", " ").alias("candidates"))


@query("j6_in_library", f"""
    WITH lib AS (SELECT DISTINCT lower(p_name) AS t, lower(replace(p_brand, '#', ' ')) AS a FROM part WHERE p_size > 45),
    v AS ({_VIDEOS_PARSED_SQL}), raw AS (SELECT p_partkey AS video_id, CASE p_partkey % 6 WHEN 5 THEN 'the composer ' ELSE '' END || p_name || CASE p_partkey % 6 WHEN 2 THEN ' radio edit' ELSE '' END || ' ' || replace(p_brand, '#', ' ') AS words, p_partkey % 6 AS k FROM part)
    SELECT video_id FROM v JOIN raw USING (video_id) WHERE EXISTS (SELECT 1 FROM lib WHERE (t = lower(title) AND a = lower(artist))
        OR (k <> 3 AND contains(' ' || lower(words) || ' ', ' ' || t || ' ') AND contains(' ' || lower(words) || ' ', ' ' || a || ' ')))""")
def _in_library(t: Tables):
    part = t.spread("part")
    songs = part.select(name_if("p_size > 45", F.concat("p_name", F.lit(" [Deluxe]"))).alias("title"), F.translate("p_brand", "#", " ").alias("artist"))
    plain = part.select(name_if("p_size > 45", "p_name").alias("title"), F.translate("p_brand", "#", " ").alias("artist"))
    return ma.in_library(videos(t), songs.unionByName(plain))


_HEARD_SQL = "SELECT c_custkey AS video_id, 'Tour: ' || c_name || ' in ' || n_name AS video_title FROM customer JOIN nation ON n_nationkey = c_nationkey"


def _heard(t: Tables):
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("c_custkey").alias("video_id"), F.concat(F.lit("Tour: "), "c_name", F.lit(" in "), "n_name").alias("video_title"))


@query("j7_title_in_library", f"SELECT video_id FROM ({_HEARD_SQL}) WHERE EXISTS (SELECT 1 FROM nation WHERE n_regionkey IN (0, 3) AND contains(lower(video_title), lower(n_name)))")
def _title_known(t: Tables):
    titles = t.nation.select(F.concat(F.lit(" "), name_if("n_regionkey in (0, 3)", "n_name")).alias("title"))
    return ma.title_in_library(_heard(t), titles, keep_known=True).select("video_id")


@query("j7_title_not_in_library", f"SELECT video_id FROM ({_HEARD_SQL}) WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_regionkey IN (0, 3) AND contains(lower(video_title), lower(n_name)))")
def _title_unknown(t: Tables):
    titles = t.nation.select(name_if("n_regionkey in (0, 3)", "n_name").alias("title"))
    return ma.title_in_library(_heard(t), titles, keep_known=False).select("video_id")


# One hit per line item for the part as wanted track; the line number decides how the upload is titled.
def _tracks(t: Tables):
    return t.part.select(F.col("p_partkey").alias("track_id"), F.col("p_name").alias("title"), F.array(F.col("p_brand"), F.lit("Second Name")).alias("artists"), (F.col("p_size") * 10000).cast("bigint").alias("duration_ms"))


def _hits(t: Tables):
    rows = t.spread("lineitem").join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    k, name, brand = F.col("l_linenumber"), F.col("p_name"), F.col("p_brand")
    title = F.when(k == 1, F.concat(brand, F.lit(" - "), name, F.lit(" (Official Video)"))).when(k == 2, F.concat(name, F.lit(" LIVE - "), brand)).when(
        k == 3, F.concat(brand, F.lit(" - "), name, F.lit(" ft. Nobody Else"))).when(k == 4, F.concat(brand, F.lit(" - something else"))).when(
        k == 5, name).when(k == 6, F.concat(F.upper(name), F.lit(" by sécond name"))).otherwise(F.concat(name, F.lit(" (2009 Remastered Version)")))
    uploader = F.when(k == 7, F.concat(brand, F.lit(" - Topic"))).otherwise("Fan")
    return rows.select(F.col("l_partkey").alias("track_id"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey").alias("video_id"),
                       title.alias("video_title"), uploader.alias("uploader"), (F.col("l_quantity") * 10).cast("int").alias("duration"),
                       (F.col("l_orderkey") * 10 + k).alias("input_pos"), (k % 3).alias("tier"))


_HITS_SQL = """
    SELECT l_partkey AS track_id, l_orderkey || '-' || l_linenumber || '-' || l_suppkey AS video_id, l_linenumber AS k, l_quantity * 10 AS v, p_size * 10 AS s,
        l_orderkey * 10 + l_linenumber AS input_pos, l_linenumber % 3 AS tier FROM lineitem JOIN part ON p_partkey = l_partkey"""
_FITS_SQL = f"SELECT * FROM ({_HITS_SQL}) WHERE k IN (1, 6, 7) AND (abs(v - s) <= 15 OR v BETWEEN s AND s * 1.25)"


@query("j8_candidate_fits", f"SELECT track_id, video_id FROM ({_FITS_SQL})")
def _fits(t: Tables):
    return ma.candidate_fits(_tracks(t), _hits(t)).select("track_id", "video_id")


_ORDER_SQL = "ORDER BY CASE WHEN k = 7 THEN 0 ELSE 1 END, abs(v - s), input_pos"


@query("o4_order_candidates", f"SELECT track_id, input_pos, row_number() OVER (PARTITION BY track_id {_ORDER_SQL}) AS place FROM ({_FITS_SQL})")
def _order(t: Tables):
    return ma.order_candidates(_tracks(t), ma.candidate_fits(_tracks(t), _hits(t))).select("track_id", "input_pos", "place")


@query("o5_first_fitting", f"""
    SELECT track_id, input_pos, row_number() OVER (PARTITION BY track_id {_ORDER_SQL}) AS attempt FROM (
        SELECT *, min(tier) OVER (PARTITION BY track_id) AS best FROM ({_FITS_SQL})) WHERE tier = best QUALIFY attempt <= 3""")
def _first_fitting(t: Tables):
    return ma.first_fitting(ma.candidate_fits(_tracks(t), _hits(t)), _tracks(t)).select("track_id", "input_pos", "attempt")


@query("j9_identity_matches", """
    SELECT DISTINCT l_partkey AS track_id, l_orderkey || '-' || l_linenumber || '-' || l_suppkey AS found_id FROM lineitem WHERE l_linenumber IN (1, 2, 3, 6) AND l_returnflag <> 'R'""")
def _identity(t: Tables):
    rows = t.spread("lineitem").join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    k, name, brand = F.col("l_linenumber"), F.col("p_name"), F.col("p_brand")
    title = F.when(k == 1, F.upper(name)).when(k == 2, F.concat(name, F.lit(" - Live"))).when(k == 3, F.concat(name, F.lit(" (Initial D)"))).when(
        k == 4, F.concat(name, F.lit(" (Club Rework)"))).when(k == 6, F.concat(F.translate(name, "i", "í"), F.lit(" (feat. X)"))).otherwise("Entirely Different Song")
    artist = F.when(F.col("l_returnflag") == "A", F.concat(F.lit("Someone feat. "), brand)).when(F.col("l_returnflag") == "N", F.concat(brand, F.lit(" & Friends"))).otherwise("Stranger")
    found = rows.select(F.col("l_partkey").alias("track_id"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey").alias("found_id"), title.alias("title"), artist.alias("artist"))
    return ma.identity_matches(_tracks(t), found.distinct())


@query("j10_trusted_upload", "SELECT l_partkey AS track_id, l_orderkey || '-' || l_linenumber || '-' || l_suppkey AS video_id FROM lineitem WHERE l_linenumber IN (1, 5)")
def _trusted(t: Tables):
    rows = t.spread("lineitem").join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    k, name, brand = F.col("l_linenumber"), F.col("p_name"), F.col("p_brand")
    title = F.when(k == 1, F.concat(brand, F.lit(" & Second Name - "), name, F.lit(" (Official 4K Video) 2011"))).when(k == 2, F.concat(brand, F.lit(" - "), name, F.lit(" drum cam"))).otherwise(name)
    uploader = F.when(k.isin(1, 2), F.concat(brand, F.lit(" (Official)"))).when(k == 5, F.concat(F.lit("Second Name"), F.lit("VEVO"))).otherwise("Fan Channel")
    seen = rows.select(F.col("l_partkey").alias("track_id"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey").alias("video_id"), title.alias("video_title"), uploader.alias("uploader"))
    return ma.trusted_upload(_tracks(t), seen).select("track_id", "video_id")


@query("o3_rank_hits", f"""
    WITH h AS (SELECT l_partkey AS query_id, l_orderkey * 10 + l_linenumber AS input_pos, min(l_linenumber) AS k, min(l_orderkey) * 1000 AS views, bool_or(l_linestatus = 'O') AS verified FROM lineitem GROUP BY 1, 2),
    s AS (SELECT *, CASE k WHEN 1 THEN 8 + 3 WHEN 2 THEN 8 + 3 - 4 WHEN 3 THEN 8 + 3 + 3 WHEN 4 THEN 4 WHEN 5 THEN 8 WHEN 6 THEN 8 + 3 - 4 ELSE 0 END + CASE WHEN verified THEN 2 ELSE 0 END + 0.3 * log10(views + 1) AS score FROM h)
    SELECT query_id, input_pos, {sql_round('score', 4)} AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, input_pos) AS place FROM s""")
def _rank(t: Tables):
    queries = t.part.select(F.col("p_partkey").alias("query_id"), F.concat("p_brand", F.lit(" - "), F.lit("Élan "), "p_partkey", F.lit(" official audio")).alias("query"), "p_brand")
    rows = t.lineitem.groupBy(F.col("l_partkey").alias("query_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("input_pos")).agg(
        F.min("l_linenumber").alias("k"), (F.min("l_orderkey") * 1000).alias("view_count"), F.bool_or(F.col("l_linestatus") == "O").alias("verified"))
    rows = rows.join(queries, "query_id")
    k, brand = F.col("k"), F.col("p_brand")
    song = F.concat(F.lit("elan "), F.col("query_id").cast("string"))
    title = F.when(k == 1, F.concat(brand, F.lit(" - "), song)).when(k == 2, F.concat(brand, F.lit(" - "), song, F.lit(" (Karaoke)"))).when(k == 3, song).when(
        k == 4, F.lit("Elan")).when(k == 5, song).when(k == 6, F.concat(brand, F.lit(": Paris - "), song)).otherwise("unrelated")
    channel = F.when(k == 3, F.concat(brand, F.lit(" - Topic"))).otherwise("Fan")
    hits = rows.select("query_id", "input_pos", title.alias("title"), channel.alias("channel"), "view_count", "verified")
    ranked = ma.rank_hits(queries, hits)
    return ranked.select("query_id", "input_pos", rounded(F.col("score"), 4).alias("score"), "place")


@query("j19_pending_hits", """
    SELECT l_orderkey AS video_id, l_linenumber AS n, l_partkey AS p FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 30)
        AND l_partkey NOT IN (SELECT ps * 3 FROM (SELECT s_suppkey AS ps FROM supplier))""")
def _pending(t: Tables):
    hits = t.lineitem.select(F.col("l_partkey").alias("video_id"), "l_orderkey", "l_linenumber")
    found = ma.pending_hits(hits, t.part.select(key_if("p_size > 30", "p_partkey").alias("video_id")), t.supplier.select((F.col("s_suppkey") * 3).alias("video_id")))
    return found.select(F.col("l_orderkey").alias("video_id"), F.col("l_linenumber").alias("n"), F.col("video_id").alias("p"))


@query("j19_pending_counts", """
    WITH h AS (SELECT l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 30) AS a, l_partkey IN (SELECT s_suppkey * 3 FROM supplier) AS b FROM lineitem)
    SELECT count(*) FILTER (WHERE a) AS in_library, count(*) FILTER (WHERE b) AS loading, count(*) FILTER (WHERE NOT a AND NOT b) AS pending FROM h""")
def _pending_counts(t: Tables):
    hits = t.lineitem.select(F.col("l_partkey").alias("video_id"))
    return ma.pending_counts(hits, t.part.select(key_if("p_size > 30", "p_partkey").alias("video_id")), t.supplier.select((F.col("s_suppkey") * 3).alias("video_id")))
