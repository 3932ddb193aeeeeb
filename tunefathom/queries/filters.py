"""Filters and per-row verdicts on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tunefathom.functions import numeric as nu
from tunefathom.operators import aggregates as ag, filters as fi
from tunefathom.queries.registry import LABELS_SQL, SONGS_SQL, Tables, key_if, labels_from_lineitem, query, songs_from_part, sql_round


@query("f1_search", f"""
    SELECT song_id, title, artist FROM ({SONGS_SQL})
    WHERE contains(lower(title), 'ring') OR contains(lower(artist), 'ring')""")
def _search(t: Tables):
    return fi.search(songs_from_part(t), " RING ").select("song_id", "title", "artist")


@query("f1_picker", f"""
    SELECT song_id, title FROM ({SONGS_SQL})
    WHERE (contains(lower(title), 'o') OR contains(lower(artist), 'o')) AND song_id NOT IN (2, 7)
    ORDER BY title NULLS LAST, song_id LIMIT 30""")
def _picker(t: Tables):
    return fi.picker(songs_from_part(t), "o", [2, 7]).select("song_id", "title")


@query("f2_chart_filter", """
    SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders
    WHERE year(o_orderdate) = 1997 AND o_totalprice >= 50000 AND o_totalprice < 150000.5 AND o_orderpriority = '2-HIGH'""")
def _chart_filter(t: Tables):
    kept = fi.chart_filter(t.orders, [
        fi.year_is(F.year("o_orderdate"), 1997), fi.in_range(F.col("o_totalprice"), 50000, 150000.5), fi.value_is(F.col("o_orderpriority"), "2-HIGH")])
    return kept.select("o_orderkey", "o_totalprice", "o_orderpriority")


@query("f2_open_range", "SELECT o_orderkey FROM orders WHERE o_totalprice >= 400000")
def _open_range(t: Tables):
    return fi.chart_filter(t.orders, [fi.in_range(F.col("o_totalprice"), 400000, None)]).select("o_orderkey")


@query("f2_top_label_filter", f"""
    SELECT o_orderkey AS song_id, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE 'A' || o_custkey % 3 END AS artist FROM orders WHERE (o_orderstatus = 'P') AND o_orderkey IN (
        SELECT song_id FROM (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY score DESC, label) AS rank FROM ({LABELS_SQL})) WHERE rank <= 3 AND label = 'P' || 7 % 7 || '---D7')""")
def _top_label(t: Tables):
    songs = t.orders.select(F.col("o_orderkey").alias("song_id"), F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("A"), F.col("o_custkey") % 3)).alias("artist"))
    return fi.among_top_labels(fi.chart_filter(songs, [fi.artist_is(F.col("artist"), "Unknown")]), labels_from_lineitem(t), "P0---D7", 3)


@query("f2_dominant_mood", """
    SELECT o_orderkey AS song_id FROM (SELECT o_orderkey, o_custkey % 7 AS happy, o_orderkey % 7 AS sad, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_custkey % 5 END AS party FROM orders)
    WHERE sad > happy AND (party IS NULL OR sad >= party)""")
def _dominant_mood(t: Tables):
    songs = t.orders.select(F.col("o_orderkey").alias("song_id"), (F.col("o_custkey") % 7).cast("double").alias("happy"), (F.col("o_orderkey") % 7).cast("double").alias("sad"),
                            F.when(F.col("o_orderstatus") != "P", F.col("o_custkey") % 5).cast("double").alias("party"))
    return fi.dominant_mood_is(songs, ["happy", "sad", "party"], "sad").select("song_id")


@query("f3_threshold_filter", """
    WITH s AS (SELECT min(p_size) AS slo, max(p_size) AS shi, min(p_retailprice) AS rlo, max(p_retailprice) AS rhi FROM part)
    SELECT p_partkey FROM part, s WHERE (p_size - slo)::DOUBLE / (shi - slo) >= 0.4 AND (p_retailprice - rlo) / (rhi - rlo) >= 0.25""")
def _threshold_filter(t: Tables):
    axes = ["p_size", "p_retailprice"]
    rows = t.part.withColumn("_s", ag.axis_stats_row(t.part, axes))
    normalised = {a: nu.minmax(F.col(a).cast("double"), F.col(f"_s.{a}.lo"), F.col(f"_s.{a}.hi")) for a in axes}
    return fi.threshold_filter(rows, normalised, {"p_size": 0.4, "p_retailprice": 0.25}).select("p_partkey")


@query("f4_label_filter", """
    SELECT l_orderkey AS song_id FROM lineitem GROUP BY l_orderkey
    HAVING max(CASE WHEN l_returnflag = 'A' AND l_discount >= 0.05 THEN 1 ELSE 0 END) = 1
       AND max(CASE WHEN l_returnflag = 'R' AND l_discount >= 0.02 THEN 1 ELSE 0 END) = 1""")
def _label_filter(t: Tables):
    labels = t.lineitem.select(F.col("l_orderkey").alias("song_id"), F.col("l_returnflag").alias("label"), F.col("l_discount").alias("score"))
    return fi.label_filter(labels, {"A": 0.05, "R": 0.02})


@query("f5_mood_filter", "SELECT l_orderkey, l_linenumber, l_tax FROM lineitem WHERE l_tax >= 0.07")
def _mood_filter(t: Tables):
    return fi.mood_filter(t.lineitem, "l_tax", 0.07, known=["l_tax", "l_discount"]).select("l_orderkey", "l_linenumber", "l_tax")


@query("f6_valid_series", """
    SELECT count(*) FILTER (WHERE text <> '' AND n_chars > 200) AS used, count(*) FILTER (WHERE NOT (text <> '' AND n_chars > 200)) AS skipped FROM documents""")
def _valid_series(t: Tables):
    series = F.when(F.col("text") != "", F.array(F.length("text").cast("double"))).otherwise(F.array().cast("array<double>"))
    return fi.skipped_series_count(t.documents.select(series.alias("values"), (F.col("n_chars") - 200).alias("duration_seconds")))


@query("f7_plausible_track", """
    SELECT event_id FROM events WHERE event_type NOT IN ('error', 'signup') AND CAST(trunc(value) AS INTEGER) BETWEEN 45 AND 600""")
def _plausible_track(t: Tables):
    live = F.when(F.col("event_type") == "error", "is_live").when(F.col("event_type") == "signup", "is_upcoming")
    return fi.plausible_track(t.events.select("event_id", live.alias("live_status"), F.col("value").alias("duration"))).select("event_id")


_HITS_SQL = """
    SELECT o_orderkey AS video_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'Some Artist - Topic' ELSE 'Clerk' END AS uploader FROM orders"""
_VERDICT_SQL = """
    SELECT l_orderkey AS video_id, CASE WHEN max(l_returnflag) = 'N' THEN 'not_music' ELSE 'music' END AS verdict
    FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_orderkey"""


def _hits(t: Tables):
    hits = t.orders.select(F.col("o_orderkey").alias("video_id"), F.when(F.col("o_orderpriority") == "1-URGENT", "Some Artist - Topic").otherwise("Clerk").alias("uploader"))
    verdicts = t.lineitem.filter("l_returnflag <> 'R'").groupBy(F.col("l_orderkey").alias("video_id")).agg(
        F.when(F.max("l_returnflag") == "N", "not_music").otherwise("music").alias("verdict"))
    return hits, verdicts


@query("f8_keep_music_lenient", f"""
    SELECT video_id FROM ({_HITS_SQL}) LEFT JOIN ({_VERDICT_SQL}) USING (video_id)
    WHERE uploader LIKE '% - Topic' OR coalesce(verdict, 'unknown') <> 'not_music'""")
def _keep_music_lenient(t: Tables):
    return fi.keep_music(*_hits(t), strict=False).select("video_id")


@query("f8_keep_music_strict", f"""
    SELECT video_id FROM ({_HITS_SQL}) LEFT JOIN ({_VERDICT_SQL}) USING (video_id)
    WHERE uploader LIKE '% - Topic' OR verdict = 'music'""")
def _keep_music_strict(t: Tables):
    return fi.keep_music(*_hits(t), strict=True).select("video_id")


_LABELLED_SQL = "SELECT d.doc_id, d.lang, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)"


def _labelled(t: Tables):
    rows = t.documents.join(t.labels, "doc_id", "left")
    return rows.select(
        F.col("doc_id").alias("song_id"), F.col("lang").alias("artist"), F.col("source").alias("title"),
        F.when(F.col("quality") == 1, F.col("source")).alias("recording_id"), (F.col("toxic") == 1).alias("reviewed"))


@query("f9_missing_identity", f"""
    SELECT doc_id AS song_id, lang AS artist, source AS title FROM ({_LABELLED_SQL})
    WHERE coalesce(quality, 0) <> 1 AND coalesce(toxic, 0) <> 1""")
def _missing_identity(t: Tables):
    return fi.missing_identity(_labelled(t)).select("song_id", "artist", "title")


@query("f10_verification_status", f"""
    SELECT CASE WHEN quality = 1 THEN 'acoustid' WHEN toxic = 1 THEN 'reviewed' ELSE 'unverified' END AS status, count(*) AS n
    FROM ({_LABELLED_SQL}) GROUP BY 1""")
def _verification(t: Tables):
    return _labelled(t).groupBy(fi.verification_status(F.col("recording_id"), F.col("reviewed")).alias("status")).agg(F.count("*").alias("n"))


@query("f11_duration_gate", """
    SELECT o_orderkey AS file_id, CASE WHEN o_totalprice / 500 > 600 AND NOT coalesce(best >= 0.5, false) THEN 'too_long_unrecognized' END AS skip_reason
    FROM orders LEFT JOIN (SELECT l_orderkey, max(l_discount * 6) AS best FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey""")
def _duration_gate(t: Tables):
    files = t.orders.select(F.col("o_orderkey").alias("file_id"), (F.col("o_totalprice") / 500).alias("duration_seconds"))
    matches = t.lineitem.select(F.col("l_orderkey").alias("file_id"), (F.col("l_discount") * 6).alias("score"))
    return fi.duration_gate(files, matches).select("file_id", "skip_reason")


@query("f12_identity_verdict", """
    SELECT l_orderkey, l_linenumber, l_partkey, CASE
        WHEN l_tax > 0.01 AND l_returnflag = 'A' AND l_quantity < 10 THEN 'mismatch'
        WHEN l_tax > 0.01 AND NOT (l_returnflag = 'A' OR l_quantity > 45 OR (l_linestatus = 'O' AND l_discount * 10 >= 0.9)) THEN 'unverified'
        WHEN l_suppkey % 10 = 0 THEN 'needs_metadata' WHEN l_partkey % 5 = 0 THEN 'duplicate' ELSE 'accept' END AS verdict
    FROM lineitem""")
def _identity_verdict(t: Tables):
    verdict = fi.identity_verdict(
        recognised=F.col("l_returnflag") == "A", matches_expected=F.col("l_quantity") >= 10, trusted=F.col("l_quantity") > 45,
        own_channel=F.col("l_linestatus") == "O", unlinked_score=F.col("l_discount") * 10, has_names=F.col("l_suppkey") % 10 != 0,
        already_saved=F.col("l_partkey") % 5 == 0, expected=F.col("l_tax") > 0.01)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", verdict.alias("verdict"))


@query("f13_scatter", f"""
    SELECT p_partkey AS song_id, CAST(p_size AS DOUBLE) AS x, {sql_round('p_retailprice / (p_size - 7)', 6)} AS y, l_suppkey AS neighbor_id
    FROM part LEFT JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_quantity >= 49) ON l_partkey = p_partkey
    WHERE p_size <> 7""")
def _scatter(t: Tables):
    songs = t.part.select(F.col("p_partkey").alias("song_id"), F.col("p_size").cast("double").alias("x"), F.try_divide("p_retailprice", F.col("p_size") - 7).alias("y"))
    edges = t.lineitem.select(key_if("l_quantity >= 49", "l_partkey").alias("song_id"), F.col("l_suppkey").alias("neighbor_id")).distinct()
    return fi.scatter_with_neighbours(songs, edges, "x", "y").withColumn("y", F.round(F.round("y", 12), 6))


@query("f14_hide_genres", f"""
    SELECT top_genre, count(*) AS n FROM ({SONGS_SQL}) WHERE top_genre IS NULL OR top_genre NOT IN ('SMALL', 'ECONOMY') GROUP BY top_genre""")
def _hide_genres(t: Tables):
    return fi.hide_genres(songs_from_part(t), ["SMALL", "ECONOMY"]).groupBy("top_genre").agg(F.count("*").alias("n"))


_PLAYLISTS_SQL = """
    SELECT c_custkey AS playlist_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'liked' WHEN 'MACHINERY' THEN 'album' ELSE 'playlist' END AS kind,
           c_acctbal > 5000 AS collaborative, CASE WHEN c_mktsegment = 'HOUSEHOLD' AND c_nationkey < 10 THEN 'The ' || c_name END AS artists, c_name AS name
    FROM customer"""


def _playlists(t: Tables):
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "liked").when(F.col("c_mktsegment") == "MACHINERY", "album").otherwise("playlist")
    artists = F.when((F.col("c_mktsegment") == "HOUSEHOLD") & (F.col("c_nationkey") < 10), F.concat(F.lit("The "), F.col("c_name")))
    return t.customer.select(F.col("c_custkey").alias("playlist_id"), kind.alias("kind"), (F.col("c_acctbal") > 5000).alias("collaborative"), artists.alias("artists"), F.col("c_name").alias("name"))


@query("f15_playlist_section", f"""
    SELECT CASE WHEN kind = 'liked' OR (kind = 'playlist' AND artists IS NULL AND NOT collaborative) THEN 'own'
                WHEN kind = 'playlist' AND artists IS NULL THEN 'shared' ELSE 'albums' END AS section, count(*) AS n
    FROM ({_PLAYLISTS_SQL}) WHERE contains(lower(name), '00004') OR contains(lower(coalesce(artists, '')), 'the customer') GROUP BY 1""")
def _playlist_section(t: Tables):
    rows = _playlists(t)
    found = fi.search_playlists(rows, "00004").unionByName(fi.search_playlists(rows, "The Customer")).distinct()
    return found.groupBy(fi.playlist_section(F.col("kind"), F.col("collaborative"), F.col("artists")).alias("section")).agg(F.count("*").alias("n"))


@query("f16_error_kind", """
    WITH m AS (SELECT doc_id, lower(text) AS x FROM documents), k AS (SELECT doc_id, CASE
        WHEN contains(x, '403') OR contains(x, 'forbidden') OR contains(x, '429') OR contains(x, 'too many requests') THEN 'rate_limited'
        WHEN contains(x, 'not available in your country') OR contains(x, 'geo') THEN 'geo_blocked'
        WHEN contains(x, 'not a bot') THEN 'bot_check'
        WHEN contains(x, 'age') AND (contains(x, 'confirm') OR contains(x, 'restrict') OR contains(x, 'sign in')) THEN 'age_restricted'
        WHEN contains(x, 'not available') OR contains(x, 'private') OR contains(x, 'removed') OR contains(x, 'terminated') THEN 'unavailable'
        WHEN contains(x, 'resolve') OR contains(x, 'connection') OR contains(x, 'timed out') OR contains(x, 'network') THEN 'network'
        ELSE 'unknown' END AS kind FROM m)
    SELECT doc_id, kind, kind IN ('rate_limited', 'network') AS retryable,
        CASE WHEN kind = 'unknown' THEN 'unknown' WHEN kind IN ('rate_limited', 'bot_check', 'network') THEN 'global' ELSE 'video' END AS scope FROM k""")
def _error_kind(t: Tables):
    return fi.with_error_kind(t.documents.select("doc_id", F.col("text").alias("message")), "message").drop("message")


_FAILURES_SQL = """
    SELECT event_id AS id, CASE event_type WHEN 'error' THEN 'duplicate' WHEN 'click' THEN 'download_error: HTTP ' || CAST(user_id AS VARCHAR)
        WHEN 'view' THEN 'write_error' WHEN 'purchase' THEN 'Traceback: ' || props ELSE '' END AS reason,
        CASE WHEN value > 20 THEN 'value ' || props END AS message FROM events"""


def failure_results(t: Tables):
    kind = F.col("event_type")
    reason = F.when(kind == "error", "duplicate").when(kind == "click", F.concat(F.lit("download_error: HTTP "), F.col("user_id").cast("string"))).when(
        kind == "view", "write_error").when(kind == "purchase", F.concat(F.lit("Traceback: "), F.col("props"))).otherwise("")
    return t.events.select(F.col("event_id").alias("id"), reason.alias("reason"), F.when(F.col("value") > 20, F.concat(F.lit("value "), F.col("props"))).alias("message"))


REASONS_SQL = f"""
    SELECT id, CASE WHEN reason = 'duplicate' THEN reason WHEN reason LIKE 'download_error%' OR reason LIKE 'write_error%' THEN split_part(reason, ':', 1) ELSE 'error' END AS reason,
        nullif(concat_ws(' — ', CASE WHEN reason = 'duplicate' OR reason = 'write_error' THEN NULL WHEN reason LIKE 'download_error%' THEN trim(substr(reason, 16))
            WHEN reason = '' THEN 'unknown' ELSE reason END, message), '') AS detail
    FROM ({_FAILURES_SQL})"""


@query("f17_failure_reason", REASONS_SQL)
def _failure_reason(t: Tables):
    return failure_results(t).select("id", fi.failure_reason(F.col("reason"), F.col("message")).alias("_f")).select("id", "_f.reason", "_f.detail")


@query("f18_recent_failures", f"SELECT id, reason, detail FROM ({REASONS_SQL}) WHERE reason = 'download_error' ORDER BY id DESC LIMIT 200")
def _recent_failures(t: Tables):
    return fi.recent_failures(_failure_reason(t), "download_error")


@query("w1_top_n_labels", f"""
    SELECT song_id, label, {sql_round('score', 6)} AS score, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY score DESC, label) AS rank FROM ({LABELS_SQL})) WHERE rank <= 3""")
def _top_labels(t: Tables):
    return fi.dominant_labels(labels_from_lineitem(t), 3).withColumn("score", F.round(F.round("score", 12), 6))
