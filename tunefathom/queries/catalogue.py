"""Identity, album and metadata choice on catalogue tables derived from orders and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from tunefathom.operators import catalogue as ca
from tunefathom.queries.registry import Tables, key_if, query

# --- identity ---------------------------------------------------------------------


@query("e1_resolve_identity", """
    WITH o AS (SELECT o_orderkey AS file_id, 'Title ' || o_orderkey AS title, 'Artist ' || o_custkey AS artist, o_orderstatus AS s, o_orderpriority AS p FROM orders)
    SELECT file_id, title, artist, CASE WHEN s = 'F' THEN 'acoustid' WHEN p <> '5-LOW' THEN 'hint' ELSE 'file_tags' END AS source, CASE WHEN s = 'F' THEN 'rec' || file_id END AS recording_id, CASE WHEN s = 'F' AND file_id % 4 > 0 THEN 'Guest''s' ELSE '' END AS featured
    FROM o WHERE s = 'F' OR p <> '5-LOW' OR file_id % 3 > 0""")
def _resolve(t: Tables):
    k = F.col("o_orderkey")
    title, artist = F.concat(F.lit("Title "), k), F.concat(F.lit("Artist "), F.col("o_custkey"))
    rows = t.orders.select(k.alias("file_id"), title.alias("title"), artist.alias("artist"), "o_orderstatus", "o_orderpriority")
    fingerprints = rows.filter("o_orderstatus <> 'O'").select(
        "file_id", F.concat("title", F.lit(" (2011 Remaster)")).alias("title"), F.when(F.col("o_orderstatus") == "F", F.col("artist")).alias("artist"), F.concat(F.lit("rec"), "file_id").alias("recording_id"),
        F.when(F.col("file_id") % 4 > 0, F.array(F.upper("artist"), F.lit("Guest’s"))).alias("featured"))
    hints = rows.select("file_id", F.concat(F.lit("  "), "title", F.lit(" - Live")).alias("title"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("artist")).otherwise("  ").alias("artist"), F.lit("hint").alias("source"))
    tags = rows.select("file_id", F.when(F.col("file_id") % 3 > 0, F.concat("title", F.lit(" "))).otherwise("").alias("title"), "artist")
    return ca.resolve_identity(fingerprints, hints, tags).withColumn("featured", F.array_join("featured", "+"))


@query("e2_pick_recording", """
    WITH r AS (SELECT DISTINCT l_orderkey AS file_id, l_partkey * 1000 + l_suppkey AS recording_id, l_partkey % 3 AS k, l_suppkey % 4 AS g, l_partkey % 50 AS sources, l_suppkey % 2 AS paren FROM lineitem),
    x AS (SELECT *, 'Name ' || k || CASE WHEN paren = 1 THEN ' (Take)' ELSE '' END AS title,
        CASE WHEN file_id % 3 > 0 AND k = file_id % 3 AND paren = 0 THEN 0 ELSE 1 END AS a, CASE WHEN file_id % 5 = 0 OR g = 0 OR g = file_id % 4 THEN 0 ELSE 1 END AS b FROM r)
    SELECT file_id, recording_id, title FROM x QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY a, b, sources DESC, paren, recording_id) = 1""")
def _pick_recording(t: Tables):
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    rows = t.lineitem.select(
        F.col("l_orderkey").alias("file_id"), (part * 1000 + supp).alias("recording_id"), (part % 50).alias("sources"),
        F.concat(F.lit("Name "), (part % 3).cast("string"), F.when(supp % 2 == 1, " (Take)").otherwise("")).alias("title"),
        F.when(supp % 4 > 0, F.array(F.concat(F.lit("G"), (supp % 4).cast("string")))).alias("guests")).distinct()
    wanted = t.orders.select(
        F.col("o_orderkey").alias("file_id"), F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("name... "), (F.col("o_orderkey") % 3).cast("string"))).alias("preferred_title"),
        F.when(F.col("o_orderkey") % 5 > 0, F.concat(F.lit("Video feat. G"), (F.col("o_orderkey") % 4).cast("string"))).alias("source_text"))
    return ca.pick_recording(rows.withColumn("position", F.col("recording_id")), wanted)


@query("e3_best_match", """
    WITH r AS (SELECT l_orderkey AS file_id, l_partkey * 1000 + l_suppkey AS result_id, max(l_extendedprice / 105000) AS score, max(l_linenumber % 2) AS recordings FROM lineitem GROUP BY 1, 2),
    b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY score DESC, result_id) = 1)
    SELECT file_id, CASE WHEN recordings > 0 THEN result_id END AS result_id, CASE WHEN recordings = 0 THEN score END AS unlinked_score FROM b WHERE score >= 0.5""")
def _best_match(t: Tables):
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("file_id"), (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("result_id")).agg(
        F.max(F.col("l_extendedprice") / 105000).alias("score"), F.max(F.col("l_linenumber") % 2).alias("recordings"))
    return ca.best_match(rows.withColumn("position", F.col("result_id")))


_COMPOSER_SQL = "SELECT DISTINCT l_orderkey AS recording_id, l_partkey AS work_id FROM lineitem"


def _composer_rows(t: Tables):
    performances = t.lineitem.select(F.col("l_orderkey").alias("recording_id"), F.col("l_partkey").alias("work_id"), F.col("l_partkey").alias("work_pos")).distinct()
    credits = t.part.select(F.col("p_partkey").alias("work_id"), F.explode(F.array(
        F.struct(F.lit(0).alias("credit_pos"), F.concat(F.lit("Johann "), F.translate("p_brand", "#", "")).alias("composer")),
        F.struct(F.lit(1).alias("credit_pos"), F.concat(F.lit("Maria "), F.col("p_type")).alias("composer")))).alias("_c")).select("work_id", "_c.*")
    return ca.composers(performances, credits)


@query("e5_composers", f"""
    WITH c AS (SELECT recording_id, work_id AS work_pos, unnest([0, 1]) AS credit_pos, unnest(['Johann ' || replace(p_brand, '#', ''), 'Maria ' || p_type]) AS composer FROM ({_COMPOSER_SQL}) JOIN part ON p_partkey = work_id)
    SELECT recording_id, composer, work_pos, credit_pos FROM c QUALIFY row_number() OVER (PARTITION BY recording_id, composer ORDER BY work_pos, credit_pos) = 1""")
def _composers(t: Tables):
    return _composer_rows(t)


@query("e4_composer_credit", f"""
    WITH c AS (SELECT DISTINCT recording_id, 'Johann ' || replace(p_brand, '#', '') AS composer FROM ({_COMPOSER_SQL}) JOIN part ON p_partkey = work_id),
    i AS (SELECT o_orderkey AS file_id, o_orderkey AS recording_id, 'Piece' AS title, CASE WHEN o_orderstatus = 'P' THEN 'Johann Brand' || (o_custkey % 25 + 1) ELSE 'Pianist' END AS artist, 'Brand' || (o_custkey % 25 + 1) AS named FROM orders)
    SELECT i.file_id, i.recording_id, i.title, CASE WHEN artist = 'Pianist' AND composer IS NOT NULL THEN composer ELSE artist END AS artist,
        CASE WHEN artist = 'Pianist' AND composer IS NOT NULL THEN 'Pianist+Orchestra' ELSE 'Orchestra' END AS featured
    FROM i LEFT JOIN c ON c.recording_id = i.recording_id AND c.composer = 'Johann ' || named""")
def _composer_credit(t: Tables):
    named = F.concat(F.lit("Brand"), (F.col("o_custkey") % 25 + 1).cast("string"))
    identities = t.orders.select(
        F.col("o_orderkey").alias("file_id"), F.col("o_orderkey").alias("recording_id"), F.lit("Piece").alias("title"),
        F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("Johann "), named)).otherwise("Pianist").alias("artist"), F.array(F.lit("Orchestra")).alias("featured"))
    expected = t.orders.select(F.col("o_orderkey").alias("file_id"), F.posexplode(F.array(F.lit("Nobody Here"), F.upper(named))).alias("name_pos", "name"))
    return ca.composer_credit(identities, expected, _composer_rows(t)).withColumn("featured", F.array_join("featured", "+"))


@query("e4_composer_prefix", """
    SELECT p_partkey, CASE WHEN p_size > 30 THEN p_name ELSE NULL END AS title, CASE WHEN p_size > 30 THEN p_brand END AS artist, CASE WHEN p_size > 30 THEN 'Pianist' END AS performer FROM part""")
def _composer_prefix(t: Tables):
    title = F.when(F.col("p_size") % 2 == 0, F.concat("p_brand", F.lit(" - "), "p_name")).otherwise(F.concat("p_brand", F.lit(": "), "p_name"))
    named = F.when(F.col("p_size") > 30, F.array(F.lit("Someone"), F.concat(F.lit("First "), "p_brand"))).otherwise(F.array(F.lit("Someone")))
    return t.part.select("p_partkey", ca.composer_prefix(title, F.lit("Pianist"), named).alias("_c")).select("p_partkey", "_c.title", "_c.artist", "_c.performer")


def _name_hits(t: Tables):
    """Search hits per order: same song in several spellings and by several artists."""
    k = F.col("l_linenumber")
    artist = F.when(k.isin(1, 2), "Lady Gaga").when(k == 3, "Bradley").when(k == 4, "Lady Gaga, Bradley Cooper").when(k == 5, "Ensemble").otherwise("Lady")
    sort_name = F.when(k == 5, "Lady Gaga Bradley Cooper, The").otherwise("x")
    title = F.when(F.col("l_returnflag") == "A", "SHALLOW").when(F.col("l_returnflag") == "N", "Shállow (Remastered 2012)").otherwise("Other Song")
    return t.lineitem.groupBy(F.col("l_orderkey").alias("query_id"), (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("position")).agg(
        F.min(F.struct(k.alias("k"), title.alias("hit_title"), artist.alias("hit_artist"), sort_name.alias("sort_name"), (F.col("l_quantity") * 2).cast("int").alias("score"))).alias("_h")).select(
        "query_id", "position", "_h.hit_title", "_h.hit_artist", "_h.sort_name", "_h.score", "_h.k")


_NAME_HITS_SQL = """
    SELECT query_id, position, h.k AS k, h.hit_title AS hit_title, h.score AS score, CASE WHEN h.k = 4 THEN 0 WHEN h.k = 5 THEN 1 WHEN h.k IN (1, 2, 6, 7) THEN 2 END AS fit,
        CASE h.k WHEN 1 THEN 'Lady Gaga' WHEN 2 THEN 'Lady Gaga' WHEN 3 THEN 'Bradley' WHEN 4 THEN 'Lady Gaga, Bradley Cooper' WHEN 5 THEN 'Ensemble' ELSE 'Lady' END AS artist FROM (
        SELECT l_orderkey AS query_id, l_partkey * 1000 + l_suppkey AS position, min({'k': l_linenumber, 'hit_title': CASE l_returnflag WHEN 'A' THEN 'SHALLOW' WHEN 'N' THEN 'Shállow' ELSE 'Other Song' END,
            'score': CAST(l_quantity * 2 AS INTEGER)}) AS h FROM lineitem GROUP BY 1, 2)"""


@query("e6_canonical_name", f"""
    SELECT query_id, hit_title AS title, artist FROM ({_NAME_HITS_SQL}) WHERE fit IS NOT NULL AND hit_title <> 'Other Song'
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY fit, CASE hit_title WHEN 'SHALLOW' THEN 1 ELSE 2 END, position) = 1""")
def _canonical(t: Tables):
    queries = t.orders.select(F.col("o_orderkey").alias("query_id"), F.lit("Shallow").alias("title"), F.lit("lady gaga, Bradley Cooper").alias("artist"))
    return ca.canonical_name(queries, _name_hits(t))


@query("e10_search_candidates", f"""
    SELECT query_id, position, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, position) AS place FROM ({_NAME_HITS_SQL}) WHERE fit IS NOT NULL AND score >= 70""")
def _search_candidates(t: Tables):
    queries = t.orders.select(F.col("o_orderkey").alias("query_id"), F.lit("Lady Gaga & Bradley Cooper").alias("artist"))
    return ca.search_candidates(queries, _name_hits(t)).select("query_id", "position", "score", "place")


# --- albums -----------------------------------------------------------------------

def _releases(t: Tables):
    """Orders as releases: the customer is the song, customer and year the release group."""
    k, year = F.col("o_orderkey"), F.year("o_orderdate")
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "Album").when(F.col("o_orderpriority") == "2-HIGH", "EP").when(F.col("o_orderpriority") == "3-MEDIUM", "Single").when(
        F.col("o_orderpriority") == "4-NOT SPECIFIED", "Broadcast")
    song = F.concat(F.lit("Song "), "o_custkey")
    return t.orders.select(
        F.col("o_custkey").alias("song_id"), song.alias("song_title"), F.lit("Singer").alias("song_artist"), F.concat_ws("-", "o_custkey", year).alias("group_id"),
        F.when(year % 4 == 0, F.concat(song, F.lit(" (Radio Edit)"))).when(year % 5 == 0, "The Very Best 90s").when(year % 5 == 1, "Essential Songs").otherwise(F.concat(F.lit("Album "), year)).alias("group_title"),
        F.lit("x").alias("release_title"), kind.alias("primary_type"),
        F.when(k % 5 == 0, F.array(F.lit("Live"))).when(k % 5 == 1, F.array(F.lit("Soundtrack"))).alias("secondary_types"),
        F.when(F.col("o_orderstatus") == "P", "Bootleg").otherwise("Official").alias("status"),
        F.when(k % 6 > 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"), F.when(k % 7 == 0, "Various Artists").when(k % 7 == 1, "SINGER").alias("release_artist"))


_CANDIDATES_SQL = """
    SELECT * FROM (SELECT o_custkey AS song_id, o_custkey || '-' || year(o_orderdate) AS group_id, CASE WHEN year(o_orderdate) % 4 = 0 THEN 'Song ' || o_custkey || ' (Radio Edit)' WHEN year(o_orderdate) % 5 = 0 THEN 'The Very Best 90s'
        WHEN year(o_orderdate) % 5 = 1 THEN 'Essential Songs' ELSE 'Album ' || year(o_orderdate) END AS title, CASE WHEN year(o_orderdate) % 4 = 0 THEN 0 ELSE 1 END AS other,
        CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 END AS rank,
        CASE WHEN o_orderkey % 6 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '9999' END AS date, o_orderkey % 5 AS secondary, o_orderkey % 7 AS credit, o_orderstatus AS status FROM orders)
    WHERE rank IS NOT NULL AND status <> 'P' AND secondary > 0 AND credit > 0 AND title NOT IN ('Essential Songs', 'The Very Best 90s')"""
_DEBUT_SQL = f"SELECT song_id, group_id, min(CAST(substr(date, 1, 4) AS INTEGER)) AS first_year FROM ({_CANDIDATES_SQL}) WHERE date <> '9999' GROUP BY 1, 2"
_NEAR_SQL = f"""
    WITH c AS ({_CANDIDATES_SQL}), d AS ({_DEBUT_SQL}), s AS (SELECT song_id, min(first_year) AS debut FROM d GROUP BY 1)
    SELECT c.* FROM c LEFT JOIN d USING (song_id, group_id) LEFT JOIN s ON s.song_id = c.song_id WHERE debut IS NULL OR first_year - debut <= 1"""


@query("e7_album_candidates", f"SELECT song_id, group_id, title, rank, date FROM ({_CANDIDATES_SQL})")
def _candidates(t: Tables):
    return ca.album_candidates(_releases(t)).select("song_id", "group_id", "title", "rank", "date")


@query("e7_no_soundtracks", f"SELECT song_id, group_id, title, rank, date FROM ({_CANDIDATES_SQL}) WHERE secondary > 1")
def _no_soundtracks(t: Tables):
    return ca.album_candidates(_releases(t), allow_soundtracks=False).select("song_id", "group_id", "title", "rank", "date")


@query("a34_group_debut", f"""
    SELECT d.song_id, d.group_id, CAST(coalesce(CASE WHEN d.first_year % 2 = 1 THEN d.first_year - 3 END, d.first_year) AS INTEGER) AS first_year FROM ({_DEBUT_SQL}) d""")
def _debut(t: Tables):
    known = t.orders.select(F.concat_ws("-", "o_custkey", F.year("o_orderdate")).alias("group_id"), F.year("o_orderdate").alias("y")).distinct().select(
        "group_id", F.when(F.col("y") % 2 == 1, F.concat((F.col("y") - 3).cast("string"), F.lit("-05"))).otherwise("unknown").alias("first_release_date"))
    return ca.group_debut(ca.album_candidates(_releases(t)), known)


@query("e8_near_debut", f"SELECT song_id, group_id, date FROM ({_NEAR_SQL})")
def _near(t: Tables):
    return ca.near_debut(ca.album_candidates(_releases(t))).select("song_id", "group_id", "date")


@query("e9_pick_album", f"""
    SELECT song_id, group_id, title AS album FROM ({_NEAR_SQL}) QUALIFY row_number() OVER (PARTITION BY song_id ORDER BY rank, other, date, group_id) = 1""")
def _pick_album(t: Tables):
    return ca.pick_album(ca.near_debut(ca.album_candidates(_releases(t))))


@query("e9_album_from_search", f"""
    WITH n AS ({_NEAR_SQL}), c AS (SELECT *, count(*) OVER (PARTITION BY song_id, group_id) AS releases FROM n)
    SELECT song_id, group_id, title AS album FROM c WHERE releases >= 2 QUALIFY row_number() OVER (PARTITION BY song_id ORDER BY rank, other, releases DESC, date, group_id) = 1""")
def _album_search(t: Tables):
    return ca.pick_album(ca.near_debut(ca.album_candidates(_releases(t))), min_releases=2, count_releases=True)


# --- tags and providers -----------------------------------------------------------

_TAGS_SQL = """
    SELECT l_orderkey AS recording_id, CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END AS tier, l_partkey * 1000 + l_suppkey AS position, 'tag' || (l_partkey % 9) AS name, max(CAST(l_quantity AS INTEGER)) AS count
    FROM lineitem GROUP BY ALL"""


def _tags(t: Tables):
    return t.lineitem.groupBy(
        F.col("l_orderkey").alias("recording_id"), F.when(F.col("l_linestatus") == "O", 0).otherwise(1).alias("tier"), (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("position"),
        F.concat(F.lit("tag"), (F.col("l_partkey") % 9).cast("string")).alias("name")).agg(F.max(F.col("l_quantity").cast("int")).alias("count"))


@query("a32_tag_genres", f"""
    WITH o AS (SELECT * FROM ({_TAGS_SQL}) QUALIFY row_number() OVER (PARTITION BY recording_id, name ORDER BY tier, position) = 1)
    SELECT recording_id, name, count, row_number() OVER (PARTITION BY recording_id ORDER BY count DESC, tier, position) AS place FROM o QUALIFY place <= 10""")
def _tag_genres(t: Tables):
    return ca.tag_genres(_tags(t))


@query("e11_first_with_genres", """
    WITH l AS (SELECT o_custkey AS song_id, o_orderkey AS position, o_orderpriority = '3-MEDIUM' AS has, CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN strftime(o_orderdate, '%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d,
        CASE WHEN o_orderkey % 4 = 1 THEN 'alb' || o_orderkey END AS album_id, 'guest' || o_orderkey AS featured FROM orders),
    u AS (SELECT * FROM (SELECT *, min(position) FILTER (WHERE has) OVER (PARTITION BY song_id) AS stop FROM l) WHERE stop IS NULL OR position <= stop)
    SELECT song_id, min(position) FILTER (WHERE has) AS genre_recording_id, coalesce(min(d) FILTER (WHERE length(d) = 10), min(d)) AS release_date, arg_min(featured, position) AS featured,
        arg_min(album_id, position) FILTER (WHERE album_id IS NOT NULL) AS album_id FROM u GROUP BY song_id""")
def _first_genres(t: Tables):
    k = F.col("o_orderkey")
    date = F.when(k % 3 == 1, F.date_format("o_orderdate", "yyyy")).when(k % 3 == 2, F.date_format("o_orderdate", "yyyy-MM-dd"))
    lookups = t.orders.select(F.col("o_custkey").alias("song_id"), k.alias("position"), k.alias("recording_id"), date.alias("release_date"), F.concat(F.lit("guest"), k).alias("featured"),
                              F.when(k % 4 == 1, F.concat(F.lit("alb"), k)).otherwise("").alias("album_id"), F.lit("Album").alias("album"))
    genres = t.orders.select(key_if("o_orderpriority = '3-MEDIUM'", "o_orderkey").alias("recording_id"), F.lit(1).alias("place"), F.lit("rock").alias("name"))
    return ca.first_with_genres(lookups, genres).drop("album")


@query("e12_provider_track", """
    WITH h AS (SELECT l_orderkey AS query_id, l_partkey * 1000 + l_suppkey AS position, min(l_linenumber) AS k, min(l_shipdate) AS d, min(l_returnflag) AS f FROM lineitem GROUP BY 1, 2),
    m AS (SELECT *, CASE k WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 3 ELSE 99 END AS rank, CASE WHEN f = 'N' THEN strftime(d, '%Y') ELSE strftime(d, '%Y-%m-%d') END AS date FROM h WHERE k <> 6)
    SELECT query_id, arg_min('t' || position, (rank, date, position)) AS track_id, arg_min_null(CASE WHEN k = 7 THEN NULL ELSE 'Album ' || k END, (rank, date, position)) AS album, min(date) FILTER (WHERE f = 'A') AS release_date,
        arg_min(CASE WHEN k % 2 = 0 THEN 'G' || k ELSE '' END, (rank, date, position)) AS featured
    FROM m GROUP BY query_id""")
def _provider(t: Tables):
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("query_id"), (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("position")).agg(
        F.min("l_linenumber").alias("k"), F.min("l_shipdate").alias("d"), F.min("l_returnflag").alias("f"))
    k, f = F.col("k"), F.col("f")
    hits = rows.select(
        "query_id", "position", F.concat(F.lit("t"), "position").alias("track_id"), F.when(k == 6, "Zzz").when(k == 5, "The Long Song Titel!").otherwise("the long song title, deluxe").alias("hit_title"),
        F.when(k == 7, "").otherwise(F.concat(F.lit("Album "), k)).alias("album"), F.when(k == 1, "album").when(k == 2, "single").when(k == 3, "ep").when(k == 4, "compilation").otherwise("other").alias("album_type"),
        F.when(f == "N", F.date_format("d", "yyyy")).otherwise(F.date_format("d", "yyyy-MM-dd")).alias("release_date"), F.when(f == "A", "day").otherwise("year").alias("release_precision"),
        F.when(k % 2 == 0, F.array(F.lit("Main"), F.concat(F.lit("G"), k), F.lit(""))).otherwise(F.array(F.lit("Main"))).alias("artists"))
    queries = t.orders.select(F.col("o_orderkey").alias("query_id"), F.lit("The Long Song Title").alias("title"))
    return ca.provider_track(queries, hits).withColumn("featured", F.array_join("featured", "+"))


@query("e13_merge_metadata", """
    WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_orderdate AS d, o_orderpriority = '1-URGENT' AS found FROM orders)
    SELECT k AS file_id, CASE WHEN s = 'F' THEN 'acoustid' ELSE 'hint' END AS source,
        concat_ws('+', CASE WHEN s = 'F' THEN 'Own Guest' ELSE 'Own Guest+Tag Guest' END, CASE WHEN s <> 'F' AND found THEN 'Provider' END, CASE WHEN s = 'F' OR found THEN 'Catalogue' END) AS featured,
        CASE WHEN k % 3 = 0 THEN 'Catalogue Album' WHEN NOT (s = 'F' OR found) THEN NULL WHEN k % 3 = 1 AND s <> 'F' THEN NULL WHEN k % 3 = 1 THEN 'Film Soundtrack' ELSE 'Provider Album' END AS album,
        CASE WHEN k % 2 = 0 THEN strftime(d, '%Y-%m-%d') ELSE strftime(d, '%Y') END AS release_date FROM o""")
def _merge(t: Tables):
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    identities = t.orders.select(k.alias("file_id"), F.lit("T").alias("title"), F.lit("Main").alias("artist"), F.when(s == "F", "acoustid").otherwise("hint").alias("source"),
                                 F.lit("r").alias("recording_id"), F.array(F.lit("Own Guest"), F.lit("MAIN")).alias("featured"), (F.col("o_orderpriority") == "1-URGENT").alias("catalogue_found"))
    tags = t.orders.select(k.alias("file_id"), F.array(F.lit("Tag Guest"), F.lit("Guest")).alias("featured"), F.date_format("o_orderdate", "yyyy").alias("release_date"), F.lit("Tag Album").alias("album"))
    provider = t.orders.select(k.alias("file_id"), F.when(k % 3 == 1, "Film Soundtrack (Remastered)").otherwise("Provider Album").alias("album"), F.lit(None).cast("string").alias("release_date"), F.array(F.lit("Provider")).alias("featured"))
    catalogue = t.orders.select(k.alias("file_id"), F.lit("a").alias("album_id"), F.when(k % 3 == 0, "Catalogue Album").alias("album"),
                                F.when(k % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("release_date"), F.array(F.lit("Catalogue")).alias("featured"), F.array(F.lit("g")).alias("genres"))
    merged = ca.merge_metadata(identities, tags, provider, catalogue)
    return merged.select("file_id", "source", F.array_join("featured", "+").alias("featured"), "album", "release_date")


@query("e18_apply_recording_identity", """
    WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, CASE WHEN o_orderstatus = 'F' THEN 'rec' || o_custkey END AS rec, o_orderpriority AS p FROM orders),
    own AS (SELECT rec, min(k) AS a, max(k) AS b FROM o WHERE rec IS NOT NULL GROUP BY rec),
    x AS (SELECT o.*, p = '2-HIGH' AS asked, coalesce(a <> k OR b <> k, false) AS taken FROM o LEFT JOIN own ON own.rec = 'rec' || c)
    SELECT k AS song_id, CASE WHEN asked AND NOT taken THEN 'New' ELSE 'Old' END AS title, CASE WHEN asked AND NOT taken THEN 'rec' || c ELSE rec END AS recording_id, asked AND taken AS conflict,
        CASE WHEN asked AND NOT taken THEN 'acoustid' ELSE 'hint' END AS metadata_source, (asked AND NOT taken) OR c % 2 = 0 AS reviewed, CASE WHEN asked AND NOT taken THEN 'G' || c ELSE 'Old' END AS featured FROM x""")
def _apply_identity(t: Tables):
    rec = F.concat(F.lit("rec"), "o_custkey")
    songs = t.orders.select(F.col("o_orderkey").alias("song_id"), F.lit("Old").alias("title"), F.lit("A").alias("artist"), F.when(F.col("o_orderstatus") == "F", rec).alias("recording_id"),
                            F.lit("hint").alias("metadata_source"), (F.col("o_custkey") % 2 == 0).alias("reviewed"), F.array(F.lit("Old")).alias("featured"))
    wanted = t.orders.select(key_if("o_orderpriority = '2-HIGH'", "o_orderkey").alias("song_id"), rec.alias("recording_id"), F.lit("New").alias("title"), F.lit("A").alias("artist"),
                                                                      F.array(F.concat(F.lit("G"), "o_custkey")).alias("featured"))
    out = ca.apply_recording_identity(songs, wanted).withColumn("featured", F.array_join("featured", "+"))
    return out.select("song_id", "title", "recording_id", "conflict", "metadata_source", "reviewed", "featured")
