"""Playlists and imports: customers own playlists, orders are imports, line items their tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tunefathom.operators import filters as fi, matching as ma, playlists as pl, ranking as rk
from tunefathom.plans.shapes import rounded
from tunefathom.queries.registry import Tables, key_if, name_if, query, sql_round

# A line item is one track of an import; its number in the import is unique after this.
_TRACKS_SQL = """
    SELECT l_orderkey AS import_id, l_linenumber AS position, min(l_partkey) AS track_id, min(l_orderkey * 10 + l_linenumber) AS id,
        CASE min(l_returnflag) WHEN 'A' THEN 'saved' WHEN 'N' THEN CASE WHEN min(l_linestatus) = 'O' THEN 'queued' ELSE 'failed' END ELSE 'duplicate' END AS status,
        CASE WHEN min(l_tax) > 0.01 THEN min(l_shipdate) END AS finished_at, CASE WHEN min(l_returnflag) <> 'N' THEN min(l_partkey) // 2 END AS song_id FROM lineitem GROUP BY 1, 2"""


def _tracks(t: Tables):
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("import_id"), F.col("l_linenumber").alias("position")).agg(
        F.min("l_partkey").alias("track_id"), F.min("l_returnflag").alias("f"), F.min("l_linestatus").alias("s"), F.min("l_tax").alias("tax"), F.min("l_shipdate").alias("d"))
    status = F.when(F.col("f") == "A", "saved").when(F.col("f") == "N", F.when(F.col("s") == "O", "queued").otherwise("failed")).otherwise("duplicate")
    return rows.select(
        "import_id", "position", "track_id", (F.col("import_id") * 10 + F.col("position")).alias("id"), status.alias("status"), F.when(F.col("tax") > 0.01, F.col("d")).alias("finished_at"),
        F.when(F.col("f") != "N", F.floor(F.col("track_id") / 2)).alias("song_id"))


_IMPORTS_SQL = "SELECT o_orderkey AS import_id, o_custkey AS user_id, o_orderpriority AS playlist_id, o_orderstatus AS name, o_orderdate AS created_at FROM orders"


def _imports(t: Tables):
    return t.orders.select(F.col("o_orderkey").alias("import_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("playlist_id"), F.col("o_orderstatus").alias("name"), F.col("o_orderdate").alias("created_at"))


@query("a25_import_counts", f"""
    SELECT import_id, count(*) AS total, {", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in pl.STATUSES)} FROM ({_TRACKS_SQL}) GROUP BY import_id""")
def _counts(t: Tables):
    return pl.import_counts(_tracks(t))


_END_SQL = f"""
    SELECT import_id, created_at, CASE WHEN coalesce(q, 0) = 0 THEN coalesce(latest, created_at) END AS finished_at, coalesce(q, 0) = 0 AND coalesce(u, 0) > 0 AS finished_estimated
    FROM ({_IMPORTS_SQL}) LEFT JOIN (SELECT import_id, count(*) FILTER (WHERE status = 'queued') AS q, max(finished_at) FILTER (WHERE status <> 'queued') AS latest,
        count(*) FILTER (WHERE status <> 'queued' AND finished_at IS NULL) AS u FROM ({_TRACKS_SQL}) GROUP BY 1) USING (import_id)"""


@query("a26_import_end", f"SELECT import_id, CAST(finished_at AS VARCHAR) AS finished_at, finished_estimated FROM ({_END_SQL})")
def _end(t: Tables):
    return pl.import_end(_imports(t), _tracks(t)).withColumn("finished_at", F.date_format("finished_at", "yyyy-MM-dd HH:mm:ss"))


@query("a27_last_import", """
    SELECT c_custkey AS user_id, p AS playlist_id, max(o_orderkey) AS last_import_id FROM customer, (VALUES ('1-URGENT'), ('5-LOW')) v(p) LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = p GROUP BY 1, 2""")
def _last(t: Tables):
    playlists = t.customer.select(F.col("c_custkey").alias("user_id"), F.explode(F.array(F.lit("1-URGENT"), F.lit("5-LOW"))).alias("playlist_id"))
    return pl.last_import(playlists, _imports(t))


_LINKS_SQL = f"SELECT import_id AS playlist_id, song_id, min(position) AS position FROM ({_TRACKS_SQL}) WHERE song_id IS NOT NULL GROUP BY 1, 2"


def _links(t: Tables):
    return pl.upsert_links(_tracks(t).limit(0).select(F.col("import_id").alias("playlist_id"), "song_id", "position"),
                           _tracks(t).filter("song_id is not null").select(F.col("import_id").alias("playlist_id"), "song_id", "position"),
                           t.part.select(F.col("p_partkey").alias("song_id")))


@query("a28_playlist_songs", f"""
    SELECT o_custkey AS user_id, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS liked_first, lower(o_orderpriority) AS name_key, o_orderkey AS playlist_id, position, song_id
    FROM orders LEFT JOIN ({_LINKS_SQL}) ON playlist_id = o_orderkey""")
def _playlist_songs(t: Tables):
    playlists = t.orders.select(F.col("o_custkey").alias("user_id"), F.when(F.col("o_orderstatus") == "F", "liked").otherwise("playlist").alias("kind"), F.col("o_orderpriority").alias("name"), F.col("o_orderkey").alias("playlist_id"))
    return pl.playlist_songs(playlists, _links(t))


@query("a29_playlist_rollup", f"""
    SELECT playlist_id, track_count, songs FROM (SELECT import_id AS playlist_id, count(DISTINCT track_id) AS track_count FROM ({_TRACKS_SQL}) GROUP BY 1)
    LEFT JOIN (SELECT import_id AS playlist_id, string_agg(song_id || ':' || position, ' ' ORDER BY song_id) AS songs FROM (
        SELECT import_id, l.song_id, min(position) AS position FROM ({_TRACKS_SQL}) l WHERE song_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1) USING (playlist_id)""")
def _rollup(t: Tables):
    entries = _tracks(t).withColumnRenamed("import_id", "playlist_id").drop("song_id")
    resolved = t.part.select(F.col("p_partkey").alias("track_id"), F.floor(F.col("p_partkey") / 2).alias("song_id"))
    saved = entries.join(_tracks(t).filter("song_id is not null").select("id"), "id", "left_semi")
    first = pl.first_positions(saved, resolved)
    # at most seven positions per import in these tables; text only for the comparison
    listed = first.groupBy("playlist_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("song_id", "position"))), lambda e: F.concat_ws(":", e["song_id"], e["position"])), " ").alias("songs"))
    return pl.playlist_rollup(entries).join(listed, "playlist_id", "left")


@query("a30_album_copy", """
    WITH e AS (SELECT l_orderkey AS playlist_id, l_linenumber AS position, CASE WHEN l_quantity < 48 THEN l_suppkey % 2 END AS album_id, 'By ' || (l_suppkey % 2) AS artists FROM lineitem),
    s AS (SELECT playlist_id, count(DISTINCT album_id) = 1 AND count(album_id) = count(*) AS one, min(album_id) AS a, arg_min(artists, position) AS artists FROM e GROUP BY 1)
    SELECT o_orderkey AS playlist_id, CASE WHEN one AND (CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END) = a THEN artists END AS album_artists FROM orders LEFT JOIN s ON playlist_id = o_orderkey""")
def _album_copy(t: Tables):
    n = (F.col("l_suppkey") % 2).cast("string")
    entries = t.lineitem.select(F.col("l_orderkey").alias("playlist_id"), F.col("l_linenumber").alias("position"), F.when(F.col("l_quantity") < 48, n).alias("album_id"),
                                F.concat(F.lit(" Straße "), n).alias("album_name"), F.when(F.col("l_quantity") < 10, F.array(F.concat(F.lit("By "), n))).otherwise(F.array().cast("array<string>")).alias("album_artists"),
                                F.array(F.concat(F.lit("By "), n)).alias("artists"))
    playlists = t.orders.select(F.col("o_orderkey").alias("playlist_id"), F.when(F.col("o_orderstatus") == "F", "STRASSE 0").otherwise("STRASSE 1").alias("name"))
    return pl.album_copy(playlists, entries)


@query("a33_liked_version", "SELECT user_id, count(*) || ':' || arg_max(event_id, ts) AS version FROM events GROUP BY user_id")
def _liked(t: Tables):
    return pl.liked_version(t.events.select("user_id", F.col("event_id").cast("string").alias("track_id"), F.col("ts").alias("added_at")))


@query("a36_import_elapsed", f"""
    WITH c AS (SELECT import_id, count(*) AS total, {", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in pl.STATUSES)} FROM ({_TRACKS_SQL}) GROUP BY import_id),
    e AS (SELECT *, greatest(floor(date_diff('second', created_at, coalesce(finished_at, TIMESTAMP '2002-01-01 00:00:00')) / 60), 0) AS m FROM ({_END_SQL}))
    SELECT import_id, CAST(CASE WHEN m < 60 THEN m WHEN m < 1440 THEN floor(m / 60) ELSE floor(m / 1440) END AS BIGINT) AS amount, CASE WHEN m < 60 THEN 'minutes' WHEN m < 1440 THEN 'hours' ELSE 'days' END AS unit,
        CAST(CASE WHEN m < 60 THEN 0 WHEN m < 1440 THEN m % 60 ELSE floor(m % 1440 / 60) END AS BIGINT) AS rest,
        {", ".join(sql_round(f"{s} / greatest(total, 1)", 6) + f" AS {s}_share" for s in pl.STATUSES)} FROM e JOIN c USING (import_id)""")
def _elapsed(t: Tables):
    ends = pl.import_end(_imports(t), _tracks(t))
    rows = _imports(t).join(ends, "import_id").join(pl.import_counts(_tracks(t)), "import_id")
    out = pl.import_elapsed(rows, F.lit("2002-01-01 00:00:00").cast("timestamp_ntz"))
    return out.withColumns({f"{s}_share": rounded(F.col(f"{s}_share"), 6) for s in pl.STATUSES})


@query("j11_playlist_view", f"""
    SELECT import_id AS playlist_id, position, 'Track ' || track_id AS title, 'A' || track_id || ', B' AS artists, CASE WHEN track_id IN (SELECT p_partkey FROM part WHERE p_size > 15) THEN track_id // 2 END AS song_id FROM ({_TRACKS_SQL}) WHERE import_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
    UNION ALL SELECT playlist_id, position, p_name, p_brand, song_id FROM ({_LINKS_SQL}) JOIN part ON p_partkey = song_id WHERE playlist_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')""")
def _view(t: Tables):
    entries = _tracks(t).select(F.col("import_id").alias("playlist_id"), "position", "track_id", F.concat(F.lit("Track "), "track_id").alias("title"), F.array(F.concat(F.lit("A"), "track_id"), F.lit("B")).alias("artists"))
    resolved = t.part.select(key_if("p_size > 15", "p_partkey").alias("track_id"), F.floor(F.col("p_partkey") / 2).alias("song_id"))
    playlists = t.orders.select(F.col("o_orderkey").alias("playlist_id"), (F.col("o_orderstatus") != "P").alias("has_tracks"))
    songs = t.part.select(F.col("p_partkey").alias("song_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("artist"))
    return pl.playlist_view(entries, resolved, playlists, _links(t), songs)


@query("j12_remove_missing", """
    SELECT o_custkey AS user_id, o_orderkey AS playlist_id FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')""")
def _missing(t: Tables):
    entries = t.orders.select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("playlist_id"), F.col("o_orderpriority").alias("kind"))
    kept = t.orders.join(t.lineitem.select(key_if("l_returnflag = 'A'", "l_orderkey").alias("_kept")), F.col("o_orderkey") == F.col("_kept"), "left_semi").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("playlist_id"))
    return pl.remove_missing(entries, kept, ["1-URGENT", "2-HIGH"]).select("user_id", "playlist_id")


@query("j13_import_running", f"SELECT o_orderkey AS import_id FROM orders WHERE o_orderkey IN (SELECT import_id FROM ({_TRACKS_SQL}) WHERE status = 'queued')")
def _running(t: Tables):
    return pl.import_running(_imports(t), _tracks(t)).select("import_id")


@query("j14_changed_playlists", """
    SELECT o_custkey AS user_id, o_orderkey AS playlist_id, NOT (o_orderkey IN (SELECT l_orderkey FROM lineitem) AND o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW' AND lacks = 0) AS read_again
    FROM orders LEFT JOIN (SELECT l_orderkey AS k, max(CASE WHEN l_quantity > 45 THEN 1 ELSE 0 END) AS lacks FROM lineitem GROUP BY 1) ON k = o_orderkey""")
def _changed(t: Tables):
    remote = t.orders.select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("playlist_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("version"))
    albums = F.transform(F.array("l_quantity"), lambda q: F.struct(F.when(q <= 45, "album").alias("album_id")))
    per_list = t.lineitem.groupBy("l_orderkey").agg(F.bool_or(pl.lacks_album(albums)).alias("lacks_album"))
    stored = t.orders.join(per_list, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("playlist_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("version"), (F.col("o_orderpriority") != "5-LOW").alias("has_tracks"), "lacks_album")
    return pl.changed_playlists(remote, stored).select("user_id", "playlist_id", "read_again")


@query("j15_backfill_finished", f"""
    WITH t AS (SELECT id, import_id, track_id, position, CASE WHEN track_id % 2 = 0 THEN 'v' || (track_id % 50) END AS video_id FROM ({_TRACKS_SQL}) WHERE status = 'failed'),
    f AS (SELECT CASE WHEN l_partkey % 2 = 0 THEN 'v' || (l_partkey % 50) END AS video_id, 'A' || (l_suppkey % 3) || ', B – T' || (l_partkey % 50) AS label, l_shipdate AS created_at FROM lineitem WHERE l_discount > 0.05)
    SELECT id, CAST((SELECT min(f.created_at) FROM f WHERE f.video_id IS NOT DISTINCT FROM t.video_id AND f.label = 'A' || (t.position % 3) || ', B – T' || (t.track_id % 50) AND f.created_at >= o_orderdate) AS VARCHAR) AS finished_at
    FROM t JOIN orders ON o_orderkey = t.import_id""")
def _backfill(t: Tables):
    def video(c: str):
        return F.when(F.col(c) % 2 == 0, F.concat(F.lit("v"), (F.col(c) % 50).cast("string")))
    tracks = _tracks(t).select("id", "import_id", "status", video("track_id").alias("video_id"), F.concat(F.lit("T"), (F.col("track_id") % 50).cast("string")).alias("title"),
                               F.to_json(F.array(F.concat(F.lit("A"), (F.col("position") % 3).cast("string")), F.lit("B"))).alias("artists_json"))
    failures = t.lineitem.select(video("l_partkey").alias("video_id"), name_if("l_discount > 0.05", F.concat(
        F.lit("A"), (F.col("l_suppkey") % 3).cast("string"), F.lit(", B – T"), (F.col("l_partkey") % 50).cast("string"))).alias("label"), F.col("l_shipdate").alias("created_at"))
    return pl.backfill_finished(tracks, failures, _imports(t)).withColumn("finished_at", F.date_format("finished_at", "yyyy-MM-dd HH:mm:ss"))


@query("j16_backfill_links", f"""
    WITH t AS ({_TRACKS_SQL}), newest AS (SELECT o_custkey AS user_id, o_orderpriority AS playlist_id, max(o_orderkey) AS import_id FROM orders GROUP BY 1, 2),
    linked AS (SELECT track_id, arg_max(song_id, id) AS song_id FROM t WHERE song_id IN (SELECT p_partkey FROM part WHERE p_size > 10) GROUP BY 1)
    SELECT user_id, playlist_id, l.song_id, min(position) AS position FROM t JOIN newest USING (import_id) JOIN linked l ON l.track_id = t.track_id GROUP BY 1, 2, 3""")
def _backfill_links(t: Tables):
    return pl.backfill_links(_imports(t), _tracks(t), t.part.select(key_if("p_size > 10", "p_partkey").alias("song_id")))


@query("j20_playlist_library_songs", f"""
    SELECT playlist_id, song_id, position, p_name AS title FROM ({_LINKS_SQL}) JOIN part ON p_partkey = song_id WHERE contains(p_name, 'ring')""")
def _library_songs(t: Tables):
    entries = _tracks(t).withColumnRenamed("import_id", "playlist_id")
    songs = t.part.select(F.col("p_partkey").alias("song_id"), F.col("p_name").alias("title"), F.lit("none").alias("artist"))
    return rk.sort_songs(fi.search(pl.playlist_library_songs(entries, songs), "Ring"), "title").select("playlist_id", "song_id", "position", "title")


@query("j21_import_detail", f"""
    SELECT id, import_id, status, count(*) OVER (PARTITION BY import_id, status) AS in_status, count(*) OVER (PARTITION BY import_id) AS total, o_orderstatus AS name FROM ({_TRACKS_SQL}) JOIN orders ON o_orderkey = import_id""")
def _detail(t: Tables):
    return pl.import_detail(_tracks(t), _imports(t)).select("id", "import_id", "status", "in_status", "total", "name")


@query("e14_start_import", f"""
    WITH t AS ({_TRACKS_SQL}), u AS (SELECT import_id % 500 AS import_id, import_id * 10 + position AS position, track_id FROM t), s AS (SELECT p_partkey AS track_id, p_partkey // 2 AS song_id FROM part WHERE p_size > 25)
    SELECT import_id, position, track_id, CASE WHEN song_id IS NOT NULL OR row_number() OVER (PARTITION BY import_id, track_id ORDER BY position) > 1 THEN 'duplicate' ELSE 'queued' END AS status, song_id,
        CASE WHEN song_id IS NOT NULL OR row_number() OVER (PARTITION BY import_id, track_id ORDER BY position) > 1 THEN '2002-01-01' END AS finished_at FROM u LEFT JOIN s USING (track_id)""")
def _start(t: Tables):
    tracks = _tracks(t).select((F.col("import_id") % 500).alias("import_id"), (F.col("import_id") * 10 + F.col("position")).alias("position"), "track_id")
    resolved = t.part.select(key_if("p_size > 25", "p_partkey").alias("track_id"), F.floor(F.col("p_partkey") / 2).alias("song_id"))
    return pl.start_import(tracks, resolved, F.lit("2002-01-01"))


@query("e15_record_result", f"""
    WITH t AS ({_TRACKS_SQL}), r AS (SELECT *, CASE track_id % 4 WHEN 0 THEN 'saved' ELSE 'error' END AS result, CASE track_id % 4 WHEN 1 THEN 'duplicate' WHEN 2 THEN 'no_search_hit' WHEN 3 THEN 'write_error: disk' END AS why FROM t)
    SELECT id, CASE WHEN result = 'saved' THEN 'saved' WHEN why = 'duplicate' THEN 'duplicate' ELSE 'failed' END AS status, CASE why WHEN 'no_search_hit' THEN why WHEN 'write_error: disk' THEN 'write_error' END AS reason,
        CASE WHEN result = 'saved' THEN 's' || track_id WHEN why = 'duplicate' AND track_id IN (SELECT l_partkey FROM lineitem WHERE l_suppkey % 3 = 0 AND l_partkey % 8 = 1) AND track_id IN (SELECT p_partkey FROM part WHERE p_size > 5) THEN 'e' || track_id
        WHEN why = 'duplicate' AND track_id IN (SELECT p_partkey FROM part WHERE p_size > 25) THEN 'c' || track_id END AS song_id, '2002-01-01' AS finished_at FROM r""")
def _record(t: Tables):
    track = F.col("track_id").cast("string")
    tracks = _tracks(t).select("id", "import_id", "position", track.alias("track_id"))
    kind = F.col("track_id") % 4
    results = _tracks(t).select("id", F.when(kind == 0, "saved").otherwise("error").alias("status"), F.when(kind == 1, "duplicate").when(kind == 2, "no_search_hit").when(kind == 3, "write_error: disk").alias("reason"),
                                F.when(kind == 0, F.concat(F.lit("s"), track)).alias("song_id"), F.lit("v").alias("video_id"))
    candidates = t.part.select(F.col("p_partkey").cast("string").alias("track_id"), F.array(F.lit("none"), F.concat(F.lit("c"), "p_partkey")).alias("candidates"))
    songs = t.part.select(name_if("p_size > 25", F.concat(F.lit("c"), "p_partkey")).alias("song_id"))
    songs = songs.unionByName(t.part.select(name_if("p_size > 5", F.concat(F.lit("e"), "p_partkey")).alias("song_id")))
    # earlier imports linked some of the tracks
    earlier = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), name_if("l_suppkey % 3 = 0 and l_partkey % 8 = 1", F.col("l_partkey").cast("string")).alias("track_id"),
                                F.concat(F.lit("e"), "l_partkey").alias("song_id"))
    return pl.record_result(tracks, results, candidates, songs, earlier, F.lit("2002-01-01")).select("id", "status", "reason", "song_id", "finished_at")


@query("e15_result_links", f"""
    WITH r AS (SELECT import_id, position, track_id, CASE WHEN track_id % 4 = 0 THEN track_id ELSE track_id + 1 END AS song_id FROM ({_TRACKS_SQL}) WHERE track_id % 4 < 2),
    a AS (SELECT o_orderpriority AS playlist_id, song_id, position FROM r JOIN orders ON o_orderkey = import_id WHERE song_id IN (SELECT p_partkey FROM part WHERE p_size > 10)
        UNION ALL SELECT '1-URGENT', p_partkey, p_size FROM part)
    SELECT playlist_id, song_id, CAST(min(position) AS INTEGER) AS position FROM a GROUP BY 1, 2""")
def _result_links(t: Tables):
    kind = F.col("track_id") % 4
    recorded = _tracks(t).select("import_id", F.col("position").cast("int").alias("position"), F.when(kind == 0, "saved").when(kind == 1, "duplicate").otherwise("failed").alias("status"),
                                 F.when(kind == 0, F.col("track_id")).otherwise(F.col("track_id") + 1).alias("song_id"))
    imports = t.orders.select(F.col("o_orderkey").alias("import_id"), F.col("o_orderpriority").alias("playlist_id"))
    links = t.part.select(F.lit("1-URGENT").alias("playlist_id"), F.col("p_partkey").alias("song_id"), F.col("p_size").cast("int").alias("position"))
    return pl.result_links(recorded, imports, links, t.part.select(key_if("p_size > 10", "p_partkey").alias("song_id")))


@query("e16_requeue", f"""
    SELECT import_id, position, id, song_id FROM (SELECT *, CASE WHEN status = 'failed' THEN 'queued' ELSE status END AS now FROM ({_TRACKS_SQL})) WHERE now = 'queued' ORDER BY import_id, position""")
def _requeue(t: Tables):
    return pl.queued_tracks(pl.requeue(_tracks(t))).select("import_id", "position", "id", "song_id")


@query("e17_upsert_link", """
    SELECT playlist_id, l_partkey AS song_id, min(l_linenumber) AS position FROM (
        SELECT CASE WHEN l_returnflag <> 'R' THEN l_orderkey ELSE -1 - l_orderkey END AS playlist_id, l_partkey, l_linenumber FROM lineitem UNION ALL
        SELECT CASE WHEN l_returnflag = 'R' THEN l_orderkey ELSE -1 - l_orderkey END, l_partkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 20)) GROUP BY 1, 2""")
def _upsert(t: Tables):
    def links(condition: str):
        return t.lineitem.select(key_if(condition, "l_orderkey").alias("playlist_id"), F.col("l_partkey").alias("song_id"), F.col("l_linenumber").alias("position"))
    return pl.upsert_links(links("l_returnflag <> 'R'"), links("l_returnflag = 'R'"), t.part.select(key_if("p_size > 20", "p_partkey").alias("song_id")))


@query("o7_recent_imports", """
    SELECT o_custkey AS user_id, o_orderkey AS import_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS place FROM orders QUALIFY place <= 3""")
def _recent(t: Tables):
    return pl.recent_imports_per_user(_imports(t), 3).select("user_id", "import_id", "place")


@query("o7_recent_imports_of_one", "SELECT o_orderkey AS import_id FROM orders WHERE o_custkey = 7 ORDER BY 1 DESC LIMIT 20")
def _recent_one(t: Tables):
    return pl.recent_imports(_imports(t), 7, 20).select("import_id")


@query("s5_owned_or_collaborative", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' OR c_acctbal > 5000")
def _owned(t: Tables):
    return pl.owned_or_collaborative(t.customer.withColumn("collaborative", F.col("c_acctbal") > 5000), "BUILDING", "c_mktsegment").select("c_custkey")
