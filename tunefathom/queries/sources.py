"""Scans, flattening of landed documents, and sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tunefathom import schemas
from tunefathom.functions.ids import song_id
from tunefathom.plans.shapes import rounded
from tunefathom.queries.filters import REASONS_SQL
from tunefathom.queries.registry import Tables, key_if, name_if, query, sql_round
from tunefathom.session import settled, work_path
from tunefathom.sources import catalogue as sc, library as li


def _library(t: Tables) -> str:
    """The driver tables as a song library: parts are songs, their line items labels and series."""
    root = work_path(t.spark, "library")
    li.create_library(t.spark, root)
    key = F.col("p_partkey").cast("string").alias("song_id")

    def add(name: str, rows) -> None:
        empty = li.read_table(t.spark, root, name)
        empty.unionByName(rows, allowMissingColumns=True).write.mode("append").parquet(f"{root}/{name}")
    add("songs", t.part.select(key, F.col("p_name").alias("title"), F.col("p_brand").alias("artist")))
    add("dsp", t.part.select(key_if("p_partkey % 5 > 0", "p_partkey").cast("string").alias("song_id"), F.col("p_size").cast("double").alias("bpm")))
    add("tracks", t.part.select(key_if("p_partkey % 3 > 0", "p_partkey").cast("string").alias("song_id"), F.col("p_type").alias("album")))
    rows = t.lineitem.select(F.col("l_partkey").cast("string").alias("song_id"), F.concat(F.lit("L"), "l_suppkey").alias("label"), F.col("l_discount").alias("score"))
    add("parent_genres", rows.groupBy("song_id", "label").agg(F.max("score").alias("score")))
    frames = F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")))
    add("moods", t.lineitem.groupBy(F.col("l_partkey").cast("string").alias("song_id")).agg(F.transform(frames, lambda e: e["l_quantity"]).alias("happy_timeseries")))
    return root


_GENRES_SQL = """SELECT l_partkey, string_agg(label, ' ' ORDER BY score DESC, label) AS labels FROM (
        SELECT l_partkey, 'L' || l_suppkey AS label, max(l_discount) AS score FROM lineitem GROUP BY 1, 2) GROUP BY 1"""
_SONGS_WIDE_SQL = f"""
    SELECT CAST(p_partkey AS VARCHAR) AS song_id, p_name AS title, CASE WHEN p_partkey % 5 > 0 THEN CAST(p_size AS DOUBLE) END AS bpm, CASE WHEN p_partkey % 3 > 0 THEN p_type END AS album, g.labels
    FROM part LEFT JOIN ({_GENRES_SQL}) g ON g.l_partkey = p_partkey"""


def _shown(songs):
    labels = F.when(F.col("parent_genres").isNotNull(), F.array_join(F.transform("parent_genres", lambda e: e["label"]), " "))
    return songs.select("song_id", "title", "bpm", "album", labels.alias("labels"))


@query("s1_scan_songs", _SONGS_WIDE_SQL)
def _scan(t: Tables):
    return _shown(li.scan_songs(t.spark, _library(t)))


@query("s2_scan_feature", "SELECT CAST(l_partkey AS VARCHAR) AS song_id, string_agg(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), ' ' ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity) AS shown FROM lineitem GROUP BY 1")
def _feature(t: Tables):
    rows = li.scan_feature(t.spark, _library(t), "happy")
    return rows.select("song_id", F.array_join(F.transform("values", lambda v: v.cast("int").cast("string")), " ").alias("shown"))


@query("j2_song_detail", f"SELECT * FROM ({_SONGS_WIDE_SQL}) WHERE song_id = '77'")
def _detail(t: Tables):
    return _shown(li.song_detail(t.spark, _library(t), "77"))


@query("j1_song_wide", """
    SELECT s_suppkey AS song_id, s_name, n_name, l.lines, l.total FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey
    LEFT JOIN (SELECT l_suppkey, count(*) AS lines, sum(l_linenumber)::BIGINT AS total FROM lineitem GROUP BY 1) l ON l_suppkey = s_suppkey""")
def _wide(t: Tables):
    songs = t.supplier.select(F.col("s_suppkey").alias("song_id"), "s_name", "s_nationkey").join(t.nation.select(F.col("n_nationkey").alias("s_nationkey"), "n_name"), "s_nationkey", "left")
    lines = t.lineitem.groupBy(F.col("l_suppkey").alias("song_id")).agg(F.count("*").alias("lines"), F.sum("l_linenumber").alias("total"))
    return li.song_wide(songs, lines).select("song_id", "s_name", "n_name", "lines", "total")


def _landed(t: Tables, documents, schema: str):
    """Documents written as JSON lines and read back with their declared schema."""
    path = work_path(t.spark, "landed")
    documents.write.option("compression", "gzip").json(path)
    return sc.scan_catalogue(t.spark, path, schema)


@query("s3_scan_catalogue", """
    SELECT o_orderkey AS query_id, 0 AS position, 'r' || o_orderkey AS recording_id, 'Song ' || o_custkey AS hit_title, CASE WHEN o_custkey % 3 = 0 THEN 'Pyotr Tchaikovsky' ELSE 'Artist' END AS hit_artist, 'Gu''est' AS featured, 90 AS score
    FROM orders WHERE o_orderstatus <> 'P'""")
def _catalogue(t: Tables):
    credit = F.array(
        F.when(F.col("o_custkey") % 3 == 0, F.struct(F.lit("Чайковский").alias("name"), F.struct(F.lit("Чайковский").alias("name"), F.lit("Tchaikovsky, Pyotr").alias("sort-name")).alias("artist"))).otherwise(
            F.struct(F.lit("Artist").alias("name"), F.struct(F.lit("Artist").alias("name"), F.lit("Artist").alias("sort-name")).alias("artist"))),
        F.struct(F.lit("Gu’est").alias("name"), F.struct(F.lit("Gu’est").alias("name"), F.lit("Gu’est").alias("sort-name")).alias("artist")))
    recording = F.struct(F.concat(F.lit("r"), "o_orderkey").alias("id"), F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("Song "), "o_custkey")).alias("title"), F.lit(90).alias("score"), credit.alias("artist-credit"))
    documents = t.orders.select(F.col("o_orderkey").cast("string").alias("query_id"), F.lit(1).alias("count"), F.array(recording).alias("recordings"))
    rows = sc.recordings(_landed(t, documents, schemas.RECORDING_SEARCH))
    return rows.select(F.col("query_id").cast("bigint").alias("query_id"), "position", "recording_id", "hit_title", "hit_artist", F.array_join("featured", "+").alias("featured"), "score")


@query("s4_flatten_playlist_items", """
    SELECT l_orderkey AS playlist_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber // 3, l_linenumber, l_partkey, l_suppkey) - 1 AS INTEGER) AS position, 't' || l_partkey AS track_id, 'Name' AS title,
        'A' || l_suppkey AS artists, l_linenumber * 1000 AS duration_ms, 'alb' || l_suppkey AS album_id
    FROM lineitem WHERE l_linestatus = 'O' AND l_quantity < 40 AND l_returnflag <> 'R' AND l_discount > 0.02""")
def _flatten(t: Tables):
    # pages of up to three entries, which hold their track under either name
    # what an entry is made of, in the order its fields sort by, meets on the page; the entries are made there
    source = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.coalesce(F.col("l_returnflag") != "R", F.lit(False)).alias("named"), F.coalesce(F.col("l_linestatus") == "O", F.lit(False)).alias("music"),
                      (F.col("l_quantity") >= 40).alias("is_local"), F.coalesce(F.col("l_discount") > 0.02, F.lit(False)).alias("credited"))

    def entry(e):
        nobody = F.struct(F.lit("").alias("name"))
        artists = F.when(e["credited"], F.array(F.struct(F.concat(F.lit("A"), e["l_suppkey"]).alias("name")), nobody)).otherwise(F.array(nobody))
        track = F.struct(
            F.concat(F.lit("t"), e["l_partkey"]).alias("id"), F.when(e["named"], "Name").otherwise("").alias("name"), F.when(e["music"], "track").otherwise("episode").alias("type"),
            e["is_local"].alias("is_local"), (e["l_linenumber"] * 1000).cast("bigint").alias("duration_ms"), F.struct(F.lit("x").alias("isrc")).alias("external_ids"), artists.alias("artists"),
            F.struct(F.concat(F.lit("alb"), e["l_suppkey"]).alias("id"), F.lit("Album").alias("name"), artists.alias("artists")).alias("album"))
        renamed = e["l_linenumber"] % 2 == 0
        return F.struct(F.when(renamed, track).alias("item"), F.when(~renamed, track).alias("track"))
    grouped = t.lineitem.groupBy(F.col("l_orderkey").cast("string").alias("playlist_id"), F.floor(F.col("l_linenumber") / 3).cast("int").alias("page")).agg(F.array_sort(F.collect_list(source)).alias("_sources"))
    pages = grouped.select("playlist_id", "page", F.transform("_sources", entry).alias("items"))
    rows = sc.flatten_playlist_items(_landed(t, pages, schemas.PLAYLIST_PAGE))
    return rows.select(F.col("playlist_id").cast("bigint").alias("playlist_id"), "position", "track_id", "title", F.array_join("artists", "+").alias("artists"), "duration_ms", "album_id")


@query("s6_query_lines", r"""
    SELECT line AS value FROM (SELECT regexp_replace(unnest(string_split(text, chr(10))), '^\s+|\s+$', '', 'g') AS line FROM documents) WHERE line <> '' AND line NOT LIKE '#%'""")
def _lines(t: Tables):
    path = work_path(t.spark, "query-lines")
    t.documents.select("text").write.text(path)
    return li.read_query_lines(t.spark, path)


@query("s7_list_audio_files", """
    SELECT lower(name) AS basename, count(*) AS files FROM (SELECT page_id % 3 AS folder, 'Brand ' || page_id % 40 || list_extract(['.MP3', '.flac', '.txt', '.m4a', '.mp3.part', '.aiff', '.jpg'], page_id % 7 + 1) AS name FROM pages GROUP BY ALL)
    WHERE regexp_matches(lower(name), '[.](mp3|flac|m4a|aiff)$') GROUP BY 1""")
def _listed(t: Tables):
    # a file of each of those names (at most 840) below three folders, then listed
    endings = F.array(*[F.lit(e) for e in (".MP3", ".flac", ".txt", ".m4a", ".mp3.part", ".aiff", ".jpg")])
    root = work_path(t.spark, "audio")
    k = F.col("page_id")
    named = t.pages.select((k % 3).alias("folder"), F.concat(F.lit("Brand "), (k % 40).cast("string"), F.get(endings, (k % 7).cast("int"))).alias("name")).distinct()
    for row in named.collect():
        target = t.spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{row['folder']}/{row['name']}")
        file = target.getFileSystem(t.spark._jsc.hadoopConfiguration()).create(target, True)
        file.write(bytearray(b"-"))
        file.close()
    return li.list_audio_files(t.spark, root).groupBy("basename").agg(F.count("*").alias("files"))


@query("s7_audio_files", """
    SELECT page_id, lower(name) AS basename FROM (SELECT page_id, 'Track' || page_id || list_extract(['.MP3', '.flac', '.txt', '.m4a', '.mp3.part', '.aiff', '.jpg'], page_id % 7 + 1) AS name FROM pages) WHERE page_id % 7 IN (0, 1, 3, 5)""")
def _files(t: Tables):
    endings = F.array(*[F.lit(e) for e in (".MP3", ".flac", ".txt", ".m4a", ".mp3.part", ".aiff", ".jpg")])
    name = F.concat(F.lit("Track"), "page_id", F.get(endings, (F.col("page_id") % 7).cast("int")))
    return li.audio_files(t.pages.select("page_id", F.concat_ws("/", "url", name).alias("path"))).select("page_id", "basename")


_RESULT_ROWS = """
    WITH named AS (SELECT *, lower(p_name) || '|' || lower(p_brand) AS k FROM part WHERE p_size > 5),
    fresh AS (SELECT * FROM named WHERE k NOT IN (SELECT lower(p_name) || '|' || lower(p_brand) FROM part WHERE p_size > 48) QUALIFY row_number() OVER (PARTITION BY k ORDER BY p_partkey) = 1),
    told AS (SELECT DISTINCT p_brand FROM fresh WHERE p_brand <> (SELECT min(p_brand) FROM part))"""


@query("s8_split_results", f"""{_RESULT_ROWS}
    SELECT lower(p_name) AS title, t.name, CAST(CASE WHEN t.name = 'dsp' THEN p_size WHEN t.name = 'files' THEN p_retailprice WHEN t.name IN ('parent_genres', 'detailed_genres', 'instruments') THEN p_retailprice END AS DOUBLE) AS value
    FROM fresh, (VALUES {', '.join(repr((n,)) for n in ('songs', *schemas.ONE_TO_ONE, *schemas.LABEL_TABLES))}) t(name)
    UNION ALL SELECT lower(p_brand), 'artists', NULL FROM told""")
def _split(t: Tables):
    # written twice, as after a failure, into a library that knows some of the songs and one artist
    def struct(name: str, schema: str, **given):
        fields = schema.split(", ", 1)[1]
        return F.from_json(F.to_json(F.struct(*[v.alias(k) for k, v in given.items()])) if given else F.lit("{}"), f"struct<{fields}>").alias(name)
    part = t.spread("part")
    results = part.select(
        F.col("p_partkey"), F.concat(F.lit(" "), F.upper("p_name")).alias("title"), F.when(F.col("p_size") > 5, F.col("p_brand")).alias("artist"), F.lit(None).cast("string").alias("recording_id"), F.lit("file_tags").alias("metadata_source"),
        F.lit("f").alias("original_name"), F.lit(None).cast("string").alias("video_id"),
        *[struct(n, s, **({"bpm": F.col("p_size")} if n == "dsp" else {"duration_seconds": F.col("p_retailprice")} if n == "files" else {})) for n, s in {**schemas.ONE_TO_ONE, "artist_info": schemas.ARTISTS}.items()],
        *[F.array(F.struct(F.col("p_type").alias("label"), F.col("p_retailprice").alias("score"))).alias(n) for n in schemas.LABEL_TABLES])
    root = work_path(t.spark, "library")
    li.create_library(t.spark, root)
    known = part.select(song_id(name_if("p_size > 48", "p_name"), F.col("p_brand")).alias("song_id")).distinct()
    old = known.join(li.read_table(t.spark, root, "songs"), "song_id", "left").withColumn("original_name", F.lit("old"))
    old.select(*li.read_table(t.spark, root, "songs").columns).write.mode("append").parquet(f"{root}/songs")
    artists = li.read_table(t.spark, root, "artists")
    t.part.agg(F.min("p_brand").alias("artist")).join(artists, "artist", "left").withColumn("bio", F.lit("old")).select(*artists.columns).write.mode("append").parquet(f"{root}/artists")
    for _ in range(2):
        li.write_songs(results, root, "p_partkey")
    titles = li.read_table(t.spark, root, "songs").filter("original_name <> 'old'").select("song_id", F.trim(F.lower("title")).alias("title"))
    value = {"dsp": "bpm", "files": "duration_seconds", **{n: "score" for n in schemas.LABEL_TABLES}}
    out = titles.select("title", F.lit("songs").alias("name"), F.lit(None).cast("double").alias("value"))
    for name in (*schemas.ONE_TO_ONE, *schemas.LABEL_TABLES):
        rows = li.read_table(t.spark, root, name).join(titles, "song_id")
        out = out.unionByName(rows.select("title", F.lit(name).alias("name"), (F.col(value[name]) if name in value else F.lit(None)).cast("double").alias("value")))
    new = li.read_table(t.spark, root, "artists").filter("bio is null")
    return out.unionByName(new.select(F.lower("artist").alias("title"), F.lit("artists").alias("name"), F.lit(None).cast("double").alias("value")))


FAILURE_ROWS_SQL = f"""
    SELECT e.event_id, 'bulk' AS source, substr(repeat('label ' || e.event_id || ' ', 60), 1, 512) AS label, CASE WHEN e.event_type = 'click' THEN 'error' ELSE 'skipped' END AS status, r.reason, CASE WHEN e.user_id % 2 = 0 THEN r.detail ELSE coalesce(nullif(r.detail, '') || ' (2 hits tried)', '2 hits tried') END AS detail,
        'T' || e.user_id AS title, CASE WHEN e.user_id % 3 > 0 THEN 'A' || e.user_id END AS artist, CASE WHEN e.user_id % 5 = 0 THEN 's' || e.event_id END AS song_id
    FROM events e JOIN ({REASONS_SQL}) r ON r.id = e.event_id WHERE e.event_type <> 'view'"""


def failure_stream(events):
    """Results as the failure log receives them; saved ones are dropped by the operator."""
    kind = F.col("event_type")
    reason = F.when(kind == "error", "duplicate").when(kind == "click", F.concat(F.lit("download_error: HTTP "), F.col("user_id").cast("string"))).when(
        kind == "view", "write_error").when(kind == "purchase", F.concat(F.lit("Traceback: "), F.col("props"))).otherwise("")
    return events.select(
        F.lit("bulk").alias("source"), F.repeat(F.concat(F.lit("label "), "event_id", F.lit(" ")), 60).alias("label"), F.col("event_id").cast("string").alias("video_id"),
        F.when(kind == "view", "saved").when(kind == "click", "").otherwise("skipped").alias("status"), reason.alias("reason"), F.when(F.col("value") > 20, F.concat(F.lit("value "), F.col("props"))).alias("message"),
        F.concat(F.lit("T"), "user_id").alias("title"), F.when(F.col("user_id") % 3 > 0, F.concat(F.lit("A"), "user_id")).otherwise("").alias("artist"),
        F.when(F.col("user_id") % 5 == 0, F.concat(F.lit("s"), "event_id")).alias("song_id"), F.when(F.col("user_id") % 2 == 1, "2 hits tried").alias("note"))


@query("s9_write_failure", FAILURE_ROWS_SQL)
def _failures(t: Tables):
    path = work_path(t.spark, "failures")
    li.write_failures(failure_stream(t.events), path)
    return t.spark.read.parquet(path).withColumn("event_id", F.col("video_id").cast("bigint")).drop("video_id")


@query("s10_append_login_event", "SELECT doc_id, nullif(substr(text, 1, 512), '') AS user_agent FROM documents")
def _logins(t: Tables):
    path = work_path(t.spark, "logins")
    li.append_logins(t.documents.select("doc_id", F.col("text").alias("user_agent")), path)
    return t.spark.read.parquet(path)


@query("s11_dump_results", "SELECT p_partkey, p_name, CASE WHEN p_size > 20 THEN p_retailprice END AS price FROM part")
def _dump(t: Tables):
    path = work_path(t.spark, "results")
    li.dump_results(t.part.select("p_partkey", "p_name", F.when(F.col("p_size") > 20, F.col("p_retailprice")).alias("price")), path)
    return t.spark.read.schema("p_partkey bigint, p_name string, price double").json(path)


@query("s12_truncate_library", f"SELECT name, CASE WHEN name = 'songs' THEN (SELECT count(*) FROM part) ELSE 0 END AS before, n FROM (VALUES {', '.join(repr((name, 0)) for name in li.TABLES)}) v(name, n)")
def _truncate(t: Tables):
    root = work_path(t.spark, "library")
    li.create_library(t.spark, root)
    li.read_table(t.spark, root, "songs").unionByName(t.part.select(F.col("p_partkey").cast("string").alias("song_id"), F.col("p_name").alias("title")), allowMissingColumns=True).write.mode("append").parquet(f"{root}/songs")
    before = settled(_counted(t, root), "counts")
    li.truncate_library(t.spark, root)
    return _counted(t, root).withColumn("n", F.col("n").cast("int")).join(before.select("name", F.col("n").alias("before")), "name").select("name", "before", "n")


def _counted(t: Tables, root: str):
    """Rows of every table of a library."""
    counts = [li.read_table(t.spark, root, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name in li.TABLES]
    return reduce(lambda a, b: a.unionByName(b), counts)


@query("t22_similar_tracks", f"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, i AS position, 'T' || (l_partkey + i) AS title, CASE WHEN i <> 1 THEN 'A' END AS artist, {sql_round('CASE WHEN i = 2 THEN 0 ELSE l_discount / (i + 1) END', 4)} AS similarity
    FROM lineitem, range(7) r(i) WHERE (l_linenumber > 2 AND i < 5) OR (l_linenumber <= 2 AND i = 0)""")
def _similar(t: Tables):
    def entry(i: int, objects: bool):
        return F.struct(F.concat(F.lit("T"), (F.col("l_partkey") + i).cast("string")).alias("name"), F.when(F.lit(i) != 2, (F.col("l_discount") / (i + 1)).cast("string")).alias("match"), (F.struct(F.when(F.lit(i) != 1, "A").otherwise("").alias("name")) if objects else F.when(F.lit(i) != 1, "A").otherwise("")).alias("artist"))
    # the artist is an object with a name, or plain text
    text = F.when(F.col("l_linenumber") > 2, F.when(F.col("l_linenumber") % 2 == 0, F.to_json(F.array(*[entry(i, True) for i in range(7)]))).otherwise(
        F.to_json(F.array(*[entry(i, False) for i in range(7)])))).otherwise(F.to_json(entry(0, True)))
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = sc.similar_tracks(t.spread("lineitem").select(F.struct(*keys).alias("k"), text.alias("text")), "k", "text")
    return rows.select("k.*", "position", "title", "artist", "similarity")


@query("t22_track_info", """
    SELECT o_orderkey, 'Song ft. G' || o_custkey AS title, 'G' || o_custkey AS guests, strftime(o_orderdate, '%Y-%m-%d') AS release_date, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE o_custkey END AS playcount, 0::BIGINT AS listeners FROM orders""")
def _track_info(t: Tables):
    track = F.struct(F.concat(F.lit("Song ft. G"), "o_custkey").alias("name"), F.struct(F.lit("A").alias("name")).alias("artist"), F.struct(F.lit("").alias("title")).alias("album"),
                     F.when(F.col("o_orderstatus") != "P", F.col("o_custkey").cast("string")).alias("playcount"), F.lit("n/a").alias("listeners"),
                     F.struct(F.date_format("o_orderdate", "dd MMM yyyy, HH:mm").alias("published")).alias("wiki"))
    rows = sc.track_info(t.orders.select("o_orderkey", F.to_json(F.struct(track.alias("track"))).alias("text")), "o_orderkey", "text")
    return rows.select("o_orderkey", "title", F.array_join("featured", "+").alias("guests"), "release_date", "playcount", "listeners")


@query("t23_file_tags", f"""
    SELECT p_partkey AS file_id, p_brand AS artist, 'Guest+Other' AS featured, 'MP3' AS file_format, {sql_round('p_retailprice / 7', 2)} AS duration_seconds, CASE WHEN p_size > 5 THEN CAST(round((p_size * 1000 + 128000) / 1000.0) AS INTEGER) END AS bitrate_kbps,
        CASE WHEN p_size % 4 > 0 THEN p_type ELSE '' END AS genres, 44100 + p_size AS sample_rate_hz, CASE WHEN p_size % 3 > 0 THEN CAST(p_size % 3 AS INTEGER) END AS channels FROM part""")
def _file_tags(t: Tables):
    tags = t.part.select(
        F.col("p_partkey").alias("file_id"), F.concat(F.lit("track."), "p_partkey", F.lit(".mp3")).alias("filename"), F.concat("p_name", F.lit(" (feat. Guest & Other)")).alias("title"), F.concat("p_brand", F.lit(" Ft. Guest")).alias("artist"),
        F.lit("Album").alias("album"), F.lit("2001").alias("date"), F.when(F.col("p_size") % 4 > 0, F.col("p_type")).when(F.col("p_size") % 8 > 0, "").alias("genre"), (44100 + F.col("p_size")).alias("sample_rate"), F.when(F.col("p_size") % 3 > 0, F.col("p_size") % 3).alias("channels"), (F.col("p_retailprice") / 7).alias("length"), F.when(F.col("p_size") > 5, F.col("p_size") * 1000 + 128000).otherwise(0).alias("bitrate"))
    return li.file_tag_rows(tags).select("file_id", "artist", F.array_join("featured", "+").alias("featured"), "file_format", "duration_seconds", "bitrate_kbps", F.array_join("genres", "+").alias("genres"), "sample_rate_hz", "channels")
