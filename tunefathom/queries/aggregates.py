"""Totals, histograms, distributions, correlations and rankings over songs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tunefathom import fixed_values as fv
from tunefathom.functions import numeric as nu
from tunefathom.operators import aggregates as ag, ranking as rk
from tunefathom.plans.shapes import rounded
from tunefathom.queries.registry import LABELS_SQL, SONGS_SQL, Tables, key_if, labels_from_lineitem, query, songs_from_part, sql_round


@query("a1_song_count", "SELECT count(*) AS songs FROM lineitem")
def _song_count(t: Tables):
    return ag.song_count(t.lineitem)


@query("a2_library_totals", f"""
    SELECT count(*) AS songs, count(DISTINCT coalesce(artist, 'Unknown')) AS artists, {sql_round('avg(bpm)', 4)} AS mean_bpm,
        {sql_round('avg(duration_seconds)', 4)} AS mean_duration, {sql_round('sum(duration_seconds) / 3600', 4)} AS hours
    FROM (SELECT CASE WHEN l_returnflag = 'R' THEN NULL ELSE 'S' || CAST(l_suppkey AS VARCHAR) END AS artist, l_quantity AS bpm, l_extendedprice / 100 AS duration_seconds FROM lineitem)""")
def _library_totals(t: Tables):
    songs = t.lineitem.select(
        F.when(F.col("l_returnflag") != "R", F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))).alias("artist"),
        F.col("l_quantity").alias("bpm"), (F.col("l_extendedprice") / 100).alias("duration_seconds"))
    return ag.library_totals(songs).withColumns({c: rounded(F.col(c), 4) for c in ("mean_bpm", "mean_duration", "hours")})


@query("a3_histogram", f"""
    WITH s AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 18 AS step FROM lineitem),
    c AS (SELECT CAST(least(floor((l_extendedprice - lo) / step), 17) AS INTEGER) AS bin, count(*) AS n FROM lineitem, s GROUP BY 1)
    SELECT CAST(r.bin AS INTEGER) AS bin, {sql_round('lo + r.bin * step', 4)} AS low, {sql_round('lo + (r.bin + 1) * step', 4)} AS high, coalesce(n, 0) AS n
    FROM range(18) r(bin) CROSS JOIN s LEFT JOIN c ON c.bin = r.bin""")
def _histogram(t: Tables):
    return ag.histogram(t.lineitem, "l_extendedprice", 18).withColumns({c: rounded(F.col(c), 4) for c in ("low", "high")})


@query("a4_unit_histogram", """
    SELECT CAST(r.bin AS INTEGER) AS bin, coalesce(n, 0) AS n FROM range(20) r(bin) LEFT JOIN (
        SELECT CAST(least(floor((l_extendedprice / 105000) * 20), 19) AS INTEGER) AS bin, count(*) AS n FROM lineitem GROUP BY 1) c ON c.bin = r.bin""")
def _unit_histogram(t: Tables):
    return ag.unit_histogram(t.lineitem.select((F.col("l_extendedprice") / 105000).alias("v")), "v")


_KEYS_SQL = "SELECT CASE o_custkey % 13 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(fv.PITCH_CLASSES) if k != "D") + " END AS key FROM orders"


@query("a5_key_distribution", f"""
    SELECT CAST(k.position AS INTEGER) AS position, k.key, coalesce(n, 0) AS n
    FROM (VALUES {", ".join(f"({i}, '{k}')" for i, k in enumerate(fv.PITCH_CLASSES))}) k(position, key)
    LEFT JOIN (SELECT key, count(*) AS n FROM ({_KEYS_SQL}) GROUP BY key) c USING (key)""")
def _key_distribution(t: Tables):
    names = F.array(*[F.lit(k) if k != "D" else F.lit(None).cast("string") for k in fv.PITCH_CLASSES])
    return ag.key_distribution(t.orders.select(F.get(names, (F.col("o_custkey") % 13).cast("int")).alias("key")))


@query("a6_scale_distribution", f"""
    SELECT scale, count(*) AS n, {sql_round('count(*)::DOUBLE / (SELECT count(*) FROM lineitem WHERE l_discount > 0.01)', 6)} AS share
    FROM (SELECT CASE WHEN l_linestatus = 'O' THEN 'major' ELSE 'minor' END AS scale FROM lineitem WHERE l_discount > 0.01) GROUP BY scale""")
def _scale_distribution(t: Tables):
    scale = F.when(F.col("l_discount") > 0.01, F.when(F.col("l_linestatus") == "O", "major").otherwise("minor"))
    return ag.share_distribution(t.lineitem.select(scale.alias("scale")), "scale").withColumn("share", rounded(F.col("share"), 6))


# three scores of a line item as its moods; ties fall to the first in the order
_MOOD_COLUMNS = {"happy": "l_discount * 10", "sad": "l_tax * 12.5", "party": "CASE WHEN l_quantity > 5 THEN l_quantity / 50 END"}
_MOODS_SQL = f"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, happy, sad, party, CASE WHEN happy >= sad AND happy >= coalesce(party, -1) THEN 'happy'
        WHEN sad >= coalesce(party, -1) THEN 'sad' ELSE 'party' END AS mood
    FROM (SELECT *, {", ".join(f"{sql_round(e, 6)} AS {m}" for m, e in _MOOD_COLUMNS.items())} FROM lineitem)"""


def mood_rows(t: Tables):
    return t.lineitem.select("*", *[rounded(F.expr(e), 6).alias(m) for m, e in _MOOD_COLUMNS.items()])


@query("a7_mood_distribution", f"SELECT mood, count(*) AS n FROM ({_MOODS_SQL}) GROUP BY mood")
def _mood_distribution(t: Tables):
    return ag.value_counts(mood_rows(t).select(rk.dominant_mood(list(_MOOD_COLUMNS)).alias("mood")), "mood")


@query("w2_ranked_moods", f"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, mood AS dominant,
        array_to_string(list_transform(list_sort(list_filter([{{'k': -happy, 'p': 0, 'm': 'happy'}}, {{'k': -sad, 'p': 1, 'm': 'sad'}}, {{'k': -party, 'p': 2, 'm': 'party'}}],
            lambda x: x.k IS NOT NULL)), lambda x: x.m), '>') AS ranking
    FROM ({_MOODS_SQL})""")
def _ranked_moods(t: Tables):
    moods = list(_MOOD_COLUMNS)
    return mood_rows(t).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", rk.dominant_mood(moods).alias("dominant"),
        F.array_join(F.transform(rk.ranked_moods(moods), lambda e: e["mood"]), ">").alias("ranking"))


_YEARS_SQL = "SELECT CAST(CASE WHEN year(o_orderdate) IN (1997, 1998) THEN 1996 ELSE year(o_orderdate) END AS INTEGER) AS year FROM orders"


@query("a8_release_years", f"""
    SELECT CAST(y AS INTEGER) AS year, coalesce(n, 0) AS n FROM range((SELECT min(year) FROM ({_YEARS_SQL})), (SELECT max(year) + 1 FROM ({_YEARS_SQL}))) r(y)
    LEFT JOIN (SELECT year, count(*) AS n FROM ({_YEARS_SQL}) GROUP BY year) c ON c.year = y""")
def _release_years(t: Tables):
    years = t.orders.select(nu.release_year(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("year"))
    return ag.release_years(years.withColumn("year", F.when(F.col("year").isin(1997, 1998), 1996).otherwise(F.col("year"))))


@query("a9_top_artists", """
    SELECT coalesce(artist, 'Unknown') AS artist, count(*) AS n FROM (SELECT CASE WHEN l_quantity > 1 THEN 'Supplier ' || CAST(l_suppkey AS VARCHAR) END AS artist FROM lineitem)
    GROUP BY 1 ORDER BY n DESC, artist LIMIT 15""")
def _top_artists(t: Tables):
    name = F.when(F.col("l_quantity") > 1, F.concat(F.lit("Supplier "), F.col("l_suppkey").cast("string")))
    return ag.top_artists(t.lineitem.select(name.alias("artist")))


_RANKED_LABELS = f"SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY score DESC, label) AS rank FROM ({LABELS_SQL})"


@query("a10_parent_genre_counts", f"""
    SELECT genre, count(*) AS n FROM (SELECT split_part(label, '---', 1) AS genre, row_number() OVER (PARTITION BY song_id ORDER BY score DESC, genre) AS rank FROM (
        SELECT song_id, split_part(label, '---', 1) AS label, sum(score) AS score FROM ({LABELS_SQL}) GROUP BY 1, 2)) WHERE rank <= 3 GROUP BY genre""")
def _parent_genre_counts(t: Tables):
    parents = labels_from_lineitem(t).groupBy("song_id", F.substring_index("label", "---", 1).alias("label")).agg(F.sum("score").alias("score"))
    return ag.genre_counts(parents, 3)


@query("a10_detailed_genre_counts", f"SELECT split_part(label, '---', 2) AS genre, count(*) AS n FROM ({_RANKED_LABELS}) WHERE rank <= 5 GROUP BY 1")
def _detailed_genre_counts(t: Tables):
    return ag.genre_counts(labels_from_lineitem(t), 5, detailed=True)


_INSTRUMENTS = ["drums", "bass", "electricguitar", "keyboard", "violin", "horn", "pipeorgan", "harp", "choir", "sampler", "computer", "contrabass"]
_INSTRUMENTS_SQL = f"""
    SELECT l_orderkey AS song_id, list_extract([{", ".join(f"'{i}'" for i in _INSTRUMENTS)}], CAST(l_partkey % 12 + 1 AS BIGINT)) AS label, max(l_discount + l_extendedprice / 1e6) AS score
    FROM lineitem GROUP BY 1, 2"""


@query("a11_instrument_counts", f"""
    SELECT label AS instrument, count(*) AS n, CASE WHEN label = 'drums' THEN 'percussion' WHEN label IN ('bass', 'contrabass') THEN 'bass' WHEN label = 'electricguitar' THEN 'guitar'
        WHEN label IN ('keyboard', 'pipeorgan') THEN 'piano' WHEN label IN ('violin', 'harp') THEN 'strings' WHEN label = 'horn' THEN 'brass' WHEN label = 'choir' THEN 'voice'
        WHEN label = 'sampler' THEN 'synth' ELSE 'other' END AS family
    FROM (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY score DESC, label) AS rank FROM ({_INSTRUMENTS_SQL})) WHERE rank <= 10 GROUP BY label""")
def _instrument_counts(t: Tables):
    names = F.array(*[F.lit(i) for i in _INSTRUMENTS])
    labels = t.lineitem.groupBy(F.col("l_orderkey").alias("song_id"), F.get(names, (F.col("l_partkey") % 12).cast("int")).alias("label")).agg(
        F.max(F.col("l_discount") + F.col("l_extendedprice") / 1e6).alias("score"))
    return ag.instrument_counts(labels)


@query("a12_label_rows", f"""
    WITH l AS ({LABELS_SQL}), top AS (SELECT label, count(*) AS top_count FROM (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY score DESC, label) AS rank FROM l)
        WHERE rank <= 3 GROUP BY label ORDER BY top_count DESC, label LIMIT 25)
    SELECT label, top_count, CAST(least(floor(score * 20), 19) AS INTEGER) AS bin, count(*) AS n FROM l JOIN top USING (label) GROUP BY 1, 2, 3""")
def _label_rows(t: Tables):
    return ag.label_rows(labels_from_lineitem(t), 3)


@query("a13_axis_stats", f"""
    SELECT 'l_quantity' AS axis, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem UNION ALL
    SELECT 'l_extendedprice', min(l_extendedprice), max(l_extendedprice) FROM lineitem UNION ALL SELECT 'nothing', 0, 1""")
def _axis_stats(t: Tables):
    return ag.axis_stats(t.lineitem.withColumn("nothing", F.lit(None).cast("double")), ["l_quantity", "l_extendedprice", "nothing"])


@query("a14_mean_profile", f"""
    WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
    SELECT 'clamped' AS axis, {sql_round('avg(greatest(0, least(1, l_quantity / 40)))', 6)} AS mean FROM lineitem UNION ALL
    SELECT 'ranged', {sql_round('avg((l_extendedprice - lo) / (hi - lo))', 6)} FROM lineitem, s UNION ALL
    SELECT 'scored', {sql_round('avg(greatest(0, least(1, (l_quantity / 10 - 3 + 2) / 4)))', 6)} FROM lineitem""")
def _mean_profile(t: Tables):
    rows = t.lineitem.withColumn("_s", ag.axis_stats_row(t.lineitem, ["l_extendedprice"]))
    axes = {
        "clamped": nu.clamp01(F.col("l_quantity") / 40),
        "ranged": nu.minmax(F.col("l_extendedprice"), F.col("_s.l_extendedprice.lo"), F.col("_s.l_extendedprice.hi")),
        "scored": nu.z_to_unit(F.col("l_quantity") / 10 - 3),
        "absent": nu.clamp01(F.lit(None).cast("double")),
    }
    return ag.mean_profile(rows, axes).withColumn("mean", rounded(F.col("mean"), 6))


_FEATURES = ["quantity", "price", "discount", "tax", "constant", "playcount"]
_FEATURES_SQL = """
    SELECT l_quantity AS quantity, l_extendedprice AS price, CASE WHEN l_returnflag <> 'N' THEN l_discount END AS discount, l_tax AS tax,
        0.1 AS constant, nullif(CAST(l_linenumber - 1 AS DOUBLE), 0) AS playcount FROM lineitem"""


@query("a15_correlations", f"WITH w AS ({_FEATURES_SQL}), c AS (" + " UNION ALL ".join(
    f"SELECT '{x}' AS feature_x, '{y}' AS feature_y, "
    + ("CAST(NULL AS DOUBLE) AS r" if "constant" in (x, y) else
       f"covar_pop({x}, {y}) / (stddev_pop({x}) FILTER (WHERE {y} IS NOT NULL) * stddev_pop({y}) FILTER (WHERE {x} IS NOT NULL)) AS r FROM w") for x in _FEATURES for y in _FEATURES) + f") SELECT feature_x, feature_y, {sql_round('r', 3)} AS r FROM c")
def _correlations(t: Tables):
    songs = t.lineitem.select(
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"),
        F.when(F.col("l_returnflag") != "N", F.col("l_discount")).alias("discount"), F.col("l_tax").alias("tax"), F.lit(0.1).alias("constant"),
        (F.col("l_linenumber") - 1).alias("playcount"), F.when(F.col("l_quantity") > 49, F.col("l_tax")).alias("rare"))
    return ag.correlations(songs, [*_FEATURES, "rare"])


@query("a31_genre_legend", f"SELECT top_genre, count(*) AS n FROM ({SONGS_SQL}) GROUP BY top_genre")
def _genre_legend(t: Tables):
    return ag.genre_legend(songs_from_part(t))


@query("a35_upload_summary", """
    SELECT count(*) FILTER (WHERE event_type = 'view') AS saved, count(*) FILTER (WHERE event_type = 'click') AS skipped, count(*) FILTER (WHERE event_type = 'error') AS error FROM events""")
def _upload_summary(t: Tables):
    status = F.when(F.col("event_type") == "view", "saved").when(F.col("event_type") == "click", "skipped").otherwise(F.col("event_type"))
    return ag.upload_summary(t.events.select(status.alias("status")))


@query("w3_top_genre", f"""
    SELECT song_id, label AS top_genre, {sql_round('score', 6)} AS share FROM ({_RANKED_LABELS}) WHERE rank = 1""")
def _top_genre(t: Tables):
    return rk.top_genre(labels_from_lineitem(t)).withColumn("share", rounded(F.col("share"), 6))


# --- ordered lists ----------------------------------------------------------------

@query("w7_queue_moves", """
    SELECT event_id, coalesce(lead(user_id) OVER (PARTITION BY g ORDER BY event_id), first_value(user_id) OVER (PARTITION BY g ORDER BY event_id)) AS next_item,
        coalesce(lag(user_id) OVER (PARTITION BY g ORDER BY event_id), last_value(user_id) OVER (PARTITION BY g ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS previous_item
    FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 10 + user_id % 5 END AS g FROM events)""")
def _queue_moves(t: Tables):
    # one queue holds a third of the table; the positions of all have gaps
    owner = F.when(F.col("event_id") % 3 == 0, 1).otherwise(10 + F.col("user_id") % 5)
    queue = t.events.select(owner.alias("list_id"), F.col("event_id").alias("position"), "user_id")
    return rk.queue_moves(queue, "list_id", "position", "user_id").select(F.col("position").alias("event_id"), "next_item", "previous_item")


@query("w7_unknown_current", "SELECT o_custkey, min(o_orderkey) AS next_item, max(o_orderkey) AS previous_item FROM orders GROUP BY o_custkey")
def _unknown_current(t: Tables):
    return rk.start_of_queue(t.orders, "o_custkey", "o_orderkey", "o_orderkey")


_PLAYS_SQL = "SELECT user_id AS session_id, CAST(json_extract(props, '$.k') AS BIGINT) AS song_id, event_id AS played_at FROM events"
_NEAR_SQL = """
    SELECT song_id, neighbor_id, row_number() OVER (PARTITION BY song_id ORDER BY n DESC, neighbor_id) AS rank FROM (
        SELECT l_suppkey AS song_id, l_partkey % 100 AS neighbor_id, count(*) AS n FROM lineitem GROUP BY 1, 2) QUALIFY rank <= 5"""


@query("w8_next_neighbour", f"""
    WITH l AS (SELECT session_id, song_id, max(played_at) AS last_at FROM ({_PLAYS_SQL}) GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY last_at DESC) AS place FROM l QUALIFY place <= 10),
    o AS (SELECT c.session_id, c.song_id AS current_id, e.rank, e.neighbor_id, EXISTS (SELECT 1 FROM r WHERE r.session_id = c.session_id AND r.song_id = e.neighbor_id) AS played
        FROM r c JOIN ({_NEAR_SQL}) e ON e.song_id = c.song_id WHERE c.place = 1)
    SELECT session_id, current_id, neighbor_id AS next_id FROM o QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY played, rank) = 1""")
def _next_neighbour(t: Tables):
    plays = t.events.select(F.col("user_id").alias("session_id"), F.get_json_object("props", "$.k").cast("bigint").alias("song_id"), F.col("event_id").alias("played_at"))
    counts = t.lineitem.groupBy(F.col("l_suppkey").alias("song_id"), (F.col("l_partkey") % 100).alias("neighbor_id")).agg(F.count("*").alias("n"))
    edges = rk.top_n(counts, ["song_id"], [F.desc("n"), "neighbor_id"], 5)
    return rk.next_neighbour(plays, edges)


_STAGE_SQL = f"SELECT user_id AS job_id, event_type AS stage, ts FROM events"


@query("w10_stage_since", f"""
    WITH s AS (SELECT *, lag(stage) OVER (PARTITION BY job_id ORDER BY ts) AS before FROM ({_STAGE_SQL}))
    SELECT job_id, arg_max(stage, ts) AS stage, epoch_us(max(ts) FILTER (WHERE stage IS DISTINCT FROM before)) AS since_us, epoch_us(max(ts)) AS last_us,
        list_position(['error', 'click', 'view', 'purchase', 'signup'], arg_max(stage, ts)) AS place FROM s GROUP BY job_id""")
def _stage_since(t: Tables):
    jobs = rk.stage_since(t.events.select(F.col("user_id").alias("job_id"), F.col("event_type").alias("stage"), F.col("ts").cast("timestamp").alias("ts")))
    return jobs.select("job_id", "stage", F.unix_micros("stage_since").alias("since_us"), F.unix_micros("last_update").alias("last_us"),
                       rk.stage_order(F.col("stage"), ["error", "click", "view", "purchase", "signup"]).cast("int").alias("place"))


@query("w11_latest_import", """
    SELECT o_custkey AS user_id, o_orderpriority AS playlist_id, max(o_orderkey) AS import_id, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1, 2""")
def _latest_import(t: Tables):
    imports = t.orders.select(F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("playlist_id"), F.col("o_orderkey").alias("import_id"), F.col("o_orderstatus").alias("status"))
    return rk.latest_per(imports, ["user_id", "playlist_id"], "import_id")


@query("o1_sort_songs", f"""
    SELECT song_id, title, nullif(bpm, 7) AS bpm FROM ({SONGS_SQL}) ORDER BY bpm DESC NULLS LAST, song_id""")
def _sort_songs(t: Tables):
    songs = songs_from_part(t).select("song_id", "title", F.nullif("bpm", F.lit(7.0)).alias("bpm"))
    return rk.sort_songs(songs, "bpm", descending=True)


@query("o2_page", f"SELECT song_id, title FROM ({SONGS_SQL}) ORDER BY title NULLS LAST, song_id LIMIT 150")
def _page(t: Tables):
    return rk.page(rk.sort_songs(songs_from_part(t).select("song_id", "title"), "title"), 3)


@query("o8_random_sample", "SELECT o_orderkey FROM orders ORDER BY md5('7:' || o_orderkey), o_orderkey LIMIT 10")
def _random_sample(t: Tables):
    return rk.random_sample(t.orders.select("o_orderkey"), 10, 7, "o_orderkey")


@query("o8_weighted_sample", """
    SELECT o_orderkey FROM orders WHERE o_totalprice - 100000 > 0 ORDER BY -ln((('0x' || substr(md5('7:' || o_orderkey), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656) / (o_totalprice - 100000), o_orderkey LIMIT 50""")
def _weighted_sample(t: Tables):
    rows = t.orders.select("o_orderkey", (F.col("o_totalprice") - 100000).alias("weight"))
    return rk.random_sample(rows, 50, 7, "o_orderkey", "weight").select("o_orderkey")


_ACCENTED_SQL = """SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN upper(p_name) WHEN p_partkey % 2 = 0 THEN translate(p_name, 'aeou', 'áèöü') ELSE p_name END AS title FROM part"""


def _in_collation(t: Tables, descending: bool):
    k = F.col("p_partkey")
    title = F.when(k % 7 == 0, F.lit(None)).when(k % 3 == 0, F.upper("p_name")).when(k % 2 == 0, F.translate("p_name", "aeou", "áèöü")).otherwise(F.col("p_name"))
    songs = t.part.select(k.alias("song_id"), title.alias("title"))
    return rk.sorted_places(songs, "title", descending, collation="UNICODE_CI_AI").select(F.col("song_id").alias("p_partkey"), "place")


@query("o1_sort_by_collation", f"SELECT p_partkey, row_number() OVER (ORDER BY title COLLATE NOCASE.NOACCENT ASC NULLS LAST, p_partkey)::INT AS place FROM ({_ACCENTED_SQL})")
def _sort_by_collation(t: Tables):
    return _in_collation(t, False)


@query("o1_sort_by_collation_descending", f"SELECT p_partkey, row_number() OVER (ORDER BY title COLLATE NOCASE.NOACCENT DESC NULLS LAST, p_partkey)::INT AS place FROM ({_ACCENTED_SQL})")
def _sort_by_collation_descending(t: Tables):
    return _in_collation(t, True)


@query("u4_union_recordings", """
    WITH b AS (SELECT o_custkey AS query_id, o_orderkey AS recording_id, o_totalprice AS total FROM orders WHERE o_orderstatus <> 'P'),
    cut AS (SELECT query_id FROM b GROUP BY query_id HAVING max(floor(total / 20000)) > count(*))
    SELECT query_id, recording_id FROM b UNION SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_custkey IN (SELECT query_id FROM cut)""")
def _union_recordings(t: Tables):
    rows = t.orders.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("recording_id"), F.floor(F.col("o_totalprice") / 20000).alias("total_hits"), "o_orderstatus")
    return rk.union_recordings(rows.filter("o_orderstatus <> 'P'"), rows.filter("o_orderstatus <> 'F'"))


@query("u5_pool_add", """
    SELECT DISTINCT video_id FROM (SELECT CASE WHEN l_returnflag = 'A' THEN l_partkey ELSE -1 - l_partkey END AS video_id FROM lineitem) WHERE video_id NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 46)
        AND video_id NOT IN (SELECT p_partkey FROM part WHERE p_size > 40)
        AND video_id NOT IN (SELECT -1 - l_partkey FROM lineitem WHERE l_quantity < 46) AND video_id NOT IN (SELECT -1 - p_partkey FROM part WHERE p_size <= 40)""")
def _pool_add(t: Tables):
    # rows that are not offered, pooled or served have a key of their own
    return rk.pool_add(t.lineitem.select(key_if("l_quantity >= 46", "l_partkey").alias("video_id")), t.lineitem.select(key_if("l_returnflag = 'A'", "l_partkey").alias("video_id")),
                       t.part.select(key_if("p_size > 40", "p_partkey").alias("video_id")))


# --- scalar functions -------------------------------------------------------------

@query("m1_m4_normalisers", f"""
    SELECT l_orderkey, l_linenumber, l_partkey, {sql_round('greatest(0, least(1, l_quantity / 40))', 6)} AS clamped, {sql_round('greatest(0, least(1, (l_quantity / 10 - 3 + 2) / 4))', 6)} AS unit,
        {sql_round('greatest(0, least(1, CASE WHEN l_quantity / 8 <= 1 THEN l_quantity / 8 ELSE (l_quantity / 8 - 1) / 8 END))', 6)} AS arousal,
        {sql_round('coalesce(least(1, power(10, (-16 - (l_extendedprice / 5000 - 25)) / 20)), 1)', 6)} AS gain, {sql_round('1 - l_discount', 4)} AS flipped
    FROM lineitem""")
def _normalisers(t: Tables):
    q = F.col("l_quantity")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", rounded(nu.clamp01(q / 40), 6).alias("clamped"), rounded(nu.z_to_unit(q / 10 - 3), 6).alias("unit"),
        rounded(nu.normalise_av(q / 8), 6).alias("arousal"), rounded(nu.loudness_gain(F.col("l_extendedprice") / 5000 - 25), 6).alias("gain"),
        nu.flip_score(F.col("l_discount")).alias("flipped"))


@query("m2_minmax", f"""
    WITH s AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part)
    SELECT p_partkey, {sql_round('(p_retailprice - lo) / (hi - lo)', 6)} AS ranged, 0.5::DOUBLE AS constant FROM part, s""")
def _minmax(t: Tables):
    rows = t.part.withColumn("same", F.lit(3.0))
    rows = rows.withColumn("_s", ag.axis_stats_row(rows, ["p_retailprice", "same"]))
    return rows.select("p_partkey", rounded(nu.minmax(F.col("p_retailprice"), F.col("_s.p_retailprice.lo"), F.col("_s.p_retailprice.hi")), 6).alias("ranged"),
                       nu.minmax(F.col("same"), F.col("_s.same.lo"), F.col("_s.same.hi")).alias("constant"))
