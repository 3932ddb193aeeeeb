"""Text functions over the documents, pages and conversations; whole texts throughout."""

from __future__ import annotations

from pyspark.sql import functions as F

from tunefathom import fixed_values as fv
from tunefathom.functions import ids, numeric as nu, text as tx
from tunefathom.plans.shapes import rounded
from tunefathom.queries.registry import Tables, query, sql_round


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _re2(pattern: str) -> str:
    """The same pattern for the other engine, which has its own flag syntax."""
    return _quoted(pattern.replace("(?iU)", "(?i)").replace("(?U)", ""))


def _replace(text: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({text}, {_re2(pattern)}, {_quoted(by)}, 'g')"


_STRIP = r"^\s+|\s+$"


def _strip(text: str) -> str:
    return _replace(text, _STRIP)


# titles made from the tables: every part under every kind of upload decoration
_DECORATIONS = [" (Official Video)", " [2009 Remaster]", " - Official Audio", " | Some Name - Topic", " (Radio Edit)", " - Live", " (feat. {b} & Third)", " ft. {b}", " (Titanium Remix)", ""]


def title_column(number, name, brand):
    made = [F.concat(name, *[x for i, piece in enumerate(d.split("{b}")) for x in ([brand, F.lit(piece)] if i else [F.lit(piece)])]) for d in _DECORATIONS]
    return F.get(F.array(*made), (number % 10).cast("int"))


def titles(t: Tables):
    return t.part.select("p_partkey", F.col("p_brand").alias("artist"), title_column(F.col("p_partkey"), F.col("p_name"), F.col("p_brand")).alias("title"))


def title_sql(number: str, name: str, brand: str) -> str:
    made = ", ".join(f"{name} || " + _quoted(d).replace("{b}", f"' || {brand} || '") for d in _DECORATIONS)
    return f"list_extract([{made}], CAST({number} % 10 + 1 AS BIGINT))"


TITLES_SQL = f"SELECT p_partkey, p_brand AS artist, {title_sql('p_partkey', 'p_name', 'p_brand')} AS title FROM part"


def _version_sql(text: str) -> str:
    return _strip(_replace(_replace(text, fv.VERSION_BRACKET), fv.VERSION_DASH_TAIL))


def song_id_sql(source: str, key: str) -> str:
    """Keys and song ids of a query with the columns ``key``, ``title`` and ``artist``: long division by 62^10, 60 bits at a time."""
    limbs = ", ".join(f"('0x' || substr(h, {15 * i + 1}, 15))::HUGEINT AS a{i}" for i in range(5))
    now = f"SELECT {key}, {limbs} FROM (SELECT {key}, lpad(sha256(lower(trim(title)) || '|' || lower(trim(artist))), 75, '0') AS h FROM ({source}))"
    groups: list[str] = []
    for left in range(4, 0, -1):
        rest, columns = "a0", [key, *groups]
        for i in range(1, left + 1):
            whole = f"({rest} * {2**60} + a{i})"
            columns.append(f"{whole} // {62**10} AS a{i - 1}")
            rest = f"{whole} % {62**10}"
        now = f"SELECT {', '.join(columns)}, {rest} AS g{left} FROM ({now})"
        groups.append(f"g{left}")
    powers = ", ".join(str(62**k) for k in reversed(range(10)))
    digits = [f"array_to_string(list_transform([{powers}], lambda p: substr('{ids.DIGITS}', ({g} // p % 62 + 1)::INT, 1)), '')" for g in ("a0", *reversed(groups))]
    return f"SELECT {key}, rpad(substr(ltrim({' || '.join(digits)}, '0'), 1, 22), 22, '0') AS song_id FROM ({now})"


@query("t1_song_id", song_id_sql("SELECT p_partkey, p_name AS title, p_brand AS artist FROM part", "p_partkey"))
def _song_id(t: Tables):
    return t.part.select("p_partkey", ids.song_id(F.col("p_name"), F.col("p_brand")).alias("song_id"))


@query("t2_strip_version_markers", f"SELECT p_partkey, {_version_sql('title')} AS title FROM ({TITLES_SQL})")
def _versions(t: Tables):
    return titles(t).select("p_partkey", tx.strip_version_markers(F.col("title")).alias("title"))


@query("t2_strip_version_markers_documents", f"SELECT doc_id, {_version_sql('text')} AS title FROM documents")
def _versions_documents(t: Tables):
    return t.spread("documents").select("doc_id", tx.strip_version_markers(F.col("text")).alias("title"))


@query("t3_plain_quotes", "SELECT doc_id, translate(translate(text, 'éèê', '’‘“'), '’‘ʼ“”', '''''''\"\"') AS text FROM documents")
def _quotes(t: Tables):
    return t.spread("documents").select("doc_id", tx.plain_quotes(F.translate("text", "éèê", "’‘“")).alias("text"))


@query("t4_clean_title", f"SELECT p_partkey, trim({_replace(_replace(_replace('title', fv.NOISE_BRACKET), fv.NOISE_DASH_TAIL), fv.NOISE_PIPE_TAIL)}, ' -_.') AS title FROM ({TITLES_SQL})")
def _clean(t: Tables):
    return titles(t).select("p_partkey", tx.clean_title(F.col("title")).alias("title"))


@query("t5_match_words", r"""
    SELECT doc_id, trim(regexp_replace(strip_accents(replace(replace(translate(lower(text), '’‘ʼ“”', '''''''""'), '''', ''), '$', 's')), '[^\p{L}\p{N}\p{M}]+', ' ', 'g')) AS words FROM documents""")
def _match_words(t: Tables):
    return t.spread("documents").select("doc_id", tx.match_words(F.col("text")).alias("words"))


@query("t6_word_key", r"SELECT doc_id, coalesce(' ' || nullif(trim(regexp_replace(lower(text), '[^\p{L}\p{N}\p{M}]+', ' ', 'g')), '') || ' ', '') AS key FROM documents")
def _word_key(t: Tables):
    return t.spread("documents").select("doc_id", tx.word_key(F.col("text")).alias("key"))


@query("t7_plain_and_core_title", f"""
    SELECT p_partkey, CASE WHEN p_partkey % 10 IN (1, 4, 5, 6, 7) THEN p_name ELSE title END AS plain,
        CASE WHEN p_partkey % 10 = 3 THEN p_name || ' some name' WHEN p_partkey % 10 IN (4, 5, 6, 7, 1, 0, 2) THEN p_name
             WHEN p_partkey % 10 = 8 THEN p_name || ' titanium remix' ELSE p_name END AS core
    FROM (SELECT *, {title_sql('p_partkey', 'p_name', 'p_brand')} AS title FROM part)""")
def _plain_core(t: Tables):
    return titles(t).select("p_partkey", tx.plain_title(F.col("title")).alias("plain"), tx.core_title_words(tx.plain_title(F.col("title"))).alias("core"))


@query("t8_parse_featured", f"""
    SELECT p_partkey, CASE p_partkey % 10 WHEN 6 THEN artist || '+Third' WHEN 7 THEN artist ELSE '' END AS guests FROM ({TITLES_SQL})""")
def _featured(t: Tables):
    return titles(t).select("p_partkey", F.array_join(tx.parse_featured(F.col("title")), "+").alias("guests"))


_CREDITS_SQL = """
    SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN s_name || ' feat. ' || n_name WHEN 1 THEN s_name || ' & ' || n_name WHEN 2 THEN s_name || ' ft. ' || n_name || ' x DJ' ELSE s_name END AS credit,
        s_name, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey"""


def _credits(t: Tables):
    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    n, a, b = F.col("s_suppkey") % 4, F.col("s_name"), F.col("n_name")
    return rows.select("s_suppkey", F.when(n == 0, F.concat(a, F.lit(" feat. "), b)).when(n == 1, F.concat(a, F.lit(" & "), b)).when(
        n == 2, F.concat(a, F.lit(" ft. "), b, F.lit(" x DJ"))).otherwise(a).alias("credit"))


@query("t9_credited_artists", f"""
    SELECT s_suppkey, CASE s_suppkey % 4 WHEN 1 THEN credit ELSE s_name END AS main,
        CASE s_suppkey % 4 WHEN 0 THEN credit || '+' || s_name || '+' || n_name WHEN 1 THEN credit || '+' || s_name || '+' || n_name
            WHEN 2 THEN credit || '+' || s_name || '+' || n_name || '+DJ' ELSE s_name END AS names FROM ({_CREDITS_SQL})""")
def _credited(t: Tables):
    return _credits(t).select("s_suppkey", tx.main_artist(F.col("credit")).alias("main"), F.array_join(tx.credited_names(F.col("credit")), "+").alias("names"))


# a title and a channel per part: dash, colon, Topic, VEVO and title-first uploads
def videos(t: Tables):
    k = F.col("p_partkey")
    name, brand = F.col("p_name"), F.translate("p_brand", "#", " ")
    n = k % 6
    title = F.when(n == 0, F.concat(brand, F.lit(" - "), name, F.lit(" (Official Video) 🎵"))).when(n == 1, F.concat(brand, F.lit(": "), name, F.lit(" Official Music Video HD"))).when(
        n == 2, F.concat(name, F.lit(" (Radio Edit)"))).when(n == 3, name).when(n == 4, F.concat(name, F.lit(" - "), brand)).otherwise(F.concat(F.lit("The Composer: "), name))
    uploader = F.when(n == 2, F.concat(brand, F.lit(" - Topic"))).when(n == 3, F.concat(brand, F.lit("VEVO"))).when(n == 4, brand).when(n == 5, F.concat(brand, F.lit(" - Topic"))).otherwise("Fan Uploads")
    return t.spread("part").select(k.alias("video_id"), title.alias("video_title"), uploader.alias("uploader"))


_VIDEOS_PARSED_SQL = """
    SELECT p_partkey AS video_id, CASE p_partkey % 6 WHEN 2 THEN p_name || ' (Radio Edit)' WHEN 5 THEN 'The Composer: ' || p_name ELSE p_name END AS title,
        replace(p_brand, '#', ' ') AS artist, CASE WHEN p_partkey % 6 = 5 THEN 'The Composer' END AS mentioned_artist FROM part"""


@query("t10_parse_video_title", _VIDEOS_PARSED_SQL)
def _video(t: Tables):
    return tx.with_parsed_video(videos(t), "video_title", "uploader").select("video_id", "parsed.title", "parsed.artist", "parsed.mentioned_artist")


@query("t11_guess_track", """
    SELECT p_partkey AS video_id, p_name AS title, 'Query Artist' AS artist FROM part WHERE p_size >= 20 UNION ALL
    SELECT p_partkey, p_name, replace(p_brand, '#', ' ') FROM part WHERE p_size < 20""")
def _guess(t: Tables):
    brand = F.translate("p_brand", "#", " ")
    uploader = F.when(F.col("p_size") >= 20, "Some Label").otherwise(F.concat(brand, F.lit(" - Topic")))
    asked = F.concat(F.lit("Query Artist - "), F.col("p_name"), F.lit(" (Lyric Video)"))
    rows = t.part.select(F.col("p_partkey").alias("video_id"), F.col("p_name").alias("video_title"), uploader.alias("uploader"), asked.alias("query"))
    return tx.with_guessed_track(rows, "video_title", "uploader", "query").select("video_id", "guess.title", "guess.artist")


@query("t12_split_query", "SELECT p_partkey, lower(replace(p_brand, '#', ' ')) AS artist, p_name AS song FROM part")
def _split_query(t: Tables):
    text = F.concat("p_brand", F.lit(" – "), "p_name", F.lit(" (Official Audio) [HD]"))
    return t.part.select("p_partkey", tx.query_artist(text).alias("artist"), F.array_join(tx.query_song_words(text), " ").alias("song"))


_DATE_FORMS = [("yyyy-MM-dd", "%Y-%m-%d"), ("yyyyMMdd", "%Y%m%d"), ("yyyy", "%Y"), ("d MMM yyyy, HH:mm", "%-d %b %Y, %H:%M"), ("yyyy/MM/dd", "%Y/%m/%d"), ("'released in 'yyyy", "released in %Y"), ("yyyy.MM.dd", "%Y.%m.%d"), ("'soon'", "soon")]


def _dates(t: Tables):
    forms = F.array(*[F.date_format("o_orderdate", f) for f, _ in _DATE_FORMS])
    return t.orders.select("o_orderkey", "o_custkey", F.get(forms, (F.col("o_orderkey") % 8).cast("int")).alias("raw"))


_NORMAL_DATE_SQL = """
    CASE WHEN o_orderkey % 8 IN (2, 5) THEN strftime(o_orderdate, '%Y') WHEN o_orderkey % 8 <> 7 THEN strftime(o_orderdate, '%Y-%m-%d') END"""


@query("t13_normalize_date", f"SELECT o_orderkey, {_NORMAL_DATE_SQL} AS date FROM orders")
def _normalize_date(t: Tables):
    return _dates(t).select("o_orderkey", tx.normalize_date(F.col("raw")).alias("date"))


@query("t14_better_date", f"""
    SELECT o_custkey, coalesce(min(date) FILTER (WHERE length(date) = 10), min(date)) AS best, count(*) FILTER (WHERE length(date) = 4) AS years, bool_or(date IS NULL) AS some_missing
    FROM (SELECT o_custkey, {_NORMAL_DATE_SQL} AS date FROM orders) GROUP BY o_custkey""")
def _better_date(t: Tables):
    dates = _dates(t).select("o_custkey", tx.normalize_date(F.col("raw")).alias("date"))
    best = dates.groupBy("o_custkey").agg(
        F.min_by("date", F.when(F.col("date").isNotNull(), tx.date_order(F.col("date")))).alias("best"),
        F.count_if(tx.date_precision(F.col("date")) == 1).alias("years"), F.bool_or(F.col("date").isNull()).alias("some_missing"))
    # the pairwise form agrees with the aggregate
    return best.withColumn("best", tx.better_date(F.col("best"), F.substring("best", 1, 4)))


@query("t15_release_year", f"""
    SELECT o_orderkey, CASE WHEN o_orderkey % 8 IN (0, 1, 2, 4, 6) THEN CAST(year(o_orderdate) AS INTEGER) END AS year FROM orders""")
def _release_year(t: Tables):
    return _dates(t).select("o_orderkey", nu.release_year(F.col("raw")).alias("year"))


@query("t16_strip_html", f"SELECT page_id, {_strip(_replace(_replace('html', '(?i)<a[^>]*>.*?</a>'), '<[^>]+>'))} AS text FROM pages")
def _strip_html(t: Tables):
    return t.pages.select("page_id", tx.strip_html(F.col("html")).alias("text"))


@query("t17_preferred_album", """
    SELECT p_partkey, CASE WHEN p_size <= 15 THEN p_name WHEN p_size <= 25 THEN NULL WHEN p_size <= 35 THEN CASE WHEN p_retailprice > 1000 THEN p_name || ' Soundtrack' END ELSE p_name END AS album FROM part""")
def _preferred_album(t: Tables):
    size, name = F.col("p_size"), F.col("p_name")
    provider = F.when(size <= 25, F.concat(F.lit("Greatest Hits: "), name)).when(size <= 35, F.concat(name, F.lit(" Soundtrack"))).otherwise(F.concat(name, F.lit(" (Remastered 2011)")))
    return t.part.select("p_partkey", tx.preferred_album(F.when(size <= 15, name), provider, F.col("p_retailprice") > 1000).alias("album"))


@query("t18_similar_ratio")
def _similar(t: Tables):
    pairs = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    wanted = F.concat("c_name", F.lit(" "), "o_orderpriority")
    found = F.concat(F.lit("Customer "), "c_custkey", F.lit(" "), "o_orderpriority")
    return pairs.select("o_orderkey", rounded(tx.sequence_ratio(wanted, found), 6).alias("ratio"), tx.title_similar(wanted, found).alias("similar"))


@query("t19_chord_symbol", """
    SELECT p_partkey, CASE WHEN p_size <> 3 THEN p_brand || CASE WHEN p_size > 25 THEN 'm' ELSE '' END END AS chord,
        CASE WHEN p_size <> 3 THEN p_brand || CASE WHEN p_size > 25 THEN ' minor' WHEN p_size < 9 THEN '' ELSE ' major' END END AS key FROM part""")
def _chords(t: Tables):
    key = F.when(F.col("p_size") != 3, F.col("p_brand"))
    scale = F.when(F.col("p_size") > 25, "minor").when(F.col("p_size") >= 9, "major")
    return t.part.select("p_partkey", tx.chord_symbol(key, scale).alias("chord"), tx.key_name(key, scale).alias("key"))


@query("t20_label_text", "SELECT p_partkey, p_brand || ', ' || p_type || ' – ' || p_name AS label FROM part")
def _label_text(t: Tables):
    return t.part.select("p_partkey", tx.label_text(F.to_json(F.array("p_brand", "p_type")), F.col("p_name")).alias("label"))


@query("t21_latin_name", """
    SELECT c_custkey, CASE c_nationkey % 3 WHEN 0 THEN 'Given ' || c_name WHEN 1 THEN 'Plain ' || c_name ELSE 'Чайковский ' || c_name END AS name FROM customer""")
def _latin(t: Tables):
    n = F.col("c_nationkey") % 3
    name = F.concat(F.when(n == 1, "Plain ").otherwise("Чайковский "), F.col("c_name"))
    sort_name = F.when(n == 2, "no comma").otherwise(F.concat(F.col("c_name"), F.lit(", Given")))
    return t.customer.select("c_custkey", tx.latin_name(name, sort_name).alias("name"))


# --- lists ------------------------------------------------------------------------

_WORDS_SQL = r"list_filter(regexp_split_to_array(lower(text), '[ \t\n\x0B\f\r.,]+'), lambda w: w <> '')"


def _word_lists(t: Tables):
    words = F.filter(F.split(F.lower("text"), r"[\s.,]+"), lambda w: w != "")
    return t.conversations.select("conv_id", "turn", "role", words.alias("words"))


def _unique(expression: str) -> str:
    return f"list_filter({expression}, lambda x, i: list_position({expression}, x) = i)"


@query("u1_ordered_union", f"""
    SELECT conv_id, turn, array_to_string({_unique("l")}, ' ') AS names FROM (SELECT conv_id, turn, list_concat([role, 'user'], {_WORDS_SQL}) AS l FROM conversations)""")
def _union(t: Tables):
    rows = _word_lists(t)
    joined = tx.ordered_union(F.array("role"), F.array(F.lit("user")), F.col("words"), F.lit(None).cast("array<string>"))
    return rows.select("conv_id", "turn", F.array_join(joined, " ").alias("names"))


@query("u2_final_featured", f"""
    SELECT conv_id, turn, array_to_string(list_filter({_unique("l")}, lambda x: x <> 'the'), ' ') AS names FROM (SELECT conv_id, turn, {_WORDS_SQL} AS l FROM conversations)""")
def _final(t: Tables):
    rows = _word_lists(t)
    return rows.select("conv_id", "turn", F.array_join(tx.final_featured(F.lit("THE"), F.col("words")), " ").alias("names"))


@query("u3_dedup_featured", f"""
    SELECT conv_id, turn, array_to_string(list_filter({_unique("l")}, lambda x: NOT list_bool_or(list_transform(l, lambda y: contains(y, x) AND length(y) > length(x)))), ' ') AS names
    FROM (SELECT conv_id, turn, {_WORDS_SQL} AS l FROM conversations)""")
def _dedup(t: Tables):
    rows = _word_lists(t)
    return rows.select("conv_id", "turn", F.array_join(tx.dedup_featured(F.col("words")), " ").alias("names"))
