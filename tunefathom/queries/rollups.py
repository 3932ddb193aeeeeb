"""Frames, patches and segments rolled up to songs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tunefathom import fixed_values as fv
from tunefathom.functions.numeric import let
from tunefathom.operators import rollups as ro
from tunefathom.plans.shapes import rounded
from tunefathom.queries.registry import Tables, query, sql_round, whole_words
from tunefathom.queries.series import series_songs


def _frames(t: Tables):
    """Every word of every document is a frame: its first letter the chord, its length the value."""
    rows = t.spread("documents").select(F.col("doc_id").alias("song_id"), F.posexplode_outer(whole_words(F.col("text"))).alias("frame_idx", "word")).filter("frame_idx is not null")
    return rows.select("song_id", "frame_idx", F.length("word").cast("double").alias("value"), F.substring("word", 1, 1).alias("chord"), (F.length("word") / 20).alias("strength"))


_FRAMES_SQL = r"""
    SELECT song_id, generate_subscripts(words, 1) - 1 AS frame_idx, length(unnest(words))::DOUBLE AS value, substr(unnest(words), 1, 1) AS chord, length(unnest(words)) / 20 AS strength FROM (
        SELECT doc_id AS song_id, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS words FROM documents)"""


@query("a18_seconds_from_frames", f"SELECT song_id, frame_idx // 43 AS second, {sql_round('avg(value)', 4)} AS value FROM ({_FRAMES_SQL}) GROUP BY 1, 2")
def _seconds(t: Tables):
    return ro.seconds_from_frames(_frames(t), "value")


@query("a18_loudness_seconds", f"SELECT song_id, frame_idx // 10 AS second, {sql_round('avg(strength)', 4)} AS value FROM ({_FRAMES_SQL}) GROUP BY 1, 2")
def _loudness_seconds(t: Tables):
    return ro.seconds_from_frames(_frames(t), "strength", fv.LOUDNESS_VALUES_PER_SECOND)


@query("a19_song_means", f"SELECT song_id, {sql_round('avg(value)', 4)} AS value_mean, {sql_round('avg(strength)', 4)} AS strength_mean FROM ({_FRAMES_SQL}) GROUP BY 1")
def _song_means(t: Tables):
    return ro.song_means_from_frames(_frames(t), ["value", "strength"])


@query("a20_vector_mean", f"""
    SELECT label AS song_id, CAST(i - 1 AS INTEGER) AS i, {sql_round('avg(v)', 6)} AS mean FROM (
        SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY label, i""")
def _vector_mean(t: Tables):
    rows = ro.vector_mean(t.embeddings.withColumnRenamed("label", "song_id"), "embedding", 64)
    return rows.select("song_id", F.posexplode("embedding_mean").alias("i", "mean")).withColumn("mean", rounded(F.col("mean"), 6))


_CHANGES_SQL = f"SELECT *, coalesce(chord <> lag(chord) OVER (PARTITION BY song_id ORDER BY frame_idx), false) AS changed FROM ({_FRAMES_SQL})"


@query("w9_chord_changes", f"SELECT song_id, count(*) AS frames, count(*) FILTER (WHERE changed) AS changes FROM ({_CHANGES_SQL}) GROUP BY song_id")
def _changes(t: Tables):
    return ro.chord_changes(_frames(t)).groupBy("song_id").agg(F.count("*").alias("frames"), F.count_if("changed").alias("changes"))


@query("a21_chord_stats", f"""
    WITH f AS ({_CHANGES_SQL}), c AS (SELECT song_id, chord, row_number() OVER (PARTITION BY song_id ORDER BY count(*) DESC, min(frame_idx)) AS place FROM f GROUP BY 1, 2)
    SELECT song_id, c.chord, {sql_round('avg(strength)', 4)} AS strength_mean, {sql_round('count(*) FILTER (WHERE changed) / count(*)', 4)} AS change_rate
    FROM f JOIN c USING (song_id) WHERE place = 1 GROUP BY song_id, c.chord""")
def _chord_stats(t: Tables):
    return ro.chord_stats(_frames(t))


_MODELS = ["mood_happy", "mood_sad", "mood_aggressive", "mood_party", "mood_relaxed", "approachability", "engagement", "voice_instrumental", "gender"]


def _patches(t: Tables):
    names = F.array(*[F.lit(m) for m in _MODELS])
    return t.embeddings.select((F.col("label") % 3).alias("song_id"), F.get(names, (F.col("vec_id") % 9).cast("int")).alias("model"), F.col("vec_id").alias("patch_idx"), F.col("embedding").alias("probs"))


_PATCHES_SQL = f"""
    SELECT label % 3 AS song_id, list_extract({_MODELS}, vec_id % 9 + 1) AS model, vec_id AS patch_idx, embedding[1]::DOUBLE AS p0, embedding[2]::DOUBLE AS p1,
        CASE WHEN vec_id % 9 IN (0, 2) THEN embedding[1]::DOUBLE ELSE embedding[2]::DOUBLE END AS chosen,
        CASE WHEN vec_id % 9 IN (0, 2, 5, 6, 7, 8) THEN embedding[1]::DOUBLE ELSE embedding[2]::DOUBLE END AS shown FROM embeddings"""


@query("a22_class_scores", f"""
    SELECT song_id, model, {sql_round('avg(p0)', 4)} AS first_mean, {sql_round('avg(p1)', 4)} AS second_mean, {sql_round('avg(chosen)', 4)} AS score FROM ({_PATCHES_SQL}) GROUP BY 1, 2""")
def _class_scores(t: Tables):
    return ro.class_scores(_patches(t))


@query("a22_class_series", f"SELECT song_id, model, patch_idx, {sql_round('shown', 4)} AS value FROM ({_PATCHES_SQL})")
def _class_series(t: Tables):
    return ro.class_series(_patches(t))


@query("a23_arousal_valence", f"SELECT song_id, {sql_round('avg(p0)', 4)} AS arousal, {sql_round('avg(p1)', 4)} AS valence FROM ({_PATCHES_SQL}) GROUP BY 1")
def _arousal(t: Tables):
    return ro.arousal_valence(_patches(t))


@query("a23_arousal_valence_series", f"SELECT song_id, patch_idx, {sql_round('p0', 4)} AS arousal, {sql_round('p1', 4)} AS valence FROM ({_PATCHES_SQL})")
def _arousal_series(t: Tables):
    return ro.arousal_valence_series(_patches(t))


_CLASSES = [f"G{i % 9}---D{i}" for i in range(64)]


def _class_means(t: Tables):
    rows = t.embeddings.select(F.col("label").alias("song_id"), F.transform("embedding", lambda v: F.abs(v.cast("double"))).alias("probs"))
    return ro.class_means(rows, _CLASSES)


_CLASS_MEANS_SQL = f"""
    SELECT song_id, list_extract({_CLASSES}, i) AS label, avg(v) AS score FROM (
        SELECT label AS song_id, generate_subscripts(embedding, 1) AS i, abs(unnest(embedding)::DOUBLE) AS v FROM embeddings) GROUP BY song_id, i"""


@query("a24_parent_genre_shares", f"""
    WITH m AS ({_CLASS_MEANS_SQL}), s AS (SELECT song_id, split_part(label, '---', 1) AS genre, sum(score) / sum(sum(score)) OVER (PARTITION BY song_id) AS share FROM m GROUP BY 1, 2)
    SELECT song_id, genre, {sql_round('share', 4)} AS share FROM s WHERE share >= 0.01""")
def _shares(t: Tables):
    return ro.parent_genre_shares(_class_means(t))


@query("w4_top_classes", f"""
    SELECT song_id, label, {sql_round('score', 4)} AS score, row_number() OVER (PARTITION BY song_id ORDER BY score DESC, label) AS rank FROM ({_CLASS_MEANS_SQL}) QUALIFY rank <= 10""")
def _top_classes(t: Tables):
    return ro.top_classes(_class_means(t))


_SEGMENTS_SQL = """
    SELECT user_id AS song_id, event_id AS idx, CASE event_type WHEN 'view' THEN 'music' WHEN 'click' THEN 'noise' ELSE 'speech' END AS label,
        event_id * 2.0 AS s, event_id * 2.0 + 1.5 AS e FROM events"""


@query("w5_music_span", f"""
    WITH g AS ({_SEGMENTS_SQL}), m AS (SELECT song_id, min(idx) FILTER (WHERE label = 'music') AS f, max(idx) FILTER (WHERE label = 'music') AS l, min(s) AS ts, max(e) AS te FROM g GROUP BY 1),
    b AS (SELECT g.song_id, max(idx) FILTER (WHERE idx < f AND label = 'speech') AS before, min(idx) FILTER (WHERE idx > l AND label = 'speech') AS after FROM g JOIN m USING (song_id) GROUP BY 1),
    p AS (SELECT g.song_id, min(s) FILTER (WHERE idx > coalesce(before, -1)) AS s, max(e) FILTER (WHERE idx < coalesce(after, 1e15)) AS e FROM g JOIN b USING (song_id) GROUP BY 1)
    SELECT song_id, (CASE WHEN s - ts < 2.5 THEN ts ELSE s END)::DOUBLE AS start, (CASE WHEN te - e < 2.5 THEN te ELSE e END)::DOUBLE AS "end" FROM p JOIN m USING (song_id) WHERE f IS NOT NULL""")
def _music_span(t: Tables):
    label = F.when(F.col("event_type") == "view", "music").when(F.col("event_type") == "click", "noise").otherwise("speech")
    segments = t.events.select(F.col("user_id").alias("song_id"), F.col("event_id").alias("idx"), label.alias("label"),
                               (F.col("event_id") * 2.0).alias("start"), (F.col("event_id") * 2.0 + 1.5).alias("end"))
    return ro.music_span(segments)


@query("w6_chorus_segment")
def _chorus(t: Tables):
    # word lengths and their running difference as two signals; the words are the seconds
    songs = series_songs(t).withColumn("duration_seconds", F.size("values").cast("double"))
    steps = let(F.col("values"), lambda vs: F.transform(vs, lambda v, i: v - F.coalesce(F.get(vs, i - 1), F.lit(0.0))))
    return ro.chorus_segment(songs.withColumn("steps", steps), ["values", "steps"])
