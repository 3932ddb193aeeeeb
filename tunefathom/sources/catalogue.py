"""Landed catalogue documents as flat tables. Documents are read with their declared schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tunefathom import schemas
from tunefathom.functions import text as tx
from tunefathom.plans.shapes import rounded
from tunefathom.sources.library import json_list


def scan_catalogue(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Newline-delimited JSON documents."""
    return spark.read.schema(schema).json(path)


def flatten_playlist_items(pages: DataFrame) -> DataFrame:
    """``(playlist_id, position, track_id, ...)`` of playlist pages; episodes, local files and incomplete rows are left out.

    An entry holds its track as ``item`` or as ``track``. Positions number the kept tracks over all pages of a playlist;
    only the pages' counts are ordered, not the tracks.
    """
    def names(of) -> Column:
        return F.filter(F.transform(of["artists"], lambda a: a["name"]), lambda n: n.isNotNull() & (n != ""))

    def usable(t) -> Column:
        return F.coalesce((t["type"] == "track") & ~F.coalesce(t["is_local"], F.lit(False)) & (F.coalesce(t["id"], F.lit("")) != "") & (
            F.coalesce(t["name"], F.lit("")) != "") & (F.size(names(t)) > 0), F.lit(False))
    kept = pages.select("playlist_id", "page", F.filter(F.transform("items", lambda i: F.coalesce(i["item"], i["track"])), usable).alias("_tracks"))
    before = Window.partitionBy("playlist_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    placed = kept.withColumn("_before", F.coalesce(F.sum(F.size("_tracks")).over(before), F.lit(0)))
    rows = placed.select("playlist_id", "_before", F.posexplode("_tracks").alias("_at", "_t"))
    return rows.select(
        "playlist_id", (F.col("_before") + F.col("_at")).cast("int").alias("position"), F.col("_t.id").alias("track_id"), F.col("_t.name").alias("title"), names(F.col("_t")).alias("artists"),
        F.col("_t.duration_ms").alias("duration_ms"), F.col("_t.external_ids.isrc").alias("isrc"), F.col("_t.album.id").alias("album_id"),
        F.col("_t.album.name").alias("album_name"),
        F.filter(F.transform("_t.album.artists", lambda a: a["name"]), lambda n: n.isNotNull() & (n != "")).alias("album_artists"))


def _credit_name(credit):
    return tx.latin_name(F.coalesce(tx.none_if_empty(credit["name"]), credit["artist"]["name"], F.lit("")), F.coalesce(credit["artist"]["sort-name"], F.lit("")))


def recordings(search: DataFrame) -> DataFrame:
    """``(query_id, position, recording_id, hit_title, hit_artist, sort_name, featured, score)`` of search documents."""
    rows = search.select("query_id", F.posexplode("recordings").alias("position", "_r"))
    names = F.filter(F.transform("_r.artist-credit", _credit_name), lambda n: n != "")
    return rows.filter((F.coalesce("_r.title", F.lit("")) != "") & (F.size(names) > 0)).select(
        "query_id", "position", F.col("_r.id").alias("recording_id"), F.col("_r.title").alias("hit_title"),
        tx.plain_quotes(F.get(names, F.lit(0))).alias("hit_artist"),
        F.coalesce(F.get(F.col("_r.artist-credit"), F.lit(0))["artist"]["sort-name"], F.lit("")).alias("sort_name"),
        F.transform(F.slice(names, 2, F.greatest(F.size(names) - 1, F.lit(0))), tx.plain_quotes).alias("featured"), F.col("_r.score").alias("score"))


def releases(search: DataFrame, wanted: DataFrame) -> DataFrame:
    """Releases of recordings that are the wanted song: same title without version markers, same first credit.

    ``wanted``: query_id, title, artist. The result is the input of ``album_candidates`` (song_id = query_id).
    """
    rows = search.select("query_id", F.explode("recordings").alias("_r")).join(wanted, "query_id")
    first = F.get(F.col("_r.artist-credit"), F.lit(0))
    credited = (tx.casefold(first["name"]) == tx.casefold(F.col("artist"))) | (tx.casefold(first["artist"]["name"]) == tx.casefold(F.col("artist")))
    same = tx.casefold(tx.strip_version_markers(F.col("_r.title"))) == tx.casefold(tx.strip_version_markers(F.col("title")))
    own = rows.filter(F.coalesce(credited, F.lit(False)) & same).select("query_id", "title", "artist", F.explode("_r.releases").alias("_l"))
    by = F.get(F.col("_l.artist-credit"), F.lit(0))
    own_name = tx.casefold(by["artist"]["name"]) == tx.casefold(F.col("artist"))
    return own.select(
        F.col("query_id").alias("song_id"), F.col("title").alias("song_title"), F.col("artist").alias("song_artist"),
        F.col("_l.release-group.id").alias("group_id"), F.col("_l.release-group.title").alias("group_title"), F.col("_l.title").alias("release_title"),
        F.col("_l.release-group.primary-type").alias("primary_type"), F.col("_l.release-group.secondary-types").alias("secondary_types"),
        F.col("_l.status").alias("status"), F.col("_l.date").alias("date"),
        # credited under either name
        F.when(F.coalesce(own_name, F.lit(False)), F.col("artist")).otherwise(F.coalesce(by["name"], by["artist"]["name"])).alias("release_artist"))


def _name_of(field: Column) -> Column:
    """An artist given as text, or as an object with a name."""
    return F.when(F.startswith(F.trim(field), F.lit("{")), F.get_json_object(field, "$.name")).otherwise(field)


def similar_tracks(documents: DataFrame, key: str, text: str) -> DataFrame:
    """Up to five similar tracks per document; a single object counts as a list of one, a missing match as 0."""
    rows = documents.select(key, F.slice(json_list(F.col(text), schemas.SIMILAR_TRACKS), 1, 5).alias("_s"))
    # outer: else a filter on the list would be moved below the parsing, with a second copy of it
    entries = rows.select(key, F.posexplode_outer("_s").alias("position", "_e")).filter(F.col("position").isNotNull())
    return entries.select(
        key, "position", F.col("_e.name").alias("title"), tx.none_if_empty(_name_of(F.col("_e.artist"))).alias("artist"),
        rounded(F.coalesce(F.col("_e.match").try_cast("double"), F.lit(0.0)), 4).alias("similarity"))


def track_info(documents: DataFrame, key: str, text: str) -> DataFrame:
    """Title, guests, counts (0 when missing) and normalised date of track documents."""
    schema = "name string, artist string, album struct<title: string>, playcount string, listeners string, mbid string, url string, wiki struct<published: string>"
    t = F.from_json(F.get_json_object(text, "$.track"), schema)
    return documents.select(key, t.alias("_t")).select(
        key, F.col("_t.name").alias("title"), tx.none_if_empty(_name_of(F.col("_t.artist"))).alias("artist"), tx.parse_featured(F.col("_t.name")).alias("featured"),
        tx.none_if_empty(F.col("_t.album.title")).alias("album"), tx.normalize_date(F.col("_t.wiki.published")).alias("release_date"),
        F.coalesce(F.col("_t.playcount").try_cast("bigint"), F.lit(0)).alias("playcount"),
        F.coalesce(F.col("_t.listeners").try_cast("bigint"), F.lit(0)).alias("listeners"),
        tx.none_if_empty(F.col("_t.mbid")).alias("recording_id"), tx.none_if_empty(F.col("_t.url")).alias("url"))


def artist_info(documents: DataFrame, key: str, text: str) -> DataFrame:
    """Counts, plain-text biography and up to five similar artists of artist documents."""
    schema = "stats struct<playcount: string, listeners: string>, bio struct<summary: string>"
    a = F.from_json(F.get_json_object(text, "$.artist"), schema)
    similar = json_list(F.coalesce(F.get_json_object(text, "$.artist.similar.artist"), F.lit("[]")), "array<struct<name: string>>")
    return documents.select(key, a.alias("_a"), F.transform(F.slice(similar, 1, 5), lambda s: s["name"]).alias("similar_artists")).select(
        key, F.coalesce(F.col("_a.stats.playcount").try_cast("bigint"), F.lit(0)).alias("artist_playcount"),
        F.coalesce(F.col("_a.stats.listeners").try_cast("bigint"), F.lit(0)).alias("artist_listeners"),
        tx.none_if_empty(tx.strip_html(F.coalesce("_a.bio.summary", F.lit("")))).alias("artist_bio"), "similar_artists")
