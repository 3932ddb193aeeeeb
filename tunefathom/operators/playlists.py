"""Playlist copies, imports and their bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tunefathom.functions import text as tx
from tunefathom.operators.filters import failure_reason
from tunefathom.operators.matching import resolve_tracks
from tunefathom.operators.ranking import latest_per
from tunefathom.plans.shapes import even_chunks, following_event, top_n

STATUSES = ["queued", "saved", "duplicate", "failed"]


def owned_or_collaborative(playlists: DataFrame, user: str, owner: str = "owner_id") -> DataFrame:
    return playlists.filter(F.coalesce(F.col(owner) == user, F.lit(False)) | F.coalesce("collaborative", F.lit(False)))


def playlist_view(entries: DataFrame, resolved: DataFrame, playlists: DataFrame, links: DataFrame, songs: DataFrame) -> DataFrame:
    """Tracks of each playlist in order with their library song; playlists without a stored list show their linked songs.

    ``entries``: playlist_id, position, track_id, title, artists. ``resolved``: track_id, song_id.
    ``playlists``: playlist_id, has_tracks. ``links``: playlist_id, song_id, position. ``songs``: song_id, title, artist.
    """
    stored = entries.join(playlists.filter("has_tracks").select("playlist_id"), "playlist_id", "left_semi").join(resolved, "track_id", "left").select(
        "playlist_id", "position", "title", F.array_join("artists", ", ").alias("artists"), "song_id")
    bare = links.join(playlists.filter("not has_tracks").select("playlist_id"), "playlist_id", "left_semi").join(songs, "song_id").select(
        "playlist_id", "position", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("artist", F.lit("")).alias("artists"), "song_id")
    return stored.unionByName(bare)


def remove_missing(entries: DataFrame, kept: DataFrame, kinds: list[str], playlist: str = "playlist_id") -> DataFrame:
    """The entries to drop: of these kinds and no longer listed."""
    return entries.filter(F.col("kind").isin(kinds)).join(kept.select("user_id", playlist), ["user_id", playlist], "left_anti")


def import_running(imports: DataFrame, tracks: DataFrame) -> DataFrame:
    """Imports that still have a queued track."""
    return imports.join(tracks.filter("status = 'queued'").select("import_id"), "import_id", "left_semi")


def changed_playlists(remote: DataFrame, stored: DataFrame) -> DataFrame:
    """Which remote playlists have to be read again.

    ``remote``: user_id, playlist_id, version. ``stored``: user_id, playlist_id, version, has_tracks, lacks_album.
    """
    held = stored.select("user_id", "playlist_id", F.col("version").alias("_v"), "has_tracks", "lacks_album", F.lit(True).alias("_known"))
    same = F.col("_known").isNotNull() & F.col("version").isNotNull() & F.col("version").eqNullSafe(F.col("_v"))
    usable = F.coalesce("has_tracks", F.lit(False)) & ~F.coalesce("lacks_album", F.lit(False))
    return remote.join(held, ["user_id", "playlist_id"], "left").select("user_id", "playlist_id", "version", (~(same & usable)).alias("read_again"))


def lacks_album(tracks: Column) -> Column:
    """A stored track list from before tracks kept their album: an entry whose album id is absent."""
    return F.exists(tracks, lambda t: t["album_id"].isNull())


def backfill_finished(tracks: DataFrame, failures: DataFrame, imports: DataFrame) -> DataFrame:
    """``(id, finished_at)`` of failed tracks: the earliest failure since the import began with the same video and label.

    ``tracks``: id, import_id, video_id, title, artists_json, status. ``failures``: video_id, label, created_at. ``imports``: import_id, created_at.
    """
    def key(video: Column, label: Column) -> Column:
        # equal videos or both without one
        return F.concat_ws("|", F.coalesce(F.concat(F.lit("v"), video), F.lit("-")), label)
    label = tx.label_text(F.col("artists_json"), F.col("title"))
    asked = tracks.filter("status = 'failed'").join(imports.select("import_id", F.col("created_at").alias("_since")), "import_id").select(
        "id", "_since", key(F.col("video_id"), label).alias("_match"))
    seen = failures.select(key(F.col("video_id"), F.col("label")).alias("_match"), "created_at")
    return following_event(asked, seen, "_match", "_since", "created_at", even_chunks(failures, "created_at"), "finished_at").select("id", "finished_at")


def backfill_links(imports: DataFrame, tracks: DataFrame, songs: DataFrame) -> DataFrame:
    """``(user_id, playlist_id, song_id, position)`` from each playlist's newest import; a track is the song it last ended in anywhere."""
    newest = latest_per(imports.select("user_id", "playlist_id", "import_id"), ["user_id", "playlist_id"], "import_id")
    linked = tracks.filter(F.col("song_id").isNotNull()).join(songs.select("song_id"), "song_id", "left_semi").groupBy("track_id").agg(F.max_by("song_id", "id").alias("song_id"))
    listed = tracks.select("import_id", "track_id", "position").join(newest, "import_id")
    return listed.join(linked, "track_id").groupBy("user_id", "playlist_id", "song_id").agg(F.min("position").alias("position"))


def playlist_library_songs(entries: DataFrame, songs: DataFrame) -> DataFrame:
    """Distinct found songs of each playlist with their first position."""
    first = entries.filter(F.col("song_id").isNotNull()).groupBy("playlist_id", "song_id").agg(F.min("position").alias("position"))
    return first.join(songs, "song_id")


def import_detail(tracks: DataFrame, imports: DataFrame) -> DataFrame:
    """Tracks with their import's total and the size of their status group."""
    counts = tracks.groupBy("import_id", "status").agg(F.count("*").alias("in_status"))
    totals = counts.groupBy("import_id").agg(F.sum("in_status").alias("total"))
    return tracks.join(imports.select("import_id", "name"), "import_id").join(counts, ["import_id", "status"]).join(totals, "import_id")


def import_counts(tracks: DataFrame, by: str = "import_id", statuses: list[str] = STATUSES) -> DataFrame:
    return tracks.groupBy(by).agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in statuses])


def import_end(imports: DataFrame, tracks: DataFrame, by: str = "import_id") -> DataFrame:
    """End of each import: none while a track is queued, else the last finish or the start; estimated when a finish is unknown."""
    done = F.col("status") != "queued"
    sums = tracks.groupBy(by).agg(
        F.count_if(F.col("status") == "queued").alias("_queued"), F.max(F.when(done, F.col("finished_at"))).alias("_latest"),
        F.count_if(done & F.col("finished_at").isNull()).alias("_untimed"))
    rows = imports.join(sums, by, "left")
    end = F.when(F.coalesce("_queued", F.lit(0)) == 0, F.coalesce("_latest", "created_at"))
    return rows.select(by, end.alias("finished_at"), (end.isNotNull() & (F.coalesce("_untimed", F.lit(0)) > 0)).alias("finished_estimated"))


def last_import(playlists: DataFrame, imports: DataFrame) -> DataFrame:
    latest = imports.groupBy("user_id", "playlist_id").agg(F.max("import_id").alias("last_import_id"))
    return playlists.join(latest, ["user_id", "playlist_id"], "left")


def playlist_songs(playlists: DataFrame, links: DataFrame) -> DataFrame:
    """Song rows of each playlist in order; empty playlists stay with one row without a song.

    Long form: the place of a playlist in its user's list is the sort key (liked first, then caseless name).
    """
    key = playlists.withColumn("liked_first", (F.col("kind") != "liked").cast("int")).withColumn("name_key", F.lower("name"))
    return key.join(links, "playlist_id", "left").select("user_id", "liked_first", "name_key", "playlist_id", "position", "song_id")


def playlist_rollup(entries: DataFrame) -> DataFrame:
    """Distinct tracks of each playlist (each track counted once however often it is listed)."""
    return entries.select("playlist_id", "track_id").distinct().groupBy("playlist_id").agg(F.count("*").alias("track_count"))


def first_positions(entries: DataFrame, resolved: DataFrame) -> DataFrame:
    return entries.join(resolved, "track_id").groupBy("playlist_id", "song_id").agg(F.min("position").alias("position"))


def album_copy(playlists: DataFrame, entries: DataFrame) -> DataFrame:
    """Album artists of playlists that hold one album under its name; null for all others.

    ``playlists``: playlist_id, name. ``entries``: playlist_id, position, album_id, album_name, album_artists, artists.
    Two equal extremes and no null prove a single album id, without a distinct set.
    """
    first = F.min_by(F.struct("album_name", F.when(F.size("album_artists") > 0, F.col("album_artists")).otherwise(F.col("artists")).alias("by")), "position")
    sums = entries.groupBy("playlist_id").agg(
        F.min("album_id").alias("_a"), F.max("album_id").alias("_b"), F.count_if(F.col("album_id").isNull()).alias("_none"), first.alias("_f"))
    same = tx.casefold(tx.strip(F.col("name"))) == tx.casefold(tx.strip(F.coalesce("_f.album_name", F.lit(""))))
    copy = (F.col("_a") == F.col("_b")) & (F.col("_none") == 0) & same
    return playlists.join(sums, "playlist_id", "left").select("playlist_id", F.when(copy, F.array_join("_f.by", ", ")).alias("album_artists"))


def liked_version(liked: DataFrame, user: str = "user_id") -> DataFrame:
    """Change key per user: number of saved tracks and the newest one."""
    return liked.groupBy(user).agg(F.concat_ws(":", F.count("*").cast("string"), F.coalesce(
        F.max_by("track_id", F.struct("added_at", "track_id")), F.lit(""))).alias("version"))


def import_elapsed(imports: DataFrame, now: Column) -> DataFrame:
    """Running or finished time in the largest fitting unit with the rest in the next one (3 hours 5, 1 day 2), and
    each status's share of the import.

    ``imports``: import_id, created_at, finished_at, total and the status counts.
    """
    seconds = F.unix_timestamp(F.coalesce("finished_at", now).cast("timestamp")) - F.unix_timestamp(F.col("created_at").cast("timestamp"))
    minutes = F.greatest(F.floor(seconds / 60), F.lit(0))
    unit = F.when(minutes < 60, "minutes").when(minutes < 1440, "hours").otherwise("days")
    amount = F.when(minutes < 60, minutes).when(minutes < 1440, F.floor(minutes / 60)).otherwise(F.floor(minutes / 1440))
    rest = F.when(minutes < 60, F.lit(0)).when(minutes < 1440, minutes % 60).otherwise(F.floor(minutes % 1440 / 60))
    return imports.select("import_id", amount.alias("amount"), unit.alias("unit"), rest.alias("rest"), *[
        (F.col(s) / F.greatest("total", F.lit(1))).alias(f"{s}_share") for s in STATUSES])


def start_import(tracks: DataFrame, resolved: DataFrame, now: Column) -> DataFrame:
    """Repeated tracks and known songs are duplicates (linked, finished ``now``), the rest is queued.

    ``tracks``: import_id, position, track_id. The first position of a track comes from an aggregate, not a window.
    """
    first = tracks.groupBy("import_id", "track_id").agg(F.min("position").alias("_first"))
    rows = tracks.join(first, ["import_id", "track_id"]).join(resolved, "track_id", "left")
    known = (F.col("position") > F.col("_first")) | F.col("song_id").isNotNull()
    return rows.select("import_id", "position", "track_id", F.when(known, "duplicate").otherwise("queued").alias("status"), "song_id", F.when(known, now).alias("finished_at"))


def record_result(tracks: DataFrame, results: DataFrame, candidates: DataFrame, songs: DataFrame, earlier: DataFrame, now: Column) -> DataFrame:
    """Import tracks with their worker's result: saved, duplicate or failed with a category, finished ``now``.

    Duplicates without a song are looked up, in ``earlier`` imports first, then among the candidates.
    ``tracks``: id, import_id, position, track_id. ``results``: id, status, reason, song_id, video_id. ``candidates``: track_id,
    candidates. ``earlier``: id, track_id, song_id.
    """
    rows = tracks.join(results, "id")
    state = F.when(F.col("status") == "saved", "saved").when(F.col("reason") == "duplicate", "duplicate").otherwise("failed")
    category = F.substring(failure_reason(F.col("reason"), F.lit(None).cast("string"))["reason"], 1, 64)
    marked = rows.withColumn("new_status", state).withColumn("new_reason", F.when(F.col("new_status") == "failed", category))
    unlinked = marked.filter("new_status = 'duplicate' and song_id is null").select("track_id").distinct()
    found = resolve_tracks(unlinked.join(candidates, "track_id"), earlier, songs).withColumnRenamed("song_id", "_found")
    return marked.join(found, "track_id", "left").select(
        "id", "import_id", "position", F.col("new_status").alias("status"), F.col("new_reason").alias("reason"),
        F.coalesce("song_id", F.when(F.col("new_status") == "duplicate", F.col("_found"))).alias("song_id"), "video_id", now.alias("finished_at"))


def result_links(recorded: DataFrame, imports: DataFrame, links: DataFrame, songs: DataFrame) -> DataFrame:
    """Stored links with those of saved and duplicate tracks merged in. ``imports``: import_id, playlist_id."""
    done = recorded.filter(F.col("status").isin("saved", "duplicate") & F.col("song_id").isNotNull())
    return upsert_links(links, done.join(imports.select("import_id", "playlist_id"), "import_id").select("playlist_id", "song_id", "position"), songs)


def requeue(tracks: DataFrame, only_import: int | None = None) -> DataFrame:
    """Failed tracks (of one import) queued again with their result cleared; order with import and position."""
    again = F.col("status") == "failed"
    if only_import is not None:
        again = again & (F.col("import_id") == only_import)
    cleared = {c: F.when(again, F.lit(None)).otherwise(F.col(c)) for c in ("reason", "song_id", "video_id", "finished_at") if c in tracks.columns}
    return tracks.withColumns({**cleared, "status": F.when(again, "queued").otherwise(F.col("status"))})


def queued_tracks(tracks: DataFrame) -> DataFrame:
    return tracks.filter("status = 'queued'").orderBy("import_id", "position")


def upsert_links(links: DataFrame, new: DataFrame, songs: DataFrame) -> DataFrame:
    """Playlist links with the new ones merged in: the smaller position stays, only existing songs come in."""
    known = new.join(songs.select("song_id"), "song_id", "left_semi")
    columns = ["playlist_id", "song_id", "position"]
    return links.select(*columns).unionByName(known.select(*columns)).groupBy("playlist_id", "song_id").agg(F.min("position").alias("position"))


def recent_imports(imports: DataFrame, user: int, n: int) -> DataFrame:
    return imports.filter(F.col("user_id") == user).orderBy(F.desc("import_id")).limit(n)


def recent_imports_per_user(imports: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` imports of every user."""
    return top_n(imports, ["user_id"], [F.desc("import_id")], n, "place")
