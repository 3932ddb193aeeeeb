"""Row filters and per-row verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tunefathom import fixed_values as fv
from tunefathom.functions import text as tx
from tunefathom.plans.shapes import top_n


def _true(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def search(songs: DataFrame, query: str, title: str = "title", artist: str = "artist") -> DataFrame:
    """Songs whose title or artist contains the query, ignoring case; an empty query keeps all."""
    needle = query.strip().lower()
    if not needle:
        return songs
    return songs.filter(_true(F.contains(F.lower(title), F.lit(needle))) | _true(F.contains(F.lower(artist), F.lit(needle))))


def picker(songs: DataFrame, query: str, chosen: list[str], limit: int = 30, song_id: str = "song_id") -> DataFrame:
    """Search hits not chosen yet, by title; the first ``limit`` of them."""
    return search(songs, query).filter(~F.col(song_id).isin(chosen)).orderBy(F.asc_nulls_last("title"), song_id).limit(limit)


def year_is(year: Column, wanted: int) -> Column:
    return _true(year == wanted)


def in_range(value: Column, low: float, high: float | None) -> Column:
    """``low`` inclusive, ``high`` exclusive, open without ``high``."""
    return _true(value >= low) if high is None else _true((value >= low) & (value < high))


def value_is(value: Column, wanted: str) -> Column:
    return _true(value == wanted)


def chart_filter(songs: DataFrame, conditions: list[Column]) -> DataFrame:
    """Songs meeting every condition."""
    return songs.filter(reduce(lambda a, b: a & b, conditions, F.lit(True)))


def among_top_labels(songs: DataFrame, labels: DataFrame, wanted: str, n: int, song: str = "song_id", label: str = "label", score: str = "score") -> DataFrame:
    """Songs that have a label among their first ``n`` (three genres, five detailed ones, ten instruments in the charts)."""
    return songs.join(dominant_labels(labels, n, song, label, score).filter(F.col(label) == wanted).select(song), song, "left_semi")


def artist_is(artist: Column, wanted: str) -> Column:
    """The artist as the charts show it: one without a name is ``Unknown``."""
    return F.coalesce(F.when(artist != "", artist), F.lit("Unknown")) == wanted


def dominant_mood_is(songs: DataFrame, moods: list[str], wanted: str) -> DataFrame:
    """Songs whose highest mood is the wanted one; the first named of equal ones counts, songs without moods never."""
    best = F.array_max(F.array(*[F.struct(F.col(m).alias("score"), F.lit(-i).alias("order")) for i, m in enumerate(moods)]))
    known = F.coalesce(*[F.col(m) for m in moods]).isNotNull()
    return songs.filter(known & (best["order"] == -moods.index(wanted)))


def threshold_filter(songs: DataFrame, axes: dict[str, Column], thresholds: dict[str, float]) -> DataFrame:
    """Normalised axis values at or above their threshold; zero and below are off, a missing value fails."""
    active = [_true(axes[name] >= t) for name, t in thresholds.items() if t > 0]
    return chart_filter(songs, active)


def label_filter(labels: DataFrame, wanted: dict[str, float], song: str = "song_id", label: str = "label", score: str = "score") -> DataFrame:
    """Ids of songs that have each wanted label with at least its score (one partially aggregated pass)."""
    needed = labels.filter(F.col(label).isin(list(wanted)))
    hits = [F.max(((F.col(label) == name) & (F.col(score) >= low)).cast("int")).alias(f"_h{i}") for i, (name, low) in enumerate(wanted.items())]
    per_song = needed.groupBy(song).agg(*hits)
    return per_song.filter(reduce(lambda a, b: a & b, [F.col(f"_h{i}") == 1 for i in range(len(hits))])).select(song)


def mood_filter(songs: DataFrame, mood: str, threshold: float = 0.7, known: list[str] = fv.MOODS) -> DataFrame:
    if mood not in known:
        raise ValueError(f"unknown mood {mood!r}, expected one of {known}")
    return songs.filter(F.col(mood).isNotNull() & (F.col(mood) >= threshold))


def is_valid_series(values: Column, duration: Column) -> Column:
    return _true((F.size(values) > 0) & (duration > 0))


def valid_series(songs: DataFrame, values: str = "values", duration: str = "duration_seconds") -> DataFrame:
    return songs.filter(is_valid_series(F.col(values), F.col(duration)))


def skipped_series_count(songs: DataFrame, values: str = "values", duration: str = "duration_seconds") -> DataFrame:
    ok = is_valid_series(F.col(values), F.col(duration))
    return songs.agg(F.count_if(ok).alias("used"), F.count_if(~ok).alias("skipped"))


def plausible_track(hits: DataFrame, live_status: str = "live_status", duration: str = "duration") -> DataFrame:
    live = _true(F.col(live_status).isin("is_live", "is_upcoming"))
    return hits.filter(~live & _true(F.col(duration).cast("int").between(fv.MIN_TRACK_SECONDS, fv.MAX_TRACK_SECONDS)))


def keep_music(hits: DataFrame, verdicts: DataFrame, strict: bool, video: str = "video_id") -> DataFrame:
    """Lenient: all but confirmed non-music. Strict: confirmed music only. Topic channels are music."""
    topic = F.endswith(F.lower(F.coalesce("uploader", F.lit(""))), F.lit(fv.TOPIC_SUFFIX))
    judged = hits.join(verdicts.select(video, "verdict"), video, "left").withColumn(
        "verdict", F.when(topic, "music").otherwise(F.coalesce("verdict", F.lit("unknown"))))
    return judged.filter((F.col("verdict") == "music") if strict else (F.col("verdict") != "not_music"))


def missing_identity(songs: DataFrame) -> DataFrame:
    """Songs without a recording id that nobody has reviewed, by artist and title."""
    open_songs = songs.filter(F.col("recording_id").isNull() & ~F.coalesce("reviewed", F.lit(False)))
    return open_songs.orderBy(F.asc_nulls_last("artist"), F.asc_nulls_last("title"), "song_id")


def verification_status(recording_id: Column, reviewed: Column) -> Column:
    return F.when(recording_id.isNotNull(), "acoustid").when(_true(reviewed), "reviewed").otherwise("unverified")


def duration_gate(files: DataFrame, matches: DataFrame, file: str = "file_id") -> DataFrame:
    """Files longer than ten minutes with no match of at least one half are to be skipped."""
    best = matches.groupBy(file).agg(F.max("score").alias("best_score"))
    long_file = _true(F.col("duration_seconds") > fv.UNRECOGNISED_LIMIT_SECONDS)
    known = _true(F.col("best_score") >= fv.RECOGNISED_SCORE)
    return files.join(best, file, "left").withColumn(
        "skip_reason", F.when(long_file & ~known, F.lit("too_long_unrecognized")))


def identity_verdict(
    recognised: Column, matches_expected: Column, trusted: Column, own_channel: Column, unlinked_score: Column,
    has_names: Column, already_saved: Column, expected: Column,
) -> Column:
    """The first verdict that applies: mismatch, unverified, needs_metadata, duplicate, accept."""
    verified = _true(recognised) | _true(trusted) | (_true(own_channel) & (F.coalesce(unlinked_score, F.lit(0.0)) >= fv.KNOWN_AUDIO_SCORE))
    return (
        F.when(_true(expected) & _true(recognised) & ~_true(matches_expected), "mismatch")
        .when(_true(expected) & ~verified, "unverified")
        .when(~_true(has_names), "needs_metadata")
        .when(_true(already_saved), "duplicate")
        .otherwise("accept")
    )


def scatter(songs: DataFrame, x: str, y: str) -> DataFrame:
    """Songs with two finite values."""
    def finite(c: str) -> Column:
        v = F.col(c).cast("double")
        return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    return songs.filter(finite(x) & finite(y))


def scatter_with_neighbours(songs: DataFrame, edges: DataFrame, x: str, y: str, song: str = "song_id") -> DataFrame:
    """The scatter's points with their neighbour edges (points without edges stay, one row per edge)."""
    return scatter(songs, x, y).join(edges, song, "left")


def hide_genres(points: DataFrame, hidden: list[str], genre: str = "top_genre") -> DataFrame:
    """Points whose top genre is not hidden; points without a genre stay."""
    return points.filter(F.col(genre).isNull() | ~F.col(genre).isin(hidden))


def playlist_section(kind: Column, collaborative: Column, artists: Column) -> Column:
    real = _true(kind == "playlist") & artists.isNull()
    shared = _true(collaborative)
    return F.when(_true(kind == "liked") | (real & ~shared), "own").when(real & shared, "shared").otherwise("albums")


def search_playlists(playlists: DataFrame, query: str) -> DataFrame:
    return search(playlists, query, title="name", artist="artists")


def error_kind(message: Column) -> Column:
    """Kind of a download error: the first rule whose words occur in the message."""
    low = F.lower(message)

    def any_of(*words: str) -> Column:
        return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])
    return (
        F.when(any_of("403", "forbidden", "429", "too many requests"), "rate_limited")
        .when(any_of("not available in your country", "geo"), "geo_blocked")
        .when(any_of("not a bot"), "bot_check")
        .when(any_of("age") & any_of("confirm", "restrict", "sign in"), "age_restricted")
        .when(any_of("not available", "private", "removed", "terminated"), "unavailable")
        .when(any_of("resolve", "connection", "timed out", "network"), "network")
        .otherwise("unknown")
    )


def with_error_kind(messages: DataFrame, message: str = "message") -> DataFrame:
    """Kind, retryable flag and scope of each message; the kinds are seven fixed values, so no join is needed."""
    kind = error_kind(F.col(message))
    retryable = [k for k, (retry, _) in fv.ERROR_KINDS.items() if retry]
    global_kinds = [k for k, (_, scope) in fv.ERROR_KINDS.items() if scope == "global"]
    return messages.withColumn("kind", kind).withColumn("retryable", F.col("kind").isin(retryable)).withColumn(
        "scope", F.when(F.col("kind") == "unknown", "unknown").when(F.col("kind").isin(global_kinds), "global").otherwise("video"))


def failure_reason(reason: Column, extra: Column) -> Column:
    """``struct(reason, detail)``: a known reason, a prefixed error with its detail, or ``error`` with the raw text."""
    raw = F.coalesce(tx.none_if_empty(reason), F.lit("unknown"))
    known = raw.isin(fv.KNOWN_FAILURE_REASONS)
    prefixed = F.startswith(raw, F.lit("download_error")) | F.startswith(raw, F.lit("write_error"))
    head = F.substring_index(raw, ":", 1)
    tail = tx.none_if_empty(tx.strip(F.substr(raw, F.length(head) + 2)))
    category = F.when(known, raw).when(prefixed, head).otherwise("error")
    detail = F.when(known, F.lit(None).cast("string")).when(prefixed, tail).otherwise(raw)
    detail = F.nullif(F.concat_ws(" — ", detail, tx.none_if_empty(extra)), F.lit(""))
    return F.struct(category.alias("reason"), detail.alias("detail"))


def recent_failures(failures: DataFrame, reason: str | None = None, limit: int = 200) -> DataFrame:
    """Newest failures first, optionally of one reason; 1 to 2000 of them."""
    if not 1 <= limit <= 2000:
        raise ValueError("limit must lie between 1 and 2000")
    rows = failures if reason is None else failures.filter(F.col("reason") == reason)
    return rows.orderBy(F.desc("id")).limit(limit)


def dominant_labels(labels: DataFrame, n: int, song: str = "song_id", label: str = "label", score: str = "score") -> DataFrame:
    """The first ``n`` labels of every song by score."""
    return top_n(labels, [song], [F.desc(score), F.col(label)], n)
