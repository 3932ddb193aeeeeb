"""Song identities, albums and metadata from landed catalogue responses (see sources.catalogue for the flat tables)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tunefathom import fixed_values as fv
from tunefathom.functions import text as tx
from tunefathom.functions.numeric import let
from tunefathom.plans.shapes import place_in_group, top_n
from tunefathom.session import settled

#: Performances whose credits one task sorts.
PERFORMANCES = 500_000


def _first(df: DataFrame, by: list[str], keep: list[str], order: list[Column]) -> DataFrame:
    """The row with the smallest order key per group, as one partial aggregate."""
    key = F.struct(*[o.alias(f"k{i}") for i, o in enumerate(order)])
    return df.groupBy(*by).agg(F.min_by(F.struct(*keep), key).alias("_r")).select(*by, "_r.*")


def resolve_identity(fingerprints: DataFrame, hints: DataFrame, tags: DataFrame, song: str = "file_id") -> DataFrame:
    """Title, artist, source of every file: fingerprint, then hint, then file tags; each needs both names.

    ``fingerprints``: file_id, title, artist, recording_id, featured. ``hints``: file_id, title, artist, source. ``tags``: file_id,
    title, artist. Guests come with a fingerprint only, without the main artist; otherwise ``featured`` is empty.
    """
    def side(df: DataFrame, prefix: str) -> DataFrame:
        return df.select(song, *[F.col(c).alias(f"{prefix}_{c}") for c in df.columns if c != song])
    all_files = tags.select(song).unionByName(hints.select(song)).unionByName(fingerprints.select(song)).distinct()
    rows = all_files.join(side(fingerprints, "f"), song, "left").join(side(hints, "h"), song, "left").join(side(tags, "t"), song, "left")

    def both(prefix: str, trimmed: bool) -> Column:
        title, artist = F.col(f"{prefix}_title"), F.col(f"{prefix}_artist")
        if trimmed:
            title, artist = tx.strip(title), tx.strip(artist)
        return F.coalesce((title != "") & (artist != ""), F.lit(False))

    def pick(prefix: str, source: Column) -> Column:
        trim = (lambda c: c) if prefix == "f" else tx.strip
        recording = F.col("f_recording_id") if prefix == "f" else F.lit(None).cast("string")
        nobody = F.array().cast("array<string>")
        guests = nobody
        if prefix == "f" and "featured" in fingerprints.columns:
            others = let(tx.casefold(tx.plain_quotes(F.col("f_artist"))), lambda own: F.filter("f_featured", lambda g: tx.casefold(g) != own))
            guests = F.coalesce(F.transform(others, tx.plain_quotes), nobody)
        return F.struct(
            tx.plain_quotes(tx.strip_version_markers(tx.strip(F.col(f"{prefix}_title")))).alias("title"),
            tx.plain_quotes(trim(F.col(f"{prefix}_artist"))).alias("artist"), source.alias("source"), recording.alias("recording_id"), guests.alias("featured"))
    chosen = F.when(both("f", False), pick("f", F.lit("acoustid"))).when(both("h", True), pick("h", F.col("h_source"))).when(
        both("t", True), pick("t", F.lit("file_tags")))
    return rows.select(song, chosen.alias("_i")).filter(F.col("_i").isNotNull()).select(song, "_i.*")


def pick_recording(recordings: DataFrame, wanted: DataFrame, file: str = "file_id") -> DataFrame:
    """Per file the recording titled as wanted, then without unnamed guests, then most submitted, then without parenthesis.

    ``recordings``: file_id, position, recording_id, title, sources, guests. ``wanted``: file_id, preferred_title, source_text.
    """
    rows = recordings.join(wanted, file, "left")
    liked = tx.plain_lower_words(F.coalesce("preferred_title", F.lit("")))
    title_fits = (liked != "") & (tx.plain_lower_words(F.col("title")) == liked)
    video = tx.plain_lower_words(F.coalesce("source_text", F.lit("")))
    unnamed = F.exists(F.coalesce("guests", F.array().cast("array<string>")), lambda g: ~F.contains(video, tx.plain_lower_words(g)))
    guests_fit = F.when(F.coalesce("source_text", F.lit("")) == "", True).otherwise(~unnamed)
    order = [(~title_fits).cast("int"), (~guests_fit).cast("int"), -F.coalesce("sources", F.lit(0)),
             F.contains(F.coalesce("title", F.lit("")), F.lit("(")).cast("int"), F.col("position")]
    return _first(rows, [file], ["recording_id", "title"], order)


def best_match(results: DataFrame, file: str = "file_id") -> DataFrame:
    """Highest-scored fingerprint result per file from one half up; its score stays apart when it links no recording.

    ``results``: file_id, position, result_id, score, recordings (count).
    """
    best = _first(results, [file], ["result_id", "score", "recordings"], [-F.coalesce("score", F.lit(0.0)), F.col("position")])
    return best.filter(F.col("score") >= fv.RECOGNISED_SCORE).select(
        file, F.when(F.col("recordings") > 0, F.col("result_id")).alias("result_id"),
        F.when(F.col("recordings") == 0, F.col("score")).alias("unlinked_score"))


def composers(performances: DataFrame, credits: DataFrame, recording: str = "recording_id") -> DataFrame:
    """``(recording_id, position, composer)``: distinct composers of the performed works in credit order.

    ``performances``: recording_id, work_pos, work_id. ``credits``: work_id, credit_pos, composer. The credits are sorted
    in as many parts as there are ``PERFORMANCES`` of them, so a task's memory does not grow with the catalogue.
    """
    held = settled(performances.select(recording, "work_pos", "work_id"), "performances")
    parts = max(int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-held.count() // PERFORMANCES))
    credited = held.join(credits, "work_id").repartition(parts, recording, "composer")
    named = credited.groupBy(recording, "composer").agg(F.min(F.struct("work_pos", "credit_pos")).alias("_p"))
    return named.select(recording, F.col("_p.work_pos").alias("work_pos"), F.col("_p.credit_pos").alias("credit_pos"), "composer")


def composer_credit(identities: DataFrame, expected: DataFrame, composer_rows: DataFrame, file: str = "file_id") -> DataFrame:
    """A composer the video named becomes the artist, the performer the first guest.

    ``identities``: file_id, recording_id, title, artist, featured. ``expected``: file_id, name_pos, name.
    """
    named = identities.join(expected, file).join(composer_rows, "recording_id")
    fits = named.filter(tx.same_name(F.col("name"), F.col("composer")) & ~tx.same_name(F.col("name"), F.col("artist"))
                        & ~F.exists("featured", lambda f: tx.same_name(F.col("name"), f)))
    chosen = _first(fits, [file], ["composer"], [F.col("name_pos"), F.col("work_pos"), F.col("credit_pos")])
    rows = identities.join(chosen, file, "left")
    guests = F.concat(F.array("artist"), F.filter("featured", lambda f: ~tx.same_name(f, F.col("composer"))))
    return rows.select(file, "recording_id", "title", F.coalesce("composer", "artist").alias("artist"),
                       F.when(F.col("composer").isNotNull(), guests).otherwise(F.col("featured")).alias("featured"))


def composer_prefix(title: Column, artist: Column, named: Column) -> Column:
    """``struct(title, artist, performer)`` when the title starts with a named artist other than the credited one."""
    result = None
    for separator in fv.COMPOSER_SEPARATORS:
        parts = F.split(title, separator, 2)
        prefix, rest = tx.strip(parts[0]), tx.strip(F.try_element_at(parts, F.lit(2)))
        known = F.coalesce(F.exists(named, lambda n: tx.same_name(prefix, n) | tx.same_name(n, prefix)), F.lit(False))
        hit = F.coalesce(rest != "", F.lit(False)) & known & ~tx.same_name(prefix, artist)
        value = F.struct(rest.alias("title"), prefix.alias("artist"), artist.alias("performer"))
        result = F.when(hit, value) if result is None else result.when(hit, value)
    return result


def artist_fit(wanted: Column, main: Column, sort_name: Column) -> Column:
    """0 same artist, 1 a person of that surname, 2 the first of several, null no fit (all but the sort name comparable)."""
    family = tx.comparable(F.split(sort_name, ",", 2)[0])
    surname = F.contains(sort_name, F.lit(",")) & (wanted != "") & (family == wanted)
    return F.when(main == "", F.lit(None).cast("int")).when(wanted == main, 0).when(F.coalesce(surname, F.lit(False)), 1).when(
        F.startswith(wanted, F.concat(main, F.lit(" "))), 2)


def canonical_name(queries: DataFrame, hits: DataFrame, query: str = "query_id") -> DataFrame:
    """Catalogue spelling of a song: same comparable title, best artist fit, then spelling as asked.

    ``queries``: query_id, title, artist. ``hits``: query_id, position, hit_title, hit_artist, sort_name.
    """
    asked = queries.select(query, tx.comparable(F.col("title")).alias("_t"), tx.comparable(F.col("artist")).alias("_a"),
                           tx.strip_version_markers(F.col("title")).alias("_raw"))
    found = hits.withColumn("title", tx.plain_quotes(tx.strip_version_markers(F.col("hit_title")))).withColumn(
        "artist", tx.plain_quotes(F.col("hit_artist"))).withColumn("_ht", tx.comparable(F.col("title"))).withColumn("_ha", tx.comparable(F.col("artist")))
    rows = found.join(asked, query).filter("_ht = _t").withColumn("_fit", artist_fit(F.col("_a"), F.col("_ha"), F.col("sort_name"))).filter("_fit is not null")
    spelling = F.when(F.col("title") == F.col("_raw"), 0).when(tx.casefold(F.col("title")) == tx.casefold(F.col("_raw")), 1).otherwise(2)
    return _first(rows, [query], ["title", "artist"], [F.col("_fit"), spelling, F.col("position")])


def search_candidates(queries: DataFrame, hits: DataFrame, query: str = "query_id") -> DataFrame:
    """Hits scored at least 70 whose artist fits, best score first (``place``)."""
    asked = queries.select(query, tx.comparable(F.col("artist")).alias("_a"))
    rows = hits.filter(F.col("score") >= fv.MIN_SEARCH_SCORE).withColumn("_ha", tx.comparable(F.col("hit_artist"))).join(asked, query)
    fits = rows.filter(artist_fit(F.col("_a"), F.col("_ha"), F.col("sort_name")).isNotNull())
    return place_in_group(fits, [query], [-F.col("score"), F.col("position")], "place").select(*hits.columns, "place")


# --- albums -----------------------------------------------------------------------

def _rank(value: Column, ranks: dict[str, int]) -> Column:
    """The rank of a named value, null for one without."""
    return F.coalesce(*[F.when(value == name, rank) for name, rank in ranks.items()])


def album_candidates(releases: DataFrame, allow_soundtracks: bool = True) -> DataFrame:
    """Official releases of an album, EP or single group without other secondary types and sampler names.

    ``releases``: song_id, group_id, group_title, release_title, primary_type, secondary_types, status, date,
    release_artist, song_artist, song_title. A release credited to somebody else is dropped, one without credit stays.
    """
    rank = _rank(F.col("primary_type"), fv.ALBUM_TYPE_RANK)
    title = F.coalesce(tx.none_if_empty(F.col("group_title")), tx.none_if_empty(F.col("release_title")), F.lit(""))
    allowed = F.array(F.lit("Soundtrack")) if allow_soundtracks else F.array().cast("array<string>")
    others = F.size(F.array_except(F.coalesce("secondary_types", F.array().cast("array<string>")), allowed))
    own = F.coalesce(tx.casefold(F.col("release_artist")) == tx.casefold(F.col("song_artist")), F.lit(True))
    rows = releases.withColumn("rank", rank).withColumn("title", title).withColumn("date", F.coalesce(tx.none_if_empty(F.col("date")), F.lit(fv.UNDATED)))
    return rows.filter(
        (F.col("status") == "Official") & F.col("rank").isNotNull() & F.col("group_id").isNotNull() & (others == 0)
        & ~F.rlike("title", F.lit(fv.SAMPLER_NAME)) & own).select("song_id", "song_title", "group_id", "title", "rank", "date")


def _year(date: Column) -> Column:
    return F.when((date != fv.UNDATED) & F.rlike(date, F.lit(r"^\d{4}")), F.substring(date, 1, 4).try_cast("int"))


def group_debut(candidates: DataFrame, first_releases: DataFrame | None = None) -> DataFrame:
    """``(song_id, group_id, first_year)``; a known first release date of the group overrides the earliest seen."""
    debuts = candidates.groupBy("song_id", "group_id").agg(F.min(_year(F.col("date"))).alias("first_year")).filter(F.col("first_year").isNotNull())
    if first_releases is None:
        return debuts
    known = first_releases.select("group_id", _year(F.col("first_release_date")).alias("_known"))
    return debuts.join(known, "group_id", "left").select("song_id", "group_id", F.coalesce("_known", "first_year").alias("first_year"))


def near_debut(candidates: DataFrame, first_releases: DataFrame | None = None) -> DataFrame:
    """Candidates whose group came out within a year of the song; undated ones only when nothing is dated."""
    debuts = group_debut(candidates, first_releases)
    song_first = debuts.groupBy("song_id").agg(F.min("first_year").alias("_debut"))
    rows = candidates.join(debuts, ["song_id", "group_id"], "left").join(song_first, "song_id", "left")
    keep = F.col("_debut").isNull() | (F.col("first_year") - F.col("_debut") <= fv.ALBUM_WINDOW_YEARS)
    return rows.filter(F.coalesce(keep, F.lit(False))).select(*candidates.columns)


def pick_album(candidates: DataFrame, min_releases: int = 1, count_releases: bool = False) -> DataFrame:
    """Album of each song: type, own title, (with ``count_releases``) most releases, then the earliest date."""
    def song_key(c: str) -> Column:
        return tx.casefold(tx.strip_version_markers(F.col(c)))
    other_title = F.coalesce((song_key("title") != song_key("song_title")).cast("int"), F.lit(1))
    # one row per group and rank first: the count, the earliest date and its title
    groups = candidates.withColumn("_other", other_title).groupBy("song_id", "group_id").agg(
        F.count("*").alias("_n"), F.min(F.struct("rank", "_other", "date", "title")).alias("_b")).filter(F.col("_n") >= min_releases)
    order = [F.col("_b.rank"), F.col("_b._other"), *([-F.col("_n")] if count_releases else []), F.col("_b.date"), F.col("group_id")]
    best = groups.groupBy("song_id").agg(F.min_by(F.struct("group_id", F.col("_b.title").alias("title")), F.struct(*[o.alias(f"k{i}") for i, o in enumerate(order)])).alias("_r"))
    return best.select("song_id", "_r.group_id", tx.none_if_empty(F.col("_r.title")).alias("album"))


# --- tags, dates, providers -------------------------------------------------------

def tag_genres(tags: DataFrame, n: int = 10, recording: str = "recording_id") -> DataFrame:
    """Ten most counted tag names per recording; of equal names the first counts (recording tags before group tags).

    ``tags``: recording_id, tier (0 recording, 1 group), position, name, count.
    """
    name = tx.strip(F.coalesce("name", F.lit("")))
    order = F.struct("tier", "position")
    once = tags.withColumn("name", name).filter("name <> ''").groupBy(recording, "name").agg(
        F.min_by(F.coalesce("count", F.lit(0)), order).alias("count"), F.min(order).alias("_o"))
    return top_n(once, [recording], [F.desc("count"), "_o"], n, "place").select(recording, "place", "name", "count")


def first_with_genres(lookups: DataFrame, genres: DataFrame, song: str = "song_id") -> DataFrame:
    """Dates merged up to the first lookup with genres; guests only from the first lookup; album from the first having one.

    ``lookups``: song_id, position, recording_id, release_date, featured, album_id, album. ``genres``: recording_id, place, name.
    """
    with_tags = genres.select("recording_id").distinct().withColumn("_has", F.lit(True))
    rows = lookups.join(with_tags, "recording_id", "left")
    stop = rows.groupBy(song).agg(F.min(F.when(F.col("_has"), F.col("position"))).alias("_stop"), F.min("position").alias("_start"))
    used = rows.join(stop, song).filter(F.col("_stop").isNull() | (F.col("position") <= F.col("_stop")))
    date = tx.none_if_empty(F.col("release_date"))
    has_album = tx.none_if_empty(F.col("album_id")).isNotNull()
    return used.groupBy(song).agg(
        F.min_by(F.when(F.col("_has"), F.col("recording_id")), F.when(F.col("_has"), F.col("position"))).alias("genre_recording_id"),
        F.min_by(date, F.when(date.isNotNull(), tx.date_order(date))).alias("release_date"),
        F.min_by("featured", F.when(F.col("position") == F.col("_start"), F.col("position"))).alias("featured"),
        F.min_by(F.struct("album_id", "album"), F.when(has_album, F.col("position"))).alias("_album"),
    ).select(song, "genre_recording_id", "release_date", "featured", "_album.album_id", "_album.album")


def provider_track(queries: DataFrame, hits: DataFrame, query: str = "query_id") -> DataFrame:
    """Similar titles only; album of the best type then date, its track's guests, and the earliest day-precise date of all matches.

    ``queries``: query_id, title. ``hits``: query_id, position, track_id, hit_title, artists, album, album_type, release_date,
    release_precision.
    """
    rows = hits.join(queries.select(query, "title"), query)
    matches = rows.filter(tx.title_similar(F.col("title"), F.coalesce("hit_title", F.lit(""))))
    rank = F.coalesce(_rank(F.col("album_type"), fv.PROVIDER_ALBUM_TYPE_RANK), F.lit(99))
    key = F.struct(rank.alias("a"), F.coalesce(tx.none_if_empty(F.col("release_date")), F.lit(fv.UNDATED)).alias("b"), F.col("position").alias("c"))
    full = F.when((F.col("release_precision") == "day") & (F.length("release_date") == 10), F.col("release_date"))
    guests = F.filter(F.slice("artists", 2, F.greatest(F.size("artists"), F.lit(1))), lambda g: g != "")
    chosen = F.struct("track_id", "album", F.coalesce(guests, F.array().cast("array<string>")).alias("featured"))
    return matches.groupBy(query).agg(F.min_by(chosen, key).alias("_r"), F.min(full).alias("release_date")).select(
        query, "_r.track_id", tx.none_if_empty(F.col("_r.album")).alias("album"), "release_date", "_r.featured")


def merge_metadata(identities: DataFrame, tags: DataFrame, provider: DataFrame, catalogue: DataFrame, song: str = "file_id") -> DataFrame:
    """One row per identified file from all sources, by precedence.

    Guests and album of a provider count only for a confirmed name (fingerprinted or found in the catalogue);
    a fingerprinted song takes no guests from other providers. ``identities``: file_id, title, artist, source,
    recording_id, featured, catalogue_found. ``tags``: file_id, featured, release_date, album. ``provider``: file_id, album,
    release_date, featured. ``catalogue``: file_id, album_id, album, release_date, featured, genres.
    """
    def side(df: DataFrame, p: str) -> DataFrame:
        return df.select(song, *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c != song])
    rows = identities.join(side(tags, "t"), song, "left").join(side(provider, "p"), song, "left").join(side(catalogue, "c"), song, "left")
    fingerprinted = F.col("source") == "acoustid"
    confirmed = fingerprinted | F.coalesce("catalogue_found", F.lit(False))
    empty = F.array().cast("array<string>")
    own_guests = F.when(fingerprinted, F.col("featured")).otherwise(tx.ordered_union(F.col("featured"), F.col("t_featured")))
    guests = tx.ordered_union(
        own_guests, F.when(confirmed & ~fingerprinted, F.col("p_featured")).otherwise(empty), F.when(confirmed, F.col("c_featured")).otherwise(empty))
    album = F.when(confirmed, tx.preferred_album(F.col("c_album"), F.coalesce(F.col("p_album"), F.col("t_album")), fingerprinted)).otherwise(
        tx.plain_quotes(tx.none_if_empty(F.col("c_album"))))
    base_date = F.coalesce(tx.none_if_empty(F.col("p_release_date")), tx.none_if_empty(F.col("t_release_date")))
    return rows.select(
        song, "title", "artist", "source", "recording_id",
        tx.final_featured(F.col("artist"), tx.dedup_featured(guests)).alias("featured"),
        album.alias("album"), F.col("c_album_id").alias("album_id"), tx.better_date(base_date, F.col("c_release_date")).alias("release_date"),
        F.coalesce("c_genres", empty).alias("genres"))


def apply_recording_identity(songs: DataFrame, wanted: DataFrame, song: str = "song_id", recording: str = "recording_id") -> DataFrame:
    """Rename songs to their recording's identity, ids kept; a recording another song owns is a conflict.

    A renamed song's source is the fingerprint service, it counts as reviewed and takes the recording's guests.
    ``songs``: song_id, title, artist, recording_id, metadata_source, reviewed, featured. ``wanted``: song_id, recording_id,
    title, artist, featured.
    """
    owners = songs.filter(F.col(recording).isNotNull()).groupBy(recording).agg(F.min(song).alias("_a"), F.max(song).alias("_b"))
    asked = wanted.select(song, F.col(recording).alias("_rec"), F.col("title").alias("_title"), F.col("artist").alias("_artist"), F.col("featured").alias("_featured"))
    asked = asked.join(owners.withColumnRenamed(recording, "_rec"), "_rec", "left")
    taken = F.coalesce((F.col("_a") != F.col(song)) | (F.col("_b") != F.col(song)), F.lit(False))
    rows = songs.join(asked.withColumn("_conflict", taken).drop("_a", "_b"), song, "left")
    apply = F.col("_rec").isNotNull() & ~F.col("_conflict")
    return rows.select(
        song, F.when(apply, F.col("_title")).otherwise(F.col("title")).alias("title"), F.when(apply, F.col("_artist")).otherwise(F.col("artist")).alias("artist"),
        F.when(apply, F.col("_rec")).otherwise(F.col(recording)).alias(recording),
        F.when(apply, "acoustid").otherwise(F.col("metadata_source")).alias("metadata_source"), (apply | F.coalesce("reviewed", F.lit(False))).alias("reviewed"),
        F.when(apply, F.col("_featured")).otherwise(F.col("featured")).alias("featured"), F.coalesce("_conflict", F.lit(False)).alias("conflict"))
