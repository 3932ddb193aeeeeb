"""Matching videos, files and playlist tracks with the library."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tunefathom import fixed_values as fv
from tunefathom.functions import text as tx
from tunefathom.functions.ids import song_id
from tunefathom.functions.numeric import let
from tunefathom.functions.udfs import sequence_ratio
from tunefathom.plans.shapes import bound, place_in_group, top_n
from tunefathom.session import settled


def with_audio(songs: DataFrame, files: DataFrame, filename: str = "filename", basename: str = "basename") -> DataFrame:
    """Songs with whether their file exists, by caseless base name; no name means no audio."""
    present = files.select(F.lower(basename).alias("_file")).distinct().withColumn("_found", F.lit(True))
    return songs.withColumn("_file", F.lower(filename)).join(present, "_file", "left").withColumn(
        "has_audio", F.coalesce("_found", F.lit(False))).drop("_file", "_found")


def already_saved(new: DataFrame, songs: DataFrame, song: str = "song_id", recording: str = "recording_id") -> DataFrame:
    """New rows the library has under the same id, or under the same recording.

    One equi join per key: the id matches first, then the rest by recording. A row is in one branch only.
    """
    by_id = new.join(songs.select(song), song, "left_semi")
    rest = new.join(songs.select(song), song, "left_anti").filter(F.col(recording).isNotNull())
    return by_id.unionByName(rest.join(songs.filter(F.col(recording).isNotNull()).select(recording), recording, "left_semi").select(by_id.columns))


def resolve_tracks(tracks: DataFrame, imports: DataFrame, songs: DataFrame, track: str = "track_id", song: str = "song_id") -> DataFrame:
    """``(track_id, song_id)``: an earlier import's song wins (its latest row), else the first candidate in artist order.

    ``tracks``: track_id, candidates array<string>. ``imports``: id, track_id, song_id.
    """
    asked = tracks.select(track, "candidates").dropDuplicates([track])
    linked = imports.filter(F.col(song).isNotNull()).join(songs.select(song), song, "left_semi").groupBy(track).agg(
        F.max_by(song, "id").alias("_linked"))
    named = asked.select(track, F.posexplode("candidates").alias("_pos", song)).join(songs.select(song).distinct(), song, "left_semi").groupBy(track).agg(
        F.min_by(song, "_pos").alias("_named"))
    return asked.select(track).join(linked, track, "left").join(named, track, "left").select(
        track, F.coalesce("_linked", "_named").alias(song)).filter(F.col(song).isNotNull())


def candidate_ids(title: Column, artists: Column) -> list[Column]:
    """Title side shared by all candidate ids of a track."""
    return [tx.plain_quotes(tx.strip_version_markers(title)), F.transform(artists, tx.plain_quotes)]


def with_candidates(tracks: DataFrame, track: str = "track_id", title: str = "title", artists: str = "artists") -> DataFrame:
    """``(track_id, candidates)``: the id the track would have under each of its artists."""
    name, credited = candidate_ids(tx.plain_title(F.col(title)), F.col(artists))
    rows = tracks.dropDuplicates([track]).select(track, name.alias("_t"), F.posexplode(credited).alias("_pos", "_a"))
    ids = rows.select(track, "_pos", song_id(F.col("_t"), F.col("_a")).alias("_id"))
    # one row per credited artist: as many as the track's own artist list holds
    return ids.groupBy(track).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_id"))), lambda e: e["_id"]).alias("candidates"))


# --- is a video in the library ----------------------------------------------------

#: Characters of names in one automaton, which takes some fifty times as many bytes in a task.
AUTOMATON_CHARS = 2_000_000
_AUTOMATA: dict[str, tuple] = {}


def _automaton(shared):
    """The automaton of a broadcast block of (name, partners) and the partners by name; built once per worker."""
    name_of_block, names = shared.value
    if name_of_block not in _AUTOMATA:
        import ahocorasick
        machine, partners = ahocorasick.Automaton(), {}
        for name, others in names:
            machine.add_word(name, name)
            if others is not None:
                partners.setdefault(name, set()).update(others)
                for other in others:
                    machine.add_word(other, other)
        machine.make_automaton()
        _AUTOMATA.clear()  # one block at a time
        _AUTOMATA[name_of_block] = (machine, partners)
    return _AUTOMATA[name_of_block]


def texts_naming(texts: DataFrame, names: DataFrame, key: str, text: str) -> DataFrame:
    """Keys of the texts that hold a name and, where the name has partners, one of them. May repeat a key.

    ``names``: name, partners (array<string>; null where the name alone is enough). Names are dealt by hash into blocks
    of about ``AUTOMATON_CHARS`` characters; a block is one automaton, sent to the texts' partitions, which it runs over
    once per text, however long. Every block costs one pass over the texts, which are not shuffled.
    """
    spark = texts.sparkSession
    known = settled(names.select("name", "partners"), "names")
    chars = known.agg(F.sum(F.length("name") + F.coalesce(F.aggregate("partners", F.lit(0), lambda n, p: n + F.length(p)), F.lit(0)))).first()[0] or 0
    blocks = -(-chars // AUTOMATON_CHARS)
    rows = texts.select(key, F.col(text).alias("_text")).filter("_text <> ''")
    if blocks > 1:
        rows = settled(rows, "texts")  # they are read once per block, and normalised once
    kind = rows.schema[key].dataType.simpleString()
    found = spark.createDataFrame([], f"{key} {kind}")
    for block in range(blocks):
        part = [(r["name"], r["partners"]) for r in known.filter(F.pmod(F.xxhash64("name"), F.lit(blocks)) == block).collect()]
        if part:
            found = found.unionByName(rows.mapInPandas(_search(spark.sparkContext.broadcast((uuid.uuid4().hex, part)), key), f"{key} {kind}"))
    return found


def _search(shared, key: str):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine, partners = _automaton(shared)

        def holds(text: str) -> bool:
            if not partners:
                return next(machine.iter(text), None) is not None
            there = {name for _, name in machine.iter(text)}
            return any(not partners[name].isdisjoint(there) for name in there if name in partners)
        for batch in batches:
            yield batch.loc[[holds(text) for text in batch["_text"]], [key]]
    return work


def in_library(videos: DataFrame, songs: DataFrame, video: str = "video_id", title: str = "video_title", uploader: str = "uploader") -> DataFrame:
    """Ids of videos showing a library song.

    Either the parsed title and artist give a stored song id, or a library title and one of its artists
    both stand as whole words in the video's title and channel.
    """
    # a key that cannot be null: else the join would filter on it, below a second copy of all the parsing
    parsed = tx.with_parsed_video(videos.select(video, title, uploader), title, uploader, "_p")
    # bound, so that a title is parsed once for both halves of the id
    parts = let(F.col("_p"), lambda p: song_id(p["title"], p["artist"]))
    ids = parsed.select(video, F.coalesce(parts, F.lit("")).alias("_sid"))
    known_ids = songs.filter((F.col("title") != "") & (F.col("artist") != "")).select(song_id(F.col("title"), F.col("artist")).alias("_sid"))
    by_id = ids.join(known_ids, "_sid", "left_semi").select(video)

    bracketless = F.regexp_replace(F.coalesce("title", F.lit("")), r"[\(\[][^\)\]]*[\)\]]", " ")
    pairs = songs.select(
        tx.word_key(bracketless).alias("name"), F.explode(F.split(F.coalesce("artist", F.lit("")), fv.LIBRARY_ARTIST_SPLIT)).alias("_artist"),
    ).select("name", tx.word_key(F.col("_artist")).alias("_artist")).filter((F.col("name") != "") & (F.col("_artist") != ""))
    # a title may stand in several rows; each holds a bounded list of its artists
    dealt = pairs.distinct().groupBy("name", F.pmod(F.xxhash64("_artist"), F.lit(64)).alias("_deal")).agg(F.collect_list("_artist").alias("partners"))
    haystack = tx.word_key(F.concat_ws(" ", F.col(title), F.coalesce(F.col(uploader), F.lit(""))))
    return by_id.unionByName(texts_naming(videos.select(video, haystack.alias("_h")), dealt, video, "_h")).distinct()


def title_in_library(hits: DataFrame, titles: DataFrame, keep_known: bool, video: str = "video_id", text: str = "video_title", title: str = "title") -> DataFrame:
    """Hits whose text holds (or, without ``keep_known``, does not hold) some library title, at any place."""
    names = titles.select(F.lower(tx.strip(F.coalesce(F.col(title), F.lit("")))).alias("name")).filter("name <> ''").distinct()
    low = hits.select(video, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_x"))
    known = texts_naming(low, names.withColumn("partners", F.lit(None).cast("array<string>")), video, "_x").distinct()
    return hits.join(known, video, "left_semi" if keep_known else "left_anti")


def pending_hits(hits: DataFrame, library: DataFrame, active: DataFrame, video: str = "video_id") -> DataFrame:
    return hits.join(library.select(video), video, "left_anti").join(active.select(video), video, "left_anti")


def pending_counts(hits: DataFrame, library: DataFrame, active: DataFrame, video: str = "video_id") -> DataFrame:
    """How many hits are in the library, being loaded, or still open."""
    lib = library.select(video).distinct().withColumn("_lib", F.lit(True))
    act = active.select(video).distinct().withColumn("_act", F.lit(True))
    marked = hits.join(lib, video, "left").join(act, video, "left")
    in_lib, loading = F.coalesce("_lib", F.lit(False)), F.coalesce("_act", F.lit(False))
    return marked.agg(F.count_if(in_lib).alias("in_library"), F.count_if(loading).alias("loading"), F.count_if(~in_lib & ~loading).alias("pending"))


# --- candidates for a wanted track ------------------------------------------------

def length_fits(track_ms: Column, video_s: Column) -> Column:
    track_s = track_ms / 1000
    close = (F.abs(video_s - track_s) <= fv.LENGTH_TOLERANCE_SECONDS) | video_s.between(track_s, track_s * fv.MAX_LENGTH_FACTOR)
    return F.when(track_ms.isNull(), True).when(video_s.isNull(), False).otherwise(close)


def _any(names: Column, test) -> Column:
    return F.coalesce(F.exists(names, test), F.lit(False))


def candidate_fits(tracks: DataFrame, hits: DataFrame, track: str = "track_id") -> DataFrame:
    """Hits that are plausibly exactly their track, joined on the track they were searched for.

    ``tracks``: track_id, title, artists, duration_ms. ``hits``: track_id, video_id, video_title, uploader, duration.
    Lengths are compared first; only the texts of what is left are normalised, each once, and of a hit first the title.
    """
    named = tracks.select(track, "duration_ms", F.posexplode("artists").alias("_p", "_a")).select(track, tx.match_words(F.col("_a")).alias("_n"))
    artist_names = named.groupBy(track).agg(F.collect_set("_n").alias("_artists"))
    wanted = bound(tracks.select(track, "duration_ms", "title"), _core=tx.core_title_words(tx.plain_title(F.col("title"))), _full=tx.match_words(F.col("title"))).drop("title").join(artist_names, track)
    guests = F.array_join(tx.parse_featured(F.col("video_title")), "\n")
    channel = F.regexp_replace(tx.strip(F.coalesce("uploader", F.lit(""))), fv.MATCH_CHANNEL_NOISE, "")
    pairs = hits.join(wanted, track).filter(length_fits(F.col("duration_ms"), F.col("duration")))
    words_there = (F.col("_core") != "") & (F.size(F.array_except(F.split("_core", " "), F.split("_video", " "))) == 0)
    artist_there = _any(F.col("_artists"), lambda a: tx.has_phrase(F.col("_video"), a) | tx.has_phrase(F.col("_channel"), a))
    foreign = _any(F.col("_guests"), lambda g: (g != "") & ~F.exists(F.col("_artists"), lambda a: tx.has_phrase(g, a) | tx.has_phrase(a, g)))
    unwanted = tx.announces_other(F.col("_versions"), F.col("_full"), fv.VERSION_WORDS + fv.EXTRA_VERSION_WORDS)
    titled = bound(pairs, _video=tx.match_words(F.col("video_title"))).filter(words_there)
    seen = bound(
        titled, _channel=tx.match_words(channel), _versions=tx.match_words(F.regexp_replace("video_title", fv.REMASTER, " ")),
        # guests keep their separation through the normalisation by line
        _guests=F.transform(F.split(without_accents_lines(guests), "\n"), lambda g: tx.squeeze(g, r"(?U)[^\w]+|_+| +")))
    fitting = seen.filter(artist_there & ~unwanted & ~foreign)
    return fitting.select(*hits.columns)


def without_accents_lines(lines: Column) -> Column:
    return tx.without_accents(F.translate(F.lower(tx.plain_quotes(lines)), "$'", "s"))


def _trial_order() -> list[Column]:
    topic = F.endswith(F.lower(F.coalesce("uploader", F.lit(""))), F.lit(fv.TOPIC_SUFFIX))
    off = F.coalesce(F.abs(F.col("duration") - F.nullif(F.col("duration_ms"), F.lit(0)) / 1000), F.lit(0.0))
    return [F.when(topic, 0).otherwise(1), off, F.col("input_pos")]


def order_candidates(tracks: DataFrame, hits: DataFrame, track: str = "track_id") -> DataFrame:
    """Topic uploads first, then the closest length, then input order; adds ``place``."""
    rows = hits.join(tracks.select(track, "duration_ms"), track)
    return place_in_group(rows, [track], _trial_order(), "place").drop("duration_ms")


def first_fitting(fitting: DataFrame, tracks: DataFrame, attempts: int = 3, track: str = "track_id", tier: str = "tier") -> DataFrame:
    """Hits of the first tier that has any, in the order they are tried (topic uploads, closest length, input order).

    ``tracks``: track_id, duration_ms. At most ``attempts`` hits of a track are kept, on the map side already.
    """
    rows = fitting.filter(F.col(tier).isNotNull()).join(tracks.select(track, "duration_ms"), track)
    # tiers come before all else, so the first tier's hits are the first ones: the hits are read once
    first = top_n(rows, [track], [F.col(tier), *_trial_order()], attempts, "attempt")
    return first.withColumn("_best", F.min(tier).over(Window.partitionBy(track))).filter(F.col(tier) == F.col("_best")).drop("_best", "duration_ms")


def _numerals(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: F.rlike(w, F.lit(fv.NUMERAL)))


def _same_title(wanted: Column, found: Column, settled_by: Column) -> Column:
    """Equal or nearly equal titles. Python compares only where neither ``settled_by``, lengths nor numerals have decided."""
    shorter, both = F.least(F.length(wanted), F.length(found)), F.length(wanted) + F.length(found)
    open_yet = ~(settled_by | (wanted == found)) & (shorter >= 6) & (2.0 * shorter / both >= 0.85) & (_numerals(wanted) == _numerals(found))
    return (wanted == found) | (sequence_ratio(F.when(open_yet, wanted), F.when(open_yet, found)) >= 0.85)


def artist_keys(credits: DataFrame, key: str, artist: str) -> DataFrame:
    """``(key, _name)``: every normalised name in a credit."""
    raw = credits.select(key, F.explode(tx.credited_names(F.col(artist))).alias("_raw"))
    return bound(raw, _name=tx.match_words(F.col("_raw"))).filter("_name <> ''").select(key, "_name").distinct()


def identity_matches(tracks: DataFrame, recognised: DataFrame, track: str = "track_id") -> DataFrame:
    """Pairs where the recognised title and artist name the track.

    ``recognised``: track_id, found_id, title, artist (what the audio of a candidate for that track turned out to be).
    The join is on the track; artists are compared as sets, titles by equality or near spelling. Titles are read only
    where an artist is shared, each once.
    """
    wanted_names = artist_keys(tracks.select(track, F.explode("artists").alias("_a")), track, "_a")
    found_names = artist_keys(recognised.select(F.struct(track, "found_id").alias("_k"), "artist"), "_k", "artist").select("_k.*", "_name")
    shared = found_names.join(wanted_names, [track, "_name"], "left_semi").select(track, "found_id").distinct()

    def words(rows: DataFrame, title: str, core: str) -> DataFrame:
        plain = bound(rows, _plain=tx.plain_title(F.col("title")))
        return bound(plain, **{title: tx.match_words(F.col("_plain")), core: tx.core_title_words(F.col("_plain"))}).filter(F.col(title) != "").drop("title", "_plain")
    wanted_titles = words(tracks.select(track, "title"), "_wt", "_wc")
    found = words(recognised.select(track, "found_id", "title").join(shared, [track, "found_id"], "left_semi"), "_ft", "_fc")
    equal = F.col("_wt") == F.col("_ft")
    same = _same_title(F.col("_wt"), F.col("_ft"), F.lit(False)) | ((F.col("_wc") != "") & _same_title(F.col("_wc"), F.col("_fc"), equal | (F.col("_wc") == "")))
    return found.join(wanted_titles, track).filter(same).select(track, "found_id")


def trusted_upload(tracks: DataFrame, videos: DataFrame, track: str = "track_id") -> DataFrame:
    """Videos on one of the track's artists' own channels whose title holds nothing but the track and upload words."""
    names = artist_keys(tracks.select(track, F.explode("artists").alias("_a")), track, "_a").groupBy(track).agg(F.collect_set("_name").alias("_names"))
    wanted = bound(tracks.select(track, "title"), _title=tx.match_words(F.col("title"))).drop("title").join(names, track)
    channel = F.regexp_replace(tx.match_words(F.regexp_replace(tx.strip(F.coalesce("uploader", F.lit(""))), fv.MATCH_CHANNEL_NOISE, "")), fv.CHANNEL_TAIL, "")
    allowed = F.concat(
        F.split("_title", " "), F.flatten(F.transform("_names", lambda n: F.split(n, " "))), F.array(*[F.lit(w) for w in fv.UPLOAD_FILLER_WORDS]))
    leftover = F.filter(F.array_except(F.split("_video", " "), allowed), lambda w: (w != "") & ~F.rlike(w, F.lit(fv.YEAR_WORD)))
    own = (F.col("_channel") != "") & F.array_contains("_names", F.col("_channel"))
    # the titles of other channels are not read
    theirs = bound(videos.join(wanted, track), _channel=channel).filter(own)
    return bound(theirs, _video=tx.match_words(F.col("video_title"))).filter(F.size(leftover) == 0).select(*videos.columns)


def rank_hits(queries: DataFrame, hits: DataFrame, query: str = "query_id") -> DataFrame:
    """Hits of each query, best first: ``score`` and ``place``; equal scores keep input order.

    ``queries``: query_id, query. ``hits``: query_id, input_pos, video_id, title, channel, view_count, verified.
    """
    asked = queries.select(query, tx.query_artist(F.col("query")).alias("_artist"), tx.query_song_words(F.col("query")).alias("_song"))
    channel = F.coalesce("channel", F.lit(""))
    seen = hits.select(
        "*", tx.rank_words(F.coalesce("title", F.lit(""))).alias("_title"),
        tx.rank_words(F.regexp_replace(tx.strip(channel), fv.RANK_CHANNEL_NOISE, "")).alias("_channel"),
        F.endswith(F.lower(channel), F.lit(fv.TOPIC_SUFFIX)).alias("_topic"))
    both = seen.join(asked, query)
    title, song = F.col("_title"), F.col("_song")
    title_words = F.split(title, " ")
    share = F.when(F.size(song) == 0, F.lit(1.0)).otherwise(
        F.size(F.filter(song, lambda w: F.array_contains(title_words, w))) / F.size(song))
    artist_words = F.filter(F.split("_artist", " "), lambda w: (w != "") & ~F.array_contains(song, w))
    channel_is_artist = (F.length("_channel") >= 2) & tx.has_phrase(F.col("_artist"), F.col("_channel"))
    title_names_artist = (F.size(artist_words) > 0) & F.forall(artist_words, lambda w: F.array_contains(title_words, w))
    wanted = F.array_join(song, " ")
    other_version = tx.announces_other(title, wanted, fv.VERSION_WORDS)
    sides = F.split(tx.strip(F.coalesce("title", F.lit(""))), fv.QUERY_SEPARATOR, 2)
    concert = (F.size(sides) == 2) & F.contains(sides[0], F.lit(":"))

    def points(condition: Column, weight: float) -> Column:
        return F.when(F.coalesce(condition, F.lit(False)), F.lit(weight)).otherwise(F.lit(0.0))
    score = (
        fv.TITLE_MATCH_WEIGHT * share + points(F.col("_topic"), fv.TOPIC_BONUS)
        + points(channel_is_artist | title_names_artist, fv.ARTIST_NAMED_BONUS) + points(F.col("verified"), fv.VERIFIED_BONUS)
        - points(concert | other_version, fv.VERSION_PENALTY) + fv.VIEWS_WEIGHT * F.log10(F.coalesce("view_count", F.lit(0)) + 1)
    )
    scored = both.withColumn("score", score).select(*hits.columns, "score")
    return place_in_group(scored, [query], [-F.col("score"), F.col("input_pos")], "place")
