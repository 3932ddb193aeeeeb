"""Text, naming and matching rules on small example pairs."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from tunefathom.functions import text as tx
from tunefathom.operators import matching as ma, ranking as rk
from tunefathom.operators import catalogue as ca, filters as fi, rollups as ro


def apply(spark, function, inputs):
    rows = [(i, *(x if isinstance(x, tuple) else (x,))) for i, x in enumerate(inputs)]
    width = len(rows[0]) - 1
    df = spark.createDataFrame(rows, "i int, " + ", ".join(f"c{n} string" for n in range(width)))
    return [r["o"] for r in df.select("i", function(*[F.col(f"c{n}") for n in range(width)]).alias("o")).orderBy("i").collect()]


def pairs(spark, function, cases):
    assert apply(spark, function, [c[0] for c in cases]) == [c[1] for c in cases]


def song_key(title, artist):
    number = int.from_bytes(hashlib.sha256(f"{title.lower().strip()}|{artist.lower().strip()}".encode()).digest(), "big")
    digits = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    out = ""
    while number:
        out = digits[number % 62] + out
        number //= 62
    return out[:22].ljust(22, "0")


def test_base62_at_the_edges(spark):
    from tunefathom.functions import ids
    numbers = [0, 1, 61, 62, 2**256 - 1, 2**60, 2**60 - 1, 2**240, *[62**k + d for k in range(1, 43) for d in (-1, 0, 1)]]

    def want(number):
        out = ""
        while number:
            number, digit = divmod(number, 62)
            out = ids.DIGITS[digit] + out
        return out[:22].ljust(22, "0")
    assert apply(spark, ids.base62, [f"{n:064x}" for n in numbers]) == [want(n) for n in numbers]
    assert apply(spark, tx.song_id, [(None, "a"), ("a", None)]) == [None, None]


def test_song_id(spark):
    names = [("Hello", "Adele"), (" HELLO ", "adele"), ("Adele", "Hello"), ("", ""), ("Für Elise", "Beethoven"), ("a" * 500, "ß")]
    got = apply(spark, tx.song_id, names)
    assert got == [song_key(*n) for n in names]
    assert got[0] == got[1] != got[2] and all(len(g) == 22 for g in got)


def test_version_markers(spark):
    pairs(spark, tx.strip_version_markers, [
        ("Song (Radio Edit)", "Song"), ("Song [2002 Remaster]", "Song"), ("Song - Remastered 2009", "Song"), ("Song (mono)", "Song"), ("Song (live)", "Song"),
        ("Titanium (David Guetta Remix)", "Titanium (David Guetta Remix)"), ("Song - Live", "Song"), ("Live Forever", "Live Forever"), ("Song (Extended Mix)", "Song"), ("Song (Taylor's Version)", "Song")])


def test_clean_title(spark):
    pairs(spark, tx.clean_title, [
        ("Artist - Song (Official Video)", "Artist - Song"), ("Song [Official Music Video] HD", "Song HD"), ("Song | Official Audio", "Song"), ("Song - Lyrics", "Song"),
        ("Song (2011 Remaster)", "Song"), ("Song (1999)", "Song"), ("Song | Artist - Topic", "Song"), ("Song (feat. X)", "Song (feat. X)")])


def test_dates(spark):
    pairs(spark, tx.normalize_date, [
        ("2020-01-31", "2020-01-31"), ("20200131", "2020-01-31"), ("1999", "1999"), ("3 Feb 2009, 10:00", "2009-02-03"), ("03 Xyz 2009", "2009"), ("2001/05/06", "2001-05-06"),
        ("2001.05.06", "2001-05-06"), ("around 1987!", "1987"), ("soon", None), ("", None), (None, None)])
    pairs(spark, tx.better_date, [(("2001", "2001-05"), "2001-05"), (("2001-05-02", "1999"), "2001-05-02"), (("2001", "1999"), "1999"), (("", "1999"), "1999"), (("1999", ""), "1999")])


def test_featured(spark):
    joined = lambda c: F.array_join(tx.parse_featured(c), "|")
    pairs(spark, joined, [
        ("Song (feat. A & B)", "A|B"), ("Song [ft. A, B]", "A|B"), ("Song featuring A x B and C", "A|B|C"), ("Song", ""), ("Song (FEAT A)", "A"), ("Defeat of Song", "")])
    pairs(spark, lambda c: F.array_join(tx.credited_names(c), "|"), [("A feat. B & C", "A feat. B & C|A|B|C"), ("Simon & Carl", "Simon & Carl|Simon|Carl"), ("Solo", "Solo")])
    lists = F.array(F.lit("Pharrell"), F.lit("Pharrell Williams"), F.lit("Jay"), F.lit("jay"), F.lit("Main"))
    row = spark.range(1).select(tx.dedup_featured(lists).alias("a"), tx.final_featured(F.lit("MAIN"), lists).alias("b")).first()
    assert row.a == ["Pharrell Williams", "Jay", "jay", "Main"] and row.b == ["Pharrell", "Pharrell Williams", "Jay"]


def test_match_words(spark):
    pairs(spark, tx.match_words, [("Don’t Stop", "dont stop"), ("A$AP Rocky", "asap rocky"), ("Gymnopédie_No.1", "gymnopedie no 1"), ("  ", "")])
    pairs(spark, tx.comparable, [("Gymnopédie (Remastered)", "gymnopedie"), ("Straße", "strasse"), ("AC/DC", "ac dc")])
    pairs(spark, lambda c: tx.core_title_words(tx.plain_title(c)), [
        ("Deja Vu (Initial D)", "deja vu"), ("Song (feat. X) - Spotify Singles", "song"), ("Song (Acoustic)", "song acoustic"), ("(Intro)", "intro"), ("Song [A] (B) - c", "song"), ("Song (VIP) [x]", "song vip")])


def test_latin_names(spark):
    pairs(spark, tx.latin_name, [
        (("Пётр Ильич Чайковский", "Tchaikovsky, Pyotr Ilyich"), "Pyotr Ilyich Tchaikovsky"), (("Sigur Rós", "Sigur Rós"), "Sigur Rós"), (("Кино", "Kino"), "Кино"), (("Björk", "Björk, X"), "Björk")])


@pytest.mark.parametrize("title, uploader, want", [
    ("Avicii - Hey Brother (Official Video)", "AviciiOfficialVEVO", ("Hey Brother", "Avicii", None)),
    ("Hey Brother", "Avicii - Topic", ("Hey Brother", "Avicii", None)),
    ("Hey Brother", "AviciiOfficialVEVO", ("Hey Brother", "Avicii", None)),
    ("In The End - Linkin Park", "Linkin Park", ("In The End", "Linkin Park", None)),
    ("Adele - Hello", "Adele - Topic", ("Hello", "Adele", None)),
    ("Tchaikovsky: Swan Lake", "Some Orchestra - Topic", ("Tchaikovsky: Swan Lake", "Some Orchestra", "Tchaikovsky")),
    ("Erik Satie: Gymnopédie No.1", "Piano", ("Gymnopédie No.1", "Erik Satie", None)),
    ("Rammstein: Paris - Du Hast (Official Video)", "Rammstein", ("Du Hast", "Rammstein", None)),
    ("Metallica – Enter Sandman Live Moscow 1991 HD", "Fan", ("Enter Sandman", "Metallica", None)),
    ("David Guetta feat. Kid Cudi - Memories ft. X", "x", ("Memories", "David Guetta", None)),
    ("Oasis - Live Forever", "x", ("Live Forever", "Oasis", None)),
    ("", "", None),
])
def test_video_titles(spark, title, uploader, want):
    df = spark.createDataFrame([(title, uploader)], "t string, u string")
    parsed = tx.with_parsed_video(df, "t", "u").first()["parsed"]
    assert (tuple(parsed) if parsed else None) == want


def test_in_library(spark):
    songs = spark.createDataFrame([("Hey Brother", "Avicii"), ("Burn [Remix]", "Usher feat. Guest"), (None, "X"), ("Wild", "")], "title string, artist string")
    rows = [(1, "Avicii - Hey Brother (Official Video)", "x"), (2, "hey brother", "Avicii - Topic"), (3, "Hey Brothers - Avicii", "x"), (4, "Guest: burn!", "any"), (5, "Burn", "Ellie Goulding"), (6, "Wild", "x"), (7, "", None)]
    videos = spark.createDataFrame(rows, "video_id int, video_title string, uploader string")
    assert {r[0] for r in ma.in_library(videos, songs).collect()} == {1, 2, 4}


def test_candidate_rules(spark):
    tracks = spark.createDataFrame([("t", "Dancin (feat. Luvli) - Krono Remix", ["Aaron Smith", "Krono"], 198000)], "track_id string, title string, artists array<string>, duration_ms bigint")
    cases = [
        ("Aaron Smith - Dancin (KRONO Remix)", "x", 200, True), ("Aaron Smith - Dancin (Krono Remix) ft. Luvli", "x", 200, False), ("Aaron Smith - Dancin (Krono Remix) LIVE", "x", 200, False),
        ("Dancin Krono Remix", "Krono - Topic", 247, True), ("Dancin Krono Remix", "Krono - Topic", 249, False), ("Dancin Krono Remix", "Krono - Topic", 182, False), ("Dancin Krono Remix", "Fan", 198, True),
        ("Dancin Krono Remix", "Krono - Topic", None, False), ("Dancin", "Krono - Topic", 198, False)]
    # "Dancin Krono Remix" names an artist in its title, whoever uploads it
    hits = spark.createDataFrame([("t", str(i), t, u, d) for i, (t, u, d, _) in enumerate(cases)], "track_id string, video_id string, video_title string, uploader string, duration int")
    got = {r["video_id"] for r in ma.candidate_fits(tracks, hits).collect()}
    assert got == {str(i) for i, c in enumerate(cases) if c[3]}


def test_numerals_keep_parts_apart(spark):
    tracks = spark.createDataFrame([("a", "Symphony Part I", ["Wim"], 1), ("b", "Dont Stop Me Now", ["Queen"], 1)], "track_id string, title string, artists array<string>, duration_ms bigint")
    found = spark.createDataFrame([("a", "1", "Symphony Part II", "Wim"), ("a", "2", "Symphony, Part I", "Wim & Yan"), ("b", "3", "Don't Stop Me Nowww", "queen"), ("b", "4", "Dont Stop Me Now", "Other")], "track_id string, found_id string, title string, artist string")
    assert {r["found_id"] for r in ma.identity_matches(tracks, found).collect()} == {"2", "3"}


def test_ranking_ties_keep_input_order(spark):
    queries = spark.createDataFrame([(1, "Adele - Hello")], "query_id int, query string")
    hits = [(1, 0, "a", "Hello (cover)", "Fan", 10**9, False), (1, 1, "b", "Adele - Hello", "Fan", None, None), (1, 2, "c", "Adele - Hello", "Fan", 0, False), (1, 3, "d", "Hello", "Adele - Topic", 5, True), (1, 4, "e", "Something", "Adele", 10**9, True)]
    df = spark.createDataFrame(hits, "query_id int, input_pos int, video_id string, title string, channel string, view_count bigint, verified boolean")
    assert [r["video_id"] for r in ma.rank_hits(queries, df).orderBy("place").collect()] == ["d", "b", "c", "e", "a"]


def test_error_kinds_in_order(spark):
    pairs(spark, fi.error_kind, [
        ("HTTP Error 403: Forbidden", "rate_limited"), ("not available in your country", "geo_blocked"), ("Sign in to confirm you're not a bot", "bot_check"), ("Sign in to confirm your age", "age_restricted"),
        ("Video unavailable: removed", "unavailable"), ("Connection timed out", "network"), ("boom", "unknown")])


@pytest.mark.parametrize("labels, want", [
    (["speech", "noise", "music", "speech"], (10.0, 30.0)), (["noise", "speech", "music"], (20.0, 30.0)), (["music"], (0.0, 10.0)), (["speech", "noise"], None),
    (["music", "noise", "speech", "music", "noise", "noise"], (0.0, 60.0)), (["noise", "noise", "music", "noise"], (0.0, 40.0))])
def test_music_span(spark, labels, want):
    rows = [("s", i, label, i * 10.0, i * 10.0 + 10) for i, label in enumerate(labels)]
    got = ro.music_span(spark.createDataFrame(rows, "song_id string, idx int, label string, start double, end double")).collect()
    assert ([(r["start"], r["end"]) for r in got] or [None]) == [want]


def test_short_edges_are_kept(spark):
    rows = [("s", 0, "speech", 0.0, 2.4), ("s", 1, "music", 2.4, 60.0), ("s", 2, "silence", 60.0, 62.5)]
    got = ro.music_span(spark.createDataFrame(rows, "song_id string, idx int, label string, start double, end double")).first()
    assert (got["start"], got["end"]) == (0.0, 60.0)


def test_queue_wraps_around(spark):
    queue = spark.createDataFrame([("q", i, f"s{i}") for i in range(4)] + [("one", 0, "x")], "q string, p int, s string")
    got = {(r["q"], r["p"]): (r["next_item"], r["previous_item"]) for r in rk.queue_moves(queue, "q", "p", "s").collect()}
    assert got == {("q", 0): ("s1", "s3"), ("q", 1): ("s2", "s0"), ("q", 2): ("s3", "s1"), ("q", 3): ("s0", "s2"), ("one", 0): ("x", "x")}


def test_canonical_name_prefers_the_full_credit(spark):
    queries = spark.createDataFrame([(1, "Gymnopedie No. 1 (Remastered)", "Satie")], "query_id int, title string, artist string")
    hits = spark.createDataFrame([(1, 0, "Gymnopédie No. 1", "Erik Satie", "Satie, Erik"), (1, 1, "Gymnopédie no. 1", "Satie", "Satie"), (1, 2, "Other", "Satie", "Satie"), (1, 3, "Gymnopedie No. 1", "Electric Satie", "Electric Satie")],
                                 "query_id int, position int, hit_title string, hit_artist string, sort_name string")
    row = ca.canonical_name(queries, hits).first()
    assert (row["title"], row["artist"]) == ("Gymnopédie no. 1", "Satie")


def test_similarity_and_candidate_ids(spark):
    import difflib
    names = [("dont stop me now", "don t stop me now"), ("abc", "xyz"), ("", "a"), ("shallow", "shallow")]
    got = apply(spark, tx.sequence_ratio, names)
    assert all(abs(g - difflib.SequenceMatcher(None, a, b).ratio()) < 1e-12 for g, (a, b) in zip(got, names))
    pairs(spark, tx.title_similar, [(("Hello", "Hello (Live)"), True), (("Hello", "Goodbye"), False), (("", "x"), False), (("Colour", "Color"), True)])
    tracks = spark.createDataFrame([("t", "Don’t Stop (feat. Z) - Remastered 2009", ["B", "A"])], "track_id string, title string, artists array<string>")
    assert ma.with_candidates(tracks).first()["candidates"] == [song_key("Don't Stop", "B"), song_key("Don't Stop", "A")]


def test_samples_do_not_depend_on_partitioning(spark):
    rows = spark.range(1000).withColumn("weight", F.when(F.col("id") < 100, 50.0).when(F.col("id") < 200, 0.0).otherwise(0.5))
    for weight in (None, "weight"):
        samples = {tuple(sorted(r["id"] for r in rk.random_sample(rows.repartition(n), 60, 3, "id", weight).collect())) for n in (1, 3, 8)}
        assert len(samples) == 1 and len(set(samples.pop())) == 60
    drawn = [r["id"] for r in rk.random_sample(rows, 60, 3, "id", "weight").collect()]
    assert sum(i < 100 for i in drawn) > 45 and not any(100 <= i < 200 for i in drawn)
    assert rk.random_sample(rows.limit(0), 5, 3, "id").count() == 0


def test_sorting_by_collation_places_missing_last(spark):
    songs = spark.createDataFrame([(1, "Éclair"), (2, "eclair"), (3, "Zebra"), (4, None), (5, "apple"), (6, "Apple"), (7, None)], "song_id int, title string")

    def order(descending):
        return [r["song_id"] for r in rk.sorted_places(songs, "title", descending, collation="UNICODE_CI_AI").orderBy("place").collect()]
    assert order(False) == [5, 6, 1, 2, 3, 4, 7] and order(True) == [3, 1, 2, 5, 6, 4, 7]


def test_shared_folder_follows_the_session(spark):
    from tunefathom.session import shared_folder, work_path
    assert work_path(spark, "x").startswith(shared_folder(spark)) and work_path(spark, "x") != work_path(spark, "x")
