"""Column expressions for titles, artists, dates and video titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tunefathom import fixed_values as fv
from tunefathom.functions.numeric import let
from tunefathom.functions.ids import song_id  # noqa: F401  (part of this surface)
from tunefathom.functions.udfs import sequence_ratio, without_accents  # noqa: F401  (part of this surface)


def strip(text: Column, characters: str | None = None) -> Column:
    """Trim white space (Unicode) or the given characters at both ends."""
    if characters is None:
        return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return F.btrim(text, F.lit(characters))


def casefold(text: Column) -> Column:
    """Caseless form: lower case, where sharp s and the ligatures are spelt out and a final sigma is an ordinary one."""
    folded = F.translate(F.lower(text), "ς", "σ")
    for letter, spelt in fv.FOLDED_LETTERS.items():
        folded = F.replace(folded, F.lit(letter), F.lit(spelt))
    return folded


def none_if_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def squeeze(text: Column, non_word: str) -> Column:
    """Everything matching ``non_word`` becomes one space; no outer spaces."""
    return F.trim(F.regexp_replace(text, non_word, " "))


def has_phrase(text: Column, phrase: Column) -> Column:
    """True when the words of ``phrase`` stand next to each other in ``text`` (both already normalised)."""
    return (phrase != "") & F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" ")))


def phrase_pattern(words: list[str]) -> str:
    return r"(?:^| )(?:" + "|".join(words) + r")(?= |$)"


# --- titles -----------------------------------------------------------------------

def strip_version_markers(title: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(title, fv.VERSION_BRACKET, ""), fv.VERSION_DASH_TAIL, ""))


def plain_quotes(text: Column) -> Column:
    return F.translate(text, *fv.TYPOGRAPHIC_QUOTES)


def clean_title(text: Column) -> Column:
    for pattern in (fv.NOISE_BRACKET, fv.NOISE_DASH_TAIL, fv.NOISE_PIPE_TAIL):
        text = F.regexp_replace(text, pattern, "")
    return strip(text, " -_.")


def match_words(text: Column) -> Column:
    """Words for matching: no accents, no punctuation, apostrophes dropped, ``$`` read as s."""
    lowered = F.translate(F.lower(plain_quotes(text)), "$'", "s")
    return squeeze(without_accents(lowered), r"(?U)[^\w]+|_+| +")


def rank_words(text: Column) -> Column:
    """Words for ranking: like :func:`match_words`, with punctuation (apostrophes too) as a gap."""
    return squeeze(without_accents(F.lower(text)), r"(?U)[^\w]+")


def comparable(text: Column) -> Column:
    """Form for comparing catalogue names: no version marker, case, accent or punctuation."""
    return squeeze(without_accents(casefold(strip_version_markers(text))), r"(?U)[^\w]+")


def plain_lower_words(text: Column) -> Column:
    return squeeze(F.lower(text), r"(?U)[^\w]+")


def word_key(text: Column) -> Column:
    """Lower-case words padded with spaces for whole-word search; empty without words."""
    words = squeeze(F.lower(text), r"(?U)[\W_]+")
    return F.when(words == "", F.lit("")).otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def plain_title(title: Column) -> Column:
    for pattern in (fv.FEAT_BRACKET, fv.FEAT_TAIL, fv.FROM_TAIL):
        title = F.regexp_replace(plain_quotes(title) if pattern is fv.FEAT_BRACKET else title, pattern, "")
    return strip_version_markers(title)


_RECORDING_PHRASE = "(?U)" + phrase_pattern(fv.VERSION_WORDS + fv.EXTRA_VERSION_WORDS + fv.EXTRA_RECORDING_WORDS)


def core_title_words(title: Column) -> Column:
    """Match words of the title without trailing parts that name no other recording.

    Accents go first, because the fold over the parts has to stay inside Spark; it runs once per
    bracket or dash in the text, so no part is left over.
    """
    folded = without_accents(F.lower(plain_quotes(title)))
    parts = F.regexp_count(folded, F.lit(r"[\(\[]|\s-\s"))

    def drop_last(text: Column, _: Column) -> Column:
        head = F.regexp_replace(text, fv.TRAILING_PART, "")
        part = squeeze(F.substr(text, F.length(head) + 1), r"(?U)[^\w]+|_+| +")
        names_recording = F.rlike(part, F.lit(_RECORDING_PHRASE))
        return F.when((head == "") | (head == text) | names_recording, text).otherwise(head)

    core = F.when(parts > 0, F.aggregate(F.sequence(F.lit(1), parts), folded, drop_last)).otherwise(folded)
    return squeeze(F.translate(core, "$'", "s"), r"(?U)[^\w]+|_+| +")


def phrases_in(words: Column, phrases: list[str]) -> Column:
    """Which of the phrases stand in the normalised text, in one scan of it."""
    return F.regexp_extract_all(words, F.lit(r"(?:^| )(" + "|".join(phrases) + r")(?= |$)"), F.lit(1))


def announces_other(video_words: Column, wanted_words: Column, phrases: list[str]) -> Column:
    """The video announces a version (live, cover, ...) the wanted title does not."""
    return F.size(F.array_except(phrases_in(video_words, phrases), phrases_in(wanted_words, phrases))) > 0


# --- artists ----------------------------------------------------------------------

def parse_featured(title: Column) -> Column:
    """Guests of the first featuring pattern that matches, as an array (empty when there is none)."""
    tried = F.array(*[F.regexp_extract(title, p, 1) for p in fv.FEATURED_PATTERNS])
    found = F.get(F.filter(tried, lambda found: found != ""), F.lit(0))
    names = F.split(F.rtrim(strip(found), F.lit(")]")), fv.FEATURED_SPLIT)
    kept = F.filter(F.transform(names, lambda n: strip(n)), lambda n: n != "")
    return F.coalesce(F.transform(kept, lambda n: F.rtrim(n, F.lit("])"))), F.array().cast("array<string>"))


def main_artist(artist: Column) -> Column:
    """The credit without its featuring part."""
    return F.when(F.size(parse_featured(artist)) > 0, strip(F.regexp_replace(artist, fv.FEAT_IN_ARTIST, ""))).otherwise(artist)


def credited_names(artist: Column) -> Column:
    """Every raw name in a credit: the credit, its main part, the parts of that, its guests."""
    main = main_artist(artist)
    names = F.concat(F.array(artist, main), parse_featured(artist), F.split(main, fv.ARTIST_SPLIT))
    return F.array_distinct(F.filter(names, lambda n: strip(n) != ""))


def ordered_union(*lists: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*[F.coalesce(a, empty) for a in lists]))


def final_featured(artist: Column, names: Column) -> Column:
    """Names that are neither the main artist nor a caseless repeat of an earlier one."""
    def first_of_each(box: Column) -> Column:
        return F.filter(names, lambda n, i: (casefold(n) != box["artist"]) & (F.array_position(box["names"], casefold(n)) == i + 1))
    return let(F.struct(F.transform(names, casefold).alias("names"), casefold(artist).alias("artist")), first_of_each)


def dedup_featured(names: Column) -> Column:
    """Drop names that are part of a longer one in the list."""
    def key(n: Column) -> Column:
        return strip(F.lower(n))

    def kept(box: Column) -> Column:
        keys = box["keys"]
        return F.filter(box["names"], lambda n, i: ~let(F.get(keys, i), lambda own: F.exists(
            keys, lambda other: (F.length(other) > F.length(own)) & F.contains(other, own))))
    return F.array_distinct(let(F.struct(names.alias("names"), F.transform(names, key).alias("keys")), kept))


def latin_name(name: Column, sort_name: Column) -> Column:
    """A person written in another script gets the given and family name of the Latin sort name."""
    # letters outside the Latin script
    foreign = r"[\p{L}&&[^\p{IsLatin}]]"
    family, given = strip(F.split(sort_name, ",", 2)[0]), strip(F.try_element_at(F.split(sort_name, ",", 2), F.lit(2)))
    usable = F.contains(sort_name, F.lit(",")) & ~F.rlike(sort_name, F.lit(foreign))
    return F.when((name != "") & F.rlike(name, F.lit(foreign)) & usable, strip(F.concat(given, F.lit(" "), family))).otherwise(name)


def same_name(named: Column, full: Column) -> Column:
    """Equal, or the surname of the full name."""
    a, b = casefold(strip(named)), casefold(strip(full))
    return (a != "") & ((a == b) | F.endswith(b, F.concat(F.lit(" "), a)))


# --- dates ------------------------------------------------------------------------

def normalize_date(raw: Column) -> Column:
    """Six spellings of a date as YYYY-MM-DD or YYYY; null when there is no year."""
    text = strip(raw)
    named = r"(?U)^(\d{1,2})\s+([A-Za-z]{3})\s+(\d{4})"
    month = F.array_position(F.array(*[F.lit(m) for m in fv.MONTHS]), F.lower(F.regexp_extract(text, named, 2)))
    year = F.regexp_extract(text, named, 3)
    return (
        F.when(F.rlike(text, F.lit(r"^\d{4}-\d{2}-\d{2}$")), text)
        .when(F.rlike(text, F.lit(r"^\d{8}$")), F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"))
        .when(F.rlike(text, F.lit(r"^\d{4}$")), text)
        .when(F.rlike(text, F.lit(named)), F.when(month > 0, F.concat_ws(
            "-", year, F.lpad(month.cast("string"), 2, "0"), F.lpad(F.regexp_extract(text, named, 1), 2, "0"))).otherwise(year))
        .when(F.rlike(text, F.lit(r"^\d{4}[/.]\d{2}[/.]\d{2}$")), F.translate(text, "/.", "--"))
        .otherwise(none_if_empty(F.regexp_extract(text, r"(?U)\b((?:19|20)\d{2})\b", 1)))
    )


def date_precision(date: Column) -> Column:
    """3 for a day, 2 for a month, 1 for a year, 0 for anything else."""
    return (
        F.when(F.rlike(date, F.lit(r"^\d{4}-\d{2}-\d{2}$")), 3).when(F.rlike(date, F.lit(r"^\d{4}-\d{2}$")), 2)
        .when(F.rlike(date, F.lit(r"^\d{4}$")), 1).otherwise(0)
    )


def date_order(date: Column) -> Column:
    """Sort key for ``min_by``: the most precise date first, then the earliest."""
    return F.struct((-date_precision(date)).alias("precision"), date.alias("date"))


def better_date(current: Column, candidate: Column) -> Column:
    a, b = none_if_empty(current), none_if_empty(candidate)
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.when(date_order(b) < date_order(a), b).otherwise(a))


# --- other text -------------------------------------------------------------------

def strip_html(text: Column) -> Column:
    """Links go with their text, other tags alone."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"(?iU)<a[^>]*>.*?</a>", ""), r"<[^>]+>", ""))


def preferred_album(own: Column, provider: Column, allow_soundtracks: Column) -> Column:
    """The catalogue's album; a provider's only when it names no sampler or unwanted soundtrack."""
    unwanted = F.rlike(provider, F.lit(fv.SAMPLER_NAME)) | (~allow_soundtracks & F.rlike(provider, F.lit(fv.SOUNDTRACK_NAME)))
    given = none_if_empty(provider)
    return F.coalesce(plain_quotes(none_if_empty(own)), F.when(given.isNotNull() & ~unwanted, plain_quotes(strip_version_markers(given))))


def title_similar(queried: Column, returned: Column, threshold: float = 0.6) -> Column:
    """One title holds the other, or their sequence ratio reaches the threshold."""
    def key(t: Column) -> Column:
        return strip(F.regexp_replace(F.lower(t), r"(?U)[^\w\s]", ""))
    q, r = key(queried), key(returned)
    usable = (q != "") & (r != "")
    return F.coalesce(usable & (F.contains(r, q) | F.contains(q, r) | (sequence_ratio(q, r) >= threshold)), F.lit(False))


def chord_symbol(key: Column, scale: Column) -> Column:
    return F.when(none_if_empty(key).isNotNull(), F.concat(key, F.when(scale == "minor", "m").otherwise("")))


def key_name(key: Column, scale: Column) -> Column:
    return F.when(none_if_empty(key).isNotNull(), strip(F.concat_ws(" ", key, scale)))


def label_text(artists_json: Column, title: Column) -> Column:
    return F.concat(F.array_join(F.from_json(artists_json, "array<string>"), ", "), F.lit(" – "), title)


# --- video titles -----------------------------------------------------------------

# a bracketed part with a noise word somewhere inside
_NOISY_BRACKET = r"(?iU)\s*(?=[\(\[【])(?=[^\)\]】]*(?:" + fv.VIDEO_NOISE_WORDS + r"))[\(\[【][^\)\]】]*[\)\]】]"
# symbols of category "So": pictographs and emoji
_PICTOGRAPHS = r"\p{So}"


def _without_noise_brackets(text: Column) -> Column:
    return F.regexp_replace(text, _NOISY_BRACKET, "")


def _clean_video_title(text: Column) -> Column:
    text = F.regexp_replace(_without_noise_brackets(text), _PICTOGRAPHS, "")
    for pattern in (fv.HASHTAG, fv.FREQUENCY, fv.QUALITY_TAIL, fv.BARE_NOISE_TAIL, fv.LIVE_TAIL, fv.TITLE_FEAT_TAIL):
        text = F.regexp_replace(text, pattern, "")
    return strip(strip(strip(text), fv.QUOTES))


def _clean_video_artist(text: Column) -> Column:
    named = F.split(text, fv.COLON_SEPARATOR, 2)[0]
    return strip(strip(strip(main_artist(strip(_without_noise_brackets(named)))), fv.QUOTES))


def _is_topic(uploader: Column) -> Column:
    return F.endswith(F.lower(F.coalesce(uploader, F.lit(""))), F.lit(fv.TOPIC_SUFFIX))


def _channel_artist(uploader: Column) -> Column:
    channel = strip(F.coalesce(uploader, F.lit("")))
    topic = F.endswith(F.lower(channel), F.lit(fv.TOPIC_SUFFIX))
    cut = F.substr(channel, F.lit(1), F.length(channel) - len(fv.TOPIC_SUFFIX))
    return F.when(topic, strip(cut)).otherwise(strip(F.regexp_replace(channel, fv.UPLOADER_NOISE, "")))


def _sides(video_title: Column) -> Column:
    """The title split at its first dash or pipe, else at its first colon."""
    text = strip(video_title)
    by_dash = F.split(text, fv.VIDEO_SEPARATOR, 2)
    return F.when(F.size(by_dash) == 2, by_dash).otherwise(F.split(text, fv.COLON_SEPARATOR, 2))


def _naming(title: Column, artist: Column, mentioned: Column) -> Column:
    return F.when((title != "") & (artist != ""), F.struct(title.alias("title"), artist.alias("artist"), mentioned.alias("mentioned_artist")))


def with_parsed_video(videos: DataFrame, video_title: str, uploader: str, name: str = "parsed") -> DataFrame:
    """Adds ``struct(title, artist, mentioned_artist)`` a video most likely holds; null when unreadable.

    The steps are columns of their own, so every text is split and cleaned once.
    """
    by_colon = F.split(strip(F.col(video_title)), fv.COLON_SEPARATOR, 2)
    rows = videos.select(
        "*", _sides(F.col(video_title)).alias("_sides"), F.coalesce(_channel_artist(F.col(uploader)), F.lit("")).alias("_channel"),
        _is_topic(F.col(uploader)).alias("_topic"), by_colon.alias("_colon"))
    second = F.coalesce(F.try_element_at("_sides", F.lit(2)), F.lit(""))
    rows = rows.select(
        "*", (F.size("_sides") == 2).alias("_two"),
        _clean_video_artist(F.col("_sides")[0]).alias("_left_artist"), _clean_video_title(F.col("_sides")[0]).alias("_left_title"),
        _clean_video_artist(second).alias("_right_artist"), _clean_video_title(second).alias("_right_title"),
        _clean_video_title(F.col(video_title)).alias("_whole"), _clean_video_artist(F.col("_colon")[0]).alias("_named"))
    channel, two, topic = F.col("_channel"), F.col("_two"), F.col("_topic")
    left_is_channel = casefold(F.col("_left_artist")) == casefold(channel)
    title_first = (channel != "") & (casefold(F.col("_right_artist")) == casefold(channel)) & ~left_is_channel
    from_title = two & ~topic
    topic_title = F.when(two & (channel != "") & left_is_channel, F.col("_right_title")).otherwise(F.col("_whole"))
    rows = rows.select(
        "*", F.when(from_title, F.when(title_first, F.col("_left_title")).otherwise(F.col("_right_title"))).otherwise(topic_title).alias("_title"),
        F.when(from_title, F.when(title_first, F.col("_right_artist")).otherwise(F.col("_left_artist"))).otherwise(channel).alias("_artist"))
    # "Composer: Piece" under an artist list that names the composer
    halves = F.split("_title", ": ", 2)
    rest = strip(F.coalesce(F.try_element_at(halves, F.lit(2)), F.lit("")))
    names = F.transform(F.array_append(F.split("_artist", fv.VIDEO_ARTIST_SPLIT), F.col("_artist")), casefold)
    repeats = from_title & (rest != "") & F.array_contains(names, casefold(strip(halves[0])))
    title = F.when(repeats, rest).otherwise(F.col("_title"))
    mentioned = F.when(topic & (F.size("_colon") == 2) & (F.col("_named") != "") & (casefold(F.col("_named")) != casefold(F.col("_artist"))), F.col("_named"))
    return rows.select(*[F.col(c) for c in videos.columns], _naming(title, F.col("_artist"), mentioned).alias(name))


def with_parsed_query(queries: DataFrame, query: str, name: str = "parsed") -> DataFrame:
    """Adds the naming of an "Artist - Title" query; null without a dash."""
    rows = queries.withColumn("_sides", F.split(strip(F.col(query)), fv.VIDEO_SEPARATOR, 2))
    second = F.coalesce(F.try_element_at("_sides", F.lit(2)), F.lit(""))
    rows = rows.select("*", _clean_video_artist(F.col("_sides")[0]).alias("_artist"), _clean_video_title(second).alias("_title"))
    naming = F.when(F.size("_sides") == 2, _naming(F.col("_title"), F.col("_artist"), F.lit(None).cast("string")))
    return rows.select(*[F.col(c) for c in queries.columns], naming.alias(name))


def names_its_artist(video_title: Column, uploader: Column) -> Column:
    channel = F.lower(F.coalesce(uploader, F.lit("")))
    return (F.size(_sides(video_title)) == 2) | _is_topic(uploader) | F.contains(channel, F.lit("vevo"))


def with_guessed_track(videos: DataFrame, video_title: str, uploader: str, query: str, name: str = "guess") -> DataFrame:
    """The video's own naming; the query that led to it where the video does not name its artist."""
    rows = with_parsed_query(with_parsed_video(videos, video_title, uploader, "_video"), query, "_query")
    guess = F.coalesce(F.when(~names_its_artist(F.col(video_title), F.col(uploader)), F.col("_query")), F.col("_video"))
    return rows.select(*[F.col(c) for c in videos.columns], guess.alias(name))


def query_artist(query: Column) -> Column:
    sides = F.split(strip(query), fv.QUERY_SEPARATOR, 2)
    return rank_words(sides[0])


def query_song_words(query: Column) -> Column:
    """Words of the song side without filler words."""
    sides = F.split(strip(query), fv.QUERY_SEPARATOR, 2)
    words = F.split(rank_words(F.coalesce(F.try_element_at(sides, F.lit(2)), sides[0])), " ")
    fillers = F.array(*[F.lit(w) for w in fv.QUERY_FILLER_WORDS + [""]])
    return F.filter(words, lambda w: ~F.array_contains(fillers, w))
