"""Reading and writing the song library's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tunefathom import fixed_values as fv, schemas
from tunefathom.functions import text as tx
from tunefathom.functions.ids import song_id
from tunefathom.operators.filters import failure_reason
from tunefathom.session import settled

TABLES = {"songs": schemas.SONGS, **schemas.ONE_TO_ONE, **{t: schemas.LABELS for t in schemas.LABEL_TABLES}, "artists": schemas.ARTISTS}


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A library table straight from a database; give partitionColumn, lowerBound, upperBound and numPartitions for big ones."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def song_wide(songs: DataFrame, *tables: DataFrame, key: str = "song_id") -> DataFrame:
    """Songs left-joined with 1:1 tables on the song id; the tables share one partitioning."""
    for table in tables:
        songs = songs.join(table, key, "left")
    return songs


def nested_labels(labels: DataFrame, name: str, song: str = "song_id", label: str = "label", score: str = "score") -> DataFrame:
    """One array of all labels per song, best first; a song has at most one row per class of its model."""
    order = F.struct(F.col(score).isNull().alias("_n"), (-F.col(score)).alias("_s"), F.col(label).alias("label"), F.col(score).alias("score"))
    return labels.groupBy(song).agg(F.transform(F.array_sort(F.collect_list(order)), lambda e: F.struct(e["label"], e["score"])).alias(name))


def scan_songs(spark: SparkSession, root: str) -> DataFrame:
    """Every song with all nine relations."""
    wide = song_wide(read_table(spark, root, "songs"), *[read_table(spark, root, t) for t in schemas.ONE_TO_ONE])
    return song_wide(wide, *[nested_labels(read_table(spark, root, t), t) for t in schemas.LABEL_TABLES])


def scan_feature(spark: SparkSession, root: str, feature: str) -> DataFrame:
    """One feature's series by name; only that array column is read."""
    if feature not in fv.SERIES_COLUMNS:
        raise ValueError(f"unknown feature {feature!r}, known: {sorted(fv.SERIES_COLUMNS)}")
    table, column = fv.SERIES_COLUMNS[feature]
    return read_table(spark, root, table).select("song_id", F.col(column).alias("values"))


def song_detail(spark: SparkSession, root: str, wanted: str) -> DataFrame:
    """One song with everything; the id filter reaches every scan."""
    def one(t: str) -> DataFrame:
        return read_table(spark, root, t).filter(F.col("song_id") == wanted)
    wide = song_wide(one("songs"), *[one(t) for t in schemas.ONE_TO_ONE])
    return song_wide(wide, *[nested_labels(one(t), t) for t in schemas.LABEL_TABLES])


def read_query_lines(spark: SparkSession, path: str) -> DataFrame:
    return query_lines(spark.read.text(path))


def query_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Trimmed lines that are neither blank nor comments."""
    line = tx.strip(F.col(value))
    return lines.withColumn(value, line).filter((F.col(value) != "") & ~F.startswith(value, F.lit("#")))


def list_audio_files(spark: SparkSession, path: str) -> DataFrame:
    """Audio files below a folder, by path; contents are not read. Files without any are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    return audio_files(files)


def audio_files(files: DataFrame, path: str = "path") -> DataFrame:
    name = F.lower(F.substring_index(path, "/", -1))
    wanted = F.lit(False)
    for suffix in fv.AUDIO_SUFFIXES:
        wanted = wanted | F.endswith(name, F.lit(suffix))
    return files.filter(wanted).withColumn("basename", name).orderBy(path)


def new_songs(results: DataFrame, songs: DataFrame, order: str | None = None) -> DataFrame:
    """Results of songs not stored yet, one per song id: the first by ``order``, ties (or no order) by their values.

    Results without title or artist are left out.
    """
    named = results.filter((F.coalesce("title", F.lit("")) != "") & (F.coalesce("artist", F.lit("")) != ""))
    columns = [order, *[c for c in results.columns if c != order]] if order else results.columns
    keyed = named.select(song_id(F.col("title"), F.col("artist")).alias("song_id"), F.struct(*columns).alias("_row"))
    return keyed.groupBy("song_id").agg(F.min("_row").alias("_row")).join(songs.select("song_id"), "song_id", "left_anti").select("song_id", "_row.*")


def split_results(fresh: DataFrame, artists: DataFrame) -> dict[str, DataFrame]:
    """Nested results of :func:`new_songs` as library tables, songs last; an artist's row appears only when the artist is new."""
    out = {}
    for name in schemas.ONE_TO_ONE:
        out[name] = fresh.filter(F.col(name).isNotNull()).select("song_id", f"{name}.*")
    for name in schemas.LABEL_TABLES:
        out[name] = fresh.select("song_id", F.inline(name)).groupBy("song_id", "label").agg(F.max("score").alias("score"))
    told = fresh.filter(F.col("artist_info").isNotNull()).groupBy("artist").agg(F.min_by("artist_info", "song_id").alias("_info"))
    out["artists"] = told.join(artists.select("artist"), "artist", "left_anti").select("artist", "_info.*")
    out["songs"] = fresh.select("song_id", "title", "artist", "recording_id", "metadata_source", F.lit(False).alias("reviewed"), "original_name", "video_id")
    return out


def write_songs(results: DataFrame, root: str, order: str | None = None) -> None:
    """Append analysis results to the library below ``root``.

    The chosen rows are settled once, so all tables take a song's rows from the same result. ``songs`` is written
    last: after a failure a second run finds the song missing and adds what is not there yet, table by table.
    """
    spark = results.sparkSession
    fresh = settled(new_songs(results, read_table(spark, root, "songs"), order), "new-songs")
    for name, rows in split_results(fresh, settled(read_table(spark, root, "artists").select("artist"), "known-artists")).items():
        there = settled(read_table(spark, root, name).select(F.col(rows.columns[0]).alias("_there")).distinct(), "stored-ids")
        rows.join(there, F.col(rows.columns[0]) == F.col("_there"), "left_anti").write.mode("append").parquet(f"{root}/{name}")


def create_library(spark: SparkSession, root: str) -> None:
    """Empty tables with their declared schemas; also empties an existing library."""
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{root}/{name}")


truncate_library = create_library


def failure_rows(results: DataFrame) -> DataFrame:
    """Log rows of results that were not saved; labels cut to 512 characters, reasons to 64, status to 16.

    ``title``, ``artist``, ``song_id`` and ``note`` may be missing; a note follows the detail in brackets.
    """
    def given(name: str) -> Column:
        return F.col(name).cast("string") if name in results.columns else F.lit(None).cast("string")
    split = failure_reason(F.col("reason"), F.col("message"))
    rows = results.filter(F.coalesce(F.col("status") != "saved", F.lit(True))).withColumns({"_f": split, "_note": tx.none_if_empty(given("note"))})
    detail = tx.none_if_empty(F.col("_f.detail"))
    noted = F.when(F.col("_note").isNull(), F.col("_f.detail")).when(detail.isNull(), F.col("_note")).otherwise(F.concat(detail, F.lit(" ("), "_note", F.lit(")")))
    return rows.select("source", F.substring("label", 1, 512).alias("label"), "video_id",
                       F.substring(F.coalesce(tx.none_if_empty(F.col("status")), F.lit("error")), 1, 16).alias("status"),
                       F.substring("_f.reason", 1, 64).alias("reason"), noted.alias("detail"), tx.none_if_empty(given("title")).alias("title"),
                       tx.none_if_empty(given("artist")).alias("artist"), given("song_id").alias("song_id"))


def write_failures(results: DataFrame, path: str) -> None:
    failure_rows(results).write.mode("append").parquet(path)


def login_rows(attempts: DataFrame) -> DataFrame:
    """Login attempts as logged: user agent cut to 512 characters, empty ones null."""
    return attempts.withColumn("user_agent", F.nullif(F.substring("user_agent", 1, 512), F.lit("")))


def append_logins(attempts: DataFrame, path: str) -> None:
    login_rows(attempts).write.mode("append").parquet(path)


def dump_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def file_tag_rows(tags: DataFrame) -> DataFrame:
    """File tags as stored: main artist, guests of artist and title, genre as a list, rounded duration, bitrate in kbps.

    ``tags``: file_id, filename, title, artist, album, date, genre, length, bitrate, sample_rate, channels.
    """
    guests = tx.dedup_featured(tx.ordered_union(tx.parse_featured(F.coalesce("artist", F.lit(""))), tx.parse_featured(F.coalesce("title", F.lit("")))))
    return tags.select(
        "file_id", "filename", "title", tx.main_artist(F.col("artist")).alias("artist"), guests.alias("featured"), "album",
        tx.normalize_date(F.col("date")).alias("release_date"),
        F.filter(F.array(tx.none_if_empty(F.col("genre"))), lambda g: g.isNotNull()).alias("genres"), F.upper(F.substring_index("filename", ".", -1)).alias("file_format"),
        F.round("length", 2).alias("duration_seconds"), F.round(F.nullif("bitrate", F.lit(0)) / 1000).cast("int").alias("bitrate_kbps"),
        F.col("sample_rate").cast("int").alias("sample_rate_hz"), F.col("channels").cast("int").alias("channels"))


def json_list(text: Column, of: str) -> Column:
    """A JSON value that is either one object or a list of them, as a list."""
    trimmed = F.trim(text)
    return F.from_json(F.when(F.startswith(trimmed, F.lit("[")), trimmed).otherwise(F.concat(F.lit("["), trimmed, F.lit("]"))), of)
