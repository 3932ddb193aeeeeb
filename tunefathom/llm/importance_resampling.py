"""Importance resampling towards a target: draw the documents whose words are likelier under the target texts.

1. Features are runs of one or two words; a feature's bucket is its CRC-32 modulo ``BUCKETS``. Both corpora are counted
   by bucket, one array per task.
2. Each bucket has a gain, the scaled log ratio of its smoothed shares. A document's weight is the floored mean of the
   gains of its features, looked up in one array (``BUCKETS`` numbers, whatever the corpus). Its score adds Gumbel
   noise from a hash of its id, so taking the highest scores is a weighted draw without replacement.
3. The last key to be drawn is found by a weighted median of medians. Every partition tells the median of the keys that
   are still open and how many there are; the weighted median of those medians has at least a quarter of the open keys
   on either side, so each round discards a guaranteed share. When an eighth of a table is left, that is written and the
   rounds go on with it; the last ``FINISH`` keys are sorted. The driver sees one row per partition and side.
4. Keys up to the cutoff are the winners; only they are sorted, in ranges, and ranked.

Words are runs of ASCII letters, digits and non-ASCII characters, with A-Z lower-cased and nothing else. Defined
results: null and empty texts have no features, weight 0, and are never drawn; very long texts are read piece by piece,
whole; ties go to the smaller id (null first), then to fewer features; repeated rows are documents of their own and all
count; an empty target leaves gains that fall with a bucket's share; an empty table gives no rows. Ids must be integers
(null hashes as an empty id). Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tunefathom.llm.bpe import text_slices
from tunefathom.session import settled

BUCKETS, MIN_WORDS, SEED = 10_000, 20, 7
#: Open keys that are sorted instead of being halved again.
FINISH = 4096
_WORD, _OTHER = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
_PIECE = 1 << 20
KEYS = ["k1", "k2", "k3", "k4"]


def bucket_pieces(text: str | None) -> Iterator[tuple[int, np.ndarray]]:
    """(number of words, buckets of all features) of each piece of a text; pieces end between words."""
    data = text.encode().lower() if text else b""
    start, before = 0, None
    while start < len(data):
        cut = _OTHER.search(data, start + _PIECE)
        end = cut.start() if cut else len(data)
        words = _WORD.findall(data, start, end)
        if words:
            single = list(map(crc32, words))
            # the checksum of "a b" goes on from that of "a "
            opened = list(map(crc32, repeat(b" "), single))
            double = list(map(crc32, words[1:], opened))
            if before is not None:
                double.append(crc32(words[0], before))
            before = opened[-1]
            yield len(words), np.array(single + double, np.int64) % BUCKETS
        start = end


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """How many features of all texts fall into each bucket; at most ``BUCKETS`` rows leave a task."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in text_slices(batches, "text"):
            for text in batch.column("text").to_pylist():
                for _, buckets in bucket_pieces(text):
                    total += np.bincount(buckets, minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    counts = np.zeros(BUCKETS, np.int64)
    for row in docs.select(F.col("text").cast("string").alias("text")).mapInArrow(work, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row["bucket"]] = row["n"]
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The floored, scaled log ratio of every bucket's smoothed shares."""
    all_source, all_target = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1) * all_source / ((s + 1) * all_target))) for s, t in zip(source.astype(float), target.astype(float))], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, seed: int) -> DataFrame:
    """(doc_id, n_features, weight, score) and whether the document has words enough to be drawn."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in text_slices(batches, "text"):
            ids, features, weights, enough = batch.column("doc_id").to_pylist(), [], [], []
            for text in batch.column("text").to_pylist():
                words = count = total = 0
                for n, buckets in bucket_pieces(text):
                    words, count, total = words + n, count + len(buckets), total + int(gain[buckets].sum())
                features.append(count), weights.append(total // count if count else 0), enough.append(words >= MIN_WORDS)
            scores = [w + noise(i, seed) for w, i in zip(weights, ids)]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(features, pa.int64()), pa.array(weights, pa.int64()), pa.array(scores, pa.int64()), pa.array(enough, pa.bool_())],
                names=["doc_id", "n_features", "weight", "score", "enough"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, n_features long, weight long, score long, enough boolean")


def _below(keys: np.ndarray, bound: tuple[int, ...]) -> np.ndarray:
    """Which keys (one row per part of a key) come before a bound."""
    out = np.zeros(keys.shape[1], bool)
    for part, value in zip(keys[::-1], bound[::-1]):
        out = (part < value) | ((part == value) & out)
    return out


def _medians(frame: DataFrame, low: tuple | None, high: tuple | None, pivot: tuple | None) -> list[tuple[bool, int, tuple]]:
    """(whether below the pivot, open keys, their lower median) of every partition and side with open keys."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.stack([b.column(k).to_numpy() for k in KEYS]) for b in batches if b.num_rows]
        keys = np.concatenate(parts, axis=1) if parts else np.empty((len(KEYS), 0), np.int64)
        if low is not None:
            keys = keys[:, ~_below(keys, low)]
        if high is not None:
            keys = keys[:, _below(keys, high)]
        side = _below(keys, pivot) if pivot is not None else np.zeros(keys.shape[1], bool)
        rows = []
        for below in (True, False):
            part = keys[:, side == below]
            if part.shape[1]:
                middle = np.lexsort(part[::-1])[(part.shape[1] - 1) // 2]
                rows.append((below, part.shape[1], *part[:, middle].tolist()))
        columns = list(zip(*rows)) if rows else [()] * (2 + len(KEYS))
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.bool_()), *[pa.array(c, pa.int64()) for c in columns[1:]]], names=["below", "n", *KEYS])

    rows = frame.select(*KEYS).mapInArrow(work, "below boolean, n long, " + ", ".join(f"{k} long" for k in KEYS)).collect()
    return [(r["below"], r["n"], tuple(r[k] for k in KEYS)) for r in rows]


def weighted_median(medians: list[tuple[int, tuple]]) -> tuple:
    """The first median, in order, at which half of all weight is reached."""
    total, seen = sum(n for n, _ in medians), 0
    for n, key in sorted(medians, key=lambda m: m[1]):
        seen += n
        if 2 * seen >= total:
            return key
    raise ValueError("no keys are open")


def cutoff(frame: DataFrame, take: int, finish: int = FINISH) -> tuple:
    """The key at place ``take`` (from 1) of a settled table of distinct keys."""
    low = high = pivot = None
    held = None
    while True:
        sides = _medians(frame, low, high, pivot)
        below = sum(n for side, n, _ in sides if side)
        if pivot is not None:
            if take <= below:
                high = pivot
            else:
                take, low = take - below, pivot
        open_side = high is pivot and pivot is not None
        medians = [(n, key) for side, n, key in sides if side == open_side]
        left = sum(n for n, _ in medians)
        if left <= finish:
            rows = frame.filter(_between(low, high)).select(*KEYS).collect()
            return sorted(tuple(r) for r in rows)[take - 1]
        if held is not None and 8 * left <= held:
            frame, held = settled(frame.filter(_between(low, high)).select(*KEYS), "open-keys"), left
        held = held or left
        pivot = weighted_median(medians)


def _key() -> Column:
    return F.struct(*KEYS)


def _bound(key: tuple) -> Column:
    return F.struct(*[F.lit(v).cast("long").alias(k) for k, v in zip(KEYS, key)])


def _between(low: tuple | None, high: tuple | None) -> Column:
    inside = F.lit(True)
    if low is not None:
        inside &= _key() >= _bound(low)
    return inside & (_key() < _bound(high)) if high is not None else inside


def ranked(winners: DataFrame) -> DataFrame:
    """Adds ``rank`` (1, 2, ... over the whole table in the order of the keys).

    Rows are sorted inside key ranges; the id of a sorted row holds its range and its place there, and the ranges
    before it are added up. One row per range is broadcast.
    """
    placed = winners.repartitionByRange(*KEYS).sortWithinPartitions(*KEYS).withColumn("at", F.monotonically_increasing_id())
    placed = settled(placed.withColumns({"slice": F.shiftright("at", 33), "inside": F.col("at").bitwiseAND(F.lit((1 << 33) - 1))}), "winners")
    counts = placed.groupBy("slice").agg(F.count("*").alias("n"))
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return placed.join(F.broadcast(offsets), "slice").withColumn("rank", F.col("before") + F.col("inside") + 1)


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, seed: int = SEED, finish: int = FINISH) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; ``rank`` is null where it is not drawn.

    Of the documents with at least ``MIN_WORDS`` words, ``percent`` in a hundred are drawn.
    """
    gain = gains(bucket_counts(docs), bucket_counts(target))
    keyed = scored(docs, gain, seed).withColumns({
        "k1": -F.col("score"), "k2": F.coalesce("doc_id", F.lit(-(1 << 63))), "k3": F.col("n_features"), "k4": F.monotonically_increasing_id()})
    rows = settled(keyed, "scored")
    drawable = rows.filter("enough")
    take = drawable.count() * percent // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    if not take:
        return rows.select(*columns, F.lit(None).cast("long").alias("rank"))
    last = _bound(cutoff(drawable, take, finish))
    won = F.col("enough") & (_key() <= last)
    return ranked(rows.filter(won)).select(*columns, "rank").unionByName(rows.filter(~won).select(*columns, F.lit(None).cast("long").alias("rank")))


def sql() -> str:
    """The same draw in DuckDB's SQL, with the checksum by its own table of 256 remainders."""
    return f"""
WITH remainders AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END)) AS r),
words AS MATERIALIZED (SELECT 0 AS corpus, row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
  UNION ALL SELECT 1, row_number() OVER (), NULL, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark),
held AS MATERIALIZED (SELECT corpus, id, feature, count(*) AS n FROM (
    SELECT corpus, id, unnest(w) AS feature FROM words
    UNION ALL SELECT corpus, id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words WHERE len(w) > 1) f GROUP BY corpus, id, feature),
buckets AS MATERIALIZED (SELECT feature, xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT],
    list_transform(range(0, octet_length(encode(feature))), lambda i: ('0x' || substr(hex(encode(feature)), 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(r[xor(c & 255, b) + 1], c >> 8))) % {BUCKETS} AS bucket FROM (SELECT DISTINCT feature FROM held), remainders),
counts AS (SELECT bucket, coalesce(sum(n) FILTER (corpus = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (corpus = 1), 0)::DOUBLE AS t FROM held JOIN buckets USING (feature) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + {BUCKETS}) / ((s + 1) * (sum(t) OVER () + {BUCKETS}))))::BIGINT AS g FROM counts),
sums AS (SELECT id, sum(n) AS n, sum(n * g) AS g FROM held JOIN buckets USING (feature) JOIN gain USING (bucket) WHERE corpus = 0 GROUP BY id),
weighed AS (SELECT id, doc_id, len(w) AS words, coalesce(n, 0)::BIGINT AS n_features,
    coalesce((g - ((g % n) + n) % n) // n, 0)::BIGINT AS weight, ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM words LEFT JOIN sums USING (id) WHERE corpus = 0),
drawn AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM weighed)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= {MIN_WORDS} AND place <= (25 * enough) // 100 THEN place END AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY words >= {MIN_WORDS} ORDER BY score DESC, doc_id NULLS FIRST, n_features) AS place,
    count(*) FILTER (words >= {MIN_WORDS}) OVER () AS enough FROM drawn)"""
