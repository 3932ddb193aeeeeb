"""Suffix-array dedup: remove every byte covered by a string of ``LENGTH`` bytes that also starts anywhere else.

The order of suffixes is only wanted up to ``LENGTH`` bytes, and only whether a bucket holds more than one suffix. So
buckets of suffixes are refined until they are that deep, by bucket-pointer refinement over sampled offsets:

1. Of the string at every offset, the 8-gram of lowest hash among its first ``WIDTH`` places is its pointer. Equal
   strings point to the same place in themselves, so one sampled offset stands for all neighbouring strings that point
   to it; there is one in about 70 bytes. What those strings share is at least the q-gram of ``LENGTH - WIDTH + 1``
   bytes that starts there.
2. Initial buckets are these q-grams. A bucket of one ends there: no string through it is repeated.
3. A bucket is sorted on the identifier (a hash) of all that its strings cover, their earlier and later offsets. Members
   that share it are repeated as a whole. One of them stays as a witness, for the others of the bucket.
4. Buckets that hold members apart are refined again with the strings of each member cut into blocks of ``LEVELS``
   neighbouring ones, down to single strings. The identifiers that a level has settled are not computed again: only
   open members and one witness per settled class go on.

Rows are (bucket, class, text, place). Bucket counts are windows, one exchange in all; q-grams that hold more than a
``HOT``-th of all rows are found beforehand and counted by aggregates that combine before they meet, so no task gets
them whole. Texts are shuffled once; only those with open members are written and read again. Pairs are never made.

Texts are told apart by a 64-bit hash, classes by two. Defined results: null texts count as empty; texts below
``LENGTH`` bytes lose nothing; exact copies of long enough texts lose everything, also the first one; repeated rows and
rows with equal or null ids are documents of their own; a string that overlaps itself counts as repeated; very long
texts are read in blocks of ``BLOCK`` offsets, whole; bytes are UTF-8, and what is kept may begin inside a character; an
empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from xxhash import xxh3_64_intdigest

from tunefathom.llm.bpe import text_slices
from tunefathom.session import settled

LENGTH, WIDTH = 200, 144
#: Blocks of neighbouring strings by which open members are refined, one level after the other.
LEVELS = (48, 8, 1)
#: A q-gram is hot from a ``HOT``-th of all rows on, and from so many rows.
HOT, HOT_ROWS = 20_000, 1000
BLOCK = 1 << 20
_GRAM = 8
_FIRST, _SECOND, _HIGH, _LOW = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xFFFFFFFF00000000, 0xFFFFFFFF))
REPEATED, OPEN = 1, 2


def _pointers(data: bytes, first: int, count: int) -> np.ndarray:
    """Where the strings at ``count`` offsets from ``first`` on point to: the leftmost lowest hash of ``WIDTH`` grams."""
    size = count + WIDTH - 1
    value = np.ndarray((size,), "<u8", data, first, (1,)) * _FIRST
    value ^= value >> np.uint64(32)
    value *= _SECOND
    value &= _HIGH
    value |= np.arange(size, dtype=np.uint64)
    rows = -(-size // WIDTH)
    tiles = np.full(rows * WIDTH, np.iinfo(np.uint64).max, np.uint64)
    tiles[:size] = value
    tiles = tiles.reshape(rows, WIDTH)
    ahead = np.minimum.accumulate(tiles, axis=1).ravel()
    behind = np.minimum.accumulate(tiles[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:count], ahead[WIDTH - 1:WIDTH - 1 + count]) & _LOW).astype(np.int64) + first


def sampled(data: bytes, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place, low, high): strings that start ``low`` to ``high`` bytes before ``place`` point there. In blocks."""
    strings = len(data) - LENGTH + 1
    open_run = None  # the last run of a block may go on in the next one
    for first in range(0, max(strings, 0), block):
        count = min(block, strings - first)
        to = _pointers(data, first, count)
        cuts = np.flatnonzero(np.diff(to)) + 1
        start, end = np.append(0, cuts) + first, np.append(cuts, count) + first - 1
        place = to[start - first]
        if open_run is not None:
            if open_run[0] == place[0]:
                start[0] = open_run[1]
            else:
                place, start, end = (np.append(v, a) for v, a in zip(open_run, (place, start, end)))
        if first + count < strings:
            open_run = (place[-1], start[-1], end[-1])
            place, start, end = place[:-1], start[:-1], end[:-1]
        if len(place):
            yield place, place - end, place - start


def _signed(numbers: list[int]) -> np.ndarray:
    return np.array(numbers, np.uint64).view(np.int64)


def _members(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bucket, class, packed place) of a text's sampled offsets."""
    core = LENGTH - WIDTH + 1
    for place, low, high in sampled(data):
        buckets = _signed([xxh3_64_intdigest(data[p:p + core]) for p in place.tolist()])
        classes = _signed([xxh3_64_intdigest(data[a:b], 1) for a, b in zip((place - high).tolist(), (place - low + LENGTH).tolist())])
        yield buckets, classes, packed(place, low, high)


def packed(place: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return place << 16 | low << 8 | high


def unpacked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return key >> 16, key >> 8 & 255, key & 255


_MEMBER = "bucket long, class long, text_key long, place long"


def members(texts: DataFrame, chosen=None, only: bool = False) -> DataFrame:
    """(bucket, class, text_key, place) of all texts; without the buckets of ``chosen`` (a broadcast), or ``only`` those."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = chosen.value if chosen is not None else np.empty(0, np.int64)
        for batch in text_slices(batches, "text"):
            parts: list[list[np.ndarray]] = []
            for key, text in zip(batch.column("text_key").to_pylist(), batch.column("text").to_pylist()):
                for bucket, kind, place in _members(text.encode()):
                    if len(hot) or only:
                        keep = np.isin(bucket, hot) == only
                        bucket, kind, place = bucket[keep], kind[keep], place[keep]
                    parts.append([bucket, kind, np.full(len(bucket), key, np.int64), place])
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], names=["bucket", "class", "text_key", "place"])
    return texts.mapInArrow(work, _MEMBER)


def hot_buckets(texts: DataFrame, share: int, least: int) -> np.ndarray:
    """All buckets with at least ``2 / share`` of the rows, and none below ``1 / share`` of them or ``least`` rows.

    Each million rows tell the buckets that hold a ``share``-th of them. A bucket that has twice that overall has it in
    some of them, and what the others keep back is less than one ``share``-th.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def told() -> pa.RecordBatch:
            buckets, n = np.unique(np.concatenate(held), return_counts=True)
            often = n * share >= n.sum()
            return pa.RecordBatch.from_arrays([pa.array(np.append(buckets[often], 0)), pa.array(np.append(n[often], n.sum())), pa.array([False] * int(often.sum()) + [True])], names=["bucket", "n", "total"])

        for batch in text_slices(batches, "text"):
            for text in batch.column("text").to_pylist():
                held += [bucket for bucket, _, _ in _members(text.encode())]
            if sum(map(len, held)) > 1_000_000:
                yield told()
                held = []
        if held:
            yield told()

    counts = settled(texts.mapInArrow(work, "bucket long, n long, total boolean").groupBy("bucket", "total").agg(F.sum("n").alias("n")), "bucket-counts")
    total = counts.filter("total").agg(F.sum("n")).first()[0] or 0
    found = counts.filter(~F.col("total") & (F.col("n") * share >= total) & (F.col("n") >= least)).select("bucket").collect()
    return np.sort(np.array([r["bucket"] for r in found], np.int64))


def _flags(size, alone):
    """Repeated members, and which go on: members alone in their class, and one witness of each other class."""
    return F.when(size > 1, F.lit(REPEATED)).otherwise(F.lit(0)).bitwiseOR(F.when(alone, F.lit(OPEN)).otherwise(F.lit(0)))


def first_buckets(texts: DataFrame, share: int = HOT, least: int = HOT_ROWS) -> DataFrame:
    """(text_key, place, flags) of the sampled offsets whose bucket holds several."""
    context = texts.sparkSession.sparkContext
    hot = hot_buckets(texts, share, least)
    shared = context.broadcast(hot)
    rows = members(texts, shared).repartition("bucket")
    of_class, of_bucket = Window.partitionBy("bucket", "class"), Window.partitionBy("bucket")
    ordered = of_class.orderBy("text_key", "place")
    rows = rows.withColumns({"size": F.count("*").over(of_class), "at": F.row_number().over(ordered), "before": F.lag(F.struct("text_key", "place")).over(ordered)})
    rows = rows.withColumns({"in_bucket": F.count("*").over(of_bucket), "apart": F.max(F.col("size") == 1).over(of_bucket)})
    again = F.col("before").eqNullSafe(F.struct("text_key", "place"))  # the same place of a copied text
    found = rows.filter((F.col("in_bucket") > 1) & ~again).select("text_key", "place", _flags(F.col("size"), F.col("apart") & (F.col("at") == 1)).alias("flags"))
    if len(hot):
        held = settled(members(texts, shared, only=True), "hot-members")
        classes = settled(held.groupBy("bucket", "class").agg(F.count("*").alias("size"), F.min(F.struct("text_key", "place")).alias("witness")), "hot-classes")
        buckets = classes.groupBy("bucket").agg(F.max(F.col("size") == 1).alias("apart"))  # as many rows as are hot
        rows = held.join(classes, ["bucket", "class"]).join(F.broadcast(buckets), "bucket")
        chosen = F.col("apart") & (F.col("witness") == F.struct("text_key", "place"))
        found = found.unionByName(rows.select("text_key", "place", _flags(F.col("size"), chosen).alias("flags")).distinct())
    return found


_SEEN = ("kind int, row_id long, doc_id long, text_key long, text string, spans binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
         "bucket long, class long, place long, needed boolean")
DONE, PENDING, NODE = 0, 1, 2


def _blocks(data: bytes, places: np.ndarray, flags: np.ndarray, width: int) -> Iterator[tuple[int, int, int, bool]]:
    """(bucket, class, packed place, whether it is asked for) of the blocks of a text's open members."""
    for place, low, high, flag in zip(*(v.tolist() for v in unpacked(places)), flags.tolist()):
        for block in range(low // width, high // width + 1):
            first, last = block * width, min((block + 1) * width, WIDTH) - 1
            a, b = max(first, low), min(last, high)
            yield (xxh3_64_intdigest(data[place - first:place - last + LENGTH]), xxh3_64_intdigest(data[place - b:place - a + LENGTH], 1),
                   place << 16 | a << 8 | b, not flag & REPEATED)


def united(spans: np.ndarray) -> np.ndarray:
    """Rows (start, end) of the maximal stretches that the given ones cover."""
    if not len(spans):
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    begins = np.append(True, spans[1:, 0] > reach[:-1])
    return np.stack([spans[begins, 0], reach[np.append(np.flatnonzero(begins)[1:] - 1, len(spans) - 1)]], axis=1)


def _kept(data: bytes, spans: np.ndarray) -> str:
    digest, at = hashlib.sha256(), 0
    for start, end in spans.tolist():
        digest.update(data[at:start])
        at = end
    digest.update(data[at:])
    return digest.hexdigest()


def visit(texts: DataFrame, found: DataFrame, width: int | None) -> DataFrame:
    """What the flags found say of each text: its result, or the text with its spans so far and the blocks of its open members.

    ``texts``: row_id (null for a text that is only a witness), doc_id, text_key, text, spans.
    """
    lists = found.groupBy("text_key").agg(F.collect_list(F.shiftleft("place", 2).bitwiseOR(F.col("flags").cast("long"))).alias("found"))
    both = texts.join(lists, "text_key", "left").select("row_id", "doc_id", "text_key", "text", "spans", "found")
    names = [c.split()[0] for c in _SEEN.split(", ")]
    types = pa.schema(list(zip(names, [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), *[pa.int64()] * 3, pa.string(), *[pa.int64()] * 3, pa.bool_()])))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        witnesses: set[int] = set()
        for batch in text_slices(batches, "text"):
            out: list[dict] = []
            for row in batch.to_pylist():
                data = row["text"].encode()
                spans = np.frombuffer(row["spans"] or b"", np.int64).reshape(-1, 2)
                told = np.array(row["found"] or [], np.int64)
                places, flags = told >> 2, told & 3
                p, low, high = unpacked(places[flags & REPEATED > 0])
                spans = united(np.concatenate([spans, np.stack([p - high, p - low + LENGTH], axis=1)]))
                going = flags & OPEN > 0
                asked = bool((going & (flags & REPEATED == 0)).any())
                kept = {"text_key": row["text_key"], "text": row["text"]}
                if row["row_id"] is not None and not (asked and width):
                    removed = int((spans[:, 1] - spans[:, 0]).sum())
                    out.append({"kind": DONE, "row_id": row["row_id"], "doc_id": row["doc_id"], "n_bytes": len(data), "n_removed": removed, "n_spans": len(spans), "kept_sha256": _kept(data, spans)})
                elif row["row_id"] is not None:
                    out.append({"kind": PENDING, "row_id": row["row_id"], "doc_id": row["doc_id"], "spans": spans.tobytes(), **kept})
                if width and going.any() and (asked or row["text_key"] not in witnesses):
                    if not asked:  # of copies of a text that is only a witness, one is enough
                        witnesses.add(row["text_key"])
                        out.append({"kind": PENDING, **kept})
                    out += [{"kind": NODE, "text_key": row["text_key"], "bucket": b, "class": c, "place": p, "needed": needed}
                            for (b, c, p, needed) in ((b - (b >> 63 << 64), c - (c >> 63 << 64), p, n) for b, c, p, n in _blocks(data, places[going], flags[going], width))]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=types)

    return settled(both.mapInArrow(work, _SEEN), "suffix-level")


def refined(nodes: DataFrame, last: bool) -> DataFrame:
    """(text_key, place, flags) of one level's blocks: repeated ones, and what goes on to the next level."""
    weight = F.when(F.col("needed"), 1).otherwise(2)  # a witness stands for two places at least
    classes = settled(nodes.groupBy("bucket", "class").agg(F.sum(weight).alias("size"), F.min(F.struct("text_key", "place")).alias("witness")), "classes")
    found = nodes.filter("needed").join(classes.filter("size > 1").select("bucket", "class"), ["bucket", "class"]).select("text_key", "place", F.lit(REPEATED).alias("flags"))
    if last:
        return found
    buckets = classes.groupBy("bucket").agg(F.sum("size").alias("in_bucket"), F.max(F.col("size") == 1).alias("apart")).filter("in_bucket > 1 and apart")
    going = classes.join(buckets.select("bucket"), "bucket").select("witness.text_key", "witness.place", _flags(F.col("size"), F.lit(True)).alias("flags"))
    return found.unionByName(going).groupBy("text_key", "place").agg(F.bit_or("flags").alias("flags"))


def remove_repeated(docs: DataFrame, share: int = HOT, least: int = HOT_ROWS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    result = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    size = F.octet_length("text").cast("long")
    short = rows.filter(size < LENGTH).select("doc_id", size.alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))
    long = rows.filter(size >= LENGTH).withColumn("text_key", F.xxhash64("text"))
    found = first_buckets(long.select("text_key", "text"), share, least)
    texts = long.select(F.lit(0).cast("long").alias("row_id"), "doc_id", "text_key", "text", F.lit(None).cast("binary").alias("spans"))
    out = short
    for level, width in enumerate([*LEVELS, None]):
        seen = visit(texts, found, width)
        out = out.unionByName(seen.filter(F.col("kind") == DONE).select(*result))
        if width is None:
            break
        texts = seen.filter(F.col("kind") == PENDING).select("row_id", "doc_id", "text_key", "text", "spans")
        found = refined(seen.filter(F.col("kind") == NODE).select("bucket", "class", "text_key", "place", "needed"), last=level == len(LEVELS) - 1)
    return out


def sql() -> str:
    """The same rows in DuckDB's SQL, from the digest of the string at every offset."""
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS MATERIALIZED (SELECT id, i, md5_number(substr(h, 2 * i + 1, {2 * LENGTH})) AS k
  FROM (SELECT id, h, unnest(range(length(h) // 2 - {LENGTH - 1})) AS i FROM d WHERE length(h) >= {2 * LENGTH})),
r AS (SELECT id, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
g AS (SELECT id, i, sum(CASE WHEN i <= before + {LENGTH} THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY i) AS run
  FROM (SELECT id, i, lag(i) OVER (PARTITION BY id ORDER BY i) AS before FROM r)),
s AS (SELECT id, min(i) AS a, max(i) + {LENGTH} AS b FROM g GROUP BY id, run),
t AS (SELECT id, count(*) AS spans, sum(b - a) AS removed, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends FROM s GROUP BY id),
k AS (SELECT d.*, spans, removed, list_concat([0], coalesce(ends, [])) AS low, list_concat(coalesce(starts, []), [length(h) // 2]) AS high FROM d LEFT JOIN t USING (id))
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(array_to_string(list_transform(range(1, len(low) + 1), lambda j: substr(h, 2 * low[j] + 1, 2 * (high[j] - low[j]))), ''))) AS kept_sha256 FROM k"""
