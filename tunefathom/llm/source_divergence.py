"""Source divergence audit: how far the word use of a language's sources lies apart, and by which words.

1. Arrow's compute functions turn each record batch into counts: ``ascii_lower``, ``split_pattern_regex``,
   ``dictionary_encode`` and a hash ``group_by`` per document, then one per (language, source, term). Counts of several
   batches are merged before they leave a task, up to ``HELD_ROWS`` rows at a time.
2. Spark sums them. A term is kept in a language where at least ``MIN_DOCUMENTS`` of its documents have it.
3. The kept counts are cut into columnar shards: all sources of some terms of one language, about ``SHARD_CELLS``
   cells. A shard is one matrix of smoothed shares; it yields its part of every pair's divergence, and the terms that
   stand out. Parts are summed, ranks are given per source. More than ``BLOCK_SOURCES`` sources are compared in blocks.

A share is ``1 + floor(SCALE * (count + 2) / (total + 2 * terms))``, the divergence of two shares
``floor((p - q)^2 / (p + q))``; all of it is exact in 64-bit integers (totals up to 10^15).

Terms are runs of ASCII letters and non-ASCII characters, with A-Z lower-cased and nothing else. Defined results: null
texts, languages and sources count as empty ones; each row is a document, so repeated rows count as often as they
stand; empty texts and texts without terms still make their group known; very long texts are one document, read whole;
a language with one source has no pairs, one without kept terms has pairs of value 0 and no terms; equal values rank by
the item's UTF-8 bytes; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from tunefathom.llm.bpe import text_slices
from tunefathom.plans.shapes import top_n
from tunefathom.session import settled

MIN_DOCUMENTS, TOP_TERMS, SCALE = 10, 10, 1_000_000_000
#: What is no part of a term, once A-Z are lower-cased.
BETWEEN_TERMS = r"[\x00-\x60\x7B-\x7F]+"
HELD_ROWS, SHARD_CELLS, BLOCK_SOURCES = 400_000, 1 << 18, 1024
_KEYS = ["lang", "source", "term"]
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _batch_counts(batch: pa.RecordBatch) -> pa.Table:
    """(lang, source, term, n, docs) of one batch; a null term counts the documents of a group."""
    lang, source = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
    found = pc.split_pattern_regex(pc.ascii_lower(batch.column("text")), pattern=BETWEEN_TERMS)
    term = pc.list_flatten(found)
    real = pc.not_equal(pc.binary_length(term), 0)
    row, term = pc.list_parent_indices(found).filter(real), term.filter(real).dictionary_encode()
    # terms of each document, then documents of each group
    held = pa.table({"row": row, "term": term.indices}).group_by(["row", "term"], use_threads=False).aggregate([([], "count_all")])
    by_term = pa.table({
        "lang": lang.indices.take(held["row"]), "source": source.indices.take(held["row"]), "term": held["term"], "n": held["count_all"],
    }).group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("n", "count")])
    by_group = pa.table({"lang": lang.indices, "source": source.indices}).group_by(["lang", "source"], use_threads=False).aggregate([([], "count_all")])

    def named(counts: pa.Table, terms, n, docs) -> pa.Table:
        return pa.table([lang.dictionary.take(counts["lang"].combine_chunks()), source.dictionary.take(counts["source"].combine_chunks()), terms, n, docs], schema=_COUNTS)

    return pa.concat_tables([
        named(by_term, term.dictionary.take(by_term["term"].combine_chunks()), by_term["n_sum"], by_term["n_count"]),
        named(by_group, pa.nulls(by_group.num_rows, pa.string()), pa.array(np.zeros(by_group.num_rows, np.int64)), by_group["count_all"])])


def _merged(parts: list[pa.Table]) -> pa.Table:
    summed = pa.concat_tables(parts).group_by(_KEYS, use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return summed.select([*_KEYS, "n_sum", "docs_sum"]).rename_columns(_COUNTS.names)


def partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's batches. What is held stays below ``HELD_ROWS`` rows and one slice of text."""
    held: list[pa.Table] = []
    rows = 0
    for batch in text_slices(batches, "text", 8_000_000):
        held.append(_batch_counts(batch))
        rows += held[-1].num_rows
        if rows > HELD_ROWS:
            held = [_merged(held)]
            rows = held[0].num_rows
            if rows > HELD_ROWS // 2:  # little left to merge
                yield from held[0].to_batches(65_536)
                held, rows = [], 0
    if held:
        yield from _merged(held).to_batches(65_536)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents per group and term; a null term counts the documents."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    parts = rows.mapInArrow(partial_counts, "lang string, source string, term string, n long, docs long")
    return parts.groupBy(*_KEYS).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``1 + floor(SCALE * (count + 2) / total)`` by long division, three decimal places at a time."""
    rest, out = count + 2, np.zeros(np.broadcast(count, total).shape, np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    apart = p - q
    return apart * apart // (p + q)


def _shard(counts: pa.Table, sources: pa.Table) -> pa.Table:
    """The pairs' parts and the outstanding terms of one shard (lang, shard, block)."""
    lang, block = sources["lang"][0].as_py(), sources["block"][0].as_py()
    order = np.argsort(sources["place"].to_numpy())
    names = sources["source"].combine_chunks().take(pa.array(order))
    total = sources["total"].to_numpy()[order][:, None]
    lang_total = sources["lang_total"].to_numpy()[0]
    term = counts["term"].combine_chunks().dictionary_encode()
    column, place = term.indices.to_numpy(), counts["place"].to_numpy()
    cells = np.zeros((len(order), len(term.dictionary)), np.int64)
    cells[place, column] = counts["n"].to_numpy()
    whole = np.zeros(len(term.dictionary), np.int64)
    whole[column] = counts["lang_n"].to_numpy()
    p, q = shares(cells, total), shares(whole, lang_total)
    mine = range(block * BLOCK_SOURCES, min((block + 1) * BLOCK_SOURCES, len(order)))
    first = np.concatenate([np.full(len(order) - a - 1, a) for a in mine]).astype(np.int64)
    second = np.concatenate([np.arange(a + 1, len(order)) for a in mine]).astype(np.int64)
    value = np.concatenate([divergence(p[a + 1:], p[a]).sum(axis=1) for a in mine])
    owner, what, gain = [], [], []
    for a in mine:
        at = np.flatnonzero((cells[a] > 0) & (p[a] > q))
        f = divergence(p[a, at], q[at])
        if len(at) > TOP_TERMS:  # of what is surely not among the first ones, nothing is sent; ties are
            stays = f >= np.partition(f, len(f) - TOP_TERMS)[len(f) - TOP_TERMS]
            at, f = at[stays], f[stays]
        owner.append(np.full(len(at), a)), what.append(at), gain.append(f)
    owner, what, gain = (np.concatenate(x).astype(np.int64) for x in (owner, what, gain))
    size = len(first) + len(owner)
    return pa.table({
        "lang": pa.array([lang] * size, pa.string()), "part": pa.array(["pair"] * len(first) + ["term"] * len(owner), pa.string()),
        "source": names.take(pa.array(np.concatenate([first, owner]))).cast(pa.string()),
        "item": pa.concat_arrays([names.take(pa.array(second)).cast(pa.string()), term.dictionary.take(pa.array(what)).cast(pa.string())]),
        "value": np.concatenate([value, gain]).astype(np.int64)})


def source_divergence(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank).

    Part ``pair``: the divergence to each other source of the language, over all kept terms. Part ``term``: the
    ``TOP_TERMS`` kept terms that a source uses more than its language does, by their divergence.
    """
    counts = settled(term_counts(docs), "term-counts")
    terms = counts.filter(F.col("term").isNotNull())
    kept = terms.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("lang_docs")).filter(F.col("lang_docs") >= MIN_DOCUMENTS)
    held = settled(terms.join(kept.drop("lang_docs"), ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "kept-terms")
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    of_source = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.filter(F.col("term").isNull()).select("lang", "source").join(of_source, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0)
    in_lang = Window.partitionBy("lang")
    placed = groups.withColumn("place", F.row_number().over(in_lang.orderBy("source")) - 1).withColumn("sources", F.count("*").over(in_lang))
    placed = settled(placed.select(
        "lang", "source", "place", (F.col("total") + 2 * F.col("terms")).alias("total"), (F.col("lang_total") + 2 * F.col("terms")).alias("lang_total"),
        # a shard has at least as many terms as sources, so that it yields no more pairs than it reads cells
        F.greatest(F.ceil(F.col("terms") / F.greatest(F.lit(SHARD_CELLS) / F.col("sources"), F.col("sources"))), F.lit(1)).cast("int").alias("shards"),
        F.ceil(F.col("sources") / BLOCK_SOURCES).cast("int").alias("blocks")), "sources")

    def below(count: str) -> Column:
        return F.sequence(F.lit(0), F.col(count) - 1)
    tiles = placed.withColumn("shard", F.explode(below("shards"))).withColumn("block", F.explode(below("blocks"))).select("lang", "shard", "block", "source", "place", "total", "lang_total")
    numbers = placed.select("lang", "source", "place", "shards", "blocks").toDF("lang", "source", "number", "cut", "blocks")
    cells = held.join(numbers, ["lang", "source"]).select(
        F.col("lang").alias("lang"), F.pmod(F.xxhash64("term"), F.col("cut")).cast("int").alias("shard"), F.explode(below("blocks")).alias("block"), F.col("number").alias("place"), "term", "n", "lang_n")
    tile = ["lang", "shard", "block"]
    made = cells.groupBy(*tile).cogroup(tiles.groupBy(*tile)).applyInArrow(_shard, "lang string, part string, source string, item string, value long")
    made = settled(made, "divergences")
    once = made.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = once.unionByName(once.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    best = top_n(made.filter("part = 'term'").drop("part"), ["lang", "source"], [F.desc("value"), F.col("item")], TOP_TERMS)
    return ranked.withColumn("part", F.lit("pair")).unionByName(best.withColumn("part", F.lit("term"))).select("lang", "source", "part", "item", "value", "rank")


def sql() -> str:
    """The same rows in DuckDB's SQL, from every pair of sources at every kept term."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
o AS MATERIALIZED (SELECT id, lang, source, unnest(w) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM o GROUP BY lang, term HAVING count(DISTINCT id) >= {MIN_DOCUMENTS}),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
t AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS MATERIALIZED (SELECT t.lang, t.source, kept.term, coalesce(c.n, 0) AS n,
    1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + 2)) // (t.total + 2 * v.v) AS p, 1 + ({SCALE}::HUGEINT * (kept.n + 2)) // (v.total + 2 * v.v) AS q
  FROM t JOIN v ON v.lang = t.lang JOIN kept ON kept.lang = t.lang LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = kept.term),
pairs AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
  FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY x.lang, x.source, y.source
  UNION ALL SELECT x.lang, x.source, y.source, 0 FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source WHERE x.lang NOT IN (SELECT lang FROM v)),
best AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM best
  QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= {TOP_TERMS})
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked"""
