"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

1. Every three-word sequence of the benchmark is counted over all documents.
2. Rare sequences are seeds, and in each stretch of ``WINDOW`` neighbouring sequences of an item the rarest one.
   However common an item's words are, and however often it was copied, every part of it keeps a seed.
3. Where a document has a seed, the passage around it that the item would cover is aligned with the item by
   Smith-Waterman over words (match 2, mismatch -1, gap -1), which bridges substituted, lost and added words.
   The score is relative to a perfect copy of the whole item.

The benchmark is read in blocks of ``BLOCK_ITEMS`` items, so what is broadcast is bounded by that; each block makes
two passes over the documents, which are not shuffled. Seeds join passages inside the scan.

Words are runs of letters, digits and non-ASCII characters in lower case. Defined results: null and empty texts have
no passages; items of fewer than ``MIN_WORDS`` words are not searched for; equal documents get equal rows; an item
that occurs several times in a document is reported with its best passage (the first of equal ones); other columns
are not carried by ``find_passages`` and kept by ``drop_contaminated``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tunefathom.llm.bpe import text_slices

GRAM, WINDOW, MIN_WORDS = 3, 4, 5
#: A sequence is rare in up to so many documents, or up to this share of all.
RARE_DOCUMENTS, RARE_SHARE = 100, 1e-4
MATCH, MISMATCH, GAP = 2, 1, 1
#: Share of a perfect copy's score from which a passage counts as taken from the item.
MIN_SCORE = 0.5
BLOCK_ITEMS = 20_000
_SPACED = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return text.lower().encode().translate(_SPACED).split() if text else []


@dataclass
class Block:
    """A block of the benchmark: its words by number and its sequences in order."""
    items: list[tuple[int, np.ndarray]]  # item id, word numbers from 1
    numbers: dict[bytes, int]
    keys: np.ndarray  # distinct sequences, sorted

    @classmethod
    def of(cls, rows: list[tuple[int, str]]) -> "Block":
        numbers: dict[bytes, int] = {}
        items = [(i, np.array([numbers.setdefault(w, len(numbers) + 1) for w in found], dtype=np.int64)) for i, found in ((i, words(t)) for i, t in rows) if len(found) >= MIN_WORDS]
        block = cls(items, numbers, np.empty(0, np.int64))
        if len(numbers) >= 1 << 21:
            raise ValueError("a block's vocabulary must stay below two million words; lower the items per block")
        if items:
            block.keys = np.unique(np.concatenate([grams(w) for _, w in items]))
        return block

    def encode(self, text: str | None) -> np.ndarray:
        """Word numbers of a text; 0 for words the block does not have."""
        found = words(text)
        return np.fromiter(map(self.numbers.get, found, _ZEROS), np.int64, len(found))

    def places(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a document has sequences of the block, and which."""
        if len(w) < GRAM or not len(self.keys):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        known = w > 0
        at = np.flatnonzero(known[:-2] & known[1:-1] & known[2:])
        key = w[at] << 42 | w[at + 1] << 21 | w[at + 2]
        row = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[row] == key
        return at[hit], row[hit]


class _Zeros:
    """Endless zeros, the default of every look-up."""
    def __iter__(self):
        return self

    def __next__(self):
        return 0


_ZEROS = _Zeros()


def grams(w: np.ndarray) -> np.ndarray:
    return w[:-2] << 42 | w[1:-1] << 21 | w[2:]


def gram_counts(docs: DataFrame, block, size: int) -> np.ndarray:
    """In how many documents each sequence of the block occurs, and the number of documents last.

    At most one row per sequence leaves a task.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Block = block.value
        total = np.zeros(size + 1, dtype=np.int64)
        for batch in text_slices(batches, "text"):
            total[size] += batch.num_rows
            for text in batch.column("text").to_pylist():
                total[np.unique(known.places(known.encode(text))[1])] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])

    counts = np.zeros(size + 1, dtype=np.int64)
    for row in docs.select("text").mapInArrow(work, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        counts[row["gram"]] = row["n"]
    return counts


def seeds(block: Block, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By sequence of the block: where its entries begin, how many they are; by entry: the item and the place in it.

    Sequences that are no seeds have no entries.
    """
    rows, owners, places = [], [], []
    rare = np.flatnonzero(counts[:-1] <= max(RARE_DOCUMENTS, RARE_SHARE * counts[-1]))
    for i, (_, w) in enumerate(block.items):
        row = np.searchsorted(block.keys, grams(w))
        n = counts[row]
        width = min(WINDOW, len(row))
        low = np.lib.stride_tricks.sliding_window_view(n, width).argmin(axis=1) + np.arange(len(row) - width + 1)
        # a sequence that stands several times in an item is a seed at all its places
        at = np.flatnonzero(np.isin(row, np.append(rare, row[low])))
        rows.append(row[at]), owners.append(np.full(len(at), i)), places.append(at)
    row, owner, place = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (rows, owners, places))
    order = np.lexsort((place, owner, row))
    row, owner, place = row[order], owner[order], place[order]
    first = np.searchsorted(row, np.arange(len(block.keys) + 1))
    return first[:-1], np.diff(first), owner, place


def align(items: np.ndarray, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each row's item and passage, and where in the passage it ends.

    Both are padded (items with -1, passages with -2). Row by row of the item; gaps inside a row are a running
    maximum, so all pairs are done in step.
    """
    count, length = passages.shape
    before = np.zeros((count, length), np.int32)
    best, end = np.zeros(count, np.int32), np.zeros(count, np.int64)
    ramp = (GAP * np.arange(length)).astype(np.int32)
    for i in range(items.shape[1]):
        word = items[:, i:i + 1]
        step = np.where(passages == word, MATCH, -MISMATCH).astype(np.int32)
        diagonal = np.zeros_like(before)
        diagonal[:, 1:] = before[:, :-1]
        now = np.maximum(np.maximum(diagonal + step, before - GAP), 0)
        now = np.maximum.accumulate(now + ramp, axis=1) - ramp
        now[(word < 0)[:, 0]] = 0
        top = now.argmax(axis=1)
        value = now[np.arange(count), top]
        better = value > best
        best[better], end[better] = value[better], top[better]
        before = now
    return best, end


def _aligned(block: Block, held: list[tuple[int, int, np.ndarray]]) -> np.ndarray:
    """Relative score and end of (item, start, passage) rows, in groups of similar size."""
    out = np.zeros((len(held), 2))
    order = sorted(range(len(held)), key=lambda k: len(held[k][2]))
    for i in range(0, len(order), 256):
        part = order[i:i + 256]
        chosen = [block.items[held[k][0]][1] for k in part]
        items = np.full((len(part), max(map(len, chosen))), -1, np.int64)
        passages = np.full((len(part), max(len(held[k][2]) for k in part)), -2, np.int64)
        for r, (k, w) in enumerate(zip(part, chosen)):
            items[r, :len(w)] = w
            passages[r, :len(held[k][2])] = held[k][2]
        best, end = align(items, passages)
        out[part, 0] = best / (MATCH * np.array([len(w) for w in chosen]))
        out[part, 1] = [held[k][1] + e + 1 for k, e in zip(part, end)]
    return out


def passages(block: Block, index, w: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(item, seeds, start, end) of every stretch of a document that a seed suggests; at most about twice an item long."""
    first, count, owner, place = index
    at, row = block.places(w)
    used = count[row] > 0
    at, row = at[used], row[used]
    if not len(at):
        return []
    n = count[row]
    entry = np.repeat(first[row] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    item, begin = owner[entry], np.repeat(at, n) - place[entry]
    size = np.array([len(x) for _, x in block.items])[item]
    # seeds of one copy agree in where it begins, but for lost and added words: cells of half an item
    half = np.maximum(size // 2, 1)
    cell = begin // half
    keys, inverse, hits = np.unique(np.stack([item, cell]), axis=1, return_inverse=True, return_counts=True)
    out = []
    for (i, c), h in zip(keys.T, hits):
        length = len(block.items[i][1])
        step = max(length // 2, 1)
        out.append((int(i), int(h), max(0, int(c) * step - length // 4), min(len(w), (int(c) + 1) * step + length + length // 4)))
    return out


def find_passages(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE, doc_id: str = "doc_id", text: str = "text", block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, item_id, score, n_seeds, word_end) of every document and item that align with at least ``min_score``.

    ``word_end`` counts the document's words up to the end of the best passage.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    items = benchmark.select("item_id", "text").filter(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    numbered = items.withColumn("block", F.floor((F.row_number().over(Window.orderBy("item_id", "text")) - 1) / block_items))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id long, score double, n_seeds long, word_end long"
    found = spark.createDataFrame([], schema)
    for b in range(-(-items.count() // block_items)):
        block = Block.of([(r["item_id"], r["text"]) for r in numbered.filter(F.col("block") == b).collect()])
        if block.items:
            found = found.unionByName(_scan(rows, block, min_score, schema))
    return found


def _scan(rows: DataFrame, block: Block, min_score: float, schema: str) -> DataFrame:
    context = rows.sparkSession.sparkContext
    counts = gram_counts(rows, context.broadcast(block), len(block.keys))
    shared = context.broadcast((block, seeds(block, counts)))
    names = ["doc_id", "item_id", "score", "n_seeds", "word_end"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, index = shared.value
        for batch in text_slices(batches, "text", 1_000_000):
            docs, held, seen = [], [], []
            for d, text in enumerate(batch.column("text").to_pylist()):
                w = known.encode(text)
                for item, n, start, end in passages(known, index, w):
                    docs.append(d), held.append((item, start, w[start:end])), seen.append(n)
            score = _aligned(known, held)
            best: dict[tuple[int, int], tuple] = {}
            for d, (item, _, _), n, (s, end) in zip(docs, held, seen, score):
                key = (d, known.items[item][0])
                if s >= min_score and (key not in best or (-s, end) < best[key][:2]):
                    best[key] = (-s, end, n)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(pa.array([d for d, _ in best], pa.int64())), pa.array([i for _, i in best], pa.int64()),
                pa.array([-v[0] for v in best.values()], pa.float64()), pa.array([int(v[2]) for v in best.values()], pa.int64()),
                pa.array([int(v[1]) for v in best.values()], pa.int64())], names=names)

    return rows.mapInArrow(work, schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The documents without a passage of the benchmark. Documents are told apart by ``doc_id``; a null id is kept."""
    found = find_passages(docs, benchmark, min_score).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti")
