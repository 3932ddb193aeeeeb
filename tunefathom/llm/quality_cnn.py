"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. Learned filters run over each chunk and
are max-pooled; a small hidden layer turns a chunk's pooled values and its fill into a logit, and the mean logit of
all chunks gives the text's probability of being good.

The network is fitted on a bounded sample of labelled texts (``PER_CLASS`` per class, ``CHUNKS_PER_TEXT`` evenly
spaced chunks of each); scoring is map-only over whole texts.

Defined results: null and empty texts are one chunk without bytes and get the network's score for that; very long
texts are scored in blocks of chunks; repeated rows get equal scores; other columns stay, and ``score`` replaces an
input column of that name. Fitting needs texts of both classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from tunefathom.llm.bpe import text_slices

CHUNK, STEP = 512, 448
WIDTH, STRIDE = 6, 2
FILTERS, HIDDEN = 24, 16
#: Bounds of the training sample.
PER_CLASS, CHUNKS_PER_TEXT = 2000, 6
EPOCHS, STEPS, BATCH, RATE = 6, 250, 64, 0.004  # at least so many epochs and so many steps
_BLOCK = 128  # chunks per block of work
_PAD = 256
_POSITIONS = (CHUNK - WIDTH) // STRIDE + 1


def chunks(data: bytes) -> np.ndarray:
    """Overlapping chunks of a text's bytes, the last one padded."""
    count = 1 + max(0, -(-(len(data) - CHUNK) // STEP))
    padded = np.full((count - 1) * STEP + CHUNK, _PAD, dtype=np.int16)
    padded[:len(data)] = np.frombuffer(data, dtype=np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STEP]


@dataclass
class Network:
    filters: np.ndarray  # width x byte x filter; the padding byte is always zero
    shift: np.ndarray
    hidden: np.ndarray
    hidden_shift: np.ndarray
    out: np.ndarray
    out_shift: np.ndarray

    @classmethod
    def start(cls, seed: int) -> "Network":
        rng = np.random.default_rng(seed)
        filters = rng.normal(0, 0.3, (WIDTH, 257, FILTERS)).astype(np.float32)
        filters[:, _PAD] = 0
        hidden = rng.normal(0, (FILTERS + 1) ** -0.5, (FILTERS + 1, HIDDEN)).astype(np.float32)
        zeros = [np.zeros(n, dtype=np.float32) for n in (FILTERS, HIDDEN, 1)]
        return cls(filters, zeros[0], hidden, zeros[1], rng.normal(0, 0.2, HIDDEN).astype(np.float32), zeros[2])

    def parameters(self) -> list[np.ndarray]:
        return [self.filters, self.shift, self.hidden, self.hidden_shift, self.out, self.out_shift]

    def pooled(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Highest value of each filter in each chunk, and where it is."""
        best, place = np.empty((len(block), FILTERS), np.float32), np.empty((len(block), FILTERS), np.int64)
        for i in range(0, len(block), _BLOCK):
            part = block[i:i + _BLOCK]
            found = np.zeros((len(part), _POSITIONS, FILTERS), np.float32)
            for k in range(WIDTH):
                found += np.take(self.filters[k], part[:, k:k + STRIDE * _POSITIONS:STRIDE][:, :_POSITIONS], axis=0)
            place[i:i + _BLOCK] = found.argmax(axis=1)
            best[i:i + _BLOCK] = np.take_along_axis(found, place[i:i + _BLOCK, None, :], axis=1)[:, 0]
        return best + self.shift, place

    def logits(self, block: np.ndarray) -> np.ndarray:
        best = np.empty((len(block), FILTERS), np.float32)
        for i in range(0, len(block), _BLOCK):
            part = block[i:i + _BLOCK]
            found = np.take(self.filters[0], part[:, 0:STRIDE * _POSITIONS:STRIDE][:, :_POSITIONS], axis=0)
            for k in range(1, WIDTH):
                found += np.take(self.filters[k], part[:, k:k + STRIDE * _POSITIONS:STRIDE][:, :_POSITIONS], axis=0)
            best[i:i + _BLOCK] = found.max(axis=1)
        inputs = _with_fill(np.maximum(best + self.shift, 0), block)
        return np.maximum(inputs @ self.hidden + self.hidden_shift, 0) @ self.out + self.out_shift


def _with_fill(pooled: np.ndarray, block: np.ndarray) -> np.ndarray:
    return np.column_stack([pooled, (block != _PAD).mean(axis=1).astype(np.float32)])


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(texts: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Network:
    """Adam on the log loss of the texts' mean logits, both classes weighing the same; ``texts`` holds the chunks of each."""
    if len(set(labels.tolist())) < 2:
        raise ValueError("texts of both classes are needed")
    net, rng = Network.start(seed), np.random.default_rng(seed)
    means = [np.zeros_like(p) for p in net.parameters()]
    squares = [np.zeros_like(p) for p in net.parameters()]
    step, good = 0, labels.mean()
    weight = np.where(labels == 1, 0.5 / good, 0.5 / (1 - good))
    for _ in range(max(EPOCHS, -(-STEPS * BATCH // len(texts)))):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), BATCH):
            batch = order[i:i + BATCH]
            block, sizes = np.concatenate([texts[j] for j in batch]), np.array([len(texts[j]) for j in batch])
            owner = np.repeat(np.arange(len(batch)), sizes)
            best, place = net.pooled(block)
            inputs = _with_fill(np.maximum(best, 0), block)
            hidden = np.maximum(inputs @ net.hidden + net.hidden_shift, 0)
            logits = hidden @ net.out + net.out_shift
            score = _sigmoid(np.bincount(owner, logits) / sizes)
            back = (((score - labels[batch]) * weight[batch] / len(batch) / sizes)[owner]).astype(np.float32)
            d_hidden = np.outer(back, net.out) * (hidden > 0)
            d_best = (d_hidden @ net.hidden.T)[:, :FILTERS] * (best > 0)
            d_filters = np.zeros_like(net.filters)
            rows = np.arange(len(block))[:, None]
            for k in range(WIDTH):
                np.add.at(d_filters[k], (block[rows, place * STRIDE + k], np.arange(FILTERS)[None, :]), d_best)
            d_filters[:, _PAD] = 0
            slopes = [d_filters, d_best.sum(0), inputs.T @ d_hidden, d_hidden.sum(0), hidden.T @ back, back.sum(keepdims=True)]
            step += 1
            for p, g, m, s in zip(net.parameters(), slopes, means, squares):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7)
    return net


def sample_chunks(sample: DataFrame, per_text: int = CHUNKS_PER_TEXT) -> DataFrame:
    """``per_text`` evenly spaced chunks of each sampled text as bytes, with its label."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            found = []
            for text in batch.column("text").to_pylist():
                every = chunks((text or "").encode())
                at = np.unique(np.linspace(0, len(every) - 1, min(per_text, len(every))).round().astype(int))
                found.append(every[at].astype("<i2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(found, pa.binary())], names=["doc_id", "label", "chunks"])
    return sample.select("doc_id", "label", "text").mapInArrow(work, "doc_id long, label int, chunks binary")


def train(sample: DataFrame, per_text: int = CHUNKS_PER_TEXT, seed: int = 7) -> Network:
    """Fit on a bounded sample (``doc_id``, ``text``, ``label``): a few kilobytes of each text come to the driver."""
    rows = sorted(sample_chunks(sample, per_text).collect(), key=lambda r: (r["doc_id"], r["chunks"]))
    texts = [np.frombuffer(r["chunks"], dtype="<i2").reshape(-1, CHUNK) for r in rows]
    return fit(texts, np.array([r["label"] for r in rows], dtype=np.float32), seed)


def score_texts(docs: DataFrame, network: Network, text: str = "text", score: str = "score") -> DataFrame:
    """Adds the probability of being good, from all chunks of every text."""
    kept = [c for c in docs.columns if c != score]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(score, T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, text, 2_000_000):
            texts = [chunks((t or "").encode()) for t in batch.column(text).to_pylist()]
            sizes = np.array([len(t) for t in texts])
            logits = np.concatenate([network.logits(t) for t in _joined(texts)])
            means = np.add.reduceat(logits.astype(np.float64), np.cumsum(sizes) - sizes) / sizes
            arrays = [batch.column(c) for c in kept] + [pa.array(_sigmoid(means), pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, score])

    return docs.mapInArrow(work, schema)


def _joined(texts: list[np.ndarray], rows: int = 2048) -> Iterator[np.ndarray]:
    """The chunks of several texts together, so that short texts do not make short blocks."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= rows:
            yield np.concatenate(held)
            held, size = [], 0
    if held:
        yield np.concatenate(held)
