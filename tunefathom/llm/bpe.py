"""BPE encoding and decoding with a public tokenizer's vocabulary, by batched merge rounds in numpy.

All words of a batch lie as symbols in one flat array. Each round looks every neighbouring pair up by binary search
over the sorted pair keys, takes each word's lowest rank, and merges all its places at once; words without a known
pair leave. The vocabulary file names the rules of a tokenizer with word ends: NFC, lower case, white space dropped,
bytes as letters. Texts are independent of each other, so the work is map-only and a lost task is simply run again.

Most words repeat, so runs between spaces are looked up in a cache of bounded size and only new ones are encoded.

Defined results: a null text is encoded like an empty one (no ids, decoded to an empty text); special tokens written
out in a text become their ids, as the tokenizers library does; ids outside the vocabulary raise on decoding; other
columns of the input stay, and result columns replace input columns of the same name.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T

#: Cached runs between spaces per Python worker; reaching it empties the cache.
CACHED_RUNS = 500_000
_NONE = np.iinfo(np.int64).max


class MergeTable:
    """Pair keys in order, with the rank and the merged symbol of each."""

    def __init__(self, vocabulary: dict[str, int], merges: list) -> None:
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left = np.array([vocabulary[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocabulary[b] for _, b in pairs], dtype=np.int64)
        made = np.array([vocabulary[a + b] for a, b in pairs], dtype=np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        # Merging every place of a pair at once equals merging one place after the other only if a new symbol never
        # opens a pair of lower rank.
        born = np.full(max(vocabulary.values()) + 1, -1, dtype=np.int64)
        np.maximum.at(born, made, np.arange(len(made)))
        self.together = bool(np.all(np.maximum(born[left], born[right]) < np.arange(len(left))))

    def encode(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols and lengths of words given as flat symbols; ``starts`` has where each word begins."""
        lengths = np.diff(np.append(starts, len(symbols)))
        word = np.repeat(np.arange(len(starts)), lengths)
        done_symbols, done_words = [], []
        while len(symbols):
            key = symbols[:-1] << 32 | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = (self.keys[at] == key) & (word[:-1] == word[1:])
            rank = np.append(np.where(known, self.ranks[at], _NONE), _NONE)
            begins = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            sizes = np.diff(np.append(begins, len(word)))
            lowest = np.repeat(np.minimum.reduceat(rank, begins), sizes)
            active = lowest != _NONE
            if not active.all():
                done_symbols.append(symbols[~active])
                done_words.append(word[~active])
                symbols, word, rank, lowest = symbols[active], word[active], rank[active], lowest[active]
                if not len(symbols):
                    break
            chosen = np.flatnonzero(rank == lowest)
            if self.together:
                # of overlapping places (a a a) every second one counts, from the left
                run = np.append(True, np.diff(chosen) != 1)
                first = np.maximum.accumulate(np.where(run, np.arange(len(chosen)), 0))
                chosen = chosen[(np.arange(len(chosen)) - first) % 2 == 0]
            else:
                chosen = chosen[np.append(True, word[chosen[1:]] != word[chosen[:-1]])]
            merged = self.made[np.searchsorted(self.keys, symbols[chosen] << 32 | symbols[chosen + 1])]
            symbols = symbols.copy()
            symbols[chosen] = merged
            keep = np.ones(len(symbols), dtype=bool)
            keep[chosen + 1] = False
            symbols, word = symbols[keep], word[keep]
        if not done_symbols:
            return np.empty(0, np.int64), np.zeros(len(starts), np.int64)
        out, owner = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(owner, kind="stable")
        return out[order], np.bincount(owner, minlength=len(starts))


class _Numbered(dict):
    """Gives every new key the next number and lists the keys that are new."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list = []

    def __missing__(self, key):
        self[key] = number = len(self)
        self.fresh.append(key)
        return number


class _Rows:
    """Rows of different lengths in one flat array, appended to and gathered by number."""

    def __init__(self) -> None:
        self.flat, self.starts, self.lengths = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def append(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        starts = len(self.flat) + np.cumsum(lengths) - lengths
        self.flat, self.starts, self.lengths = np.append(self.flat, flat), np.append(self.starts, starts), np.append(self.lengths, lengths)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat values of the rows in order, and each row's length."""
        lengths = self.lengths[rows]
        ends = np.cumsum(lengths)
        return self.flat[np.repeat(self.starts[rows] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)], lengths


class Tokenizer:
    """Encoder and decoder of one vocabulary file in the tokenizers library's JSON form."""

    def __init__(self, spec: str) -> None:
        from tokenizers import Tokenizer as Library

        data = json.loads(spec)
        model = data["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] is None or data["decoder"] is not None:
            raise ValueError("a BPE vocabulary with word ends and without a decoder is needed")
        vocabulary = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.table = MergeTable(vocabulary, model["merges"])
        suffix = model["end_of_word_suffix"]
        letters = _byte_letters()
        self.inner, self.last = np.full((2, 512), -1, dtype=np.int64)
        self.inner[[ord(c) for c in letters]] = [vocabulary[c] for c in letters]
        self.last[[ord(c) for c in letters]] = [vocabulary[c + suffix] for c in letters]
        names = {i: s for s, i in {**vocabulary, **self.special}.items()}
        self.names = [names.get(i) for i in range(max(names) + 1)]
        # only the rules that turn text into words; the merges are done here
        library = Library.from_str(spec)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.marks = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self._reset()

    def _reset(self) -> None:
        self.runs, self.words, self.run_ids, self.word_ids = _Numbered(), _Numbered(), _Rows(), _Rows()

    _ASCII = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
    _MARK = "\ue000"

    def _split(self, runs: list[str]) -> list[list[str]]:
        """The words of runs in byte letters, special tokens as they stand."""
        found: dict[str, list[str]] = {}
        plain = [r for r in runs if r.isascii() and r.isprintable() and "<|" not in r]
        for run, words in zip(plain, _divide(self._ASCII.findall("\n".join(plain).lower()), "\n")):
            found[run] = words
        others = [r for r in runs if r not in found]
        joined = [r for r in others if self._MARK not in r and not (self.marks and self.marks.search(r))]
        mark = "".join(_byte_letters()[b] for b in self._MARK.encode())
        for i in range(0, len(joined), 1000):  # each run between marks, so that one call splits many
            part = joined[i:i + 1000]
            for run, words in zip(part, _divide(self._library_words(f" {self._MARK} ".join(part)), mark)):
                found[run] = words
        for run in others:
            if run not in found:
                pieces = self.marks.split(run) if self.marks else [run]
                found[run] = [w for p in pieces for w in ([p] if p in self.special else self._library_words(p))]
        return [found[r] for r in runs]

    def _library_words(self, text: str) -> list[str]:
        return [w for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text)) if w]

    def _learn(self) -> None:
        """Encode the runs met for the first time."""
        if not self.runs.fresh:
            return
        per_run = self._split(self.runs.fresh)
        self.runs.fresh = []
        per = np.fromiter(map(len, per_run), np.int64, len(per_run))
        numbers = np.fromiter(map(self.words.__getitem__, itertools.chain.from_iterable(per_run)), np.int64, int(per.sum()))
        fresh, self.words.fresh = self.words.fresh, []
        if fresh:
            # a special token is a word of one finished symbol
            texts = ["!" if w in self.special else w for w in fresh]
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            letters, ends = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32), np.cumsum(sizes)
            symbols = self.inner[letters]
            symbols[ends - 1] = self.last[letters[ends - 1]]
            ids, lengths = self.table.encode(symbols, ends - sizes)
            places = np.cumsum(lengths) - lengths
            for i, w in enumerate(fresh):
                if w in self.special:
                    ids[places[i]] = self.special[w]
            self.word_ids.append(ids, lengths)
        ids, lengths = self.word_ids.take(numbers)
        ends, upto = np.append(0, np.cumsum(lengths)), np.append(0, np.cumsum(per))
        self.run_ids.append(ids, ends[upto[1:]] - ends[upto[:-1]])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of every text. A space or line break always separates words, whatever surrounds it."""
        if len(self.runs) > CACHED_RUNS:
            self._reset()
        number = self.runs.__getitem__
        rows = [np.fromiter(map(number, runs), np.int64, len(runs)) for runs in (t.replace("\n", " ").split(" ") if t else [] for t in texts)]
        self._learn()
        ids, lengths = self.run_ids.take(np.concatenate(rows) if rows else np.empty(0, np.int64))
        ends = np.append(0, np.cumsum(lengths))
        upto = np.append(0, np.cumsum([len(r) for r in rows])).astype(np.int64)
        return [ids[ends[a]:ends[b]] for a, b in zip(upto[:-1], upto[1:])]

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by spaces: the file names no decoder."""
        return " ".join(map(self.names.__getitem__, ids))


def _divide(words: list[str], mark: str) -> Iterator[list[str]]:
    """The words between marks."""
    start = 0
    while True:
        try:
            end = words.index(mark, start)
        except ValueError:
            yield words[start:]
            return
        yield words[start:end]
        start = end + 1


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the others moved above 255 in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    moved = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in own)}
    return [chr(moved.get(b, b)) for b in range(256)]


_LOADED: dict[int, Tokenizer] = {}


def loaded(spec: str) -> Tokenizer:
    """One tokenizer per Python worker, kept between tasks."""
    key = hash(spec)
    if key not in _LOADED:
        _LOADED[key] = Tokenizer(spec)
    return _LOADED[key]


def text_slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches cut so that one holds about ``most_bytes`` of text, or one row."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        part, start = np.cumsum(sizes) // most_bytes, 0
        for cut in [*(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]:
            if cut > start:
                yield batch.slice(start, cut - start)
            start = cut


OUTPUTS = {
    "ids": T.ArrayType(T.IntegerType()), "decoded": T.StringType(), "n_tokens": T.LongType(),
    "ids_sha256": T.StringType(), "decoded_sha256": T.StringType(),
}


def encode_decode(docs: DataFrame, vocabulary_path: str, outputs: tuple[str, ...] = ("ids", "decoded"), text: str = "text") -> DataFrame:
    """Adds the wanted ``outputs`` of encoding ``text`` and decoding the ids again.

    ``ids``, ``decoded``, ``n_tokens``, and the SHA-256 of the decimal ids joined by a space and of the decoded text.
    """
    with open(vocabulary_path, encoding="utf-8") as file:
        spec = docs.sparkSession.sparkContext.broadcast(file.read())  # a vocabulary file: a few MB, whatever the corpus
    kept = [c for c in docs.columns if c not in outputs]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(c, OUTPUTS[c]) for c in outputs])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = loaded(spec.value)
        number = [str(i) for i in range(len(tokenizer.names))]
        for batch in text_slices(batches, text):
            rows = tokenizer.encode(batch.column(text).to_pylist())
            made: dict[str, list] = {c: [] for c in outputs}
            for row in rows:
                ids = row.tolist()
                decoded = tokenizer.decode(ids) if "decoded" in made or "decoded_sha256" in made else None
                for name in outputs:
                    made[name].append(
                        row.astype(np.int32) if name == "ids" else decoded if name == "decoded" else len(ids) if name == "n_tokens"
                        else hashlib.sha256(decoded.encode()).hexdigest() if name == "decoded_sha256"
                        else hashlib.sha256(" ".join(map(number.__getitem__, ids)).encode()).hexdigest())
            arrays = [batch.column(c) for c in kept]
            arrays += [pa.array(made[c], pa.list_(pa.int32()) if c == "ids" else pa.int64() if c == "n_tokens" else pa.string()) for c in outputs]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *outputs])

    return docs.mapInArrow(work, schema)
