"""Toxicity: noisy-channel deobfuscation under a character language model, then a score of the restored text.

A token that mixes letters with digits or symbols, spells letters out one by one, or repeats a letter becomes a
lattice: each observed character may stand for itself, for the letters it is known to imitate, or (separators,
repeats) for nothing, each at a price. The Viterbi path through the lattice under a character trigram model is the
restored token. A token with repeated letters also stands for each toxic word that it equals but for repeats, and
neighbouring pieces for the toxic word that they are when written together. Toxic words and word beginnings come from
labelled texts; a text's score is calibrated from the weights of those it contains, plainly or restored, in total and
per word.

The trigram model is counted over all texts (a table of fixed size); words and calibration are fitted on a bounded
sample of labelled texts (``PER_CLASS`` per class, ``MAX_WORDS`` words). Scoring is map-only over whole texts.

Defined results: null and empty texts have no words and get the score of a text without toxic words; repeated rows
get equal scores; other columns stay, and ``score`` replaces an input column of that name. Without toxic labels no
word is toxic and every score is the share of toxic texts in the sample.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tunefathom.llm.bpe import text_slices
from tunefathom.llm.sample import labelled_sample
from tunefathom.plans.shapes import one_row

#: What a character may stand for besides itself. Fixed values.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "×": "x",
    "*": "aeiou", "#": "aeiouh", "?": "aeiou", "%": "aeiou", "&": "a",
}
_MASKS, _SEPARATORS = "*#?%&", ".-_~',:;/\\·•"
#: Letters of other scripts that look Latin, and marks without width. Fixed values.
_HOMOGLYPHS = str.maketrans("аеорсухіјѕмтквнԁɡ", "aeopcyxijsmtkbhdg", "\u00ad\u200b\u200c\u200d\u2060\ufeff")
#: Prices in natural-log units: a lookalike, a masked letter, a dropped separator, another dropped symbol, a repeat
#: dropped from a run of three or more, or from a pair.
PRICE_LOOKALIKE, PRICE_MASK, PRICE_SEPARATOR, PRICE_SYMBOL, PRICE_LONG, PRICE_PAIR = 0.7, 1.5, 0.5, 2.5, 0.4, 2.0
#: What any dropped character costs besides: about as much as a letter, so that longer readings are not punished.
PRICE_CHARACTER = 2.5
PER_CLASS, MAX_WORDS = 1500, 2000
#: Lengths of word beginnings that are looked at besides whole words.
BEGINNINGS = (5, 6, 7)
#: A toxic word stands after at least so many different words in toxic texts, and is so much more frequent there.
MIN_CONTEXTS, MIN_LOG_ODDS = 8, 2.5
CACHED_TOKENS = 400_000
_N = 27  # 26 letters and the word border


class _Latin(dict):
    """What a lower-case character becomes in Latin letters without accents, found once per character."""

    def __missing__(self, code: int) -> str:
        decomposed = unicodedata.normalize("NFKD", chr(code).translate(_HOMOGLYPHS))
        self[code] = found = "".join(c for c in decomposed if not unicodedata.combining(c))
        return found


_LATIN = _Latin()


def _letters(text: str) -> str:
    """Lower case in Latin letters without accents."""
    return text.lower() if text.isascii() else text.lower().translate(_LATIN)


# ---- the language model -------------------------------------------------------------------------------------------

_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)


def trigram_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Counts of letter trigrams over all texts: at most 27 cubed rows, summed before the shuffle."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_N**3, dtype=np.int64)
        for batch in text_slices(batches, text):
            # two borders between texts, so that no trigram spans two of them
            joined = "  ".join(t if t.isascii() else _letters(t) for t in batch.column(text).to_pylist() if t)
            if joined:
                c = _CLASS[np.frombuffer(f"  {joined}  ".encode("latin-1", "replace"), dtype=np.uint8)]
                total += np.bincount(c[:-2] * _N * _N + c[1:-1] * _N + c[2:], minlength=_N**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["trigram", "n"])
    return docs.select(text).mapInArrow(work, "trigram long, n long").groupBy("trigram").agg(F.sum("n").alias("n"))


def language_model(counts: list[tuple[int, int]]) -> np.ndarray:
    """Log probability of a letter after two others, backed off to one and none."""
    n = np.zeros(_N**3)
    for trigram, count in counts:
        n[trigram] = count
    n = n.reshape(_N, _N, _N)
    n[0, 0, 0] = 0  # runs of borders are not language
    single = (n.sum((0, 1)) + 1) / (n.sum() + _N)
    double = n.sum(0)
    after_one = (double + 20 * single) / (double.sum(1, keepdims=True) + 20)
    return np.log((n + 5 * after_one[None]) / (n.sum(2, keepdims=True) + 5))


# ---- the channel --------------------------------------------------------------------------------------------------

def lattice(token: str) -> Iterator[list[tuple[int, float]]]:
    """For each character the letters it may stand for (0: none) with their prices. Runs count as two at most."""
    for run in _RUN.finditer(token):
        c, repeat = run[1], PRICE_LONG if len(run[0]) > 2 else PRICE_PAIR
        if "a" <= c <= "z":
            options = [(ord(c) - 96, 0.0)]
        else:
            price = PRICE_MASK if c in _MASKS else PRICE_LOOKALIKE
            options = [(ord(x) - 96, price) for x in LOOKALIKES.get(c, "")]
            if not c.isdigit() or not options:
                options.append((0, PRICE_CHARACTER + (PRICE_SEPARATOR if c in _SEPARATORS else PRICE_SYMBOL)))
        yield options
        if len(run[0]) > 1:
            yield [*[o for o in options if o[0]], (0, PRICE_CHARACTER + repeat if options[0][0] else 0.0)]


def viterbi(token: str, model: np.ndarray) -> str:
    """The likeliest letters behind a token. States are the last two letters; only reachable ones are kept."""
    states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    for options in lattice(token):
        following: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (score, path) in states.items():
            for letter, price in options:
                key = (b, letter) if letter else (a, b)
                value = score - price + (model[a, b, letter] if letter else 0.0)
                if key not in following or value > following[key][0]:
                    following[key] = (value, (path, letter) if letter else path)
        states = following
    best = max(states.items(), key=lambda s: s[1][0] + model[s[0][0], s[0][1], 0])[1][1]
    letters = []
    while best:
        best, letter = best
        letters.append(chr(96 + letter))
    return "".join(reversed(letters))


_PAIR, _RUN = re.compile(r"(.)\1"), re.compile(r"(.)\1*", re.S)
_EDGES = ".,;:!?\"'()[]{}<>|*#$%&-_/~`@+"
#: Those that imitate no letter.
_MARKS = "".join(c for c in _EDGES if c not in LOOKALIKES)


class Restorer:
    """Restored forms of tokens and of letters spelt out one by one."""

    def __init__(self, model: np.ndarray) -> None:
        self.model = model

    def forms(self, raw: str, text: str | None = None, wanted: Callable[[str], bool] | None = None) -> Iterator[str]:
        """The words a token may stand for: itself without marks around it, and the decoded lattices where it has any.

        A symbol at an edge may belong to the word ($tupid) or not (stupid!!), so both readings are decoded; those that
        are not ``wanted`` are left out. ``text``: the token's ``_letters`` where they are known.
        """
        own = raw.lower().strip(_EDGES)
        if own.isalpha():
            yield own
        text = _letters(raw) if text is None else text
        core = text.strip(_EDGES)
        plain = core.isascii() and core.isalpha()
        if plain and core != own:
            yield core
        if core and any("a" <= c <= "z" for c in core):
            start, end = text.find(core), text.find(core) + len(core)
            left, right = start and text[start - 1] in LOOKALIKES, end < len(text) and text[end] in LOOKALIKES
            readings = [core] if not plain or _PAIR.search(core) else []
            readings += [text[start - 1:end]] if left else []
            readings += [text[start:end + 1]] if right and text[end:end + 2] in LOOKALIKES else []
            for reading in readings:
                if wanted is None or wanted(reading):
                    yield viterbi(reading, self.model)

    def spelt(self, letters: list[str]) -> str:
        """Single characters in a row, read as one."""
        return viterbi("".join(_letters(x) for x in letters), self.model)


# ---- the score ----------------------------------------------------------------------------------------------------

def units(word: str) -> list[str]:
    """A word and its beginnings; beginnings end in a hyphen."""
    return [word, *[word[:n] + "-" for n in BEGINNINGS if len(word) > n]]


@dataclass
class ToxicModel:
    language: np.ndarray
    weights: dict[str, float]
    curve: np.ndarray  # base, slope of the total weight, slope of the weight per word


class _Weights(dict):
    """Highest weight among a token's forms, found once per token; below zero if it has none but may be the first
    piece of a toxic word."""

    def __init__(self, restorer: Restorer, weights: dict[str, float]) -> None:
        super().__init__()
        whole = {w for u in weights if len(u) > 3 for w in (u.removesuffix("-"), _letters(u.removesuffix("-")))}
        self.beginnings = {w[:n] for w in whole for n in range(1, len(w))}
        self.restorer, self.known = restorer, weights
        self.shapes: dict[str, list[tuple[float, re.Pattern]]] = {}
        for unit, weight in weights.items():
            self.shapes.setdefault(_RUN.sub(r"\1", unit.removesuffix("-")), []).append((weight, re.compile(_with_repeats(unit))))
        self.lengths = sorted({len(shape) for shape in self.shapes})
        # most words are told from all toxic ones by how they begin
        self.starts, self.shape_starts = {unit[:3] for unit in weights}, {shape[:2] for shape in self.shapes}
        self.stems = {unit.removesuffix("-") for unit in weights}
        self.openings = {stem[:n] for stem in self.stems for n in range(len(stem) + 1)}

    def plain(self, word: str) -> float:
        """Without restoring anything."""
        if word[:3] not in self.starts:
            return 0.0
        known = self.known
        found = known.get(word, 0.0)
        for n in BEGINNINGS:
            if len(word) > n and (weight := known.get(word[:n] + "-", 0.0)) > found:
                found = weight
        return found

    def may_hold(self, token: str) -> bool:
        """Whether a path through the token's lattice begins with a toxic word, however unlikely it is."""
        reached = {""}
        for options in lattice(token):
            longer = {word + chr(96 + letter) if letter else word for word in reached for letter, _ in options}
            if not self.stems.isdisjoint(longer):
                return True
            reached = longer & self.openings
            if not reached:
                return False
        return False

    def opens(self, word: str) -> bool:
        """Whether ``word`` begins, but for repeats, like a toxic one."""
        first = word[:1]
        return first + word.lstrip(first)[:1] in self.shape_starts or first in self.shape_starts

    def repeated(self, word: str) -> float:
        """Of a word whose repeats may be left out."""
        shape = _RUN.sub(r"\1", word)
        near = [u for n in self.lengths if n <= len(shape) for u in self.shapes.get(shape[:n], ())]
        return max((weight for weight, pattern in near if pattern.fullmatch(word)), default=0.0)

    def __missing__(self, raw: str) -> float:
        core = raw.strip(_MARKS)
        if core.isascii() and core.isalpha():
            # a lattice of letters only differs by repeats, so its path is among what ``repeated`` finds
            own = letters = core.lower()
            found = self.plain(own) if len(own) > 2 else 0.0
            if self.opens(own) and _PAIR.search(own):
                found = max(found, self.repeated(own))
        else:
            own, text = core.lower(), _letters(raw)
            letters = text[len(raw) - len(core):]  # of the core, where nothing is stripped from the end
            found = max((self.plain(w) for w in self.restorer.forms(raw, text, self.may_hold) if len(w) > 2), default=0.0)
            if _PAIR.search(raw):
                found = max(found, *[self.repeated(w) for w in (raw.lower().strip(_EDGES), text.strip(_EDGES)) if w.isalpha() and self.opens(w)], 0.0)
        if not found and raw[-1].isalpha() and (own in self.beginnings or letters in self.beginnings):
            found = -1.0
        self[raw] = found
        return found


def _with_repeats(unit: str) -> str:
    """A pattern of the words that are ``unit``, or begin with it, when some repeats of letters are left out."""
    word = unit.removesuffix("-")
    return "".join(f"{re.escape(r[1])}{{{len(r[0])},}}" for r in _RUN.finditer(word)) + (".+" if unit != word else "")


class Scorer:
    def __init__(self, model: ToxicModel) -> None:
        self.model, self.restorer = model, Restorer(model.language)
        self.cache = _Weights(self.restorer, model.weights)
        self.sizes = sorted({len(w) for w in model.weights if len(w) > 3 and not w.endswith("-")})

    def in_pieces(self, tokens: list[str], found: np.ndarray) -> list[float]:
        """The weights of toxic words written in neighbouring pieces, none of which weighs anything itself.

        Marks may stand around the whole. Rows of single characters are left to ``spelt``.
        """
        out, used = [], 0
        for i in np.flatnonzero(found < 0).tolist():
            if i < used:
                continue
            joined = tokens[i].lstrip(_EDGES)
            for j in range(i + 1, len(tokens)):
                piece = tokens[j]
                if found[j] > 0 or not piece[0].isalnum() and piece[0] not in LOOKALIKES:
                    break
                joined += piece
                own, word = joined.lower().strip(_EDGES), _letters(joined).strip(_EDGES)
                weight = max(self.cache.plain(own), self.cache.plain(word)) if word.isalpha() else self.cache[joined]
                if weight > 0 and (j == i + 1 or any(len(t) > 1 for t in tokens[i:j + 1])):
                    out.append(weight)
                    used = j + 1
                    break
                if not piece[-1].isalpha() or not (own in self.cache.beginnings or word in self.cache.beginnings):
                    break
        return out

    def weights(self, text: str) -> tuple[np.ndarray, int]:
        """The weights of a text's toxic words, and its number of words."""
        if len(self.cache) > CACHED_TOKENS:
            self.cache.clear()
        tokens = text.split()
        found = np.fromiter(map(self.cache.__getitem__, tokens), np.float64, len(tokens))
        single = np.fromiter(map(len, tokens), np.int64, len(tokens)) == 1
        # three or more single characters in a row may spell a word
        edges = np.flatnonzero(np.diff(np.concatenate([[0], single, [0]])))
        spelt = []
        for a, b in zip(edges[::2], edges[1::2]):
            if b - a > 2:
                whole = self.restorer.spelt(tokens[a:b])
                spelt += [self.model.weights.get(whole[i:i + n], 0.0) for n in self.sizes for i in range(len(whole) - n + 1)]
        found = np.concatenate([found, spelt, self.in_pieces(tokens, found)])
        return found[found > 0], len(tokens)

    def features(self, text: str | None) -> list[float]:
        """One, the total of the squared weights and the weight per hundred words, both on a log scale."""
        found, n = self.weights(text or "")
        return [1.0, math.log1p(float(found @ found)), math.log1p(100 * float(found.sum()) / max(n, 1))]

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(self.model.curve, self.features(text)))))))


def toxic_words(sample: DataFrame, language: np.ndarray, min_contexts: int = MIN_CONTEXTS, min_log_odds: float = MIN_LOG_ODDS, most: int = MAX_WORDS) -> dict[str, float]:
    """Words and word beginnings that set toxic texts apart, with their log odds; at most ``most`` come to the driver.

    Places that agree in the word before, as in copies of a text, count as one.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(language)
        for batch in text_slices(batches, "text", 1_000_000):
            seen = set()
            for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist()):
                words = [next(restorer.forms(t), "") for t in text.split()]
                seen.update((label, b, u) for b, w in zip(["", *words], words) if len(w) > 2 for u in units(w))
            yield pa.RecordBatch.from_pydict(dict(zip(("label", "before", "unit"), zip(*seen))) if seen else {"label": [], "before": [], "unit": []}, schema=schema)

    schema = pa.schema([("label", pa.int32()), ("before", pa.string()), ("unit", pa.string())])
    pairs = sample.select("label", "text").mapInArrow(work, "label int, before string, unit string").distinct()
    counts = pairs.groupBy("unit").agg(F.count_if(F.col("label") == 1).alias("bad"), F.count_if(F.col("label") == 0).alias("good"))
    totals = one_row(counts.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")))
    likely = counts.filter(F.col("bad") >= min_contexts).withColumn("all", totals)
    odds = F.log((F.col("bad") + 0.5) / (F.col("all.bad") + 1)) - F.log((F.col("good") + 0.5) / (F.col("all.good") + 1))
    chosen = likely.withColumn("weight", odds).filter(F.col("weight") >= min_log_odds)
    return {r["unit"]: r["weight"] for r in chosen.orderBy(F.desc(F.col("weight") * F.sqrt("bad")), "unit").limit(most).collect()}


def fit(docs: DataFrame, labels: DataFrame, train, per_class: int = PER_CLASS) -> ToxicModel:
    """Count the language over all texts, choose the words, then calibrate a logistic curve on the sample."""
    language = language_model([(r["trigram"], r["n"]) for r in trigram_counts(docs).collect()])
    sample = labelled_sample(docs, labels, "toxic", train, per_class)
    model = ToxicModel(language, toxic_words(sample, language), np.zeros(3))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in text_slices(batches, "text", 1_000_000):
            found = [scorer.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found, pa.list_(pa.float64()))], names=["label", "features"])

    rows = sample.select("label", "text").mapInArrow(work, "label int, features array<double>").collect()
    if rows:
        model.curve = _logistic(np.array([r["features"] for r in rows]), np.array([r["label"] for r in rows], dtype=float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic coefficients by Newton steps, slopes not below zero."""
    used = np.ones(x.shape[1], dtype=bool)
    while True:
        beta = np.zeros(x.shape[1])
        part = x[:, used]
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(part @ beta[used], -30, 30)))
            hessian = (part * (p * (1 - p))[:, None]).T @ part + ridge * np.eye(used.sum())
            beta[used] += np.linalg.solve(hessian, part.T @ (y - p) - ridge * beta[used])
        if (beta[1:] >= 0).all():
            return beta
        used[1:] &= beta[1:] >= 0


def score_texts(docs: DataFrame, model: ToxicModel, text: str = "text", score: str = "score") -> DataFrame:
    """Adds the probability of being toxic."""
    kept = [c for c in docs.columns if c != score]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(score, T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in text_slices(batches, text):
            found = pa.array([scorer.score(t) for t in batch.column(text).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], found], names=[*kept, score])

    return docs.mapInArrow(work, schema)
