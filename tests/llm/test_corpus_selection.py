"""Suffix dedup, importance resampling and source divergence against brute force, with odd rows and hot keys."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest

from tunefathom.llm import importance_resampling as ir, jaccard_join, source_divergence as sd, suffix_dedup
from tunefathom.session import settled

LENGTH = suffix_dedup.LENGTH


# --- suffix dedup -----------------------------------------------------------------

def removed_bytes(rows):
    seen = Counter()
    for _, text in rows:
        data = (text or "").encode()
        seen.update(data[i:i + LENGTH] for i in range(len(data) - LENGTH + 1))
    out = []
    for doc, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - LENGTH + 1):
            if seen[data[i:i + LENGTH]] > 1:
                gone[i:i + LENGTH] = b"\1" * LENGTH
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((doc, len(data), sum(gone), len([run for run in bytes(gone).split(b"\0") if run]), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def passages_and_copies():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]

    def text(n):
        return " ".join(rng.choice(words) for _ in range(n))
    shared = [text(60) for _ in range(4)]
    rows = [(0, None), (1, ""), (2, "a" * 199), (3, "a" * 200), (4, "a" * 201), (5, "ab" * 300), (6, "é" * 100), (7, "é" * 100), (7, "é" * 99 + "xy")]
    for i in range(40):  # passages cut at any place, between texts of their own
        made = text(rng.randint(5, 150))
        for passage in shared:
            if rng.random() < 0.5:
                made += " " + passage[rng.randint(0, 80):len(passage) - rng.randint(0, 80)] + " " + text(rng.randint(0, 60))
        rows.append((10 + i, made))
    base = text(200)
    for i in range(20):  # near copies
        changed = base.split()
        for _ in range(rng.randint(0, 8)):
            changed[rng.randrange(len(changed))] = f"X{rng.randrange(5)}"
        rows.append((100 + i, " ".join(changed)))
    rows += [(200, base)] * 6 + [(None, base + base), (None, None), (300, "line one of the text\n" * 40), (301, "q" * 5000), (302, "a" * 200)]
    return rows


@pytest.mark.parametrize("share, least", [(suffix_dedup.HOT, suffix_dedup.HOT_ROWS), (10**9, 1), (200, 5)])
def test_suffix_dedup_with_no_all_and_some_hot_buckets(spark, share, least):
    rows = passages_and_copies()
    docs = spark.createDataFrame([(d, t, "own", 1) for d, t in rows], "doc_id long, text string, bucket string, place int").repartition(5)
    assert Counter(tuple(r) for r in suffix_dedup.remove_repeated(docs, share, least).collect()) == removed_bytes(rows)


def test_suffix_dedup_of_nothing_and_of_one_long_text(spark):
    assert suffix_dedup.remove_repeated(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rng = random.Random(6)
    long = " ".join(f"{rng.randrange(10**9)}" for _ in range(40_000))
    rows = [(1, long + long[5_000:5_400] + "!"), (2, "x" + long[9_000:9_250] + "y")]
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffix_dedup.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2] == (250, 1) and got[1][0] >= 400 + 400 + 250 and got[1][1] >= 3


def test_sampled_offsets_do_not_depend_on_blocks():
    rng = random.Random(7)
    data = bytes(rng.choice(b"abc ") for _ in range(6000)) + b"z" * 700
    whole = [np.concatenate(c) for c in zip(*suffix_dedup.sampled(data))]
    for block in (1, 145, 1000):
        parts = [np.concatenate(c) for c in zip(*suffix_dedup.sampled(data, block))]
        assert all((a == b).all() for a, b in zip(whole, parts))
    place, low, high = whole
    assert sorted(s for p, a, b in zip(place, low, high) for s in range(p - b, p - a + 1)) == list(range(len(data) - LENGTH + 1))
    assert (low >= 0).all() and (high < suffix_dedup.WIDTH).all()


# --- importance resampling --------------------------------------------------------

def features(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return len(words), [crc32(f.encode()) % ir.BUCKETS for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def drawn(docs, target, percent, seed):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    whole_s, whole_t = sum(s.values()) + ir.BUCKETS, sum(t.values()) + ir.BUCKETS
    rows = []
    for doc, text in docs:
        n, buckets = features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * whole_s / ((s[b] + 1) * whole_t))) for b in buckets) // len(buckets) if buckets else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append((doc, len(buckets), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= ir.MIN_WORDS))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], -math.inf if r[0] is None else r[0], r[1]))
    able = able[:len(able) * percent // 100]
    return Counter([(*r[:4], i + 1) for i, r in enumerate(able)]) + (Counter([(*r[:4], None) for r in rows]) - Counter([(*r[:4], None) for r in able]))


def corpus():
    rng = random.Random(8)
    words = [f"word{i}" for i in range(60)] + ["Ärger", "x", "42"]
    docs = [(rng.choice([None, *range(2000)]), " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for _ in range(400)]
    docs += [(5, None), (6, ""), (7, "!?"), (8, "UPPER " * 25), (8, "UPPER " * 25), (9, docs[0][1])] + [(17, "same text again " * 9)] * 30
    return docs


@pytest.mark.parametrize("finish", [2, 50, ir.FINISH])
def test_resampling_down_to_the_last_key(spark, finish):
    docs, target = corpus(), ["word1 word2 word3 Ärger", None, "", "x x x"]
    table = spark.createDataFrame([(d, t, "own", 1.0) for d, t in docs], "doc_id long, text string, score string, rank double").repartition(7)
    got = ir.resample(table, spark.createDataFrame([(t,) for t in target], "text string"), 25, 7, finish).collect()
    assert Counter(tuple(r) for r in got) == drawn(docs, target, 25, 7)


def test_resampling_of_empty_tables(spark):
    none, docs = spark.createDataFrame([], "doc_id long, text string"), corpus()
    assert ir.resample(none, none).count() == 0
    got = ir.resample(spark.createDataFrame(docs, "doc_id long, text string"), none.select("text"), 100).collect()
    assert Counter(tuple(r) for r in got) == drawn(docs, [], 100, 7)


def test_cutoff_of_uneven_partitions(spark):
    rng = random.Random(9)
    keys = sorted({(rng.randrange(50), rng.randrange(9), rng.randrange(3), i) for i in range(900)})
    frame = settled(spark.createDataFrame(rng.sample(keys, len(keys)), "k1 long, k2 long, k3 long, k4 long").repartitionByRange(6, "k1"), "keys")
    for take in (1, 2, 450, 899, 900):
        assert ir.cutoff(frame, take, finish=3) == keys[take - 1]


def test_pieces_of_a_very_long_text_are_one_text():
    text = " ".join(f"w{i % 977}" for i in range(400_000)) + "-" + "y" * 3_000_000 + " end"
    pieces = list(ir.bucket_pieces(text))
    assert len(pieces) > 1
    words, buckets = features(text)
    assert sum(n for n, _ in pieces) == words and Counter(np.concatenate([b for _, b in pieces]).tolist()) == Counter(buckets)


# --- source divergence ------------------------------------------------------------

def audit(docs):
    groups, counts, held = set(), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered)
        counts[lang, source].update(terms)
        held[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in held[lang].items() if n >= sd.MIN_DOCUMENTS]
        sources = [s for g, s in groups if g == lang]
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])

        def share(c):
            total = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + sd.SCALE * (c[t] + 2) // total for t in kept}
        q, p = share(whole), {s: share(counts[lang, s]) for s in sources}

        def apart(a, b):
            return (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(apart(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(-apart(p[s][t], q[t]), t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, ranked in (("pair", sorted(pairs)), ("term", sorted(terms)[:sd.TOP_TERMS])):
                out += [(lang, s, part, item, -value, i + 1) for i, (value, _, item) in enumerate(ranked)]
    return Counter(out)


def test_divergence_of_odd_groups(spark):
    rng = random.Random(10)
    words = [f"Wort{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)] + ["Öl", "ÖL", "naïve", "a1b"]
    docs = [(" ".join(rng.choice(words[:rng.randint(5, len(words))]) for _ in range(rng.randint(0, 40))), rng.choice(["en", "en", "de", None, "", "En"]),
             rng.choice(["hot", "hot", "s1", "s2", None, "", "é"])) for _ in range(500)]
    docs += [(None, "fr", "one"), ("few words", "it", "a"), ("other", "it", "b"), ("12 34", "it", "c"), ("x " * 20_000, "de", "s1")]
    table = spark.createDataFrame([(*d, 1, "own") for d in docs], "text string, lang string, source string, n int, term string").repartition(5)
    got = sd.source_divergence(table)
    assert Counter(tuple(r) for r in got.collect()) == audit(docs)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sd.source_divergence(table.limit(0)).count() == 0


def test_shares_are_exact_beyond_doubles():
    count, total = np.array([10**12 + 7, 3, 0]), np.array([10**15 - 11, 7, 10**15])
    assert sd.shares(count, total).tolist() == [1 + sd.SCALE * (int(c) + 2) // int(t) for c, t in zip(count, total)]


# --- jaccard join: sketches and groups of large hubs --------------------------------

def test_sketches_never_refuse_a_similar_pair():
    rng = np.random.default_rng(11)
    for size in (3, 900, 5000, 40_000):
        tokens = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
        other = np.union1d(tokens[: int(len(tokens) * 0.95)], rng.integers(0, 2**63, size // 30, dtype=np.uint64))
        one, two = jaccard_join.sketch(tokens), jaccard_join.sketch(other)
        short = min(len(one), len(two))
        differ = int(np.bitwise_count(jaccard_join.folded(one, short) ^ jaccard_join.folded(two, short)).sum())
        assert differ <= len(np.setxor1d(tokens, other))


def test_components_do_not_depend_on_blocks(spark):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(40)]
    bases = [[rng.choice(words) for _ in range(rng.randint(4, 60))] for _ in range(12)]
    docs = []
    for i in range(220):
        text = list(rng.choice(bases))
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(len(text))] = rng.choice(words)
        docs.append((i, " ".join(text)))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    sets = {i: set(jaccard_join.shingles(t, 2).tolist()) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for x in sets:
        for y in sets:
            if x < y and 10 * len(sets[x] & sets[y]) >= 8 * len(sets[x] | sets[y]) > 0:
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    for block in (2, 1024):
        got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(table, 2, 8, 10, block).collect()}
        assert got == {i: find(i) for i in sets}
