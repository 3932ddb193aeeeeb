"""Decontamination, classifiers, joins and the pipeline against brute force."""

from __future__ import annotations

import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tunefathom.llm import components, decontamination, jaccard_join, line_dedup, quality_cnn, quality_rules, toxicity
from tunefathom.llm.sample import labelled_sample


def _words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def _smith_waterman(a, b):
    best, before = 0, [0] * (len(b) + 1)
    for x in a:
        now = [0]
        for j, y in enumerate(b):
            now.append(max(0, before[j] + (2 if x == y else -1), before[j + 1] - 1, now[j] - 1))
        best, before = max(best, *now), now
    return best


def test_alignment_equals_the_plain_recurrence():
    rng = np.random.default_rng(1)
    items = [rng.integers(1, 6, rng.integers(5, 12)) for _ in range(60)]
    texts = [rng.integers(0, 6, rng.integers(1, 30)) for _ in range(60)]
    a, b = np.full((60, 12), -1), np.full((60, 30), -2)
    for i, (x, y) in enumerate(zip(items, texts)):
        a[i, :len(x)], b[i, :len(y)] = x, y
    got, _ = decontamination.align(a, b)
    assert got.tolist() == [_smith_waterman(x.tolist(), y.tolist()) for x, y in zip(items, texts)]


def test_passages_equal_an_alignment_of_every_pair(spark):
    rng = random.Random(2)
    items = [(i, " ".join(_words(rng, rng.randint(8, 30)))) for i in range(12)] + [(50, "too short"), (51, None), (None, "w1 w2 w3 w4 w5 w6")]
    docs = []
    for d in range(60):
        text = _words(rng, rng.randint(0, 120))
        if d % 2:  # a copy of an item, edited more and more
            copy = items[d % 12][1].split()
            for _ in range(d // 12):
                copy[rng.randrange(len(copy))] = "edited"
            at = rng.randint(0, len(text))
            text[at:at] = copy
        docs.append((d, " ".join(text).capitalize()))
    docs += [(100, None), (101, ""), (3, docs[3][1])]
    frame = spark.createDataFrame([(d, t, "clash") for d, t in docs], "doc_id long, text string, item_id string")
    got = {(r["doc_id"], r["item_id"]): round(r["score"], 9) for r in decontamination.find_passages(frame, spark.createDataFrame(items, "item_id long, text string"), block_items=5).collect()}
    want = {}
    for d, t in docs:
        for i, item in items:
            a, b = decontamination.words(item), decontamination.words(t)
            if i is not None and len(a) >= 5 and (s := _smith_waterman(a, b) / (2 * len(a))) >= 0.5:
                want[d, i] = round(s, 9)
    # a copy so edited that no three words in a row are left has no seed
    def grams(text):
        w = decontamination.words(text)
        return set(zip(w, w[1:], w[2:]))
    texts, wordings = dict(docs), dict(items)
    seedless = {k for k in want if not grams(texts[k[0]]) & grams(wordings[k[1]])}
    want = {k: v for k, v in want.items() if k not in seedless}
    assert got == want and len(want) > 20 and len(seedless) < 8
    left = decontamination.drop_contaminated(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"] for r in left.collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_no_benchmark_and_no_documents(spark):
    docs, none = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontamination.find_passages(docs, none).count() == 0
    assert decontamination.find_passages(docs.limit(0), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0


def _linked(texts, n, a, b):
    sets = [set(jaccard_join.shingles(t, n).tolist()) for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and b * shared >= a * len(sets[i] | sets[j]) and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    return group


@pytest.mark.parametrize("n,a", [(3, 90), (5, 80), (1, 80)])
def test_components_equal_all_pairs(spark, n, a):
    rng = random.Random(a + n)
    texts = []
    for _ in range(50):
        base = _words(rng, rng.choice([2, 6, 12, 25, 60, 200]), 60 if n == 1 else 400)
        texts.append(base)
        for _ in range(rng.choice([0, 1, 4])):
            copy = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 25)):
                copy[rng.randrange(len(copy))] = rng.choice(["x", "y"])
            texts.append(copy + (["tail"] if rng.random() < 0.3 else []))
    rng.shuffle(texts)
    texts = [" ".join(t) for t in texts]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(frame, n, a, 100).collect()}
    assert [got[i] for i in range(len(texts))] == _linked(texts, n, a, 100)


def test_no_similar_pair_is_without_a_common_key():
    """Sets at the very edge of the similarity, over all band borders."""
    rng = np.random.default_rng(5)
    for a, b in ((90, 100), (80, 100)):
        for size in [*range(1, 40), 77, 140, 333, 900]:
            for _ in range(6):
                pool = rng.integers(0, 1 << 63, 2 * size + 2, dtype=np.int64).view(np.uint64)
                lost = rng.integers(0, size)
                more = rng.integers(0, size // 4 + 1)
                x, y = np.unique(pool[:size]), np.unique(np.append(pool[:size - lost], pool[size:size + more]))
                shared = len(np.intersect1d(x, y))
                if b * shared >= a * (len(x) + len(y) - shared):
                    keys = [set(np.concatenate([jaccard_join.signatures(s, p) for p in jaccard_join.plans_for(len(s), a, b)]).tolist()) for s in (x, y)]
                    assert keys[0] & keys[1]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (205, 203), (203, 209)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(30)) and got[209] == got[205] == 203
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edit_distance_equals_the_built_in_one(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(1500):
        a = [rng.choice("abé") for _ in range(rng.randint(0, 40))]
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            at, kind = rng.randint(0, len(b)), rng.random()
            b[at:at + (kind > 0.4)] = [] if kind > 0.7 else [rng.choice("abé")]
        rows.append(("".join(a), "".join(b)))
    frame = spark.createDataFrame(rows, "a string, b string")
    for edits in (1, 2, 3):
        assert frame.filter(line_dedup.within_edits(F.col("a"), F.col("b"), edits) != (F.levenshtein("a", "b") <= edits)).count() == 0
        assert frame.filter(line_dedup.within_edits(F.col("a"), F.col("b"), edits).isNull()).count() == 0


def test_variants_of_one_line_and_kept_columns(spark):
    base = "a line of some forty characters to be varied"
    variants = [base[:i] + "#" + base[i + 1:] for i in range(0, 40, 4)] + [base[:i] + "@@@" + base[i + 3:] for i in range(0, 40, 7)]
    docs = [(i, f"{t}\nshort\nown line number {i} of a long enough text", "clash") for i, t in enumerate([base, *variants])] + [(None, base, "clash"), (99, None, "clash")]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string, removed string")).collect()}
    lines = {}
    for d, t, _ in docs:
        for n, line in enumerate(t.split("\n") if d is not None and t else []):
            lines[d, n] = line
    def near(x, y):
        return spark.range(1).select(F.levenshtein(F.lit(x), F.lit(y))).first()[0] <= 2 if x[:5] == y[:5] or x[-5:] == y[-5:] else False
    for d, n in lines:
        earlier = any(k < (d, n) and len(v) >= 24 and abs(len(v) - len(lines[d, n])) <= 2 and near(v, lines[d, n]) for k, v in lines.items()) if len(lines[d, n]) >= 24 else False
        assert (n in got[d]["removed"]) == earlier
        assert (lines[d, n] in got[d]["text"].split("\n")) or n in got[d]["removed"]
    assert got[None]["text"] == base and got[99]["text"] is None and got[99]["n_lines"] == 1


def test_chunks_cover_every_byte():
    for n in (0, 1, 511, 512, 513, 959, 960, 961, 5000):
        data = bytes(i % 251 for i in range(n))
        parts = quality_cnn.chunks(data)
        seen = b"".join(p[:quality_cnn.STEP].astype(np.int16)[p[:quality_cnn.STEP] < 256].astype(np.uint8).tobytes() for p in parts[:-1]) + parts[-1][parts[-1] < 256].astype(np.uint8).tobytes()
        assert seen == data


def test_classifier_learns_held_out_texts(spark):
    rng = random.Random(4)
    good = [" ".join(_words(rng, rng.randint(20, 300))) for _ in range(120)]
    bad = [" ".join(w + "%%$" for w in _words(rng, rng.randint(20, 300))) for _ in range(120)]
    rows = [(i, t, i < 120) for i, t in enumerate(good + bad)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t, _ in rows] + [(900, None, "clash"), (901, "", "clash"), (902, good[0] * 200, "clash")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(g)) for i, _, g in rows] + [(None, 1), (5, None)], "doc_id long, quality int")
    sample = labelled_sample(docs, labels, "quality", F.col("doc_id") % 3 != 0, 60)
    assert sample.count() == 120
    got = {r["doc_id"]: r["score"] for r in quality_cnn.score_texts(docs, quality_cnn.train(sample)).collect()}
    assert all((got[i] >= 0.3) == g for i, _, g in rows if i % 3 == 0) and got[902] >= 0.3
    assert got[900] == got[901] and 0 <= got[900] <= 1


def test_toxic_words_are_found_disguised(spark):
    rng = random.Random(6)
    def text(bad):
        words = ["".join(rng.choice(["ba", "lo", "ser", "tin", "mo", "ra", "stu", "pi"]) for _ in range(3)) for _ in range(80)]
        for _ in range(4 if bad else 0):
            words.insert(rng.randrange(80), rng.choice(["nasty", "filthy"]))
        return " ".join(words)
    rows = [(i, text(i % 2 == 0), i % 2 == 0) for i in range(200)]
    extra = [(900, None), (901, ""), (902, rows[1][1] + " n4sty"), (903, rows[1][1] + " f i l t h y"), (904, rows[1][1] + " naaaasty"), (905, rows[1][1] + " n.a.s.t.y,"), (906, rows[1][1] * 50)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + extra, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(b)) for i, _, b in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.col("doc_id") % 5 != 0)
    got = {r["doc_id"]: r["score"] for r in toxicity.score_texts(docs, model).collect()}
    assert {w for w in model.weights if not w.endswith("-")} == {"nasty", "filthy"}
    assert all((got[i] >= 0.3) == b for i, _, b in rows if i % 5 == 0)
    assert all(got[i] >= 0.3 for i in (902, 903, 904, 905)) and got[906] < 0.3 and got[900] == got[901] < 0.3


def test_one_doubled_letter_and_split_words_weigh(spark):
    words = ["stupid", "moron", "idiot", "idiot-", "clown"]
    texts = ["the stupid moron and the idiot clown went into the town to find a path", "an idea of many other words in one line of text and on"] * 40
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    language = toxicity.language_model([(r["trigram"], r["n"]) for r in toxicity.trigram_counts(frame).collect()])
    scorer = toxicity.Scorer(toxicity.ToxicModel(language, {w: 3.0 for w in words}, np.array([-3.0, 1.0, 1.0])))
    disguised = ["stuupid", "moroon", "idiiot", "Idioots", "cloown,", "stu pid", "mor on", "id io ts!", "st u pid", "clow n", '"stu p1d"']
    assert all(len(scorer.weights(f"a line with {d} in it")[0]) == 1 for d in disguised)
    rest = ["too good", "stu. pid", "mor only", "clow down", "full of wood", "id of iota", "stupid pid", "s t u p i d"]
    assert [len(scorer.weights(f"a line with {d} in it")[0]) for d in rest] == [0, 0, 0, 0, 0, 0, 1, 1]


def test_only_tokens_that_may_be_toxic_are_decoded(monkeypatch):
    """Lattices that no toxic word goes through are left alone; the others and all scores stay as they were."""
    decoded, viterbi = [], toxicity.viterbi
    monkeypatch.setattr(toxicity, "viterbi", lambda token, model: decoded.append(token) or viterbi(token, model))
    counts = [((a * 27 + b) * 27 + c, 1) for a in range(27) for b in range(27) for c in range(27)]
    scorer = toxicity.Scorer(toxicity.ToxicModel(toxicity.language_model(counts), {"stupid": 3.0, "moron": 2.0, "moron-": 1.5}, np.array([-3.0, 1.0, 1.0])))
    assert scorer.weights("worrd! r\u00e9gg! b0ok coffee! gr33n \u00fcberall\u00e9!")[0].tolist() == [] and not decoded
    assert scorer.weights("$tup1d s-t-u-p-i-d MOR0N! m0r0ns \u0455tup\u0456d st\u00fcpid")[0].tolist() == [3.0, 3.0, 2.0, 1.5, 3.0, 3.0]
    assert decoded


def test_letters_without_accents():
    for text in ("\u00c9T\u00c9 \u0130stanbul \ufb01n \u039f\u0394\u039f\u03a3 stra\u00dfe", "e\u0301\u0323x \u1e69 \uac00 \u200bz\u00adz", "\u0430\u0410 \U0001d518 \u00bd \u3000"):
        plain = unicodedata.normalize("NFKD", text.lower().translate(toxicity._HOMOGLYPHS))
        assert toxicity._letters(text) == "".join(c for c in plain if not unicodedata.combining(c))


def test_language_counts_cover_all_texts(spark):
    texts = ["abc ab", "É abd", None, "", "zz" * 50]
    counts = {r["trigram"]: r["n"] for r in toxicity.trigram_counts(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)).collect()}
    def number(s):
        return sum((ord(c) - 96 if c != " " else 0) * 27**k for c, k in zip(s, (2, 1, 0)))
    assert counts[number("abc")] == 1 and counts[number("abd")] == 1 and counts[number("zzz")] == 98 and counts[number("  e")] == 1


def _pipeline_by_hand(spark, docs, benchmark):
    """Every stage on plain Python rows."""
    judged = quality_rules.quality_rules(docs).filter("kept").select("doc_id", "text").collect()
    rows = {r["doc_id"]: r["text"] for r in judged}
    first, out = [], {}
    for d in sorted(rows):
        lines = []
        for line in rows[d].split("\n"):
            if len(line) >= 24:
                gone = any(f == line or abs(len(f) - len(line)) <= 2 and _edits(f, line) <= 2 for f in first)
                first.append(line)
                if gone:
                    continue
            lines.append(line)
        if "\n".join(lines).split() or "\n".join(lines) == rows[d]:
            out[d] = "\n".join(lines)
    ids = sorted(out)
    group = _linked([out[d] for d in ids], 5, 80, 100)
    out = {d: out[d] for i, d in enumerate(ids) if group[i] == i}
    def leaks(t):
        return any(_smith_waterman(decontamination.words(b), decontamination.words(t)) >= len(decontamination.words(b)) for b in benchmark)
    return {d: t for d, t in out.items() if not leaks(t)}


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row, before = [i + 1], row
        for j, y in enumerate(b):
            row.append(min(before[j + 1] + 1, row[j] + 1, before[j] + (x != y)))
    return row[-1]


def test_pipeline_equals_the_stages_by_hand(spark, tmp_path):
    rng = random.Random(8)
    vocabulary = ["the", "of", "and"] * 15 + [f"word{i}" for i in range(300)]
    def line():
        return " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 14)))
    docs = [(i, "\n".join(line() for _ in range(8))) for i in range(30)]
    benchmark = [line() + " " + line() for _ in range(4)]
    docs += [(40 + i, docs[i][1]) for i in range(4)]
    docs += [(50 + i, docs[i][1].replace("word", "wort", 1)) for i in range(4)]
    docs += [(60 + i, "\n".join(line() for _ in range(6)) + "\n" + benchmark[i]) for i in range(4)]
    docs += [(70, "$$$ %%% " * 60), (71, None), (72, ""), (73, "the of and " * 80)]
    long = docs[8][1].replace("\n", " ")
    docs += [(80, long), (81, long.replace("word1 ", "x "))]
    folder = str(tmp_path)
    frame = spark.createDataFrame([(d, t, "en", "s", len(t) if t else None) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(folder + "/documents.parquet")
    spark.createDataFrame(list(enumerate(benchmark)), "item_id long, text string").write.parquet(folder + "/benchmark.parquet")
    want = _pipeline_by_hand(spark, frame, benchmark)
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(got) == set(want) and 20 < len(want) < len(docs)
    import public_tokenizers
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert all(got[d]["ids"] == library.encode(t, add_special_tokens=False).ids for d, t in want.items())


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    empty = spark.createDataFrame([], schema)
    spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, str(tmp_path)).columns == empty.columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, empty, str(tmp_path)).count() == 0


def test_far_members_of_one_hub_meet_in_blocks(spark):
    """Members that differ from the hub too much, in pairs that are alike: found whatever the blocks."""
    rng = np.random.default_rng(11)
    def pool(n):
        return rng.integers(0, 1 << 62, n, dtype=np.int64).view(np.uint64)
    hub = np.unique(pool(200))
    rows, want = [], set()
    for i in range(40):
        own = np.unique(np.concatenate([hub[:150], pool(50)]))  # far from the hub
        twin = np.unique(np.concatenate([own[:-4], pool(4)]))
        near = np.unique(np.concatenate([hub[:-1], pool(1)]))
        for k, s in enumerate((own, twin, near)):
            rows.append((3 * i + k, 1000, len(s), np.setxor1d(s, hub).tobytes(), 1000 if k == 2 else 3 * i + k, k != 2))
        want.add(tuple(sorted((3 * i, 3 * i + 1))))
    members = spark.createDataFrame(rows, "doc long, hub long, size long, differs binary, component long, far boolean")
    for block in (1024, 7):
        got = {tuple(sorted((r["a"], r["b"]))) for r in jaccard_join.far_links(members, 90, 100, block).collect()}
        assert got == want


def test_many_near_copies_without_their_original(spark):
    rng = random.Random(12)
    base = _words(rng, 150, 5000)
    texts = []
    for i in range(60):
        copy = list(base)
        for _ in range(rng.randint(1, 5)):
            copy[rng.randrange(150)] = f"new{rng.randrange(400)}"
        texts.append(" ".join(copy))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(frame, 3, 90, 100).collect()}
    assert [got[i] for i in range(60)] == _linked(texts, 3, 90, 100)
