"""Plan shapes against brute force, with hot keys and tiny chunks."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from tunefathom.plans import shapes


def test_exact_quantiles_through_the_brackets(spark):
    random.seed(1)
    rows = [("hot", random.choice([1.0, 1.0, 1.0, random.gauss(0, 5)])) for _ in range(9000)]
    rows += [("few", float(i)) for i in range(7)] + [("same", 2.0)] * 500 + [("one", 4.0), ("one", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {r["k"]: r for r in shapes.exact_quantiles(df, ["k"], "v", probs, accuracy=100, also=[F.avg("v").alias("mean")]).collect()}
    for k in ("hot", "few", "same", "one"):
        values = [v for key, v in rows if key == k and v is not None]
        assert got[k]["n"] == len(values)
        assert np.isclose(got[k]["mean"], np.mean(values))
        for i, p in enumerate(probs):
            assert np.isclose(got[k][f"q{i}"], np.percentile(values, p * 100)), (k, p)


def test_previous_value_across_chunks(spark):
    random.seed(2)
    rows = [(g, t, random.choice(["a", "b", None])) for g in ("x", "y") for t in sorted(random.sample(range(1000), 200))]
    df = spark.createDataFrame(rows, "g string, t int, v string").repartition(5)
    for chunk in (shapes.chunks_of(lambda t: F.floor(t / 7)), shapes.even_chunks(df, "t", 15)):
        got = {(r["g"], r["t"]): r["p"] for r in shapes.previous_value(df, ["g"], "t", chunk, "v", "p").collect()}
        for g in ("x", "y"):
            mine = [(t, v) for k, t, v in rows if k == g]
            for i, (t, _) in enumerate(mine):
                assert got[(g, t)] == (mine[i - 1][1] if i else None)


def test_neighbours_across_chunks_of_two_levels(spark):
    random.seed(4)
    rows = [(g, t, random.choice(["a", "b", None])) for g in ("x", "y") for t in sorted(random.sample(range(100_000), 300))] + [("z", 5, "only")]
    df = spark.createDataFrame(rows, "g string, t int, v string").repartition(5)
    chunk = shapes.even_chunks(df, "t", 10, most=4)
    assert chunk(df, "t").select("_chunk").distinct().count() > 20
    got = {(r["g"], r["t"]): r for r in shapes.neighbour_values(df, ["g"], "t", chunk, "v").collect()}
    assert len(got) == len(rows)
    for g in ("x", "y", "z"):
        mine = [(t, v) for k, t, v in rows if k == g]
        for i, (t, _) in enumerate(mine):
            r = got[g, t]
            assert r["_before"] == (mine[i - 1][1] if i else None) and r["_after"] == (mine[i + 1][1] if i + 1 < len(mine) else None)
            assert r["_first"] == mine[0][1] and r["_last"] == mine[-1][1]


def test_following_event(spark):
    random.seed(3)
    asked = [(i, random.choice("abc"), random.randrange(500)) for i in range(300)]
    events = [(random.choice("abd"), random.randrange(400)) for _ in range(150)]
    a = spark.createDataFrame(asked, "id int, k string, since int")
    e = spark.createDataFrame(events, "k string, at int")
    out = shapes.following_event(a, e, "k", "since", "at", shapes.chunks_of(lambda t: F.floor(t / 13)), "found")
    got = {r["id"]: r["found"] for r in out.collect()}
    for i, k, since in asked:
        assert got[i] == min((at for key, at in events if key == k and at >= since), default=None)


def test_place_in_group_with_a_hot_group(spark):
    rows = [("hot", (i * 7919) % 5000, i) for i in range(3000)] + [(f"g{i % 40}", i % 9, i) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, s int, i int")
    got = {(r["g"], r["i"]): r["place"] for r in shapes.place_in_group(df, ["g"], [-F.col("s"), F.col("i")], "place").collect()}
    for g in {r[0] for r in rows}:
        order = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        assert [got[(g, r[2])] for r in order] == list(range(1, len(order) + 1))


def test_a_filter_does_not_copy_what_is_bound(spark):
    from tunefathom.functions import text as tx
    df = spark.createDataFrame([("Élan",), ("",), (None,)], "t string")
    rows = shapes.bound(df, w=tx.match_words(F.col("t"))).filter("w <> ''")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("without_accents") == 1
    assert [(r["t"], r["w"]) for r in rows.collect()] == [("Élan", "elan")]
