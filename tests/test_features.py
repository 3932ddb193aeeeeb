"""Neighbours, map, chorus and resampling against NumPy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tunefathom import fixed_values as fv
from tunefathom.functions import numeric as nu
from tunefathom.operators import aggregates as ag, features as fe, rollups as ro, timeseries as ts


def brute_knn(vectors: dict, k: int) -> dict:
    out = {}
    for a, va in vectors.items():
        d = sorted((float(np.sqrt(((va - vb) ** 2).sum())), b) for b, vb in vectors.items() if b != a)
        out[a] = d[:k]
    return out


def check_knn(spark, vectors: dict, k: int, **options):
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vectors.items()], "song_id bigint, features array<double>")
    got: dict = {}
    for r in fe.knn(df, k, **options).collect():
        got.setdefault(r["song_id"], []).append((r["rank"], r["neighbor_id"], r["distance"]))
    want = brute_knn(vectors, k)
    for song, expected in want.items():
        mine = sorted(got.get(song, []))
        assert [m[0] for m in mine] == list(range(1, len(expected) + 1))
        assert np.allclose([m[2] for m in mine], [e[0] for e in expected])
        assert [m[1] for m in mine] == [e[1] for e in expected]


@pytest.mark.parametrize("block", [4096, 37])
def test_knn_clusters_copies_and_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(fe, "BLOCK_ROWS", block)
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 20, (6, 5))
    vectors = {i: centres[i % 6] + rng.normal(0, 1, 5) for i in range(300)}
    for i in range(300, 420):  # more than a quarter of the library is one vector
        vectors[i] = centres[0]
    check_knn(spark, vectors, 4, cell_rows=30)


def test_knn_tiny_libraries(spark):
    check_knn(spark, {1: np.array([1.0]), 2: np.array([2.0]), 3: np.array([10.0]), 4: np.array([1.1])}, 10)
    check_knn(spark, {1: np.array([1.0, 2.0])}, 3)
    check_knn(spark, {1: np.array([1.0]), 2: np.array([1.0])}, 3)


def test_knn_on_a_grid_breaks_ties_by_id(spark):
    check_knn(spark, {i: np.array([i % 6, i // 6], dtype=float) for i in range(36)}, 3, cell_rows=6)


def test_knn_visits_grow_slower_than_all_pairs(spark):
    def compared(n: int) -> int:
        rng = np.random.default_rng(3)
        centres = rng.normal(0, 50, (40, 3))
        points = [(i, (centres[i % 40] + rng.normal(0, 1, 3)).tolist()) for i in range(n)]
        cells, own = fe.own_cells(spark.createDataFrame(points, "_rep bigint, _vec array<double>"), 5, cell_rows=10)
        sizes = cells.groupBy("_cell").count()
        met = own.select(F.explode("visits").alias("_cell")).join(sizes, "_cell").agg(F.sum("count")).first()[0] or 0
        return met + own.agg(F.sum(F.size("near"))).first()[0]
    small, large = compared(400), compared(3200)
    assert large < 8**1.6 * small and large < 3200**2 / 20


def test_knn_sends_a_vector_to_few_groups_however_many_cells_it_visits(spark, monkeypatch):
    monkeypatch.setattr(fe, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(7)
    points = [(i, rng.normal(0, 1, 16).tolist()) for i in range(320)]
    cells, own = fe.own_cells(spark.createDataFrame(points, "_rep bigint, _vec array<double>"), 4, cell_rows=12)
    most = own.agg(F.max(F.size("visits")).alias("cells"), F.max(F.size("groups")).alias("groups")).first()
    assert most["cells"] > fe.VISIT_GROUPS + 1 >= most["groups"]
    assert cells.select("_group").distinct().count() <= fe.VISIT_GROUPS + 1
    check_knn(spark, {i: np.array(v) for i, v in points}, 4, cell_rows=12)


def test_standardise_ignores_zero_and_missing(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0, None), ("b", 3.0, 5.0, None), ("c", 0.0, 5.0, None), ("d", None, 5.0, None)], "song_id string, x double, y double, z double")
    got = {r["song_id"]: r["features"] for r in fe.standardise(df, ["x", "y", "z"]).collect()}
    assert np.allclose(got["a"], [-np.sqrt(2), 0, 0]) and np.allclose(got["c"], [0, 0, 0]) and np.allclose(got["d"], [0, 0, 0])


def test_map_is_order_free_and_needs_three_songs(spark):
    rng = np.random.default_rng(1)
    rows = [(i, *map(float, rng.normal(0, [3, 1, 2]))) for i in range(1, 40)]
    df = spark.createDataFrame(rows, "song_id bigint, bpm double, happy double, sad double")
    one = fe.project_2d(df, ["bpm", "happy", "sad"]).orderBy("song_id").collect()
    assert one == fe.project_2d(df, ["sad", "nonsense", "happy", "bpm"]).orderBy("song_id").collect()
    x = np.array([r[1:] for r in rows])
    z = (x - x.mean(0)) / x.std(0)
    values, axes = np.linalg.eigh(np.cov(z.T, bias=True))
    assert np.allclose(np.abs([r["x"] for r in one]), np.abs(z @ axes[:, -1]))
    with pytest.raises(ValueError):
        fe.project_2d(df.limit(2), ["bpm", "happy"])


def test_correlations_match_pandas(spark):
    import pandas as pd
    rng = np.random.default_rng(2)
    frame = pd.DataFrame({"a": rng.normal(1e6, 1, 500), "b": rng.normal(0, 1, 500), "c": np.full(500, 0.1)})
    frame["d"] = frame["b"] * 2 + rng.normal(0, 0.1, 500)
    frame.loc[::3, "a"] = np.nan
    frame["e"] = np.nan
    want = frame[["a", "b", "c", "d"]].corr()
    df = spark.createDataFrame(frame.replace({np.nan: None}), "a double, b double, c double, d double, e double")
    got = {(r["feature_x"], r["feature_y"]): r["r"] for r in ag.correlations(df, list("abcde")).collect()}
    assert {x for x, _ in got} == set("abcd")
    for x in "abcd":
        for y in "abcd":
            w = want.loc[x, y]
            assert got[x, y] is None if np.isnan(w) else abs(got[x, y] - w) <= 0.00051


def brute_chorus(series, duration):
    w, n = 15, min(len(s[:int(duration)]) for s in series if s)
    if n < 30:
        return None
    if n < 45:
        return max(0, (n - w) // 2)
    m = np.column_stack([np.array(s[:n], float) for s in series if s])
    m = (m - m.mean(0)) / (m.std(0) + 1e-8)
    win = np.stack([m[i:i + w].ravel() for i in range(n - w)])
    win = win / (np.linalg.norm(win, axis=1, keepdims=True) + 1e-8)
    sim = win @ win.T
    i = np.arange(len(win))
    sim[np.abs(i[:, None] - i[None, :]) <= w] = -1
    e = (m[:, 0] - m[:, 0].min()) / (np.ptp(m[:, 0]) + 1e-8)
    score = 0.65 * sim.max(1) + 0.35 * np.array([e[k:k + w].mean() for k in i])
    edge = max(8, int(n * 0.08))
    score[:edge] = -1
    score[max(0, len(win) - edge):] = -1
    best = int(score.argmax())
    return next((k for k in range(edge, best) if sim[best, k] >= sim[best].max() * 0.92), best)


def test_chorus_matches_the_full_similarity_matrix(spark):
    rng = np.random.default_rng(7)
    songs, want = [], {}
    for i, n in enumerate([20, 29, 30, 44, 45, 60, 120, 240, 331, 700]):
        a, b = rng.normal(-20, 4, n), rng.normal(0, 1, n)
        if n > 200:  # a real repeat, louder
            a[150:170] = a[60:80] = rng.normal(-8, 2, 20)
            b[150:170] = b[60:80]
        songs.append((i, [float(x) for x in a], [float(x) for x in b], [], float(n) + 0.7))
        want[i] = brute_chorus([list(a), list(b), []], n + 0.7)
    songs += [(90, [], [], [], 100.0), (91, [1.0] * 50, None, None, 0.0), (92, [1.0] * 50, None, None, None)]
    want.update({90: None, 91: None, 92: None})
    df = spark.createDataFrame(songs, "song_id int, a array<double>, b array<double>, c array<double>, duration_seconds double")
    got = {r["song_id"]: r["start_seconds"] for r in ro.chorus_segment(df, ["a", "b", "c"]).collect()}
    assert got == want


@pytest.mark.parametrize("feature", ["loudness", "happy", "valence", "dissonance"])
def test_resampling_matches_interp(spark, feature):
    hop, window = ts.timebase(feature)
    rng = np.random.default_rng(3)
    songs = [(i, [float(v) for v in rng.normal(-60, 30, n)], float(d)) for i, (n, d) in enumerate([(1, 3.2), (5, 6.0), (140, 138.4), (200, 181.0)])]
    df = spark.createDataFrame(songs, "song_id int, values array<double>, duration_seconds double")
    for mode in ts.MODES:
        got: dict = {}
        for r in ts.resample_long(df, feature, mode).collect():
            got.setdefault(r["song_id"], []).append((r["position"], r["value"]))
        for i, values, d in songs:
            ys = np.maximum(values, -70) if feature == "loudness" else np.array(values)
            centres = np.arange(len(values)) * hop + window / 2
            grid = np.linspace(0, 1, 100) * d if mode == "relative" else np.arange(int(np.ceil(d)))[np.arange(int(np.ceil(d))) < d]
            assert np.allclose([v for _, v in sorted(got[i])], np.interp(grid, centres, ys))


def test_constant_songs_stay_flat_and_few_songs_are_hidden(spark):
    df = spark.createDataFrame([(i, [-12.5] * 300, d) for i, d in enumerate([138.4, 181.0, 240.7, 312.2, 356.9, 600.0])], "song_id int, values array<double>, duration_seconds double")
    for mode in ts.MODES:
        rows = ts.timeseries_envelope(df, "happy", mode).collect()
        assert all(r["mean"] is None if r["songs"] < 5 else abs(r["mean"] + 12.5) < 1e-9 and r["p25"] == r["p75"] for r in rows)
        assert any(r["songs"] < 5 for r in rows) == (mode == "absolute")
    flat = ts.normalise_envelope(ts.timeseries_envelope(df, "happy", "relative")).collect()
    assert {r["mean"] for r in flat} == {0.5}


def test_invalid_series_are_left_out(spark):
    df = spark.createDataFrame([(1, None, 200.0), (2, [], 200.0), (3, [1.0], None), (4, [1.0], 0.0), (5, [1.0], 2.0)], "song_id int, values array<double>, duration_seconds double")
    assert {r["song_id"] for r in ts.resample_long(df, "happy", "relative").collect()} == {5}
    with pytest.raises(ValueError):
        ts.resample_long(df, "nothing", "relative")


def test_unit_normalisers(spark):
    row = spark.range(1).select(
        nu.clamp01(F.lit(1.7)).alias("a"), nu.clamp01(F.lit(None).cast("double")).alias("b"), nu.normalise_av(F.lit(5.0)).alias("c"), nu.normalise_av(F.lit(0.4)).alias("d"),
        nu.loudness_gain(F.lit(None).cast("double")).alias("e"), nu.loudness_gain(F.lit(-30.0)).alias("f"), nu.loudness_gain(F.lit(4.0)).alias("g"),
        nu.release_year(F.lit("1900-01")).alias("h"), nu.release_year(F.lit("2030")).alias("i"), nu.release_year(F.lit("x")).alias("j"),
        nu.stretch_series(F.array(*[F.lit(float(i)) for i in range(3)]), F.lit(7)).alias("k")).first()
    assert (row.a, row.b, row.c, row.d, row.e, row.f) == (1.0, None, 0.5, 0.4, 1.0, 1.0)
    assert np.isclose(row.g, 0.1) and (row.h, row.i, row.j) == (None, 2030, None)
    assert row.k == [[0.0, 1.0, 2.0][min(int(np.floor(i * 3 / 7 + 0.5)), 2)] for i in range(7)]
    assert fv.FEATURE_FAMILY["arousal"] == "musicnn"


def test_chorus_sums_by_second_only_where_rounding_decides(monkeypatch):
    summed = []
    plain = ro._diagonal_sums

    def counted(products, width):
        sums = plain(products, width)
        summed.append(sums.size)
        return sums
    monkeypatch.setattr(ro, "_diagonal_sums", counted)
    rng = np.random.default_rng(4)
    values = rng.normal(0, 1, 1500)
    values[700:740] = values[300:340]
    steps = np.diff(values, prepend=0.0)
    assert ro._chorus_start([values, steps], 1500.0) == brute_chorus([list(values), list(steps)], 1500.0)
    assert sum(summed) < 1500**2 / 10
