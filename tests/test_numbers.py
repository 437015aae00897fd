"""Quantiles, the expression mask and hierarchical clustering against computations in memory."""

import inspect
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxmere.operators import linkage as L
from voxmere.operators import raster
from voxmere.operators.quantiles import quantiles


def test_quantiles_against_numpy(spark):
    rng = np.random.default_rng(1)
    groups = {
        "normal": rng.normal(size=3000) * 1e6,
        "few": rng.integers(0, 3, 500).astype(float),
        "one": np.array([4.25]),
        "same": np.full(70, -2.0),
        "wide": np.concatenate([[-1.5e308, 1.5e308], rng.random(400) * 1e-300, np.arange(50.0)]),
    }
    qs = [0.0, 0.05, 0.5, 0.9995, 1.0]
    rows = [(g, float(v)) for g, a in groups.items() for v in a] + [("none", None), ("none", math.nan), ("few", None)]
    frame = spark.createDataFrame(rows, "g string, v double")
    found = {(r.g, r.q): r.value for r in quantiles(frame, "v", qs, "g").collect()}
    inner = {k: v for k, v in found.items() if not (k[0] == "wide" and k[1] == 0.9995)}  # that one is between 49 and 1.5e308
    assert inner == pytest.approx({(g, q): float(np.quantile(a, q)) for g, a in groups.items() for q in qs if not (g == "wide" and q == 0.9995)}, rel=1e-12)
    every = np.concatenate([a for g, a in groups.items() if g != "wide"])
    assert {r.q: r.value for r in quantiles(frame.where("g <> 'wide'"), "v", qs).collect()} == pytest.approx({q: float(np.quantile(every, q)) for q in qs}, rel=1e-12)
    assert quantiles(frame.where("g = 'none'"), "v", qs, "g").count() == 0


def test_weighted_quantiles(spark):
    rng = np.random.default_rng(2)
    v, n = rng.normal(size=300), rng.integers(0, 9, 300)
    frame = spark.createDataFrame([(float(a), int(b)) for a, b in zip(v, n)], "v double, n long")
    assert quantiles(frame, "v", [0.3], weight="n").first().value == pytest.approx(float(np.quantile(np.repeat(v, n), 0.3)))


def brute_mask(signal: np.ndarray, background: np.ndarray, step: float, slope: float, window: int, kernel: int, most: int = 1000) -> tuple[np.ndarray, int]:
    """On whole arrays (z, y, x): scores after the median, and the number of rounds."""
    c1, c2 = signal.ravel(), background.ravel()
    fit = lambda m: np.polyfit(c1[m], c2[m], 1)
    start = 0
    for w in range(int(c1.max()) // window + 1):
        inside = (c1 >= w * window) & (c1 < (w + 1) * window)
        if len(np.unique(c1[inside])) > 1 and fit(inside)[0] >= slope:
            start = (w + 1) * window
            break
    mask, rounds = c1 >= start, 0
    while True:
        m, b = fit(mask)
        rest = m * c1 + b - c2
        up, down = rest[mask & (rest > 0)], -rest[mask & (rest < 0)]
        above, below = np.percentile(up, 100 - step), np.percentile(down, 100 - step)
        if rounds == most or (above < below and m > slope):
            break
        mask, rounds = mask & (rest <= above), rounds + 1
    score = np.where((rest > 0) & ~mask, rest / np.std(rest[mask]), 0).reshape(signal.shape)
    half = kernel // 2
    padded = np.pad(score, ((0, 0), (half, half), (half, half)))
    boxes = np.lib.stride_tricks.sliding_window_view(padded, (1, kernel, kernel))
    return np.median(boxes.reshape(*score.shape, -1), axis=-1), rounds


@pytest.fixture(scope="module")
def brain(spark):
    """Two channels that follow each other, and a bright patch in one of them."""
    rng = np.random.default_rng(3)
    background = rng.integers(100, 900, (3, 30, 30))
    signal = (background * 1.1 + rng.normal(0, 40, background.shape)).round().astype(int).clip(0)
    signal[1, 8:17, 5:16] += rng.integers(1500, 3000, (9, 11))
    signal[2, 3, 3] += 4000  # a speckle
    frame = spark.createDataFrame([(*map(int, p), int(signal[tuple(p)]), int(background[tuple(p)])) for p in np.ndindex(signal.shape)], "z int, y int, x int, signal int, background int")
    return signal, background, frame


@pytest.mark.parametrize(("step", "slope", "window", "kernel"), [(5.0, 0.4, 300, 5), (2.0, 0.6, 150, 3), (10.0, 0.3, 100_000, 1)])
def test_expression_mask_against_arrays(brain, step, slope, window, kernel):
    signal, background, frame = brain
    want, rounds = brute_mask(signal, background, step, slope, window, kernel)
    assert rounds and (want > 0).any()
    got = {(r.z, r.y, r.x): r.v for r in raster.expression_mask(frame, step, slope, window, kernel).collect()}
    assert got == pytest.approx({tuple(map(int, p)): float(want[tuple(p)]) for p in np.argwhere(want > 0)}, rel=1e-6)
    if kernel > 1:
        assert want[1, 12, 10] > 0 and (2, 3, 3) not in got


def test_expression_mask_without_pixels_or_spread(spark, brain):
    frame = brain[2]
    assert raster.expression_mask(frame.limit(0)).count() == 0
    assert raster.expression_mask(frame.where("z = 0").selectExpr("z", "y", "x", "5 as signal", "background")).count() == 0


def brute_linkage(d: np.ndarray, method: str) -> list[tuple]:
    """One merge at a time: the nearest pair, the smaller names among equals."""
    parts = {i: [i] for i in range(len(d))}
    dist = {(i, j): round(float(d[i, j]), 9) for i, j in itertools.combinations(range(len(d)), 2)}
    out = []
    while dist:
        (a, b), h = min(dist.items(), key=lambda e: (e[1], e[0]))
        na, nb = len(parts[a]), len(parts[b])
        out.append((a, b, h, na + nb))
        del dist[a, b]
        for k in parts:
            if k not in (a, b):
                x, y = dist.pop(tuple(sorted((a, k)))), dist.pop(tuple(sorted((b, k))))
                v = {"weighted": (x + y) / 2, "average": (na * x + nb * y) / (na + nb), "complete": max(x, y), "single": min(x, y)}[method]
                dist[tuple(sorted((a, k)))] = v
        parts[a] += parts.pop(b)
    return out


@pytest.mark.parametrize("method", L.METHODS)
def test_linkage_against_one_at_a_time(spark, method):
    x = np.random.default_rng(4).normal(size=(24, 3))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    frame = spark.createDataFrame([(i, j, float(d[i, j])) for i, j in itertools.combinations(range(24), 2)], "a long, b long, d double")
    found = sorted(map(tuple, L.linkage(frame, method).collect()), key=lambda r: r[2])
    want = sorted(brute_linkage(d, method), key=lambda r: r[2])
    assert [r[:2] + r[3:] for r in found] == [r[:2] + r[3:] for r in want]
    assert [r[2] for r in found] == pytest.approx([r[2] for r in want], abs=1e-7)
    assert L.linkage(frame.limit(0), method).count() == 0


@pytest.mark.parametrize("metric", L.METRICS)
def test_distances_of_matrix_rows(spark, metric):
    rng = np.random.default_rng(5)
    m = rng.integers(0, 4, (9, 6)).astype(float)
    m[4] = 2.0  # constant: no correlation
    m[7] = 0.0
    cells = spark.createDataFrame([(i, f"c{j}", float(m[i, j])) for i, j in np.ndindex(m.shape) if m[i, j] or i % 2] + [(None, "c0", 1.0), (0, "c0", None)], "region long, brain string, n double")
    found = {(r.a, r.b): r.d for r in L.distances(cells, "region", "brain", "n", metric).collect()}
    rows = [i for i in range(9) if metric == "euclidean" or m[i].std() > 0]
    of = (lambda a, b: 1 - np.corrcoef(a, b)[0, 1]) if metric == "correlation" else (lambda a, b: np.linalg.norm(a - b))
    assert found == pytest.approx({(i, j): float(of(m[i], m[j])) for i, j in itertools.combinations(rows, 2)}, abs=1e-9)


def test_distances_shuffle_rows_and_not_pairs(spark):
    m = np.random.default_rng(6).integers(0, 9, (200, 4)).astype(float)
    cells = spark.createDataFrame([(i, f"c{j}", float(m[i, j])) for i, j in np.ndindex(m.shape)], "region long, brain string, n double")
    pairs = L.distances(cells, "region", "brain", "n", "euclidean", block=64)
    assert "Join" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    found = {(r.a, r.b): r.d for r in pairs.collect()}
    assert found == pytest.approx({(i, j): float(np.linalg.norm(m[i] - m[j])) for i, j in itertools.combinations(range(200), 2)}, abs=1e-9)


def test_copies_of_a_row_do_not_grow_with_the_rows(spark):
    most = inspect.signature(L.distances).parameters["block"].default
    rows = spark.range(100_000).withColumnRenamed("id", "r")
    dealt = L._against(rows, 8, most)
    assert dealt.count() <= 12 * 100_000  # blocks of 4096 rows made 25 copies of each
    ends = {(r.i, r.j, r["first"]): (r.lo, r.hi) for r in dealt.groupBy("i", "j", "first").agg(F.min("r").alias("lo"), F.max("r").alias("hi")).collect()}
    assert all(ends[i, j, True][1] < ends[i, j, False][0] for i, j, first in ends if i < j and first)


def test_distances_are_rounded_as_spark_rounds(spark):
    rng = np.random.default_rng(8)
    d = np.r_[rng.random(2000) * 2, rng.integers(0, 4000, 500) / 128, (rng.integers(0, 10**7, 2000) + 0.5) / 1e6, 5e-7, 1.5e-6, 0.0, 1e15, 123456789012.3456785, 1e300, np.inf]
    want = [r[0] for r in spark.createDataFrame([(float(v),) for v in d], "d double").select(F.round("d", 6)).collect()]
    assert L._rounded(d, 6).tolist() == want
    cells = spark.createDataFrame([(f"r{i}", f"c{j}", float(v)) for (i, j), v in np.ndenumerate(rng.integers(0, 9, (70, 4)))], "region string, brain string, n double")
    assert sorted(L.distances(cells, "region", "brain", "n", digits=6).collect()) == sorted(L.distances(cells, "region", "brain", "n", block=64).withColumn("d", F.round("d", 6)).collect())


@pytest.mark.parametrize("method", ["weighted", "average"])
def test_linkage_of_rows_against_one_at_a_time(spark, method):
    rng = np.random.default_rng(7)
    m = rng.integers(0, 50, (90, 5)).astype(float)
    m[60:70], m[75:80] = m[3], m[70]  # copies
    cells = spark.createDataFrame([(i, f"c{j}", float(m[i, j])) for i, j in np.ndindex(m.shape)], "region long, brain string, n double")
    found = sorted(map(tuple, L.linkage_of_rows(cells, "region", "brain", "n", method, block=64).collect()), key=lambda r: (round(r[2], 6), r[:2]))
    want = sorted(brute_linkage(np.maximum(0.0, 1 - np.corrcoef(m)), method), key=lambda r: (round(r[2], 6), r[:2]))
    assert [r[:2] + r[3:] for r in found] == [r[:2] + r[3:] for r in want]
    assert [r[2] for r in found] == pytest.approx([r[2] for r in want], abs=1e-7)
    assert L.linkage_of_rows(cells.where("region = 1"), "region", "brain", "n").count() == 0


@pytest.mark.parametrize("held", [1 << 21, 100])
def test_silhouette_hands_on_sums_and_no_copies_of_points(spark, monkeypatch, held):
    import duckdb
    import pandas as pd

    import __spark_entry__
    from voxmere.operators import cohort

    rng = np.random.default_rng(10)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[200:220] = x[:20]
    label = [None if i % 29 == 0 else int(i % 5) for i in range(300)]
    label[7] = 9  # alone in its cluster
    rows = [(i - (i == 150), label[i] if i != 150 else label[149], None if i == 33 else x[i].tolist()) for i in range(300)]  # one id twice, one without a vector
    points = spark.createDataFrame([*rows, (None, 1, x[0].tolist())], "vec_id long, label int, embedding array<float>")
    seen, old = [], type(points).mapInArrow
    monkeypatch.setattr(type(points), "mapInArrow", lambda self, *a: seen.append(old(self, *a)) or seen[-1])
    monkeypatch.setattr(cohort, "SUMS", held)
    got = cohort.silhouette(points, "label", "embedding", "vec_id", block=40).first()[0]
    embeddings = pd.DataFrame({"vec_id": pd.array([r[0] for r in rows] + [None], "Int64"), "label": pd.array([r[1] for r in rows] + [1], "Int64"), "embedding": [r[2] for r in rows] + [x[0].tolist()]})
    c = duckdb.connect()
    c.register("embeddings", embeddings)
    assert round(got, 5) == c.execute(__spark_entry__.oracle_sql()["a16_silhouette"]).fetchone()[0]
    if held > 100:
        assert seen[0].count() == 299 * 7  # for each point its sums by six clusters and a row without; blocks met in groups gave 8 times as many


def test_distances_keep_their_digits():
    """By a matrix product, but equal and nearly equal rows far from the origin keep their distance."""
    from voxmere.operators import cohort

    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(50, 64)), rng.normal(size=(70, 64)) + 1000
    x[:30] += 1000
    y[:20] = x[:20]
    y[20:25] = x[20:25] + 1e-9
    x[40, 3], y[60, 5] = np.nan, np.inf
    exact = np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2))
    assert np.allclose(cohort.distances(x, y, (x * x).sum(axis=1), (y * y).sum(axis=1)), exact, rtol=1e-9, atol=0, equal_nan=True)
