"""Edges across tiles, maps of sparse voxels and places among masks, against whole arrays."""

import hashlib
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxmere.operators import augment, components, dense, graph, inference, raster, ridges

VOXEL = "volume_id string, z int, y int, x int, v double"


def whole_section(image: np.ndarray, low: float, high: float) -> dict:
    """Sobel gradient, ridges along it, and weak ridges that touch strong ones, on one array."""
    ydim, xdim = image.shape
    wide = np.pad(image, 1, mode="edge")
    dy, dx, size = np.zeros(image.shape), np.zeros(image.shape), np.zeros((ydim + 2, xdim + 2))
    for j, w in ((0, 1), (1, 2), (2, 1)):
        dy += w * (wide[2:, j : j + xdim] - wide[:-2, j : j + xdim])
        dx += w * (wide[j : j + ydim, 2:] - wide[j : j + ydim, :-2])
    size[1:-1, 1:-1] = np.hypot(dy, dx)
    turn = np.round(np.arctan2(dy, dx) / (np.pi / 4)).astype(int) % 4
    step = ((0, 1), (1, 1), (1, 0), (1, -1))
    weak = {}
    for y, x in np.ndindex(image.shape):
        a, b = step[turn[y, x]]
        here = size[y + 1, x + 1]
        if here >= low and here >= size[y + 1 + a, x + 1 + b] and here > size[y + 1 - a, x + 1 - b]:
            weak[y, x] = here
    edge = [p for p, v in weak.items() if v >= high]
    found = set(edge)
    while edge:
        y, x = edge.pop()
        for p in ((y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
            if p in weak and p not in found:
                found.add(p)
                edge.append(p)
    return {p: weak[p] for p in found}


def test_edges_run_through_tiles(spark):
    rng = np.random.default_rng(6)
    ydim, xdim, images = 41, 70, {}
    for volume in "ab":
        for z in (0, 1, 17):
            y, x = np.mgrid[:ydim, :xdim]
            shape = ((y - 20) ** 2 + (x - 35) ** 2 < rng.integers(100, 380)) * 5.0 + (np.abs(y - x // 2) < 3) * 2.0
            images[volume, z] = np.round(shape + rng.random(shape.shape), 3)
    rows = [(k, z, int(y), int(x), float(a[y, x])) for (k, z), a in images.items() for y, x in np.ndindex(a.shape)]
    got = {(r.volume_id, r.z, r.y, r.x): r.v for r in ridges.gradient_edges(spark.createDataFrame(rows, VOXEL), ydim, xdim, 4.0, 14.0).collect()}
    want = {(k, z, *p): v for (k, z), a in images.items() for p, v in whole_section(a, 4.0, 14.0).items()}
    assert len(want) > 300 and got == pytest.approx(want)


def test_edges_of_sparse_sections_and_regions(spark):
    rng = np.random.default_rng(7)
    image = np.zeros((33, 50))
    image[rng.integers(0, 33, 90), rng.integers(0, 50, 90)] = 3.0
    frame = spark.createDataFrame([("a", 2, int(y), int(x), 3.0) for y, x in np.argwhere(image)] + [("a", 2, 33, 0, 9.0)], VOXEL)
    want = whole_section(image, 2.0, 9.0)
    assert {(r.y, r.x): r.v for r in ridges.gradient_edges(frame, 33, 50, 2.0, 9.0).collect()} == pytest.approx(want)
    wide = {(y + i, x + j) for y, x in want for i in (-2, -1, 0, 1, 2) for j in (-2, -1, 0, 1, 2) if 0 <= y + i < 33 and 0 <= x + j < 50}
    assert {(r.y, r.x) for r in ridges.edge_regions(frame, 33, 50, 2.0, 9.0, 0.0, 5).collect()} == wide
    assert ridges.edge_regions(frame, 33, 50, 1e9, 1e9).count() == 0


def half_up(v: np.ndarray) -> np.ndarray:
    return (np.sign(v) * np.floor(np.abs(v) + 0.5)).astype(int)


@pytest.mark.parametrize("matrix", [augment.linear_map(30.0), augment.linear_map(-110.0, (0.3, -0.2), (1.0, 1.7, 0.6)), [[0, 1, 0], [1, 0, 0], [0, 0, 2.5]], [[0.9, 0.2, 0], [-0.1, 1.2, 0.3], [0.2, 0, 0.7]]])
def test_warp_against_every_place(spark, matrix):
    rng = np.random.default_rng(8)
    dims = (7, 13, 16)
    old = {tuple(map(int, p)): float(v) for p, v in zip(rng.integers(0, dims, (260, 3)), rng.random(260).round(3))}
    frame = spark.createDataFrame([("a", *p, v) for p, v in old.items()], VOXEL)
    middle, inverse = (np.array(dims) - 1) / 2, np.linalg.inv(np.array(matrix, float))
    places = np.argwhere(np.ones(dims))
    back = half_up((inverse @ (places - middle).T).T + middle)
    want = {tuple(map(int, p)): old[tuple(b)] for p, b in zip(places, back.tolist()) if tuple(b) in old}
    assert {(r.z, r.y, r.x): r.v for r in augment.warp(frame, dims, matrix).collect()} == want


def test_twist_against_every_place(spark):
    rng = np.random.default_rng(9)
    dims = (9, 14, 12)
    old = {tuple(map(int, p)): float(v) for p, v in zip(rng.integers(0, dims, (400, 3)), rng.random(400).round(3))}
    frame = spark.createDataFrame([("a", *p, v) for p, v in old.items()], VOXEL)
    middle, want = (np.array(dims) - 1) / 2, {}
    for z, y, x in np.ndindex(dims):
        a = np.radians(-50.0 * (z - middle[0]) / (dims[0] - 1))
        b = half_up(np.array([np.cos(a) * (y - middle[1]) - np.sin(a) * (x - middle[2]) + middle[1], np.sin(a) * (y - middle[1]) + np.cos(a) * (x - middle[2]) + middle[2]]))
        if (z, *b.tolist()) in old:
            want[z, y, x] = old[(z, *b.tolist())]
    assert {(r.z, r.y, r.x): r.v for r in augment.twist(frame, dims, 50.0).collect()} == want


def test_places_among_masks(spark):
    rng = np.random.default_rng(10)
    masks = {(d, *map(int, p)) for d in "uv" for p in rng.integers(0, 12, (80, 3))}
    frame = spark.createDataFrame([(*m, 1.0) for m in masks] + [("u", 5, 5, 5, 0.0), ("w", 0, 0, 0, 1.0)], "dataset string, z int, y int, x int, v double")
    ranges = {"u": ((0, 0, 0), (12, 12, 12)), "v": ((3, 3, 3), (8, 8, 9)), "w": ((1, 1, 1), (2, 2, 2))}
    known = spark.createDataFrame([(d, list(lo), list(hi)) for d, (lo, hi) in ranges.items()], "dataset string, lo array<int>, hi array<int>")
    want = set()
    for d, (lo, hi) in ranges.items():
        valid = [m for m in masks if m[0] == d and all(a <= p < b for a, p, b in zip(lo, m[1:], hi))]
        valid.sort(key=lambda m: hashlib.md5(":".join(map(str, (4, *m))).encode()).hexdigest())
        want |= {(d, k + 1, *m[1:]) for k, m in enumerate(valid[:15])}
    assert {tuple(r) for r in augment.mask_places(frame, known, 15, 4).collect()} == want


def test_parts_of_the_volume_follow_its_splits(spark):
    from common import DATA

    from voxmere.plans import projections as P

    splits = P.table(spark, f"{DATA}/sf0.01", "lineitem").rdd.getNumPartitions()
    held = P.voxels(spark, f"{DATA}/sf0.01").rdd.glom().map(len).collect()
    assert len(held) == 8 * splits and max(held) < 2 * sum(held) / len(held)


def cloud(spark, n=4000):
    """Voxels of two volumes, some below zero in place, with random values."""
    rng = np.random.default_rng(5)
    places = {(str(v), int(z), int(y), int(x)) for v, z, y, x in zip(rng.integers(0, 2, n), rng.integers(-9, 30, n), rng.integers(-40, 60, n), rng.integers(-70, 99, n))}
    rows = {p: float(rng.integers(0, 16)) / 15 for p in sorted(places)}
    return rows, spark.createDataFrame([(*p, v) for p, v in rows.items()], VOXEL)


def plan(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_largest_value_around_points(spark):
    rows, voxels = cloud(spark)
    rng, radius = np.random.default_rng(6), (2, 3, 5)
    points = [("01"[k % 2], int(z), int(y), int(x), k) for k, (z, y, x) in enumerate(zip(rng.integers(-12, 33, 300), rng.integers(-45, 65, 300), rng.integers(-80, 110, 300)))]
    found = dense.largest_around(spark.createDataFrame(points, "volume_id string, z int, y int, x int, k long"), voxels, radius, "top")
    inside = lambda p, q: p[0] == q[0] and all(abs(a - b) <= r for a, b, r in zip(p[1:4], q[1:4], radius))
    want = {p[4]: max((v for q, v in rows.items() if inside(p, q)), default=None) for p in points}
    assert {r.k: r.top for r in found.collect()} == want
    assert None in want.values() and len(set(want.values())) > 3


def test_labels_are_made_once_and_measured_without_pairs(spark):
    _, voxels = cloud(spark)
    labelled = components.label(voxels.where("v > 0.5"), 200, 1000)
    assert "Join" not in plan(labelled) and "Aggregate" not in plan(labelled)
    assert "CoGroup" in plan(components.measures(labelled)) and "CoGroup" not in plan(components.measures(labelled, intensity=False))
    with_, without = components.measures(labelled, volume=voxels), components.measures(labelled, intensity=False)
    assert sorted(with_.drop("intensity").collect()) == sorted(without.select(*with_.drop("intensity").columns).collect())


@pytest.mark.parametrize("neighbours,same_value,side,at_once", [(6, False, 64, 1 << 18), (18, False, 5, 40), (26, True, 3, 1), (26, False, 16, 500)])
def test_labels_of_blocks_are_those_of_the_whole(spark, monkeypatch, neighbours, same_value, side, at_once):
    rows, voxels = cloud(spark)
    rows = {k: v for k, v in rows.items() if k[1] < 6 and k[2] < 0}
    rows |= {("0", 40, y, x): 1.0 for y in range(20) for x in range(20)}
    voxels = spark.createDataFrame([(*p, v) for p, v in rows.items()], VOXEL)
    given = []
    monkeypatch.setattr(components, "connected_components", lambda links, *a: given.append(links.count()) or graph.connected_components(links, *a))
    monkeypatch.setattr(components, "SIDE", side, raising=False)
    monkeypatch.setattr(components, "AT_ONCE", at_once, raising=False)
    got = {tuple(r)[:4]: r.label for r in components.label(voxels, 200, 1000, neighbours, same_value).collect()}
    steps = [o for o in itertools.product((-1, 0, 1), repeat=3) if 0 < sum(map(abs, o)) <= {6: 1, 18: 2, 26: 3}[neighbours]]
    want = {}
    for p in sorted(rows, key=lambda p: p[1:]):
        if p not in want:
            want[p], todo = (p[1] * 200 + p[2]) * 1000 + p[3], [p]
            while todo:
                n, z, y, x = todo.pop()
                for dz, dy, dx in steps:
                    q = (n, z + dz, y + dy, x + dx)
                    if q in rows and q not in want and (not same_value or rows[q] == rows[n, z, y, x]):
                        want[q] = want[p]
                        todo.append(q)
    assert got == want and len(set(want.values())) < len(want)
    assert side < 16 or given[0] < len(rows) / 2  # links are of shared planes only


def test_measures_move_each_voxel_once(spark):
    rows, voxels = cloud(spark, 3000)
    labelled = components.label(voxels, 200, 1000)
    got = components.measures(labelled, intensity=False)
    assert "explode" not in plan(got) and "Join" not in plan(got)
    of = {}
    for r in labelled.collect():
        of.setdefault((r.volume_id, r.label), set()).add((r.z, r.y, r.x))
    for r in got.collect():
        own = of.pop((r.volume_id, r.label))
        out = {z: sum((z, y + dy, x + dx) not in own for k, y, x in own if k == z for dy, dx in ((0, 1), (0, -1), (1, 0), (-1, 0))) for z in {p[0] for p in own}}
        assert (r.no_voxels, r.z_depth, r.max_perimeter) == (len(own), len(out), max(out.values()))
        assert (r.z, r.y, r.x) == tuple(int(sum(p[k] for p in own) / len(own)) for k in range(3))
        assert r.sphericity == pytest.approx(np.mean([4 * np.pi * sum(p[0] == z for p in own) / n**2 for z, n in out.items()]))
    assert not of


def test_boxes_of_training_labels_are_formed_once(spark):
    rows, voxels = cloud(spark, 1500)
    points = spark.createDataFrame([(p[0], k, *p[1:]) for k, p in enumerate(sorted(rows)[::7])], "volume_id string, idx long, z int, y int, x int")
    got = components.training_labels(points, voxels, (4, 9, 9), 8, 0.1, 0.9)
    near = components.in_box(points, voxels, (4, 9, 9), "idx")
    bins = raster.otsu(near, 8, 0.1, 0.9, "volume_id", "idx")
    want = near.join(bins, ["volume_id", "idx"]).where(F.col("v") >= 0.1 + (F.col("bin") + 1) * ((0.9 - 0.1) / 8)).select("volume_id", "z", "y", "x").distinct()
    assert sorted(map(tuple, got.drop("v").collect())) == sorted(map(tuple, want.collect())) and got.count() > 50
    assert plan(got).count("explode(") == 3


@pytest.mark.parametrize("kind,factor", [("int", 1.0), ("double", 1.25)])
def test_training_labels_form_no_pair(spark, kind, factor):
    rows, voxels = cloud(spark, 1500)
    voxels = voxels.union(spark.createDataFrame([("0", 0, 200, k, v) for k, v in enumerate([None, float("nan"), 0.2, 0.7, 0.5])] + [("1", 0, 200, 0, 0.3)], VOXEL))
    off = 0.5 if kind == "double" else 0
    points = [(p[0], k, *(c + off for c in p[1:])) for k, p in enumerate(sorted(rows)[::7])] + [("0", 998, off, 200 + off, 2 + off), ("1", 999, off, 200 + off, off)]
    points = spark.createDataFrame(points, f"volume_id string, idx long, z {kind}, y {kind}, x {kind}")
    got = components.training_labels(points, voxels, (4, 9, 9), 8, 0.1, 0.9, factor)
    near = components.in_box(points, voxels, (4, 9, 9), "idx")
    bins = raster.otsu(near, 8, 0.1, 0.9, "volume_id", "idx")
    want = near.join(bins, ["volume_id", "idx"]).where(F.col("v") >= (0.1 + (F.col("bin") + 1) * ((0.9 - 0.1) / 8)) / factor).select("volume_id", "z", "y", "x").distinct()
    assert sorted(map(tuple, got.drop("v").collect())) == sorted(map(tuple, want.collect())) and got.count() > 50
    assert "Join" not in plan(got) and "Window" not in plan(got)


def test_blocks_are_not_many_small_ones():
    for radius in ((0, 2, 2), (1, 1, 1), (0, 0, 1)):
        edge = dense.edges(radius)
        assert dense.USUAL <= np.prod([e + 2 * r for e, r in zip(edge, radius)]) < 4 * dense.USUAL


def test_sections_in_parts_with_their_aggregates(spark):
    rows, voxels = cloud(spark)
    most = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        got = inference.per_section(voxels, lambda pdf: pdf.assign(v=pdf["v"] - pdf["mean"] + 1000 * (len(pdf) > 10)), {"mean": F.avg("v")}).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
    mean = {k: np.mean([v for p, v in rows.items() if p[:2] == k]) for k in {p[:2] for p in rows}}
    assert {tuple(r)[:4]: r.v for r in got} == pytest.approx({p: v - mean[p[:2]] for p, v in rows.items()})
