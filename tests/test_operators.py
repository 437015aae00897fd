"""Goldens, brute force on small inputs, and properties."""


import random
import struct
import zipfile

import numpy as np
import pytest

from voxmere.functions import geometry, maths
from voxmere.operators import augment, cohort, components, matching, ontology, raster, windows
from voxmere.plans import projections as P
from voxmere.sources import arrays, catalog, exchange
from voxmere.streaming import monitors

SF = "/root/testdata/sf0.001"


def test_patch_grid(spark):
    rows = windows.patch_grid(spark, (5, 4, 3), (2, 2, 2)).orderBy("patch_id").collect()
    assert len(rows) == 12
    assert [(r.z0, r.y0, r.x0) for r in rows[:4]] == [(0, 0, 0), (0, 0, 2), (0, 2, 0), (0, 2, 2)]


def test_scan_starts():
    assert windows.scan_starts(10, 4, 0.75) == [2, 5, 8]
    assert windows.scan_starts(10, 4, 0) == [2, 6, 8]
    assert windows.scan_starts(60, 20, 0.75) == [10, 25, 40, 50]
    assert windows.scan_starts(20, 20, 0.75) == [10]


def test_bump_logits(spark):
    from pyspark.sql import functions as F

    got = [r[0] for r in spark.range(3).select(windows.bump_logit(F.col("id"), 3)).collect()]
    assert got == pytest.approx([-12.316806, -8, -12.316806], abs=1e-6)


def test_effect_size(spark):
    a, b = [9, 7, 8, 9, 8, 9, 9, 10, 9, 9], [9, 6, 7, 8, 7, 9, 8, 8, 8, 7]
    df = spark.createDataFrame([("a", float(v)) for v in a] + [("b", float(v)) for v in b], "g string, v double")
    assert cohort.effect_size(df, "g", "v", "a", "b").first()[0] == pytest.approx(1.1258799375612014)


@pytest.mark.parametrize("spec,point,dims", [(("2", "1", "0"), (3, 2, 1), (30, 20, 10)), (("-2", "1", "0"), (3, 2, 8), (30, 20, 10)), (("0", "-1", "2"), (1, 17, 3), (10, 20, 30)), (("2", "0", "1"), (2, 3, 1), (20, 30, 10))])
def test_reorient(spark, spec, point, dims):
    got = geometry.reorient(spark.createDataFrame([(1, 2, 3)], "z int, y int, x int"), (10, 20, 30), spec).first()
    assert (got.z, got.y, got.x) == point
    assert geometry.reoriented_dims((10, 20, 30), spec) == dims


def test_lookup_truncates(spark):
    from voxmere.operators import atlas

    points = spark.createDataFrame([(1, 2.7, 0.0, 0.0), (2, -0.5, 0.0, 0.0), (3, -1.5, 0.0, 0.0)], "point_id int, z double, y double, x double")
    annotation = spark.createDataFrame([(2, 0, 0, 7), (0, 0, 0, 8), (9, 0, 0, 9)], "z int, y int, x int, id long")
    assert {r.point_id: r.id for r in atlas.lookup(points, annotation).collect()} == {1: 7, 2: 8}
    assert {r.point_id: r.id for r in atlas.lookup(points, annotation, (10, 1, 1), wrap_negative=True).collect()} == {1: 7, 2: 8, 3: 9}


def _greedy(t, p, cutoff):
    pairs = sorted((float(np.linalg.norm(np.subtract(a, b))), i, j) for i, a in enumerate(t) for j, b in enumerate(p))
    seen_t, seen_p, out = set(), set(), []
    for d, i, j in pairs:
        if d <= cutoff and i not in seen_t and j not in seen_p:
            seen_t.add(i), seen_p.add(j), out.append((i, j))
    return sorted(out)


def _frame(spark, pts):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "idx long, z double, y double, x double")


def test_greedy_golden_and_random(spark):
    t, p = [(0, 0, 0), (0, 0, 4), (0, 9, 0)], [(0, 0, 1), (0, 0, 3), (0, 0, 5)]
    stats = matching.sweep(_frame(spark, t), _frame(spark, p), [3.0]).first()
    assert (stats.tp, stats.fp, stats.fn) == (2, 1, 1)
    rng = random.Random(5)
    t, p = ([tuple(rng.randrange(6) for _ in range(3)) for _ in range(40)] for _ in range(2))
    got = matching.greedy(matching.distance_join(_frame(spark, t), _frame(spark, p), 2.0)).collect()
    assert sorted((r.truth_idx, r.pred_idx) for r in got) == _greedy(t, p, 2.0)
    got = matching.nearest_pairs(_frame(spark, t[:12]), _frame(spark, p[:9]), 1.0).collect()
    assert sorted((r.truth_idx, r.pred_idx) for r in got) == _greedy(t[:12], p[:9], 1e9)


def test_distance_join_plans_no_nested_loop(spark):
    t, p = _frame(spark, [(0, 0, 0)]), _frame(spark, [(0, 0, 1)])
    plan = matching.distance_join(t, p, 2.0)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_distance_join_broadcasts_no_side_and_keeps_every_pair(spark):
    rng = random.Random(8)
    t, p = ([tuple(rng.choice((rng.uniform(-9, 9), rng.randrange(-9, 9) * 0.7)) for _ in range(3)) for _ in range(150)] for _ in range(2))
    pairs = matching.distance_join(_frame(spark, t), _frame(spark, p), 2.1)
    assert "BroadcastHashJoin" not in pairs._jdf.queryExecution().executedPlan().toString()
    want = sorted((i, j) for i, a in enumerate(t) for j, b in enumerate(p) if sum((x - y) * (x - y) for x, y in zip(a, b)) ** 0.5 <= 2.1)
    assert sorted((r.truth_idx, r.pred_idx) for r in pairs.collect()) == want


@pytest.mark.parametrize("n,expected", [(6, 4), (18, 1), (26, 1)])
def test_component_neighbours(spark, n, expected):
    v = spark.createDataFrame([("a", *c, 1.0) for c in ((0, 0, 0), (0, 1, 1), (1, 2, 1), (2, 2, 2))], "volume_id string, z int, y int, x int, v double")
    assert components.label(v, 10, 10, n).select("label").distinct().count() == expected


def test_components_long_chain(spark):
    v = spark.createDataFrame([("a", 0, 0, x, 1.0) for x in range(300)], "volume_id string, z int, y int, x int, v double")
    assert [r.label for r in components.label(v, 1, 1000, 6).select("label").distinct().collect()] == [0]


def test_halo_does_not_change_objects(spark):
    v = components.at_least(P.voxels(spark, SF), 0.85)
    whole = components.centres(components.label(v, 40, 100_000)).select("z", "y", "x", "no_voxels")
    for depth in (10, 25):
        chunked = components.halo_chunks(v, depth, 12).withColumn("volume_id", __import__("pyspark.sql.functions", fromlist=["f"]).col("chunk").cast("string"))
        found = components.centres(components.label(chunked, 40, 100_000))
        found = components.owned(found.withColumn("chunk", found["volume_id"].cast("int")), depth).select("z", "y", "x", "no_voxels")
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, whole.collect()))


def test_rollup_of_root_is_all_mass(spark):
    closed = ontology.closure(P.structures(spark, SF))
    total = ontology.rollup(P.masses(spark, SF), closed).where("id = 0").first().total
    assert total == P.table(spark, SF, "lineitem").count()


def test_resample_against_dense(spark):
    rng = np.random.default_rng(3)
    a = rng.random((6, 7, 5))
    v = spark.createDataFrame([(int(z), int(y), int(x), float(a[z, y, x])) for z, y, x in np.ndindex(a.shape)], "z int, y int, x int, v double")
    for axis, n in ((0, 9), (1, 4), (2, 11)):
        o = a.shape[axis]
        at = np.clip((np.arange(n) + 0.5) * o / n - 0.5, 0, o - 1)
        lo = np.minimum(at.astype(int), o - 1)
        hi, w = np.minimum(lo + 1, o - 1), at - lo
        shape = [1, 1, 1]
        shape[axis] = n
        a = np.take(a, lo, axis) * (1 - w.reshape(shape)) + np.take(a, hi, axis) * w.reshape(shape)
    got = np.zeros(a.shape)
    for r in raster.resample(v, (6, 7, 5), (9, 4, 11)).collect():
        got[r.z, r.y, r.x] = r.v
    assert np.allclose(got, a)


def test_gaussian_keeps_mass(spark):
    v = spark.createDataFrame([(5, 5, 5, 2.0)], "z int, y int, x int, v double")
    out = raster.gaussian_filter(v, (1.0, 1.0, 0.5)).collect()
    assert sum(r.v for r in out) == pytest.approx(2.0)


def test_polygons(spark):
    from pyspark.sql import functions as F

    square = F.array(*(F.struct(F.lit(float(y)).alias("y"), F.lit(float(x)).alias("x")) for y, x in ((0, 0), (0, 4), (3, 4), (3, 0))))
    r = spark.range(1).select(maths.polygon_area(square).alias("a"), maths.polygon_perimeter(square).alias("p"), maths.mean_radius(F.lit(1.5), F.lit(2.0), square).alias("m")).first()
    assert (r.a, r.p, r.m) == (12, 14, 2.5)


def test_augmentations(spark):
    v = P.voxels(spark, SF).where("z < 6 and x < 12").select("z", "y", "x", "v")
    dims = (6, 40, 12)
    same = augment.flip(augment.flip(v, dims, "zx"), dims, "zx")
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, v.collect()))
    identity = augment.warp(v, dims, [[1, 0, 0], [0, 1, 0], [0, 0, 1]])
    assert sorted(map(tuple, identity.collect())) == sorted(map(tuple, v.collect()))
    assert augment.blur_sections(v, dims, [2], 1.0).where("z <> 2").count() == v.where("z <> 2").count()
    parts = augment.split(P.table(spark, SF, "orders"), "o_orderkey", {"train": 0.7, "val": 0.2, "test": 0.1}).groupBy("part").count().collect()
    assert {r.part for r in parts} == {"train", "val", "test"}
    sets = spark.createDataFrame([("a", 1.0, [0, 0, 0], [5, 5, 5]), ("b", 3.0, [2, 2, 2], [4, 4, 4])], "dataset string, weight double, lo array<int>, hi array<int>")
    drawn = augment.sample_places(sets, 2000, 1)
    assert 0.7 < drawn.where("dataset = 'b'").count() / 2000 < 0.8
    assert drawn.where("dataset = 'b' and (z < 2 or z > 3)").isEmpty()


def test_merge_planes(spark):
    cells = spark.createDataFrame([("v", 1, 0, 10.0, 10.0), ("v", 2, 1, 12.0, 11.0), ("v", 3, 2, 14.0, 9.0), ("v", 4, 1, 40.0, 40.0)], "volume_id string, cell_id long, z int, y double, x double")
    assert {r.cell_id: r.object_id for r in components.merge_planes(cells, 5).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_npy_blocks_and_stack(spark, tmp_path):
    a = (np.random.default_rng(0).random((4, 6, 5)) > 0.6).astype(np.float32) * 3
    np.save(tmp_path / "a.npy", a), np.save(tmp_path / "b.npy", a)
    shapes = arrays.npy_shapes(spark, str(tmp_path))
    assert sorted(map(list, (r["shape"] for r in shapes.collect()))) == [[4, 6, 5]] * 2
    v = arrays.stacked(arrays.npy_voxels(spark, str(tmp_path)), shapes)
    assert v.count() == 2 * np.count_nonzero(a) and v.agg({"z": "max"}).first()[0] == 7
    from pyspark.sql import functions as F

    volume = v.withColumn("volume_id", F.lit("v")).select("volume_id", "z", "y", "x", "v")
    back = arrays.from_blocks(arrays.to_blocks(volume, (3, 4, 2)))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, volume.collect()))


def _roi(points, kind=7):
    ys, xs = [p[0] for p in points], [p[1] for p in points]
    head = bytearray(64)
    head[:4], head[6] = b"Iout", kind
    struct.pack_into(">4hH", head, 8, min(ys), min(xs), max(ys), max(xs), len(points))
    return bytes(head) + b"".join(struct.pack(">h", x - min(xs)) for x in xs) + b"".join(struct.pack(">h", y - min(ys)) for y in ys)


def test_rois(spark, tmp_path):
    pts = [(3, 4), (8, 4), (8, 9)]
    with zipfile.ZipFile(tmp_path / "set.zip", "w") as z:
        z.writestr("0012-0003-0004.roi", _roi(pts))
    (tmp_path / "7-1-1.roi").write_bytes(_roi(pts, 0))
    got = {r.name: (r.kind, r.z, [(p.y, p.x) for p in r.pts]) for r in arrays.rois(spark, str(tmp_path)).collect()}
    assert got == {"0012-0003-0004.roi": ("freehand", 12, [tuple(map(float, p)) for p in pts]), "7-1-1.roi": ("polygon", 7, [tuple(map(float, p)) for p in pts])}
    with pytest.raises(ValueError):
        arrays.decode_roi(_roi(pts, 3))


def test_point_text_round_trip(spark, tmp_path):
    points = spark.createDataFrame([(0, 1.5, 2.0, 3.0), (1, 4.0, 5.0, 6.0)], "point_id long, z double, y double, x double")
    exchange.write_points(points, str(tmp_path / "p"))
    assert [r.value for r in spark.read.text(str(tmp_path / "p")).collect()] == ["index", "2", "3.0 2.0 1.5", "6.0 5.0 4.0"]
    lines = spark.createDataFrame([("Point\t0\t; InputPoint = [ 3 2 1 ]\t; OutputPoint = [ 3.5 2.5 1.5 ]\t; Deformation = [ 0 0 0 ]",)], "value string")
    r = exchange.read_transformed(lines).first()
    assert (r.point_id, r.z, r.y, r.x) == (0, 1.5, 2.5, 3.5)


def test_hierarchy_json(spark, tmp_path):
    text = '{"msg": [{"id": 1, "name": "root", "acronym": "r", "parent_structure_id": null, "children": [{"id": 2, "name": "a", "acronym": "a", "parent_structure_id": 1, "children": [{"id": 3, "name": "b", "acronym": "b", "parent_structure_id": 2, "children": []}]}]}]}'
    (tmp_path / "o.json").write_text(text)
    rows = exchange.hierarchy(spark, str(tmp_path / "o.json"))
    assert sorted((r.id, r.parent_structure_id) for r in rows.collect()) == [(1, None), (2, 1), (3, 2)]
    assert {r.id: r.parent_name for r in ontology.with_parents(rows).collect()} == {1: None, 2: "root", 3: "a"}
    assert {r.id: r.chain for r in ontology.chains(rows, ontology.closure(rows)).collect()} == {2: [], 3: ["a"]}


def test_step0_report(spark):
    names = [(f"/d/r_[{y:02d} x {x:02d}]_C{ls:02d}_xyz-Table Z{z:04d}_UltraII Filter0000.ome.tif",) for z in range(25) for y in range(3) for x in range(3) for ls in range(2)]
    parsed = catalog.parsed(spark.createDataFrame(names, "path string"))
    g = catalog.geometry(parsed).first()
    assert (g.planes, g.channels, g.xtile, g.ytile, g.lightsheets) == (25, 1, 3, 3, 2)
    assert catalog.bad_planes(parsed).isEmpty()
    assert catalog.bad_planes(parsed.where("not (z = 4 and x = 1 and ls = 0)")).count() == 1


def test_trees_and_listing(spark, tmp_path):
    for side, extra in (("a", "1"), ("b", "2")):
        (tmp_path / side).mkdir()
        (tmp_path / side / "same.txt").write_text("s")
        (tmp_path / side / "own.txt").write_text(extra)
        (tmp_path / side / ".hidden").write_text("h")
    assert catalog.files(spark, str(tmp_path / "a")).count() == 2
    d = catalog.tree_differences(catalog.digested(spark, str(tmp_path / "a")), catalog.digested(spark, str(tmp_path / "b")))
    assert sorted((r.path, r.side) for r in d.collect()) == [("own.txt", "left"), ("own.txt", "right")]


def test_edges_outlines_and_filling(spark):
    from pyspark.sql import functions as F

    from voxmere.operators import edges, ridges

    block = [("a", 1, y, x, 1.0) for y in range(4, 9) for x in range(3, 10)]
    v = spark.createDataFrame(block, "volume_id string, z int, y int, x int, v double")
    c = edges.contours(components.label(v, 20, 20)).first()
    assert (c.area, c.perimeter) == (24.0, 20.0) and len(c.pts) == 4
    found = edges.contours(components.label(v, 20, 20))
    assert edges.largest_contour(found, 20).count() == 1 and edges.largest_contour(found, 25).count() == 0
    inside = edges.filled(found.select("z", F.transform("pts", lambda p: F.struct((p["y"] + 0.5).alias("y"), (p["x"] - 0.5).alias("x"))).alias("pts")))
    assert {(r.y, r.x) for r in inside.collect()} == {(y, x) for y in range(5, 9) for x in range(3, 9)}
    rim = {(r.y, r.x) for r in ridges.gradient_edges(v, 20, 20, 1.0, 2.0).collect()}
    assert rim and all(3 <= y <= 9 and 2 <= x <= 10 for y, x in rim) and (6, 6) not in rim


def test_inference_round_trip(spark):
    from voxmere.operators import inference

    v = P.voxels(spark, SF).where("z < 10 and x < 20").select("z", "y", "x", "v")
    shape, stride, window = (10, 40, 20), (5, 20, 10), (7, 24, 12)
    patches = inference.dense_patches(v, shape, stride, window)
    out = windows.bump_blended(inference.infer(patches, window, lambda a: a * 2), window)
    got, want = ({(r.z, r.y, r.x): r.v for r in d.collect()} for d in (out, v))
    want = {k: 2 * x for k, x in want.items() if x}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)
    r = inference.mapped(spark.createDataFrame([("1",), ("x",)], "item string"), lambda s: str(int(s) + 1)).orderBy("item").collect()
    assert r[0].result == "2" and "ValueError" in r[1].error


def test_tiff(spark, tmp_path):
    from voxmere.sources import tiff

    a = np.random.default_rng(1).integers(0, 60000, (5, 7)).astype("<u2")
    entries = [(256, 4, 1, 7), (257, 4, 1, 5), (258, 3, 1, 16), (259, 3, 1, 1), (273, 4, 1, 8), (277, 3, 1, 1), (279, 4, 1, a.nbytes)]
    body = b"II" + struct.pack("<HI", 42, 8 + a.nbytes) + a.tobytes() + struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) for e in entries) + struct.pack("<I", 0)
    (tmp_path / "p.tif").write_bytes(body)
    got = {(r.y, r.x): r.v for r in tiff.tiff_voxels(spark, str(tmp_path)).collect()}
    assert got == {(y, x): float(a[y, x]) for y, x in np.ndindex(a.shape) if a[y, x]}


def test_cell_pipeline(spark):
    from voxmere.plans import pipelines

    cells = pipelines.detect_cells(P.voxels(spark, SF), 40, 100_000, 0.85, size=(1, 100))
    assert cells.count() > 100 and cells.where("no_voxels < 1 or sphericity > 1 or intensity < 0.85").isEmpty()
    nodes, links = pipelines.network(P.structures(spark, SF), pipelines.structure_totals(P.brain_masses(spark, SF), P.structures(spark, SF)))
    assert nodes.count() == links.count() + 1


def test_volumes_stay_apart(spark):
    """Every kernel gives for two volumes together what it gives for each alone."""
    from pyspark.sql import functions as F

    from voxmere.operators import inference, ridges

    rng = random.Random(3)
    rows = [(n, z, y, x, rng.random()) for n in "ab" for z in range(3) for y in range(6) for x in range(6) if rng.random() < 0.6]
    both = spark.createDataFrame(rows, "volume_id string, z int, y int, x int, v double").cache()
    dims = (3, 6, 6)
    tiles = lambda d: d.withColumn("x_tile", (F.col("x") / 3).cast("int")).withColumn("x", F.col("x") % 3)
    patched = lambda d: windows.patches(d, dims, (2, 3, 3), (3, 4, 4))
    kernels = [
        raster.project, raster.scaled, lambda d: raster.box_filter(d, (1, 1, 1)), lambda d: raster.median_filter(d, (0, 1, 1)), lambda d: raster.gaussian_filter(d, (0.5, 0.5, 0.5), dims=dims),
        lambda d: raster.dilate(d, (0, 1, 1), dims), lambda d: raster.erode(d, (0, 0, 1)), lambda d: raster.closed(d, (0, 1, 1)), lambda d: raster.stamp(d, raster.ball(1), dims), lambda d: raster.stitch(tiles(d), 3, 1),
        lambda d: raster.blend_sheets(d, d.withColumn("v", F.col("v") * 0.5), 6), lambda d: raster.block_mean(d, (2, 2, 2)), lambda d: raster.resample(d, dims, (2, 9, 5)),
        lambda d: windows.merged_by_max(patched(d), dims), lambda d: windows.blended(patched(d)), lambda d: windows.bump_blended(patched(d), (3, 4, 4)), lambda d: windows.overwritten(patched(d), "patch_id"), lambda d: windows.set_patch(d, d.where("x < 2"), "sum"),
        lambda d: ridges.gradient_edges(d, 6, 6, 0.1, 0.2), lambda d: augment.warp(d, dims, [[1, 0, 0], [0, 0.8, 0], [0, 0, 1]]), lambda d: augment.blur_sections(d, dims, [1], 0.7), lambda d: inference.infer(inference.dense_patches(d, dims, (2, 3, 3), (3, 4, 4)), (3, 4, 4), lambda a: a * 2),
    ]
    for k, kernel in enumerate(kernels):
        found = kernel(both)
        rows_of = lambda d: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in d.select(*found.columns).collect())
        for n in "ab":
            assert rows_of(found.where(F.col("volume_id") == n)) == rows_of(kernel(both.where(F.col("volume_id") == n))), (k, n)
        if {"z", "y", "x"} <= set(found.columns) and k not in (9, 12):
            assert found.where("z < 0 or y < 0 or x < 0 or z > 2 or y > 5 or x > 5").isEmpty(), k


def test_outlines_of_pieces_and_branches(spark):
    from voxmere.operators import edges

    squares = [("a", 7, 1, y, x) for y in range(4) for x in range(4)] + [("a", 7, 1, y, x) for y in range(10, 14) for x in range(10)]
    found = edges.contours(spark.createDataFrame(squares, "volume_id string, label long, z int, y int, x int")).orderBy("piece").collect()
    assert [(r.area, r.perimeter) for r in found] == [(9.0, 12.0), (27.0, 24.0)]
    branch = {(0, 3), (1, 2), (2, 1), (1, 4), (2, 5), (2, 6)}
    assert {(2, 1), (2, 6), (0, 3)} <= set(edges.outline(branch))
    rng = random.Random(1)
    for _ in range(200):
        pixels = {(rng.randrange(6), rng.randrange(6)) for _ in range(rng.randrange(1, 20))}
        pieces = edges.pieces_of(pixels)
        assert set().union(*pieces) == pixels and sum(map(len, pieces)) == len(pixels)
        for piece in pieces:
            path = edges.outline(piece)
            # the outline reaches as far as the piece on each side, and stays in it
            assert set(path) <= piece
            for axis in (0, 1):
                assert (min(p[axis] for p in path), max(p[axis] for p in path)) == (min(p[axis] for p in piece), max(p[axis] for p in piece))


@pytest.mark.parametrize("side, near", [(None, 1 << 18), (1.5, 1 << 18), (2.0, 40)])
def test_matching_of_copies_takes_few_rounds(spark, monkeypatch, side, near):
    rng = random.Random(7)
    places = [tuple(rng.randrange(4) for _ in range(3)) for _ in range(12)]
    t, p = ([rng.choice(places) for _ in range(k)] for k in (150, 140))
    tables, dealt = [], matching._dealt
    for name in ("cut", "written"):
        monkeypatch.setattr(matching, name, lambda df, old=getattr(matching, name): tables.append(name) or old(df))
    monkeypatch.setattr(matching, "NEAR", near)
    monkeypatch.setattr(matching, "_dealt", lambda links, a, b, s, *by: dealt(links, a, b, side or s, *by))
    got = matching.matched(_frame(spark, t), _frame(spark, p), 1.5).collect()
    assert sorted((r.truth_idx, r.pred_idx) for r in got) == _greedy(t, p, 1.5)
    assert len(tables) < 20  # greedy writes two tables a round and takes one pair of a place in each
    if side is None:
        del tables[:]
        assert matching.sweep(_frame(spark, t), _frame(spark, p), [1.5]).first().tp == len(got) and len(tables) == 5


def test_only_what_has_no_partner_in_its_place_is_joined(spark, monkeypatch):
    rng = random.Random(9)
    places = [tuple(rng.randrange(5) for _ in range(3)) for _ in range(30)]
    t, p = ([rng.choice(places) for _ in range(k)] for k in (300, 280))
    asked, dealt = [], matching._dealt
    monkeypatch.setattr(matching, "_dealt", lambda links, a, b, *rest: asked.append((a.count(), b.count())) or dealt(links, a, b, *rest))
    got = {r.cutoff: r.tp for r in matching.sweep(_frame(spark, t), _frame(spark, p), [0.5, 1.0, 1.5]).collect()}
    assert got == {c: len(_greedy(t, p, c)) for c in (0.5, 1.0, 1.5)}
    assert asked == [(300 - got[0.5], 280 - got[0.5])]  # all points were, once for each cutoff


@pytest.mark.parametrize("near", [1 << 20, 3])
def test_odd_places_match_as_the_pairs_of_the_distance_join(spark, monkeypatch, near):
    monkeypatch.setattr(matching, "NEAR", near)
    nan, inf = float("nan"), float("inf")
    t = [(1, "a", 0.0, 0.0, 0.0), (1, "b", -0.0, 0.0, 0.0), (1, "c", 1e-200, 0.0, 0.0), (1, "d", 5.0, 5.0, 5.0), (1, "d", 7.0, 5.0, 5.0), (1, "e", 7.0, 5.0, 5.0), (1, "f", nan, 0.0, 0.0), (1, "g", inf, 0.0, 0.0)]
    t += [(None, "a", 1.0, 1.0, 1.0), (1, None, 3.0, 3.0, 3.0), (2, "a", 3.0, 3.0, 3.0), (2, "b", 3.0, 3.0, 3.0), (2, "c", None, 3.0, 3.0), (2, "d", 3.0, 3.0, 4.0), (2, "d", 3.0, 3.0, 4.0)]
    p = [(1, 9, 0.0, -0.0, 0.0), (1, 8, 1e-200, 1e-200, 0.0), (1, 7, 7.0, 5.0, 5.0), (1, 6, 5.0, 5.0, 5.5), (1, 5, nan, 0.0, 0.0), (1, 4, inf, 0.0, 0.0), (None, 1, 1.0, 1.0, 1.0), (2, 1, 3.0, 3.0, 3.0), (2, 2, 3.0, 3.0, 4.0), (2, 3, 3.0, 3.0, 4.5)]
    t = spark.createDataFrame(t, "day int, idx string, z double, y double, x double")
    p = spark.createDataFrame(p, "day int, idx long, z double, y double, x double")
    near_all = [df.where("abs(z) < 1e300") for df in (t, p)]
    pairs = matching.distance_join(*near_all, 1.0, "day").where("truth_idx is not null").groupBy("day", "truth_idx", "pred_idx").agg({"dist": "min"}).withColumnRenamed("min(dist)", "dist").orderBy("day", "dist", "truth_idx", "pred_idx").collect()
    taken, want = set(), []
    for r in pairs:
        if not {(r.day, r.truth_idx), (r.day, r.pred_idx)} & taken:
            taken |= {(r.day, r.truth_idx), (r.day, r.pred_idx)}
            want.append(tuple(r))
    assert len(want) == 5 and sorted(map(tuple, matching.matched(t, p, 1.0, "day").collect())) == sorted(want)


def test_points_of_several_places_match_by_the_nearest(spark):
    t = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (1, 0.0, 0.0, 9.0), (2, 0.0, 0.0, 0.0)], "idx long, z double, y double, x double")
    p = spark.createDataFrame([(5, 0.0, 0.0, 9.5), (6, 0.0, 1.0, 0.0)], t.schema)
    want = [(1, 5, 0.5), (2, 6, 1.0)]
    assert sorted(map(tuple, matching.matched(t, p, 2.0).collect())) == want == sorted(map(tuple, matching.greedy(matching.distance_join(t, p, 2.0)).collect()))


def test_unpaired_rows_are_found_without_a_broadcast(spark):
    t = spark.createDataFrame([(1, k, 0.0, 0.0, float(k)) for k in range(9)], "day int, idx long, z double, y double, x double")
    p = t.where("idx % 3 = 0").withColumn("idx", t["idx"] + 100)
    left = matching.unpaired(t, matching.matched(t, p, 0.5, "day"), "truth_idx", "day")
    assert "BroadcastHashJoin" not in left._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["idx"] for r in left.collect()) == [1, 2, 4, 5, 7, 8]


def test_greedy_says_when_it_is_not_done(spark):
    pairs = spark.createDataFrame([(i, i, float(i)) for i in range(3)] + [(0, 1, 0.5), (1, 2, 0.7)], "truth_idx long, pred_idx long, dist double")
    with pytest.raises(RuntimeError):
        matching.greedy(pairs, most_rounds=1)


def test_cell_table_round_trip(spark, tmp_path):
    cells = spark.createDataFrame([(1.0, 2.5, 3.0, "a"), (4.0, 5.0, 6.0, "b")], "z double, y double, x double, kind string")
    exchange.write_cells(cells, str(tmp_path / "cells"))
    assert sorted(map(tuple, exchange.read_cells(spark, str(tmp_path / "cells")).collect())) == sorted(map(tuple, cells.collect()))
    (tmp_path / "bare.csv").write_text("3,2,1\n6,5,4\nx,y,z\n")
    assert sorted((r.z, r.y, r.x) for r in exchange.read_cells(spark, str(tmp_path / "bare.csv"), ("x", "y", "z"), header=False).collect()) == [(1, 2, 3), (4, 5, 6)]


def test_random_points_are_drawn_again(spark):
    a, b = (augment.random_points(spark, 500, (3, 40, 500), 9).collect() for _ in range(2))
    assert a == b and {r.z for r in a} == {0, 1, 2} and max(r.x for r in a) < 500


def test_copies_of_cells_are_linked_once_and_lose_no_neighbour(spark, monkeypatch):
    square = lambda y, x: [{"y": float(y + i), "x": float(x + j)} for i, j in ((-1, -1), (-1, 1), (1, 1), (1, -1))]
    at = [(1, 5, 5)] * 20 + [(2, 5, 6)] * 20 + [(2, 30, 30)] * 5
    rows = [("a", k, z, float(y), float(x), square(y, x)) for k, (z, y, x) in enumerate(at)] + [("a", 50, 3, 5.0, 7.0, square(5, 7)), ("a", 50, 3, 5.0, 7.0, square(30, 40))]
    cells = spark.createDataFrame(rows, "volume_id string, cell_id long, z int, y double, x double, pts array<struct<y:double,x:double>>")
    pairs = sorted((r.a, r.b) for r in components.overlapping(cells, 3).collect())
    assert pairs == sorted([(a, b) for a in range(20) for b in range(20, 40)] + [(a, 50) for a in range(20, 40)])
    seen, whole = [], components.connected_components
    monkeypatch.setattr(components, "connected_components", lambda links: seen.append(links.count()) or whole(links))
    for some in (cells, cells.where("cell_id < 50").drop("pts")):
        merged = {r.cell_id: r.object_id for r in components.merge_planes(some, 3).collect()}
        assert merged == {r.cell_id: 0 if r.cell_id < 40 or r.cell_id == 50 else r.cell_id for r in some.collect()}
    assert seen == [2, 1]


def test_pairs_of_rectangles_are_not_moved(spark):
    rng = random.Random(4)
    shapes = {"box": ((-1, -2), (-1, 2), (1, 2), (1, -2)), "wide": ((0, -3), (0, 3)), "point": ((0, 0),), "corner": ((-3, 0), (3, 0), (3, 3))}
    outline = lambda s, y, x: [{"y": float(y + i), "x": float(x + j)} for i, j in shapes[s]]
    rows = [("ab"[k % 2], k, rng.randrange(3), rng.randrange(-6, 6), rng.randrange(9) + rng.choice((0, 0.5)), rng.choice(sorted(shapes))) for k in range(300)]
    kind = "volume_id string, cell_id long, z int, y double, x double, pts array<struct<y:double,x:double>>"
    cells = lambda some: spark.createDataFrame([(n, k, z, float(y), float(x), outline(s, y, x)) for n, k, z, y, x, s in rows if s in some and ("corner" in some or x % 1 == 0)], kind)
    for some in (["box", "wide", "point"], sorted(shapes), ["corner"]):
        runs = components._runs(cells(some))
        want = components._meeting(runs, runs, 3).select("volume_id", "a", "b").distinct()
        got = components.overlapping(cells(some), 3)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 20
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "corner" in some or ("Aggregate" not in plan and plan.count("Join") == 1)


def test_outlines_within_others_of_their_centre_get_one_link(spark, monkeypatch):
    rng = random.Random(3)
    box = lambda y, x, h, w: [{"y": y + i * h, "x": x + j * w} for i, j in ((-1, -1), (-1, 1), (1, 1), (1, -1))]
    places, rows = [(rng.randrange(4), float(rng.randrange(16)), float(rng.randrange(16))) for _ in range(90)], []
    for k in range(400):
        z, y, x = rng.choice(places)
        rows.append(("a", k, z, y, x, box(y, x, float(rng.randrange(3)), float(rng.randrange(3)))))
    cells = spark.createDataFrame(rows, "volume_id string, cell_id long, z int, y double, x double, pts array<struct<y:double,x:double>>")
    for some in (cells, cells.where("cell_id % 7 = 0")):
        pairs, root = [(r.a, r.b) for r in components.overlapping(some, 3).collect()], {r.cell_id: r.cell_id for r in some.collect()}
        for _ in root:  # the smallest id reachable, by passing it on
            before = dict(root)
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
            if root == before:
                break
        seen, whole = [], components.connected_components
        with monkeypatch.context() as m:
            m.setattr(components, "connected_components", lambda links: seen.append(links.count()) or whole(links))
            assert {r.cell_id: r.object_id for r in components.merge_planes(some, 3).collect()} == root
        assert len(set(root.values())) > 1
        if some is cells:
            assert seen[0] * 2 < len(pairs)
