"""Queries of windows, components, matching, raster, geometry, catalog and augmentation operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxmere.functions import geometry as G
from voxmere.functions import maths, text
from voxmere.operators import augment, components, matching, raster, ridges, windows
from voxmere.operators.graph import checkpoint_dir
from voxmere.plans import projections as P
from voxmere.sources import catalog, exchange, volumes

_XDIM = "(select max(x) + 1 from voxels)"


def _voxels(s, d):
    return P.voxels(s, d)


def _dims(s, d):
    return 60, 40, P.table(s, d, "lineitem").agg(F.max(F.expr("l_orderkey div 100"))).first()[0] + 1


def _in_place(df):
    """Of the one volume."""
    return df.drop("volume_id")


def _labelled(s, d):
    return components.label(components.at_least(_voxels(s, d), 0.85), 40, 1_000_000)


def _r(df, *columns: str, digits: int = 6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _patches(s, d):
    return windows.patches(_voxels(s, d), _dims(s, d), (30, 20, 100), (40, 30, 120)).select("patch_id", "pz", "py", "px", "v")


def _back(s, d):
    """Patches' voxels at their places in the volume, each with its patch's own small error."""
    p = windows.patches(_voxels(s, d), _dims(s, d), (30, 20, 100), (40, 30, 120))
    return p.withColumn("v", F.col("v") + F.col("patch_id") % 7 / 10)


def _missing(s, d):
    found = catalog.parsed(P.tiles(s, d))
    return catalog.missing(found, found.agg(F.max("z")).first()[0] + 10, "z")


def _bump(s, d):
    return _in_place(_r(windows.bump_blended(_back(s, d), (40, 30, 120)), "v"))


def _pairs(s, d):
    t, p = P.annotators(s, d)
    return matching.distance_join(t, p, 1.5, "day")


def _match_stats(s, d):
    t, p = P.annotators(s, d)
    return matching.sweep(t, p, [1.0, 1.5], "day")


def _matched(s, d):
    t, p = P.annotators(s, d)
    return matching.matched(t, p, 1.5, "day").select("day", "truth_idx", "pred_idx", "dist")


def _boxes(s, d):
    rows = P.table(s, d, "part").selectExpr("p_partkey", "p_partkey % 50 as a", "p_size as b", "p_partkey % 7 + 1 as w")
    v = lambda *c: G.vec(*(F.col(x).cast("double") if isinstance(x, str) else x for x in c))
    one = G.box(v("a", "b", "w"), G.add(v("a", "b", "w"), v("w", "w", "w")))
    two = G.centred_box(G.vec(25.0, 25.0, 4.0), G.vec(21.0, 20.0, 5.0))
    both = G.intersect(one, two)
    return rows.select("p_partkey", G.volume_of(both).alias("shared"), G.volume_of(G.merge(one, two)).alias("merged"), G.contains(two, v("a", "b", "w")).alias("inside"), F.round(G.distance(v("a", "b", "w"), G.vec(1.0, 2.0, 3.0)), 9).alias("distance"))


def _vectors(s, d):
    c: list[Column] = [F.col(x).cast("double") for x in ("l_quantity", "l_linenumber", "l_tax")]
    a, b = G.vec(*c), G.vec(1.0, 2.0, 3.0)
    x = G.cross(a, b)
    return P.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(G.dot(a, b), 6).alias("dot"), F.round(x["z"], 6).alias("cz"), F.round(x["y"], 6).alias("cy"), F.round(x["x"], 6).alias("cx"), F.round(G.length(G.projection(a, b)), 6).alias("projected"), F.round(G.mod(a, G.vec(7.0, 7.0, 7.0))["z"], 6).alias("remainder"))


_PATCHES = "n as (select (max(x) + 100) // 100 as n from voxels), grid as (select a.k as kz, b.k as ky, c.k as kx, (a.k * 2 + b.k) * n + c.k as patch_id from n, (select unnest(range(2)) as k) a, (select unnest(range(2)) as k) b, (select unnest(range((select n from n))) as k) c)"
_BACK = f"with {P.VOXELS}, {_PATCHES}, back as (select z, y, x, z - kz * 30 as pz, y - ky * 20 as py, x - kx * 100 as px, v + patch_id % 7 / 10 as v, patch_id from voxels, grid where z between kz * 30 and kz * 30 + 39 and y between ky * 20 and ky * 20 + 29 and x between kx * 100 and kx * 100 + 119)"
_NEAR = "k as (select unnest([-1, 0, 1])::int as d), s as (select v.z + a.d as z, v.y + b.d as y, v.x + c.d as x, v.v from voxels v, k a, k b, k c)"
_L = "pow((({0} + 1) / {1}::double) * (1 - ({0} + 1) / {1}::double), -1.5)"


def _labels_of(hot: str, link: str = "true", most: int = 2) -> str:
    """Labelled voxels; hot: rows (t, z, y, x, v), of which those of one t connect where `link` holds."""
    return f"""with recursive {P.VOXELS}, hot as (select *, (z::bigint * 40 + y) * 1000000 + x as p from ({hot})),
steps as (select a as dz, b as dy, c as dx from (select unnest([-1, 0, 1]) as a), (select unnest([-1, 0, 1]) as b), (select unnest([-1, 0, 1]) as c) where abs(a) + abs(b) + abs(c) between 1 and {most}),
links as (select h.t, h.p as a, o.p as b from hot h, steps s join hot o on o.t = h.t and o.z = h.z + s.dz and o.y = h.y + s.dy and o.x = h.x + s.dx where {link}),
reach as (select t, p as a, p as b from hot union select r.t, r.a, l.b from reach r join links l on l.a = r.b and l.t = r.t),
labelled as (select h.*, m.label from hot h join (select t, b as p, min(a) as label from reach group by t, b) m using (t, p))"""


_LABELS = _labels_of("select 0 as t, z, y, x, v from voxels where v >= 0.85")
_CENTRES = "centres as (select label, trunc(avg(z))::int as z, trunc(avg(y))::int as y, trunc(avg(x))::int as x, count(*) as no_voxels from labelled group by 1)"
_PAIRS = f"with recursive {P.ANNOTATORS}, pairs as (select t.day, t.idx as truth_idx, p.idx as pred_idx, sqrt((t.z - p.z) * (t.z - p.z) + (t.y - p.y) * (t.y - p.y) + (t.x - p.x) * (t.x - p.x)) as dist from truth t join pred p using (day))"
#: Greedy pairs by walking each day's pairs in their order, with the members that are used up.
_WALK = """ranked as (select c as cutoff, pairs.*, row_number() over (partition by c, day order by dist, truth_idx, pred_idx) as r from pairs, (select unnest([{0}]) as c) where dist <= c),
walk as (
  select cutoff, day, 0::bigint as r, []::bigint[] as ts, []::bigint[] as ps from (select distinct cutoff, day from ranked)
  union all select w.cutoff, w.day, k.r, case when list_contains(ts, k.truth_idx) or list_contains(ps, k.pred_idx) then ts else list_append(ts, k.truth_idx) end,
    case when list_contains(ts, k.truth_idx) or list_contains(ps, k.pred_idx) then ps else list_append(ps, k.pred_idx) end
  from walk w join ranked k on k.cutoff = w.cutoff and k.day = w.day and k.r = w.r + 1),
ends as (select cutoff, day, arg_max(ts, r) as ts, arg_max(ps, r) as ps from walk group by 1, 2),
taken as (select cutoff, day, unnest(ts) as truth_idx, unnest(ps) as pred_idx from ends)"""
#: Pairs of cells of neighbouring planes by their centres alone, and with overlapping rectangles; and what hangs together.
_WINDOWS = "links as (select a.idx as a, b.idx as b from e a join e b on a.day = b.day and b.z = a.z + 1 and b.y - a.y >= -3 and b.y - a.y < 3 and b.x - a.x >= -3 and b.x - a.x < 3)"
_OVERLAPS = _WINDOWS[:-1] + " and abs(b.y - a.y) <= a.idx % 3 + b.idx % 3 and abs(b.x - a.x) <= a.idx // 3 % 3 + b.idx // 3 % 3)"
_OBJECTS = "both_ways as (select a, b from links union select b, a from links), reach as (select idx as a, idx as b from e union select r.a, l.b from reach r join both_ways l on l.a = r.b), objects as (select b as cell_id, min(a) as object_id from reach group by 1)"
_STATS = """sides as (select c as cutoff, day, count(*) filter (where side = 0) as nt, count(*) filter (where side = 1) as np from e, (select unnest([1.0, 1.5]) as c) group by 1, 2),
stats as (select s.cutoff, s.day, coalesce(n, 0)::bigint as tp, np - coalesce(n, 0)::bigint as fp, nt - coalesce(n, 0)::bigint as fn, coalesce(n, 0) / nullif(np, 0)::double as precision, coalesce(n, 0) / nullif(nt, 0)::double as recall
  from sides s left join (select cutoff, day, count(*) as n from taken group by 1, 2) using (cutoff, day))"""


def _flat(s, d):
    """All events as rectangular 2-D cells of a volume for each day."""
    t, p = P.annotators(s, d)
    cells = t.unionByName(p).selectExpr("cast(day as string) as volume_id", "idx as cell_id", "cast(z as int) as z", "y", "x", "cast(idx % 3 as double) as h", "cast(idx div 3 % 3 as double) as w")
    corners = F.array(*(F.struct((F.col("y") + i * F.col("h")).alias("y"), (F.col("x") + j * F.col("w")).alias("x")) for i, j in ((-1, -1), (-1, 1), (1, 1), (1, -1))))
    return cells.withColumn("pts", corners).drop("h", "w")


def _all_events(s, d):
    t, p = P.annotators(s, d)
    return t.unionByName(p)


def _owned(s, d):
    """Objects of each chunk with its halo, kept by the chunk that holds their centre."""
    chunks = components.halo_chunks(components.at_least(_voxels(s, d), 0.85), 20, 3).withColumn("volume_id", F.col("chunk").cast("string")).drop("chunk")
    found = components.centres(components.label(chunks, 40, 1_000_000)).withColumn("chunk", F.col("volume_id").cast("int"))
    return components.owned(found, 20).select("chunk", "z", "y", "x", "no_voxels")


def _grid(s, d):
    """All patches with the number of voxels they hold."""
    dims = _dims(s, d)
    held = windows.patches(_voxels(s, d), dims, (30, 20, 100), (40, 30, 120)).groupBy("patch_id").agg(F.count(F.lit(1)).alias("n"))
    return windows.patch_grid(s, dims, (30, 20, 100)).join(held, "patch_id", "left").fillna(0, ["n"])


def _scan(s, d):
    """All patches of a scan by their centres, with the number of voxels they hold."""
    centres = windows.scan_grid(s, _dims(s, d), (20, 10, 20), (0.75, 0, 0.75))
    inside = components.in_box(centres.withColumn("volume_id", F.lit("a")), _voxels(s, d), (10, 5, 10)).where("z < cz + 10 and y < cy + 5 and x < cx + 10")
    held = inside.groupBy(F.col("cz").alias("z"), F.col("cy").alias("y"), F.col("cx").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    return centres.join(held, ["z", "y", "x"], "left").fillna(0, ["n"])


def _folder(s) -> str:
    return f"{checkpoint_dir(s).rstrip('/')}/volumes-{uuid.uuid4().hex}"


def _npy(s, d):
    """Voxels written as dense slabs and read back in ranges of planes."""
    path, dims = _folder(s), _dims(s, d)
    volumes.write_volume(_in_place(_voxels(s, d)), path, dims, 20, "float64", background=-1.0)
    return volumes.combined(volumes.read_volume(s, path, background=-1.0), dims)


def _tiff(s, d):
    """Voxels written as a TIFF file for each plane, read back as one volume and turned."""
    path, dims = _folder(s), _dims(s, d)
    volumes.write_volume(_in_place(_voxels(s, d)).withColumn("v", F.round(F.col("v") * 49)), path, dims, 1, "int16", "tiff_volume", background=-1.0)
    return volumes.combined(volumes.read_volume(s, path, "tiff_volume", background=-1.0), dims, ("1", "-2", "0"))


def _mask_places(s, d):
    """Places to train at in three datasets, which share the volume's planes."""
    masks = _voxels(s, d).where("v >= 0.8").withColumn("dataset", F.concat(F.lit("d"), (F.col("z") % 3).cast("string")))
    ranges = masks.select("dataset").distinct().select("dataset", F.expr("array(5, 5, 2)").alias("lo"), F.expr("array(50, 35, 1000000)").alias("hi"))
    return augment.mask_places(masks, ranges, 20, 7)


def _pixels(s, d):
    """Two channels of the line items' volume."""
    rows = P.table(s, d, "lineitem").selectExpr("cast(l_partkey % 60 as int) as z", "cast(l_suppkey % 40 as int) as y", "cast(l_orderkey div 100 as int) as x", "l_extendedprice", "l_quantity")
    return rows.groupBy("z", "y", "x").agg(F.max(F.floor(F.col("l_extendedprice") / 100)).alias("signal"), F.max(F.col("l_quantity") * 20).alias("background"))


def _swept(s, d):
    return components.sweep_centres(components.threshold_sweep(_voxels(s, d), [0.85, 0.95], 40, 1_000_000)).drop("volume_id")


def _trained(s, d):
    points = components.centres(_labelled(s, d)).withColumnRenamed("label", "idx")
    return _in_place(components.training_labels(points, _voxels(s, d), (2, 3, 3), 16, 0.0, 1.0)).select("z", "y", "x", "v")


def _trees(s, d):
    rows = P.table(s, d, "orders").selectExpr("cast(o_orderkey as string) as path", "cast(o_totalprice as long) as length", "o_orderstatus as digest")
    return catalog.tree_differences(rows, rows.withColumn("length", F.expr("length + cast(path % 5 = 0 as int)")))


def _transformed(s, d):
    lines = P.points(s, d).select(F.format_string("Point\t%d\t; InputPoint = [ 0 0 0 ]\t; OutputPoint = [ %.2f %.2f %.2f ]\t; Deformation = [ 0 0 0 ]", "point_id", "x", "y", "z").alias("value"))
    return exchange.read_transformed(lines).select("point_id", *(F.round(c, 2).alias(c) for c in "zyx"))

QUERIES = {
    "p1_threshold": lambda s, d: components.at_least(_voxels(s, d), 0.3, 0.6).select("z", "y", "x", "v"),
    "p3_adaptive": lambda s, d: components.adaptive(_voxels(s, d), 1.2).select("z", "y", "x", "v"),
    "p4_share_of_max": lambda s, d: components.above_share_of_max(_voxels(s, d), 0.9).select("z", "y", "x", "v"),
    "v1_components": lambda s, d: _labelled(s, d).select("z", "y", "x", "label"),
    "p6_size_filter": lambda s, d: components.size_filter(_labelled(s, d), 2, 6).select("z", "y", "x", "label"),
    "a7_centres": lambda s, d: components.centres(_labelled(s, d)).select("label", "z", "y", "x", "no_voxels"),
    "a7w_weighted_centres": lambda s, d: components.centres(_labelled(s, d), True).select("label", "z", "y", "x", "no_voxels"),
    "o3_largest": lambda s, d: components.largest(_labelled(s, d), 3).select("z", "y", "x", "label"),
    "o4_largest_high": lambda s, d: components.largest(_labelled(s, d), 3, True).select("z", "y", "x", "label"),
    "v1_numbered": lambda s, d: components.numbered(_labelled(s, d)).select("label", F.col("val").cast("long").alias("val")).distinct(),
    "v5_measures": lambda s, d: _r(components.measures(_labelled(s, d), volume=_voxels(s, d)), "sphericity", "intensity").select("label", "z", "y", "x", "max_perimeter", "sphericity", F.col("z_depth").cast("long").alias("z_depth"), "no_voxels", "intensity"),
    "w7_halo": lambda s, d: components.halo_chunks(_voxels(s, d), 20, 3).select("chunk", "z", "y", "x", "v"),
    "p5_owned": _owned,
    "w1_patch_grid": _grid,
    "w2_patches": _patches,
    "w3_max_merge": lambda s, d: _in_place(windows.merged_by_max(_back(s, d), _dims(s, d))),
    "w5_blend": lambda s, d: _in_place(_r(windows.blended(_back(s, d)), "v")),
    "w5_overwrite": lambda s, d: _in_place(_r(windows.overwritten(_back(s, d), "patch_id"), "v")),
    "w6_bump_blend": _bump,
    "w9_centred_patch": lambda s, d: windows.centred_patch(_voxels(s, d), (30, 20, 50), (11, 12, 13)).select("z", "y", "x", "v"),
    "w9_set_patch": lambda s, d: _in_place(windows.set_patch(_voxels(s, d), _voxels(s, d).where("x < 20").withColumn("v", 0.5 - F.col("v") / 2), "max")),
    "j6_distance_join": lambda s, d: _r(_pairs(s, d), "dist"),
    "j7_greedy": _matched,
    "a13_match_stats": _match_stats,
    "a10_statistics": lambda s, d: _r(raster.statistics(_voxels(s, d), "z"), "lo", "hi", "mean", "std", "median", "p95"),
    "a11_projection": lambda s, d: _in_place(raster.project(_voxels(s, d))),
    "f11_scaled": lambda s, d: _r(raster.scaled(_voxels(s, d), 255.0, 0.05, 0.95), "v").select("z", "y", "x", "v"),
    "w10_box_filter": lambda s, d: _in_place(_r(raster.box_filter(_voxels(s, d), (1, 1, 1)), "v")),
    "w10_median_filter": lambda s, d: _in_place(_r(raster.median_filter(_voxels(s, d), (1, 1, 1)), "v")),
    "v8_dilate": lambda s, d: _in_place(raster.dilate(_voxels(s, d), (0, 1, 1), _dims(s, d))),
    "v8_erode": lambda s, d: _in_place(raster.erode(_voxels(s, d), (0, 0, 1))),
    "v7_stamp": lambda s, d: _r(raster.stamp(_all_events(s, d), raster.ball(2), (40, 24, 50)), "v"),
    "v7_stamped": lambda s, d: _r(raster.stamped(_all_events(s, d), raster.cylinder(1, 3), (40, 24, 50), 255.0), "v"),
    "v11_stitch": lambda s, d: _in_place(_r(raster.stitch(_voxels(s, d).withColumn("x_tile", (F.col("x") / 20).cast("int")).withColumn("x", F.col("x") % 20), 20, 5, False), "v")),
    "v12_blend_sheets": lambda s, d: _in_place(_r(raster.blend_sheets(_voxels(s, d), _voxels(s, d).withColumn("v", F.col("v") / 2 + 0.1), _dims(s, d)[2]), "v")),
    "v14_block_mean": lambda s, d: _in_place(_r(raster.block_mean(_voxels(s, d), (2, 4, 8)), "v")),
    "a17_histogram": lambda s, d: _r(raster.histogram(_voxels(s, d), 16, 0.0, 1.0), "cdf"),
    "a17_match": lambda s, d: _r(raster.match_histogram(raster.histogram(_voxels(s, d), 16, 0.0, 1.0), raster.histogram(_voxels(s, d).withColumn("v", F.col("v") * F.col("v")), 16, 0.0, 1.0)), "target"),
    "a27_otsu": lambda s, d: raster.otsu(_voxels(s, d), 32, 0.0, 1.0, "z"),
    "f4_resample_points": lambda s, d: _r(G.resample_points(P.points(s, d), (60, 40, 20), (30, 60, 25)), "z", "y", "x").select("point_id", "z", "y", "x"),
    "f5_reorient": lambda s, d: _r(G.reorient(P.points(s, d), (62, 42, 22), ("2", "0", "-1")), "z", "y", "x").select("point_id", "z", "y", "x"),
    "f10_affine": lambda s, d: _r(G.affine(P.points(s, d), [[1, 0.5, 0, 2], [0, 2, 0, -1], [0.25, 0, 1, 0], [0, 0, 0, 1]]), "z", "y", "x").select("point_id", "z", "y", "x"),
    "f9_boxes": _boxes,
    "f8_vectors": _vectors,
    "f12_interpolate": lambda s, d: P.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(maths.interpolate(F.col("l_quantity"), [(5, 0), (10, 1), (30, 0.5), (45, 4)]), 9).alias("v")),
    "f14_grayscale": lambda s, d: P.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(maths.grayscale(F.col("l_discount") * 10, 1.2, -0.1, 0.5), 9).alias("v")),
    "f15_circularity": lambda s, d: P.table(s, d, "part").select("p_partkey", F.round(maths.circularity(F.col("p_retailprice"), F.col("p_size") * 10), 6).alias("v")),
    "f16_sigmoid": lambda s, d: P.table(s, d, "customer").select("c_custkey", F.round(maths.sigmoid(F.col("c_acctbal") / 5000), 9).alias("v")),
    "f1_zero_padded": lambda s, d: P.table(s, d, "orders").select("o_orderkey", text.zero_padded(F.col("o_orderkey"), 4).alias("v")),
    "f2_base_name": lambda s, d: P.tiles(s, d).select(text.base_name(F.col("path")).alias("name")),
    "f3_moved": lambda s, d: P.tiles(s, d).select(text.moved(F.col("path"), "/raw/b1", "/scratch").alias("path")),
    "f21_stamp": lambda s, d: P.table(s, d, "orders").select("o_orderkey", text.stamp(F.col("o_orderdate")).alias("v")),
    "f23_first_int": lambda s, d: P.table(s, d, "supplier").select("s_suppkey", text.first_int(F.col("s_name")).alias("v")),
    "s2_planes": lambda s, d: catalog.planes(catalog.parsed(P.tiles(s, d))).select("ch", "z", "n", F.array_join("paths", ";").alias("paths")),
    "s3_geometry": lambda s, d: catalog.geometry(catalog.parsed(P.tiles(s, d))).select(*(F.col(c).cast("long").alias(c) for c in ("xtile", "ytile", "lightsheets", "channels", "planes"))),
    "s3_bad_planes": lambda s, d: catalog.bad_planes(catalog.parsed(P.tiles(s, d))),
    "s3_complete": lambda s, d: catalog.complete(catalog.parsed(P.tiles(s, d))).select("z", "ch", "ls", "y", "x"),
    "a8_size_outliers": lambda s, d: catalog.size_outliers(P.table(s, d, "orders").selectExpr("o_orderkey", "o_totalprice as length"), 1.5),
    "a9_missing": _missing,
    "u1_pooled": lambda s, d: catalog.pooled([P.table(s, d, "region"), P.table(s, d, "nation").selectExpr("n_regionkey as r_regionkey", "n_name as extra")]).select("extra", "r_name", "r_regionkey"),
    "s14_point_lines": lambda s, d: exchange.point_lines(_all_events(s, d).selectExpr("idx as point_id", "cast(z as int) as z", "cast(y as int) as y", "cast(x as int) as x")),
    "s17_npy_round_trip": _npy,
    "v15_combined_planes": _tiff,
    "v17_expression_mask": lambda s, d: _r(raster.expression_mask(_pixels(s, d), 5.0, 0.4, 300, 1, most_rounds=6), "v"),
    "m3_flip": lambda s, d: augment.flip(_voxels(s, d), (60, 40, 600), "zy").select("z", "y", "x", "v"),
    "m3_transpose": lambda s, d: augment.transpose(_voxels(s, d)).select("z", "y", "x", "v"),
    "m4_gray": lambda s, d: _r(augment.gray(_voxels(s, d), 0.8, 0.1, -0.5), "v").select("z", "y", "x", "v"),
    "m5_fill_sections": lambda s, d: augment.fill_sections(_voxels(s, d), [3, 9], 0.5, F.col("y") < 20).select("z", "y", "x", "v"),
    "m6_misalign": lambda s, d: augment.misalign(_voxels(s, d), _dims(s, d), 20, 3, -2).select("z", "y", "x", "v"),
    "m7_lost": lambda s, d: augment.lose_sections(_voxels(s, d), [5, 17, 18]).select("z", "y", "x", "v"),
    "v2_same_value": lambda s, d: components.label(components.at_least(_voxels(s, d), 0.85), 40, 1_000_000, 26, same_value=True).select("z", "y", "x", "label"),
    "v3_object_windows": lambda s, d: components.object_windows(_labelled(s, d)).select("label", "pz", "py", "px"),
    "v6_threshold_sweep": _swept,
    "v21_training_labels": _trained,
    "p7_sphericity": lambda s, d: components.sphericity_filter(components.measures(_labelled(s, d), intensity=False), 0.7).select("label", "no_voxels"),
    "j9_unpaired": lambda s, d: matching.unpaired(P.annotators(s, d)[0], _matched(s, d), "truth_idx", "day").select("day", "idx"),
    "a14_curve_area": lambda s, d: _r(matching.curve_area(_match_stats(s, d), "cutoff", "day"), "area"),
    "j10_overlapping": lambda s, d: components.overlapping(_flat(s, d), 3).select("a", "b"),
    "v10_merge_planes": lambda s, d: components.merge_planes(_flat(s, d), 3).select("cell_id", "object_id"),
    "v10_windows_only": lambda s, d: components.merge_planes(_flat(s, d).drop("pts"), 3).select("cell_id", "object_id"),
    "v10_merged_cells": lambda s, d: _r(components.merged_cells(components.merge_planes(_flat(s, d), 3)), "radius").select("object_id", "planes", "z", "y", "x", "radius"),
    "w4_scan_grid": _scan,
    "w10_gaussian_filter": lambda s, d: _in_place(_r(raster.gaussian_filter(_voxels(s, d), (0.0, 0.5, 0.5), dims=_dims(s, d)), "v")),
    "m10_warp": lambda s, d: _in_place(augment.warp(_voxels(s, d), _dims(s, d), [[1, 0, 0], [0, 2, 0], [0, 0, 1]])),
    "m10_sheared": lambda s, d: _in_place(augment.warp(_voxels(s, d), _dims(s, d), augment.linear_map(shear=(0.0, 0.5)))),
    "m10_twist": lambda s, d: _in_place(augment.twist(_voxels(s, d), _dims(s, d), 30.0)),
    "m1_mask_places": _mask_places,
    "v9_gradient_edges": lambda s, d: _in_place(_r(ridges.gradient_edges(_voxels(s, d), 40, _dims(s, d)[2], 2.0, 3.0), "v")),
    "s15_transformed": _transformed,
    "u2_tree_differences": _trees,
    "g8_full_dims": lambda s, d: catalog.full_dims(catalog.parsed(P.tiles(s, d)), (100, 200)),
    "e5_own_pattern": lambda s, d: catalog.parsed(P.tiles(s, d), patterns={r"^x_\[(\d+) x \d+\]_C\d+_xyz-Table Z(\d+)_.*$": ("y", "z")}).select("y", "x", "z"),
    "p20_with_mask": lambda s, d: augment.with_mask(P.table(s, d, "orders").select("o_orderkey"), P.table(s, d, "lineitem").selectExpr("l_orderkey as o_orderkey", "cast(l_quantity > 45 as int) as v"), "o_orderkey"),
    "s20_loss_log": lambda s, d: catalog.loss_log(P.log(s, d).select(F.concat_ws("\t", F.col("iter").cast("string"), "metric", F.format_string("%.3f", "num")).alias("value"))),
    "m8_occlude": lambda s, d: augment.occlude(_voxels(s, d), [((0, 0, 0), (10, 10, 10)), ((20, 5, 5), (40, 20, 30))]).select("z", "y", "x", "v"),
}

_RAMP = "(1 / (1 + exp(-({0}))))"
ORACLES = {
    "p1_threshold": f"with {P.VOXELS} select z, y, x, v from voxels where v >= 0.3 and v <= 0.6",
    "p3_adaptive": f"with {P.VOXELS} select z, y, x, v from voxels where v > (select avg(v) + 1.2 * stddev_pop(v) from voxels)",
    "p4_share_of_max": f"with {P.VOXELS} select z, y, x, v from voxels where v > (select max(v) * 0.9::double from voxels)",
    "v1_components": f"{_LABELS} select z, y, x, label from labelled",
    "p6_size_filter": f"{_LABELS} select z, y, x, label from labelled where label in (select label from labelled group by 1 having count(*) between 2 and 6)",
    "a7_centres": f"{_LABELS} select label, trunc(avg(z))::int as z, trunc(avg(y))::int as y, trunc(avg(x))::int as x, count(*) as no_voxels from labelled group by 1",
    "a7w_weighted_centres": f"{_LABELS} select label, trunc(round(sum(z * v) / sum(v), 9))::int as z, trunc(round(sum(y * v) / sum(v), 9))::int as y, trunc(round(sum(x * v) / sum(v), 9))::int as x, count(*) as no_voxels from labelled group by 1",
    "o3_largest": f"{_LABELS} select z, y, x, label from labelled where label in (select label from labelled group by 1 order by count(*) desc, label limit 3)",
    "o4_largest_high": f"{_LABELS} select z, y, x, label from labelled where label in (select label from labelled group by 1 order by count(*) desc, label desc limit 3)",
    "v1_numbered": f"{_LABELS} select distinct label, dense_rank() over (order by label) as val from labelled",
    "v5_measures": f"{_LABELS}, {_CENTRES}, plane as (select label, z, count(*) as a, sum(4 - (select count(*) from labelled o where o.label = l.label and o.z = l.z and abs(o.y - l.y) + abs(o.x - l.x) = 1)) as p from labelled l group by 1, 2), shape as (select label, max(p)::double as max_perimeter, round(avg(4 * 3.141592653589793 * a / (p * p)), 6) as sphericity, count(*) as z_depth from plane group by 1), wide as (select label, y, x, unnest(range(z - 5, z + 6))::int as cz from centres), peak as (select c.label, round(max(v.v), 6) as intensity from wide c join voxels v on v.z = c.cz and v.y between c.y - 10 and c.y + 10 and v.x between c.x - 10 and c.x + 10 group by 1) select label, z, y, x, max_perimeter, sphericity, z_depth, no_voxels, intensity from centres join shape using (label) left join peak using (label)",
    "w7_halo": f"with {P.VOXELS} select c as chunk, z, y, x, v from voxels, (select unnest(range(-1, 5))::int as c) where z >= c * 20 - 3 and z < c * 20 + 23 and c >= 0",
    "p5_owned": f"{_labels_of('select c as t, z, y, x, v from voxels, (select unnest(range(0, 4))::int as c) where v >= 0.85 and z >= c * 20 - 3 and z < c * 20 + 23')}, centres as (select t, label, trunc(avg(z))::int as z, trunc(avg(y))::int as y, trunc(avg(x))::int as x, count(*) as no_voxels from labelled group by 1, 2) select t as chunk, z, y, x, no_voxels from centres where z // 20 = t",
    "w1_patch_grid": f"with {P.VOXELS}, {_PATCHES} select patch_id, kz * 30 as z0, ky * 20 as y0, kx * 100 as x0, count(v) as n from grid left join voxels on z between kz * 30 and kz * 30 + 39 and y between ky * 20 and ky * 20 + 29 and x between kx * 100 and kx * 100 + 119 group by 1, 2, 3, 4",
    "w2_patches": f"with {P.VOXELS}, {_PATCHES} select patch_id::int as patch_id, (z - kz * 30)::int as pz, (y - ky * 20)::int as py, (x - kx * 100)::int as px, v from voxels, grid where z between kz * 30 and kz * 30 + 39 and y between ky * 20 and ky * 20 + 29 and x between kx * 100 and kx * 100 + 119",
    "w3_max_merge": f"{_BACK} select z, y, x, max(v) as v from back group by 1, 2, 3",
    "w5_blend": f"{_BACK} select z, y, x, round(avg(v), 6) as v from back group by 1, 2, 3",
    "w5_overwrite": f"{_BACK} select z, y, x, round(max_by(v, patch_id), 6) as v from back group by 1, 2, 3",
    "w6_bump_blend": f"{_BACK}, l as (select z, y, x, v, -({_L.format('pz', 41)} + {_L.format('py', 31)} + {_L.format('px', 121)}) as l from back), w as (select *, exp(l - max(l) over (partition by z, y, x)) as w from l) select z, y, x, round(sum(v * w) / sum(w), 6) as v from w group by 1, 2, 3",
    "w9_centred_patch": f"with {P.VOXELS} select z - 25 as z, y - 14 as y, x - 44 as x, v from voxels where z between 25 and 35 and y between 14 and 25 and x between 44 and 56",
    "w9_set_patch": f"with {P.VOXELS} select z, y, x, case when x < 20 then greatest(v, 0.5 - v / 2) else v end as v from voxels",
    "j6_distance_join": f"{_PAIRS} select day, truth_idx, pred_idx, round(dist, 6) as dist from pairs where dist <= 1.5",
    "a10_statistics": f"with {P.VOXELS} select z, round(min(v), 6) as lo, round(max(v), 6) as hi, round(avg(v), 6) as mean, round(stddev_pop(v), 6) as std, round(median(v), 6) as median, round(quantile_cont(v, 0.95), 6) as p95 from voxels group by 1",
    "a11_projection": f"with {P.VOXELS} select y, x, max(v) as v from voxels group by 1, 2",
    "f11_scaled": f"with {P.VOXELS}, e as (select quantile_cont(v, 0.05) as a, quantile_cont(v, 0.95) as b from voxels) select z, y, x, round((least(b, greatest(a, v)) - a) * 255 / (b - a), 6) as v from voxels, e",
    "w10_box_filter": f"with {P.VOXELS}, {_NEAR} select z, y, x, round(sum(s.v) / 27, 6) as v from voxels o join s using (z, y, x) group by 1, 2, 3",
    "w10_median_filter": f"with {P.VOXELS}, {_NEAR} select z, y, x, round(median(s.v), 6) as v from voxels o join s using (z, y, x) group by 1, 2, 3",
    "v8_dilate": f"with {P.VOXELS}, k as (select unnest([-1, 0, 1])::int as d), s as (select z, y + a.d as y, x + b.d as x, v from voxels, k a, k b) select z, y, x, max(v) as v from s where y between 0 and 39 and x between 0 and (select max(x) from voxels) group by 1, 2, 3",
    "v8_erode": f"with {P.VOXELS}, s as (select z, y, x + d as x, v from voxels, (select unnest([-1, 0, 1])::int as d)) select z, y, x, min(v) as v from s group by 1, 2, 3 having count(*) = 3",
    "v7_stamp": f"with {P.ANNOTATORS}, o as (select a as dz, b as dy, c as dx, 1 - sqrt(a * a + b * b + c * c) / 3 as v from (select unnest(range(-2, 3)) as a), (select unnest(range(-2, 3)) as b), (select unnest(range(-2, 3)) as c) where a * a + b * b + c * c <= 4), p as (select (t.z::int + dz)::int as z, (t.y::int + dy)::int as y, (t.x::int + dx)::int as x, v from e t, o) select z, y, x, round(max(v), 6) as v from p where z between 0 and 39 and y between 0 and 23 and x between 0 and 49 group by 1, 2, 3",
    "v7_stamped": f"with {P.ANNOTATORS}, o as (select a as dz, b as dy, c as dx from (select unnest([-1, 0, 1]) as a), (select unnest([-1, 0, 1]) as b), (select unnest([-1, 0, 1]) as c) where b * b + c * c <= 1), p as (select distinct (t.z::int + dz)::int as z, (t.y::int + dy)::int as y, (t.x::int + dx)::int as x from e t, o) select z, y, x, 255.0::double as v from p where z between 0 and 39 and y between 0 and 23 and x between 0 and 49",
    "v11_stitch": f"with {P.VOXELS}, t as (select z, y, x % 20 as x, x // 20 as t, v from voxels), m as (select max(t) as last from t) select z, y, (t * 15 + x)::int as x, round(sum(v * case when x < 5 and t > 0 then x / 4.0::double else 1 end * case when x >= 15 and t < last then 1 - (x - 15) / 4.0::double else 1 end), 6) as v from t, m group by 1, 2, 3",
    "v12_blend_sheets": f"with {P.VOXELS}, s as (select *, v / 2 + 0.1 as b, 1 / (1 + exp(-(-10 + 20 * x / (select max(x) from voxels)::double))) as w from voxels), m as (select median(v) as ml, median(b) as mr from s) select z, y, x, round(v * (1 - w) + greatest(0, b + ml - mr) * w, 6) as v from s, m",
    "v14_block_mean": f"with {P.VOXELS} select z // 2 as z, y // 4 as y, x // 8 as x, round(sum(v) / 64, 6) as v from voxels group by 1, 2, 3",
    "a17_histogram": f"with {P.VOXELS}, h as (select least(15, floor(v * 16))::int as bin, count(*) as n from voxels group by 1) select bin, n, round(sum(n) over (order by bin) / sum(n) over ()::double, 6) as cdf from h",
    "a17_match": f"with {P.VOXELS}, a as (select least(15, floor(v * 16))::int as bin, count(*) as n from voxels group by 1), ca as (select bin, sum(n) over (order by bin) / sum(n) over ()::double as c from a), b as (select least(15, floor(v * v * 16))::int as bin, count(*) as n from voxels group by 1), cb as (select bin, sum(n) over (order by bin) / sum(n) over ()::double as c from b), legs as (select bin as b0, c as c0, lead(bin) over (order by c) as b1, lead(c) over (order by c) as c1 from cb), e as (select arg_min(bin, c) as f, min(c) as fc, arg_max(bin, c) as l, max(c) as lc from cb) select ca.bin as source_bin, round(case when ca.c <= fc then f::double when ca.c >= lc then l::double else b0 + (ca.c - c0) * (b1 - b0) / (c1 - c0) end, 6) as target from ca cross join e left join legs on ca.c >= c0 and ca.c < c1",
    "a27_otsu": f"with {P.VOXELS}, h as (select z, least(31, floor(v * 32))::int as bin, count(*) as n from voxels group by 1, 2), c as (select z, bin, sum(n) over w as n0, sum(n * bin) over w as s0, sum(n) over (partition by z) as n, sum(n * bin) over (partition by z) as s from h window w as (partition by z order by bin)), f as (select z, bin, n0 * (n - n0) * pow(s0 / n0::double - (s - s0) / (n - n0)::double, 2) as score from c where n0 < n) select z, bin from f qualify row_number() over (partition by z order by score desc, bin) = 1",
    "f4_resample_points": f"with {P.POINTS} select point_id, round(z * 0.5, 6) as z, round(y * 1.5, 6) as y, round(x * 1.25, 6) as x from points",
    "f5_reorient": f"with {P.POINTS} select point_id, round(42 - (y + 1), 6) as z, round(x, 6) as y, round(z, 6) as x from points",
    "f10_affine": f"with {P.POINTS} select point_id, round(z + 0.5 * y + 2, 6) as z, round(2 * y - 1, 6) as y, round(0.25 * z + x, 6) as x from points",
    "f9_boxes": "with p as (select p_partkey, (p_partkey % 50)::double as a, p_size::double as b, (p_partkey % 7 + 1)::double as w from part) select p_partkey, case when a < 36 and 15 < a + w and b < 35 and 15 < b + w and w < 7 and 2 < w + w then (least(a + w, 36) - greatest(a, 15)) * (least(b + w, 35) - greatest(b, 15)) * (least(w + w, 7) - greatest(w, 2)) end as shared, (greatest(a + w, 36) - least(a, 15)) * (greatest(b + w, 35) - least(b, 15)) * (greatest(w + w, 7) - least(w, 2)) as merged, a >= 15 and a < 36 and b >= 15 and b < 35 and w >= 2 and w < 7 as inside, round(sqrt((a - 1) * (a - 1) + (b - 2) * (b - 2) + (w - 3) * (w - 3)), 9) as distance from p",
    "f8_vectors": "select l_orderkey, l_linenumber, round(l_quantity + 2 * l_linenumber + 3 * l_tax, 6) as dot, round(l_linenumber * 3 - l_tax * 2, 6) as cz, round(l_tax * 1 - l_quantity * 3, 6) as cy, round(l_quantity * 2 - l_linenumber, 6) as cx, round((l_quantity + 2 * l_linenumber + 3 * l_tax) / sqrt(14), 6) as projected, round(l_quantity - 7 * floor(l_quantity / 7), 6) as remainder from lineitem",
    "f12_interpolate": "select l_orderkey, l_linenumber, round(case when l_quantity <= 5 then 0 when l_quantity <= 10 then (l_quantity - 5) / 5 when l_quantity <= 30 then 1 - (l_quantity - 10) * 0.5 / 20 when l_quantity <= 45 then 0.5 + (l_quantity - 30) * 3.5 / 15 else 4 end, 9) as v from lineitem",
    "f14_grayscale": "select l_orderkey, l_linenumber, round(pow(least(1, greatest(0, l_discount * 10 * 1.2 - 0.1)), pow(2, 0.5)), 9) as v from lineitem",
    "f15_circularity": "select p_partkey, round(4 * 3.141592653589793 * p_retailprice / (p_size * 10 * (p_size * 10)), 6) as v from part",
    "f16_sigmoid": "select c_custkey, round(1 / (1 + exp(-c_acctbal / 5000)), 9) as v from customer",
    "f1_zero_padded": "select o_orderkey, case when length(o_orderkey::varchar) >= 4 then o_orderkey::varchar else lpad(o_orderkey::varchar, 4, '0') end as v from orders",
    "f2_base_name": f"with {P.TILES} select printf('x_[%02d x %02d]_C%02d_xyz-Table Z%04d_UltraII Filter%04d.ome.tif', y, x, ls, z, ch) as name from tiles",
    "f3_moved": f"with {P.TILES} select printf('/scratch/x_[%02d x %02d]_C%02d_xyz-Table Z%04d_UltraII Filter%04d.ome.tif', y, x, ls, z, ch) as path from tiles",
    "f21_stamp": "select o_orderkey, strftime(o_orderdate, '%d%m%y_%H%M%S') as v from orders",
    "f23_first_int": "select s_suppkey, regexp_extract(s_name, '(\\d+)', 1)::bigint as v from supplier",
    "s2_planes": f"with {P.TILES} select ch, z, count(*) as n, string_agg(printf('/raw/b1/x_[%02d x %02d]_C%02d_xyz-Table Z%04d_UltraII Filter%04d.ome.tif', y, x, ls, z, ch), ';' order by ls, y, x, k) as paths from tiles group by 1, 2",
    "s3_geometry": f"with {P.TILES} select max(x) + 1::bigint as xtile, max(y) + 1::bigint as ytile, count(distinct ls) as lightsheets, count(distinct ch) as channels, count(distinct z) as planes from tiles",
    "s3_bad_planes": f"with {P.TILES}, p as (select ch, z, count(*) as n from tiles group by 1, 2) select z from p group by z having max((n <> 12)::int) = 1 or count(*) <> 2",
    "s3_complete": f"with {P.TILES}, p as (select ch, z, count(*) as n from tiles group by 1, 2) select z, ch, ls, y, x from tiles where z not in (select z from p group by z having max((n <> 12)::int) = 1 or count(*) <> 2)",
    "a8_size_outliers": "select o_orderkey, o_totalprice as length from orders where abs(o_totalprice - (select avg(o_totalprice) from orders)) > 1.5 * (select stddev_pop(o_totalprice) from orders)",
    "a9_missing": f"with {P.TILES} select z::int as z from (select unnest(range((select max(z) + 10 from tiles))) as z) where z not in (select z from tiles)",
    "u1_pooled": "select null as extra, r_name, r_regionkey from region union all select n_name, null, n_regionkey from nation",
    "s14_point_lines": f"with {P.ANNOTATORS} select (-2)::bigint as ord, 'index' as value union all select -1, count(*)::varchar from e union all select idx, x::int::varchar || ' ' || y::int::varchar || ' ' || z::int::varchar from e",
    "s17_npy_round_trip": f"with {P.VOXELS} select z, y, x, v from voxels",
    "v15_combined_planes": f"with {P.VOXELS} select x::int as z, (59 - z)::int as y, y::int as x, (v * 49)::int::double as v from voxels",
    "m3_flip": f"with {P.VOXELS} select 59 - z as z, 39 - y as y, x, v from voxels",
    "m3_transpose": f"with {P.VOXELS} select z, x as y, y as x, v from voxels",
    "m4_gray": f"with {P.VOXELS} select z, y, x, round(pow(least(1, greatest(0, v * 0.8 + 0.1)), pow(2, -0.5)), 6) as v from voxels",
    "m5_fill_sections": f"with {P.VOXELS} select z, y, x, case when z in (3, 9) and y < 20 then 0.5 else v end as v from voxels",
    "m6_misalign": f"with {P.VOXELS}, s as (select z, y + case when z >= 20 then 3 else 0 end as y, x + case when z >= 20 then -2 else 0 end as x, v from voxels) select * from s where y between 0 and 39 and x between 0 and (select max(x) from voxels)",
    "m7_lost": f"with {P.VOXELS} select z - (z > 5)::int - (z > 17)::int - (z > 18)::int as z, y, x, v from voxels where z not in (5, 17, 18)",
    "j7_greedy": f"{_PAIRS}, {_WALK.format('1.5')} select day, truth_idx, pred_idx, dist from taken join pairs using (day, truth_idx, pred_idx)",
    "j9_unpaired": f"{_PAIRS}, {_WALK.format('1.5')} select day, idx from truth where (day, idx) not in (select (day, truth_idx) from taken)",
    "a13_match_stats": f"{_PAIRS}, {_WALK.format('1.0, 1.5')}, {_STATS} select day, cutoff::double as cutoff, tp, fp, fn, precision, recall, 2 * tp / nullif(2 * tp + fp + fn, 0)::double as f1 from stats",
    "a14_curve_area": f"{_PAIRS}, {_WALK.format('1.0, 1.5')}, {_STATS}, p as (select day, 1 - recall as x, precision as y, lag(1 - recall) over w as x0, lag(precision) over w as y0 from stats window w as (partition by day order by cutoff)) select day, round(sum((x - x0) * (y + y0) / 2), 6) as area from p group by 1",
    "v2_same_value": f"{_labels_of('select 0 as t, z, y, x, v from voxels where v >= 0.85', 'h.v = o.v', 3)} select z, y, x, label from labelled",
    "v3_object_windows": f"{_LABELS}, {_CENTRES} select label, l.z - c.z + 30 as pz, l.y - c.y + 75 as py, l.x - c.x + 75 as px from labelled l join centres c using (label) where abs(l.z - c.z) <= 30 and abs(l.y - c.y) <= 75 and abs(l.x - c.x) <= 75",
    "v6_threshold_sweep": f"{_labels_of('select t, z, y, x, v from voxels, (select unnest([0.85, 0.95]) as t) where v >= t')} select t::double as threshold, label, trunc(avg(z))::int as z, trunc(avg(y))::int as y, trunc(avg(x))::int as x, count(*) as no_voxels from labelled group by 1, 2",
    "v21_training_labels": f"{_LABELS}, {_CENTRES}, wide as (select label, y, x, unnest(range(z - 2, z + 3))::int as cz from centres), near as (select c.label, v.z, v.y, v.x, v.v from wide c join voxels v on v.z = c.cz and v.y between c.y - 3 and c.y + 3 and v.x between c.x - 3 and c.x + 3), h as (select label, least(15, floor(v * 16))::int as bin, count(*) as n from near group by 1, 2), c as (select label, bin, sum(n) over w as n0, sum(n * bin) over w as s0, sum(n) over (partition by label) as n, sum(n * bin) over (partition by label) as s from h window w as (partition by label order by bin)), f as (select label, bin, n0 * (n - n0) * pow(s0 / n0::double - (s - s0) / (n - n0)::double, 2) as score from c where n0 < n), o as (select label, (bin + 1) / 16::double as lim from f qualify row_number() over (partition by label order by score desc, bin) = 1) select distinct z, y, x, 1.0::double as v from near join o using (label) where v >= lim",
    "p7_sphericity": f"{_LABELS}, plane as (select label, z, count(*) as a, sum(4 - (select count(*) from labelled o where o.label = l.label and o.z = l.z and abs(o.y - l.y) + abs(o.x - l.x) = 1)) as p from labelled l group by 1, 2) select label, sum(a)::bigint as no_voxels from plane group by 1 having avg(4 * 3.141592653589793 * a / (p * p)) >= 0.7",
    "j10_overlapping": f"with {P.ANNOTATORS}, {_OVERLAPS} select a, b from links",
    "v10_merge_planes": f"with recursive {P.ANNOTATORS}, {_OVERLAPS}, {_OBJECTS} select cell_id, object_id from objects",
    "v10_windows_only": f"with recursive {P.ANNOTATORS}, {_WINDOWS}, {_OBJECTS} select cell_id, object_id from objects",
    "v10_merged_cells": f"with recursive {P.ANNOTATORS}, {_OVERLAPS}, {_OBJECTS}, planes as (select object_id, z, arg_min(idx, idx) as idx, arg_min(y, idx) as y, arg_min(x, idx) as x from objects join e on idx = cell_id group by 1, 2), placed as (select *, row_number() over (partition by object_id order by z) - 1 as k, count(*) over (partition by object_id) as planes from planes), middle as (select * from placed where k between (planes - 1) // 2 and planes // 2), centre as (select object_id, planes, avg(z) as z, avg(y) as y, avg(x) as x from middle group by 1, 2), corners as (select m.object_id, m.y + i * (m.idx % 3) as y, m.x + j * (m.idx // 3 % 3) as x from middle m, (select unnest([-1, 1]) as i), (select unnest([-1, 1]) as j)) select c.object_id, c.planes, c.z, c.y, c.x, round(avg(sqrt((p.y - c.y) * (p.y - c.y) + (p.x - c.x) * (p.x - c.x))), 6) as radius from centre c join corners p using (object_id) group by 1, 2, 3, 4, 5",
    "w4_scan_grid": f"with {P.VOXELS}, far as (select max(x) + 1 - 10 as m from voxels), c as (select z, y, x from (select unnest([10, 25, 40, 50])::int as z), (select unnest([5, 15, 25, 35])::int as y), (select unnest(range(10, (select m from far) + 1, 15))::int as x union select m::int from far)) select c.z, c.y, c.x, count(v) as n from c left join voxels v on v.z between c.z - 10 and c.z + 9 and v.y between c.y - 5 and c.y + 4 and v.x between c.x - 10 and c.x + 9 group by 1, 2, 3",
    "w10_gaussian_filter": f"with {P.VOXELS}, k as (select unnest(range(-2, 3))::int as d), g as (select d, exp(-d * d / 0.5::double) / (select sum(exp(-d * d / 0.5::double)) from k) as w from k) select z, (y + a.d)::int as y, (x + b.d)::int as x, round(sum(v * a.w * b.w), 6) as v from voxels, g a, g b where y + a.d between 0 and 39 and x + b.d between 0 and (select max(x) from voxels) group by 1, 2, 3",
    "m10_warp": f"with {P.VOXELS}, g as (select unnest(range(40))::int as y) select v.z, g.y, v.x, v.v from g join voxels v on v.y = round(19.5 + 0.5 * (g.y - 19.5))",
    "m10_sheared": f"with {P.VOXELS}, m as (select max(x) / 2.0::double as mx, max(x) as far from voxels), p as (select v.z, v.y, unnest(range(greatest(0, floor(v.x + 0.5 * (v.y - 19.5) - 1)::bigint), least(far, ceil(v.x + 0.5 * (v.y - 19.5) + 1)::bigint) + 1)) as nx, v.x, v.v, m.mx from voxels v, m) select z, y, nx as x, v from p where round(mx + (nx - mx) - 0.5 * (y - 19.5)) = x",
    "m1_mask_places": f"with {P.VOXELS}, m as (select 'd' || (z % 3) as dataset, z, y, x, md5('7:d' || (z % 3) || ':' || z || ':' || y || ':' || x) as p from voxels where v >= 0.8 and z between 5 and 49 and y between 5 and 34 and x >= 2) select dataset, row_number() over (partition by dataset order by p) as k, z, y, x from m qualify k <= 20",
    "s15_transformed": f"with {P.POINTS} select point_id, round(printf('%.2f', z)::double, 2) as z, round(printf('%.2f', y)::double, 2) as y, round(printf('%.2f', x)::double, 2) as x from points",
    "u2_tree_differences": "with a as (select o_orderkey::varchar as path, trunc(o_totalprice)::bigint as length, o_orderstatus as digest from orders), b as (select path, length + (path::bigint % 5 = 0)::int as length, digest from a) select *, 'left' as side from (select * from a except all select * from b) union all select *, 'right' from (select * from b except all select * from a)",
    "g8_full_dims": f"with {P.TILES} select max(z) + 1 as zdim, (max(y) + 1) * 100 as ydim, (max(x) + 1) * 200 as xdim from tiles",
    "e5_own_pattern": f"with {P.TILES} select y, 0 as x, z from tiles",
    "p20_with_mask": "select o_orderkey from orders where o_orderkey in (select l_orderkey from lineitem where l_quantity > 45)",
    "s20_loss_log": f"with {P.LOG} select iter, metric, round(num, 3) as value from log",
    "m8_occlude": f"with {P.VOXELS} select z, y, x, v from voxels where not (z < 10 and y < 10 and x < 10) and not (z between 20 and 39 and y between 5 and 19 and x between 5 and 29)",
}
