"""Queries of text and map functions, stores, pairings, compositions and a caller's functions."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from voxmere.functions import geometry as G
from voxmere.functions import maths, text
from voxmere.operators import augment, cohort, edges, inference, windows
from voxmere.operators.graph import checkpoint_dir
from voxmere.plans import pipelines
from voxmere.plans import projections as P
from voxmere.sources import catalog


def _dims(s, d):
    return 60, 40, P.table(s, d, "lineitem").agg(F.max(F.expr("l_orderkey div 100"))).first()[0] + 1


def _stored(s, d):
    """Every customer's parameters, stored and read back with changes for some."""
    rows = P.table(s, d, "customer").selectExpr("concat('e', c_nationkey) as expt", "c_name as key", "case when c_custkey % 3 = 0 then c_mktsegment else cast(c_custkey as string) end as value")
    path = f"{checkpoint_dir(s).rstrip('/')}/parameters-{uuid.uuid4().hex}"
    catalog.save_parameters(rows, path)
    changes = rows.where("value like '%7'").withColumn("value", F.concat(F.lit("-"), F.col("value")))
    return catalog.load_parameters(s, path, changes)


def _first(s, d):
    rows = P.table(s, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return cohort.first_match(rows, F.col("l_quantity") > 45, ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"], "l_suppkey")


def _entries(pairs):
    return F.array_join(F.transform(text.sorted_entries(pairs), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")


def _sorted(s, d):
    pairs = F.map_from_arrays(F.array(F.col("n_name"), F.lit("middle"), F.lit("AAA")), F.array("n_nationkey", "n_regionkey", F.lit(1).cast("bigint")))
    return P.table(s, d, "nation").select("n_nationkey", _entries(pairs).alias("entries"))


def _updated(s, d):
    base = F.create_map(F.lit("a"), F.col("o_orderkey"), F.lit("b"), F.col("o_custkey"))
    changes = F.map_from_arrays(F.array(F.concat(F.lit(""), F.substring("o_orderstatus", 1, 1)), F.lit("b")), F.array(F.lit(0).cast("bigint"), F.col("o_custkey") + 1))
    return P.table(s, d, "orders").select("o_orderkey", _entries(text.updated(base, changes)).alias("entries"))


def _metric(s, d):
    lines = P.table(s, d, "events").selectExpr("user_id as log", "event_id as line_no", "case when event_id % 7 = 0 then concat('Final metric value = ', cast(event_id as string), '.5') else 'Iteration' end as line")
    return catalog.last_metric(lines)


def _paired(s, d):
    left = P.table(s, d, "orders").selectExpr("concat('/im/v', cast(o_orderkey as string), '.tif') as path")
    right = P.table(s, d, "lineitem").selectExpr("concat('/roi/a/v', cast(l_orderkey as string), '.zip') as path").distinct()
    return catalog.paired(left, right)


def _valid(s, d):
    """Voxels at which a patch lies inside the volume."""
    lo, hi = windows.valid_range(_dims(s, d), (11, 12, 5))
    inside = F.lit(True)
    for k, c in enumerate("zyx"):
        inside &= (F.col(c) >= lo[k]) & (F.col(c) < hi[k])
    return P.voxels(s, d).where(inside).select("z", "y", "x")


def _contour_filter(s, d):
    rows = P.table(s, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_extendedprice / 10 as area", "l_discount * 10 as circle", "l_quantity as intensity", "20.0D as least")
    return rows.where(maths.contour_filter(F.col("area"), F.col("circle"), F.col("intensity"), (500.0, 6000.0), 0.3, F.col("least"), 2.0, 1.5)).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


def _chained(s, d):
    first, then = [[1, 0, 0, 1], [0, 2, 0, 0], [0, 0, 1, -1], [0, 0, 0, 1]], [[0.5, 0, 0, 0], [0, 1, 0.25, 3], [0, 0, 1, 0], [0, 0, 0, 1]]
    return G.chained(P.points(s, d), [first, then]).select("point_id", *(F.round(c, 6).alias(c) for c in "zyx"))


def _jacobian(s, d):
    """Volumes of the annotation's structures after an affine map."""
    grows = abs(G.affine_jacobian([[2, 0.5, 0, 9], [0, 1.5, 0, 9], [0.25, 0, -1, 9], [0, 0, 0, 1]]))
    return P.annotation(s, d).groupBy("id").agg(F.round(F.count(F.lit(1)) * grows, 6).alias("volume"))


def _objects(s, d):
    return pipelines.structure_objects(P.structures(s, d), P.masses(s, d)).withColumn("children", F.array_join(F.col("children").cast("array<string>"), ","))


def _totals(s, d):
    return pipelines.structure_totals(P.brain_masses(s, d), P.structures(s, d))


def _nodes(s, d):
    return pipelines.network(P.structures(s, d), _totals(s, d))[0]


def _edges(s, d):
    return pipelines.network(P.structures(s, d), _totals(s, d))[1]


def _activated(s, d):
    return inference.activated(P.voxels(s, d), lambda v: 1 / (1 + np.exp(-v))).select("z", "y", "x", F.round("v", 6).alias("v"))


def _sections(s, d):
    """Every section less its mean."""
    return inference.per_section(P.voxels(s, d), lambda pdf: pdf.assign(v=pdf["v"] - pdf["mean"]), {"mean": F.avg("v")}).select("z", "y", "x", F.round("v", 6).alias("v"))


def _composed(s, d):
    dims = _dims(s, d)
    out = augment.composed(P.voxels(s, d), lambda v: augment.flip(v, dims, "z"), lambda v: augment.gray(v, 0.8, 0.1, 0.0), lambda v: augment.occlude(v, [((0, 3, 0), (60, 6, 9))], 0.25))
    return out.select("z", "y", "x", F.round("v", 6).alias("v"))


def _rectangles(s, d):
    """A rectangle in a plane for each supplier; its sides lie between pixels."""
    rows = P.table(s, d, "supplier").selectExpr("cast(s_suppkey % 60 as int) as z", "s_nationkey % 17 + 0.5D as y", "s_suppkey % 13 + 0.5D as x", "s_suppkey % 7 + 1.0D as h", "s_nationkey % 5 + 1.0D as w")
    corner = lambda i, j: F.struct((F.col("y") + i * F.col("h")).alias("y"), (F.col("x") + j * F.col("w")).alias("x"))
    return rows.select("z", F.array(corner(0, 0), corner(0, 1), corner(1, 1), corner(1, 0)).alias("pts"))


QUERIES = {
    "s16_parameters": _stored,
    "o7_first_match": _first,
    "f18_chunks": lambda s, d: P.table(s, d, "orders").select("o_orderkey", maths.chunk_of(F.col("o_orderkey") % 1000, 7, 1000).alias("chunk")),
    "f19_sorted_entries": _sorted,
    "f20_updated": _updated,
    "f22_json": lambda s, d: P.table(s, d, "events").select("event_id", text.json_value(F.col("props"), "$.k", "bigint").alias("k"), text.json_value(F.col("props"), "$.none", "bigint").alias("none")),
    "f24_last_metric": _metric,
    "j11_paired": _paired,
    "w8_valid_places": _valid,
    "p8_contour_filter": _contour_filter,
    "g5_chained": _chained,
    "g6_jacobian": _jacobian,
    "h4_structure_objects": _objects,
    "h8_nodes": _nodes,
    "h8_edges": _edges,
    "e1_activated": _activated,
    "e2_per_section": _sections,
    "m2_composed": _composed,
    "v22_filled": lambda s, d: edges.filled(_rectangles(s, d)),
    "v22_erased": lambda s, d: edges.erase(P.voxels(s, d), _rectangles(s, d)).select("z", "y", "x", "v"),
    "c4_jobs": lambda s, d: catalog.jobs(catalog.parsed(P.tiles(s, d)), 4),
}

_INSIDE = "r as (select (s_suppkey % 60)::int as z, s_nationkey % 17 + 1 as y0, s_suppkey % 13 + 1 as x0, s_suppkey % 7 + 1 as h, s_nationkey % 5 + 1 as w from supplier), rows as (select z, unnest(range(y0, y0 + h))::int as y, x0, w from r), inside as (select distinct z, y, unnest(range(x0, x0 + w))::int as x from rows)"
_TREE = f"with recursive {P.STRUCTURES}, {P.CLOSURE}"
ORACLES = {
    "s16_parameters": "with p as (select 'e' || c_nationkey as expt, c_name as key, case when c_custkey % 3 = 0 then c_mktsegment else c_custkey::varchar end as value from customer), c as (select expt, key, case when value like '%7' then '-' || value else value end as value from p) select *, try_cast(value as double) as number from c",
    "o7_first_match": "select l_suppkey, l_orderkey, l_linenumber, l_partkey, l_quantity from lineitem where l_quantity > 45 qualify row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_quantity) = 1",
    "f18_chunks": "select o_orderkey, ((o_orderkey % 1000) * 7 // 1000)::int as chunk from orders",
    "f19_sorted_entries": "with e as (select n_nationkey, unnest([n_name, 'middle', 'AAA']) as k, unnest([n_nationkey, n_regionkey, 1]) as v from nation) select n_nationkey, string_agg(k || '=' || v, ',' order by k) as entries from e group by 1",
    "f20_updated": "with e as (select o_orderkey, unnest(['a', o_orderstatus, 'b']) as k, unnest([o_orderkey, 0, o_custkey + 1]) as v from orders) select o_orderkey, string_agg(k || '=' || v, ',' order by k) as entries from e group by 1",
    "f22_json": "select event_id, regexp_extract(props, '\"k\": (\\d+)', 1)::bigint as k, null::bigint as none from events",
    "f24_last_metric": "select user_id as log, max(event_id) + 0.5::double as metric from events where event_id % 7 = 0 group by 1",
    "j11_paired": "select distinct 'v' || o_orderkey as stem, '/im/v' || o_orderkey || '.tif' as left_path, '/roi/a/v' || o_orderkey || '.zip' as right_path from orders where o_orderkey in (select l_orderkey from lineitem)",
    "w8_valid_places": f"with {P.VOXELS} select z, y, x from voxels where z >= 5 and z + 5 < 60 and y >= 6 and y + 5 < 40 and x >= 2 and x + 2 <= (select max(x) from voxels)",
    "p8_contour_filter": "select l_orderkey, count(*) as n from lineitem where l_extendedprice / 10 > 500 / 2.0::double and l_extendedprice / 10 < 6000 / 1.5::double and l_discount * 10 > 0.3::double and l_quantity > 20 group by 1",
    "g5_chained": f"with {P.POINTS} select point_id, round(0.5 * (z + 1), 6) as z, round(2 * y + 0.25 * (x - 1) + 3, 6) as y, round(x - 1, 6) as x from points",
    "g6_jacobian": f"with {P.ANNOTATION} select id, round(count(*) * 3.0::double, 6) as volume from annotation group by 1",
    "h4_structure_objects": f"{_TREE}, {P.MASSES}, kids as (select parent_structure_id as id, string_agg(id::varchar, ',' order by id) as children from structures where parent_structure_id is not null group by 1), lv as (select descendant_id as id, max(depth) as level from closure group by 1), bl as (select ancestor_id as id, count(*) - 1 as below from closure group by 1), t as (select ancestor_id as id, sum(cell_count)::bigint as total from closure join masses m on m.id = descendant_id group by 1) select s.id, s.name, p.name as parent_name, coalesce(children, '') as children, level, below, coalesce(cell_count, 0) as own, coalesce(total, 0) as total from structures s left join structures p on p.id = s.parent_structure_id left join kids k on k.id = s.id join lv on lv.id = s.id join bl on bl.id = s.id left join masses m on m.id = s.id left join t on t.id = s.id",
    "h8_nodes": f"{_TREE}, {P.MASSES}, t as (select ancestor_id as id, sum(cell_count)::bigint as total from closure join masses m on m.id = descendant_id group by 1) select s.id, s.name, coalesce(total, 0) as size from structures s left join t using (id)",
    "h8_edges": f"with {P.STRUCTURES} select parent_structure_id as a, id as b, 1 as weight from structures where parent_structure_id is not null",
    "e1_activated": f"with {P.VOXELS} select z, y, x, round(1 / (1 + exp(-v)), 6) as v from voxels",
    "e2_per_section": f"with {P.VOXELS} select z, y, x, round(v - avg(v) over (partition by z), 6) as v from voxels",
    "m2_composed": f"with {P.VOXELS} select 59 - z as z, y, x, case when y between 3 and 5 and x < 9 then 0.25 else round(least(1, greatest(0, v * 0.8 + 0.1)), 6) end as v from voxels",
    "v22_filled": f"with {_INSIDE} select z, y, x from inside",
    "v22_erased": f"with {P.VOXELS}, {_INSIDE} select z, y, x, v from voxels where (z, y, x) not in (select (z, y, x) from inside)",
    "c4_jobs": f"with {P.TILES}, p as (select distinct z from tiles) select z, ((row_number() over (order by z) - 1) // 4)::int as job from p",
}
