"""Queries of lookup, counting, hierarchy and cohort operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxmere.operators import atlas, cohort, linkage, ontology
from voxmere.plans import pipelines
from voxmere.plans import projections as P

_DIMS = (60, 40, 20)
_LOOKUP = f"{P.POINTS}, {P.ANNOTATION}, located as (select p.*, a.id from points p join annotation a on a.z = trunc(p.z)::int and a.y = trunc(p.y)::int and a.x = trunc(p.x)::int where a.id <> 0)"


def _located(s, d):
    return atlas.lookup(P.points(s, d), P.annotation(s, d))


def _closed(s, d):
    return ontology.closure(P.structures(s, d))


def _pivot(s, d):
    counts = _located(s, d).groupBy("brain", "id").agg(F.count(F.lit(1)).alias("cell_count"))
    wide = cohort.pivoted(counts, [str(b) for b in range(1, 8)])
    return wide.select("id", *(F.col(str(b)).alias(f"brain_{b}") for b in range(1, 8)))


def _effect(s, d):
    rows = P.table(s, d, "lineitem").selectExpr("l_returnflag", "case when l_linenumber % 2 = 0 then 'a' else 'b' end as g", "l_quantity - 1 as q")
    return cohort.effect_size(rows, "g", "q", "a", "b", True, "l_returnflag").select("l_returnflag", F.round("d", 6).alias("d"))


def _matrix(s, d, column: str, key: str):
    rows = P.table(s, d, "lineitem")
    return rows.groupBy(F.col("l_linenumber").cast("string").alias("brain"), F.expr(key).alias("column")).agg(F.count(F.lit(1)).cast("double").alias("value"))


def _chains(s, d):
    st = P.structures(s, d)
    return ontology.chains(st, ontology.closure(st)).select("id", "name", F.concat_ws("<", "chain").alias("chain"))


def _edges(s, d):
    left = P.table(s, d, "nation").selectExpr("n_name as node", "cast(n_nationkey + n_regionkey as double) as value")
    right = P.table(s, d, "supplier").selectExpr("s_name as node", "cast(s_suppkey % 50 as double) as value")
    return cohort.score_edges(left, right, 0.8).select("a", "b", F.round("score", 9).alias("score"))


def _sunburst(s, d):
    st = P.structures(s, d)
    return ontology.sunburst(P.masses(s, d), ontology.closure(st), st).select("id", "parent_structure_id", "total", F.round("arc_from", 9).alias("arc_from"), F.round("arc_to", 9).alias("arc_to"))


def _distances(s, d):
    return linkage.distances(P.brain_masses(s, d), "id", "brain", "cell_count", digits=6)


QUERIES = {
    "h10_distances": _distances,
    "h10_linkage": lambda s, d: linkage.linkage_of_rows(P.brain_masses(s, d), "id", "brain", "cell_count").withColumn("height", F.round("height", 6)),
    "j1_lookup": lambda s, d: _located(s, d).select("brain", "point_id", "id"),
    "j2_region_counts": lambda s, d: atlas.region_counts(_located(s, d), P.structures(s, d)).select("id", "name", "cell_count"),
    "j2_region_counts_by_brain": lambda s, d: atlas.region_counts(_located(s, d), P.structures(s, d), "brain").select("brain", "id", "cell_count"),
    "j4_location_to_structure": lambda s, d: atlas.location_counts(P.points(s, d), P.annotation(s, d), P.structures(s, d)).select("id", "name", "n"),
    "p10_outside": lambda s, d: atlas.missed(P.points(s, d), _DIMS, "brain"),
    "p9_inside": lambda s, d: P.points(s, d).where(atlas.inside(_DIMS)).groupBy("brain").agg(F.count(F.lit(1)).alias("n")),
    "a2_voxel_overlap": lambda s, d: cohort.voxel_overlap(P.points(s, d)),
    "a3_cells_per_voxel": lambda s, d: atlas.per_voxel(P.points(s, d)),
    "a23_voxels_per_structure": lambda s, d: atlas.voxel_counts(P.annotation(s, d)),
    "a24_density": lambda s, d: atlas.density(P.annotation(s, d), atlas.region_counts(_located(s, d), P.structures(s, d))).select("z", "y", "x", F.round("v", 6).alias("v")),
    "p12_isolate": lambda s, d: atlas.isolate(P.annotation(s, d), [3, 5, 8]),
    "p14_crop": lambda s, d: atlas.crop(P.annotation(s, d), "10:50", "all", "4:"),
    "p14_mask": lambda s, d: atlas.mask(P.annotation(s, d), "10:50", ":30", "all"),
    "p13_replace": lambda s, d: atlas.replace_where(P.annotation(s, d).selectExpr("z", "y", "x", "cast(id as double) as v"), 7.0, 99.0, "0:30"),
    "a4_pivot": _pivot,
    "j5_parents": lambda s, d: ontology.with_parents(P.structures(s, d)).select("id", "parent_structure_id", "parent_name", "parent_acronym"),
    "h2_closure": lambda s, d: _closed(s, d),
    "a5_rollup": lambda s, d: ontology.rollup(P.masses(s, d), _closed(s, d)),
    "a6_matrix_rollup": lambda s, d: ontology.rollup(P.brain_masses(s, d), _closed(s, d), "brain"),
    "h3_chains": _chains,
    "h5_within_levels": lambda s, d: ontology.within_levels(_closed(s, d), 1001, 1),
    "h6_level_slice": lambda s, d: ontology.level_slice(_closed(s, d), P.structures(s, d), 0, 2),
    "h7_prune_leaves": lambda s, d: ontology.prune_leaves(P.structures(s, d), P.annotation(s, d)).select("id", "name"),
    "v19_consolidate": lambda s, d: ontology.consolidate(P.annotation(s, d), _closed(s, d), P.structures(s, d).where("id between 1000 and 1003")),
    "h9_level_totals": lambda s, d: pipelines.structure_totals(P.brain_masses(s, d), P.structures(s, d), ancestor=0, level=2),
    "h9_named_totals": lambda s, d: pipelines.structure_totals(P.brain_masses(s, d), P.structures(s, d), containing="1"),
    "g7_counts": lambda s, d: pipelines.count_in_atlas(P.points(s, d), P.annotation(s, d), P.structures(s, d), (62, 42, 22), (62, 42, 22), ("0", "1", "2"), [[[1, 0, 0, 1], [0, 1, 0, -2], [0, 0, 1, 0], [0, 0, 0, 1]]]).select("id", "cell_count"),
    "h13_sunburst": _sunburst,
    "h11_score_edges": _edges,
    "a15_effect_size": _effect,
    "a18_matrix_product": lambda s, d: cohort.product(_matrix(s, d, "x", "concat('n', l_suppkey % 25)"), _matrix(s, d, "y", "concat('p', l_partkey % 10)")),
    "p18_nonzero": lambda s, d: cohort.nonzero(_matrix(s, d, "x", "cast(l_partkey % 200 as string)").withColumn("value", F.expr("case when cast(column as int) % 3 = 0 then 0 else value end")), "column", "value"),
    "a12_regression": lambda s, d: cohort.regression(P.table(s, d, "lineitem"), "l_extendedprice", "l_quantity", "l_returnflag").select("l_returnflag", F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept")),
    "a19_running_averages": lambda s, d: cohort.running_averages(P.log(s, d), 500).select("phase", "metric", F.col("flush").cast("long").alias("flush"), F.round("value", 6).alias("value")),
    "w13_subsampled": lambda s, d: cohort.subsampled(P.log(s, d), 7).select("phase", "metric", "iter"),
    "a25_balance": lambda s, d: cohort.balance(P.table(s, d, "lineitem").selectExpr("case when l_quantity > 40 then 1 else 0 end as t"), "t").select(F.round("w_positive", 9).alias("w_positive"), F.round("w_negative", 9).alias("w_negative")),
    "a26_losses": lambda s, d: cohort.losses(P.table(s, d, "lineitem").selectExpr("l_quantity / 10 - 2 as x", "cast(l_linenumber % 2 as double) as t", "l_discount as w"), "x", "t", "w").select(F.round("bce", 4).alias("bce"), F.round("mse", 4).alias("mse"), F.round("n", 4).alias("n")),
    "a16_bic": lambda s, d: cohort.bic(P.embeddings(s, d), "label", "embedding", 64).select(F.round("bic", 2).alias("bic")),
    "a16_silhouette": lambda s, d: cohort.silhouette(P.embeddings(s, d), "label", "embedding", "vec_id").select(F.round("silhouette", 5).alias("silhouette")),
    "p17_open_interval": lambda s, d: cohort.p_between(P.table(s, d, "lineitem"), "l_discount", 0.02, 0.05).groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n")),
    "o6_ranked": lambda s, d: cohort.ranked(P.table(s, d, "supplier").selectExpr("s_nationkey", "s_suppkey", "s_acctbal"), "s_acctbal", "s_nationkey").select("s_suppkey", F.col("rank").cast("long").alias("rank")),
}

_C = f"with recursive {P.STRUCTURES}, {P.CLOSURE}"
ORACLES = {
    "h10_distances": f"with {P.BRAIN_MASSES}, m as (select i.id, b.brain, coalesce(n.cell_count, 0)::double as v from (select distinct id from brain_masses) i cross join (select distinct brain from brain_masses) b left join brain_masses n on n.id = i.id and n.brain = b.brain), k as (select id from m group by 1 having max(v) > min(v)) select a.id as a, b.id as b, round(1 - corr(a.v, b.v), 6) as d from m a join m b on a.brain = b.brain and a.id < b.id where a.id in (select id from k) and b.id in (select id from k) group by 1, 2",
    "j1_lookup": f"with {_LOOKUP} select brain, point_id, id from located",
    "j2_region_counts": f"with {_LOOKUP}, {P.STRUCTURES} select s.id, s.name, count(l.id) as cell_count from structures s left join located l using (id) group by s.id, s.name",
    "j2_region_counts_by_brain": f"with {_LOOKUP}, {P.STRUCTURES} select b.brain, s.id, count(l.id) as cell_count from structures s cross join (select distinct brain from located) b left join located l on l.id = s.id and l.brain = b.brain group by 1, 2",
    "j4_location_to_structure": f"with {_LOOKUP}, {P.STRUCTURES} select id, name, count(*) as n from located join structures using (id) group by 1, 2",
    "p10_outside": f"with {P.POINTS} select brain, count(*) filter (where not (trunc(z)::int between 0 and 59 and trunc(y)::int between 0 and 39 and trunc(x)::int between 0 and 19)) as n_outside, count(*) as n_points from points group by 1",
    "p9_inside": f"with {P.POINTS} select brain, count(*) as n from points where z < 60 and y < 40 and x < 20 group by 1",
    "a2_voxel_overlap": f"with {P.POINTS} select trunc(z)::int as z, trunc(y)::int as y, trunc(x)::int as x, count(distinct brain) as n_brains from points group by 1, 2, 3",
    "a3_cells_per_voxel": f"with {P.POINTS} select trunc(z)::int as z, trunc(y)::int as y, trunc(x)::int as x, count(*) as n from points group by 1, 2, 3",
    "a23_voxels_per_structure": f"with {P.ANNOTATION} select id, count(*) as voxels_in_structure from annotation where id <> 0 group by 1",
    "a24_density": f"with {_LOOKUP}, {P.STRUCTURES}, c as (select s.id, count(l.id) as n from structures s left join located l using (id) group by 1), m as (select min(n) as lo, max(n) as hi from c) select z, y, x, round((n - lo) * 255.0::double / (hi - lo), 6) as v from annotation join c using (id), m",
    "p12_isolate": f"with {P.ANNOTATION} select z, y, x, 255 as v from annotation where id in (3, 5, 8)",
    "p14_crop": f"with {P.ANNOTATION} select z - 10 as z, y, x - 4 as x, id from annotation where z >= 10 and z < 50 and x >= 4",
    "p14_mask": f"with {P.ANNOTATION} select z, y, x, id from annotation where z >= 10 and z < 50 and y < 30",
    "p13_replace": f"with {P.ANNOTATION} select z, y, x, case when z >= 0 and z < 30 and id = 7 then 99.0::double else id::double end as v from annotation",
    "a4_pivot": f"with {_LOOKUP} select id, " + ", ".join(f"count(*) filter (where brain = '{b}') as brain_{b}" for b in range(1, 8)) + " from located group by 1",
    "j5_parents": f"with {P.STRUCTURES} select s.id, s.parent_structure_id, p.name as parent_name, p.acronym as parent_acronym from structures s left join structures p on p.id = s.parent_structure_id",
    "h2_closure": f"{_C} select * from closure",
    "a5_rollup": f"{_C}, {P.MASSES} select ancestor_id as id, coalesce(sum(cell_count), 0)::bigint as total from closure c left join masses m on m.id = c.descendant_id group by 1",
    "a6_matrix_rollup": f"{_C}, {P.BRAIN_MASSES} select b.brain, ancestor_id as id, coalesce(sum(cell_count), 0)::bigint as total from closure c cross join (select distinct brain from brain_masses) b left join brain_masses m on m.id = c.descendant_id and m.brain = b.brain group by 1, 2",
    "h3_chains": f"{_C} select s.id, s.name, coalesce(string_agg(p.name, '<' order by depth), '') as chain from structures s left join closure c on c.descendant_id = s.id and depth > 0 and ancestor_id <> 0 left join structures p on p.id = c.ancestor_id where s.name <> 'root' group by 1, 2",
    "h5_within_levels": f"{_C} select descendant_id as id, depth from closure where ancestor_id = 1001 and depth <= 1",
    "h6_level_slice": f"{_C} select descendant_id as id, depth from closure c where ancestor_id = 0 and (depth = 2 or (depth < 2 and not exists (select 1 from structures s where s.parent_structure_id = c.descendant_id)))",
    "h7_prune_leaves": f"with {P.STRUCTURES}, {P.ANNOTATION}, s as (select * from structures) select id, name from s where exists (select 1 from s c where c.parent_structure_id = s.id) or id in (select id from annotation)",
    "v19_consolidate": f"{_C}, {P.ANNOTATION}, p as (select id, floor(row_number() over (order by id) * 255.0 / count(*) over ())::int as v from structures where id between 1000 and 1003) select z, y, x, v from annotation a join closure c on c.descendant_id = a.id join p on p.id = c.ancestor_id",
    "h13_sunburst": f"{_C}, {P.MASSES}, t as (select ancestor_id as id, coalesce(sum(cell_count), 0) as total from closure c left join masses m on m.id = c.descendant_id group by 1), u as (select id, parent_structure_id, total, sum(total) over (partition by parent_structure_id order by id) as upto, sum(total) over (partition by parent_structure_id) as whole from t join structures using (id)) select id, parent_structure_id, total::bigint as total, round(((upto - total) / nullif(whole, 0))::double, 9) as arc_from, round((upto / nullif(whole, 0))::double, 9) as arc_to from u",
    "h9_level_totals": f"{_C}, {P.BRAIN_MASSES}, t as (select b.brain, ancestor_id as id, coalesce(sum(cell_count), 0)::bigint as total from closure c cross join (select distinct brain from brain_masses) b left join brain_masses m on m.id = c.descendant_id and m.brain = b.brain group by 1, 2) select brain, id, name, total from t join structures using (id) where id in (select descendant_id from closure where ancestor_id = 0 and depth = 2)",
    "h9_named_totals": f"{_C}, {P.BRAIN_MASSES}, t as (select b.brain, ancestor_id as id, coalesce(sum(cell_count), 0)::bigint as total from closure c cross join (select distinct brain from brain_masses) b left join brain_masses m on m.id = c.descendant_id and m.brain = b.brain group by 1, 2) select brain, id, name, total from t join structures using (id) where contains(name, '1')",
    "g7_counts": f"with {P.POINTS}, {P.ANNOTATION}, {P.STRUCTURES}, l as (select a.id from points p join annotation a on a.z = trunc(p.z + 1)::int and a.y = trunc(p.y - 2)::int and a.x = trunc(p.x)::int where a.id <> 0) select s.id, count(l.id) as cell_count from structures s left join l using (id) group by 1",
    "h11_score_edges": "with l as (select n_name as a, (n_nationkey + n_regionkey)::double as v from nation), r as (select s_name as b, (s_suppkey % 50)::double as v from supplier) select a, b, round((l.v / (select max(v) from l) + r.v / (select max(v) from r)) / 2, 9) as score from l, r where l.v > 0 and r.v > 0 and (l.v / (select max(v) from l) + r.v / (select max(v) from r)) / 2 > 0.8",
    "a15_effect_size": "with v as (select l_returnflag, l_linenumber % 2 as g, log10(l_quantity - 1) as q from lineitem where l_quantity <> 1), s as (select l_returnflag, count(q) filter (where g = 0) as na, count(q) filter (where g = 1) as nb, avg(q) filter (where g = 0) as ma, avg(q) filter (where g = 1) as mb, var_samp(q) filter (where g = 0) as va, var_samp(q) filter (where g = 1) as vb from v group by 1) select l_returnflag, round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 6) as d from s",
    "a18_matrix_product": "with l as (select l_linenumber as b, 'n' || (l_suppkey % 25)::varchar as i, count(*)::double as v from lineitem group by 1, 2), r as (select l_linenumber as b, 'p' || (l_partkey % 10)::varchar as j, count(*)::double as v from lineitem group by 1, 2) select i, j, sum(l.v * r.v) as value from l join r using (b) group by 1, 2",
    "p18_nonzero": "select l_linenumber::varchar as brain, (l_partkey % 200)::varchar as \"column\", count(*)::double as value from lineitem where (l_partkey % 200) % 3 <> 0 group by 1, 2",
    "a12_regression": "select l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 4) as intercept from lineitem group by 1",
    "a19_running_averages": f"with {P.LOG} select phase, metric, iter // 500 as flush, round(sum(num) / sum(den), 6) as value from log group by 1, 2, 3",
    "w13_subsampled": f"with {P.LOG} select phase, metric, iter from log where iter % 7 = 0",
    "a25_balance": "with p as (select least(0.95, greatest(0.05, avg(case when l_quantity > 40 then 1.0 else 0.0 end)))::double as p from lineitem) select round(1 / (2 * p), 9) as w_positive, round(1 / (2 * (1 - p)), 9) as w_negative from p",
    "a26_losses": "with r as (select l_quantity / 10 - 2 as x, (l_linenumber % 2)::double as t, l_discount as w from lineitem) select round(sum(w * (greatest(x, 0) - x * t + ln(1 + exp(-abs(x))))), 4) as bce, round(sum(w * (x - t) * (x - t)), 4) as mse, round(sum(w), 4) as n from r",
    "a16_bic": "with p as (select label, unnest(range(64)) as i, unnest(embedding)::double as x from embeddings), s as (select label, i, var_pop(x) as v, count(*) as n from p group by 1, 2), c as (select label, sum(v * n) as ss, max(n) as n from s group by 1), t as (select sum(ss) as ss, sum(n)::double as r, count(*)::double as m, sum(n * ln(n)) as nlogn from c) select round(nlogn - r * ln(r) - r * 64 / 2 * ln(2 * 3.141592653589793 * (ss / (r - m) / 64)) - (r - m) * 64 / 2 - 0.5 * m * ln(r) * 65, 2) as bic from t",
    "a16_silhouette": "with e as (select vec_id, label, embedding::double[] as v from embeddings), p as (select a.vec_id, a.label, b.label as c, avg(list_distance(a.v, b.v)) as d from e a join e b on a.vec_id <> b.vec_id group by 1, 2, 3), s as (select vec_id, max(d) filter (where c = label) as a, min(d) filter (where c <> label) as b from p group by 1) select round(avg(case when a is null then 0 else (b - a) / greatest(a, b) end), 5) as silhouette from s",
    "p17_open_interval": "select l_linenumber, count(*) as n from lineitem where l_discount > 0.02 and l_discount < 0.05 group by 1",
    "o6_ranked": "select s_suppkey, row_number() over (partition by s_nationkey order by s_acctbal desc, s_suppkey) as rank from supplier",
}
