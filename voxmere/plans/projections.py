"""The driver's tables read as volumes, points, annotations, hierarchies, logs and tiles; each with the same as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("cast(l_partkey % 60 as int) as z", "cast(l_suppkey % 40 as int) as y", "cast(l_orderkey div 100 as int) as x", "(l_quantity - 1) / 49 as v")
    # eight parts for each split that is read: what a task holds of the volume does not grow with the table
    dealt = rows.repartition(8 * rows.rdd.getNumPartitions(), "z", "y", "x")
    return dealt.groupBy("z", "y", "x").agg(F.max("v").alias("v")).select(F.lit("a").alias("volume_id"), "z", "y", "x", "v")


VOXELS = "voxels as (select 'a' as volume_id, (l_partkey % 60)::int as z, (l_suppkey % 40)::int as y, (l_orderkey // 100)::int as x, max((l_quantity - 1) / 49) as v from lineitem group by 2, 3, 4)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "cast(l_linenumber as string) as brain", "l_orderkey * 10 + l_linenumber as point_id", "l_partkey % 62 + l_quantity / 100 - 0.25 as z", "(l_partkey div 62) % 42 + l_quantity / 100 - 0.25 as y", "l_suppkey % 22 + l_quantity / 100 - 0.25 as x"
    )


POINTS = "points as (select l_linenumber::varchar as brain, l_orderkey * 10 + l_linenumber as point_id, l_partkey % 62 + l_quantity / 100 - 0.25 as z, (l_partkey // 62) % 42 + l_quantity / 100 - 0.25 as y, l_suppkey % 22 + l_quantity / 100 - 0.25 as x from lineitem)"


def annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("cast(p_partkey % 60 as int) as z", "cast((p_partkey div 60) % 40 as int) as y", "explode(sequence(0, 19)) as x", "p_size", "p_partkey")
    return rows.groupBy("z", "y", "x").agg(F.max(F.expr("cast((p_size + x) % 26 as bigint)")).alias("id"))


ANNOTATION = "annotation as (select z, y, x, max((p_size + x) % 26)::bigint as id from (select (p_partkey % 60)::int as z, ((p_partkey // 60) % 40)::int as y, unnest(range(20))::int as x, p_size from part) group by z, y, x)"


def structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest: root 0, regions 1000 + key, nations as ids 1 to 25 (nation key + 1), suppliers 10000 + key."""
    root = spark.range(1).selectExpr("cast(0 as bigint) as id", "'root' as name", "'r' as acronym", "cast(null as bigint) as parent_structure_id")
    region = table(spark, sf_dir, "region").selectExpr("cast(1000 + r_regionkey as bigint)", "r_name", "lower(substring(r_name, 1, 3))", "cast(0 as bigint)")
    nation = table(spark, sf_dir, "nation").selectExpr("cast(n_nationkey + 1 as bigint)", "n_name", "lower(substring(n_name, 1, 4))", "cast(1000 + n_regionkey as bigint)")
    supplier = table(spark, sf_dir, "supplier").selectExpr("cast(10000 + s_suppkey as bigint)", "s_name", "concat('s', cast(s_suppkey as string))", "cast(s_nationkey + 1 as bigint)")
    return root.union(region).union(nation).union(supplier)


STRUCTURES = """structures as (
  select 0::bigint as id, 'root' as name, 'r' as acronym, null::bigint as parent_structure_id
  union all select (1000 + r_regionkey)::bigint, r_name, lower(substr(r_name, 1, 3)), 0 from region
  union all select (n_nationkey + 1)::bigint, n_name, lower(substr(n_name, 1, 4)), 1000 + n_regionkey from nation
  union all select (10000 + s_suppkey)::bigint, s_name, 's' || s_suppkey::varchar, s_nationkey + 1 from supplier)"""

CLOSURE = """closure as (
  select id as ancestor_id, id as descendant_id, 0 as depth from structures
  union all select c.ancestor_id, s.id, c.depth + 1 from closure c join structures s on s.parent_structure_id = c.descendant_id)"""


def masses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.expr("cast(10000 + l_suppkey as bigint)").alias("id")).agg(F.count(F.lit(1)).alias("cell_count"))


MASSES = "masses as (select (10000 + l_suppkey)::bigint as id, count(*) as cell_count from lineitem group by 1)"


def brain_masses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.expr("cast(l_linenumber as string)").alias("brain"), F.expr("cast(10000 + l_suppkey as bigint)").alias("id")).agg(F.count(F.lit(1)).alias("cell_count"))


BRAIN_MASSES = "brain_masses as (select l_linenumber::varchar as brain, (10000 + l_suppkey)::bigint as id, count(*) as cell_count from lineitem group by 1, 2)"


def annotators(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two annotators' points by day of the month: even and odd events."""
    e = table(spark, sf_dir, "events").selectExpr("cast(day(ts) as int) as day", "event_id as idx", "event_id % 2 as side", "cast(user_id % 40 as double) as z", "cast(hour(ts) as double) as y", "floor(value) % 50 * 1.0D as x")
    return e.where("side = 0").drop("side"), e.where("side = 1").drop("side")


ANNOTATORS = "e as (select day(ts)::int as day, event_id as idx, event_id % 2 as side, (user_id % 40)::double as z, hour(ts)::double as y, (floor(value) % 50)::double as x from events), truth as (select * from e where side = 0), pred as (select * from e where side = 1)"


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("case when event_id % 5 = 0 then 'test' else 'train' end as phase", "event_id as iter", "event_type as metric", "value as num", "1.0D + event_id % 3 as den")


LOG = "log as (select case when event_id % 5 = 0 then 'test' else 'train' end as phase, event_id as iter, event_type as metric, value as num, 1.0 + event_id % 3 as den from events)"


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names of planes built from orders; a few planes lack a tile."""
    return table(spark, sf_dir, "orders").selectExpr(
        "format_string('/raw/b1/x_[%02d x %02d]_C%02d_xyz-Table Z%04d_UltraII Filter%04d.ome.tif', cast(o_orderkey % 3 as int), cast((o_orderkey div 3) % 2 as int), cast((o_orderkey div 6) % 2 as int), cast(o_orderkey div 24 as int), cast((o_orderkey div 12) % 2 as int)) as path",
        "cast(1000 + o_totalprice % 97 as bigint) as length",
    ).where("path not like '%Z0007%Filter0001%' or path like '%[00%'")


TILES = """raw as (select o_orderkey as k, o_totalprice from orders),
tiles as (select k, (k % 3)::int as y, ((k // 3) % 2)::int as x, ((k // 6) % 2)::int as ls, (k // 24)::int as z, ((k // 12) % 2)::int as ch, (1000 + o_totalprice % 97) as f from raw where not ((k // 24) = 7 and ((k // 12) % 2) = 1 and k % 3 <> 0))"""


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")
