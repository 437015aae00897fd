"""Region hierarchy: closure, roll-ups, levels, chains. The tree is unbalanced and need not have one root."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxmere.operators.graph import cut

#: Rows that are left out of ancestor chains and of their result.
TOP_NAMES = ("root", "Basic cell groups and regions")


def closure(structure: DataFrame, deepest: int = 64) -> DataFrame:
    """H2: (ancestor_id, descendant_id, depth) with every node as its own ancestor at depth 0.

    One join per level of the tree; rows that are repeated in the table count once (by id).
    """
    child = structure.select(F.col("id").alias("child"), F.col("parent_structure_id").alias("parent")).where("parent is not null and parent <> child").distinct()
    level = structure.select(F.col("id").alias("ancestor_id"), F.col("id").alias("descendant_id")).distinct().withColumn("depth", F.lit(0))
    level = cut(level)
    out = level
    for depth in range(1, deepest + 1):
        level = cut(level.join(child, F.col("descendant_id") == F.col("parent")).select("ancestor_id", F.col("child").alias("descendant_id"), F.lit(depth).alias("depth")))
        if level.isEmpty():
            return out
        out = out.unionByName(level)
    raise ValueError(f"the hierarchy is deeper than {deepest} levels or has a cycle")


def rollup(counts: DataFrame, closed: DataFrame, *by: str, count: str = "cell_count") -> DataFrame:
    """For each ancestor its own count and those of all descendants; nodes without counts have 0."""
    own = counts.select(*by, F.col("id").alias("descendant_id"), count)
    summed = closed.join(own, "descendant_id").groupBy(*by, F.col("ancestor_id").alias("id")).agg(F.sum(count).alias("total"))
    nodes = closed.where("depth = 0").select(F.col("ancestor_id").alias("id"))
    every = nodes.crossJoin(counts.select(*by).distinct()) if by else nodes
    return every.join(summed, [*by, "id"], "left").fillna(0, ["total"])


def chains(structure: DataFrame, closed: DataFrame) -> DataFrame:
    """H3: the names of a node's ancestors, nearest first, without the top rows; the top rows themselves are left out."""
    names = structure.where(~F.col("name").isin(*TOP_NAMES)).select("id", "name")
    above = closed.where("depth > 0").join(names.select(F.col("id").alias("ancestor_id"), "name"), "ancestor_id")
    listed = above.groupBy(F.col("descendant_id").alias("id")).agg(F.expr("transform(array_sort(collect_list(struct(depth, name))), s -> s.name)").alias("chain"))
    return names.join(listed, "id", "left").withColumn("chain", F.coalesce("chain", F.array().cast("array<string>")))


def within_levels(closed: DataFrame, ancestor: int, levels: int) -> DataFrame:
    """H5: nodes at most so many steps below an ancestor, itself included."""
    return closed.where((F.col("ancestor_id") == ancestor) & (F.col("depth") <= levels)).select(F.col("descendant_id").alias("id"), "depth")


def leaves(structure: DataFrame) -> DataFrame:
    """Ids that are nobody's parent."""
    return structure.select("id").join(structure.select(F.col("parent_structure_id").alias("id")).where("id is not null").distinct(), "id", "left_anti")


def level_slice(closed: DataFrame, structure: DataFrame, ancestor: int, level: int) -> DataFrame:
    """H6: nodes exactly so many steps below an ancestor, and leaves above that level."""
    end = leaves(structure).withColumn("is_leaf", F.lit(True))
    near = within_levels(closed, ancestor, level).join(end, "id", "left")
    return near.where((F.col("depth") == level) | F.col("is_leaf")).select("id", "depth")


def prune_leaves(structure: DataFrame, annotation: DataFrame) -> DataFrame:
    """H7: structure without the leaves that the annotation does not hold; inner nodes stay."""
    absent = leaves(structure).join(annotation.select("id").distinct(), "id", "left_anti")
    return structure.join(absent, "id", "left_anti")


def with_parents(structure: DataFrame) -> DataFrame:
    """Name and acronym of each row's parent, null where there is none."""
    up = structure.select(F.col("id").alias("parent_structure_id"), F.col("name").alias("parent_name"), F.col("acronym").alias("parent_acronym")).dropDuplicates(["parent_structure_id"])
    return structure.drop("parent_name", "parent_acronym").join(up, "parent_structure_id", "left")


def consolidate(annotation: DataFrame, closed: DataFrame, parents: DataFrame) -> DataFrame:
    """Voxels of the parents' descendants get the parent's value; values are spread evenly over 0 to 255 in order of id."""
    order = Window.orderBy("id")  # over the list of parents, which a caller writes by hand
    n = parents.select("id").distinct()
    ranked = n.withColumn("k", F.row_number().over(order)).crossJoin(F.broadcast(n.agg(F.count(F.lit(1)).alias("n"))))
    valued = ranked.select(F.col("id").alias("ancestor_id"), F.floor(F.col("k") * 255.0 / F.col("n")).cast("int").alias("v"))
    of = closed.join(valued, "ancestor_id").groupBy(F.col("descendant_id").alias("id")).agg(F.min_by("v", "depth").alias("v"))
    return annotation.join(of, "id").select("z", "y", "x", "v")


def sunburst(counts: DataFrame, closed: DataFrame, structure: DataFrame) -> DataFrame:
    """Each node's share of its parent and where its arc begins and ends among its siblings (ordered by id)."""
    total = rollup(counts, closed).join(structure.select("id", "parent_structure_id"), "id")
    siblings = Window.partitionBy("parent_structure_id").orderBy("id")
    end = F.sum("total").over(siblings.rowsBetween(Window.unboundedPreceding, 0))
    whole = F.sum("total").over(Window.partitionBy("parent_structure_id"))
    return total.select("id", "parent_structure_id", "total", ((end - F.col("total")) / F.nullif(whole, F.lit(0))).alias("arc_from"), (end / F.nullif(whole, F.lit(0))).alias("arc_to"))
