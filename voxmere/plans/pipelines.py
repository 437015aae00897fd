"""The reference's end-to-end runs as single plans; array jobs and hand-over files are gone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmere.functions import geometry
from voxmere.operators import atlas, cohort, components, ontology
from voxmere.sources import exchange


def detect_cells(probability: DataFrame, ydim: int, xdim: int, lo: float, hi: float = 1.0, size: tuple[int, int] | None = None) -> DataFrame:
    """Probability voxels to the table of cells."""
    labelled = components.label(components.at_least(probability, lo, hi), ydim, xdim)
    if size:
        labelled = components.size_filter(labelled, *size)
    return components.measures(labelled, volume=probability)


def sites(volumes: DataFrame, ydim: int, xdim: int, k: float, n: int = 1) -> DataFrame:
    """The n largest sites of each volume that stand out by k deviations."""
    return components.largest(components.label(components.adaptive(volumes, k), ydim, xdim, 6), n)


def count_in_atlas(points: DataFrame, annotation: DataFrame, structure: DataFrame, full: tuple[int, int, int], small: tuple[int, int, int], axes: tuple[str, str, str], transforms: list) -> DataFrame:
    """Full-size points resampled, reoriented, moved by the transforms and counted by structure."""
    moved = geometry.chained(geometry.reorient(geometry.resample_points(points, full, small), small, axes), transforms)
    return atlas.region_counts(atlas.lookup(moved, annotation), structure)


def count_transformed(lines: DataFrame, annotation: DataFrame, structure: DataFrame) -> DataFrame:
    """The external tool's output counted by structure; no points at all is an error."""
    points = exchange.read_transformed(lines)
    if points.isEmpty():
        raise ValueError("the transformed points are empty")
    return atlas.region_counts(atlas.lookup(points, annotation), structure)


def pool(volumes: DataFrame, annotation: DataFrame, brains: list[str], ydim: int, xdim: int, k: float) -> tuple[DataFrame, DataFrame]:
    """K4: sites of every brain (volume_id) as a structure by brain matrix, and how many brains cover each voxel."""
    found = sites(volumes, ydim, xdim, k).withColumnRenamed("volume_id", "brain")
    counts = atlas.lookup(found, annotation).groupBy("brain", "id").agg(F.count(F.lit(1)).alias("cell_count"))
    return cohort.pivoted(counts, brains), cohort.voxel_overlap(found)


def structure_totals(counts: DataFrame, structure: DataFrame, names: list[str] | None = None, containing: str | None = None, ancestor: int | None = None, level: int | None = None) -> DataFrame:
    """Rolled-up counts by brain of a list of structures, of those whose name holds a text, or of a level below an ancestor."""
    closed = ontology.closure(structure)
    chosen = structure.select("id", "name")
    if names is not None:
        chosen = chosen.where(F.col("name").isin(names))
    if containing is not None:
        chosen = chosen.where(F.col("name").contains(containing))
    if ancestor is not None and level is not None:
        chosen = chosen.join(ontology.level_slice(closed, structure, ancestor, level).select("id"), "id", "left_semi")
    return ontology.rollup(counts, closed, "brain").join(chosen, "id").select("brain", "id", "name", "total")


def structure_objects(structure: DataFrame, counts: DataFrame) -> DataFrame:
    """H4: (id, name, parent_name, children, level, below, own, total): a structure with its sorted children, its depth below the root, how many are below it, and its own and rolled-up counts (id, cell_count)."""
    closed = ontology.closure(structure)
    parents = structure.select(F.col("id").alias("parent_structure_id"), F.col("name").alias("parent_name"))
    children = structure.where("parent_structure_id is not null").groupBy(F.col("parent_structure_id").alias("id")).agg(F.array_sort(F.collect_list(F.col("id"))).alias("children"))
    level = closed.groupBy(F.col("descendant_id").alias("id")).agg(F.max("depth").alias("level"))
    below = closed.groupBy(F.col("ancestor_id").alias("id")).agg((F.count(F.lit(1)) - 1).alias("below"))
    own = counts.groupBy("id").agg(F.sum("cell_count").alias("own"))
    total = closed.join(own, closed["descendant_id"] == own["id"]).groupBy(F.col("ancestor_id").alias("id")).agg(F.sum("own").alias("total"))
    out = structure.join(parents, "parent_structure_id", "left").join(children, "id", "left").join(level, "id").join(below, "id").join(own, "id", "left").join(total, "id", "left")
    return out.select("id", "name", "parent_name", F.coalesce("children", F.array().cast("array<bigint>")).alias("children"), "level", "below", F.coalesce("own", F.lit(0)).alias("own"), F.coalesce("total", F.lit(0)).alias("total"))


def network(structure: DataFrame, totals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """H8: nodes with their size and edges of weight 1 from parents to children."""
    nodes = structure.select("id", "name").join(totals.groupBy("id").agg(F.sum("total").alias("size")), "id", "left").fillna(0, ["size"])
    edges = structure.where("parent_structure_id is not null").select(F.col("parent_structure_id").alias("a"), F.col("id").alias("b"), F.lit(1).alias("weight"))
    return nodes, edges
