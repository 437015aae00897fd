"""Text files exchanged with external registration tools, and the region hierarchy's JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def point_lines(points: DataFrame) -> DataFrame:
    """Lines (ord, value): `index`, the number of points, then `x y z` of each in order of point_id."""
    head = points.agg(F.count(F.lit(1)).cast("string").alias("value")).select(F.lit(-1).cast("long").alias("ord"), "value")
    first = points.sparkSession.range(1).select(F.lit(-2).cast("long").alias("ord"), F.lit("index").alias("value"))
    return first.unionByName(head).unionByName(points.select(F.col("point_id").alias("ord"), F.concat_ws(" ", *(F.col(c).cast("string") for c in "xyz")).alias("value")))


def write_points(points: DataFrame, path: str) -> None:
    """As one text file, which the external tool reads as a whole."""
    point_lines(points).orderBy("ord").coalesce(1).select("value").write.text(path)


def read_transformed(lines: DataFrame, marker: str = "OutputPoint") -> DataFrame:
    """(point_id, z, y, x) from the tool's lines (value): the three tokens after `marker`, `=` and `[`."""
    tokens = lines.withColumn("t", F.split(F.trim("value"), r"\s+")).withColumn("p", F.array_position("t", marker)).where("p > 0")
    axis = {a: F.get("t", (F.col("p") + 2 + k).cast("int")).try_cast("double").alias(a) for k, a in enumerate("xyz")}
    return tokens.select(F.get("t", F.lit(1)).try_cast("long").alias("point_id"), axis["z"], axis["y"], axis["x"])


CELLS = "z double, y double, x double"


def read_cells(spark: SparkSession, path: str, order: tuple[str, str, str] = ("z", "y", "x"), header: bool = True) -> DataFrame:
    """Cell centres (z, y, x and further columns) of CSV files; without a header the first three columns are `order`."""
    raw = spark.read.option("header", header).csv(path)
    if not header:
        raw = raw.toDF(*order, *raw.columns[3:])
    rest = [c for c in raw.columns if c not in "zyx"]
    return raw.select(*(F.col(c).try_cast("double").alias(c) for c in "zyx"), *rest).where("z is not null and y is not null and x is not null")


def write_cells(cells: DataFrame, path: str) -> None:
    """The cell table as CSV files with a header, in as many files as it has partitions."""
    cells.write.option("header", True).csv(path)


def hierarchy(spark: SparkSession, path: str, deepest: int = 16) -> DataFrame:
    """The nested JSON of regions as rows (id, name, acronym, parent_structure_id).

    Children are lists of the same objects; each round takes one level apart. Parents' names are added by
    operators.ontology.with_parents.
    """
    node: T.DataType = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("acronym", T.StringType()), T.StructField("parent_structure_id", T.LongType())])
    for _ in range(deepest):
        node = T.StructType([*T.StructType.fromJson(node.jsonValue()).fields[:4], T.StructField("children", T.ArrayType(node))])
    level = spark.read.schema(T.StructType([T.StructField("msg", T.ArrayType(node))])).json(path, multiLine=True).select(F.explode("msg").alias("n"))
    out = None
    for _ in range(deepest + 1):
        rows = level.select("n.id", "n.name", "n.acronym", "n.parent_structure_id")
        out = rows if out is None else out.unionByName(rows)
        if "children" not in level.schema["n"].dataType.names:
            break
        level = level.select(F.explode("n.children").alias("n"))
    return out
