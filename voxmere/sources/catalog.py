"""Catalog of image planes from file names: patterns, planes and tiles, completeness, outliers, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The file name patterns that are tried in turn; groups are y, x, light sheet or channel, z (see FIELDS).
PATTERNS = (
    r"^.*\[(\d+) x (\d+)\]_C(\d+)_xyz-Table Z(\d+).*Filter(\d+).*\.tif$",
    r"^.*\[(\d+) x (\d+)\]_xyz-Table Z(\d+).*Filter(\d+).*\.tif$",
    r"^.*_C(\d+)_xyz-Table Z(\d+).*Filter(\d+).*\.tif$",
    r"^.*_C(\d+)_Z(\d+)\.tif$",
    r"^.*Z(\d+)\.tif$",
)
FIELDS = (("y", "x", "ls", "z", "ch"), ("y", "x", "z", "ch"), ("ls", "z", "ch"), ("ch", "z"), ("z",))


def files(spark: SparkSession, folder: str, keyword: str = "", recursive: bool = False) -> DataFrame:
    """(path, length) of files whose name holds a keyword; hidden files, backups and thumbnails are left out. Contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    name = F.element_at(F.split("path", "/"), -1)
    return reader.load(folder).select("path", "length").where(~name.startswith(".") & ~name.contains("~") & (name != "Thumbs.db") & name.contains(keyword))


def parsed(listing: DataFrame, path: str = "path", patterns: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Y, x, ls, z, ch of each name by the first pattern that matches it; fields a pattern lacks are 0, names that none matches are dropped.

    A caller's own patterns (expression: names of its groups) take the place of the fixed ones.
    """
    own = patterns or dict(zip(PATTERNS, FIELDS))
    name = F.element_at(F.split(path, "/"), -1)

    def number(field: str) -> Column:
        options = [F.when(name.rlike(p), F.regexp_extract(name, p, names.index(field) + 1).cast("int") if field in names else F.lit(0)) for p, names in own.items()]
        return F.coalesce(*options).alias(field)

    matched = F.lit(False)
    for p in own:
        matched |= name.rlike(p)
    return listing.where(matched).select("*", *(number(f) for f in ("y", "x", "ls", "z", "ch")))


def planes(catalog: DataFrame) -> DataFrame:
    """The files of each channel and plane as one list in order of (light sheet, y, x)."""
    tiles = F.array_sort(F.collect_list(F.struct("ls", "y", "x", "path")))
    return catalog.groupBy("ch", "z").agg(F.transform(tiles, lambda t: t["path"]).alias("paths"), F.count(F.lit(1)).alias("n"))


def geometry(catalog: DataFrame) -> DataFrame:
    """S3: tiles on each axis, light sheets, channels and planes. Tiles are counted by their number, not by its digits."""
    return catalog.agg((F.max("x") + 1).alias("xtile"), (F.max("y") + 1).alias("ytile"), F.countDistinct("ls").alias("lightsheets"), F.countDistinct("ch").alias("channels"), F.countDistinct("z").alias("planes"))


def bad_planes(catalog: DataFrame) -> DataFrame:
    """S3: planes of which some channel lacks tiles."""
    shape = geometry(catalog).select((F.col("xtile") * F.col("ytile") * F.col("lightsheets")).alias("expected"))
    per = catalog.groupBy("ch", "z").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(shape))
    present = per.groupBy("z").agg(F.count(F.lit(1)).alias("chs"), F.max(F.col("n") != F.col("expected")).alias("bad"))
    return present.crossJoin(F.broadcast(geometry(catalog).select("channels"))).where(F.col("bad") | (F.col("chs") != F.col("channels"))).select("z")


def complete(catalog: DataFrame) -> DataFrame:
    """The catalog without those planes, in all channels."""
    return catalog.join(bad_planes(catalog), "z", "left_anti")


def size_outliers(listing: DataFrame, deviations: float = 5.0) -> DataFrame:
    """Files whose size is further from the mean than so many population deviations."""
    stats = listing.agg(F.avg("length").alias("m"), F.stddev_pop("length").alias("sd"))
    return listing.crossJoin(F.broadcast(stats)).where(F.abs(F.col("length") - F.col("m")) > deviations * F.col("sd")).drop("m", "sd")


def missing(present: DataFrame, expected: int, column: str) -> DataFrame:
    """Numbers from 0 to expected - 1 that are absent."""
    return present.sparkSession.range(expected).select(F.col("id").cast("int").alias(column)).join(present.select(column).distinct(), column, "left_anti")


def pooled(parts: list[DataFrame]) -> DataFrame:
    """The rows of all parts; columns by name in order, absent ones null, index columns dropped."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.select(*sorted(c for c in out.columns if not c.startswith("Unnamed")))


def tree_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Listings (path relative to each root, length, digest) that are in one tree only."""
    cols = ["path", "length", "digest"]
    return a.select(cols).exceptAll(b.select(cols)).withColumn("side", F.lit("left")).unionByName(b.select(cols).exceptAll(a.select(cols)).withColumn("side", F.lit("right")))


def digested(spark: SparkSession, folder: str) -> DataFrame:
    """(path below the folder, length, digest of the contents)."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return read.select(F.regexp_replace("path", "^.*?" + folder.rstrip("/").replace(".", r"\.") + "/", "").alias("path"), "length", F.md5("content").alias("digest"))


def paired(left: DataFrame, right: DataFrame) -> DataFrame:
    """Images and their ROI or label files by equal stem (the name without its ending)."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return left.select(stem.alias("stem"), F.col("path").alias("left_path")).join(right.select(stem.alias("stem"), F.col("path").alias("right_path")), "stem")


def full_dims(catalog: DataFrame, tile: tuple[int, int]) -> DataFrame:
    """Planes of the full-size volume, and its rows and columns from the tiles of (height, width) side by side."""
    return catalog.agg((F.max("z") + 1).alias("zdim"), ((F.max("y") + 1) * tile[0]).alias("ydim"), ((F.max("x") + 1) * tile[1]).alias("xdim"))


def loss_log(lines: DataFrame) -> DataFrame:
    """(iter, metric, value) of the statistics lines `iter<TAB>metric<TAB>value` of a training run; other lines are left out."""
    parts = F.split("value", "\t")
    named = lines.select(F.get(parts, F.lit(0)).try_cast("long").alias("iter"), F.get(parts, F.lit(1)).alias("metric"), F.get(parts, F.lit(2)).try_cast("double").alias("value"))
    return named.where("iter is not null and value is not null")


def jobs(catalog: DataFrame, factor: int) -> DataFrame:
    """C4: which array job each plane belongs to, planes in order of z."""
    order = Window.orderBy("z")  # over planes, of which a volume has thousands
    return catalog.select("z").distinct().withColumn("job", F.floor((F.row_number().over(order) - 1) / factor).cast("int"))


def parameters(rows: DataFrame) -> DataFrame:
    """(expt, key, value) with the value's number where it is one; text is never evaluated."""
    return rows.withColumn("number", F.col("value").try_cast("double"))


def save_parameters(rows: DataFrame, path: str) -> None:
    """Parameters (expt, key, value) stored for other runs; values are text, keys of nested parameters are parted by dots."""
    rows.select(*(F.col(c).cast("string").alias(c) for c in ("expt", "key", "value"))).write.mode("overwrite").parquet(path)


def flat_parameters(spark: SparkSession, expt: str, values: dict) -> DataFrame:
    """A (nested) dictionary of a run's parameters as rows."""

    def rows(prefix: str, part: dict):
        for k, v in part.items():
            if isinstance(v, dict):
                yield from rows(f"{prefix}{k}.", v)
            else:
                yield expt, f"{prefix}{k}", None if v is None else str(v)

    return spark.createDataFrame(list(rows("", values)), "expt string, key string, value string")


def load_parameters(spark: SparkSession, path: str, changes: DataFrame | None = None) -> DataFrame:
    """Stored parameters with their numbers; `changes` (expt, key, value) replace or add to them."""
    stored = spark.read.schema("expt string, key string, value string").parquet(path)
    if changes is not None:
        stored = stored.join(changes.select("expt", "key"), ["expt", "key"], "left_anti").unionByName(changes.select("expt", "key", "value"))
    return parameters(stored)


def last_metric(lines: DataFrame) -> DataFrame:
    """the number of the last `Final metric value` line of each log (log, line_no, line)."""
    hit = lines.where(F.col("line").startswith("Final metric value"))
    return hit.groupBy("log").agg(F.max_by(F.regexp_extract("line", r"(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)\s*$", 1).cast("double"), "line_no").alias("metric"))
