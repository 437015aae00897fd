"""Connected components of a table of links (H1), and the reliable checkpoints that iterations need."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names. Only a local session may do without; it gets a temporary one."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    current = context._jsc.sc().getCheckpointDir()
    if named or current.isDefined():
        return named or current.get()
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-voxmere-")


def cut(df: DataFrame) -> DataFrame:
    """Ends the lineage with a reliable checkpoint in spark.checkpoint.dir."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(checkpoint_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Ends the lineage with a Parquet table in the shared folder, which goes when the driver ends.

    For loops: a checkpoint keeps what the optimizer has inferred of its plan, and that doubles with each round of
    joins of a table with itself; a table that is read again starts afresh.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/voxmere-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


#: So many links and fewer are followed within one task.
FEW = 1 << 15


def _followed(edges: DataFrame) -> DataFrame:
    """(node, into) of a table of at most FEW links (u, v): one node stands for each component."""
    kind = edges.schema["u"].dataType.simpleString()

    def follow(batches):
        links = list(batches)
        if not links:
            return
        ends = pa.concat_arrays([c for b in links for c in (b["u"], b["v"])])
        number: dict = {}
        code = [number.setdefault(tuple(x.values()) if isinstance(x, dict) else x, i) for i, x in enumerate(ends.to_pylist())]
        root = list(range(len(code)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        at = 0
        for b in links:
            for k in range(at, at + len(b)):
                x, y = sorted((find(code[k]), find(code[k + len(b)])))
                root[y] = x
            at += 2 * len(b)
        nodes = sorted(number.values())
        yield pa.RecordBatch.from_arrays([ends.take(pa.array(nodes)), ends.take(pa.array([find(i) for i in nodes]))], names=["node", "into"])

    return edges.repartition(1).mapInArrow(follow, f"node {kind}, into {kind}")


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node of a link; component is the smallest node that is reachable.

    Randomised contraction: each round deals the nodes a new order by a hash, and every node joins the first of
    itself and its neighbours; links between the sets so made are the next round's, until none is left. Every
    connected node is as likely as its neighbours to come first, so a round leaves about half of a path and less of
    anything denser, whatever the ids: rounds grow with the logarithm of the nodes, and the tables shrink from one
    to the next. Afterwards the rounds' sets are followed from the last to the first. Nodes without links are absent;
    links with a null end and links of a node with itself are none.
    """
    u, v = F.col(a).alias("u"), F.col(b).alias("v")
    edges = written(links.select(u, v).where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    rounds: list[DataFrame] = []
    while edges.count() > FEW:
        place = lambda c: F.struct(F.xxhash64(F.lit(len(rounds)), c).alias("h"), F.col(c).alias("node"))
        both = edges.select("u", place("v").alias("other")).union(edges.select("v", place("u")))
        sets = written(both.groupBy("u").agg(F.min("other").alias("other")).select(F.col("u").alias("node"), F.least(place("u"), "other")["node"].alias("into")))
        # merged, since files of few bytes may hold more rows than the driver can broadcast
        ends = edges.join(sets.select(F.col("node").alias("u"), F.col("into").alias("iu")).hint("merge"), "u").join(sets.select(F.col("node").alias("v"), F.col("into").alias("iv")).hint("merge"), "v")
        edges = written(ends.where("iu <> iv").select(F.least("iu", "iv").alias("u"), F.greatest("iu", "iv").alias("v")).distinct())
        rounds.append(sets)
    found = written(_followed(edges))
    while rounds:
        on = found.select(F.col("node").alias("into"), F.col("into").alias("last"))
        found = rounds.pop().join(on.hint("merge"), "into", "left").select("node", F.coalesce("last", "into").alias("into"))
        found = written(found) if len(rounds) % 4 == 0 else found
    least = found.groupBy("into").agg(F.min("node").alias("component"))
    return found.join(least.hint("merge"), "into").select("node", "component")
