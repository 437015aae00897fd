"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmere.operators.graph import checkpoint_dir, cut  # noqa: F401  (used by the operators)

#: Rows of a text column are handled in slices of about this many bytes inside a task, so that numpy's
#: intermediate arrays stay small whatever the length of the Arrow batch.
SLICE_BYTES = 1 << 19
#: Rows are handed to Python in Arrow batches of about this many bytes (and at most the session's number of rows),
#: so that neither side holds more of long texts at once. A longer text is a batch of its own.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_batches(df: DataFrame) -> DataFrame:
    """df, in a session that bounds the bytes of an Arrow batch: by BATCH_BYTES, unless the session names a bound itself."""
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(bound, None) is None:
        df.sparkSession.conf.set(bound, str(BATCH_BYTES))
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the one the cluster names. Only a local session may do without; it gets a temporary one."""
    named = checkpoint_dir(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named


def unused(df: DataFrame, name: str) -> str:
    """`name`, with underscores before it until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def written(df: DataFrame) -> DataFrame:
    """Ends the lineage with a Parquet table in the shared folder; for tables with texts or other wide columns.

    The table goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/voxmere-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: str, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id's decimal text leaves the given remainder."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == remainder


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About `rows` rows of df, chosen by a hash of the key; all of them if df has no more.

    The share is fixed by a count, so no sort and no single task is needed. The number of rows is binomial:
    `rows` is exceeded by more than a twentieth only with negligible probability once it is over 5000.
    """
    total = df.count()
    if total <= rows:
        return df
    share = int(rows / total * (1 << 30))
    return df.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 30)) < share)


#: Largest bit map that `may_be_in` sends to the tasks, in bits.
MOST_BITS = 1 << 27


def may_be_in(df: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> Column:
    """True for the rows of df whose key is in `wanted`, and for some others: a sieve before a join, so that it moves few texts.

    The keys' hashes mark bits of a map with 16 bits for each wanted key. The map never exceeds MOST_BITS; with more
    keys than that allows it lets more rows through, but never stops a wanted one.
    """
    n = wanted.count()
    bits = min(MOST_BITS, 1 << max(16, (16 * n).bit_length()))
    spot = F.pmod(F.xxhash64(F.col(key)), F.lit(bits))
    marked = wanted.select(F.pmod(F.xxhash64(F.col(wanted_key)), F.lit(bits)).alias("spot")).withColumn("part", F.shiftright("spot", 16))

    def mark(pdf: pd.DataFrame) -> pd.DataFrame:
        there = np.zeros(1 << 16, bool)
        there[pdf["spot"].to_numpy() & 0xFFFF] = True
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "bits": [np.packbits(there).tobytes()]})

    parts = marked.groupBy("part").applyInPandas(mark, "part long, bits binary").collect()
    whole = np.zeros(bits // 8, np.uint8)
    for r in parts:
        whole[r["part"] << 13 : (r["part"] + 1) << 13] = np.frombuffer(r["bits"], np.uint8)
    shared = df.sparkSession.sparkContext.broadcast(whole)

    @F.pandas_udf("boolean")
    def may_be(at: pd.Series) -> pd.Series:
        i = at.to_numpy(np.int64, na_value=0)
        return pd.Series((shared.value[i >> 3] >> (7 - (i & 7)).astype(np.uint8)) & 1 > 0)

    return may_be(spot)


def likely(df: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """The rows of df whose key is in `wanted`, and some others."""
    return df.where(may_be_in(df, key, wanted, wanted_key))


def without(df: DataFrame, key: str, gone: DataFrame, gone_key: str) -> DataFrame:
    """The rows of df whose key is not in `gone` (a table that is cheap to read again); only the rows that may be in it are moved."""
    maybe, own = unused(df, "maybe"), unused(df, "gone")
    sieved = df.withColumn(maybe, may_be_in(df, key, gone, gone_key))
    ids = gone.select(F.col(gone_key).alias(own)).distinct()
    sure = sieved.where(~F.coalesce(F.col(maybe), F.lit(False))).drop(maybe)
    return sure.unionByName(sieved.where(F.col(maybe)).drop(maybe).join(ids, F.col(key) == F.col(own), "left_anti"))
