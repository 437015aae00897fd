"""Sharding by histogram sort.

Rows are ordered by (hash of the text, id) and cut into shards of nearly equal bytes. The cuts are found by
counting: every partition counts the bytes below the candidate keys ("probes"), the exact sums over all
partitions tell between which two probes each cut lies, and the next round probes only that interval, until the
cut is within the tolerance. Then the rows are exchanged once, each to the shard its key falls in. Equal texts
are neighbours in this order, so a group of copies is cut only where it spans a boundary.

At any size a round moves only the counts: shards x probes numbers from each partition.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxmere.llm.common import cut, table, unused

_LOW = -(1 << 63)


@dataclass(frozen=True)
class Keys:
    """Keys (hash, id) as one ordered integer: the ids from `first` on, `span` of them, under each hash."""

    first: int
    span: int

    @property
    def end(self) -> int:
        return (1 << 64) * self.span

    def split(self, key: int) -> tuple[int, int]:
        high, low = divmod(key, self.span)
        return high + _LOW, low + self.first


def _bucket(high: np.ndarray, low: np.ndarray, halves: list[tuple[int, int]]) -> np.ndarray:
    """How many of the sorted probes are at most (high, low)."""
    pair = np.dtype([("h", np.int64), ("l", np.int64)])
    probes = np.array(halves, dtype=pair)
    heads = probes["h"]
    first, last = np.searchsorted(heads, high, "left"), np.searchsorted(heads, high, "right")
    place = last.copy()
    tie = np.flatnonzero(first != last)  # the hash equals that of a probe: the id decides
    for a in np.unique(first[tie]):
        mine = tie[first[tie] == a]
        place[mine] = a + np.searchsorted(probes["l"][a : last[mine[0]]], low[mine], "right")
    return place


def bytes_below(keyed: DataFrame, probes: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Exact bytes and rows of the keys below each probe, summed over all partitions."""

    def count(batches):
        size, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
        for batch in batches:
            place = _bucket(batch["key_hash"].to_numpy(), batch["key_id"].to_numpy(), probes)
            np.add.at(size, place, batch["size"].to_numpy())
            rows += np.bincount(place, minlength=len(rows))
        some = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(size[some]), pa.array(rows[some])], names=["bucket", "size", "n"])

    counts = keyed.mapInArrow(count, "bucket long, size long, n long").groupBy("bucket").agg(F.sum("size").alias("size"), F.sum("n").alias("n")).collect()
    size, rows = [0] * (len(probes) + 1), [0] * (len(probes) + 1)
    for r in counts:
        size[r["bucket"]], rows[r["bucket"]] = r["size"], r["n"]
    below = np.cumsum(size)[:-1], np.cumsum(rows)[:-1]
    return below[0].tolist(), below[1].tolist()


def find_cuts(keyed: DataFrame, keys: Keys, targets: dict[int, int], total: int, probes: int = 16, rounds: int = 100) -> dict[int, int]:
    """For each target (bytes: tolerance) a key with about that many bytes below it.

    Each round puts keys into every open interval, half of them evenly and half around where the target lies if
    bytes are spread evenly, since hashes are. An interval that holds a single hash value is a group of copies, and
    evenly means by id there. A cut is done once the bytes below it miss the target by at most its tolerance, or its
    interval holds no further key. Every round divides the intervals by `probes` at least, so it ends long before
    `rounds`; raises otherwise.
    """
    low, high = {t: (0, 0) for t in targets}, {t: (keys.end, total) for t in targets}
    done: dict[int, int] = {}
    for _ in range(rounds):
        still = [t for t in targets if t not in done]
        if not still:
            return done
        candidates: set[int] = set()
        for t in still:
            (a, below_a), (b, below_b) = low[t], high[t]
            guess = a + (b - a) * (t - below_a) // max(1, below_b - below_a)
            width, near = max(1, (b - a) // probes), max(1, (b - a) // (probes * probes))
            candidates |= {k for k in [a + i * width for i in range(1, probes)] + [guess + i * near for i in range(-probes // 2, probes // 2)] if a < k < b}
        ordered = sorted(candidates)
        below, _ = bytes_below(keyed, [keys.split(k) for k in ordered]) if ordered else ([], [])
        for t in still:
            at = bisect.bisect_right(below, t) - 1
            if at >= 0 and ordered[at] > low[t][0]:
                low[t] = (ordered[at], below[at])
            at = bisect.bisect_left(below, t)
            if at < len(below) and ordered[at] < high[t][0]:
                high[t] = (ordered[at], below[at])
            best = min((low[t], high[t]), key=lambda x: abs(x[1] - t))
            if abs(best[1] - t) <= targets[t] or high[t][0] - low[t][0] <= 1:
                done[t] = best[0]
    raise RuntimeError(f"{len(targets) - len(done)} cuts are not within their tolerance after {rounds} rounds")


#: Bytes that one task should sort, and the most ranges over all shards that are counted for.
PART_BYTES, MOST_PARTS = 256 << 20, 8192


def shard_by_bytes(df: DataFrame, shards: int, text: str = "text", id_col: str = "doc_id", tolerance: float = 0.001, parts: int | None = None) -> DataFrame:
    """df with `size`, `shard` (0 to shards - 1) and `slot` (gapless from 0 in each shard).

    A row's size is its text's UTF-8 bytes plus 16; a null text counts as empty. Shards get equal bytes within
    `tolerance` of a shard, or the length of one row where a longer row lies across the boundary. Each shard is
    exchanged as `parts` ranges whose row counts give the slots, so no task holds a whole large shard; without
    `parts` there are as many as it takes for PART_BYTES each, at most MOST_PARTS in all.
    Rows with equal text and id are ordered arbitrarily among themselves. A null id counts as the lowest id.
    An empty table gives an empty result. Columns named shard, slot or size are replaced.
    """
    spark = df.sparkSession
    size = (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 16).cast("long")
    kept = df.drop("size", "shard", "slot")
    key_hash, key_id, cut_no, base_no, rank = (unused(kept, n) for n in ("key_hash", "key_id", "cut", "base", "rank"))
    rows = kept.withColumn("size", size).withColumn(key_hash, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    rows = rows.withColumn(key_id, F.coalesce(F.col(id_col).cast("long"), F.lit(_LOW)))
    keyed = cut(rows.select(F.col(key_hash).alias("key_hash"), F.col(key_id).alias("key_id"), "size"))
    total, low, high = keyed.agg(F.sum("size"), F.min("key_id"), F.max("key_id")).first()
    if not total:
        return rows.drop(key_hash, key_id).withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    keys = Keys(low, high - low + 1)
    parts = parts or max(1, min(MOST_PARTS // shards, -(-total // (shards * PART_BYTES))))
    fine = shards * parts
    exact, loose = max(1, int(tolerance * total / shards)), max(1, int(0.25 * total / fine))
    targets = {total * i // fine: loose for i in range(1, fine)} | {total * i // shards: exact for i in range(1, shards)}
    found = find_cuts(keyed, keys, targets, total)
    cuts = sorted(set(found.values()))
    halves = [keys.split(k) for k in cuts]
    _, below = bytes_below(keyed, halves) if cuts else ([], [])
    edges = sorted(found[total * i // shards] for i in range(1, shards))
    starts, shard_of, first_of = [0, *below], [], {}
    for i, begin in enumerate(starts):
        s = bisect.bisect_right(edges, cuts[i - 1]) if i else 0
        first_of.setdefault(s, begin)
        shard_of.append(s)
    base = [begin - first_of[s] for begin, s in zip(starts, shard_of)]

    @F.pandas_udf("int")
    def cut_of(high: pd.Series, low: pd.Series) -> pd.Series:
        return pd.Series(_bucket(high.to_numpy(), low.to_numpy(), halves).astype(np.int32))

    placed = rows.withColumn(cut_no, cut_of(key_hash, key_id))
    levels = spark.createDataFrame([(i, s, b) for i, (s, b) in enumerate(zip(shard_of, base))], f"`{cut_no}` int, shard int, `{base_no}` long")
    order = Window.partitionBy(cut_no).orderBy(key_hash, key_id)
    ranked = placed.withColumn(rank, F.row_number().over(order)).join(F.broadcast(levels), cut_no)  # at most MOST_PARTS small rows
    return ranked.withColumn("slot", F.col(base_no) + F.col(rank) - 1).drop(cut_no, base_no, rank, key_hash, key_id)


def op6_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sharded = shard_by_bytes(docs, 40).withColumn("text_crc32", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    return sharded.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
