"""Near-duplicates by b-bit MinHash.

Each text becomes the set of its word shingles (64-bit hashes). Of every permutation's minimum only the low bits
are kept, as packed bit planes: two signatures agree at a place where no plane differs, so the number of
agreements is a bit count, and taking off the agreements due to chance gives the estimated similarity.

1. Texts with the same set collapse to the one with the smallest id.
2. Bands of whole minima give buckets. In every bucket each member is paired with one hub; pairs whose estimate
   is far too low go, the others are confirmed on the full sets; confirmed links give components.
3. Keys whose buckets hang together form a cluster, so any two that share a bucket are in one. A cluster whose
   members are still in several components is compared further, its smaller components against all of it, in
   blocks of bounded size; what is estimated in reach of the threshold is confirmed on the full sets, and only
   links that join components are kept. So no link between components stays unexamined, and the pairs inside a
   component are never listed.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmere.llm.common import cut, in_batches, likely, table, written
from voxmere.llm.textvec import LOWER, U64, Tokens, grams, mix, slices, text_buffers, words
from voxmere.operators.graph import connected_components

HASHES, BITS = 128, 4
#: Two planes' words of 64 agreements each; the order is plane by plane.
WORDS = BITS * HASHES // 64
BLOCK = 1024
_rng = np.random.default_rng(20240229)
_MULTIPLY = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) | U64(1)
_ADD = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def shingle_sets(data: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the distinct shingles, sorted by row and hash; a row with fewer words has its whole sequence as one."""
    tokens = words(LOWER[data], offs)
    found = [grams(tokens, size)]
    n = tokens.per_row(len(offs) - 1)
    for k in range(1, size):
        few = n[tokens.row] == k if len(tokens.row) else np.zeros(0, bool)
        if few.any():
            found.append(grams(Tokens(tokens.start[few], tokens.end[few], tokens.row[few], tokens.hash[few]), k))
    row, h = np.concatenate([r for r, _ in found]), np.concatenate([x for _, x in found])
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]


def minima(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows that have shingles, and HASHES minima (32 bits) of each."""
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
    out = np.empty((len(first), HASHES), np.uint32)
    with np.errstate(over="ignore"):
        for k in range(HASHES if len(first) else 0):
            out[:, k] = np.minimum.reduceat(((h * _MULTIPLY[k] + _ADD[k]) >> U64(32)).astype(np.uint32), first)
    return row[first], out


def packed(low: np.ndarray) -> np.ndarray:
    """Rows x WORDS words with the low BITS bits of the minima, plane by plane."""
    planes = [np.packbits(((low >> np.uint32(p)) & np.uint32(1)).astype(np.uint8), axis=1) for p in range(BITS)]
    return np.ascontiguousarray(np.concatenate(planes, axis=1)).view(np.int64)


def banding(threshold: float, miss: float = 1e-5) -> tuple[int, int]:
    """(rows of a band, bands): the longest bands of which HASHES minima give enough that a pair at the threshold is missed with at most that probability."""
    for rows in range(12, 0, -1):
        bands = math.ceil(math.log(miss) / math.log(1 - threshold**rows))
        if rows * bands <= HASHES:
            return rows, bands
    return 1, HASHES


def sketches(df: DataFrame, text: str, key: str, size: int, threshold: float) -> DataFrame:
    """(key, n, set_a, set_b, signature, bands) of each whole text; a text without words has n 0 and no bands."""
    rows, bands = banding(threshold)
    names = ["key", "n", "set_a", "set_b", "signature", "bands"]

    def sketch(batches):
        for batch in batches:
            for first, last, data, offs in slices(batch["text"]):
                m = last - first
                row, h = shingle_sets(data, offs, size)
                n = np.bincount(row, minlength=m)
                some, low = minima(row, h)
                with np.errstate(over="ignore"):
                    set_a, set_b = np.zeros(m, U64), np.zeros(m, U64)
                    if len(some):
                        at = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                        set_a[some] = np.add.reduceat(mix(h + U64(1)), at)
                        set_b[some] = np.bitwise_xor.reduceat(mix(h * U64(3) + U64(2)), at)
                    keys = np.zeros((m, bands), U64)
                    for k in range(bands if len(some) else 0):
                        v = np.full(len(some), k, U64)
                        for j in range(rows):
                            v = mix(v * U64(0x9FB21C651E98DF25) + low[:, k * rows + j].astype(U64))
                        keys[some, k] = v
                signature = np.zeros((m, WORDS), np.int64)
                signature[some] = packed(low)
                in_bands = np.where(n > 0, bands, 0)
                lists = [
                    pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * WORDS), pa.array(signature.ravel())),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(in_bands)]).astype(np.int32)), pa.array(keys[n > 0].view(np.int64).ravel())),
                ]
                yield pa.RecordBatch.from_arrays([batch["key"].slice(first, m), pa.array(n), pa.array(set_a.view(np.int64)), pa.array(set_b.view(np.int64)), *lists], names=names)

    source = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return in_batches(source).mapInArrow(sketch, "key long, n long, set_a long, set_b long, signature array<long>, bands array<long>")


def estimate(x: Column, y: Column) -> Column:
    """Collision-corrected similarity of two signatures."""
    half = WORDS // BITS
    differ = sum(
        (F.bit_count(_any([F.get(x, F.lit(p * half + w)).bitwiseXOR(F.get(y, F.lit(p * half + w))) for p in range(BITS)])) for w in range(half)),
        F.lit(0),
    )
    chance = 2.0**-BITS
    return ((F.lit(1.0) - differ / float(HASHES)) - chance) / (1 - chance)


def _any(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out.bitwiseOR(c)
    return out


def in_reach(threshold: float) -> float:
    """Estimates below this are, at four and a half standard deviations, of pairs under the threshold."""
    return threshold - 4.5 * math.sqrt(threshold * (1 - threshold) / HASHES) - 0.02


def confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Of the pairs (a, b) those with 100 * intersection >= percent * union of their full shingle sets.

    texts has (key, text). A much used key is a skewed join key, which adaptive execution splits.
    """

    def check(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for first, last, data, offs in slices(batch["text_a"]):
                ra, ha = shingle_sets(data, offs, size)
                rb, hb = shingle_sets(*_rows(batch["text_b"].slice(first, last - first)), size)
                steps = np.arange(last - first + 1)
                at_a, at_b = np.searchsorted(ra, steps), np.searchsorted(rb, steps)
                for i in range(last - first):
                    x, y = ha[at_a[i] : at_a[i + 1]], hb[at_b[i] : at_b[i + 1]]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep[first + i] = both > 0 and 100 * both >= percent * (len(x) + len(y) - both)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch["a"].filter(mask), batch["b"].filter(mask)], names=["a", "b"])

    of = lambda side: likely(texts, "key", pairs.select(side).distinct(), side).select(F.col("key").alias(side), F.col("text").alias(f"text_{side}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    return in_batches(both.select("a", "b", "text_a", "text_b")).mapInArrow(check, "a long, b long")


def _rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offs = text_buffers(column)
    return data[offs[0] : offs[-1]], offs - offs[0]


def _apart(members: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) between components of a cluster: for any two that are linked, some pair of a chain of links.

    members: (cluster, key, component, signature). A cluster's largest component is compared with the others,
    these also among themselves; both sides are dealt to blocks of about BLOCK members, and each task gets one
    block of each. Whoever is estimated in reach is confirmed on the full sets, unless the two are joined already.
    """
    counts = members.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("m"))
    shape = counts.groupBy("cluster").agg(F.sum("m").alias("all"), F.max(F.struct("m", "component")).alias("top"), F.count(F.lit(1)).alias("kinds"))
    shape = shape.where("kinds > 1 and all > 2")  # the two of a pair have been compared as hub and member
    shape = shape.select("cluster", F.col("top.component").alias("largest"), F.ceil(F.col("all") / BLOCK).cast("int").alias("g"), F.ceil((F.col("all") - F.col("top.m")) / BLOCK).cast("int").alias("s"))
    inside = cut(members.join(cut(shape), "cluster"))
    mixed = inside.join(likely(texts, "key", inside, "key"), "key")
    everyone = mixed.select("cluster", "key", "component", "signature", "text", F.lit(False).alias("minor"), F.pmod(F.xxhash64("key"), F.col("g")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("j"))
    minors = mixed.where("component <> largest").select("cluster", "key", "component", "signature", "text", F.lit(True).alias("minor"), F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("i"), F.pmod(F.xxhash64("key"), F.col("s")).cast("int").alias("j"))
    least = in_reach(percent / 100)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        minor, key = pdf["minor"].to_numpy(), pdf["key"].to_numpy()
        sig = np.array(pdf["signature"].tolist(), np.int64).view(np.uint64)
        _, comp = np.unique(pdf["component"].to_numpy(), return_inverse=True)
        row, h = shingle_sets(*_rows(pa.array(pdf["text"].tolist(), pa.large_string())), size)
        n = np.bincount(row, minlength=len(pdf))
        at = np.searchsorted(row, np.arange(len(pdf) + 1))
        by_hash = np.argsort(h, kind="stable")
        there, half, chance = np.flatnonzero(~minor), WORDS // BITS, 2.0**-BITS
        out_a, out_b = [], []
        for i in np.flatnonzero(minor):
            x = sig[there] ^ sig[i]
            differ = x[:, :half].copy()
            for p in range(1, BITS):
                differ |= x[:, p * half : (p + 1) * half]
            est = (1 - np.bitwise_count(differ).sum(axis=1) / HASHES - chance) / (1 - chance)
            near = there[(est >= least) & (comp[there] != comp[i])]
            if not len(near):
                continue
            own = h[at[i] : at[i + 1]]
            first = np.searchsorted(h, own, "left", sorter=by_hash)
            much = np.searchsorted(h, own, "right", sorter=by_hash) - first
            hits = np.repeat(first - (np.cumsum(much) - much), much) + np.arange(int(much.sum()))
            both = np.bincount(row[by_hash[hits]], minlength=len(pdf))[near]
            for k in near[(both > 0) & (100 * both >= percent * (n[i] + n[near] - both))]:
                if comp[k] != comp[i]:
                    comp[comp == comp[k]] = comp[i]
                    out_a.append(min(key[i], key[k]))
                    out_b.append(max(key[i], key[k]))
        return pd.DataFrame({"a": np.array(out_a, np.int64), "b": np.array(out_b, np.int64)})

    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return everyone.unionByName(minors).repartition(parts, "cluster", "i", "j").groupBy("cluster", "i", "j").applyInPandas(compare, "a long, b long")


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", size: int = 5, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id) of each row.

    Rows are linked where 100 * shared shingles >= percent * all shingles of the two, and component_id is the
    smallest key reachable by links. A null, empty or blank text has no shingles and no links. Keys are integers;
    rows that repeat a key are one node with the links of all their texts, and each keeps its own row. Equal texts
    are linked. Rows with a null key are left out.
    """
    threshold = percent / 100
    sketch = written(sketches(df.where(F.col(key).isNotNull()), text, key, size, threshold))
    sets = cut(sketch.where("n > 0").groupBy("set_a", "set_b", "n").agg(F.min("key").alias("rep")))
    reps = sketch.join(sets.select(F.col("rep").alias("key")), "key", "left_semi").select("key", "signature", "bands")
    texts = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    banded = reps.select("key", F.explode("bands").alias("bucket"))
    hubs = banded.groupBy("bucket").agg(F.min_by("key", F.struct(F.xxhash64("key"), "key")).alias("hub"), F.count(F.lit(1)).alias("m")).where("m > 1").select("bucket", "hub")
    crowded = banded.join(hubs, "bucket")  # only the keys that have company in a bucket
    signed = sketch.select("key", "signature")
    stars = cut(crowded.where("key <> hub").select(F.least("key", "hub").alias("a"), F.greatest("key", "hub").alias("b")).distinct())
    pairs = stars.join(signed.select(F.col("key").alias("a"), F.col("signature").alias("sa")), "a").join(signed.select(F.col("key").alias("b"), F.col("signature").alias("sb")), "b")
    near = cut(pairs.where(estimate(F.col("sa"), F.col("sb")) >= in_reach(threshold)).select("a", "b"))
    links = cut(confirm(near, texts, size, percent))
    labels = connected_components(links)
    clusters = connected_components(stars).withColumnRenamed("component", "cluster")
    named = cut(clusters.join(labels, "node", "left").select("cluster", F.col("node").alias("key"), F.coalesce("component", "node").alias("component")))
    more = cut(_apart(named.join(signed, "key"), texts, size, percent))
    if not more.isEmpty():
        labels = connected_components(links.unionByName(more))
    of_set = sets.join(labels, sets["rep"] == labels["node"], "left").select("set_a", "set_b", "n", F.coalesce("component", "rep").alias("component"))
    joined = sketch.select("key", "n", "set_a", "set_b").join(cut(of_set), ["set_a", "set_b", "n"], "left")
    return joined.select("key", F.col("n").alias("n_shingles"), F.coalesce("component", "key").alias("component_id"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), size=3, percent=85)
    return found.select(F.col("key").alias("doc_id"), "n_shingles", "component_id", (F.col("key") == F.col("component_id")).alias("kept"))
