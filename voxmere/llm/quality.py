"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

A text is split into pieces (runs of letters, of digits, of one kind of other characters). Its features are the
pieces, pairs of neighbouring pieces, triples of their shapes (lower case, capitalised, upper case, digits, the
symbol itself) and one for a word that repeats the word before it; each is hashed to one of 2**BITS buckets, and
a text's vector has length 1. A score is the sparse dot product of that vector with the weights.

Training data is a bounded sample of the labelled rows. It is dealt to a fixed number of shards; every shard runs
the per-coordinate leader update over its rows, and the shards' weights are averaged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmere.llm.common import bounded_sample, held_out, in_batches, table
from voxmere.llm.textvec import U64, Tokens, grams, mix, run_hashes, slices

BITS = 18
#: Bound of the labelled rows that are learned from, and the number of shards they are dealt to.
TRAIN_ROWS, SHARDS = 8000, 4
_KIND = np.full(256, 3, np.uint8)  # 0 white space, 1 letters and bytes of multi-byte characters, 2 digits, 3 others
_KIND[[0x20, 9, 10, 11, 12, 13]] = 0
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1
_KIND[48:58] = 2
_UPPER = np.zeros(256, np.uint8)
_UPPER[65:91] = 1


def pieces(data: np.ndarray, offs: np.ndarray) -> tuple[Tokens, np.ndarray]:
    """The pieces and their shape codes."""
    kind = _KIND[data]
    if not len(kind):
        z = np.zeros(0, np.int64)
        return Tokens(z, z, z, z.astype(U64)), z
    change = np.ones(len(kind), bool)
    change[1:] = kind[1:] != kind[:-1]
    change[offs[(offs > 0) & (offs < len(kind))]] = True
    start = np.flatnonzero(change)
    end = np.append(start[1:], len(kind))
    some = kind[start] > 0
    start, end = start[some], end[some]
    row = np.searchsorted(offs, start, "right") - 1
    tokens = Tokens(start, end, row, run_hashes(data, start, end))
    upper = np.concatenate([[0], np.cumsum(_UPPER[data])])
    many = upper[end] - upper[start]
    shape = np.where(kind[start] == 1, np.minimum(many, 2), np.where(kind[start] == 2, 3, 4 + (tokens.hash & U64(0xFFFF)).astype(np.int64)))
    return tokens, shape


def features(data: np.ndarray, offs: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and value of the rows' vectors, each (row, bucket) once, in order."""
    tokens, shape = pieces(data, offs)
    shapes = Tokens(tokens.start, tokens.end, tokens.row, mix(shape.astype(U64) + U64(77)))
    letters = np.flatnonzero(shape <= 2)
    again = letters[1:][(tokens.hash[letters[1:]] == tokens.hash[letters[:-1]]) & (tokens.row[letters[1:]] == tokens.row[letters[:-1]])]
    found = [(tokens.row, tokens.hash), grams(tokens, 2), grams(shapes, 3), (tokens.row[again], np.full(len(again), 12345, U64))]
    row = np.concatenate([r for r, _ in found])
    bucket = np.concatenate([(h >> U64(64 - bits)).astype(np.int64) if len(h) else np.zeros(0, np.int64) for _, h in found])
    key, count = np.unique((row << bits) | bucket, return_counts=True)
    row, bucket = key >> bits, key & ((1 << bits) - 1)
    value = np.sqrt(count)  # the square root keeps frequent pieces from hiding the others
    length = np.sqrt(np.bincount(row, weights=value * value, minlength=len(offs) - 1))
    return row, bucket, value / length[row]


@dataclass
class Linear:
    """Weights by bucket; the last one is the intercept."""

    weights: np.ndarray

    def score(self, column: pa.Array) -> np.ndarray:
        bits = int(len(self.weights) - 1).bit_length() - 1
        out = np.zeros(len(column))
        for first, last, data, offs in slices(column):
            row, bucket, value = features(data, offs, bits)
            out[first:last] = np.bincount(row, weights=self.weights[bucket] * value, minlength=last - first)
        return 1 / (1 + np.exp(-np.clip(out + self.weights[-1], -40, 40)))


def follow_leader(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, size: int, epochs: int = 4, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01) -> np.ndarray:
    """Weights (size of them and an intercept) after passing over the rows in order, `epochs` times.

    z holds the accumulated shifted gradients and n their squares; a weight is the closed-form minimiser of the
    regularised sum so far and is needed only for the features at hand.
    """
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def at(i):
        return np.where(np.abs(z[i]) <= l1, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for (bucket, value), y in zip(rows, labels):
            i, x = np.append(bucket, size), np.append(value, 1.0)
            w = at(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -40, 40))) - y) * x
            step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - step * w
            n[i] += g * g
    return at(np.arange(size + 1))


def fit(labelled: DataFrame, text: str = "text", label: str = "label", key: str = "doc_id", rows: int = TRAIN_ROWS, shards: int = SHARDS, bits: int = BITS) -> Linear:
    """Learns from at most about `rows` rows of (key, text, label 0 or 1); rows with a null label are left out.

    With no labelled rows every score is 0.5. Rows of which the order is the same by the key's hash, as repeated rows,
    are learned from one after the other. The driver gets one vector of 2**bits + 1 numbers from each shard.
    """
    sample = bounded_sample(labelled.where(F.col(label).isNotNull()).select(key, label, text), key, rows)

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("order", kind="stable")
        vectors = []
        for _, last, data, offs in slices(pa.array(pdf["text"].tolist(), pa.large_string())):
            row, bucket, value = features(data, offs, bits)
            at = np.searchsorted(row, np.arange(len(offs)))
            vectors += [(bucket[a:b], value[a:b]) for a, b in zip(at[:-1], at[1:])]
        weights = follow_leader(vectors, pdf["label"].to_numpy(float), 1 << bits)
        return pd.DataFrame({"n": [len(pdf)], "weights": [weights.astype(np.float32).tobytes()]})

    dealt = sample.select(F.xxhash64(F.lit("order"), F.col(key)).alias("order"), F.col(text).alias("text"), F.col(label).cast("double").alias("label"))
    parts = dealt.groupBy(F.pmod(F.col("order"), F.lit(shards)).alias("shard")).applyInPandas(learn, "n long, weights binary").collect()
    if not parts:
        return Linear(np.zeros((1 << bits) + 1))
    total = sum(p["n"] for p in parts)
    return Linear(sum(np.frombuffer(p["weights"], np.float32).astype(float) * p["n"] for p in parts) / total)


def with_score(df: DataFrame, model, text: str = "text", out: str = "score") -> DataFrame:
    """df with the model's score of each whole text; a null or empty text has no features, so its score is the intercept's.

    Equal texts have equal scores, whatever their ids. A column named `out` is replaced: name another one to keep it.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(column), pa.float64())

    return in_batches(df).withColumn(out, score(F.col(text)))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id", 5, 0)).select("doc_id", F.col("quality").alias("label")).where("label is not null")
    chosen = bounded_sample(labels, "doc_id", TRAIN_ROWS)
    model = fit(docs.join(F.broadcast(chosen), "doc_id"))  # at most about TRAIN_ROWS small rows
    scored = with_score(docs, model)
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
