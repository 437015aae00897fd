"""Language identification by the nearest of several centroids per language.

A text's vector holds the normalised TF-IDF of its hashed byte trigrams (case folded, everything but letters
taken as one separator). The document frequencies come from all training rows; the centroids from a bounded
sample of each language, by spherical k-means. A text gets the language of the centroid with the highest cosine,
and is marked as rejected if that cosine is lower than what the centroid's own members reach.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmere.llm.common import held_out, in_batches, table, unused
from voxmere.llm.textvec import slices

DIMS = 4096
#: Bound of the rows of a language from which its centroids are made, and the number of centroids.
SAMPLE_ROWS, CENTROIDS = 1500, 4
_LETTER = np.full(256, 32, np.uint32)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def counts(data: np.ndarray, offs: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """Rows x dims: how often each hashed trigram occurs."""
    rows = len(offs) - 1
    if len(data) < 3:
        return np.zeros((rows, dims))
    b = _LETTER[data]
    code = ((b[:-2] | (b[1:-1] << np.uint32(8)) | (b[2:] << np.uint32(16))) * np.uint32(2654435761)) >> np.uint32(32 - int(dims).bit_length() + 1)
    keep = np.ones(len(code), bool)
    for k in (1, 2):  # trigrams that reach into the next row
        cross = offs[1:-1] - k
        keep[cross[(cross >= 0) & (cross < len(code))]] = False
    keep &= (b[:-2] != 32) | (b[1:-1] != 32)
    row = np.repeat(np.arange(rows), np.diff(offs))[: len(code)]
    return np.bincount(row[keep] * dims + code[keep], minlength=rows * dims).reshape(rows, dims).astype(np.float64)


def unit(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(tf) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def document_frequencies(texts: DataFrame, dims: int = DIMS) -> tuple[np.ndarray, int]:
    """In how many of all the texts each trigram bucket occurs, and the number of texts."""

    def count(batches):
        total, n = np.zeros(dims, np.int64), 0
        for batch in batches:
            for first, last, data, offs in slices(batch.column(0), most=256):
                total += (counts(data, offs, dims) > 0).sum(axis=0)
                n += last - first
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], n))], names=["bucket", "n"])

    df = np.zeros(dims, np.int64)
    texts_n = 0
    for r in texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        if r["bucket"] < 0:
            texts_n = r["n"]
        else:
            df[r["bucket"]] = r["n"]
    return df, texts_n


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Centroids and the lowest cosine that a member of each has; starts from mutually distant rows."""
    k = min(k, len(x))
    chosen, near = [0], x @ x[0]
    while len(chosen) < k:
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[chosen[-1]])
    c = x[chosen]
    for _ in range(rounds):
        mine = np.argmax(x @ c.T, axis=1)
        for j in range(k):
            if (mine == j).any():
                c[j] = x[mine == j].mean(axis=0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    cosine = x @ c.T
    mine = np.argmax(cosine, axis=1)
    reach = np.array([cosine[mine == j, j].min() if (mine == j).any() else 1.0 for j in range(k)])
    return c, reach


@dataclass
class Centroids:
    idf: np.ndarray
    langs: list[str] = field(default_factory=list)
    vectors: np.ndarray | None = None
    reach: np.ndarray | None = None

    def predict(self, column: pa.Array) -> tuple[list, np.ndarray, np.ndarray]:
        best, score, rejected = np.zeros(len(column), np.int64), np.zeros(len(column)), np.ones(len(column), bool)
        for first, last, data, offs in slices(column, most=256):
            cosine = unit(counts(data, offs, len(self.idf)), self.idf) @ self.vectors.T
            at = np.argmax(cosine, axis=1)
            best[first:last], score[first:last] = at, np.clip(cosine[np.arange(last - first), at], 0, 1)
            rejected[first:last] = cosine[np.arange(last - first), at] < self.reach[at] * 0.9
        return [self.langs[i] for i in best], score, rejected


def fit(training: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = SAMPLE_ROWS, k: int = CENTROIDS, dims: int = DIMS) -> Centroids:
    """Learns from rows with text and language; document frequencies from all of them, centroids from about `rows` of each language.

    Which rows follows from a hash of their key, so rows that repeat one are taken or left together. Rows with a null
    text or language teach nothing.
    """
    known = training.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    df, n = document_frequencies(known.select("text"), dims)
    idf = np.log((1 + n) / (1 + df)) + 0.05
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("of_lang"))
    share = (F.lit(float(rows)) / F.col("of_lang") * (1 << 30)).cast("long")
    sample = known.join(F.broadcast(sizes), "lang").where(F.pmod(F.xxhash64(F.lit("lang"), F.col("key")), F.lit(1 << 30)) < share)

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", kind="stable")
        x = np.concatenate([unit(counts(data, offs, dims), idf) for _, _, data, offs in slices(pa.array(pdf["text"].tolist(), pa.large_string()), most=256)])
        x = x[np.abs(x).sum(axis=1) > 0]
        if not len(x):
            return pd.DataFrame({"lang": [], "n": [], "vector": [], "reach": []})
        c, reach = spherical_kmeans(x, k)
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]] * len(c), "n": [int(pdf["of_lang"].iloc[0])] * len(c), "vector": [v.astype(np.float32).tobytes() for v in c], "reach": reach})

    found = sample.groupBy("lang").applyInPandas(learn, "lang string, n long, vector binary, reach double").collect()
    if not found:
        return Centroids(idf)
    found.sort(key=lambda r: (-r["n"], r["lang"], r["vector"]))
    return Centroids(idf, [r["lang"] for r in found], np.stack([np.frombuffer(r["vector"], np.float32).astype(float) for r in found]), np.array([r["reach"] for r in found]))


def with_language(df: DataFrame, model: Centroids, text: str = "text") -> DataFrame:
    """df with lang_pred, score and rejected.

    `und` with score 0, rejected, where the text is null or has no letter, or nothing was learned. A text with
    letters but no trigram gets the most frequent language with score 0. Of equally near centroids that of the more
    frequent language wins, then the name's order. Rows that repeat an id or a text are predicted each for itself,
    equal texts alike. Columns named lang_pred, score or rejected are replaced; all others stay.
    """
    has_letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    if not model.langs:
        return df.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "rejected": F.lit(True)})
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double,rejected:boolean>")
    def nearest(column: pa.Array) -> pa.Array:
        lang, score, rejected = shared.value.predict(column)
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], names=["lang", "score", "rejected"])

    near, letter = unused(df, "near"), unused(df, "letter")
    found = in_batches(df).withColumn(near, nearest(F.col(text))).withColumn(letter, has_letter)
    return found.withColumns({
        "lang_pred": F.when(F.col(letter), F.col(f"{near}.lang")).otherwise("und"),
        "score": F.when(F.col(letter), F.col(f"{near}.score")).otherwise(0.0),
        "rejected": ~F.col(letter) | F.col(f"{near}.rejected"),
    }).drop(near, letter)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out("doc_id", 3, 1)))
    predicted = with_language(docs.select("doc_id", "text"), model)
    return predicted.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score", "rejected")
