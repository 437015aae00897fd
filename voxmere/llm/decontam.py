"""Benchmark decontamination by latent semantic retrieval.

1. Words' document frequencies are counted over all documents.
2. A randomised SVD of the TF-IDF matrix of the passages of all documents gives every hashed word a place in a
   latent space. It is of the sketching kind: every passage is added, with a random sign, to one of SKETCH rows (a
   sparse random matrix times the passages), partitions' rows are summed, and the singular vectors of what is left
   are those of the passages up to the sketch's error. That is one pass over the corpus. A word's place is its row
   of the leading right singular vectors at length 1, times its inverse document frequency.
3. Every document is read in overlapping windows, every benchmark item in pieces of as many words, and the cosine
   of their latent vectors (sums over their words) alone decides which windows are candidates for which items. An
   item of few words is one piece, compared with windows of about its size (SCALES).
4. Candidates are verified: the longest common subsequence of the item and the words around the window must cover
   `LEAST` of the item, and `LEAST_ANSWER` of its answer (its last sentence, or as many words at its end as that
   takes to hold ANSWER_WORDS).
The benchmark is a table of bounded size (MOST_ITEMS); it is the stated query set, held in every task.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmere.llm.common import in_batches, table
from voxmere.llm.textvec import LOWER, U64, Tokens, mix, run_hashes, runs, slices, text_buffers

BITS, RANK, SKETCH, PASSAGE = 14, 64, 128, 32
#: Bound of the benchmark. At about five pieces an item every task then holds 26 MB of latent vectors.
MOST_ITEMS = 20_000
#: Words of a window, and the shortest item it is used for; windows overlap by half.
SCALES = ((16, 12), (8, 6), (4, 1))
#: Least cosine of a candidate, share of the item and of its answer in common order, and words of an answer.
COSINE, LEAST, LEAST_ANSWER, ANSWER_WORDS = 0.55, 0.6, 0.5, 12
#: Rows of the sketch that are summed as one value, and the groups in which partitions' values are summed first.
_PART, _GROUPS = 64, 16


def _buckets(h: np.ndarray) -> np.ndarray:
    return (h >> U64(64 - BITS)).astype(np.int64)


_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = _ALNUM[128:] = True


def plain_words(data: np.ndarray, offs: np.ndarray) -> Tokens:
    """Runs of letters and digits, in lower case."""
    start, end, row = runs(_ALNUM[data], offs)
    return Tokens(start, end, row, run_hashes(LOWER[data], start, end))


def tokens_of(texts: list) -> Tokens:
    data, offs = text_buffers(pa.array([t or "" for t in texts], pa.large_string()))
    return plain_words(data, offs)


def windows(row: np.ndarray, size: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and word after the last of the windows of each row; the last one ends with the row, a short row is one window."""
    if not len(row):
        z = np.zeros(0, np.int64)
        return z, z
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    end = np.append(first[1:], len(row))
    n = 1 + np.maximum(0, -((size - (end - first)) // stride))
    begin = np.repeat(first - stride * (np.cumsum(n) - n), n) + stride * np.arange(int(n.sum()))
    last = np.repeat(end, n)
    begin = np.maximum(np.repeat(first, n), np.minimum(begin, last - size))
    return begin, np.minimum(begin + size, last)


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all texts each hashed word occurs, and the number of texts."""

    def count(batches):
        total, n = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for first, last, data, offs in slices(batch.column(0), most=64):
                t = plain_words(data, offs)
                there = np.zeros((last - first) << BITS, bool)
                there[(t.row << BITS) | _buckets(t.hash)] = True
                total += np.bincount(np.flatnonzero(there) & ((1 << BITS) - 1), minlength=1 << BITS)
                n += last - first
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], n))], names=["bucket", "n"])

    df = np.zeros(1 << BITS, np.int64)
    sums = texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    bucket, n = sums["bucket"].to_numpy(), sums["n"].to_numpy()
    df[bucket[bucket >= 0]] = n[bucket >= 0]
    return df, int(n[bucket < 0].sum())


def sketched(texts: DataFrame, idf: np.ndarray, rows: int = SKETCH) -> np.ndarray:
    """Words x rows: the transposed sketch of the normalised TF-IDF of the passages of all texts (doc_id, text).

    The row and the sign of a passage follow from the document's id and the passage's number, so copies are dealt
    apart and a repeated task gives the same sums. Partitions' sums are added up in two steps, in parts of the
    vocabulary; the driver gets words x rows numbers.
    """
    shared = texts.sparkSession.sparkContext.broadcast(idf.astype(np.float32))

    def add_up(batches):
        weight = shared.value
        out = np.zeros(len(weight) * rows, np.float32)
        for batch in batches:
            ids = batch["doc_id"].to_numpy()
            for at, _, data, offs in slices(batch["text"]):
                t = plain_words(data, offs)
                a, b = windows(t.row, PASSAGE, PASSAGE)
                if not len(a):
                    continue
                n = b - a
                start = np.cumsum(n) - n
                passage = np.repeat(np.arange(len(a)), n)
                bucket = _buckets(t.hash)[np.repeat(a - start, n) + np.arange(int(n.sum()))]
                value = weight[bucket]
                value = value / np.maximum(np.sqrt(np.bincount(passage, value * value, len(a))), 1e-9).astype(np.float32)[passage]
                with np.errstate(over="ignore"):
                    drawn = mix(ids[at + t.row[a]].view(U64) * U64(0x9FB21C651E98DF25) + np.arange(len(a), dtype=U64) - np.searchsorted(t.row[a], t.row[a]).astype(U64) + U64(1))
                sign = np.where(drawn & U64(1), np.float32(1), np.float32(-1))
                np.add.at(out, bucket * rows + ((drawn >> U64(1)) % U64(rows)).astype(np.int64)[passage], value * sign[passage])
        context = TaskContext.get()
        group = context.partitionId() % _GROUPS if context else 0
        parts = out.reshape(-1, _PART * rows)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(parts), group)), pa.array(np.arange(len(parts))), pa.array([x.tobytes() for x in parts], pa.binary())], names=["salt", "part", "sums"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(_PART * rows)
        for s in pdf["sums"]:
            total += np.frombuffer(s, np.float32)
        return pd.DataFrame({"salt": pdf["salt"].iloc[:1], "part": pdf["part"].iloc[:1], "sums": [total.astype(np.float32).tobytes()]})

    kinds = "salt long, part long, sums binary"
    few = texts.coalesce(texts.sparkSession.sparkContext.defaultParallelism)  # every partition's sums are as large as the sketch
    sums = few.mapInArrow(add_up, kinds).groupBy("salt", "part").applyInPandas(add, kinds).groupBy("part").applyInPandas(add, kinds).collect()
    out = np.zeros((len(idf), rows), np.float32)
    for r in sums:
        out[r["part"] * _PART : (r["part"] + 1) * _PART] = np.frombuffer(r["sums"], np.float32).reshape(_PART, rows)
    return out


def latent_words(sketch: np.ndarray, idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Words x rank: each word's place in the space. Words that no passage has are at zero, and no document has them either."""
    square, turn = np.linalg.eigh(sketch.T.astype(float) @ sketch)
    top = np.argsort(square)[::-1][:rank]
    vectors = sketch @ turn[:, top] / np.maximum(square[top], 1e-9)  # right singular vectors over their values
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return (idf[:, None] * vectors / np.where(length > 0, length, 1)).astype(np.float32)


def lcs(pattern: list[int], text: list[int]) -> int:
    """Length of the longest common subsequence, with the pattern's positions as the bits of one number."""
    where: dict[int, int] = {}
    for i, w in enumerate(pattern):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(pattern)) - 1
    v = full
    for w in text:
        u = v & where.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(pattern) - v.bit_count()


def blocks(row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of the blocks of `size` words that each row is cut into (its last one may be shorter), and their rows."""
    if not len(row):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    n = -(np.append(first[1:], len(row)) - first) // -size
    begin = np.repeat(first - size * (np.cumsum(n) - n), n) + size * np.arange(int(n.sum()))
    return begin, row[begin]


def latent_windows(t: Tokens, space: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and unit latent vectors of windows of two neighbouring half-sized blocks; a row of one block is one window."""
    begin, row = blocks(t.row, size // 2)
    if not len(begin):
        return begin, np.zeros((0, space.shape[1]), np.float32)
    bucket, ends = _buckets(t.hash), np.append(begin[1:], len(t.row))
    sums = np.empty((len(begin), space.shape[1]), np.float32)
    for k in range(0, len(begin), 2048):
        lo, hi = begin[k], ends[min(k + 2048, len(begin)) - 1]
        sums[k : k + 2048] = np.add.reduceat(space[bucket[lo:hi]], begin[k : k + 2048] - lo, axis=0)
    last = np.append(row[1:] != row[:-1], True)
    alone = last & np.insert(last[:-1], 0, True)
    sums[:-1] += np.where(last[:-1], 0, 1).astype(np.float32)[:, None] * sums[1:]
    kept = np.flatnonzero(~last | alone)
    x = sums[kept]
    return begin[kept], x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


@dataclass
class Benchmark:
    """The items' words, their answers, and their pieces in the latent space."""

    ids: list
    items: list[list[int]]
    answers: list[list[int]]
    vocabulary: np.ndarray  # sorted hashes
    places: list[np.ndarray]  # of the items' words in the vocabulary
    space: np.ndarray
    pieces: list[tuple[int, np.ndarray, np.ndarray]]  # words of a window, the items of the pieces compared with it, their latent vectors
    cosine: float

    @classmethod
    def of(cls, rows: list, space: np.ndarray, cosine: float = COSINE) -> Benchmark:
        texts = [r["text"] for r in rows]
        t = tokens_of(texts)
        words = lambda t: np.split(t.hash, np.searchsorted(t.row, np.arange(1, len(texts))))
        own = words(t)
        last = words(tokens_of([([s for s in re.split(r"(?<=[.?!])\s+|\n", x or "") if s.strip()] or [""])[-1] for x in texts]))
        answers = [x[-max(len(y), ANSWER_WORDS) :].tolist() for x, y in zip(own, last)]
        vocabulary = np.unique(t.hash)
        pieces, longest = [], None
        for size, least in SCALES:
            mine = np.array([i for i, x in enumerate(own) if len(x) >= least and (longest is None or len(x) < longest)], np.int64)
            longest = least
            kept = np.isin(t.row, mine)
            part = Tokens(t.start[kept], t.end[kept], t.row[kept], t.hash[kept])
            begin, vectors = latent_windows(part, space, size)
            if len(begin):
                pieces.append((size, part.row[begin], vectors))
        return cls([r["item_id"] for r in rows], [x.tolist() for x in own], answers, vocabulary, [np.searchsorted(vocabulary, x) for x in own], space, pieces, cosine)

    def search(self, data: np.ndarray, offs: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, item, words of the item, common words in order, common words of the answer) of each verified pair."""
        t = plain_words(data, offs)
        if not len(t.row) or not len(self.vocabulary):
            return []
        at = np.minimum(np.searchsorted(self.vocabulary, t.hash), len(self.vocabulary) - 1)
        at = np.where(self.vocabulary[at] == t.hash, at, len(self.vocabulary))
        out: dict[tuple[int, int], tuple] = {}
        there_now = np.zeros(len(self.vocabulary) + 1, bool)
        bounds = np.searchsorted(t.row, np.arange(len(offs)))
        for size, item_of, vectors in self.pieces:
            begin, latent = latent_windows(t, self.space, size)
            at_once = max(1, (1 << 22) // len(item_of))
            for k in range(0, len(begin), at_once):
                w, piece = np.nonzero(latent[k : k + at_once] @ vectors.T >= self.cosine)
                for x, item in sorted(set(zip(begin[k + w].tolist(), item_of[piece].tolist()))):
                    row, own = int(t.row[x]), self.items[item]
                    before = out.get((row, item))
                    if before and before[2] >= 0.95 * len(own):
                        continue
                    n = max(len(own), size)
                    lo, hi = max(int(bounds[row]), x - n), min(int(bounds[row + 1]), x + size + n)
                    there_now[at[lo:hi]] = True  # no subsequence is longer than the number of the item's words that are there at all
                    possible = int(there_now[self.places[item]].sum())
                    there_now[at[lo:hi]] = False
                    if possible < LEAST * len(own):
                        continue
                    region = t.hash[lo:hi].tolist()
                    common = lcs(own, region)
                    if common < LEAST * len(own):
                        continue
                    answer = lcs(self.answers[item], region)
                    if answer >= LEAST_ANSWER * len(self.answers[item]) and (before is None or common > before[2]):
                        out[(row, item)] = (row, len(own), common, answer)
        return [(row, item, n, common, answer) for (row, item), (_, n, common, answer) in out.items()]


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", cosine: float = COSINE) -> DataFrame:
    """(doc_id, item_id, n_words, n_common, n_answer) of each document and benchmark item found in it.

    Null or empty texts and items without words match nothing; rows with a null key or item id are left out. Keys
    and item ids are integers. A key or an item id that is repeated gives a row for each of its rows. Equal texts
    have equal results. Raises if the benchmark has more than MOST_ITEMS rows, since every task holds it. With
    `cosine` -1 every window is a candidate for every item.
    """
    rows = benchmark.select("item_id", "text").where("item_id is not null and trim(coalesce(text, '')) <> ''").orderBy("item_id").limit(MOST_ITEMS + 1).collect()
    if len(rows) > MOST_ITEMS:
        raise ValueError(f"the benchmark has more than {MOST_ITEMS} items")
    schema = "doc_id long, item_id long, n_words int, n_common int, n_answer int"
    source = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    df, n = document_frequencies(in_batches(source).select("text"))
    if not rows or not n:
        return docs.sparkSession.createDataFrame([], schema)
    idf = np.log((1 + n) / (1 + df)) + 0.01
    shared = docs.sparkSession.sparkContext.broadcast(Benchmark.of(rows, latent_words(sketched(source, idf), idf), cosine))

    def find(batches):
        bench = shared.value
        for batch in batches:
            ids = batch["doc_id"].to_pylist()
            hits = [(ids[first + row], bench.ids[item], n, common, answer) for first, _, data, offs in slices(batch["text"]) for row, item, n, common, answer in bench.search(data, offs)]
            columns = list(zip(*hits)) if hits else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "item_id", "n_words", "n_common", "n_answer"])

    return source.mapInArrow(find, schema)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
