"""Packing of tokenised documents into sequences of fixed length by swap-based local search.

Documents are tokenised where they are read; a document longer than a sequence is cut so that only its first
piece may be shorter. Pieces that fill a sequence stand alone. The others are dealt to groups of bounded size by a
hash; each group is filled best-fit decreasing, then all of its underfull bins are improved: documents move, swap one for
one or two for one between two bins until none of that makes the sum of squared fills larger, which drives the bins
apart until some are full and others empty. A second pass takes the bins that are still underfull of all groups
and packs their documents together, so what groups leave over is at most a bin in each group of the second pass.
"""

from __future__ import annotations

import bisect
import heapq
import json
import zlib
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmere.llm.common import cut, in_batches, table, written
from voxmere.llm.textvec import slices

SEQUENCE = 2048
#: Pieces of a group on average.
GROUP = 8192
_CODECS: dict = {}
_ENCODERS: dict = {}


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where printable, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def codec(path: str, pattern: str):
    """An encoder with the ranks of a byte-level BPE file for `tokenizers`, whose ids are its merge ranks.

    It gives the ids `tokenizers` gives for that file (a test compares them), at a quarter of the CPU time.
    """
    if path not in _CODECS:
        import tiktoken

        symbols = byte_symbols()
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        ranks = {bytes(symbols[c] for c in token): i for token, i in vocabulary.items() if all(c in symbols for c in token) and not token.startswith("<|")}
        _CODECS[path] = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _CODECS[path]


def named_codec(name: str):
    import public_tokenizers

    return codec(public_tokenizers.path(name), public_tokenizers.PATTERN)


def encoder_of(name: str) -> Callable[[str], list[int]]:
    """The ids that `tokenizers` gives without special tokens added; texts that spell out one of the file's added tokens go to that library itself."""
    import public_tokenizers

    if name not in _ENCODERS:
        path = public_tokenizers.path(name)
        with open(path, encoding="utf-8") as f:
            added = [x["content"] for x in json.load(f).get("added_tokens") or []]
        plain, exact = named_codec(name).encode_ordinary, []

        def encode(text: str) -> list[int]:
            if not any(x in text for x in added):
                return plain(text)
            if not exact:
                from tokenizers import Tokenizer

                exact.append(Tokenizer.from_file(path))
            return exact[0].encode(text, add_special_tokens=False).ids

        _ENCODERS[name] = encode
    return _ENCODERS[name]


def pieces_of(df: DataFrame, text: str, key: str, tokenizer: str, sequence: int = SEQUENCE, end: int = 0) -> DataFrame:
    """(key, piece, start, length, ids) of each document: its token ids, then `end`."""

    def tokenise(batches):
        encode = encoder_of(tokenizer)
        for batch in batches:
            column, names = batch["text"], batch["key"].to_pylist()
            for first, last, _, _ in slices(column):
                keys, piece, start, length, held = [], [], [], [], []
                for k, own in zip(names[first:last], column.slice(first, last - first).to_pylist()):
                    ids = np.array([*encode(own or ""), end], np.int32)
                    head = (len(ids) - 1) % sequence + 1
                    at = [0, *range(head, len(ids) + 1, sequence)]
                    held.append(ids)
                    for i, (a, b) in enumerate(zip(at, at[1:])):
                        keys.append(k), piece.append(i), start.append(a), length.append(b - a)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(np.concatenate(held), pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), lists], names=["key", "piece", "start", "length", "ids"])

    source = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return in_batches(source).mapInArrow(tokenise, "key long, piece int, start long, length long, ids array<int>")


def crc32_of(ids: Column) -> Column:
    """crc32 of an array of ids as little-endian 32-bit numbers."""

    @F.arrow_udf("long")
    def crc32(column: pa.Array) -> pa.Array:
        values, at = column.values.to_numpy(zero_copy_only=False).astype("<u4"), column.offsets.to_pylist()
        return pa.array([zlib.crc32(values[a:b].tobytes()) for a, b in zip(at, at[1:])], pa.int64())

    return crc32(ids)


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of indices: longest first, each into the fullest bin that still takes it."""
    room: list[list[int]] = [[] for _ in range(size + 1)]  # bins by free space
    spaces: list[int] = []  # sorted free spaces that have bins
    bins: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        at = bisect.bisect_left(spaces, n)
        if at < len(spaces):
            free = spaces[at]
            b = room[free].pop()
            if not room[free]:
                spaces.pop(at)
            bins[b].append(i)
        else:
            free, b = size, len(bins)
            bins.append([i])
        left = free - n
        if left:
            if not room[left]:
                bisect.insort(spaces, left)
            room[left].append(b)
    return bins


class _Givers:
    """Underfull bins by the lengths that they can give, one piece or two; for each length the least fill of such a bin."""

    def __init__(self, size: int):
        self.heaps: list[list[list[tuple[int, int, int]]]] = [[[] for _ in range(size + 1)] for _ in range(2)]
        self.least = np.full((2, size + 1), size + 1)
        self.version: dict[int, int] = {}
        self.listed: dict[int, tuple[set[int], set[int]]] = {}

    def add(self, b: int, fill: int, lengths: Counter) -> None:
        """Lists bin b; its entries stand until it is removed."""
        kinds = sorted(lengths)
        pairs = {x + y for i, x in enumerate(kinds) for y in kinds[i:] if x != y or lengths[x] > 1}
        self.listed[b] = set(kinds), pairs
        version = self.version.setdefault(b, 0)
        for k, sums in enumerate(self.listed[b]):
            for n in sums:
                heapq.heappush(self.heaps[k][n], (fill, b, version))
                self.least[k, n] = self.heaps[k][n][0][0]

    def remove(self, b: int) -> None:
        self.version[b] += 1
        for k, sums in enumerate(self.listed.pop(b)):
            for n in sums:
                heap = self.heaps[k][n]
                while heap and heap[0][2] != self.version[heap[0][1]]:
                    heapq.heappop(heap)
                self.least[k, n] = heap[0][0] if heap else len(self.least[k])

    def best(self, fill: int, size: int, lengths: Counter) -> tuple[int, int, int, int]:
        """(gain, pieces given - 1, their length, length given back or 0) of the exchange that fills a bin most; the giver is no fuller."""
        found, free = (0, 0, 0, 0), size - fill
        for back in (0, *lengths):
            for k in (0, 1) if back else (0,):
                at = np.flatnonzero(self.least[k, back + found[0] + 1 : back + free + 1] <= fill)
                if len(at):
                    gain = found[0] + 1 + int(at[-1])
                    found = gain, k, back + gain, back
        return found


def local_search(bins: list[list[int]], lengths: list[int], size: int) -> list[list[int]]:
    """Moves, one-for-one and two-for-one swaps between underfull bins that raise the sum of squared fills; empty bins go.

    All underfull bins take part until no exchange raises the sum. It is a whole number and bounded, so this ends.
    """
    held: list[dict[int, list[int]]] = []  # pieces of each bin by length
    for b in bins:
        held.append({})
        for i in b:
            held[-1].setdefault(lengths[i], []).append(i)
    fill = [sum(lengths[i] for i in b) for b in bins]
    count = lambda b: Counter({n: len(x) for n, x in held[b].items()})
    givers = _Givers(size)
    for b in range(len(bins)):
        if 0 < fill[b] < size:
            givers.add(b, fill[b], count(b))

    def hand(a: int, b: int, n: int) -> None:
        i = held[a][n].pop()
        if not held[a][n]:
            del held[a][n]
        held[b].setdefault(n, []).append(i)
        fill[a], fill[b] = fill[a] - n, fill[b] + n

    changed = True
    while changed:
        changed = False
        for b in sorted(givers.listed, key=lambda b: (-fill[b], b)):
            if b not in givers.listed:
                continue
            givers.remove(b)
            while 0 < fill[b] < size:
                gain, two, n, back = givers.best(fill[b], size, held[b])
                if not gain:
                    break
                a = givers.heaps[two][n][0][1]
                givers.remove(a)
                out = [n] if not two else next([x, n - x] for x in held[a] if n - x in held[a] and (n != 2 * x or len(held[a][x]) > 1))
                for x in out:
                    hand(a, b, x)
                if back:
                    hand(b, a, back)
                if fill[a]:
                    givers.add(a, fill[a], count(a))
                changed = True
            if fill[b] < size:
                givers.add(b, fill[b], count(b))
    return [[i for x in b.values() for i in x] for b in held if b]


def _packed(df: DataFrame, groups: int, salt: int, sequence: int) -> DataFrame:
    """df (row, key, piece, length) with its bin: a number within its group, the place in it, and the bin's fill."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "key", "piece", "row"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        lengths = pdf["length"].tolist()
        group = int(pdf["part"].iloc[0])
        bins = local_search(best_fit(lengths, sequence), lengths, sequence)
        at, offset, fill = [0] * len(lengths), [0] * len(lengths), [0] * len(lengths)
        for k, b in enumerate(bins):
            place = 0
            for i in b:
                at[i], offset[i] = k, place
                place += lengths[i]
            for i in b:
                fill[i] = place
        return pdf[["row", "key", "piece", "length"]].assign(bin=np.array(at, np.int64) * groups + group, offset=np.array(offset, np.int64), fill=np.array(fill, np.int64))

    dealt = df.withColumn("part", F.pmod(F.xxhash64(F.lit(salt), "key", "piece", "row"), F.lit(groups)))
    return dealt.repartition(min(groups, 4096), "part").groupBy("part").applyInPandas(pack, "row long, key long, piece int, length long, bin long, offset long, fill long")


def pack_documents(df: DataFrame, text: str = "text", key: str = "doc_id", tokenizer: str = "byte_bpe_50k.json", sequence: int = SEQUENCE, group: int = GROUP) -> DataFrame:
    """(key, piece, start, length, ids, sequence_id, offset) of each piece of each document.

    A null text counts as empty and gives the end id alone. Keys are integers; rows that repeat one are packed each
    for itself, with the same keys and piece numbers. Equal lengths are taken in order of key and piece. Rows with a
    null key are left out.
    """
    pieces = written(pieces_of(df, text, key, tokenizer, sequence).withColumn("row", F.monotonically_increasing_id()))
    short = pieces.where(F.col("length") < sequence).select("row", "key", "piece", "length")
    count = short.count()
    first = cut(_packed(short, max(1, round(count / group)), 1, sequence))
    least = sequence * 31 // 32  # what is missing in fuller bins adds up to less than their number divided by 32
    done = first.where(F.col("fill") > least)
    left = first.where(F.col("fill") <= least).select("row", "key", "piece", "length")
    again = _packed(left, max(1, round(left.count() / group)), 2, sequence)
    placed = done.select("row", (F.col("bin") * 3).alias("sequence_id"), "offset").unionByName(again.select("row", (F.col("bin") * 3 + 1).alias("sequence_id"), "offset"))
    full = pieces.where(F.col("length") == sequence).withColumns({"sequence_id": F.col("row") * 3 + 2, "offset": F.lit(0).cast("long")})
    return pieces.where(F.col("length") < sequence).join(placed, "row").unionByName(full).drop("row")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return packed.select(F.col("key").alias("doc_id"), "piece", "start", "length", crc32_of(F.col("ids")).alias("ids_crc32"), "sequence_id", "offset")
