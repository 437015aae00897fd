"""Line deduplication by a deletion-neighbourhood join.

Of lines that are equal, or within one edited character (inserted, deleted or replaced) of each other, the one
that comes first (smallest document id, then line number) stays and the others go. Two lines are within one edit
exactly if leaving out one character at some place makes them equal, so each line emits the hash of itself without
each of its characters, keyed by the place; lines whose variants meet are joined to the earliest of them and
verified by edit distance. Short lines are alike by chance, so of these only equal ones go; lines of spaces stay.

A variant's hash is a sum over its characters, so all variants of a line come from the sums of its beginnings, in
time and memory in proportion to its length. A line has as many variants as characters, so a loss-free sieve comes
first: an edit falls into one half of a line, and the other half of the two lines is equal. Only lines that share a
half with another line, and of them only the variants in the half that may differ, take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from voxmere.llm.common import cut, in_batches, likely, may_be_in, table, unused, written
from voxmere.llm.textvec import U64, mix, slices

#: Lines with fewer characters only go as equal copies: short ones are within an edit of each other by chance.
MIN_CHARS = 24
#: Variants that a task makes at once.
VARIANTS = 1 << 16
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse among the 64-bit numbers
_INVERSE = pow(_BASE, -1, 1 << 64)


def _lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc", F.posexplode(F.split("text", "\n", -1)).alias("no", "line"))


def _at() -> Column:
    """A line's place as one number that orders by document, then line; a fixed-width type, so that its minimum needs no sort."""
    return (F.col("doc").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(11,0)") + F.col("no").cast("decimal(11,0)")).cast("decimal(38,0)")


def _place(at: str) -> list[Column]:
    """doc and no of such a number."""
    no = F.pmod(F.col(at), F.lit(1 << 31).cast("decimal(38,0)")).cast("int")
    return [F.expr(f"cast(({at} - pmod({at}, {1 << 31})) div {1 << 31} as bigint)").alias("doc"), no.alias("no")]


def _halves() -> list[str]:
    """Hash keys of a line's halves, for partners as long as it and for one that is longer by one; the bit is the key's number."""
    keys = []
    for longer in (0, 1):
        n = f"(chars + {longer})"
        keys += [f"xxhash64({n}, 0, substring(line, chars - ({n} - {n} div 2) + 1, {n} - {n} div 2))", f"xxhash64({n}, 1, substring(line, 1, {n} div 2))"]
    return keys


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base ** 2 ... to the nth power, modulo 2 ** 64."""
    return np.cumprod(np.concatenate([[U64(1)], np.full(n, U64(base))]))


def _codes(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """A number for each UTF-8 character: its bytes in order."""
    lead = np.flatnonzero(begins)
    code = data[lead].astype(np.uint64)
    size = np.diff(np.append(lead, len(data)))
    for k in range(1, 4):
        more = size > k
        code[more] = (code[more] << U64(8)) | data[lead[more] + k]
    return code


def variants(lines: pa.Array, masks: np.ndarray, most: int = VARIANTS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, n, i, v): the longer partner's length, the place of the character left out, and the hash of what remains.

    lines are UTF-8; a bit of a row's mask wants the variants of a half: as the longer partner, or as one of equal
    length, those without a character of the first (1) or second half (2); as the partner that is shorter by one, the
    line as it is for each place of the first (4) or second half (8) of the longer one. At most `most` at a time.
    """
    for first, _, data, offsets in slices(lines):
        begins = (data & 0xC0) != 0x80
        at = np.concatenate([[0], np.cumsum(begins)])[offsets]
        code = _codes(data, begins)
        up, down = _powers(_BASE, len(code)), _powers(_INVERSE, len(code))
        sums = np.concatenate([[U64(0)], np.cumsum(mix(code) * up[:-1])])
        start, chars, mask = at[:-1], np.diff(at), masks[first : first + len(at) - 1]
        for bit, longer in ((1, 0), (2, 0), (4, 1), (8, 1)):
            rows = np.flatnonzero(mask & bit)
            n = chars[rows] + longer
            low, high = (0 * n, n // 2) if bit in (1, 4) else (n // 2, n)
            ends = np.cumsum(high - low)
            for begin in range(0, int(ends[-1]) if len(ends) else 0, most):
                flat = np.arange(begin, min(begin + most, int(ends[-1])))
                which = np.searchsorted(ends, flat, "right")
                i = flat - ends[which] + high[which]
                row = rows[which]
                left, right = start[row], start[row] + chars[row]
                if longer:
                    v = sums[right] - sums[left]
                else:
                    v = sums[left + i] - sums[left] + (sums[right] - sums[left + i + 1]) * U64(_INVERSE)
                yield first + row, n[which], i, v * down[left]


def _emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, n, i, v in variants(batch.column(1), batch.column(2).to_numpy(zero_copy_only=False)):
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(n.astype(np.int32)), pa.array(i.astype(np.int32)), pa.array(v.view(np.int64))], names=["at", "n", "i", "v"])


def within_one_edit(a: str, b: str) -> bool:
    """True for texts at most one edited character apart; the first difference is found by comparing halves, so time is linear."""
    a, b = sorted((a, b), key=len)
    if len(b) - len(a) > 1:
        return False
    same, most = 0, len(a)
    while same < most:
        middle = (same + most + 1) // 2
        if a[same:middle] == b[same:middle]:
            same = middle
        else:
            most = middle - 1
    return a[same + (len(a) == len(b)) :] == b[same + 1 :]


@F.pandas_udf(BooleanType())
def _close(one: pd.Series, other: pd.Series) -> pd.Series:
    """Whether two lines (UTF-8) are within one edit. The engine's levenshtein takes the square of a line's length even with a bound."""
    text = lambda x: x.decode("utf-8", "surrogateescape")
    return pd.Series([within_one_edit(text(a), text(b)) for a, b in zip(one, other, strict=True)], dtype=bool)


def duplicate_lines(df: DataFrame, text: str = "text", key: str = "doc_id", min_chars: int = MIN_CHARS, max_edits: int = 1) -> DataFrame:
    """(doc, removed): the sorted numbers (from 0) of the lines that go, for documents that lose any.

    Lines are parted by \\n. max_edits is 0 (equal lines only) or 1. Keys are integers; of rows that repeat one the
    lines of a number stand at one place, of which no line goes as a copy of another. Of lines under `min_chars`
    characters only equal copies go; lines of nothing but spaces always stay. Rows with a null key or text have no lines.
    """
    if max_edits not in (0, 1):
        raise ValueError("max_edits must be 0 or 1")
    docs = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    lines = _lines(docs).where(F.trim("line") != "").withColumn("chars", F.length("line"))
    named = lines.select("doc", "no", _at().alias("at"), F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), *(F.when(F.col("chars") >= min_chars, F.expr(k)).alias(f"k{i}") for i, k in enumerate(_halves())))
    unique = written(named.groupBy("h1", "h2").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("m"), *(F.min(f"k{i}").alias(f"k{i}") for i in range(4))))
    repeated = unique.where("m > 1").select("h1", "h2", "first", F.lit(False).alias("near"))
    if max_edits:
        near = cut(_near(docs, unique))
        edited = unique.select("h1", "h2", "first").join(near, "first").select("h1", "h2", "first", F.lit(True).alias("near"))
        repeated = repeated.unionByName(edited).groupBy("h1", "h2").agg(F.min("first").alias("first"), F.max("near").alias("near"))
    gone = named.select("doc", "no", "at", "h1", "h2").join(cut(repeated), ["h1", "h2"]).where("near or at <> first")
    return gone.groupBy("doc").agg(F.array_sort(F.collect_set("no")).alias("removed"))


def _near(docs: DataFrame, unique: DataFrame) -> DataFrame:
    """The first occurrences (`first`) of lines that have an earlier line within one edit."""
    keys = unique.where("k0 is not null").select("first", F.posexplode(F.array("k0", "k1", "k2", "k3")).alias("number", "half"))
    shared = cut(keys.groupBy("half").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("half"))
    sieved = keys.join(shared, "half").groupBy("first").agg(F.bit_or(F.expr("shiftleft(1, number)")).alias("mask"))
    wanted = cut(sieved.select(*_place("first"), "mask").groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("no", "mask"))).alias("masks")))
    lines = _lines(likely(docs, "doc", wanted, "doc").join(wanted, "doc").select(F.struct("doc", "masks").alias("doc"), "text")).select(F.col("doc.doc").alias("doc"), "no", "line", F.expr("doc.masks[no]").alias("mask")).where("mask is not null")
    lines = written(lines.select(_at().alias("at"), "line", "mask"))
    emitted = in_batches(lines.select("at", F.col("line").cast("binary").alias("line"), "mask")).mapInArrow(_emitted, "at decimal(38,0), n int, i int, v long")
    meet = cut(emitted.groupBy("n", "i", "v").agg(F.min("at").alias("earliest"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m"))
    pairs = emitted.join(meet, ["n", "i", "v"]).where("at > earliest").select("at", "earliest").distinct()
    early = lines.select(F.col("at").alias("earliest"), F.col("line").cast("binary").alias("early_line"))
    late = lines.select("at", F.col("line").cast("binary").alias("late_line"))
    close = pairs.join(early, "earliest").join(late, "at").where(_close("early_line", "late_line"))
    return close.select(F.col("at").alias("first")).distinct()


def without_duplicate_lines(df: DataFrame, text: str = "text", key: str = "doc_id", min_chars: int = MIN_CHARS, max_edits: int = 1) -> DataFrame:
    """df with the duplicate lines taken out of its texts; rows left with nothing are dropped, others stay as they are.

    Keys are distinct integers (of rows that repeat one the first line of each number stands for the others); rows
    with a null key or text stay.
    """
    doc, gone, maybe = unused(df, "doc"), unused(df, "removed"), unused(df, "maybe")
    removed = written(duplicate_lines(df, text, key, min_chars, max_edits).select(F.col("doc").alias(doc), F.col("removed").alias(gone)))
    sieved = df.withColumn(maybe, F.coalesce(may_be_in(df, key, removed, doc), F.lit(False)))
    lines = sieved.where(F.col(maybe)).drop(maybe).withColumn(text, F.split(text, "\n", -1))  # before the join, so that a text is split once
    joined = lines.join(removed, F.col(key).cast("long") == F.col(doc), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size(text) - 1), F.coalesce(gone, F.array().cast("array<int>")))
    kept = F.array_join(F.transform(stay, lambda i: F.get(text, i)), "\n")
    whole = F.array_join(text, "\n")
    cleaned = joined.withColumn(text, F.when(F.col(gone).isNull(), whole).otherwise(kept)).where(F.col(gone).isNull() | F.col(text).rlike(r"\S"))
    return sieved.where(~F.col(maybe)).drop(maybe).unionByName(cleaned.drop(doc, gone).select(*(f"`{c}`" for c in df.columns)))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    removed = duplicate_lines(docs)
    counted = docs.select("doc_id", F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long").alias("n_lines"))
    joined = counted.join(removed.withColumnRenamed("doc", "doc_id"), "doc_id", "left")
    return joined.select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join(F.col("removed").cast("array<string>"), ","), F.lit("")).alias("removed_lines"))


ORACLE = f"""
with parts as (select doc_id, string_split(text, chr(10)) as a from documents where text is not null),
lines as (select doc_id, unnest(range(len(a))) as no, unnest(a) as line from parts),
solid as (select *, length(line) as n from lines where trim(line) <> ''),
firsts as (select line, n, min((doc_id, no)) as at from solid group by line, n),
long_firsts as (select * from firsts where n >= {MIN_CHARS}),
candidates as (
  select a.line as x, b.line as y, a.n as n, b.n as m, a.at as p, b.at as q from long_firsts a join long_firsts b
    on b.n between a.n - 1 and a.n and substr(a.line, 1, a.n // 2) = substr(b.line, 1, a.n // 2) and a.line <> b.line
  union
  select a.line, b.line, a.n, b.n, a.at, b.at from long_firsts a join long_firsts b
    on b.n between a.n - 1 and a.n and right(a.line, a.n - a.n // 2) = right(b.line, a.n - a.n // 2) and a.line <> b.line
),
close as (
  select * from candidates
  where list_bool_or(list_transform(range(n), lambda i: substr(x, 1, i) || substr(x, i + 2) = case when n = m then substr(y, 1, i) || substr(y, i + 2) else y end))
),
near as (select x as line from close where p > q union select y from close where q > p),
gone as (
  select l.doc_id, l.no from solid l join firsts f using (line) left join near e using (line)
  where e.line is not null or (l.doc_id, l.no) <> f.at
),
lost as (select doc_id, count(*) as n_removed, string_agg(no::varchar, ',' order by no) as removed_lines from gone group by doc_id)
select d.doc_id, len(string_split(coalesce(d.text, ''), chr(10)))::bigint as n_lines, coalesce(n_removed, 0)::bigint as n_removed, coalesce(removed_lines, '') as removed_lines
from documents d left join lost using (doc_id)
"""
