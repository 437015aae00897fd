"""Spelling variants by a trie with one error merged into it.

The trie of all words is a table: a row for each edge, with the number of words below it. At every node that
branches, the child with the most words below continues the heavy path; the other children, and the end of a word
that stops there, are light. A word leaves heavy paths at few places (each time at least half of the words are left
behind), and only there is it merged, the smaller subtree into the larger: with the light character replaced by the
heavy one, with it skipped, and with the heavy one put before it. Where the changed word ends at the end of a word
of the trie, the two are one edit apart. Words that leave at one node by two light characters and end alike are
grouped by the word with that character left open. Two words part at exactly one node, so each pair is found once.

Strings are not copied for each of their prefixes: a prefix is the sum of one random 128-bit number for each pair of
place and character, so prefixes, tails and changed words are differences of sums. A word of any length has one row
for each of its characters, and no row holds more than one word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmere.llm.common import cut, in_batches, may_be_in, table, written
from voxmere.llm.textvec import U64, mix

LETTERS = "A-Za-z\\u00C0-\\u00FF"
LEAST_CHARS, LEAST_COUNT = 5, 3
#: One of so many words of the corpus loses a character (see op12's contract).
DAMAGE = 97
#: Prefixes of up to so many characters are sent to all tasks: words are runs of 90 characters (26 + 64), so there
#: are at most 1 + 90 + 8100 of them.
SHORT = 2
#: About so many characters are spelt at a time.
ROWS = 1 << 14
END = -1

_EDGE = "c int, p1 long, p2 long, at int"
_WAYS = "a1 long, a2 long, b1 long, b2 long, d1 long, d2 long, s1 long, s2 long, skips boolean"


def number(c: np.ndarray, at: np.ndarray, lane: int) -> np.ndarray:
    """The random number of a character at a place."""
    with np.errstate(over="ignore"):
        return mix(mix(c.astype(U64) + U64(0x9E3779B97F4A7C15 if lane else 1)) + at.astype(U64) * U64(0xD1B54A32D192ED03))


def characters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all words one after the other, and where each word begins (and the last ends)."""
    joined = "".join(words.to_pylist())
    ends = np.cumsum(pc.utf8_length(words).to_numpy(zero_copy_only=False), dtype=np.int64)
    return np.frombuffer(joined.encode("utf-32-le"), np.uint32), np.concatenate([np.zeros(1, np.int64), ends])


def whole(words: pa.Array) -> list[np.ndarray]:
    """The two halves of each word's number; words are not empty."""
    c, begin = characters(words)
    at = np.arange(len(c)) - np.repeat(begin[:-1], np.diff(begin))
    with np.errstate(over="ignore"):
        return [np.add.reduceat(number(c, at, k), begin[:-1]).view(np.int64) if len(c) else np.zeros(0, np.int64) for k in (0, 1)]


def places(words: pa.Array) -> dict[str, np.ndarray]:
    """A row for each character of each word and one for its end; words are not empty.

    a: the whole word. p: what is before the place. b: the word without the character there, its place left open.
    d: the word with it skipped; skips: not if the next is the same, since skipping that one gives the same word.
    s: what is before, and from there on everything one place later, so that a character fits in between.
    """
    c, begin = characters(words)
    length = np.diff(begin)
    word = np.repeat(np.arange(len(length)), length + 1)
    start = begin[:-1] + np.arange(len(length))  # of each word's rows
    at = np.arange(len(word)) - start[word]
    end = at == length[word]
    char = np.full(len(word), END, np.int32)
    char[~end] = c
    out = {"c": char, "at": at.astype(np.int32)}
    with np.errstate(over="ignore"):
        for k, lane in enumerate("12"):
            own, back, on = (np.where(end, U64(0), number(char, at + shift, k)) for shift in (0, -1, 1))
            upto, back_upto, on_upto = (np.cumsum(x, dtype=U64) for x in (own, back, on))
            last = start + length  # the row of a word's end: sums up to there hold the whole word
            before = upto - own - (upto - own)[start][word]  # what precedes a row in its word
            out[f"a{lane}"] = (upto[last] - (upto - own)[start])[word]
            out[f"p{lane}"] = before
            out[f"b{lane}"] = out[f"a{lane}"] - own
            out[f"d{lane}"] = before + back_upto[last][word] - back_upto
            out[f"s{lane}"] = before + on_upto[last][word] - (on_upto - on)
    follows = np.append(char[1:], np.int32(END))
    out["skips"] = ~end & (char != follows)
    return out


def spelt(words: DataFrame) -> DataFrame:
    """The rows of `places` of every word."""
    names = [x.split()[0] for x in f"{_EDGE}, {_WAYS}".split(", ")]

    def rows(batches):
        for b in batches:
            for first, last in slices_of(b["word"]):
                found = places(b["word"].slice(first, last - first))
                columns = [v.view(np.int64) if v.dtype == U64 else v for v in (found[k] for k in names)]
                for i in range(0, len(columns[0]), ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array(v[i : i + ROWS]) for v in columns], names=names)

    return in_batches(words.select("word")).mapInArrow(rows, f"{_EDGE}, {_WAYS}")


def slices_of(words: pa.Array) -> list[tuple[int, int]]:
    """Ranges of words with about ROWS characters together; a longer word is a range of its own."""
    ends = np.cumsum(pc.utf8_length(words).to_numpy(zero_copy_only=False), dtype=np.int64)
    cuts = np.flatnonzero(np.diff(ends // ROWS)) + 1
    bounds = [0, *cuts.tolist(), len(ends)]
    return [(i, j) for i, j in zip(bounds, bounds[1:]) if i < j]


def heavy_paths(rows: DataFrame) -> DataFrame:
    """(p1, p2, at, heavy) of the nodes with two ways on or more: the character with the most words behind it, the smaller of equals."""
    edges = rows.groupBy("p1", "p2", "at", "c").agg(F.count(F.lit(1)).alias("below"))
    way = F.when(F.col("c") != END, F.struct("below", (-F.col("c")).alias("minus"), "c"))
    return edges.groupBy("p1", "p2", "at").agg(F.count(F.lit(1)).alias("ways"), F.max(way).alias("top")).where("ways > 1").select("p1", "p2", "at", F.col("top.c").alias("heavy"))


def merged(light: DataFrame) -> DataFrame:
    """(a1, a2, t1, t2, open): each word's key with those of the words it becomes where it leaves a heavy path; `open` is the place for words with a character left open, else null."""

    def change(batches):
        for b in batches:
            x = {k: np.asarray(b[k]) for k in b.schema.names}
            at, real = x["at"], x["c"] != END
            put = [number(x["heavy"], at, k) for k in (0, 1)]
            lane = lambda n, k: x[f"{n}{k + 1}"].view(U64)
            with np.errstate(over="ignore"):
                ways = [
                    (real, [lane("b", k) + put[k] for k in (0, 1)], None),
                    (real & x["skips"], [lane("d", k) for k in (0, 1)], None),
                    (np.ones(len(at), bool), [lane("s", k) + put[k] for k in (0, 1)], None),
                    (real, [lane("b", k) for k in (0, 1)], at),
                ]
            for kept, key, place in ways:
                columns = [x["a1"][kept], x["a2"][kept], *(k[kept].view(np.int64) for k in key)]
                opened = pa.nulls(int(kept.sum()), pa.int32()) if place is None else pa.array(place[kept])
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), opened], names=["a1", "a2", "t1", "t2", "open"])

    return light.mapInArrow(change, "a1 long, a2 long, t1 long, t2 long, open int")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best): for each of the distinct words (word, n) that has words one edit away, their number and the (minus, word) of the most frequent of them, the smallest of equals."""

    def keys(batches):
        for b in batches:
            found = whole(b["word"])
            yield b.append_column("w1", pa.array(found[0])).append_column("w2", pa.array(found[1]))

    keyed = written(in_batches(words.select("word", "n")).mapInArrow(keys, "word string, n long, w1 long, w2 long"))
    rows = written(spelt(words))
    nodes = cut(heavy_paths(rows))
    light = F.col("c") != F.col("heavy")
    on = ["p1", "p2", "at"]
    short = rows.where(F.col("at") <= SHORT).join(F.broadcast(nodes.where(F.col("at") <= SHORT)), on).where(light)
    deep = rows.where(F.col("at") > SHORT).join(nodes.where(F.col("at") > SHORT), on).where(light)
    changed = merged(short.unionByName(deep))
    # most changed words are none of the trie's: those that cannot be are neither written nor moved
    changed = written(changed.where(F.col("open").isNotNull() | F.coalesce(may_be_in(changed, "t1", keyed, "w1"), F.lit(False))))

    word_of = lambda side: keyed.select(F.col("w1").alias(f"{side}1"), F.col("w2").alias(f"{side}2"), F.struct((-F.col("n")).alias("minus"), "word").alias(f"{side}_is"))
    met = changed.where("open is null").join(word_of("t"), ["t1", "t2"]).join(word_of("a"), ["a1", "a2"])
    pairs = met.select(F.explode(F.array(F.struct(F.col("a_is.word").alias("word"), F.col("t_is").alias("near")), F.struct(F.col("t_is.word").alias("word"), F.col("a_is").alias("near")))).alias("x")).select("x.word", F.lit(1).cast("long").alias("n_near"), F.col("x.near").alias("best"))
    # words that differ in the open character only: at most one for each character there is
    alike = changed.where("open is not null").groupBy("t1", "t2", "open").agg(F.collect_list(F.struct("a1", "a2")).alias("of")).where(F.size("of") > 1)
    members = alike.select("t1", "t2", "open", F.explode("of").alias("a")).select("t1", "t2", "open", "a.*").join(word_of("a"), ["a1", "a2"])
    ranked = members.groupBy("t1", "t2", "open").agg(F.array_sort(F.collect_list("a_is")).alias("in"))
    others = ranked.select(F.size("in").alias("m"), F.col("in")[0].alias("first"), F.col("in")[1].alias("second"), F.explode("in").alias("own"))
    groups = others.select(F.col("own.word").alias("word"), (F.col("m") - 1).cast("long").alias("n_near"), F.when(F.col("own") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("best"))
    return pairs.unionByName(groups).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def grouped(words: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of distinct words (word, n); words that are null or empty are left out.

    A word's form is its most frequent near word (the smallest of equals) if that is at least twice as frequent; its
    root is the end of the chain of forms. Counts at least double along a chain, so chains are short and end.
    """
    some = words.where("length(word) > 0").select("word", F.col("n").cast("long").alias("n"))
    near = near_words(some)
    joined = some.join(near, "word", "left")
    is_form = F.coalesce(-F.col("best.minus") >= 2 * F.col("n"), F.lit(False))
    formed = written(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, -F.col("best.minus")).alias("form_n")))
    steps = formed.where("form is not null").select("word", F.col("form").alias("root"))
    while True:  # each round halves what is left of a chain
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = cut(steps.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        steps = after.drop("moved")
        if after.where("moved").isEmpty():
            break
    return formed.join(steps, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def damaged(run: Column, key: Column) -> Column:
    """The run, which loses one character if the crc32 of '<key>:<run>' is a multiple of DAMAGE."""
    h = F.crc32(F.concat(key, F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run)).cast("int")
    return F.when(h % DAMAGE == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def counted_words(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(word, n): words of LEAST_CHARS characters and LEAST_COUNT occurrences or more among the damaged runs of letters of whole texts.

    Only A to Z are lower-cased. A null text has no runs, a null key counts as an empty one; rows that repeat a key
    or a text count each. Runs shorter than LEAST_CHARS cannot become words and are not listed.
    """
    upper, lower = (("".join(chr(a + i) for i in range(26))) for a in (65, 97))
    found = F.explode(F.regexp_extract_all(F.col(text), F.lit(f"[{LETTERS}]{{{LEAST_CHARS},}}"), F.lit(0)))
    runs = df.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), found.alias("run"))
    words = runs.select(damaged(F.translate("run", upper, lower), F.col("key")).alias("word")).where(F.length("word") >= LEAST_CHARS)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(written(counted_words(table(spark, sf_dir, "documents"))))
