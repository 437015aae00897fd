"""Exact removal of repeated byte strings by distributed suffix sorting.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else. Sorting every suffix of the
corpus is not needed for that: every string of LENGTH bytes has one anchor, the place inside it whose GRAM bytes
hash lowest (leftmost of equals), so equal strings have equal anchors at equal distances. Suffixes are sorted only
at anchors, and only at those whose GRAM bytes occur more than once:

1. Every text's anchors are found. Texts that are equal as a whole are recognised by their digest; if they are
   long enough they go as a whole, and the one with the smallest id stands for them below.
2. The anchors' hashes are counted over the corpus; those that occur twice are looked at, in context.
3. The suffixes at the anchors that share a hash (the bucket, a common prefix of GRAM bytes) are sorted
   deep-shallow: multikey quicksort on 8-byte words down to SHALLOW bytes, then blind tries order the groups that
   are still equal there. The reversed prefixes before the anchors are sorted likewise. With the common prefix
   lengths of neighbours in the two orders, strings around two anchors are equal exactly if they fall in the same
   run of both orders; so every string in the bucket is judged without comparing pairs.
4. Anchors whose surroundings are equal throughout need no sorting among themselves: all their strings repeat, and
   one of them stands for the others. A bucket with more than HOT anchors, as of a passage in very many documents,
   is brought down in that way and then split: strings that begin far before the anchor share the bytes before it,
   the others those after it, so either half of the distances has a longer common string, by which it falls into
   smaller groups. Halving goes on until every group is small enough for step 3 or a single string.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmere.llm.common import cut, in_batches, likely, table, written
from voxmere.llm.textvec import U64, mix, slices, text_buffers

GRAM, SHALLOW, HOT = 32, 96, 32768  # a bucket of HOT anchors takes about 60 MB in a task
#: A row is known by its id and a hash of its text, so rows that repeat an id stay apart.
KEY = "struct<id:bigint,tag:bigint>"
_STEP = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _STEP and of its inverse modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        with np.errstate(over="ignore"):
            _POWERS["up"] = np.cumprod(np.concatenate([np.ones(1, U64), np.full(n, _STEP, U64)]))
            _POWERS["down"] = np.cumprod(np.concatenate([np.ones(1, U64), np.full(n, pow(_STEP, -1, 1 << 64), U64)]))
    return _POWERS["up"], _POWERS["down"]


class Rolling:
    """Hashes of any substrings of one byte array."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = _powers(len(data) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, U64), np.cumsum((data.astype(U64) + U64(1)) * self.up[: len(data)])])

    def __call__(self, start: np.ndarray, length) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[start + length] - self.sums[start]) * self.down[start])


def anchors(data: np.ndarray, offs: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, hash, first string start, last string start) of the anchors of all strings of `length` bytes inside a row."""
    n = len(data)
    z = np.zeros(0, np.int64)
    if n < length:
        return z, z, z.astype(U64), z, z
    rolling = Rolling(data)
    h = rolling(np.arange(n - gram + 1), gram)
    low = (h & U64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=U64)  # the place decides between equals
    span, width = length - gram + 1, 1
    while width * 2 <= span:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: n - length + 1], low[span - width :][: n - length + 1])
    start = np.arange(len(low))
    row = np.searchsorted(offs, start, "right") - 1
    inside = start + length <= offs[row + 1]
    start, row, place = start[inside], row[inside], (low[inside] & U64(0xFFFFFFFF)).astype(np.int64)
    if not len(start):
        return z, z, z.astype(U64), z, z
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (row[1:] != row[:-1])]))
    last = np.append(new[1:], len(start)) - 1
    return row[new], place[new], h[place[new]], start[new], start[last]


def _lengthened(strings: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of rows of 8-byte words within groups down to `depth` bytes: order, and which rows start a new run of equals."""
    words = strings.view(">u8").astype(U64)
    order = np.argsort(group, kind="stable")
    run = np.concatenate([[True], group[order][1:] != group[order][:-1]]) if len(order) else np.zeros(0, bool)
    for k in range(min(depth // 8, words.shape[1])):
        first = np.flatnonzero(run)
        size = np.diff(np.append(first, len(order)))
        busy = np.repeat(size > 1, size)  # rows that stand alone are done
        if not busy.any():
            break
        at = np.flatnonzero(busy)
        sub = order[at]
        part = np.cumsum(run)[at]
        inner = np.lexsort((words[sub, k], part))
        order[at] = sub[inner]
        w, part = words[order[at], k], part[inner]
        run[at[1:]] |= (w[1:] != w[:-1]) | (part[1:] != part[:-1])
        run[at[0]] = True
    return order, run


class BlindTrie:
    """Strings of one length by the bytes at which they part. Descending looks at those bytes only; one comparison with the leaf then shows where a new string parts from the others."""

    def __init__(self):
        self.root = None  # a leaf (string, ids) or a node [depth, {byte: child}]

    def insert(self, string: bytes, number: int) -> None:
        if self.root is None:
            self.root = (string, [number])
            return
        node, path = self.root, []
        while isinstance(node, list):
            path.append(node)
            child = node[1].get(string[node[0]])
            node = child if child is not None else next(iter(node[1].values()))
        if node[0] == string:
            node[1].append(number)
            return
        size = len(string)
        apart = size - ((int.from_bytes(node[0], "big") ^ int.from_bytes(string, "big")).bit_length() + 7) // 8
        above, below = None, self.root
        for step in path:
            if step[0] > apart:
                break
            above, below = step, step[1].get(string[step[0]])
        if above is not None and above[0] == apart:
            above[1][string[apart]] = (string, [number])
            return
        fork = [apart, {node[0][apart]: below, string[apart]: (string, [number])}]
        if above is None:
            self.root = fork
        else:
            above[1][string[above[0]]] = fork

    def ordered(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, list):
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
            else:
                out += node[1]
        return out


def deep_shallow(strings: np.ndarray, group: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of bytes within their groups, and the common prefix of each with the one before it (-1 at a group's first)."""
    if not len(strings):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order, run = _lengthened(strings, group, shallow)
    first = np.flatnonzero(run)
    size = np.diff(np.append(first, len(order)))
    for a, m in zip(first[size > 1], size[size > 1]):
        trie = BlindTrie()
        for i in order[a : a + m].tolist():
            trie.insert(strings[i].tobytes(), i)
        order[a : a + m] = trie.ordered()
    common = np.full(len(order), -1)
    for a in range(1, len(order), 65536):
        b = min(len(order), a + 65536)
        differ = strings[order[a:b]] != strings[order[a - 1 : b - 1]]
        common[a:b] = np.where(differ.any(axis=1), differ.argmax(axis=1), strings.shape[1])
    common[1:][group[order[1:]] != group[order[:-1]]] = -1
    return order, common


def judged(group: np.ndarray, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> np.ndarray:
    """Rows x distances: whether the string that starts so far before the row's anchor also stands at another row of its group.

    left: the bytes before the anchors, nearest first; right: those from the anchors on; low to high: the
    distances at which a row has a string. Bytes beyond those are filled with 0 and never decide.
    """
    by_left, common_left = deep_shallow(left, group)
    by_right, common_right = deep_shallow(right, group)
    out = np.zeros((len(group), length), bool)
    node_left, node_right = np.empty(len(group), np.int64), np.empty(len(group), np.int64)
    for d in range(int(low.min()) if len(low) else 0, int(high.max()) + 1 if len(high) else 0):
        rows = np.flatnonzero((low <= d) & (high >= d))
        if len(rows) < 2:
            continue
        node_left[by_left] = np.cumsum(common_left < d)
        node_right[by_right] = np.cumsum(common_right < length - d)
        key = node_left[rows] * (len(group) + 1) + node_right[rows]
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(rows), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        out[rows[twice], d] = True
    return out


def _bytes_matrix(data: np.ndarray, start: np.ndarray, count: np.ndarray, width: int, step: int) -> np.ndarray:
    """Rows of `width` bytes: count of them from start on in steps of 1 or -1, then zeros."""
    out = np.zeros((len(start), width), np.uint8)
    for k in range(0, len(start), 4096):
        at = start[k : k + 4096, None] + step * np.arange(width)[None, :]
        there = np.arange(width)[None, :] < count[k : k + 4096, None]
        out[k : k + 4096] = np.where(there, data[np.where(there, at, 0)], 0)
    return out


def _find_anchors(df: DataFrame, length: int, gram: int) -> DataFrame:
    def find(batches):
        for batch in batches:
            for first, last, data, offs in slices(batch["text"]):
                row, place, h, _, _ = anchors(data, offs, length, gram)
                at = np.searchsorted(row, np.arange(last - first + 1)).astype(np.int32)
                view = data.tobytes()
                digest = [hashlib.md5(view[a:b]).digest() for a, b in zip(offs[:-1], offs[1:])]
                yield pa.RecordBatch.from_arrays([
                    batch["key"].slice(first, last - first), pa.array(np.diff(offs)), pa.array(digest, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(at), pa.array(h.view(np.int64))), pa.ListArray.from_arrays(pa.array(at), pa.array((place - offs[row]).astype(np.int32))),
                ], names=["key", "n_bytes", "digest", "hashes", "places"])

    return in_batches(df).mapInArrow(find, f"key {KEY}, n_bytes long, digest binary, hashes array<long>, places array<int>")


def _selected(batch: pa.RecordBatch, length: int, gram: int):
    """Per slice: its first row, bytes, and the anchors (of all strings) that the batch's `places` name."""
    flat_places = batch["places"]
    for first, last, data, offs in slices(batch["text"]):
        row, place, h, a, b = anchors(data, offs, length, gram)
        lists = flat_places.slice(first, last - first)
        named = np.repeat(offs[:-1], np.diff(lists.offsets.to_numpy())) + lists.flatten().to_numpy()
        mine = np.isin(place, named)
        yield first, data, offs, row[mine], place[mine], h[mine], a[mine], b[mine]


def _alike(data: np.ndarray, start: np.ndarray, size: np.ndarray, groups: list[np.ndarray]) -> np.ndarray:
    """For each range of bytes the first one that equals it and agrees in all `groups` (a range alone: itself)."""
    h = Rolling(data)(start, size)
    order = np.lexsort((start, h, *groups))
    new = np.ones(len(order), bool)
    if len(order) > 1:
        new[1:] = np.any([x[order][1:] != x[order][:-1] for x in (h, *groups)], axis=0)
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    for k in range(0, len(order), 4096):  # equal hashes are not taken for equal bytes
        mine, own = order[k : k + 4096], first[k : k + 4096]
        differ = np.zeros(len(mine), bool)
        for i in np.flatnonzero(mine != own):
            n = size[mine[i]]
            differ[i] = not np.array_equal(data[start[mine[i]] : start[mine[i]] + n], data[start[own[i]] : start[own[i]] + n])
        own[differ] = mine[differ]
        first[k : k + 4096] = own
    out = np.empty(len(order), np.int64)
    out[order] = first
    return out


def _contexts(df: DataFrame, length: int, gram: int) -> DataFrame:
    """One row for each named anchor: its hash, where it is, the distances of its strings, and the bytes they cover.

    Of a slice's anchors with equal surroundings one has such a row; the spans of them all come as rows without
    bytes (see _judge), merged to runs. So a long text of one pattern has few rows.
    """

    def find(batches):
        for batch in batches:
            for first, data, offs, row, place, h, a, b in _selected(batch, length, gram):
                view = data.tobytes()
                low, high = place - b, place - a
                stand_in = _alike(data, a, b - a + length, [low, high, h]) if len(a) else np.zeros(0, np.int64)
                many = np.bincount(stand_in, minlength=len(a)) > 1
                shown = np.flatnonzero(stand_in == np.arange(len(a)))
                sure = np.flatnonzero(many[stand_in])
                around: list = [view[x : y + length] for x, y in zip(a[shown].tolist(), b[shown].tolist())]
                start, end = merged(a[sure], b[sure] + length, row[sure])
                rows = np.concatenate([row[shown], np.searchsorted(offs, start, "right") - 1])
                at = np.concatenate([place[shown], start]) - offs[rows]
                lows, highs = np.concatenate([low[shown], start + length - end]), np.concatenate([high[shown], np.zeros(len(start), np.int64)])
                keys = batch["key"].slice(first, len(offs) - 1).take(pa.array(rows))
                hashes = np.concatenate([h[shown], mix(start.astype(U64) + U64(len(view)))]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(hashes), keys, pa.array(at), pa.array(lows.astype(np.int32)), pa.array(highs.astype(np.int32)), pa.array(around + [None] * len(start), pa.binary())], names=["hash", "key", "place", "low", "high", "around"])

    return in_batches(df).mapInArrow(find, f"hash long, key {KEY}, place long, low int, high int, around binary")


def _split(contexts: DataFrame, length: int, hot: int) -> DataFrame:
    """The contexts of large buckets in groups (`hash`) of at most `hot` different ones, and rows without bytes for the spans found on the way."""
    names = ["hash", "key", "place", "low", "high", "around"]
    found = contexts.where("around is null").select(*names)
    work = contexts.where("around is not null").withColumns({"from": F.lit(0), "to": F.lit(length)})
    while True:
        ranged = work.withColumns({"e0": F.greatest("low", "from"), "e1": F.least("high", "to")}).where("e0 <= e1")
        core = F.expr(f"concat(substring(around, high - `from` + 1, `from`), substring(around, high + 1, {length} - `to`))")
        whole = F.expr(f"substring(around, high - e1 + 1, e1 + {length} - e0)")
        work = cut(ranged.select("key", "place", "from", "to", "e0", "e1", F.xxhash64("hash", "from", "to", core).alias("hash"), F.md5(whole).alias("own"), whole.alias("around")))
        alike = work.groupBy("hash", "e0", "e1", "own").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("key", "place")).alias("stand_in"))
        known = cut(work.join(alike, ["hash", "e0", "e1", "own"]))
        found = found.unionByName(known.where("m > 1").select("hash", "key", "place", F.col("e0").alias("low"), F.col("e1").alias("high"), F.lit(None).cast("binary").alias("around")))
        different = known.where(F.struct("key", "place") == F.col("stand_in")).dropDuplicates(["hash", "e0", "e1", "own"]).select("hash", "key", "place", "from", "to", F.col("e0").alias("low"), F.col("e1").alias("high"), "around")
        sizes = different.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        grouped = cut(different.join(sizes, "hash"))
        found = found.unionByName(grouped.where(F.col("n") <= hot).select(*names))
        large = grouped.where(F.col("n") > hot)
        if large.isEmpty():
            return found
        middle = F.expr("(greatest(`from`, 0) + `to`) div 2").cast("int")
        halves = F.explode(F.array(F.struct(F.col("from"), middle.alias("to")), F.struct((middle + 1).alias("from"), F.col("to"))))
        work = large.select(*names, halves.alias("half")).select(*names, "half.from", "half.to")


def _judge(contexts: DataFrame, length: int, gram: int, rows_at_once: int = 8192) -> DataFrame:
    """(key, start, end) of the runs of strings that occur twice; buckets are whole within a partition and sorted by hash. Rows without bytes are spans already: place - high to place - low + length."""
    reach = (length - gram + 7) // 8 * 8
    width = (length + 7) // 8 * 8

    def judge(table_: pa.Table):
        bare = table_["around"].is_null().combine_chunks()
        spans, table_ = table_.filter(bare), table_.filter(pa.compute.invert(bare))
        group = table_["hash"].to_numpy()
        low, high, place = (table_[c].to_numpy() for c in ("low", "high", "place"))
        data, offs = text_buffers(table_["around"])
        anchor = offs[:-1] + high
        left = _bytes_matrix(data, anchor - 1, high, reach, -1)
        right = _bytes_matrix(data, anchor, length - low, width, 1)
        hit = judged(group, left, right, low, high, length)
        hit = np.concatenate([np.zeros((len(hit), 1), bool), hit, np.zeros((len(hit), 1), bool)], axis=1)
        row, d = np.nonzero(hit[:, 1:] != hit[:, :-1])
        row, near, far = row[::2], d[::2], d[1::2] - 1
        at = spans["place"].to_numpy()
        keys = pa.concat_arrays([table_["key"].combine_chunks().take(pa.array(row)), spans["key"].combine_chunks()])
        start, end = np.concatenate([place[row] - far, at - spans["high"].to_numpy()]), np.concatenate([place[row] - near + length, at - spans["low"].to_numpy() + length])
        return pa.RecordBatch.from_arrays([keys, pa.array(start), pa.array(end)], names=["key", "start", "end"])

    def find(batches):
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= rows_at_once:
                whole = pa.Table.from_batches(held).combine_chunks()
                h = whole["hash"].to_numpy()
                done = int(np.searchsorted(h, h[-1], "left"))  # the last bucket may go on in the next batch
                for a, b in _runs(h[:done], rows_at_once):
                    yield judge(whole.slice(a, b - a))
                held = whole.slice(done).to_batches()
                rows = whole.num_rows - done
        if rows:
            whole = pa.Table.from_batches(held).combine_chunks()
            for a, b in _runs(whole["hash"].to_numpy(), rows_at_once):
                yield judge(whole.slice(a, b - a))

    return contexts.mapInArrow(find, f"key {KEY}, start long, end long")


def _runs(h: np.ndarray, about: int):
    """Ranges of whole buckets with about so many rows, or one larger bucket."""
    ends = np.append(np.flatnonzero(h[1:] != h[:-1]) + 1, len(h)) if len(h) else np.zeros(0, int)
    a = 0
    while a < len(h):
        b = ends[min(len(ends) - 1, max(np.searchsorted(ends, a + about, "right") - 1, np.searchsorted(ends, a, "right")))]
        yield a, int(b)
        a = int(b)


def _spans(df: DataFrame, text: str, key: str, length: int, gram: int, hot: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The texts (key, text), the spans (key, start, end) found between texts that differ, and (key, n_bytes) of texts that go as a whole."""
    own = F.coalesce(F.col(text), F.lit(""))
    source = df.where(F.col(key).isNotNull()).select(F.struct(F.col(key).cast("long").alias("id"), F.xxhash64(own).alias("tag")).alias("key"), own.alias("text"))
    found = written(_find_anchors(source, length, gram))
    long_enough = found.where(F.col("n_bytes") >= length)
    copies = cut(long_enough.groupBy("digest").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("m")))
    reps = long_enough.join(copies.select(F.col("rep").alias("key")), "key", "left_semi")
    places = reps.select("key", F.explode(F.arrays_zip("hashes", "places")).alias("x")).select("key", F.col("x.hashes").alias("hash"), F.col("x.places").alias("place"))
    twice = cut(places.groupBy("hash").agg(F.count(F.lit(1)).alias("m")).where("m > 1"))
    named = written(places.join(twice, "hash").groupBy("key", (F.col("m") > hot).alias("is_hot")).agg(F.collect_set("place").alias("places")))

    def contexts(is_hot: bool) -> DataFrame:
        mine = named.where(F.col("is_hot") == is_hot).select("key", "places")
        return _contexts(likely(source, "key", mine, "key").join(mine, "key").select("key", "text", "places"), length, gram)

    groups = contexts(False)
    if not named.where("is_hot").isEmpty():
        groups = groups.unionByName(_split(cut(contexts(True)), length, hot))
    spans = _judge(groups.repartition("hash").sortWithinPartitions("hash"), length, gram)
    whole = cut(long_enough.select("key", "digest", "n_bytes").join(copies.where("m > 1").select("digest"), "digest").select("key", "n_bytes"))
    return source, spans, whole


def repeated_spans(df: DataFrame, text: str = "text", key: str = "doc_id", length: int = 200, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(key, start, end) byte ranges, overlapping ones too, of all strings of `length` bytes that start at more than one place in the texts' UTF-8."""
    _, spans, whole = _spans(df, text, key, length, gram, hot)
    every = spans.unionByName(whole.select("key", F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    return every.select(F.col("key.id").alias("key"), "start", "end")


def merged(start: np.ndarray, end: np.ndarray, row: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of ranges; ranges that touch are one, unless their rows differ (ranges of rows lie apart and in order)."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    if row is not None:
        new[1:] |= row[order][1:] != row[order][:-1]
    return start[new], reach[np.append(np.flatnonzero(new)[1:], len(start)) - 1]


def remove_repeats(df: DataFrame, text: str = "text", key: str = "doc_id", length: int = 200, with_bytes: bool = True, hot: int = HOT) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept, kept_sha256) of each row; kept is binary, as a cut may part a character, and null without `with_bytes`.

    Null counts as empty; texts shorter than `length` stay. Keys are integers; rows that repeat a key are judged
    each for itself, and repeated rows are copies of each other. Rows with a null key are left out.
    """
    source, found, whole = _spans(df, text, key, length, GRAM, hot)
    spans = cut(found.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("spans")).join(whole.select("key"), "key", "left_anti"))

    def strip(batches):
        for batch in batches:
            data, offs = text_buffers(batch["text"])
            out = []
            for i, found in enumerate(batch["spans"].to_pylist()):
                own = data[offs[i] : offs[i + 1]].tobytes()
                a, b = merged(np.array([x["start"] for x in found]), np.array([x["end"] for x in found]))
                kept = b"".join(own[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(own)]))
                out.append((len(own), len(own) - len(kept), len(a), kept))
            yield pa.RecordBatch.from_arrays([
                batch["key"], *(pa.array([r[k] for r in out], pa.int64()) for k in range(3)), pa.array([r[3] if with_bytes else None for r in out], pa.binary()), pa.array([hashlib.sha256(r[3]).hexdigest() for r in out], pa.string()),
            ], names=["key", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    schema = f"key {KEY}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"
    cut_up = likely(source, "key", spans, "key").join(spans, "key").mapInArrow(strip, schema)
    nothing = F.lit(0).cast("long")
    gone = whole.select("key", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(b"" if with_bytes else None).cast("binary").alias("kept"), F.sha2(F.lit(b""), 256).alias("kept_sha256"))
    binary = F.col("text").cast("binary")
    touched = spans.select("key").unionByName(whole.select("key"))
    intact = source.select("key", F.octet_length("text").cast("long").alias("n_bytes"), nothing.alias("n_removed"), nothing.alias("n_spans"), (binary if with_bytes else F.lit(None).cast("binary")).alias("kept"), F.sha2(binary, 256).alias("kept_sha256")).join(touched, "key", "left_anti")
    return cut_up.unionByName(gone).unionByName(intact).withColumn("key", F.col("key.id"))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), with_bytes=False)
    return removed.select(F.col("key").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
