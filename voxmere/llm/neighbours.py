"""Nearest neighbours by inner product: a hierarchical k-means tree, searched best bin first.

1. The tree is fitted on a bounded sample of rows (SAMPLE_CELLS components, 65 536 rows of 64): a node with more
   sample rows than a leaf may hold is split by k-means into BRANCH children.
2. Every row goes down the tree to one leaf. Equal vectors are one entry with its k + 1 smallest ids, since of equal
   scores the smaller ids win; so a vector that a third of the rows share is no large group.
3. A query takes nodes from a priority queue, the most promising first, and visits leaves in that order.
4. How many leaves: the true neighbours of CALIBRATE queries are found among all rows in one pass, and the visits are
   widened until these queries' recall reaches the wanted one. If that takes all leaves, the search is exhaustive.
5. Neighbouring leaves are bundled up to BLOCK entries; a fuller leaf is dealt into blocks of about that size, and the
   queries that visit a bundle into parts of about VISITS. Each block meets each part in one task, which scores a query
   with the rows of the leaves it visits, in double precision and in one fixed order of the components.
"""

from __future__ import annotations

import heapq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from voxmere.llm.common import in_batches, table, written

SAMPLE_CELLS = 1 << 22
BRANCH, ITERATIONS = 8, 8
#: A leaf is meant to hold about so many rows, and at least so many of the sample.
LEAF, LEAST_OF_SAMPLE = 128, 8
CALIBRATE = 256
BLOCK, VISITS = 2048, 8192
FOUND = "query_id long, rank int, vec_id long, score double"


class Tree(NamedTuple):
    """Nodes by number, the root is 0. The children of a node are neighbours; leaf is -1 for inner nodes."""

    centre: np.ndarray
    reach: np.ndarray
    first: np.ndarray
    children: np.ndarray
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int((self.children == 0).sum())


def split(x: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
    """Rows of x by k-means cluster; clusters without rows are left out."""
    centres = x[rng.choice(len(x), min(BRANCH, len(x)), replace=False)]
    for _ in range(ITERATIONS):
        nearest = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
        there = np.unique(nearest)
        centres = np.stack([x[nearest == c].mean(0) for c in there])
    nearest = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
    return [np.flatnonzero(nearest == c) for c in np.unique(nearest)]


def grow(x: np.ndarray, most: int) -> Tree:
    """The tree over the rows of x, whose leaves hold at most `most` of them unless k-means cannot part them."""
    rng = np.random.default_rng(11)
    queue, first, children = [np.arange(len(x))], [-1], [0]
    for node, rows in enumerate(queue):  # grows while it is walked
        parts = split(x[rows], rng) if len(rows) > most else []
        if len(parts) > 1:
            first[node], children[node] = len(queue), len(parts)
            queue += [rows[p] for p in parts]
            first += [-1] * len(parts)
            children += [0] * len(parts)
    centre = np.stack([x[rows].mean(0) for rows in queue])
    # what the best of a node's rows gains over its centre: about two deviations along the query
    reach = np.array([2 * np.sqrt(((x[rows] - c) ** 2).mean()) for rows, c in zip(queue, centre)])
    leaf = np.where(np.array(children) == 0, np.cumsum(np.array(children) == 0) - 1, -1)
    return Tree(centre, reach, np.array(first), np.array(children), leaf)


def place(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf of each row of x: from the root always to the nearest child."""
    at = np.zeros(len(x), np.int64)
    while len(inner := np.flatnonzero(tree.children[at] > 0)):
        order = inner[np.argsort(at[inner], kind="stable")]
        for rows in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
            begin = tree.first[at[rows[0]]]
            centres = tree.centre[begin : begin + tree.children[at[rows[0]]]]
            at[rows] = begin + ((centres**2).sum(1) - 2 * x[rows] @ centres.T).argmin(1)
    return tree.leaf[at]


def best_first(tree: Tree, q: np.ndarray, visits: int) -> np.ndarray:
    """Each query's first `visits` leaves in the order in which the priority queue gives them."""
    out = np.empty((len(q), visits), np.int32)
    for begin in range(0, len(q), 256):
        part = q[begin : begin + 256]
        cost = -(part @ tree.centre.T + np.sqrt((part**2).sum(1))[:, None] * tree.reach)
        for i, c in enumerate(cost.tolist()):
            heap, taken = [(c[0], 0)], 0
            while taken < visits:
                node = heapq.heappop(heap)[1]
                if tree.children[node]:
                    for kid in range(tree.first[node], tree.first[node] + tree.children[node]):
                        heapq.heappush(heap, (c[kid], kid))
                else:
                    out[begin + i, taken] = tree.leaf[node]
                    taken += 1
    return out


def matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """A column of equally long lists as rows in double precision."""
    lists = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) and column.num_chunks else column
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims) if len(column) else np.zeros((0, dims))


def scores(x: np.ndarray, q: np.ndarray, xi: np.ndarray, qi: np.ndarray) -> np.ndarray:
    """Inner products of pairs, summed in one fixed order: equal pairs have equal scores wherever they are computed."""
    return np.concatenate([(x[xi[i : i + 65536]] * q[qi[i : i + 65536]]).sum(1) for i in range(0, len(xi), 65536)] or [np.zeros(0)])


def at_the_top(x: np.ndarray, q: np.ndarray, most: int, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of all rows that are among a query's `most` best or as good as the last of them; of those `allowed` (query x row), where given."""
    rough = q @ x.T
    if allowed is not None:
        rough[~allowed] = -np.inf
    last = np.partition(rough, -most, axis=1)[:, -most] if most < len(x) else np.full(len(q), -np.inf)
    slack = 1e-12 * np.sqrt((q**2).sum(1) * (x**2).sum(1).max(initial=0))
    qi, xi = np.nonzero((rough >= (last - slack)[:, None]) & (rough > -np.inf))
    return qi, xi, scores(x, q, xi, qi)


def bundles(held: list[int]) -> np.ndarray:
    """A bundle for each leaf: neighbouring leaves share one as long as they hold at most BLOCK entries together; a fuller leaf has its own."""
    out, number, inside = np.zeros(len(held), np.int64), 0, 0
    for leaf, n in enumerate(held):
        if inside and inside + n > BLOCK:
            number, inside = number + 1, 0
        out[leaf] = number
        inside += n
    return out


def usable(vector: str) -> Column:
    """True for vectors that take part: not null, not all zero, and with finite components only."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def nearest(df: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20, recall: float = 0.95) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows found for each query, by largest inner product, ties to the smaller id.

    Every row for which `is_query` holds is a query; candidates are all rows with another id. Rows whose id is null
    take no part, nor do vectors that are null, all zero, or hold null or non-finite components, nor those of another
    length than most have (the shorter of equally frequent ones). Rows that repeat an id and its vector count once;
    those that repeat an id with another vector are rows of their own. Queries without candidates have no rows.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks")).where(F.col("id").isNotNull() & usable("vec"))
    common = rows.groupBy(F.size("vec").alias("dims")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dims").first()
    if common is None:
        return spark.createDataFrame([], FOUND)
    dims, total = common["dims"], common["n"]
    # 128 bits tell vectors apart
    rows = rows.where(F.size("vec") == dims).withColumns({"h1": F.xxhash64(F.lit(1), "vec"), "h2": F.xxhash64(F.lit(2), "vec")})
    tree = spark.sparkContext.broadcast(fitted(rows, dims, total))
    kind = rows.schema["vec"].dataType.simpleString()

    order = Window.partitionBy("h1", "h2").orderBy("id")
    entries = rows.withColumn("r", F.dense_rank().over(order)).where(F.col("r") <= k + 1).groupBy("h1", "h2").agg(F.first("vec").alias("vec"), F.array_sort(F.collect_set("id")).alias("ids"))

    def descend(batches):
        for b in batches:
            yield b.append_column("leaf", pa.array(place(tree.value, matrix(b["vec"], dims)).astype(np.int32)))

    placed = written(in_batches(entries).mapInArrow(descend, f"h1 long, h2 long, vec {kind}, ids array<long>, leaf int"))
    asked = rows.where("asks").groupBy("h1", "h2").agg(F.first("vec").alias("vec"))
    visits = calibrated(asked, placed, tree.value, dims, k, recall)

    # a row for each leaf: as many as the tree has, which the sample bounds
    held = {r["leaf"]: r["n"] for r in placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}
    bundle = bundles([held.get(leaf, 0) for leaf in range(tree.value.leaves)])
    blocks = np.zeros(bundle.max() + 1, np.int64)
    for leaf, n in held.items():
        blocks[bundle[leaf]] = max(blocks[bundle[leaf]], -(-n // BLOCK))

    def search(batches):
        for b in batches:
            leaves = best_first(tree.value, matrix(b["vec"], dims), visits)
            of = bundle[leaves]
            order = np.argsort(of, axis=1, kind="stable")
            of, leaves = np.take_along_axis(of, order, 1).ravel(), np.take_along_axis(leaves, order, 1).ravel()
            query = np.repeat(np.arange(len(b)), visits)
            begin = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (query[1:] != query[:-1])]))
            inside = pa.ListArray.from_arrays(pa.array(np.append(begin, len(of)).astype(np.int32)), pa.array(leaves))
            each = pa.StructArray.from_arrays([pa.array(of[begin].astype(np.int32)), inside], names=["bundle", "leaves"])
            ends = np.searchsorted(query[begin], np.arange(len(b) + 1))
            yield b.append_column("to", pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), each))

    searched = written(in_batches(asked).mapInArrow(search, f"h1 long, h2 long, vec {kind}, to array<struct<bundle: int, leaves: array<int>>>"))
    visited = searched.select("h1", "h2", "vec", F.explode("to").alias("to")).select("h1", "h2", "vec", "to.*")
    parts = {r["bundle"]: -(-r["n"] // VISITS) for r in visited.groupBy("bundle").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = F.broadcast(spark.createDataFrame([(leaf, int(bundle[leaf]), int(blocks[bundle[leaf]]), parts[bundle[leaf]]) for leaf in held if bundle[leaf] in parts], "leaf int, bundle int, blocks long, parts long"))
    by = ["bundle", "block", "part"]
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = placed.join(sizes, "leaf").select("bundle", F.pmod("h2", "blocks").alias("block"), upto("parts").alias("part"), "leaf", "vec", "ids")
    right = visited.join(sizes.drop("leaf").distinct(), "bundle").select("bundle", upto("blocks").alias("block"), F.pmod("h2", "parts").alias("part"), "h1", "h2", "vec", "leaves")

    def meet(entry: pa.Table, ask: pa.Table) -> pa.Table:
        x, q = matrix(entry["vec"], dims), matrix(ask["vec"], dims)
        ids = entry["ids"].to_pylist()
        count, flat = np.array([len(i) for i in ids], np.int64), np.array([i for a in ids for i in a], np.int64)
        start = np.cumsum(count) - count
        here, leaf = np.unique(entry["leaf"].to_numpy(), return_inverse=True)
        to = ask["leaves"].to_pylist()
        best, ends = [], [np.zeros(1, np.int64)]
        for begin in range(0, len(q) if len(x) else 0, 128):
            part = q[begin : begin + 128]
            open_to = np.stack([np.isin(here, t, assume_unique=True) for t in to[begin : begin + 128]])
            qi, xi, s = at_the_top(x, part, k + 1, open_to[:, leaf])
            more = count[xi]
            at = np.repeat(start[xi] - np.cumsum(more) + more, more) + np.arange(more.sum())
            qi, s, i = np.repeat(qi, more), np.repeat(s, more), flat[at]
            o = np.lexsort((i, -s, qi))
            qi, s, i = qi[o], s[o], i[o]
            kept = np.arange(len(qi)) - np.searchsorted(qi, qi) <= k
            best.append((-s[kept], i[kept]))
            ends.append(np.bincount(qi[kept], minlength=len(part)))
        n = sum(map(len, ends)) - 1
        structs = pa.StructArray.from_arrays([pa.array(np.concatenate([b[j] for b in best] or [np.zeros(0, t)])) for j, t in ((0, np.float64), (1, np.int64))], names=["minus", "id"])
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(ends)).astype(np.int32)), structs)
        return pa.table({"h1": ask["h1"].slice(0, n), "h2": ask["h2"].slice(0, n), "best": lists})

    met = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(meet, "h1 long, h2 long, best array<struct<minus: double, id: long>>")
    merged = met.groupBy("h1", "h2").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k + 1).alias("best"))  # one list for each block that was visited
    asking = rows.where("asks").select("h1", "h2", F.col("id").alias("query_id")).distinct()
    others = F.slice(F.filter("best", lambda e: e["id"] != F.col("query_id")), 1, k)
    listed = asking.join(merged, ["h1", "h2"]).select("query_id", F.posexplode(others).alias("pos", "e"))
    return listed.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("e.id").alias("vec_id"), (-F.col("e.minus")).alias("score"))


def fitted(rows: DataFrame, dims: int, total: int) -> Tree:
    """The tree over a sample of about SAMPLE_CELLS components (all rows where there are no more), chosen by a hash of the id."""
    most = max(1, SAMPLE_CELLS // dims)
    chosen = rows if total <= most else rows.where(F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 30)) < int(most / total * (1 << 30)))
    x = matrix(in_batches(chosen.select("vec")).toArrow()["vec"], dims)
    x = np.unique(x, axis=0)
    return grow(x, max(LEAST_OF_SAMPLE, round(LEAF * min(1.0, most / total)))) if len(x) else grow(np.zeros((1, dims)), 1)


def calibrated(asked: DataFrame, placed: DataFrame, tree: Tree, dims: int, k: int, recall: float) -> int:
    """The fewest visits that find the wanted share of the true neighbours of about CALIBRATE queries, which one pass over all rows finds."""
    total = asked.count()
    share = int(min(1.0, CALIBRATE / max(1, total)) * (1 << 20))
    some = asked.where(F.pmod("h1", F.lit(1 << 20)) < share).toArrow()
    if not len(some):
        return tree.leaves
    q, own = matrix(some["vec"], dims), np.array(some["h1"].to_numpy())
    shared = placed.sparkSession.sparkContext.broadcast((q, own))

    def compare(batches):
        q, own = shared.value
        for b in batches:
            x, leaf, h1 = matrix(b["vec"], dims), b["leaf"].to_numpy(), b["h1"].to_numpy()
            for begin in range(0, len(x), 2048):
                qi, xi, s = at_the_top(x[begin : begin + 2048], q, k + 1)
                other = h1[begin + xi] != own[qi]
                yield pa.RecordBatch.from_arrays([pa.array(qi[other].astype(np.int32)), pa.array(s[other]), pa.array(leaf[begin + xi[other]])], names=["q", "s", "leaf"])

    every = in_batches(placed.select("vec", "leaf", "h1")).mapInArrow(compare, "q int, s double, leaf int")
    top = every.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "leaf"))).where(F.col("r") <= k).select("q", "leaf").toArrow()
    order = np.empty((len(q), tree.leaves), np.int32)  # when each leaf is visited
    np.put_along_axis(order, best_first(tree, q, tree.leaves), np.arange(tree.leaves, dtype=np.int32)[None, :], axis=1)
    when = order[top["q"].to_numpy(), top["leaf"].to_numpy()]
    visits = 1
    while visits < tree.leaves and len(when) and (when < visits).mean() < recall:
        visits += 1
    return visits


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
