"""Matching of predictions with ground truth: distance join, greedy one-to-one assignment, scores."""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxmere.operators.graph import cut, written


def distance_join(truth: DataFrame, pred: DataFrame, cutoff: float, *by: str) -> DataFrame:
    """(by, truth_idx, pred_idx, dist) of all pairs at most `cutoff` apart; inputs are (by, idx, z, y, x).

    Space is cut into cubes of twice the cutoff; truth goes to those that its reach touches, two on an axis, so pairs
    meet by equality of the cube and only near ones are measured. Both sides are shuffled: Spark's estimate of the
    truth does not count its copies, and it would be broadcast whole.
    """
    side = 2.0 * cutoff
    t = truth.select(*by, F.col("idx").alias("truth_idx"), *(F.col(c).alias(f"t{c}") for c in "zyx"))
    for c in "zyx":
        reach = cutoff * (1 + 1e-9) + F.abs(F.col(f"t{c}")) * 1e-14  # a little more than the cutoff, as the distance is rounded
        t = t.withColumn(f"g{c}", F.explode(F.sequence(F.floor((F.col(f"t{c}") - reach) / side), F.floor((F.col(f"t{c}") + reach) / side))))
    p = pred.select(*by, F.col("idx").alias("pred_idx"), *(F.col(c).alias(f"p{c}") for c in "zyx"), *(F.floor(F.col(c) / side).alias(f"g{c}") for c in "zyx"))
    square = sum(((F.col(f"t{c}") - F.col(f"p{c}")) * (F.col(f"t{c}") - F.col(f"p{c}")) for c in "zyx"), F.lit(0.0))
    return t.join(p.hint("merge"), [*by, "gz", "gy", "gx"]).withColumn("dist", F.sqrt(square)).where(F.col("dist") <= cutoff).select(*by, "truth_idx", "pred_idx", "dist")


def greedy(pairs: DataFrame, *by: str, most_rounds: int = 10_000) -> DataFrame:
    """Pairs taken in order of (dist, truth_idx, pred_idx), each truth and prediction once.

    Each round takes the pairs that are the best of both their members; these are exactly pairs that the
    sequential order takes, and what touches them is out. Every round settles at least one pair of each group.
    """
    left, taken = cut(pairs.select(*by, "truth_idx", "pred_idx", "dist")), []
    order = [F.col("dist"), F.col("truth_idx"), F.col("pred_idx")]
    for _ in range(most_rounds):
        if left.isEmpty():
            break
        best_t = Window.partitionBy(*by, "truth_idx").orderBy(*order)
        best_p = Window.partitionBy(*by, "pred_idx").orderBy(*order)
        ranked = left.withColumn("rt", F.row_number().over(best_t)).withColumn("rp", F.row_number().over(best_p))
        both = cut(ranked.where("rt = 1 and rp = 1").drop("rt", "rp"))
        taken.append(both)
        if len(taken) == 32:  # pairs are written again once in 31 rounds
            taken = [cut(reduce(DataFrame.unionByName, taken))]
        left = cut(left.join(both.select(*by, "truth_idx"), [*by, "truth_idx"], "left_anti").join(both.select(*by, "pred_idx"), [*by, "pred_idx"], "left_anti"))
    else:
        raise RuntimeError(f"pairs are left after {most_rounds} rounds")
    return reduce(DataFrame.unionByName, taken) if taken else pairs.select(*by, "truth_idx", "pred_idx", "dist").limit(0)


#: So many rows and fewer of truths that are near each other are settled at once within a task.
NEAR = 1 << 20


def _sides(truth: DataFrame, pred: DataFrame, *by: str) -> DataFrame:
    """(by, t, p, z, y, x) of the places where pairs can be: rows of truths have no p, those of predictions no t."""
    some = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*by, "idx")] + [F.abs(F.col(c).cast("double")) < float("inf") for c in "zyx"])
    none = lambda of, c: F.lit(None).cast(of.schema["idx"].dataType).alias(c)
    places = [F.col(c).cast("double").alias(c) for c in "zyx"]
    t = truth.where(some).select(*by, F.col("idx").alias("t"), none(pred, "p"), *places)
    return t.unionByName(pred.where(some).select(*by, none(truth, "t"), F.col("idx").alias("p"), *places))


def _in_place(rows: DataFrame, *by: str) -> tuple[DataFrame, DataFrame]:
    """The pairs (by, truth_idx, pred_idx, dist) of `greedy` that have no distance, and the rows of `_sides` that these leave, with the smallest idx of their place and side (`of`).

    They come before all others, and those of a place do not touch another place's: its first truth gets its first
    prediction, and so on. Left as they are, without `of`: places with a point of several rows, and those so near to
    an axis that the square of a distance may vanish.
    """
    keys = [f"k{c}" for c in "zyx"]
    tiny = reduce(lambda a, b: a | b, [(F.abs(F.col(c)) < 1e-140) & (F.col(c) != 0) for c in "zyx"])
    rows = rows.withColumn("odd", tiny | (F.count(F.lit(1)).over(Window.partitionBy(*by, "t", "p")) > 1))
    rows = rows.withColumns({k: F.when(F.abs(F.col(c)) < 1e-140, 0.0).otherwise(F.col(c)) for k, c in zip(keys, "zyx")}).repartition(*by, *keys)
    rows = rows.withColumn("side", F.col("t").isNull()).withColumn("rank", F.row_number().over(Window.partitionBy(*by, *keys, "side").orderBy("t", "p")))
    place = Window.partitionBy(*by, *keys)
    rows = rows.withColumns({"mate": F.lead("p").over(place.orderBy("rank", "side")), "plain": ~F.max("odd").over(place), "both": F.least(F.count("t").over(place), F.count("p").over(place))})
    own = lambda c: F.min(F.when(F.col("rank") > F.col("both"), F.col(c))).over(place)
    rows = rows.withColumns({"paired": F.col("plain") & (F.col("rank") <= F.col("both")), "ot": own("t"), "op": own("p")})
    kept = [F.when(F.col("plain"), F.col(c)).alias(c) for c in ("ot", "op")]
    state = written(rows.where("not (paired and side)").select(*by, "t", "p", *"zyx", "plain", *kept, F.when(F.col("paired"), F.col("mate")).alias("mate"), "paired"))
    pairs = state.where("paired").select(*by, F.col("t").alias("truth_idx"), F.col("mate").alias("pred_idx"), F.lit(0.0).alias("dist"))
    return pairs, state.where("not paired").drop("mate", "paired")


def _kinds(rows: DataFrame, *by: str) -> list[DataFrame]:
    """Of truths, then of predictions: the points (by, idx, of, cz, cy, cx) and the places (by, idx, z, y, x) of those that stand for all of the same place: `of` is their smallest idx."""
    points = rows.where("not plain").groupBy(*by, "t", "p").agg(F.sort_array(F.collect_set(F.struct("z", "y", "x"))).alias("places"))
    same = Window.partitionBy(*by, F.col("t").isNull(), "places")
    points = written(points.withColumns({"ot": F.min("t").over(same), "op": F.min("p").over(same)}))
    out = []
    for c, of in (("t", "ot"), ("p", "op")):
        plain = rows.where("plain").where(F.col(c).isNotNull()).select(*by, F.col(c).alias("idx"), F.col(of).alias("of"), *"zyx")
        side = points.where(F.col(c).isNotNull()).select(*by, F.col(c).alias("idx"), F.col(of).alias("of"), "places")
        at = [*by, "idx", "of", *(F.col(x).alias(f"c{x}") for x in "zyx")]
        out.append(plain.select(*at).unionByName(side.withColumns({x: F.col("places")[0][x] for x in "zyx"}).select(*at)))
        out.append(plain.where("idx = of").drop("of").unionByName(side.where("idx = of").select(*by, "idx", F.inline("places"))))
    return out


def _settled(d: list, t: list, p: list, starts: list[int], owns: list[int], rivals: dict):
    """(row, truth) of the pairs taken in order among kinds: from its start a kind has rows of so many truths in order, then of the predictions in reach by (d, p).

    A prediction that is held from elsewhere (rivals) is taken only by a truth that comes before its holder (d, t).
    """
    ends, at = starts[1:] + [len(d)], [start + own for start, own in zip(starts, owns)]
    used, taken = [0] * len(starts), set()
    turns = [(d[at[k]], t[starts[k]], k) for k in range(len(starts)) if owns[k] and at[k] < ends[k]]
    heapq.heapify(turns)
    while turns:
        dist, truth, k = heapq.heappop(turns)
        i, end = at[k], ends[k]
        while i < end and d[i] == dist and (p[i] in taken or (i in rivals and rivals[i] <= (dist, truth))):
            i += 1
        if i < end and d[i] == dist:
            taken.add(p[i])
            yield i, truth
            used[k], i = used[k] + 1, i + 1
        at[k] = i
        if i < end and used[k] < owns[k]:
            heapq.heappush(turns, (d[i], t[starts[k] + used[k]], k))


def _changes(batch: pa.RecordBatch, names: list[str], before: tuple | None) -> np.ndarray:
    """Whether a row differs in these columns from the one before it; `before` is that of the first."""
    out = np.zeros(len(batch), dtype=bool)
    for c in names:
        v = batch[c].to_numpy(zero_copy_only=False)
        out[1:] |= v[1:] != v[:-1]
    out[0] = before != tuple(batch[c][0].as_py() for c in names)
    return out


def _asked(rows: DataFrame, blocks: list[str], *by: str) -> DataFrame:
    """What the kinds of truths ask for: (by, of, cz, cy, cx, dist, t, p).

    Rows of a kind are its truths (dist is null) and the predictions in reach with their holders (other, hd, ht).
    Kinds of a block settle among themselves; of a block with more than NEAR rows, those that are read together do.
    """
    names = [*by, "of", "cz", "cy", "cx", "dist", "t", "p"]
    wide = {f.name: f.dataType.simpleString() for f in rows.schema}

    def out(parts, starts):
        whole = pa.Table.from_batches(parts)
        d, t, p = (whole[c].to_pylist() for c in ("dist", "t", "p"))
        truths = np.concatenate([[0], np.cumsum(whole["dist"].is_null().to_numpy())])
        owns = np.diff(truths[[*starts, len(whole)]]).tolist()
        rivals = {}
        if whole["other"].null_count < len(whole):
            of, other, hd, ht = (whole[c].to_pylist() for c in ("of", "other", "hd", "ht"))
            here = {of[start] for start in starts}  # kinds that settle here do not hold anything against each other
            rivals = {i: (hd[i], ht[i]) for i, o in enumerate(other) if o is not None and o not in here}
        pairs = list(_settled(d, t, p, starts, owns, rivals))
        at, whole = pa.array([i for i, _ in pairs], pa.int64()), whole.select(names)
        some = whole.take(at).set_column(names.index("t"), whole.schema.field("t"), pa.array([t for _, t in pairs], whole.schema.field("t").type))
        return some.to_batches()

    def ask(batches):
        parts, starts, n, last = [], [], 0, (None, None)
        for batch in batches:
            if not len(batch):
                continue
            new = _changes(batch, [*by, *blocks], last[0])
            kinds, done = new | _changes(batch, ["of"], last[1]), 0
            for i in np.flatnonzero(kinds).tolist():
                if starts and (new[i] or n + i - done >= NEAR):
                    yield from out([*parts, batch.slice(done, i - done)], starts)
                    parts, starts, n, done = [], [], 0, i
                starts.append(n + i - done)
            parts.append(batch.slice(done))
            n += len(batch) - done
            last = tuple(tuple(batch[c][len(batch) - 1].as_py() for c in some) for some in ([*by, *blocks], ["of"]))
        if parts:
            yield from out(parts, starts)

    dealt = rows.repartition(*by, *blocks).sortWithinPartitions(*by, *blocks, "of", "dist", "t", "p")
    return dealt.mapInArrow(ask, ", ".join(f"`{c}` {wide[c]}" for c in names))


def _dealt(links: DataFrame, truths: DataFrame, preds: DataFrame, side: float, *by: str) -> DataFrame:
    """The pairs of `greedy` from links (by, truth_idx, pred_idx, dist) of kinds and both sides' points (by, idx, of, cz, cy, cx)."""
    kind, keys, places, blocks = [*by, "of"], [*by, "p"], ["cz", "cy", "cx"], ["gz", "gy", "gx"]
    in_blocks = lambda df, n: df.withColumns({g: F.floor(F.col(c) / side + n % 4 / 4) for g, c in zip(blocks, places)})
    stand = truths.where("idx = of").drop("idx")
    reach = links.select(*by, F.col("truth_idx").alias("of"), F.col("pred_idx").alias("pk"), "dist").join(stand.hint("merge"), kind)
    reach = written(reach.join(preds.select(*by, F.col("of").alias("pk"), F.col("idx").alias("p")).hint("merge"), [*by, "pk"]).drop("pk"))
    t_kind, p_kind = truths.schema["idx"].dataType, preds.schema["idx"].dataType
    none = lambda of, c: F.lit(None).cast(of).alias(c)
    own = truths.select(*kind, *places, none("double", "dist"), F.col("idx").alias("t"), none(p_kind, "p"), none(t_kind, "other"), none("double", "hd"), none(t_kind, "ht"))
    own = written(own.join(reach.select(*kind).distinct().hint("merge"), kind, "left_semi"))
    held, turned, n = None, None, 0
    while turned is None or not turned.isEmpty():
        lists, some, rest = in_blocks(reach, n), in_blocks(own, n), None
        if held is None:
            lists = lists.withColumns({"other": none(t_kind, "other"), "hd": none("double", "hd"), "ht": none(t_kind, "ht")})
        else:
            again = in_blocks(turned, n).select(*by, *blocks).distinct().hint("merge")
            lists, some = (df.join(again, [*by, *blocks], "left_semi") for df in (lists, some))
            rest = in_blocks(held, n).join(again, [*by, *blocks], "left_anti").drop(*blocks)
            holders = held.select(*keys, F.col("of").alias("other"), F.col("dist").alias("hd"), F.col("t").alias("ht"))
            lists = lists.join(holders.hint("merge"), keys, "left")
        asked = _asked(some.unionByName(lists.withColumn("t", none(t_kind, "t"))), blocks, *by)
        asked = asked if rest is None else asked.unionByName(rest)
        first = Window.partitionBy(*keys).orderBy("dist", "t")
        state = written(asked.withColumn("k", F.row_number().over(first)))
        held, turned, n = state.where("k = 1").drop("k"), state.where("k > 1").select(*kind, *places).distinct(), n + 1
    return held.select(*by, F.col("t").alias("truth_idx"), F.col("p").alias("pred_idx"), "dist")


def _links(t: DataFrame, p: DataFrame, cutoff: float, *by: str) -> DataFrame:
    return distance_join(t, p, cutoff, *by).groupBy(*by, "truth_idx", "pred_idx").agg(F.min("dist").alias("dist"))


def _side(truths: DataFrame, preds: DataFrame, least: float, *by: str) -> float:
    """The largest of `least` doubled some times whose blocks hold few enough points to settle at once."""
    if not least > 0:
        return least
    grid = [F.floor(F.col(c) / least).alias(c) for c in ("cz", "cy", "cx")]
    cells = truths.select(*by, *grid).unionByName(preds.select(*by, *grid)).groupBy(*by, "cz", "cy", "cx").agg(F.count(F.lit(1)).alias("n"))
    wider = cells.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(12)))).withColumns({c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("k"))) for c in ("cz", "cy", "cx")})
    most = wider.groupBy(*by, "k", "cz", "cy", "cx").agg(F.sum("n").alias("n")).groupBy("k").agg(F.max("n").alias("n"))
    return least * 2 ** (most.where(F.col("n") <= NEAR // 4).agg(F.max("k")).first()[0] or 0)


def matched(truth: DataFrame, pred: DataFrame, cutoff: float, *by: str) -> DataFrame:
    """J6 and J7 in one: what `greedy` takes of the pairs of `distance_join`, without forming these.

    Pairs without a distance are taken first, place by place. Points of one place are of a kind, and of what is left
    only kinds are joined. Pairs have one order for both sides, so taking them in that order is the one stable
    matching, and truths may ask in any order. In a round the truths of a block of space settle among themselves and
    ask for predictions without a holder or with one that comes later; a prediction keeps the first in order, and
    blocks of which a truth was turned away settle again, in a grid that is moved with each round, until none is
    turned away.
    """
    pairs, rows = _in_place(_sides(truth, pred, *by), *by)
    truths, t, preds, p = _kinds(rows, *by)
    side = _side(truths, preds, 16 * cutoff, *by)
    rest = _dealt(_links(t, p, cutoff, *by), truths, preds, side, *by)
    return pairs.where(F.lit(cutoff >= 0)).unionByName(rest)


def match_stats(truth: DataFrame, pred: DataFrame, matched: DataFrame, *by: str) -> DataFrame:
    """Tp, fp, fn, precision, recall and F1 of each group; ratios of nothing are null."""
    n_t = truth.groupBy(*by).agg(F.count(F.lit(1)).alias("n_truth"))
    n_p = pred.groupBy(*by).agg(F.count(F.lit(1)).alias("n_pred"))
    tp = matched.groupBy(*by).agg(F.count(F.lit(1)).alias("tp"))
    if by:
        rows = n_t.join(n_p, list(by), "full").join(tp, list(by), "left")
    else:
        rows = n_t.crossJoin(n_p).crossJoin(tp)
    rows = rows.fillna(0, ["n_truth", "n_pred", "tp"]).withColumns({"fp": F.col("n_pred") - F.col("tp"), "fn": F.col("n_truth") - F.col("tp")})
    ratio = lambda a, b: a / F.nullif(b, F.lit(0))
    rows = rows.withColumns({"precision": ratio(F.col("tp"), F.col("n_pred")), "recall": ratio(F.col("tp"), F.col("n_truth"))})
    return rows.withColumn("f1", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))).drop("n_truth", "n_pred")


def sweep(truth: DataFrame, pred: DataFrame, cutoffs: list[float], *by: str) -> DataFrame:
    """match_stats for several cutoffs. Pairs are taken from the nearest on, so those of a cutoff are the ones within it of the largest cutoff's."""
    each = lambda df: df.withColumn("cutoff", F.explode(F.array(*map(F.lit, map(float, cutoffs)))))
    taken = each(matched(truth, pred, max(cutoffs), *by)).where("dist <= cutoff")
    return match_stats(each(truth), each(pred), taken, *by, "cutoff")


def unpaired(side: DataFrame, matched: DataFrame, idx: str, *by: str) -> DataFrame:
    """The rows of a side (its column idx) that no pair holds.

    Pairs are read from files that look small enough to be broadcast, though they grow with the points.
    """
    return side.join(matched.select(*by, F.col(idx).alias("idx")).hint("merge"), [*by, "idx"], "left_anti")


def nearest_pairs(truth: DataFrame, pred: DataFrame, first: float, *by: str) -> DataFrame:
    """Greedy pairs without a cutoff.

    The search distance doubles until the smaller side of each group is used up, so no cross product of the sides
    is formed unless the points themselves are that far apart; matches of a shorter distance come first anyway.
    """
    reach, found, t, p = first, None, truth, pred
    while True:
        got = matched(t, p, reach, *by)
        found = got if found is None else cut(found.unionByName(got))
        t, p = cut(unpaired(t, got, "truth_idx", *by)), cut(unpaired(p, got, "pred_idx", *by))
        open_groups = t.select(*by).distinct().join(p.select(*by).distinct(), list(by), "left_semi") if by else t.limit(1).crossJoin(p.limit(1))
        if open_groups.isEmpty():
            return found
        reach *= 2


def curve_area(stats: DataFrame, order: str, *by: str) -> DataFrame:
    """Trapezoid area of precision over 1 - recall, in the given order."""
    w = Window.partitionBy(*by).orderBy(order)
    x, y = 1 - F.col("recall"), F.col("precision")
    steps = stats.withColumn("step", (x - F.lag(x).over(w)) * (y + F.lag(y).over(w)) / 2)
    return steps.groupBy(*by).agg(F.sum("step").alias("area"))
