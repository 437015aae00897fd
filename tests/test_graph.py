"""Connected components: rounds, hubs, odd links, winding objects."""

import numpy as np
import pytest

from voxmere.operators import components, graph


def found(frame) -> dict:
    rows = frame.collect()
    assert len(rows) == len({r.node for r in rows})
    return {r.node: r.component for r in rows}


def test_shuffled_path_in_few_rounds(spark, monkeypatch):
    n, cuts = 100_000, []
    monkeypatch.setattr(graph, "FEW", 0)
    monkeypatch.setattr(graph, "written", lambda df, write=graph.written: cuts.append(1) or write(df))
    ids = np.random.default_rng(1).permutation(n)
    links = spark.createDataFrame([(int(x), int(y)) for x, y in zip(ids, ids[1:])], "a long, b long")
    assert graph.connected_components(links).selectExpr("count(*)", "max(component)").first()[:] == (n, 0)
    assert len(cuts) <= 2 * 20 + 6


@pytest.mark.parametrize("few", [0, 1 << 15])
def test_against_union_find(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW", few)
    rng = np.random.default_rng(7)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 900, (500, 2))] + [(5, 1000 + k) for k in range(700)] + [(3, 3), (2000, 2001), (2001, 2000), (2000, 2001)]
    of = {v: v for p in pairs for v in p if p[0] != p[1]}

    def root(v):
        while of[v] != v:
            v = of[v]
        return v

    for a, b in pairs:
        if a != b:
            x, y = sorted((root(a), root(b)))
            of[y] = x
    links = spark.createDataFrame([*pairs, (None, 4), (8, None)], "a long, b long")
    assert found(graph.connected_components(links)) == {v: root(v) for v in of}
    assert graph.connected_components(links.limit(0)).count() == 0
    assert found(graph.connected_components(spark.createDataFrame([("x", "y"), ("z", "y")], "p string, q string"), "p", "q")) == dict.fromkeys("xyz", "x")


def test_spiral_is_one_object(spark):
    """A curve that winds inwards through a plane: thousands of voxels from end to end."""
    n = 90
    wall, at, step, turns = np.zeros((n, n), bool), (0, 0), (0, 1), 0
    wall[at] = True
    while turns < 2:
        ahead, beyond = tuple(np.add(at, step)), tuple(np.add(at, np.multiply(step, 2)))
        inside = lambda p: 0 <= p[0] < n and 0 <= p[1] < n
        if inside(ahead) and not wall[ahead] and not (inside(beyond) and wall[beyond]):
            at, turns = ahead, 0
            wall[at] = True
        else:
            step, turns = (step[1], -step[0]), turns + 1
    y, x = np.nonzero(wall)
    assert len(y) > 3000
    voxels = spark.createDataFrame([("a", 0, int(i), int(j), 1.0) for i, j in zip(y, x)], "volume_id string, z int, y int, x int, v double")
    assert components.label(voxels, n, n, 6).select("label").distinct().count() == 1
