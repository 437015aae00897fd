"""Kernels on dense blocks against whole arrays, and volumes read and written by the data sources."""

import itertools
import os

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F
from voxmere.operators import dense, raster
from voxmere.sources import volumes

VOXEL = "volume_id string, z int, y int, x int, v double"


@pytest.fixture(scope="module")
def scattered(spark):
    """Two volumes with voxels on both sides of blocks' faces, negative places and values among them."""
    rng = np.random.default_rng(4)
    rows = {(k, *map(int, p)): float(np.round(rng.normal(), 3)) for k in "ab" for p in rng.integers([-3, 10, 12], [6, 24, 40], (500, 3))}
    return rows, spark.createDataFrame([(*k, v) for k, v in rows.items()], VOXEL)


def got(frame) -> dict:
    found = frame.collect()
    out = {(r.volume_id, r.z, r.y, r.x): r.v for r in found}
    assert len(out) == len(found)
    return out


def boxes(rows: dict, radius) -> dict:
    """Every place with the values of the box around it."""
    out = {}
    for (k, *p), v in rows.items():
        for d in itertools.product(*(range(-r, r + 1) for r in radius)):
            out.setdefault((k, *(a + b for a, b in zip(p, d))), []).append((d, v))
    return out


@pytest.mark.parametrize("radius", [(1, 1, 1), (0, 2, 1), (2, 0, 3)])
def test_kernels_against_boxes(scattered, radius):
    rows, frame = scattered
    near = boxes(rows, radius)
    n = int(np.prod([2 * r + 1 for r in radius]))
    assert got(raster.dilate(frame, radius)) == {p: max(v for _, v in s) for p, s in near.items()}
    assert got(raster.erode(frame, radius)) == {p: min(v for _, v in s) for p, s in near.items() if len(s) == n}
    assert got(raster.box_filter(frame, radius)) == pytest.approx({p: sum(v for _, v in near[p]) / n for p in rows})
    assert got(raster.median_filter(frame, radius)) == pytest.approx({p: float(np.median([v for _, v in near[p]])) for p in rows})


def test_erode_of_full_box(spark):
    full = spark.createDataFrame([("a", z, y, x, float(z + y + x)) for z in range(14, 20) for y in range(3) for x in range(30, 35)], VOXEL)
    want = {("a", z, 1, x): float(z - 1 + x - 1) for z in range(15, 19) for x in range(31, 34)}
    assert got(raster.erode(full, (1, 1, 1))) == want
    assert got(raster.opened(full, (1, 1, 1))).keys() == got(full).keys()


def test_gaussian_and_stamp_against_places(scattered):
    rows, frame = scattered
    sigma, radius = (0.3, 0.6, 0.0), (1, 2, 0)
    bell = [{k: np.exp(-k * k / (2 * s * s)) if s else 1.0 for k in range(-r, r + 1)} for s, r in zip(sigma, radius)]
    weight = lambda d: float(np.prod([b[-k] / sum(b.values()) for b, k in zip(bell, d)]))
    want = {p: sum(v * weight(d) for d, v in s) for p, s in boxes(rows, radius).items()}
    assert got(raster.gaussian_filter(frame, sigma)) == pytest.approx(want)
    part = [(0, 0, 0, 1.0), (1, 0, -2, 0.5), (-1, 3, 0, 0.25), (0, 0, 1, -2.0)]
    dims, want = (5, 22, 38), {}
    for (k, z, y, x), _ in rows.items():
        for dz, dy, dx, v in part:
            p = (z + dz, y + dy, x + dx)
            if all(0 <= a < d for a, d in zip(p, dims)):
                want[(k, *p)] = max(v, want.get((k, *p), -9.0))
    assert got(raster.stamp(frame, part, dims)) == want
    assert got(raster.stamped(frame, part, dims, 255.0)) == pytest.approx({p: max(0.0, v) * 255 for p, v in want.items()})


@pytest.mark.parametrize("radius", [(1, 1, 1), (10, 10, 10), (0, 40, 40), (3, 0, 0)])
def test_little_more_than_the_voxels_is_moved(spark, radius):
    n = 60_000
    side = [4 * e for e in dense.edges(radius)]
    place = lambda k, d: F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(d)).cast("int")
    frame = spark.range(n).select(F.lit("a").alias("volume_id"), *(place(k, d).alias(c) for k, (c, d) in enumerate(zip("zyx", side))), F.lit(1.0).alias("v"))
    assert np.prod([e + 2 * r for e, r in zip(dense.edges(radius), radius)]) <= dense.CELLS
    assert dense.dealt(frame, radius, ["volume_id"]).count() < 2 * n


def test_empty_volume(spark):
    none = spark.createDataFrame([], VOXEL)
    for frame in (raster.dilate(none, (1, 1, 1)), raster.box_filter(none, (1, 1, 1)), raster.stamped(none, raster.ball(2), (9, 9, 9))):
        assert frame.count() == 0


# --- files ----------------------------------------------------------------------------------------------------


def places(frame, *names) -> dict:
    rows = frame.select(*names, "z", "y", "x", "v").collect()
    out = {tuple(r)[:-1]: r.v for r in rows}
    assert len(out) == len(rows)
    return out


def full(a: np.ndarray) -> dict:
    return {tuple(map(int, p)): float(a[tuple(p)]) for p in np.argwhere(a != 0)}


def test_npy_in_ranges(spark, tmp_path):
    a = np.random.default_rng(1).integers(0, 5, (9, 6, 7)).astype("u2")
    np.save(tmp_path / "c.npy", a)
    np.save(tmp_path / "f.npy", np.asfortranarray(a.astype("f4")))
    np.save(tmp_path / "plane.npy", a[0])
    (tmp_path / "sub").mkdir()
    np.save(tmp_path / "sub/big_endian.npy", a.astype(">i4"))
    for name in ("c.npy", "f.npy", "sub/big_endian.npy"):
        frame = volumes.read_volume(spark, str(tmp_path / name), part_bytes=200)
        assert frame.rdd.getNumPartitions() >= 4
        assert places(frame) == full(a)
    assert places(volumes.read_volume(spark, str(tmp_path / "plane.npy"))) == full(a[:1])
    every = volumes.read_volume(spark, str(tmp_path), background=1.0)
    assert every.select("path").distinct().count() == 4
    assert every.count() == 3 * int((a != 1).sum()) + int((a[0] != 1).sum())
    (tmp_path / "none").mkdir()
    assert volumes.read_volume(spark, str(tmp_path / "none")).count() == 0
    assert places(volumes.read_volume(spark, f"file://{tmp_path}/c.npy")) == full(a)


def test_npy_over_two_gigabytes(spark, tmp_path):
    """A sparse file on disk: only the planes that are asked for take memory."""
    shape = (6, 20_000, 20_000)
    a = np.lib.format.open_memmap(tmp_path / "large.npy", mode="w+", dtype="u1", shape=shape)
    marks = [(0, 0, 0), (3, 19_999, 4), (5, 19_999, 19_999)]
    for m in marks:
        a[m] = 7
    a.flush()
    assert os.path.getsize(tmp_path / "large.npy") > 2 << 30
    frame = volumes.read_volume(spark, str(tmp_path / "large.npy"))
    assert frame.rdd.getNumPartitions() == 6
    assert places(frame) == dict.fromkeys(marks, 7.0)


def test_round_trip_of_slabs(spark, tmp_path):
    a = np.random.default_rng(2).normal(size=(11, 5, 6)) * (np.random.default_rng(3).random((11, 5, 6)) < 0.2)
    a[4:8] = 0  # a slab without voxels
    a = a.astype("f4")
    rows = [(k, *p, v * (1 + i)) for i, k in enumerate("ab") for p, v in full(a).items()]
    frame = spark.createDataFrame([*rows, ("a", 99, 0, 0, 1.0), ("b", 0, 0, 0, None)], VOXEL)
    for kind, ending in (("npy_volume", "npy"), ("tiff_volume", "tif")):
        path = str(tmp_path / kind)
        for _ in range(2):  # the second time in place of the first
            volumes.write_volume(frame, path, a.shape, depth=4, kind=kind)
        assert sorted(os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names) == [f"{k}/z{z:06d}.{ending}" for k in "ab" for z in (0, 4, 8)]
        back = volumes.combined(volumes.read_volume(spark, f"{path}/a", kind, part_bytes=250), a.shape)
        assert places(back) == full(a)
        turned = volumes.combined(volumes.read_volume(spark, f"{path}/a", kind), a.shape, ("2", "0", "-1"))
        assert places(turned) == full(np.flip(a, 1).transpose(1, 2, 0))
    np.testing.assert_array_equal(np.load(tmp_path / "npy_volume/a/z000008.npy"), a[8:])


def test_tasks_that_run_again_leave_one_file(tmp_path):
    """Two attempts write a slab, one of them counts."""
    options = {"path": str(tmp_path), "dims": "2,3,4", "depth": "2"}
    writer = volumes.NpyVolumes(options).writer(None, False)
    batch = pa.RecordBatch.from_pydict({"volume_id": pa.array([None, None], pa.string()), "z": [0, 1], "y": [1, 2], "x": [0, 3], "v": [5.0, None], "slab": [0, 0]})
    first, again = writer.write(iter([batch])), writer.write(iter([batch]))
    assert first.moves != again.moves
    writer.commit([again, None])
    assert os.listdir(tmp_path) == ["z000000.npy"]
    assert full(np.load(tmp_path / "z000000.npy")) == {(0, 1, 0): 5.0}
    lost = volumes.NpyVolumes(options).writer(None, False)
    lost.write(iter([batch]))
    lost.abort([])
    assert os.listdir(tmp_path) == ["z000000.npy"]


def test_tiff_kinds(spark, tmp_path):
    import struct

    a = np.random.default_rng(5).integers(0, 4, (3, 4, 5))
    # big-endian, a page in two strips, then a BigTIFF
    page = a[0].astype(">u2")
    strips = [page[:3].tobytes(), page[3:].tobytes()]
    tags = [(256, 3, 1, struct.pack(">HH", 5, 0)), (257, 3, 1, struct.pack(">HH", 4, 0)), (258, 3, 1, struct.pack(">HH", 16, 0)), (273, 4, 2, struct.pack(">I", 200)), (279, 4, 2, struct.pack(">I", 208))]
    ifd = struct.pack(">H", len(tags)) + b"".join(struct.pack(">HHI", t, k, n) + v for t, k, n, v in tags) + struct.pack(">I", 0)
    body = struct.pack(">2sHI", b"MM", 42, 8) + ifd
    data = body.ljust(200, b"\0") + struct.pack(">IIII", 216, 216 + len(strips[0]), *map(len, strips)) + b"".join(strips)
    (tmp_path / "mm.tif").write_bytes(data)
    assert places(volumes.read_volume(spark, str(tmp_path / "mm.tif"), "tiff_volume")) == full(a[:1])
    planes = [p.astype("<f8").tobytes() for p in a]
    step, out = 8 + 20 * 6 + 8, [struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16 + sum(map(len, planes)))] + planes
    for k in range(3):
        tags = [(256, 3, 5), (257, 3, 4), (258, 3, 64), (273, 16, 16 + k * len(planes[0])), (279, 16, len(planes[0])), (339, 3, 3)]
        after = 16 + sum(map(len, planes)) + (k + 1) * step
        out.append(struct.pack("<Q", 6) + b"".join(struct.pack("<HHQQ", t, f, 1, v) for t, f, v in tags) + struct.pack("<Q", after if k < 2 else 0))
    (tmp_path / "big.tiff").write_bytes(b"".join(out))
    frame = volumes.read_volume(spark, str(tmp_path / "big.tiff"), "tiff_volume", part_bytes=100)
    assert frame.rdd.getNumPartitions() == 3 and places(frame) == full(a)


def test_writer_holds_one_plane_of_its_slab(tmp_path):
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from voxmere.sources import volumes

    writer = volumes.NpyVolumes({"path": str(tmp_path), "dims": "64,64,256", "depth": "64", "dtype": "float64", "background": "-1"}).writer(None, True)
    rows = pa.RecordBatch.from_pydict({"volume_id": pa.array([None] * 3, pa.string()), "z": [0, 5, 63], "y": [0, 1, 63], "x": [0, 2, 255], "v": [None, 2.0, 3.0], "slab": [0, 0, 0]})
    tracemalloc.start()
    done = writer.write(iter([rows]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    writer.commit([done])
    a = np.load(tmp_path / "z000000.npy")
    assert a.shape == (64, 64, 256) and a[5, 1, 2] == 2 and a[63, 63, 255] == 3 and (a == -1).sum() == a.size - 2
    assert peak < 2 << 20  # the slab is 8 MB
