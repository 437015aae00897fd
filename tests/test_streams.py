"""Streams: objects followed through planes, patches merged by batch, results that outlive a run, late rows."""

import datetime
import random

import pytest

from voxmere.streaming import monitors

CELL = "volume_id string, z int, y double, x double, time timestamp"


def at(minute: float) -> datetime.datetime:
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)


@pytest.fixture
def stream(spark, tmp_path):
    """A function that puts rows into the next file and one that opens the files as a stream, a file for each batch."""
    count = iter(range(100))

    def put(rows, schema):
        import os

        n = next(count)
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"part{n}"))
        (tmp_path / "in").mkdir(exist_ok=True)
        name = next(f for f in os.listdir(tmp_path / f"part{n}") if f.endswith(".parquet"))
        os.rename(tmp_path / f"part{n}" / name, tmp_path / "in" / f"{n:03d}.parquet")
        os.utime(tmp_path / "in" / f"{n:03d}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))

    return put, lambda schema: monitors.files_as_stream(spark, str(tmp_path / "in"), schema, 1), str(tmp_path / "out")


def objects(frame) -> list[tuple]:
    return sorted((r.volume_id, r.object_id, r.z_first, r.z_last, r.n_planes) for r in frame.collect())


def test_objects_close_by_planes_ends_and_timers(stream):
    put, opened, out = stream
    put([("v", 0, 5.0, 5.0, at(0)), ("v", 1, 6.0, 5.0, at(0)), ("w", 4, 1.0, 1.0, at(0))], CELL)
    put([("v", 2, 7.0, 6.0, at(0)), ("v", 1, 30.0, 30.0, at(0)), ("v", 2, 40.0, 40.0, at(0))], CELL)  # plane 1 again: the third is late for none
    put([("v", 0, 90.0, 90.0, at(0)), ("v", 4, 0.0, 0.0, at(0)), ("w", 5, 1.0, 2.0, at(0))], CELL)  # plane 0 is late
    first = monitors.as_table(monitors.follow_objects(opened(CELL), 3.0), out, "append")
    # the object of planes 0 to 2, one of plane 1 and one of plane 2; what is open in the last planes is not known to be over
    assert objects(first) == [("v", 0, 0, 2, 3), ("v", 1, 1, 1, 1), ("v", 2, 2, 2, 1)]
    assert max(r.late for r in first.collect()) == 1
    put([("v", None, None, None, at(1))], CELL)  # v ends
    put([("x", 0, 1.0, 1.0, at(60))], CELL)  # much later: w has been quiet
    second = monitors.as_table(monitors.follow_objects(opened(CELL), 3.0), out, "append")
    assert objects(second) == [*objects(first), ("v", 3, 4, 4, 1), ("w", 0, 4, 5, 2)]


def test_result_goes_on_after_a_restart(stream, spark):
    put, opened, out = stream
    schema = "phase string, metric string, iter long, num double, den double"
    put([("train", "loss", 1, 4.0, 2.0)], schema)
    run = lambda: monitors.as_table(monitors.running_averages(opened(schema), 10), out)
    assert [r.value for r in run().collect()] == [2.0]
    assert [r.value for r in run().collect()] == [2.0]  # nothing new
    put([("train", "loss", 2, 6.0, 2.0)], schema)
    assert [r.value for r in run().collect()] == [2.5]
    assert monitors.merged_so_far(spark, out + "/none").count() == 0


def test_patches_of_volumes_stay_apart(stream, spark):
    put, opened, out = stream
    voxel = "volume_id string, z int, y int, x int, v double"
    put([("a", 0, 0, 0, 1.0), ("b", 0, 0, 0, 5.0)], voxel)
    put([("a", 0, 0, 0, 3.0), ("a", 0, 0, 1, 2.0)], voxel)
    monitors.merge_patches(opened(voxel), out + "/merged", out + "/checkpoint").awaitTermination()
    found = {tuple(r)[:4]: r.v for r in monitors.merged_so_far(spark, out + "/merged").collect()}
    assert found == {("a", 0, 0, 0): 3.0, ("a", 0, 0, 1): 2.0, ("b", 0, 0, 0): 5.0}


def test_late_rows_of_windows_are_left_out(stream):
    put, opened, out = stream
    event = "ts timestamp, kind string"
    put([(at(0), "a"), (at(1), "a")], event)
    put([(at(200), "a")], event)  # moves the watermark to minute 190, for the batch after the next
    put([(at(201), "b")], event)
    put([(at(2), "a"), (at(195), "c")], event)  # the first is late for its window
    put([(at(400), "a")], event)
    counted = monitors.as_table(monitors.windowed(opened(event), "ts", "10 minutes", "1 hour", None, "kind"), out, "append")
    assert sorted((r.window.start, r.n) for r in counted.collect()) == [(at(0), 2), (at(180), 1), (at(180), 1), (at(180), 1)]


def test_jobs_count_once(stream):
    put, opened, out = stream
    job = "job string, at timestamp"
    put([("a", at(0)), ("a", at(1)), ("b", at(1))], job)
    put([("a", at(2)), ("c", at(3))], job)
    assert sorted(r.job for r in monitors.as_table(monitors.completed(opened(job), "job", "at", "1 hour"), out, "append").collect()) == ["a", "b", "c"]


class Counting(dict):
    looked = 0

    def get(self, key, none=()):
        found = super().get(key, none)
        self.looked += len(found)
        return found


@pytest.mark.parametrize("side", [12, 4000])
def test_a_cell_looks_at_the_objects_around_it(side):
    rng = random.Random(side)
    objects = [(k, 0, 0, 1, float(rng.randrange(side)) / 2, float(rng.randrange(side)) / 2) for k in range(3000)]
    cells, most = [(rng.randrange(side) / 2, rng.randrange(side) / 2) for _ in range(3500)], 3.0
    free = monitors._Free(list(objects), most)
    free.squares = Counting(free.squares)
    for y, x in cells:
        near = [o for o in objects if -most <= y - o[4] < most and -most <= x - o[5] < most]
        want = min(near, key=lambda o: ((y - o[4]) ** 2 + (x - o[5]) ** 2, o[0])) if near else None
        assert free.take(y, x) == want
        if want:
            objects.remove(want)
    assert sorted(free.rest()) == sorted(objects)
    assert free.squares.looked < 60 * len(cells)  # of 3000 objects
