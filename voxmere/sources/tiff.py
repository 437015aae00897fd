"""Uncompressed TIFF planes and stacks as voxels."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def pages(data: bytes):
    """The pages of an uncompressed single-channel TIFF as arrays; raises for other kinds."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack_from(order + "I", data, 4)[0]
    width = {1: "B", 3: "H", 4: "I"}
    while at:
        tags = {}
        n = struct.unpack_from(order + "H", data, at)[0]
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            if kind in width:
                size = struct.calcsize(width[kind]) * count
                where = at + 10 + 12 * k if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * k)[0]
                tags[tag] = struct.unpack_from(f"{order}{count}{width[kind]}", data, where)
        if tags.get(259, (1,))[0] != 1 or tags.get(277, (1,))[0] != 1:
            raise ValueError("only uncompressed single-channel TIFF is read")
        kind = {(8, 1): "u1", (16, 1): "u2", (32, 1): "u4", (32, 3): "f4"}[(tags[258][0], tags.get(339, (1,))[0])]
        strips = b"".join(data[o : o + c] for o, c in zip(tags[273], tags[279]))
        yield np.frombuffer(strips, order + kind).reshape(tags[257][0], tags[256][0])
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def tiff_voxels(spark: SparkSession, path: str, background: float = 0.0) -> DataFrame:
    """(path, z, y, x, v) of the voxels that are not background; z is the page. Each file is one row, so many planes are read in parallel."""

    def read(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                for z, a in enumerate(pages(content)):
                    y, x = np.nonzero(a != background)
                    yield pd.DataFrame({"path": name, "z": np.full(len(y), z, np.int32), "y": y.astype(np.int32), "x": x.astype(np.int32), "v": a[y, x].astype(np.float64)})

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.tif*").load(path).select("path", "content").mapInPandas(read, "path string, z int, y int, x int, v double")
