"""Array and ROI files: NumPy arrays as voxels and blocks, ImageJ ROIs and their archives."""

from __future__ import annotations

import io
import struct
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmere.schemas import BLOCK


def npy_voxels(spark: SparkSession, path: str, background: float = 0.0) -> DataFrame:
    """(path, z, y, x, v) of the voxels of .npy files that are not background; one file is one task's work, so volumes are stored as several files along z (see stacked)."""

    def read(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                a = a.reshape((1,) * (3 - a.ndim) + a.shape)
                for z in range(len(a)):  # one plane at a time
                    y, x = np.nonzero(a[z] != background)
                    yield pd.DataFrame({"path": name, "z": np.full(len(y), z, np.int32), "y": y.astype(np.int32), "x": x.astype(np.int32), "v": a[z][y, x].astype(np.float64)})

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content").mapInPandas(read, "path string, z int, y int, x int, v double")


def npy_shapes(spark: SparkSession, path: str) -> DataFrame:
    """Shape and type from the header alone."""

    def read(batches):
        for pdf in batches:
            rows = []
            for name, head in zip(pdf["path"], pdf["head"]):
                stream = io.BytesIO(head)
                version = np.lib.format.read_magic(stream)
                shape, _, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(stream)
                rows.append((name, list(shape), str(dtype)))
            yield pd.DataFrame(rows, columns=["path", "shape", "dtype"])

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path)
    return found.select("path", F.substring("content", 1, 4096).alias("head")).mapInPandas(read, "path string, shape array<int>, dtype string")


def stacked(voxels: DataFrame, shapes: DataFrame) -> DataFrame:
    """Several files as one volume, in order of their paths along z; offsets come from the shapes."""
    from pyspark.sql import Window

    depth = F.when(F.size("shape") > 2, F.element_at("shape", 1)).otherwise(1)
    before = F.sum(depth).over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1))  # over files, not voxels
    offsets = shapes.select("path", F.coalesce(before, F.lit(0)).cast("int").alias("z0"))
    return voxels.join(offsets, "path").withColumn("z", F.col("z") + F.col("z0")).drop("z0", "path")


def to_blocks(voxels: DataFrame, edge: tuple[int, int, int], dtype: str = "float32") -> DataFrame:
    """Sparse voxels (volume_id, z, y, x, v) as dense blocks; each block is one group of bounded size."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        at = [int(first[f"b{c}"]) for c in "zyx"]
        a = np.zeros(edge, dtype)
        a[pdf["z"] - at[0] * edge[0], pdf["y"] - at[1] * edge[1], pdf["x"] - at[2] * edge[2]] = pdf["v"]
        return pd.DataFrame({"volume_id": [first["volume_id"]], "bz": at[:1], "by": at[1:2], "bx": at[2:], "c": [0], "offset": [[k * e for k, e in zip(at, edge)]], "shape": [list(edge)], "dtype": [dtype], "data": [a.tobytes()]})

    keyed = voxels.select("volume_id", "z", "y", "x", "v", *(F.floor(F.col(c) / e).cast("int").alias(f"b{c}") for c, e in zip("zyx", edge)))
    return keyed.groupBy("volume_id", "bz", "by", "bx").applyInPandas(pack, BLOCK)


def from_blocks(blocks: DataFrame, background: float = 0.0) -> DataFrame:
    """The voxels of dense blocks that are not background."""

    def unpack(batches):
        for pdf in batches:
            for b in pdf.itertuples():
                a = np.frombuffer(b.data, b.dtype).reshape(tuple(b.shape))
                z, y, x = np.nonzero(a != background)
                yield pd.DataFrame({"volume_id": b.volume_id, "z": (z + b.offset[0]).astype(np.int32), "y": (y + b.offset[1]).astype(np.int32), "x": (x + b.offset[2]).astype(np.int32), "v": a[z, y, x].astype(np.float64)})

    return blocks.mapInPandas(unpack, "volume_id string, z int, y int, x int, v double")


#: Kinds of ImageJ ROI and where the header holds what (big-endian).
ROI_KINDS = {0: "polygon", 1: "rectangle", 7: "freehand", 10: "point"}


def decode_roi(data: bytes) -> tuple[str, list[tuple[float, float]]]:
    """Kind and (y, x) points of an ImageJ ROI; sub-pixel coordinates where the file has them. Raises for other kinds and for subtypes."""
    if data[:4] != b"Iout":
        raise ValueError("not an ImageJ ROI")
    kind = data[6]
    if kind not in ROI_KINDS:
        raise ValueError(f"ROI kind {kind} is not read")
    top, left, bottom, right, n = struct.unpack_from(">4hH", data, 8)
    subtype, options = struct.unpack_from(">2h", data, 48)
    if subtype:
        raise ValueError(f"ROI subtype {subtype} is not read")
    if kind == 1:
        return ROI_KINDS[kind], [(float(y), float(x)) for y, x in ((top, left), (top, right), (bottom, right), (bottom, left))]
    if options & 128:
        xs = np.frombuffer(data, ">f4", n, 64 + 4 * n)
        ys = np.frombuffer(data, ">f4", n, 64 + 8 * n)
    else:
        xs = np.frombuffer(data, ">i2", n, 64).astype(float) + left
        ys = np.frombuffer(data, ">i2", n, 64 + 2 * n).astype(float) + top
    return ROI_KINDS[kind], [(float(y), float(x)) for y, x in zip(ys, xs)]


def rois(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, kind, z, pts) of .roi files and of those in .zip archives; the plane is the first number of a name `z-y-x.roi`."""

    def read(batches):
        for pdf in batches:
            rows = []
            for name, content in zip(pdf["path"], pdf["content"]):
                if name.lower().endswith(".zip"):
                    with zipfile.ZipFile(io.BytesIO(content)) as archive:
                        found = [(n, archive.read(n)) for n in archive.namelist() if n.lower().endswith(".roi")]
                else:
                    found = [(name.rsplit("/", 1)[-1], content)]
                for n, data in found:
                    kind, points = decode_roi(data)
                    rows.append((name, n, kind, [{"y": y, "x": x} for y, x in points]))
            yield pd.DataFrame(rows, columns=["path", "name", "kind", "pts"])

    found = spark.read.format("binaryFile").load(path).select("path", "content").where(F.lower("path").rlike(r"\.(roi|zip)$"))
    decoded = found.mapInPandas(read, "path string, name string, kind string, pts array<struct<y:double,x:double>>")
    return decoded.withColumn("z", F.element_at(F.split("name", "-"), 1).try_cast("int"))
