"""Volumes in NumPy and TIFF files as Spark data sources: read in ranges of planes, written slab by slab.

    spark.dataSource.register(NpyVolumes)
    spark.read.format("npy_volume").load("/data/brain")                     (path, z, y, x, v)
    write_volume(voxels, "/data/out", (696, 2160, 2560), kind="npy_volume")

Reading plans partitions from headers alone and reads byte ranges, so a file may have any size: a task holds one plane
at a time. Files are reached through pyarrow's file systems (local paths, file://, hdfs://, s3:// ...), from the
driver and the executors alike.

Options of reading: `background` (value that is not listed, 0) and `partBytes` (bytes of a partition, 64 MB).
"""

from __future__ import annotations

import io
import math
import struct
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

PART_BYTES = 64 << 20
VOXELS = "path string, z int, y int, x int, v double"
NAMES = ["path", "z", "y", "x", "v"]


class Piece(NamedTuple):
    """Bytes of a file."""

    at: int
    length: int


class Plane(NamedTuple):
    """One stored plane: its place along the slowest axis, its pieces, shape and type; turned: z is the fastest axis."""

    number: int
    pieces: tuple[Piece, ...]
    shape: tuple[int, int]
    dtype: str
    turned: bool = False


class Range(InputPartition):
    def __init__(self, path: str, planes: list[Plane]):
        self.path, self.planes = path, planes


def opened(path: str) -> tuple[files.FileSystem, str]:
    return files.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (files.LocalFileSystem(), path)


def listed(path: str, endings: tuple[str, ...]) -> list[str]:
    """The files of a folder in order of their names, or the one file."""
    system, inner = opened(path)
    info = system.get_file_info(inner)
    if info.type == files.FileType.File:
        return [path]
    if info.type == files.FileType.NotFound:
        raise FileNotFoundError(path)
    found = system.get_file_info(files.FileSelector(inner, recursive=True))
    names = sorted(f.path for f in found if f.type == files.FileType.File and f.path.lower().endswith(endings) and not any(p.startswith("_") for p in f.path[len(inner) :].split("/")))
    return [path[: len(path) - len(inner)] + n if path.endswith(inner) else n for n in names]


def npy_planes(read: Callable[[int, int], bytes]) -> list[Plane]:
    """The planes of a .npy file from its header; fewer than three axes count as one plane or row."""
    stream = io.BytesIO(read(0, 1 << 16))
    version = np.lib.format.read_magic(stream)
    shape, turned, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(stream)
    if len(shape) > 3 or dtype.hasobject:
        raise ValueError(f"a volume has at most three axes of numbers, not {shape} of {dtype}")
    z, y, x = (1,) * (3 - len(shape)) + tuple(shape)
    n, plane = (x, (y, z)) if turned else (z, (y, x))  # the slowest axis in the file, and what is stored for each place on it
    size = plane[0] * plane[1] * dtype.itemsize
    return [Plane(k, (Piece(stream.tell() + k * size, size),), plane, dtype.str, turned) for k in range(n)]


#: TIFF field types that hold whole numbers, and sample types by (bits, sample format).
WHOLE = {1: "B", 3: "H", 4: "I", 16: "Q"}
SAMPLES = {(8, 1): "u1", (16, 1): "u2", (32, 1): "u4", (8, 2): "i1", (16, 2): "i2", (32, 2): "i4", (32, 3): "f4", (64, 3): "f8"}


def tiff_planes(read: Callable[[int, int], bytes]) -> list[Plane]:
    """The pages of an uncompressed single-channel TIFF or BigTIFF, from its directories alone."""
    head = read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    kind = struct.unpack_from(order + "H", head, 2)[0] if order else 0
    if kind not in (42, 43):
        raise ValueError("not a TIFF file")
    word, count_word, entry = ("I", "H", 12) if kind == 42 else ("Q", "Q", 20)
    width, count_width = struct.calcsize(order + word), struct.calcsize(order + count_word)
    at = struct.unpack_from(order + word, head, 4 if kind == 42 else 8)[0]
    out: list[Plane] = []
    while at:
        n = struct.unpack(order + count_word, read(at, count_width))[0]
        directory = read(at + count_width, n * entry + width)
        tags = {}
        for k in range(n):
            tag, field, count = struct.unpack_from(order + "HH" + word, directory, k * entry)
            if field in WHOLE:
                size = struct.calcsize(order + WHOLE[field]) * count
                where = k * entry + 4 + width
                data = directory[where : where + size] if size <= width else read(struct.unpack_from(order + word, directory, where)[0], size)
                tags[tag] = struct.unpack(f"{order}{count}{WHOLE[field]}", data)
        if tags.get(259, (1,))[0] != 1 or tags.get(277, (1,))[0] != 1:
            raise ValueError("only uncompressed single-channel TIFF is read")
        dtype = SAMPLES[(tags[258][0], tags.get(339, (1,))[0])]
        out.append(Plane(len(out), tuple(Piece(o, c) for o, c in zip(tags[273], tags[279])), (tags[257][0], tags[256][0]), np.dtype(order + dtype).str))
        at = struct.unpack_from(order + word, directory, n * entry)[0]
    return out


class _Reader(DataSourceReader):
    def __init__(self, options: dict, endings: tuple[str, ...], planes_of: Callable):
        self.path, self.endings, self.planes_of = options["path"], endings, planes_of
        self.background, self.part_bytes = float(options.get("background", 0)), int(options.get("partBytes", PART_BYTES))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in listed(self.path, self.endings):
            system, inner = opened(path)
            with system.open_input_file(inner) as f:
                planes = self.planes_of(lambda at, n: f.read_at(n, at))
            for i, j in ranges([sum(p.length for p in plane.pieces) for plane in planes], self.part_bytes):
                out.append(Range(path, planes[i:j]))
        return out or [Range("", [])]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.planes:
            return
        system, inner = opened(part.path)
        with system.open_input_file(inner) as f:
            for plane in part.planes:
                data = b"".join(f.read_at(p.length, p.at) for p in plane.pieces)
                a = np.frombuffer(data, plane.dtype).reshape(plane.shape)
                i, j = np.nonzero(a != self.background)
                v = a[i, j].astype(np.float64)
                k = np.full(len(i), plane.number)
                z, y, x = (j, i, k) if plane.turned else (k, i, j)
                columns = [pa.array([part.path] * len(i), pa.string()), *(pa.array(c.astype(np.int32)) for c in (z, y, x)), pa.array(v)]
                yield pa.RecordBatch.from_arrays(columns, names=NAMES)


def ranges(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Ranges of neighbours that are at most `most` together; a larger one stands alone."""
    out, begin, held = [], 0, 0
    for k, size in enumerate(sizes):
        if k > begin and held + size > most:
            out.append((begin, k))
            begin, held = k, 0
        held += size
    return [*out, (begin, len(sizes))] if begin < len(sizes) else out


class Written(WriterCommitMessage):
    def __init__(self, moves: list[tuple[str, str]], folder: str):
        self.moves, self.folder = moves, folder


def npy_ends(shape: tuple[int, int, int], dtype: np.dtype) -> tuple[bytes, bytes]:
    """What stands before and after the planes in a .npy file."""
    out = io.BytesIO()
    np.lib.format.write_array_header_1_0(out, {"descr": np.lib.format.dtype_to_descr(dtype), "fortran_order": False, "shape": shape})
    return out.getvalue(), b""


def tiff_ends(shape: tuple[int, int, int], dtype: np.dtype) -> tuple[bytes, bytes]:
    """What stands before and after the planes in an uncompressed TIFF with a page for each plane, each in one strip."""
    form = {"u": 1, "i": 2, "f": 3}[dtype.kind]
    page = shape[1] * shape[2] * dtype.itemsize
    entries = 9
    step = 2 + 12 * entries + 4
    if 8 + shape[0] * (page + step) >= 1 << 32:
        raise ValueError("a TIFF file ends at 4 GB; use thinner slabs")
    out = []
    for k in range(shape[0]):
        tags = [(256, 4, shape[2]), (257, 4, shape[1]), (258, 3, 8 * dtype.itemsize), (259, 3, 1), (262, 3, 1), (273, 4, 8 + k * page), (277, 3, 1), (279, 4, page), (339, 3, form)]
        at = 8 + shape[0] * page + (k + 1) * step
        out.append(struct.pack("<H", entries) + b"".join(struct.pack("<HHII", tag, kind, 1, v) for tag, kind, v in tags) + struct.pack("<I", at if k + 1 < shape[0] else 0))
    return struct.pack("<2sHI", b"II", 42, 8 + shape[0] * page), b"".join(out)


class _Writer(DataSourceArrowWriter):
    """Each task writes its slabs to files with names of its own; the commit moves those of the tasks that count to their places.

    A task that is run again leaves other files, which go with the folder they are in.
    """

    def __init__(self, options: dict, overwrite: bool, ending: str, ends: Callable[[tuple[int, int, int], np.dtype], tuple[bytes, bytes]]):
        self.path, self.ending, self.ends, self.overwrite = options["path"].rstrip("/"), ending, ends, overwrite
        self.dims, self.depth, self.dtype = tuple(map(int, options["dims"].split(","))), int(options["depth"]), options.get("dtype", "float32")
        self.fill, self.folder = float(options.get("background", 0)), f"{self.path}/_writing-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, folder = opened(self.folder)
        system.create_dir(folder, recursive=True)
        dtype = np.dtype(self.dtype).newbyteorder("<")
        moves, slab, at, plane, file, tail = [], None, 0, None, None, b""

        def upto(z: int) -> None:
            """Writes the planes before z; those without voxels are background."""
            nonlocal at, plane
            while at < z:
                file.write((np.full(self.dims[1:], self.fill, dtype) if plane is None else plane).tobytes())
                at, plane = at + 1, None

        def close() -> None:
            upto(min((slab[1] + 1) * self.depth, self.dims[0]))
            file.write(tail)
            file.close()

        for b in batches:
            volume, k, planes = b["volume_id"].to_pylist(), b["slab"].to_numpy(), b["z"].to_numpy()
            change = [0, *(i for i in range(1, len(b)) if planes[i] != planes[i - 1] or k[i] != k[i - 1] or volume[i] != volume[i - 1]), len(b)]
            for i, j in zip(change, change[1:]):
                if i == j:
                    continue
                if slab != (volume[i], int(k[i])):
                    if slab is not None:
                        close()
                    slab = (volume[i], int(k[i]))
                    at = slab[1] * self.depth
                    name, place = f"{uuid.uuid4().hex}{self.ending}", f"z{at:06d}{self.ending}"
                    moves.append((name, f"{volume[i]}/{place}" if volume[i] else place))
                    head, tail = self.ends((min(self.depth, self.dims[0] - at), *self.dims[1:]), dtype)
                    file = system.open_output_stream(f"{folder}/{name}")
                    file.write(head)
                upto(int(planes[i]))
                plane = np.full(self.dims[1:], self.fill, dtype) if plane is None else plane
                part = b.slice(i, j - i)
                v = part["v"].to_numpy(zero_copy_only=False)
                there = ~np.isnan(v)
                y, x = (part[c].to_numpy()[there] for c in "yx")
                plane[y, x] = v[there]
        if slab is not None:
            close()
        return Written(moves, self.folder)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, folder = opened(self.folder)
        path = opened(self.path)[1]
        if self.overwrite:
            for info in system.get_file_info(files.FileSelector(path, allow_not_found=True, recursive=True)):
                if info.type == files.FileType.File and info.path.endswith(self.ending) and not info.path.startswith(folder):
                    system.delete_file(info.path)
        for name, place in (m for message in messages if message for m in message.moves):
            system.create_dir(f"{path}/{place}".rpartition("/")[0], recursive=True)
            system.move(f"{folder}/{name}", f"{path}/{place}")
        self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, folder = opened(self.folder)
        if system.get_file_info(folder).type != files.FileType.NotFound:
            system.delete_dir(folder)


class _Volumes(DataSource):
    endings: tuple[str, ...]

    def schema(self) -> str:
        return VOXELS


class NpyVolumes(_Volumes):
    """S8, V16, S17."""

    @classmethod
    def name(cls) -> str:
        return "npy_volume"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, (".npy",), npy_planes)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, overwrite, ".npy", npy_ends)


class TiffVolumes(_Volumes):
    """S6, S7, S17."""

    @classmethod
    def name(cls) -> str:
        return "tiff_volume"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, (".tif", ".tiff"), tiff_planes)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, overwrite, ".tif", tiff_ends)


def read_volume(spark, path: str, kind: str = "npy_volume", background: float = 0.0, part_bytes: int = PART_BYTES) -> DataFrame:
    """(path, z, y, x, v) of the voxels of a file, or of all files of a folder, that are not background."""
    for source in (NpyVolumes, TiffVolumes):
        spark.dataSource.register(source)
    return spark.read.format(kind).option("background", background).option("partBytes", part_bytes).load(path)


def combined(voxels: DataFrame, dims: tuple[int, int, int], orientation: tuple[str, str, str] | None = None) -> DataFrame:
    """The files of planes or slabs of one volume as one: z counts on from the number that ends each file's name (z000030.npy starts at 30), then the axes are put in order."""
    from voxmere.functions.geometry import reorient

    first = F.regexp_extract("path", r"(\d+)\.[A-Za-z]+$", 1).try_cast("int")
    whole = voxels.withColumn("z", F.col("z") + F.coalesce(first, F.lit(0))).drop("path")
    if orientation is None:
        return whole
    return reorient(whole, dims, orientation).withColumns({c: F.col(c).cast("int") for c in "zyx"})


def write_volume(voxels: DataFrame, path: str, dims: tuple[int, int, int], depth: int = 30, dtype: str = "float32", kind: str = "npy_volume", background: float = 0.0, mode: str = "overwrite") -> None:
    """Dense slabs of `depth` planes, a file each (of a volume's own folder where there is a volume_id); slabs without voxels are written too.

    A task holds one plane of its slab at a time. Voxels outside the dimensions are left out; of several at a place one counts.
    """
    spark = voxels.sparkSession
    for source in (NpyVolumes, TiffVolumes):
        spark.dataSource.register(source)
    by = F.col("volume_id").cast("string") if "volume_id" in voxels.columns else F.lit(None).cast("string")
    inside = F.lit(True)
    for c, d in zip("zyx", dims):
        inside &= F.col(c).between(0, d - 1)
    rows = voxels.select(by.alias("volume_id"), *(F.col(c).cast("int").alias(c) for c in "zyx"), F.col("v").cast("double").alias("v")).where(inside & F.col("v").isNotNull())
    volumes = voxels.select(by.alias("volume_id")).distinct()
    empty = volumes.withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(dims[0] - 1), F.lit(depth)))).select("volume_id", "z", F.lit(0).alias("y"), F.lit(0).alias("x"), F.lit(None).cast("double").alias("v"))
    slabs = rows.unionByName(empty).withColumn("slab", F.floor(F.col("z") / depth).cast("int"))
    dealt = slabs.repartition(math.ceil(dims[0] / depth), "volume_id", "slab").sortWithinPartitions("volume_id", "slab", "z")
    writer = dealt.write.format(kind).mode(mode).option("dims", ",".join(map(str, dims))).option("depth", depth).option("dtype", dtype).option("background", background)
    writer.save(path)
