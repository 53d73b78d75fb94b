"""NIfTI volumes as a data source: spark.read.format("nifti").load(folder), and df.write.format("nifti")."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage

from pairvox.sources.tables import _affine

#: Element types by their code.
KINDS = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}
SLICES = "volume_id string, z long, height int, width int, px array<double>, sx double, sy double, sz double, affine array<array<double>>"
#: Bytes of files that a task reads; values of a batch of slices.
TASK_BYTES, BATCH_VALUES = 64 << 20, 1 << 20


@dataclass
class Header:
    order: str
    shape: tuple[int, int, int]
    kind: str
    spacing: tuple[float, float, float]
    start: int
    slope: float
    shift: float
    affine: list[list[float]]

    @classmethod
    def of(cls, raw: bytes) -> Header:
        order = "<" if struct.unpack("<i", raw[:4])[0] == 348 else ">"
        shape = tuple(max(1, d) for d in struct.unpack(f"{order}8h", raw[40:56])[1:4])
        code = struct.unpack(f"{order}h", raw[70:72])[0]
        if code not in KINDS:
            raise ValueError(f"element type {code} is not known")
        spacing = struct.unpack(f"{order}8f", raw[76:108])[1:4]
        start, slope, shift = struct.unpack(f"{order}3f", raw[108:120])
        return cls(order, shape, KINDS[code], spacing, int(start), slope, shift, _affine(raw, order, spacing))

    def values(self, raw: bytes) -> np.ndarray:
        x = np.frombuffer(raw, f"{self.order}{self.kind}").astype(np.float64)
        return x * self.slope + self.shift if self.slope not in (0.0, 1.0) or self.shift else x


@dataclass
class Files(InputPartition):
    """Files, or shares of them: (path, share, of how many)."""

    parts: list[tuple[str, int, int]]


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _stem(path: str) -> str:
    return path.rsplit("/", 1)[-1].removesuffix(".gz").removesuffix(".nii")


class VolumeReader(DataSourceReader):
    """Slices of all .nii and .nii.gz files below a folder.

    Small files share a task. Of a large one that isn't compressed each task takes a share of the slices and seeks to
    them; a compressed one is decompressed as it is read. Either way a task holds a batch of slices, not a volume.
    """

    def __init__(self, path: str) -> None:
        self.path = path
        self.volumes: set[str] | None = None
        self.begins: list[str] = []
        self.low, self.high = 0, 1 << 62

    def partitions(self) -> list[InputPartition]:
        store, base = _opened(self.path)
        found = [f for f in store.get_file_info(fs.FileSelector(base, recursive=True)) if f.is_file and f.path.endswith((".nii", ".nii.gz"))]
        out, held, size = [], [], 0
        for f in sorted(found, key=lambda f: f.path):
            if self.volumes is not None and _stem(f.path) not in self.volumes or not all(map(_stem(f.path).startswith, self.begins)):
                continue
            shares = 1 if f.path.endswith(".gz") else max(1, -(-f.size // TASK_BYTES))
            if shares > 1:
                out += [Files([(f.path, k, shares)]) for k in range(shares)]
                continue
            held.append((f.path, 0, 1))
            size += f.size
            if size >= TASK_BYTES:
                out.append(Files(held))
                held, size = [], 0
        return [*out, *([Files(held)] if held else [])] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = _opened(self.path)
        for path, share, shares in partition.parts:
            with store.open_input_file(path) as raw:
                body = gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw
                head = Header.of(body.read(348))
                nx, ny, nz = head.shape
                size = nx * ny * np.dtype(head.kind).itemsize
                first, last = max(self.low, nz * share // shares), min(self.high, nz * (share + 1) // shares - 1)
                if first > last:
                    continue
                body.seek(head.start + first * size)  # in a compressed file this reads on
                step = max(1, BATCH_VALUES // (nx * ny))
                for z in range(first, last + 1, step):
                    n = min(step, last + 1 - z)
                    read = body.read(n * size)
                    if len(read) < n * size:
                        raise ValueError(f"{path} ends before slice {z + n - 1}")
                    yield _batch(_stem(path), z, n, head, head.values(read))


class FilteringReader(VolumeReader):
    """The same with filters on volume_id and z: files and slices that they leave out are not read."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            if column == "volume_id" and isinstance(f, (EqualTo, In)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.volumes = wanted if self.volumes is None else self.volumes & wanted
            elif column == "volume_id" and isinstance(f, StringStartsWith):
                self.begins.append(f.value)
            elif column == "z" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.high = min(self.high, f.value - isinstance(f, LessThan))
            else:
                yield f


def _batch(volume: str, z: int, n: int, head: Header, values: np.ndarray) -> pa.RecordBatch:
    nx, ny, _ = head.shape
    same = lambda x, kind: pa.array([x] * n, kind)
    px = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (nx * ny)), pa.array(values))
    columns = [same(volume, pa.string()), pa.array(np.arange(z, z + n)), same(ny, pa.int32()), same(nx, pa.int32()), px, *(same(s, pa.float64()) for s in head.spacing), same(head.affine, pa.list_(pa.list_(pa.float64())))]
    return pa.RecordBatch.from_arrays(columns, ["volume_id", "z", "height", "width", "px", "sx", "sy", "sz", "affine"])


@dataclass
class Written(WriterCommitMessage):
    files: int


class VolumeWriter(DataSourceWriter):
    """A file for each volume. Rows of a volume come together and by z (see `write_volumes`); a volume is what a task holds.

    A file appears whole under its name, so a task that runs again replaces what it wrote, and other volumes' files stay.
    """

    def __init__(self, path: str, columns: list[str], kind: str, compressed: bool) -> None:
        self.path, self.columns, self.kind, self.compressed = path, columns, kind, compressed

    def write(self, iterator: Iterator) -> Written:
        at = {c: i for i, c in enumerate(self.columns)}
        held, files = [], 0
        for row in iterator:
            if held and row[at["volume_id"]] != held[0][at["volume_id"]]:
                files += self._file(held, at)
                held = []
            held.append(row)
        return Written(files + (self._file(held, at) if held else 0))

    def _file(self, rows: list, at: dict[str, int]) -> int:
        one = rows[0]
        height, width = one[at["height"]], one[at["width"]]
        if [r[at["z"]] for r in rows] != list(range(len(rows))) or any((r[at["height"]], r[at["width"]]) != (height, width) for r in rows):
            raise ValueError(f"slices of {one[at['volume_id']]} are not 0, 1, 2, ... of one size")
        spacing = [float(one[at[c]]) if c in at else 1.0 for c in ("sx", "sy", "sz")]
        head = bytearray(352)
        struct.pack_into("<i", head, 0, 348)
        struct.pack_into("<8h", head, 40, 3, width, height, len(rows), 1, 1, 1, 1)
        struct.pack_into("<2h", head, 70, next(code for code, k in KINDS.items() if k == self.kind), 8 * np.dtype(self.kind).itemsize)
        struct.pack_into("<8f", head, 76, 1.0, *spacing, 0, 0, 0, 0)
        struct.pack_into("<3f", head, 108, 352.0, 1.0, 0.0)
        head[344:348] = b"n+1\0"
        body = bytes(head) + b"".join(np.asarray(r[at["px"]], "<" + self.kind).tobytes() for r in rows)
        store, base = _opened(self.path)
        store.create_dir(base, recursive=True)
        name = f"{base.rstrip('/')}/{one[at['volume_id']]}.nii" + (".gz" if self.compressed else "")
        with store.open_output_stream(f"{name}.part", compression=None) as out:
            out.write(gzip.compress(body, mtime=0) if self.compressed else body)
        store.move(f"{name}.part", name)
        return 1


class NiftiSource(DataSource):
    """Options: path; for reading, `pushdown` (needs spark.sql.python.filterPushdown.enabled); for writing, `kind` (f4 or f8, ...) and `compressed`."""

    @classmethod
    def name(cls) -> str:
        return "nifti"

    def schema(self) -> str:
        return SLICES

    def reader(self, schema) -> DataSourceReader:
        pushes = self.options.get("pushdown", "false").lower() == "true"
        return (FilteringReader if pushes else VolumeReader)(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return VolumeWriter(self.options["path"], schema.names, self.options.get("kind", "f4"), self.options.get("compressed", "true").lower() == "true")


def register(spark: SparkSession) -> None:
    """Makes format("nifti") known to the session."""
    spark.dataSource.register(NiftiSource)


def write_volumes(slices: DataFrame, path: str, *, kind: str = "f4", compressed: bool = True) -> None:
    """slices (volume_id, z, height, width, px, sx, sy, sz if there) as a file for each volume; z counts from 0."""
    register(slices.sparkSession)
    slices.repartition("volume_id").sortWithinPartitions("volume_id", "z").write.format("nifti").option("kind", kind).option("compressed", str(compressed)).mode("append").save(path)
