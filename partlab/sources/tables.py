"""Files as DataFrames and back: meshes, weights, partitions, point clouds, pictures.

Binary MEDIT meshes, weight and partition files have records of fixed width: the data sources
``meshb``, ``mewe`` and ``mepe`` read them in ranges of records, one task each, without loading
the file. Text meshes and VTK files are read by Spark's binaryFile source, a file a task.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import shared
from ..model import FormatError, UnsupportedVersion
from . import meshfile

NODES = "node_id bigint, coords array<double>, ref bigint"
ELEMENTS = "el_id bigint, type string, nodes array<bigint>, ref bigint, block int"
#: Records of a task.
RECORDS = 1 << 20


def _nodes(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in it:
        for data in pdf["content"]:
            m = meshfile.parse(bytes(data))
            for i in range(0, len(m.refs), RECORDS):
                yield pd.DataFrame({"node_id": np.arange(i, min(i + RECORDS, len(m.refs))), "coords": list(m.coords[i : i + RECORDS]), "ref": m.refs[i : i + RECORDS]})


def _elements(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in it:
        for data in pdf["content"]:
            at = 0
            for block, (kind, nodes, refs) in enumerate(meshfile.parse(bytes(data)).blocks):
                yield pd.DataFrame({"el_id": np.arange(at, at + len(refs)), "type": kind, "nodes": list(nodes), "ref": refs, "block": np.full(len(refs), block, np.int32)})
                at += len(refs)


def read_mesh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, elements) of one mesh file; the format is told from its first bytes."""
    try:
        with open_file(path) as f:
            binary = meshfile.sniff(f.read(256)) == "medit-binary"
            if binary:  # a broken file is refused here, not by a task
                f.seek(0)
                meshfile.sections(f)
    except (OSError, ValueError):  # a store that only Spark reads
        binary = False
    if binary:
        register(spark)
        source = spark.read.format("meshb")
        return source.option("table", "nodes").load(path), source.option("table", "elements").load(path)
    raw = spark.read.format("binaryFile").load(path).select("content")
    return raw.mapInPandas(_nodes, NODES), raw.mapInPandas(_elements, ELEMENTS)


def collect_mesh(nodes: DataFrame, elements: DataFrame) -> meshfile.Mesh:
    """A mesh as arrays on the driver: for writing the formats that are one file by definition.
    Elements name nodes by their place in node_id order."""
    n = nodes.orderBy("node_id").toPandas()
    d = len(n["coords"].iloc[0]) if len(n) else 2
    place = {v: i for i, v in enumerate(n["node_id"].tolist())}
    e = elements.orderBy("block", "el_id").toPandas()
    mesh = meshfile.Mesh(d, np.array(n["coords"].tolist(), float).reshape(len(n), d), n["ref"].to_numpy(np.int64))
    for (_, kind), b in e.groupby(["block", "type"], sort=True):
        mesh.blocks.append((kind, np.array([[place[v] for v in row] for row in b["nodes"]], np.int64), b["ref"].to_numpy(np.int64)))
    return mesh


WRITERS = {"mesh": meshfile.to_medit, "meshb": meshfile.to_medit_binary, "vtk-ascii": lambda m: meshfile.to_vtk(m, False), "vtk-binary": lambda m: meshfile.to_vtk(m, True)}


def mesh_format(path: str, name: str | None = None) -> str:
    """The format that a name or else a file's ending asks for; ``meshb`` if neither does."""
    if name is not None:
        if name not in WRITERS:
            raise FormatError(f"unknown format {name!r}")
        return name
    ending = path.rpartition(".")[2].lower()
    return {"mesh": "mesh", "meshb": "meshb", "vtk": "vtk-binary"}.get(ending, "meshb")


def write_bytes(spark: SparkSession, path: str, parts: Iterator[bytes]) -> None:
    """A single file in any store that Hadoop's file systems reach."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        for part in parts:
            out.write(bytearray(part))
    finally:
        out.close()


def write_mesh(nodes: DataFrame, elements: DataFrame, path: str, name: str | None = None) -> None:
    write_bytes(nodes.sparkSession, path, iter([WRITERS[mesh_format(path, name)](collect_mesh(nodes, elements))]))


def _in_id_order(df: DataFrame, kind: str) -> Iterator[bytes]:
    """Records in the order of ids, one partition of the sorted table at a time."""
    rows: list = []
    for r in df.orderBy("id").select("v").toLocalIterator(prefetchPartitions=True):
        rows.append(r["v"])
        if len(rows) >= 100_000:
            yield np.array(rows, kind).tobytes()
            rows = []
    yield np.array(rows, kind).tobytes()


def _reached(folder: str) -> bool:
    """Whether Arrow, and so a task, can write to a folder."""
    from pyarrow import fs

    try:
        fs.FileSystem.from_uri(folder)
    except (OSError, ValueError, NotImplementedError):
        return False
    return True


def _write_records(df: DataFrame, path: str, head: Callable[[int], bytes], kind: str, width: int) -> None:
    """One file of ``head`` (of the number of records) and the records (id, v array) in the order
    of ids. Tasks write their records as files in the shared folder, which are put together as
    streams; only their names come to the driver. Where Arrow doesn't reach the shared folder the
    records go through the driver, a partition at a time."""
    spark = df.sparkSession
    folder = shared.new_path(spark, "records")
    if ":" not in folder:  # in the store that Hadoop means by a bare path
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        folder = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString().replace("file:/", "file:///", 1)
    if not _reached(folder):
        n = df.count()
        write_bytes(spark, path, (x for part in ([head(n)], _in_id_order(df, kind)) for x in part))
        return
    whole = kind != "<f8"
    values = df.select("id", F.col("v").cast("array<bigint>" if whole else "array<double>").alias("v"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        place, n = TaskContext.get().partitionId(), 0
        system, own = fs.FileSystem.from_uri(folder)
        system.create_dir(own, recursive=True)
        name = f"{place}-{uuid.uuid4().hex}"  # a task that is tried again writes another file
        with system.open_output_stream(f"{own}/{name}") as out:
            for b in batches:
                v = b.column("v")
                flat = v.flatten()
                if v.null_count or flat.null_count or len(flat) != width * len(v) or set(pc.unique(pc.list_value_length(v)).to_pylist()) - {width}:
                    raise FormatError(f"a record must have {width} numbers")
                numbers = flat.to_numpy(zero_copy_only=False)
                if kind == "<u8" and len(numbers) and numbers.min() < 0:
                    raise FormatError("parts must not be negative")
                out.write(numbers.astype(kind, copy=False).tobytes())
                n += len(v)
        if n:
            yield pa.RecordBatch.from_pydict({"place": pa.array([place], pa.int32()), "name": [name], "n": pa.array([n], pa.int64())})

    found = sorted(tuple(r) for r in values.orderBy("id").mapInArrow(task, "place int, name string, n bigint").collect())
    jvm = spark.sparkContext._jvm
    conf, Path = spark.sparkContext._jsc.hadoopConfiguration(), jvm.org.apache.hadoop.fs.Path
    out = Path(path).getFileSystem(conf).create(Path(path), True)
    try:
        out.write(bytearray(head(sum(n for _, _, n in found))))
        for _, name, _ in found:
            part = Path(f"{folder}/{name}")
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(part.getFileSystem(conf).open(part), out, conf, False)
    finally:
        out.close()
    shared.remove(spark, folder)


def write_weights(weights: DataFrame, path: str) -> None:
    """(id, w) with w a number or an array of up to 65 535 criteria; whole numbers are written as
    integers."""
    kind = weights.schema["w"].dataType.simpleString()
    many = kind.startswith("array")
    criteria = (weights.agg(F.max(F.size("w"))).first()[0] or 0) if many else 1
    if criteria > 65_535:
        raise FormatError("a weight file holds 65535 criteria at most")
    integral = not any(x in kind for x in ("double", "float", "decimal"))
    head = lambda n: b"MeWe" + struct.pack("<BBHQ", 1, int(integral), criteria, n)
    values = weights.select("id", F.col("w").alias("v") if many else F.array("w").alias("v"))
    _write_records(values, path, head, "<i8" if integral else "<f8", criteria)


def write_partition(partition: DataFrame, path: str) -> None:
    values = partition.select("id", F.array("part").alias("v"))
    _write_records(values, path, lambda n: b"MePe" + struct.pack("<Q", n), "<u8", 1)


def open_file(path: str):
    """A file that can be read at any place, here or in a store that Arrow reaches."""
    from pyarrow import fs

    system, local = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(local)


class _Records(InputPartition):
    def __init__(self, first: int, count: int):
        super().__init__((first, count))
        self.first, self.count = first, count


class _FixedWidth(DataSource):
    """Common ground of both record formats."""

    def _open(self):
        return open_file(self.options["path"])

    def reader(self, schema):
        return _Reader(self)


class _Reader(DataSourceReader):
    def __init__(self, source):
        self.source = source
        with source._open() as f:
            self.start, self.width, self.count, self.kind = source.header(f)

    def partitions(self):
        return [_Records(i, min(RECORDS, self.count - i)) for i in range(0, self.count, RECORDS)] or [_Records(0, 0)]

    def read(self, partition):
        size = 8 * self.width
        with self.source._open() as f:
            f.seek(self.start + partition.first * size)
            raw = f.read(partition.count * size)
        if len(raw) < partition.count * size:
            raise FormatError("the file ends early")
        values = np.frombuffer(raw, self.kind)
        ids = pa.array(np.arange(partition.first, partition.first + partition.count, dtype=np.int64))
        yield self.source.batch(ids, values, self.width)


class WeightSource(_FixedWidth):
    """``spark.read.format("mewe").load(path)``: (id, w array<bigint> or array<double>)."""

    @classmethod
    def name(cls):
        return "mewe"

    def header(self, f):
        head = f.read(16)
        if head[:4] != b"MeWe":
            raise FormatError("not a weight file")
        version, flags, criteria = struct.unpack("<BBH", head[4:8])
        if version != 1:
            raise UnsupportedVersion(f"version {version}")
        count = struct.unpack("<Q", head[8:16])[0] if criteria else 0
        return 16, criteria, count, "<i8" if flags & 1 else "<f8"

    def schema(self):
        with self._open() as f:
            kind = self.header(f)[3]
        return f"id bigint, w array<{'bigint' if kind == '<i8' else 'double'}>"

    def batch(self, ids, values, width):
        offsets = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * width)
        return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(offsets, pa.array(values))], names=["id", "w"])


class PartitionSource(_FixedWidth):
    """``spark.read.format("mepe").load(path)``: (id, part int)."""

    @classmethod
    def name(cls):
        return "mepe"

    def header(self, f):
        head = f.read(12)
        if head[:4] != b"MePe":
            raise FormatError("not a partition file")
        return 12, 1, struct.unpack("<Q", head[4:12])[0], "<u8"

    def schema(self):
        return "id bigint, part int"

    def batch(self, ids, values, width):
        return pa.RecordBatch.from_arrays([ids, pa.array(values.astype(np.int32))], names=["id", "part"])


class _Rows(InputPartition):
    """Rows of a section of a mesh file."""

    def __init__(self, section: meshfile.Section | None, block: int, first: int, done: int, count: int):
        super().__init__((block, first))
        self.section, self.block, self.first, self.done, self.count = section, block, first, done, count


class MeshSource(DataSource):
    """``spark.read.format("meshb").option("table", "nodes").load(path)``: nodes, or elements, of
    a binary MEDIT file, ``records`` rows a task. Only the heads of its sections are read before
    the tasks are known."""

    @classmethod
    def name(cls):
        return "meshb"

    def schema(self):
        return NODES if self.options.get("table", "nodes") == "nodes" else ELEMENTS

    def reader(self, schema):
        return _MeshReader(self.options["path"], self.options.get("table", "nodes") == "nodes", int(self.options.get("records", RECORDS)))


class _MeshReader(DataSourceReader):
    def __init__(self, path: str, nodes: bool, records: int):
        self.path, self.nodes, self.records = path, nodes, records
        with open_file(path) as f:
            self.sections = [s for s in meshfile.sections(f)[1] if s.is_nodes == nodes]

    def partitions(self):
        out, first = [], 0
        for block, s in enumerate(self.sections):
            out += [_Rows(s, block, first + i, i, min(self.records, s.count - i)) for i in range(0, s.count, self.records)]
            first += s.count
        return out or [_Rows(None, 0, 0, 0, 0)]

    def read(self, part):
        if not part.count:
            return
        s = part.section
        with open_file(self.path) as f:
            f.seek(s.start + part.done * s.row.itemsize)
            raw = f.read(part.count * s.row.itemsize)
        if len(raw) < part.count * s.row.itemsize:
            raise FormatError("the file ends early")
        rows = np.frombuffer(raw, s.row)
        ids = pa.array(np.arange(part.first, part.first + part.count, dtype=np.int64))
        refs = pa.array(rows["r"].astype(np.int64))
        width = rows["x"].shape[1]
        offsets = pa.array(np.arange(part.count + 1, dtype=np.int32) * width)
        if self.nodes:
            coords = pa.ListArray.from_arrays(offsets, pa.array(rows["x"].astype(np.float64).ravel()))
            yield pa.RecordBatch.from_arrays([ids, coords, refs], names=["node_id", "coords", "ref"])
        else:
            nodes = pa.ListArray.from_arrays(offsets, pa.array(rows["x"].astype(np.int64).ravel() - 1))
            kind, block = pa.array([s.kind] * part.count), pa.array(np.full(part.count, part.block, np.int32))
            yield pa.RecordBatch.from_arrays([ids, kind, nodes, refs, block], names=["el_id", "type", "nodes", "ref", "block"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MeshSource)
    spark.dataSource.register(WeightSource)
    spark.dataSource.register(PartitionSource)


def write_points(lines: DataFrame, path: str) -> None:
    """(id, line) as text files, in the order of ids."""
    lines.orderBy("id").select("line").write.text(path)


def svg(rings: DataFrame, width: int = 800) -> str:
    """A picture of (blob, ref, rings): a path a blob, grey by ref, y upwards. The rings of a
    drawing come to the driver, which makes one text of them."""
    rows = rings.orderBy("blob").collect()
    points = [p for r in rows for ring in r["rings"] for p in ring]
    if not points:
        return '<svg xmlns="http://www.w3.org/2000/svg" width="0" height="0"></svg>'
    x0, x1 = min(p[0] for p in points), max(p[0] for p in points)
    y0, y1 = min(p[1] for p in points), max(p[1] for p in points)
    scale = width / ((x1 - x0) or 1)
    refs = sorted({r["ref"] for r in rows})
    grey = {v: 255 - (200 * i // max(len(refs) - 1, 1)) for i, v in enumerate(refs)}
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{scale * (y1 - y0):g}">']
    for r in rows:
        d = " ".join("M" + " L".join(f"{scale * (x - x0):g},{scale * (y1 - y):g}" for x, y in ring) + " Z" for ring in r["rings"])
        g = grey[r["ref"]]
        out.append(f'<path d="{d}" fill="rgb({g},{g},{g})" fill-rule="evenodd"/>')
    return "\n".join([*out, "</svg>"])
