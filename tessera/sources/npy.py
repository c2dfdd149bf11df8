"""NumPy's .npy files as a Spark source and sink.

A file, or a folder of part files in the order of their names, is a table of row (the place along the first axis) and px (the rest,
flat). The schema and the partitions come from the headers alone; a partition is a range of rows and reads its bytes only. Filters on
row reach the reader where `spark.sql.python.filterPushdown.enabled` is set; read_npy() has the range as arguments.

Paths are what Arrow's file systems know: local and shared folders, hdfs, s3, gs.
"""

from __future__ import annotations

import ast
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import ArrayType, LongType, StructField, StructType
from pyspark.sql.pandas.types import from_arrow_type, to_arrow_type

MAGIC = b"\x93NUMPY"
#: Bytes of a partition, unless the option partition_bytes says otherwise; bytes of an Arrow batch.
PARTITION, BATCH = 1 << 27, 1 << 22


def located(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


@dataclass(frozen=True)
class Header:
    """Of one file: where its data begins, the type, the number of rows and the shape of one."""

    start: int
    dtype: str
    rows: int
    shape: tuple[int, ...]

    @property
    def row_bytes(self) -> int:
        return int(np.dtype(self.dtype).itemsize * np.prod(self.shape, dtype=np.int64))


def header(path: str) -> Header:
    """Read from the file's first bytes."""
    system, name = located(path)
    with system.open_input_stream(name) as f:
        begin = f.read(8)
        if begin[:6] != MAGIC:
            raise ValueError(f"{path} is not a .npy file")
        wide = 2 if begin[6] == 1 else 4
        size = int.from_bytes(f.read(wide), "little")
        told = ast.literal_eval(f.read(size).decode("latin1" if begin[6] < 3 else "utf8"))
    kind = np.dtype(told["descr"])
    if told["fortran_order"] and len(told["shape"]) > 1:
        raise ValueError(f"{path} is in Fortran order")
    if kind.kind not in "iufb" or not told["shape"]:
        raise ValueError(f"{path} has no rows of numbers")
    return Header(8 + wide + size, told["descr"], told["shape"][0], tuple(told["shape"][1:]))


def files(path: str) -> list[str]:
    """The file, or the folder's .npy files by name."""
    system, name = located(path)
    if system.get_file_info(name).type != fs.FileType.Directory:
        return [path]
    found = sorted(x.base_name for x in system.get_file_info(fs.FileSelector(name)) if x.base_name.endswith(".npy"))
    if not found:
        raise FileNotFoundError(f"no .npy file in {path}")
    return [f"{path.rstrip('/')}/{x}" for x in found]


def schema_of(path: str) -> StructType:
    kind = np.dtype(header(files(path)[0]).dtype)
    return StructType([StructField("row", LongType(), False), StructField("px", ArrayType(from_arrow_type(arrow_type(kind)), False), False)])


def arrow_type(kind: np.dtype) -> pa.DataType:
    """Spark has no unsigned and no half-precision numbers: the next wider type takes their place."""
    wider = {"u1": "i2", "u2": "i4", "u4": "i8", "u8": "f8", "f2": "f4"}
    return pa.from_numpy_dtype(np.dtype(wider.get(kind.str[1:], kind.str[1:])))


@dataclass
class Rows(InputPartition):
    """Rows first .. first + n - 1 of one file, of which the first has the number `number` in the table."""

    path: str
    head: Header
    first: int
    n: int
    number: int

    def __init__(self, path: str, head: Header, first: int, n: int, number: int):
        super().__init__((path, first))
        self.path, self.head, self.first, self.n, self.number = path, head, first, n, number


class NpyReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.schema = options["path"], schema
        self.low, self.high = int(options.get("low", 0)), int(options["high"]) if options.get("high") else None
        self.size = int(options.get("partition_bytes", PARTITION))

    def partitions(self):
        out, number = [], 0
        for path in files(self.path):
            head = header(path)
            low, high = max(self.low - number, 0), head.rows if self.high is None else min(head.rows, self.high - number)
            step = max(1, self.size // max(head.row_bytes, 1))
            out += [Rows(path, head, a, min(step, high - a), number + a) for a in range(low, high, step)]
            number += head.rows
        return out or [Rows("", Header(0, "<f4", 0, ()), 0, 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if not partition.n:
            return
        head, kind = partition.head, np.dtype(partition.head.dtype)
        width, step = int(np.prod(head.shape, dtype=np.int64)), max(1, BATCH // max(head.row_bytes, 1))
        element = to_arrow_type(self.schema["px"].dataType.elementType)
        system, name = located(partition.path)
        with system.open_input_file(name) as f:
            for a in range(0, partition.n, step):
                n = min(step, partition.n - a)
                data = f.read_at(n * head.row_bytes, head.start + (partition.first + a) * head.row_bytes)
                if len(data) < n * head.row_bytes:
                    raise EOFError(f"{partition.path} ends before row {partition.first + a + n}")
                x = np.frombuffer(data, kind).astype(element.to_pandas_dtype())
                px = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(x, element))
                yield pa.RecordBatch.from_arrays([pa.array(partition.number + a + np.arange(n)), px], ["row", "px"])


class PushedNpyReader(NpyReader):
    """Takes filters on row; Spark refuses such readers where the setting is off."""

    def pushFilters(self, filters):
        for f in filters:
            if getattr(f, "attribute", None) == ("row",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                v = int(f.value)
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, v + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    top = v + (not isinstance(f, LessThan))
                    self.high = top if self.high is None else min(self.high, top)
            else:
                yield f


@dataclass
class Part(WriterCommitMessage):
    name: str


class NpyWriter(DataSourceArrowWriter):
    """Each task's rows become one part; parts are moved in place when all are written."""

    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.shape, self.dtype = ast.literal_eval(options["shape"]), options["dtype"]
        self.own = f"{self.path}/_writing-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        from pyspark import TaskContext

        parts, width, wanted = [], int(np.prod(self.shape, dtype=np.int64)), np.dtype(self.dtype)
        for batch in batches:
            px = batch.column("px")
            if px.null_count or (len(px) and (np.diff(px.offsets.to_numpy()) != width).any()):
                raise ValueError(f"an image has not {width} pixels")
            parts.append(px.flatten().to_numpy(zero_copy_only=False).astype(wanted))
        if not sum(map(len, parts)):
            return Part("")
        whole = np.concatenate(parts).reshape(-1, *self.shape)
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}.npy"
        system, folder = located(self.own)
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{folder}/{task.attemptNumber()}-{name}") as f:
            np.lib.format.write_array_header_1_0(f, np.lib.format.header_data_from_array_1_0(whole))
            f.write(whole.tobytes())
        return Part(f"{task.attemptNumber()}-{name}")

    def commit(self, messages) -> None:
        system, folder = located(self.path)
        system.create_dir(folder, recursive=True)
        if self.overwrite:
            for old in system.get_file_info(fs.FileSelector(folder)):
                if old.base_name.endswith(".npy"):
                    system.delete_file(old.path)
        _, own = located(self.own)
        for m in messages:
            if m and m.name:
                system.move(f"{own}/{m.name}", f"{folder}/{m.name.split('-', 1)[1]}")
        self.clear()

    def abort(self, messages) -> None:
        self.clear()

    def clear(self) -> None:
        system, own = located(self.own)
        if system.get_file_info(own).type == fs.FileType.Directory:
            system.delete_dir(own)


class Npy(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> StructType:
        return schema_of(self.options["path"])

    def reader(self, schema: StructType) -> NpyReader:
        kind = PushedNpyReader if self.options.get("pushdown") == "true" else NpyReader
        return kind(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> NpyWriter:
        return NpyWriter(dict(self.options), schema, overwrite)


def read_npy(spark: SparkSession, path: str, low: int = 0, high: int | None = None, partition_bytes: int = PARTITION) -> DataFrame:
    """row, px of rows low .. high - 1; other rows' bytes aren't read."""
    spark.dataSource.register(Npy)
    options = {"path": path, "low": str(low), "partition_bytes": str(partition_bytes), "pushdown": spark.conf.get("spark.sql.python.filterPushdown.enabled")} | ({} if high is None else {"high": str(high)})
    return spark.read.format("npy").options(**options).load()


def write_npy(df: DataFrame, path: str, shape: tuple[int, ...], dtype: str = "<f4", key: str = "row", px: str = "px", rows_per_file: int = 0) -> None:
    """The images (px: flat, of this shape) in the order of the key, as a folder of .npy parts; a part is a task's rows.

    rows_per_file: about so many in a part; 0 leaves it to Spark. What was there is replaced. Without a row nothing is written.
    """
    df.sparkSession.dataSource.register(Npy)
    parts = -(-df.count() // rows_per_file) if rows_per_file else 0
    rows = df.select(F.col(key).alias("row"), F.col(px).alias("px"))
    rows = (rows.repartitionByRange(max(1, parts), "row") if parts else rows.repartitionByRange("row")).sortWithinPartitions("row")
    rows.select("px").write.format("npy").mode("overwrite").options(path=path, shape=repr(tuple(shape)), dtype=dtype).save()
