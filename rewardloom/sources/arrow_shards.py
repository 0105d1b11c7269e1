"""Read a dataset saved as a folder of Arrow shards.

The folder holds ``state.json``, which lists the shards (Arrow IPC streams), or
one such folder per split next to ``dataset_dict.json``.

    register(spark)
    spark.read.format("arrow_shards").option("split", "train").load(path)

A shard is read by several tasks: its record batches are found by going from one message header to the next,
without reading their bodies, and runs of batches of about ``partition_bytes`` (128 MiB) are input partitions. A task reads the
shard's schema, the dictionaries before its run, and the run. Going through the headers takes a few small reads a batch, in threads on the driver; for a dataset
of very many shards, let Spark do it once and pass the result:

    write_index(spark, path, index_path, split="train")
    spark.read.format("arrow_shards").option("split", "train").option("index", index_path).load(path)

The folder must be reachable from all executors. Option ``row_id`` names a
column to add that numbers the rows in dataset order from 0 without gaps; the headers have the row counts.
Option ``columns`` (comma-separated) reads only the named columns of the stream.
Columns are matched by name, so shards may order them differently; a shard that
lacks one is an error. A dataset without shards has no schema to read: pass one to
get an empty table.

Filters are not pushed into the reader: Spark 4.1 keeps those of one query for the
next one on the same DataFrame, if that has none to push, and so loses its rows.
"""

from __future__ import annotations

import json
import struct
import sys
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import LongType, StructField, StructType

PARTITION_BYTES = 128 << 20
# Shards whose headers are read at the same time on the driver.
THREADS = 16

# Fixed values of the Arrow IPC format: what precedes a message's length, and the types of its header.
CONTINUATION = 0xFFFFFFFF
SCHEMA, DICTIONARY, RECORDS = 1, 2, 3


def _open(path: str):
    from pyarrow import fs

    filesystem, name = fs.FileSystem.from_uri(path)
    return filesystem.open_input_file(name)


def _read_json(path: str) -> dict:
    with _open(path) as file:
        return json.loads(file.read())


def _exists(path: str) -> bool:
    from pyarrow import fs

    filesystem, name = fs.FileSystem.from_uri(path)
    return filesystem.get_file_info(name).type == fs.FileType.File


def has_splits(path: str) -> bool:
    """Whether the folder holds named splits rather than one table."""
    return _exists(f"{path.rstrip('/')}/dataset_dict.json")


@dataclass(frozen=True)
class Batch:
    """A message of a shard: its type, number of rows (of record batches), and place in the file."""

    kind: int
    rows: int
    start: int
    end: int


def _field(table: bytes, at: int, number: int, kind: str, missing=0):
    """A scalar, or the place of a table, in field ``number`` of the FlatBuffers table at ``at``."""
    vtable = at - struct.unpack_from("<i", table, at)[0]
    size = struct.unpack_from("<H", table, vtable)[0]
    offset = struct.unpack_from("<H", table, vtable + 4 + 2 * number)[0] if 4 + 2 * number < size else 0
    if not offset:
        return missing
    value = struct.unpack_from("<" + kind, table, at + offset)[0]
    return at + offset + value if kind == "I" else value


def message_of(header: bytes) -> tuple[int, int, int]:
    """Type, rows and length of the body of the message with this FlatBuffers header."""
    root = struct.unpack_from("<I", header)[0]
    kind, body = _field(header, root, 1, "B"), _field(header, root, 3, "q")
    rows = _field(header, _field(header, root, 2, "I"), 0, "q") if kind == RECORDS else 0
    return kind, rows, body


def batches_of(path: str) -> list[Batch]:
    """The messages of a shard, by its headers alone."""
    found = []
    with _open(path) as file:
        size, at = file.size(), 0
        while at + 8 <= size:
            file.seek(at)
            mark, length = struct.unpack("<II", file.read(8))
            head = 8
            if mark != CONTINUATION:
                # Streams written before the format's version 0.15 have the length alone.
                length, head = mark, 4
            if not length:
                break
            file.seek(at + head)
            header = file.read(length)
            if len(header) < length:
                raise ValueError(f"{path} ends within a message")
            kind, rows, body = message_of(header)
            end = at + head + length + body
            if end > size:
                raise ValueError(f"{path} ends within a message")
            found.append(Batch(kind, rows, at, end))
            at = end
    if not found or found[0].kind != SCHEMA:
        raise ValueError(f"{path} is not an Arrow stream")
    return found


class Run(InputPartition):
    """Record batches of a shard that one task reads: their bytes, those of schema and dictionaries before them, and the first row's number."""

    def __init__(self, path: str, prefix: list[tuple[int, int]], start: int, end: int, first_row: int, n_batches: int):
        self.path, self.prefix, self.start, self.end = path, prefix, start, end
        self.first_row, self.n_batches = first_row, n_batches


def runs_of(path: str, batches: list[Batch], most: int, first_row: int = 0) -> list[Run]:
    """A shard's runs of neighbouring record batches of about ``most`` bytes, one batch at least."""
    out, prefix, run, row, at = [], [], [], first_row, first_row
    for b in batches:
        if b.kind == RECORDS and run and (b.start != run[-1].end or b.end - run[0].start > most):
            out.append(Run(path, list(prefix), run[0].start, run[-1].end, at, len(run)))
            run, at = [], row
        if b.kind == RECORDS:
            run.append(b)
            row += b.rows
        else:
            if run:
                out.append(Run(path, list(prefix), run[0].start, run[-1].end, at, len(run)))
                run, at = [], row
            prefix.append((b.start, b.end))
    if run:
        out.append(Run(path, list(prefix), run[0].start, run[-1].end, at, len(run)))
    return out


INDEX = "shard int, kind int, rows long, start long, end long"


def write_index(spark: SparkSession, path: str, index_path: str, split: str | None = None) -> DataFrame:
    """Go through the shards' headers, a task for each, and write what was found for option ``index``."""
    shards = ArrowShards({"path": path, **({"split": split} if split else {})}).shards()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for number, shard in zip(batch.column("number").to_pylist(), batch.column("path").to_pylist(), strict=True):
                found = batches_of(shard)
                columns = [[number] * len(found), *([getattr(b, name) for b in found] for name in ("kind", "rows", "start", "end"))]
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["shard", "kind", "rows", "start", "end"])

    rows = spark.createDataFrame(list(enumerate(shards)), "number int, path string")
    rows.repartition(max(1, len(shards)), "number").mapInArrow(run, INDEX).write.parquet(index_path)
    return spark.read.schema(INDEX).parquet(index_path)


class ArrowShards(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arrow_shards"

    def _folder(self) -> str:
        path = self.options["path"].rstrip("/")
        split = self.options.get("split")
        if split is None:
            return path
        splits = _read_json(f"{path}/dataset_dict.json")["splits"]
        if split not in splits:
            raise ValueError(f"no split {split!r} in {path}; it has {', '.join(splits)}")
        return f"{path}/{split}"

    def shards(self) -> list[str]:
        folder = self._folder()
        if not _exists(f"{folder}/state.json"):
            raise ValueError(f"{folder} is not a folder of Arrow shards; is a split missing?")
        files = _read_json(f"{folder}/state.json")["_data_files"]
        return [f"{folder}/{file['filename']}" for file in files]

    def schema(self) -> StructType:
        import pyarrow as pa
        from pyspark.sql.pandas.types import from_arrow_schema

        shards = self.shards()
        if not shards:
            raise ValueError(f"{self._folder()} has no shards; pass a schema to read it as an empty table")
        with _open(shards[0]) as file, pa.ipc.open_stream(file) as stream:
            schema = from_arrow_schema(stream.schema)
        if "columns" in self.options:
            wanted = [name.strip() for name in self.options["columns"].split(",")]
            if missing := [name for name in wanted if name not in schema.names]:
                raise ValueError(f"{self._folder()} has no column {', '.join(missing)}")
            schema = StructType([schema[name] for name in wanted])
        if "row_id" in self.options:
            schema = StructType([StructField(self.options["row_id"], LongType()), *schema.fields])
        return schema

    def reader(self, schema: StructType) -> DataSourceReader:
        most = int(self.options.get("partition_bytes", PARTITION_BYTES))
        return ShardReader(self.shards(), self.options.get("row_id"), schema, most, self.options.get("index"))


def _indexed(path: str, n_shards: int) -> list[list[Batch]]:
    """Messages by shard from a written index."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    filesystem, name = fs.FileSystem.from_uri(path)
    table = ds.dataset(name, filesystem=filesystem, format="parquet").to_table()
    out: list[list[Batch]] = [[] for _ in range(n_shards)]
    for r in sorted(table.to_pylist(), key=lambda r: (r["shard"], r["start"])):
        if r["shard"] >= n_shards:
            raise ValueError(f"{path} is the index of another dataset")
        out[r["shard"]].append(Batch(r["kind"], r["rows"], r["start"], r["end"]))
    if missing := [i for i, found in enumerate(out) if not found]:
        raise ValueError(f"{path} has no batches of shard {missing[0]}")
    return out


def _head(file, place: tuple[int, int]) -> bytes:
    file.seek(place[0])
    return file.read(place[1] - place[0])


class _Parts:
    """Parts of a file, one after another, as a file to read from."""

    closed = False

    def __init__(self, file, parts: list[tuple[int, int]]):
        self._file, self._parts, self._at = file, list(parts), None

    def read(self, n: int = -1) -> bytes:
        out = []
        while self._parts and n != 0:
            start, end = self._parts[0]
            at = start if self._at is None else self._at
            self._file.seek(at)
            found = self._file.read(end - at if n < 0 else min(n, end - at))
            if not found:
                break
            out.append(found)
            n = n - len(found) if n > 0 else n
            self._at = at + len(found)
            if self._at == end:
                self._at = None
                self._parts.pop(0)
        return out[0] if len(out) == 1 else b"".join(out)

    def close(self) -> None:
        self.closed = True


class ShardReader(DataSourceReader):
    def __init__(self, shards: list[str], row_id: str | None, schema: StructType, most: int, index: str | None):
        self._shards = shards
        self._row_id = row_id
        self._schema = schema
        self._most = most
        self._index = index

    def partitions(self) -> list[Run]:
        if self._index:
            found = _indexed(self._index, len(self._shards))
        else:
            with ThreadPoolExecutor(THREADS) as pool:
                found = list(pool.map(batches_of, self._shards))
        out, row = [], 0
        for path, batches in zip(self._shards, found, strict=True):
            out += runs_of(path, batches, self._most, row)
            row += sum(b.rows for b in batches if b.kind == RECORDS)
        return out

    def read(self, partition: Run | None) -> Iterator:
        # Spark reads a list of no partitions as one that is None.
        if partition is None:
            return
        import numpy as np
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(self._schema)
        row = partition.first_row
        # The messages of a run are read one at a time, as they are decoded.
        with _open(partition.path) as file, pa.PythonFile(_Parts(file, [*partition.prefix, (partition.start, partition.end)]), "r") as parts:
            names = pa.ipc.read_schema(pa.py_buffer(_head(file, partition.prefix[0]))).names
            wanted = [i for i, name in enumerate(names) if name in target.names and name != self._row_id]
            # Other columns are neither decoded nor decompressed; without any, batches would have no rows.
            options = pa.ipc.IpcReadOptions(included_fields=wanted or [0])
            stream = pa.ipc.open_stream(parts, options=options)
            for batch in stream:
                arrays = []
                for field in target:
                    if field.name == self._row_id:
                        arrays.append(pa.array(np.arange(row, row + batch.num_rows)))
                    elif field.name in batch.schema.names:
                        arrays.append(batch.column(field.name).cast(field.type))
                    else:
                        raise ValueError(f"{partition.path} has no column {field.name!r}")
                row += batch.num_rows
                yield pa.RecordBatch.from_arrays(arrays, schema=target)


def register(spark: SparkSession) -> None:
    """Make the format ``arrow_shards`` available to ``spark.read``."""
    from pyspark import cloudpickle

    # Ships the reader with the plan, so that workers need no installed package.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(ArrowShards)
