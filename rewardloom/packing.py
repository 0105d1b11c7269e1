"""Rows on their way to a partition of a given number, packed.

What a batch of rows has for one partition is one value compressed by Zstandard, so that texts that these rows share are moved about once. Spark's own
shuffle compresses 32 KB at a time, in which long texts don't come twice.
"""

from __future__ import annotations

from pyspark.sql import types as T

#: Zstandard's level for rows on their way; lower ones lose sight of a long text before it comes again.
LEVEL = 2
#: Types whose values are the same after a way through Arrow.
PLAIN = (
    T.BooleanType(), T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType(), T.FloatType(), T.DoubleType(),
    T.StringType(), T.BinaryType(), T.DateType(), T.TimestampType(), T.TimestampNTZType(),
)
PACKED = "bucket int, rows binary"


def packable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return packable(kind.elementType)
    if isinstance(kind, T.MapType):
        return packable(kind.keyType) and packable(kind.valueType)
    if type(kind) is T.StructType:
        return bool(kind.fields) and all(packable(f.dataType) for f in kind.fields)
    return kind in PLAIN or isinstance(kind, T.DecimalType)


def pack(batches):
    """Each batch's rows of a bucket (the first column) as one compressed value."""
    import numpy as np
    import pyarrow as pa

    codec = pa.Codec("zstd", compression_level=LEVEL)
    for batch in batches:
        number = batch.column(0).to_numpy()
        order = np.argsort(number, kind="stable")
        edges = np.flatnonzero(np.diff(number[order], prepend=-1, append=-1))
        rows = pa.RecordBatch.from_arrays(batch.columns[1:], schema=pa.schema(list(batch.schema)[1:])).take(pa.array(order))
        blobs = []
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as out:
                out.write_batch(rows.slice(i, j - i))
            plain = sink.getvalue()
            blobs.append(plain.size.to_bytes(8, "little") + codec.compress(plain, asbytes=True))
        yield pa.RecordBatch.from_arrays([pa.array(number[order][edges[:-1]], pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "rows"])


def unpacked(value):
    """The record batches of one packed value."""
    import pyarrow as pa

    blob = value.as_buffer()
    plain = pa.Codec("zstd", compression_level=LEVEL).decompress(blob.slice(8), int.from_bytes(blob.slice(0, 8).to_pybytes(), "little"))
    yield from pa.ipc.open_stream(plain)
