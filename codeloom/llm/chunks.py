"""Chunks of whole rows: written once in buckets, so that answers travel to texts and texts stay where they are."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

#: Bytes of rows in a chunk, at most about; a longer text is a chunk of its own.
CHUNK_BYTES = 8 << 20


def source(docs: DataFrame, keep: list[str], text: str, **more: Column) -> tuple[DataFrame, list[S.StructField], str]:
    """(rows of columns c0, c1, ... for `keep`, and of `more`; fields of the former; the text's column). A text that is kept is carried once."""
    fields = [S.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(keep)]
    cols = [F.col(c).alias(f.name) for c, f in zip(keep, fields, strict=True)] + [c.alias(n) for n, c in more.items()]
    if text in keep and isinstance(docs.schema[text].dataType, S.StringType):
        return docs.select(*cols), fields, f"c{keep.index(text)}"
    return docs.select(*cols, F.col(text).cast("string").alias("text")), fields, "text"


def gathered(batches, most: int = CHUNK_BYTES):
    """Lists of record batches of about `most` bytes together."""
    parts, size = [], 0
    for b in batches:
        if not len(b):
            continue
        parts.append(b)
        size += b.nbytes
        if size >= most:
            yield parts
            parts, size = [], 0
    if parts:
        yield parts


def name() -> int:
    """A new chunk's name. What is written keeps it; a task that runs again draws another."""
    return uuid.uuid4().int >> 65


def stored(parts) -> bytes:
    """Batches of one schema as compressed Arrow data."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, parts[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        for b in parts:
            w.write_batch(b)
    return sink.getvalue().to_pybytes()


def opened(value):
    """The batches of a stored() value, and the number of rows before each."""
    first = 0
    for b in pa.ipc.open_stream(value.as_buffer()):
        yield first, b
        first += len(b)


def pack(a) -> bytes:
    return pa.compress(np.ascontiguousarray(a).tobytes(), codec="zstd", asbytes=True)


def unpack(raw, kind, n):
    return np.frombuffer(pa.decompress(raw, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


def one_list(values, kind=None) -> pa.ListArray:
    """A column of one row that holds all values."""
    values = values if isinstance(values, pa.Array) else pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
