"""Packing by concatenate and cut.

Pass one encodes every document, ends it with one id, and writes the ids together with the count of
tokens before it in its partition. The partitions' totals, a number for each partition, are summed
up to give each partition's place in the whole; pass two reads the written ids and cuts them at
fixed windows. A document that crosses a window gives a record on either side. No ids are shuffled.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import small_batches, written
from .tokens import shared_spec, worker_ids


def encoded(docs: DataFrame, tokenizer: str, end: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Pass one: (part, before, key, n, ids) with ids as bytes of width bytes each."""
    spark = docs.sparkSession
    small_batches(spark)
    spec, ranked = shared_spec(spark, tokenizer)

    def run(batches):
        coder = worker_ids(spec.value, ranked)
        last, width = np.array([end], coder.dtype).tobytes(), np.dtype(coder.dtype).itemsize
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = [coder.ids(x) + last for x in K.column(batch, "text").to_pylist()]
            n = np.array([len(x) // width for x in ids], np.int64)
            before = total + np.concatenate([[0], np.cumsum(n)])
            total = int(before[-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int64)), pa.array(before[:-1].astype(np.int64)), K.column(batch, "key"), pa.array(n), pa.array(ids, pa.binary())], ["part", "before", "key", "n", "ids"])

    kind = docs.select(F.col(key)).schema[0].dataType.simpleString()
    src = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return src.mapInArrow(run, f"part bigint, before bigint, key {kind}, n bigint, ids binary")


def bases(enc: DataFrame, part: str = "part", total=None) -> DataFrame:
    """(part, base): tokens before each partition. A row for each partition, so one task can sum them."""
    sums = enc.groupBy(part).agg(F.max(F.col("before") + F.col("n")) if total is None else total).toDF(part, "total")
    return sums.select(part, (F.sum("total").over(Window.orderBy(part)) - F.col("total")).alias("base"))


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, end: int = 1, text: str = "text", key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Pieces of documents in sequences of at most `length` tokens; only the last sequence can be short.

    Out, a row for each piece: the key, start (the document's ids before it), length, ids_crc32 (of
    its ids as little-endian unsigned 32-bit integers), doc_tokens (with the end id), sequence_id,
    offset in the sequence, and, with_ids, its ids. Documents follow each other in the order of the
    written ids. Null and empty texts give their end id alone. Rows of equal or null keys are packed
    one by one; other columns are left behind.
    """
    enc = written(encoded(docs, tokenizer, end, text, key), "ids")
    placed = enc.join(F.broadcast(bases(enc)), "part")  # bounded by the number of partitions

    def run(batches):
        for batch in batches:
            cols = [[] for _ in range(8)]
            ids = K.column(batch, "ids")
            keys = []
            at = (K.column(batch, "before").to_numpy() + K.column(batch, "base").to_numpy()).tolist()
            for i, (g, n) in enumerate(zip(at, K.column(batch, "n").to_pylist(), strict=True)):
                raw = ids[i].as_buffer()
                x = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                s = 0
                while s < n:
                    seq, off = divmod(g + s, length)
                    e = min(n, s + length - off)
                    keys.append(i)
                    piece = x[s:e]
                    for c, v in zip(cols, (s, e - s, zlib.crc32(piece), n, seq, off), strict=False):
                        c.append(v)
                    if with_ids:
                        cols[6].append(piece.astype(np.int32))
                    s = e
            out = [K.column(batch, "key").take(pa.array(keys, pa.int64())), *(pa.array(c, pa.int64()) for c in cols[:6])]
            yield pa.RecordBatch.from_arrays([*out, *([pa.array(cols[6], pa.list_(pa.int32()))] if with_ids else [])], names)

    names = ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
    kind = enc.schema["key"].dataType.simpleString()
    out = placed.select("key", "before", "base", "n", "ids").mapInArrow(run, f"key {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids array<int>" * with_ids)
    return out.withColumnRenamed("key", key)
