"""Token-id output as shuffled planes.

A data set is a Parquet table of segments, so that any store Spark writes to can hold it and a lost
task is simply written again. Rows are in ascending key order: shard, then segment. A segment holds
whole documents: their keys and lengths, its ids cut into blocks of fixed size, and a payload. Each
block is transposed into byte planes (all lowest bytes, then all next ones) or bit planes, each
plane is compressed with zstandard, and the chunk index gives each plane's end in the payload.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import small_batches, written
from .packing import bases
from .tokens import shared_spec, worker_ids

BLOCK, SEGMENT = 1 << 16, 1 << 19


def shuffle(ids, width: int, planes: str = "byte", block: int = BLOCK, level: int = 3) -> tuple[bytes, list[int]]:
    """(payload, chunk index) of an array of ids that fit into `width` bytes."""
    z = zstandard.ZstdCompressor(level=level)
    x = np.ascontiguousarray(ids, f"<u{width}")
    out, index, total = [], [], 0
    for at in range(0, len(x), block):
        b = x[at : at + block].view(np.uint8).reshape(-1, width)
        if planes == "bit":
            bits = np.unpackbits(b, axis=1, bitorder="little")
            rows = [np.packbits(bits[:, i], bitorder="little") for i in range(8 * width)]
        else:
            rows = [np.ascontiguousarray(b[:, i]) for i in range(width)]
        for r in rows:
            out.append(z.compress(r.tobytes()))
            total += len(out[-1])
            index.append(total)
    return b"".join(out), index


def unshuffle(payload: bytes, index: list[int], n: int, width: int, planes: str = "byte", block: int = BLOCK):
    """The ids again."""
    z = zstandard.ZstdDecompressor()
    out = np.empty(n, f"<u{width}")
    each, ends = width * (8 if planes == "bit" else 1), [0, *index]
    for k, at in enumerate(range(0, n, block)):
        size = min(block, n - at)
        rows = [np.frombuffer(z.decompress(payload[ends[k * each + i] : ends[k * each + i + 1]]), np.uint8) for i in range(each)]
        if planes == "bit":
            bits = np.stack([np.unpackbits(r, count=size, bitorder="little") for r in rows], 1)
            b = np.packbits(bits, axis=1, bitorder="little")
        else:
            b = np.stack(rows, 1)
        out[at : at + size] = np.ascontiguousarray(b).view(f"<u{width}")[:, 0]
    return out


SEGMENTS = "shard bigint, segment bigint, before bigint, n bigint, width int, planes string, keys array<bigint>, lengths array<int>, chunks array<bigint>, payload binary"


def segments(docs: DataFrame, tokenizer: str, end: int = 0, text: str = "text", key: str = "doc_id", planes: str = "byte") -> DataFrame:
    """Encode documents in ascending key order into segments; null texts count as empty, nulls sort first."""
    spark = docs.sparkSession
    small_batches(spark)
    spec, ranked = shared_spec(spark, tokenizer)

    def run(batches):
        coder = worker_ids(spec.value, ranked)
        width = np.dtype(coder.dtype).itemsize
        last = np.array([end], coder.dtype).tobytes()
        shard, seg, before = TaskContext.get().partitionId(), 0, 0
        keys, sizes, held, n = [], [], [], 0

        def row():
            payload, index = shuffle(np.frombuffer(b"".join(held), coder.dtype), width, planes)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([seg], pa.int64()), pa.array([before], pa.int64()), pa.array([n], pa.int64()), pa.array([width], pa.int32()), pa.array([planes]), pa.array([keys], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())), pa.array([index], pa.list_(pa.int64())), pa.array([payload], pa.binary())], ["shard", "segment", "before", "n", "width", "planes", "keys", "lengths", "chunks", "payload"])

        for batch in batches:
            for k, x in zip(K.column(batch, "key").to_pylist(), K.column(batch, "text").to_pylist(), strict=True):
                ids = coder.ids(x) + last
                keys.append(k)
                sizes.append(len(ids) // width)
                held.append(ids)
                n += sizes[-1]
                if n >= SEGMENT:
                    yield row()
                    seg, before = seg + 1, before + n
                    keys, sizes, held, n = [], [], [], 0
        if keys:
            yield row()

    src = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    dealt = src.withColumn("h", F.xxhash64("text")).repartitionByRange("key", "h").sortWithinPartitions("key", "h").drop("h")  # rows of one key may lie in several ranges
    return dealt.mapInArrow(run, SEGMENTS)


def documents(segs: DataFrame, with_ids: bool = False) -> DataFrame:
    """Read segments back: (key, start, n_tokens, ids_crc32), and ids if asked for; start counts all ids before."""
    place = segs.join(F.broadcast(bases(segs, "shard")), "shard")  # bounded by the number of partitions

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids = unshuffle(r["payload"], r["chunks"], r["n"], r["width"], r["planes"]).astype("<u4")
                size = np.array(r["lengths"], np.int64)
                ends = np.cumsum(size)
                parts = [ids[e - s : e] for s, e in zip(size.tolist(), ends.tolist(), strict=True)]
                cols = [pa.array(r["keys"], pa.int64()), pa.array(ends - size + r["before"] + r["base"]), pa.array(size), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                yield pa.RecordBatch.from_arrays([*cols, *([pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32()))] if with_ids else [])], ["key", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    cols = ["before", "base", "n", "width", "planes", "keys", "lengths", "chunks", "payload"]
    return place.select(*cols).mapInArrow(run, "key bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)


def round_trip(docs: DataFrame, tokenizer: str, end: int = 0, text: str = "text", key: str = "doc_id", planes: str = "byte") -> DataFrame:
    """Write the documents' ids as segments to the shared folder, read them back and digest them.

    Rows of equal keys follow each other, ordered by a hash of their texts; null keys come first.
    Other columns are left behind.
    """
    segs = written(segments(docs, tokenizer, end, text, key, planes), "planes")
    return documents(segs).withColumnRenamed("key", key)
