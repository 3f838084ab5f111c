"""Shared plumbing: tables, the shared folder, lineage cuts and connected components."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import clear, dropped, fresh_dir, made, mark, sweep, written  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, by a path that any Spark reader can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": "8m", "spark.sql.execution.arrow.maxRecordsPerBatch": "5000"}


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch may hold; long texts would otherwise fill a worker's memory.

    Plans that are not run yet take the setting when they run, so it stays; bounded_batches() gives it back.
    """
    for k, v in _BATCH.items():
        spark.conf.set(k, v)


@contextlib.contextmanager
def bounded_batches(spark: SparkSession):
    """small_batches for what runs inside; the caller's settings afterwards."""
    old = {k: spark.conf.get(k, None) for k in _BATCH}
    small_batches(spark)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def bucketed(df: DataFrame, key: str, buckets: int, label: str) -> DataFrame:
    """written() in buckets by key: joins on it move only the other side."""
    name = f"codeloom_{label}_{uuid.uuid4().hex}"
    df.write.format("parquet").option("compression", "zstd").option("path", fresh_dir(df.sparkSession, label, name)).bucketBy(buckets, key).saveAsTable(name)
    return df.sparkSession.table(name)


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Connected components of edges (a, b) of longs: (id, component), component the smallest id reachable.

    Alternates large-star and small-star rounds, each written to the shared folder; every node ends
    linked to its smallest id. Nothing goes to the driver but a count and a checksum for each round.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e = written(e, "edges")
    state = None
    for _ in range(max_rounds):
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("s")).select("s.*").where("a <> b").distinct()
        new = written(small, "edges")
        row = new.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        dropped(e)
        e = new
        if tuple(row) == state:
            break
        state = tuple(row)
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).union(e.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()
