"""Incremental forms: appended files consumed once, deduplication by seen keys, gap-based grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files: int | None = None) -> DataFrame:
    """Files of a folder as they come."""
    r = spark.readStream.schema(schema)
    if files:
        r = r.option("maxFilesPerTrigger", files)
    return r.format(fmt).load(path)


def seen_once(df: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """The first row of each key; state is kept only as long as late rows may come."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def windows(df: DataFrame, ts: str, delay: str, width: str, slide: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Counts in tumbling or sliding windows."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).groupBy(w.alias("w"), *(by or [])).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *(by or []), "n")


def sessions(df: DataFrame, ts: str, delay: str, gap: str, by: str) -> DataFrame:
    """Sessions by gap: the debounce of edit events."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def drain(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Consume what is there, write it and stop; a restart goes on where this ended."""
    df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).format("parquet").option("path", path).trigger(availableNow=True).start().awaitTermination()


def accept_once(df: DataFrame, path: str, checkpoint: str, key: str, order: str) -> None:
    """Append rows whose key the sink does not hold yet, the first of each key in a batch."""
    from ..operators.dedup import keep_first
    from ..sources import resume

    def batch(rows, _):
        resume(keep_first(rows, [key], [order]), path, key).write.mode("append").parquet(path)

    df.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
