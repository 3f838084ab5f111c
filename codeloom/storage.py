"""The shared folder: where lineage is cut, so that a lost executor loses nothing."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: What was made and not yet removed: session, folder, and the catalogue's table, if it is one.
_made: list[tuple[SparkSession, str, str | None]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share; a temporary folder only where it is unset, as in tests."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not got:
        got = "file://" + tempfile.mkdtemp(prefix="codeloom-")
        spark.conf.set("spark.checkpoint.dir", got)
    return got.rstrip("/")


def fresh_dir(spark: SparkSession, label: str, table: str | None = None) -> str:
    """A new path in the shared folder, removed when the interpreter ends."""
    path = f"{shared_dir(spark)}/codeloom/{label}-{uuid.uuid4().hex}"
    _made.append((spark, path, table))
    return path


def mark() -> int:
    """A point from which sweep() clears."""
    return len(_made)


def made(since: int) -> list[str]:
    """The folders that were made since a mark and are there yet."""
    return [path for _, path, _ in _made[since:]]


def clear(paths: list[str]) -> None:
    """Remove folders that were made here, and their tables. What belongs to a session that has ended is left to its folder."""
    for m in [m for m in _made if m[1] in set(paths)]:
        spark, path, table = m
        if spark.sparkContext._jsc is not None:
            if table:
                spark.sql(f"DROP TABLE IF EXISTS {table}")
            remove(spark, path)
        _made.remove(m)


def sweep(since: int, *keep: DataFrame) -> None:
    """Remove what was made since a mark but for `keep`: written tables do not depend on one another."""
    stay = {df._codeloom_path for df in keep}
    clear([path for path in made(since) if path not in stay])


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder, read back: cuts lineage, and lost executors lose nothing of it."""
    path = fresh_dir(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._codeloom_path = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    clear([df._codeloom_path for df in frames])


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path, _ in _made:
        try:
            if spark.sparkContext._jsc is not None:
                remove(spark, path)
        except Exception:  # the JVM may have ended before the interpreter does
            pass
