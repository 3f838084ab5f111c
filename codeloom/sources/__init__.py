"""Readers and writers: explicit schemas, damaged lines counted, resumable sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import pending


def jsonl(spark: SparkSession, paths, schema: str) -> DataFrame:
    """JSON lines by an explicit schema; a damaged line has its text in `_corrupt` and nulls elsewhere."""
    return spark.read.schema(f"{schema}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(paths)


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of the paths that exist, in any store Spark reads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            found.append(p)
    return found


def union_of(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Rows of all files that exist, with `file`."""
    got = existing(spark, paths)
    out = jsonl(spark, got, schema) if got else spark.createDataFrame([], f"{schema}, _corrupt string")
    return out.withColumn("file", F.input_file_name() if got else F.lit(None).cast("string"))


def text_column(df: DataFrame, candidates: list[str]) -> Column:
    """The candidates that the table has, joined by blanks."""
    there = [c for c in candidates if c in df.columns]
    return F.concat_ws(" ", *there) if there else F.lit(None).cast("string")


def files(spark: SparkSession, path: str, most: int = 2_000_000) -> DataFrame:
    """(path, rel parts, bytes) of a tree of files: binary files by the data source, sizes capped."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.col("length") <= most)


def is_text(content: Column, path: Column, endings: list[str], least: int = 64) -> Column:
    """Whether a file is text: a known ending, no zero byte in its first 4096, and long enough."""
    head = F.hex(F.substring(content, 1, 4096))
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1)).isin(*endings) & ~head.rlike("^(..)*00") & (F.octet_length(content) >= least)


def members(spark: SparkSession, path: str, pattern: str = r"\.[Rr]$") -> DataFrame:
    """(archive, member, content) of files in tar archives, opened on the executors."""
    import io
    import re
    import tarfile

    import pandas as pd

    def run(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                with tarfile.open(fileobj=io.BytesIO(content)) as t:
                    for m in t:
                        if m.isfile() and re.search(pattern, m.name):
                            yield pd.DataFrame({"archive": [name], "member": [m.name], "content": [t.extractfile(m).read().decode("utf-8", "replace")]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, member string, content string")


def dcf(text: Column) -> Column:
    """A map of a record's fields; lines that begin with white space go on with the field before."""
    unfolded = F.regexp_replace(text, "\n[ \t]+", " ")
    pairs = F.filter(F.transform(F.split(unfolded, "\n"), lambda x: F.regexp_extract(x, r"^([A-Za-z0-9/_.@-]+):[ \t]*(.*)$", 0)), lambda x: x != "")
    entry = lambda x: F.struct(F.regexp_extract(x, r"^([^:]+):", 1).alias("key"), F.regexp_extract(x, r"^[^:]+:[ \t]*(.*)$", 1).alias("value"))
    return F.map_from_entries(F.transform(pairs, entry))


def records(text: Column) -> Column:
    """Records of an index file, cut at blank lines."""
    return F.filter(F.split(text, r"\n\s*\n"), lambda x: F.trim(x) != "")


def ranking(spark: SparkSession, path: str) -> DataFrame:
    """(count, name) of lines `count name`; other lines go."""
    t = spark.read.text(path)
    return t.where(F.col("value").rlike(r"^\s*\d+\s+\S+\s*$")).select(F.regexp_extract("value", r"(\d+)", 1).cast("bigint").alias("count"), F.regexp_extract("value", r"\d+\s+(\S+)", 1).alias("name"))


def write_split(df: DataFrame, path: str) -> None:
    """JSON lines in a folder for each split."""
    df.write.mode("overwrite").partitionBy("split").json(path)


def write_shards(df: DataFrame, path: str, by: str, most: int = 100_000) -> None:
    """Parquet in a folder for each key, files of bounded rows; only the folders of these keys are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", most).partitionBy(by).parquet(path)


def append(df: DataFrame, path: str) -> None:
    """Rows onto an append-only ledger; read it with operators.dedup.latest."""
    df.write.mode("append").parquet(path)


def resume(df: DataFrame, path: str, key: str) -> DataFrame:
    """What a ledger does not have yet."""
    spark = df.sparkSession
    return pending(df, spark.read.parquet(path), key) if existing(spark, [path]) else df


def drop_partition(spark: SparkSession, path: str, by: str, value: str) -> None:
    """Take one key's folder down."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{by}={value}")
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def changed(now: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    """Files whose path, size and time are not as before: what an incremental push sends."""
    return now.join(before.select(*keys), keys, "left_anti")


PACKAGE_PATH = r"/([^/]+)/([^/]+)/(?:[^/]+/)?((?:R|src|man|inst|vignettes|data-raw|tests)/.*|DESCRIPTION|NAMESPACE|NEWS[^/]*|LICEN[SC]E[^/]*)$"


def package_files(spark: SparkSession, path: str, endings: list[str], most_bytes: int = 400_000, per_package: int | None = None, newest: bool = False, seed: int = 0) -> DataFrame:
    """(package, version, rel, source) of a store laid out as package/version/[package/]file: text files of given endings and bounded size.

    With per_package, that many files of each package by hash order; with newest, only its highest version.
    """
    from ..operators.sampling import hash_ranked
    from ..operators.tables import highest_version

    f = files(spark, path, most_bytes).where(F.col("path").rlike(PACKAGE_PATH))
    part = lambda i: F.regexp_extract("path", PACKAGE_PATH, i)
    rows = f.where(is_text(F.col("content"), F.col("path"), endings, 1)).select(part(1).alias("package"), part(2).alias("version"), part(3).alias("rel"), F.decode("content", "UTF-8").alias("source"))
    if newest:
        rows = rows.join(highest_version(rows.select("package", "version").distinct(), "package", "version"), ["package", "version"], "left_semi")
    if per_package is None:
        return rows
    keyed = rows.withColumn("__key", F.concat_ws("/", "package", "version", "rel"))
    return hash_ranked(keyed, ["package"], "__key", seed).where(F.col("__r") <= per_package).drop("__r", "__key")


def cached(df: DataFrame, folder: str, **params) -> DataFrame:
    """df as a table named by a hash of its parameters: made once, read after that. A table counts only with its success mark."""
    import hashlib
    import json

    name = hashlib.sha1(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:16]
    path = f"{folder.rstrip('/')}/scan-{name}"
    spark = df.sparkSession
    if not existing(spark, [f"{path}/_SUCCESS"]):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def log_counts(spark: SparkSession, path: str, column: str = "package") -> DataFrame:
    """(count, name) of a compressed CSV log with a header, most first, then by name; blank names go."""
    rows = spark.read.option("header", True).csv(path).select(F.trim(column).alias("name")).where("name <> ''")
    return rows.groupBy("name").agg(F.count("*").alias("count")).select("count", "name").orderBy(F.desc("count"), "name")


def repository_mapping(spark: SparkSession, path: str, order: str = "file") -> DataFrame:
    """(package, slug) from files that hold a JSON array of (package, url): repository addresses only, no mirror accounts, the first file's entry of each package."""
    from ..operators.dedup import keep_first

    rows = spark.read.schema("package string, url string").option("multiLine", True).option("mode", "DROPMALFORMED").json(path).withColumn("file", F.input_file_name())
    parts = F.split(F.regexp_replace(F.regexp_replace(F.trim("url"), "^https://github.com/", ""), "^/+|/+$", ""), "/")
    bad = F.exists(F.slice(parts, 3, 2), lambda x: F.lower(x).isin("issues", "pull", "tree", "blob", "releases"))
    good = rows.where(F.trim("url").startswith("https://github.com/") & (F.trim("package") != "")).withColumn("p", parts).where((F.size("p") >= 2) & ~bad & (F.lower(F.col("p")[0]) != "cran"))
    return keep_first(good.select(F.trim("package").alias("package"), F.concat_ws("/", F.col("p")[0], F.col("p")[1]).alias("slug"), "file"), ["package"], [order, "slug"]).select("package", "slug")


def token_blocks(spark: SparkSession, path: str, size: int, dtype: str = "<u2") -> DataFrame:
    """(block, toks) of files of raw token ids: blocks of size + 1 ids, the last repeated as the next one's first; files come in the order of
    their names, and each is cut where it ends. A file's blocks are read by ranges of its bytes."""
    import numpy as np
    import pandas as pd

    def run(batches):
        width = np.dtype(dtype).itemsize
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                ids = np.frombuffer(content[: len(content) // width * width], dtype)
                n = max(0, (len(ids) - 1) // size)
                for at in range(0, n, 256):
                    some = range(at, min(at + 256, n))
                    yield pd.DataFrame({"path": name, "at": list(some), "toks": [ids[k * size : k * size + size + 1].astype(np.int32).tolist() for k in some]})

    b = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, at long, toks array<int>")
    from ..operators.tables import prefix_sums

    sizes = b.groupBy("path").agg(F.count("*").alias("n"))
    first = prefix_sums(sizes, ["path"], F.col("n"), F.col("path"), "before").select("path", "before")
    return b.join(first, "path").select((F.col("before") + F.col("at")).alias("block"), "toks")


def replace_verified(df: DataFrame, path: str, check) -> int:
    """Write df beside a table, hold what was written against `check` (rows -> whether they are fine), and only then put it in its place.

    The old table goes aside first and comes back if the move fails. Gives the number of rows.
    """
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(conf)
    new, old = f"{path.rstrip('/')}.new", f"{path.rstrip('/')}.old"
    df.write.mode("overwrite").parquet(new)
    back = spark.read.parquet(new)
    n = back.count()
    if back.schema.simpleString() != df.schema.simpleString() or not check(back):
        fs.delete(at(new), True)
        raise ValueError(f"{path}: what was written does not pass")
    fs.delete(at(old), True)
    had = fs.exists(at(path))
    if had and not fs.rename(at(path), at(old)):
        raise OSError(f"{path} can't be moved aside")
    if not fs.rename(at(new), at(path)):
        if had:
            fs.rename(at(old), at(path))
        raise OSError(f"{new} can't take its place")
    fs.delete(at(old), True)
    return n


def layout(rows: DataFrame, family: str, source: str) -> DataFrame:
    """rows with `dest`, where a hub keeps them: data/<family>/<source>.jsonl, and how many rows each place gets."""
    clean = lambda c: F.regexp_replace(F.lower(F.col(c)), "[^a-z0-9._-]+", "-")
    dest = rows.withColumn("dest", F.concat(F.lit("data/"), clean(family), F.lit("/"), clean(source), F.lit(".jsonl")))
    return dest.groupBy("dest").agg(F.count("*").alias("n"))


def license_members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, content): license texts at an archive's second level."""
    return members(spark, path, r"^[^/]+/LICEN[SC]E[^/]*$")
