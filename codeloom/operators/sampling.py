"""Sampling, splitting and quotas. Every choice is a hash of stable keys, so it holds for any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .tables import prefix_sums


def hash_ranked(df: DataFrame, by: list[str], key: str, seed, out: str = "__r") -> DataFrame:
    """df with its rank from 1 in each group (in all, if `by` is empty), by the hash of key, then by key.

    Rows of one 16-bit prefix of the hash are counted first, so neither a hot group nor the whole
    table meets in one task.
    """
    d = df.withColumn("__o", T.order_key(F.col(key), seed)).withColumn("__p", F.substring("__o", 1, 4))
    n = d.groupBy(*by, "__p").agg(F.count("*").alias("__n"))
    before = n.withColumn("__before", F.sum("__n").over(Window.partitionBy(*by).orderBy("__p")) - F.col("__n"))
    there = before.select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(by)], F.col("__p").alias("__q"), "__before")
    match = F.col("__p") == F.col("__q")
    for i, c in enumerate(by):
        match &= F.col(c).eqNullSafe(F.col(f"__g{i}"))
    rank = F.row_number().over(Window.partitionBy(*by, "__p").orderBy("__o", key))
    return d.withColumn("__in", rank).join(there, match).withColumn(out, F.col("__before") + F.col("__in")).drop("__o", "__p", "__q", "__in", "__before", *[f"__g{i}" for i in range(len(by))])


def holdout_keys(df: DataFrame, key: str, share: float, seed: int, by: list[str] | None = None, rounding: str = "half_even", least: int = 1) -> DataFrame:
    """(by, key): distinct keys held out in each group, by hash order; `least` at least."""
    by = by or []
    keys = df.select(*by, key).distinct()
    n = keys.groupBy(*by).agg(F.count("*").alias("__n"))
    want = F.bround(F.lit(share) * F.col("__n")) if rounding == "half_even" else F.floor(F.lit(share) * F.col("__n"))
    quota = n.select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(by)], F.greatest(F.lit(least), want).alias("__w"))
    ranked = hash_ranked(keys, by, key, seed)
    if not by:
        return ranked.where(F.col("__r") <= quota.select("__w").scalar()).select(key)
    match = F.lit(True)
    for i, c in enumerate(by):
        match &= F.col(c).eqNullSafe(F.col(f"__g{i}"))
    return ranked.join(quota, match).where("__r <= __w").select(*by, key)


def holdout(df: DataFrame, key: str, share: float, seed: int, by: list[str] | None = None, **kw) -> DataFrame:
    """df with `split`: eval for held-out keys, else train. No key is on both sides of a group."""
    held = holdout_keys(df, key, share, seed, by, **kw).withColumn("__e", F.lit(True))
    return df.join(held, [*(by or []), key], "left").withColumn("split", F.when(F.col("__e"), "eval").otherwise("train")).drop("__e")


def threshold_split(df: DataFrame, key: str, share: float) -> DataFrame:
    """df with `split` by the key's hash alone: needs no other row."""
    return df.withColumn("split", F.when(T.unit(F.col(key)) < share, "eval").otherwise("train"))


def overlap(split: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on both sides of a split; empty if all is well."""
    return split.where("split = 'train'").select(*keys).distinct().intersect(split.where("split = 'eval'").select(*keys).distinct())


def capped(df: DataFrame, by: list[str], cap: int | Column, order: list) -> DataFrame:
    """The first `cap` rows of each group, by an order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= cap).drop("__r")


def quotas(df: DataFrame, by: list[str], total: int, least: int = 1) -> DataFrame:
    """(by, n, quota): proportional quotas, rounded half to even."""
    every = df.agg(F.count("*")).scalar()
    return df.groupBy(*by).agg(F.count("*").alias("n")).select(*by, "n", F.greatest(F.lit(least), F.bround(F.lit(total) * F.col("n") / every).cast("int")).alias("quota"))


def by_quota(df: DataFrame, by: list[str], total: int, key: str, seed: int) -> DataFrame:
    """A stratified sample by proportional quotas."""
    return hash_ranked(df, by, key, seed).join(quotas(df, by, total), by).where("__r <= quota").drop("__r", "n", "quota")


def seeded(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows by hash order."""
    return df.orderBy(T.order_key(F.col(key), seed), key).limit(n)


def fill_from(first: DataFrame, rest: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows: all of `first` by hash order, then of `rest`."""
    both = first.withColumn("__p", F.lit(0)).unionByName(rest.withColumn("__p", F.lit(1)))
    return both.orderBy("__p", T.order_key(F.col(key), seed), key).limit(n).drop("__p")


def half(df: DataFrame, key: str, seed: int, order_by: str) -> DataFrame:
    """Half of the rows (rounded down) by hash order, in their own order."""
    order = T.order_key(F.col(key), seed)
    ranked = prefix_sums(df, [order, key], F.lit(1), F.substring(order, 1, 3), "__r")
    return ranked.where(F.col("__r") < F.floor(df.agg(F.count("*")).scalar() / 2)).drop("__r").orderBy(order_by)


def round_robin(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """n rows in rotation over the groups, groups in their own order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__cycle", F.row_number().over(w)).orderBy("__cycle", *by).limit(n).drop("__cycle")


def minority_first(df: DataFrame, by: str, order: list, n: int) -> DataFrame:
    """n rows in rotation over the groups, the smallest group first."""
    size = df.groupBy(by).agg(F.count("*").alias("__size"))
    w = Window.partitionBy(by).orderBy(*order)
    return df.join(size, by).withColumn("__cycle", F.row_number().over(w)).orderBy("__cycle", "__size", by).limit(n).drop("__cycle", "__size")


def owner_capped(df: DataFrame, owner: str, good: Column, order: list, cap: int, total: int) -> DataFrame:
    """Two passes: good rows first, then the rest, `cap` for each owner and `total` in all."""
    ranked = df.withColumn("__pass", F.when(good, 0).otherwise(1))
    w = Window.partitionBy(owner).orderBy("__pass", *order)
    return ranked.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= cap).orderBy("__pass", *order).limit(total).drop("__r").withColumnRenamed("__pass", "pass")


def shard(df: DataFrame, key: str, n: int) -> DataFrame:
    """df with `shard`: the row's rank by a numeric key, modulo n."""
    return prefix_sums(df, [key], F.lit(1), F.floor(F.col(key) / 4096), "__r").withColumn("shard", F.pmod(F.col("__r"), F.lit(n)).cast("int")).drop("__r")


def weighted_choice(key: Column, seed, options: list[tuple[str, float]]) -> Column:
    """One of the options by the key's hash, by weight."""
    u = T.unit(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))
    total, upto, out = sum(w for _, w in options), 0.0, None
    for name, w in options[:-1]:
        upto += w / total
        out = F.when(u < upto, name) if out is None else out.when(u < upto, name)
    return F.lit(options[-1][0]) if out is None else out.otherwise(options[-1][0])


def grid(spark, **axes) -> DataFrame:
    """All combinations of the axes' values."""
    out = spark.range(1).select()
    for name, values in axes.items():
        out = out.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return out


def nested_doses(df: DataFrame, key: str, doses: list[float]) -> DataFrame:
    """df with a mask for each dose; a larger dose includes every smaller one."""
    u = T.unit(F.col(key))
    return df.select("*", *[(u < d).alias(f"dose_{round(d * 100)}") for d in doses])
