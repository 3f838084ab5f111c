"""Order statistics under the conventions in use, and intervals. None of them interpolates but the median."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Index from 0 into the ascending list of n values, for the share p.
CONVENTIONS = {
    "nearest": lambda n, p: F.least(n - 1, F.bround(F.lit(p) * (n - 1)).cast("bigint")),
    "floor": lambda n, p: F.least(n - 1, F.floor(F.lit(p) * n)),
    "upper_median": lambda n, p: F.floor(n / 2),
    "below": lambda n, p: F.greatest(F.lit(0).cast("bigint"), F.floor(F.lit(p) * n) - 1),
    "max": lambda n, p: n - 1,
}


def order_stats(df: DataFrame, by: list[str], value: str, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """One row for each group with its order statistics: name -> (convention, share).

    Values are counted first, so that a large group is as many rows as it has distinct values.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*by)
    upto = counts.withColumn("__upto", F.sum("__n").over(w.orderBy(value))).withColumn("__all", F.sum("__n").over(w))
    picks = [F.min(F.when(F.col("__upto") > CONVENTIONS[how](F.col("__all"), p), F.col(value))).alias(name) for name, (how, p) in wanted.items()]
    return upto.groupBy(*by).agg(*picks)


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson's score interval; (0, 0) for no trials."""
    p = hits / n
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    none = n == 0
    return F.when(none, 0.0).otherwise(F.greatest(F.lit(0.0), mid - half)), F.when(none, 0.0).otherwise(F.least(F.lit(1.0), mid + half))


def round_means(df: DataFrame, by: list[str], value: str, rounds: int, seed: int) -> DataFrame:
    """(g, round, mean): the mean of each group in each resample; g is the group as JSON, '' without groups.

    A Poisson bootstrap: instead of n drawn indices a row has a Poisson(1) count in each round, so no
    group needs to be in one place. Equal values are counted first; n of them have a Poisson(n) count,
    drawn from the group's and the value's hash. A task keeps running sums of all rounds for each of
    its groups, and only those are added up. Null values take no part.
    """
    names = [f"g{i}" for i in range(len(by))]
    counts = df.where(F.col(value).isNotNull()).groupBy(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)], F.col(value).cast("double").alias("x")).agg(F.count("*").alias("n"))
    seeded = counts.select(_group(names), "x", "n", F.xxhash64(*names, "x", F.lit(seed)).alias("h"))

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for one, x, n, h in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                w = np.random.default_rng(h & 0xFFFFFFFFFFFFFFFF).poisson(n, rounds)
                sums.setdefault(one, np.zeros((2, rounds)))[:] += (w * x, w)
            if len(sums) > 1000:
                yield partial(sums)
                sums = {}
        yield partial(sums)

    def partial(sums):
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), *(pa.array([v[i].tolist() for v in sums.values()], pa.list_(pa.float64())) for i in (0, 1))], ["g", "s", "w"])

    parts = seeded.mapInArrow(run, "g string, s array<double>, w array<double>")
    return parts.select("g", F.posexplode(F.arrays_zip("s", "w")).alias("round", "z")).groupBy("g", "round").agg((F.sum("z.s") / F.nullif(F.sum("z.w"), F.lit(0.0))).alias("mean"))


def _group(names: list[str]) -> Column:
    return (F.to_json(F.struct(*names)) if names else F.lit("")).alias("g")


ENDS = {"lo": ("floor", 0.025), "hi": ("floor", 0.975)}


def bootstrap(df: DataFrame, by: list[str], value: str, rounds: int = 1000, seed: int = 0) -> DataFrame:
    """Means of resamples: (by, mean, lo, hi) with the 2.5 and 97.5 % order statistics. See round_means()."""
    names = [f"g{i}" for i in range(len(by))]
    ends = order_stats(round_means(df, by, value, rounds, seed), ["g"], "mean", ENDS)
    means = df.groupBy(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)]).agg(F.avg(value).alias("mean")).withColumn("g", _group(names))
    return means.join(ends, "g", "left").select(*[F.col(n).alias(c) for n, c in zip(names, by, strict=True)], "mean", "lo", "hi")


def bootstrap_gap(df: DataFrame, arm: str, first: str, second: str, value: str, rounds: int = 1000, seed: int = 0) -> DataFrame:
    """One row (gap, lo, hi): the mean of the first arm less the second's, and its interval over resamples of both."""
    m = round_means(df.where(F.col(arm).isin(first, second)), [arm], value, rounds, seed).withColumn("arm", F.get_json_object("g", "$.g0"))
    per = m.groupBy("round").agg((F.max(F.when(F.col("arm") == first, F.col("mean"))) - F.max(F.when(F.col("arm") == second, F.col("mean")))).alias("gap")).withColumn("all", F.lit(0))
    ends = order_stats(per, ["all"], "gap", ENDS)
    mean = lambda a: F.avg(F.when(F.col(arm) == a, F.col(value)))
    return df.agg((mean(first) - mean(second)).alias("gap")).select("gap", *[ends.select(c).scalar().alias(c) for c in ("lo", "hi")])
