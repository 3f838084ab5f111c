"""Joins, windows and roll-ups over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written


def enriched(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """df with a dimension's columns and `hit`. Spark broadcasts the dimension if its size allows."""
    return df.join(dim.withColumn("__hit", F.lit(True)), key, "left").withColumn("hit", F.coalesce("__hit", F.lit(False))).drop("__hit")


def pending(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not done yet: how a job resumes."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def joined_on(frames: list[DataFrame], key: str) -> DataFrame:
    """All frames by an inner join on a key."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, key)
    return out


def innermost(points: DataFrame, spans: DataFrame, key: str, at: str, start: str = "start", end: str = "end", bin_size: int = 64) -> DataFrame:
    """Each point with the shortest span around it. Spans are dealt to bins, so the join is on equal bins, not on all pairs."""
    s = spans.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(start) / bin_size), F.floor(F.col(end) / bin_size))))
    p = points.withColumn("__bin", F.floor(F.col(at) / bin_size))
    hit = p.join(s, ["__bin"]).where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end)))
    w = Window.partitionBy(key).orderBy(F.col(end) - F.col(start), start)
    return hit.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__bin")


def looked_up(df: DataFrame, dim: DataFrame, keys: list[str]) -> DataFrame:
    """df's rows with the columns of the row of dim that has the same composite key; null parts equal each other."""
    there = dim.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in dim.columns if c not in keys])
    match = F.lit(True)
    for k in keys:
        match &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    return df.join(there, match).drop(*[f"__{k}" for k in keys])


def best_overlap(left: DataFrame, lkey: str, right: DataFrame, rkey: str, items: str, least: float) -> DataFrame:
    """(lkey, rkey, score): the right set that holds most of each left set, from a share of `least` on; ties go to the smaller rkey.

    A left set of n items needs ceil(least * n) of them, so some of its n - need + 1 items that are
    rarest on the right must be there (prefix filter), and the right set is no smaller (length
    filter). Only these items are joined; what meets is compared in full. Empty sets match nothing.
    """
    need = lambda n: F.greatest(F.lit(1), F.ceil(F.lit(least) * n - 1e-9)).cast("int")
    r = right.select(rkey, F.array_distinct(items).alias("rs")).where("size(rs) > 0")
    rx = r.select(rkey, F.size("rs").alias("rn"), F.explode("rs").alias("x"))
    rare = rx.groupBy("x").agg(F.count("*").alias("c"))
    l = left.select(lkey, F.array_distinct(items).alias("ls")).where("size(ls) > 0")
    lx = l.select(lkey, F.size("ls").alias("n"), F.explode("ls").alias("x")).join(rare, "x", "left")
    known = lx.groupBy(lkey, "n").agg(F.array_sort(F.collect_list(F.when(F.col("c").isNotNull(), F.struct("c", "x")))).alias("on"))
    room = F.size("on") - need(F.col("n")) + 1  # items unknown on the right are the rarest and come first
    prefix = known.where(room > 0).select(lkey, need(F.col("n")).alias("need"), F.explode(F.slice("on", 1, room)).alias("p"))
    met = prefix.select(lkey, "need", F.col("p.x").alias("x")).join(rx, "x").where("rn >= need").select(lkey, rkey).distinct()
    full = met.join(l, lkey).join(r, rkey).select(lkey, rkey, (F.size(F.array_intersect("ls", "rs")) / F.size("ls")).alias("score"))
    best = full.where(F.col("score") >= least).groupBy(lkey).agg(F.max(F.struct("score", (-F.col(rkey)).alias("k"))).alias("m"))
    return best.select(lkey, (-F.col("m.k")).alias(rkey), F.col("m.score").alias("score"))


def next_of_other_kind(df: DataFrame, by: str, order: str, kind: str) -> DataFrame:
    """Each row with the next later row of its group that is of another kind, as `sibling`; rows without one go."""
    w = Window.partitionBy(by).orderBy(order)
    change = df.withColumn("__run", F.when(F.lag(kind).over(w).eqNullSafe(F.col(kind)), 0).otherwise(1))
    run = change.withColumn("__id", F.sum("__run").over(w))
    first = run.groupBy(by, "__id").agg(F.min(order).alias("sibling")).withColumn("__id", F.col("__id") - 1)
    return run.join(first, [by, "__id"]).drop("__run", "__id")


def first_disjoint(df: DataFrame, by: str, order: str, items: str, at_once: int = 16) -> DataFrame:
    """(by, order, sibling): for each row the first other row of its group, by order, that shares no item with it.

    order is unique within a group; null and empty item sets share nothing. Rows without such a sibling
    are left out. Rows try `at_once` candidates of their group at a time, and only those without a
    find go on; rows that hold an item of every row of their group can have none and go first.
    """
    d = df.select(by, order, F.coalesce(F.array_distinct(items), F.array().cast(df.schema[items].dataType)).alias("x"))
    size = d.groupBy(by).agg(F.count("*").alias("n"))
    everywhere = d.select(by, F.explode("x").alias("i")).groupBy(by, "i").agg(F.count("*").alias("c")).join(size, by).where("c = n").groupBy(by).agg(F.collect_list("i").alias("all"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1
    ranked = written(d.withColumn("r", rank), "ranked")
    left = ranked.join(everywhere, by, "left").where("all is null or not arrays_overlap(x, all)").select(by, order, "x")
    found, step = None, 0
    while True:
        some = ranked.where((F.col("r") >= step) & (F.col("r") < step + at_once)).groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("x").alias("cx")))).alias("c"))
        fits = F.filter("c", lambda c: (c["o"] != F.col(order)) & ~F.coalesce(F.arrays_overlap(c["cx"], F.col("x")), F.lit(False)))
        tried = written(left.join(some, by).withColumn("hit", F.get(fits, F.lit(0))).select(by, order, "x", F.col("hit.o").alias("sibling")), "tried")
        got = tried.where("sibling is not null").select(by, order, "sibling")
        found = got if found is None else found.union(got)
        left, step = tried.where("sibling is null").select(by, order, "x"), step + at_once
        if left.isEmpty():
            return found


def next_pairs(df: DataFrame, by: str, order: list[str], cols: list[str]) -> DataFrame:
    """Each row of a group with the next one's columns; last rows have none and go."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in cols]).where(F.col(f"next_{cols[0]}").isNotNull())


def transitions(df: DataFrame, by: str, order: list[Column], value: str, cap: int) -> DataFrame:
    """Changes of a value between adjacent rows, newest first, the first `cap` of each group."""
    w = Window.partitionBy(by).orderBy(*order)
    pairs = df.withColumn("old", F.lead(value).over(w)).where(F.col("old").isNotNull() & (F.col("old") != F.col(value)))
    return pairs.withColumn("k", F.row_number().over(w)).where(F.col("k") <= cap)


def ring(df: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    """The last n rows of each group, oldest first by `place`."""
    w = Window.partitionBy(by)
    newest = df.withColumn("__r", F.row_number().over(w.orderBy(*[F.desc(o) for o in order]))).where(F.col("__r") <= n)
    return newest.withColumn("place", F.row_number().over(w.orderBy(*order))).drop("__r")


def gap_groups(df: DataFrame, by: str, ts: str, tie: str, seconds: float) -> DataFrame:
    """Groups of rows no more than a gap apart: (by, group, first, last, n)."""
    w = Window.partitionBy(by).orderBy(ts, tie)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = micros - F.lag(micros).over(w)
    g = df.withColumn("__new", F.when(gap <= seconds * 1e6, 0).otherwise(1)).withColumn("grp", F.sum("__new").over(w))
    return g.groupBy(by, "grp").agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n"))


def runs(df: DataFrame, by: list[str], pos: str) -> DataFrame:
    """Contiguous runs of positions: (by, start, length)."""
    w = Window.partitionBy(*by).orderBy(pos)
    return df.withColumn("__i", F.col(pos) - F.row_number().over(w)).groupBy(*by, "__i").agg(F.min(pos).alias("start"), F.count("*").alias("length")).drop("__i")


def before_counts(df: DataFrame, by: list[str], order: list[str], mask: Column) -> Column:
    """How many rows before this one have the mask set."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(mask.cast("bigint")).over(w), F.lit(0).cast("bigint"))


def prefix_sums(df: DataFrame, order: list, value: Column, bucket: Column, out: str = "before") -> DataFrame:
    """df with the sum of a value over all rows before, in one order over the whole table.

    bucket must rise with the order. Buckets are added up first, then ranges of buckets, so a task sees
    one bucket's rows, or one range's buckets, or a row for each range.
    """
    d = df.withColumn("__b", bucket).withColumn("__v", value)
    sums = d.groupBy("__b").agg(F.sum("__v").alias("__t"))
    ranges = written(sums.repartitionByRange("__b").withColumn("__p", F.spark_partition_id()), "sums")
    tops = ranges.groupBy("__p").agg(F.sum("__t").alias("__r")).select("__p", (F.sum("__r").over(Window.orderBy("__p")) - F.col("__r")).alias("__top"))
    low = ranges.withColumn("__low", F.sum("__t").over(Window.partitionBy("__p").orderBy("__b")) - F.col("__t"))
    base = low.join(tops, "__p").select("__b", (F.col("__top") + F.col("__low")).alias("__base"))
    inside = F.sum("__v").over(Window.partitionBy("__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("__v")
    return d.withColumn("__in", inside).join(base, "__b").withColumn(out, F.col("__base") + F.col("__in")).drop("__b", "__v", "__t", "__base", "__in")


def hysteresis(df: DataFrame, by: str, order: str, value: str, step: int, room: int) -> DataFrame:
    """df with `anchor`: it moves on in whole steps, only as far as the value needs room, and never back."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    need = F.greatest(F.lit(0), F.ceil((F.col(value) - room) / step) * step)
    return df.withColumn("anchor", F.max(need).over(w))


def share(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Sums by group, and their shares of all."""
    s = df.groupBy(*by).agg(F.sum(value).alias("total"))
    return s.select(*by, "total", (F.col("total") / s.agg(F.sum("total")).scalar()).alias("share"))


def breakdowns(df: DataFrame, dims: list[str], aggs: list[Column]) -> DataFrame:
    """Over all, and by each dimension: (dimension, value, ...) in one pass over the data."""
    tags = F.array(F.struct(F.lit("overall").alias("d"), F.lit("").alias("v")), *[F.struct(F.lit(d).alias("d"), F.col(d).cast("string").alias("v")) for d in dims])
    return df.withColumn("__t", F.explode(tags)).groupBy(F.col("__t.d").alias("dimension"), F.col("__t.v").alias("value")).agg(*aggs)


def version_key(version: Column) -> Column:
    """Sortable parts of a version: numbers by value, then what is left of each part."""
    return F.transform(F.split(version, "[.-]"), lambda p: F.struct(F.coalesce(F.regexp_extract(p, r"^(\d+)", 1).try_cast("int"), F.lit(-1)).alias("n"), F.regexp_replace(p, r"^\d+", "").alias("rest")))


def highest_version(df: DataFrame, by: str, version: str) -> DataFrame:
    """Each group's highest version."""
    return df.groupBy(by).agg(F.max_by(version, version_key(F.col(version))).alias("version"))
