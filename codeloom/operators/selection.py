"""Selections with quotas, strata, decks and merges. Random order is always the hash of a stable key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .dedup import keep_first
from .sampling import grid, hash_ranked


def stratified_fill(first: DataFrame, rest: DataFrame, key: str, total: int, n_eval: int, seed: int) -> DataFrame:
    """All of `first` and as many of `rest` as fill `total`, with `stratum` and `split`: of each stratum its share, rounded
    half to even, of n_eval / total is eval. Both are ranked by hash."""
    n_first = first.agg(F.count("*")).scalar()
    both = first.withColumn("stratum", F.lit("first")).unionByName(rest.withColumn("stratum", F.lit("rest")))
    ranked = hash_ranked(both, ["stratum"], key, seed).where((F.col("stratum") == "first") | (F.col("__r") <= F.greatest(F.lit(0), F.lit(total) - n_first)))
    size = ranked.groupBy("stratum").agg(F.bround(F.count("*") * F.lit(n_eval / total)).alias("__e"))
    return ranked.join(size, "stratum").withColumn("split", F.when(F.col("__r") <= F.col("__e"), "eval").otherwise("train")).select(*first.columns, "stratum", "split")


def fixed_sizes(df: DataFrame, by: str, sizes: dict[str, int], key: str, seed: int) -> DataFrame:
    """min(size, rows) rows of each named group, by hash order; groups without a size give none."""
    want = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])
    return hash_ranked(df.where(F.col(by).isin(*sizes)), [by], key, seed).where(F.col("__r") <= want[F.col(by)]).drop("__r")


def capped_total(df: DataFrame, by: str, order: list, cap: int, total: int) -> DataFrame:
    """The first `cap` rows of each group, and of these the first `total` in the order of groups; the last group may give a part."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= cap).orderBy(by, "__r").limit(total).drop("__r")


def countdown(df: DataFrame, kind: str, quotas: dict[str, int], order: list) -> DataFrame:
    """Rows of each kind until its quota is used up, in an order; unnamed kinds give none."""
    want = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])
    w = Window.partitionBy(kind).orderBy(*order)
    return df.where(F.col(kind).isin(*quotas)).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= want[F.col(kind)]).drop("__r")


def by_priority(df: DataFrame, kind: str, kinds: list[str], order: list, n: int) -> DataFrame:
    """n rows in rotation over the kinds, in the order of `kinds`; other kinds are left out."""
    place = F.array_position(F.array(*map(F.lit, kinds)), F.col(kind))
    w = Window.partitionBy(kind).orderBy(*order)
    return df.where(F.col(kind).isin(*kinds)).withColumn("__c", F.row_number().over(w)).orderBy("__c", place).limit(n).drop("__c")


def deck(spark, n: int, seed: int, cores: dict[str, list], styles: dict[str, list]) -> DataFrame:
    """n cells (pos, core columns, style columns, recycled): cores are cycled in a shuffled order; each core deals its own
    shuffled deck of styles without repeating one, and once that is used up styles are drawn by hash."""
    w = Window.orderBy("__h")
    text = lambda cols: F.concat_ws("|", *[F.col(c).cast("string") for c in cols])
    c = grid(spark, **cores).withColumn("__id", text(cores)).withColumn("__h", T.order_key(F.col("__id"), seed)).withColumn("__core", F.row_number().over(w) - 1)
    n_core, n_style = _product(cores), _product(styles)
    draws = spark.range(n).select(F.col("id").alias("pos"), (F.col("id") % n_core).alias("__core"), F.floor(F.col("id") / n_core).alias("__turn"))
    drawn = draws.join(c, "__core")
    pick = F.when(F.col("__turn") < n_style, F.col("__turn")).otherwise(F.floor(T.unit(F.concat_ws(":", F.lit(str(seed)), "__id", F.col("pos").cast("string"))) * (n_style - 1e-9))).cast("bigint")
    cells = grid(spark, **cores, **styles).select(text(cores).alias("__mine"), text(styles).alias("__sid"), *styles)
    decks = cells.withColumn("__slot", F.row_number().over(Window.partitionBy("__mine").orderBy(T.order_key(F.concat_ws("|", "__mine", "__sid"), seed))) - 1)
    out = drawn.withColumn("__pick", pick).join(decks, (F.col("__id") == F.col("__mine")) & (F.col("__pick") == F.col("__slot")))
    return out.select("pos", *cores, *styles, (F.col("__turn") >= n_style).alias("recycled"))


def _product(axes: dict[str, list]) -> int:
    n = 1
    for v in axes.values():
        n *= len(v)
    return n


def mixed(df: DataFrame, arm: str, spec: str, key: str, seed: int, done: DataFrame | None = None) -> DataFrame:
    """Rows by a spec such as `mine:200,inject:50`: so many of each arm, by hash order, without keys that are done."""
    want = {a.strip(): int(n or 0) for a, _, n in (part.partition(":") for part in spec.split(","))}
    left = df if done is None else df.join(done.select(key).distinct(), key, "left_anti")
    return fixed_sizes(left, arm, {a: n for a, n in want.items() if n > 0} or {"": 0}, key, seed)


def family_quotas(df: DataFrame, family: str, quotas: dict[str, int], text: str, key: str, held: DataFrame, seen: DataFrame, most: int, seed: int) -> DataFrame:
    """Quotas of families after held-out keys, texts that were seen, and texts over `most` characters are gone."""
    left = df.where(F.length(text) <= most).join(held.select(key).distinct(), key, "left_anti")
    fresh = left.withColumn("__t", F.md5(T.collapse(F.col(text)))).join(seen.select(F.md5(T.collapse(F.col(text))).alias("__t")).distinct(), "__t", "left_anti").drop("__t")
    return fixed_sizes(fresh, family, quotas, key, seed)


def first_usable(df: DataFrame, family: str, n: int, usable, key: str, seed: int) -> DataFrame:
    """Of each family the first n rows, by hash order, that are usable."""
    return hash_ranked(df.where(usable), [family], key, seed).where(F.col("__r") <= n).drop("__r")


def train_and_eval(df: DataFrame, key: str, n_train: int, n_eval: int, seed: int) -> DataFrame:
    """The first n_train rows by hash order as train, the next n_eval as eval."""
    ranked = hash_ranked(df, [], key, seed).where(F.col("__r") <= n_train + n_eval)
    return ranked.withColumn("split", F.when(F.col("__r") <= n_train, "train").otherwise("eval")).drop("__r")


def merged(old: DataFrame, new: DataFrame, keys: list[str], text: str, order: str) -> DataFrame:
    """old's and new's rows, of each keys and text (by hash) the first, old before new; `origin` tells which."""
    both = old.withColumn("origin", F.lit("old")).unionByName(new.withColumn("origin", F.lit("new")))
    return keep_first(both, [*keys, F.sha1(F.col(text))], [F.when(F.col("origin") == "old", 0).otherwise(1), order])


def derivation_key(sample: Column, rule: Column, version: Column, params: Column) -> Column:
    """The key under which a derived row counts once: sample, rule, version and parameters."""
    return F.sha1(F.concat_ws("|", sample, rule, version.cast("string"), F.to_json(params)))


def stable_order(df: DataFrame, by: list[str], seed: str) -> DataFrame:
    """Rows in a shuffled order that their keys and a seed (say, a hash of parameters) fix."""
    key = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by])
    return df.orderBy(T.order_key(key, seed), *by)


def pool_order(df: DataFrame, arm: str, first: list[str], key: str) -> DataFrame:
    """The arms named first, in that order, then all others; by key within."""
    place = F.array_position(F.array(*map(F.lit, first)), F.col(arm))
    return df.orderBy(F.when(place > 0, place).otherwise(len(first) + 1), key)


def diverse_best(df: DataFrame, title: str, band: str, score: str, target: int, most: int) -> DataFrame:
    """BUILD rows, `most` at most, filled up to `target` with the best BANK rows whose title is no near copy of a picked one
    (neither holds the other's first 25 letters); if there are none at all, the best row. Titles are unique.

    Each pick is one top-1 over the rows that no earlier pick shadows; the driver holds the picked titles, `target` or `most` at most.
    """
    order, low = [F.desc(score), title], F.lower(F.col(title))
    picked = [r[0] for r in df.where(F.col(band) == "BUILD").orderBy(*order).limit(most).select(title).collect()]
    while len(picked) < target:
        rest = df.where((F.col(band) == "BANK") & ~F.col(title).isin(picked))
        for p in picked:
            rest = rest.where(~F.contains(low, F.lit(p[:25].lower())) & ~F.contains(F.lit(p.lower()), F.substring(low, 1, 25)))
        more = rest.orderBy(*order).select(title).limit(1).collect()
        if not more:
            break
        picked.append(more[0][0])
    return df.where(F.col(title).isin(picked)) if picked else df.orderBy(*order).limit(1)
