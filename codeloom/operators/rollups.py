"""Roll-ups of corpora, evaluations, judges and rules: every one an aggregation that starts before its shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import order_stats
from . import metrics
from .tables import enriched

# Limits from which a function smells, and labels that are no modernisation.
SMELLS = {"cyclomatic": 10, "nesting": 4, "body_lines": 40, "dup_lines": 3, "magic_numbers": 3, "dead_assigns": 1}
NOT_MODERN = ("other_code_edit", "docs_file", "tests_file", "purrr_loss", "dplyr_loss", "pipe_loss", "apply_to_loop", "styler_whitespace")


def share_of(condition: Column, digits: int = 4) -> Column:
    """The share of a group's rows for which a condition holds; null counts as not."""
    return F.round(F.avg(F.when(condition, 1.0).otherwise(0.0)), digits)


def totals_map(df: DataFrame, by: list[str], key: str, value: str, out: str = "totals") -> DataFrame:
    """(by, out): a map from each key of a group to its total, in the order of keys; a null key is ''."""
    sums = df.groupBy(*by, F.coalesce(F.col(key).cast("string"), F.lit("")).alias("__k")).agg(F.sum(value).alias("__v"))
    return sums.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("__k", "__v")))).alias(out))


def duplication_split(raw: Column, unique: Column, raw_latest: Column, unique_latest: Column) -> Column:
    """What is duplicated in all versions, apart: between versions and within the latest ones."""
    total, within = raw - unique, raw_latest - unique_latest
    between = F.greatest(F.lit(0.0), (total - within).cast("double"))
    return F.struct(total.cast("double").alias("total_dup"), between.alias("version_dup"), within.cast("double").alias("within_dup"), F.when(total > 0, F.round(between / total, 4)).alias("version_share"))


def inventory(files: DataFrame, by: list[str], size: str) -> DataFrame:
    """Files and bytes of each package."""
    return files.groupBy(*by).agg(F.count("*").alias("n_files"), F.coalesce(F.sum(size), F.lit(0)).alias("n_bytes"))


def corpus_estimates(sample: DataFrame, population: DataFrame, cls: str, value: str) -> DataFrame:
    """One row: the sample's mean times the population, and class means times class counts (classes that the sample lacks count nothing)."""
    means = sample.groupBy(cls).agg(F.avg(value).alias("m"))
    strat = population.groupBy(cls).agg(F.count("*").alias("n")).join(means, cls).agg(F.sum(F.col("m") * F.col("n")))
    return sample.agg(F.avg(value).alias("mean"), F.count("*").alias("sample_n")).select("sample_n", "mean", (F.col("mean") * population.agg(F.count("*")).scalar()).alias("by_mean"), strat.scalar().alias("by_class"))


def flag_counts(df: DataFrame, flags: str) -> DataFrame:
    """(flag, n): rows with each flag, with any (`any`) and the rows without (`clean`)."""
    tags = F.concat(F.array_distinct(F.coalesce(flags, F.array().cast("array<string>"))), F.array(F.when(F.size(F.coalesce(flags, F.array().cast("array<string>"))) > 0, "any").otherwise("clean")))
    return df.select(F.explode(tags).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


def scenario_scores(df: DataFrame, by: list[str], old: str, new: str) -> DataFrame:
    """Results of scenarios (valid_pass, exact, reward, fail_kind, latency_s) with what answering nothing new would score."""
    lat = order_stats(df, by, "latency_s", {"p50_latency_s": ("upper_median", 0), "p95_latency_s": ("nearest", 0.95)})
    kinds = [share_of(F.col("fail_kind") == k).alias(f"fail_{k}") for k in ("shape", "transform", "error")]
    scored = df.withColumn("__f1", metrics.line_f1(F.col(old), F.col(new))).withColumn("__exact", metrics.exact(F.col(old), F.col(new)))
    agg = scored.groupBy(*by).agg(F.count("*").alias("n_scored"), share_of(F.col("valid_pass") == 1).alias("validator_pass"), share_of(F.col("exact") == 1).alias("exact"), F.round(F.avg("reward"), 4).alias("mean_reward"), *kinds, F.round(F.avg("__f1"), 4).alias("noop_line_f1"), share_of(F.col("__exact") == 1).alias("noop_exact"))
    return agg.join(lat, by, "left")


def copy_baseline(df: DataFrame, by: list[str], old: str, new: str) -> DataFrame:
    """Scores of repeating the old region: (by, n, exact, first_line, line_f1)."""
    o, n = F.col(old), F.col(new)
    scored = df.select(*by, metrics.exact(o, n).alias("e"), metrics.first_line(o, n).alias("f"), metrics.line_f1(o, n).alias("l"))
    return scored.groupBy(*by).agg(F.count("*").alias("n"), F.avg("e").alias("exact"), F.avg("f").alias("first_line"), F.avg("l").alias("line_f1"))


def tournament(rounds: DataFrame, bank: DataFrame, title: str, composite: str, top: int = 5) -> DataFrame:
    """One row: rounds done and open (name like r001, done), the bank's size and its best titles."""
    best = bank.groupBy().agg(F.count("*").alias("bank_size"))
    names = bank.select(F.coalesce(composite, F.lit(0.0)).alias("c"), title).orderBy(F.desc("c"), title).limit(top).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("c"), F.col(title).alias("t")))), lambda x: x["t"]))
    r = rounds.where(F.col("round").rlike(r"^r\d{3}$")).agg(F.count_if("done").alias("rounds_done"), F.count_if(~F.col("done")).alias("rounds_open"))
    return r.select("rounds_done", "rounds_open", best.scalar().alias("bank_size"), names.scalar().alias("top"))


def density(df: DataFrame, package: str, bodies: str, commented: str) -> DataFrame:
    """One row: the share of bodies with comments, over all and as order statistics of packages, in percent."""
    per = df.groupBy(package).agg(F.sum(bodies).alias("b"), F.sum(commented).alias("c")).where("b > 0").select((F.col("c") / F.col("b")).alias("p"), "b", "c")
    stats = order_stats(per, [], "p", {"p25": ("floor", 0.25), "median": ("floor", 0.5), "p75": ("floor", 0.75)})
    agg = per.agg(F.sum("b").alias("bodies"), F.sum("c").alias("commented"), F.count("*").alias("packages"), F.avg("p").alias("mean"), F.min("p").alias("min"), F.max("p").alias("max"))
    pct = lambda c: F.round(100 * c, 2)
    return agg.select("bodies", "commented", pct(F.col("commented") / F.col("bodies")).alias("pct"), "packages", *[pct(F.col(c)).alias(c) for c in ("mean", "min", "max")], *[pct(stats.select(c).scalar()).alias(c) for c in ("p25", "median", "p75")])


def rule_matrix(df: DataFrame, rule: str, sites: str, rows: str, reason: str) -> DataFrame:
    """(rule, attempted, sites, rows, rejects, reasons): outcomes of rules on samples; rejects gave no row, reasons is a map of counts."""
    per = df.groupBy(rule, F.when(F.col(rows) == 0, F.coalesce(reason, F.lit("none"))).alias("why")).agg(F.count("*").alias("n"), F.sum(sites).alias("sites"), F.sum(rows).alias("rows"))
    lost = F.when(F.col("why").isNotNull(), F.struct("why", "n"))
    return per.groupBy(rule).agg(F.sum("n").alias("attempted"), F.sum("sites").alias("sites"), F.sum("rows").alias("rows"), F.coalesce(F.sum(F.when(F.col("why").isNotNull(), F.col("n"))), F.lit(0).cast("bigint")).alias("rejects"), F.map_from_entries(F.array_sort(F.collect_list(lost))).alias("reasons"))


def sample_yield(df: DataFrame, sample: str, family: str) -> DataFrame:
    """(sample, n_rows, n_families, families): what each base sample gave."""
    fams = F.array_sort(F.collect_set(family))
    return df.groupBy(sample).agg(F.count("*").alias("n_rows"), F.size(fams).alias("n_families"), fams.alias("families"))


def smells(df: DataFrame, limits: dict[str, int] | None = None, percentiles: tuple[float, ...] = (0.5, 0.75, 0.9, 0.95, 0.99)) -> tuple[DataFrame, DataFrame]:
    """(counts of functions over each limit, over any and over none, with percent; order statistics of each metric)."""
    limits = limits or SMELLS
    over = [F.coalesce(F.col(m) >= k, F.lit(False)) for m, k in limits.items()]
    some = reduce(lambda a, b: a | b, over)
    names = F.array(*[F.when(c, F.lit(f"{m}_ge_{k}")) for c, (m, k) in zip(over, limits.items(), strict=True)], F.when(some, "any_smell").otherwise("all_clean"))
    total = df.agg(F.count("*")).scalar()
    hot = df.select(F.explode(F.array_compact(names)).alias("smell")).groupBy("smell").agg(F.count("*").alias("n")).select("smell", "n", F.round(100 * F.col("n") / total, 1).alias("pct"))
    long = df.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("bigint").alias("value")) for m in limits])))
    dist = order_stats(long, ["metric"], "value", {f"p{round(100 * p)}": ("floor", p) for p in percentiles} | {"max": ("max", 1)})
    return hot, long.groupBy("metric").agg(F.round(F.avg("value"), 2).alias("mean")).join(dist, "metric")


def label_shares(df: DataFrame, label: str, population: int) -> DataFrame:
    """(label, n, pct, estimate, modern): shares of primary labels, carried over to a population."""
    n = df.agg(F.count("*")).scalar()
    return df.groupBy(label).agg(F.count("*").alias("n")).select(label, "n", F.round(100 * F.col("n") / n, 2).alias("pct"), F.bround(F.col("n") * population / n).cast("bigint").alias("estimate"), (~F.col(label).isin(*NOT_MODERN)).alias("modern"))


def judge_scores(df: DataFrame, by: list[str], score: str, digits: int = 3) -> DataFrame:
    """(by, n, mean, pct2, pct0) of scores from 0 to 2; null scores take no part."""
    s = F.col(score)
    return df.where(s.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(s), digits).alias("mean"), share_of(s == 2, digits).alias("pct2"), share_of(s == 0, digits).alias("pct0"))


def calibration(df: DataFrame, label: str, score: str) -> DataFrame:
    """judge_scores by anchor label, to two digits: how a judge scores what is known to be right, spoiled or foreign."""
    return judge_scores(df, [label], score, 2).select(label, "n", "mean", "pct2")


def acceptance(df: DataFrame, by: list[str], accepted: str, layer: str, seconds: str) -> DataFrame:
    """(by, attempts, accepted, rate, rejects, mean_s, per_hour): rejects is a map of counts by the layer that rejected."""
    a = F.coalesce(F.col(accepted), F.lit(False))
    per = df.groupBy(*by, F.when(~a, F.coalesce(layer, F.lit("none"))).alias("why")).agg(F.count("*").alias("n"), F.sum(seconds).alias("all_s"), F.sum(F.when(a, F.col(seconds))).alias("ok_s"))
    ok = F.coalesce(F.sum(F.when(F.col("why").isNull(), F.col("n"))), F.lit(0).cast("bigint"))
    out = per.groupBy(*by).agg(F.sum("n").alias("attempts"), ok.alias("accepted"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("why").isNotNull(), F.struct("why", "n"))))).alias("rejects"), F.sum("ok_s").alias("ok_s"), F.sum("all_s").alias("all_s"))
    return out.select(*by, "attempts", "accepted", F.round(F.col("accepted") / F.col("attempts"), 3).alias("rate"), "rejects", F.round(F.col("ok_s") / F.nullif(F.col("accepted"), F.lit(0)), 2).alias("mean_s"), F.round(F.col("accepted") / F.nullif(F.col("all_s"), F.lit(0.0)) * 3600, 1).alias("per_hour"))


def proposals(df: DataFrame, cls: str, proposal: str, expects_none: str, chars: str, seconds: str) -> DataFrame:
    """(class, n, proposal_rate, mean_pred_chars, p50_s, p95_s, false_positives): what is proposed where nothing should be; class `all` counts expected none only."""
    yes = F.coalesce(F.col(proposal), F.lit(False))
    per = df.groupBy(cls).agg(F.count("*").alias("n"), share_of(yes).alias("proposal_rate"), F.round(F.coalesce(F.avg(F.when(yes, F.col(chars))), F.lit(0.0)), 1).alias("mean_pred_chars"), F.count_if(yes & F.col(expects_none)).alias("false_positives"))
    lat = order_stats(df, [cls], seconds, {"p50_s": ("upper_median", 0), "p95_s": ("nearest", 0.95)})
    none = df.where(F.col(expects_none)).agg(F.lit("all").alias(cls), F.count("*").alias("n"), share_of(yes).alias("proposal_rate"), F.lit(None).cast("double").alias("mean_pred_chars"), F.count_if(yes).alias("false_positives"), F.lit(None).cast(df.schema[seconds].dataType).alias("p50_s"), F.lit(None).cast(df.schema[seconds].dataType).alias("p95_s"))
    return per.join(lat, cls).unionByName(none)


def gate_stats(df: DataFrame, gates: list[str], verdict: str) -> DataFrame:
    """(gate, passed, failed, unknown, mean_ms) of tri-state gates with times ms_<gate>, and a row for each verdict with its count."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(g).alias("gate"), F.col(g).alias("ok"), (F.col(f"ms_{g}") if f"ms_{g}" in df.columns else F.lit(None)).cast("double").alias("ms")) for g in gates])))
    per = long.groupBy("gate").agg(F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failed"), F.count_if(F.col("ok").isNull()).alias("unknown"), F.round(F.avg(F.coalesce("ms", F.lit(0.0))), 1).alias("mean_ms"))
    none = F.lit(None).cast("bigint")
    return per.union(df.groupBy(F.concat(F.lit("verdict:"), F.col(verdict)).alias("gate")).agg(F.count("*").alias("passed")).select("gate", "passed", none, none, F.lit(None).cast("double")))


def rerated(ratings: DataFrame, key: str, axes: list[str]) -> DataFrame:
    """(key, axes, composite): clamped means of every axis, and their mean if any is there."""
    means = ratings.groupBy(key).agg(*[F.round(F.avg(F.when(F.col(a).isNotNull(), F.least(F.lit(5.0), F.greatest(F.lit(0.0), F.col(a))))), 2).alias(a) for a in axes])
    there = F.array_compact(F.array(*[F.col(a) for a in axes]))
    return means.withColumn("composite", F.round(F.when(F.size(there) > 0, F.aggregate(there, F.lit(0.0), lambda a, x: a + x) / F.size(there)), 2))


def speedups(behaviour: Column, bench: Column) -> Column:
    """Of behaviour (size, equal) and bench (size, speedup): the sizes of equal results, and the best speed-up (0 if none)."""
    equal = F.transform(F.filter(behaviour, lambda x: F.coalesce(x["equal"], F.lit(False))), lambda x: x["size"])
    return F.struct(equal.alias("equal_sizes"), F.coalesce(F.array_max(F.transform(bench, lambda x: F.coalesce(x["speedup"], F.lit(0.0)))), F.lit(0.0)).alias("top_speedup"))


def new_since(mixture: DataFrame, live: DataFrame, key: str, used: str, now: str) -> DataFrame:
    """mixture's counts with the live counts of the same key and what is new since; keys that are not live any more have 0."""
    e = enriched(mixture, live.select(key, F.col(now).alias("__now")), key)
    return e.select(*mixture.columns, F.coalesce("__now", F.lit(0)).alias("live"), F.greatest(F.lit(0), F.coalesce("__now", F.lit(0)) - F.col(used)).alias("new"))
