"""Declarative case specs: JSON, checked, bound to registered functions and compiled to a plan.

A spec names a corpus selector, a sampler of templates, a normaliser, a validator and a row
constructor. Compiling gives a DataFrame: items that are not done yet, joined with the responses that
some backend has given (a table takes the place of calls), gated with the first reason that rejects,
deduplicated by content hash, and built into rows.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import text as T
from .operators import classify, dedup, sampling, tables
from .plans.registry import get, plugin


class SpecError(ValueError):
    """A spec that cannot be compiled."""


@dataclass(frozen=True)
class CaseSpec:
    """One case: required are name, version, selector, templates, validator and row."""

    case: str
    version: int
    selector: str
    templates: tuple[str, ...]
    validator: str
    row: str
    sampler: str = "template_uniform"
    normalizer: str = "raw"
    dedup: str = "target"
    checks: tuple[str, ...] = ()
    seed: int = 0
    max_items: int | None = None
    options: dict = field(default_factory=dict, hash=False)


REQUIRED = ("case", "version", "selector", "templates", "validator", "row")


def load(text: str) -> CaseSpec:
    """A spec from JSON. Unknown or missing keys, and names that nothing is registered under, are errors."""
    try:
        d = json.loads(text)
    except ValueError as e:
        raise SpecError(f"not JSON: {e}") from e
    missing = [k for k in REQUIRED if k not in d]
    extra = set(d) - set(CaseSpec.__dataclass_fields__)
    if missing or extra:
        raise SpecError(f"missing {missing}, unknown {sorted(extra)}")
    if not d["templates"] or d.get("dedup", "target") not in ("target", "key"):
        raise SpecError("templates must not be empty, and dedup is target or key")
    spec = CaseSpec(**{k: tuple(v) if isinstance(v, list) else v for k, v in d.items()})
    for kind, name in (("selector", spec.selector), ("sampler", spec.sampler), ("normalizer", spec.normalizer), ("validator", spec.validator), ("row", spec.row), *(("check", c) for c in spec.checks)):
        try:
            get(kind, name)
        except KeyError as e:
            raise SpecError(str(e)) from e
    return spec


def compiled(spec: CaseSpec, corpus: DataFrame, responses: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """(key, template, reject, ...row): accepted rows have a null reject; rejected ones say why.

    corpus goes through the selector, which gives at least a key; responses are (key, response).
    """
    items = get("selector", spec.selector)(corpus, **spec.options)
    if done is not None:
        items = tables.pending(items, done, "key")
    if spec.max_items is not None:
        items = sampling.seeded(items, "key", spec.max_items, spec.seed)
    items = items.withColumn("template", get("sampler", spec.sampler)(F.col("key"), spec.seed, list(spec.templates)))
    both = items.join(responses.select("key", "response"), "key", "left")
    target = get("normalizer", spec.normalizer)(F.col("response"))
    both = both.withColumn("target", target).withColumn("reject", F.when(F.col("response").isNull(), "no_response"))
    both = both.withColumn("reject", F.coalesce("reject", get("validator", spec.validator)(F.col("target"))))
    rows = get("row", spec.row)(both)
    for c in spec.checks:
        rows = rows.withColumn("reject", F.coalesce("reject", F.when(~F.coalesce(get("check", c)(rows), F.lit(False)), c)))
    key = F.col("key") if spec.dedup == "key" else None
    rows = rows.withColumn("content_hash", T.content_hash(F.lit(f"{spec.case}@{spec.version}"), key, F.col("target")))
    good, bad = rows.where("reject is null"), rows.where("reject is not null")
    first = dedup.keep_first(good.select("content_hash", "key"), ["content_hash"], ["key"]).select(F.col("key").alias("__k"))
    marked = good.join(first, F.col("key") == F.col("__k"), "left").withColumn("reject", F.when(F.col("__k").isNull(), "duplicate")).drop("__k")
    return marked.unionByName(bad)


@plugin("sampler", "template_uniform")
def template_uniform(key: Column, seed: int, templates: list[str]) -> Column:
    return sampling.weighted_choice(key, seed, [(t, 1) for t in templates])


@plugin("sampler", "grid_choice")
def grid_choice(key: Column, seed: int, options: list[str]) -> Column:
    return sampling.weighted_choice(F.concat(F.lit("grid:"), key.cast("string")), seed, [(t, 1) for t in options])


@plugin("normalizer", "raw")
def raw(c: Column) -> Column:
    return c


@plugin("normalizer", "code")
def code(c: Column) -> Column:
    """Lines right-stripped, without empty ones at the end."""
    return F.array_join(T.trim_tail(T.lines(c)), "\n")


@plugin("normalizer", "comment")
def comment(c: Column) -> Column:
    """Without leading #, quotes around, and with single blanks."""
    return T.collapse(F.regexp_replace(T.strip(F.regexp_replace(c, r"^\s*#+'?\s*", "")), "^[\"'`]+|[\"'`]+$", ""))


@plugin("validator", "corpus_side")
def corpus_side(c: Column) -> Column:
    return F.when(T.strip(F.coalesce(c, F.lit(""))) == "", "empty")


@plugin("validator", "comment_gate")
def comment_gate(c: Column) -> Column:
    """One short line of prose."""
    return F.when(T.strip(c) == "", "empty").when(F.length(c) > 90, "too_long").when(c.rlike("[;(\n]|<-"), "not_prose")


@plugin("row", "cursor_completion")
def cursor_completion(df: DataFrame) -> DataFrame:
    """The response becomes the new region."""
    return df.withColumn("region_new", F.split("target", "\n"))


@plugin("row", "exact_completion")
def exact_completion(df: DataFrame) -> DataFrame:
    """The corpus remainder becomes the new region; the response is kept beside it."""
    return df.withColumn("region_new", F.split("corpus_target", "\n")).withColumn("model_target", F.col("target"))


@plugin("row", "comment_prefix")
def comment_prefix(df: DataFrame) -> DataFrame:
    """The response becomes the last line of the prefix, as a comment."""
    return df.withColumn("prefix", F.concat("prefix", F.array(F.concat(F.lit("# "), F.col("target")))))


@plugin("check", "ends_with_comment_line")
def ends_with_comment_line(df: DataFrame) -> Column:
    last = F.element_at("prefix", -1)
    return T.strip(last).startswith("#") & ~T.strip(last).startswith("#'")


@plugin("check", "mid_line_cursor")
def mid_line_cursor(df: DataFrame) -> Column:
    return F.element_at("prefix", -1).rlike(r"[(,=]\s*$")


@plugin("check", "matches_corpus")
def matches_corpus(df: DataFrame) -> Column:
    """Solid lines of target and corpus are equal once stripped."""
    solid = lambda c: F.filter(F.transform(F.split(c, "\n"), T.strip), lambda x: x != "")
    return solid(F.col("target")) == solid(F.col("corpus_target"))


@plugin("check", "row_shape")
def row_shape(df: DataFrame) -> Column:
    """Lines hold no line ends, and there is a new region."""
    whole = lambda c: F.forall(F.col(c), lambda x: ~F.contains(x, F.lit("\n")))
    return whole("prefix") & whole("region_new") & (F.size("region_new") > 0)


def report(rows: DataFrame) -> DataFrame:
    """Counts by outcome."""
    return rows.groupBy(F.coalesce("reject", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("n"))


__all__ = ["CaseSpec", "SpecError", "classify", "compiled", "load", "report"]
