"""Scores of predictions against targets."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T


def exact(pred: Column, target: Column) -> Column:
    return (T.trim_tail(pred) == T.trim_tail(target)).cast("int")


def first_line(pred: Column, target: Column) -> Column:
    a, b = T.trim_tail(pred), T.trim_tail(target)
    return ((F.size(a) > 0) & (F.size(b) > 0) & F.get(a, F.lit(0)).eqNullSafe(F.get(b, F.lit(0)))).cast("int")


def empty(pred: Column) -> Column:
    return (F.size(T.trim_tail(pred)) == 0).cast("int")


def _matched(a: list, b: list) -> int:
    return sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())


def _line_f1(pred: pd.Series, target: pd.Series) -> pd.Series:
    def one(p, t):
        p, t = list(p), list(t)
        if not p or not t:
            return float(p == t)
        hit = _matched(p, t)
        return 2 * hit / (len(p) + len(t))

    return pd.Series([None if p is None or t is None else one(p, t) for p, t in zip(pred, target, strict=True)], dtype="float64")


def line_f1(pred: Column, target: Column) -> Column:
    """F1 of lines matched in order (longest matching blocks), over lines right-stripped."""
    return F.pandas_udf(_line_f1, "double")(T.trim_tail(pred), T.trim_tail(target))


def exact_reward(pred: Column, target: Column) -> Column:
    """1 if equal, else the line F1; 0 if one side is empty."""
    return F.when(exact(pred, target) == 1, 1.0).when((empty(pred) == 1) | (empty(target) == 1), 0.0).otherwise(line_f1(pred, target))


def shaped_reward(pred: Column, target: Column, shaping: float = 0.2) -> Column:
    """1 for an exact answer, and a share of exact_reward on top."""
    return exact(pred, target) + shaping * exact_reward(pred, target)


def noop_scores(old: Column, new: Column) -> tuple[Column, Column]:
    """(exact_reward, exact) of answering with the old region."""
    return exact_reward(old, new), exact(old, new).cast("double")


def verdict(pred: Column, single_line: Column, shape_reason: Column, transform_reason: Column) -> Column:
    """A struct of passed, fail_kind and reason: single-line families need one line; then shape comes before transform."""
    n = F.size(pred)
    lines = F.when(single_line & (n != 1), F.concat(F.lit("single-line region family, got "), n.cast("string"), F.lit(" line(s)")))
    shape = F.coalesce(lines, shape_reason)
    kind = F.when(shape.isNotNull(), "shape").when(transform_reason.isNotNull(), "transform")
    return F.struct(kind.isNull().alias("passed"), kind.alias("fail_kind"), F.substring(F.replace(F.coalesce(shape, transform_reason), F.lit("\n"), F.lit(" ")), 1, 160).alias("reason"))


def divergence(ref: Column, out: Column) -> Column:
    """A struct of first_div_tok (null if none) and prefix_frac, over words: 1 if all agree, 0 if one only runs on."""
    a, b = T.words(ref), T.words(out)
    short = F.least(F.size(a), F.size(b))
    at = F.array_position(F.zip_with(F.slice(a, 1, F.greatest(short, F.lit(0))), F.slice(b, 1, F.greatest(short, F.lit(0))), lambda x, y: x != y), True)
    div = F.when(at > 0, at.cast("int") - 1)
    frac = F.when(div.isNull() & (F.size(a) == F.size(b)), 1.0).when(div.isNull(), 0.0).otherwise(F.round(div / F.greatest(F.lit(1), F.size(a)), 4))
    return F.struct(div.alias("first_div_tok"), frac.alias("prefix_frac"))


def needle_span(text: Column, begin: str = r"#\s*SECRET_BLOCK", end: str = r"#\s*END_BLOCK") -> Column:
    """A block that an answer repeats: from its first mark, if there is one, to the end of its end mark, if there is one."""
    t = T.strip(text)
    t = F.when(t.rlike(begin), F.regexp_extract(t, f"(?s){begin}.*", 0)).otherwise(t)
    return F.when(t.rlike(end), F.regexp_extract(t, f"(?s)^.*?{end}", 0)).otherwise(t)


TAG = r"<\|marker_(\d+)\|>"


def apply_span(old: Column, offsets: Column, output: Column, end_marker: str) -> Column:
    """A struct of text and error: an answer's lines between its first and last numbered marker take the place of the old text
    between these markers' offsets (in characters); equal numbers leave it as it is. Inner markers vanish."""
    body = F.when(output.endswith(end_marker), F.substring(output, F.lit(1), F.length(output) - len(end_marker))).otherwise(output)
    tags = F.transform(F.regexp_extract_all(body, F.lit(TAG), F.lit(1)), lambda x: x.cast("int"))
    first, last, n = F.get(tags, F.lit(0)), F.element_at(F.concat(F.array(F.lit(0)), tags), -1), F.size(offsets)
    parts = F.split(body, TAG)
    content = F.array_join(F.slice(parts, 2, F.greatest(F.size(tags) - 1, F.lit(0))), "")
    outside = (first < 1) | (first > n) | (last < 1) | (last > n)
    a, b = F.get(offsets, first - 1), F.get(offsets, last - 1)
    error = F.when(F.size(tags) == 0, "no marker tags").when(F.size(tags) == 1, "only one marker tag").when(first == last, F.lit(None).cast("string")).when(outside, "marker number out of range").when(a > b, "start marker must come before end marker")
    new = F.when(first == last, old).otherwise(F.concat(F.substring(old, F.lit(1), a), content, F.substring(old, b + 1, F.length(old))))
    return F.struct(F.when(error.isNull(), new).alias("text"), error.alias("error"))


def _char_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def char_ratio(a: Column, b: Column) -> Column:
    """Similarity of characters, 0 to 1."""
    return F.pandas_udf(_char_ratio, "double")(a, b)


def taxonomy(target: Column, pred: Column, near: float = 0.9, partial: float = 0.4) -> Column:
    """exact, near_miss, partial or garbage."""
    r = char_ratio(target, pred)
    return F.when(target == pred, "exact").when(r >= near, "near_miss").when(r >= partial, "partial").otherwise("garbage")


def bits_per_byte(nats: Column, n_bytes: Column) -> Column:
    return F.sum(nats) / (F.sum(n_bytes) * F.ln(F.lit(2.0)))
