"""What surrounds an edit: windows, budgets, shifts, event texts, names, outlines and labels."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import classify, edits

EVENT = r'(?s)^User edited "(.*?)":\n\n```diff\n@@ [^\n]*@@\n(.*)\n```$'
NAME = r"[A-Za-z.][A-Za-z0-9._]*"


def line_shift(hunks: Column, line: Column) -> Column:
    """How far a line moves by the hunks (end, old_count, new_count) whose changes end above it."""
    above = F.filter(hunks, lambda h: h["end"] < line)
    return F.aggregate(above, F.lit(0), lambda a, h: a + (h["new_count"] - h["old_count"]).cast("int"))


def window(lines: Column, first: Column, last: Column, before: int, after: int, prefix: int, suffix: int) -> Column:
    """A struct of prefix, region and suffix around the changed lines [first, last]: `before` and `after` lines belong to the region."""
    n = F.size(lines)
    start, end = F.greatest(F.lit(0), first - before), F.least(n, last + 1 + after)
    low = F.greatest(F.lit(0), start - prefix)
    cut = lambda a, b: F.slice(lines, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
    return F.struct(cut(low, start).alias("prefix"), cut(start, end).alias("region"), cut(end, F.least(n, end + suffix)).alias("suffix"), start.cast("int").alias("start"))


def moved_region(child: Column, hunks: Column, start: Column, end: Column) -> Column:
    """The same region in the child file: its ends move with the hunks above them."""
    a, b = start + line_shift(hunks, start), end + line_shift(hunks, end)
    return F.slice(child, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))


def budget_head(lines: Column, budget: int) -> Column:
    """Lines from the start on whose characters, with line ends, fit a budget."""
    upto = F.aggregate(lines, F.array().cast("array<int>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.element_at(F.reverse(F.concat(F.array(F.lit(0)), a)), 1), F.lit(0)) + F.length(x) + 1)))
    return F.slice(lines, 1, F.size(F.filter(upto, lambda x: x <= budget)))


def budgeted(prefix: Column, suffix: Column, total: int, most_suffix: int) -> Column:
    """A struct of prefix and suffix: the suffix fits its budget from its start, the prefix what is left from its end."""
    s = budget_head(suffix, most_suffix)
    size = F.aggregate(s, F.lit(0), lambda a, x: a + F.length(x) + 1)
    back = F.reverse(prefix)
    run = F.aggregate(back, F.struct(F.lit(0).alias("used"), F.lit(0).alias("n"), F.lit(True).alias("open")), lambda a, x: F.struct((a["used"] + F.length(x) + 1).alias("used"), F.when(a["open"] & (a["used"] + F.length(x) + 1 <= total - size), a["n"] + 1).otherwise(a["n"]).alias("n"), (a["open"] & (a["used"] + F.length(x) + 1 <= total - size)).alias("open")))
    n = run["n"]
    return F.struct(F.when(n > 0, F.slice(prefix, F.size(prefix) - n + 1, n)).otherwise(F.array().cast("array<string>")).alias("prefix"), s.alias("suffix"))


def region_target(new: Column, prompt: Column, most: int) -> tuple[Column, Column]:
    """(target, drop reason): the whole new region with its end marker; empty regions and rows over a budget go."""
    target = F.concat(T.rstrip(F.array_join(new, "\n")), F.lit(edits.UPDATED))
    reason = F.when(F.size(edits.solid(new)) == 0, "empty_region_new").when(F.length(prompt) + F.length(target) > most, f"over_{most}")
    return F.when(reason.isNull(), target), reason


def render_block(kind: Column, package: Column, path: Column, prefix: Column, target: Column) -> Column:
    """A struct of prompt, target and converted: for `signature` an empty region, else the body's head that is typed already,
    which a target that repeats it loses; null if nothing is left."""
    at = F.instr(prefix, "{\n")
    head = F.when((kind != "signature") & (at > 0), T.lines(F.substring(prefix, at + 2, F.length(prefix)))).otherwise(F.array().cast("array<string>"))
    n = F.size(head)
    region = F.when(n > 0, F.concat(head, F.array(F.lit(edits.CURSOR)))).otherwise(F.array(F.lit(edits.CURSOR)))
    bare = lambda c: F.transform(c, lambda x: F.rtrim(x, F.lit("\r")))
    want = T.lines(target)
    again = (n > 0) & (bare(F.slice(want, 1, F.greatest(n, F.lit(1)))) == bare(head))
    rest = F.when(again, F.slice(want, n + 1, 1 << 20)).otherwise(want)
    opening = F.array(F.lit("<[fim-suffix]>"), F.concat(F.lit("<[fim-prefix]><filename>"), package, F.lit("/"), path))
    prompt = F.array_join(F.concat(opening, T.lines(prefix), F.array(F.lit("<<<<<<< CURRENT")), region, F.array(F.lit("======="), F.lit("<[fim-middle]>"))), "\n")
    return F.when(F.size(rest) > 0, F.struct(prompt.alias("prompt"), F.concat(T.rstrip(F.array_join(rest, "\n")), F.lit(edits.UPDATED)).alias("target"), again.alias("converted")))


def pair_flags(prefix: Column, old: Column, new: Column, author: Column, pr_author: Column, reply_to: Column, created: Column, merged: Column, changed_after: Column) -> Column:
    """Flags of a reviewed edit and of its thread, in a fixed order."""
    o, n = edits.solid(old), edits.solid(new)
    comments = lambda c: F.forall(c, lambda x: F.ltrim(x).startswith("#"))
    both = (F.size(o) > 0) & (F.size(n) > 0)
    clean = lambda c: F.transform(c, T.strip)
    rules = [
        ("ws-only", clean(old) == clean(new)),
        ("comment-only", both & comments(o) & comments(n)),
        ("mostly-unchanged", both & (edits.equal_ratio(old, new) > 0.9)),
        ("no-context", F.size(prefix) == 0),
        ("ai_reviewer", author == "Copilot"),
        ("by_pr_author", author == pr_author),
        ("thread-reply", reply_to.isNotNull()),
        ("precedes_merge", created < F.coalesce(merged, F.lit(""))),
        ("hunk_changed_after_comment", changed_after),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), name) for name, c in rules]))


def style_of_fields(fields: list[Column], lang: Column, path: Column) -> Column:
    """python for Python rows, else the style of the joined fields (arrays of lines)."""
    blob = F.concat_ws("\n", *[F.when(F.size(f) > 0, F.to_json(f)) for f in fields])
    return F.when((lang == "python") | path.endswith(".py"), "python").otherwise(classify.style(blob))


def source_label(name: Column, explicit: dict[str, str], labels: dict[str, str], pattern: str) -> Column:
    """Where a file's rows come from, by its name: an explicit label, a model in the name (-- for /), a known suffix, or corpus."""
    model = F.regexp_extract(name, pattern, 1)
    out = F.lit("corpus")
    for key, label in reversed(labels.items()):
        out = F.when(name.endswith(f"_{key}.jsonl") | F.contains(name, F.lit(f"_{key}.")), label).otherwise(out)
    out = F.when(model != "", F.replace(model, F.lit("--"), F.lit("/"))).otherwise(out)
    for key, label in reversed(explicit.items()):
        out = F.when(name == key, label).otherwise(out)
    return out


def file_family(name: Column, authors: list[str], pattern: str) -> Column:
    """A file's family: its name without author suffixes, model, extension and separators at its end; misc if nothing is left."""
    stem = name
    for key in authors:
        stem = F.replace(stem, F.lit(f"_{key}"), F.lit(""))
    bare = F.rtrim(F.replace(F.regexp_replace(stem, pattern, ""), F.lit(".jsonl"), F.lit("")), F.lit("_-"))
    return F.when(bare != "", bare).otherwise("misc")


def filled(template: str, cell: Column, keys: list[str]) -> Column:
    """A template whose {key} places take a map's values; null if the cell or one of the keys is missing."""
    out, there = F.lit(template), cell.isNotNull()
    for k in keys:
        out = F.replace(out, F.lit("{" + k + "}"), F.coalesce(cell[k], F.lit("")))
        there &= cell[k].isNotNull()
    return F.when(there, out)


def event_text(path: Column, old_start: Column, old_count: Column, new_start: Column, new_count: Column, lines: Column, most: int = 40) -> Column:
    """The text of an edit event: a fenced hunk of at most `most` lines; counts of null are left out, as for single lines."""
    at = lambda s, c: F.concat(s.cast("string"), F.coalesce(F.concat(F.lit(","), c.cast("string")), F.lit("")))
    return F.concat(F.lit('User edited "'), path, F.lit('":\n\n```diff\n@@ -'), at(old_start, old_count), F.lit(" +"), at(new_start, new_count), F.lit(" @@\n"), F.array_join(F.slice(lines, 1, most), "\n"), F.lit("\n```"))


def parsed_event(event: Column) -> Column:
    """A struct of path, old and new lines of an event text; null if it is none."""
    body = F.split(F.regexp_extract(event, EVENT, 2), "\n")
    side = lambda sign: F.transform(F.filter(body, lambda x: x.startswith(sign)), lambda x: F.substring(x, 2, F.length(x)))
    return F.when(event.rlike(EVENT), F.struct(F.regexp_extract(event, EVENT, 1).alias("path"), side("-").alias("old"), side("+").alias("new")))


def renamed_pair(history: Column, stopwords: list[str]) -> Column:
    """(old, new) if the lines of a diff take out just one name and bring in just one; else null."""
    def names(sign, head):
        lines = F.filter(history, lambda x: x.startswith(sign) & ~x.startswith(head))
        return F.filter(F.array_distinct(F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit(NAME), F.lit(0))))), lambda n: ~n.isin(*stopwords) if stopwords else F.lit(True))

    minus, plus = names("-", "---"), names("+", "+++")
    gone, come = F.array_except(minus, plus), F.array_except(plus, minus)
    return F.when((F.size(gone) == 1) & (F.size(come) == 1), F.struct(F.get(gone, F.lit(0)).alias("old"), F.get(come, F.lit(0)).alias("new")))


def outline(functions: DataFrame, key: str, name: str, start: str) -> DataFrame:
    """(key, outline): a file's functions in order, a line `start: name` for each."""
    return functions.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(start, name))), lambda x: F.concat(x[start].cast("string"), F.lit(": "), x[name])), "\n").alias("outline"))


def pinned(lines: Column, cursor: Column, most: int) -> Column:
    """A struct of the lines before and after a cursor line, each at most `most`, the cursor's own line first of those after."""
    before = F.slice(lines, F.greatest(F.lit(1), cursor - most + 1).cast("int"), F.least(cursor, F.lit(most)).cast("int"))
    return F.struct(F.when(cursor > 0, before).otherwise(F.array().cast("array<string>")).alias("before"), F.slice(lines, (cursor + 1).cast("int"), most).alias("after"))


def _groups(old: list[str], new: list[str]) -> list[tuple[int, int, int, int]]:
    """Runs of lines that differ, as ranges of both sides."""
    at = [(m.a, m.b, m.size) for m in difflib.SequenceMatcher(None, old, new, autojunk=False).get_matching_blocks()]
    out, i, j = [], 0, 0
    for a, b, n in at:
        if a > i or b > j:
            out.append((i, a, j, b))
        i, j = a + n, b + n
    return out


def change_groups(old: Column, new: Column) -> Column:
    """Hunks of two arrays of lines: structs of ranges [i1, i2) of the old and [j1, j2) of the new lines, an equal line apart at least."""
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else [dict(zip(("i1", "i2", "j1", "j2"), g, strict=True)) for g in _groups(list(x), list(y))] for x, y in zip(a, b, strict=True)])

    return F.pandas_udf(run, "array<struct<i1:int,i2:int,j1:int,j2:int>>")(old, new)


def mapped_region(old: Column, new: Column, start: Column, span: Column) -> Column:
    """The range of new lines that stands for old lines [start, start + span): equal runs anchor it, changes fall to the side they touch."""
    def one(a, b, r0, n):
        same = [(m.a, m.b, m.size) for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size]
        inside = lambda k: next((j + k - i for i, j, size in same if i <= k <= i + size), None)
        low, high = inside(r0), inside(r0 + n)
        low = max((j + size for i, j, size in same if i + size <= r0), default=0) if low is None else low
        high = min((j for i, j, _ in same if i >= r0 + n), default=len(b)) if high is None else high
        return {"start": low, "end": max(high, low + 1)}

    def run(a: pd.Series, b: pd.Series, r: pd.Series, n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(list(x), list(y), int(z), int(m)) for x, y, z, m in zip(a, b, r, n, strict=True)], columns=["start", "end"])

    return F.pandas_udf(run, "start int, end int")(old, new, start, span)


def code_blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, block, tag, kind, code, sha): fenced blocks of each text; kind is r, other or untagged, and equal code has an equal sha."""
    part = lambda i: F.regexp_extract_all(F.col(text), F.lit(classify.FENCE_BLOCK), F.lit(i))
    rows = df.select(key, F.posexplode(F.arrays_zip(part(1).alias("tag"), part(2).alias("code"))).alias("block", "x")).select(key, "block", F.lower("x.tag").alias("tag"), "x.code")
    kind = F.when(F.col("tag") == "", "untagged").when(F.col("tag").isin(*classify.R_TAGS), "r").otherwise("other")
    return rows.select(key, "block", "tag", kind.alias("kind"), "code", F.sha1("code").alias("sha"))


def reformatted(df: DataFrame, key: str, text: str, formatted: DataFrame) -> DataFrame:
    """df with fenced R code replaced by what a formatter has made of it: formatted is (sha, code), once for all equal blocks; other blocks stay."""
    hits = code_blocks(df, key, text).where("kind = 'r'").join(formatted.select("sha", F.col("code").alias("new")), "sha").where(F.col("new") != F.col("code"))
    per = hits.groupBy(F.col(key).alias("__k")).agg(F.array_sort(F.collect_list(F.struct("block", "code", "new"))).alias("__h"))
    done = F.aggregate("__h", F.col(text), lambda t, h: F.replace(t, F.concat(F.lit("\n"), h["code"], F.lit("```")), F.concat(F.lit("\n"), h["new"], F.lit("```"))))
    j = df.join(per, F.col(key) == F.col("__k"), "left")
    return j.select(*[F.when(F.col("__h").isNotNull(), done).otherwise(F.col(text)).alias(text) if c == text else F.col(c) for c in df.columns])
