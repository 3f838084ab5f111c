"""Edit pairs: hunks, regions, flags, targets and prompts, as columns over arrays of lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T

# Markers of the prompt formats.
UPDATED = "\n>>>>>>> UPDATED"
CURSOR = "<|user_cursor|>"
REGION = ("<|editable_region_start|>", "<|editable_region_end|>", "<|user_cursor_is_here|>")
DOC_ENDS = (".md", ".rmd", ".qmd", ".txt", ".yaml", ".yml", ".json", ".toml", ".cfg", ".ini")
CHURN = ("snapshot", "_snaps", "news", "description", " changelog", "cran-comments")
EXCERPT = "### Instruction:\nYou are a code completion assistant and your task is to analyze user edits and then rewrite an excerpt that the user provides, suggesting the appropriate edits within the excerpt, taking into account the cursor location.\n\n### User Edits:\n\n"


def solid(lines: Column) -> Column:
    """Lines that are not blank."""
    return F.filter(lines, lambda x: T.strip(x) != "")


def equal_ratio(old: Column, new: Column) -> Column:
    """Solid lines equal place by place, over the longer side."""
    o, n = solid(old), solid(new)
    same = F.size(F.filter(F.zip_with(o, n, lambda a, b: a.eqNullSafe(b) & a.isNotNull()), lambda x: x))
    return same / F.greatest(F.size(o), F.size(n), F.lit(1))


def flags(path: Column, prefix: Column, old: Column, new: Column, suffix: Column) -> Column:
    """Audit flags, in a fixed order."""
    p = F.lower(path)
    clean = lambda c: F.transform(c, T.strip)
    comments = lambda c: (F.size(solid(c)) > 0) & F.forall(solid(c), lambda x: T.strip(x).rlike(r"^(#|//|\*)"))
    docs = p.rlike("(" + "|".join(x.replace(".", "\\.") for x in DOC_ENDS) + ")$")
    churn = p.rlike("|".join(CHURN))
    found = [
        F.when(docs, "docsfile"),
        F.when(churn, "churnfile"),
        F.when(clean(old) == clean(new), "ws-only"),
        F.when(comments(old) & comments(new), "comment-only"),
        F.when(F.size(new) - F.size(old) > 12, "large-grow"),
        F.when((F.size(prefix) == 0) & (F.size(suffix) == 0), "no-context"),
        F.when(equal_ratio(old, new) > 0.9, "mostly-unchanged"),
    ]
    return F.array_compact(F.array(*found))


def first_difference(old: Column, new: Column) -> Column:
    """Index of the first line that differs, or the shorter length."""
    short = F.least(F.size(old), F.size(new))
    differs = F.zip_with(F.slice(old, 1, F.greatest(short, F.lit(0))), F.slice(new, 1, F.greatest(short, F.lit(0))), lambda a, b: ~a.eqNullSafe(b))
    at = F.array_position(differs, True)
    return F.when(short <= 0, 0).when(at > 0, at.cast("int") - 1).otherwise(short)


def suffix_target(old: Column, new: Column) -> tuple[Column, Column, Column]:
    """(first difference, target, drop reason): the new region from its first changed line on, with its end marker."""
    fd = first_difference(old, new)
    body = T.rstrip(F.array_join(F.slice(new, fd + 1, F.greatest(F.size(new) - fd, F.lit(0))), "\n"))
    reason = F.when(F.size(solid(new)) == 0, "empty_region_new").when(T.strip(body) == "", "empty_after_head_strip")
    return fd, F.when(reason.isNull(), F.concat(body, F.lit(UPDATED))), reason


def with_cursor(lines: Column, at: Column, marker: str = CURSOR) -> Column:
    return F.transform(lines, lambda x, i: F.when(i == at, F.concat(x, F.lit(marker))).otherwise(x))


def history(event: Column) -> Column:
    """Lines of an edit event without its wrapping."""
    bare = F.replace(F.replace(F.coalesce(event, F.lit("")), F.lit("```diff\n"), F.lit("")), F.lit("```"), F.lit(""))
    lines = T.lines(bare)
    lines = F.when(F.element_at(F.concat(lines, F.array(F.lit(""))), 1).startswith("User edited"), F.slice(lines, 2, 1 << 20)).otherwise(lines)
    first = F.aggregate(F.transform(lines, lambda x, i: F.when(T.strip(x) != "", i).otherwise(1 << 20)), F.lit(1 << 20), lambda a, x: F.least(a, x))
    return F.when(first < (1 << 20), F.slice(lines, first + 1, 1 << 20)).otherwise(F.array().cast("array<string>"))


def _marked(path, prefix, old, cursor, suffix, event, opening: str, closing: list[str]) -> Column:
    h = history(event)
    none = F.array().cast("array<string>")
    parts = [F.array(F.lit("<[fim-suffix]>")), F.coalesce(suffix, none), F.array(F.lit("<[fim-prefix]><filename>edit_history")), F.when(F.size(h) > 0, F.concat(h, F.array(F.lit("")))).otherwise(none), F.array(F.concat(F.lit("<filename>"), path)), F.coalesce(prefix, none), F.array(F.lit(opening)), with_cursor(old, cursor), F.array(*map(F.lit, closing))]
    return F.array_join(F.concat(*parts), "\n")


def render_merge(path, prefix, old, cursor, suffix, event) -> Column:
    """The prompt with merge markers around the region."""
    return _marked(path, prefix, old, cursor, suffix, event, "<<<<<<< CURRENT", ["=======", "<[fim-middle]>"])


def render_markers(path, prefix, old, cursor, suffix, event) -> Column:
    """The prompt with numbered markers around the region."""
    return _marked(path, prefix, old, cursor, suffix, event, "<|marker_1|>", ["<|marker_2|>", "<[fim-middle]>"])


def render_excerpt(path, prefix, old, cursor, suffix, event) -> Column:
    """The prompt with an instruction and an editable region in a fenced excerpt."""
    parts = F.concat(F.array(F.concat(F.lit("```"), path)), prefix, F.array(F.lit(REGION[0])), with_cursor(old, cursor, REGION[2]), F.array(F.lit(REGION[1])), suffix, F.array(F.lit("```")))
    return F.concat(F.lit(EXCERPT), F.coalesce(event, F.lit("")), F.lit("\n\n### User Excerpt:\n\n"), F.array_join(parts, "\n"), F.lit("\n\n### Response:\n\n"))


def render_comment(filename: Column, comment: Column, code: Column) -> tuple[Column, Column]:
    """(prompt, target) of a comment that is to become code; the target is null if the code is blank."""
    prompt = F.concat_ws("\n", F.lit("<[fim-suffix]>"), F.concat(F.lit("<[fim-prefix]><filename>"), filename), T.rstrip(comment), F.lit("<<<<<<< CURRENT"), F.lit(CURSOR), F.lit("======="), F.lit("<[fim-middle]>"))
    body = T.rstrip(F.regexp_replace(T.rstrip(code), ">>>>>>> UPDATED$", ""))
    return prompt, F.when(body != "", F.concat(body, F.lit(UPDATED)))


def parse_merge(text: Column) -> Column:
    """Predicted lines from an answer in the merge format."""
    body = F.split_part(F.split_part(text, F.lit(">>>>>>> UPDATED"), F.lit(1)), F.lit(">>>>>>>"), F.lit(1))
    body = F.when(body.startswith("```"), F.substring(body, 4, 1 << 30)).otherwise(body)
    return T.trim_tail(T.lines(F.replace(F.replace(body, F.lit(REGION[2]), F.lit("")), F.lit(CURSOR), F.lit(""))))


def midtyping(key: Column, old: Column, new: Column) -> tuple[Column, Column, Column]:
    """(old region cut at a partly typed line, cursor line, what is left to type), by the key's hash."""
    fd = F.least(first_difference(old, new), F.greatest(F.size(new) - 1, F.lit(0)))
    first = F.coalesce(F.get(new, fd), F.lit(""))
    share = 0.3 + 0.3 * T.unit(key)
    cut = F.when(F.length(first) > 0, F.greatest(F.lit(1), F.floor(F.length(first) * share).cast("int"))).otherwise(0)
    changed = F.aggregate(F.transform(new, lambda x, i: F.when((i >= fd) & ~F.array_contains(old, x), i).otherwise(-1)), F.lit(-1), lambda a, x: F.greatest(a, x))
    last = F.greatest(changed, fd)
    typed = F.concat(F.slice(old, 1, fd), F.array(F.substring(first, F.lit(1), cut)))
    rest = F.concat(F.array(F.substring(first, cut + 1, F.length(first))), F.slice(new, fd + 2, F.greatest(last - fd, F.lit(0))))
    return typed, fd, rest


def fim(source: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """(prompt, target) of a span of bytes [start, end): suffix, prefix, middle; null where a marker occurs in the text."""
    s = F.replace(source, F.lit("\r\n"), F.lit("\n")).cast("binary")
    cut = lambda a, n: F.decode(F.substring(s, a + 1, n), "UTF-8")
    clash = source.rlike("<\\[fim-(suffix|prefix|middle)\\]>")
    prompt = F.concat(F.lit("<[fim-suffix]>"), cut(end, F.octet_length(s)), F.lit("<[fim-prefix]>"), cut(F.lit(0), start), F.lit("<[fim-middle]>"))
    return F.when(~clash, prompt), F.when(~clash, cut(start, end - start))


def causal(prompt: Column, target: Column) -> Column:
    """A suffix-prefix-middle row as a plain document again."""
    tail = F.regexp_extract(prompt, r"(?s)^<\[fim-suffix\]>(.*)<\[fim-prefix\]>(.*)<\[fim-middle\]>$", 1)
    head = F.regexp_extract(prompt, r"(?s)^<\[fim-suffix\]>(.*)<\[fim-prefix\]>(.*)<\[fim-middle\]>$", 2)
    return F.concat(head, target, tail)


HUNK = "array<struct<old_start:int,old_count:int,new_start:int,new_count:int,lines:array<string>>>"


def hunks(diff: Column) -> Column:
    """Hunks of a unified diff of one file."""
    head = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
    parts = F.filter(F.split(F.concat(F.lit("\n"), diff), "\n(?=@@ )"), lambda p: p.startswith("@@ "))
    number = lambda p, i: F.coalesce(F.expr("try_cast(null as int)"), F.when(F.regexp_extract(p, head, i) == "", 1).otherwise(F.regexp_extract(p, head, i).cast("int")))
    body = lambda p: F.transform(F.filter(F.slice(T.lines(p), 2, 1 << 20), lambda x: (x == "") | x.rlike("^[-+ ]")), lambda x: F.when(x == "", " ").otherwise(x))
    return F.transform(parts, lambda p: F.struct(number(p, 1).alias("old_start"), number(p, 2).alias("old_count"), number(p, 3).alias("new_start"), number(p, 4).alias("new_count"), body(p).alias("lines")))


def hunk_counts(lines: Column) -> tuple[Column, Column]:
    """(added, removed) lines of a hunk."""
    return F.size(F.filter(lines, lambda x: x.rlike(r"^\+(?!\+\+)"))), F.size(F.filter(lines, lambda x: x.rlike("^-(?!--)")))


def budget_front(lines: Column, budget: int) -> Column:
    """Lines from the end on whose characters, with line ends, fit a budget; in their order."""
    kept = F.aggregate(F.reverse(lines), F.struct(F.lit(0).alias("n"), F.lit(0).alias("used"), F.lit(True).alias("open")), lambda a, x: F.struct(F.when(a["open"] & (a["used"] + F.length(x) + 1 <= budget), a["n"] + 1).otherwise(a["n"]).alias("n"), F.when(a["open"] & (a["used"] + F.length(x) + 1 <= budget), a["used"] + F.length(x) + 1).otherwise(a["used"]).alias("used"), (a["open"] & (a["used"] + F.length(x) + 1 <= budget)).alias("open")))
    n = kept["n"]
    return F.slice(lines, F.greatest(F.size(lines) - n + 1, F.lit(1)), n)


def renamed(before: Column, after: Column) -> Column:
    """Names that come in by an edit, sorted."""
    names = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"[A-Za-z.][A-Za-z0-9._]*"), F.lit(0)))
    return F.array_sort(F.array_except(names(after), names(before)))
