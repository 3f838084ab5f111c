"""Members of the case registries: selectors, validators, row checks and transforms over R sources.

Selectors and transforms give rows of `scenarios.PLACE` with a key. Validators are columns of reasons
(null passes) over a target; those that need tokens run once over Arrow batches. Checks are columns
over built rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import text as T
from .operators import rlex, sampling, scenarios, selection
from .operators.scenarios import Source, _clean, _row
from .plans.registry import plugin

# Which calls do input or output, which guard, and what a helper's first argument is.
IO_CALLS = {"read.csv", "read.table", "readRDS", "readLines", "read_csv", "readr::read_csv", "load", "source", "download.file", "url", "file", "writeLines", "write.csv", "saveRDS", "fromJSON", "GET", "POST", "dbConnect"}
GUARDS = {"tryCatch", "try", "withCallingHandlers", "safely", "possibly"}
FIRST_ARGUMENT = {"starts_with": "string", "ends_with": "string", "contains": "string", "matches": "string", "num_range": "string", "all_of": "vector", "any_of": "vector", "everything": "", "last_col": "numeric", "where": "predicate"}
OPENERS = "(,= +|>%$@-!&:"


def keyed(rows: DataFrame) -> DataFrame:
    """Rows with `key` and `corpus_target`: what specs need of a selector."""
    return rows.withColumn("key", F.concat_ws(":", "package", "path", "line", F.md5(F.array_join("region_new", "\n")))).withColumn("corpus_target", F.array_join("region_new", "\n"))


def _selector(name: str, *families: str):
    """Register a selector of scenario families; `per_file` caps rows of a file by the hash of their keys."""
    @plugin("selector", name)
    def select(corpus: DataFrame, per_file: int | None = None) -> DataFrame:
        rows = reduce(lambda a, b: a.unionByName(b), [scenarios.scenario_table(corpus, f) for f in families])
        rows = keyed(rows)
        return rows if per_file is None else sampling.hash_ranked(rows, ["package", "path"], "key", name).where(F.col("__r") <= per_file).drop("__r")

    return select


_selector("c2c_cache_blocks", "comment_free_block")
_selector("tidyselect_helpers", "tidyselect_helpers")
_selector("pipe_chain_links", "pipe_chain_link")
_selector("trycatch_handlers", "trycatch_handlers")
_selector("removed_block_sites", "removed_block")
_selector("pkg_metadata", "namespace_entry", "description_entry")
_selector("roxygen_blocks", "roxygen_drafting", "mid_roxygen")


@plugin("selector", "mid_body_sites")
def mid_body_sites(corpus: DataFrame, n: int | None = None) -> DataFrame:
    """mid_body_edit rows; n of them in rotation over the kinds, scarce ones first."""
    rows = keyed(scenarios.scenario_table(corpus, "mid_body_edit"))
    return rows if n is None else selection.by_priority(rows, "kind", ["na_rm_insert", "rename_once", "arg_edit", "insert_line"], ["key"], n)


def _sites(source: str, rule: str) -> Iterator[dict]:
    s = Source(source)
    for x in rlex.RULES[rule][1](s.text):
        line = x["line"]
        at, end = x["start"] - s.starts[line], min(x["end"], s.starts[line + 1] - 1) - s.starts[line]
        if x["end"] < s.starts[line + 1]:
            rest = s.lines[line][end:]
            yield s, line, at, end, rest


def _qualifiers(source: str) -> Iterator[dict]:
    """pkg::name( uses: the package is stripped off the line above the cursor, and to be written again with the rest of the line."""
    for s, line, at, end, rest in _sites(source, "namespace_qualify"):
        if s.lines[line][end : end + 1] == "(" and s.lines[line][:at].strip():
            text = s.lines[line][at:]
            yield _row("namespace_qualify", s.lines, line, [""], [text], kind=text.split("::")[0], prefix=[*s.lines[max(0, line - 10) : line], s.lines[line][:at]], suffix=s.lines[line + 1 : line + 11])


def _expect(source: str) -> Iterator[dict]:
    """expect_ calls on one line, cut after expect_ or after the opening bracket."""
    for s, line, at, end, _ in _sites(source, "testthat"):
        text = s.lines[line][at:end]
        cut = len("expect_") if scenarios.draw(text, 2) else text.index("(") + 1
        yield _row("testthat_expectation", s.lines, line, [""], [text[cut:]], kind="name" if cut == 7 else "arguments", prefix=[*s.lines[max(0, line - 10) : line], s.lines[line][: at + cut]], suffix=s.lines[line + 1 : line + 11])


@plugin("selector", "namespace_qualifiers")
def namespace_qualifiers(corpus: DataFrame) -> DataFrame:
    return keyed(scenarios.with_event(rlex.extracted(corpus, _qualifiers, scenarios.PLACE, "::")))


@plugin("selector", "testthat_expectations")
def testthat_expectations(corpus: DataFrame) -> DataFrame:
    return keyed(scenarios.with_event(rlex.extracted(corpus, _expect, scenarios.PLACE, "expect_")))


@plugin("selector", "astfim_partial_rows")
def astfim_partial_rows(corpus: DataFrame, most: int = 3) -> DataFrame:
    """removed blocks of which the first lines are typed again above the cursor."""
    rows = removed = keyed(scenarios.scenario_table(corpus, "removed_block"))
    rows = scenarios.partial_spans(removed, "key", "region_new", most)
    return rows.withColumns({"prefix": F.concat("prefix", "partial"), "region_new": F.col("remaining"), "corpus_target": F.array_join("remaining", "\n")}).drop("remaining")


# --- validators -------------------------------------------------------------------------------


def fragment(text: str | None) -> dict:
    """What a piece of code is: whether its brackets match and no operator is left open, its statements, its one call's name and first argument."""
    out = {"clean": False, "statements": 0, "callee": None, "first": None, "whole_call": False}
    if text is None or not text.strip():
        return out
    s = Source("{\n" + text + "\n}")
    code = [s.tokens[i] for i in s.code]
    last = code[-2] if len(code) > 2 else None
    words = ("name", "number", "string", "quoted")
    loose = any(a.kind in words and b.kind in words and a.line == b.line and not {a.text, b.text} & scenarios.RESERVED for a, b in zip(code, code[1:], strict=False))
    out["clean"] = last is not None and _clean(s.lines) and s.tokens[0].mate == len(s.tokens) - 1 and last.kind not in ("op", "sep") and not loose
    inside = s.statements(0) if out["clean"] else []
    out["statements"] = len(inside)
    if len(inside) == 1:
        at, end = inside[0]
        calls = [(i, o, e) for i, o, e in s.calls() if e == end and (i == at or (s.near(at, 1) is not None and s.near(at, 1).text == "::" and s.code[s.place[at] + 2] == i))]
        if calls:
            i, o, e = calls[0]
            arg = [s.tokens[k] for k in s.code if o < k < e]
            if len(arg) > 1 and arg[1].text == "=":
                arg = arg[2:]
            kind = None if not arg else "call" if len(arg) > 1 and arg[0].kind == "name" and arg[1].text in ("(", "::") else arg[0].kind
            out |= {"callee": s.tokens[i].text, "first": kind, "whole_call": True}
    return out


def fragments(c: Column) -> Column:
    """fragment() of a column, as a struct."""
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([fragment(t) for t in texts], columns=["clean", "statements", "callee", "first", "whole_call"])

    return F.pandas_udf(run, "clean boolean, statements int, callee string, first string, whole_call boolean")(c)


def _reasons(*rules: tuple[Column, str]) -> Column:
    return reduce(lambda rest, r: F.when(r[0], r[1]).otherwise(rest), reversed(rules), F.lit(None).cast("string"))


def _blank(c: Column) -> Column:
    return T.strip(F.coalesce(c, F.lit(""))) == ""


def _lines(c: Column) -> Column:
    return F.size(F.split(c, "\n"))


@plugin("validator", "r_fragment")
def r_fragment(c: Column, least: int = 1, most: int = 10, max_lines: int = 25) -> Column:
    f = fragments(c)
    return _reasons((_blank(c), "empty target"), (_lines(T.rstrip(c)) > max_lines, "too many lines"), (~f["clean"], "does not parse"), (~f["statements"].between(least, most), "number of statements"))


@plugin("validator", "tidyselect_call")
def tidyselect_call(c: Column, max_len: int = 120) -> Column:
    t = T.strip(c)
    f = fragments(t)
    need = F.create_map(*[F.lit(x) for kv in FIRST_ARGUMENT.items() for x in kv])[f["callee"]]
    fits = F.when(need == "string", f["first"] == "string").when(need == "vector", f["first"].isin("call", "name")).when(need == "numeric", f["first"].isin("number", "name", "call")).when(need == "predicate", f["first"].isin("name", "call")).otherwise(True)
    return _reasons((_blank(c), "empty completion"), (F.length(t) > max_len, "too long"), (F.contains(t, F.lit("\n")), "more than one line"), (~f["clean"], "does not parse"), (~f["whole_call"], "not one call"), (need.isNull(), "no helper"), (f["first"].isNull(), "no arguments"), (~F.coalesce(fits, F.lit(False)), "first argument"))


@plugin("validator", "pipe_link")
def pipe_link(c: Column, max_len: int = 220) -> Column:
    t = T.strip(c)
    body = T.rstrip(F.regexp_replace(t, r"(?:%>%|\|>)\s*$", ""))
    whole, tail = fragments(body), fragments(F.concat(F.lit("f("), body))
    return _reasons((_blank(c), "empty completion"), (F.length(t) > max_len, "too long"), (body == "", "only a pipe"), (~((whole["clean"] & whole["whole_call"]) | tail["clean"]), "not one call"))


@plugin("validator", "expect_call_tail")
def expect_call_tail(c: Column, max_len: int = 220) -> Column:
    t = T.strip(c)
    whole, tail = fragments(t), fragments(F.concat(F.lit("f("), t))
    return _reasons((_blank(c), "empty completion"), (F.length(t) > max_len, "too long"), (~((whole["clean"] & whole["whole_call"]) | tail["clean"]), "not a tail of a call"))


def _handlers_ok(text: str | None) -> bool:
    """Whether text closes a tryCatch with named handlers, functions of one argument but for finally."""
    for tail in ("", ")"):
        whole = f"tryCatch({{\n1\n}}, {text}{tail}"
        if not fragment(whole)["clean"]:
            continue
        s = Source(whole)
        top = [k for k in s.code if s.tokens[k].depth == 1]
        cuts = [k for k in top if s.tokens[k].text == ","]
        for a, b in zip(cuts, [*cuts[1:], s.tokens[1].mate], strict=True):
            part = [s.tokens[k] for k in s.code if a < k < b]
            if len(part) < 3 or part[1].text != "=" or part[0].text not in ("error", "warning", "message", "finally"):
                return False
            if part[0].text != "finally" and part[2].text in ("function", "\\"):
                p = part[3]
                if sum(x.kind == "name" and x.depth == p.depth + 1 for x in s.tokens[s.tokens.index(p) + 1 : p.mate]) != 1:
                    return False
            elif part[0].text != "finally":
                return False
        return bool(cuts)
    return False


@plugin("validator", "handler_clauses")
def handler_clauses(c: Column, max_len: int = 500) -> Column:
    ok = F.pandas_udf(lambda t: t.map(_handlers_ok), "boolean")(T.strip(c))
    return _reasons((_blank(c), "empty completion"), (F.length(T.strip(c)) > max_len, "too long"), (~ok, "not handler clauses"))


@plugin("validator", "mid_body_edit_line")
def mid_body_edit_line(c: Column, max_lines: int = 3, max_len: int = 220) -> Column:
    t = F.trim(c, F.lit("\n"))
    f = fragments(t)
    return _reasons((_blank(c), "empty completion"), (_lines(t) > max_lines, "too many lines"), (F.exists(F.split(t, "\n"), lambda x: F.length(x) > max_len), "too long"), (~f["clean"], "does not parse"), (f["statements"] != 1, "number of statements"))


# --- row checks -------------------------------------------------------------------------------


def _tail() -> Column:
    return T.rstrip(F.coalesce(F.element_at("prefix", -1), F.lit("")))


def _equals_corpus() -> Column:
    solid = lambda c: F.filter(F.transform(F.split(c, "\n"), T.strip), lambda x: x != "")
    return F.coalesce(solid(F.col("model_target")) == solid(F.col("corpus_target")), F.lit(False))


@plugin("check", "mid_expression")
def mid_expression(df: DataFrame) -> Column:
    """The prefix ends within an expression."""
    return (_tail() != "") & F.contains(F.lit(OPENERS), F.right(_tail(), F.lit(1)))


@plugin("check", "pipe_cut_cursor")
def pipe_cut_cursor(df: DataFrame) -> Column:
    return (_tail().endswith("%>%") | _tail().endswith("|>") | _tail().endswith("(")) & _equals_corpus()


@plugin("check", "expect_cut_cursor")
def expect_cut_cursor(df: DataFrame) -> Column:
    return (_tail().endswith("expect_") | _tail().endswith("(") | F.rtrim(_tail(), F.lit(",")).endswith("expect_")) & _equals_corpus()


@plugin("check", "handler_cut_cursor")
def handler_cut_cursor(df: DataFrame) -> Column:
    return F.right(_tail(), F.lit(1)).isin(",", "}", "{") & F.get("region_new", F.lit(0)).rlike(r"^\s*(error|warning|message|finally)\s*=") & _equals_corpus()


@plugin("check", "qualified_call_cursor")
def qualified_call_cursor(df: DataFrame) -> Column:
    """The target begins with its package, the line above the cursor does not hold it, and both make the corpus line."""
    p, head = F.concat("kind", F.lit("::")), F.element_at("prefix", -1)
    return F.get("region_new", F.lit(0)).startswith(p) & ~F.contains(head, p) & (T.rstrip(F.concat(head, F.get("region_new", F.lit(0)))) == T.rstrip(F.col("corpus_line")))


@plugin("check", "sorted_entry_slot")
def sorted_entry_slot(df: DataFrame) -> Column:
    """A metadata entry lies strictly between its neighbours of the same kind."""
    ns = F.col("kind").startswith("namespace:")
    word = F.split_part("kind", F.lit(":"), F.lit(2))
    entry = lambda x: F.when(ns, F.lower(F.regexp_replace(F.regexp_extract(x, r"^\s*\w+\(([^)]*)\)", 1), r"[\s\"'`]", ""))).otherwise(F.lower(F.regexp_extract(x, r"^\s*([A-Za-z][\w.]*)", 1)))
    mine = lambda c: F.filter(c, lambda x: F.when(ns, F.regexp_extract(x, r"^\s*(\w+)\(", 1) == word).otherwise(x.rlike(r"^\s*[A-Za-z][\w.]*\s*(\([^)]*\))?\s*,?\s*$")))
    key = entry(F.get("region_new", F.lit(0)))
    inline = F.element_at(F.filter(F.split(F.regexp_replace(F.element_at("prefix", -1), "^Imports:", ""), ","), lambda x: T.strip(x) != ""), -1)
    above = F.when(ns, F.element_at(mine(F.col("prefix")), -1)).otherwise(T.strip(inline))
    below = F.get(mine(F.col("suffix")), F.lit(0))
    own_line = ns | F.get("region_new", F.lit(0)).rlike(r"^\s")
    return (key != "") & F.coalesce(entry(above) < key, F.lit(True)) & (~own_line | F.coalesce(key < entry(below), F.lit(True)))


@plugin("check", "astfim_partial_site")
def astfim_partial_site(df: DataFrame) -> Column:
    """One to three lines are typed again at the prefix's end, and the rest of the span is to come."""
    k = F.col("k")
    return k.between(1, 3) & (F.size("partial") == k) & (F.slice("prefix", F.size("prefix") - k + 1, k) == F.col("partial")) & F.exists("region_new", lambda x: T.strip(x) != "") & (F.array_join("region_new", "\n") == F.col("corpus_target"))


def _below() -> Column:
    """The function's end and a statement before it are below."""
    return F.exists("suffix", lambda x: T.strip(x) == "}") & F.exists("suffix", lambda x: ~T.strip(x).isin("", "}"))


@plugin("check", "removed_block_site")
def removed_block_site(df: DataFrame) -> Column:
    """A block of 3 to 8 whole lines under a marker comment, with the function's end below."""
    f = fragments(F.array_join("region_new", "\n"))
    return F.size("region_new").between(3, 8) & (F.array_join("region_new", "\n") == F.col("corpus_target")) & f["clean"] & f["statements"].between(1, 8) & F.ltrim(_tail()).rlike("^#(?!')") & _below()


@plugin("check", "mid_body_edit_site")
def mid_body_edit_site(df: DataFrame) -> Column:
    """One changed line of the kind that it claims to be, within a function whose end is below."""
    new, old = F.get("region_new", F.lit(0)), F.get("region_old", F.lit(0))
    added = F.replace(new, F.lit(", na.rm = TRUE"), F.lit(""))
    number = r"(?<![\w.])\d+(?:\.\d+)?L?|TRUE|FALSE"
    name = r"[A-Za-z.][A-Za-z0-9._]*"
    one = lambda p: (F.regexp_replace(new, p, "#") == F.regexp_replace(old, p, "#")) & (F.size(F.filter(F.zip_with(F.regexp_extract_all(new, F.lit(p), F.lit(0)), F.regexp_extract_all(old, F.lit(p), F.lit(0)), lambda a, b: a != b), lambda x: x)) == 1)
    kind = F.when(F.col("kind") == "arg_edit", one(number)).when(F.col("kind") == "na_rm_insert", (added == old) & (new != old)).when(F.col("kind") == "rename_once", one(name)).when(F.col("kind") == "insert_line", F.size("region_old") == 0)
    return (F.size("region_new") == 1) & (T.strip(new) != "") & (F.length(new) <= 220) & F.coalesce(kind, F.lit(False)) & (T.strip(_tail()) != "") & _below()


# --- transforms -------------------------------------------------------------------------------


def _both_ways(source: str) -> Iterator[dict]:
    """comment_pairs, and each the other way round: the code is there, its comment is to be written."""
    for r in scenarios.comment_pairs(source):
        yield r
        yield r | {"family": "comment_drafting", "kind": "reverse", "prefix": r["prefix"][:-1], "region_new": [r["prefix"][-1]], "suffix": r["region_new"]}


def _marked_removal(source: str) -> Iterator[dict]:
    """removed_blocks with a comment that names the calls of the block in its place."""
    for r in scenarios.removed_blocks(source):
        names = list(dict.fromkeys(re.findall(r"([A-Za-z.][\w.]*)\s*\(", "\n".join(r["region_new"]))))
        indent = re.match(r"\s*", r["region_new"][0]).group()
        yield r | {"prefix": [*r["prefix"], f"{indent}# {', '.join(n for n in names[:3] if n not in scenarios.RESERVED) or 'continue'}"]}


def _second_qualifier(source: str) -> Iterator[dict]:
    """A package that qualifies names on two lines: the second use is stripped, and to be qualified after the first."""
    seen: dict[str, int] = {}
    for s, line, at, end, rest in _sites(source, "namespace_qualify"):
        pkg = s.lines[line][at:end].split("::")[0]
        if pkg in seen and seen[pkg] >= 0 and line != seen[pkg]:
            bare = s.edited(line, at, at + len(pkg) + 2, "")
            first, seen[pkg] = seen[pkg], -1
            yield _row("namespace_qualify_propagation", s.lines, line, [bare], [s.lines[line]], kind=pkg, cursor=at, event=(first + 1, [s.lines[first].replace(f"{pkg}::", "", 1)], [s.lines[first]]))
        seen.setdefault(pkg, line)


def _examples(source: str) -> Iterator[dict]:
    """@examples of three code lines or more: the first are typed, the next one to three are to come."""
    s = Source(source)
    for name, _, e, _, docs in scenarios._documented(s):
        tag = next((i for i in docs if re.match(r"\s*#'\s*@examples\b", s.lines[i])), None)
        code = [] if tag is None else [i for i in docs if i > tag]
        stop = next((k for k, i in enumerate(code) if re.match(r"\s*#'\s*@", s.lines[i])), len(code))
        code = code[:stop]
        if len(code) < 3 or any(not re.sub(r"^\s*#'\s?", "", s.lines[i]).strip() for i in code):
            continue
        k = 1 + scenarios.draw(s.lines[code[0]], len(code) - 2)
        m = 1 + scenarios.draw(s.lines[code[k]], min(3, len(code) - k))
        target = [s.lines[i] for i in code[k : k + m]]
        if fragment("\n".join(re.sub(r"^\s*#'\s?", "", x) for x in target))["clean"]:
            yield _row("roxygen_examples", s.lines, code[k], [""], target, kind=str(k), prefix=s.lines[docs[0] : code[k]], suffix=s.lines[code[k] + m : s.tokens[e].line + 7])


def _loops(source: str) -> Iterator[dict]:
    """for (i in seq_along(x)) { r[[i]] <- f(x[[i]]) } as lapply and as a map: only loops that do nothing else, are not nested, and whose index is used only to take elements and not after."""
    s = Source(source)
    for i in s.code:
        p = s.near(i, 1)
        if s.tokens[i].text != "for" or p is None or p.text != "(" or p.mate < 0:
            continue
        head = re.fullmatch(r"\(\s*([A-Za-z.][\w.]*)\s+in\s+(?:seq_along\(\s*([A-Za-z.][\w.]*)\s*\)|seq_len\(\s*length\(\s*([A-Za-z.][\w.]*)\s*\)\s*\))\s*\)", s.text[p.at : s.tokens[p.mate].at + 1])
        o = s.near(p.mate, 1)
        around = [b for b in s.bodies() if b[1] < i < b[2]]
        if head is None or o is None or o.text != "{" or not around or any(s.tokens[k].text in ("for", "while", "repeat", "break", "next") for k in s.code if around[0][1] < k < o.mate and k != i):
            continue
        var, seq = head.group(1), head.group(2) or head.group(3)
        at = s.code[s.place[p.mate] + 1]
        inside, new, names = s.statements(at), [], None
        for a, b in inside:
            text = s.text[s.tokens[a].at : s.tokens[b].at + len(s.tokens[b].text)]
            m = re.fullmatch(r"(names\(\s*)?([A-Za-z.][\w.]*)(\s*\))?\[\[\s*([A-Za-z.][\w.]*)\s*\]\]\s*<-\s*(.+)", text, re.S)
            if m is None or m.group(4) != var or bool(m.group(1)) != bool(m.group(3)):
                new = None
                break
            if m.group(1):
                new, names = (None, None) if names or m.group(5) != f"names({seq})" else (new, m.group(2))
                if new is None:
                    break
            elif re.search(rf"(?<![\w.]){re.escape(var)}(?![\w.])", re.sub(rf"\[\[\s*{re.escape(var)}\s*\]\]", "", m.group(5))):
                new = None
                break
            else:
                new.append((m.group(2), m.group(5)))
        after = [s.tokens[k].text for k in s.code if o.mate < k < around[0][2]]
        if not new or not 1 <= len(inside) <= 2 or var in after:
            continue
        first, last = s.tokens[i].line, s.tokens[o.mate].line
        indent = re.match(r"\s*", s.lines[first]).group()
        for kind, call in (("lapply", "lapply({}, function({}) {})"), ("purrr_map", "purrr::map({}, \\({}) {})")):
            lines = [f"{indent}{r} <- {call.format(seq, var, rhs)}" for r, rhs in new] + ([f"{indent}names({names}) <- names({seq})"] if names else [])
            yield _row("loop_rewrite", s.lines, first, s.lines[first : last + 1], "\n".join(lines).split("\n"), kind=kind, suffix=s.lines[last + 1 : last + 7])


def _wrapped(source: str) -> Iterator[dict]:
    """Bodies with input or output and no guard, wrapped in tryCatch."""
    s = Source(source)
    for f, o, e, _ in s.bodies():
        names = {s.tokens[i].text for i, a, b in s.calls() if o < i < e}
        inside = s.statements(o)
        if not names & IO_CALLS or names & GUARDS or not inside:
            continue
        first, last = s.tokens[inside[0][0]].line, s.tokens[inside[-1][1]].line
        if last >= s.tokens[e].line or first <= s.tokens[o].line:
            continue
        indent = re.match(r"\s*", s.lines[first]).group()
        a, n = s.near(f, -1), s.near(f, -2)
        where = f" in {n.text}" if n is not None and a.text in ("<-", "=") and n.kind == "name" else ""
        body = [indent + "  " + x.removeprefix(indent) if x.strip() else x for x in s.lines[first : last + 1]]
        new = [f"{indent}tryCatch({{", *body, f"{indent}}}, error = function(e) {{", f'{indent}  stop("failed{where}: ", conditionMessage(e))', f"{indent}}})"]
        yield _row("trycatch_wrap", s.lines, first, s.lines[first : last + 1], new, kind=",".join(sorted(names & IO_CALLS)), suffix=s.lines[last + 1 : s.tokens[e].line + 7])


#: Transform -> (pattern that a file must hold, extractor).
TRANSFORMS = {
    "comment_pair": ("#", _both_ways),
    "removed_block": ("function|\\\\", _marked_removal),
    "namespace_qualify": ("::", _second_qualifier),
    "examples_completion": ("@examples", _examples),
    "loop_to_apply": (r"\bfor\s*\(", _loops),
    "trycatch_wrap": ("|".join(re.escape(x) for x in sorted(IO_CALLS)), _wrapped),
}


def _transform(name: str, pattern: str, extract) -> None:
    @plugin("transform", name)
    def transform(corpus: DataFrame) -> DataFrame:
        return keyed(scenarios.with_event(rlex.extracted(corpus, extract, scenarios.PLACE, pattern)))


for _name, (_pattern, _extract) in TRANSFORMS.items():
    _transform(_name, _pattern, _extract)

for _kind in ("arg_edit", "na_rm_insert", "rename_once", "insert_line"):
    @plugin("transform", f"mbe_{_kind}")
    def _mbe(corpus: DataFrame, kind: str = _kind) -> DataFrame:
        return keyed(scenarios.scenario_table(corpus, "mid_body_edit")).where(F.col("kind") == kind)


@plugin("transform", "astfim_partial")
def astfim_partial(corpus: DataFrame) -> DataFrame:
    return astfim_partial_rows(corpus)


def base_samples(functions: DataFrame, per_package: int, total: int, seed: int = 0) -> DataFrame:
    """Functions to derive from: `per_package` of each package by hash order, `total` in all, with an id that names the function."""
    ids = functions.withColumn("base_sample_id", F.sha1(F.concat_ws("|", "package", "path", "name", "line")))
    ranked = sampling.hash_ranked(ids, ["package"], "base_sample_id", seed).where(F.col("__r") <= per_package)
    return ranked.orderBy("__r", "package").limit(total).drop("__r")


def transformed(corpus: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Rows of all transforms, with `transform`."""
    from .plans.registry import get

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [get("transform", n)(corpus).withColumn("transform", F.lit(n)) for n in names or [*TRANSFORMS, "astfim_partial", *(f"mbe_{k}" for k in ("arg_edit", "na_rm_insert", "rename_once", "insert_line"))]])
