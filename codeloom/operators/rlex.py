"""A small lexer for R, and extractors over source files that need no full parser.

Extractors are mapped over rows of (package, path, source) by Arrow batches; each gives a row for
every site that it finds. A cheap pattern comes first, so that files without a site never reach Python.
What needs a full parser (argument matching, scoping) is not approximated here.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"""
 (?P<comment>\#[^\n]*)
|(?P<raw>[rR]["'](?P<dash>-*)[(\[{].*?[)\]}](?P=dash)["'])
|(?P<string>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')
|(?P<quoted>`[^`]*`)
|(?P<number>0[xX][0-9a-fA-F]+L?|(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?[Li]?)
|(?P<name>(?:[^\W\d_]|\.(?!\d))[\w.]*)
|(?P<op>%[^%\n]*%|<<-|->>|\|>|<-|->|<=|>=|==|!=|&&|\|\||:::|::|:=|\\|[-+*/^<>=!&|~?:$@])
|(?P<open>[(\[{])
|(?P<close>[)\]}])
|(?P<sep>[,;])
|(?P<newline>\n)
|(?P<space>[^\S\n]+)
|(?P<other>.)
""", re.X | re.S)


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    at: int
    line: int
    mate: int = -1  # index of the matching bracket
    depth: int = 0


def lex(source: str) -> list[Token]:
    """Tokens without blanks, with brackets matched; a bracket without its mate has -1."""
    out, stack, line = [], [], 0
    for m in TOKEN.finditer(source):
        kind = "string" if m.lastgroup == "raw" or m.group("raw") else m.lastgroup
        text = m.group()
        if kind != "space":
            t = Token(kind, text, m.start(), line, -1, len(stack))
            if kind == "open":
                stack.append(len(out))
            elif kind == "close" and stack:
                t.mate = stack.pop()
                out[t.mate].mate = len(out)
                t.depth = len(stack)
            out.append(t)
        line += text.count("\n")
    return out


def code(tokens: list[Token]) -> list[int]:
    """Indexes of tokens that are neither comments nor line ends."""
    return [i for i, t in enumerate(tokens) if t.kind not in ("comment", "newline")]


def _dead(inner: list[Token]) -> int:
    """Names that a body assigns once or more and never reads."""
    c = [x for x in inner if x.kind not in ("comment", "newline")]
    written, read = set(), set()
    for x, n in zip(c, [*c[1:], None], strict=False):
        if x.kind == "name":
            (written if n is not None and n.text in ("<-", "=") and x.depth == c[0].depth else read).add(x.text)
    last = c[-1].text if c else ""
    return len(written - read - {last})


def functions(source: str) -> Iterator[dict]:
    """Functions assigned at the top level: name, lines from 0, documentation above, body span, and measures."""
    t = lex(source)
    c = code(t)
    lines = source.split("\n")
    for k in range(len(c) - 3):
        a, b, f, p = (t[c[k + i]] for i in range(4))
        if a.depth or a.kind not in ("name", "quoted") or b.text not in ("<-", "=", "<<-") or f.text not in ("function", "\\") or p.text != "(" or p.mate < 0:
            continue
        after = [i for i in c if i > p.mate]
        if not after or t[after[0]].text != "{" or t[after[0]].mate < 0:
            continue
        o, e = t[after[0]], t[t[after[0]].mate]
        docs = []
        at = a.line - 1
        while at >= 0 and lines[at].lstrip().startswith("#'"):
            docs.insert(0, lines[at].strip())
            at -= 1
        inner = t[after[0] + 1 : o.mate]
        words = sum(len(re.findall(r"\w+", d)) for d in docs)
        body = [x.strip() for x in lines[o.line + 1 : e.line] if x.strip()]
        yield {
            "name": a.text.strip("`"), "line": a.line, "end_line": e.line, "body_start": o.at, "body_end": e.at + 1, "signature": source[a.at : o.at].strip(), "doc": "\n".join(docs),
            "rich": words >= 12 or any(re.search("@param|@return", d) for d in docs),
            "cyclomatic": 1 + sum(x.text in ("if", "for", "while", "repeat", "&&", "||") for x in inner),
            "nesting": max((x.depth - o.depth - 1 for x in inner if x.kind == "open" and x.text == "{"), default=0),
            "body_lines": len(body), "dup_lines": len(body) - len(set(body)),
            "magic": sum(x.kind == "number" and x.text.rstrip("L") not in ("0", "1", "2") for x in inner),
            "dead": _dead(inner),
        }


def spans(source: str) -> Iterator[dict]:
    """Candidate spans: function bodies, top-level blocks and argument lists."""
    t = lex(source)
    for f in functions(source):
        yield {"kind": "function_body", "start": f["body_start"] + 1, "end": f["body_end"] - 1}
    for i, x in enumerate(t):
        if x.kind == "open" and x.mate >= 0:
            if x.text == "{" and not x.depth:
                yield {"kind": "top_level_block", "start": x.at, "end": t[x.mate].at + 1}
            elif x.text == "(" and i and t[i - 1].kind in ("name", "quoted") and t[i - 1].text not in ("if", "for", "while", "function"):
                yield {"kind": "argument_list", "start": x.at + 1, "end": t[x.mate].at}


def picked(candidates: list[dict], most: int = 4, reserved: str = "argument_list") -> list[dict]:
    """Largest first, none overlapping, `most` at most, with a place kept for one kind."""
    out: list[dict] = []
    for s in sorted(candidates, key=lambda s: (s["start"] - s["end"], s["start"])):
        last = most - (0 if s["kind"] == reserved or any(x["kind"] == reserved for x in out) else 1)
        if len(out) < last and s["end"] > s["start"] and all(s["end"] <= x["start"] or s["start"] >= x["end"] for x in out):
            out.append(s)
    return sorted(out, key=lambda s: s["start"])


def _site(t: Token, end: int, rule: str, new: str) -> dict:
    return {"rule": rule, "line": t.line, "start": t.at, "end": end, "rewrite": new}


def pipes(source: str) -> Iterator[dict]:
    """Magrittr pipes and the base pipe in their place."""
    for x in lex(source):
        if x.text == "%>%":
            yield _site(x, x.at + 3, "pipe", "|>")


def true_false(source: str) -> Iterator[dict]:
    """T and F as values, unless the file assigns them."""
    t = lex(source)
    c = [t[i] for i in code(t)]
    taken = {a.text for a, b in zip(c, c[1:], strict=False) if b.text in ("<-", "<<-", "=") and not a.depth} | {b.text for a, b in zip(c, c[1:], strict=False) if a.text in ("->", "->>")}
    for p, x, n in zip([None, *c], c, [*c[1:], None], strict=False):
        if x.kind == "name" and x.text in "TF" and x.text not in taken and (n is None or n.text not in ("(", "=", "<-", "::", "$", "@", "in")) and (p is None or p.text not in ("$", "@", "::", ":::")):
            yield _site(x, x.at + 1, "tf_true_false", "TRUE" if x.text == "T" else "FALSE")


def seq_along(source: str) -> Iterator[dict]:
    """1:length(x) and its like."""
    t = lex(source)
    c = code(t)
    for k in range(len(c) - 3):
        a, b, f, p = (t[c[k + i]] for i in range(4))
        before = t[c[k - 1]].text if k else ""
        if a.text in ("1", "1L") and b.text == ":" and f.text in ("length", "nrow", "ncol", "NROW", "NCOL") and p.text == "(" and p.mate >= 0 and before not in ("-", "+", "*", "/", "^", ":"):
            inner = source[p.at + 1 : t[p.mate].at]
            yield _site(a, t[p.mate].at + 1, "seq_along_replace", f"seq_along({inner})" if f.text == "length" else f"seq_len({f.text}({inner}))")


def paste_empty(source: str) -> Iterator[dict]:
    """paste(..., sep = "") as paste0(...)."""
    t = lex(source)
    c = code(t)
    for k in range(len(c) - 1):
        f, p = t[c[k]], t[c[k + 1]]
        if f.text == "paste" and p.text == "(" and p.mate >= 0:
            m = re.search(r",\s*sep\s*=\s*(\"\"|'')\s*$", source[p.at : t[p.mate].at])
            if m:
                yield _site(f, t[p.mate].at + 1, "paste_sep_empty", "paste0" + source[p.at : p.at + m.start()] + ")")


def class_inherits(source: str) -> Iterator[dict]:
    """class(x) == "a" as inherits(x, "a")."""
    t = lex(source)
    c = code(t)
    for k in range(len(c) - 1):
        f, p = t[c[k]], t[c[k + 1]]
        if f.text == "class" and p.text == "(" and p.mate >= 0:
            rest = [i for i in c if i > p.mate][:3]
            if len(rest) >= 2 and t[rest[0]].text in ("==", "!=") and t[rest[1]].kind == "string" and (len(rest) < 3 or t[rest[2]].line > t[rest[1]].line or t[rest[2]].kind in ("close", "sep") or t[rest[2]].text in ("&&", "||", "{")):
                s = t[rest[1]]
                yield _site(f, s.at + len(s.text), "class_inherits", f"{'!' * (t[rest[0]].text == '!=')}inherits({source[p.at + 1 : t[p.mate].at]}, {s.text})")


def single_quotes(source: str) -> Iterator[dict]:
    """Single-quoted strings without quotes or escapes inside."""
    for x in lex(source):
        if x.kind == "string" and x.text[0] == "'" and not re.search(r"[\"\\]", x.text):
            yield _site(x, x.at + len(x.text), "single_quote", f'"{x.text[1:-1]}"')


def qualified(source: str) -> Iterator[dict]:
    """pkg::name uses, with the bare name in their place."""
    t = lex(source)
    c = code(t)
    for k in range(len(c) - 2):
        a, b, n = (t[c[k + i]] for i in range(3))
        if a.kind == "name" and b.text == "::" and n.kind in ("name", "quoted"):
            yield _site(a, n.at + len(n.text), "namespace_qualify", n.text)


def expectations(source: str) -> Iterator[dict]:
    """expect_*() calls: the whole call."""
    t = lex(source)
    c = code(t)
    for k in range(len(c) - 1):
        f, p = t[c[k]], t[c[k + 1]]
        if f.text.startswith("expect_") and p.text == "(" and p.mate >= 0:
            yield _site(f, t[p.mate].at + 1, "testthat", source[f.at : t[p.mate].at + 1])


def bare_na(source: str) -> Iterator[dict]:
    """mean() and sd() calls without na.rm."""
    t = lex(source)
    c = code(t)
    for k in range(len(c) - 1):
        f, p = t[c[k]], t[c[k + 1]]
        if f.text in ("mean", "sd") and p.text == "(" and p.mate >= 0 and "na.rm" not in source[p.at : t[p.mate].at]:
            yield _site(f, t[p.mate].at, "na_rm", source[f.at : t[p.mate].at] + ", na.rm = TRUE")


def stopifnot_named(source: str) -> Iterator[dict]:
    """if (!cond) stop("text") as stopifnot("text" = cond): guards of up to three lines, with no else and one string at most."""
    t = lex(source)
    c = code(t)
    for k in range(len(c) - 3):
        i, p, bang = (t[c[k + n]] for n in range(3))
        if i.text != "if" or p.text != "(" or p.mate < 0 or bang.text != "!":
            continue
        rest = [x for x in c if x > p.mate]
        brace = bool(rest) and t[rest[0]].text == "{"
        at = rest[1:] if brace else rest
        if len(at) < 3 or t[at[0]].text != "stop" or t[at[1]].text != "(" or t[at[1]].mate < 0:
            continue
        inner = [x for x in at if at[1] < x < t[at[1]].mate]
        end = t[t[at[1]].mate]
        after = [x for x in at if x > t[at[1]].mate]
        if brace:
            if not after or t[after[0]].text != "}":
                continue
            end, after = t[after[0]], after[1:]
        whole = re.fullmatch(r"!\s*(.+)", source[p.at + 1 : t[p.mate].at].strip(), re.S)
        simple = all(x.depth > bang.depth or x.kind not in ("op",) or x.text in ("$", "@", "::", "!") for x in (t[j] for j in c if c[k + 1] < j < p.mate))
        if len(inner) > 1 or (inner and t[inner[0]].kind != "string") or (after and t[after[0]].text == "else") or end.line - i.line > 2 or not whole or not simple:
            continue
        message = f"{t[inner[0]].text} = " if inner else ""
        yield _site(i, end.at + len(end.text), "stopifnot_named", f"stopifnot({message}{whole.group(1)})")


MASKED = ("filter", "mutate", "summarise", "summarize", "arrange", "group_by", "transmute", "reframe", "count", "distinct", "slice_max", "slice_min", "aes", "if_else", "case_when")


def data_pronoun(source: str) -> Iterator[dict]:
    """.data$name as name, within a call that masks data."""
    t = lex(source)
    c = code(t)
    masked = [(c[k + 1], t[c[k + 1]].mate) for k in range(len(c) - 1) if t[c[k]].text in MASKED and t[c[k + 1]].text == "(" and t[c[k + 1]].mate >= 0]
    for k in range(len(c) - 2):
        a, d, n = (t[c[k + i]] for i in range(3))
        before = t[c[k - 1]].text if k else ""
        if a.text == ".data" and d.text == "$" and n.kind in ("name", "quoted") and before not in ("$", "@", "::") and any(o < c[k] < e for o, e in masked):
            yield _site(a, n.at + len(n.text), "tidyeval_data_pronoun", n.text)


def smells(source: str) -> Iterator[dict]:
    """Functions with branches, nesting or length over the usual limits, as notes; nothing is rewritten."""
    for f in functions(source):
        over = [f"{k}={f[k]}" for k, most in (("cyclomatic", 10), ("nesting", 4), ("body_lines", 40)) if f[k] >= most]
        if over:
            yield {"rule": "smell_metadata", "line": f["line"], "start": f["body_start"], "end": f["body_start"], "rewrite": "; ".join(over)}


def quiet_places(source: str) -> Iterator[dict]:
    """Lines where nothing is to be done: after a closing brace at the top level, or blank between code."""
    lines = source.split("\n")
    for i, x in enumerate(lines[:-1]):
        if x.rstrip() == "}":
            yield {"rule": "after_close_brace", "line": i, "start": 0, "end": 0, "rewrite": ""}
        elif not x.strip() and 0 < i and lines[i - 1].strip() and lines[i + 1].strip():
            yield {"rule": "blank_between", "line": i, "start": 0, "end": 0, "rewrite": ""}


#: Rule -> (pattern that a file must hold, extractor).
RULES: dict[str, tuple[str, Callable]] = {
    "pipe": ("%>%", pipes),
    "tf_true_false": (r"\b[TF]\b", true_false),
    "seq_along_replace": (r"1L?\s*:\s*(length|nrow|ncol|NROW|NCOL)", seq_along),
    "paste_sep_empty": (r"paste\s*\(", paste_empty),
    "class_inherits": (r"class\s*\(", class_inherits),
    "single_quote": ("'", single_quotes),
    "namespace_qualify": ("::", qualified),
    "testthat": ("expect_", expectations),
    "na_rm": (r"\b(mean|sd)\s*\(", bare_na),
    "stopifnot_named": (r"if\s*\(\s*!", stopifnot_named),
    "tidyeval_data_pronoun": (r"\.data\$", data_pronoun),
    "smell_metadata": ("function|\\\\", smells),
    "no_op": ("\n", quiet_places),
}
SITE = "rule string, line int, start int, end int, rewrite string"
FUNCTION = "name string, line int, end_line int, body_start int, body_end int, signature string, doc string, rich boolean, cyclomatic int, nesting int, body_lines int, dup_lines int, magic int, dead int"
SPAN = "kind string, start int, end int"


def extracted(files: DataFrame, extract: Callable[[str], Iterator[dict]], fields: str, pattern: str | None = None) -> DataFrame:
    """(package, path, ...fields): what an extractor finds in each file; nulls hold nothing."""
    names = [f.split(" ")[0] for f in fields.split(", ")]

    def run(batches):
        for pdf in batches:
            rows = [(p, q, *(r[n] for n in names)) for p, q, s in zip(pdf["package"], pdf["path"], pdf["source"], strict=True) for r in extract(s)]
            yield pd.DataFrame(rows, columns=["package", "path", *names])

    some = files.where(F.col("source").isNotNull())
    some = some.where(F.col("source").rlike(pattern)) if pattern else some
    return some.select("package", "path", "source").mapInPandas(run, f"package string, path string, {fields}")


def sites(files: DataFrame, rule: str) -> DataFrame:
    """All sites of a rule."""
    pattern, extract = RULES[rule]
    return extracted(files, extract, SITE, pattern)


def function_table(files: DataFrame) -> DataFrame:
    return extracted(files, functions, FUNCTION, "function|\\\\")


def span_table(files: DataFrame, most: int = 4) -> DataFrame:
    return extracted(files, lambda s: iter(picked(list(spans(s)), most)), SPAN)


def spliced(source: str, site: dict) -> str:
    """The source with one site rewritten."""
    return source[: site["start"]] + site["rewrite"] + source[site["end"] :]
