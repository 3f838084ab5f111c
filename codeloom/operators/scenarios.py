"""Edit and completion scenarios over R source files, on the lexer's tokens.

An extractor takes a source and gives rows of one shape: the lines above (prefix), the old and the new
region, the lines below (suffix), the cursor, and the edit that came before (line from 1, old and new
lines). `scenario_table` maps them over files by Arrow batches, behind a pattern that a file must hold.
Draws are hashes of what is drawn from, so they hold on any cluster.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import context, rlex

# Names and texts that scenarios use, and their limits.
RESERVED = {"if", "else", "for", "while", "repeat", "function", "break", "next", "return", "in", "TRUE", "FALSE", "NULL", "NA", "Inf", "NaN"}
STATS = ("mean", "sd", "var")
VERBS = {"summarise", "summarize", "mutate", "transmute", "reframe", "summarise_at", "summarize_at", "mutate_at", "summarise_if", "summarize_if", "mutate_if", "summarise_all", "summarize_all", "mutate_all"}
SELECTING = {"select", "rename", "across", "relocate", "pivot_longer", "pivot_wider", "if_any", "if_all"}
HELPERS = {"starts_with", "ends_with", "contains", "matches", "num_range", "all_of", "any_of", "everything", "last_col", "where"}
NEW_ARGUMENTS = [("verbose", "FALSE", "Show progress messages while the function runs."), ("call", "caller_env()", "Calling environment captured by rlang."), ("env", "parent.frame()", "Environment in which to evaluate expressions.")]
HANDLERS = re.compile(r"^\s*(error|warning|message|finally)\s*=", re.I)
WIDEST, WINDOW = 200, 10
PLACE = "family string, kind string, line int, prefix array<string>, region_old array<string>, region_new array<string>, suffix array<string>, cursor_idx int, event_line int, event_old array<string>, event_new array<string>, note string"


def draw(key: str, n: int) -> int:
    """A number under n that the key fixes."""
    return zlib.crc32(key.encode()) % n


def _row(family: str, lines: list[str], line: int, old: list[str], new: list[str], *, kind: str = "", cursor: int = 0, prefix: list[str] | None = None, suffix: list[str] | None = None, event: tuple[int, list[str], list[str]] | None = None, note: str = "") -> dict:
    at, before, after = event or (None, [], [])
    return {"family": family, "kind": kind, "line": line, "prefix": lines[max(0, line - WINDOW) : line] if prefix is None else prefix, "region_old": old, "region_new": new, "suffix": suffix or [], "cursor_idx": cursor, "event_line": at, "event_old": before, "event_new": after, "note": note}


class Source:
    """A file's lines and tokens, and what extractors ask of them."""

    def __init__(self, text: str):
        self.text, self.tokens = text.replace("\r\n", "\n"), []
        self.tokens = rlex.lex(self.text)
        self.lines = self.text.split("\n")
        self.starts = [0]
        for x in self.lines:
            self.starts.append(self.starts[-1] + len(x) + 1)
        self.code = rlex.code(self.tokens)
        self.place = {i: k for k, i in enumerate(self.code)}

    def column(self, t) -> int:
        return t.at - self.starts[t.line]

    def near(self, i: int, step: int):
        """The code token `step` places from token i, or None."""
        k = self.place[i] + step
        return self.tokens[self.code[k]] if 0 <= k < len(self.code) else None

    def calls(self) -> Iterator[tuple[int, int, int]]:
        """(name, opening bracket, closing bracket) of every call, as token indexes."""
        for k in range(len(self.code) - 1):
            i, j = self.code[k], self.code[k + 1]
            f, p = self.tokens[i], self.tokens[j]
            if f.kind in ("name", "quoted") and f.text not in RESERVED and p.text == "(" and p.mate >= 0:
                yield i, j, p.mate

    def bodies(self) -> Iterator[tuple[int, int, int, int]]:
        """(function keyword, opening brace, closing brace, bracket of parameters) of every function with a body in braces."""
        for k in range(len(self.code) - 1):
            i, j = self.code[k], self.code[k + 1]
            if self.tokens[i].text in ("function", "\\") and self.tokens[j].text == "(" and self.tokens[j].mate >= 0:
                o = self.near(self.tokens[j].mate, 1)
                if o is not None and o.text == "{" and o.mate >= 0:
                    yield i, self.code[self.place[self.tokens[j].mate] + 1], o.mate, j

    def statements(self, opening: int) -> list[tuple[int, int]]:
        """(first, last) code tokens of the statements directly in a brace."""
        t, end = self.tokens, self.tokens[opening].mate
        out, first, last, i = [], None, None, opening + 1

        def goes_on(k: int) -> bool:
            x = t[k]
            if x.kind == "op" or x.text in ("else", "repeat", "function", "in", "\\"):
                return True
            before = self.near(x.mate, -1) if x.text == ")" and x.mate >= 0 else None
            return before is not None and before.text in ("if", "for", "while", "function", "\\")

        while i < end:
            x = t[i]
            if x.kind == "comment":
                i += 1
                continue
            if x.kind == "newline" or x.text == ";":
                k = i + 1
                while k < end and t[k].kind in ("newline", "comment"):
                    k += 1
                if first is not None and not goes_on(last) and not (k < end and t[k].text == "else"):
                    out.append((first, last))
                    first = None
                i += 1
                continue
            first = i if first is None else first
            last = x.mate if x.kind == "open" and x.mate >= 0 else i
            i = last + 1
        if first is not None:
            out.append((first, last))
        return out

    def edited(self, line: int, at: int, end: int, new: str) -> str:
        x = self.lines[line]
        return x[:at] + new + x[end:]


def _taken(s: Source) -> set[str]:
    return {t.text.strip("`\"'") for t in s.tokens if t.kind in ("name", "quoted", "string")}


def new_name(old: str) -> str | None:
    """The deterministic rename of operators.classify.new_name, for one string."""
    new = old[:-4] if old.endswith("_tmp") else old.replace(".", "_") if "." in old else old + "2"
    return new if re.fullmatch(r"[A-Za-z.][A-Za-z0-9._]*", new) and new not in RESERVED else None


def renames(source: str, cap: int = 6) -> Iterator[dict]:
    """A name or name-like string used three times or more in a body: its first use is renamed, a later one, on another line, is to follow."""
    s = Source(source)
    taken = _taken(s)
    for f, o, e, p in s.bodies():
        inner = [i for i in s.code if o < i < e]
        called = {s.tokens[i].text for i in inner if (n := s.near(i, 1)) is not None and n.text == "(" and s.tokens[i].kind == "name"}
        declared = {s.tokens[i].text for i in s.code if p < i < s.tokens[p].mate and s.tokens[i].kind == "name"} | {s.tokens[i].text for i in inner if s.tokens[i].kind == "name" and (n := s.near(i, 1)) is not None and n.text in ("<-", "=", "<<-")}
        uses: dict[tuple[str, str], list[int]] = {}
        for i in inner:
            t = s.tokens[i]
            before = s.near(i, -1)
            if t.kind == "name" and t.text in declared - called - RESERVED and not t.text.startswith(".") and (before is None or before.text not in ("$", "@", "::", ":::")):
                uses.setdefault(("variable", t.text), []).append(i)
            elif t.kind == "string" and t.text[0] in "\"'" and re.fullmatch(r"[A-Za-z.][A-Za-z0-9._]*", t.text[1:-1]) and t.text[1:-1] not in RESERVED:
                uses.setdefault(("string", t.text), []).append(i)
        for kind in ("variable", "string"):
            n = 0
            for (k, tok), at in sorted(uses.items(), key=lambda u: zlib.crc32(u[0][1].encode())):
                bare = tok.strip("\"'")
                new = new_name(bare)
                if k != kind or n == cap or len(at) < 3 or len(bare) < 3 or new is None or new in taken:
                    continue
                new_tok = tok[0] + new + tok[0] if kind == "string" else new
                later = at[1:]
                first, then = s.tokens[at[0]], s.tokens[later[0] if draw(tok + source[:200], 10) < 7 else later[draw(source[:200] + tok, len(later))]]
                if then.line == first.line or "\n" in tok:
                    continue
                change = lambda t: s.edited(t.line, s.column(t), s.column(t) + len(tok), new_tok)  # noqa: B023, E731
                n += 1
                yield _row("rename_propagation", s.lines, then.line, [s.lines[then.line]], [change(then)], kind=kind, cursor=s.column(then), event=(first.line + 1, [s.lines[first.line]], [change(first)]), note=f"rename {tok} -> {new_tok}")


def pipe_pairs(source: str, cap: int = 4) -> Iterator[dict]:
    """Two pipes that follow each other on different lines: one is rewritten, the next is to follow. Right sides are calls without a placeholder."""
    s = Source(source)
    fine = []
    for i in s.code:
        if s.tokens[i].text == "%>%":
            f, p = s.near(i, 1), s.near(i, 2)
            if f is not None and p is not None and f.kind == "name" and p.text == "(" and p.mate >= 0 and not any(x.text == "." for x in s.tokens[s.code[s.place[i] + 2] : p.mate]):
                fine.append(s.tokens[i])
    n = 0
    for a, b in zip(fine, fine[1:], strict=False):
        if a.line != b.line and n < cap:
            n += 1
            new = [s.edited(t.line, s.column(t), s.column(t) + 3, "|>") for t in (a, b)]
            yield _row("pipe_rewrite", s.lines, b.line, [s.lines[b.line]], [new[1]], cursor=s.column(b), event=(a.line + 1, [s.lines[a.line]], [new[0]]), note="rewrite the next pipe")


def na_rm_pairs(source: str, cap: int = 4) -> Iterator[dict]:
    """Calls of mean, sd or var on one line without na.rm: one gains it, the next is to follow; first pairs within one verb, then any that follow each other."""
    if not re.search("dplyr|tidyverse|summaris|summariz|%>%", source) or re.search(r"(?<![\w.])(?:mean|sd|var)\s*<-", source):
        return
    s = Source(source)
    verbs = [(o, e) for i, o, e in s.calls() if s.tokens[i].text in VERBS]
    found = []
    for i, o, e in s.calls():
        inner = s.text[s.tokens[o].at + 1 : s.tokens[e].at]
        bare = "".join(x.text for x in s.tokens[o + 1 : e] if x.kind not in ("string", "comment"))
        if s.tokens[i].text in STATS and s.tokens[o].line == s.tokens[e].line and inner.strip() and not inner.strip().endswith(",") and not re.search(r"(?<![\w.])na\.rm=", bare.replace(" ", "")):
            at = s.column(s.tokens[e])
            while at and s.lines[s.tokens[e].line][at - 1] in " \t":
                at -= 1
            around = [v for v in verbs if v[0] < i < v[1]]
            found.append((max(around)[0] if around else None, s.tokens[e].line, at, s.tokens[i].text))
    groups: dict[int, list] = {}
    for x in found:
        if x[0] is not None:
            groups.setdefault(x[0], []).append(x)
    pairs = [p for _, g in sorted(groups.items()) for p in zip(g, g[1:], strict=False)] + list(zip(found, found[1:], strict=False))
    seen, n = set(), 0
    for a, b in pairs:
        if (a[1:3], b[1:3]) in seen or a[1] == b[1] or n == cap:
            continue
        seen.add((a[1:3], b[1:3]))
        n += 1
        old, new = ([s.lines[x[1]] for x in (a, b)], [s.edited(x[1], x[2], x[2], ", na.rm = TRUE") for x in (a, b)])
        yield _row("na_rm_propagation", s.lines, b[1], [old[1]], [new[1]], cursor=b[2], event=(a[1] + 1, [old[0]], [new[0]]), note=f"add na.rm to {b[3]}")


def format_pairs(raw: list[str], tidy: list[str], cap: int = 3, most: int = 12) -> Iterator[dict]:
    """Hunks of a reformatted file that change white space and braces only and share no line: one is shown, the next is to follow.
    A file whose hunks do not rebuild the tidy one gives nothing."""
    groups = context._groups(raw, tidy)
    built, at = [], 0
    for i1, i2, j1, j2 in groups:
        built += raw[at:i1] + tidy[j1:j2]
        at = i2
    if built + raw[at:] != tidy:
        return
    bare = lambda x: re.sub(r"[\s{}]+", "", "".join(x))
    fine = [g for g in groups if g[0] < g[1] and g[2] < g[3] and max(g[1] - g[0], g[3] - g[2]) <= most and all(len(x) <= WIDEST for x in raw[g[0] : g[1]] + tidy[g[2] : g[3]]) and not {x.rstrip() for x in raw[g[0] : g[1]]} & {x.rstrip() for x in tidy[g[2] : g[3]]} and bare(raw[g[0] : g[1]]) == bare(tidy[g[2] : g[3]])]
    for a, b in list(zip(fine, fine[1:], strict=False))[:cap]:
        first = raw[b[0]]
        yield _row("format_propagation", raw, b[0], raw[b[0] : b[1]], tidy[b[2] : b[3]], cursor=len(first) - len(first.lstrip()), event=(a[0] + 1, raw[a[0] : a[1]], tidy[a[2] : a[3]]), note="format the next hunk")


def _documented(s: Source) -> Iterator[tuple[int, int, int, int, list[int]]]:
    """(name, brace of the body, its mate, bracket of parameters, lines of documentation) of documented functions at the top level."""
    for f, o, e, p in s.bodies():
        a, n = s.near(f, -1), s.near(f, -2)
        if n is None or n.depth or a.text not in ("<-", "=", "<<-") or n.kind != "name":
            continue
        docs, at = [], n.line - 1
        while at >= 0 and s.lines[at].lstrip().startswith("#'"):
            docs.insert(0, at)
            at -= 1
        yield s.code[s.place[f] - 2], o, e, p, docs


def doc_sync(source: str, cap: int = 2, most: int = 14) -> Iterator[dict]:
    """A signature gains a known argument; its documentation is to gain the line before @return or @export."""
    s, n = Source(source), 0
    for name, _, _, p, docs in _documented(s):
        inner = [s.tokens[i] for i in s.code if p < i < s.tokens[p].mate]
        have = {t.text for t in inner if t.kind == "name" and t.depth == s.tokens[p].depth + 1}
        param = [i for i in docs if re.match(r"\s*#'\s*@param\b", s.lines[i])]
        anchor = next((i for i in docs if re.match(r"\s*#'\s*@(return|export)\b", s.lines[i])), None)
        pick = next(((a, d, t) for a, d, t in NEW_ARGUMENTS if a not in have), None)
        if n == cap or not inner or not param or anchor is None or anchor < param[0] or pick is None or anchor - param[0] + 1 > most:
            continue
        arg, default, text = pick
        if any(re.match(rf"\s*#'\s*@param\s+{arg}\b", s.lines[i]) for i in docs):
            continue
        n += 1
        old = s.lines[param[0] : anchor + 1]
        new = [*old[:-1], re.match(r"\s*#'", old[-1]).group() + f" @param {arg} {text}", old[-1]]
        end = s.tokens[s.tokens[p].mate]
        yield _row("doc_sync", s.lines, param[0], old, new, cursor=sum(len(x) + 1 for x in old[:-1]), event=(end.line + 1, [s.lines[end.line]], [s.edited(end.line, s.column(end), s.column(end), f", {arg} = {default}")]), note=f"document {arg} of {s.tokens[name].text}")


def roxygen_drafts(source: str, least: int = 3, budget: int = 6000) -> Iterator[dict]:
    """Functions under rich documentation of `least` lines or more: the documentation is to be written above them."""
    s = Source(source)
    for name, o, e, _, docs in _documented(s):
        text = [s.lines[i] for i in docs]
        body = s.text[s.tokens[o].at + 1 : s.tokens[e].at]
        below = s.lines[s.tokens[name].line : s.tokens[e].line + 1]
        if len(docs) < least or not re.search("@param|@return", "\n".join(text)) or not body.strip() or body.count("\n") + 1 < 3:
            continue
        room = budget - len("\n".join(text)) - len("\n".join(below))
        head = _last_fitting(s.lines[: docs[0]], room)
        if room >= 0:
            yield _row("roxygen_drafting", s.lines, docs[0], [""], text, prefix=head, suffix=below, note=f"{s.tokens[name].text}: {len(text)} lines")


def mid_roxygen(source: str, least: int = 3, budget: int = 6000) -> Iterator[dict]:
    """Documentation of which the first lines are there: the rest is to follow."""
    s = Source(source)
    for name, _, e, _, docs in _documented(s):
        text, n = [s.lines[i] for i in docs], len(docs)
        below = s.lines[s.tokens[name].line : s.tokens[e].line + 1]
        room = budget - len("\n".join(text)) - len("\n".join(below))
        if n < least + 1 or room < 0:
            continue
        cuts = sorted({max(0, n // 3 - 1), 2 * n // 3, n - 2} & set(range(n - 1)))
        k = cuts[draw(s.tokens[name].text + text[0], len(cuts))]
        yield _row("mid_roxygen", s.lines, docs[0], text[: k + 1], text[k + 1 :], cursor=k, prefix=_last_fitting(s.lines[: docs[0]], room), suffix=below, note=f"line {k + 1} of {n}")


def _last_fitting(lines: list[str], room: int, most: int = 60) -> list[str]:
    out: list[str] = []
    for x in reversed(lines[-most:]):
        room -= len(x) + 1
        if room < 0:
            break
        out.insert(0, x)
    return out


def _functions(s: Source) -> Iterator[tuple[int, int, int, int]]:
    """s.bodies() with the innermost first, so that lines belong to the function around them."""
    yield from sorted(s.bodies(), key=lambda b: b[2] - b[1])


def _clean(lines: list[str]) -> bool:
    """Whether lines are whole by themselves: every bracket has its mate, and no string is open."""
    t = rlex.lex("\n".join(lines))
    return all(x.mate >= 0 for x in t if x.kind in ("open", "close")) and not any(x.text in ("\"", "'", "`") for x in t)


def comment_pairs(source: str, cap: int = 4, most: int = 40) -> Iterator[dict]:
    """A comment line in a body and the 2 to 10 statements below it: the statements are to be written."""
    s, n = Source(source), 0
    plain = lambda i: s.lines[i].lstrip().startswith("#") and not s.lines[i].lstrip().startswith("#'")
    owner: dict[int, tuple[int, int, int]] = {}
    for f, o, e, _ in _functions(s):
        for i in range(s.tokens[o].line + 1, s.tokens[e].line):
            owner.setdefault(i, (f, o, e))
    for i in sorted(owner):
        f, o, e = owner[i]
        if n == cap or not plain(i) or i + 1 - s.tokens[f].line > most:
            continue
        j = i + 1
        while j < s.tokens[e].line and s.lines[j].strip() and not s.lines[j].lstrip().startswith("#"):
            j += 1
        block = s.lines[i + 1 : j]
        inside = [x for x in s.statements(o) if i < s.tokens[x[0]].line and s.tokens[x[1]].line < j]
        if not 2 <= len(inside) <= 10 or not _clean(block):
            continue
        n += 1
        yield _row("comment_to_code_real", s.lines, i + 1, [""], block, prefix=s.lines[s.tokens[f].line : i + 1], note=f"{len(inside)} statements")


def comment_free_blocks(source: str, cap: int = 4, least: int = 2, most: int = 8) -> Iterator[dict]:
    """Runs of 2 to 8 lines in a body without comments, with two calls or a pipe: a comment is to be written for them."""
    s, n = Source(source), 0
    noted = {t.line for t in s.tokens if t.kind == "comment"}
    calls = [s.tokens[i].line for i, _, _ in s.calls()]
    for _, o, e, _ in _functions(s):
        inside = s.statements(o)
        at = 0
        while at < len(inside) and n < cap:
            best = None
            for to in range(at, len(inside)):
                a, b = s.tokens[inside[at][0]].line, s.tokens[inside[to][1]].line
                span = range(a, b + 1)
                if b - a + 1 > most or any(i in noted or not s.lines[i].strip() for i in span) or a - 1 in noted:
                    break
                if b - a + 1 >= least and (sum(x in span for x in calls) >= 2 or any(p in s.lines[i] for i in span for p in ("%>%", "|>"))):
                    best = (a, b, to)
            if best and _clean(s.lines[best[0] : best[1] + 1]):
                n += 1
                yield _row("comment_free_block", s.lines, best[0], [""], s.lines[best[0] : best[1] + 1], prefix=s.lines[s.tokens[o].line : best[0]], note=f"{best[1] - best[0] + 1} lines")
                at = best[2]
            at += 1


def removed_blocks(source: str, cap: int = 2, least: int = 3, most: int = 8, body: tuple[int, int] = (6, 40)) -> Iterator[dict]:
    """A run of statements inside a body, neither its first nor its last, is cut out: it is to be written again."""
    s, n = Source(source), 0
    for f, o, e, _ in s.bodies():
        first, end = s.tokens[o].line, s.tokens[e].line
        full = sum(bool(x.strip()) for x in s.lines[first + 1 : end])
        inside = s.statements(o)
        if n == cap or not body[0] <= full <= body[1]:
            continue
        spans = [(s.tokens[inside[i][0]].line, s.tokens[inside[j][1]].line) for i in range(1, len(inside)) for j in range(i, len(inside) - 1)]
        spans = [x for x in spans if least <= x[1] - x[0] + 1 <= most]
        for a, b in sorted(spans, key=lambda x: zlib.crc32(f"{x}{s.lines[x[0]]}".encode())):
            block = s.lines[a : b + 1]
            if s.lines[a - 1].strip() and not block[0].lstrip().startswith("#") and len("\n".join(block)) <= 700 and _clean(block):
                n += 1
                yield _row("removed_block", s.lines, a, [""], block, prefix=s.lines[max(0, s.tokens[f].line - WINDOW) : a], suffix=s.lines[b + 1 : end + 1 + WINDOW], note=f"{len(block)} lines of {full}")
                break


def finish_blocks(source: str) -> Iterator[dict]:
    """Documented functions as `signature` rows (the body is to be written) and `mid_body` rows (after its first third, the rest is)."""
    s = Source(source)
    for name, o, e, _, docs in _documented(s):
        if not docs:
            continue
        text = [s.lines[i].strip() for i in docs]
        rich = sum(len(x.replace("#'", "").split()) for x in text) >= 12 or bool(re.search("@param|@return", "\n".join(text)))
        head = "\n".join(text) + "\n" + s.text[s.tokens[name].at : s.tokens[o].at].rstrip() + " {"
        inside = s.statements(o)
        body = s.text[s.tokens[o].at + 1 : s.tokens[e].at]
        note = "rich" if rich else "plain"
        if inside and body.count("\n") + 1 <= 40:
            yield _row("finish_block", s.lines, s.tokens[o].line, [""], body.split("\n"), kind="signature", prefix=head.split("\n"), note=note)
        if len(inside) >= 4:
            t = s.tokens[inside[max(1, len(inside) // 3) - 1][1]]
            cut = t.at + len(t.text)
            top, rest = s.text[s.tokens[o].at + 1 : cut], s.text[cut : s.tokens[e].at]
            if 2 <= rest.count("\n") + 1 <= 30 and top.count("\n") + 1 <= 25:
                yield _row("finish_block", s.lines, t.line, [""], rest.split("\n"), kind="mid_body", prefix=(head + "\n" + top).split("\n"), note=note)


def comment_inserts(source: str) -> Iterator[dict]:
    """comment_pairs of four lines or more: the comment has just been typed, the first part of its block is to come, the rest is below."""
    for r in comment_pairs(source):
        block = r["region_new"]
        if len(block) >= 4:
            share = 0.25 + 0.25 * draw("\n".join(block), 1000) / 1000
            k = max(1, min(len(block) - 2, round(len(block) * share)))
            yield r | {"family": "comment_insert", "prefix": r["prefix"][:-1], "region_old": [r["prefix"][-1] + "<|user_cursor|>"], "region_new": block[:k], "suffix": block[k:], "note": f"split {k}/{len(block)}"}


def tidyselect(source: str, cap: int = 8, above: int = 8) -> Iterator[dict]:
    """Selection helpers on one line within a selecting verb: the helper's call is to be written where it stood."""
    s, seen, n = Source(source), set(), 0
    verbs = [(o, e) for i, o, e in s.calls() if s.tokens[i].text in SELECTING]
    for i, o, e in s.calls():
        t, end = s.tokens[i], s.tokens[e]
        if t.text not in HELPERS or t.line != end.line or e == o + 1 or not any(a < i < b for a, b in verbs) or n == cap:
            continue
        x = s.lines[t.line]
        text, before, after = x[s.column(t) : s.column(end) + 1], x[: s.column(t)].rstrip(), x[s.column(end) + 1 :].strip()
        if before and (t.line, text) not in seen:
            seen.add((t.line, text))
            n += 1
            yield _row("tidyselect_helpers", s.lines, t.line, [""], [text], prefix=[*s.lines[max(0, t.line - above) : t.line], before], suffix=[after] if after else [])


def pipe_links(source: str, cap: int = 2) -> Iterator[dict]:
    """A pipe at a line's end and a call on the next line: that line is to be written; later lines stay below."""
    s, found = Source(source), []
    for i in s.code:
        t = s.tokens[i]
        f, p = s.near(i, 1), s.near(i, 2)
        if t.text not in ("%>%", "|>") or f is None or p is None or f.line != t.line + 1 or p.text != "(" or s.lines[t.line][s.column(t) + len(t.text) :].strip() or len(s.lines[f.line]) > 220:
            continue
        at = i  # back over what the pipe works on
        while (b := s.near(at, -1)) is not None and (b.text in ("%>%", "|>", "$", "@", "::", ")", "]") or b.kind in ("name", "string", "number", "quoted")) and b.line >= t.line - WINDOW:
            at = b.mate if b.kind == "close" and b.mate >= 0 else s.code[s.place[at] - 1]
        head = s.tokens[at].line
        kind = "mid" if s.lines[f.line].rstrip().endswith(("%>%", "|>")) else "final"
        found.append(_row("pipe_chain_link", s.lines, f.line, [""], [s.lines[f.line].rstrip()], kind=kind, prefix=s.lines[max(head, t.line - WINDOW) : t.line + 1], suffix=s.lines[f.line + 1 : f.line + 1 + WINDOW]))
    yield from sorted(found, key=lambda r: zlib.crc32(f"{r['line']}{r['region_new'][0]}".encode()))[:cap]


def handlers(source: str, cap: int = 2, most: int = 4, window: int = 8) -> Iterator[dict]:
    """tryCatch calls of three lines or more: the handlers after the guarded expression's comma are to be written."""
    s, n = Source(source), 0
    for i, o, e in s.calls():
        if s.tokens[i].text not in ("tryCatch", "withCallingHandlers") or s.tokens[e].line - s.tokens[i].line < 2 or n == cap:
            continue
        comma = next((k for k in s.code if o < k < e and s.tokens[k].text == "," and s.tokens[k].depth == s.tokens[o].depth + 1), None)
        second = s.near(comma, 1) if comma is not None else None
        if second is None or second.at >= s.tokens[e].at:
            continue
        text = s.text[second.at : s.tokens[e].at + 1]
        lines = [x.rstrip() for x in text.split("\n")]
        if not HANDLERS.match(text) or len(lines) > most or any(len(x) > WIDEST for x in lines) or len(text) > 500:
            continue
        n += 1
        part = s.lines[second.line][: s.column(second)]
        above = s.lines[max(0, s.tokens[i].line - window) : second.line]
        yield _row("trycatch_handlers", s.lines, second.line, [""], lines, prefix=[*above, part] if part.strip() else above, suffix=s.lines[s.tokens[e].line + 1 : s.tokens[e].line + 1 + window])


def mid_body_edits(source: str, body: tuple[int, int] = (3, 40), per_file: int = 2) -> Iterator[dict]:
    """One change on a line strictly inside a body, of the kind that the file has had least so far:
    a number raised (arg_edit), na.rm added (na_rm_insert), a local renamed once (rename_once), or a line left out that is to come back (insert_line)."""
    s, n, had = Source(source), 0, dict.fromkeys(("arg_edit", "insert_line", "na_rm_insert", "rename_once"), 0)
    shadowed = re.search(r"(?<![\w.])(?:mean|sd|var)\s*<-", source)
    for _, o, e, _ in s.bodies():
        first, last = s.tokens[o].line, s.tokens[e].line
        full = [i for i in range(first + 1, last) if s.lines[i].strip()]
        if n == per_file or not body[0] <= len(full) <= body[1]:
            continue
        inside = full[1:-1]
        options: dict[str, list[tuple[int, str]]] = {k: [] for k in had}
        for i in s.code:
            t = s.tokens[i]
            a, b = s.near(i, -1), s.near(i, 1)
            if not o < i < e or t.line not in inside or b is None:
                continue
            if t.kind == "number" and re.fullmatch(r"\d+L?", t.text) and a.text == "=" and a.depth > s.tokens[o].depth + 1:
                options["arg_edit"].append((t.line, s.edited(t.line, s.column(t), s.column(t) + len(t.text), str(int(t.text.rstrip("L")) + 1) + "L" * t.text.endswith("L"))))
            elif t.text in STATS and b.text == "(" and b.mate >= 0 and s.tokens[b.mate].line == t.line and not shadowed and "na.rm" not in s.text[b.at : s.tokens[b.mate].at] and s.tokens[b.mate].at > b.at + 1:
                end = s.column(s.tokens[b.mate])
                options["na_rm_insert"].append((t.line, s.edited(t.line, end, end, ", na.rm = TRUE")))
            elif t.kind == "name" and len(t.text) > 2 and t.text not in RESERVED and b.text != "(" and a.text not in ("$", "@", "::") and (new := new_name(t.text)) and any(s.tokens[j].text == t.text and (x := s.near(j, 1)) is not None and x.text == "<-" for j in s.code if o < j < i):
                options["rename_once"].append((t.line, s.edited(t.line, s.column(t), s.column(t) + len(t.text), new)))
        options["insert_line"] = [(s.tokens[x].line, s.lines[s.tokens[x].line]) for x, y in s.statements(o) if s.tokens[x].line == s.tokens[y].line and s.tokens[x].line in inside]
        kinds = [k for k in sorted(had, key=lambda k: (had[k], k)) if options[k]]
        if not kinds:
            continue
        kind = kinds[0]
        line, new = options[kind][draw(s.lines[first] + kind, len(options[kind]))]
        had[kind] += 1
        n += 1
        old = [] if kind == "insert_line" else [s.lines[line]]
        yield _row("mid_body_edit", s.lines, line, old, [new], kind=kind, prefix=s.lines[max(0, first - WINDOW) : line], suffix=s.lines[line + 1 : last + 1 + WINDOW])


def cut_sites(source: str, random: int = 2, least: int = 30, budget: int = 6000) -> Iterator[dict]:
    """Bodies of documented functions cut after their first statement, at their middle and before their last one, and at `random` more
    places that the function's name fixes; with and without the documentation above. What is to come has `least` characters at least."""
    s = Source(source)
    for name, o, e, _, docs in _documented(s):
        inside = s.statements(o)
        if len(inside) < 2:
            continue
        n = len(inside) - 1
        sites = {"first": 0, "middle": n // 2, "last": n - 1}
        sites |= {f"random{k}": draw(f"{s.tokens[name].text}{k}{s.lines[s.tokens[o].line]}", n) for k in range(random)}
        seen: set[int] = set()
        for kind, at in sites.items():
            if at in seen:
                continue
            seen.add(at)
            t = s.tokens[inside[at][1]]
            cut = t.at + len(t.text)
            rest = s.text[cut : s.tokens[e].at].strip("\n")
            if len(rest.strip()) < least or len(rest.split("\n")) > 40:
                continue
            for doc in ("docs", "bare") if docs else ("bare",):
                first = docs[0] if doc == "docs" else s.tokens[name].line
                above = s.text[s.starts[first] : cut].split("\n")
                if len("\n".join(above)) + len(rest) <= budget:
                    yield _row("finish_block", s.lines, t.line, [""], rest.split("\n"), kind=f"fb_cut_{kind}:{doc}", prefix=above, note=s.tokens[name].text)


NAMESPACE_ENTRY = re.compile(r"^(export|importFrom|import|S3method|exportPattern|useDynLib)\(([^)]*)\)\s*$")


def namespace_entries(source: str) -> Iterator[dict]:
    """Of a NAMESPACE's first kind of directive that stands in strictly sorted order, the middle entry: it is to be put back into its slot."""
    lines = source.split("\n")
    groups: dict[str, list[tuple[int, str]]] = {}
    for i, x in enumerate(lines):
        if m := NAMESPACE_ENTRY.match(x.strip()):
            groups.setdefault(m.group(1), []).append((i, re.sub(r"[\s\"'`]", "", m.group(2)).lower()))
    for kind, g in sorted(groups.items()):
        if all(a[1] < b[1] for a, b in zip(g, g[1:], strict=False)):
            i = g[len(g) // 2][0] if len(g) > 2 else g[0][0]
            if i <= 80:
                yield _row("namespace_entry", lines, i, [""], [lines[i]], kind=f"namespace:{kind}", prefix=lines[:i], suffix=lines[i + 1 : i + 41])
                return


def description_entries(source: str) -> Iterator[dict]:
    """Of a DESCRIPTION's Imports an entry whose neighbours are in order: it is to be put back, as a line of its own or within its line."""
    lines = source.split("\n")
    head = next((i for i, x in enumerate(lines) if x.startswith("Imports:")), None)
    if head is None:
        return
    last = head + 1
    while last < len(lines) and lines[last].strip() and lines[last][0].isspace():
        last += 1
    found = [(m.group().lower(), i, m.start(), m) for i in range(head, last) for m in re.finditer(r"[A-Za-z][\w.]*(?:\s*\([^)]*\))?(?=\s*(?:,|$))", lines[i]) if not (i == head and m.start() < len("Imports:"))]
    names = [re.match(r"[\w.]+", x[0]).group() for x in found]
    slots = [j for j in range(1, len(found) - 1) if names[j - 1] < names[j] < names[j + 1]]
    if len(found) < 3 or not slots:
        return
    _, i, at, m = found[slots[len(slots) // 2]]
    if len(lines[i]) <= WIDEST:
        whole = lines[i].strip().rstrip(",").strip() == m.group()
        yield _row("description_entry", lines, i, [""], [lines[i] if whole else lines[i][at:]], kind="description:imports", prefix=lines[:i] if whole else [*lines[:i], lines[i][:at]], suffix=lines[i + 1 : i + 31])


#: Family -> (pattern that a file must hold, extractor).
FAMILIES: dict[str, tuple[str, Callable[[str], Iterator[dict]]]] = {
    "rename_propagation": ("function|\\\\", renames),
    "pipe_rewrite": ("%>%", pipe_pairs),
    "na_rm_propagation": (r"\b(mean|sd|var)\s*\(", na_rm_pairs),
    "doc_sync": ("#'\\s*@param", doc_sync),
    "roxygen_drafting": ("#'", roxygen_drafts),
    "mid_roxygen": ("#'", mid_roxygen),
    "comment_to_code_real": ("#", comment_pairs),
    "comment_free_block": ("function|\\\\", comment_free_blocks),
    "comment_insert": ("#", comment_inserts),
    "removed_block": ("function|\\\\", removed_blocks),
    "finish_block": ("#'", finish_blocks),
    "finish_block_cuts": ("function|\\\\", cut_sites),
    "tidyselect_helpers": ("|".join(sorted(HELPERS)), tidyselect),
    "pipe_chain_link": (r"%>%|\|>", pipe_links),
    "trycatch_handlers": ("tryCatch|withCallingHandlers", handlers),
    "mid_body_edit": ("function|\\\\", mid_body_edits),
    "namespace_entry": (r"(?m)^\w+\(", namespace_entries),
    "description_entry": ("(?m)^Imports:", description_entries),
}


def scenario_table(files: DataFrame, family: str) -> DataFrame:
    """(package, path, ..., event_diff) of one family over files (package, path, source); null sources hold nothing."""
    pattern, extract = FAMILIES[family]
    return with_event(rlex.extracted(files, extract, PLACE, pattern))


def format_table(files: DataFrame, tidy: DataFrame) -> DataFrame:
    """format_pairs of files (package, path, source) that also have a tidy source under the same package and path."""
    both = files.select("package", "path", "source").join(tidy.select("package", "path", F.col("source").alias("tidy")), ["package", "path"]).where("source is not null and tidy is not null and source <> tidy")
    names = [f.split(" ")[0] for f in PLACE.split(", ")]

    def run(batches):
        for pdf in batches:
            rows = [(p, q, *(r[n] for n in names)) for p, q, a, b in pdf.itertuples(index=False) for r in format_pairs(a.split("\n"), b.split("\n"))]
            yield pd.DataFrame(rows, columns=["package", "path", *names])

    return with_event(both.mapInPandas(run, f"package string, path string, {PLACE}"))


def with_event(rows: DataFrame) -> DataFrame:
    """Rows with the text of the edit before, empty where there is none."""
    signed = lambda c, sign: F.transform(c, lambda x: F.concat(F.lit(sign), x))
    none = F.lit(None).cast("int")
    count = lambda c: F.when(F.size(c) != 1, F.size(c)).otherwise(none)
    text = context.event_text(F.col("path"), F.col("event_line"), count("event_old"), F.col("event_line"), count("event_new"), F.concat(signed("event_old", "-"), signed("event_new", "+")))
    return rows.withColumn("event_diff", F.when(F.col("event_line").isNotNull(), text).otherwise("")).drop("event_line", "event_old", "event_new")


def partial_spans(rows: DataFrame, key: str, lines: str, most: int = 3) -> DataFrame:
    """Rows whose span, an array of lines, is split: the first one to `most` lines are typed already (`partial`), the rest (`remaining`)
    is to come. Spans of one line, or with only blanks to come, go."""
    n = F.least(F.lit(most), F.size(lines) - 1)
    k = (F.floor(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("bigint") / 4294967296.0 * n) + 1).cast("int")
    cut = rows.where(F.size(lines) >= 2).withColumn("k", k)
    cut = cut.withColumn("partial", F.slice(lines, F.lit(1), F.col("k"))).withColumn("remaining", F.slice(lines, F.col("k") + 1, F.size(lines) - F.col("k")))
    return cut.where(F.exists("remaining", lambda x: F.trim(x) != ""))
