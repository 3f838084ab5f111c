"""Roll-ups, gates, contexts and selections on small tables, against plain re-implementations."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from codeloom.functions import stats
from codeloom.operators import context, gates, metrics, rollups, selection


def one(spark, column, **values):
    kinds = ", ".join(f"{k} {v[1]}" for k, v in values.items())
    return spark.createDataFrame([tuple(v[0] for v in values.values())], kinds).select(column.alias("x")).first().x


LINES = "array<string>"


def test_scenario_scores_and_baseline(spark):
    rows = [("a", 1, 1, 1.0, None, 0.5, ["x", "y"], ["x", "z"]), ("a", 0, 0, 0.2, "shape", 1.5, ["x"], ["x "]), ("b", 0, 0, 0.0, "error", 2.0, ["q"], ["r"]), ("a", 0, 0, 0.0, "transform", 3.0, ["m"], ["m"])]
    d = spark.createDataFrame(rows, f"family string, valid_pass int, exact int, reward double, fail_kind string, latency_s double, old {LINES}, new {LINES}")
    got = {r.family: r for r in rollups.scenario_scores(d, ["family"], "old", "new").collect()}
    a = got["a"]
    assert (a.n_scored, a.validator_pass, a.exact, a.mean_reward, a.fail_shape, a.fail_transform, a.fail_error) == (3, 0.3333, 0.3333, 0.4, 0.3333, 0.3333, 0.0)
    assert (a.noop_line_f1, a.noop_exact, a.p50_latency_s, a.p95_latency_s) == (0.8333, 0.6667, 1.5, 3.0)
    base = {r.family: (r.n, r.exact, r.first_line, r.line_f1) for r in rollups.copy_baseline(d, ["family"], "old", "new").collect()}
    assert base["b"] == (1, 0.0, 0.0, 0.0) and base["a"][2] == 1.0


def test_tournament_and_smells(spark):
    rounds = spark.createDataFrame([("r001", True), ("r002", False), ("notes", True)], "round string, done boolean")
    bank = spark.createDataFrame([(f"t{i}", float(i)) for i in range(8)] + [("none", None)], "title string, composite double")
    r = rollups.tournament(rounds, bank, "title", "composite").first()
    assert (r.rounds_done, r.rounds_open, r.bank_size, r.top) == (1, 1, 9, ["t7", "t6", "t5", "t4", "t3"])
    f = spark.createDataFrame([(10, 0, 50, 0, 0, 0), (1, 1, 5, 1, 0, 0), (3, 4, 41, 3, 3, 1)], ", ".join(f"{k} int" for k in rollups.SMELLS))
    hot, dist = rollups.smells(f)
    assert {r.smell: r.n for r in hot.collect()} == {"cyclomatic_ge_10": 1, "nesting_ge_4": 1, "body_lines_ge_40": 2, "dup_lines_ge_3": 1, "magic_numbers_ge_3": 1, "dead_assigns_ge_1": 1, "any_smell": 2, "all_clean": 1}
    assert {r.metric: (r.mean, r.p50, r.max) for r in dist.collect()}["body_lines"] == (32.0, 41, 50)


def test_rewrite_gates(spark):
    kind = "parses boolean, lo int, ln int, diff int, loc int, beh array<struct<size:int,equal:boolean,env_bearing:boolean>>, bench array<struct<size:bigint,orig_ms:double,orig_iqr_ms:double,speedup:double>>, hot boolean"
    same = [(i, True, False) for i in (1, 2, 3)]
    slow = [(10, 1.0, 0.01, 2.5), (100, 9.0, 0.1, 3.0)]
    rows = [
        (True, 2, 1, 10, 0, same, None, False, "accept"),
        (False, 2, 1, 10, 0, same, None, False, "reject_G0"),
        (True, None, 1, 10, 0, same, None, False, "reject"),
        (True, 2, 2, 31, -1, same, None, False, "reject"),
        (True, 2, 2, 10, 0, same[:2], None, False, "reject"),
        (True, 2, 2, 10, 0, [(1, True, True), *same], None, False, "reject"),
        (True, 2, 2, 10, 4, same, slow, False, "accept"),
        (True, 2, 2, 10, 4, same, [slow[0], (100, 9.0, 9.0, 3.0)], False, "reject_no_perf_gain"),
        (True, 2, 2, 10, 1, same, [(10, 1.0, 0.01, 1.0), (100, 1.1, 0.01, 1.0)], False, "reject"),
        (True, 2, 2, 10, 0, same, None, False, "reject_no_value_no_op_wins"),
        (True, 2, 2, 10, 3, same, None, True, "reject_no_value_no_op_wins"),
    ]
    d = spark.createDataFrame(rows, kind + ", want string")
    g = gates.rewrite_gates(*[F.col(c) for c in ("parses", "lo", "ln", "diff", "loc", "beh", "bench", "hot")])
    got = d.select("want", g["verdict"].alias("v"), g["G4_perf"].alias("p"), g["G1_lint"].alias("l")).collect()
    assert [r.v for r in got] == [r.want for r in got] and got[0].p is None and got[2].l is None and got[6].p is True
    s = rollups.speedups(F.col("beh"), F.col("bench"))
    assert [(r.x.equal_sizes, r.x.top_speedup) for r in d.select(s.alias("x")).collect()][6] == ([1, 2, 3], 3.0)


def test_documented_delta(spark):
    a = lambda *x: (list(x), LINES)
    args = [F.col(c) for c in ("op", "np", "od", "nd")]
    for op, np_, od, nd, want in [("a b", "a b c", "a b", "a b c", True), ("a b", "a b c", "a b", "a b", False), ("a b", "a c", "a b", "a c", True), ("a", "a", "a", "a", False), ("a", "a b c d e", "a", "a b c d e", False), ("a b", "a c", "b", "c b", False)]:
        assert one(spark, gates.documented_delta(*args), op=a(*op.split()), np=a(*np_.split()), od=a(*od.split()), nd=a(*nd.split())) is want


def test_active_and_rows(spark):
    cols = [F.col(c) for c in ("missing", "archived", "fork", "disk")]
    keep = gates.active(F.col("at"), "2026-05-01", *cols)
    for at, missing, archived, fork, disk, want in [("2026-06-01", False, None, False, 10, True), ("2026-04-01", False, False, False, 10, False), (None, False, False, False, 1, False), ("2026-06-01", False, True, False, 1, False), ("2026-06-01", False, False, False, 2_000_000, False), ("2026-06-01", None, None, None, None, True)]:
        assert one(spark, keep, at=(at, "string"), missing=(missing, "boolean"), archived=(archived, "boolean"), fork=(fork, "boolean"), disk=(disk, "int")) is want
    why = gates.row_reason(*[F.col(c) for c in ("p", "o", "n", "c", "e")])
    for p, o, n, c, e, want in [(["a"], [""], ["b"], 0, "", None), ([], [""], ["b"], 0, "", "prefix must be a non-empty list"), (["a\nb"], [""], ["b"], 0, "", "prefix must be single-line strings"), (["a"], ["x"], ["b"], 0, "", "region_old must be the empty cursor line"), (["a"], [""], [" "], 0, "", "region_new must be non-blank"), (["a"], [""], ["b"], 1, "", "cursor_idx must be 0"), (["a"], [""], ["b"], 0, "x", "case rows carry no event")]:
        assert one(spark, why, p=(p, LINES), o=(o, LINES), n=(n, LINES), c=(c, "int"), e=(e, "string")) == want


def test_rendered_blocks(spark):
    r = context.render_block(*[F.col(c) for c in ("kind", "pkg", "path", "prefix", "target")])
    row = dict(pkg=("p", "string"), path=("R/a.R", "string"))
    sig = one(spark, r, kind=("signature", "string"), prefix=("#' x\nf <- function() {", "string"), target=("\n  1\n", "string"), **row)
    assert sig.prompt.split("\n") == ["<[fim-suffix]>", "<[fim-prefix]><filename>p/R/a.R", "#' x", "f <- function() {", "<<<<<<< CURRENT", "<|user_cursor|>", "=======", "<[fim-middle]>"] and sig.target == "\n  1\n>>>>>>> UPDATED" and not sig.converted
    mid = one(spark, r, kind=("mid_body", "string"), prefix=("f <- function() {\n  a\n  b", "string"), target=("  a\r\n  b\n  c", "string"), **row)
    assert mid.target == "  c\n>>>>>>> UPDATED" and mid.converted and mid.prompt.split("\n")[-5:] == ["  a", "  b", "<|user_cursor|>", "=======", "<[fim-middle]>"]
    assert one(spark, r, kind=("mid_body", "string"), prefix=("f <- function() {\n  a", "string"), target=("  a", "string"), **row) is None


def test_names_and_labels(spark):
    old = context.renamed_pair(F.col("h"), ["if"])
    assert tuple(one(spark, old, h=(["--- a", "-x <- foo(y)", "+x <- bar(y)", " z"], LINES))) == ("foo", "bar")
    assert one(spark, old, h=(["-a", "+b", "+c"], LINES)) is None
    pattern = r"_or_([a-z0-9-]+--[a-z0-9-]+)\.jsonl$"
    label = context.source_label(F.col("n"), {"x.jsonl": "hand"}, {"gem": "Gemini"}, pattern)
    family = context.file_family(F.col("n"), ["gem"], pattern)
    for n, want, fam in [("x.jsonl", "hand", "x"), ("cases_gem.jsonl", "Gemini", "cases"), ("cases_or_a--b.jsonl", "a/b", "cases"), ("plain.jsonl", "corpus", "plain"), ("_gem.jsonl", "Gemini", "misc")]:
        assert (one(spark, label, n=(n, "string")), one(spark, family, n=(n, "string"))) == (want, fam)
    cell = F.col("m")
    assert one(spark, context.filled("{a} and {b}", cell, ["a", "b"]), m=({"a": "1", "b": "2"}, "map<string,string>")) == "1 and 2"
    assert one(spark, context.filled("{a}", cell, ["a"]), m=({"b": "2"}, "map<string,string>")) is None
    style = context.style_of_fields([F.col("a"), F.col("b")], F.col("lang"), F.col("path"))
    args = dict(a=(["x %>% filter(y)"], LINES), b=(["mutate(z)"], LINES), path=("a.R", "string"))
    assert one(spark, style, lang=("r", "string"), **args) == "tidyverse" and one(spark, style, lang=("python", "string"), **args) == "python"


def test_pair_flags_and_outline(spark):
    f = context.pair_flags(*[F.col(c) for c in ("p", "o", "n", "who", "pr", "reply", "made", "merged", "moved")])
    got = one(spark, f, p=([], LINES), o=(["# a", "# b"], LINES), n=(["# a", "# c"], LINES), who=("Copilot", "string"), pr=("Copilot", "string"), reply=(7, "int"), made=("2024", "string"), merged=("2025", "string"), moved=(None, "boolean"))
    assert got == ["comment-only", "no-context", "ai_reviewer", "by_pr_author", "thread-reply", "precedes_merge"]
    fns = spark.createDataFrame([("a", "g", 9), ("a", "f", 2), ("b", "h", 1)], "path string, name string, line int")
    assert {r.path: r.outline for r in context.outline(fns, "path", "name", "line").collect()} == {"a": "2: f\n9: g", "b": "1: h"}
    p = one(spark, context.pinned(F.col("l"), F.col("c"), 2), l=(list("abcdef"), LINES), c=(3, "int"))
    assert (p.before, p.after) == (["b", "c"], ["d", "e"])


def test_change_groups_and_regions(spark):
    rnd = random.Random(2)
    rows = [([rnd.choice("abcd") for _ in range(rnd.randrange(9))], [rnd.choice("abcd") for _ in range(rnd.randrange(9))]) for _ in range(40)]
    d = spark.createDataFrame(rows, f"a {LINES}, b {LINES}")
    for r in d.select("a", "b", context.change_groups(F.col("a"), F.col("b")).alias("g")).collect():
        built, at = [], 0
        for g in r.g:
            built += r.a[at : g.i1] + r.b[g.j1 : g.j2]
            at = g.i2
        assert built + r.a[at:] == r.b
        assert len(r.g) == sum(x[0] != "equal" for x in difflib.SequenceMatcher(None, r.a, r.b, autojunk=False).get_opcodes()) or all(x.i2 < y.i1 for x, y in zip(r.g, r.g[1:], strict=False))
    m = context.mapped_region(F.col("a"), F.col("b"), F.col("r"), F.col("n"))
    assert tuple(one(spark, m, a=(["a", "x", "b"], LINES), b=(["a", "y", "z", "b"], LINES), r=(1, "int"), n=(1, "int"))) == (1, 3)
    assert tuple(one(spark, m, a=(["a", "b"], LINES), b=(["a", "b"], LINES), r=(1, "int"), n=(1, "int"))) == (1, 2)


def test_scores(spark):
    p, t = F.col("p"), F.col("t")
    args = lambda a, b: dict(p=(a, LINES), t=(b, LINES))
    assert one(spark, metrics.shaped_reward(p, t), **args(["a"], ["a "])) == pytest.approx(1.2)
    assert one(spark, metrics.shaped_reward(p, t), **args(["a", "b"], ["a", "c"])) == pytest.approx(0.1)
    assert one(spark, metrics.noop_scores(p, t)[1], **args(["a", ""], ["a"])) == 1.0
    v = metrics.verdict(p, F.col("s"), F.col("a"), F.col("b"))
    for lines, single, shape, change, want in [(["a"], True, None, None, (True, None, None)), (["a", "b"], True, None, "x", (False, "shape", "single-line region family, got 2 line(s)")), (["a", "b"], False, None, "no\nchange", (False, "transform", "no change")), (["a"], True, "bad", "x", (False, "shape", "bad"))]:
        assert tuple(one(spark, v, p=(lines, LINES), s=(single, "boolean"), a=(shape, "string"), b=(change, "string"))) == want


def test_bootstrap(spark):
    rnd = random.Random(5)
    rows = [("a", rnd.gauss(10, 2)) for _ in range(400)] + [("b", rnd.gauss(8, 2)) for _ in range(400)] + [("b", None)]
    for parts in (1, 5):
        d = spark.createDataFrame(rows, "arm string, x double").repartition(parts)
        got = {r.arm: r for r in stats.bootstrap(d, ["arm"], "x", 400).collect()}
        for r in got.values():
            assert r.lo < r.mean < r.hi and 0.25 < r.hi - r.lo < 0.6  # about 4 * 2 / sqrt(400)
        gap = stats.bootstrap_gap(d, "arm", "a", "b", "x", 400).first()
        assert gap.lo < gap.gap < gap.hi and abs(gap.gap - (got["a"].mean - got["b"].mean)) < 1e-9 and gap.lo > 1
    tied = spark.createDataFrame([(1.0,)] * 300 + [(0.0,)] * 300, "x double")
    r = stats.bootstrap(tied, [], "x", 400).first()
    assert 0.05 < r.hi - r.lo < 0.12  # equal rows draw counts of their own: about 4 * 0.5 / sqrt(600)


def test_deck_and_best(spark):
    rows = selection.deck(spark, 30, 1, {"d": ["x", "y"], "c": [1, 2]}, {"s": ["p", "q"], "l": [5, 6]}).collect()
    assert sorted(r.pos for r in rows) == list(range(30))
    first = [r for r in rows if not r.recycled]
    assert len(first) == 16 and len({(r.d, r.c, r.s, r.l) for r in first}) == 16 and all(r.pos >= 16 for r in rows if r.recycled)
    order = {r.pos: (r.d, r.c) for r in rows}
    assert all(order[i] == order[i + 4] for i in range(26)) and len({order[i] for i in range(4)}) == 4
    titles = [("A long title about parsing trees, one", "BUILD", 4.0), ("A long title about parsing trees, two", "BANK", 3.9), ("Another idea", "BANK", 3.0), ("Third idea", "BANK", 2.5), ("Low", "RECYCLE", 1.0)]
    d = spark.createDataFrame(titles, "title string, band string, score double")
    assert sorted(r.title for r in selection.diverse_best(d, "title", "band", "score", 3, 5).collect()) == ["A long title about parsing trees, one", "Another idea", "Third idea"]
    assert [r.title for r in selection.diverse_best(d.where("band = 'RECYCLE'"), "title", "band", "score", 3, 5).collect()] == ["Low"]
