"""The R lexer, its extractors, and case specs."""

import json

import pytest
from pyspark.sql import functions as F

from codeloom import specs
from codeloom.operators import rlex
from codeloom.plans import registry

SOURCE = """#' Add two numbers, with a description that has more than twelve words in it.
#' @param a a number
add <- function(a, b = T) {
  if (b && a > 10) { # a ) in a comment
    x <- dplyr::filter(d, y == ")")
    x <- x %>% head(1:length(a))
  }
  paste("a", 'b', sep = "")
}

f <- function(x) {
  class(x) == "lm"
  mean(x)
  mean(x, na.rm = TRUE)
  expect_equal(f(1), g(2))
}
"""


def test_brackets_match():
    t = rlex.lex(SOURCE)
    assert all(t[x.mate].mate == i for i, x in enumerate(t) if x.mate >= 0)
    assert all(x.mate >= 0 for x in t if x.kind in ("open", "close"))
    assert "".join(x.text for x in t).replace("\n", "") == "".join(m.group() for m in rlex.TOKEN.finditer(SOURCE) if m.lastgroup != "space").replace("\n", "")
    assert rlex.lex(")(") and rlex.lex("")[:0] == []


def test_functions():
    a, f = rlex.functions(SOURCE)
    assert (a["name"], a["rich"], a["cyclomatic"], a["line"], f["rich"], f["body_lines"]) == ("add", True, 3, 2, False, 4)
    assert SOURCE[f["body_start"] : f["body_end"]].startswith("{") and SOURCE[f["body_start"] : f["body_end"]].endswith("}")


@pytest.mark.parametrize(("rule", "n", "text"), [("pipe", 1, "x |> head"), ("tf_true_false", 1, "b = TRUE"), ("seq_along_replace", 1, "head(seq_along(a))"), ("paste_sep_empty", 1, "paste0(\"a\", 'b')"), ("class_inherits", 1, 'inherits(x, "lm")'), ("single_quote", 1, '"a", "b"'), ("namespace_qualify", 1, "<- filter(d"), ("na_rm", 1, "mean(x, na.rm = TRUE)\n  mean(x, na.rm"), ("testthat", 1, "expect_equal(f(1), g(2))")])
def test_rules(rule, n, text):
    found = list(rlex.RULES[rule][1](SOURCE))
    assert len(found) == n and text in rlex.spliced(SOURCE, found[0])


def test_suppressed():
    assert not list(rlex.true_false("T <- 1\nx <- T\n")) and not list(rlex.true_false("x$T; T(1)"))
    assert not list(rlex.seq_along("x <- 2:length(a)")) and not list(rlex.paste_empty('paste(a, sep = "-")'))
    assert not list(rlex.pipes('"a %>% b" # %>%'))


def test_spans_do_not_overlap():
    p = rlex.picked(list(rlex.spans(SOURCE)))
    assert 0 < len(p) <= 4 and all(a["end"] <= b["start"] for a, b in zip(p, p[1:], strict=False))


def test_over_files(spark):
    files = spark.createDataFrame([("p", "a.R", SOURCE), ("p", "b.R", None), ("q", "c.R", "x <- 1")], "package string, path string, source string")
    assert rlex.function_table(files).count() == 2
    assert rlex.sites(files, "pipe").select("package", "line").collect()[0].line == 5
    assert rlex.span_table(files).where("end <= start").count() == 0


SPEC = {"case": "c", "version": 1, "selector": "rows_test", "templates": ["t1", "t2"], "validator": "comment_gate", "row": "comment_prefix", "normalizer": "comment", "checks": ["ends_with_comment_line"]}


def test_specs(spark):
    if ("selector", "rows_test") not in registry.PLUGINS:
        registry.plugin("selector", "rows_test")(lambda df: df)
    s = specs.load(json.dumps(SPEC))
    corpus = spark.createDataFrame([(f"k{i}", ["a"]) for i in range(7)], "key string, prefix array<string>")
    answers = [("k0", "# say it"), ("k1", "say  it"), ("k2", "x <- 1"), ("k3", ""), ("k4", "other"), ("k5", "w" * 99)]
    out = specs.compiled(s, corpus, spark.createDataFrame(answers, "key string, response string"), spark.createDataFrame([("k6",)], "key string"))
    got = {r.key: r.reject for r in out.collect()}
    assert got == {"k0": None, "k1": "duplicate", "k2": "not_prose", "k3": "empty", "k4": None, "k5": "too_long"}
    assert out.where(F.col("reject").isNull()).select(F.element_at("prefix", -1).alias("x")).first().x.startswith("# ")
    assert {r.outcome: r.n for r in specs.report(out).collect()}["accepted"] == 2
    for bad in ({**SPEC, "validator": "none"}, {**SPEC, "more": 1}, {k: v for k, v in SPEC.items() if k != "row"}):
        with pytest.raises(specs.SpecError):
            specs.load(json.dumps(bad))
    with pytest.raises(specs.SpecError):
        specs.load("{")
