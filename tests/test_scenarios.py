"""Scenario extractors, case registries and rules: positive, negative and tampered cases."""

import pytest
from pyspark.sql import functions as F

from codeloom import casebook, specs
from codeloom.operators import context, rlex, scenarios
from codeloom.plans import registry

SOURCE = """library(dplyr)
#' Summarise scores
#'
#' A longer text about what this does with the scores it is given.
#' @param scores a data frame
#' @param group a name
#' @return a data frame
#' @examples
#' x <- make()
#' y <- summarise_scores(x)
#' print(y)
#' plot(y)
#' @export
summarise_scores <- function(scores, group) {
  # keep rows that count and scale them
  kept <- scores %>%
    filter(value > 0) %>%
    mutate(scaled = value / max(value, n = 3L))
  other <- kept$value + 1

  out <- kept %>% summarise(
    a = mean(scaled),
    b = sd(scaled),
    d = var(scaled, na.rm = TRUE)
  )
  label <- "group_name"
  out[["group_name"]] <- label
  last <- kept[, "group_name"]
  cols <- dplyr::select(out, starts_with("a"), everything())
  more <- dplyr::pull(cols, a)
  res <- tryCatch({
    risky(kept)
  },
    error = function(e) NULL,
    warning = function(w) NULL)
  if (is.null(res))
    stop("none")
  else
    message("ok")
  out
}

collect <- function(xs, path) {
  res <- list()
  for (i in seq_along(xs)) {
    res[[i]] <- f(xs[[i]])
    names(res)[[i]] <- names(xs)
  }
  dat <- readRDS(path)
  expect_equal(res, dat)
  res
}
"""
NAMESPACE = "export(a)\nexport(b)\nexport(c)\nimportFrom(x, y)\n"
DESCRIPTION = "Package: p\nImports: cli, dplyr (>= 1.0), rlang,\n    tidyr, utils\nSuggests: x\n"


def found(family, source=SOURCE):
    return list(scenarios.FAMILIES[family][1](source))


@pytest.mark.parametrize("family", ["rename_propagation", "pipe_rewrite", "na_rm_propagation", "doc_sync"])
def test_edits_follow_their_event(family):
    """The region is the file's, the event changes the file's line, and the region's change is another one."""
    lines = SOURCE.split("\n")
    rows = found(family)
    assert rows
    for r in rows:
        assert r["region_old"] == lines[r["line"] : r["line"] + len(r["region_old"])] and r["region_new"] != r["region_old"]
        at = r["event_line"] - 1
        assert lines[at : at + len(r["event_old"])] == r["event_old"] != r["event_new"] and at != r["line"]
        assert r["prefix"] == lines[max(0, r["line"] - 10) : r["line"]]


@pytest.mark.parametrize("family", ["roxygen_drafting", "removed_block", "comment_to_code_real", "pipe_chain_link", "comment_free_block"])
def test_regions_are_the_files_text(family):
    lines = SOURCE.split("\n")
    rows = found(family)
    assert rows
    for r in rows:
        n = len(r["region_new"])
        assert r["region_new"] == lines[r["line"] : r["line"] + n] and r["region_old"] == [""]
        assert r["suffix"] == lines[r["line"] + n : r["line"] + n + len(r["suffix"])]
        assert not r["prefix"] or r["prefix"] == lines[r["line"] - len(r["prefix"]) : r["line"]]


def test_cut_sites():
    rows = found("finish_block_cuts")
    assert {r["kind"].split(":")[0] for r in rows} >= {"fb_cut_first", "fb_cut_middle"} and {r["kind"].split(":")[1] for r in rows} == {"docs", "bare"}
    for r in rows:
        assert "\n".join(r["prefix"] + r["region_new"]) in SOURCE or "\n".join(r["prefix"]) + "\n" + "\n".join(r["region_new"]) in SOURCE


def test_dead_assignments():
    f = next(rlex.functions("f <- function(x) {\n  a <- 1\n  b <- 2\n  g(b)\n  c <- x\n  c\n}"))
    assert f["dead"] == 1


def test_families():
    assert [r["kind"] for r in found("finish_block")] == ["signature", "mid_body"]
    m = found("mid_roxygen")[0]
    assert m["region_old"] + m["region_new"] == SOURCE.split("\n")[1:13]
    t = found("tidyselect_helpers")
    assert [r["region_new"] for r in t] == [['starts_with("a")'], ["everything()"]][:1]
    h = found("trycatch_handlers")[0]
    assert h["region_new"][0].startswith("error =") and h["region_new"][-1].endswith(")")
    c = found("comment_insert")[0]
    assert c["region_old"][0].endswith("<|user_cursor|>") and c["region_new"] + c["suffix"] == found("comment_to_code_real")[0]["region_new"]
    e = {r["kind"] for r in found("mid_body_edit")}
    assert e and e <= {"arg_edit", "na_rm_insert", "rename_once", "insert_line"}
    assert found("namespace_entry", NAMESPACE)[0]["region_new"] == ["export(b)"]
    assert found("description_entry", DESCRIPTION)[0]["region_new"] == ["rlang,"]


@pytest.mark.parametrize(("family", "source"), [
    ("rename_propagation", "f <- function(x) { g(x) }"),
    ("rename_propagation", "f <- function() {\n  val <- 1\n  val2 <- val\n  val\n  val\n}"),
    ("pipe_rewrite", "x %>% f() %>% g()"),
    ("pipe_rewrite", "x %>% f(.)\ny %>% g(.)"),
    ("na_rm_propagation", "library(dplyr)\nmean <- 3\nmean(x)\nmean(y)"),
    ("na_rm_propagation", "mean(x)\nsd(y)"),
    ("doc_sync", "#' @param x a\nf <- function(x) {\n}"),
    ("namespace_entry", "export(b)\nexport(a)"),
    ("description_entry", "Imports: z, a, b"),
    ("trycatch_handlers", "tryCatch(f(), error = function(e) NULL)"),
    ("removed_block", "f <- function(x) {\n  x\n}"),
    ("comment_to_code_real", "# top\nx <- 1\ny <- 2"),
    ("mid_body_edit", "f <- function(x) {\n  x\n}"),
])
def test_restraint(family, source):
    assert found(family, source) == []


def test_format_pairs():
    raw, tidy = ["f=function(x){", "x+1}", "", "y<-2", "z", "g<-1"], ["f = function(x) {", "  x + 1}", "", "y <- 2", "z", "g <- 1"]
    rows = list(scenarios.format_pairs(raw, tidy))
    assert [(r["region_old"], r["region_new"], r["event_old"]) for r in rows] == [(["y<-2"], ["y <- 2"], raw[:2]), (["g<-1"], ["g <- 1"], ["y<-2"])]
    assert not list(scenarios.format_pairs(raw, [*tidy[:3], "y <- 3", *tidy[4:]]))[1:]
    assert not list(scenarios.format_pairs(raw, raw))


def test_statements():
    s = scenarios.Source("f <- function(a) {\n  x <- a +\n    1; y <- 2\n  if (a)\n    b\n  else\n    c\n  for (i in a)\n    d(i,\n      e)\n  function(z)\n    z\n}")
    o = next(s.bodies())[1]
    assert [s.text[s.tokens[a].at : s.tokens[b].at + len(s.tokens[b].text)].split()[0] for a, b in s.statements(o)] == ["x", "y", "if", "for", "function(z)"]


@pytest.fixture(scope="module")
def files(spark):
    rows = [("p", "R/a.R", SOURCE), ("p", "NAMESPACE", NAMESPACE), ("p", "DESCRIPTION", DESCRIPTION), ("q", "R/a.R", SOURCE), ("q", "R/none.R", None), ("q", "R/empty.R", "")]
    return spark.createDataFrame(rows, "package string, path string, source string")


def test_tables(files, spark):
    for family in scenarios.FAMILIES:
        rows = scenarios.scenario_table(files, family).collect()
        assert rows, family
        one = [r for r in rows if r.event_diff]
        for r in one:
            assert r.event_diff.startswith(f'User edited "{r.path}"')
            p = spark.createDataFrame([(r.event_diff,)], "e string").select(context.parsed_event(F.col("e")).alias("p")).first().p if family == "doc_sync" else None
            assert p is None or (p.path, len(p.old), len(p.new)) == (r.path, 1, 1)
    tidy = files.withColumn("source", F.replace("source", F.lit("  "), F.lit("    ")))
    assert scenarios.format_table(files, tidy).count() > 0


SELECTORS = ["c2c_cache_blocks", "tidyselect_helpers", "pipe_chain_links", "trycatch_handlers", "removed_block_sites", "pkg_metadata", "roxygen_blocks", "mid_body_sites", "namespace_qualifiers", "testthat_expectations", "astfim_partial_rows"]


@pytest.mark.parametrize("name", SELECTORS)
def test_selectors(files, name):
    rows = registry.get("selector", name)(files).collect()
    assert rows and len({r.key for r in rows}) == len(rows)
    assert all(r.corpus_target == "\n".join(r.region_new) for r in rows)


def test_transforms(files):
    rows = casebook.transformed(files).collect()
    seen = {r.transform for r in rows}
    assert {"comment_pair", "removed_block", "namespace_qualify", "examples_completion", "loop_to_apply", "trycatch_wrap", "astfim_partial"} <= seen
    loops = {r.kind: r.region_new for r in rows if r.transform == "loop_to_apply"}
    assert loops == {"lapply": ["  res <- lapply(xs, function(i) f(xs[[i]]))", "  names(res) <- names(xs)"], "purrr_map": ["  res <- purrr::map(xs, \\(i) f(xs[[i]]))", "  names(res) <- names(xs)"]}
    wrap = next(r for r in rows if r.transform == "trycatch_wrap")
    assert wrap.region_new[0] == "  tryCatch({" and wrap.region_new[-2] == '    stop("failed in collect: ", conditionMessage(e))' and wrap.region_new[1] == "    res <- list()"
    again = next(r for r in rows if r.transform == "namespace_qualify")
    assert again.region_old == ["  more <- pull(cols, a)"] and again.region_new == ["  more <- dplyr::pull(cols, a)"]


@pytest.mark.parametrize("body", ["for (i in seq_along(x)) { print(x[[i]]) }", "for (i in seq_along(x)) { r[[i]] <- x[[i]] + i }", "for (i in 1:3) { r[[i]] <- x[[i]] }", "for (i in seq_along(x)) { for (j in seq_along(y)) { r[[j]] <- y[[j]] } }", "for (i in seq_along(x)) { r[[i]] <- x[[i]] }\n  i"])
def test_loops_that_stay(body):
    assert not list(casebook._loops(f"f <- function(x, y) {{\n  {body}\n}}"))


CASES = [
    ("r_fragment", "x <- 1\ny <- f(x)", True), ("r_fragment", "x <- (1", False), ("r_fragment", "x <-", False), ("r_fragment", "a b", False), ("r_fragment", "", False),
    ("tidyselect_call", 'starts_with("a")', True), ("tidyselect_call", "starts_with(a)", False), ("tidyselect_call", 'tidyselect::all_of(c("a"))', True), ("tidyselect_call", "where(is.numeric)", True), ("tidyselect_call", 'mean("a")', False), ("tidyselect_call", "contains()", False),
    ("pipe_link", "filter(x > 1) %>%", True), ("pipe_link", "%>%", False), ("pipe_link", "x > 1) |>", True), ("pipe_link", "filter(x > 1", False),
    ("expect_call_tail", "equal(f(1), 2)", True), ("expect_call_tail", "f(1), 2)", True), ("expect_call_tail", "f(1), 2))", False),
    ("handler_clauses", "error = function(e) NULL)", True), ("handler_clauses", "error = function(e, f) NULL)", False), ("handler_clauses", "oops = function(e) NULL)", False), ("handler_clauses", "finally = done())", True),
    ("mid_body_edit_line", "x <- mean(y, na.rm = TRUE)", True), ("mid_body_edit_line", "x <- 1\ny <- 2", False), ("mid_body_edit_line", "x <- mean(", False),
    ("comment_gate", "Compute the mean", True), ("comment_gate", "x <- 1", False), ("corpus_side", " ", False),
]


def test_validators(spark):
    for name in {c[0] for c in CASES}:
        mine = [(i, t, ok) for i, (n, t, ok) in enumerate(CASES) if n == name]
        d = spark.createDataFrame(mine, "i int, t string, ok boolean")
        got = d.select("t", "ok", specs.get("validator", name)(F.col("t")).alias("why")).collect()
        assert [(r.t, r.why is None) for r in got] == [(r.t, r.ok) for r in got], name


def test_checks(files):
    """Rows of the corpus pass; rows with a changed target do not."""
    pairs = [("pipe_chain_links", "pipe_cut_cursor"), ("testthat_expectations", "expect_cut_cursor"), ("trycatch_handlers", "handler_cut_cursor"), ("namespace_qualifiers", "qualified_call_cursor"), ("pkg_metadata", "sorted_entry_slot"), ("astfim_partial_rows", "astfim_partial_site"), ("mid_body_sites", "mid_body_edit_site")]
    for selector, check in pairs:
        rows = registry.get("selector", selector)(files).withColumn("model_target", F.col("corpus_target")).withColumn("corpus_line", F.concat(F.element_at("prefix", -1), F.get("region_new", F.lit(0))))
        good = rows.select(registry.get("check", check)(rows).alias("ok")).collect()
        assert good and all(r.ok for r in good), check
        bad = rows.withColumn("region_new", F.array(F.lit("aaa(1)"), F.lit("x"))).withColumn("model_target", F.lit("aaa"))
        assert not any(r.ok for r in bad.select(registry.get("check", check)(bad).alias("ok")).collect()), check
    removed = registry.get("transform", "removed_block")(files)
    assert all(r.ok for r in removed.select(registry.get("check", "removed_block_site")(removed).alias("ok")).collect())
    cut = removed.withColumn("suffix", F.array().cast("array<string>"))
    assert not any(r.ok for r in cut.select(registry.get("check", "removed_block_site")(cut).alias("ok")).collect())


@pytest.mark.parametrize(("rule", "source", "want"), [
    ("stopifnot_named", 'f <- function(x) {\n  if (!is.numeric(x)) stop("x must be numeric")\n  x + 1\n}\n', ['stopifnot("x must be numeric" = is.numeric(x))']),
    ("stopifnot_named", 'f <- function(x) {\n  if (!is.numeric(x)) {\n    stop("no")\n  }\n  x\n}\n', ['stopifnot("no" = is.numeric(x))']),
    ("stopifnot_named", 'if (!is.numeric(x)) stop("bad", call. = FALSE)', []),
    ("stopifnot_named", 'if (is.numeric(x)) x else stop("no")', []),
    ("stopifnot_named", 'if (!a && b) stop("no")', []),
    ("tidyeval_data_pronoun", "dplyr::filter(df, .data$value > 0)", ["value"]),
    ("tidyeval_data_pronoun", "mutate(df, y = .data$x + .data$z)", ["x", "z"]),
    ("tidyeval_data_pronoun", 'a <- l$.data$x\nb <- df[[".data$x"]]', []),
    ("tidyeval_data_pronoun", "x <- .data$value\nfilter(df, value > 0)", []),
    ("seq_along_replace", "1:NROW(x)", ["seq_len(NROW(x))"]),
])
def test_more_rules(rule, source, want):
    assert [x["rewrite"] for x in rlex.RULES[rule][1](source)] == want


def test_base_samples(files):
    f = rlex.function_table(files)
    got = casebook.base_samples(f, 1, 10).collect()
    assert sorted(r.package for r in got) == ["p", "q"] and len({r.base_sample_id for r in got}) == 2
