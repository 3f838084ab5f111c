"""Queries of code extractors over sources that are built from the documents; SQL builds the same sources and works out the rows by itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import casebook
from ..functions import text as T
from ..operators import rlex, scenarios
from .registry import get, query

WORDS = "list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z \n]', '', 'g'), '[ \t\n\r\f\v]+'), lambda x: len(x) > 2)"


def words(n):
    """The first words of a document, as names: lower-case letters only."""
    return F.slice(F.filter(T.words(F.regexp_replace(F.lower("text"), "[^a-z \n]", "")), lambda x: F.length(x) > 2), 1, n)


def files(t, source):
    return t("documents").select(F.col("source").alias("package"), F.concat(F.lit("R/"), F.col("doc_id").cast("string"), F.lit(".R")).alias("path"), source.alias("source"))


@query(f"""WITH w AS (SELECT doc_id, source, {WORDS}[1:6] AS w FROM documents), l AS (SELECT doc_id, source, unnest(w) AS w, unnest(range(len(w))) AS i FROM w)
SELECT source AS package, 'R/' || doc_id || '.R' AS path, CAST(i + 1 AS INTEGER) AS line, 'x <- select(df,' AS head, 'starts_with(' || chr(34) || w || chr(34) || ')' AS target, ', y)' AS tail FROM l""")
def tidyselect_sites(t, spark):
    """A helper on each of up to six lines."""
    src = F.concat(F.lit("library(dplyr)\n"), F.array_join(F.transform(words(6), lambda w: F.concat(F.lit('x <- select(df, starts_with("'), w, F.lit('"), y)'))), "\n"))
    rows = get("selector", "tidyselect_helpers")(files(t, src))
    return rows.select("package", "path", "line", F.element_at("prefix", -1).alias("head"), "corpus_target", F.get("suffix", F.lit(0)).alias("tail")).withColumnRenamed("corpus_target", "target")


@query(f"""WITH w AS (SELECT doc_id, source, list_sort(list_distinct({WORDS}[1:9])) AS w FROM documents), m AS (SELECT *, CASE WHEN len(w) > 2 THEN len(w) // 2 ELSE 0 END AS i FROM w WHERE len(w) > 0)
SELECT source AS package, 'R/' || doc_id || '.R' AS path, CAST(i AS INTEGER) AS line, 'export(' || w[i + 1] || ')' AS target, CAST(i AS INTEGER) AS above FROM m""")
def namespace_slots(t, spark):
    """Sorted export directives: the middle one is to be put back."""
    names = F.array_sort(F.array_distinct(words(9)))
    src = F.array_join(F.transform(names, lambda w: F.concat(F.lit("export("), w, F.lit(")"))), "\n")
    rows = scenarios.scenario_table(files(t, src), "namespace_entry")
    return rows.select("package", "path", "line", F.get("region_new", F.lit(0)).alias("target"), F.size("prefix").alias("above"))


@query(f"""WITH w AS (SELECT doc_id, source, {WORDS}[1:4] AS w FROM documents), l AS (SELECT doc_id, source, w, unnest(range(1, len(w))) AS i FROM w)
SELECT source AS package, 'R/' || doc_id || '.R' AS path, CAST(i + 1 AS INTEGER) AS line, 'mean(' || w[i + 1] || ', na.rm = TRUE)' AS target, '@@ -' || (i + 1) || ' +' || (i + 1) || ' @@' AS at FROM l""")
def na_rm_edits(t, spark):
    """Calls that lack na.rm, line under line: each follows the one above."""
    src = F.concat(F.lit("library(dplyr)\n"), F.array_join(F.transform(words(4), lambda w: F.concat(F.lit("mean("), w, F.lit(")"))), "\n"))
    rows = scenarios.scenario_table(files(t, src), "na_rm_propagation")
    return rows.select("package", "path", "line", F.get("region_new", F.lit(0)).alias("target"), F.regexp_extract("event_diff", "@@ [^\n]*@@", 0).alias("at"))


@query(f"""WITH w AS (SELECT doc_id, source, {WORDS}[1:8] AS w FROM documents), l AS (SELECT doc_id, source, unnest(w) AS w, unnest(range(len(w))) AS i FROM w)
SELECT source AS package, 'R/' || doc_id || '.R' AS path, CAST(i AS INTEGER) AS line, 'tf_true_false' AS rule, 'TRUE' AS rewrite FROM l WHERE i % 3 = 0 UNION ALL SELECT source, 'R/' || doc_id || '.R', CAST(i AS INTEGER), 'seq_along_replace', 'seq_along(' || w || ')' FROM l WHERE i % 3 = 1 UNION ALL SELECT source, 'R/' || doc_id || '.R', CAST(i AS INTEGER), 'paste_sep_empty', 'paste0(' || w || ')' FROM l WHERE i % 3 = 2""")
def lint_rewrites(t, spark):
    """Three rules over lines of which each holds one rule's site."""
    line = lambda w, i: F.when(i % 3 == 0, F.concat(w, F.lit(" <- T"))).when(i % 3 == 1, F.concat(F.lit("1:length("), w, F.lit(")"))).otherwise(F.concat(F.lit("paste("), w, F.lit(', sep = "")')))
    f = files(t, F.array_join(F.transform(words(8), line), "\n"))
    out = None
    for rule in ("tf_true_false", "seq_along_replace", "paste_sep_empty"):
        s = rlex.sites(f, rule).select("package", "path", "line", "rule", "rewrite")
        out = s if out is None else out.union(s)
    return out


@query("SELECT transform, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(['trycatch_wrap', 'loop_to_apply', 'loop_to_apply']) AS transform FROM documents) GROUP BY transform")
def transform_yield(t, spark):
    """Every source has a loop that only accumulates (two rewrites) and a body that reads a file (one)."""
    src = F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(" <- function(xs, path) {\n  out <- list()\n  for (i in seq_along(xs)) {\n    out[[i]] <- g(xs[[i]])\n  }\n  d <- readRDS(path)\n  out\n}\n"))
    return casebook.transformed(files(t, src), ["loop_to_apply", "trycatch_wrap"]).groupBy("transform").agg(F.count("*").alias("n"))
