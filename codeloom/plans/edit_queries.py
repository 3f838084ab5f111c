"""Queries of edits, prompts, licenses, ratings and gates, over fixtures and over fields that both engines derive from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import classify, edits, metrics, signals, tables
from .registry import query

#: (id, path, prefix, old, new, suffix), lines joined by |, no lines as an empty string.
PAIRS = [
    (1, "R/a.R", "x <- 1", "y <- 2|z <- 3", "y <- 2|z <- 4", "print(z)"),
    (2, "README.md", "", "a|b", "a|b", ""),
    (3, "R/b.R", "f <- function() {", "# one|# two", "# one|# three", "}"),
    (4, "tests/_snaps/c.R", "", "a", "a|b|c|d|e|f|g|h|i|j|k|l|m|n", ""),
    (5, "R/d.R", "k", "  a", "a  ", "m"),
    (6, "R/e.R", "k", "a|b", "", "m"),
    (7, "R/f.R", "k", "", "new line", "m"),
    (8, "NEWS", "k", "a|b|c", "a|b", "m"),
]
VALUES = ", ".join("(" + ", ".join(repr(v) for v in r) + ")" for r in PAIRS)
LINES = "CASE WHEN {0} = '' THEN CAST([] AS VARCHAR[]) ELSE string_split({0}, '|') END"
SQL_PAIRS = f"e AS (SELECT id, path, {LINES.format('p')} AS p, {LINES.format('o')} AS o, {LINES.format('n')} AS n, {LINES.format('s')} AS s FROM (VALUES {VALUES}) AS v(id, path, p, o, n, s))"


def pairs(spark):
    d = spark.createDataFrame(PAIRS, "id int, path string, p string, o string, n string, s string")
    return d.withColumns({c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, r"\|")) for c in "pons"})


RATIO = "list_sum(list_transform(range(1, least(len(so), len(sn)) + 1), lambda i: CASE WHEN so[i] = sn[i] THEN 1 ELSE 0 END))"


@query(f"""WITH {SQL_PAIRS}, b AS (SELECT *, list_filter(o, lambda x: trim(x) <> '') AS so, list_filter(n, lambda x: trim(x) <> '') AS sn, lower(path) AS l FROM e)
SELECT id, array_to_string(list_filter([
CASE WHEN regexp_matches(l, '[.](md|rmd|qmd|txt|yaml|yml|json|toml|cfg|ini)$') THEN 'docsfile' END,
CASE WHEN regexp_matches(l, 'snapshot|_snaps|news|description| changelog|cran-comments') THEN 'churnfile' END,
CASE WHEN list_transform(o, lambda x: trim(x)) = list_transform(n, lambda x: trim(x)) THEN 'ws-only' END,
CASE WHEN len(so) > 0 AND len(sn) > 0 AND len(list_filter(list_concat(so, sn), lambda x: NOT regexp_matches(trim(x), '^(#|//|[*])'))) = 0 THEN 'comment-only' END,
CASE WHEN len(n) - len(o) > 12 THEN 'large-grow' END,
CASE WHEN len(p) = 0 AND len(s) = 0 THEN 'no-context' END,
CASE WHEN coalesce({RATIO}, 0) / greatest(len(so), len(sn), 1) > 0.9 THEN 'mostly-unchanged' END], lambda x: x IS NOT NULL), ',') AS flags FROM b""")
def audit_flags(t, spark):
    return pairs(spark).select("id", F.array_join(edits.flags(F.col("path"), F.col("p"), F.col("o"), F.col("n"), F.col("s")), ",").alias("flags"))


FD = "coalesce(list_min(list_filter(range(0, least(len(o), len(n))), lambda i: o[i + 1] <> n[i + 1])), least(len(o), len(n)))"


@query(f"""WITH {SQL_PAIRS}, f AS (SELECT *, {FD} AS fd FROM e), g AS (SELECT *, rtrim(array_to_string(n[fd + 1 :], chr(10))) AS body FROM f)
SELECT id, CAST(fd AS INTEGER) AS fd, CASE WHEN trim(body) <> '' THEN body || chr(10) || '>>>>>>> UPDATED' END AS target, CASE WHEN len(list_filter(n, lambda x: trim(x) <> '')) = 0 THEN 'empty_region_new' WHEN trim(body) = '' THEN 'empty_after_head_strip' END AS reason FROM g""")
def first_diff_suffix_target(t, spark):
    fd, target, reason = edits.suffix_target(F.col("o"), F.col("n"))
    return pairs(spark).select("id", fd.cast("int").alias("fd"), target.alias("target"), reason.alias("reason"))


@query(f"""WITH {SQL_PAIRS}, c AS (SELECT *, CAST(greatest({FD} - 1, 0) AS INTEGER) AS k FROM e)
SELECT id, array_to_string(list_concat(list_concat(list_concat(list_concat(['<[fim-suffix]>'], s), ['<[fim-prefix]><filename>edit_history', '<filename>' || path]), list_append(p, '<<<<<<< CURRENT')), list_concat(list_transform(range(1, len(o) + 1), lambda i: CASE WHEN i = k + 1 THEN o[i] || '<|user_cursor|>' ELSE o[i] END), ['=======', '<[fim-middle]>'])), chr(10)) AS prompt FROM c""")
def render_merge_prompt(t, spark):
    fd = F.greatest(edits.first_difference(F.col("o"), F.col("n")) - 1, F.lit(0))
    return pairs(spark).select("id", edits.render_merge(F.col("path"), F.col("p"), F.col("o"), fd, F.col("s"), F.lit(None).cast("string")).alias("prompt"))


RATINGS = [("a", "p1", 5.0, 4.0, 3.0, 6.0, 5.0), ("b", "p1", 3.0, 4.0, None, 2.0, 5.0), ("a", "p2", 1.0, None, None, 2.0, 1.0), ("a", "p3", -1.0, 2.0, 2.0, None, 3.0)]
RVALUES = ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in r) + ")" for r in RATINGS)


@query(f"""WITH m AS (SELECT pid, {', '.join(f'avg(CASE WHEN {a} IS NOT NULL THEN least(5.0, greatest(0.0, {a})) END) AS {a}' for a in ('signal', 'novelty', 'build', 'risk'))}, min(ready) AS low, count(*) AS n FROM (VALUES {RVALUES}) AS v(rater, pid, signal, novelty, build, risk, ready) GROUP BY pid),
c AS (SELECT *, list_filter([signal, novelty, build, risk], lambda x: x IS NOT NULL) AS l FROM m)
SELECT pid, CASE WHEN len(l) >= 3 THEN round(list_sum(l) / len(l), 6) END AS composite, low = 5 AND n >= 2 AS unanimous, CASE WHEN len(l) < 3 THEN 'RECYCLE' WHEN list_sum(l) / len(l) >= 3.5 THEN 'BUILD' WHEN list_sum(l) / len(l) >= 2 THEN 'BANK' ELSE 'RECYCLE' END AS band FROM c""")
def rating_bands(t, spark):
    axes = ["signal", "novelty", "build", "risk"]
    d = spark.createDataFrame(RATINGS, "rater string, pid string, signal double, novelty double, build double, risk double, ready double")
    means, composite = classify.rating(axes, axes)
    m = d.groupBy("pid").agg(*[c.alias(a) for a, c in means.items()], F.min("ready").alias("low"), F.count("*").alias("n")).withColumn("c", composite)
    band = F.when(F.col("c") >= 3.5, "BUILD").when(F.col("c") >= 2, "BANK").otherwise("RECYCLE")
    return m.select("pid", F.round("c", 6).alias("composite"), ((F.col("low") == 5) & (F.col("n") >= 2)).alias("unanimous"), band.alias("band"))


GATES = [(1, True, True, True, False), (2, None, True, True, True), (3, True, True, None, None), (4, True, False, True, True), (5, True, True, None, True)]


@query("""WITH g(id, a, b, c, d) AS (VALUES (1, true, true, true, false), (2, NULL, true, true, true), (3, true, true, NULL, NULL), (4, true, false, true, true), (5, true, true, NULL, true))
SELECT CASE WHEN NOT (coalesce(a, false) AND coalesce(b, false)) THEN 'reject' WHEN NOT (coalesce(c, false) OR coalesce(d, false)) THEN 'no_value' ELSE 'accept' END AS verdict, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY 1""")
def gate_verdict(t, spark):
    d = spark.createDataFrame(GATES, "id int, a boolean, b boolean, c boolean, d boolean")
    return d.select(classify.gate_verdict(["a", "b", "c", "d"], ["a", "b"], ["c", "d"]).alias("verdict")).groupBy("verdict").agg(F.count("*").alias("n"))


@query("WITH j(id, swap, winner) AS (VALUES (1, false, 'A'), (2, true, 'A'), (3, true, 'B'), (4, false, 'tie')) SELECT CASE WHEN winner = 'tie' THEN 'tie' WHEN (winner = 'A') <> swap THEN 'candidate' ELSE 'anchor' END AS side, CAST(count(*) AS BIGINT) AS n FROM j GROUP BY 1")
def judge_swap(t, spark):
    d = spark.createDataFrame([(1, False, "A"), (2, True, "A"), (3, True, "B"), (4, False, "tie")], "id int, swap boolean, winner string")
    side = F.when(F.col("winner") == "tie", "tie").when((F.col("winner") == "A") != F.col("swap"), "candidate").otherwise("anchor")
    return d.groupBy(side.alias("side")).agg(F.count("*").alias("n"))


@query()
def line_f1_scores(t, spark):
    rows = [(1, ["a", "b"], ["a", "b "]), (2, ["a", "c"], ["a", "b"]), (3, [], ["a"]), (4, [], []), (5, ["b", "a"], ["a", "b"])]
    d = spark.createDataFrame(rows, "id int, pred array<string>, target array<string>")
    p, g = F.col("pred"), F.col("target")
    return d.select("id", metrics.exact(p, g).alias("exact"), metrics.first_line(p, g).alias("first_line"), metrics.line_f1(p, g).alias("f1"), metrics.exact_reward(p, g).alias("reward"))


@query("SELECT lang AS area, CAST(count(*) AS BIGINT) AS n, round(sum(len(string_split(text, ' '))) / sum(strlen(text)), 6) AS ratio, round(sum(len(string_split(text, ' '))) / sum(strlen(text)) * sum(n_chars), 3) AS estimate FROM documents GROUP BY lang")
def stratified_token_estimate(t, spark):
    d = t("documents").select(F.col("lang").alias("area"), F.size(F.split("text", " ")).alias("tokens"), F.octet_length("text").alias("bytes"), "n_chars")
    e = signals.token_estimate(d, d.groupBy("area").agg(F.sum("n_chars").alias("bytes")), "area")
    return e.select("area", "n", F.round("ratio", 6).alias("ratio"), F.round("estimate", 3).alias("estimate"))


@query("SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END), 6) AS rate, round(avg(l_tax), 6) AS value FROM lineitem GROUP BY l_returnflag")
def cell_collapse(t, spark):
    l = t("lineitem").withColumn("hit", (F.col("l_discount") > 0.05).cast("int"))
    return signals.collapsed(l, ["l_returnflag"], "l_linestatus", "hit", "l_tax").select("l_returnflag", "n", F.round("rate", 6).alias("rate"), F.round("value", 6).alias("value"))


@query("SELECT page_id, len(list_distinct(regexp_extract_all(html, 'github[.]com/([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+)', 1))) AS n_repos FROM pages")
def page_repo_links(t, spark):
    return t("pages").select("page_id", F.size(signals.repo_links(F.col("html"))).cast("bigint").alias("n_repos"))


#: Fields, heads and snippets from which rows draw by their number; SQL works out the answers.
FIELDS = ["MIT + file LICENSE", "GPL-2 | CC BY-NC 4.0", "Artistic-2.0", "", "file LICENSE", "CC BY-NC 4.0", "AGPL-3 | GPL-3", "Unlimited", "Apache License (>= 2)", "unknown", "LGPL (>= 2) | EPL", "CC0", "MPL-2.0 | BSD_3_clause", "CeCILL-2", " CC BY 4.0 ", "GPL | MIT"]
HEADS = ["GNU General Public License, noncommercial distribution", "This work: CC BY-NC 4.0", "Permission is hereby granted, free of charge", "plain words only", "GNU Lesser General Public", "for non-commercial use only, BSD style", "Cecill and CC0"]
CODE = ["library(dplyr)\nx <- y %>% filter(a %in% b)", "plain", "```r\nx\n```", "```python\nimport numpy\n```", "read.csv(f)", "saveRDS(x, f); stopifnot(y)"]
PATHS = ["R/a.R", "DESCRIPTION", "man/x.Rd", "src/y.cpp", "inst/z", "inst/doc/a.R", "vignettes/a.Rmd", "src/a.c", "inst/a.h", "x.bin", "NEWS.md", "inst/doc/b.Rmd", "docs/i.html", "R/old.r", "a.b/c"]
SNIPPETS = ["for (i in x) f(i)", "purrr::map(x, f)", "f(x)", "x |> f()", "  a", "a", "x = T", "x = TRUE", "sapply(x, f)", "vapply(x, f, 1)", "seq_along(x)", "1:length(x)", "inherits(x, 'a')", "class(x) == 'a'", "mutate(d)", "lapply(x, f)"]
FILES = ["library(x)\nz <<- 1", 'library(y); paste(a, sep = "")', "x <- T\ny = 1:length(x)", "'T; library(z)'", 'f("ifelse(a)")\nsapply(x, f)', "ifelse(a, b, c); stopifnot(d)", "# TODO fix\nclass(x) == 'a'", "x[1, ]\nmean(x, na = TRUE)", "if (a == b && c) paste0(d, e)", "a == b | c == d\nseq()"]
FIXES = [("true_false_symbol", "x = TRUE", None, "T"), ("true_false_symbol", "x = T", None, "T"), ("true_false_symbol", "x = FALSE", None, "T"), ("paste0_sep", "paste0(a)", None, None), ("paste0_sep", "paste0(paste(a))", None, None), ("sapply_vapply", "vapply(x, f, logical(1))", "logical(1)", None), ("sapply_vapply", "vapply(x, f, character(1))", "logical(1)", None), ("sapply_vapply", "vapply(sapply(x))", None, None), ("seq_safety", "1:length(x)", None, None), ("seq_safety", "seq_len(n)", None, None), ("class_equals", "inherits(x, 'a')", None, None), ("class_equals", "is(x)", None, None), ("other", "a", None, None), ("other", "b", None, None)]
CELLS = ["CC BY 4.0", "non-exclusive", "CC BY-NC 4.0", "", "CC0", "all rights", "https://creativecommons.org/x"]


def quoted(v):
    """A string, for SQL."""
    return "NULL" if v is None else "'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def listed(values):
    return "[" + ", ".join(map(quoted, values)) + "]"


def drawn(values, key="doc_id"):
    """One of the values for each row, by a number."""
    return F.get(F.array(*map(F.lit, values)), F.pmod(F.col(key), F.lit(len(values))).cast("int"))


def draw_sql(values, key="doc_id"):
    return f"{listed(values)}[1 + {key} % {len(values)}]"


BAD = "(" + " OR ".join(f"contains(x, '{m}')" for m in classify.NC_ND) + ")"
RANK = "CASE " + " ".join(f"WHEN regexp_matches(x, '{p}') THEN {i}" for i, (_, p) in enumerate(classify.LICENSES, 1)) + " END"
PLACE = {n: i for i, (n, _) in enumerate(classify.LICENSES, 1)}
FLAG = "CASE " + " ".join(f"WHEN list_contains(ranks, {PLACE[n]}) THEN '{f}'" for n, f in classify.FLAGGED) + " ELSE '' END"


@query(f"""WITH f AS (SELECT doc_id, trim({draw_sql(FIELDS)}) AS f FROM documents), a AS (SELECT doc_id, f, list_transform(string_split(lower(f), '|'), lambda x: trim(x)) AS alts FROM f),
r AS (SELECT *, list_filter(list_transform(list_filter(alts, lambda x: NOT {BAD}), lambda x: {RANK}), lambda x: x IS NOT NULL) AS ranks FROM a), k AS (SELECT *, f = '' OR lower(f) IN ('unknown', 'what license?') AS none, len(list_filter(alts, lambda x: {BAD})) > 0 AS bad FROM r)
SELECT doc_id, CASE WHEN NOT none AND len(ranks) > 0 THEN 'include' ELSE 'exclude' END AS decision, CASE WHEN none THEN 'unclassified' WHEN len(ranks) > 0 THEN {listed(n for n, _ in classify.LICENSES)}[list_min(ranks)] WHEN bad THEN 'NC/ND' ELSE 'unclassified' END AS license_class, CASE WHEN NOT none AND len(ranks) > 0 THEN {FLAG} ELSE '' END AS flag,
CASE WHEN none THEN 'empty-or-unknown-license-field' WHEN len(ranks) > 0 THEN '' WHEN bad THEN 'only-nc-nd-alternatives-in-field' WHEN len(list_filter(alts, lambda x: contains(x, 'file license'))) > 0 THEN 'file-license-no-file-or-empty' ELSE 'unrecognized-license-field:' || substr(f, 1, 60) END AS reason FROM k""")
def license_classify(t, spark):
    return t("documents").select("doc_id", classify.license_class(drawn(FIELDS)).alias("c")).select("doc_id", "c.*")


MARK = "CASE " + " ".join(f"WHEN contains(l, '{m}') THEN '{n}'" for n, m in classify.TEXT_MARKS) + " END"


@query(f"""WITH l AS (SELECT doc_id, lower({draw_sql(HEADS)} || chr(10) || text) AS l FROM documents), m AS (SELECT *, regexp_matches(l, {quoted(classify.NC_ND_TEXT)}) AS nc, {MARK} AS mark FROM l)
SELECT doc_id, CASE WHEN NOT nc AND mark IS NOT NULL THEN 'include' ELSE 'exclude' END AS decision, CASE WHEN nc THEN 'NC/ND' ELSE coalesce(mark, 'unclassified') END AS license_class FROM m""")
def license_override(t, spark):
    """A field that points to a file, and texts with a license head."""
    d = t("documents").select("doc_id", F.concat(drawn(HEADS), F.lit("\n"), "text").alias("body"))
    return d.select("doc_id", classify.license_class(F.lit("file LICENSE"), F.col("body")).alias("c")).select("doc_id", "c.decision", "c.license_class")


STRONG = " + ".join(f"len(regexp_extract_all(b, {quoted(p)}))" for p in classify.STRONG)
FENCED = f"len(list_filter(regexp_extract_all(o, '{classify.FENCE}', 1), lambda x: lower(x) IN ({', '.join(map(quoted, classify.R_TAGS))}))) > 0"


@query(f"""WITH o AS (SELECT doc_id, lang, {draw_sql(CODE)} || chr(10) || text AS o FROM documents), b AS (SELECT doc_id, o, lang || chr(10) || o AS b FROM o) SELECT doc_id, {FENCED} OR ({STRONG}) >= 2 AS keep FROM b""")
def strict_cut(t, spark):
    d = t("documents").select("doc_id", "lang", F.concat(drawn(CODE), F.lit("\n"), "text").alias("o"))
    return d.select("doc_id", classify.strict(F.col("lang"), F.col("o")).alias("keep"))


def score_sql(x, markers):
    return "(" + " + ".join(f"{w} * least(len(regexp_extract_all({x}, {quoted(p)})), {cap})" for p, w, cap in markers) + ")"


def mass_sql(tags):
    return f"coalesce(list_sum(list_transform(range(1, len(k) + 1), lambda i: CASE WHEN lower(k[i]) IN ({', '.join(map(quoted, tags))}) THEN length(b[i]) ELSE 0 END)), 0)"


@query(f"""WITH o AS (SELECT doc_id, lang AS g, {draw_sql(CODE)} || chr(10) || text AS o FROM documents), f AS (SELECT *, regexp_extract_all(o, {quoted(classify.FENCE_BLOCK)}, 1) AS k, regexp_extract_all(o, {quoted(classify.FENCE_BLOCK)}, 2) AS b FROM o),
m AS (SELECT doc_id, {mass_sql(classify.R_TAGS)} AS r, {mass_sql(classify.OTHER_TAGS)} AS n, {score_sql('o', classify.R_MARKERS)} + 0.3 * {score_sql('g', classify.R_MARKERS)} AS rs, {score_sql('o', classify.OTHER_MARKERS)} + 0.3 * {score_sql('g', classify.OTHER_MARKERS)} AS os FROM f),
c AS (SELECT *, CASE WHEN r > 0 AND r / (r + n) >= 0.35 AND rs >= 4 AND rs >= os THEN 'r_fence_dominant' WHEN rs >= 6 AND rs >= 1.5 * greatest(os, 1) AND NOT (n > 800 AND r = 0) THEN 'token_dominant' ELSE '' END AS reason FROM m)
SELECT doc_id, reason <> '' AS accept, reason, CAST(round(rs, 1) AS DOUBLE) AS r_score, CAST(round(os, 1) AS DOUBLE) AS o_score FROM c""")
def fence_mass_accept(t, spark):
    d = t("documents").select("doc_id", F.col("lang").alias("given"), F.concat(drawn(CODE), F.lit("\n"), "text").alias("answer"))
    return classify.detect(d, "given", "answer").select("doc_id", "accept", "reason", F.round("r_score", 1).alias("r_score"), F.round("o_score", 1).alias("o_score"))


@query("WITH v AS (SELECT source, doc_id % 3 AS a, doc_id % 13 AS b, doc_id % 7 AS c FROM documents) SELECT source, arg_max(a || '.' || b || '-' || c, [a, b, c]) AS version FROM v GROUP BY source")
def highest_version(t, spark):
    part = lambda n: (F.col("doc_id") % n).cast("string")
    return tables.highest_version(t("documents").select("source", F.concat(part(3), F.lit("."), part(13), F.lit("-"), part(7)).alias("version")), "source", "version")


@query("""WITH n AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_type || '_tmp' WHEN 1 THEN 'a.' || event_type WHEN 2 THEN 'if_tmp' WHEN 3 THEN '2' || event_type ELSE event_type END AS old FROM events)
SELECT event_id, old, CASE event_id % 5 WHEN 0 THEN regexp_replace(old, '_tmp$', '') WHEN 1 THEN replace(old, '.', '_') WHEN 4 THEN old || '2' END AS new FROM n""")
def rename_rule(t, spark):
    c, e = F.col("event_id") % 5, F.col("event_type")
    old = F.when(c == 0, F.concat(e, F.lit("_tmp"))).when(c == 1, F.concat(F.lit("a."), e)).when(c == 2, "if_tmp").when(c == 3, F.concat(F.lit("2"), e)).otherwise(e)
    return t("events").select("event_id", old.alias("old")).withColumn("new", classify.new_name(F.col("old")))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)
SELECT doc_id, CAST(1 AS INTEGER) AS k, CAST(doc_id + 1 AS INTEGER) AS old_start, CAST(count(*) FILTER (i % 3 <> 1) AS INTEGER) AS old_count, CAST(3 AS INTEGER) AS new_start, CAST(count(*) FILTER (i % 3 <> 2) AS INTEGER) AS new_count, CAST(count(*) FILTER (i % 3 = 1) AS INTEGER) AS added, CAST(count(*) FILTER (i % 3 = 2) AS INTEGER) AS removed FROM l GROUP BY doc_id
UNION ALL SELECT doc_id, 2, 9, 1, 10, 1, 1, 1 FROM documents""")
def hunk_parse(t, spark):
    """A diff of two hunks from each text: every third line is added, every third removed."""
    l = F.split("text", "\n")
    n = lambda k: F.size(F.filter(F.transform(l, lambda x, i: i % 3), lambda m: m != k)).cast("string")
    body = F.array_join(F.transform(l, lambda x, i: F.concat(F.when(i % 3 == 1, "+").when(i % 3 == 2, "-").otherwise(" "), x)), "\n")
    diff = F.concat(F.lit("--- a\n+++ b\n@@ -"), (F.col("doc_id") + 1).cast("string"), F.lit(","), n(1), F.lit(" +3,"), n(2), F.lit(" @@ f\n"), body, F.lit("\n@@ -9 +10 @@\n-x\n+y\n"))
    d = t("documents").select("doc_id", F.posexplode(edits.hunks(diff)).alias("k", "h"))
    added, removed = edits.hunk_counts(F.col("h.lines"))
    return d.select("doc_id", (F.col("k") + 1).alias("k"), "h.old_start", "h.old_count", "h.new_start", "h.new_count", added.alias("added"), removed.alias("removed"))


@query(f"""WITH p AS (SELECT doc_id, {draw_sql(PATHS)} AS p FROM documents), e AS (SELECT *, lower(regexp_extract(p, '([.][^./]*)$', 1)) AS e FROM p)
SELECT doc_id, CASE WHEN contains(p, '/') THEN string_split(p, '/')[1] ELSE '.' END AS area, CASE WHEN e = '.r' THEN 'R' WHEN e IN ('.rd', '.rmd', '.qmd', '.rnw', '.md') THEN 'Rdocs' WHEN e IN ('.c', '.h', '.cpp', '.hpp', '.cc', '.f', '.f90') THEN 'C' WHEN regexp_matches(p, '(^|/)(DESCRIPTION|NAMESPACE|LICENSE|NEWS)[^/]*$') THEN 'meta' ELSE 'other' END AS cls FROM e""")
def path_classes(t, spark):
    return t("documents").select("doc_id", classify.area(drawn(PATHS)).alias("area"), classify.document_class(drawn(PATHS)).alias("cls"))


@query(f"""WITH p AS (SELECT doc_id, {draw_sql(PATHS)} AS p FROM documents), e AS (SELECT doc_id, p, regexp_extract(p, '([.][^./]*)$', 1) AS e, regexp_matches(p, '(^|/)inst/(.*/)?doc/') AS r FROM p)
SELECT doc_id, CASE WHEN lower(e) = '.r' THEN CASE WHEN r THEN 'r_rendered' ELSE 'R' END WHEN e = '.Rd' THEN 'Rd' WHEN e IN ('.Rmd', '.Rnw', '.qmd') THEN CASE WHEN r THEN 'rmd_rendered' ELSE 'rmd_src' END WHEN e IN ('.cpp', '.c', '.cc', '.h', '.hpp') THEN CASE WHEN regexp_matches(p, '(^|/)src/') THEN 'C_src' ELSE 'C_elsewhere' END
WHEN e = '.html' THEN 'html' WHEN e IN ('.md', '.txt') THEN 'md_txt' WHEN p IN ('DESCRIPTION', 'NAMESPACE', 'LICENSE') THEN 'meta' ELSE 'other_text' END AS bucket FROM e""")
def composition_buckets(t, spark):
    return t("documents").select("doc_id", signals.file_bucket(drawn(PATHS)).alias("bucket"))


@query(r"""WITH l AS (SELECT doc_id, list_transform(string_split(text || '  ' || chr(10) || ' ' || chr(10), chr(10)), lambda x: regexp_replace(x, '[ \t\r\f\v]+$', '')) AS l FROM documents)
SELECT doc_id, array_to_string(l[1 : coalesce(list_max(list_filter(range(1, len(l) + 1), lambda i: l[i] <> '')), 0)], '|') AS lines FROM l""")
def normalized_lines(t, spark):
    text = F.concat("text", F.lit("  \n \n"))
    return t("documents").select("doc_id", F.array_join(T.trim_tail(T.lines(text)), "|").alias("lines"))


GAIN = {k: f"len(regexp_extract_all({{0}}, '{p}'))" if k != "tf" else "len(regexp_extract_all(' ' || {0} || ' ', '[^A-Za-z0-9_.][TF][^A-Za-z0-9_.(]'))" for k, p in signals.GAINS.items()}
GAINED = ", ".join(f"{c.format('n')} - {c.format('o')} AS g_{k}" for k, c in GAIN.items())
LABEL = {"loop_to_apply": "g_loop < 0 AND (g_purrr > 0 OR g_lapply > 0)", "sapply_to_vapply": "g_vapply > 0 AND g_sapply < 0", "seq_safety_gain": "g_seq - g_one_to > 0", "class_to_inherits": "g_inherits - g_class_eq > 0", "TF_symbol_fix": "g_tf < 0", "apply_to_loop": "g_loop > 0", "styler_whitespace": "o <> n AND trim(o) = trim(n)", "docs_file": "doc", "tests_file": "NOT doc AND contains(lower(path), 'test')"}
LABEL |= {f"{k}_gain": f"g_{k} > 0" for k in ("purrr", "dplyr", "tidyr", "ggplot", "stringr", "data_table", "pipe")} | {f"{k}_loss": f"g_{k} < 0" for k in ("purrr", "dplyr", "pipe")}
PRIMARY = "CASE " + " ".join(f"WHEN {LABEL[k]} THEN '{k}'" for k in signals.PRIORITY) + " ELSE 'other_code_edit' END"


@query(f"""WITH e AS (SELECT doc_id, {draw_sql(SNIPPETS)} AS o, {draw_sql(SNIPPETS, '(doc_id // 3)')} AS n, ['R/a.R', 'NEWS.md', 'tests/t.R'][1 + doc_id % 3] AS path FROM documents), g AS (SELECT *, path = 'NEWS.md' AS doc, {GAINED} FROM e) SELECT doc_id, {PRIMARY} AS label FROM g""")
def modernization_labels(t, spark):
    d = t("documents").select("doc_id", drawn(["R/a.R", "NEWS.md", "tests/t.R"]).alias("path"), F.array(drawn(SNIPPETS)).alias("old"), F.floor(F.col("doc_id") / 3).alias("third"))
    return signals.modernization(d.withColumn("new", F.array(drawn(SNIPPETS, "third"))), "old", "new", "path").select("doc_id", F.col("primary").alias("label"))


def plain(p):
    """A pattern for an engine that can't look back: what stands before is matched instead."""
    for a, b in ((r"(?<![\w.$@])", r"(?:^|[^A-Za-z0-9_.$@])"), (r"(?![\w.$@])", r"(?:$|[^A-Za-z0-9_.$@])"), (r"(?<![\w.\d])", r"(?:^|[^A-Za-z0-9_.])"), (r"(?<![\w.])", r"(?:^|[^A-Za-z0-9_.])"), (r"(?<![\w)])", r"(?:^|[^A-Za-z0-9_)])")):
        p = p.replace(a, b)
    return quoted(p)


#: One pattern repeats a group, which that engine lacks; no source here shows it.
SHOWN = " UNION ALL ".join(f"SELECT lang, '{k}' AS signal FROM f WHERE " + " AND ".join(f"regexp_matches(s, {plain(p)})" for p in ps) for k, ps in signals.SIGNALS.items() if k != "unnecessary_lambda")
PIECE = quoted("\"[^\"]*\"|'[^']*'|[^\"']+")


@query(f"""WITH r AS (SELECT lang, {draw_sql(FILES)} AS s FROM documents), p AS (SELECT lang, list_transform(regexp_extract_all(s, {PIECE}), lambda x: CASE WHEN x[1] IN (chr(34), chr(39)) THEN x[1] || repeat('x', length(x) - 2) || x[1] ELSE x END) AS x FROM r), f AS (SELECT lang, array_to_string(x, '') AS s FROM p), n AS ({SHOWN})
SELECT signal, CAST(count(*) AS BIGINT) AS files, CAST(count(DISTINCT lang) AS BIGINT) AS groups, round(count(*) / (SELECT count(*) FROM f), 6) AS share, round(count(*) * 14202 / (SELECT count(DISTINCT lang) FROM f), 3) AS projected FROM n GROUP BY signal""")
def signal_prevalence(t, spark):
    """Signals over sources whose strings are blanked, projected to a number of packages."""
    p = signals.prevalence(t("documents").select("lang", drawn(FILES).alias("src")), "src", "lang", 14202)
    return p.select("signal", "files", "groups", F.round("share", 6).alias("share"), F.round("projected", 3).alias("projected"))


@query(r"""WITH x AS (SELECT doc_id, '\begin{verbatim}' || text || '\end{verbatim}' || chr(10) || '<<a>>=' || chr(10) || lang || text || chr(10) || '@' || chr(10) AS x FROM documents)
SELECT doc_id, 'verbatim' AS kind, b AS block FROM (SELECT doc_id, unnest(regexp_extract_all(x, '(?s)\\begin\{verbatim\}(.*?)\\end\{verbatim\}', 1)) AS b FROM x) WHERE length(b) >= 120 UNION ALL SELECT doc_id, 'sweave', b FROM (SELECT doc_id, unnest(regexp_extract_all(x, '(?s)<<[^>]*>>=\s*\n(.*?)\n@', 1)) AS b FROM x) WHERE length(b) >= 120""")
def tex_code_blocks(t, spark):
    tex = F.concat(F.lit("\\begin{verbatim}"), "text", F.lit("\\end{verbatim}\n<<a>>=\n"), "lang", "text", F.lit("\n@\n"))
    return signals.tex_blocks(t("documents").select("doc_id", tex.alias("tex")), "tex").select("doc_id", "kind", "block")


@query("""WITH l AS (SELECT doc_id, list_concat(string_split(text, chr(10))[1 : CAST(doc_id % 3 AS INTEGER)], list_transform(range(1, 1 + doc_id % 11), lambda i: '# c' || i)) AS p, source AS n FROM documents WHERE NOT contains(text, '#')), k AS (SELECT *, least(8, doc_id % 11) AS c FROM l)
SELECT doc_id, array_to_string(p[1 : len(p) - c], '|') AS prefix, array_to_string(p[len(p) - c + 1 : len(p)], '|') AS region_new, n AS suffix FROM k WHERE c > 0 AND len(p) > c""")
def comment_reversal(t, spark):
    """Lines and up to ten comments above a region: the comments (eight at most) become the region."""
    d = t("documents").where(~F.contains("text", F.lit("#")))
    n = (F.col("doc_id") % 11).cast("int")
    comments = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("# c"), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    rows = d.select("doc_id", F.concat(F.slice(F.split("text", "\n"), F.lit(1), (F.col("doc_id") % 3).cast("int")), comments).alias("prefix"), F.array("source").alias("region_new"))
    return signals.reversed_comments(rows).select("doc_id", *[F.array_join(c, "|").alias(c) for c in ("prefix", "region_new", "suffix")])


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, chr(34) || chr(39) || chr(92), ''), '[ \t\n\r\f\v]+'), lambda x: x <> '')[1:30] AS w FROM documents)
SELECT doc_id, array_to_string(list_transform(w, lambda x, i: CASE WHEN i % 3 = 1 THEN chr(34) || repeat('x', length(x) + 2) || chr(34) WHEN i % 3 = 2 THEN chr(39) || repeat('x', length(x)) || chr(39) ELSE x END), ' ') AS src FROM w""")
def blanked_strings(t, spark):
    """Every third word in double quotes behind an escaped one, every third in single quotes."""
    w = F.slice(T.words(F.translate("text", "\"'\\", "")), 1, 30)
    src = F.transform(w, lambda x, i: F.when(i % 3 == 0, F.concat(F.lit('"\\"'), x, F.lit('"'))).when(i % 3 == 1, F.concat(F.lit("'"), x, F.lit("'"))).otherwise(x))
    return t("documents").select("doc_id", signals.without_strings(F.array_join(src, " ")).alias("src"))


@query(r"""WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10))[1:5], lambda x: replace(x, chr(13), '')) AS l FROM documents), k AS (SELECT doc_id, l, list_filter(range(1, len(l) + 1), lambda i: trim(l[i]) <> '') AS solid FROM l)
SELECT doc_id, CASE WHEN len(solid) > 0 THEN array_to_string(l[list_min(solid) : list_max(solid)], '|') ELSE '' END AS lines FROM k""")
def target_parsing(t, spark):
    """Answers with markers, a cursor and blank lines around the first five lines of each text."""
    first = F.transform(F.slice(F.split("text", "\n"), 1, 5), lambda x, i: F.when(i == 0, F.concat(x, F.lit("<|user_cursor|>"))).otherwise(x))
    answer = F.concat(F.lit("=======\n \n"), F.array_join(first, "\n"), F.lit("\n\n>>>>>>> UPDATED\nmore"))
    return t("documents").select("doc_id", F.array_join(signals.parsed_target(answer), "|").alias("lines"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN lang || chr(10) END AS prompt, CASE WHEN doc_id % 3 > 0 THEN source || chr(10) || 'x' END AS target FROM documents""")
def ended_rows(t, spark):
    """Rows with two end marks, with one, and with none."""
    c = F.col("doc_id") % 3
    body = F.concat("lang", F.lit("\n<|end|>\n\n"), "source", F.lit("\nx"))
    text = F.when(c == 1, F.concat(body, F.lit("\n<|end|>"))).when(c == 2, body).otherwise(F.col("lang"))
    p, g = signals.split_ended(text)
    return t("documents").select("doc_id", p.alias("prompt"), g.alias("target"))


FIX = ", ".join("(" + ", ".join([str(i), *map(quoted, f)]) + ")" for i, f in enumerate(FIXES))


@query(rf"""WITH f AS (SELECT * FROM (VALUES {FIX}) AS v(k, rule, new, wanted, given))
SELECT doc_id, CASE rule WHEN 'true_false_symbol' THEN contains(new, CASE given WHEN 'T' THEN 'TRUE' ELSE 'FALSE' END) AND NOT regexp_matches(' ' || new || ' ', '[^A-Za-z0-9_.][TF][^A-Za-z0-9_.(]') WHEN 'paste0_sep' THEN contains(new, 'paste0(') AND NOT regexp_matches(new, '\bpaste\s*\(')
WHEN 'sapply_vapply' THEN contains(new, 'vapply(') AND NOT regexp_matches(new, '\bsapply\s*\(') AND contains(new, coalesce(wanted, '')) WHEN 'seq_safety' THEN regexp_matches(new, 'seq_along[(]|seq_len[(]') AND NOT regexp_matches(new, '1:(length|nrow|ncol)') WHEN 'class_equals' THEN contains(new, 'inherits(') ELSE new <> 'b' END AS ok FROM documents JOIN f ON k = doc_id % {len(FIXES)}""")
def lint_fix_applied(t, spark):
    f = spark.createDataFrame([(i, *x) for i, x in enumerate(FIXES)], "k int, rule string, new string, wanted string, given string").withColumn("old", F.lit("b"))
    d = t("documents").join(f, F.col("doc_id") % len(FIXES) == F.col("k"))
    return d.select("doc_id", signals.fix_applied(*[F.col(c) for c in ("rule", "old", "new", "wanted", "given")]).alias("ok"))


@query(f"""WITH c AS (SELECT page_id, CASE WHEN page_id % 8 < 7 THEN {listed(CELLS)}[1 + page_id % 8] ELSE '' END AS c FROM pages)
SELECT page_id, CASE WHEN regexp_matches(c, '(?i)CC[ -]?BY|CC0|creativecommons') AND NOT regexp_matches(c, 'NC|ND') THEN 'permissive' WHEN contains(c, 'non-exclusive') OR trim(c) = '' THEN 'excluded-default' ELSE 'unknown' END AS verdict FROM c""")
def page_license_cell(t, spark):
    """Pages with a license cell before them, and every eighth without."""
    k = (F.col("page_id") % 8).cast("int")
    rest = F.regexp_replace("html", "(?i)licen[sc]e", "")
    html = F.when(k < 7, F.concat(F.lit("<tr><td>License:</td> <td class='x'>"), F.get(F.array(*map(F.lit, CELLS)), k), F.lit("</td></tr>"), rest)).otherwise(rest)
    return t("pages").select("page_id", signals.page_license(html).alias("verdict"))
