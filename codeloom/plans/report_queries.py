"""Queries of roll-ups, selections, gates and contexts, over fields that both engines derive from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import context, gates, metrics, rollups, selection, signals
from .registry import query

SPLIT_LINES = "string_split(text, chr(10))"
K = "CAST(regexp_extract(props, '\"k\": ([0-9]+)', 1) AS BIGINT)"


def scored(t):
    """events as results: a score of 0 to 2, flags and times."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return t("events").select("event_id", "user_id", "event_type", "value", k.alias("k"), (k % 3).alias("score"), (k % 2 == 0).alias("ok"))


@query("SELECT lang, array_to_string(list(source || '=' || n ORDER BY source), ',') AS totals FROM (SELECT lang, source, CAST(sum(n_chars) AS BIGINT) AS n FROM documents GROUP BY ALL) GROUP BY lang")
def totals_by_class_map(t, spark):
    m = rollups.totals_map(t("documents"), ["lang"], "source", "n_chars")
    return m.select("lang", F.array_join(F.transform(F.map_entries("totals"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("totals"))


@query("""WITH u AS (SELECT source, text, max(n_chars) AS u, sum(n_chars) AS r, max(n_chars) FILTER (lang = 'en') AS lu, sum(n_chars) FILTER (lang = 'en') AS lr FROM documents GROUP BY ALL),
s AS (SELECT source, sum(r) AS r, sum(u) AS u, coalesce(sum(lr), 0) AS lr, coalesce(sum(lu), 0) AS lu FROM u GROUP BY source)
SELECT source, CAST(r - u AS DOUBLE) AS total_dup, CAST(greatest(0, (r - u) - (lr - lu)) AS DOUBLE) AS version_dup, CAST(lr - lu AS DOUBLE) AS within_dup, CASE WHEN r > u THEN round(greatest(0, (r - u) - (lr - lu)) / (r - u), 4) END AS version_share FROM s""")
def duplication_split(t, spark):
    """Duplicated characters of each source, between languages and within English ones."""
    en = F.when(F.col("lang") == "en", F.col("n_chars"))
    per = t("documents").groupBy("source", F.md5("text").alias("h")).agg(F.max("n_chars").alias("u"), F.sum("n_chars").alias("r"), F.max(en).alias("lu"), F.sum(en).alias("lr"))
    s = per.groupBy("source").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("r", "u", "lr", "lu")])
    return s.select("source", rollups.duplication_split(F.col("r"), F.col("u"), F.col("lr"), F.col("lu")).alias("x")).select("source", "x.*")


@query("SELECT source, lang, CAST(count(*) AS BIGINT) AS n_files, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes FROM documents GROUP BY ALL")
def package_inventory(t, spark):
    return rollups.inventory(t("documents").withColumn("b", F.octet_length("text").cast("bigint")), ["source", "lang"], "b")


@query("""WITH s AS (SELECT * FROM documents WHERE CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967295.0 < 0.2), m AS (SELECT lang, avg(n_chars) AS m FROM s GROUP BY lang), n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang)
SELECT (SELECT count(*) FROM s) AS sample_n, (SELECT avg(n_chars) FROM s) AS mean, (SELECT avg(n_chars) FROM s) * (SELECT count(*) FROM documents) AS by_mean, round((SELECT sum(m * n) FROM m JOIN n USING (lang)), 3) AS by_class""")
def token_estimates(t, spark):
    d = t("documents")
    e = rollups.corpus_estimates(d.where(T.unit(F.col("doc_id")) < 0.2), d, "lang", "n_chars")
    return e.select("sample_n", "mean", "by_mean", F.round("by_class", 3).alias("by_class"))


FLAGS = "list_filter([CASE WHEN contains(text, '#') THEN 'hash' END, CASE WHEN contains(lower(text), 'license') THEN 'license' END, CASE WHEN n_chars > 5000 THEN 'long' END], lambda x: x IS NOT NULL)"


@query(f"WITH f AS (SELECT {FLAGS} AS f FROM documents), x AS (SELECT unnest(list_append(f, CASE WHEN len(f) > 0 THEN 'any' ELSE 'clean' END)) AS flag FROM f) SELECT flag, CAST(count(*) AS BIGINT) AS n FROM x GROUP BY flag")
def flag_distribution(t, spark):
    f = F.array_compact(F.array(F.when(F.contains("text", F.lit("#")), "hash"), F.when(F.contains(F.lower("text"), F.lit("license")), "license"), F.when(F.col("n_chars") > 5000, "long")))
    return rollups.flag_counts(t("documents").select(f.alias("f")), "f")


@query(f"SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(avg(k % 3), 3) AS mean, round(avg(CASE WHEN k % 3 = 2 THEN 1.0 ELSE 0.0 END), 3) AS pct2, round(avg(CASE WHEN k % 3 = 0 THEN 1.0 ELSE 0.0 END), 3) AS pct0 FROM (SELECT *, {K} AS k FROM events) WHERE k IS NOT NULL GROUP BY event_type")
def judge_stats(t, spark):
    return rollups.judge_scores(scored(t), ["event_type"], "score")


@query("SELECT CASE WHEN toxic = 1 THEN 'degraded' WHEN quality = 0 THEN 'unrelated' ELSE 'gt' END AS label, CAST(count(*) AS BIGINT) AS n, round(avg(doc_id % 3), 2) AS mean, round(avg(CASE WHEN doc_id % 3 = 2 THEN 1.0 ELSE 0.0 END), 2) AS pct2 FROM labels GROUP BY 1")
def judge_calibration(t, spark):
    label = F.when(F.col("toxic") == 1, "degraded").when(F.col("quality") == 0, "unrelated").otherwise("gt")
    return rollups.calibration(t("labels").select(label.alias("label"), (F.col("doc_id") % 3).alias("score")), "label", "score")


@query(f"""WITH e AS (SELECT event_type, {K} AS k, round(abs(value), 2) AS s FROM events), r AS (SELECT event_type, 'layer' || (k % 5) AS w, count(*) AS n FROM e WHERE k % 2 <> 0 GROUP BY ALL), m AS (SELECT event_type, array_to_string(list(w || '=' || n ORDER BY w), ',') AS rejects FROM r GROUP BY event_type)
SELECT event_type, CAST(count(*) AS BIGINT) AS attempts, CAST(count(*) FILTER (k % 2 = 0) AS BIGINT) AS accepted, round(count(*) FILTER (k % 2 = 0) / count(*), 3) AS rate, any_value(rejects) AS rejects, round(sum(s) FILTER (k % 2 = 0) / nullif(count(*) FILTER (k % 2 = 0), 0), 2) AS mean_s, round(count(*) FILTER (k % 2 = 0) / nullif(sum(s), 0) * 3600, 1) AS per_hour FROM e LEFT JOIN m USING (event_type) GROUP BY event_type""")
def acceptance_stats(t, spark):
    e = scored(t).withColumn("layer", F.concat(F.lit("layer"), (F.col("k") % 5).cast("string"))).withColumn("s", F.round(F.abs("value"), 2))
    a = rollups.acceptance(e, ["event_type"], "ok", "layer", "s")
    return a.withColumn("rejects", F.nullif(F.array_join(F.transform(F.map_entries("rejects"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ","), F.lit("")))


@query(f"""WITH e AS (SELECT event_type, {K} AS k, value AS s FROM events), p AS (SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN k % 2 = 0 THEN 1.0 ELSE 0.0 END), 4) AS proposal_rate, round(coalesce(avg(k) FILTER (k % 2 = 0), 0), 1) AS mean_pred_chars, CAST(count(*) FILTER (k % 2 = 0 AND k % 3 = 0) AS BIGINT) AS false_positives,
list_sort(list(s))[count(*) // 2 + 1] AS p50_s, list_sort(list(s))[CAST(least(count(*) - 1, round_even(0.95 * (count(*) - 1), 0)) AS BIGINT) + 1] AS p95_s FROM e GROUP BY event_type)
SELECT * FROM p UNION ALL SELECT 'all', CAST(count(*) AS BIGINT), round(avg(CASE WHEN k % 2 = 0 THEN 1.0 ELSE 0.0 END), 4), NULL, CAST(count(*) FILTER (k % 2 = 0) AS BIGINT), NULL, NULL FROM e WHERE k % 3 = 0""")
def false_positive_rates(t, spark):
    e = scored(t).withColumn("none", F.col("score") == 0).withColumnRenamed("value", "s")
    return rollups.proposals(e, "event_type", "ok", "none", "k", "s").select("event_type", "n", "proposal_rate", "mean_pred_chars", "false_positives", "p50_s", "p95_s")


@query(f"""WITH l AS (SELECT source, CAST(len({SPLIT_LINES}) AS BIGINT) AS b, CAST(len(list_filter({SPLIT_LINES}, lambda x: contains(x, '#'))) AS BIGINT) AS c FROM documents), p AS (SELECT source, sum(b) AS b, sum(c) AS c, sum(c) / sum(b) AS p FROM l GROUP BY source)
SELECT CAST(sum(b) AS BIGINT) AS bodies, CAST(sum(c) AS BIGINT) AS commented, round(100 * sum(c) / sum(b), 2) AS pct, CAST(count(*) AS BIGINT) AS packages, round(100 * avg(p), 2) AS mean, round(100 * min(p), 2) AS min, round(100 * max(p), 2) AS max,
round(100 * list_sort(list(p))[CAST(least(count(*) - 1, floor(0.25 * count(*))) AS BIGINT) + 1], 2) AS p25, round(100 * list_sort(list(p))[CAST(least(count(*) - 1, floor(0.5 * count(*))) AS BIGINT) + 1], 2) AS median, round(100 * list_sort(list(p))[CAST(least(count(*) - 1, floor(0.75 * count(*))) AS BIGINT) + 1], 2) AS p75 FROM p""")
def comment_density(t, spark):
    """Lines with a hash sign in place of bodies with comments, by source."""
    lines = F.split("text", "\n")
    d = t("documents").select("source", F.size(lines).cast("bigint").alias("b"), F.size(F.filter(lines, lambda x: F.contains(x, F.lit("#")))).cast("bigint").alias("c"))
    return rollups.density(d, "source", "b", "c")


@query(f"""WITH e AS (SELECT event_type AS rule, CASE WHEN k % 3 = 0 THEN 0 ELSE k % 4 END AS rows, k % 7 AS sites, 'r' || (k % 4) AS why FROM (SELECT *, {K} AS k FROM events)), r AS (SELECT rule, why, count(*) AS n FROM e WHERE rows = 0 GROUP BY ALL), m AS (SELECT rule, array_to_string(list(why || '=' || n ORDER BY why), ',') AS reasons FROM r GROUP BY rule)
SELECT rule, CAST(count(*) AS BIGINT) AS attempted, CAST(sum(sites) AS BIGINT) AS sites, CAST(sum(rows) AS BIGINT) AS rows, CAST(count(*) FILTER (rows = 0) AS BIGINT) AS rejects, any_value(reasons) AS reasons FROM e LEFT JOIN m USING (rule) GROUP BY rule""")
def rule_outcomes(t, spark):
    k = F.col("k")
    e = scored(t).select(F.col("event_type").alias("rule"), F.when(k % 3 == 0, 0).otherwise(k % 4).alias("rows"), (k % 7).alias("sites"), F.concat(F.lit("r"), (k % 4).cast("string")).alias("why"))
    return rollups.rule_matrix(e, "rule", "sites", "rows", "why").withColumn("reasons", F.array_join(F.transform(F.map_entries("reasons"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ","))


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT event_type) AS INTEGER) AS n_families, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS families FROM events GROUP BY user_id")
def sample_yields(t, spark):
    y = rollups.sample_yield(t("events"), "user_id", "event_type")
    return y.withColumn("families", F.array_join("families", ","))


SMELL = "CAST(len(regexp_extract_all(text, '[.]')) AS BIGINT) AS cyclomatic, CAST(len(regexp_extract_all(text, chr(10))) AS BIGINT) AS body_lines"


@query(f"""WITH m AS (SELECT {SMELL} FROM documents), x AS (SELECT 'cyclomatic_ge_10' AS smell FROM m WHERE cyclomatic >= 10 UNION ALL SELECT 'body_lines_ge_40' FROM m WHERE body_lines >= 40 UNION ALL SELECT CASE WHEN cyclomatic >= 10 OR body_lines >= 40 THEN 'any_smell' ELSE 'all_clean' END FROM m)
SELECT smell, CAST(count(*) AS BIGINT) AS n, round(100 * count(*) / (SELECT count(*) FROM m), 1) AS pct FROM x GROUP BY smell""")
def smell_counts(t, spark):
    d = t("documents").select(T.count(F.col("text"), "[.]").alias("cyclomatic"), T.count(F.col("text"), "\n").alias("body_lines"))
    return rollups.smells(d, {"cyclomatic": 10, "body_lines": 40})[0]


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(100 * count(*) / (SELECT count(*) FROM events), 2) AS pct, CAST(round_even(count(*) * 15983 / (SELECT count(*) FROM events), 0) AS BIGINT) AS estimate, event_type <> 'view' AS modern FROM events GROUP BY event_type")
def label_extrapolation(t, spark):
    return rollups.label_shares(t("events"), "event_type", 15983).withColumn("modern", F.col("event_type") != "view")


@query(f"""WITH e AS (SELECT user_id, least(5, greatest(0, k / 23.0)) AS a, CASE WHEN k % 5 <> 0 THEN least(5, greatest(0, k / 11.0 - 1)) END AS b, least(5, greatest(0, k / 17.0)) AS c FROM (SELECT *, {K} AS k FROM events)), m AS (SELECT user_id, round(avg(a), 2) AS a, round(avg(b), 2) AS b, round(avg(c), 2) AS c FROM e GROUP BY user_id)
SELECT user_id, a, b, c, round((a + coalesce(b, 0) + c) / (CASE WHEN b IS NULL THEN 2 ELSE 3 END), 2) AS composite FROM m""")
def rerated_means(t, spark):
    k = F.col("k")
    r = scored(t).select("user_id", (k / 23.0).alias("a"), F.when(k % 5 != 0, k / 11.0 - 1).alias("b"), (k / 17.0).alias("c"))
    return rollups.rerated(r, "user_id", ["a", "b", "c"])


@query("WITH m AS (SELECT source, count(*) AS used FROM documents WHERE lang <> 'en' GROUP BY source), n AS (SELECT source, count(*) AS n FROM documents WHERE lang <> 'fr' GROUP BY source) SELECT source, CAST(used AS BIGINT) AS used, CAST(coalesce(n, 0) AS BIGINT) AS live, CAST(greatest(0, coalesce(n, 0) - used) AS BIGINT) AS new FROM m LEFT JOIN n USING (source)")
def new_since_cut(t, spark):
    d = t("documents")
    cut = lambda lang: d.where(F.col("lang") != lang).groupBy("source").agg(F.count("*").alias("used" if lang == "en" else "n"))
    return rollups.new_since(cut("en"), cut("fr"), "source", "used", "n")


@query(f"""WITH e AS (SELECT event_id, {K} AS k FROM events) SELECT g AS gate, CAST(count(*) FILTER (v) AS BIGINT) AS passed, CAST(count(*) FILTER (NOT v) AS BIGINT) AS failed, CAST(count(*) FILTER (v IS NULL) AS BIGINT) AS unknown, round(avg(coalesce(ms, 0)), 1) AS mean_ms
FROM (SELECT 'G0' AS g, k % 2 = 0 AS v, CAST(k AS DOUBLE) AS ms FROM e UNION ALL SELECT 'G1', CASE WHEN k % 3 <> 0 THEN k % 5 = 0 END, NULL FROM e) GROUP BY g UNION ALL SELECT 'verdict:v' || (k % 4), CAST(count(*) AS BIGINT), NULL, NULL, NULL FROM e GROUP BY 1""")
def gate_statistics(t, spark):
    k = F.col("k")
    e = scored(t).select((k % 2 == 0).alias("G0"), F.when(k % 3 != 0, k % 5 == 0).alias("G1"), k.cast("double").alias("ms_G0"), F.concat(F.lit("v"), (k % 4).cast("string")).alias("v"))
    return rollups.gate_stats(e, ["G0", "G1"], "v")


@query("""WITH f AS (SELECT doc_id, md5('5:' || doc_id) AS o FROM documents WHERE lang = 'de'), r AS (SELECT doc_id, md5('5:' || doc_id) AS o FROM documents WHERE lang <> 'de'), b AS (SELECT doc_id, 'first' AS stratum, row_number() OVER (ORDER BY o, doc_id) AS r FROM f UNION ALL SELECT doc_id, 'rest', row_number() OVER (ORDER BY o, doc_id) FROM r),
k AS (SELECT * FROM b WHERE stratum = 'first' OR r <= greatest(0, 300 - (SELECT count(*) FROM f))), n AS (SELECT stratum, round_even(count(*) * (30 / 300), 0) AS e FROM k GROUP BY stratum)
SELECT doc_id, stratum, CASE WHEN r <= e THEN 'eval' ELSE 'train' END AS split FROM k JOIN n USING (stratum)""")
def stratified_fill(t, spark):
    d = t("documents").select("doc_id", "lang")
    return selection.stratified_fill(d.where("lang = 'de'"), d.where("lang <> 'de'"), "doc_id", 300, 30, 5).select("doc_id", "stratum", "split")


@query("WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('4:' || doc_id), doc_id) AS r FROM documents) SELECT doc_id, lang FROM r WHERE r <= CASE lang WHEN 'en' THEN 40 WHEN 'fr' THEN 15 WHEN 'es' THEN 100000 END")
def fixed_area_sizes(t, spark):
    return selection.fixed_sizes(t("documents").select("doc_id", "lang"), "lang", {"en": 40, "fr": 15, "es": 100_000}, "doc_id", 4)


@query("WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) SELECT doc_id, source FROM r WHERE r <= 7 ORDER BY source, r LIMIT 61")
def capped_with_total(t, spark):
    return selection.capped_total(t("documents").select("doc_id", "source"), "source", ["doc_id"], 7, 61)


@query("WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS r FROM events) SELECT event_id, event_type FROM r WHERE r <= CASE event_type WHEN 'view' THEN 25 WHEN 'click' THEN 10 END")
def quota_countdown(t, spark):
    return selection.countdown(t("events").select("event_id", "event_type", "ts"), "event_type", {"view": 25, "click": 10}, ["ts", "event_id"]).drop("ts")


@query("WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS c FROM events WHERE event_type IN ('purchase', 'click', 'view')) SELECT event_id, event_type FROM r ORDER BY c, list_position(['purchase', 'click', 'view'], event_type) LIMIT 31")
def priority_rotation(t, spark):
    return selection.by_priority(t("events").select("event_id", "event_type"), "event_type", ["purchase", "click", "view"], ["event_id"], 31)


@query("WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('7:' || doc_id), doc_id) AS r FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) SELECT doc_id, lang FROM r WHERE r <= CASE lang WHEN 'en' THEN 30 WHEN 'es' THEN 12 END")
def mixture_doses(t, spark):
    return selection.mixed(t("documents").select("doc_id", "lang"), "lang", "en:30, es:12,fr", "doc_id", 7, t("labels"))


@query("""WITH h AS (SELECT doc_id FROM labels WHERE toxic = 1), seen AS (SELECT DISTINCT md5(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'))) AS m FROM documents JOIN labels USING (doc_id) WHERE quality = 0),
r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('9:' || doc_id), doc_id) AS r FROM documents WHERE n_chars <= 3000 AND lang IN ('en', 'de') AND doc_id NOT IN (SELECT doc_id FROM h) AND md5(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'))) NOT IN (SELECT m FROM seen))
SELECT doc_id, lang FROM r WHERE r <= CASE lang WHEN 'en' THEN 50 ELSE 20 END""")
def family_quota_suite(t, spark):
    d = t("documents").select("doc_id", "lang", "text")
    l = t("labels")
    return selection.family_quotas(d, "lang", {"en": 50, "de": 20}, "text", "doc_id", l.where("toxic = 1"), d.join(l.where("quality = 0"), "doc_id"), 3000, 9).select("doc_id", "lang")


@query("WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('6:' || doc_id), doc_id) AS r FROM documents WHERE contains(text, chr(10))) SELECT doc_id, lang FROM r WHERE r <= 5")
def usable_suite(t, spark):
    return selection.first_usable(t("documents"), "lang", 5, F.contains("text", F.lit("\n")), "doc_id", 6).select("doc_id", "lang")


@query("WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('2:' || doc_id), doc_id) AS r FROM documents) SELECT doc_id, CASE WHEN r <= 120 THEN 'train' ELSE 'eval' END AS split FROM r WHERE r <= 160")
def train_then_eval(t, spark):
    return selection.train_and_eval(t("documents").select("doc_id"), "doc_id", 120, 40, 2)


@query("""WITH b AS (SELECT doc_id, source, text, 'old' AS origin FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, source, text, 'new' FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY source, sha1(text) ORDER BY CASE WHEN origin = 'old' THEN 0 ELSE 1 END, doc_id) AS r FROM b)
SELECT doc_id, source, origin FROM r WHERE r = 1""")
def merge_old_before_new(t, spark):
    d = t("documents").select("doc_id", "source", "text", "lang")
    return selection.merged(d.where("lang = 'en'").drop("lang"), d.drop("lang"), ["source"], "text", "doc_id").select("doc_id", "source", "origin")


@query("SELECT doc_id, source, row_number() OVER (ORDER BY CASE source WHEN 'src3' THEN 1 WHEN 'src1' THEN 2 ELSE 3 END, doc_id) AS place FROM documents ORDER BY place LIMIT 80")
def pool_priority(t, spark):
    d = selection.pool_order(t("documents").select("doc_id", "source"), "source", ["src3", "src1"], "doc_id").limit(80)
    order = F.when(F.col("source") == "src3", 1).when(F.col("source") == "src1", 2).otherwise(3)
    from pyspark.sql import Window

    return d.withColumn("place", F.row_number().over(Window.orderBy(order, "doc_id")).cast("bigint"))


LINES = f"SELECT doc_id, lang, {SPLIT_LINES} AS l FROM documents"


@query(f"""WITH x AS ({LINES}), w AS (SELECT doc_id, l, len(l) AS n, len(l) // 3 AS a, len(l) // 2 AS b FROM x), s AS (SELECT *, greatest(0, a - 4) AS s, least(n, b + 1 + 4) AS e FROM w)
SELECT doc_id, CAST(s AS INTEGER) AS start, array_to_string(l[greatest(0, s - 20) + 1 : s], '|') AS prefix, array_to_string(l[s + 1 : e], '|') AS region, array_to_string(l[e + 1 : least(n, e + 20)], '|') AS suffix FROM s""")
def context_windows(t, spark):
    """Regions of 4 lines around changed lines, with 20 lines on both sides."""
    l = F.split("text", "\n")
    n = F.size(l)
    w = context.window(l, F.floor(n / 3).cast("int"), F.floor(n / 2).cast("int"), 4, 4, 20, 20)
    return t("documents").select("doc_id", w.alias("w")).select("doc_id", "w.start", *[F.array_join(f"w.{c}", "|").alias(c) for c in ("prefix", "region", "suffix")])


@query(f"""WITH x AS ({LINES}), h AS (SELECT doc_id, unnest(range(1, len(l) // 5 + 1)) * 5 AS e, len(l) AS n FROM x), s AS (SELECT doc_id, any_value(n) AS n, CAST(coalesce(sum(e % 3 - e % 2) FILTER (e < n // 2), 0) AS INTEGER) AS shift FROM h GROUP BY doc_id) SELECT doc_id, coalesce(shift, 0) AS shift FROM x LEFT JOIN s USING (doc_id)""")
def hunk_line_shift(t, spark):
    l = F.size(F.split("text", "\n"))
    hunks = F.when(l >= 5, F.transform(F.sequence(F.lit(1), F.floor(l / 5).cast("int")), lambda i: F.struct((i * 5).alias("end"), ((i * 5) % 2).alias("old_count"), ((i * 5) % 3).alias("new_count")))).otherwise(F.array().cast("array<struct<end:int,old_count:int,new_count:int>>"))
    return t("documents").select("doc_id", context.line_shift(hunks, F.floor(l / 2)).alias("shift"))


@query(f"""WITH x AS ({LINES}), c AS (SELECT doc_id, l, list_transform(range(1, len(l) + 1), lambda i: list_sum(list_transform(l[1:i], lambda y: length(y) + 1))) AS up, list_transform(range(1, len(l) + 1), lambda i: list_sum(list_transform(l[len(l) - i + 1 : len(l)], lambda y: length(y) + 1))) AS down FROM x WHERE len(l) <= 60),
s AS (SELECT doc_id, l, down, len(list_filter(up, lambda z: z <= 300)) AS k, coalesce(list_max(list_filter(up, lambda z: z <= 300)), 0) AS used FROM c)
SELECT doc_id, array_to_string(l[1:k], '|') AS suffix, array_to_string(l[len(l) - len(list_filter(down, lambda z: z <= 500 - used)) + 1 : len(l)], '|') AS prefix FROM s""")
def budgeted_context(t, spark):
    """Texts of up to 60 lines, each as its own prefix and suffix, in budgets of characters."""
    l = F.split("text", "\n")
    b = context.budgeted(l, l, 500, 300)
    return t("documents").where(F.size(l) <= 60).select("doc_id", b.alias("b")).select("doc_id", F.array_join("b.suffix", "|").alias("suffix"), F.array_join("b.prefix", "|").alias("prefix"))


@query(f"""WITH x AS ({LINES}) SELECT doc_id, 'User edited "' || lang || '":' || chr(10) || chr(10) || '```diff' || chr(10) || '@@ -1,' || len(l) || ' +2 @@' || chr(10) || '-' || array_to_string(l[1:3], chr(10) || '-') || chr(10) || '```' AS event, lang AS path, array_to_string(l[1:3], '|') AS old FROM x """)
def event_texts(t, spark):
    """Edit events built, and read back."""
    l = F.split("text", "\n")
    ev = context.event_text(F.col("lang"), F.lit(1), F.size(l), F.lit(2), F.lit(None).cast("int"), F.transform(F.slice(l, 1, 3), lambda x: F.concat(F.lit("-"), x)))
    d = t("documents").select("doc_id", ev.alias("event"))
    p = context.parsed_event(F.col("event"))
    return d.select("doc_id", "event", p["path"].alias("path"), F.array_join(p["old"], "|").alias("old"))


@query("SELECT doc_id, CASE WHEN b < 200 THEN 'short' WHEN len(list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda x: x <> '')) < 40 THEN 'few_tokens' END AS reason FROM (SELECT doc_id, text, n_chars, strlen(text) AS b FROM documents)")
def document_skips(t, spark):
    return t("documents").select("doc_id", gates.document_skip(F.col("text"), F.size(T.words(F.col("text"))), 200, 40).alias("reason"))


@query("""WITH l AS (SELECT page_id, url, CASE page_id % 6 WHEN 0 THEN 'MIT + file LICENSE' WHEN 1 THEN 'GPL (>= 2) | BSD' WHEN 2 THEN 'file LICENSE' WHEN 3 THEN 'Artistic + x' WHEN 4 THEN 'Apache License 2.0' END AS f FROM pages)
SELECT page_id, CASE WHEN f IS NULL THEN 'MPL-2.0' WHEN contains(f, 'MIT') THEN 'MIT' WHEN contains(f, 'Apache') THEN 'Apache-2.0' WHEN contains(f, 'GPL') THEN 'GPL-2' WHEN contains(f, 'BSD') THEN 'BSD' ELSE trim(string_split(string_split(f, '|')[1], '+')[1]) END AS kind,
CASE WHEN f IS NULL OR f LIKE 'file %' THEN NULL WHEN contains(f, 'file LICENSE') THEN trim(regexp_replace(f, '[+] file LICENSE.*', '')) ELSE f END AS field FROM l""")
def repository_licenses(t, spark):
    names = ["MIT + file LICENSE", "GPL (>= 2) | BSD", "file LICENSE", "Artistic + x", "Apache License 2.0"]
    f = F.get(F.array(*map(F.lit, names)), (F.col("page_id") % 6).cast("int"))
    text = F.when(f.isNotNull(), F.concat(F.lit("Package: a\nLicense: "), f, F.lit("\nURL: b")))
    return t("pages").select("page_id", gates.repository_license(text, F.lit("Mozilla Public License Version 2.0")).alias("kind"), gates.description_license(text).alias("field"))


@query("""WITH e AS (SELECT event_id, props, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, event_id % 4 AS c FROM events)
SELECT event_id, CASE WHEN c = 3 THEN NULL ELSE props END AS obj, CASE WHEN c = 3 THEN 'no object' WHEN c = 0 THEN 'response lacks ''v''' ELSE '''k'' is no string' END AS reason FROM e""")
def json_gate(t, spark):
    """Objects in answers with fences and talk around them, and the schema gate on them."""
    p = F.col("props")
    c = F.col("event_id") % 4
    text = F.when(c == 0, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(c == 1, F.concat(F.lit("Sure: "), p, F.lit(" done"))).when(c == 2, p).otherwise("no { object")
    obj = gates.json_object(text)
    return t("events").select("event_id", obj.alias("obj"), F.when(c == 0, gates.spec_reason(obj, "v")).otherwise(gates.spec_reason(obj, "k")).alias("reason"))


@query(f"""WITH x AS ({LINES}), r AS (SELECT doc_id, l[1:12] AS o, list_reverse(l[1:12]) AS n FROM x) SELECT doc_id, CASE WHEN len(o) = 0 THEN 'empty' WHEN o = n THEN 'unchanged' WHEN len(o) > 8 THEN 'too_big' END AS reason FROM r""")
def region_gates(t, spark):
    o = F.slice(F.split("text", "\n"), 1, 12)
    return t("documents").select("doc_id", gates.region_skip(o, F.reverse(o), 8).alias("reason"))


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda x: x <> '') AS a FROM documents), v AS (SELECT doc_id, a, list_transform(a, lambda x, i: CASE WHEN i = 1 + doc_id % 50 THEN x || '!' ELSE x END) AS b FROM w)
SELECT doc_id, CASE WHEN len(a) > doc_id % 50 THEN CAST(doc_id % 50 AS INTEGER) END AS first_div_tok, CASE WHEN len(a) > doc_id % 50 THEN round((doc_id % 50) / len(a), 4) ELSE 1.0 END AS prefix_frac FROM v""")
def word_divergence(t, spark):
    w = T.words(F.col("text"))
    out = F.array_join(F.transform(w, lambda x, i: F.when(i == F.col("doc_id") % 50, F.concat(x, F.lit("!"))).otherwise(x)), " ")
    return t("documents").select("doc_id", metrics.divergence(F.col("text"), out).alias("d")).select("doc_id", "d.*")


@query("""SELECT doc_id, '# SECRET_BLOCK' || chr(10) || lang || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '# END_BLOCK' ELSE chr(10) || source END AS span FROM documents""")
def needle_spans(t, spark):
    even = F.col("doc_id") % 2 == 0
    text = F.concat(F.lit("  so:\n# SECRET_BLOCK\n"), "lang", F.lit("\n"), F.when(even, F.concat(F.lit("# END_BLOCK\n"), "source")).otherwise(F.col("source")))
    return t("documents").select("doc_id", metrics.needle_span(text).alias("span"))


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN lang || source WHEN 2 THEN 'ab' || substr(lang || source, 4) WHEN 3 THEN NULL ELSE NULL END AS text,
CASE doc_id % 5 WHEN 0 THEN 'no marker tags' WHEN 3 THEN 'marker number out of range' WHEN 4 THEN 'start marker must come before end marker' END AS error FROM documents""")
def marker_spans(t, spark):
    """Answers with numbered markers, on a text with marks at 0 and 3 characters."""
    c = F.col("doc_id") % 5
    m = lambda n: f"<|marker_{n}|>"
    out = F.when(c == 0, "plain").when(c == 1, f"{m(1)}zz{m(1)}").when(c == 2, f"{m(1)}a{m(2)}b{m(2)}[end]").when(c == 3, f"{m(1)}x{m(9)}").otherwise(f"{m(2)}x{m(1)}")
    return t("documents").select("doc_id", metrics.apply_span(F.concat("lang", "source"), F.array(F.lit(0), F.lit(3)), out, "[end]").alias("s")).select("doc_id", "s.*")


@query("""WITH x AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda x: x <> '')) AS n FROM documents) SELECT doc_id, CAST(n AS INTEGER) AS prompt_tok, CAST(least(64, 1024 - n) AS INTEGER) AS max_tokens FROM x WHERE n <= 900""")
def eval_token_caps(t, spark):
    """Rows for evaluation by token caps, with the room that is left for an answer."""
    n = F.size(T.words(F.col("text")))
    return t("documents").where(n <= 900).select("doc_id", n.alias("prompt_tok"), F.least(F.lit(64), 1024 - n).alias("max_tokens"))


FENCES = "'a' || chr(10) || '```' || ['r', 'python', '', 'R'][1 + doc_id % 4] || chr(10) || lang || '<-' || source || chr(10) || '```' || chr(10) || 'b'"


@query(f"""WITH t AS (SELECT doc_id, lang, source, {FENCES} AS t FROM documents) SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN 'other' WHEN 2 THEN 'untagged' ELSE 'r' END AS kind, sha1(lang || '<-' || source || chr(10)) AS sha, CASE WHEN doc_id % 4 IN (0, 3) THEN replace(t, '<-', ' <- ') ELSE t END AS text FROM t""")
def embedded_code(t, spark):
    """Fenced blocks with their kind and hash, and texts with R blocks reformatted."""
    tag = F.get(F.array(*map(F.lit, ["r", "python", "", "R"])), (F.col("doc_id") % 4).cast("int"))
    text = F.concat(F.lit("a\n```"), tag, F.lit("\n"), "lang", F.lit("<-"), "source", F.lit("\n```\nb"))
    d = t("documents").select("doc_id", text.alias("text"))
    b = context.code_blocks(d, "doc_id", "text")
    tidy = b.select("sha", F.replace("code", F.lit("<-"), F.lit(" <- ")).alias("code")).distinct()
    return context.reformatted(d, "doc_id", "text", tidy).join(b.select("doc_id", "kind", "sha"), "doc_id").select("doc_id", "kind", "sha", "text")


@query(f"""WITH e AS (SELECT event_type, {K} AS k, value FROM events) SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN k % 3 = 0 THEN 1.0 ELSE 0.0 END), 6) AS exact, round(avg(k / 100.0), 6) AS line_f1, round(avg(CASE WHEN k % 5 = 0 THEN 1.0 ELSE 0.0 END), 6) AS format_fail, list_sort(list(value))[count(*) // 2 + 1] AS p50 FROM e GROUP BY event_type""")
def evaluation_scores(t, spark):
    k = F.col("k")
    e = scored(t).select("event_type", (k % 3 == 0).cast("int").alias("exact"), (k % 2 == 0).cast("int").alias("first_line"), (k / 100.0).alias("line_f1"), F.when(k % 5 == 0, "x").alias("error"), F.col("value").alias("latency_s"))
    return signals.evaluation(e, ["event_type"]).select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("exact", "line_f1", "format_fail")], "p50")
