"""Queries over documents: deduplication, splits, samples, gates and order statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats, text as T
from ..operators import classify, dedup, sampling, tables, tokens
from .registry import query

COLLAPSE = "trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'))"
FIRST = f"f AS (SELECT * FROM (SELECT *, {COLLAPSE} AS c, row_number() OVER (PARTITION BY md5({COLLAPSE}) ORDER BY doc_id) AS r FROM documents) WHERE r = 1)"
HELD = "k AS (SELECT lang, source, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || source), source) AS r, count(*) OVER (PARTITION BY lang) AS n FROM (SELECT DISTINCT lang, source FROM {0})), h AS (SELECT lang, source FROM k WHERE r <= greatest(1, round_even(0.03 * n, 0)))"


def nearest(p):
    return f"list_sort(list(n_chars))[CAST(least(count(*) - 1, round_even({p} * (count(*) - 1), 0)) AS BIGINT) + 1]"


def split_documents(t):
    first = dedup.keep_first_collapsed(t("documents"), "text", ["doc_id"])
    return sampling.holdout(first, "source", 0.03, 42, ["lang"])


@query(f"""WITH {FIRST}, {HELD.format('f')}, s AS (SELECT f.*, h.source IS NOT NULL AS e FROM f LEFT JOIN h ON f.lang = h.lang AND f.source = h.source)
SELECT lang, CAST(count(*) FILTER (NOT e) AS BIGINT) AS train_n, CAST(count(*) FILTER (e) AS BIGINT) AS eval_n, {nearest(0.5)} AS p50, {nearest(0.95)} AS p95, {nearest(0.99)} AS p99, max(n_chars) AS max_chars FROM s GROUP BY lang""")
def mixture_report(t, spark):
    """Documents after collapsed keep-first and a hold-out of sources: counts by split, and length statistics."""
    s = split_documents(t)
    n = s.groupBy("lang").agg(F.count_if(F.col("split") == "train").alias("train_n"), F.count_if(F.col("split") == "eval").alias("eval_n"))
    return n.join(stats.order_stats(s, ["lang"], "n_chars", {"p50": ("nearest", 0.5), "p95": ("nearest", 0.95), "p99": ("nearest", 0.99), "max_chars": ("max", 1)}), "lang")


@query(f"WITH {FIRST}, {HELD.format('f')}, s AS (SELECT f.*, h.source IS NOT NULL AS e FROM f LEFT JOIN h ON f.lang = h.lang AND f.source = h.source) SELECT source FROM s WHERE e INTERSECT SELECT source FROM s WHERE NOT e")
def holdout_overlap(t, spark):
    """Sources on both sides of a split that holds them out within each language only."""
    return sampling.overlap(split_documents(t), ["source"])


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def keep_first_text(t, spark):
    return dedup.keep_first(t("documents").select("doc_id", "text"), ["text"], ["doc_id"]).select("doc_id")


@query(f"WITH {FIRST} SELECT doc_id, md5(c) AS k FROM f")
def keep_first_collapsed(t, spark):
    return dedup.keep_first_collapsed(t("documents").select("doc_id", "text"), "text", ["doc_id"]).select("doc_id", F.md5(T.collapse(F.col("text"))).alias("k"))


@query("""WITH s AS (SELECT *, CASE WHEN CAST('0x' || substr(md5(source), 1, 8) AS BIGINT) / 4294967295.0 < 0.2 THEN 'eval' ELSE 'train' END AS split FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY CASE WHEN split = 'train' THEN 0 ELSE 1 END, doc_id) AS r FROM s)
SELECT split, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (r = 1) AS BIGINT) AS kept, CAST(count(*) FILTER (r > 1) AS BIGINT) AS dropped FROM r GROUP BY split""")
def train_before_eval_dedup(t, spark):
    """Equal texts are kept in train before eval."""
    s = sampling.threshold_split(t("documents"), "source", 0.2).withColumn("o", F.when(F.col("split") == "train", 0).otherwise(1))
    kept = dedup.keep_first(s.select("doc_id", "text", "split", "o"), ["text"], ["o", "doc_id"]).groupBy("split").agg(F.count("*").alias("kept"))
    return s.groupBy("split").agg(F.count("*").alias("n")).join(kept, "split", "left").select("split", "n", F.coalesce("kept", F.lit(0).cast("long")).alias("kept"), (F.col("n") - F.coalesce("kept", F.lit(0))).alias("dropped"))


@query("SELECT source, CASE WHEN CAST('0x' || substr(md5(source), 1, 8) AS BIGINT) / 4294967295.0 < 0.05 THEN 'eval' ELSE 'train' END AS split, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY ALL")
def md5_threshold_split(t, spark):
    return sampling.threshold_split(t("documents"), "source", 0.05).groupBy("source", "split").agg(F.count("*").alias("n"))


@query("WITH k AS (SELECT source, row_number() OVER (ORDER BY md5('11:' || source), source) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents)) SELECT source FROM k WHERE r <= greatest(1, floor(0.05 * n))")
def percent_split_floor(t, spark):
    return sampling.holdout_keys(t("documents"), "source", 0.05, 11, rounding="floor")


QUOTA = "q AS (SELECT lang, source, count(*) AS n, greatest(1, CAST(round_even(100 * count(*) / (SELECT count(*) FROM documents), 0) AS INTEGER)) AS quota FROM documents GROUP BY ALL)"


@query(f"WITH {QUOTA} SELECT lang, source, CAST(n AS BIGINT) AS n, quota FROM q")
def stratified_quota(t, spark):
    return sampling.quotas(t("documents"), ["lang", "source"], 100)


@query(f"WITH {QUOTA}, r AS (SELECT d.doc_id, quota, row_number() OVER (PARTITION BY d.lang, d.source ORDER BY md5('5:' || d.doc_id), d.doc_id) AS r FROM documents d JOIN q USING (lang, source)) SELECT doc_id FROM r WHERE r <= quota")
def stratified_sample(t, spark):
    return sampling.by_quota(t("documents").select("doc_id", "lang", "source"), ["lang", "source"], 100, "doc_id", 5).select("doc_id")


@query("WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('123:' || doc_id), doc_id) AS r FROM documents) SELECT doc_id, source FROM r WHERE r <= 20")
def family_cap_seeded(t, spark):
    d = t("documents").select("doc_id", "source")
    return sampling.capped(d, ["source"], 20, [T.order_key(F.col("doc_id"), 123), "doc_id"])


@query("SELECT doc_id FROM documents ORDER BY md5('9:' || doc_id), doc_id LIMIT 50")
def seeded_sample(t, spark):
    return sampling.seeded(t("documents").select("doc_id"), "doc_id", 50, 9)


@query("SELECT doc_id FROM documents ORDER BY CASE WHEN lang = 'de' THEN 0 ELSE 1 END, md5('3:' || doc_id), doc_id LIMIT 200")
def two_stage_pool(t, spark):
    d = t("documents").select("doc_id", "lang")
    return sampling.fill_from(d.where("lang = 'de'"), d.where("lang <> 'de'"), "doc_id", 200, 3).select("doc_id")


@query("WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('8:' || doc_id), doc_id) AS r, count(*) OVER () AS n FROM documents) SELECT doc_id FROM r WHERE r <= floor(n / 2)")
def half_split(t, spark):
    return sampling.half(t("documents").select("doc_id"), "doc_id", 8, "doc_id")


@query("WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS c FROM documents) SELECT doc_id, lang FROM r ORDER BY c, lang LIMIT 30")
def round_robin_pick(t, spark):
    return sampling.round_robin(t("documents").select("doc_id", "lang"), ["lang"], ["doc_id"], 30)


@query("SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) % 7 AS INTEGER) AS shard FROM documents")
def modulo_shard(t, spark):
    return sampling.shard(t("documents").select("doc_id"), "doc_id", 7)


WEIGHT = "CAST('0x' || substr(md5('2:' || doc_id), 1, 8) AS BIGINT) / 4294967295.0"


@query(f"SELECT CASE WHEN {WEIGHT} < 0.5 THEN 'a' WHEN {WEIGHT} < 0.8 THEN 'b' ELSE 'c' END AS template, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY ALL")
def template_draw(t, spark):
    return t("documents").select(sampling.weighted_choice(F.col("doc_id"), 2, [("a", 5), ("b", 3), ("c", 2)]).alias("template")).groupBy("template").agg(F.count("*").alias("n"))


@query("SELECT style, length, core FROM (VALUES ('x'), ('y')) s(style), (VALUES (1), (2), (3)) l(length), (VALUES ('p'), ('q')) c(core)")
def coverage_grid(t, spark):
    return sampling.grid(spark, style=["x", "y"], length=[1, 2, 3], core=["p", "q"])


@query("SELECT CASE WHEN n_chars < 200 THEN 'short' WHEN n_chars > 8000 THEN 'long' WHEN lang = 'fr' THEN 'lang' ELSE 'kept' END AS reason, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY ALL")
def budget_drop_reasons(t, spark):
    r = classify.drop_reason(("short", F.col("n_chars") < 200), ("long", F.col("n_chars") > 8000), ("lang", F.col("lang") == "fr"))
    return t("documents").select(F.coalesce(r, F.lit("kept")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT source, CASE WHEN b < 1 THEN '0' WHEN b < 5 THEN '1-4' WHEN b < 16 THEN '5-15' WHEN b < 30 THEN '16-29' ELSE '30+' END AS band, CAST(count(*) AS BIGINT) AS n FROM (SELECT source, n_chars // 200 AS b FROM documents) GROUP BY ALL")
def length_bands(t, spark):
    return t("documents").select("source", classify.bands(F.floor(F.col("n_chars") / 200), [0, 1, 5, 16, 30]).alias("band")).groupBy("source", "band").agg(F.count("*").alias("n"))


@query(f"""SELECT lang, {nearest(0.95)} AS a, list_sort(list(n_chars))[least(count(*) - 1, CAST(floor(0.9 * count(*)) AS BIGINT)) + 1] AS b, list_sort(list(n_chars))[count(*) // 2 + 1] AS c,
list_sort(list(n_chars))[greatest(0, CAST(floor(0.95 * count(*)) AS BIGINT) - 1) + 1] AS d, CAST(median(n_chars) AS DOUBLE) AS e, max(n_chars) AS f FROM documents GROUP BY lang""")
def order_stats_all(t, spark):
    d = t("documents")
    s = stats.order_stats(d, ["lang"], "n_chars", {"a": ("nearest", 0.95), "b": ("floor", 0.9), "c": ("upper_median", 0), "d": ("below", 0.95), "f": ("max", 1)})
    return s.join(d.groupBy("lang").agg(F.median("n_chars").cast("double").alias("e")), "lang")


@query("""WITH s AS (SELECT len(regexp_extract_all(text, 'the|and|ing')) AS a, len(regexp_extract_all(text, 'der|die|und')) AS b FROM documents)
SELECT CASE WHEN a >= 2 AND a > 2 * b THEN 'a' WHEN b >= 2 AND b > 2 * a THEN 'b' WHEN a > b THEN 'a-lean' WHEN b > a THEN 'b-lean' ELSE 'neutral' END AS cls, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY ALL""")
def two_list_class(t, spark):
    """The style classifier, with words these documents have in place of its own lists."""
    c = classify.style(F.col("text"), "the|and|ing", "der|die|und", ("a", "b"))
    return t("documents").select(c.alias("cls")).groupBy("cls").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, CASE WHEN contains(l, 'mit license') THEN 'MIT' WHEN contains(l, 'apache license') THEN 'Apache-2.0' WHEN contains(l, 'gnu general public license') THEN CASE WHEN contains(l, 'version 3') THEN 'GPL-3' WHEN contains(l, 'version 2') THEN 'GPL-2' ELSE 'GPL' END END AS spdx
FROM (SELECT doc_id, lower(text) AS l FROM documents) WHERE regexp_matches(l, 'mit license|apache license|gnu general public license')""")
def license_text_heuristic(t, spark):
    d = t("documents").where(F.lower("text").rlike("mit license|apache license|gnu general public license"))
    return d.select("doc_id", classify.license_text(F.col("text")).alias("spdx"))


@query("SELECT doc_id, md5(text) AS md5_key, sha256(text) AS sha, CAST(strlen(text) AS BIGINT) AS n_bytes, CAST(length(text) - length(replace(text, chr(10), '')) AS BIGINT) AS n_lines FROM documents")
def inventory_columns(t, spark):
    d = F.col("text")
    return t("documents").select("doc_id", F.md5(d.cast("binary")).alias("md5_key"), F.sha2(d.cast("binary"), 256).alias("sha"), F.octet_length(d).cast("bigint").alias("n_bytes"), (F.length(d) - F.length(F.replace(d, F.lit("\n"), F.lit("")))).cast("bigint").alias("n_lines"))


@query("SELECT sha1(text) AS hash, CAST(count(*) AS BIGINT) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_hash_groups(t, spark):
    return dedup.exact_groups(t("documents"), "text", "doc_id")


GRAMS = "g AS (SELECT doc_id, lang, unnest(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i : i + {n} - 1], ' '))) AS g FROM (SELECT doc_id, lang, list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda x: x <> '') AS w FROM documents) WHERE len(w) >= {n})"


@query(f"WITH {GRAMS.format(n=3)} SELECT lang, CAST(count(DISTINCT g) AS BIGINT) AS n_grams FROM g GROUP BY lang")
def distinct_3grams(t, spark):
    return dedup.distinct_ngrams(t("documents"), ["lang"])


@query("""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda x: x <> '') AS w FROM documents), b AS (SELECT item_id, list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda x: x <> '') AS w FROM benchmark),
dg AS (SELECT doc_id, unnest(range(1, len(w) - 10)) AS i, w FROM d WHERE len(w) >= 12), bg AS (SELECT item_id, unnest(range(1, len(w) - 10)) AS j, w FROM b WHERE len(w) >= 12),
dh AS (SELECT doc_id, i, array_to_string(w[i : i + 11], ' ') AS g FROM dg), bh AS (SELECT item_id, j, array_to_string(w[j : j + 11], ' ') AS g FROM bg),
h AS (SELECT DISTINCT doc_id, item_id, i, j FROM dh JOIN bh USING (g)), r AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, i - j ORDER BY i) AS island FROM h),
l AS (SELECT doc_id, item_id, count(*) + 11 AS n FROM r GROUP BY doc_id, item_id, i - j, island)
SELECT doc_id, item_id, CAST(max(n) AS BIGINT) AS longest FROM l GROUP BY ALL""")
def verbatim_span_12gram(t, spark):
    return dedup.verbatim_spans(t("documents"), "doc_id", t("benchmark"), "item_id").select("doc_id", "item_id", F.col("longest").cast("bigint").alias("longest"))


@query("""WITH d AS (SELECT doc_id, list_append(list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda x: x <> ''), '</s>') AS w FROM documents),
p AS (SELECT *, sum(len(w)) OVER (ORDER BY doc_id) - len(w) AS s FROM d), f AS (SELECT CAST(s + unnest(range(len(w))) AS BIGINT) AS pos, unnest(w) AS tok FROM p), n AS (SELECT count(*) AS n FROM f),
b AS (SELECT pos // 1024 AS block, pos, tok FROM f UNION ALL SELECT pos // 1024 - 1, pos, tok FROM f WHERE pos % 1024 = 0 AND pos > 0)
SELECT CAST(block AS BIGINT) AS block, CAST(count(*) AS BIGINT) AS size, arg_min(tok, pos) AS first_tok, arg_max(tok, pos) AS last_tok FROM b, n WHERE block < (n - 1) // 1025 GROUP BY block HAVING count(*) = 1025""")
def token_pack_blocks(t, spark):
    d = t("documents").select("doc_id", T.words(F.col("text")).alias("w"))
    b = tokens.blocks(d, "doc_id", "w", "</s>")
    return b.select(F.col("block").cast("bigint").alias("block"), F.size("toks").cast("bigint").alias("size"), F.element_at("toks", 1).alias("first_tok"), F.element_at("toks", -1).alias("last_tok"))


@query("SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda x: x <> '')[1:12], ' ') AS head FROM documents")
def canary_prompt(t, spark):
    return t("documents").select("doc_id", F.array_join(tokens.prompt_head(T.words(F.col("text")), 12), " ").alias("head"))


MASK = "CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967295.0"


@query(f"SELECT doc_id, {MASK} < 0.1 AS dose_10, {MASK} < 0.2 AS dose_20, {MASK} < 0.35 AS dose_35, CAST(coalesce(sum(CASE WHEN {MASK} < 0.2 THEN 1 ELSE 0 END) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM documents")
def prefix_count_mask(t, spark):
    d = sampling.nested_doses(t("documents").select("doc_id"), "doc_id", [0.1, 0.2, 0.35])
    return tables.prefix_sums(d, ["doc_id"], F.col("dose_20").cast("bigint"), F.floor(F.col("doc_id") / 4096))


@query("WITH k AS (SELECT source, row_number() OVER (ORDER BY md5('3:' || source), source) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents)) SELECT doc_id FROM documents WHERE source IN (SELECT source FROM k WHERE r <= greatest(1, round_even(0.1 * n, 0)))")
def heldout_semi_join(t, spark):
    """Documents of held-out sources."""
    d = t("documents").select("doc_id", "source")
    return d.join(sampling.holdout_keys(d, "source", 0.1, 3), "source", "left_semi").select("doc_id")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents), m AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM l WHERE length(line) > 80)
SELECT doc_id, CAST(min(i) AS BIGINT) AS start, CAST(count(*) AS BIGINT) AS length FROM m GROUP BY doc_id, g""")
def contiguous_runs(t, spark):
    """Runs of long lines."""
    l = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).where(F.length("line") > 80)
    return tables.runs(l, ["doc_id"], "i").select("doc_id", F.col("start").cast("bigint").alias("start"), F.col("length").cast("bigint").alias("length"))


@query("SELECT source, CAST(sum(n_chars) AS BIGINT) AS total, round(sum(n_chars) / (SELECT sum(n_chars) FROM documents), 6) AS share FROM documents GROUP BY source")
def extrapolated_composition(t, spark):
    return tables.share(t("documents"), ["source"], "n_chars").select("source", "total", F.round("share", 6).alias("share"))


@query("""WITH x AS (SELECT d.lang, l.quality, l.toxic FROM labels l JOIN documents d USING (doc_id))
SELECT 'overall' AS dimension, '' AS value, CAST(count(*) AS BIGINT) AS n, round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic FROM x
UNION ALL SELECT 'lang', lang, CAST(count(*) AS BIGINT), round(avg(quality), 6), round(avg(toxic), 6) FROM x GROUP BY lang
UNION ALL SELECT 'quality', CAST(quality AS VARCHAR), CAST(count(*) AS BIGINT), round(avg(quality), 6), round(avg(toxic), 6) FROM x GROUP BY quality""")
def breakdowns(t, spark):
    x = t("labels").join(t("documents").select("doc_id", "lang"), "doc_id")
    return tables.breakdowns(x, ["lang", "quality"], [F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("quality"), F.round(F.avg("toxic"), 6).alias("toxic")])


@query("""WITH x AS (SELECT lang, CAST(sum(quality) AS BIGINT) AS k, CAST(count(*) AS BIGINT) AS n FROM labels JOIN documents USING (doc_id) GROUP BY lang), y AS (SELECT *, k / n AS p, 1.96 AS z FROM x)
SELECT lang, k, n, round(greatest(0, ((p + z*z/(2*n)) - z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n)), 6) AS lo, round(least(1, ((p + z*z/(2*n)) + z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n)), 6) AS hi FROM y""")
def weighted_collapse(t, spark):
    x = t("labels").join(t("documents").select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.sum("quality").alias("k"), F.count("*").alias("n"))
    lo, hi = stats.wilson(F.col("k"), F.col("n"))
    return x.select("lang", "k", "n", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


@query("SELECT lang, CAST(count(*) FILTER (split = 'train') AS BIGINT) AS train, CAST(count(*) FILTER (split = 'eval') AS BIGINT) AS eval FROM (SELECT lang, CASE WHEN CAST('0x' || substr(md5(source), 1, 8) AS BIGINT) / 4294967295.0 < 0.2 THEN 'eval' ELSE 'train' END AS split FROM documents) GROUP BY lang")
def family_split_pivot(t, spark):
    return sampling.threshold_split(t("documents"), "source", 0.2).groupBy("lang").pivot("split", ["train", "eval"]).count().na.fill(0, ["train", "eval"])


@query("SELECT lang, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, CAST(count(DISTINCT source) AS BIGINT) AS n FROM documents GROUP BY lang")
def tag_sets(t, spark):
    return t("documents").groupBy("lang").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.countDistinct("source").alias("n"))


@query("SELECT source FROM documents WHERE lang = 'en' INTERSECT SELECT source FROM documents WHERE lang = 'fr'")
def universe_overlap(t, spark):
    d = t("documents")
    return d.where("lang = 'en'").select("source").intersect(d.where("lang = 'fr'").select("source"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def universe_difference(t, spark):
    return t("documents").select("doc_id").exceptAll(t("labels").select("doc_id").distinct())


@query("SELECT 'labels' AS origin, CAST(count(*) AS BIGINT) AS n FROM labels UNION ALL SELECT 'documents', CAST(count(*) AS BIGINT) FROM documents")
def union_tagged(t, spark):
    a = t("labels").select(F.lit("labels").alias("origin"), "doc_id", "quality")
    return a.unionByName(t("documents").select(F.lit("documents").alias("origin"), "doc_id"), allowMissingColumns=True).groupBy("origin").agg(F.count("*").alias("n"))


@query()
def minhash_near_dups(t, spark):
    """Clusters within each source at 0.9 and 0.8: raw and unique tokens."""
    d = t("documents").select("doc_id", "source", "text", F.size(T.words(F.col("text"))).alias("tokens"))
    out = None
    for th, found in dedup.clusters_at(d, "doc_id", [0.9, 0.8], scope=["source"]).items():
        u = dedup.unique_tokens(found, "tokens", ["source"]).withColumn("threshold", F.lit(th))
        out = u if out is None else out.union(u)
    return out


@query()
def bootstrap_ci(t, spark):
    return stats.bootstrap(t("documents").select("doc_id", "lang", "n_chars"), ["lang"], "n_chars", 200)
