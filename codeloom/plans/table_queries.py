"""Queries over events, pages, conversations and the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import classify, dedup, sampling, tables
from .registry import query

HOST = "regexp_extract(url, '^[a-z]+://([^/:]+)', 1)"


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 25")
def top_k_ranking(t, spark):
    return t("events").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(25)


@query("WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM l WHERE r = 1 GROUP BY event_type")
def ledger_latest(t, spark):
    return dedup.latest(t("events"), "user_id", "ts", "event_id").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def resume_anti_join(t, spark):
    """Documents that are not labelled yet."""
    return tables.pending(t("documents").select("doc_id"), t("labels"), "doc_id")


@query("WITH w AS (SELECT event_id, user_id, event_type, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_event_id, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_event_type FROM events) SELECT * FROM w WHERE next_event_id IS NOT NULL")
def next_pair_lead(t, spark):
    return tables.next_pairs(t("events").select("event_id", "user_id", "event_type", "ts"), "user_id", ["ts", "event_id"], ["event_id", "event_type"]).drop("ts")


@query("WITH w AS (SELECT user_id, event_id, event_type, ts, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS old FROM events), p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM w WHERE old <> event_type) SELECT user_id, event_id, event_type, old, CAST(k AS INTEGER) AS k FROM p WHERE k <= 6")
def version_transitions(t, spark):
    return tables.transitions(t("events"), "user_id", [F.desc("ts"), F.desc("event_id")], "event_type", 6).select("user_id", "event_id", "event_type", "old", "k")


@query("WITH r AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS place FROM r WHERE r <= 3")
def event_ring_last3(t, spark):
    return tables.ring(t("events"), "user_id", ["ts", "event_id"], 3).select("user_id", "event_id", "place")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 21600000000 THEN 0 ELSE 1 END AS n, event_id FROM events), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS grp FROM g) SELECT user_id, CAST(grp AS BIGINT) AS grp, min(ts) AS first_ts, max(ts) AS last_ts, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, grp")
def debounce_groups(t, spark):
    return tables.gap_groups(t("events"), "user_id", "ts", "event_id", 6 * 3600)


@query("SELECT user_id, event_id, CAST(max(greatest(0, ceil((event_id - 1000) / 512.0) * 512)) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS anchor FROM events")
def anchor_hysteresis(t, spark):
    return tables.hysteresis(t("events").select("user_id", "event_id"), "user_id", "event_id", "event_id", 512, 1000)


@query("WITH s AS (SELECT event_type, count(*) AS n FROM events GROUP BY event_type), r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS c FROM events) SELECT event_id, event_type FROM r JOIN s USING (event_type) ORDER BY c, n, event_type LIMIT 40")
def minority_first(t, spark):
    return sampling.minority_first(t("events").select("event_id", "event_type"), "event_type", ["event_id"], 40)


@query("WITH w AS (SELECT *, CASE WHEN s_acctbal > 5000 THEN 0 ELSE 1 END AS pass FROM supplier), r AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY pass, s_acctbal DESC, s_suppkey) AS r FROM w) SELECT s_suppkey, s_nationkey, pass FROM r WHERE r <= 3 ORDER BY pass, s_acctbal DESC, s_suppkey LIMIT 40")
def owner_capped_selection(t, spark):
    s = t("supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return sampling.owner_capped(s, "s_nationkey", F.col("s_acctbal") > 5000, [F.desc("s_acctbal"), "s_suppkey"], 3, 40).select("s_suppkey", "s_nationkey", "pass")


@query("SELECT p_brand, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN p_brand IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS hit_rate FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size < 30) p ON l_partkey = p_partkey GROUP BY p_brand")
def provenance_left_join(t, spark):
    j = tables.enriched(t("lineitem").select(F.col("l_partkey").alias("p_partkey")), t("part").where("p_size < 30").select("p_partkey", "p_brand"), "p_partkey")
    return j.groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("hit_rate"))


@query("SELECT s_name, n_name, CAST(count(*) AS BIGINT) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY s_name, n_name")
def ranking_inner_join(t, spark):
    n = t("lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    return n.join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("s_name", "n_name").agg(F.sum("n").alias("n"))


@query("WITH e AS (SELECT CAST(ts AS DATE) AS d, * FROM events), a AS (SELECT d, count(*) AS n FROM e GROUP BY d), b AS (SELECT d, count(DISTINCT user_id) AS u FROM e GROUP BY d), c AS (SELECT d, max(value) AS m FROM e GROUP BY d) SELECT CAST(d AS VARCHAR) AS d, CAST(n AS BIGINT) AS n, CAST(u AS BIGINT) AS u, round(m, 6) AS m FROM a JOIN b USING (d) JOIN c USING (d)")
def multiway_token_join(t, spark):
    e = t("events").withColumn("d", F.to_date("ts"))
    g = e.groupBy("d")
    j = tables.joined_on([g.agg(F.count("*").alias("n")), g.agg(F.countDistinct("user_id").alias("u")), g.agg(F.max("value").alias("m"))], "d")
    return j.select(F.col("d").cast("string").alias("d"), "n", "u", F.round("m", 6).alias("m"))


@query("SELECT u.conv_id, u.turn, a.text AS answer FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'")
def composite_key_lookup(t, spark):
    """Each question's answer, by (conv_id, turn, role)."""
    c = t("conversations")
    asked = c.where("role = 'user'").select("conv_id", F.col("turn").alias("asked"), (F.col("turn") + 1).alias("turn"), F.lit("assistant").alias("role"))
    return tables.looked_up(asked, c.withColumnRenamed("text", "answer"), ["conv_id", "turn", "role"]).select("conv_id", F.col("asked").alias("turn"), "answer")


@query("WITH s(sid, a, b) AS (VALUES (1, 0, 4000), (2, 100, 900), (3, 120, 300), (4, 5000, 9000)), h AS (SELECT event_id, sid, row_number() OVER (PARTITION BY event_id ORDER BY b - a, a) AS r FROM events JOIN s ON event_id BETWEEN a AND b) SELECT event_id, sid FROM h WHERE r = 1")
def containment_join(t, spark):
    spans = spark.createDataFrame([(1, 0, 4000), (2, 100, 900), (3, 120, 300), (4, 5000, 9000)], "sid int, start int, end int")
    return tables.innermost(t("events").select("event_id"), spans, "event_id", "event_id").select("event_id", "sid")


@query("""WITH d AS (SELECT doc_id AS a, list_distinct(list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda x: x <> '')) AS w FROM documents), b AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda x: x <> '')) AS w FROM benchmark),
de AS (SELECT a, len(w) AS n, unnest(w) AS x FROM d), be AS (SELECT item_id, unnest(w) AS x FROM b), s AS (SELECT a, item_id, count(*) / min(n) AS s FROM de JOIN be USING (x) GROUP BY a, item_id HAVING count(*) / min(n) >= 0.1), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, item_id) AS r FROM s)
SELECT a AS doc_id, item_id, round(s, 6) AS score FROM r WHERE r = 1""")
def best_overlap_match(t, spark):
    d = t("documents").select("doc_id", T.words(F.col("text")).alias("w"))
    b = t("benchmark").select("item_id", T.words(F.col("text")).alias("w"))
    return tables.best_overlap(d, "doc_id", b, "item_id", "w", 0.1).select("doc_id", "item_id", F.round("score", 6).alias("score"))


@query("SELECT a.user_id, a.event_id, min(b.event_id) AS sibling FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_id > a.event_id AND a.event_type <> b.event_type GROUP BY a.user_id, a.event_id")
def next_other_kind(t, spark):
    return tables.next_of_other_kind(t("events").select("event_id", "user_id", "event_type"), "user_id", "event_id", "event_type").select("user_id", "event_id", "sibling")


@query("""WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda x: x <> '') AS w FROM conversations)
SELECT a.conv_id, a.turn, min(b.turn) AS sibling FROM w a JOIN w b ON a.conv_id = b.conv_id AND a.turn <> b.turn AND NOT list_has_any(a.w, b.w) GROUP BY a.conv_id, a.turn""")
def sibling_no_leak(t, spark):
    """Each turn with the first other turn of its conversation that shares no word with it."""
    c = t("conversations").select("conv_id", "turn", T.words(F.col("text")).alias("w"))
    return tables.first_disjoint(c, "conv_id", "turn", "w")


@query(f"SELECT {HOST} AS host, CAST(count(*) AS BIGINT) AS n, min(page_id) AS first_page FROM pages GROUP BY 1")
def url_owner_mapping(t, spark):
    h = t("pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/:]+)", 1).alias("host"))
    first = dedup.keep_first(h, ["host"], ["page_id"]).select("host", F.col("page_id").alias("first_page"))
    return h.groupBy("host").agg(F.count("*").alias("n")).join(first, "host")


@query("WITH l AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))) AS link FROM pages) SELECT page_id, CAST(count(*) AS BIGINT) AS n, min(link) AS first_link FROM l GROUP BY page_id")
def page_license_links(t, spark):
    l = t("pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))).alias("link"))
    return l.groupBy("page_id").agg(F.count("*").alias("n"), F.min("link").alias("first_link"))


@query("SELECT conv_id, arg_max(text, turn) AS last_text, CAST(max(turn) AS BIGINT) AS turn FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def last_message_extract(t, spark):
    return t("conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("last_text"), F.max("turn").alias("turn"))


@query("""WITH u AS (SELECT trim(regexp_replace(text, '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g')) AS b FROM conversations WHERE role = 'user')
SELECT CASE WHEN length(b) < 15 OR length(b) > 400 THEN 'len_out_of_range' WHEN len(regexp_extract_all(b, '[A-Za-z][A-Za-z''-]*')) < 3 THEN 'too_few_words' WHEN NOT regexp_matches(lower(b), 'the|der|que|fix|use') THEN 'no_intent_lexicon' ELSE 'kept' END AS reason, CAST(count(*) AS BIGINT) AS n FROM u GROUP BY 1""")
def instruction_gate(t, spark):
    r = classify.instruction_reject(F.col("text"), F.lit(None).cast("string"), ["the", "der", "que", "fix", "use"])
    return t("conversations").where("role = 'user'").select(F.coalesce(r, F.lit("kept")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 6) AS discount FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def conditional_rollup(t, spark):
    return t("lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.avg("l_discount"), 6).alias("discount"))


@query("SELECT o_orderpriority, arg_min(o_orderkey, struct_pack(a := o_totalprice, b := o_orderkey)) AS best, round(min(o_totalprice), 2) AS price FROM orders GROUP BY 1")
def best_config(t, spark):
    return t("orders").groupBy("o_orderpriority").agg(F.min_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("best"), F.round(F.min("o_totalprice"), 2).alias("price"))


@query("SELECT c_mktsegment, CAST(count(*) FILTER (c_acctbal > 0) AS BIGINT) AS pos, CAST(count(*) FILTER (NOT c_acctbal > 0) AS BIGINT) AS neg, CAST(count(*) FILTER (c_acctbal IS NULL) AS BIGINT) AS unknown FROM customer GROUP BY 1")
def tri_state_counts(t, spark):
    g = F.col("c_acctbal") > 0
    return t("customer").groupBy("c_mktsegment").agg(F.count_if(g).alias("pos"), F.count_if(~g).alias("neg"), F.count_if(g.isNull()).alias("unknown"))


@query("SELECT user_id, event_id, CAST(regexp_extract(props, '\"k\": ([0-9]+)', 1) AS BIGINT) AS k FROM events")
def json_field(t, spark):
    return t("events").select("user_id", "event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("SELECT o_orderkey, coalesce(o_orderpriority, '') AS p FROM orders ORDER BY p DESC, o_orderkey LIMIT 60")
def nulls_as_empty_sort(t, spark):
    return t("orders").select("o_orderkey", F.coalesce("o_orderpriority", F.lit("")).alias("p")).orderBy(F.desc("p"), "o_orderkey").limit(60)


@query("SELECT CAST(time_bucket(INTERVAL '1 hour', ts) AS TIMESTAMP) AS start, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL")
def tumbling_counts(t, spark):
    w = F.window("ts", "1 hour")
    return t("events").groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("SELECT event_id FROM events")
def stream_seen_dedup(t, spark):
    """Each event once, by a stream over the table's files; equal to the table's keys."""
    from .. import streaming
    from ..storage import fresh_dir

    e = t("events")
    at = fresh_dir(spark, "stream")
    e.union(e).write.parquet(f"{at}/in")
    s = streaming.stream(spark, f"{at}/in", e.schema, files=1)
    streaming.drain(streaming.seen_once(s.select("event_id", "ts"), "event_id", "ts", "3650 days").select("event_id"), f"{at}/out", f"{at}/state")
    return spark.read.parquet(f"{at}/out")
