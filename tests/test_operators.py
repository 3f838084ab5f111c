"""Operators against plain Python, invariants and edge cases."""

import difflib
import io
import json
import random
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom import schemas, sources, streaming
from codeloom.functions import stats, text as T
from codeloom.operators import classify, dedup, edits, graph, metrics, sampling, tables, tokens
from codeloom.plans import registry

SF = "/root/testdata/sf0.001"


def one(spark, col, **values):
    kinds = {str: "string", int: "bigint", float: "double", list: "array<string>", type(None): "string"}
    d = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))
    return d.select(col.alias("x")).first().x


def test_lines_and_strip(spark):
    for s in ["", "a", "a\n", "a\r\nb", "\n\n", "a\rb\n", " \t x \n"]:
        assert one(spark, T.lines(F.col("s")), s=s) == s.splitlines()
        assert one(spark, T.strip(F.col("s")), s=s) == s.strip()


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 20])
def test_order_statistics(spark, n):
    v = sorted(random.Random(n).choices(range(10), k=n))
    d = spark.createDataFrame([(x,) for x in v], "v int").withColumn("g", F.lit("g"))
    got = stats.order_stats(d, ["g"], "v", {"a": ("nearest", 0.95), "b": ("floor", 0.9), "c": ("upper_median", 0), "d": ("below", 0.95), "f": ("max", 1)}).first()
    assert (got.a, got.b, got.c, got.d, got.f) == (v[min(n - 1, round(0.95 * (n - 1)))], v[min(n - 1, int(0.9 * n))], v[n // 2], v[max(0, int(0.95 * n) - 1)], v[-1])


def test_keep_first_is_stable(spark):
    rows = [(i, f"t{i % 7}" if i % 5 else None) for i in range(60)]
    want = {min(i for i, t in rows if t == k) for k in {t for _, t in rows}}
    for parts in (1, 4, 16):
        d = spark.createDataFrame(rows, "id int, t string").repartition(parts)
        assert {r.id for r in dedup.keep_first(d, ["t"], ["id"]).collect()} == want


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        u, v = sorted((find(a), find(b)))
        root[v] = u
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_near_duplicates_with_a_hot_bucket(spark):
    base = " ".join(f"w{i}" for i in range(80))
    rows = [(i, base + f" end{i % 3}", "s") for i in range(230)] + [(1000, "something else entirely " * 9, "s"), (1001, None, "s"), (1002, "few", "s")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    c = {r.doc_id: r.cluster for r in dedup.clusters(d, "doc_id", 0.8, scope=["source"]).collect()}
    assert {c[i] for i in range(230)} == {0} and c[1000] == 1000 and len(c) == 233


def test_large_buckets_lose_no_links(spark, monkeypatch):
    rnd = random.Random(3)
    base = [f"w{i}" for i in range(150)]

    def copy():
        w = list(base)
        w[rnd.randrange(len(w))] = f"x{rnd.random()}"
        w[rnd.randrange(len(w))] = f"x{rnd.random()}"
        return " ".join(w)

    texts = [copy() for _ in range(300)]
    rows = [(i, t, "s") for i, t in enumerate([*texts, texts[0], " ".join(base)])]
    s = dedup.signatures(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), "text").select("doc_id", "source", "sig").collect()
    sig = {r.doc_id: np.array(r.sig) for r in s}
    d = spark.createDataFrame(s, "doc_id bigint, source string, sig array<bigint>")
    monkeypatch.setattr(dedup, "BLOCK", 64, raising=False)
    for th in (0.9, 0.8):
        root = {k: k for k in sig}
        for a in sig:
            for b in sig:
                met = a < b and (sig[a] == sig[b]).reshape(dedup.BANDS, -1).all(1).any()
                if met and (sig[a] == sig[b]).sum() >= th * dedup.SIGNATURE and root[a] != root[b]:
                    x, y = sorted((root[a], root[b]))
                    root = {k: x if r == y else r for k, r in root.items()}
        got = {r.id: r.component for r in graph.components(dedup.near_links(d, "doc_id", [th], ["source"])[th]).collect()}
        assert {k: got.get(k, k) for k in sig} == root
        assert len(set(root.values())) < len(root)


def test_splits_do_not_overlap(spark):
    d = spark.createDataFrame([(i, f"k{i % 40}", "ab"[i % 2]) for i in range(400)], "id int, k string, f string")
    for parts in (1, 8):
        s = sampling.holdout(d.repartition(parts), "k", 0.1, 7, ["f"])
        assert sampling.overlap(s, ["f", "k"]).count() == 0 and s.count() == 400
        assert s.where("split = 'eval'").select("f", "k").distinct().count() == 4
    nested = sampling.nested_doses(d, "id", [0.1, 0.3])
    assert nested.where("dose_10 and not dose_30").count() == 0


def test_license_order(spark):
    got = one(spark, classify.license_class(F.col("f")), f="AGPL-3 | MIT")
    assert (got.decision, got.license_class, got.flag) == ("include", "MIT", "agpl-redistribution-sensitive")
    assert one(spark, classify.license_class(F.col("f")), f=None).reason == "empty-or-unknown-license-field"


def test_detector_prefilter(spark):
    for s, want in [("x <- 1", True), ("```R\nx\n```", True), ("plain", False), ("```python\nx\n```", False)]:
        assert one(spark, classify.prefilter(F.col("s")), s=s) is want


def test_target_tampering(spark):
    """A changed line moves the target; a no-op has none."""
    a = one(spark, edits.suffix_target(F.col("o"), F.col("n"))[1], o=["a", "b"], n=["a", "c"])
    assert a == "c\n>>>>>>> UPDATED"
    assert one(spark, edits.suffix_target(F.col("o"), F.col("n"))[2], o=["a"], n=["a"]) == "empty_after_head_strip"
    assert one(spark, edits.first_difference(F.col("o"), F.col("n")), o=[], n=["a"]) == 0


def test_midtyping(spark):
    typed, at, rest = edits.midtyping(F.lit("k"), F.col("o"), F.col("n"))
    o, n = ["a", "old line"], ["a", "new line here", "tail"]
    t, r = one(spark, typed, o=o, n=n), one(spark, rest, o=o, n=n)
    assert t[:1] == ["a"] and t[1] + r[0] == "new line here" and r[1:] == ["tail"] and one(spark, at, o=o, n=n) == 1


def test_fim_round_trip(spark):
    s = "añb\r\ncdé"
    prompt, target = edits.fim(F.col("s"), F.lit(1), F.lit(4))
    assert one(spark, edits.causal(prompt, target), s=s) == s.replace("\r\n", "\n")
    assert one(spark, prompt, s="x <[fim-middle]> y") is None


def test_budget(spark):
    assert one(spark, edits.budget_front(F.col("s"), 6), s=["aaaa", "bb", "c"]) == ["bb", "c"]
    assert one(spark, edits.budget_front(F.col("s"), 0), s=["a"]) == []


def test_line_f1(spark):
    rng = random.Random(2)
    rows = [(i, rng.choices("abcd", k=rng.randrange(6)), rng.choices("abcd", k=rng.randrange(6))) for i in range(60)]
    d = spark.createDataFrame(rows, "i int, p array<string>, t array<string>")
    for r in d.select("p", "t", metrics.line_f1(F.col("p"), F.col("t")).alias("f")).collect():
        hit = sum(m.size for m in difflib.SequenceMatcher(None, r.p, r.t, autojunk=False).get_matching_blocks())
        assert r.f == pytest.approx(2 * hit / (len(r.p) + len(r.t)) if r.p and r.t else float(r.p == r.t))


def test_blocks(spark):
    rows = [(i * 3000, [f"{i}_{j}" for j in range(i % 9)]) for i in range(50)] + [(7, None)]
    flat = [x for _, t in sorted(rows) for x in [*(t or []), "E"]]
    got = {r.block: r.toks for r in tokens.blocks(spark.createDataFrame(rows, "k bigint, t array<string>"), "k", "t", "E", 16).collect()}
    n = (len(flat) - 1) // 17
    assert got == {b: flat[16 * b : 16 * b + 17] for b in range(n)}


def test_innermost_span(spark):
    spans = [(0, 0, 500), (1, 10, 90), (2, 20, 30), (3, 85, 200)]
    pts = spark.createDataFrame([(i,) for i in range(0, 300, 7)], "p int")
    got = {r.p: r.sid for r in tables.innermost(pts, spark.createDataFrame(spans, "sid int, start int, end int"), "p", "p").collect()}
    assert got == {p: min((e - s, s, i) for i, s, e in spans if s <= p <= e)[2] for p in range(0, 300, 7)}


def test_damaged_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"i": 1, "lang": "R"}\n{"i": 2, "la\n{"i": 3}\n')
    d = sources.union_of(spark, [f"{tmp_path}/a.jsonl", f"{tmp_path}/missing.jsonl"], "i int, lang string").cache()
    assert d.count() == 3 and d.where("_corrupt is not null").count() == 1
    assert sources.union_of(spark, [f"{tmp_path}/none"], schemas.SFT_ROW).count() == 0


def test_sinks_and_resume(spark, tmp_path):
    d = spark.createDataFrame([(i, "pq"[i % 2]) for i in range(20)], "id int, package string")
    path = f"{tmp_path}/shards"
    sources.write_shards(d, path, "package", 4)
    sources.write_shards(d.where("package = 'p' and id < 4"), path, "package")
    assert spark.read.parquet(path).count() == 12
    sources.drop_partition(spark, path, "package", "p")
    assert spark.read.parquet(path).count() == 10
    ledger = f"{tmp_path}/ledger"
    assert sources.resume(d, ledger, "id").count() == 20
    sources.append(d.where("id < 15"), ledger)
    assert sources.resume(d, ledger, "id").count() == 5
    assert sources.changed(d, d.where("id > 3"), ["id"]).count() == 4


def test_archives_and_records(spark, tmp_path):
    with tarfile.open(tmp_path / "p.tar.gz", "w:gz") as t:
        for name, body in (("p/R/a.R", b"x <- 1\n"), ("p/DESCRIPTION", b"Package: p\n")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
    assert [(r.member, r.content) for r in sources.members(spark, f"{tmp_path}/p.tar.gz").collect()] == [("p/R/a.R", "x <- 1\n")]
    m = one(spark, sources.dcf(F.col("s")), s="Package: p\nTitle: one\n  two\nLicense: MIT\n")
    assert m == {"Package": "p", "Title": "one two", "License": "MIT"}
    assert one(spark, F.size(sources.records(F.col("s"))), s="a: 1\n\nb: 2\n \nc: 3") == 3


def test_streams(spark, tmp_path):
    rows = [(i % 10, f"2024-01-01 00:{i:02d}:00") for i in range(30)]
    d = spark.createDataFrame(rows, "id int, ts string").withColumn("ts", F.to_timestamp("ts"))
    d.repartition(3).write.parquet(f"{tmp_path}/in")
    s = streaming.stream(spark, f"{tmp_path}/in", d.schema, files=1)
    streaming.accept_once(s, f"{tmp_path}/out", f"{tmp_path}/c1", "id", "ts")
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(10))
    streaming.accept_once(streaming.stream(spark, f"{tmp_path}/in", d.schema), f"{tmp_path}/out", f"{tmp_path}/c1", "id", "ts")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 10
    streaming.drain(streaming.windows(streaming.stream(spark, f"{tmp_path}/in", d.schema), "ts", "0 seconds", "10 minutes"), f"{tmp_path}/w", f"{tmp_path}/c2")
    assert sum(r.n for r in spark.read.parquet(f"{tmp_path}/w").collect()) in (20, 30)


def test_plugins():
    @registry.plugin("normalizer", "upper_test")
    def upper(c):
        return F.upper(c)

    assert registry.get("normalizer", "upper_test") is upper
    with pytest.raises(KeyError):
        registry.get("normalizer", "none")


def test_conversation_schema(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text(json.dumps({"mid": "1", "messages": [{"role": "user", "content": "hi", "index": 0}], "languages": ["R"]}) + "\n")
    d = sources.jsonl(spark, f"{tmp_path}/c.jsonl", schemas.CONVERSATION)
    assert d.where(F.array_contains("languages", "R")).select(F.element_at("messages", -1)["content"].alias("c")).first().c == "hi"
