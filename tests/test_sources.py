"""Readers and writers that only files can show."""

import gzip
import io
import json
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom import sources


def test_package_store(spark, tmp_path):
    for pkg, version, name, text in [("a", "1.9", "R/x.R", "x <- 1"), ("a", "1.10", "R/x.R", "x <- 2"), ("a", "1.10", "R/y.R", "y <- 2"), ("b", "0.1", "R/z.r", "z"), ("b", "0.1", "R/bin.R", "a\0b"), ("b", "0.1", "R/long.R", "l" * 500)]:
        f = tmp_path / pkg / version / pkg / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    got = sources.package_files(spark, str(tmp_path), [".r"], 400, newest=True).collect()
    assert sorted((r.package, r.version, r.rel, r.source) for r in got) == [("a", "1.10", "R/x.R", "x <- 2"), ("a", "1.10", "R/y.R", "y <- 2"), ("b", "0.1", "R/z.r", "z")]
    assert sources.package_files(spark, str(tmp_path), [".r"], 400).count() == 4
    capped = sources.package_files(spark, str(tmp_path), [".r"], 400, per_package=1)
    assert sorted(r.package for r in capped.collect()) == ["a", "b"]


def test_cached_scan(spark, tmp_path):
    d = spark.range(5)
    assert sources.cached(d, str(tmp_path), a=1).count() == 5
    assert sources.cached(spark.range(9), str(tmp_path), a=1).count() == 5 and sources.cached(spark.range(9), str(tmp_path), a=2).count() == 9


def test_log_and_mapping(spark, tmp_path):
    with gzip.open(tmp_path / "log.csv.gz", "wt") as f:
        f.write('"date","package"\n1,b\n2,a\n3,b\n4, \n5,c\n')
    assert [tuple(r) for r in sources.log_counts(spark, str(tmp_path / "log.csv.gz")).collect()] == [(2, "b"), (1, "a"), (1, "c")]
    m = tmp_path / "m"
    m.mkdir()
    (m / "a.json").write_text(json.dumps([{"package": "p", "url": "https://github.com/o/r/"}, {"package": "q", "url": "https://github.com/cran/q"}, {"package": "i", "url": "https://github.com/o/i/issues"}, {"package": "x", "url": "https://example.org/x"}]))
    (m / "b.json").write_text(json.dumps([{"package": "p", "url": "https://github.com/other/r"}, {"package": "z", "url": " https://github.com/o/z "}]))
    assert sorted(tuple(r) for r in sources.repository_mapping(spark, str(m)).collect()) == [("p", "o/r"), ("z", "o/z")]


def test_token_blocks(spark, tmp_path):
    a, b = np.arange(1000, dtype="<u2"), np.arange(33, dtype="<u2")
    a.tofile(tmp_path / "a.bin")
    b.tofile(tmp_path / "b.bin")
    got = {r.block: r.toks for r in sources.token_blocks(spark, str(tmp_path), 16).collect()}
    want = [x[k * 16 : k * 16 + 17].tolist() for x in (a, b) for k in range((len(x) - 1) // 16)]
    assert [got[i] for i in range(len(want))] == want and len(got) == len(want)


def test_verified_swap(spark, tmp_path):
    at = str(tmp_path / "t")
    assert sources.replace_verified(spark.range(3), at, lambda d: d.count() == 3) == 3
    with pytest.raises(ValueError):
        sources.replace_verified(spark.range(9), at, lambda d: False)
    assert spark.read.parquet(at).count() == 3
    sources.replace_verified(spark.range(4), at, lambda d: True)
    assert spark.read.parquet(at).count() == 4 and [p.name for p in tmp_path.iterdir()] == ["t"]


def test_archives_and_layout(spark, tmp_path):
    with tarfile.open(tmp_path / "p_1.tar.gz", "w:gz") as t:
        for name, text in [("p/LICENSE", b"MIT"), ("p/inst/LICENSE", b"no"), ("p/R/a.R", b"x")]:
            info = tarfile.TarInfo(name)
            info.size = len(text)
            t.addfile(info, io.BytesIO(text))
    assert [(r.member, r.content) for r in sources.license_members(spark, str(tmp_path / "p_1.tar.gz")).collect()] == [("p/LICENSE", "MIT")]
    d = spark.createDataFrame([("Edit Pairs", "x"), ("Edit Pairs", "x"), ("b", "y")], "f string, s string")
    assert sorted(tuple(r) for r in sources.layout(d, "f", "s").collect()) == [("data/b/y.jsonl", 1), ("data/edit-pairs/x.jsonl", 2)]


def test_damaged_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1, "prefix": null}\n{"a": 2}\n{"a": 3, "pre')
    d = sources.union_of(spark, [str(tmp_path / "a.jsonl"), str(tmp_path / "none.jsonl")], "a int, prefix string").cache()
    assert d.where(F.col("_corrupt").isNotNull()).count() == 1 and d.count() == 3
