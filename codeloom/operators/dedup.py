"""Exact and near-duplicate removal. Keeping is always by a stated order, never arbitrary."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions import text as T
from ..storage import written
from .graph import components

SIGNATURE, BANDS = 128, 16
#: Rows of a large bucket that are compared at once, with as many others.
BLOCK = 1024
_rng = np.random.default_rng(1)
_A = _rng.integers(1, 1 << 63, SIGNATURE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, SIGNATURE, dtype=np.uint64)


def keep_first(df: DataFrame, keys: list[Column | str], order: list[Column | str]) -> DataFrame:
    """The first row of each key, by a total order. Null keys equal each other.

    Keys are told apart by 128-bit digests. A key's first row is found by an aggregation that starts
    before the shuffle, so a hot key needs no place in one task.
    """
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    by = [F.col(o) if isinstance(o, str) else o for o in order]
    parts = [x for c in cols for x in (c.isNull(), c)]
    first = F.min(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(by)], F.struct(*df.columns).alias("row"))).alias("f")
    return df.groupBy(F.xxhash64(*parts).alias("k1"), F.xxhash64(*parts, F.lit(1)).alias("k2")).agg(first).select("f.row.*")


def latest(df: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """The last row of each key: how an append-only ledger is read."""
    last = F.max(F.struct(F.col(ts).alias("a"), F.col(tie).alias("b"), F.struct(*df.columns).alias("row"))).alias("f")
    return df.groupBy(F.col(key).alias("__k")).agg(last).select("f.row.*")


def keep_first_collapsed(df: DataFrame, text: str, order: list[Column | str]) -> DataFrame:
    """keep_first on the text with its white space collapsed."""
    return keep_first(df, [F.md5(T.collapse(F.col(text)))], order)


def exact_groups(df: DataFrame, text: str, key: str) -> DataFrame:
    """(hash, n, first): groups of equal texts of two rows or more."""
    return df.groupBy(F.sha1(F.col(text)).alias("hash")).agg(F.count("*").alias("n"), F.min(key).alias("first")).where("n > 1")


def normalized_block(c: Column) -> Column:
    """A block with every line stripped, for comparison."""
    return F.array_join(F.transform(F.split(c, "\n"), T.strip), "\n")


def _signatures(grams: pa.ListArray) -> pa.ListArray:
    """Of each list of hashes the 128 minima; null for null."""
    off = grams.offsets.to_numpy()
    full = np.diff(off) > 0
    sig = np.zeros((int(full.sum()), SIGNATURE), np.int64)
    if len(sig):
        h = grams.values.to_numpy()[: off[-1]].view(np.uint64)  # null lists hold nothing
        for k in range(SIGNATURE):
            sig[:, k] = np.minimum.reduceat(h * _A[k] + _B[k], off[:-1][full]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(full * SIGNATURE)]).astype(np.int32)), pa.array(sig.reshape(-1)), mask=pa.array(~full))


def signatures(df: DataFrame, text: str, out: str = "sig") -> DataFrame:
    """df with 128 MinHash values over the hashes of 5-word shingles; null with fewer than 8 distinct ones."""
    grams = T.bound(T.gram_hashes(T.words(F.col(text)), 5), F.array_distinct)
    long = F.when(F.size(grams) >= 8, grams)

    def run(batches):
        for b in batches:
            cols = [*(b.column(i) for i in range(b.num_columns - 1)), _signatures(b.column(b.num_columns - 1))]
            yield pa.RecordBatch.from_arrays(cols, [*b.schema.names[:-1], out])

    kind = S.StructType([*df.schema.fields, S.StructField(out, S.ArrayType(S.LongType()))])
    return df.select("*", long.alias("__grams")).mapInArrow(run, kind)


def _block_links(members, least: float) -> list[tuple[int, int]]:
    """Places of members whose links join different components in one block pair: no more than there are members."""
    side = members.field("side").to_numpy()
    n = len(side)
    sig = members.field("sig").flatten().to_numpy().reshape(n, SIGNATURE)
    comp = np.unique(members.field("comp").to_numpy(zero_copy_only=False), return_inverse=True)[1]
    same = np.zeros((n, n), np.uint8)
    for k in range(SIGNATURE):
        same += sig[:, None, k] == sig[None, :, k]
    near = (same >= least) & (comp[:, None] != comp[None, :]) & ((side[:, None] != side[None, :]) | (side[:, None] == 2))
    out, left = [], np.ones(n, bool)
    for start in range(n):
        stack = [start] if left[start] else []
        left[start] = False
        while stack:
            x = stack.pop()
            new = np.flatnonzero(near[x] & left)
            left[new] = False
            out += [(x, int(y)) for y in new]
            stack += new.tolist()
    return out


def _within_buckets(buckets: DataFrame, links: DataFrame, sig: DataFrame, key: str, where: list[str], least: float) -> DataFrame:
    """(a, b): links that join what `links` leaves apart in the buckets; all pairs, in blocks of bounded size."""
    comp = components(links)
    m = buckets.where("n > 2").join(comp.withColumnRenamed("id", key), key, "left").withColumn("comp", F.coalesce("component", key))
    several = m.groupBy(*where).agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select(*where)
    m = m.join(several, where).join(sig, key).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    dealt = m.withColumn("blk", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("blk") == F.col("other"), 2).when(F.col("blk") < F.col("other"), 0).otherwise(1)
    groups = dealt.groupBy(*where, F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j")).agg(F.collect_list(F.struct(F.col(key).alias("key"), "comp", side.alias("side"), "sig")).alias("members"))

    def run(batches):
        for batch in batches:
            for row in batch.column(0):
                keys = row.values.field("key")
                found = _block_links(row.values, least)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array([p[i] for p in found], pa.int64())) for i in (0, 1)], ["a", "b"])

    kind = sig.schema[key].dataType.simpleString()
    return groups.select("members").mapInArrow(run, f"a {kind}, b {kind}")


def near_links(df: DataFrame, key: str, thresholds: list[float], scope: list[str] | None = None) -> dict[float, DataFrame]:
    """For each threshold, links (a, b) of rows with a signature `sig`, whose connected components are those of all
    pairs that share a bucket (16 bands of 8 values) and agree in enough of their values.

    Rows of one signature are linked to the first of them, which alone goes on. Every bucket first
    links its rows to the smallest key, once for all thresholds; what then lies apart in a bucket is
    compared in full, by pairs of blocks of about BLOCK rows, of which only joining links come back.
    """
    scope = scope or []
    digest = [F.xxhash64("sig").alias("d1"), F.xxhash64("sig", F.lit(1)).alias("d2")]
    every = df.where("sig is not null").select(key, *scope, "sig", *digest)
    rows = written(every.groupBy(*scope, "d1", "d2").agg(F.min(key).alias("a"), F.any_value("sig").alias("sig")), "signatures")
    one = rows.select(*[F.col(c).alias(f"s{i}") for i, c in enumerate(scope)], F.col("d1").alias("e1"), F.col("d2").alias("e2"), "a")
    same_sig = (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2"))
    for i, c in enumerate(scope):
        same_sig &= F.col(c).eqNullSafe(F.col(f"s{i}"))
    equal = written(every.drop("sig").join(one, same_sig).select("a", F.col(key).alias("b")).where("a <> b"), "equal")
    sig = rows.select(F.col("a").alias(key), "sig")
    width = SIGNATURE // BANDS
    bands = rows.select(F.col("a").alias(key), *scope, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(F.slice("sig", b * width + 1, width)))).alias("band", "h"))
    where = [*scope, "band", "h"]
    n = bands.groupBy(*where).agg(F.count("*").alias("n"), F.min(key).alias("first")).where("n > 1")
    same_bucket = (F.col("band") == F.col("band2")) & (F.col("h") == F.col("h2"))
    for i, c in enumerate(scope):
        same_bucket &= F.col(c).eqNullSafe(F.col(f"s{i}"))
    heads = n.select(*[F.col(c).alias(f"s{i}") for i, c in enumerate(scope)], F.col("band").alias("band2"), F.col("h").alias("h2"), "n", "first")
    buckets = written(bands.join(heads, same_bucket).select(key, *where, "n", "first"), "buckets")
    hubs = buckets.where(F.col("first") != F.col(key)).select(F.col("first").alias("a"), F.col(key).alias("b")).distinct()
    agree = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda x: x))
    tried = written(hubs.join(sig.toDF("a", "sa"), "a").join(sig.toDF("b", "sb"), "b").select("a", "b", agree.alias("agree")), "tried")
    out = {}
    for t in thresholds:
        links = tried.where(F.col("agree") >= t * SIGNATURE).select("a", "b")
        out[t] = links.union(_within_buckets(buckets, links, sig, key, where, t * SIGNATURE)).union(equal)
    return out


def clusters_at(df: DataFrame, key: str, thresholds: list[float], text: str = "text", scope: list[str] | None = None) -> dict[float, DataFrame]:
    """For each threshold, df with `cluster`: equal texts and near pairs, connected; a row alone is its own cluster.

    Signatures are made and written once for all thresholds. Null and short texts have no signature;
    keys must be unique and of a type that orders (rows with a null key are clusters of their own).
    """
    s = written(signatures(df.select(key, text, *(scope or [])), text).select(key, *(scope or []), F.sha1(F.col(text)).alias("__sha"), "sig"), "texts")
    cols = ["__sha", *(scope or [])]
    first = s.groupBy(*[F.col(c).alias(f"g{i}") for i, c in enumerate(cols)]).agg(F.min(key).alias("a"))
    match = F.lit(True)
    for i, c in enumerate(cols):
        match &= F.col(c).eqNullSafe(F.col(f"g{i}")) if i else F.col(c) == F.col(f"g{i}")
    same = s.join(first, match).select("a", F.col(key).alias("b")).where("a <> b")
    out = {}
    for t, links in near_links(s, key, thresholds, scope).items():
        comp = components(same.union(links))
        out[t] = df.join(comp.withColumnRenamed("id", key), key, "left").select(*df.columns, F.coalesce("component", key).alias("cluster"))
    return out


def clusters(df: DataFrame, key: str, threshold: float, text: str = "text", scope: list[str] | None = None) -> DataFrame:
    """clusters_at for one threshold."""
    return clusters_at(df, key, [threshold], text, scope)[threshold]


def unique_tokens(clustered: DataFrame, tokens: str, by: list[str]) -> DataFrame:
    """Raw and unique tokens: each cluster counts as its largest member."""
    per = clustered.groupBy(*by, "cluster").agg(F.max(tokens).alias("t"), F.sum(tokens).alias("raw"), F.count("*").alias("n"))
    return per.groupBy(*by).agg(F.sum("n").alias("docs"), F.sum("raw").alias("raw_tokens"), F.sum("t").alias("unique_tokens"), F.count("*").alias("clusters"))


def verbatim_spans(docs: DataFrame, key: str, refs: DataFrame, ref: str, text: str = "text", n: int = 12) -> DataFrame:
    """(key, ref, longest): the longest run of equal words that a document shares with a reference, from n words on.

    Runs of n words meet by 128-bit digests; documents' grams that no reference has go before the join.
    """
    def grams(df, k, at):
        return df.select(F.col(k), F.posexplode(T.gram_digests(T.words(F.col(text)), n)).alias(at, "g")).select(k, at, "g.h1", "g.h2")

    r = grams(refs, ref, "j")
    some = grams(docs, key, "i").join(r.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi")
    hits = some.join(r, ["h1", "h2"]).select(key, ref, "i", "j").distinct()
    w = Window.partitionBy(key, ref, F.col("i") - F.col("j")).orderBy("i")
    runs = hits.withColumn("island", F.col("i") - F.row_number().over(w)).groupBy(key, ref, (F.col("i") - F.col("j")).alias("diagonal"), "island").agg((F.count("*") + n - 1).alias("len"))
    return runs.groupBy(key, ref).agg(F.max("len").alias("longest"))


def distinct_ngrams(docs: DataFrame, by: list[str], text: str = "text", n: int = 3) -> DataFrame:
    """Distinct n-grams of each group, told apart by 128-bit digests."""
    grams = docs.select(*by, F.explode(T.gram_digests(T.words(F.col(text)), n)).alias("g"))
    return grams.select(*by, "g.h1", "g.h2").distinct().groupBy(*by).agg(F.count("*").alias("n_grams"))
