"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text.

Symbols are bytes, the order is 5, and n-grams are packed into 64-bit integers, so keys are exact and
tables grow with the text. The corpus is cut into chunks of bounded size (chunks.py). A chunk
is one row: its rows as compressed Arrow data, and its distinct n-grams and contexts of every order,
pre-aggregated. Chunks are written once, in buckets by chunk, so that texts are never shuffled:

1. The labels meet the (chunk, place, key) of every row and give each chunk its trusted places.
2. Trusted texts that are not held out are counted; counts are sharded by n-gram, summed, and joined on
   contexts and suffixes to give the smoothed probabilities.
3. Sharded count join: each chunk asks every shard once for its distinct n-grams; a shard answers with
   probabilities and context weights; answers go back to the chunk, which scores its texts.

A document is rejected if its perplexity is above its language's limit: a quantile of the trusted
documents that were held out. A short text's perplexity says little, so PRIOR bytes at the language's
own rate are added to each text before it is compared, at every length alike.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from . import chunks as C
from . import kernels as K
from .common import bounded_batches, bucketed, mark, sweep, written

ORDER, START = 5, 0
#: Of the held-out trusted documents of a language: the quantile that is the limit.
QUANTILE = 0.98
#: Bytes at the language's mean rate that every text is mixed with before it is compared.
PRIOR = 1000
#: One trusted text of so many, by a hash of the text, is held out from the counts and sets the limits.
HELD = 4
#: Entries of one shard of the model, and bytes of asks that one group of a shard holds, at most about.
SHARD_ROWS, SHARD_BYTES = 500_000, 64 << 20
_BINS = 2000
_TAG = 8 * ORDER
_PRIME = 998_244_353


def _codes(data, off):
    """The n-gram of order ORDER that ends at each byte; before a text's first byte stand START bytes."""
    s = data.astype(np.int64)
    code = s.copy()
    at = np.arange(len(data)) - np.repeat(off[:-1], np.diff(off))
    for k in range(1, ORDER):
        prev = np.full(len(data), START, np.int64)
        prev[k:] = s[:-k]
        prev[at < k] = START
        code |= prev << (8 * k)
    return code


def _held(data, off):
    """Whether each text is held out: by a hash of the whole text, so equal texts fall alike."""
    return K.run_hash(K.byte_prefix(data), off[:-1], off[1:]) % np.uint64(HELD) == 0


def _keys(grams):
    """Sorted keys of all that a probability may need: every order's n-grams and contexts, order and n-gram in one."""
    out, g, c = [], grams, grams >> 8
    for k in range(ORDER, 0, -1):
        g = np.unique(g & ((1 << 8 * k) - 1))
        c = np.unique(c & ((1 << 8 * (k - 1)) - 1))
        out += [g | (k << _TAG), c | ((k - 1) << _TAG)]
    return np.unique(np.concatenate(out))


def chunks(src: DataFrame, text: str = "text") -> DataFrame:
    """(chunk, ids, rows, n_keys, keys) of rows with an id and a text: see the module's description."""

    def one(parts):
        grams = [np.zeros(0, np.int64)]
        for b in parts:
            for _, _, data, off in K.slices(b, text):
                grams.append(pc.unique(pa.array(_codes(data, off))).to_numpy())
        keys = _keys(np.unique(np.concatenate(grams)))
        ids = pa.concat_arrays([K.column(b, "id") for b in parts])
        return pa.RecordBatch.from_arrays([pa.array([C.name()]), C.one_list(ids), pa.array([C.stored(parts)], pa.binary()), pa.array([len(keys)]), pa.array([C.pack(np.diff(keys, prepend=0))], pa.binary())], ["chunk", "ids", "rows", "n_keys", "keys"])

    def run(batches):
        yield from map(one, C.gathered(batches, 2 * C.CHUNK_BYTES))

    return src.mapInArrow(K.trimmed(run), "chunk bigint, ids array<bigint>, rows binary, n_keys bigint, keys binary")


def gram_counts(marked: DataFrame, every: bool = False, text: str = "text") -> DataFrame:
    """(g, n): counts of all n-grams of order ORDER in trusted texts that are not held out; of all texts if `every`."""

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                g, n = [], []
                places = None if every else np.array(K.column(batch, "places")[i].as_py() or [], np.int64)
                for first, b in C.opened(K.column(batch, "rows")[i]):
                    mine = b if every else b.take(pa.array(places[(places >= first) & (places < first + len(b))] - first))
                    for _, _, data, off in K.slices(mine, text):
                        c = _codes(data, off)
                        seen = pc.value_counts(pa.array(c if every else c[np.repeat(~_held(data, off), np.diff(off))]))
                        g.append(seen.field("values").to_numpy())
                        n.append(seen.field("counts").to_numpy())
                if g:
                    u, inv = np.unique(np.concatenate(g), return_inverse=True)
                    total = np.bincount(inv, np.concatenate(n)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(total)], ["g", "n"])

    return marked.select("rows", *([] if every else ["places"])).mapInArrow(K.trimmed(run), "g bigint, n bigint").groupBy("g").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> list[float]:
    """The discounts of counts 1, 2 and 3 or more, by counts of counts.

    Where there is no n-gram of a count of 1, 2 or 3, the formulas are undefined; then 0.5, 1 and 1.5 are taken.
    """
    n = counts.agg(*[F.count_if(F.col("n") == i) for i in (1, 2, 3, 4)]).first()
    if min(n[:3]) == 0:
        return [0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(float(i), max(0.05, i - (i + 1) * y * n[i] / n[i - 1])) for i in (1, 2, 3)]


def model(counts: DataFrame) -> DataFrame:
    """(key, p, weight): of every seen n-gram its interpolated probability, of every context the weight of the order below."""
    tables = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        tables[k] = written(tables[k + 1].groupBy(F.col("g").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("g")).agg(F.count("*").alias("n")), f"types{k}")
    out, low = None, None
    for k in range(1, ORDER + 1):
        d1, d2, d3 = _discounts(tables[k])
        t = tables[k].withColumn("d", F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)).withColumn("ctx", F.shiftright("g", 8))
        ctx = t.groupBy("ctx").agg(F.sum("n").cast("double").alias("total"), F.sum("d").alias("cut"))
        t = t.join(ctx, "ctx").withColumn("own", (F.col("n") - F.col("d")) / F.col("total")).withColumn("rest", F.col("cut") / F.col("total"))
        if low is None:
            t = t.withColumn("q", F.lit(1 / 256))
        else:
            below = low.select(F.col("g").alias("suffix"), F.col("p").alias("q"))
            t = t.withColumn("suffix", F.col("g").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1))).join(below, "suffix")
        low = written(t.select("g", "ctx", (F.col("own") + F.col("rest") * F.col("q")).alias("p"), "rest"), f"order{k}")
        tag = lambda c, j: F.col(c).bitwiseOR(F.lit(j << _TAG)).alias("key")
        none = F.lit(None).cast("double")
        part = low.select(tag("g", k), "p", none.alias("weight")).union(low.select(tag("ctx", k - 1), none.alias("p"), F.col("rest").alias("weight")))
        out = part if out is None else out.union(part)
    return out.groupBy("key").agg(F.max("p").alias("p"), F.max("weight").alias("weight"))


def _shard(keys, shards):
    return keys % _PRIME % shards


def answers(cut: DataFrame, fitted: DataFrame, partitions: int) -> DataFrame:
    """(chunk, shard, p, weight): the sharded join. p is 0 and weight 1 for keys that the model lacks; float32, in the keys' order."""
    n_keys = cut.agg(F.sum("n_keys")).first()[0] or 0
    shards = max(partitions, math.ceil(fitted.count() / SHARD_ROWS))
    salts = max(1, math.ceil(n_keys * 8 / shards / SHARD_BYTES))

    def asks(batches):
        for batch in batches:
            for chunk, n, raw in zip(K.column(batch, "chunk").to_pylist(), K.column(batch, "n_keys").to_pylist(), K.column(batch, "keys"), strict=True):
                keys = np.cumsum(C.unpack(raw.as_buffer(), np.int64, n))
                shard = _shard(keys, shards)
                order = np.argsort(shard, kind="stable")
                bound = np.searchsorted(shard[order], np.arange(shards + 1))
                some = [(s, keys[order[bound[s] : bound[s + 1]]]) for s in np.flatnonzero(np.diff(bound)).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in some], pa.int32()), pa.array([chunk % salts] * len(some), pa.int32()), pa.array([chunk] * len(some), pa.int64()), pa.array([len(k) for _, k in some], pa.int32()), pa.array([C.pack(np.diff(k, prepend=0)) for _, k in some], pa.binary())], ["shard", "salt", "chunk", "n", "keys"])

    def answer(asked, known):
        order = np.argsort(known.column("key").to_numpy())
        key = known.column("key").to_numpy()[order]
        p = known.column("p").to_numpy(zero_copy_only=False)[order]
        weight = known.column("weight").to_numpy(zero_copy_only=False)[order]
        ps, ws = [], []
        for n, raw in zip(asked.column("n").to_pylist(), asked.column("keys"), strict=True):
            k = np.cumsum(C.unpack(raw.as_buffer(), np.int64, n))
            i = np.minimum(np.searchsorted(key, k), max(len(key) - 1, 0))
            hit = key[i] == k if len(key) else np.zeros(n, bool)
            for got, values, lacking in ((ps, p, 0), (ws, weight, 1)):
                v = np.where(hit, values[i] if len(key) else 0, np.nan)
                got.append(C.pack(np.where(np.isnan(v), lacking, v).astype(np.float32)))
        return pa.table({"chunk": asked.column("chunk").cast(pa.int64()), "shard": asked.column("shard").cast(pa.int32()), "p": pa.array(ps, pa.binary()), "weight": pa.array(ws, pa.binary())})

    asked = cut.select("chunk", "n_keys", "keys").mapInArrow(K.trimmed(asks), "shard int, salt int, chunk bigint, n int, keys binary")
    known = fitted.select(F.pmod(F.col("key") % _PRIME, F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "key", "p", "weight")
    back = asked.groupBy("shard", "salt").cogroup(known.groupBy("shard", "salt")).applyInArrow(answer, "chunk bigint, shard int, p binary, weight binary")
    return back.where("chunk is not null").groupBy("chunk").agg(F.collect_list(F.struct("shard", "p", "weight")).alias("found"), F.lit(shards).alias("shards"))


def _log2p(grams, keys, p, weight):
    """Interpolated log2-probabilities of n-grams of the full order, by the longest suffix that was seen."""
    value = np.full(len(grams), 1 / 256)
    for k in range(1, ORDER + 1):
        mine = np.searchsorted(keys, (grams & ((1 << 8 * k) - 1)) | (k << _TAG))
        ctx = np.searchsorted(keys, ((grams >> 8) & ((1 << 8 * (k - 1)) - 1)) | ((k - 1) << _TAG))
        value = np.where(p[mine] > 0, p[mine], value * weight[ctx])
    return np.log2(value)


def scores(marked: DataFrame, keep: list[S.StructField], text: str = "text") -> DataFrame:
    """The columns `keep` of every row, and n_bytes, bits (of the whole text, added up), trusted and held."""

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                n = K.column(batch, "n_keys")[i].as_py()
                keys = np.cumsum(C.unpack(K.column(batch, "keys")[i].as_buffer(), np.int64, n))
                shard = _shard(keys, K.column(batch, "shards")[i].as_py() or 1)
                p, weight = np.zeros(n), np.ones(n)
                order = np.argsort(shard, kind="stable")
                for part in K.column(batch, "found")[i].values or ():
                    s = part["shard"].as_py()
                    at = order[np.searchsorted(shard[order], s) : np.searchsorted(shard[order], s, "right")]
                    p[at], weight[at] = (C.unpack(part[x].as_buffer(), np.float32, len(at)) for x in ("p", "weight"))
                places = np.array(K.column(batch, "places")[i].as_py() or [], np.int64)
                for first, b in C.opened(K.column(batch, "rows")[i]):
                    bits, size, held = np.zeros(len(b)), np.zeros(len(b), np.int64), np.zeros(len(b), bool)
                    for at, to, data, off in K.slices(b, text):
                        if len(data):
                            d = pa.array(_codes(data, off)).dictionary_encode()
                            lp = _log2p(d.dictionary.to_numpy(), keys, p, weight)[d.indices.to_numpy()]
                            total = np.concatenate([[0.0], np.cumsum(lp)])
                            bits[at:to] = total[off[:-1]] - total[off[1:]]
                        size[at:to] = np.diff(off)
                        held[at:to] = _held(data, off)
                    good = np.zeros(len(b), bool)
                    good[places[(places >= first) & (places < first + len(b))] - first] = True
                    yield pa.RecordBatch.from_arrays([*(K.column(b, f.name) for f in keep), pa.array(size), pa.array(bits), pa.array(good), pa.array(held)], [*(f.name for f in keep), "n_bytes", "bits", "trusted", "held"])

    kind = S.StructType([*keep, S.StructField("n_bytes", S.LongType()), S.StructField("bits", S.DoubleType()), S.StructField("trusted", S.BooleanType()), S.StructField("held", S.BooleanType())])
    return marked.select("rows", "n_keys", "keys", "found", "shards", "places").mapInArrow(K.trimmed(run), kind)


def limits(held: DataFrame, quantile: float) -> DataFrame:
    """(lang, rate, limit): for each language, and for null as all of them: mean bits a byte, and the quantile of mixed rates.

    held: (lang, n_bytes, bits) of held-out trusted texts. The quantile comes from a histogram of all of them.
    """
    both = held.where("n_bytes > 0").select(F.explode(F.array_distinct(F.array(F.col("lang"), F.lit(None).cast("string")))).alias("lang"), "n_bytes", "bits")
    sums = both.groupBy(F.col("lang").alias("of")).agg((F.sum("bits") / F.sum("n_bytes")).alias("rate"))
    own = both.join(sums, F.col("lang").eqNullSafe(F.col("of"))).select("lang", "rate", F.floor((F.col("bits") + PRIOR * F.col("rate")) / (F.col("n_bytes") + PRIOR) * _BINS).alias("bin"))
    bins = own.groupBy("lang", "rate", "bin").agg(F.count("*").alias("n"))
    w = Window.partitionBy("lang")
    cum = bins.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("total", F.sum("n").over(w))
    return cum.where(F.col("upto") >= F.col("total") * quantile).groupBy("lang", "rate").agg(((F.min("bin") + 1) / _BINS).alias("limit"))


def judged(docs: DataFrame, labels: DataFrame, keep: list[str], text: str = "text", key: str = "doc_id", lang: str = "lang", quantile: float = QUANTILE) -> DataFrame:
    """A row for each row of docs: its columns `keep` as c0, c1, ..., and n_bytes, rate, mixed, limit (in bits a byte) and kept.

    Trusted are the documents that labels (doc_id, quality, toxic) give a quality of 1 and no
    toxicity; if there are none, all documents are. A language without held-out trusted documents,
    or a null one, takes the rate and limit of all languages; if there is none at all, nothing is
    rejected. Null and empty texts have a null rate and are kept: they are left to the rules. Rows of
    equal keys are judged each by its own text, and all of them are trusted if their key is; rows
    with a null key can't be trusted but are judged. NUL bytes count as what stands before a text.
    """
    spark = docs.sparkSession
    src, inner, text = C.source(docs, keep, text, id=F.expr(f"try_cast(`{key}` as bigint)"), lang=F.col(lang).cast("string"))
    partitions, since = int(spark.conf.get("spark.sql.shuffle.partitions")), mark()
    with bounded_batches(spark):
        cut = bucketed(chunks(src, text), "chunk", partitions, "chunks")
        good = labels.where("quality = 1 and coalesce(toxic, 0) = 0").select(F.col("doc_id").cast("long").alias("id")).distinct()
        at = cut.select("chunk", F.posexplode("ids").alias("place", "id")).join(good, "id").groupBy("chunk").agg(F.collect_list("place").alias("places"))
        places = written(at, "places")
        counts = written(gram_counts(cut.join(places.hint("shuffle_hash"), "chunk"), text=text), "grams")
        alone = counts.isEmpty()
        if alone:
            counts = written(gram_counts(cut, True, text), "grams")
        fitted = written(model(counts), "model")
        found = answers(cut, fitted, partitions)
        marked = cut.join(found.hint("shuffle_hash"), "chunk", "left").join(places.hint("shuffle_hash"), "chunk", "left")
        scored = written(scores(marked, [*inner, S.StructField("lang", S.StringType())], text), "scores")
    held = scored.select("lang", "n_bytes", "bits") if alone else scored.where("trusted and held").select("lang", "n_bytes", "bits")
    lim = written(limits(held, quantile), "limits")
    sweep(since, scored, lim)
    every = lim.where("lang is null").first()
    rate, limit = (F.coalesce(c, F.lit(every[c] if every else None).cast("double")) for c in ("rate", "limit"))
    out = scored.join(lim.where("lang is not null"), "lang", "left")
    own = F.when(F.col("n_bytes") > 0, F.col("bits") / F.col("n_bytes"))
    mixed = F.when(F.col("n_bytes") > 0, (F.col("bits") + PRIOR * rate) / (F.col("n_bytes") + PRIOR))
    return out.select(*[f.name for f in inner], "n_bytes", own.alias("own"), mixed.alias("mixed"), limit.alias("limit"), F.coalesce(mixed <= limit, F.lit(True)).alias("kept"))


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang", quantile: float = QUANTILE) -> DataFrame:
    """One row for each document: key, lang, n_bytes, perplexity (a byte, of the text alone), judged (mixed with PRIOR bytes), limit, kept.

    See judged() for trusted documents, nulls, empty texts and repeated keys. Other columns are left behind.
    """
    two = F.lit(2.0)
    j = judged(docs, labels, [key, lang], text, key, lang, quantile)
    return j.select(F.col("c0").alias(key), F.col("c1").alias(lang), "n_bytes", F.pow(two, "own").alias("perplexity"), F.pow(two, "mixed").alias("judged"), F.pow(two, "limit").alias("limit"), "kept")


def screened(docs: DataFrame, labels: DataFrame, **names) -> DataFrame:
    """The rows of docs that are kept, with all their columns: each row by its own text, whatever its key."""
    j = judged(docs, labels, docs.columns, **names).where("kept")
    return j.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op2(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """classify by its defaults: a row for each document; null and empty texts are kept, with a null perplexity."""
    return classify(docs, labels)
