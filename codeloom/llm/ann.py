"""Approximate nearest neighbours by largest inner product, with an adaptive dimension scan.

Vectors are dealt to lists by their nearest centroid; a list is stored in chunks of bounded size,
each with its rotated vectors in column blocks. A scan adds up squared distances block by block:
after d of D dimensions, P * D / d estimates the full squared distance (the rotation is random), and
a candidate is abandoned once the estimate exceeds (1 + EPS / sqrt(d))**2 times the distance that
its norm and the query's current threshold allow. What survives is scored exactly, in double
precision, on the original vectors. A first pass over each query's nearest lists fixes its
threshold; the second pass probes its other lists against it. Rotation, centroids and the number of
lists to probe are fitted on a bounded sample; every row is indexed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import small_batches, written

#: The index is fitted on so many vectors, those of smallest hash: 20,000, or as many as its lists ask for, 200,000 at most.
SAMPLE, MOST, EACH = 20_000, 200_000, 16
CHUNK, QUERIES, COLUMNS, EPS, FIRST = 1024, 256, 16, 2.1, 4
#: Probes are set so that this share of the sample's own neighbours is in the probed lists, and that this share of its queries finds nine in ten of its own.
TARGET = 0.98


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v): rows with a key and a vector that is not zero and has only finite components."""
    v = F.col(vector).cast("array<double>")
    fine = "id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"
    return vectors.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(fine)


def n_lists(total: int) -> int:
    """Lists for so many vectors: half of the square root, as far as the largest sample gives each list EACH vectors."""
    return max(1, min(int(total**0.5 / 2), MOST // EACH))


def fit(sample: np.ndarray, total: int, k: int, seed: int = 7):
    """(rotation, centroids, probes) from a sample of the vectors."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    x = sample @ rotation
    lists = int(min(n_lists(total), len(np.unique(x, axis=0))))
    centroids = x[rng.choice(len(x), lists, replace=False)]
    for _ in range(12):
        near = nearest(x, centroids)
        for c in range(lists):
            own = x[near == c]
            centroids[c] = own.mean(0) if len(own) else x[rng.integers(len(x))]
    near = nearest(x, centroids)
    q = rng.choice(len(x), min(300, len(x)), replace=False)
    ip = x[q] @ x.T
    ip[np.arange(len(q)), q] = -np.inf
    best = np.argsort(-ip, axis=1)[:, : min(k, len(x) - 1)]
    rank = np.argsort(np.argsort(-order_of(x[q], centroids), axis=1), axis=1)
    probes = 0
    if best.size:
        at = np.sort(np.take_along_axis(rank, near[best], axis=1), axis=1)
        every = np.sort(at.reshape(-1))
        own = np.sort(at[:, int(np.ceil(0.9 * at.shape[1])) - 1])
        probes = 1 + max(int(v[min(len(v) - 1, int(np.ceil(TARGET * len(v))))]) for v in (every, own))
    return rotation, centroids, min(lists, max(1, probes) + max(1, lists // 50))


def _steps(n: int, lists: int):
    """Slices of n rows so small that a row of each list's numbers fits."""
    step = max(1, 4_000_000 // max(1, lists))
    return [slice(i, i + step) for i in range(0, n, step)]


def nearest(x, centroids):
    return np.concatenate([np.argmin((centroids**2).sum(1) - 2 * x[i] @ centroids.T, axis=1) for i in _steps(len(x), len(centroids))]) if len(x) else np.zeros(0, np.int64)


def order_of(q, centroids):
    """How promising each list is for each query: the inner product with its centroid."""
    return q @ centroids.T


def _matrix(col, dim):
    flat = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _index(rows: DataFrame, model, dim: int) -> DataFrame:
    """(list, part, ids, rot, orig): chunks of about CHUNK vectors; a list of any length is many chunks."""

    def assign(batches):
        rotation, centroids, _ = model.value
        for batch in batches:
            near = nearest(_matrix(K.column(batch, "v"), dim) @ rotation, centroids)
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), K.column(batch, "id"), K.column(batch, "v")], ["list", "id", "v"])

    def blocks(batches):
        rotation = model.value[0]
        for batch in batches:
            ids, rots, origs = [], [], []
            for members in K.column(batch, "members"):
                m = members.values
                i = m.field("id").to_numpy()
                o = np.argsort(i, kind="stable")
                v = m.field("v").flatten().to_numpy().reshape(-1, dim)[o]
                r = (v @ rotation).astype(np.float32)
                ids.append(i[o].tobytes())
                rots.append(b"".join(np.ascontiguousarray(r[:, c : c + COLUMNS]).tobytes() for c in range(0, dim, COLUMNS)))
                origs.append(v.tobytes())
            yield pa.RecordBatch.from_arrays([K.column(batch, "list"), K.column(batch, "part"), *(pa.array(x, pa.binary()) for x in (ids, rots, origs))], ["list", "part", "ids", "rot", "orig"])

    dealt = written(rows.mapInArrow(assign, "list int, id bigint, v array<double>"), "assigned")
    sizes = written(dealt.groupBy("list").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("parts")), "sizes")
    salted = dealt.join(sizes, "list")
    groups = salted.groupBy("list", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part")).agg(F.collect_list(F.struct("id", "v")).alias("members"))
    return groups.select("list", F.col("part").cast("int").alias("part"), "members").mapInArrow(blocks, "list int, part int, ids binary, rot binary, orig binary")


def scan_chunk(qid, q, floor, ids, rot, orig, rotation, k):
    """The k best of one chunk for each query, of those at or above its floor: (query row, id, score)."""
    n, dim = orig.shape
    qr = (q @ rotation).astype(np.float32)
    qn, vn = (q**2).sum(1), (orig**2).sum(1)
    cols, at = [], 0
    for c in range(0, dim, COLUMNS):
        w = min(COLUMNS, dim - c)
        cols.append((c, w, rot[at : at + n * w].reshape(n, w)))
        at += n * w
    slack = 1e-5 * (np.sqrt(qn).max(initial=0) * np.sqrt(vn).max(initial=0) + 1e-30)
    out = []
    floor = floor.copy()
    step = 256
    for b in range(0, n, step):
        own = ids[b : b + step]
        allowed = qn[:, None] + vn[None, b : b + step] - 2 * (floor[:, None] - slack)
        c, w, block = cols[0]
        vb, qb = block[b : b + step], qr[:, :w]
        part = (qb**2).sum(1)[:, None] + (vb**2).sum(1)[None] - 2 * qb @ vb.T
        live = (own[None] != qid[:, None]) & (allowed >= 0)
        limit = lambda d: (1 + EPS / np.sqrt(d)) ** 2 * d / dim
        live &= part <= np.where(np.isinf(allowed), np.inf, allowed) * (limit(w) if w < dim else 1) + slack
        i, j = np.nonzero(live)
        p, d = part[i, j], w
        for c, w, block in cols[1:]:
            if not len(i):
                break
            p = p + ((qr[i, c : c + w] - block[b + j]) ** 2).sum(1)
            d += w
            keep = p <= allowed[i, j] * (limit(d) if d < dim else 1) + slack
            i, j, p = i[keep], j[keep], p[keep]
        if len(i):
            s = np.einsum("ij,ij->i", q[i], orig[b + j])
            ok = s >= floor[i]
            out.append((i[ok], own[j[ok]], s[ok]))
            allq, _, alls = map(np.concatenate, zip(*out, strict=True))
            o = np.lexsort((-alls, allq))
            allq, alls = allq[o], alls[o]
            place = np.arange(len(allq)) - np.searchsorted(allq, allq)
            kth = place == k - 1
            floor[allq[kth]] = np.maximum(floor[allq[kth]], alls[kth])
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    i, v, s = map(np.concatenate, zip(*out, strict=True))
    o = np.lexsort((v, -s, i))
    i, v, s = i[o], v[o], s[o]
    top = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[top], v[top], s[top]


def _scan(chunks: DataFrame, probes: DataFrame, model, dim: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): probes (list, query_id, q, floor), in blocks, against the chunks of their lists."""

    def run(batches):
        rotation = model.value[0]
        for batch in batches:
            for r in range(len(batch)):
                m = K.column(batch, "members")[r].values
                qid = m.field("query_id").to_numpy()
                q = m.field("q").flatten().to_numpy().reshape(-1, dim)
                ids = np.frombuffer(K.column(batch, "ids")[r].as_buffer(), np.int64)
                rot = np.frombuffer(K.column(batch, "rot")[r].as_buffer(), np.float32)
                orig = np.frombuffer(K.column(batch, "orig")[r].as_buffer(), np.float64).reshape(-1, dim)
                i, v, s = scan_chunk(qid, q, m.field("floor").to_numpy(), ids, rot, orig, rotation, k)
                yield pa.RecordBatch.from_arrays([pa.array(qid[i]), pa.array(v), pa.array(s)], ["query_id", "vec_id", "score"])

    sizes = probes.groupBy("list").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts"))
    parts = chunks.groupBy("list").agg(F.max("part").alias("last"))
    blocks = probes.join(sizes, "list").groupBy("list", F.pmod(F.xxhash64("query_id"), F.col("parts")).alias("block")).agg(F.collect_list(F.struct("query_id", "q", "floor")).alias("members"))
    every = blocks.join(parts, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("part"), "members")  # a key holds one chunk, however long its list
    return chunks.join(every, ["list", "part"]).select("members", "ids", "rot", "orig").mapInArrow(run, "query_id bigint, vec_id bigint, score double")


def _top(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank from 1, vec_id, score): for each query its k nearest by inner product.

    A query's own row (its key) is no candidate of its own. Vectors that are null, zero or hold null
    or non-finite components take no part, nor do null keys and vectors of another length than most
    of the sample's (they have no inner product with the others). Ties go to the smaller key; rows of equal
    keys count once for a query, with their best score, and once as a query, with the smallest of their vectors. Empty tables give no rows. Other columns are left behind.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = usable(vectors, key, vector)
    total = rows.count()
    got = rows.orderBy(F.xxhash64("id"), "id").limit(min(MOST, max(SAMPLE, EACH * n_lists(total)))).toArrow()
    if not len(got):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lengths = [len(x) for x in got["v"]]
    dim = max(set(lengths), key=lengths.count)
    rows = rows.where(F.size("v") == dim)
    sample = np.array([x for x in got["v"].to_pylist() if len(x) == dim])
    model = spark.sparkContext.broadcast(fit(sample, total, k))
    chunks = written(_index(rows, model, dim), "chunks")

    def probe(batches):
        rotation, centroids, n = model.value
        for batch in batches:
            q = _matrix(K.column(batch, "v"), dim)
            order = [row for i in _steps(len(q), len(centroids)) for row in np.argsort(-order_of(q[i] @ rotation, centroids), axis=1, kind="stable")[:, :n].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([K.column(batch, "id"), K.column(batch, "v"), pa.array(order, pa.list_(pa.int32()))], ["query_id", "q", "lists"])

    asked = usable(queries, key, vector).where(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v"))
    asked = written(asked.mapInArrow(probe, "query_id bigint, q array<double>, lists array<int>"), "probes")
    first = asked.select(F.explode(F.slice("lists", 1, FIRST)).alias("list"), "query_id", "q", F.lit(float("-inf")).alias("floor"))
    one = written(_top(_scan(chunks, first, model, dim, k), k), "first")
    floors = one.groupBy("query_id").agg(F.max(F.when(F.col("rank") == k, F.col("score"))).alias("floor"))
    rest = asked.where(F.size("lists") > FIRST).join(floors, "query_id", "left").select(F.explode(F.slice("lists", FIRST + 1, 1 << 20)).alias("list"), "query_id", "q", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    two = _scan(chunks, rest, model, dim, k)
    return _top(one.select("query_id", "vec_id", "score").union(two), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5(vectors: DataFrame) -> DataFrame:
    """The contract: rows whose vec_id is divisible by 20 ask for their 20 nearest. See neighbours() for nulls and repeated keys."""
    return neighbours(vectors, vectors.where("vec_id % 20 = 0"))
