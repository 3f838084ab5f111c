"""Near-duplicates by a multi-index Hamming join over b-bit MinHash signatures.

A signature has 32 symbols of 16 bits. It is split into 8 chunks of 4 symbols; two signatures within
a distance of 15 symbols agree, by the pigeonhole principle, in all but at most one symbol of some
chunk. Every chunk is therefore indexed under its 4 keys that leave one symbol out: all pairs within
that distance meet under some key. At a similarity of 0.85 a pair is missed with a probability of
2e-8 (all 8 chunks would need two errors or more), at 0.8 of 1e-6. Pairs that meet and agree in at least
AGREE symbols are confirmed on full shingle sets, by
64-bit hashes.

No group of copies is expanded into pairs. Equal sets are one class. Each bucket first links its
members to one hub, the member that meets most others in all its buckets; what these links connect is not
compared again. Buckets that still hold several components go on: once more with hubs drawn by hash, then
in full. Buckets of up to BLOCK members are compared one by one, each pair under the smallest key that it
shares; larger ones that share members are compared together, so that a large group that meets under many keys
is compared once. What is compared together is dealt into blocks of bounded size, and each pair of blocks first
compares signatures and keeps the members that have a pair to confirm. Only these members' texts are fetched,
and the pair of blocks confirms on full sets and gives only links that join components. So every link between
different components is found, no pairs are written out, and no task gathers an unbounded group.

Texts are written once, in chunks (chunks.py); only texts that have to be compared leave them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from . import chunks as C
from . import kernels as K
from .common import bounded_batches, bucketed, components, mark, sweep, written

SYMBOLS, CHUNKS = 32, 8
WIDTH = SYMBOLS // CHUNKS
#: Symbols that a pair must share to be confirmed: one of similarity 0.8 has fewer with a probability of 3e-8.
AGREE = 12
SMALL_BUCKET, FEW = 32, 8
#: A block of a bucket holds about so many members, or so many bytes of text.
BLOCK, BLOCK_BYTES = 512, 4_000_000
_rng = np.random.default_rng(411)
_A = _rng.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64)


def signatures(h, bounds):
    """uint16 [texts, SYMBOLS] from sorted shingle hashes; texts without shingles get zeros."""
    n = len(bounds) - 1
    out = np.zeros((n, SYMBOLS), np.uint16)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        for k in range(SYMBOLS):
            low = np.minimum.reduceat(h * _A[k] + _B[k], bounds[full])
            out[full, k] = (K.mix(low) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def chunks(src: DataFrame, shingle: int, text: str) -> DataFrame:
    """A row for each chunk of src (id, the text, and columns that are carried along): its rows, and arrays with an
    entry for each row: its number, id, n_shingles, set_key (a 128-bit digest of the shingle set, null if it is empty) and sig."""

    def one(parts):
        name, first = C.name(), 0
        out = {x: [] for x in ("row", "id", "n_shingles", "set_key", "sig")}
        for p in parts:
            for at, to, data, off in K.slices(p, text):
                h, b = K.shingle_sets(data, off, shingle)
                sig, size = signatures(h, b), np.diff(b)
                x, y = (np.concatenate([[np.uint64(0)], np.cumsum(K.mix(h * _A[i]), dtype=np.uint64)]) for i in (0, 1))
                key = np.stack([x[b[1:]] - x[b[:-1]], y[b[1:]] - y[b[:-1]]], 1).astype(np.uint64)
                out["row"].append((K.mix(np.arange(first + at, first + to, dtype=np.uint64) + np.uint64(name)) >> np.uint64(1)).astype(np.int64))
                out["id"].append(K.column(p, "id").slice(at, to - at))
                out["n_shingles"].append(size.astype(np.int64))
                out["set_key"] += [key[i].tobytes() if size[i] else None for i in range(to - at)]
                out["sig"] += [sig[i].tobytes() for i in range(to - at)]
            first += len(p)
        cols = {"chunk": pa.array([name]), "rows": pa.array([C.stored(parts)], pa.binary()), "row": C.one_list(np.concatenate(out["row"])), "id": C.one_list(pa.concat_arrays(out["id"])), "n_shingles": C.one_list(np.concatenate(out["n_shingles"])), "set_key": C.one_list(out["set_key"], pa.binary()), "sig": C.one_list(out["sig"], pa.binary())}
        return pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    def run(batches):
        yield from map(one, C.gathered(batches))

    return src.mapInArrow(K.trimmed(run), "chunk bigint, rows binary, row array<bigint>, id array<bigint>, n_shingles array<bigint>, set_key array<binary>, sig array<binary>")


def fetched(wanted: DataFrame, text: str) -> DataFrame:
    """(id, n_bytes, text) of chunk rows with `places`, structs (at, id): texts under the ids that are asked for."""

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                v = K.column(batch, "places")[i].values
                at, ids = v.field("at").to_numpy(), v.field("id").to_numpy()
                order = np.argsort(at)
                at, ids = at[order], ids[order]
                for first, part in C.opened(K.column(batch, "rows")[i]):
                    lo, hi = np.searchsorted(at, (first, first + len(part)))
                    if hi > lo:
                        own = K.column(part, text).take(pa.array(at[lo:hi] - first))
                        yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi]), pc.binary_length(own).cast(pa.int64()), own], ["id", "n_bytes", "text"])

    return wanted.select("rows", "places").mapInArrow(K.trimmed(run), "id bigint, n_bytes bigint, text string")


def _keys(sig):
    """int64 [texts, SYMBOLS]: for each chunk its 4 keys with one symbol left out; 3 symbols of 16 bits, chunk and gap."""
    sig = sig.reshape(-1, CHUNKS, WIDTH).astype(np.int64)
    keys = np.empty(sig.shape, np.int64)
    for gap in range(WIDTH):
        k = np.zeros(sig.shape[:2], np.int64)
        for i in range(WIDTH):
            if i != gap:
                k = (k << 16) | sig[:, :, i]
        keys[:, :, gap] = (k << 5) | (np.arange(CHUNKS) * WIDTH + gap)
    return keys.reshape(-1, SYMBOLS)


def _sigs(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, SYMBOLS)


def index_keys(reps: DataFrame) -> DataFrame:
    """(key, id): the index entries of (id, sig)."""

    def run(batches):
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            keys = _keys(_sigs(K.column(batch, "sig")))
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(np.repeat(K.column(batch, "id").to_numpy(), SYMBOLS))], ["key", "id"])

    return reps.select("id", "sig").mapInArrow(K.trimmed(run), "key bigint, id bigint")


def confirmed(pairs: DataFrame, sigs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose shingle sets reach the similarity: 100 * intersection >= percent * union. Signatures go first."""

    def alike(batches):
        for batch in batches:
            if len(batch):
                same = (_sigs(K.column(batch, "sig_a")) == _sigs(K.column(batch, "sig_b"))).sum(1) >= AGREE
                yield pa.RecordBatch.from_arrays([K.column(batch, x).filter(pa.array(same)) for x in "ab"], ["a", "b"])

    def run(batches):
        for batch in batches:
            keep = []
            for at, to, data, off in K.slices(batch, "text_a"):
                h, b = K.shingle_sets(data, off, shingle)
                part = batch.slice(at, to - at)
                for at2, to2, data2, off2 in K.slices(part, "text_b"):
                    g, c = K.shingle_sets(data2, off2, shingle)
                    for i in range(to2 - at2):
                        x, y = h[b[at2 + i] : b[at2 + i + 1]], g[c[i] : c[i + 1]]
                        both = len(np.intersect1d(x, y, assume_unique=True))
                        keep.append(bool(len(x) and len(y)) and 100 * both >= percent * (len(x) + len(y) - both))
            mask = np.array(keep, bool)
            yield pa.RecordBatch.from_arrays([pa.array(K.column(batch, x).to_numpy()[mask]) for x in "ab"], ["a", "b"])

    sa, sb = (sigs.select(F.col("id").alias(x), F.col("sig").alias(f"sig_{x}")) for x in "ab")
    some = written(pairs.join(sa, "a").join(sb, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(K.trimmed(alike), "a bigint, b bigint"), "alike")
    a, b = (texts.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    return some.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(K.trimmed(run), "a bigint, b bigint")


def _near(key, sig, comp, side):
    """[n, n], upper half: members of different components and blocks that agree enough and, in a bucket (key >= 0), share no smaller key."""
    n = len(sig)
    same = np.zeros((n, n), np.uint8)
    for k in range(SYMBOLS):
        same += sig[:, None, k] == sig[None, :, k]
    near = (same >= AGREE) & (comp[:, None] != comp[None, :]) & ((side[:, None] != side[None, :]) | (side[:, None] == 2))
    near = np.triu(near, 1)
    if key < 0:
        return near
    i, j = np.nonzero(near)
    keys = _keys(sig)
    for at in range(0, len(i), 1 << 16):
        x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        least = np.where(keys[x] == keys[y], keys[x], np.iinfo(np.int64).max).min(1)
        near[x, y] = least == key
    return near


def _needed(groups: DataFrame) -> DataFrame:
    """(key, i, j, id, comp, side, sig): of the members (id, comp, side, sig) of pairs of blocks those that have a pair to confirm there."""

    def run(batches):
        for batch in batches:
            for key, i, j, row in zip(*(K.column(batch, x).to_pylist() for x in ("key", "i", "j")), K.column(batch, "members"), strict=True):
                m = row.values
                near = _near(key, _sigs(m.field("sig")), m.field("comp").to_numpy(), m.field("side").to_numpy())
                some = pa.array(np.flatnonzero(near.any(0) | near.any(1)))
                if len(some):
                    n = len(some)
                    yield pa.RecordBatch.from_arrays([pa.array([key] * n, pa.int64()), pa.array([i] * n, pa.int32()), pa.array([j] * n, pa.int32()), *(m.field(x).take(some) for x in ("id", "comp", "side", "sig"))], ["key", "i", "j", "id", "comp", "side", "sig"])

    return groups.mapInArrow(K.trimmed(run), "key bigint, i int, j int, id bigint, comp bigint, side int, sig binary")


def _links(key, members, shingle: int, percent: int) -> list[tuple[int, int]]:
    """Links that join different components among the members of one block pair: no more than there are members."""
    ids, comp, side = (members.field(x).to_numpy() for x in ("id", "comp", "side"))
    n = len(ids)
    near = _near(key, _sigs(members.field("sig")), comp, side)
    i, j = np.nonzero(near)
    if not len(i):
        return []
    used = np.unique(np.concatenate([i, j]))
    place = np.zeros(n, np.int64)
    place[used] = np.arange(len(used))
    raw = [t.encode("utf-8", "surrogatepass") for t in members.field("text").take(pa.array(used)).to_pylist()]
    h, b = K.shingle_sets(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64), shingle)
    i, j, size = place[i], place[j], np.diff(b)
    if len(i) <= 4 * len(used):
        both = np.array([len(np.intersect1d(h[b[x] : b[x + 1]], h[b[y] : b[y + 1]], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist(), strict=True)])
    else:
        _, code, count = np.unique(h, return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(used)), size)
        shared = count[code] > 1  # what only one member holds is in no intersection
        column = np.cumsum(count > 1) - 1
        code, owner = column[code[shared]], owner[shared]
        every = np.zeros((len(used), len(used)), np.float32)
        for at in range(0, int((count > 1).sum()), 4096):
            part = (code >= at) & (code < at + 4096)
            m = np.zeros((len(used), 4096), np.float32)
            m[owner[part], code[part] - at] = 1
            every += m @ m.T
        both = every[i, j].astype(np.int64)
    ok = 100 * both >= percent * (size[i] + size[j] - both)
    root = {int(c): int(c) for c in comp[used]}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, y in zip(used[i[ok]].tolist(), used[j[ok]].tolist(), strict=True):
        u, v = find(int(comp[x])), find(int(comp[y]))
        if u != v:
            root[max(u, v)] = min(u, v)
            out.append((int(ids[x]), int(ids[y])))
    return out


def _joining(groups: DataFrame, shingle: int, percent: int) -> DataFrame:
    """groups: rows (key, members), members of bounded number of (id, comp, side, sig, text); out: links (a, b)."""

    def run(batches):
        for batch in batches:
            found = [p for key, row in zip(K.column(batch, "key").to_pylist(), K.column(batch, "members"), strict=True) for p in _links(key, row.values, shingle, percent)]
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return groups.select("key", "members").mapInArrow(K.trimmed(run), "a bigint, b bigint")


def _linked(classes: DataFrame, texts_of, shingle: int, percent: int) -> DataFrame:
    """(id, component) of classes (id, sig): all that links connect; texts_of gives (id, text) for a table of ids."""
    keys = index_keys(classes)
    sizes = written(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    buckets = written(keys.join(sizes, "key"), "buckets")
    # the hub is the member that meets most rows over all its buckets: of a star of copies, its centre
    met = buckets.groupBy("id").agg(F.sum("n").alias("met"))
    hubs = written(buckets.join(met, "id").groupBy("key").agg(F.max(F.struct("met", (-F.col("id")).alias("no"))).alias("h")).select("key", (-F.col("h.no")).alias("hub"), F.col("h.met").alias("hub_met")), "hubs")
    sigs = classes.select("id", "sig")
    texts = written(texts_of(buckets.select("id").distinct()), "texts")

    # a row tries the hubs of its few-member buckets, and of the others the one that meets most
    meets = buckets.join(hubs, "key").where("id <> hub")
    few = meets.where(F.col("n") <= FEW).select(F.col("hub").alias("a"), F.col("id").alias("b"))
    one = meets.where(F.col("n") > FEW).groupBy("id").agg(F.max(F.struct("hub_met", (-F.col("hub")).alias("no"))).alias("h")).select((-F.col("h.no")).alias("a"), F.col("id").alias("b"))
    tried = few.union(one).distinct()
    edges = written(confirmed(tried, sigs, texts, shingle, percent), "links")
    comp = written(components(edges), "components")

    mixed = written(_mixed(buckets, comp, SMALL_BUCKET), "mixed")
    if not mixed.isEmpty():
        drawn = written(mixed.groupBy("key").agg(F.min_by("id", F.xxhash64("id", "key")).alias("drawn")), "drawn")
        again = mixed.join(drawn, "key").where("id <> drawn").groupBy("id").agg(F.min_by("drawn", F.xxhash64("drawn", "id")).alias("drawn"))
        more = again.select(F.least("id", "drawn").alias("a"), F.greatest("id", "drawn").alias("b")).distinct()
        edges = written(edges.union(confirmed(more, sigs, texts, shingle, percent)), "links")
        comp = written(components(edges), "components")

    rest = written(_mixed(buckets, comp, 2), "rest")
    if not rest.isEmpty():
        small, large = rest.where(F.col("n") <= BLOCK).select("key", "id", "comp"), rest.where(F.col("n") > BLOCK)
        head = written(large.groupBy("key").agg(F.min("id").alias("a")), "heads")
        canopy = written(components(large.join(head, "key").select("a", F.col("id").alias("b"))), "canopies") if not head.isEmpty() else head.select(F.col("a").alias("id"), F.col("a").alias("component"))
        joint = large.select("id", "comp").distinct().join(canopy, "id").select((-F.col("component") - 1).alias("key"), "id", "comp")
        groups_of = written(small.union(joint), "groups")
        sizes = written(groups_of.join(texts.select("id", "n_bytes"), "id").groupBy("key").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_bytes") / BLOCK_BYTES)).cast("int").alias("blocks")), "sizes")
        member = groups_of.join(sigs, "id").join(sizes, "key")
        dealt = member.withColumn("blk", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        side = F.when(F.col("blk") == F.col("other"), 2).when(F.col("blk") < F.col("other"), 0).otherwise(1)
        groups = dealt.groupBy("key", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j")).agg(F.collect_list(F.struct("id", "comp", side.alias("side"), "sig")).alias("members"))
        needed = written(_needed(groups), "needed")
        full = needed.join(texts.select("id", "text"), "id").groupBy("key", "i", "j").agg(F.collect_list(F.struct("id", "comp", "side", "sig", "text")).alias("members"))
        edges = written(edges.union(_joining(full, shingle, percent)), "links")
        comp = written(components(edges), "components")
    return comp


def compared(docs: DataFrame, keep: list[str], text: str, key: str, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(the chunks, a row for each row of docs): chunk, at, id, n_shingles, set_key, component_id, and whether it is its component's first row.

    Words are runs of bytes other than space and 9 to 13, with A-Z lower-cased; a set holds the
    distinct shingles of `shingle` words, or the whole sequence where there are fewer words. Texts
    that are null, empty or blank have empty sets and stand alone. Rows are linked if
    100 * intersection >= percent * union (percent at least 80). Each row is compared by its own text,
    also if its key is repeated or null. component_id is the smallest key reachable (null if
    there is none but null); the first row is one of that key.
    """
    if percent < 80:
        raise ValueError("the index is laid out for a similarity of 0.8 or more")
    spark = docs.sparkSession
    src, _, text = C.source(docs, keep, text, id=F.col(key).cast("bigint"))
    t = bucketed(chunks(src, shingle, text), "chunk", int(spark.conf.get("spark.sql.shuffle.partitions")), "texts")
    sk = t.select("chunk", F.posexplode(F.arrays_zip("row", "id", "n_shingles", "set_key", "sig")).alias("at", "x")).select("chunk", "at", "x.*")
    best = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    classes = sk.where("set_key is not null").groupBy("set_key").agg(F.min(F.struct("row", "chunk", "at")).alias("x"), F.any_value("sig").alias("sig"), F.min(best).alias("best"))
    classes = written(classes.select("set_key", F.col("x.row").alias("id"), "x.chunk", "x.at", "sig", "best"), "classes")

    def texts_of(ids):
        places = classes.join(ids, "id").groupBy("chunk").agg(F.collect_list(F.struct("at", "id")).alias("places"))
        return fetched(t.join(places.hint("shuffle_hash"), "chunk"), text)

    comp = _linked(classes, texts_of, shingle, percent)
    of_set = classes.join(comp, "id", "left").select("set_key", F.coalesce("component", "id").alias("c"), "best")
    lead = of_set.groupBy("c").agg(F.min("best").alias("lead"))
    verdict = written(of_set.join(lead, "c").select(F.col("set_key").alias("of"), "lead"), "verdict")
    out = sk.drop("sig").join(verdict, F.col("set_key") == F.col("of"), "left")
    alone = F.col("lead").isNull()
    return t, out.select("chunk", "at", "id", "n_shingles", "set_key", F.when(alone, F.col("id")).otherwise(F.col("lead.id")).alias("component_id"), (alone | (F.col("lead.row") == F.col("row"))).alias("first"))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3, percent: int = 85) -> DataFrame:
    """One row for each row of docs: its key, n_shingles, set_key, component_id and kept (its key is component_id). See compared()."""
    since = mark()
    with bounded_batches(docs.sparkSession):
        found = written(compared(docs, [], text, key, shingle, percent)[1], "found")
    sweep(since, found)
    return found.select(F.col("id").alias(key), "n_shingles", "set_key", "component_id", F.col("component_id").eqNullSafe(F.col("id")).alias("kept"))


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component: of its smallest key, whatever rows that key has. See compared()."""
    kind = S.StructType([S.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)])

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                v = K.column(batch, "gone")[i]
                gone = v.values.to_numpy() if v.is_valid else np.zeros(0, np.int32)
                for first, part in C.opened(K.column(batch, "rows")[i]):
                    stay = np.ones(len(part), bool)
                    stay[gone[(gone >= first) & (gone < first + len(part))] - first] = False
                    yield pa.RecordBatch.from_arrays([K.column(part, f.name).filter(pa.array(stay)) for f in kind.fields], kind.names)

    since = mark()
    with bounded_batches(docs.sparkSession):
        t, found = compared(docs, docs.columns, text, key, shingle, percent)
        gone = found.where("not first").groupBy("chunk").agg(F.collect_list("at").alias("gone"))
        out = written(t.select("chunk", "rows").join(gone.hint("shuffle_hash"), "chunk", "left").select("rows", "gone").mapInArrow(K.trimmed(run), kind), "stay")
    sweep(since, out)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def _mixed(buckets: DataFrame, comp: DataFrame, above: int) -> DataFrame:
    """(key, id, n, comp): members of buckets of more than `above` that still hold several components."""
    b = buckets.where(f"n > {above}").join(comp, "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("comp"))
    several = b.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key")
    return b.join(several, "key")


def op4(docs: DataFrame) -> DataFrame:
    """The contract: 3-word shingles, a similarity of 0.85. Null texts have no shingles and stand alone; for nulls and repeated keys see compared()."""
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")


def oracle(shingle: int = 3, percent: int = 85) -> str:
    """DuckDB SQL for op4: shingles themselves, every pair that shares one, and what the links reach."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
i AS (SELECT doc_id, unnest(range(1, greatest(len(w) - {shingle - 1}, 1) + 1)) AS i, w FROM w WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + {shingle - 1}], ' ') AS s FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= {percent} * (a.n + b.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT x AS doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(y) AS component_id, min(y) = x AS kept FROM r LEFT JOIN n ON n.doc_id = x GROUP BY x, n.n
"""
