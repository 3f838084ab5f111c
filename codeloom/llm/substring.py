"""Substring deduplication by seed and extend over winnowed anchors.

Seeds: of the 13 consecutive 8-word grams in every 20-word window the one of smallest hash (the
first, of equals) is its anchor, so equal windows have equal anchors at equal places; about a
seventh of all positions are anchors. Anchors are found once and joined on their hash; only those
that two different texts hold, or one text twice, are seeds. Extension: each seed grows both ways, to
every full window of the threshold length that it anchors, all occurrences at once and one row for
each, never in pairs; a window that begins earlier elsewhere is a match, and matches that touch, from
seed to seed, join to the maximal repeat, of which every part has its window. Windows are
compared by 96-bit hashes.

Texts are written once, in chunks (chunks.py), and never shuffled: seeds, copies and matches travel to
the chunks. Every row is a document of its own; rows of one key come in the order of their texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from . import chunks as C
from . import kernels as K
from .common import bounded_batches, bucketed, mark, sweep, written

GRAM = 8
#: The order of documents: key (null: last), then for repeated and null keys a hash of the text and the row's own number.
ORDER = ["id", "tie", "row"]
_LAST = (1 << 63) - 1


def _lowest(h, at, text, length):
    """For each window of `length` words: the word index of its anchor; and the windows' start words."""
    span = length - GRAM + 1
    n = len(h) - span + 1
    if n <= 0:
        e = np.zeros(0, np.int64)
        return e, e
    ok = text[span - 1 :] == text[:n]
    start = np.flatnonzero(ok)
    best, which = h[:n].copy(), np.zeros(n, np.int64)
    for k in range(1, span):
        less = h[k : k + n] < best
        best[less] = h[k : k + n][less]
        which[less] = k
    return at[start + which[start]], at[start]


def _anchors(data, off, length):
    """(words, bounds, seed hash, text, start): the anchors of all windows of a slice, each position once."""
    w, s, e, b = K.word_hashes(data, off)
    h, start, text = K.gram_hashes(w, b, GRAM)
    a = np.unique(_lowest(h, start, text, length)[0])
    return w, s, e, b, h[np.searchsorted(start, a)], np.searchsorted(b, a, "right") - 1, a


def chunks(src: DataFrame, length: int, text: str) -> DataFrame:
    """A row for each chunk of src (id, again, the text, and columns that are carried along).

    rows are the chunk's rows; then come arrays with an entry for each row (id, tie, row, n_words, sha
    of the words joined by single spaces, own: the text has an anchor twice) and for each anchor (hash, at:
    the row in the chunk, pos in words, whole: a hash of the text's sequence of words, twice).
    """

    def one(parts):
        docs = {x: [] for x in (*ORDER, "n_words", "sha", "own")}
        found = {x: [] for x in ("hash", "at", "pos", "whole", "twice")}
        name, first = C.name(), 0
        for p in parts:
            again = np.asarray(K.column(p, "again"))
            for at, to, data, off in K.slices(p, text):
                w, s, e, b, seed, t, a = _anchors(data, off, length)
                twice = K.repeats(K.mix(seed + t.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
                n = to - at
                own = np.zeros(n, bool)
                own[t[twice]] = True
                tie = (K.run_hash(K.byte_prefix(data), off[:-1], off[1:]) >> np.uint64(1)).astype(np.int64)
                mine = again[at:to]
                raw = data.tobytes()
                docs["id"].append(K.column(p, "id").fill_null(_LAST).to_numpy()[at:to])
                docs["tie"].append(np.where(mine, tie, 0))
                docs["row"].append(np.where(mine, (K.mix(np.arange(first + at, first + to, dtype=np.uint64) + np.uint64(name)) >> np.uint64(1)).astype(np.int64), 0))
                docs["n_words"].append(np.diff(b))
                docs["sha"] += [hashlib.sha256(b" ".join(raw[off[i] : off[i + 1]].split())).digest() for i in range(n)]
                docs["own"].append(own)
                for x, v in (("hash", seed.view(np.int64)), ("at", (first + at + t).astype(np.int32)), ("pos", (a - b[t]).astype(np.int32)), ("whole", K.sequence_hashes(w, b)[t].view(np.int64)), ("twice", twice)):
                    found[x].append(v)
            first += len(p)
        cols = {"chunk": pa.array([name]), "rows": pa.array([C.stored(parts)], pa.binary())}
        cols |= {x: C.one_list(v if x == "sha" else np.concatenate(v), pa.binary() if x == "sha" else None) for x, v in (docs | found).items()}
        return pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    def run(batches):
        yield from map(one, C.gathered(batches))

    return src.mapInArrow(K.trimmed(run), "chunk bigint, rows binary, id array<bigint>, tie array<bigint>, row array<bigint>, n_words array<bigint>, sha array<binary>, own array<boolean>, hash array<bigint>, at array<int>, pos array<int>, whole array<bigint>, twice array<boolean>")


def _windows(w, b, length):
    """(h1, h2, start word, text, again): all windows, and whether the same text has the window earlier."""
    g, s, t = K.gram_hashes(w, b, length)
    g2, _, _ = K.gram_hashes(K.mix(w + np.uint64(0x5851F42D4C957F2D)), b, length)
    g2 >>= np.uint64(32)
    order = np.lexsort((s, g2, g, t))
    again = np.zeros(len(g), bool)
    x, y = order[1:], order[:-1]
    again[x] = (g[x] == g[y]) & (g2[x] == g2[y]) & (t[x] == t[y])
    return g, g2, s, t, again


def _lists(batch, name, i, kind=np.int64):
    v = K.column(batch, name)[i]
    return v.values.to_numpy(zero_copy_only=False) if v.is_valid else np.zeros(0, kind)


def _apart(packed):
    """(rows, places) of packed (row << 32 | place), by row."""
    packed = np.sort(packed)
    return packed >> 32, packed & 0xFFFFFFFF


def _some(part, text, rows):
    """Slices of the texts of some rows (sorted, distinct) of a batch: (the rows' places in `rows`: first and end, bytes, offsets)."""
    return K.slices(pa.RecordBatch.from_arrays([K.column(part, text).take(pa.array(rows, pa.int64()))], ["text"]))


def windows(marked: DataFrame, length: int, order: list[str], text: str) -> DataFrame:
    """(h1, rest, and the row's order): the windows that each chunk's seeds grow to, each once for a text; rest is 32 bits of hash and the start.

    Only texts that hold a seed and are no copy are read again.
    """

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                rows, places = _apart(_lists(batch, "seeds", i))
                fine = ~np.isin(rows, _lists(batch, "copies", i, np.int32))
                rows, places = rows[fine], places[fine]
                mine = [_lists(batch, x, i) for x in order]
                for first, part in C.opened(K.column(batch, "rows")[i]):
                    lo, hi = np.searchsorted(rows, (first, first + len(part)))
                    used, r = np.unique(rows[lo:hi], return_inverse=True)
                    for at, to, data, off in _some(part, text, used - first):
                        x, y = np.searchsorted(r, (at, to))
                        w, _, _, b = K.word_hashes(data, off)
                        h, start, of = K.gram_hashes(w, b, GRAM)
                        a, s = _lowest(h, start, of, length)
                        seed = np.zeros(len(w), bool)
                        seed[b[r[x:y] - at] + places[lo:hi][x:y]] = True
                        g, g2, starts, t, again = _windows(w, b, length)
                        pick = np.searchsorted(starts, s[seed[a]])
                        pick = pick[~again[pick]]
                        rest = (g2[pick] << np.uint64(32)).view(np.int64) | (starts[pick] - b[t[pick]])
                        yield pa.RecordBatch.from_arrays([pa.array(g[pick].view(np.int64)), pa.array(rest), *(pa.array(o[used[at + t[pick]]]) for o in mine)], ["h1", "rest", *order])

    return marked.select("rows", "seeds", "copies", *order).mapInArrow(K.trimmed(run), "h1 bigint, rest bigint, " + ", ".join(f"{x} bigint" for x in order))


def _cut(marked: DataFrame, length: int, keep: list[S.StructField], texts: bool, text: str) -> DataFrame:
    """For each row its columns `keep`, n_words, n_removed, sha of what is left, and if `texts` also kept (null if
    nothing goes) and spans [from, to) of removed words. bad: starts of windows that other rows have earlier; copies: rows that lose all words."""
    empty = hashlib.sha256(b"").digest()

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                rows, places = _apart(_lists(batch, "bad", i))
                n_words, own, sha = (_lists(batch, x, i) for x in ("n_words", "own", "sha"))
                copies = _lists(batch, "copies", i, np.int32)
                copy = np.zeros(len(n_words), bool)
                copy[copies] = True
                for first, part in C.opened(K.column(batch, "rows")[i]):
                    end = first + len(part)
                    removed, left, kept, spans = [0] * len(part), list(sha[first:end]), [None] * len(part), [None] * len(part)
                    for k in np.flatnonzero(copy[first:end]).tolist():
                        n = int(n_words[first + k])
                        removed[k], left[k], kept[k], spans[k] = n, empty, "", [[0, n]]
                    lo, hi = np.searchsorted(rows, (first, end))
                    starts = {k: [places[lo:hi][x:y]] for k, x, y in _groups(rows[lo:hi] - first)}
                    alone = np.flatnonzero(own[first:end] & ~copy[first:end])
                    for at, _, data, off in _some(part, text, alone):
                        w, _, _, b = K.word_hashes(data, off)
                        _, _, s, t, again = _windows(w, b, length)
                        s, t = s[again], t[again]
                        for k, x, y in _groups(t):
                            starts.setdefault(int(alone[at + k]), []).append(s[x:y] - b[k])
                    lose = np.array(sorted(starts), np.int64)
                    for at, to, data, off in _some(part, text, lose):
                        for k in range(at, to):
                            r = int(lose[k])
                            words = data[off[k - at] : off[k - at + 1]].tobytes().split()
                            gone = K.covered(np.concatenate(starts[r]), length, len(words))
                            rest = b" ".join([x for x, g in zip(words, gone.tolist(), strict=True) if not g])
                            removed[r], left[r] = int(gone.sum()), hashlib.sha256(rest).digest()
                            if texts:
                                kept[r] = rest.decode("utf-8", "replace")
                                spans[r] = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))).reshape(-1, 2).tolist()
                    cols = [*(K.column(part, f.name) for f in keep), pa.array(n_words[first:end]), pa.array(removed, pa.int64()), pa.array([x.hex() for x in left], pa.string())]
                    more = [pa.array(kept, pa.string()), pa.array(spans, pa.list_(pa.list_(pa.int64())))] if texts else []
                    yield pa.RecordBatch.from_arrays([*cols, *more], [f.name for f in kind.fields])

    more = [S.StructField("kept", S.StringType()), S.StructField("spans", S.ArrayType(S.ArrayType(S.LongType())))] if texts else []
    kind = S.StructType([*keep, S.StructField("n_words", S.LongType()), S.StructField("n_removed", S.LongType()), S.StructField("sha", S.StringType()), *more])
    return marked.select("rows", "bad", "copies", "n_words", "own", "sha").mapInArrow(K.trimmed(run), kind)


def _groups(sorted_):
    """(value, from, to) of each run of equal values."""
    u, at = np.unique(sorted_, return_index=True)
    return zip(u.tolist(), at.tolist(), np.append(at[1:], len(sorted_))[: len(u)].tolist(), strict=True)


def _by_chunk(df: DataFrame, row, place, out: str) -> DataFrame:
    return df.groupBy("chunk").agg(F.collect_list(F.shiftleft(row.cast("bigint"), 32).bitwiseOR(place.cast("bigint"))).alias(out))


def cut(docs: DataFrame, keep: list[str], text: str = "text", key: str = "doc_id", length: int = 20, texts: bool = True) -> DataFrame:
    """A row for each row of docs: its columns `keep` as c0, c1, ..., n_words, n_removed, sha (of what is left), kept, spans.

    Words are runs of bytes other than space and 9 to 13, unchanged. A window is `length` (12 or
    more) consecutive words of one row; every word is removed that a window covers whose word
    sequence also starts earlier: in an earlier row, or earlier in the same one. Rows come in the order
    of their keys, null last; rows of one key, or of none, in the order of a hash of their texts, and equal
    ones in any order. What is left is joined by single spaces. Null and empty texts have no words.
    """
    if length < GRAM + 4:
        raise ValueError(f"length must be {GRAM + 4} or more")
    spark, since = docs.sparkSession, mark()
    src, inner, text = C.source(docs, keep, text, id=F.col(key).cast("bigint"))
    many = written(src.select("id").where("id is not null").groupBy("id").count().where("count > 1").select(F.col("id").alias("many")), "many")
    src = src.withColumn("again", F.col("id").isNull()) if many.isEmpty() else src.join(many, F.col("id") == F.col("many"), "left").withColumn("again", F.col("id").isNull() | F.col("many").isNotNull()).drop("many")
    with bounded_batches(spark):
        t = bucketed(chunks(src, length, text), "chunk", int(spark.conf.get("spark.sql.shuffle.partitions")), "texts")
        # without repeated or null keys the key alone is the order
        order = ["id"] if many.isEmpty() and src.where("id is null").isEmpty() else ORDER
        me = F.struct(*order) if len(order) > 1 else F.col("id")
        rows = t.select("chunk", F.posexplode(F.arrays_zip(*order, "n_words", "sha")).alias("at", "x")).select("chunk", "at", "x.*")
        firsts = written(rows.where(F.col("n_words") >= length).groupBy("sha").agg(F.min(me).alias("f"), F.max(me).alias("l")).where("f <> l").select("sha", "f"), "firsts")
        copies = written(rows.where(F.col("n_words") >= length).join(firsts, "sha").where(me != F.col("f")).groupBy("chunk").agg(F.collect_list("at").alias("copies")), "copies")
        shared = t.select(F.inline(F.arrays_zip("hash", "whole", "twice"))).groupBy("hash").agg(F.min("whole").alias("x"), F.max("whole").alias("y"), F.max("twice").alias("twice"))
        seeds = written(shared.where("x <> y or twice").select("hash"), "seeds")
        places = t.select("chunk", F.inline(F.arrays_zip("hash", "at", "pos"))).join(seeds, "hash", "left_semi")
        marks = written(_by_chunk(places, F.col("at"), F.col("pos"), "seeds"), "marks")
        marked = t.join(marks.hint("shuffle_hash"), "chunk").join(copies.hint("shuffle_hash"), "chunk", "left")
        win = written(windows(marked, length, order, text), "windows")
        high = F.shiftright("rest", 32)
        first = written(win.groupBy("h1", high.alias("h2")).agg(F.min(me).alias("f"), F.max(me).alias("l")).where("f <> l").select(F.col("h1").alias("g1"), "h2", "f"), "matches")
        bad = win.join(first, (F.col("h1") == F.col("g1")) & (high == F.col("h2"))).where(me != F.col("f")).groupBy(*order).agg(F.collect_list(F.col("rest").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")).alias("starts"))
        where = rows.select("chunk", "at", *[F.col(c).alias(f"my_{c}") for c in order])
        at = bad.join(where, [F.col(c) == F.col(f"my_{c}") for c in order]).select("chunk", "at", F.explode("starts").alias("start"))
        bads = written(_by_chunk(at, F.col("at"), F.col("start"), "bad"), "bad")
        every = t.join(bads.hint("shuffle_hash"), "chunk", "left").join(copies.hint("shuffle_hash"), "chunk", "left")
        out = written(_cut(every, length, inner, texts, text), "cut")
    sweep(since, out)
    return out


def repeated(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = 20) -> DataFrame:
    """Rows that lose words: (key, n_removed, kept text, spans [from, to) of what maximal repeats cover). See cut()."""
    return cut(docs, [key], text, key, length).where("n_removed > 0").select(F.col("c0").alias(key), "n_removed", "kept", "spans")


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = 20) -> DataFrame:
    """docs with its repeated passages cut out, row by row; texts without any stay exactly as they are. See cut()."""
    j = cut(docs, docs.columns, text, key, length)
    return j.select(*[(F.coalesce("kept", F.col(f"c{i}").cast("string")) if c == text else F.col(f"c{i}")).alias(c) for i, c in enumerate(docs.columns)])


def op8(docs: DataFrame, length: int = 20) -> DataFrame:
    """The contract: windows of 20 words; a row for each row of docs, null texts without words. See cut() for nulls and repeated keys."""
    return cut(docs, ["doc_id"], length=length, texts=False).select(F.col("c0").alias("doc_id"), "n_words", "n_removed", F.col("sha").alias("kept_sha256"))


def oracle(length: int = 20) -> str:
    """DuckDB SQL for op8: windows themselves, and the first place of each."""
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
i AS (SELECT doc_id, unnest(range(1, len(w) - {length - 2})) AS i, w FROM w WHERE len(w) >= {length}),
x AS (SELECT doc_id, i, array_to_string(w[i : i + {length - 1}], ' ') AS x FROM i),
bad AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS r FROM x) WHERE r > 1),
gone AS (SELECT doc_id, list(DISTINCT j) AS g FROM (SELECT doc_id, unnest(range(i, i + {length})) AS j FROM bad) GROUP BY doc_id),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM w SEMI JOIN gone USING (doc_id)),
lost AS (SELECT doc_id, unnest(g) AS j FROM gone),
left_ AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS t FROM word ANTI JOIN lost USING (doc_id, j) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed, sha256(CASE WHEN g IS NULL THEN array_to_string(w, ' ') ELSE coalesce(t, '') END) AS kept_sha256 FROM w LEFT JOIN gone USING (doc_id) LEFT JOIN left_ USING (doc_id)
"""
