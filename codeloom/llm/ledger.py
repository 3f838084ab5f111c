"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document; the ledger keeps the measurements and one bit for
each failed rule. Policies are versioned masks over these bits, applied without touching the texts
again, and ablations are bitwise aggregations over the ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from . import kernels as K
from .common import small_batches

SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
SHOUT = np.zeros(256, bool)
SHOUT[[ord("!"), ord("?")]] = True
HEAD = np.ones(256, bool)
HEAD[0x80:0xC0] = False
NEWLINE = np.ones(256, bool)
NEWLINE[10] = False

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_shouts", "n_lines", "longest_word")


@dataclass(frozen=True)
class Rule:
    """One rule: its bit, its name, and when it fails, as SQL over the measurements."""

    bit: int
    name: str
    fails: str


#: Bits are never reused: a new rule takes a new bit, so that old ledgers stay readable.
RULES = (
    Rule(0, "few_words", "n_words < 20"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > 2 * n_words"),
    Rule(3, "shouting", "10 * n_shouts > 3 * n_words"),
    Rule(4, "duplicate_lines", "n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines"),
    Rule(5, "word_length", "n_words > 0 and (word_chars < 2 * n_words or word_chars > 25 * n_words)"),
    Rule(6, "endless_word", "longest_word > 2000"),
)
BASE_MASK = 0b11

#: Versions of the policy: which bits reject a document.
POLICIES = {1: BASE_MASK, 2: 0b1111111}


def measure(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """The measurements of each row's whole text, after its key, or after its columns `keep` as c0, c1, ...

    Null texts count as empty: every measurement is 0. Rows with equal or null keys give a row each. Words
    are runs of bytes other than space and 9 to 13; windows are 8 words; lines are cut at newlines
    and count if they hold a word. Equality of windows and lines within a text is by 64-bit hash.
    """
    small_batches(docs.sparkSession)
    cols = keep or [key]
    inner = [S.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(cols)]

    def run(batches):
        for batch in batches:
            for at, to, data, off in K.slices(batch, "text"):
                m = _measure(data, off)
                yield pa.RecordBatch.from_arrays([*(K.column(batch, f.name).slice(at, to - at) for f in inner), *(pa.array(m[x].astype(np.int64)) for x in MEASURES)], [*(f.name for f in inner), *MEASURES])

    kind = S.StructType([*inner, *(S.StructField(x, S.LongType()) for x in MEASURES)])
    out = docs.select(*[F.col(c).alias(f.name) for c, f in zip(cols, inner, strict=True)], F.col(text).cast("string").alias("text")).mapInArrow(K.trimmed(run), kind)
    return out if keep else out.withColumnRenamed("c0", key)


def _measure(data, off):
    w, s, e, b = K.word_hashes(data, off)
    heads = np.concatenate([[0], np.cumsum(HEAD[data], dtype=np.int64)])
    chars = heads[e] - heads[s]
    out = {"n_words": np.diff(b), "word_chars": K.per_text(chars, b)}
    for name, of in (("n_symbols", SYMBOL), ("n_shouts", SHOUT)):
        p = np.concatenate([[0], np.cumsum(of[data], dtype=np.int64)])
        out[name] = p[off[1:]] - p[off[:-1]]
    longest = np.zeros(len(off) - 1, np.int64)
    np.maximum.at(longest, np.repeat(np.arange(len(off) - 1), np.diff(b)), chars)
    out["longest_word"] = longest
    h, at, text = K.gram_hashes(w, b, 8)
    dup = K.repeats(K.mix(h + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    out["n_repeat_words"] = K.per_text(K.covered(at[dup], 8, len(w)), b)
    ls, le, lb = K.spans(data, off, NEWLINE)
    words = np.searchsorted(s, np.stack([ls, le])) if len(ls) else np.zeros((2, 0), np.int64)
    real = words[1] > words[0]
    line = np.repeat(np.arange(len(off) - 1), np.diff(lb))[real]
    key = K.mix(K.run_hash(K.byte_prefix(data), ls[real], le[real]) + line.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.lexsort((key, line))
    again = np.zeros(len(key), bool)
    again[1:] = (key[order][1:] == key[order][:-1]) & (line[order][1:] == line[order][:-1])
    n = len(off) - 1
    out["n_lines"] = np.bincount(line, minlength=n)
    out["n_dup_lines"] = np.bincount(line[order][again], minlength=n)
    return out


def _bits(measured: DataFrame, rules) -> DataFrame:
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("fail_bits", bits)


def ledger(docs: DataFrame, text: str = "text", key: str = "doc_id", rules=RULES) -> DataFrame:
    """measure() and fail_bits, one bit for each failed rule."""
    return _bits(measure(docs, text, key), rules)


def screened(docs: DataFrame, version: int = 2, text: str = "text") -> DataFrame:
    """The rows of docs that a policy keeps, with all their columns: each row by its own text, in one pass."""
    led = _bits(measure(docs, text, keep=docs.columns), RULES).where(~rejected(version))
    return led.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def rejected(version: int | None = None, mask: int | None = None) -> Column:
    """Whether a policy, by version or as a mask, rejects a row of a ledger."""
    return F.col("fail_bits").bitwiseAND(F.lit(POLICIES[version] if mask is None else mask)) != 0


def ablation(led: DataFrame, mask: int, rules=RULES) -> DataFrame:
    """For each rule of a policy: rows that fail it, rows that fail it alone, and rows kept without it."""
    hit = F.col("fail_bits").bitwiseAND(F.lit(mask))
    used = [r for r in rules if mask >> r.bit & 1]
    if not used:
        return led.sparkSession.createDataFrame([], "rule string, n_failed long, n_only long, kept_without long")
    sums = led.agg(F.count("*").alias("n"), *[x for r in used for x in (F.count_if(hit.bitwiseAND(F.lit(1 << r.bit)) != 0).alias(f"f{r.bit}"), F.count_if(hit == 1 << r.bit).alias(f"o{r.bit}"), F.count_if(hit.bitwiseAND(F.lit(mask & ~(1 << r.bit))) == 0).alias(f"k{r.bit}"))])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(f"f{r.bit}").alias("n_failed"), F.col(f"o{r.bit}").alias("n_only"), F.col(f"k{r.bit}").alias("kept_without")) for r in used])).alias("x")).select("x.*")


def op3(docs: DataFrame, version: int = 2) -> DataFrame:
    """The contract's columns: base measurements, base_failed, kept, and the ledger's bits. See measure() for nulls and repeated keys."""
    base = F.col("fail_bits").bitwiseAND(F.lit(BASE_MASK)) != 0
    return ledger(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & ~rejected(version)).alias("kept"), "fail_bits", "n_shouts", "n_lines", "longest_word")


def oracle(version: int = 2) -> str:
    """DuckDB SQL for op3: words, lines and windows themselves, not hashes of them."""
    word = r"[^\x20\x09-\x0D]"
    bits = " + ".join(f"CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END" for r in RULES)
    count = "length(regexp_replace(t, '[^{}]', '', 'g'))"
    return f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{word}+') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM w WHERE len(w) >= 8),
k AS (SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS k FROM g),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM k) WHERE c > 1),
cover AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM again) GROUP BY doc_id),
line AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w),
lines AS (SELECT doc_id, count(*) AS n, count(DISTINCT line) AS u FROM line WHERE regexp_matches(line, '{word}') GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST({count.format('#*$%&|<>')} AS BIGINT) AS n_symbols,
  CAST(coalesce(lines.n - lines.u, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cover.n, 0) AS BIGINT) AS n_repeat_words, CAST({count.format('!?')} AS BIGINT) AS n_shouts, CAST(coalesce(lines.n, 0) AS BIGINT) AS n_lines,
  CAST(coalesce(list_max(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS longest_word FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN cover USING (doc_id)),
b AS (SELECT *, CAST({bits} AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & {BASE_MASK} <> 0 AS base_failed, fail_bits & {BASE_MASK | POLICIES[version]} = 0 AS kept, fail_bits, n_shouts, n_lines, longest_word FROM b
"""
