"""Text as columns, with the edge cases of Python's string methods pinned down."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space at either end (not only blanks)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return strip(F.regexp_replace(c, r"\s+", " "))


def lines(c: Column) -> Column:
    """Cut at every line end; no empty last line."""
    parts = F.split(c, "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def count(c: Column, pattern: str) -> Column:
    """Number of matches."""
    return F.regexp_count(c, F.lit(pattern))


def order_key(key: Column, seed) -> Column:
    """A seeded pseudo-random order that does not depend on partitioning, and that other engines can repeat."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def unit(key: Column) -> Column:
    """A number in [0, 1] from the first 32 bits of the key's MD5."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint") / F.lit(4294967295.0)


def content_hash(scope: Column, key: Column | None, target: Column) -> Column:
    """SHA-1 over scope, key (if any) and the collapsed target."""
    parts = [scope, *([key] if key is not None else []), collapse(target)]
    return F.sha1(F.concat_ws("|", *parts))


def trim_tail(lines_: Column) -> Column:
    """Lines right-stripped, with empty lines at the end dropped."""
    clean = F.transform(lines_, rstrip)
    last = F.aggregate(F.transform(clean, lambda x, i: F.when(x != "", i + 1).otherwise(0)), F.lit(0), lambda a, x: F.greatest(a, x))
    return F.when(F.size(clean) > 0, F.slice(clean, 1, last)).otherwise(clean)


def words(c: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def bound(c: Column, f) -> Column:
    """f of an expression that is evaluated once, however often f's lambdas use it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def _runs(w: Column, n: int, one, kind: str) -> Column:
    return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: one(F.slice(w, i, n)))).otherwise(F.array().cast(kind))


def ngrams(words_: Column, n: int) -> Column:
    """All runs of n words, joined by blanks."""
    return bound(words_, lambda w: _runs(w, n, lambda x: F.array_join(x, " "), "array<string>"))


def gram_hashes(words_: Column, n: int) -> Column:
    """64-bit hashes of all runs of n words."""
    return bound(words_, lambda w: _runs(w, n, F.xxhash64, "array<bigint>"))


def gram_digests(words_: Column, n: int) -> Column:
    """128 bits (h1, h2) of all runs of n words: what stands for the words in exchanges."""
    return bound(words_, lambda w: _runs(w, n, lambda x: F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(x, F.lit(1)).alias("h2")), "array<struct<h1:bigint,h2:bigint>>"))
