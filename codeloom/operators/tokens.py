"""Token blocks and stream mixing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .tables import prefix_sums


def placed(docs: DataFrame, key: str, tokens: str, eos) -> DataFrame:
    """(key, start, toks): each document's tokens with the end token, and its place in the whole, in key order.

    Totals of key ranges are summed first, so no task sees all documents.
    """
    d = docs.select(key, F.concat(F.coalesce(F.col(tokens), F.array().cast(docs.schema[tokens].dataType)), F.array(F.lit(eos))).alias("toks"))
    start = prefix_sums(d.select(key, F.size("toks").alias("n")), [key], F.col("n"), F.floor(F.col(key) / 4096), "start")
    return d.join(start.drop("n"), key)


def blocks(docs: DataFrame, key: str, tokens: str, eos, size: int = 1024, keep_tail: bool = False) -> DataFrame:
    """(block, toks): size + 1 tokens, the last repeated as the next block's first; the tail goes unless kept.

    Documents are cut at block edges, and these slices are shuffled, not single tokens.
    """
    p = placed(docs, key, tokens, eos)
    n, start = F.size("toks"), F.col("start")
    first = F.greatest(F.lit(0), F.ceil((start - size) / size)).cast("bigint")
    last = F.floor((start + n - 1) / size)

    def cut(k):
        at = F.greatest(start, k * size)
        upto = F.least(start + n, k * size + size + 1)
        return F.struct(k.alias("block"), at.alias("pos"), F.slice("toks", (at - start + 1).cast("int"), (upto - at).cast("int")).alias("part"))

    parts = p.select(F.inline(F.transform(F.sequence(first, last), cut)))
    b = parts.groupBy("block").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"])).alias("toks"))
    if keep_tail:
        return b
    total = p.agg(F.sum(F.size("toks"))).scalar()
    return b.where((F.col("block") < F.floor((total - 1) / (size + 1))) & (F.size("toks") == size + 1))


def epoch_order(blocks_: DataFrame, seed: int, epoch: int) -> DataFrame:
    """Blocks in an order of their own for each epoch."""
    return blocks_.orderBy(T.order_key(F.col("block"), seed + epoch))


def prompt_head(tokens: Column, n: int = 120) -> Column:
    return F.slice(tokens, 1, n)
