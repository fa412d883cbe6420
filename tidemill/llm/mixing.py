"""Operator 1: mixing sources to target weights, in DataFrame operations only.

Temperature mixing: a source's weight is its token share raised to an exponent, normalised. The exponent is found by
bisection (sixteen sections at a time: one aggregation of the per-source table gives sixteen exponents' entropies and
repetitions) as the smallest in [0, 1] that keeps the repetition limit, or the largest that reaches the target entropy. The
weights become quotas of a token budget; each source is read in whole passes and a last partial one, each pass in an order of
its own: blocks of keys (leading digits of a seeded md5) in turn, keys in order within a block. Where the partial pass ends is
found from block totals and one block's rows, so no source is ever sorted in one task, however large its share.

A document costs its words (runs of other than ASCII white space) plus one. Edge cases: a null or empty text costs 1; null is
a source of its own; rows that repeat a doc_id stand or fall together at the cut; an empty table gives an empty mix; other
columns pass through where documents are returned and are not read elsewhere.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hinted, stored

WORD = r"[^\x20\x09-\x0D]+"
SECTIONS, ROUNDS = 16, 8
#: Rows a block of keys holds on average, and tokens an output block is budgeted with.
BLOCK_ROWS, BLOCK_TOKENS = 2048, 1 << 20
#: Sources up to which the table of quotas is broadcast.
BROADCAST_SOURCES = 100_000
NO_SOURCE = "\u0000"


def cost(text_col: str = "text") -> Column:
    return (F.size(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD), F.lit(0))) + 1).cast("bigint")


def source_key(source_col: str = "source") -> Column:
    return F.coalesce(F.col(source_col).cast("string"), F.lit(NO_SOURCE))


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def exponent(sources: DataFrame, budget: float | None, repetition: float | None, entropy: float | None) -> float:
    """The exponent, to six decimals, on the side that keeps the target. sources: s, t (tokens), p (share); passes: budget / all tokens, None for one whole pass of the least repeated source."""
    if (repetition is None) == (entropy is None):
        raise ValueError("give a repetition limit or a target entropy")
    low, high = 0.0, 1.0

    def measured(at: list[float]) -> dict[float, tuple[float, float]]:
        a = F.col("a")
        sums = (
            sources.select("p", F.explode(F.array(*(F.lit(float(x)) for x in at))).alias("a"))
            .groupBy("a").agg(F.sum(F.pow("p", a)).alias("z"), F.sum(F.pow("p", a) * F.log("p")).alias("l"), F.max(F.pow("p", a - 1)).alias("most"), F.min(F.pow("p", a - 1)).alias("least"))
        )
        return {r["a"]: (math.log(r["z"]) - r["a"] * r["l"] / r["z"], r["most"] / r["least"] if budget is None else budget * r["most"] / r["z"]) for r in sums.collect()}

    def kept(found: tuple[float, float]) -> bool:
        return found[1] <= repetition + 1e-12 if repetition is not None else found[0] >= entropy - 1e-12

    ends = measured([0.0, 1.0])
    if repetition is not None:
        if not kept(ends[1.0]):
            raise ValueError("no exponent keeps the repetition limit under this budget")
        if kept(ends[0.0]):
            return 0.0
    else:
        if not kept(ends[0.0]):
            raise ValueError("the target entropy is above that of equal weights")
        if kept(ends[1.0]):
            return 1.0
    for _ in range(ROUNDS):
        at = [low + (high - low) * i / SECTIONS for i in range(1, SECTIONS)]
        found = measured(at)
        good = [x for x in at if kept(found[x])]
        bad = [x for x in at if not kept(found[x])]
        if repetition is not None:  # smallest exponent that keeps the limit
            low, high = max(bad, default=low), min(good, default=high)
        else:  # largest exponent that reaches the entropy
            low, high = max(good, default=low), min(bad, default=high)
        if high - low < 1e-9:
            break
    return math.ceil(high * 1e6 - 1e-3) / 1e6 if repetition is not None else math.floor(low * 1e6 + 1e-3) / 1e6


def quotas(rows: DataFrame, passes: float | None, repetition: float | None, entropy: float | None, seed: int) -> tuple[DataFrame, int]:
    """Per source: s, t, weight, quota (tokens), whole (passes), cut (last key of the partial pass, '' for none); digits of a block.

    rows: doc_id, s, c. passes: the budget in passes over the corpus; None for one whole pass of the least repeated source.
    """
    per = stored(rows.groupBy("s").agg(F.sum("c").alias("t"), F.count("*").alias("n")), "sources")
    total = per.agg(F.sum("t").alias("t"), F.sum("n").alias("n")).first()
    if not total["n"]:
        return per.select("s", "t", F.lit(0.0).alias("weight"), F.lit(0.0).alias("quota"), F.lit(0).cast("bigint").alias("whole"), F.lit("").alias("cut")), 1
    shares = per.select("s", "t", (F.col("t") / F.lit(float(total["t"]))).alias("p"))
    a = exponent(shares, passes, repetition, entropy)
    z = shares.agg(F.sum(F.pow("p", F.lit(a))).alias("z"), F.min(F.pow("p", F.lit(a - 1))).alias("least")).first()
    budget = float(total["t"]) * (passes if passes is not None else z["z"] / z["least"])
    table = shares.withColumn("weight", F.pow("p", F.lit(a)) / F.lit(z["z"])).withColumn("quota", F.col("weight") * F.lit(budget))
    table = table.withColumn("whole", F.floor(F.col("quota") / F.col("t") + F.lit(1e-9))).withColumn("rest", F.greatest(F.lit(0), F.floor(F.col("quota") - F.col("whole") * F.col("t") + F.lit(1e-6))).cast("bigint"))
    table = stored(table.select("s", "t", "weight", "quota", "whole", "rest"), "quotas")
    digits = max(1, math.ceil(math.log(max(1, total["n"] / BLOCK_ROWS), 16)))
    partial = rows.join(hinted(table.where("rest > 0").select("s", "whole", "rest"), BROADCAST_SOURCES, table), "s")
    partial = partial.withColumn("key", order_key(seed, F.col("whole") + 1, F.col("doc_id"))).withColumn("b", F.substring("key", 1, digits))
    blocks = partial.groupBy("s", "b").agg(F.sum("c").alias("c"), F.first("rest").alias("rest"))
    upto = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    blocks = blocks.withColumn("end", F.sum("c").over(upto)).withColumn("base", F.col("end") - F.col("c"))
    last = blocks.where("end > rest and base <= rest").select("s", "b", "base")
    within = Window.partitionBy("s", "b").orderBy("key").rangeBetween(Window.unboundedPreceding, 0)
    fits = partial.join(hinted(last, BROADCAST_SOURCES), ["s", "b"]).withColumn("end", F.col("base") + F.sum("c").over(within)).where("end <= rest")
    cut = fits.groupBy("s").agg(F.max("key").alias("in_block"))
    before = blocks.where("end <= rest").groupBy("s").agg(F.max("b").alias("blocks_before"))
    # All keys of a whole block sort before its digits followed by 'g'.
    out = table.join(cut, "s", "left").join(before, "s", "left")
    return stored(out.select("s", "t", "weight", "quota", "whole", F.coalesce("in_block", F.concat("blocks_before", F.lit("g")), F.lit("")).alias("cut")), "cuts"), digits


def copies(seed: int) -> Column:
    """How often a row joined with its source's quota is read."""
    return F.col("whole").cast("int") + F.when(order_key(seed, F.col("whole") + 1, F.col("doc_id")) <= F.col("cut"), 1).otherwise(0)


def mix(docs: DataFrame, passes: float | None = 1.0, repetition: float | None = 2.0, entropy: float | None = None, seed: int = 7) -> DataFrame:
    """The mixed corpus in reading order: doc_id, source, epoch (from 1), n_tokens, block (of the mix, from 0), place (sorts within a block), weight.

    The budget is so many passes over the corpus's tokens. A block of the mix takes from each source its weight's share.
    """
    rows = stored(docs.select("doc_id", source_key().alias("s"), cost().alias("c")), "costs")
    table, digits = quotas(rows, passes, repetition, entropy, seed)
    budget = table.agg(F.sum("quota").alias("q")).first()["q"] or 0.0
    n_blocks = max(1, math.ceil(budget / BLOCK_TOKENS - 1e-9))
    read = rows.join(hinted(table, BROADCAST_SOURCES), "s").withColumn("k", copies(seed)).where("k > 0")
    read = read.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("k")))).withColumn("key", order_key(seed, F.col("epoch"), F.col("doc_id"))).withColumn("b", F.substring("key", 1, digits))
    read = read.select("doc_id", "s", "c", "t", "weight", "quota", "epoch", "key", "b")
    blocks = read.groupBy("s", "epoch", "b").agg(F.sum("c").alias("bc"))
    upto = Window.partitionBy("s").orderBy("epoch", "b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("base", F.coalesce(F.sum("bc").over(upto), F.lit(0))).drop("bc")
    within = Window.partitionBy("s", "epoch", "b").orderBy("key").rangeBetween(Window.unboundedPreceding, 0)
    # A document stands where its last token falls in its source's stream.
    placed = read.withColumn("own", F.sum("c").over(within)).join(blocks, ["s", "epoch", "b"]).withColumn("end", F.col("base") + F.col("own") - 1)
    block = F.least(F.lit(n_blocks - 1), F.floor(F.col("end") * F.lit(n_blocks) / F.col("quota"))).cast("bigint")
    return placed.select("doc_id", F.when(F.col("s") != NO_SOURCE, F.col("s")).alias("source"), F.col("epoch").cast("bigint").alias("epoch"), F.col("c").alias("n_tokens"), block.alias("block"), F.md5(F.concat(F.lit("place|"), "key").cast("binary")).alias("place"), F.round("weight", 9).alias("weight"))


def mix_documents(docs: DataFrame, passes: float | None = None, repetition: float | None = 1.5, entropy: float | None = None, seed: int = 7) -> DataFrame:
    """The rows of docs, with all their columns, as often as the mix reads them. By default every document is read at least once."""
    rows = stored(docs.select("doc_id", source_key().alias("s"), cost().alias("c")), "costs")
    table, _ = quotas(rows, passes, repetition, entropy, seed)
    columns = [docs[c] for c in docs.columns]
    times = table.select(F.col("s").alias("__s"), F.col("whole").alias("__whole"), F.col("cut").alias("__cut"))
    n = F.col("__whole").cast("int") + F.when(order_key(seed, F.col("__whole") + 1, F.col("doc_id")) <= F.col("__cut"), 1).otherwise(0)
    met = docs.join(hinted(times, BROADCAST_SOURCES, table), source_key() == F.col("__s"))
    return met.select(*columns, F.explode(F.array_repeat(F.lit(1), n)).alias("__copy")).drop("__copy")
