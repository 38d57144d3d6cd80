"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its target share of the output over its rows. Every document draws a uniform number from
a hash of seed and key, which an inverted Poisson distribution of that rate turns into a number of copies; the copies are
exploded and dealt globally in the order of a second hash. The draw depends on the document alone, so a repeated run, a
lost executor or another partitioning give the same rows, and a hot source needs no group of its own: its rows are only
counted, with partial sums.

Defined cases: a null source is a source of its own and never has a given weight, an empty name is an ordinary one; sources
without a target weight (or with one of 0) get none of the output, unless no weights are given, when all sources weigh the
same; repeated rows draw alike; null texts stay; an empty table gives none; all columns of the input are kept, but those
named rate, n_copies, copy or order_key, which are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Up to so many sources, their rates (some tens of bytes each) are broadcast; more are joined by a shuffle in which every
#: source has SALTS keys, so that the rows of a hot one are spread.
SEED, FEW_SOURCES, SALTS = 20240229, 50_000, 64
#: What ``replicate`` adds.
ADDED = ("rate", "n_copies", "copy", "order_key")
#: Bits of an order key.
KEY_BITS = 60
#: Copies of a row that one step makes; what has more is dealt to tasks block by block.
BLOCK_COPIES = 4096
#: Up to this rate, the terms of the Poisson law are summed from zero copies.
DIRECT = 500


def uniform(key: Column, seed: int) -> Column:
    """(0, 1), from the first 52 bits of an MD5 hash of seed and key."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") + 0.5) / float(1 << 52)


def shuffled(key: Column, copy: Column, seed: int = SEED) -> Column:
    """The place of a copy in the global shuffle: 60 bits of an MD5 hash."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed}"), F.coalesce(key.cast("string"), F.lit("null")), copy)), 1, 15), 16, 10).cast("bigint")


def inverse_poisson(u: Column, rate: Column) -> Column:
    """The smallest k whose cumulative probability reaches ``u``.

    Both are read once for each term, so they should be columns of the row and no expressions. Terms are summed from k = 0, or beyond rates of DIRECT, where exp(-rate) comes near the smallest doubles, from twelve
    deviations and 20 below the mean; they end as far above it. What lies outside is far less than the smallest ``u``.
    """
    spread = 12 * F.sqrt(rate) + 20
    large = rate > DIRECT
    first = F.when(large, F.floor(rate - spread)).otherwise(0).cast("int")
    f = F.greatest(F.floor(rate - spread), F.lit(1)).cast("double")
    # log of the probability of f, with Stirling's series for its factorial
    log_p = f * F.log(rate / f) - (rate - f) - 0.5 * F.log(2 * math.pi * f) - 1 / (12 * f) + 1 / (360 * f * f * f)
    p = F.when(large, F.exp(log_p)).otherwise(F.exp(-rate))
    start = F.struct(p.alias("p"), p.alias("c"), first.alias("k"))

    def step(a: Column, i: Column) -> Column:
        p = a["p"] * rate / i
        return F.struct(F.when(a["c"] < u, p).otherwise(a["p"]).alias("p"), F.when(a["c"] < u, a["c"] + p).otherwise(a["c"]).alias("c"), (a["k"] + F.when(a["c"] < u, 1).otherwise(0)).alias("k"))

    return F.aggregate(F.sequence(first + 1, F.ceil(rate + spread).cast("int")), start, step, lambda a: a["k"])


def rates(docs: DataFrame, weights: Mapping[str, float] | None = None, rows: float | None = None) -> DataFrame:
    """source, n, rate: mean copies of a document of each source, for ``rows`` output rows (default: as many as the input)."""
    counts = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        counts = counts.withColumn("weight", F.lit(1.0))
    else:
        table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else F.create_map().cast("map<string,double>")
        counts = counts.withColumn("weight", F.when(F.col("source").isNull(), 0.0).otherwise(F.coalesce(F.try_element_at(table, F.col("source")).cast("double"), F.lit(0.0))))
    total = counts.agg(F.sum("n").alias("all_rows"), F.sum("weight").alias("all_weight"))
    out = F.col("all_rows") if rows is None else F.lit(float(rows))
    return counts.crossJoin(F.broadcast(total)).select("source", "n", F.coalesce(F.try_divide(out * F.col("weight"), F.col("all_weight") * F.col("n")), F.lit(0.0)).alias("rate"))


def replicate(docs: DataFrame, weights: Mapping[str, float] | None = None, rows: float | None = None, seed: int = SEED, key: str = "doc_id") -> DataFrame:
    """All columns of ``docs``, with rate, n_copies, copy (from 0) and order_key, once for each copy, in the order of order_key.

    Order keys are uniform, so their leading bits are the partition: a global shuffle without a pass that samples the keys.
    """
    found = written(rates(docs, weights, rows).select(F.col("source").alias("_mix_source"), F.col("rate").alias("_mix_rate")), "rates")
    # drawn before the join, so that the sum over the terms reads a number and doesn't hash the key again for each
    keyed = docs.withColumns({"_mix_u": uniform(F.col(key), seed), "_mix_key": F.col(key)})
    same = F.col("source").eqNullSafe(F.col("_mix_source"))
    if found.count() <= FEW_SOURCES:
        joined = keyed.join(F.broadcast(found), same)
    else:
        salted = found.withColumn("_mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = keyed.withColumn("_mix_own", F.floor(F.col("_mix_u") * SALTS).cast("int")).join(salted, same & (F.col("_mix_own") == F.col("_mix_salt")))
    kept = [c for c in docs.columns if c not in ADDED]
    drawn = lambda rows: rows.select(*kept, "_mix_key", F.col("_mix_rate").alias("rate"), inverse_poisson(F.col("_mix_u"), F.col("_mix_rate")).alias("n_copies"))
    copies = numbered(drawn(joined), "n_copies", "copy")
    if (found.agg(F.max(most_copies(F.col("_mix_rate")))).first()[0] or 0) > BLOCK_COPIES:
        # only rows of sources with such a rate can have as many copies
        many = most_copies(F.col("_mix_rate")) > BLOCK_COPIES
        copies = numbered(drawn(joined.where(~many)), "n_copies", "copy").unionByName(numbered(drawn(joined.where(many)), "n_copies", "copy", spread=True))
    placed = copies.withColumn("order_key", shuffled(F.col("_mix_key"), F.col("copy"), seed)).drop("_mix_key")
    return dealt(placed, "order_key")


def most_copies(rate: Column) -> Column:
    """What ``inverse_poisson`` gives at most for ``rate``."""
    return F.ceil(rate + 12 * F.sqrt(rate) + 20)


def numbered(rows: DataFrame, n: str, copy: str, spread: bool = False) -> DataFrame:
    """Each of ``rows`` ``n`` times, with the number of the copy from 0: blocks of BLOCK_COPIES, which with ``spread`` are dealt to tasks before they are filled."""
    last = F.ceil(F.col(n) / BLOCK_COPIES).cast("int") - 1
    blocks = rows.where(F.col(n) > 0).withColumn("_mix_block", F.explode(F.sequence(F.lit(0), last)))
    if spread:
        # a number of partitions of its own: blocks are short, so that few tasks would take them all
        blocks = blocks.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("_mix_block", *[c for c, kind in rows.dtypes if kind == "bigint"]))
    first = F.col("_mix_block") * BLOCK_COPIES
    inside = F.sequence(first, F.least(first + BLOCK_COPIES, F.col(n)) - 1)
    return blocks.withColumn(copy, F.explode(inside)).drop("_mix_block")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` in the order of a uniform key of KEY_BITS bits, whose leading bits are the partition."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.shiftright(F.shiftright(F.col(key), KEY_BITS - 32) * n, 32).cast("int")
    return rows.repartitionById(n, part).sortWithinPartitions(key)
