"""Mixing sources to target weights, by Sainte-Lague apportionment.

Targets in words are split into blocks of equal length, which are the seats.
Sources get seats by highest quotients target / 1, / 3, / 5 ..., the shards of a
source get its seats in the same way by their sizes, and each shard takes its
blocks from its documents laid end to end in a seeded order, going round again
where it takes more than it has.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _store

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Words in a block; sources, which the driver holds as one row each.
BLOCK, MAX_SOURCES, SEED = 16, 1_000_000, 20
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Words of each source: weights in turn share out share * all sizes; none gets over most * its size, the excess is shared again."""
    out, active, left = [0.0] * len(sizes), list(range(len(sizes))), share * sum(sizes)
    weight = [float(weights[i % len(weights)]) for i in range(len(sizes))]
    while active:
        total = sum(weight[i] for i in active)
        full = [i for i in active if left * weight[i] / total > most * sizes[i]]
        if not full:
            for i in active:
                out[i] = left * weight[i] / total
            break
        for i in full:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in full)
        gone = set(full)
        active = [i for i in active if i not in gone]
    return out


def seats(weights: list[float], n: int) -> list[int]:
    """n seats by the highest quotients weight / 1, / 3, / 5 ..., ties by place: by rounding at a divisor that is near, then seat by seat."""
    total, got = sum(weights), [0] * len(weights)
    if total > 0:
        share = max(0.0, n - len(weights) / 2 - 1)
        got = [max(0, math.floor(w * share / total + 0.5)) for w in weights]
        queue = [(-w / (2 * g + 1), i) for i, (w, g) in enumerate(zip(weights, got)) if w > 0]
        heapq.heapify(queue)
        for _ in range(n - sum(got)):
            _, i = heapq.heappop(queue)
            got[i] += 1
            heapq.heappush(queue, (-weights[i] / (2 * got[i] + 1), i))
    return got


def shards(rows: int) -> int:
    """Shards of a source: as many as a shard has rows, about, so that neither the shards of a source nor the rows of a shard are many for one task."""
    return max(1, math.isqrt(rows))


def apportion(df: DataFrame, group: list[str], weight: Column, seats: Column, order: list[str]) -> DataFrame:
    """df with the column ``quota``: seats of each group given by the highest quotients weight / (2 a - 1), ties by order.

    A divisor d that gives out s seats among n rows lies where s - n/2 <= sum / d
    <= s + n/2, which leaves two or so quotients a row to be ranked.
    """
    of = Window.partitionBy(*group)
    df = df.withColumn("_w", weight.cast("double")).withColumn("_s", seats.cast("double"))
    df = df.withColumn("_sum", F.sum("_w").over(of)).withColumn("_n", F.count("*").over(of))

    def rounded(s: Column) -> Column:
        return F.when(F.col("_sum") > 0, F.greatest(F.lit(0), F.floor(F.col("_w") * s / F.col("_sum") + 0.5))).otherwise(0).cast("long")

    df = df.withColumn("_low", rounded(F.col("_s") - F.col("_n") / 2 - 1)).withColumn("_top", rounded(F.col("_s") + F.col("_n") / 2 + 1))
    free = F.col("_s") - F.sum("_low").over(of)
    df = df.withColumn("_free", free)
    some = df.withColumn("_a", F.explode_outer(F.when(F.col("_top") > F.col("_low"), F.sequence(F.col("_low") + 1, F.col("_top")))))
    rank = F.row_number().over(of.orderBy((F.col("_w") / (2 * F.col("_a") - 1)).desc_nulls_last(), *order))
    some = some.withColumn("_got", F.when(F.col("_a").isNotNull() & (rank <= F.col("_free")), 1).otherwise(0))
    keep = [c for c in df.columns if not c.startswith("_")]
    return some.groupBy(*keep, "_low").agg(F.sum("_got").alias("_got")).select(*keep, (F.col("_low") + F.col("_got")).cast("long").alias("quota"))


def source_mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """Mix docs (doc_id, text, source): doc_id, size, source_size, target, taken, source.

    size is the number of words; target the source's words in the mix; taken
    those of the row, repeats counted, at most ``most`` times its size. A
    source's taken words differ from its target by some blocks at most.

    Null text has no words and is never taken; a null source is a source, the
    last by code point. Repeated rows each count. Sources without words get
    nothing. An empty table gives an empty result. Reruns on equal rows agree.
    """
    spark = docs.sparkSession
    sized = _store.save(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    totals.sort(key=lambda r: (r.source is None, r.source or ""))
    words = targets([r.n for r in totals], weights, share, most)
    blocks = seats(words, round(sum(words) / block))
    rows = [(i, r.source, r.n, t, shards(r.rows), n) for i, (r, t, n) in enumerate(zip(totals, words, blocks))]
    sources = _store.save(spark.createDataFrame(rows, "sid int, source string, source_size long, target double, shards int, blocks long"), "sources")
    sized = sized.withColumnRenamed("source", "_source")
    dealt = sized.join(sources, F.col("_source").eqNullSafe(F.col("source"))).drop("_source")
    dealt = dealt.withColumn("turn", F.xxhash64(F.lit(seed), "doc_id", "size")).withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.col("shards")).cast("int"))
    quotas = dealt.groupBy("sid", "shard", "blocks").agg(F.sum("size").alias("shard_size"))
    quotas = _store.save(apportion(quotas, ["sid"], F.col("shard_size"), F.col("blocks"), ["shard"]).drop("blocks"), "quotas")
    laid = dealt.join(quotas, ["sid", "shard"])
    before = F.sum("size").over(Window.partitionBy("sid", "shard").orderBy("turn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1))
    laid = laid.withColumn("before", F.coalesce(before, F.lit(0))).withColumn("words", F.col("quota") * block)
    rounds = F.when(F.col("shard_size") > 0, F.floor(F.col("words") / F.col("shard_size"))).otherwise(0)
    rest = F.col("words") - rounds * F.col("shard_size") - F.col("before")
    taken = F.when(rounds >= most, most * F.col("size")).otherwise(rounds * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest)))
    return laid.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "source")


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
