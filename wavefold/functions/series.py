"""Elementwise and neighbourhood functions on ordered series (signal_id, i, ...).

Whole-series statistics are grouped aggregates joined back, and frames of
bounded width run in overlapping chunks of the ordinal, so that no operator here
sorts a whole signal in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEY, ORD = "signal_id", "i"
CHUNK = 1 << 16


def chunked(df: DataFrame, before: int, after: int, key: list[str] | None = None, order: str = ORD, size: int = CHUNK) -> tuple[DataFrame, WindowSpec, Column]:
    """df with chunk numbers, rows near a border being in both chunks; the window of a chunk; and whether a row is in its own chunk.

    Frames that reach at most ``before`` rows back and ``after`` rows ahead
    are then exact for the rows that are kept.
    """
    key = key or [KEY]
    if max(before, after) > size:
        raise ValueError("frame wider than a chunk")
    own, rest = F.floor(F.col(order) / size), F.col(order) % size
    copies = F.array_compact(F.array(own, F.when((rest < after) & (own > 0), own - 1), F.when(rest >= size - before, own + 1)))
    out = df.withColumn("_own", own).withColumn("_chunk", F.explode(copies))
    return out, Window.partitionBy(*key, "_chunk").orderBy(order), F.col("_own") == F.col("_chunk")


def tidy(df: DataFrame, core: Column) -> DataFrame:
    return df.filter(core).drop("_own", "_chunk")


def with_stats(df: DataFrame, value: str = "y", key: list[str] | None = None, **aggregates: Column) -> DataFrame:
    """df with columns of aggregates of its group."""
    key = key or [KEY]
    return df.join(df.groupBy(*key).agg(*(a.alias(k) for k, a in aggregates.items())), key)


def zscore(df: DataFrame, value: str, out: str, key: list[str] | None = None) -> DataFrame:
    """(x - mean) / (population deviation + 1e-12) within each group."""
    df = with_stats(df, value, key, _m=F.avg(value), _d=F.stddev_pop(value))
    return df.withColumn(out, (F.col(value) - F.col("_m")) / (F.col("_d") + 1e-12)).drop("_m", "_d")


def minmax(df: DataFrame, value: str, out: str, key: list[str] | None = None) -> DataFrame:
    df = with_stats(df, value, key, _l=F.min(value), _h=F.max(value))
    return df.withColumn(out, (F.col(value) - F.col("_l")) / (F.col("_h") - F.col("_l") + 1e-12)).drop("_l", "_h")


def gradient(df: DataFrame, value: str, out: str, key: list[str] | None = None, order: str = ORD) -> DataFrame:
    """Half the difference of the neighbours; one-sided at the ends; 0 for a single row."""
    df, w, core = chunked(df, 1, 1, key, order)
    x, before, after = F.col(value), F.lag(value).over(w), F.lead(value).over(w)
    g = F.when(before.isNull() & after.isNull(), 0.0).when(before.isNull(), after - x).when(after.isNull(), x - before).otherwise((after - before) / 2)
    return tidy(df.withColumn(out, g), core)


def difference(df: DataFrame, value: str, out: str, factor: float = 1.0, key: list[str] | None = None, order: str = ORD) -> DataFrame:
    """x[i] - factor * x[i-1]; the first row keeps its value for a factor under 1 (pre-emphasis), else null."""
    df, w, core = chunked(df, 1, 0, key, order)
    before = F.lag(value).over(w)
    return tidy(df.withColumn(out, F.when(before.isNotNull(), F.col(value) - factor * before).otherwise(F.col(value) if factor < 1 else F.lit(None))), core)


def running_sum(df: DataFrame, value: str, out: str, key: list[str] | None = None, order: str = ORD, size: int = CHUNK) -> DataFrame:
    """df with the sum of value up to each row: within chunks of the ordinal, beside the sums of the chunks before."""
    key = key or [KEY]
    z = df.withColumn("_own", F.floor(F.col(order) / size))
    before = F.sum("_t").over(Window.partitionBy(*key).orderBy("_own").rowsBetween(Window.unboundedPreceding, -1))
    offsets = z.groupBy(*key, "_own").agg(F.sum(value).alias("_t")).withColumn("_o", F.coalesce(before, F.lit(0.0))).drop("_t")
    own = F.sum(value).over(Window.partitionBy(*key, "_own").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return z.withColumn(out, own).join(offsets, [*key, "_own"]).withColumn(out, F.col(out) + F.col("_o")).drop("_own", "_o")


def smooth(df: DataFrame, value: str, out: str, size: Column, n: Column, order: str = ORD) -> DataFrame:
    """Moving mean of ``size`` rows (from i - size // 2), the series being mirrored at its ends with the edge row repeated.

    size and n are columns of df, size at most n. A mean is made of the running
    sums at up to four places, so a row is handed to four others at most,
    however wide the frame.
    """
    i = F.col(order)
    z = df.withColumn("_size", size).withColumn("_n", n).withColumn("_lo", i - F.floor(F.col("_size") / 2)).withColumn("_hi", F.col("_lo") + F.col("_size") - 1)
    low, high, last = F.col("_lo"), F.col("_hi"), F.col("_n") - 1
    place = lambda at, sign: F.struct(at.cast("bigint").alias("at"), F.lit(sign).alias("sign"))
    parts = F.array(
        place(F.least(high, last), 1.0), F.when(low > 0, place(low - 1, -1.0)), F.when(low < 0, place(-low - 1, 1.0)),
        F.when(high > last, place(last, 1.0)), F.when((high > last) & (2 * last - high >= 0), place(2 * last - high, -1.0)),
    )
    wanted = z.select(KEY, order, "_size", F.explode(F.array_compact(parts)).alias("_p")).select(KEY, order, "_size", F.col("_p.at").alias("_at"), F.col("_p.sign").alias("_sign"))
    sums = running_sum(df.select(KEY, order, value), value, "_s", order=order).select(KEY, F.col(order).alias("_at"), "_s")
    means = wanted.join(sums, [KEY, "_at"]).groupBy(KEY, order).agg((F.sum(F.col("_sign") * F.col("_s")) / F.first("_size")).alias(out))
    return df.join(means, [KEY, order])


def resample(df: DataFrame, value: str, length: Column | int, key: list[str] | None = None, order: str = ORD) -> DataFrame:
    """(key, k, v): linear interpolation of each series at ``length`` equally spaced places, ends included."""
    key = key or [KEY]
    length = F.lit(length) if isinstance(length, int) else length
    sizes = df.groupBy(*key).agg(F.count("*").alias("_n"), F.first(length).alias("_t"))
    pos = F.col("k") * (F.col("_n") - 1) / F.greatest(F.col("_t") - 1, F.lit(1))
    grid = sizes.select(*key, "_n", "_t", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_t").cast("bigint") - 1)).alias("k"))
    grid = grid.withColumn("_p", pos).withColumn("_a", F.floor("_p")).withColumn("_b", F.least(F.col("_a") + 1, F.col("_n") - 1))
    low, high = (df.select(*key, F.col(order).alias(a), F.col(value).alias(v)) for a, v in (("_a", "_va"), ("_b", "_vb")))
    return grid.join(low, [*key, "_a"]).join(high, [*key, "_b"]).select(*key, "k", (F.col("_va") + (F.col("_p") - F.col("_a")) * (F.col("_vb") - F.col("_va"))).alias("v"))


def corr(x: str, y: str) -> Column:
    """Pearson correlation, or 0 where either side does not vary."""
    return F.when((F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0), F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))).otherwise(0.0)


def ranks(df: DataFrame, value: str, out: str, key: list[str] | None = None) -> DataFrame:
    """Average rank of each row in its group, for Spearman's correlation."""
    key = key or [KEY]
    counts = df.groupBy(*key, value).agg(F.count("*").alias("_c"))
    below = F.coalesce(F.sum("_c").over(Window.partitionBy(*key).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.join(counts.withColumn(out, below + (F.col("_c") + 1) / 2).drop("_c"), [*key, value])


def chi2_sf_even(x: Column, df: int) -> Column:
    """Upper tail of chi-square for an even number of degrees of freedom, in closed form."""
    term = total = F.lit(1.0)
    for j in range(1, df // 2):
        term = term * (x / 2) / j
        total = total + term
    return F.exp(-x / 2) * total


def histogram_distance(a: DataFrame, b: DataFrame, key: list[str], value: str, bins: Column) -> DataFrame:
    """(key, emd): summed gap of the cumulative shares of a and b, on bins over a's range, times the bins' width.

    Values of b outside that range are left out; null where b has none inside.
    Not symmetric.
    """
    spans = a.groupBy(*key).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.first(bins).alias("_k"))
    spans = spans.withColumn("_lo2", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo") - 0.5).otherwise(F.col("_lo"))).withColumn("_hi", F.when(F.col("_lo") == F.col("_hi"), F.col("_hi") + 0.5).otherwise(F.col("_hi"))).drop("_lo").withColumnRenamed("_lo2", "_lo")

    def counted(df: DataFrame, name: str) -> DataFrame:
        at = F.least(F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * F.col("_k")), F.col("_k") - 1).cast("bigint")
        inside = df.join(spans, key).filter((F.col(value) >= F.col("_lo")) & (F.col(value) <= F.col("_hi")))
        return inside.groupBy(*key, at.alias("_bin")).agg(F.count("*").alias(name))

    grid = spans.select(*key, "_lo", "_hi", "_k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_k").cast("bigint") - 1)).alias("_bin"))
    grid = grid.join(counted(a, "_ca"), [*key, "_bin"], "left").join(counted(b, "_cb"), [*key, "_bin"], "left").fillna(0, ["_ca", "_cb"])
    run, whole = Window.partitionBy(*key).orderBy("_bin"), Window.partitionBy(*key)
    width = (F.col("_hi") - F.col("_lo")) / F.col("_k")

    def share(c: str) -> Column:
        return F.try_divide(F.sum(c).over(run), F.sum(c).over(whole))

    gap = F.abs(share("_ca") - share("_cb"))
    return grid.withColumn("_gap", gap).withColumn("_w", width).groupBy(*key).agg((F.sum("_gap") * F.first("_w")).alias("_emd"), F.sum("_cb").alias("_in")).select(*key, F.when(F.col("_in") > 0, F.col("_emd")).alias("emd"))


def spread(df: DataFrame, *key: str) -> DataFrame:
    """df dealt out by key over all shuffle partitions, for kernels whose cost its bytes don't show (small partitions would be merged)."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)
