"""The volatility layer: rolling deviation and GARCH of trend series."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import series as X
from ..functions.fits import garch_fits, series_batches
from ..functions.kernels import garch_variance
from ..functions.series import KEY, spread
from .trends import global_similarity, series_similarity

WEIGHTS = {"energy": 0.35, "brightness": 0.20, "complexity": 0.15, "rhythm": 0.30}
GARCH_SHAPE = "omega double, alpha double, beta double, persistence double, half_life double, converged boolean, backend string, cond_vol array<double>"


def rolling_volatility(rows: DataFrame, value: str = "y", window: int = 10, key: list[str] | None = None, order: str = "i") -> DataFrame:
    """rows with ``vol``: population deviation of the last ``window`` values; of the first i + 2 where i < window - 1.

    The warm-up looks one value ahead, as its definition has it. Rows below the
    warm-up are few, so both frames run in chunks.
    """
    df, w, core = X.chunked(rows, window - 1, 1, key, order)
    early = F.stddev_pop(value).over(w.rowsBetween(-(window - 1), 1))
    late = F.stddev_pop(value).over(w.rowsBetween(-(window - 1), 0))
    return X.tidy(df.withColumn("vol", F.when(F.col(order) < window - 1, early).otherwise(late)), core)


def volatility_layer(series: DataFrame, window: int = 10, order: str = "w", value: str = "x") -> DataFrame:
    """(signal_id, trend, w, vol, vol_norm) of long trend rows; the window is at most a third of the series, and at least 2.

    The width differs between series, so every row is handed to the at most
    ``window`` frames that hold it, as one grouped deviation.
    """
    key = [KEY, "trend"]
    n = series.groupBy(*key).agg(F.count("*").alias("_n"))
    sized = series.join(n, key).withColumn("_win", F.least(F.lit(window), F.greatest(F.lit(2), F.floor(F.col("_n") / 3))))
    w, last = F.col(order), F.col("_n") - 1
    first = F.when(w < F.col("_win") - 1, F.greatest(w - 1, F.lit(0))).otherwise(w)
    # A row is in the frames of the win - 1 rows that follow it, and of the one before it while that is in the warm-up.
    early = F.filter(F.sequence(F.greatest(w - 1, F.lit(0)), F.least(F.greatest(F.col("_win") - 2, w), last)), lambda t: (t < F.col("_win") - 1) & (t >= w - 1))
    late = F.filter(F.sequence(first, F.least(w + F.col("_win") - 1, last)), lambda t: (t >= F.col("_win") - 1) & (t >= w))
    frames = sized.select(*key, F.col(value).alias("_x"), F.explode(F.array_union(early, late)).alias(order))
    return X.zscore(frames.groupBy(*key, order).agg(F.stddev_pop("_x").alias("vol")), "vol", "vol_norm", key)


def summarise(layer: DataFrame, key: list[str]) -> DataFrame:
    """(key, mean_vol, sd_vol, max_vol, vol_of_vol, regime)."""
    s = layer.groupBy(*key).agg(F.avg("vol").alias("mean_vol"), F.stddev_pop("vol").alias("sd_vol"), F.max("vol").alias("max_vol"))
    regime = F.when(F.col("mean_vol") > 0.1, "high").when(F.col("mean_vol") > 0.03, "medium").otherwise("low")
    return s.withColumn("vol_of_vol", F.col("sd_vol") / (F.col("mean_vol") + 1e-12)).withColumn("regime", regime)


def garch(rows: DataFrame, value: str = "y", key: list[str] | None = None, order: str = "i", least: int = 20) -> DataFrame:
    """(key, omega, alpha, beta, persistence, half_life, converged, backend, cond_vol) of each series; constant under ``least`` values."""
    key = key or [KEY]
    names = {f.name: f.dataType.simpleString() for f in rows.schema}

    columns = [*key, *(c.split()[0] for c in GARCH_SHAPE.split(", "))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, series in series_batches(frames, key, value):
            fits = garch_fits([x if len(x) >= least else x[:0] for x in series])
            for fit, x in zip(fits, series):
                if len(x) < least:
                    fit |= {"omega": float(x.var()) if len(x) else 0.0, "cond_vol": [float(x.std())] * len(x)}
                fit["backend"] = "likelihood" if fit["converged"] else "constant"
            yield pd.DataFrame([dict(zip(key, k)) | fit for k, fit in zip(ids, fits)])[columns]

    dealt = spread(rows.select(*key, order, value), *key).sortWithinPartitions(*key, order)
    return dealt.mapInPandas(run, ", ".join(f"{k} {names[k]}" for k in key) + ", " + GARCH_SHAPE)


def garch_recursion(rows: DataFrame, omega: float, alpha: float, beta: float, value: str = "y", order: str = "i") -> DataFrame:
    """(signal_id, i, variance) of each demeaned series for given parameters, as a fold over its array."""
    m = X.with_stats(rows, _m=F.avg(value)).select(KEY, order, (F.col(value) - F.col("_m")).alias("_r"))
    arrays = m.groupBy(KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "_r"))), lambda s: s["_r"]).alias("r"))

    @F.pandas_udf("array<double>")
    def fold(r: pd.Series) -> pd.Series:
        return r.map(lambda x: garch_variance(np.asarray(x, float), omega, alpha, beta))

    return arrays.select(KEY, F.posexplode(fold("r")).alias(order, "variance")).withColumn(order, F.col(order).cast("bigint"))


def volatility_similarity(layer: DataFrame, pair: DataFrame, persistence: DataFrame | None = None, names: tuple = tuple(WEIGHTS)) -> DataFrame:
    """(a_id, b_id, trend, ..., score): .30 Pearson + .35 derivative + .20 distribution + .15 exp(-3 |difference of persistence|)."""
    out = series_similarity(layer.filter(F.col("trend").isin(*names)).select(KEY, "trend", "w", F.col("vol").alias("x")), pair).drop("overlap")
    if persistence is not None:
        for side in ("a", "b"):
            out = out.join(persistence.select(F.col(KEY).alias(f"{side}_id"), "trend", F.col("persistence").alias(f"_{side}")), [f"{side}_id", "trend"], "left")
        gap = F.abs(F.coalesce("_a", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0)))
        out = out.withColumn("garch", F.exp(-3 * gap)).drop("_a", "_b")
    else:
        out = out.withColumn("garch", F.lit(1.0))
    score = 0.30 * F.col("pearson") + 0.35 * F.col("derivative") + 0.20 * F.coalesce("distribution", F.lit(0.0)) + 0.15 * F.col("garch")
    return out.withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)))


def volatility_global(scores: DataFrame) -> DataFrame:
    return global_similarity(scores, WEIGHTS)


def blend(base, vol, weight: float = 0.15):
    """Similarity in percent with a share of the volatility's."""
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), (1 - weight) * base + weight * vol))
