"""Forecasts of series, their errors, and what fitted models tell."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fits import arma_fits, series_batches
from ..functions.kernels import adf, arma_forecast, find_peaks, hmm_fit, ridge_ar, viterbi
from ..functions.series import KEY, chunked, spread, tidy

#: Fixed values: (p, q) that predict_arima tries, in this order; d comes from the unit-root test.
ORDERS = ((1, 1), (1, 0), (0, 1), (1, 2), (2, 1), (2, 2), (3, 1), (3, 2), (3, 3), (4, 1), (4, 2), (0, 0), (2, 0), (0, 2))
MODELS = ("arima", "hmm", "ridge", "ridge_long")
PREDICTED = "model string, step bigint, forecast double, actual double, backend string, error string"


def metrics(df: DataFrame, key: list[str], truth: str = "actual", forecast: str = "forecast") -> DataFrame:
    """(key, rmse, mae, mse) of the steps that have both values."""
    e = F.col(truth) - F.col(forecast)
    return df.groupBy(*key).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"))


def predict_arima(trains: list[np.ndarray], h: int) -> list[tuple[np.ndarray, str]]:
    """For each series the order with the lowest AIC, or one within 10 of it with a lower BIC; the mean of the last five values where nothing fits."""
    out = [(np.full(h, x[-5:].mean()), "mean") for x in trains]
    own = [i for i, x in enumerate(trains) if len(x) >= max(10, h)]
    for i, fits in zip(own, arma_fits([trains[i] for i in own], [0 if adf(trains[i])[1] else 1 for i in own], ORDERS) if own else ()):
        best = None
        for f in fits:
            if np.isfinite(f["aic"]) and (best is None or f["aic"] < best["aic"] or (f["aic"] < best["aic"] + 10 and f["bic"] < best["bic"])):
                best = f
        ahead = arma_forecast(best, h) if best else np.full(h, np.nan)
        if np.isfinite(ahead).all():
            out[i] = ahead, "css"
    return out


def predict_hmm(train: np.ndarray, h: int, states: int = 3, seed: int = 42) -> tuple[np.ndarray, str]:
    """State means along the likeliest transitions from the last state; persistence for a constant series."""
    if train.std() < 1e-12 or len(train) < 15:
        return np.full(h, train[-1]), "persistence"
    best = None
    for k in sorted({max(2, states - 1), states, states + 1}):
        m = hmm_fit(train, k, seed, restarts=3, steps=30)
        size = k * k + 2 * k
        score = m["loglik"] - 0.5 * size * math.log(len(train)) - (1000 if (m["trans"].sum(1) < 0.5).any() else 0)
        if best is None or score > best[0]:
            best = (score, m)
    m = best[1]
    s = int(viterbi(train[-30:], m)[-1])
    out = []
    for _ in range(h):
        s = int(m["trans"][s].argmax())
        out.append(float(m["mean"][s, 0]))
    return np.array(out), "baum-welch"


ONE = {
    "hmm": lambda x, h: predict_hmm(x, h), "ridge": lambda x, h: (ridge_ar(x, 10, h), "ridge"), "ridge_long": lambda x, h: (ridge_ar(x, 30, h), "ridge"),
    "naive": lambda x, h: (np.full(h, x[-1]), "persistence"), "mean": lambda x, h: (np.full(h, x.mean()), "mean"),
}


def forecast_many(series: list[np.ndarray], h: int, models: tuple = MODELS) -> list[list[tuple]]:
    """For each series rows (model, step, forecast, actual, backend, error): fitted on all but the last h values, held against those."""
    unknown = set(models) - {"arima", *ONE}
    if unknown:
        raise ValueError(f"unknown models {sorted(unknown)}")
    series = [np.asarray(x, float) for x in series]
    long = [i for i, x in enumerate(series) if len(x) >= h + 5]
    arima = dict(zip(long, predict_arima([series[i][:-h] for i in long], h))) if "arima" in models else {}
    out = []
    for i, x in enumerate(series):
        rows = []
        for name in models:
            if len(x) < h + 5:
                rows += [(name, k, None, None, "none", "too short") for k in range(h)]
                continue
            error = None
            try:
                ahead, backend = arima[i] if name == "arima" else ONE[name](x[:-h], h)
            except (np.linalg.LinAlgError, FloatingPointError) as e:
                ahead, backend, error = np.zeros(h), "none", str(e)
            rows += [(name, k, float(ahead[k]), float(x[len(x) - h + k]), backend, error) for k in range(h)]
        out.append(rows)
    return out


def forecasts(rows: DataFrame, key: list[str], order: str, value: str, h: int = 20, models: tuple = MODELS) -> DataFrame:
    """(key, model, step, forecast, actual, backend, error) of every series; a task fits its series many at a time."""
    unknown = set(models) - {*MODELS, "naive", "mean"}
    if unknown:
        raise ValueError(f"unknown models {sorted(unknown)}")
    names = {f.name: f.dataType.simpleString() for f in rows.schema}
    columns = [*key, "model", "step", "forecast", "actual", "backend", "error"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, series in series_batches(frames, key, value):
            yield pd.DataFrame([(*k, *r) for k, own in zip(ids, forecast_many(series, h, models)) for r in own], columns=columns)

    dealt = spread(rows.select(*key, order, value), *key).sortWithinPartitions(*key, order)
    return dealt.mapInPandas(run, ", ".join(f"{k} {names[k]}" for k in key) + ", " + PREDICTED)


def naive(samples: DataFrame, h: int, key: str = KEY, order: str = "i", value: str = "y") -> DataFrame:
    """(signal_id, step, forecast, actual): the last value before the final h, carried on."""
    n = samples.groupBy(key).agg(F.count("*").alias("_n"))
    z = samples.join(n, key)
    last = z.filter(F.col(order) == F.col("_n") - h - 1).select(key, F.col(value).alias("forecast"))
    return z.filter(F.col(order) >= F.col("_n") - h).join(last, key).select(key, (F.col(order) - F.col("_n") + h).alias("step"), "forecast", F.col(value).alias("actual"))


def band_series(levels: DataFrame, frame: str = "w") -> DataFrame:
    """(signal_id, band, w, x): mean level of each band by frame, for forecasting band by band."""
    return levels.groupBy(KEY, "band", frame).agg(F.avg("level").alias("x"))


def band_errors(scores: DataFrame) -> DataFrame:
    """(signal_id, band, avg_rmse, min_rmse, best_model) of (signal_id, band, model, rmse), missing errors left out."""
    ok = scores.filter("rmse is not null")
    return ok.groupBy(KEY, "band").agg(F.avg("rmse").alias("avg_rmse"), F.min("rmse").alias("min_rmse"), F.min_by("model", F.struct("rmse", "model")).alias("best_model"))


def band_rank(errors: DataFrame) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(KEY).orderBy("avg_rmse", "band"))
    return errors.select(KEY, "band", "avg_rmse", place.cast("bigint").alias("rank"))


def arima_kind(p: Column, d: Column, q: Column) -> Column:
    return F.when(d >= 2, "trending").when(d == 1, "random walk").when(p >= 2, "oscillating").when((p == 1) & (q == 0), "mean reverting").when(q >= 1, "moving average").otherwise("noise")


def arima_structure(rows: DataFrame, key: list[str], order: str, value: str, max_p: int = 4, max_q: int = 2) -> DataFrame:
    """(key, p, d, q, stationary, aic, white, period, kind) of the order with the lowest AIC."""
    names = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(ids: tuple, df: pd.DataFrame) -> pd.DataFrame:
        x = df.sort_values(order)[value].to_numpy(float)
        n = len(x)
        out = dict(zip(key, ids)) | {"p": None, "d": None, "q": None, "stationary": None, "aic": None, "white": None, "period": None}
        if n >= 10 and x.std() > 1e-12:
            ok = adf(x, min(10, n // 3))[1]
            d = 0 if ok else 1
            best = min(arma_fits([x], [d], tuple((p, q) for p in range(max_p + 1) for q in range(max_q + 1)))[0], key=lambda f: f["aic"] if np.isfinite(f["aic"]) else math.inf)
            e = best["resid"]
            lags = max(2, min(10, len(e) // 4) // 2 * 2)
            r = correlations(e, lags)
            stat = len(e) * (len(e) + 2) * sum(r[k] ** 2 / (len(e) - k) for k in range(1, lags + 1))
            tail = math.exp(-stat / 2) * sum((stat / 2) ** j / math.factorial(j) for j in range(lags // 2))
            a = correlations(x, min(20, n // 2) - 1)[1:]
            at = find_peaks(a)
            period = int(at[np.argmax(a[at])]) + 1 if len(at) else None
            out |= {"p": best["order"][0], "d": d, "q": best["order"][2], "stationary": bool(ok), "aic": float(best["aic"]), "white": bool(tail > 0.05), "period": period}
        return pd.DataFrame([out])

    shape = ", ".join(f"{k} {names[k]}" for k in key) + ", p bigint, d bigint, q bigint, stationary boolean, aic double, white boolean, period bigint"
    found = spread(rows.select(*key, order, value), *key).groupBy(*key).applyInPandas(run, shape)
    return found.withColumn("kind", F.when(F.col("p").isNull(), "too short").otherwise(arima_kind(F.col("p"), F.col("d"), F.col("q"))))


def correlations(x: np.ndarray, nlags: int) -> np.ndarray:
    """Correlation of the overlapping pairs at lags 0 .. nlags."""
    out = [1.0]
    for k in range(1, nlags + 1):
        a, b = x[k:], x[:-k]
        out.append(float(np.corrcoef(a, b)[0, 1]) if len(a) > 1 and a.std() > 0 and b.std() > 0 else 0.0)
    return np.array(out)


def hmm_states(layer: DataFrame, names: tuple, states: int = 3, seed: int = 42, order: str = "w") -> DataFrame:
    """(signal_id, w, state, n_states, transitions): states by falling mean of the first trend; the transition matrix in the same order, row by row."""

    def run(ids: tuple, df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(order)
        x = df[list(names)].to_numpy(float)
        n = len(x)
        k = min(states, max(2, n // 6), max(2, n // 8)) if n >= 4 else 1
        if k < 2 or x.std() < 1e-12:
            return pd.DataFrame({KEY: ids[0], order: df[order], "state": 0, "n_states": 1, "transitions": [[1.0]] * n})
        m = hmm_fit(x, k, seed, restarts=5, steps=60)
        by = np.argsort(-m["mean"][:, 0], kind="stable")
        new = np.argsort(by)
        flat = m["trans"][np.ix_(by, by)].ravel().tolist()
        return pd.DataFrame({KEY: ids[0], order: df[order], "state": new[m["states"]], "n_states": k, "transitions": [flat] * n})

    return spread(layer.select(KEY, order, *names), KEY).groupBy(KEY).applyInPandas(run, f"{KEY} string, {order} bigint, state bigint, n_states bigint, transitions array<double>")


def state_profile(states: DataFrame, layer: DataFrame, names: tuple, order: str = "w", state: str = "state") -> DataFrame:
    """(signal_id, state, windows, fraction, mean of each trend)."""
    z = states.select(KEY, order, state).join(layer, [KEY, order])
    total = z.groupBy(KEY).agg(F.count("*").alias("_t"))
    s = z.groupBy(KEY, state).agg(F.count("*").alias("windows"), *(F.avg(c).alias(f"mean_{c}") for c in names))
    return s.join(total, KEY).select(KEY, state, "windows", (F.col("windows") / F.col("_t")).alias("fraction"), *(f"mean_{c}" for c in names))


def label_states(profile: DataFrame, layer: DataFrame) -> DataFrame:
    """profile (signal_id, mean_energy, mean_brightness, mean_complexity, mean_rhythm) with ``word``: the first that fits of climax, calm, intense, active, transition, bright; else stable.

    Limits are percentiles of the signal's energy and rhythm; brightness is held
    against those of rhythm, and complexity against those of energy.
    """
    p = layer.groupBy(KEY).agg(*(F.percentile(c, F.lit(q)).alias(a) for a, c, q in (("_eh", "energy", 0.7), ("_el", "energy", 0.3), ("_rh", "rhythm", 0.7), ("_rl", "rhythm", 0.3), ("_et", "energy", 0.75))))
    e, b, c, r = (F.col(f"mean_{k}") for k in ("energy", "brightness", "complexity", "rhythm"))
    word = (
        F.when((e >= F.col("_eh")) & (r >= F.col("_rh")), "climax").when((e <= F.col("_el")) & (r <= F.col("_rl")), "calm").when(e >= F.col("_eh"), "intense")
        .when(r >= F.col("_rh"), "active").when(c >= F.col("_et"), "transition").when(b >= F.col("_rh"), "bright").otherwise("stable")
    )
    return profile.join(p, KEY).withColumn("word", word).drop("_eh", "_el", "_rh", "_rl", "_et")


def state_changes(states: DataFrame, order: str = "w", state: str = "state") -> DataFrame:
    """(signal_id, states, changes): different states that are entered from another one, and the first; and how often the state changes."""
    df, w, core = chunked(states.select(KEY, order, state), 1, 0, order=order)
    z = tidy(df.withColumn("_b", F.lag(state).over(w)), core)
    entered = F.when(F.col("_b") != F.col(state), F.col(state))
    return z.groupBy(KEY).agg((F.countDistinct(entered) + 1).alias("states"), F.count(entered).alias("changes"))


def common_lags(found: DataFrame) -> DataFrame:
    """(lags, mode): different lags among peaks (signal_id, rank, lag) of all signals, and the commonest, the least of equals."""
    return found.agg(F.countDistinct("lag").alias("lags"), F.mode("lag", True).alias("mode"))


def ensemble(layer: DataFrame, names: tuple, hop: float = 0.25, trends_: tuple = ("energy", "rhythm")) -> DataFrame:
    """(signal_id, trend, kind, period, regime, lags, quality, words): what ARIMA structure, hidden states, lookback and lag profile say of each trend."""
    series = layer.unpivot([KEY, "w"], list(trends_), "trend", "x")
    key = [KEY, "trend"]
    kind = arima_structure(series, key, "w", "x").select(*key, "kind", "period")
    regime = lookback_insights(series, key, "w", "x", hop=hop).groupBy(*key).agg(F.first("regime").alias("regime"))
    lags = lag_profile(series, key, "w", "x").groupBy(*key).agg(F.array_sort(F.collect_list(F.concat_ws(" ", "bucket", F.col("lag").cast("string")))).alias("lags"))
    quality = state_quality(hmm_states(layer, names), layer, names)
    z = kind.join(regime, key, "left").join(lags, key, "left").join(quality, KEY, "left")
    words = F.concat_ws("; ", F.concat(F.lit("structure: "), "kind"), F.concat(F.lit("memory: "), "regime"), F.concat(F.lit("lags: "), F.array_join("lags", ", ")), F.when(F.col("quality") > 1, "states well apart").otherwise("states overlap"))
    return z.withColumn("words", words)


def state_quality(states: DataFrame, layer: DataFrame, names: tuple, order: str = "w", state: str = "state") -> DataFrame:
    """(signal_id, quality): variance between states, weighted by their size, over the sum of the variances within them."""
    z = states.select(KEY, order, state).join(layer, [KEY, order])
    long = z.unpivot([KEY, state], list(names), "trend", "x")
    whole = long.groupBy(KEY, "trend").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    part = long.groupBy(KEY, state, "trend").agg(F.avg("x").alias("ms"), F.var_pop("x").alias("vs"), F.count("*").alias("ns"))
    s = part.join(whole, [KEY, "trend"]).groupBy(KEY).agg(F.sum(F.col("ns") / F.col("n") * F.pow(F.col("ms") - F.col("m"), F.lit(2))).alias("between"), F.sum("vs").alias("within"))
    return s.select(KEY, (F.col("between") / (F.col("within") + 1e-12)).alias("quality"))


def lookback_insights(rows: DataFrame, key: list[str], order: str, value: str, lookbacks: tuple = (10, 20, 30), h: int = 10, hop: float = 0.25) -> DataFrame:
    """(key, lookback, loss, optimal, decay, regime): error of the ridge forecast by lookback; the optimum is where a longer one gains little."""
    names = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(ids: tuple, df: pd.DataFrame) -> pd.DataFrame:
        x = df.sort_values(order)[value].to_numpy(float)
        out = []
        if len(x) >= 20:
            z = (x - x.mean()) / (x.std() + 1e-12)
            steps = min(h, max(1, len(z) // 5))
            loss = [float(np.mean((ridge_ar(z[:-steps], b, steps) - z[-steps:]) ** 2)) for b in lookbacks]
            best = lookbacks[0]
            first = loss[0] - loss[1] if len(loss) > 1 else 0.0
            for j in range(1, len(lookbacks)):
                gain = loss[j - 1] - loss[j]
                if gain <= 0 or (first > 0 and gain < 0.2 * first):
                    break
                best = lookbacks[j]
            out = [(*ids, b, e, best) for b, e in zip(lookbacks, loss)]
        return pd.DataFrame(out, columns=[*key, "lookback", "loss", "optimal"])

    shape = ", ".join(f"{k} {names[k]}" for k in key) + ", lookback bigint, loss double, optimal bigint"
    found = spread(rows.select(*key, order, value), *key).groupBy(*key).applyInPandas(run, shape)
    seconds = F.col("optimal") * hop
    return found.withColumn("decay", F.exp(-1 / F.col("optimal"))).withColumn("regime", F.when(seconds < 1, "short").when(seconds < 3, "medium").otherwise("long"))


#: Concentrations that stand for the three ranges of lags.
CONCENTRATION = {"short": 0.8, "medium": 0.6, "long": 0.5}


def lag_profile(rows: DataFrame, key: list[str], order: str, value: str, cap: int = 200) -> DataFrame:
    """(key, bucket, lag, concentration): median lag of the correlation's peaks among short, medium and long lags."""
    names = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(ids: tuple, df: pd.DataFrame) -> pd.DataFrame:
        x = df.sort_values(order)[value].to_numpy(float)[:cap]
        out = []
        if len(x) >= 10:
            r = correlations(x, min(40, len(x) - 1) - 1)
            for p in find_peaks(r, distance=2, prominence=0.3 * 1.96 / math.sqrt(len(x))):
                out.append((*ids, int(p)))
        return pd.DataFrame(out, columns=[*key, "lag"])

    found = spread(rows.select(*key, order, value), *key).groupBy(*key).applyInPandas(run, ", ".join(f"{k} {names[k]}" for k in key) + ", lag bigint")
    bucket = F.when(F.col("lag") < 5, "short").when(F.col("lag") < 16, "medium").otherwise("long")
    table = F.create_map(*(F.lit(v) for kv in CONCENTRATION.items() for v in kv))
    return found.groupBy(*key, bucket.alias("bucket")).agg(F.median("lag").cast("bigint").alias("lag")).withColumn("concentration", table[F.col("bucket")])
