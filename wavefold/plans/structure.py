"""Queries on spectra, similarity, unsupervised structure, reports and forecasts, with their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import series as X
from ..operators import discovery, forecast, framing, similarity, spectral, trends, unsupervised, volatility
from ..sinks import registry
from ..sources import signals
from .core import A, B, DFT, FA, HOP, LAYER, LONG4, SEGMENTS, WIN, layer, r, sr_
from .sql import peaks as peaks_sql
from .sql import simple_errors

PAIRS = [("click", "purchase"), ("click", "view"), ("purchase", "view")]


def spec(spark, d):
    return spectral.spectra(signals.by_type(spark, d), WIN, HOP)


def described(spark, d):
    return spectral.descriptors(spec(spark, d))


def _one(name, column=None):
    def query(spark, d):
        return described(spark, d).select("signal_id", "w", *r(column or name.removeprefix("spectral_")))

    query.__name__ = name
    return query


spectral_centroid, spectral_flatness, spectral_rolloff, spectral_bandwidth = map(_one, ("spectral_centroid", "spectral_flatness", "spectral_rolloff", "spectral_bandwidth"))


def spectral_entropy(spark, d):
    return described(spark, d).select("signal_id", "w", *r("entropy_bits", "entropy"))


def chroma_profile(spark, d):
    return spectral.chroma(spec(spark, d)).select("signal_id", "w", "pitch", *r("share"))


def dominant_frequency(spark, d):
    return spectral.dominant(signals.by_user(spark, d)).select("signal_id", *r("freq", "period"), "period_samples")


def spectrum(spark, d):
    return spectral.fft(signals.by_user(spark, d)).withColumn("level", 20 * F.log10(F.col("mag") + 1e-10)).select("signal_id", "bin", *r("freq", "level", d=5))


def flatness_global(spark, d):
    return spectral.flatness_global(signals.by_user(spark, d)).select("signal_id", *r("flatness"))


def mel_energy(spark, d):
    return spectral.mel_levels(spec(spark, d), 9, 33, 16000.0).select("signal_id", "w", "mel", *r("level"))


def mel_bands(spark, d):
    return spectral.mel_bands(spectral.mel_levels(spec(spark, d), 9, 33, 16000.0), 9).select("signal_id", "w", "band", *r("level"))


def mel_spectrogram(spark, d):
    z = spectral.mel_spectrogram(signals.by_type(spark, d), 16000.0, 16, 256, 64)
    return z.select("signal_id", "frame", F.transform("values", lambda x: F.round(x, 5)).alias("levels"))


def mfcc(spark, d):
    z = spectral.mfcc(signals.by_type(spark, d), 16000.0, 13, 20, 256, 64)
    return z.select("signal_id", "frame", F.transform("values", lambda x: F.round(x, 5)).alias("coefficients"))


def stft(spark, d):
    z = spectral.stft(signals.by_type(spark, d), 256, 64)
    return z.select("signal_id", "frame", F.posexplode("values").alias("bin", "mag")).select("signal_id", "frame", F.col("bin").cast("bigint").alias("bin"), *r("mag"))


def asked(spark, d):
    """Pairs of users with neighbouring numbers."""
    u = signals.by_user(spark, d).select(F.col("signal_id").cast("bigint").alias("u")).distinct()
    return u.select(F.col("u").cast("string").alias("a_id"), (F.col("u") + 1).cast("string").alias("b_id")).join(u.select(F.col("u").cast("string").alias("b_id")), "b_id").select("a_id", "b_id")


def paired(spark, d):
    s = signals.by_user(spark, d)
    a = asked(spark, d).join(s.withColumnRenamed("signal_id", "a_id").withColumnRenamed("y", "a"), "a_id")
    return a.join(s.withColumnRenamed("signal_id", "b_id").withColumnRenamed("y", "b"), ["b_id", "i"])


def pearson_pairs(spark, d):
    return paired(spark, d).groupBy("a_id", "b_id").agg(F.round(X.corr("a", "b"), 6).alias("pearson"))


def spearman_pairs(spark, d):
    key = ["a_id", "b_id"]
    z = X.ranks(X.ranks(paired(spark, d), "a", "ra", key), "b", "rb", key)
    return z.groupBy(*key).agg(F.round(X.corr("ra", "rb"), 6).alias("spearman"))


def derivative_corr(spark, d):
    key = ["a_id", "b_id"]
    z = X.gradient(X.gradient(paired(spark, d), "a", "da", key), "b", "db", key)
    return z.groupBy(*key).agg(F.round(X.corr("da", "db"), 6).alias("derivative"))


def distribution_emd(spark, d):
    key = ["a_id", "b_id"]
    s, p = signals.by_user(spark, d), asked(spark, d)
    a, b = (p.join(s.withColumnRenamed("signal_id", f"{k}_id"), f"{k}_id").select(*key, F.col("y").alias("x")) for k in ("a", "b"))
    return X.histogram_distance(a, b, key, "x", F.lit(30)).select(*key, *r("emd"), F.round(F.exp(-2 * F.col("emd")), 6).alias("similarity"))


def type_pairs(spark):
    return trends.pairs(spark, PAIRS)


def contrast_report(spark, d):
    z = discovery.contrast(layer(spark, d), type_pairs(spark))
    return z.select("a_id", "b_id", "trend", *r("mean_a", "mean_b", "ratio", "overlap", "confidence"), "kind")


def trend_similarity(spark, d):
    z = trends.trend_similarity(layer(spark, d), type_pairs(spark))
    return z.select("a_id", "b_id", "trend", *r("pearson", "spearman", "derivative", "distribution", "overlap", "score", d=5))


def dynamics_similarity(spark, d):
    s = trends.trend_similarity(layer(spark, d), type_pairs(spark))
    return trends.global_similarity(s).select("a_id", "b_id", *r("similarity", "coherence", d=4), "dominant")


def volatility_similarity(spark, d):
    v = volatility.volatility_layer(trends.long(layer(spark, d))).persist()
    return volatility.volatility_global(volatility.volatility_similarity(v, type_pairs(spark))).select("a_id", "b_id", *r("similarity", "coherence", d=4), "dominant")


def vec(spark, d):
    return signals.vectors(spark, d)


def vec_pair(spark):
    """Every label beside the next one."""
    return trends.pairs(spark, [(str(k), str((k + 1) % 10)) for k in range(10)])


def similarity_matrix(spark, d):
    return similarity.similarity_matrix(vec(spark, d), vec_pair(spark), digits=6).select("a_id", "a_w", "b_w", "sim")


def best_match(spark, d):
    return similarity.nearest(vec(spark, d), vec_pair(spark)).filter("sim > 0.05").select("a_id", "a_w", "b_w", *r("sim"))


def weights(rows):
    return rows.select("signal_id", "w", F.aggregate("x", F.lit(0.0), lambda a, x: a + F.abs(x)).alias("spectral_entropy"))


def entropy_weighted_match(spark, d):
    v = vec(spark, d)
    dist = similarity.median_distance(similarity.distribution_distance(v, vec_pair(spark), "difference"))
    z = similarity.aggregate(similarity.nearest(v, vec_pair(spark), back=True), vec_pair(spark), weights(v), dist)
    return z.select("a_id", "b_id", *r("simple", "weighted", "distribution", "similarity"))


def distribution_distance(spark, d):
    return similarity.distribution_distance(vec(spark, d), vec_pair(spark)).select("a_id", "dim", *r("distance"))


def js_distance(spark, d):
    return similarity.distribution_distance(vec(spark, d), vec_pair(spark), "js").select("a_id", "dim", *r("distance"))


def whitened_similarity(spark, d):
    return similarity.whitened(vec(spark, d), vec_pair(spark), digits=6).select("a_id", "a_w", "b_w", "sim")


def numbered(spark, d):
    """Feature rows of each label, numbered in order of vec_id."""
    w = Window.partitionBy("signal_id").orderBy("w")
    return vec(spark, d).withColumn("w", F.row_number().over(w).cast("bigint") - 1)


def self_similarity_lags(spark, d):
    return similarity.self_similarity(numbered(spark, d), 5).select("signal_id", "lag", "w", *r("sim"))


def novelty_curve(spark, d):
    return similarity.novelty(numbered(spark, d)).select("signal_id", "w", *r("novelty"))


def window_features(spark, d):
    z = similarity.window_features(signals.by_type(spark, d), WIN, HOP)
    return z.select("signal_id", "w", F.size("x").alias("features"), *r("onset_density", "rms_energy", "peak_to_rms", "spectral_centroid"))


def climax_windows(spark, d):
    return similarity.climaxes(similarity.window_features(signals.by_type(spark, d), WIN, HOP)).select("signal_id", "w", *r("rms_energy", "onset_density"))


def annotated_matches(spark, d):
    f = similarity.window_features(signals.by_type(spark, d), WIN, HOP).persist()
    best = similarity.nearest(f.select("signal_id", "w", "x"), type_pairs(spark)).filter("sim > 0.7")
    return similarity.annotate(best, f).drop("sim")


def motif_profile(spark, d):
    return unsupervised.motif_profile(numbered(spark, d), 3).select("signal_id", "j", *r("distance", d=5))


def motif_report(spark, d):
    found, _ = unsupervised.motifs(unsupervised.motif_profile(numbered(spark, d), 3), 0.75, 0.25)
    return found.select("signal_id", "pattern_index", "occurrences", *r("significance", d=5))


def discord_report(spark, d):
    return unsupervised.motifs(unsupervised.motif_profile(numbered(spark, d), 3), 0.75, 0.25)[1].select("signal_id", "j", *r("distance", d=5))


def change_score(spark, d):
    z = signals.by_user(spark, d).select("signal_id", F.col("i").alias("w"), F.array("y").alias("x"))
    return unsupervised.change_score(z, 3).select("signal_id", "w", *r("score", d=4))


def change_points(spark, d):
    z = layer(spark, d).select("signal_id", "w", F.array("energy_norm", "complexity_norm").alias("x"))
    return unsupervised.change_points(z, 0.25).select("signal_id", "w", *r("score", d=4))


def segment_report(spark, d):
    base = layer(spark, d)
    points = unsupervised.change_points(base.select("signal_id", "w", F.array("energy_norm", "complexity_norm").alias("x")), 0.25)
    s = unsupervised.build_segments(points, base, 0.25, trends.segments(base))
    return unsupervised.characterise(s).select("signal_id", "start", "end", "windows", "label", "energy_word", "rhythm_word")


def recurrence(spark, d):
    z = signals.by_user(spark, d).select("signal_id", F.col("i").alias("w"), F.array("y").alias("x"))
    out = unsupervised.recurrence(z)
    return out.select("signal_id", *r("recurrence_rate", "determinism", "laminarity", "mean_diag_length", "trapping_time", "entropy_diag"), "level")


def mahalanobis_outliers(spark, d):
    z = signals.vectors(spark, d).select(F.lit("all").alias("signal_id"), "w", F.col("x")[0].alias("a"), F.col("x")[1].alias("b"))
    return unsupervised.anomalies(unsupervised.mahalanobis_2d(z, "a", "b"), top=None).select("w", *r("score"))


def mahalanobis_scores(spark, d):
    return unsupervised.mahalanobis(signals.vectors(spark, d)).select("signal_id", "w", *r("score", d=5))


def kmeans_profile(spark, d):
    z = signals.vectors(spark, d)
    return unsupervised.cluster_profile(unsupervised.clusters(z), z).select("cluster", "size", *r("fraction"), "first", "last")


def silhouette(spark, d):
    z = signals.vectors(spark, d)
    return unsupervised.silhouette(unsupervised.clusters(z).persist(), z).select(*r("silhouette"))


def nmf_components(spark, d):
    z = unsupervised.factors(signals.vectors(spark, d))
    return z.select("signal_id", "component", *r("weight", "relative_error", d=4), "character")


def pca_variance(spark, d):
    return unsupervised.principal(signals.vectors(spark, d)).select("signal_id", "component", *r("variance", "share"))


def characters(spark, d):
    return discovery.character(layer(spark, d)).select("signal_id", "rhythm", *r("bpm"), "pace", "energy", "timbre", "purity")


def self_motifs(spark, d):
    return discovery.self_motifs(layer(spark, d)).select("signal_id", "lag", "p", *r("sim"))


def corresponding_segments(spark, d):
    return discovery.corresponding(layer(spark, d), type_pairs(spark)).select("a_id", "b_id", "trend", "a_w", "b_w", "width", *r("confidence", d=4), "tier")


def pair_overview(spark, d):
    base = layer(spark, d)
    cross = discovery.cross_summary(discovery.corresponding(base, type_pairs(spark)), type_pairs(spark))
    return discovery.overview(cross, discovery.contrast(base, type_pairs(spark)))


def standout_trends(spark, d):
    return discovery.standout(layer(spark, d)).select("signal_id", "rank", "trend", *r("range_pct"))


def forecast_naive_metrics(spark, d):
    z = forecast.naive(signals.by_user(spark, d), 10)
    return forecast.metrics(z, ["signal_id"]).select("signal_id", *r("rmse", "mae", "mse", d=5))


def model_forecasts(spark, d):
    z = forecast.forecasts(signals.by_user(spark, d), ["signal_id"], "i", "y", 10, ("ridge", "ridge_long", "naive", "mean"))
    return z.select("signal_id", "model", "step", *r("forecast", "actual", d=5), "backend")


def arima_forecast(spark, d):
    z = forecast.forecasts(signals.by_user(spark, d), ["signal_id"], "i", "y", 10, ("arima",))
    return forecast.metrics(z, ["signal_id", "model"]).select("signal_id", "model", *r("rmse", "mae", d=4))


def hmm_forecast(spark, d):
    z = forecast.forecasts(signals.by_user(spark, d), ["signal_id"], "i", "y", 10, ("hmm",))
    return forecast.metrics(z, ["signal_id", "model"]).select("signal_id", "model", *r("rmse", "mae", d=4))


def arima_structure(spark, d):
    z = trends.long(layer(spark, d), ("energy", "complexity"))
    return forecast.arima_structure(z, ["signal_id", "trend"], "w", "x").select("signal_id", "trend", "p", "d", "q", "kind", "period")


NORMS = ("energy_norm", "brightness_norm", "complexity_norm", "rhythm_norm")


def hmm_states(spark, d):
    return forecast.hmm_states(layer(spark, d), NORMS).select("signal_id", "w", "state", "n_states")


def hmm_state_quality(spark, d):
    base = layer(spark, d)
    return forecast.state_quality(forecast.hmm_states(base, NORMS).persist(), base, NORMS).select("signal_id", *r("quality", d=4))


def state_profile(spark, d):
    base = layer(spark, d)
    z = forecast.state_profile(trends.segments(base), base, ("energy", "complexity"), state="label")
    return z.select("signal_id", "label", "windows", *r("fraction", "mean_energy", "mean_complexity"))


def lookback_insights(spark, d):
    z = forecast.lookback_insights(trends.long(layer(spark, d), ("energy", "rhythm")), ["signal_id", "trend"], "w", "x")
    return z.select("signal_id", "trend", "lookback", *r("loss", "decay", d=4), "optimal", "regime")


def lag_profile(spark, d):
    return forecast.lag_profile(trends.long(layer(spark, d), ("energy", "rhythm")), ["signal_id", "trend"], "w", "x")


def scores(spark, d):
    """Errors of two forecasts of each band's level."""
    z = forecast.band_series(spectral.mel_bands(spectral.mel_levels(spec(spark, d), 9, 33, 16000.0), 9))
    return forecast.metrics(forecast.forecasts(z, ["signal_id", "band"], "w", "x", 5, ("naive", "mean")), ["signal_id", "band", "model"])


def band_error_summary(spark, d):
    return forecast.band_errors(scores(spark, d)).select("signal_id", "band", *r("avg_rmse", "min_rmse", d=4), "best_model")


def band_rank(spark, d):
    return forecast.band_rank(forecast.band_errors(scores(spark, d))).select("signal_id", "band", *r("avg_rmse"), "rank")


def band_forecasts(spark, d):
    z = forecast.band_series(spectral.mel_bands(spectral.mel_levels(spec(spark, d), 9, 33, 16000.0), 9))
    f = forecast.forecasts(z, ["signal_id", "band"], "w", "x", 5, ("ridge", "naive", "mean"))
    return forecast.band_errors(forecast.metrics(f, ["signal_id", "band", "model"])).select("signal_id", "band", *r("avg_rmse", "min_rmse", d=5), "best_model")


def delay_embedding(spark, d):
    z = signals.by_user(spark, d).select("signal_id", F.col("i").alias("w"), F.array("y").alias("x"))
    return framing.embed(z, 3, 2).select("signal_id", "j", *(F.round(F.col("e")[k], 6).alias(f"e{k}") for k in range(3)))


def experiments_upsert(spark, d):
    t = spark.sql("SELECT * FROM VALUES ('a', 't1', 1L, 1L), ('b', 't2', 2L, 2L) AS t(name, task_id, created_at, updated_at)")
    n = spark.sql("SELECT * FROM VALUES ('b ', 't3', 5L), ('c', 't4', 6L) AS t(name, task_id, at)")
    return registry.upsert(t, n)


def experiments_delete(spark, d):
    return registry.delete(experiments_upsert(spark, d), "a")


def history_join(spark, d):
    res = spark.sql("SELECT * FROM VALUES ('t1', 10L), ('t2', 20L), ('t3', 5L) AS t(task_id, modified)")
    info = spark.sql("SELECT * FROM VALUES ('t1', 'first', 'x.wav'), ('t2', NULL, 'y.wav') AS t(task_id, title, audio1)")
    return registry.history(res, info)


def json_results(spark, d):
    return registry.as_json(trends.segments(layer(spark, d)).groupBy("signal_id").agg(F.count("*").alias("windows")), ["signal_id"])


FULL = "z AS (SELECT signal_id, w, b, b / 64.0 AS fr, m, m / (t + 1e-10) AS p, t, am, gm, sum(m) OVER (PARTITION BY signal_id, w ORDER BY b) AS cu FROM bins JOIN tot USING (signal_id, w))"
SPEC = f"{FA}, {DFT}"
ASKED = f"{B}, u AS (SELECT DISTINCT CAST(signal_id AS BIGINT) AS u FROM s), pr AS (SELECT x.u::VARCHAR AS a_id, y.u::VARCHAR AS b_id FROM u x JOIN u y ON y.u = x.u + 1)"
PAIRED = f"{ASKED}, pd AS (SELECT a_id, b_id, a.i, a.y AS a, b.y AS b FROM pr JOIN s a ON a.signal_id = a_id JOIN s b ON b.signal_id = b_id AND b.i = a.i)"
CORR = "CASE WHEN stddev_pop({a}) > 0 AND stddev_pop({b}) > 0 THEN covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) ELSE 0 END"
GRAD = "CASE WHEN lag({x}) OVER p IS NULL THEN lead({x}) OVER p - {x} WHEN lead({x}) OVER p IS NULL THEN {x} - lag({x}) OVER p ELSE (lead({x}) OVER p - lag({x}) OVER p) / 2 END"
EMD = (
    "rg AS (SELECT {key}, min(x) AS lo, max(x) AS hi, max({bins}) AS nb FROM xa GROUP BY ALL), "
    "ha AS (SELECT {key}, least(floor((x - lo) / (hi - lo) * nb), nb - 1)::BIGINT AS bin, count(*) AS c FROM xa JOIN rg USING ({key}) GROUP BY ALL), "
    "hb AS (SELECT {key}, least(floor((x - lo) / (hi - lo) * nb), nb - 1)::BIGINT AS bin, count(*) AS c FROM xb JOIN rg USING ({key}) WHERE x BETWEEN lo AND hi GROUP BY ALL), "
    "hg AS (SELECT {key}, lo, hi, nb, unnest(range(nb::BIGINT)) AS bin FROM rg), "
    "hz AS (SELECT {key}, lo, hi, nb, bin, coalesce(ha.c, 0) AS ca, coalesce(hb.c, 0) AS cb FROM hg LEFT JOIN ha USING ({key}, bin) LEFT JOIN hb USING ({key}, bin)), "
    "hc AS (SELECT {key}, lo, hi, nb, sum(ca) OVER o / sum(ca) OVER q - sum(cb) OVER o / nullif(sum(cb) OVER q, 0) AS gap, sum(cb) OVER q AS inb FROM hz WINDOW o AS (PARTITION BY {key} ORDER BY bin), q AS (PARTITION BY {key})), "
    "emd AS (SELECT {key}, CASE WHEN max(inb) > 0 THEN sum(abs(gap)) * max((hi - lo) / nb) END AS emd FROM hc GROUP BY {key})"
)
PR = "pr(a_id, b_id) AS (VALUES ('click', 'purchase'), ('click', 'view'), ('purchase', 'view'))"
KEY3 = "a_id, b_id, trend"
SIMILAR = (
    "nl AS (SELECT signal_id, trend, count(*) AS n FROM lg GROUP BY 1, 2), tl AS (SELECT a_id, b_id, x.trend, greatest(50, least(300, (x.n + y.n) // 2)) AS t, x.n AS na, y.n AS nb FROM pr JOIN nl x ON x.signal_id = a_id JOIN nl y ON y.signal_id = b_id AND y.trend = x.trend), "
    "gr AS (SELECT *, unnest(range(t)) AS k FROM tl), gp AS (SELECT *, k * (na - 1) / (t - 1) AS pa, k * (nb - 1) / (t - 1) AS pb FROM gr), "
    "al AS (SELECT g.a_id, g.b_id, g.trend, g.t, k, a0.x + (pa - floor(pa)) * (a1.x - a0.x) AS a, b0.x + (pb - floor(pb)) * (b1.x - b0.x) AS b FROM gp g "
    "JOIN lg a0 ON a0.signal_id = a_id AND a0.trend = g.trend AND a0.w = floor(pa) JOIN lg a1 ON a1.signal_id = a_id AND a1.trend = g.trend AND a1.w = least(floor(pa) + 1, na - 1) "
    "JOIN lg b0 ON b0.signal_id = b_id AND b0.trend = g.trend AND b0.w = floor(pb) JOIN lg b1 ON b1.signal_id = b_id AND b1.trend = g.trend AND b1.w = least(floor(pb) + 1, nb - 1)), "
    f"al2 AS (SELECT *, rank() OVER (PARTITION BY {KEY3} ORDER BY a) + (count(*) OVER (PARTITION BY {KEY3}, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY {KEY3} ORDER BY b) + (count(*) OVER (PARTITION BY {KEY3}, b) - 1) / 2.0 AS rb, {GRAD.format(x='a')} AS da, {GRAD.format(x='b')} AS db FROM al WINDOW p AS (PARTITION BY {KEY3} ORDER BY k)), "
    f"cr AS (SELECT {KEY3}, greatest(0, {CORR.format(a='a', b='b')}) AS pearson, greatest(0, {CORR.format(a='ra', b='rb')}) AS spearman, greatest(0, {CORR.format(a='da', b='db')}) AS derivative FROM al2 GROUP BY ALL), "
    f"xa AS (SELECT {KEY3}, a AS x, least(30, greatest(10, t // 5)) AS bn FROM al), xb AS (SELECT {KEY3}, b AS x FROM al), {EMD.format(key=KEY3, bins='bn')}, "
    f"sc AS (SELECT {KEY3}, pearson, spearman, derivative, exp(-2 * emd) AS distribution FROM cr LEFT JOIN emd USING ({KEY3}))"
)
SIDES = f"sd2 AS (SELECT {KEY3}, side, t, k, (v - min(v) OVER q) / (max(v) OVER q - min(v) OVER q + 1e-12) AS v FROM (SELECT {KEY3}, 'a' AS side, t, k, a AS v FROM al UNION ALL SELECT {KEY3}, 'b', t, k, b FROM al) WINDOW q AS (PARTITION BY {KEY3}, side))"
OVERLAP = (
    f"{SIDES}, {peaks_sql('pk', 'sd2', KEY3 + ', side', 'k', 'v', height='0.6', distance='greatest(1, n // 20)')}, "
    f"ov AS (SELECT {KEY3}, count(*) FILTER (WHERE m = 2) / count(*) AS overlap FROM (SELECT {KEY3}, p, count(*) AS m FROM pk GROUP BY ALL) GROUP BY ALL)"
)
SCORED = f"{OVERLAP}, ss AS (SELECT {KEY3}, pearson, spearman, derivative, distribution, coalesce(overlap, 1.0) AS overlap, least(1, greatest(0, 0.15 * pearson + 0.15 * spearman + 0.35 * derivative + 0.25 * coalesce(overlap, 1) + 0.10 * coalesce(distribution, 0)))::DOUBLE AS score FROM sc LEFT JOIN ov USING ({KEY3}))"
GLOBAL = "sum(score * CASE trend WHEN 'energy' THEN {0} WHEN 'brightness' THEN {1} WHEN 'complexity' THEN {2} ELSE {3} END)"
VSCORED = "ss AS (SELECT *, least(1, greatest(0, 0.30 * pearson + 0.35 * derivative + 0.20 * coalesce(distribution, 0) + 0.15))::DOUBLE AS score FROM sc)"


def _global(w: tuple) -> str:
    return f"SELECT a_id, b_id, round(least(1, greatest(0, {GLOBAL.format(*w)})) * 100, 4) AS similarity, round(1 - stddev_pop(score), 4) AS coherence, arg_max(trend, score) AS dominant FROM ss GROUP BY 1, 2"


VOLATILE = (
    "lw AS (SELECT *, least(10, greatest(2, count(*) OVER (PARTITION BY signal_id, trend) // 3)) AS wd FROM l0), "
    "lg AS (SELECT p.signal_id, p.w, p.trend, stddev_pop(o.x) AS x FROM lw p JOIN l0 o ON o.signal_id = p.signal_id AND o.trend = p.trend AND CASE WHEN p.w < p.wd - 1 THEN o.w <= p.w + 1 ELSE o.w BETWEEN p.w - p.wd + 1 AND p.w END GROUP BY 1, 2, 3)"
)
VEC = "v AS (SELECT label::VARCHAR AS signal_id, vec_id AS w, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"
DOT = "list_inner_product({a}, {b})"
VPAIRS = "vp AS (SELECT range::VARCHAR AS a_id, ((range + 1) % 10)::VARCHAR AS b_id FROM range(10))"
UNIT = f"{VEC}, {VPAIRS}, un AS (SELECT signal_id, w, list_transform(x, lambda q: q / (sqrt(list_inner_product(x, x)) + 1e-12)) AS u FROM v), sm AS (SELECT a_id, b_id, a.w AS a_w, b.w AS b_w, exp(-3 * (1 - list_inner_product(a.u, b.u)) ** 2) AS sim FROM vp JOIN un a ON a.signal_id = a_id JOIN un b ON b.signal_id = b_id)"
NUM = f"{VEC}, nv AS (SELECT signal_id, row_number() OVER (PARTITION BY signal_id ORDER BY w) - 1 AS w, x FROM v)"
DIMS = (
    f"{VEC}, {VPAIRS}, dm AS (SELECT signal_id, d, x[d + 1] AS v FROM (SELECT *, unnest(range(len(x))) AS d FROM v)), ds AS (SELECT signal_id, d, avg(v) AS m, stddev_pop(v) AS sd, stddev_samp(v) AS ss, count(*) AS n, min(v) AS lo, max(v) AS hi FROM dm GROUP BY 1, 2), "
    "st AS (SELECT a_id, b_id, d, a.m AS ma, b.m AS mb, a.sd AS da, b.sd AS db, a.n AS na, b.n AS nb, a.ss AS sa, b.ss AS sb, least(a.lo, b.lo) AS lo, greatest(a.hi, b.hi) AS hi FROM vp JOIN ds a ON a.signal_id = a_id JOIN ds b USING (d) WHERE b.signal_id = b_id)"
)
JS = (
    "gr AS (SELECT a_id, b_id, d, g, lo + g * (hi - lo) / 199 AS gx, greatest(sa, 1e-9) * na ** -0.2 AS ha, greatest(sb, 1e-9) * nb ** -0.2 AS hb FROM st, range(200) AS q(g)), "
    "pa AS (SELECT a_id, d, g, sum(exp(-0.5 * ((gx - v) / ha) ** 2)) + 1e-12 AS p FROM gr JOIN dm USING (d) WHERE signal_id = a_id GROUP BY 1, 2, 3), pb AS (SELECT a_id, d, g, sum(exp(-0.5 * ((gx - v) / hb) ** 2)) + 1e-12 AS q FROM gr JOIN dm USING (d) WHERE signal_id = b_id GROUP BY 1, 2, 3), "
    "pq AS (SELECT a_id, d, p / sum(p) OVER w AS p, q / sum(q) OVER w AS q FROM pa JOIN pb USING (a_id, d, g) WINDOW w AS (PARTITION BY a_id, d)), js AS (SELECT a_id, d, sum(0.5 * p * ln(2 * p / (p + q)) + 0.5 * q * ln(2 * q / (p + q))) AS js FROM pq GROUP BY 1, 2)"
)
SUBS = (
    f"{NUM}, sb AS (SELECT a.signal_id, a.w AS j, list_concat(list_concat(a.x, b.x), c.x) AS s FROM nv a JOIN nv b ON b.signal_id = a.signal_id AND b.w = a.w + 1 JOIN nv c ON c.signal_id = a.signal_id AND c.w = a.w + 2), "
    "zz AS (SELECT signal_id, j, list_transform(s, lambda q: (q - list_avg(s)) / (list_stddev_pop(s) + 1e-12)) AS z FROM sb), pr AS (SELECT a.signal_id, a.j, b.j AS k, 1 - list_inner_product(a.z, b.z) AS d FROM zz a JOIN zz b ON a.signal_id = b.signal_id AND a.j <> b.j), "
    "mp AS (SELECT signal_id, j, min(d) AS distance, arg_min(k, d) AS nearest FROM pr GROUP BY 1, 2), mq AS (SELECT mp.*, quantile_cont(distance, 0.15) OVER (PARTITION BY signal_id) AS lo, quantile_cont(distance, 0.9) OVER (PARTITION BY signal_id) AS hi FROM mp)"
)
NOVELTY = (
    "nn AS (SELECT signal_id, count(*) AS n, greatest(3, count(*) // 20) AS k FROM nv GROUP BY 1), nu AS (SELECT signal_id, w, n, k, list_transform(x, lambda q: q / (sqrt(list_inner_product(x, x)) + 1e-12)) AS u FROM nv JOIN nn USING (signal_id)), "
    "nc AS (SELECT c.signal_id, c.w, sum(list_inner_product(a.u, b.u) * (CASE WHEN a.w - c.w + c.k < c.k / 2 THEN 1 ELSE -1 END) * (CASE WHEN b.w - c.w < c.k / 2 THEN 1 ELSE -1 END)) AS s FROM nu c JOIN nu a ON a.signal_id = c.signal_id AND a.w BETWEEN c.w - c.k AND c.w - 1 JOIN nu b ON b.signal_id = c.signal_id AND b.w BETWEEN c.w AND c.w + c.k - 1 WHERE c.w >= c.k AND c.w < c.n - c.k GROUP BY 1, 2), "
    "nz AS (SELECT nv.signal_id, nv.w, greatest(0, coalesce(s, 0)) AS o FROM nv LEFT JOIN nc USING (signal_id, w))"
)
CHANGE = (
    "nm AS (SELECT signal_id, w, (energy - avg(energy) OVER q) / (stddev_pop(energy) OVER q + 1e-12) AS a, (complexity - avg(complexity) OVER q) / (stddev_pop(complexity) OVER q + 1e-12) AS b, count(*) OVER q AS n FROM e WINDOW q AS (PARTITION BY signal_id)), "
    "mv AS (SELECT signal_id, w, n, (avg(a) OVER l - avg(a) OVER r) ** 2 + (avg(b) OVER l - avg(b) OVER r) ** 2 AS dd, var_pop(a) OVER l + var_pop(a) OVER r + var_pop(b) OVER l + var_pop(b) OVER r AS vv FROM nm WINDOW l AS (PARTITION BY signal_id ORDER BY w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), r AS (PARTITION BY signal_id ORDER BY w ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)), "
    "rw AS (SELECT signal_id, w, CASE WHEN w >= 3 AND w < n - 3 THEN dd / (vv + 1e-12) ELSE 0 END AS raw FROM mv), cs AS (SELECT signal_id, w, raw / (max(raw) OVER (PARTITION BY signal_id) + 1e-12) AS score FROM rw), "
    f"{peaks_sql('pk', 'cs', 'signal_id', 'w', 'score', height='0.15', distance='4')}, "
    "br AS (SELECT signal_id, greatest(0.15, quantile_cont(score, 0.7)) AS bar FROM cs GROUP BY 1), cp AS (SELECT * FROM (SELECT signal_id, p AS w, v AS score, row_number() OVER (PARTITION BY signal_id ORDER BY v DESC, p) AS k FROM pk JOIN br USING (signal_id) WHERE v >= bar) WHERE k <= 8)"
)
RQA = (
    "em AS (SELECT signal_id, i, y AS a, lead(y, 2) OVER p AS b, lead(y, 4) OVER p AS c FROM s WINDOW p AS (PARTITION BY signal_id ORDER BY i)), ee AS (SELECT * FROM em WHERE c IS NOT NULL), nq AS (SELECT signal_id, count(*) AS n FROM ee GROUP BY 1), "
    "dd AS (SELECT x.signal_id, x.i, y.i AS j, sqrt((x.a - y.a) ** 2 + (x.b - y.b) ** 2 + (x.c - y.c) ** 2) AS d FROM ee x JOIN ee y ON x.signal_id = y.signal_id AND x.i <> y.i), fr AS (SELECT signal_id, max(d) AS far FROM dd GROUP BY 1), "
    "rr AS (SELECT signal_id, i, j FROM dd JOIN fr USING (signal_id) WHERE d < 0.15 * far), rt AS (SELECT signal_id, count(*) AS r FROM rr GROUP BY 1), "
    "dl AS (SELECT signal_id, len, count(*) AS c FROM (SELECT signal_id, ln, isl, count(*) AS len FROM (SELECT *, j - i AS ln, i - row_number() OVER (PARTITION BY signal_id, j - i ORDER BY i) AS isl FROM rr) GROUP BY 1, 2, 3) WHERE len >= 2 GROUP BY 1, 2), "
    "vl AS (SELECT signal_id, len, count(*) AS c FROM (SELECT signal_id, j, isl, count(*) AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY signal_id, j ORDER BY i) AS isl FROM rr) GROUP BY 1, 2, 3) WHERE len >= 2 GROUP BY 1, 2), "
    "da AS (SELECT signal_id, sum(len * c) AS pd, sum(c) AS ld, sum(-p * ln(p + 1e-12)) AS en FROM (SELECT *, c / (sum(c) OVER (PARTITION BY signal_id) + 1e-12) AS p FROM dl) GROUP BY 1), va AS (SELECT signal_id, sum(len * c) AS pv, sum(c) AS lv FROM vl GROUP BY 1), "
    "rz AS (SELECT nq.signal_id, coalesce(r, 0) / (n * n) AS recurrence_rate, coalesce(pd, 0) / greatest(coalesce(r, 0), 1) AS determinism, coalesce(pv, 0) / greatest(coalesce(r, 0), 1) AS laminarity, CASE WHEN ld > 0 THEN pd / ld ELSE 1.0 END AS mean_diag_length, CASE WHEN lv > 0 THEN pv / lv ELSE 1.0 END AS trapping_time, coalesce(en, 0) AS entropy_diag "
    "FROM nq LEFT JOIN rt USING (signal_id) LEFT JOIN da USING (signal_id) LEFT JOIN va USING (signal_id))"
)
MEL = "hz AS (SELECT m, 700 * (10 ** (m * 2595 * log10(1 + 8000 / 700.0) / 10 / 2595) - 1) AS hz FROM (SELECT range AS m FROM range(11))), fb AS (SELECT a.m AS mel, bin, greatest(0, least((bin * 250.0 - a.hz) / (b.hz - a.hz + 1e-8), (c.hz - bin * 250.0) / (c.hz - b.hz + 1e-8))) AS wt FROM hz a JOIN hz b ON b.m = a.m + 1 JOIN hz c ON c.m = a.m + 2, (SELECT range AS bin FROM range(33))), ml AS (SELECT signal_id, w, mel, sum(wt * bins.m) AS level FROM bins JOIN fb ON fb.bin = bins.b WHERE wt > 0 GROUP BY 1, 2, 3)"
BANDS = f"{SPEC}, {MEL}, bl AS (SELECT signal_id, w, CASE WHEN mel < 3 THEN 'low' WHEN mel < 6 THEN 'mid' ELSE 'high' END AS band, avg(level) AS x FROM ml GROUP BY 1, 2, 3)"
SCORES = f"{BANDS}, {simple_errors('be', 'bl', 'signal_id, band', 5)}, bz AS (SELECT signal_id, band, avg(rmse) AS avg_rmse, min(rmse) AS min_rmse, arg_min(model, rmse) AS best_model FROM be GROUP BY 1, 2)"

ORACLES = {
    "spectral_centroid": f"WITH {SPEC}, {FULL} SELECT signal_id, w, round(sum(fr * m) / max(t), 6) AS centroid FROM z GROUP BY 1, 2",
    "spectral_entropy": f"WITH {SPEC}, {FULL} SELECT signal_id, w, round(sum(CASE WHEN m > 0 THEN -(m / t) * log2(m / t) ELSE 0 END), 6) AS entropy_bits, round(sum(-p * ln(p + 1e-10)), 6) AS entropy FROM z GROUP BY 1, 2",
    "spectral_flatness": f"WITH {SPEC}, {FULL} SELECT signal_id, w, round(max(gm) / (max(am) + 1e-10), 6) AS flatness FROM z GROUP BY 1, 2",
    "spectral_rolloff": f"WITH {SPEC}, {FULL} SELECT signal_id, w, round(min(fr) FILTER (WHERE cu >= 0.85 * t), 6) AS rolloff FROM z GROUP BY 1, 2",
    "spectral_bandwidth": f"WITH {SPEC}, {FULL}, c AS (SELECT signal_id, w, sum(fr * p) AS c FROM z GROUP BY 1, 2) SELECT signal_id, w, round(sqrt(sum((fr - c) ** 2 * p)), 6) AS bandwidth FROM z JOIN c USING (signal_id, w) GROUP BY 1, 2",
    "chroma_profile": f"WITH {SPEC}, {FULL}, c AS (SELECT signal_id, w, ((round_even(12 * log2(fr / 27.5), 0)::BIGINT % 12) + 12) % 12 AS pitch, sum(m) AS m FROM z WHERE fr > 0 GROUP BY 1, 2, 3) SELECT signal_id, w, pitch, round(m / sum(m) OVER (PARTITION BY signal_id, w), 6) AS share FROM c",
    "dominant_frequency": f"WITH {B}, n AS (SELECT signal_id, count(*) AS n FROM s GROUP BY 1), b AS (SELECT s.signal_id, k, n, sum(y * cos(2 * pi() * k * i / n)) ** 2 + sum(y * sin(2 * pi() * k * i / n)) ** 2 AS m FROM s JOIN n USING (signal_id), range(1, 60) AS q(k) WHERE k < n // 2 GROUP BY 1, 2, 3), "
    "t AS (SELECT signal_id, arg_max(k, m) AS k, max(n) AS n FROM b GROUP BY 1) SELECT signal_id, round(k / n, 6) AS freq, round(n / k, 6) AS period, (n // k)::BIGINT AS period_samples FROM t",
    "mel_energy": f"WITH {SPEC}, {MEL} SELECT signal_id, w, mel, {sr_('level')} FROM ml",
    "mel_bands": f"WITH {SPEC}, {MEL}, l AS (SELECT signal_id, w, CASE WHEN mel < 3 THEN 'low' WHEN mel < 6 THEN 'mid' ELSE 'high' END AS band, avg(level) AS level FROM ml GROUP BY 1, 2, 3) SELECT signal_id, w, band, {sr_('level')} FROM l",
    "pearson_pairs": f"WITH {PAIRED} SELECT a_id, b_id, round({CORR.format(a='a', b='b')}, 6) AS pearson FROM pd GROUP BY 1, 2",
    "spearman_pairs": f"WITH {PAIRED}, k AS (SELECT a_id, b_id, rank() OVER (PARTITION BY a_id, b_id ORDER BY a) + (count(*) OVER (PARTITION BY a_id, b_id, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY a_id, b_id ORDER BY b) + (count(*) OVER (PARTITION BY a_id, b_id, b) - 1) / 2.0 AS rb FROM pd) SELECT a_id, b_id, round({CORR.format(a='ra', b='rb')}, 6) AS spearman FROM k GROUP BY 1, 2",
    "derivative_corr": f"WITH {PAIRED}, k AS (SELECT a_id, b_id, {GRAD.format(x='a')} AS da, {GRAD.format(x='b')} AS db FROM pd WINDOW p AS (PARTITION BY a_id, b_id ORDER BY i)) SELECT a_id, b_id, round({CORR.format(a='da', b='db')}, 6) AS derivative FROM k GROUP BY 1, 2",
    "distribution_emd": f"WITH {ASKED}, xa AS (SELECT a_id, b_id, y AS x FROM pr JOIN s ON signal_id = a_id), xb AS (SELECT a_id, b_id, y AS x FROM pr JOIN s ON signal_id = b_id), {EMD.format(key='a_id, b_id', bins='30')} SELECT a_id, b_id, round(emd, 6) AS emd, round(exp(-2 * emd), 6) AS similarity FROM emd",
    "contrast_report": f"WITH {LAYER}, {LONG4}, {PR}, ya AS (SELECT a_id, b_id, trend, x FROM pr JOIN lg ON signal_id = a_id), yb AS (SELECT a_id, b_id, trend, x FROM pr JOIN lg ON signal_id = b_id), "
    f"sa AS (SELECT {KEY3}, avg(x) AS mean_a, var_pop(x) AS va, count(*) AS na FROM ya GROUP BY ALL), sb AS (SELECT {KEY3}, avg(x) AS mean_b, var_pop(x) AS vb, count(*) AS nb2 FROM yb GROUP BY ALL), st AS (SELECT * FROM sa JOIN sb USING ({KEY3})), "
    f"xa AS (SELECT {KEY3}, x, greatest(10, least(30, floor(sqrt(least(na, nb2)))::BIGINT)) AS bn FROM ya JOIN st USING ({KEY3})), xb AS (SELECT * FROM yb), {EMD.format(key=KEY3, bins='bn')}, "
    f"cc AS (SELECT {KEY3}, mean_a, mean_b, abs(mean_a - mean_b) / (sqrt(va + vb) + 1e-12) AS ratio, exp(-2 * emd) AS overlap FROM st LEFT JOIN emd USING ({KEY3})) "
    f"SELECT {KEY3}, {sr_('mean_a', 'mean_b', 'ratio', 'overlap')}, round(CASE WHEN ratio > 1 THEN least(1, ratio / 3) ELSE 1 - least(1, ratio / 2) END, 6) AS confidence, CASE WHEN ratio > 1 THEN 'contrast' ELSE 'similar' END AS kind FROM cc",
    "trend_similarity": f"WITH RECURSIVE {LAYER}, {LONG4}, {PR}, {SIMILAR}, {SCORED} SELECT {KEY3}, {sr_('pearson', 'spearman', 'derivative', 'distribution', 'overlap', 'score', d=5)} FROM ss",
    "dynamics_similarity": f"WITH RECURSIVE {LAYER}, {LONG4}, {PR}, {SIMILAR}, {SCORED} {_global((0.35, 0.25, 0.15, 0.25))}",
    "volatility_similarity": f"WITH {LAYER}, {LONG4.replace('lg AS', 'l0 AS', 1)}, {VOLATILE}, {PR}, {SIMILAR}, {VSCORED} {_global((0.35, 0.20, 0.15, 0.30))}",
    "similarity_matrix": f"WITH {UNIT} SELECT a_id, a_w, b_w, {sr_('sim')} FROM sm",
    "best_match": f"WITH {UNIT}, t AS (SELECT *, row_number() OVER (PARTITION BY a_w ORDER BY sim DESC, b_w) AS k FROM sm) SELECT a_id, a_w, b_w, {sr_('sim')} FROM t WHERE k = 1 AND sim > 0.05",
    "entropy_weighted_match": f"WITH {UNIT}, {DIMS.replace(VEC + ', ' + VPAIRS + ', ', '')}, we AS (SELECT w, list_sum(list_transform(x, lambda q: abs(q))) AS e FROM v), "
    "ba AS (SELECT a_id, b_id, a_w, max(sim) AS best FROM sm GROUP BY 1, 2, 3), bb AS (SELECT a_id, b_id, b_w, max(sim) AS best FROM sm GROUP BY 1, 2, 3), "
    "ia AS (SELECT a_id, b_id, avg(best) AS m, sum(e * best) / (sum(e) + 1e-12) AS x FROM ba JOIN we ON w = a_w GROUP BY 1, 2), ib AS (SELECT a_id, b_id, avg(best) AS m, sum(e * best) / (sum(e) + 1e-12) AS x FROM bb JOIN we ON w = b_w GROUP BY 1, 2), "
    "dq AS (SELECT a_id, b_id, median(CASE WHEN da < 1e-12 AND db < 1e-12 THEN 0 ELSE abs(ma - mb) / (da + db + 1e-10) END) AS dist FROM st GROUP BY 1, 2), "
    "q AS (SELECT a_id, b_id, (ia.m + ib.m) / 2 AS simple, (ia.x + ib.x) / 2 AS weighted, exp(-3 * dist) AS distribution FROM ia JOIN ib USING (a_id, b_id) JOIN dq USING (a_id, b_id)) "
    f"SELECT a_id, b_id, {sr_('simple', 'weighted', 'distribution')}, round(least(1, greatest(0, 0.60 * simple + 0.25 * weighted + 0.15 * distribution)) * 100, 6) AS similarity FROM q",
    "distribution_distance": f"WITH {DIMS}, xa AS (SELECT a_id, d, v AS x, greatest(10, least(50, floor(sqrt(least(na, nb)))::BIGINT)) AS bn FROM dm JOIN st USING (d) WHERE signal_id = a_id), xb AS (SELECT a_id, d, v AS x FROM dm JOIN st USING (d) WHERE signal_id = b_id), {EMD.format(key='a_id, d', bins='bn')} SELECT a_id, d AS dim, round(CASE WHEN da < 1e-12 AND db < 1e-12 THEN 0 ELSE emd END, 6) AS distance FROM st LEFT JOIN emd USING (a_id, d)",
    "js_distance": f"WITH {DIMS}, {JS} SELECT a_id, d AS dim, round(CASE WHEN da < 1e-12 AND db < 1e-12 THEN 0 ELSE js END, 6) + 0.0::DOUBLE AS distance FROM js JOIN st USING (a_id, d)",
    "self_similarity_lags": f"WITH {NUM} SELECT a.signal_id, b.w - a.w AS lag, a.w, round(list_inner_product(a.x, b.x) / (sqrt(list_inner_product(a.x, a.x)) * sqrt(list_inner_product(b.x, b.x))), 6) AS sim FROM nv a JOIN nv b ON a.signal_id = b.signal_id AND b.w - a.w BETWEEN 1 AND 5",
    "novelty_curve": f"WITH {NUM}, {NOVELTY} SELECT signal_id, w, round(o / (max(o) OVER (PARTITION BY signal_id) + 1e-12), 6) AS novelty FROM nz",
    "motif_profile": f"WITH {SUBS} SELECT signal_id, j, round(distance, 5) + 0.0::DOUBLE AS distance FROM mp",
    "motif_report": f"WITH {SUBS} SELECT signal_id, pattern_index, list_sort([j * 0.25::DOUBLE, nearest * 0.25::DOUBLE]) AS occurrences, round(1 - distance, 5) + 0.0::DOUBLE AS significance FROM (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY distance, j) AS pattern_index FROM mq WHERE distance < lo) WHERE pattern_index <= 5",
    "discord_report": f"WITH {SUBS} SELECT signal_id, j, round(distance, 5) + 0.0::DOUBLE AS distance FROM (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY j) AS k FROM mq WHERE distance > hi) WHERE k <= 3",
    "change_points": f"WITH RECURSIVE {LAYER}, {CHANGE} SELECT signal_id, w, round(score, 4) AS score FROM cp",
    "spectrum": f"WITH {B}, n AS (SELECT signal_id, count(*) AS n FROM s GROUP BY 1) SELECT s.signal_id, k AS bin, round(k / any_value(n), 5) AS freq, round(20 * log10(sqrt(sum(y * cos(2 * pi() * k * i / n)) ** 2 + sum(y * sin(2 * pi() * k * i / n)) ** 2) / any_value(n) + 1e-10), 5) + 0.0::DOUBLE AS level FROM s JOIN n USING (signal_id) JOIN range((SELECT max(n) FROM n)) AS q(k) ON k < n // 2 GROUP BY 1, 2",
    "flatness_global": f"WITH {B}, n AS (SELECT signal_id, count(*) AS n FROM s GROUP BY 1), m AS (SELECT s.signal_id, k, sqrt(sum(y * cos(2 * pi() * k * i / n)) ** 2 + sum(y * sin(2 * pi() * k * i / n)) ** 2) / any_value(n) AS m FROM s JOIN n USING (signal_id) JOIN range((SELECT max(n) FROM n)) AS q(k) ON k < n // 2 GROUP BY 1, 2) "
    "SELECT signal_id, round(CASE WHEN max(m) < 1e-10 THEN 1 ELSE exp(avg(ln(m + 1e-10))) / (avg(m) + 1e-10) END, 6) AS flatness FROM m GROUP BY 1",
    "stft": f"WITH {A}, n AS (SELECT signal_id, count(*) AS n FROM s GROUP BY 1), f AS (SELECT signal_id, range AS frame FROM n, range((SELECT max(n) // 64 + 2 FROM n)) WHERE range * 64 <= n + (64 - n % 64) % 64), "
    "h AS (SELECT range AS k, 0.5 - 0.5 * cos(2 * pi() * range / 256) AS h FROM range(256)), p AS (SELECT f.signal_id, frame, k, h * y AS y FROM f, h JOIN s ON s.i = frame * 64 + k - 128 WHERE s.signal_id = f.signal_id) "
    "SELECT signal_id, frame, b AS bin, round(sqrt(sum(y * cos(2 * pi() * b * k / 256)) ** 2 + sum(y * sin(2 * pi() * b * k / 256)) ** 2) / 128, 6) + 0.0::DOUBLE AS mag FROM p, range(129) AS q(b) GROUP BY 1, 2, 3",
    "standout_trends": f"WITH {LAYER}, {LONG4}, z AS (SELECT signal_id, trend, (max(x) - min(x)) / (max(x) + 1e-12) AS range_pct FROM lg GROUP BY 1, 2) SELECT signal_id, rank, trend, round(range_pct, 6) AS range_pct FROM (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY range_pct DESC, trend) AS rank FROM z) WHERE rank <= 3",
    "characters": f"WITH RECURSIVE {LAYER}, {peaks_sql('pk', 'e', 'signal_id', 'w', 'rhythm', distance='3', prominence='0.15 * sd')}, bt AS (SELECT signal_id, count(*) AS beats FROM pk GROUP BY 1), "
    "z AS (SELECT signal_id, avg(rhythm) AS r, avg(brightness) AS b, avg(complexity) AS c, (max(w) - min(w)) * 32.0 AS t, stddev_pop(energy) AS sd, regr_slope(energy, w::DOUBLE) AS sl, count(*) AS n FROM e GROUP BY 1), y AS (SELECT *, coalesce(beats, 0) / greatest(t, 0.1) * 60 AS bpm, greatest(0, least(1, c / 15)) AS fl FROM z LEFT JOIN bt USING (signal_id)) "
    "SELECT signal_id, CASE WHEN r > 0.03 THEN 'dense' WHEN r > 0.015 THEN 'medium' ELSE 'sparse' END AS rhythm, round(bpm, 6) AS bpm, CASE WHEN bpm > 160 THEN 'very fast' WHEN bpm > 100 THEN 'fast' WHEN bpm > 50 THEN 'moderate' ELSE 'slow' END AS pace, CASE WHEN sl > sd * 0.3 / n THEN 'rising' WHEN sl < -sd * 0.3 / n THEN 'falling' ELSE 'flat' END AS energy, "
    "CASE WHEN b > 3000 THEN 'bright' WHEN b > 1500 THEN 'balanced' ELSE 'dark' END AS timbre, CASE WHEN fl > 0.7 THEN 'noisy' WHEN fl > 0.4 THEN 'mixed' ELSE 'tonal' END AS purity FROM y",
    "change_score": f"WITH {B}, m AS (SELECT signal_id, i, count(*) OVER (PARTITION BY signal_id) AS n, avg(y) OVER l AS ml, avg(y) OVER r AS mr, var_pop(y) OVER l AS vl, var_pop(y) OVER r AS vr FROM s WINDOW l AS (PARTITION BY signal_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), r AS (PARTITION BY signal_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)), "
    "q AS (SELECT signal_id, i, CASE WHEN i >= 3 AND i < n - 3 THEN (ml - mr) ** 2 / (vl + vr + 1e-12) ELSE 0 END AS raw FROM m) SELECT signal_id, i AS w, round(raw / (max(raw) OVER (PARTITION BY signal_id) + 1e-12), 4) AS score FROM q",
    "recurrence": f"WITH {B}, {RQA} SELECT signal_id, {sr_('recurrence_rate', 'determinism', 'laminarity', 'mean_diag_length', 'trapping_time', 'entropy_diag')}, CASE WHEN determinism > 0.8 THEN 'high' WHEN determinism > 0.5 THEN 'medium' WHEN determinism > 0.2 THEN 'low' ELSE 'random' END || CASE WHEN laminarity > 0.6 THEN '+laminar' ELSE '' END AS level FROM rz",
    "mahalanobis_outliers": f"WITH {VEC}, q AS (SELECT w, x[1] AS a, x[2] AS b FROM v), m AS (SELECT avg(a) AS ma, avg(b) AS mb, var_samp(a) + 1e-6 AS va, var_samp(b) + 1e-6 AS vb, covar_samp(a, b) AS vab FROM q), z AS (SELECT w, sqrt((vb * (a - ma) ** 2 - 2 * vab * (a - ma) * (b - mb) + va * (b - mb) ** 2) / (va * vb - vab * vab)) AS score FROM q, m) SELECT w, {sr_('score')} FROM z WHERE score > (SELECT quantile_cont(score, 0.95) FROM z)",
    "forecast_naive_metrics": f"WITH {B}, n AS (SELECT *, count(*) OVER (PARTITION BY signal_id) AS n FROM s), l AS (SELECT signal_id, y AS f FROM n WHERE i = n - 11), q AS (SELECT signal_id, y - f AS e FROM n JOIN l USING (signal_id) WHERE i >= n - 10) SELECT signal_id, round(sqrt(avg(e * e)), 5) AS rmse, round(avg(abs(e)), 5) AS mae, round(avg(e * e), 5) AS mse FROM q GROUP BY 1",
    "state_profile": f"WITH {LAYER}, {SEGMENTS} SELECT signal_id, label, count(*) AS windows, round(count(*) / sum(count(*)) OVER (PARTITION BY signal_id), 6) AS fraction, round(avg(energy), 6) AS mean_energy, round(avg(complexity), 6) AS mean_complexity FROM seg JOIN e USING (signal_id, w) GROUP BY 1, 2",
    "band_error_summary": f"WITH {SCORES} SELECT signal_id, band, {sr_('avg_rmse', 'min_rmse', d=4)}, best_model FROM bz",
    "band_rank": f"WITH {SCORES} SELECT signal_id, band, {sr_('avg_rmse')}, row_number() OVER (PARTITION BY signal_id ORDER BY bz.avg_rmse, band) AS rank FROM bz",
    "delay_embedding": f"WITH {B}, q AS (SELECT signal_id, i AS j, y AS e0, lead(y, 2) OVER p AS e1, lead(y, 4) OVER p AS e2 FROM s WINDOW p AS (PARTITION BY signal_id ORDER BY i)) SELECT signal_id, j, {sr_('e0', 'e1', 'e2')} FROM q WHERE e2 IS NOT NULL",
    "experiments_upsert": "SELECT * FROM (VALUES ('a', 't1', 1::BIGINT, 1::BIGINT), ('b', 't3', 2, 5), ('c', 't4', 6, 6)) AS t(name, task_id, created_at, updated_at)",
    "experiments_delete": "SELECT * FROM (VALUES ('b', 't3', 2::BIGINT, 5::BIGINT), ('c', 't4', 6, 6)) AS t(name, task_id, created_at, updated_at)",
    "history_join": "SELECT r.task_id, coalesce(title, 'untitled') AS title, coalesce(audio1, 'synthetic') AS audio1, modified FROM (VALUES ('t1', 10::BIGINT), ('t2', 20), ('t3', 5)) AS r(task_id, modified) LEFT JOIN (VALUES ('t1', 'first', 'x.wav'), ('t2', NULL, 'y.wav')) AS i(task_id, title, audio1) ON i.task_id = r.task_id",
    "json_results": f"WITH {A}, n AS (SELECT signal_id, (count(*) - 64) // 32 + 1 AS n FROM s GROUP BY 1) SELECT signal_id, '{{\"windows\":' || n || '}}' AS json FROM n",
}
QUERIES = {
    f.__name__: f
    for f in (
        spectral_centroid, spectral_entropy, spectral_flatness, spectral_rolloff, spectral_bandwidth, chroma_profile, dominant_frequency, spectrum, flatness_global, mel_energy, mel_bands, mel_spectrogram, mfcc, stft, pearson_pairs, spearman_pairs, derivative_corr,
        distribution_emd, contrast_report, trend_similarity, dynamics_similarity, volatility_similarity, similarity_matrix, best_match, entropy_weighted_match, distribution_distance, js_distance, whitened_similarity, self_similarity_lags, novelty_curve,
        window_features, climax_windows, annotated_matches, motif_profile, motif_report, discord_report, change_score, change_points, segment_report, recurrence, mahalanobis_outliers, mahalanobis_scores, kmeans_profile, silhouette, nmf_components, pca_variance, characters,
        self_motifs, corresponding_segments, pair_overview, standout_trends, forecast_naive_metrics, model_forecasts, arima_forecast, hmm_forecast, arima_structure, hmm_states, hmm_state_quality, state_profile, lookback_insights, lag_profile, band_error_summary, band_rank,
        band_forecasts, delay_embedding, experiments_upsert, experiments_delete, history_join, json_results,
    )
}
