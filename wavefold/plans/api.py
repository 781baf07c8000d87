"""analyze(): named analyses of signals, each a lazy DataFrame keyed by signal or pair; and a command line."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import discovery, forecast, plotdata, similarity, spectral, stats, trends, unsupervised, volatility
from ..operators.trends import TRENDS
from ..schemas import EngineConfig
from ..sinks import registry
from ..sources import synth, wav

ANALYSES = ("features", "dynamics", "dynamics_analysis", "model_analysis", "timeseries", "unsupervised", "prediction", "band", "comparison", "visualization")


def parse(options: str | None, signals: int) -> list[str]:
    """Chosen analyses, in their fixed order; comparison needs two signals; unknown names are refused."""
    if options is None or not options.strip():
        chosen = [a for a in ANALYSES if a != "comparison" or signals > 1]
    else:
        chosen = [o.strip().lower() for o in options.split(",") if o.strip()]
    unknown = sorted(set(chosen) - set(ANALYSES))
    if unknown:
        raise ValueError(f"unknown analyses: {', '.join(unknown)}; known: {', '.join(ANALYSES)}")
    return [a for a in ANALYSES if a in chosen and (a != "comparison" or signals > 1)]


def analyze(samples: DataFrame, options: str | None = None, sr: float = 16000.0, config: EngineConfig | None = None, pair: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables by name, of the analyses asked for. Nothing runs until a table is used; the trend layer is made once."""
    c = config or EngineConfig()
    spark = samples.sparkSession
    chosen = parse(options, 2 if pair is not None else 1)
    win, hop = int(c.window * sr), int(c.hop * sr)
    layer = trends.trends(samples, win, hop, sr).persist()
    rows = layer.select("signal_id", "w", F.array(*(f"{t}_norm" for t in TRENDS)).alias("x"))
    series = trends.long(layer)
    out: dict[str, DataFrame] = {}
    if "features" in chosen:
        out |= {"spectrum": spectral.fft(samples, sr), "mel": spectral.mel_spectrogram(samples, sr, c.n_mels, c.n_fft, c.fft_hop), "mfcc": spectral.mfcc(samples, sr, c.n_mfcc, c.n_mels, c.n_fft, c.fft_hop)}
    if "dynamics" in chosen:
        out |= {"trends": layer, "segments": trends.segments(layer), "summary": trends.summary(layer), "peaks": trends.peak_counts(layer)}
    if "dynamics_analysis" in chosen:
        vol = volatility.volatility_layer(series, c.volatility_window).persist()
        out |= {"volatility": vol, "volatility_summary": volatility.summarise(vol, ["signal_id", "trend"]), "garch": volatility.garch(series, "x", ["signal_id", "trend"], "w"), "trend_forecasts": forecast.forecasts(series, ["signal_id", "trend"], "w", "x", c.horizon)}
    if "model_analysis" in chosen:
        norms = tuple(f"{t}_norm" for t in TRENDS)
        states = forecast.hmm_states(layer, norms, c.hmm_states, c.seed)
        out |= {"arima": forecast.arima_structure(series, ["signal_id", "trend"], "w", "x"), "states": states, "state_profile": forecast.state_profile(states, layer, norms), "lookback": forecast.lookback_insights(series, ["signal_id", "trend"], "w", "x"), "lags": forecast.lag_profile(series, ["signal_id", "trend"], "w", "x")}
        out |= {"state_changes": forecast.state_changes(states), "ensemble": forecast.ensemble(layer, norms, c.hop)}
    if "timeseries" in chosen:
        first = samples.filter(F.col("i") < int(sr))
        out |= {"pacf": stats.pacf(first), "acf_peaks": stats.acf_peaks(first), "dominant": spectral.dominant(samples, sr), "entropy": stats.sample_entropy(samples), "white_noise": stats.white_noise_vote(samples.filter(F.col("i") < int(2 * sr)))}
    if "unsupervised" in chosen:
        points = unsupervised.change_points(rows, c.hop)
        out |= {"change_points": points, "segments_found": unsupervised.characterise(unsupervised.build_segments(points, layer, c.hop, trends.segments(layer))), "recurrence": unsupervised.recurrence(rows), "anomalies": unsupervised.anomalies(unsupervised.mahalanobis(rows)), "factors": unsupervised.factors(rows)}
    if "prediction" in chosen or "band" in chosen:
        levels = spectral.mel_spectrogram(samples, sr, c.n_mels, c.n_fft, c.fft_hop).select("signal_id", F.col("frame").alias("w"), F.posexplode("values").alias("mel", "level"))
        if "prediction" in chosen:
            mean = levels.groupBy("signal_id", "w").agg(F.avg("level").alias("x"))
            out["predictions"] = forecast.forecasts(mean, ["signal_id"], "w", "x", c.horizon)
        if "band" in chosen:
            bands = forecast.forecasts(forecast.band_series(spectral.mel_bands(levels, c.n_mels)), ["signal_id", "band"], "w", "x", c.horizon)
            errors = forecast.band_errors(forecast.metrics(bands, ["signal_id", "band", "model"]))
            out |= {"band_predictions": bands, "band_errors": errors, "band_rank": forecast.band_rank(errors)}
    if "comparison" in chosen and pair is not None:
        scores = trends.trend_similarity(layer, pair)
        cross = discovery.cross_summary(discovery.corresponding(layer, pair), pair)
        contrast = discovery.contrast(layer, pair)
        out |= {"trend_similarity": scores, "similarity": trends.global_similarity(scores), "correspondence": cross, "contrast": contrast, "overview": discovery.overview(cross, contrast), "similarity_matrix": similarity.similarity_matrix(rows, pair)}
    if "visualization" in chosen:
        vol = volatility.volatility_layer(series, c.volatility_window)
        out |= {"plot_waveform": plotdata.waveform(samples, sr), "plot_spectrum": plotdata.spectrum(samples, sr), "plot_periodicity": plotdata.periodicity(samples, sr), "plot_segments": plotdata.segment_bar(trends.segments(layer)), "plot_trends": plotdata.trend_lines(layer)}
        out |= {"plot_volatility": plotdata.volatility_band(series, vol), "plot_persistence": plotdata.persistence_words(volatility.garch(series, "x", ["signal_id", "trend"], "w")), "plot_histogram": plotdata.histogram(series, "x", ["signal_id", "trend"])}
        if "band" in chosen:
            out["plot_bands"] = plotdata.band_heatmap(forecast.metrics(bands, ["signal_id", "band", "model"]), list(forecast.MODELS))
        if pair is not None:
            out["plot_dimensions"] = plotdata.top_dimensions(similarity.distribution_distance(rows, pair, "difference"), [f"{t}_norm" for t in TRENDS])
    return out


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Analyses of WAV files below a folder, or of two synthetic tones.")
    p.add_argument("--input")
    p.add_argument("--analysis")
    p.add_argument("--output")
    p.add_argument("--sr", type=int, default=16000)
    p.add_argument("--seconds", type=float, default=3.0)
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("wavefold").getOrCreate()
    samples = wav.read_wav(spark, a.input, a.sr) if a.input else synth.tone(spark, a.seconds, a.sr, signal_id="a").unionByName(synth.tone(spark, a.seconds, a.sr, 330.0, seed=1, signal_id="b"))
    ids = sorted(r.signal_id for r in samples.select("signal_id").distinct().limit(3).collect())
    pair = trends.pairs(spark, [(ids[0], ids[1])]) if len(ids) == 2 else None
    for name, df in analyze(samples, a.analysis, float(a.sr), pair=pair).items():
        if a.output:
            df.write.mode("overwrite").json(f"{a.output}/{name}")
        else:
            print(registry.report(df.drop(*(f.name for f in df.schema if f.dataType.typeName() == "array")), name, 20), "\n")


if __name__ == "__main__":
    main()
