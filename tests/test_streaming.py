"""Streaming operators on files that arrive one after the other, against plain Python on all rows."""

import datetime as dt
import statistics

from wavefold.streaming import rolling


def test_streams(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [("a" if k % 3 else "b", start + dt.timedelta(hours=k), float(k * k % 17)) for k in range(60)]
    shape = "signal_id string, ts timestamp, y double"
    source = str(tmp_path / "in")
    for part in (rows[:25], rows[25:40], rows[40:]):
        spark.createDataFrame(part, shape).coalesce(1).write.mode("append").parquet(source)

    def ran(make, mode):
        stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(source)
        query = make(stream).writeStream.format("memory").queryName(mode).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / mode)).start()
        query.awaitTermination(120)
        return spark.table(mode).collect()

    got = {(r.signal_id, r.ts): r.vol for r in ran(lambda s: rolling.rolling_volatility(s, 5), "append")}
    for key in "ab":
        own = [(t, y) for k, t, y in rows if k == key]
        for i, (t, _) in enumerate(own):
            assert abs(got[key, t] - statistics.pstdev([y for _, y in own[max(0, i - 4) : i + 1]])) < 1e-9
    frames = {(r.signal_id, r.start): r for r in ran(lambda s: rolling.hopping(s, late="10 hours"), "complete")}
    for (key, begin), r in frames.items():
        own = [y for k, t, y in rows if k == key and begin <= t < begin + dt.timedelta(hours=12)]
        assert r.n == len(own) and abs(r.energy**2 - sum(y * y for y in own) / len(own)) < 1e-9
    assert len(frames) > 15


def test_analyses_return_plot_tables(spark):
    from wavefold.operators import trends
    from wavefold.plans import api
    from wavefold.sources import synth

    samples = synth.tone(spark, 1.5, 2000, signal_id="a").unionByName(synth.tone(spark, 1.5, 2000, 330.0, seed=1, signal_id="b"))
    got = api.analyze(samples, "visualization, comparison", 2000.0, pair=trends.pairs(spark, [("a", "b")]))
    plots = {k for k in got if k.startswith("plot_")}
    assert plots >= {"plot_waveform", "plot_segments", "plot_trends", "plot_volatility", "plot_histogram", "plot_dimensions"}
    assert got["plot_waveform"].count() == 6000 and got["plot_segments"].count() == got["plot_trends"].count() / 4
    assert all(r.low <= r.x <= r.high or r.low == 0 for r in got["plot_volatility"].collect())
