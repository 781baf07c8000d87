"""Event streams: hopping frames with a watermark, and rolling volatility with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def hopping(events: DataFrame, size: str = "12 hours", hop: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """(signal_id, start, end, n, energy, sd) of every hopping window of a stream (signal_id, ts, y); rows later than ``late`` are dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    g = timed.groupBy("signal_id", F.window("ts", size, hop).alias("win"))
    z = g.agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("y") * F.col("y"))).alias("energy"), F.stddev_pop("y").alias("sd"))
    return z.select("signal_id", F.col("win.start").alias("start"), F.col("win.end").alias("end"), "n", "energy", "sd")


def rolling_volatility(events: DataFrame, window: int = 10) -> DataFrame:
    """(signal_id, ts, y, vol): deviation of each signal's last ``window`` values, in order of ts within a batch; the state is those values."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        df = pd.concat(batches).sort_values("ts")
        out = []
        for y in df.y:
            held = [*held, float(y)][-window:]
            mean = sum(held) / len(held)
            out.append((sum((v - mean) ** 2 for v in held) / len(held)) ** 0.5)
        state.update((held,))
        yield pd.DataFrame({"signal_id": key[0], "ts": df.ts, "y": df.y, "vol": out})

    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.select("signal_id", "ts", "y").groupBy("signal_id").applyInPandasWithState(step, "signal_id string, ts timestamp, y double, vol double", "held array<double>", "append", GroupStateTimeout.NoTimeout)
