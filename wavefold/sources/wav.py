"""WAV files: read by Spark as binary files, decoded on the executors; and written for synthetic clips."""

from __future__ import annotations

import io
import math
import wave

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def decode(data: bytes) -> tuple[np.ndarray, int]:
    """Mono samples in [-1, 1] and the sample rate; channels are averaged."""
    with wave.open(io.BytesIO(data)) as f:
        width, channels, sr = f.getsampwidth(), f.getnchannels(), f.getframerate()
        raw = f.readframes(f.getnframes())
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    elif width == 2:
        x = np.frombuffer(raw, "<i2").astype(float) / 32768
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8).astype(float) / (1 << 23)
    else:
        x = np.frombuffer(raw, "<i4").astype(float) / (1 << 31)
    return x.reshape(-1, channels).mean(1), sr


def resample(x: np.ndarray, sr: int, target: int) -> np.ndarray:
    """x at another rate, through its spectrum."""
    if sr == target or not len(x):
        return x
    g = math.gcd(sr, target)
    n = int(math.ceil(len(x) * (target // g) / (sr // g)))
    spec = np.fft.rfft(x)
    out = np.zeros(n // 2 + 1, complex)
    k = min(len(spec), len(out))
    out[:k] = spec[:k]
    return np.fft.irfft(out, n) * (n / len(x))


def read_wav(spark: SparkSession, path: str, sr: int = 16000) -> DataFrame:
    """(signal_id, i, y) of every WAV file below path, a signal for each file name."""

    def run(batches):
        for df in batches:
            for at, data in zip(df.path, df.content):
                x = resample(*decode(bytes(data)), sr)
                for a in range(0, len(x), 100_000):
                    part = x[a : a + 100_000]
                    yield pd.DataFrame({"signal_id": at.rsplit("/", 1)[-1], "i": np.arange(a, a + len(part)), "y": part})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, "signal_id string, i bigint, y double")


def signals(samples: DataFrame, sr: float) -> DataFrame:
    """(signal_id, sr, n, duration) of each signal."""
    return samples.groupBy("signal_id").agg(F.lit(float(sr)).alias("sr"), F.count("*").alias("n"), (F.count("*") / sr).alias("duration"))


def write_wav(y: np.ndarray, sr: int, path: str) -> None:
    """One clip as 16-bit mono; for short synthetic signals on the driver."""
    with wave.open(path, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(sr)
        f.writeframes((np.clip(y, -1, 1) * 32767).round().astype("<i2").tobytes())
