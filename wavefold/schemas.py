"""Column layouts and tunables that the operators share."""

from __future__ import annotations

from dataclasses import dataclass

SAMPLES = "signal_id string, i bigint, y double"
TRENDS = ("energy", "brightness", "complexity", "rhythm")
LABELS = ("climax", "calm", "buildup", "release", "transition", "sustained")
WINDOW_SCALARS = (
    "onset_density", "onset_mean", "onset_std", "tempo_acf_peak", "rms_energy", "energy_entropy", "zero_crossing_rate",
    "peak_to_rms", "spectral_centroid", "spectral_bandwidth", "spectral_rolloff", "spectral_flatness", "spectral_entropy",
)
WINDOW_VECTORS = {"acf": 5, "pacf": 5, "chroma": 12, "mfcc_mean": 13, "mfcc_std": 13}


@dataclass(frozen=True)
class EngineConfig:
    """Defaults: frames in seconds, horizons in steps."""

    window: float = 0.5
    hop: float = 0.25
    n_fft: int = 2048
    fft_hop: int = 512
    n_mels: int = 128
    n_mfcc: int = 20
    horizon: int = 20
    volatility_window: int = 10
    min_points_deep: int = 50
    hmm_states: int = 3
    seed: int = 42


def feature_names() -> list[str]:
    """The 61 names of a flattened window feature vector, in order."""
    return [*WINDOW_SCALARS, *(f"{k}_{j}" for k, n in WINDOW_VECTORS.items() for j in range(n))]
