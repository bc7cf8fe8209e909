"""Triangular mel filter bank, as a constant table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def _to_mel(f):
    """Linear below 1 kHz (200/3 Hz a mel), logarithmic above (27 mels for each factor of 6.4)."""
    f = np.asarray(f, dtype=float)
    return np.where(f < 1000, f * 3 / 200, 15 + 27 * np.log(np.maximum(f, 1e-9) / 1000) / np.log(6.4))


def _to_hz(m):
    m = np.asarray(m, dtype=float)
    return np.where(m < 15, m * 200 / 3, 1000 * np.exp((m - 15) * np.log(6.4) / 27))


def mel_weights(rate: int = 44100, n_fft: int = 1024, n_mels: int = 40, low: float = 20, high: float | None = None) -> np.ndarray:
    """(n_mels, n_fft // 2 + 1) triangles of unit area over band edges evenly spaced in mels."""
    edges = _to_hz(np.linspace(_to_mel(low), _to_mel(high or rate // 2), n_mels + 2))
    bins = np.arange(n_fft // 2 + 1) * rate / n_fft
    rise = (bins - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    fall = (edges[2:, None] - bins) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(rise, fall)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def mel_table(spark: SparkSession, **options) -> DataFrame:
    """Rows (mel, bin, weight) of the non-zero weights: a few thousand at most."""
    w = mel_weights(**options)
    rows = [(int(m), int(b), float(w[m, b])) for m, b in zip(*np.nonzero(w), strict=True)]
    return spark.createDataFrame(rows, "mel int, bin int, weight double")
