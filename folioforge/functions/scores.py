"""Signal scorers: raw signal -> 0..100, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.functions.numeric import clip

# Signal order, weights per preset in that order.
SIGNALS = [
    "momentum_12_1", "rsi_14", "sma_trend", "realized_vol_20", "volume_trend", "macd",
    "bollinger_pctb", "atr_pct", "obv_trend", "roc_20",
]
PRESET_WEIGHTS: dict[str, list[float]] = {
    "Momentum": [0.14, 0.04, 0.16, 0.04, 0.08, 0.14, 0.04, 0.08, 0.14, 0.14],
    "Balanced": [0.10, 0.08, 0.13, 0.08, 0.10, 0.10, 0.08, 0.10, 0.13, 0.10],
    "Defensive": [0.06, 0.12, 0.11, 0.14, 0.10, 0.06, 0.12, 0.14, 0.10, 0.05],
}
# Straight-line scorers as (raw value scoring 0, raw value scoring 100).
LINEAR_BOUNDS: dict[str, tuple[float, float]] = {
    "momentum_12_1": (-0.3, 0.7),
    "sma_trend": (-0.3, 0.5),
    "realized_vol_20": (1.0, 0.0),
    "volume_trend": (0.5, 2.5),
    "macd": (-0.02, 0.02),
    "atr_pct": (0.10, 0.005),
    "obv_trend": (-1.5, 1.5),
    "roc_20": (-0.15, 0.20),
}
# Contrarian scorers as segments (upper raw bound, raw range, score range at its ends).
# The last segment is open-ended; every segment is clipped to its own score range.
SEGMENTS: dict[str, list[tuple[float | None, tuple[float, float], tuple[float, float]]]] = {
    "rsi_14": [
        (30.0, (0.0, 30.0), (100.0, 80.0)),
        (50.0, (30.0, 50.0), (80.0, 50.0)),
        (70.0, (50.0, 70.0), (50.0, 30.0)),
        (None, (70.0, 100.0), (30.0, 0.0)),
    ],
    "bollinger_pctb": [
        (0.2, (0.0, 0.2), (100.0, 70.0)),
        (0.5, (0.2, 0.5), (70.0, 40.0)),
        (0.8, (0.5, 0.8), (40.0, 25.0)),
        (None, (0.8, 1.2), (25.0, 0.0)),
    ],
}


def _interpolate(x: Column, raw: tuple[float, float], score: tuple[float, float]) -> Column:
    """Straight line through the two (raw, score) points."""
    return F.lit(score[0]) + (x - raw[0]) / (raw[1] - raw[0]) * (score[1] - score[0])


def score_signal(name: str, x: Column) -> Column:
    """Unrounded score of one signal; null stays null."""
    if name in LINEAR_BOUNDS:
        return clip(_interpolate(x, LINEAR_BOUNDS[name], (0.0, 100.0)), 0.0, 100.0)
    result = None
    for upper, raw, score in SEGMENTS[name]:
        piece = clip(_interpolate(x, raw, score), min(score), max(score))
        inside = x.isNotNull() if upper is None else x <= upper
        result = F.when(inside, piece) if result is None else result.when(inside, piece)
    return result


def rounded_score(name: str, x: Column) -> Column:
    return F.bround(score_signal(name, x), 1)


def composite(scores: dict[str, Column], preset: str = "Balanced") -> Column:
    """Weighted mean over the non-null scores, renormalized; an unknown preset means Balanced."""
    weights = dict(zip(SIGNALS, PRESET_WEIGHTS.get(preset, PRESET_WEIGHTS["Balanced"])))
    return F.bround(weighted_mean(scores, weights), 1)


def weighted_mean(values: dict[str, Column], weights: dict[str, float]) -> Column:
    """Sum(w*v)/Sum(w) over the non-null values; null when all are null."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for name, w in weights.items():
        v = values[name]
        total = total + F.when(v.isNotNull(), v * w).otherwise(0.0)
        weight = weight + F.when(v.isNotNull(), F.lit(w)).otherwise(0.0)
    return F.try_divide(total, weight)


def score_band(score: Column) -> Column:
    # Thresholds.
    return F.when(score.isNull(), "none").when(score >= 70, "high").when(score >= 40, "mid").otherwise("low")
