"""Quality: rejection by thresholds, and the pixel measurements behind it."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class QualityLimits:
    min_width: int = 256
    min_height: int = 256
    min_blur: float = 20.0
    min_brightness: float = 20.0
    max_brightness: float = 235.0

    def __post_init__(self) -> None:
        if self.min_width < 1 or self.min_height < 1:
            raise ValueError("least sizes are 1 or more")
        if not 0 <= self.min_brightness <= self.max_brightness <= 255:
            raise ValueError("0 <= least <= most brightness <= 255 must hold")


def rejection_reason(limits: QualityLimits) -> Column:
    """NULL, or the first of unreadable, too_small, blurry, too_dark, too_bright that holds."""
    return (
        F.when(F.coalesce(F.col("width"), F.lit(0)) <= 0, "unreadable")
        .when((F.col("width") < limits.min_width) | (F.col("height") < limits.min_height), "too_small")
        .when(F.col("blur_score") < limits.min_blur, "blurry")
        .when(F.col("brightness") < limits.min_brightness, "too_dark")
        .when(F.col("brightness") > limits.max_brightness, "too_bright")
    )


def measure(gray: np.ndarray) -> tuple[float, float]:
    """(blur score, brightness): population variance of the edge-filtered picture without its border, and the mean."""
    g = gray.astype(np.float64)
    p = np.pad(g, 1, mode="edge")
    around = sum(p[1 + dy : 1 + dy + g.shape[0], 1 + dx : 1 + dx + g.shape[1]] for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx)
    edges = np.clip(8 * g - around, 0, 255)
    edges[[0, -1], :], edges[:, [0, -1]] = g[[0, -1], :], g[:, [0, -1]]
    inner = edges[1:-1, 1:-1] if min(g.shape) > 2 else edges
    return float(inner.var()), float(g.mean())
