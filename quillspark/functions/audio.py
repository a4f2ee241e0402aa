"""Numeric transforms of audio samples (arrays of float)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def mono(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: (a + b) / 2)


def scaled(samples: Column) -> Column:
    """Samples as -1 .. 1: divided by 32768 if any is beyond 1.5."""
    peak = F.aggregate(samples, F.lit(0.0).cast("double"), lambda m, x: F.greatest(m, F.abs(x.cast("double"))))
    return F.transform(samples, lambda x: F.when(peak > 1.5, x.cast("double") / 32768.0).otherwise(x.cast("double")))


def rms(samples: Column) -> Column:
    total = F.aggregate(samples, F.lit(0.0).cast("double"), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.when(F.size(samples) > 0, F.sqrt(total / F.size(samples))).otherwise(F.lit(0.0))


def dbfs(samples: Column, floor: float = -120.0) -> Column:
    r = rms(samples)
    return F.when(r > 0, F.greatest(F.lit(floor), 20 * F.log10(r))).otherwise(F.lit(floor))


def gained(samples: Column, target: float, most: float = 10.0) -> Column:
    """Samples at the target level, by a bounded gain, clipped to -1 .. 1."""
    r = rms(samples)
    gain = F.when(r > 0, F.least(F.lit(target) / r, F.lit(most))).otherwise(F.lit(1.0))
    return F.transform(samples, lambda x: F.least(F.lit(1.0), F.greatest(F.lit(-1.0), x.cast("double") * gain)))


def resampled(source_rate: int, target_rate: int):
    """Column function: linear interpolation from one rate to another."""

    @F.pandas_udf("array<double>")
    def run(samples: pd.Series) -> pd.Series:
        def one(x):
            x = np.asarray(x, dtype=np.float64)
            n = int(round(len(x) * target_rate / source_rate))
            return np.interp(np.arange(n) * source_rate / target_rate, np.arange(len(x)), x) if len(x) else x

        return samples.map(one, na_action="ignore")

    return run


def high_pass(cutoff: float, rate: float) -> tuple[float, float, float]:
    """(b, a1, a2) of the second-order Butterworth high-pass b (1 - 2/z + 1/z^2) / (1 + a1/z + a2/z^2), by the bilinear map."""
    if not 0 < cutoff < rate / 2:
        raise ValueError(f"a cutoff of {cutoff} Hz is outside 0 .. {rate / 2} Hz")
    k = math.tan(math.pi * cutoff / rate)
    b = 1 / (1 + math.sqrt(2) * k + k * k)
    return b, 2 * (k * k - 1) * b, (1 - math.sqrt(2) * k + k * k) * b


def filtered(samples: list[float | None], state: tuple[float, float], filter_: tuple[float, float, float]) -> tuple[list[float], tuple[float, float]]:
    """The filter's output and the state to go on with; null samples are silence."""
    (b, a1, a2), (z1, z2), out = filter_, state, []
    for x in samples:
        x = x or 0.0
        y = b * x + z1
        z1 = -2 * b * x - a1 * y + z2
        z2 = b * x - a2 * y
        out.append(y)
    return out, (z1, z2)
