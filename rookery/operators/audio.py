"""Array kernels on audio samples (array<float>)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rookery.functions.vectors import let

FRAME, FLOOR_DB, PADDING_S = 256, -42.0, 0.12
RATE = 16_000


def _trimmed(x: np.ndarray, rate: int) -> np.ndarray:
    frames = len(x) // FRAME
    if not frames:
        return x
    rms = np.sqrt((x[: frames * FRAME].reshape(frames, FRAME).astype(np.float64) ** 2).mean(1) + 1e-12)
    loud = np.flatnonzero(20 * np.log10(rms) > FLOOR_DB)
    if not len(loud):
        return x
    pad = int(PADDING_S * rate)
    return x[max(0, loud[0] * FRAME - pad) : min(len(x), (loud[-1] + 1) * FRAME + pad)]


def trim_silence(df: DataFrame, samples: str, rate: int = RATE, out: str = "trimmed") -> DataFrame:
    """df with the stretch from the first to the last loud frame, padded; all-quiet clips stay whole."""

    @F.pandas_udf("array<float>")
    def trim(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else _trimmed(np.asarray(x, np.float32), rate))

    return df.withColumn(out, trim(samples))


def quality_flags(samples: Column, rate: int = RATE) -> Column:
    """Names of what is wrong: too_short, clipped, too_quiet, no_signal."""
    n = F.size(samples)
    square = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    peak = F.array_max(F.transform(samples, lambda x: F.abs(x)))
    clipped = F.size(F.filter(samples, lambda x: F.abs(x) > 0.999))
    rms_db = 20 * F.log10(F.sqrt(square / F.greatest(n, F.lit(1))) + 1e-12)
    flags = [("too_short", n / rate < 0.3), ("clipped", clipped > 8), ("too_quiet", rms_db < -45), ("no_signal", F.coalesce(peak, F.lit(0.0)) < 0.02)]
    return F.array_compact(F.array(*[F.when(c, name) for name, c in flags]))


def augment(df: DataFrame, samples: str, key: str, seed: int, out: str = "augmented") -> DataFrame:
    """df with gain, noise at a random ratio, an echo for half, and peaks limited to 0.99; by (seed, key) only."""

    @F.pandas_udf("array<float>")
    def change(s: pd.Series, k: pd.Series) -> pd.Series:
        def one(x, number):
            if x is None:
                return None
            rng = np.random.default_rng([seed, int(number)])
            y = np.asarray(x, np.float32) * rng.uniform(0.6, 1.15)
            power = float((y.astype(np.float64) ** 2).mean()) if len(y) else 0.0
            y = y + rng.normal(0, np.sqrt(power / 10 ** (rng.uniform(15, 35) / 10)) if power else 0.0, len(y))
            delay = int(rng.uniform(0.02, 0.06) * RATE)
            if rng.random() < 0.5 and len(y) > delay:
                y[delay:] += 0.25 * y[:-delay]
            peak = np.abs(y).max() if len(y) else 0.0
            return (y * (0.99 / peak) if peak > 0.99 else y).astype(np.float32)

        return pd.Series([one(x, n) for x, n in zip(s, k)])

    return df.withColumn(out, change(samples, key))


def peak_normalised(samples: Column, to: float = 0.95) -> Column:
    """Scaled so that the peak is `to`; silence stays."""
    peak = F.array_max(F.transform(samples, lambda x: F.abs(x)))
    return let(peak, lambda p: F.when(p > 0, F.transform(samples, lambda x: (x / p * to).cast("float"))).otherwise(samples))


def resampled(df: DataFrame, samples: str, rate: str, to: int = RATE, out: str = "resampled") -> DataFrame:
    """df with samples brought to `to` per second by linear interpolation; clips under 0.2 s become null."""

    @F.pandas_udf("array<float>")
    def change(s: pd.Series, r: pd.Series) -> pd.Series:
        def one(x, have):
            if x is None or have is None or len(x) < 0.2 * have:
                return None
            m = int(round(len(x) * to / have))
            return np.interp(np.arange(m) * have / to, np.arange(len(x)), np.asarray(x, np.float64)).astype(np.float32)

        return pd.Series([one(x, have) for x, have in zip(s, r)])

    return df.withColumn(out, change(samples, rate))
