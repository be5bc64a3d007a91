"""Waveforms as arrays of doubles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def level(x: Column) -> Column:
    """Root mean square; 0 of no samples."""
    return F.when(F.size(x) > 0, F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v) / F.size(x))).otherwise(0.0)


def with_noise(x: Column, noise: Column, decibels: Column) -> Column:
    """x with noise of the same length so many decibels below it; without noise of any level x itself."""
    gain = F.when(level(noise) > 0, level(x) / level(noise) / F.pow(F.lit(10.0), decibels / 20)).otherwise(0.0)
    pair = F.array(F.struct(x.alias("x"), noise.alias("n"), gain.alias("g")))
    return F.get(F.transform(pair, lambda p: F.zip_with(p["x"], p["n"], lambda v, n: v + n * p["g"])), 0)


def with_echoes(x: Column, delay: int, gains: Sequence[float]) -> Column:
    """x with itself again after each multiple of the delay, by those gains."""
    late = lambda i, k: F.when(i >= k * delay, F.get(x, i - k * delay)).otherwise(0.0)
    return F.transform(x, lambda v, i: sum((late(i, k) * g for k, g in enumerate(gains, 1)), v))


def masked(x: Column, start: Column, length: int) -> Column:
    """x with a stretch of silence."""
    return F.transform(x, lambda v, i: F.when((i >= start) & (i < start + length), 0.0).otherwise(v))


def masked_bands(frames: Column, first: Column, bands: int) -> Column:
    """Frames (an array of arrays, one value for each band) with neighbouring bands silenced in all of them."""
    return F.transform(frames, lambda f: masked(f, first, bands))
