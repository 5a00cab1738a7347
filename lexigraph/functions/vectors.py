"""Vector expressions: magnitude, cosine, sign-sampling signatures."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seed of the index draws, bands of a signature and bits of a band: fixed values, which stored signatures depend on.
SEED, BANDS, BITS = 0xC0FFEE, 4, 16


def mulberry32(seed: int):
    """The published 32-bit generator: numbers in [0, 1)."""
    state = seed & 0xFFFFFFFF
    mask = 0xFFFFFFFF

    def draw() -> float:
        nonlocal state
        state = (state + 0x6D2B79F5) & mask
        t = ((state ^ (state >> 15)) * (state | 1)) & mask
        t ^= (t + ((t ^ (t >> 7)) * (t | 61) & mask)) & mask
        return ((t ^ (t >> 14)) & mask) / 4294967296

    return draw


@functools.cache
def band_indices(dims: int) -> tuple[int, ...]:
    """Coordinates whose signs a signature samples, with replacement."""
    draw = mulberry32(SEED)
    return tuple(math.floor(draw() * dims) for _ in range(BANDS * BITS))


def magnitude(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null if sizes differ, an element is missing, or a magnitude is 0."""
    return F.when(F.size(a) == F.size(b), dot(a, b) / F.nullif(magnitude(a) * magnitude(b), F.lit(0.0)))


def cosine_to(query: list[float], v: Column) -> Column:
    """Cosine with a known vector: unrolled sums, which whole-stage code generation compiles, unlike lambdas."""
    size = math.sqrt(sum(x * x for x in query))
    at = [v[i].cast("double") for i in range(len(query))]
    top = functools.reduce(lambda s, x: s + x, (c * F.lit(float(q)) for c, q in zip(at, query, strict=True)), F.lit(0.0))
    own = functools.reduce(lambda s, x: s + x, (c * c for c in at), F.lit(0.0))
    return F.when(F.size(v) == len(query), top / F.nullif(F.lit(size) * F.sqrt(own), F.lit(0.0)))


def bands(v: Column, dims: int) -> list[Column]:
    """The four band values of a signature: bit i is set where the sampled coordinate isn't negative (or is missing)."""
    at = band_indices(dims)
    bit = lambda i: F.coalesce(F.get(v, F.lit(i)), F.lit(0.0)) >= 0
    return [F.when(F.size(v) > 0, functools.reduce(lambda s, x: s + x, (F.when(bit(i), 1 << k).otherwise(0) for k, i in enumerate(at[b * BITS : (b + 1) * BITS])))).cast("int") for b in range(BANDS)]


def bands_of(v: list[float]) -> list[int] | None:
    """As `bands`, of a vector on the driver."""
    if not v:
        return None
    at = band_indices(len(v))
    return [sum((v[i] >= 0) << k for k, i in enumerate(at[b * BITS : (b + 1) * BITS])) for b in range(BANDS)]


def decode(text: Column) -> Column:
    """A JSON array of numbers as a vector; null if it isn't one."""
    return F.from_json(text, "array<double>")


def encode(v: Column) -> Column:
    return F.to_json(v)
