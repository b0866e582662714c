"""Random draws as hashes of keys, so that any engine and any partitioning repeats them."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def mixed(x: np.ndarray) -> np.ndarray:
    """A 32-bit hash of 32-bit numbers, every bit spread over all."""
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(2246822507)
    x = x ^ (x >> np.uint32(13))
    x = x * np.uint32(3266489909)
    return x ^ (x >> np.uint32(16))


#: a hash below the k-th of these, and not below those before it, is k draws: the distribution of a Poisson number of mean 1, in units of 2 ** -32
POISSON = np.array([math.floor(2**32 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(12)], np.uint32)


def draws(seed: int, reps: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """How often each replicate (rows) draws each thing (columns; two 32-bit halves of its key)."""
    r = mixed(reps.astype(np.uint32) * np.uint32(2654435769) + np.uint32(seed))
    u = mixed(mixed(r[:, None] ^ high[None, :].astype(np.uint32)) ^ low[None, :].astype(np.uint32))
    n = np.zeros(u.shape, np.uint8)
    for bound in POISSON:
        above = u >= bound
        if not above.any():
            break
        n += above
    return n.astype(np.float64)


def halves(*key: Column) -> tuple[Column, Column]:
    """Two 32-bit halves of the md5 of a key: its columns' text, joined by colons."""
    text = F.md5(F.concat_ws(":", *(k.cast("string") for k in key)))
    return tuple(F.conv(F.substring(text, at, 8), 16, 10).cast("long") for at in (1, 9))
