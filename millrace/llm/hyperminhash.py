"""HyperMinHash sketches: per bucket, the leading zeros of the least hash and the bits that follow its first one."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from millrace.llm.text import remix

MANTISSA_BITS = 10


@lru_cache(maxsize=4)
def _probes(buckets: int, rounds: int = 64) -> np.ndarray:
    """For each round, the bucket that an empty bucket looks into: the same for all texts, so that equal sets fill equally."""
    x = remix(np.arange(1, rounds * buckets + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (x % np.uint64(buckets)).astype(np.int64).reshape(rounds, buckets)


def sketch(hashes: np.ndarray, starts: np.ndarray, buckets: int) -> np.ndarray:
    """Registers (uint16, texts x buckets) of the sets of hashes; a text without hashes has registers of zeros.

    Each hash falls into one bucket (one permutation). A bucket that got none takes the value of the first filled one among
    64 that are drawn for it, else the text's least value, so that small sets can be compared register by register.
    """
    n = len(starts) - 1
    owner = np.repeat(np.arange(n), np.diff(starts))
    spread = remix(hashes + np.uint64(0x5851F42D4C957F2D))
    bucket = ((spread >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    value = remix(spread)
    least = np.full(n * buckets, np.uint64(2**64 - 1))
    np.minimum.at(least, owner * buckets + bucket.astype(np.int64), value)
    filled = np.zeros(n * buckets, bool)
    filled[owner * buckets + bucket.astype(np.int64)] = True
    some = np.flatnonzero(np.diff(starts) > 0)
    todo = (some[:, None] * buckets + np.arange(buckets)).ravel()
    todo = todo[~filled[todo]]
    source = least.copy()
    for probe in _probes(buckets):
        if not len(todo):
            break
        at = (todo // buckets) * buckets + probe[todo % buckets]
        hit = filled[at]
        least[todo[hit]] = source[at[hit]]
        todo = todo[~hit]
    if len(todo):
        least[todo] = source.reshape(n, buckets).min(axis=1)[todo // buckets]
    cut = least >> np.uint64(11)
    exponent = np.frexp(cut.astype(np.float64))[1].astype(np.uint64)
    zeros = np.uint64(53) - exponent
    mantissa = ((cut << zeros) >> np.uint64(52 - MANTISSA_BITS)) & np.uint64((1 << MANTISSA_BITS) - 1)
    registers = ((zeros << np.uint64(MANTISSA_BITS)) | mantissa).astype(np.uint16).reshape(n, buckets)
    registers[np.diff(starts) == 0] = 0
    return registers


@lru_cache(maxsize=4)
def _cells(buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bound, as shares of the hash range, of each value that a register can take."""
    zeros = np.arange(40)[:, None]
    mantissa = np.arange(1 << MANTISSA_BITS)[None, :]
    low = (1 + mantissa / (1 << MANTISSA_BITS)) / 2.0 ** (zeros + 1)
    return low.ravel(), (low + 2.0 ** -(zeros + 1) / (1 << MANTISSA_BITS)).ravel()


@lru_cache(maxsize=65536)
def _cell_chances(level: int, buckets: int) -> np.ndarray:
    """Chance of each register value for a set of about 2 ** (level / 2) hashes, of which every bucket gets its share."""
    low, high = _cells(buckets)
    share = max(1.0, 2.0 ** (level / 2) / buckets)
    with np.errstate(under="ignore"):
        return (np.exp(share * np.log1p(-low)) - np.exp(share * np.log1p(-np.minimum(high, 1 - 1e-16)))).astype(np.float32)


@lru_cache(maxsize=65536)
def collisions(level_a: int, level_b: int, buckets: int) -> float:
    """Chance that a register of two unrelated sets of these sizes (in half powers of two) is equal."""
    return float(_cell_chances(level_a, buckets) @ _cell_chances(level_b, buckets))


def level(n: int) -> int:
    return int(round(2 * np.log2(max(1, n))))


def corrected_jaccard(equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, buckets: int) -> np.ndarray:
    """Jaccard estimates from the numbers of equal registers, less the collisions that are to be expected by chance."""
    pairs = {(level(a), level(b)) for a, b in zip(n_a.tolist(), n_b.tolist(), strict=True)}
    table = {p: collisions(min(p), max(p), buckets) for p in pairs}
    chance = np.array([table[level(a), level(b)] for a, b in zip(n_a.tolist(), n_b.tolist(), strict=True)])
    return np.clip((equal / buckets - chance) / np.maximum(1 - chance, 1e-9), 0, 1)
