"""Uniforms that depend only on (seed, step, record): a retried task draws the same numbers.

The same 32-bit integer mixer is given three times: as column arithmetic (BIGINT, no overflow), as
SQL text that another engine can run, and for numpy blocks inside Arrow functions. Two of its hashes
make a uniform with a full double's precision.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F

# Multipliers of the integer mixer (each product stays below 2^63).
MIX_A = 0x21F0AAAD
MIX_B = 0x735A2D97
MASK32 = 0xFFFFFFFF
# Fixed value: a gamma draw whose logarithm is below this changes no sum of doubles beside an ordinary one.
NEGLIGIBLE = -100.0
# Numbers hashed at once: a piece and its scratch space stay in a processor's second cache.
CACHED_CELLS = 1 << 16
# Fixed value: last stream number of the second hash of a uniform.
SECOND_HALF = 0x6C6F77


def _mix(x: Column) -> Column:
    x = x.bitwiseXOR(F.shiftright(x, 16))
    x = (x * F.lit(MIX_A)).bitwiseAND(F.lit(MASK32))
    x = x.bitwiseXOR(F.shiftright(x, 15))
    x = (x * F.lit(MIX_B)).bitwiseAND(F.lit(MASK32))
    return x.bitwiseXOR(F.shiftright(x, 15))


def _mix_int(x: int) -> int:
    x ^= x >> 16
    x = x * MIX_A & MASK32
    x ^= x >> 15
    x = x * MIX_B & MASK32
    return x ^ x >> 15


def stream_key(*parts: int) -> int:
    """One 32-bit key from whole numbers such as (seed, sweep, axis)."""
    key = 0x9E3779B9
    for part in parts:
        key = _mix_int((key ^ part) & MASK32) ^ _mix_int(part >> 32 & MASK32)
    return key


def _hash(r: Column, key: int) -> Column:
    low = r.bitwiseAND(F.lit(MASK32)).bitwiseXOR(F.lit(key))
    high = F.shiftright(r, 32).bitwiseAND(F.lit(MASK32))
    return _mix(_mix(low).bitwiseXOR(high))


def halves(*stream: int) -> tuple[int, int]:
    """The keys of the two hashes whose upper 26 bits make up one uniform."""
    return stream_key(*stream), stream_key(*stream, SECOND_HALF)


def uniform(record: Column | str, *stream: int) -> Column:
    """Uniform in (0, 1) of a BIGINT record number under the given stream numbers: an odd multiple
    of 2^-53, from 26 bits each of two hashes."""
    r = (F.col(record) if isinstance(record, str) else record).cast("bigint")
    first, second = (F.shiftright(_hash(r, key), 6).cast("double") for key in halves(*stream))
    return (first * F.lit(67108864.0) + second + F.lit(0.5)) / F.lit(4503599627370496.0)


def uniform_sql(record: str, *stream: int) -> str:
    """The expression of :func:`uniform` as ANSI-style SQL text (for checks in another engine)."""
    first, second = halves(*stream)
    return uniform_sql_of(record, f"{first}::BIGINT", f"{second}::BIGINT")


def uniform_sql_of(record: str, first: str, second: str) -> str:
    """As :func:`uniform_sql`, with the keys of the two halves as SQL expressions."""
    def mix(x: str) -> str:
        a = f"xor({x}, ({x}) >> 16)"
        b = f"((({a}) * {MIX_A}) & {MASK32})"
        c = f"xor({b}, ({b}) >> 15)"
        d = f"((({c}) * {MIX_B}) & {MASK32})"
        return f"xor({d}, ({d}) >> 15)"

    def half(key: str) -> str:
        low = f"xor(({record})::BIGINT & {MASK32}, {key})"
        high = f"((({record})::BIGINT >> 32) & {MASK32})"
        return f"(({mix(f'xor({mix(low)}, {high})')}) >> 6)::DOUBLE"

    return f"(({half(first)} * 67108864.0::DOUBLE + {half(second)} + 0.5) / 4503599627370496.0::DOUBLE)"


def _np_hash(record: np.ndarray, key: int) -> np.ndarray:
    a, b = np.uint32(MIX_A), np.uint32(MIX_B)

    def mix(x: np.ndarray) -> np.ndarray:
        x ^= x >> np.uint32(16)
        x *= a
        x ^= x >> np.uint32(15)
        x *= b
        x ^= x >> np.uint32(15)
        return x

    r = np.asarray(record).astype(np.uint64, copy=False)
    low, high = r.astype(np.uint32), (r >> np.uint64(32)).astype(np.uint32)
    low ^= np.uint32(key)
    x = mix(low)
    x ^= high
    return mix(x)


def np_uniform(record: np.ndarray, *stream: int) -> np.ndarray:
    """The same numbers as :func:`uniform`, for a numpy block of whole numbers."""
    first, second = (_np_hash(record, key) >> np.uint32(6) for key in halves(*stream))
    return (first * 67108864.0 + second + 0.5) / 4503599627370496.0


def np_may_exceed(record: np.ndarray, level: float, *stream: int) -> np.ndarray:
    """Where :func:`np_uniform` may be above a level, judged by the first of its two hashes alone:
    true wherever it is, and at most 2^-26 further down."""
    first = _np_hash(record, halves(*stream)[0]) >> np.uint32(6)
    return first >= np.uint32(max(0.0, level) * 67108864.0)


def np_exceeding(first: np.ndarray, width: int, level: float, *stream: int) -> np.ndarray:
    """Positions at which :func:`np_may_exceed` holds, in order, for rows of ``width`` successive whole
    numbers that start at ``first``. Numbers are hashed in pieces that a processor's cache holds."""
    limit = int(max(0.0, level) * 67108864.0) << 6
    if limit > MASK32:
        return np.zeros(0, dtype=np.int64)
    key, across = np.uint32(halves(*stream)[0]), np.arange(width, dtype=np.uint64)
    a, b = np.uint32(MIX_A), np.uint32(MIX_B)
    rows, out = max(1, CACHED_CELLS // max(width, 1)), [np.zeros(0, dtype=np.int64)]
    shifted = np.empty((rows, width), dtype=np.uint32)

    def mix(x: np.ndarray) -> None:
        t = shifted[: len(x)]
        for shift, factor in ((16, a), (15, b), (15, None)):
            np.right_shift(x, np.uint32(shift), out=t)
            np.bitwise_xor(x, t, out=x)
            if factor is not None:
                np.multiply(x, factor, out=x)

    for at in range(0, len(first), rows):
        start = first[at : at + rows].astype(np.uint64)
        low, high = start.astype(np.uint32), (start >> np.uint64(32)).astype(np.uint32)
        # wraps as the lower half of the number does
        x = low[:, None] + across.astype(np.uint32)
        if (((start + np.uint64(max(width - 1, 0))) >> np.uint64(32)).astype(np.uint32) != high).any():
            high = ((start[:, None] + across) >> np.uint64(32)).astype(np.uint32)
        else:
            high = high[:, None]
        x ^= key
        mix(x)
        if high.any():
            x ^= high
        mix(x)
        out.append(np.flatnonzero(x >= np.uint32(limit)) + at * width)
    return np.concatenate(out)


def np_log_gamma_draws(shape: np.ndarray, counter: np.ndarray, *stream: int) -> np.ndarray:
    """Logarithms of Gamma(shape, 1) draws, one per entry, by Marsaglia and Tsang's method.

    Working with logs keeps shapes near zero from underflowing: a draw of shape a is a draw of
    shape a + 1 times U^(1/a). Where the latter alone is below e^NEGLIGIBLE, as for most cells of a
    long axis, it stands for the draw.
    """
    shape = np.asarray(shape, dtype=np.float64)
    counter = np.asarray(counter, dtype=np.uint64)
    d = shape + 1.0 - 1.0 / 3.0
    c = 1.0 / np.sqrt(9.0 * d)
    flat_d, flat_c, flat_n = d.ravel(), c.ravel(), counter.ravel()
    boost = np.log(np_uniform(flat_n, *stream, 0, 4)) / shape.ravel()
    flat = np.zeros(shape.size)
    todo = np.flatnonzero(boost > NEGLIGIBLE)
    attempt = 0
    while todo.size:
        n = flat_n[todo]
        radius = np.sqrt(-2.0 * np.log(np_uniform(n, *stream, attempt, 1)))
        normal = radius * np.cos(2.0 * np.pi * np_uniform(n, *stream, attempt, 2))
        u = np_uniform(n, *stream, attempt, 3)
        dd = flat_d[todo]
        v = (1.0 + flat_c[todo] * normal) ** 3
        ok = v > 0
        logv = np.log(np.where(ok, v, 1.0))
        ok &= np.log(u) < 0.5 * normal**2 + dd - dd * v + dd * logv
        flat[todo[ok]] = np.log(dd[ok]) + logv[ok]
        todo = todo[~ok]
        attempt += 1
    return (flat + boost).reshape(shape.shape)
