"""Integer helpers of the planner and of index arithmetic: plain Python, and Columns where rows need them."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column
from pyspark.sql import functions as F

S = TypeVar("S")


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, math.isqrt(n) + 1))


def is_power_of_2(n: int) -> bool:
    return n > 0 and n & (n - 1) == 0


def log2(n: int) -> int:
    """The largest k with 2**k <= n."""
    if n < 1:
        raise ValueError("log2 of a number below 1")
    return n.bit_length() - 1


def sqrt(n: int) -> int:
    return math.isqrt(n)


def least_significant_one_bit(n: int) -> int:
    return n & -n


def is_odd(n: int) -> bool:
    return n % 2 == 1


def is_even(n: int) -> bool:
    return n % 2 == 0


def power(x: S, n: int, times: Callable[[S, S], S], one: S | None = None, inverse: Callable[[S], S] | None = None) -> S:
    """x to the n by repeated squaring, for any associative product: n >= 1; n = 0 needs `one`, n < 0 `inverse`."""
    if n < 0:
        if inverse is None:
            raise ValueError("a negative power needs an inverse")
        return power(inverse(x), -n, times, one)
    if n == 0:
        if one is None:
            raise ValueError("power 0 needs an identity")
        return one
    result: S | None = None
    while n:
        if n & 1:
            result = x if result is None else times(result, x)
        n >>= 1
        if n:
            x = times(x, x)
    return result  # type: ignore[return-value]


def interleave(i: Column, j: Column, bits: int = 16) -> Column:
    """The place of block (i, j) on the Z-order curve."""
    spread = lambda x, by: sum((F.shiftleft(F.shiftright(x, k).bitwiseAND(1), 2 * k + by) for k in range(bits)), F.lit(0).cast("long"))
    return spread(i.cast("long"), 1) + spread(j.cast("long"), 0)
