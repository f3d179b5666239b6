"""Shuffles of row numbers by arithmetic: keyed bijections of 0..n-1, without a sort or a prefix sum.

A number is split into digits (left, right) of a rectangle ``a * b`` that just holds ``n`` numbers. Rounds add to one
digit, modulo its size, a hash of the other: each round can be undone, so the whole is a bijection of the rectangle (a
Feistel network). Numbers that land beyond ``n`` go on through it until they land inside (cycle walking), which is a
bijection of 0..n-1. The rectangle has fewer than ``a`` numbers too many, so up to ``WALK``**2 numbers a walk ends
within ``WALK`` steps; above, each step stays outside with a chance below 1 / sqrt(n), and a walk of so many does not
happen (a chance below 10**-60). The hash is a square modulo a prime: plain integer arithmetic that SQL can restate.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = 2_147_483_647  # squares of remainders fit a long
ROUNDS = 4
WALK = 40


def rectangle(n: int) -> tuple[int, int]:
    """The sides of the rectangle for ``n`` numbers."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def _let(x: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often it occurs there."""
    return F.get(F.transform(F.array(x), lambda v: then(v)), F.lit(0))


def _hash(x: Column, key: Column, turn: int) -> Column:
    return _let((x * 48271 + key * 69621 + (turn + 1) * 16807) % PRIME,
                lambda t: _let((t * t + x + key) % PRIME, lambda u: (u * u + turn) % PRIME))


def _rounds(left: Column, right: Column, key: Column, a: int, b: int, turn: int = 0) -> Column:
    if turn == ROUNDS:
        return left * b + right
    if turn % 2:
        return _let((right + _hash(left, key, turn)) % b, lambda r: _rounds(left, r, key, a, b, turn + 1))
    return _let((left + _hash(right, key, turn)) % a, lambda x: _rounds(x, right, key, a, b, turn + 1))


def _once(i: Column, key: Column, a: int, b: int) -> Column:
    return _let(F.floor(i / b), lambda left: _let(i % b, lambda right: _rounds(left, right, key, a, b)))


def shuffled(i: Column, n: int, key: Column) -> Column:
    """The place (from 0) of number ``i`` (from 0) in the shuffle of 0..n-1 that ``key`` (0 to 10**9) names."""
    a, b = rectangle(n)
    i, key = i.cast("long"), key.cast("long")
    start = _once(i, key, a, b)
    if a * b == n:
        return start
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), start,
                       lambda at, _: F.when(at < n, at).otherwise(_once(at, key, a, b)))
