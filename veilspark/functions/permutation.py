"""A keyed permutation of 0..size-1, computed for each value by itself: no table, whatever the size.

A balanced Feistel network over two digits, of base a and b with a * b just above ``size``: each round adds a keyed hash of one
digit to the other, which its inverse subtracts. A result outside the domain goes through the network again until it falls inside
(cycle walking), which keeps the whole a bijection. At most a - 1 of the a * b values lie outside, so a second turn is rare.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from veilspark.functions.crypto import bind, fail_unless

ROUNDS = 8

#: Turns allowed. A value needs more only if so many results in a row lie outside: never for domains up to some 4,000, where fewer lie
#: outside at all, and beyond with a chance below 10^-100. Such a value fails the job.
TURNS = 64

LARGEST = 1 << 60


def bases(size: int) -> tuple[int, int]:
    """The bases of the two digits."""
    if not 1 <= size <= LARGEST:
        raise ValueError(f"a permutation needs a size between 1 and {LARGEST}")
    low = math.isqrt(size - 1) + 1
    return low, -(-size // low)


def _round_value(seed: Column, number: Column, digit: Column) -> Column:
    """60 bits of a keyed hash of the round and a digit."""
    digest = F.sha2(F.concat_ws("|", seed, number.cast("string"), digit.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def _turn(value: Column, low: int, high: int, seed: Column, inverse: bool) -> Column:
    """One pass through the network."""

    def step(digits: Column, number: Column) -> Column:
        first = number % 2 == 1
        base = F.when(first, F.lit(low)).otherwise(F.lit(high)).cast("bigint")
        from_digit = F.when(first, digits["high"]).otherwise(digits["low"])
        to_digit = F.when(first, digits["low"]).otherwise(digits["high"])
        move = _round_value(seed, number, from_digit) % base
        moved = F.pmod(to_digit - move if inverse else to_digit + move, base)
        return bind(
            moved,
            lambda m: F.struct(
                F.when(first, m).otherwise(digits["low"]).alias("low"), F.when(first, digits["high"]).otherwise(m).alias("high")
            ),
        )

    numbers = range(ROUNDS, 0, -1) if inverse else range(1, ROUNDS + 1)
    start = F.struct((value % low).cast("bigint").alias("low"), F.call_function("div", value, F.lit(low).cast("bigint")).alias("high"))
    done = F.aggregate(F.array(*[F.lit(n) for n in numbers]), start, step)
    return bind(done, lambda d: d["low"] + d["high"] * low)


def permute(value: Column, size: int, seed: Column, inverse: bool = False) -> Column:
    """The value's image, or what it is the image of; null outside 0..size-1.

    ``seed`` must be a column, not a subquery, since it is used inside a lambda.
    """
    low, high = bases(size)
    number = value.cast("bigint")

    def walked(v: Column) -> Column:
        once = _turn(v, low, high, seed, inverse)
        end = F.aggregate(
            F.sequence(F.lit(2), F.lit(TURNS)), once, lambda x, _: F.when(x >= size, _turn(x, low, high, seed, inverse)).otherwise(x)
        )
        return bind(end, lambda x: fail_unless(x < size, x, F.lit("a permuted value never came back into its domain")))

    return F.when((number >= 0) & (number < size), bind(number, walked))
