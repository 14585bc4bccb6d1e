"""Sums of doubles that do not depend on the order of rows.

A value is split into whole multiples of fixed powers of two, 30 binary digits each.
The splits are exact, and so are sums of whole numbers, whatever the order, the
partitions or the steps in which they are merged. Only the final total is rounded.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 30
#: Units of the parts, greatest first. Values below 2^93 are split without loss down to
#: 2^-90; what a value has below that is left out, the same for each value wherever it
#: stands. A group may hold 2^33 values below 2^60; a sum beyond that fails, it does not wrap.
UNITS = [2.0 ** (BITS * k) for k in range(1, -4, -1)]


def part_names(name: str) -> list[str]:
    return [f"{name}_part{i}" for i in range(len(UNITS))]


def parts(name: str) -> list[Column]:
    """The column ``name`` as whole multiples of ``UNITS``."""
    size, sign = F.abs(name), F.signum(name).cast("long")
    rests = [size, *[size % F.lit(unit) for unit in UNITS[:-1]]]
    return [
        (F.floor(rest / F.lit(unit)) * sign).alias(part)
        for rest, unit, part in zip(rests, UNITS, part_names(name))
    ]


def part_sums(*names: str) -> list[Column]:
    """Sums of the parts, under their names, so that sums can be summed again."""
    return [F.sum(part).alias(part) for name in names for part in part_names(name)]


def _digits(sums: list[Column]) -> list[Column]:
    """The sums with what exceeds a part carried to the next greater one, greatest first."""
    digits, carry = [], F.lit(0).cast("long")
    for part in reversed(sums[1:]):
        whole = part + carry
        digits.append(whole.bitwiseAND(F.lit((1 << BITS) - 1)))
        carry = F.shiftright(whole, BITS)
    return [sums[0] + carry, *reversed(digits)]


def _put_together(digits: list[Column]) -> Column:
    scaled = [d.cast("double") * F.lit(unit) for d, unit in zip(digits, UNITS)]
    return reduce(lambda total, more: total + more, reversed(scaled))


def total(name: str) -> Column:
    """The sum of the values whose ``part_sums`` the row holds, as a double."""
    sums = [F.col(part) for part in part_names(name)]
    digits = _digits(sums)
    # Digits are not negative, so a negative sum is taken the other way round.
    return F.when(digits[0] < 0, -_put_together(_digits([-s for s in sums]))).otherwise(_put_together(digits))
