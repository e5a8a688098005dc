"""Rounding of doubles by their exact binary value, half to even.

Spark's round and format_string work on the shortest decimal text of a double, which differs at ties (65.35 is a bit
below the tie in binary). Scaling by a power of two is exact, so the tie can be tested on integers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_exact(x: Column, digits: int) -> Column:
    """x >= 0 rounded to 0, 1 or 2 digits. Below 1/128 the decimal text is used, from 2^50 on x is whole anyway."""
    factor = 10 ** digits
    shift = (F.lit(53) - F.floor(F.log2(x))).cast("int")
    n = (x * F.pow(F.lit(2.0), shift.cast("double"))).cast("bigint")

    def body(p: Column) -> Column:
        scaled = p["n"] * F.lit(factor).cast("bigint")
        k = F.call_function("shiftright", scaled, p["shift"])
        twice = (scaled - F.call_function("shiftleft", k, p["shift"])) * 2
        one = F.call_function("shiftleft", F.lit(1).cast("bigint"), p["shift"])
        up = (twice > one) | ((twice == one) & (k % 2 == 1))
        return (k + F.when(up, 1).otherwise(0)) / F.lit(float(factor))

    # A one-element array binds the parts once for the lambda.
    exact = F.transform(F.array(F.struct(n.alias("n"), shift.alias("shift"))), body)[0]
    plain = F.when(x >= 2.0 ** 50, x).otherwise(F.bround(x, digits))
    return F.when((x < 1 / 128) | (x >= 2.0 ** 50), plain).otherwise(exact)


def fixed(x: Column, digits: int) -> Column:
    """Text of x with a fixed number of digits."""
    return F.format_string(f"%.{digits}f", round_exact(x, digits))
