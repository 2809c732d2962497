"""Rounding as Python and C do it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_round(c: Column, digits: int) -> Column:
    """``c`` (double) rounded to ``digits`` decimals by its exact binary value, ties to even.

    The product with the power of ten is taken with its rounding error (by splitting the factor), so that a value just
    under a tie is not taken for one. Good for magnitudes up to about 1e12.
    """
    x, ten = F.abs(c), float(10**digits)
    product = x * ten
    big = x * 134217729.0
    high = big - (big - x)
    error = (high * ten - product) + (x - high) * ten
    base = F.floor(product).cast("double")
    part = product - base
    up = (part > 0.5) | ((part == 0.5) & ((error > 0) | ((error == 0) & (base % 2 == 1))))
    return F.signum(c) * (base + up.cast("double")) / ten


def rounded(column: str, digits: int) -> str:
    """``exact_round`` of a column given by name, as SQL text: one expression to parse instead of some forty calls to the JVM."""
    ten, x = float(10**digits), f"abs(`{column}`)"
    product, base = f"({x} * {ten}D)", f"CAST(floor({x} * {ten}D) AS double)"
    high = f"({x} * 134217729D - ({x} * 134217729D - {x}))"
    error = f"(({high} * {ten}D - {product}) + ({x} - {high}) * {ten}D)"
    part = f"({product} - {base})"
    up = f"({part} > 0.5D OR ({part} = 0.5D AND ({error} > 0D OR ({error} = 0D AND {base} % 2 = 1))))"
    return f"signum(`{column}`) * ({base} + CAST({up} AS double)) / {ten}D"
