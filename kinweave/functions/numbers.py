"""Rounding of the binary value, ties to even, as columns and as the same formula in SQL."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_SPLIT = 134217729.0  # 2**27 + 1: halves the digits of a double


def scaled(x: Column, digits: int) -> Column:
    """``x * 10**digits`` as a whole number, rounded from the exact product.

    The product of doubles is itself rounded and may fall on a tie that ``x`` is not on; the
    part that it lost, which splitting ``x`` in halves gives exactly, then decides.
    """
    scale = F.lit(float(10**digits))
    x = x.cast("double")
    big = x * _SPLIT
    head = big - (big - x)
    product = x * scale
    lost = (head * scale - product) + (x - head) * scale
    down = F.floor(product)
    over = product - down - 0.5
    up = (over > 0) | ((over == 0) & ((lost > 0) | ((lost == 0) & (down % 2 != 0))))
    return down + up.cast("long")


def half_even(x: Column, digits: int) -> Column:
    return scaled(x, digits) / F.lit(float(10**digits))


def fixed(x: Column, digits: int) -> Column:
    """Text with so many digits after the point."""
    shown = F.lpad(scaled(F.abs(x), digits).cast("string"), digits + 1, "0")
    return F.concat(F.when(x < 0, "-").otherwise(""), F.regexp_replace(shown, f"([0-9]{{{digits}}})$", ".$1"))


def half_even_sql(x: str, digits: int) -> str:
    """:func:`half_even` for DuckDB."""
    scale = f"{float(10**digits)}::DOUBLE"
    return (
        f"list_transform([({x})::DOUBLE], lambda x: list_transform([{{'h': x * {_SPLIT}::DOUBLE - (x * {_SPLIT}::DOUBLE - x), 'p': x * {scale}}}], lambda s: "
        f"list_transform([{{'l': (s.h * {scale} - s.p) + (x - s.h) * {scale}, 'd': floor(s.p), 'o': s.p - floor(s.p) - 0.5::DOUBLE}}], lambda w: "
        f"(w.d + CASE WHEN w.o > 0 OR (w.o = 0 AND (w.l > 0 OR (w.l = 0 AND w.d % 2 <> 0))) THEN 1 ELSE 0 END) / {scale})[1])[1])[1]"
    )


def fixed_sql(x: str, digits: int) -> str:
    """:func:`fixed` for DuckDB, of numbers that are not negative."""
    return f"printf('%.{digits}f', {half_even_sql(x, digits)})"
