"""Numeric casts, exact decimal pricing and number rendering."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterbook.schema import DECIMAL_SUFFIX

# Exact type of money and quantity sums.
MONEY = T.DecimalType(38, 12)
# Narrower operand type for division, so that the quotient keeps 12 fraction digits.
_DIVISION_OPERAND = T.DecimalType(26, 12)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strict_double(col) -> Column:
    """``CAST(x AS DOUBLE)``: under ANSI mode a non-number fails the query."""
    return _col(col).cast(T.DoubleType())


def strict_decimal(col) -> Column:
    """``CAST(x AS DECIMAL(38,12))``: a non-number fails the query."""
    return _col(col).cast(MONEY)


def lenient_decimal(col) -> Column:
    """``TRY_CAST(x AS DECIMAL(38,12))``: a non-number becomes null."""
    return _col(col).try_cast(MONEY)


def lenient_double(col) -> Column:
    return _col(col).try_cast(T.DoubleType())


def is_strict(on_bad_number: str) -> bool:
    """``"fail"``: a non-number fails the report (strict cast); ``"null"``: it counts as missing."""
    if on_bad_number not in ("fail", "null"):
        raise ValueError("on_bad_number is 'fail' or 'null'")
    return on_bad_number == "fail"


def amount(df, name: str, strict: bool) -> Column:
    """DECIMAL(38,12) value of the text amount column ``name`` of ``df``.

    When the table carries the copy parsed at ingest (``<name>_dec``, lenient), that copy is
    used and no text is parsed; the strict form then fails the query on text the copy could
    not read, as a strict cast of the text would."""
    typed = name + DECIMAL_SUFFIX
    if typed in df.columns:
        if not strict:
            return F.col(typed)
        unreadable = F.col(name).isNotNull() & F.col(typed).isNull()
        message = F.concat(F.lit("[CAST_INVALID_INPUT] The value '"), F.col(name),
                           F.lit(f"' of column {name} cannot be cast to DECIMAL(38,12)."))
        return F.when(unreadable, F.raise_error(message)).otherwise(F.col(typed))
    return strict_decimal(name) if strict else lenient_decimal(name)


def money_sum(col, strict: bool = True) -> Column:
    """Exact sum of a text amount column as DECIMAL(38,12), 0 when there is nothing to sum.

    A decimal sum does not depend on partitioning or task order, unlike a double sum,
    so the same data gives the same total on any cluster layout. ``col`` may also be an
    already-decimal column (see :func:`amount`).
    """
    if isinstance(col, Column):
        value = col
    else:
        value = strict_decimal(col) if strict else lenient_decimal(col)
    return F.coalesce(F.sum(value), F.lit(Decimal(0)).cast(MONEY))


def to_double(col) -> Column:
    return _col(col).cast(T.DoubleType())


def _digits(value: Decimal) -> tuple[int, int]:
    """(precision, scale) of an exact decimal value, without trailing zeros."""
    sign, digits, exp = Decimal(value).normalize().as_tuple()
    scale = max(0, -exp)
    return max(len(digits) + max(0, exp), scale, 1), scale


def _decimal_lit(value: Decimal, precision: int | None = None, scale: int | None = None) -> Column:
    natural_p, natural_s = _digits(value)
    scale = natural_s if scale is None else scale
    precision = max(natural_p - natural_s + scale, 1) if precision is None else precision
    return F.lit(format(Decimal(value).normalize(), "f")).cast(T.DecimalType(precision, scale))


def weighted_price(price_sum, quantity_sum) -> Column:
    """Σprice ÷ Σquantity as an exact DECIMAL(38,12) quotient (half-up), 0 when Σquantity = 0.

    Where either sum reaches 10^14 the quotient keeps six places, so a very large sum costs
    places and not the report."""
    p, q = _col(price_sum), _col(quantity_sum)
    exact = (p.try_cast(_DIVISION_OPERAND) / q.try_cast(_DIVISION_OPERAND)).cast(MONEY)
    wide = F.try_divide(p.cast(MONEY), q.cast(MONEY)).try_cast(MONEY)
    return F.when(q == 0, F.lit(Decimal(0)).cast(MONEY)).otherwise(F.coalesce(exact, wide))


def weighted_price_double(price_sum, quantity_sum) -> Column:
    """Σprice ÷ Σquantity in double arithmetic (0 when Σquantity = 0, null when it is null)."""
    q = _col(quantity_sum)
    return F.when(q == 0, F.lit(0.0)).otherwise(to_double(price_sum) / to_double(q))


def priced_decimal(value, forex: Decimal, margin: Decimal, vat: Decimal) -> Column:
    """``value * forex / margin * vat`` in exact decimals, rounded half-up once to 12 places.

    The product ``value * (forex * vat)`` is exact. The divisor's scale is chosen so that
    Spark's decimal division yields DECIMAL(38,12) directly (one rounding, no second cast).
    Amounts from 10^14 on are computed with the places that DECIMAL(38) leaves (six or more).
    """
    rate = Decimal(forex) * Decimal(vat)
    rate_p, rate_s = _digits(rate)
    margin_p, margin_s = _digits(margin)
    numerator = _col(value).try_cast(_DIVISION_OPERAND) * _decimal_lit(rate)
    wide = F.try_divide(F.try_multiply(_col(value).cast(MONEY), _decimal_lit(rate)), _decimal_lit(margin)).try_cast(MONEY)
    # quotient integer digits = (27 + rate_p) - (12 + rate_s) + divisor scale; 26 of them leave 12 fraction digits
    divisor_scale = 11 - rate_p + rate_s
    if rate_p > 11 or divisor_scale < margin_s:
        return F.coalesce((numerator / _decimal_lit(margin)).cast(MONEY), wide)
    divisor_int = margin_p - margin_s
    exact = numerator / _decimal_lit(margin, min(38, divisor_scale + max(divisor_int, 1) + 8), divisor_scale)
    return F.coalesce(exact, wide)


def decimal_text(col, min_fraction_digits: int = 0) -> Column:
    """Plain decimal text without trailing zeros (``100``, ``1.5``, ``-0.1``), padded to a
    minimum number of fraction digits when asked (``1.5`` → ``1.50``).

    The value is rendered at scale 12 (always with a dot), so trimming trailing ``0`` and
    then ``.`` characters only touches the fraction."""
    text = _col(col).cast(MONEY).cast(T.StringType())
    trimmed = F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))
    if min_fraction_digits <= 0:
        return trimmed
    has_dot = trimmed.contains(".")
    integer = F.substring_index(trimmed, ".", 1)
    fraction = F.when(has_dot, F.substring_index(trimmed, ".", -1)).otherwise(F.lit(""))
    padded = F.rpad(fraction, F.greatest(F.length(fraction), F.lit(min_fraction_digits)), "0")
    return F.concat(integer, F.lit("."), padded)


def money_text(col) -> Column:
    """Display amount: thousands separators and 2 decimals (half-even on the binary value,
    like ``'{:,.2f}'``); missing, unreadable or NaN shows ``0.00``."""
    x = _col(col).try_cast(T.DoubleType())
    return F.format_number(F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0)), 2)


def export_number(raw, number) -> Column:
    """Export cell: the raw decimal text if usable, else the number, else ``"0"``."""
    return F.coalesce(
        F.nullif(F.trim(_col(raw)), F.lit("")),
        decimal_text(_col(number).cast(MONEY)),
        F.lit("0"),
    )
