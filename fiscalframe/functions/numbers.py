"""Italian number parsing and the number formats used in reports."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fiscalframe.functions.text import ascii_digits, strip

_GROUPED = r"\A[0-9]{1,3}(\.[0-9]{3})*(,[0-9]{1,2})?\z"
_COMMA = r"\A[0-9]+(,[0-9]{1,2})?\z"
# What Python's float accepts, so that Spark's wider and narrower cast agree.
_DIGITS = r"[0-9](?:_?[0-9])*"
_PLAIN = rf"\A[+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?\z"
_INFINITE = r"(?i)\A[+-]?inf(?:inity)?\z"
_NOT_A_NUMBER = r"(?i)\A[+-]?nan\z"


def parse_italian_number(text: Column) -> Column:
    """Number written as 1.234,56 / 1 234,56 / 1234,56 / 1234.56, as double.

    A minus sign or enclosing parentheses make it negative, currency signs and
    spaces are skipped; null if the text is no number.
    """
    # Only blanks and no-break spaces are skipped inside, other space is not.
    bare = ascii_digits(strip(F.translate(text, "€ \u00a0", "")))
    enclosed = bare.startswith("(") & bare.endswith(")") & (F.length(bare) > 1)
    inner = F.when(enclosed, strip(bare.substr(F.lit(2), F.length(bare) - 2))).otherwise(bare)
    minus = inner.startswith("-") | inner.startswith("\u2212")
    signed = minus | inner.startswith("+")
    magnitude = F.when(signed, strip(inner.substr(F.lit(2), F.length(inner)))).otherwise(inner)
    value = (
        F.when(magnitude.rlike(_GROUPED), F.translate(magnitude, ",.", ".").try_cast("double"))
        .when(magnitude.rlike(_COMMA), F.translate(magnitude, ",", ".").try_cast("double"))
        .when(magnitude.rlike(_PLAIN), F.translate(magnitude, "_", "").try_cast("double"))
        .when(magnitude.rlike(_INFINITE), F.when(magnitude.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))
        .when(magnitude.rlike(_NOT_A_NUMBER), F.lit(float("nan")))
    )
    return value * F.when(enclosed | minus, F.lit(-1.0)).otherwise(F.lit(1.0))


def exact_cents(value: Column) -> Column:
    """The value as DECIMAL(18,2), or null if it is not a whole number of cents.

    Decimal sums do not depend on the order of the rows.
    """
    # A cast of a value out of range, infinite or NaN gives null here.
    cents = value.try_cast("decimal(18,2)")
    return F.when(cents.cast("double") == value, cents)


def sum_of_totals(total: Column, total_dec: Column) -> Column:
    """Aggregate: exact sum of the whole-cent totals plus the odd ones; 0 for no rows."""
    exact = F.coalesce(F.sum(total_dec).cast("double"), F.lit(0.0))
    odd = F.coalesce(F.sum(F.when(total_dec.isNull(), total)), F.lit(0.0))
    return exact + odd


def two_decimals(value: Column) -> Column:
    """``1234.50``: half-even on the binary value, as printf does."""
    return _named_specials(value, F.call_function("format_number", value, F.lit("0.00")))


def grouped_two_decimals(value: Column) -> Column:
    """``1,234.50``."""
    return _named_specials(value, F.format_number(value, 2))


def comma_decimals(value: Column) -> Column:
    """``1234,50``, the form Italian spreadsheets read."""
    return F.translate(two_decimals(value), ".", ",")


def shortest(value: Column) -> Column:
    """Shortest text that reads back as the same double: ``1250.0``, ``1e+16``."""
    size = F.abs(value)
    # Spark switches to exponents at 1e7 and below 1e-3; the text should at 1e16 and 1e-4.
    plain = F.regexp_replace(value.try_cast("decimal(38,20)").cast("string"), r"(\.[0-9]+?)0+\z", "$1")
    scientific = value.cast("string")
    exponent = F.regexp_extract(scientific, r"E(-?)([0-9]+)", 2)
    sign = F.when(scientific.contains("E-"), F.lit("e-")).otherwise(F.lit("e+"))
    mantissa = F.regexp_replace(F.substring_index(scientific, "E", 1), r"\.0\z", "")
    exponential = F.concat(mantissa, sign, F.lpad(exponent, F.greatest(F.length(exponent), F.lit(2)), F.lit("0")))
    text = (
        F.when((size == 0) | ((size >= 1e-3) & (size < 1e7)), scientific)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(exponential)
    )
    return _named_specials(value, text)


def _named_specials(value: Column, text: Column) -> Column:
    return (
        F.when(F.isnan(value), F.lit("nan"))
        .when(value == float("inf"), F.lit("inf"))
        .when(value == float("-inf"), F.lit("-inf"))
        .otherwise(text)
    )
