"""Text helpers with Python's notion of white space and digits."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, functions as F

from fiscalframe.functions.dialect import DIGIT, SPACE


def strip(text: Column) -> Column:
    """Without white space at either end (Spark's trim removes spaces only)."""
    return F.regexp_replace(text, rf"\A[{SPACE}]+|[{SPACE}]+\z", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(rf"[^{SPACE}]")


@cache
def _digit_alphabet() -> tuple[str, str]:
    """Every decimal digit outside ASCII, and the ASCII digit of equal value."""
    digits = [c for c in map(chr, range(0x80, 0x110000)) if unicodedata.category(c) == "Nd"]
    return "".join(digits), "".join(str(unicodedata.decimal(c)) for c in digits)


def ascii_digits(text: Column) -> Column:
    """Decimal digits of any script as 0-9."""
    foreign, plain = _digit_alphabet()
    return F.when(text.rlike(rf"[{DIGIT}&&[^0-9]]"), F.translate(text, foreign, plain)).otherwise(text)


# From the start: marks, then dashes unless they are the sign of a number (of
# several dashes before a number the last one stays), then space.
_LEADING = rf"\A[{SPACE}.,;:]*+(?:-+(?![{SPACE}]*[{DIGIT}(]))?[{SPACE}]*"
# To the end: space, dashes, then marks.
_TRAILING = rf"[{SPACE}]*-*[{SPACE}.,;:]*\z"


def clean_capture(text: Column) -> Column:
    """A rule's capture without the punctuation around it.

    A leading minus stays if it belongs to a number.
    """
    return F.regexp_replace(text, f"{_LEADING}|{_TRAILING}", "")


def lookup(table: dict[str, str], key: Column) -> Column:
    """Value of the key in a small fixed table, or null."""
    entries = ", ".join(f"'{name}', '{value}'" for name, value in table.items())
    return F.try_element_at(F.expr(f"map({entries})"), key)


def file_name(path: Column) -> Column:
    """Last component of a path."""
    return F.substring_index(path, "/", -1)


def path_parts(path: Column) -> Column:
    """Sort key that orders paths component by component."""
    return F.split(path, "/")
