"""Dates in any ``strptime`` format, as expressions.

A format becomes one regex, which must take the whole text at its first match,
and an expression of what its directives captured.  Times, zones and names of
days are read and checked as Python does, and only decide whether there is a
date.  Names are Italian and English, whatever the locale of the process.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, functions as F

from fiscalframe.functions.dialect import to_java
from fiscalframe.functions.text import ascii_digits, lookup

# --- fixed values: what Python's directives read, and the names they know ------
MONTHS = {
    "it": "gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre".split(),
    "en": "january february march april may june july august september october november december".split(),
}
WEEKDAYS = {
    "it": "lunedì martedì mercoledì giovedì venerdì sabato domenica".split(),
    "en": "monday tuesday wednesday thursday friday saturday sunday".split(),
}
DIRECTIVES = {
    "d": r"3[0-1]|[1-2]\d|0[1-9]|[1-9]| [1-9]",
    "f": r"[0-9]{1,6}",
    "G": r"\d\d\d\d",
    "H": r"2[0-3]|[0-1]\d|\d",
    "I": r"1[0-2]|0[1-9]|[1-9]",
    "j": r"36[0-6]|3[0-5]\d|[1-2]\d\d|0[1-9]\d|00[1-9]|[1-9]\d|0[1-9]|[1-9]",
    "m": r"1[0-2]|0[1-9]|[1-9]",
    "M": r"[0-5]\d|\d",
    "p": r"am|pm",
    "S": r"6[0-1]|[0-5]\d|\d",
    "u": r"[1-7]",
    "U": r"5[0-3]|[0-4]\d|\d",
    "V": r"5[0-3]|0[1-9]|[1-4]\d|\d",
    "w": r"[0-6]",
    "W": r"5[0-3]|[0-4]\d|\d",
    "y": r"\d\d",
    "Y": r"\d\d\d\d",
    "z": r"[+-]\d\d:?[0-5]\d(?::?[0-5]\d(?:\.\d{1,6})?)?|(?-i:Z)",
    "Z": r"utc|gmt",
}
# --- end of fixed values --------------------------------------------------------


def _numbered(names: dict[str, list[str]], first: int, length: int | None = None) -> dict[str, str]:
    return {name[:length]: str(number) for own in names.values() for number, name in enumerate(own, first)}


NAMES = {"B": _numbered(MONTHS, 1), "b": _numbered(MONTHS, 1, 3), "A": _numbered(WEEKDAYS, 0), "a": _numbered(WEEKDAYS, 0, 3)}
DIRECTIVES |= {d: "|".join(sorted(names, key=len, reverse=True)) for d, names in NAMES.items()}

# What a directive tells of the date; of several of a kind the last one counts.
KINDS = {"year": "Yy", "month": "mBb", "day": "d", "yearday": "j", "weekday": "Aawu", "week": "UW", "iso_year": "G", "iso_week": "V", "second": "S"}
_KIND_OF = {directive: kind for kind, directives in KINDS.items() for directive in directives}
_MARK = "\x1f"


@dataclass(frozen=True)
class Grammar:
    """A format's regex, and by kind the directive that counts and its group."""

    pattern: str
    groups: int
    fields: dict[str, tuple[str, int]]


def _reject(fmt: str, why: str) -> ValueError:
    return ValueError(f"Formato data non supportato: {fmt} ({why})")


@lru_cache(maxsize=256)
def grammar(fmt: str) -> Grammar:
    """Raises ValueError for formats that Python rejects for every text, and for those that stand for a locale's own layout (%c %x %X)."""
    body, seen, fields = "", set(), {}
    groups = 0
    for token in re.finditer(r"%(.)|(\s+)|(%)|([^%\s]+)", fmt, re.DOTALL):
        directive, space, stray, literal = token.groups()
        if space or literal or directive == "%":
            body += r"\s+" if space else re.escape(literal or "%")
            continue
        if stray or directive not in DIRECTIVES:
            raise _reject(fmt, f"%{directive or ''}")
        if directive in seen:
            raise _reject(fmt, f"%{directive} ripetuto")
        seen.add(directive)
        kind = _KIND_OF.get(directive)
        if kind:
            groups += 1
            fields[kind] = (directive, groups)
        body += f"({'' if kind else '?:'}{DIRECTIVES[directive]})"
    if "iso_year" in fields and ("yearday" in fields or not {"iso_week", "weekday"} <= fields.keys()):
        raise _reject(fmt, "%G richiede %V e un giorno della settimana, senza %j")
    if "iso_week" in fields and "iso_year" not in fields:
        raise _reject(fmt, "%V richiede %G")
    # Atomic: the first match must reach the end of the text, no other one is tried.
    return Grammar(to_java(rf"\A(?>{body})\Z"), groups, fields)


def _date(found: Column, fields: dict[str, tuple[str, int]]) -> Column:
    """The date that captured texts tell; null if there is no such day."""

    def number(kind: str, default: int | None = None) -> Column:
        if kind not in fields:
            return F.lit(default)
        directive, group = fields[kind]
        text = F.get(found, F.lit(group - 1))
        if directive in NAMES:
            return lookup(NAMES[directive], F.lower(text)).try_cast("int")
        value = ascii_digits(F.trim(text)).try_cast("int")
        if directive == "y":
            return value + F.when(value <= 68, 2000).otherwise(1900)
        if directive == "w":  # from Sunday
            return (value + 6) % 7
        return value - 1 if directive == "u" else value

    year, weekday = number("year", 1900), number("weekday")
    if "iso_year" in fields:
        week, fourth = number("iso_week"), F.make_date(number("iso_year"), F.lit(1), F.lit(4))
        date = F.date_add(fourth, 7 * (week - 1) + weekday - F.weekday(fourth))
        date = F.when((F.weekofyear(date) == week) & (number("iso_year") > 0), date)
    elif "yearday" in fields:
        date = F.date_add(F.make_date(year, F.lit(1), F.lit(1)), number("yearday") - 1)
    elif {"week", "weekday"} <= fields.keys():
        first, shift, week = F.make_date(year, F.lit(1), F.lit(1)), int(fields["week"][0] == "U"), number("week")
        # Days of a week are counted from Sunday for %U, from Monday for %W; week 0 ends before the first of these.
        begins, day = (F.weekday(first) + shift) % 7, (weekday + shift) % 7
        date = F.date_add(first, F.when(week == 0, day - begins).otherwise((7 - begins) % 7 + 7 * (week - 1) + day))
    else:
        parts = [F.lpad(c.cast("string"), n, "0") for c, n in ((year, 4), (number("month", 1), 2), (number("day", 1), 2))]
        date = F.concat_ws("-", *parts).try_cast("date")
    # Python knows the years 1 to 9999, and no leap seconds.
    date = F.when((year > 0) & F.year(date).between(1, 9999), date)
    return F.when(number("second") < 60, date) if "second" in fields else date


def read_strptime(text: Column, fmt: str) -> Column:
    """The date of a text in a format, or null."""
    known = grammar(fmt)
    captured = F.regexp_replace(text, known.pattern, _MARK.join(f"${g + 1}" for g in range(known.groups)))
    once = F.transform(F.array(F.split(captured, _MARK)), lambda found: _date(found, known.fields))
    return F.when(text.rlike(known.pattern), F.get(once, F.lit(0)))
