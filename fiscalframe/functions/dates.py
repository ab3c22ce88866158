"""Italian date parsing."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, functions as F

from fiscalframe.functions.dialect import to_java
from fiscalframe.functions.strptime import grammar, read_strptime
from fiscalframe.functions.text import ascii_digits, lookup, strip

# Month names by number, and what each date directive reads.
ITALIAN_MONTHS = {
    "gennaio": "01",
    "febbraio": "02",
    "marzo": "03",
    "aprile": "04",
    "maggio": "05",
    "giugno": "06",
    "luglio": "07",
    "agosto": "08",
    "settembre": "09",
    "ottobre": "10",
    "novembre": "11",
    "dicembre": "12",
}
ENGLISH_MONTHS = (
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
)

_FULL_NAMES = dict(ITALIAN_MONTHS) | {name: f"{i:02d}" for i, name in enumerate(ENGLISH_MONTHS, 1)}
_SHORT_NAMES = {name[:3]: number for name, number in _FULL_NAMES.items()}
_DIRECTIVES = {
    "d": r"(3[0-1]|[1-2][0-9]|0[1-9]|[1-9]| [1-9])",
    "m": r"(1[0-2]|0[1-9]|[1-9])",
    "Y": r"((?!0000)[0-9]{4})",
    "y": r"([0-9]{2})",
    "B": "(" + "|".join(sorted(_FULL_NAMES, key=len, reverse=True)) + ")",
    "b": "(" + "|".join(sorted(_SHORT_NAMES, key=len, reverse=True)) + ")",
}
# Two-digit years below 69 belong to this century, the others to the last one.
_CENTURIES = {"19": r"(69|[7-9][0-9])", "20": r"(6[0-8]|[0-5][0-9])"}
_LONG_FORM = to_java(r"\A(\d{1,2})\s*(" + "|".join(ITALIAN_MONTHS) + r")\s*(\d{4})")


def _read_format(fmt: str, century: str = "") -> tuple[str, dict[str, int]]:
    """Pattern of a plain format, and the group number of each directive."""
    groups: dict[str, int] = {}
    body = plain = ""
    for token in re.finditer(r"%(.)|(\s+)|(%)|([^%\s]+)", fmt, re.DOTALL):
        directive, space, _, literal = token.groups()
        part = r"\s+" if space else re.escape(literal or "%")
        if directive in _DIRECTIVES:
            groups[directive] = len(groups) + 1
            part = _CENTURIES[century] if directive == "y" and century else _DIRECTIVES[directive]
        body += part
        plain += "(?:" + part[1:] if directive in groups else part
    # The first match must reach the end of the text by itself, as the atomic
    # look-ahead asks; any other text takes the last branch, with empty groups.
    return rf"\A(?:(?=(?>{plain})\Z){body}\Z|.*)", groups


def _is_plain(fmt: str) -> bool:
    """Whether a format has year, month and day only, each at most once."""
    directives = re.findall(r"%(.?)", fmt, re.DOTALL)
    kinds = ["year" if d in "Yy" else "month" if d in "mBb" else d for d in directives if d != "%"]
    return set(directives) <= {*_DIRECTIVES, "%"} and len(kinds) == len(set(kinds))


def check_format(fmt: str) -> None:
    """Reject a format that Python's strptime takes for no text, or that depends on the locale's layout."""
    if not _is_plain(fmt):
        grammar(fmt)


def _marks(fmt: str) -> list[str]:
    """ASCII marks that stand in every text of a plain format; letters may stand in either case."""
    literal = re.sub(r"%(.)", lambda m: "%" if m[1] == "%" else "", fmt, flags=re.DOTALL)
    return sorted({c for c in literal if c.isascii() and not c.isalpha() and not c.isspace() and c.isprintable()})


def _by_format(text: Column, fmt: str, century: str = "") -> Column:
    """The date, or null if the text is not a real date in this format."""
    if not _is_plain(fmt):
        return read_strptime(text, fmt)
    pattern, groups = _read_format(fmt, century)
    if "y" in groups and not century:
        return F.coalesce(*[_by_format(text, fmt, c) for c in _CENTURIES])
    pattern = to_java(pattern)
    year = f"${groups['Y']}" if "Y" in groups else f"{century}${groups['y']}" if "y" in groups else "1900"
    month = f"${groups['m']}" if "m" in groups else "01"
    day = f"${groups['d']}" if "d" in groups else "01"
    for directive, names in (("B", _FULL_NAMES), ("b", _SHORT_NAMES)):
        if directive in groups:
            name = F.lower(F.regexp_extract(text, pattern, groups[directive]))
            iso = F.regexp_replace(text, pattern, f"{year}-@-{day}")
            return F.replace(F.translate(iso, " ", ""), F.lit("@"), lookup(names, name)).try_cast("date")
    return F.translate(F.regexp_replace(text, pattern, f"{year}-{month}-{day}"), " ", "").try_cast("date")


def parse_italian_date(text: Column, formats: Iterable[str]) -> Column:
    """Date as ``YYYY-MM-DD`` text, or null.

    The long form (``15 marzo 2024``) is read at the start of the text without
    checking the day; then the formats are tried in order.
    """
    bare = strip(text)
    day = F.lpad(ascii_digits(F.regexp_extract(bare, _LONG_FORM, 1)), 2, "0")
    month = lookup(ITALIAN_MONTHS, F.lower(F.regexp_extract(bare, _LONG_FORM, 2)))
    year = F.regexp_extract(bare, _LONG_FORM, 3)
    long_form = F.when(bare.rlike(_LONG_FORM), F.concat(year, F.lit("-"), month, F.lit("-"), day))
    tries = []
    for fmt in formats:
        # A byte search tells most formats out; their regexes cost far more.
        marks = [F.contains(text, F.lit(mark)) for mark in _marks(fmt)] if _is_plain(fmt) else []
        tries.append(F.when(reduce(Column.__and__, marks), _by_format(bare, fmt)) if marks else _by_format(bare, fmt))
    parsed = F.coalesce(*tries)
    # Years below 1000 are printed without leading zeros.
    return F.coalesce(long_form, F.ltrim(parsed.cast("string"), F.lit("0")))
