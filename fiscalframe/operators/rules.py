"""The extraction rules: built-in values, and an immutable set to extend them."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fiscalframe.functions.dates import check_format
from fiscalframe.functions.dialect import SPACE, to_java
from fiscalframe.functions.literals import required_words

# --- fixed values: fields, patterns, formats and labels ----------------------
# Results depend on their exact text and order: within a field the first
# pattern that yields a value wins, and the first fitting date format wins.

FIELDS = ("invoice_number", "date", "total", "supplier_name", "vat_number")

AMOUNT = r"\(?\s*[-−]?\s*\d{1,3}(?:[. ]\d{3})*(?:,\d{1,2})?\s*\)?"

PATTERNS: dict[str, tuple[str, ...]] = {
    "invoice_number": (
        r"(?:fattura|ricevuta|nota\s*(?:di\s*)?(?:credito|debito)|documento|ddt)\s*[nN]?[.:]?\s*(\S[\w/\-.]{0,40}?)(?:\s|$|\\n)",
        r"(?:numero|n[.:])\s*(?:fattura|documento|ricevuta)\s*[.:]?\s*(\S[\w/\-.]{0,40}?)(?:\s|$|\\n)",
        r"[nN][.:]?\s*FATTURA\s*([\w/\-.]{1,40})",
        r"protocollo[.:]?\s*(\S[\w/\-.]{0,40}?)(?:\s|$|\\n)",
    ),
    "date": (
        r"(?:data|del)\s*(?:fattura|documento|ricevuta|emissione)\s*[.:]?\s*(\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4})",
        r"data[.:]?\s*(\d{4}[/\-.]\d{1,2}[/\-.]\d{1,2})",
        r"(?<!\d)(\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4})(?!\d)",
        r"(\d{1,2})\s*(gennaio|febbraio|marzo|aprile|maggio|giugno|luglio|agosto|settembre|ottobre|novembre|dicembre)\s*(\d{4})",
    ),
    "total": (
        rf"(?:totale|importo)\s*(?:fattura|documento)?\s*[.:]?\s*(?:€|€|eur|euro|usd)?\s*({AMOUNT})",
        rf"(?:totale|importo\s*totale|totale\s*documento|totale\s*da\s*pagare|totale\s*fattura)\s*[.:]?\s*[€€]?\s*({AMOUNT})",
        rf"importo[.:]?\s*[€€]?\s*({AMOUNT})",
        rf"(?:€|€|eur|euro)\s*({AMOUNT})",
        r"(?:(?:totale|importo|tot\.?)\s*[.:]?\s*)(\(?\s*[-−]?\s*\d{1,3}(?:[. ]\d{3})*,\d{2}\s*\)?)",
        r"(?:totale|importo)\s*(?:€|€|eur)?\s*([-−]?\d+(?:,\d{1,2}|\.\d{2}))",
    ),
    "supplier_name": (
        r"(?:fornitore|mittente|emittente|dal|prestatore)\s*[.:]?\s*(.+?)(?:\\n|\||via\s|p[.]?\s*[.]?\s*iva|cod\s*[.]?\s*fisc|indirizzo|telefono|email|$)",
        r"spett[.]?\s*le\s*(.+?)(?:\\n|\||via\s|c.a\.|p[.]?\s*iva)",
        r"(?:ragione\s*sociale|denominazione|ditta|societ[àa])\s*[.:]?\s*(.+?)(?:\\n|\||via|p[.]?\s*iva|cod\s*fisc|tel)",
        r"^(.+?(?:S\.r\.l\.|S\.p\.A\.|S\.n\.c\.|S\.a\.s\.|Societ[àa]|Ditta))",
    ),
    "vat_number": (
        r"(?:p[.]?\s*[.]?\s*iva|partita\s*iva|p\s*iva)\s*[.:]?\s*([\d]{11})",
        r"([\d]{11})(?:\s*$|\s*\n|\s*\||\s*-)",
        r"(?:cod\s*[.]?\s*fisc|codice\s*fiscale)\s*[.:]?\s*([\d]{11})",
    ),
}

DATE_FORMATS = (
    "%d/%m/%Y",
    "%d/%m/%y",
    "%d-%m-%Y",
    "%d-%m-%y",
    "%d.%m.%Y",
    "%d.%m.%y",
    "%Y/%m/%d",
    "%Y-%m-%d",
    "%Y.%m.%d",
    "%d %B %Y",
    "%d %b %Y",
)

FIELD_LABELS = {
    "invoice_number": "numero fattura",
    "date": "data",
    "total": "totale",
    "supplier_name": "fornitore",
    "vat_number": "partita IVA",
}
# --- end of fixed values ------------------------------------------------------

# How the built-in rules are run.  The published texts above stay the rules'
# identity; these find the same first match, but possessive runs of spaces are not tried in every
# split when nothing follows them, so wide gaps cost linear time.  Optional marks
# and words are possessive only where the capture cannot begin with them.
#
# Two supplier rules end at a stop word that need not be there.  If none follows the
# first anchor, none follows a later one, so the first anchor alone decides; trying each
# would read the rest of the text once for every anchor.
def _first_only(anchor: str) -> str:
    """Up to the first anchor of a text, tried no further."""
    return rf"\A(?>.*?(?:{anchor}))"


_RUN_AMOUNT = r"\(?+\s*+(?:[-−]\s*+)?+\d{1,3}(?:[. ]\d{3})*(?:,\d{1,2})?\s*+\)?"
_RUN_CODE = r"(\S[\w/\-.]{0,40}?)(?:\s|$|\\n)"
_RUN_VAT_WORD = r"p[.]?+\s*+(?:[.]\s*+)?+iva"
_RUN_TAX_WORD = r"cod\s*+(?:[.]\s*+)?+fisc"
RUN_FORMS: dict[str, tuple[str, ...]] = {
    "invoice_number": (
        rf"(?:fattura|ricevuta|nota\s*+(?:di\s*+)?+(?:credito|debito)|documento|ddt)\s*+[nN]?[.:]?\s*+{_RUN_CODE}",
        rf"(?:numero|n[.:])\s*+(?:fattura|documento|ricevuta)\s*+[.:]?\s*+{_RUN_CODE}",
        r"[nN][.:]?\s*+FATTURA\s*+([\w/\-.]{1,40})",
        rf"protocollo[.:]?\s*+{_RUN_CODE}",
    ),
    "date": (
        r"(?:data|del)\s*+(?:fattura|documento|ricevuta|emissione)\s*+(?:[.:]\s*+)?+(\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4})",
        r"data[.:]?+\s*+(\d{4}[/\-.]\d{1,2}[/\-.]\d{1,2})",
        PATTERNS["date"][2],
        PATTERNS["date"][3].replace(r"\s*", r"\s*+"),
    ),
    "total": (
        rf"(?:totale|importo)\s*+(?:(?:fattura|documento)\s*+)?+(?:[.:]\s*+)?+(?:(?:€|euro|eur|usd)\s*+)?+({_RUN_AMOUNT})",
        rf"(?:importo\s*+totale|totale(?:\s*+(?:documento|da\s*+pagare|fattura))?+)\s*+(?:[.:]\s*+)?+(?:€\s*+)?+({_RUN_AMOUNT})",
        rf"importo[.:]?+\s*+(?:€\s*+)?+({_RUN_AMOUNT})",
        rf"(?:€|euro|eur)\s*+({_RUN_AMOUNT})",
        r"(?:totale|importo|tot\.?+)\s*+(?:[.:]\s*+)?+(\(?+\s*+(?:[-−]\s*+)?+\d{1,3}(?:[. ]\d{3})*,\d{2}\s*+\)?)",
        r"(?:totale|importo)\s*+(?:(?:€|eur)\s*+)?+([-−]?+\d++(?:,\d{1,2}|\.\d{2}))",
    ),
    "supplier_name": (
        rf"(?:fornitore|mittente|emittente|dal|prestatore)\s*+[.:]?+\s*+(.+?)(?:\\n|\||via\s|{_RUN_VAT_WORD}|{_RUN_TAX_WORD}|indirizzo|telefono|email|$)",
        _first_only(r"spett[.]?+\s*+le") + r"\s*+(.+?)(?:\\n|\||via\s|c.a\.|p[.]?+\s*+iva)",
        _first_only(r"ragione\s*+sociale|denominazione|ditta|societ[àa]") + r"\s*+[.:]?+\s*+(.+?)(?:\\n|\||via|p[.]?+\s*+iva|cod\s*+fisc|tel)",
        PATTERNS["supplier_name"][3],
    ),
    "vat_number": (
        rf"(?:{_RUN_VAT_WORD}|partita\s*+iva)\s*+(?:[.:]\s*+)?+([\d]{{11}})",
        PATTERNS["vat_number"][1],
        rf"(?:{_RUN_TAX_WORD}|codice\s*+fiscale)\s*+(?:[.:]\s*+)?+([\d]{{11}})",
    ),
}
_RUN_FORM_OF = {pattern: form for name in FIELDS for pattern, form in zip(PATTERNS[name], RUN_FORMS[name], strict=True)}


# The run forms tell one blank from several, but no two runs of several apart, so with long ones cut
# short they match at the same places.  A number, date or VAT code captured has no space in it; an amount only
# next to a bracket or sign.  What the other rules capture can hold any gap.
WORD_RULES = frozenset(p for name in ("invoice_number", "date", "vat_number") for p in PATTERNS[name])
AMOUNT_RULES = frozenset(PATTERNS["total"])
_GAP = " " * 16


def narrowed(text: str) -> Column:
    """The column with its long runs of blanks cut short, to no less than two."""
    shorter = F.col(text)
    for _ in range(2):
        shorter = F.replace(shorter, F.lit(_GAP), F.lit("  "))
    return F.when(F.contains(F.col(text), F.lit(_GAP)), shorter).otherwise(F.col(text))


def gaps_in_amounts(text: str) -> Column:
    """True if an amount in the column may have space inside."""
    return F.col(text).rlike(rf"[(\-−][{SPACE}]|[{SPACE}]\)")


def run_form(pattern: str) -> str:
    """The Java regex that finds a rule's first match."""
    return to_java(_RUN_FORM_OF.get(pattern, pattern))


# Corrected spellings of two surprising rules, for those who ask: whole amounts
# without thousands separators, and long dates with their month.
LONG_AMOUNTS = r"(?:totale|importo)\s*+(?:(?:fattura|documento|da\s*+pagare)\s*+)?+(?:[.:]\s*+)?+(?:(?:€|euro|eur|usd)\s*+)?+(\(?+\s*+(?:[-−]\s*+)?+\d{4,}+(?:[.,]\d{1,2})?\s*+\)?)"
LONG_DATES = r"(?<!\d)(\d{1,2}\s*+(?:gennaio|febbraio|marzo|aprile|maggio|giugno|luglio|agosto|settembre|ottobre|novembre|dicembre)\s*+\d{4})"

# One of these words stands in every text that the pattern at the same place in
# PATTERNS can match, so a text without any of them need not be searched.
# None: the pattern starts at a digit and fails fast by itself.
ANCHOR_WORDS: dict[str, tuple[tuple[str, ...] | None, ...]] = {
    "invoice_number": (
        ("fattura", "ricevuta", "credito", "debito", "documento", "ddt"),
        ("fattura", "documento", "ricevuta"),
        ("fattura",),
        ("protocollo",),
    ),
    "date": (
        ("fattura", "documento", "ricevuta", "emissione"),
        ("data",),
        None,
        None,
    ),
    "total": (
        ("totale", "importo"),
        ("totale", "importo"),
        ("importo",),
        ("€", "eur"),
        ("tot", "importo"),
        ("totale", "importo"),
    ),
    "supplier_name": (
        ("fornitore", "mittente", "emittente", "dal", "prestatore"),
        ("spett",),
        ("ragione", "denominazione", "ditta", "societ"),
        ("s.r.l.", "s.p.a.", "s.n.c.", "s.a.s.", "societ", "ditta"),
    ),
    "vat_number": (("iva",), None, ("fisc",)),
}
_ANCHORS_OF = {
    pattern: words
    for name in FIELDS
    for pattern, words in zip(PATTERNS[name], ANCHOR_WORDS[name], strict=True)
}
# A dated text holds a digit, a separator and a digit in a row.  Much cheaper to
# look for than the rule, whose look-behind is tried at every character.
_SHAPE_OF = {PATTERNS["date"][2]: to_java(r"\d[/\-.]\d")}

# Non-ASCII letters that case-insensitive matching equates with s, i, i and k,
# while lower-casing does not turn them into these letters.
_ODD_CASE_LETTERS = ("\u017f", "\u0131", "\u0130", "\u212a")


def odd_case(text: str) -> Column:
    """True if lower-casing the column is no safe way to look for anchor words."""
    return F.expr(" or ".join(f"contains({text}, '{letter}')" for letter in _ODD_CASE_LETTERS))


def may_match(pattern: str, text: str, lowered: str, odd: str) -> Column | None:
    """A cheap condition that holds for every text the pattern matches in.

    Takes the names of the columns with the text, the text in lower case, with narrow gaps, and
    the result of ``odd_case``.
    """
    if pattern in _SHAPE_OF:
        return F.col(text).rlike(_SHAPE_OF[pattern])
    words = _ANCHORS_OF[pattern] if pattern in _ANCHORS_OF else required_words(pattern)
    if words is None:
        return None
    return reduce(Column.__or__, [F.contains(F.lower(text) if "  " in word else F.col(lowered), F.lit(word)) for word in words], F.col(odd))


def check_pattern(field_name: str, pattern: str) -> None:
    """Reject a rule that cannot run, with the message shown to the user."""
    try:
        groups = re.compile(pattern).groups
        if groups < 1:
            raise ValueError("manca un gruppo di cattura")
        to_java(pattern)
    except (re.error, ValueError) as exc:
        raise ValueError(f"Espressione regolare non valida per '{field_name}': {pattern} ({exc})") from exc


@dataclass(frozen=True)
class ExtractionRules:
    """Patterns per field and date formats, both in order of priority."""

    patterns: Mapping[str, tuple[str, ...]] = field(default_factory=lambda: dict(PATTERNS))
    date_formats: tuple[str, ...] = DATE_FORMATS

    def merge(
        self,
        patterns: Mapping[str, str | Iterable[str]] | None = None,
        date_formats: Iterable[str] = (),
    ) -> ExtractionRules:
        """A new rule set in which the given rules come before the present ones.

        Unknown fields are ignored.  A present pattern that is given again moves
        to its new place.  New date formats go to the front one by one, so the
        last one given is tried first; known formats keep their place.
        """
        merged = dict(self.patterns)
        for name, given in (patterns or {}).items():
            if name not in merged:
                continue
            custom = (given,) if isinstance(given, str) else tuple(given)
            for pattern in custom:
                check_pattern(name, pattern)
            merged[name] = tuple(dict.fromkeys(custom + tuple(merged[name])))
        formats = self.date_formats
        for fmt in date_formats:
            if fmt not in formats:
                check_format(fmt)
                formats = (fmt, *formats)
        return ExtractionRules(merged, formats)

    def with_options(self, long_amounts: bool = False, long_dates: bool = False) -> ExtractionRules:
        """Both options are off by default, since they read some documents otherwise than the rules as published.

        ``long_amounts``: ``Totale 1250,00`` reads as 1250.0 and not as 125.0.
        ``long_dates``: ``15 marzo 2024`` in running text reads as that date and not as 15.
        """
        rules = self.merge({"total": LONG_AMOUNTS} if long_amounts else {})
        if not long_dates:
            return rules
        # Numeric dates keep their precedence.
        day_only = PATTERNS["date"][3]
        dates = [p for known in rules.patterns["date"] for p in ([LONG_DATES, known] if known == day_only else [known])]
        return ExtractionRules(dict(rules.patterns) | {"date": tuple(dates)}, rules.date_formats)

    def table(self, spark: SparkSession) -> DataFrame:
        """The patterns as rows (field, priority, pattern)."""
        rows = [(n, i, p) for n, ps in self.patterns.items() for i, p in enumerate(ps)]
        return spark.createDataFrame(rows, "field string, priority int, pattern string")


def merge_rule_tables(custom: DataFrame, present: DataFrame) -> DataFrame:
    """Both rule tables as one: custom rules first, each pattern once per field.

    ``source`` (0 custom, 1 present) and ``priority`` give the order in a field.
    Repeats collapse map-side, so only distinct patterns are shuffled.
    """
    tagged = custom.select("field", "pattern", F.lit(0).alias("source"), "priority").unionByName(
        present.select("field", "pattern", F.lit(1).alias("source"), "priority")
    )
    known = present.select("field").distinct()
    return (
        tagged.groupBy("field", "pattern")
        .agg(F.min(F.struct("source", "priority")).alias("place"))
        .join(known, "field", "left_semi")
        .select("field", "pattern", "place.source", "place.priority")
    )


def rules_from_table(table: DataFrame) -> ExtractionRules:
    """Rule set of a merged rules table.

    Rules become part of the query plan, so all of them come to the driver; any
    number is taken, but planning time grows with it.
    """
    merged: dict[str, list[str]] = {name: [] for name in FIELDS}
    for row in table.filter(F.col("field").isin(*FIELDS)).orderBy("field", "source", "priority").collect():
        check_pattern(row.field, row.pattern)
        merged[row.field].append(row.pattern)
    return ExtractionRules({name: tuple(patterns) for name, patterns in merged.items()})
