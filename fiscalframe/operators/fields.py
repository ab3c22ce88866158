"""Field extraction: each field is the first usable capture of its rules."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, functions as F

from fiscalframe.functions.dates import parse_italian_date
from fiscalframe.functions.numbers import exact_cents, parse_italian_number
from fiscalframe.functions.once import non_empty, with_computed_once
from fiscalframe.functions.text import clean_capture
from fiscalframe.operators.rules import AMOUNT_RULES, FIELDS, WORD_RULES, ExtractionRules, gaps_in_amounts, may_match, narrowed, odd_case, run_form


@lru_cache(maxsize=64)
def first_capture(text: str, patterns: tuple[str, ...], narrow: str, amounts: str, lowered: str, odd: str) -> Column:
    """Cleaned capture of the first rule that yields one, or null; arguments but patterns name columns.

    Rules whose captures are the same there search the text with narrow gaps.

    Only the first match of a rule counts; a capture that is empty after
    cleaning passes the turn to the next rule.  A rule is evaluated once at
    most, and not at all after a hit or in a text without its anchor words.
    """
    tries = []
    for pattern in patterns:
        searched = narrow if pattern in WORD_RULES else amounts if pattern in AMOUNT_RULES else text
        found = non_empty(clean_capture(F.regexp_extract(searched, run_form(pattern), 1)))
        condition = may_match(pattern, searched, lowered, odd)
        tries.append(found if condition is None else F.when(condition, found))
    return F.coalesce(*tries)


def first_captures(
    df: DataFrame,
    text: str,
    rules: ExtractionRules,
    fields: tuple[str, ...] = FIELDS,
    prefix: str = "",
) -> DataFrame:
    """Adds the first capture of each of the given fields."""
    made = {"_amounts": F.when(gaps_in_amounts("_narrow"), F.col(text)).otherwise(F.col("_narrow")), "_lowered": F.lower("_narrow"), "_odd_case": odd_case("_narrow")}
    found = df.withColumn("_narrow", narrowed(text)).withColumns(made)
    for field in fields:
        capture = first_capture(text, rules.patterns[field], "_narrow", "_amounts", "_lowered", "_odd_case")
        found = with_computed_once(found, prefix + field, capture)
    return found.drop("_narrow", *made)


def extract_field(df: DataFrame, text: str, field: str, rules: ExtractionRules) -> DataFrame:
    """Adds the raw capture of one field."""
    return first_captures(df, text, rules, (field,))


def extract_fields(
    df: DataFrame,
    text: str = "text",
    rules: ExtractionRules | None = None,
    fields: tuple[str, ...] = FIELDS,
) -> DataFrame:
    """Adds the fields of a document: number, date, total, supplier and VAT number, or those asked for.

    A date comes with ``date_parsed``, a total with ``total_dec``.  A date that
    cannot be parsed is kept as found; a total that is no number is null.
    """
    rules = rules or ExtractionRules()
    fields = tuple(f for f in FIELDS if f in fields)
    found = first_captures(df, text, rules, fields, prefix="_raw_")
    iso_date, total = _parsed("_raw_date", rules.date_formats, "_raw_total")
    if "date" in fields:
        found = with_computed_once(found, "_iso_date", iso_date)
    if "total" in fields:
        found = with_computed_once(found, "total", total)
    columns = {
        "invoice_number": [F.col("_raw_invoice_number").alias("invoice_number")],
        "date": [F.coalesce("_iso_date", "_raw_date").alias("date"), F.col("_iso_date").try_cast("date").alias("date_parsed")],
        "total": [F.col("total"), exact_cents(F.col("total")).alias("total_dec")],
        "supplier_name": [F.col("_raw_supplier_name").alias("supplier_name")],
        "vat_number": [F.col("_raw_vat_number").alias("vat_number")],
    }
    return found.select(*df.columns, *[c for f in fields for c in columns[f]])


@lru_cache(maxsize=64)
def _parsed(date: str, formats: tuple[str, ...], total: str) -> tuple[Column, Column]:
    """The date and total of the named capture columns."""
    return parse_italian_date(F.col(date), formats), parse_italian_number(F.col(total))
