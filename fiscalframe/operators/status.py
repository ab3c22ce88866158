"""Status columns of extracted invoices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fiscalframe.functions.text import lookup
from fiscalframe.operators.rules import FIELD_LABELS, FIELDS


def missing_fields() -> Column:
    """Names of the fields without a value, in field order."""
    return F.array_compact(F.array(*[F.when(F.col(name).isNull(), F.lit(name)) for name in FIELDS]))


def labelled(names: Column) -> Column:
    """``Campi non trovati: numero fattura, totale``; unknown names stay as they are."""
    texts = F.transform(names, lambda name: F.coalesce(lookup(FIELD_LABELS, name), name))
    return F.concat(F.lit("Campi non trovati: "), F.array_join(texts, ", "))


def with_status(df: DataFrame, error: str = "error", kind: str = "error_kind") -> DataFrame:
    """Adds errors, missing fields, the three flags and the Italian texts.

    A document that could not be read has a kind of error and no missing fields.
    """
    empty = F.array().cast("array<string>")
    failed = F.col(kind).isNotNull()
    issues = df.withColumns(
        {
            "errors": F.when(failed, F.array(F.coalesce(error, kind))).otherwise(empty),
            "missing_fields": F.when(failed, empty).otherwise(missing_fields()),
        }
    )
    hard, soft = F.size("errors") > 0, F.size("missing_fields") > 0
    credit = F.coalesce(F.col("total") < 0, F.lit(False))
    return issues.withColumns(
        {
            "has_hard_error": hard,
            "is_ok": ~hard & ~soft,
            "is_credit_note": credit,
            "status_it": F.when(hard, "Errore").when(soft, "Incompleto").otherwise("OK"),
            "document_type_it": F.when(F.col("total").isNull(), "").when(credit, "Nota di credito").otherwise("Fattura"),
            "notes_it": F.concat_ws(" | ", F.col("errors"), F.when(soft, labelled(F.col("missing_fields")))),
        }
    )
