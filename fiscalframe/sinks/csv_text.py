"""The Italian CSV export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fiscalframe.functions.numbers import comma_decimals
from fiscalframe.functions.text import path_parts
from fiscalframe.plans.reports import EXPORT_COLUMNS, GRAND_TOTAL, export_columns, rows_and_total
from fiscalframe.sinks.staged import replacing

BYTE_ORDER_MARK = "\ufeff"
HEADER, DETAIL, GAP, TOTAL = range(4)


def csv_line(columns: list[Column], delimiter: str = ";") -> Column:
    """One CSV record; a field is quoted only if it has to be."""
    special = F.lit(delimiter)

    def field(value: Column) -> Column:
        quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(F.contains(value, special) | value.rlike('["\r\n]'), quoted).otherwise(value)

    return F.concat_ws(delimiter, *[field(c) for c in columns])


def csv_lines(invoices: DataFrame, delimiter: str = ";", order: str = "path") -> DataFrame:
    """All lines of the export as (section, <order>, line), to be sorted by the first two.

    Header with a byte order mark, one line per invoice with a comma decimal
    total, an empty line and the grand total.  One pass over the invoices.
    """
    session = invoices.sparkSession
    key = invoices.schema[order].dataType
    no_key = F.lit(None).cast(key).alias(order)
    detail = export_columns()
    detail[EXPORT_COLUMNS.index("Totale")] = F.coalesce(comma_decimals(F.col("total")), F.lit(""))
    total_row = [F.lit("")] * len(EXPORT_COLUMNS)
    total_row[0] = F.lit(GRAND_TOTAL)
    total_row[EXPORT_COLUMNS.index("Totale")] = comma_decimals(F.col("grand_total"))
    header = csv_line([F.lit(c) for c in EXPORT_COLUMNS], delimiter)

    found = rows_and_total(invoices, F.col(order), csv_line(detail, delimiter).alias("line"))
    lines = found.select(
        F.when(F.col("is_total"), TOTAL).otherwise(DETAIL).alias("section"),
        order,
        F.when(F.col("is_total"), csv_line(total_row, delimiter)).otherwise(F.col("line")).alias("line"),
    )
    fixed = F.array(
        F.struct(F.lit(HEADER).alias("section"), no_key, F.concat(F.lit(BYTE_ORDER_MARK), header).alias("line")),
        F.struct(F.lit(GAP).alias("section"), no_key, F.lit("").alias("line")),
    )
    return lines.unionByName(session.range(1).select(F.inline(fixed)))


def write_csv_parts(invoices: DataFrame, path: str, delimiter: str = ";", order: str = "path") -> None:
    """Writes the export as text parts into a new folder.

    The parts are cut from one sorted sequence of lines: read in name order they
    are, byte for byte, the single export file.  A small export is one part.
    No task holds more than its range of lines; lines of one key are put in the
    order of their text, so that many requests of a path are ranges, too.
    """
    key = path_parts(F.col(order)) if order == "path" else F.col(order)
    lines = csv_lines(invoices, delimiter, order).orderBy("section", key, "line")
    lines.select("line").write.text(path, lineSep="\r\n")


def write_csv(invoices: DataFrame, path: str, delimiter: str = ";", order: str = "path") -> None:
    """Writes the export (see ``write_csv_parts``), replacing what is there once all of it is written."""
    with replacing(invoices.sparkSession, [path]) as (place,):
        write_csv_parts(invoices, place, delimiter, order)
