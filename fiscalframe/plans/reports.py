"""Report tables over extracted invoices, each in one pass over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fiscalframe.functions.numbers import grouped_two_decimals, shortest, sum_of_totals, two_decimals
from fiscalframe.functions.text import path_parts
from fiscalframe.operators.numbering import number_rows
from fiscalframe.operators.status import labelled

# Export columns in order, and the wording of the reports.
EXPORT_COLUMNS = (
    "File",
    "Numero Fattura",
    "Data",
    "Totale",
    "Fornitore",
    "Partita IVA",
    "Tipo Documento",
    "Esito",
    "Note",
)
GRAND_TOTAL = "TOTALE COMPLESSIVO"


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def export_columns() -> list[Column]:
    """The nine export columns of an invoice; only the total may be null."""
    return [
        F.col("filename").alias("File"),
        _text("invoice_number").alias("Numero Fattura"),
        _text("date").alias("Data"),
        F.col("total").alias("Totale"),
        _text("supplier_name").alias("Fornitore"),
        _text("vat_number").alias("Partita IVA"),
        F.col("document_type_it").alias("Tipo Documento"),
        F.col("status_it").alias("Esito"),
        F.col("notes_it").alias("Note"),
    ]


def fatture(invoices: DataFrame) -> DataFrame:
    """The detail sheet: one row per invoice."""
    return invoices.select(*export_columns())


def grand_total(invoices: DataFrame) -> DataFrame:
    """Sum of all totals, credit notes subtracting; 0 if there is none."""
    return invoices.agg(sum_of_totals(F.col("total"), F.col("total_dec")).alias("grand_total"))


def rows_and_total(invoices: DataFrame, *columns: Column) -> DataFrame:
    """The given columns of every invoice (``is_total`` false), and one row with them null and ``grand_total`` (true).

    Both parts read one exchange of the narrow rows, so invoices are extracted once.  It is dealt by
    all its columns, which therefore neither part can prune; that would make two exchanges
    of them.  AQE splits what is dealt unevenly.
    """
    plain = invoices.select(*columns)
    names = [f"_c{i}" for i in range(len(columns))]
    moved = invoices.select(*[c.alias(n) for c, n in zip(columns, names, strict=True)], F.col("total").alias("_total"), F.col("total_dec").alias("_total_dec"))
    moved = moved.hint("rebalance", *moved.columns)
    total = moved.agg(sum_of_totals(F.col("_total"), F.col("_total_dec")).alias("grand_total"))
    shown = [F.col(n).alias(field.name) for n, field in zip(names, plain.schema, strict=True)]
    rows = moved.select(F.lit(False).alias("is_total"), *shown, F.lit(None).cast(total.schema["grand_total"].dataType).alias("grand_total"))
    nothing = [F.lit(None).cast(field.dataType).alias(field.name) for field in plain.schema]
    return rows.unionByName(total.select(F.lit(True).alias("is_total"), *nothing, "grand_total"))


def fatture_with_total(invoices: DataFrame, order: str = "path") -> DataFrame:
    """Detail rows (section 0) with their order column, and the grand-total row (section 1), in one pass."""
    found = rows_and_total(invoices, F.col(order), *export_columns())
    shown = {c: F.lit("") for c in EXPORT_COLUMNS} | {"File": F.lit(GRAND_TOTAL), "Totale": F.col("grand_total")}
    if order == "path":
        shown["path"] = F.lit("")
    return found.select(
        F.col("is_total").cast("int").alias("sezione"),
        *[F.when(F.col("is_total"), shown[c]).otherwise(F.col(c)).alias(c) if c in shown else F.col(c) for c in (order, *EXPORT_COLUMNS)],
    )


def summary(invoices: DataFrame) -> DataFrame:
    """One row of counts and the grand total, in one pass."""
    incomplete = ~F.col("has_hard_error") & (F.size("missing_fields") > 0)
    return invoices.agg(
        F.count("*").alias("processed"),
        F.count_if("is_ok").alias("ok"),
        F.count_if(incomplete).alias("incomplete"),
        F.count_if("has_hard_error").alias("failed"),
        F.count_if("is_credit_note").alias("credit_notes"),
        sum_of_totals(F.col("total"), F.col("total_dec")).alias("grand_total"),
    )


def _lines(one_row: DataFrame, lines: list[tuple[str, Column, Column | None]]) -> DataFrame:
    """(ordine, voce, valore) rows of a one-row table, without those whose condition fails."""
    entries = [
        F.when(F.lit(True) if shown is None else shown, F.struct(F.lit(n).alias("ordine"), F.lit(label).alias("voce"), value.alias("valore")))
        for n, (label, value, shown) in enumerate(lines, 1)
    ]
    return one_row.select(F.inline(F.array_compact(F.array(*entries))))


def _count(name: str) -> Column:
    return F.col(name).cast("string")


def riepilogo(invoices: DataFrame, destination: str | None = None, exported_at: str | None = None) -> DataFrame:
    """The summary sheet; the last two lines only when they are given."""
    gap = ("", F.lit(""), None)
    lines = [
        ("PDF elaborati", _count("processed"), None),
        ("Estratti correttamente", _count("ok"), None),
        ("Estratti parzialmente", _count("incomplete"), None),
        ("Non leggibili", _count("failed"), None),
        ("Note di credito", _count("credit_notes"), None),
        gap,
        ("Totale complessivo (€)", two_decimals(F.col("grand_total")), None),
    ]
    if destination is not None or exported_at is not None:
        lines += [
            gap,
            ("File esportato in", F.lit(destination or ""), None),
            ("Data esportazione", F.lit(exported_at or ""), None),
        ]
    return _lines(summary(invoices), lines)


def console_summary(invoices: DataFrame, written: tuple[str, ...] = ()) -> DataFrame:
    """The summary of a batch run, with one line per written output."""
    return _lines(
        summary(invoices),
        [
            ("Fatture elaborate", _count("processed"), None),
            ("Estratte correttamente", _count("ok"), None),
            ("Estratte parzialmente", _count("incomplete"), None),
            ("File non leggibili", _count("failed"), None),
            ("Note di credito", _count("credit_notes"), F.col("credit_notes") > 0),
            ("Totale complessivo", F.concat(F.lit("€ "), grouped_two_decimals(F.col("grand_total"))), None),
            *[("File esportato", F.lit(path), None) for path in written],
        ],
    )


def web_summary(invoices: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """The summary of an upload: lines without a count are left out.

    Skipped files follow one per row, under one label and in the order of their
    ``seq`` column if there is one (the upload order).
    """
    lines = _lines(
        summary(invoices),
        [
            ("Fatture elaborate", _count("processed"), None),
            ("Estratte correttamente", _count("ok"), None),
            ("Estratte parzialmente", _count("incomplete"), F.col("incomplete") > 0),
            ("File non leggibili", _count("failed"), F.col("failed") > 0),
            ("Note di credito", _count("credit_notes"), F.col("credit_notes") > 0),
            ("Totale complessivo", F.concat(F.lit("€ "), grouped_two_decimals(F.col("grand_total"))), None),
        ],
    ).withColumn("seq", F.lit(0).cast("bigint"))
    if skipped is None:
        return lines
    # The label stands between the credit notes (5) and the total (6, moved to 7).
    moved = lines.withColumn("ordine", F.when(F.col("ordine") == 6, 7).otherwise(F.col("ordine")))
    seq = F.col("seq").cast("bigint") if "seq" in skipped.columns else F.lit(0).cast("bigint")
    ignored = skipped.select(
        F.lit(6).alias("ordine"),
        F.lit("File ignorati (non PDF)").alias("voce"),
        F.col("file_name").alias("valore"),
        seq.alias("seq"),
    )
    return moved.unionByName(ignored)


def problem_files(invoices: DataFrame) -> DataFrame:
    """Files that did not extract cleanly, with the reason."""
    detail = F.when(F.col("has_hard_error"), F.array_join("errors", " | ")).otherwise(labelled(F.col("missing_fields")))
    return invoices.filter(~F.col("is_ok")).select("path", F.col("filename").alias("File"), detail.alias("Dettaglio"))


def invoice_unpivot(invoices: DataFrame) -> DataFrame:
    """Campo/Valore pairs of each invoice, all export columns but file and notes."""
    shown = [c for c in EXPORT_COLUMNS if c not in ("File", "Note")]
    texts = invoices.select("path", *export_columns()).withColumn(
        "Totale", F.coalesce(shortest(F.col("Totale")), F.lit(""))
    )
    return texts.unpivot("path", shown, "Campo", "Valore")


def preview_table(invoices: DataFrame) -> DataFrame:
    """The export columns as display texts, the total as ``1,234.56 €``."""
    shown = F.coalesce(F.concat(grouped_two_decimals(F.col("Totale")), F.lit(" €")), F.lit(""))
    return invoices.select("path", *export_columns()).withColumn("Totale", shown)


def size_text(size: Column) -> Column:
    """``1,234 byte`` below one MiB, ``1.5 MB`` from there on."""
    small = F.concat(F.format_number(size, 0), F.lit(" byte"))
    return F.when(size < 1024 * 1024, small).otherwise(
        F.concat(F.call_function("format_number", size / F.lit(1024.0 * 1024.0), F.lit("0.0")), F.lit(" MB"))
    )


def file_listing(files: DataFrame) -> DataFrame:
    """Numbered files in path order (component by component), with their size as text."""
    listed = files.select("path", size_text(F.col("file_size")).alias("size_text"))
    return number_rows(listed, path_parts(F.col("path")), name="n", total="n_files")
