"""The extraction job: files and page texts in, one invoice row per request out."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fiscalframe.operators.fields import extract_fields
from fiscalframe.operators.reads import document_texts, with_read_errors
from fiscalframe.operators.requests import per_request
from fiscalframe.operators.rules import ExtractionRules
from fiscalframe.operators.status import with_status

INVOICE_COLUMNS = (
    "path", "filename", "invoice_number", "date", "date_parsed", "total", "total_dec",
    "supplier_name", "vat_number", "errors", "missing_fields", "has_hard_error", "is_ok",
    "is_credit_note", "status_it", "document_type_it", "notes_it", "error_kind",
)


def extract_documents(documents: DataFrame, rules: ExtractionRules | None = None) -> DataFrame:
    """Invoices of documents that are already whole: (path, filename, text, error_kind, error)."""
    return with_status(extract_fields(documents, "text", rules)).select(*INVOICE_COLUMNS)


def extract_invoices(
    files: DataFrame,
    pages: DataFrame,
    manifest: DataFrame | None = None,
    rules: ExtractionRules | None = None,
) -> DataFrame:
    """Invoices of the requested documents; see ``read_documents`` for the inputs.

    Unreadable documents become rows with an error, nothing is ever raised for
    one document.  A path that stands in the manifest several times gives as
    many rows.

    Fields are extracted where the pages of a document come together, the only
    place its text is moved to; what is joined to the files afterwards is narrow.
    """
    extracted = extract_fields(document_texts(pages, manifest), "text", rules).drop("text")
    invoices = with_status(with_read_errors(extracted, files, manifest)).select(*INVOICE_COLUMNS)
    if manifest is None:
        return invoices
    order = "seq" if "seq" in manifest.columns else None
    return per_request(manifest, invoices, order).select(*INVOICE_COLUMNS, *([order] if order else []))


def extract_invoice(files: DataFrame, pages: DataFrame, path: str, rules: ExtractionRules | None = None) -> DataFrame:
    """The one row of a single document; only its pages leave the scan."""
    wanted = F.col("path") == path
    manifest = files.sparkSession.createDataFrame([(path,)], "path string")
    return extract_invoices(files.filter(wanted), pages.filter(wanted), manifest, rules)
