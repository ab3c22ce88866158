"""Field extraction from Italian business documents as Spark jobs."""

from fiscalframe.functions.dates import parse_italian_date
from fiscalframe.functions.numbers import parse_italian_number
from fiscalframe.operators.fields import extract_field, extract_fields
from fiscalframe.operators.materialise import materialise
from fiscalframe.operators.rules import ExtractionRules
from fiscalframe.plans.pipeline import extract_documents, extract_invoice, extract_invoices
from fiscalframe.plans.reports import fatture, fatture_with_total, grand_total, problem_files, riepilogo
from fiscalframe.sinks.csv_text import write_csv
from fiscalframe.sinks.outputs import write_outputs
from fiscalframe.sources.files import scan_files
from fiscalframe.sources.rule_config import load_rules

__all__ = [
    "ExtractionRules",
    "extract_documents",
    "extract_field",
    "extract_fields",
    "extract_invoice",
    "extract_invoices",
    "fatture",
    "fatture_with_total",
    "grand_total",
    "load_rules",
    "materialise",
    "parse_italian_date",
    "parse_italian_number",
    "problem_files",
    "riepilogo",
    "scan_files",
    "write_csv",
    "write_outputs",
]
