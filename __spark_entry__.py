"""

Most queries read invoices rendered from orders and customer; the SQL never
matches text there but states, from the same rows, what must be read back.  On
the prose tables (documents, pages, conversations) the SQL re-states the rules
for DuckDB's own regex engine.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import Column, DataFrame, SparkSession, functions as F  # noqa: E402

from fiscalframe.functions.dates import parse_italian_date  # noqa: E402
from fiscalframe.functions.numbers import comma_decimals, parse_italian_number  # noqa: E402
from fiscalframe.functions.text import clean_capture  # noqa: E402
from fiscalframe.operators.fields import extract_field, extract_fields  # noqa: E402
from fiscalframe.operators.reads import read_documents  # noqa: E402
from fiscalframe.operators.rules import DATE_FORMATS, PATTERNS, ExtractionRules, merge_rule_tables  # noqa: E402
from fiscalframe.plans import reports  # noqa: E402
from fiscalframe.plans.corpus import (  # noqa: E402
    corpus_files,
    corpus_manifest,
    corpus_pages,
    italian_amount,
    plain_amount,
)
from fiscalframe.plans.pipeline import extract_invoices  # noqa: E402
from fiscalframe.sinks.csv_text import csv_lines  # noqa: E402
from fiscalframe.sources.files import skipped_files  # noqa: E402
from fiscalframe.sources.pages import assemble_pages  # noqa: E402
from fiscalframe.sources.tables import read_table  # noqa: E402

# The corpus operators are a folder of their own, which may be absent.
try:
    from fiscalframe.llm import queries as corpus_queries
except ModuleNotFoundError as missing:
    if missing.name not in ("fiscalframe.llm", "corpus_pipeline"):
        raise
    corpus_queries = None

Query = Callable[[SparkSession, str], DataFrame]


# --- inputs -------------------------------------------------------------------


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Partitions to spread CPU-bound inputs over, where tables have fewer row groups than there are cores.
# Unset, tables of texts are read as they lie; narrow rows of which texts are rendered are always spread, since
# so few bytes are one split.
SPREAD = int(os.environ.get("FISCALFRAME_SPREAD", "0")) or None


def _spread(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Narrow rows that much work is done on, over a few tasks a core."""
    return read_table(spark, f"{sf_dir}/{name}.parquet", *columns, partitions=SPREAD or 4 * spark.sparkContext.defaultParallelism)


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rendered corpus, extracted."""
    return extract_invoices(
        corpus_files(spark, sf_dir),
        corpus_pages(spark, sf_dir, SPREAD),
        corpus_manifest(spark, sf_dir),
    )


def corpus_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble_pages(corpus_pages(spark, sf_dir, SPREAD)).select("path", "text")


def prose(spark: SparkSession, sf_dir: str, table: str, key: str, text: str) -> DataFrame:
    """A prose table as (key, text)."""
    rows = read_table(spark, f"{sf_dir}/{table}.parquet", key, text, partitions=SPREAD)
    return rows.select(F.col(key).alias("doc_key"), F.col(text).alias("text"))


# Frequent words of the prose, and what they become to give the rules matches.
SEEDED = (
    (" de ", " fattura n. "),
    (" le ", " Fornitore: "),
    (" la ", " importo € 12,5 "),
    (" et ", " data 2024-1-5 "),
    (" der ", " Totale (-1.250,40) "),
    (" the ", " società "),
    (" of ", " -- P.IVA 01234567890 "),
    (" un ", " 31/2/24 | "),
)


def seeded(text: Column) -> Column:
    for word, planted in SEEDED:
        text = F.replace(text, F.lit(word), F.lit(planted))
    return text


def _choices(label: str, value: str, *pairs: tuple[str, Column]) -> Column:
    """One row per named rendering of a row."""
    return F.inline(F.array(*[F.struct(F.lit(n).alias(label), c.alias(value)) for n, c in pairs]))


# --- queries ------------------------------------------------------------------


def q_page_text_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return assemble_pages(turns, "conv_id", "turn", "text").select("conv_id", "n_pages", "text")


def q_clean_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("c_name")
    amount = F.concat(F.lit("-"), F.abs("c_acctbal").cast("decimal(18,2)").cast("string"))
    wrapped = _table(spark, sf_dir, "customer").select(
        "c_custkey",
        _choices(
            "wrapping",
            "wrapped",
            ("bare", name),
            ("space", F.concat(F.lit(" \t\n\u00a0"), name, F.lit("\u2003 \r\n"))),
            ("marks", F.concat(F.lit(".,;: "), name, F.lit(" :;,."))),
            ("dashes", F.concat(F.lit("--- "), name, F.lit("---"))),
            ("mixed", F.concat(F.lit(": -- "), name, F.lit(" -- ."))),
            ("minus", F.concat(F.lit("; "), amount, F.lit(" -."))),
            ("two_minus", F.concat(F.lit("-"), amount)),
            ("nothing", F.lit(" .;- - ")),
        ),
    )
    return wrapped.select("c_custkey", "wrapping", clean_capture(F.col("wrapped")).alias("cleaned"))


def q_field(field: str, column: str) -> Query:
    """One field of the corpus texts: the raw capture, and for dates and totals the value."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = extract_field(corpus_texts(spark, sf_dir), "text", field, ExtractionRules())
        value = F.col(field)
        if field == "date":
            value = F.coalesce(parse_italian_date(value, DATE_FORMATS), value)
        elif field == "total":
            value = parse_italian_number(value)
        return found.select("path", value.alias(column))

    return query


# Per field and rule a text in which that rule, and none before it, yields the value; {} is made of the order.
# Two total rules cannot win: whatever the third or the sixth finds, the first one finds at least a part of.
RULE_TEXTS = {
    "invoice_number": (
        ("1", "Ricevuta n. R/{} pagata"),
        ("1 again", "numero documento: {}"),
        ("2", "ddt ; \nnumero fattura: Q/{}"),
        ("3", "N.FATTURA_{}"),
        ("4", "ddt ; \nProtocollo: P-{}"),
        ("none", "ordine {}"),
    ),
    "date": (
        ("1", "del documento: {:dd/MM/yyyy} e data 1999-1-1"),
        ("2", "Data: {:yyyy-MM-dd} oppure 01/02/1999"),
        ("3", "Roma, {:dd.MM.yyyy}"),
        ("4", "Emessa il {:dd} marzo {:yyyy}"),
        ("none", "Emessa nel {:yyyy}"),
    ),
    "total": (
        ("1", "Importo documento: EUR {:it}"),
        ("2", "Totale da pagare: {:it}"),
        ("4", "In tutto € {:it}"),
        ("5", "Tot. {:it}"),
        ("none", "In tutto {:it}"),
    ),
    "supplier_name": (
        ("1", "Mittente: Casa {}\nEmail x"),
        ("2", "Spett.le Casa {} | resto"),
        ("3", "Ragione sociale: Casa {} tel 1"),
        ("4", "Casa {} S.n.c. di Roma"),
        ("none", "Casa {}"),
    ),
    "vat_number": (
        ("1", "Partita IVA: {:vat} e 99999999999 |"),
        ("2", "Codice {:vat} |"),
        ("3", "Cod. fisc: {:vat} qui"),
        ("none", "Numero {:vat} qui"),
    ),
}


def _rule_text(template: str) -> Column:
    made = {
        "{}": F.col("o_orderkey").cast("string"),
        "{:it}": italian_amount(F.col("o_totalprice")),
        "{:vat}": F.lpad(F.col("o_custkey").cast("string"), 11, "0"),
    }
    text = F.lit(template)
    for shape in ("dd/MM/yyyy", "yyyy-MM-dd", "dd.MM.yyyy", "dd", "yyyy"):
        made[f"{{:{shape}}}"] = F.date_format("o_orderdate", shape)
    for place, value in made.items():
        if place in template:
            text = F.replace(text, F.lit(place), value)
    return text


def q_rule_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each rule of each field gets its turn: per order, one text per rule that can win."""
    orders = _spread(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    fields = []
    for field, texts in RULE_TEXTS.items():
        rendered = orders.select("o_orderkey", _choices("rule", "text", *[(rule, _rule_text(text)) for rule, text in texts]))
        found = extract_field(rendered, "text", field, ExtractionRules())
        fields.append(found.select("o_orderkey", F.lit(field).alias("field"), "rule", F.col(field).alias("capture")))
    whole = fields[0]
    for more in fields[1:]:
        whole = whole.unionByName(more)
    return whole


def q_wide_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns printed 200 blanks apart; every other order lacks its amount."""
    gap = F.repeat(F.lit(" "), 200)
    amount = F.when(F.col("o_orderkey") % 2 == 0, italian_amount(F.col("o_totalprice"))).otherwise(F.lit("x"))
    text = F.concat(
        F.lit("FATTURA"), gap, F.lit("N."), gap, F.lit("INV-"), F.col("o_orderkey"), gap, F.lit("\nData:"), gap,
        F.date_format("o_orderdate", "yyyy-MM-dd"), gap, F.lit("\nP."), gap, F.lit("IVA"), gap, F.lpad(F.col("o_custkey").cast("string"), 11, "0"),
        gap, F.lit("\nTotale"), gap, F.lit("documento"), gap, F.lit(":"), gap, F.lit("EUR"), gap, amount, gap,
    )
    orders = _spread(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    found = extract_fields(orders.select("o_orderkey", text.alias("text")))
    return found.select("o_orderkey", "invoice_number", "date", "total", "vat_number")


def q_many_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier anchors a thousand times over, with and without the stop word that their rules look for."""
    key = F.col("c_custkey").cast("string")
    text = F.when(F.col("c_custkey") % 2 == 0, F.repeat(F.lit("ditta "), 1000)).otherwise(F.repeat(F.lit("spett.le a "), 1000))
    stop = F.when(F.col("c_custkey") % 3 == 0, F.concat(key, F.lit(" | fine"))).otherwise(key)
    texts = _spread(spark, sf_dir, "customer", "c_custkey").select("c_custkey", F.concat(text, stop).alias("text"))
    return extract_field(texts, "text", "supplier_name", ExtractionRules()).select("c_custkey", "supplier_name")


def q_odd_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary over a manifest with repeats and requests without a path, and over file rows that repeat."""
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    path = F.concat(F.lit("/archivio/"), F.date_format("o_orderdate", "yyyy/MM"), F.lit("/ordine_"), F.col("o_orderkey"), F.lit(".pdf"))
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    asked = F.when(F.col("l_linenumber") % 3 != 0, path)
    manifest = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(asked.alias("path"))
    files = corpus_files(spark, sf_dir)
    return reports.summary(extract_invoices(files.unionByName(files), corpus_pages(spark, sf_dir, SPREAD), manifest))


def q_extract_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_fields(corpus_texts(spark, sf_dir)).drop("text", "total_dec")


def q_parse_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    def renderings(value: Column) -> Column:
        size = F.abs(value)
        sign = F.when(value < 0, F.lit("-")).otherwise(F.lit(""))
        true_minus = F.when(value < 0, F.lit("\u2212")).otherwise(F.lit("+"))
        enclosed = F.concat(F.lit("("), italian_amount(size), F.lit(")"))
        return _choices(
            "rendering",
            "text",
            ("dots", F.concat(F.lit("€ "), sign, italian_amount(size))),
            ("spaces", F.concat(sign, F.translate(italian_amount(size), ".", "\u00a0"))),
            ("comma", F.concat(sign, comma_decimals(size), F.lit("  "))),
            ("plain", F.concat(sign, plain_amount(size))),
            ("enclosed", F.when(value < 0, enclosed).otherwise(italian_amount(size))),
            ("true_minus", F.concat(true_minus, F.lit(" "), italian_amount(size))),
            ("us_style", F.concat(sign, F.format_number(size, 2), F.lit(" EUR"))),
        )

    orders = _spread(spark, sf_dir, "orders", "o_orderkey", "o_totalprice").select(
        F.lit("orders").alias("source"), F.col("o_orderkey").alias("key"), renderings(F.col("o_totalprice"))
    )
    customers = _spread(spark, sf_dir, "customer", "c_custkey", "c_acctbal").select(
        F.lit("customer").alias("source"), F.col("c_custkey").alias("key"), renderings(F.col("c_acctbal"))
    )
    texts = orders.unionByName(customers)
    return texts.select("source", "key", "rendering", parse_italian_number(F.col("text")).alias("value"))


ITALIAN_DATE = "concat(day(o_orderdate), ' ', element_at(split('gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre', ' '), month(o_orderdate)), ' ', year(o_orderdate))"


def q_parse_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = ("dd/MM/yyyy", "dd/MM/yy", "dd-MM-yyyy", "dd-MM-yy", "dd.MM.yyyy", "dd.MM.yy", "yyyy/MM/dd", "yyyy-MM-dd", "yyyy.MM.dd", "d/M/yyyy")
    texts = _spread(spark, sf_dir, "orders", "o_orderkey", "o_orderdate").select(
        "o_orderkey",
        _choices(
            "shape",
            "text",
            *[(shape, F.date_format("o_orderdate", shape)) for shape in shapes],
            ("long", F.upper(F.expr(ITALIAN_DATE))),
            ("long_tail", F.concat(F.expr(ITALIAN_DATE), F.lit(", Roma"))),
            ("mixed", F.date_format("o_orderdate", "dd/MM-yyyy")),
            ("english", F.date_format("o_orderdate", "d MMMM yyyy")),
        ),
    )
    return texts.select("o_orderkey", "shape", parse_italian_date(F.col("text"), DATE_FORMATS).alias("iso"))


# Formats of users, with times, names of days, days of the year and weeks; the last ones are of no day.
CUSTOM_DATE_FORMATS = ("%d/%m/%Y %H:%M", "%A %d %B %Y", "%j/%Y", "%m/%d/%Y %I:%M:%S %p", "%G-W%V-%u", "%U.%w.%Y")


def q_custom_date_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    weekdays = F.split(F.lit("lunedì martedì mercoledì giovedì venerdì sabato domenica"), " ")
    day = F.col("o_orderdate")
    iso = [F.extract(F.lit(part), day).cast("string") for part in ("YEAROFWEEK", "WEEK", "DAYOFWEEK_ISO")]
    # Weeks that begin on Sunday, counted from the first Sunday.
    sunday = F.floor((F.dayofyear(day) + 6 - F.dayofweek(day) + 1) / 7).cast("string")
    texts = _spread(spark, sf_dir, "orders", "o_orderkey", "o_orderdate").select(
        "o_orderkey",
        _choices(
            "shape",
            "text",
            ("time", F.concat(F.date_format(day, "d/M/yyyy"), F.lit(" 7:05"))),
            ("weekday", F.concat_ws(" ", F.initcap(F.get(weekdays, F.weekday(day))), F.expr(ITALIAN_DATE))),
            ("yearday", F.date_format(day, "D/yyyy")),
            ("half_day", F.concat(F.date_format(day, "MM/dd/yyyy"), F.lit(" 12:59:59 pm"))),
            ("iso_week", F.concat(iso[0], F.lit("-W"), F.lpad(iso[1], 2, "0"), F.lit("-"), iso[2])),
            ("sunday_week", F.concat_ws(".", sunday, (F.dayofweek(day) - 1).cast("string"), F.year(day).cast("string"))),
            ("no_time", F.concat(F.date_format(day, "d/M/yyyy"), F.lit(" 24:05"))),
            ("no_day", F.concat(F.lit("367/"), F.year(day))),
        ),
    )
    formats = ExtractionRules().merge({}, CUSTOM_DATE_FORMATS).date_formats
    return texts.select("o_orderkey", "shape", parse_italian_date(F.col("text"), formats).alias("iso"))


def q_date_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = prose(spark, sf_dir, "documents", "doc_id", "text")
    return extract_fields(texts).select("doc_key", "date")


def q_prose(table: str, key: str, text: str) -> Query:
    """All fields of a table of prose, which holds only chance matches."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return extract_fields(prose(spark, sf_dir, table, key, text)).drop("text", "date_parsed", "total_dec")

    return query


def q_seeded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = prose(spark, sf_dir, "documents", "doc_id", "text").withColumn("text", seeded(F.col("text")))
    return extract_fields(texts).drop("text", "date_parsed", "total_dec")


def q_amount_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _spread(spark, sf_dir, "orders", "o_orderkey", "o_totalprice").select(
        "o_orderkey", F.concat(F.lit("Totale "), comma_decimals(F.col("o_totalprice"))).alias("text")
    )
    found = extract_field(texts, "text", "total", ExtractionRules())
    return found.select("o_orderkey", F.col("total").alias("capture"), parse_italian_number(F.col("total")).alias("value"))


def q_status_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invoices(spark, sf_dir).select(
        "path", "has_hard_error", "is_ok", "is_credit_note", "status_it", "document_type_it"
    )


def q_missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invoices(spark, sf_dir).select("path", F.array_join("missing_fields", ",").alias("missing_fields"))


def q_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invoices(spark, sf_dir).select("path", "notes_it")


def q_read_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_documents(corpus_files(spark, sf_dir), corpus_pages(spark, sf_dir), corpus_manifest(spark, sf_dir))
    return documents.select("path", "filename", "error_kind", "error", F.length("text").isNotNull().alias("readable"))


def q_repeated_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest that asks for an order's document once per line item."""
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    path = F.concat(F.lit("/archivio/"), F.date_format("o_orderdate", "yyyy/MM"), F.lit("/ordine_"), F.col("o_orderkey"), F.lit(".pdf"))
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    manifest = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        path.alias("path"), F.concat_ws("/", "l_orderkey", "l_linenumber").alias("seq")
    )
    asked = extract_invoices(corpus_files(spark, sf_dir), corpus_pages(spark, sf_dir), manifest)
    return asked.select("path", "seq", "invoice_number", "total", "status_it")


def q_fatture_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.fatture(invoices(spark, sf_dir))


def q_fatture_with_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.fatture_with_total(invoices(spark, sf_dir))


def q_csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return csv_lines(invoices(spark, sf_dir))


def q_preview_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.preview_table(invoices(spark, sf_dir))


def q_invoice_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.invoice_unpivot(invoices(spark, sf_dir))


def q_problem_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.problem_files(invoices(spark, sf_dir))


def q_grand_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.grand_total(invoices(spark, sf_dir))


def q_riepilogo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.riepilogo(invoices(spark, sf_dir))


def q_console_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.console_summary(invoices(spark, sf_dir))


def _uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploaded names: every document, with a suffix by its language."""
    suffix = (
        F.when(F.col("lang") == "de", ".pdf")
        .when(F.col("lang") == "en", ".PDF")
        .when(F.col("lang") == "es", ".pdf.txt")
        .otherwise("/.pdf")
    )
    path = F.concat(F.lit("/upload/"), F.col("doc_id"), suffix)
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), path.alias("path"))


def q_skipped_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skipped_files(_uploads(spark, sf_dir))


def q_web_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.web_summary(invoices(spark, sf_dir), skipped_files(_uploads(spark, sf_dir)))


def q_file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _table(spark, sf_dir, "pages").select(
        F.concat_ws("/", "url", "page_id").alias("path"), (F.length("html") * 100).cast("bigint").alias("file_size")
    )
    return reports.file_listing(files)


# A custom rule before the built-in ones, and one that repeats a built-in rule.
CUSTOM_PATTERNS = {
    "invoice_number": [r"CODICE\s+(?P<code>\S+)"],
    "date": r"emessa il\s+(\d{8})",
    "total": [PATTERNS["total"][3]],
    "unknown": ["ignored"],
}


def q_custom_rule_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _spread(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("Fattura n. INV-"), F.col("o_orderkey")),
        F.concat(F.lit("Data: "), F.date_format("o_orderdate", "dd/MM/yyyy")),
        F.when(urgent, F.concat(F.lit("codice U"), F.col("o_custkey"))),
        F.when(urgent, F.concat(F.lit("Codice U"), F.col("o_custkey"), F.lit(" emessa il 2001"), F.lpad(F.month("o_orderdate").cast("string"), 2, "0"), F.lit("28"))),
        F.lit("Totale 5,00"),
        F.concat(F.lit("EUR "), italian_amount(F.col("o_totalprice"))),
    )
    rules = ExtractionRules().merge(CUSTOM_PATTERNS, ["%Y%m%d", "%d/%m/%Y"])
    texts = orders.select("o_orderkey", text.alias("text"))
    return extract_fields(texts, rules=rules).select("o_orderkey", "invoice_number", "date", "total")


def q_rule_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Custom rules taken from the parts: patterns repeat, and some are built-in or for unknown fields."""
    kind = F.col("p_type")
    field = (
        F.when(kind == "ECONOMY", "total").when(kind == "STANDARD", "date").when(kind == "PROMO", "unknown").otherwise("vat_number")
    )
    pattern = F.when(F.col("p_size") <= 5, F.lit(PATTERNS["total"][2])).otherwise(F.concat("p_brand", F.lit(r"\s+(\S+)")))
    custom = _table(spark, sf_dir, "part").select(
        field.alias("field"), F.col("p_partkey").cast("int").alias("priority"), pattern.alias("pattern")
    )
    return merge_rule_tables(custom, ExtractionRules().table(spark))


def entry(spark: SparkSession) -> DataFrame:
    """Flagship query: the extracted invoices of the smallest tables."""
    return invoices(spark, "/root/testdata/sf0.001")


def invoice_queries() -> dict[str, Query]:
    return {
        "page_text_assembly": q_page_text_assembly,
        "clean_capture": q_clean_capture,
        "rule_chain": q_rule_chain,
        "f_invoice_number": q_field("invoice_number", "invoice_number"),
        "f_date": q_field("date", "date"),
        "f_total": q_field("total", "total"),
        "f_supplier": q_field("supplier_name", "supplier_name"),
        "f_vat": q_field("vat_number", "vat_number"),
        "wide_gaps": q_wide_gaps,
        "many_anchors": q_many_anchors,
        "odd_requests": q_odd_requests,
        "extract_all": q_extract_all,
        "parse_number": q_parse_number,
        "parse_date": q_parse_date,
        "custom_date_formats": q_custom_date_formats,
        "date_negative": q_date_negative,
        "documents_fields": q_prose("documents", "doc_id", "text"),
        "pages_fields": q_prose("pages", "page_id", "html"),
        "seeded_documents": q_seeded_documents,
        "amount_truncation": q_amount_truncation,
        "status_flags": q_status_flags,
        "missing_fields": q_missing_fields,
        "notes": q_notes,
        "read_errors": q_read_errors,
        "repeated_requests": q_repeated_requests,
        "fatture_table": q_fatture_table,
        "fatture_with_total": q_fatture_with_total,
        "csv_lines": q_csv_lines,
        "preview_table": q_preview_table,
        "invoice_unpivot": q_invoice_unpivot,
        "problem_files": q_problem_files,
        "grand_total": q_grand_total,
        "riepilogo": q_riepilogo,
        "console_summary": q_console_summary,
        "web_summary": q_web_summary,
        "file_listing": q_file_listing,
        "skipped_files": q_skipped_files,
        "rule_merge": q_rule_merge,
        "custom_rule_priority": q_custom_rule_priority,
    }


def queries() -> dict[str, Query]:
    return invoice_queries() | (corpus_queries.queries() if corpus_queries else {})


def oracle_sql() -> dict[str, str]:
    from expected_sql import expected

    return expected(SEEDED) | (corpus_queries.oracle_sql() if corpus_queries else {})
