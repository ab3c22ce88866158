"""Renders invoices from the orders and customer tables.

The given tables hold no Italian invoices, so every order is printed as one, in
one of fourteen layouts.  What the job should read back is known from the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fiscalframe.functions.numbers import comma_decimals, grouped_two_decimals
from fiscalframe.sources.tables import read_table

LAYOUTS = 14
ZERO, CREDIT_MINUS, CREDIT_PARENTHESES, NO_VAT, TWO_PAGES, BLANK_PAGE, EMPTY_FILE, DAMAGED, ABSENT, NO_PAGES, FAILED = range(3, 14)


def italian_amount(value: Column) -> Column:
    """``1.234,56``."""
    return F.translate(grouped_two_decimals(value), ",.", ".,")


def _orders(orders: DataFrame, *columns: str) -> DataFrame:
    """All orders with their layout and path, and the given columns of their own."""
    path = F.concat(
        F.lit("/archivio/"), F.date_format("o_orderdate", "yyyy/MM"), F.lit("/ordine_"), F.col("o_orderkey"), F.lit(".pdf")
    )
    return orders.select(
        path.alias("path"), F.pmod("o_orderkey", F.lit(LAYOUTS)).alias("layout"), "o_orderkey", *columns
    )


def corpus_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested documents: one per order."""
    return _orders(spark.read.parquet(f"{sf_dir}/orders.parquet")).select("path")


def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files found: all but the absent ones."""
    size = F.when(F.col("layout") == EMPTY_FILE, 0).otherwise(F.lit(1000) + F.pmod(F.col("o_orderkey") * 7919, F.lit(3_000_000)))
    decode_error = F.when(F.col("layout") == DAMAGED, F.lit("No /Root object! - Is this really a PDF?"))
    unexpected = F.when(F.col("layout") == FAILED, F.lit("accesso negato"))
    return (
        _orders(spark.read.parquet(f"{sf_dir}/orders.parquet"))
        .filter(F.col("layout") != ABSENT)
        .select(
            "path",
            F.substring_index("path", "/", -1).alias("file_name"),
            size.cast("bigint").alias("file_size"),
            decode_error.alias("decode_error"),
            unexpected.alias("unexpected_error"),
        )
    )


def corpus_pages(spark: SparkSession, sf_dir: str, partitions: int | None = None) -> DataFrame:
    """Page texts of the readable files."""
    columns = ("o_custkey", "o_totalprice", "o_orderdate")
    orders = _orders(read_table(spark, f"{sf_dir}/orders.parquet", "o_orderkey", *columns, partitions=partitions), *columns)
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name")
    # Left, so that an order without its customer still yields a document.
    printed = orders.filter(F.col("layout") <= BLANK_PAGE).join(
        customers, F.col("o_custkey") == F.col("c_custkey"), "left"
    )
    layout, total = F.col("layout"), F.col("o_totalprice")
    credit = layout.isin(CREDIT_MINUS, CREDIT_PARENTHESES)
    number = F.concat(F.when(credit, F.lit("NC-")).otherwise(F.lit("INV-")), F.col("o_orderkey"))
    head = [
        F.concat(F.when(credit, F.lit("NOTA DI CREDITO N. ")).otherwise(F.lit("FATTURA N. ")), number),
        F.concat(F.lit("Data: "), F.date_format("o_orderdate", "dd/MM/yyyy")),
        F.concat(F.lit("Fornitore: "), F.coalesce("c_name", F.lit("Ignoto")), F.lit(" S.r.l.")),
        F.when(layout != NO_VAT, F.concat(F.lit("P.IVA: "), F.lpad(F.col("o_custkey").cast("string"), 11, "0"))),
    ]
    amount = (
        F.when(layout == ZERO, F.lit("0,00"))
        .when(layout == CREDIT_MINUS, F.concat(F.lit("-"), italian_amount(total)))
        .when(layout == CREDIT_PARENTHESES, F.concat(F.lit("("), italian_amount(total), F.lit(")")))
        .otherwise(italian_amount(total))
    )
    tail = [
        F.concat(F.lit("Totale Fattura: EUR "), amount),
        F.lit("Voce unica: fornitura come da ordine"),
        F.concat(F.lit("Imponibile: EUR "), italian_amount(total / 1.22)),
    ]
    one_page = F.concat_ws("\n", *head, *tail)
    first_of_two = F.concat_ws("\n", *head, F.lit("Il conto prosegue sul retro"))
    second_of_two = F.concat_ws("\n", F.lit("Retro del foglio"), *tail)
    texts = (
        F.when(layout == BLANK_PAGE, F.array(F.lit("")))
        .when(layout == TWO_PAGES, F.array(first_of_two, second_of_two))
        .otherwise(F.array(one_page))
    )
    return printed.select("path", F.posexplode(texts).alias("page_no", "page_text"))


def plain_amount(value: Column) -> Column:
    """``1234.56``."""
    return F.translate(comma_decimals(value), ",", ".")
