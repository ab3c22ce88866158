"""Page texts to document texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def assemble_pages(pages: DataFrame, key: str = "path", order: str = "page_no", text: str = "page_text", bucketed: bool = False) -> DataFrame:
    """One row per document: its non-empty pages in order, joined by line feeds.

    Pages without text still count in ``n_pages``.  The text column of a
    document is null-free: "" if no page has text.  Pages are moved to their key
    before they are gathered, since gathering beforehand would only copy them;
    ``bucketed`` says that the table is bucketed by the key, and nothing is moved.
    """
    page = F.when(F.col(text) != "", F.struct(F.col(order).alias("no"), F.col(text).alias("text")))
    pages = pages.select(key, page.alias("_page"))
    return (
        (pages if bucketed else pages.repartition(key))
        .groupBy(key)
        .agg(F.count("*").alias("n_pages"), F.sort_array(F.collect_list("_page")).alias("_pages"))
        .select(key, "n_pages", F.array_join(F.col("_pages.text"), "\n").alias("text"))
    )


def read_text_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents stored as one text file each, as one-page page rows; needs no shuffle."""
    return spark.read.text(path, wholetext=True).select(
        F.regexp_replace(F.col("_metadata.file_path"), r"\Afile:/+", "/").alias("path"),
        F.lit(1).alias("page_no"),
        F.col("value").alias("page_text"),
    )
