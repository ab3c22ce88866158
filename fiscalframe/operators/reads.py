"""From requested files and page texts to readable documents or read errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fiscalframe.functions.text import file_name, is_blank
from fiscalframe.sources.pages import assemble_pages

# No path holds this character.
_NO_PATH = "\u0001"


def error_kind(size: Column, unexpected: Column, decode_error: Column, n_pages: Column, blank: Column) -> Column:
    """Why a document cannot be read; null if it can.  The first reason counts."""
    return (
        F.when(unexpected.isNotNull(), "unexpected")
        .when(size.isNull(), "missing")
        .when(size == 0, "empty")
        .when(decode_error.isNotNull() | F.coalesce(n_pages == 0, F.lit(True)), "corrupt")
        .when(blank, "scanned")
    )


def error_message(kind: Column, path: Column, name: Column, unexpected: Column, decode_error: Column) -> Column:
    """The message shown for an unreadable document; a missing path or name is shown as nothing.  The texts are fixed values."""
    path, name = F.coalesce(path, F.lit("")), F.coalesce(name, F.lit(""))
    unreadable = F.concat(F.lit("PDF danneggiato o protetto da password: "), name, F.lit(" ("), decode_error, F.lit(")"))
    return (
        F.when(kind == "unexpected", F.concat(F.lit("Errore imprevisto durante la lettura: "), unexpected))
        .when(kind == "missing", F.concat(F.lit("File PDF non trovato: "), path))
        .when(kind == "empty", F.concat(F.lit("Il file è vuoto (0 byte): "), name))
        .when(kind == "corrupt", F.coalesce(unreadable, F.concat(F.lit("Il PDF non contiene pagine: "), name)))
        .when(
            kind == "scanned",
            F.concat(
                F.lit("Nessun testo estraibile da "),
                name,
                F.lit(": probabilmente è una scansione. Serve un OCR."),
            ),
        )
    )


def document_texts(pages: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """Assembled pages, of the manifest's documents only if there is one, and whether they are blank.

    Pages without a path belong to no document; together they could be one huge
    group.
    """
    pages = pages.filter(F.col("path").isNotNull())
    if manifest is not None:
        # Distinct, so that a path requested very often is one row of its join partition.  Said as a
        # comparison, "has a path" lets Spark put a Bloom filter of the requests before the shuffle of
        # large page tables (session.SETTINGS); a test for null would not.
        asked = manifest.select("path").filter(F.col("path") >= "").distinct()
        pages = pages.join(asked, "path", "left_semi")
    return assemble_pages(pages).withColumn("blank", is_blank(F.col("text")))


def with_read_errors(texts: DataFrame, files: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """Joins per-document rows to the requested documents and says which of these cannot be read.

    Gives one row per path, a null one included: the columns of ``texts`` without ``n_pages`` and
    ``blank``, which it must have, all null for unreadable documents; and
    filename, error_kind and error.
    """
    for name in ("file_name", "decode_error", "unexpected_error"):
        if name not in files.columns:
            files = files.withColumn(name, F.lit(None).cast("string"))
    # All meet on a key that is the path, or no possible path for none: joins and groups of one
    # partitioning, which null-safe joins would not share.
    files = files.withColumn("_key", F.coalesce("path", F.lit(_NO_PATH)))
    # Of several rows of a path the one with the largest size counts.
    known = F.max(F.struct("file_size", "file_name", "decode_error", "unexpected_error")).alias("known")
    requested = files.groupBy("_key").agg(known)
    if manifest is not None:
        asked = manifest.select(F.coalesce("path", F.lit(_NO_PATH)).alias("_key")).distinct()
        requested = asked.join(requested, "_key", "left")
    requested = requested.select("_key", F.nullif("_key", F.lit(_NO_PATH)).alias("path"), "known.*")
    texts = texts.withColumnRenamed("path", "_text_path")

    path, name, kind = F.col("path"), F.col("filename"), F.col("error_kind")
    unexpected, decode_error = F.col("unexpected_error"), F.col("decode_error")
    found = (
        requested.join(texts, F.col("_key") == F.col("_text_path"), "left")
        .withColumn("filename", F.coalesce("file_name", file_name(path)))
        .withColumn("error_kind", error_kind(F.col("file_size"), unexpected, decode_error, F.col("n_pages"), F.col("blank")))
    )
    carried = [c for c in texts.columns if c not in ("_text_path", "n_pages", "blank")]
    return found.select(
        "path",
        "filename",
        *[F.when(kind.isNull(), F.col(c)).alias(c) for c in carried],
        "error_kind",
        error_message(kind, path, name, unexpected, decode_error).alias("error"),
    )


def read_documents(files: DataFrame, pages: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """Documents as (path, filename, text, error_kind, error), one row per path.

    ``files`` has (path, file_size) and may have ``file_name``, ``decode_error``
    (why the pages could not be read) and ``unexpected_error``; ``pages`` has
    (path, page_no, page_text).  With a ``manifest`` of paths these are the
    requested documents, otherwise all files are.  ``text`` is null on errors.
    """
    return with_read_errors(document_texts(pages, manifest), files, manifest)
