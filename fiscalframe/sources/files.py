"""File tables: what is known about a document without reading it."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fiscalframe.functions.text import file_name


def is_pdf_name(name: Column) -> Column:
    """True for a file name with the suffix .pdf in any case; ``.pdf`` alone has no suffix."""
    return F.lower(name).rlike(r"(?s)[^/]\.pdf\z")


# What a path pattern reads as more than itself.
_GLOB_CHARACTERS = re.compile(r"([\\*?{}\[\]])")


def _without_local_scheme(uri: Column) -> Column:
    return F.regexp_replace(uri, r"\Afile:/+", "/")


def scan_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """The PDF files at a path as (path, file_name, file_size).

    The path may be relative to the working folder, or spelt with "." or repeated slashes; results have absolute
    paths.  A folder contributes its ``*.pdf`` files (case-sensitive), with ``recursive``
    those of all its sub-folders, whatever these are called; without it no sub-folder is listed.  A single file may
    be named ``.PDF`` too, and is an error if it is no PDF by name, as is a path that
    does not exist.  Only metadata is read.  Names starting with "." or "_" are hidden to Spark.

    Spark lists folders on the driver; the list stays in the JVM.  Where there are too many files for that,
    an inventory (a table of the same three columns, as object stores deliver
    it) takes the place of this scan in everything that follows.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    given = hadoop.Path(path)
    system = given.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    root = system.makeQualified(given)
    if not system.exists(root):
        raise FileNotFoundError(f"Il percorso non esiste: {path}")
    # Spark reads any path as a pattern, so one that is meant as it stands is escaped.
    literal = _GLOB_CHARACTERS.sub(r"\\\1", root.toString())
    if system.getFileStatus(root).isFile():
        if not root.getName().lower().endswith(".pdf"):
            raise ValueError(f"Il file non è un PDF: {path}")
        pattern = literal
    else:
        pattern = literal if recursive else f"{literal.rstrip('/')}/*.pdf"
        if not recursive and not len(system.globStatus(hadoop.Path(pattern))):
            return spark.createDataFrame([], "path string, file_name string, file_size bigint")
    # Recursive in any case: else Spark takes sub-folders named k=v for partitions.
    # A listed file that cannot be read is an error, so one without a row is empty.
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", False)
    found = (listing.option("pathGlobFilter", "*.pdf") if recursive else listing).load(pattern)
    uris = spark._jvm.scala.collection.immutable.ArraySeq.unsafeWrapArray(found._jdf.inputFiles())
    listed = DataFrame(spark._jsparkSession.createDataset(uris, spark._jvm.org.apache.spark.sql.Encoders.STRING()).toDF(), spark)
    # A plus sign in a URI's path is itself.
    decoded = F.url_decode(F.regexp_replace("value", r"\+", "%2B"))
    listed = listed.select(_without_local_scheme(decoded).alias("path"))
    if not recursive and pattern != literal:
        # A folder called x.pdf is matched, too, and listed in place of itself.
        own = _without_local_scheme(F.lit(root.toString().rstrip("/")))
        listed = listed.filter(F.expr("substr(path, 1, length(path) - length(substring_index(path, '/', -1)) - 1)") == own)
    sizes = found.select(_without_local_scheme(F.col("path")).alias("path"), "length")
    return listed.join(sizes, "path", "left").select(
        "path", file_name(F.col("path")).alias("file_name"), F.coalesce("length", F.lit(0)).alias("file_size")
    )


def accept_uploads(uploads: DataFrame, name: str = "path") -> DataFrame:
    """The uploaded files that are PDFs by name."""
    return uploads.filter(is_pdf_name(F.col(name)))


def skipped_files(uploads: DataFrame, name: str = "path") -> DataFrame:
    """Names of the uploaded files that are no PDFs, one row each.

    One row per file rather than one joined text: the list has no bound.
    """
    rest = uploads.filter(~is_pdf_name(F.col(name)))
    return rest.select(*[c for c in uploads.columns if c != name], file_name(F.col(name)).alias("file_name"))
