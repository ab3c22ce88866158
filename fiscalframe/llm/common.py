"""What several corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
# bytes.split() cuts at the same six characters.
WORD = r"[^\x20\x09-\x0D]+"

# Python stages take so many characters of text at a time, whatever the rows of a batch.
SLICE_CHARS = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8; lone surrogates cannot occur in Spark's strings."""
    return text.encode().split() if text else []


def held_out(key: Column) -> Column:
    """The third of the documents that nothing learns from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def kept(frame: DataFrame) -> DataFrame:
    """The rows written to the cluster's checkpoint folder, and read from there ever after.

    The folder is the one the cluster names in spark.checkpoint.dir.  Only where
    that is unset is a folder of the warehouse taken, which is shared as well.
    """
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        conf = frame.sparkSession.conf
        context.setCheckpointDir(conf.get("spark.checkpoint.dir", None) or conf.get("spark.sql.warehouse.dir") + "/checkpoints")
    return frame.checkpoint()


def slices(batch: pa.RecordBatch, text: str = "text", chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of at most so many bytes of text, or of one row."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_pylist()
    start = total = 0
    for row, size in enumerate(sizes):
        if row > start and total + size > chars:
            yield batch.slice(start, row - start)
            start, total = row, 0
        total += size
    if start < batch.num_rows:
        yield batch.slice(start)
