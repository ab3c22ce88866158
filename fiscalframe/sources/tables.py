"""Reading tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str, *columns: str, partitions: int | None = None) -> DataFrame:
    """Columns of a Parquet table, all if none is named.

    ``partitions`` spreads the rows by a shuffle before work that is bound by
    CPU; it is for tables of few row groups, where splits are fewer than cores.
    """
    table = spark.read.parquet(path)
    if columns:
        table = table.select(*columns)
    return table.repartition(partitions) if partitions else table
