"""One result row per request, also where a path is requested many times."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def per_request(manifest: DataFrame, invoices: DataFrame, order: str | None = None) -> DataFrame:
    """Joins per-path results to the manifest, keeping repeats, requests without a path and the ``order`` column.

    One join with the requests on the side that is kept: where a path, or none,
    holds very many of them, AQE splits its requests over tasks and copies the
    one result row to each.
    """
    requests = manifest.select(F.col("path").alias("_path"), *([order] if order else []))
    joined = requests.join(invoices, F.col("_path").eqNullSafe(invoices["path"]), "left")
    rest = [c for c in invoices.columns if c != "path"]
    return joined.select(F.col("_path").alias("path"), *([order] if order else []), *rest)
