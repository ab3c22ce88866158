"""Writing all outputs of a batch."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame

from fiscalframe.operators.materialise import materialise
from fiscalframe.plans.reports import fatture_with_total, riepilogo
from fiscalframe.sinks.csv_text import write_csv_parts
from fiscalframe.sinks.staged import replacing

FORMATS = ("parquet", "csv", "both")


def write_outputs(
    invoices: DataFrame,
    output: str,
    fmt: str = "parquet",
    include_summary: bool = True,
    delimiter: str = ";",
) -> list[str]:
    """Writes the batch next to ``output`` with the suffix replaced; returns the folders written.

    ``<base>.parquet`` holds the sheets as ``fatture`` (detail and grand total)
    and ``riepilogo`` (if wanted), ``<base>.csv`` the CSV export.  Existing
    outputs are replaced, all of them when all new ones are written and none otherwise;
    missing parent folders are made.  Extraction runs once.
    The sheet holds the column ``seq`` if the invoices have one, else the path,
    to put its rows back in order.  Raises OSError, with a message for the user,
    where an output cannot be written.
    """
    fmt = fmt.lower()
    if fmt not in FORMATS:
        raise ValueError(f"Formato non valido: '{fmt}'. Usa 'parquet', 'csv' oppure 'both'.")
    folder, name = posixpath.split(output)
    base = posixpath.join(folder, posixpath.splitext(name)[0])
    order = "seq" if "seq" in invoices.columns else "path"
    sheet = [f"{base}.parquet"] if fmt in ("parquet", "both") else []
    export = [f"{base}.csv"] if fmt in ("csv", "both") else []
    kept = materialise(invoices)
    with _writing(", ".join(sheet + export)), replacing(invoices.sparkSession, sheet + export) as places:
        if sheet:
            fatture_with_total(kept, order).write.parquet(f"{places[0]}/fatture")
            if include_summary:
                now = datetime.now().strftime("%d/%m/%Y %H:%M:%S")
                riepilogo(kept, sheet[0], now).write.parquet(f"{places[0]}/riepilogo")
        if export:
            write_csv_parts(kept, places[-1], delimiter, order)
    return sheet + export


@contextmanager
def _writing(path: str) -> Iterator[None]:
    """Any failure of Spark to write there, as an OSError.  The first sentence is a fixed value."""
    try:
        yield
    except (PySparkException, Py4JJavaError) as exc:
        raise OSError(f"Impossibile salvare '{path}'. Verifica lo spazio e i permessi di scrittura.") from exc
