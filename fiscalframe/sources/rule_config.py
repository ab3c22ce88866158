"""Rule configuration files."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from fiscalframe.operators.rules import ExtractionRules


def load_rules(spark: SparkSession, path: str, base: ExtractionRules | None = None) -> ExtractionRules:
    """Rule set extended by a JSON file ``{"patterns": {field: [regex, ...]}, "date_formats": [...]}``.

    A field's value may be a single regex.  Other keys are ignored.  Raises
    ValueError, with a message for the user, if the file cannot be used; the
    texts of the messages are fixed values.
    """
    name = path.rstrip("/").rsplit("/", 1)[-1]
    try:
        rows = spark.read.text(path, wholetext=True).limit(2).collect()
    except AnalysisException as exc:
        raise ValueError(f"Impossibile leggere il file di configurazione {path}: {exc}") from exc
    if len(rows) > 1:
        raise ValueError(f"Impossibile leggere il file di configurazione {path}: più di un file")
    try:
        config = json.loads(rows[0].value if rows else "")
    except json.JSONDecodeError as exc:
        raise ValueError(f"File di configurazione non valido ({name}): {exc}") from exc
    patterns = config.get("patterns", {}) if isinstance(config, dict) else None
    if not isinstance(patterns, dict):
        raise ValueError("La chiave 'patterns' deve essere un oggetto JSON.")
    return (base or ExtractionRules()).merge(patterns, config.get("date_formats", []))
