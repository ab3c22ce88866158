"""Session settings that suit this library."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Small batches of texts are worth spreading over all cores; this bounds
    # merging from below only, large ones are merged as usual.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128KB",
    # Joins whose smaller side fits in memory per partition need not sort the
    # other side, which may be page texts.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    # A Bloom filter of the requested paths at the scan of page texts, also where the requests are too
    # many to broadcast: of 8 MB at most, and of use up to some ten million paths.
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1GB",
    "spark.sql.optimizer.runtime.bloomFilter.expectedNumItems": "4000000",
    "spark.sql.optimizer.runtime.bloomFilter.numBits": "67108864",
    # The rule chains generate long methods.  The JVM compiles none beyond 8000
    # bytes, so Spark had better cut them up.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Java's case mapping suffices to find anchor words; ICU's takes seconds to load.
    "spark.sql.icu.caseMappings.enabled": "false",
    # Files of tables that were kept for several outputs go when these are done.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


# Extraction is bound by CPU and takes some seconds per 10 MB and core, so a
# shuffle partition of page texts is best kept well below Spark's 128 MB splits.
TEXT_BYTES_PER_PARTITION = 64 << 20


def with_settings(builder: SparkSession.Builder, text_bytes: int = 0) -> SparkSession.Builder:
    """A session builder with the settings, and shuffle partitions for that much page text if it is given.

    AQE merges partitions that turn out small, but splits none of an aggregation.
    """
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    if text_bytes:
        builder = builder.config("spark.sql.shuffle.partitions", max(200, -(-text_bytes // TEXT_BYTES_PER_PARTITION)))
    return builder
