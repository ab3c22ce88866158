"""Consecutive numbers over a whole sorted table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fiscalframe.functions.once import with_computed_once


def number_rows(df: DataFrame, *order: Column, name: str = "n", total: str | None = None, buckets: int | None = None) -> DataFrame:
    """Adds 1, 2, 3, ... in the given order, and the row count if ``total`` names a column.

    Rows of equal order are numbered by a hash of the row, rows alike in all
    either way.  A plain window would move the whole table into one task: here
    the sort keys of the rows with the least hashes, spread evenly as they are, part
    the rows into buckets (as many as shuffle partitions), which are sorted each by itself; a row's
    number is its place there plus the sizes of the buckets before.  No job runs before the
    action; df is read twice, for the bounds and to be dealt to the buckets.
    """
    buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    orders = {f"_o{i}": o for i, o in enumerate(order)} | {"_tie": F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])}
    key = F.struct(*[o.alias(c) for c, o in orders.items()])
    # Hashed again for the choice, so that the keys chosen are not all of low hash.
    least = df.select(key.alias("_key")).orderBy(F.xxhash64(F.col("_key._tie"), F.lit(1)), "_key").limit(buckets)
    bounds = least.agg(F.array_sort(F.collect_set("_key")).alias("_bounds"))
    # The key once a row, not once a bound.  Never null, so that the join below puts no filter on one side only.
    keyed = with_computed_once(df, "_key", key).withColumn("_bounds", bounds.scalar())
    below = F.coalesce(F.size(F.filter("_bounds", lambda bound: bound < F.col("_key"))), F.lit(0))
    dealt = keyed.select(below.alias("_bucket"), *[F.col(f"_key.{c}").alias(c) for c in orders], *df.columns).repartition("_bucket")
    placed = dealt.withColumn("_place", F.row_number().over(Window.partitionBy("_bucket").orderBy(*orders)))
    # A hash of all columns, which is never below the least long, keeps them in the exchange that sizes
    # are counted from, so that it is the rows' own and is shared.  The bounds depend on the rows only, so
    # the numbers would be the same if it were not.
    present = F.xxhash64(*[F.col(f"`{c}`") for c in dealt.columns if c != "_bucket"]) >= F.lit(-(1 << 63))
    sizes = dealt.groupBy("_bucket").agg(F.count_if(present).alias("_rows"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # One row for each bucket.
    offsets = sizes.select(
        "_bucket",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"),
        F.sum("_rows").over(everything).alias("_total"),
    )
    numbered = placed.join(F.broadcast(offsets), "_bucket")
    columns = [(F.col("_offset") + F.col("_place")).alias(name), *df.columns]
    if total:
        columns.append(F.col("_total").alias(total))
    return numbered.select(*columns)
