"""Exact deduplication by skew-safe combining.

Copies are combined where they lie (map side), then per salt of a digest, and
the winners of the salts globally, so that a text which makes up a third of all
rows is never gathered in one task.  Rows combine only if digest and full text
are equal.

Defined cases: a null text counts as empty and equals it; of equal texts the row
with the largest id stays, null ids counting as smallest; rows that repeat both
id and text are one group, of which one row stays; an empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

SALTS = 64


def _digested(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("content"))
    return rows.withColumns({
        "digest": F.unhex(F.sha2("content", 256)),
        # Tells apart texts of one digest, should there ever be any.
        "check": F.xxhash64("content"),
    })


def winners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per distinct text: digest, check, content, keep_id, group_size."""
    key = ["digest", "check", "content"]
    salted = _digested(docs, id_col, text_col).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
    per_salt = salted.groupBy(*key, "salt").agg(F.max("id").alias("id"), F.count(F.lit(1)).alias("n"))
    return per_salt.groupBy(*key).agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size"))


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256.

    Texts move in the two combining steps only; documents find their winner by
    digest and check in a narrow join that AQE can split.  The job fails should
    two different texts share both.
    """
    found = winners(docs, id_col, text_col, salts).groupBy("digest", "check").agg(
        F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.count(F.lit(1)).alias("contents")
    )
    size = F.when(F.col("contents") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two texts share a digest")))
    found = found.select("digest", "check", "keep_id", size.alias("group_size"))
    rows = _digested(docs, id_col, text_col).groupBy("id", "digest", "check").agg(F.count(F.lit(1)).alias("repeats"))
    joined = rows.join(found, ["digest", "check"])
    each = joined.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))))
    return each.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("repeat") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of docs that stay, with all their columns.

    Every column must be orderable; among rows of equal text and id the largest
    by the other columns, in their order, stays.
    """
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    row = F.struct(F.col(id_col).alias("c0"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others, 1)], F.col(text_col).isNotNull().alias("given"))
    content = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.unhex(F.sha2(content, 256)).alias("digest"), content.alias("content"), F.pmod(F.xxhash64(id_col), F.lit(salts)).alias("salt"), row.alias("row"))
    per_salt = rows.groupBy("digest", "content", "salt").agg(F.max("row").alias("row"))
    best = per_salt.groupBy("digest", "content").agg(F.max("row").alias("row"))
    columns = {id_col: F.col("row.c0"), text_col: F.when(F.col("row.given"), F.col("content"))}
    columns |= {c: F.col(f"row.c{i}") for i, c in enumerate(others, 1)}
    return best.select([columns[c].alias(c) for c in docs.columns])
