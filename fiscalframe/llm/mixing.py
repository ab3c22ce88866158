"""Mixing of sources to target weights by balanced sampling (cube method).

A source whose target is r times its size is taken floor(r) times as a whole, and
each of its documents once more with probability r - floor(r).  Which ones is
decided by the flight phase of the cube method: the probabilities of three
documents at a time move along the null space of the two balancing constraints
(words and documents) until one of them is 0 or 1, so both totals stay what they
were.  Blocks of a source fly by themselves, what each leaves open (two documents
at most) flies on in blocks of blocks, and the last two of a source land on the
rounding that comes nearest to its totals.

Defined cases: a null text has size 0; null is a source of its own, last in
order; sources without words have target 0 and are not taken; one source alone
is taken once as it is; rows may repeat and ids may be null; an empty table
gives an empty result; columns to carry may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from fiscalframe.llm.common import kept, word_count

WEIGHTS = (1, 2, 3)
MOST = 3  # times a source's size
BLOCK = 2_000  # documents that fly together
FAN = 1_000  # blocks whose open documents fly together


def targets(sources: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """rank, target and target / source_size for each row of (source, source_size): one row per source.

    Weights repeat in code point order of the sources.  Targets share the sum of all sizes by
    weight, but none exceeds ``most`` times its source: sorted by the level at
    which they fill, sources fill one after another, each leaving the rest to the others.
    """
    every = Window.partitionBy(F.lit(0))
    by_name = every.orderBy(F.col("source").asc_nulls_last())
    by_level = every.orderBy(F.col("source_size") / F.col("weight"), "rank")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    table = sources.withColumn("rank", F.row_number().over(by_name))
    table = table.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") - 1) % len(weights) + 1))
    table = table.withColumn("full", F.col("source_size") * most)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("full").over(before), F.lit(0))
    weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    table = table.withColumns({"left": left, "among": weight})
    fills = F.col("full") * F.col("among") < F.col("weight") * F.col("left")
    # The first source that does not fill sets the level for all after it.
    table = table.withColumn("fills", fills)
    whole = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = F.first(F.when(~F.col("fills"), F.struct("left", "among")), ignorenulls=True).over(whole)
    table = table.withColumn("rest", rest)
    shared = F.col("weight") * F.col("rest.left") / F.col("rest.among")
    table = table.withColumn("target", F.when(F.col("fills"), F.col("full").cast("double")).otherwise(shared))
    times = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    return table.select("source", "source_size", "n", "rank", "target", times.alias("times"))


def flight(size: np.ndarray, share: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Shares moved until at most two are neither 0 nor 1; sums of share and of size * share stay."""
    share = share.copy()
    free = np.flatnonzero((share > 0) & (share < 1))
    while len(free) >= 3:
        rng.shuffle(free)
        rows = free[: len(free) // 3 * 3].reshape(-1, 3)
        x, p = size[rows], share[rows]
        u = np.stack([x[:, 1] - x[:, 2], x[:, 2] - x[:, 0], x[:, 0] - x[:, 1]], axis=1)
        u[(u == 0).all(axis=1)] = (1.0, -1.0, 0.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(u > 0, (1 - p) / u, np.where(u < 0, p / -u, np.inf))
            down = np.where(u < 0, (1 - p) / -u, np.where(u > 0, p / u, np.inf))
        most, least = up.min(axis=1), down.min(axis=1)
        go_up = rng.random(len(rows)) * (most + least) < least
        p = p + np.where(go_up, most, -least)[:, None] * u
        first = np.where(go_up, up.argmin(axis=1), down.argmin(axis=1))
        each = np.arange(len(rows))
        p[each, first] = np.round(p[each, first])
        p[(p < 1e-12)], p[(p > 1 - 1e-12)] = 0.0, 1.0
        share[rows] = p
        free = np.flatnonzero((share > 0) & (share < 1))
    return share


def land(size: np.ndarray, share: np.ndarray, start: np.ndarray) -> np.ndarray:
    """All shares 0 or 1, sums of size * share and of share as near to those of start as can be."""
    share = share.copy()
    free = np.flatnonzero((share > 0) & (share < 1))
    words, count = float((size * start).sum()), float(start.sum())
    best = None
    for bits in range(1 << len(free)):
        share[free] = [bits >> k & 1 for k in range(len(free))]
        off = (abs(float((size * share).sum()) - words), abs(float(share.sum()) - count))
        if best is None or off < best[0]:
            best = (off, bits)
    share[free] = [best[1] >> k & 1 for k in range(len(free))]
    # Exchanges of one taken document for another keep the number of documents.
    movable = np.flatnonzero((start > 0) & (start < 1))
    for _ in range(8):
        off = float((size * share).sum()) - words
        taken, other = (movable[share[movable] == v] for v in (1, 0))
        if abs(off) < 1 or not len(taken) or not len(other):
            break
        other = other[np.argsort(size[other], kind="stable")]
        wanted = size[taken] - off
        at = np.searchsorted(size[other], wanted)
        near = np.stack([np.clip(at - 1, 0, len(other) - 1), np.clip(at, 0, len(other) - 1)])
        error = np.abs(size[other][near] - wanted)
        side, i = np.unravel_index(error.argmin(), error.shape)
        if error[side, i] >= abs(off):
            break
        share[taken[i]], share[other[near[side, i]]] = 0, 1
    return share


def _flown(rows: pa.Table, level: int, seed: int) -> pa.Table:
    """One block: share after its flight; landed where the block is all of its source."""
    rows = rows.sort_by([(c, "ascending") for c in ("place", "size", "slot")])
    rank, block, blocks = (rows.column(c)[0].as_py() for c in ("rank", "block", "blocks"))
    size, start = (rows.column(c).to_numpy().astype(float) for c in ("size", "share"))
    rng = np.random.default_rng([seed, level, rank, block])
    share = flight(size, start, rng)
    if blocks == 1:
        share = land(size, share, start)
    rows = rows.set_column(rows.schema.get_field_index("share"), "share", pa.array(share))
    if level == 0:
        rows = rows.set_column(rows.schema.get_field_index("slot"), "slot", pa.array(np.arange(len(rows)), pa.int64()))
    return rows


def _fly(rows: DataFrame, level: int, seed: int) -> DataFrame:
    return rows.groupBy("rank", "block").applyInArrow(lambda block: _flown(block, level, seed), rows.schema)


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    most: int = MOST,
    size_col: str | None = None,
    carry: tuple[str, ...] = (),
    block: int = BLOCK,
    seed: int = 7,
) -> DataFrame:
    """One row per row of docs: id_col, size, source_size, target (its source's), copies, taken (words), and the columns to carry.

    Sizes are the texts' words unless a column has them.  Blocks are dealt by a
    hash of id and size, so a rerun decides the same.
    """
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), (F.col(size_col) if size_col else word_count(F.col(text_col))).alias("size"),
        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)],
    )
    plan = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), weights, most)
    blocks = F.ceil(F.col("n") / block).cast("long")
    plan = plan.withColumns({"blocks": blocks, "whole": F.floor("times"), "share": F.col("times") - F.floor("times")})
    most_blocks = plan.agg(F.max("blocks")).first()[0] or 1
    plan = plan.withColumnRenamed("source", "of").drop("n", "times")
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("of"))).drop("of", "source")
    place: Column = F.xxhash64("id", "size")
    rows = rows.withColumns({"place": place, "block": F.pmod(place, F.col("blocks")), "slot": F.lit(0).cast("long")})
    flown = _fly(rows, 0, seed)
    if most_blocks > 1:
        flown = kept(flown)
        open_rows = flown.filter((F.col("share") > 0) & (F.col("share") < 1)).select("rank", "block", "blocks", "slot", "place", "size", "share")
        open_rows = open_rows.withColumn("home", F.col("block"))
        level = 1
        while most_blocks > 1:
            joined = open_rows.withColumns({"block": F.floor(F.col("block") / FAN), "blocks": F.ceil(F.col("blocks") / FAN)})
            open_rows = _fly(joined, level, seed)
            most_blocks, level = -(-most_blocks // FAN), level + 1
        landed = open_rows.select(F.col("rank"), F.col("home").alias("block"), "slot", F.col("share").alias("landed"))
        flown = flown.join(landed, ["rank", "block", "slot"], "left").withColumn("share", F.coalesce("landed", "share"))
    copies = (F.col("whole") + F.round("share")).cast("long")
    return flown.select(
        F.col("id").alias(id_col), "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"),
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)],
    )


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of docs that the mix takes, with size, source_size, target, copies and taken beside their columns.

    Where docs has a column of such a name, the mix's own is called mix_<name>.

    Texts take no part in the mixing: rows find their decision by id, source,
    hash of the text and number among rows alike in all three.
    """
    alike, number = (next(f"{n}{i or ''}" for i in range(len(docs.columns) + 1) if f"{n}{i or ''}" not in docs.columns) for n in ("alike", "number"))
    hashed = docs.withColumns({alike: F.xxhash64(text_col), "size": word_count(F.col(text_col))})
    one = Window.partitionBy(id_col, source_col, alike).orderBy(F.lit(0))
    numbered = hashed.select(id_col, source_col, "size", alike).withColumn(number, F.row_number().over(one))
    decided = mix(numbered, id_col, source_col=source_col, size_col="size", carry=(source_col, alike, number), **options)
    rows = docs.withColumn(alike, F.xxhash64(text_col)).withColumn(number, F.row_number().over(one)).alias("rows")
    decided = decided.filter("copies > 0").alias("decided")
    same = [F.col(f"rows.{c}").eqNullSafe(F.col(f"decided.{c}")) for c in (id_col, source_col, alike, number)]
    taken = [F.col(f"decided.{c}").alias(f"mix_{c}" if c in docs.columns else c) for c in ("size", "source_size", "target", "copies", "taken")]
    return rows.join(decided, same).select(*[F.col(f"rows.`{c}`") for c in docs.columns], *taken)
