"""Merkle manifest of a dataset by cogrouped subtree exchange.

Each row is a leaf, the digest of its columns.  The leaves of a group (here a
language) are in order of their key and make a tree of eight children a node;
the groups' tops, in order of the group, make one more such tree, whose top is
the root.

1. Rows become leaves where they are read; only ids, groups and digests move.
   They are put in order by a range exchange and numbered by what each range
   holds of each group.
2. A superblock is 512 consecutive leaves of a group.  What it reduces to is the
   leaf of the next tier, where 512 such nodes are a superblock again, until every group has one.
3. From the top tier downwards, each superblock gets its required outer nodes: its
   top's siblings on the way to the root.  The nodes of a superblock and these
   are cogrouped in one ``applyInPandas``, which reduces the block again, joins its
   own siblings to the outer ones and so proves, and folds, every node in it.

No task holds more than a superblock and some dozens of outer nodes; a
group of any size is many superblocks.

A digest is SHA-256 of the inputs' texts concatenated, in lower-case hex.

Defined cases: a null column counts as "-", an empty one as length 0; rows without group come
first as a group of their own; rows without key come first in their group; rows that
repeat a key are ordered by their digest, and rows alike in all have equal results up to their
neighbours'; the last run of a level may be short, down to one node, which is digested all the same; a group of one
leaf is its own top; without any other node the proof is the digest of nothing; an empty table gives an empty result; columns that
are not named as leaf columns are not looked at and may have any name.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from fiscalframe.llm.common import kept

FANOUT = 8
LEVELS = 3  # of a superblock
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(texts: list[str]) -> str:
    return sha256("".join(texts).encode()).hexdigest()


def leaf(*columns: Column) -> Column:
    """Digest of a row's columns: each as its length in bytes, a colon and its value, or "-" if it is null."""
    texts = [c.cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


# --- local trees -------------------------------------------------------------


def levels_of(nodes: int, fanout: int = FANOUT) -> int:
    """Levels above so many nodes until one is left."""
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // fanout), levels + 1
    return levels


def reduced(nodes: list[str], levels: int, fanout: int = FANOUT) -> list[list[str]]:
    """The nodes and every level above them."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        out.append([digest(below[k : k + fanout]) for k in range(0, len(below), fanout)])
    return out


def siblings(levels: list[list[str]], place: int, fanout: int = FANOUT) -> list[tuple[str, str]]:
    """Level by level, what stands left and right of the node at a place in its run, each as one text."""
    out = []
    for nodes in levels[:-1]:
        start = place // fanout * fanout
        out.append(("".join(nodes[start:place]), "".join(nodes[place + 1 : start + fanout])))
        place //= fanout
    return out


def fold(node: str, proof: list[tuple[str, str]]) -> str:
    """The top that a node and its siblings give."""
    for left, right in proof:
        node = digest([left, node, right])
    return node


def proof_digest(proof: list[tuple[str, str]]) -> str:
    return digest([text for pair in proof for text in pair])


# --- distributed trees -------------------------------------------------------


def numbered(rows: DataFrame, group: str, *order: Column) -> DataFrame:
    """Adds place (from 0, in the given order) and nodes (their number) within each group.

    Rows alike in all are told apart by where they lie, so that a range never has to take all of them.
    """
    by = [F.col(group).asc_nulls_first(), *order]
    ranged = rows.withColumn("lies", F.monotonically_increasing_id()).repartitionByRange(*by, "lies").sortWithinPartitions(*by)
    # Kept, since a second run might cut other ranges; a kept partition keeps its order.
    ranged = kept(ranged.drop("lies")).select("*", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("at"))
    # One row for each range and group in it.
    held = ranged.groupBy(group, "range").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("held"))
    within = Window.partitionBy(group)
    before = F.coalesce(F.sum("held").over(within.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = held.select(F.col(group).alias("held_of"), F.col("range").alias("held_in"), "first", before.alias("before"), F.sum("held").over(within).alias("nodes"))
    same = (F.col("range") == F.col("held_in")) & F.col(group).eqNullSafe(F.col("held_of"))
    joined = ranged.join(starts, same)
    return joined.select(*rows.columns, (F.col("before") + F.col("at") - F.col("first")).alias("place"), "nodes")


def _blocks(nodes: DataFrame, size: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("place") / size))


def _next_tier(nodes: DataFrame, levels: int, fanout: int) -> DataFrame:
    """(of, place, nodes, node): each superblock of nodes as one."""
    size = fanout**levels
    of = nodes.schema["of"].dataType.simpleString()

    def top(block: pd.DataFrame) -> pd.DataFrame:
        first = block.iloc[0]
        up = min(levels, levels_of(int(first.nodes), fanout))
        node = reduced(block.sort_values("place").node.tolist(), up, fanout)[-1][0]
        return pd.DataFrame({"of": [first.of], "place": [first.block], "nodes": [-(-int(first.nodes) // size)], "node": [node]})

    blocks = _blocks(nodes.select("of", "place", "nodes", "node"), size)
    return blocks.groupBy("of", "block").applyInPandas(top, f"of {of}, place long, nodes long, node string")


def _proved(nodes: DataFrame, outer: DataFrame, levels: int, fanout: int, extra: str, finish: Callable[[pd.DataFrame, list, list], dict]) -> DataFrame:
    """Cogroups the nodes (of, place, nodes, node, ...) with the outer nodes (of, place of the block, sides) of their superblock.

    finish makes columns of a block's rows from their proofs, each a list of (left, right) up to the root, and from what is above.
    """
    of = nodes.schema["of"].dataType.simpleString()

    def proved(block: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("place", ignore_index=True)
        up = min(levels, levels_of(int(block.nodes[0]), fanout)) if len(block) else 0
        tree = reduced(block.node.tolist(), up, fanout)
        rest = [tuple(side) for side in above.sides[0]]
        proofs = [siblings(tree, k, fanout) + rest for k in range(len(block))]
        return pd.DataFrame({"of": block.of, **finish(block, proofs, above)})

    # Null groups find each other by a key of their own.
    known, key = F.col("of").isNotNull().alias("known"), F.coalesce("of", F.lit("")).alias("named")
    left = _blocks(nodes, fanout**levels).select("*", known, key).groupBy("known", "named", "block")
    right = outer.select(F.col("place").alias("block"), *[c for c in outer.columns if c not in ("of", "place")], known, key).groupBy("known", "named", "block")
    return left.cogroup(right).applyInPandas(proved, f"of {of}, {extra}")


SIDES = "array<array<string>>"


def _sides(block: pd.DataFrame, proofs: list, above: pd.DataFrame) -> dict:
    """Of nodes that are tops of superblocks below: what their blocks need."""
    return {"place": block.place, "sides": [[list(side) for side in p] for p in proofs]} | {c: above[c][0] for c in ("subroot", "root") if c in above}


def _tree(nodes: DataFrame, levels: int, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """The tiers of nodes (of, place, nodes, node) below the last, and the last: one row for each group."""
    most = nodes.agg(F.max("nodes")).first()[0] or 0
    tiers = []
    while most > 1:
        tiers.append(nodes)
        nodes, most = kept(_next_tier(nodes, levels, fanout)), -(-most // fanout**levels)
    return tiers, nodes


def manifest(leaves: DataFrame, group: str, order: list[str], carried: list[str], levels: int = LEVELS, fanout: int = FANOUT, proofs: bool = False) -> DataFrame:
    """Proves rows (leaf, claimed, group, carried columns): what each folds to with its proof.

    leaf is the digest that makes the tree, claimed the one to be verified.
    Gives the carried columns, leaf, subroot (the group's top), root,
    proof_sha256, folded_root (of claimed and the proof), verified; with proofs also proof, an array of
    [left, right] digests, each side as one text.
    """
    rows = leaves.select(
        F.col(group).cast("string").alias("of"), F.struct(*[F.col(c) for c in carried]).alias("carried"), F.struct(*[F.col(c) for c in order]).alias("key"),
        F.unhex("leaf").alias("leaf"), F.when(F.col("claimed") != F.col("leaf"), F.unhex("claimed")).alias("claimed"),
    )
    placed = kept(numbered(rows, "of", F.col("key"), F.col("leaf")))
    leaf_nodes = placed.select("of", "place", "nodes", F.lower(F.hex("leaf")).alias("node"), "carried", F.lower(F.hex("claimed")).alias("claimed"))
    tiers, tops = _tree(leaf_nodes, levels, fanout)

    # The tops of all groups, in order of the group, are one tree.
    subroots = numbered(tops.select(F.lit("all").alias("of"), F.col("of").alias("top_of"), "node"), "of", F.col("top_of").asc_nulls_first())
    subroots = kept(subroots)
    upper, root = _tree(subroots, levels, fanout)
    above = root.select("of", "place", F.array().cast(SIDES).alias("sides"), F.col("node").alias("root"))
    for tier in reversed(upper[1:]):
        above = kept(_proved(tier, above, levels, fanout, f"place long, sides {SIDES}, root string", _sides))

    def of_group(block: pd.DataFrame, found: list, above: pd.DataFrame) -> dict:
        return {"top_of": block.top_of, "subroot": block.node} | _sides(block, found, above)

    proved = _proved(subroots, above, levels, fanout, f"top_of string, subroot string, place long, sides {SIDES}, root string", of_group)
    above = kept(proved.select(F.col("top_of").alias("of"), F.lit(0).cast("long").alias("place"), "sides", "subroot", "root"))
    for tier in reversed(tiers[1:]):
        above = kept(_proved(tier, above, levels, fanout, f"place long, sides {SIDES}, subroot string, root string", _sides))

    def of_leaf(block: pd.DataFrame, found: list, above: pd.DataFrame) -> dict:
        claimed = block.claimed.where(block.claimed.notna(), block.node)
        out = {"carried": block.carried, "leaf": block.node, "subroot": above.subroot[0], "root": above.root[0]}
        out |= {"proof_sha256": [proof_digest(p) for p in found], "folded_root": [fold(c, p) for c, p in zip(claimed, found, strict=True)]}
        return out | ({"proof": [[list(side) for side in p] for p in found]} if proofs else {})

    kinds = f"carried {rows.schema['carried'].dataType.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string" + f", proof {SIDES}" * proofs
    found = _proved(leaf_nodes, above, levels, fanout, kinds, of_leaf)
    return found.select("carried.*", *found.columns[2:], (F.col("folded_root") == F.col("root")).alias("verified"))
