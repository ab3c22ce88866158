"""Near-duplicates by SimHash with deletion-variant signatures.

A fingerprint is cut into two halves.  Of two fingerprints that differ in at
most two bits, one half differs in at most one, so with that bit made a wildcard
the halves are equal: each half is indexed under its 32 one-wildcard variants,
an equality join finds the partners, and all 64 bits verify them.  Buckets that
many fingerprints share are cut once more the same way, by the halves of the
half that the bucket leaves free, then by the quarters; after that a bucket
cannot hold more than 2,048 fingerprints.  So no bucket is capped and none
is compared pair by pair beyond a fixed size.  Equal fingerprints are one node throughout.

Defined cases: null and empty texts have fingerprint zero, which links like any
other; texts of one or two words have that one shingle; shingles count as often as they occur;
rows with null ids get a component, which takes the least id that is not null; rows may repeat;
an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh64_intdigest

from fiscalframe.llm.common import kept, slices
from fiscalframe.llm.components import components

SHINGLE = 3
DISTANCE = 2  # the cut into halves is made for this
SEED = 42
BUCKET = 512  # fingerprints compared pair by pair


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """A hash of each shingle, in order."""
    words = text.encode().lower().split() if text else []  # bytes: A-Z only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda at, n: at + 1 + n))
    starts = [0, *[e + 1 for e in ends]]
    size = min(size, len(words))
    return np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :])], np.uint64)  # noqa: B905


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """64 bits, each set if it is in more than half of the shingles' hashes."""
    hashes = shingle_hashes(text, size)
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64)
    most = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(most, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) per row; fp holds the 64 bits as a signed long."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = np.array([fingerprint(t) for t in part.column("text").to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(found)], names=["id", "fp"])

    return rows.mapInArrow(printed, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def _variants(members: DataFrame, level: int) -> DataFrame:
    """(key, fp, free): a row for each half of the free bits and each wildcard in it.

    free is the first of the bits that the key leaves free: all 64 before level
    0, and half as many after each level.  Keys hold those of the levels before.
    """
    width = 32 >> level
    rows = members.select("*", F.explode(F.sequence(F.lit(0), F.lit(2 * width - 1))).alias("k"))
    upper = F.expr(f"cast(k div {width} as int)")
    half = F.expr(f"shiftrightunsigned(fp, cast(free + (k div {width}) * {width} as int)) & {(1 << width) - 1}L")
    masked = half.bitwiseAND(F.expr(f"~shiftleft(1L, k % {width})"))
    before = [F.col(f"key.{c}") for c in members.schema["key"].dataType.names] if level else []
    key = F.struct(*before, F.col("k").alias(f"k{level}"), masked.alias(f"v{level}"))
    # The half that the key is not made of stays free.
    return rows.select(key.alias("key"), "fp", (F.col("free") + (1 - upper) * width).alias("free"))


def _verified(members: DataFrame) -> DataFrame:
    """Links within buckets (key, fp) of bounded size."""
    buckets = members.groupBy("key").agg(F.collect_list("fp").alias("fps")).select("fps")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("fps")
            values, offsets = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()
            offsets = offsets - offsets[0]
            sizes = np.diff(offsets)
            found = []
            for n in np.unique(sizes[sizes > 1]):
                rows = np.flatnonzero(sizes == n)
                step = max(1, (1 << 21) // int(n * n))
                left, right = np.triu_indices(n, 1)
                for some in (rows[i : i + step] for i in range(0, len(rows), step)):
                    block = values[offsets[some][:, None] + np.arange(n)]
                    a, b = block[:, left], block[:, right]
                    near = np.bitwise_count(a ^ b) <= DISTANCE
                    found.append(np.stack([a[near], b[near]]))
            if found:
                pairs = np.unique(np.concatenate(found, axis=1), axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    return buckets.mapInArrow(linked, "a long, b long")


def links(nodes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Pairs (a, b) of different fingerprints among nodes (fp, distinct) that differ in at most two bits.  Pairs may repeat."""
    members = nodes.select(F.lit(None).alias("key"), "fp", F.lit(0).alias("free"))
    found = None
    for level in range(3):
        variants = _variants(members, level)
        shared = kept(variants.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
        in_shared = variants.join(shared, "key")
        last = level == 2 or shared.filter(F.col("n") > bucket).isEmpty()
        few = _verified(in_shared if last else in_shared.filter(F.col("n") <= bucket))
        found = few if found is None else found.union(few)
        if last:
            return found
        members = in_shared.filter(F.col("n") > bucket).select("key", "fp", "free")


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """One row per row of docs: id_col, fingerprint (16 hex digits), component_id (least id of its component)."""
    prints = kept(fingerprints(docs, id_col, text_col))
    nodes = kept(prints.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(links(nodes.select("fp"), bucket))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
