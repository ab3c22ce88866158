"""Vector codes: product quantisation in integers, searched in the Walsh-Hadamard domain.

Components become integers (floor of 4096 x), vectors are cut into 8 parts, and
each part is coded by the nearest of 16 codebook entries.  Rounds of assignment and
averaging train the codebooks.

Assignment transforms parts and entries, padded with zeros to a power of two n, by the
Walsh-Hadamard transform.  The squared differences of the coefficients add up to n times
those of the components, and low sequencies hold most of the energy.  So they are added up
in sequency order: the entry ahead after the first coefficients is measured in full, and
every entry whose sum so far exceeds that goes, step by step, with no more of its
coefficients looked at.  Everything is an integer: 64 bits where no sum can
exceed them, else Python's, with the same results.

A round is one pass over the table.  Tasks add up their rows by part and entry; what is
summed over tasks and comes to the driver is one row per part and entry (128).  Vectors are never
moved: sorting, if any, is for the first 16 ids.

Defined cases: rows whose vector is null or holds a null, NaN or infinite component are dropped;
shorter vectors are taken as filled up with zeros to the length of the longest, and that to
a multiple of 8; of fewer than 16 vectors each is an entry; null ids come last among the first entries,
repeated ids each count, in order of their vectors; a null label is a label; an error beyond a long is given as the
greatest long; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fiscalframe.llm.common import kept

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
CHUNK = 4096  # parts compared at a time
LONGEST = (1 << 63) - 1


# --- the transform -----------------------------------------------------------


def sequency_order(n: int) -> np.ndarray:
    """Places of the naturally ordered coefficients of n (a power of two) by number of sign changes."""
    rows = np.ones((1, 1), np.int64)
    while len(rows) < n:
        rows = np.block([[rows, rows], [rows, -rows]])
    return np.argsort((np.diff(rows, axis=1) != 0).sum(axis=1), kind="stable")


def transform(parts: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row, padded to a power of two, in sequency order."""
    rows, width = parts.shape
    n = 1 << max(0, width - 1).bit_length()
    out = np.zeros((rows, n), parts.dtype)
    out[:, :width] = parts
    half = 1
    while half < n:
        pairs = out.reshape(rows, n // (2 * half), 2, half)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(rows, n)
        half *= 2
    return out[:, sequency_order(n)]


def exact_type(*arrays: np.ndarray) -> type:
    """int64 if no sum of squared differences of the arrays' transforms can exceed it, else object (Python's integers)."""
    n = 1 << max(0, arrays[0].shape[1] - 1).bit_length()
    most = max((max(abs(int(a.max())), abs(int(a.min()))) for a in arrays if a.size), default=0)
    # A coefficient is at most n times the largest component.
    return np.int64 if n * (2 * n * most) ** 2 < 1 << 62 else object


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each part the index of its nearest entry, the lowest of several, and its squared distance."""
    kind = exact_type(parts, entries)
    books = transform(entries.astype(kind))
    n = books.shape[1]
    found = [_nearest(transform(parts[k : k + CHUNK].astype(kind)), books) for k in range(0, len(parts), CHUNK)]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]) // n


def _squares(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    difference = left - right
    return (difference * difference).sum(axis=-1)


def _nearest(rows: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance, n-fold, in the transformed domain."""
    n = rows.shape[1]
    step = max(1, n // 4)
    so_far = _squares(rows[:, None, :step], books[None, :, :step])
    ahead = so_far.argmin(axis=1)
    bound = _squares(rows, books[ahead])
    of, entry = np.nonzero(so_far <= bound[:, None])
    sums = so_far[of, entry]
    for k in range(step, n, step):
        sums = sums + _squares(rows[of, k : k + step], books[entry, k : k + step])
        left = np.nonzero(sums <= bound[of])[0]
        of, entry, sums = of[left], entry[left], sums[left]
    # The entry ahead is left in every row, so each row has a first one.
    first = np.flatnonzero(np.diff(of, prepend=-1))
    least = np.minimum.reduceat(sums, first)
    best = np.flatnonzero(sums == least[of])
    best = best[np.flatnonzero(np.diff(of[best], prepend=-1))]
    return entry[best], least


# --- vectors as integers -----------------------------------------------------


def _scaled(x: float) -> int:
    return floor(x * SCALE) if abs(x) < 2.0**53 else int(x) * SCALE


def integers(column: pa.Array, width: int) -> np.ndarray:
    """A row of so many integers for each vector; the vectors hold finite numbers only."""
    values, offsets = column.values.to_numpy(zero_copy_only=False).astype(np.float64), column.offsets.to_numpy()
    own = values[offsets[0] : offsets[-1]]
    small = not len(own) or np.abs(own).max() < 2.0**50
    out = np.zeros((len(column), width), np.int64 if small else object)
    sizes = np.diff(offsets)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        block = values[offsets[rows][:, None] + np.arange(size)]
        out[rows, :size] = np.floor(block * SCALE).astype(np.int64) if small else np.array([[_scaled(x) for x in row] for row in block.tolist()], object).reshape(block.shape)
    return out


def _finite(vector: Column) -> Column:
    """True for a vector of finite numbers."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


# --- codebooks ---------------------------------------------------------------


@dataclass(frozen=True)
class Codebooks:
    """For each part its entries, each a tuple of integers."""

    parts: tuple[tuple[tuple[int, ...], ...], ...]

    @property
    def width(self) -> int:
        """Length of a vector."""
        return sum(len(p[0]) for p in self.parts) if self.parts[0] else 0

    def arrays(self) -> list[np.ndarray]:
        """The entries of each part, as 64-bit integers where they fit."""
        most = max((abs(x) for part in self.parts for entry in part for x in entry), default=0)
        return [np.array(part, np.int64 if most < 1 << 62 else object) for part in self.parts]

    def sha256(self) -> str:
        return sha256(",".join(str(x) for part in self.parts for entry in part for x in entry).encode()).hexdigest()


def _cut(vectors: np.ndarray, parts: int) -> list[np.ndarray]:
    length = vectors.shape[1] // parts
    return [vectors[:, p * length : (p + 1) * length] for p in range(parts)]


def _assigned(vectors: np.ndarray, books: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(entries, distances) of the rows for each part."""
    return [nearest(part, entries) for part, entries in zip(_cut(vectors, len(books)), books, strict=True)]


def _averaged(rows: DataFrame, books: Codebooks) -> Codebooks:
    """One round: every entry becomes the floor of the mean of its parts; unused ones stay."""
    width, arrays = books.width, books.arrays()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], tuple[int, np.ndarray]] = {}
        for batch in batches:
            vectors = integers(batch.column("vector"), width)
            for p, (part, (entry, _)) in enumerate(zip(_cut(vectors, len(arrays)), _assigned(vectors, arrays), strict=True)):
                for e in np.unique(entry).tolist():
                    mine = part[entry == e].astype(object if exact_type(part) is object else np.int64)
                    count, total = totals.get((p, e), (0, 0))
                    totals[p, e] = count + len(mine), total + mine.sum(axis=0).astype(object)
        kinds = {"part": pa.int32(), "entry": pa.int32(), "count": pa.int64(), "total": pa.list_(pa.string())}
        found = [(p, e, count, [str(x) for x in total]) for (p, e), (count, total) in totals.items()]
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds.values())], names=list(kinds))

    def added(group: pa.Table) -> pa.Table:
        totals = group.column("total").to_pylist()
        whole = [str(sum(map(int, column))) for column in zip(*totals, strict=True)]
        return pa.table({"part": group.column("part")[:1], "entry": group.column("entry")[:1], "count": pa.array([sum(group.column("count").to_pylist())]), "total": pa.array([whole], pa.list_(pa.string()))})

    schema = "part int, entry int, count long, total array<string>"
    sums = rows.select("vector").mapInArrow(partial, schema).groupBy("part", "entry").applyInArrow(added, schema)
    # One row for each part and entry.
    used = {(r.part, r["entry"]): tuple(int(x) // r["count"] for x in r.total) for r in sums.collect()}
    return Codebooks(tuple(tuple(used.get((p, e), old) for e, old in enumerate(part)) for p, part in enumerate(books.parts)))


def fit(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks trained on all vectors, from those of the smallest ids; None if there is no vector."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).filter(_finite(F.col("vector")))
    longest = rows.agg(F.max(F.size("vector"))).first()[0]
    if longest is None:
        return None
    length = max(1, -(-longest // parts))
    first = rows.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()
    whole = [[_scaled(x) for x in r.vector] + [0] * (length * parts - len(r.vector)) for r in first]
    books = Codebooks(tuple(tuple(tuple(v[p * length : (p + 1) * length]) for v in whole) for p in range(parts)))
    for _ in range(rounds):
        books = _averaged(rows, books)
    return books


def encode(vectors: DataFrame, books: Codebooks, id_col: str = "vec_id", vector_col: str = "embedding", carried: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, carried columns, code, error) of every vector: an entry of two hex digits for each part, and the squared distance."""
    carried_row = F.struct(F.col(id_col), *[F.col(c) for c in carried])
    rows = vectors.select(carried_row.alias("carried"), F.col(vector_col).alias("vector")).filter(_finite(F.col("vector")))
    width, arrays = books.width, books.arrays()

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _assigned(integers(batch.column("vector"), width), arrays)
            codes = ["".join(f"{e:02x}" for e in row) for row in zip(*[entry.tolist() for entry, _ in found], strict=True)]
            errors = [min(sum(row), LONGEST) for row in zip(*[distance.tolist() for _, distance in found], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("carried"), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], names=["carried", "code", "error"])

    out = rows.mapInArrow(coded, f"carried {rows.schema['carried'].dataType.simpleString()}, code string, error long")
    return out.select("carried.*", "code", "error")


def decode(codes: DataFrame, books: Codebooks, code_col: str = "code") -> DataFrame:
    """Adds vector, the integers that a code stands for."""
    entries = F.array(*[F.array(*[F.array(*[F.lit(x) for x in e]) for e in part]) for part in books.parts])
    place = F.sequence(F.lit(0), F.lit(len(books.parts) - 1))
    index = lambda p: F.conv(F.substring(F.col(code_col), 2 * p + 1, F.lit(2)), 16, 10).cast("int")
    return codes.withColumn("vector", F.flatten(F.transform(place, lambda p: F.get(F.get(entries, p), index(p)))))


def codes_and_errors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector that is not dropped: id_col, code, error, label_error (of its label's rows), codebooks_sha256."""
    books = fit(vectors, id_col, vector_col)
    if books is None:
        label = F.lit(None).cast("long")
        return vectors.limit(0).select(F.col(id_col), F.lit("").alias("code"), label.alias("error"), label.alias("label_error"), F.lit("").alias("codebooks_sha256"))
    renamed = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    # Kept, as it is read for the sums and for the rows.
    coded = kept(encode(renamed, books, "id", "vector", ("label",)))
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST).cast("decimal(38,0)")).cast("long")
    by_label = coded.groupBy(F.col("label").alias("of_label")).agg(total.alias("label_error"))
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("of_label")))
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
