"""Removal of repeated passages by relative Lempel-Ziv parsing.

The reference is the corpus itself, indexed block by block: a block is a window
of 20 words, and the index tells where its words start first.  A document is
parsed greedily against all of it: from a word on, a factor is extended for as long as
the next block is still found at an earlier place; since every start inside a
factor is looked up as well, passages that run across the boundary of two
factors are found, too.  The words of factors are removed.

Not every block is worth indexing.  Each window has an anchor, the six words in it
of least hash, which equal windows share; only windows whose anchor occurs more
than once can repeat.  So the steps are

1. texts that equal an earlier text are one factor each and need no index,
2. anchors that occur once are told to their document,
3. windows with other anchors are indexed: hash of the 20 words to first place,
4. first places are told to their document; its other indexed windows have an earlier one.

Nothing is grouped by a frequent passage but with map-side aggregation, and what
a document is told is bounded by its own length.  Texts are shuffled once, by id; the
joins share that exchange.  Windows are compared by 128 bits of hash.

Defined cases: null and empty texts have no words; texts under 20 words stay;
of texts that are equal only the one of the least id stays; null ids count as
greatest; rows that repeat id and text are the same document and do not remove each other; of rows that share an id, or have
none, but not the text, the one of the lesser text hash is the earlier; an empty table gives an empty result;
other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh3_64_intdigest

from fiscalframe.llm.common import kept, slices, words
from fiscalframe.llm.merkle import numbered

WINDOW = 20
ANCHOR = 6
_FACTORS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD))


def _rolled(hashes: np.ndarray, size: int, factor: np.uint64) -> np.ndarray:
    """A hash of every run of so many words."""
    n = len(hashes) - size + 1
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * factor + hashes[k : k + n]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost least value in every run of so many."""
    n = len(values) - width + 1
    at = np.arange(len(values))
    span = 1
    # Runs of doubling length; the left half wins ties.
    while 2 * span <= width:
        left, right = at[: len(at) - span], at[span:]
        at = np.where(values[right] < values[left], right, left)
        span *= 2
    left, right = at[:n], at[width - span : width - span + n]
    return np.where(values[right] < values[left], right, left)


class Parsed:
    """The words of a text, and of every window its anchor."""

    def __init__(self, text: str | None):
        self.words = words(text)
        self.count = len(self.words)
        self.windows = max(0, self.count - WINDOW + 1)
        if self.windows:
            self.hashes = np.fromiter(map(xxh3_64_intdigest, self.words), np.uint64, self.count)
            self.grams = _rolled(self.hashes, ANCHOR, _FACTORS[0])
            self.anchor = _least(self.grams, WINDOW - ANCHOR + 1)

    def anchors(self) -> np.ndarray:
        return np.unique(self.anchor)

    def open_windows(self, unique) -> np.ndarray:
        """Starts of the windows whose anchor is none of the unique ones."""
        alone = np.zeros(len(self.grams), bool)
        if unique is not None:
            alone[unique] = True
        return np.flatnonzero(~alone[self.anchor])

    def window_hashes(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(starts):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        return _rolled(self.hashes, WINDOW, _FACTORS[1])[starts], _rolled(self.hashes, WINDOW, _FACTORS[2])[starts]


def _lists(column: pa.Array) -> Iterator[np.ndarray | None]:
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    missing = column.is_null().to_pylist()
    for i, none in enumerate(missing):
        yield None if none else values[offsets[i] : offsets[i + 1]]


def _rows(part: pa.RecordBatch, per_row: list[tuple], names: list[str]) -> pa.RecordBatch:
    """A batch of the id and several arrays for every row."""
    sizes = [len(x[0]) for x in per_row]
    ids = part.column("id").take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
    columns = [np.concatenate([x[i] for x in per_row]) if per_row else np.zeros(0) for i in range(len(names))]
    arrays = [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int32)) for c in columns]
    return pa.RecordBatch.from_arrays([ids, *arrays], names=["id", *names])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_words, n_removed, kept_text (words joined by one space), kept_sha256, factors.

    factors: start:length of the removed runs of words, comma-joined.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if rows.groupBy("id").count().filter("count > 1").isEmpty():
        return _parsed_rows(rows).withColumnRenamed("id", id_col)
    # Ids that do not tell documents apart are replaced by their documents' numbers, in the same order.
    rows = rows.withColumn("print", F.xxhash64("text"))
    documents = rows.select(F.lit("all").alias("all"), "id", "print").distinct()
    documents = kept(numbered(documents, "all", F.col("id").asc_nulls_last(), F.col("print")).select(F.col("id").alias("own_id"), F.col("print").alias("own_print"), "place"))
    same = F.col("id").eqNullSafe(F.col("own_id")) & (F.col("print") == F.col("own_print"))
    found = _parsed_rows(rows.join(documents, same).select(F.col("place").alias("id"), "text"))
    return found.join(documents, found["id"] == documents["place"]).select(F.col("own_id").alias(id_col), *found.columns[1:])


def _parsed_rows(rows: DataFrame) -> DataFrame:
    """The same for rows (id, text) whose ids are their documents'."""
    id_type = rows.schema["id"].dataType.simpleString()
    first_texts = rows.groupBy(F.unhex(F.sha2("text", 256))).agg(F.min("id").alias("id")).select("id").distinct().withColumn("is_first", F.lit(True))
    # Null ids find each other in the joins by a key of their own.
    key = F.struct(F.col("id").isNull(), F.coalesce("id", F.lit(0).cast(id_type)))
    rows, first_texts = rows.withColumn("key", key), first_texts.withColumn("key", key).drop("id")
    marked = rows.join(first_texts, "key", "left")
    firsts = marked.filter("is_first").drop("is_first")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = []
                for text in part.column("text").to_pylist():
                    parsed = Parsed(text)
                    at = parsed.anchors() if parsed.windows else np.zeros(0, np.int64)
                    found.append((parsed.grams[at] if parsed.windows else np.zeros(0, np.uint64), at))
                yield _rows(part, found, ["gram", "at"])

    grams = firsts.select("id", "text").mapInArrow(anchors, f"id {id_type}, gram long, at int")
    once = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"), F.min("at").alias("at")).filter("n = 1")
    unique = once.groupBy("id").agg(F.collect_list("at").alias("unique")).withColumn("key", key).drop("id")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = []
                for text, alone in zip(part.column("text").to_pylist(), _lists(part.column("unique")), strict=True):
                    parsed = Parsed(text)
                    starts = parsed.open_windows(alone) if parsed.windows else np.zeros(0, np.int64)
                    one, two = parsed.window_hashes(starts)
                    # Of windows that repeat within the document the first one stands for it.
                    first = np.unique(np.stack([one, two]), axis=1, return_index=True)[1] if len(starts) else starts
                    found.append((one[first], two[first], starts[first]))
                yield _rows(part, found, ["one", "two", "start"])

    indexed = firsts.join(unique, "key", "left").select("id", "text", "unique").mapInArrow(windows, f"id {id_type}, one long, two long, start int")
    index = indexed.groupBy("one", "two").agg(F.min("id").alias("id"), F.min_by("start", "id").alias("start"), F.min("start").alias("any_start"))
    places = index.select("id", F.coalesce("start", "any_start").alias("start"))
    earliest = places.groupBy("id").agg(F.collect_list("start").alias("earliest")).withColumn("key", key).drop("id")
    told = marked.join(unique, "key", "left").join(earliest, "key", "left").select("id", "text", "is_first", "unique", "earliest")

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts, are_first = part.column("text").to_pylist(), part.column("is_first").to_pylist()
                lists = _lists(part.column("unique")), _lists(part.column("earliest"))
                found = [_parse(*row) for row in zip(texts, are_first, *lists, strict=True)]
                kinds = {"n_words": pa.int64(), "n_removed": pa.int64(), "kept_text": pa.string(), "kept_sha256": pa.string(), "factors": pa.string()}
                columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds.values())]
                yield pa.RecordBatch.from_arrays([part.column("id"), *columns], names=["id", *kinds])

    out = told.mapInArrow(parsed, f"id {id_type}, n_words long, n_removed long, kept_text string, kept_sha256 string, factors string")
    return out


def factors(found: np.ndarray) -> list[tuple[int, int]]:
    """Greedy parse of the window starts (ascending) found in the reference: (first word, words) of each stretch of factors."""
    if not len(found):
        return []
    # A factor goes on while the next window is found; one that begins before the last one's end adds to its words.
    breaks = np.flatnonzero(np.diff(found) > WINDOW) + 1
    runs = np.split(found, breaks)
    return [(int(run[0]), int(run[-1] - run[0]) + WINDOW) for run in runs]


def _parse(text: str | None, is_first: bool | None, unique, earliest) -> tuple[int, int, str, str, str]:
    if not is_first:
        own = words(text)
        spans = [(0, len(own))] if len(own) >= WINDOW else []
    else:
        parsed = Parsed(text)
        own, found = parsed.words, np.zeros(0, np.int64)
        if parsed.windows:
            found = parsed.open_windows(unique)
            if earliest is not None and len(found):
                new = np.zeros(parsed.windows, bool)
                new[earliest] = True
                found = found[~new[found]]
        spans = factors(found)
    kept_words, at = [], 0
    for start, length in spans:
        kept_words += own[at:start]
        at = start + length
    joined = b" ".join([*kept_words, *own[at:]] if spans else own)
    removed = sum(n for _, n in spans)
    return len(own), removed, joined.decode(), sha256(joined).hexdigest(), ",".join(f"{a}:{n}" for a, n in spans)
