"""Byte-level BPE by prefix dynamic programming.

A text is split into pieces by a pattern, and each piece is encoded by itself.
Within a piece every byte prefix has exactly one encoding, and that of a longer prefix
ends in the one token which is a suffix of it and may follow the encoding of what
is before.  So it suffices to store each prefix's last token: reading the table
backwards gives the tokens of any prefix.  Two tokens may stand side by side if
merging their bytes gives just these two; whole sequences are encodings if
all neighbours are.

The table makes appends exact and cheap (it is continued), and edits, too: prefixes before
the edit stay, and behind it the table is as before as soon as it agrees with
the old one over as many bytes as the longest token has, since nothing further back is looked at.

In Spark the vocabulary, of a size given by its file, goes to the tasks as a broadcast of
the file's bytes; each task makes its tables of it.  Rows are encoded where they are read
and nothing is shuffled.  ``encode`` gives the token ids, ``append`` and ``edit`` go on from an earlier result, ``decode`` back to bytes.

Defined cases: null and empty texts have no tokens; a piece that is a token as a whole is that token, as tiktoken has it;
very long texts are encoded whole (pieces of over 64 characters are not remembered);
rows may repeat; an empty table gives an empty result; other columns are not looked at, those
named as carried are kept, whatever their names.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterator
from itertools import islice
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from fiscalframe.llm.common import slices

REMEMBERED = 1 << 19  # pieces
REMEMBERED_PAIRS = 1 << 20  # of tokens
REMEMBERED_CHARS = 64  # of a piece
NONE = 0xFFFFFFFF
START = 1 << 31
AT_ONCE = 1 << 20  # characters whose pieces are looked up together
# A piece is settled if so many characters after its start, and one after its end, are known: "'re" needs three.
AHEAD = 3


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The tokens of a vocabulary file: per line a token in base 64 and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


class Encoder:
    """A vocabulary ready for use."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.longest = max(map(len, ranks))
        self.sizes = {rank: len(token) for token, rank in ranks.items()}
        try:
            self.single = [ranks[bytes([k])] for k in range(256)]
        except KeyError as missing:
            raise ValueError("the vocabulary does not encode every byte") from missing
        self.suffixes = ahocorasick.Automaton()
        for token, rank in ranks.items():
            if len(token) > 1:
                self.suffixes.add_word(token.decode("latin-1"), (len(token), rank))
        self.suffixes.make_automaton()
        self.formed: dict[int, list[tuple[int, bytes, bytes]]] = {}
        self.beside: dict[int, bool] = {}
        self.pieces: dict[str, bytes] = {}

    def merges(self, data: bytes) -> Iterator[tuple[int, list[bytes]]]:
        """Plain merging: the adjacent pair of least rank first, the leftmost of equal ones.  Each merge's rank, and the parts after it."""
        rank = self.ranks.get
        parts = [data[k : k + 1] for k in range(len(data))]
        pairs = [rank(a + b, NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs and (least := min(pairs)) != NONE:
            k = pairs.index(least)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del pairs[k]
            if k:
                pairs[k - 1] = rank(parts[k - 1] + parts[k], NONE)
            if k < len(pairs):
                pairs[k] = rank(parts[k] + parts[k + 1], NONE)
            yield least, parts

    def merged(self, data: bytes) -> list[int]:
        """The tokens that plain merging gives."""
        parts = [data[k : k + 1] for k in range(len(data))]
        for _, parts in self.merges(data):
            pass
        return [self.ranks[p] for p in parts]

    def formation(self, token: int) -> list[tuple[int, bytes, bytes]]:
        """(rank of the next merge, first part, last part) of a token's bytes before each merge and after the last; empty if merging does not give it."""
        known = self.formed.get(token)
        if known is None:
            data = self.tokens[token]
            states, ends = [], (data[:1], data[-1:])
            for rank, parts in self.merges(data):
                states.append((rank, *ends))
                ends = parts[0], parts[-1]
            known = self.formed[token] = [*states, (NONE, *ends)] if ends[0] == data else []
        return known

    def may_follow(self, before: int, token: int) -> bool:
        """Whether merging their bytes leaves a token behind another one, or alone (before NONE).

        Both form by themselves, in the order of their ranks, unless at some point their ends at the seam are
        the pair to be merged next.
        """
        if len(self.beside) >= REMEMBERED_PAIRS:
            self.beside.clear()
        right = self.formation(token)
        fits = bool(right)
        if before != NONE and fits:
            left = self.formation(before)
            fits, i, j, rank = bool(left), 0, 0, self.ranks.get
            while fits:
                (l_next, _, l_end), (r_next, r_end, _) = left[i], right[j]
                seam = rank(l_end + r_end, NONE)
                # Of equal ranks the leftmost is first.
                if seam != NONE and seam < l_next and seam <= r_next:
                    fits = False
                elif l_next == r_next == NONE:
                    break
                elif l_next <= r_next:
                    i += 1
                else:
                    j += 1
        self.beside[before << 32 | token] = fits
        return fits

    def extend(self, data: bytes, last: list[int]) -> None:
        """Continues the table of the last tokens, of the first len(last) prefixes of data, to all of them.

        The search for tokens begins as far back as one can reach.
        """
        size, beside, single = len(last), self.beside.get, self.single
        start = max(0, size - self.longest + 1)
        for end, (length, token) in self.suffixes.iter(data[start:].decode("latin-1")):
            at = start + end
            while size < at:  # where none of the longer tokens fits
                last.append(single[data[size]])
                size += 1
            # One token fits at each place; other tokens that end there, or in the known part, are passed over.
            if size == at:
                before = last[at - length] if at >= length else NONE
                fits = beside(before << 32 | token)
                if fits or fits is None and self.may_follow(before, token):
                    last.append(token)
                    size += 1
        last += [single[byte] for byte in data[size:]]

    def table(self, data: bytes) -> list[int]:
        """For every prefix of a piece but the empty one its last token."""
        last: list[int] = []
        self.extend(data, last)
        return last

    def read(self, data: bytes, last: list[int]) -> list[int]:
        """The tokens of a piece."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        at, out = len(last), []
        while at:
            out.append(last[at - 1])
            at -= self.sizes[last[at - 1]]
        return out[::-1]

    # --- texts ---

    def learn(self, pieces: set[str]) -> None:
        """Encodes pieces that are not known yet."""
        for piece in pieces:
            data = piece.encode()
            ids = self.read(data, self.table(data))
            self.pieces[piece] = pack(f"<{len(ids)}I", *ids)

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of texts as little-endian unsigned 32-bit integers; all their pieces are held at once."""
        cut = [self.pattern.findall(text) if text else [] for text in texts]
        return self._joined(cut)

    def _joined(self, cut: list[list[str]]) -> list[bytes]:
        unknown = {piece for piece in set().union(*cut) if piece not in self.pieces}
        if len(self.pieces) + len(unknown) > REMEMBERED:
            self.pieces.clear()
            unknown = set().union(*cut)
        self.learn(unknown)
        out = [b"".join(map(self.pieces.__getitem__, pieces)) for pieces in cut]
        for piece in unknown:
            if len(piece) > REMEMBERED_CHARS:
                del self.pieces[piece]
        return out

    def encode(self, text: str | None) -> bytes:
        """The ids of a text, however long."""
        if not text or len(text) <= AT_ONCE:
            return self.encode_all([text])[0]
        found, out = self.pattern.finditer(text), []
        while pieces := [m.group() for m in islice(found, AT_ONCE // 8)]:
            out += self._joined([pieces])
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    # --- stored tables: of each byte the last token of its piece up to there, a piece's first byte marked ---

    def text_table(self, text: str | None) -> array:
        out = array("I")
        for piece in self.pattern.findall(text or ""):
            out += _marked(self.table(piece.encode()))
        return out

    def ids(self, text: str, table: array) -> bytes:
        """The ids that a stored table tells."""
        data, marks = text.encode(), np.flatnonzero(np.frombuffer(table, "u4") & START).tolist()
        ends = [*marks[1:], len(table)][: len(marks)]
        return np.array([t for a, b in zip(marks, ends, strict=True) for t in self.read(data[a:b], _plain(table[a:b]))], "<u4").tobytes()

    def settled(self, text: str) -> int:
        """Characters at the start that are cut into the same pieces whatever follows the text."""
        end = 0
        for found in self.pattern.finditer(text):
            if max(found.end() + 1, found.start() + AHEAD) > len(text):
                break
            end = found.end()
        return end

    def replaced(self, text: str, table: array, start: int, end: int, by: str) -> tuple[str, array, int]:
        """(text, table, bytes computed anew) after text[start:end] is replaced; an append if start is the end.

        Pieces before the edit stay, of the piece it falls in the prefixes before it, and what is behind
        stays from the first place on where pieces, or within a piece last tokens, are as before.
        """
        new, shift = text[:start] + by + text[end:], len(by) - (end - start)
        keep = self.settled(text[:start])
        at = len(text[:keep].encode())  # in the old bytes
        tail = text[keep:].encode()
        marks = np.append(np.flatnonzero(np.frombuffer(table, "u4")[at:] & START), len(tail))
        out, computed = table[:at], 0
        for found in self.pattern.finditer(new, pos=keep):
            data = found.group().encode()
            if len(out) == at and len(marks) > 1:
                # The piece that begins where an old one did.
                size = int(marks[1])
                last, fresh = self._again(tail[:size], _plain(table[at : at + size]), data)
            else:
                last, fresh = self.table(data), len(data)
            out += _marked(last)
            computed += fresh
            old = found.end() - shift - keep  # where the old text had what follows, in characters
            if found.end() >= start + len(by) and old >= 0:
                behind = len(text[keep : keep + old].encode())
                if behind in marks:
                    return new, out + table[at + behind :], computed
        return new, out, computed

    def _again(self, old: bytes, last: list[int], new: bytes) -> tuple[list[int], int]:
        """(table, prefixes computed) of a piece, from another one and its table, of which it may share both ends."""
        head = next((k for k, (a, b) in enumerate(zip(old, new, strict=False)) if a != b), min(len(old), len(new)))
        most = min(len(old), len(new)) - head
        tail = next((k for k in range(most) if old[-1 - k] != new[-1 - k]), most)
        table, shift, same, at = last[:head], len(new) - len(old), 0, head
        while at < len(new):
            self.extend(new[: at + 2 * self.longest], table)
            while at < len(table):
                # Prefixes whose last token lies in the common end.
                same = same + 1 if at >= len(new) - tail + self.longest and table[at] == last[at - shift] else 0
                at += 1
                if same == self.longest:
                    return table[:at] + last[at - shift :], at - head
        return table, at - head


def _marked(last: list[int]) -> array:
    out = array("I", last)
    out[0] |= START
    return out


def _plain(last: array) -> list[int]:
    out = last.tolist()
    out[0] &= START - 1
    return out


# --- tables of rows ----------------------------------------------------------


class Vocabulary:
    """A vocabulary file for use in tasks.  It is read by the driver and sent to each executor once; it is some megabytes at most."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        with open(path, "rb") as file:
            self.data: Broadcast = spark.sparkContext.broadcast(file.read())
        self.pattern = pattern

    def encoder(self) -> Encoder:
        return Encoder(read_ranks(self.data.value), self.pattern)


def _by_slices(rows: DataFrame, vocabulary: Vocabulary, sized_by: str, kinds: dict[str, tuple[str, pa.DataType]], made: Callable[..., list[tuple]]) -> DataFrame:
    """The column "carried" of rows, and columns that made makes of an encoder and the lists of the other columns of some rows."""
    names = [c for c in rows.columns if c != "carried"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = vocabulary.encoder()
        for batch in batches:
            for part in slices(batch, sized_by, AT_ONCE):
                found = made(encoder, *[part.column(n).to_pylist() for n in names])
                columns = [pa.array([f[i] for f in found], kind) for i, (_, kind) in enumerate(kinds.values())]
                yield pa.RecordBatch.from_arrays([part.column("carried"), *columns], names=["carried", *kinds])

    schema = f"carried {rows.schema['carried'].dataType.simpleString()}, " + ", ".join(f"{n} {ddl}" for n, (ddl, _) in kinds.items())
    return rows.mapInArrow(each, schema).select("carried.*", *kinds)


def _rowwise(rows: DataFrame, vocabulary: Vocabulary, sized_by: str, kinds: dict[str, tuple[str, pa.DataType]], made: Callable[..., tuple]) -> DataFrame:
    """As _by_slices, row by row."""
    return _by_slices(rows, vocabulary, sized_by, kinds, lambda encoder, *columns: [made(encoder, *row) for row in zip(*columns, strict=True)])


def _carried(columns: tuple[str, ...]):
    return F.struct(*[F.col(c) for c in columns]).alias("carried")


BYTES = ("binary", pa.binary())


def encode(docs: DataFrame, vocabulary: Vocabulary, carried: tuple[str, ...] = ("doc_id",), text_col: str = "text", tables: bool = False) -> DataFrame:
    """The carried columns and ids (four bytes a token, little-endian); with tables also table, from which append and edit go on."""
    rows = docs.select(_carried(carried), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if not tables:

        def several(encoder: Encoder, texts: list[str]) -> list[tuple]:
            encoded = encoder.encode_all(texts) if len(texts) > 1 else map(encoder.encode, texts)
            return [(ids,) for ids in encoded]

        return _by_slices(rows, vocabulary, "text", {"ids": BYTES}, several)

    def made(encoder: Encoder, text: str) -> tuple[bytes, bytes]:
        table = encoder.text_table(text)
        return encoder.ids(text, table), table.tobytes()

    return _rowwise(rows, vocabulary, "text", {"ids": BYTES, "table": BYTES}, made)


def edit(encoded: DataFrame, vocabulary: Vocabulary, start: str, end: str, by: str, carried: tuple[str, ...] = ("doc_id",), text_col: str = "text", table_col: str = "table") -> DataFrame:
    """Replaces the characters from start to end (columns; both clipped to the text, null start: its end, null end: start) of each text.

    Gives the carried columns, text, ids, table and computed, the number of bytes whose token was looked for.
    """
    rows = encoded.select(_carried(carried), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(table_col), F.lit(b"")).alias("table"),
        F.col(start).cast("long").alias("start"), F.col(end).cast("long").alias("end"), F.coalesce(F.col(by), F.lit("")).alias("by"))

    def made(encoder: Encoder, text: str, table: bytes, start: int | None, end: int | None, by: str) -> tuple[str, bytes, bytes, int]:
        start = len(text) if start is None else min(max(start, 0), len(text))
        end = start if end is None else min(max(end, start), len(text))
        old = array("I")
        old.frombytes(table)
        new, after, computed = encoder.replaced(text, old, start, end, by)
        return new, encoder.ids(new, after), after.tobytes(), computed

    return _rowwise(rows, vocabulary, "table", {"text": ("string", pa.string()), "ids": BYTES, "table": BYTES, "computed": ("long", pa.int64())}, made)


def append(encoded: DataFrame, vocabulary: Vocabulary, more: str, carried: tuple[str, ...] = ("doc_id",), text_col: str = "text", table_col: str = "table") -> DataFrame:
    """Adds the text of column more to the end of each text; see edit."""
    end = encoded.withColumns({"append_at": F.lit(None).cast("long"), "append_to": F.lit(None).cast("long")})
    return edit(end, vocabulary, "append_at", "append_to", more, carried, text_col, table_col)


def decode(encoded: DataFrame, vocabulary: Vocabulary, carried: tuple[str, ...] = ("doc_id",), ids_col: str = "ids") -> DataFrame:
    """The carried columns and decoded, the bytes that ids stand for."""
    rows = encoded.select(_carried(carried), F.coalesce(F.col(ids_col), F.lit(b"")).alias("ids"))
    return _rowwise(rows, vocabulary, "ids", {"decoded": BYTES}, lambda encoder, ids: (encoder.decode(ids),))
