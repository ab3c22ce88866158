"""Format-preserving pseudonyms of personal data.

Values are found in whole texts, validated, and replaced by a keyed permutation
of the set of values of the same format, so that equal values become equal
pseudonyms in every document, different ones different pseudonyms, and who holds
the key can go back (``Pseudonyms(key, inverse=True)``).  The permutation is an
alternating Feistel network over the two halves of a mixed-radix number, with
keyed BLAKE2b as its round function.

Kinds, in order of precedence: email, iban (mod 97), ipv4 (octets up to 255),
card (13 to 19 digits, Luhn), date (a day of the years 1900 to 2099), ssn (US areas
and groups that exist), phone (international or North American, 7 to 15 digits).  Check digits are made anew, dates are moved to
another day, separators, letter case and lengths stay.  What fails validation is left as it is, but of
an iban or card that fails, shorter ends and later starts at its separators are tried, the longest first, so a
value is found beside other numbers and words.

Defined cases: a null text stays null, an empty one empty; texts without a
value stay as they are, byte for byte; values found by two kinds go to the first
one; rows may repeat; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

KINDS = ("email", "iban", "ipv4", "card", "date", "ssn", "phone")
ROUNDS = 10
FIRST_DAY, LAST_DAY = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()

_PATTERNS = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-])?@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])"),
    "ipv4": re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)", re.A),
    "card": re.compile(r"(?<![\w.])\d(?:[ -]?\d){12,18}(?!\w)", re.A),
    "date": re.compile(r"(?<![\w./-])(?:(?P<y>\d{4})(?P<s>[-/.])(?P<m>\d{1,2})(?P=s)(?P<d>\d{1,2})|(?P<d2>\d{1,2})(?P<s2>[-/.])(?P<m2>\d{1,2})(?P=s2)(?P<y2>\d{4}))(?![\w/-])", re.A),
    "ssn": re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", re.A),
    "phone": re.compile(r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?![\w-])", re.A),
}
_DIGIT = re.compile(r"\d", re.A)
# Kinds whose patterns take in what stands beside a value, and the separators between their groups.
_SEPARATORS = {"iban": " ", "card": " -"}


def luhn_digit(digits: str) -> int:
    """The digit that makes digits + digit valid."""
    doubled = [int(d) * 2 for d in digits[::-1][::2]]
    return -(sum(d - 9 * (d > 9) for d in doubled) + sum(map(int, digits[::-1][1::2]))) % 10


def _mod97(country: str, check: str, rest: str) -> int:
    return int("".join(str(int(c, 36)) for c in rest + country + check)) % 97


class Pseudonyms:
    def __init__(self, key: bytes, inverse: bool = False):
        if not key:
            raise ValueError("a key is needed")
        self.key, self.inverse = blake2b(key, digest_size=32).digest(), inverse
        self.swap = lru_cache(1 << 14)(self._swap)

    # --- the permutation ---

    def _round(self, tweak: str, r: int, half: int, size: int) -> int:
        said = f"{tweak}/{r}/{half}".encode()
        return int.from_bytes(blake2b(said, key=self.key, digest_size=32).digest()) % size

    def number(self, n: int, left: int, right: int, tweak: str) -> int:
        """A permutation of the numbers below left * right."""
        a, b = divmod(n, right)
        for r in range(ROUNDS)[:: -1 if self.inverse else 1]:
            sign = -1 if self.inverse else 1
            if r % 2:
                b = (b + sign * self._round(tweak, r, a, right)) % right
            else:
                a = (a + sign * self._round(tweak, r, b, left)) % left
        return a * right + b

    def symbols(self, values: list[int], radices: list[int], tweak: str) -> list[int]:
        half = len(values) // 2
        left = right = 1
        n = 0
        for i, (v, r) in enumerate(zip(values, radices, strict=True)):
            n = n * r + v
            left, right = (left * r, right) if i < half else (left, right * r)
        n, out = self.number(n, left, right, tweak), []
        for r in radices[::-1]:
            n, v = divmod(n, r)
            out.append(v)
        return out[::-1]

    def digits(self, text: str, tweak: str) -> str:
        return "".join(map(str, self.symbols([int(c) for c in text], [10] * len(text), f"{tweak}{len(text)}")))

    def walk(self, text: str, tweak: str, valid) -> str:
        """The next valid value along the permutation's cycle."""
        while True:
            text = self.digits(text, tweak)
            if valid(text):
                return text

    # --- kinds: the pseudonym of a match, or None where it is no valid value ---

    def _swap(self, kind: str, found: str) -> str | None:
        return getattr(self, f"_{kind}")(found)

    @staticmethod
    def _fill(shape: str, digits: str) -> str:
        rest = iter(digits)
        return _DIGIT.sub(lambda _: next(rest), shape)

    def _email(self, found: str) -> str:
        name, _, domain = found.rpartition("@")
        top = domain.rpartition(".")[2]
        open_part = found[: -len(top) - 1].lower()
        places = [i for i, c in enumerate(open_part) if c.isalnum()]
        digit = [open_part[i].isdigit() for i in places]
        values = [int(open_part[i]) if d else ord(open_part[i]) - 97 for i, d in zip(places, digit, strict=True)]
        shape = "".join("0" if c.isdigit() else "a" if c.isalpha() else c for c in open_part)
        new = list(found)
        for i, d, v in zip(places, digit, self.symbols(values, [10 if d else 26 for d in digit], f"email{shape}{top.lower()}"), strict=True):
            new[i] = str(v) if d else chr(v + (65 if found[i].isupper() else 97))
        return "".join(new)

    def _iban(self, found: str) -> str | None:
        plain = found.replace(" ", "")
        country, check, rest = plain[:2], plain[2:4], plain[4:]
        if not 15 <= len(plain) <= 34 or _mod97(country, check, rest) != 1:
            return None
        digit = [c.isdigit() for c in rest]
        shape = "".join("0" if d else "A" for d in digit)
        values = self.symbols([int(c) if d else ord(c) - 65 for c, d in zip(rest, digit, strict=True)], [10 if d else 26 for d in digit], f"iban{country}{shape}")
        rest = "".join(str(v) if d else chr(v + 65) for v, d in zip(values, digit, strict=True))
        new = iter(f"{country}{98 - _mod97(country, '00', rest):02d}{rest}")
        return "".join(c if c == " " else next(new) for c in found)

    def _ipv4(self, found: str) -> str | None:
        parts = [int(x) for x in found.split(".")]
        if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in found.split(".")):
            return None
        return ".".join(map(str, self.symbols(parts, [256] * 4, "ipv4")))

    def _card(self, found: str) -> str | None:
        plain = re.sub("[ -]", "", found)
        if luhn_digit(plain[:-1]) != int(plain[-1]):
            return None
        new = self.digits(plain[:-1], "card")
        return self._fill(found, new + str(luhn_digit(new)))

    def _date(self, found: str) -> str | None:
        m = _PATTERNS["date"].fullmatch(found)
        year, month, day = (m["y"], m["m"], m["d"]) if m["y"] else (m["y2"], m["m2"], m["d2"])
        shown = [int(year), int(month), int(day)]
        swapped = not m["y"] and shown[1] > 12  # month before day
        if swapped:
            shown[1:] = shown[:0:-1]
        try:
            n = date(*shown).toordinal()
        except ValueError:
            return None
        if not FIRST_DAY <= n <= LAST_DAY:
            return None
        n -= FIRST_DAY
        widths = (len(day), len(month)) if swapped else (len(month), len(day))
        while True:
            n = self.number(n, 271, 271, "date")
            if n > LAST_DAY - FIRST_DAY:
                continue
            new = date.fromordinal(n + FIRST_DAY)
            # As wide as before, and read in the same order.
            fits = all(w == 2 or x < 10 for w, x in zip(widths, (new.month, new.day), strict=True))
            if fits and (not swapped or new.day > 12):
                break
        parts = [f"{x:0{w}d}" for x, w in zip((new.month, new.day), widths, strict=True)]
        mark = m["s"] or m["s2"]
        if m["y"]:
            return mark.join([f"{new.year}", *parts])
        return mark.join([*(parts if swapped else parts[::-1]), f"{new.year}"])

    @staticmethod
    def _real_ssn(digits: str) -> bool:
        return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"

    def _ssn(self, found: str) -> str | None:
        plain = found.replace("-", "")
        return self._fill(found, self.walk(plain, "ssn", self._real_ssn)) if self._real_ssn(plain) else None

    def _phone(self, found: str) -> str | None:
        plain = "".join(_DIGIT.findall(found))
        if not 7 <= len(plain) <= 15:
            return None
        code = re.match(r"\+(\d{1,3})(?=[ .(-])", found)
        fixed = len(code[1]) if code else 0  # the country stays
        return self._fill(found, plain[:fixed] + self.digits(plain[fixed:], f"phone{plain[:fixed]}"))

    # --- texts ---

    def _within(self, kind: str, text: str, taken: list[tuple[int, int, str, str]]) -> Iterator[tuple[int, int, str, str]]:
        """The values of a kind, from the left and the longest first, also inside of matches that are none."""
        pattern, at = _PATTERNS[kind], 0
        while m := pattern.search(text, at):
            start, at = m.start(), m.start() + 1
            limit = min((max(s, start) for s, e, *_ in taken if s < m.end() and start < e), default=m.end())
            ends = [e for e in range(m.end(), start, -1) if e <= limit and (e == m.end() or text[e] in _SEPARATORS[kind])]
            for end in ends:
                value = self.swap(kind, text[start:end]) if end == m.end() or pattern.fullmatch(text, start, end) else None
                if value is not None:
                    yield start, end, kind, value
                    at = end
                    break

    def spans(self, text: str) -> list[tuple[int, int, str, str]]:
        """(start, end, kind, pseudonym), ordered, without overlaps."""
        taken: list[tuple[int, int, str, str]] = []
        digits = _DIGIT.search(text)
        for kind in KINDS:
            if "@" not in text if kind == "email" else not digits:
                continue
            if kind in _SEPARATORS:
                taken += list(self._within(kind, text, taken))
                continue
            new = []
            for m in _PATTERNS[kind].finditer(text):
                if any(s < m.end() and m.start() < e for s, e, *_ in taken):
                    continue
                value = self.swap(kind, m[0])
                if value is not None:
                    new.append((*m.span(), kind, value))
            taken += new
        return sorted(taken)

    def given_spans(self, text: str, told: str | None) -> list[tuple[int, int, str, str]]:
        """The same for the pseudonyms of values that stood at the spans told (kind:start:end, comma-joined)."""
        out, shift = [], 0
        for kind, start, end in (x.split(":") for x in (told or "").split(",") if x):
            a, b = int(start) + shift, int(end) + shift
            if kind == "ipv4":  # the one kind whose pseudonyms can be longer or shorter
                b = _PATTERNS[kind].match(text, a).end()
            shift = b - int(end)
            out.append((a, b, kind, self.swap(kind, text[a:b])))
        return out

    def replace(self, text: str, spans: list[tuple[int, int, str, str]] | None = None) -> tuple[str, list[tuple[int, int, str, str]]]:
        spans = self.spans(text) if spans is None else spans
        parts, at = [], 0
        for start, end, _, value in spans:
            parts += [text[at:start], value]
            at = end
        return "".join([*parts, text[at:]]), spans


def pseudonymise(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", inverse: bool = False, spans_col: str | None = None) -> DataFrame:
    """id_col, text_col with pseudonyms, spans (kind:start:end in the given text, comma-joined), n_<kind> for every kind.

    The way back (inverse) finds a pseudonym where it was put, since it is valid in the same format.  Only beside a
    number or word that makes a longer valid value with it can it take that one; with the spans of the way there in
    spans_col it never does.
    """
    columns = [F.col(id_col).alias("id"), F.col(text_col).alias("text"), (F.col(spans_col) if spans_col else F.lit(None)).cast("string").alias("told")]
    rows = docs.select(*columns)
    counts = ", ".join(f"n_{k} long" for k in KINDS)

    def swapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pseudonyms = Pseudonyms(key, inverse)
        for batch in batches:
            told = zip(batch.column("text").to_pylist(), batch.column("told").to_pylist(), strict=True)
            done = [(None, []) if t is None else pseudonyms.replace(t, pseudonyms.given_spans(t, s) if spans_col else None) for t, s in told]
            kinds = [[k for *_, k, _ in s] for _, s in done]
            columns = [batch.column("id"), pa.array([t for t, _ in done], pa.string())]
            columns.append(pa.array([",".join(f"{k}:{a}:{b}" for a, b, k, _ in s) for _, s in done], pa.string()))
            columns += [pa.array([x.count(k) for x in kinds], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "text", "spans", *[f"n_{k}" for k in KINDS]])

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(swapped, f"id {kind}, text string, spans string, {counts}")
    return out.withColumnsRenamed({"id": id_col, "text": text_col})
