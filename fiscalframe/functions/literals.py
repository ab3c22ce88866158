"""Words that stand in every text a regex matches in, taken from its parsed form."""

from __future__ import annotations

from functools import lru_cache

# The standard library's regex parser, which has no public name.
from re import I, M, S, _constants as kinds, _parser

REPEATS = {kinds.MAX_REPEAT, kinds.MIN_REPEAT, kinds.POSSESSIVE_REPEAT}
# Least letters of a word worth a search of its own, and most words to search for.
LEAST, MOST = 2, 12


def _letter(kind: object, value: object) -> str | None:
    """The one ASCII character, lower-cased, that an item stands for; a class of a letter in both cases is one."""
    if kind is kinds.LITERAL and value < 128:
        return chr(value).lower()
    if kind is kinds.IN and value and all(k is kinds.LITERAL and v < 128 for k, v in value):
        letters = {chr(v).lower() for _, v in value}
        return letters.pop() if len(letters) == 1 else None
    return None


def _better(one: frozenset[str] | None, other: frozenset[str] | None) -> frozenset[str] | None:
    """Of two sets, one word of each of which is in every match, the one that tells more."""
    if one is None or other is None:
        return one or other
    return max(one, other, key=lambda words: (min(map(len, words)), -len(words)))


def _required(items: list) -> frozenset[str] | None:
    """Words of which every match of a sequence has one; None if none are known."""
    best, run = None, ""

    def ended() -> frozenset[str] | None:
        return _better(best, frozenset([run]) if len(run) >= LEAST else None)

    for kind, value in items:
        letter = _letter(kind, value)
        if letter is not None:
            run += letter
            continue
        inner = None
        if kind is kinds.SUBPATTERN:
            inner = _required(value[3])
        elif kind is kinds.ATOMIC_GROUP:
            inner = _required(value)
        elif kind in REPEATS and value[0] >= 1:
            inner = _required(value[2])
        elif kind is kinds.BRANCH:
            each = [_required(branch) for branch in value[1]]
            inner = frozenset().union(*each) if all(each) else None
            inner = inner if inner and len(inner) <= MOST else None
        if kind not in (kinds.AT, kinds.ASSERT, kinds.ASSERT_NOT):  # those take no characters
            best, run = ended(), ""
        best = _better(best, inner)
    return ended()


@lru_cache(maxsize=1024)
def required_words(pattern: str) -> tuple[str, ...] | None:
    """Lower-case words of which every text that the Python pattern matches in, ignoring case, has one, or None.

    Only ASCII letters are relied on; texts with one of the few others that ignoring case equates with
    them (rules.odd_case) need not hold a word.
    """
    found = _required(list(_parser.parse(pattern, I | M | S)))
    return tuple(sorted(found)) if found else None
