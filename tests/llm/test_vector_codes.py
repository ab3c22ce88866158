"""Vector codes against plain distances in Python's integers."""

from fractions import Fraction
from hashlib import sha256
from math import floor, isfinite
from random import Random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fiscalframe.llm import vector_codes as codes

SCHEMA = "vec_id long, embedding array<double>, label int"
LONGEST = 2**63 - 1


def brute(rows):
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and isfinite(x) for x in v)]
    length = max(1, -(-max((len(v) for _, v, _ in kept), default=0) // 8))
    whole = [[floor(Fraction(x) * 4096) for x in v] + [0] * (8 * length - len(v)) for _, v, _ in kept]
    cut = [[w[p * length : (p + 1) * length] for p in range(8)] for w in whole]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))
    books = [[cut[k][p] for k in order[:16]] for p in range(8)]

    def nearest(p, part):
        return min((sum((x - y) ** 2 for x, y in zip(part, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(6):
        fresh = []
        for p in range(8):
            own = [nearest(p, c[p])[1] for c in cut]
            members = [[c[p] for c, k in zip(cut, own, strict=True) if k == e] for e in range(len(books[p]))]
            fresh.append([[sum(x) // len(m) for x in zip(*m, strict=True)] if m else books[p][e] for e, m in enumerate(members)])
        books = fresh
    final = [[nearest(p, c[p]) for p in range(8)] for c in cut]
    errors = [min(sum(d for d, _ in f), LONGEST) for f in final]
    by_label = {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        by_label[label] = by_label.get(label, 0) + e
    books_sha = sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    return sorted(
        ((i, "".join(f"{e:02x}" for _, e in f), error, min(by_label[label], LONGEST), books_sha) for (i, _, label), f, error in zip(kept, final, errors, strict=True)),
        key=repr,
    )


def check(frame, rows):
    docs = frame(rows, SCHEMA).withColumn("code", F.lit("clash")).withColumn("vector", F.lit(1)).withColumn("error", F.lit("x"))
    found = codes.codes_and_errors(docs).collect()
    assert sorted(map(tuple, found), key=repr) == brute(rows)


@pytest.mark.parametrize("width", [8, 24, 64, 104])
def test_codes_against_brute_force(frame, width):
    """Clusters, many equal vectors, ties on a coarse grid, nulls and non-finite values."""
    random = Random(width)
    centres = [[random.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(width)] for _ in range(9)]
    rows = [(i, [x + random.gauss(0, 0.2) if i % 3 else x for x in random.choice(centres)], random.choice([None, 1, 2])) for i in range(150)]
    rows += [(i + 1000, [float(random.randrange(2)) for _ in range(width)], 3) for i in range(30)]
    rows += [(-5, None, 1), (-4, [None] * width, 1), (-3, [float("nan")] * width, 1), (-2, [0.0] * (width - 1) + [float("inf")], 1)]
    rows += [(3, rows[5][1], 1), (None, rows[6][1], 1), rows[7]]
    check(frame, rows)


def test_codes_of_odd_vectors(frame):
    """Lengths that differ, values beyond 64 bits, and few vectors."""
    random = Random(5)
    check(frame, [(i, [random.gauss(0, 3) for _ in range(random.choice([0, 1, 7, 13]))], i % 2) for i in range(40)])
    check(frame, [(i, [random.gauss(0, 1) * 10.0 ** random.randrange(-320, 300) for _ in range(16)], None) for i in range(40)])
    check(frame, [(i, [random.gauss(0, 1) * 2.0 ** random.randrange(60) for _ in range(9)], i) for i in range(25)])
    check(frame, [(2, [0.5] * 8, 1), (1, [-0.00001] * 8, 1)])
    assert codes.codes_and_errors(frame([], SCHEMA)).count() == 0
    assert codes.codes_and_errors(frame([(1, None, 1)], SCHEMA)).count() == 0


def test_transform_keeps_distances():
    """Sequency order, Parseval's identity, and elimination that never changes a result."""
    random = np.random.default_rng(1)
    eye = codes.transform(np.eye(8, dtype=np.int64)).T
    changes = [(np.diff(row) != 0).sum() for row in eye]
    assert changes == list(range(8)) and (np.abs(eye) == 1).all()
    for width in (1, 3, 8, 13, 32):
        parts, books = random.integers(-50, 50, (300, width)), random.integers(-50, 50, (16, width))
        books[7] = books[3]
        entry, distance = codes.nearest(parts, books)
        plain = ((parts[:, None] - books[None]) ** 2).sum(axis=2)
        assert (entry == plain.argmin(axis=1)).all() and (distance == plain.min(axis=1)).all()


def test_decoding(frame):
    docs = frame([(i, [float(i * k % 7) for k in range(16)], None) for i in range(10)], SCHEMA)
    books = codes.fit(docs)
    coded = codes.encode(docs, books)
    for r in codes.decode(coded, books).join(docs, "vec_id").collect():
        assert sum((x - floor(4096 * y)) ** 2 for x, y in zip(r.vector, r.embedding, strict=True)) == r.error == 0
