"""The manifest against a tree built in memory."""

from hashlib import sha256
from random import Random

import pytest
from pyspark.sql import functions as F

from fiscalframe.llm import merkle


def digest(text):
    return sha256(text.encode()).hexdigest()


def climb(nodes, place):
    """(top, path): path holds a (run, own index) for each level."""
    path = []
    while len(nodes) > 1:
        start = place // 8 * 8
        path.append((nodes[start : start + 8], place - start))
        nodes = [digest("".join(nodes[k : k + 8])) for k in range(0, len(nodes), 8)]
        place //= 8
    return nodes[0], path


def brute(rows):
    """rows: (key, group, leaf, claimed) -> sorted (key, leaf, subroot, root, proof digest, folded root, verified)."""
    groups = {}
    for key, group, leaf, claimed in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2])):
        groups.setdefault(group, []).append((key, leaf, claimed))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops = {g: climb([leaf for _, leaf, _ in groups[g]], 0)[0] for g in order}
    out = []
    for k, g in enumerate(order):
        root, upper = climb([tops[x] for x in order], k)
        for place, (key, leaf, claimed) in enumerate(groups[g]):
            node, proof = claimed, ""
            for run, at in climb([leaf for _, leaf, _ in groups[g]], place)[1] + upper:
                proof += "".join(run[:at] + run[at + 1 :])
                node = digest("".join([*run[:at], node, *run[at + 1 :]]))
            out.append((key, leaf, tops[g], root, digest(proof), node, node == root))
    return sorted(out, key=repr)


SCHEMA = "doc_id long, lang string, leaf string, claimed string"


@pytest.mark.parametrize("levels", [1, 3])
def test_manifest_against_brute_force(frame, levels):
    """Groups of 1 to 700 leaves, more groups than one run holds, null ones, repeated keys; superblocks of 8 and 512."""
    random, rows = Random(levels), []
    sizes = {None: 9, "": 1, "a": 64, "b": 65, "è": 8, "hot": 700} | {f"g{k}": random.randrange(1, 4) for k in range(12)}
    for group, size in sizes.items():
        for _ in range(size):
            key = random.choice([None, random.randrange(10**6), random.randrange(40)])
            leaf = digest(f"{random.random()}")
            rows.append((key, group, leaf, leaf if random.random() < 0.7 else digest("other")))
    rows += rows[:3] + rows[-3:]
    docs = frame(rows, SCHEMA).withColumn("place", F.lit("clash")).withColumn("node", F.lit("clash"))
    found = merkle.manifest(docs, "lang", ["doc_id"], ["doc_id"], levels=levels)
    # Rows alike in all but their claim share a place in the order only up to that claim.
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows)


def test_proofs_verify_by_themselves(frame):
    rows = [(k, "x" if k % 3 else None, digest(str(k)), digest(str(k))) for k in range(100)]
    found = merkle.manifest(frame(rows, SCHEMA), "lang", ["doc_id"], ["doc_id"], proofs=True).collect()
    for r in found:
        assert merkle.fold(r.leaf, r.proof) == r.root == r.folded_root and r.verified and merkle.proof_digest(r.proof) == r.proof_sha256
    one = found[0]
    assert merkle.fold(digest("forged"), one.proof) != one.root


def test_manifest_of_little(frame):
    alone = [(5, None, digest("x"), digest("x"))]
    assert [tuple(r) for r in merkle.manifest(frame(alone, SCHEMA), "lang", ["doc_id"], ["doc_id"]).collect()] == brute(alone)
    assert brute(alone)[0][2:5] == (digest("x"), digest("x"), digest(""))
    assert merkle.manifest(frame([], SCHEMA), "lang", ["doc_id"], ["doc_id"]).count() == 0


def test_leaves(frame):
    rows = frame([(1, None), (2, ""), (None, "È 1"), (3, "ab" * 300_000)])
    found = [r[0] for r in rows.select(merkle.leaf(F.col("doc_id"), F.col("text")).alias("leaf")).collect()]
    assert sorted(found) == sorted(map(digest, ["1:1-", "1:20:", "-4:È 1", f"1:3600000:{'ab' * 300_000}"]))
    assert [r[0] for r in frame([(1, "AZÈé b")]).select(merkle.lower_ascii(F.col("text"))).collect()] == ["azÈé b"]
