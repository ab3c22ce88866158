"""Secret scan over an incremental blob ledger.

Every version of every path is content-addressed.  Only pairs of a blob and a
rule version that the ledger has not seen are scanned, each blob once; findings
are joined back to all paths that hold the blob.  The ledger has one row per
scanned blob, found or clean: blob_id, rule_version, findings.  It is a table
the caller keeps; ``scan`` returns the rows to append.

Defined cases: a null text is the empty blob; a path may have any number of
versions and rows may repeat, each gets its findings; an empty table or ledger
is fine; blobs without a secret have an empty list of findings; other columns of
the versions are kept and may have any name but blob_id, rule_version, findings.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: re.Pattern
    shortest: int
    group: int = 0


# Matches are leftmost and do not overlap within a kind; those whose group is
# too short are dropped after matching.  A run of one character class is found
# by its least length at once, which gives the same matches.
BASE = (
    Rule("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 8, 2),
    Rule("access", re.compile(r"AKIA[A-Z0-9]{12,}"), 16),
    Rule("hex", re.compile(r"[0-9a-f]{32,}"), 32),
)
MORE = (
    Rule("github", re.compile(r"gh[oprsu]_[A-Za-z0-9]{36,}"), 40),
    Rule("slack", re.compile(r"xox[abeoprs]-[A-Za-z0-9-]{10,}"), 15),
    Rule("jwt", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"), 20),
    Rule("pem", re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----)?"), 20),
)
RULES = BASE + MORE
# To be changed with RULES.
RULE_VERSION = "1"

FINDING = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
LEDGER = T.StructType([T.StructField("blob_id", T.StringType()), T.StructField("rule_version", T.StringType()), T.StructField("findings", FINDING)])
_FINDING = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find(text: str, rules: Iterable[Rule] = RULES) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start and order of rules, in code points."""
    order = {}
    spans = []
    for rule in rules:
        order[rule.kind] = len(order)
        spans += [(rule.kind, *m.span()) for m in rule.pattern.finditer(text) if len(m[rule.group]) >= rule.shortest]
    return sorted(spans, key=lambda s: (s[1], order[s[0]]))


def scan(versions: DataFrame, ledger: DataFrame | None = None, text_col: str = "text", rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION) -> DataFrame:
    """Ledger rows of the blobs in versions that the ledger lacks for this rule version; without a ledger, of all."""
    content = F.coalesce(F.col(text_col), F.lit(""))
    blobs = versions.select(F.sha2(content, 256).alias("blob_id"), content.alias("content"))
    if ledger is not None:
        blobs = blobs.join(ledger.filter(F.col("rule_version") == rule_version), "blob_id", "left_anti")

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in find(t, rules)] for t in batch.column("content").to_pylist()]
            version = pa.array([rule_version] * batch.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("blob_id"), version, pa.array(found, _FINDING)], names=["blob_id", "rule_version", "findings"])

    return blobs.distinct().mapInArrow(scanned, LEDGER)


def findings_by_path(versions: DataFrame, ledger: DataFrame, text_col: str = "text", rule_version: str = RULE_VERSION) -> DataFrame:
    """Every row of versions, without its text, with blob_id and findings.

    The side of the versions is narrow and may be skewed by a blob with very
    many paths, which AQE splits.
    """
    paths = versions.withColumn("blob_id", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).drop(text_col)
    known = ledger.filter(F.col("rule_version") == rule_version).select("blob_id", "findings")
    return paths.join(known, "blob_id", "left")


def of_kinds(findings: Column, *kinds: str) -> Column:
    return F.filter(findings, lambda f: f["kind"].isin(*kinds))


def spans_text(findings: Column) -> Column:
    """kind:start:end of each finding, comma-joined."""
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")
