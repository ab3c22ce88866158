"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from fiscalframe.llm.licenses import ANCHOR, RULES, SENTENCE_END, SENTENCES

OP1 = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def op4() -> str:
    known = ", ".join(f"('{text}', '{name}')" for name, texts in SENTENCES.items() for text in texts)
    rules = {"".join(f"<{i}>" for i in ids): licence for licence, ids in RULES}
    names = ", ".join(f"('{seq}', '{licence}')" for seq, licence in rules.items())
    pattern = "|".join(rules)
    return f"""
WITH known(sentence, name) AS (VALUES {known}), rules(seq, licence) AS (VALUES {names}),
cut AS (
  SELECT doc_id, generate_subscripts(s, 1) AS i, unnest(s) AS sentence
  FROM (SELECT doc_id, regexp_split_to_array(lower(text), '{SENTENCE_END}') AS s FROM documents WHERE regexp_matches(lower(text), '{ANCHOR}'))
),
ids AS (
  SELECT doc_id, string_agg(name, ',' ORDER BY i) AS ids, string_agg('<' || name || '>', '' ORDER BY i) AS seq
  FROM cut JOIN known ON trim(regexp_replace(cut.sentence, '[^a-z0-9]+', ' ', 'g')) = known.sentence GROUP BY doc_id
),
matched AS (SELECT doc_id, regexp_extract_all(seq, '{pattern}') AS m, regexp_replace(seq, '{pattern}', '', 'g') AS rest FROM ids),
each AS (SELECT doc_id, generate_subscripts(m, 1) AS i, unnest(m) AS seq FROM matched),
named AS (SELECT doc_id, string_agg(licence, ',' ORDER BY i) AS licenses FROM each JOIN rules USING (seq) GROUP BY doc_id)
SELECT doc_id, coalesce(ids, '') AS sentence_ids, coalesce(licenses, '') AS licenses,
       CASE WHEN ids IS NULL THEN 'none' WHEN rest <> '' THEN 'partial' ELSE 'matched' END AS status
FROM documents LEFT JOIN ids USING (doc_id) LEFT JOIN matched USING (doc_id) LEFT JOIN named USING (doc_id)
"""


OP9 = r"""
WITH cut AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, sha256(array_to_string(w[i:i + 19], ' ')) AS words
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM cut WHERE len(w) >= 20)
),
later AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY words ORDER BY doc_id, i) > 1),
covered AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM later)),
each_word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM cut),
rest AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n
  FROM each_word ANTI JOIN covered USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM cut LEFT JOIN rest USING (doc_id)
"""


def op12(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Distances of all entries in the plain domain; the rounds one after the other."""
    steps = [f"""
v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::HUGEINT) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
p AS MATERIALIZED (SELECT rid, vec_id, k, x[k * (len(x) // {parts}) + 1 : (k + 1) * (len(x) // {parts})] AS x FROM v, range({parts}) AS r(k)),
c0 AS MATERIALIZED (SELECT k, e, x FROM (SELECT k, x, row_number() OVER (PARTITION BY k ORDER BY vec_id) - 1 AS e FROM p) WHERE e < {entries})"""]
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT rid, k, min({{'d': list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': e}}) AS near
  FROM p JOIN c{r} c USING (k) GROUP BY rid, k
)""")
        if r < rounds:
            steps.append(f"""
c{r + 1} AS MATERIALIZED (
  SELECT k, e, coalesce(mean, c.x) AS x FROM c{r} c LEFT JOIN (
    SELECT k, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS mean FROM (
      SELECT k, near.e AS e, i, sum(x[i]) AS s, count(*)::HUGEINT AS n FROM p JOIN a{r} USING (rid, k), unnest(range(1, len(x) + 1)) AS u(i) GROUP BY ALL
    ) GROUP BY k, e
  ) USING (k, e)
)""")
    return f"""WITH {",".join(steps)},
books AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY k, e)) AS codebooks_sha256 FROM c{rounds}),
coded AS (SELECT rid, string_agg(format('{{:02x}}', near.e), '' ORDER BY k) AS code, sum(near.d)::BIGINT AS error FROM a{rounds} GROUP BY rid)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN v USING (rid), books"""


def op13(levels: int = 7, upper_levels: int = 3) -> str:
    """Trees of up to 8 ** levels leaves a language and 8 ** upper_levels languages; what has one node left goes up as it is."""
    head = " || ".join(f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars"))
    body = "coalesce(octet_length(encode({0}))::VARCHAR || ':' || {0}, '-')"
    lower = f"translate(text, '{ascii_uppercase}', '{ascii_lowercase}')"
    # CRC-32 by bytes and bits, before its last complement.
    crc = (
        "list_reduce(list_prepend(4294967295::UBIGINT, [ord(d)::UBIGINT FOR d IN string_split(doc_id::VARCHAR, '')]), lambda c, b: "
        "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda r, k: xor(r >> 1, (r & 1) * 3988292384::UBIGINT)))"
    )
    parts = [f"""
docs AS (SELECT doc_id, lang, {head} AS head, text, coalesce((4294967295 - {crc}) % 3 = 0, false) AS tampered FROM documents),
leaves AS (SELECT doc_id, lang, sha256(head || {body.format("text")}) AS leaf, sha256(head || CASE WHEN tampered THEN {body.format(lower)} ELSE {body.format("text")} END) AS claimed FROM docs),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
a0 AS (SELECT lang AS g, pos, leaf AS node FROM placed),
f0 AS (SELECT *, lang AS g, '' AS proof, claimed AS folded FROM placed)"""]

    def level(nodes: str, folded: str, k: int) -> None:
        run = "OVER (PARTITION BY g, pos // 8 ORDER BY pos ROWS BETWEEN"
        parts.append(f"""
{nodes}{k}s AS (SELECT *, count(*) OVER (PARTITION BY g) AS n, coalesce(string_agg(node, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(node, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {nodes}{k}),
{nodes}{k + 1} AS (SELECT g, pos // 8 AS pos, CASE WHEN max(n) = 1 THEN max(node) ELSE sha256(string_agg(node, '' ORDER BY pos)) END AS node FROM {nodes}{k}s GROUP BY g, pos // 8),
{folded}{k + 1} AS (SELECT f.* REPLACE (f.pos // 8 AS pos, proof || l || r AS proof, CASE WHEN n = 1 THEN folded ELSE sha256(l || folded || r) END AS folded)
  FROM {folded}{k} f JOIN {nodes}{k}s s ON f.g IS NOT DISTINCT FROM s.g AND f.pos = s.pos)""")

    for k in range(levels):
        level("a", "f", k)
    parts.append(f"""
b0 AS (SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos, node, g AS lang FROM a{levels}),
h0 AS (SELECT f.* REPLACE (0 AS g, b0.pos AS pos), node AS subroot FROM f{levels} f JOIN b0 ON f.lang IS NOT DISTINCT FROM b0.lang)""")
    for k in range(upper_levels):
        level("b", "h", k)
    return f"""WITH {",".join(parts)}
SELECT doc_id, leaf, subroot, node AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = node AS verified
FROM h{upper_levels} h, b{upper_levels}"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1, "op4_licenses": op4(), "op9_substring_dedup": OP9, "op12_vector_codes": op12(), "op13_merkle": op13()}
