"""The corpus operators against brute force, and their defined cases."""

import re
from collections import Counter, defaultdict
from hashlib import sha256
from pathlib import Path
from random import Random

import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

import corpus_pipeline
from fiscalframe.llm import (
    components,
    decontamination,
    exact_dedup,
    language,
    licenses,
    mixing,
    pseudonyms,
    quality,
    secret_scan,
    simhash,
    substring_dedup,
)

KEY = b"key of the tests"
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "uno"), (4, "uno"), (None, "uno"), (5, "uno due"), (6, "uno due tre " * 5000)]


def prose(seed: int, words: int, vocabulary: int = 400) -> str:
    random = Random(seed)
    return " ".join(f"w{random.randrange(vocabulary)}" for _ in range(words))


def rows_of(found):
    return sorted(map(tuple, found.collect()), key=repr)


# --- exact dedup ---


def test_exact_dedup(frame):
    rows = [(i, prose(i % 7, 30) if i % 3 else prose(i, 30)) for i in range(300)] + [(1, None), (2, ""), (900, "x"), (900, "x")]
    found = exact_dedup.mark_copies(frame(rows).withColumn("id", F.lit("clash")).withColumn("digest", F.lit(1)), salts=4)
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    expected = []
    for text, ids in groups.items():
        for k, i in enumerate(sorted(ids)):
            expected.append((i, max(ids), len(ids), i == max(ids) and (k == 0 or sorted(ids)[k - 1] != i), sha256(text.encode()).hexdigest()))
    assert rows_of(found) == sorted(expected, key=repr)


def test_exact_dedup_rows(frame):
    docs = frame([(1, "a", "s"), (2, "a", None), (3, None, "s"), (4, "", "t"), (5, "b", "u"), (5, "b", "u"), (None, "a", "z")], "doc_id long, text string, digest string")
    assert rows_of(exact_dedup.drop_copies(docs)) == sorted([(2, "a", None), (4, "", "t"), (5, "b", "u")], key=repr)


def test_exact_dedup_null_ids_and_empty(frame):
    assert rows_of(exact_dedup.mark_copies(frame([(None, "a"), (None, "a")]))) == sorted(
        [(None, None, 2, k, sha256(b"a").hexdigest()) for k in (True, False)], key=repr
    )
    assert exact_dedup.mark_copies(frame([])).count() == exact_dedup.drop_copies(frame([])).count() == 0


# --- pseudonyms ---


def test_permutations_are_bijective():
    forth, back = pseudonyms.Pseudonyms(KEY), pseudonyms.Pseudonyms(KEY, inverse=True)
    assert sorted(forth.number(n, 7, 13, "t") for n in range(91)) == list(range(91))
    assert all(back.number(forth.number(n, 7, 13, "t"), 7, 13, "t") == n for n in range(91))


VALUES = {
    "card": ["4111111111111111", "5500 0000 0000 0004", "3782-822463-10005"],
    "email": ["anna.rossi@example.com", "B2@Mail.Example.org"],
    "ipv4": ["10.0.0.1", "192.168.17.254"],
    "iban": ["GB82 WEST 1234 5698 7654 32", "IT60X0542811101000000123456"],
    "date": ["2024-02-29", "1/2/1999", "31.12.2001", "12/25/2020"],
    "ssn": ["123-45-6789"],
    "phone": ["+1 (017) 555-7713", "+39 06 1234 5678", "(212) 555-0100", "+14155550123"],
}


@pytest.mark.parametrize("kind", VALUES)
def test_values_are_swapped_in_their_format_and_back(kind):
    forth, back = pseudonyms.Pseudonyms(KEY), pseudonyms.Pseudonyms(KEY, inverse=True)
    for value in VALUES[kind]:
        new, spans = forth.replace(f"x {value}, y")
        assert [s[2] for s in spans] == [kind], value
        swapped = new[2:-3]
        assert swapped != value
        assert re.sub(r"\d+", "0", swapped) == re.sub(r"\d+", "0", value) if kind in ("date", "ipv4", "phone", "card", "ssn") else len(swapped) == len(value)
        again, found = back.replace(new)
        assert again == f"x {value}, y" and [s[2] for s in found] == [kind]
        assert pseudonyms.Pseudonyms(b"other").replace(f"x {value}, y")[0] != new


@pytest.mark.parametrize("text", ["4111111111111112", "999.1.1.1", "2023-02-29", "000-12-3456", "IT60X0542811101000000123457", "1.2.3", "12345", "a@b", "v1.2.3.4.5", ""])
def test_what_is_not_valid_stays(text):
    assert pseudonyms.Pseudonyms(KEY).replace(text) == (text, [])


BESIDE = [
    ("card", "4111111111111111", "{} 12/27"), ("card", "4111 1111 1111 1111", "{} 123"), ("card", "4111111111111111", "12 {}"), ("card", "4111-1111-1111-1111", "12 {} 12/27 123"),
    ("card", "4111111111111111", "{} 10.0.0.1"), ("card", "4111111111111111", "10.0.0.1 {}"), ("card", "5500 0000 0000 0004", "EUR 12.50 {} 99.00"), ("card", "4111111111111111", "1 2 3 {} 4 5 6"),
    ("iban", "ES91 2100 0418 4502 0005 1332", "{} EUR"), ("iban", "ES9121000418450200051332", "IBAN {} EUR 12"), ("iban", "GB82 WEST 1234 5698 7654 32", "AB12 {} BIC ABCD"), ("iban", "GB82 WEST 1234 5698 7654 32", "{} 10.0.0.1"),
]


@pytest.mark.parametrize("kind,value,around", BESIDE)
def test_values_beside_numbers_and_words(frame, kind, value, around):
    text = around.format(value)
    new, spans = pseudonyms.Pseudonyms(KEY).replace(text)
    at = text.index(value)
    # Whatever else is taken with it, no digit group of the value stays in clear.
    assert any(k == kind and s <= at and at + len(value) <= e for s, e, k, _ in spans), (spans, new)
    assert value not in new
    there = pseudonyms.pseudonymise(frame([(1, text)]), KEY)
    assert pseudonyms.pseudonymise(there, KEY, inverse=True, spans_col="spans").first().text == text


def test_equal_values_stay_linked(frame):
    docs = frame([(1, "4111 1111 1111 1111"), (2, "card 4111-1111-1111-1111!"), (3, None), (4, ""), (4, "x " * 100_000 + "10.0.0.1")])
    found = pseudonyms.pseudonymise(docs.withColumn("spans", F.lit(1)), KEY).collect()
    texts = {(r.doc_id, r.n_ipv4): r.text for r in found}
    digits = {re.sub(r"\D", "", texts[i, 0]) for i in (1, 2)}
    assert len(digits) == 1 and pseudonyms.luhn_digit((d := digits.pop())[:-1]) == int(d[-1])
    assert texts[3, 0] is None and texts[4, 0] == "" and texts[4, 1].startswith("x x ") and not texts[4, 1].endswith("10.0.0.1")
    assert pseudonyms.pseudonymise(frame([]), KEY).count() == 0


# --- secrets ---


def brute_secrets(text):
    rules = [
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
        ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16),
        ("hex", re.compile("[0-9a-f]+"), 0, 32),
    ]
    found = [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for k, (name, p, g, n) in enumerate(rules) for m in p.finditer(text) if len(m[g]) >= n]
    return [s for *_, s in sorted(found)]


def test_secrets_equal_the_plain_search():
    random = Random(3)
    pieces = ["password", "PASSWD", "Token", "api_key", "apikey", "ſecret", "secret", '"', "'", " ", ":", "=", "AKIA", "ABCD1234EFGH", "0123456789abcdef", "é", "\n", "x", "abcdefgh", "-", "9" * 20]
    for _ in range(3000):
        text = "".join(random.choices(pieces, k=12))
        assert [f"{k}:{a}:{b}" for k, a, b in secret_scan.find(text, secret_scan.BASE)] == brute_secrets(text), text


def test_ledger_scans_only_what_is_unseen(frame):
    versions = frame([("a", "token = abcdefgh1234"), ("b", "token = abcdefgh1234"), ("a", "clean"), ("c", None), ("c", "é AKIAABCDEFGHIJKL")], "path string, text string")
    first = secret_scan.scan(versions.filter("text <> 'clean' or text is null"))
    assert first.count() == 3
    ledger = first.collect()
    ledger = versions.sparkSession.createDataFrame(ledger, secret_scan.LEDGER)
    more = secret_scan.scan(versions, ledger)
    assert [r.blob_id for r in more.collect()] == [sha256(b"clean").hexdigest()]
    assert secret_scan.scan(versions, ledger, rule_version="2").count() == 4
    found = secret_scan.findings_by_path(versions, ledger.union(more))
    assert rows_of(found.select("path", secret_scan.spans_text(F.col("findings")))) == sorted(
        [("a", "assign:0:20"), ("b", "assign:0:20"), ("a", ""), ("c", ""), ("c", "access:2:18")]
    )
    assert secret_scan.scan(versions.limit(0)).count() == 0


# --- licences ---


def test_licences(frame):
    mit = licenses.SENTENCES["mit-grant"][0], licenses.SENTENCES["mit-condition"][0], licenses.SENTENCES["as-is"][0]
    docs = frame(
        [
            (1, "Bla.\nReleased under the MIT License.\nBla."),
            (2, "Licensed under CC BY-NC 4.0."),
            (3, "X. MIT License\n\n" + ":\n".join(s.upper() for s in mit) + "."),
            (4, "LICENSED!! UNDER!! THE!! APACHE!! LICENSE,!! VERSION!! 2.0.!!\nYou may not use this file except in compliance with the License."),
            (5, "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement."),
            (6, None), (7, ""), (8, "no license here"),
            (9, "Released under the MIT License.\nReleased under the MIT License."),
        ]
    )
    found = {r.doc_id: (r.licenses, r.status) for r in licenses.recognise(docs.withColumn("ids", F.lit(0)).withColumn("id", F.lit(0))).collect()}
    assert found == {
        1: ("MIT", "matched"), 2: ("CC-BY-NC-4.0", "matched"), 3: ("MIT", "matched"), 4: ("Apache-2.0", "matched"), 5: ("", "partial"),
        6: ("", "none"), 7: ("", "none"), 8: ("", "none"), 9: ("MIT,MIT", "matched"),
    }
    assert licenses.recognise(frame([])).count() == 0


MIT = """MIT License

Copyright (c) 2020 Anna Rossi

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE.
"""
GPL = """Copyright (C) 2020  Anna Rossi
This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful.
"""
ISC = """Copyright 2020 Anna Rossi

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""


def test_wrapped_licences(frame):
    wrapped = {"MIT": MIT, "GPL-3.0-or-later": GPL, "GPL-2.0-or-later": GPL.replace("software:", "software;").replace("Foundation,", "Foundation;").replace("3 of", "2 of"), "ISC": ISC, "BSD-3-Clause": BSD}
    styles = {"plain": lambda t: t, "windows": lambda t: t.replace("\n", "\r\n"), "hash": lambda t: "".join(f"# {x}\n" for x in t.split("\n")), "star": lambda t: "/*\n" + "".join(f" * {x}\n" for x in t.split("\n")) + " */\nint main;"}
    asked = [(f"{name} {style}", change(text)) for name, text in wrapped.items() for style, change in styles.items()]
    more = [("one line", "bla bla\nReleased under the MIT License\nbla bla"), ("across", "Released under.\nThe MIT\n\nLicense"), ("marks", "HS H S released under the H mit license")]
    found = {r.doc_id: (r.licenses, r.status) for r in licenses.recognise(frame(asked + more, "doc_id string, text string")).collect()}
    assert {i: found[i] for i, _ in asked} == {i: (i.split()[0], "matched") for i, _ in asked}
    assert found["one line"] == ("MIT", "matched") and found["across"] == found["marks"] == ("", "none")


def test_licence_table_is_normal():
    for texts in licenses.SENTENCES.values():
        for text in texts:
            assert re.search(licenses.ANCHOR, text) and text == re.sub("[^a-z0-9]+", " ", text).strip()
    assert all(i in licenses.SENTENCES for _, ids in licenses.RULES for i in ids)


# --- decontamination ---


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], max(row[j + 1], row[j], last + 1 if x == y else 0)
    return row[-1]


def test_common_length():
    random = Random(1)
    for _ in range(300):
        a, b = (random.choices(range(6), k=random.randrange(1, 40)) for _ in "ab")
        assert decontamination.common_length(decontamination.Items.masks(a), len(a), b) == lcs(a, b)


@pytest.fixture(scope="module")
def leaks():
    items = [(i, " ".join(f"q{i}x{k}" if k % 2 else f"w{k}" for k in range(24 + i)) + ". Answer: " + f"a{i} b{i} c{i}") for i in range(40)]
    random, docs, expected = Random(2), [], {}
    for d in range(400):
        text = prose(d + 1000, 200, 100)
        if d % 8 == 0:
            i = random.randrange(40)
            words = items[i][1].upper().split()
            dropped = [w for k, w in enumerate(words) if d % 16 or k % 5]  # every other leak is a paraphrase
            at = random.randrange(len(text))
            text = text[:at] + " " + " !! ".join(dropped) + " " + text[at:]
            expected[d] = i
        docs.append((d, text))
    return items, docs, expected


def test_decontamination(frame, leaks):
    items, docs, expected = leaks
    more = [(900, None), (901, ""), (902, "w0 w2 w4"), (903, items[3][1].split(". Answer")[0]), (0, docs[0][1])]
    benchmark = frame([*items, (None, "x y"), (77, None), (78, "!")], "item_id long, text string")
    hits = decontamination.find(frame(docs + more).withColumn("item", F.lit(0)), benchmark)
    found = {r.doc_id: r["items"] for r in decontamination.mark(frame(docs + more), hits).filter("contaminated").collect()}
    assert found == {d: str(i) for d, i in expected.items()}  # 903 has the question without its answer
    blocks = decontamination.find(frame(docs), benchmark, block=15)
    assert {r.id: str(r["item"]) for r in blocks.collect()} == found


def test_recall_of_the_latent_space(spark, frame, leaks):
    """Against all pairs: passages whose plain cosine to an item is 0.6 or more are candidates."""
    import numpy as np

    items, docs, _ = leaks
    block = decontamination.Items.of(items)
    frame_docs = frame(docs).select(F.col("doc_id").alias("id"), "text")
    read = decontamination._read(frame_docs, block)
    n, counts = decontamination._document_frequency(read, block)
    assert n == 400 and counts[block.vocabulary[b"w0"]] == sum("w0" in t.lower().split() for _, t in docs)
    weight = np.log1p(n / (1 + counts)).astype(np.float32)
    passages = read.filter("n IS NULL")
    space = decontamination.latent_space(passages, block, weight)
    lists = decontamination._lists([r.terms for r in passages.collect()])
    dense = np.eye(len(weight), dtype=np.float32)
    own = decontamination._lists([t for _, t in block.passages()])
    plain = decontamination._unit(decontamination._projected(lists, weight, dense)) @ decontamination._unit(decontamination._projected(own, weight, dense)).T
    latent = decontamination._unit(decontamination._projected(lists, weight, space)) @ decontamination._unit(decontamination._projected(own, weight, space)).T
    near = plain >= 0.6
    assert near.sum() > 50 and (latent[near] >= decontamination.COSINE).mean() >= 0.9


def test_latent_space_is_of_the_corpus(frame, monkeypatch):
    """Its passages are of all documents, whatever items they could hold; of many, a sample that does not depend on partitions."""
    import numpy as np

    block = decontamination.Items.of([(1, "w1 w2 w3 q1 q2 q3 q4 q5 q6")])
    docs = [(d, prose(d, 200, 20)) for d in range(60)] + [(60, None), (61, "w1")]
    clean = frame(docs).select(F.col("doc_id").alias("id"), "text")
    passages = decontamination._read(clean, block).filter("n IS NULL")
    texts = [(t or "").split() for _, t in docs]
    holding = [w for w in texts for k in range(0, max(1, len(w) - 16), 16) if {"w1", "w2", "w3"} & set(w[k : k + 32])]
    assert passages.count() == len(holding) > 600  # none holds the item
    monkeypatch.setattr(decontamination, "SAMPLE", 64)
    drawn = [sorted(map(tuple, decontamination._sampled(decontamination._read(clean.repartition(n), block)).collect())) for n in (1, 5)]
    assert 32 <= len(drawn[0]) <= 64 and drawn[0] == drawn[1]
    same = frame(docs[:1] * 200).select(F.col("doc_id").alias("id"), "text")
    assert decontamination._sampled(decontamination._read(same, block)).count() <= 64
    weight = np.ones(len(block.vocabulary), np.float32)
    space = decontamination.latent_space(passages, block, weight, 1)
    assert np.abs(space[block.vocabulary[b"w1"]]) > np.abs(space[block.vocabulary[b"q1"]])  # the corpus's words lead


def test_passages_are_retrieved_in_the_latent_space_only(frame, leaks, monkeypatch):
    """The bound by words sees passages that the latent space gave, and no others."""

    def unwanted(*_):
        raise AssertionError("asked about a passage that was not retrieved")

    monkeypatch.setattr(decontamination, "_held", unwanted)
    items, docs, _ = leaks
    assert decontamination.find(frame(docs), frame(items, "item_id long, text string"), cosine=1.5).count() == 0


def test_short_items_in_long_foreign_text(frame, monkeypatch):
    """Items of 3 to 10 words, whole or without a word: all are found, and as if every passage were scored."""
    random, docs, expected = Random(8), [], set()
    items = [(i, " ".join(f"s{i}k{k}" if k % 2 else f"w{random.randrange(40)}" for k in range(3 + i % 8))) for i in range(48)]
    for d in range(240):
        words = [f"f{random.randrange(10**6)}" if k % 9 else f"w{random.randrange(40)}" for k in range(random.choice([40, 150, 400]))]
        if d % 2:
            i = d // 2 % 48
            leak = items[i][1].split()
            del leak[len(leak) // 2 : len(leak) // 2 + (d % 3 == 0 and len(leak) > 5)]
            at = random.randrange(len(words))
            words[at:at] = leak
            expected.add((d, i))
        docs.append((d, " ".join(words)))
    benchmark = frame(items, "item_id long, text string")
    found = {(r.id, r["item"]) for r in decontamination.find(frame(docs), benchmark).collect()}
    assert expected <= found
    monkeypatch.setattr(decontamination, "_held", lambda lists, *_: __import__("numpy").ones(len(lists), bool))
    every = {(r.id, r["item"]) for r in decontamination.find(frame(docs), benchmark).collect()}
    assert expected <= every


@pytest.mark.parametrize("block", [1, 15, 2000])
def test_hits_do_not_depend_on_other_items(frame, block):
    """Words of a short item spread over foreign ones are no leak of it, whichever long item shares its block; leaks are found in any."""
    short, long = " ".join(f"s{k}" for k in range(10)), " ".join(f"l{k}" for k in range(3000))
    spread = " ".join(f"s{k // 150}" if k % 150 == 0 else f"f{k}" for k in range(1500))
    items = [(1, short), (2, long), *[(10 + k, prose(900 + k, 20, 4000)) for k in range(14)]]
    docs = [(1, spread), (2, f"f1 f2 {short} f3"), (3, f"f4 {long}"), (4, f"f5 {items[5][1]} f6")]
    found = decontamination.find(frame(docs), frame(items, "item_id long, text string"), block=block).collect()
    assert {(r.id, r["item"]) for r in found} == {(2, 1), (3, 2), (4, items[5][0])}


def test_leaks_among_null_ids(frame):
    """Documents without id are marked together, as those of one id; items without id are looked for."""
    items = frame([(None, prose(70, 12, 5000)), (5, prose(71, 12, 5000))], "item_id long, text string")
    docs = frame([(None, f"x {prose(70, 12, 5000)} y"), (1, f"x {prose(71, 12, 5000)}"), (2, "x y")])
    marked = decontamination.mark(docs, decontamination.find(docs, items)).collect()
    assert {(r.doc_id, r.contaminated, r["items"]) for r in marked} == {(None, True, ""), (1, True, "5"), (2, False, "")}


def test_decontamination_without_rows(frame):
    benchmark = frame([(1, "a b c")], "item_id long, text string")
    assert decontamination.find(frame([]), benchmark).count() == 0
    assert decontamination.find(frame([(1, "a b c")]), benchmark.limit(0)).count() == 0
    assert decontamination.mark(frame(ODD), decontamination.find(frame(ODD), benchmark)).filter("contaminated").count() == 0


# --- mixing ---


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    full, left = {}, float(sum(sizes.values()))
    while True:
        among = sum(weight[s] for s in names if s not in full)
        over = [s for s in names if s not in full and weight[s] * left / among > 3 * sizes[s]] if among else []
        if not over:
            return {s: full.get(s, weight[s] * left / among if among else 0.0) for s in names}
        for s in over:
            full[s] = 3.0 * sizes[s]
            left -= full[s]


def test_mixing(frame):
    random = Random(4)
    rows = [(i, prose(i, random.choice([0, 1, 5, 30, 200])), random.choice(["b", "b", "b", "b", "a", "é", "", None, "z"]) if i > 6 else "tiny") for i in range(900)]
    rows += [(5000, None, "tiny"), (5001, None, "wordless")]
    docs = frame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    found = [r.asDict() for r in mixing.mix(docs, carry=("source",), block=50).collect()]
    assert len(found) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    expected = brute_targets(sizes)
    by_source = defaultdict(list)
    for r in found:
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3 and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(expected[r["source"]])
        by_source[r["source"]].append(r)
    for source, group in by_source.items():
        times = expected[source] / sizes[source] if sizes[source] else 0
        assert abs(sum(r["taken"] for r in group) - expected[source]) <= 200
        assert abs(sum(r["copies"] for r in group) - times * len(group)) <= 2
    again = mixing.mix(docs.repartition(7), carry=("source",), block=50)
    assert sorted(map(repr, (r.asDict() for r in again.collect()))) == sorted(map(repr, found))
    in_levels = mixing.mix(docs, block=4)
    assert in_levels.count() == len(rows) and in_levels.filter("copies > 3 or copies < 0").count() == 0


def test_mixing_odd(frame):
    docs = frame([(i, t, None) for i, t in ODD], "doc_id long, text string, source string")
    assert all(r.copies == 1 for r in mixing.mix(docs).collect())
    assert mixing.mixed_rows(docs).count() == len(ODD)
    assert mixing.mix(docs.limit(0)).count() == 0
    taken = mixing.mixed_rows(frame([(1, "a", "s"), (1, "a", "s"), (2, "b c", "t")], "doc_id long, text string, source string").withColumn("alike", F.lit(9)).withColumn("size", F.lit("x")))
    assert set(taken.columns) >= {"alike", "copies", "size", "mix_size"} and taken.agg(F.sum("taken")).first()[0] in (3, 4, 5)


def test_flight_keeps_both_totals():
    import numpy as np

    rng = np.random.default_rng(1)
    size, share = rng.integers(0, 500, 1000).astype(float), rng.random(1000)
    flown = mixing.flight(size, share, rng)
    assert ((flown > 0) & (flown < 1)).sum() <= 2
    assert flown.sum() == pytest.approx(share.sum()) and (size * flown).sum() == pytest.approx((size * share).sum())


# --- language and quality ---

TONGUES = {"it": "della gente che parla", "de": "und der nicht auch schön", "fr": "où les étés sont très", "xx": "qqq zzz vvv kkk"}


def spoken(tongue, seed, n=30):
    random = Random(seed)
    return " ".join(random.choices(TONGUES[tongue].split(), k=n)) + random.choice([".", "!!", " ###"])


def test_language(frame):
    learned = [(i, spoken(t := list(TONGUES)[i % 4], i), t) for i in range(200)]
    docs = frame([*learned, (900, None, "it"), (901, "x", None)], "doc_id long, text string, lang string")
    model = language.fit(docs)
    asked = [(i, spoken(list(TONGUES)[i % 4], i).upper()) for i in range(1000, 1100)]
    found = {r.doc_id: r for r in language.predict(frame([*asked, *ODD, (77, "12 !? 34")]).withColumn("score", F.lit(1)), model).collect()}
    assert all(found[i].lang_pred == list(TONGUES)[i % 4] and 0.5 < found[i].score <= 1 for i, _ in asked)
    assert all(found[i].lang_pred == "und" and found[i].score == 0 and found[i].ambiguous for i in (1, 2, 3, 77))
    assert found[6].lang_pred in TONGUES
    only = language.fit(docs.filter("lang = 'it'"))
    assert {r.lang_pred for r in language.predict(frame(asked), only).collect()} == {"it"}
    assert language.fit(docs.limit(0)) is None
    assert {r.lang_pred for r in language.predict(frame(asked), None).collect()} == {"und"}
    assert language.predict(frame([]), model).count() == 0


@pytest.mark.parametrize("classes", range(9))
def test_codewords_are_apart(classes):
    code = language.codewords(classes)
    assert len(code) == classes and (classes < 2 or min((a != b).sum() for i, a in enumerate(code) for b in code[:i]) >= max(1, code.shape[1] // 4))


def test_quality(frame, spark):
    texts = {i: prose(i, 60).upper() + " $$$" if i % 5 == 0 else prose(i, 60) for i in range(400)}
    docs = frame(list(texts.items()))
    labels = frame([*[(i, int(i % 5 > 0), 0) for i in range(0, 400, 2)], (7777, 1, 0), (3, None, 1)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    assert 0.7 < model.prior < 0.9
    found = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) == (i % 5 > 0) for i, r in found.items())
    unmarked = quality.fit(docs, labels.filter("quality = 1"))
    scores = {r.doc_id: r.score for r in quality.score(docs, unmarked).collect()}
    ranked = sorted(scores, key=scores.get)
    assert sum(i % 5 == 0 for i in ranked[:80]) >= 76
    assert {r.predicted for r in quality.score(docs, quality.fit(docs, labels.limit(0))).collect()} == {0}
    odd = quality.score(frame(ODD).withColumn("score", F.lit("clash")), model)
    assert odd.count() == len(ODD) and len({r.score for r in odd.filter("doc_id in (1, 2)").collect()}) == 1
    assert quality.score(frame([]), quality.fit(frame([]), labels)).count() == 0


# --- SimHash ---


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(spark):
    for text in [None, "", " \n", "Uno", "uno DUE", "uno due tre", "É é A b c d", prose(1, 500), "a b c " * 40]:
        assert simhash.fingerprint(text) == brute_print(text)
    native = spark.sql("SELECT xxhash64('w1 w2 w3')").first()[0]
    assert simhash.fingerprint("W1 w2 w3") == native % (1 << 64)


def brute_classes(nodes):
    parent = {n: n for n in nodes}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ordered = sorted(nodes)
    count = 0
    for i, a in enumerate(ordered):
        for b in ordered[:i]:
            if ((a ^ b) % (1 << 64)).bit_count() <= 2:
                count += 1
                parent[find(a)] = find(b)
    return {n: find(n) for n in nodes}, count


@pytest.mark.parametrize("bucket", [2, 512])
def test_links_and_components(spark, bucket):
    """Random clusters, some with one half in common to many: small buckets force every level of the cut."""
    random = Random(9)
    nodes = set()
    for _ in range(30):
        base = random.getrandbits(64)
        nodes |= {base, *[base ^ sum(1 << random.randrange(64) for _ in range(random.randrange(4))) for _ in range(6)]}
    half = random.getrandbits(32)
    nodes |= {half << 32 | random.getrandbits(32) for _ in range(60)} | {half << 32 | random.getrandbits(6) for _ in range(40)}
    signed = [n - (1 << 64) if n >> 63 else n for n in nodes]
    expected, count = brute_classes(signed)
    links = simhash.links(spark.createDataFrame([(n,) for n in signed], "fp long").repartition(3), bucket)
    pairs = {tuple(sorted(r)) for r in links.collect()}
    assert len(pairs) == count and all(((a ^ b) % (1 << 64)).bit_count() <= 2 for a, b in pairs)
    roots = {r.node: r.root for r in components.components(links).collect()}
    classes = defaultdict(set)
    for n in signed:
        classes[expected[n]].add(n)
    assert all({roots.get(n, n) for n in members} == {min(members)} for members in classes.values())


def test_a_long_chain_is_one_component(spark):
    edges = spark.range(1, 500).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    assert {r.root for r in components.components(edges).collect()} == {0}


def test_simhash_groups(frame):
    base = prose(5, 300)
    docs = [*ODD, (10, base), (11, base.upper()), (12, base + " end"), (13, prose(6, 300)), (9, None)]
    found = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.group(frame(docs).withColumn("fp", F.lit("clash"))).collect()}
    assert found[1, "0" * 16] == found[9, "0" * 16] == found[3, "0" * 16] == 1
    assert all(f == f"{brute_print(dict(docs)[i]):016x}" for i, f in found if i and i != 4)
    assert {c for (i, _), c in found.items() if i in (10, 11)} == {10}
    assert {c for (i, _), c in found.items() if i is None} == {4}
    assert simhash.group(frame([])).count() == 0


# --- repeated passages ---


def brute_repeats(rows):
    seen, places = {}, defaultdict(set)
    for i, text in sorted(((i, t) for i, t in rows), key=lambda r: r[0]):
        words = (text or "").encode().split()
        for k in range(len(words) - 19):
            window = tuple(words[k : k + 20])
            if window in seen and seen[window] != (i, k):
                places[i] |= set(range(k, k + 20))
            seen.setdefault(window, (i, k))
    out = []
    for i, text in rows:
        words = (text or "").encode().split()
        rest = [w for k, w in enumerate(words) if k not in places[i]]
        out.append((i, len(words), len(words) - len(rest), sha256(b" ".join(rest)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_repeats_against_brute_force(frame, seed):
    random = Random(seed)
    passages = [prose(100 + k, random.choice([19, 20, 21, 35, 60])) for k in range(6)]
    rows = []
    for i in range(60):
        parts = [prose(1000 * seed + 10 * i + k, random.choice([0, 3, 10, 40]), random.choice([2, 400])) for k in range(4)]
        parts.insert(random.randrange(4), random.choice(passages))
        parts.insert(random.randrange(4), random.choice(passages)[random.randrange(40) :])
        rows.append((i, " ".join(parts)))
    rows += [(100, rows[0][1]), (101, rows[0][1]), (102, rows[0][1].replace(" ", "\n")), (103, None), (104, ""), (105, "a " * 300), (106, "a " * 19)]
    found = substring_dedup.remove_repeats(frame(rows).withColumn("key", F.lit("clash")).withColumn("unique", F.lit(1)))
    assert sorted(map(tuple, found.select("doc_id", "n_words", "n_removed", "kept_sha256").collect())) == brute_repeats(rows)
    one = next(r for r in found.collect() if r.doc_id == 105)
    assert one.factors == "1:299" and one.kept_text == "a"


def test_repeats_among_repeated_and_null_ids(frame):
    """Documents that share an id, or have none, are told apart by their text and ordered by its hash."""
    random, rows = Random(12), []
    passages = [prose(60 + k, 35) for k in range(4)]
    for k in range(60):
        parts = [prose(2000 + k, random.choice([0, 5, 200]), 5000), random.choice(passages), prose(3000 + k, random.choice([0, 30]), 5000)]
        rows.append((random.choice([None, None, 1, 2, 2, 5 + k]), " ".join(parts)))
    rows += [(1, prose(1, 200)), (1, prose(2, 30)), (None, None), (None, ""), (None, prose(1, 200)), rows[0], rows[0]]
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, 42 if r[1] is None else (xxh64_intdigest(r[1].encode(), 42) ^ 1 << 63) - (1 << 63)))
    numbers = {row: k for k, row in enumerate(order)}
    expected = {i: rest for i, *rest in brute_repeats([(k, t) for k, (_, t) in enumerate(order)])}
    found = substring_dedup.remove_repeats(frame(rows)).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert rows_of(found) == sorted(((i, *expected[numbers[i, t]]) for i, t in rows), key=repr)


def test_repeats_odd(frame):
    rows = [*ODD, (7, prose(1, 50)), (7, prose(1, 50)), (8, prose(1, 50))]
    found = rows_of(substring_dedup.remove_repeats(frame(rows)).select("doc_id", "n_words", "n_removed"))
    assert [r for r in found if r[0] in (7, 8)] == [(7, 50, 0), (7, 50, 0), (8, 50, 50)]
    # Three words over and over: only the first three words are in no window that has begun before.
    assert next(r for r in found if r[0] == 6) == (6, 15000, 15000 - 3)
    assert substring_dedup.remove_repeats(frame([])).count() == 0


# --- the pipeline ---


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no test tables")
def test_pipeline(spark, tmp_path):
    data = "/root/testdata/sf0.01"
    documents = spark.read.parquet(f"{data}/documents.parquet")
    out = corpus_pipeline.run(spark, data, str(tmp_path / "stages"))
    rows = out.toPandas()
    stages = [spark.read.parquet(str(tmp_path / f"stages/{k}")).toPandas() for k in range(5)]
    assert all(list(s.columns) == documents.columns for s in stages[:4])
    counts = [documents.count(), *map(len, stages)]
    assert counts == sorted(counts, reverse=True) and counts[1] > 0.7 * counts[0]
    labels = spark.read.parquet(f"{data}/labels.parquet").toPandas().set_index("doc_id").quality
    accepted = set(stages[0].doc_id)
    assert sum((i in accepted) == bool(q) for i, q in labels.items()) >= 0.95 * len(labels)
    assert len(stages[1]) == stages[0].text.nunique() and set(stages[1].doc_id) == set(stages[0].groupby("text").doc_id.max())
    prints = {i: simhash.fingerprint(t) for i, t in zip(stages[1].doc_id, stages[1].text, strict=True)}
    classes, _ = brute_classes(list(set(prints.values())))
    assert set(stages[2].doc_id) == {min(i for i in prints if classes[prints[i]] == c) for c in set(classes.values())}
    items = [" ".join(x.decode() for x in decontamination.tokens(r.text)) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    leaked = {i for i, t in zip(stages[2].doc_id, stages[2].text, strict=True) if any(q in " ".join(x.decode() for x in decontamination.tokens(t)) for q in items)}
    assert set(stages[2].doc_id) - set(stages[3].doc_id) == leaked
    assert (rows.copies > 0).all() and (rows.taken == rows.copies * rows["size"]).all() and set(rows.doc_id) <= set(stages[3].doc_id)
    for _, group in rows.groupby("source"):
        assert abs(group.taken.sum() - group.target.iloc[0]) <= stages[3].text.str.split().str.len().max()


def test_stages_tell_rows_without_id_apart(spark, frame):
    """Rows without id, or of one id, go for their own text only; of rows in one group one stays."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    leak = next(r.text for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").orderBy("item_id").collect())
    clean, near = prose(1, 300), prose(1, 300) + " end"
    assert (simhash.fingerprint(clean) ^ simhash.fingerprint(near)).bit_count() <= 2
    other = prose(2, 300, 5000)
    rows = [(None, leak), (None, clean), (None, near), (7, other), (7, f"{other[:900]} {leak}"), (8, near + " ")]
    docs = frame([(i, t, None, None, None) for i, t in rows], schema)
    kept_near = corpus_pipeline.near_stage(spark, docs, "").collect()
    assert len(kept_near) == 4 and sum(r.text.startswith(clean) for r in kept_near) == 1
    assert next(r for r in kept_near if r.text.startswith(clean)).doc_id is None
    kept_clean = corpus_pipeline.decontamination_stage(spark, docs, "/root/testdata/sf0.001").collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept_clean))) == sorted(map(str, [rows[1], rows[2], rows[3], rows[5]]))


def test_stages_take_odd_tables(spark, frame):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = frame([(i, t, None, s, None) for i, t in ODD for s in ("a", None)], schema).withColumn("score", F.lit("x")).withColumn("key", F.lit("y"))
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "/root/testdata/sf0.001")
            assert out.columns[: len(docs.columns)] == docs.columns and out.count() <= docs.count(), name
