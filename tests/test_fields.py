"""The rule chains against a brute-force search with Python's own regex engine."""

import random
import re
import time
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from fiscalframe import ExtractionRules, extract_fields
from fiscalframe.functions.dialect import to_java
from fiscalframe.functions.literals import required_words
from fiscalframe.functions.text import clean_capture
from fiscalframe.operators.fields import first_captures
from fiscalframe.operators.rules import DATE_FORMATS, FIELDS, PATTERNS, RUN_FORMS, narrowed

PIECES = [
    "fattura", "FATTURA N.", "Ricevuta", "nota di credito", "documento", "ddt", "numero", "n.", "protocollo:", "Data:", "data",
    "del", "emissione", "totale", "Importo", "TOT.", "€", "eur", "Euro", "usd", "Fornitore:", "dal", "Mittente", "spett.le",
    "Ragione Sociale", "ditta", "società", "societa", "S.r.l.", "s.p.a.", "P.IVA", "p. iva", "partita iva", "cod. fisc.",
    "codice fiscale", "via ", "indirizzo", "tel", "email", "|", "\\n", "-", "--", "−", "(", ")", ".", ",", ":", ";", "/",
    "1.234,56", "12,5", "450,00", "1234.56", "15/03/2024", "1.2.99", "2024-3-5", "15 marzo 2024", "31-02-2023", "01234567890",
    "123456789012", "INV-7/A", "١٢", "x", "Àé", "é", "²", "_", " ", " ", "\u001c", "\x0b", "\t",
    "\r\n", "\n", "\n\n", "fattura", "mi̇ttente", "İmporto", "ımporto", "preſtatore", "K", "DİTTA",
]


def brute_clean(value):
    value = value.strip()
    while value and (value[0].isspace() or value[0] in ".,;:"):
        value = value[1:]
    while value and (value[-1].isspace() or value[-1] in ".,;:"):
        value = value[:-1]
    dashes = len(value) - len(value.lstrip("-"))
    if dashes:
        rest = value[dashes:].lstrip()
        number = rest[:1].isdecimal() or rest[:1] == "("
        value = value[dashes - 1 if number and dashes > 1 else 0 if number else dashes :]
    return value.rstrip("-").strip()


def brute_first(text, patterns):
    for pattern in patterns:
        match = re.search(pattern, text, re.I | re.M | re.S)
        if match and (value := brute_clean(match.group(1) or "")):
            return value
    return None


def random_texts(n, seed):
    rng = random.Random(seed)
    return [
        "".join(rng.choice(PIECES) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.randint(0, 25))) for _ in range(n)
    ]


def test_published_rules_are_as_they_were():
    """Everything else here compares with PATTERNS itself; this tells if one is lost or mistyped."""
    assert sha256(repr((PATTERNS, DATE_FORMATS)).encode()).hexdigest() == "1e1195d02e7619d30c7edf6504fb681df36263a051fe1357402bec92e4ed7fcc"


def test_chains_equal_brute_force(spark):
    texts = random_texts(6000, 7)
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(8)
    got = {r.i: r for r in first_captures(rows, "text", ExtractionRules()).collect()}
    hits = 0
    for i, text in enumerate(texts):
        for field in FIELDS:
            expected = brute_first(text, PATTERNS[field])
            hits += expected is not None
            assert got[i][field] == expected, (field, text)
    assert hits > 10000


def test_every_pattern_by_itself_equals_python(spark):
    texts = random_texts(1500, 11)
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(8)
    for field in FIELDS:
        for pattern in PATTERNS[field]:
            rules = ExtractionRules({name: (pattern,) for name in FIELDS})
            got = {r.i: r[field] for r in first_captures(rows, "text", rules, (field,)).collect()}
            for i, text in enumerate(texts):
                assert got[i] == brute_first(text, [pattern]), (pattern, text)


@pytest.mark.parametrize(
    "pattern",
    [
        r"(?P<word_1>\w+)-(?P=word_1)", r"(\w{,3})\b", r"([^\W\d]+)\Z", r"(a{x}|\{)", r"([[&&]+)", r"(?#note)(\S+\v?)", r"([]x]+)",
        r"(?i:FATT)(\w)", r"(\D\B.)", r"([\s\w]+)$", r"( |\x41|\N{EURO SIGN})", r"(\0|\U00000041|[\b]|,)", r"^(.+?n)", r"^(.+?n)|(b)",
    ],
)
def test_dialect(spark, pattern):
    texts = [*random_texts(150, 3), "ab-ab", "a{x}", "[[&", "]x]", "a\x00", "n\nan", "b\nxn", "\x08"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: r.v for r in rows.select("i", F.regexp_extract("text", to_java(pattern), 1).alias("v")).collect()}
    for i, text in enumerate(texts):
        match = re.search(pattern, text, re.I | re.M | re.S)
        assert got[i] == ((match.group(1) or "") if match else ""), text


def test_dialect_rejects_what_java_lacks():
    for pattern in (r"(a)?(?(1)b|c)", r"(?x)( a )", r"(?a:(\w))"):
        with pytest.raises(ValueError):
            to_java(pattern)


def test_clean_capture(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(" \t\n-.,;:(5a ") for _ in range(rng.randint(0, 9))) for _ in range(5000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.c for r in rows.select("i", clean_capture(F.col("t")).alias("c")).collect()}
    for i, text in enumerate(texts):
        assert got[i] == brute_clean(text), repr(text)


CAPTURES = [
    ("Fattura elettronica x", "invoice_number", "elettronica"),
    ("Fattura numero 5", "invoice_number", "umero"),
    ("Fattura NC-1", "invoice_number", "C-1"),
    ("Emessa 15 marzo 2024 a", "date", "15"),
    ("ip 10.20.30.40 e 70.1.2024", "date", "10.20.30"),
    ("Totale 1250,00", "total", 125.0),
    ("Totale 1234.56", "total", 123.0),
    ("(Totale 450,00) fine", "total", None),
    ("Totale da pagare: 12,50", "total", 12.5),
    ("Fornitore: Olivia Rossi", "supplier_name", "Oli"),
    ("riga uno\nriga due\nBeta S.r.l. Milano", "supplier_name", "riga uno\nriga due\nBeta S.r.l"),
    ("x 123456789012 - y", "vat_number", "23456789012"),
    ("P.IVA: IT01234567890", "vat_number", "01234567890"),
    ("nulla", "vat_number", None),
]


def test_known_captures(spark):
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CAPTURES)], "i int, text string")
    got = {r.i: r for r in extract_fields(rows).collect()}
    for i, (text, field, expected) in enumerate(CAPTURES):
        assert got[i][field] == expected, text


def test_custom_rules_come_first(spark):
    rules = ExtractionRules().merge({"invoice_number": r"CODICE\s+(\S+)", "altro": "x"})
    assert rules.patterns["invoice_number"] == (r"CODICE\s+(\S+)", *PATTERNS["invoice_number"])
    rows = spark.createDataFrame([("Fattura n. 7\ncodice Z9",), ("Fattura n. 7",)], "text string")
    assert [r.invoice_number for r in extract_fields(rows, rules=rules).collect()] == ["Z9", "7"]
    moved = ExtractionRules().merge({"total": [PATTERNS["total"][3], "(x)"]}, ["%Y%m%d", "%d.%m.%Y", "%m-%Y"])
    assert moved.patterns["total"] == (PATTERNS["total"][3], "(x)", *PATTERNS["total"][:3], *PATTERNS["total"][4:])
    assert moved.date_formats[:3] == ("%m-%Y", "%Y%m%d", "%d/%m/%Y")
    assert ExtractionRules().patterns["total"] == PATTERNS["total"]


@pytest.mark.parametrize("pattern", ["(", "nessun gruppo", r"(?x)(a)"])
def test_bad_rules_are_rejected(pattern):
    with pytest.raises(ValueError, match="Espressione regolare non valida per 'total'"):
        ExtractionRules().merge({"total": [pattern]})


def test_filters_reach_the_scan_and_do_not_repeat_the_extraction(spark, tmp_path):
    spark.createDataFrame([("Totale 5,00", "it"), ("Totale 6,00", "en")], "text string, lang string").write.parquet(str(tmp_path / "t"))
    found = extract_fields(spark.read.parquet(str(tmp_path / "t"))).filter("lang = 'it' and total > 0 and invoice_number is null")
    assert found.count() == 1
    plan = found._jdf.queryExecution()
    assert plan.optimizedPlan().toString().count("protocollo[.:]?") == 1
    assert "EqualTo(lang,it)" in plan.executedPlan().toString()


def test_only_wanted_fields_are_extracted(spark):
    rows = spark.createDataFrame([("Totale 5,00",)], "text string")
    found = extract_fields(rows, fields=("total",))
    assert found.columns == ["text", "total", "total_dec"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "totale" in plan and "fornitore" not in plan and "protocollo" not in plan


def test_wide_gaps_cost_little(spark):
    """Every anchor of every field before thousands of spaces and nothing that fits."""
    anchors = [piece for piece in PIECES if piece.strip() and piece.isascii()] + ["nota", "nota di", "importo totale", "totale da", "p.", "cod.", "ragione", "spett", "12", "01234567890"]
    texts = [f"{a}{' ' * 5000}x" for a in anchors] + [f"{a}{' ' * 2500}:{' ' * 2500}(x" for a in anchors]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(8)
    first_captures(rows.limit(1), "text", ExtractionRules()).collect()
    start = time.perf_counter()
    first_captures(rows, "text", ExtractionRules()).collect()
    assert time.perf_counter() - start < 20  # all of them; one alone took hours


SUPPLIER_PIECES = [
    "ditta", "Ditta:", "società", "ragione sociale", "ragione", "denominazione.", "spett.le", "spett le", "spettle", "dal", "fornitore", "preſtatore",
    "via ", "via", "|", "\\n", "c/a.", "c", "p. iva", "piva", "cod fisc", "tel", "S.r.l.", "x", "Casa", ":", ".", " ", "\n", "  ", "\u00a0",
]


def test_captures_hold_wide_gaps_as_they_stand(spark):
    """Gaps of one blank to hundreds, within captures, too; custom rules may count the blanks."""
    rng = random.Random(12)
    gaps = ["", " ", "  ", " " * 15, " " * 16, " " * 17, " " * 31, " " * 47, " " * 300, " " * 20 + "\t" + " " * 20, "\n" + " " * 40]
    texts = ["".join(rng.choice(PIECES) + rng.choice(gaps) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    texts += [f"Totale{a}({b}-{c}12{d}){e}x" for a in gaps for b, c, d, e in [rng.choices(gaps, k=4) for _ in range(4)]]
    texts += [f"Fornitore:{a}Casa{b}Rossi{c}|" for a in gaps for b in gaps for c in gaps[:4]]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(8)
    rules = ExtractionRules().merge({"invoice_number": [r"codice {20,}(\S+)", r"numero {18}(x)"], "supplier_name": r"(emissione                    x)"})
    got = {r.i: r for r in first_captures(rows, "text", rules).collect()}
    for i, text in enumerate(texts):
        for field in FIELDS:
            custom = [p for p in rules.patterns[field] if p not in PATTERNS[field]]
            assert got[i][field] == brute_first(text, [*custom, *RUN_FORMS[field]]), (field, text)


def test_rules_search_few_blanks(spark):
    """However wide the gaps, most rules read tens of blanks only."""
    rows = spark.createDataFrame([("a" + " " * 3000 + "b c",)], "text string")
    assert [r.n for r in rows.select(F.length(narrowed("text")).alias("n")).collect()] == [1 + 60 + 3]


def test_rules_equal_python_among_many_anchors(spark):
    """Texts of little but anchors and stops, in which later anchors follow the first one with and without a stop between."""
    rng = random.Random(23)
    texts = ["".join(rng.choice(SUPPLIER_PIECES) + rng.choice(["", " "]) for _ in range(rng.randint(0, 12))) for _ in range(8000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(8)
    for pattern in PATTERNS["supplier_name"]:
        got = {r.i: r.supplier_name for r in first_captures(rows, "text", ExtractionRules({name: (pattern,) for name in FIELDS}), ("supplier_name",)).collect()}
        for i, text in enumerate(texts):
            assert got[i] == brute_first(text, [pattern]), (pattern, text)


def test_many_anchors_cost_little(spark):
    """100,000 times each anchor, without a stop after any of them: linear for every rule."""
    anchors = [piece for piece in PIECES if piece.strip() and piece.isascii()] + ["ditta ", "spett.le a ", "società:", "ragione sociale ", "denominazione. ", "nota ", "p. ", "cod. ", "1 ", "12345678901 ", "n.", "data: 1"]
    first_captures(spark.createDataFrame([("x",)], "text string"), "text", ExtractionRules()).collect()
    for anchor in anchors:
        rows = spark.range(1).select(F.expr(f"repeat('{anchor.replace(chr(92), chr(92) * 2)}', 100000)").alias("text"))
        start = time.perf_counter()
        first_captures(rows, "text", ExtractionRules()).collect()
        assert time.perf_counter() - start < 10, anchor  # most of it planning; the quadratic forms took hours


def test_run_forms_equal_the_published_rules():
    """With Python's own engine, which knows possessive runs too, on texts with wide gaps."""
    rng = random.Random(13)
    for field in FIELDS:
        for pattern, form in zip(PATTERNS[field], RUN_FORMS[field], strict=True):
            slow, fast = (re.compile(p, re.I | re.M | re.S) for p in (pattern, form))
            for text in random_texts(4000, rng.random()):
                text = re.sub(" ", lambda _: " " * rng.choice([1, 1, 1, 2, 9]), text)
                a, b = slow.search(text), fast.search(text)
                assert brute_clean(a.group(1) or "" if a else "") == brute_clean(b.group(1) or "" if b else ""), (pattern, text)


CUSTOM = {
    r"(?:fattura|nota)\s+numero\s*(\S+)": {"numero"}, r"[Tt]ot(?:ale)?[.:]?\s*€?\s*([\d.,]+)": {"tot"}, r"p\.?\s*iva\s*([\d]+)": {"iva"},
    r"(?:IMPORTO|data){2,}.*?(\d+)": {"importo", "data"}, r"(?P<what>ditta)\s(\w+)": {"ditta"}, r"del(?=\s)\s+(\S+)": {"del"}, r"(?>società|eur)o?\s*(\d+)": {"societ", "eur"},
    r"(?:fattura)?\s*(\d{3})": None, r"(\d+)[/-](\d+)": None, r"(x|tel)\s*(.)": None, r"(?<!dal )ditta\s(.)": {"ditta"}, r"(\|.|(?:tel\s)+)email": {"email"},
}


def test_custom_rules_are_tried_where_their_words_stand(spark):
    """Every custom rule with a literal part gets a test for it, and results stay Python's."""
    assert {p: set(required_words(p) or ()) or None for p in CUSTOM} == CUSTOM
    texts = random_texts(3000, 17)
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(8)
    hits = 0
    for pattern in CUSTOM:
        rules = ExtractionRules({name: (pattern,) for name in FIELDS})
        got = {r.i: r.total for r in first_captures(rows, "text", rules, ("total",)).collect()}
        for i, text in enumerate(texts):
            expected = brute_first(text, [pattern])
            hits += expected is not None
            assert got[i] == expected, (pattern, text)
    assert hits > 2000


def test_required_words_are_in_every_match():
    """Published rules and random patterns: a match without one of the words would be lost."""
    rng = random.Random(41)
    atoms = ["a", "B", "cd", "[Aa]", "[ab]", r"\d", ".", "(?:ab|cd)", "(?:a|bcd)", "(ab)", "(?:cd)?", "(?:ab)+", "(?:ab){2}", r"\s*", "(?=c)", "(?!d)", "(?i:Ab)", "^", "x{0}", "(?:ab(?:c|dd))"]
    patterns = ["".join(rng.choice(atoms) for _ in range(rng.randint(1, 6))) for _ in range(1500)]
    patterns += [f"{a}|{b}" for a, b in zip(patterns[:300], patterns[300:600], strict=True)]
    texts = ["".join(rng.choice(["a", "b", "c", "d", "ab", "cd", "A", "D", " ", "1"]) for _ in range(rng.randint(0, 12))) for _ in range(150)]
    known = 0
    for pattern, some in [*((p, texts) for p in patterns), *((p, random_texts(300, 19)) for ps in PATTERNS.values() for p in ps)]:
        words = required_words(pattern)
        known += words is not None
        for text in some:
            if words and re.search(pattern, text, re.I | re.M | re.S):
                assert any(w in text.lower() for w in words) or set(text) & set("\u017f\u0131\u0130\u212a"), (pattern, text)
    assert known > 800


def test_options(spark):
    rows = spark.createDataFrame([("Totale 1250,00, emessa il 15 marzo 2024",), ("Totale 1.250,00 del 3/4/2024, poi 15 marzo 2024",)], "text string")
    plain = [(r.total, r.date) for r in extract_fields(rows).collect()]
    asked = [(r.total, r.date) for r in extract_fields(rows, rules=ExtractionRules().with_options(True, True)).collect()]
    assert plain == [(125.0, "15"), (1250.0, "2024-04-03")] and asked == [(1250.0, "2024-03-15"), (1250.0, "2024-04-03")]
