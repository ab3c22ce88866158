"""Expected results of the registered queries, as SQL for DuckDB."""

from __future__ import annotations

from fiscalframe.operators.rules import FIELDS, PATTERNS

# --- rendered invoices: what must be read back is known from the order ----------

CORPUS = """
WITH numbered AS (
  SELECT o.*, c.c_name, o_orderkey % 14 AS k,
         '/archivio/' || strftime(o_orderdate, '%Y/%m') || '/ordine_' || o_orderkey || '.pdf' AS path,
         'ordine_' || o_orderkey || '.pdf' AS filename,
         CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS amount
  FROM orders o LEFT JOIN customer c ON o_custkey = c_custkey
), corpus AS (
  SELECT path, filename, k, o_orderkey,
         k <= 7 AS readable,
         CASE WHEN k <= 7 THEN CASE WHEN k IN (4, 5) THEN 'NC-' ELSE 'INV-' END || o_orderkey END AS invoice_number,
         CASE WHEN k <= 7 THEN strftime(o_orderdate, '%Y-%m-%d') END AS date,
         CASE WHEN k = 3 THEN 0.0::DOUBLE WHEN k IN (4, 5) THEN -amount WHEN k <= 7 THEN amount END AS total,
         CASE WHEN k <= 7 THEN coalesce(c_name, 'Ignoto') || ' S.r.l' END AS supplier_name,
         CASE WHEN k <= 7 AND k <> 6 THEN lpad(CAST(o_custkey AS VARCHAR), 11, '0') END AS vat_number,
         CASE k WHEN 8 THEN 'Nessun testo estraibile da ' || filename || ': probabilmente è una scansione. Serve un OCR.'
                WHEN 9 THEN 'Il file è vuoto (0 byte): ' || filename
                WHEN 10 THEN 'PDF danneggiato o protetto da password: ' || filename || ' (No /Root object! - Is this really a PDF?)'
                WHEN 11 THEN 'File PDF non trovato: ' || path
                WHEN 12 THEN 'Il PDF non contiene pagine: ' || filename
                WHEN 13 THEN 'Errore imprevisto durante la lettura: accesso negato' END AS error,
         CASE k WHEN 8 THEN 'scanned' WHEN 9 THEN 'empty' WHEN 10 THEN 'corrupt' WHEN 11 THEN 'missing' WHEN 12 THEN 'corrupt'
                WHEN 13 THEN 'unexpected' END AS error_kind
  FROM numbered
), invoices AS (
  SELECT *, CASE WHEN k >= 8 THEN 'Errore' WHEN k = 6 THEN 'Incompleto' ELSE 'OK' END AS status_it,
         CASE WHEN k IN (4, 5) THEN 'Nota di credito' WHEN k <= 7 THEN 'Fattura' ELSE '' END AS document_type_it,
         CASE WHEN k >= 8 THEN error WHEN k = 6 THEN 'Campi non trovati: partita IVA' ELSE '' END AS notes_it
  FROM corpus
), fatture AS (
  SELECT path, filename AS "File", coalesce(invoice_number, '') AS "Numero Fattura", coalesce(date, '') AS "Data",
         total AS "Totale", coalesce(supplier_name, '') AS "Fornitore", coalesce(vat_number, '') AS "Partita IVA",
         document_type_it AS "Tipo Documento", status_it AS "Esito", notes_it AS "Note"
  FROM invoices
), counts AS (
  SELECT count(*) AS processed, count(*) FILTER (k <= 7 AND k <> 6) AS ok, count(*) FILTER (k = 6) AS incomplete,
         count(*) FILTER (k >= 8) AS failed, count(*) FILTER (k IN (4, 5)) AS credit_notes,
         coalesce(CAST(sum(CAST(total AS DECIMAL(18,2))) AS DOUBLE), 0) AS grand_total
  FROM invoices
)
"""

_COUNT_LINES = """
SELECT 1 AS ordine, '{processed}' AS voce, CAST(processed AS VARCHAR) AS valore FROM counts
UNION ALL SELECT 2, '{ok}', CAST(ok AS VARCHAR) FROM counts
UNION ALL SELECT 3, '{incomplete}', CAST(incomplete AS VARCHAR) FROM counts {if_incomplete}
UNION ALL SELECT 4, '{failed}', CAST(failed AS VARCHAR) FROM counts {if_failed}
UNION ALL SELECT 5, 'Note di credito', CAST(credit_notes AS VARCHAR) FROM counts {if_credit}
"""
_RIEPILOGO = (
    _COUNT_LINES.format(
        processed="PDF elaborati",
        ok="Estratti correttamente",
        incomplete="Estratti parzialmente",
        failed="Non leggibili",
        if_incomplete="",
        if_failed="",
        if_credit="",
    )
    + """UNION ALL SELECT 6, '', ''
UNION ALL SELECT 7, 'Totale complessivo (€)', printf('%.2f', grand_total) FROM counts"""
)
_BATCH = {
    "processed": "Fatture elaborate",
    "ok": "Estratte correttamente",
    "incomplete": "Estratte parzialmente",
    "failed": "File non leggibili",
    "if_credit": "WHERE credit_notes > 0",
}
_CONSOLE = (
    _COUNT_LINES.format(**_BATCH, if_incomplete="", if_failed="")
    + "UNION ALL SELECT 6, 'Totale complessivo', '€ ' || format('{:,.2f}', grand_total) FROM counts"
)
_UPLOADS = """
  SELECT doc_id AS seq, CASE lang WHEN 'de' THEN doc_id || '.pdf' WHEN 'en' THEN doc_id || '.PDF'
         WHEN 'es' THEN doc_id || '.pdf.txt' ELSE '.pdf' END AS file_name FROM documents
"""
_SKIPPED = f"SELECT seq, file_name FROM ({_UPLOADS}) WHERE NOT regexp_matches(file_name, '(?i).\\.pdf$')"
_WEB = (
    "SELECT *, CAST(0 AS BIGINT) AS seq FROM ("
    + _COUNT_LINES.format(**_BATCH, if_incomplete="WHERE incomplete > 0", if_failed="WHERE failed > 0")
    + f"""UNION ALL SELECT 7, 'Totale complessivo', '€ ' || format('{{:,.2f}}', grand_total) FROM counts)
UNION ALL SELECT 6, 'File ignorati (non PDF)', file_name, seq FROM ({_SKIPPED})"""
)

_CSV_FIELDS = """"File", "Numero Fattura", "Data",
  CASE WHEN "Totale" IS NULL THEN '' ELSE replace(printf('%.2f', "Totale"), '.', ',') END,
  "Fornitore", "Partita IVA", "Tipo Documento", "Esito", "Note\""""
_CSV = f"""
SELECT 0 AS section, CAST(NULL AS VARCHAR) AS path,
       chr(65279) || 'File;Numero Fattura;Data;Totale;Fornitore;Partita IVA;Tipo Documento;Esito;Note' AS line
UNION ALL
SELECT 1, path, array_to_string(list_transform([{_CSV_FIELDS}],
  lambda v: CASE WHEN regexp_matches(v, '[;"\\r\\n]') THEN '"' || replace(v, '"', '""') || '"' ELSE v END), ';')
FROM fatture
UNION ALL SELECT 2, NULL, ''
UNION ALL SELECT 3, NULL, 'TOTALE COMPLESSIVO;;;' || replace(printf('%.2f', grand_total), '.', ',') || ';;;;;' FROM counts
"""

# --- prose: the rules in DuckDB's regex engine ----------------------------------

_SPACES = r"\t-\r\x{1c}- \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _re2(pattern: str) -> str:
    """The pattern with Unicode classes spelled out and without look-around."""
    if pattern.startswith("(?<!"):
        pattern = pattern.replace(r"(?<!\d)", r"(?:^|\D)").replace(r"(?!\d)", r"(?:\D|$)")
    for shorthand, spelled in (
        (r"\s", f"[{_SPACES}]"),
        (r"\S", f"[^{_SPACES}]"),
        (r"\d", r"\p{Nd}"),
        (r"\D", r"\P{Nd}"),
        (r"\w", r"\p{L}\p{N}_"),
    ):
        pattern = pattern.replace(shorthand, spelled)
    return "(?ims)" + pattern


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{_SPACES}]+|[{_SPACES}]+$', '', 'g')"


def _clean(x: str) -> str:
    edges = f"regexp_replace({x}, '^[{_SPACES}.,;:]+|[{_SPACES}.,;:]+$', '', 'g')"
    lead = (
        f"CASE WHEN regexp_matches({edges}, '^-+[{_SPACES}]*[\\p{{Nd}}(]') "
        f"THEN regexp_replace({edges}, '^-+', '-') ELSE regexp_replace({edges}, '^-+', '') END"
    )
    return _strip(f"regexp_replace({lead}, '-+$', '')")


def _chain(field: str, text: str = "text") -> str:
    tries = ", ".join(f"regexp_extract({text}, '{_re2(p)}', 1)" for p in PATTERNS[field])
    return f"list_filter(list_transform([{tries}], lambda v: {_clean('v')}), lambda v: v <> '')[1]"


def _number(x: str) -> str:
    """Value of an amount capture (digits only, at most two decimals)."""
    bare = f"regexp_replace({_strip(x)}, '[ \\x{{a0}}]', '', 'g')"
    opened = f"regexp_replace({bare}, '^[(]|[)]$', '', 'g')"
    inner = f"(CASE WHEN {bare} LIKE '(%)' THEN {_strip(opened)} ELSE {bare} END)"
    magnitude = _strip(f"regexp_replace({inner}, '^[-−+]', '')")
    value = (
        f"CASE WHEN regexp_matches({magnitude}, '^[0-9]{{1,3}}(\\.[0-9]{{3}})*(,[0-9]{{1,2}})?$') "
        f"THEN CAST(replace(replace({magnitude}, '.', ''), ',', '.') AS DOUBLE) "
        f"WHEN regexp_matches({magnitude}, '^[0-9]+(,[0-9]{{1,2}})?$') THEN CAST(replace({magnitude}, ',', '.') AS DOUBLE) END"
    )
    return f"({value}) * CASE WHEN {bare} LIKE '(%)' OR regexp_matches({inner}, '^[-−]') THEN -1 ELSE 1 END"


def _iso(x: str) -> str:
    """ISO text of a numeric date capture, or null."""
    day, month = "(3[01]|[12][0-9]|0[1-9]|[1-9])", "(1[0-2]|0[1-9]|[1-9])"
    tries = []
    for sep in ("/", "-", "[.]"):
        for year, size in (("[0-9]{4}", 4), ("[0-9]{2}", 2)):
            p = f"^{day}{sep}{month}{sep}({year})$"
            y = f"regexp_extract({x}, '{p}', 3)"
            if size == 2:
                y = f"(CASE WHEN {y} >= '69' THEN '19' ELSE '20' END || {y})"
            tries.append((p, y, f"regexp_extract({x}, '{p}', 2)", f"regexp_extract({x}, '{p}', 1)"))
    for sep in ("/", "-", "[.]"):
        p = f"^([0-9]{{4}}){sep}{month}{sep}{day}$"
        tries.append((p, *[f"regexp_extract({x}, '{p}', {i})" for i in (1, 2, 3)]))
    parsed = [
        f"CASE WHEN regexp_matches({x}, '{p}') THEN "
        f"TRY_CAST({y} || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0') AS DATE) END"
        for p, y, m, d in tries
    ]
    return f"strftime(coalesce({', '.join(parsed)}), '%Y-%m-%d')"


def _prose(source: str) -> str:
    captures = ", ".join(f"{_chain(f)} AS {f}" for f in FIELDS)
    return (
        f"WITH texts AS ({source}), captured AS (SELECT doc_key, {captures} FROM texts) "
        f"SELECT doc_key, invoice_number, coalesce({_iso('date')}, date) AS date, "
        f"{_number('total')} AS total, supplier_name, vat_number FROM captured"
    )


# --- single operators ------------------------------------------------------------

_NUMBERS = """
WITH numbers AS (
  SELECT 'orders' AS source, o_orderkey AS key, o_totalprice AS v FROM orders
  UNION ALL SELECT 'customer', c_custkey, c_acctbal FROM customer
)
SELECT source, key, rendering,
       CASE WHEN rendering = 'us_style' THEN NULL ELSE CAST(CAST(v AS DECIMAL(18,2)) AS DOUBLE) END AS value
FROM numbers, (SELECT unnest(['dots', 'spaces', 'comma', 'plain', 'enclosed', 'true_minus', 'us_style']) AS rendering)
"""
_DATES = """
SELECT o_orderkey, shape, CASE WHEN shape NOT IN ('mixed') THEN strftime(o_orderdate, '%Y-%m-%d') END AS iso
FROM orders, (SELECT unnest(['dd/MM/yyyy', 'dd/MM/yy', 'dd-MM-yyyy', 'dd-MM-yy', 'dd.MM.yyyy', 'dd.MM.yy', 'yyyy/MM/dd',
  'yyyy-MM-dd', 'yyyy.MM.dd', 'd/M/yyyy', 'long', 'long_tail', 'mixed', 'english']) AS shape)
"""
_CLEANED = """
SELECT c_custkey, wrapping, CASE WHEN wrapping IN ('minus', 'two_minus') THEN '-' || CAST(CAST(abs(c_acctbal) AS DECIMAL(18,2)) AS VARCHAR)
  WHEN wrapping = 'nothing' THEN '' ELSE c_name END AS cleaned
FROM customer, (SELECT unnest(['bare', 'space', 'marks', 'dashes', 'mixed', 'minus', 'two_minus', 'nothing']) AS wrapping)
"""
_AMOUNT = "replace(replace(replace(format('{:,.2f}', o_totalprice), ',', '#'), '.', ','), '#', '.')"
_VAT = "lpad(CAST(o_custkey AS VARCHAR), 11, '0')"
_RULES = " UNION ALL ".join(
    f"SELECT o_orderkey, '{field}' AS field, '{rule}' AS rule, {value} AS capture FROM orders"
    for field, rule, value in (
        ("invoice_number", "1", "'R/' || o_orderkey"),
        ("invoice_number", "1 again", "CAST(o_orderkey AS VARCHAR)"),
        ("invoice_number", "2", "'Q/' || o_orderkey"),
        ("invoice_number", "3", "'_' || o_orderkey"),
        ("invoice_number", "4", "'P-' || o_orderkey"),
        ("invoice_number", "none", "NULL"),
        ("date", "1", "strftime(o_orderdate, '%d/%m/%Y')"),
        ("date", "2", "strftime(o_orderdate, '%Y-%m-%d')"),
        ("date", "3", "strftime(o_orderdate, '%d.%m.%Y')"),
        ("date", "4", "strftime(o_orderdate, '%d')"),
        ("date", "none", "NULL"),
        ("total", "1", _AMOUNT),
        ("total", "2", _AMOUNT),
        ("total", "4", _AMOUNT),
        ("total", "5", _AMOUNT),
        ("total", "none", "NULL"),
        ("supplier_name", "1", "'Casa ' || o_orderkey"),
        ("supplier_name", "2", "'Casa ' || o_orderkey"),
        ("supplier_name", "3", "'Casa ' || o_orderkey"),
        ("supplier_name", "4", "'Casa ' || o_orderkey || ' S.n.c'"),
        ("supplier_name", "none", "NULL"),
        ("vat_number", "1", _VAT),
        ("vat_number", "2", _VAT),
        ("vat_number", "3", _VAT),
        ("vat_number", "none", "NULL"),
    )
)
_WIDE = f"""
SELECT o_orderkey, 'INV-' || o_orderkey AS invoice_number, strftime(o_orderdate, '%Y-%m-%d') AS date,
       CASE WHEN o_orderkey % 2 = 0 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) END AS total, {_VAT} AS vat_number
FROM orders
"""
_ODD = """, asked AS (
  SELECT CASE WHEN l_linenumber % 3 <> 0 THEN o_orderkey END AS key FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), found AS (
  SELECT CASE WHEN key IS NULL THEN 11 ELSE k END AS k, CASE WHEN key IS NOT NULL THEN total END AS total FROM asked LEFT JOIN invoices ON key = o_orderkey
)
SELECT count(*) AS processed, count(*) FILTER (k <= 7 AND k <> 6) AS ok, count(*) FILTER (k = 6) AS incomplete,
       count(*) FILTER (k >= 8) AS failed, count(*) FILTER (k IN (4, 5)) AS credit_notes,
       coalesce(CAST(sum(CAST(total AS DECIMAL(18,2))) AS DOUBLE), 0) AS grand_total
FROM found
"""
_CUSTOM = """
SELECT o_orderkey,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 'U' || o_custkey ELSE 'INV-' || o_orderkey END AS invoice_number,
       CASE WHEN o_orderpriority = '1-URGENT' THEN '2001-' || strftime(o_orderdate, '%m') || '-28'
            ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date,
       CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS total
FROM orders
"""


def _rule_merge() -> str:
    rows = ", ".join(f"('{f}', '{p}', {n})" for f in FIELDS for n, p in enumerate(PATTERNS[f]))
    return f"""
WITH present(field, pattern, priority) AS (VALUES {rows}), custom AS (
  SELECT CASE p_type WHEN 'ECONOMY' THEN 'total' WHEN 'STANDARD' THEN 'date' WHEN 'PROMO' THEN 'unknown' ELSE 'vat_number' END AS field,
         CASE WHEN p_size <= 5 THEN '{PATTERNS["total"][2]}' ELSE p_brand || '\\s+(\\S+)' END AS pattern,
         CAST(p_partkey AS INTEGER) AS priority
  FROM part
), tagged AS (
  SELECT field, pattern, 0 AS source, priority FROM custom UNION ALL SELECT field, pattern, 1, priority FROM present
)
SELECT field, pattern, source, priority FROM tagged WHERE field IN (SELECT field FROM present)
QUALIFY row_number() OVER (PARTITION BY field, pattern ORDER BY source, priority) = 1
"""


def expected(seeded: tuple[tuple[str, str], ...]) -> dict[str, str]:
    texts = "text"
    for word, planted in seeded:
        texts = f"replace({texts}, '{word}', '{planted}')"
    documents = "SELECT doc_id AS doc_key, text FROM documents"
    fields = CORPUS + "SELECT path, {} FROM corpus WHERE k <= 8"
    unpivoted = """
SELECT path, "Campo", "Valore" FROM (
  SELECT path, "Numero Fattura", "Data",
         CASE WHEN "Totale" IS NULL THEN '' ELSE CAST("Totale" AS VARCHAR) END AS "Totale",
         "Fornitore", "Partita IVA", "Tipo Documento", "Esito" FROM fatture
) UNPIVOT ("Valore" FOR "Campo" IN ("Numero Fattura", "Data", "Totale", "Fornitore", "Partita IVA", "Tipo Documento", "Esito"))
"""
    return {
        "page_text_assembly": """
SELECT conv_id, count(*) AS n_pages, coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (text <> ''), '') AS text
FROM conversations GROUP BY conv_id""",
        "clean_capture": _CLEANED,
        "rule_chain": _RULES,
        "wide_gaps": _WIDE,
        "many_anchors": """
            SELECT c_custkey, CASE
              WHEN c_custkey % 6 = 0 THEN repeat('ditta ', 999) || c_custkey
              WHEN c_custkey % 6 = 3 THEN 'a ' || repeat('spett.le a ', 999) || c_custkey
              WHEN c_custkey % 2 = 0 THEN 'ditta ditta' END AS supplier_name
            FROM customer""",
        "odd_requests": CORPUS.rstrip() + _ODD,
        "f_invoice_number": fields.format("invoice_number"),
        "f_date": fields.format("date"),
        "f_total": fields.format("total"),
        "f_supplier": fields.format("supplier_name"),
        "f_vat": fields.format("vat_number"),
        "extract_all": fields.format(
            "invoice_number, date, CAST(date AS DATE) AS date_parsed, total, supplier_name, vat_number"
        ),
        "parse_number": _NUMBERS,
        "parse_date": _DATES,
        "custom_date_formats": """
            SELECT o_orderkey, shape, CASE WHEN shape NOT LIKE 'no%' THEN strftime(o_orderdate, '%Y-%m-%d') END AS iso
            FROM orders, (VALUES ('time'), ('weekday'), ('yearday'), ('half_day'), ('iso_week'), ('sunday_week'), ('no_time'), ('no_day')) AS s(shape)""",
        "date_negative": (
            f"WITH captured AS (SELECT doc_id AS doc_key, {_chain('date')} AS date FROM documents) "
            f"SELECT doc_key, coalesce({_iso('date')}, date) AS date FROM captured"
        ),
        "documents_fields": _prose(documents),
        "pages_fields": _prose("SELECT page_id AS doc_key, html AS text FROM pages"),
        "seeded_documents": _prose(f"SELECT doc_id AS doc_key, {texts} AS text FROM documents"),
        "amount_truncation": """
SELECT o_orderkey, substr(printf('%.2f', o_totalprice), 1, 3) AS capture,
       CAST(substr(printf('%.2f', o_totalprice), 1, 3) AS DOUBLE) AS value
FROM orders""",
        "status_flags": CORPUS
        + """SELECT path, k >= 8 AS has_hard_error, k <= 7 AND k <> 6 AS is_ok, k IN (4, 5) AS is_credit_note,
       status_it, document_type_it FROM invoices""",
        "missing_fields": CORPUS
        + "SELECT path, CASE WHEN k = 6 THEN 'vat_number' ELSE '' END AS missing_fields FROM invoices",
        "notes": CORPUS + "SELECT path, notes_it FROM invoices",
        "read_errors": CORPUS + "SELECT path, filename, error_kind, error, readable FROM corpus",
        "repeated_requests": CORPUS
        + """SELECT path, l_orderkey || '/' || l_linenumber AS seq, invoice_number, total, status_it
FROM lineitem JOIN invoices ON l_orderkey = o_orderkey""",
        "fatture_table": CORPUS + "SELECT * EXCLUDE (path) FROM fatture",
        "fatture_with_total": CORPUS
        + """SELECT 0 AS sezione, * FROM fatture
UNION ALL SELECT 1, '', 'TOTALE COMPLESSIVO', '', '', grand_total, '', '', '', '', '' FROM counts""",
        "csv_lines": CORPUS + _CSV,
        "preview_table": CORPUS
        + """SELECT * REPLACE (CASE WHEN "Totale" IS NULL THEN '' ELSE format('{:,.2f} €', "Totale") END AS "Totale")
FROM fatture""",
        "invoice_unpivot": CORPUS + unpivoted,
        "problem_files": CORPUS
        + """SELECT path, filename AS "File", notes_it AS "Dettaglio" FROM invoices WHERE status_it <> 'OK'""",
        "grand_total": CORPUS + "SELECT grand_total FROM counts",
        "riepilogo": CORPUS + _RIEPILOGO,
        "console_summary": CORPUS + _CONSOLE,
        "web_summary": CORPUS + _WEB,
        "file_listing": """
SELECT row_number() OVER (ORDER BY string_split(path, '/')) AS n, path,
       CASE WHEN size < 1048576 THEN format('{:,} byte', size) ELSE printf('%.1f MB', size / 1048576.0) END AS size_text,
       count(*) OVER () AS n_files
FROM (SELECT url || '/' || page_id AS path, CAST(length(html) * 100 AS BIGINT) AS size FROM pages)""",
        "skipped_files": _SKIPPED,
        "rule_merge": _rule_merge(),
        "custom_rule_priority": _CUSTOM,
    }
