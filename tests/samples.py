"""Sample invoices, as pages of lines."""

STANDARD = [[
    "Officine Carsulae S.p.A. - Narni", "P.IVA: 04417823905", "FATTURA N. A/118", "Data: 09/11/2023",
    "Fornitore: Officine Carsulae S.p.A.", "Imponibile: EUR 2.000,00", "IVA 22%: EUR 440,00", "Totale Fattura: EUR 2.440,90",
]]
ZERO = [[
    "Fornitore: Vivaio Sorgente S.r.l.", "FATTURA N. OM-7", "P.IVA: 11820560374", "Data: 30/12/2022", "Totale Fattura: EUR 0,00",
]]
CREDIT = [[
    "Data: 18/02/2025", "NOTA DI CREDITO N. 31/R", "Totale Fattura: EUR -87,35", "Fornitore: Lanificio Biancospino S.r.l.",
    "P.IVA: 07096114428", "Causale: merce resa",
]]
NO_VAT = [[
    "Fornitore: Bottega Melarancia S.n.c.", "FATTURA N. 2023.55", "Totale Fattura: EUR 76,40", "Data: 21/08/2023",
]]
TWO_PAGES = [
    ["Data: 05/10/2024", "P.IVA: 02938471650", "FATTURA N. K-9001", "Fornitore: Cantieri Altamarea S.p.A."],
    ["Foglio secondo", "Totale Fattura: EUR 15.600,25"],
]
SCANNED = [[]]


def tables(spark, documents, files=None):
    """Files and pages tables of {path: pages}; extra or changed file rows as {path: (size, decode_error)}."""
    known = {path: (1000, None) for path in documents} | (files or {})
    file_rows = [(p, p.rsplit("/", 1)[-1], s, e) for p, (s, e) in known.items()]
    page_rows = [(p, n, "\n".join(lines)) for p, pages in documents.items() for n, lines in enumerate(pages)]
    return (
        spark.createDataFrame(file_rows, "path string, file_name string, file_size bigint, decode_error string"),
        spark.createDataFrame(page_rows, "path string, page_no int, page_text string"),
    )
