import json
import os
import re

import pytest
from pyspark.sql import functions as F

import samples
from fiscalframe import (
    ExtractionRules,
    extract_documents,
    extract_invoice,
    extract_invoices,
    fatture,
    grand_total,
    load_rules,
    problem_files,
    riepilogo,
    scan_files,
    write_csv,
    write_outputs,
)
from fiscalframe.operators.numbering import number_rows
from fiscalframe.operators.requests import per_request
from fiscalframe.operators.rules import merge_rule_tables, rules_from_table
from fiscalframe.plans import reports
from fiscalframe.sinks import outputs, staged
from fiscalframe.sinks.csv_text import csv_lines
from fiscalframe.sources.files import accept_uploads, skipped_files
from fiscalframe.sources.pages import assemble_pages, read_text_documents

COLUMNS = ["File", "Numero Fattura", "Data", "Totale", "Fornitore", "Partita IVA", "Tipo Documento", "Esito", "Note"]


def by_path(df):
    return {r.path: r for r in df.collect()}


def invoices_of(spark, documents, files=None, manifest=None):
    return extract_invoices(*samples.tables(spark, documents, files), manifest)


@pytest.fixture(scope="module")
def batch(spark):
    """One readable or unreadable document of each kind."""
    documents = {
        "/in/a.pdf": samples.STANDARD, "/in/b.pdf": samples.ZERO, "/in/c.pdf": samples.CREDIT, "/in/d.pdf": samples.NO_VAT,
        "/in/e.pdf": samples.TWO_PAGES, "/in/f.pdf": samples.SCANNED,
    }
    files = {"/in/g.pdf": (0, None), "/in/h.pdf": (9, "bad header"), "/in/i.pdf": (9, None)}
    paths = [(p,) for p in (*documents, *files, "/in/j.pdf")]
    return invoices_of(spark, documents, files, spark.createDataFrame(paths, "path string")).cache()


def test_readable_documents(batch):
    got = by_path(batch)
    a = got["/in/a.pdf"]
    assert (a.filename, a.invoice_number, a.date, a.total, a.supplier_name, a.vat_number) == (
        "a.pdf", "A/118", "2023-11-09", 2440.9, "Officine Carsulae S.p.A", "04417823905",
    )
    assert a.is_ok and a.status_it == "OK" and a.document_type_it == "Fattura" and a.errors == [] == a.missing_fields
    assert str(a.date_parsed) == "2023-11-09" and str(a.total_dec) == "2440.90"
    b = got["/in/b.pdf"]
    assert b.total == 0.0 and b.is_ok and not b.is_credit_note and b.document_type_it == "Fattura"
    c = got["/in/c.pdf"]
    assert c.total == -87.35 and c.is_credit_note and c.document_type_it == "Nota di credito" and not c.has_hard_error
    d = got["/in/d.pdf"]
    assert d.vat_number is None and d.missing_fields == ["vat_number"] and d.status_it == "Incompleto" and not d.is_ok
    assert d.notes_it == "Campi non trovati: partita IVA" and d.errors == [] and d.total == 76.4
    e = got["/in/e.pdf"]
    assert e.is_ok and e.total == 15600.25 and e.invoice_number == "K-9001"


def test_unreadable_documents(batch):
    got = by_path(batch)
    expected = {
        "/in/f.pdf": ("scanned", "Nessun testo estraibile da f.pdf: probabilmente è una scansione. Serve un OCR."),
        "/in/g.pdf": ("empty", "Il file è vuoto (0 byte): g.pdf"),
        "/in/h.pdf": ("corrupt", "PDF danneggiato o protetto da password: h.pdf (bad header)"),
        "/in/i.pdf": ("corrupt", "Il PDF non contiene pagine: i.pdf"),
        "/in/j.pdf": ("missing", "File PDF non trovato: /in/j.pdf"),
    }
    for path, (kind, message) in expected.items():
        row = got[path]
        assert (row.error_kind, row.notes_it, row.errors) == (kind, message, [message])
        assert row.status_it == "Errore" and row.has_hard_error and not row.is_ok and row.missing_fields == []
        assert (row.total, row.date, row.invoice_number, row.document_type_it) == (None, None, None, "")


def test_unexpected_read_error_comes_first(spark):
    files, pages = samples.tables(spark, {"/x.pdf": samples.STANDARD})
    row = extract_invoices(files.withColumn("unexpected_error", F.lit("denied")), pages).first()
    assert row.errors == ["Errore imprevisto durante la lettura: denied"] and row.error_kind == "unexpected"


def test_failed_pages_are_skipped_and_pages_ordered(spark):
    rows = [("p", 2, "two"), ("p", 10, "ten"), ("p", 1, None), ("p", 3, ""), ("q", 1, None)]
    got = by_path(assemble_pages(spark.createDataFrame(rows, "path string, page_no int, page_text string")))
    assert (got["p"].text, got["p"].n_pages, got["q"].text) == ("two\nten", 4, "")


def test_pages_without_path_belong_to_no_document(spark):
    files, pages = samples.tables(spark, {"/x.pdf": samples.STANDARD})
    stray = spark.createDataFrame([(None, 0, "Totale 1,00")] * 50, "path string, page_no int, page_text string")
    assert [(r.path, r.total) for r in extract_invoices(files, pages.unionByName(stray)).collect()] == [("/x.pdf", 2440.9)]


def test_single_document(spark, tmp_path):
    files, pages = samples.tables(spark, {"/a.pdf": samples.STANDARD, "/b.pdf": samples.ZERO})
    pages.write.parquet(str(tmp_path / "pages"))
    stored = spark.read.parquet(str(tmp_path / "pages"))
    one = extract_invoice(files, stored, "/b.pdf")
    assert [(r.path, r.invoice_number) for r in one.collect()] == [("/b.pdf", "OM-7")]
    assert "EqualTo(path,/b.pdf)" in one._jdf.queryExecution().executedPlan().toString()
    assert extract_invoice(files, stored, "/c.pdf").first().error_kind == "missing"


def test_batch_reports(batch):
    assert grand_total(batch).first()[0] == 2440.9 - 87.35 + 76.4 + 15600.25 - 0.0
    lines = {r.voce: r.valore for r in riepilogo(batch, "/out", "01/01/2024 10:00:00").orderBy("ordine").collect()}
    assert lines == {
        "PDF elaborati": "10", "Estratti correttamente": "4", "Estratti parzialmente": "1", "Non leggibili": "5",
        "Note di credito": "1", "": "", "Totale complessivo (€)": "18030.20", "File esportato in": "/out",
        "Data esportazione": "01/01/2024 10:00:00",
    }
    console = {r.voce: r.valore for r in reports.console_summary(batch, ("a.csv",)).collect()}
    assert console["Totale complessivo"] == "€ 18,030.20" and console["File esportato"] == "a.csv"
    assert {r.File for r in problem_files(batch).collect()} == {f"{n}.pdf" for n in "dfghij"}
    assert fatture(batch).columns == COLUMNS
    pairs = {(r.path, r.Campo): r.Valore for r in reports.invoice_unpivot(batch).collect()}
    assert pairs["/in/a.pdf", "Totale"] == "2440.9" and pairs["/in/g.pdf", "Totale"] == "" and len(pairs) == 70


def test_reports_of_nothing(spark):
    files, pages = samples.tables(spark, {"/x.pdf": samples.STANDARD})
    none = extract_invoices(files.limit(0), pages)
    assert grand_total(none).first()[0] == 0.0
    assert [r.valore for r in reports.web_summary(none).orderBy("ordine").collect()] == ["0", "0", "€ 0.00"]
    assert "Note di credito" not in {r.voce for r in reports.console_summary(none).collect()}


def csv_bytes(folder):
    parts = sorted(p for p in folder.iterdir() if p.name.startswith("part-"))
    return b"".join(p.read_bytes() for p in parts)


def test_csv_bytes(spark, tmp_path):
    odd = [["Fattura n. 12", 'Fornitore: Ditta "Uno; Due" | x', "Totale -1.000,50"]]
    made = invoices_of(spark, {"/in/a-b/x.pdf": samples.STANDARD, "/in/a/y.pdf": odd})
    write_csv(made, str(tmp_path / "new" / "out.csv"))
    expected = (
        "\ufeffFile;Numero Fattura;Data;Totale;Fornitore;Partita IVA;Tipo Documento;Esito;Note\r\n"
        'y.pdf;12;;-1000,50;"Ditta ""Uno; Due""";;Nota di credito;Incompleto;Campi non trovati: data, partita IVA\r\n'
        "x.pdf;A/118;2023-11-09;2440,90;Officine Carsulae S.p.A;04417823905;Fattura;OK;\r\n"
        "\r\n"
        "TOTALE COMPLESSIVO;;;1440,40;;;;;\r\n"
    )
    assert csv_bytes(tmp_path / "new" / "out.csv").decode() == expected


def test_csv_parts_are_one_sequence(spark, tmp_path):
    """Many parts, read in name order, equal the single file."""
    documents = {f"/in/{n:05}.pdf": [[f"Fattura n. {n}", f"Totale {n % 900},00"]] for n in range(3000)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_csv(invoices_of(spark, documents), str(tmp_path / "out.csv"), ",")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len([p for p in (tmp_path / "out.csv").iterdir() if p.name.startswith("part-")]) > 1
    lines = csv_bytes(tmp_path / "out.csv").decode("utf-8-sig").split("\r\n")
    assert [line.split(",")[0] for line in lines[1:3001]] == [f"{n:05}.pdf" for n in range(3000)]
    assert lines[0].startswith("File,") and lines[3001] == "" and lines[3002].startswith("TOTALE COMPLESSIVO,,,")
    assert lines[3002].split('"')[1] == f"{sum(n % 900 for n in range(3000))},00" and lines[3003:] == [""]


def test_write_outputs(spark, batch, tmp_path):
    target = str(tmp_path / "deep" / "fatture.xlsx")
    for _ in range(2):
        assert write_outputs(batch, target, "BOTH") == [target[:-5] + ".parquet", target[:-5] + ".csv"]
    detail = spark.read.parquet(target[:-5] + ".parquet/fatture")
    assert detail.count() == 11 and detail.filter("sezione = 1").first().Totale == 18030.2
    assert spark.read.parquet(target[:-5] + ".parquet/riepilogo").count() == 10
    assert csv_bytes(tmp_path / "deep" / "fatture.csv").count(b"\r\n") == 13
    write_outputs(batch, str(tmp_path / "b.x"), "parquet", include_summary=False)
    assert not (tmp_path / "b.parquet" / "riepilogo").exists() and not (tmp_path / "b.csv").exists()
    with pytest.raises(ValueError, match="Formato non valido: 'pdf'"):
        write_outputs(batch, target, "pdf")


def test_outputs_that_cannot_be_written(batch, tmp_path):
    (tmp_path / "file").write_text("x")
    for fmt in ("parquet", "csv"):
        with pytest.raises(OSError, match="Impossibile salvare"):
            write_outputs(batch, str(tmp_path / "file" / "o.x"), fmt)


def everything(folder):
    return {str(p.relative_to(folder)): p.read_bytes() for p in folder.rglob("*") if p.is_file() and "_temporary" not in p.parts}


@pytest.mark.parametrize("step", ["second output", "replacing"])
def test_a_failed_output_leaves_the_old_ones(batch, tmp_path, monkeypatch, step):
    """Neither the sheet nor the export is replaced if either cannot be, and nothing else is left behind."""
    target = str(tmp_path / "fatture.xlsx")
    write_outputs(batch, target, "both")
    before = everything(tmp_path)
    if step == "second output":
        monkeypatch.setattr(outputs, "write_csv_parts", lambda frame, place, *rest: frame.select(F.raise_error(F.lit("full"))).write.text(place))
    else:
        move = staged._Folder.move

        def failing(self, source, place):
            if source.endswith(".new") and place.endswith(".csv"):
                raise OSError("full")
            move(self, source, place)

        monkeypatch.setattr(staged._Folder, "move", failing)
    with pytest.raises(OSError):
        write_outputs(batch.filter("path < '/in/c'"), target, "both")
    assert everything(tmp_path) == before
    monkeypatch.undo()
    write_outputs(batch.filter("path < '/in/c'"), target, "both")
    assert batch.sparkSession.read.parquet(str(tmp_path / "fatture.parquet/fatture")).count() == 3
    assert csv_bytes(tmp_path / "fatture.csv").count(b"\r\n") == 5
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["fatture.csv", "fatture.parquet"]


def test_output_keeps_the_request_order(spark, tmp_path):
    files, pages = samples.tables(spark, {"/a.pdf": samples.STANDARD, "/b.pdf": samples.ZERO})
    manifest = spark.createDataFrame([("/b.pdf", 1), ("/a.pdf", 2), ("/b.pdf", 3)], "path string, seq int")
    write_outputs(extract_invoices(files, pages, manifest), str(tmp_path / "o"), "both")
    sheet = spark.read.parquet(str(tmp_path / "o.parquet" / "fatture")).orderBy("sezione", "seq").collect()
    assert [(r.seq, r.File) for r in sheet] == [(1, "b.pdf"), (2, "a.pdf"), (3, "b.pdf"), (None, "TOTALE COMPLESSIVO")]
    lines = csv_bytes(tmp_path / "o.csv").decode().split("\r\n")
    assert [line.split(";")[0] for line in lines[1:4]] == ["b.pdf", "a.pdf", "b.pdf"]


def test_hot_paths_are_spread(spark):
    """Paths, and missing ones, that hold most requests are split over tasks, with or without an order column; nothing is lost."""
    path = F.when(F.col("id") < 40_000, "/hot.pdf").when(F.col("id") < 80_000, F.lit(None)).otherwise(F.concat(F.lit("/"), F.col("id") % 500))
    wide = spark.range(90_000).repartition(8).select(path.alias("path"), F.lit(None).cast("long").alias("seq"))
    results = wide.select("path").distinct().withColumn("v", F.coalesce(F.length("path"), F.lit(0)))
    low = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256b",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256b",
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "0",
    }
    before = {k: spark.conf.get(k, None) for k in low}
    for k, v in low.items():
        spark.conf.set(k, v)
    try:
        joined = per_request(wide, results, "seq")
        rows = joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(rows) == 90_000 and all(r.v == len(r.path or "") for r in rows)
    assert joined.columns == ["path", "seq", "v"]


def test_odd_keys(spark):
    """No path, repeated requests and repeated file rows."""
    files, pages = samples.tables(spark, {"/a.pdf": samples.STANDARD, "/b.pdf": samples.ZERO})
    manifest = spark.createDataFrame([("/a.pdf",), (None,), ("/a.pdf",), (None,), ("/c.pdf",)], "path string")
    got = extract_invoices(files.unionByName(files), pages, manifest)
    assert sorted((r.path or "", r.status_it, r.error_kind or "") for r in got.collect()) == [
        ("", "Errore", "missing"), ("", "Errore", "missing"), ("/a.pdf", "OK", ""), ("/a.pdf", "OK", ""), ("/c.pdf", "Errore", "missing"),
    ]
    counts = reports.summary(got).first()
    assert counts.processed == counts.ok + counts.incomplete + counts.failed == 5
    assert extract_invoices(files.unionByName(files), pages).count() == 2


def test_documents_that_are_whole(spark):
    rows = [("/a", "a", "Fattura n. 5\nTotale 3,00", None, None), ("/b", "b", None, "missing", "File PDF non trovato: /b"), (None, None, None, "corrupt", None)]
    schema = "path string, filename string, text string, error_kind string, error string"
    got = by_path(extract_documents(spark.createDataFrame(rows, schema)))
    assert (got["/a"].invoice_number, got["/a"].total, got["/a"].status_it) == ("5", 3.0, "Incompleto")
    assert got["/b"].errors == ["File PDF non trovato: /b"] and got["/b"].missing_fields == []
    assert got[None].has_hard_error and got[None].errors == ["corrupt"]


def test_numbers_across_partitions(spark):
    rows = spark.range(5000).select(F.sha2(F.col("id").cast("string"), 256).alias("k")).repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = number_rows(rows, F.col("k"), total="all").orderBy("k").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r.n for r in got] == list(range(1, 5001)) and {r["all"] for r in got} == {5000}
    many = spark.range(3000).select(F.when(F.col("id") < 2500, "same").otherwise("z").alias("k"), (F.col("id") % 100).alias("v"))
    numbered = number_rows(many, F.col("k"), buckets=16).collect()
    assert sorted(r.n for r in numbered) == list(range(1, 3001)) and max(r.n for r in numbered if r.k == "same") == 2500
    assert number_rows(many.limit(0), F.col("k")).count() == 0


def test_file_listing_order_and_sizes(spark):
    rows = [("/a-b/x.pdf", 1048576), ("/a/x.pdf", 1234), ("/a/b/x.pdf", 1572864), ("/a/a.pdf", 1048575)]
    got = reports.file_listing(spark.createDataFrame(rows, "path string, file_size bigint")).orderBy("n").collect()
    assert [(r.n, r.path, r.size_text) for r in got] == [
        (1, "/a/a.pdf", "1,048,575 byte"), (2, "/a/b/x.pdf", "1.5 MB"), (3, "/a/x.pdf", "1,234 byte"), (4, "/a-b/x.pdf", "1.0 MB"),
    ]


def final_plan(df):
    """The plan that ran, without the initial ones, which are printed indented below it."""
    df.collect()
    lines, skipped = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        indent = len(line) - len(line.lstrip(" :+-"))
        if skipped is None or indent < skipped:
            skipped = indent if "== Initial Plan ==" in line else None
            lines.append(line)
    return "\n".join(lines)


def test_total_and_rows_share_one_exchange(spark):
    """No aggregate is keyed by the rows; they are shuffled once for both parts."""
    made = invoices_of(spark, {"/in/a.pdf": samples.STANDARD, "/in/b.pdf": samples.ZERO})
    for both in (reports.fatture_with_total(made), csv_lines(made)):
        plan = final_plan(both)
        dealt = {"ReusedExchange" in line for line in plan.splitlines() if "REBALANCE_PARTITIONS_BY_COL" in line}
        assert dealt == {False, True}
        keys = {re.sub(r"#\d+", "", k) for k in re.findall(r"Aggregate\(keys?=\[([^\]]*)", plan)}
        assert keys == {"", "_key", "path"}


def test_numbering_reads_its_input_twice(spark, tmp_path):
    spark.range(5000).selectExpr("concat('/d/', id % 7, '/', id) AS path", "id AS file_size").write.parquet(str(tmp_path / "files"))
    plan = final_plan(reports.file_listing(spark.read.parquet(str(tmp_path / "files"))))
    assert plan.count("FileScan") == 2 and "NestedLoop" not in plan and plan.count("ReusedExchange") == 1


def test_requests_filter_page_texts_before_they_move(spark, tmp_path):
    """With more requests than can be broadcast, a Bloom filter of them is tested at the scan of a large page table."""
    spark.range(2000).selectExpr("concat('/d/', id) AS path", "1 AS page_no", "repeat('Totale 5 ', 50) AS page_text").write.parquet(str(tmp_path / "pages"))
    spark.range(0, 2000, 100).selectExpr("concat('/d/', id) AS path", "9L AS file_size").write.parquet(str(tmp_path / "files"))
    pages, files = (spark.read.parquet(str(tmp_path / name)) for name in ("pages", "files"))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1KB"}
    before = {name: spark.conf.get(name, None) for name in conf}
    try:
        for name, value in conf.items():
            spark.conf.set(name, value)
        made = extract_invoices(files, pages, files.select("path").union(files.select("path")).distinct())
        assert made.count() == 20 and {r.total for r in made.collect()} == {5.0}
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        below = plan[: plan.index("/pages")] if "/pages" in plan else plan
        assert "might_contain" in below and below.index("might_contain") > below.index("collect_list")
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


def test_scan_files(spark, tmp_path):
    names = ["b.pdf", "a b+c%20.pdf", "vuoto.pdf", "B.PDF", "x.txt", "sub/d.pdf", "sub/deep/e.pdf", "anno=2024/n.pdf", "anno=2024/m=1/o.pdf"]
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"" if name == "vuoto.pdf" else b"12345")
    flat = {r.file_name: r for r in scan_files(spark, str(tmp_path)).collect()}
    assert {n: r.file_size for n, r in flat.items()} == {"b.pdf": 5, "a b+c%20.pdf": 5, "vuoto.pdf": 0}
    assert flat["b.pdf"].path == str(tmp_path / "b.pdf")
    deep = {r.file_name for r in scan_files(spark, str(tmp_path), recursive=True).collect()}
    assert deep == {"b.pdf", "a b+c%20.pdf", "vuoto.pdf", "d.pdf", "e.pdf", "n.pdf", "o.pdf"}
    assert {r.file_size for r in scan_files(spark, str(tmp_path), recursive=True).collect() if r.file_name != "vuoto.pdf"} == {5}
    single = scan_files(spark, str(tmp_path / "B.PDF")).collect()
    assert [(r.file_name, r.file_size) for r in single] == [("B.PDF", 5)]
    with pytest.raises(ValueError, match="non è un PDF"):
        scan_files(spark, str(tmp_path / "x.txt"))


def test_scan_files_takes_any_spelling_of_a_path(spark, tmp_path):
    for name in ("a.pdf", "vuoto.pdf", "x.pdf/in.pdf", "k=v/b.pdf", "sub/c.pdf", "[1] {x}*?/d.pdf", "[1] {x}*?/sub/e.pdf"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"" if name == "vuoto.pdf" else b"12345")
    working = spark._jvm.java.lang.System.getProperty("user.dir")
    relative = os.path.relpath(tmp_path, working)
    expected = [(str(tmp_path / "a.pdf"), "a.pdf", 5), (str(tmp_path / "vuoto.pdf"), "vuoto.pdf", 0)]
    for spelt in (str(tmp_path), f"{tmp_path}/", relative, f"./{relative}", f"{tmp_path.parent}/./{tmp_path.name}", f"{tmp_path.parent}//{tmp_path.name}", f"file://{tmp_path}", f"{tmp_path}/sub/.."):
        assert sorted(map(tuple, scan_files(spark, spelt).collect())) == expected, spelt
    for spelt in (f"{relative}/a.pdf", f"./{relative}/a.pdf", f"{tmp_path}//a.pdf", f"{tmp_path}/./a.pdf"):
        assert list(map(tuple, scan_files(spark, spelt).collect())) == expected[:1], spelt
    deep = {r.path for r in scan_files(spark, relative, recursive=True).collect()}
    assert deep == {str(tmp_path / n) for n in ("a.pdf", "vuoto.pdf", "x.pdf/in.pdf", "k=v/b.pdf", "sub/c.pdf", "[1] {x}*?/d.pdf", "[1] {x}*?/sub/e.pdf")}
    odd = scan_files(spark, str(tmp_path / "[1] {x}*?")).collect()
    assert [(r.path, r.file_size) for r in odd] == [(str(tmp_path / "[1] {x}*?/d.pdf"), 5)]
    assert scan_files(spark, str(tmp_path / "k=v")).count() == 1 and scan_files(spark, str(tmp_path / "k=v/..")).count() == 2
    (tmp_path / "empty").mkdir()
    assert scan_files(spark, str(tmp_path / "empty")).count() == scan_files(spark, str(tmp_path / "empty"), recursive=True).count() == 0
    for missing in (str(tmp_path / "no"), f"{relative}/no.pdf", str(tmp_path / "*.pdf")):
        with pytest.raises(FileNotFoundError, match="non esiste"):
            scan_files(spark, missing)


def test_a_flat_scan_lists_no_sub_folder(spark, tmp_path, monkeypatch):
    """What Spark is given to list: files of the folder itself, however many there are below."""
    (tmp_path / "a.pdf").write_bytes(b"1")
    (tmp_path / "sub").mkdir()
    for k in range(50):
        (tmp_path / "sub" / f"{k}.pdf").write_bytes(b"1")
    seen = []
    monkeypatch.setattr("pyspark.sql.DataFrameReader.load", lambda self, path, load=type(spark.read).load: seen.append(load(self, path)) or seen[-1])
    assert scan_files(spark, str(tmp_path)).count() == 1 and [len(s.inputFiles()) for s in seen] == [1]


def test_scanned_folder_end_to_end(spark, tmp_path):
    """A folder's files joined with page texts that were decoded elsewhere, by path."""
    for name in ("ok.pdf", "vuoto.pdf"):
        (tmp_path / name).write_bytes(b"" if name == "vuoto.pdf" else b"%PDF")
    pages = [(str(tmp_path / "ok.pdf"), 0, "\n".join(samples.STANDARD[0]))]
    made = extract_invoices(
        scan_files(spark, str(tmp_path)), spark.createDataFrame(pages, "path string, page_no int, page_text string")
    )
    assert {r.filename: r.status_it for r in made.collect()} == {"ok.pdf": "OK", "vuoto.pdf": "Errore"}


def test_uploads(spark):
    names = ["/t/a.pdf", "/t/b.PDF", "/t/c.txt", "/t/.pdf", "/t/d.pdf.zip"]
    uploads = spark.createDataFrame(list(enumerate(names)), "seq int, path string")
    assert {r.path for r in accept_uploads(uploads).collect()} == {"/t/a.pdf", "/t/b.PDF"}
    skipped = skipped_files(uploads).orderBy("seq").collect()
    assert [r.file_name for r in skipped] == ["c.txt", ".pdf", "d.pdf.zip"]


def test_text_documents_need_no_shuffle(spark, tmp_path):
    (tmp_path / "one.txt").write_text("Fattura n. 5\nTotale 3,00")
    pages = read_text_documents(spark, str(tmp_path))
    assert pages.first().path == str(tmp_path / "one.txt")
    assert "Exchange" not in pages._jdf.queryExecution().executedPlan().toString()


def test_rule_files(spark, tmp_path):
    def load(text):
        (tmp_path / "c.json").write_text(text, encoding="utf-8")
        spark.catalog.refreshByPath(str(tmp_path / "c.json"))
        return load_rules(spark, str(tmp_path / "c.json"))

    rules = load(json.dumps({"patterns": {"invoice_number": ["CODICE\\s+(\\S+)"], "date": "il (\\S+)"}, "date_formats": ["%Y%m%d"]}))
    assert rules.patterns["invoice_number"][0] == r"CODICE\s+(\S+)" and len(rules.patterns["invoice_number"]) == 5
    assert rules.patterns["date"][0] == r"il (\S+)" and rules.date_formats[0] == "%Y%m%d"
    assert load("{}") == ExtractionRules()
    with pytest.raises(ValueError, match="File di configurazione non valido"):
        load("{ non json")
    with pytest.raises(ValueError, match="'patterns' deve essere un oggetto"):
        load('{"patterns": []}')
    with pytest.raises(ValueError, match="Espressione regolare non valida per 'date'"):
        load('{"patterns": {"date": ["("]}}')
    with pytest.raises(ValueError, match="Impossibile leggere"):
        load_rules(spark, str(tmp_path / "none.json"))


def test_any_number_of_rules_loads(spark):
    table = spark.range(1500).select(F.lit("total").alias("field"), F.lit(0).alias("source"), F.col("id").alias("priority"), F.format_string("(a%d)", "id").alias("pattern"))
    assert len(rules_from_table(table).patterns["total"]) == 1500


def test_rule_tables_merge_like_rule_sets(spark):
    given = {"total": ["(a)", "(b)", "(a)", ExtractionRules().patterns["total"][2]], "altro": ["(x)"]}
    rows = [(f, i, p) for f, ps in given.items() for i, p in enumerate(ps)]
    merged = merge_rule_tables(
        spark.createDataFrame(rows, "field string, priority int, pattern string"), ExtractionRules().table(spark)
    )
    assert rules_from_table(merged).patterns == ExtractionRules().merge(given).patterns


SHOP_RULES = {
    "total": [r"totale\s*(?:fattura|documento|da\s*pagare)?[.:]?\s*[€]?\s*([\d.,]+)"],
    "date": [r"data[.:]?\s*([\d/\-]+)"],
}


def test_override_rules(spark):
    """Looser rules read whole unseparated amounts and leave the rest to the built-in ones."""
    rows = [("Totale: 1250,00",), ("Totale: EUR 12,00",), ("Totale fattura -5,00",), ("Data: 15/3",)]
    got = extract_invoices(
        *samples.tables(spark, {f"/{i}.pdf": [[t]] for i, (t,) in enumerate(rows)}), rules=ExtractionRules().merge(SHOP_RULES)
    )
    found = by_path(got)
    assert [found[f"/{i}.pdf"].total for i in range(3)] == [1250.0, 12.0, -5.0]
    assert found["/3.pdf"].date == "15/3"


def test_pipeline_plan(spark):
    """No Python worker; every table shuffled once; page text filtered and pruned at the scan."""
    import __spark_entry__ as entry

    plan = entry.invoices(spark, "/root/testdata/sf0.001")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "CartesianProduct" not in text and "NestedLoop" not in text
    assert text.count("Exchange hashpartitioning(path") <= 3
    files = entry.corpus_files(spark, "/root/testdata/sf0.001").select("path", "file_size")
    assert "o_totalprice" not in files._jdf.queryExecution().executedPlan().toString()
