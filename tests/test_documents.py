"""Invoices, receipts, layout and page operators on small documents."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscale.functions import text
from folioscale.operators import evaluation, images, layout, lines, receipt
from folioscale.plans import documents
from folioscale.operators.invoice import invoices
from folioscale.sources import files
from folioscale.streaming import landing, progress

INVOICE = """ACME Trading LLC
12 Main Street
Tax lnvoice No: INV-2026-001
Inv0ice Date: 2026-05-09
Due Date: May 30, 2026
Bill To: Example Corp
Description Qty Unit Price Amount
Consulting 2 50.00 100.00
Widget 1 25.00 25.00
Subtotal: 125.00
Tax: 12.50
Total Amount: USD 137.50
Payment Method: card"""

LINE = "array<struct<text:string,text_clean:string,line_id:string,page:int,confidence:double,bbox:array<array<double>>>>"


def box(left, top, right, bottom):
    return [[float(left), float(top)], [float(right), float(top)], [float(right), float(bottom)], [float(left), float(bottom)]]


def line(text, left, top, width=100, height=20, confidence=0.95):
    return (text, None, None, 1, confidence, box(left, top, left + width, top + height))


def test_invoice_text(spark):
    r = invoices(spark.createDataFrame([("a", INVOICE), ("b", None), ("c", "")], "doc_id string, text string")).orderBy("doc_id").collect()
    a = r[0]
    assert (a.invoice_number, a.invoice_date, a.due_date, a.total_amount, a.vendor_name, a.buyer_name) == ("INV-2026-001", "2026-05-09", "2026-05-30", 137.5, "ACME Trading LLC", "Example Corp")
    assert a.confidence == 1.0 and not a.needs_review and [x.description for x in a.line_items] == ["Consulting", "Widget"]
    assert r[1].review_reasons == r[2].review_reasons == ["currency_not_detected", "low_ocr_confidence", "missing_invoice_date", "missing_invoice_number", "missing_total_amount"]


def test_layout(spark):
    rows = [line("ACME LLC", 40, 20), line("Invoice No", 40, 80), line("INV-LAYOUT-7", 200, 82), line("Invoice Date", 40, 115), line("2026-05-09", 40, 145), line("Description", 40, 220), line("Qty", 200, 220, 40), line("Unit Price", 300, 220), line("Amount", 440, 220), line("Consulting", 40, 255), line("2", 200, 255, 40), line("50.00", 300, 255), line("100.00", 440, 255), line("Total Amount", 40, 330), line("USD 105.00", 200, 331)]
    d = spark.createDataFrame([("x", rows), ("none", [])], f"doc_id string, lines {LINE}")
    r = {x.doc_id: x for x in layout.invoices_from_lines(d).collect()}
    x = r["x"]
    assert (x.invoice_number, x.invoice_date, x.total_amount) == ("INV-LAYOUT-7", "2026-05-09", 105.0)
    assert [(i.description, i.quantity, i.unit_price, i.amount, i.item_code) for i in x.line_items] == [("Consulting", 2.0, 50.0, 100.0, None)]
    assert r["none"].invoice_number is None and r["none"].needs_review


def test_page_lines(spark):
    rows = [line("inclu-", 40, 300), line("ding", 40, 330), line("Hello", 40, 200), line("world", 145, 202), line("|||||", 40, 400), line("7", 10, 100, 10, 10, 0.5), line("side", 900, 0, 2, 200), line("far below", 40, 900)]
    d = spark.createDataFrame([(1, rows), (2, [])], f"doc_id int, lines {LINE}")
    r = lines.postprocess(d).select("doc_id", F.transform("lines", lambda x: x["text_clean"]).alias("t"), lines.paragraphs(F.col("lines"), "text_clean").alias("p")).orderBy("doc_id").collect()
    assert r[0].t == ["Hello world", "including", "far below"] and r[0].p == "Hello world including\n\nfar below"
    assert r[1].t == [] and r[1].p == ""


def test_choice_of_pass_is_not_an_argmax(spark):
    rows = [(1, "basic", 0.90, 0.5), (1, "receipt", 0.896, 0.53), (1, "strong", 0.8915, 0.56), (2, "basic", 0.9, 0.9), (2, "strong", 0.905, 0.9), (3, "strong", 0.1, 0.1)]
    d = spark.createDataFrame(rows, "page int, mode string, confidence double, quality_score double")
    assert {r.page: r.selected_mode for r in lines.choose_pass(d, ["page"]).collect()} == {1: "strong", 2: "basic", 3: "strong"}


def test_receipts(spark):
    texts = ["ACME MART", "TEL 07-5551234", "Doc No: CS123", "Date: 06/05/2024", "GST ID 0021", "CODE/DESC QTY PRICE AMOUNT", "1001 2 3.00 6.00", "milk", "Total Sales 80.00", "Cash 100.00", "Change 20.00", "Thank you"]
    rows = [(x, None, f"l{i}", 1, 0.9, box(0, 30 * i, 300, 30 * i + 20)) for i, x in enumerate(texts)]
    d = spark.createDataFrame([("r", rows)], f"doc_id string, lines {LINE}")
    x = receipt.validate_receipts(receipt.receipts(d)).first()
    assert (x.document_number, x.date, x.cash_paid, x.change, x.currency, x.footer_note) == ("CS123", "2024-05-06", 100.0, 20.0, "RM", "Thank you")
    assert x.warnings == ["line_item_sum_does_not_match_total"] and x.line_items[0].source_line_ids == ["l6", "l7"] and x.checks.expected_change == 20.0
    s = d.select(receipt.sections(F.col("lines")).alias("s")).first().s
    assert len(s["items_table"]) == 3 and s["handwritten_area"] == [] and [y.text for y in s["footer_notes"]] == ["Thank you"]


def test_evaluation(spark):
    truth = spark.createDataFrame([("a", "V", "N1", "2024-01-01", "10.00"), ("b", "", "", "", "")], files.TRUTH)
    found = spark.createDataFrame([("a", " n1 ", "2024-01-01", 10.01, "v", False, 0.9)], "doc_id string, invoice_number string, invoice_date string, total_amount double, vendor_name string, needs_review boolean, confidence double")
    s = evaluation.summarize(evaluation.compare(truth, found)).first()
    assert tuple(s) == (1.0, 1.0, 1.0, 1.0, 0.0, 0.45, 2)
    assert tuple(evaluation.summarize(evaluation.compare(truth.limit(0), found)).first()) == (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0)


def test_images(spark):
    grey = np.full((50, 80), 255, dtype=np.uint8)
    grey[20:30, 30:50] = 0
    d = spark.createDataFrame([("d", 1, 50, 80, grey.tobytes()), ("d", 2, 0, 0, None)], "doc_id string, page int, height int, width int, pixels binary")
    r = images.quality_warnings(images.image_measures(d, ["doc_id", "page"])).orderBy("page").collect()
    assert r[0].content_area_ratio == 0.05 and "document_content_is_small" in r[0].warnings and r[1].content_area_ratio is None
    sizes = {x.mode: (x.height, x.width) for x in images.prepare_pages(d, ["doc_id", "page"]).collect()}
    assert sizes["basic"] == (50 * 2 + 36, 80 * 2 + 36) and sizes["sorie"] == ((10 + 24) * 4 + 48, (20 + 24) * 4 + 48)  # content and its margin
    assert images.document_quality(images.quality_warnings(images.image_measures(d, ["doc_id", "page"]))).first().page_count == 2
    read = images.recognise(d, ["doc_id", "page"], lambda: lambda g: [(f"{g.shape[0]} rows", 0.9, [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]])]).collect()
    assert [(x.page, x.text, x.line_id) for x in read] == [(1, "50 rows", "l0001")]


def test_image_steps():
    page = np.full((60, 90), 250, dtype=np.uint8)
    page[20:40, 30:60] = 10
    assert images.trimmed(page, 0.08).shape == (20 + 24, 30 + 24) and images.trimmed(page, 0.5) is page and images.trimmed(np.full((5, 5), 7, np.uint8), 0).shape == (5, 5)
    flat, ramp = np.full((9, 7), 77, np.uint8), np.tile(np.arange(0, 200, 10, dtype=np.uint8), (8, 1))
    assert (images.cubic(flat, 2.0) == 77).all() and images.cubic(flat, 1.5).shape == (14, 10) and images.cubic(flat, 1) is flat
    assert np.abs(images.cubic(ramp, 2.0)[8, 8:-8].astype(float) - (np.arange(8, 32) + 0.5) * 5 + 5).max() <= 1
    assert np.allclose(images.blurred(flat, 1.0), 77, atol=1e-3) and np.isclose(images.blurred(page, 1.0).sum(), page.astype(float).sum(), rtol=1e-4)
    sharp = images.sharpened(page, 1.0, 0.45)
    assert sharp.min() < 10 and sharp[19, 45] == 255 and sharp[0, 0] == 250
    made = {m: images.prepared(page, m) for m in images.MODES}
    assert not np.array_equal(made["basic"], made["receipt"]) and set(np.unique(made["strong"])) == {0, 255}
    assert np.array_equal(images.prepared(page, "sroie"), made["sorie"])


def test_skew_and_contrast():
    lines_ = np.full((300, 400), 245, dtype=np.uint8)
    for y in range(60, 240, 30):
        lines_[y : y + 8, 60:340] = 20
    for lean in (-5.0, -2.0, 1.0, 4.0):
        leaning = images.turned(lines_, -lean)
        assert abs(images.skew_angle(leaning) - lean) < 0.35 and abs(images.skew_angle(images.deskewed(leaning))) < 0.35
    assert images.skew_angle(lines_) == 0.0 and images.deskewed(lines_) is lines_ and np.array_equal(images.turned(lines_, 0.0), lines_)
    far = images.turned(lines_, -12.0)
    assert images.deskewed(far) is far and images.skew_angle(np.full((5, 5), 9, np.uint8)) == 0.0
    one = np.full((20, 20), 255, np.uint8)
    one[9:11, 4:16] = 0
    assert images.skew_angle(one) == 0.0
    one[:, 4:9], one[:, 11:16] = 255, 255
    assert images.skew_angle(one) == 45.0  # a dot, blurred, is a diamond
    faint = (np.random.default_rng(1).integers(110, 140, (160, 160))).astype(np.uint8)
    strong = images.contrast_equalised(faint)
    assert strong.shape == faint.shape and np.ptp(strong) > 1.5 * np.ptp(faint)
    # on one flat page every tile maps alike, so it stays flat; brighter stays brighter within a tile's map
    assert np.ptp(images.contrast_equalised(np.full((33, 57), 90, np.uint8))) == 0 and images.contrast_equalised(np.full((1, 1), 5, np.uint8)).shape == (1, 1)
    plain = np.tile(np.arange(256, dtype=np.uint8), (64, 1)).repeat(8, axis=0)[:64]
    assert (np.diff(images.contrast_equalised(plain)[32].astype(int)) >= -1).all()


def test_saved_uploads_and_their_pages(spark, tmp_path):
    d = spark.createDataFrame([("d1", "../../etc/pass wd", b"one"), ("d1", "..\\x\\pass wd", b"two"), ("d2", None, b""), ("d3", "a.pdf", None), ("d4", "scan.png", b"2")], "doc_id string, name string, content binary")
    saved = files.save_uploads(d, tmp_path.as_uri()).collect()
    assert sorted((x.doc_id, x.name, x.length) for x in saved) == [("d1", "pass_wd", 3), ("d2", "upload", 0), ("d4", "scan.png", 1)]
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file() and not p.name.startswith(".")) == ["d1/pass_wd", "d2/upload", "d4/scan.png"]
    back = files.uploads(spark, str(tmp_path))

    def make():
        import numpy

        return lambda name, content: [("text layer", None)] * 2 if name == "pass_wd" else [(None, numpy.zeros((int(content), 3)))]

    pages = files.decoded_pages(back, make)
    found = sorted((x.doc_id, x.page, x.text, x.height, x.width, x.pixels) for x in pages.collect())
    assert found == [("d1", 1, "text layer", None, None, None), ("d1", 2, "text layer", None, None, None), ("d4", 1, None, 2, 3, bytes(6))]
    there = spark.createDataFrame([("d1", 2, "ocr"), ("d1", 2, "ocr"), ("d4", 1, "basic")], "doc_id string, page int, kind string")
    assert [(x.doc_id, x.page) for x in files.with_artifact(pages, there, "ocr").collect()] == [("d1", 2)]


def test_evaluation_of_no_documents(spark):
    truth = spark.createDataFrame([(None, "V", "N1", "2024-01-01", "10.00")], files.TRUTH)
    found = spark.createDataFrame([], "doc_id string, invoice_number string, invoice_date string, total_amount double, vendor_name string, needs_review boolean, confidence double")
    none = evaluation.summarize(evaluation.compare(truth.limit(0), found))
    assert evaluation.checked(none, truth.limit(0)).first().document_count == 0
    with pytest.raises(ValueError):
        evaluation.checked(none, truth)


def test_documents_from_pages_to_records(spark, tmp_path):
    # inside the test, so that workers need not import this file
    def engine_by_height():
        """Reads the better a page was prepared: receipts are recognised after trimming only."""

        def box(y):
            return [[10.0, y], [300.0, y], [300.0, y + 20.0], [10.0, y + 20.0]]

        def read(page):
            if page.shape[0] == 400 * 2 + 36:
                return [("blurred~ text", 0.5, box(0.0))]
            rows = ["ACME MART SDN BHD", "Doc No: CS77", "Date: 15/01/2024", "CODE/DESC QTY PRICE AMOUNT", "100123 2 5.00 10.00", "blue pens", "Total Sales RM 10.00", "Cash 20.00", "Change 10.00"]
            return [(x, 0.97, box(60.0 * i)) for i, x in enumerate(rows)]

        return read

    scan = np.full((400, 300), 250, dtype=np.uint8)
    scan[100:300, 100:200] = 5
    pages = spark.createDataFrame([("inv", 1, INVOICE), ("shop", 1, ""), ("both", 1, INVOICE), ("both", 2, None)], "doc_id string, page int, text string")
    scans = spark.createDataFrame([("shop", 1, 400, 300, scan.tobytes()), ("both", 2, 400, 300, scan.tobytes())], "doc_id string, page int, height int, width int, pixels binary")
    kept, passes = documents.recognise_with_retry(scans, engine_by_height)
    assert {(x.selected_mode, x.retry_used) for x in passes.collect()} == {("receipt", True)} and kept.where("doc_id = 'shop'").count() == 9
    found = documents.documents(pages, scans, engine_by_height)
    got = {x.doc_id: x for x in found.collect()}
    assert set(got) == {"inv", "shop", "both"}
    assert got["inv"].invoice.invoice_number == "INV-2026-001" and [p.source for p in got["inv"].pages] == ["native"] and got["inv"].quality is None
    assert got["shop"].receipt.document_number == "CS77" and got["shop"].receipt.total == 10.0 and got["shop"].receipt.is_valid and got["shop"].receipt.line_items[0].description == "blue pens"
    assert [p.source for p in got["both"].pages] == ["native", "ocr"] and "ACME MART" in got["both"].full_text and got["shop"].quality.page_count == 1
    documents.write_documents(found, str(tmp_path))
    assert spark.read.json(f"{tmp_path}/validation").where("is_valid").count() >= 1 and spark.read.json(f"{tmp_path}/result").count() == 3


def test_files(spark, tmp_path):
    page = tmp_path / "docs" / "d1" / "ocr"
    page.mkdir(parents=True)
    (page / "page_0002.json").write_text(json.dumps({"lines": [{"text": " a "}, {"text": ""}, {"text": "b", "text_clean": "B", "line_id": "own", "page": 7}]}, indent=1))
    r = files.ocr_lines(spark, str(tmp_path / "docs")).orderBy("line_no").collect()
    assert [(x.doc_id, x.page, x.line_id, x.text) for x in r] == [("d1", 2, "p0002_l0001", "a"), ("d1", 7, "own", "B")]
    up = tmp_path / "up" / "d2"
    up.mkdir(parents=True)
    (up / "b.txt").write_bytes(b"x"), (up / "a.txt").write_bytes(b"y"), (up / "0.txt").write_bytes(b"")
    assert [(x.doc_id, x.name) for x in files.uploads(spark, str(tmp_path / "up")).collect()] == [("d2", "a.txt")]


def test_streaming(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text(json.dumps({"doc_id": "a", "text": INVOICE}) + "\n" + json.dumps({"doc_id": "e", "text": ""}) + "\n")
    watch = progress.Progress()
    spark.streams.addListener(watch)
    for _ in range(2):  # a file counts once, however often the job runs
        landing.process(spark, str(src), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    spark.streams.removeListener(watch)
    assert [r.invoice_number for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["INV-2026-001"]
    assert "started" in {e[1] for e in watch.events}


def test_display(spark):
    d = spark.createDataFrame([(0.456, 12.5, "USD"), (None, None, "USD"), (1.0, 3.0, "unknown"), (0.0, 1.0, None)], "c double, a double, k string")
    got = [tuple(r) for r in d.select(text.percent(d.c), text.money_text(d.a, d.k)).collect()]
    assert got == [("46%", "USD 12.50"), ("-", "-"), ("100%", "3.00"), ("0%", "1.00")]
