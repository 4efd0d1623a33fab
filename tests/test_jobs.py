"""The document job as a stream, records that are read one by one, record files, artifacts, failing rows and denoising."""

import json

import numpy as np
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from folioscale.operators import images
from folioscale.operators.invoice import invoices
from folioscale.plans.settings import Settings
from folioscale.sources import files, record_files, records
from folioscale.streaming import landing

KINDS = {"invoice", "receipt", "validation", "layout", "quality", "result", "failed"}


def plain_denoised(grey, strength):
    reach, half = images.WINDOW // 2, images.PATCH // 2
    h, w = grey.shape
    edge = reach + half
    wide, out = np.pad(grey.astype(float), edge, mode="reflect" if min(h, w) > 1 else "edge"), np.empty((h, w))
    patch = lambda y, x: wide[y + edge - half : y + edge + half + 1, x + edge - half : x + edge + half + 1]
    for y in range(h):
        for x in range(w):
            shifts = [(y + dy, x + dx) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1)]
            weights = [np.exp(-((patch(y, x) - patch(*s)) ** 2).mean() / strength**2) for s in shifts]
            out[y, x] = sum(k * wide[a + edge, b + edge] for k, (a, b) in zip(weights, shifts)) / sum(weights)
    return out


@pytest.mark.parametrize("shape", [(9, 7), (1, 5), (2, 2), (14, 11)])
def test_denoising_pixel_by_pixel(monkeypatch, shape):
    grey = np.random.default_rng(2).integers(0, 256, shape).astype(np.uint8)
    want = {s: plain_denoised(grey, s) for s in (5.0, 60.0)}
    for band in (128, 4):
        monkeypatch.setattr(images, "BAND", band)
        for strength, plain in want.items():
            assert np.abs(images.denoised(grey, strength) - plain).max() <= 0.501


def test_denoising_takes_noise_and_keeps_edges():
    page = np.full((60, 80), 200, dtype=np.uint8)
    page[20:40, 30:50] = 30
    noisy = np.clip(page + np.random.default_rng(3).normal(0, 4, page.shape), 0, 255).astype(np.uint8)
    clean = images.denoised(noisy, 8.0)
    assert np.abs(clean.astype(int) - page).mean() < 0.5 * np.abs(noisy.astype(int) - page).mean()
    assert clean[30, 29] > 180 and clean[30, 30] < 50


def test_failing_pages_are_set_aside(spark):
    def make():
        tries = []

        def read(page):
            tries.append(1)
            if page[0, 0] == 1 or (page[0, 0] == 2 and len(tries) > 1):  # the second comes right with a new engine
                raise RuntimeError("no")
            return [("bad line",)] if page[0, 0] == 3 else [("fine", 0.9, [[0.0, 0.0]])]

        return read

    d = spark.createDataFrame([(k, 1, 1, bytes([k])) for k in range(5)] + [(5, 2, 9, b"xy"), (6, None, None, None)], "page int, height int, width int, pixels binary").coalesce(1)
    got = {r.page: (r.text, r.error and r.error.split(":")[0]) for r in images.recognised(d, ["page"], make).collect()}
    assert got == {0: ("fine", None), 1: (None, "RuntimeError"), 2: ("fine", None), 3: (None, "IndexError"), 4: ("fine", None), 5: (None, "ValueError")}
    assert images.recognise(d, ["page"], make).count() == 3

    def decoder():
        def decode(name, content):
            if name == "broken":
                raise ValueError("damaged")
            return [("text", None)]

        return decode

    up = spark.createDataFrame([("a", "x", b"1"), ("b", "broken", b"2"), ("c", "x", None)], "doc_id string, name string, content binary")
    assert sorted((r.doc_id, r.page, r.text, r.error) for r in files.decoded(up, decoder).collect()) == [("a", 1, "text", None), ("b", None, None, "ValueError: damaged"), ("c", 1, "text", None)]
    assert files.decoded_pages(up, decoder).count() == 2


def test_landing_stream_that_is_cut_off(spark, tmp_path, monkeypatch):
    invoice = "ACME Trading LLC\nInvoice No: INV-9\nInvoice Date: 2026-05-09\nDescription Qty Unit Price Amount\nConsulting 2 50.00 100.00\nTotal Amount: USD 100.00\nPayment Method: card"

    def decoder():
        import numpy

        def decode(name, content):
            if content == b"broken":
                raise ValueError("damaged")
            return [(None, numpy.full((int(content[1:]), 40), 200, dtype=numpy.uint8))] if content[:1] == b"#" else [(content.decode(), None)]

        return decode

    def engine():
        def read(page):
            if page.shape[0] in (2 * 50 + 36, 4 * 50 + 48):
                raise RuntimeError("too high")
            return [(x, 0.97, [[0.0, y], [90.0, y], [90.0, y + 20], [0.0, y + 20]]) for x, y in (("SHOP LTD", 0.0), ("Doc No: CS5", 60.0), ("Total 5.00", 120.0))]

        return read

    def put(doc, name, content):
        (tmp_path / "in" / doc).mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / doc / name).write_bytes(content)

    def run():
        q = landing.run_documents(spark, str(tmp_path / "in"), out, str(tmp_path / "check"), decoder, engine)
        try:
            q.awaitTermination(600)
        finally:
            q.stop()

    out = str(tmp_path / "out")
    for doc, name, content in (("text", "b.txt", invoice.encode()), ("text", "c.txt", b"second file"), ("scan", "p.png", b"#30"), ("hurt", "h.pdf", b"broken"), ("high", "d.png", b"#50"), ("none", "e.txt", b"")):
        put(doc, name, content)
    real, calls = landing.write_records, []

    def cut_off(d, path, number, buckets):
        calls.append(path)
        if path.endswith("/layout") and len([c for c in calls if c.endswith("/layout")]) == 1:
            raise RuntimeError("lost")
        real(d, path, number, buckets)

    monkeypatch.setattr(landing, "write_records", cut_off)
    monkeypatch.setattr(images, "denoised", lambda grey, strength: grey)
    with pytest.raises(Exception, match="lost"):
        run()
    run()
    put("text", "a.txt", b"a file that comes late"), put("late", "l.txt", invoice.replace("INV-9", "INV-10").encode())
    run()
    found = {k: records.read_records(spark, f"{out}/{k}") for k in KINDS}
    ids = lambda k: sorted(r.doc_id for r in found[k].collect())
    assert {k: ids(k) for k in KINDS - {"failed"}} == {k: ["high", "late", "scan", "text"] for k in KINDS - {"failed"}}
    got = {r.doc_id: r for r in found["result"].collect()}
    assert got["text"].invoice.invoice_number == "INV-9" and got["late"].batch == 1 and got["scan"].receipt.document_number == "CS5" and got["high"].full_text == ""
    assert {tuple(r)[:4] for r in found["failed"].select("doc_id", "page", "stage", "error").collect()} == {("hurt", None, "decode", "ValueError: damaged")} | {("high", 1, m, "RuntimeError: too high") for m in images.MODES}
    assert records.invoice_of(spark, out, "late").first().invoice_number == "INV-10"


def test_one_record_reads_one_bucket(spark, tmp_path):
    d = spark.range(500).select(F.format_string("d%03d", "id").alias("doc_id"), F.col("id").alias("v"))
    path = str(tmp_path / "t")
    records.write_records(d, path, 0, 16)
    records.write_records(d.where("v >= 490").withColumn("v", F.col("v") + 1000), path, 1, 16)
    records.write_records(d.where("v >= 495").withColumn("v", F.col("v") + 1000), path, 1, 16)  # a batch again
    assert records.read_records(spark, path).count() == 505
    one = records.record_of(spark, path, "d123", 16)
    assert [(r.doc_id, r.v) for r in one.collect()] == [("d123", 123)] and sorted(r.v for r in records.record_of(spark, path, "d499", 16).collect()) == [499, 1499]
    assert records.record_of(spark, path, "nobody", 16).count() == 0 and records.read_records(spark, f"{path}-none").count() == 0
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(doc_id,d123)" in plan
    whole, bucket = (x.select(F.input_file_name().alias("f")).distinct().count() for x in (records.read_records(spark, path), records.read_records(spark, path).where(F.col("bucket") == records.bucket_of(F.lit("d123"), 16))))
    assert whole > 16 and bucket <= 2


def test_invoice_falls_back_to_the_whole_result(spark, tmp_path):
    whole = spark.createDataFrame([("a", ("A1",)), ("b", ("B1",))], "doc_id string, invoice struct<invoice_number:string>")
    records.write_records(whole, f"{tmp_path}/result")
    assert records.invoice_of(spark, str(tmp_path), "a").collect() == [("a", "A1")]
    records.write_records(spark.createDataFrame([("a", "A2")], "doc_id string, invoice_number string"), f"{tmp_path}/invoice")
    assert records.invoice_of(spark, str(tmp_path), "a").collect() == [("a", "A2")] and records.invoice_of(spark, str(tmp_path), "b").collect() == [("b", "B1")]


def test_record_files(spark, tmp_path):
    record_files.register(spark)
    uri = tmp_path.as_uri()
    rows = [(f"d/{k}", n, json.dumps({"k": k, "n": n})) for k in range(20) for n in ("page_0001", "page_0002")] + [("..", ".", "{}"), ("", "é x", None)]
    d = spark.createDataFrame(rows, "doc_id string, name string, body string").repartition(3)
    d.write.format("record_files").mode("append").save(uri)
    back = spark.read.format("record_files").load(uri)
    assert sorted(tuple(r) for r in back.collect()) == sorted((a, b, c or "null") for a, b, c in rows)
    one = spark.read.format("record_files").load(uri).where("doc_id = 'd/7'")
    assert sorted(r.name for r in one.collect()) == ["page_0001", "page_0002"] and one.rdd.getNumPartitions() == 1 < back.rdd.getNumPartitions()

    # a task that fails leaves nothing that is seen, and its files are gone
    with pytest.raises(Exception):
        d.withColumn("body", F.when(F.col("doc_id") == "d/3", F.raise_error(F.lit("lost"))).otherwise(F.col("body"))).write.format("record_files").mode("append").save(uri)
    assert spark.read.format("record_files").load(uri).count() == len(rows)
    assert len([x for x in pafs.LocalFileSystem().get_file_info(pafs.FileSelector(str(tmp_path))) if x.base_name != "_commits"]) == 1
    d.limit(1).write.format("record_files").mode("append").save(uri)
    assert spark.read.format("record_files").load(uri).count() == len(rows) + 1
    d.limit(2).write.format("record_files").mode("overwrite").save(uri)
    assert spark.read.format("record_files").load(uri).count() == 2


def test_artifacts_are_listed_only(spark, tmp_path):
    for name in ("d1/basic/page_0001.png", "d1/ocr/page_0001.json", "d1/ocr/page_0002.json", "d2/strong/page_0001.png", "d2/notes.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"12345")
    there = files.artifacts(spark, str(tmp_path))
    assert "content" not in there._jdf.queryExecution().executedPlan().toString()
    pages = spark.createDataFrame([("d1", 1), ("d1", 2), ("d2", 1), ("d3", 1)], "doc_id string, page int")
    view = {(r.doc_id, r.page): (r.has_basic, r.has_strong, r.has_ocr) for r in files.pipeline_view(pages, there).collect()}
    assert view == {("d1", 1): (True, False, True), ("d1", 2): (False, False, True), ("d2", 1): (False, True, False), ("d3", 1): (False, False, False)}
    assert [(r.doc_id, r.page) for r in files.with_artifact(pages, there, "strong").collect()] == [("d2", 1)]


def test_settings_of_a_session(spark):
    assert Settings.of(spark) == Settings()
    spark.conf.set("folioscale.retry_below", "0.8"), spark.conf.set("folioscale.buckets", "8")
    try:
        assert Settings.of(spark) == Settings(retry_below=0.8, buckets=8)
        spark.conf.set("folioscale.buckets", "many")
        with pytest.raises(ValueError, match="folioscale.buckets"):
            Settings.of(spark)
        spark.conf.set("folioscale.buckets", "0")
        with pytest.raises(ValueError, match="folioscale.buckets"):
            Settings.of(spark)
    finally:
        spark.conf.unset("folioscale.retry_below"), spark.conf.unset("folioscale.buckets")


def test_impossible_dates_force_a_review(spark):
    text = "ACME Trading LLC\nInvoice No: INV-9\nInvoice Date: {}\nTotal Amount: USD 100.00\nDescription Qty Unit Price Amount\nConsulting 2 50.00 100.00\n"
    d = spark.createDataFrame([(x, text.format(x)) for x in ("2024-02-31", "31/02/2024", "February 31, 2024", "2024-02-29", "03/04/2024")], "d string, text string")
    got = {r.d: (r.invoice_date, r.review_reasons, r.needs_review) for r in invoices(d).collect()}
    assert all(got[x] == (x, ["invalid_date"], True) for x in ("2024-02-31", "31/02/2024", "February 31, 2024"))
    assert got["2024-02-29"] == ("2024-02-29", [], False) and got["03/04/2024"] == ("03/04/2024", ["ambiguous_date_format"], True)
