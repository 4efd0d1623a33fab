"""The registered queries of the document engine and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscale.functions import text as t
from folioscale.operators import evaluation, images, layout, lines, receipt
from folioscale.operators.invoice import invoices
from folioscale.plans import defects, documents, synth
from folioscale.plans.session import ship, table
from folioscale.plans.synth import cents
from folioscale.sources import files


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invoices(synth.invoice_texts(spark, sf_dir)).select("doc_id", "invoice_number", "invoice_date", "total_amount", "confidence", "needs_review")


def native_text_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", t.text_quality(F.col("text")).alias("q"), t.use_native_text(F.col("text")).alias("native"))
    return d.select("doc_id", F.col("q.char_count").cast("long").alias("char_count"), F.col("q.word_count").cast("long").alias("word_count"), "native")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.explode_lines(table(spark, sf_dir, "documents"), "doc_id", "text")


def line_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_lines(spark, sf_dir).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line_id", F.length("text").cast("long").alias("n_chars"))


def line_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("text")
    return document_lines(spark, sf_dir).groupBy("doc_id").agg(F.count_if(t.is_garbage(x)).alias("garbage"), F.count_if(t.is_suspicious(x)).alias("suspicious"), F.count_if(F.length(x) <= 3).alias("short"))


def scored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with confidences in hundredths that follow from their place."""
    return document_lines(spark, sf_dir).withColumn("confidence", ((F.col("doc_id") * 7 + F.col("line_no") * 13) % 21 + 80) / 100)


def retry_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lines.page_scores(scored_lines(spark, sf_dir), ["doc_id"])
    return d.select("doc_id", F.round(F.col("confidence") * 1_000_000).cast("long").alias("confidence_millionths"), "suspicious_lines", "short_lines", lines.should_retry(F.col("confidence"), F.col("suspicious_lines")).alias("retry"))


def retry_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    base = table(spark, sf_dir, "orders").select(k.alias("doc_id"), F.explode(F.array(*(F.struct(F.lit(m).alias("mode"), ((k * a) % 64 / 1024 + 0.9375).alias("confidence"), ((k * b) % 64 / 512 + 0.75).alias("quality_score")) for m, a, b in (("basic", 5, 3), ("receipt", 7, 11), ("sorie", 13, 5), ("strong", 17, 23))))).alias("p"))
    return lines.choose_pass(base.select("doc_id", "p.*"), ["doc_id"]).select("doc_id", "selected_mode")


def amount_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "orders")
    c = F.round(F.col("o_totalprice") * 100).cast("long")
    plain = synth.money(c)
    swapped = F.translate(plain, ",.", ".,")
    forms = F.array(plain, F.concat(F.lit("USD "), plain), F.concat(F.lit("$"), plain), swapped, F.concat(F.lit("-"), plain))
    d = x.select("o_orderkey", F.posexplode_outer(forms).alias("form", "raw"))
    return d.select("o_orderkey", F.col("form").cast("long").alias("form"), cents(t.parse_amount(F.col("raw"))).alias("cents"))


def date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate")
    forms = F.array(*(F.date_format(day, f) for f in ("yyyy-MM-dd", "d MMMM yyyy", "MMM d, yyyy", "dd/MM/yyyy", "MM-dd-yy", "d/M/yyyy")))
    d = table(spark, sf_dir, "orders").select("o_orderkey", F.posexplode_outer(forms).alias("form", "raw"))
    d = d.withColumn("p", t.parse_date(F.col("raw"), F.col("form") == 5))
    return d.select("o_orderkey", F.col("form").cast("long").alias("form"), F.col("p.value").alias("value"), F.col("p.ambiguous").alias("ambiguous"))


def invoice_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = invoices(synth.invoice_texts(spark, sf_dir))
    return d.select("doc_id", "invoice_number", "invoice_date", "vendor_name", "vendor_address", "buyer_name", "currency", "document_type", "payment_method", *(cents(F.col(n)).alias(n) for n in ("subtotal", "tax", "discount", "total_amount")))


def invoice_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = invoices(synth.invoice_texts(spark, sf_dir)).select("doc_id", F.posexplode_outer("line_items").alias("n", "x")).where(F.col("n").isNotNull())
    return d.select("doc_id", F.col("n").cast("long").alias("n"), F.col("x.description").alias("description"), F.col("x.quantity").cast("long").alias("quantity"), cents(F.col("x.unit_price")).alias("unit_cents"), cents(F.col("x.amount")).alias("cents"))


def invoice_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = invoices(synth.invoice_texts(spark, sf_dir))
    return d.select("doc_id", F.round(F.col("confidence") * 100).cast("long").alias("confidence"), "needs_review", F.array_join("review_reasons", ",").alias("reasons"))


def review_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invoices(synth.invoice_texts(spark, sf_dir)).select(F.explode_outer("review_reasons").alias("reason")).where(F.col("reason").isNotNull()).groupBy("reason").agg(F.count("*").alias("n"))


def invoice_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = invoices(synth.invoice_texts(spark, sf_dir))
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey", "left")
    k = F.col("o_orderkey")
    truth = o.select(k.alias("doc_id"), F.concat(F.lit("inv-"), k.cast("string")).alias("invoice_number"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("invoice_date"), F.lit("").alias("total_amount"), F.concat(F.replace("c_name", F.lit("Customer#"), F.lit("FIRM ")), F.lit(" TRADING LLC")).alias("vendor_name"))
    s = evaluation.summarize(evaluation.compare(truth, found))
    fields = ("invoice_number_accuracy", "invoice_date_accuracy", "total_amount_accuracy", "vendor_name_accuracy")
    return s.select(*(F.round(F.col(n) * 10_000).cast("long").alias(n) for n in fields), "document_count")


def layout_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = synth.order_lines(spark, sf_dir).withColumn("p", layout.placed(F.col("lines")))
    p = F.col("p")
    return d.select("doc_id", layout.labelled_value(p, t.NUMBER_LABELS, t.NUMBER_VALUE).alias("right_of_number"), layout.labelled_value(p, t.DATE_LABELS, t.DATE).alias("below_date"), F.size(layout.rows_of(p)).cast("long").alias("n_rows"))


def layout_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = synth.order_lines(spark, sf_dir).select("doc_id", F.posexplode_outer(layout.layout_items(layout.placed(F.col("lines")))).alias("n", "x")).where(F.col("n").isNotNull())
    return d.select("doc_id", F.col("n").cast("long").alias("n"), F.col("x.description").alias("description"), F.col("x.quantity").cast("long").alias("quantity"), cents(F.col("x.unit_price")).alias("unit_cents"), cents(F.col("x.amount")).alias("cents"))


def layout_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = layout.invoices_from_lines(synth.order_lines(spark, sf_dir))
    return d.select("doc_id", "invoice_number", "invoice_date", cents(F.col("total_amount")).alias("total_cents"), F.size("line_items").cast("long").alias("n_items"))


def receipt_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = synth.receipt_pages(spark, sf_dir).select("doc_id", F.explode(receipt.sectioned(F.col("lines"))).alias("x"))
    return d.groupBy("doc_id", F.col("x.section").alias("section")).agg(F.count("*").alias("n"))


def items_of_receipts(spark: SparkSession, sf_dir: str, fixed_amounts: bool) -> DataFrame:
    d = synth.receipt_pages(spark, sf_dir).select("doc_id", F.posexplode_outer(receipt.receipt_items(F.col("lines"), fixed_amounts)).alias("n", "x")).where(F.col("n").isNotNull())
    return d.select("doc_id", F.col("n").cast("long").alias("n"), F.col("x.item_code").alias("item_code"), F.col("x.description").alias("description"), F.col("x.qty").cast("long").alias("quantity"), cents(F.col("x.unit_price")).alias("unit_cents"), cents(F.col("x.amount")).alias("cents"), cents(F.col("x.confidence")).alias("confidence"), F.size("x.source_line_ids").cast("long").alias("n_sources"))


def receipt_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items_of_receipts(spark, sf_dir, False)


def receipt_items_whole_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items_of_receipts(spark, sf_dir, True)


def receipt_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = receipt.validate_receipts(receipt.receipts(synth.receipt_pages(spark, sf_dir)))
    return d.select("doc_id", "document_number", "date", "currency", cents(F.col("total")).alias("total_cents"), cents(F.col("cash_paid")).alias("cash_cents"), cents(F.col("change")).alias("change_cents"), "footer_note", F.array_join("warnings", ",").alias("warnings"), "is_valid")


def sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page sizes and measures in whole numbers that follow from the orders' keys."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("doc_id"), (k * 37 % 3000).cast("int").alias("width"), (k * 53 % 4000 + 1).cast("int").alias("height"), (k % 160).cast("double").alias("blur_score"), (k * 3 % 256).cast("double").alias("brightness"), ((k % 13) - 6).cast("double").alias("skew_angle"), ((k % 64) / 64).alias("text_density"), F.when(k % 9 != 0, (k % 32) / 32).alias("content_area_ratio"))


def image_upscale_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = F.col("width"), F.col("height")
    return sized(spark, sf_dir).select("doc_id", (images.upscale(w) * 2).cast("long").alias("halves"), F.round(images.receipt_scale(w, h) * 1000).cast("long").alias("receipt_thousandths"), images.orientation(w, h).alias("orientation"))


def image_quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.quality_warnings(sized(spark, sf_dir)).select("doc_id", F.array_join("warnings", ",").alias("warnings"), "status")


def drawn_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A white page of 60 by 40 pixels for each supplier, with a black box whose place and size follow from the key."""
    k = F.col("s_suppkey")
    left, top, w, h = 5 + k % 9, 6 + k % 5, 12 + k % 23, 10 + k % 13
    white, black = (lambda n: F.repeat(F.lit("FF"), n.cast("int"))), (lambda n: F.repeat(F.lit("00"), n.cast("int")))
    row = F.concat(white(left), black(w), white(60 - left - w))
    pixels = F.unhex(F.concat(white(60 * top), F.repeat(row, h.cast("int")), white(60 * (40 - top - h))))
    pages = table(spark, sf_dir, "supplier").select(k.alias("doc_id"), F.lit(1).alias("page"), F.lit(40).alias("height"), F.lit(60).alias("width"), pixels.alias("pixels"))
    # few bytes, but much work
    return pages.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")


def page_image_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is measured from pixels: dark pixels by density, by content box and by brightness, the skew and the warnings that follow."""
    d = images.quality_warnings(images.image_measures(drawn_pages(spark, sf_dir), ["doc_id", "page"]))
    dark = (("density_pixels", F.col("text_density") * 2400), ("content_pixels", F.col("content_area_ratio") * 2400), ("brightness_pixels", (255 - F.col("brightness")) * 2400 / 255))
    return d.select("doc_id", *(F.round(x).cast("long").alias(n) for n, x in dark), F.round(F.col("skew_angle") * 100).cast("long").alias("skew_hundredths"), "orientation", F.array_contains("warnings", "document_content_is_small").alias("small"))


def prepared_page_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages after straightening, trimming, scaling and borders, in each mode."""
    d = images.prepare_pages(drawn_pages(spark, sf_dir), ["doc_id", "page"])
    corner = F.hex(F.substring("pixels", 1, 1)) == "FF"
    return d.select("doc_id", "mode", F.col("height").cast("long").alias("height"), F.col("width").cast("long").alias("width"), (F.octet_length("pixels") == F.col("height") * F.col("width")).alias("whole"), corner.alias("white_corner"))


def box_reader() -> Callable[[np.ndarray], list[tuple[str, float, list[list[float]]]]]:
    """Stands for an engine: reads the black box of a drawn page as a receipt of as many pieces as it is high, at the price of its width.

    It is unsure of boxes whose width is a multiple of three, but in black and white; it finds nothing on trimmed pages, and fails on boxes 13 high.
    """

    def read(page: np.ndarray) -> list[tuple[str, float, list[list[float]]]]:
        if page.shape != (116, 156):
            return []
        dark = page < 128
        w, h = int(dark.any(axis=0).sum()) // 2, int(dark.any(axis=1).sum()) // 2
        if h == 13:
            raise ValueError("unreadable")
        sure = w % 3 != 0 or set(np.unique(page)) <= {0, 255}
        rows = ["ACME MART SDN BHD", f"Doc No: CS{100 * w + h}", "Date: 15/01/2024", "CODE/DESC QTY PRICE AMOUNT", f"100123 {h} {w}.00 {w * h}.00", "blue pens", f"Total Sales RM {w * h}.00", f"Cash {w * h + 10}.00", "Change 10.00"]
        box = lambda y: [[10.0, y], [300.0, y], [300.0, y + 20], [10.0, y + 20]]
        return [(x, 0.97 if sure else 0.5, box(60.0 * i)) for i, x in enumerate(rows)]

    return read


def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way of documents: drawn pages are recognised in two stages, some have a page of text besides; records and failed readings of each document."""
    scans = drawn_pages(ship(spark), sf_dir)
    k = F.col("doc_id")
    terms = F.concat(F.lit("Goods stay property of our house until they are paid for in full, see file "), k.cast("string"))
    pages = scans.select(k, F.explode(F.array(F.struct(F.lit(1).alias("page"), F.lit("").alias("text")), F.struct(F.lit(2).alias("page"), F.when(k % 4 == 0, terms).alias("text")))).alias("p")).select("doc_id", "p.*").where("text IS NOT NULL")
    found, failed = documents.document_records(pages, scans, box_reader)
    errors = failed.where("error = 'ValueError: unreadable'").groupBy("doc_id").agg(F.count("*").alias("failed_readings"))
    r, c = F.col("receipt"), F.col
    d = found.join(errors, "doc_id", "left")
    return d.select(
        "doc_id", F.size("pages").cast("long").alias("n_pages"), F.array_join(F.transform("pages", lambda p: F.concat_ws(":", p["source"], p["mode"])), ",").alias("sources"), F.right("full_text", F.lit(8)).alias("text_end"), r["document_number"].alias("document_number"), r["date"].alias("date"), c("invoice.invoice_number").alias("invoice_number"), cents(r["total"]).alias("total_cents"), F.size(r["line_items"]).cast("long").alias("n_items"),
        F.array_join(r["warnings"], ",").alias("warnings"), r["is_valid"].alias("is_valid"), F.coalesce(F.size(c("layout")["items_table"]), F.lit(0)).cast("long").alias("n_table_lines"), c("quality.page_count").alias("quality_pages"), F.coalesce("failed_readings", F.lit(0)).cast("long").alias("failed_readings"),
    )


def pipeline_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    pages = table(spark, sf_dir, "orders").select(k.alias("doc_id"), F.lit(1).alias("page"))
    x = F.col("doc_id")
    artifacts = pages.select("doc_id", "page", F.explode(F.array_compact(F.array(F.when(x % 2 == 0, "basic"), F.when(x % 3 == 0, "receipt"), F.when(x % 5 == 0, "ocr")))).alias("kind"))
    return files.pipeline_view(pages, artifacts).select("doc_id", "has_basic", "has_receipt", "has_strong", "has_ocr")


def page_postprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised lines of all orders, cleaned and joined into paragraphs."""
    d = lines.postprocess(synth.order_lines(spark, sf_dir))
    return d.select("doc_id", F.size("lines").cast("long").alias("n_lines"), lines.paragraphs(F.col("lines"), "text_clean").alias("text"))


def page_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lines.page_scores(scored_lines(spark, sf_dir), ["doc_id"])
    return d.select("doc_id", F.round(F.col("quality_score") * 1_000).cast("long").alias("thousandths"))


def shop_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts, inline labels, title, type, currency, totals and items of cash receipts as texts."""
    d = invoices(synth.shop_texts(spark, sf_dir))
    x = F.try_element_at("line_items", F.lit(1))
    fields = ("vendor_name", "vendor_registration_number", "vendor_address", "vendor_phone", "vendor_fax", "vendor_email", "document_title", "document_type", "invoice_number", "invoice_date", "transaction_time", "cashier", "salesperson", "reference", "currency", "payment_method")
    return d.select("doc_id", *fields, *(cents(F.col(n)).alias(n) for n in ("subtotal", "total_amount", "cash_received", "change_amount")), F.col("total_quantity").cast("long").alias("total_quantity"), F.size("line_items").cast("long").alias("n_items"), x["item_code"].alias("item_code"), x["description"].alias("description"), x["quantity"].cast("long").alias("quantity"), cents(x["unit_price"]).alias("unit_cents"), cents(x["amount"]).alias("cents"), F.array_join("review_reasons", ",").alias("reasons"))


def normalized_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with misread words, digits and marks, cleaned."""
    k = F.col("o_orderkey")
    noisy = F.concat(F.lit(" The Coumittee  met ,  room I"), F.lpad((k % 100).cast("string"), 2, "0"), F.lit("l and l"), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit(" .. ﬁle no~ "), F.lpad((k % 900 + 100).cast("string"), 3, "0"), F.lit("I — Iearned of. The end of. it  "))
    return table(spark, sf_dir, "orders").select(k.alias("doc_id"), t.normalize_text(noisy).alias("text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        native_text_routing,
        line_explode,
        line_flags,
        retry_decision,
        retry_select,
        amount_parse,
        date_parse,
        invoice_header,
        invoice_items,
        invoice_validation,
        review_reason_counts,
        invoice_evaluation,
        layout_labels,
        layout_items,
        layout_invoices,
        receipt_sections,
        receipt_items,
        receipt_items_whole_amounts,
        receipt_validation,
        image_upscale_plan,
        image_quality_flags,
        page_image_measures,
        prepared_page_sizes,
        document_records,
        pipeline_view,
        page_postprocess,
        page_quality_score,
        shop_fields,
        normalized_lines,
    )
} | defects.QUERIES

_LINES = r"""texts AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '')) AS text, generate_subscripts(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> ''), 1) AS line_no FROM documents)"""
_SUSPICIOUS = r"""(regexp_matches(text, '[~|¦`]') OR regexp_matches(text, '\b[Il]\d{2,}\b|\b\d{2,}[Il]\b|\b[Il]\d{2}[Il]\b') OR regexp_matches(text, '[A-Za-z]{3,}[~\-]$'))"""
_ITEMS = """items AS (SELECT l_orderkey AS k, l_partkey AS part, CAST(l_quantity AS BIGINT) AS quantity, CAST(round(l_extendedprice * 100) AS BIGINT) % 9900 + 100 AS cents,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) - 1 AS n FROM lineitem),
sums AS (SELECT o_orderkey AS k, CAST(coalesce(sum(cents), 0) AS BIGINT) AS subtotal, CAST(coalesce(sum(cents * quantity), 0) AS BIGINT) AS whole, count(cents) AS c FROM orders LEFT JOIN items ON k = o_orderkey GROUP BY o_orderkey)"""
# the receipt's second line of an item ends in a part number; of four digits or more, it is read as amounts of three digits each and the rest
_PARTS = """read AS (SELECT *, CAST(part AS VARCHAR) AS p, (length(CAST(part AS VARCHAR)) - 1) // 3 AS before FROM items),
own AS (SELECT *, before > 0 AS long, CAST(substr(p, 3 * before + 1) AS BIGINT) * 100 AS last, CASE WHEN before > 0 THEN CAST(substr(p, 3 * before - 2, 3) AS BIGINT) * 100 END AS unit FROM read)"""
_TRUTH = f"""{_ITEMS},
base AS (SELECT o_orderkey AS k, o_custkey, o_orderdate, c_name, coalesce(subtotal, 0) AS subtotal, coalesce(c, 0) AS c FROM orders LEFT JOIN sums ON k = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey),
taxed AS (SELECT *, subtotal * 6 // 100 AS tax, k % 10 * 10 AS discount FROM base),
truth AS (SELECT *, CASE WHEN k % 11 <> 3 THEN subtotal + tax - discount + CASE WHEN k % 13 = 4 THEN 500 ELSE 0 END END AS total,
  k % 5 = 2 AND day(o_orderdate) <= 12 AS ambiguous,
  CASE WHEN k % 5 = 2 AND day(o_orderdate) <= 12 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d FROM taxed),
judged AS (SELECT *, k % 13 = 4 AND total IS NOT NULL AS mismatch FROM truth),
scored AS (SELECT *, 65 + CASE WHEN total IS NOT NULL THEN 25 ELSE 0 END + CASE WHEN c > 0 THEN 10 ELSE 0 END - CASE WHEN mismatch THEN 10 ELSE 0 END AS points FROM judged),
reasoned AS (SELECT *, least(100, points) AS confidence, list_filter([CASE WHEN ambiguous THEN 'ambiguous_date_format' END, CASE WHEN least(100, points) < 75 THEN 'low_ocr_confidence' END, CASE WHEN total IS NULL THEN 'missing_total_amount' END, CASE WHEN mismatch THEN 'total_mismatch' END], lambda x: x IS NOT NULL) AS reasons FROM scored)"""

SQL: dict[str, str] = {
    "native_text_routing": r"""
WITH s AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS x FROM documents),
m AS (SELECT doc_id, length(x) AS char_count, CASE WHEN x = '' THEN 0 ELSE len(regexp_split_to_array(x, '\s+')) END AS word_count, length(regexp_replace(x, '[^\x20-\x7e\t\n\r\x0b\x0c؀-ۿݐ-ݿࢠ-ࣿ]', '', 'g')) AS good FROM s)
SELECT doc_id, char_count, CAST(word_count AS BIGINT) AS word_count, char_count >= 50 AND word_count >= 5 AND good / char_count >= 0.85 AS native FROM m""",
    "line_explode": f"WITH {_LINES} SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, 'p0001_l' || lpad(CAST(line_no AS VARCHAR), 4, '0') AS line_id, length(text) AS n_chars FROM texts",
    "line_flags": rf"""
WITH {_LINES}, m AS (SELECT *, length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) AS letters, length(regexp_replace(text, '[\p{{L}}\p{{N}}\s]', '', 'g')) AS symbols FROM texts)
SELECT doc_id, count(*) FILTER ((letters = 0 AND symbols > 3) OR (letters > 0 AND symbols > 2 * letters)) AS garbage, count(*) FILTER {_SUSPICIOUS} AS suspicious, count(*) FILTER (length(text) <= 3) AS short FROM m GROUP BY doc_id""",
    "retry_decision": rf"""
WITH {_LINES}, m AS (SELECT doc_id, avg(((doc_id * 7 + line_no * 13) % 21 + 80) / 100) AS c, count(*) FILTER {_SUSPICIOUS} AS suspicious_lines, count(*) FILTER (length(text) <= 3) AS short_lines FROM texts GROUP BY doc_id)
SELECT doc_id, CAST(round(c * 1000000) AS BIGINT) AS confidence_millionths, suspicious_lines, short_lines, c < 0.9 OR (c < 0.9 + 0.03::DOUBLE AND suspicious_lines >= 2) AS retry FROM m""",
    "page_quality_score": rf"""
WITH {_LINES}, m AS (SELECT doc_id, avg(((doc_id * 7 + line_no * 13) % 21 + 80) / 100) AS c, count(*) FILTER {_SUSPICIOUS} AS s, count(*) FILTER (length(text) <= 3) AS n FROM texts GROUP BY doc_id)
SELECT doc_id, CAST(round((c - 0.015::DOUBLE * s - 0.01::DOUBLE * n) * 1000) AS BIGINT) AS thousandths FROM m""",
    "shop_fields": """
-- a line with two numbers of three digits or more has no prices, so its item stays without an amount and is dropped
WITH o AS (SELECT o_orderkey AS k, o_orderdate AS d, (o_orderkey % 50 + 1) * 500 AS unit, o_orderkey % 4 + 1 AS q FROM orders), s AS (SELECT *, CASE WHEN unit < 10000 THEN 1 END AS read FROM o)
SELECT k AS doc_id, 'KEDAI BUKU ' || k % 7 || ' SDN BHD' AS vendor_name, 'JM' || (k % 9000 + 1000) || '-H' AS vendor_registration_number, CASE WHEN k % 2 = 0 THEN 'NO ' || (k % 90 + 1) || ' JALAN BESAR' END AS vendor_address,
  '07-' || (k % 9000 + 1000) AS vendor_phone, '07-' || (k % 8000 + 1000) AS vendor_fax, 'shop' || k || '@mail.example.com' AS vendor_email, CASE k % 3 WHEN 0 THEN 'CASH SALES' WHEN 1 THEN 'TAX INVOICE' END AS document_title, CASE WHEN k % 3 = 0 THEN 'cash_sales_receipt' ELSE 'invoice' END AS document_type,
  'CS' || k AS invoice_number, strftime(d, '%Y-%m-%d') AS invoice_date, '09:4' || k % 10 || ':00' AS transaction_time, 'USER' || k % 5 AS cashier, 'S' || k % 4 AS salesperson, 'R' || k AS reference, CASE k % 4 WHEN 1 THEN 'EUR' WHEN 2 THEN 'USD' ELSE 'MYR' END AS currency, CASE WHEN k % 6 = 0 THEN 'bank transfer' END AS payment_method,
  unit * q AS subtotal, unit * q + 5 AS total_amount, unit * q + 2005 AS cash_received, CAST(2000 AS BIGINT) AS change_amount, q AS total_quantity, CAST(coalesce(read, 0) AS BIGINT) AS n_items, CASE WHEN read = 1 THEN CAST(k % 1000 + 10000000 AS VARCHAR) END AS item_code, CASE WHEN read = 1 THEN 'PEN SET' || CASE WHEN k % 5 = 0 THEN ' BLUE INK' ELSE '' END END AS description, q * read AS quantity, unit * read AS unit_cents, unit * q * read AS cents, '' AS reasons FROM s""",
    "normalized_lines": "SELECT o_orderkey AS doc_id, 'The Committee met, room 1' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') || '1 and 1' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') || '. file no~ ' || (o_orderkey % 900 + 100) || '1 - learned of The end of it' AS text FROM orders",
    "retry_select": """
WITH p AS (SELECT o_orderkey AS doc_id, list_transform([('basic', 5, 3), ('receipt', 7, 11), ('sorie', 13, 5), ('strong', 17, 23)], lambda m: {'mode': m[1], 'c': (o_orderkey * m[2]) % 64 / 1024 + 0.9375::DOUBLE, 's': (o_orderkey * m[3]) % 64 / 512 + 0.75::DOUBLE}) AS l FROM orders)
SELECT doc_id, list_reduce(l, lambda a, b: CASE WHEN b.c >= a.c + 0.01::DOUBLE OR (b.c >= a.c - 0.005::DOUBLE AND b.s > a.s + 0.02::DOUBLE) THEN b ELSE a END).mode AS selected_mode FROM p""",
    "amount_parse": "SELECT o_orderkey, form, CASE WHEN form = 4 THEN -1 ELSE 1 END * CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders, (SELECT unnest(range(0, 5)) AS form)",
    "date_parse": """
SELECT o_orderkey, form, (form IN (3, 4) AND day(o_orderdate) <= 12) AS ambiguous,
  CASE WHEN form IN (3, 4) AND day(o_orderdate) <= 12 THEN CASE form WHEN 3 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE strftime(o_orderdate, '%m-%d-%y') END
       WHEN form = 4 THEN '20' || strftime(o_orderdate, '%y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS value
FROM orders, (SELECT unnest(range(0, 6)) AS form)""",
    "invoice_header": f"""
WITH {_TRUTH}
SELECT k AS doc_id, 'INV-' || k AS invoice_number, d AS invoice_date, replace(c_name, 'Customer#', 'Firm ') || ' Trading LLC' AS vendor_name, (k % 90 + 10) || ' Main Street' || CASE WHEN k % 7 = 1 THEN chr(10) || 'lnvoice No: INV-' || k ELSE '' END AS vendor_address, 'Shop ' || o_custkey AS buyer_name, 'USD' AS currency, 'invoice' AS document_type, 'card' AS payment_method,
  subtotal, tax, discount, total AS total_amount FROM truth""",
    "invoice_items": f"WITH {_ITEMS} SELECT k AS doc_id, n, 'Widget P' || part AS description, quantity, cents AS unit_cents, cents FROM items",
    "invoice_validation": f"WITH {_TRUTH} SELECT k AS doc_id, CAST(confidence AS BIGINT) AS confidence, confidence < 75 OR ambiguous OR total IS NULL OR mismatch AS needs_review, array_to_string(reasons, ',') AS reasons FROM reasoned",
    "review_reason_counts": f"WITH {_TRUTH} SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM reasoned) GROUP BY reason",
    "invoice_evaluation": f"""
WITH {_TRUTH}
SELECT CAST(10000 AS BIGINT) AS invoice_number_accuracy, CAST(round(round(avg(CAST(NOT ambiguous AS INTEGER)), 4) * 10000) AS BIGINT) AS invoice_date_accuracy, CAST(round(round(avg(CAST(total IS NULL AS INTEGER)), 4) * 10000) AS BIGINT) AS total_amount_accuracy,
  CAST(10000 AS BIGINT) AS vendor_name_accuracy, count(*) AS document_count FROM truth""",
    "layout_labels": f"WITH {_ITEMS} SELECT o_orderkey AS doc_id, 'INV-' || o_orderkey AS right_of_number, strftime(o_orderdate, '%Y-%m-%d') AS below_date, 6 + c AS n_rows FROM orders JOIN sums ON k = o_orderkey",
    "layout_items": f"WITH {_ITEMS} SELECT k AS doc_id, n, 'Widget P' || part AS description, quantity, cents AS unit_cents, cents FROM items",
    "layout_invoices": f"WITH {_ITEMS} SELECT o_orderkey AS doc_id, 'INV-' || o_orderkey AS invoice_number, strftime(o_orderdate, '%Y-%m-%d') AS invoice_date, subtotal AS total_cents, c AS n_items FROM orders JOIN sums ON k = o_orderkey",
    "receipt_sections": f"""
WITH {_ITEMS}, low AS (SELECT k, c, len(list_filter(range(5, 5 + 2 * c), lambda j: (30 * j)::DOUBLE / (30 * (8 + 2 * c) + 20)::DOUBLE > 0.86::DOUBLE)) AS f FROM sums)
SELECT k AS doc_id, s AS section, CAST(m AS BIGINT) AS n FROM (SELECT k, unnest(['header_company', 'merchant_contact', 'document_metadata', 'items_table', 'totals_payment', 'footer_notes']) AS s, unnest([1, 1, 2, 1 + 2 * c - f, 3, 1 + f]) AS m FROM low)""",
    "receipt_items": f"""
WITH {_ITEMS}, {_PARTS},
rows AS (SELECT k, n, 1 AS second, CAST(part + 100000 AS VARCHAR) AS item_code, CASE WHEN long THEN CAST(part + 100000 AS VARCHAR) ELSE 'widget P' || p END AS description, quantity, cents AS unit_cents, cents * quantity AS cents, CASE WHEN long THEN 1 ELSE 2 END AS n_sources FROM own
  UNION ALL SELECT k, n, 0, NULL, 'widget P', NULL, unit, last, 1 FROM own WHERE long)
SELECT k AS doc_id, row_number() OVER (PARTITION BY k ORDER BY n, second) - 1 AS n, item_code, description, quantity, unit_cents, cents, CAST(90 AS BIGINT) AS confidence, CAST(n_sources AS BIGINT) AS n_sources FROM rows""",
    "receipt_items_whole_amounts": f"WITH {_ITEMS} SELECT k AS doc_id, n, CAST(part + 100000 AS VARCHAR) AS item_code, 'widget P' || part AS description, quantity, cents AS unit_cents, cents * quantity AS cents, CAST(90 AS BIGINT) AS confidence, CAST(2 AS BIGINT) AS n_sources FROM items",
    "receipt_validation": f"""
WITH {_ITEMS}, {_PARTS}, extra AS (SELECT k, CAST(sum(CASE WHEN long THEN last ELSE 0 END) AS BIGINT) AS e FROM own GROUP BY k),
r AS (SELECT k, c, CASE WHEN k % 9 = 2 THEN 100 ELSE 0 END AS planted, whole, coalesce(e, 0) AS e FROM sums LEFT JOIN extra USING (k)),
w AS (SELECT *, c > 0 AND abs(e - planted) > 5 AS wrong FROM r)
SELECT k AS doc_id, 'CS' || k AS document_number, '2024-05-06' AS date, 'RM' AS currency, whole + planted AS total_cents, whole + planted + 250 AS cash_cents, CAST(250 AS BIGINT) AS change_cents, 'Thank you' AS footer_note,
  CASE WHEN wrong THEN 'line_item_sum_does_not_match_total' ELSE '' END AS warnings, NOT wrong AS is_valid FROM w""",
    "page_postprocess": f"""
WITH {_ITEMS}, body AS (SELECT k, string_agg(printf(' Widget P%d' || chr(10) || chr(10) || '%.2f %.2f %d', part, cents / 100, cents / 100, quantity), '' ORDER BY n) AS rows FROM items GROUP BY k),
t AS (SELECT o_orderkey AS k, o_orderdate, c, coalesce(rows, '') AS rows, format('{{:,}}', subtotal // 100) || '.' || lpad(CAST(subtotal % 100 AS VARCHAR), 2, '0') AS total FROM orders JOIN sums ON sums.k = o_orderkey LEFT JOIN body ON body.k = o_orderkey)
SELECT k AS doc_id, 9 + 2 * c AS n_lines, replace('ACME Trading LLC||Invoice No||INV-' || k || ' Invoice Date ' || strftime(o_orderdate, '%Y-%m-%d') || '||Description||Unit Price Amount Qty' || rows || '||Total Amount||USD ' || total, '||', chr(10) || chr(10)) AS text FROM t""",
    "image_upscale_plan": """
WITH s AS (SELECT o_orderkey AS doc_id, o_orderkey * 37 % 3000 AS w, o_orderkey * 53 % 4000 + 1 AS h FROM orders),
f AS (SELECT *, CASE WHEN w > 0 THEN least(4.0::DOUBLE, greatest(2600 / w, 3600 / h, 1.0::DOUBLE)) ELSE 1.0::DOUBLE END AS x FROM s)
SELECT doc_id, CAST(CASE WHEN w <= 0 OR w >= 1800 THEN 2 WHEN w <= 900 THEN 4 ELSE 3 END AS BIGINT) AS halves, CASE WHEN x <= 1.01::DOUBLE THEN 1000 ELSE CAST(round(x * 1000) AS BIGINT) END AS receipt_thousandths, CASE WHEN w = h THEN 'square' WHEN w > h THEN 'landscape' ELSE 'portrait' END AS orientation FROM f""",
    "image_quality_flags": """
WITH s AS (SELECT o_orderkey AS k FROM orders),
w AS (SELECT k, array_to_string(list_filter([CASE WHEN k % 160 < 80 THEN 'image_is_blurry' END, CASE WHEN k * 3 % 256 < 70 THEN 'image_is_dark' END, CASE WHEN k * 3 % 256 > 235 THEN 'image_is_too_light' END, CASE WHEN k % 64 = 0 THEN 'low_text_density' END, CASE WHEN k % 64 > 35 THEN 'high_foreground_density' END,
  CASE WHEN k % 9 <> 0 AND k % 32 < 7 THEN 'document_content_is_small' END, CASE WHEN abs(k % 13 - 6) > 3 THEN 'receipt_may_be_skewed' END], lambda x: x IS NOT NULL), ',') AS warnings FROM s)
SELECT k AS doc_id, warnings, CASE WHEN warnings = '' THEN 'ok' ELSE 'low_quality' END AS status FROM w""",
    "page_image_measures": """
WITH b AS (SELECT s_suppkey AS k, (12 + s_suppkey % 23) * (10 + s_suppkey % 13) AS n FROM supplier)
SELECT k AS doc_id, n AS density_pixels, n AS content_pixels, n AS brightness_pixels, CAST(0 AS BIGINT) AS skew_hundredths, 'landscape' AS orientation, n < 480 AS small FROM b""",
    "prepared_page_sizes": """
-- a trimmed page keeps 12 pixels around its content where the page has them
WITH b AS (SELECT s_suppkey AS k, 5 + s_suppkey % 9 AS l, 6 + s_suppkey % 5 AS t, 12 + s_suppkey % 23 AS w, 10 + s_suppkey % 13 AS h FROM supplier),
c AS (SELECT k, w * h AS n, least(60, l + w + 12) - greatest(0, l - 12) AS cw, least(40, t + h + 12) - greatest(0, t - 12) AS ch FROM b),
m AS (SELECT *, unnest(['basic', 'receipt', 'sorie', 'strong']) AS mode FROM c),
p AS (SELECT *, mode IN ('receipt', 'sorie') AND (mode = 'sorie' OR n * 100 >= 2400 * 8) AS cut, CASE WHEN mode = 'sorie' THEN 4 ELSE 2 END AS scale, CASE WHEN mode = 'sorie' THEN 48 ELSE 36 END AS border FROM m)
SELECT k AS doc_id, mode, CAST(CASE WHEN cut THEN ch ELSE 40 END * scale + border AS BIGINT) AS height, CAST(CASE WHEN cut THEN cw ELSE 60 END * scale + border AS BIGINT) AS width, TRUE AS whole, TRUE AS white_corner FROM p""",
    "document_records": """
-- boxes 13 high fail wherever the page isn't trimmed: in basic, in strong, and in receipt where the box covers under 8 % of the page
WITH b AS (SELECT s_suppkey AS k, 12 + s_suppkey % 23 AS w, 10 + s_suppkey % 13 AS h, s_suppkey % 4 = 0 AS more FROM supplier),
r AS (SELECT *, h = 13 AS bad, w % 3 = 0 AS weak FROM b),
t AS (SELECT *, CASE WHEN more THEN 'see file ' || k WHEN bad THEN '' ELSE 'Change 10.00' END AS ending FROM r)
SELECT k AS doc_id, CAST(1 + CAST(more AS INTEGER) AS BIGINT) AS n_pages, 'ocr:' || CASE WHEN weak AND NOT bad THEN 'strong' ELSE 'basic' END || CASE WHEN more THEN ',native' ELSE '' END AS sources, right(ending, 8) AS text_end,
  CASE WHEN NOT bad THEN 'CS' || (100 * w + h) END AS document_number, CASE WHEN NOT bad THEN '2024-01-15' END AS date, CASE WHEN NOT bad THEN 'CS' || (100 * w + h) END AS invoice_number, CASE WHEN NOT bad THEN w * h * 100 END AS total_cents, CAST(NOT bad AS BIGINT) AS n_items,
  CASE WHEN bad THEN 'document_number_missing,' || CASE WHEN more THEN '' ELSE 'merchant_missing,' END || 'date_missing,total_missing' ELSE '' END AS warnings, NOT bad AS is_valid, CAST(CASE WHEN bad THEN CAST(more AS INTEGER) ELSE 3 END AS BIGINT) AS n_table_lines, CAST(1 AS BIGINT) AS quality_pages,
  CAST(CASE WHEN bad THEN 2 + CAST(w * h * 100 < 2400 * 8 AS INTEGER) ELSE 0 END AS BIGINT) AS failed_readings FROM t""",
    "pipeline_view": "SELECT o_orderkey AS doc_id, o_orderkey % 2 = 0 AS has_basic, o_orderkey % 3 = 0 AS has_receipt, FALSE AS has_strong, o_orderkey % 5 = 0 AS has_ocr FROM orders",
} | defects.SQL
