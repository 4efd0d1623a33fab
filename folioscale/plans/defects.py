"""Documents with planted defects, one kind for each rule that plain documents never reach, with their queries and SQL.

Which defect a document has follows from its key; both sides of each bound occur.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscale.functions import text as t
from folioscale.operators import evaluation, images, items, lines, receipt
from folioscale.plans.session import spread, table
from folioscale.plans.synth import cents, money
from folioscale.sources import files


def joined(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))


def choice(number: Column, *options: Column | str | None) -> Column:
    """The option at a number from 0; null beyond the last."""
    return F.get(F.array(*(F.lit(x) for x in options)), number.cast("int"))


# ---- lines of scanned pages


def noisy_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each order with upright lines, symbols, specks at the edges, words broken at line ends, and lines in pieces: ``doc_id`` and ``lines``."""
    k = F.col("o_orderkey")

    def line(text: Column | str, x: int | Column, y: int | Column, width: int = 200, height: int | Column = 20, confidence: float | Column = 0.95) -> Column:
        x, y, height = (F.lit(v) if isinstance(v, int) else v for v in (x, y, height))
        text = F.lit(text) if isinstance(text, str) else text
        # a line without text stands for one that isn't there
        return F.when(text.isNotNull(), F.struct(text.alias("text"), F.lit(None).cast("string").alias("line_id"), (F.lit(confidence) if isinstance(confidence, float) else confidence).alias("confidence"), lines.box_of(x, y, x + width, y + height).alias("bbox")))

    speck = k % 4
    found = F.array(
        line("x1", F.when(speck == 3, 80).otherwise(300), F.when(speck == 3, 160).otherwise(100), 30, 30, F.when(speck == 1, 0.0).when(speck == 2, 0.8).otherwise(0.5)),
        line(joined("page of order ", k), 90, 200),
        line(choice(k % 3, "**##==", "a#*%", "a#*"), 90, 300),
        line(choice(k % 5, "al-", "under-", "co¬", "plain", "a~"), 90, 400, confidence=0.9),
        line(choice(k % 5, "pha-", "stand", "operate", "words", "  b"), 90, 500, confidence=0.97),
        line(choice(k % 5, "bet", None, None, "more"), 90, 600),
        line(choice(k % 4, "left part", "re-", "end", "far"), 90, 700, confidence=0.99),
        line(choice(k % 4, "right part", "use", ", then", "away"), F.when(speck == 3, 341).otherwise(340), 712),
        line("upright", 600, 900, 20, F.when(k % 2 == 0, 81).otherwise(80)),
        line("last-", 90, 1100),
    )
    # recognition gives lines in any order
    return spread(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").select(k.alias("doc_id"), F.reverse(F.array_compact(found)).alias("lines"))


def noisy_page_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lines.postprocess(noisy_pages(spark, sf_dir))
    text = F.transform("lines", lambda x: x["text_clean"])
    right = F.transform("lines", lambda x: lines.bounds(x["bbox"])["right"].cast("long").cast("string"))
    return d.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.array_join(text, "|").alias("texts"), F.array_join(right, ",").alias("right_ends"), F.array_join(F.transform("lines", lambda x: cents(x["confidence"]).cast("string")), ",").alias("confidences"))


# ---- rows of a code and numbers


def code_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list for each part, of up to 129 rows of a code with quantity, unit price and amount around it in nine layouts: ``doc_id`` and ``lines``."""
    k = F.col("p_partkey")

    def row(j: Column) -> Column:
        code, q = joined((k * 7 + j) % 9000 + 1000), joined(j % 8 + 2)
        u, v = money(j % 90 * 100 + 1050), money(k % 90 * 100 + 1025)
        layouts = ((code, q, u, v), (v, "3", u, code, q), (v, q, code, u), (v, code, q), (v, "3", u, q, code), (v, v, v, code), (v, q, u, code), (v, "1.50", u, code), (v, q, code))
        return choice(j % 9, *(F.concat_ws(" ", *(F.lit(x) if isinstance(x, str) else x for x in y)) for y in layouts))

    rows = F.when(k % 130 > 0, F.transform(F.sequence(F.lit(0).cast("long"), k % 130 - 1), row)).otherwise(F.array().cast("array<string>"))
    return spread(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select(k.alias("doc_id"), F.concat(F.array(F.lit("Item Qty Amount")), rows, F.array(F.lit("Total 1.00"))).alias("lines"))


def code_row_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of rows in nine layouts, at most a hundred of each list."""
    d = code_lists(spark, sf_dir).select("doc_id", F.posexplode(items.line_items(F.col("lines"))).alias("n", "x"))
    return d.select("doc_id", F.col("n").cast("long").alias("n"), F.col("x.item_code").alias("item_code"), F.col("x.description").alias("description"), F.col("x.quantity").cast("long").alias("quantity"), cents(F.col("x.unit_price")).alias("unit_cents"), cents(F.col("x.amount")).alias("cents"))


# ---- receipts


def faulty_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A receipt for each order that may lack its number, merchant, date or total, or whose sums, change or handwriting are wrong: ``doc_id`` and ``lines``."""
    k = F.col("o_orderkey")
    q, unit = k % 3 + 1, (k % 20 + 1) * 100
    amount = q * unit + F.when(k % 9 == 0, 100).otherwise(0)
    total = amount + F.when(k % 11 == 0, 300).otherwise(0)
    change = F.lit(2000) + F.when(k % 13 == 0, 100).otherwise(0)
    texts = F.array_compact(F.array(
        F.when(k % 6 != 0, joined("ACME MART ", k % 7)),
        choice(k % 5, "CASH SALES", "CASH BILL", "RECEIPT", "TAX INVOICE"),
        F.when(k % 7 != 0, joined("Doc No: CS", k)),
        F.when(k % 8 != 0, F.lit("Date: 2024-05-06")),
        choice(k % 4, joined("GST ID: 000", k), joined("GST No. ", k, " ;"), joined("gstin# A", k)),
        *(F.lit(x) for x in ("TEL: 07-5551234", "FAX: 07-5551235", "No. 7 Jalan Besar", "Taman Indah", "Johor Bahru", "Tel 2", "Barcode 5", "Fax 3")),
        F.lit("CODE/DESC QTY PRICE AMOUNT"),
        joined(k % 900 + 100_100, " ", q, " ", money(unit), " ", money(amount)),
        F.lit("blue pens"),
        F.when(k % 10 != 0, joined("Total Sales RM ", money(total))),
        joined("Cash ", money(total + 2000)),
        joined("Change ", money(change)),
        choice(k % 4, joined("handwritten ", money(total)), "circled 7 99.50", "manual entry"),
    ))
    line = lambda x, i: F.struct(x.alias("text"), joined("l", i + 1).alias("line_id"), F.lit(0.9).alias("confidence"), lines.box_of(F.lit(0), i * 30, F.lit(400), i * 30 + 20).alias("bbox"))
    return spread(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").select(k.alias("doc_id"), F.transform(texts, line).alias("lines"))


def receipt_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = receipt.validate_receipts(receipt.receipts(faulty_receipts(spark, sf_dir)))
    amounts = {"total_cents": "total", "handwritten_cents": "handwritten_total", "final_cents": "final_total", "expected_change_cents": "checks.expected_change"}
    sources = (F.array_join(F.col("source_line_ids")[n], ",").alias(f"{n}_lines") for n in ("document_number", "date", "total", "cash_paid"))
    return d.select("doc_id", "merchant_name", "gst_id", "document_type", *(cents(F.col(v)).alias(n) for n, v in amounts.items()), "total_match", F.col("checks.totals_match").alias("totals_match"), *sources, F.array_join("warnings", ",").alias("warnings"), "is_valid")


# ---- leaning pages


def leaning_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A white page of 200 by 120 pixels for each supplier with a black bar that leans by -6 to 6 degrees, by its key."""
    k = F.col("s_suppkey")
    lean = F.radians((k % 7 - 3) * 2)
    c, s, half, thick = F.cos(lean), F.sin(lean), 70 + k % 11, 8 + k % 5
    width, height = 200, 120

    def row(y: Column) -> Column:
        down = y - height // 2

        # columns of the bar on this row: within its length, and within its thickness where the bar leans
        def between(e: Column) -> Column:
            low, high = F.greatest(e["a"], e["p"]), F.least(e["b"], e["q"])
            return t.let(F.struct(F.greatest(F.ceil(low), F.lit(0)).alias("l"), F.least(F.floor(high), F.lit(width - 1)).alias("h")), lambda r: F.when(r["h"] >= r["l"], F.concat(F.repeat(F.lit("FF"), r["l"].cast("int")), F.repeat(F.lit("00"), (r["h"] - r["l"] + 1).cast("int")), F.repeat(F.lit("FF"), (width - 1 - r["h"]).cast("int")))).otherwise("FF" * width))

        mid = F.lit(width / 2)
        p, q = mid + (down * c - thick) / s, mid + (down * c + thick) / s
        level = k % 7 == 3
        inside = F.abs(down) <= thick
        first = F.when(level, F.when(inside, 0.0).otherwise(float(width))).otherwise(F.least(p, q))
        last = F.when(level, F.when(inside, float(width)).otherwise(-1.0)).otherwise(F.greatest(p, q))
        return t.let(F.struct((mid + (-half - down * s) / c).alias("a"), (mid + (half - down * s) / c).alias("b"), first.alias("p"), last.alias("q")), between)

    pixels = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(height - 1)), row), ""))
    pages = table(spark, sf_dir, "supplier").select(k.alias("doc_id"), F.lit(1).alias("page"), F.lit(height).alias("height"), F.lit(width).alias("width"), pixels.alias("pixels"))
    # few bytes, but much work
    return pages.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")


def leaning_page_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measured lean of each page in whole degrees, and the warning that follows."""
    d = images.quality_warnings(images.image_measures(leaning_pages(spark, sf_dir), ["doc_id", "page"]))
    return d.select("doc_id", F.round("skew_angle").cast("long").alias("degrees"), F.array_contains("warnings", "receipt_may_be_skewed").alias("skewed"))


# ---- documents from pages, records from tables


def assembled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose lines are their pages: the manifest by the quality of each page's text, and the whole text where every third page gave none."""
    pages = lines.explode_lines(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", F.col("line_no").alias("page"), "text")
    d = files.assemble(files.manifest(pages), pages.where(F.col("page") % 3 != 0))
    native = F.size(F.filter("pages", lambda p: p["source"] == "native")).cast("long")
    return d.select("doc_id", F.size("pages").cast("long").alias("n_pages"), native.alias("native_pages"), F.length("full_text").cast("long").alias("n_chars"), F.md5("full_text").alias("text_md5"))


def evaluation_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's matches with the first of two tables of records that has it; one in seven is in neither."""
    k, total = F.col("o_orderkey"), cents(F.col("o_totalprice"))
    o = table(spark, sf_dir, "orders")
    record = lambda number, off: (k.alias("doc_id"), number.alias("invoice_number"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("invoice_date"), ((total + off) / 100).alias("total_amount"), joined("Firm ", k).alias("vendor_name"), (k % 2 == 0).alias("needs_review"), ((k % 64) / 64).alias("confidence"))
    first = o.where(k % 3 == 0).select(*record(joined(" inv-", k, " "), F.lit(1)))
    second = o.where(k % 7 != 1).select(*record(joined("OTHER-", k), F.lit(5)))
    truth = o.select(k.alias("doc_id"), joined("INV-", k).alias("invoice_number"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("invoice_date"), F.when(k % 5 != 0, (total / 100).cast("decimal(18,2)").cast("string")).alias("total_amount"), joined("FIRM ", k).alias("vendor_name"))
    d = evaluation.compare(truth, first, second)
    return d.select("doc_id", *(f"{n}_match" for n in ("invoice_number", "invoice_date", "total_amount", "vendor_name")), "needs_review", F.round(F.col("confidence") * 64).cast("long").alias("sixty_fourths"))


def shown_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidences and amounts as they are shown."""
    k = F.col("o_orderkey")
    code = choice(k % 4, "USD", "unknown", "")
    return table(spark, sf_dir, "orders").select(k.alias("doc_id"), t.percent(F.when(k % 9 != 0, k % 257 / 256)).alias("confidence"), t.money_text(F.when(k % 8 != 0, cents(F.col("o_totalprice")) / 100), code).alias("amount"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (noisy_page_cleaning, code_row_items, receipt_warnings, leaning_page_skew, assembled_documents, evaluation_fallback, shown_values)}

SQL: dict[str, str] = {
    "noisy_page_cleaning": """
-- specks go if under 0.8 sure (0: sure) at an edge, symbols if over 3 without or 2 for each letter, upright lines if over 4 times as high as wide
WITH o AS (SELECT o_orderkey AS k FROM orders),
p AS (SELECT k, list_filter([
  CASE WHEN k % 4 IN (1, 2) THEN {'t': 'x1', 'r': 330, 'c': CASE k % 4 WHEN 1 THEN 0 ELSE 80 END} WHEN k % 4 = 3 THEN {'t': 'x1', 'r': 110, 'c': 50} END,
  {'t': 'page of order ' || k, 'r': 290, 'c': 95},
  CASE WHEN k % 3 = 2 THEN {'t': 'a#*', 'r': 290, 'c': 95} END,
  CASE k % 5 WHEN 0 THEN {'t': 'alpha-', 'r': 290, 'c': 97} WHEN 1 THEN {'t': 'understand', 'r': 290, 'c': 97} WHEN 2 THEN {'t': 'cooperate', 'r': 290, 'c': 97} WHEN 3 THEN {'t': 'plain', 'r': 290, 'c': 90} ELSE {'t': 'ab', 'r': 290, 'c': 97} END,
  CASE k % 5 WHEN 3 THEN {'t': 'words', 'r': 290, 'c': 97} END,
  CASE k % 5 WHEN 0 THEN {'t': 'bet', 'r': 290, 'c': 95} WHEN 3 THEN {'t': 'more', 'r': 290, 'c': 95} END,
  CASE k % 4 WHEN 0 THEN {'t': 'left part right part', 'r': 540, 'c': 99} WHEN 1 THEN {'t': 'reuse', 'r': 540, 'c': 99} WHEN 2 THEN {'t': 'end, then', 'r': 540, 'c': 99} ELSE {'t': 'far', 'r': 290, 'c': 99} END,
  CASE k % 4 WHEN 3 THEN {'t': 'away', 'r': 541, 'c': 95} END,
  CASE WHEN k % 2 = 1 THEN {'t': 'upright', 'r': 620, 'c': 95} END,
  {'t': 'last-', 'r': 290, 'c': 95}], lambda x: x IS NOT NULL) AS l FROM o)
SELECT k AS doc_id, len(l) AS n_lines, array_to_string(list_transform(l, lambda x: x.t), '|') AS texts, array_to_string(list_transform(l, lambda x: x.r), ',') AS right_ends, array_to_string(list_transform(l, lambda x: x.c), ',') AS confidences FROM p""",
    "code_row_items": """
WITH j AS (SELECT p_partkey AS k, unnest(range(0, least(p_partkey % 130, 100))) AS j FROM part),
v AS (SELECT k, j, j % 8 + 2 AS q, j % 90 * 100 + 1050 AS u, k % 90 * 100 + 1025 AS v, CAST((k * 7 + j) % 9000 + 1000 AS VARCHAR) AS code FROM j)
SELECT k AS doc_id, j AS n, code AS item_code, code AS description, CAST(CASE WHEN j % 9 IN (5, 7) THEN 1 ELSE q END AS BIGINT) AS quantity, CASE WHEN j % 9 IN (3, 5, 8) THEN v ELSE u END AS unit_cents, v AS cents FROM v""",
    "receipt_warnings": """
-- marks at the end of a number go, white space before them stays; without a company, the first of eight lines without a word of other data is the merchant
WITH o AS (SELECT o_orderkey AS k, o_orderkey % 3 + 1 AS q, (o_orderkey % 20 + 1) * 100 AS unit FROM orders),
a AS (SELECT *, q * unit + CASE WHEN k % 9 = 0 THEN 100 ELSE 0 END AS amount FROM o),
b AS (SELECT *, amount + CASE WHEN k % 11 = 0 THEN 300 ELSE 0 END AS printed, 2000 + CASE WHEN k % 13 = 0 THEN 100 ELSE 0 END AS change FROM a),
c AS (SELECT *, CASE WHEN k % 10 <> 0 THEN printed END AS total FROM b),
d AS (SELECT *, CASE k % 4 WHEN 0 THEN printed WHEN 1 THEN 9950 WHEN 2 THEN total END AS written FROM c),
e AS (SELECT *, CASE WHEN k % 6 <> 0 THEN 'ACME MART ' || k % 7 WHEN k % 4 = 2 THEN 'gstin# A' || k END AS merchant, coalesce(total, written) AS final, CAST(k % 6 <> 0 AS INTEGER) + CAST(k % 5 <> 4 AS INTEGER) AS before, CAST(k % 7 <> 0 AS INTEGER) AS number, CAST(k % 8 <> 0 AS INTEGER) AS dated FROM d),
f AS (SELECT *, before + number + dated + CAST(k % 4 <> 3 AS INTEGER) + 12 AS priced FROM e),
w AS (SELECT *, array_to_string(list_filter([CASE WHEN number = 0 THEN 'document_number_missing' END, CASE WHEN merchant IS NULL THEN 'merchant_missing' END, CASE WHEN dated = 0 THEN 'date_missing' END, CASE WHEN final IS NULL THEN 'total_missing' END,
  CASE WHEN abs(amount - final) > 5 THEN 'line_item_sum_does_not_match_total' END, CASE WHEN k % 9 = 0 THEN 'line_1_quantity_price_amount_mismatch' END, CASE WHEN abs(printed + 2000 - final - change) > 2 THEN 'cash_paid_change_calculation_failed' END,
  CASE WHEN abs(total - written) > 2 THEN 'handwritten_total_does_not_match_printed_total' END], lambda x: x IS NOT NULL), ',') AS warnings FROM f)
SELECT k AS doc_id, merchant AS merchant_name, CASE k % 4 WHEN 0 THEN '000' || k WHEN 1 THEN k || ' ' WHEN 2 THEN 'A' || k END AS gst_id, CASE k % 5 WHEN 0 THEN 'cash_sales' WHEN 1 THEN 'cash_bill' WHEN 2 THEN 'receipt' ELSE 'invoice' END AS document_type,
  total AS total_cents, written AS handwritten_cents, final AS final_cents, printed + 2000 - final AS expected_change_cents, CASE WHEN written IS NOT NULL THEN coalesce(abs(total - written) <= 2, FALSE) END AS total_match, coalesce(abs(total - written) <= 2, abs(amount - final) <= 5) AS totals_match,
  CASE WHEN number = 1 THEN 'l' || (before + 1) ELSE '' END AS document_number_lines, CASE WHEN dated = 1 THEN 'l' || (before + number + 1) ELSE '' END AS date_lines, CASE WHEN total IS NOT NULL THEN 'l' || priced ELSE '' END AS total_lines,
  CASE WHEN k % 5 IN (0, 1) THEN 'l' || before || ',' ELSE '' END || 'l' || (priced + CAST(total IS NOT NULL AS INTEGER)) AS cash_paid_lines, warnings, warnings = '' AS is_valid FROM w""",
    "leaning_page_skew": "SELECT s_suppkey AS doc_id, (s_suppkey % 7 - 3) * 2 AS degrees, abs(s_suppkey % 7 - 3) >= 2 AS skewed FROM supplier",
    "assembled_documents": r"""
WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') AS l FROM documents),
p AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS page FROM l),
m AS (SELECT *, length(x) >= 50 AND len(regexp_split_to_array(x, '\s+')) >= 5 AND length(regexp_replace(x, '[^\x20-\x7e\t\n\r\x0b\x0c؀-ۿݐ-ݿࢠ-ࣿ]', '', 'g')) / length(x) >= 0.85 AS native FROM p),
d AS (SELECT doc_id, count(*) AS n_pages, count(*) FILTER (native) AS native_pages, coalesce(string_agg(x, chr(10) || chr(10) ORDER BY page) FILTER (page % 3 <> 0), '') AS t FROM m GROUP BY doc_id)
SELECT doc_id, n_pages, native_pages, length(t) AS n_chars, md5(t) AS text_md5 FROM d""",
    "evaluation_fallback": """
WITH o AS (SELECT o_orderkey AS k, o_orderkey % 3 = 0 AS one, o_orderkey % 3 = 0 OR o_orderkey % 7 <> 1 AS there FROM orders)
SELECT k AS doc_id, one AS invoice_number_match, there AS invoice_date_match, CASE WHEN k % 5 = 0 THEN NOT there ELSE one END AS total_amount_match, there AS vendor_name_match, there AND k % 2 = 0 AS needs_review, CASE WHEN there THEN k % 64 ELSE 0 END AS sixty_fourths FROM o""",
    "shown_values": """
WITH o AS (SELECT o_orderkey AS k, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders)
SELECT k AS doc_id, CASE WHEN k % 9 = 0 THEN '-' ELSE ((k % 257 * 200 + 256) // 512) || '%' END AS confidence, CASE WHEN k % 8 = 0 THEN '-' ELSE CASE WHEN k % 4 = 0 THEN 'USD ' ELSE '' END || c // 100 || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') END AS amount FROM o""",
}
