"""Receipts: sections of a page, the receipt record and its checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscale.functions import text as t
from folioscale.operators.invoice import MONEY_TOLERANCE, SUM_TOLERANCE, extract, near, validate
from folioscale.operators.items import RECEIPT_ITEM, receipt_items
from folioscale.operators.lines import bounds

# The sections of a receipt and, in their order, the words that decide them.
SECTIONS = ("header_company", "merchant_contact", "document_metadata", "items_table", "totals_payment", "footer_notes", "handwritten_area", "barcode")
SECTION_WORDS = (
    ("barcode", r"barcode|qr"),
    ("document_metadata", r"cashier|salesperson|doc(?:ument)?\s*no|date|time|gst\s*id"),
    ("items_table", r"code/?desc|\bitem\b.*\bqty\b|\bqty\b.*\bamount\b|s/price"),
    ("totals_payment", r"total\s+sales|rounded\s+total|\btotal\b|cash|change|rounding|discount|subtotal"),
    ("merchant_contact", r"tel|fax|@|jalan|taman|johor|address"),
    ("footer_notes", r"thank|goods sold|return|exchange"),
)
HANDWRITING = r"hand\s*written|circled|manual"
SOURCES = {"document_number": r"doc(?:ument)?\s*no", "date": r"\bdate\b", "cashier": r"\bcashier\b", "total": r"total\s+sales|rounded\s+total|\btotal\b", "cash_paid": r"\bcash\b", "change": r"\bchange\b"}


def raw_section(text: Column, y_ratio: Column) -> Column:
    """A line's section by its words, else by its height on the page: the top is the company, the bottom notes, between are items."""
    low, out = F.lower(text), None
    for name, words in SECTION_WORDS:
        test = t.has(low, words, t.C)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.when(y_ratio < 0.22, "header_company").when(y_ratio > 0.86, "footer_notes").otherwise("items_table")


def sectioned(lines: Column) -> Column:
    """Lines (``text``, ``bbox``) with their ``section``: ``array<struct<line, section>>``.

    Once items have begun, a company line is an item; once totals have begun, an item line without a leading code is a note.
    """
    bottom = F.coalesce(F.array_max(F.transform(lines, lambda x: bounds(x["bbox"])["bottom"])), F.lit(0.0))

    def rows(height: Column) -> Column:
        raw = F.transform(lines, lambda x: F.struct(x.alias("line"), raw_section(x["text"], F.when(height != 0, bounds(x["bbox"])["top"] / height)).alias("raw")))

        def made(r: Column) -> Column:
            # the last line that began items or totals, and whether any began totals, up to and with each line
            last = lambda i: t.last_of(F.transform(F.slice(r, F.lit(1), i + 1), lambda x: F.when(x["raw"] == "items_table", True).when(x["raw"] == "totals_payment", False)))
            totals = lambda i: F.exists(F.slice(r, F.lit(1), i + 1), lambda x: x["raw"] == "totals_payment")
            final = lambda s, x, i: F.when(totals(i) & (s == "items_table") & ~F.rlike(x["line"]["text"], F.lit(r"^\d{3,}\b")), "footer_notes").otherwise(s)
            first = lambda x, i: F.when((x["raw"] == "header_company") & F.coalesce(last(i), F.lit(False)), "items_table").otherwise(x["raw"])
            return F.transform(r, lambda x, i: F.struct(x["line"].alias("line"), final(first(x, i), x, i).alias("section")))

        return t.let(raw, made)

    return t.let(bottom, rows)


def sections(lines: Column) -> Column:
    """Map of each section to its lines."""
    return t.let(sectioned(lines), lambda s: F.create_map(*(part for n in SECTIONS for part in (F.lit(n), F.transform(F.filter(s, lambda x: x["section"] == n), lambda x: x["line"])))))


def source_lines(lines: Column, pattern: str) -> Column:
    """Ids of the lines that have a pattern."""
    return F.transform(F.filter(lines, lambda x: t.has(x["text"], pattern) & (F.coalesce(x["line_id"], F.lit("")) != "")), lambda x: x["line_id"])


def document_kind(title: Column, invoice_type: Column) -> Column:
    low = F.lower(F.coalesce(F.nullif(title, F.lit("")), invoice_type, F.lit("")))
    return F.when(F.contains(low, F.lit("cash sales")), "cash_sales").when(F.contains(low, F.lit("cash bill")), "cash_bill").when(F.contains(low, F.lit("receipt")), "receipt").when(F.contains(low, F.lit("invoice")), "invoice").otherwise("unknown")


def receipts(docs: DataFrame, id_col: str = "doc_id", lines_col: str = "lines", fixed_amounts: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """The receipt record of documents given as lines (``text, line_id, confidence``), one row each, after the columns to ``keep``. ``fixed_amounts`` is as in ``receipt_items``."""
    d = docs.select(F.col(id_col), *keep, F.col(lines_col).alias("__l")).withColumn("__t", F.array_join(F.transform("__l", lambda x: F.coalesce(x["text"], F.lit(""))), "\n"))
    d = validate(extract(d, "__t"))
    lines, c = F.col("__l"), F.col
    own = receipt_items(lines, fixed_amounts)
    other = F.transform("line_items", lambda x: F.struct(x["item_code"], x["description"], x["quantity"], x["unit_price"], F.lit(None), x["amount"], F.lit(0.0), F.array().cast("array<string>")).cast(RECEIPT_ITEM))
    marked = F.filter(lines, lambda x: t.has(x["text"], HANDWRITING))
    amounts = lambda x: F.filter(F.transform(F.regexp_extract_all(x["text"], F.lit(r"\d+(?:[,.]\d{2})"), F.lit(0)), t.parse_amount), lambda v: v.isNotNull())
    written = F.coalesce(t.first_of(F.transform(marked, lambda x: F.try_element_at(amounts(x), F.lit(-1)))), F.when(F.size(marked) > 0, c("total_amount")))
    d = d.withColumns({"__own": own, "handwritten_total": written})
    note = F.nullif(F.array_join(F.filter(F.transform(F.slice(lines, F.greatest(F.size(lines) - 7, F.lit(1)), 8), lambda x: t.strip_all(x["text"])), lambda x: t.has(x, "thank|goods sold|return|exchange|note")), " "), F.lit(""))
    return d.select(
        id_col,
        *keep,
        c("vendor_name").alias("merchant_name"),
        c("vendor_address").alias("merchant_address"),
        c("vendor_phone").alias("phone"),
        c("vendor_email").alias("email"),
        "gst_id",
        document_kind(c("document_title"), c("document_type")).alias("document_type"),
        c("invoice_number").alias("document_number"),
        c("invoice_date").alias("date"),
        c("transaction_time").alias("time"),
        "cashier",
        "salesperson",
        F.when(c("currency") == "MYR", "RM").otherwise(c("currency")).alias("currency"),
        F.when(F.size("__own") > 0, c("__own")).otherwise(other).alias("line_items"),
        "subtotal",
        "discount",
        "rounding",
        c("total_amount").alias("total"),
        c("cash_received").alias("cash_paid"),
        c("change_amount").alias("change"),
        c("total_amount").alias("printed_total"),
        "handwritten_total",
        F.coalesce("total_amount", "handwritten_total").alias("final_total"),
        F.when(c("handwritten_total").isNotNull(), near(c("total_amount"), c("handwritten_total"))).alias("total_match"),
        note.alias("footer_note"),
        F.create_map(*(x for n, p in SOURCES.items() for x in (F.lit(n), source_lines(lines, p)))).alias("source_line_ids"),
    )


def validate_receipts(d: DataFrame) -> DataFrame:
    """Add ``warnings``, ``is_valid`` and ``checks`` to receipt records."""
    c = F.col
    amounts = F.filter(F.transform("line_items", lambda x: x["amount"]), lambda v: v.isNotNull())
    line_sum = F.when(F.size(amounts) > 0, F.round(F.aggregate(amounts, F.lit(0.0), lambda s, v: s + v), 2))
    d = d.withColumns({"__sum": line_sum, "__total": F.coalesce("final_total", "total"), "__printed": F.coalesce("printed_total", "total")})
    d = d.withColumn("__expected", F.round(c("cash_paid") - c("__total"), 2)).withColumn("__match", F.when(c("__printed").isNotNull() & c("handwritten_total").isNotNull(), near(c("__printed"), c("handwritten_total"))))
    wrong = F.array_compact(F.transform("line_items", lambda x, i: F.when(~near(F.round(x["qty"] * x["unit_price"], 2), x["amount"], SUM_TOLERANCE) & (x["qty"] * x["unit_price"] * x["amount"]).isNotNull(), F.concat(F.lit("line_"), (i + 1).cast("string"), F.lit("_quantity_price_amount_mismatch")))))
    one = lambda test, name: F.array_compact(F.array(F.when(test, name)))
    warnings = F.concat(
        one(c("document_number").isNull(), "document_number_missing"),
        one(c("merchant_name").isNull(), "merchant_missing"),
        one(c("date").isNull(), "date_missing"),
        one(c("__total").isNull(), "total_missing"),
        one(c("__sum").isNotNull() & c("__total").isNotNull() & ~near(c("__sum"), c("__total"), SUM_TOLERANCE), "line_item_sum_does_not_match_total"),
        F.coalesce(wrong, F.array().cast("array<string>")),
        one(c("__expected").isNotNull() & c("change").isNotNull() & ~near(c("__expected"), c("change"), MONEY_TOLERANCE), "cash_paid_change_calculation_failed"),
        one(~c("__match"), "handwritten_total_does_not_match_printed_total"),
    )
    checks = F.struct(c("__sum").alias("line_items_sum"), c("__printed").alias("printed_total"), "handwritten_total", "cash_paid", "change", c("__expected").alias("expected_change"), F.coalesce("__match", F.when(c("__sum").isNotNull() & c("__total").isNotNull(), near(c("__sum"), c("__total"), SUM_TOLERANCE))).alias("totals_match"))
    return d.withColumns({"warnings": warnings, "checks": checks}).withColumn("is_valid", F.size("warnings") == 0).drop("__sum", "__total", "__printed", "__expected", "__match")
