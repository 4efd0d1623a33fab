"""Invoices from text: header fields, parties, arithmetic checks, confidence and reasons for review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscale.functions import text as t
from folioscale.functions.once import once
from folioscale.operators.items import line_items

# Tolerances, the weights of the confidence, and reasons that force a review.
MONEY_TOLERANCE, SUM_TOLERANCE, REVIEW_BELOW = 0.02, 0.05, 0.75
BLOCKING = ("missing_invoice_number", "missing_invoice_date", "missing_total_amount", "ambiguous_date_format", "total_mismatch", "line_items_subtotal_mismatch", "line_items_total_mismatch", "line_items_quantity_mismatch", "cash_change_mismatch")
# our own: a date that can't be, such as 31/02/2024, stays text and forces a review
INVALID_DATE = "invalid_date"
BUYER = r"\b(?:bill to|billed to|customer|client|buyer)\b"
BUYER_WORDS = ("bill", "billed", "customer", "client", "buyer")
ADDRESS_END = r"invoice|doc(?:ument)?\s*no|documentno|bill to|date|total|subtotal|cash\s+(?:sales|bill)|tel|fax|gst\s*id|@"
ADDRESS = r"\d|street|st\.?|road|rd\.?|ave|avenue|city|egypt|usa|zip|jalan|taman|johor|bahru"


def near(a: Column, b: Column, tolerance: float = MONEY_TOLERANCE) -> Column:
    """Equal up to a tolerance; false if either is null."""
    return F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))


def vendor(lines: Column) -> Column:
    """struct(name, ends): the first company among ten lines, with up to two lines that continue it, else the first of eight that is no metadata.

    ``ends`` is the place of its last line, from 0. ``lines`` are stripped and not empty.
    """
    at = lambda i: F.get(lines, i)
    place = F.array_position(F.transform(F.slice(lines, 1, 10), lambda x: t.has(x, t.COMPANY)), True).cast("int") - 1

    def company(i: Column) -> Column:
        name = at(i)
        joins = lambda whole, x: ~t.has(x, t.METADATA) & (t.has(F.concat_ws(" ", whole, x), t.COMPANY) | t.is_all(x, "[A-Z&(). -]{2,}", t.C))
        one, two = at(i + 1), at(i + 2)
        first = F.concat_ws(" ", name, one)
        suffix = lambda x: t.has(x, t.COMPANY_SUFFIX)
        made = lambda n, e: F.struct(n.alias("name"), e.alias("ends"))
        with_one = F.when(suffix(first) | two.isNull() | ~joins(first, two), made(first, i + 1)).otherwise(made(F.concat_ws(" ", first, two), i + 2))
        skip_one = F.when(one.isNotNull() & ~t.has(one, t.METADATA) & two.isNotNull() & joins(name, two), made(F.concat_ws(" ", name, two), i + 2)).otherwise(made(name, i))
        return F.when(suffix(name) | one.isNull(), made(name, i)).when(joins(name, one), with_one).otherwise(skip_one)

    other = F.array_position(F.transform(F.slice(lines, 1, 8), lambda x: ~t.has(x, t.METADATA)), True).cast("int") - 1
    none = F.struct(F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("ends"))
    first = t.let(other, lambda o: F.when(o >= 0, F.struct(at(o).alias("name"), (F.array_position(lines, at(o)).cast("int") - 1).alias("ends"))).otherwise(none))
    return t.let(place, lambda p: F.when(p >= 0, company(p)).otherwise(first))


def buyer(lines: Column) -> Column:
    """What follows the first label of a buyer, or the line after it."""

    def of(i: Column) -> Column:
        line = F.get(lines, i)
        rest = t.strip(F.regexp_replace(line, t.I + r".*?(?:bill to|billed to|customer|client|buyer)\s*[:#-]?\s*", ""))
        return t.let(rest, lambda r: F.when((r != "") & (F.lower(r) != F.lower(line)), r).otherwise(F.get(lines, i + 1)))

    place = F.array_position(F.transform(lines, lambda x: t.has(x, BUYER)), True).cast("int") - 1
    return t.let(place, lambda p: F.when(p >= 0, of(p)))


def address(lines: Column, ends: Column) -> Column:
    """Of the six lines after the vendor, up to one of other data, those that look like an address and are no registration number."""
    stop = lambda after: F.array_position(F.transform(after, lambda x: t.has(x, ADDRESS_END)), True).cast("int")
    before = lambda after: t.let(stop(after), lambda s: F.when(s > 0, F.slice(after, F.lit(1), s - 1)).otherwise(after))
    kept = F.filter(t.let(F.slice(lines, ends + 2, 6), before), lambda x: ~t.is_all(x, t.REGISTRATION) & t.has(x, ADDRESS))
    return F.when(ends.isNotNull(), t.let(F.array_join(kept, "\n"), lambda x: F.nullif(x, F.lit(""))))


@once
def _parts() -> dict[str, Column]:
    x, lines = F.col("__text"), F.col("__lines")
    return {"__cleaned": F.filter(F.transform(lines, lambda x: t.strip(x)), lambda s: s != ""), "__day_first": t.is_malaysian(x), "__shape": t.shape(x)}


@once
def _shapes() -> Column:
    return t.lines_of(F.col("__shape"))


@once
def _dates_and_vendor() -> dict[str, Column]:
    x, shaped = F.col("__text"), F.col("__shape")
    return {"__date": t.labelled_date(x, t.DATE_LABELS, F.col("__day_first"), shaped), "__due": t.labelled_date(x, t.DUE_LABELS, F.col("__day_first"), shaped), "__vendor": vendor(F.col("__cleaned"))}


@once
def _fields(items_where: str | None) -> dict[str, Column]:
    x, lines, shaped, shapes = F.col("__text"), F.col("__lines"), F.col("__shape"), F.col("__shapes")
    items = line_items(lines)
    return {
        "document_type": t.document_type(x, shaped),
        "document_title": t.document_title(lines, shapes),
        "vendor_name": F.col("__vendor.name"),
        "vendor_registration_number": t.registration_number(lines),
        "vendor_address": address(F.col("__cleaned"), F.col("__vendor.ends")),
        "vendor_phone": t.phone(lines, shaped, shapes),
        "vendor_fax": t.fax(lines, shaped, shapes),
        "vendor_email": t.email(x),
        "gst_id": t.labelled_text(lines, ("GST ID", "GST No", "GSTIN"), 60, shaped, shapes),
        "buyer_name": t.where_held(shaped, BUYER_WORDS, buyer(F.col("__cleaned"))),
        "invoice_number": t.invoice_number(lines, shaped, shapes),
        "invoice_date": F.col("__date.value"),
        "due_date": F.col("__due.value"),
        **{k: t.labelled_amount(x, v, shaped) for k, v in t.AMOUNT_LABELS.items() if k != "change_amount"},
        "total_amount": t.total_amount(x, lines, shaped, shapes),
        "total_quantity": t.total_quantity(x),
        "__change": t.labelled_amount(x, t.AMOUNT_LABELS["change_amount"], shaped),
        "currency": t.currency(x, shaped),
        "payment_method": t.payment_method(x),
        "cashier": t.cashier(lines, shaped, shapes),
        "transaction_time": t.transaction_time(x, shaped),
        "salesperson": t.inline_text(lines, "Salesperson", ("Ref", "Time", "Date"), 80, shaped, shapes),
        "reference": t.inline_text(lines, "Ref", ("Time", "Date"), 80, shaped, shapes),
        "line_items": items if items_where is None else F.when(F.col(items_where), items),
        "ambiguous_date": F.col("__date.ambiguous") | F.col("__due.ambiguous"),
    }


def extract(docs: DataFrame, text_col: str = "text", items_where: str | None = None) -> DataFrame:
    """Add all invoice fields of a text, unvalidated, plus ``ambiguous_date``. A null text counts as empty. All other columns stay, so they must not have the fields' names.

    With ``items_where``, a column, the items of rows where it isn't true are not read, and null.
    """
    d = docs.withColumn("__text", F.coalesce(F.col(text_col), F.lit(""))).withColumn("__lines", t.lines_of(F.col("__text")))
    d = d.withColumns(_parts()).withColumn("__shapes", _shapes()).withColumns(_dates_and_vendor()).withColumns(_fields(items_where))
    d = d.withColumn("change_amount", F.coalesce("__change", F.round(F.col("cash_received") - F.col("total_amount"), 2)))
    return d.drop("__text", "__lines", "__cleaned", "__day_first", "__date", "__due", "__vendor", "__change", "__shape", "__shapes")


def validate(fields: DataFrame) -> DataFrame:
    """Add ``confidence``, ``needs_review`` and ``review_reasons`` (sorted) to extracted fields; ``currency`` becomes unknown if null."""
    c = F.col
    given = lambda n: F.coalesce(c(n), F.lit("")) != ""
    amounts = F.filter(F.transform("line_items", lambda x: x["amount"]), lambda v: v.isNotNull())
    quantities = F.filter(F.transform("line_items", lambda x: x["quantity"]), lambda v: v.isNotNull())
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    d = fields.withColumn("currency", F.when(given("currency"), c("currency")).otherwise("unknown")).withColumns({"__amounts": F.coalesce(amounts, F.array().cast("array<double>")), "__quantities": F.coalesce(quantities, F.array().cast("array<double>"))})
    some = F.size("__amounts") > 0
    expected = c("subtotal") + F.coalesce(c("tax"), F.lit(0.0)) - F.coalesce(c("discount"), F.lit(0.0))
    checks = {
        "total_mismatch": c("total_amount").isNotNull() & c("subtotal").isNotNull() & (c("tax").isNotNull() | c("discount").isNotNull()) & ~near(c("total_amount"), expected),
        "line_items_subtotal_mismatch": some & c("subtotal").isNotNull() & ~near(c("subtotal"), total("__amounts"), SUM_TOLERANCE),
        "line_items_total_mismatch": (F.size("__amounts") >= 2) & c("subtotal").isNull() & c("total_amount").isNotNull() & ~near(c("total_amount"), total("__amounts"), SUM_TOLERANCE),
        "line_items_quantity_mismatch": (F.size("__quantities") > 0) & c("total_quantity").isNotNull() & ~near(c("total_quantity"), total("__quantities"), SUM_TOLERANCE),
        "cash_change_mismatch": c("total_amount").isNotNull() & c("cash_received").isNotNull() & c("change_amount").isNotNull() & ~near(c("change_amount"), c("cash_received") - c("total_amount")),
    }
    d = d.withColumn("__failed", F.array_compact(F.array(*(F.when(v, k) for k, v in checks.items()))))
    weights = ((given("invoice_number"), 15), (given("invoice_date"), 15), (c("total_amount").isNotNull(), 25), (given("vendor_name"), 15), (c("currency") != "unknown", 10), (F.coalesce(F.size("line_items"), F.lit(0)) > 0, 10), (c("total_quantity").isNotNull() | c("cash_received").isNotNull(), 5), (F.size("__failed") == 0, 10))
    points = sum((F.when(test, n).otherwise(0) for test, n in weights), F.lit(0))
    d = d.withColumn("confidence", F.least(F.lit(1.0), points / 100))
    missing = {"missing_invoice_number": ~given("invoice_number"), "missing_invoice_date": ~given("invoice_date"), "missing_total_amount": c("total_amount").isNull(), "currency_not_detected": c("currency") == "unknown", "low_ocr_confidence": c("confidence") < REVIEW_BELOW, "ambiguous_date_format": F.coalesce(c("ambiguous_date"), F.lit(False))}
    impossible = lambda n: c(n).isNotNull() & c(n).try_cast("date").isNull()
    missing[INVALID_DATE] = ~missing["ambiguous_date_format"] & (impossible("invoice_date") | impossible("due_date"))
    reasons = F.array_sort(F.array_distinct(F.concat("__failed", F.array_compact(F.array(*(F.when(v, k) for k, v in missing.items()))))))
    d = d.withColumn("review_reasons", reasons)
    blocking = F.array(*(F.lit(x) for x in (*BLOCKING, INVALID_DATE)))
    return d.withColumn("needs_review", (c("confidence") < REVIEW_BELOW) | F.arrays_overlap("review_reasons", blocking)).drop("__amounts", "__quantities", "__failed", "ambiguous_date")


def invoices(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Validated invoice fields of every text."""
    return validate(extract(docs, text_col))
