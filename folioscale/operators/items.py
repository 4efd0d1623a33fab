"""Line items of invoices and receipts, read from lines of text by one pass over an array of lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscale.functions.text import AMOUNT, WHOLE_AMOUNT, C, I, amount_tokens, amounts_in, group, has, is_all, let, parse_amount, parse_price, receipt_amounts, strip, unless_empty

# Words of table heads, of what ends a table, and of lines that are no items.
ITEM_WORDS, QUANTITY_WORDS = r"\b(description|code/?desc|item|service|product)\b", r"\b(qty|quantity|unit|price|amount|s/price)\b"
STOP = r"\b(subtotal|sub total|total\s+qty|total\s+sales|grand\s+total|total|tax|discount|balance|amount due|payment|cash|change|rounding)\b"
NO_ITEM = r"\b(invoice|date|due|bill to|ship to|customer|client|address|cashier|salesperson|ref\.?|tel|fax|gst\s*id)\b"
UNITS = r"(?:PC|PCS|EA|UNIT|UNITS)"
RECEIPT_HEAD = r"\b(item|code/?desc|description)\b.*\b(qty|price|amount|disc|s/price)\b"
RECEIPT_STOP = r"\b(total\s+qty|total\s+sales|rounded\s+total|\btotal\b|cash|change|rounding|discount|subtotal)\b"
MOST_ITEMS = 100

ITEM = "struct<item_code:string,description:string,quantity:double,unit_price:double,amount:double>"
RECEIPT_ITEM = "struct<item_code:string,description:string,qty:double,unit_price:double,discount:double,amount:double,confidence:double,source_line_ids:array<string>>"


def item(code: Column | None, description: Column, quantity: Column | None, unit_price: Column, amount: Column) -> Column:
    null = F.lit(None)
    return F.struct(null if code is None else code, description, null if quantity is None else quantity, unit_price, amount).cast(ITEM)


def is_head(text: Column) -> Column:
    return has(text, ITEM_WORDS) & has(text, QUANTITY_WORDS)


def description_and_code(text: Column) -> Column:
    """An item without amounts, from a line with words and a code of 8 to 14 digits."""
    code = group(text, r"\b(\d{8,14})\b")
    rest = F.coalesce(unless_empty(strip(F.regexp_replace(text, C + r"\b\d{8,14}\b", ""), " -|\t")), text)
    none = F.lit(None).cast("double")
    return F.when(has(text, r"\b\d{8,14}\b", C) & has(text, "[A-Z]{2,}"), item(code, rest, none, none, none))


def code_row(text: Column) -> Column:
    """An item from a line with exactly one whole number of three digits or more, its code; the numbers around it tell the columns apart."""

    def of(parts: Column) -> Column:
        return let(F.struct(parts.alias("parts"), F.transform(parts, lambda p: is_all(p, r"\d{3,}", C)).alias("codes")), one_code)

    def one_code(s: Column) -> Column:
        at = F.array_position(s["codes"], True)
        return F.when(F.size(F.filter(s["codes"], lambda c: c)) == 1, let(at, lambda a: sided(s["parts"], a)))

    def sided(parts: Column, at: Column) -> Column:
        numbers = lambda a: F.filter(F.transform(a, parse_amount), lambda x: x.isNotNull())
        sides = F.struct(numbers(F.slice(parts, 1, (at - 1).cast("int"))).alias("b"), numbers(F.slice(parts, (at + 1).cast("int"), F.size(parts))).alias("a"), F.get(parts, (at - 1).cast("int")).alias("code"))
        return let(sides, columns)

    def columns(s: Column) -> Column:
        b, a = s["b"], s["a"]
        nb, na = F.size(b), F.size(a)
        first, last = (lambda x, i: F.get(x, F.lit(i))), (lambda x, i: F.try_element_at(x, F.lit(-i)))
        made = lambda q, u, v: item(s["code"], s["code"], F.coalesce(q, F.lit(1.0)), u, v)
        b0, one = first(b, 0), F.lit(1.0)
        whole = (first(b, 1) == F.floor(first(b, 1))) & (first(b, 1) <= 999)
        return (
            F.when((nb == 0) & (na >= 3), made(first(a, 0), first(a, 1), last(a, 1)))
            .when((nb > 0) & (na > 0), F.when((nb >= 3) & (na == 1), made(first(a, 0), last(b, 1), b0)).when(nb >= 2, made(first(b, 1), first(a, 0), b0)).otherwise(made(first(a, 0), b0, b0)))
            .when(nb >= 4, made(last(b, 1), last(b, 2), b0))
            .when(nb == 3, F.when((b0 == first(b, 1)) & (b0 == first(b, 2)), made(one, last(b, 1), b0)).when(whole, made(first(b, 1), first(b, 2), b0)).otherwise(made(one, last(b, 1), b0)))
            .when(nb == 2, made(first(b, 1), b0, b0))
        )

    return F.when(has(text, r"(?<!\S)\d{3,}(?!\S)", C), let(F.split(text, C + r"\s+"), of))


def amount_row(text: Column) -> Column:
    """struct(has_unit, quantity, unit_price, amount) from a line of prices without words; else null."""
    words = has(F.regexp_replace(text, rf"{I}(?<=\d)\s*{UNITS}\b|\b{UNITS}\b", ""), "[A-Z]{2,}")
    unit = group(text, rf"\b(\d+(?:[.,]\d+)?)\s*{UNITS}\b")

    def of(p: Column) -> Column:
        first, last = F.get(p, F.lit(0)), F.try_element_at(p, F.lit(-1))
        second = F.get(p, F.lit(1))
        amount = F.when((F.size(p) >= 3) & (last == 0) & (second != 0), second).otherwise(last)
        return F.when(F.size(p) > 0, F.struct(unit.isNotNull().alias("has_unit"), parse_price(unit).alias("quantity"), first.alias("unit_price"), amount.alias("amount")))

    return F.when(~words, let(receipt_amounts(text), of))


def plain_row(text: Column) -> Column:
    """An item from any other line with an amount and a description of three characters or more."""

    p = r"^(.+?)\s+(\d+(?:[.,]\d+)?)\s+(?:[$€£¥]\s*)?(?:[A-Z]{3}\s*)?-?\d"

    def of(tokens: Column) -> Column:
        values = F.filter(F.transform(tokens, parse_amount), lambda x: x.isNotNull())
        bare = is_all(text, r"[\d.,\s$€£¥A-Z-]+", C) & ~has(text, "[A-Z]{2,}", C)
        return F.when((F.size(tokens) > 0) & ~bare, let(F.struct(tokens.alias("tokens"), values.alias("values"), group(text, p, 1, C).alias("named")), described))

    def described(s: Column) -> Column:
        tokens, named = s["tokens"], s["named"]
        cut = strip(F.regexp_replace(text, F.concat(F.lit("\\Q"), F.try_element_at(tokens, F.lit(-1)), F.lit("\\E\\s*$")), F.lit("")), " -|\t")
        made = lambda d: item(None, d, F.when(named.isNotNull(), parse_amount(group(text, p, 2, C))), F.try_element_at(s["values"], F.lit(-2)), F.try_element_at(s["values"], F.lit(-1)))
        return F.when(F.size(s["values"]) > 0, let(F.when(named.isNotNull(), strip(named)).otherwise(cut), lambda d: F.when(F.length(d) >= 3, made(d))))

    return let(amount_tokens(text), of)


def closed(items: Column, pending: Column, kind: str) -> Column:
    """Items with the pending one, if it has a description of three characters and an amount."""
    description = strip(F.coalesce(F.nullif(pending["description"], F.lit("")), pending["item_code"], F.lit("")))
    good = pending.isNotNull() & (F.length(description) >= 3) & pending["amount"].isNotNull()
    return F.when(good, F.concat(items, F.array(pending.withField("description", description).cast(kind)))).otherwise(items)


def table_lines(lines: Column) -> Column:
    """The lines of a document's table: after its first head, up to a line of totals, without heads and lines that are no items."""

    def after_head(rows: Column) -> Column:
        head = F.array_position(F.transform(rows, lambda r: r["head"]), True).cast("int")
        return let(head, lambda h: F.when(h > 0, let(F.filter(F.slice(rows, h + 1, F.size(rows)), lambda r: ~r["head"]), up_to_stop)).otherwise(F.array().cast("array<string>")))

    def up_to_stop(rest: Column) -> Column:
        stop = F.array_position(F.transform(rest, lambda r: has(r["text"], STOP)), True).cast("int")
        kept = let(stop, lambda s: F.when(s > 0, F.slice(rest, F.lit(1), s - 1)).otherwise(rest))
        return F.filter(F.transform(kept, lambda r: r["text"]), lambda x: ~has(x, NO_ITEM))

    full = F.filter(F.transform(lines, lambda x: strip(x)), lambda x: x != "")
    return let(F.transform(full, lambda x: F.struct(x.alias("text"), is_head(x).alias("head"))), after_head)


def line_items(lines: Column) -> Column:
    """Items (at most MOST_ITEMS) of a document's lines: ``array<ITEM>``.

    A table begins at its head and ends at a line of totals. A line with a code begins an item; lines after it add to its description until one of prices closes it.
    Each reading of a line is made only where the ones before it don't decide: prices matter only after a line with a code.
    """
    state = f"struct<pending:{ITEM},items:array<{ITEM}>>"
    none = F.lit(None).cast(ITEM)

    def coded(x: Column) -> Column:
        return F.coalesce(description_and_code(x), code_row(x))

    def read(rows: Column) -> Column:
        first = F.array_position(F.transform(rows, lambda r: r["item"].isNotNull()), True)

        def row(r: Column, i: Column) -> Column:
            several = F.size(F.regexp_extract_all(r["text"], F.lit(C + r"\b\d{3,}\b"), F.lit(0))) > 1
            open_ = r["item"].isNull() & ~several
            return F.struct(r["text"].alias("text"), r["item"].alias("item"), open_.alias("open"), F.when(open_ & (first > 0) & (i >= first), amount_row(r["text"])).alias("prices"), F.when(open_, plain_row(r["text"])).alias("plain"))

        return F.transform(rows, row)

    def made(pending: Column, items: Column) -> Column:
        return F.struct(pending.alias("pending"), items.alias("items")).cast(state)

    def step(s: Column, r: Column) -> Column:
        items, pending = s["items"], s["pending"]
        priced = item(pending["item_code"], pending["description"], F.when(r["prices"]["has_unit"], r["prices"]["quantity"]).otherwise(F.coalesce(pending["quantity"], F.lit(1.0))), r["prices"]["unit_price"], r["prices"]["amount"])
        longer = F.when(pending["description"] == pending["item_code"], r["text"]).otherwise(strip(F.concat_ws(" ", pending["description"], r["text"])))
        return (
            F.when(r["item"].isNotNull(), made(r["item"], closed(items, pending, ITEM)))
            .when(~r["open"], s.cast(state))
            .when(pending.isNotNull() & r["prices"].isNotNull(), made(none, closed(items, priced, ITEM)))
            .when(pending.isNotNull(), made(pending.withField("description", longer).cast(ITEM), items))
            .when(r["plain"].isNotNull(), made(pending, F.concat(items, F.array(r["plain"].cast(ITEM)))))
            .otherwise(s.cast(state))
        )

    rows = F.transform(table_lines(lines), lambda x: F.struct(x.alias("text"), coded(x).alias("item")))
    start = made(none, F.array().cast(f"array<{ITEM}>"))
    return F.slice(F.aggregate(let(rows, read), start, step, lambda s: closed(s["items"], s["pending"], ITEM)), 1, MOST_ITEMS)


def receipt_items(lines: Column, fixed_amounts: bool = False) -> Column:
    """Items of a receipt's lines (struct with ``text``, ``line_id``, ``confidence``), with the ids of the lines that each came from: ``array<RECEIPT_ITEM>``.

    A row of two amounts or more without a code is an item of its own, before the pending one, which stays open. AMOUNT reads a run of four digits or more as
    several amounts, so a long part number makes such a row; with ``fixed_amounts`` a run of digits is one amount.
    """
    pattern = WHOLE_AMOUNT if fixed_amounts else AMOUNT
    full = f"struct<item:{RECEIPT_ITEM},sum:double,n:int>"
    state = f"struct<inside:boolean,done:boolean,pending:{full},items:array<{RECEIPT_ITEM}>>"
    none = F.lit(None).cast(full)

    def row(line: Column) -> Column:
        x = strip(F.coalesce(line["text"], F.lit("")))
        parts = F.split(x, C + r"\s+")
        return let(F.struct(x.alias("text"), parts.alias("parts")), lambda s: read(line, s["text"], s["parts"]))

    def read(line: Column, x: Column, parts: Column) -> Column:
        numbers = F.filter(F.transform(F.slice(parts, 2, F.size(parts)), parse_amount), lambda v: v.isNotNull())
        coded = (F.size(parts) >= 4) & is_all(F.get(parts, F.lit(0)), r"\d{3,}", C)
        # without a digit there is no amount to take from the end
        rest = strip(F.when(has(x, r"\d", C), F.regexp_replace(x, rf"{C}{pattern}\s*$", "")).otherwise(x), " -|\t")
        return F.struct(x.alias("text"), F.nullif(line["line_id"], F.lit("")).alias("id"), F.coalesce(line["confidence"].cast("double"), F.lit(0.0)).alias("conf"), F.get(parts, F.lit(0)).alias("code"), F.when(coded, numbers).alias("numbers"), amounts_in(x, pattern).alias("amounts"), rest.alias("rest"))

    def made(code: Column, description: Column, qty: Column, unit: Column, discount: Column, amount: Column, conf: Column, ids: Column) -> Column:
        return F.struct(code, description, qty, unit, discount, amount, conf, ids).cast(RECEIPT_ITEM)

    def now(inside: Column, done: Column, pending: Column, items: Column) -> Column:
        return F.struct(inside.alias("inside"), done.alias("done"), pending.alias("pending"), items.alias("items")).cast(state)

    def finished(s: Column) -> Column:
        p = s["pending"]
        good = p.isNotNull() & (F.coalesce(p["item"]["description"], F.lit("")) != "")
        return F.when(good, F.concat(s["items"], F.array(p["item"].withField("confidence", F.round(p["sum"] / p["n"], 2)).cast(RECEIPT_ITEM)))).otherwise(s["items"])

    def step(s: Column, r: Column) -> Column:
        yes, no, null, keep = F.lit(True), F.lit(False), F.lit(None), s.cast(state)
        ids = F.when(r["id"].isNull(), F.array().cast("array<string>")).otherwise(F.array(r["id"]))
        n, p, amounts = r["numbers"], s["pending"], r["amounts"]
        coded = made(r["code"], r["code"], F.get(n, F.lit(0)), F.get(n, F.lit(1)), F.when(F.size(n) >= 4, 0.0), F.try_element_at(n, F.lit(-1)), F.lit(0.0), ids)
        longer = F.when(p["item"]["description"] != p["item"]["item_code"], strip(F.concat_ws(" ", p["item"]["description"], r["text"]))).otherwise(r["text"])
        added = F.when(F.array_contains(p["item"]["source_line_ids"], F.coalesce(r["id"], F.lit(""))), p["item"]["source_line_ids"]).otherwise(F.concat(p["item"]["source_line_ids"], F.array(F.coalesce(r["id"], F.lit("")))))
        grown = F.struct(p["item"].withField("description", longer).withField("source_line_ids", added), p["sum"] + r["conf"], p["n"] + 1).cast(full)
        alone = made(null, r["rest"], null, F.try_element_at(amounts, F.lit(-2)), null, F.try_element_at(amounts, F.lit(-1)), F.round(r["conf"], 2), ids)
        return (
            F.when(s["done"] | (r["text"] == ""), keep)
            .when(has(r["text"], RECEIPT_HEAD), now(yes, no, p, s["items"]))
            .when(s["inside"] & has(r["text"], RECEIPT_STOP), now(yes, yes, none, finished(s)))
            .when(~s["inside"], keep)
            .when(n.isNotNull() & (F.size(n) >= 3), now(yes, no, F.struct(coded, r["conf"], F.lit(1)).cast(full), finished(s)))
            .when(p.isNotNull() & (F.size(amounts) < 2), now(yes, no, grown, s["items"]))
            .when((F.size(amounts) > 0) & (r["rest"] != ""), now(yes, no, p, F.concat(s["items"], F.array(alone))))
            .otherwise(keep)
        )

    start = now(F.lit(False), F.lit(False), none, F.array().cast(f"array<{RECEIPT_ITEM}>"))
    return F.slice(F.aggregate(F.transform(lines, row), start, step, finished), 1, MOST_ITEMS)
