"""Business documents made from the order tables, so that what is read from them can be held against the tables.

Money is in whole cents until it is printed. Some documents have a known defect, by their order's key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscale.plans.session import spread, table


def cents(amount: Column) -> Column:
    return F.round(amount * 100).cast("long")


def money(cents: Column) -> Column:
    """Cents as text with two decimals and commas between thousands."""
    return F.format_number((cents / 100).cast("decimal(18,2)"), 2)


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``o_orderkey, n, part, quantity, cents``: items of orders, numbered in a total order; amounts from 1.00 to 99.99."""
    x = table(spark, sf_dir, "lineitem")
    cents = (F.round(F.col("l_extendedprice") * 100).cast("long") % 9900) + 100
    return x.select(F.col("l_orderkey").alias("o_orderkey"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate").alias("place"), F.col("l_partkey").alias("part"), F.col("l_quantity").cast("long").alias("quantity"), cents.alias("cents"))


def invoice_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One invoice text for each order: ``doc_id`` and ``text``."""
    row = F.struct("place", F.concat_ws(" ", F.lit("Widget"), F.concat(F.lit("P"), "part"), F.col("quantity").cast("string"), money(F.col("cents")), money(F.col("cents"))).alias("text"))
    items = order_items(spark, sf_dir).groupBy("o_orderkey").agg(F.sort_array(F.collect_list(row)).alias("rows"), F.sum("cents").alias("subtotal"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    d = spread(orders.join(items, "o_orderkey", "left").join(customers, "o_custkey", "left"), "o_orderkey")
    k = F.col("o_orderkey")
    subtotal = F.coalesce("subtotal", F.lit(0).cast("long"))
    tax, discount = F.floor(subtotal * 6 / 100).cast("long"), (k % 10) * 10
    total = subtotal + tax - discount + F.when(k % 13 == 4, 500).otherwise(0)
    date = F.when(k % 5 == 2, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    lines = F.array(
        F.concat(F.replace("c_name", F.lit("Customer#"), F.lit("Firm ")), F.lit(" Trading LLC")),
        F.concat((k % 90 + 10).cast("string"), F.lit(" Main Street")),
        F.concat(F.when(k % 7 == 1, "lnvoice No: INV-").otherwise("Invoice No: INV-"), k.cast("string")),
        F.concat(F.lit("Invoice Date: "), date),
        F.concat(F.lit("Bill To: Shop "), F.col("o_custkey").cast("string")),
        F.lit("Description Qty Unit Price Amount"),
    )
    tail = F.array(
        F.concat(F.lit("Subtotal: "), money(subtotal)),
        F.concat(F.lit("Tax: "), money(tax)),
        F.concat(F.lit("Discount: "), money(discount)),
        F.when(k % 11 != 3, F.concat(F.lit("Total Amount: USD "), money(total))),
        F.lit("Payment Method: card"),
        F.lit("Currency USD"),
    )
    body = F.transform("rows", lambda r: r["text"])
    all_lines = F.array_compact(F.concat(lines, F.coalesce(body, F.array().cast("array<string>")), tail))
    return d.select(k.alias("doc_id"), F.array_join(all_lines, "\n").alias("text"))


def rows_or_none(rows: str) -> Column:
    """The items of an order in their order; an order without items has an empty array."""
    kept = F.transform(rows, lambda r: F.struct(r["part"].alias("part"), r["quantity"].alias("quantity"), r["cents"].alias("cents")))
    return F.coalesce(kept, F.array().cast("array<struct<part:bigint,quantity:bigint,cents:bigint>>"))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of recognised lines for each order: ``doc_id`` and ``lines``; labels on the left, values to their right or below, and a table.

    Coordinates are whole numbers.
    """
    k = F.col("o_orderkey")

    def line(text: Column, x: int, y: Column | int, width: int = 200, height: int = 20) -> Column:
        y = F.lit(y) if isinstance(y, int) else y
        box = F.array(F.array(F.lit(x), y), F.array(F.lit(x + width), y), F.array(F.lit(x + width), y + height), F.array(F.lit(x), y + height)).cast("array<array<double>>")
        return F.struct(text.alias("text"), F.lit(None).cast("string").alias("text_clean"), F.lit(None).cast("string").alias("line_id"), F.lit(1).alias("page"), F.lit(0.95).alias("confidence"), box.alias("bbox"))

    items = order_items(spark, sf_dir).groupBy("o_orderkey").agg(F.sort_array(F.collect_list(F.struct("place", "part", "quantity", "cents"))).alias("rows"), F.sum("cents").alias("total"))
    d = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").join(items, "o_orderkey", "left"), "o_orderkey")
    d = d.withColumns({"rows": rows_or_none("rows"), "total": F.coalesce("total", F.lit(0).cast("long"))})
    cell = lambda r, i: F.array(line(F.concat(F.lit("Widget P"), r["part"].cast("string")), 40, 260 + 40 * i), line(r["quantity"].cast("string"), 300, 262 + 40 * i, 60), line(money(r["cents"]), 420, 261 + 40 * i, 100), line(money(r["cents"]), 560, 260 + 40 * i, 100))
    end = 300 + 40 * F.size("rows")
    head = F.array(
        line(F.lit("ACME Trading LLC"), 40, 20),
        line(F.lit("Invoice No"), 40, 80, 110),
        line(F.concat(F.lit("INV-"), k.cast("string")), 300, 82, 120),
        line(F.lit("Invoice Date"), 40, 120, 130),
        line(F.date_format("o_orderdate", "yyyy-MM-dd"), 42, 150, 110),
        line(F.lit("Description"), 40, 220),
        line(F.lit("Qty"), 300, 221, 60),
        line(F.lit("Unit Price"), 420, 220, 100),
        line(F.lit("Amount"), 560, 220, 100),
    )
    tail = F.array(line(F.lit("Total Amount"), 40, end, 140), line(F.concat(F.lit("USD "), money(F.col("total"))), 560, end + 1, 120))
    return d.select(k.alias("doc_id"), F.concat(head, F.flatten(F.transform("rows", cell)), tail).alias("lines"))


def receipt_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One receipt for each order: ``doc_id`` and ``lines`` of ``text, line_id, confidence, bbox``."""
    k = F.col("o_orderkey")
    items = order_items(spark, sf_dir).groupBy("o_orderkey").agg(F.sort_array(F.collect_list(F.struct("place", "part", "quantity", "cents"))).alias("rows"), F.sum("cents").alias("total"), F.sum(F.col("cents") * F.col("quantity")).alias("all"))
    zero = F.lit(0).cast("long")
    items = spread(table(spark, sf_dir, "orders").select("o_orderkey").join(items, "o_orderkey", "left"), "o_orderkey").withColumns({"rows": rows_or_none("rows"), "total": F.coalesce("total", zero), "all": F.coalesce("all", zero)})
    texts = F.flatten(F.transform("rows", lambda r: F.array(F.concat_ws(" ", (r["part"] + 100_000).cast("string"), r["quantity"].cast("string"), money(r["cents"]), F.regexp_replace(money(r["cents"] * r["quantity"]), ",", "")), F.concat(F.lit("widget P"), r["part"].cast("string")))))
    total = F.when(k % 9 == 2, F.col("all") + 100).otherwise(F.col("all"))
    whole = F.concat(F.array(F.concat(F.lit("ACME MART "), (k % 7).cast("string")), F.lit("TEL 07-5551234"), F.concat(F.lit("Doc No: CS"), k.cast("string")), F.lit("Date: 2024-05-06"), F.lit("CODE/DESC QTY PRICE AMOUNT")), texts, F.array(F.concat(F.lit("Total Sales RM "), money(total)), F.concat(F.lit("Cash "), money(total + 250)), F.lit("Change 2.50"), F.lit("Thank you")))
    line = lambda x, i: F.struct(x.alias("text"), F.concat(F.lit("l"), (i + 1).cast("string")).alias("line_id"), F.lit(0.9).alias("confidence"), F.array(F.array(F.lit(0), i * 30), F.array(F.lit(400), i * 30), F.array(F.lit(400), i * 30 + 20), F.array(F.lit(0), i * 30 + 20)).cast("array<array<double>>").alias("bbox"))
    return items.select(k.alias("doc_id"), F.transform(whole, line).alias("lines"))


def shop_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cash receipt text for each order: ``doc_id`` and ``text``, with contacts, several labels on a line, items of a code and a price line, and totals that
    aren't the one to pay. Its title and currency differ with the order's key."""
    k = F.col("o_orderkey")
    text = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))
    unit = (k % 50 + 1) * 5
    lines = F.array(
        text("KEDAI BUKU ", k % 7, " SDN BHD"),
        text("(JM", k % 9000 + 1000, "-H)"),
        F.when(k % 2 == 0, text("NO ", k % 90 + 1, " JALAN BESAR")),
        text("TEL: 07-", k % 9000 + 1000, " FAX: 07-", k % 8000 + 1000),
        text("Mail: shop", k, "@mail.example.com"),
        F.when(k % 3 == 0, "CASH SALES").when(k % 3 == 1, "TAX INVOICE"),
        text("Doc No: CS", k),
        text("Date: ", F.date_format("o_orderdate", "dd/MM/yyyy"), " Time: 09:4", k % 10, ":00"),
        text("Cashier: USER", k % 5, " Salesperson: S", k % 4, " Ref: R", k),
        F.lit("Item Qty Price Amount"),
        text("PEN SET ", k % 1000 + 10_000_000),
        F.when(k % 5 == 0, "BLUE INK"),
        text(k % 4 + 1, " PCS ", money(unit * 100), " ", money(unit * 100 * (k % 4 + 1))),
        text("Total Qty: ", k % 4 + 1),
        text("Subtotal ", money(unit * 100 * (k % 4 + 1))),
        F.when(k % 2 == 1, text("Total ", money(unit * 100))),
        text("Grand Total ", money(unit * 100 * (k % 4 + 1) + 5)),
        text("Cash ", money(unit * 100 * (k % 4 + 1) + 2005)),
        F.when(k % 4 == 1, "Prices in EUR").when(k % 4 == 2, "All in $").when(k % 4 == 3, "RM"),
        F.when(k % 6 == 0, "Paid by bank transfer."),
    )
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey")
    return orders.select(k.alias("doc_id"), F.array_join(F.array_compact(lines), "\n").alias("text"))
