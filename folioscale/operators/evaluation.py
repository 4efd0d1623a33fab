"""Accuracy of extracted invoices against ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscale.functions.text import strip_all


def same_text(a: Column, b: Column) -> Column:
    return F.lower(strip_all(a.cast("string"))) == F.lower(strip_all(b.cast("string")))


def same_amount(expected: Column, actual: Column) -> Column:
    """Both missing, or numbers within 0.02."""
    none = F.coalesce(expected, F.lit("")) == ""
    return F.coalesce((none & actual.isNull()) | (F.abs(expected.try_cast("double") - actual) <= 0.02), F.lit(False))


def compare(truth: DataFrame, *found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Matches of each truth row (all strings) with the first of the tables ``found`` that has its document, field by field.

    A document that none has counts as one without fields. Keys are unique in each table.
    """
    fields = ("invoice_number", "invoice_date", "total_amount", "vendor_name", "needs_review", "confidence")
    d = truth
    for i, f in enumerate(found):
        d = d.join(f.select(key, F.struct(*fields).alias(f"__f{i}")), key, "left")
    d = d.withColumn("__f", F.coalesce(*(F.col(f"__f{i}") for i in range(len(found)))))
    text = lambda n: same_text(F.col(n), F.col("__f")[n]).alias(f"{n}_match")
    return d.select(key, text("invoice_number"), text("invoice_date"), same_amount(F.col("total_amount"), F.col("__f")["total_amount"]).alias("total_amount_match"), text("vendor_name"), F.coalesce(F.col("__f")["needs_review"], F.lit(False)).alias("needs_review"), F.coalesce(F.col("__f")["confidence"], F.lit(0.0)).alias("confidence"))


def summarize(rows: DataFrame) -> DataFrame:
    """One row: four accuracies (4 decimals), the percentage for review (2), the mean confidence (4) and the number of documents; zeros for none."""
    share = lambda n: F.coalesce(F.round(F.avg(F.col(f"{n}_match").cast("int")), 4), F.lit(0.0)).alias(f"{n}_accuracy")
    return rows.agg(
        *(share(n) for n in ("invoice_number", "invoice_date", "total_amount", "vendor_name")),
        F.coalesce(F.round(F.avg(F.col("needs_review").cast("int")) * 100, 2), F.lit(0.0)).alias("needs_review_percentage"),
        F.coalesce(F.round(F.avg("confidence"), 4), F.lit(0.0)).alias("average_confidence"),
        F.count("*").alias("document_count"),
    )


def checked(summary: DataFrame, truth: DataFrame) -> DataFrame:
    """The summary, unless it counts no documents although there are rows of ground truth: then their ids are missing, and that is an error."""
    if summary.first()["document_count"] == 0 and not truth.isEmpty():
        raise ValueError("no document was evaluated although there is ground truth: check its doc_id column")
    return summary
