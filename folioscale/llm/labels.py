"""Bounded samples of labelled documents, and the split that keeps some documents out of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(key: Column, folds: int) -> Column:
    """crc32 of an id's text modulo ``folds``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows_per_class: int, id_col: str, text_col: str, label_id: str, folds: int = 5, held_out: int = 0) -> DataFrame:
    """``key``, ``text`` and ``label`` (0 or 1) of at most ``rows_per_class`` label rows of each class, the first by a hash of their id.

    Held-out ids (crc32 of the id's text modulo ``folds`` is ``held_out``), null ids and labels other than 0 and 1 are left out. Texts of any length count.
    The chosen ids are broadcast: at most 2 * rows_per_class. Of rows of ``docs`` that share a chosen id, the text with the least hash is taken, so there
    are no more rows than chosen ids.
    """
    usable = labels.select(F.col(label_id).alias("key"), F.col(label).cast("int").alias("label")).where(F.col("key").isNotNull() & F.col("label").isin(0, 1) & (remainder(F.col("key"), folds) != held_out))
    chosen = None
    for k in (0, 1):
        part = usable.where(F.col("label") == k).distinct().orderBy(F.xxhash64("key"), "key").limit(rows_per_class)
        chosen = part if chosen is None else chosen.union(part)
    texts = docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    joined = texts.join(F.broadcast(chosen), "key").groupBy("key", "label").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("first"))
    return joined.select("key", F.col("first.text").alias("text"), "label")
