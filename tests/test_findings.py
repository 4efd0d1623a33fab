"""Findings of reviews, each with a case that failed before."""

import os

import pytest
from pyspark.sql import functions as F

from folioscale.functions import text as t
from folioscale.operators import lines
from folioscale.plans import defects, synth

DATA = "/root/testdata/sf0.001"


def test_page_scores_do_not_depend_on_how_lines_are_dealt(spark):
    """A confidence of 1e16 that is taken back at the end: the sum shows the order in which the others were added."""
    rows = [(1, n, "some text", c) for n, c in enumerate([1e16, *[0.7] * 10, -1e16], 1)]
    expected = 0.0
    for r in rows:
        expected += r[3]
    d = spark.createDataFrame(rows, "doc_id long, line_no int, text string, confidence double")
    for dealt in (d.coalesce(1), d.repartition(7), d.orderBy(F.desc("line_no"))):
        [found] = lines.page_scores(dealt, ["doc_id"]).collect()
        assert found.confidence == expected / 12


def test_short_ways_agree_with_the_long_ones(spark):
    amounts = ["12.34", "1,234.56", "1,234.5", "1,234", "1234,567.10", "1.250", "12,34", "-5.00", "--5", "5-", "USD 7.00", "RM", "", " 8 ", "0", "123456789012345678", "12.", ".5", "1,2.3", "\u0665", None]
    d = spark.createDataFrame([(x,) for x in amounts], "v string")
    for r in d.select("v", t.parse_amount(F.col("v")).alias("a"), t.any_amount(F.col("v")).alias("b")).collect():
        assert r.a == r.b, r.v
    texts = ["plain words", "a , b", "a,. b", "a., b", "a.. b", "of. The end", "x,. y", "the. end", "a. B", "no.", None, ""]
    d = spark.createDataFrame([(x,) for x in texts], "v string")
    for r in d.select("v", t.normalize_punctuation(F.col("v")).alias("a"), t.any_punctuation(F.col("v")).alias("b")).collect():
        assert r.a == r.b, r.v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("made", [synth.shop_texts, synth.invoice_texts, synth.order_lines, synth.receipt_pages, defects.code_lists, defects.faulty_receipts, defects.noisy_pages])
def test_documents_are_dealt_to_all_cores(spark, made):
    """The tables are of a few megabytes, but reading a document takes milliseconds."""
    assert made(spark, DATA).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_links_do_not_depend_on_the_sample_that_orders_tokens(spark, monkeypatch):
    from folioscale.llm import jaccard_join
    from folioscale.plans.session import ship, table

    docs = table(ship(spark), DATA, "documents").select("doc_id", "text")
    found = []
    for sample, kept in ((20_000, 200_000), (20_000, 50), (0, 1)):
        monkeypatch.setattr(jaccard_join, "ORDERING_SAMPLE", sample)
        monkeypatch.setattr(jaccard_join, "FREQUENT_KEPT", kept)
        d = jaccard_join.similar_documents(docs, size=5, num=80, den=100)
        found.append(sorted(map(tuple, d.select("doc_id", "component_id", "n_links").collect())))
    assert any(r[2] > 0 for r in found[0]) and found[0] == found[1] == found[2]
