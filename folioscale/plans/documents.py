"""The whole way of a document: pages with a text layer or an image become lines, lines become an invoice and a receipt with their checks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscale.functions.text import strip_all
from folioscale.operators import images, layout, lines, receipt
from folioscale.plans.session import written
from folioscale.sources.files import manifest, write_json

Engine = Callable[[], Callable[[np.ndarray], list[tuple[str, float, list[list[float]]]]]]
RETRY_MODES = ("receipt", "sorie", "strong")
LINES = "array<struct<text:string,text_clean:string,line_id:string,page:int,confidence:double,bbox:array<array<double>>>>"


def recognise_passes(pages: DataFrame, make_engine: Engine, threshold: float = 0.9) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Recognise page images (``doc_id, page, height, width, pixels``) in two stages.

    All pages are read in the mode ``basic``; only those that come out badly are prepared and read again in the others, and one pass is kept of each page. Returns the
    kept lines (``doc_id, page, line_no, line_id, text, confidence, bbox``), the passes (``doc_id, page, selected_mode, retry_used``) and the readings that failed
    (``doc_id, page, mode, error``). A page without lines, failed or not, has a confidence of 0, so it is read again.
    """
    key = ["doc_id", "page"]

    def read(some: DataFrame, modes: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
        prepared = images.prepare_pages(some, key, modes)
        found = written(images.recognised(prepared, [*key, "mode"], make_engine), "recognised")
        every = some.where(F.length("pixels") > 0).select(*key, F.explode(F.array(*(F.lit(m) for m in modes))).alias("mode"))
        scores = every.join(lines.page_scores(found.where("error IS NULL"), [*key, "mode"]), [*key, "mode"], "left")
        return found, scores.na.fill(0)

    first, scores = read(pages, ("basic",))
    weak = scores.where(lines.should_retry(F.col("confidence"), F.col("suspicious_lines"), threshold)).select(*key)
    # a page is minutes of work, so a few megabytes of them still go to as many tasks as a shuffle has
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    again, more = read(pages.join(weak, key, "left_semi").repartition(parts, *key), RETRY_MODES)
    chosen = written(lines.choose_pass(scores.unionByName(more), key), "passes")
    both = first.unionByName(again)
    kept = both.where("error IS NULL").drop("error").join(chosen.select(*key, F.col("selected_mode").alias("mode")), [*key, "mode"], "left_semi").drop("mode")
    return kept.withColumn("line_id", F.format_string("p%04d_l%04d", "page", "line_no")), chosen, both.where("error IS NOT NULL").select(*key, "mode", "error")


def recognise_with_retry(pages: DataFrame, make_engine: Engine, threshold: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """The kept lines and the passes of ``recognise_passes``."""
    return recognise_passes(pages, make_engine, threshold)[:2]


def read_pages(pages: DataFrame, page_images: DataFrame, make_engine: Engine, threshold: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """``doc_id, page, source, lines, text, mode`` of all pages (``doc_id, page, text``): a good text layer counts as it is, other pages are recognised and cleaned. Second, the readings that failed."""
    listed = manifest(pages)
    native = listed.where("source = 'native'").withColumn("text", strip_all(F.col("text")))
    own = lines.explode_lines(native.withColumn("key", F.struct("doc_id", "page")), "key", "text")
    own = own.select("key.*", "line_no", F.format_string("p%04d_l%04d", F.col("key.page"), "line_no").alias("line_id"), "text", "confidence").withColumn("bbox", F.lit(None).cast("array<array<double>>"))
    scans = listed.where("source = 'ocr'").select("doc_id", "page", "source")
    found, passes, failed = recognise_passes(page_images.join(scans, ["doc_id", "page"], "left_semi"), make_engine, threshold)

    def gathered(d: DataFrame) -> DataFrame:
        rows = F.array_sort(F.collect_list(F.struct("line_no", "line_id", "text", "confidence", "bbox")))
        return d.groupBy("doc_id", "page").agg(F.transform(rows, lambda x: F.struct(x["line_id"], x["text"], x["confidence"], x["bbox"])).alias("lines"))

    clean = lines.postprocess(gathered(found)).withColumn("text", lines.paragraphs(F.col("lines"), "text_clean"))
    kept = lambda x, page, text: F.struct(x["text"], text.alias("text_clean"), x["line_id"], page.cast("int").alias("page"), x["confidence"], x["bbox"])
    modes = passes.select("doc_id", "page", F.col("selected_mode").alias("mode"))
    read = scans.join(clean, ["doc_id", "page"], "left").join(modes, ["doc_id", "page"], "left").select("doc_id", "page", "source", F.coalesce(F.transform("lines", lambda x: kept(x, F.col("page"), x["text_clean"])).cast(LINES), F.array().cast(LINES)).alias("lines"), F.coalesce("text", F.lit("")).alias("text"), "mode")
    typed = native.select("doc_id", "page", "source", "text").join(gathered(own), ["doc_id", "page"]).select("doc_id", "page", "source", F.transform("lines", lambda x: kept(x, F.col("page"), x["text"])).cast(LINES).alias("lines"), "text", F.lit(None).cast("string").alias("mode"))
    return read.unionByName(typed), failed


def page_lines(pages: DataFrame, page_images: DataFrame, make_engine: Engine, threshold: float = 0.9) -> DataFrame:
    """The pages of ``read_pages``."""
    return read_pages(pages, page_images, make_engine, threshold)[0]


def document_records(pages: DataFrame, page_images: DataFrame, make_engine: Engine, threshold: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """Records, one row for each document, and the readings that failed (``doc_id, page, mode, error``).

    A record has ``doc_id``, ``pages`` (page, source, text, mode), ``full_text``, ``invoice`` and ``receipt`` (structs of all fields, checked), ``layout`` (the lines of each section) and
    ``quality``. Records are written once, so what is made of them reads them only. Invoices and receipts are columns of a document's own row; only the quality of its images joins it.
    """
    read, failed = read_pages(pages, page_images, make_engine, threshold)
    rows = F.array_sort(F.collect_list(F.struct("page", "source", "text", "lines", "mode")))
    d = written(read, "page-lines").groupBy("doc_id").agg(rows.alias("rows"))
    texts = F.filter(F.transform("rows", lambda r: r["text"]), lambda x: x != "")
    d = d.select("doc_id", F.transform("rows", lambda r: F.struct(r["page"], r["source"], r["text"], r["mode"])).alias("pages"), F.array_join(texts, "\n\n").alias("full_text"), F.flatten(F.transform("rows", lambda r: r["lines"])).alias("lines"))
    own = ["doc_id", "pages", "full_text", "lines"]
    struct = lambda x, kept, name: x.select(*kept, F.struct(*(c for c in x.columns if c not in kept)).alias(name))
    d = struct(layout.invoices_from_lines(d), own, "invoice")
    shop = d.withColumn("shop", F.transform("lines", lambda x: x.withField("text", F.coalesce(F.nullif(x["text_clean"], F.lit("")), x["text"]))))
    shop = shop.withColumn("layout", receipt.sections(F.col("shop")))
    kept = ["doc_id", "pages", "full_text", "invoice", "layout"]
    d = struct(receipt.validate_receipts(receipt.receipts(shop, lines_col="shop", keep=tuple(kept[1:]))), kept, "receipt")
    quality = images.document_quality(images.quality_warnings(images.image_measures(page_images, ["doc_id", "page"])))
    return written(d.join(struct(quality, ["doc_id"], "quality"), "doc_id", "left"), "records"), failed


def documents(pages: DataFrame, page_images: DataFrame, make_engine: Engine, threshold: float = 0.9) -> DataFrame:
    """The records of ``document_records``."""
    return document_records(pages, page_images, make_engine, threshold)[0]


def records_of(found: DataFrame) -> dict[str, DataFrame]:
    """Each kind of record, with its ``doc_id``."""
    kinds = {"invoice": ["invoice.*"], "receipt": ["receipt.*"], "validation": ["receipt.is_valid", "receipt.warnings", "receipt.checks"], "layout": ["layout"], "quality": ["quality.*"]}
    return {**{k: found.select("doc_id", *columns) for k, columns in kinds.items()}, "result": found}


def write_documents(found: DataFrame, path: str) -> None:
    """The records of documents as JSON lines: whole results, invoices, receipts and their reports each in a folder."""
    for kind, d in records_of(found).items():
        write_json(d, f"{path}/{kind}")
