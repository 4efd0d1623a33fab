"""Files in and out: uploads, OCR pages and ground truth in; results, receipts and summaries out."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscale.functions.text import C, strip_all, use_native_text
from folioscale.operators.images import Restarted
from folioscale.plans.session import ship, written

OCR_PAGE = "lines array<struct<text:string,text_clean:string,confidence:double,bbox:array<array<double>>,page:int,line_id:string>>"
TRUTH = "doc_id string, vendor_name string, invoice_number string, invoice_date string, total_amount string"


#: The columns of a scan of whole files.
BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def named_files(d: DataFrame) -> DataFrame:
    """Files of a scan of whole files that aren't empty: ``doc_id`` (their folder's name), ``name``, ``content``. Of several in a folder the first by name counts."""
    parts = F.split("path", "/")
    d = d.where("length > 0").select(F.try_element_at(parts, F.lit(-2)).alias("doc_id"), F.try_element_at(parts, F.lit(-1)).alias("name"), "path", "content")
    first = d.groupBy("doc_id").agg(F.min("path").alias("path"))
    return d.join(first, ["doc_id", "path"], "left_semi").drop("path")


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """Uploaded files under a folder, as ``named_files`` has them."""
    return named_files(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def artifacts(spark: SparkSession, path: str) -> DataFrame:
    """Page files ``.../doc_id/kind/page_0001.*``: ``doc_id, page, kind, length``. Files are listed, and their content isn't read."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "page_*").load(path).select("path", "length")
    part = lambda k: F.regexp_extract("path", r"([^/]+)/([^/]+)/page_(\d+)\.[^/]*$", k)
    return d.select(part(1).alias("doc_id"), part(3).try_cast("int").alias("page"), part(2).alias("kind"), "length").where("page IS NOT NULL")


def safe_name(name: Column) -> Column:
    """A file name without folders or leading points, other characters than letters, digits, point, hyphen and underscore as underscores; ``upload`` if nothing is left."""
    last = F.regexp_replace(F.coalesce(name, F.lit("")), r"(?s)^.*[/\\\\]", "")
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(last, C + r"[^\w.-]", "_"), r"^\.+", ""), F.lit("")), F.lit("upload"))


def save_uploads(files: DataFrame, path: str) -> DataFrame:
    """Save files (``doc_id, name, content``) as ``path/doc_id/name``, where ``uploads`` finds them, under safe names; returns ``doc_id, name, length``.

    ``path`` is a URI that all executors reach. A file appears whole or not at all, so a task may run again. Of files of one document and name the one with the least
    SHA-256 stays; without content nothing is saved. ``doc_id`` is cleaned like a name.
    """
    ship(files.sparkSession)
    d = files.where("content IS NOT NULL").select(safe_name(F.col("doc_id").cast("string")).alias("doc_id"), safe_name(F.col("name")).alias("name"), "content", F.sha2("content", 256).alias("sha"))
    first = d.groupBy("doc_id", "name").agg(F.min("sha").alias("sha"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for doc, name, content in zip(*(batch.column(n) for n in ("doc_id", "name", "content"))):
                folder = f"{base}/{doc.as_py()}"
                fs.create_dir(folder, recursive=True)
                part = f"{base}/_{uuid.uuid4().hex}"
                with fs.open_output_stream(part) as out:
                    out.write(content.as_buffer())
                fs.move(part, f"{folder}/{name.as_py()}")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("name"), pa.array([len(x.as_buffer()) for x in batch.column("content")], pa.int64())], ["doc_id", "name", "length"])

    once = d.join(first, ["doc_id", "name", "sha"], "left_semi").select("doc_id", "name", "content")
    return written(once.mapInArrow(run, "doc_id string, name string, length long"), "saved").distinct()


Decoder = Callable[[], Callable[[str, bytes], list[tuple[str | None, np.ndarray | None]]]]


def decoded(files: DataFrame, make_decoder: Decoder) -> DataFrame:
    """Pages of files (``doc_id, name, content``): ``doc_id, page`` (from 1), ``text`` of a text layer and ``height, width, pixels`` of a grey image, null where a page has none, and ``error``.

    ``make_decoder`` is called once in each Python worker, and once more after an error; its function turns a name and bytes into pages. An image file is one page without
    text. Each page is handed on by itself, so a long file is not held twice. A file that fails twice is one row with ``error`` and no page; others don't notice.
    """
    ship(files.sparkSession)
    names = ["doc_id", "page", "text", "height", "width", "pixels", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def checked(make: Callable[[], Callable]) -> Callable:
            decode = make()
            return lambda name, content: [(text, None if grey is None else np.ascontiguousarray(grey, dtype=np.uint8).reshape(len(grey), -1)) for text, grey in decode(name, content)]

        decode = Restarted(lambda: checked(make_decoder))
        for batch in batches:
            for i in range(len(batch)):
                pages, error = decode(batch.column("name")[i].as_py(), batch.column("content")[i].as_py() or b"")
                for page, (text, grey) in enumerate([(None, None)] if error else pages, 1):
                    h, w = (None, None) if grey is None else grey.shape
                    raw = None if grey is None else grey.tobytes()
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, 1), pa.array([None if error else page], pa.int32()), pa.array([text], pa.string()), pa.array([h], pa.int32()), pa.array([w], pa.int32()), pa.array([raw], pa.binary()), pa.array([error], pa.string())], names)

    kind = files.schema["doc_id"].dataType.simpleString()
    return files.select("doc_id", "name", "content").mapInArrow(run, f"doc_id {kind}, page int, text string, height int, width int, pixels binary, error string")


def decoded_pages(files: DataFrame, make_decoder: Decoder) -> DataFrame:
    """As ``decoded``, without files that failed."""
    return decoded(files, make_decoder).where("error IS NULL").drop("error")


def with_artifact(pages: DataFrame, artifacts: DataFrame, kind: str) -> DataFrame:
    """The pages of which an artifact of this kind exists. ``artifacts`` has ``doc_id, page, kind``."""
    return pages.join(artifacts.where(F.col("kind") == kind), ["doc_id", "page"], "left_semi")


def manifest(pages: DataFrame, text_col: str = "text") -> DataFrame:
    """Pages with their ``source``, native or ocr, by the quality of their text layer, and the ``artifact`` that follows from it."""
    source = F.when(use_native_text(F.col(text_col)), "native").otherwise("ocr")
    return pages.withColumn("source", source).withColumn("artifact", F.concat(F.format_string("page_%04d", "page"), F.when(F.col("source") == "native", ".txt").otherwise(".png")))


def ocr_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with text of OCR page files ``.../doc_id/ocr/page_0001.json``: ``doc_id, page, line_no, line_id, text, confidence, bbox``."""
    d = spark.read.schema(OCR_PAGE).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "page_*.json").json(path)
    file = F.col("_metadata.file_path")
    page = F.coalesce(F.regexp_extract(file, r"page_(\d+)\.json", 1).try_cast("int"), F.lit(1))
    d = d.select(F.regexp_extract(file, r"([^/]+)/(?:ocr/)?page_\d+\.json", 1).alias("doc_id"), page.alias("file_page"), F.posexplode("lines").alias("at", "x"))
    text = strip_all(F.coalesce(F.nullif(F.col("x.text_clean"), F.lit("")), F.col("x.text")))
    number = F.col("at") + 1
    own = F.coalesce(F.nullif(F.col("x.line_id"), F.lit("")), F.format_string("p%04d_l%04d", "file_page", number))
    return d.select("doc_id", F.coalesce(F.nullif(F.col("x.page"), F.lit(0)), "file_page").alias("page"), number.alias("line_no"), own.alias("line_id"), text.alias("text"), "x.confidence", "x.bbox").where("text <> ''")


def assemble(pages: DataFrame, texts: DataFrame) -> DataFrame:
    """Documents from their manifest and the text of their pages, in page order; a page without text is empty."""
    d = pages.select("doc_id", "page", "source").join(texts.select("doc_id", "page", "text"), ["doc_id", "page"], "left").groupBy("doc_id")
    rows = F.array_sort(F.collect_list(F.struct("page", "source", F.coalesce("text", F.lit("")).alias("text"))))
    return d.agg(rows.alias("pages")).withColumn("full_text", strip_all(F.array_join(F.filter(F.transform("pages", lambda p: p["text"]), lambda x: x != ""), "\n\n")))


def pipeline_view(pages: DataFrame, artifacts: DataFrame, modes: tuple[str, ...] = ("basic", "receipt", "sorie", "strong")) -> DataFrame:
    """Of each page, which processed images and OCR results exist. ``artifacts`` has ``doc_id, page, kind`` (a mode, or ocr)."""
    there = artifacts.groupBy("doc_id", "page").agg(F.collect_set("kind").alias("kinds"))
    d = pages.join(there, ["doc_id", "page"], "left")
    has: dict[str, Column] = {f"has_{k}": F.coalesce(F.array_contains("kinds", k), F.lit(False)) for k in (*modes, "ocr")}
    return d.withColumns(has).drop("kinds")


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRUTH).option("header", "true").csv(path)


def write_json(d: DataFrame, path: str) -> None:
    """One JSON object a line, nulls included, partitioned files; existing results are replaced."""
    d.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """A one-row summary as JSON and as CSV with a head."""
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/json")
    summary.coalesce(1).write.mode("overwrite").option("header", "true").csv(f"{path}/csv")
