"""Documents as they arrive: a folder of files is read once each, and what is found in them is written batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioscale.operators.invoice import invoices
from folioscale.plans.documents import Engine, document_records, records_of
from folioscale.plans.session import ship, written
from folioscale.plans.settings import Settings
from folioscale.sources.files import BINARY_FILE, Decoder, decoded, named_files
from folioscale.sources.records import BUCKETS, read_records, write_records

DOCUMENT = "doc_id string, text string"


def arriving(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(DOCUMENT).option("maxFilesPerTrigger", files_per_batch).json(path)


def process(spark: SparkSession, landing: str, out: str, checkpoint: str) -> StreamingQuery:
    """Extract all documents that have arrived and stop. A batch that is run again writes the same folder again, so each file counts once."""

    def write(batch: DataFrame, number: int) -> None:
        invoices(batch.where(F.length("text") > 0)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return arriving(spark, landing).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arriving_files(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Uploaded files of any kind, ``path/doc_id/name``, as a stream."""
    return spark.readStream.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(path)


def process_files(files: DataFrame, out: str, number: int, make_decoder: Decoder, make_engine: Engine, threshold: float = 0.9, buckets: int = BUCKETS) -> None:
    """All of one batch of files: pages, recognition in two stages, records of each kind under ``out``, and what failed under ``out/failed`` (``doc_id, page, stage, error``).

    A document counts with the first file that arrives of it; of those of one batch, with the first by name. Documents of earlier batches are left out. Every kind is written as
    ``batch=number``, the whole results last: a batch that was cut off and runs again replaces what it had written.
    """
    spark = ship(files.sparkSession)
    done = read_records(spark, f"{out}/result").where(F.col("batch") < number).select("doc_id")
    fresh = named_files(files).join(done, "doc_id", "left_anti")
    pages = written(decoded(fresh, make_decoder), "pages")
    good = pages.where("error IS NULL")
    found, failed = document_records(good.select("doc_id", "page", "text"), good.where("pixels IS NOT NULL").select("doc_id", "page", "height", "width", "pixels"), make_engine, threshold)
    broken = pages.where("error IS NOT NULL").select("doc_id", "page", F.lit("decode").alias("stage"), "error")
    write_records(broken.unionByName(failed.withColumnRenamed("mode", "stage")), f"{out}/failed", number, buckets)
    for kind, records in records_of(found).items():
        write_records(records, f"{out}/{kind}", number, buckets)


def run_documents(spark: SparkSession, landing: str, out: str, checkpoint: str, make_decoder: Decoder, make_engine: Engine, settings: Settings | None = None) -> StreamingQuery:
    """Turn all files that have arrived into records and stop; run again, it goes on where it ended, or was cut off. Settings come from the session unless they are given."""
    s = settings or Settings.of(spark)
    stream = arriving_files(spark, landing, s.files_per_batch)
    return stream.writeStream.foreachBatch(lambda batch, number: process_files(batch, out, number, make_decoder, make_engine, s.retry_below, s.buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
