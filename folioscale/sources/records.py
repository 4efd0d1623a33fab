"""Records of documents as tables that one document can be read from: a folder for each batch, in it a folder for each bucket of ids, sorted by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def bucket_of(doc_id: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(doc_id.cast("string")), F.lit(buckets)).cast("int")


def write_records(d: DataFrame, path: str, batch: int = 0, buckets: int = BUCKETS) -> None:
    """Write records (with ``doc_id``) as ``path/batch=.../bucket=...``. Writing a batch again replaces it, and no other."""
    d = d.withColumn("bucket", bucket_of(F.col("doc_id"), buckets))
    d.repartition("bucket").sortWithinPartitions("bucket", "doc_id").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/batch={batch}")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all batches; without any, an empty table of ids."""
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return spark.createDataFrame([], "doc_id string, batch int, bucket int")


def record_of(spark: SparkSession, path: str, doc_id: str, buckets: int = BUCKETS) -> DataFrame:
    """The records of one document. Only its bucket is listed in the plan, and within it only row groups whose range of ids holds it are read."""
    return read_records(spark, path).where((F.col("bucket") == bucket_of(F.lit(doc_id), buckets)) & (F.col("doc_id") == doc_id))


def invoice_of(spark: SparkSession, path: str, doc_id: str, buckets: int = BUCKETS) -> DataFrame:
    """The invoice of one document, from its own record or, where there is none, from the whole result."""
    own = record_of(spark, f"{path}/invoice", doc_id, buckets).drop("batch", "bucket")
    whole = record_of(spark, f"{path}/result", doc_id, buckets)
    if "invoice" not in whole.columns:
        return own
    other = whole.select("doc_id", "invoice.*")
    if own.columns == ["doc_id"]:
        return other
    return own.unionByName(other.join(own.select("doc_id"), "doc_id", "left_anti"))
