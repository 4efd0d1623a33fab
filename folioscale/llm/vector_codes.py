"""Product codes of vectors: codebooks by rounds of nearest entries and means, all in whole numbers.

Vectors are kept as blocks: a block holds some thousand vectors as one matrix of whole numbers, a row for each dimension. A round goes over an RDD of these
blocks. Distances to all entries of a codebook accumulate one dimension after the other; ``np.add.at`` gathers int64 sums and counts of each entry, and
``treeAggregate`` merges these tensors through a reduction tree. Whole numbers make a result that depends neither on the order nor on the cut of the blocks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscale.plans.session import written

#: Vectors of a block, less where they are long: a block has at most BLOCK_BYTES, or one vector.
BLOCK_ROWS, BLOCK_BYTES = 4096, 4 << 20
#: Vectors whose distances are held at once: they and one dimension stay in the cache.
AT_ONCE = 512
#: Labels whose sums are broadcast; beyond it each sum is dealt SALTS times, so that rows of one label spread over as many tasks.
BROADCAST_LABELS, SALTS = 100_000, 64
#: Tensors that one step of the reduction tree merges, about.
FAN_IN = 16


def usable(vector: Column) -> Column:
    """Not null, and without null or non-finite components."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def largest_component(dimensions: int) -> int:
    """Whole components beyond this count as this much: squared distances of a vector then stay below 2^62."""
    return math.isqrt((1 << 62) // max(1, dimensions)) // 2


def to_blocks(kept: DataFrame, dimensions: int, scale: int) -> DataFrame:
    """Blocks of ``ids``, ``labels`` and ``data``: little-endian int64, one dimension after the other. ``dimensions`` is a multiple of the parts."""
    fields = [T.StructField("ids", T.ArrayType(kept.schema["id"].dataType)), T.StructField("labels", T.ArrayType(kept.schema["label"].dataType)), T.StructField("data", T.BinaryType())]
    rows, limit = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(1, dimensions)))), largest_component(dimensions)

    def matrix(vectors: pa.Array) -> np.ndarray:
        lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
        out = np.zeros((dimensions, len(vectors)), dtype=np.int64)
        flat = np.clip(np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False)), -limit, limit).astype(np.int64)
        row = np.repeat(np.arange(len(vectors)), lengths)
        out[np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths), row] = flat
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0

        def blocks() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(waiting).combine_chunks()
            for at in range(0, n, rows):
                part = whole.slice(at, rows).combine_chunks()
                ids, labels, vectors = (c.chunk(0) for c in part.columns)
                ends = pa.array([0, len(ids)], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, ids), pa.ListArray.from_arrays(ends, labels), pa.array([matrix(vectors).astype("<i8").tobytes()], pa.binary())], ["ids", "labels", "data"])

        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
                n += batch.num_rows
            if n >= rows:
                yield from blocks()
                waiting, n = [], 0
        if n:
            yield from blocks()

    return kept.mapInArrow(run, T.StructType(fields))


def nearest(block: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each part and vector the index of the nearest entry, the lowest of equal ones, and its squared distance.

    ``block`` is (parts, dimensions of a part, vectors), ``books`` (parts, dimensions of a part, entries). Where all distances fit, 32 bits hold them.
    """
    parts, width, n = block.shape
    greatest = int(max(np.abs(block).max(initial=0), np.abs(books).max(initial=0)))
    kind = np.int32 if 4 * greatest * greatest * max(1, width) < 1 << 31 else np.int64
    block, books = block.astype(kind), books.astype(kind)
    index, error = np.zeros((parts, n), dtype=np.int64), np.zeros((parts, n), dtype=np.int64)
    for part in range(parts):
        for at in range(0, n, AT_ONCE):
            some = block[part, :, at : at + AT_ONCE]
            distance = np.zeros((some.shape[1], books.shape[2]), dtype=kind)
            for dimension in range(width):
                apart = some[dimension][:, None] - books[part, dimension][None, :]
                apart *= apart
                distance += apart
            index[part, at : at + AT_ONCE] = found = distance.argmin(1)
            error[part, at : at + AT_ONCE] = distance[np.arange(len(found)), found]
    return index, error


def gathered(state: tuple[np.ndarray, np.ndarray] | None, block: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums (parts, dimensions, entries) and counts (parts, entries) with one more block in them."""
    sums, counts = state or (np.zeros(books.shape, dtype=np.int64), np.zeros((books.shape[0], books.shape[2]), dtype=np.int64))
    index, _ = nearest(block, books)
    for part in range(len(block)):
        np.add.at(counts[part], index[part], 1)
        for dimension in range(block.shape[1]):
            np.add.at(sums[part, dimension], index[part], block[part, dimension])
    return sums, counts


def together(a: tuple[np.ndarray, np.ndarray] | None, b: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray] | None:
    return (a[0] + b[0], a[1] + b[1]) if a and b else a or b


def next_books(books: np.ndarray, state: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """Means rounded down; entries that are nearest to nothing stay."""
    if state is None:
        return books
    sums, counts = state
    return np.where(counts[:, None, :] > 0, sums // np.maximum(counts, 1)[:, None, :], books)


def in_parts(data: bytes, parts: int, n: int) -> np.ndarray:
    return np.frombuffer(data, dtype="<i8").reshape(parts, -1, n)


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, as decimal numbers with commas between."""
    return hashlib.sha256(",".join(map(str, books.transpose(0, 2, 1).ravel().tolist())).encode()).hexdigest()


def train(blocks: DataFrame, books: np.ndarray, rounds: int) -> np.ndarray:
    """Codebooks after ``rounds`` rounds over blocks of ``n`` vectors each. The driver and every task hold one tensor of their size."""
    context, parts = blocks.sparkSession.sparkContext, len(books)
    for _ in range(rounds):
        now = context.broadcast(books)
        matrices = blocks.select(F.size("ids").alias("n"), "data").rdd.map(lambda r: in_parts(r.data, parts, r.n))
        depth = max(2, math.ceil(math.log(max(2, matrices.getNumPartitions()), FAN_IN)))
        books = next_books(books, matrices.treeAggregate(None, lambda s, b: gathered(s, b, now.value), together, depth))
        now.unpersist()
    return books


def encode(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """``id``, ``label``, ``code`` (array of indexes) and ``error`` of each vector."""
    ids, labels = (blocks.schema[c].dataType.elementType for c in ("ids", "labels"))
    schema = T.StructType([T.StructField("id", ids), T.StructField("label", labels), T.StructField("code", T.ArrayType(T.IntegerType())), T.StructField("error", T.LongType())])
    now = blocks.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = now.value
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                ids, labels = one.column(0).flatten(), one.column(1).flatten()
                index, error = nearest(in_parts(one.column(2)[0].as_py(), len(books), len(ids)), books)
                codes = pa.ListArray.from_arrays(pa.array(np.arange(0, len(books) * (len(ids) + 1), len(books)), pa.int32()), pa.array(index.T.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([ids, labels, codes, pa.array(error.sum(0))], schema.names)

    return blocks.mapInArrow(run, schema)


def with_label_errors(coded: DataFrame, broadcast_labels: int = BROADCAST_LABELS) -> DataFrame:
    """``label_error``, the sum of ``error`` over equal labels; nulls count as equal. Rows that hold one label are added up where they are, and never gathered."""
    sums = written(coded.groupBy("label").agg(F.try_sum("error").alias("label_error")), "label-errors").withColumnRenamed("label", "of")
    if sums.count() <= broadcast_labels:
        return coded.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("of"))).drop("of")
    dealt = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = coded.withColumn("row_salt", F.pmod(F.xxhash64("id", "code", "error"), F.lit(SALTS)).cast("int"))
    return rows.join(dealt.hint("merge"), F.col("label").eqNullSafe(F.col("of")) & (F.col("row_salt") == F.col("salt"))).drop("of", "salt", "row_salt")


def product_codes(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024
) -> tuple[DataFrame, np.ndarray]:
    """Codes of all usable vectors, and the codebooks as (parts, dimensions of a part, entries).

    Returns the id and label columns, ``code`` (an index for each part), ``error`` (squared distances, summed over the parts) and ``label_error``. Rows whose
    vector is null or has null or non-finite components are dropped. Each component x becomes floor(scale * x). A codebook starts as the parts of the vectors
    with the ``entries`` smallest ids (fewer rows: that many entries; null ids come last; of equal ids the smaller vector first). Repeated rows count each for
    itself, ties go to the lower index. Vectors shorter than the longest, or than a multiple of ``parts``, are filled up with zeros; empty ones are all zeros.
    Components too large for 64-bit distances (2^27 in whole numbers for 64 dimensions) count as the largest that is not. A sum over a label that
    leaves 64 bits is null. An empty table gives no rows. Other columns are left out, whatever their names.

    The driver holds codebooks and a few tensors of their size: entries * dimensions numbers each. The blocks and the codes are written to the shared folder.
    """
    kept = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector")).where(usable(F.col("vector")))
    longest = kept.agg(F.max(F.size("vector"))).first()[0] or 0
    dimensions = max(parts, -(-longest // parts) * parts)
    blocks = written(to_blocks(kept, dimensions, scale), "vector-blocks")
    limit = largest_component(dimensions)
    first = kept.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()
    start = np.zeros((len(first), dimensions), dtype=np.int64)
    for row, r in zip(start, first):
        row[: len(r.vector)] = np.clip(np.floor(scale * np.array(r.vector, dtype=np.float64)), -limit, limit).astype(np.int64)
    books = np.ascontiguousarray(start.reshape(len(first), parts, dimensions // parts).transpose(1, 2, 0))
    books = train(blocks, books, rounds) if first else books
    coded = with_label_errors(written(encode(blocks, books), "vector-codes"))
    return coded.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error"), books


def hex_code(code: Column) -> Column:
    """Two hex digits for each index."""
    return F.array_join(F.transform(code, lambda x: F.lower(F.lpad(F.hex(x.cast("long")), 2, "0"))), "")
