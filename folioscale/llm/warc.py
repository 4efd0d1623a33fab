"""WARC archives with a two-level capture index.

Pages are written as gzip members to archive files in the shared folder. The index sorts reversed-host URL keys into compressed blocks and
keeps, for each of its files, a sparse directory of the blocks' first and last keys. A lookup finds the index file in a short list, binary-searches
its directory, reads the range of one block, binary-searches that, and then reads the records' ranges in file order.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscale.llm.url_lm import after_scheme, host_of
from folioscale.plans.session import fresh_path, written

#: Lines of an index block; bytes of an archive file before the next one starts; bytes that are read at once; bytes of an archive that one task reads in a row.
BLOCK_LINES, ARCHIVE_BYTES, READ_BYTES, STRETCH_BYTES = 1_000, 1 << 30, 4 << 20, 16 << 20
#: Digests of repeated payloads that are broadcast, about 64 MB; beyond it, they are joined by a shuffle, dealt over SALTS parts each.
BROADCAST_DIGESTS, SALTS = 500_000, 16
COMPRESSION = 3
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass
class Archive:
    """Where the files are, the index files with their key ranges: ``(name, first key, last key)``, a row for each index partition, and the size of the archives."""

    folder: str
    shards: list[tuple[str, str, str]]
    size: int


def url_key(url: Column) -> Column:
    """Host parts from the last to the first, then ``)``, path and query; white space is percent-encoded. Null and URLs without ``://`` have the key ``)`` and what there is."""
    host = host_of(url)
    rest = F.substring_index(after_scheme(url), "#", 1)
    tail = F.substr(rest, F.length(host) + 1)
    key = F.concat(F.array_join(F.reverse(F.split(host, "\\.")), ","), F.lit(")"), tail)
    for raw, escaped in ((" ", "%20"), ("\t", "%09"), ("\n", "%0A"), ("\r", "%0D")):
        key = F.replace(key, F.lit(raw), F.lit(escaped))
    return key


def record(page_id: str | None, url: str | None, payload: bytes, sha1: bytes, refers_to: str | None, captured: str) -> bytes:
    """One WARC record: a response with its payload, or a revisit with the HTTP headers only."""
    digest = "sha1:" + base64.b32encode(sha1).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record_id(page_id)}>", f"WARC-Date: {captured}", f"WARC-Payload-Digest: {digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{record_id(refers_to)}>", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record_id(page_id: str | None) -> str:
    return uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}").urn


def parse_record(raw: bytes) -> dict[str, str | int | None]:
    """A record's page, type, payload size and digest. The digest of a response is computed from its payload and must be the recorded one."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(b": ", 1) for line in http.split(b"\r\n")[1:])[b"Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"damaged record of page {fields.get('X-Page-ID')}")
    return {"page_id": fields.get("X-Page-ID"), "record_type": fields["WARC-Type"], "payload_bytes": size, "payload_digest": digest, "refers_to": fields.get("X-Refers-To-Page"), "url": fields.get("WARC-Target-URI")}


def attempt_name(kind: str) -> str:
    """A file name of this task attempt alone; what a failed attempt left is in no list and is never read."""
    c = TaskContext.get()
    return f"{kind}-{c.partitionId():06d}-{c.taskAttemptId()}"


def write_archives(pages: DataFrame, folder: str, captured: str) -> DataFrame:
    """Write records of ``id, url, key, payload, sha1, refers_to`` and return ``key, file, offset, length``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        out, name, at, part, stem = None, "", 0, 0, attempt_name("archive")
        for batch in batches:
            keys, names, offsets, lengths = batch.column(2), [], [], []
            for i, url, payload, sha1, refers in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4, 5))):
                if out is None or at >= ARCHIVE_BYTES:
                    if out:
                        out.close()
                    name, at, part = f"{stem}-{part}.warc.gz", 0, part + 1
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                z = zlib.compressobj(COMPRESSION, zlib.DEFLATED, 31)
                member = z.compress(record(i, url, payload, bytes.fromhex(sha1), refers, captured)) + z.flush()
                out.write(member)
                names.append(name)
                offsets.append(at)
                lengths.append(len(member))
                at += len(member)
            yield pa.RecordBatch.from_arrays([keys, pa.array(names, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], ["key", "file", "offset", "length"])
        if out:
            out.close()

    return pages.select("id", "url", "key", "payload", "sha1", "refers_to").mapInArrow(run, "key string, file string, offset long, length long")


def write_index(captures: DataFrame, folder: str, shards: int) -> list[tuple[str, str, str]]:
    """Sort the captures into at most ``shards`` index files of compressed blocks, each with its block directory. Returns each file's name and key range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        name, out, at, directory, lines = attempt_name("index"), None, 0, [], []

        def flush() -> None:
            nonlocal out, at, lines
            if lines:
                out = out or fs.open_output_stream(f"{base}/{name}.cdx.gz", compression=None)
                block = zlib.compress("\n".join(lines).encode(), COMPRESSION)
                out.write(block)
                directory.append((lines[0].split("\t", 1)[0], lines[-1].split("\t", 1)[0], at, len(block)))
                at, lines = at + len(block), []

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(4))):
                lines.append("{}\t{}\t{}\t{}".format(*row))
                if len(lines) == BLOCK_LINES:
                    flush()
        flush()
        if out:
            out.close()
            with fs.open_output_stream(f"{base}/{name}.dir") as f:
                f.write("\n".join("\t".join(map(str, x)) for x in directory).encode())
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (name, directory[0][0], directory[-1][1])], ["name", "first", "last"])

    ordered = captures.repartitionByRange(shards, "key", "file", "offset").sortWithinPartitions("key", "file", "offset")
    rows = written(ordered.mapInArrow(run, "name string, first string, last string"), "shards").collect()
    return sorted((r["name"], r["first"], r["last"]) for r in rows)


def key_of_line(line: bytes) -> bytes:
    """What the lines are sorted by. The whole line is in another order: keys can go on with bytes below the tab that ends them."""
    return line.split(b"\t", 1)[0]


class IndexReader:
    """Lookups in one folder's index files; a file's directory and its last block are kept."""

    def __init__(self, folder: str):
        self.fs, self.base = pafs.FileSystem.from_uri(folder)
        self.name, self.directory, self.file, self.held, self.lines = "", [], None, -1, []

    def turn_to(self, name: str) -> None:
        if name != self.name:
            with self.fs.open_input_stream(f"{self.base}/{name}.dir") as f:
                rows = [x.split("\t") for x in f.read().decode().split("\n")]
            self.directory = [(a.encode(), b.encode(), int(o), int(n)) for a, b, o, n in rows]
            self.lasts = [x[1] for x in self.directory]
            self.name, self.file, self.held = name, self.fs.open_input_file(f"{self.base}/{name}.cdx.gz"), -1

    def block(self, k: int) -> list[bytes]:
        if k != self.held:
            _, _, offset, length = self.directory[k]
            self.file.seek(offset)
            self.held, self.lines = k, zlib.decompress(self.file.read(length)).split(b"\n")
        return self.lines

    def captures(self, name: str, key: bytes) -> Iterator[tuple[str, int, int]]:
        """(archive file, offset, length) of all captures of a key in an index file."""
        self.turn_to(name)
        k = bisect.bisect_left(self.lasts, key)
        while k < len(self.directory) and self.directory[k][0] <= key:
            lines = self.block(k)
            at = bisect.bisect_left(lines, key, key=key_of_line)
            while at < len(lines) and lines[at].startswith(key + b"\t"):
                _, file, offset, length = lines[at].decode().split("\t")
                yield file, int(offset), int(length)
                at += 1
            k += 1


def tasks(spark: SparkSession, size: int, each: int) -> int:
    """Enough tasks for work of a certain size, and for all cores."""
    return max(2 * spark.sparkContext.defaultParallelism, -(-size // each))


def shards_of(archive: Archive) -> Callable[[pa.Array], list[list[str]]]:
    """The index files that can hold each of some keys. Files are in the order of their keys, so they are found by bisection; neighbours may share a key."""
    names, firsts, lasts = ([x[k].encode() if k else x[0] for x in archive.shards] for k in range(3))
    return lambda keys: [names[bisect.bisect_left(lasts, k.encode()) : bisect.bisect_right(firsts, k.encode())] for k in keys.to_pylist()]


def lookup(archive: Archive, keys: DataFrame) -> DataFrame:
    """Captures (``key, file, offset, length``) of the distinct values of a ``key`` column. Null keys find nothing."""
    folder, find = archive.folder, shards_of(archive)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = find(batch.column(0))
            at = pa.array([i for i, x in enumerate(found) for _ in x], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([n for x in found for n in x], pa.string()), batch.column(0).take(at)], ["name", "key"])

    where = keys.select("key").where(F.col("key").isNotNull()).distinct().mapInArrow(place, "name string, key string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = IndexReader(folder)
        for batch in batches:
            rows: list[tuple] = []
            for name, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for found in reader.captures(name, key.encode()):
                    rows.append((key, *found))
                    if len(rows) == 10_000:
                        yield as_batch(rows)
                        rows = []
            yield as_batch(rows)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())], ["key", "file", "offset", "length"])

    n = tasks(keys.sparkSession, len(archive.shards), 1)
    ordered = where.repartition(n, "name", F.pmod(F.xxhash64("key"), F.lit(4))).sortWithinPartitions("name", "key")
    return ordered.mapInArrow(run, "key string, file string, offset long, length long")


def read_records(archive: Archive, captures: DataFrame) -> DataFrame:
    """The records at ``file, offset, length``; ranges that touch are read together, up to READ_BYTES."""
    folder = archive.folder
    names = ("page_id", "record_type", "payload_bytes", "payload_digest", "refers_to", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        open_name, f = "", None
        for batch in batches:
            rows = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
            found, i = [], 0
            while i < len(rows):
                name, start, length = rows[i]
                j, end = i + 1, start + length
                while j < len(rows) and rows[j][0] == name and rows[j][1] == end and end + rows[j][2] - start <= READ_BYTES:
                    end += rows[j][2]
                    j += 1
                if name != open_name:
                    open_name, f = name, fs.open_input_file(f"{base}/{name}")
                f.seek(start)
                data = memoryview(f.read(end - start))
                for _, offset, n in rows[i:j]:
                    found.append(parse_record(zlib.decompress(data[offset - start : offset - start + n], 31)))
                i = j
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], pa.int64() if k == "payload_bytes" else pa.string()) for k in names], list(names))

    # the number of tasks follows from the bytes that they read; the few bytes of their offsets say nothing about it
    stretch = min(STRETCH_BYTES, max(READ_BYTES // 8, archive.size // tasks(captures.sparkSession, archive.size, STRETCH_BYTES)))
    n = tasks(captures.sparkSession, archive.size, STRETCH_BYTES)
    in_order = captures.select("file", "offset", "length").distinct().repartition(n, "file", F.floor(F.col("offset") / stretch)).sortWithinPartitions("file", "offset")
    return in_order.mapInArrow(run, "page_id string, record_type string, payload_bytes long, payload_digest string, refers_to string, url string")


def with_keys(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    payload = F.coalesce(F.encode(F.col(payload_col).cast("string"), "UTF-8"), F.lit(b""))
    return pages.select(F.col(id_col).alias("number"), F.col(url_col).alias("url"), url_key(F.col(url_col)).alias("key"), payload.alias("payload"), F.sha1(payload).alias("sha1"))


def write(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", captured: str = "1970-01-01T00:00:00Z", shards: int | None = None) -> Archive:
    """Write all pages and their index; see ``round_trip`` for which become revisits.

    Ids and digests are grouped without the payloads. Digests that occur twice or more are then broadcast to the pages, so payloads stay where they are; if
    there are more than BROADCAST_DIGESTS, pages are shuffled to them, those of one digest over SALTS parts.
    """
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    d = with_keys(pages, id_col, url_col, payload_col)
    repeated = d.where(F.octet_length("payload") >= least_bytes).select(F.unhex("sha1").alias("digest"), "number").groupBy("digest").agg(F.min("number").alias("first"), F.count("*").alias("c"))
    first = written(repeated.where("c > 1").select(F.lower(F.hex("digest")).alias("sha1"), "first"), "digests")
    if first.count() <= BROADCAST_DIGESTS:
        joined = d.join(F.broadcast(first), "sha1", "left")
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        joined = d.withColumn("salt", F.pmod(F.xxhash64("number", "url"), F.lit(SALTS)).cast("int")).join(first.withColumn("salt", salts), ["sha1", "salt"], "left")
    refers = F.when(F.col("number").isNull() | (F.col("number") != F.col("first")), F.col("first").cast("string"))
    rows = joined.select(F.col("number").cast("string").alias("id"), "url", "key", "payload", "sha1", F.when(F.octet_length("payload") >= least_bytes, refers).alias("refers_to"))
    captures = written(write_archives(rows, folder, captured), "captures")
    size = captures.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    return Archive(folder, write_index(captures, folder, shards or int(spark.conf.get("spark.sql.shuffle.partitions"))), int(size))


def round_trip(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write all pages, then look all their URLs up in the index and read their records back.

    Per page: the id column, ``payload_bytes``, ``payload_digest`` (base-32 SHA-1), ``record_type`` and ``refers_to``. Of records with equal payloads of at least
    ``least_bytes`` bytes, the one with the smallest id is a response and the others are revisits of it; smaller ones are all responses. A null payload is
    empty. Null ids come last, so they revisit any other; if all ids of a payload are null, all are responses. Rows that repeat the smallest id are all
    responses. A null URL has the key ``)`` and no target. Other columns are left out. An empty table gives no rows.
    """
    archive = write(pages, least_bytes, id_col, url_col, payload_col)
    found = lookup(archive, pages.select(url_key(F.col(url_col)).alias("key")))
    kind = pages.schema[id_col].dataType
    return read_records(archive, found).select(F.col("page_id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
