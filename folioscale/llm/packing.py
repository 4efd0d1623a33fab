"""Packing of token pieces into fixed-size sequences by exact complements.

Only the number of pieces of each length decides how full the sequences get, and lengths are bounded by the capacity. So the plan is
made from a histogram of at most ``capacity`` numbers: a list of patterns (lengths that share a sequence) and how often each is used.
Pieces then find their place by their rank among the pieces of their length, which needs no ordering of all pieces anywhere.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscale.plans.session import written

#: Bytes of chunks that a Python worker remembers; when there are more, it forgets those that were not met since the last time.
REMEMBERED_BYTES = 8_000_000
#: Characters of texts whose new chunks are asked for at once, and chunks in each text that the library is asked for.
GROUP_CHARS, LINES = 4_000_000, 100
#: Counts (one for each task and length) that are broadcast to the pieces, about 64 MB; beyond it, the pieces are shuffled to them.
BROADCAST_COUNTS = 1_000_000
# Unicode white space, on which byte-level tokenizers split a text.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WHITE, _LETTER, _MARK = (np.array([b < 128 and f(chr(b)) for b in range(256)]) for f in (lambda c: c in "\t\n\v\f\r ", str.isalpha, lambda c: not c.isalpha() and c not in "\t\n\v\f\r "))
_BEYOND = [int.from_bytes(chr(c).encode()) for c in range(128, 0x3001) if re.match(f"[{WHITE}]", chr(c))]
_WHITE_TWO, _WHITE_THREE = [x for x in _BEYOND if x < 1 << 16], [x for x in _BEYOND if x >= 1 << 16]


def chunk_begins(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which bytes begin a chunk, in texts as UTF-8 whose white space is all ASCII; ``first`` is where each text begins.

    A chunk ends before white space, and where a Latin letter is followed by a digit or mark of ASCII: there the library's pattern ends a word as well. Of
    white space before a word its last character stands alone, or belongs to the word if it is a space.
    """
    white, before, after = _WHITE[data], data[:-1], data[1:]
    begins = np.zeros(len(data), dtype=bool)
    begins[first] = True
    last = white[:-1] & ~white[1:]
    last[first[1:] - 1] = False
    begins[:-1] |= last
    begins[1:] |= (last & (before != 32)) | (white[1:] & ~white[:-1])
    letter = _LETTER[data]
    letter[1:] |= (before >= 0xC3) & (before <= 0xC8) & ~((before == 0xC3) & ((after == 0x97) | (after == 0xB7)))
    begins[1:] |= letter[:-1] & _MARK[after]
    return begins


def white_beyond_ascii(data: np.ndarray) -> np.ndarray:
    """Where characters of white space beyond ASCII begin."""
    at = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    padded = np.append(data, [0, 0]).astype(np.int64)
    two = (padded[at] << 8) | padded[at + 1]
    return at[np.isin(two, _WHITE_TWO) | np.isin((two << 8) | padded[at + 2], _WHITE_THREE)]


class Tokenizer:
    """The ids of the tokenizers library.

    A byte-level BPE works on each chunk between white space by itself, so the library is asked once for each distinct chunk, and texts of any length
    are put together from remembered chunks. Other kinds of tokenizers are asked for every whole text.
    """

    def __init__(self, path: str):
        import tokenizers

        self.library = tokenizers.Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split, added = spec.get("pre_tokenizer") or {}, spec["added_tokens"]
        level = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        line_break = self.library.encode("\n", add_special_tokens=False).ids
        self.line_break = line_break[0] if len(line_break) == 1 else None
        self.by_chunk = spec["model"]["type"] == "BPE" and level and self.line_break is not None and not spec.get("normalizer") and not any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in added)
        # all up to white space
        self.chunks = re.compile(rf" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
        self.contents = [x["content"].encode() for x in added]
        self.added = re.compile("(" + "|".join(re.escape(x["content"]) for x in sorted(added, key=lambda x: -len(x["content"]))) + ")") if added else None
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.size = 0

    def ask(self, chunks: list[str]) -> list[bytes]:
        """The ids of chunks, as bytes. A line break is a token of its own between chunks without one, so these are asked for as the lines of texts."""
        blank = [c.isspace() for c in chunks]
        lines = [c for c, b in zip(chunks, blank) if not b]
        texts = ["\n".join(lines[i : i + LINES]) for i in range(0, len(lines), LINES)]
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.array([i for x in found for i in (*x.ids, self.line_break)], dtype="<u4")
        raw, ends = ids.tobytes(), np.flatnonzero(ids == self.line_break).tolist()
        of_lines = iter([raw[4 * a : 4 * b] for a, b in zip([0, *(x + 1 for x in ends)], ends)])
        of_blanks = iter(self.library.encode_batch_fast([c for c, b in zip(chunks, blank) if b], add_special_tokens=False))
        return [array("I", next(of_blanks).ids).tobytes() if b else next(of_lines) for b in blank]

    def split(self, text: str) -> list[str]:
        """The chunks of a text with any white space and added tokens."""
        # an added token parts a text: the white space before it is at the end of its part
        parts = self.added.split(text) if self.added else [text]
        return [c for k, part in enumerate(parts) for c in ([part] if k % 2 else self.chunks.findall(part))]

    def starts(self, data: np.ndarray, first: np.ndarray, texts: list[str]) -> np.ndarray:
        """Where the chunks of texts begin in their UTF-8 bytes, given where each text begins. None of the texts is empty."""
        begins = chunk_begins(data, first)
        odd = set((np.searchsorted(first, white_beyond_ascii(data), side="right") - 1).tolist())
        if any(x in data.tobytes() for x in self.contents):
            odd.update(k for k, text in enumerate(texts) if self.added.search(text))
        for k in odd:
            lengths = [len(c.encode()) for c in self.split(texts[k])]
            begins[first[k] : first[k] + sum(lengths)] = False
            begins[first[k] + np.cumsum([0, *lengths[:-1]])] = True
        return np.flatnonzero(begins)

    def learn(self, chunks: list[bytes]) -> None:
        if self.size > REMEMBERED_BYTES // 2:
            self.before, self.known, self.size = self.known, {}, 0
        new = [c for c in chunks if c not in self.known]
        asked = [c for c in new if c not in self.before]
        self.known.update((c, self.before[c]) for c in new if c in self.before)
        if asked:
            self.known.update(zip(asked, self.ask([c.decode() for c in asked])))
        self.size += sum(map(len, new))

    def ids_of_group(self, texts: list[str]) -> Iterator[np.ndarray]:
        raw = [text.encode() for text in texts]
        lengths = np.array([len(x) for x in raw])
        full = np.flatnonzero(lengths)
        ends = np.zeros(len(texts) + 1, dtype=np.int64)  # of the texts' ids
        flat = np.zeros(0, dtype="<u4")
        if len(full):
            whole = b"".join(raw)
            first = (np.cumsum(lengths) - lengths)[full]
            starts = self.starts(np.frombuffer(whole, dtype=np.uint8), first, [texts[k] for k in full.tolist()])
            offsets = np.append(starts, len(whole)).astype(np.int64)
            coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(whole)]).dictionary_encode()
            distinct, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            self.learn(distinct)
            found = [self.known[c] for c in distinct]
            sizes = np.array([len(x) // 4 for x in found], dtype=np.int64)
            counts, until = sizes[codes], np.cumsum(sizes)
            done = np.cumsum(counts)  # ids up to and with each chunk
            flat = np.frombuffer(b"".join(found), dtype="<u4")[np.repeat((until - sizes)[codes] - (done - counts), counts) + np.arange(done[-1])]
            ends[full + 1] = done[np.append(np.searchsorted(starts, first[1:]), len(starts)) - 1]
            ends = np.maximum.accumulate(ends)
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            yield flat[a:b]

    def ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text. Texts are read in groups, so that their new chunks are asked for at once."""
        if not self.by_chunk:
            for i in range(0, len(texts), 100):
                yield from (np.array(x.ids, dtype="<u4") for x in self.library.encode_batch_fast(texts[i : i + 100], add_special_tokens=False))
            return
        waiting, size = [], 0
        for i, text in enumerate(texts):
            waiting.append(text)
            size += len(text)
            if size >= GROUP_CHARS or i == len(texts) - 1:
                yield from self.ids_of_group(waiting)
                waiting, size = [], 0


_TOKENIZERS: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """One tokenizer for each file and Python worker. Tasks share a machine's cores, so the library starts no threads of its own."""
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _TOKENIZERS[path] = Tokenizer(path)
    return _TOKENIZERS[path]


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str, text_col: str, keep_ids: bool) -> DataFrame:
    """Pieces of all documents; ``part`` and ``nth`` number the pieces of one length within a task."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("id", source.schema["id"].dataType), T.StructField("piece", T.IntegerType()), *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32")), T.StructField("part", T.IntegerType()), T.StructField("nth", T.LongType()), *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if keep_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, part, seen = tokenizer(tokenizer_path), TaskContext.get().partitionId(), [0] * (capacity + 1)
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            rows, pieces, starts, lengths, crcs, nths, kept = [], [], [], [], [], [], []
            for row, found in enumerate(t.ids([x or "" for x in batch.column(1).to_pylist()])):
                ids = np.concatenate([found, end])
                first = len(ids) % capacity or capacity
                packed = ids.tobytes()
                if keep_ids:
                    kept.append(ids)
                for k, (a, b) in enumerate(zip([0, *range(first, len(ids), capacity)], range(first, len(ids) + 1, capacity))):
                    rows.append(row)
                    pieces.append(k)
                    starts.append(a)
                    lengths.append(b - a)
                    crcs.append(zlib.crc32(packed[4 * a : 4 * b]))
                    nths.append(seen[b - a])
                    seen[b - a] += 1
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64()), pa.array([part] * len(rows), pa.int32()), pa.array(nths, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.ListArray.from_arrays(pa.array(np.cumsum([0, *lengths]), pa.int32()), pa.array(np.concatenate([*kept, end[:0]]).astype(np.int32)))] if keep_ids else [])], schema.names)

    return source.mapInArrow(run, schema)


class Complements:
    """Combinations of one to three available lengths with a given sum. Counts only fall, so what is used up is dropped for good."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        present = np.flatnonzero(counts)
        self.pairs: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, a in enumerate(present.tolist()):
            for b in present[: i + 1].tolist():
                if a + b < len(counts):
                    self.pairs[a + b].append((a, b))
        for found in self.pairs.values():
            found.sort(key=lambda p: p[1])  # even pairs are used first: they leave the short pieces, which fit everywhere
        self.singles = present.tolist()
        self.next_single: dict[int, int] = {}

    def enough(self, lengths: tuple[int, ...]) -> int:
        """How often these lengths can be taken together."""
        return min(int(self.counts[x]) // lengths.count(x) for x in lengths)

    def pair(self, gap: int, beside: tuple[int, ...]) -> tuple[int, int] | None:
        found = self.pairs.get(gap, [])
        while found and not self.enough(found[-1]):
            found.pop()
        return next((p for p in reversed(found) if self.enough((*p, *beside))), None)

    def find(self, gap: int, beside: int) -> tuple[int, ...] | None:
        """One, else two, else three lengths that fill a gap beside a given length exactly."""
        if 0 < gap < len(self.counts) and self.enough((gap, beside)):
            return (gap,)
        if (two := self.pair(gap, (beside,))) is not None:
            return two
        k = self.next_single.setdefault(gap, len(self.singles) - 1)
        while k >= 0:
            a = self.singles[k]
            if a <= gap - 2 and self.counts[a] and (two := self.pair(gap - a, (a, beside))) is not None:
                self.next_single[gap] = k
                return (a, *two)
            k -= 1
        self.next_single[gap] = k
        return None


def plan_patterns(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and their numbers of uses: exact combinations from the longest length down, then best fit, longest first."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] = n
    patterns: list[tuple[tuple[int, ...], int]] = []
    rest: dict[int, int] = {}
    index = Complements(counts)
    for length in range(capacity, 0, -1):
        while counts[length]:
            gap = capacity - length
            found = () if gap == 0 else index.find(gap, length)
            if found is None:
                rest[length] = int(counts[length])
                counts[length] = 0
                break
            whole = (length, *found)
            times = index.enough(whole)
            for x in whole:
                counts[x] -= times
            patterns.append((whole, times))

    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    gaps: list[int] = []

    def keep(pattern: tuple[int, ...], times: int) -> None:
        gap = capacity - sum(pattern)
        if gap not in open_:
            open_[gap] = []
            bisect.insort(gaps, gap)
        open_[gap].append((pattern, times))

    for length in sorted(rest, reverse=True):
        n = rest[length]
        while n:
            at = bisect.bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                pattern, times = open_[gap].pop()
                used = min(n, times)
                if times > used:
                    open_[gap].append((pattern, times - used))
                if not open_[gap]:
                    del open_[gap]
                    gaps.pop(at)
                keep((*pattern, length), used)
                n -= used
            else:
                each = capacity // length
                if n // each:
                    keep((length,) * each, n // each)
                if n % each:
                    keep((length,) * (n % each), 1)
                n = 0
    return patterns + [x for found in open_.values() for x in found]


def intervals(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset): which ranks of a length go where."""
    out, taken, base = [], defaultdict(int), 0
    for pattern, times in patterns:
        offset = 0
        for length in pattern:
            out.append((length, taken[length], taken[length] + times, base, offset))
            taken[length] += times
            offset += length
        base += times
    return out


def crc32_of_ids(ids: str) -> Column:
    """crc32 of a column of ids, each as four bytes, the lowest first."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            data = memoryview(batch.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes())
            ends = 4 * np.cumsum([0, *batch.value_lengths().to_pylist()])
            yield pa.array([zlib.crc32(data[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.int64())

    return F.arrow_udf(run, "long")(F.col(ids))


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    A document is its ids and ``end_id``; a longer one is cut into pieces of ``capacity``, of which the first may be shorter. Returns per
    piece: the id column, ``piece`` int, ``start``, ``length``, ``ids_crc32``, ``sequence_id`` and ``offset`` (long), and with ``keep_ids``
    the ids. A null text is empty, so it has one piece of length 1. A null id is kept; rows with the same id are packed each for
    itself. An empty table gives no rows. Other columns are left out, whatever their names.

    The pieces are written once to the shared folder. The driver sees a histogram of at most ``capacity`` lengths; the plan is
    broadcast, with at most a few rows for each length. The first ranks of each task's pieces are broadcast up to BROADCAST_COUNTS rows.
    """
    spark = docs.sparkSession
    pieces = written(cut_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col, keep_ids), "pieces")
    counts = written(pieces.groupBy("part", "length").agg((F.max("nth") + 1).alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.createDataFrame(intervals(plan_patterns(histogram, capacity)), "at long, lo long, hi long, base long, offset long")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    if counts.count() <= BROADCAST_COUNTS:
        first = F.broadcast(first)
    rank = F.col("first") + F.col("nth")
    placed = pieces.join(first, ["part", "length"]).withColumn("rank", rank).join(F.broadcast(plan), (F.col("length") == F.col("at")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return placed.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset", *(["ids"] if keep_ids else []))
