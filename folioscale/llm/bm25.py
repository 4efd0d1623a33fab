"""Exact top-k search by BM25 over an inverted index in shards, with block-max WAND.

Each shard has the postings of some thousand documents, numbered so that documents of like words and lengths are neighbours. A posting list is cut into blocks of neighbouring documents, and for every block of every list the
index keeps the greatest term frequency and the least document length, which bound what any of its postings can add, whatever the corpus's statistics.
A query's cursors stand on the blocks of its lists. The sum of their bounds tells which documents can reach the threshold (the k-th best score so
far); the next of these are the pivots. Only blocks under pivots are opened, and a batch of pivots is scored at once; all other blocks are skipped, and
the threshold rises with each batch. Lists that many of a shard's documents are in lie in a matrix as well. Queries are taken together, those that can have most in the same block; a
product of matrices sums each one's frequent lists over the blocks that one of them waits for, and the greatest sum in a block is a tighter bound than the sum of the greatest. Only the other lists are added posting by posting. A shard's postings and what each adds are read and computed before its queries, so a skipped block spares adding up, not reading. Shards give their own best k, which are merged. Document counts and lengths are those of the whole corpus.
Contributions are whole millionths, so sums do not depend on their order and ties are exact.

Queries are a table like any other: they are packed into blocks of bounded size in the shared folder, and the task of a shard reads one block after the other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscale.plans.session import written

K1, B, SCALE = 1.2, 0.75, 1_000_000.0
#: Documents and terms of a shard at most; documents that share a block of each list.
SHARD_DOCS, SHARD_TERMS, BLOCK = 8_192, 2_000_000, 64
#: (query, term) pairs of a block of queries, about 20 MB with all that is derived from them.
QUERY_TERMS = 400_000
#: Postings whose contributions are computed at once.
AT_ONCE = 500_000
#: Pivot blocks that are scored before all others, those with the highest bounds, and in each batch after them.
FIRST_PIVOTS, PIVOTS = 8, 64
#: Lists in more than one of so many documents of a shard are columns of a matrix as well, at most so many lists (32 MB).
FREQUENT, MATRIX_LISTS = 32, 1_024
#: A 32-bit sum of so many whole numbers, times this, is no less than their exact sum, and by this factor twice no more: its error is below MATRIX_LISTS / 2 ** 24.
MARGIN = np.float32(1 + 2**-12)
#: Queries that are looked at in one go; of these, that are scored together, with so many list blocks if they are more than one.
LOOKED_AT, TOGETHER, PASSED = 1_024, 128, 2_000_000

_CLEAN = bytes(b + 32 if 65 <= b <= 90 else (b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32) for b in range(256))
_KINDS = {"terms": np.uint64, "counts": np.int32, "doc": np.uint16, "tf": np.int32, "lengths": np.int32, "most_tf": np.int32, "least_length": np.int32}
_INDEX = "shard string, docs int, length long, " + ", ".join(f"{k} binary" for k in _KINDS)


def term_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct terms of a text as 64-bit hashes, ascending, and how often each occurs. Terms are runs of ASCII letters and digits and all other characters
    beyond ASCII; A-Z are lower-cased."""
    words = (text or "").encode().translate(_CLEAN).split()
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words)), return_counts=True)


def block_starts(terms: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Where the blocks of all lists begin among the postings, which are by term and document."""
    block = doc // BLOCK
    return np.flatnonzero(np.append(len(doc) > 0, (terms[1:] != terms[:-1]) | (block[1:] != block[:-1])))


def neighbours(terms: list[np.ndarray], tfs: list[np.ndarray]) -> list[int]:
    """An order of documents by their most frequent term, then by length. A language's or topic's lists then have fewer blocks, with tighter bounds, and a
    query of another one skips them. Results don't depend on it."""
    key = np.array([t[n.argmax()] if len(t) else 0 for t, n in zip(terms, tfs)], dtype=np.uint64)
    return np.lexsort(([int(n.sum()) for n in tfs], key)).tolist()


def pack_shard(terms: list[np.ndarray], tfs: list[np.ndarray]) -> dict[str, np.ndarray]:
    """The arrays of a shard, given each document's terms and their frequencies."""
    doc = np.repeat(np.arange(len(terms), dtype=np.uint16), [len(t) for t in terms])
    lengths = np.array([int(t.sum()) for t in tfs], dtype=np.int32)
    flat, tf = np.concatenate(terms), np.concatenate(tfs).astype(np.int32)
    order = np.argsort(flat, kind="stable")
    flat, doc, tf = flat[order], doc[order], tf[order]
    distinct, counts = np.unique(flat, return_counts=True)
    first = block_starts(flat, doc)
    most = np.maximum.reduceat(tf, first) if len(first) else tf
    least = np.minimum.reduceat(lengths[doc], first) if len(first) else lengths[doc]
    return dict(zip(_KINDS, (distinct, counts.astype(np.int32), doc, tf, lengths, most, least)))


def build_index(docs: DataFrame) -> DataFrame:
    """A row for each shard of ``id, text``, as packed arrays: its postings by term and document, and the bounds of their blocks. Shards never leave their input partition."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        ids: list = []
        terms: list[np.ndarray] = []
        tfs: list[np.ndarray] = []
        size = 0

        def shard() -> pa.RecordBatch:
            order = neighbours(terms, tfs)
            d = pack_shard([terms[i] for i in order], [tfs[i] for i in order])
            return pa.RecordBatch.from_arrays([pa.array([f"{part}-{number}"]), pa.array([len(ids)], pa.int32()), pa.array([int(d["lengths"].sum())], pa.int64()), *(pa.array([d[x].tobytes()], pa.binary()) for x in _KINDS), pa.array([[ids[i] for i in order]], pa.list_(id_type))], names)

        names = [x.split()[0] for x in _INDEX.split(", ")] + ["ids"]
        id_type = pa.int64()
        for batch in batches:
            id_type = batch.schema.field(0).type
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                t, n = term_counts(text)
                if len(ids) == SHARD_DOCS or (ids and size + len(t) > SHARD_TERMS):
                    yield shard()
                    ids, terms, tfs, size, number = [], [], [], 0, number + 1
                ids.append(i), terms.append(t), tfs.append(n)
                size += len(t)
        if ids:
            yield shard()

    return docs.mapInArrow(run, f"{_INDEX}, ids array<{kind}>")


def query_terms(queries: DataFrame) -> DataFrame:
    """``query`` and its distinct ``terms``; of rows with the same query, the one whose text has the least hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [term_counts(t)[0].view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64())), batch.column(2)], ["query", "terms", "hash"])

    terms = queries.withColumn("hash", F.xxhash64("text")).mapInArrow(run, f"query {queries.schema['query'].dataType.simpleString()}, terms array<long>, hash long")
    return terms.groupBy("query").agg(F.min_by("terms", "hash").alias("terms"))


def document_frequencies(index: DataFrame) -> DataFrame:
    """``term, df``: in how many documents of all shards each term occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(t, dtype=np.int64)), pa.array(np.frombuffer(c, dtype=np.int32))], ["term", "n"])

    return index.select("terms", "counts").mapInArrow(run, "term long, n int").groupBy("term").agg(F.sum("n").alias("df"))


def known_terms(index: DataFrame, asked: DataFrame) -> DataFrame:
    """``query, terms, df``: the terms of each query that the index has. Frequencies are summed before queries meet them, so the join makes one row for each query and term."""
    pairs = asked.select("query", F.explode("terms").alias("term")).join(document_frequencies(index), "term")
    return pairs.groupBy("query").agg(F.collect_list(F.struct("term", "df")).alias("t")).select("query", F.col("t.term").alias("terms"), F.col("t.df").alias("df"))


@dataclass
class Queries:
    """A block of queries: its distinct terms, ascending, with their documents; each query's terms as places among them; and the scores from which a document counts."""

    names: pa.Array
    terms: np.ndarray
    df: np.ndarray
    starts: np.ndarray
    places: np.ndarray
    floors: np.ndarray


def pack_queries(queries: DataFrame, parts: int) -> DataFrame:
    """Rows of ``query, terms, df, floor`` as rows of about QUERY_TERMS terms."""
    kind = queries.schema["query"].dataType.simpleString()
    names = ("names", "terms", "df", "starts", "places", "floors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        name_type, size = None, 0

        def packed() -> pa.RecordBatch:
            flat, df = np.concatenate([r[1] for r in rows]).astype(np.int64).view(np.uint64), np.concatenate([r[2] for r in rows]).astype(np.int64)
            terms, first, places = np.unique(flat, return_index=True, return_inverse=True)
            arrays = terms, df[first], np.cumsum([0, *(len(r[1]) for r in rows)]), places.astype(np.int32), np.array([r[3] for r in rows], dtype=np.int64)
            return pa.RecordBatch.from_arrays([pa.array([[r[0] for r in rows]], pa.list_(name_type)), *(pa.array([x.tobytes()], pa.binary()) for x in arrays)], list(names))

        for batch in batches:
            name_type = batch.schema.field(0).type
            for row in zip(*(batch.column(k).to_pylist() for k in range(4))):
                rows.append(row)
                size += len(row[1])
                if size >= QUERY_TERMS:
                    yield packed()
                    rows, size = [], 0
        if rows:
            yield packed()

    dealt = queries.select("query", "terms", "df", "floor").repartition(parts, "query")
    return written(dealt.mapInArrow(run, f"names array<{kind}>, " + ", ".join(f"{x} binary" for x in names[1:])), "query-blocks")


def read_queries(files: list[str]) -> Iterator[Queries]:
    """The blocks of queries in the files that Spark wrote, one at a time."""
    kinds = (np.uint64, np.int64, np.int64, np.int32, np.int64)
    for uri in files:
        fs, path = pafs.FileSystem.from_uri(uri)
        with fs.open_input_file(path) as f:
            for batch in pq.ParquetFile(f).iter_batches(batch_size=1):
                yield Queries(batch.column(0).flatten(), *(np.frombuffer(batch.column(k + 1)[0].as_py(), dtype=t) for k, t in enumerate(kinds)))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin at ``starts``."""
    ends = np.cumsum(counts)
    return np.repeat(starts - ends + counts, counts) + np.arange(int(ends[-1]) if len(ends) else 0)


def contribution(idf: np.ndarray, tf: np.ndarray, length: np.ndarray, average: float) -> np.ndarray:
    """BM25 of a term in a document, in whole millionths. It rises with ``tf`` and falls with ``length``, rounded as well."""
    return np.rint(((SCALE * idf) * (tf * (K1 + 1))) / (tf + K1 * ((1 - B) + (B * length) / average)))


class Shard:
    """A shard's arrays: lists of postings, each cut into blocks."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.terms, self.tf, self.lengths = arrays["terms"], arrays["tf"], arrays["lengths"].astype(np.float64)
        self.doc = arrays["doc"]
        self.counts = arrays["counts"].astype(np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        self.most_tf, self.least_length = arrays["most_tf"], arrays["least_length"]
        self.block_start = block_starts(np.repeat(np.arange(len(self.terms)), self.counts), self.doc)
        self.block_count = np.diff(np.append(self.block_start, len(self.doc)))
        self.first_block = np.searchsorted(self.block_start, self.starts)
        self.n_blocks = np.diff(np.append(self.first_block, len(self.block_start)))
        self.docs = len(self.lengths)


class ShardSearch:
    """One shard for a block of queries: the lists of their terms with the bounds of all list blocks, in the order of the block's distinct terms."""

    def __init__(self, shard: Shard, q: Queries, n_docs: int, average: float):
        at = np.minimum(np.searchsorted(shard.terms, q.terms), max(0, len(shard.terms) - 1))
        here = shard.terms[at] == q.terms if len(shard.terms) else np.zeros(len(q.terms), dtype=bool)
        lists = at[here]
        idf = np.log(1.0 + ((n_docs - q.df) + 0.5) / (q.df + 0.5))[here]
        self.docs, self.average = shard.docs, average
        self.n_blocks = np.zeros(len(q.terms), dtype=np.int64)
        self.n_blocks[here] = shard.n_blocks[lists]
        self.first = np.cumsum(self.n_blocks) - self.n_blocks
        blocks = ranges(shard.first_block[lists], shard.n_blocks[lists])
        self.block = shard.doc[shard.block_start[blocks]].astype(np.int64) // BLOCK
        self.bound = contribution(np.repeat(idf, shard.n_blocks[lists]), shard.most_tf[blocks].astype(np.float64), shard.least_length[blocks].astype(np.float64), average)
        # postings of these lists, as (start, count) of each block; queries that open the same block share its contributions
        self.count = shard.block_count[blocks]
        self.start = np.cumsum(self.count) - self.count
        posts = ranges(shard.starts[lists], shard.counts[lists])
        self.doc = shard.doc[posts].astype(np.int64)
        self.value = np.empty(len(posts))
        owner = np.repeat(np.arange(len(lists), dtype=np.int32), shard.counts[lists])
        for i in range(0, len(posts), AT_ONCE):
            part = slice(i, i + AT_ONCE)
            self.value[part] = contribution(idf[owner[part]], shard.tf[posts[part]].astype(np.float64), shard.lengths[self.doc[part]], average)
        # the frequent lists as columns over all documents, and the greatest contribution of each of their blocks; 32-bit floats hold whole numbers below 2 ** 24
        n, own = -(-shard.docs // BLOCK), shard.counts[lists]
        many = np.flatnonzero((own * FREQUENT > shard.docs) & (idf * ((K1 + 1) * SCALE) < (1 << 24) - 1))
        many = many[np.argsort(-own[many], kind="stable")[:MATRIX_LISTS]]
        self.column = np.full(len(q.terms), -1, dtype=np.int64)
        self.column[np.flatnonzero(here)[many]] = np.arange(len(many))
        self.matrix = np.zeros((n * BLOCK, len(many)), dtype=np.float32)
        posts = ranges((np.cumsum(own) - own)[many], own[many])
        self.matrix[self.doc[posts], np.repeat(np.arange(len(many)), own[many])] = self.value[posts]
        self.most = self.matrix.reshape(n, BLOCK, len(many)).max(axis=1)
        self.opened = self.skipped = 0

    def best(self, places: np.ndarray, ids: np.ndarray, k: int, floor: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """The best k documents (scores, local numbers) of at least ``floor`` for a query's terms; equal scores by the lower id."""
        return self.best_of([places], ids, k, np.array([floor]))[0]

    def best_of(self, asked: list[np.ndarray], ids: np.ndarray, k: int, floors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """``best`` of each of some queries. Those that can have most in the same block are scored together."""
        flat, owner = np.concatenate(asked), np.repeat(np.arange(len(asked)), [len(p) for p in asked])
        column = self.column[flat]
        wanted = np.zeros((len(asked), self.matrix.shape[1]), dtype=np.float32)
        wanted[owner[column >= 0], column[column >= 0]] = 1
        reach = wanted @ self.most.T * MARGIN
        order = np.argsort(reach.argmax(axis=1), kind="stable")
        passed = np.bincount(owner, weights=self.n_blocks[flat], minlength=len(asked))[order]
        out: list = [None] * len(asked)
        start = 0
        while start < len(order):
            few = int(np.searchsorted(np.cumsum(passed[start : start + TOGETHER]), PASSED, side="right"))
            part = order[start : start + max(1, few)]
            for j, found in zip(part.tolist(), self.together([asked[j] for j in part.tolist()], wanted[part], reach[part], ids, k, floors[part])):
                out[j] = found
            start += len(part)
        return out

    def together(self, asked: list[np.ndarray], wanted: np.ndarray, reach: np.ndarray, ids: np.ndarray, k: int, floors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """The best k of each query, given which frequent lists it wants and what these add at most in each block. A product of matrices sums the frequent lists of
        all these queries over the blocks that one of them waits for; each query then has one list of these sums, whose greatest in a block is known, beside its other lists."""
        g, n = reach.shape
        rare = [p[self.column[p] < 0] for p in asked]
        lists = np.concatenate(rare)
        cursor = ranges(self.first[lists], self.n_blocks[lists])  # the list blocks that the queries' cursors pass
        ends = np.cumsum([0, *(int(self.n_blocks[p].sum()) for p in rare)])
        block, bound = self.block[cursor], self.bound[cursor]
        others = np.bincount(np.repeat(np.arange(g) * n, np.diff(ends)) + block, weights=bound, minlength=g * n).reshape(g, n)
        reach = reach + others  # what a document of these blocks can have at most
        limits = np.maximum(1, floors)
        waiting = reach >= limits[:, None]
        sums, present = np.zeros((g, n * BLOCK), dtype=np.float32), self.most > 0
        self.skipped += sum(int(self.n_blocks[p].sum()) for p in asked)

        def add_up(here: np.ndarray) -> None:
            edges = np.flatnonzero(np.diff(here, prepend=False, append=False)).tolist()
            for a, b in zip(edges[::2], edges[1::2]):
                own = sums[:, a * BLOCK : b * BLOCK]
                np.matmul(wanted, self.matrix[a * BLOCK : b * BLOCK].T, out=own)
                own *= MARGIN
            summed = int(wanted.sum(axis=0) @ present[here].sum(axis=0))
            self.opened += summed
            self.skipped -= summed

        def opened(j: int, pivots: np.ndarray) -> None:
            waiting[j, pivots] = False
            mine = slice(ends[j], ends[j + 1])
            tops[j], limits[j] = self.open(pivots, cursor[mine], block[mine], sums[j], wanted[j], tops[j], ids, k, int(limits[j]))

        tops = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))] * g
        here = np.zeros(n, dtype=bool)
        first = {j: self.highest(reach[j], waiting[j]) for j in np.flatnonzero(limits == 1).tolist()}  # they give a floor to queries without one
        for pivots in first.values():
            here[pivots] = True
        add_up(here)
        for j, pivots in first.items():
            opened(j, pivots)
        waiting &= reach >= limits[:, None]
        add_up(waiting.any(axis=0) & ~here)
        reach = others + sums.reshape(g, n, BLOCK).max(axis=2)
        for j in range(g):
            waiting[j] &= reach[j] >= limits[j]
            while len(pivots := np.flatnonzero(waiting[j])[:PIVOTS]):
                opened(j, pivots)
                waiting[j] &= reach[j] >= limits[j]
        return tops

    @staticmethod
    def highest(reach: np.ndarray, waiting: np.ndarray) -> np.ndarray:
        """The first pivots: of the blocks that wait, those with the highest bounds."""
        blocks = np.flatnonzero(waiting)
        return blocks[np.argpartition(-reach[blocks], FIRST_PIVOTS)[:FIRST_PIVOTS]] if len(blocks) > FIRST_PIVOTS else blocks

    def open(
        self, pivots: np.ndarray, cursor: np.ndarray, block: np.ndarray, sums: np.ndarray, wanted: np.ndarray, top: tuple[np.ndarray, np.ndarray], ids: np.ndarray, k: int, floor: int
    ) -> tuple[tuple[np.ndarray, np.ndarray], int]:
        """The best k (scores, local numbers) and the threshold after the documents of some blocks are scored: by the list blocks that the cursors pass there and, for those
        documents that can be among the best, by the wanted frequent lists, whose sums are at most ``sums``."""
        under = np.zeros(-(-self.docs // BLOCK), dtype=bool)
        under[pivots] = True
        open_ = cursor[under[block]]
        self.opened += len(open_)
        self.skipped -= len(open_)
        posts = ranges(self.start[open_], self.count[open_])
        # sums of whole numbers far below 2 ** 53 are exact
        total = np.bincount(self.doc[posts], weights=self.value[posts], minlength=len(under) * BLOCK)
        docs = (pivots[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        most = total[docs] + sums[docs]
        docs, most = docs[most >= floor], most[most >= floor]
        if len(docs) > k:
            docs = docs[most >= np.partition(most, len(most) - k)[len(most) - k] / MARGIN**2]
        new = total[docs] + self.matrix[docs].astype(np.float64) @ wanted.astype(np.float64)
        docs, new = docs[new >= floor], new[new >= floor].astype(np.int64)
        if len(docs) > k:
            keep = new >= np.partition(new, len(new) - k)[len(new) - k]
            docs, new = docs[keep], new[keep]
        scores, found = np.concatenate([top[0], new]), np.concatenate([top[1], docs])
        best = np.lexsort((ids[found], -scores))[:k]
        return (scores[best], found[best]), max(floor, int(scores[best[-1]])) if len(best) == k else floor


def search_shards(index: DataFrame, queries: DataFrame, n_docs: int, total_length: int, k: int, kinds: tuple[str, str]) -> DataFrame:
    """The best k of each shard for each query, of at least its floor: ``query, doc, score``. A task holds one shard and one block of queries at a time."""
    files, average = sorted(queries.inputFiles()), total_length / max(1, n_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                one = batch.slice(row, 1)
                shard = Shard({x: np.frombuffer(one.column(x)[0].as_py(), dtype=t) for x, t in _KINDS.items()})
                keys = one.column("ids").flatten()
                ids = keys.to_numpy(zero_copy_only=False)
                for q in read_queries(files):
                    s = ShardSearch(shard, q, n_docs, average)
                    asked = [q.places[a:b] for a, b in zip(q.starts[:-1].tolist(), q.starts[1:].tolist())]
                    found = [x for i in range(0, len(asked), LOOKED_AT) for x in s.best_of(asked[i : i + LOOKED_AT], ids, k, q.floors[i : i + LOOKED_AT])]
                    n = np.array([len(x) for x, _ in found])
                    yield pa.RecordBatch.from_arrays([q.names.take(pa.array(np.repeat(np.arange(len(n)), n))), keys.take(pa.array(np.concatenate([d for _, d in found]))), pa.array(np.concatenate([x for x, _ in found]))], ["query", "doc", "score"])

    return index.drop("docs", "length", "shard").mapInArrow(run, f"query {kinds[0]}, doc {kinds[1]}, score long")


def search(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", query_id: str = "query_id", query_text: str = "text") -> DataFrame:
    """The ``k`` best documents of each query: ``query_id``, ``rank`` (from 1), the document's id and ``score`` (millionths, long).

    BM25 over the distinct terms of a query's whole text. Documents without a common term aren't returned, so a query without terms (null or empty
    text) has no rows. Equal scores rank by the lower id. Rows with a null id, in either table, are left out. Repeated rows of documents are documents of
    their own; of queries with the same id, the one whose text has the least hash is answered. Other columns are left out. Empty tables give no rows.

    Some shards (about the square root of their number) are searched first. The k-th best score that they give a query is its floor in all others, which
    then return few rows. Nothing but counts reaches the driver, and nothing is broadcast by this function.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull())
    index = written(build_index(source), "index")
    asked = written(query_terms(queries.select(F.col(query_id).alias("query"), F.col(query_text).alias("text")).where(F.col("query").isNotNull())), "queries").where(F.size("terms") > 0)
    stats = index.agg(F.count("*").alias("shards"), F.coalesce(F.sum("docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("length")).first()
    size = asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    kinds = asked.schema["query"].dataType.simpleString(), source.schema["id"].dataType.simpleString()

    known = written(known_terms(index, asked), "query-terms")
    parts = max(1, -(-int(size) // QUERY_TERMS))
    every = max(1, round(stats["shards"] ** 0.5))
    early = F.pmod(F.xxhash64("shard"), F.lit(every)) == 0
    first = written(search_shards(index.where(early), pack_queries(known.withColumn("floor", F.lit(1)), parts), stats["n"], stats["length"], k, kinds), "found")
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    floors = first.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") == k).select("query", F.col("score").alias("floor"))
    floored = known.join(floors, "query", "left").withColumn("floor", F.coalesce("floor", F.lit(1)))
    rest = written(search_shards(index.where(~early), pack_queries(floored, parts), stats["n"], stats["length"], k, kinds), "found")
    ranked = first.union(rest).withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    return ranked.select(F.col("query").alias(query_id), "rank", F.col("doc").alias(id_col), "score")
