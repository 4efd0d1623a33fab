"""Maximal runs of repeated words in texts, found as branching tandem repeats in a suffix tree.

The words of many texts stand in one array; a word of one text never equals a word of another, so their suffix trees share no edge. The trees are built from
sorted suffixes: prefix doubling sorts those that are not yet told apart, the common prefixes of neighbours follow from the ranks of its rounds, and a
node is a stretch of sorted suffixes between two shorter common prefixes. Every node of depth d then visits the leaves outside its largest child (each leaf is
met at most log2 n times), and asks whether a leaf d words before or after it is below the node as well: a repeat w w with d = len(w). It is branching if another
word follows than the one that w starts with. A run of period d holds exactly one such repeat of length 2d, at its right end; rotating it to the left gives the
whole run. Of runs over the same words, found for multiples of a period, that with the smallest period is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words whose trees are built at once, unless a single text has more.
GROUP_WORDS = 150_000
#: Leaves visited at once, unless a single child has more.
GROUP_LEAVES = 1_000_000
# White space between words.
WHITE = r"[\x20\x09-\x0D]"

RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


def sorted_suffixes(symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order, and for each round k the rank of each place by its first 2^k symbols. ``ends`` has the end of each place's text.

    Ranks are places in the order, so one that is unique stays; only places with equals are sorted again.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    slots, places, keys = np.arange(n), order, symbols[order]
    rank, levels, width = np.zeros(n, dtype=np.int64), [], 1
    while True:
        fresh = np.ones(len(keys) + 1, dtype=bool)
        fresh[1:-1] = keys[1:] != keys[:-1]
        rank = rank.copy()
        rank[places] = slots[np.flatnonzero(fresh[:-1])[np.cumsum(fresh[:-1]) - 1]]
        levels.append(rank.astype(np.int32 if n < 1 << 31 else np.int64))
        equal = ~(fresh[:-1] & fresh[1:])
        slots = slots[equal]
        if not len(slots):
            return order, levels
        places = places[equal]
        after = places + width
        keys = rank[places] * (n + 1) + np.where(after < ends[places], rank[np.minimum(after, n - 1)] + 1, 0)
        again = np.argsort(keys, kind="stable")
        places, keys = places[again], keys[again]
        order[slots] = places
        width *= 2


def common_prefixes(order: np.ndarray, levels: list[np.ndarray], ends: np.ndarray) -> np.ndarray:
    """At k the common prefix of the suffixes k - 1 and k in order; 0 at both ends."""
    out = np.zeros(len(order) + 1, dtype=np.int64)
    ranks = levels[0][order]
    at = np.flatnonzero(ranks[1:] == ranks[:-1]) + 1
    a, b = order[at - 1], order[at]
    start = a.copy()
    last_a, last_b = ends[a], ends[b]
    for k in range(len(levels) - 2, -1, -1):
        same = (a < last_a) & (b < last_b)
        same[same] = levels[k][a[same]] == levels[k][b[same]]
        a, b = a + (same << k), b + (same << k)
    out[at] = a - start
    return out


def tree_nodes(prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inner nodes below the root: first and end place in the order, and depth; then the children of each but the largest, as places from and to, with node.

    Returned as (first, end, depth, children of shape (2, n), node of each child).
    """
    at = np.flatnonzero(prefix)
    if not len(at):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, np.zeros((2, 0), dtype=np.int64), none
    depth = prefix[at]
    zeros = np.flatnonzero(prefix == 0)
    table = [prefix]
    while 1 << len(table) <= int(np.diff(zeros).max()) and len(table[-1]) > 1 << (len(table) - 1):
        half = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    end, first = at + 1, at - 1  # the next and the last shorter common prefix
    for k in range(len(table) - 1, -1, -1):
        inside = np.minimum(end, len(table[k]) - 1)
        end = end + ((table[k][inside] >= depth) & (inside == end)).astype(np.int64) * (1 << k)
        back = first - (1 << k) + 1
        first = first - ((back >= 0) & (table[k][np.maximum(back, 0)] >= depth)).astype(np.int64) * (1 << k)
    by_node = np.argsort(first * len(prefix) + end, kind="stable")
    at, first, end, depth = at[by_node], first[by_node], end[by_node], depth[by_node]
    opens = np.ones(len(at) + 1, dtype=bool)
    opens[1:-1] = (first[1:] != first[:-1]) | (end[1:] != end[:-1])
    heads, tails, node = np.flatnonzero(opens[:-1]), np.flatnonzero(opens[1:]), np.cumsum(opens[:-1]) - 1
    # a node's children lie between its own common prefixes: one before each, and one after the last
    low = np.concatenate([np.where(opens[:-1], first, np.roll(at, 1)), at[tails]])
    high = np.concatenate([at, end[tails]])
    owner = np.concatenate([node, np.arange(len(heads))])
    largest = np.lexsort((low, low - high, owner))
    largest = largest[np.concatenate([[True], np.diff(owner[largest]) > 0])]
    small = np.ones(len(low), dtype=bool)
    small[largest] = False
    return first[heads], end[heads], depth[heads], np.stack([low[small], high[small]]), owner[small]


def branching_repeats(symbols: np.ndarray, begins: np.ndarray, ends: np.ndarray, order: np.ndarray, levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of all branching tandem repeats, each once."""
    first, end, depth, children, owner = tree_nodes(common_prefixes(order, levels, ends))
    rank, n = levels[-1], len(symbols)
    sizes = children[1] - children[0]
    cuts = np.unique(np.searchsorted(np.cumsum(sizes), np.arange(0, int(sizes.sum()) + GROUP_LEAVES, GROUP_LEAVES), side="right")) if len(sizes) else []
    found = []
    for a, b in zip([0, *cuts], [*cuts, len(sizes)]):
        if a == b:
            continue
        size, node = sizes[a:b], np.repeat(owner[a:b], sizes[a:b])
        at = order[np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(children[0, a:b], size)]
        d = depth[node]
        for start in (at, at - d):
            other = start + d if start is at else start
            there = (other >= begins[at]) & (other < ends[at])
            there[there] = (rank[other[there]] >= first[node[there]]) & (rank[other[there]] < end[node[there]])
            s, p = start[there], d[there]
            follows = s + 2 * p
            s, p = (x[(follows >= ends[s]) | (symbols[np.minimum(follows, n - 1)] != symbols[s])] for x in (s, p))
            found.append(s * (n + 1) + p)
    keys = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)
    return keys // (n + 1), keys % (n + 1)


def maximal_runs(symbols: np.ndarray, begins: np.ndarray, ends: np.ndarray, min_length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and smallest periods of all runs of at least two periods and ``min_length`` symbols, by start and period. Texts have no symbol in common."""
    if not len(symbols):
        return (np.zeros(0, dtype=np.int64),) * 3
    order, levels = sorted_suffixes(symbols, ends)
    start, period = branching_repeats(symbols, begins, ends, order, levels)
    stop, lowest = start + 2 * period, begins[start]
    for k in range(len(levels) - 2, -1, -1):  # rotate to the left
        back = start - (1 << k)
        same = back >= lowest
        same[same] = levels[k][back[same]] == levels[k][back[same] + period[same]]
        start = np.where(same, back, start)
    long = stop - start >= min_length
    start, stop, period = start[long], stop[long], period[long]
    by = np.lexsort((period, stop, start))
    start, stop, period = start[by], stop[by], period[by]
    once = np.ones(len(start), dtype=bool)
    once[1:] = (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])
    start, length, period = start[once], (stop - start)[once], period[once]
    by = np.lexsort((period, start))
    return start[by], length[by], period[by]


def runs_of_texts(texts: list[list[bytes]], min_length: int) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each list of words."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    total = int(sizes.sum())
    number = dict.fromkeys(chain.from_iterable(texts))
    number = dict(zip(number, range(len(number))))
    symbols = np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), dtype=np.int64, count=total)
    text = np.repeat(np.arange(len(texts)), sizes)
    last = np.cumsum(sizes)
    start, length, period = maximal_runs(text * len(number) + symbols, (last - sizes)[text], last[text], min_length)
    of = text[start] if total else start
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for i, s, n, p in zip(of.tolist(), (start - (last - sizes)[of]).tolist(), length.tolist(), period.tolist()):
        out[i].append((s, n, p))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words, joined by one space, without those that any run holds after its first period."""
    if runs:
        kept = np.ones(len(words), dtype=bool)
        for start, length, period in runs:
            kept[start + period : start + length] = False
        words = list(compress(words, kept.tolist()))
    return b" ".join(words).decode()


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 12) -> DataFrame:
    """The id column, ``n_words``, ``runs`` (structs of start, length and period in words, by start, then period) and ``collapsed`` (the text without repeats).

    A run is a stretch of words with smallest period q and at least max(min_length, 2 * q) words that can't be made longer on either side. A word is any
    characters between ASCII white space. A null or empty text has no words, no runs and an empty collapsed text. Rows with null or repeated ids are read
    each for itself; an empty table gives no rows. Other columns are left out, whatever their names.

    Nothing is shuffled. A task holds the trees of at most GROUP_WORDS words, or of one longer text: about 300 bytes a word.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("id", source.schema["id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])
    struct = pa.struct([pa.field(f.name, pa.int64()) for f in RUN])

    def answer(ids: pa.Array, texts: list[list[bytes]]) -> pa.RecordBatch:
        runs = runs_of_texts(texts, min_length)
        flat = np.array([x for r in runs for x in r], dtype=np.int64).reshape(-1, 3)
        structs = pa.StructArray.from_arrays([pa.array(c) for c in flat.T], fields=list(struct))
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, runs)]), pa.int32()), structs)
        return pa.RecordBatch.from_arrays([ids, pa.array(list(map(len, texts)), pa.int64()), lists, pa.array(list(map(collapsed, texts, runs)), pa.string())], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, first, size = [], 0, 0
            for k, text in enumerate(batch.column(1)):
                texts.append((text.as_py() or "").encode().split())
                size += len(texts[-1])
                if size >= GROUP_WORDS or k == batch.num_rows - 1:
                    yield answer(batch.column(0).slice(first, len(texts)), texts)
                    texts, first, size = [], k + 1, 0

    return source.mapInArrow(run, T.StructType([*schema])).withColumnRenamed("id", id_col)


def longest(runs: Column) -> Column:
    """The run with most words, of equal ones that with the smallest start, then period; null if there is none."""
    ranked = F.array_sort(F.transform(runs, lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length"))))
    return F.when(F.size(runs) > 0, F.element_at(ranked, 1))


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every tenth text, chosen by crc32 of its id, repeats a stretch of its words from a place chosen by it up to its end; other texts and columns stay.

    With h the crc32 of the decimal id and g = floor(h / 10): if h % 10 is 0, each of n words from a = g % n on becomes word a + (i - a) % p, where
    p = 1 + floor((n - a) / (3 + g % 8)). A null id counts as an empty one; texts without words stay.
    """
    h = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    words = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), f"{WHITE}+", -1), lambda w: w != "")
    made = F.transform(F.array(F.struct(words.alias("w"), F.floor(h / 10).alias("g"))), lambda x: F.struct(x["w"].alias("w"), (x["g"] % F.size(x["w"])).cast("int").alias("a"), x["g"].alias("g")))
    made = F.transform(made, lambda x: F.struct(x["w"].alias("w"), x["a"].alias("a"), (1 + F.floor((F.size(x["w"]) - x["a"]) / (3 + x["g"] % 8))).cast("int").alias("p")))
    text = F.transform(made, lambda x: F.array_join(F.transform(x["w"], lambda w, i: F.when(i < x["a"], w).otherwise(x["w"][x["a"] + F.pmod(i - x["a"], x["p"])])), " "))[0]
    return docs.withColumn(text_col, F.when((h % 10 == 0) & F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]"), text).otherwise(F.col(text_col)))
