"""Byte-level BPE encoding and decoding with numpy matrices.

The distinct pre-tokens of a batch are put in padded matrices, by byte length. In every round each row merges its leftmost pair of minimum rank, and with
it the further places of the same pair, up to the first whose merge makes a pair of lower rank, which has to come next. So a round stands for many steps of
"merge the leftmost pair of minimum rank", in the same order. Ranks come from a hashed pair table. Rows with no mergeable pair leave the matrix, and all
others are compacted to the columns that they still need.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: No merge; above every rank.
NONE = np.uint32(0xFFFFFFFF)
#: Distinct pre-tokens that a Python worker remembers; beyond it, it forgets all and starts anew.
REMEMBERED = 250_000
#: Cells of a matrix, unless a single row has more.
CELLS = 1_000_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Open-addressing hash table from a pair of ids to the id of their merge."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.shift, self.mask = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self.keys = np.full(1 << bits, np.uint64(2**64 - 1))
        self.values = np.full(1 << bits, NONE, dtype=np.uint32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] == np.uint64(2**64 - 1)
            first = np.zeros(len(left), dtype=bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            self.keys[slot[put]], self.values[slot[put]] = keys[left[put]], values[left[put]]
            left, slot = left[~put], (slot[~put] + np.uint64(1)) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * MULTIPLIER) >> self.shift

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ids of the merges, NONE where a pair does not merge; any shape."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], NONE)
        open_ = np.nonzero((found != keys) & (found != np.uint64(2**64 - 1)))
        while len(open_[0]):
            slot[open_] = (slot[open_] + np.uint64(1)) & self.mask
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            at = tuple(x[hit] for x in open_)
            out[at] = self.values[slot[at]]
            more = ~hit & (found != np.uint64(2**64 - 1))
            open_ = tuple(x[more] for x in open_)
        return out


class Codec:
    """Encoder and decoder for a rank file: a line has a token in base64 and its rank, which is its id."""

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        self.pattern = regex.compile(pattern)
        pairs = [
            (self.ranks[token[:i]] << 32 | self.ranks[token[i:]], rank)
            for token, rank in self.ranks.items()
            for i in range(1, len(token))
            if token[:i] in self.ranks and token[i:] in self.ranks
        ]
        both = np.array(pairs, dtype=np.uint64).reshape(-1, 2)
        self.pairs = PairTable(both[:, 0], both[:, 1].astype(np.uint32))
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.uint32)
        size = max(self.ranks.values()) + 1
        self.lengths, self.starts = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
        at, parts = 0, []
        for token, rank in self.ranks.items():
            self.lengths[rank], self.starts[rank] = len(token), at
            at += len(token)
            parts.append(token)
        self.vocabulary = np.frombuffer(b"".join(parts), dtype=np.uint8)
        self.decimal: dict[str, bytes] = {}
        self.packed: dict[str, bytes] = {}

    def merge_matrix(self, ids: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        """The ids of each row of a padded matrix of byte ids, given the rows' lengths."""
        out: list = [None] * len(ids)
        at = np.arange(len(ids))
        ranks = self.ranks_of(ids, lengths)
        while len(ids):
            best = ranks.min(1) if ranks.shape[1] else np.full(len(ids), NONE)
            done = best == NONE
            if done.any():
                for i, row, n in zip(at[done].tolist(), ids[done], lengths[done].tolist()):
                    out[i] = row[:n]
                ids, ranks, at, lengths, best = ids[~done], ranks[~done], at[~done], lengths[~done], best[~done]
                if not len(ids):
                    break
            r, c = self.places(ids, ranks, lengths, best)
            if len(r) == len(ids):
                ids, ranks, lengths = self.merged_once(ids, ranks, lengths - 1, c, best)
                continue
            # the left cell of each place becomes the merged token, its right cell goes
            ids[r, c] = best[r]
            stays = np.ones(ids.shape, dtype=bool)
            stays[r, c + 1] = False
            before = np.bincount(r, minlength=len(ids))
            shift = np.cumsum(~stays, 1)
            lengths = lengths - before
            width = int(lengths.max())
            row, col = np.nonzero(stays & (np.arange(ids.shape[1]) < (lengths + before)[:, None]))
            to = col - shift[row, col]
            new_ids = np.zeros((len(ids), width), dtype=np.uint32)
            new_ids[row, to] = ids[row, col]
            new_ranks = np.full((len(ids), max(0, width - 1)), NONE, dtype=np.uint32)
            inner = to < width - 1
            old = np.minimum(col[inner], ranks.shape[1] - 1)
            new_ranks[row[inner], to[inner]] = np.where(col[inner] < ranks.shape[1], ranks[row[inner], old], NONE)
            # pairs with a merged token are looked up anew
            place = c - shift[r, c]
            for rr, cc in ((r, place - 1), (r, place)):
                fits = (cc >= 0) & (cc < lengths[rr] - 1)
                rr, cc = rr[fits], cc[fits]
                new_ranks[rr, cc] = self.pairs.find(new_ids[rr, cc], new_ids[rr, cc + 1])
            # the last pair of a row was one with a cell that is gone
            short = np.flatnonzero(lengths < width)
            new_ranks[short, lengths[short] - 1] = NONE
            ids, ranks = new_ids, new_ranks
        return out

    def merged_once(self, ids: np.ndarray, ranks: np.ndarray, lengths: np.ndarray, where: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All rows after one merge in each: cells move up by one from the place on. ``lengths`` are those after it."""
        n, k = np.arange(len(ids)), ids.shape[1] - 1
        at = np.arange(k)[None, :]
        ids = np.where(at > where[:, None], ids[:, 1:], ids[:, :-1])
        ids[n, where] = best
        ranks = np.where(at[:, : k - 1] >= where[:, None], ranks[:, 1:], ranks[:, :-1])
        for cells, fits in ((where - 1, where > 0), (where, where < lengths - 1)):
            r, c = n[fits], cells[fits]
            ranks[r, c] = self.pairs.find(ids[r, c], ids[r, c + 1])
        return ids, ranks, lengths

    def ranks_of(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        found = self.pairs.find(ids[:, :-1], ids[:, 1:])
        found[np.arange(found.shape[1]) >= lengths[:, None] - 1] = NONE
        return found

    def places(self, ids: np.ndarray, ranks: np.ndarray, lengths: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and columns of the pairs that are merged in one round, by row and from left to right."""
        r, c = np.nonzero(ranks == best[:, None])
        first = np.append(True, r[1:] != r[:-1])
        if 2 * len(r) < 3 * len(ids):  # few rows have further places: one merge in each row is the cheaper round
            return r[first], c[first]
        # of places that overlap, every other one counts from the left
        joined = ~first & (c == np.append(-2, c[:-1]) + 1)
        run = np.maximum.accumulate(np.where(joined, 0, np.arange(len(r))))
        even = (np.arange(len(r)) - run) % 2 == 0
        r, c = r[even], c[even]
        first = np.append(True, r[1:] != r[:-1])
        # a merge is the round's last one if it makes a pair of lower rank
        after_merged = ~first & (c == np.append(-2, c[:-1]) + 2)
        left = np.where(after_merged, best[r], ids[r, np.maximum(c - 1, 0)])
        lower = (c > 0) & (self.pairs.find(left, best[r]) < best[r])
        right = np.minimum(c + 2, ids.shape[1] - 1)
        lower |= (c + 2 < lengths[r]) & (self.pairs.find(best[r], ids[r, right]) < best[r])
        ended = np.cumsum(lower) - lower
        keep = ended == ended[np.flatnonzero(first)][np.cumsum(first) - 1]
        return r[keep], c[keep]

    def learn(self, tokens: set[str]) -> None:
        """Encode the pre-tokens that are not remembered yet, by length."""
        if len(self.packed) + len(tokens) > REMEMBERED:
            self.decimal.clear()
            self.packed.clear()
        new = [t for t in tokens if t not in self.packed]
        by_length: dict[int, list[tuple[str, bytes]]] = {}
        for t in new:
            b = t.encode()
            by_length.setdefault(len(b), []).append((t, b))
        for length, rows in by_length.items():
            encoded = []
            step = max(1, CELLS // length)
            for i in range(0, len(rows), step):
                part = np.frombuffer(b"".join(b for _, b in rows[i : i + step]), dtype=np.uint8).reshape(-1, length)
                encoded += self.merge_matrix(self.byte_ids[part], np.full(len(part), length))
            for (t, _), ids in zip(rows, encoded):
                self.packed[t] = ids.tobytes()
                self.decimal[t] = ",".join(map(str, ids.tolist())).encode()

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, bytes]]:
        """Of each text, the ids and their decimal form joined by commas."""
        for text in texts:
            tokens = self.pattern.findall(text)
            self.learn(set(tokens))
            yield np.frombuffer(b"".join(map(self.packed.__getitem__, tokens)), dtype=np.uint32), b",".join(map(self.decimal.__getitem__, tokens))

    def decode(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.vocabulary[np.repeat(self.starts[ids] - ends + lengths, lengths) + np.arange(total)].tobytes()


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(ranks_path: str, pattern: str) -> Codec:
    """One codec for each rank file and Python worker."""
    key = (ranks_path, pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(ranks_path, pattern)
    return _CODECS[key]


def grouped_encode(c: Codec, texts: list[str], most: int = 200_000) -> Iterator[tuple[np.ndarray, bytes]]:
    """As Codec.encode, with the new pre-tokens of several texts in the same matrices."""
    waiting, count = [], 0
    for text in [*texts, None]:
        if text is not None:
            waiting.append(c.pattern.findall(text))
            count += len(waiting[-1])
        if waiting and (text is None or count >= most):
            c.learn(set().union(*waiting))
            for tokens in waiting:
                yield np.frombuffer(b"".join(map(c.packed.__getitem__, tokens)), dtype=np.uint32), b",".join(map(c.decimal.__getitem__, tokens))
            waiting, count = [], 0


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Encode every text, then decode the ids.

    Returns the id column, ``n_tokens`` long, ``ids`` (array of int, with ``keep_ids``), ``ids_sha256`` (of the decimal ids joined by
    commas) and ``decoded_sha256`` (of the decoded bytes). A null text counts as empty: no ids. A null id is kept. Repeated rows
    give repeated rows; other columns are left out, whatever their names. An empty table gives an empty result. Texts of any length are
    encoded whole.
    """
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ids_field = [T.StructField("ids", T.ArrayType(T.IntegerType()))] if keep_ids else []
    schema = T.StructType([T.StructField(id_col, source.schema["id"].dataType), T.StructField("n_tokens", T.LongType()), *ids_field, T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for batch in batches:
            counts, ids_sha, decoded_sha, kept = [], [], [], []
            for ids, decimal in grouped_encode(c, [x or "" for x in batch.column(1).to_pylist()]):
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(decimal).hexdigest())
                decoded_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
                if keep_ids:
                    kept.append(ids.astype(np.int32))
            columns = [batch.column(0), pa.array(counts, pa.int64())]
            if keep_ids:
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*kept, np.zeros(0, np.int32)]), pa.int32())))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], schema.names)

    return source.mapInArrow(run, schema)
