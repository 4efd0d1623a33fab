"""Quality classifier: histogram gradient-boosted trees over statistics of a document, scored by vectorised numpy traversal."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscale.llm.labels import labelled_sample, remainder

#: Label rows that the trees learn from, at most, for each class.
SAMPLE_PER_CLASS = 10_000

# Frequent function words of four languages.
STOP_WORDS = frozenset(
    w.encode()
    for w in (
        "the be to of and that have with is in it for was on are as by this a at an or not from "
        "der die das und ist den von zu mit für auf nicht ein eine des im dem sich auch als "
        "le la les de et un une en du que est pour dans qui par sur au avec pas "
        "el los las y una por con para del se no es lo como su al"
    ).split()
)
_UPPER, _LOWER, _DIGIT, _HIGH = slice(65, 91), slice(97, 123), slice(48, 58), slice(128, 256)
_SYMBOL = [ord(c) for c in "#*$%&|<>"]
_MARK = [ord(c) for c in ".,;:"]
_LOUD = [ord(c) for c in "!?"]
_SPACE = [9, 10, 11, 12, 13, 32]
FEATURES = 20


def statistics(text: str | None) -> np.ndarray:
    """FEATURES statistics of a whole text, as float32; all but the first three are shares. An empty text has zeros."""
    out = np.zeros(FEATURES, dtype=np.float32)
    raw = (text or "").encode()
    if not raw:
        return out
    n = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    words, total = raw.split(), len(raw)
    letters = n[_UPPER].sum() + n[_LOWER].sum() + n[_HIGH].sum()
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    w, k = max(1, len(words)), max(1, len(lines))
    p = n[n > 0] / total
    distinct = len(set(words))
    out[:] = (
        np.log1p(len(words)),
        np.log1p(len(lines)),
        sum(map(len, words)) / w,
        n[_UPPER].sum() / max(1, letters),
        n[_DIGIT].sum() / total,
        n[_SYMBOL].sum() / w,
        n[_MARK].sum() / w,
        n[_LOUD].sum() / w,
        n[_SPACE].sum() / total,
        letters / total,
        n[_HIGH].sum() / total,
        sum(map(STOP_WORDS.__contains__, words)) / w,
        distinct / w,
        distinct / w**0.7,
        sum(map(eq, words, words[1:])) / w,
        1 - len(set(lines)) / k,
        np.log1p(w / k),
        -(p * np.log(p)).sum(),
        n[ord("|")] / w,
        n[[ord(c) for c in "@/=_{}[]()"]].sum() / w,
    )
    return out


@dataclass
class Trees:
    """All trees in flat arrays: a node tests ``feature <= cut`` and goes left or right; leaves point to themselves and have a value."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1; every row walks all trees at once."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.prior + self.value[at].sum(1))))


def train(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 1.0, least: float = 3.0) -> Trees:
    """Boost ``trees`` trees of ``depth`` levels on the logistic loss, from histograms over quantile bins. Needs no examples of both classes: then the prior is all."""
    positive = (y.sum() + 1) / (len(y) + 2)
    prior = float(np.log(positive / (1 - positive)))
    feature, cut, left, right, value, roots = [], [], [], [], [], []
    if 0 < y.sum() < len(y):
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        code = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
        width, n_features = bins, x.shape[1]
        raw = np.full(len(y), prior)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-raw))
            g, h = p - y, p * (1 - p)
            node = np.zeros(len(y), dtype=np.int64)
            first = len(feature)
            roots.append(first)
            ids = [first]
            feature.append(0), cut.append(np.inf), left.append(first), right.append(first), value.append(0.0)
            for level in range(depth + 1):
                k = len(ids)
                live = node >= 0
                sums = np.bincount(node[live], g[live], k), np.bincount(node[live], h[live], k)
                if level == depth:
                    for i, t in enumerate(ids):
                        value[t] = -rate * sums[0][i] / (sums[1][i] + ridge)
                    raw[live] += np.array([value[t] for t in ids])[node[live]]
                    break
                flat = ((node[live][:, None] * n_features + np.arange(n_features)) * width + code[live]).ravel()
                size = k * n_features * width
                gs = np.bincount(flat, np.repeat(g[live], n_features), size).reshape(k, n_features, width).cumsum(2)
                hs = np.bincount(flat, np.repeat(h[live], n_features), size).reshape(k, n_features, width).cumsum(2)
                gt, ht = sums[0][:, None, None], sums[1][:, None, None]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain[(hs < least) | (ht - hs < least)] = -1
                for f, e in enumerate(edges):
                    gain[:, f, len(e) :] = -1
                best = gain.reshape(k, -1).argmax(1)
                next_ids, split_left, split_right = [], np.full(k, -1), np.full(k, -1)
                fs, cs = best // width, best % width
                for i, t in enumerate(ids):
                    if gain[i, fs[i], cs[i]] <= 1e-6:
                        value[t] = -rate * sums[0][i] / (sums[1][i] + ridge)
                        continue
                    feature[t], cut[t] = int(fs[i]), float(edges[fs[i]][cs[i]])
                    for side, split in ((left, split_left), (right, split_right)):
                        new = len(feature)
                        feature.append(0), cut.append(np.inf), left.append(new), right.append(new), value.append(0.0)
                        side[t] = new
                        split[i] = len(next_ids)
                        next_ids.append(new)
                stay = live.copy()
                stay[live] = split_left[node[live]] < 0
                raw[stay] += np.array([value[t] for t in ids])[node[stay]]
                go = live & ~stay
                small = code[go, fs[node[go]]] <= cs[node[go]]
                moved = np.where(small, split_left[node[go]], split_right[node[go]])
                node[stay], node[go] = -1, moved
                ids = next_ids
                if not ids:
                    break
    if not roots:
        feature, cut, left, right, value, roots = [0], [np.inf], [0], [0], [0.0], [0]
    return Trees(*(np.array(a) for a in (feature, cut, left, right, value, roots)), depth=depth, prior=prior)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", rows_per_class: int = SAMPLE_PER_CLASS) -> Trees:
    """Trees fitted on a bounded sample of labelled documents; the driver gets FEATURES numbers for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.stack([statistics(t) for t in batch.column(1).to_pylist()]) if len(batch) else np.zeros((0, FEATURES), np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), FEATURES).cast(pa.list_(pa.float32())), batch.column(2)], ["key", "x", "label"])

    sample = labelled_sample(docs, labels, label, rows_per_class, id_col, text_col, label_id)
    key = sample.schema["key"].dataType.simpleString()
    got = sample.mapInArrow(run, f"key {key}, x array<float>, label int").orderBy("key", "label").toArrow()
    if not got.num_rows:
        return train(np.zeros((0, FEATURES)), np.zeros(0))
    x = got.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
    return train(x, got.column("label").to_numpy().astype(np.float64))


def with_score(docs: DataFrame, model: Trees, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Add the model's score of each whole text; all other columns stay. Null texts count as empty."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [statistics(t) for t in batch.to_pylist()]
            yield pa.array(held.value.score(np.stack(rows)) if rows else np.zeros(0), pa.float64())

    return docs.withColumn(score_col, F.arrow_udf(score, "double")(F.col(text_col)))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", cut: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id") -> DataFrame:
    """Score every document: the id column, ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 if score >= cut).

    The trees learn from at most ``SAMPLE_PER_CLASS`` label rows of each class, none of them held out (crc32 of the id's text modulo 5 is 0). Null and
    empty texts get the score of an empty text. Null ids count as the id '' and so are never learned from. Repeated rows stay. Without
    labels, or with one class only, the score is the class's smoothed share. Other columns are left out. An empty table gives no rows.
    """
    model = fit(docs, labels, label, id_col, text_col, label_id)
    d = with_score(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), model, "__text", "score")
    return d.select(F.col("__id").alias(id_col), (remainder(F.col("__id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
