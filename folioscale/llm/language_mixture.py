"""Language identification as a mixture: expectation-maximisation finds the share of each language in a document.

A language is a distribution over hashed letter trigrams. A document's trigrams are explained as a mixture of languages; the set of
languages is the one with the best likelihood after a penalty for each language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscale.llm.labels import remainder

#: Hashed trigrams; a model has BUCKETS numbers for each language, however large the corpus.
BUCKETS = 1 << 14
SMOOTHING = 0.5
#: Steps of expectation-maximisation at most, and the change of the shares that ends it.
STEPS, CHANGE = 12, 2e-3
#: What a further language has to gain in log-likelihood, times the log of the number of trigrams.
PENALTY = 2.0
#: Characters that are read at once. Longer texts are read in overlapping parts whose counts add up.
PART = 1 << 20

_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTERS[0]


def trigram_counts(text: str | None) -> np.ndarray:
    """Numbers of the hashed trigrams around each letter of a whole text, in lower case; whatever is not a letter counts as an edge."""
    out = np.zeros(BUCKETS, dtype=np.int64)
    text = text or ""
    for i in range(0, len(text), PART):
        # one character more on either side belongs to the neighbouring trigrams
        before, after = text[i - 1 : i].lower()[-1:] if i else "", text[i + PART : i + PART + 1].lower()[:1]
        points = np.frombuffer((before.rjust(1) + text[i : i + PART].lower() + after.rjust(1)).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        points = np.where(letters()[points], points, 0)
        middle = points[1:-1]
        code = (points[:-2] * 0x9E3779B1 + middle * 0x85EBCA77 + points[2:] * 0xC2B2AE3D) & 0xFFFFFFFF
        code = ((code ^ (code >> 15)) * 0x2C1B3C6D & 0xFFFFFFFF) >> (32 - 14)
        out += np.bincount(code[middle > 0], minlength=BUCKETS)
    return out


@dataclass
class Languages:
    """Names in order, and log-probabilities of the buckets, one column for each language."""

    names: list[str]
    log_p: np.ndarray


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Languages:
    """Count the trigrams of all rows that have a text and a language. The driver gets at most BUCKETS numbers for each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[lang] = sums.get(lang, 0) + trigram_counts(text)
        for lang, n in sums.items():
            found = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found, pa.int32()), pa.array(n[found], pa.int64())], ["lang", "bucket", "n"])

    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    got = rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(got.column("lang").to_pylist()))
    counts = np.zeros((BUCKETS, len(names)))
    place = {x: i for i, x in enumerate(names)}
    counts[got.column("bucket").to_numpy(), [place[x] for x in got.column("lang").to_pylist()]] = got.column("n").to_numpy()
    return Languages(names, np.log((counts + SMOOTHING) / (counts.sum(0) + SMOOTHING * BUCKETS)))


def shares(weights: np.ndarray, n: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float]:
    """Expectation-maximisation for one document: mixture shares, and the log-likelihood less that of ``weights`` of 1."""
    total, p = n.sum(), start
    for _ in range(STEPS):
        mixed = weights @ p
        new = p * ((n / mixed) @ weights) / total
        done = np.abs(new - p).max() < CHANGE
        p = new
        if done:
            break
    return p, float(n @ np.log(weights @ p))


def infer(model: Languages, counts: np.ndarray) -> np.ndarray:
    """The share of each language in a document; 0 for those outside the chosen set."""
    found = np.flatnonzero(counts)
    n = counts[found].astype(np.float64)
    log_p = model.log_p[found]
    weights = np.exp(log_p - log_p.max(1, keepdims=True))
    k = len(model.names)
    alone = n @ np.log(weights)
    best, fit_ = np.zeros(k), -np.inf
    if k == 1:
        return np.ones(1)
    full, _ = shares(weights, n, np.full(k, 1 / k))
    order = np.argsort(-full, kind="stable")
    order = np.concatenate([[alone.argmax()], order[order != alone.argmax()]])
    charge = PENALTY * np.log(n.sum() + 1)
    for size in range(1, k + 1):
        chosen = order[:size]
        if size == 1:
            p, likelihood = np.ones(1), float(alone[chosen[0]])
        else:
            start = np.maximum(full[chosen], 0.05)
            p, likelihood = shares(weights[:, chosen], n, start / start.sum())
        if likelihood - charge * (size - 1) <= fit_:
            break
        fit_ = likelihood - charge * (size - 1)
        best = np.zeros(k)
        best[chosen] = p
    return best


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, held_out: int = 1) -> DataFrame:
    """The id column, ``held_out``, ``lang_pred``, ``score`` (the predicted language's share) and ``languages`` (map of the chosen set to shares).

    Languages are learned from all rows with a text and a language whose crc32 of the id's text modulo ``folds`` is not ``held_out``; null ids count
    as the id ''. Predictions use the text only, the whole of it. ``lang_pred`` is ``und`` and the score 0 if the text is null, has no letters, or nothing
    could be learned. Equal shares go to the first name in order. Repeated rows stay; other columns are left out. An empty table gives no rows.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), (remainder(F.col(id_col), folds) == held_out).alias("held_out"))
    model = fit(source.where(~F.col("held_out")))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            names, scores, sets = [], [], []
            for text in batch.column(2).to_pylist():
                counts = trigram_counts(text)
                if not m.names or not counts.any():
                    names.append("und"), scores.append(0.0), sets.append([])
                    continue
                p = infer(m, counts)
                names.append(m.names[int(p.argmax())]), scores.append(min(1.0, float(p.max())))
                sets.append([(m.names[i], float(p[i])) for i in np.flatnonzero(p)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, pa.map_(pa.string(), pa.float64()))], ["id", "held_out", "lang_pred", "score", "languages"])

    out = source.select("id", "held_out", "text").mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, languages map<string,double>")
    return out.withColumnRenamed("id", id_col)
