"""URL filter: explicit host and path rules first, a character language-model ratio for all other URLs.

Two variable-order Markov models, of accepted and of rejected URLs, give each character a probability from the longest context that was
seen, blended with shorter ones by Witten-Bell weights. A URL's score is the mean difference of its characters' log-likelihoods; a
threshold calibrated on URLs that the models haven't seen turns it into a verdict.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The alphabet of the models. Digits count as 0, upper-case letters as lower-case, all else as one other symbol.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0-._~/?#&=%:+@"
SIZE = len(ALPHABET) + 2  # another symbol, and the end of a URL (which also stands before its start)
OTHER, EDGE = SIZE - 2, SIZE - 1
#: Characters of context at most. The counts of a model have at most SIZE ** (ORDER + 1) numbers, whatever the input: 3.1 million.
ORDER = 3
#: Bins of the score histograms that calibrate the threshold, over scores from -LIMIT to LIMIT.
BINS, LIMIT = 4_000, 8.0
#: Of URLs with a rule's verdict, one in so many calibrates the threshold and is not counted by the models.
CALIBRATION = 5

_CODE = np.full(256, OTHER, dtype=np.int64)
for _i, _c in enumerate(ALPHABET):
    _CODE[ord(_c)] = _CODE[ord(_c.upper())] = _i
_CODE[ord("0") : ord("9") + 1] = ALPHABET.index("0")


@dataclass(frozen=True)
class UrlRule:
    """A host suffix and a path prefix, such as ``example.com/en/``; it fits the host, its subdomains and the paths that start so."""

    host: str
    path: str
    verdict: str

    @staticmethod
    def parse(text: str, verdict: str) -> "UrlRule":
        host, slash, path = text.partition("/")
        return UrlRule(host.lower(), slash + path, verdict)

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | F.endswith(host, F.lit(f".{self.host}"))) & F.startswith(path, F.lit(self.path))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; empty without ``://`` or for null."""
    rest = F.substring_index(F.substring_index(F.substring_index(after_scheme(url), "/", 1), "?", 1), "#", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    rest = F.substring_index(F.substring_index(after_scheme(url), "?", 1), "#", 1)
    return F.when(F.instr(rest, "/") > 0, F.substr(rest, F.instr(rest, "/"))).otherwise("")


def after_scheme(url: Column) -> Column:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def with_rules(pages: DataFrame, rules: list[UrlRule], url_col: str) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` (the longest that fits, as text; the first in the list among equally long ones) and ``rule_verdict``."""
    d = pages.withColumn("host", host_of(F.col(url_col))).withColumn("path", path_of(F.col(url_col)))
    longest = sorted(rules, key=lambda r: -len(r.text))
    first = F.coalesce(*(F.when(r.fits(F.col("host"), F.col("path")), F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))) for r in longest), F.lit(None).cast("struct<rule:string,verdict:string>"))
    return d.withColumn("__rule", first).withColumn("rule", F.col("__rule.rule")).withColumn("rule_verdict", F.col("__rule.verdict")).drop("__rule")


def gram_codes(urls: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all (ORDER + 1)-grams of the URLs, each padded by ORDER edges before and one after, and each URL's number of grams."""
    raw = [u.encode() for u in urls.to_pylist()]
    lengths = np.array([len(u) for u in raw], dtype=np.int64) + 1
    total = int(lengths.sum()) + ORDER * len(raw)
    symbols = np.full(total, EDGE, dtype=np.int64)
    starts = np.cumsum(lengths + ORDER) - lengths
    body = np.repeat(starts - np.cumsum(lengths - 1) + (lengths - 1), lengths - 1) + np.arange(total - (ORDER + 1) * len(raw))
    symbols[body] = _CODE[np.frombuffer(b"".join(raw), dtype=np.uint8)]
    codes = np.zeros(max(0, total - ORDER), dtype=np.int64)
    for k in range(ORDER + 1):
        codes = codes * SIZE + symbols[k : k + len(codes)]
    at = np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum())) - ORDER
    return codes[at], lengths


def count_grams(urls: DataFrame) -> DataFrame:
    """``accepted`` (boolean) and ``url`` to the numbers of each gram by class: ``accepted, code, n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(SIZE ** (ORDER + 1), dtype=np.int64) for _ in range(2)]
        for batch in batches:
            good = np.array(batch.column(0).to_pylist(), dtype=bool)
            codes, lengths = gram_codes(batch.column(1))
            of_good = np.repeat(good, lengths)
            for k in range(2):
                found, n = np.unique(codes[of_good == bool(k)], return_counts=True)
                sums[k][found] += n
        for k in range(2):
            found = np.flatnonzero(sums[k])
            for i in range(0, len(found), 50_000):
                part = found[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), bool(k))), pa.array(part), pa.array(sums[k][part])], ["accepted", "code", "n"])

    counted = urls.select("accepted", "url").mapInArrow(run, "accepted boolean, code long, n long")
    return counted.groupBy("accepted", "code").agg(F.sum("n").alias("n"))


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """log P(symbol | context) for every gram, from the gram counts of one model."""
    shape = (SIZE,) * (ORDER + 1)
    full = counts.reshape(shape).astype(np.float64)
    below = np.full(SIZE, 1.0 / SIZE)
    for order in range(ORDER + 1):
        n = full.sum(axis=tuple(range(ORDER - order))) if order < ORDER else full  # the last `order` symbols of context, and the next
        total = n.sum(-1, keepdims=True)
        kinds = (n > 0).sum(-1, keepdims=True)
        # Witten-Bell: the share of the shorter context is the number of kinds seen after this one; unseen contexts leave it all.
        below = (n + np.where(total > 0, kinds, 1) * below) / np.where(total > 0, total + kinds, 1)
    return np.log(below).ravel()


@dataclass
class UrlModel:
    """``difference`` is log P(accepted) - log P(rejected) for each gram; a URL with a mean of at least ``threshold`` is accepted."""

    difference: np.ndarray
    threshold: float


def score_urls(urls: DataFrame, difference: np.ndarray) -> DataFrame:
    """Add ``lm_score``: the mean log-likelihood difference per character of ``url``; null urls count as empty."""
    held = urls.sparkSession.sparkContext.broadcast(difference.astype(np.float32))

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            codes, lengths = gram_codes(batch)
            sums = np.add.reduceat(held.value[codes].astype(np.float64), np.cumsum(lengths) - lengths) if len(lengths) else np.zeros(0)
            yield pa.array(sums / lengths)

    udf = F.arrow_udf(score, "double")
    return urls.withColumn("lm_score", udf(F.coalesce(F.col("url"), F.lit(""))))


def calibrated_threshold(accepted: np.ndarray, rejected: np.ndarray) -> float:
    """The lower edge of the bin that best parts two histograms (by the mean of both classes' shares), nearest to 0 among equals; 0 without both classes."""
    if not accepted.sum() or not rejected.sum():
        return 0.0
    edges = np.linspace(-LIMIT, LIMIT, BINS + 1)[:-1]
    right = accepted[::-1].cumsum()[::-1] / accepted.sum() + (rejected.cumsum() - rejected) / rejected.sum()
    best = np.flatnonzero(right >= right.max() - 1e-12)
    return float(edges[best[np.argmin(np.abs(edges[best]))]])


def fit(labelled: DataFrame) -> UrlModel:
    """Fit on ``key``, ``url`` and ``accepted``. All rows are counted: by their key's crc32, one in CALIBRATION calibrates, the others teach."""
    held = F.crc32(F.coalesce(F.col("key").cast("string"), F.lit(""))) % CALIBRATION == 0
    counts = [np.zeros(SIZE ** (ORDER + 1), dtype=np.int64) for _ in range(2)]
    for r in count_grams(labelled.where(~held)).toArrow().to_batches():
        good = np.array(r.column(0).to_pylist(), dtype=bool)
        for k in range(2):
            counts[k][r.column(1).to_numpy()[good == bool(k)]] = r.column(2).to_numpy()[good == bool(k)]
    difference = log_probabilities(counts[1]) - log_probabilities(counts[0])
    bins = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("lm_score") + LIMIT) * (BINS / (2 * LIMIT)))))
    shares = [np.zeros(BINS) for _ in range(2)]
    for r in score_urls(labelled.where(held), difference).groupBy("accepted", bins.cast("int").alias("bin")).count().collect():
        shares[int(r["accepted"])][r["bin"]] = r["count"]
    return UrlModel(difference, calibrated_threshold(shares[1], shares[0]))


def judge_urls(pages: DataFrame, rules: list[UrlRule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Judge every URL: ``host``, ``path``, ``rule``, ``verdict`` (allow or block) and ``lm_score``, next to the id column.

    A rule's verdict holds where one fits. Those verdicts are also the examples that the models learn from: all URLs with a rule are
    counted, and each URL without one is judged by its score. Null urls and urls without ``://`` have an empty host and path; null urls
    are scored as empty. Without examples of both kinds the threshold is 0, and a score of at least the threshold is allowed. Null ids and repeated
    rows are kept and counted as they are; other columns are left out. Empty tables give empty results.

    The driver and the broadcasts hold dense tables of SIZE ** (ORDER + 1) numbers, however large the input.
    """
    d = with_rules(pages.select(F.col(id_col).alias("key"), F.col(url_col).alias("url")), rules, "url")
    labelled = d.where(F.col("rule_verdict").isNotNull()).select("key", "url", (F.col("rule_verdict") == "allow").alias("accepted"))
    model = fit(labelled)
    by_method = F.when(F.col("lm_score") >= model.threshold, "allow").otherwise("block")
    return score_urls(d, model.difference).select(F.col("key").alias(id_col), "host", "path", "rule", F.coalesce("rule_verdict", by_method).alias("verdict"), "lm_score")
