"""Toxicity: a bidirectional gated recurrent network with attention pooling, over a word input and a character input, trained in numpy.

A text is read as overlapping windows of words, all of which are scored; its score is that of its worst window. The labels are of
documents, so training picks windows by itself, in rounds: first by the log-odds of their words, then by the network of the round before. The texts of the
sample stay on the executors, which score all their windows in every round; the driver gets the at most five windows of each text that the round trains on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscale.llm.labels import labelled_sample, remainder
from folioscale.plans.session import written

#: The training sample: label rows of each class at most.
SAMPLE_PER_CLASS = 2_000
#: Log-odds are kept for 2^ODDS_BITS hashes of word parts; parts that share a hash are counted together.
ODDS_BITS = 22
#: Words of a window, and from one window's start to the next: neighbours share WINDOW - STEP words.
WINDOW, STEP = 32, 24
WORD_ROWS, GRAM_BITS, WIDTH, HIDDEN, ATTENTION = 1 << 14, 13, 8, 8, 4
GRAM_ROWS = 1 << GRAM_BITS
#: Bytes of a word's beginning that are character inputs besides its trigrams.
PREFIXES = (4, 5, 6, 7)
#: Distinct words that a Python worker remembers.
REMEMBERED = 200_000
#: Windows that the network reads at once.
AT_ONCE = 2_048
#: Rounds of picking windows; each passes over them as often as it takes to come to LEAST_STEPS batches in all.
ROUNDS, LEAST_STEPS, BATCH, RATE, DECAY = 8, 500, 128, 0.01, 0.03

_CLEAN = bytes(b + 32 if 65 <= b <= 90 else (b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32) for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of ASCII letters, digits and all non-ASCII characters, with A-Z lower-cased."""
    return (text or "").encode().translate(_CLEAN).split()


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (np.tanh(np.float32(0.5) * x) + np.float32(1))


def word_rows(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) % WORD_ROWS for w in words), dtype=np.int64, count=len(words))


def gram_rows(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The rows of the words' character inputs, and where each word's begin: its byte trigrams between edge marks and its PREFIXES."""
    widest = max(PREFIXES)
    raw = np.frombuffer(b"".join(b"\x01" + w + b"\x02" * widest for w in words), dtype=np.uint8).astype(np.uint64)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    starts = np.cumsum(lengths + 1 + widest) - (lengths + 1 + widest)
    counts = lengths + len(PREFIXES)
    begins = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), dtype=np.uint64)
    at = np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))
    to = np.repeat(begins - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))
    out[to] = (raw[at] << np.uint64(16)) | (raw[at + 1] << np.uint64(8)) | raw[at + 2]
    code = np.zeros(len(words), dtype=np.uint64)
    for k in range(1, widest + 1):
        code = (code + raw[starts + k] + np.uint64(k << 32)) * np.uint64(0x9E3779B97F4A7C15)
        if k in PREFIXES:
            out[begins + lengths + PREFIXES.index(k)] = code
    return ((out * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - GRAM_BITS)).astype(np.int64), begins


def window_starts(n: int) -> np.ndarray:
    """Starts of all windows of a text of n words; the last one reaches the end. A text without words has one empty window."""
    return np.arange(0, max(1, n - (WINDOW - STEP)), STEP)


@dataclass
class Network:
    """Parameters by name. ``wf, wb`` project an input to the gates of either direction, ``uf, ub`` the state before."""

    p: dict[str, np.ndarray]

    @staticmethod
    def fresh(seed: int = 7) -> "Network":
        r = np.random.default_rng(seed)
        shape = {"words": (WORD_ROWS, WIDTH), "grams": (GRAM_ROWS, WIDTH), "wf": (2 * WIDTH, 3 * HIDDEN), "wb": (2 * WIDTH, 3 * HIDDEN), "bf": (3 * HIDDEN,), "bb": (3 * HIDDEN,), "uf": (HIDDEN, 3 * HIDDEN), "ub": (HIDDEN, 3 * HIDDEN), "a": (2 * HIDDEN, ATTENTION), "v": (ATTENTION,), "o": (2 * HIDDEN,), "c": (1,)}
        scale = {"words": 0.1, "grams": 0.3, "bf": 0, "bb": 0, "c": 0}
        return Network({k: (r.normal(size=s) * scale.get(k, 0.35)).astype(np.float32) for k, s in shape.items()})

    def inputs(self, rows: np.ndarray, grams: np.ndarray, starts: np.ndarray, keep_words: np.ndarray | None = None) -> np.ndarray:
        """Word and mean trigram vectors, side by side."""
        counts = np.diff(np.append(starts, len(grams)))
        word = self.p["words"][rows]
        if keep_words is not None:
            word = word * keep_words[:, None]
        chars = np.add.reduceat(self.p["grams"][grams], starts) / counts[:, None].astype(np.float32) if len(rows) else np.zeros((0, WIDTH), np.float32)
        return np.concatenate([word, chars], 1)

    def direction(self, gates: np.ndarray, mask: np.ndarray, u: np.ndarray, order: range, kept: list | None = None) -> np.ndarray:
        """States (T, B, HIDDEN) of one direction, from the input's share of the gates (T, B, 3 HIDDEN)."""
        h = np.zeros((gates.shape[1], HIDDEN), np.float32)
        out = np.empty((gates.shape[0], gates.shape[1], HIDDEN), np.float32)
        for t in order:
            s = h @ u
            g = sigmoid(gates[t, :, : 2 * HIDDEN] + s[:, : 2 * HIDDEN])
            z, r, c = g[:, :HIDDEN], g[:, HIDDEN:], s[:, 2 * HIDDEN :]
            n = np.tanh(gates[t, :, 2 * HIDDEN :] + r * c)
            if kept is not None:
                kept.append((t, h, z, r, c, n))
            h = h + mask[t] * (1 - z) * (n - h)
            out[t] = h
        return out

    def pool(self, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Attention over a window's words: weights, pooled states, hidden layer."""
        q = np.tanh(states @ self.p["a"])
        e = np.where(mask[:, :, 0] > 0, q @ self.p["v"], -30)
        w = np.exp(e - e.max(0)) * mask[:, :, 0]
        w = w / np.maximum(w.sum(0), 1e-9)
        return w, np.einsum("tb,tbh->bh", w, states), q

    def logits(self, gates_f: np.ndarray, gates_b: np.ndarray, mask: np.ndarray) -> np.ndarray:
        steps = gates_f.shape[0]
        states = np.concatenate([self.direction(gates_f, mask, self.p["uf"], range(steps)), self.direction(gates_b, mask, self.p["ub"], range(steps - 1, -1, -1))], 2)
        return self.pool(states, mask)[1] @ self.p["o"] + self.p["c"]

    def gradients(self, index: np.ndarray, mask: np.ndarray, y: np.ndarray, rows: np.ndarray, grams: np.ndarray, starts: np.ndarray, keep_words: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean logistic loss of windows and its gradients. ``index`` (T, B) points into the batch's distinct words; y is 0 or 1."""
        p, steps = self.p, index.shape[0]
        x = self.inputs(rows, grams, starts, keep_words)
        kept: dict[str, list] = {"f": [], "b": []}
        gates = {k: (x @ p["w" + k] + p["b" + k])[index] for k in "fb"}
        states = np.concatenate([self.direction(gates["f"], mask, p["uf"], range(steps), kept["f"]), self.direction(gates["b"], mask, p["ub"], range(steps - 1, -1, -1), kept["b"])], 2)
        w, pooled, q = self.pool(states, mask)
        logit = pooled @ p["o"] + p["c"]
        prob = sigmoid(logit)
        loss = float(np.mean(np.logaddexp(0, logit) - y * logit))
        d = ((prob - y) / len(y)).astype(np.float32)
        grad = {"o": pooled.T @ d, "c": d.sum(keepdims=True)}
        d_pooled = d[:, None] * p["o"]
        d_states = w[:, :, None] * d_pooled
        d_w = np.einsum("bh,tbh->tb", d_pooled, states)
        d_e = w * (d_w - (w * d_w).sum(0))
        grad["v"] = np.einsum("tb,tba->a", d_e, q)
        d_q = d_e[:, :, None] * p["v"] * (1 - q * q)
        grad["a"] = np.einsum("tbh,tba->ha", states, d_q)
        d_states = d_states + d_q @ p["a"].T
        d_x = np.zeros_like(x)
        for k, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
            u, d_u, d_gates = p["u" + k], np.zeros_like(p["u" + k]), np.zeros_like(gates[k])
            d_h = np.zeros((index.shape[1], HIDDEN), np.float32)
            for t, h, z, r, c, n in reversed(kept[k]):
                d_h = d_h + d_states[t][:, part]
                d_new = d_h * mask[t]
                d_n = d_new * (1 - z) * (1 - n * n)
                d_z = d_new * (h - n) * z * (1 - z)
                d_r = d_n * c * r * (1 - r)
                d_gates[t] = np.concatenate([d_z, d_r, d_n], 1)
                d_s = np.concatenate([d_z, d_r, d_n * r], 1)
                d_u += h.T @ d_s
                d_h = d_h * (1 - mask[t]) + d_new * z + d_s @ u.T
            per_word = np.zeros((len(rows), 3 * HIDDEN), np.float32)
            np.add.at(per_word, index.ravel(), (d_gates * mask).reshape(-1, 3 * HIDDEN))
            grad["u" + k], grad["w" + k], grad["b" + k] = d_u, x.T @ per_word, per_word.sum(0)
            d_x += per_word @ p["w" + k].T
        grad["words"], grad["grams"] = np.zeros_like(p["words"]), np.zeros_like(p["grams"])
        np.add.at(grad["words"], rows, d_x[:, :WIDTH] * keep_words[:, None])
        counts = np.diff(np.append(starts, len(grams)))
        np.add.at(grad["grams"], grams, np.repeat(d_x[:, WIDTH:] / counts[:, None].astype(np.float32), counts, axis=0))
        return loss, grad


class Reader:
    """Scores texts with a network; each distinct word's share of the gates is computed once and remembered."""

    def __init__(self, network: Network):
        self.network = network
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.gates = np.zeros((1024, 6 * HIDDEN), np.float32)  # row 0 stands for a place without a word
        self.used = 1

    def learn(self, words: set[bytes]) -> None:
        new = sorted(words - self.known.keys())
        if len(self.known) + len(new) > REMEMBERED:
            self.forget()
            new = sorted(words)
        for i in range(0, len(new), 50_000):
            part = new[i : i + 50_000]
            p = self.network.p
            x = self.network.inputs(word_rows(part), *gram_rows(part))
            need = self.used + len(part)
            if need > len(self.gates):
                self.gates = np.concatenate([self.gates, np.zeros((max(need, 2 * len(self.gates)) - len(self.gates), 6 * HIDDEN), np.float32)])
            self.gates[self.used : need] = np.concatenate([x @ p["wf"] + p["bf"], x @ p["wb"] + p["bb"]], 1)
            self.known.update(zip(part, range(self.used, need)))
            self.used = need

    def window_logits(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """The logits of all windows of the texts, and where each text's begin."""
        self.learn(set().union(*texts))
        lengths = [len(t) for t in texts]
        flat = np.concatenate([np.fromiter(map(self.known.__getitem__, t), dtype=np.int64, count=len(t)) for t in texts] + [np.zeros(WINDOW, np.int64)])
        begins = np.cumsum([0, *lengths[:-1]])
        starts = [window_starts(n) for n in lengths]
        at = np.concatenate([b + s for b, s in zip(begins, starts)])
        left = np.concatenate([n - s for n, s in zip(lengths, starts)])
        logits = np.empty(len(at), np.float32)
        place = np.arange(WINDOW)
        for i in range(0, len(at), AT_ONCE):
            inside = place[:, None] < left[None, i : i + AT_ONCE]
            index = np.where(inside, flat[np.minimum(at[None, i : i + AT_ONCE] + place[:, None], len(flat) - 1)], 0)
            g = self.gates[index]
            logits[i : i + AT_ONCE] = self.network.logits(g[:, :, : 3 * HIDDEN], g[:, :, 3 * HIDDEN :], inside[:, :, None].astype(np.float32))
        return logits, np.cumsum([0, *(len(s) for s in starts[:-1])])

    def scores(self, texts: list[str | None], most: int = 100_000) -> np.ndarray:
        """The score of each text: the sigmoid of its worst window's logit. About ``most`` words are read at once."""
        out: list[np.ndarray] = []
        waiting, size = [], 0
        for i, text in enumerate(texts):
            waiting.append(words_of(text))
            size += len(waiting[-1])
            if size >= most or i == len(texts) - 1:
                logits, begins = self.window_logits(waiting)
                out.append(sigmoid(np.maximum.reduceat(logits, begins)))
                waiting, size = [], 0
        return np.concatenate(out).astype(np.float64) if out else np.zeros(0)


def part_slots(word: bytes) -> list[int]:
    """The hashes of a word and of its beginnings."""
    return [xxhash.xxh3_64_intdigest(x) >> (64 - ODDS_BITS) for x in (word, *(word[:k] + b"*" for k in PREFIXES if k < len(word)))]


def count_parts(texts: Iterable[list[bytes]], y: Iterable[float]) -> dict[int, list[int]]:
    """In how many other and toxic texts each hash of a word, or of a beginning of a word, occurs."""
    counts: dict[int, list[int]] = {}
    for words, label in zip(texts, y):
        for slot in {x for w in set(words) for x in part_slots(w)}:
            counts.setdefault(slot, [0, 0])[int(label)] += 1
    return counts


def odds_of(counts: Iterable[tuple[int, int, int]], n_other: int, n_toxic: int) -> np.ndarray:
    """Log-odds, where positive, of all hashes from ``(hash, other texts, toxic texts)``: by the share of texts of either label in which they occur."""
    out = np.zeros(1 << ODDS_BITS, dtype=np.float32)
    for slot, other, toxic in counts:
        if toxic >= 3:
            out[slot] = max(0.0, np.log((toxic + 0.1) / (n_toxic + 2)) - np.log((other + 0.5) / (n_other + 2)))
    return out


def scores_by_odds(words: list[bytes], odds: np.ndarray) -> np.ndarray:
    """Of each window of a text, the sum of its words' log-odds."""
    of = {w: float(odds[part_slots(w)].max()) for w in set(words)}
    total = np.concatenate([[0], np.cumsum([of[w] for w in words])])
    s = window_starts(len(words))
    return total[np.minimum(s + WINDOW, len(words))] - total[s]


def scores_by_network(texts: list[list[bytes]], reader: Reader, most: int = 100_000) -> Iterator[np.ndarray]:
    """Of each text the logits of all its windows; about ``most`` words are read at once."""
    waiting, size = [], 0
    for i, words in enumerate(texts):
        waiting.append(words)
        size += len(words)
        if size >= most or i == len(texts) - 1:
            logits, begins = reader.window_logits(waiting)
            yield from np.split(logits, begins[1:])
            waiting, size = [], 0


def chosen_windows(s: np.ndarray, toxic: bool, r: np.random.Generator) -> list[int]:
    """Windows of a text to train on: of a toxic one its two worst if the second comes near the first, of another its four worst and one at random."""
    worst = np.argsort(-s, kind="stable")
    if toxic:
        return worst[: 2 if len(worst) > 1 and s[worst[1]] >= 0.6 * s[worst[0]] > 0 else 1].tolist()
    return [*worst[:4].tolist(), int(r.integers(len(s)))]


def picked_windows(texts: list[bytes], y: list[int], odds: np.ndarray, network: Network | None, number: int) -> Iterator[tuple[int, list[list[bytes]]]]:
    """For each text, as UTF-8, its hash and the windows to train on in a round, by a network or, where there is none yet, by log-odds. Equal texts pick alike."""
    words = [words_of(t.decode()) for t in texts]
    scores = scores_by_network(words, Reader(network)) if network else (scores_by_odds(w, odds) for w in words)
    for raw, ws, s, label in zip(texts, words, scores, y):
        own, starts = xxhash.xxh3_64_intdigest(raw), window_starts(len(ws))
        yield own, [ws[starts[k] : starts[k] + WINDOW] for k in chosen_windows(s, bool(label), np.random.default_rng((number, own)))]


#: Gives the windows of a round and their labels, by log-odds where there is no network yet.
Pick = Callable[[int, "Network | None"], list[tuple[list[bytes], int]]]


def train(texts: list[str], y: np.ndarray, rounds: int = ROUNDS, seed: int = 7) -> Network:
    """Train on texts and their labels, all in one process: what ``fit`` does on Spark."""
    words, n_toxic = [words_of(t) for t in texts], int(np.sum(y))
    odds = odds_of(((x, *n) for x, n in count_parts(words, y).items()), len(y) - n_toxic, n_toxic)

    def pick(number: int, network: Network | None) -> list[tuple[list[bytes], int]]:
        found = picked_windows([(t or "").encode() for t in texts], list(y), odds, network, number)
        return [(w, int(label)) for (_, windows), label in sorted(zip(found, y), key=lambda x: (x[0][0], x[1])) for w in windows]

    return train_rounds(pick, len(y) - n_toxic, n_toxic, rounds, seed)


def train_rounds(pick: Pick, n_other: int, n_toxic: int, rounds: int = ROUNDS, seed: int = 7) -> Network:
    """Train on the windows that each round picks. Without examples of both classes the network answers the smoothed share of label 1."""
    network = Network.fresh(seed)
    if not (n_other and n_toxic):
        network.p["o"][:] = 0
        network.p["c"][:] = np.log((n_toxic + 1) / (n_other + 1)) if n_other + n_toxic else -4
        return network
    r = np.random.default_rng(seed)
    network.p["c"][:] = -1
    m = {k: np.zeros_like(v) for k, v in network.p.items()}
    v2 = {k: np.zeros_like(v) for k, v in network.p.items()}
    step = 0
    for number in range(rounds):
        picks = pick(number, network if number >= max(3, rounds // 3) else None)
        passes = max(1, -(-LEAST_STEPS // (rounds * -(-len(picks) // BATCH))))
        for i, order in ((i, order) for order in (r.permutation(len(picks)) for _ in range(passes)) for i in range(0, len(picks), BATCH)):
            batch = [picks[k] for k in order[i : i + BATCH]]
            parts = [words for words, _ in batch] + [[]]  # and an empty window, which is not toxic
            labels = np.array([float(y) for _, y in batch] + [0.0], dtype=np.float32)
            distinct = sorted(set().union(*parts)) or [b"-"]
            at = {w: n for n, w in enumerate(distinct)}
            index = np.zeros((WINDOW, len(parts)), dtype=np.int64)
            mask = np.zeros((WINDOW, len(parts), 1), dtype=np.float32)
            for b, part in enumerate(parts):
                index[: len(part), b] = [at[w] for w in part]
                mask[: len(part), b] = 1
            keep = (r.random(len(distinct)) > 0.5).astype(np.float32)  # else the network leans on words and not on their characters
            _, grad = network.gradients(index, mask, labels, word_rows(distinct), *gram_rows(distinct), keep)
            step += 1
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            rate = RATE * (1 - 0.8 * number / rounds)
            for k, g in grad.items():
                g = g * min(1.0, 5.0 / (norm + 1e-9))
                m[k] += 0.1 * (g - m[k])
                v2[k] += 0.001 * (g * g - v2[k])
                network.p[k] *= 1 - DECAY * rate
                network.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-6)
    return network


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", rows_per_class: int = SAMPLE_PER_CLASS) -> Network:
    """A network trained on a sample of at most 2 * rows_per_class whole texts.

    The sample is written once and dealt to as many parts as a shuffle has; every round reads it. Broadcast are the log-odds of all hashes (16 MB) and the network (1 MB). The
    driver gets counts for at most 2^ODDS_BITS hashes, and in each round at most five windows of each text, of whole words.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sample = labelled_sample(docs, labels, label, rows_per_class, id_col, text_col, label_id)
    sample = written(sample.select(F.col("text").cast("binary").alias("text"), "label").repartition(parts), "sample")
    n = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = count_parts((words_of(t.decode()) for t in batch.column(0).to_pylist()), batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int32()), *(pa.array([x[k] for x in found.values()], pa.int64()) for k in (0, 1))], ["slot", "other", "toxic"])

    counts = sample.mapInArrow(count, "slot int, other long, toxic long").groupBy("slot").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic")).where("toxic >= 3").toArrow()
    odds = odds_of(zip(*(counts.column(c).to_pylist() for c in ("slot", "other", "toxic"))), n.get(0, 0), n.get(1, 0))
    held_odds = spark.sparkContext.broadcast(odds)

    def pick(number: int, network: Network | None) -> list[tuple[list[bytes], int]]:
        held = spark.sparkContext.broadcast(network.p) if network else None

        def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            by = Network(held.value) if held else None
            for batch in batches:
                found = list(picked_windows(batch.column(0).to_pylist(), batch.column(1).to_pylist(), held_odds.value, by, number))
                yield pa.RecordBatch.from_arrays([pa.array([own.to_bytes(8, "big") for own, _ in found], pa.binary()), batch.column(1), pa.array([[b" ".join(w) for w in x] for _, x in found], pa.list_(pa.binary()))], ["own", "label", "windows"])

        got = sample.mapInArrow(windows, "own binary, label int, windows array<binary>").toArrow().sort_by([("own", "ascending"), ("label", "ascending")])
        if held:
            held.unpersist()
        return [(w.split(), label) for x, label in zip(got.column("windows").to_pylist(), got.column("label").to_pylist()) for w in x]

    return train_rounds(pick, n.get(0, 0), n.get(1, 0))


def with_score(docs: DataFrame, network: Network, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Add the network's score of each whole text; all other columns stay. Null texts count as empty."""
    held = docs.sparkSession.sparkContext.broadcast(network.p)

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader = Reader(Network(held.value))
        for batch in batches:
            yield pa.array(reader.scores(batch.to_pylist()), pa.float64())

    return docs.withColumn(score_col, F.arrow_udf(score, "double")(F.col(text_col)))


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", cut: float = 0.5, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id") -> DataFrame:
    """Score every document: the id column, ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 if score >= cut).

    The network learns from at most ``SAMPLE_PER_CLASS`` label rows of each class, none of them held out (crc32 of the id's text modulo 5 is 0).
    All windows of a text are scored, whatever its length. Null and empty texts get the score of an empty window. Null ids count as the id '' and are never
    learned from. Repeated rows stay. Without labels, or with one class only, the score is a smoothed share. Other columns are left out. An empty table
    gives no rows.
    """
    network = fit(docs, labels, label, id_col, text_col, label_id)
    d = with_score(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), network, "__text", "score")
    return d.select(F.col("__id").alias(id_col), (remainder(F.col("__id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
