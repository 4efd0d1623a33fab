"""Vector codes, periodic runs and chat formatting against plain recomputation."""

import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscale.llm import chat_format, periodic_runs, queries, vector_codes
from folioscale.plans.session import ship


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_runs(words, least):
    """All stretches by comparing words ``period`` apart, smallest period first."""
    found, n = {}, len(words)
    for period in range(1, n // 2 + 1):
        at = 0
        while at + period < n:
            end = at
            while end + period < n and words[end] == words[end + period]:
                end += 1
            length = end + period - at
            if end > at and length >= max(least, 2 * period):
                found.setdefault((at, length), period)
            at = end + 1
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_against_comparing_words():
    draw, texts = random.Random(5), [[], [b"a"], [b"a"] * 50, [b"a", b"b"] * 9 + [b"a"]]
    for _ in range(600):
        n, letters = draw.randint(0, 70), draw.randint(1, 4)
        words = [bytes([97 + draw.randrange(letters)]) for _ in range(n)]
        if n > 4 and draw.random() < 0.5:
            a, p = draw.randrange(n // 2), draw.randint(1, n // 2)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        texts.append(words)
    older, newer = [b"a"], [b"a", b"b"]
    while len(newer) < 500:
        older, newer = newer, newer + older
    texts.append(newer)
    for least in (2, 5, 12):
        want = [plain_runs(t, least) for t in texts]
        assert periodic_runs.runs_of_texts(texts, least) == want
        assert [periodic_runs.runs_of_texts([t], least)[0] for t in texts] == want
    assert any(len(w) > 1 for w in want) and periodic_runs.runs_of_texts([], 12) == []


def test_leaves_in_several_groups(monkeypatch):
    words = [b"x"] * 300 + [b"y", b"z"] * 100 + [b"x"] * 200
    monkeypatch.setattr(periodic_runs, "GROUP_LEAVES", 50)
    assert periodic_runs.runs_of_texts([words, words], 12) == [plain_runs(words, 12)] * 2


def test_long_texts_of_one_word_and_of_two():
    assert periodic_runs.runs_of_texts([[b"a"] * 50_000, [b"a", b"b"] * 20_000 + [b"c"]], 12) == [[(0, 50_000, 1)], [(0, 40_000, 2)]]


def plain_op12(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words, 12)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{length},{p}\n" for s, length, p in runs)), sha(b" ".join(w for i, w in enumerate(words) if i not in gone).decode()))


def test_periodic_runs_query(spark, tmp_path):
    ship(spark)
    draw = random.Random(7)
    prose = lambda n, k: "".join(f"w{draw.randrange(k)}" + draw.choice([" ", "\n", "\t \x0b", "  "]) for _ in range(n))
    rows = [(i, prose(draw.randint(0, 120), draw.choice([2, 3, 40])), 0) for i in range(250)]
    rows += [(None, "a b c a b c a b c a b c a b c", 1), (None, None, 1), (3, None, 1), (3, "", 1), (4, " \n ", 1), (5, "é\u2003x " * 20, 1), (5, "é\u2003x " * 20, 1), (6, "q " * 30_000, 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, period int").withColumn("runs", F.lit("clash")).withColumn("start", F.lit(1))
    d.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    small = [r for r in rows if len(r[1] or "") < 50_000]
    found = [tuple(r) for r in got.collect()]
    assert sorted((r for r in found if r[0] != 6 or r[3] != 30_000), key=repr) == sorted((plain_op12(i, t) for i, t, _ in small), key=repr)
    long = next(r for r in found if r[3] == 30_000)
    assert long[:6] == (6, 1, 0, 30_000, 1, 30_000_000) and long[7] == sha("q")
    assert periodic_runs.find_runs(d.limit(0)).count() == 0
    spans = periodic_runs.find_runs(spark.createDataFrame([("k", "x y x y x")], "doc_id string, text string"), min_length=4).first()
    assert (spans.doc_id, spans.n_words, [tuple(r) for r in spans.runs], spans.collapsed) == ("k", 5, [(0, 5, 2)], "x y")


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """(vec_id, code, error) with whole Python numbers, one vector, part and entry after the other."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(-(-max(len(v) for _, v in kept) // parts), 1)
    kept = [(i, v + [0] * (parts * width - len(v))) for i, v in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[v[p * width : (p + 1) * width] for _, v in first] for p in range(parts)]

    def best(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(v[p * width : (p + 1) * width], c)), k) for k, c in enumerate(books[p]))

    for _ in range(rounds):
        held = [[[] for _ in first] for _ in range(parts)]
        for _, v in kept:
            for p in range(parts):
                held[p][best(v, p)[1]].append(v[p * width : (p + 1) * width])
        books = [[[sum(x) // len(members) for x in zip(*members)] if members else books[p][k] for k, members in enumerate(held[p])] for p in range(parts)]
    return [(i, "".join(f"{best(v, p)[1]:02x}" for p in range(parts)), sum(best(v, p)[0] for p in range(parts))) for i, v in kept], books


@pytest.mark.parametrize("entries, broadcast_labels", [(256, 100), (7, 0)])
def test_vector_codes(spark, monkeypatch, entries, broadcast_labels):
    ship(spark)
    monkeypatch.setattr(vector_codes.with_label_errors, "__defaults__", (broadcast_labels,))
    draw = np.random.default_rng(3)
    rows = [(int(i), [float(np.float32(x)) for x in draw.normal(0, 0.3, 10)], int(i) % 3) for i in range(150)]
    rows += [(2, rows[2][1], None), (2, [9.5, -3.25], 1), (None, rows[9][1], None), (151, None, 1), (152, [1.0, None], 1), (153, [float("nan")] * 10, 1), (154, [float("-inf")] * 10, 2), (155, [], 0), (156, [4e4] * 10, 0)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("id", F.lit("clash")).withColumn("code", F.lit(1)).repartition(5)
    coded, books = vector_codes.product_codes(d, entries=entries)
    want, plain_books = plain_codes(rows, entries=entries)
    got = coded.withColumn("code", vector_codes.hex_code(F.col("code"))).collect()
    assert sorted(((r.vec_id, r.code, r.error) for r in got), key=repr) == sorted(want, key=repr)
    assert books.transpose(0, 2, 1).tolist() == plain_books
    assert vector_codes.books_digest(books) == sha(",".join(str(x) for part in plain_books for entry in part for x in entry))
    sums = {}
    for r in got:
        sums[r.label] = sums.get(r.label, 0) + r.error
    assert all(r.label_error == sums[r.label] for r in got)
    assert vector_codes.product_codes(d.limit(0))[0].count() == 0


def test_vector_codes_of_components_beyond_64_bits(spark):
    ship(spark)
    d = spark.createDataFrame([(k, [s * 3e38, 1.0, 0.0, 0.0], None) for k, s in enumerate((1, -1, 1))], "vec_id long, embedding array<float>, label string")
    coded, books = vector_codes.product_codes(d, entries=1, rounds=0)
    assert sorted(r.error for r in coded.collect())[:2] == [0, 0] and 0 < max(r.error for r in coded.collect()) <= 1 << 62


def test_nearest_in_32_and_64_bits():
    draw = np.random.default_rng(1)
    for scale in (1000, 1 << 20):
        block, books = draw.integers(-scale, scale, (2, 3, 1100)), draw.integers(-scale, scale, (2, 3, 9))
        distance = ((block[:, :, :, None] - books[:, :, None, :]) ** 2).sum(1)
        index, error = vector_codes.nearest(block, books)
        assert (index == distance.argmin(2)).all() and (error == distance.min(2)).all()


def chats(spark):
    hard = ["", " ", "\\", "\\\\", "<s>", "</s>", "\\</s>", "[INST] x [/INST]", " [+] ", "\\ [OUT] \\", "[AS] user [TEXT] y [/AS]", "<s", "[/INST", "é\n[SYS]\n", "\\\\[/SYS]", None]
    rows = [(k % 5, turn, role, text) for k, text in enumerate(hard) for turn, role in enumerate(("system", "user", "assistant", "assistant", "tool", "[AS] user [TEXT]", None))]
    rows += [(9, 3, "user", "late"), (9, None, "user", "null turn first"), (9, 3, "assistant", "same turn"), (9, 3, "assistant", "same turn"), (None, 0, "user", "no id"), (10, 0, "assistant", None)]
    rows += [(11, k, ("user", "assistant")[k % 2], "word " * 20) for k in range(3000)]
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_chat_format(spark, tmp_path):
    rows, d = chats(spark)
    d.withColumn("segments", F.lit(1)).withColumn("t", F.lit(2)).repartition(7).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in queries.op13_chat_format(spark, str(tmp_path)).collect()}
    rows = rows + [(-7, k, r, "</s>[INST] ok [/INST]") for k, r in enumerate(("user", "assistant"))]
    for key in {r[0] for r in rows}:
        turns = [(r or "", t or "") for _, _, r, t in sorted((x for x in rows if x[0] == key), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert tuple(got[key])[1:5] == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss)), key
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    con.execute("set timezone = 'UTC'")
    rel = con.execute(queries.SQL["op13_chat_format"])
    names = [c[0] for c in rel.description]
    assert {(dict(zip(names, r)))["conv_id"]: dict(zip(names, r)) for r in rel.fetchall()} == {k: r.asDict() for k, r in got.items()}
    assert chat_format.format_chats(d.limit(0)).count() == 0


def test_chat_format_blocks_and_loss(spark):
    d = spark.createDataFrame([("c", 0, "user", "a"), ("c", 1, "user", "b [+]"), ("c", 2, "assistant", "x</s>"), ("c", 3, "bot", "y")], "conv_id string, turn int, role string, text string")
    r = chat_format.format_chats(d).first()
    assert r.formatted == "<s> [INST] a [+] b \\[+] [/INST] [OUT] x\\</s> </s> [AS] bot [TEXT] y [/AS]"
    assert "".join(s.text for s in r.segments) == r.formatted and [s.text for s in r.segments if s.loss] == ["x\\</s>"]
