"""Operators on texts against libraries, brute force and hand-made cases: BPE, packing, quality rules, language, classifiers."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscale.llm import bpe, language_mixture, packing, quality_gbt, quality_rules, toxicity
from folioscale.plans.session import ship

MULTI, PLAIN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "Hello world, it's 2024!", "Hello world, it's 2024!", "äöü ßéè 漢字 🙂\n\n\tx  y ", "a" * 3000, "word " * 3000, " " * 700 + "x", "<|endoftext|> end"]


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    rows = [(i if i != 3 else None, t, "en", f"s{i}", "clash", 1, 2.0) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, id string, piece int, score double")


@pytest.fixture(scope="module")
def multi():
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(MULTI, "rb"))}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_table(docs, multi):
    got = sorted((r.n_tokens, r.ids, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_decode(docs, MULTI, public_tokenizers.PATTERN).collect())
    expected = []
    for t in TEXTS:
        ids = multi.encode_ordinary(t or "")
        expected.append((len(ids), ids, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(expected)
    assert bpe.encode_decode(docs.limit(0), MULTI, public_tokenizers.PATTERN).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_bpe_any_text(text):
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(MULTI, "rb"))} if not hasattr(test_bpe_any_text, "t") else None
    if ranks:
        test_bpe_any_text.t = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    c = bpe.codec(MULTI, public_tokenizers.PATTERN)
    [(ids, _)] = c.encode([text])
    assert ids.tolist() == test_bpe_any_text.t.encode_ordinary(text) and c.decode(ids) == text.encode()


def test_bpe_long_runs(multi):
    r = np.random.default_rng(9)
    c = bpe.codec(MULTI, public_tokenizers.PATTERN)
    texts = ["".join(r.choice(list(alphabet), n)) for alphabet in ("a", "ab", "acgt", "ering", "漢字仮名", "!?.", "01") for n in (2, 255, 256, 257, 1000, 20_000)] + [" " * 5000, "aab" * 3000]
    for text, (ids, _) in zip(texts, bpe.grouped_encode(c, texts)):
        assert ids.tolist() == multi.encode_ordinary(text) and c.decode(ids) == text.encode()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "e", "er", "in", "ing", "s", "t", "th", "é", "字"]), max_size=60))
def test_bpe_any_letters(multi, parts):
    c, text = bpe.codec(MULTI, public_tokenizers.PATTERN), "".join(parts)
    assert next(c.encode([text]))[0].tolist() == multi.encode_ordinary(text)


@settings(max_examples=150, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \t\n\r\x0b\x1c\x85\xa0\u2003\u3000ab.1'")), max_size=80))
def test_tokenizer_as_library(text):
    t = packing.tokenizer(PLAIN)
    assert t.by_chunk and next(t.ids([text])).tolist() == t.library.encode(text, add_special_tokens=False).ids


def test_tokenizer_on_every_code_point_and_long_runs():
    t = packing.tokenizer(PLAIN)
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"{c}a {c}" for c in chars[i : i + 4096]) for i in range(0, len(chars), 4096)]
    texts += [" " * 1_500_000, "\n " * 400_000 + "x", "a" * 300_000, " b" * 200_000, "a  <|endoftext|>  <|endoftext|>\n\n<|endoftext|> b"]
    for text, ids in zip(texts, t.ids(texts)):
        assert ids.tolist() == t.library.encode(text, add_special_tokens=False).ids


def test_tokenizer_asks_once_for_a_word_before_any_mark():
    t, asked = packing.Tokenizer(PLAIN), []
    ask = t.ask
    t.ask = lambda chunks: asked.extend(chunks) or ask(chunks)
    texts = ["".join(f" {word}{mark}" for mark in ("", ".", "###", "%%", "'s", "-", "7")) for word in ("tree", "éaaile", "ünger")]
    found = list(t.ids(texts))
    assert sorted(asked) == sorted([" tree", " éaaile", " ünger", ".", "###", "%%", "'s", "-", "7"])
    assert [x.tolist() for x in found] == [t.library.encode(text, add_special_tokens=False).ids for text in texts]


def test_tokenizer_on_white_space_and_added_tokens_in_groups(monkeypatch):
    pick = random.Random(4)
    parts = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", "\u2009", "\u3000", "a", "The", "é", "ß", "×", "÷", "ɏ", "ɐ", "д", "中", "½", "2", ".", ",", "'s", "'", "%%", "<|endoftext|>", "—", "😀", ""]
    texts = ["".join(pick.choices(parts, k=pick.randrange(25))) for _ in range(4000)]
    monkeypatch.setattr(packing, "GROUP_CHARS", 3_000)
    t = packing.Tokenizer(PLAIN)
    assert [x.tolist() for x in t.ids(texts)] == [x.ids for x in t.library.encode_batch_fast(texts, add_special_tokens=False)]


def test_tokenizer_of_another_kind(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = packing.tokenizer(path)
    assert not t.by_chunk and [x.tolist() for x in t.ids(["Some Words here", ""])] == [x.ids for x in t.library.encode_batch(["Some Words here", ""], add_special_tokens=False)]


def test_packing(docs):
    rows = packing.pack(docs, PLAIN, capacity=64).collect()
    library = tokenizers.Tokenizer.from_file(PLAIN)
    pieces = defaultdict(list)
    for r in rows:
        assert zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        pieces[r.doc_id].append(r)
    for i, t in enumerate(TEXTS):
        own = sorted(pieces[i if i != 3 else None], key=lambda r: r.piece)
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        assert [x for r in own for x in r.ids] == ids and [r.piece for r in own] == list(range(len(own)))
        assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]] and all(r.length == 64 for r in own[1:])
    check_sequences(rows, 64)
    assert packing.pack(docs.limit(0), PLAIN).count() == 0


def test_packing_beyond_the_broadcast(docs, monkeypatch):
    expected = sorted(((x.doc_id, x.piece, x.length, x.ids) for x in packing.pack(docs, PLAIN, capacity=64).collect()), key=repr)
    monkeypatch.setattr(packing, "BROADCAST_COUNTS", 0)
    rows = packing.pack(docs, PLAIN, capacity=64).collect()
    assert sorted(((x.doc_id, x.piece, x.length, x.ids) for x in rows), key=repr) == expected
    check_sequences(rows, 64)


def check_sequences(rows, capacity):
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


@pytest.mark.parametrize("seed", range(3))
def test_packing_plan_is_near_the_bound(seed):
    r = np.random.default_rng(seed)
    lengths = np.minimum(256, r.lognormal(3.5, 1.1, 20_000).astype(int) + 1)
    plan = packing.plan_patterns(Counter(lengths.tolist()), 256)
    used = Counter()
    for p, n in plan:
        assert sum(p) <= 256
        used.update({x: k * n for x, k in Counter(p).items()})
    assert used == Counter(lengths.tolist())
    assert sum(n for _, n in plan) <= max(-(-int(lengths.sum()) // 256), int((lengths > 128).sum())) * 1.002 + 1


def brute_quality(text):
    words = (text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ")
    words = [w for w in words if w]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\x0b\x0c\r")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside)


def test_quality_rules(spark):
    r = np.random.default_rng(1)
    texts = [None, "", " \n ", "a b c d e a b c d e", "the same line\nthe same line\n\n#", "ü " * 7, *(" ".join(r.choice(["the", "a|", "b\n", "c\t"], 60)) for _ in range(40))]
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, n_words string")
    for x in quality_rules.judge(d).collect():
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == brute_quality(texts[x.doc_id])
        assert x.base_failed == (x.n_words < 10 or 100 * x.n_repeat_words > 20 * x.n_words) and x.kept == (not x.base_failed and not x.failed_rules)
    assert quality_rules.judge(d.limit(0)).count() == 0
    plan = quality_rules.judge(d)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_language(spark):
    ship(spark)
    english, french = "the cat and the dog were in the house with another thing ", "le chat et le chien étaient dans la maison avec une chose "
    rows = [(i, (english if i % 2 else french) * (i % 5 + 1), "en" if i % 2 else "fr") for i in range(200)] + [(900, None, "en"), (901, "123 !!", "fr"), (None, english, None), (902, english * 3 + french, None), (902, english, "en")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_mixture.identify(d).collect()
    for x in got:
        if x.doc_id is not None and x.doc_id < 200:
            assert x.lang_pred == ("en" if x.doc_id % 2 else "fr") and x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1)
    by = {x.doc_id: x for x in got if x.doc_id in (900, 901)}
    assert by[900].lang_pred == by[901].lang_pred == "und"
    mixed = next(x for x in got if x.doc_id == 902 and len(x.languages) == 2)
    assert mixed.lang_pred == "en" and 0.5 < mixed.score < 1
    assert {x.lang_pred for x in language_mixture.identify(d.where("lang is null")).collect()} == {"und"}
    assert language_mixture.identify(d.limit(0)).count() == 0


def test_long_texts_are_counted_in_parts():
    text = "abc déf " * 200
    whole, part = language_mixture.trigram_counts(text), language_mixture.PART
    try:
        language_mixture.PART = 7
        assert (language_mixture.trigram_counts(text) == whole).all()
    finally:
        language_mixture.PART = part


def test_tree_traversal_as_training():
    r = np.random.default_rng(3)
    x = r.normal(size=(800, 4))
    y = ((x[:, 0] > 0.2) ^ (x[:, 2] > 0)).astype(float)
    trees = quality_gbt.train(x, y, trees=40)
    assert ((trees.score(x) > 0.5) == y).mean() > 0.97
    one = np.array([walk(trees, row) for row in x[:50]])
    assert np.allclose(one, trees.score(x[:50]))
    assert np.allclose(quality_gbt.train(x, np.ones(800)).score(x), 801 / 802) and quality_gbt.train(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]


def walk(trees, row):
    total = trees.prior
    for at in trees.roots:
        while trees.left[at] != at:
            at = trees.left[at] if row[trees.feature[at]] <= trees.cut[at] else trees.right[at]
        total += trees.value[at]
    return 1 / (1 + np.exp(-total))


def labelled(spark, bad):
    rows = [(i, (bad if i % 4 == 0 else "some plain words of a usual kind without harm ") * (i % 3 + 1), "x") for i in range(240)]
    rows += [(None, None, "x"), (777, "", "x"), (777, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), int(i % 4 == 0)) for i in range(240)] + [(5, None, None), (None, 1, 1), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_quality_classifier(spark):
    ship(spark)
    docs, labels = labelled(spark, "### $$$ !!! %%% ")
    got = quality_gbt.classify(docs, labels).collect()
    assert len(got) == 243 and all(x.predicted == int(x.doc_id % 4 != 0) for x in got if x.doc_id is not None and x.doc_id < 240)
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in got if x.doc_id is not None)
    assert quality_gbt.classify(docs.limit(0), labels).count() == 0 and {x.score for x in quality_gbt.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_toxicity(spark, monkeypatch):
    ship(spark)
    monkeypatch.setattr(toxicity, "LEAST_STEPS", 60)
    docs, labels = labelled(spark, "you awful scum and moron go away from these plain words ")
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == 243
    right = [x.predicted == int(x.doc_id % 4 == 0) for x in got if x.doc_id is not None and x.doc_id < 240]
    assert np.mean(right) > 0.95 and all(0 <= x.score <= 1 for x in got) and all(x.predicted == 0 for x in got if x.doc_id in (None, 777))
    assert toxicity.classify(docs.limit(0), labels).count() == 0 and all(x.predicted == 0 for x in toxicity.classify(docs, labels.limit(0)).collect())


def test_windows_overlap_and_reach_the_end():
    for n in range(0, 200):
        s = toxicity.window_starts(n)
        assert s[0] == 0 and (n == 0 or s[-1] < n) and s[-1] + toxicity.WINDOW >= n
    reader = toxicity.Reader(toxicity.Network.fresh())
    texts = ["a b c", None, "x " * 500, "zz " * 33 + "end"]
    assert np.allclose(reader.scores(texts, most=5), [reader.scores([t])[0] for t in texts])


def plain_score(net, text):
    """The score of a text by reading each window word by word."""
    p, h, words = net.p, toxicity.HIDDEN, toxicity.words_of(text)
    sig = lambda v: 1 / (1 + np.exp(-v))
    worst = -np.inf
    for at in toxicity.window_starts(len(words)):
        window = words[at : at + toxicity.WINDOW]
        states = np.zeros((len(window), 2 * h))
        x = [np.concatenate([p["words"][toxicity.word_rows([w])[0]], p["grams"][toxicity.gram_rows([w])[0]].mean(0)]) for w in window]
        for k, part, order in (("f", slice(0, h), range(len(window))), ("b", slice(h, None), reversed(range(len(window))))):
            state = np.zeros(h)
            for t in order:
                g, s = x[t] @ p["w" + k] + p["b" + k], state @ p["u" + k]
                z, r = sig(g[:h] + s[:h]), sig(g[h : 2 * h] + s[h : 2 * h])
                state = z * state + (1 - z) * np.tanh(g[2 * h :] + r * s[2 * h :])
                states[t, part] = state
        e = np.tanh(states @ p["a"]) @ p["v"]
        weights = np.exp(e - e.max()) / np.exp(e - e.max()).sum() if len(window) else e
        worst = max(worst, float((weights @ states) @ p["o"] + p["c"][0]) if len(window) else float(p["c"][0]))
    return sig(worst)


def test_scores_as_reading_word_by_word():
    net = toxicity.Network.fresh(3)
    r = np.random.default_rng(3)
    words = ["plain", "awful", "scum", "Words", "ü", "moron12", "a"]
    texts = [None, "", "one", *(" ".join(r.choice(words, n)) for n in (5, 31, 32, 33, 57, 200))]
    assert np.allclose(toxicity.Reader(net).scores(texts), [plain_score(net, t) for t in texts], atol=1e-5)


def test_windows_of_long_texts(spark):
    words = [b"plain"] * 5000 + [b"scum"] * 3 + [b"plain"] * 5000
    odds = np.zeros(1 << toxicity.ODDS_BITS, dtype=np.float32)
    odds[toxicity.part_slots(b"scum")[0]] = 2.0
    scores = toxicity.scores_by_odds(words, odds)
    assert len(scores) == len(toxicity.window_starts(len(words))) and scores.max() == 6 and toxicity.scores_by_odds([], odds).tolist() == [0.0]
    own, picked = next(toxicity.picked_windows([b" ".join(words)], [1], odds, None, 0))
    assert all(w.count(b"scum") == 3 for w in picked) and next(toxicity.picked_windows([b" ".join(words)], [1], odds, None, 5)) == (own, picked)
    # what only a far window of a labelled text holds is learned, whole words and all, on Spark as in one process
    draw, long_word = np.random.default_rng(4), "x" * 70
    prose, foul = lambda n: " ".join(f"w{k}" for k in draw.integers(0, 300, n)), f"scum trash {long_word}bad idiot scum"
    rows = [(k, f"{prose(4800)} {foul} {prose(150)}" if k % 2 else prose(4950)) for k in range(40)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, k % 2) for k, _ in rows], "doc_id long, toxic int")
    asked = [f"{prose(900)} {foul} {prose(900)}", prose(1000), ""]
    assert any(w.endswith(b"xbad") and len(w) == 73 for _, x in toxicity.picked_windows([rows[1][1].encode()], [1], toxicity.odds_of([(s, 0, 20) for s in toxicity.part_slots(long_word.encode() + b"bad")], 20, 20), None, 0) for words in x for w in words)
    for network in (toxicity.fit(docs, labels), toxicity.train([t for _, t in rows], np.array([k % 2 for k, _ in rows]))):
        got = toxicity.Reader(network).scores(asked)
        assert got[0] > 0.5 > max(got[1:]), got


def test_gradients():
    net = toxicity.Network({k: v.astype(np.float64) for k, v in toxicity.Network.fresh(1).p.items()})
    parts = [b"you are bad".split(), b"the quick brown fox".split(), []]
    distinct = sorted(set().union(*parts))
    index, mask = np.zeros((5, 3), int), np.zeros((5, 3, 1))
    for b, part in enumerate(parts):
        index[: len(part), b] = [distinct.index(w) for w in part]
        mask[: len(part), b] = 1
    args = index, mask, np.array([1.0, 0, 0]), toxicity.word_rows(distinct), *toxicity.gram_rows(distinct), np.ones(len(distinct))
    _, grad = net.gradients(*args)
    for k, v in net.p.items():
        i = np.unravel_index(np.abs(grad[k]).argmax(), v.shape)
        v[i] += 1e-3
        up = net.gradients(*args)[0]
        v[i] -= 2e-3
        down = net.gradients(*args)[0]
        v[i] += 1e-3
        assert abs((up - down) / 2e-3 - grad[k][i]) < 1e-3 * max(0.01, abs(grad[k][i])) + 1e-5, k
