"""Operators on whole corpora against brute force: URL filter, Jaccard join, WARC index, search, and the pipeline."""

import base64
import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscale.llm import bm25, components, jaccard_join, packing, quality_gbt, shingles, toxicity, url_lm, warc
from folioscale.plans.session import ship

RULES = [url_lm.UrlRule.parse(x, v) for x, v in (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))]


def plain_rule(host, path):
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


def test_url_filter(spark):
    ship(spark)
    urls = [None, "", "no scheme", "http://WWW.Example.com/en/a?x#y", "https://example.com", "https://a.example.com/en/1", "https://x.net/es/", "http://notexample.com/en/", "http://b.net/fr/?q", "http://c.org/en/1", "x://://", "http://h?q=/en/", "http://ü.example.com/en/ä b"]
    urls += [f"http://good{i}.com/a" for i in range(60)] + [f"http://bad{i}.net/fr/x" for i in range(60)] + [f"http://site{i}.org/fr/x" for i in range(5)]
    d = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(None, "http://q.com/", "h")], "page_id long, url string, host string")
    got = url_lm.judge_urls(d, RULES).collect()
    assert len(got) == len(urls) + 1
    for x in got:
        u = urls[x.page_id] if x.page_id is not None else "http://q.com/"
        _, found, rest = (u or "").partition("://")
        end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0]
        rule = plain_rule(host, path)
        assert (x.host, x.path, x.rule) == (host, path, rule.text if rule else None), u
        assert x.verdict == rule.verdict if rule else x.verdict in ("allow", "block")
    assert {x.verdict for x in got if x.host.endswith(".org") and "/fr/" in x.path} == {"block"}
    assert url_lm.judge_urls(d.limit(0), RULES).count() == 0


def test_url_model_against_counting():
    import pyarrow as pa

    urls = ["http://ab.com/a1", "http://ab.com/b", "é"]
    codes, lengths = url_lm.gram_codes(pa.array(urls))
    table = np.bincount(codes, minlength=url_lm.SIZE ** (url_lm.ORDER + 1))
    p = url_lm.log_probabilities(table)
    symbols = [[url_lm.EDGE] * url_lm.ORDER + [int(url_lm._CODE[b]) for b in u.encode()] + [url_lm.EDGE] for u in urls]
    assert lengths.tolist() == [len(s) - url_lm.ORDER for s in symbols]
    seen = [Counter(tuple(s[i - k : i + 1]) for s in symbols for i in range(url_lm.ORDER, len(s))) for k in range(url_lm.ORDER + 1)]

    def prob(gram):
        below = prob(gram[1:]) if len(gram) > 1 else 1 / url_lm.SIZE
        after = [n for g, n in seen[len(gram) - 1].items() if g[:-1] == gram[:-1]]
        return (seen[len(gram) - 1][gram] + len(after) * below) / (sum(after) + len(after)) if after else below

    i = 0
    for s in symbols:
        for k in range(url_lm.ORDER, len(s)):
            assert math.isclose(p[codes[i]], math.log(prob(tuple(s[k - url_lm.ORDER : k + 1]))), rel_tol=1e-9)
            i += 1
    assert np.allclose(np.exp(p).reshape(-1, url_lm.SIZE).sum(1), 1)


def plain_groups(rows, size, num, den):
    """Components and link counts by comparing all pairs; rows with a null id or without words stand alone."""
    sets = []
    for i, t in rows:
        w = shingles.words_of(t)
        sets.append(({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)}) if w else set())
    parent = list(range(len(rows)))

    def root(x):
        return x if parent[x] == x else root(parent[x])

    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and rows[a][0] is not None and rows[b][0] is not None and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)].append(i)
    return sorted(((i, len(s), min(least[root(k)]) if i is not None else None, links[k]) for k, ((i, _), s) in enumerate(zip(rows, sets))), key=repr)


@pytest.mark.parametrize("size, num, den", [(3, 90, 100), (5, 80, 100)])
def test_jaccard_join(spark, monkeypatch, size, num, den):
    ship(spark)
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", 7)
    monkeypatch.setattr(jaccard_join, "BLOCK_TOKENS", 3_000)  # so that groups and visits are dealt over several blocks
    r = np.random.default_rng(size)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [list(r.choice(vocabulary, r.integers(1, 200))) for _ in range(40)]
    texts = [" ".join(w) for w in base]
    for k in range(120):  # near copies of the first ones, many of one
        w = list(base[0 if k % 2 else k % 40])
        for _ in range(r.integers(0, 4)):
            w[r.integers(len(w))] = str(r.choice(vocabulary))
        texts.append(" ".join(w))
    texts += [None, "", " \n", "one", "ONE", "one two", "one  two", texts[0], texts[0].upper(), "w1 " * 5000]
    rows = [(int(i), t) for i, t in enumerate(r.permutation(np.array(texts, dtype=object)))] + [(None, texts[0]), (3_000, "alone and twice here now"), (3_000, "alone and twice here now")]
    d = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, digest string, cid int")
    got = sorted((tuple(x) for x in jaccard_join.similar_documents(d, size, num, den).collect()), key=repr)
    assert got == plain_groups(rows, size, num, den)
    flags = sorted((tuple(x) for x in jaccard_join.similar_documents(d, size, num, den, count_links=False).collect()), key=repr)
    assert flags == sorted(((*x[:3], x[3] > 0) for x in got), key=repr)
    assert jaccard_join.similar_documents(d.limit(0), size, num, den).count() == 0


def test_components(spark):
    r = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7), (None, 3)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {x.node: x.root for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in list(parent)}


def test_warc(spark, monkeypatch):
    ship(spark)
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    rows = [(i, f"http://{'abc'[i % 3]}.example.com/p{i % 7}?q={i % 2}#f", f"<p>{i % 5}</p>" * 30 + "ü", "k") for i in range(40)] + [(50, None, None, "k"), (51, "no scheme", "", "k"), (52, "http://a b\r\nX: y", "é", "k"), (None, "http://n.com/", "é", "k"), (60, "http://z.org/", "z" * 300_000, "k"), (61, "http://z.org/", "only", "k"), (61, "http://z.org/", "only", "k")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, key string")
    for least in (0, 2, 10**6):
        first = {}
        for i, _, h, _ in rows:
            if i is not None:
                first[h or ""] = min(i, first.get(h or "", i))
        expected = []
        for i, _, h, _ in rows:
            raw = (h or "").encode()
            response = len(raw) < least or i == first.get(h or "", i)
            expected.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if response else "revisit", None if response else first[h or ""]))
        assert sorted(map(repr, (tuple(x) for x in warc.round_trip(d, least).collect()))) == sorted(map(repr, expected))
    archive = warc.write(d)
    found = warc.lookup(archive, spark.createDataFrame([("http://z.org/",), ("http://nowhere.net/",), (None,)], "url string").select(warc.url_key(F.col("url")).alias("key")))
    assert {x.page_id for x in warc.read_records(archive, found).collect()} >= {"60", "61"} and found.where("key like '%nowhere%'").count() == 0
    assert warc.round_trip(d.limit(0)).count() == 0


def test_warc_plans_and_the_way_beyond_the_broadcast(spark, monkeypatch):
    ship(spark)
    d = spark.createDataFrame([(i, f"http://s{i % 50}.org/{i // 3}", f"page {i % 40}" if i % 3 else "hot") for i in range(600)], "page_id long, url string, html string")
    expected = sorted(map(repr, warc.round_trip(d).collect()))
    archive = warc.write(d, shards=5)
    names = [x[0] for x in archive.shards]
    assert warc.shards_of(archive)(pa.array(["", "zzz", archive.shards[2][1], archive.shards[2][2]])) == [[], [], [names[2]], [names[2]]]
    found = warc.lookup(archive, d.select(warc.url_key(F.col("url")).alias("key")))
    plan = warc.read_records(archive, found)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and found.count() == 600
    assert warc.read_records(archive, found).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", 0)
    assert sorted(map(repr, warc.round_trip(d).collect())) == expected
    same = d.withColumn("url", F.lit("http://one.org/"))  # one key over several index files
    assert warc.lookup(warc.write(same, shards=3), same.select(warc.url_key(F.col("url")).alias("key"))).count() == 600


def test_warc_keys_that_go_on_below_the_tab(spark):
    ship(spark)
    urls = ["http://a.com/p", "http://a.com/p\x01", "http://a.com/p\x08x", "http://a.com/p\x0b", "http://a.com/p!", "http://a.com/o", "http://a.com/p\x01"]
    d = spark.createDataFrame([(i, u, f"page {i}") for i, u in enumerate(urls)], "page_id long, url string, html string")
    assert sorted(x.page_id for x in warc.round_trip(d).collect()) == list(range(len(urls)))
    archive = warc.write(d, shards=1)
    for u in set(urls):
        found = warc.lookup(archive, spark.createDataFrame([(u,)], "url string").select(warc.url_key(F.col("url")).alias("key")))
        assert sorted(int(x.page_id) for x in warc.read_records(archive, found).collect()) == [i for i, x in enumerate(urls) if x == u]


def plain_search(rows, asked, k):
    counts = [(i, Counter((t or "").encode().translate(bm25._CLEAN).split())) for i, t in rows if i is not None]
    n, average = len(counts), sum(sum(c.values()) for _, c in counts) / max(1, len(counts))
    df = Counter(w for _, c in counts for w in c)
    out = []
    for q, t in asked:
        words = set((t or "").encode().translate(bm25._CLEAN).split())
        scored = []
        for i, c in counts:
            dl = float(sum(c.values()))
            s = 0
            for w in words & set(c):
                idf = float(np.log(1.0 + ((n - df[w]) + 0.5) / (df[w] + 0.5)))
                s += int(np.rint(((bm25.SCALE * idf) * (c[w] * (bm25.K1 + 1))) / (c[w] + bm25.K1 * ((1 - bm25.B) + (bm25.B * dl) / average))))
            if s > 0:
                scored.append((-s, i))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def test_search(spark, monkeypatch):
    ship(spark)
    monkeypatch.setattr(bm25, "SHARD_DOCS", 37)
    monkeypatch.setattr(bm25, "QUERY_TERMS", 60)
    monkeypatch.setattr(bm25, "BLOCK", 4)
    monkeypatch.setattr(bm25, "FIRST_PIVOTS", 2)
    monkeypatch.setattr(bm25, "PIVOTS", 3)
    r = np.random.default_rng(2)
    words = [f"t{i}" for i in range(300)]
    weight = 1 / np.arange(1, 301)
    texts = [" ".join(r.choice(words, r.integers(1, 60), p=weight / weight.sum())) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate([*texts, None, "", texts[0], texts[0], "t1 " * 4000])] + [(None, texts[1])]
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, score int, query string")
    asked = [(i, t) for i, t in rows if i is not None and (i % 25 == 0 or i > 298)]
    q = spark.createDataFrame(asked, "query_id long, text string")
    got = sorted((x.query_id, x.rank, x.doc_id, x.score) for x in bm25.search(d, q, k=7).collect())
    assert got == plain_search(rows, asked, 7)
    assert bm25.search(d.limit(0), q).count() == 0 and bm25.search(d, q.limit(0)).count() == 0


def test_search_answers_the_text_of_least_hash(spark):
    ship(spark)
    d = spark.createDataFrame([(1, "red fish"), (2, "blue bird")], "doc_id long, text string")
    q = spark.createDataFrame([(7, "red"), (7, "blue"), (7, "blue")], "query_id long, text string")
    least = q.orderBy(F.xxhash64("text")).first().text
    assert [(x.query_id, x.rank, x.doc_id) for x in bm25.search(d, q).collect()] == [(7, 1, 1 if least == "red" else 2)]


def test_search_skips_blocks_of_all_lists():
    r = np.random.default_rng(6)
    weight = 1 / np.arange(1, 401)
    # neighbours share their topic, as copies and the pages of a site do
    texts = [" ".join(f"{'' if w < 20 else i // 250}t{w}" for w in r.choice(400, 40, p=weight / weight.sum())) for i in range(4000)]
    pairs = [bm25.term_counts(t) for t in texts]
    shard = bm25.Shard(bm25.pack_shard([t for t, _ in pairs], [n for _, n in pairs]))
    df = Counter(t for terms, _ in pairs for t in terms.tolist())
    asked = [pairs[i][0] for i in range(0, 4000, 100)]
    terms, places = np.unique(np.concatenate(asked), return_inverse=True)
    q = bm25.Queries(None, terms, np.array([df[t] for t in terms.tolist()]), np.cumsum([0, *map(len, asked)]), places, np.ones(len(asked)))
    average = float(shard.lengths.mean())
    s = bm25.ShardSearch(shard, q, 4000, average)
    ids = np.arange(4000)
    for a, b in zip(q.starts, q.starts[1:]):
        scores, found = s.best(places[a:b], ids, 10)
        total = np.zeros(4000)
        for p in places[a:b]:
            for e in range(s.first[p], s.first[p] + s.n_blocks[p]):
                own = slice(s.start[e], s.start[e] + s.count[e])
                total[s.doc[own]] += s.value[own]
                assert s.value[own].max() <= s.bound[e] and set(s.doc[own] // bm25.BLOCK) == {s.block[e]}
        order = np.lexsort((ids, -total))[:10]
        assert found.tolist() == order.tolist() and scores.tolist() == total[order].tolist()
    assert s.skipped > s.opened > 0


def test_search_adds_frequent_lists_without_their_postings(monkeypatch):
    r = np.random.default_rng(8)
    # t0 to t39 in most documents, r0 to r59 in some hundred, u0 to u1499 in some
    texts = [" ".join([f"t{w}" for w in range(40) if r.random() < 0.6 for _ in range(r.integers(1, 4))] + [f"r{w}" for w in r.integers(0, 60, 6)] + [f"u{w}" for w in r.integers(0, 1500, 8)]) for _ in range(2500)]
    texts[900:904] = [texts[900]] * 4  # equal scores
    texts[50] += " r0" * 60
    pairs = [bm25.term_counts(t) for t in texts]
    shard = bm25.Shard(bm25.pack_shard([t for t, _ in pairs], [n for _, n in pairs]))
    df = Counter(t for terms, _ in pairs for t in terms.tolist())
    asked = [pairs[i][0] for i in range(0, 2500, 50)] + [bm25.term_counts(t)[0] for t in ("u7", "t1", "r3 r4")]
    terms, places = np.unique(np.concatenate(asked), return_inverse=True)
    ends = np.cumsum([0, *map(len, asked)])
    each = [places[a:b] for a, b in zip(ends, ends[1:])]
    # in so large a corpus some of r's contributions are above 2 ** 24, and so are most sums
    s = bm25.ShardSearch(shard, bm25.Queries(None, terms, np.array([df[t] for t in terms.tolist()]), ends, places, np.ones(len(asked))), 2_000_000, float(shard.lengths.mean()))
    assert s.value.max() > 1 << 24
    ids, expected = r.permutation(2500), []
    for p in each:
        total = np.zeros(2500)
        for x in p:
            own = slice(s.start[s.first[x]], s.start[s.first[x]] + s.count[s.first[x] : s.first[x] + s.n_blocks[x]].sum())
            total[s.doc[own]] += s.value[own]
        order = np.lexsort((ids, -total))[:10]
        order = order[total[order] > 0]
        expected.append((total[order].tolist(), order.tolist()))
    tenth = np.array([int(x[9]) if len(x) == 10 else 1 for x, _ in expected])
    passed, real = [], bm25.ranges
    monkeypatch.setattr(bm25, "ranges", lambda starts, counts: passed.append(int(counts.sum())) or real(starts, counts))
    plain = lambda found: [(x.tolist(), d.tolist()) for x, d in found]
    assert plain(s.best(p, ids, 10, f) for p, f in zip(each, tenth.tolist())) == expected
    postings = sum(int(s.count[s.first[x] : s.first[x] + s.n_blocks[x]].sum()) for p in each for x in p)
    assert sum(passed) < postings / 3
    assert s.matrix.shape[1] == 40  # the others of the frequent lists are too high for 32 bits
    for together, most in ((128, 2_000_000), (7, 2_000_000), (128, 900), (128, 1)):
        monkeypatch.setattr(bm25, "TOGETHER", together)
        monkeypatch.setattr(bm25, "PASSED", most)
        for floors in (tenth, np.ones(len(each), dtype=np.int64), np.where(np.arange(len(each)) % 2, tenth, 1)):
            assert plain(s.best_of(each, ids, 10, floors)) == expected


def test_search_sums_frequencies_before_queries_meet_them(spark):
    ship(spark)
    d = spark.createDataFrame([(i, f"red {'fish' if i % 2 else 'bird'} n{i}") for i in range(40)], "id long, text string").repartition(8)
    index = bm25.build_index(d)
    asked = bm25.query_terms(spark.createDataFrame([(1, "red fish absent"), (2, "red red bird"), (3, "absent")], "query long, text string"))
    known = bm25.known_terms(index, asked)
    assert sorted((r.query, sorted(r.df)) for r in known.collect()) == [(1, [20, 40]), (2, [20, 40])]
    # nothing that the shards give is joined before it is summed
    _, *below = known._jdf.queryExecution().optimizedPlan().toString().split("Join ")
    assert len(below) == 1 and below[0].index("Aggregate [term") < below[0].rindex("MapInArrow")


def test_index_puts_documents_of_like_words_together(spark):
    ship(spark)
    r = np.random.default_rng(3)
    texts = [" ".join([f"the{i % 8}"] * 9 + [f"x{i % 8}y{w}" for w in r.integers(0, 30, 40)]) for i in range(1024)]
    d = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    (row,) = bm25.build_index(d).collect()
    shard = bm25.Shard({x: np.frombuffer(row[x], dtype=t) for x, t in bm25._KINDS.items()})
    assert sorted(row.ids) == list(range(1024)) and [texts[i].split()[0] for i in row.ids[:128]] == [texts[row.ids[0]].split()[0]] * 128
    # interleaved, each list would have a block in every stretch of the shard
    assert len(shard.block_start) <= 1024 // bm25.BLOCK * 31 * 1.5
    for i, length in zip(row.ids, shard.lengths.tolist()):
        assert length == len(texts[i].split())


def test_pipeline_stages(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_classifier", "ngram_jaccard_join", "best_fit_packing"]
    words = [f"word{i}" for i in range(60)]
    text = " ".join(words)
    near = " ".join([*words[:-1], "other"])
    rows = [(5, text), (2, near), (9, text), (7, "something else entirely here with words"), (7, "something else entirely here with words"), (11, None), (None, text)]
    d = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    kept = corpus_pipeline.one_of_each_group(spark, d, "")
    assert kept.columns == d.columns and sorted(map(repr, (x.doc_id for x in kept.collect()))) == sorted(map(repr, [2, 7, 11, None]))


def test_pipeline_tells_rows_apart(spark):
    import corpus_pipeline

    ship(spark)
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(2, a), (9, a), (9, b), (9, c), (9, c), (4, c.upper()), (None, b), (None, b), (None, "only one here with a null id"), (11, None), (11, ""), (12, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(x) for x in corpus_pipeline.one_of_each_group(spark, d, "").collect()]
    assert sorted(kept, key=repr) == sorted([(2, a), (9, b), (4, c.upper()), (None, b), (None, "only one here with a null id"), (11, None), (11, ""), (12, None)], key=repr)
    assert corpus_pipeline.one_of_each_group(spark, d.limit(0), "").count() == 0


def test_stages_keep_columns_of_any_name(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    ship(spark)
    monkeypatch.setattr(toxicity, "LEAST_STEPS", 60)
    names = ["toxicity", "quality", "row", "id", "score", "label", "key", "digest", "component_id", "linked", "__id"]
    d = spark.createDataFrame([(i, f"some words here {i}", *range(len(names))) for i in range(20)], ["doc_id", "text", *names])
    spark.createDataFrame([(i, 1, i % 2) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, d, str(tmp_path))
        assert out.columns == d.columns and all(tuple(x)[2:] == tuple(range(len(names))) for x in out.collect())


def test_packing_gives_its_ids(spark, tmp_path, monkeypatch):
    import corpus_pipeline
    import public_tokenizers
    import tokenizers
    from folioscale.llm import queries

    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [None, "", "some words here", "many words " * 1500]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    expected = sorted((i, k, *x) for i, t in enumerate(texts) for k, x in enumerate(plain_pieces(library, t)))
    assert sorted((x.doc_id, x.piece, x.start, x.length, x.ids) for x in corpus_pipeline.pack_sequences(spark, d, "").collect()) == expected
    made, pack = [], packing.pack
    monkeypatch.setattr(packing, "pack", lambda *a, **b: made.append(pack(*a, **b)) or made[-1])
    got = queries.op3_best_fit_packing(spark, str(tmp_path))
    assert "ids" in made[0].columns and got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert sorted((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got.collect()) == [(*x[:4], zlib.crc32(np.array(x[4], dtype="<u4").tobytes())) for x in expected]


def plain_pieces(library, text, capacity=1024):
    """(start, length, ids) of a text's pieces; only the first may be shorter than the capacity."""
    ids = library.encode(text or "", add_special_tokens=False).ids + [2]
    cuts = [0, *range(len(ids) % capacity or capacity, len(ids), capacity), len(ids)]
    return [(a, b - a, ids[a:b]) for a, b in zip(cuts, cuts[1:])]


def test_sample_has_one_text_for_each_label_row(spark):
    from folioscale.llm.labels import labelled_sample

    rows = [(7, f"text {i}") for i in range(60)] + [(8, "a"), (8, "a"), (9, None), (9, "long " * 50), (None, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(7, 1), (7, 1), (7, 0), (8, 0), (9, 1), (None, 1)], "doc_id long, toxic int")
    got = [tuple(x) for x in labelled_sample(docs, labels, "toxic", 10, "doc_id", "text", "doc_id", folds=1, held_out=1).collect()]
    assert sorted((k, y) for k, _, y in got) == [(7, 0), (7, 1), (8, 0), (9, 1)]
    assert {t for k, t, _ in got if k == 8} == {"a"} and {t for k, t, _ in got if k == 9} <= {"", "long " * 50} and len({t for k, t, _ in got if k == 7} & {f"text {i}" for i in range(60)}) == 1


def plain_stages(rows, labels):
    """The rows (id, text, further column) that the first three stages keep, stage by stage, and the pieces of the fourth."""
    import public_tokenizers
    import tokenizers

    def examples(rows, column):
        known = {x[0]: x[column] for x in labels if x[0] is not None and x[column] in (0, 1) and zlib.crc32(str(x[0]).encode()) % 5}
        found = {i: t or "" for i, t, _ in rows if i in known}
        return [found[i] for i in sorted(found)], np.array([float(known[i]) for i in sorted(found)])

    reader = toxicity.Reader(toxicity.train(*examples(rows, 2)))
    clean = [x for x in rows if not x[1] or reader.scores([x[1]])[0] < 0.5]
    texts, y = examples(clean, 1)
    trees = quality_gbt.train(np.stack([quality_gbt.statistics(t) for t in texts]), y)
    good = [x for x in clean if trees.score(quality_gbt.statistics(x[1])[None])[0] >= 0.3]
    numbered = plain_groups_of_rows(good)
    kept = [good[k] for k in numbered]
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return clean, good, kept, [(i, k, *x) for i, t, _ in kept for k, x in enumerate(plain_pieces(library, t))]


def plain_groups_of_rows(rows):
    """Places of the rows that stay: of each group the least id's, and one without an id."""
    groups = {k: component for k, _, component, _ in plain_groups([(k, t) for k, (_, t, _) in enumerate(rows)], 5, 80, 100)}
    first = {}
    for k, (i, _, _) in enumerate(rows):
        key = groups[k], i is None
        if key not in first or (i is not None and i < rows[first[key]][0]):
            first[key] = k
    return sorted(first.values())


def test_every_stage_of_the_pipeline(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    ship(spark)
    monkeypatch.setattr(toxicity, "LEAST_STEPS", 60)
    r = np.random.default_rng(4)
    words = [f"{a}{b}" for a in ("plain", "usual", "kind", "quiet", "green") for b in "abcdefgh"]
    rows = []
    for i in range(240):
        text = " ".join(r.choice(words, 30))
        rows.append((i, "you awful scum and moron go away " + text if i % 4 == 0 else "### $$$ !!! %%% " * (i % 7 + 1) if i % 4 == 1 else text, f"extra {i}"))
    good = [x for x in rows if x[0] % 4 == 2]
    rows += [(300 + k, t, "copy") for k, (_, t, _) in enumerate(good[:5])] + [(310 + k, t.rsplit(" ", 1)[0], "near copy") for k, (_, t, _) in enumerate(good[:5])]
    rows += [(400, good[6][1], "id twice"), (400, good[7][1] + " and more of another kind than that", "id twice"), (401, "long " + " ".join(r.choice(words, 3000)), "long")]
    rows += [(None, good[8][1], "null id"), (None, good[8][1], "null id"), (500, None, "null"), (501, "", "empty"), (502, None, None)]
    labels = [(i, int(i % 4 != 1), int(i % 4 == 0)) for i in range(240)] + [(5000, 1, 0), (None, 1, 1), (401, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, extra string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    *kept, pieces = plain_stages(rows, labels)
    assert len(rows) > len(kept[0]) > len(kept[1]) > len(kept[2]) and not [x for x in kept[0] if x[0] is not None and x[0] < 240 and x[0] % 4 == 0]
    assert {500, 501, 502} <= {x[0] for x in kept[0]} and not [x for x in kept[1] if x[0] is not None and x[0] < 240 and x[0] % 4 == 1]

    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for (name, stage), expected in zip(corpus_pipeline.STAGES, kept):
        out = stage(spark, d, str(tmp_path)).collect()
        # which of two rows with the same id and text stays is not told by their further columns
        assert sorted((tuple(x)[:2] for x in out), key=repr) == sorted((x[:2] for x in expected), key=repr), name
        assert {tuple(x) for x in out} <= set(rows), name
        d = spark.createDataFrame(expected, "doc_id long, text string, extra string").repartition(2)
    for packed in (corpus_pipeline.pack_sequences(spark, d, str(tmp_path)), corpus_pipeline.run(spark, str(tmp_path))):
        got = packed.collect()
        assert sorted(((x.doc_id, x.piece, x.start, x.length, x.ids) for x in got), key=repr) == sorted(pieces, key=repr)
        at = defaultdict(int)
        for x in sorted(got, key=lambda x: (x.sequence_id, x.offset)):
            assert x.offset == at[x.sequence_id]
            at[x.sequence_id] += x.length
        assert max(at.values()) <= 1024
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, d.limit(0), str(tmp_path)).count() == 0, name


def test_search_over_many_files_of_shards_and_queries(spark, monkeypatch):
    ship(spark)
    monkeypatch.setattr(bm25, "SHARD_DOCS", 9)
    monkeypatch.setattr(bm25, "QUERY_TERMS", 40)
    r = np.random.default_rng(9)
    rows = [(i, " ".join(r.choice([f"w{j}" for j in range(40)], r.integers(0, 25)))) for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    asked = [x for x in rows if x[0] % 9 == 0]
    got = bm25.search(d, spark.createDataFrame(asked, "query_id long, text string").repartition(3), k=4)
    assert sorted((x.query_id, x.rank, x.doc_id, x.score) for x in got.collect()) == plain_search(rows, asked, 4)
