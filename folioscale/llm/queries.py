"""The registered queries of this subpackage and the SQL that some of them are held against."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscale.plans.session import ship, table


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscale.llm.url_lm import UrlRule, judge_urls

    rules = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
    out = judge_urls(table(ship(spark), sf_dir, "pages"), [UrlRule.parse(text, verdict) for text, verdict in rules])
    return out.select("page_id", "host", "path", "rule", "verdict")


def op2_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscale.llm.language_mixture import identify

    return identify(table(ship(spark), sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscale.llm.packing import crc32_of_ids, pack

    out = pack(table(ship(spark), sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.withColumn("ids_crc32", crc32_of_ids("ids")).drop("ids")


def op4_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscale.llm.warc import round_trip

    return round_trip(table(ship(spark), sf_dir, "pages"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscale.llm.quality_rules import judge

    out = judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscale.llm.jaccard_join import similar_documents

    return similar_documents(table(ship(spark), sf_dir, "documents"), size=3, num=90, den=100)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscale.llm.quality_gbt import classify

    ship(spark)
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality", 0.3)


def op8_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscale.llm.bm25 import search

    docs = table(ship(spark), sf_dir, "documents")
    return search(docs, docs.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id"), k=10)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscale.llm.toxicity import classify

    ship(spark)
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "toxic", 0.5)


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscale.llm.bpe import encode_decode

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode_decode(table(ship(spark), sf_dir, "documents"), path, public_tokenizers.PATTERN, keep_ids=False)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscale.llm.vector_codes import books_digest, hex_code, product_codes

    coded, books = product_codes(table(ship(spark), sf_dir, "embeddings"))
    return coded.select("vec_id", hex_code(F.col("code")).alias("code"), "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscale.llm.periodic_runs import find_runs, longest, with_planted_runs

    found = find_runs(with_planted_runs(table(ship(spark), sf_dir, "documents").select("doc_id", "text"))).withColumn("best", longest(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscale.llm.chat_format import format_chats, read_loss, read_turns

    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marked = spark.createDataFrame([(-7, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))], chats.schema)
    out = format_chats(chats.union(marked)).select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("segments")).alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_language_mixture": op2_language_mixture,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_warc_index": op4_warc_index,
    "op5_quality_rules": op5_quality_rules,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_bm25_search": op8_bm25_search,
    "op9_toxicity": op9_toxicity,
    "op10_bpe_codec": op10_bpe_codec,
    "op11_vector_codes": op11_vector_codes,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_chat_format": op13_chat_format,
}


def quality_rules_sql() -> str:
    from folioscale.llm.quality_rules import BASE_SQL, RULES, STOP_WORDS

    stop = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
words AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM texts),
windows AS (SELECT doc_id, p, w[p:p + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM words)),
repeated AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT p + o) AS n FROM repeated, (SELECT unnest(range(0, 5)) AS o) GROUP BY doc_id),
measures AS (
  SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
    len(list_filter(w, lambda x: x IN ({stop}))) AS n_stop_words, len(l) AS n_lines, len(list_filter(l, lambda x: ends_with(x, '...'))) AS n_ellipsis_lines,
    len(list_filter(l, lambda x: substr(x, 1, 2) IN ('- ', '* ', '• '))) AS n_bullet_lines
  FROM words LEFT JOIN covered USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {BASE_SQL} AS base_failed,
  NOT {BASE_SQL} AND NOT ({" OR ".join(r.sql() for r in RULES)}) AS kept
FROM measures"""


JACCARD_SQL = """
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
rare AS (SELECT doc_id, n, t, count(*) OVER (PARTITION BY t) AS df FROM tokens),
prefix AS (SELECT doc_id, n, t FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY df, t) AS r FROM rare) WHERE r <= n - CAST(ceil(0.9 * n) AS BIGINT) + 1),
pairs AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM prefix a JOIN prefix b ON a.t = b.t AND a.doc_id < b.doc_id AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n),
overlap AS (SELECT x, y, a.s AS sx, b.s AS sy, len(list_intersect(a.s, b.s)) AS o FROM pairs JOIN sets a ON a.doc_id = x JOIN sets b ON b.doc_id = y),
links AS (SELECT x, y FROM overlap WHERE 100 * o >= 90 * (len(sx) + len(sy) - o)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, l.y FROM reach r JOIN both_ways l ON r.b = l.x),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT x AS doc_id, count(*) AS n_links FROM both_ways GROUP BY x)
SELECT doc_id, len(s) AS n_shingles, component_id, coalesce(n_links, 0) AS n_links FROM sets JOIN least USING (doc_id) LEFT JOIN degree USING (doc_id)"""


WARC_SQL = """
WITH payloads AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
fives AS (SELECT page_id, payload_bytes, h, list_transform(range(0, 8), lambda g: list_sum(list_transform(range(1, 6), lambda k: CAST((strpos('0123456789abcdef', substr(h, 5 * g + k, 1)) - 1) << (4 * (5 - k)) AS BIGINT)))) AS v FROM payloads),
digests AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST(v[i // 4 + 1] AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1)), '') AS payload_digest FROM fives),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS f FROM digests)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to FROM firsts"""


BM25_SQL = """
WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\\x{80}-\\x{10FFFF}]+') AS w FROM documents),
lengths AS (SELECT doc_id, len(w) AS dl FROM words),
corpus AS (SELECT count(*) AS n, CAST(sum(dl) AS DOUBLE) / count(*) AS average FROM lengths),
tokens AS (SELECT doc_id, unnest(w) AS t FROM words),
postings AS (SELECT doc_id, t, CAST(count(*) AS DOUBLE) AS tf FROM tokens GROUP BY doc_id, t),
frequencies AS (SELECT t, CAST(count(*) AS DOUBLE) AS df FROM postings GROUP BY t),
scores AS (
  SELECT q.doc_id AS query_id, p.doc_id, CAST(sum(CAST(round(((1000000.0::DOUBLE * ln(1.0::DOUBLE + ((n - df) + 0.5::DOUBLE) / (df + 0.5::DOUBLE))) * (tf * (1.2::DOUBLE + 1))) / (tf + 1.2::DOUBLE * ((1 - 0.75::DOUBLE) + (0.75::DOUBLE * dl) / average))) AS BIGINT)) AS BIGINT) AS score
  FROM (SELECT doc_id, t FROM postings WHERE doc_id % 100 = 0) q JOIN (SELECT doc_id, t, tf FROM postings) p ON q.t = p.t JOIN frequencies f ON f.t = p.t JOIN lengths l ON l.doc_id = p.doc_id, corpus
  GROUP BY q.doc_id, p.doc_id)
SELECT query_id, CAST(r AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM scores WHERE score > 0) WHERE r <= 10"""


def vector_codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """A round in SQL: all distances of the parts to their codebook, the nearest entry, means rounded down."""
    nearest = """SELECT vec_id, p, min(e) AS e, min(d) AS d FROM (
    SELECT vec_id, p, e, d, min(d) OVER (PARTITION BY vec_id, p) AS least FROM (
      SELECT vec_id, p, e, CAST(list_sum(list_transform(list_zip(x, b), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM cut JOIN {book} USING (p))) WHERE d = least GROUP BY vec_id, p"""
    steps = []
    for k in range(rounds):
        steps.append(f"n{k} AS MATERIALIZED ({nearest.format(book=f'b{k}')})")
        steps.append(f"s{k} AS (SELECT p, e, i, CAST(sum(v) AS BIGINT) AS s, count(*) AS c FROM (SELECT p, e, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS i FROM cut JOIN n{k} USING (vec_id, p)) GROUP BY p, e, i)")
        steps.append(f"m{k} AS (SELECT p, e, list((s - ((s % c) + c) % c) // c ORDER BY i) AS b FROM s{k} GROUP BY p, e)")
        steps.append(f"b{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.b, o.b) AS b FROM b{k} o LEFT JOIN m{k} m USING (p, e))")
    return f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS MATERIALIZED (SELECT vec_id, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] AS x FROM kept, range({parts}) r(p)),
b0 AS MATERIALIZED (SELECT p, e, x AS b FROM cut JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {entries}) USING (vec_id)),
{("," + chr(10)).join(steps)},
last AS MATERIALIZED ({nearest.format(book=f'b{rounds}')}),
codes AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM last GROUP BY vec_id),
digest AS (SELECT sha256(string_agg(array_to_string(b, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM codes JOIN kept USING (vec_id), digest"""


def chat_format_sql() -> str:
    from folioscale.llm.chat_format import BLOCKS, JOINED, NAMED, OTHER, START, _any, _MARKS

    longer = lambda text: f"length(regexp_replace({text}, '({_any(_MARKS)})', '\\\\\\1', 'g'))"
    opening = " ".join(f"WHEN '{role}' THEN {len(a) + 2}" for role, (a, _) in BLOCKS.items())
    closing = " ".join(f"WHEN '{role}' THEN {len(b) + 1}" for role, (_, b) in BLOCKS.items())
    return f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
beside AS (SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
sized AS (
  SELECT *, {longer("text")} + CASE WHEN role IS NOT DISTINCT FROM before THEN {len(JOINED) + 2} ELSE CASE role {opening} ELSE {len(OTHER[0]) + len(NAMED) + 4} + {longer("role")} END END
    + CASE WHEN role IS NOT DISTINCT FROM after THEN 0 ELSE CASE role {closing} ELSE {len(OTHER[1]) + 1} END END AS n
  FROM beside)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST({len(START)} + sum(n) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id"""


SQL: dict[str, str] = {
    "op11_vector_codes": vector_codes_sql(),
    "op13_chat_format": chat_format_sql(),
    "op8_bm25_search": BM25_SQL,
    "op4_warc_index": WARC_SQL,
    "op6_ngram_jaccard_join": JACCARD_SQL,
    "op5_quality_rules": quality_rules_sql(),
}
