"""Similarity join of word-shingle sets by Jaccard, with a token-group matrix.

Documents with equal sets are one class. Classes that share enough of their prefixes (the rarest tokens, of which linked sets must share a
certain number) with others are partitioned into groups by the most shared of these tokens, so similar classes meet in one group. The
union of a group's tokens is made where its block is read, and isn't a table of its own. A class looks only at groups whose members' prefixes hold enough of its own; there, the part of its
tokens inside the union bounds its overlap with every member, and only groups that can reach the threshold are opened. Links between members of opened groups are counted
exactly. What leaves a block is a forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscale.llm.components import components
from folioscale.llm.shingles import set_digest, shingle_set
from folioscale.plans.session import written

#: About so many documents, chosen by a hash, tell which shingles are frequent. That only orders the tokens; no link depends on it.
ORDERING_SAMPLE = 20_000
#: A shingle in so many sampled documents is frequent; at most FREQUENT_KEPT of them are broadcast.
FREQUENT_FROM, FREQUENT_KEPT = 3, 200_000
#: Linked sets have to share a token of their prefixes for each so many tokens, and one more.
LEVEL_TOKENS = 24
#: A token in more prefixes than this leads nowhere, as far as a class can spare it.
SPARED_DF = 16
#: A block (members of a group, and classes that visit it) has about so many tokens of either, 16 MB, and so many rows of either.
BLOCK_TOKENS, BLOCK_ROWS = 2_000_000, 512


def level(n: int) -> int:
    return 1 + n // LEVEL_TOKENS


def prefix_length(n: int, num: int, den: int) -> int:
    """How many first tokens of a set of n are compared before others.

    Linked sets x and y share num/den of the tokens of either. If their first n - ceil(num * n / den) + k tokens shared fewer than k, the shared tokens
    after them would be too few. So they share at least k, for the smaller level k of both.
    """
    return min(n, n - -(-num * n // den) + level(n))


def required(num: int, den: int) -> Column:
    """The least level among the sets that a set of ``n`` tokens can link with."""
    return F.expr(f"1 + ((n * {num} + {den - 1}) div {den}) div {LEVEL_TOKENS}")


def spared(num: int, den: int) -> Column:
    """How many of its prefix tokens a set of ``n`` can leave out of the search for partners: a quarter of those that it must share."""
    return F.expr(f"((n * {num} + {den - 1}) div {den}) div {LEVEL_TOKENS} div 4")


def found_at_least(num: int, den: int) -> Column:
    """What the search then still finds of a linked pair: the required number less what a set of ``n`` and any partner leave out."""
    return required(num, den) - spared(num, den) - F.expr(f"n div {LEVEL_TOKENS} div 4")


def frequent_shingles(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles, ascending, and their places (from 1) in the order of rising frequency."""
    share = min(1.0, ORDERING_SAMPLE / max(1, docs.count()))
    sample = docs.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20))).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, size) for t in batch.column(0).to_pylist()]
            tokens, n = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(n)], ["token", "n"])

    counts = sample.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT_FROM)
    top = counts.orderBy(F.desc("n"), "token").limit(FREQUENT_KEPT).collect()
    tokens = np.array([r["token"] for r in top], dtype=np.int64).view(np.uint64)
    places = np.arange(len(top), 0, -1)
    order = np.argsort(tokens)
    return tokens[order], places[order]


def describe(docs: DataFrame, size: int, num: int, den: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Each document's set: its size ``n``, a digest and the prefix of its tokens, rarest first."""
    held = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, places = held.value
        for batch in batches:
            sizes, digests, prefixes = [], [], []
            for text in batch.column(1).to_pylist():
                tokens = shingle_set(text, size)
                sizes.append(len(tokens))
                digests.append(set_digest(tokens))
                if not len(tokens):
                    prefixes.append(np.zeros(0, np.int64))
                    continue
                p = prefix_length(len(tokens), num, den)
                if len(common):
                    at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
                    place = np.where(common[at] == tokens, places[at], 0)
                    rare = tokens[place == 0]
                    if len(rare) < p:
                        rest = tokens[place > 0][np.argsort(place[place > 0], kind="stable")]
                        rare = np.concatenate([rare, rest[: p - len(rare)]])
                    tokens = rare
                prefixes.append(tokens[:p].view(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*prefixes, np.zeros(0, np.int64)])))], ["id", "n", "digest", "prefix"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, n long, digest binary, prefix array<long>")


def tokens_of(docs: DataFrame, size: int) -> DataFrame:
    """``cid``, ``places`` and all tokens as bytes, of documents whose set has the wanted ``digest``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for i, (text, digest) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                tokens = shingle_set(text, size)
                if set_digest(tokens) == digest:
                    rows.append(i)
                    out.append(tokens.tobytes())
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(out, pa.binary()), batch.column(3).take(at)], ["cid", "tokens", "places"])

    d = docs.select("cid", "text", "digest", "places")
    return d.mapInArrow(run, f"cid long, tokens binary, places {d.schema['places'].dataType.simpleString()}")


def open_group(table: pa.Table, num: int, den: int, count_links: bool) -> pa.Table:
    """One block: members (``role`` 0) and visitors (1: from another group, 2: from this one). A row for each class: its local root and the weight of its links.

    Without ``count_links`` a class has 1 if it has links, and visitors that can't join anything new are left out: those from this group, once all members are joined.
    """
    # several rows with the id and the text of a class's first give its tokens more than once
    d = table.group_by(["cid", "role"]).aggregate([("weight", "min"), ("tokens", "min")]).rename_columns(["cid", "role", "weight", "tokens"]).to_pydict()
    role, cid, weight = np.array(d["role"]), np.array(d["cid"], dtype=np.int64), np.array(d["weight"], dtype=np.int64)
    sets = [np.frombuffer(b, dtype=np.uint64) for b in d["tokens"]]
    members, visitors = np.flatnonzero(role == 0), np.flatnonzero(role > 0)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    flat = np.concatenate([*(sets[i] for i in members), np.zeros(0, np.uint64)])
    owner = np.repeat(np.arange(len(members)), sizes[members])
    order = np.argsort(flat, kind="stable")
    owner, (union, starts, counts) = owner[order], np.unique(flat[order], return_index=True, return_counts=True)
    # local components: one label for each class, the least of its component
    nodes, at = np.unique(cid, return_inverse=True)
    label, links = np.arange(len(nodes)), np.zeros(len(nodes), dtype=np.int64)
    node_of, member_nodes = at, at[members]
    for v in visitors.tolist():
        own, c = sets[v], node_of[v]
        if not count_links and role[v] == 2 and (label[member_nodes] == label[c]).all():
            continue
        places = np.searchsorted(union, own)
        places[places == len(union)] = 0
        inside = places[union[places] == own] if len(union) else places[:0]
        if den * len(inside) < num * len(own):  # the bound: no member can overlap more
            continue
        n = counts[inside]
        ends = np.cumsum(n)
        posts = np.repeat(starts[inside] - ends + n, n) + np.arange(int(ends[-1]))
        overlap = np.bincount(owner[posts], minlength=len(members))
        near = np.flatnonzero(den * overlap >= num * (len(own) + sizes[members] - overlap))
        near = near[member_nodes[near] != c]
        if not len(near):
            continue
        others = member_nodes[near]
        if count_links:
            links[c] += weight[members[near]].sum()
            if role[v] == 1:
                links[others] += weight[v]  # the members are different classes
        else:
            links[c] = 1
            links[others] = 1
        joined = np.unique(label[np.append(others, c)])
        if len(joined) > 1:
            label[np.isin(label, joined)] = joined[0]
    some = np.bincount(label, minlength=len(nodes))[label] > 1
    return pa.table({"cid": pa.array(nodes[some], pa.int64()), "root": pa.array(nodes[label[some]], pa.int64()), "links": pa.array(links[some], pa.int64())})


def group_classes(shared: DataFrame) -> DataFrame:
    """``cid`` to ``gid``: classes by the most shared of their prefix tokens; a group of too many tokens is dealt over several."""
    key = shared.groupBy("cid").agg(F.max(F.struct("df", "token")).alias("k"), F.first("n").alias("n"), F.first("weight").alias("weight")).select("cid", "n", "weight", F.col("k.token").alias("key"))
    parts = key.groupBy("key").agg(F.ceil(F.sum("n") / BLOCK_TOKENS).alias("parts")).where("parts > 1")
    return key.join(parts, "key", "left").select("cid", "n", "weight", F.xxhash64("key", F.coalesce(F.pmod(F.xxhash64("cid"), "parts"), F.lit(0))).alias("gid"))


def similar_documents(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", count_links: bool = True) -> DataFrame:
    """Per document: the id column, ``n_shingles``, ``component_id`` (the least id that links lead to, itself included) and ``n_links``.

    Without ``count_links`` there is a boolean ``linked`` instead of ``n_links``: links inside a component that is already joined need not be found then.

    Two documents link if ``den * |intersection| >= num * |union|`` of their sets of ``size``-word shingles; words are runs between ASCII
    white space, A-Z lower-cased; fewer words count as one shingle. A document without words (or with a null text) has no shingles and
    no links. A row with a null id keeps its set's size, but takes part in no link and has a null component. Rows with equal texts are copies and link, also
    with the same id. Other columns are left out, whatever their names. An empty table gives no rows. Texts are taken whole, of any length.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    described = written(describe(source, size, num, den, frequent_shingles(source, size)), "sets")
    usable = described.where((F.col("n") > 0) & F.col("id").isNotNull())
    classes = usable.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("weight"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")

    tokens = classes.select("cid", "n", "weight", F.explode("prefix").alias("token"))
    counts = classes.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    own, ranked = Window.partitionBy("cid"), Window.partitionBy("cid").orderBy(F.desc("df"), "token")
    shared = tokens.join(counts, "token").withColumn("c", F.count("*").over(own)).withColumn("place", F.row_number().over(ranked))
    leads = (F.col("df") <= SPARED_DF) | (F.col("place") > spared(num, den))
    shared = written(shared.where(F.col("c") >= required(num, den)).select("cid", "n", "weight", "token", "df", leads.alias("leads")), "shared")
    groups = written(group_classes(shared), "groups")

    reached = shared.where("leads").select("token", "cid", "n").join(groups.select("cid", "gid"), "cid")
    index = reached.select("token", F.col("gid").alias("to")).distinct()
    visits = reached.join(index, "token").where(F.col("to") < F.col("gid")).groupBy("cid", "to").agg(F.count("*").alias("c"), F.first("n").alias("n")).where(F.col("c") >= found_at_least(num, den)).select("cid", F.col("to").alias("gid"))
    several = groups.groupBy("gid").agg(F.count("*").alias("c")).where("c > 1").select("gid")
    visits = written(visits.withColumn("role", F.lit(1)).union(groups.join(several, "gid").select("cid", "gid", F.lit(2).alias("role"))), "visits")

    weights = groups.select("cid", "n", "weight")
    visitors = visits.join(weights, "cid")
    cut = lambda name: F.ceil(F.greatest(F.sum("n") / BLOCK_TOKENS, F.count("*") / BLOCK_ROWS)).alias(name)
    # a group is a matrix of blocks: its members are dealt over parts, its visitors over chunks, and each part meets each chunk
    grid = visitors.groupBy("gid").agg(cut("chunks")).join(groups.groupBy("gid").agg(cut("parts")), "gid")
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))
    one = lambda count: F.pmod(F.xxhash64("cid"), count)
    rows = visitors.join(grid, "gid").select("cid", "gid", "role", "weight", one("chunks").alias("chunk"), every("parts").alias("part"))
    members = groups.join(grid, "gid").select("cid", "gid", F.lit(0).alias("role"), "weight", every("chunks").alias("chunk"), one("parts").alias("part"))
    places = rows.union(members).groupBy("cid").agg(F.collect_list(F.struct("gid", "chunk", "part", "role", "weight")).alias("places"))
    wanted = written(places.join(classes.select("cid", "rep", "digest"), "cid"), "blocks")

    texts = source.join(wanted.hint("shuffle_hash"), F.col("id") == F.col("rep"))
    sets = tokens_of(texts, size).select("cid", "tokens", F.explode("places").alias("p")).select("cid", "tokens", "p.*")
    opened = sets.groupBy("gid", "chunk", "part").applyInArrow(lambda t: open_group(t, num, den, count_links), "cid long, root long, links long")
    found = written(opened, "links")

    roots = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    linked = roots.join(classes.select(F.col("cid").alias("node"), "digest", "rep", "weight"), "node")
    least = linked.groupBy("root").agg(F.min("rep").alias("least"))
    totals = found.groupBy(F.col("cid").alias("node")).agg(F.sum("links").alias("links"))
    reach = linked.join(least, "root").join(totals, "node", "left").select("digest", "least", "links")
    per_class = classes.select("digest", "rep", "weight").join(reach, "digest", "left").select("digest", F.coalesce("least", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("class_links"))
    own = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("digest"))
    out = described.select("id", "n", own.alias("digest")).join(per_class, "digest", "left")
    n_links = F.coalesce("class_links", F.lit(0).cast("long"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"), n_links.alias("n_links") if count_links else (n_links > 0).alias("linked"))
