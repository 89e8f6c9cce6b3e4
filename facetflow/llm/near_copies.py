"""The pipeline's near-duplicates: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Operator 9's method alone cannot reach them. At a similarity of 0.8 two
fingerprints of 64 bits differ in ten bits on average, and its keys find links
within two. So its links, over five-word shingles, are candidates here, and so
are the pairs that share a band of minima: of `BANDS` bands of `ROWS` minima
each, a pair at similarity s shares one with probability 1 - (1 - s^ROWS)^BANDS;
at 0.8 it misses 1 in 8 million.

Candidates are verified by their words, without all pairs of a group:

1. Each text is compared with one other, the least of the band that it shares
   with it most often, and with those that operator 9 links it to. In a group of
   near copies this joins nearly all.
2. Where the texts of a band still fall into several components, those outside of
   the largest are compared with all of the band, in blocks of `BLOCK` texts.
   So every pair that shares a band is compared, or already joined.

Words are as in op9 (only A to Z change to lower case). Texts with the same
words are joined first, so copies never meet as pairs; texts of at most five
words link only with these. Rows with a null doc_id link with nothing and stay.
Null texts count as empty. Rows that repeat both doc_id and text count once. An
empty table gives an empty result; columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import hold, may_occur, numbered, picked, release, salted_join, slices, stash, unstash
from .components import components, local_stars

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
BANDS, ROWS, BLOCK, FOLLOWERS = 40, 5, 512, 64
_RANDOM = np.random.default_rng(SEED)
_FLIP, _TIMES = _RANDOM.integers(0, 1 << 32, (2, BANDS * ROWS, 1), np.uint32)
_TIMES |= np.uint32(1)


def bands(hashes: np.ndarray) -> list[int]:
    """A key for each band."""
    high = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, ~np.uint32(0))
    for k in range(0, len(high), 1024):
        np.minimum(least, ((high[k : k + 1024] ^ _FLIP) * _TIMES).min(1), out=least)
    digest = xxhash.xxh64_intdigest
    return [digest(band.tobytes(), k) - (1 << 63) for k, band in enumerate(least.reshape(BANDS, ROWS))]


def shingles(text: str) -> np.ndarray:
    """Distinct hashes, sorted."""
    return np.unique(simhash.shingle_hashes(simhash.words_of(text), SHINGLE, SEED))


def _marks(rows: DataFrame) -> DataFrame:
    """(doc_id, mark, text) -> doc_id, mark, words: a digest of the text's words, fp (five-word fingerprint) and bands; null and none for short texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, tuple] = {}  # exact copies in one task
        for batch in slices(batches, "text"):
            if len(memo) > 4000:
                memo.clear()
            digests, fps, keys = [], [], []
            for text in batch.column("text").to_pylist():
                words = simhash.words_of(text)
                digest = xxhash.xxh3_128_digest(b" ".join(words), SEED)
                if digest not in memo:
                    hashes = simhash.shingle_hashes(words, SHINGLE, SEED)
                    memo[digest] = (np.uint64(simhash.majority(hashes)).astype(np.int64).item(), bands(np.unique(hashes))) if len(words) > SHINGLE else (None, [])
                digests.append(digest)
                fps.append(memo[digest][0])
                keys.append(memo[digest][1])
            yield pa.record_batch([batch.column("doc_id"), batch.column("mark"), pa.array(digests, pa.binary()), pa.array(fps, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "mark", "words", "fp", "bands"])

    return rows.mapInArrow(run, "doc_id long, mark long, words binary, fp long, bands array<long>")


def _compare(texts: DataFrame) -> DataFrame:
    """texts(grp, part, role, node, cluster, text) -> a, b: links, enough for all components, between the queries (role 1) and the residents (role 0) of each part that are not in one cluster yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, clusters, sets = None, [], [], []
        index: tuple | None = None
        for batch in slices(batches, "text"):
            found_a, found_b = [], []
            for grp, part, role, node, cluster, text in zip(*(batch.column(c).to_pylist() for c in ("grp", "part", "role", "node", "cluster", "text")), strict=True):
                if (grp, part) != now:
                    now, nodes, clusters, sets, index = (grp, part), [], [], [], None
                own = shingles(text)
                if not role:
                    nodes.append(node)
                    clusters.append(cluster)
                    sets.append(own)
                    continue
                if not sets:
                    continue
                if index is None:
                    every = np.concatenate(sets)
                    order = np.argsort(every, kind="stable")
                    sizes = np.array([len(s) for s in sets])
                    index = every[order], np.repeat(np.arange(len(sets)), sizes)[order], sizes, np.array(nodes), np.array(clusters)
                values, owner, sizes, ids, groups = index
                low, high = np.searchsorted(values, own), np.searchsorted(values, own, "right")
                n = high - low
                hit = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                common = np.bincount(owner[hit], minlength=len(sizes))
                linked = ids[(common >= SIMILARITY * (sizes + len(own) - common) - 1e-9) & (groups != cluster) & (ids != node)]
                found_a.append(np.full(len(linked), node))
                found_b.append(linked)
            if found_a:
                a, b = local_stars(np.concatenate(found_a), np.concatenate(found_b))
                if len(a):
                    yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    key = ["grp", "part"]
    return texts.select(*key, "role", "node", "cluster", "text").repartition(*key).sortWithinPartitions(*key, "role").mapInArrow(run, "a long, b long")


def _to_leaders(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Links of pairs(leader, node). A leader of many is repeated, so that each part compares up to FOLLOWERS texts with it."""
    sizes = pairs.groupBy("leader").agg(F.count("*").alias("c"))
    parts = F.ceil(F.col("c") / FOLLOWERS).cast("int")
    first = sizes.select(F.col("leader").alias("grp"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(0).alias("role"), F.col("leader").alias("node"))
    many = sizes.where(F.col("c") > FOLLOWERS).select("leader", parts.alias("parts"))
    others = pairs.join(many, "leader", "left").select(F.col("leader").alias("grp"), F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("node"), "parts")).cast("int").alias("part"), F.lit(1).alias("role"), "node")
    return _compare(first.unionByName(others).withColumn("cluster", F.col("node")).join(texts, "node"))


def _across_clusters(members: DataFrame, clusters: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between texts of members(key, node) that share a key and are in different clusters."""
    placed = hold(members.select("key", "node").join(clusters, "node", "left").select("key", "node", F.coalesce("component", "node").alias("cluster")))
    sizes = placed.groupBy("key", "cluster").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node") % (1 << 40)).alias("of"))
    mixed = sizes.groupBy("key").agg(F.count("*").alias("clusters"), F.sum("n").alias("c"), F.sum("of").alias("of"), F.max_by("cluster", F.struct("n", -F.col("cluster"))).alias("largest")).where("clusters > 1")
    # Bands of the same texts are compared once.
    keys = mixed.groupBy("c", "of").agg(F.min("key").alias("key"), F.min_by("largest", "key").alias("largest"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    asked = hold(salted_join(placed, keys.select("key", "largest", F.col("c").alias("n"), "c"), ["key"], placed.count()))
    residents = asked.select(F.col("key").alias("grp"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("part"), F.lit(0).alias("role"), "node", "cluster")
    queries = asked.where("cluster <> largest").select(F.col("key").alias("grp"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("part"), F.lit(1).alias("role"), "node", "cluster")
    found = stash(_compare(residents.unionByName(queries).join(texts, "node")), "across")
    release(placed, asked)
    return found


def near_copies(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, mark (xxhash64 of text), first: doc_id and mark of the least row of the component; rows with a null doc_id are left out."""
    chosen = picked(docs, "doc_id", "text").where("doc_id is not null")
    rows = chosen.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    marks = hold(_marks(rows))
    distinct = marks.groupBy("words").agg(F.min(F.struct("doc_id", "mark")).alias("row"), F.first("bands").alias("bands"), F.first("fp").alias("fp"), F.count("*").alias("c"))
    distinct = stash(distinct.withColumn("node", F.monotonically_increasing_id()), "distinct")
    keyed = distinct.select(F.explode("bands").alias("key"), "node")
    leaders = keyed.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("c")).where("c > 1")
    members = hold(salted_join(keyed, leaders, ["key"], BANDS * distinct.count()))
    # Of each text, the leader that it shares most bands with; and what operator 9 links.
    usual = members.where("leader <> node").groupBy("node", "leader").agg(F.count("*").alias("n")).groupBy("node").agg(F.max_by("leader", F.struct("n", -F.col("leader"))).alias("leader"))
    known = distinct.where("fp is not null").groupBy("fp").agg(F.min("node").alias("node"))
    same = distinct.where("fp is not null").join(known.select("fp", F.col("node").alias("leader")), "fp").where("node <> leader").select("leader", "node")
    golay = simhash.links(known).select(F.least("a", "b").alias("leader"), F.greatest("a", "b").alias("node"))
    pairs = hold(usual.select("leader", "node").unionByName(same).unionByName(golay).distinct())
    wanted = pairs.select("node").unionByName(pairs.select(F.col("leader").alias("node"))).unionByName(members.select("node")).distinct()
    at = hold(distinct.join(wanted, "node").select("row.doc_id", "row.mark", "node"))
    texts = stash(may_occur(rows, ["doc_id", "mark"], at).where("_may").join(at, ["doc_id", "mark"]).dropDuplicates(["node"]).select("node", "text"), "texts")
    near = hold(_to_leaders(pairs, texts))
    clusters = components(near, "a", "b")
    across = _across_clusters(members, clusters, texts)
    joined = components(near.unionByName(across), "a", "b")
    rooted = hold(distinct.join(joined, "node", "left").select("words", "row", "c", F.coalesce("component", "node").alias("root")))
    first = rooted.groupBy("root").agg(F.min("row").alias("first"), F.count("*").alias("c"))
    of_words = salted_join(rooted.select("root", "words", F.col("c").alias("copies")), first, ["root"], rooted.count()).select("words", "first", F.col("copies").alias("c"))
    result = stash(salted_join(marks.select("words", "doc_id", "mark"), of_words, ["words"], marks.count()).select("doc_id", "mark", "first"), "first")
    release(marks, members, pairs, at, near, rooted)
    unstash(distinct, texts, across)
    return result


def first_of_groups(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all of their columns, that are the least by doc_id of their component; rows that repeat both doc_id and text count once. Rows with a null doc_id all stay."""
    names = docs.columns
    ids, text = (F.col(f"c{names.index(n)}") for n in ("doc_id", "text"))
    key = ["doc_id", "mark"]
    gone = near_copies(docs).where("struct(doc_id, mark) <> first").select(*key).distinct()
    rows = numbered(docs).withColumns({"doc_id": ids.cast("long"), "mark": F.xxhash64(text)})
    plain = [f"c{k}" for k in range(len(names))]
    left = may_occur(rows.where("doc_id is not null"), key, gone)
    kept = left.where("not _may").drop("_may").unionByName(left.where("_may").drop("_may").join(gone, key, "left_anti"))
    return kept.dropDuplicates(key).select(*plain).unionByName(rows.where("doc_id is null").select(*plain)).toDF(*names)
