"""Operator 10: quality rules with an isolation forest on their statistics.

Fixed rules give counts for each whole text. Ratios of these counts feed an
isolation forest: trees of random splits over shares of the rows, in which
unusual documents end on short paths. Forests are grown on half of the labelled
rows, one for each family of features; on the other half the threshold on the
anomaly score is calibrated, and the family that rejects most junk at a bounded
loss of good rows is kept. Documents that fail a base rule are
rejected whatever the forest says.

All labelled rows that pass the base rules take part, a hash of their doc_id
says in which half. Those of the first are dealt over the trees, so that each
is in one tree at least: a tree has `SAMPLE` rows, or more where `TREES` such
trees could not hold them all, but never more levels, so the model's size is
bounded and its leaves count all rows. Those of the second are all scored, and
the threshold is the best of all cuts between their scores. Both are done where
the rows are; only tallies and trees come to the driver. Without labelled rows
of both kinds only the base rules apply.

Null and empty texts have no words, all counts zero, and fail the base rule on
words. Repeated rows are judged each on its own; an empty table gives an empty
result; other columns of the input are ignored. A doc_id with several labels
counts once, with the least of them, and one with several texts once, with the
least features. Ties in the anomaly are decided alike: all of a score or none.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import doc_text, hold, may_occur, numbered, picked, release, slices, table

SYMBOLS = "#*$%&|<>"
TREES, SAMPLE, SEED = 100, 256, 20
#: Labelled rows are numbered, and cuts between scores tried, in so many ranges: of hashes, of the score from 0 to 1.
RANGES = 4096
#: Of the labelled good rows that pass the base rules, at most this share may be lost to the forest.
MAX_LOSS = 0.005
_LETTERS = re.compile(r"[^\W\d_]")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("symbols", "marks", "bars", "word_length", "dup_lines", "repeats", "log_words", "distinct", "upper", "digits", "ends")
#: Forests are grown on each of these groups of features; the one that tells labelled junk from good rows best is kept.
FAMILIES = (FEATURES[:3], FEATURES[:4], FEATURES[:6], FEATURES)


def statistics(text: str) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """COUNTS and FEATURES of a text."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    spaces = sum(map(text.count, " \t\n\x0b\x0c\r"))
    chars = len(text) - spaces
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    lines = dups = 0
    for line in text.split("\n"):
        if line in seen:
            dups += 1
            lines += 1
        elif line.strip(" \t\x0b\x0c\r"):
            seen.add(line)
            lines += 1
    repeats = 0
    if n >= 6:
        windows = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
        if len(set(windows)) < len(windows):
            count, end = Counter(windows), 0
            for k, w in enumerate(windows):
                if count[w] > 1:
                    repeats += k + 5 - max(k, end)
                    end = k + 5
    upper = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    marks = text.count("!") + text.count("?")
    ends = marks + text.count(".")
    digits = sum(map(text.count, "0123456789"))
    c, w = max(chars, 1), max(n, 1)
    root = math.sqrt  # spreads small ratios, so that random splits fall among them
    features = (root(symbols / w), root(marks / w), root(text.count("|") / w), chars / w, root(dups / max(lines, 1)), root(repeats / w), math.log1p(n), len(set(words)) / w**0.8, upper / c, digits / c, ends / w)
    return (n, chars, symbols, dups, repeats), features


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 10 or 100 * n_repeat_words > 20 * n_words


def _unsuccessful(n: int | np.ndarray) -> float:
    """Mean path length of an unsuccessful search among n points."""
    n = np.maximum(np.asarray(n, float), 1)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


def _height(sample: int) -> int:
    """Levels of splits in a tree of so many rows; those of SAMPLE rows at most, which bounds its nodes."""
    return math.ceil(math.log2(max(min(sample, SAMPLE), 2)))


def grow_tree(rows: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    """Feature (-1 at a leaf), split value, children, and at leaves the path length. The order of rows does not matter."""
    feature, value, left, right, path = [], [], [], [], []
    limit = _height(len(rows))

    def grow(part: np.ndarray, depth: int) -> int:
        me = len(feature)
        for x in (feature, value, left, right, path):
            x.append(-1)
        low, high = part.min(0), part.max(0)
        able = np.flatnonzero(high > low)
        if depth >= limit or len(part) < 2 or not len(able):
            path[me] = depth + float(_unsuccessful(len(part)))
            return me
        f = int(able[rng.integers(len(able))])
        v = float(rng.uniform(low[f], high[f]))
        under = part[:, f] < v
        if not under.any() or under.all():
            path[me] = depth + float(_unsuccessful(len(part)))
            return me
        feature[me], value[me] = f, v
        left[me] = grow(part[under], depth + 1)
        right[me] = grow(part[~under], depth + 1)
        return me

    grow(rows, 0)
    return np.array(feature), np.array(value, float), np.array(left), np.array(right), np.array(path, float)


class IsolationForest:
    """Trees as arrays, as grow_tree() gives them, each grown on `sample` rows."""

    def __init__(self, trees: list[tuple[np.ndarray, ...]], sample: int):
        self.trees, self.sample, self.limit = trees, sample, _height(sample)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly: 2 to the power of minus the mean path over the usual path."""
        if not len(rows):
            return np.zeros(0)
        total = np.zeros(len(rows))
        for feature, value, left, right, path in self.trees:
            node = np.zeros(len(rows), int)
            for _ in range(self.limit):
                f = feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                under = rows[np.arange(len(rows)), np.maximum(f, 0)] < value[node]
                node = np.where(inner, np.where(under, left[node], right[node]), node)
            total += path[node]
        return 2 ** -(total / len(self.trees) / max(float(_unsuccessful(self.sample)), 1e-9))


def calibrate(scores: np.ndarray, good: np.ndarray, max_loss: float = MAX_LOSS, junk: np.ndarray | None = None, before: tuple[int, int] = (0, 0), total: tuple[int, int] | None = None, after: float | None = None) -> tuple[float, float]:
    """The score from which on documents are rejected: the best balance of rejected junk and lost good rows, losing at most a share max_loss of these. And that balance.

    With junk, good and junk are numbers of rows with these scores. Where these are only a range of the scores, before has the numbers of good and junk rows with higher ones, total those of all rows, and after the next lower score.
    """
    order = np.argsort(-scores, kind="stable")
    s, g = scores[order], good[order].astype(float)
    j = 1 - g if junk is None else junk[order].astype(float)
    n_good, n_junk = total or (g.sum(), j.sum())
    lost, caught = (before[0] + np.cumsum(g)) / max(n_good, 1), (before[1] + np.cumsum(j)) / max(n_junk, 1)
    last = np.r_[s[1:] != s[:-1], True] & (lost <= max_loss)
    if not last.any():
        return math.inf, 0.0
    worth = np.where(last, caught - lost, -1)
    k = int(worth.argmax())
    if worth[k] <= 0:
        return math.inf, 0.0
    under = s[k + 1] if k + 1 < len(s) else after
    return float(s[k] if under is None else (s[k] + under) / 2), float(worth[k])


def _features(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
    column = rows.column("features")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All labelled rows that pass the base rules, one for each doc_id: doc_id, features, good, hash, range and grown, the half they are in."""
    chosen = picked(labels, "doc_id", "quality").where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality").cast("int") == 1).alias("good"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            counts, features = zip(*map(statistics, batch.column("text").to_pylist()), strict=True)
            passed = pa.array([not base_failed(c[0], c[4]) for c in counts])
            yield pa.record_batch([batch.column("doc_id"), pa.array(features, pa.list_(pa.float64()))], names=["doc_id", "features"]).filter(passed)

    # Features are joined, not texts: these would be shuffled.
    asked = may_occur(doc_text(docs).withColumn("doc_id", F.col("doc_id").cast("long")), ["doc_id"], chosen).where("_may").select("doc_id", "text")
    found = asked.mapInArrow(run, "doc_id long, features array<double>").groupBy("doc_id").agg(F.min("features").alias("features"))
    h = F.xxhash64("doc_id")
    return found.join(chosen, "doc_id").select("doc_id", "features", "good", h.alias("hash"), F.pmod(h, F.lit(RANGES)).cast("int").alias("range"), (h < 0).alias("grown"))


def _share(n: int) -> int:
    """Rows of a tree, of n: together the trees have them all."""
    return max(min(SAMPLE, n), -(-n // TREES))


def _dealt(rows: DataFrame, counts: dict[int, int]) -> DataFrame:
    """rows(doc_id, hash, range, ...), so many in each range, dealt over the trees (tree, ...): by the order of hashes, round and round, until each tree has its share."""
    spark, n = rows.sparkSession, sum(counts.values())
    size = _share(n)
    rounds = -(-TREES * size // n)
    ranges = sorted(counts)
    starts = spark.createDataFrame(list(zip(ranges, np.r_[0, np.cumsum([counts[r] for r in ranges])][:-1].tolist(), strict=True)), "range int, _start long")
    at = F.row_number().over(Window.partitionBy("range").orderBy("hash", "doc_id")) - 1 + F.col("_start")
    placed = rows.join(F.broadcast(starts), "range").withColumn("_at", at)
    trees = F.expr(f"filter(transform(sequence(0L, {rounds - 1}L), k -> cast((_at + k * {n}L) div {size}L as int)), t -> t < {TREES})")
    return placed.withColumn("tree", F.explode(trees)).drop("_start", "_at")


def _forests(rows: DataFrame, counts: dict[int, int]) -> list[IsolationForest]:
    """A forest for each family, of all rows."""
    uses = [[FEATURES.index(f) for f in family] for family in FAMILIES]

    def grow(key: tuple[pa.Scalar, ...], share: pa.Table) -> pa.Table:
        tree, features = key[0].as_py(), _features(share)
        grown = [(tree, k, *(x.tolist() for x in grow_tree(features[:, use], np.random.default_rng((SEED, k, tree))))) for k, use in enumerate(uses)]
        kinds = [pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float64())]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*grown, strict=True), kinds, strict=True)], names=["tree", "family", "feature", "value", "lower", "upper", "path"])

    dealt = _dealt(rows, counts).select("tree", "features").repartition(rows.sparkSession.sparkContext.defaultParallelism, "tree")
    # At most two nodes a row of SAMPLE come back, for each tree and family.
    grown = dealt.groupBy("tree").applyInArrow(grow, "tree int, family int, feature array<int>, value array<double>, lower array<int>, upper array<int>, path array<double>").collect()
    of: list = [[] for _ in FAMILIES]
    for r in sorted(grown, key=lambda r: r["tree"]):
        of[r["family"]].append(tuple(map(np.array, tuple(r)[2:])))
    return [IsolationForest(trees, _share(sum(counts.values()))) for trees in of]


def _thresholds(rows: DataFrame, forests: list[IsolationForest], max_loss: float = MAX_LOSS) -> list[tuple[float, float]]:
    """What calibrate() gives for each family on all rows."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast([(forest, [FEATURES.index(f) for f in family]) for forest, family in zip(forests, FAMILIES, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features = _features(batch)
            for k, (forest, use) in enumerate(sent.value):
                score = forest.score(features[:, use])
                yield pa.record_batch([pa.array(np.full(len(score), k, np.int32)), pa.array((score * RANGES).astype(np.int32)), pa.array(score), batch.column("good")], names=["family", "level", "score", "good"])

    scored = rows.select("features", "good").mapInArrow(run, "family int, level int, score double, good boolean")
    # Many rows may have one score, copies and texts without any marks do.
    scores = hold(scored.groupBy("family", "level", "score").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("junk")))
    tally = scores.groupBy("family", "level").agg(F.sum("good").alias("good"), F.sum("junk").alias("junk"), F.max("score").alias("top")).orderBy("family", F.desc("level")).collect()
    facts = []
    for k in range(len(FAMILIES)):
        levels = [r for r in tally if r["family"] == k]
        total = sum(r["good"] for r in levels), sum(r["junk"] for r in levels)
        lost = caught = 0
        for r, under in zip(levels, [*levels[1:], None], strict=True):
            # No cut is best in a range without junk, or beyond the loss allowed.
            if r["junk"] and lost <= max_loss * max(total[0], 1):
                facts.append((k, r["level"], lost, caught, *total, under and under["top"]))
            lost, caught = lost + r["good"], caught + r["junk"]

    def cut(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        lost, caught, n_good, n_junk, after = (part.column(c)[0].as_py() for c in ("lost", "caught", "n_good", "n_junk", "after"))
        threshold, worth = calibrate(*(part.column(c).to_numpy() for c in ("score", "good")), max_loss, part.column("junk").to_numpy(), (lost, caught), (n_good, n_junk), after)
        return pa.table([[key[0].as_py()], [threshold], [worth]], schema=pa.schema([("family", pa.int32()), ("threshold", pa.float64()), ("worth", pa.float64())]))

    known = F.broadcast(spark.createDataFrame(facts, "family int, level int, lost long, caught long, n_good long, n_junk long, after double"))
    cuts = scores.join(known, ["family", "level"]).groupBy("family", "level").applyInArrow(cut, "family int, threshold double, worth double").collect()
    release(scores)
    # Of equal balances the highest score, as within a range.
    best = [max(((r["worth"], r["threshold"]) for r in cuts if r["family"] == k), default=(0.0, math.inf)) for k in range(len(FAMILIES))]
    return [(threshold, worth) for worth, threshold in best]


def fit(docs: DataFrame, labels: DataFrame) -> tuple[IsolationForest | None, list[int], float]:
    """The forest, its columns of FEATURES, and the score from which on documents are rejected."""
    rows = hold(_labelled(docs, labels))
    tally = rows.groupBy("range", "grown").agg(F.count("*").alias("n"), F.count_if("good").alias("n_good")).collect()
    good, n = sum(r["n_good"] for r in tally), sum(r["n"] for r in tally)
    best: tuple = (0.0, None, [], math.inf)
    if good >= 2 and good < n:
        held_good, held_n = (sum(r[c] for r in tally if not r["grown"]) for c in ("n_good", "n"))
        grown = held = rows
        if 0 < held_good < held_n < n:
            grown, held = rows.where("grown"), rows.where("not grown")
            tally = [r for r in tally if r["grown"]]
        counts: Counter = Counter()
        for r in tally:
            counts[r["range"]] += r["n"]
        forests = _forests(grown, counts)
        for family, forest, (threshold, worth) in zip(FAMILIES, forests, _thresholds(held, forests), strict=True):
            if worth > best[0]:
                best = worth, forest, [FEATURES.index(f) for f in family], threshold
    release(rows)
    return best[1:]


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, the counts, base_failed, anomaly, kept."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))  # 2 x TREES x SAMPLE nodes at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, use, threshold = model.value
        for batch in slices(batches, "text"):
            counts, features = zip(*map(statistics, batch.column("text").to_pylist()), strict=True)
            failed = [base_failed(c[0], c[4]) for c in counts]
            anomaly = forest.score(np.array(features)[:, use]) if forest else np.zeros(len(counts))
            kept = [not f and a < threshold for f, a in zip(failed, anomaly.tolist(), strict=True)]
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in zip(*counts, strict=True)), pa.array(failed), pa.array(anomaly), pa.array(kept)], names=["doc_id", *COUNTS, "base_failed", "anomaly", "kept"])

    return doc_text(docs).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, anomaly double, kept boolean")


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that judge() keeps, with all of their columns."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    at = docs.columns.index("text")
    plain = numbered(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, use, threshold = model.value
        for batch in slices(batches, at):
            counts, features = zip(*(statistics(t or "") for t in batch.column(at).to_pylist()), strict=True)
            anomaly = forest.score(np.array(features)[:, use]) if forest else np.zeros(len(counts))
            yield batch.filter(pa.array([not base_failed(c[0], c[4]) and a < threshold for c, a in zip(counts, anomaly.tolist(), strict=True)]))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
