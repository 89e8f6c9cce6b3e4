"""Operator 8: removal of long repeated passages over a sparse De Bruijn graph.

The edges of the graph are k-mers of `window` words (50). Written out, a corpus
has as many as words, so they are handled in paths: consecutive windows of a
document with the same minimizer (the k-mer of `anchor` words with the least
hash among theirs) form one path, a row instead of about fourteen.

1. Paths are written once, without their windows. Windows can only repeat
   across documents where their minimizer does, so the paths are joined with
   the minimizers that more than one document holds.
2. Equal paths fall together by joins: a path's source is its first place (the
   least document, the least position). Where a minimizer has a single path,
   the graph does not branch: the path stays compact and its source stands for
   all of its windows.
3. Where it has several, the windows of one copy of each path are read from its
   source's text and compared one by one: each takes the least place of all
   paths that share it.
4. At its places in a document, a path or window whose source lies in a lesser
   document is marked, with the source's coordinates. Marks with neighbouring
   sources compact into long spans.
5. Source coordinates verify: the words of each span are brought to the text of
   its source and compared there. Up to here equality was that of 64-bit hashes;
   if any span differs, the hashes met by chance, and all is done again with
   hashes of another seed. So no word goes that does not repeat, and none stays
   that does, since equal windows always have equal hashes.
6. The words covered by verified spans are cut.

Texts are only shuffled where a filter of fixed size says that they may be
needed (steps 3, 5, 6); keys of many rows are dealt over salts.

Windows are judged on the input, not on what is left. Null and empty texts have
no words; texts shorter than a window stay. Rows that share a doc_id do not
count against each other. Rows with a null doc_id neither remove nor lose
anything. Repeated rows are all cut alike. An empty table gives an empty result;
all columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hold, hot_limit, may_occur, numbered, picked, release, salted_join, slices, stash, table, unstash
from .kmers import mix, sliding_min, window_hashes, word_hashes

WINDOW, ANCHOR = 50, 25
PLACE = ["doc_id", "text_hash"]


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _paths(batch: pa.RecordBatch, window: int, anchor: int, seed: int) -> tuple[np.ndarray, ...]:
    """Of a batch of texts: the row, first position, minimizer and number of windows of each path, and the hash of every window."""
    with np.errstate(over="ignore"):
        lists = [_words(t) for t in batch.column("text").to_pylist()]
        lists = [x if len(x) >= window else [] for x in lists]
        hashes = word_hashes(lists, seed)
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        windows = window_hashes(hashes, window)
        if not len(windows):
            none = np.zeros(0, np.int64)
            return none, none, none.view(np.uint64), none, none.view(np.uint64)
        least = sliding_min(window_hashes(hashes, anchor), window - anchor + 1)
        row = np.repeat(np.arange(len(lists)), sizes)
        position = np.arange(len(hashes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        whole = row[: len(windows)] == row[window - 1 :]
        row, position, least, windows = row[: len(windows)][whole], position[: len(windows)][whole], least[whole], windows[whole]
        starts = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (row[1:] != row[:-1])])
        return row[starts], position[starts], least[starts], np.diff(np.r_[starts, len(windows)]), windows


def _whole_paths(texts: DataFrame, window: int, anchor: int, seed: int) -> DataFrame:
    """texts(doc_id, text_hash, text) -> a row for each path: its minimizer, its hash, its first window and how many it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            row, position, least, n, windows = _paths(batch, window, anchor, seed)
            first = np.cumsum(n) - n
            with np.errstate(over="ignore"):  # the path's hash: of its windows in order
                running = np.r_[np.uint64(0), np.add.accumulate(mix(windows + (np.arange(len(windows)) - np.repeat(first, n)).astype(np.uint64)))]
                path = running[first + n] - running[first]
            at = batch.select(PLACE).take(pa.array(row))
            yield pa.record_batch([pa.array(least.view(np.int64)), pa.array(path.view(np.int64)), *at.columns, pa.array(position.astype(np.int32)), pa.array(n.astype(np.int32))], names=["m", "path", *PLACE, "start", "n"])

    return texts.select(*PLACE, "text").mapInArrow(run, "m long, path long, doc_id long, text_hash long, start int, n int")


def _at(texts: DataFrame, places: DataFrame) -> DataFrame:
    """texts joined with places, which has each (doc_id, text_hash) once."""
    return may_occur(texts, PLACE, places).where("_may").drop("_may").join(places, PLACE)


def _windows(texts: DataFrame, sources: DataFrame, window: int, anchor: int, seed: int) -> DataFrame:
    """The windows of the paths that start at the given sources, read from their texts: m, path, place in the path, hash w, and where it lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            row, position, least, n, windows = _paths(batch, window, anchor, seed)
            first = np.cumsum(n) - n
            wanted = [(r << 32) + s for r, starts in enumerate(batch.column("starts").to_pylist()) for s in starts]
            chosen = np.flatnonzero(np.isin((row << 32) + position, np.array(wanted, np.int64)))
            with np.errstate(over="ignore"):
                running = np.r_[np.uint64(0), np.add.accumulate(mix(windows + (np.arange(len(windows)) - np.repeat(first, n)).astype(np.uint64)))]
                path = running[first + n] - running[first]
            of = np.repeat(chosen, n[chosen])
            place = np.arange(len(of)) - np.repeat(np.cumsum(n[chosen]) - n[chosen], n[chosen])
            at = batch.select(PLACE).take(pa.array(row[of]))
            yield pa.record_batch(
                [pa.array(least[of].view(np.int64)), pa.array(path[of].view(np.int64)), *at.columns, pa.array((position[of] + place).astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(windows[first[of] + place].view(np.int64))],
                names=["m", "path", *PLACE, "at", "place", "w"],
            )

    starts = hold(sources.groupBy(*PLACE).agg(F.collect_list("start").alias("starts")))  # of a document, its own paths
    opened = stash(_at(texts, starts).select(*PLACE, "text", "starts").mapInArrow(run, "m long, path long, doc_id long, text_hash long, at int, place int, w long"), "windows")
    release(starts)
    return opened


def _marks(texts: DataFrame, window: int, anchor: int, seed: int) -> DataFrame:
    """doc_id, text_hash -> marks: runs of windows (start, n) and where they occur in a lesser document (doc, hash, at), by their hashes."""
    paths = hold(_whole_paths(texts, window, anchor, seed))
    held = paths.groupBy("m").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("c")).where("low < high").select("m", "c", F.col("c").alias("of_m"))
    found = stash(salted_join(paths, held, ["m"], paths.count()), "found")
    total = found.count()
    sources = hold(found.groupBy("m", "path").agg(F.min(F.struct(*PLACE, "start")).alias("source"), F.count("*").alias("c"), F.min("of_m").alias("of_m")))
    several = sources.where("c < of_m")  # the minimizer has other paths, too
    opened = _windows(texts, several.select("source.*"), window, anchor, seed)
    least = opened.groupBy("m", "w").agg(F.min(F.struct(*PLACE, "at")).alias("low"), F.count("*").alias("c")).where("c > 1")
    lower = salted_join(opened.select("m", "path", "doc_id", "place", "w"), least, ["m", "w"], opened.count()).where("low.doc_id < doc_id")
    # A path has window - anchor + 1 windows at most. Places whose least document is the path's own need no row.
    shared = lower.groupBy("m", "path").agg(F.collect_set(F.struct("place", "low")).alias("lower"))
    hits = salted_join(found.drop("of_m"), sources.drop("of_m").join(shared, ["m", "path"], "left"), ["m", "path"], total)
    mark = lambda start, n, s, at: F.struct(start.alias("start"), n.alias("n"), s["doc_id"].alias("doc"), s["text_hash"].alias("hash"), s[at].alias("at"))
    single = F.transform(F.filter("lower", lambda x: x["low"]["doc_id"] < F.col("doc_id")), lambda x: mark(F.col("start") + x["place"], F.lit(1), x["low"], "at"))
    each = F.when(F.col("source.doc_id") < F.col("doc_id"), F.array(mark(F.col("start"), F.col("n"), F.col("source"), "start"))).otherwise(single)
    marks = stash(hits.select(*PLACE, F.explode(each).alias("mark")).groupBy(*PLACE).agg(F.collect_set("mark").alias("marks")), "marks")
    release(paths, sources)
    unstash(found, opened)
    return marks


def compact(marks: list[dict]) -> list[list]:
    """Marks whose windows follow one another, here and at their source, as one: [doc, hash, at, start, n]."""
    out: list[list] = []
    for s in sorted(marks, key=lambda s: (s["doc"], s["hash"], s["at"] - s["start"], s["start"])):
        doc, source, at, start, n = (out[-1] if out else [None] * 5)
        if (doc, source) == (s["doc"], s["hash"]) and at - start == s["at"] - s["start"] and s["start"] <= start + n:
            out[-1][4] = max(n, s["start"] + s["n"] - start)
        else:
            out.append([s["doc"], s["hash"], s["at"], s["start"], s["n"]])
    return out


SPAN = "doc long, hash long, at int, length int, doc_id long, text_hash long, start int, words binary"


def _spans(texts: DataFrame, marks: DataFrame, window: int) -> DataFrame:
    """Long spans with their words and the coordinates of their sources."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        names = [x.split()[0] for x in SPAN.split(", ")]
        for batch in slices(batches, "text"):
            rows = []
            for doc_id, text_hash, text, found in zip(*(batch.column(c).to_pylist() for c in (*PLACE, "text", "marks")), strict=True):
                words = _words(text)
                for doc, source, at, start, n in compact(found):
                    length = n + window - 1
                    rows.append((doc, source, at, length, doc_id, text_hash, start, b" ".join(words[start : start + length])))
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return _at(texts, marks).select(*PLACE, "text", "marks").mapInArrow(run, SPAN)


def _verified(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """Each span with `same`: whether its words are those at its source's coordinates. Spans of a source that has many are dealt over copies of its text."""
    limit = hot_limit(spans.count())
    wanted = spans.groupBy("doc", "hash").agg(F.count("*").alias("c"))
    parts = F.ceil(F.col("c") / limit).cast("int")
    listed = F.broadcast(wanted.where(F.col("c") > limit).select("doc", "hash", parts.alias("parts")))
    salt = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id", "text_hash", "start"), F.col("parts"))).cast("int")
    asked = spans.join(listed, ["doc", "hash"], "left").select("doc", "hash", salt.alias("salt"), F.lit(1).alias("role"), *PLACE, "start", "at", "length", F.col("words").alias("data"))
    named = wanted.select(F.col("doc").alias("doc_id"), F.col("hash").alias("text_hash"), F.sequence(F.lit(0), parts - 1).alias("salts"))
    null = lambda kind: F.lit(None).cast(kind)
    texts_of = _at(texts, named).select(F.col("doc_id").alias("doc"), F.col("text_hash").alias("hash"), F.explode("salts").alias("salt"), F.lit(0).alias("role"), null("long").alias("doc_id"), null("long").alias("text_hash"), null("int").alias("start"), null("int").alias("at"), null("int").alias("length"), F.col("text").cast("binary").alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, words = None, []
        for batch in slices(batches, "data"):
            rows = []
            for doc, source, role, doc_id, text_hash, start, at, length, data in zip(*(batch.column(c).to_pylist() for c in ("doc", "hash", "role", *PLACE, "start", "at", "length", "data")), strict=True):
                if not role:
                    now, words = (doc, source), data.split()
                else:
                    rows.append((doc_id, text_hash, start, length, now == (doc, source) and b" ".join(words[at : at + length]) == data))
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()), strict=True)], names=[*PLACE, "start", "length", "same"])

    key = ["doc", "hash", "salt"]
    return texts_of.unionByName(asked).repartition(*key).sortWithinPartitions(*key, "role").mapInArrow(run, "doc_id long, text_hash long, start int, length int, same boolean")


def repeated_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """docs(doc_id, text) -> doc_id, text_hash, spans: words covered by windows that also start in a document with a lesser doc_id."""
    chosen = picked(docs, "doc_id", "text").where("doc_id is not null and text is not null")
    texts = chosen.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string").alias("text"))
    for seed in count():
        marks = _marks(texts, window, anchor, seed)
        spans = hold(_spans(texts, marks, window))
        verified = stash(_verified(texts, spans), "verified")
        release(spans)
        unstash(marks)
        if not verified.where("not same").limit(1).count():
            return verified.groupBy(*PLACE).agg(F.collect_set(F.struct("start", "length")).alias("spans"))
        unstash(verified)
    raise AssertionError("unreachable")


def _cut(words: list[bytes], spans: list[dict] | None) -> list[bytes]:
    if not spans:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for s in spans:
        edge[s["start"]] += 1
        edge[s["start"] + s["length"]] -= 1
    return [w for w, c in zip(words, np.cumsum(edge[:-1]).tolist(), strict=True) if not c]


def _joined(docs: DataFrame, window: int, anchor: int) -> tuple[DataFrame, DataFrame, int]:
    """docs with numbered columns and their spans: rows that may have some, and rows that have none; and the number of the text's column."""
    names, spans = docs.columns, repeated_spans(docs, window, anchor)
    ids, text = F.col(f"c{names.index('doc_id')}").cast("long"), F.col(f"c{names.index('text')}").cast("string")
    keyed = numbered(docs).withColumns({"doc_id": ids, "text_hash": F.when(text.isNotNull(), F.xxhash64(text))})
    flagged = may_occur(keyed, PLACE, spans)
    plain = [f"c{k}" for k in range(len(names))]
    return flagged.where("_may").join(spans, PLACE, "left").select(*plain, "spans"), flagged.where("not _may").select(*plain), names.index("text")


def clean(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """The rows and columns of docs; where words were removed, text holds the others joined by one space, elsewhere it is unchanged."""
    some, none, place = _joined(docs, window, anchor)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, place):
            texts = []
            for text, cut in zip(batch.column(place).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                texts.append(b" ".join(_cut(_words(text), cut)).decode("utf-8", "surrogatepass") if cut else text)
            yield pa.record_batch([pa.array(texts, pa.string()) if k == place else batch.column(k) for k in range(batch.num_columns - 1)], names=batch.schema.names[:-1])

    return some.mapInArrow(run, none.schema).unionByName(none).toDF(*docs.columns)


def counted(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, n_removed, kept: the words that stay, joined by one space."""
    some, none, _ = _joined(picked(docs, "doc_id", "text"), window, anchor)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "c1"):
            n, removed, kept = [], [], []
            for text, cut in zip(batch.column("c1").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words = _words(text)
                left = _cut(words, cut)
                n.append(len(words))
                removed.append(len(words) - len(left))
                kept.append(b" ".join(left).decode("utf-8", "surrogatepass"))
            yield pa.record_batch([batch.column("c0"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    fields = [T.StructField("doc_id", some.schema["c0"].dataType), *(T.StructField(c, T.LongType()) for c in ("n_words", "n_removed")), T.StructField("kept", T.StringType())]
    whole = some.unionByName(none.withColumn("spans", F.lit(None).cast(some.schema["spans"].dataType)))
    return whole.mapInArrow(run, T.StructType(fields))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


#: Windows as texts of fifty words; for tables of the size that tests and the correctness run have.
SQL = r"""
WITH t AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
w AS (SELECT doc_id, k, md5(array_to_string(ws[k + 1 : k + 50], ' ')) AS h FROM t, unnest(range(greatest(len(ws) - 49, 0))) AS u(k)),
f AS (SELECT h, min(doc_id) AS low FROM w GROUP BY h HAVING min(doc_id) < max(doc_id)),
g AS (SELECT doc_id, list(DISTINCT k + j) AS gone FROM w JOIN f ON w.h = f.h AND low < doc_id, unnest(range(50)) AS x(j) GROUP BY doc_id),
r AS (SELECT t.doc_id, len(ws) AS n_words, coalesce(len(gone), 0) AS n_removed, ws, list_sort(list_filter(range(len(ws)), lambda k: gone IS NULL OR NOT list_contains(gone, k))) AS stay FROM t LEFT JOIN g ON t.doc_id = g.doc_id)
SELECT doc_id, n_words, n_removed, sha256(array_to_string(list_transform(stay, lambda k: ws[k + 1]), ' ')) AS kept_sha256 FROM r"""
