"""Operator 9: near-duplicates by SimHash, found with the binary Golay code.

A fingerprint has 64 bits; two link if at most two bits differ. It is cut into
segments of 22, 21 and 21 bits. Two errors leave, in a cycle of the segments,
at least one without error whose successor has at most one: the keys of a
fingerprint are, for each of the three, the segment itself with the indices of
the Golay codewords at distance 4 or less from its successor. Every 23-bit word
has one codeword at distance 3 or less, so two words that differ in one bit
share one of these: at most six each, five or so on average. So links that the
keys miss do not exist; candidates are verified by counting bits.

Equal fingerprints are joined before keys are made, so copies never meet as
pairs. Rows with equal keys are compared in streams sorted by key; of the links
found only stars go on to the components. A key of more than `bucket` rows is
cut once more: of the third segment's three parts one has no error, so each
part, with the key, is a key of its own.

Null, empty and short texts have the fingerprint of what words they have; none:
zero, linked like any other. Repeated rows fall together; rows with a null doc_id get a fingerprint,
but link with nothing and have a null component. An empty table gives an empty
result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_text, hold, release, salted_join, slices, stash, table
from .components import components, local_stars

SHINGLE, SEED = 3, 42
#: Start and width of the segments, from the lowest bit.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Buckets beyond this many fingerprints are searched by flipping bits, which takes time in proportion to their size.
PAIRWISE = 3000


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A to Z change


def shingle_hashes(words: list[bytes], shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Hashes of the shingles in order, repeats included; fewer words are one shingle, none give none."""
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts, ends = np.r_[0, ends[:-1] + 1].tolist(), ends.tolist()
    return np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts, ends[shingle - 1 :], strict=False)), np.uint64, len(words) - shingle + 1)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    set_bits = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 4096):
        set_bits += np.unpackbits(hashes[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    return majority(shingle_hashes(words_of(text), shingle, seed))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """docs(doc_id, text) -> doc_id, fp: the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            fps = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    return doc_text(docs).mapInArrow(run, "doc_id long, fp long")


class Golay:
    """The perfect [23, 12, 7] code, generated by x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, in systematic form."""

    GENERATOR = 0b101011100011

    def __init__(self):
        self.high = np.array([self._rest(h << 11) for h in range(1 << 12)], np.int64)  # remainder of the upper 12 bits
        self.errors: list[list[int]] = [[] for _ in range(1 << 11)]  # of each syndrome: error words of weight 4 at most
        bits = [1 << k for k in range(23)]
        rest = [self._rest(b) for b in bits]

        def add(first: int, word: int, syndrome: int, left: int) -> None:
            self.errors[syndrome].append(word)
            if left:
                for k in range(first, 23):
                    add(k + 1, word | bits[k], syndrome ^ rest[k], left - 1)

        add(0, 0, 0, 4)
        widest = max(map(len, self.errors))
        # Syndromes with fewer error words repeat their first.
        self.table = np.array([e + [e[0]] * (widest - len(e)) for e in self.errors], np.int64)
        self.counts = np.array([len(e) for e in self.errors])

    def _rest(self, x: int) -> int:
        for k in range(22, 10, -1):
            if x >> k & 1:
                x ^= self.GENERATOR << (k - 11)
        return x

    def indices(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each 23-bit word, the 12-bit indices of the codewords at distance 4 or less, and which of these columns count."""
        syndrome = self.high[words >> 11] ^ (words & 0x7FF)
        return (words[:, None] ^ self.table[syndrome]) >> 11, np.arange(self.table.shape[1]) < self.counts[syndrome][:, None]


_GOLAY: list[Golay] = []


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in fps and keys, a row for each key of each fingerprint."""
    if not _GOLAY:
        _GOLAY.append(Golay())
    parts = [(fps >> np.uint64(s) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in SEGMENTS]
    places, out = [], []
    for k in range(3):
        index, counts = _GOLAY[0].indices(parts[(k + 1) % 3])
        key = (np.int64(k) << 34 | parts[k] << 12)[:, None] | index
        row, column = np.nonzero(counts)
        places.append(row)
        out.append(key[row, column])
    return np.concatenate(places), np.concatenate(out)


def _near(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= bits


def links_in_bucket(fps: np.ndarray, bits: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Places of linked fingerprints of a bucket, as pairs that hold its components together."""
    n = len(fps)
    found_a, found_b = [], []
    if n <= PAIRWISE:
        for k in range(0, n, 512):
            x, y = np.nonzero(_near(fps[k : k + 512, None], fps[None, :], bits))
            keep = x + k < y
            a, b = local_stars(x[keep] + k, y[keep])
            found_a.append(a)
            found_b.append(b)
    else:
        order = np.argsort(fps, kind="stable")
        ordered = fps[order]
        one = [np.uint64(1 << k) for k in range(64)]
        for flip in [np.uint64(0), *one, *(one[i] | one[j] for i in range(64) for j in range(i))]:
            at = np.searchsorted(ordered, ordered ^ flip)
            hit = (at < n) & (ordered[np.minimum(at, n - 1)] == ordered ^ flip)
            x, y = order[np.flatnonzero(hit)], order[at[hit]]
            keep = x < y
            found_a.append(x[keep])
            found_b.append(y[keep])
            if sum(map(len, found_a)) > 4 * n:
                a, b = local_stars(np.concatenate(found_a), np.concatenate(found_b))
                found_a, found_b = [a], [b]
    return local_stars(np.concatenate(found_a), np.concatenate(found_b))


#: Rows of one key that are compared in one go.
BUCKET = 50_000


def _finer(key: str, fp: str) -> F.Column:
    """Of a key, what its rows are cut by: the three parts of the segment that the key says nothing of."""
    cuts = []
    for k in range(3):
        start, width = SEGMENTS[(k + 2) % 3]
        sizes = [width - 2 * (width // 3), width // 3, width // 3]
        starts = [start, start + sizes[0], start + sizes[0] + sizes[1]]
        cuts.append(F.array(*[F.shiftrightunsigned(fp, s).bitwiseAND(F.lit((1 << n) - 1)) + F.lit((j + 1) << 10) for j, (s, n) in enumerate(zip(starts, sizes, strict=True))]))
    which = F.shiftright(key, 34)
    return F.when(which == 0, cuts[0]).when(which == 1, cuts[1]).otherwise(cuts[2])


def links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """distinct(fp, node) -> a, b: nodes whose fingerprints link, enough of them to give all components."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            fp, node = batch.column("fp").to_numpy(), batch.column("node").to_numpy()
            place, key = keys(fp.view(np.uint64))
            yield pa.record_batch([pa.array(key), pa.array(fp[place]), pa.array(node[place])], names=["key", "fp", "node"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []  # rows of the key that may go on in the next batch; at most `bucket`, but for what shares a part, too

        def of(key: np.ndarray, fp: np.ndarray, node: np.ndarray) -> pa.RecordBatch | None:
            cuts = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)]
            sizes = np.diff(cuts)
            found_a, found_b = [], []
            small = int(min(sizes.max(initial=1), 16))
            for s in range(1, small):  # buckets of up to 16 rows, all at once
                hit = np.flatnonzero((key[s:] == key[:-s]) & _near(fp[s:], fp[:-s], 2))
                found_a.append(node[hit])
                found_b.append(node[hit + s])
            for k in np.flatnonzero(sizes > 16):
                a, b = links_in_bucket(fp[cuts[k] : cuts[k + 1]])
                found_a.append(node[cuts[k] + a])
                found_b.append(node[cuts[k] + b])
            if found_a:
                a, b = local_stars(np.concatenate(found_a), np.concatenate(found_b))
                if len(a):
                    return pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])
            return None

        for batch in batches:
            if not batch.num_rows:
                continue
            key, part, fp, node = (batch.column(c).to_numpy() for c in ("key", "part", "fp", "node"))
            key, fp = key << 13 | part, fp.view(np.uint64)
            if key[0] == key[-1] and (not held or held[0][0][0] == key[0]):
                held.append((key, fp, node))
                continue
            last = int(np.searchsorted(key, key[-1]))
            out = of(*(np.concatenate(x) for x in zip(*held, (key[:last], fp[:last], node[:last]), strict=True)))
            held = [(key[last:], fp[last:], node[last:])]
            if out is not None:
                yield out
        if held and (out := of(*(np.concatenate(x) for x in zip(*held, strict=True)))) is not None:
            yield out

    keyed = distinct.select("fp", "node").mapInArrow(emit, "key long, fp long, node long")
    large = keyed.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > bucket)
    parted = keyed.join(large, "key", "left").withColumn("part", F.explode(F.when(F.col("rows").isNull(), F.array(F.lit(0).cast("long"))).otherwise(_finer("key", "fp"))))
    return parted.select("key", "part", "fp", "node").repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """docs(doc_id, text) -> doc_id, fp, component_id: the least doc_id reachable over links."""
    fps = hold(fingerprints(docs, shingle))
    known = fps.where("doc_id is not null")
    distinct = hold(known.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count("*").alias("c")))
    joined = components(links(distinct, bucket), "a", "b")
    of_fp = distinct.join(joined, "node", "left").select("fp", "c", F.coalesce("component", "node").alias("component_id"))
    found = salted_join(known, of_fp, ["fp"], fps.count()).select("doc_id", "fp", "component_id")
    result = stash(found.unionByName(fps.where("doc_id is null").withColumn("component_id", F.lit(None).cast("long"))), "components")
    release(fps, distinct)
    return result


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
