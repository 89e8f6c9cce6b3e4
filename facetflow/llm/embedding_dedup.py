"""Operator 1: near-duplicate vectors by an inverted multi-index.

Vectors are scaled to length 1 and cut into halves, each with a codebook of its
own; pairs of centroids form a grid of cells, and each vector is filed in the
cell of its two nearest centroids. A query visits cells in the order of a cost,
the sum over both halves of the squared distance to the border of a centroid's
region, by multi-sequence traversal: a heap over the two sorted lists. It stops
at a cost that reaches the target recall; vectors in the cells visited are
verified by cosine in double precision.

The cost is a lower bound of the squared distance. So with `recall` 1 the
traversal goes on to 2 (1 - threshold), and nothing is missed. Below 1 the bound
is calibrated on vectors turned by just the angle of the threshold, the hardest
links, so that a share `recall` of these is found. Of two linked vectors only
the one in the cell of the lower number looks for the other.

The grid grows with the rows, PER_CELL of them a cell: beyond CENTROIDS
centroids a half, each region is cut again by a second codebook, on what is
left of a vector behind its centroid. Codebooks are fitted on at most
`fit_rows` vectors (those with the least hashes); all are filed and all are
queries. Equal vectors are joined before. Large cells are split into blocks of
`block` vectors, and queries of a block come as a stream; links are counted,
and of them only stars are emitted.

Vectors of different lengths don't link. Each length has an index of its own;
of more than LENGTHS lengths, the rarer ones have a single cell, compared in
blocks. Vectors that are null, zero, or hold null or non-finite components link
with nothing. Rows that repeat a vec_id count as vectors of their own. A vector
with a null vec_id counts as a link of others and of its component, but never
names one: its component_id is the least vec_id reached, null if there is none.
An empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hold, picked, release, salted_join, stash, table, unstash
from .components import components, local_stars

THRESHOLD, RECALL = 0.95, 0.999
FIT_ROWS, PER_CELL, CENTROIDS, LENGTHS, BLOCK, SEED = 8192, 256, 256, 64, 2048, 11
#: Costs are rounded, so that equal rows cost the same in every task; the bound allows for it.
DIGITS, SLACK = 6, 1e-5


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by the largest component first, so that no square overflows."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def k_means(rows: np.ndarray, k: int, rounds: int = 12, seed: int = SEED) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = rows[rng.choice(len(rows), k, replace=False)].copy()
    for _ in range(rounds):
        nearest = ((centres * centres).sum(1) - 2 * rows @ centres.T).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, rows)
        count = np.bincount(nearest, minlength=k)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return np.unique(centres, axis=0)


def _borders(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Of each row and centre: the squared distance to the border between the centre's region and that of the nearest one. A lower bound of the distance to anything in the region."""
    far = (centres * centres).sum(1) - 2 * rows @ centres.T
    nearest = far.argmin(1)
    mine = np.arange(len(rows))
    apart = np.sqrt(np.maximum((centres * centres).sum(1)[nearest][:, None] + (centres * centres).sum(1) - 2 * centres[nearest] @ centres.T, 1e-18))
    border = np.maximum(far - far[mine, nearest][:, None], 0) / (2 * apart)
    border[mine, nearest] = 0
    return np.round(border * border, DIGITS)


class Book:
    """Codebook of one half, of one level or two. Regions are numbered by centroid, then centroid of the rest."""

    def __init__(self, rows: np.ndarray, k: int, most: int = CENTROIDS):
        first = min(k, most, len(rows))
        self.coarse = k_means(rows, first)
        self.fine = np.zeros((1, rows.shape[1]))
        if k > first and len(rows) > first:
            rest = rows - self.coarse[_borders(rows, self.coarse).argmin(1)]
            self.fine = k_means(rest, min(-(-k // first), most, len(rows)))
        self.size = len(self.coarse) * len(self.fine)

    def near(self, rows: np.ndarray, bound: float) -> list[tuple[list[int], list[float]]]:
        """Of each row: the regions that cost no more than the bound, cheapest first, and their costs. The first is the row's own."""
        ids: list[list[np.ndarray]] = [[] for _ in rows]
        costs: list[list[np.ndarray]] = [[] for _ in rows]
        coarse = _borders(rows, self.coarse)
        for c in range(len(self.coarse)):
            able = np.flatnonzero(coarse[:, c] <= bound)
            cost = np.maximum(coarse[able, c][:, None], _borders(rows[able] - self.coarse[c], self.fine)) if len(able) else np.zeros((0, 1))
            for r, of in zip(able.tolist(), cost, strict=True):
                good = np.flatnonzero(of <= bound)
                ids[r].append(c * len(self.fine) + good)
                costs[r].append(of[good])
        out = []
        for i, c in zip(ids, costs, strict=True):
            i, c = np.concatenate(i), np.concatenate(c)
            order = np.argsort(c, kind="stable")
            out.append((i[order].tolist(), c[order].tolist()))
        return out

    def home(self, rows: np.ndarray) -> np.ndarray:
        """The region of each row: the first of those without cost."""
        coarse = _borders(rows, self.coarse).argmin(1)
        return coarse * len(self.fine) + _borders(rows - self.coarse[coarse], self.fine).argmin(1)

    def cost(self, rows: np.ndarray, regions: np.ndarray) -> np.ndarray:
        """Of each row, the cost of one region."""
        c, f = np.divmod(regions, len(self.fine))
        mine = np.arange(len(rows))
        return np.maximum(_borders(rows, self.coarse)[mine, c], _borders(rows - self.coarse[c], self.fine)[mine, f])


class MultiIndex:
    def __init__(self, sample: np.ndarray, rows: int, threshold: float = THRESHOLD, recall: float = RECALL, per_cell: int = PER_CELL, most: int = CENTROIDS):
        self.cut = (sample.shape[1] + 1) // 2
        k = max(int(np.sqrt(rows / per_cell)), 1)
        self.books = [Book(h, k, most) for h in self._halves(sample)]
        self.bound = 2 * (1 - threshold) + SLACK
        if recall < 1:
            rng = np.random.default_rng(SEED)
            some = sample[rng.permutation(len(sample))[:4096]]
            side = rng.normal(size=some.shape)
            side -= (side * some).sum(1, keepdims=True) * some
            length = np.sqrt((side * side).sum(1, keepdims=True))
            turned = threshold * some + np.sqrt(1 - threshold**2) * np.divide(side, length, out=np.zeros_like(side), where=length > 0)
            a, b = self.cells(some), self.cells(turned)
            needed = np.where(a < b, self._cost(some, b), self._cost(turned, a))
            self.bound = min(self.bound, float(np.quantile(needed, recall, method="higher")) + 1e-6)

    def _halves(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return rows[:, : self.cut], rows[:, self.cut :]

    def cells(self, rows: np.ndarray) -> np.ndarray:
        first, second = (book.home(half) for book, half in zip(self.books, self._halves(rows), strict=True))
        return first * self.books[1].size + second

    def _cost(self, rows: np.ndarray, cells: np.ndarray) -> np.ndarray:
        regions = np.divmod(cells, self.books[1].size)
        return sum(book.cost(half, of) for book, half, of in zip(self.books, self._halves(rows), regions, strict=True))

    def visits(self, rows: np.ndarray) -> Iterator[list[int]]:
        """Cells of each row in the order of cost, up to the bound."""
        lists = [book.near(half, self.bound) for book, half in zip(self.books, self._halves(rows), strict=True)]
        for (a, x), (b, y) in zip(*lists, strict=True):
            heap, out = [(x[0] + y[0], 0, 0)], []
            while heap:
                cost, i, j = heapq.heappop(heap)
                if cost > self.bound:
                    break
                out.append(a[i] * self.books[1].size + b[j])
                if j + 1 < len(y):
                    heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
                if j == 0 and i + 1 < len(x):
                    heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))
            yield out


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of a batch by the length of their vectors."""
    n = batch.column("n").to_numpy()
    for size in np.unique(n).tolist():
        yield size, batch.take(pa.array(np.flatnonzero(n == size)))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, fit_rows: int = FIT_ROWS, block: int = BLOCK, per_cell: int = PER_CELL, centroids: int = CENTROIDS) -> DataFrame:
    """vectors(vec_id, embedding) -> vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    rows = picked(vectors, "vec_id", "embedding")
    kind = rows.schema["embedding"].dataType
    # Vectors travel in the precision they came in.
    dtype = np.dtype("<f4" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "<f8")
    v = F.col("embedding").cast("array<float>" if dtype.itemsize == 4 else "array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(dtype).tobytes()
            size = np.array([len(x) if x.is_valid else 0 for x in lists], np.int64) if lists.null_count else np.diff(lists.offsets.to_numpy())
            ends = np.cumsum(size) * dtype.itemsize
            raw = [flat[e - n : e] if n else None for e, n in zip(ends.tolist(), (size * dtype.itemsize).tolist(), strict=True)]
            key = [None if x is None else xxhash.xxh3_128_digest(x) for x in raw]
            yield pa.record_batch([batch.column("vec_id"), pa.array(key, pa.binary()), pa.array(size.astype(np.int32)), pa.array(raw, pa.binary())], names=["vec_id", "key", "n", "raw"])

    good = F.coalesce(v.isNotNull() & finite, F.lit(False))
    marks = hold(rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(good, v).alias("v")).mapInArrow(pack, "vec_id long, key binary, n int, raw binary"))
    alone = marks.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    distinct = stash(marks.where("key is not null").groupBy("key", "n", "raw").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies")).withColumn("node", F.monotonically_increasing_id()), "vectors")

    def matrix(column: pa.Array) -> np.ndarray:
        return unit(np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1))

    # An index for each of the commonest lengths, if a single block doesn't hold them.
    indexes = {}
    for r in distinct.groupBy("n").agg(F.count("*").alias("c")).where(F.col("c") > block).orderBy(F.desc("c"), "n").limit(LENGTHS).collect():
        sample = distinct.where(F.col("n") == r["n"]).select("raw").orderBy(F.xxhash64("raw"), "raw").limit(fit_rows).toArrow()
        indexes[r["n"]] = MultiIndex(matrix(sample.column("raw").combine_chunks()), r["c"], threshold, recall, per_cell, centroids)
    sent = spark.sparkContext.broadcast(indexes)  # at most LENGTHS x 2 books of 2 x CENTROIDS centroids

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, part in _by_length(batch):
                m = sent.value.get(n)
                cells = m.cells(matrix(part.column("raw"))) if m else np.zeros(part.num_rows, np.int64)
                yield pa.record_batch([part.column("n"), pa.array(cells)], names=["n", "cell"])

    blocks = stash(distinct.select("n", "raw").mapInArrow(home, "n int, cell long").groupBy("n", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).where("blocks > 1"), "blocks")  # written, so that its size is known when it is joined

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector to its own cell, as a resident, and as a query to this one and to those that it visits of higher numbers."""
        for whole in batches:
            for _, of_length in _by_length(whole):
                m = sent.value.get(of_length.column("n")[0].as_py())
                for k in range(0, of_length.num_rows, 512):
                    batch = of_length.slice(k, 512)
                    place, cell, own, query = [], [], [], []
                    visits = m.visits(matrix(batch.column("raw"))) if m else ([0] for _ in range(batch.num_rows))
                    homes = m.cells(matrix(batch.column("raw"))).tolist() if m else [0] * batch.num_rows
                    for r, (at, cells) in enumerate(zip(homes, visits, strict=True)):
                        to = [at, at, *(c for c in cells if c > at)]
                        place += [r] * len(to)
                        cell += to
                        query += [False] + [True] * (len(to) - 1)
                        own += [True, True] + [False] * (len(to) - 2)
                    taken = batch.take(pa.array(place))
                    yield pa.record_batch([pa.array(cell, pa.int64()), pa.array(query), pa.array(own), *taken.columns], names=["cell", "query", "own", *taken.schema.names])

    dealt = distinct.select("n", "node", "copies", "raw").mapInArrow(deal, "cell long, query boolean, own boolean, n int, node long, copies long, raw binary")
    count = F.coalesce("blocks", F.lit(1))
    mine = F.when(F.col("own"), F.pmod(F.xxhash64("node"), count)).otherwise(0).cast("int")
    # A query of its own cell goes to its own block and those behind it.
    parted = dealt.join(blocks, ["n", "cell"], "left").withColumn("mine", mine).withColumn("part", F.explode(F.when(F.col("query"), F.sequence(F.col("mine"), count - 1)).otherwise(F.array("mine"))))
    parted = parted.select("n", "cell", "part", "query", (F.col("own") & (F.col("part") == F.col("mine"))).alias("same"), "node", "copies", "raw")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of each block: residents, then queries. -> node, other, links: a link between nodes, or more vectors that node links with."""
        now, held = None, []
        residents: tuple | None = None

        def compare(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            node, copies, x, same = batch.column("node").to_numpy(), batch.column("copies").to_numpy(), matrix(batch.column("raw")), batch.column("same").to_numpy(zero_copy_only=False)
            r_node, r_copies, r_unit = residents
            for k in range(0, len(node), 256):
                q, r = np.nonzero(x[k : k + 256] @ r_unit.T >= threshold)
                q += k
                other = node[q] != r_node[r]
                q, r = q[other], r[other]
                if not len(q):
                    continue
                once = ~same[q]  # within a block both come as queries
                ids, inverse = np.unique(np.concatenate([node[q], r_node[r[once]]]), return_inverse=True)
                links = np.bincount(inverse, np.concatenate([r_copies[r], copies[q[once]]])).astype(np.int64)
                a, b = local_stars(node[q], r_node[r])
                yield pa.record_batch([pa.array(np.r_[ids, a]), pa.array([None] * len(ids) + b.tolist(), pa.int64()), pa.array(np.r_[links, np.zeros(len(a), np.int64)])], names=["node", "other", "links"])

        for batch in batches:
            if not batch.num_rows:
                continue
            n, cell, part, query = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n", "cell", "part", "query"))
            cuts = np.r_[0, np.flatnonzero((n[1:] != n[:-1]) | (cell[1:] != cell[:-1]) | (part[1:] != part[:-1]) | (query[1:] != query[:-1])) + 1, len(cell)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                some = batch.slice(s, e - s)
                if (n[s], cell[s], part[s]) != now:
                    now, held, residents = (n[s], cell[s], part[s]), [], None
                if not query[s]:
                    held.append(some)
                elif held:
                    if residents is None:
                        residents = (np.concatenate([b.column("node").to_numpy() for b in held]), np.concatenate([b.column("copies").to_numpy() for b in held]), np.concatenate([matrix(b.column("raw")) for b in held]))
                    yield from compare(some)

    key = ["n", "cell", "part"]
    found = stash(parted.repartition(*key).sortWithinPartitions(*key, "query").mapInArrow(verify, "node long, other long, links long"), "links")
    links = found.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.where("other is not null"), "node", "other")
    of_node = distinct.select("key", "node", "least", F.col("copies").alias("c")).join(links, "node", "left").join(joined, "node", "left")
    of_node = hold(of_node.select("key", "least", "c", (F.coalesce("links", F.lit(0)) + F.col("c") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")))
    names = of_node.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("c"))
    named = salted_join(of_node.select("component", "key", "n_links", F.col("c").alias("copies")), names, ["component"], of_node.count()).select("key", "n_links", "component_id", F.col("copies").alias("c"))
    linked = salted_join(marks.where("key is not null").select("key", "vec_id"), named, ["key"], marks.count()).select("vec_id", "n_links", "component_id")
    result = stash(linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))), "result")
    release(marks, of_node)
    unstash(distinct, blocks, found)
    return result


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: All pairs, so for small tables; vectors are cast to double first.
SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS k, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.k, b.k AS other FROM g a JOIN g b ON a.k <> b.k AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT k, k AS other FROM v UNION SELECT r.k, l.other FROM r JOIN l ON r.other = l.k),
c AS (SELECT r.k, min(v.vec_id) AS component_id FROM r JOIN v ON r.other = v.k GROUP BY r.k),
n AS (SELECT k, count(*) AS n FROM l GROUP BY k)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, component_id, v.vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN c ON v.k = c.k LEFT JOIN n ON v.k = n.k"""
