"""Operators over tables of many small graphs, and over reports of runs. Built-in functions only.

A graph is a row: crop, vertices (id, x, y, degree, radius, shape), edges (u, w)
and ring, the label or null. graphs() gathers such rows from long tables, with
one shuffle of each on crop; what follows looks at one row at a time, so it
shuffles nothing more. Positions, radii and shapes may be null where an
operator doesn't need them. Vertices are in the order of their ids, edges in
the order of (u, w), both as sorted by graphs().
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import records as R

# Bounds of degrees and rings, distances in pixels.
LEAST_DEGREE, LEAST_RING, GREATEST_RING = 5, 3, 14
LONGEST, BODY, CLEAR, NEAR, BRIDGE, NODE_REACH, EDGE_REACH = 210, 4, 4, 25, 16, 18, 10
VERTEX = ("id", "x", "y", "degree", "radius", "shape")


def graphs(nodes: DataFrame, edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """nodes(crop, id, ...), edges(crop, u, w), labels(crop, ring) -> a row a crop that has nodes."""
    lacking = [F.lit(None).alias(c) for c in VERTEX if c not in nodes.columns]
    v = nodes.select("*", *lacking).groupBy("crop").agg(F.sort_array(F.collect_list(F.struct(*VERTEX))).alias("vertices"))
    e = edges.groupBy("crop").agg(F.sort_array(F.collect_list(F.struct("u", "w"))).alias("edges"))
    whole = v.join(e, "crop", "left").withColumn("edges", F.coalesce("edges", F.array().cast("array<struct<u:int,w:int>>")))
    return whole.join(labels.select("crop", "ring"), "crop", "left") if labels is not None else whole.withColumn("ring", F.lit(None).cast("int"))


def vertices(g: DataFrame) -> DataFrame:
    return g.select("crop", F.inline("vertices"))


def edges(g: DataFrame) -> DataFrame:
    return g.select("crop", F.inline("edges"))


def _let(value: Column, f) -> Column:
    """f of a value that is computed once, not wherever f names it."""
    return F.transform(F.array(value), f)[0]


def _total(array: str, value) -> Column:
    return F.aggregate(array, F.lit(0).cast("long"), lambda a, v: a + value(v))


def sums(g: DataFrame) -> DataFrame:
    """Counts, sum of degrees, attachments and implied ring."""
    v, e, d = F.size("vertices").cast("long"), F.size("edges").cast("long"), _total("vertices", lambda v: v["degree"])
    return g.select("crop", "ring", v.alias("n_v"), e.alias("n_e"), d.alias("sum_d"), (d - 2 * e).alias("e_att"), (d - e - 3 * v + 3).alias("implied_ring"))


def in_range(ring: Column) -> Column:
    return ring.between(LEAST_RING, GREATEST_RING)


def infer_ring(g: DataFrame) -> DataFrame:
    """The implied ring where it is possible at all, else null."""
    return sums(g).select("crop", F.when(in_range(F.col("implied_ring")), F.col("implied_ring")).alias("ring"))


def identity(s: DataFrame) -> DataFrame:
    """Of sums(): totals with the ring, whether edges are 3 V - r - 3, and that as a line of text."""
    v, e = F.col("n_v") + F.col("implied_ring"), F.col("n_e") + F.col("e_att") + F.col("implied_ring")
    want = 3 * v - F.col("implied_ring") - 3
    line = F.format_string("[%s] V=%d, E=%d, E*=%d, r=%d", F.when(e == want, "VALID").otherwise("INVALID"), v, e, want, F.col("implied_ring"))
    return s.select("crop", v.alias("v_total"), e.alias("e_total"), (e == want).alias("holds"), line.alias("line"))


def ring_label_check(s: DataFrame) -> DataFrame:
    delta = F.col("implied_ring") - F.col("ring")
    return s.where("ring is not null").select("crop", delta.alias("ring_delta"), F.when(delta > 0, "missed").when(delta < 0, "phantom").alias("verdict"))


def with_inner(g: DataFrame) -> DataFrame:
    """vertices with inner, the number of edges at each."""
    at = lambda v, end: F.size(F.filter("edges", lambda e: e[end] == v["id"]))
    return g.withColumn("vertices", F.transform("vertices", lambda v: F.struct(*[v[c].alias(c) for c in VERTEX], (at(v, "u") + at(v, "w")).cast("long").alias("inner"))))


def internal_degree(g: DataFrame) -> DataFrame:
    return vertices(with_inner(g))


def attachment(g: DataFrame) -> DataFrame:
    """Of each crop: whether no vertex has too many edges, the sum of what is free, and the least."""
    free = F.transform("vertices", lambda v: v["degree"] - v["inner"])
    return with_inner(g).select("crop", free.alias("free")).select("crop", F.forall("free", lambda a: a >= 0).alias("ok"), F.aggregate("free", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.array_min("free").alias("least"))


def structural_failures(g: DataFrame) -> DataFrame:
    """crop, tag, n: what stops a graph before anything else is asked."""
    ids = F.transform("vertices", lambda v: v["id"])
    ends = F.transform("edges", lambda e: F.struct(F.least(e["u"], e["w"]).alias("u"), F.greatest(e["u"], e["w"]).alias("w")))
    count = {
        "EMPTY": F.when(F.size("vertices") == 0, 1).otherwise(0),
        "DUPLICATE_VERTEX_IDS": F.size(ids) - F.size(F.array_distinct(ids)),
        "SELF_LOOP": F.size(F.filter("edges", lambda e: e["u"] == e["w"])),
        "DANGLING_EDGE": F.size(F.filter("edges", lambda e: ~F.array_contains(ids, e["u"]) | ~F.array_contains(ids, e["w"]))),
        "DUPLICATE_EDGE": F.size(ends) - F.size(F.array_distinct(ends)),
        "DEGREE_TOO_SMALL": F.size(F.filter("vertices", lambda v: v["degree"] < LEAST_DEGREE)),
    }
    found = F.array(*[F.struct(F.lit(t).alias("tag"), c.cast("long").alias("n")) for t, c in count.items()])
    return g.select("crop", F.inline(F.filter(found, lambda f: f["n"] > 0)))


def _point(v: Column) -> Column:
    return F.struct(v["x"].cast("long").alias("x"), v["y"].cast("long").alias("y"))


def placed_edges(g: DataFrame) -> DataFrame:
    """edges with the places a and b of their ends, and the radii ra and rb; those of unknown vertices go."""
    known = F.map_from_entries(F.transform("vertices", lambda v: F.struct(v["id"], F.struct(v["x"].cast("long").alias("x"), v["y"].cast("long").alias("y"), v["radius"].alias("r")))))
    put = lambda at: F.transform("edges", lambda e: F.struct(e["u"].alias("u"), e["w"].alias("w"), F.try_element_at(at, e["u"]).alias("a"), F.try_element_at(at, e["w"]).alias("b")))
    return g.withColumn("edges", F.filter(_let(known, put), lambda e: e["a"].isNotNull() & e["b"].isNotNull()))


def _turn(p, q, r) -> Column:
    """Side of r seen along p to q."""
    return F.signum(((q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"])).cast("double"))


def crossing_edges(g: DataFrame) -> DataFrame:
    """Pairs of edges without a common end that cross as segments; integer positions."""

    def cross(e, f):
        apart = (e["u"] != f["u"]) & (e["u"] != f["w"]) & (e["w"] != f["u"]) & (e["w"] != f["w"])
        return apart & (_turn(e["a"], e["b"], f["a"]) * _turn(e["a"], e["b"], f["b"]) < 0) & (_turn(f["a"], f["b"], e["a"]) * _turn(f["a"], f["b"], e["b"]) < 0)

    pair = lambda e, f: F.struct(e["u"].alias("u1"), e["w"].alias("w1"), f["u"].alias("u2"), f["w"].alias("w2"))
    every = F.flatten(F.transform("edges", lambda e, i: F.transform(F.filter(F.slice("edges", i + 2, F.size("edges")), lambda f: cross(e, f)), lambda f: pair(e, f))))
    return placed_edges(g).select("crop", F.inline(every))


def _squared(a, b) -> Column:
    return (a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"])


def pair_candidates(g: DataFrame) -> DataFrame:
    """Pairs of vertices near enough for an edge whose bodies don't touch."""
    able = lambda a, b: (_squared(a, b) <= LONGEST * LONGEST) & (_squared(a, b) > (a["radius"] + b["radius"] + 2 * BODY + CLEAR) * (a["radius"] + b["radius"] + 2 * BODY + CLEAR))
    every = F.flatten(F.transform("vertices", lambda a, k: F.transform(F.filter(F.slice("vertices", k + 2, F.size("vertices")), lambda b: able(a, b)), lambda b: F.struct(a["id"].alias("i"), b["id"].alias("j")))))
    return g.select("crop", F.inline(every))


def occluded(g: DataFrame) -> DataFrame:
    """Edges, as chords, that run through the body of a third vertex, the ends' own bodies left out."""

    def hidden(e, k):
        a, b = e["a"], e["b"]
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        square = dx * dx + dy * dy
        long = F.sqrt(square.cast("double"))
        first, last = (a["r"] + BODY) / long, 1 - (b["r"] + BODY) / long
        t = ((k["x"] - a["x"]) * dx + (k["y"] - a["y"]) * dy) / square
        side = dx * (k["y"] - a["y"]) - dy * (k["x"] - a["x"])
        return (k["id"] != e["u"]) & (k["id"] != e["w"]) & (square > 0) & (first < last) & (t >= first) & (t <= last) & (side * side < k["radius"].cast("long") * k["radius"] * square)

    return placed_edges(g).select("crop", F.inline(F.filter("edges", lambda e: F.exists("vertices", lambda k: hidden(e, k))))).select("crop", "u", "w")


def not_near(candidates: DataFrame, found: DataFrame, reach: int = NEAR) -> DataFrame:
    """candidates(crop, id, x, y) without those nearer than reach to one of found."""
    places = found.groupBy("crop").agg(F.collect_list(F.struct("x", "y")).alias("_found"))
    far = ~F.coalesce(F.exists("_found", lambda p: _squared(p, {"x": F.col("x"), "y": F.col("y")}) < reach * reach), F.lit(False))
    return candidates.join(places, "crop", "left").where(far).drop("_found")


def spaced(candidates: DataFrame, reach: int = NEAR) -> DataFrame:
    """In the order of id, each candidate that is not nearer than reach to one taken before."""
    some = candidates.groupBy("crop").agg(F.sort_array(F.collect_list(F.struct("id", "x", "y"))).alias("c"))
    none = F.array().cast(some.schema["c"].dataType)
    taken = F.aggregate("c", none, lambda a, c: F.when(F.exists(a, lambda t: _squared(t, c) < reach * reach), a).otherwise(F.concat(a, F.array(c))))
    return some.select("crop", F.inline(taken))


def bridges(loose: DataFrame, reach: int = BRIDGE) -> DataFrame:
    """loose(crop, id, owner, x, y), ends of strokes at one vertex each -> edges between owners whose ends face each other."""
    some = loose.groupBy("crop").agg(F.sort_array(F.collect_list(F.struct("id", "owner", "x", "y"))).alias("c"))
    edge = lambda a, b: F.struct(F.least(a["owner"], b["owner"]).alias("u"), F.greatest(a["owner"], b["owner"]).alias("w"))
    every = F.flatten(F.transform("c", lambda a, k: F.transform(F.filter(F.slice("c", k + 2, F.size("c")), lambda b: (a["owner"] != b["owner"]) & (_squared(a, b) <= reach * reach)), lambda b: edge(a, b))))
    return some.select("crop", F.inline(F.array_distinct(every)))


def node_at(g: DataFrame, probes: DataFrame) -> DataFrame:
    """probes(crop, px, py) -> the nearest vertex, if it is near enough."""
    point = {"x": F.col("px"), "y": F.col("py")}
    best = F.array_min(F.transform("vertices", lambda v: F.struct(_squared(v, point).alias("d2"), v["id"].alias("id"))))
    return probes.join(g.select("crop", "vertices"), "crop").select("crop", "px", "py", best.alias("b")).select("crop", "px", "py", "b.id", "b.d2").where(F.col("d2") < NODE_REACH * NODE_REACH)


def edge_at(g: DataFrame, probes: DataFrame) -> DataFrame:
    """probes(crop, px, py) -> the nearest edge, the first of equals, if it is near enough; squared distances are rounded to six digits."""

    def away(e):
        a, b = e["a"], e["b"]
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        square = dx * dx + dy * dy
        t = F.when(square == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("px") - a["x"]) * dx + (F.col("py") - a["y"]) * dy) / F.nullif(square, F.lit(0)))))
        x, y = F.col("px") - a["x"] - t * dx, F.col("py") - a["y"] - t * dy
        return F.round(x * x + y * y, 6)

    best = F.array_min(F.transform("edges", lambda e: F.struct(away(e).alias("d2"), e["u"].alias("u"), e["w"].alias("w"))))
    return probes.join(placed_edges(g).select("crop", "edges"), "crop").select("crop", "px", "py", best.alias("b")).select("crop", "px", "py", "b.*").where(F.col("d2") < EDGE_REACH * EDGE_REACH)


def rotation(g: DataFrame) -> DataFrame:
    """Darts (u, w) with their place in the turn around u, by angle, then in the order of the edges."""
    angle = lambda p, q: F.atan2((q["y"] - p["y"]).cast("double"), (q["x"] - p["x"]).cast("double"))
    dart = lambda e, u, w, p, q, i: F.struct(e[u].alias("u"), angle(e[p], e[q]).alias("angle"), i.alias("seq"), e[w].alias("w"))
    darts = F.sort_array(F.flatten(F.transform("edges", lambda e, i: F.array(dart(e, "u", "w", "a", "b", i), dart(e, "w", "u", "b", "a", i)))))
    turned = placed_edges(g).select("crop", darts.alias("darts"))
    place = F.transform("darts", lambda d, i: F.struct(d["u"].alias("u"), d["w"].alias("w"), (i + 1 - F.size(F.filter("darts", lambda o: o["u"] < d["u"]))).cast("int").alias("place")))
    return turned.select("crop", F.inline(place))


def outer_vertex(g: DataFrame) -> DataFrame:
    """The least vertex by (x, y, id), which is on the outer face."""
    return g.select("crop", F.array_min(F.transform("vertices", lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"), v["id"].alias("id")))).alias("v")).select("crop", "v.id", "v.x", "v.y")


def failure_histogram(run: DataFrame) -> DataFrame:
    """run(crop, failures) -> tag, n (occurrences), crops."""
    return run.select("crop", F.explode("failures").alias("f")).groupBy(R.tag(F.col("f")).alias("tag")).agg(F.count("*").alias("n"), F.countDistinct("crop").alias("crops"))


def compare_histograms(new: DataFrame, base: DataFrame) -> DataFrame:
    """tag, new_count, base_count of all crops of each run, the most frequent of the baseline first."""
    n, b = (failure_histogram(r).select("tag", F.col("n").alias(c)) for r, c in ((new, "new_count"), (base, "base_count")))
    both = n.join(b, "tag", "full").select("tag", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("new_count", "base_count")))
    return both.orderBy(F.desc("base_count"), "tag")


def last_of_each(run: DataFrame, order: str) -> DataFrame:
    """One row a crop: the last by order."""
    names = [c for c in run.columns if c != "crop"]
    return run.groupBy("crop").agg(F.max_by(F.struct(*names), order).alias("r")).select("crop", "r.*")


def transitions(new: DataFrame, base: DataFrame) -> DataFrame:
    """Runs (crop, ok) -> crops of both runs: crop, new, base, and change: fixed, broken or null."""
    both = new.select("crop", F.coalesce("ok", F.lit(False)).alias("new")).join(base.select("crop", F.coalesce("ok", F.lit(False)).alias("base")), "crop")
    return both.withColumn("change", F.when(F.col("new") & ~F.col("base"), "fixed").when(~F.col("new") & F.col("base"), "broken"))


def compare_batteries(new: DataFrame, base: DataFrame, samples: int = 8) -> DataFrame:
    """One row: crops, new_pass, base_pass, fixed, broken, and the first few that broke."""
    t = transitions(new, base)
    counts = [F.count("*").alias("crops"), F.count_if("new").alias("new_pass"), F.count_if("base").alias("base_pass"), *(F.count_if(F.col("change") == c).alias(c) for c in ("fixed", "broken"))]
    some = t.where("change = 'broken'").orderBy("crop").limit(samples).agg(F.sort_array(F.collect_list("crop")).alias("broken_samples"))  # at most `samples` rows
    return t.agg(*counts).join(F.broadcast(some))


def batch_summary(run: DataFrame) -> DataFrame:
    """run(crop, ok, ring, n_nodes, failures) -> one row of counts of crops."""
    has = lambda *tags: F.count_if(F.exists("failures", lambda f: R.tag(f).isin(*tags)))
    ok = F.count_if("ok")
    return run.agg(
        F.count("*").alias("total"), ok.alias("valid"), F.count_if(F.col("ok") & F.col("ring").isNotNull()).alias("valid_labeled"), F.count_if(F.col("n_nodes") == 0).alias("no_nodes"), has("DEGREE_OVERFLOW").alias("overflow"),
        has("RING_TOO_SMALL", "RING_TOO_LARGE").alias("out_of_range"), has("RING_MISMATCH").alias("mismatch"), has("DISCONNECTED").alias("disconnected"), has("NONPLANAR").alias("nonplanar"), has("ERROR").alias("errors"),
        F.round(100.0 * ok / F.count("*"), 4).alias("pct"),
    )


def ranked(rows: DataFrame, *order, name: str = "place") -> DataFrame:
    """rows with their place in the whole order, from 1, without one task for all.

    Rows are dealt by ranges, sorted within each, and counted; the sorted rows
    stay on the executors' disks, since both the counts and the result read them.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).persist(StorageLevel.DISK_ONLY)
    part = F.shiftright("_at", 33)
    sizes = sorted_rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row a partition
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    placed = sorted_rows.withColumn("_part", part).join(F.broadcast(before), "_part")
    return placed.withColumn(name, (F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("long")).drop("_part", "_at", "_before")


def queue(run: DataFrame, skip_empty: bool = False) -> DataFrame:
    """run(crop, ok, note, failures[, n_nodes]): what a person has to look at, in order. Clean passes are left out; passes that ask to be verified come first."""
    rows = run.where(R.in_queue(F.col("ok"), F.col("note")))
    rows = rows.where("n_nodes > 0") if skip_empty else rows
    key = R.queue_order(F.col("ok"), F.col("note"), F.col("failures"))
    return ranked(rows.select("crop", key["p0"].alias("p"), key["p1"].alias("bad")), "p", "bad", "crop")


def of_files(queue_rows: DataFrame, files: DataFrame) -> DataFrame:
    """The rows whose crop is a file that exists."""
    return queue_rows.join(files.select("crop").distinct(), "crop", "left_semi")


def edge_difference(new: DataFrame, base: DataFrame) -> DataFrame:
    """Edges of one run only, with `side`: new or base."""
    a, b = new.select("crop", "u", "w"), base.select("crop", "u", "w")
    return a.subtract(b).withColumn("side", F.lit("new")).unionByName(b.subtract(a).withColumn("side", F.lit("base")))


def golden_pairs(golden: DataFrame, run: DataFrame, reach: int = NEAR) -> DataFrame:
    """golden and run, graphs both, joined on crop: candidates (d2, gi, di) within reach, sorted, and pairs taken from them, each vertex once. Places in the lists count, not ids."""
    both = golden.select("crop", F.col("vertices").alias("gv"), F.col("edges").alias("ge")).join(run.select("crop", F.col("vertices").alias("rv"), F.col("edges").alias("re")), "crop")
    every = F.flatten(F.transform("gv", lambda g, i: F.transform("rv", lambda r, j: F.struct(_squared(g, r).alias("d2"), i.cast("int").alias("gi"), j.cast("int").alias("di")))))
    both = both.withColumn("candidates", F.sort_array(F.filter(every, lambda p: p["d2"] <= reach * reach)))
    none = F.array().cast(both.schema["candidates"].dataType)
    taken = F.aggregate("candidates", none, lambda a, p: F.when(F.exists(a, lambda t: (t["gi"] == p["gi"]) | (t["di"] == p["di"])), a).otherwise(F.concat(a, F.array(p))))
    return both.withColumn("pairs", taken)


def match_nodes(golden: DataFrame, run: DataFrame, reach: int = NEAR) -> DataFrame:
    """crop, gi, di, d2 of the vertices that were matched."""
    return golden_pairs(golden, run, reach).select("crop", F.inline("pairs"))


def golden_counts(golden: DataFrame, run: DataFrame) -> DataFrame:
    """Of each golden crop: missing (not in the run, nothing counted), and true and false positives and negatives of nodes, shapes and edges. Edges name ids."""

    def index(v):
        return F.map_from_entries(F.transform(v, lambda x, i: F.struct(x["id"], i.cast("int"))))

    unordered = lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    to = F.map_from_entries(F.transform("pairs", lambda p: F.struct(p["di"], p["gi"])))
    end = lambda maps, e, c: F.try_element_at(maps["to"], F.try_element_at(maps["ids"], e[c]))
    whole = lambda maps, e: F.when(end(maps, e, "u").isNotNull() & end(maps, e, "w").isNotNull(), unordered(end(maps, e, "u"), end(maps, e, "w"))).otherwise(unordered(F.lit(None).cast("int"), F.lit(None).cast("int")))
    m = golden_pairs(golden, run)
    m = m.withColumn("mapped", _let(F.struct(to.alias("to"), index("rv").alias("ids")), lambda maps: F.transform("re", lambda e: whole(maps, e))))
    known = F.array_distinct(F.filter("mapped", lambda e: e["a"].isNotNull()))
    wanted = F.array_distinct(_let(index("gv"), lambda ids: F.transform("ge", lambda e: unordered(F.try_element_at(ids, e["u"]), F.try_element_at(ids, e["w"])))))
    m = m.withColumns({"known": known, "wanted": wanted})
    n = F.size("pairs")
    counts = {
        "tp_n": n, "fp_n": F.size("rv") - n, "fn_n": F.size("gv") - n, "shape_ok": F.size(F.filter("pairs", lambda p: F.get("gv", p["gi"])["shape"].eqNullSafe(F.get("rv", p["di"])["shape"]))), "shape_n": n,
        "tp_e": F.size(F.array_intersect("known", "wanted")), "fp_e": F.size(F.array_except("known", "wanted")) + F.size(F.filter("mapped", lambda e: e["a"].isNull())), "fn_e": F.size(F.array_except("wanted", "known")),
    }
    found = m.select("crop", *(c.cast("long").alias(k) for k, c in counts.items()))
    return golden.select("crop").join(found, "crop", "left").select("crop", F.col("tp_n").isNull().alias("missing"), *(F.coalesce(k, F.lit(0)).alias(k) for k in counts))


def score_golden(golden: DataFrame, run: DataFrame) -> DataFrame:
    """One row: crops, missing, counts, precision and recall of nodes and edges over all crops, and share of shapes; nothing over nothing is 0."""
    names = ("tp_n", "fp_n", "fn_n", "shape_ok", "shape_n", "tp_e", "fp_e", "fn_e")
    total = golden_counts(golden, run).agg(F.count("*").alias("crops"), F.count_if("missing").alias("missing"), *(F.sum(c).alias(c) for c in names))
    share = lambda a, b: F.round(F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b))).otherwise(0.0), 6)
    return total.withColumns({"p_n": share("tp_n", "fp_n"), "r_n": share("tp_n", "fn_n"), "p_e": share("tp_e", "fp_e"), "r_e": share("tp_e", "fn_e"), "shapes": F.round(F.when(F.col("shape_n") > 0, F.col("shape_ok") / F.col("shape_n")).otherwise(0.0), 6)})


def merge_labels(old: DataFrame, new: DataFrame, force: bool = False) -> DataFrame:
    """Label maps (crop, ring) -> crop, ring, conflict: an old label stays, unless forced; it conflicts with another one."""
    both = old.select("crop", F.col("ring").alias("o")).join(new.select("crop", F.col("ring").alias("n"), F.lit(True).alias("given")), "crop", "full")
    conflict = F.col("o").isNotNull() & F.coalesce("given", F.lit(False)) & ~F.col("o").eqNullSafe(F.col("n"))
    return both.select("crop", F.when(F.col("given") & (F.lit(force) | ~conflict), F.col("n")).otherwise(F.col("o")).alias("ring"), (conflict & ~F.lit(force)).alias("conflict"))


def enrich(annotations: DataFrame, index: DataFrame) -> DataFrame:
    """annotations(crop, reducibility), index(crop, figure, position, letter): a letter of its own wins, the figure's name comes from the index."""
    joined = annotations.join(index.select("crop", "figure", "position", "letter"), "crop", "left")
    name = F.when(F.col("figure").isNotNull(), F.concat(F.lit("Table U "), F.col("figure").cast("string"), F.lit("-"), F.col("position").cast("string")))
    return joined.select("crop", F.coalesce("reducibility", "letter").alias("reducibility"), "figure", "position", name.alias("figure_ref"))


def census_progress(labels: DataFrame, census: DataFrame) -> DataFrame:
    """labels(ring), census(bucket, expected) -> bucket, n, expected."""
    have = labels.groupBy(R.census_bucket(F.col("ring")).alias("bucket")).agg(F.count("*").alias("n"))
    return F.broadcast(census).join(have, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.col("expected").cast("long").alias("expected"))


def pruned(g: DataFrame, extra: Column) -> DataFrame:
    """Graphs without vertices that `extra`, a condition on the struct v, names and that have fewer than two edges; ids anew from 0, edges follow."""
    g = with_inner(g)
    kept = F.filter("vertices", lambda v: ~extra(v) | (v["inner"] >= 2))
    new = lambda vs: F.map_from_entries(F.transform(vs, lambda v, i: F.struct(v["id"], i.cast("int"))))
    end = lambda m, e, c: F.try_element_at(m, e[c]).alias(c)
    moved = lambda m: F.filter(F.transform("edges", lambda e: F.struct(end(m, e, "u"), end(m, e, "w"))), lambda e: e["u"].isNotNull() & e["w"].isNotNull())
    renamed = lambda vs: F.transform(vs, lambda v, i: F.struct(i.cast("int").alias("id"), *[v[c].alias(c) for c in VERTEX[1:]], v["id"].alias("old")))
    both = _let(kept, lambda vs: F.struct(renamed(vs).alias("vertices"), _let(new(vs), moved).alias("edges")))
    return g.select("crop", both.alias("g"), "ring").select("crop", "g.vertices", "g.edges", "ring")


def first_passing(attempts: DataFrame) -> DataFrame:
    """attempts(crop, attempt, ok) -> the first attempt that passes, else 0."""
    return attempts.groupBy("crop").agg(F.coalesce(F.min(F.when(F.col("ok"), F.col("attempt"))), F.lit(0)).alias("attempt"))


def signed_area(g: DataFrame) -> DataFrame:
    """Twice the area of the walk along the vertices in their order."""
    nxt = lambda i: F.get("vertices", F.pmod(i + 1, F.size("vertices")))
    parts = F.transform("vertices", lambda v, i: v["x"].cast("long") * nxt(i)["y"] - nxt(i)["x"].cast("long") * v["y"])
    return g.select("crop", F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x).alias("doubled"))


def nearest_centre(values: Column, centres: list[float]) -> Column:
    """Place of the nearest of a few centres, the first of equals."""
    return F.array_min(F.array(*[F.struct(F.abs(values - c).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(centres)]))["k"]


def good_box(x: Column, y: Column, w: Column, h: Column) -> Column:
    # Area, height and shape of a drawing.
    return (w * h > 8000) & (w * h < 1000000) & (h >= 150) & (w / h > 0.4) & (w / h < 2.5)


def reading_order(boxes: DataFrame) -> DataFrame:
    """boxes(page, id, x, y, ...) with their place on the page, by lines of 100 pixels."""
    return boxes.withColumn("place", F.row_number().over(Window.partitionBy("page").orderBy(F.floor(F.col("y") / 100), "x", "id")).cast("long"))


def padded(x: Column, y: Column, w: Column, h: Column, width: int, height: int, pad: int = 10) -> list[Column]:
    return [F.greatest(F.lit(0), x - pad).alias("x0"), F.greatest(F.lit(0), y - pad).alias("y0"), F.least(F.lit(width), x + w + pad).alias("x1"), F.least(F.lit(height), y + h + pad).alias("y1")]


def checks(g: DataFrame) -> DataFrame:
    """The layers of the battery that columns can express, for sane graphs: crop, ring, n_nodes, implied_ring, failures, ok, note. battery.report() has them all."""
    g = with_inner(g)
    v, e, d = F.size("vertices").cast("long"), F.size("edges").cast("long"), _total("vertices", lambda v: v["degree"])
    g = g.withColumns({"implied_ring": d - e - 3 * v + 3, "e_att": d - 2 * e})
    r = F.col("implied_ring")
    some = lambda test, text: F.when(test, F.array(text)).otherwise(F.array().cast("array<string>"))
    over = F.transform(F.filter("vertices", lambda v: v["inner"] > v["degree"]), lambda v: F.concat(F.lit("DEGREE_OVERFLOW: vertex "), v["id"].cast("string")))
    failures = F.concat(
        over, some(F.col("e_att") < 0, F.lit("NEGATIVE_ATTACHMENT")), some(r < LEAST_RING, F.lit("RING_TOO_SMALL")), some(r > GREATEST_RING, F.lit("RING_TOO_LARGE")),
        some(F.coalesce(r != F.col("ring"), F.lit(False)), F.lit("RING_MISMATCH")),
    )
    g = g.select("crop", "ring", F.size("vertices").alias("n_nodes"), "implied_ring", "e_att", failures.alias("failures")).withColumn("ok", F.size("failures") == 0)
    return g.withColumn("note", R.validation_note(F.col("ok"), F.col("failures"), r, F.col("e_att"), F.col("ring")))


def connected(g: DataFrame) -> DataFrame:
    """crop, connected: whether all vertices can be reached from the first; nothing else is asked. A graph of one vertex or none is connected."""
    ids = F.transform("vertices", lambda v: v["id"])
    ends = lambda some: F.flatten(F.transform(some, lambda e: F.array(e["u"], e["w"])))
    grown = lambda seen, _: F.array_union(seen, ends(F.filter("edges", lambda e: F.array_contains(seen, e["u"]) | F.array_contains(seen, e["w"]))))
    reached = F.aggregate("vertices", F.slice(ids, 1, 1), grown)
    return g.select("crop", (F.size(F.array_except(ids, reached)) == 0).alias("connected"))
