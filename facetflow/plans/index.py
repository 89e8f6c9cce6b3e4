"""Queries of the slot index, of pixel tables, images, files and edit logs; their SQL is in oracles.py."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import records as R
from ..operators import cluster, imaging, slots
from ..sources import records as sources
from ..sources import sinks
from ..streaming import edits
from . import derived, oracles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


@query
def token_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.words(spark, sf_dir).select("ord", "token", R.slot_number(F.col("token")).alias("number"), R.slot_letter(F.col("token")).alias("letter"))


@query
def slot_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid as seen from the centres of its columns and lines."""
    centres = [100.0 + 200 * k for k in range(5)], [100.0 + 200 * k for k in range(7)]
    grid = slots.grid(spark, *centres)
    cells = derived.cells(spark, sf_dir).select("page", "line", "col")
    return cells.join(F.broadcast(grid), ["line", "col"]).select("page", (F.col("page") - 13).alias("figure"), "position", "sx", "sy", "w", "h")


@query
def words_in_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = derived.cells(spark, sf_dir).withColumns({"w": F.lit(200), "h": F.lit(200), "position": F.col("line") * 5 + F.col("col") + 1})
    return slots.words_in_slots(cells, derived.words(spark, sf_dir), band=80).select("page", "line", "col", "number", "letter", "agrees")


@query
def cross_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = derived.cells(spark, sf_dir).withColumns({"w": F.lit(200), "h": F.lit(200), "position": F.col("line") * 5 + F.col("col") + 1})
    known = spark.createDataFrame([(17, 3)], "page int, position int")
    return slots.cross_references(cells, derived.words(spark, sf_dir), known).select("page", "line", "col")


@query
def slot_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = derived.boxes(spark, sf_dir).withColumns({"col": F.floor(F.col("x") / 600).cast("int"), "line": F.floor(F.col("y") / 600).cast("int")})
    return slots.boxes_at_slots(b)


@query
def merge_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations whose ring is out of range are rejected before anything else is asked of them."""
    orders = derived.table(spark, sf_dir, "orders")
    ring = F.col("o_orderkey") % 11 + 5
    annotations = orders.where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("crop"), ring.cast("int").alias("ring"), ring.between(6, 14).alias("ok"))
    known = orders.where("o_orderkey % 6 = 0").select(F.col("o_orderkey").alias("crop"), (5 + F.col("o_custkey") % 10).cast("int").alias("known"))
    return annotations.join(known, "crop", "left").agg(F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("rejected"), F.count_if(F.col("ok") & (F.col("ring") != F.col("known"))).alias("conflicts"))


def _of_marks(pixels: DataFrame, names: str = "node cx cy radius") -> DataFrame:
    """Each pixel with each of the three marks."""
    marks = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(m, names.split(), strict=True)]) for m in derived.MARKS])
    return pixels.select("*", F.inline(marks))


def _d2() -> Column:
    return (F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy"))


def _ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.pixels(spark, sf_dir).where("v > 128").select("crop", "y", "x")


@query
def disc_ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = _of_marks(derived.pixels(spark, sf_dir)).where(_d2() <= F.col("radius") * F.col("radius"))
    return near.groupBy("crop", "node").agg(F.count("*").alias("pixels"), F.count_if(F.col("v") > 128).alias("ink"), F.sum("v").cast("long").alias("brightness"))


@query
def rectangle_ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = (F.col("x") >= F.col("cx") - F.col("radius")) & (F.col("x") < F.col("cx") + F.col("radius")) & (F.col("y") >= F.col("cy") - F.col("radius")) & (F.col("y") < F.col("cy") + F.col("radius"))
    return _of_marks(_ink(spark, sf_dir)).where(inside).groupBy("crop", "node").agg(F.count("*").alias("ink"))


@query
def erased_discs(spark: SparkSession, sf_dir: str) -> DataFrame:
    outside = [(F.col("x") - cx) * (F.col("x") - cx) + (F.col("y") - cy) * (F.col("y") - cy) > (r + 4) * (r + 4) for _, cx, cy, r in derived.MARKS]
    return _ink(spark, sf_dir).where(outside[0] & outside[1] & outside[2])


@query
def stroke_touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _of_marks(_ink(spark, sf_dir)).groupBy("crop", (F.col("x") % 7).alias("stroke"), "node", "radius").agg(F.min(_d2()).alias("d2"))
    return rows.where("d2 <= (radius + 8) * (radius + 8)").select("crop", "stroke", "node", "d2")


#: The eight neighbours (dy, dx) in the order of a walk around.
AROUND = ((-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1))


@query
def crossing_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pixel tells its neighbours where it is; a place counts the steps from paper to ink in what it was told."""
    ink = _ink(spark, sf_dir)
    told = ink.select("crop", F.inline(F.array(*[F.struct((F.col("y") - dy).alias("y"), (F.col("x") - dx).alias("x"), F.lit(1 << k).alias("bit")) for k, (dy, dx) in enumerate(AROUND)])))
    bits = ink.withColumn("bit", F.lit(256)).unionByName(told).groupBy("crop", "y", "x").agg(F.bit_or("bit").alias("bits")).where("bits >= 256")
    steps = [F.when((F.col("bits").bitwiseAND(F.lit(1 << k)) == 0) & (F.col("bits").bitwiseAND(F.lit(1 << (k + 1) % 8)) != 0), 1).otherwise(0) for k in range(8)]
    return bits.select("crop", "y", "x", sum(steps[1:], steps[0]).cast("long").alias("crossings"))


@query
def dilated_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread = F.array(*[F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    return derived.pixels(spark, sf_dir).select("crop", "v", F.inline(spread)).groupBy("crop", "y", "x").agg(F.max("v").alias("v"))


def of_images(name: str, *kernel: str) -> None:
    """A query of pixels (crop, y, x, v) that raster operators make of each image."""
    QUERIES[name] = lambda spark, sf_dir: imaging.pixels(imaging.mapped(derived.images(spark, sf_dir), *kernel))


of_images("median_pixels", "median3")
of_images("ink_pixels", "ink")
of_images("eroded_pixels", "erode3")
of_images("closed_pixels", "close5")
of_images("local_maxima", "maximum5")
of_images("component_pixels", "binary", "labels")
of_images("distance_pixels", "binary", "squared")


@query
def rim_ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each mark: points of the rim that are ink, and points of a wider circle."""
    return imaging.rims(derived.images(spark, sf_dir), [(k, cx, cy, r) for k, cx, cy, r in derived.MARKS])


@query
def disc_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each mark: share of ink and mean brightness of a disc, from images."""
    return imaging.discs(derived.images(spark, sf_dir), [(k, cx, cy, r) for k, cx, cy, r in derived.MARKS])


@query
def point_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy clusters of the points of each order."""
    return imaging.clustered(derived.drawings(spark, sf_dir).select("crop", F.transform("vertices", lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))).alias("points")), 120)


@query
def labels_to_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = derived.table(spark, sf_dir, "orders").groupBy(F.col("o_orderkey").alias("crop")).agg(F.max(5 + F.col("o_custkey") % 10).alias("ring"))
    return o.select("crop", F.concat(F.lit('"'), F.col("crop").cast("string"), F.lit('": '), F.col("ring").cast("string")).alias("line"))


@query
def kmeans_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five centres of the values of events."""
    centres = cluster.kmeans_1d(spark.read.parquet(f"{sf_dir}/events.parquet"), "value", 5)
    return spark.createDataFrame([(i, float(c)) for i, c in enumerate(centres)], "place int, centre double")


def _log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines, orders = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders"))
    clicks = lines.selectExpr("string(l_orderkey) crop", "l_partkey * 1000 + l_suppkey seq", "if(l_partkey % 9 = 0, 'shift_click', 'click') action", "double(l_partkey * 37 % 97) x", "double(l_suppkey * 59 % 89) y", "cast(null as string) value")
    keys = orders.selectExpr("string(o_orderkey) crop", "o_custkey + 1000000000000 seq", "'key' action", "cast(null as double) x", "cast(null as double) y", "element_at(array('+', '-', 'a', 'escape'), int(o_custkey % 4 + 1)) value")
    return clicks, keys


@query
def edit_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs that come of one click a line, then of one key an order."""
    clicks, keys = _log(spark, sf_dir)
    return edits.fold(clicks.unionByName(keys))


@query
def edit_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings after a key a line: the floor is 3, whatever comes after."""
    keys = derived.table(spark, sf_dir, "lineitem").selectExpr("string(l_suppkey) crop", "l_orderkey * 1000000 + l_partkey * 10 + l_linenumber seq", "'key' action", "cast(null as double) x", "cast(null as double) y", "element_at(array('-', '+', '-', '='), int(l_partkey % 4 + 1)) value")
    return edits.fold(keys).select(F.col("crop").cast("long").alias("crop"), "ring")


@query
def edit_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A click a line on one of a few places that are far apart: the first adds a node, later ones turn its shape."""
    clicks = derived.table(spark, sf_dir, "lineitem").selectExpr("string(l_orderkey) crop", "l_partkey * 1000 + l_suppkey seq", "'click' action", "double(l_partkey % 3 * 100) x", "double(l_suppkey % 2 * 100) y", "cast(null as string) value")
    nodes = F.from_json("nodes", "array<struct<x:int,y:int,shape:string,degree:int>>")
    return edits.fold(clicks).select(F.col("crop").cast("long").alias("crop"), F.inline(nodes))


def _folder(spark: SparkSession) -> str:
    """A folder for files of a query: in the one that all machines share, where there is one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{named.rstrip('/')}/files-{uuid.uuid4().hex}"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detection a supplier, whose nodes are its first few nations' numbers; small enough for files of one value."""
    s = F.col("s_suppkey")
    nodes = F.transform(F.sequence(F.lit(0), (s % 4).cast("int")), lambda k: F.struct((k * 30).cast("int").alias("x"), (s % 50).cast("int").alias("y"), F.lit(9).alias("radius"), F.lit("solid_dot").alias("shape"), F.lit(5).alias("degree"), (k == 3).alias("recovered")))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest((s % 4).cast("int"), F.lit(1))), lambda k: F.struct((k - 1).cast("int").alias("from"), k.cast("int").alias("to")))
    name = F.format_string("page%03d_cell%03d.png", (s % 90).cast("int"), s.cast("int"))
    rows = derived.table(spark, sf_dir, "supplier").select(
        name.alias("crop"), (s % 90).cast("int").alias("page"), nodes.alias("nodes"), F.size(nodes).alias("node_count"), F.when(s % 4 > 0, pairs).otherwise(F.array().cast("array<struct<from:int,to:int>>")).alias("edges"), (s % 4).cast("int").alias("edge_count"),
        (5 + s % 10).cast("int").alias("ring_size"), F.when(s % 3 == 0, 6).cast("int").alias("labeled_ring"), F.lit(None).cast("int").alias("e_attachment"), (s % 2 == 0).alias("euler_valid"), F.lit("é \"note\"").alias("validation_note"),
        F.when(s % 2 == 1, F.array(F.lit("A: x"), F.concat(F.lit("B: "), s.cast("string")))).otherwise(F.array().cast("array<string>")).alias("failures"), F.array().cast("array<string>").alias("warnings"), (s % 5 == 0).alias("human_corrected"),
    )
    return rows


@query
def run_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections written as one array of JSON and read again."""
    path = f"{_folder(spark)}/run.json"
    sinks.write_array(_records(spark, sf_dir), path, "crop")
    back = sources.read_run(spark, path)
    return back.select("crop", "page", "node_count", F.size("nodes").alias("n_nodes"), F.size("edges").alias("n_edges"), F.coalesce("labeled_ring", F.lit(-1)).alias("labeled_ring"), "euler_valid", "validation_note", F.concat_ws("|", "failures").alias("failures"), F.aggregate("nodes", F.lit(0), lambda a, n: a + n["x"]).alias("xs"))


@query
def canonical_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical records, a file each, written in two goes and read again."""
    path = _folder(spark)
    rows = _records(spark, sf_dir).select(*R.canonical(F.col("labeled_ring")))
    for part in (rows.where("xxhash64(id) % 2 = 0"), rows.where("xxhash64(id) % 2 <> 0")):
        sinks.write_canonical(part, path)
    back = sources.read_canonical(spark, path)
    return back.select("file_name", "id", F.coalesce("ring_size", F.lit(-1)).alias("ring_size"), F.size("vertices").alias("n_vertices"), F.size("edges").alias("n_edges"), F.get("vertices", F.lit(0))["pos"][1].alias("y0"), "provenance.extraction", "provenance.human_corrected", "provenance.source_document")


@query
def label_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label map written as one JSON object and read again."""
    path = f"{_folder(spark)}/labels.json"
    sinks.write_map(derived.table(spark, sf_dir, "supplier").selectExpr("concat('crop ', s_suppkey) as crop", "cast(5 + s_suppkey % 10 as int) as ring"), path)
    return sources.read_map(spark, path)


@query
def index_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slot index with crops that repeat, as one array; the last in its order counts, whatever its rank."""
    path = f"{_folder(spark)}/index.json"
    s = F.col("s_suppkey")
    rows = derived.table(spark, sf_dir, "supplier").select(F.when(s % 7 > 0, F.concat(F.lit("crop "), (s % 40).cast("string"))).alias("crop"), (-s).cast("int").alias("rank"), s.cast("int").alias("figure"), (s % 35).cast("int").alias("position"))
    sinks.write_array(rows, path, "figure")
    return sources.read_index(spark, path).select("crop", "rank", "figure", "position")


@query
def golden_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Golden records as one array."""
    path = f"{_folder(spark)}/golden.json"
    rows = _records(spark, sf_dir).select("crop", F.col("ring_size").alias("ring"), F.transform("nodes", lambda n: F.struct(n["x"].alias("x"), n["y"].alias("y"), n["shape"].alias("shape"), n["degree"].alias("degree"))).alias("nodes"), F.transform("edges", lambda e: F.array(e["from"], e["to"])).alias("edges"), F.lit("by hand").alias("provenance"))
    sinks.write_array(rows, path, "crop")
    return sources.read_golden(spark, path).select("crop", "ring", F.size("nodes").alias("n_nodes"), F.size("edges").alias("n_edges"), "provenance")


@query
def crop_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crops as PNG files, among others that don't count, listed and read from a page on."""
    path = _folder(spark)
    n = F.col("n_nationkey")
    kinds = F.explode(F.array(F.lit(""), F.lit("_debug"), F.lit("_nodes"))).alias("kind")
    rows = derived.table(spark, sf_dir, "nation").select(n, kinds).select(F.concat(F.format_string("page%03d_cell%03d", n.cast("int"), (n * 3).cast("int")), "kind", F.lit(".png")).alias("crop"), F.lit(4).alias("rows"), F.unhex(F.repeat(F.lpad(F.hex(n), 2, "0"), 16)).alias("content"))
    sinks.write_files(imaging.encoded(rows), path)
    read = sources.read_crops(spark, path, 14)
    listed = sources.list_crops(spark, path, 14)
    return imaging.decoded(read).join(listed.select("crop", "page"), "crop").select("crop", "page", F.col("rows").alias("height"), F.length("content").cast("int").alias("bytes"), F.conv(F.hex(F.substring("content", 1, 1)), 16, 10).cast("int").alias("first"))


@query
def gated_saves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records to save and to reject, by their verdicts; a null verdict rejects."""
    rows = derived.table(spark, sf_dir, "supplier").selectExpr("s_suppkey as id", "case s_suppkey % 3 when 0 then true when 1 then false end as ok")
    good, bad = sinks.gated(rows, F.col("ok"))
    return good.select("id", F.lit("saved").alias("fate")).unionByName(bad.select("id", F.lit("rejected").alias("fate")))


@query
def queue_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places that warnings name."""
    s = F.col("s_suppkey").cast("string")
    warnings = F.array(F.concat(F.lit("UNRESOLVED_JUNCTION: strokes at ("), s, F.lit(", 7) of nodes [0]")), F.lit("other at (1, 1)"), F.concat(F.lit("UNRESOLVED_JUNCTION: at (2, "), s, F.lit(")")))
    return derived.table(spark, sf_dir, "supplier").select("s_suppkey", F.inline(R.pointers(warnings))).select("s_suppkey", "kind", "at.x", "at.y")


@query
def node_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gates of candidates, strict and weak, over their features."""
    k = F.col("p_partkey")
    share, count, radius = (k % 101) / 100.0, k % 4, 10 + k % 9
    rim, centre = (k * 7 % 101) / 100.0, 100 + k * 3 % 156
    area, length, corners = 300 + k * 11 % 5000, 60 + k % 300, 3 + k % 3
    return derived.table(spark, sf_dir, "part").select(
        k, R.solid_gate(share, count, radius).alias("solid"), R.solid_gate(share, count, radius, weak=True).alias("weak_solid"), R.circle_gate(centre, count, rim).alias("circle"), R.circle_gate(centre, count, rim, weak=True).alias("weak_circle"), R.polygon_shape(area, length, corners).alias("polygon")
    )


@query
def slot_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = derived.table(spark, sf_dir, "customer").select(k, (k % 3 == 0).alias("box"), (k % 5 == 0).alias("xref"), (k * 37 % 8000).alias("core"))
    return rows.select("c_custkey", slots.occupied(F.col("box"), F.col("xref"), F.col("core")).alias("occupied"))


@query
def word_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a page's text layer in pixels, turned with the page."""
    k = F.col("c_custkey")
    rows = derived.table(spark, sf_dir, "customer").select(k.cast("int").alias("page"), F.lit("w").alias("token"), *((k % m).cast("double").alias(c) for m, c in ((7, "x0"), (11, "y0"), (13, "x1"), (17, "y1"))))
    return sources.words(rows, 4.0, (0.5, -2.0, 1.0, 2.0, 0.5, -3.0)).select("page", "cx", "cy")


ORACLE_SQL = oracles.INDEX
