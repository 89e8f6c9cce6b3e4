"""Tables of graphs, labels, slots, boxes, words and pixels, derived from the driver's tables by whole numbers.

An order is a graph and its lines are the vertices; graphs() gathers an order's
lines with one shuffle and makes vertices and edges in that row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# How far an edge reaches, shapes by degree.
REACH2 = 44100
SHAPES = ("solid_dot", "open_circle", "square", "triangle")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("crop"), (5 + F.col("o_custkey") % 10).cast("int").alias("ring"))


def drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """crop, vertices, edges."""
    key = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("crop")).agg(F.sort_array(F.collect_list(key)).alias("lines"))

    def vertex(line, i):
        p, s = line["l_partkey"], line["l_suppkey"]
        shape = F.element_at(F.array(*map(F.lit, SHAPES)), (p % 4 + 1).cast("int"))
        return F.struct(i.cast("int").alias("id"), (p * 37 % 397).cast("int").alias("x"), ((p * 101 + s * 59) % 389).cast("int").alias("y"), (5 + p % 4).cast("int").alias("degree"), (10 + s % 10).cast("int").alias("radius"), shape.alias("shape"))

    d2 = lambda a, b: (a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"])
    near = lambda a, k: F.transform(F.filter(F.slice("vertices", k + 2, F.size("vertices")), lambda b: d2(a, b).between(1, REACH2)), lambda b: F.struct(a["id"].alias("u"), b["id"].alias("w")))
    return lines.select("crop", F.transform("lines", vertex).alias("vertices")).withColumn("edges", F.flatten(F.transform("vertices", near)))


def graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drawings(spark, sf_dir).join(labels(spark, sf_dir), "crop", "left")


def baseline(g: DataFrame) -> DataFrame:
    """The same graphs without some edges."""
    return g.withColumn("edges", F.filter("edges", lambda e: (e["u"] * 3 + e["w"] * 5 + F.col("crop")) % 11 != 0))


def golden(g: DataFrame) -> DataFrame:
    """Every tenth graph with its vertices moved a little."""
    moved = lambda v: F.struct(v["id"].alias("id"), (v["x"] + (v["id"] * 7 + F.col("crop")) % 31 - 15).cast("int").alias("x"), (v["y"] + (v["id"] * 11 + F.col("crop")) % 29 - 14).cast("int").alias("y"), v["degree"].alias("degree"), v["radius"].alias("radius"), v["shape"].alias("shape"))
    return g.where("crop % 10 = 0").withColumn("vertices", F.transform("vertices", moved))


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    letter = F.when(k % 3 == 0, None).when(k % 2 == 0, "C").otherwise("D")
    return table(spark, sf_dir, "orders").select(k.alias("crop"), F.floor(k / 35 + 1).cast("long").alias("figure"), (k % 35 + 1).cast("long").alias("position"), letter.alias("letter"), "o_custkey")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), (k * 97 % 3000).cast("int").alias("x"), (k * 61 % 4000).cast("int").alias("y"), (60 + k * 13 % 900).cast("int").alias("w"), (60 + k * 29 % 900).cast("int").alias("h"), (k % 50).cast("int").alias("page"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    text = F.element_at(F.array(F.concat(F.lit("I"), (k % 10).cast("string")), (k % 60).cast("string"), F.lit("c"), F.lit("D"), F.concat(F.lit("#"), (k % 7).cast("string")), F.lit("see")), (k % 6 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select((k % 20).cast("int").alias("page"), k.cast("long").alias("ord"), (k * 37 % 1000).cast("int").alias("cx"), (k * 53 % 1400).cast("int").alias("cy"), text.alias("token"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots of a grid of five columns, some lines on each of twenty pages: a nation is a line, with a cell for each column."""
    n = F.col("n_nationkey")
    lines = table(spark, sf_dir, "nation").where("n_nationkey < 20").select((n % 20).cast("int").alias("page"), (n % 7).cast("int").alias("line"), F.explode(F.array(*[F.lit(k) for k in range(5)])).alias("col"))
    return lines.withColumns({"sx": F.col("col") * 200, "sy": F.col("line") * 200})


def pixels(spark: SparkSession, sf_dir: str, size: int = 24) -> DataFrame:
    """crop, y, x, v: an image a supplier, a pixel a line; of lines that meet the brightest. Some places have none."""
    p, o = F.col("l_partkey"), F.col("l_orderkey")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("int").alias("crop"), (p * 7 % size).cast("int").alias("y"), (o * 11 % size).cast("int").alias("x"))
    return rows.agg(F.max((p * 31 + o * 17) % 256).cast("int").alias("v"))


#: Places of nodes in each image: node, cx, cy, radius.
MARKS = tuple((k, 5 + 7 * k, 19 - 7 * k, 3 + k) for k in range(3))


def images(spark: SparkSession, sf_dir: str, size: int = 24) -> DataFrame:
    """crop, rows, content: the pixels of each image as bytes, line by line; 0 where there is none."""
    flat = F.map_from_entries(F.collect_list(F.struct((F.col("y") * size + F.col("x")).alias("at"), "v")))
    of = pixels(spark, sf_dir, size).groupBy("crop").agg(flat.alias("m"))
    line = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda k: F.lpad(F.hex(F.coalesce(F.try_element_at("m", k), F.lit(0))), 2, "0")), "")
    return of.select("crop", F.lit(size).alias("rows"), F.unhex(line).alias("content"))
