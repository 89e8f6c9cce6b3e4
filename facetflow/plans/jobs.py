"""Whole jobs over files: detection of a folder of crops, measurement of a run, annotations folded back, crops cut out of pages."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import records as R
from ..operators import battery, extract, imaging
from ..operators import relations as ops
from ..sources import records as sources
from ..sources import sinks


def graphs_of_run(run: DataFrame) -> DataFrame:
    """Detections as graphs; the place of a node is its id."""
    node = lambda n, i: F.struct(i.cast("int").alias("id"), n["x"].alias("x"), n["y"].alias("y"), n["degree"].alias("degree"), n["radius"].alias("radius"), n["shape"].alias("shape"))
    none = F.array().cast(f"array<{R.NODE}>")
    edges = F.coalesce("edges", F.array().cast("array<struct<`from`:int,`to`:int>>"))
    return run.select("crop", F.transform(F.coalesce("nodes", none), node).alias("vertices"), F.transform(edges, lambda e: F.struct(e["from"].alias("u"), e["to"].alias("w"))).alias("edges"), F.col("labeled_ring").alias("ring"))


def graphs_of_records(rows: DataFrame, key: str = "id") -> DataFrame:
    """Canonical records as graphs, named by key."""
    vertex = lambda v: F.struct(v["id"].alias("id"), F.get(v["pos"], F.lit(0)).alias("x"), F.get(v["pos"], F.lit(1)).alias("y"), v["degree"].alias("degree"), v["radius"].alias("radius"), v["shape"].alias("shape"))
    return rows.select(F.col(key).alias("crop"), F.transform("vertices", vertex).alias("vertices"), F.transform("edges", lambda e: F.struct(e[0].alias("u"), e[1].alias("w"))).alias("edges"), F.col("ring_size").alias("ring"))


def batch_run(spark: SparkSession, crops: str, out: str | None = None, labels: str | None = None, start_page: int = 14) -> tuple[DataFrame, DataFrame]:
    """Detections of all crops of a folder, and their summary. An image is a row; the detections stay on the executors' disks, since both read them."""
    files = sources.read_crops(spark, crops, start_page)
    known = sources.read_map(spark, labels) if labels else spark.createDataFrame([], "crop string, ring int")
    run = extract.extract(files.join(known.withColumnRenamed("ring", "labeled_ring"), "crop", "left")).persist(StorageLevel.DISK_ONLY)
    if out:
        sinks.write_array(run, out, "crop")
    return run, ops.batch_summary(run.select("crop", F.col("euler_valid").alias("ok"), F.col("labeled_ring").alias("ring"), F.col("node_count").alias("n_nodes"), "failures"))


def evaluate(spark: SparkSession, new: str, base: str | None = None, golden: str | None = None) -> dict[str, DataFrame]:
    """battery and histogram of two runs, and golden scores of the new one, as far as there are files."""
    run = ops.last_of_each(sources.read_run(spark, new).withColumn("_at", F.monotonically_increasing_id()), "_at")
    verdict = lambda r: r.select("crop", F.col("euler_valid").alias("ok"), "failures")
    out: dict[str, DataFrame] = {}
    if base:
        old = sources.read_run(spark, base)
        last = ops.last_of_each(old.withColumn("_at", F.monotonically_increasing_id()), "_at")
        out["battery"] = ops.compare_batteries(verdict(run), verdict(last))
        out["histogram"] = ops.compare_histograms(verdict(sources.read_run(spark, new)), verdict(old))
    if golden and sources.exists(spark, golden):
        node = lambda n, i: F.struct(i.cast("int").alias("id"), n["x"].alias("x"), n["y"].alias("y"), n["degree"].alias("degree"), F.lit(None).cast("int").alias("radius"), n["shape"].alias("shape"))
        g = sources.read_golden(spark, golden).select("crop", F.transform("nodes", node).alias("vertices"), F.transform("edges", lambda e: F.struct(e[0].alias("u"), e[1].alias("w"))).alias("edges"))
        out["golden"] = ops.score_golden(g, graphs_of_run(run))
        out["missing"] = ops.golden_counts(g, graphs_of_run(run)).where("missing").select("crop")
    return out


def fold_back(spark: SparkSession, annotations: str, labels: str, index: str, dataset: str, force: bool = False) -> dict[str, DataFrame]:
    """Annotations that pass the battery go into the data set, with what the index knows of them, and their rings into the label map.

    Records whose shapes and degrees disagree are rejected, like those that fail
    the battery. Files count in the order of their names: the first label of a
    crop stays, unless forced, and later ones that differ are conflicts, though
    their records are written all the same. The census is that of the whole data
    set, old records included.
    """
    rows = sources.read_canonical(spark, annotations)
    report = battery.report(graphs_of_records(rows, "file_name")).select(F.col("crop").alias("file_name"), "ok", "failures")
    sane = F.forall("vertices", lambda v: R.shape_agrees(v["shape"], v["degree"]))
    judged = rows.join(report, "file_name").withColumn("ok", F.col("ok") & sane).persist(StorageLevel.DISK_ONLY)
    crop = F.coalesce("provenance.crop", F.concat("id", F.lit(".png")))
    good = judged.where("ok").withColumn("crop", crop)
    known = ops.enrich(good.select("crop", "reducibility"), sources.read_index(spark, index).select("crop", "figure", "position", "letter")).dropDuplicates(["crop"])
    named = good.drop("reducibility").join(known, "crop", "left")
    record = named.withColumn("provenance", F.col("provenance").withField("figure_ref", F.coalesce("figure_ref", "provenance.figure_ref")))
    old = sources.read_map(spark, labels).persist(StorageLevel.DISK_ONLY)
    old.count()  # before the file is written anew
    pick = F.max_by if force else F.min_by
    new = good.groupBy("crop").agg(pick("ring_size", F.when(F.col("ring_size").isNotNull(), F.col("file_name"))).alias("ring"), F.min(F.when(F.col("ring_size").isNotNull(), F.col("file_name"))).alias("first"))
    merged = ops.merge_labels(old, new, force)
    settled = good.join(old.withColumnRenamed("ring", "before"), "crop", "left").join(new.select("crop", "ring", "first"), "crop", "left")
    clash = F.when(F.col("before").isNotNull(), ~F.col("before").eqNullSafe(F.col("ring_size"))).otherwise((F.col("file_name") > F.col("first")) & ~F.col("ring").eqNullSafe(F.col("ring_size")))
    conflicts = settled.where(F.coalesce(clash, F.lit(False)) & ~F.lit(force))
    counts = judged.agg(F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("rejected")).join(F.broadcast(conflicts.agg(F.count("*").alias("conflicts"))))
    counts = spark.createDataFrame(counts.collect(), "ok long, rejected long, conflicts long")  # one row
    sinks.write_canonical(record, dataset)
    sinks.write_map(merged, labels)
    whole = sources.read_canonical(spark, dataset)
    return {"counts": counts, "rejected": judged.where(~F.col("ok")).select("file_name", F.slice("failures", 1, 2).alias("failures")), "labels": sources.read_map(spark, labels), "census": ops.census_progress(whole.select(F.col("ring_size").alias("ring")), sources.constants(spark)["census"])}


def cut_pages(spark: SparkSession, pages: DataFrame, out: str) -> DataFrame:
    """pages(page, rows, content) -> the boxes of their drawings; the crops are written as page<page>_cell<cell>.png."""
    crops = imaging.crops_of_pages(pages).withColumn("crop", R.crop_name(F.col("page"), F.col("cell"))).persist(StorageLevel.DISK_ONLY)
    sinks.write_files(imaging.encoded(crops), out)
    return crops.select("page", "cell", "crop", "x", "y", "w", "h")


def diamond(spark: SparkSession) -> DataFrame:
    """The canonical record of a ring of four around a chord."""
    return _record(spark, "birkhoff-diamond", [(0.0, 1.0), (-1.0, 0.0), (0.0, -1.0), (1.0, 0.0)], [[0, 1], [1, 2], [2, 3], [3, 0], [0, 2]], 6, "D")


def single(spark: SparkSession) -> DataFrame:
    """The canonical record of one vertex of degree 5."""
    return _record(spark, "single-v5", [None], [], 5, None)


def _record(spark: SparkSession, name: str, places: list, edges: list, ring: int, letter: str | None) -> DataFrame:
    vertices = [(k, 5, "solid_dot", None if p is None else list(p), None) for k, p in enumerate(places)]
    return spark.createDataFrame([(name, vertices, edges, ring, letter, (None, None, None, "manual", False, None))], ", ".join(R.CANONICAL.split(", ")[:-1]))
