"""Queries over reports of the whole battery, whose planarity no SQL expresses; the other layers have SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import records as R
from ..operators import battery, graph
from ..operators import relations as ops
from . import derived, oracles


def _reports(g: DataFrame) -> DataFrame:
    return battery.report(g)


def _runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    g = derived.graphs(spark, sf_dir)
    return _reports(g), _reports(derived.baseline(g))


def full_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reports(derived.graphs(spark, sf_dir)).select("crop", "ok", F.concat_ws("; ", "failures").alias("failures"), F.concat_ws("; ", "warnings").alias("warnings"), *graph.COMPUTED)


def battery_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.failure_histogram(_reports(derived.graphs(spark, sf_dir))).select("tag", "n", "crops")


def battery_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures by crop and tag, without planarity; and the ring of the outer walk."""
    tags = _reports(derived.graphs(spark, sf_dir)).select("crop", "ring_walk", F.explode("failures").alias("f")).withColumn("tag", R.tag(F.col("f"))).where("tag <> 'NONPLANAR'")
    return tags.groupBy("crop", "tag").agg(F.count("*").alias("n"), F.max("ring_walk").cast("long").alias("ring_walk"))


def face_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Computed values of connected graphs that have edges."""
    return _reports(derived.graphs(spark, sf_dir)).where("faces > 0").select("crop", *(F.col(c).cast("long").alias(c) for c in ("faces", "outer_walk_len", "ring_walk")))


def battery_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.compare_batteries(*_runs(spark, sf_dir)).select("crops", "new_pass", "base_pass", "fixed", "broken")


def battery_run_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.transitions(*_runs(spark, sf_dir)).where("change is not null").select("crop", "change")


def battery_run_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.compare_histograms(*_runs(spark, sf_dir))


def _reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived.graphs(spark, sf_dir)
    notes = F.concat_ws("; ", "failures")
    return _reports(g).join(g.select("crop", "ring", F.size("vertices").alias("n_nodes")), "crop").withColumn("note", notes)


def battery_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.batch_summary(_reported(spark, sf_dir))


def battery_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.queue(_reported(spark, sf_dir)).select("crop", "place", "p")


def face_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived.graphs(spark, sf_dir).where(F.size("edges") > 0)
    return battery.faces(g.join(ops.connected(g).where("connected"), "crop", "left_semi")).select("crop", "faces")


QUERIES = {f.__name__: f for f in (full_battery, battery_histogram, battery_layers, face_walks, battery_run_summary, battery_run_changes, battery_run_histogram, battery_summary, battery_queue, face_counts)}
ORACLE_SQL = {"face_counts": oracles.FACE_COUNTS_SQL, "battery_layers": oracles.LAYERS_SQL, "face_walks": oracles.FACE_WALKS_SQL}
