"""Queries of the relational operators over the derived graphs; their SQL, for another engine, is in oracles.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import records as R
from ..operators import relations as ops
from ..sources import records as sources
from . import derived, oracles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


def of_graphs(name: str, f: Callable[[DataFrame], DataFrame]) -> None:
    """A query that reads nothing but the graphs."""
    QUERIES[name] = lambda spark, sf_dir: f(derived.graphs(spark, sf_dir))


of_graphs("implied_ring", lambda g: ops.sums(g).select("crop", "n_v", "n_e", "sum_d", "e_att", "implied_ring", F.coalesce("ring", F.lit(-1)).alias("labeled_ring"), ops.in_range(F.col("implied_ring")).alias("in_range")))
of_graphs("ring_summary", lambda g: ops.sums(g).groupBy("implied_ring").agg(F.count("*").alias("crops"), F.sum("n_v").alias("vertices")))
of_graphs("identity_check", lambda g: ops.identity(ops.sums(g)))
of_graphs("attachment_legacy", lambda g: ops.sums(g).where(ops.in_range(F.col("implied_ring"))).select("crop", (F.col("e_att") + F.col("implied_ring")).alias("e_attachment")))
of_graphs("ring_label_check", lambda g: ops.ring_label_check(ops.sums(g)))
of_graphs("internal_degree", lambda g: ops.internal_degree(g).select("crop", "id", F.col("inner").alias("deg_int")))
of_graphs("degree_overflow", lambda g: ops.internal_degree(g).where("inner > degree").select("crop", "id", F.col("inner").alias("deg_int"), "degree"))
of_graphs("degree_check", lambda g: ops.attachment(g).select("crop", "ok"))
of_graphs("attachment", lambda g: ops.attachment(g).select("crop", "total", "least"))
of_graphs("crossing_edges", ops.crossing_edges)
of_graphs("crossing_count_per_crop", lambda g: ops.crossing_edges(g).groupBy("crop").agg(F.count("*").alias("crossings")))
of_graphs("pair_candidates", ops.pair_candidates)
of_graphs("occluded_pairs", ops.occluded)
of_graphs("rotation_system", ops.rotation)
of_graphs("outer_vertex", ops.outer_vertex)
of_graphs("signed_area", ops.signed_area)
of_graphs("connected", ops.connected)


@query
def shape_degree_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = ops.vertices(derived.graphs(spark, sf_dir)).withColumn("degree", F.col("degree") + F.when(F.col("id") % 5 == 4, 1).otherwise(0))
    return odd.groupBy("shape").agg(F.count("*").alias("n"), F.count_if(R.shape_agrees(F.col("shape"), F.col("degree"))).alias("consistent"))


@query
def structural_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some graphs with an edge twice, a loop, an edge to nowhere, or degrees that are too small."""
    c = F.col("crop")
    first = F.filter("edges", lambda e: e["u"] == 0)
    none = F.array().cast("array<struct<u:int,w:int>>")
    more = [F.when(c % 97 == 0, first).otherwise(none), F.when(c % 101 == 0, F.transform("edges", lambda e: F.struct(e["u"].alias("u"), e["u"].alias("w")))).otherwise(none), F.when(c % 89 == 0, F.transform(first, lambda e: F.struct(e["u"].alias("u"), (e["w"] + 100).alias("w")))).otherwise(none)]
    fields = [f for f in ops.VERTEX if f != "degree"]
    lower = F.transform("vertices", lambda v: F.struct(*[v[f].alias(f) for f in fields], (v["degree"] - F.when(c % 103 == 0, 4).otherwise(0)).alias("degree")))
    return ops.structural_failures(derived.graphs(spark, sf_dir).select("crop", lower.alias("vertices"), F.concat("edges", *more).alias("edges")))


@query
def proximity_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = ops.vertices(derived.graphs(spark, sf_dir))
    return ops.not_near(v.where("shape in ('square', 'triangle')"), v.where("shape in ('solid_dot', 'open_circle')")).select("crop", "id")


@query
def spaced_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.spaced(ops.vertices(derived.graphs(spark, sf_dir)), 90).select("crop", "id")


@query
def bridge_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.bridges(ops.vertices(derived.graphs(spark, sf_dir)).withColumn("owner", (F.col("id") % 3).cast("int")))


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_custkey")
    return derived.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("crop"), (k * 31 % 397).cast("int").alias("px"), (k * 17 % 389).cast("int").alias("py")).distinct()


@query
def hit_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.node_at(derived.graphs(spark, sf_dir), _probes(spark, sf_dir))


@query
def edge_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.edge_at(derived.graphs(spark, sf_dir), _probes(spark, sf_dir))


def _runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Both runs by the checks that columns can express; the whole battery is in graphs.py."""
    g = derived.graphs(spark, sf_dir)
    return ops.checks(g), ops.checks(derived.baseline(g))


@query
def failure_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, base = _runs(spark, sf_dir)
    return ops.failure_histogram(new).withColumn("run", F.lit("new")).unionByName(ops.failure_histogram(base).withColumn("run", F.lit("base"))).select("run", "tag", "n")


@query
def failure_tag_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, base = _runs(spark, sf_dir)
    return ops.failure_histogram(new).withColumn("run", F.lit("new")).unionByName(ops.failure_histogram(base).withColumn("run", F.lit("base"))).select("run", "tag", "crops")


@query
def run_histogram_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.compare_histograms(*_runs(spark, sf_dir))


@query
def run_compare_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.compare_batteries(*_runs(spark, sf_dir)).select("crops", "new_pass", "base_pass", "fixed", "broken")


@query
def run_fixed_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.transitions(*_runs(spark, sf_dir)).where("change is not null").select("crop", "change")


@query
def edge_set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived.graphs(spark, sf_dir)
    return ops.edge_difference(ops.edges(g), ops.edges(derived.baseline(g)))


@query
def edge_set_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived.graphs(spark, sf_dir)
    return ops.edges(g).intersect(ops.edges(derived.baseline(g))).groupBy("crop").agg(F.count("*").alias("n"))


@query
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.batch_summary(_runs(spark, sf_dir)[0])


@query
def triage_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some passes ask to be verified."""
    note = F.when(F.col("ok") & (F.col("crop") % 3 == 0), F.concat("note", F.lit(f" ({R.VERIFY})"))).otherwise(F.col("note"))
    return ops.queue(_runs(spark, sf_dir)[0].withColumn("note", note)).select("crop", "place", "p")


@query
def golden_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived.graphs(spark, sf_dir)
    return ops.golden_pairs(derived.golden(g), g).select("crop", F.inline("candidates")).select("crop", "gi", "di", "d2")


@query
def golden_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived.graphs(spark, sf_dir)
    return ops.match_nodes(derived.golden(g), g)


@query
def golden_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Golden graphs have all edges, the run lacks some; a few golden crops are not in the run."""
    g = derived.graphs(spark, sf_dir)
    gold = derived.golden(g)
    return ops.score_golden(gold.unionByName(gold.where("crop % 50 = 0").withColumn("crop", -F.col("crop") - 1)), derived.baseline(g))


@query
def label_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = derived.table(spark, sf_dir, "orders")
    new = orders.where("o_orderkey % 4 = 0").selectExpr("o_orderkey as crop", "cast(5 + o_orderkey % 11 as int) as ring")
    return ops.merge_labels(orders.where("o_orderkey % 6 = 0").selectExpr("o_orderkey as crop", "cast(5 + o_custkey % 10 as int) as ring"), new)


@query
def annotation_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = derived.table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("crop"), F.when(F.col("o_orderkey") % 5 == 0, "D").alias("reducibility"))
    return ops.enrich(some, derived.slots(spark, sf_dir))


@query
def census_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.census_progress(derived.labels(spark, sf_dir), sources.constants(spark)["census"])


@query
def index_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.ranked(derived.slots(spark, sf_dir).where("crop % 7 <> 0"), "figure", "position", "crop").select("crop", "place", "letter")


@query
def index_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, position = F.col("crop"), F.col("position")
    seen = F.when(k % 4 == 0, None).when(k % 9 == 0, position + 1).otherwise(position)
    rows = derived.slots(spark, sf_dir).select((k % 11 == 0).alias("missing"), seen.alias("seen"), "position", "letter")
    return rows.agg(F.count("*").alias("occupied"), F.count_if("missing").alias("missing"), F.count("seen").alias("checked"), F.count_if(F.col("seen") != position).alias("disagree"), F.count("letter").alias("letters"))


@query
def slot_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    centre = 2 * F.col("x") + F.col("w")
    return derived.boxes(spark, sf_dir).select("id", ops.nearest_centre(centre, [2 * (300 + 600 * k) for k in range(5)]).alias("col"))


@query
def box_filter_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.reading_order(derived.boxes(spark, sf_dir).where(ops.good_box(*map(F.col, ("x", "y", "w", "h"))))).select("page", "id", "place")


@query
def crop_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.boxes(spark, sf_dir).select("id", *ops.padded(*map(F.col, ("x", "y", "w", "h")), 3000, 4000))


def _pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.pruned(derived.graphs(spark, sf_dir), lambda v: v["id"] % 4 == 3)


@query
def pruned_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.vertices(_pruned(spark, sf_dir)).select("crop", F.col("old").alias("id"), F.col("id").alias("new_id"))


@query
def pruned_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.edges(_pruned(spark, sf_dir))


@query
def ladder_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ops.sums(derived.graphs(spark, sf_dir))
    tries = F.array(*[F.struct(F.lit(k).alias("attempt"), ops.in_range(F.col("implied_ring") + more).alias("ok")) for k, more in enumerate((0, -3, 3))])
    return ops.first_passing(s.select("crop", F.inline(tries)))


@query
def detection_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections as canonical records, by the columns that readers use."""
    node = lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"), v["radius"].alias("radius"), v["shape"].alias("shape"), v["degree"].alias("degree"), F.lit(False).alias("recovered"))
    name = F.concat(F.lit("page"), F.lpad((F.col("crop") % 1000).cast("string"), 3, "0"), F.lit("_cell"), F.col("crop").cast("string"), F.lit(".png"))
    det = derived.graphs(spark, sf_dir).select(name.alias("crop"), F.lit(1).alias("page"), F.transform("vertices", node).alias("nodes"), F.transform("edges", lambda e: F.struct(e["u"].alias("from"), e["w"].alias("to"))).alias("edges"), F.lit(None).cast("boolean").alias("human_corrected"))
    return det.select(*R.canonical()).select(F.col("id").alias("config"), F.inline("vertices")).select("config", "id", "degree", F.get("pos", F.lit(0)).alias("px"), F.get("pos", F.lit(1)).alias("py"), "shape")


ORACLE_SQL = oracles.RELATIONAL | {"connected": oracles.CONNECTED_SQL, "golden_match": oracles.GOLDEN_MATCH_SQL}
