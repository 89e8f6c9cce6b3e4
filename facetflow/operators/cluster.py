"""One-dimensional k-means over a column: every round is one aggregate of at most k rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kmeans_1d(df: DataFrame, column: str, k: int, rounds: int = 30) -> list[float]:
    """Sorted centres, from equal steps between the extremes; nulls are left out; an empty cluster keeps its centre; ties go to the lower place.

    Values are counted once and the counts checkpointed, so rounds read distinct
    values only. Rounds end early where the centres no longer move, since all
    later ones would be the same. No values: no centres.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n"))
    spark = df.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
        counts = counts.checkpoint()
    low, high = counts.agg(F.min("v"), F.max("v")).first()
    if low is None:
        return []
    centres = [low + (high - low) * i / max(k - 1, 1) for i in range(k)]
    for _ in range(rounds):
        home = F.least(*[F.struct(F.abs(F.col("v") - c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)]) if k > 1 else F.struct(F.lit(0.0).alias("d"), F.lit(0).alias("i"))
        means = {r.i: r.m for r in counts.groupBy(home["i"].alias("i")).agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("m")).collect()}
        moved = [means.get(i, c) for i, c in enumerate(centres)]
        if moved == centres:
            break
        centres = moved
    return sorted(centres)
