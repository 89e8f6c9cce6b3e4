"""python -m facetflow batch | evaluate | collect: the jobs on files, with defaults from the environment."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession

from .plans import jobs


def main() -> None:
    parser = argparse.ArgumentParser(prog="facetflow")
    commands = parser.add_subparsers(dest="command", required=True)
    batch = commands.add_parser("batch", help="detect and validate a folder of crops")
    batch.add_argument("--crops", default=os.environ.get("CROPS_DIR"), required="CROPS_DIR" not in os.environ)
    batch.add_argument("--out", default=os.environ.get("DEFAULT_OUT"))
    batch.add_argument("--labels")
    batch.add_argument("--start-page", type=int, default=14)
    measure = commands.add_parser("evaluate", help="compare runs, score one by golden records")
    measure.add_argument("--new", required=True)
    measure.add_argument("--baseline")
    measure.add_argument("--golden", default="data/golden.json")
    collect = commands.add_parser("collect", help="fold annotations back")
    for name, place in (("annotations", "annotations"), ("labels", "data/ring_labels.json"), ("index", "data/config_index.json"), ("dataset", "data/dataset")):
        collect.add_argument(f"--{name}", default=place)
    collect.add_argument("--force", action="store_true")
    args = parser.parse_args()
    spark = SparkSession.builder.getOrCreate()
    if args.command == "batch":
        tables = {"summary": jobs.batch_run(spark, args.crops, args.out, args.labels, args.start_page)[1]}
    elif args.command == "evaluate":
        tables = jobs.evaluate(spark, args.new, args.baseline, args.golden)
    else:
        tables = jobs.fold_back(spark, args.annotations, args.labels, args.index, args.dataset, args.force)
    for name, table in tables.items():
        print(name)
        table.show(50, truncate=False)


if __name__ == "__main__":
    main()
