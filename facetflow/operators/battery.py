"""The battery over many graphs, rows of relations.graphs(), in Arrow batches; nothing is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from . import graph

REPORT = "ok boolean, failures array<string>, warnings array<string>, " + ", ".join(f"{c} int" for c in graph.COMPUTED)


def faces(graphs: DataFrame) -> DataFrame:
    """(crop, vertices, edges) of connected graphs that have edges and all positions -> crop, faces, outer_walk_len."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for g in batch.to_pylist():
                walks, outer = graph.faces({v["id"]: (v["x"], v["y"]) for v in g["vertices"]}, [(e["u"], e["w"]) for e in g["edges"]])
                rows.append({"crop": g["crop"], "faces": len(walks), "outer_walk_len": len(walks[outer])})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("crop", pa.int64()), ("faces", pa.int64()), ("outer_walk_len", pa.int64())]))

    return graphs.select("crop", "vertices", "edges").mapInArrow(run, "crop long, faces long, outer_walk_len long")


def report(graphs: DataFrame) -> DataFrame:
    """(crop, vertices, edges, ring) -> crop and the report; a graph that breaks an assumption gives a row with an ERROR failure."""

    kind = graphs.schema["crop"].dataType
    name = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for g in batch.to_pylist():
                try:
                    points = [(v["id"], v["degree"], None if v["x"] is None or v["y"] is None else (v["x"], v["y"])) for v in g["vertices"] or []]
                    bad, warn, got = graph.battery(points, [(e["u"], e["w"]) for e in g["edges"] or []], g["ring"])
                except Exception as error:  # one bad row must not end the run
                    bad, warn, got = [f"ERROR: {error}"], [], {}
                rows.append({"crop": g["crop"], "ok": not bad, "failures": bad, "warnings": warn} | {c: got.get(c) for c in graph.COMPUTED})
            schema = pa.schema([("crop", name), ("ok", pa.bool_()), ("failures", pa.list_(pa.string())), ("warnings", pa.list_(pa.string())), *((c, pa.int32()) for c in graph.COMPUTED)])
            yield pa.RecordBatch.from_pylist(rows, schema)

    return graphs.select("crop", "vertices", "edges", "ring").mapInArrow(run, f"crop {kind.simpleString()}, {REPORT}")
