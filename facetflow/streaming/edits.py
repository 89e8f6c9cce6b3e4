"""A log of edits, folded for each crop: as a batch, or as a stream that keeps the state of each crop.

An event is (crop, seq, action, x, y, value). Actions: click and shift_click at
(x, y), key with the key in value. A click on a node changes its shape, with
shift deletes it; on an edge deletes it; elsewhere adds a node. Key a starts an
edge, which the next two nodes clicked make or unmake; escape ends this; + and =
widen the ring, - narrows it, never below 3. Unknown actions and keys change
nothing. Events of a crop apply by seq; equal seq by their other fields.
A crop's log is one person's work on one drawing, so it fits into a task.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import _parse_datatype_string

from ..operators import graph

# Order of the shapes, reach of a click on a node and on an edge in pixels, radius of an added node.
SHAPES = ("solid_dot", "open_circle", "square", "triangle")
NODE_REACH, EDGE_REACH, ADDED_RADIUS = 18, 10, 10
RESULT = "crop string, events long, nodes string, edges string, ring int, ok boolean, failures array<string>"


def start(nodes: list[dict] | None = None, edges: list[list[int]] | None = None, ring: int = 6) -> dict:
    return {"nodes": nodes or [], "edges": sorted(edges or []), "ring": ring, "adding": False, "first": None, "events": 0}


def node_at(state: dict, x: float, y: float) -> int | None:
    d2, k = min((((n["x"] - x) ** 2 + (n["y"] - y) ** 2, k) for k, n in enumerate(state["nodes"])), default=(NODE_REACH**2, None))
    return k if d2 < NODE_REACH**2 else None


def edge_at(state: dict, x: float, y: float) -> list[int] | None:
    best, found = float(EDGE_REACH**2), None
    for e in state["edges"]:
        a, b = (state["nodes"][k] for k in e)
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        long2 = dx * dx + dy * dy
        t = min(1.0, max(0.0, ((x - a["x"]) * dx + (y - a["y"]) * dy) / long2)) if long2 else 0.0
        d2 = (x - a["x"] - t * dx) ** 2 + (y - a["y"] - t * dy) ** 2
        if d2 < best:
            best, found = d2, e
    return found


def _delete_node(state: dict, gone: int) -> None:
    state["nodes"].pop(gone)
    state["edges"] = sorted([i - (i > gone), j - (j > gone)] for i, j in state["edges"] if gone not in (i, j))
    if state["first"] is not None:
        state["first"] = None if state["first"] == gone else state["first"] - (state["first"] > gone)


def _click(state: dict, x: float, y: float, shift: bool) -> None:
    k = node_at(state, x, y)
    if state["adding"]:
        if k is None:
            return
        if state["first"] is None:
            state["first"] = k
        elif state["first"] != k:
            e = sorted((state["first"], k))
            state["edges"] = sorted([f for f in state["edges"] if f != e] + ([] if e in state["edges"] else [e]))
            state["adding"], state["first"] = False, None
    elif k is not None and shift:
        _delete_node(state, k)
    elif k is not None:
        node = state["nodes"][k]
        node["shape"] = SHAPES[(SHAPES.index(node["shape"]) + 1) % len(SHAPES)]
        node["degree"] = graph.SHAPE_DEGREE[node["shape"]]
    elif (e := edge_at(state, x, y)) is not None:
        state["edges"].remove(e)
    else:
        state["nodes"].append({"x": round(x), "y": round(y), "radius": ADDED_RADIUS, "shape": SHAPES[0], "degree": graph.SHAPE_DEGREE[SHAPES[0]]})


def apply(state: dict, action: str | None, x: float | None, y: float | None, value: str | None) -> dict:
    state["events"] += 1
    if action in ("click", "shift_click"):
        if not (pd.isna(x) or pd.isna(y)):
            _click(state, float(x), float(y), action == "shift_click")
    elif action == "key":
        if value == "a":
            state["adding"], state["first"] = not state["adding"], None
        elif value == "escape":
            state["adding"], state["first"] = False, None
        elif value in ("+", "=", "-"):
            state["ring"] = max(graph.LEAST_RING, state["ring"] + (-1 if value == "-" else 1))
    return state


def report(crop: str, state: dict) -> dict:
    """The state and what the battery says of it, with the ring that was set as label."""
    vertices = [(k, n["degree"], (n["x"], n["y"])) for k, n in enumerate(state["nodes"])]
    bad, _, _ = graph.battery(vertices, [tuple(e) for e in state["edges"]], state["ring"])
    return {"crop": crop, "events": state["events"], "nodes": json.dumps(state["nodes"]), "edges": json.dumps(state["edges"]), "ring": state["ring"], "ok": not bad, "failures": bad}


ORDER = ["seq", "action", "x", "y", "value"]


def _fold(state: dict, log: list[tuple]) -> dict:
    """log: rows of ORDER; nulls sort first."""
    for _, action, x, y, value in sorted(log, key=lambda row: [(v is not None, v) for v in row]):
        apply(state, action, x, y, value)
    return state


def fold(log: DataFrame) -> DataFrame:
    """The last state of each crop of a finished log; events without a crop are one group of their own. One shuffle on crop, then Arrow batches of whole logs."""
    shape = _parse_datatype_string(RESULT)
    arrow = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logs = zip(batch.column("crop").to_pylist(), batch.column("log").to_pylist(), strict=True)
            yield pa.RecordBatch.from_pylist([report(crop, _fold(start(), [tuple(e[c] for c in ORDER) for e in events])) for crop, events in logs], arrow)

    return log.groupBy("crop").agg(F.collect_list(F.struct(*ORDER)).alias("log")).mapInArrow(run, shape)


def stream(log: DataFrame) -> DataFrame:
    """The same over a streaming log: after each micro-batch the new state of the crops it touched. Output mode: update."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        state = json.loads(kept.get[0]) if kept.exists else start()
        rows = pd.concat(batches)[ORDER].astype(object)
        _fold(state, list(rows.where(rows.notna(), None).itertuples(index=False, name=None)))
        kept.update((json.dumps(state),))
        yield pd.DataFrame([report(key[0], state)])

    return log.select("crop", *ORDER).groupBy("crop").applyInPandasWithState(run, RESULT, "state string", "update", GroupStateTimeout.NoTimeout)
