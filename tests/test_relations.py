"""Operators over tables of graphs a user brings, and jobs over files."""

import json
from itertools import combinations

import numpy as np
import pytest

from facetflow.functions import records as R
from facetflow.operators import battery
from facetflow.operators import relations as ops
from facetflow.plans import jobs

DIAMOND = [(0, 1), (-1, 0), (0, -1), (1, 0)]
RIM = [(0, 1), (1, 2), (2, 3), (3, 0)]
JUNE = [(123, 42), (46, 146), (192, 146), (124, 223)]
JUNE_EDGES = [(0, 1), (0, 2), (1, 2), (1, 3)]
HUB = [(0, k) for k in range(1, 7)] + [(k, k % 6 + 1) for k in range(1, 7)]
# name: degrees, positions or None, edges, ring, tags
CASES = {
    "diamond": ([5] * 4, DIAMOND, [*RIM, (0, 2)], 6, []),
    "single": ([5], None, [], 5, []),
    "june": ([5] * 4, JUNE, JUNE_EDGES, 6, ["RING_MISMATCH"]),
    "june mended": ([5] * 4, JUNE, [*JUNE_EDGES, (2, 3)], 6, []),
    "hole": ([5] * 4, DIAMOND, RIM, None, ["NONTRIANGULAR_INTERIOR_FACE", "RING_WALK_MISMATCH"]),
    "disconnected": ([5] * 4, None, [(0, 1), (2, 3)], None, ["DISCONNECTED"]),
    "k5": ([6] * 5, None, list(combinations(range(5), 2)), None, ["NONPLANAR"]),
    "overflow": ([5] * 7, None, HUB, None, ["DEGREE_OVERFLOW"]),
    "doubled": ([5] * 4, DIAMOND, [*RIM, (0, 2), (1, 0), (2, 2)], None, ["SELF_LOOP", "DUPLICATE_EDGE"]),
    "low, in two parts": ([5, 4, 5, 5], DIAMOND, [(0, 1), (2, 3)], None, ["DEGREE_TOO_SMALL"]),
    "large": ([15], None, [], None, ["RING_TOO_LARGE"]),
}


@pytest.fixture(scope="module")
def graphs(spark):
    nodes = [(name, i, d, *(at[i] if at else (None, None)), 9, "solid_dot") for name, (degrees, at, _, _, _) in CASES.items() for i, d in enumerate(degrees)]
    edges = [(name, *e) for name, c in CASES.items() for e in c[2]]
    labels = [(name, c[3]) for name, c in CASES.items() if c[3]]
    return ops.graphs(spark.createDataFrame(nodes, "crop string, id int, degree int, x int, y int, radius int, shape string"), spark.createDataFrame(edges, "crop string, u int, w int"), spark.createDataFrame(labels, "crop string, ring int"))


def test_battery_over_a_users_tables(graphs):
    got = {r.crop: r for r in battery.report(graphs).collect()}
    assert {k: sorted(f.split(":")[0] for f in r.failures) for k, r in got.items()} == {k: sorted(c[4]) for k, c in CASES.items()}
    assert (got["diamond"].E_total, got["june"].ring_delta, got["june mended"].ring_walk, got["single"].implied_ring) == (21, 1, 6, 5)


def test_columns_say_what_the_battery_says(graphs):
    s = {r.crop: r for r in ops.sums(graphs).collect()}
    assert {k: r.implied_ring for k, r in s.items() if k in ("diamond", "single", "june", "k5", "overflow")} == {"diamond": 6, "single": 5, "june": 7, "k5": 8, "overflow": 5}
    assert {r.crop: r.connected for r in ops.connected(graphs).collect()} == {k: k not in ("disconnected", "low, in two parts") for k in CASES}
    assert {(r.crop, r.tag): r.n for r in ops.structural_failures(graphs).collect()} == {("doubled", "SELF_LOOP"): 1, ("doubled", "DUPLICATE_EDGE"): 1, ("low, in two parts", "DEGREE_TOO_SMALL"): 1}
    assert {r.crop: [f.split(":")[0] for f in r.failures] for r in ops.checks(graphs).collect() if r.failures} == {"june": ["RING_MISMATCH"], "overflow": ["DEGREE_OVERFLOW"], "large": ["RING_TOO_LARGE"]}
    lines = {r.crop: r.line for r in ops.identity(ops.sums(graphs)).collect()}
    assert lines["diamond"] == "[VALID] V=10, E=21, E*=21, r=6"
    assert {r.crop: r.verdict for r in ops.ring_label_check(ops.sums(graphs)).collect()} == {"diamond": None, "single": None, "june": "missed", "june mended": None}
    assert {r.crop: r.ring for r in ops.infer_ring(graphs).collect()}["large"] is None


def test_golden_scores(spark, graphs):
    names = {"june mended": "a", "june": "a", "diamond": "b"}
    pick = lambda case: graphs.where(f"crop = '{case}'").replace(names, subset="crop")
    golden = pick("june mended").unionByName(pick("diamond"))
    score = ops.score_golden(golden, pick("june")).first()
    assert (score.crops, score.missing, score.tp_n, score.fp_n, score.fn_n, score.shape_ok, score.tp_e, score.fp_e, score.fn_e, score.p_e, score.r_e) == (2, 1, 4, 0, 0, 4, 4, 0, 1, 1.0, 0.8)
    none = ops.score_golden(golden, pick("june").limit(0)).first()
    assert (none.missing, none.p_n, none.r_e, none.shapes) == (2, 0.0, 0.0, 0.0)


def test_queue_and_ranks(spark):
    rows = [(k, k % 3 == 0, "verify in HITL" if k % 2 else "", ["x"] * (k % 5), k % 4) for k in range(200)]
    run = spark.createDataFrame(rows, "crop int, ok boolean, note string, failures array<string>, n_nodes int")
    want = sorted(((0, 0) if ok and note else (1, len(f)), k) for k, ok, note, f, n in rows if (not ok or note))
    assert [r.crop for r in sorted(ops.queue(run).collect(), key=lambda r: r.place)] == [k for _, k in want]
    assert sorted(r.place for r in ops.queue(run, skip_empty=True).collect()) == list(range(1, 1 + sum(rows[k][4] > 0 for _, k in want)))
    files = spark.createDataFrame([(5,), (6,), (6,)], "crop int")
    assert sorted(r.crop for r in ops.of_files(run.select("crop"), files).collect()) == [5, 6]
    assert ops.ranked(run.limit(0), "crop").count() == 0
    twice = spark.createDataFrame([("a", 1, True), ("a", 2, False)], "crop string, at int, ok boolean")
    assert [r.ok for r in ops.last_of_each(twice, "at").collect()] == [False]


def test_shape_and_degree():
    assert R.SCHEMA_VERSION == "1.1"


def test_annotations_are_folded_back(spark, tmp_path):
    folder = tmp_path / "annotations"
    folder.mkdir()

    def annotation(name, crop, ring, degree=5, letter=None):
        record = {"id": name, "vertices": [{"id": k, "degree": degree, "shape": "solid_dot", "pos": list(map(float, p)), "radius": None} for k, p in enumerate(DIAMOND)], "edges": [list(e) for e in [*RIM, (0, 2)]], "ring_size": ring, "reducibility": letter, "provenance": {"crop": crop}}
        (folder / f"{name}.json").write_text(json.dumps(record))

    annotation("a", "page014_cell000.png", 6)
    annotation("b", None, 6, letter="C")
    annotation("c", "page014_cell000.png", None)
    annotation("wrong", "x.png", 9)
    annotation("shape", "y.png", None, degree=6)
    labels, index = tmp_path / "labels.json", tmp_path / "index.json"
    labels.write_text(json.dumps({"b.png": 7, "other.png": 8}))
    index.write_text(json.dumps([{"crop": "page014_cell000.png", "figure": 1, "position": 1, "letter": "D"}, {"crop": "b.png", "figure": 2, "position": 3, "letter": "D"}]))
    for force, conflicts, ring in ((False, 2, 7), (True, 0, 6)):
        got = jobs.fold_back(spark, str(folder), str(labels), str(index), str(tmp_path / "dataset"), force)
        assert tuple(got["counts"].first()) == (3, 2, conflicts)
        assert json.loads(labels.read_text()) == {"b.png": ring, "other.png": 8, "page014_cell000.png": 6}
    assert sorted(p.name for p in (tmp_path / "dataset").glob("*.json")) == ["a.json", "b.json", "c.json"]
    a, b = (json.loads((tmp_path / "dataset" / f"{n}.json").read_text()) for n in "ab")
    assert (a["reducibility"], a["provenance"]["figure_ref"], b["reducibility"], b["provenance"]["figure_ref"]) == ("D", "Table U 1-1", "C", "Table U 2-3")
    assert {r.bucket: r.n for r in got["census"].collect()}["<=8"] == 2 and sorted(r.file_name for r in got["rejected"].collect()) == ["shape.json", "wrong.json"]


def test_jobs_over_files(spark, tmp_path):
    from facetflow.operators import raster

    from .test_raster import drawing

    dots = [(60, 60), (200, 60), (60, 200)]
    sides = [(dots[0], dots[1]), (dots[1], dots[2]), (dots[2], dots[0])]
    crops = tmp_path / "crops"
    crops.mkdir()
    (crops / "page014_cell000.png").write_bytes(raster.png(drawing(dots, sides)))
    (crops / "page014_cell001.png").write_bytes(raster.png(np.full((60, 60), 255, np.uint8)))
    (crops / "page013_cell000.png").write_bytes(b"before the first page")
    (tmp_path / "labels.json").write_text(json.dumps({"page014_cell000.png": 6}))
    run, summary = jobs.batch_run(spark, str(crops), str(tmp_path / "run.json"), str(tmp_path / "labels.json"))
    s = summary.first()
    assert (s.total, s.valid, s.valid_labeled, s.no_nodes, s.errors) == (2, 1, 1, 1, 0) and run.count() == 2
    golden = [{"crop": "page014_cell000.png", "ring": 6, "nodes": [{"x": x, "y": y, "shape": "solid_dot", "degree": 5} for x, y in dots], "edges": [[0, 1], [1, 2], [0, 2]], "provenance": "by hand"}]
    (tmp_path / "golden.json").write_text(json.dumps(golden))
    got = jobs.evaluate(spark, str(tmp_path / "run.json"), str(tmp_path / "run.json"), str(tmp_path / "golden.json"))
    assert (got["battery"].first().crops, got["golden"].first().r_e, got["missing"].count()) == (2, 1.0, 0)
    page = np.full((500, 700), 255, np.uint8)
    page[100:340, 120:128], page[100:340, 400:408], page[100:108, 120:400], page[332:340, 120:400] = 0, 0, 0, 0
    boxes = jobs.cut_pages(spark, spark.createDataFrame([(14, 500, bytearray(page.tobytes()))], "page int, rows int, content binary"), str(tmp_path / "cut")).collect()
    assert [b.crop for b in boxes] == ["page014_cell000.png"] and raster.from_png((tmp_path / "cut" / "page014_cell000.png").read_bytes()).shape == (boxes[0].h + 20, boxes[0].w + 20)
    both = jobs.diamond(spark).unionByName(jobs.single(spark))
    assert {r.crop: (r.ok, r.implied_ring) for r in battery.report(jobs.graphs_of_records(both)).collect()} == {"birkhoff-diamond": (True, 6), "single-v5": (True, 5)}


def test_slot_index(spark):
    from facetflow.operators import slots

    boxes = spark.createDataFrame([(14, 0, 20, 20, 100, 150), (14, 1, 230, 10, 120, 160)], "page int, id int, x int, y int, w int, h int")
    words = spark.createDataFrame([(14, 0, 10, 380, "I"), (14, 1, 60, 385, "d"), (14, 2, 250, 380, "3"), (14, 3, 500, 100, "see")], "page int, ord int, cx int, cy int, token string")
    ink = spark.createDataFrame([(14, 3, 9000, 5000), (14, 4, 6000, 4500), (14, 5, 10, 5)], "page int, position int, slot_ink long, core_ink long")
    rings = spark.createDataFrame([("page014_cell001.png", 6)], "crop string, ring int")
    got = slots.index(spark, boxes, words, ink, [100.0, 300.0, 500.0, 700.0, 900.0], [200.0, 600.0], rings).orderBy("rank").collect()
    assert [(r.figure, r.position, r.crop, r.missing_crop, r.ocr_position, r.ocr_agrees, r.letter, r.rank, r.ring) for r in got] == [
        (1, 1, "page014_cell000.png", False, 1, True, "D", 1, None), (1, 2, "page014_cell001.png", False, 3, False, "D" if got[1].letter else None, 2, 6), (1, 4, None, True, None, None, None, 3, None),
    ]
    assert tuple(slots.report(spark.createDataFrame(got)).first())[:4] == (3, 1, 2, 1)
