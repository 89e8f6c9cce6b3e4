from itertools import combinations

import pytest

from facetflow.operators.graph import battery, connected, faces, greedy_match, planar

DIAMOND = [(0, 1), (-1, 0), (0, -1), (1, 0)]
RIM = [(0, 1), (1, 2), (2, 3), (3, 0)]
JUNE = [(123, 42), (46, 146), (192, 146), (124, 223)]


def points(positions, degree=5):
    return [(i, degree, p) for i, p in enumerate(positions)]


def tags(failures):
    return [f.split(":")[0] for f in failures]


@pytest.mark.parametrize(
    "vertices, edges, ring, want, values",
    [
        (points(DIAMOND), [*RIM, (0, 2)], 6, [], {"implied_ring": 6, "E_total": 21, "faces": 3, "outer_walk_len": 4, "ring_walk": 6}),
        ([(0, 5, None)], [], 5, [], {"implied_ring": 5, "E_total": 10}),
        (points(JUNE), [(0, 1), (0, 2), (1, 2), (1, 3)], None, [], {"implied_ring": 7, "E_total": 23, "faces": 2, "outer_walk_len": 5, "ring_walk": 7}),
        (points(JUNE), [(0, 1), (0, 2), (1, 2), (1, 3)], 6, ["RING_MISMATCH"], {"ring_delta": 1}),
        (points(JUNE), [(0, 1), (0, 2), (1, 2), (1, 3), (2, 3)], 6, [], {"ring_delta": 0, "faces": 3}),
        (points(DIAMOND), [*RIM, (0, 2), (1, 3)], 6, ["GEOM_EDGE_CROSSING", "NONTRIANGULAR_INTERIOR_FACE", "RING_WALK_MISMATCH", "RING_MISMATCH"], {"ring_delta": -1}),
        (points(DIAMOND), RIM, None, ["NONTRIANGULAR_INTERIOR_FACE", "RING_WALK_MISMATCH"], {"ring_walk": 8}),
        (points([None] * 4), [(0, 1), (2, 3)], None, ["DISCONNECTED"], {"implied_ring": 9}),
        (points([None] * 5, 6), list(combinations(range(5), 2)), None, ["NONPLANAR"], {"implied_ring": 8}),
        (points([None] * 7), [(0, k) for k in range(1, 7)] + [(k, k % 6 + 1) for k in range(1, 7)], None, ["DEGREE_OVERFLOW"], {"implied_ring": 5}),
        ([(0, 15, None)], [], None, ["RING_TOO_LARGE"], {"implied_ring": 15}),
        (points(DIAMOND), [*RIM, (0, 2), (1, 0), (2, 2)], None, ["DUPLICATE_EDGE", "SELF_LOOP"], {}),
        ([(0, 4, None)], [], None, ["DEGREE_TOO_SMALL"], {}),
        ([], [], None, ["EMPTY"], {}),
    ],
)
def test_battery(vertices, edges, ring, want, values):
    failures, _, got = battery(vertices, edges, ring)
    assert tags(failures) == want
    assert {k: got.get(k) for k in values} == values


def test_planarity():
    k33 = [(i, j) for i in range(3) for j in range(3, 6)]
    petersen = [(i, (i + 1) % 5) for i in range(5)] + [(i, i + 5) for i in range(5)] + [(5 + i, 5 + (i + 2) % 5) for i in range(5)]
    grid = [(3 * i + j, 3 * i + j + 1) for i in range(3) for j in range(2)] + [(3 * i + j, 3 * i + j + 3) for i in range(2) for j in range(3)]
    assert not planar(range(6), k33) and not planar(range(10), petersen)
    assert planar(range(9), grid) and planar(range(6), k33[1:])
    assert connected(range(3), [(0, 1), (1, 2)]) and not connected(range(3), [(0, 1)])


def test_each_dart_lies_in_one_face():
    walks, _ = faces(dict(enumerate(DIAMOND)), [*RIM, (0, 2)])
    darts = [d for w in walks for d in w]
    assert len(darts) == len(set(darts)) == 10


def test_greedy_match():
    assert greedy_match([(0, 0), (10, 0)], [(9, 0), (40, 0)]) == {1: 0}


def test_both_runs_are_judged_by_the_same_battery(spark):
    from facetflow.plans import derived, graphs

    folder = "/root/testdata/sf0.001"
    new = derived.graphs(spark, folder)
    base = derived.baseline(new)
    passes = []
    for g in (new, base):
        rows = g.collect()
        passes.append({r["crop"]: not battery([(v["id"], v["degree"], (v["x"], v["y"])) for v in r["vertices"]], [(e["u"], e["w"]) for e in r["edges"]], r["ring"])[0] for r in rows})
    changes = {r["crop"]: r["change"] for r in graphs.battery_run_changes(spark, folder).collect()}
    assert changes == {c: "fixed" if ok else "broken" for c, ok in passes[0].items() if ok != passes[1][c]} and set(changes.values()) == {"fixed", "broken"}
    got = graphs.battery_run_summary(spark, folder).first()
    assert (got["crops"], got["new_pass"], got["base_pass"]) == (len(passes[0]), sum(passes[0].values()), sum(passes[1].values()))
    histogram = {r["tag"]: (r["new_count"], r["base_count"]) for r in graphs.battery_run_histogram(spark, folder).collect()}
    assert histogram["DEGREE_OVERFLOW"][1] == sum(sum(e["u"] == v["id"] or e["w"] == v["id"] for e in r["edges"]) > v["degree"] for r in base.collect() for v in r["vertices"]) > 0


def test_summary_and_queue_take_the_whole_battery(spark):
    import __spark_entry__ as entry

    folder, queries = "/root/testdata/sf0.001", entry.queries()
    reports = {r["crop"]: r["failures"].split("; ") if r["failures"] else [] for r in queries["full_battery"](spark, folder).collect()}
    got = queries["battery_summary"](spark, folder).first()
    assert (got["total"], got["valid"]) == (len(reports), sum(not f for f in reports.values()))
    for name, tag in (("disconnected", "DISCONNECTED"), ("nonplanar", "NONPLANAR"), ("overflow", "DEGREE_OVERFLOW"), ("out_of_range", "RING_TOO"), ("mismatch", "RING_MISMATCH"), ("errors", "ERROR")):
        assert got[name] == sum(any(x.startswith(tag) for x in f) for f in reports.values()), name
    assert got["disconnected"] > 0 and got["no_nodes"] == 0
    queue = queries["battery_queue"](spark, folder).collect()
    assert [r["crop"] for r in sorted(queue, key=lambda r: r["place"])] == [c for _, c in sorted((len(f), c) for c, f in reports.items() if f)]
