import json

from pyspark.sql import functions as F

from facetflow.functions import records as R
from facetflow.sources import records as sources
from facetflow.sources import sinks
from facetflow.streaming import edits

DETECTION = {
    "crop": "page014_cell000.png", "page": 14, "node_count": 2, "edge_count": 1, "euler_valid": True, "validation_note": "ok (verify in HITL)", "failures": [],
    "nodes": [{"x": 1, "y": 2, "radius": 9, "shape": "solid_dot", "degree": 5, "recovered": False}, {"x": None, "y": None, "radius": None, "shape": None, "degree": 6, "recovered": True}],
    "edges": [{"from": 0, "to": 1}], "warnings": ["UNRESOLVED_JUNCTION: strokes meet at (3, 4) touching nodes [0]", "other at (1, 1)"],
}


def test_detection_to_canonical_and_back(spark, tmp_path):
    (tmp_path / "run.json").write_text(json.dumps([DETECTION, {"crop": None, "page": None}]))
    run = sources.read_run(spark, str(tmp_path / "run.json"))
    rows = run.select(*R.canonical(F.lit(6))).orderBy("id")
    one, none = rows.collect()
    assert (one.id, one.ring_size, one.edges, one.provenance.extraction, one.provenance.source_document) == ("page014_cell000", 6, [[0, 1]], "cv", "Part II PDF, page 14")
    assert [v.pos for v in one.vertices] == [[1.0, 2.0], None] and (none.id, none.vertices) == ("unknown", [])
    sinks.write_canonical(rows.where("id <> 'unknown'"), str(tmp_path / "out"))
    assert json.loads((tmp_path / "out" / "page014_cell000.json").read_text())["schema_version"] == "1.1"
    (tmp_path / "out" / "zb.json").write_text(json.dumps({"id": "b", "vertices": [], "edges": []}))
    sinks.write_canonical(rows.where("id = 'unknown'").withColumn("id", F.lit("odd id=é")), str(tmp_path / "out"))  # others stay
    sinks.write_canonical(rows.where("id <> 'unknown'").withColumn("ring_size", F.lit(9)), str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith((".", "_"))) == ["odd id=é.json", "page014_cell000.json", "zb.json"]
    back = [r for r in sources.read_canonical(spark, str(tmp_path / "out")).orderBy("file_name").collect() if r.id != "odd id=é"]
    assert back[0].vertices == one.vertices and back[0].provenance == one.provenance and back[0].ring_size == 9
    assert (back[1].file_name, back[1].provenance.extraction, back[1].provenance.human_corrected) == ("zb.json", "manual", False)


def test_queue_and_pointers(spark, tmp_path):
    (tmp_path / "run.json").write_text(json.dumps([DETECTION, {"crop": "b", "euler_valid": True}, {"crop": "c", "failures": ["A: x", "B"]}, {"crop": "d", "failures": ["A: y"]}]))
    run = sources.read_run(spark, str(tmp_path / "run.json"))
    queue = run.where(R.in_queue(F.col("euler_valid"), F.col("validation_note"))).orderBy(R.queue_order(F.col("euler_valid"), F.col("validation_note"), F.col("failures")), "crop")
    assert [r.crop for r in queue.collect()] == ["page014_cell000.png", "d", "c"]
    assert run.where("page = 14").select(F.to_json(R.pointers(F.col("warnings")))).first()[0] == '[{"kind":"junction","at":{"x":3,"y":4}}]'


def test_expressions(spark):
    def one(column):
        return spark.range(1).select(column).first()[0]

    assert one(R.page_number(F.lit("page014_cell000.png"))) == 14 and one(R.page_number(F.lit("x"))) is None
    assert one(R.crop_name(F.lit(7), F.lit(12))) == "page007_cell012.png"
    assert [one(R.slot_number(F.lit(t))) for t in ("I2", "o7", "36", "#", "1#", "123", "x")] == [12, 7, None, None, 1, None, None]
    assert [one(R.slot_letter(F.lit(t))) for t in ("c", "D", "e", "cd")] == ["C", "D", None, None]
    assert [one(R.shape_agrees(F.lit(s), F.lit(d))) for s, d in (("solid_dot", 6), ("solid_dot", 5), ("triangle", 7), ("triangle", 9), (None, 3), ("odd", 3))] == [False, True, False, True, True, True]
    note = R.validation_note(F.lit(True), F.array(), F.lit(6), F.lit(10), F.lit(6))
    assert one(note) == "r=6, E_att=16 (ring verified)"
    assert one(R.validation_note(F.lit(False), F.array(F.lit("A"), F.lit("B")), F.lit(6), F.lit(10), F.lit(None).cast("int"))) == "A; B"
    assert one(R.polygon_shape(F.lit(500.0), F.lit(120.0), F.lit(4))) == "square" and one(R.polygon_shape(F.lit(399.0), F.lit(120.0), F.lit(4))) is None
    assert one(R.solid_gate(F.lit(0.7), F.lit(1), F.lit(14))) and not one(R.solid_gate(F.lit(0.7), F.lit(1), F.lit(13)))


def test_maps_arrays_and_index(spark, tmp_path):
    missing = str(tmp_path / "none.json")
    assert sources.read_map(spark, missing).count() == sources.read_golden(spark, missing).count() == sources.read_index(spark, missing).count() == 0
    old, new = (spark.createDataFrame(rows, "crop string, ring int") for rows in ([("a", 5), ("b", 6)], [("b", 7), ("ü", 8)]))
    path = str(tmp_path / "labels.json")
    sinks.write_map(sinks.upsert(old, new), path)
    assert json.loads(open(path).read()) == {"a": 5, "b": 6, "ü": 8}
    assert sorted(map(tuple, sources.read_map(spark, path).collect())) == [("a", 5), ("b", 6), ("ü", 8)]
    assert sorted(map(tuple, sinks.upsert(old, new, force=True).collect())) == [("a", 5), ("b", 7), ("ü", 8)]
    for rows, name in (([], "no.json"), ([("b", None), ("a", 1)], "two.json")):
        sinks.write_array(spark.createDataFrame(rows, "crop string, ring int"), str(tmp_path / name), "crop")
    assert open(tmp_path / "no.json").read() == "[]"
    assert open(tmp_path / "two.json").read() == json.dumps([{"crop": "a", "ring": 1}, {"crop": "b", "ring": None}], indent=2)
    (tmp_path / "index.json").write_text(json.dumps([{"crop": "a", "rank": 2}, {"crop": "a", "rank": 1}, {"crop": None, "rank": 3}]))
    assert [(r.crop, r.rank) for r in sources.read_index(spark, str(tmp_path / "index.json")).collect()] == [("a", 1)]
    good, bad = sinks.gated(spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, ok boolean"), F.col("ok"))
    assert [r.id for r in good.collect()] == [1] and sorted(r.id for r in bad.collect()) == [2, 3]


def test_crops(spark, tmp_path):
    for name in ("page014_cell000.png", "page014_cell000_debug.png", "page009_cell001.png", "other.png"):
        (tmp_path / name).write_bytes(b"x")
    assert [tuple(r)[1:] for r in sources.list_crops(spark, str(tmp_path), 10).collect()] == [("page014_cell000.png", 14)]
    assert [bytes(r.content) for r in sources.read_crops(spark, str(tmp_path), 10).collect()] == [b"x"]
    assert {k: v.count() for k, v in sources.constants(spark).items()} == {"shapes": 4, "census": 7, "ring_labels": 2, "xref_slots": 1}
    words = spark.createDataFrame([(1, "see", 0.0, 0.0, 2.0, 4.0)], "page int, token string, x0 double, y0 double, x1 double, y1 double")
    assert tuple(sources.words(words, 2.0, (0, 1, 5, 1, 0, 0)).first())[2:] == (9.0, 2.0)


LOG = [
    ("a", 1, "click", 10.0, 10.0, None), ("a", 2, "click", 100.0, 10.0, None), ("a", 3, "click", 50.0, 90.0, None),
    ("a", 4, "key", None, None, "a"), ("a", 5, "click", 12.0, 9.0, None), ("a", 6, "click", 300.0, 300.0, None), ("a", 7, "click", 99.0, 12.0, None),
    ("a", 8, "key", None, None, "a"), ("a", 9, "click", 100.0, 10.0, None), ("a", 10, "click", 50.0, 90.0, None),
    ("a", 11, "click", 100.0, 10.0, None), ("a", 12, "shift_click", 10.0, 10.0, None), ("a", 13, "key", None, None, "-"),
    ("b", 1, "key", None, None, "-"), ("b", 2, "key", None, None, "-"), ("b", 3, "key", None, None, "-"), ("b", 4, "key", None, None, "-"), ("b", 5, "key", None, None, "+"), ("b", 6, "odd", None, None, None), ("b", 7, "click", None, 3.0, None),
]
COLUMNS = "crop string, seq long, action string, x double, y double, value string"


def check_edits(rows):
    got = {r.crop: r for r in rows}
    assert [(n["x"], n["shape"], n["degree"]) for n in json.loads(got["a"].nodes)] == [(100, "open_circle", 6), (50, "solid_dot", 5)]
    assert (json.loads(got["a"].edges), got["a"].ring, got["a"].events, got["a"].ok) == ([[0, 1]], 5, 13, False)
    assert (got["b"].ring, got["b"].events, got["b"].failures) == (4, 7, ["EMPTY: there is no vertex"])


def test_edits_as_a_batch(spark):
    check_edits(edits.fold(spark.createDataFrame(LOG, COLUMNS).repartition(3)).collect())
    assert edits.fold(spark.createDataFrame([], COLUMNS)).count() == 0


def test_click_on_an_edge_deletes_it():
    state = edits.start([{"x": 0, "y": 0, "radius": 9, "shape": "square", "degree": 7}, {"x": 100, "y": 0, "radius": 9, "shape": "triangle", "degree": 8}], [[0, 1]])
    edits.apply(state, "click", 50, 10, None)
    assert state["edges"] == [[0, 1]] and len(state["nodes"]) == 3  # ten pixels off is too far
    edits.apply(state, "click", 30, 9, None)
    assert state["edges"] == []


def test_edits_as_a_stream(spark, tmp_path):
    source, rows = str(tmp_path / "log"), spark.createDataFrame(LOG, COLUMNS)
    for bound in ("seq <= 4", "seq > 4 and seq <= 9", "seq > 9"):
        rows.where(bound).coalesce(1).write.mode("append").parquet(source)
        query = (
            edits.stream(spark.readStream.schema(COLUMNS).parquet(source)).writeStream.outputMode("update")
            .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True)
        )
        query = query.foreachBatch(lambda df, _: df.write.mode("append").parquet(str(tmp_path / "out"))).start()
        assert query.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    check_edits(out.groupBy("crop").agg(F.max_by(F.struct("crop", "events", "nodes", "edges", "ring", "ok", "failures"), "events").alias("r")).select("r.*").collect())
