"""Column expressions over detections and canonical records: built-in functions only, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Schemas of the record files.
NODE = "struct<x:int,y:int,radius:int,shape:string,degree:int,recovered:boolean>"
DETECTION = (
    f"crop string, page int, nodes array<{NODE}>, node_count int, edges array<struct<`from`:int,`to`:int>>, edge_count int, ring_size int, labeled_ring int, "
    "e_attachment int, euler_valid boolean, validation_note string, failures array<string>, warnings array<string>, human_corrected boolean"
)
VERTEX = "struct<id:int,degree:int,shape:string,pos:array<double>,radius:int>"
PROVENANCE = "struct<source_document:string,crop:string,figure_ref:string,extraction:string,human_corrected:boolean,notes:string>"
CANONICAL = f"id string, vertices array<{VERTEX}>, edges array<array<int>>, ring_size int, reducibility string, provenance {PROVENANCE}, schema_version string"
GOLDEN = "crop string, ring int, nodes array<struct<x:int,y:int,shape:string,degree:int>>, edges array<array<int>>, provenance string"
INDEX = "page int, figure int, position int, crop string, missing_crop boolean, slot_ink long, ocr_position int, ocr_agrees boolean, letter string, rank int, ring int"
SCHEMA_VERSION = "1.1"
VERIFY = "verify in HITL"


def page_number(name: Column) -> Column:
    return F.regexp_extract(name, r"page(\d+)_", 1).try_cast("int")


def crop_name(page: Column, cell: Column) -> Column:
    return F.format_string("page%03d_cell%03d.png", page, cell)


def canonical(labeled_ring: Column | None = None, reducibility: Column | None = None) -> list[Column]:
    """The columns of a canonical record, of those of a detection. The place of a node is its id; the ring is the label, never the detection's own."""
    null = F.lit(None)
    nodes, edges, fixed = F.coalesce("nodes", F.array().cast(f"array<{NODE}>")), F.coalesce("edges", F.array().cast("array<struct<`from`:int,`to`:int>>")), F.coalesce("human_corrected", F.lit(False))
    vertex = lambda n, i: F.struct(i.cast("int").alias("id"), n.degree.alias("degree"), n["shape"].alias("shape"), F.when(n.x.isNotNull(), F.array(n.x.cast("double"), n.y.cast("double"))).alias("pos"), n.radius.alias("radius"))
    source = F.concat(F.lit("Part II PDF, page "), F.coalesce(F.col("page").cast("string"), F.lit("None")))
    provenance = F.struct(
        source.alias("source_document"), F.col("crop"), null.cast("string").alias("figure_ref"), F.when(fixed, "cv+hitl").otherwise("cv").alias("extraction"), fixed.alias("human_corrected"), null.cast("string").alias("notes")
    )
    return [
        F.replace(F.coalesce("crop", F.lit("unknown")), F.lit(".png"), F.lit("")).alias("id"),
        F.transform(nodes, vertex).alias("vertices"),
        F.transform(edges, lambda e: F.array(e["from"], e["to"])).alias("edges"),
        (labeled_ring if labeled_ring is not None else null).cast("int").alias("ring_size"),
        (reducibility if reducibility is not None else null).cast("string").alias("reducibility"),
        provenance.alias("provenance"),
        F.lit(SCHEMA_VERSION).alias("schema_version"),
    ]


def degree_of(shape: Column) -> Column:
    # Fixed values.
    return F.when(shape == "solid_dot", 5).when(shape == "open_circle", 6).when(shape == "square", 7).when(shape == "triangle", 8)


def shape_agrees(shape: Column, degree: Column) -> Column:
    """A triangle stands for 8 and more, other shapes for one degree, unknown and null ones for any."""
    return F.coalesce(F.when(shape == "triangle", degree >= 8).otherwise(degree == degree_of(shape)), F.lit(True))


def validation_note(ok: Column, failures: Column, implied_ring: Column, e_att: Column, labeled_ring: Column) -> Column:
    good = F.concat(F.lit("r="), implied_ring.cast("string"), F.lit(", E_att="), (e_att + implied_ring).cast("string"), F.when(labeled_ring.isNotNull(), " (ring verified)").otherwise(""))
    return F.when(ok, good).otherwise(F.concat_ws("; ", failures))


def tag(failure: Column) -> Column:
    return F.split(failure, ":", 2)[0]


def _verify(note: Column) -> Column:
    return F.contains(F.coalesce(note, F.lit("")), F.lit(VERIFY))


def in_queue(valid: Column, note: Column) -> Column:
    """All but clean passes."""
    return ~(F.coalesce(valid, F.lit(False)) & ~_verify(note))


def queue_order(valid: Column, note: Column, failures: Column) -> Column:
    """Quick confirmations first, then by the number of failures."""
    first = F.coalesce(valid, F.lit(False)) & _verify(note)
    return F.when(first, F.struct(F.lit(0).alias("p0"), F.lit(0).alias("p1"))).otherwise(F.struct(F.lit(1).alias("p0"), F.size(F.coalesce(failures, F.array().cast("array<string>"))).alias("p1")))


def pointers(warnings: Column) -> Column:
    """Places that the warnings of unresolved junctions name."""
    some = F.filter(warnings, lambda w: F.contains(w, F.lit("UNRESOLVED_JUNCTION")) & w.rlike(r"at \(\d+, \d+\)"))
    at = lambda w, k: F.regexp_extract(w, r"at \((\d+), (\d+)\)", k).cast("int")
    return F.transform(some, lambda w: F.struct(F.lit("junction").alias("kind"), F.struct(at(w, 1).alias("x"), at(w, 2).alias("y")).alias("at")))


def slot_number(token: Column) -> Column:
    """1 to 35 of a token with letters read for digits, else null."""
    fixed = F.replace(F.translate(token, "iIlLoO", "111100"), F.lit("#"), F.lit("")).try_cast("int")
    return F.when(token.rlike("^[0-9iIlLoO#]{1,2}$") & fixed.between(1, 35), fixed)


def slot_letter(token: Column) -> Column:
    return F.when(token.rlike("^[cCdD]$"), F.upper(token))


def census_bucket(ring: Column) -> Column:
    return F.when(ring <= 8, "<=8").otherwise(ring.cast("string"))


def solid_gate(fill: Column, radial: Column, radius: Column, weak: bool = False) -> Column:
    return fill >= 0.5 if weak else (fill >= 0.65) & (radial >= F.when(radius >= 14, 1).otherwise(2))


def circle_gate(centre: Column, radial: Column, rim: Column, weak: bool = False) -> Column:
    return (centre >= 140) & (rim >= 0.35) if weak else (centre >= 160) & (radial >= 2) & (rim >= 0.45)


def polygon_shape(area: Column, perimeter: Column, corners: Column) -> Column:
    """square or triangle, or null where the outline fails the gates."""
    gate = area.between(400, 5000) & (perimeter > 0) & (4 * F.pi() * area / (perimeter * perimeter) < 0.72)
    return F.when(gate, F.when(corners == 4, "square").when(corners == 3, "triangle"))
