"""Readers of the record files. Schemas are given, never inferred, so a scan is lazy and reads only the columns asked for.

A JSON file that holds one array is one value that one task parses; many such
files are read side by side. Where a file may be missing the result is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import records as R


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _arrays(spark: SparkSession, path: str, schema: str, optional: bool = False) -> DataFrame:
    if optional and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_run(spark: SparkSession, path: str) -> DataFrame:
    return _arrays(spark, path, R.DETECTION)


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    return _arrays(spark, path, R.GOLDEN, optional=True)


def read_canonical(spark: SparkSession, folder: str) -> DataFrame:
    """One record a file, with file_name to sort by; a missing provenance is one of nulls and not corrected."""
    rows = spark.read.schema(R.CANONICAL).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder).withColumn("file_name", F.col("_metadata.file_name"))
    nothing = F.expr(f"cast(named_struct('source_document', null, 'crop', null, 'figure_ref', null, 'extraction', 'manual', 'human_corrected', false, 'notes', null) as {R.PROVENANCE})")
    return rows.withColumn("provenance", F.coalesce("provenance", nothing)).drop("schema_version")


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of numbers -> (crop, ring); a repeated key has its last value."""
    if not exists(spark, path):
        return spark.createDataFrame([], "crop string, ring int")
    text = spark.read.text(path, wholetext=True)
    pairs = text.select(F.posexplode(F.map_entries(F.from_json("value", "map<string,int>")))).select("pos", "col.key", "col.value")
    return pairs.groupBy(F.col("key").alias("crop")).agg(F.max_by("value", "pos").alias("ring"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Slots with a crop; of several with the same crop the last in the order of the file stays."""
    rows = _arrays(spark, path, R.INDEX, optional=True).withColumn("_at", F.monotonically_increasing_id()).where("crop is not null")
    names = [c for c in rows.columns if c not in ("crop", "_at")]
    last = rows.groupBy("crop").agg(F.max_by(F.struct(*names), "_at").alias("r")).select("crop", "r.*")
    return last.select(*[c for c in rows.columns if c != "_at"])


def _crop_files(spark: SparkSession, folder: str, start_page: int) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "page*.png").load(folder).withColumn("crop", F.element_at(F.split("path", "/"), -1))
    return files.withColumn("page", R.page_number(F.col("crop"))).where((F.col("page") >= start_page) & ~F.col("crop").rlike("_(debug|nodes|edges)"))


def list_crops(spark: SparkSession, folder: str, start_page: int = 0) -> DataFrame:
    """Names, pages and paths of crops; contents are not read. Renderings for debugging are left out."""
    return _crop_files(spark, folder, start_page).select("path", "crop", "page")


def read_crops(spark: SparkSession, folder: str, start_page: int = 0) -> DataFrame:
    """Names and bytes of crops, in one scan."""
    return _crop_files(spark, folder, start_page).select("crop", "content")


def constants(spark: SparkSession) -> dict[str, DataFrame]:
    """Fixed values as small tables: degrees of shapes, the census, ring labels by hand, slots known to be references."""
    shapes = [("solid_dot", 5), ("open_circle", 6), ("square", 7), ("triangle", 8)]
    rings = [("page014_cell000.png", 6), ("page014_cell003.png", 5)]
    census = [("<=8", 7), ("9", 8), ("10", 35), ("11", 89), ("12", 334), ("13", 701), ("14", 660)]
    return {
        "shapes": spark.createDataFrame(shapes, "shape string, degree int"),
        "census": spark.createDataFrame(census, "bucket string, expected int"),
        "ring_labels": spark.createDataFrame(rings, "crop string, ring int"),
        "xref_slots": spark.createDataFrame([(45, 3)], "figure int, position int"),
    }


def words(words: DataFrame, scale: float, affine: tuple[float, ...] | None = None) -> DataFrame:
    """words(page, token, x0, y0, x1, y1) in points -> token centres in pixels, turned by a 2 x 3 matrix if there is one."""
    x, y = (F.col("x0") + F.col("x1")) / 2 * scale, (F.col("y0") + F.col("y1")) / 2 * scale
    if affine:
        a, b, c, d, e, f = affine
        x, y = a * x + b * y + c, d * x + e * y + f
    return words.select("page", "token", x.alias("cx"), y.alias("cy"))
