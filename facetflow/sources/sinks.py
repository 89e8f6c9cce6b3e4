"""Writers of the record files.

write_rows() and write_canonical() are what a cluster should use: every task
writes its part. write_array() and write_map() make files that hold a single JSON
value; their rows stream through the driver, a partition at a time, into one file.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import records as R
from ..operators import relations


def write_rows(df: DataFrame, path: str, run: str | None = None) -> None:
    """A run as Parquet, in a folder for each run."""
    (df.withColumn("run", F.lit(run)) if run else df).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*(["run"] if run else [])).parquet(path)


def write_canonical(df: DataFrame, path: str) -> None:
    """One JSON document an id, in the file <id>.json; files of other ids stay, one of the same id is replaced. Of rows with one id the greatest text is taken.

    Tasks write in a folder of their own; then the driver renames each file, so
    a reader sees whole files only.
    """
    fields = ["id", "vertices", "edges", "ring_size", "reducibility", "provenance"]
    body = F.to_json(F.struct(*fields, F.lit(R.SCHEMA_VERSION).alias("schema_version")), {"pretty": "true", "ignoreNullFields": "false"})
    spark, aside = df.sparkSession, f"{path}/_writing-{uuid.uuid4().hex}"
    df.where("id is not null").select("id", body.alias("value")).groupBy("id").agg(F.max("value").alias("value")).write.partitionBy("id").text(aside)
    place, to = spark._jvm.org.apache.hadoop.fs.Path(aside), spark._jvm.org.apache.hadoop.fs.Path
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.listFiles(place, True)
    while found.hasNext():
        one = found.next().getPath()
        if one.getName().startswith("part-"):
            target = to(path, f"{unquote(one.getParent().getName().removeprefix('id='))}.json")
            files.delete(target, False)
            files.rename(one, target)
    files.delete(place, True)


def write_files(df: DataFrame, path: str) -> None:
    """(crop, content): a file a row, named by crop. Rows stream through the driver, a partition at a time, since Spark's writers choose the names of files."""
    for row in df.select("crop", "content").toLocalIterator():
        _write_bytes(df.sparkSession, f"{path}/{row.crop}", [bytes(row.content)])


def gated(df: DataFrame, ok: Column) -> tuple[DataFrame, DataFrame]:
    """Rows to save and rows to reject; a null verdict rejects."""
    good = F.coalesce(ok, F.lit(False))
    return df.where(good), df.where(~good)


def _write_bytes(spark: SparkSession, path: str, parts: Iterable[bytes]) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
    try:
        for part in parts:
            out.write(bytearray(part))
    finally:
        out.close()


def _write_text(df: DataFrame, path: str, parts: Iterable[str]) -> None:
    _write_bytes(df.sparkSession, path, (part.encode() for part in parts))


def write_array(df: DataFrame, path: str, *order: str) -> None:
    """One JSON array, two spaces a level, in the order of the named columns."""
    rows = df.orderBy(*order).select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("j"))

    def parts():
        first = True
        for row in rows.toLocalIterator():
            body = json.dumps(json.loads(row.j), indent=2, ensure_ascii=False).replace("\n", "\n  ")
            yield ("[\n  " if first else ",\n  ") + body
            first = False
        yield "[]" if first else "\n]"

    _write_text(df, path, parts())


def write_map(df: DataFrame, path: str) -> None:
    """(crop, ring) as one JSON object, by key; rows of null keys or rings are left out, and of equal keys the largest ring stays."""
    rows = df.where("crop is not null and ring is not null").groupBy("crop").agg(F.max("ring").alias("ring")).orderBy("crop")

    def parts():
        first = True
        for row in rows.toLocalIterator():
            yield ("{\n  " if first else ",\n  ") + f"{json.dumps(row.crop, ensure_ascii=False)}: {row.ring}"
            first = False
        yield "{}" if first else "\n}"

    _write_text(df, path, parts())


def upsert(old: DataFrame, new: DataFrame, force: bool = False) -> DataFrame:
    """Label maps (crop, ring): an old label stays, unless forced."""
    return relations.merge_labels(old, new, force).select("crop", "ring")
