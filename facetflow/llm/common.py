"""Shared plumbing: columns by exact name, Arrow batches of bounded size, written intermediate tables, joins on hot keys."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a worker handles at a time, beyond one row.
BATCH_BYTES = 3 << 20
#: Rows in a batch between the JVM and a Python worker, at most, whatever the session says: texts may be long, and each side holds a batch or two.
BATCH_ROWS = 1000
#: A key is hot if its rows are more than one in a thousand and, in large tables, more than HOT_ROWS; of hot keys there are never more than MOST_HOT_KEYS, which bounds their broadcast.
HOT_ROWS, MOST_HOT_KEYS = 50_000, 200_000
#: Files that a written table has at most, for each core of the session: enough for all cores, few enough for any folder.
FILES_A_CORE = 8
#: Bits of the filter in may_occur().
FILTER_BITS = 22


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame) -> DataFrame:
    """The same columns named c0, c1, ...: names that differ in case only, or hold dots, cannot be told apart otherwise. Every operator begins here, so batches are bounded here."""
    conf, rows = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(rows)) <= BATCH_ROWS:
        conf.set(rows, BATCH_ROWS)
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def picked(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns of exactly these names, whatever the others are called."""
    return numbered(df).select(*[F.col(f"c{df.columns.index(n)}").alias(n) for n in names])


def replaced(df: DataFrame, name: str, value: Callable[[Callable[[str], Column]], Column]) -> DataFrame:
    """df with another value in one column; value gets a function from exact names to columns."""
    names = df.columns
    at = lambda n: F.col(f"c{names.index(n)}")
    return numbered(df).withColumn(f"c{names.index(name)}", value(at)).toDF(*names)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir. Where it is unset, as in tests, one machine alone uses a folder of its own, deleted at the end; a cluster is refused."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        named = tempfile.mkdtemp(prefix="facetflow-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: lineage ends there, so a lost executor costs no recomputation beyond it. Columns may have any names."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    plain = numbered(df)
    plain.coalesce(FILES_A_CORE * df.sparkSession.sparkContext.defaultParallelism).write.parquet(path)
    back = df.sparkSession.read.schema(plain.schema).parquet(path).toDF(*df.columns)
    back._stash_path = path
    return back


def unstash(*tables: DataFrame) -> None:
    """Delete what stash() wrote; only when nothing reads it any more."""
    for df in tables:
        delete(df.sparkSession, df._stash_path)


def hold(df: DataFrame) -> DataFrame:
    """Keep on the executors' disks what is read more than once. Lineage stays, so what a lost executor held is computed again; rows must not depend on the order of a shuffle. Not for what reads several such tables: plans that nest them grow."""
    return df.persist(StorageLevel.DISK_ONLY)


def release(*tables: DataFrame) -> None:
    """Drop what hold() keeps, once all that reads it is written."""
    for df in tables:
        df.unpersist()


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def slices(batches: Iterable[pa.RecordBatch], column: str | int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose named column holds at most BATCH_BYTES, or one row."""
    for batch in batches:
        col = batch.column(column)
        if col.nbytes <= BATCH_BYTES:
            if batch.num_rows:
                yield batch
            continue
        at, held = 0, 0
        sizes = [len(v.as_buffer()) if v.is_valid else 0 for v in col]
        for i, n in enumerate(sizes):
            if i > at and held + n > BATCH_BYTES:
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += n
        if batch.num_rows > at:
            yield batch.slice(at)


def doc_text(docs: DataFrame) -> DataFrame:
    """Only doc_id and text (null: empty), so other columns of any name cannot clash."""
    return picked(docs, "doc_id", "text").select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def hot_limit(total: int) -> int:
    """Rows that one key may have in one task, of so many rows."""
    return max(total // MOST_HOT_KEYS, min(total // 1000, HOT_ROWS), 16)


def salted_join(rows: DataFrame, facts: DataFrame, keys: list[str], total: int) -> DataFrame:
    """rows joined with facts on keys, none of them null. facts has each key once, with the number of its rows, of total, in column c, which goes.

    Hot keys are dealt over salts, enough that none has more than hot_limit()
    rows. Their list is bounded, so it is broadcast; their facts are repeated
    for each salt.
    """
    limit = hot_limit(total)
    parts = F.ceil(F.col("c") / limit).cast("int")
    listed = F.broadcast(facts.where(F.col("c") > limit).select(*keys, parts.alias("_parts")))
    own = [c for c in rows.columns if c not in keys]
    salt = F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*own), F.col("_parts"))).cast("int")
    dealt = rows.join(listed, keys, "left").withColumn("_salt", salt).drop("_parts")
    copied = facts.withColumn("_salt", F.explode(F.when(F.col("c") > limit, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.lit(0))))).drop("c")
    return dealt.join(copied, [*keys, "_salt"]).drop("_salt")


def may_occur(rows: DataFrame, keys: list[str], of: DataFrame) -> DataFrame:
    """rows with a column _may: false only where the keys do not occur in `of`.

    A filter of 2^FILTER_BITS bits, in a broadcast table of at most
    2^(FILTER_BITS - 6) rows whatever the size of `of`. It only saves work: rows
    that pass must still be joined. Keys with a null do not occur.
    """
    bit = F.shiftrightunsigned(F.xxhash64(*keys), 64 - FILTER_BITS)
    held = of.select(bit.alias("_bit")).select(F.shiftright("_bit", 6).alias("_word"), F.expr("shiftleft(1L, cast(_bit & 63 as int)) as _held")).groupBy("_word").agg(F.bit_or("_held").alias("_held"))
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    marked = rows.withColumn("_bit", bit).withColumn("_word", F.shiftright("_bit", 6)).join(F.broadcast(held), "_word", "left")
    return marked.withColumn("_may", known & F.coalesce(F.expr("shiftrightunsigned(_held, cast(_bit & 63 as int)) & 1 = 1"), F.lit(False))).drop("_bit", "_word", "_held")
