"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of an Arrow batch of texts.
BATCH_ROWS = 1000
#: Rows up to which a lookup table is broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or veilspark.shared.dir. Where both are unset a local
    master (tests) gets a temporary folder, and a cluster an error: its executors don't see the driver's folders."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir", None) or spark.conf.get("veilspark.shared.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='veilspark-')}"
        spark.conf.set("veilspark.shared.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/veilspark/{label}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """Arrow batches of at most BATCH_ROWS rows while a table is written: both sides of a Python worker hold whole batches, and texts are long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at files that survive a lost executor."""
    path = new_path(df.sparkSession, label)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    delete_at_exit(df.sparkSession, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._veil_path = path
    return out


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Have the driver's JVM delete a work table when it ends; until then results may still read it."""
    with contextlib.suppress(Exception):
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a work table now. A store that refuses leaves it to delete_at_exit()."""
    with contextlib.suppress(Exception):
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """Work within deletes its shuffle files when its job has ended, not when the driver happens to collect its garbage: for a table that is
    written once, and whose exchange is as large as what follows. A stage that is lost while the job runs is made again as ever."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drop_table(df: DataFrame) -> None:
    """Delete a table of materialize() that nothing reads any more."""
    path = getattr(df, "_veil_path", None)
    if path:
        delete(df.sparkSession, path)


def quoted(name: str) -> str:
    """A column's name as one part of an expression, whatever is in it."""
    return "`" + name.replace("`", "``") + "`"


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """128 bits that tell rows of different doc_id or text apart, null from empty included."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in (doc_id, text)]
    return F.unhex(F.md5(F.concat(parts[0], F.lit(" "), parts[1]).cast("binary")))


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string or binary Arrow column, null as empty."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return [x or b"" for x in column.to_pylist()]
