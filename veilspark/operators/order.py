"""Positions of rows in a global order, without a window over all rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: monotonically_increasing_id() has the partition above bit 33 and the row below.
_BITS = 33


def numbered(df: DataFrame, order: list[Column], name: str = "position", keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``df`` with ``name``, the row's place (1, 2, 3...) in ``order``: a sort by ranges, each range's number of rows, and their running sum.

    Two passes over the sorted rows and one row per partition in the sum; rows that ``order`` doesn't tell apart get consecutive
    places in any order. Without ``order`` rows are numbered as they come, partition after partition. ``keep`` writes the sorted rows
    once, so that both passes see the same; without it they go to the shared folder."""
    ordered = df
    if order:
        ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ids = f"_{name}_id"
    marked = (keep or written)(ordered.withColumn(ids, F.monotonically_increasing_id()))
    per = marked.groupBy(F.shiftright(ids, _BITS).alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = per.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    joined = marked.withColumn("_part", F.shiftright(ids, _BITS)).join(F.broadcast(before), "_part")
    place = (F.col("_before") + F.col(ids).bitwiseAND((1 << _BITS) - 1) + 1).cast("long")
    return joined.withColumn(name, place).select(*[F.col(f"`{c}`") for c in df.columns], name)


def positional_zip(left: DataFrame, right: DataFrame, left_order: list[Column], right_order: list[Column], name: str = "position", keep=None) -> DataFrame:
    """Row k of ``left`` beside row k of ``right``, as many as the shorter has: (position, columns of left, columns of right) for tables without a
    key in common. A column of right that left has, too, gets the prefix right_. Each side is sorted by ranges and counted per range, so
    that neither passes through one task; the join is by position."""
    taken = {c.lower() for c in (name, *left.columns)}
    names = []
    for c in right.columns:
        while c.lower() in taken:
            c = f"right_{c}"
        taken.add(c.lower())
        names.append(c)
    a, b = numbered(left, left_order, name, keep), numbered(right, right_order, "_place", keep).toDF(*names, name)
    return a.join(b, name).select(name, *[F.col(f"`{c}`") for c in (*left.columns, *names)])


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share. Where it is unset a local master (tests) gets a temporary folder, and a cluster an
    error: its executors don't see the driver's folders."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("veilspark.work.dir", None)
    if folder is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='veilspark-')}"
        spark.conf.set("veilspark.work.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, read back: it is computed once, and what follows survives lost executors. The driver's JVM deletes
    the table when it ends. Places and offsets rise from row to row, so whole numbers are written as differences and not by a dictionary."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/work-{uuid.uuid4().hex}"
    plain = {f"parquet.enable.dictionary#{c}": "false" for c, kind in df.dtypes if kind in ("int", "bigint")}
    df.write.options(compression="zstd", **{"parquet.writer.version": "v2"}, **plain).parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)
