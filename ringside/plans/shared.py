"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local one only where it's unset and everything runs in one process, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="ringside-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def shelve(df: DataFrame, *by: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives the loss of any executor; `by`: in folders by these columns."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete what shelve() wrote, once nothing reads it any more."""
    for df in frames:
        jvm = df.sparkSession.sparkContext._jvm
        conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        folder = f"/{shared_folder(df.sparkSession).rstrip('/').rpartition('/')[2]}/"
        for above, _, below in {f.rpartition(folder) for f in df.inputFiles()}:
            if above:
                path = jvm.org.apache.hadoop.fs.Path(f"{above}{folder}{below.partition('/')[0]}")
                path.getFileSystem(conf).delete(path, True)


def numbered(df: DataFrame, order: list[Column], name: str = "number") -> DataFrame:
    """df with each row's place in a total order, from 0 on, as `name`.

    Rows are sorted by ranges and written; a row's number is its place in its range plus the sizes of the ranges before,
    of which there is one row each. No task holds more than a range.
    """
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    placed = shelve(spread.withColumn("_at", at).withColumns({"_range": F.shiftright("_at", 33), "_place": F.col("_at").bitwiseAND((1 << 33) - 1)}))
    before, offsets = 0, []
    for r in placed.groupBy("_range").count().orderBy("_range").collect():
        offsets.append((r["_range"], before))
        before += r["count"]
    first = df.sparkSession.createDataFrame(offsets, "_range long, _before long")
    return placed.join(F.broadcast(first), "_range").withColumn(name, F.col("_place") + F.col("_before")).drop("_at", "_range", "_place", "_before")
