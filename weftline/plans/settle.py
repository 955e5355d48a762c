"""Cutting lineage between the rounds of an iterative plan."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``. A session that names
    none gets one of our own if it runs in one process (in tests); on a cluster, where
    a folder of one machine would be lost with it, that is a RuntimeError."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    set_already = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_already.isDefined():
        return set_already.get()
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="weftline-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and return it without its
    lineage. The files survive the loss of any executor."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, *by: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder, in a folder for each value
    of ``by``, and read it again. Later steps read the columns and folders that they
    need, and joins know the table's size. The files go when the driver ends."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/stored-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*by) if by else df.write
    writer.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *order: Column, name: str) -> DataFrame:
    """``df`` with ``name`` bigint, the place of each row in the order, from 0. Rows are
    sorted by ranges; only the number of rows of each range goes to the driver, so no
    task has more than a range. Ties are in any order: let ``order`` be total."""
    ranged = settle(df.orderBy(*order).withColumn("range_", F.spark_partition_id()).withColumn("at_", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    before, offsets = 0, []
    for row in ranged.groupBy("range_").count().orderBy("range_").collect():
        offsets.append((row["range_"], before))
        before += row["count"]
    places = F.broadcast(df.sparkSession.createDataFrame(offsets, "range_ int, before_ bigint"))
    return ranged.join(places, "range_").withColumn(name, F.col("before_") + F.col("at_")).drop("range_", "at_", "before_")


#: Bytes that a side may have to be broadcast, as its values take them.
BROADCAST_BYTES = 8_000_000


def measured_bytes(df: DataFrame) -> int:
    """Bytes of the values of ``df`` with some for each row: text by its length, arrays by
    their elements at eight bytes."""
    size = F.lit(24)
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        own = F.octet_length(c) if kind in ("string", "binary") else F.size(c) * 8 if kind.startswith("array") else F.lit(8)
        size = size + F.coalesce(own, F.lit(0))
    return int(df.agg(F.sum(size)).first()[0] or 0)


def hinted(df: DataFrame) -> DataFrame:
    """A settled ``df``, to be broadcast where its measured bytes allow it. Settled rows
    have no statistics that a join could go by."""
    return F.broadcast(df) if measured_bytes(df) <= BROADCAST_BYTES else df
