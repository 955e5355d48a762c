"""Reading the tables and small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.plans.settle import hinted

#: How many rows one task of a Python stage should hold at once.
ROWS_PER_TASK = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unit_interval(seed: int, *cols: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the columns' values only:
    the first 52 bits of an MD5 digest. A null counts as an empty string."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def whole_partitions(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """All batches of a partition as one table; None where there is none."""
    kept = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(kept) if kept else None


def spread(df: DataFrame, rows: int, *keys: Column | str, per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Hash-partition ``df`` by ``keys`` into as many partitions as its ``rows`` need."""
    width = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))
    return df.repartition(width, *keys)


def join_measured(large: DataFrame, small: DataFrame, on: Column, how: str) -> DataFrame:
    """``large`` joined with ``small``, which is measured first (pass it settled) and
    broadcast where it has few bytes, so that ``large`` isn't shuffled; beyond that both
    sides are shuffled by the key."""
    return large.join(hinted(small), on, how)
