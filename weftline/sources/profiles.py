"""CPU profiles in the public ``.cpuprofile`` format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FRAME = "struct<functionName:string,scriptId:string,url:string,lineNumber:bigint,columnNumber:bigint>"
SCHEMA = f"nodes array<struct<id:bigint,callFrame:{_FRAME},hitCount:bigint,children:array<bigint>>>, startTime double, endTime double, samples array<bigint>, timeDeltas array<bigint>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per profile; ValueError for a file that is none."""
    profile = spark.read.schema(SCHEMA + ", _bad string").option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(path)
    if profile.where("_bad IS NOT NULL OR nodes IS NULL OR exists(nodes, n -> n.id IS NULL OR n.callFrame.functionName IS NULL)").first() is not None or profile.isEmpty():
        raise ValueError(f"{path} is no CPU profile")
    return profile.drop("_bad")


def parts(profile: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, samples, tree): (node, function_name, url, line, column_number,
    hit_count); (at, node, delta); (parent, child)."""
    n = profile.select(F.explode("nodes").alias("n"))
    nodes = n.select(F.col("n.id").alias("node"), F.col("n.callFrame.functionName").alias("function_name"), F.coalesce("n.callFrame.url", F.lit("")).alias("url"), F.col("n.callFrame.lineNumber").alias("line"), F.col("n.callFrame.columnNumber").alias("column_number"), F.coalesce("n.hitCount", F.lit(0)).alias("hit_count"))
    samples = profile.select(F.posexplode("samples").alias("at", "node"), "timeDeltas").select("at", "node", F.get("timeDeltas", F.col("at")).alias("delta"))
    tree = n.select(F.col("n.id").alias("parent"), F.explode("n.children").alias("child"))
    return nodes, samples, tree
