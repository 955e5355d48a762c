"""Property graphs made of relational tables.

Each projection is SQL that Spark and DuckDB both read, with tables named in
braces. Numbers come as plain columns; ``graph`` turns them into the metadata
that a loaded code graph would carry.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.plans.model import EDGE_COLUMNS, NODE_COLUMNS, Graph
from weftline.plans.settle import stored

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")

#: Supply: regions contain nations, nations customers and suppliers; customers call
#: suppliers and suppliers call parts as often as line items say; parts cost time.
SUPPLY_NODES = """
SELECT concat('R', r_regionkey) AS id, 'Module' AS kind, r_name AS name, r_name AS file_path, false AS exported,
       CAST(r_regionkey AS BIGINT) AS start_line, CAST(NULL AS DOUBLE) AS self_ms, CAST(NULL AS DOUBLE) AS samples
FROM {region}
UNION ALL
SELECT concat('N', n_nationkey), 'Class', n_name, concat(r_name, '/', n_name), false, CAST(n_nationkey AS BIGINT), NULL, NULL
FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
UNION ALL
SELECT concat('C', c_custkey), 'Function', c_name, concat(r_name, '/', n_name), c_acctbal >= 0, c_custkey, NULL, NULL
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
UNION ALL
SELECT concat('S', s_suppkey), 'Method', s_name, concat(r_name, '/', n_name), s_acctbal >= 0, s_suppkey, NULL, NULL
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
UNION ALL
SELECT concat('P', p_partkey), 'Variable', p_name, p_brand, p_size % 2 = 0, p_partkey, self_ms, samples
FROM {part} LEFT JOIN (
  SELECT l_partkey, round(sum(l_extendedprice), 2) AS self_ms, CAST(count(*) AS DOUBLE) AS samples FROM {lineitem} GROUP BY l_partkey
) used ON p_partkey = l_partkey
"""
SUPPLY_EDGES = """
SELECT concat('R', n_regionkey) AS src, concat('N', n_nationkey) AS dst, 'CONTAINS' AS kind, CAST(1 AS BIGINT) AS calls FROM {nation}
UNION ALL SELECT concat('N', c_nationkey), concat('C', c_custkey), 'CONTAINS', 1 FROM {customer}
UNION ALL SELECT concat('N', s_nationkey), concat('S', s_suppkey), 'CONTAINS', 1 FROM {supplier}
UNION ALL
SELECT concat('C', o_custkey), concat('S', l_suppkey), 'CALLS', count(*)
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey GROUP BY o_custkey, l_suppkey
UNION ALL
SELECT concat('S', l_suppkey), concat('P', l_partkey), 'CALLS', count(*) FROM {lineitem} GROUP BY l_suppkey, l_partkey
"""
#: Handoff: each order is followed, in order of time, by another customer's or one's own;
#: customers call their followers as often as that happens.
HANDOFF_NODES = """
SELECT concat('C', c_custkey) AS id, 'Function' AS kind, c_name AS name, concat('nation/', c_nationkey) AS file_path, true AS exported,
       c_custkey AS start_line, spent AS self_ms, n AS samples
FROM {customer} LEFT JOIN (
  SELECT o_custkey, round(sum(o_totalprice), 2) AS spent, CAST(count(*) AS DOUBLE) AS n FROM {orders} GROUP BY o_custkey
) bought ON c_custkey = o_custkey
"""
HANDOFF_EDGES = """
SELECT concat('C', o_custkey) AS src, concat('C', follower) AS dst, 'CALLS' AS kind, count(*) AS calls FROM (
  SELECT o_custkey, lead(o_custkey) OVER (ORDER BY o_orderdate, o_orderkey) AS follower FROM {orders}
) followed WHERE follower IS NOT NULL GROUP BY o_custkey, follower
"""
#: Likeness: unordered pairs of vectors whose cosine is high, tied by it.
LIKENESS_COSINE = 0.35
_BLOCK = 4096


def likeness_pairs(vectors: DataFrame, least: float = LIKENESS_COSINE) -> DataFrame:
    """(src, dst, weight) of vector pairs whose cosine reaches ``least``, src < dst.

    Vectors lie in blocks of about ``_BLOCK``; a task multiplies two blocks, and only the
    pairs that reach the bound leave it. All pairs are compared, as no cosine can be
    told without: the work is quadratic, the rows that move are the vectors times the
    number of blocks."""
    n = vectors.count()
    blocks = max(1, -(-n // _BLOCK))
    v = vectors.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("g"))
    others = F.sequence(F.lit(0), F.lit(blocks - 1))
    dealt = v.withColumn("h", F.explode(others)).select(F.least("g", "h").alias("i"), F.greatest("g", "h").alias("j"), (F.col("g") == F.least("g", "h")).alias("left"), "vec_id", "e")
    schema = f"src {vectors.schema['vec_id'].dataType.simpleString()}, dst {vectors.schema['vec_id'].dataType.simpleString()}, weight double"

    def compare(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        def side(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
            e = np.stack(rows["e"].to_list()) if len(rows) else np.empty((0, 1))
            return rows["vec_id"].to_numpy(), e / np.sqrt(np.square(e).sum(1, keepdims=True))

        (a, ea), (b, eb) = side(group[group["left"]]), side(group if key[0] == key[1] else group[~group["left"]])
        if not len(a) or not len(b):
            return pd.DataFrame({"src": a[:0], "dst": a[:0], "weight": np.empty(0)})
        cosine = np.round(ea @ eb.T, 4)
        x, y = np.nonzero(cosine >= least)
        keep = a[x] < b[y] if key[0] == key[1] else a[x] != b[y]
        x, y = x[keep], y[keep]
        return pd.DataFrame({"src": np.minimum(a[x], b[y]), "dst": np.maximum(a[x], b[y]), "weight": cosine[x, y]})

    return dealt.groupBy("i", "j").applyInPandas(compare, schema)


def in_sequence(df: DataFrame, group: Column, *order: Column, value: str) -> DataFrame:
    """``df`` with ``before_`` and ``after_``, the ``value`` of the rows before and after
    each in the order, and ``at_``, its place from 0. ``group`` must follow the order,
    as a day follows the time. Rows are ordered within each group; of groups, which
    are few, the ends and sizes are put in a row."""
    keyed = df.withColumn("g_", group)
    own = Window.partitionBy("g_").orderBy(*order)
    keyed = keyed.withColumn("r_", F.row_number().over(own)).withColumn("b_", F.lag(value).over(own)).withColumn("a_", F.lead(value).over(own))
    first = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    ends = df.withColumn("g_", group).groupBy("g_").agg(F.min_by(value, first).alias("first"), F.max_by(value, first).alias("last"), F.count("*").alias("n"))
    row = Window.orderBy("g_")
    ends = ends.select("g_", F.lag("last").over(row).alias("l_"), F.lead("first").over(row).alias("f_"), F.coalesce(F.sum("n").over(row.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("o_"), F.col("n").alias("n_"))
    joined = keyed.join(ends, "g_")
    before = F.when(F.col("r_") == 1, F.col("l_")).otherwise(F.col("b_"))
    after = F.when(F.col("r_") == F.col("n_"), F.col("f_")).otherwise(F.col("a_"))
    return joined.select(*df.columns, before.alias("before_"), after.alias("after_"), (F.col("o_") + F.col("r_") - 1).alias("at_"))


class Tables(dict):
    """The tables of a folder by name, each opened when it is asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self[name]


def frames(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(spark, sf_dir)


def rows(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A projection's text over the tables of ``sf_dir``."""
    known = frames(spark, sf_dir)
    return spark.sql(sql, **{t: known[t] for t in TABLES if "{" + t + "}" in sql})


def text(sql: str) -> str:
    """A projection's text with the tables' own names."""
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql.strip()


def graph(nodes: DataFrame, edges: DataFrame, keep: bool = False) -> Graph:
    """The graph of projected rows. With ``keep`` it is written once, for operators that
    read it several times. Edges aren't put in a folder for each kind: that would sort
    what a task writes, in memory; files mostly hold one kind, and Parquet's statistics
    skip the others."""
    runtime = F.when(F.col("self_ms").isNotNull(), F.to_json(F.struct(F.struct(F.col("samples"), F.col("self_ms").alias("selfMs")).alias("runtime"))))
    nodes = nodes.select(F.lit(0).cast("bigint").alias("seq"), "id", "kind", "name", "file_path", "exported", "start_line", F.col("start_line").alias("end_line"), F.coalesce(runtime, F.lit("{}")).alias("metadata")).select(*NODE_COLUMNS)
    edges = edges.select(F.lit(0).cast("bigint").alias("seq"), "src", "dst", "kind", F.to_json(F.struct(F.col("calls").alias("count"))).alias("metadata")).select(*EDGE_COLUMNS)
    return Graph.of(stored(nodes), stored(edges), settled=True) if keep else Graph.of(nodes, edges)


def supply(spark: SparkSession, sf_dir: str, keep: bool = False) -> Graph:
    return graph(rows(spark, sf_dir, SUPPLY_NODES), rows(spark, sf_dir, SUPPLY_EDGES), keep)


def handoff(spark: SparkSession, sf_dir: str, keep: bool = False) -> Graph:
    """The graph that HANDOFF_NODES and HANDOFF_EDGES describe, days being put in a row
    instead of orders."""
    orders = frames(spark, sf_dir)["orders"].select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    followed = in_sequence(orders, F.col("day"), F.col("day"), F.col("o_orderkey"), value="o_custkey").where("after_ IS NOT NULL")
    name = lambda c: F.concat(F.lit("C"), F.col(c).cast("string"))
    edges = followed.groupBy("o_custkey", "after_").agg(F.count("*").alias("calls")).select(name("o_custkey").alias("src"), name("after_").alias("dst"), F.lit("CALLS").alias("kind"), "calls")
    return graph(rows(spark, sf_dir, HANDOFF_NODES), edges, keep)
