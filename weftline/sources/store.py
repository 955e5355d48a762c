"""Keeping a graph as Parquet: merges, deletes and graph-level values.

Parquet has no merge: a table is rebuilt from old and new rows, the last of a key
winning, written beside the old one and swapped in. Edges are partitioned by kind,
so that a query for one kind reads it alone, and sorted by their target within it;
lookups by source read the kind.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.plans.model import EDGE_COLUMNS, EDGE_SCHEMA, META_SCHEMA, NODE_COLUMNS, NODE_SCHEMA, Graph
from weftline.plans.settle import BROADCAST_BYTES, measured_bytes, stored


def _latest(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    both = old.withColumn("load", F.lit(0)).unionByName(new.withColumn("load", F.lit(1)))
    order = Window.partitionBy(*key).orderBy(F.desc("load"), F.desc("seq"))
    return both.withColumn("r", F.row_number().over(order)).where("r = 1").drop("load", "r")


def upsert_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """By id; the last record wins with all its columns."""
    return _latest(old, new, ["id"])


def anchored(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges whose both ends are among ``ids`` (id)."""
    ids = ids.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def unknown_ends(edges: DataFrame, ids: DataFrame, *ends: str, among: DataFrame | None = None) -> tuple[DataFrame, int]:
    """(id) of the ``ends`` (src, dst or both) of ``edges``, which must be settled, that
    aren't among ``ids`` (id), and their bytes. ``among``: (id) of all ends, where known."""
    if among is None:
        each = F.col(ends[0]) if len(ends) == 1 else F.explode(F.array(*ends))
        among = edges.select(each.alias("id")).distinct()
    unknown = stored(among.join(ids.select("id"), "id", "left_anti"))
    return unknown, measured_bytes(unknown)


def known_ends(edges: DataFrame, ids: DataFrame, *ends: str, unknown: tuple[DataFrame, int] | None = None) -> DataFrame:
    """Rows of ``edges``, which must be settled, whose ``ends`` (src, dst or both) are
    among ``ids`` (id); ``edges`` itself where all are. Only distinct ends are shuffled:
    few or none of them are unknown as a rule, and those are broadcast. Where they are
    many, the edges are joined."""
    strangers, size = unknown or unknown_ends(edges, ids, *ends)
    for end in ends if size else ():
        other = ids.select(F.col("id").alias(end)) if size > BROADCAST_BYTES else F.broadcast(strangers.withColumnRenamed("id", end))
        edges = edges.where(F.col(end).isNotNull()).join(other, end, "left_semi" if size > BROADCAST_BYTES else "left_anti").select(*edges.columns)
    return edges


def edges_of(graph: Graph, *kinds: str) -> DataFrame:
    """(src, dst) of the graph's edges of ``kinds``, in files."""
    pairs = graph.edges.where(F.col("kind").isin(*kinds)).select("src", "dst")
    return pairs if graph.settled else stored(pairs)


def upsert_edges(old: DataFrame, new: DataFrame, ids: DataFrame) -> DataFrame:
    """By (src, dst, kind); the last metadata win; dangling new edges are dropped."""
    return _latest(old, anchored(new, ids), ["src", "dst", "kind"])


def load_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(nodes, edges): distinct ids; rows of edges that don't dangle, repeats counted."""
    n = nodes.agg(F.count_distinct("id").alias("nodes"))
    return n.crossJoin(anchored(edges, nodes).agg(F.count("*").alias("edges")))


def count_edges(raw: DataFrame) -> DataFrame:
    """(src, dst, kind, metadata, count) of raw edges: the first record's metadata and
    the number of records."""
    return raw.groupBy("src", "dst", "kind").agg(F.min_by("metadata", "seq").alias("metadata"), F.count("*").alias("count"), F.min("seq").alias("seq"))


def dedupe_nodes(raw: DataFrame) -> DataFrame:
    """The last record of each id."""
    return raw.groupBy("id").agg(F.max_by(F.struct(*[c for c in raw.columns if c != "id"]), "seq").alias("s")).select("id", "s.*").select(*raw.columns)


def delete_edges(edges: DataFrame, kind: str) -> DataFrame:
    return edges.where(F.col("kind") != kind)


def set_metadata(nodes: DataFrame, updates: DataFrame) -> DataFrame:
    """Metadata replaced for the ids in ``updates`` (id, metadata)."""
    new = updates.select("id", F.col("metadata").alias("new_metadata"))
    return nodes.join(new, "id", "left").withColumn("metadata", F.coalesce("new_metadata", "metadata")).select(*nodes.columns)


def put_meta(meta: DataFrame, key: str, value: object) -> DataFrame:
    row = meta.sparkSession.createDataFrame([(key, json.dumps(value, ensure_ascii=False))], META_SCHEMA)
    return meta.where(F.col("key") != key).unionByName(row)


def get_meta(meta: DataFrame, key: str) -> dict | None:
    row = meta.where(F.col("key") == key).first()
    try:
        value = json.loads(row["value"]) if row else None
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def delete_meta(meta: DataFrame, key: str) -> DataFrame:
    return meta.where(F.col("key") != key)


@dataclass(frozen=True)
class GraphStore:
    """A graph in a folder that all executors share. Each write makes a new version;
    a pointer file names the current one."""

    spark: SparkSession
    folder: str

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))

    def _current(self) -> str | None:
        if not self._fs().exists(self._path("CURRENT")):
            return None
        return self.spark.read.text(f"{self.folder}/CURRENT").first()["value"]

    def read(self) -> Graph:
        """The stored graph; an empty one where nothing is stored."""
        version = self._current()
        if version is None:
            return Graph.of(self.spark.createDataFrame([], NODE_SCHEMA), self.spark.createDataFrame([], EDGE_SCHEMA))
        read = lambda name, schema: self.spark.read.schema(schema).parquet(f"{self.folder}/{version}/{name}")
        return Graph(read("nodes", NODE_SCHEMA).select(*NODE_COLUMNS), read("edges", EDGE_SCHEMA).select(*EDGE_COLUMNS), read("meta", META_SCHEMA), settled=True)

    def init(self) -> Graph:
        """Make an empty store where there is none; what is stored stays."""
        return self.read() if self._current() is not None else self.write(self.read())

    def write(self, graph: Graph) -> Graph:
        old, version = self._current(), f"v-{uuid.uuid4().hex}"
        # rows near in key lie in the same files, so that a lookup reads few of them
        graph.nodes.repartitionByRange("id").sortWithinPartitions("id").write.parquet(f"{self.folder}/{version}/nodes")
        graph.edges.repartitionByRange("kind", "dst").sortWithinPartitions("kind", "dst").write.partitionBy("kind").parquet(f"{self.folder}/{version}/edges")
        graph.meta.coalesce(1).write.parquet(f"{self.folder}/{version}/meta")
        out = self._fs().create(self._path("CURRENT"), True)
        out.write(bytearray(version.encode()))
        out.close()
        if old:
            self._fs().delete(self._path(old), True)
        return self.read()

    def load(self, nodes: DataFrame, edges: DataFrame, source: dict | None = None) -> dict[str, int]:
        """Merge a batch: nothing stale goes, but the ``runtime`` manifest does, and
        ``source`` is set or cleared. Returns the counts of the batch."""
        now = self.read()
        meta = delete_meta(delete_meta(now.meta, "runtime"), "source")
        if source is not None:
            meta = put_meta(meta, "source", source)
        counts = load_counts(nodes, edges).first()
        self.write(Graph(upsert_nodes(now.nodes, nodes), upsert_edges(now.edges, edges, nodes), meta))
        return counts.asDict()

    def append_edges(self, edges: DataFrame) -> Graph:
        now = self.read()
        return self.write(Graph(now.nodes, upsert_edges(now.edges, edges, now.nodes), now.meta))

    def query(self, sql: str, **args: object) -> DataFrame:
        """SQL with named parameters over ``{nodes}``, ``{edges}`` and ``{meta}``."""
        now = self.read()
        frames = {n: d for n, d in (("nodes", now.nodes), ("edges", now.edges), ("meta", now.meta)) if "{" + n + "}" in sql}
        return self.spark.sql(sql, args=args or None, **frames)
