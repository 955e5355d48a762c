"""The property graph: two flat tables and a small key/value table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

NODE_KINDS = ("Module", "Class", "Interface", "TypeAlias", "Enum", "Function", "Method", "Property", "Parameter", "Variable", "ExternalModule", "ConfigFlag", "ExternalAPI", "Endpoint")
EDGE_KINDS = ("CONTAINS", "IMPORTS", "EXPORTS", "EXTENDS", "IMPLEMENTS", "USES_TYPE", "RETURNS", "PARAM_TYPE", "CALLS", "INSTANTIATES", "OVERRIDES", "READS", "WRITES", "READS_CONFIG", "CALLS_EXTERNAL", "HANDLES", "CALLS_RUNTIME")
#: Edge kinds whose target is in use.
USE_KINDS = ("CALLS", "EXTENDS", "IMPLEMENTS", "USES_TYPE", "RETURNS", "PARAM_TYPE", "INSTANTIATES", "READS", "OVERRIDES", "HANDLES")
#: How strongly an edge of each kind ties its ends together in clustering.
TIE_WEIGHTS = {"CALLS": 3.0, "CALLS_RUNTIME": 4.0, "INSTANTIATES": 2.0, "EXTENDS": 2.0, "IMPLEMENTS": 2.0, "OVERRIDES": 1.5, "WRITES": 1.5, "READS": 1.0, "USES_TYPE": 1.0, "RETURNS": 1.0, "PARAM_TYPE": 1.0, "CONTAINS": 0.5}

NODE_SCHEMA = "seq bigint, id string, kind string, name string, file_path string, exported boolean, start_line bigint, end_line bigint, metadata string"
EDGE_SCHEMA = "seq bigint, src string, dst string, kind string, metadata string"
META_SCHEMA = "key string, value string"
NODE_COLUMNS = [c.split()[0] for c in NODE_SCHEMA.split(", ")]
EDGE_COLUMNS = [c.split()[0] for c in EDGE_SCHEMA.split(", ")]
#: What a query returns of a node.
REF = ["id", "kind", "name", "file_path", "start_line"]


@dataclass(frozen=True)
class Graph:
    """``nodes`` (NODE_SCHEMA, id unique), ``edges`` (EDGE_SCHEMA, (src, dst, kind)
    unique) and ``meta`` (META_SCHEMA). ``seq`` is the order of loading, which a few
    rules use to break ties. ``settled``: nodes and edges lie in files, so that reading
    them again costs no more than that."""

    nodes: DataFrame
    edges: DataFrame
    meta: DataFrame
    settled: bool = False

    @classmethod
    def of(cls, nodes: DataFrame, edges: DataFrame, meta: DataFrame | None = None, settled: bool = False) -> Graph:
        return cls(nodes, edges, meta if meta is not None else nodes.sparkSession.createDataFrame([], META_SCHEMA), settled)

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession
