"""Lookups that touch a node's own edges only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import metadata as M
from weftline.plans.model import REF, USE_KINDS, Graph

FIND_LIMIT = 50


def _ends(graph: Graph, edges: DataFrame, end: str) -> DataFrame:
    """Edges with the node at their ``end`` (src or dst)."""
    return edges.join(graph.nodes, edges[end] == graph.nodes["id"]).select(*[graph.nodes[c] for c in REF], edges["kind"].alias("edge_kind"), edges["metadata"].alias("edge_metadata"))


def who_calls(graph: Graph, node_id: str) -> DataFrame:
    """Nodes that call ``node_id``, by file and line."""
    inbound = graph.edges.where((F.col("kind") == "CALLS") & (F.col("dst") == node_id))
    return _ends(graph, inbound, "src").select(*REF).orderBy("file_path", "start_line", "id")


def calls(graph: Graph, node_id: str) -> DataFrame:
    """Nodes that ``node_id`` calls, by file and line."""
    outbound = graph.edges.where((F.col("kind") == "CALLS") & (F.col("src") == node_id))
    return _ends(graph, outbound, "dst").select(*REF).orderBy("file_path", "start_line", "id")


def references(graph: Graph, node_id: str) -> DataFrame:
    """One row per edge that uses ``node_id``, by edge kind, file and line."""
    inbound = graph.edges.where(F.col("kind").isin(*USE_KINDS) & (F.col("dst") == node_id))
    return _ends(graph, inbound, "src").orderBy("edge_kind", "file_path", "start_line", "id")


def neighborhood(graph: Graph, node_id: str) -> DataFrame:
    """All edges out of and into ``node_id``; a self-loop counts in both directions."""
    out = _ends(graph, graph.edges.where(F.col("src") == node_id), "dst").withColumn("direction", F.lit("out"))
    return out.unionByName(_ends(graph, graph.edges.where(F.col("dst") == node_id), "src").withColumn("direction", F.lit("in")))


def detail(graph: Graph, node_id: str) -> DataFrame:
    """``neighborhood`` with ``count``, how often an edge occurs: the viewer's panel."""
    around = neighborhood(graph, node_id)
    return around.withColumn("count", M.call_count("edge_metadata")).orderBy(F.desc("count"), "direction", "edge_kind", "file_path", "start_line", "id")


def find(graph: Graph, pattern: str, limit: int = FIND_LIMIT) -> DataFrame:
    """Nodes other than modules whose name contains ``pattern``, or whose kind is it,
    in any case; by file and line, the first 50. The pattern is literal text; an
    empty one matches all."""
    wanted = F.lower(F.lit(pattern))
    hit = F.contains(F.lower("name"), wanted) | (F.lower("kind") == wanted)
    return graph.nodes.where((F.col("kind") != "Module") & hit).select(*REF).orderBy("file_path", "start_line", "id").limit(limit)


def resolve(graph: Graph, target: str) -> str:
    """Id of the one symbol that ``target`` names: the only exact match, else the only
    match. LookupError lists up to eight candidates otherwise."""
    found = find(graph, target).collect()
    exact = [r for r in found if r["name"] == target]
    for rows in (exact, found):
        if len(rows) == 1:
            return rows[0]["id"]
    raise LookupError(f"{target!r} names {len(found)} symbols: " + ", ".join(r["id"] for r in (exact or found)[:8]))


def search(graph: Graph, text: str, limit: int = 15) -> DataFrame:
    """The viewer's search: two characters or more, in names or paths, in load order."""
    wanted = F.lower(F.lit(text.strip()))
    hit = F.contains(F.lower("name"), wanted) | F.contains(F.lower("file_path"), wanted)
    return graph.nodes.where(hit & F.lit(len(text.strip()) >= 2)).orderBy("seq", "id").select(*REF).limit(limit)


def visible(graph: Graph, hide_nodes: tuple[str, ...] = (), hide_edges: tuple[str, ...] = (), keep: Column | None = None, hide_isolated: bool = False, hide_communities: tuple[int, ...] = (), measured_only: bool = False) -> Graph:
    """The graph without nodes and edges of hidden kinds, without nodes of hidden
    communities or, on request, without runtime figures, without nodes that ``keep``
    rejects, and, on request, without nodes that no visible edge ties to another
    visible node."""
    nodes = graph.nodes.where(~F.col("kind").isin(*hide_nodes)) if hide_nodes else graph.nodes
    if hide_communities:
        nodes = nodes.where(~F.coalesce(M.number("metadata", "$.community").cast("bigint").isin(*hide_communities), F.lit(False)))
    if measured_only:
        nodes = nodes.where(M.has_runtime())
    nodes = nodes.where(keep) if keep is not None else nodes
    edges = graph.edges.where(~F.col("kind").isin(*hide_edges)) if hide_edges else graph.edges
    ids = nodes.select("id")
    edges = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*graph.edges.columns)
    if hide_isolated:
        tied = edges.where("src <> dst").select(F.explode(F.array("src", "dst")).alias("id"))
        nodes = nodes.join(tied, "id", "left_semi").select(*graph.nodes.columns)
    return Graph(nodes, edges, graph.meta)


def degree(graph: Graph) -> DataFrame:
    """(id, degree): edges in and out, also of ids that no node has."""
    ends = graph.edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))
