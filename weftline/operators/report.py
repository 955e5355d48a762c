"""What the brief is made of: composition, totals, findings."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators import cluster
from weftline.operators.connectivity import call_cycles
from weftline.operators.cost import cost_ranking, coverage, measured_nodes
from weftline.operators.hotspots import dead_exports, hotspots
from weftline.plans.model import REF, Graph
from weftline.plans.settle import stored
from weftline.sources import store

BOUNDARY_KINDS = {"endpoints": "Endpoint", "configFlags": "ConfigFlag", "externalApis": "ExternalAPI"}
HIDDEN_CALLERS, CONCENTRATED, EXAMPLES = 1, 0.5, 3
_ALL = 100_000


def kind_counts(df: DataFrame) -> DataFrame:
    """(kind, count), most frequent first."""
    return df.groupBy("kind").agg(F.count("*").alias("count")).orderBy(F.desc("count"), F.collate("kind", "UNICODE"))


def totals(graph: Graph) -> DataFrame:
    """One row: symbols, files (distinct paths of all nodes), relationships,
    communities, dead_exports, cycles."""
    nodes = graph.nodes.agg(F.count("*").alias("symbols"), F.count_distinct("file_path").alias("files"))
    links = graph.edges if graph.settled else stored(graph.edges)
    settled = Graph(graph.nodes, links, graph.meta, settled=True)
    # ends are looked up once for all
    unknown = store.unknown_ends(links, graph.nodes, "src", "dst")
    anchored = store.known_ends(links, graph.nodes, "src", "dst", unknown=unknown)
    edges = anchored.agg(F.count("*").alias("relationships"))
    communities = cluster.assigned(graph).agg(F.count_distinct("community").alias("communities"))
    dead = dead_exports(settled, unknown).agg(F.count("*").alias("dead_exports"))
    cycles = call_cycles(settled, anchored.where("kind = 'CALLS'").select("src", "dst")).agg(F.count("*").alias("cycles"))
    return nodes.crossJoin(edges).crossJoin(communities).crossJoin(dead).crossJoin(cycles)


def communities(graph: Graph) -> DataFrame:
    """(label, size) of the communities that metadata name, largest first."""
    return cluster.dump(cluster.assigned(graph)).select("label", "size").orderBy(F.desc("size"), F.collate("label", "UNICODE"))


def boundary(graph: Graph) -> DataFrame:
    """Endpoints, configuration flags and external APIs."""
    return graph.nodes.where(F.col("kind").isin(*BOUNDARY_KINDS.values())).select(*REF)


def structure_vs_runtime(graph: Graph, top: int = 5) -> DataFrame:
    """(role, rank, REF): orchestrators cost only through what they call; hidden hotspots
    are hot with one caller at most; the aligned core is hot and called by more. The
    rankings compared hold 1000 nodes at most, and callers beyond that rank count as
    none."""
    cost = cost_ranking(graph, limit=_ALL).where("self_cost = 0")
    hot = hotspots(graph, "self-time", _ALL)
    fan = hotspots(graph, "callers", _ALL).df.select("id", F.col("score").alias("fan"))
    path = F.collate("file_path", "UNICODE")
    rank = lambda *order: F.row_number().over(Window.partitionBy("role").orderBy(*order))
    flows = cost.withColumn("role", F.lit("orchestrator")).withColumn("rank", rank(F.desc("inclusive_cost"), path, "start_line", "id"))
    if hot.fell_back:
        return flows.where(F.col("rank") <= top).select("role", "rank", *REF)
    hottest = hot.df.join(fan, "id", "left").withColumn("role", F.when(F.coalesce("fan", F.lit(0.0)) <= HIDDEN_CALLERS, "hidden hotspot").otherwise("aligned core"))
    hottest = hottest.withColumn("rank", rank(F.desc("score"), path, "start_line", "id"))
    both = flows.select("role", "rank", *REF).unionByName(hottest.select("role", "rank", *REF))
    return both.where(F.col("rank") <= top)


def concentration(graph: Graph, limit: int = 10, share: float = CONCENTRATED) -> DataFrame:
    """(count, share): the shortest prefix of the hottest ``limit`` nodes that has
    ``share`` of all self time; no row where they don't reach it."""
    total = measured_nodes(graph).agg(F.sum("self_ms").alias("total"))
    top = hotspots(graph, "self-time", limit).df
    order = Window.orderBy(F.desc("score"), F.collate("file_path", "UNICODE"), "start_line", "id")
    run = top.withColumn("count", F.row_number().over(order)).withColumn("sum", F.sum("score").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    found = run.join(F.broadcast(total)).where((F.col("total") > 0) & (F.col("sum") / F.col("total") >= share))
    return found.select("count", (F.col("sum") / F.col("total")).alias("share")).orderBy("count").limit(1)


@dataclass(frozen=True)
class Report:
    """Everything the brief shows, as plain values."""

    generated_at: str
    project: str
    limit: int
    totals: dict
    verdict: str
    provenance: dict | None
    coverage: float | None
    enriched: bool
    semantic: bool
    quality: float | None
    total_self: float = 0.0
    output_folder: str = "."
    tables: dict[str, list[dict]] = field(default_factory=dict)
    findings: list[dict] = field(default_factory=list)


def clamp_report_limit(limit: float | None) -> int:
    if limit is None or limit != limit or limit < 1:
        return 10
    return int(min(100, limit))


def _rows(df: DataFrame, limit: int | None = None) -> list[dict]:
    return [r.asDict(recursive=True) for r in (df.limit(limit) if limit else df).collect()]


def cycles_with_symbols(graph: Graph, limit: int) -> list[dict]:
    """The ``limit`` largest call cycles, each with its members as symbols."""
    top = _rows(call_cycles(graph), limit)
    if not top:
        return []
    place = graph.spark.createDataFrame([(k, m) for k, c in enumerate(top) for m in c["members"]], "k int, id string")
    found: dict[int, list[dict]] = {}
    for r in _rows(graph.nodes.join(place, "id").select("k", *REF).orderBy("k", "id")):
        found.setdefault(r.pop("k"), []).append(r)
    return [{"size": c["size"], "symbols": found.get(k, [])} for k, c in enumerate(top)]


def gather(graph: Graph, generated_at: str, project: str, limit: float | None = None, output_folder: str = ".") -> Report:
    """The report of a graph. Only tables of ``limit`` rows, the symbols of as many
    cycles, the boundary and the dead exports are collected."""
    n = clamp_report_limit(limit)
    all_ = totals(graph).first().asDict()
    hot = hotspots(graph, "self-time", n)
    provenance = store.get_meta(graph.meta, "source")
    clustering = store.get_meta(graph.meta, "clustering") or {}
    kinds = _rows(kind_counts(store.anchored(graph.edges, graph.nodes)))
    blast = _rows(hotspots(graph, "blast-radius", n).df)
    ranked = [] if hot.fell_back or not hot.enriched else _rows(hot.df)
    cost = _rows(cost_ranking(graph, limit=n))
    dead = _rows(dead_exports(graph))
    semantic = any(k["kind"] == "CALLS" and k["count"] > 0 for k in kinds)
    tables = {
        "node_kinds": _rows(kind_counts(graph.nodes)), "edge_kinds": kinds, "callers": _rows(hotspots(graph, "callers", n).df), "blast": blast, "communities": _rows(communities(graph), n),
        "hotspots": ranked, "cost": cost, "structure": _rows(structure_vs_runtime(graph).orderBy("role", "rank")), "cycles": cycles_with_symbols(graph, n), "boundary": _rows(boundary(graph)), "dead": dead,
    }
    if provenance and provenance.get("baseUrl"):
        project = provenance["baseUrl"].split("://", 1)[-1].split("/", 1)[-1].strip("/") or project
    findings = []
    if blast:
        hot_keys = {(r["file_path"], r["name"]) for r in ranked}
        overlap = [r for r in blast if (r["file_path"], r["name"]) in hot_keys]
        if hot.enriched and overlap:
            findings.append({"title": "Change with the most care", "detail": "widely depended upon and among the hottest: a regression costs most here.", "tone": "risk", "symbols": overlap[:EXAMPLES]})
        else:
            share = int(blast[0]["score"] / all_["symbols"] * 100 + 0.5)
            findings.append({"title": "Highest blast radius", "detail": f"up to {blast[0]['score']:.0f} symbols, {share}% of the code, depend on one: change with care.", "tone": "risk", "symbols": blast[:EXAMPLES]})
    if ranked and (prefix := concentration(graph, n).first()) is not None:
        findings.append({"title": "Runtime is concentrated", "detail": f"{prefix['count']} function(s) take {int(prefix['share'] * 100 + 0.5)}% of measured self time: begin there.", "tone": "opportunity", "symbols": ranked[: min(prefix["count"], EXAMPLES)]})
    if dead:
        findings.append({"title": "Dead code is safe to remove", "detail": f"{len(dead)} exported symbol(s) in {len({r['file_path'] for r in dead})} file(s) are never used: confirm, then delete.", "tone": "opportunity", "symbols": dead[:EXAMPLES]})
    shape = ("semantic, enriched" if hot.enriched else "semantic") if semantic else "structural"
    verdict = f"{all_['symbols']} symbols across {all_['files']} files — {shape}, " + (f"{all_['cycles']} call cycle(s)." if all_["cycles"] else "acyclic.")
    if ranked:
        match = next((c for c in cost if (c["name"], c["file_path"]) == (ranked[0]["name"], ranked[0]["file_path"])), None)
        verdict += f" `{ranked[0]['name']}` is the hottest function" + (f" ({match['share_of_total'] * 100:.1f}% of inclusive cost)." if match else ".")
    if dead:
        verdict += f" {len(dead)} exported symbol(s) appear dead."
    return Report(generated_at, project, n, all_, verdict, provenance, coverage(graph).first()["coverage"], hot.enriched, semantic, clustering.get("quality"), measured_nodes(graph).agg(F.sum("self_ms")).first()[0] or 0.0, output_folder, tables, findings)
