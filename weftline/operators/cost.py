"""Inclusive cost: what a node costs itself and through what it calls."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import metadata as M
from weftline.operators.connectivity import anchored_ends, cyclic_core, strong_components
from weftline.plans.model import REF, Graph
from weftline.plans.settle import stored

METRICS = {"self-time": "self_ms", "samples": "samples"}
FLOWS = ("static", "runtime")
#: Levels that are peeled one by one before what is left is solved by doubling.
PEELED = 8


def clamp_limit(limit: float | None) -> int:
    """Rows of a ranking: 20 unless a number of 1 or more is given, 1000 at most."""
    if limit is None or limit != limit or limit in (float("inf"), float("-inf")) or limit < 1:
        return 20
    return min(1000, int(limit))


def measured_nodes(graph: Graph) -> DataFrame:
    """Nodes with (self_ms, samples, measured) read from their metadata."""
    return graph.nodes.select("seq", *REF, "exported", M.self_ms().alias("self_ms"), M.samples().alias("samples"), M.has_runtime().alias("measured"))


def flow_edges(graph: Graph, flow: str) -> tuple[DataFrame, str, bool]:
    """(src, dst, count) of the flow asked for, the flow used, and whether it fell back
    to static calls as no runtime call was recorded."""
    if flow not in FLOWS:
        raise ValueError(f"edges must be one of {', '.join(FLOWS)}")
    static = graph.edges.where("kind = 'CALLS'").select("src", "dst", M.call_count().alias("count"))
    if flow == "static":
        return static, "static", False
    runtime = graph.edges.where("kind = 'CALLS_RUNTIME'").select("src", "dst", M.flow_samples().alias("count"))
    return (static, "static", True) if runtime.isEmpty() else (runtime, "runtime", False)


@dataclass(frozen=True)
class CostModel:
    """``nodes``: (id, ..., self, inclusive, component, size, inbound); ``edges``:
    (src, dst, count) without self-calls and unknown ends."""

    nodes: DataFrame
    edges: DataFrame
    total_self: float
    measured: int


def _solve(own: DataFrame, shares: DataFrame) -> DataFrame:
    """(component, inclusive) where inclusive = own + sum of share * inclusive / per of the
    callee. ``own``: (component, self, per), per 0 for what passes nothing on;
    ``shares`` (src, dst, share) must be settled and acyclic.

    Components whose callees are all known are finished together, a few levels of
    them, in one join of each level's edges; deeper graphs are finished by squaring
    the shares, which takes a logarithm of the remaining depth in rounds."""
    left, pending, done = stored(own.select("component", F.col("self").alias("inclusive"), "per")), shares, None
    amount = F.sum(F.when(F.col("per") > 0, F.col("share") * F.col("inclusive") / F.col("per")).otherwise(0.0))
    for _ in range(PEELED):
        busy = stored(pending.select(F.col("src").alias("component")).distinct())
        ready = left.join(busy, "component", "left_anti")
        done = ready if done is None else done.unionByName(ready)
        if busy.isEmpty():
            return done.select("component", "inclusive")
        known = ready.select(F.col("component").alias("dst"), "inclusive", "per", F.lit(True).alias("known"))
        split = stored(pending.join(known, "dst", "left").select("src", "dst", "share", "inclusive", "per", F.coalesce("known", F.lit(False)).alias("known")))
        gains = split.where("known").groupBy(F.col("src").alias("component")).agg(amount.alias("gain"))
        rest = left.join(busy, "component", "left_semi").join(gains, "component", "left")
        left = stored(rest.select("component", (F.col("inclusive") + F.coalesce("gain", F.lit(0.0))).alias("inclusive"), "per"))
        pending = split.where("NOT known").select("src", "dst", "share")
    per = left.select(F.col("component").alias("dst"), "per")
    pending = stored(pending.join(per, "dst").where("per > 0").select("src", "dst", (F.col("share") / F.col("per")).alias("share")))
    left = left.select("component", "inclusive")
    while not pending.isEmpty():
        gains = pending.join(left, pending["dst"] == left["component"]).groupBy("src").agg(F.sum(F.col("share") * F.col("inclusive")).alias("gain"))
        left = stored(left.join(gains.withColumnRenamed("src", "component"), "component", "left").select("component", (F.col("inclusive") + F.coalesce("gain", F.lit(0.0))).alias("inclusive")))
        twice = pending.alias("a").join(pending.alias("b"), F.col("a.dst") == F.col("b.src"))
        pending = stored(twice.groupBy(F.col("a.src"), F.col("b.dst")).agg(F.sum(F.col("a.share") * F.col("b.share")).alias("share")))
    return done.select("component", "inclusive").unionByName(left)


def self_totals(nodes: DataFrame, metric: str = "self-time") -> dict[str, float]:
    """Self cost of all ``nodes`` (as ``measured_nodes`` gives them), and how many of them
    were measured. Calls have no part in either."""
    if metric not in METRICS:
        raise ValueError(f"by must be one of {', '.join(METRICS)}")
    sums = nodes.agg(F.sum(METRICS[metric]).alias("t"), F.sum(F.col("measured").cast("bigint")).alias("m")).first()
    return {"total_self": sums["t"] or 0.0, "measured": sums["m"] or 0}


def cost_model(graph: Graph, metric: str = "self-time", flow: str = "static") -> tuple[CostModel, str, bool]:
    """The model, the flow used and whether it fell back.

    A cycle costs as one: its members all have the total. What a callee costs is
    divided among its callers from outside its cycle by their counts."""
    if metric not in METRICS:
        raise ValueError(f"by must be one of {', '.join(METRICS)}")
    raw, used, fell = flow_edges(graph, flow)
    nodes = stored(measured_nodes(graph))
    edges, ends = anchored_ends(stored(raw.where("src <> dst")), nodes, "count")
    own = nodes.select("id", F.col(METRICS[metric]).alias("self"))
    core = cyclic_core(edges, ends=ends)
    if core is None:
        # without cycles each node is a component by itself, and what it costs a call is told by the node alone
        inbound = ends.where("into = 1").select("id", F.col("n").alias("inbound"))
        comps = own.join(inbound, "id", "left").select(F.col("id").alias("component"), "self", F.coalesce("inbound", F.lit(0.0)).alias("per"))
        solved = _solve(comps, edges.select("src", "dst", F.col("count").alias("share"))).withColumnRenamed("component", "id")
        costed = nodes.join(solved, "id").withColumns({"component": F.col("id"), "size": F.lit(1).cast("bigint")})
    else:
        found = strong_components(edges.select("src", "dst"), core=core)
        member = stored(own.join(found, "id", "left").select("id", "self", F.coalesce("component", "id").alias("component")))
        comps = member.groupBy("component").agg(F.sum("self").alias("self"), F.count("*").alias("size"))
        a, b = member.select(F.col("id").alias("src"), F.col("component").alias("s")), member.select(F.col("id").alias("dst"), F.col("component").alias("d"))
        between = stored(edges.join(a, "src").join(b, "dst").where("s <> d"))
        inbound = between.groupBy(F.col("dst").alias("id")).agg(F.sum("count").alias("inbound"))
        shares = between.join(inbound.withColumnRenamed("id", "dst"), "dst").where("inbound > 0").groupBy(F.col("s").alias("src"), F.col("d").alias("dst")).agg(F.sum(F.col("count") / F.col("inbound")).alias("share"))
        solved = _solve(comps.select("component", "self", F.lit(1.0).alias("per")), stored(shares))
        costed = nodes.join(member.select("id", "component"), "id").join(comps.select("component", "size"), "component").join(solved, "component")
    costed = costed.join(inbound, "id", "left")
    costed = costed.select("seq", *REF, "measured", F.col(METRICS[metric]).alias("self"), "inclusive", "component", "size", F.coalesce("inbound", F.lit(0.0)).alias("inbound"))
    sums = self_totals(nodes, metric)
    return CostModel(stored(costed), edges, sums["total_self"], sums["measured"]), used, fell


def _refs(model: CostModel) -> DataFrame:
    total = F.lit(model.total_self)
    share = F.when(total > 0, F.col("inclusive") / total).otherwise(0.0)
    return model.nodes.select(*REF, F.col("self").alias("self_cost"), F.col("inclusive").alias("inclusive_cost"), share.alias("share_of_total"), (F.col("size") > 1).alias("cyclic"), F.col("size").alias("component_size"))


def ranked(model: CostModel, limit: float | None = None) -> DataFrame:
    """Nodes of positive inclusive cost, costliest first."""
    return _refs(model).where("inclusive_cost > 0").orderBy(F.desc("inclusive_cost"), F.collate("file_path", "UNICODE"), "start_line", "id").limit(clamp_limit(limit))


def totals(model: CostModel) -> dict[str, float]:
    """Self cost of all nodes, and how many of them were measured."""
    return {"total_self": model.total_self, "measured": model.measured}


def cost_ranking(graph: Graph, by: str = "self-time", edges: str = "static", limit: float | None = None) -> DataFrame:
    """``ranked`` of the graph's cost model."""
    model, _, _ = cost_model(graph, by, edges)
    return ranked(model, limit)


def attribution(model: CostModel, node_id: str) -> dict[str, DataFrame]:
    """``node`` (no row for an unknown id), ``callees`` and ``callers`` of a node with
    the amount each edge carries, its share and its count. Edges within a cycle
    carry nothing across and are left out."""
    n = model.nodes
    focal = n.where(F.col("id") == node_id).select(F.col("component").alias("fc"), F.col("inclusive").alias("fi"), F.col("inbound").alias("fb"))
    order = [F.desc("amount"), F.collate("file_path", "UNICODE"), "start_line", "id"]
    out = model.edges.where(F.col("src") == node_id).join(n, F.col("dst") == F.col("id")).join(F.broadcast(focal)).where("component <> fc")
    amount = F.when(F.col("inbound") > 0, F.col("inclusive") * F.col("count") / F.col("inbound")).otherwise(0.0)
    callees = out.select(*REF, amount.alias("amount"), F.when(F.col("fi") > 0, amount / F.col("fi")).otherwise(0.0).alias("share"), F.col("count").alias("call_count"))
    into = model.edges.where(F.col("dst") == node_id).join(n, F.col("src") == F.col("id")).join(F.broadcast(focal)).where("component <> fc")
    share = F.when(F.col("fb") > 0, F.col("count") / F.col("fb")).otherwise(0.0)
    callers = into.select(*REF, F.when(F.col("fb") > 0, F.col("fi") * F.col("count") / F.col("fb")).otherwise(0.0).alias("amount"), share.alias("share"), F.col("count").alias("call_count"))
    return {"node": _refs(model).where(F.col("id") == node_id), "callees": callees.orderBy(*order), "callers": callers.orderBy(*order)}


def cost_attribution(graph: Graph, node_id: str, by: str = "self-time", edges: str = "static") -> dict[str, DataFrame]:
    """``attribution`` of a node in the graph's cost model."""
    model, _, _ = cost_model(graph, by, edges)
    return attribution(model, node_id)


def coverage(graph: Graph, by: str = "self-time") -> DataFrame:
    """(coverage double): matched over total of the runtime manifest, null where there is
    no manifest, it is malformed, or its total isn't positive."""
    kind = "SelfMicros" if by == "self-time" else "Samples"
    fields = [M.number("value", f"$.{f}") for f in ("totalSamples", "matchedSamples", "totalSelfMicros", "matchedSelfMicros")]
    whole = M.string("value", "$.source").isNotNull()
    for f in fields:
        whole = whole & f.isNotNull()
    total, matched = M.number("value", f"$.total{kind}"), M.number("value", f"$.matched{kind}")
    found = graph.meta.where("key = 'runtime'").select(F.when(whole & (total > 0), matched / total).alias("c"))
    return found.agg(F.max("c").alias("coverage"))
