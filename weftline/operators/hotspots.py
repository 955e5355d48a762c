"""Rankings of nodes by runtime and by calls, dead exports and the worklist."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import metadata as M
from weftline.operators.connectivity import ancestor_counts, blast_sizes
from weftline.operators.cost import clamp_limit, measured_nodes
from weftline.plans.model import REF, USE_KINDS, Graph
from weftline.plans.settle import settle
from weftline.sources import store

METRICS = ("self-time", "samples", "callers", "call-count", "blast-radius")
RUNTIME_METRICS = METRICS[:2]
WORKLIST_DEPTH = 10


@dataclass(frozen=True)
class Hotspots:
    """A ranking (REF, score) with how it came about."""

    df: DataFrame
    metric: str
    requested: str
    enriched: bool
    fell_back: bool


def scores(graph: Graph, metric: str) -> DataFrame:
    """(id, score) for the nodes that the metric scores."""
    if metric in RUNTIME_METRICS:
        value = M.self_ms() if metric == "self-time" else M.samples()
        return graph.nodes.select("id", value.alias("score"))
    if metric == "blast-radius":
        return ancestor_counts(graph).select("id", F.col("blast").cast("double").alias("score"))
    calls = graph.edges.where("kind = 'CALLS'")
    score = F.count("*").cast("double") if metric == "callers" else F.sum(M.call_count())
    return calls.groupBy(F.col("dst").alias("id")).agg(score.alias("score"))


def hotspots(graph: Graph, by: str | None = None, limit: float | None = None, measured_only: bool = False) -> Hotspots:
    """The top nodes by a metric. Unasked, it is self-time where any node was measured
    and callers elsewhere; a runtime metric on an unmeasured graph falls back to
    callers. Scores of 0 are left out."""
    if by is not None and by not in METRICS:
        raise ValueError(f"by must be one of {', '.join(METRICS)}")
    enriched = not graph.nodes.where(M.has_runtime()).isEmpty()
    requested = by or ("self-time" if enriched else "callers")
    fell = requested in RUNTIME_METRICS and not enriched
    metric = "callers" if fell else requested
    nodes = graph.nodes.where(M.has_runtime()) if measured_only else graph.nodes
    ranked = nodes.join(scores(graph, metric), "id").where("score > 0").select(*REF, "score")
    top = ranked.orderBy(F.desc("score"), F.collate("file_path", "UNICODE"), "start_line", "id").limit(clamp_limit(limit))
    return Hotspots(top, metric, requested, enriched, fell)


def dead_exports(graph: Graph, unknown: tuple[DataFrame, int] | None = None) -> DataFrame:
    """Exported nodes that no edge uses, neither themselves nor a node they contain
    directly, framework entry points aside; by file and line. A recursive
    function uses itself. ``unknown``: what ``store.unknown_ends`` gave, where that is
    known."""
    uses = store.known_ends(store.edges_of(graph, *USE_KINDS), graph.nodes, "src", unknown=unknown)
    used = settle(uses.select(F.col("dst").alias("id")).distinct())
    inside = graph.edges.where("kind = 'CONTAINS'").join(used.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"))
    live = used.unionByName(inside).distinct()
    dead = graph.nodes.where("exported").join(live, "id", "left_anti").where(~entry_point(F.col("file_path")))
    return dead.select(*REF).orderBy("file_path", "start_line", "id")


_SCRIPTS = ("js", "jsx", "mjs", "cjs", "ts", "tsx", "mts", "cts")
_ROUTES = ("page", "layout", "loading", "error", "not-found", "global-error", "template", "default", "route", "sitemap", "robots", "manifest", "opengraph-image", "twitter-image", "icon", "apple-icon")


def entry_point(path: Column) -> Column:
    """Whether a framework takes a file's exports by convention: configuration files of
    three frameworks, route files below an ``app`` or ``pages`` folder, middleware at
    the root or in ``src``, and test set-up files."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda s: s != "")
    base = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    script = F.contains(base, F.lit(".")) & F.substring_index(base, ".", -1).isin(*_SCRIPTS)
    stem = F.regexp_replace(base, r"\.[^.]*$", "")
    at_root = (F.size(parts) == 1) | ((F.size(parts) == 2) & (F.get(parts, F.lit(0)) == "src"))
    routed = stem.isin(*_ROUTES) & F.arrays_overlap(folders, F.array(F.lit("app"), F.lit("pages")))
    named = stem.isin("next.config", "tailwind.config", "playwright.config", "global-setup", "global-teardown")
    return F.coalesce(script & (named | (stem.isin("middleware", "instrumentation") & at_root) | routed), F.lit(False))


def _clamp(value: float, least: int, most: int) -> int:
    if value != value or value in (float("inf"), float("-inf")):
        return least
    return min(most, max(least, int(value // 1)))


def campaign(graph: Graph, by: str | None = None, limit: float = 20, max_blast: float = 25) -> DataFrame:
    """Ranked worklist: dead exports can go at once; hotspots need a workload, or, when
    more than ``max_blast`` nodes reach them within ten calls, a human. A node can be
    listed as both."""
    limit, ceiling = _clamp(limit, 1, 1000), _clamp(max_blast, 0, 1000)
    dead = dead_exports(graph).select(*REF, F.lit("dead-export").alias("candidate"), F.lit("auto-applicable").alias("readiness"), F.lit(0.0).alias("score"), F.lit(None).cast("string").alias("metric"), F.lit(0).cast("bigint").alias("blast"))
    found = hotspots(graph, by, limit)
    # a ranking has at most 1000 rows: their ids fit in a plan
    top = settle(found.df)
    blasts = blast_sizes(graph, [r["id"] for r in top.select("id").collect()] or [""], WORKLIST_DEPTH)
    hot = top.join(blasts, "id").select(
        *REF, F.lit("hotspot").alias("candidate"), F.when(F.col("blast") <= ceiling, "needs-workload").otherwise("manual").alias("readiness"),
        "score", F.lit(found.metric).alias("metric"), "blast",
    )
    rank = F.when(F.col("readiness") == "auto-applicable", 0).when(F.col("readiness") == "needs-workload", 1).otherwise(2)
    both = dead.unionByName(hot).withColumn("r", rank)
    return both.orderBy("r", F.desc("score"), F.collate("file_path", "UNICODE"), "start_line", "id").limit(limit).drop("r")


def runtime_stats(graph: Graph, top: int = 12) -> tuple[dict[str, float], DataFrame]:
    """The viewer's figures: largest and total self time, measured nodes, and the top
    nodes with fraction sqrt(self / largest)."""
    m = measured_nodes(graph).where("measured")
    row = m.agg(F.max("self_ms").alias("most"), F.sum("self_ms").alias("total"), F.count("*").alias("n")).first()
    most = row["most"] or 0.0
    share = F.sqrt(F.col("self_ms") / most) if most > 0 else F.lit(0.0)
    listed = m.where("self_ms > 0").select(*REF, "self_ms", share.alias("fraction")).orderBy(F.desc("self_ms"), "id").limit(top)
    return {"max_self_ms": most, "total_self_ms": row["total"] or 0.0, "measured": row["n"]}, listed
