"""CPU profiles: frames, totals, runtime calls, and their join with a graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import metadata as M
from weftline.plans.model import Graph
from weftline.plans.settle import settle
from weftline.sources import store

NAMED_KINDS = ("Function", "Method", "Property", "Variable", "Class")


def frame_samples(nodes: DataFrame, samples: DataFrame) -> DataFrame:
    """(node, function_name, url, line, column_number, samples, self_micros) of frames
    with a sample. ``nodes``: (node, function_name, url, line, column_number,
    hit_count); ``samples``: (at, node, delta), delta null where the profile has
    none. A profile without samples counts hits, at 0 microseconds. Lines become
    1-based."""
    taken = samples.groupBy("node").agg(F.count("*").alias("samples"), F.sum(F.greatest(F.coalesce("delta", F.lit(0)), F.lit(0))).cast("double").alias("self_micros"))
    if samples.isEmpty():
        taken = nodes.where("hit_count > 0").select("node", F.col("hit_count").alias("samples"), F.lit(0.0).alias("self_micros"))
    return nodes.join(taken, "node").select("node", "function_name", "url", (F.col("line") + 1).alias("line"), "column_number", "samples", "self_micros")


def total_samples(nodes: DataFrame, samples: DataFrame) -> DataFrame:
    """(total bigint): the samples, or the hits of a profile without samples."""
    if samples.isEmpty():
        return nodes.agg(F.coalesce(F.sum("hit_count"), F.lit(0)).cast("bigint").alias("total"))
    return samples.agg(F.count("*").alias("total"))


def subtree_samples(tree: DataFrame, own: DataFrame) -> DataFrame:
    """(node, subtree): own samples plus those of all descendants. ``tree``: (parent,
    child); ``own``: (node, samples). Works by doubling the distance that sums
    travel upwards, a logarithm of the depth in rounds; a node that is its own
    ancestor counts once."""
    links = settle(tree.where("parent <> child").select(F.col("parent").alias("up"), F.col("child").alias("down")).distinct())
    size = links.count()
    while True:
        longer = links.alias("a").join(links.alias("b"), F.col("a.down") == F.col("b.up")).select(F.col("a.up"), F.col("b.down")).where("up <> down")
        links = settle(links.unionByName(longer).distinct())
        if (after := links.count()) == size:
            break
        size = after
    below = links.join(own, links["down"] == own["node"]).groupBy(F.col("up").alias("node")).agg(F.sum("samples").alias("below"))
    return own.join(below, "node", "left").select("node", (F.col("samples") + F.coalesce("below", F.lit(0))).alias("subtree"))


def runtime_calls(tree: DataFrame, own: DataFrame) -> DataFrame:
    """(parent, child, samples): one edge per tree link, weighing what is below it."""
    return tree.join(subtree_samples(tree, own), F.col("child") == F.col("node")).select("parent", "child", F.col("subtree").alias("samples"))


def file_of(frames: DataFrame, paths: DataFrame, root: str) -> DataFrame:
    """``frames`` with ``file_path`` from ``url``: none for an empty or ``node:`` one; for
    a file URL or absolute path the path below ``root`` if it is known, else the one
    known path that it ends with (several give none); other paths must be known as
    they are. Only a file URL is decoded, and one that can't be has none. ``paths``:
    (file_path), distinct."""
    is_url = F.col("url").startswith("file://")
    decoded = F.try_url_decode(F.regexp_replace(F.regexp_replace("url", r"^file://", ""), r"\+", "%2B"))
    absolute = F.col("url").startswith("file://") | F.col("url").startswith("/")
    local = F.when((F.col("url") == "") | F.col("url").isNull() | F.col("url").startswith("node:"), None).otherwise(F.when(is_url, decoded).otherwise(F.col("url")))
    below = F.when(absolute & F.col("p").startswith(root.rstrip("/") + "/"), F.substring(F.col("p"), F.lit(len(root.rstrip("/")) + 2), F.length("p")))
    urls = frames.select("url").distinct().withColumn("p", local).where("p IS NOT NULL").withColumn("absolute", absolute).withColumn("exact", F.when(absolute, below).otherwise(F.col("p")))
    known = paths.select(F.col("file_path").alias("k"))
    direct = urls.join(known, F.col("exact") == F.col("k")).select("url", F.col("k").alias("file_path"))
    # a path ends with "/suffix" exactly when one of its suffixes equals it
    parts = F.split("p", "/")
    suffixes = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    ended = urls.where("absolute AND p LIKE '%/%'").join(direct.select("url"), "url", "left_anti").select("url", F.explode(suffixes).alias("k")).join(known, "k")
    unique = ended.groupBy("url").agg(F.count("*").alias("n"), F.min("k").alias("file_path")).where("n = 1").select("url", "file_path")
    return frames.join(direct.unionByName(unique), "url", "left")


def _innermost() -> Column:
    """Rank of a frame's enclosing nodes: smallest span, later start, load order."""
    return F.row_number().over(Window.partitionBy("frame").orderBy(F.col("end_line") - F.col("start_line"), F.desc("start_line"), "seq", "id"))


def resolve_frames(frames: DataFrame, nodes: DataFrame) -> DataFrame:
    """(frame, id, via): the node that each frame runs in. ``frames``: (frame,
    function_name, file_path, line). ``via`` is ``name``, ``range``, or why there is
    none: ``no-file``, ``ambiguous``, ``no-node``.

    A name matches a function-like node of the file by the frame's name or its last
    dotted part; several matches are told apart by the innermost range around the
    line, and without a match the innermost node of any kind counts."""
    placed = frames.where("file_path IS NOT NULL")
    name = F.col("function_name")
    wanted = F.when((F.coalesce(name, F.lit("")) == "") | name.startswith("("), F.array().cast("array<string>")).otherwise(F.array_distinct(F.array(name, F.substring_index(name, ".", -1))))
    spans = nodes.select("id", "seq", "kind", F.col("name").alias("node_name"), F.col("file_path").alias("fp"), "start_line", "end_line")
    asked = placed.select("frame", "file_path", "line", F.explode(wanted).alias("wanted"))
    named = asked.join(spans.where(F.col("kind").isin(*NAMED_KINDS)), (F.col("file_path") == F.col("fp")) & (F.col("wanted") == F.col("node_name"))).dropDuplicates(["frame", "id"])
    counts = named.groupBy("frame").agg(F.count("*").alias("n"), F.min("id").alias("only"))
    around = (F.col("line") >= 1) & (F.col("start_line") >= 1) & (F.col("end_line") >= F.col("start_line")) & F.col("line").between(F.col("start_line"), F.col("end_line"))
    among = named.where(around).withColumn("r", _innermost()).where("r = 1").select("frame", F.col("id").alias("among"))
    unnamed = placed.join(counts, "frame", "left_anti")
    ranged = unnamed.join(spans, F.col("file_path") == F.col("fp")).where(around).withColumn("r", _innermost()).where("r = 1").select("frame", F.col("id").alias("ranged"))
    joined = frames.join(counts, "frame", "left").join(among, "frame", "left").join(ranged, "frame", "left")
    node = F.when(F.col("n") == 1, F.col("only")).when(F.col("n") > 1, F.col("among")).otherwise(F.col("ranged"))
    via = F.when(F.col("file_path").isNull(), "no-file").when(F.col("n") == 1, "name").when(F.col("n") > 1, F.when(F.col("among").isNotNull(), "name").otherwise("ambiguous")).otherwise(F.when(F.col("ranged").isNotNull(), "range").otherwise("no-node"))
    return joined.select("frame", node.alias("id"), via.alias("via"))


def millis(micros: Column) -> Column:
    return F.floor(micros + 0.5) / 1000


@dataclass(frozen=True)
class Enriched:
    graph: Graph
    matched: DataFrame
    dropped: DataFrame
    calls: DataFrame
    totals: dict[str, float]


def attribute(frames: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, samples, self_micros) per node, and (reason, label, samples, self_micros) of
    what has none, largest first."""
    joined = frames.join(found, frames["node"] == found["frame"])
    matched = joined.where(F.col("id").isNotNull()).groupBy("id").agg(F.sum("samples").alias("samples"), F.sum("self_micros").alias("self_micros"))
    label = F.when(F.coalesce("function_name", F.lit("")) == "", F.lit("(anonymous)")).otherwise(F.col("function_name"))
    # a file that isn't the graph's is named without its line, so that its frames are one group
    there = F.concat(label, F.lit(" "), F.coalesce("url", F.lit("")))
    nowhere = F.when(F.coalesce("url", F.lit("")) == "", label).otherwise(there)
    where = F.when(F.col("via") == "no-file", nowhere).otherwise(F.concat(there, F.lit(":"), F.col("line").cast("string")))
    dropped = joined.where(F.col("id").isNull()).groupBy(F.col("via").alias("reason"), where.alias("label")).agg(F.sum("samples").alias("samples"), F.sum("self_micros").alias("self_micros"))
    return matched, dropped.orderBy(F.desc("self_micros"), F.desc("samples"), "label")


def call_edges(links: DataFrame, found: DataFrame) -> tuple[DataFrame, int]:
    """(src, dst, samples) of runtime calls between resolved nodes, and how many links
    went into them. Unresolved ends and calls to oneself are left out."""
    a, b = found.select(F.col("frame").alias("parent"), F.col("id").alias("src")), found.select(F.col("frame").alias("child"), F.col("id").alias("dst"))
    both = settle(links.join(a, "parent").join(b, "child").where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst"))
    return both.groupBy("src", "dst").agg(F.sum("samples").alias("samples")), both.count()


def enrich(graph: Graph, profile: DataFrame, source: str, root: str) -> Enriched:
    """Write a profile onto a graph: ``runtime`` on the nodes that matched (others keep
    what they have), the manifest, and CALLS_RUNTIME edges in place of the old."""
    from weftline.sources import profiles

    nodes, samples, tree = profiles.parts(profile)
    frames = settle(frame_samples(nodes, samples))
    own = nodes.join(frames.select("node", "samples"), "node", "left").select("node", F.coalesce("samples", F.lit(0)).alias("samples"))
    paths = graph.nodes.where("file_path <> ''").select("file_path").distinct()
    placed = file_of(nodes.select(F.col("node").alias("frame"), "function_name", "url", (F.col("line") + 1).alias("line")), paths, root)
    found = settle(resolve_frames(placed, graph.nodes))
    matched, dropped = attribute(frames, found)
    matched = settle(matched)
    runtime = F.to_json(F.struct(F.struct(F.lit(source).alias("source"), "samples", F.col("self_micros").alias("selfMicros"), millis(F.col("self_micros")).alias("selfMs")).alias("runtime")))
    changed = M.with_changes(graph.nodes, matched.select("id", runtime.alias("change")))
    calls, links = call_edges(runtime_calls(tree, own), found)
    sums = frames.agg(F.sum("self_micros")).first()[0] or 0.0
    hit = matched.agg(F.sum("samples"), F.sum("self_micros")).first()
    totals = {"totalSamples": total_samples(nodes, samples).first()[0], "matchedSamples": hit[0] or 0, "totalSelfMicros": sums, "matchedSelfMicros": hit[1] or 0.0, "matchedEdges": links}
    edges = store.delete_edges(graph.edges, "CALLS_RUNTIME")
    metadata = F.to_json(F.struct(F.lit(source).alias("source"), "samples"))
    edges = edges.unionByName(calls.select(F.lit(0).cast("bigint").alias("seq"), "src", "dst", F.lit("CALLS_RUNTIME").alias("kind"), metadata.alias("metadata")))
    manifest = {"source": source} | {k: totals[k] for k in ("totalSamples", "matchedSamples", "totalSelfMicros", "matchedSelfMicros")}
    return Enriched(Graph(changed, edges, store.put_meta(graph.meta, "runtime", manifest)), matched, dropped, calls, totals)
