"""The commands: ``extract``, ``load`` and ``enrich`` make a graph, the others ask it.

Everything lies below one folder (``-o``): ``graph`` has the JSON lines, ``store`` the
stored graph, ``bench`` the baselines. Each command that asks has ``--json``.
"""

from __future__ import annotations

import argparse
import datetime
import json
import os
import re
import sys
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from weftline.commands import benchmark, verify, workload
from weftline.extract import build, project
from weftline.operators import brief, cluster, connectivity, cost, hotspots, onehop, report, runtime
from weftline.plans.model import Graph
from weftline.sources import jsonl, profiles
from weftline.sources.store import GraphStore

FOLDER = "./.weftline"
_CAMEL = {"file_path": "filePath", "start_line": "startLine", "edge_kind": "edgeKind", "edge_metadata": "edgeMetadata", "self_cost": "selfCost", "inclusive_cost": "inclusiveCost", "share_of_total": "shareOfTotal", "component_size": "cycleSize", "call_count": "callCount", "blast": "blastRadius"}


class Refused(Exception):
    """A request that can't be met; its text is for the user."""


class Folder:
    def __init__(self, root: str) -> None:
        self.root, self.graph, self.store = root, f"{root}/graph", f"{root}/store"

    def baseline(self, target: str) -> str:
        return f"{self.root}/bench/{re.sub(r'[^A-Za-z0-9._-]+', '_', target)}.baseline.json"

    def brief(self, extension: str) -> str:
        return f"{self.root}/CODEBASE_BRIEF.{extension}"


def _session() -> SparkSession:
    builder = SparkSession.builder.appName("weftline")
    if SparkSession.getActiveSession() is None and "SPARK_MASTER" not in os.environ:
        builder = builder.config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "8")
    return builder.getOrCreate()


def _store(options: argparse.Namespace) -> GraphStore:
    return GraphStore(_session(), os.path.abspath(Folder(options.output_folder).store))


def _graph(options: argparse.Namespace) -> Graph:
    graph = _store(options).read()
    if graph.nodes.isEmpty():
        raise Refused(f"no graph in {options.output_folder}: run `extract` and `load` first")
    return graph


def _rows(df: DataFrame) -> list[dict]:
    return [{_CAMEL.get(k, k): v for k, v in r.asDict(recursive=True).items()} for r in df.collect()]


def _emit(value: object) -> None:
    print(json.dumps(value, indent=2, ensure_ascii=False))


def _where(row: dict) -> str:
    return f"{row['filePath']}:{row['startLine']}"


def _list(rows: Sequence[dict], options: argparse.Namespace, line: Callable[[dict], str], none: str = "(no results)") -> None:
    if options.json:
        _emit(list(rows))
    elif not rows:
        print(none)
    else:
        for row in rows:
            print(line(row))
        print(f"\n{len(rows)} result(s)")


def _choice(value: str | None, known: Sequence[str], what: str) -> None:
    if value is not None and value not in known:
        raise Refused(f"unknown {what} '{value}': choose one of {', '.join(known)}")


def _number(text: str | None) -> float | None:
    try:
        return float(text) if text is not None else None
    except ValueError:
        return float("nan")


# ---- making a graph


def extract(o: argparse.Namespace) -> None:
    spark, folder, root = _session(), Folder(o.output_folder), os.path.abspath(o.root)
    graph = build.build(project.sources(spark, root), o.semantic)
    source = project.provenance(root)
    jsonl.write(graph, folder.graph, source)
    print(f"{graph.nodes.count()} nodes, {graph.edges.count()} edges -> {folder.graph}")
    if source:
        print(f"  source: {source['baseUrl']} @ {source['commit'][:7]}")
    for title, df in (("Nodes", graph.nodes), ("Edges", graph.edges)):
        print(f"\n{title}")
        for row in report.kind_counts(df).collect():
            print(f"  {row['kind']:<16} {row['count']}")


def load(o: argparse.Namespace) -> None:
    nodes, edges, source = jsonl.read(_session(), Folder(o.output_folder).graph)
    counts = _store(o).load(nodes, edges, source)
    print(f"loaded {counts['nodes']} nodes, {counts['edges']} edges")


def enrich(o: argparse.Namespace) -> None:
    store = _store(o)
    done = runtime.enrich(_graph(o), profiles.read(store.spark, os.path.abspath(o.profile)), Path(o.profile).name, os.path.abspath(o.root))
    matched, dropped = done.matched.count(), [r.asDict() for r in done.dropped.limit(10).collect()]
    store.write(done.graph)
    totals = done.totals | {"nodesEnriched": matched}
    if o.json:
        _emit(totals | {"dropped": dropped})
        return
    print(f"enriched {matched} node(s): {totals['matchedSamples']} of {totals['totalSamples']} samples, {totals['matchedEdges']} runtime call(s)")
    for r in dropped:
        print(f"  dropped {r['samples']} sample(s), {r['reason']}: {r['label']}")


def cluster_detect(o: argparse.Namespace) -> None:
    resolution = _number(o.resolution)
    if resolution is None or not 0 < resolution < float("inf"):
        raise Refused(f"invalid --resolution '{o.resolution}': expected a positive number")
    graph = _store(o).write(cluster.cluster(_graph(o), resolution))
    groups = _rows(cluster.dump(cluster.assigned(graph)).select("community", "label", "size"))
    manifest = _meta(graph)
    if o.json:
        _emit(manifest | {"sizes": [g["size"] for g in groups], "nodesAssigned": sum(g["size"] for g in groups)})
    elif not groups:
        print("! no weighted edges in the graph: run `extract --semantic` and `load` first")
    else:
        print(f"assigned {sum(g['size'] for g in groups)} node(s) to {len(groups)} communities\n  resolution {resolution}, CPM quality {manifest['quality'] or 0:.4f}")
        print("  largest: " + ", ".join(f"{g['label']} ({g['size']})" for g in groups[:8]))


def _meta(graph: Graph) -> dict:
    from weftline.sources import store

    return store.get_meta(graph.meta, "clustering") or {}


def cluster_communities(o: argparse.Namespace) -> None:
    rows = _rows(cluster.dump(cluster.assigned(_graph(o))))
    if o.json:
        _emit({"communityCount": len(rows), "communities": [{"index": r["community"], "currentLabel": r["label"], "size": r["size"], "members": [{_CAMEL.get(k, k): v for k, v in m.items()} for m in r["members"]]} for r in rows]})
        return
    if not rows:
        print("! no communities: run `cluster` first")
    for r in rows:
        print(f"\n[{r['community']}] {r['label']} ({r['size']})")
        for m in r["members"]:
            print(f"  {m['kind']:<12} {m['name']}  {m['file_path']}")


def read_labels(path: str) -> dict[int, str]:
    """Labels by community number; Refused for a file that isn't such an object."""
    try:
        found = json.loads(Path(path).read_text(encoding="utf-8"))
    except OSError:
        raise Refused(f"could not read labels file '{path}'") from None
    except ValueError:
        raise Refused(f"labels file '{path}' is not valid JSON") from None
    if not isinstance(found, dict) or not all(isinstance(v, str) and v for v in found.values()):
        raise Refused("labels file must be a JSON object of community number to a label that isn't empty")
    bad = next((k for k in found if not re.fullmatch(r"\d+", k)), None)
    if bad is not None:
        raise Refused(f"invalid community number '{bad}': expected 0 or more")
    return {int(k): v for k, v in found.items()}


def cluster_rename(o: argparse.Namespace) -> None:
    wanted, graph = read_labels(o.labels), _graph(o)
    if cluster.assigned(graph).isEmpty():
        raise Refused("no communities found: run `cluster` first")
    renamed, changes, unknown = cluster.rename(graph, wanted)
    changed, missing = [r.asDict() for r in changes.collect()], [r["community"] for r in unknown.collect()]
    _store(o).write(renamed)
    if o.json:
        _emit({"changes": [{"index": c["community"], "from": c["from_label"], "to": c["to_label"]} for c in changed], "unknownIndexes": missing})
        return
    if missing:
        print(f"! ignored unknown communities: {', '.join(map(str, missing))}")
    for c in changed:
        print(f"  [{c['community']}] {c['from_label']} -> {c['to_label']}")
    print(f"renamed {len(changed)} communities")


# ---- asking it


def _symbols(find: Callable[[Graph, argparse.Namespace], DataFrame]) -> Callable[[argparse.Namespace], None]:
    def run(o: argparse.Namespace) -> None:
        _list(_rows(find(_graph(o), o)), o, lambda r: f"{r['kind']:<14} {r['name']}  {_where(r)}")

    return run


def references(o: argparse.Namespace) -> None:
    _list(_rows(onehop.references(_graph(o), o.id)), o, lambda r: f"<- {r['edgeKind']:<12} {r['name']}  {_where(r)}", "(no references)")


def neighbors(o: argparse.Namespace) -> None:
    _list(_rows(onehop.neighborhood(_graph(o), o.id)), o, lambda r: f"{'->' if r['direction'] == 'out' else '<-'} {r['edgeKind']:<12} {r['name']}  {_where(r)}", "(no neighbours)")


_UNITS = {"self-time": "ms", "samples": "samples", "callers": "callers", "call-count": "calls", "blast-radius": "impacted"}


def hotspots_(o: argparse.Namespace) -> None:
    _choice(o.by, hotspots.METRICS, "metric")
    found = hotspots.hotspots(_graph(o), o.by, _number(o.limit), o.measured_only)
    rows = _rows(found.df)
    if o.json:
        _emit({"metric": found.metric, "requestedMetric": found.requested, "enriched": found.enriched, "fellBack": found.fell_back, "measuredOnly": o.measured_only, "hotspots": rows})
        return
    if found.fell_back:
        print("! no runtime data in the graph: run `enrich` first. Ranked by callers instead.")
    print(f"Hotspots by {found.metric}" + " (measured nodes only)" * o.measured_only)
    for k, r in enumerate(rows, 1):
        print(f"{k:>2}. {brief.number(r['score']) + ' ' + _UNITS[found.metric]:>14}  {r['kind']:<10} {r['name']}  {_where(r)}")
    print(f"\n{len(rows)} hotspot(s)" if rows else "(no results)")


def _amount(metric: str, value: float) -> str:
    return f"{brief.number(round(value, 3))} {'ms' if metric == 'self-time' else 'samples'}"


def cost_(o: argparse.Namespace) -> None:
    _choice(o.by, tuple(cost.METRICS), "metric")
    _choice(o.edges, cost.FLOWS, "call graph")
    graph = _graph(o)
    enriched = not cost.measured_nodes(graph).where("measured").isEmpty()
    seen = cost.coverage(graph, o.by).first()["coverage"]
    model, used, fell = cost.cost_model(graph, o.by, o.edges)
    head = {"metric": o.by, "edges": used, "fellBack": fell, "enriched": enriched, "totalSelf": model.total_self, "measuredNodes": model.measured, "coverage": seen}
    warn = "! no runtime data in the graph: run `enrich` first." if not enriched else "! no runtime call edges: following static calls instead." if fell else None
    if o.id is None:
        rows = _rows(cost.ranked(model, _number(o.limit)))
        if o.json:
            _emit(head | {"nodes": rows})
            return
        if warn:
            print(warn)
        if enriched:
            print(f"Inclusive cost by {o.by} (total self {_amount(o.by, model.total_self)}, coverage {'unknown' if seen is None else brief.percent(seen)})")
            for k, r in enumerate(rows, 1):
                print(f"{k:>2}. {_amount(o.by, r['inclusiveCost']):>14} {brief.percent(r['shareOfTotal'], 1):>7}  {r['kind']:<10} {r['name']}{' ↺' if r['cyclic'] else ''}  {_where(r)}")
            print(f"\n{len(rows)} node(s)" if rows else "(no results)")
        return
    parts = {k: _rows(df) for k, df in cost.attribution(model, o.id).items()}
    node = parts["node"][0] if parts["node"] else None
    if o.json:
        _emit(head | {"node": node, "callees": parts["callees"], "callers": parts["callers"]})
    elif node is None:
        print("(no such node: resolve an id with `find` first)")
    elif not enriched:
        print(warn)
    else:
        print(f"{node['name']}  {node['kind']}  {_where(node)}\n  self {_amount(o.by, node['selfCost'])}, inclusive {_amount(o.by, node['inclusiveCost'])}, share of total {brief.percent(node['shareOfTotal'], 1)}")
        if node["cyclic"]:
            print(f"  part of a {node['cycleSize']}-node call cycle: its members share the cycle's total")
        for title, key, arrow in (("Cost flows into (callees)", "callees", "->"), ("Attributed to callers", "callers", "<-")):
            print(f"\n{title}")
            for r in parts[key]:
                print(f"  {arrow} {_amount(o.by, r['amount']):>14} {brief.percent(r['share'], 1):>7}  {r['name']}  {_where(r)}")
            if not parts[key]:
                print("  (none)")


def campaign(o: argparse.Namespace) -> None:
    _choice(o.by, hotspots.METRICS, "metric")
    rows = _rows(hotspots.campaign(_graph(o), o.by, _number(o.limit) or float("nan"), float("nan") if (most := _number(o.max_blast)) is None else most))
    if o.json:
        _emit({"items": rows})
        return
    print("Optimisation campaign")
    for k, r in enumerate(rows, 1):
        detail = "safe removal" if r["candidate"] == "dead-export" else f"{brief.number(round(r['score'], 3))} {r['metric']}, blast {r['blastRadius']}"
        print(f"{k:>2}. {r['readiness']:<15}  {r['kind']:<9} {r['name']}  {detail}  {_where(r)}")
    counts = [f"{n} {x}" for x in ("auto-applicable", "needs-workload", "manual") if (n := sum(r["readiness"] == x for r in rows))]
    print(f"\n{len(rows)} item(s): {', '.join(counts)}" if rows else "(no candidates)")


def benchmark_(o: argparse.Namespace) -> None:
    _choice(o.by, benchmark.METRICS, "metric")
    store, path = _store(o), Folder(o.output_folder).baseline(o.target)
    base = benchmark.read_baseline(path) if o.baseline else None
    found = benchmark.measure(store, o.target, lambda _: benchmark.profile_and_enrich(store, os.path.abspath(o.workload), os.path.abspath(o.root)), o.by, _number(o.runs), base)
    if o.save_baseline:
        benchmark.save_baseline(path, found)
    if o.json:
        _emit(found)
        return
    s, unit = found["stats"], found["unit"]
    print(f"{found['target']['name']}  {found['metric']}  median {round(s['median'], 3)} {unit} (min {round(s['min'], 3)}, max {round(s['max'], 3)}, spread {round(s['spread'], 3)}, mean {round(s['mean'], 3)}, {s['runs']} runs)")
    if (d := found["delta"]) is not None:
        print(f"  against the baseline: {d['absolute']:+.3f} {unit} ({benchmark.signed_percent(d['percent'])}), {benchmark.direction(d, s['spread'])}")
    print(f"  {found['advisory']}")


def verify_(o: argparse.Namespace) -> int:
    found = verify.verify(o.cwd, typecheck=o.typecheck_script, test=o.test_script, skip_typecheck=o.skip_typecheck, skip_tests=o.skip_tests)
    if o.json:
        _emit(found.as_dict())
        return 0 if found.ok else 1
    for c in found.checks:
        print(f"{c.status:<8} {c.name:<10} {c.command or c.skipped_reason}")
        if c.status == "fail":
            print(c.output.rstrip())
    print(f"\n{found.summary}")
    return 0 if found.ok else 1


def report_(o: argparse.Namespace) -> None:
    _choice(o.format, ("markdown", "json", "html"), "format")
    folder = Folder(o.output_folder)
    found = report.gather(_graph(o), datetime.date.today().isoformat(), Path(os.path.abspath(folder.root)).name, _number(o.limit), o.output_folder)
    content = {"markdown": brief.markdown, "json": brief.to_json, "html": brief.html}[o.format](found)
    if o.stdout:
        print(content)
        return
    path = o.output or folder.brief({"markdown": "md", "json": "json", "html": "html"}[o.format])
    Path(path).write_text(content, encoding="utf-8")
    print(f"wrote {path}")


def webview(o: argparse.Namespace) -> None:
    path = o.output or f"{o.output_folder}/graph_data.js"
    Path(path).write_text(jsonl.viewer_script(_graph(o)), encoding="utf-8")
    print(f"wrote {path}")


def workload_(o: argparse.Namespace) -> None:
    if o.action == "path":
        print(workload.in_container(os.path.abspath(o.project), os.path.abspath(o.path)))
    else:
        for source, target in workload.scaffold_files(o.kind):
            print(f"{source} -> {target}")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="weftline", description="Property graphs of code and its runtime.")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, run: Callable, help_: str, asks: bool = True, under=commands) -> argparse.ArgumentParser:
        p = under.add_parser(name, help=help_)
        p.add_argument("-o", "--output-folder", default=FOLDER)
        if asks:
            p.add_argument("--json", action="store_true")
        p.set_defaults(run=run)
        return p

    p = command("extract", extract, "TypeScript sources -> JSON lines", False)
    p.add_argument("root")
    p.add_argument("--semantic", action="store_true")
    command("load", load, "JSON lines -> stored graph", False)
    p = command("enrich", enrich, "write a CPU profile onto the graph")
    p.add_argument("profile")
    p.add_argument("-r", "--root", default=".")
    groups = command("cluster", cluster_detect, "communities")
    groups.add_argument("--resolution", default=str(cluster.RESOLUTION))
    below = groups.add_subparsers(dest="action")
    command("detect", cluster_detect, "find communities", under=below).add_argument("--resolution", default=str(cluster.RESOLUTION))
    command("communities", cluster_communities, "list them with their members", under=below)
    command("rename", cluster_rename, "label them from a file", under=below).add_argument("--labels", required=True)
    command("find", _symbols(lambda g, o: onehop.find(g, o.pattern)), "symbols by part of a name").add_argument("pattern")
    command("who-calls", _symbols(lambda g, o: onehop.who_calls(g, o.id)), "callers of a symbol").add_argument("id")
    command("calls", _symbols(lambda g, o: onehop.calls(g, o.id)), "what a symbol calls").add_argument("id")
    command("dead-exports", _symbols(lambda g, o: hotspots.dead_exports(g)), "exports that nothing uses")
    command("references", references, "uses of a symbol").add_argument("id")
    command("neighbors", neighbors, "all edges of a symbol").add_argument("id")
    p = command("blast-radius", _symbols(lambda g, o: connectivity.blast_radius(g, o.id, _number(o.depth))), "what a change can reach")
    p.add_argument("id")
    p.add_argument("--depth", default="10")
    p = command("hotspots", hotspots_, "rank symbols")
    p.add_argument("--by")
    p.add_argument("--limit", default="20")
    p.add_argument("--measured-only", action="store_true")
    p = command("cost", cost_, "inclusive cost of all symbols or of one")
    p.add_argument("id", nargs="?")
    p.add_argument("--by", default="self-time")
    p.add_argument("--edges", default="static")
    p.add_argument("--limit", default="20")
    p = command("campaign", campaign, "a worklist for optimisation")
    p.add_argument("--by")
    p.add_argument("--limit", default="20")
    p.add_argument("--max-blast", default="25")
    p = command("benchmark", benchmark_, "measure a symbol over repeated profiles")
    p.add_argument("target")
    p.add_argument("--workload", required=True)
    p.add_argument("-r", "--root", default=".")
    p.add_argument("--by", default="self-time")
    p.add_argument("--runs", default="5")
    p.add_argument("--baseline", action="store_true")
    p.add_argument("--save-baseline", action="store_true")
    p = command("verify", verify_, "one verdict from a project's checks")
    p.add_argument("-C", "--cwd", default=".")
    p.add_argument("--typecheck-script", default="typecheck")
    p.add_argument("--test-script", default="test")
    p.add_argument("--skip-typecheck", action="store_true")
    p.add_argument("--skip-tests", action="store_true")
    p = command("report", report_, "the brief", False)
    p.add_argument("--format", default="markdown")
    p.add_argument("--output")
    p.add_argument("--limit", default="10")
    p.add_argument("--stdout", action="store_true")
    command("webview", webview, "data for the viewer", False).add_argument("--output")
    p = commands.add_parser("workload", help="paths and files of a contained workload")
    p.set_defaults(run=workload_)
    actions = p.add_subparsers(dest="action", required=True)
    path = actions.add_parser("path")
    path.add_argument("project")
    path.add_argument("path")
    actions.add_parser("scaffold").add_argument("--kind", default="both", choices=("cpu-profile", "loadtest", "both"))
    return top


def main(argv: Sequence[str] | None = None) -> int:
    """Exit code: 0, or 1 for what was refused or a failed verdict."""
    options = parser().parse_args(argv)
    try:
        return options.run(options) or 0
    except (Refused, ValueError, LookupError, RuntimeError) as why:
        print(why, file=sys.stderr)
        return 1
