"""Measuring one symbol over repeated profiles, against a saved baseline."""

from __future__ import annotations

import json
import statistics
import subprocess
import tempfile
from collections.abc import Callable, Sequence
from pathlib import Path

from weftline.operators import bench, onehop, runtime
from weftline.operators.cost import cost_attribution
from weftline.plans.model import REF, Graph
from weftline.sources import profiles
from weftline.sources.store import GraphStore

METRICS = ("self-time", "inclusive-time", "samples")


def summary(values: Sequence[float]) -> dict:
    """Median and spread of one run's worth each; ValueError without any."""
    if not values:
        raise ValueError("a benchmark needs a run")
    low, high = min(values), max(values)
    return {"runs": len(values), "median": statistics.median(values), "min": low, "max": high, "mean": statistics.fmean(values), "spread": high - low, "values": list(values)}


def change(baseline: float, now: float) -> dict:
    """From one median to another; ``percent`` is NaN for a baseline of 0."""
    return {"baselineMedian": baseline, "currentMedian": now, "absolute": now - baseline, "percent": (now - baseline) / baseline if baseline else float("nan")}


def signed_percent(share: float) -> str:
    return "n/a" if share != share else f"{'+' if share > 0 else ''}{share * 100:.1f}%"


def direction(delta: dict, spread: float) -> str:
    if abs(delta["absolute"]) <= spread:
        return "unchanged"
    return "improved" if delta["absolute"] < 0 else "regressed"


def read_metric(graph: Graph, node_id: str, metric: str) -> float:
    """The symbol's measured figure; LookupError for one that is gone."""
    row = cost_attribution(graph, node_id, "samples" if metric == "samples" else "self-time")["node"].first()
    if row is None:
        raise LookupError(f"{node_id} is no longer in the graph: build it anew after an edit")
    return float(row["inclusive_cost"] if metric == "inclusive-time" else row["self_cost"])


def measure(store: GraphStore, target: str, profile: Callable[[int], None], metric: str = "self-time", runs: float | None = 5, baseline: float | None = None) -> dict:
    """The report of ``runs`` (1 to 50) calls of ``profile``, each of which leaves fresh
    runtime figures in the store. With a ``baseline`` median also the change."""
    if metric not in METRICS:
        raise ValueError(f"by must be one of {', '.join(METRICS)}")
    graph = store.read()
    node_id = onehop.resolve(graph, target)
    symbol = graph.nodes.where(graph.nodes["id"] == node_id).select(*REF).first().asDict()
    values = []
    for run in range(bench.clamp_runs(runs)):
        profile(run)
        values.append(read_metric(store.read(), node_id, metric))
    stats = summary(values)
    unit = "samples" if metric == "samples" else "ms"
    note = f"Advisory: runtime is noisy. A median of {stats['runs']} run(s) with a spread of {round(stats['spread'], 3)} {unit} is a hint; only the verify gate passes or fails."
    return {"target": symbol, "metric": metric, "unit": unit, "stats": stats, "delta": None if baseline is None else change(baseline, stats["median"]), "advisory": note}


def profile_and_enrich(store: GraphStore, workload: str, root: str) -> None:
    """Profile one run of a workload file and write it onto the stored graph."""
    with tempfile.TemporaryDirectory(prefix="profile-") as folder:  # the profiler runs beside the driver, which reads its file
        done = subprocess.run(["node", "--cpu-prof", "--cpu-prof-dir", folder, "--import", "tsx", workload], cwd=root, stdout=subprocess.DEVNULL, stderr=subprocess.PIPE, text=True, check=False)
        if done.returncode:
            raise RuntimeError(f"workload {workload} ended with code {done.returncode}\n{done.stderr.strip()}")
        found = sorted(Path(folder).glob("*.cpuprofile"), key=lambda p: p.stat().st_mtime)
        if not found:
            raise RuntimeError(f"workload {workload} left no profile")
        store.write(runtime.enrich(store.read(), profiles.read(store.spark, str(found[-1])), found[-1].name, root).graph)


def save_baseline(path: str, report: dict) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(report, indent=2, ensure_ascii=False), encoding="utf-8")


def read_baseline(path: str) -> float:
    """The median of a saved report; ValueError for a file that has none."""
    found = json.loads(Path(path).read_text(encoding="utf-8"))
    median = found.get("stats", {}).get("median") if isinstance(found, dict) else None
    if not isinstance(median, (int, float)) or isinstance(median, bool):
        raise ValueError(f"{path} has no median")
    return float(median)
