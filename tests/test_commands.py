"""The commands from sources to brief, and the parts that hold no graph."""

import json
import math

import pytest

from tests.graphs import graph, measured
from weftline.commands import benchmark, cli, verify, workload
from weftline.operators import brief, report
from weftline.sources import jsonl
from weftline.sources.store import GraphStore

SOURCES = {
    "src/core.ts": "/** Adds. */\nexport function add(a: number): number { return a; }\nexport function unused(): void {}\nexport function loop(n: number): number { return back(n); }\nexport function back(n: number): number { return loop(add(n)); }\n",
    "src/main.ts": "import { add, loop } from './core';\nexport class App { run(): void { add(1); add(2); loop(1); fetch('https://api.example.com/x'); } }\nnew App().run();\nconst port = process.env.PORT;\n",
}
PROFILE = {
    "nodes": [
        {"id": 1, "callFrame": {"functionName": "(root)", "scriptId": "0", "url": "", "lineNumber": -1, "columnNumber": -1}, "hitCount": 0, "children": [2]},
        {"id": 2, "callFrame": {"functionName": "run", "scriptId": "1", "url": "file://{root}/src/main.ts", "lineNumber": 1, "columnNumber": 0}, "hitCount": 1, "children": [3]},
        {"id": 3, "callFrame": {"functionName": "add", "scriptId": "1", "url": "file://{root}/src/core.ts", "lineNumber": 1, "columnNumber": 0}, "hitCount": 3, "children": []},
    ],
    "startTime": 0, "endTime": 100000, "samples": [2, 3, 3, 3, 1], "timeDeltas": [1000, 2000, 3000, 4000, 5000],
}


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    for name, text in SOURCES.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(text)
    profile = json.dumps(PROFILE).replace("{root}", str(root))
    (root / "run.cpuprofile").write_text(profile)
    (root / "labels.json").write_text('{"0": "The core"}')
    return root


def run(project, capsys, *args):
    code = cli.main([*args, "-o", str(project / "out")])
    said = capsys.readouterr()
    assert code == 0, said.err
    return said.out


def asked(project, capsys, *args):
    return json.loads(run(project, capsys, *args, "--json"))


def test_from_sources_to_brief(project, capsys):
    out = run(project, capsys, "extract", str(project), "--semantic")
    assert "Function" in out and "CALLS" in out
    assert "loaded" in run(project, capsys, "load")
    add = next(r["id"] for r in asked(project, capsys, "find", "add") if r["name"] == "add")
    assert {r["name"] for r in asked(project, capsys, "who-calls", add)} == {"run", "back"}
    loop = next(r["id"] for r in asked(project, capsys, "find", "loop"))
    assert [r["name"] for r in asked(project, capsys, "calls", loop)] == ["back"]
    assert {(r["name"], r["edgeKind"]) for r in asked(project, capsys, "references", loop)} == {("back", "CALLS"), ("run", "CALLS")}
    assert any(r["direction"] == "in" and r["edgeKind"] == "EXPORTS" for r in asked(project, capsys, "neighbors", loop))
    assert {r["name"] for r in asked(project, capsys, "blast-radius", add)} == {"run", "back", "loop", "src/main.ts"}
    assert "unused" in {r["name"] for r in asked(project, capsys, "dead-exports")}
    top = asked(project, capsys, "hotspots", "--by", "callers")
    assert top["metric"] == "callers" and not top["enriched"] and top["hotspots"][0]["score"] == 2
    assert "no runtime data" in run(project, capsys, "hotspots", "--by", "self-time") and "no runtime data" in run(project, capsys, "cost")
    found = asked(project, capsys, "enrich", str(project / "run.cpuprofile"), "--root", str(project))
    assert found["totalSamples"] == 5 and found["matchedSamples"] == 4 and found["nodesEnriched"] == 2 and found["matchedEdges"] == 1
    costs = asked(project, capsys, "cost")
    assert costs["totalSelf"] == 10 and costs["coverage"] == pytest.approx(10000 / 15000) and costs["nodes"][0]["inclusiveCost"] == pytest.approx(10)
    one = asked(project, capsys, "cost", add, "--edges", "runtime")
    assert one["node"]["selfCost"] == 9 and [c["name"] for c in one["callers"]] == ["run"] and "Attributed to callers" in run(project, capsys, "cost", add)
    work = asked(project, capsys, "campaign")["items"]
    assert work[0]["readiness"] == "auto-applicable" and any(x["candidate"] == "hotspot" for x in work)
    groups = asked(project, capsys, "cluster", "--resolution", "0.1")
    assert groups["algorithm"] == "leiden" and groups["nodesAssigned"] == sum(groups["sizes"])
    renamed = asked(project, capsys, "cluster", "rename", "--labels", str(project / "labels.json"))
    assert renamed["changes"][0]["to"] == "The core" and asked(project, capsys, "cluster", "communities")["communities"][0]["currentLabel"] == "The core"
    text = run(project, capsys, "report", "--stdout")
    for heading in ("Key findings", "Snapshot", "Composition", "Load-bearing code", "Communities", "Runtime", "Structure vs. runtime", "Cycles", "System boundary", "Cleanup candidates", "Where to go next"):
        assert f"## {heading}" in text
    assert "2-symbol cycle: `back`, `loop`" in text and "`api.example.com`" in text and "`PORT`" in text and "| `unused` | Function |" in text
    assert "wrote" in run(project, capsys, "report", "--format", "json") and json.loads((project / "out" / "CODEBASE_BRIEF.json").read_text())["totals"]["cycles"] == 1
    run(project, capsys, "report", "--format", "html")
    assert (project / "out" / "CODEBASE_BRIEF.html").read_text().startswith("<!DOCTYPE html>")
    run(project, capsys, "webview")
    assert '"e0"' in (project / "out" / "graph_data.js").read_text()


@pytest.mark.parametrize("args", [("hotspots", "--by", "size"), ("cost", "--by", "callers"), ("cost", "--edges", "both"), ("cluster", "--resolution", "0"), ("cluster", "--resolution", "x"), ("report", "--format", "pdf"), ("campaign", "--by", "x")])
def test_requests_that_are_refused(spark, tmp_path, capsys, args):
    assert cli.main([*args, "-o", str(tmp_path)]) == 1 and capsys.readouterr().err


def test_no_graph_and_bad_labels(spark, tmp_path, capsys):
    assert cli.main(["find", "x", "-o", str(tmp_path)]) == 1 and "extract" in capsys.readouterr().err
    for text in ("no json", "[1]", '{"0": ""}', '{"-1": "x"}', '{"a": "x"}'):
        (tmp_path / "l.json").write_text(text)
        with pytest.raises(cli.Refused):
            cli.read_labels(str(tmp_path / "l.json"))
    with pytest.raises(cli.Refused):
        cli.read_labels(str(tmp_path / "none.json"))


# ---- the brief


def sample(**more):
    symbol = lambda name, line, file="src/a.ts", **x: {"name": name, "kind": "Function", "file_path": file, "start_line": line, **x}
    dead = symbol("unusedThing", 9, "src/b.ts")
    tables = {"node_kinds": [{"kind": "Function", "count": 3}], "edge_kinds": [{"kind": "CALLS", "count": 2}], "callers": [symbol("helper", 3, score=2.0)], "blast": [symbol("helper", 3, score=2.0)], "communities": [], "hotspots": [], "cost": [], "structure": [], "cycles": [], "boundary": [], "dead": [dead]}
    findings = [{"title": "Highest blast radius", "detail": "d", "tone": "risk", "symbols": [symbol("helper", 3)]}, {"title": "Dead code is safe to remove", "detail": "d", "tone": "opportunity", "symbols": [dead]}]
    values = {"generated_at": "2024-01-01", "project": "acme/widget", "limit": 10, "totals": {"symbols": 3, "files": 2, "relationships": 2, "communities": 0, "dead_exports": 1, "cycles": 0}, "verdict": "v", "provenance": {"baseUrl": "https://github.com/acme/widget", "commit": "abcdef1234567890", "prefix": "src/"}, "coverage": None, "enriched": False, "semantic": True, "quality": None, "tables": tables, "findings": findings}
    tables |= more.pop("tables", {})
    return report.Report(**(values | more))


def enriched():
    hot = {"name": "hot", "kind": "Function", "file_path": "src/a.ts", "start_line": 1}
    return sample(enriched=True, coverage=0.63, quality=0.71, tables={"communities": [{"label": "a|b", "size": 3}], "hotspots": [hot | {"score": 50.0}], "cost": [hot | {"self_cost": 50.0, "inclusive_cost": 80.0, "share_of_total": 0.8, "cyclic": True, "component_size": 2}], "structure": [hot | {"role": "hidden hotspot", "rank": 1}]})


def test_markdown_of_a_graph_without_runtime():
    text = brief.markdown(sample())
    assert text.startswith("# Codebase brief — acme/widget") and "**semantic ✓ · enriched —**" in text and "commit `abcdef1`" in text
    assert "Run `enrich` to populate" in text and "## Structure vs. runtime" not in text and "No call cycles detected" in text and "No communities assigned" in text and "No endpoints, configuration flags" in text
    assert "| `unusedThing` | Function | [`src/b.ts:9`](https://github.com/acme/widget/blob/abcdef1234567890/src/src/b.ts#L9) |" in text
    assert "- **Highest blast radius:** [`helper`](https://github.com/acme/widget/blob/abcdef1234567890/src/src/a.ts#L3) — d" in text
    assert "| --- | ---: |" in text and "| --- | ---: | --- |" in text and "| `helper` | 2 |" in text


def test_markdown_without_origin_and_findings():
    text = brief.markdown(sample(provenance=None, findings=[]))
    assert "| `unusedThing` | Function | `src/b.ts:9` |" in text and "github.com" not in text and "_Nothing stands out" in text


def test_markdown_with_runtime():
    text = brief.markdown(enriched())
    assert "runtime coverage 63%" in text and "(quality 0.71)" in text and "| `hot` | 50.0 |" in text and "| `hot` ↺ | 80.0 | 80.0% |" in text and "| --- | ---: | ---: | --- |" in text
    assert "a\\|b" in text and "**Hidden hotspots**" in text and "**Orchestrators** (high inclusive cost, ~0 self: the callees are what to optimise): —" in text


def test_json_and_html_and_links():
    data = json.loads(brief.to_json(enriched()))
    assert data["deadExports"][0]["name"] == "unusedThing" and data["totals"]["deadExports"] == 1 and data["cost"][0]["cycleSize"] == 2 and data["structureVsRuntime"]["hiddenHotspots"][0]["startLine"] == 1
    page = brief.html(enriched())
    assert page.startswith("<!DOCTYPE html>") and page.rstrip().endswith("</html>") and "bar-fill" in page and 'class="finding risk"' in page
    assert "a&lt;b&gt;&amp;&quot;c" in brief.html(sample(project='a<b>&"c')) and "a<b>" not in brief.html(sample(project='a<b>&"c'))
    assert brief.permalink(None, {}) is None


# ---- verify


def test_plan_of_the_checks():
    both = verify.plan({"typecheck": "tsc", "test": "run"})
    assert [c.command for c in both] == ["npm run typecheck", "npm run test"]
    assert [c.skipped_reason for c in verify.plan({"tsc": "x", "test": 3}, typecheck="tsc")] == [None, 'no "test" script in package.json']
    assert [c.skipped_reason for c in verify.plan({"typecheck": "x", "test": "y"}, skip_typecheck=True, skip_tests=True)] == ["skipped by request"] * 2


@pytest.mark.parametrize(
    "codes, scripts, want",
    [
        ([0, 0], {"typecheck": "a", "test": "b"}, (True, True, False, "verified: typecheck + test passed")), ([0, 1], {"typecheck": "a", "test": "b"}, (False, False, False, "FAILED: test")), ([1, None], {"typecheck": "a", "test": "b"}, (False, False, False, "FAILED: typecheck and test")),
        ([0], {"typecheck": "a"}, (True, False, True, "type-check passed, but no")), ([], {}, (False, False, True, "could not verify")),
    ],
)
def test_verdicts(tmp_path, codes, scripts, want):
    (tmp_path / "package.json").write_text(json.dumps({"scripts": scripts}))
    left = list(codes)
    found = verify.verify(str(tmp_path), lambda command, folder: (left.pop(0), "line\n" * 200), tail=5)
    assert (found.ok, found.behavior_verified, found.degraded) == want[:3] and found.summary.startswith(want[3])
    assert all(len(c.output.split("\n")) <= 5 for c in found.checks)


def test_scripts_of_broken_packages(tmp_path, capsys):
    assert verify.scripts_of(str(tmp_path)) == {}
    for text in ("no json", "[]", '{"scripts": 3}'):
        (tmp_path / "package.json").write_text(text)
        assert verify.scripts_of(str(tmp_path)) == {}
    assert verify._run("echo out && exit 3", str(tmp_path)) == (3, "out\n")
    assert cli.main(["verify", "-C", str(tmp_path), "--json"]) == 1 and json.loads(capsys.readouterr().out)["ok"] is False


# ---- workload and benchmark


def test_paths_in_the_container():
    assert workload.in_container("/p", "/p") == "/work" and workload.in_container("/p", "/p/a/b.ts") == "/work/a/b.ts" and workload.driver_path("/p", "/p/d.ts") == "d.ts"
    for f in (workload.in_container, workload.driver_path):
        with pytest.raises(ValueError):
            f("/p", "/q/a.ts")
    assert [len(workload.scaffold_files(k)) for k in ("cpu-profile", "loadtest", "both", "other")] == [2, 2, 3, 1]


def test_benchmark_of_injected_runs(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "store"))
    given = iter([30.0, 10.0, 20.0])

    def profile(_):
        store.write(graph(spark, {"hot": measured(next(given), 4), "caller": {}}, [("caller", "hot")]))

    store.write(graph(spark, {"hot": {}, "caller": {}}, [("caller", "hot")]))
    found = benchmark.measure(store, "hot", profile, runs=3, baseline=25.0)
    assert found["stats"]["median"] == 20 and found["stats"]["spread"] == 20 and found["stats"]["values"] == [30, 10, 20]
    assert found["delta"]["absolute"] == -5 and found["delta"]["percent"] == -0.2 and benchmark.direction(found["delta"], 20) == "unchanged" and "Advisory" in found["advisory"]
    path = str(tmp_path / "bench" / "hot.json")
    benchmark.save_baseline(path, found)
    assert benchmark.read_baseline(path) == 20
    for text in ("[]", "{}", '{"stats": {"median": "x"}}'):
        (tmp_path / "bad.json").write_text(text)
        with pytest.raises(ValueError):
            benchmark.read_baseline(str(tmp_path / "bad.json"))
    with pytest.raises(LookupError):
        benchmark.measure(store, "nothing", profile)
    with pytest.raises(ValueError):
        benchmark.measure(store, "hot", profile, "callers")
    assert math.isnan(benchmark.change(0, 3)["percent"]) and benchmark.signed_percent(float("nan")) == "n/a" and benchmark.signed_percent(-0.38) == "-38.0%" and benchmark.signed_percent(0.5) == "+50.0%"
    assert [benchmark.direction({"absolute": a}, 1) for a in (-5, 5, 0.5)] == ["improved", "regressed", "unchanged"]


# ---- JSON lines keep what they are given


def test_round_trip_of_odd_metadata(spark, tmp_path):
    odd = '{"z":1,"a":{"y":"quote \\" and \\\\ and ünï","b":[1,2]},"n":null}'
    g = graph(spark, {'a "b"\\': {"file": "src/ä b.ts", "exported": True, "line": 3, "end": 9}, "bare": {"line": 0}}, [('a "b"\\', "bare", "CALLS")])
    g = type(g)(g.nodes.withColumn("metadata", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(odd)), g.edges, g.meta)
    source = {"baseUrl": "https://github.com/a/b", "commit": "c" * 40, "prefix": ""}
    jsonl.write(g, str(tmp_path / "g"), source)
    nodes, edges, found = jsonl.read(spark, str(tmp_path / "g"))
    assert found == source and sorted(r["metadata"] for r in nodes.collect()) == [odd, odd]
    assert {(r["id"], r["file_path"], r["exported"], r["start_line"], r["end_line"]) for r in nodes.collect()} == {('a "b"\\', "src/ä b.ts", True, 3, 9), ("bare", "src/a.ts", False, 0, 0)}
    assert [(r["src"], r["dst"], r["metadata"]) for r in edges.collect()] == [('a "b"\\', "bare", "{}")]
    jsonl.write(g, str(tmp_path / "g"))
    assert jsonl.read(spark, str(tmp_path / "g"))[2] is None
