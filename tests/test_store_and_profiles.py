import json

import pytest

from tests.graphs import graph
from weftline.operators import bench, cluster, onehop, report, runtime
from weftline.plans.model import EDGE_SCHEMA, NODE_SCHEMA
from weftline.sources import jsonl, profiles, store


def lines(path, rows):
    path.write_text("\n".join(json.dumps(r) if not isinstance(r, str) else r for r in rows) + "\n")


NODES = [
    {"id": "Function:a", "kind": "Function", "name": "a", "filePath": "src/a.ts", "range": {"startLine": 3, "startColumn": 1, "endLine": 8, "endColumn": 2}, "exported": True, "metadata": {"z": 1, "a": {"k": [1]}}},
    "",
    {"id": "Module:src/a.ts", "kind": "Module", "name": "src/a.ts", "filePath": "src/a.ts"},
]
EDGES = [
    {"id": "e1", "kind": "CONTAINS", "from": "Module:src/a.ts", "to": "Function:a", "metadata": {"count": 3}},
    {"id": "e1", "kind": "CONTAINS", "from": "Module:src/a.ts", "to": "Function:a", "metadata": {"count": 4}},
    {"id": "e2", "kind": "CALLS", "from": "Function:a", "to": "gone"},
]


def test_jsonl_and_store(spark, tmp_path):
    lines(tmp_path / "nodes.jsonl", NODES)
    lines(tmp_path / "edges.jsonl", EDGES)
    (tmp_path / "source.json").write_text('{"baseUrl": "https://x.example/o/r", "commit": "c", "prefix": ""}')
    nodes, edges, source = jsonl.read(spark, str(tmp_path))
    assert source["commit"] == "c"
    kept = store.GraphStore(spark, f"file://{tmp_path}/store")
    assert kept.load(nodes, edges, source) == {"nodes": 2, "edges": 2}
    g = kept.read()
    assert json.loads(g.nodes.where("id = 'Function:a'").first()["metadata"]) == {"z": 1, "a": {"k": [1]}}
    assert [(r["kind"], json.loads(r["metadata"])) for r in g.edges.collect()] == [("CONTAINS", {"count": 4})]
    assert kept.load(nodes, edges) == {"nodes": 2, "edges": 2} and kept.read().nodes.count() == 2
    assert store.get_meta(kept.read().meta, "source") is None
    assert kept.query("SELECT count(*) AS n FROM {nodes} WHERE kind = :kind", kind="Module").first()["n"] == 1
    jsonl.write(kept.read(), f"{tmp_path}/out")
    again, _, none = jsonl.read(spark, f"{tmp_path}/out")
    assert again.count() == 2 and none is None
    assert "</" not in jsonl.viewer_script(kept.read()) and '"e0"' in jsonl.viewer_script(kept.read())


@pytest.mark.parametrize("bad", ["{oops", '{"id": "x", "kind": "Planet", "name": "n", "filePath": "f"}', '{"id": "x", "kind": "Class", "filePath": "f"}'])
def test_bad_lines_raise(spark, tmp_path, bad):
    lines(tmp_path / "nodes.jsonl", [bad])
    lines(tmp_path / "edges.jsonl", EDGES[:1])
    with pytest.raises(ValueError):
        jsonl.read(spark, str(tmp_path))


def test_counting_keeps_the_first_and_merging_the_last(spark):
    raw = spark.createDataFrame([(1, "a", "b", "CALLS", "first"), (2, "a", "b", "CALLS", "last"), (3, "a", "b", "READS", "x")], EDGE_SCHEMA)
    got = {r["kind"]: (r["metadata"], r["count"]) for r in store.count_edges(raw).collect()}
    assert got == {"CALLS": ("first", 2), "READS": ("x", 1)}
    ids = spark.createDataFrame([("a",), ("b",)], "id string")
    merged = store.upsert_edges(spark.createDataFrame([], EDGE_SCHEMA), raw, ids)
    assert {r["kind"]: r["metadata"] for r in merged.collect()} == {"CALLS": "last", "READS": "x"}
    assert store.delete_edges(raw, "CALLS").count() == 1


def frame(i, name, url="", line=-1, hits=0, children=()):
    return {"id": i, "callFrame": {"functionName": name, "scriptId": "1", "url": url, "lineNumber": line, "columnNumber": 0}, "hitCount": hits, "children": list(children)}


def test_enrich_flat_profile(spark, tmp_path):
    (tmp_path / "p.cpuprofile").write_text(json.dumps({"nodes": [frame(1, "(root)", children=[2, 3, 4]), frame(2, "hot", "file:///r/src/a.ts", 4), frame(3, "processTimers", "node:internal", 1), frame(4, "cold", "file:///r/src/a.ts", 11)], "samples": [2, 2, 2, 4, 3, 3], "timeDeltas": [100] * 6}))
    nodes = {"hot": {"line": 3, "end": 8, "meta": {"owner": "me"}}, "cold": {"line": 10, "end": 14}, "mod": {"kind": "Module", "line": 0}}
    g = graph(spark, nodes, [("hot", "cold", "CALLS_RUNTIME", {"samples": 9})])
    for _ in range(2):
        done = runtime.enrich(g, profiles.read(spark, str(tmp_path / "p.cpuprofile")), "p", "/r")
        got = {r["id"]: json.loads(r["metadata"]) for r in done.graph.nodes.collect()}
        assert got["hot"] == {"owner": "me", "runtime": {"source": "p", "samples": 3, "selfMicros": 300.0, "selfMs": 0.3}}
        assert got["cold"]["runtime"]["selfMs"] == 0.1 and got["mod"] == {}
        assert done.totals == {"totalSamples": 6, "matchedSamples": 4, "totalSelfMicros": 600.0, "matchedSelfMicros": 400.0, "matchedEdges": 0}
        assert [(r["reason"], r["samples"]) for r in done.dropped.collect()] == [("no-file", 2)]
        assert done.graph.edges.count() == 0
        g = done.graph
    with pytest.raises(ValueError):
        (tmp_path / "no.json").write_text('{"a": 1}')
        profiles.read(spark, str(tmp_path / "no.json"))


def test_nested_profile_by_hits(spark, tmp_path):
    u = "file:///r/src/a.ts"
    (tmp_path / "p").write_text(json.dumps({"nodes": [frame(1, "(root)", children=[2]), frame(2, "main", u, 0, 0, [3]), frame(3, "hot", u, 3, 3, [4]), frame(4, "cold", u, 10, 2)]}))
    g = graph(spark, {"main": {"line": 1, "end": 2}, "hot": {"line": 3, "end": 8}, "cold": {"line": 10, "end": 14}}, [])
    nodes, _, tree = profiles.parts(profiles.read(spark, str(tmp_path / "p")))
    below = {r["node"]: r["subtree"] for r in runtime.subtree_samples(tree, nodes.selectExpr("node", "hit_count AS samples")).collect()}
    assert below == {1: 5, 2: 5, 3: 5, 4: 2}
    done = runtime.enrich(g, profiles.read(spark, str(tmp_path / "p")), "p", "/r")
    assert {(r["src"], r["dst"]): r["samples"] for r in done.calls.collect()} == {("main", "hot"): 5, ("hot", "cold"): 2}
    assert done.totals["matchedEdges"] == 2


def test_frames_resolve(spark):
    nodes = {"render": {"kind": "Method", "line": 5, "end": 9}, "dup1": {"name": "dup", "line": 2, "end": 4}, "dup2": {"name": "dup", "line": 10, "end": 14}, "around": {"line": 12, "end": 20, "name": "other"}}
    g = graph(spark, nodes, [])
    rows = [(1, "Widget.render", "src/a.ts", 1), (2, "(anonymous)", "src/a.ts", 15), (3, "dup", "src/a.ts", 1), (4, "dup", "src/a.ts", 10), (5, "(root)", None, 0), (6, "nobody", "src/a.ts", 99), (7, "(anonymous)", "src/a.ts", 13)]
    found = runtime.resolve_frames(spark.createDataFrame(rows, "frame bigint, function_name string, file_path string, line bigint"), g.nodes)
    got = {r["frame"]: (r["id"], r["via"]) for r in found.collect()}
    assert got == {1: ("render", "name"), 2: ("around", "range"), 3: (None, "ambiguous"), 4: ("dup2", "name"), 5: (None, "no-file"), 6: (None, "no-node"), 7: ("dup2", "range")}


def test_communities(spark):
    clique = lambda p: [(f"{p}{i}", f"{p}{j}", 3.0) for i in range(4) for j in range(i)]
    ties = spark.createDataFrame(clique("a") + clique("b") + [("a0", "b0", 3.0)], "src string, dst string, weight double")
    part = {r["id"]: r["community"] for r in cluster.detect(ties, 1.0).collect()}
    assert len(set(part.values())) == 2 and len({part[f"a{i}"] for i in range(4)}) == 1 and part["a0"] != part["b0"]
    given = spark.createDataFrame(list(part.items()), "id string, community int")
    assert cluster.cpm_quality(ties, given, 1.0).first()[0] == pytest.approx((2 * 36 - 32) / (2 * 39))
    assert cluster.detect(ties.limit(0)).count() == 0
    lonely = spark.createDataFrame([("x", "x", 1.0), ("y", "z", 2.0)], "src string, dst string, weight double")
    assert cluster.detect(lonely).count() == 3
    with pytest.raises(ValueError):
        cluster.detect(ties, 0)


def test_labels(spark):
    nodes = {"Detector": {"file": "src/cluster/d.ts"}, "p": {"file": "src/cluster/e.ts"}, "q": {"file": "src/cluster/f.ts"}, "one": {"file": "src/solo.ts"}, "two": {"file": "src/solo.ts"}}
    g = graph(spark, nodes, [])
    part = spark.createDataFrame([("Detector", 0), ("p", 0), ("q", 0), ("one", 1), ("two", 1)], "id string, community int")
    ties = spark.createDataFrame([("Detector", "p", 3.0), ("Detector", "q", 3.0), ("p", "one", 99.0)], "src string, dst string, weight double")
    assert {r["community"]: r["label"] for r in cluster.raw_labels(g.nodes, part, ties).collect()} == {0: "cluster · Detector", 1: "solo"}
    same = spark.createDataFrame([(0, "Foo", "index"), (1, "Bar", "index"), (2, "h", "h"), (3, "h", "h")], "community int, hub string, label string")
    assert {r["community"]: r["label"] for r in cluster.distinct_labels(same).collect()} == {0: "index · Foo", 1: "index · Bar", 2: "h #2", 3: "h #3"}


def test_cluster_rename_report(spark):
    nodes = {n: {"exported": n == "dead", "file": f} for n, f in (("a", "src/a.ts"), ("b", "src/a.ts"), ("c", "src/b.ts"), ("x", "src/c.ts"), ("y", "src/c.ts"), ("dead", "src/b.ts"))}
    g = cluster.cluster(graph(spark, nodes, [("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")]))
    assert report.communities(g).count() >= 2 and store.get_meta(g.meta, "clustering")["algorithm"] == "leiden"
    renamed, changes, unknown = cluster.rename(g, {0: "core", 9: "none"})
    assert changes.count() == 1 and [r["community"] for r in unknown.collect()] == [9]
    assert store.get_meta(renamed.meta, "clustering")["labels"][0] == "core"
    data = report.gather(g, "2026-01-01", "demo")
    assert data.totals["symbols"] == 6 and data.totals["files"] == 3 and data.totals["cycles"] == 1 and data.totals["dead_exports"] == 1
    assert [f["title"] for f in data.findings] == ["Highest blast radius", "Dead code is safe to remove"]
    assert "6 symbols across 3 files" in data.verdict


def test_statistics(spark):
    from pyspark.sql import functions as F

    row = bench.stats(spark.createDataFrame([(v,) for v in (9, 13, 11, 10, 12)], "v int"), "v").first()
    assert (row["median"], row["min"], row["max"], row["mean"], row["spread"]) == (11, 9, 13, 11, 4)
    assert bench.stats(spark.createDataFrame([(v,) for v in (10, 20, 30, 40)], "v int"), "v").first()["median"] == 25
    change, percent = bench.delta(F.lit(20.0), F.lit(12.4))
    zero = bench.delta(F.lit(0.0), F.lit(1.0))[1]
    r = spark.range(1).select(change.alias("c"), percent.alias("p"), zero.alias("z"), bench.direction(F.lit(-3.0), F.lit(4.0)).alias("d")).first()
    assert r["c"] == pytest.approx(-7.6) and r["p"] == pytest.approx(-0.38) and r["z"] != r["z"] and r["d"] == "unchanged"
    steps = spark.createDataFrame([(10, 9.5, True), (20, 19.0, True), (30, 22.0, False), (40, 21.0, False)], "target int, achieved double, ok boolean")
    assert tuple(bench.capacity(steps).first()) == (19.0, 30)


def test_kinds_are_complete():
    from weftline.plans.model import EDGE_KINDS, NODE_KINDS, TIE_WEIGHTS, USE_KINDS

    assert len(NODE_KINDS) == 14 and len(EDGE_KINDS) == 17 and set(USE_KINDS) | set(TIE_WEIGHTS) <= set(EDGE_KINDS) and NODE_SCHEMA


def test_a_store_from_nothing(spark, tmp_path):
    kept = store.GraphStore(spark, str(tmp_path / "s"))
    assert kept.init().nodes.count() == 0
    kept.write(graph(spark, {"a": {}, "b": {}}, [("a", "b")]))
    assert kept.init().nodes.count() == 2
    more = spark.createDataFrame([(9, "b", "a", "READS", "{}"), (9, "a", "b", "CALLS", '{"count":2}'), (9, "a", "gone", "CALLS", "{}")], EDGE_SCHEMA)
    got = kept.append_edges(more)
    assert {(r["src"], r["dst"], r["kind"], r["metadata"]) for r in got.edges.collect()} == {("b", "a", "READS", "{}"), ("a", "b", "CALLS", '{"count":2}')}
    changed = store.set_metadata(got.nodes, spark.createDataFrame([("a", '{"x":1}')], "id string, metadata string"))
    assert {r["id"]: r["metadata"] for r in changed.collect()} == {"a": '{"x":1}', "b": "{}"}


def test_what_the_viewer_hides(spark):
    g = graph(spark, {"a": {"meta": {"community": 1, "runtime": {"selfMs": 2}}}, "b": {"meta": {"community": 2}}, "c": {}}, [("a", "b"), ("b", "c", "CALLS", {"count": 4})])
    names = lambda **how: sorted(r["id"] for r in onehop.visible(g, **how).nodes.collect())
    assert names(hide_communities=(1,)) == ["b", "c"] and names(measured_only=True) == ["a"] and names(hide_communities=(2,), hide_isolated=True) == []
    assert [(r["id"], r["direction"], r["count"]) for r in onehop.detail(g, "b").collect()] == [("c", "out", 4.0), ("a", "in", 1.0)]
