import math

import pytest

from tests.graphs import graph, ids, measured
from weftline.operators import connectivity, cost, hotspots, onehop
from weftline.plans.model import Graph
from weftline.sources import store


@pytest.fixture(scope="module")
def busy(spark):
    nodes = {n: {"line": k + 1} for k, n in enumerate(["entry", "hot", "warm", "cold", "util", "loop", "helper"])}
    for n, (ms, s) in {"hot": (100, 200), "warm": (40, 20), "cold": (10, 5), "util": (5, 80), "loop": (2, 3)}.items():
        nodes[n] |= measured(ms, s)
    edges = [("entry", "hot"), ("hot", "warm"), ("warm", "cold"), ("entry", "util"), ("hot", "util"), ("warm", "util"), ("entry", "loop", "CALLS", {"count": 30}), ("entry", "helper"), ("hot", "helper"), ("warm", "helper"), ("cold", "helper")]
    return graph(spark, nodes, edges)


@pytest.mark.parametrize(
    ("by", "order"),
    [
        ("self-time", "hot warm cold util loop"), ("samples", "hot util warm cold loop"), ("callers", "helper util hot warm cold loop"),
        ("call-count", "loop helper util hot warm cold"), ("blast-radius", "helper cold util warm hot loop"),
    ],
)
def test_hotspots_order(busy, by, order):
    assert ids(hotspots.hotspots(busy, by).df) == order.split()


def test_hotspots_defaults(busy, spark):
    assert hotspots.hotspots(busy).metric == "self-time"
    assert ids(hotspots.hotspots(busy, "callers", measured_only=True).df) == "util hot warm cold loop".split()
    bare = Graph(busy.nodes.selectExpr("seq", "id", "kind", "name", "file_path", "exported", "start_line", "end_line", "'{}' AS metadata"), busy.edges, busy.meta)
    found = hotspots.hotspots(bare, "self-time")
    assert (found.metric, found.requested, found.fell_back, found.df.count()) == ("callers", "self-time", True, 6)
    with pytest.raises(ValueError):
        hotspots.hotspots(busy, "size")


def test_limits():
    assert [cost.clamp_limit(x) for x in (None, 0, math.nan, 7.9, 5000)] == [20, 20, 20, 7, 1000]
    assert [connectivity.clamp_depth(x) for x in (None, math.inf, 0, 2.7, 99)] == [5, 5, 1, 2, 30]
    assert [hotspots._clamp(x, 0, 1000) for x in (math.nan, -3, 2000, 4.5)] == [0, 0, 1000, 4]


def test_blast_radius(spark):
    g = graph(spark, dict.fromkeys("abcd", {}) | {"leaf": {}}, [("a", "b"), ("b", "c"), ("c", "leaf")])
    assert sorted(ids(connectivity.blast_radius(g, "leaf", 50))) == ["a", "b", "c"]
    assert ids(connectivity.blast_radius(g, "leaf", 1)) == ["c"]
    loop = graph(spark, dict.fromkeys("ab", {}), [("a", "b"), ("b", "a")])
    assert sorted(ids(connectivity.blast_radius(loop, "a", 5))) == ["a", "b"]
    counts = {r["id"]: r["blast"] for r in connectivity.ancestor_counts(loop).collect()}
    assert counts == {"a": 1, "b": 1}


def inclusive(g, **how):
    model, _, fell = cost.cost_model(g, **how)
    return {r["id"]: r["inclusive"] for r in model.nodes.collect()}, model, fell


def test_cost_diamond(spark):
    g = graph(spark, {"a": {}, "b": {}, "c": {}, "d": measured(10)}, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")])
    assert inclusive(g)[0] == {"a": 10, "b": 5, "c": 5, "d": 10}
    ranked = cost.cost_ranking(g)
    assert ids(ranked) == ["a", "d", "b", "c"] and ranked.first()["share_of_total"] == 1
    parts = cost.cost_attribution(g, "a")
    assert [(r["id"], r["amount"]) for r in parts["callees"].collect()] == [("b", 5), ("c", 5)] and parts["callers"].count() == 0
    assert cost.cost_attribution(g, "nobody")["node"].count() == 0


def test_cost_weights_and_cycles(spark):
    g = graph(spark, {"x": {}, "y": {}, "z": measured(8)}, [("x", "z", "CALLS", {"count": 3}), ("y", "z", "CALLS", {"count": 1})])
    assert inclusive(g)[0] == {"x": 6, "y": 2, "z": 8}
    callers = cost.cost_attribution(g, "z")["callers"].collect()
    assert [(r["id"], r["share"], r["amount"]) for r in callers] == [("x", 0.75, 6), ("y", 0.25, 2)]
    g = graph(spark, {"a": measured(4), "b": measured(6), "c": {}}, [("a", "b"), ("b", "a"), ("c", "a")])
    costs, model, _ = inclusive(g)
    assert costs == {"a": 10, "b": 10, "c": 10}
    assert {r["id"]: r["size"] for r in model.nodes.collect()} == {"a": 2, "b": 2, "c": 1}


def test_cost_flow_and_coverage(spark):
    edges = [("r1", "r3"), ("r2", "r3")]
    nodes = {"r1": {}, "r2": {}, "r3": measured(8)}
    g = graph(spark, nodes, edges + [("r1", "r3", "CALLS_RUNTIME", {"samples": 3}), ("r2", "r3", "CALLS_RUNTIME", {"samples": 1})])
    assert inclusive(g)[0] == {"r1": 4, "r2": 4, "r3": 8}
    assert inclusive(g, flow="runtime")[0] == {"r1": 6, "r2": 2, "r3": 8}
    assert inclusive(graph(spark, nodes, edges), flow="runtime")[2] is True
    meta = store.put_meta(g.meta, "runtime", {"source": "s", "totalSamples": 100, "matchedSamples": 80, "totalSelfMicros": 20000, "matchedSelfMicros": 15000})
    full = Graph(g.nodes, g.edges, meta)
    assert cost.coverage(full, "samples").first()[0] == 0.8 and cost.coverage(full).first()[0] == 0.75
    assert cost.coverage(g).first()[0] is None
    assert cost.coverage(Graph(g.nodes, g.edges, store.put_meta(g.meta, "runtime", {"source": 1}))).first()[0] is None


def test_deep_chain_is_solved_by_doubling(spark):
    n = 20
    nodes = {f"n{k:02}": {} for k in range(n)}
    nodes["n19"] = measured(7)
    g = graph(spark, nodes, [(f"n{k:02}", f"n{k + 1:02}") for k in range(n - 1)])
    assert set(inclusive(g)[0].values()) == {7.0}


def test_campaign(spark):
    nodes = {"root": {}, "mid": measured(50), "deep": measured(100), "orphanOne": {"exported": True}, "orphanTwo": {"exported": True}}
    g = graph(spark, nodes, [("root", "mid"), ("mid", "deep")])
    rows = hotspots.campaign(g, max_blast=1).collect()
    assert [(r["id"], r["readiness"], r["blast"]) for r in rows] == [("orphanOne", "auto-applicable", 0), ("orphanTwo", "auto-applicable", 0), ("mid", "needs-workload", 1), ("deep", "manual", 2)]
    assert ids(hotspots.campaign(g, max_blast=5)) == ["orphanOne", "orphanTwo", "deep", "mid"]
    assert ids(hotspots.campaign(g, limit=3)) == ["orphanOne", "orphanTwo", "deep"]


def test_dead_exports(spark):
    exported = {"exported": True}
    g = graph(
        spark, {"reader": {}, "overrider": {}, "writer": {}, "target": exported, "writeOnly": exported, "module": {}, "recursive": exported, "holder": exported, "inner": {}, "page": exported | {"file": "app/page.tsx"}},
        [("reader", "target", "READS"), ("overrider", "target", "OVERRIDES"), ("writer", "writeOnly", "WRITES"), ("module", "target", "EXPORTS"), ("recursive", "recursive"), ("holder", "inner", "CONTAINS"), ("reader", "inner", "CALLS")],
    )
    assert ids(hotspots.dead_exports(g)) == ["writeOnly"]
    assert [(r["edge_kind"], r["id"]) for r in onehop.references(g, "target").collect()] == [("OVERRIDES", "overrider"), ("READS", "reader")]


def test_entry_points(spark):
    from pyspark.sql import functions as F

    yes = ["app/page.tsx", "src/app/blog/layout.ts", "pages/x/route.js", "middleware.ts", "src/instrumentation.js", "next.config.mjs", "apps/web/tailwind.config.ts", "e2e/global-setup.ts", "playwright.config.ts", "app\\not-found.jsx"]
    no = ["src/page.tsx", "app/Page.tsx", "app/page.test.tsx", "app/page.css", "lib/middleware.ts", "app.config.ts", "app/button.tsx", "myapp/page.tsx", "src/next.config.json", "", "page"]
    got = spark.createDataFrame([(p,) for p in yes + no], "p string").select("p", hotspots.entry_point(F.col("p")).alias("e")).collect()
    assert [r["p"] for r in got if r["e"]] == yes


def test_find_and_resolve(spark):
    nodes = {"m": {"kind": "Module", "name": "alpha"}, "f1": {"name": "Alpha_one"}, "f2": {"name": "alphaXtwo"}, "c": {"kind": "Class", "name": "beta"}}
    g = graph(spark, nodes, [("f1", "f1"), ("f1", "c", "READS")])
    assert ids(onehop.find(g, "ALPHA")) == ["f1", "f2"] and ids(onehop.find(g, "alpha_")) == ["f1"] and ids(onehop.find(g, "class")) == ["c"]
    assert onehop.find(g, "").count() == 3
    assert onehop.resolve(g, "beta") == "c"
    with pytest.raises(LookupError):
        onehop.resolve(g, "alpha")
    assert sorted((r["id"], r["direction"]) for r in onehop.neighborhood(g, "f1").collect()) == [("c", "out"), ("f1", "in"), ("f1", "out")]
    assert onehop.search(g, "a").count() == 0 and onehop.search(g, "al").count() == 3
    assert ids(onehop.visible(g, hide_edges=("CALLS",), hide_isolated=True).nodes.orderBy("id")) == ["c", "f1"]


def test_random_graphs_against_a_plain_model(spark):
    import random

    rng = random.Random(5)
    names = [f"v{k:02}" for k in range(24)]
    pairs = sorted({(rng.choice(names), rng.choice(names)) for _ in range(40)})
    g = graph(spark, {n: {} for n in names}, pairs)
    up = {n: {a for a, b in pairs if b == n} for n in names}
    reach = {}
    for n in names:
        seen, todo = set(), list(up[n])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += up[x]
        reach[n] = seen
    counts = {r["id"]: r["blast"] for r in connectivity.ancestor_counts(g).collect()}
    assert counts == {n: len(s - {n}) for n, s in reach.items() if s - {n}}
    found = {r["id"]: r["component"] for r in connectivity.strong_components(connectivity.call_pairs(g)).collect()}
    for n, c in found.items():
        assert c == min([n, *(m for m in reach[n] if n in reach[m])])
    weak = {r["id"]: r["root"] for r in connectivity.weak_components(g.edges.select("src", "dst")).collect()}
    for a, b in pairs:
        assert weak[a] == weak[b] <= min(a, b)
