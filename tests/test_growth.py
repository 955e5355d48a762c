"""Work that must not grow faster than the tables: what isn't shuffled, built or sorted."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tests.graphs import graph, measured
from weftline.extract import build
from weftline.operators import connectivity, cost, hotspots, report
from weftline.plans import catalog, settle
from weftline.plans import projection as P
from weftline.sources import store


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder, day = str(tmp_path_factory.mktemp("supply")), datetime.date(1995, 1, 1)
    known = {
        "region": ([(0, "R")], "r_regionkey bigint, r_name string"), "nation": ([(0, "N", 0)], "n_nationkey bigint, n_name string, n_regionkey bigint"),
        "customer": ([(k, f"c{k}", 0, 1.0) for k in range(5)], "c_custkey bigint, c_name string, c_nationkey bigint, c_acctbal double"),
        "supplier": ([(k, f"s{k}", 0, 1.0) for k in range(7)], "s_suppkey bigint, s_name string, s_nationkey bigint, s_acctbal double"),
        "part": ([(k, f"p{k}", "b", 2) for k in range(9)], "p_partkey bigint, p_name string, p_brand string, p_size int"),
        "orders": ([(k, k % 5, day, 1.0) for k in range(20)], "o_orderkey bigint, o_custkey bigint, o_orderdate date, o_totalprice double"),
        "lineitem": ([(k % 20, k % 9, k % 7, 10.0 + k) for k in range(80)], "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_extendedprice double"),
    }
    for t in P.TABLES:
        rows, schema = known.get(t, ([(0,)], "unused int"))
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{t}.parquet")
    return folder


def test_totals_need_no_call(spark, tables, monkeypatch):
    monkeypatch.setattr(cost, "cost_model", lambda *a, **k: pytest.fail("a sum over nodes built the model of all calls"))
    assert tuple(catalog.cost_totals(spark, tables).first()) == (sum(10.0 + k for k in range(80)), 9)


def test_coverage_writes_no_graph(spark, tables, monkeypatch):
    monkeypatch.setattr(P, "stored", lambda *a: pytest.fail("the manifest needs no edges"))
    assert {tuple(r) for r in catalog.coverage(spark, tables).collect()} == {("self-time", 0.75), ("samples", 0.8)}


def test_a_kept_graph_isnt_sorted_by_kind(spark, tables, monkeypatch):
    folders = []
    monkeypatch.setattr(P, "stored", lambda df, *by: folders.append(by) or settle.stored(df, *by))
    kept = P.supply(spark, tables, keep=True)
    assert folders == [(), ()] and kept.settled
    assert sorted(map(tuple, kept.edges.collect())) == sorted(map(tuple, P.supply(spark, tables).edges.collect()))


def test_ends_that_are_known_move_no_edge(spark):
    g = graph(spark, {c: {} for c in "abc"}, [("a", "b"), ("b", "c")])
    assert "Join" not in plan(connectivity.call_pairs(g))
    assert "Join" not in plan(cost.cost_model(g)[0].edges)


@pytest.mark.parametrize("most", [0, 8_000_000])
def test_unknown_and_null_ends(spark, monkeypatch, most):
    monkeypatch.setattr(store, "BROADCAST_BYTES", most)
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    edges = settle.stored(spark.createDataFrame([("a", "b"), ("x", "b"), ("a", "y"), (None, "b"), ("c", None), ("b", "c")], "src string, dst string"))
    rows = lambda *ends: {tuple(r) for r in store.known_ends(edges, ids, *ends).collect()}
    assert rows("src", "dst") == {("a", "b"), ("b", "c")}
    assert rows("src") == {("a", "b"), ("a", "y"), ("c", None), ("b", "c")}


def test_totals_of_a_graph_with_loose_ends(spark):
    g = graph(spark, {"a": {"exported": True}, "b": {"exported": True}, "c": {}}, [("a", "b"), ("b", "a"), ("c", "gone"), ("gone", "c"), ("c", "c")])
    row = report.totals(g).first()
    assert (row["symbols"], row["relationships"], row["cycles"], row["dead_exports"]) == (3, 3, 1, 0)
    assert [r["members"] for r in connectivity.call_cycles(g).collect()] == [["a", "b"]]
    assert hotspots.dead_exports(g).count() == 0


def test_a_large_component_needs_no_colours(spark, monkeypatch):
    monkeypatch.setattr(connectivity, "_coloured", lambda edges: pytest.fail("the one large component was coloured"))
    ring = [(f"n{k}", f"n{(k + 1) % 40}") for k in range(40)] + [("n3", "out"), ("in", "n5"), ("n7", "n30")]
    df = settle.stored(spark.createDataFrame(ring, "src string, dst string"))
    got = {r["id"]: r["component"] for r in connectivity.strong_components(df, trims=0, most_pairs=10).collect()}
    assert got == {f"n{k}": "n0" for k in range(40)} | {"out": "out", "in": "in"}


def test_spread_over_blocks_and_rounds(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(75)]
    df = settle.stored(spark.createDataFrame(pairs, "a bigint, b bigint").repartition(5))
    want, now = {0}, {0}
    while now := {b for a, b in pairs if a in now} - want:
        want |= now
    assert {i for i, x in enumerate(connectivity._spread(df, 60, 0, "a", "b")) if x} == want


def test_costs_of_a_deep_graph_without_cycles(spark):
    depth = cost.PEELED + 4
    nodes = {f"n{k}": measured(1.0) for k in range(depth)} | {"idle": measured(2.0)}
    edges = [(f"n{k}", f"n{k + 1}", "CALLS", {"count": 3}) for k in range(depth - 1)] + [(f"n{k}", f"n{k + 2}") for k in range(depth - 2)] + [("n0", "gone")]
    got = {r["id"]: r["inclusive"] for r in cost.cost_model(graph(spark, nodes, edges))[0].nodes.collect()}
    want = {"idle": 2.0}
    for k in reversed(range(depth)):
        want[f"n{k}"] = 1.0 + (want[f"n{k + 1}"] * (3 / 4 if k else 1.0) if k + 1 < depth else 0) + (want[f"n{k + 2}"] / 4 if k + 2 < depth else 0)
    assert got == pytest.approx(want)


def test_short_files_are_spread_and_nodes_need_no_uses(spark, monkeypatch):
    files = spark.createDataFrame([(f"src/f{k}.ts", f"export function f{k}() {{ return process.env.K{k % 3}; }}\n") for k in range(40)], "path string, text string").coalesce(1)
    found = build.read_facts(files)
    assert found.rdd.getNumPartitions() >= 4 and found.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    monkeypatch.setattr(build, "_ROWS", 7)
    assert sorted(map(str, build.read_facts(files).collect())) == sorted(map(str, found.collect()))
    whole = build.build(files, semantic=True)
    assert sorted(map(str, build.build_edges(files, semantic=True).collect())) == sorted(map(str, whole.edges.collect()))
    monkeypatch.setattr(build, "Names", lambda *a: pytest.fail("nodes without routes were given meanings of names"))
    assert sorted(map(str, build.build_nodes(files, semantic=True).collect())) == sorted(map(str, whole.nodes.collect()))
