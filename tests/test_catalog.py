"""Registered queries on small tables, against plain Python."""

import datetime
import json
import random

import pytest

from weftline.plans import catalog
from weftline.plans import projection as P
from weftline.sources import store


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """(folder, orders, lines, events): 700 orders of 40 customers, lines among which
    some are of no known order or part, and events that come late."""
    folder, rng = str(tmp_path_factory.mktemp("tables")), random.Random(4)
    day = lambda: datetime.date(1995, 1, 1) + datetime.timedelta(rng.randrange(2000))
    orders = [(k, rng.randrange(40), day(), round(rng.uniform(10, 99), 2)) for k in range(700)]
    lines = [(rng.randrange(720), rng.randrange(620), rng.randint(1, 3), rng.choice("RAN")) for _ in range(3000)]
    events = [(k, rng.randrange(300 if k < 600 else 200), rng.choice(["view", "buy"])) for k in range(1200)]
    known = {
        "orders": (orders, "o_orderkey bigint, o_custkey bigint, o_orderdate date, o_totalprice double"),
        "lineitem": (lines, "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_returnflag string"),
        "part": ([(k,) for k in range(600)], "p_partkey bigint"),
        "customer": ([(k, f"c{k}", k % 3) for k in range(40)], "c_custkey bigint, c_name string, c_nationkey bigint"),
        "events": (events, "event_id bigint, user_id bigint, event_type string"),
    }
    for t in P.TABLES:
        rows, schema = known.get(t, ([(0,)], "unused int"))
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{t}.parquet")
    return folder, orders, lines, events


def edges_of(lines):
    return [(f"O{o}", f"P{p}", "READS" if flag == "R" else "CALLS", o * 10 + n, {"line": n, "key": o}) for o, p, n, flag in lines]


def test_edges_of_all_orders_and_parts(spark, tables, monkeypatch):
    folder, orders, lines, _ = tables
    sides = []
    upsert = store.upsert_edges
    monkeypatch.setattr(store, "upsert_edges", lambda old, new, ids: sides.extend([old, new]) or upsert(old, new, ids))
    held = [e for e, (o, p, *_) in zip(edges_of(lines), lines) if o < 700 and p < 600]
    got = [tuple(r) for r in catalog.edge_upsert(spark, folder).collect()]
    assert len(got) == len(set(got)) and set(got) == {e[:3] for e in held}
    old, new = ({(r["src"], r["dst"], r["kind"]) for r in side.collect()} for side in sides)
    assert old - new and new - old and old & new
    counts = catalog.dangling_edges(spark, folder).first()
    assert tuple(counts) == (700 + 600, len(held)) and len(held) < len(lines)


def test_edge_counts_of_all_orders_and_parts(spark, tables):
    folder, _, lines, _ = tables
    want = {}
    for src, dst, kind, seq, meta in sorted(edges_of(lines), key=lambda e: e[3]):
        first = want.setdefault((src, dst, kind), [meta, 0])
        first[1] += 1
    got = {(r["src"], r["dst"], r["kind"]): [json.loads(r["metadata"]), r["count"]] for r in catalog.edge_counting(spark, folder).collect()}
    assert got == want


def test_nodes_merge_into_half_of_the_events(spark, tables, monkeypatch):
    folder, _, _, events = tables
    sides = []
    upsert = store.upsert_nodes
    monkeypatch.setattr(store, "upsert_nodes", lambda old, new: sides.extend([old, new]) or upsert(old, new))
    last = {f"U{u}": (k, kind) for k, u, kind in events}
    assert {r["id"]: (r["seq"], r["name"]) for r in catalog.node_upsert(spark, folder).collect()} == last
    old, new = ({r["id"] for r in side.collect()} for side in sides)
    assert len(old) == len({u for k, u, _ in events if k < 600}) and old - new and old & new


@pytest.fixture(scope="module")
def phases(spark, tmp_path_factory):
    """(folder, calls, spent): orders by 6 customers at a time, so that strong components
    follow one another, with branches, repeated edges and edges to oneself."""
    folder, rng = str(tmp_path_factory.mktemp("phases")), random.Random(8)
    order = [rng.randrange(6 * phase, 6 * phase + 6) for phase in range(4) for _ in range(30)]
    order += [24, 25, 26, 97, 98, 97, 99, 98, 98, 97]
    orders = [(k, c, datetime.date(1995, 1, 1) + datetime.timedelta(k // 3), float(rng.randint(1, 50))) for k, c in enumerate(order)]
    known = {
        "orders": (orders, "o_orderkey bigint, o_custkey bigint, o_orderdate date, o_totalprice double"),
        "customer": ([(k, f"c{k}", k % 3) for k in range(100)], "c_custkey bigint, c_name string, c_nationkey bigint"),
    }
    for t in P.TABLES:
        rows, schema = known.get(t, ([(0,)], "unused int"))
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{t}.parquet")
    calls, spent = {}, {}
    for a, b in zip(order, order[1:]):
        calls[f"C{a}", f"C{b}"] = calls.get((f"C{a}", f"C{b}"), 0) + 1
    for _, c, _, price in orders:
        spent[f"C{c}"] = spent.get(f"C{c}", 0.0) + price
    return folder, calls, spent


def reach(calls, start, depth=1000):
    """Nodes that ``start`` calls over 1 to ``depth`` edges."""
    seen, now = set(), {start}
    for _ in range(depth):
        now = {b for a, b in calls if a in now} - seen
        if not now:
            break
        seen |= now
    return seen


def test_handoffs_keep_every_edge_and_count(spark, phases):
    folder, calls, _ = phases
    got = {(r["src"], r["dst"]): json.loads(r["metadata"])["count"] for r in P.handoff(spark, folder).edges.collect()}
    assert got == calls and max(got.values()) > 1 and len(got) > 2 * len({a for a, _ in got})


def test_handoff_queries_match_brute_force(spark, phases):
    folder, calls, spent = phases
    ids = {i for e in calls for i in e}
    below = {i: reach(calls, i) for i in ids}
    assert {r["id"] for r in catalog.blast_radius(spark, folder).collect()} == {i for i in ids if "C97" in reach(calls, i, 10)}
    above = {i: sum(i in below[j] for j in ids if j != i) for i in ids}
    assert {r["id"]: r["score"] for r in catalog.hotspots_blast_radius(spark, folder).collect()} == {i: n for i, n in above.items() if n}
    component = {i: min([i, *(j for j in below[i] if i in below[j])]) for i in ids}
    assert {r["id"]: r["component"] for r in catalog.strong_components(spark, folder).collect()} == component
    members = {c: sorted(i for i in ids if component[i] == c) for c in component.values()}
    cycles = {(r["component"], r["size"], r["members"]) for r in catalog.call_cycles(spark, folder).collect()}
    assert cycles == {(c, len(m), ",".join(m)) for c, m in members.items() if len(m) > 1} and len(cycles) > 3
    outer = {e: n for e, n in calls.items() if component[e[0]] != component[e[1]]}
    inbound = {b: sum(n for (_, d), n in outer.items() if d == b) for _, b in outer}

    def cost(c):
        return sum(spent[i] for i in members[c]) + sum(n / inbound[b] * cost(component[b]) for (a, b), n in outer.items() if component[a] == c)

    got = {r["id"]: (r["self_cost"], r["inclusive_cost"], r["cyclic"]) for r in catalog.cost_cyclic(spark, folder).collect()}
    assert set(got) == ids
    for i in ids:
        assert got[i] == (pytest.approx(spent[i], abs=0.01), pytest.approx(cost(component[i]), abs=0.01), len(members[component[i]]) > 1)
