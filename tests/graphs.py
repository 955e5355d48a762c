"""Small graphs by hand."""

import json

from weftline.plans.model import EDGE_SCHEMA, NODE_SCHEMA, Graph


def graph(spark, nodes, edges, kind="Function"):
    """``nodes``: name -> dict(exported, line, end, file, kind, meta); ``edges``: (src, dst, kind, meta)."""
    rows = []
    for k, (name, o) in enumerate(nodes.items()):
        rows.append((k, name, o.get("kind", kind), o.get("name", name), o.get("file", "src/a.ts"), o.get("exported", False), o.get("line", k + 1), o.get("end", o.get("line", k + 1)), json.dumps(o.get("meta", {}))))
    links = [(k, e[0], e[1], e[2] if len(e) > 2 else "CALLS", json.dumps(e[3] if len(e) > 3 else {})) for k, e in enumerate(edges)]
    return Graph.of(spark.createDataFrame(rows, NODE_SCHEMA), spark.createDataFrame(links, EDGE_SCHEMA))


def measured(self_ms, samples=0):
    return {"meta": {"runtime": {"selfMs": self_ms, "samples": samples}}}


def ids(df):
    return [r["id"] for r in df.collect()]
