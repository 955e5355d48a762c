"""Graphs as JSON lines, strictly validated, and the viewer's export."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.plans.model import EDGE_COLUMNS, EDGE_KINDS, NODE_COLUMNS, NODE_KINDS, Graph

_RANGE = "struct<startLine:int,startColumn:int,endLine:int,endColumn:int>"
_NODE = f"id string, kind string, name string, filePath string, range {_RANGE}, exported boolean, metadata variant, _bad string"
_EDGE = "id string, kind string, `from` string, `to` string, metadata variant, _bad string"


def _lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parsed lines with ``seq``, their order in the file, and the text of their own
    metadata. Blank lines are skipped."""
    text = spark.read.text(path).where("trim(value) <> ''").withColumn("seq", F.monotonically_increasing_id())
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    raw = F.get_json_object("value", "$.metadata")
    return text.select("seq", parsed.alias("p"), raw.alias("raw")).select("seq", "p.*", "raw")


def _checked(df: DataFrame, required: list[str], kinds: tuple[str, ...], what: str) -> DataFrame:
    wrong = F.col("_bad").isNotNull() | ~F.coalesce(F.col("kind").isin(*kinds), F.lit(False))
    for c in required:
        wrong = wrong | F.col(c).isNull()
    bad = df.where(wrong).first()
    if bad is not None:
        raise ValueError(f"bad {what} record: {bad['_bad'] or bad.asDict()}")
    return df


def read(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, dict | None]:
    """(nodes, edges, source manifest). A record that isn't as the schema says raises
    ValueError; a manifest that is missing or broken is None."""
    nodes = _checked(_lines(spark, f"{folder}/nodes.jsonl", _NODE), ["id", "name", "filePath"], NODE_KINDS, "node")
    edges = _checked(_lines(spark, f"{folder}/edges.jsonl", _EDGE), ["id", "from", "to"], EDGE_KINDS, "edge")
    nodes = nodes.select(
        "seq", "id", "kind", "name", F.col("filePath").alias("file_path"), F.coalesce("exported", F.lit(False)).alias("exported"),
        F.coalesce("range.startLine", F.lit(0)).cast("bigint").alias("start_line"), F.coalesce("range.endLine", F.lit(0)).cast("bigint").alias("end_line"), F.coalesce("raw", F.lit("{}")).alias("metadata"),
    )
    edges = edges.select("seq", F.col("from").alias("src"), F.col("to").alias("dst"), "kind", F.coalesce("raw", F.lit("{}")).alias("metadata"))
    return nodes.select(*NODE_COLUMNS), edges.select(*EDGE_COLUMNS), source_manifest(spark, f"{folder}/source.json")


def source_manifest(spark: SparkSession, path: str) -> dict | None:
    try:
        value = json.loads(spark.read.text(path, wholetext=True).first()["value"])
    except Exception:  # noqa: BLE001 - a manifest is optional, whatever is wrong with it
        return None
    fields = ("baseUrl", "commit", "prefix")
    return value if isinstance(value, dict) and all(isinstance(value.get(f), str) for f in fields) else None


def _quoted(c: str) -> Column:
    """A string as JSON text."""
    return F.regexp_extract(F.to_json(F.struct(F.col(c).alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)


def _object(*parts: tuple[str, Column | None]) -> Column:
    """JSON text of an object; a part whose text is null is left out."""
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), v) for k, v in parts]), F.lit("}"))


def write(graph: Graph, folder: str, source: dict | None = None) -> None:
    """nodes.jsonl and edges.jsonl as folders of JSON lines, in load order, and
    source.json where the graph's origin is known. Metadata are written as they are,
    keys in their order; empty ones are left out, as is a range that isn't known.
    Columns aren't stored: ranges have 0 there."""
    metadata = F.when(~F.coalesce(F.trim("metadata"), F.lit("")).isin("", "{}", "null"), F.col("metadata"))
    line = lambda c: F.col(c).cast("string")
    span = F.when(F.col("start_line") > 0, F.concat(F.lit('{"startLine":'), line("start_line"), F.lit(',"startColumn":0,"endLine":'), line("end_line"), F.lit(',"endColumn":0}')))
    nodes = graph.nodes.orderBy("seq", "id").select(_object(("id", _quoted("id")), ("kind", _quoted("kind")), ("name", _quoted("name")), ("filePath", _quoted("file_path")), ("range", span), ("exported", line("exported")), ("metadata", metadata)).alias("value"))
    named = graph.edges.withColumn("id", F.concat("kind", F.lit(":"), "src", F.lit("->"), "dst"))
    edges = named.orderBy("seq", "src", "dst").select(_object(("id", _quoted("id")), ("kind", _quoted("kind")), ("from", _quoted("src")), ("to", _quoted("dst")), ("metadata", metadata)).alias("value"))
    nodes.write.mode("overwrite").text(f"{folder}/nodes.jsonl")
    edges.write.mode("overwrite").text(f"{folder}/edges.jsonl")
    path = graph.spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/source.json")
    fs = path.getFileSystem(graph.spark._jsc.hadoopConfiguration())
    fs.delete(path, False)
    if source is not None:
        out = fs.create(path, True)
        out.write(bytearray(json.dumps(source, ensure_ascii=False, indent=2).encode()))
        out.close()


def viewer_script(graph: Graph) -> str:
    """The graph as a script that sets a constant, edges named e0, e1, ... For graphs
    that a browser can show; it is collected."""
    def with_meta(row: T.Row, out: dict) -> dict:
        meta = json.loads(row["metadata"] or "{}")
        return out | ({"metadata": meta} if meta else {})

    nodes = [with_meta(r, {"id": r["id"], "kind": r["kind"], "name": r["name"], "filePath": r["file_path"], "startLine": r["start_line"], "exported": r["exported"]}) for r in graph.nodes.orderBy("seq", "id").collect()]
    links = [with_meta(r, {"id": f"e{k}", "kind": r["kind"], "from": r["src"], "to": r["dst"]}) for k, r in enumerate(graph.edges.orderBy("seq", "src", "dst", "kind").collect())]
    return "window.GRAPH_DATA = " + json.dumps({"nodes": nodes, "edges": links}, ensure_ascii=False).replace("</", "<\\/") + ";\n"
