"""Typed reading of the JSON metadata of nodes and edges.

The text is the truth and is never rewritten through a parser that would reorder
its keys. A number is a JSON number: the string "3" isn't one.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _parsed(metadata: str) -> str:
    return f"try_parse_json({metadata})"


def number(metadata: str, path: str) -> Column:
    """The JSON number at ``path`` as a double; null for anything else."""
    at = f"try_variant_get({_parsed(metadata)}, '{path}', 'variant')"
    kind = f"schema_of_variant({at})"
    return F.expr(f"CASE WHEN {kind} RLIKE '^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT)' THEN try_variant_get({_parsed(metadata)}, '{path}', 'double') END")


def string(metadata: str, path: str) -> Column:
    """The JSON string at ``path``; null for anything else."""
    at = f"try_variant_get({_parsed(metadata)}, '{path}', 'variant')"
    return F.expr(f"CASE WHEN schema_of_variant({at}) = 'STRING' THEN try_variant_get({_parsed(metadata)}, '{path}', 'string') END")


def call_count(metadata: str = "metadata") -> Column:
    """Occurrences of a call in the source: a positive number, else 1. Most metadata
    hold nothing else, and are read without a parser."""
    alone = F.regexp_extract(metadata, r'^\{"count":([1-9][0-9]{0,14})\}$', 1)
    n = number(metadata, "$.count")
    return F.when(alone != "", alone.cast("double")).when(n > 0, n).otherwise(1.0)


def flow_samples(metadata: str = "metadata") -> Column:
    """Samples of a runtime call as a flow weight: a number of 0 or more, else 1."""
    n = number(metadata, "$.samples")
    return F.when(n >= 0, n).otherwise(1.0)


def tie_samples(metadata: str = "metadata") -> Column:
    """Samples of a runtime call as a tie in clustering: a positive number, else 0."""
    n = number(metadata, "$.samples")
    return F.when(n > 0, n).otherwise(0.0)


def self_ms(metadata: str = "metadata") -> Column:
    return F.coalesce(number(metadata, "$.runtime.selfMs"), F.lit(0.0))


def samples(metadata: str = "metadata") -> Column:
    return F.coalesce(number(metadata, "$.runtime.samples"), F.lit(0.0))


def has_runtime(metadata: str = "metadata") -> Column:
    """Whether ``runtime`` is an object or an array, however empty."""
    kind = F.expr(f"schema_of_variant(try_variant_get({_parsed(metadata)}, '$.runtime', 'variant'))")
    return F.coalesce(kind.rlike("^(OBJECT|ARRAY)"), F.lit(False))


def _merge(text: str | None, change: str | None) -> str | None:
    if not isinstance(change, str):
        return text
    try:
        now = json.loads(text) if isinstance(text, str) else {}
    except ValueError:
        now = {}
    now = now if isinstance(now, dict) else {}
    return json.dumps(now | json.loads(change), ensure_ascii=False, separators=(",", ":"))


def with_changes(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """``nodes`` with the keys of ``changes`` (id, change) set in their metadata; only the
    rows that change are parsed."""
    changed = nodes.join(changes, "id").withColumn("metadata", merged("metadata", "change")).select(*nodes.columns)
    return nodes.join(changes.select("id"), "id", "left_anti").select(*nodes.columns).unionByName(changed)


def merged(metadata: str, changes: str) -> Column:
    """The JSON object of each row with the keys of ``changes`` (a JSON object, or null)
    set; other keys stay as and where they are. Text that is no object counts as {}."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series([_merge(a, b) for a, b in zip(texts, new)], dtype=object)

    return run(F.col(metadata), F.col(changes))
