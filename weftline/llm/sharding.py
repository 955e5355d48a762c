"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has ``vnodes`` points on a ring; a key belongs to the first point at or
after its hash. No shard takes more than ceil((1 + slack) * keys / shards) keys:
going round the ring in order of hash, a key that finds its shard full continues
clockwise to the next shard with room.

Keys between two points are alike but for their rank, so the walk is done on the
counts per arc, of which there are shards * vnodes however large the table is.
Its result is, for each arc, which ranks go where. Only the keys of arcs that
overflow are ranked, and keys that repeat are ranked as one, with their number; the
others need no shuffle at all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARDS, VNODES, SLACK = 64, 128, 0.05
_COPIES = 10_000


class Ring:
    """Sorted points and the shard that owns each. Shards are any distinct names."""

    def __init__(self, shards: Sequence[int | str], vnodes: int = VNODES) -> None:
        if not len(shards) or vnodes < 1:
            raise ValueError("a ring needs a shard and a point for it")
        points = sorted((int.from_bytes(hashlib.md5(f"{s}#{v}".encode()).digest()[:8], "big") >> 1, k) for k, s in enumerate(shards) for v in range(vnodes))
        self.shards = list(shards)
        self.points = np.array([p for p, _ in points], np.int64)
        self.owner = np.array([k for _, k in points])

    def arc(self, hashes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.points, hashes) % len(self.points)

    def walk(self, counts: np.ndarray, slack: float = SLACK) -> list[tuple[int, int, int, int, int]]:
        """(arc, first rank, last rank, shard, shards passed) from the keys per arc;
        ranks from 1, in order of hash."""
        if not slack >= 0:
            raise ValueError("slack must be 0 or more, or the keys have no room")
        total, n = int(counts.sum()), len(self.shards)
        limit = -(-int(np.ceil(total * (1 + slack))) // n)
        room = np.full(n, limit)
        out = []
        for arc in np.flatnonzero(counts).tolist():
            rank, left, at, passed = 1, int(counts[arc]), arc, set()
            while left:
                shard = int(self.owner[at])
                take = min(left, int(room[shard]))
                if take:
                    out.append((arc, rank, rank + take - 1, shard, len(passed - {shard})))
                    room[shard] -= take
                    rank, left = rank + take, left - take
                passed.add(shard)
                at = (at + 1) % len(self.points)
        return out


def assign(docs: DataFrame, shards: Sequence[int | str] | int = SHARDS, vnodes: int = VNODES, slack: float = SLACK, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, home, shard, hops): for each row its key, the shard that the ring
    alone gives, the shard that it gets, and how many full shards it passed.

    A null key is a key like others (all nulls hash alike). Rows that repeat a key
    are placed each; where their shard is full some of them continue. An empty
    table gives an empty result; other columns are ignored, so texts of any
    length play no part. A negative ``slack`` and a ring without shards are
    ValueErrors."""
    names = list(range(shards)) if isinstance(shards, int) else list(shards)
    ring = Ring(names, vnodes)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(ring)

    @F.pandas_udf("int")
    def arc(hashes: pd.Series) -> pd.Series:
        return pd.Series(shared.value.arc(hashes.to_numpy()).astype(np.int32))

    keys = docs.select(F.col(id_col).alias("doc_id")).withColumn("h", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).bitwiseAND(F.lit((1 << 63) - 1)))
    keys = keys.withColumn("arc", arc("h"))
    counts = np.zeros(len(ring.points), np.int64)
    for row in keys.groupBy("arc").count().collect():
        counts[row["arc"]] = row["count"]
    parts = ring.walk(counts, slack)
    label = "bigint" if all(isinstance(s, int) for s in names) else "string"
    cast = int if label == "bigint" else str
    often = {a for a, first, *_ in parts if first > 1}
    rows = [(a, first, last, cast(names[ring.owner[a]]), cast(names[s]), hops) for a, first, last, s, hops in parts]
    schema = f"arc int, first bigint, last bigint, home {label}, shard {label}, hops int"
    # both sides have at most shards * vnodes + shards rows, whatever the table's size
    single = F.broadcast(spark.createDataFrame([r for r in rows if r[0] not in often], schema))
    split = F.broadcast(spark.createDataFrame([r for r in rows if r[0] in often], schema))
    straight = keys.join(single, "arc").select("doc_id", "home", "shard", "hops")
    if not often:
        return straight
    flagged = F.broadcast(spark.createDataFrame([(a,) for a in sorted(often)], "arc int"))
    # rows of one key are alike, so a hot key is a number here, not a heap of rows
    each = keys.join(flagged, "arc", "left_semi").groupBy("arc", "h", "doc_id").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("arc").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    ranked = each.withColumn("upto", upto).join(split, "arc").withColumn("n", F.least("last", "upto") - F.greatest("first", F.col("upto") - F.col("n") + 1) + 1).where("n > 0")
    # written out in pieces, as one array of all copies could be too large
    pieces = ranked.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / _COPIES))))
    rest = pieces.withColumn("k", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least(F.lit(_COPIES).cast("bigint"), F.col("n") - F.col("piece") * _COPIES)))).select("doc_id", "home", "shard", "hops")
    return straight.unionByName(rest)
