"""Best-fit packing of documents into training sequences by a grouping genetic
algorithm.

A document is cut into pieces of at most ``capacity`` tokens, so that only its
last piece is shorter. Full pieces fill a bin each. The rest are packed: pieces
are dealt by a hash of their id to shards of about ``SHARD`` pieces, and each
shard is solved by ``islands`` populations that evolve apart and, between
epochs, send copies of their elite to the next island of the ring. Every island
of every shard is a group of its own, so an epoch is one ``applyInPandas`` over
the cluster, and only ids and lengths move.

An individual is an assignment of pieces to bins. Crossover takes the best-filled
bins of one parent whole, drops from the other parent's bins the ones that hold a
piece twice, and puts the displaced pieces back by best fit, longest first. The
first individual is plain best-fit decreasing and the best one always survives,
so the result has never more bins than that.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.mixing import n_tokens
from weftline.plans.settle import settle

CAPACITY = 2048
SHARD = 2048
ISLANDS, POPULATION, EPOCHS, GENERATIONS = 3, 4, 2, 4
SEED = 29


def best_fit(sizes: np.ndarray, items: np.ndarray, free: list[tuple[int, int]], bins: np.ndarray, next_bin: int, capacity: int) -> int:
    """Put ``items``, in their order, each into the fullest bin that still takes it
    (``free``: sorted (space, bin)); new bins are numbered from ``next_bin``."""
    for item, size in zip(items.tolist(), sizes[items].tolist()):
        at = bisect_left(free, (size, -1))
        if at < len(free):
            space, number = free.pop(at)
        else:
            space, number = capacity, next_bin
            next_bin += 1
        bins[item] = number
        if space > size:
            insort(free, (space - size, number))
    return next_bin


def fitness(sizes: np.ndarray, bins: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins are better, then fuller full ones: (-bins, sum of squared fill)."""
    fill = np.bincount(bins, sizes)
    fill = fill[fill > 0] / capacity
    return -len(fill), float(np.square(fill).sum())


def cross(rng: np.random.Generator, sizes: np.ndarray, one: np.ndarray, two: np.ndarray, capacity: int) -> np.ndarray:
    """Child of ``two`` with well-filled whole bins of ``one`` injected."""
    fill = np.bincount(one, sizes)
    used = np.flatnonzero(fill)
    ranked = used[np.argsort(-fill[used] + rng.random(len(used)) * 0.02 * capacity, kind="stable")]
    chosen = ranked[: max(1, int(len(ranked) * rng.uniform(0.2, 0.6)))]
    injected = np.isin(one, chosen)
    hit = np.zeros(int(two.max()) + 1, bool)
    hit[two[injected]] = True
    fill_two = np.bincount(two, sizes)
    weak = (fill_two > 0) & (fill_two < capacity) & (rng.random(len(fill_two)) < 0.1)
    hit |= weak[: len(hit)]
    child = np.full(len(sizes), -1)
    stays = ~injected & ~hit[two]
    _, child[stays] = np.unique(two[stays], return_inverse=True)
    base = int(child.max()) + 1
    _, inner = np.unique(one[injected], return_inverse=True)
    child[injected] = base + inner
    placed = child >= 0
    space = capacity - np.bincount(child[placed], sizes[placed]).astype(int)
    free = sorted((int(s), b) for b, s in enumerate(space) if s > 0)
    loose = np.flatnonzero(~placed)
    best_fit(sizes, loose[np.argsort(-sizes[loose], kind="stable")], free, child, len(space), capacity)
    return child


def first_population(rng: np.random.Generator, sizes: np.ndarray, capacity: int, count: int) -> list[np.ndarray]:
    """Best-fit decreasing, and best fit in orders that noise disturbs."""
    out = []
    for k in range(count):
        bins = np.full(len(sizes), -1)
        seen = sizes if k == 0 else np.maximum(1, sizes + (rng.random(len(sizes)) * sizes * 0.1 * k).astype(int))
        best_fit(sizes, np.argsort(-seen, kind="stable"), [], bins, 0, capacity)
        out.append(bins)
    return out


def evolve(seed: tuple[int, ...], sizes: np.ndarray, population: list[np.ndarray], capacity: int, generations: int, keep: int) -> list[np.ndarray]:
    """The ``keep`` best individuals after some generations, best first."""
    rng = np.random.default_rng(seed)
    least = -(-int(sizes.sum()) // capacity)
    if not population:
        population = first_population(rng, sizes, capacity, keep)
    scored = sorted(((fitness(sizes, x, capacity), x) for x in population), key=lambda t: t[0], reverse=True)[:keep]
    for _ in range(generations):
        if -scored[0][0][0] <= least:
            break  # no packing has fewer bins
        children = []
        for _ in range(keep):
            i, j = sorted(rng.integers(0, len(scored), 2))
            children.append(cross(rng, sizes, scored[i][1], scored[j][1], capacity))
        scored = sorted(scored + [(fitness(sizes, x, capacity), x) for x in children], key=lambda t: t[0], reverse=True)[:keep]
    return [x for _, x in scored]


_GENES = "shard bigint, island int, rank int, sizes binary, bins binary"


def _epoch(frame: DataFrame, epoch: int, capacity: int, generations: int, population: int, seed: int, width: int) -> DataFrame:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        shard, island = int(group["shard"].iloc[0]), int(group["island"].iloc[0])
        group = group.sort_values("rank", kind="stable")
        sizes = np.frombuffer(group["sizes"].iloc[0], np.int32).astype(int)
        given = [np.frombuffer(b, np.int32).astype(int) for b in group["bins"] if b is not None and len(b)]
        best = evolve((seed, epoch, shard, island), sizes, given, capacity, generations, population)
        return pd.DataFrame({"shard": shard, "island": island, "rank": range(len(best)), "sizes": [group["sizes"].iloc[0]] * len(best), "bins": [b.astype(np.int32).tobytes() for b in best]})

    # a few megabytes of genes are hours of work: adaptive execution must not put them into one task
    return frame.repartition(width, "shard", "island").groupBy("shard", "island").applyInPandas(run, _GENES)


def pack(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", islands: int = ISLANDS, population: int = POPULATION, epochs: int = EPOCHS, generations: int = GENERATIONS, seed: int = SEED) -> DataFrame:
    """(bin string, doc_id, copy bigint, piece bigint, start bigint, n_tokens bigint):
    every piece of every document once, no bin above ``capacity`` tokens.

    Tokens are separated by white space; ``start`` counts them from 0. Rows that
    repeat an id are told apart by ``copy``, counted from 1 in order of their
    length; rows of null id likewise. Null texts, empty texts and texts without a
    token have nothing to pack and no row. A text of any length is packed whole. Of
    packings equally good the one of larger bytes is taken. Ids may be of any type that
    has an order. An empty table gives an empty result; other columns are ignored."""
    counted = docs.select(F.col(id_col).alias("doc_id"), n_tokens(text_col).alias("total")).where("total > 0")
    # copies of an id are numbered without gathering them: equal lengths are counted first
    grouped = counted.groupBy("doc_id", "total").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("doc_id").orderBy("total").rowsBetween(Window.unboundedPreceding, -1))
    items = grouped.withColumn("b", F.coalesce(before, F.lit(0))).select("doc_id", "total", F.explode(F.sequence(F.col("b") + 1, F.col("b") + F.col("n"))).alias("copy"))
    items = settle(items)
    full = items.withColumn("k", F.floor(F.col("total") / capacity)).where("k > 0").select("doc_id", "copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1)).alias("piece"))
    full = full.select(F.concat_ws("-", F.lit("full"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "copy", "piece").alias("bin"), "doc_id", "copy", "piece", (F.col("piece") * capacity).alias("start"), F.lit(capacity).cast("bigint").alias("n_tokens"))
    rest = items.withColumn("n_tokens", F.col("total") % capacity).where("n_tokens > 0")
    shards = max(1, -(-rest.count() // SHARD))
    rest = rest.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "copy"), F.lit(shards)))

    # one row per shard: sizes in an order that the piece's place in the shard's list fixes
    listed = settle(rest.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("n_tokens", "doc_id", "copy", "total"))).alias("pieces")))

    def sizes(column: pd.Series) -> pd.Series:
        return column.map(lambda x: np.asarray(x, np.int32).tobytes())

    to_bytes = F.pandas_udf(sizes, "binary")
    genes = listed.select("shard", F.explode(F.array(*[F.lit(i) for i in range(islands)])).alias("island"), F.lit(0).alias("rank"), to_bytes(F.col("pieces.n_tokens")).alias("sizes"), F.lit(None).cast("binary").alias("bins"))
    width = min(shards * islands, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), shards * islands // 8))
    for epoch in range(epochs):
        evolved = settle(_epoch(genes, epoch, capacity, generations, population, seed, width))
        elite = evolved.where("rank = 0").withColumn("island", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int")).withColumn("rank", F.lit(population))
        genes = evolved.unionByName(elite)

    def best(group: pd.DataFrame) -> pd.DataFrame:
        individuals = [(np.frombuffer(s, np.int32), np.frombuffer(b, np.int32)) for s, b in zip(group["sizes"], group["bins"])]
        s, bins = max(individuals, key=lambda x: (fitness(x[0], x[1], capacity), x[1].tobytes()))
        return pd.DataFrame({"shard": [int(group["shard"].iloc[0])], "bins": [np.unique(bins, return_inverse=True)[1].tolist()]})

    chosen = evolved.groupBy("shard").applyInPandas(best, "shard bigint, bins array<bigint>")
    packed = listed.join(chosen, "shard").select("shard", F.explode(F.arrays_zip("pieces", "bins")).alias("z"))
    packed = packed.select(
        F.concat_ws("-", F.lit("mixed"), "shard", "z.bins").alias("bin"), F.col("z.pieces.doc_id").alias("doc_id"), F.col("z.pieces.copy").alias("copy"),
        F.floor(F.col("z.pieces.total") / capacity).alias("piece"), (F.col("z.pieces.total") - F.col("z.pieces.n_tokens")).alias("start"), F.col("z.pieces.n_tokens").alias("n_tokens"),
    )
    return full.unionByName(packed)
