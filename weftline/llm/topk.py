"""Exact top-k search over a bit-sliced index.

Vectors are dealt to blocks. Within a block each attribute is quantised to
``BITS`` bits and stored as bit slices: bitmap j of attribute d has a bit for every
row whose quantised value has bit j. For a query the attributes' weights are
quantised too, and the weighted sum of all attributes is formed for all rows at
once by bitmap arithmetic: each set bit of a weight adds the attribute's slices,
shifted, and full adders (five bitmap operations) reduce three slices of one
significance to one of it and one of the next. The k-th largest sum is found from
the most significant slice downward.

The quantisation error of a sum is bounded by norms that the index stores, so rows
whose sum is below the k-th by more than twice the bound can't be in the answer.
The others, the boundary rows, are resolved with their exact scores. Each block
gives its own k best, and the k best of those are the answer.

Queries meet blocks in tasks: each has one block and at most about ``PER_TASK``
queries. The block's rows come first, the index is built of them once and stays
while the queries stream by in Arrow batches. So a block is indexed once for every
``PER_TASK`` queries, the work spreads over the cluster evenly, nothing is broadcast,
and a task needs no more memory than one index. Time grows with queries times rows,
as for any exact method without assumptions on the vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.plans.settle import settle

K = 10
BITS, WEIGHT_BITS = 7, 6
BLOCK, PER_TASK = 16_384, 2_048
#: Partitions that the tasks are dealt to, at most.
_WIDEST = 20_000
#: The registered query asks for every row whose id is divisible by this.
EVERY = 20

ORACLE_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id AS neighbour_id, list_inner_product(q.e, d.e) AS s
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, neighbour_id) AS rank FROM scored
)
SELECT query_id, neighbour_id, CAST(rank AS INT) AS rank, round(s, 6) AS score FROM ranked WHERE rank <= 10
"""


def exact_scores(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in the order of the attributes, so
    that equal rows have equal scores wherever they lie."""
    total = np.zeros(len(rows))
    for d in range(len(query)):
        total += query[d] * rows[:, d]
    return total


class BitSlicedIndex:
    def __init__(self, ids: np.ndarray, rows: np.ndarray, bits: int = BITS) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows, self.bits = ids[order], rows[order].astype(np.float64), bits
        self.n, self.dims = self.rows.shape
        top = (1 << (bits - 1)) - 1
        self.scale = np.maximum(np.abs(self.rows).max(0), 1e-30) / top
        scaled = self.rows / self.scale
        quantised = np.rint(scaled).astype(np.int64)
        #: Norms that bound the error of a sum.
        self.residual = float(np.sqrt(np.square(scaled - quantised).sum(1)).max())
        self.largest = float(np.sqrt(np.square(quantised).sum(1)).max())
        self.offset = 1 << (bits - 1)
        self.words = -(-self.n // 64)
        self.mask = self._bitmap(np.ones(self.n, bool))
        unsigned = quantised + self.offset
        self.slices = np.stack([np.stack([self._bitmap((unsigned[:, d] >> j) & 1) for j in range(bits)]) for d in range(self.dims)])
        self.inverse = ~self.slices & self.mask

    def _bitmap(self, flags: np.ndarray) -> np.ndarray:
        packed = np.zeros(self.words * 8, np.uint8)
        raw = np.packbits(flags.astype(bool), bitorder="little")
        packed[: len(raw)] = raw
        return packed.view(np.uint64)

    def weigh(self, query: np.ndarray, weight_bits: int = WEIGHT_BITS) -> tuple[np.ndarray, float, float]:
        """Integer weights, the size of one unit of the sum, the bound of its error."""
        weight = query * self.scale
        unit = max(float(np.abs(weight).max()), 1e-300) / ((1 << weight_bits) - 1)
        whole = np.rint(weight / unit).astype(np.int64)
        error = np.linalg.norm(weight - whole * unit) * self.largest + np.linalg.norm(weight) * self.residual
        return whole, unit, float(error) * (1 + 1e-9) + 1e-12

    def sums(self, weights: np.ndarray) -> list[np.ndarray]:
        """Slices, least significant first, of sum |w| * u over the attributes, where u
        is the quantised value, or its complement where w is negative."""
        size = np.abs(weights)
        top = max(1, int(size.max()).bit_length())
        columns: list[list[np.ndarray]] = [[] for _ in range(top + self.bits)]
        for t in range(top):
            has = (size >> t) & 1 == 1
            for side, stored in ((weights > 0, self.slices), (weights < 0, self.inverse)):
                picked = stored[has & side]
                if len(picked):
                    for j in range(self.bits):
                        columns[t + j].append(picked[:, j])
        out: list[np.ndarray] = []
        at = 0
        while at < len(columns):
            planes = np.concatenate(columns[at]) if columns[at] else np.empty((0, self.words), np.uint64)
            carries = []
            while len(planes) > 2:
                k = len(planes) // 3
                a, b, c = planes[:k], planes[k : 2 * k], planes[2 * k : 3 * k]
                half = a ^ b
                carries.append((a & b) | (c & half))
                planes = np.concatenate([half ^ c, planes[3 * k :]]) if len(planes) > 3 * k else half ^ c
            if len(planes) == 2:
                carries.append(planes[:1] & planes[1:])
                planes = planes[:1] ^ planes[1:]
            out.append(planes[0] if len(planes) else np.zeros(self.words, np.uint64))
            if carries:
                if at + 1 == len(columns):
                    columns.append([])
                columns[at + 1] += carries
            at += 1
        return out

    def kth(self, slices: list[np.ndarray], k: int) -> int:
        """The k-th largest sum, or the least where there are fewer rows."""
        k = min(k, self.n)
        sure, tied, value, above = None, self.mask, 0, 0
        for j in range(len(slices) - 1, -1, -1):
            ones = tied & slices[j]
            count = int(np.bitwise_count(ones).sum())
            if above + count >= k:
                tied, value = ones, value | (1 << j)
            else:
                above += count
                tied = tied & ~slices[j]
        return value

    def at_least(self, slices: list[np.ndarray], bound: int) -> np.ndarray:
        """Rows whose sum is ``bound`` or more."""
        if bound <= 0:
            return np.arange(self.n)
        if bound.bit_length() > len(slices):
            return np.empty(0, int)
        more, same = np.zeros(self.words, np.uint64), self.mask
        for j in range(len(slices) - 1, -1, -1):
            if (bound >> j) & 1:
                same = same & slices[j]
            else:
                more = more | (same & slices[j])
                same = same & ~slices[j]
        return np.flatnonzero(np.unpackbits((more | same).view(np.uint8), bitorder="little")[: self.n])

    def search(self, query: np.ndarray, k: int, without: object = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k rows of largest inner product with ``query``, by score
        and then id, the row ``without`` left out."""
        query = query.astype(np.float64)
        weights, unit, error = self.weigh(query)
        # one row more, as the query's own may be among them
        wanted = k + (without is not None)
        slices = self.sums(weights)
        bound = self.kth(slices, wanted) - int(np.ceil(2 * error / unit)) - 1
        rows = self.at_least(slices, bound)
        if without is not None:
            rows = rows[self.ids[rows] != without]
        scores = exact_scores(query, self.rows[rows])
        # rows lie in the order of their ids
        best = np.lexsort((rows, -scores))[:k]
        return self.ids[rows[best]], scores[best]


def nearest(vectors: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", queries: Column | None = None) -> DataFrame:
    """(query_id, neighbour_id, rank int, score double): for every vector that
    ``queries`` (a condition on ``vectors``; all of them by default) names, the ``k``
    others of largest inner product, exactly; equal scores by id.

    Rows with a null id, a null vector, a null, NaN or infinite component, or another
    length than most, neither ask nor answer (of lengths equally frequent the longest
    is used). Rows that repeat an id count once, the one of largest vector in Spark's
    order, and ask if one of them does. Ids may be of any type that has an order. With
    fewer than k others there are fewer rows; an empty table gives an empty result.
    Other columns are ignored."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    asks = F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))
    clean = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), asks.alias("asks")).where("id IS NOT NULL AND v IS NOT NULL").where(~bad & (F.size("v") > 0))
    clean = settle(clean.groupBy("id").agg(F.max("v").alias("v"), F.max("asks").alias("asks")))
    lengths = clean.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.count_if("asks").alias("asked")).orderBy(F.desc("n"), F.desc("d")).first()
    dims, rows, asked = tuple(lengths) if lengths else (1, 0, 0)
    fit = clean.where(F.size("v") == dims)
    blocks, splits = max(1, -(-rows // BLOCK)), max(1, -(-asked // PER_TASK))
    width = min(blocks * splits, _WIDEST)
    numbers = lambda n: F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))
    task = lambda block, split: (block * splits + split).alias("task")
    data = fit.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("g"), F.explode(numbers(splits)).alias("s")).select(task(F.col("g"), F.col("s")), F.lit(0).alias("role"), "id", "v")
    ask = fit.where("asks").select("id", "v", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(splits)).alias("s"), F.explode(numbers(blocks)).alias("g")).select(task(F.col("g"), F.col("s")), F.lit(1).alias("role"), "id", "v")
    dealt = data.unionByName(ask).repartitionById(width, (F.col("task") % width).cast("int")).sortWithinPartitions("task", "role", "id")
    kind = fit.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, index = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            tasks, roles = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            column = batch.column(2)
            ids = column.to_numpy() if pa.types.is_integer(column.type) else np.array(column.to_pylist())
            v = batch.column(3).flatten().to_numpy().reshape(-1, dims)
            cuts = np.flatnonzero((np.diff(tasks) != 0) | (np.diff(roles) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(tasks)]):
                if tasks[a] != now:
                    now, held, index = tasks[a], [], None
                if roles[a] == 0:
                    held.append((ids[a:b], v[a:b]))
                    continue
                if index is None and held:
                    index, held = BitSlicedIndex(np.concatenate([i for i, _ in held]), np.concatenate([x for _, x in held])), []
                if index is not None:
                    found = [index.search(q, k, i) for i, q in zip(ids[a:b], v[a:b])]
                    who = np.repeat(np.arange(a, b), [len(f[0]) for f in found])
                    yield pa.RecordBatch.from_arrays(
                        [column.take(pa.array(who)), pa.array(np.concatenate([f[0] for f in found]).tolist(), column.type), pa.array(np.concatenate([f[1] for f in found]))], ["query_id", "neighbour_id", "score"]
                    )

    found = dealt.mapInArrow(run, f"query_id {kind}, neighbour_id {kind}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "neighbour_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "neighbour_id", "rank", F.round("score", 6).alias("score"))
