"""SimHash near-duplicate search by a binary-trie self-join.

Every text gets a 128-bit fingerprint: bit *i* is set when more than half of the
text's distinct lower-cased words have bit *i* set in their MD5 digest. Two texts
are near duplicates when their fingerprints differ in at most ``max_bits`` bits
and the shorter has at least ``min_length_ratio`` of the longer one's words.
Groups are the connected components of that relation.

The join is exact. The bits are cut into a ring of ``max_bits`` + 1 parts. Of two
fingerprints within the budget, from some part on, the first k parts of the ring
together differ in at most k * max_bits / (max_bits + 1) bits, for every k (the cycle
lemma): in none in the first part, in one in the first two, and so on. So each
distinct fingerprint goes once to each part's trie, in which the ring is read from
that part on. A trie is spread over the cluster by its first part, as equal bits
are needed there, and the subtrie below each such node is joined with itself:
pairs of nodes go down together, carrying the number of bits that differ so far,
and a pair that exceeds what its depth allows is dropped with everything below it.
Where a first part's largest node has too many rows for a task, nodes of two or
three parts are spread instead, and each also gets the fingerprints of the nodes
that it may be paired with.

Work grows faster than the fingerprints, with their square where they are dense
beyond the depth of the pruning. Only fingerprints move through the shuffles,
never texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.names import fresh
from weftline.llm.tables import join_measured, spread, whole_partitions
from weftline.plans.settle import settle

BITS = 128
MAX_BITS = 20
MIN_LENGTH_RATIO = 0.75
#: Rows of a bucket that one task should hold, and the parts that its key has at most.
BUCKET_ROWS, _DEEPEST = 1 << 19, 3
WORD = re.compile(r"[^\W_]+")
_CACHE_WORDS = 150_000
_SINGLE_LEVELS = 4
#: Node pairs that the join expands at once.
_PAIRS = 1 << 19

ORACLE_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w
  FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL
), counted AS (SELECT doc_id, w, len(w) AS n_words FROM words WHERE len(w) > 0),
digests AS (
  SELECT doc_id, n_words, md5(x) AS h FROM (
    SELECT doc_id, n_words, unnest(list_distinct(w)) AS x FROM counted)
), nibbles AS (
  SELECT doc_id, n_words, i, ('0x' || substr(h, CAST(i AS INT), 1))::INT AS v
  FROM digests, (SELECT unnest(range(1, 33)) AS i)
), bits AS (
  SELECT doc_id, n_words, i,
         CASE WHEN 2 * sum((v >> 3) & 1) > count(*) THEN 1 ELSE 0 END AS b3,
         CASE WHEN 2 * sum((v >> 2) & 1) > count(*) THEN 1 ELSE 0 END AS b2,
         CASE WHEN 2 * sum((v >> 1) & 1) > count(*) THEN 1 ELSE 0 END AS b1,
         CASE WHEN 2 * sum(v & 1) > count(*) THEN 1 ELSE 0 END AS b0
  FROM nibbles GROUP BY doc_id, n_words, i
), prints AS (
  SELECT doc_id, n_words, string_agg(concat(b3, b2, b1, b0), '' ORDER BY i)::BIT AS fp
  FROM bits GROUP BY doc_id, n_words
), edges AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM prints a JOIN prints b
    ON a.doc_id <> b.doc_id AND bit_count(xor(a.fp, b.fp)) <= 20
   AND least(a.n_words, b.n_words) >= 0.75 * greatest(a.n_words, b.n_words)
), reach AS (
  SELECT x, y FROM edges UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x
)
SELECT x AS doc_id, min(y) AS duplicate_of FROM reach GROUP BY x HAVING min(y) < x
"""


class Fingerprinter:
    """Fingerprints of texts; keeps the digests of the words it has met."""

    def __init__(self) -> None:
        self.digests: dict[str, bytes] = {}

    def of(self, text: str | None) -> tuple[bytes, int] | None:
        """16 bytes and the number of words; None for a text without words."""
        words = WORD.findall(text.lower()) if text else ()
        if not words:
            return None
        known, md5, parts = self.digests, hashlib.md5, []
        if len(known) > _CACHE_WORDS:
            known.clear()
        for word in set(words):
            digest = known.get(word)
            if digest is None:
                digest = known[word] = md5(word.encode()).digest()
            parts.append(digest)
        bits = np.unpackbits(np.frombuffer(b"".join(parts), np.uint8).reshape(-1, 16), axis=1)
        ones = np.add.reduce(bits, axis=0, dtype=np.int32)
        return np.packbits(2 * ones > len(parts)).tobytes(), len(words)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, hi bigint, lo bigint, n_words int), one row per text with words. Null ids,
    null texts and texts without a word have no row; ``id`` keeps its type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        printer = Fingerprinter()
        for batch in batches:
            found = [(k, p) for k, t in enumerate(batch.column(1)) if (p := printer.of(t.as_py()))]
            halves = np.frombuffer(b"".join(p[0] for _, p in found), ">i8").astype(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array([k for k, _ in found], pa.int64())), pa.array(np.ascontiguousarray(halves[:, 0])), pa.array(np.ascontiguousarray(halves[:, 1])), pa.array([p[1] for _, p in found], pa.int32())],
                ["id", "hi", "lo", "n_words"],
            )

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return narrow.where("id IS NOT NULL AND text IS NOT NULL").mapInArrow(run, f"id {narrow.schema['id'].dataType.simpleString()}, hi bigint, lo bigint, n_words int")


def parts_of(max_bits: int) -> list[tuple[int, int, int]]:
    """(half, shift, bits) of the parts that the 128 bits are cut into, in ring order:
    one more than ``max_bits`` (four at least), none across the two halves."""
    m = max(4, max_bits + 1)
    out = []
    for half, n in ((0, m // 2), (1, m - m // 2)):
        at = 64
        for k in range(n):
            size = 64 // n + (k < 64 % n)
            at -= size
            out.append((half, at, size))
    return out


def allowed(parts: int, max_bits: int, length: int) -> int:
    """Bits that may differ in the first ``length`` parts of a chain."""
    return length * max_bits // parts


def masks_of(sizes: list[int], max_bits: int, parts: int) -> list[int]:
    """Differences that a chain may show in its first ``len(sizes)`` parts, as bit
    masks over them; the one without a difference isn't listed."""
    found = [(0, 0)]
    for k, size in enumerate(sizes):
        most = allowed(parts, max_bits, k + 1)
        found = [((mask << size) | m, gone + m.bit_count()) for mask, gone in found for m in range(1 << size if gone < most else 1) if gone + m.bit_count() <= most]
    return [mask for mask, gone in found if gone]


def _levels(parts: int) -> list[tuple[int, int]]:
    """Parts (from, to) of a chain that each level of the trie takes, the first one
    being the bucket's: some single parts, then up to five at a step."""
    cuts = [1]
    while cuts[-1] < parts:
        cuts.append(min(parts, cuts[-1] + (1 if len(cuts) <= _SINGLE_LEVELS else 5)))
    return list(zip(cuts, cuts[1:]))


def chain_columns(start: np.ndarray, hi: np.ndarray, lo: np.ndarray, max_bits: int) -> list[np.ndarray]:
    """For each level of the trie the bits of its parts, the ring being read from part
    ``start`` on."""
    parts = parts_of(max_bits)
    halves = (hi.view(np.uint64), lo.view(np.uint64))
    out = [np.zeros(len(start), np.uint64) for _ in _levels(len(parts))]
    for first in np.unique(start).tolist():
        rows = np.flatnonzero(start == first)
        for column, (a, b) in zip(out, _levels(len(parts))):
            value = np.zeros(len(rows), np.uint64)
            for half, shift, size in (parts[(first + j) % len(parts)] for j in range(a, b)):
                value = (value << np.uint64(size)) | ((halves[half][rows] >> np.uint64(shift)) & np.uint64((1 << size) - 1))
            column[rows] = value
    return out


def _pairs_of(a_lo: np.ndarray, a_n: np.ndarray, b_lo: np.ndarray, b_n: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All combinations of the children of node pairs; of a node with itself only
    those with left <= right. Third: the pair that each came from."""
    count = a_n.astype(np.int64) * b_n
    src = np.repeat(np.arange(len(count)), count)
    k = np.arange(len(src)) - np.repeat(np.cumsum(count) - count, count)
    left, right = a_lo[src] + k // b_n[src], b_lo[src] + k % b_n[src]
    if same.any():
        keep = ~same[src] | (left <= right)
        left, right, src = left[keep], right[keep], src[keep]
    return left, right, src


def link(bucket: np.ndarray, start: np.ndarray, home: np.ndarray, hi: np.ndarray, lo: np.ndarray, words: np.ndarray, max_bits: int, ratio: float) -> np.ndarray:
    """For each row the least row of its component, the components being those of the
    pairs in one ``bucket``, one of them ``home`` there, whose chain from part
    ``start`` on keeps to what is allowed and whose ``words`` are alike.

    Rows that the order of the trie puts side by side are tried first. A pair of
    nodes all below which is one component by then is left out."""
    n = len(bucket)
    forest = Forest(n)
    if n < 2:
        return forest.root
    columns = chain_columns(start, hi, lo, max_bits)
    hi, lo = hi.view(np.uint64), lo.view(np.uint64)
    order = np.lexsort((words, *columns[::-1], bucket))
    bucket, words, hi, lo, home = bucket[order], words[order], hi[order], lo[order], home[order]
    columns = [c[order] for c in columns]
    alike = lambda a, b: np.minimum(words[a], words[b]) >= ratio * np.maximum(words[a], words[b])
    first = np.ones(n, bool)
    first[1:] = bucket[1:] != bucket[:-1]
    b = np.flatnonzero(~first)
    near = (np.bitwise_count(hi[b - 1] ^ hi[b]).astype(np.int16) + np.bitwise_count(lo[b - 1] ^ lo[b]) <= max_bits) & alike(b - 1, b)
    forest.join(b[near] - 1, b[near])
    # level l's nodes are runs of rows with equal bits down to it: their first rows, ends, and whether one row of them is at home; their children are a run of level l + 1's nodes
    lows, tops, homes, least, most = [], [], [], [], []
    for column in (None, *columns):
        if column is not None:
            first = first.copy()
            first[1:] |= column[1:] != column[:-1]
        at = np.flatnonzero(first).astype(np.int32)
        lows.append(at)
        tops.append(np.append(at[1:], np.int32(n)))
        homes.append(np.maximum.reduceat(home, at))
        least.append(np.minimum.reduceat(forest.root, at))
        most.append(np.maximum.reduceat(forest.root, at))
    child = [np.searchsorted(lows[k + 1], lows[k]).astype(np.int32) for k in range(len(columns))]
    children = [np.searchsorted(lows[k + 1], tops[k]).astype(np.int32) - child[k] for k in range(len(columns))]
    parts = len(parts_of(max_bits))
    ends = [to for _, to in _levels(parts)]
    roots = np.flatnonzero((tops[0] - lows[0] > 1) & (least[0] != most[0]))
    stack = [(0, roots, roots, np.zeros(len(roots), np.int16))]
    while stack:
        level, a, b, gone = stack.pop()
        if level == len(columns):
            left, right, _ = _pairs_of(lows[level][a], tops[level][a] - lows[level][a], lows[level][b], tops[level][b] - lows[level][b], np.zeros(len(a), bool))
            fits = alike(left, right) & (home[left] | home[right]).astype(bool)
            forest.join(left[fits], right[fits])
            continue
        work = np.cumsum(children[level][a].astype(np.int64) * children[level][b])
        if len(a) > 1 and work[-1] > _PAIRS:
            cut = min(max(1, int(np.searchsorted(work, work[-1] // 2))), len(a) - 1)
            stack += [(level, a[cut:], b[cut:], gone[cut:]), (level, a[:cut], b[:cut], gone[:cut])]
            continue
        left, right, src = _pairs_of(child[level][a], children[level][a], child[level][b], children[level][b], a == b)
        rows_l, rows_r = lows[level + 1][left], lows[level + 1][right]
        column = columns[level]
        bits = gone[src] + np.bitwise_count(column[rows_l] ^ column[rows_r])
        keep = np.flatnonzero(bits <= allowed(parts, max_bits, ends[level]))
        left, right, bits = left[keep], right[keep], bits[keep].astype(np.int16)
        down = level + 1
        one = (least[down][left] == most[down][left]) & (least[down][right] == most[down][right]) & (least[down][left] == least[down][right])
        # equal rows have been tried side by side: a leaf with itself has nothing left
        keep = np.flatnonzero(~one & ((homes[down][left] | homes[down][right]) > 0) & ((left != right) | (down < len(columns))))
        if len(keep):
            stack.append((down, left[keep], right[keep], bits[keep]))
    out = np.arange(n)
    out[order] = order[forest.root]
    return out


class Forest:
    """Union-find over 0..n-1 by whole arrays of edges."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while True:
            x, y = root[a], root[b]
            open_ = x != y
            if not open_.any():
                return
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root[:] = up


def _part(at: int, max_bits: int) -> Column:
    half, shift, size = parts_of(max_bits)[at]
    return F.shiftrightunsigned(F.col(("hi", "lo")[half]), shift).bitwiseAND(F.lit((1 << size) - 1))


def buckets(prints: DataFrame, depth: int, max_bits: int = MAX_BITS) -> DataFrame:
    """``prints`` once per part of the ring, with (start, bucket, home): the part, and
    the bits of the ``depth`` parts from there. With a depth above 1 a print is also
    sent, not at home, to the buckets that a near one of larger bits may be in."""
    parts = parts_of(max_bits)
    m = len(parts)
    depth = min(depth, m)
    places, masks = [], []
    for start in range(m):
        chain = [(start + j) % m for j in range(depth)]
        value = _part(start, max_bits)
        for at in chain[1:]:
            value = F.shiftleft(value, parts[at][2]).bitwiseOR(_part(at, max_bits))
        places.append(F.struct(F.lit(start).alias("start"), value.alias("value")))
        masks.append(masks_of([parts[at][2] for at in chain], max_bits, m))
    spots = prints.withColumn("place", F.explode(F.array(*places))).select("place.*", *prints.columns)
    if depth == 1:
        return spots.select("start", F.col("value").alias("bucket"), F.lit(1).cast("tinyint").alias("home"), *prints.columns)
    others = F.get(F.array(*[F.array(*[F.lit(x).cast("bigint") for x in row]).cast("array<bigint>") for row in masks]), F.col("start"))
    keys = F.concat(F.array("value"), F.filter(F.transform(others, lambda x: F.col("value").bitwiseXOR(x)), lambda k: k > F.col("value")))
    spots = spots.withColumn("bucket", F.explode(keys))
    return spots.select("start", "bucket", (F.col("bucket") == F.col("value")).cast("tinyint").alias("home"), *prints.columns)


def depth_for(largest: int, most: int = BUCKET_ROWS) -> int:
    """Parts that a bucket's key takes, from the rows of the largest bucket of one part."""
    depth = 1
    while largest > most and depth < _DEEPEST:
        depth, largest = depth + 1, largest >> 6
    return depth


def near_edges(prints: DataFrame, max_bits: int = MAX_BITS, min_length_ratio: float = MIN_LENGTH_RATIO) -> DataFrame:
    """(x, y), x < y: edges whose components are those of the near-duplicate pairs.
    ``prints`` (id, hi, lo, n_words) must hold each fingerprint once per length."""
    single = buckets(prints, 1, max_bits)
    sizes = single.groupBy("start", "bucket").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
    depth = depth_for(sizes["most"] or 0)
    spots = single if depth == 1 else buckets(prints, depth, max_bits)
    rows = (sizes["all"] or 0) if depth == 1 else spots.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = whole_partitions(batches)
        if whole is None:
            return
        start, bucket, home, ids, hi, lo, words = (whole.column(i).to_numpy() for i in range(7))
        # one part has fewer than 2 ** 58 values
        root = link(bucket * 128 + start, start, home, hi, lo, words, max_bits, min_length_ratio)
        rows = np.flatnonzero(root != np.arange(len(root)))
        if len(rows):
            x, y = ids[rows], ids[root[rows]]
            kind = whole.column(3).type
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y), kind), pa.array(np.maximum(x, y), kind)], ["x", "y"])

    kind = prints.schema["id"].dataType.simpleString()
    return spread(spots, rows, "start", "bucket").select("start", "bucket", "home", "id", "hi", "lo", "n_words").mapInArrow(run, f"x {kind}, y {kind}").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the least id of each edge end's connected component.

    Rounds of large-star and small-star: each links the neighbours of a node to
    the least of them, until no edge changes. Rounds grow with the logarithm of
    the component's size."""
    state = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
    now = settle(edges.where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct())
    before = state(now)
    while True:
        both = now.union(now.select("y", "x"))
        lows = both.groupBy(F.col("x").alias("u")).agg(F.min("y").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large-star: larger neighbours of u go under the least of u and its neighbours
        large = now.join(lows.withColumnRenamed("u", "x"), "x").select(F.col("m").alias("x"), "y").where("x <> y").distinct()
        # small-star: smaller neighbours and the node itself go under the least
        least = large.groupBy("y").agg(F.min("x").alias("m"))
        small = large.join(least, "y").select(F.explode(F.array(F.struct(F.col("m").alias("x"), F.col("x").alias("y")), F.struct(F.col("m").alias("x"), "y"))).alias("e")).select("e.x", "e.y").where("x <> y").distinct()
        now = settle(small)
        if (after := state(now)) == before:
            return now.groupBy(F.col("y").alias("id")).agg(F.min("x").alias("root"))
        before = after


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, min_length_ratio: float = MIN_LENGTH_RATIO) -> DataFrame:
    """(doc_id, duplicate_of): each document that is a near duplicate of one with a
    smaller id, with the least id of its group, which is its class. The least member
    of a group, and documents without near duplicates, have no row.

    Null ids, null texts and texts without words are never grouped. Rows that
    repeat an id with the same text count once; an id with several texts belongs to
    the groups of all of them. Texts of any length count whole. Ids may be of any
    type that has an order. An empty table gives an empty result; other columns are
    ignored."""
    prints = settle(fingerprints(docs, id_col, text_col))
    # equal fingerprints of equal length are one node of the search, however many there are
    nodes = prints.groupBy("hi", "lo", "n_words").agg(F.min("id").alias("id")).select("id", "hi", "lo", "n_words")
    nodes = settle(nodes)
    copies = prints.join(nodes.withColumnRenamed("id", "rep"), ["hi", "lo", "n_words"]).where("id <> rep").select(F.col("rep").alias("x"), F.col("id").alias("y"))
    found = components(near_edges(nodes, max_bits, min_length_ratio).union(copies))
    return found.where("id <> root").select(F.col("id").alias("doc_id"), F.col("root").alias("duplicate_of"))


def _ordered(docs: DataFrame) -> list[Column]:
    """Columns to order rows by, those of a type without an order as their JSON."""
    plain = ("map", "variant")
    return [(F.to_json(F.struct(F.col(f"`{n}`"))) if any(x in t for x in plain) else F.col(f"`{n}`")).asc_nulls_last() for n, t in docs.dtypes]


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: float) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: the one of least id.
    Documents of null id, or with no word in their text, all stay. Of rows that
    repeat id and text one stays, the first in the order of all columns. Texts count
    whole; an empty table stays empty. Columns of any type and name are kept."""
    key, seen = fresh(docs.columns, "gone_id", "seen")
    gone = settle(near_duplicates(docs, id_col, text_col, **how).select(F.col("doc_id").alias(key)).distinct())
    kept = join_measured(docs, gone, F.col(id_col) == F.col(key), "left_anti")
    # ids that occur more than once are few; only their rows take part in the second pass
    often = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias(key)).agg(F.count("*").alias(seen)).where(F.col(seen) > 1).select(key)
    often = settle(often)
    if often.isEmpty():
        return kept
    again = join_measured(kept, often, F.col(id_col) == F.col(key), "left_semi")
    one = again.withColumn(seen, F.row_number().over(Window.partitionBy(id_col, text_col).orderBy(*_ordered(docs)))).where(F.col(seen) == 1).drop(seen)
    return join_measured(kept, often, F.col(id_col) == F.col(key), "left_anti").unionByName(one)
