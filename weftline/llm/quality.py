"""Quality classifier: a factorisation machine over hashed words, structure
statistics and metadata.

score = w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2),
the sum-of-squares identity, so that all pairwise interactions cost as much as the
features that a document has. Fitted by AdaGrad on the logistic loss over at most
about ``MAX_TRAIN`` labelled documents, drawn by a hash of their id; scoring
covers every document.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.tables import unit_interval

MAX_TRAIN = 6000
SEED, RANK, PASSES = 11, 8, 4
THRESHOLD = 0.5
_WORDS, _META = 1 << 14, 1 << 8
STATISTICS = ("length", "word length", "distinct", "symbols", "exclamation", "capitals", "digits", "bars", "repeated lines", "line length", "doubled words", "sentence ends", "markup", "common")
SIZE = _WORDS + len(STATISTICS) + _META
_WORD = re.compile(r"[^\W_]+")
_CACHE = 150_000


class Features:
    """Sparse features of documents; keeps the buckets of the words it has met."""

    def __init__(self) -> None:
        self.buckets: dict[str, int] = {}

    def of(self, text: str | None, meta: tuple[str | None, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
        """(indices, values), each index once. A null text counts as an empty one; null metadata are a
        value of their own."""
        text = text or ""
        words = _WORD.findall(text.lower())
        counts = Counter(words)
        if len(self.buckets) > _CACHE:
            self.buckets.clear()
        known = self.buckets
        for w in counts:
            if w not in known:
                known[w] = zlib.crc32(w.encode()) % _WORDS
        index = np.fromiter(map(known.__getitem__, counts), np.int64, len(counts))
        value = np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
        norm = math.sqrt(float(value @ value))
        n, m = len(text), len(words)
        lines = [x for x in text.split("\n") if x.strip()]
        raw = text.encode("utf-8", "replace")
        codes = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        size = max(1, len(raw))
        spaces = int(codes[32] + codes[10] + codes[9] + codes[13])
        alnum = int(codes[48:58].sum() + codes[65:91].sum() + codes[97:123].sum() + codes[128:].sum())
        capitals = int(codes[65:91].sum())
        structure = [
            math.log1p(m) / 10, sum(map(len, words)) / m / 10 if m else 0.0, len(counts) / m if m else 0.0, (len(raw) - spaces - alnum) / size * 4, min(1.0, codes[33] / size * 10), capitals / max(1, capitals + int(codes[97:123].sum())),
            min(1.0, int(codes[48:58].sum()) / size * 5), min(1.0, codes[124] / size * 10), 1 - len(set(lines)) / len(lines) if lines else 0.0, min(1.0, n / len(lines) / 2000) if lines else 0.0,
            sum(a == b for a, b in zip(words, words[1:])) / m if m else 0.0, min(1.0, int(codes[46] + codes[63]) / max(1, m) * 3), min(1.0, int(codes[60] + codes[123]) / size * 20), max(counts.values()) / m if m else 0.0,
        ]
        tags = [_WORDS + len(STATISTICS) + zlib.crc32(f"{k}={v}".encode()) % _META for k, v in enumerate(meta)]
        # words, and metadata, that share a bucket are one feature of their values' sum
        index, place = np.unique(np.concatenate([index, np.arange(_WORDS, _WORDS + len(STATISTICS)), np.array(tags, np.int64)]), return_inverse=True)
        value = np.bincount(place, np.concatenate([value / norm if norm else value, np.array(structure), np.full(len(tags), 0.3)]), len(index))
        return index.astype(np.int32), value.astype(np.float32)


class Machine:
    def __init__(self, bias: float, linear: np.ndarray, factors: np.ndarray) -> None:
        self.bias, self.linear, self.factors = bias, linear, factors

    def margin(self, index: np.ndarray, value: np.ndarray) -> float:
        v = self.factors[index]
        sums = value @ v
        return float(self.bias + value @ self.linear[index] + 0.5 * (sums @ sums - np.square(value) @ np.square(v).sum(1)))

    def score(self, index: np.ndarray, value: np.ndarray) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.margin(index, value)))))

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, np.ndarray]], labels: list[float], rank: int = RANK, passes: int = PASSES, seed: int = SEED, rate: float = 0.1, decay: float = 1e-5) -> Machine:
        """Without rows every score is 1/2; rows of one class move the bias only so far."""
        rng = np.random.default_rng(seed)
        w, v = np.zeros(SIZE), rng.normal(0, 0.02, (SIZE, rank))
        gw, gv, gb = np.full(SIZE, 1e-3), np.full((SIZE, rank), 1e-3), 1e-3
        share = min(0.99, max(0.01, float(np.mean(labels)))) if labels else 0.5
        bias = math.log(share / (1 - share))
        for _ in range(passes):
            for at in rng.permutation(len(rows)):
                i, x = rows[at]
                x = x.astype(float)
                vi = v[i]
                sums = x @ vi
                margin = bias + x @ w[i] + 0.5 * (sums @ sums - np.square(x) @ np.square(vi).sum(1))
                g = 1 / (1 + math.exp(-max(-50.0, min(50.0, margin)))) - labels[at]
                dw, dv = g * x + decay * w[i], g * (x[:, None] * sums - np.square(x)[:, None] * vi) + decay * vi
                gb += g * g
                bias -= rate * g / math.sqrt(gb)
                gw[i] += np.square(dw)
                gv[i] += np.square(dv)
                w[i] -= rate * dw / np.sqrt(gw[i])
                v[i] -= rate * dv / np.sqrt(gv[i])
        return cls(bias, w.astype(np.float32), v.astype(np.float32))


def _meta_column(docs: DataFrame, meta_cols: tuple[str, ...]):
    return F.array(*[F.col(c).cast("string") for c in meta_cols]) if meta_cols else F.array().cast("array<string>")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple[str, ...] = ("source", "lang"), label_col: str = "quality", max_train: int = MAX_TRAIN, seed: int = SEED) -> Machine:
    """Machine for the documents that ``labels`` names, at most about ``max_train``.
    An id with several labels has the majority's, a tie being 0; null ids and labels
    don't count; null and empty texts are learnt by their statistics and metadata, and
    texts count whole. Rows that repeat an id count each. Without labelled rows every
    score is 1/2. It is fitted in one task, whose input that bound limits."""
    by_id = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("key")).agg((F.avg(F.col(label_col).cast("double")) > 0.5).cast("double").alias("label"))
    n = by_id.count()
    share = min(1.0, max_train / max(1, n))
    # at most about max_train rows, whatever the tables' size
    drawn = F.broadcast(by_id.where(unit_interval(seed, F.col("key")) < share))
    narrow = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"), _meta_column(docs, meta_cols).alias("meta"))
    sample = narrow.join(drawn, "key")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Features()
        for batch in batches:
            cols = batch.to_pydict()
            made = [make.of(t, tuple(m)) for t, m in zip(cols["text"], cols["meta"])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([str(k) for k in cols["key"]], pa.string()), pa.array(cols["label"], pa.float64()), pa.array([i.tobytes() for i, _ in made], pa.binary()), pa.array([x.tobytes() for _, x in made], pa.binary())],
                ["key", "label", "i", "x"],
            )

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r["key"], r["i"], r["x"], r["label"]) for b in batches for r in b.to_pylist())
        got = Machine.fit([(np.frombuffer(i, np.int32), np.frombuffer(x, np.float32)) for _, i, x, _ in rows], [r[3] for r in rows])
        yield pa.RecordBatch.from_arrays([pa.array([got.bias]), pa.array([got.linear.tobytes()], pa.binary()), pa.array([got.factors.tobytes()], pa.binary())], ["bias", "linear", "factors"])

    made = sample.select("key", "text", "meta", "label").mapInArrow(extract, "key string, label double, i binary, x binary")
    row = made.repartition(1).mapInArrow(fit, "bias double, linear binary, factors binary").first()
    return Machine(row["bias"], np.frombuffer(row["linear"], np.float32), np.frombuffer(row["factors"], np.float32).reshape(SIZE, -1))


def classify(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple[str, ...] = ("source", "lang"), threshold: float = THRESHOLD) -> DataFrame:
    """(id, score double, keep boolean) for each row of ``docs``; ``score`` is the
    probability of good quality and ``keep`` whether it reaches ``threshold``.

    Null and empty texts are scored by their statistics and metadata, null metadata
    being a value of their own. Texts count whole. Repeated rows and null ids are
    scored each; a score equal to ``threshold`` is kept. An empty table gives an empty result; other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, fm = Features(), shared.value
        for batch in batches:
            scores = [round(fm.score(*make.of(t, tuple(m))), 6) for t, m in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([s >= threshold for s in scores], pa.bool_())], [id_col, "score", "keep"])

    narrow = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text_"), _meta_column(docs, meta_cols).alias("meta_"))
    return narrow.mapInArrow(run, f"`{id_col}` {narrow.schema[0].dataType.simpleString()}, score double, keep boolean")
