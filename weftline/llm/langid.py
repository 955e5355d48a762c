"""Language identification by Bayesian fusion of evidence.

For each language the log of the posterior adds up
  - the likelihood of the text under a model of hashed byte trigrams, tempered
    as neighbouring trigrams aren't independent,
  - the likelihood of the declared language (a markup attribute or a column),
  - the likelihood of the address suffix, and
  - the prior of the host, smoothed towards its domain, and that towards the whole.
The last two come from counts by grouped aggregation of what the text alone says.
A further hypothesis, ``und``, spreads its likelihood evenly over letter trigrams;
text of an unknown language, and noise, go to it.

The trigram models are trained on at most about ``MAX_TRAIN`` documents of each
declared language, drawn by a hash of their id. A document's whole text is counted;
it weighs as the square root of its length, whatever that is, so that one very long
text doesn't make the model of a language. Everything else covers all rows.

Texts are scored once where they needn't be in the result: what is said of them is
written beside the columns that are wanted, and priors and fusion work on those rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.names import fresh
from weftline.llm.tables import join_measured, unit_interval
from weftline.plans.settle import settle

MAX_TRAIN = 1500
SEED = 3
MIN_CONFIDENCE = 0.5
UNKNOWN = "und"
_BUCKETS = 1 << 16
_ALPHA = 0.05
_TEMPER = 0.4
#: Log probability of a trigram under ``und``: even over 27 * 27 * 27.
_NOISE = -math.log(27**3)
#: Prior weight of ``und``, and the probability that a declaration is right.
_UNKNOWN_PRIOR, _RELIABLE = 0.02, 0.9
#: Documents that a parent's prior counts for.
_STRENGTH = 10.0
#: Trigrams that a document of as many weighs: the unit of the square root.
_UNIT = 2000.0
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_SPACES = re.compile(rb" +")


def trigrams(text: str) -> np.ndarray:
    """Bucket of each trigram of the lower-cased letters, runs of others being one space."""
    raw = _SPACES.sub(b" ", b" " + text.lower().encode("utf-8", "replace").translate(_TABLE) + b" ")
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, np.int64)
    return ((((b[:-2] << 16) | (b[1:-1] << 8) | b[2:]) * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


class TextModel:
    """Log probabilities of the buckets by language; the last column is ``und``."""

    def __init__(self, counts: dict[str, np.ndarray]) -> None:
        self.languages = sorted(counts)
        cols = [np.log((counts[x] + _ALPHA) / (counts[x].sum() + _ALPHA * _BUCKETS)) for x in self.languages]
        self.table = np.stack([*cols, np.full(_BUCKETS, _NOISE)], 1).astype(np.float32)

    def loglik(self, text: str | None) -> np.ndarray | None:
        """Tempered log likelihoods; None for a text without letters."""
        if not text:
            return None
        codes = trigrams(text)
        if not len(codes):
            return None
        return np.add.reduce(self.table[codes], axis=0, dtype=np.float64) * _TEMPER


def _tag(declared: Column) -> Column:
    """Primary part of a language tag, lower case; null where it is none."""
    tag = F.lower(F.regexp_extract(F.trim(declared.cast("string")), r"^([A-Za-z]{2,3})(?:[-_].*)?$", 1))
    return F.when(F.length(tag) > 0, tag)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str = "lang", max_train: int = MAX_TRAIN, seed: int = SEED) -> TextModel:
    """Model of the languages that ``declared_col`` names. For each about
    ``max_train`` of its documents at most count, drawn by a hash of the id, a null id
    being an empty one. Null declarations and null texts don't count; texts count
    whole; rows that repeat count each. Without declared documents there is no
    language. The model has 65,536 numbers for each language."""
    labelled = docs.select(_tag(F.col(declared_col)).alias("lang"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN))
    # tags have two or three letters: there are 18,252 of them at most
    sizes = F.broadcast(settle(labelled.groupBy("lang").agg(F.count("*").alias("n"))))
    drawn = labelled.where("text IS NOT NULL").join(sizes, "lang").where(unit_interval(seed, F.col("id")) < F.least(F.lit(1.0), max_train / F.col("n")))
    sample = drawn.select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes = trigrams(text)
                found = np.bincount(codes, minlength=_BUCKETS) * math.sqrt(_UNIT / max(1, len(codes)))
                by[lang] = by[lang] + found if lang in by else found
        for lang, counts in by.items():
            codes = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int32)), pa.array(counts[codes])], ["lang", "code", "n"])

    rows = sample.mapInArrow(count, "lang string, code int, n double").groupBy("lang", "code").agg(F.sum("n").cast("float").alias("n")).toPandas()
    counts = {}
    for lang, part in rows.groupby("lang"):
        counts[lang] = np.bincount(part["code"], part["n"], _BUCKETS)
    return TextModel(counts)


def _vector(pairs: list, n: int) -> np.ndarray:
    out = np.zeros(n)
    for at, k in pairs:
        out[int(at)] += k
    return out


def _pairs(language: str, number: str) -> Column:
    """The rows of a group as pairs (language, number); of languages there are few."""
    return F.collect_list(F.array(F.col(language).cast("double"), F.col(number).cast("double")))


def identify(docs: DataFrame, model: TextModel, text_col: str = "text", declared: Column | None = None, host: Column | None = None, suffix: Column | None = None, min_confidence: float = MIN_CONFIDENCE, names: tuple[str, str, str] = ("predicted", "confidence", "accepted"), carry: Sequence[str] | None = None) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all by default) with the three ``names`` added:
    the language (``und`` where none wins), its posterior and whether it is a known
    language of posterior ``min_confidence`` at least. A name that ``carry`` has is
    lengthened. With ``text_col`` among ``carry`` texts are scored twice.

    A null or empty text, or one without letters, is ``und`` with confidence 1 and
    not accepted. Null declarations, hosts and suffixes, and declarations of a
    language without a model, are no evidence. Texts count whole. Rows that repeat
    get the same answer each; ties go to the language first in the alphabet. An
    empty table stays empty."""
    n, spark = len(model.languages), docs.sparkSession
    carry = list(docs.columns if carry is None else carry)
    names = tuple(fresh(carry, *names))
    dec, hst, sfx, ll, hp, sp, hk, sk, best, post = fresh([*carry, *names], "d_", "h_", "s_", "ll_", "hp_", "sp_", "hk_", "sk_", "best_", "post_")
    shared = spark.sparkContext.broadcast(model)
    nothing = F.lit(None).cast("string")
    host = nothing if host is None else F.lower(host.cast("string"))
    suffix = nothing if suffix is None else F.lower(suffix.cast("string"))

    @F.pandas_udf("array<double>")
    def loglik(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.loglik(t if isinstance(t, str) else None) for t in texts], dtype=object)

    tag = nothing if declared is None else _tag(declared)
    scored = docs.select(*[F.col(f"`{c}`") for c in carry], tag.alias(dec), host.alias(hst), suffix.alias(sfx), loglik(F.col(text_col).cast("string")).alias(ll))
    if text_col not in carry:
        scored = settle(scored)
    # what the text alone says, by host and suffix: small beside the texts
    first = (F.array_position(ll, F.array_max(ll)) - 1).cast("int")
    said = scored.where(F.col(ll).isNotNull()).select(first.alias(best), hst, sfx).where(F.col(best) < n)
    counts = settle(said.groupBy(F.col(hst).alias("host"), F.col(sfx).alias("suffix"), F.col(best).alias("best")).agg(F.count("*").alias("k")))
    whole = _vector([(r["best"], r["k"]) for r in counts.groupBy("best").agg(F.sum("k").alias("k")).collect()], n)
    top = (whole + 1.0) / (whole.sum() + n) if n else whole
    smoothed = lambda own, above: (own + above * _STRENGTH) / (own.sum() + _STRENGTH)

    @F.pandas_udf("array<double>")
    def prior(own: pd.Series, domain: pd.Series) -> pd.Series:
        return pd.Series([smoothed(_vector(a, n), smoothed(_vector(b, n), top)) for a, b in zip(own, domain)], dtype=object)

    @F.pandas_udf("array<double>")
    def likely(own: pd.Series) -> pd.Series:
        """P(suffix | language) up to a factor that all languages share."""
        return pd.Series([(_vector(a, n) + top) / (whole + 1.0) for a in own], dtype=object)

    by_host = counts.where("host IS NOT NULL").groupBy("host", "best").agg(F.sum("k").alias("k")).withColumn("domain", F.substring_index("host", ".", -2))
    domains = by_host.groupBy("domain", "best").agg(F.sum("k").alias("k")).groupBy("domain").agg(_pairs("best", "k").alias("dc"))
    hosts = by_host.groupBy("host", "domain").agg(_pairs("best", "k").alias("c")).join(domains, "domain")
    hosts = settle(hosts.select(F.col("host").alias(hk), prior("c", "dc").alias(hp)))
    by_suffix = counts.where("suffix IS NOT NULL").groupBy("suffix", "best").agg(F.sum("k").alias("k"))
    suffixes = settle(by_suffix.groupBy("suffix").agg(_pairs("best", "k").alias("c")).select(F.col("suffix").alias(sk), likely("c").alias(sp)))
    place = {x: i for i, x in enumerate(model.languages)}
    labels = np.array([*model.languages, UNKNOWN], dtype=object)

    @F.pandas_udf("predicted string, confidence double")
    def fused(texts: pd.Series, tags: pd.Series, by_host: pd.Series, by_suffix: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"predicted": [UNKNOWN] * len(texts), "confidence": np.ones(len(texts))})
        rows = np.flatnonzero(texts.notna())
        if not len(rows):
            return out
        score = np.stack(texts.to_numpy()[rows]).astype(float)
        score[:, :n] += math.log(1 - _UNKNOWN_PRIOR)
        score[:, n] += math.log(_UNKNOWN_PRIOR)
        score[:, :n] += np.log(np.stack([top if x is None else x for x in by_host.to_numpy()[rows]])) if n else 0.0
        for k, (tag, suffix) in enumerate(zip(tags.to_numpy()[rows], by_suffix.to_numpy()[rows])):
            if tag in place:
                score[k, :n] += math.log((1 - _RELIABLE) / max(1, n - 1))
                score[k, place[tag]] += math.log(_RELIABLE) - math.log((1 - _RELIABLE) / max(1, n - 1))
                # ``und`` says nothing of suffix or declaration: it gets the mean language's factor there
                score[k, n] -= math.log(max(1, n))
            if suffix is not None and n:
                score[k, :n] += np.log(suffix)
                score[k, n] += math.log(float(np.sum(suffix)) / n)
        won = score.argmax(1)
        out.loc[rows, "predicted"] = labels[won]
        out.loc[rows, "confidence"] = np.round(1 / np.exp(score - score.max(1, keepdims=True)).sum(1), 6)
        return out

    joined = join_measured(scored, hosts, F.col(hst) == F.col(hk), "left")
    joined = join_measured(joined, suffixes, F.col(sfx) == F.col(sk), "left").withColumn(post, fused(ll, dec, hp, sp))
    predicted, confidence = F.col(f"{post}.predicted"), F.col(f"{post}.confidence")
    accepted = (predicted != UNKNOWN) & (confidence >= min_confidence)
    return joined.select(*[F.col(f"`{c}`") for c in carry], predicted.alias(names[0]), confidence.alias(names[1]), accepted.alias(names[2]))


def of_documents(docs: DataFrame, max_train: int = MAX_TRAIN, carry: Sequence[str] | None = None) -> DataFrame:
    """Documents, whose ``lang`` is the declaration and whose ``source`` is the host:
    their columns ``carry`` (all by default) with (predicted, confidence, accepted)
    added last, under names that don't clash. Null, empty, long and repeated texts,
    ties and an empty table are as ``identify`` has them; a null id is kept."""
    return identify(docs, train(docs, max_train=max_train), declared=F.col("lang"), host=F.col("source"), carry=carry)


def of_pages(pages: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """(page_id, declared, host, suffix, predicted, confidence, accepted) of web
    pages: text without scripts, styles, comments and tags; the ``lang`` attribute of
    the html element; the top-level domain, with a two-letter first path segment.

    A null or empty page is ``und`` and not accepted; a null address has neither host
    nor suffix; pages count whole; rows that repeat are answered each; an empty table
    gives an empty result; other columns are ignored."""
    html = F.col("html").cast("string")
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>|&[a-zA-Z#0-9]+;", " ")
    host = F.regexp_extract(F.lower("url"), r"^[a-z]+://(?:[^/@]*@)?([^/:?#]+)", 1)
    first = F.regexp_extract(F.lower("url"), r"^[a-z]+://[^/]*/([a-z]{2})(?:/|$)", 1)
    flat = pages.select(
        "page_id", "url", text.alias("text"), F.nullif(F.regexp_extract(html, r"(?is)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z][A-Za-z\-]*)", 1), F.lit("")).alias("declared"),
        F.nullif(host, F.lit("")).alias("host"), F.concat_ws("/", F.substring_index(host, ".", -1), F.nullif(first, F.lit(""))).alias("suffix"),
    )
    model = train(flat, "page_id", declared_col="declared", max_train=max_train)
    found = identify(flat, model, declared=F.col("declared"), host=F.col("host"), suffix=F.nullif(F.col("suffix"), F.lit("")), carry=["page_id", "declared", "host", "suffix"])
    return found


def keep_identified(docs: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """The documents whose language is accepted, with their own columns, of whatever
    names. Those of null, empty or letterless text go; a null id, tag or source is no
    reason to go. Rows that repeat stay or go together. Texts count whole; an empty
    table stays empty.

    Texts are scored once. Those that go are few: their keys (96 bits of a hash of
    text, tag and source, on which alone the decision depends) are taken out of the
    documents, by broadcast where they are few bytes."""
    one, two, gone_one, gone_two = fresh(docs.columns, "key_a", "key_b", "gone_a", "gone_b")
    parts = [F.col("text"), F.col("lang"), F.col("source")]
    keyed = docs.withColumn(one, F.xxhash64(*parts)).withColumn(two, F.hash(*parts))
    found = of_documents(keyed, max_train, carry=[one, two])
    gone = settle(found.where(~F.col(found.columns[-1])).select(F.col(one).alias(gone_one), F.col(two).alias(gone_two)).distinct())
    return join_measured(keyed, gone, (F.col(one) == F.col(gone_one)) & (F.col(two) == F.col(gone_two)), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
