"""Mixing sources to target weights.

Tokens are counted per source, each source's repetition rate is its share of the
token budget over the tokens it has, and each document is emitted floor(rate)
times plus once more where a number drawn from its id is below the fraction.

One pass counts; its result is one row per source. The second pass emits, without
a shuffle of any text: the rates are broadcast, unless there are so many sources
that their measured number forbids it.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.names import fresh
from weftline.llm.tables import join_measured, unit_interval
from weftline.plans.settle import settle

SEED = 17
#: Share of a source in the mixture: proportional to the square root of its tokens.
ORACLE_SQL = """
WITH counted AS (
  SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\f\\x0b]+')) AS n_tokens FROM documents
), per_source AS (
  SELECT source, CAST(sum(n_tokens) AS DOUBLE) AS t FROM counted GROUP BY source
), rates AS (
  SELECT source, CASE WHEN t > 0
    THEN (SELECT sum(t) FROM per_source) * sqrt(t) / (SELECT sum(sqrt(t)) FROM per_source) / t ELSE 1.0 END AS rate
  FROM per_source
), copies AS (
  SELECT c.*, r.rate, CAST(floor(r.rate) AS BIGINT) + CASE WHEN
    CAST(('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13))::BIGINT AS DOUBLE) / 4503599627370496.0
      < r.rate - floor(r.rate) THEN 1 ELSE 0 END AS n
  FROM counted c JOIN rates r ON c.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, text, lang, source, n_chars, CAST(n_tokens AS BIGINT) AS n_tokens,
       round(rate, 6) AS rate, CAST(unnest(range(1, n + 1)) AS BIGINT) AS copy
FROM copies WHERE n > 0
"""


def n_tokens(text: str):
    """Whitespace-separated tokens; a null text has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^ \t\n\r\f\x0B]+")), F.lit(0)).cast("bigint")


def source_rates(docs: DataFrame, weights: Mapping[str | None, float] | None = None, budget: float | None = None, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(source, tokens bigint, rate double), one row per source.

    rate = budget * weight / tokens. ``weights`` are normalised; a source that they
    don't name has weight 0. Without ``weights`` a source's weight is the square
    root of its tokens; without ``budget`` it is the tokens that there are. A
    source without tokens has rate 1: repeating it changes no share. Documents of
    null source form one source."""
    per = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(n_tokens(text_col)).alias("tokens"))
    per = settle(per)
    if weights is None:
        weighted = per.withColumn("w", F.sqrt("tokens"))
    else:
        rows = [(k, float(v)) for k, v in weights.items()]
        given = per.sparkSession.createDataFrame(rows, "k string, w double")
        weighted = per.join(F.broadcast(given), F.col("source").cast("string").eqNullSafe(F.col("k")), "left").drop("k").fillna(0.0, ["w"])
    total = weighted.agg(F.sum("tokens").cast("double").alias("t"), F.sum("w").alias("s"))
    size = F.lit(float(budget)) if budget is not None else F.col("t")
    rate = F.when(F.col("tokens") > 0, size * F.col("w") / F.col("s") / F.col("tokens")).otherwise(1.0)
    return weighted.crossJoin(F.broadcast(total)).select("source", "tokens", F.when(F.col("s") > 0, rate).otherwise(1.0).alias("rate"))


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, budget: float | None = None, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", detail: bool = True) -> DataFrame:
    """``docs`` repeated to the target weights: their columns and, with ``detail``,
    ``n_tokens bigint, rate double, copy bigint`` (counted from 1).

    The draw depends on seed and id alone, so rows that repeat an id are drawn
    alike; a null id counts as an empty string. Null and empty texts have no
    tokens and take the rate of their source; texts of any length are counted whole. An
    empty table stays empty. Extra columns are carried along; where a table has columns
    of these three names, the new ones' names are lengthened."""
    k, tokens, rate, n, copy = fresh(docs.columns, "mix_source", "mix_tokens", "mix_rate", "mix_n", "mix_copy")
    rates = settle(source_rates(docs, weights, budget, source_col, text_col)).select(F.col("source").alias(k), F.col("rate").alias(rate))
    joined = join_measured(docs, rates, F.col(source_col).eqNullSafe(F.col(k)), "inner")
    whole = F.floor(F.col(rate))
    extra = (unit_interval(seed, F.col(id_col)) < F.col(rate) - whole).cast("bigint")
    out = joined.withColumn(n, whole + extra).where(F.col(n) > 0)
    if detail:
        out = out.withColumn(tokens, n_tokens(text_col))
    out = out.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(n))))
    if not detail:
        return out.select(*docs.columns)
    named = fresh(docs.columns, "n_tokens", "rate", "copy")
    return out.select(*docs.columns, F.col(tokens).alias(named[0]), F.round(F.col(rate), 6).alias(named[1]), F.col(copy).alias(named[2]))
