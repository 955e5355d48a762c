"""Documents for the edge cases that every operator must bear."""

from pyspark.sql import Row

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ENGLISH = "The quick brown fox jumps over the lazy dog while the old farmer watches from the wooden fence near the river"
GERMAN = "Der schnelle braune Fuchs springt über den faulen Hund während der alte Bauer vom hölzernen Zaun am Fluss zusieht"


def documents(spark, rows):
    """``rows``: (doc_id, text, lang, source)."""
    return spark.createDataFrame([(i, t, g, s, None if t is None else len(t)) for i, t, g, s in rows], SCHEMA)


def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties."""
    return documents(
        spark,
        [
            (1, ENGLISH, "en", "a"), (1, ENGLISH, "en", "a"), (2, GERMAN, "de", "b"), (3, None, "en", "a"), (4, "", None, None), (None, ENGLISH + " indeed", "en", None), (None, None, None, None),
            (5, " \n\t ", "", "b"), (6, "word " * 30_000 + "end", "en", "b"), (7, "%%% *** 123", "xx-long-tag", "c"), (8, GERMAN.upper(), None, "c"), (9, ENGLISH, "en", "c"),
        ],
    )


def with_extra(df):
    """Columns that could clash with an operator's own."""
    from pyspark.sql import functions as F

    for name in ("copy", "rate", "n_tokens", "score", "keep", "id", "h", "arc", "predicted", "gone_id", "seen", "mix_n", "t_", "media", "label", "hi"):
        df = df.withColumn(name, F.lit(name))
    return df


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


__all__ = ["Row", "documents", "odd", "with_extra", "rows", "empty"]
