"""Tables that every document operator must take."""

import pytest
from pyspark.sql import functions as F

LONG = "lorem ipsum dolor " * 20_000

#: Texts that every document operator must take: null, empty, blank, control characters, a very long one.
ODD_TEXTS = [None, "", " \t\n ", "\u0001\u0002 \x00", "é ñ\U0001f600 x", LONG, "a", "a"]


@pytest.fixture
def documents(spark):
    """(doc_id, text, lang, source, n_chars) from texts; more columns clash with names used inside."""

    def make(texts, clash=True, sources=None, ids=None):
        ids = list(range(len(texts))) if ids is None else ids
        sources = sources or [f"s{i % 3}" for i in range(len(texts))]
        rows = [(i, t, "en", s, len(t or "")) for i, t, s in zip(ids, texts, sources)]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        if clash:
            extra = "row rank word count kept fp fingerprint component_id spans start end kind piece length salt".split()
            df = df.select("*", *[F.lit("x").alias(c) for c in extra])
        return df.repartition(3)

    return make


@pytest.fixture
def odd(documents):
    """Odd texts, a null id, a null source and a repeated row."""
    df = documents(
        [*ODD_TEXTS, "same row", "same row"],
        ids=[0, 1, 2, 3, 4, 5, None, 7, 8, 8],
        sources=["s", None, "s", "s", None, "s", "s", "t", "t", "t"],
    )
    return df
