"""Lexicon sentiment of short texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.projections import require_keys
from millrace.functions.scalars import clean_text, parse_tweet_time, trim_token
from millrace.operators.bounded import MAX_BROADCAST_BYTES, plan_bytes
from millrace.operators.joins import lexicon_join, token_tasks
from millrace.schemas import TWEET


def read_tweets(lines: DataFrame, column: str = "value") -> DataFrame:
    """Tweets with all required fields and their time."""
    whole = require_keys(lines, TWEET.fieldNames(), column)
    parsed = whole.select(F.from_json(column, TWEET).alias("t")).select("t.*")
    return parsed.withColumn("ts", parse_tweet_time(F.col("created_at")))


def _mood(score: Column) -> Column:
    return F.when(score > 0, "Positive").when(score < 0, "Negative").otherwise("Neutral")


def sentiment_score(tweets: DataFrame, lexicon: DataFrame, ident: str = "id_str", text: str = "text") -> DataFrame:
    """Sum of the word scores of each text and its sign.

    A word list of bounded size is broadcast, a larger one meets each word of a text once, with its number.
    Per-text sums are formed before the exchange. A text without a scored word keeps its row.
    """
    tasks = None
    if not tweets.isStreaming and plan_bytes(lexicon) > MAX_BROADCAST_BYTES:
        # The words of a text are counted where the text is.
        tasks = token_tasks(tweets)
        tweets = tweets.select(ident, text).repartition(tasks, ident)
    words = tweets.select(ident, F.explode_outer(F.split(clean_text(F.col(text)), " ")).alias("word"))
    words = words.withColumn("word", trim_token(F.col("word")))
    scored = lexicon_join(words, lexicon, "left", "__n", tasks)
    total = F.sum(F.coalesce(F.col("score"), F.lit(0)) * F.col("__n")).cast("bigint")
    return scored.groupBy(ident).agg(total.alias("score")).select(
        ident, "score", _mood(F.col("score")).alias("sentiment")
    )


# Scorers by name; each takes texts and a lexicon.
CLASSIFIERS: dict[str, Callable[..., DataFrame]] = {"basic": sentiment_score}


def classify(name: str, tweets: DataFrame, lexicon: DataFrame, **options) -> DataFrame:
    """Score with a registered classifier."""
    if name not in CLASSIFIERS:
        raise ValueError(f"unknown classifier '{name}'")
    return CLASSIFIERS[name](tweets, lexicon, **options)
