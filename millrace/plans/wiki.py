"""Statistics over wiki edit lines."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalars import WIKI_FLAG_NAMES, WIKI_PARTS, parse_wiki_line, wiki_flags
from millrace.operators.ordered import running_totals


def merge_all(streams: Sequence[DataFrame]) -> DataFrame:
    """Union of channels by column name."""
    return reduce(lambda a, b: a.unionByName(b), streams)


def parse_edits(events: DataFrame) -> DataFrame:
    """Typed edits; lines that do not match, or whose size is no number, are dropped.

    Exploding the one match of a line makes it a column of its own, evaluated once per line.
    """
    match = parse_wiki_line(F.col("raw"))
    kept = [c for c in events.columns if c != "raw"]
    parsed = events.select(*kept, F.explode(F.array_compact(F.array(match))).alias("__p"))
    part = {name: F.get("__p", F.lit(i)) for i, name in enumerate(WIKI_PARTS)}
    part["byte_diff"] = part["byte_diff"].try_cast("int")
    typed = parsed.select(*kept, *[c.alias(name) for name, c in part.items()])
    return typed.filter(F.col("byte_diff").isNotNull()).withColumn(
        "flag_map", wiki_flags(F.col("title"), F.col("flags"))
    )


def count_drops(events: DataFrame) -> DataFrame:
    """How many lines parse and how many are dropped, per channel."""
    size = F.get(parse_wiki_line(F.col("raw")), F.lit(WIKI_PARTS.index("byte_diff"))).try_cast("int")
    ok = size.isNotNull().cast("int")
    return events.groupBy("channel").agg(
        F.sum(ok).cast("bigint").alias("parsed"), F.sum(1 - ok).cast("bigint").alias("dropped")
    )


def _flag_column(name: str) -> str:
    return name.replace("-", "_")


def wiki_window_stats(edits: DataFrame, seconds: float = 10.0, compat_minus_one: bool = False) -> DataFrame:
    """Per window: edits, bytes added, distinct titles, repeat edits and a count per set flag.

    Counting per (window, title) first makes the distinct count a plain count, keeps no set of
    titles in one state row, and spreads a busy window over many tasks.
    """
    pane = f"{int(seconds * 1_000_000)} microseconds"
    flags = {_flag_column(n): F.sum(F.col("flag_map")[n].cast("int")) for n in WIKI_FLAG_NAMES}
    per_title = edits.groupBy(F.window("ts", pane).alias("pane"), "title").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("byte_diff").alias("bytes"),
        *[c.alias(name) for name, c in flags.items()],
    )
    total = per_title.groupBy(F.window(F.window_time("pane"), pane).alias("w")).agg(
        F.sum("n").cast("bigint").alias("edits"),
        F.sum("bytes").cast("bigint").alias("bytes_added"),
        F.count(F.lit(1)).alias("unique_titles"),
        *[F.sum(name).cast("bigint").alias(name) for name in flags],
    )
    less = 1 if compat_minus_one else 0
    counts = F.map_filter(
        F.create_map(*[x for n in WIKI_FLAG_NAMES for x in (F.lit(n), F.col(_flag_column(n)))]),
        lambda _, v: v > 0,
    )
    return total.select(
        F.col("w.start").alias("window_start"),
        F.col("w.end").alias("window_end"),
        "edits",
        "bytes_added",
        "unique_titles",
        (F.col("edits") - F.col("unique_titles")).alias("repeat_edits"),
        F.transform_values(counts, lambda _, v: v - less).alias("counts"),
    )


def edits_all_time(stats: DataFrame) -> DataFrame:
    """Add the number of edits up to the end of each window."""
    return running_totals(stats, [], ["window_start"], {"edits_all_time": F.col("edits")})


def wiki_stats(channels: Sequence[DataFrame], seconds: float = 10.0) -> DataFrame:
    """Channels to window statistics; on a table also with the all-time count."""
    stats = wiki_window_stats(parse_edits(merge_all(channels)), seconds)
    return stats if stats.isStreaming else edits_all_time(stats)
