"""Grouped aggregates; all of them combine on the map side before the exchange."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.scalars import keep_fields, split_tokens
from millrace.operators.ordered import previous_row, with_position


def explode_words(lines: DataFrame, column: str = "line", pattern: str = " ") -> DataFrame:
    rest = [c for c in lines.columns if c != column]
    return lines.select(*rest, F.explode(split_tokens(F.col(column), pattern)).alias("word"))


def word_count(lines: DataFrame, column: str = "line", pattern: str = " ") -> DataFrame:
    words = explode_words(lines.select(column), column, pattern)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("count"))


def transition_counts(
    lines: DataFrame, column: str = "line", skip: int = 1, delim: str = ","
) -> DataFrame:
    """Counts of neighbouring states in delimited sequences, after ``skip`` leading fields."""
    states = F.slice(F.split(column, delim), skip + 1, 2_147_483_647)
    long_enough = lines.select(states.alias("states")).filter(F.size("states") >= 2)
    pairs = F.arrays_zip(
        F.slice("states", F.lit(1), F.size("states") - 1).alias("from_state"),
        F.slice("states", F.lit(2), F.size("states") - 1).alias("to_state"),
    )
    steps = long_enough.select(F.explode(pairs).alias("step")).select("step.from_state", "step.to_state")
    return steps.groupBy("from_state", "to_state").agg(F.count(F.lit(1)).alias("count"))


def group_items(
    df: DataFrame,
    key: str,
    fields: Sequence[int],
    column: str,
    order: Sequence[str],
    delim: str = ",",
) -> DataFrame:
    """The chosen fields of every row with its position inside its key, one row per item.

    The form for keys of any size: no key is gathered.
    """
    placed = with_position(df, [key], order)
    return placed.select(key, "position", keep_fields(F.col(column), fields, delim).alias("item"))


def group_concat(
    df: DataFrame,
    key: str,
    fields: Sequence[int],
    column: str,
    order: Sequence[str],
    delim: str = ",",
    out_delim: str = ",",
) -> DataFrame:
    """One line per key: the key followed by the chosen fields of its rows in order.

    A key becomes one value, so it must fit one row; ``group_items`` is the form without that bound.
    """
    items = group_items(df, key, fields, column, order, delim)
    lines = items.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("position", "item"))).alias("items"))
    return lines.select(key, F.concat_ws(out_delim, F.col(key).cast("string"), F.col("items.item")).alias("line"))


def neighbour_counts(items: DataFrame, key: str, order: Sequence[str], item: str) -> DataFrame:
    """Counts of neighbouring states of ordered records; no sequence is gathered, so none is cut."""
    seen = previous_row(items, [key], order, {item: "from_state"})
    steps = seen.filter(F.col("from_state").isNotNull()).withColumn("to_state", F.col(item))
    return steps.groupBy("from_state", "to_state").agg(F.count(F.lit(1)).alias("count"))


def contingency_table(df: DataFrame, row: str, column: str, amount: Column | None = None) -> DataFrame:
    """Counts per (row, column) with the row and column totals of each cell."""
    cells = df.groupBy(F.col(row).alias("row_label"), F.col(column).alias("col_label")).agg(
        F.sum(amount if amount is not None else F.lit(1)).cast("bigint").alias("value")
    )
    # Sums over the small cell table: the rows are read once, and a null label is a label.
    return cells.withColumn("row_sum", F.sum("value").over(Window.partitionBy("row_label"))).withColumn(
        "col_sum", F.sum("value").over(Window.partitionBy("col_label"))
    )


def contingency_wide(cells: DataFrame, col_labels: Sequence[str]) -> DataFrame:
    """The labelled matrix with one column per given label."""
    return cells.groupBy("row_label").pivot("col_label", list(col_labels)).agg(F.first("value")).na.fill(0)
