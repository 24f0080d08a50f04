"""Markov-chain training and scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators.joins import transition_lookup
from millrace.operators.ordered import (
    drop_lookback,
    lookback_window,
    previous_row,
    running_totals,
    with_lookback,
)

WINDOW = 5
THRESHOLD = 0.96


def _state_grid(spark: SparkSession, states: Sequence[str]) -> DataFrame:
    """All ordered pairs of a short literal list of states."""
    names = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s).alias("s")) for i, s in enumerate(states)])
    grid = spark.range(1).select(F.explode(names).alias("f")).select("f", F.explode(names).alias("t"))
    return grid.select(
        F.col("f.i").alias("from_no"), F.col("f.s").alias("from_state"),
        F.col("t.i").alias("to_no"), F.col("t.s").alias("to_state"),
    )


def transition_probability(counts: DataFrame, states: Sequence[str], scale: int = 1) -> DataFrame:
    """Row-normalised transition table over the given states.

    A row with an empty cell gets one added to every cell. ``scale`` 1 gives fractions, a larger
    one whole numbers ``count * scale / row sum``. A count of a state that is not in ``states`` makes
    the query fail.
    """
    known = F.col("from_state").isin(*states) & F.col("to_state").isin(*states)
    unknown = F.concat(F.lit("transition between unknown states: "), F.concat_ws(" -> ", "from_state", "to_state"))
    counts = counts.withColumn("count", F.when(known, F.col("count")).otherwise(F.raise_error(unknown)))
    cells = _state_grid(counts.sparkSession, states).join(counts, ["from_state", "to_state"], "left")
    cells = cells.withColumn("count", F.coalesce(F.col("count"), F.lit(0)).cast("bigint"))
    row = Window.partitionBy("from_state")
    smooth = F.col("count") + F.when(F.min("count").over(row) == 0, 1).otherwise(0)
    cells = cells.withColumn("count", smooth)
    total = F.sum("count").over(row)
    p = F.col("count") / total if scale == 1 else F.floor(F.col("count") * scale / total)
    return cells.withColumn("p", p).select("from_no", "from_state", "to_no", "to_state", "p")


def model_lines(model: DataFrame, states: Sequence[str]) -> DataFrame:
    """The text form: a header of states, then one line of values per state."""
    rows = model.groupBy("from_no").agg(
        F.array_sort(F.collect_list(F.struct("to_no", F.col("p").cast("string").alias("p")))).alias("cells")
    )
    body = rows.select((F.col("from_no") + 1).alias("line_no"), F.concat_ws(",", "cells.p").alias("value"))
    header = model.sparkSession.range(1).select(
        F.lit(0).alias("line_no"), F.lit(",".join(states)).alias("value")
    )
    return header.unionByName(body)


def state_steps(
    records: DataFrame, entity: str, order: Sequence[str], state: str
) -> DataFrame:
    """State changes per entity, without gathering an entity's sequence."""
    seen = previous_row(records, [entity], order, {state: "from_state"})
    return seen.withColumn("to_state", F.col(state)).filter(F.col("from_state").isNotNull())


def train_markov(
    records: DataFrame, states: Sequence[str], entity: str, order: Sequence[str], state: str, scale: int = 1
) -> DataFrame:
    """Transition table of ordered state records, in one distributed pass."""
    steps = state_steps(records, entity, order, state)
    counts = steps.groupBy("from_state", "to_state").agg(F.count(F.lit(1)).alias("count"))
    return transition_probability(counts, states, scale)


def _penalties(model: DataFrame, algorithm: str) -> DataFrame:
    """What each change adds to the score, from a model table of one row per pair of states."""
    row = Window.partitionBy("from_state")
    if algorithm == "missProbability":
        cost: Column = F.sum("p").over(row) - F.col("p")
    elif algorithm == "missRate":
        first_best = F.max_by("to_no", F.struct(F.col("p"), -F.col("to_no"))).over(row)
        cost = F.when(F.col("to_no") == first_best, 0.0).otherwise(1.0)
    elif algorithm == "entropyReduction":
        cost = F.sum(-F.col("p") * F.log("p")).over(row)
    else:
        raise ValueError(f"no penalty is defined for algorithm {algorithm!r}")
    return model.withColumn("penalty", cost).select("from_state", "to_state", "penalty")


def markov_window(
    records: DataFrame, entity: str, order: Sequence[str], state: str, n: int = WINDOW
) -> DataFrame:
    """The last ``n`` states of the entity at each record (fewer at its start)."""
    seen = with_lookback(records, [entity], order, n - 1)
    w = lookback_window([entity], order).rowsBetween(-(n - 1), 0)
    return drop_lookback(seen.withColumn("states", F.collect_list(state).over(w)))


def markov_score(
    records: DataFrame,
    model: DataFrame,
    entity: str = "entity",
    order: Sequence[str] = ("ts", "event_id"),
    state: str = "state",
    algorithm: str = "missProbability",
    n: int = WINDOW,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Mean penalty over the changes in the last ``n`` states; 0 until there are ``n`` of them.

    A change that the model does not know adds nothing, here as in the stream form.
    """
    order = list(order)
    seen = with_lookback(records, [entity], order, n - 1)
    by_entity = lookback_window([entity], order)
    changes = seen.withColumn("from_state", F.lag(state).over(by_entity)).withColumn("to_state", F.col(state))
    priced = transition_lookup(changes, _penalties(model, algorithm), ["penalty"])
    steps = by_entity.rowsBetween(-(n - 2), 0)
    full = F.count(state).over(by_entity.rowsBetween(-(n - 1), 0)) == n
    scored = drop_lookback(
        priced.withColumn("states", F.collect_list(state).over(by_entity.rowsBetween(-(n - 1), 0)))
        .withColumn("score", F.when(full, F.coalesce(F.sum("penalty").over(steps), F.lit(0.0)) / (n - 1)).otherwise(0.0))
    )
    return scored.select(
        F.col(entity).alias("entity"), *order, "states", "score", (F.col("score") > threshold).alias("outlier")
    )


def markov_score_global(
    records: DataFrame,
    model: DataFrame,
    entity: str = "entity",
    order: Sequence[str] = ("ts", "event_id"),
    state: str = "state",
    algorithm: str = "missProbability",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Penalty per change over everything the entity has done so far."""
    order = list(order)
    seen = previous_row(records, [entity], order, {state: "from_state"})
    priced = transition_lookup(
        seen.withColumn("to_state", F.col(state)), _penalties(model, algorithm), ["penalty"]
    )
    changed = F.col("from_state").isNotNull()
    totals = {"__cost": F.coalesce("penalty", F.lit(0.0)), "__steps": changed.cast("bigint")}
    running = running_totals(priced, [entity], order, totals)
    score = F.when(F.col("__steps") > 0, F.col("__cost") / F.col("__steps")).otherwise(0.0)
    return running.withColumn("score", score).select(
        F.col(entity).alias("entity"), *order, "score", (F.col("score") > threshold).alias("outlier")
    )
