"""A user's fold over groups and windows, with partial results.

A fold is four functions: ``init()`` gives a state, ``fold(state, *values)`` takes up a row, ``merge(a, b)``
joins two states and ``finish(state)`` gives the output values. Every task folds its own rows, one state
per key it meets; only states are shuffled, and the states of a key are merged as they arrive. So a key
that holds a third of all rows costs one state a task.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.operators.ordered import fold_sorted

#: States a task holds before it hands them on.
HELD_STATES = 20_000


@dataclass(frozen=True)
class Fold:
    """States are pickled, so they may be any Python value; ``merge`` may change its first argument."""

    init: Callable[[], object]
    fold: Callable[..., object]
    merge: Callable[[object, object], object]
    finish: Callable[[object], Sequence]


def _partial_states(df: DataFrame, keys: Sequence[str], columns: Sequence[str], fold: Fold) -> DataFrame:
    """(keys, state) of what each task has folded."""
    kind = T.StructType([*[df.schema[k] for k in keys], T.StructField("__state", T.BinaryType())])
    arrow = to_arrow_schema(kind)
    n = len(keys)

    def run(batches):
        import pyarrow as pa

        def handed(states):
            parts = [*zip(*states), [pickle.dumps(s) for s in states.values()]]
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(parts, arrow)], schema=arrow)

        states = {}
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in [*keys, *columns]]):
                key = row[:n]
                # NaN is no key of a dictionary; such rows are states of their own and meet at the merge.
                state = states[key] if key in states else fold.init()
                states[key] = fold.fold(state, *row[n:])
            if len(states) >= HELD_STATES:
                yield handed(states)
                states = {}
        if states:
            yield handed(states)

    named = [F.col(c) for c in keys] + [F.col(c).alias(f"__v{i}") for i, c in enumerate(columns)]
    columns = [f"__v{i}" for i in range(len(columns))]
    return df.select(*named).mapInArrow(run, kind)


def fold_groups(df: DataFrame, keys: Sequence[str], columns: Sequence[str], fold: Fold, schema: str) -> DataFrame:
    """The keys and the outputs (``schema``) of a fold over ``columns`` of each key's rows, in any order.

    Null keys are one key. Without keys there is one row, or none for an empty table.
    """
    held = list(keys) or ["__all"]
    rows = df if keys else df.withColumn("__all", F.lit(0))
    partial = _partial_states(rows, held, columns, fold)
    n = len(held)

    def step(state, row):
        other = pickle.loads(row[n])
        state[:] = [fold.merge(state[0], other)] if state else [other]
        return []

    def finish(state, key):
        return [(*key, *fold.finish(state[0]))]

    fields = "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in held)
    found = fold_sorted(partial, held, [], list, step, finish, f"{fields}{schema}", ["__state"])
    return found if keys else found.drop("__all")


def fold_windows(
    df: DataFrame, keys: Sequence[str], seconds: float, columns: Sequence[str], fold: Fold, schema: str, ts: str = "ts"
) -> DataFrame:
    """A fold over each key's rows of every tumbling window: keys, window_start, window_end and the outputs."""
    size = round(seconds * 1_000_000)
    pane = F.floor(F.unix_micros(ts) / size) * size
    found = fold_groups(df.withColumn("__pane", pane), [*keys, "__pane"], columns, fold, schema)
    return found.select(
        *keys,
        F.timestamp_micros("__pane").alias("window_start"),
        F.timestamp_micros(F.col("__pane") + size).alias("window_end"),
        *T._parse_datatype_string(schema).names,
    )
