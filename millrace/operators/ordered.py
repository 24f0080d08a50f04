"""Ordered per-key computation that does not place a large key in one task.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task, so a key that holds a
third of a table stops the job. ``cut`` counts the rows of every key first. Where no key has more
than ``BUCKET_ROWS`` rows the plain window is right and is used. Else each large key is cut along
its order into buckets of about equal depth, and ``(key, bucket)`` is the unit of work. What a
bucket needs from its past is small, about one row per (key, bucket):

* ``running_totals``  sums over all earlier rows  -> totals of the earlier buckets
* ``latest_before``   a "last value seen so far"  -> last value of the earlier buckets
* ``with_lookback``   the previous ``k`` rows      -> at most ``k`` copied rows per bucket

The side rows are put into the stream by a union, so the table itself is shuffled once.

Cuts are order values of rows chosen by a hash, written to the shared folder once; so a bucket is a
function of the row, the same on every retry of a task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.operators.bounded import broadcast_if_small
from millrace.session import shared_path

BUCKET = "__bucket"
HALO = "__halo"

#: A bucket has half as many rows on average, and more than these about once in 300,000 buckets.
BUCKET_ROWS = 200_000
#: Order values looked at per cut.
_SAMPLED = 32
#: Tasks of a sequential fold, at least. A row takes time there and few bytes, so adaptive execution would put
#: many keys into one task; a few dozen large keys fall apart into as many tasks.
FOLD_TASKS = 200


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, null equal to null; the other columns of both sides must differ in name."""
    named = right.select(*[F.col(c).alias(f"__k{keys.index(c)}") if c in keys else F.col(c) for c in right.columns])
    meets = F.lit(True)
    for i, k in enumerate(keys):
        meets = meets & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return left.join(named, meets, how).drop(*[f"__k{i}" for i in range(len(keys))])


def _cuts_at_or_before(cuts: Column, at: Column, most: int) -> Column:
    """How many of the sorted ``cuts`` are not above ``at``, by bisection; there are at most ``most``."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(most.bit_length()))])

    def further(low: Column, step: Column) -> Column:
        return F.when(F.try_element_at(cuts, low + step) <= at, low + step).otherwise(low)

    return F.aggregate(steps, F.lit(0), further)


def cut(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int | None = None) -> tuple[DataFrame, bool]:
    """Add the bucket of each row; also tell whether any key has more than one.

    Along ``order`` a key's buckets never go back, and rows equal in all of ``order`` share one. The
    counts are one aggregation over the key columns, run here; cuts are made only for a large key.
    """
    rows = rows or BUCKET_ROWS
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    if (counts.agg(F.max("__n")).first()[0] or 0) <= rows:
        return df.withColumn(BUCKET, F.lit(0)), False
    share = min(1 << 30, int(2 * _SAMPLED / rows * (1 << 30)) + 1)
    at = F.struct(*order)
    chosen = df.where(F.pmod(F.xxhash64(*keys, *order), F.lit(1 << 30)) < share).select(*keys, at.alias("__at"))
    along = F.row_number().over(Window.partitionBy(*keys).orderBy("__at"))
    cuts = chosen.withColumn("__no", along).where(F.col("__no") % _SAMPLED == 0)
    cuts = cuts.groupBy(*keys).agg(F.array_sort(F.collect_list("__at")).alias("__cuts"))
    # As a table its size is known, so that it is broadcast if it is small.
    path = shared_path(df.sparkSession, "cuts")
    cuts.write.parquet(path)
    cuts = df.sparkSession.read.schema(cuts.schema).parquet(path)
    most = cuts.agg(F.max(F.size("__cuts"))).first()[0] or 0
    bucket = F.coalesce(_cuts_at_or_before(F.col("__cuts"), at, max(most, 1)), F.lit(0))
    if keys:
        placed = null_safe_join(df, broadcast_if_small(cuts), keys, "left")
    else:
        placed = df.withColumn("__cuts", cuts.select("__cuts").scalar())
    return placed.select(*df.columns, bucket.alias(BUCKET)), True


def with_carry(rows: DataFrame, carry: DataFrame) -> DataFrame:
    """Put one marker row in front of each (key, bucket), holding what its past adds up to.

    A union instead of a join: the rows are shuffled once, and a null key keeps its history.
    """
    marked = carry.withColumn(HALO, F.lit(True))
    return rows.withColumn(HALO, F.lit(False)).unionByName(marked, allowMissingColumns=True)


def _upto(scope: Sequence[str], order: Sequence[str | Column]):
    """Rows of a key or bucket in order, up to and including each."""
    return Window.partitionBy(*scope).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def running_totals(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], totals: dict[str, Column], rows: int | None = None
) -> DataFrame:
    """Add cumulative sums per key in the given order."""
    return totals_of(*cut(df, keys, order, rows), keys, order, totals)


def totals_of(
    bucketed: DataFrame, several: bool, keys: Sequence[str], order: Sequence[str], totals: dict[str, Column]
) -> DataFrame:
    """Cumulative sums over rows that ``cut`` has given their bucket."""
    columns = [c for c in bucketed.columns if c != BUCKET]
    if not several:
        along = _upto([*keys, BUCKET], order)
        sums = [F.coalesce(F.sum(e).over(along), F.lit(0)).alias(n) for n, e in totals.items()]
        return bucketed.select(*columns, *sums)
    scope = [*keys, BUCKET]
    inputs = {name: f"__in_{i}" for i, name in enumerate(totals)}
    for name, expr in totals.items():
        bucketed = bucketed.withColumn(inputs[name], expr)

    sums = bucketed.groupBy(*scope).agg(*[F.sum(c).alias(c) for c in inputs.values()])
    earlier = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(*scope, *[F.sum(c).over(earlier).alias(c) for c in inputs.values()])

    along = _upto(scope, [F.col(HALO).desc(), *order])
    return (
        with_carry(bucketed, carry)
        .select(
            *columns, HALO, *[F.coalesce(F.sum(c).over(along), F.lit(0)).alias(n) for n, c in inputs.items()]
        )
        .filter(~F.col(HALO))
        .drop(HALO)
    )


def with_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "position", rows: int | None = None
) -> DataFrame:
    """Add the 1-based position of each row inside its key."""
    return running_totals(df, keys, order, {name: F.lit(1).cast("bigint")}, rows)


def latest_before(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column], rows: int | None = None
) -> DataFrame:
    """Add the newest non-null of each value at or before each row of the key."""
    bucketed, several = cut(df, keys, order, rows)
    if not several:
        along = _upto([*keys, BUCKET], order)
        seen = [F.last(e, ignorenulls=True).over(along).alias(n) for n, e in values.items()]
        return bucketed.select(*df.columns, *seen)
    scope = [*keys, BUCKET]
    inputs = {name: f"__in_{i}" for i, name in enumerate(values)}
    for name, expr in values.items():
        bucketed = bucketed.withColumn(inputs[name], expr)

    ends = bucketed.groupBy(*scope).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in inputs.values()]
    )
    earlier = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(
        *scope, *[F.last(c, ignorenulls=True).over(earlier).alias(c) for c in inputs.values()]
    )

    along = _upto(scope, [F.col(HALO).desc(), *order])
    return (
        with_carry(bucketed, carry)
        .select(
            *df.columns, HALO, *[F.last(c, ignorenulls=True).over(along).alias(n) for n, c in inputs.items()]
        )
        .filter(~F.col(HALO))
        .drop(HALO)
    )


def with_lookback(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int, rows: int | None = None
) -> DataFrame:
    """Copy the last ``k`` rows before each (key, bucket) into it, marked in ``__halo``.

    A window function over ``lookback_window`` with a frame of at most ``k`` preceding rows
    then sees the same rows as one over the whole key; ``drop_lookback`` removes the copies.
    Where no key is cut there is nothing to copy.
    """
    bucketed, several = cut(df, keys, order, rows)
    marked = bucketed.withColumn(HALO, F.lit(False))
    if not several or k < 1:
        return marked
    scope = [*keys, BUCKET]
    # row_number() <= k is applied before the exchange (window group limit): k rows per task.
    newest = Window.partitionBy(*scope).orderBy(*[F.col(c).desc() for c in order])
    tails = bucketed.withColumn("__rank", F.row_number().over(newest)).filter(F.col("__rank") <= k)
    payload = [c for c in df.columns if c not in keys]
    packed = tails.groupBy(*scope).agg(F.collect_list(F.struct("__rank", *payload)).alias("__tail"))
    # The buckets that follow, each with the number of rows between, counted up to k in every one.
    by_bucket = Window.partitionBy(*keys).orderBy(BUCKET)
    upto = F.sum(F.size("__tail")).over(by_bucket.rowsBetween(Window.unboundedPreceding, 0))
    packed = packed.withColumn("__upto", upto).withColumn("__start", F.col("__upto") - F.size("__tail"))
    ahead = F.collect_list(F.struct(BUCKET, "__start")).over(by_bucket.rowsBetween(1, k))
    reached = F.filter("__ahead", lambda b: b["__start"] - F.col("__upto") < k)
    halo = (
        packed.withColumn("__ahead", ahead)
        .select(*keys, "__tail", "__upto", F.explode(reached).alias("__to"))
        .withColumn("__left", k - (F.col("__to.__start") - F.col("__upto")))
        .select(*keys, "__to", F.explode(F.filter("__tail", lambda t: t["__rank"] <= F.col("__left"))).alias("__row"))
        .select(
            *[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in df.columns],
            F.col(f"__to.{BUCKET}").alias(BUCKET),
            F.lit(True).alias(HALO),
        )
    )
    return marked.unionByName(halo)


def lookback_window(keys: Sequence[str], order: Sequence[str]):
    """The window to use on the result of ``with_lookback``."""
    return Window.partitionBy(*keys, BUCKET).orderBy(*order)


def drop_lookback(df: DataFrame) -> DataFrame:
    return df.filter(~F.col(HALO)).drop(HALO, BUCKET)


def previous_row(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: dict[str, str], rows: int | None = None
) -> DataFrame:
    """Add, per key, the given columns of the row before (null on the first row).

    The last row of each (key, bucket) is one hash aggregate; it becomes the marker row of the
    next bucket that has rows.
    """
    bucketed, several = cut(df, keys, order, rows)
    scope = [*keys, BUCKET]
    if not several:
        along = Window.partitionBy(*scope).orderBy(*order)
        return bucketed.select(*df.columns, *[F.lag(c).over(along).alias(n) for c, n in columns.items()])
    wanted = list(dict.fromkeys([*order, *columns]))
    ends = bucketed.groupBy(*scope).agg(F.max_by(F.struct(*wanted), F.struct(*order)).alias("__end"))
    by_key = Window.partitionBy(*keys).orderBy(BUCKET)
    carry = ends.select(*scope, F.lag("__end").over(by_key).alias("__end")).filter(F.col("__end").isNotNull())
    markers = carry.select(*scope, *[F.col(f"__end.{c}").alias(c) for c in wanted if c not in scope])

    along = Window.partitionBy(*scope).orderBy(F.col(HALO).desc(), *order)
    return (
        with_carry(bucketed, markers)
        .select(*df.columns, HALO, *[F.lag(c).over(along).alias(n) for c, n in columns.items()])
        .filter(~F.col(HALO))
        .drop(HALO)
    )


def python_values(column) -> list:
    """The values of an Arrow column as Python objects; by way of numpy, which is faster, where that keeps them."""
    import pyarrow as pa

    kind = column.type
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        return column.to_numpy(zero_copy_only=False).tolist()
    # Beside nulls numpy would make floats of whole numbers.
    if not column.null_count and (pa.types.is_integer(kind) or pa.types.is_float64(kind)):
        return column.to_numpy().tolist()
    return column.to_pylist()


def fold_sorted(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    start: Callable[[], object],
    step: Callable[[object, tuple], list[tuple]],
    finish: Callable[[object, tuple], list[tuple]] | None,
    schema: str,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Run a sequential state machine over each key's rows in order.

    For logic whose every step depends on the one before (an order book). Rows arrive sorted
    and are read as a stream of Arrow batches, so a task holds one key's state and one batch,
    never a group. ``step(state, row)`` gets the keys and then ``columns``; it and
    ``finish(state, key)`` return output tuples.
    """
    columns = [*keys, *[c for c in (columns or df.columns) if c not in keys]]
    width = len(keys)
    fields = T._parse_datatype_string(schema).fields
    names = [f.name for f in fields]
    # Times cross to Python as whole microseconds: cheaper than time objects, and exact.
    is_time = {f.name for f in fields if isinstance(f.dataType, T.TimestampType)}
    carried = T.StructType(
        [T.StructField(f.name, T.LongType() if f.name in is_time else f.dataType) for f in fields]
    )

    def sent(c: str) -> Column:
        return F.unix_micros(c).alias(c) if isinstance(df.schema[c].dataType, T.TimestampType) else F.col(c)

    arrow = to_arrow_schema(carried)

    def run(batches):
        import pyarrow as pa

        def packed(rows):
            parts = [pa.array(c, type=f.type) for c, f in zip(zip(*rows), arrow)]
            return pa.RecordBatch.from_arrays(parts, schema=arrow)

        key, state = None, None
        for batch in batches:
            out = []
            # Arrow keeps every value as it is: 64-bit numbers stay whole beside nulls.
            for row in zip(*[python_values(batch.column(c)) for c in columns]):
                if key is None or row[:width] != key:
                    if key is not None and finish is not None:
                        out.extend(finish(state, key))
                    key, state = row[:width], start()
                out.extend(step(state, row))
            if out:
                yield packed(out)
        if key is not None and finish is not None:
            out = finish(state, key)
            if out:
                yield packed(out)

    tasks = max(FOLD_TASKS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return (
        df.select(*dict.fromkeys([*columns, *order]))
        .repartition(tasks, *[F.col(k) for k in keys])
        .sortWithinPartitions(*keys, *order)
        .select(*[sent(c) for c in columns])
        .mapInArrow(run, carried)
        .select(*[F.timestamp_micros(n).alias(n) if n in is_time else F.col(n) for n in names])
    )


def _changes(batch, columns: Sequence[str]):
    """Where a row of a record batch differs from the one before in any of the columns, as row numbers."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    out = np.zeros(max(batch.num_rows - 1, 0), bool)
    for c in columns:
        values = batch.column(c)
        now, before = values.slice(1), values.slice(0, len(values) - 1)
        differs = pc.fill_null(pc.not_equal(now, before), False)
        differs = pc.or_(differs, pc.xor(pc.is_null(now), pc.is_null(before)))
        if pa.types.is_floating(values.type):
            both = pc.and_(pc.fill_null(pc.is_nan(now), False), pc.fill_null(pc.is_nan(before), False))
            differs = pc.and_not(differs, both)
        out |= np.asarray(differs)
    return np.nonzero(out)[0] + 1


def map_sorted(
    df: DataFrame,
    scope: Sequence[str],
    order: Sequence[str | Column],
    columns: Sequence[str],
    step: Callable[[object, object], object],
    schema: str,
) -> DataFrame:
    """Run ``step(record batch, starts)`` over whole groups of sorted rows.

    The batch holds ``columns`` of one or more whole groups of ``scope``, one after the other, and
    ``starts`` the first row of each. A task holds the rows of one group and of one Arrow batch, so
    groups must have a bounded size: keys, or keys and their bucket.
    """
    columns = list(dict.fromkeys([*scope, *columns]))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # Only the last group can go on in the next batch.
            changes = _changes(batch, scope)
            if held:
                seam = pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch.slice(0, 1)])
                joins = not len(_changes(seam.combine_chunks().to_batches()[0], scope))
                if joins and not len(changes):
                    held.append(batch)
                    continue
            last = int(changes[-1]) if len(changes) else 0
            whole = [*held, batch.slice(0, last)]
            held = [batch.slice(last)]
            if sum(b.num_rows for b in whole):
                done = pa.Table.from_batches(whole).combine_chunks().to_batches()[0]
                yield step(done, np.concatenate([[0], _changes(done, scope)]))
        if held:
            done = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            yield step(done, np.concatenate([[0], _changes(done, scope)]))

    return (
        df.repartition(*[F.col(k) for k in scope])
        .sortWithinPartitions(*scope, *order)
        .select(*columns)
        .mapInArrow(run, schema)
    )
