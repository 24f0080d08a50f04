"""Exact medians of running and sliding ranges of rows, per key, without a step per row.

Every row asks for the middle of a range of rows. All ranges are answered together, one bit of the
rank at a time: the rows' ranks are parted by a bit, lower half first, and prefix counts carry every
range into the half that holds its middle. That is as many passes over whole arrays as a rank has
bits, whatever the ranges are.

A key too large for one task is cut along its order. Within a bucket the median moves only a few
ranks away from where it was when the bucket began: at most half the number of its rows. So a bucket
needs the earlier values around their middle, about as many as it has rows itself, and the number
below these:

1. Counts per (key, bucket, bin of values) say which bins hold that part for each bucket.
2. The earlier rows of these bins join the bucket that asks for them.
3. Each bucket answers its rows over what it was handed and its own rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators import ordered
from millrace.operators.ordered import (
    BUCKET,
    HALO,
    cut,
    drop_lookback,
    fold_sorted,
    map_sorted,
    null_safe_join,
    with_lookback,
)

_BIN = "__bin"
#: Bins of values to a bucket of rows: finer bins hand over less that is not needed.
_BINS = 4


def ranks_in_ranges(ranks, left, right, k):
    """The k-th smallest (from 0) of ``ranks[left:right]`` for every query; ranks are distinct."""
    import numpy as np

    now, found = ranks, np.zeros(len(k), np.int64)
    for bit in reversed(range(max(1, int(len(ranks) - 1).bit_length()))):
        ones = (now >> bit & 1).astype(bool)
        zeros = np.concatenate([[0], np.cumsum(~ones)])
        at_left, at_right = zeros[left], zeros[right]
        lower = at_right - at_left
        up = k >= lower
        found |= up.astype(np.int64) << bit
        left = np.where(up, zeros[-1] + left - at_left, at_left)
        right = np.where(up, zeros[-1] + right - at_right, at_right)
        k = np.where(up, k - lower, k)
        now = np.concatenate([now[~ones], now[ones]])
    return found


def medians_of_ranges(values, known, left, right, below=0, more=0):
    """Median of the known ``values[left:right]`` of every query, and whether it has one.

    NaN is the largest number. ``more`` further values belong to a query, of which ``below`` are smaller
    than all others of its range.
    """
    import numpy as np

    order = np.lexsort((values, ~known))
    ranks = np.empty(len(values), np.int64)
    ranks[order] = np.arange(len(values))
    counted = np.concatenate([[0], np.cumsum(known)])
    n = counted[right] - counted[left] + more
    some = n > 0
    low = np.where(some, (n - 1) // 2 - below, 0)
    out = np.full(len(n), np.nan)
    asked = np.nonzero(some)[0]
    out[asked] = values[order[ranks_in_ranges(ranks, left[asked], right[asked], low[asked])]]
    even = np.nonzero(some & (n % 2 == 0))[0]
    high = values[order[ranks_in_ranges(ranks, left[even], right[even], low[even] + 1)]]
    same = out[even] == high
    with np.errstate(invalid="ignore"):
        out[even] = np.where(same, high, (out[even] + high) / 2)
    return out, some


def _numbers(column):
    """The values of an Arrow column as doubles, and which are not null."""
    import numpy as np
    import pyarrow as pa

    known = np.asarray(column.is_valid())
    values = column.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    return values, known


def _with_column(batch, drop: Sequence[str], name: str, values, known):
    import pyarrow as pa

    kept = [c for c in batch.schema.names if c not in drop]
    columns = [*[batch.column(c) for c in kept], pa.array(values, mask=~known)]
    return pa.RecordBatch.from_arrays(columns, names=[*kept, name])


def _schema(df: DataFrame, columns: Sequence[str], name: str) -> T.StructType:
    return T.StructType([*[df.schema[c] for c in columns], T.StructField(name, T.DoubleType())])


def sliding_median(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, n: int, rows: int | None = None
) -> DataFrame:
    """Add the median of the key's last ``n`` rows; missing values do not count, null if all are missing."""

    def step(batch, starts):
        import numpy as np

        values, known = _numbers(batch.column(value))
        right = np.arange(1, len(values) + 1)
        first = np.repeat(starts, np.diff(np.append(starts, len(values))))
        middle, some = medians_of_ranges(values, known, np.maximum(first, right - n), right)
        return _with_column(batch, [], "sliding_median", middle, some)

    seen = with_lookback(df, keys, order, n - 1, rows)
    scope = [*keys, BUCKET]
    columns = list(dict.fromkeys([*scope, *seen.columns]))
    found = map_sorted(seen, scope, order, columns, step, _schema(seen, columns, "sliding_median"))
    return drop_lookback(found).select(*df.columns, "sliding_median")


def _handed(bucketed: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, rows: int) -> DataFrame:
    """(keys, bucket, value, below, more): the earlier values each bucket needs; some are always enough.

    ``more`` of the earlier values are not handed over, ``below`` of these are smaller than all that are.
    """
    n = len(keys)
    known = bucketed.where(F.col(value).isNotNull()).withColumnRenamed(BUCKET, "__time")
    binned, _ = cut(known, keys, [value, *order], max(1, rows // _BINS))
    binned = binned.withColumnRenamed(BUCKET, _BIN)
    # A bucket without any value asks as well.
    none = bucketed.groupBy(*keys, F.col(BUCKET).alias("__time")).agg(F.lit(0).alias(_BIN), F.lit(0).alias("__n"))
    each = binned.select(*keys, "__time", _BIN, F.lit(1).alias("__n")).unionByName(none)
    per_bin = each.groupBy(*keys, "__time", _BIN).agg(F.sum("__n").alias("__n"))
    sized = per_bin.withColumn("__rows", F.sum("__n").over(Window.partitionBy(*keys, "__time")))

    def ask(state, row):
        """Which bins of the earlier values a bucket needs; one summary row per (bucket, bin)."""
        import numpy as np

        bucket, this_bin, count, size = row[n:]
        out, bins = [], state.setdefault("bins", np.zeros(16, np.int64))
        if state.get("bucket") != bucket:
            state["bucket"] = bucket
            upto = np.cumsum(bins)
            total = int(upto[-1])
            if total:
                first, last = max(0, (total - size - 1) // 2), min(total - 1, (total + size) // 2)
                wanted = np.nonzero((bins > 0) & (upto > first) & (upto - bins <= last))[0]
                below = int(upto[wanted[0]] - bins[wanted[0]])
                more = total - int(bins[wanted].sum())
                out = [(*row[:n], int(b), bucket, below, more) for b in wanted]
        if this_bin >= len(bins):
            bins = state["bins"] = np.concatenate([bins, np.zeros(max(len(bins), this_bin), np.int64)])
        bins[this_bin] += count
        return out

    fields = "".join(f"`{k}` {bucketed.schema[k].dataType.simpleString()}, " for k in keys)
    asked = fold_sorted(
        sized, keys, ["__time", _BIN], dict, ask, None,
        f"{fields}{_BIN} int, {BUCKET} int, __below bigint, __more bigint", ["__time", _BIN, "__n", "__rows"],
    )
    met = null_safe_join(binned, asked, [*keys, _BIN]).where(F.col("__time") < F.col(BUCKET))
    return met.select(*keys, BUCKET, value, "__below", "__more")


def with_running_median(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    name: str = "running_median",
    current: bool = True,
    rows: int | None = None,
) -> DataFrame:
    """Add the median of the key's values up to each row, or before it; null if there is none.

    Missing values do not count. Keys with more than ``rows`` rows are cut; that never sets the result.
    """
    rows = rows or ordered.BUCKET_ROWS
    bucketed, several = cut(df, keys, order, rows)
    merged = bucketed.withColumn(BUCKET, F.col(BUCKET).cast("int")).withColumn(HALO, F.lit(False))
    extra = {"__below": "bigint", "__more": "bigint"}
    if several:
        merged = merged.unionByName(
            _handed(bucketed, keys, order, value, rows).withColumn(HALO, F.lit(True)), allowMissingColumns=True
        )
    else:
        for c, kind in extra.items():
            merged = merged.withColumn(c, F.lit(0).cast(kind))

    def step(batch, starts):
        import numpy as np
        import pyarrow as pa

        values, known = _numbers(batch.column(value))
        end = np.append(starts, len(values))
        first = np.repeat(starts, np.diff(end))
        right = np.arange(1, len(values) + 1) - (0 if current else 1)
        # What a bucket was handed comes first, so its first row tells what it was not.
        below, more = (batch.column(c).fill_null(0).to_numpy(zero_copy_only=False)[first] for c in extra)
        handed = np.asarray(batch.column(HALO))
        own = np.nonzero(~handed)[0]
        middle, some = np.full(len(values), np.nan), np.zeros(len(values), bool)
        middle[own], some[own] = medians_of_ranges(values, known, first[own], right[own], below[own], more[own])
        return _with_column(batch, list(extra), name, middle, some).filter(pa.array(~handed))

    scope = [*keys, BUCKET]
    columns = list(dict.fromkeys([*scope, *df.columns, HALO]))
    found = map_sorted(
        merged, scope, [F.desc(HALO), *order], [*columns, *extra], step, _schema(merged, columns, name)
    )
    return found.select(*df.columns, name)


def running_median(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, rows: int | None = None
) -> DataFrame:
    """Keys, order, value and the median of the key's values up to and including each row.

    Rows without a value are left out; NaN is above every number.
    """
    columns = list(dict.fromkeys([*keys, *order, value]))
    known = df.select(*columns).filter(F.col(value).isNotNull()).withColumn(value, F.col(value).cast("double"))
    return with_running_median(known, keys, order, value, rows=rows)


def seasonal_median(
    df: DataFrame, keys: Sequence[str], slot: str, value: str, slices: int, rows: int | None = None
) -> DataFrame:
    """Median of the same slice on earlier days; 0 where there is no earlier day.

    One row per key and slot is expected, so a slice has one row per day.
    """
    phased = df.withColumn("__phase", F.pmod(F.col(slot), F.lit(slices)))
    found = with_running_median(phased, [*keys, "__phase"], [slot], value, "seasonal_median", False, rows)
    return found.select(*df.columns, F.coalesce("seasonal_median", F.lit(0.0)).alias("seasonal_median"))
