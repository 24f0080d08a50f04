"""Time-bounded and lookup joins."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.bounded import MAX_BROADCAST_BYTES, broadcast_if_small, plan_bytes
from millrace.operators.nearest import nearest_of_many
from millrace.operators.ordered import latest_before

_SLOT = "__slot"


def _slot(ts: Column, micros: int) -> Column:
    return F.floor(F.unix_micros(ts) / micros)


def interval_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[tuple[str, str]],
    ttl: float,
    left_ts: str = "ts",
    right_ts: str = "ts",
) -> DataFrame:
    """Every pair of rows with equal keys and less than ``ttl`` seconds between them.

    The time band is also an equality on a time slot, with the right side copied into the one
    or two slots it can reach. So a hot key is spread over its slots, and a join without keys
    is still a hash join. On streams both sides need a watermark; the band lets state expire.
    Column names of the two sides must differ except for the time column.
    """
    reach = int(ttl * 1_000_000)
    band = 2 * reach
    l_side = left.withColumnRenamed(left_ts, "__l_ts").withColumn(_SLOT, _slot(F.col("__l_ts"), band))
    micros = F.unix_micros("__r_ts")
    slots = F.sequence(F.floor((micros - reach) / band), F.floor((micros + reach) / band))
    r_side = right.withColumnRenamed(right_ts, "__r_ts").withColumn("__r_slot", F.explode(slots))

    span = F.expr(f"INTERVAL {reach} MICROSECONDS")
    condition = (F.col(_SLOT) == F.col("__r_slot")) & (F.col("__l_ts") > F.col("__r_ts") - span)
    condition = condition & (F.col("__l_ts") < F.col("__r_ts") + span)
    for l_key, r_key in keys:
        condition = condition & (l_side[l_key] == r_side[r_key])
    joined = l_side.join(r_side, condition, "inner")
    return (
        joined.drop(_SLOT, "__r_slot")
        .withColumnRenamed("__l_ts", "left_ts")
        .withColumnRenamed("__r_ts", "right_ts")
    )


def latest_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    ttl: float,
    ts: str = "ts",
    tie: str = "id",
) -> DataFrame:
    """Each arrival meets the newest row of the other side with its key, if younger than ``ttl``.

    Both inputs carry ``keys``, ``ts`` and ``tie``. The result has one row per arrival that found
    a partner: the keys, ``left`` and ``right`` (structs of the two rows) and the arrival time.
    Rows at the same instant count as left before right, then by ``tie``.
    """
    l_cols = [c for c in left.columns if c not in keys]
    r_cols = [c for c in right.columns if c not in keys]
    l_rows = left.select(
        *keys, F.col(ts).alias("__ts"), F.lit(0).alias("__side"), F.col(tie).alias("__tie"),
        F.struct(*l_cols).alias("__left"),
    )
    r_rows = right.select(
        *keys, F.col(ts).alias("__ts"), F.lit(1).alias("__side"), F.col(tie).alias("__tie"),
        F.struct(*r_cols).alias("__right"),
    )
    merged = l_rows.unionByName(r_rows, allowMissingColumns=True)
    order = ["__ts", "__side", "__tie"]
    newest = {"__left_seen": F.col("__left"), "__right_seen": F.col("__right")}
    seen = latest_before(merged, keys, order, newest)
    young = F.unix_micros("__ts") - int(ttl * 1_000_000)
    other_ts = F.when(F.col("__side") == 0, F.col(f"__right_seen.{ts}")).otherwise(F.col(f"__left_seen.{ts}"))
    return seen.filter(F.unix_micros(other_ts) > young).select(
        *keys,
        F.col("__left_seen").alias("left"),
        F.col("__right_seen").alias("right"),
        F.col("__side").alias("arrived_side"),
        F.col("__ts").alias("arrived_at"),
    )


def q3_local_items(persons: DataFrame, auctions: DataFrame, ttl: float = 3.0) -> DataFrame:
    """Items offered by people of the local states."""
    from millrace.functions.projections import person_state_filter

    local = person_state_filter(persons).withColumnRenamed("id", "person_id")
    offers = auctions.select(F.col("id").alias("auction_id"), "seller", "ts")
    joined = interval_join(offers, local, [("seller", "person_id")], ttl)
    return joined.select("name", "city", "state", "auction_id")


def q8_new_sellers(persons: DataFrame, auctions: DataFrame, ttl: float = 10.0) -> DataFrame:
    """People who offered something close to the time they joined."""
    people = persons.select(F.col("id").alias("person_id"), "name", "ts")
    offers = auctions.select("seller", "reserve", "ts")
    joined = interval_join(offers, people, [("seller", "person_id")], ttl)
    return joined.select("person_id", "name", "reserve")


def ad_click_join(views: DataFrame, clicks: DataFrame, ttl: float = 180.0) -> DataFrame:
    """Page views with the advertisement clicks on the same page."""
    shown = views.select("page_id", "user_id", "country", "ts")
    clicked = clicks.select(F.col("page_id").alias("click_page_id"), "ad_id", "ts")
    joined = interval_join(shown, clicked, [("page_id", "click_page_id")], ttl)
    return joined.select("page_id", "user_id", "country", "ad_id")


def buy_sell_band_join(
    orders: DataFrame, ttl: float = 180.0, keys: Sequence[str] = ("sec_code",)
) -> DataFrame:
    """Buy orders with the sell orders near them in time; no ``keys`` gives the bare time band."""
    columns = ["order_no", "order_price", "order_vol"]
    buys = orders.filter(F.col("trade_dir") == "B").select(
        *keys, *[F.col(c).alias(f"buy_{c}") for c in columns], "ts"
    )
    sells = orders.filter(F.col("trade_dir") == "S").select(
        *[F.col(k).alias(f"sell_{k}") for k in keys], *[F.col(c).alias(f"sell_{c}") for c in columns], "ts"
    )
    joined = interval_join(buys, sells, [(k, f"sell_{k}") for k in keys], ttl)
    return joined.drop(*[f"sell_{k}" for k in keys])


def buy_sell_latest_join(
    orders: DataFrame, ttl: float = 180.0, keys: Sequence[str] = ("sec_code",)
) -> DataFrame:
    """Each order with the newest opposite order of its security; at most one row per arrival."""
    columns = [*keys, "order_no", "order_price", "order_vol", "ts"]
    buys = orders.filter(F.col("trade_dir") == "B").select(*columns)
    sells = orders.filter(F.col("trade_dir") == "S").select(*columns)
    joined = latest_join(buys, sells, list(keys), ttl, tie="order_no")
    return joined.select(
        *keys,
        F.col("left.order_no").alias("buy_order_no"),
        F.col("right.order_no").alias("sell_order_no"),
        "arrived_at",
    )


#: Bytes of a table, as the plan estimates them, for each task that works on its words.
TOKEN_TASK_BYTES = 4 << 20


def token_tasks(df: DataFrame) -> int:
    """So many tasks that none has to hold more words as the table grows."""
    size, least = plan_bytes(df), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # An unknown size is given as about 2^63.
    return max(least, -(-size // TOKEN_TASK_BYTES)) if size < 1 << 50 else least


def lexicon_join(
    tokens: DataFrame, lexicon: DataFrame, how: str = "inner", number: str | None = None, tasks: int | None = None
) -> DataFrame:
    """Tokens (column ``word``) with their lexicon score.

    With ``number`` equal rows may come back as one, that column holding how many there are: beside a lexicon
    that is not broadcast, rows are counted before they meet it, so a word that is everywhere is one row a text.
    They meet in ``tasks`` tasks, see ``token_tasks``.
    """
    if tokens.isStreaming or plan_bytes(lexicon) <= MAX_BROADCAST_BYTES or not number:
        joined = tokens.join(broadcast_if_small(lexicon), "word", how)
        return joined.withColumn(number, F.lit(1).cast("bigint")) if number else joined
    counted = tokens.groupBy(*tokens.columns).agg(F.count(F.lit(1)).alias(number))
    if tasks:
        # Both sides, else the join takes the number of whichever is dealt out already.
        counted, lexicon = counted.repartition(tasks, "word"), lexicon.repartition(tasks, "word")
    return counted.join(lexicon, "word", how)


def transition_lookup(steps: DataFrame, model: DataFrame, columns: Sequence[str] = ("p",)) -> DataFrame:
    """State changes (``from_state``, ``to_state``) with their model row."""
    wanted = model.select("from_state", "to_state", *columns)
    return steps.join(broadcast_if_small(wanted), ["from_state", "to_state"], "left")


def nearest_centroid(
    points: DataFrame,
    centroids: Sequence[tuple[int, float, float]] | DataFrame,
    x: str = "x",
    y: str = "y",
    compat_linear_vol: bool = False,
    block: int = 1 << 16,
) -> DataFrame:
    """Add the id of, and distance to, the closest centroid; the smallest id wins a tie.

    Up to ``block`` centroids (``id``, ``x``, ``y``), 24 bytes each, are broadcast and every batch of points
    is compared with them. A table of more is descended as a tree of boxes, see ``nearest``: none of it goes to
    the driver. Points without a place get no centroid.
    """
    import numpy as np

    if isinstance(centroids, DataFrame):
        rows = [tuple(r) for r in centroids.select("id", "x", "y").limit(block + 1).collect()]
        if len(rows) > block:
            return nearest_of_many(points, centroids, x, y, compat_linear_vol)
    else:
        rows = list(centroids)
        if len(rows) > block:
            raise ValueError(f"more than {block} centroids must come as a table")
    rows = sorted(r for r in rows if None not in r)
    spark = points.sparkSession
    ids, places = np.array([r[0] for r in rows], np.int64), np.array([[float(r[1]), float(r[2])] for r in rows])
    blocks = [spark.sparkContext.broadcast((ids, places))] if rows else []

    @F.pandas_udf("distance double, id bigint")
    def nearest(px: pd.Series, py: pd.Series) -> pd.DataFrame:
        a, b = px.to_numpy(float), py.to_numpy(float)
        best = np.full(len(a), np.inf)
        name = np.zeros(len(a), np.int64)
        for held in blocks:
            ids, places = held.value
            # The table of distances stays within a few megabytes.
            step = max(1, (1 << 20) // len(ids))
            for i in range(0, len(a), step):
                dx = a[i : i + step, None] - places[None, :, 0]
                dy = b[i : i + step, None] - places[None, :, 1]
                d = dx * dx + (dy if compat_linear_vol else dy * dy)
                at = np.argmin(d, axis=1)
                value = d[np.arange(len(at)), at]
                closer = value < best[i : i + step]
                best[i : i + step][closer] = value[closer]
                name[i : i + step][closer] = ids[at[closer]]
        known = np.isfinite(best)
        return pd.DataFrame(
            {"distance": pd.Series(best).where(known), "id": pd.Series(name, dtype="Int64").where(known)}
        )

    found = nearest(F.col(x).cast("double"), F.col(y).cast("double"))
    return points.withColumn("__best", found).select(
        *points.columns, F.col("__best.id").alias("centroid_id"), F.col("__best.distance").alias("distance")
    )


def co_partition(df: DataFrame, *keys: str, partitions: int | None = None) -> DataFrame:
    """Place rows with equal keys together before several keyed steps that share the keys."""
    columns = [F.col(k) for k in keys]
    return df.repartition(partitions, *columns) if partitions else df.repartition(*columns)
