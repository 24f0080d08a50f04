"""Row-wise projections and filters over single streams or tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalars import split_tokens

# Divisors of the selection query, states of the local-item query.
SELECTION_DIVISORS = (1007, 1020, 2001, 2019, 2087)
LOCAL_STATES = ("OR", "ID", "CA")
EURO_RATE = 0.82
LOW_PRICE_TEXT = "low stock exchange price alarm!"
NORMAL_TEXT = "normal transaction"
LOCAL_ITEM_TEXT = "joinResult: { name:%s, city: %s, state: %s, auctionId: %d}"
NEW_SELLER_TEXT = "joinResult: { personId:%d, personName: %s, auctionReserve: %d}"


def euro_price(price: Column) -> Column:
    """Single-precision product, cut to a whole number."""
    return (F.lit(EURO_RATE).cast("float") * price.cast("float")).cast("bigint")


def q1_currency(bids: DataFrame) -> DataFrame:
    """Key: the auction. Value: auction, price in euro, bidder and time run together."""
    euro = euro_price(F.col("price"))
    millis = F.unix_millis("ts")
    return bids.select(
        F.col("auction").cast("string").alias("key"),
        F.concat(*[c.cast("string") for c in (F.col("auction"), euro, F.col("bidder"), millis)]).alias("value"),
    )


def q2_selection(bids: DataFrame, divisors: Sequence[int] = SELECTION_DIVISORS) -> DataFrame:
    hit = F.lit(False)
    for d in divisors:
        hit = hit | (F.col("auction") % d == 0)
    return bids.filter(hit).select("auction", "price")


def person_state_filter(persons: DataFrame, states: Sequence[str] = LOCAL_STATES) -> DataFrame:
    return persons.filter(F.col("state").isin(*states))


def price_alarm(trades: DataFrame, minimum: float = 10.0) -> DataFrame:
    return trades.select(
        F.col("sec_code").alias("key"),
        F.when(F.col("trade_price") < minimum, LOW_PRICE_TEXT).otherwise(NORMAL_TEXT).alias("value"),
    )


def drop_inactive_orders(orders: DataFrame) -> DataFrame:
    """Orders that were not voided or given an empty code; a missing code is none of these."""
    return orders.filter(~F.coalesce(F.col("tran_maint_code").isin("X", ""), F.lit(False)))


def drop_non_new_orders(orders: DataFrame) -> DataFrame:
    """Also without deletions."""
    return orders.filter(~F.coalesce(F.col("tran_maint_code").isin("D", "X", ""), F.lit(False)))


def non_empty(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.size(column) > 0)


def passthrough(df: DataFrame) -> DataFrame:
    return df.select("*")


def first_field(df: DataFrame, column: str = "value", delim: str = r"\|") -> DataFrame:
    return df.select(F.get(F.split(column, delim), F.lit(0)).alias("value"))


def project_fields(
    df: DataFrame, key: int, fields: Sequence[int], column: str = "value", delim: str = ",", out_delim: str = ","
) -> DataFrame:
    """Key field and the chosen fields joined to one line."""
    parts = split_tokens(F.col(column), delim)
    return df.select(
        F.concat_ws(out_delim, F.get(parts, F.lit(key)), *[F.get(parts, F.lit(i)) for i in fields]).alias("value")
    )


def require_keys(df: DataFrame, keys: Sequence[str], column: str = "value") -> DataFrame:
    """Keep JSON rows that carry every key."""
    ok = F.lit(True)
    for k in keys:
        ok = ok & F.get_json_object(column, f"$.{k}").isNotNull()
    return df.filter(ok)


def format_local_item(joined: DataFrame) -> DataFrame:
    return joined.select(
        F.format_string(
            LOCAL_ITEM_TEXT, "name", "city", "state", "auction_id"
        ).alias("value")
    )


def format_new_seller(joined: DataFrame) -> DataFrame:
    return joined.select(
        F.format_string(NEW_SELLER_TEXT, "person_id", "name", "reserve").alias("value")
    )


def format_pane(counts: DataFrame, key: str, count: str = "count") -> DataFrame:
    return counts.select(
        F.col(key).cast("string").alias("key"),
        F.concat(F.col(key).cast("string"), F.lit(": "), F.col(count).cast("string")).alias("value"),
    )


def order_fields(orders: DataFrame) -> DataFrame:
    """Typed order columns: whole volumes, and the price also in units of 1/100000."""
    return orders.select(
        "order_no",
        "tran_maint_code",
        F.col("order_price").cast("double").alias("order_price"),
        F.col("order_exec_vol").cast("double").cast("int").alias("order_exec_vol"),
        F.col("order_vol").cast("double").cast("int").alias("order_vol"),
        "sec_code",
        "trade_dir",
        F.floor(F.round(F.col("order_price").cast("double") * 100000, 0)).cast("bigint").alias("price_units"),
    )


def apply_fill(orders: DataFrame, volume: Column) -> DataFrame:
    """Move ``volume`` from the remaining to the executed part of each order."""
    return orders.withColumns(
        {
            "order_vol": F.col("order_vol") - volume,
            "order_exec_vol": F.col("order_exec_vol") + volume,
        }
    )


def split_entity_record(df: DataFrame, column: str = "value") -> DataFrame:
    """Text before the first comma is the entity; all the rest is its record."""
    parts = F.split(column, ",", 2)
    return df.select(F.get(parts, F.lit(0)).alias("entity"), F.get(parts, F.lit(1)).alias("record"))
