"""Explicit schemas of the record kinds; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T


# The types used below.
TYPES = {"bigint": T.LongType(), "string": T.StringType()}


def _struct(spec: str) -> T.StructType:
    """A schema from ``name type, name type``; needs no running session."""
    pairs = [field.split() for field in spec.split(",")]
    return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in pairs])


BID = _struct("auction bigint, bidder bigint, price bigint, dateTime bigint, extra string")
AUCTION = _struct(
    "id bigint, itemName string, description string, initialBid bigint, reserve bigint, "
    "dateTime bigint, expires bigint, seller bigint, category bigint, extra string"
)
PERSON = _struct(
    "id bigint, name string, emailAddress string, creditCard string, city string, state string, "
    "dateTime bigint, extra string"
)
PAGE_VIEW = _struct("pageId string, userId string, countryId string, country string")
AD_CLICK = _struct("pageId string, adId string, userId string")
WIKI_EVENT = _struct("raw string, channel string, source string, time bigint")
TWEET = _struct("id_str string, text string, created_at string")
WORD_COUNT = _struct("word string, count bigint")

# Positions of the fields in the pipe-delimited order text.
ORDER_FIELDS = {
    "order_no": 0,
    "tran_maint_code": 1,
    "order_date": 2,
    "order_time": 3,
    "order_time_fraction": 4,
    "order_price": 8,
    "order_exec_vol": 9,
    "order_vol": 10,
    "sec_code": 11,
    "trade_dir": 22,
}

# Positions of the fields in the pipe-delimited trade text.
TRADE_FIELDS = {
    "trade_no": 0,
    "trade_date": 1,
    "trade_time": 2,
    "trade_time_dec": 3,
    "order_time": 4,
    "order_time_dec": 5,
    "order_no": 6,
    "trade_price": 7,
    "trade_amt": 8,
    "trade_vol": 9,
    "sec_code": 10,
    "pbu_id": 11,
    "acct_id": 12,
    "trade_dir": 13,
    "order_prtfil_code": 14,
    "tran_type": 15,
    "trade_type": 16,
    "proc_type": 17,
    "order_type": 18,
    "stat_pbu_id": 19,
    "credit_type": 20,
}
