"""Entity views derived from the given tables.

Each view is one SELECT that Spark and the checking engine both run, so an operator and its
check start from the same rows. ``{name}`` refers to a base table or to another view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"

VIEWS: dict[str, str] = {
    "ev": f"SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id, event_type, value, {K} AS k FROM {{events}}",
    "bids_li": """
        SELECT l_orderkey AS auction, l_suppkey AS bidder, CAST(floor(l_extendedprice) AS BIGINT) AS price,
               CAST(l_shipdate AS TIMESTAMP) AS ts
        FROM {lineitem}""",
    "bids_ev": """
        SELECT event_id, CAST(k AS BIGINT) AS auction, user_id AS bidder,
               CAST(floor(value * 100) AS BIGINT) AS price, ts
        FROM {ev}""",
    "persons": """
        SELECT e.user_id AS id, c.c_name AS name, n.n_name AS city,
               CASE e.user_id % 6 WHEN 0 THEN 'OR' WHEN 1 THEN 'ID' WHEN 2 THEN 'CA'
                    WHEN 3 THEN 'WA' WHEN 4 THEN 'NY' ELSE 'TX' END AS state, e.ts AS ts
        FROM {ev} e JOIN {customer} c ON c.c_custkey = e.user_id
                    JOIN {nation} n ON n.n_nationkey = c.c_nationkey
        WHERE e.event_type = 'signup'""",
    "auctions": """
        SELECT event_id AS id, user_id AS seller, CAST(floor(value * 100) AS BIGINT) AS reserve, ts
        FROM {ev} WHERE event_type = 'purchase'""",
    "page_views": """
        SELECT event_id, concat('page', CAST(k % 8 AS STRING)) AS page_id,
               concat('user', CAST(user_id AS STRING)) AS user_id,
               CASE k % 3 WHEN 0 THEN 'CN' WHEN 1 THEN 'USA' ELSE 'EU' END AS country, ts
        FROM {ev} WHERE event_type = 'view'""",
    "ad_clicks": """
        SELECT event_id, concat('page', CAST(k % 8 AS STRING)) AS page_id,
               concat('ad', CAST(k % 5 + 1 AS STRING)) AS ad_id,
               concat('user', CAST(user_id AS STRING)) AS user_id, ts
        FROM {ev} WHERE event_type = 'click'""",
    "word_lines": """
        SELECT event_id, concat(event_type, ' w', CAST(k % 10 AS STRING)) AS line, ts FROM {ev}""",
    "wiki_events": """
        SELECT event_id,
               concat('[[', CASE k % 10 WHEN 0 THEN 'Talk:' WHEN 1 THEN 'Special:' ELSE '' END,
                      'T', CAST(k AS STRING), ']] ',
                      CASE k % 4 WHEN 0 THEN 'M' WHEN 1 THEN '!N' WHEN 2 THEN 'B' ELSE 'MB' END,
                      ' http://x/', CAST(event_id AS STRING), ' * u', CAST(user_id AS STRING), ' * (',
                      CASE WHEN k % 2 = 0 THEN '+' ELSE '-' END, CAST(k AS STRING), ') ', event_type) AS raw,
               CASE user_id % 3 WHEN 0 THEN 'wikipedia' WHEN 1 THEN 'wikinews' ELSE 'wiktionary' END AS channel,
               'src' AS source, ts
        FROM {ev}""",
    "stock_new": """
        SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-',
                      CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS order_no,
               CASE WHEN l_suppkey % 20 = 1 THEN 'X' WHEN l_suppkey % 20 = 2 THEN '' ELSE 'A' END
                   AS tran_maint_code,
               floor(l_extendedprice / l_quantity * 100) / 100 AS order_price, 0 AS order_exec_vol,
               CAST(l_quantity AS INT) AS order_vol, CAST(l_partkey % 50 AS STRING) AS sec_code,
               CASE l_linestatus WHEN 'O' THEN 'B' ELSE 'S' END AS trade_dir,
               CAST(l_shipdate AS TIMESTAMP) + INTERVAL '1' SECOND
                   * CAST(33300 + (l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31) % 2400 AS INT) AS ts
        FROM {lineitem}""",
    "stock_orders": """
        SELECT order_no, tran_maint_code, order_price, order_exec_vol, order_vol, sec_code, trade_dir, ts
        FROM {stock_new}
        UNION ALL
        SELECT order_no, 'D' AS tran_maint_code, order_price, order_exec_vol, order_vol, sec_code, trade_dir,
               ts + INTERVAL '1' DAY AS ts
        FROM {stock_new} WHERE CAST(split_part(order_no, '-', 4) AS BIGINT) % 20 = 0""",
    "order_lines": """
        SELECT concat(order_no, '|', tran_maint_code, '|', replace(substr(CAST(ts AS STRING), 1, 10), '-', ''), '|',
                      substr(CAST(ts AS STRING), 12, 8), '|0.', CAST(100000 + order_vol AS STRING), '|a|b|c|',
                      CAST(order_price AS STRING), '|', CAST(order_exec_vol AS STRING), '|',
                      CAST(order_vol AS STRING), '|', sec_code, '|d|e|f|g|h|i|j|k|l|m|', trade_dir) AS value
        FROM {stock_orders}
        UNION ALL
        SELECT 'end' AS value FROM {orders} WHERE o_orderkey % 10 = 0
        UNION ALL
        SELECT concat(CAST(o_orderkey AS STRING), '|A|short') AS value FROM {orders} WHERE o_orderkey % 10 = 1""",
    "stock_trades": """
        SELECT order_no AS trade_no, order_price AS trade_price, CAST(order_vol AS BIGINT) AS trade_vol,
               sec_code, trade_dir, ts
        FROM {stock_new}""",
    "trade_lines": """
        SELECT concat(trade_no, '|', replace(substr(CAST(ts AS STRING), 1, 10), '-', ''), '|',
                      substr(CAST(ts AS STRING), 12, 8), '|0.5|t|0.5|o|', CAST(trade_price AS STRING), '|1.5|',
                      CAST(trade_vol AS STRING), '|', sec_code, '|p|acct', sec_code, '|', trade_dir,
                      '|a|b|c|d|e|f|g') AS value
        FROM {stock_trades}
        UNION ALL
        SELECT 'end' AS value FROM {orders} WHERE o_orderkey % 10 = 0""",
    "fraud_records": """
        SELECT CAST(user_id AS STRING) AS entity,
               concat(CAST(event_id AS STRING), ',', event_type) AS record, event_type AS state, ts, event_id
        FROM {ev}""",
    "tweets": """
        SELECT CAST(doc_id AS STRING) AS id_str, text,
               concat(CASE doc_id % 3 WHEN 0 THEN 'Mon ' WHEN 1 THEN 'Tue ' ELSE 'Sun ' END,
                      CASE doc_id % 4 WHEN 0 THEN 'Jan' WHEN 1 THEN 'May' WHEN 2 THEN 'Aug' ELSE 'Dec' END, ' ',
                      lpad(CAST(doc_id % 28 + 1 AS STRING), 2, '0'), ' ',
                      lpad(CAST(doc_id % 24 AS STRING), 2, '0'), ':',
                      lpad(CAST(doc_id % 60 AS STRING), 2, '0'), ':',
                      lpad(CAST(doc_id % 59 AS STRING), 2, '0'),
                      CASE doc_id % 2 WHEN 0 THEN ' +0000 ' ELSE ' -0530 ' END, '2019') AS created_at
        FROM {documents}""",
    "executor_lines": """
        SELECT concat('00000', CAST(user_id % 4 + 2 AS STRING), '.txt') AS container, event_id * 2 AS line_no,
               concat('GT: ', CAST(1000 * (event_id % 750 + 1) AS STRING), ' pid ',
                      CAST(user_id % 64 AS STRING), ' n ', CAST(k % 3 + 1 AS STRING), ' latency ',
                      CAST(CAST(floor(value * 60) AS BIGINT) AS STRING)) AS value
        FROM {ev}
        UNION ALL
        SELECT concat('00000', CAST(user_id % 4 + 2 AS STRING), '.txt') AS container, event_id * 2 + 1 AS line_no,
               CASE k % 10
                    WHEN 0 THEN concat('Starting run at ', CAST(1000 * (event_id % 750) AS STRING))
                    WHEN 1 THEN concat('Entering run loop ', CAST(1000 * (event_id % 750) + 40 AS STRING))
                    WHEN 2 THEN concat('Shutting down at ', CAST(1000 * (event_id % 750) + 60 AS STRING))
                    WHEN 3 THEN concat('Shutdown at ', CAST(1000 * (event_id % 750) + 90 AS STRING))
                    WHEN 4 THEN concat('container start at host', CAST(user_id % 4 AS STRING))
                    ELSE concat('other text ', CAST(k AS STRING)) END AS value
        FROM {ev}""",
    "controller_lines": """
        SELECT event_id AS line_no,
               CASE WHEN k % 5 < 4 THEN
                 concat(CASE WHEN k % 2 = 0 THEN 'Model, time ' ELSE 'DelayEstimateModel, time ' END,
                      CAST(1000000 + 100 * (event_id % 5000) AS STRING), ' : ',
                      CASE k % 5 WHEN 0 THEN concat('Arrival Rate: ', chr(123)) WHEN 1 THEN concat('Service Rate: ', chr(123))
                                 WHEN 2 THEN concat('Instantaneous Delay: ', chr(123)) ELSE concat('Longterm Delay: ', chr(123)) END,
                      'c', CAST(user_id % 4 AS STRING), '=',
                      CASE WHEN k % 10 = 0 THEN 'NaN' ELSE CAST(k * 50000 - 400000 AS STRING) END,
                      ', c', CAST(user_id % 4 + 4 AS STRING), '=', CAST(k AS STRING), '.5', chr(125))
               ELSE concat('Number of severe OEs: ', CAST(k AS STRING)) END AS value
        FROM {ev}""",
    "migration_lines": """
        SELECT event_id * 2 AS line_no,
               CASE k % 4
                    WHEN 0 THEN concat('Migration! Scale in time: ', CAST(100 * event_id AS STRING),
                                       ' move from c', CAST(k % 3 AS STRING), ' keys to c', CAST(k % 7 AS STRING))
                    WHEN 1 THEN concat('Migration! Scale out time: ', CAST(100 * event_id AS STRING),
                                       ' move from c', CAST(k % 3 AS STRING), ' keys to c', CAST(k % 7 AS STRING))
                    WHEN 2 THEN concat('Migration! Load balance time: ', CAST(100 * event_id AS STRING),
                                       ' move from c', CAST(k % 3 AS STRING), ' keys to c', CAST(k % 7 AS STRING))
                    ELSE concat('Model, time ', CAST(100 * event_id AS STRING), ' : Arrival Rate: ', chr(123), chr(125)) END AS value
        FROM {ev}
        UNION ALL
        SELECT event_id * 2 + 1 AS line_no,
               CASE k % 4
                    WHEN 0 THEN concat('Executors stopped at time ', CAST(100 * event_id + 50 AS STRING),
                                       ' : scale-in from c', CAST(k % 3 AS STRING), ' to c', CAST(k % 7 AS STRING))
                    WHEN 1 THEN concat('Executors stopped at time ', CAST(100 * event_id + 50 AS STRING),
                                       ' : scale-out from c', CAST(k % 3 AS STRING), ' to c', CAST(k % 7 AS STRING))
                    WHEN 2 THEN concat('Executors stopped at time ', CAST(100 * event_id + 50 AS STRING),
                                       ' : balance from c', CAST(k % 3 AS STRING), ' to c', CAST(k % 7 AS STRING))
                    ELSE concat('Number of severe OEs: ', CAST(k AS STRING)) END AS value
        FROM {ev}""",
}

_REF = re.compile(r"\{(\w+)\}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or derived view as a DataFrame."""
    if name in BASE_TABLES:
        return table(spark, sf_dir, name)
    sql = VIEWS[name]
    refs = set(_REF.findall(sql))
    return spark.sql(sql, **{r: view(spark, sf_dir, r) for r in refs})


def references(sql: str) -> set[str]:
    """The tables and views that a view is made of."""
    return set(_REF.findall(sql))


def lines(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view of text lines, each composed once per row, as if it came from a text file."""
    composed = view(spark, sf_dir, name)
    rest = [c for c in composed.columns if c != "value"]
    return composed.select(*rest, F.explode(F.array("value")).alias("value"))


def _needs(sql: str) -> list[str]:
    """View names used by ``sql``, dependencies first."""
    found: list[str] = []
    for ref in _REF.findall(sql):
        if ref in VIEWS:
            for name in [*_needs(VIEWS[ref]), ref]:
                if name not in found:
                    found.append(name)
    return found


def check_sql(sql: str) -> str:
    """Expand ``{view}`` references of a check query into leading common table expressions."""
    ctes = [f"{name} AS ({VIEWS[name].strip()})" for name in _needs(sql)]
    text = sql.strip()
    if ctes:
        head = "WITH RECURSIVE " if text.upper().startswith("WITH RECURSIVE") else "WITH "
        if text.upper().startswith("WITH RECURSIVE"):
            text = text[len("WITH RECURSIVE") :].strip()
            joiner = ",\n"
        elif text.upper().startswith("WITH"):
            text = text[len("WITH") :].strip()
            joiner = ",\n"
        else:
            joiner = "\n"
        text = head + ",\n".join(ctes) + joiner + text
    return _REF.sub(lambda m: m.group(1), text)
