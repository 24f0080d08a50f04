"""Projections, filters, scalar functions and the union."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import projections as P
from millrace.functions import scalars as X
from millrace.functions import surface
from millrace.plans.wiki import merge_all, parse_edits
from millrace.registry.core import query
from millrace.registry.views import lines, table, view


@query(
    "p1_q1_currency",
    """SELECT CAST(auction AS STRING) AS key,
              concat(CAST(auction AS STRING),
                     CAST(CAST(trunc(CAST(0.82 AS FLOAT) * CAST(price AS FLOAT)) AS BIGINT) AS STRING),
                     CAST(bidder AS STRING), CAST(epoch_us(ts) // 1000 AS STRING)) AS value FROM {bids_li}""",
)
def _(spark, d):
    return P.q1_currency(view(spark, d, "bids_li"))


@query(
    "p2_q2_selection",
    """SELECT auction, price FROM {bids_li}
       WHERE auction % 1007 = 0 OR auction % 1020 = 0 OR auction % 2001 = 0 OR auction % 2019 = 0
             OR auction % 2087 = 0""",
)
def _(spark, d):
    return P.q2_selection(view(spark, d, "bids_li"))


@query("p3_person_state_filter", "SELECT * FROM {persons} WHERE state IN ('OR', 'ID', 'CA')")
def _(spark, d):
    return P.person_state_filter(view(spark, d, "persons"))


@query(
    "p4_price_alarm",
    """SELECT sec_code AS key, CASE WHEN trade_price < 1500 THEN 'low stock exchange price alarm!'
                                    ELSE 'normal transaction' END AS value FROM {stock_trades}""",
)
def _(spark, d):
    return P.price_alarm(view(spark, d, "stock_trades"), 1500)


@query("p5_drop_inactive_orders", "SELECT * FROM {stock_orders} WHERE tran_maint_code NOT IN ('X', '')")
def _(spark, d):
    return P.drop_inactive_orders(view(spark, d, "stock_orders"))


@query("p6_drop_non_new_orders", "SELECT * FROM {stock_orders} WHERE tran_maint_code = 'A'")
def _(spark, d):
    return P.drop_non_new_orders(view(spark, d, "stock_orders"))


@query("p7_non_empty", "SELECT event_id FROM events WHERE regexp_matches(props, '[5-9]')")
def _(spark, d):
    marks = table(spark, d, "events").withColumn("marks", F.regexp_extract_all("props", F.lit("([5-9])"), F.lit(1)))
    return P.non_empty(marks, "marks").select("event_id")


@query("p8_passthrough", "SELECT * FROM {word_lines}")
def _(spark, d):
    return P.passthrough(view(spark, d, "word_lines"))


@query(
    "p9_first_field",
    """SELECT order_no AS value FROM {stock_orders}
       UNION ALL SELECT 'end' FROM orders WHERE o_orderkey % 10 = 0
       UNION ALL SELECT CAST(o_orderkey AS STRING) FROM orders WHERE o_orderkey % 10 = 1""",
)
def _(spark, d):
    return P.first_field(lines(spark, d, "order_lines"))


@query(
    "p10_project_fields",
    "SELECT concat_ws(',', CAST(event_id AS STRING), CAST(user_id AS STRING), event_type) AS value FROM events",
)
def _(spark, d):
    line = F.concat_ws(",", F.col("event_id").cast("string"), "event_type", F.lit("z"), F.col("user_id").cast("string"))
    return P.project_fields(table(spark, d, "events").select(line.alias("value")), 0, [3, 1])


@query("p11_require_keys", "SELECT event_id FROM events WHERE event_id % 3 = 0")
def _(spark, d):
    name = F.when(F.col("event_id") % 3 == 0, "text").otherwise("body")
    body = F.concat(F.lit('{"id_str":"1","'), name, F.lit('":"t","created_at":"c"}'))
    return P.require_keys(
        table(spark, d, "events").select("event_id", body.alias("value")), ["id_str", "text", "created_at"]
    ).select("event_id")


@query(
    "p13_format_pane",
    """SELECT CAST(user_id AS STRING) AS key, concat(CAST(user_id AS STRING), ': ', CAST(count(*) AS STRING)) AS value
       FROM events GROUP BY user_id""",
)
def _(spark, d):
    counts = table(spark, d, "events").groupBy("user_id").count()
    return P.format_pane(counts, "user_id")


@query(
    "p14_order_fields",
    """SELECT order_no, tran_maint_code, order_price, CAST(0 AS INT) AS order_exec_vol, order_vol, sec_code, trade_dir,
              CAST(round(order_price * 100000) AS BIGINT) AS price_units FROM {stock_orders}""",
)
def _(spark, d):
    return P.order_fields(view(spark, d, "stock_orders"))


@query(
    "p15_apply_fill",
    """SELECT order_no, order_vol - least(order_vol, 7) AS order_vol, least(order_vol, 7) AS order_exec_vol
       FROM {stock_new}""",
)
def _(spark, d):
    filled = P.apply_fill(view(spark, d, "stock_new"), F.least("order_vol", F.lit(7)))
    return filled.select("order_no", "order_vol", "order_exec_vol")


@query(
    "p16_split_entity_record",
    "SELECT entity, record FROM {fraud_records}",
)
def _(spark, d):
    lines = view(spark, d, "fraud_records").select(F.concat_ws(",", "entity", "record").alias("value"))
    return P.split_entity_record(lines)


@query(
    "x1_split_tokens",
    """WITH s AS (SELECT doc_id, string_split(text, 'e') AS w FROM documents),
            t AS (SELECT doc_id, w, len(w) - coalesce(list_position(list_reverse([x <> '' for x in w]), true), len(w) + 1)
                    + 1 AS n FROM s)
       SELECT doc_id, CAST(n AS INT) AS tokens, w[1] AS first_token, w[n] AS last_token FROM t""",
)
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", X.split_tokens(F.col("text"), "e").alias("w"))
    return docs.select(
        "doc_id",
        F.size("w").alias("tokens"),
        F.get("w", F.lit(0)).alias("first_token"),
        F.try_element_at("w", F.lit(-1)).alias("last_token"),
    )


@query(
    "x2_clean_text",
    r"""SELECT doc_id, lower(regexp_replace(text, '[!-/:-@\[-`{-~\n]', ' ', 'g')) AS text FROM documents""".replace(
        "{-~", "\\x7b-~"
    ),
)
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", X.clean_text(F.col("text")).alias("text"))


_WIKI = """
    SELECT event_id, channel, source, ts,
           concat(CASE k % 10 WHEN 0 THEN 'Talk:' WHEN 1 THEN 'Special:' ELSE '' END, 'T', CAST(k AS STRING)) AS title,
           CASE k % 4 WHEN 0 THEN 'M' WHEN 1 THEN '!N' WHEN 2 THEN 'B' ELSE 'MB' END AS flags,
           concat('http://x/', CAST(event_id AS STRING)) AS diff_url,
           concat('u', CAST(user_id AS STRING)) AS user,
           CAST(CASE WHEN k % 2 = 0 THEN k ELSE -k END AS INT) AS byte_diff, event_type AS summary, k
    FROM (SELECT e.*, w.channel, w.source FROM {ev} e JOIN {wiki_events} w USING (event_id))
"""


@query(
    "x3_parse_wiki_line",
    f"WITH w AS ({_WIKI}) SELECT event_id, title, flags, diff_url, user, byte_diff, summary FROM w",
)
def _(spark, d):
    edits = parse_edits(view(spark, d, "wiki_events"))
    return edits.select("event_id", "title", "flags", "diff_url", "user", "byte_diff", "summary")


@query(
    "x4_wiki_flags",
    f"""WITH w AS ({_WIKI})
        SELECT event_id, k % 4 IN (0, 3) AS is_minor, k % 4 = 1 AS is_new, k % 4 = 1 AS is_unpatrolled,
               k % 4 IN (2, 3) AS is_bot_edit, k % 10 = 1 AS is_special, k % 10 = 0 AS is_talk FROM w""",
)
def _(spark, d):
    edits = parse_edits(view(spark, d, "wiki_events"))
    return edits.select(
        "event_id", *[F.col("flag_map")[n].alias(n.replace("-", "_")) for n in X.WIKI_FLAG_NAMES]
    )


@query(
    "x5_parse_tweet_time",
    """SELECT id_str,
              make_timestamp(2019, CASE CAST(id_str AS INT) % 4 WHEN 0 THEN 1 WHEN 1 THEN 5 WHEN 2 THEN 8 ELSE 12 END,
                             CAST(id_str AS INT) % 28 + 1, CAST(id_str AS INT) % 24, CAST(id_str AS INT) % 60,
                             CAST(CAST(id_str AS INT) % 59 AS DOUBLE))
              + to_minutes(CASE CAST(id_str AS INT) % 2 WHEN 0 THEN 0 ELSE 330 END) AS ts
       FROM {tweets}""",
)
def _(spark, d):
    return view(spark, d, "tweets").select("id_str", X.parse_tweet_time(F.col("created_at")).alias("ts"))


@query(
    "x6_parse_order_time",
    "SELECT event_id, date_trunc('milliseconds', ts) AS ts FROM {ev}",
)
def _(spark, d):
    text = F.col("ts").cast("string")
    date = F.replace(F.substring(text, 1, 10), F.lit("-"), F.lit(""))
    micros = F.lpad((F.unix_micros("ts") % 1_000_000).cast("string"), 6, "0")
    parsed = X.parse_order_time(date, F.substring(text, 12, 8), F.concat(F.lit("0."), micros))
    return view(spark, d, "ev").select("event_id", parsed.alias("ts"))


@query(
    "x7_time_to_int",
    "SELECT event_id, CAST(hour(ts) * 10000 + minute(ts) * 100 + second(ts) AS INT) AS hms FROM {ev}",
)
def _(spark, d):
    return view(spark, d, "ev").select("event_id", X.time_to_int(F.date_format("ts", "HH:mm:ss")).alias("hms"))


@query("x8_text_to_map", "SELECT event_id, CAST(k AS STRING) AS a, event_type AS b FROM {ev}")
def _(spark, d):
    text = F.concat(F.lit("a:"), F.col("k").cast("string"), F.lit("&b:"), F.col("event_type"))
    return view(spark, d, "ev").select("event_id", X.text_to_map(text).alias("m")).select(
        "event_id", F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b")
    )


@query(
    "x9_normalize_ws",
    r"""SELECT doc_id, regexp_replace(regexp_replace(lower(text), '[ \t\n\v\f\r]+$', ''), '[ \t\n\v\f\r]+', ' ', 'g') AS text
        FROM documents""",
)
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", X.normalize_ws(F.col("text")).alias("text"))


@query(
    "x10_field_lists",
    """SELECT event_id, concat_ws(',', CAST(user_id AS STRING), CAST(k AS STRING)) AS removed,
              concat_ws(',', CAST(k AS STRING), event_type) AS kept, [k, 7, k] AS items FROM {ev}""",
)
def _(spark, d):
    line = F.concat_ws(",", F.col("user_id").cast("string"), "event_type", F.col("k").cast("string"))
    k = F.col("k")
    items = F.array(k, F.lit(-1), F.lit(7), k, F.lit(-2))
    return view(spark, d, "ev").select(
        "event_id",
        X.remove_fields(line, [1]).alias("removed"),
        X.keep_fields(line, [2, 1]).alias("kept"),
        X.remove_items(items, F.array(F.lit(-1), F.lit(-2))).alias("items"),
    )


@query("x11_parse_num_array", "SELECT event_id, [CAST(user_id AS INT), k, 5] AS numbers FROM {ev}")
def _(spark, d):
    line = F.concat_ws(",", F.col("user_id").cast("string"), F.col("k").cast("string"), F.lit("5"))
    return view(spark, d, "ev").select("event_id", X.parse_num_array(line).alias("numbers"))


@query("x12_join_list", "SELECT event_id, concat_ws(';', event_type, CAST(k AS STRING), 'z') AS joined FROM {ev}")
def _(spark, d):
    items = F.array("event_type", F.col("k").cast("string"), F.lit("z"))
    return view(spark, d, "ev").select("event_id", X.join_list(items, ";").alias("joined"))


@query("x13_is_integer", "SELECT event_id, k % 3 = 0 AS ok FROM {ev}")
def _(spark, d):
    k = F.col("k").cast("string")
    text = F.when(F.col("k") % 3 == 0, F.concat(F.lit("-"), k)).when(F.col("k") % 3 == 1, F.concat(k, F.lit("."))).otherwise("")
    return view(spark, d, "ev").select("event_id", X.is_integer(text).alias("ok"))


@query(
    "x14_typed_cast",
    """SELECT event_id, CASE WHEN k % 7 > 0 THEN k END AS as_int, CAST(CASE WHEN k % 7 > 0 THEN k END AS BIGINT) AS as_long,
              CAST(CASE WHEN k % 7 > 0 THEN k END AS DOUBLE) AS as_double,
              CASE WHEN k % 7 > 0 THEN CAST(k AS STRING) ELSE 'n/a' END AS as_string FROM {ev}""",
)
def _(spark, d):
    text = F.when(F.col("k") % 7 > 0, F.col("k").cast("string")).otherwise("n/a")
    return view(spark, d, "ev").select(
        "event_id", *[X.typed_cast(text, t).alias(f"as_{t}") for t in ("int", "long", "double", "string")]
    )


@query(
    "x15_tuple_compare",
    """SELECT event_id, CAST(CASE WHEN user_id % 5 < k % 5 THEN -1 WHEN user_id % 5 > k % 5 THEN 1
                                  WHEN event_type < 'm' THEN -1 ELSE 1 END AS INT) AS compared FROM {ev}""",
)
def _(spark, d):
    left = X.prefix_key([(F.col("user_id") % 5).cast("int"), F.col("event_type"), F.col("k")], 2)
    right = X.prefix_key([(F.col("k") % 5).cast("int"), F.lit("m")], 2)
    return view(spark, d, "ev").select("event_id", X.tuple_compare(left, right).alias("compared"))


@query(
    "x15_prefix_hash",
    """SELECT user_id % 5 AS u, event_type, count(*) AS rows, CAST(1 AS BIGINT) AS hashes FROM events GROUP BY ALL""",
)
def _(spark, d):
    rows = table(spark, d, "events").withColumn("u", F.col("user_id") % 5)
    hashed = rows.withColumn("h", X.prefix_hash([F.col("u"), F.col("event_type"), F.col("event_id")], 2))
    per_hash = hashed.groupBy("u", "event_type", "h").agg(F.count(F.lit(1)).alias("n"))
    return per_hash.groupBy("u", "event_type").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("hashes"))


@query(
    "x16_squared_distance",
    """WITH p AS (SELECT trade_no, trade_price * 1000 - 500000 AS dp, trade_vol - 20 AS dv FROM {stock_trades})
       SELECT trade_no, dp * dp + CAST(dv * dv AS DOUBLE) AS distance, dp * dp + CAST(dv AS DOUBLE) AS compat FROM p""",
)
def _(spark, d):
    price, volume = F.col("trade_price") * 1000, F.col("trade_vol")
    args = (price, volume, F.lit(500000), F.lit(20))
    return view(spark, d, "stock_trades").select(
        "trade_no",
        X.squared_distance(*args).alias("distance"),
        X.squared_distance(*args, compat_linear_vol=True).alias("compat"),
    )


@query("x17_uniform_in", "SELECT event_id, true AS whole_inside, true AS real_inside FROM events")
def _(spark, d):
    drawn = table(spark, d, "events").select(
        "event_id", X.uniform_int(3, 9, 11).alias("whole"), X.uniform_double(0.0, 1.0, 12).alias("real")
    )
    # What is drawn cannot be known; that it lies inside the bounds can.
    return drawn.select(
        "event_id",
        F.col("whole").between(3, 9).alias("whole_inside"),
        ((F.col("real") >= 0.0) & (F.col("real") < 2.0)).alias("real_inside"),
    )


@query("x18_blank_to_null", "SELECT event_id, CASE WHEN k % 2 = 0 THEN concat(' ', event_type) END AS text FROM {ev}")
def _(spark, d):
    text = F.when(F.col("k") % 2 == 0, F.concat(F.lit(" "), "event_type")).otherwise(" \t ")
    return view(spark, d, "ev").select("event_id", X.blank_to_null(text).alias("text"))


@query("u1_merge_all", "SELECT channel, count(*) AS n FROM {wiki_events} GROUP BY 1")
def _(spark, d):
    events = view(spark, d, "wiki_events")
    channels = [events.filter(F.col("channel") == c) for c in ("wikipedia", "wikinews", "wiktionary")]
    return merge_all(channels).groupBy("channel").agg(F.count(F.lit(1)).alias("n"))


@query(
    "f2_map_filter_flat_map",
    """SELECT unnest([event_type, CAST(k AS STRING)]) AS item FROM {ev} WHERE k > 50""",
)
def _(spark, d):
    kept = surface.keep_rows(view(spark, d, "ev"), F.col("k") > 50)
    mapped = surface.map_rows(kept, a=F.col("event_type"), b=F.col("k").cast("string"))
    return surface.flat_map(mapped, F.array("a", "b"), "item")


@query("f3_fold_left", "SELECT event_id, CAST(100 + k + user_id + 3 AS BIGINT) AS folded FROM {ev}")
def _(spark, d):
    items = F.array(F.col("k").cast("bigint"), F.col("user_id"), F.lit(3).cast("bigint"))
    folded = surface.fold_left(items, F.lit(100).cast("bigint"), lambda acc, x: acc + x)
    return view(spark, d, "ev").select("event_id", folded.alias("folded"))
