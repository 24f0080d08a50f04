"""Joins, aggregates, statistics, running values and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import projections as P
from millrace.functions.scalars import time_to_int
from millrace.operators import aggregates as A
from millrace.operators import analytic as W
from millrace.operators import joins as J
from millrace.operators import selection as O
from millrace.operators import stats as S
from millrace.operators.medians import running_median
from millrace.plans import markov, wiki
from millrace.plans.text import read_tweets
from millrace.registry.core import query
from millrace.registry.rows import _WIKI
from millrace.registry.sources import _COUNTS, LEXICON_SQL, STATES, lexicon, trained
from millrace.registry.views import table, view
from millrace.streaming.windows import tumbling_count

HOURS_6 = 6 * 3600.0
_LEXICON_SQL = f"lexicon AS ({LEXICON_SQL})"


# --- joins -----------------------------------------------------------------------------------

_Q3 = """
    SELECT p.name, p.city, p.state, a.id AS auction_id FROM {auctions} a JOIN {persons} p ON a.seller = p.id
    WHERE p.state IN ('OR', 'ID', 'CA') AND a.ts > p.ts - INTERVAL 6 HOUR AND a.ts < p.ts + INTERVAL 6 HOUR
"""
_Q8 = """
    SELECT p.id AS person_id, p.name, a.reserve FROM {auctions} a JOIN {persons} p ON a.seller = p.id
    WHERE a.ts > p.ts - INTERVAL 6 HOUR AND a.ts < p.ts + INTERVAL 6 HOUR
"""


@query(
    "j0a_interval_join",
    """SELECT v.event_id AS view_id, c.event_id AS click_id FROM {page_views} v JOIN {ad_clicks} c USING (user_id)
       WHERE v.ts > c.ts - INTERVAL 1 DAY AND v.ts < c.ts + INTERVAL 1 DAY""",
)
def _(spark, d):
    views = view(spark, d, "page_views").select(F.col("event_id").alias("view_id"), "user_id", "ts")
    clicks = view(spark, d, "ad_clicks").select(F.col("event_id").alias("click_id"), F.col("user_id").alias("who"), "ts")
    joined = J.interval_join(views, clicks, [("user_id", "who")], 86_400.0)
    return joined.select("view_id", "click_id")


@query(
    "j0b_latest_join",
    """WITH m AS (SELECT page_id, ts, 0 AS side, event_id, event_id AS v, ts AS vt, NULL AS c, NULL AS ct FROM {page_views}
                  UNION ALL SELECT page_id, ts, 1, event_id, NULL, NULL, event_id, ts FROM {ad_clicks}),
            s AS (SELECT page_id, ts, side,
                    last_value(v IGNORE NULLS) OVER w AS v, last_value(vt IGNORE NULLS) OVER w AS vt,
                    last_value(c IGNORE NULLS) OVER w AS c, last_value(ct IGNORE NULLS) OVER w AS ct
                  FROM m WINDOW w AS (PARTITION BY page_id ORDER BY ts, side, event_id ROWS UNBOUNDED PRECEDING))
       SELECT page_id, v AS view_id, c AS click_id, side AS arrived_side FROM s
       WHERE CASE side WHEN 0 THEN ct ELSE vt END > ts - INTERVAL 3 HOUR""",
)
def _(spark, d):
    joined = J.latest_join(
        view(spark, d, "page_views"), view(spark, d, "ad_clicks"), ["page_id"], 3 * 3600.0, tie="event_id"
    )
    return joined.select(
        "page_id", F.col("left.event_id").alias("view_id"), F.col("right.event_id").alias("click_id"), "arrived_side"
    )


@query("j1_q3_local_items", _Q3)
def _(spark, d):
    return J.q3_local_items(view(spark, d, "persons"), view(spark, d, "auctions"), HOURS_6)


@query("j2_q8_new_sellers", _Q8)
def _(spark, d):
    return J.q8_new_sellers(view(spark, d, "persons"), view(spark, d, "auctions"), HOURS_6)


@query(
    "j3_ad_click_join",
    """SELECT v.page_id, v.user_id, v.country, c.ad_id FROM {page_views} v JOIN {ad_clicks} c ON v.page_id = c.page_id
       WHERE v.ts > c.ts - INTERVAL 3 MINUTE AND v.ts < c.ts + INTERVAL 3 MINUTE""",
)
def _(spark, d):
    return J.ad_click_join(view(spark, d, "page_views"), view(spark, d, "ad_clicks"))


_BAND = """
    SELECT {key}b.order_no AS buy_order_no, s.order_no AS sell_order_no
    FROM {{stock_new}} b JOIN {{stock_new}} s ON {on}b.trade_dir = 'B' AND s.trade_dir = 'S'
    WHERE b.ts > s.ts - INTERVAL {sec} SECOND AND b.ts < s.ts + INTERVAL {sec} SECOND
"""


@query("j4_buy_sell_band_join", _BAND.format(key="b.sec_code, ", on="b.sec_code = s.sec_code AND ", sec=180))
def _(spark, d):
    joined = J.buy_sell_band_join(view(spark, d, "stock_new"))
    return joined.select("sec_code", "buy_order_no", "sell_order_no")


@query(
    "j4_unkeyed_band_join",
    """WITH m AS (SELECT ts, CASE trade_dir WHEN 'B' THEN 0 ELSE 1 END AS side, order_no FROM {stock_new}),
            s AS (SELECT *,
                    last_value(CASE side WHEN 0 THEN order_no END IGNORE NULLS) OVER w AS b,
                    last_value(CASE side WHEN 0 THEN ts END IGNORE NULLS) OVER w AS bt,
                    last_value(CASE side WHEN 1 THEN order_no END IGNORE NULLS) OVER w AS s,
                    last_value(CASE side WHEN 1 THEN ts END IGNORE NULLS) OVER w AS st
                  FROM m WINDOW w AS (ORDER BY ts, side, order_no ROWS UNBOUNDED PRECEDING))
       SELECT b AS buy_order_no, s AS sell_order_no FROM s
       WHERE CASE side WHEN 0 THEN st ELSE bt END > ts - INTERVAL 2 SECOND""",
)
def _(spark, d):
    # Without a key every arrival meets the newest opposite order of the whole market: no pairs are formed.
    joined = J.buy_sell_latest_join(view(spark, d, "stock_new"), 2.0, keys=())
    return joined.select("buy_order_no", "sell_order_no")


@query(
    "j4_buy_sell_latest_join",
    """WITH m AS (SELECT sec_code, ts, CASE trade_dir WHEN 'B' THEN 0 ELSE 1 END AS side, order_no FROM {stock_new}),
            s AS (SELECT *,
                    last_value(CASE side WHEN 0 THEN order_no END IGNORE NULLS) OVER w AS b,
                    last_value(CASE side WHEN 0 THEN ts END IGNORE NULLS) OVER w AS bt,
                    last_value(CASE side WHEN 1 THEN order_no END IGNORE NULLS) OVER w AS s,
                    last_value(CASE side WHEN 1 THEN ts END IGNORE NULLS) OVER w AS st
                  FROM m WINDOW w AS (PARTITION BY sec_code ORDER BY ts, side, order_no ROWS UNBOUNDED PRECEDING))
       SELECT sec_code, b AS buy_order_no, s AS sell_order_no, ts AS arrived_at FROM s
       WHERE CASE side WHEN 0 THEN st ELSE bt END > ts - INTERVAL 3 MINUTE""",
)
def _(spark, d):
    return J.buy_sell_latest_join(view(spark, d, "stock_new"))


_TOKENS = r"""
    tokens AS (SELECT doc_id, unnest(string_split(
                 lower(regexp_replace(text, '[!-/:-@\[-`\x7b-~\n]', ' ', 'g')), ' ')) AS word FROM documents)
"""


@query(
    "j5_lexicon_join",
    f"""WITH {_TOKENS}, {_LEXICON_SQL}
        SELECT t.word, CAST(any_value(score) AS INT) AS score, count(*) AS n FROM tokens t JOIN lexicon l ON t.word = l.word
        GROUP BY t.word""",
)
def _(spark, d):
    from millrace.functions.scalars import clean_text, trim_token

    words = table(spark, d, "documents").select(F.explode(F.split(clean_text(F.col("text")), " ")).alias("word"))
    words = words.withColumn("word", trim_token(F.col("word")))
    hits = J.lexicon_join(words, lexicon(spark, d), number="times")
    return hits.groupBy("word").agg(F.max("score").alias("score"), F.sum("times").alias("n"))


@query(
    "j6_transition_lookup",
    f"""WITH {_COUNTS}
        SELECT q.entity, q.from_state, q.to_state, count(*) AS n, round(any_value(p), 9) AS p
        FROM seqs q LEFT JOIN model m ON m.from_state = q.from_state AND m.to_state = q.to_state
        WHERE q.from_state IS NOT NULL GROUP BY 1, 2, 3""",
)
def _(spark, d):
    steps = markov.state_steps(view(spark, d, "fraud_records"), "entity", ["ts", "event_id"], "state")
    found = J.transition_lookup(steps, trained(spark, d))
    return found.groupBy("entity", "from_state", "to_state").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.max("p"), 9).alias("p")
    )


# Centroids of the checks: one per security, from the trades themselves.
_CENTROIDS = """
    centroids AS (SELECT CAST(sec_code AS BIGINT) AS id, floor(avg(trade_price * 1000)) AS x, floor(avg(trade_vol)) AS y
                  FROM {stock_trades} GROUP BY 1)
"""


def centroids(spark, d):
    trades = view(spark, d, "stock_trades").withColumn("id", F.col("sec_code").cast("bigint"))
    return trades.groupBy("id").agg(
        F.floor(F.avg(F.col("trade_price") * 1000)).alias("x"), F.floor(F.avg("trade_vol")).alias("y")
    )


@query(
    "j7_nearest_centroid",
    f"""WITH {_CENTROIDS}
        SELECT trade_no, (SELECT min_by(id, (dp * dp + dv * dv, id)) FROM (
                   SELECT id, t.trade_price * 1000 - c.x AS dp, t.trade_vol - c.y AS dv FROM centroids c)) AS centroid_id FROM {{stock_trades}} t""",
)
def _(spark, d):
    points = view(spark, d, "stock_trades").select(
        "trade_no", (F.col("trade_price") * 1000).alias("x"), F.col("trade_vol").alias("y")
    )
    return J.nearest_centroid(points, centroids(spark, d)).select("trade_no", "centroid_id")


# More centroids than are broadcast: every part is one, and they are descended as a tree.
_MANY = "SELECT p_partkey AS id, p_retailprice * 100 AS x, CAST(p_size AS DOUBLE) AS y FROM {part}"


@query(
    "j7_nearest_of_many",
    f"""WITH c AS ({_MANY}), p AS (SELECT DISTINCT trade_price * 1000 AS x, trade_vol AS y FROM {{stock_trades}}),
             best AS (SELECT p.x, p.y, min((  (p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y), c.id)) AS b
                      FROM p, c GROUP BY 1, 2)
        SELECT trade_no, b[2] AS centroid_id, round(b[1], 6) AS distance
        FROM {{stock_trades}} t JOIN best ON best.x = t.trade_price * 1000 AND best.y = t.trade_vol""",
)
def _(spark, d):
    points = view(spark, d, "stock_trades").select(
        "trade_no", (F.col("trade_price") * 1000).alias("x"), F.col("trade_vol").alias("y")
    )
    parts = table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), (F.col("p_retailprice") * 100).alias("x"), F.col("p_size").alias("y")
    )
    found = J.nearest_centroid(points, parts, block=100)
    return found.select("trade_no", "centroid_id", F.round("distance", 6).alias("distance"))


@query("j8_co_partition", "SELECT user_id, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    placed = J.co_partition(table(spark, d, "events").select("user_id"), "user_id")
    return placed.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p12_format_q3",
    f"SELECT concat('joinResult: ', chr(123), ' name:', name, ', city: ', city, ', state: ', state, ', auctionId: ', "
    f"CAST(auction_id AS STRING), chr(125)) AS value FROM ({_Q3})",
)
def _(spark, d):
    return P.format_local_item(J.q3_local_items(view(spark, d, "persons"), view(spark, d, "auctions"), HOURS_6))


@query(
    "p12_format_q8",
    f"SELECT concat('joinResult: ', chr(123), ' personId:', CAST(person_id AS STRING), ', personName: ', name, "
    f"', auctionReserve: ', CAST(reserve AS STRING), chr(125)) AS value FROM ({_Q8})",
)
def _(spark, d):
    return P.format_new_seller(J.q8_new_sellers(view(spark, d, "persons"), view(spark, d, "auctions"), HOURS_6))


# --- aggregates ------------------------------------------------------------------------------


@query(
    "g1_keyed_window_count",
    """SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, auction,
              count(*) AS count FROM {bids_ev} GROUP BY ALL""",
)
def _(spark, d):
    return tumbling_count(view(spark, d, "bids_ev"), "auction", 86_400)


@query(
    "g2_word_count",
    """WITH s AS (SELECT string_split(text, ' ') AS w FROM documents),
            t AS (SELECT w, len(w) - coalesce(list_position(list_reverse([x <> '' for x in w]), true), len(w) + 1) + 1 AS n FROM s)
       SELECT unnest(w[1:n]) AS word, count(*) AS count FROM t GROUP BY 1""",
)
def _(spark, d):
    return A.word_count(table(spark, d, "documents"), "text")


_WIKI_STATS = f"""
    w AS ({_WIKI}),
    b AS (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS window_start FROM w),
    stats AS (SELECT window_start, count(*) AS edits, CAST(sum(byte_diff) AS BIGINT) AS bytes_added,
                count(DISTINCT title) AS unique_titles, count(*) - count(DISTINCT title) AS repeat_edits,
                count(*) FILTER (k % 4 IN (0, 3)) AS is_minor, count(*) FILTER (k % 4 = 1) AS is_new,
                count(*) FILTER (k % 4 IN (2, 3)) AS is_bot_edit, count(*) FILTER (k % 10 = 0) AS is_talk
              FROM b GROUP BY 1)
"""


def _flat(stats):
    flags = {n: F.coalesce(F.col("counts")[n.replace("_", "-")], F.lit(0)) for n in ("is_minor", "is_new", "is_bot_edit", "is_talk")}
    return stats.withColumns(flags).drop("counts", "window_end")


@query("g3_wiki_window_stats", f"WITH {_WIKI_STATS} SELECT * FROM stats")
def _(spark, d):
    return _flat(wiki.wiki_window_stats(wiki.parse_edits(view(spark, d, "wiki_events")), 3600))


@query(
    "g4_edits_all_time",
    f"""WITH {_WIKI_STATS}
        SELECT window_start, edits, CAST(sum(edits) OVER (ORDER BY window_start) AS BIGINT) AS edits_all_time FROM stats""",
)
def _(spark, d):
    stats = wiki.wiki_window_stats(wiki.parse_edits(view(spark, d, "wiki_events")), 3600)
    return wiki.edits_all_time(stats.select("window_start", "edits"))


def counted_changes(spark, d):
    return A.neighbour_counts(view(spark, d, "fraud_records"), "entity", ["ts", "event_id"], "state")


@query("g5_transition_counts", f"WITH {_COUNTS} SELECT from_state, to_state, c AS count FROM counted")
def _(spark, d):
    return counted_changes(spark, d)


@query("g5_transition_counts_of_lines", f"WITH {_COUNTS} SELECT from_state, to_state, c AS count FROM counted")
def _(spark, d):
    return A.transition_counts(_GROUPED(spark, d))


@query(
    "g6_transition_probability",
    f"""WITH {_COUNTS}
        SELECT from_no, from_state, to_no, to_state, n * 1000 // sum(n) OVER (PARTITION BY from_no) AS p FROM smooth""",
)
def _(spark, d):
    return markov.transition_probability(counted_changes(spark, d), STATES, 1000)


@query(
    "g7_group_concat",
    """SELECT entity, concat(entity, ',', string_agg(state, ',' ORDER BY ts, event_id)) AS line
       FROM {fraud_records} GROUP BY 1""",
)
def _GROUPED(spark, d):
    return A.group_concat(view(spark, d, "fraud_records"), "entity", [1], "record", ["ts", "event_id"])


@query(
    "g7_group_items",
    """SELECT entity, row_number() OVER (PARTITION BY entity ORDER BY ts, event_id) AS position, state AS item
       FROM {fraud_records}""",
)
def _(spark, d):
    return A.group_items(view(spark, d, "fraud_records"), "entity", [1], "record", ["ts", "event_id"])


@query(
    "g8_contingency_table",
    """SELECT event_type AS row_label, CAST(k % 4 AS STRING) AS col_label, count(*) AS value,
              CAST(sum(count(*)) OVER (PARTITION BY event_type) AS BIGINT) AS row_sum,
              CAST(sum(count(*)) OVER (PARTITION BY k % 4) AS BIGINT) AS col_sum FROM {ev} GROUP BY event_type, k % 4""",
)
def _(spark, d):
    rows = view(spark, d, "ev").withColumn("c", (F.col("k") % 4).cast("string"))
    return A.contingency_table(rows, "event_type", "c")


@query(
    "g8_contingency_wide",
    """SELECT event_type AS row_label, count(*) FILTER (k % 4 = 0) AS "0", count(*) FILTER (k % 4 = 1) AS "1",
              count(*) FILTER (k % 4 = 2) AS "2", count(*) FILTER (k % 4 = 3) AS "3" FROM {ev} GROUP BY 1""",
)
def _(spark, d):
    rows = view(spark, d, "ev").withColumn("c", (F.col("k") % 4).cast("string"))
    return A.contingency_wide(A.contingency_table(rows, "event_type", "c"), ["0", "1", "2", "3"])


@query(
    "g9_mean_stat",
    "SELECT event_type, round(sum(value), 4) AS total, count(*) AS count, round(avg(value), 6) AS mean FROM events GROUP BY 1",
)
def _(spark, d):
    out = S.mean_stat(table(spark, d, "events"), ["event_type"], "value")
    return out.withColumns({"total": F.round("total", 4), "mean": F.round("mean", 6)})


_BINS = """
    v AS (SELECT event_type, CAST(floor(value) AS BIGINT) AS value, k % 3 + 1 AS weight FROM {ev}),
    totals AS (SELECT event_type, CAST(sum(weight) AS BIGINT) AS total,
                 CAST(trunc(sum(value * weight) / sum(weight)) AS BIGINT) AS mean FROM v GROUP BY 1),
    bins AS (SELECT event_type, value // 20 AS bin, CAST(sum(weight) AS BIGINT) AS count, mean, total
             FROM v JOIN totals USING (event_type) GROUP BY ALL)
"""


def _bins(spark, d):
    rows = view(spark, d, "ev").select(
        "event_type", F.floor("value").alias("value"), (F.col("k") % 3 + 1).alias("weight")
    )
    return S.histogram(rows, ["event_type"], "value", 20, F.col("weight"))


@query("g10_histogram", f"WITH {_BINS} SELECT * FROM bins")
def _(spark, d):
    return _bins(spark, d)


@query(
    "g11_histogram_confidence",
    f"""WITH {_BINS},
        r AS (SELECT event_type, mean // 20 AS mean_bin, abs(bin - mean // 20) AS ring, count, total FROM bins),
        g AS (SELECT event_type, mean_bin, o.ring AS steps, CAST(sum(r.count) FILTER (r.ring <= o.ring) AS BIGINT) AS inside,
                any_value(total) AS total
              FROM r, (SELECT unnest(range(1, 200)) AS ring) o GROUP BY 1, 2, 3),
        s AS (SELECT event_type, mean_bin, min(steps) AS steps FROM g WHERE inside >= total * 60 // 100 GROUP BY 1, 2)
        SELECT event_type, CAST(trunc((mean_bin - steps + 0.5) * 20) AS BIGINT) AS lower,
               CAST(trunc((mean_bin + steps + 0.5) * 20) AS BIGINT) AS upper FROM s""",
)
def _(spark, d):
    return S.histogram_confidence(_bins(spark, d), ["event_type"], 20, 60)


@query(
    "g12_entropy_histogram",
    """WITH c AS (SELECT event_type, k, count(*) AS n FROM {ev} GROUP BY 1, 2),
            p AS (SELECT event_type, n / sum(n) OVER (PARTITION BY event_type) AS p FROM c)
       SELECT event_type, round(-sum(p * log2(p)), 6) AS entropy FROM p GROUP BY 1""",
)
def _(spark, d):
    return S.entropy_histogram(view(spark, d, "ev"), ["event_type"], "k").withColumn("entropy", F.round("entropy", 6))


@query(
    "g13_entropy_normal",
    """SELECT event_type, round(0.5 * ln(2 * pi() * exp(1) * power(stddev_samp(value), 2)), 6) AS entropy
       FROM events GROUP BY 1""",
)
def _(spark, d):
    out = S.entropy_normal(table(spark, d, "events"), ["event_type"], "value")
    return out.withColumn("entropy", F.round("entropy", 6))


@query(
    "g14_mle_normal",
    """SELECT event_type, round(avg(value), 6) AS mu, round(stddev_samp(value), 6) AS sigma, count(*) AS n
       FROM events GROUP BY 1""",
)
def _(spark, d):
    out = S.mle_normal(table(spark, d, "events"), ["event_type"], "value")
    return out.withColumns({"mu": F.round("mu", 6), "sigma": F.round("sigma", 6)})


@query(
    "g15_outlier_fraction",
    """SELECT count(DISTINCT user_id) FILTER (value > 150) AS outliers, count(DISTINCT user_id) AS members,
              count(DISTINCT user_id) FILTER (value > 150) / count(DISTINCT user_id) AS fraction FROM events""",
)
def _(spark, d):
    return S.outlier_fraction(table(spark, d, "events"), "user_id", F.col("value") > 150)


@query(
    "g16_centroid_mean",
    f"""WITH {_CENTROIDS}
        SELECT CAST(sum(CAST(x AS BIGINT)) // count(*) AS BIGINT) AS mean_x,
               CAST(sum(CAST(y AS BIGINT)) // count(*) AS BIGINT) AS mean_y FROM centroids""",
)
def _(spark, d):
    return S.centroid_mean(centroids(spark, d))


# --- running values --------------------------------------------------------------------------


@query(
    "w1_running_price_sum",
    """SELECT trade_no, round(sum(trade_price) OVER w, 2) AS running_sum, count(*) OVER w AS running_count,
              round(sum(trade_price) OVER w, 2) / count(*) OVER w AS running_avg
       FROM {stock_trades} WINDOW w AS (PARTITION BY sec_code ORDER BY ts, trade_no ROWS UNBOUNDED PRECEDING)""",
)
def _(spark, d):
    out = W.running_price_sum(view(spark, d, "stock_trades").select("sec_code", "trade_no", "trade_price", "ts"))
    return out.select(
        "trade_no",
        F.round("running_sum", 2).alias("running_sum"),
        "running_count",
        (F.round("running_sum", 2) / F.col("running_count")).alias("running_avg"),
    )


@query(
    "w2_running_volume",
    """SELECT trade_no, CAST(sum(trade_vol) OVER (PARTITION BY sec_code ORDER BY ts, trade_no ROWS UNBOUNDED PRECEDING)
              AS BIGINT) AS running_volume FROM {stock_trades}""",
)
def _(spark, d):
    out = W.running_volume(view(spark, d, "stock_trades").select("sec_code", "trade_no", "trade_vol", "ts"))
    return out.select("trade_no", "running_volume")


@query(
    "w3_running_median",
    """SELECT trade_no, quantile_cont(trade_price, 0.5) OVER (PARTITION BY sec_code ORDER BY ts, trade_no
              ROWS UNBOUNDED PRECEDING) AS running_median FROM {stock_trades}""",
)
def _(spark, d):
    rows = view(spark, d, "stock_trades").select("sec_code", "trade_no", "ts", "trade_price")
    out = running_median(rows, ["sec_code"], ["ts", "trade_no"], "trade_price")
    return out.select("trade_no", "running_median")


@query(
    "w4_sliding_median",
    """SELECT event_id, quantile_cont(value, 0.5) OVER (PARTITION BY user_id ORDER BY ts, event_id
              ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS sliding_median FROM events""",
)
def _(spark, d):
    rows = view(spark, d, "ev").select("event_id", "user_id", "ts", "value")
    out = W.sliding_median(rows, ["user_id"], ["ts", "event_id"], "value", 7)
    return out.select("event_id", "sliding_median")


_SLOTS = """
    slots AS (SELECT event_type, epoch_us(ts) // 3600000000 AS slot, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS total
              FROM events GROUP BY 1, 2)
"""


@query(
    "w5_seasonal_median",
    f"""WITH {_SLOTS}
        SELECT event_type, slot, total,
               coalesce(CAST(quantile_cont(CAST(total AS DOUBLE), 0.5) OVER (PARTITION BY event_type, slot % 24 ORDER BY slot
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0.0) AS seasonal_median FROM slots""",
)
def _(spark, d):
    slot = F.floor(F.unix_seconds("ts") / 3600).alias("slot")
    per_slot = view(spark, d, "ev").groupBy("event_type", slot).agg(
        F.sum(F.floor(F.col("value") * 100)).alias("total")
    )
    return W.seasonal_median(per_slot, ["event_type"], "slot", "total", 24)


@query(
    "w6_ewma",
    """WITH RECURSIVE placed AS (
           SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
       warm AS (SELECT user_id, avg(value) AS start FROM placed WHERE n <= 10 GROUP BY 1),
       live AS (SELECT p.user_id, p.event_id, p.n, w.start AS level FROM placed p JOIN warm w USING (user_id) WHERE n = 11
                UNION ALL
                SELECT p.user_id, p.event_id, p.n, p.value * (2.0 / 31) + l.level * (1 - 2.0 / 31)
                FROM live l JOIN placed p ON p.user_id = l.user_id AND p.n = l.n + 1)
       SELECT event_id, round(coalesce(level, 0.0), 6) AS ewma FROM placed LEFT JOIN live USING (user_id, event_id)""",
)
def _(spark, d):
    rows = view(spark, d, "ev").select("event_id", "user_id", "ts", "value")
    out = W.ewma(rows, ["user_id"], ["ts", "event_id"], "value")
    return out.select("event_id", F.round("ewma", 6).alias("ewma"))


@query(
    "w7_sliding_avg_delay",
    """WITH t AS (SELECT user_id % 4 AS container, epoch_us(ts) // 3600000 AS tick, CAST(floor(value * 100) AS BIGINT) AS delay FROM events),
            a AS (SELECT container, tick, sum(delay) OVER w / count(*) OVER w AS avg_value FROM t
                  WINDOW w AS (PARTITION BY container ORDER BY tick RANGE BETWEEN 2000 PRECEDING AND CURRENT ROW))
       SELECT container, tick, round(any_value(avg_value), 6) AS avg_value FROM a GROUP BY 1, 2""",
)
def _(spark, d):
    rows = view(spark, d, "ev").select(
        (F.col("user_id") % 4).alias("container"),
        F.floor(F.unix_millis("ts") / 3600).alias("tick"),
        F.floor(F.col("value") * 100).alias("delay"),
    )
    out = W.sliding_avg(rows, ["container"], "tick", "delay")
    return out.withColumn("avg_value", F.round("avg_value", 6))


@query(
    "w7_delay_lines",
    """WITH t AS (SELECT concat('container', user_id % 4) AS container, epoch_us(ts) // 3600000 AS time,
                         CAST(floor(value * 100) AS DOUBLE) AS delay FROM events WHERE event_id % 10 > 0),
            a AS (SELECT container, time, sum(delay) OVER w / count(*) OVER w AS avg_value FROM t
                  WINDOW w AS (PARTITION BY container ORDER BY time RANGE BETWEEN 2000 PRECEDING AND CURRENT ROW))
       SELECT container, time, round(any_value(avg_value), 6) AS avg_value FROM a GROUP BY 1, 2""",
)
def _(spark, d):
    from millrace.sources.logs import parse_delay_log

    # Delay lines between other lines, as the executors print them.
    delay = F.concat_ws(
        ",",
        (F.col("user_id") % 64).cast("string"),
        F.floor(F.col("value") * 100).cast("string"),
        F.floor(F.unix_millis("ts") / 3600).cast("string"),
    )
    value = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("Partitions "), delay)).otherwise(
        F.concat(F.lit("Partition "), delay, F.lit(" "))
    )
    lines = view(spark, d, "ev").select(
        F.concat(F.lit("container"), (F.col("user_id") % 4).cast("string")).alias("container"), value.alias("value")
    )
    out = W.sliding_avg(parse_delay_log(lines), ["container"], "time", "delay")
    return out.withColumn("avg_value", F.round("avg_value", 6))


@query(
    "w11_markov_window",
    """SELECT event_id, array_to_string(array_agg(state) OVER (PARTITION BY entity ORDER BY ts, event_id
              ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), ',') AS states FROM {fraud_records}""",
)
def _(spark, d):
    out = markov.markov_window(view(spark, d, "fraud_records"), "entity", ["ts", "event_id"], "state")
    return out.select("event_id", F.array_join("states", ",").alias("states"))


@query(
    "w12_auction_phase",
    """SELECT order_no, CASE WHEN hour(ts) * 10000 + minute(ts) * 100 + second(ts) < 92500 THEN 'call'
                             ELSE 'continuous' END AS phase FROM {stock_new}""",
)
def _(spark, d):
    clock = time_to_int(F.date_format("ts", "HH:mm:ss"))
    return W.auction_phase(view(spark, d, "stock_new"), clock).select("order_no", "phase")


# --- selection -------------------------------------------------------------------------------


@query(
    "o1_select_kth",
    """SELECT event_type, event_id, value FROM (
           SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS n FROM events) WHERE n = 101""",
)
def _(spark, d):
    rows = table(spark, d, "events").select("event_type", "event_id", "value")
    return O.select_kth(rows, ["event_type"], "value", 100, ["event_id"])


@query("o2_secondary_sort", "SELECT user_id, value, event_id FROM events")
def _(spark, d):
    return O.secondary_sort(table(spark, d, "events").select("user_id", "value", "event_id"), "user_id", ["value", "event_id"])


_OPEN = "SELECT * FROM {stock_new} WHERE tran_maint_code = 'A'"


@query(
    "o3_price_levels",
    f"""WITH o AS ({_OPEN}),
        l AS (SELECT sec_code, trade_dir, order_price, CAST(sum(order_vol) AS BIGINT) AS volume, count(*) AS orders
              FROM o GROUP BY ALL)
        SELECT *, row_number() OVER (PARTITION BY sec_code, trade_dir ORDER BY CASE trade_dir WHEN 'B' THEN -order_price
               ELSE order_price END) AS level FROM l""",
)
def _(spark, d):
    return O.price_levels(P.drop_non_new_orders(view(spark, d, "stock_new")))


@query(
    "o4_top_of_book",
    f"""WITH o AS ({_OPEN}),
        b AS (SELECT sec_code, max(order_price) FILTER (trade_dir = 'B') AS best_bid,
                min(order_price) FILTER (trade_dir = 'S') AS best_ask FROM o GROUP BY 1)
        SELECT *, coalesce(best_ask <= best_bid, false) AS crossed FROM b""",
)
def _(spark, d):
    return O.top_of_book(P.drop_non_new_orders(view(spark, d, "stock_new")))


@query(
    "o5_sort_levels_desc",
    f"""WITH o AS ({_OPEN}) SELECT sec_code, trade_dir, order_price, CAST(sum(order_vol) AS BIGINT) AS volume
        FROM o GROUP BY ALL""",
)
def _(spark, d):
    orders = P.drop_non_new_orders(view(spark, d, "stock_new"))
    levels = orders.groupBy("sec_code", "trade_dir", "order_price").agg(F.sum("order_vol").cast("bigint").alias("volume"))
    return O.sort_levels_desc(levels)


@query("p11_read_tweets", "SELECT id_str, text, created_at FROM {tweets}")
def _(spark, d):
    lines = view(spark, d, "tweets").select(F.to_json(F.struct("id_str", "text", "created_at")).alias("value"))
    return read_tweets(lines).select("id_str", "text", "created_at")
