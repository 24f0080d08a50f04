"""Windows over event time, stateful applications and the two reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.scalars import time_to_int
from millrace.operators import matching as M
from millrace.operators.analytic import auction_phase
from millrace.plans import fraud, markov, scaling, slo, text, wiki
from millrace.registry.core import query
from millrace.registry.grouped import _CENTROIDS, _LEXICON_SQL, _TOKENS, _WIKI_STATS, _flat, centroids
from millrace.registry.sources import (
    _COUNTS,
    CONTROLLER_LOG,
    EXECUTOR_LOG,
    MIGRATION_LOG,
    SHORT_LEXICON_SQL,
    lexicon,
    short_lexicon,
    trained,
)
from millrace.registry.views import lines, view
from millrace.session import cut_lineage, shared_path
from millrace.sources import logs
from millrace.streaming.stateful import upsert_store
from millrace.streaming.windows import (
    session_count,
    tumbling_count,
    windowed_word_count,
    windowed_word_sessions,
)

HOURS_6 = 6 * 3600.0


def _tumbling(view_sql: str, key: str, seconds: int) -> str:
    span = f"INTERVAL {seconds} SECOND"
    return f"""SELECT time_bucket({span}, ts) AS window_start, time_bucket({span}, ts) + {span} AS window_end,
                      {key}, count(*) AS count FROM {view_sql} GROUP BY ALL"""


def _sessions(view_sql: str, key: str, seconds: int) -> str:
    return f"""
        WITH m AS (SELECT {key}, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL {seconds} SECOND THEN 1 ELSE 0 END AS opens
                   FROM {view_sql} WINDOW w AS (PARTITION BY {key} ORDER BY ts)),
             n AS (SELECT *, sum(opens) OVER (PARTITION BY {key} ORDER BY ts RANGE UNBOUNDED PRECEDING) AS no FROM m)
        SELECT min(ts) AS session_start, max(ts) + INTERVAL {seconds} SECOND AS session_end, {key}, count(*) AS count
        FROM n GROUP BY {key}, no"""


_WORDS = "(SELECT unnest(string_split(line, ' ')) AS word, ts FROM {word_lines})"


@query("t1_q5_tumbling_count", _tumbling("{bids_ev}", "auction", 60))
def _(spark, d):
    return tumbling_count(view(spark, d, "bids_ev"), "auction")


@query("t2_orders_per_security", _tumbling("{stock_orders}", "sec_code", 5))
def _(spark, d):
    return tumbling_count(view(spark, d, "stock_orders"), "sec_code", 5)


@query("t3_words_per_window", _tumbling(_WORDS, "word", 3600))
def _(spark, d):
    return windowed_word_count(view(spark, d, "word_lines"), 3600)


@query("t4_tumbling_fold", f"WITH {_WIKI_STATS} SELECT window_start, edits, bytes_added FROM stats")
def _(spark, d):
    stats = wiki.wiki_window_stats(wiki.parse_edits(view(spark, d, "wiki_events")), 3600)
    return stats.select("window_start", "edits", "bytes_added")


@query("t5_q11_session_count", _sessions("{bids_ev}", "bidder", 21600))
def _(spark, d):
    return session_count(view(spark, d, "bids_ev"), "bidder", HOURS_6)


@query("t5_session_count_60s", _sessions("{bids_ev}", "bidder", 60))
def _(spark, d):
    return session_count(view(spark, d, "bids_ev"), "bidder")


@query("t6_word_sessions", _sessions(_WORDS, "word", 600))
def _(spark, d):
    return windowed_word_sessions(view(spark, d, "word_lines"), 600)


@query("t8_upsert_store", "SELECT line AS message, count(*) AS puts FROM {word_lines} GROUP BY 1")
def _(spark, d):
    return upsert_store(view(spark, d, "word_lines"), "line")


# --- order matching --------------------------------------------------------------------------

_BOOK_KEYS = ("sec_code", "session")


def _orders(spark, d, name: str = "stock_orders"):
    """Orders with the trading session they belong to: here one month."""
    return view(spark, d, name).withColumn("session", F.date_format("ts", "yyyy-MM"))


# The book of the checks: one recursion step per order. Both sides are lists; an order takes the opposite
# orders it crosses in price and time order, each up to what the ones before it have left.
_ENTRY = "STRUCT(k DOUBLE, n BIGINT, no VARCHAR, v BIGINT)"


def _book_steps(books: str, bids: str = f"[]::{_ENTRY}[]", asks: str = f"[]::{_ENTRY}[]") -> str:
    """Recursive tables of a book; ``o`` (the numbered orders) and ``books`` must be there."""
    return f"""
    s AS (
        SELECT sec_code, session, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS no, {bids} AS bids, {asks} AS asks,
               []::STRUCT(buy VARCHAR, sell VARCHAR, price DOUBLE, volume BIGINT)[] AS fills
        FROM {books}
        UNION ALL
        SELECT sec_code, session, n, no,
               CASE WHEN dir = 'B' THEN own2 ELSE opp2 END, CASE WHEN dir = 'B' THEN opp2 ELSE own2 END,
               list_transform(list_filter(f, lambda z: z.f > 0), lambda z: {{
                   'buy': CASE WHEN dir = 'B' THEN no ELSE z.e.no END, 'sell': CASE WHEN dir = 'B' THEN z.e.no ELSE no END,
                   'price': CASE WHEN dir = 'B' THEN z.e.k ELSE p END, 'volume': z.f}})
        FROM (SELECT *,
                CASE WHEN code = 'D' THEN list_filter(own, lambda e: NOT (e.no = no AND e.k = key))
                     WHEN v - coalesce(list_sum(list_transform(f, lambda z: z.f)), 0) > 0 THEN
                         list_append(own, {{'k': key, 'n': n, 'no': no,
                                            'v': CAST(v - coalesce(list_sum(list_transform(f, lambda z: z.f)), 0) AS BIGINT)}})
                     ELSE own END AS own2,
                CASE WHEN code = 'D' THEN opp ELSE list_filter(list_concat(
                    list_filter(opp, lambda e: e.k > -key),
                    list_transform(f, lambda z: {{'k': z.e.k, 'n': z.e.n, 'no': z.e.no, 'v': z.e.v - z.f}})),
                    lambda e: e.v > 0) END AS opp2
              FROM (SELECT *,
                      CASE WHEN code = 'D' THEN [] ELSE list_transform(range(1, len(cand) + 1), lambda i: {{
                          'e': cand[i], 'f': CAST(greatest(0, least(cand[i].v,
                               v - coalesce(list_sum(list_transform(cand[1:i-1], lambda y: y.v)), 0))) AS BIGINT)}}) END AS f
                    FROM (SELECT *, list_sort(list_filter(opp, lambda e: e.k <= -key)) AS cand
                          FROM (SELECT s.sec_code, s.session, o.n, o.no, o.code, o.dir, o.p, o.v,
                                  CASE WHEN o.dir = 'B' THEN -o.p ELSE o.p END AS key,
                                  CASE WHEN o.dir = 'B' THEN s.bids ELSE s.asks END AS own,
                                  CASE WHEN o.dir = 'B' THEN s.asks ELSE s.bids END AS opp
                                FROM s JOIN o ON o.sec_code = s.sec_code AND o.session = s.session AND o.n = s.n + 1)))))"""


def _numbered(where: str) -> str:
    return f"""o AS (
        SELECT sec_code, strftime(ts, '%Y-%m') AS session, order_no AS no, tran_maint_code AS code, trade_dir AS dir,
               order_price AS p, CAST(order_vol AS BIGINT) AS v,
               row_number() OVER (PARTITION BY sec_code, strftime(ts, '%Y-%m') ORDER BY ts, order_no) AS n
        FROM {{stock_orders}} WHERE tran_maint_code NOT IN ('X', ''){where})"""


_BOOK = f"WITH RECURSIVE {_numbered('')}, {_book_steps('(SELECT DISTINCT sec_code, session FROM o)')}"
_PER_ORDER = """SELECT sec_code, session, no AS order_no, CAST(list_sum(list_transform(fills, lambda z: z.volume)) AS BIGINT) AS volume,
                       fills[-1].price AS price, CAST(len(fills) AS INT) AS fills FROM s WHERE len(fills) > 0"""


@query("m1_match_orders_book", f"{_BOOK} {_PER_ORDER}")
def _(spark, d):
    return M.match_orders_book(_orders(spark, d), _BOOK_KEYS)


@query(
    "m1_book_fills",
    f"""{_BOOK} SELECT sec_code, session, f.buy AS buy_order_no, f.sell AS sell_order_no, f.price AS price, f.volume AS volume
        FROM (SELECT sec_code, session, unnest(fills) AS f FROM s)""",
)
def _(spark, d):
    return M.book_fills(_orders(spark, d), _BOOK_KEYS)


@query(
    "m1_resting_orders",
    f"""{_BOOK}, ends AS (SELECT * FROM s QUALIFY n = max(n) OVER (PARTITION BY sec_code, session))
        SELECT sec_code, session, 'B' AS trade_dir, -e.k AS order_price, e.no AS order_no, e.v AS order_vol
        FROM (SELECT sec_code, session, unnest(bids) AS e FROM ends)
        UNION ALL
        SELECT sec_code, session, 'S', e.k, e.no, e.v FROM (SELECT sec_code, session, unnest(asks) AS e FROM ends)""",
)
def _(spark, d):
    return M.resting_orders(_orders(spark, d), _BOOK_KEYS)


# Books that are kept over the whole run: an order rests until it trades or is deleted, in whichever month.
_WHOLE_RUN = f"""WITH RECURSIVE o AS (
        SELECT sec_code, 'all' AS session, order_no AS no, tran_maint_code AS code, trade_dir AS dir, order_price AS p,
               CAST(order_vol AS BIGINT) AS v, row_number() OVER (PARTITION BY sec_code ORDER BY ts, order_no) AS n
        FROM {{stock_orders}} WHERE tran_maint_code NOT IN ('X', '')),
    {_book_steps('(SELECT DISTINCT sec_code, session FROM o)')}"""


@query(
    "m1_whole_run_match_orders",
    f"{_WHOLE_RUN}, r AS ({_PER_ORDER}) SELECT sec_code, order_no, volume, price, fills FROM r",
)
def _(spark, d):
    return M.match_orders_book(view(spark, d, "stock_orders"))


@query(
    "m1_whole_run_fills",
    f"""{_WHOLE_RUN} SELECT sec_code, f.buy AS buy_order_no, f.sell AS sell_order_no, f.price AS price, f.volume AS volume
        FROM (SELECT sec_code, unnest(fills) AS f FROM s)""",
)
def _(spark, d):
    return M.book_fills(view(spark, d, "stock_orders"))


@query(
    "m1_whole_run_resting_orders",
    f"""{_WHOLE_RUN}, ends AS (SELECT * FROM s QUALIFY n = max(n) OVER (PARTITION BY sec_code))
        SELECT sec_code, 'B' AS trade_dir, -e.k AS order_price, e.no AS order_no, e.v AS order_vol
        FROM (SELECT sec_code, unnest(bids) AS e FROM ends)
        UNION ALL SELECT sec_code, 'S', e.k, e.no, e.v FROM (SELECT sec_code, unnest(asks) AS e FROM ends)""",
)
def _(spark, d):
    return M.resting_orders(view(spark, d, "stock_orders"))


# The book is kept over all sessions: the default keys. Trades of whole securities, compared by their totals, which
# any order of equal times must give: what was placed is filled, deleted or still rests.
@query(
    "m1_book_balance",
    """SELECT sec_code, CAST(sum(order_vol) AS BIGINT) AS placed, true AS balanced, true AS uncrossed
       FROM {stock_orders} WHERE tran_maint_code NOT IN ('X', '', 'D') GROUP BY 1""",
)
def _(spark, d):
    return M.book_balance(view(spark, d, "stock_orders"))


_SLOT_STEP = """
    WITH RECURSIVE o AS (
        SELECT sec_code, order_no, order_price AS p, CAST(order_vol AS BIGINT) AS v, trade_dir,
               row_number() OVER (PARTITION BY sec_code, strftime(ts, '%Y-%m') ORDER BY ts, order_no) AS n,
               strftime(ts, '%Y-%m') AS session
        FROM {stock_orders} WHERE tran_maint_code = 'A'),
    s AS (
        SELECT sec_code, session, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS bo, CAST(NULL AS DOUBLE) AS bp,
               CAST(0 AS BIGINT) AS bv, CAST(NULL AS VARCHAR) AS so, CAST(NULL AS DOUBLE) AS sp, CAST(0 AS BIGINT) AS sv,
               CAST(0 AS BIGINT) AS traded
        FROM o WHERE n = 1
        UNION ALL
        SELECT sec_code, session, n, bo, bp, bv, so, sp, sv,
               CASE WHEN bv > 0 AND sv > 0 AND bp >= sp THEN least(bv, sv) ELSE 0 END AS traded
        FROM (SELECT s.sec_code, s.session, o.n,
                 CASE o.trade_dir WHEN 'B' THEN o.order_no ELSE s.bo END AS bo,
                 CASE o.trade_dir WHEN 'B' THEN o.p ELSE s.bp END AS bp,
                 CASE o.trade_dir WHEN 'B' THEN o.v ELSE s.bv - s.traded END AS bv,
                 CASE o.trade_dir WHEN 'S' THEN o.order_no ELSE s.so END AS so,
                 CASE o.trade_dir WHEN 'S' THEN o.p ELSE s.sp END AS sp,
                 CASE o.trade_dir WHEN 'S' THEN o.v ELSE s.sv - s.traded END AS sv
              FROM s JOIN o ON o.sec_code = s.sec_code AND o.session = s.session AND o.n = s.n + 1))
    SELECT sec_code, session, bo AS buy_order_no, so AS sell_order_no, bp AS buy_price, sp AS sell_price, traded AS volume
    FROM s WHERE traded > 0
"""


@query("m2_match_orders_single", _SLOT_STEP)
def _(spark, d):
    return M.match_orders_single(_orders(spark, d), _BOOK_KEYS)


@query(
    "m2_whole_run_match_orders_single",
    "SELECT * EXCLUDE (session) FROM ("
    + _SLOT_STEP.replace("strftime(ts, '%Y-%m') ORDER", "'all' ORDER").replace("strftime(ts, '%Y-%m') AS", "'all' AS")
    + ")",
)
def _(spark, d):
    return M.match_orders_single(view(spark, d, "stock_orders"))


@query("m2_relay_orders", "SELECT sec_code AS key, order_no FROM {stock_orders} WHERE tran_maint_code = 'A'")
def _(spark, d):
    return M.relay_orders(view(spark, d, "stock_orders")).select("key", "value.order_no")


def _call_phase(spark, d):
    clock = time_to_int(F.date_format("ts", "HH:mm:ss"))
    phased = auction_phase(_orders(spark, d), clock)
    return cut_lineage(M.standing_orders(phased.filter(F.col("phase") == "call"), _BOOK_KEYS))


_STANDING = """
    live AS (SELECT *, strftime(ts, '%Y-%m') AS session FROM {stock_orders}
             WHERE tran_maint_code NOT IN ('X', '') AND hour(ts) * 10000 + minute(ts) * 100 + second(ts) < 92500),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY sec_code, session, trade_dir, order_no
                                            ORDER BY ts DESC, tran_maint_code DESC) AS r FROM live),
    standing AS (SELECT * FROM ranked WHERE r = 1 AND tran_maint_code <> 'D'),
    queue AS (SELECT *, sum(order_vol) OVER (PARTITION BY sec_code, session, trade_dir
                  ORDER BY CASE trade_dir WHEN 'B' THEN -order_price ELSE order_price END, ts, order_no
                  ROWS UNBOUNDED PRECEDING) AS hi FROM standing)
"""


@query(
    "m3_call_auction",
    f"""WITH {_STANDING}
        SELECT b.sec_code, b.session, b.order_no AS buy_order_no, s.order_no AS sell_order_no,
               b.order_price AS buy_price, s.order_price AS sell_price,
               CAST(least(b.hi, s.hi) - greatest(b.hi - b.order_vol, s.hi - s.order_vol) AS BIGINT) AS volume
        FROM queue b JOIN queue s ON b.sec_code = s.sec_code AND b.session = s.session
             AND b.trade_dir = 'B' AND s.trade_dir = 'S' AND b.order_price >= s.order_price
             AND least(b.hi, s.hi) > greatest(b.hi - b.order_vol, s.hi - s.order_vol)""",
)
def _(spark, d):
    return M.call_auction(_call_phase(spark, d), _BOOK_KEYS)


_AUCTION = """
    matched AS (SELECT b.sec_code, b.session, b.order_no AS bo, s.order_no AS so,
                  CAST(least(b.hi, s.hi) - greatest(b.hi - b.order_vol, s.hi - s.order_vol) AS BIGINT) AS volume
                FROM queue b JOIN queue s ON b.sec_code = s.sec_code AND b.session = s.session
                  AND b.trade_dir = 'B' AND s.trade_dir = 'S' AND b.order_price >= s.order_price
                  AND least(b.hi, s.hi) > greatest(b.hi - b.order_vol, s.hi - s.order_vol)),
    used AS (SELECT sec_code, session, dir, order_no, sum(volume) AS used FROM (
               SELECT sec_code, session, 'B' AS dir, bo AS order_no, volume FROM matched
               UNION ALL SELECT sec_code, session, 'S', so, volume FROM matched) GROUP BY ALL),
    opening AS (SELECT q.sec_code, q.session, q.trade_dir, q.order_no, q.order_price, q.ts,
                  CAST(q.order_vol - coalesce(u.used, 0) AS BIGINT) AS vol
                FROM standing q LEFT JOIN used u ON u.sec_code = q.sec_code AND u.session = q.session
                     AND u.dir = q.trade_dir AND u.order_no = q.order_no
                WHERE q.order_vol > coalesce(u.used, 0)),
    seeds AS (SELECT sec_code, session, trade_dir, {'k': CASE trade_dir WHEN 'B' THEN -order_price ELSE order_price END,
                  'n': row_number() OVER (PARTITION BY sec_code, session ORDER BY ts, order_no) - 1000000000,
                  'no': order_no, 'v': vol} AS e FROM opening),
    books AS (SELECT sec_code, session,
                coalesce((SELECT list(e) FROM seeds WHERE seeds.sec_code = x.sec_code AND seeds.session = x.session AND trade_dir = 'B'), []) AS bids,
                coalesce((SELECT list(e) FROM seeds WHERE seeds.sec_code = x.sec_code AND seeds.session = x.session AND trade_dir = 'S'), []) AS asks
              FROM (SELECT DISTINCT sec_code, session FROM o) x)
"""

# Buys from the highest price down; each takes the dearest sells it accepts, first come first served in a level.
_DESC = f"""WITH RECURSIVE {_STANDING},
    buys AS (SELECT sec_code, session, order_no AS no, order_price AS p, CAST(order_vol AS BIGINT) AS v,
               row_number() OVER (PARTITION BY sec_code, session ORDER BY -order_price, ts, order_no) AS n
             FROM standing WHERE trade_dir = 'B'),
    sells AS (SELECT sec_code, session, list({{'k': -order_price, 'n': n, 'no': order_no, 'v': CAST(order_vol AS BIGINT)}}) AS q
              FROM (SELECT *, row_number() OVER (PARTITION BY sec_code, session ORDER BY ts, order_no) AS n
                    FROM standing WHERE trade_dir = 'S') GROUP BY 1, 2),
    s AS (SELECT sec_code, session, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS no, CAST(NULL AS DOUBLE) AS p, q,
                 []::STRUCT(e {_ENTRY}, f BIGINT)[] AS f FROM sells
          UNION ALL
          SELECT sec_code, session, n, no, p,
                 list_filter(list_concat(list_filter(q, lambda e: e.k < -p),
                     list_transform(f, lambda z: {{'k': z.e.k, 'n': z.e.n, 'no': z.e.no, 'v': z.e.v - z.f}})), lambda e: e.v > 0), f
          FROM (SELECT *, list_transform(range(1, len(cand) + 1), lambda i: {{'e': cand[i], 'f': CAST(greatest(0, least(cand[i].v,
                          v - coalesce(list_sum(list_transform(cand[1:i-1], lambda y: y.v)), 0))) AS BIGINT)}}) AS f
                FROM (SELECT s.sec_code, s.session, b.n, b.no, b.p, b.v, s.q, list_sort(list_filter(s.q, lambda e: e.k >= -b.p)) AS cand
                      FROM s JOIN buys b ON b.sec_code = s.sec_code AND b.session = s.session AND b.n = s.n + 1)))
    SELECT sec_code, session, no AS buy_order_no, z.e.no AS sell_order_no, p AS buy_price, -z.e.k AS sell_price, z.f AS volume
    FROM (SELECT sec_code, session, no, p, unnest(f) AS z FROM s) WHERE z.f > 0"""


@query("m3_call_auction_desc", _DESC)
def _(spark, d):
    return M.call_auction(_call_phase(spark, d), _BOOK_KEYS, sell_order="desc")


@query(
    "m3_auction_depth",
    f"""WITH {_STANDING},
        prices AS (SELECT DISTINCT sec_code, session, order_price FROM standing),
        depth AS (SELECT p.sec_code, p.session, p.order_price,
                    CAST(coalesce(sum(order_vol) FILTER (trade_dir = 'B' AND s.order_price >= p.order_price), 0) AS BIGINT) AS bid_depth,
                    CAST(coalesce(sum(order_vol) FILTER (trade_dir = 'S' AND s.order_price <= p.order_price), 0) AS BIGINT) AS ask_depth
                  FROM prices p JOIN standing s USING (sec_code, session) GROUP BY 1, 2, 3)
        SELECT *, least(bid_depth, ask_depth) AS cleared FROM depth""",
)
def _(spark, d):
    return M.auction_depth(_call_phase(spark, d), _BOOK_KEYS)


@query(
    "m3_uniform_price",
    f"""WITH {_STANDING},
        prices AS (SELECT DISTINCT sec_code, session, order_price FROM standing),
        depth AS (SELECT p.sec_code, p.session, p.order_price, least(
                    coalesce(sum(order_vol) FILTER (trade_dir = 'B' AND s.order_price >= p.order_price), 0),
                    coalesce(sum(order_vol) FILTER (trade_dir = 'S' AND s.order_price <= p.order_price), 0)) AS cleared
                  FROM prices p JOIN standing s USING (sec_code, session) GROUP BY 1, 2, 3)
        SELECT sec_code, session, order_price AS clearing_price, CAST(cleared AS BIGINT) AS cleared_volume FROM depth
        QUALIFY row_number() OVER (PARTITION BY sec_code, session ORDER BY cleared DESC, order_price) = 1""",
)
def _(spark, d):
    return M.uniform_price(M.auction_depth(_call_phase(spark, d), _BOOK_KEYS), _BOOK_KEYS)


_LATER = " AND hour(ts) * 10000 + minute(ts) * 100 + second(ts) >= 92500"


@query(
    "m4_match_orders_continuous",
    f"WITH RECURSIVE {_STANDING}, {_numbered(_LATER)}, {_AUCTION}, {_book_steps('books', 'bids', 'asks')} {_PER_ORDER}",
)
def _(spark, d):
    standing = _call_phase(spark, d)
    opening = M.after_call(standing, M.call_auction(standing, _BOOK_KEYS), _BOOK_KEYS)
    clock = time_to_int(F.date_format("ts", "HH:mm:ss"))
    later = auction_phase(_orders(spark, d), clock).filter(F.col("phase") == "continuous")
    return M.match_orders_continuous(later, opening, _BOOK_KEYS)


# --- Markov scoring --------------------------------------------------------------------------

_PENALTIES = """
    costs AS (SELECT from_state, to_state, sum(p) OVER (PARTITION BY from_no) - p AS miss_probability,
                CASE WHEN to_no = max_by(to_no, (p, -to_no)) OVER (PARTITION BY from_no) THEN 0.0 ELSE 1.0 END AS miss_rate,
                sum(-p * ln(p)) OVER (PARTITION BY from_no) AS entropy FROM model),
    steps AS (SELECT entity, ts, event_id, state, lag(state) OVER (PARTITION BY entity ORDER BY ts, event_id) AS before
              FROM {fraud_records}),
    priced AS (SELECT s.*, c.miss_probability, c.miss_rate, c.entropy
               FROM steps s LEFT JOIN costs c ON c.from_state = s.before AND c.to_state = s.state)
"""


def _local_score(column: str, threshold: float = 0.96) -> str:
    return f"""WITH {_COUNTS}, {_PENALTIES},
        w AS (SELECT entity, event_id,
                CASE WHEN row_number() OVER (PARTITION BY entity ORDER BY ts, event_id) >= 5
                     THEN sum({column}) OVER (PARTITION BY entity ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) / 4
                     ELSE 0.0 END AS score FROM priced)
        SELECT entity, event_id, round(score, 6) AS score, score > {threshold} AS outlier FROM w"""


def _shown(scored):
    return scored.select("entity", "event_id", F.round("score", 6).alias("score"), "outlier")


@query("m5_markov_score", _local_score("miss_probability"))
def _(spark, d):
    return _shown(markov.markov_score(view(spark, d, "fraud_records"), trained(spark, d)))


@query("m5_markov_score_miss_rate", _local_score("miss_rate"))
def _(spark, d):
    return _shown(markov.markov_score(view(spark, d, "fraud_records"), trained(spark, d), algorithm="missRate"))


@query("m5_markov_score_entropy", _local_score("entropy"))
def _(spark, d):
    return _shown(markov.markov_score(view(spark, d, "fraud_records"), trained(spark, d), algorithm="entropyReduction"))


@query(
    "m6_markov_score_global",
    f"""WITH {_COUNTS}, {_PENALTIES},
        w AS (SELECT entity, event_id, coalesce(sum(miss_probability) OVER x / nullif(count(before) OVER x, 0), 0.0) AS score
              FROM priced WINDOW x AS (PARTITION BY entity ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
        SELECT entity, event_id, round(score, 6) AS score, score > 0.96 AS outlier FROM w""",
)
def _(spark, d):
    return _shown(markov.markov_score_global(view(spark, d, "fraud_records"), trained(spark, d)))


@query(
    "m7_train_markov",
    f"""WITH {_COUNTS} SELECT from_no, from_state, to_no, to_state, round(p, 9) AS p FROM model""",
)
def _(spark, d):
    return trained(spark, d).withColumn("p", F.round("p", 9))


# --- sentiment, fraud clusters, wiki ---------------------------------------------------------


@query(
    "m8_sentiment_score",
    f"""WITH {_TOKENS}, lexicon AS ({SHORT_LEXICON_SQL}),
        s AS (SELECT doc_id, coalesce(sum(score), 0) AS score FROM tokens t LEFT JOIN lexicon l ON l.word = t.word GROUP BY 1)
        SELECT CAST(doc_id AS STRING) AS id_str, CAST(score AS BIGINT) AS score,
               CASE WHEN score > 0 THEN 'Positive' WHEN score < 0 THEN 'Negative' ELSE 'Neutral' END AS sentiment FROM s""",
)
def _(spark, d):
    return text.classify("basic", view(spark, d, "tweets"), short_lexicon(spark))


@query(
    "m8_sentiment_loaded_lexicon",
    f"""WITH {_TOKENS}, {_LEXICON_SQL},
        s AS (SELECT doc_id, coalesce(sum(score), 0) AS score FROM tokens t LEFT JOIN lexicon l ON l.word = t.word GROUP BY 1)
        SELECT CAST(doc_id AS STRING) AS id_str, CAST(score AS BIGINT) AS score,
               CASE WHEN score > 0 THEN 'Positive' WHEN score < 0 THEN 'Negative' ELSE 'Neutral' END AS sentiment FROM s""",
)
def _(spark, d):
    return text.classify("basic", view(spark, d, "tweets"), lexicon(spark, d))


@query(
    "m9_fraud_nearest_cluster",
    f"""WITH {_CENTROIDS}
        SELECT trade_no, (SELECT min_by(id, (dp * dp + dv * dv, id)) FROM (
                   SELECT id, t.trade_price * 1000 - c.x AS dp, t.trade_vol - c.y AS dv FROM centroids c)) AS cluster FROM {{stock_trades}} t""",
)
def _(spark, d):
    return fraud.nearest_cluster(view(spark, d, "stock_trades"), centroids(spark, d)).select("trade_no", "cluster")


@query(
    "m9_fit_clusters",
    "SELECT trade_no, true AS settled FROM {stock_trades} WHERE trade_price IS NOT NULL AND trade_vol IS NOT NULL",
)
def _(spark, d):
    # The fitted centers are fed to the assignment: every trade lies in the cluster that the fit put it in.
    return fraud.settled(view(spark, d, "stock_trades"), k=20, seed=7, max_iter=5).select("trade_no", "settled")


@query(
    "m10_wiki_stats",
    f"""WITH {_WIKI_STATS}
        SELECT *, CAST(sum(edits) OVER (ORDER BY window_start) AS BIGINT) AS edits_all_time FROM stats""",
)
def _(spark, d):
    events = view(spark, d, "wiki_events")
    channels = [events.filter(F.col("channel") == c) for c in ("wikipedia", "wikinews", "wiktionary")]
    return _flat(wiki.wiki_stats(channels, 3600))


@query("m10_dropped_lines", "SELECT channel, count(*) FILTER (event_id % 7 > 0) AS parsed, count(*) FILTER (event_id % 7 = 0) AS dropped FROM {wiki_events} GROUP BY 1")
def _(spark, d):
    broken = F.when(F.col("event_id") % 7 == 0, F.col("source")).otherwise(F.col("raw"))
    return wiki.count_drops(view(spark, d, "wiki_events").withColumn("raw", broken))


# --- latency report --------------------------------------------------------------------------

_SLOTS = """
    start AS (SELECT min(ts_ms) AS t0 FROM log WHERE kind = 'gt' AND ts_ms <> 0),
    lat AS (SELECT substream, (ts_ms - t0) // 1000 AS slot, CAST(sum(n) AS BIGINT) AS n,
              CAST(sum(latency_ms) AS BIGINT) AS latency_ms, sum(latency_ms) / sum(n) AS avg_latency
            FROM log, start WHERE kind = 'gt' GROUP BY 1, 2),
    rates AS (SELECT substream, count(*) FILTER (avg_latency > 1000 AND slot BETWEEN 120 AND 720) AS violations FROM lat GROUP BY 1)
"""


def _log(spark, d):
    return logs.parse_executor_log(lines(spark, d, "executor_lines"))


def _compact(spark, d):
    return slo.compact_log(_log(spark, d))


def _latency(spark, d):
    return slo.slo_window_latency(_compact(spark, d))


@query("g17_slo_window_latency", f"WITH {EXECUTOR_LOG}, {_SLOTS} SELECT * FROM lat")
def _(spark, d):
    return _latency(spark, d)


@query(
    "g18_slo_success_rate",
    f"""WITH {EXECUTOR_LOG}, {_SLOTS}
        SELECT substream, violations, CAST(601 AS BIGINT) AS slots, 1 - violations / 601 AS success_rate FROM rates""",
)
def _(spark, d):
    return slo.slo_success_rate(_latency(spark, d))


@query(
    "g18_slo_overall",
    f"""WITH {EXECUTOR_LOG}, {_SLOTS}
        SELECT CAST(sum(violations) AS BIGINT) AS violations, count(*) * 601 AS slots,
               1 - sum(violations) / (count(*) * 601) AS success_rate FROM rates""",
)
def _(spark, d):
    return slo.slo_overall(slo.slo_success_rate(_latency(spark, d)))


_PEAK = """
    p AS (SELECT count(*) FILTER (avg_latency > 1000 AND slot BETWEEN 120 AND 720) AS violations,
            count(*) FILTER (avg_latency > 1000 AND slot BETWEEN 0 AND 120) AS peak_0_violations,
            count(*) FILTER (avg_latency > 1000 AND slot BETWEEN 300 AND 390) AS peak_1_violations,
            count(DISTINCT substream) AS streams FROM lat),
    peak AS (SELECT violations, peak_0_violations, peak_1_violations,
               1 - CASE WHEN violations > 0 THEN (violations - peak_0_violations - peak_1_violations) / (streams * (601 - 121 - 91))
                        ELSE violations / (streams * 601) END AS off_peak_success_rate FROM p)
"""
_PEAK_SLOTS = ((0, 120), (300, 390))


@query("g19_slo_peak_split", f"WITH {EXECUTOR_LOG}, {_SLOTS}, {_PEAK} SELECT * FROM peak")
def _(spark, d):
    return slo.slo_peak_split(_latency(spark, d), _PEAK_SLOTS)


_LIFE = """
    per AS (SELECT container, min_by(ts_ms, line_no) FILTER (kind = 'restore') AS restore,
              max_by(ts_ms, line_no) FILTER (kind = 'gt') AS last_gt,
              max_by(ts_ms, line_no) FILTER (kind = 'shutdown') AS last_end,
              max_by(host, line_no) FILTER (kind = 'host') AS host FROM log GROUP BY 1),
    life AS (SELECT container, host,
               greatest(least(greatest(coalesce(last_gt + 1000 - t0, greatest(restore - t0, 120000)),
                                       coalesce(last_end - t0, -1000000000)), 720000)
                        - greatest(restore - t0, 120000), 0) AS live_ms
             FROM per, start WHERE restore IS NOT NULL),
    marks AS (SELECT container, kind, ts_ms, row_number() OVER (PARTITION BY container, kind ORDER BY line_no) AS i
              FROM log WHERE kind IN ('restore', 'enter', 'shutting', 'shutdown')),
    pairs AS (SELECT r.container, CAST(0 AS BIGINT) AS number, r.ts_ms AS ll, coalesce(e.ts_ms, 0) AS rr
              FROM (SELECT * FROM marks WHERE kind = 'restore' AND i = 1) r
              LEFT JOIN (SELECT * FROM marks WHERE kind = 'enter' AND i = 1) e USING (container)
              UNION ALL
              SELECT s.container, s.i, g.ts_ms, coalesce(e.ts_ms, s.ts_ms)
              FROM (SELECT * FROM marks WHERE kind = 'shutdown') s
              JOIN (SELECT * FROM marks WHERE kind = 'shutting') g ON g.container = s.container AND g.i = s.i
              LEFT JOIN (SELECT * FROM marks WHERE kind = 'enter') e ON e.container = s.container AND e.i = s.i + 1
              WHERE s.container IN (SELECT container FROM marks WHERE kind = 'restore')),
    spans AS (SELECT container, number, greatest(ll - t0, 120000) AS left_ms, least(rr - t0, 720000) AS right_ms
              FROM pairs, start),
    used AS (SELECT *, right_ms - left_ms AS span_ms FROM spans WHERE NOT (right_ms <= 120000 OR left_ms >= 720000)),
    moved AS (SELECT count(*) AS migrations, CAST(coalesce(sum(span_ms), 0) AS BIGINT) AS total_ms, min(span_ms) AS min_ms,
                max(span_ms) AS max_ms, (SELECT CAST(sum(live_ms) AS BIGINT) FROM life) AS live_ms FROM used)
"""


@query(
    "g20_migration_spans",
    f"WITH {EXECUTOR_LOG}, {_SLOTS}, {_LIFE} SELECT container, number, left_ms, right_ms, span_ms FROM used",
)
def _(spark, d):
    return slo.migration_spans(_compact(spark, d))


@query(
    "g20_migration_time",
    f"WITH {EXECUTOR_LOG}, {_SLOTS}, {_LIFE} SELECT *, total_ms / live_ms AS ratio FROM moved",
)
def _(spark, d):
    log = _compact(spark, d)
    return slo.migration_time(slo.migration_spans(log), slo.executor_lifetimes(log))


@query(
    "g20_longest_restart",
    f"""WITH {EXECUTOR_LOG}, {_SLOTS}, {_LIFE},
        gaps AS (SELECT s.container, e.ts_ms - s.ts_ms AS longest_ms FROM marks s JOIN marks e
                 ON s.container = e.container AND s.kind = 'shutdown' AND e.kind = 'enter' AND e.i = s.i + 1)
        SELECT container, longest_ms FROM gaps ORDER BY longest_ms DESC, container LIMIT 1""",
)
def _(spark, d):
    return slo.longest_restart(_compact(spark, d))


@query(
    "s8_read_log_files",
    f"""WITH {EXECUTOR_LOG}, {_SLOTS}, {_LIFE}
        SELECT host, CAST(sum(live_ms) AS BIGINT) AS live_ms FROM life WHERE host IS NOT NULL GROUP BY 1""",
)
def _(spark, d):
    # One log file per executor, lines in order, written and read as text.
    path = shared_path(spark, "logs")
    written = lines(spark, d, "executor_lines").select("container", "line_no", "value")
    placed = written.repartition("container").sortWithinPartitions("container", "line_no")
    placed.select("container", "value").write.partitionBy("container").text(path)
    read = logs.read_log_lines(spark, path, r"container=([^/]+)/[^/]+$")
    return slo.host_live_time(slo.executor_lifetimes(slo.compact_log(logs.parse_executor_log(read))))


@query(
    "g21_host_live_time",
    f"""WITH {EXECUTOR_LOG}, {_SLOTS}, {_LIFE}
        SELECT host, CAST(sum(live_ms) AS BIGINT) AS live_ms FROM life WHERE host IS NOT NULL GROUP BY 1""",
)
def _(spark, d):
    return slo.host_live_time(slo.executor_lifetimes(_compact(spark, d)))


@query(
    "g25_violation_histogram",
    f"""WITH {EXECUTOR_LOG}, {_SLOTS},
        s AS (SELECT violations * 100 // 601 AS share FROM rates)
        SELECT CAST(CASE WHEN share < 20 THEN share ELSE least(share // 5 * 5, 95) END AS INT) AS percent_from,
               count(*) AS substreams FROM s GROUP BY 1""",
)
def _(spark, d):
    return slo.violation_histogram(slo.slo_success_rate(_latency(spark, d)))


@query(
    "w8_violation_intervals",
    f"""WITH {EXECUTOR_LOG}, {_SLOTS},
        b AS (SELECT substream, slot, slot - row_number() OVER (PARTITION BY substream ORDER BY slot) AS run
              FROM lat WHERE avg_latency > 1000 AND slot BETWEEN 120 AND 720)
        SELECT substream, min(slot) AS start_slot, max(slot) AS end_slot FROM b GROUP BY substream, run""",
)
def _(spark, d):
    return slo.violation_intervals(_latency(spark, d))


@query(
    "m11_slo_report",
    f"""WITH {EXECUTOR_LOG}, {_SLOTS}, {_PEAK}, {_LIFE},
        total AS (SELECT CAST(sum(violations) AS DOUBLE) AS violations, CAST(count(*) * 601 AS DOUBLE) AS slots,
                    1 - sum(violations) / (count(*) * 601) AS success_rate FROM rates)
        SELECT 'overall' AS section, unnest(['violations', 'slots', 'success_rate']) AS item,
               unnest([violations, slots, success_rate]) AS value FROM total
        UNION ALL
        SELECT 'peak', unnest(['violations', 'peak_0_violations', 'peak_1_violations', 'off_peak_success_rate']),
               unnest([CAST(violations AS DOUBLE), peak_0_violations, peak_1_violations, off_peak_success_rate]) FROM peak
        UNION ALL
        SELECT 'migration', unnest(['migrations', 'total_ms', 'min_ms', 'max_ms', 'live_ms', 'ratio']),
               unnest([CAST(migrations AS DOUBLE), total_ms, min_ms, max_ms, live_ms, total_ms / live_ms]) FROM moved
        UNION ALL SELECT 'substream', CAST(substream AS STRING), 1 - violations / 601 FROM rates
        UNION ALL SELECT 'host', host, CAST(sum(live_ms) AS DOUBLE) FROM life WHERE host IS NOT NULL GROUP BY host""",
)
def _(spark, d):
    return slo.slo_report(_log(spark, d), peaks=_PEAK_SLOTS)


# --- scaling report --------------------------------------------------------------------------


def _model(spark, d):
    return logs.parse_controller_log(lines(spark, d, "controller_lines"))


def _migrations(spark, d):
    return logs.parse_migration_log(lines(spark, d, "migration_lines"))


@query(
    "g22_total_arrival_rate",
    f"""WITH {CONTROLLER_LOG} SELECT time, CAST(sum(value) AS DOUBLE) AS total_rate FROM model
        WHERE metric = 'arrival_rate' GROUP BY 1""",
)
def _(spark, d):
    return scaling.total_arrival_rate(_model(spark, d))


@query(
    "g23_worst_delay",
    f"""WITH {CONTROLLER_LOG} SELECT time, CAST(max(value) AS DOUBLE) AS worst_delay FROM model
        WHERE metric = 'window_delay' GROUP BY 1""",
)
def _(spark, d):
    return scaling.worst_delay(_model(spark, d))


_LOW, _HIGH, _LAST, _INITIAL = 20_000.0, 600_000.0, 550_000.0, 10


@query(
    "g24_decision_counts",
    f"""WITH {MIGRATION_LOG} SELECT action, count(*) AS count FROM migrations
        WHERE kind = 'decision' AND time BETWEEN {_LOW} AND {_HIGH} GROUP BY 1""",
)
def _(spark, d):
    return scaling.decision_counts(_migrations(spark, d), _LOW, _HIGH)


_STEPS = f"""
    steps AS (SELECT line_no, time, CASE action WHEN 'in' THEN -1 ELSE 1 END AS change FROM migrations
              WHERE kind = 'deployment' AND action IN ('in', 'out')),
    counted AS (SELECT *, {_INITIAL} + sum(change) OVER (ORDER BY line_no) AS after FROM steps)
"""


@query(
    "w9_executor_count_steps",
    f"""WITH {MIGRATION_LOG}, {_STEPS}
        SELECT line_no, time, CAST(after - change AS BIGINT) AS executors_before, CAST(after AS BIGINT) AS executors_after
        FROM counted""",
)
def _(spark, d):
    return scaling.executor_count_steps(_migrations(spark, d), _INITIAL)


_AVG = f"""
    pieces AS (SELECT time AS t, after FROM counted UNION ALL SELECT 0, {_INITIAL}),
    ordered AS (SELECT t, after, lead(t, 1, 1e18) OVER (ORDER BY t) AS t_next FROM pieces),
    mean AS (SELECT sum(after * greatest(least(t_next, {min(_HIGH, _LAST)}) - greatest(t, {_LOW}), 0)) / ({_HIGH} - {_LOW}) AS v
             FROM ordered)
"""


@query(
    "w10_avg_executors",
    f"WITH {MIGRATION_LOG}, {_STEPS}, {_AVG} SELECT round(v, 6) AS avg_executors FROM mean",
)
def _(spark, d):
    out = scaling.avg_executors(_migrations(spark, d), _INITIAL, _LOW, _HIGH, _LAST)
    return out.withColumn("avg_executors", F.round("avg_executors", 6))


@query(
    "m12_scaling_report",
    f"""WITH RECURSIVE {CONTROLLER_LOG}, {MIGRATION_LOG}, {_STEPS}, {_AVG},
        rate AS (SELECT sum(value) AS r FROM model WHERE metric = 'arrival_rate' GROUP BY time)
        SELECT 'avg_executors' AS item, round(v, 6) AS value FROM mean
        UNION ALL SELECT concat('decisions_', action), CAST(count(*) AS DOUBLE) FROM migrations
                  WHERE kind = 'decision' AND time BETWEEN {_LOW} AND {_HIGH} GROUP BY action
        UNION ALL SELECT 'peak_arrival_rate', max(r) FROM rate
        UNION ALL SELECT 'worst_delay', max(value) FROM model WHERE metric = 'window_delay'
        UNION ALL SELECT 'max_severe', CAST(max(severe) AS DOUBLE) FROM migrations""",
)
def _(spark, d):
    migrations = logs.parse_migration_log(lines(spark, d, "migration_lines"), severe_time=False)
    report = scaling.scaling_report(_model(spark, d), migrations, _INITIAL, _LOW, _HIGH, _LAST)
    return report.withColumn("value", F.round("value", 6))
