"""Sources, sinks and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace import schemas
from millrace.functions.scalars import WHITESPACE
from millrace.registry.core import query
from millrace.registry.views import lines, table, view
from millrace.session import shared_path
from millrace.sources import kafka, logs, routing, text

# Five states in a fixed order.
STATES = ("signup", "error", "click", "view", "purchase")

@query(
    "s1_read_json",
    "SELECT auction, bidder, price, CAST(epoch_us(ts) // 1000 AS BIGINT) AS millis, 'x' AS extra FROM {bids_ev}",
)
def _(spark, d):
    bids = view(spark, d, "bids_ev").withColumn("dateTime", F.unix_millis("ts")).withColumn("extra", F.lit("x"))
    messages = kafka.encode_json(bids.select("auction", "bidder", "price", "dateTime", "extra"), "auction")
    rows = kafka.decode_json(messages.select(F.encode("value", "UTF-8").alias("value")), schemas.BID)
    return rows.select("auction", "bidder", "price", F.unix_millis("ts").alias("millis"), "extra")


@query("s2_read_kv", "SELECT CAST(event_id AS STRING) AS key, line AS value FROM {word_lines}")
def _(spark, d):
    lines = view(spark, d, "word_lines")
    raw = lines.select(
        F.encode(F.col("event_id").cast("string"), "UTF-8").alias("key"), F.encode("line", "UTF-8").alias("value")
    )
    return kafka.decode_kv(raw)


@query(
    "s3_parse_orders",
    """SELECT sec_code AS key, order_no, tran_maint_code, order_price, order_exec_vol, order_vol, sec_code, trade_dir,
              ts + INTERVAL '100' MILLISECOND AS ts FROM {stock_orders}""",
)
def _(spark, d):
    return text.parse_orders(lines(spark, d, "order_lines"))


@query(
    "s4_parse_trades",
    """SELECT sec_code AS key, trade_no, 'o' AS order_no, trade_price, 1.5 AS trade_amt, trade_vol, sec_code,
              concat('acct', sec_code) AS acct_id, trade_dir, ts FROM {stock_trades}""",
)
def _(spark, d):
    return text.parse_trades(lines(spark, d, "trade_lines"))


@query(
    "s5_opening_book",
    """SELECT sec_code, trade_dir, order_price, CAST(sum(order_vol) AS BIGINT) AS volume, count(*) AS orders
       FROM {stock_new} GROUP BY ALL""",
)
def _(spark, d):
    return text.book_levels(view(spark, d, "stock_new"))


@query(
    "s5_opening_book_files",
    """SELECT sec_code, trade_dir, order_no, tran_maint_code, order_price, order_vol, ts FROM {stock_new}""",
)
def _(spark, d):
    path = shared_path(spark, "opening-book")
    text.write_opening_book(view(spark, d, "stock_new"), path)
    return text.load_opening_book(spark, path)


_COUNTS = """
    seqs AS (SELECT entity, state AS to_state, lag(state) OVER (PARTITION BY entity ORDER BY ts, event_id) AS from_state
             FROM {fraud_records}),
    counted AS (SELECT from_state, to_state, count(*) AS c FROM seqs WHERE from_state IS NOT NULL GROUP BY ALL),
    states AS (SELECT * FROM (VALUES ('signup', 0), ('error', 1), ('click', 2), ('view', 3), ('purchase', 4)) t(s, i)),
    grid AS (SELECT f.s AS from_state, f.i AS from_no, t.s AS to_state, t.i AS to_no, coalesce(c, 0) AS c
             FROM states f CROSS JOIN states t
             LEFT JOIN counted k ON k.from_state = f.s AND k.to_state = t.s),
    smooth AS (SELECT *, c + CASE WHEN min(c) OVER (PARTITION BY from_no) = 0 THEN 1 ELSE 0 END AS n FROM grid),
    model AS (SELECT from_no, from_state, to_no, to_state, n / sum(n) OVER (PARTITION BY from_no) AS p FROM smooth)
"""


def trained(spark, d):
    from millrace.plans.markov import train_markov

    return train_markov(view(spark, d, "fraud_records"), STATES, "entity", ["ts", "event_id"], "state")


@query(
    "s6_load_markov_model",
    f"""WITH {_COUNTS}
        SELECT from_no, from_state, to_no, to_state, round(p, 9) AS p FROM model""",
)
def _(spark, d):
    from millrace.plans.markov import model_lines

    loaded = text.load_markov_model(model_lines(trained(spark, d), STATES))
    return loaded.withColumn("p", F.round("p", 9))


# A short word list, as a lexicon that fits a broadcast.
SHORT_LEXICON = (
    ("the", 1), ("and", 2), ("of", -1), ("la", -2), ("der", 3), ("que", -3), ("in", 1), ("et", -1), ("und", 2),
)
SHORT_LEXICON_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{w}', {n})" for w, n in SHORT_LEXICON) + ") t(word, score)"


def short_lexicon(spark):
    # Literals in the plan, so that the optimiser knows how small it is.
    rows = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(n).alias("score")) for w, n in SHORT_LEXICON])
    return spark.range(1).select(F.explode(rows).alias("r")).select("r.word", "r.score")


# A lexicon of every word of the texts: the last document that has it gives its score.
LEXICON_SQL = """
    SELECT word, CAST(max_by(n_chars % 11, doc_id) - 5 AS INT) AS score
    FROM (SELECT doc_id, n_chars, unnest(string_split(text, ' ')) AS word FROM documents)
    WHERE word <> '' AND NOT regexp_matches(word, '\\s') GROUP BY 1
"""


def lexicon(spark, d, every_line: bool = False):
    """The loaded lexicon; ``every_line`` keeps the repeated entries of its file, of which the last wins."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars", F.explode(F.split("text", " ")).alias("word"))
    usable = docs.filter(F.col("word") != "")
    if not every_line:
        usable = usable.groupBy("word").agg(F.max("doc_id").alias("doc_id"), F.max_by("n_chars", "doc_id").alias("n_chars"))
    # Words are parted by spaces; what other white space they hold is looked for without a regular expression.
    for other in WHITESPACE.replace(" ", ""):
        usable = usable.filter(~F.contains("word", F.lit(other)))
    word_and_score = F.concat(
        F.lit(" "), F.col("word"), F.lit(" \t "), (F.col("n_chars") % 11 - 5).cast("string"), F.lit("\r")
    )
    return text.load_lexicon(usable.select(F.col("doc_id").alias("line_no"), word_and_score.alias("value")))


@query(
    "s6_model_file",
    f"""WITH {_COUNTS} SELECT from_no, from_state, to_no, to_state, round(p, 9) AS p FROM model""",
)
def _(spark, d):
    from millrace.plans.markov import model_lines

    # The model goes through a text file: one line per state, so one small file.
    path = shared_path(spark, "model")
    model_lines(trained(spark, d), STATES).orderBy("line_no").select("value").coalesce(1).write.text(path)
    return text.load_markov_model(text.number_lines(spark, path)).withColumn("p", F.round("p", 9))


@query("s7_load_lexicon", LEXICON_SQL)
def _(spark, d):
    return lexicon(spark, d, every_line=True)


EXECUTOR_LOG = """
    words AS (SELECT container, line_no, string_split(value, ' ') AS w FROM {executor_lines}),
    log AS (SELECT container, line_no,
              CASE w[1] WHEN 'GT:' THEN 'gt' WHEN 'container' THEN 'host' WHEN 'Starting' THEN 'restore'
                        WHEN 'Entering' THEN 'enter' WHEN 'Shutdown' THEN 'shutdown' ELSE 'shutting' END AS kind,
              CASE w[1] WHEN 'GT:' THEN CAST(w[2] AS BIGINT) WHEN 'container' THEN NULL
                        WHEN 'Shutdown' THEN CAST(w[3] AS BIGINT) ELSE CAST(w[4] AS BIGINT) END AS ts_ms,
              CASE w[1] WHEN 'GT:' THEN CAST(w[4] AS INT) END AS substream,
              CASE w[1] WHEN 'GT:' THEN CAST(w[6] AS BIGINT) END AS n,
              CASE w[1] WHEN 'GT:' THEN CAST(w[8] AS BIGINT) END AS latency_ms,
              CASE w[1] WHEN 'container' THEN w[4] END AS host
            FROM words WHERE w[1] IN ('GT:', 'container', 'Starting', 'Entering', 'Shutdown', 'Shutting'))
"""


@query("s8_parse_executor_log", f"WITH {EXECUTOR_LOG} SELECT * FROM log")
def _(spark, d):
    return logs.parse_executor_log(lines(spark, d, "executor_lines"))


CONTROLLER_LOG = """
    raw AS (SELECT line_no, string_split(value, ' ') AS w, value FROM {controller_lines} WHERE value LIKE '%Model, time%'),
    typed AS (SELECT line_no, CAST(w[3] AS BIGINT) AS tick,
                CASE w[5] WHEN 'Arrival' THEN 'arrival_rate' WHEN 'Service' THEN 'service_rate'
                          WHEN 'Instantaneous' THEN 'window_delay' ELSE 'longterm_delay' END AS metric,
                unnest(string_split(replace(regexp_extract(value, chr(123) || '(.*)' || chr(125), 1), ' ', ''), ',')) AS e
              FROM raw),
    model AS (SELECT line_no, tick - (SELECT min_by(tick, line_no) FROM typed) AS time, metric,
                split_part(e, '=', 1) AS container,
                CASE WHEN metric IN ('arrival_rate', 'service_rate')
                     THEN 1000.0 * CASE split_part(e, '=', 2) WHEN 'NaN' THEN 0 ELSE CAST(split_part(e, '=', 2) AS DOUBLE) END
                     WHEN metric = 'longterm_delay'
                     THEN least(greatest(CAST(split_part(e, '=', 2) AS DOUBLE), 0.0), 1000000.0)
                     ELSE CAST(split_part(e, '=', 2) AS DOUBLE) END AS value
              FROM typed)
"""


@query(
    "s9_parse_controller_log",
    f"WITH {CONTROLLER_LOG} SELECT line_no, time, metric, container, CAST(value AS DOUBLE) AS value FROM model",
)
def _(spark, d):
    return logs.parse_controller_log(lines(spark, d, "controller_lines"))


MIGRATION_LOG = """
    seen AS (SELECT line_no, value, lag(value) OVER (ORDER BY line_no) AS above FROM {migration_lines}),
    migrations AS (
      SELECT line_no,
        CASE WHEN value LIKE 'Migration!%' THEN 'decision' WHEN value LIKE 'Executors%' THEN 'deployment'
             ELSE 'severe' END AS kind,
        CASE WHEN value LIKE 'Migration!%' THEN CAST(regexp_extract(value, 'time: ([0-9]+)', 1) AS BIGINT)
             WHEN value LIKE 'Executors%' THEN CAST(string_split(value, ' ')[5] AS BIGINT)
             ELSE TRY_CAST(string_split(above, ' ')[3] AS BIGINT) END AS time,
        CASE WHEN value LIKE '%Scale in%' OR value LIKE '%scale-in%' THEN 'in'
             WHEN value LIKE '%Scale out%' OR value LIKE '%scale-out%' THEN 'out'
             WHEN value LIKE 'Number%' THEN NULL ELSE 'balance' END AS action,
        nullif(regexp_extract(value, ' from (\\S+)', 1), '') AS source,
        nullif(regexp_extract(value, ' to (\\S+)', 1), '') AS target,
        CASE WHEN value LIKE 'Number%' THEN CAST(string_split(value, ' ')[5] AS BIGINT) END AS severe
      FROM seen WHERE value LIKE 'Migration!%' OR value LIKE 'Executors%' OR value LIKE 'Number%')
"""


@query("s10_parse_migration_log", f"WITH {MIGRATION_LOG} SELECT * FROM migrations")
def _(spark, d):
    return logs.parse_migration_log(lines(spark, d, "migration_lines"))


@query(
    "s11_write_json",
    """SELECT CAST(auction AS STRING) AS key,
              concat(chr(123), '"auction":', CAST(auction AS STRING), ',"bidder":', CAST(bidder AS STRING),
                     ',"price":', CAST(price AS STRING), chr(125)) AS value FROM {bids_li}""",
)
def _(spark, d):
    return kafka.encode_json(view(spark, d, "bids_li").select("auction", "bidder", "price"), "auction")


@query("s11_write_kv", "SELECT CAST(event_id AS STRING) AS key, line AS value FROM {word_lines}")
def _(spark, d):
    return kafka.encode_kv(view(spark, d, "word_lines"), "event_id", "line")


@query(
    "s12_write_keyed",
    """SELECT sec_code AS key,
              concat(chr(123), '"sec_code":"', sec_code, '","order_no":"', order_no, '","order_vol":',
                     CAST(order_vol AS STRING), chr(125)) AS value FROM {stock_new}""",
)
def _(spark, d):
    return kafka.write_keyed(view(spark, d, "stock_new").select("sec_code", "order_no", "order_vol"))


@query("s16_repartition_by_mod", "SELECT l_orderkey, CAST(l_orderkey % 16 AS INT) AS partition FROM lineitem")
def _(spark, d):
    placed = routing.repartition_by_mod(table(spark, d, "lineitem").select("l_orderkey"), "l_orderkey", 16)
    return placed.withColumn("partition", F.spark_partition_id())


@query(
    "s17_partition_first_seen",
    """WITH firsts AS (SELECT user_id, min(event_id) AS first_seen FROM events GROUP BY 1),
            ranked AS (SELECT *, row_number() OVER (ORDER BY first_seen) - 1 AS r FROM firsts)
       SELECT user_id, first_seen, CAST(CASE WHEN r >= 64 THEN user_id % 64 ELSE r END AS INT) AS partition FROM ranked""",
)
def _(spark, d):
    return routing.partition_first_seen(table(spark, d, "events"), "user_id", "event_id", 64)


@query("s18_repartition_round_robin", "SELECT event_id, user_id FROM events")
def _(spark, d):
    return routing.repartition_round_robin(table(spark, d, "events").select("event_id", "user_id"), 16)


@query(
    "s19_replay_repeat",
    "SELECT event_id, CAST(replay AS INT) AS replay FROM events, (SELECT unnest([1, 2, 3]) AS replay)",
)
def _(spark, d):
    return routing.replay_repeat(table(spark, d, "events").select("event_id"), 3)


@query(
    "s20_message_latency",
    "SELECT event_id, CAST(event_id % 977 AS BIGINT) AS latency_ms FROM {ev}",
)
def _(spark, d):
    sent = (F.unix_millis("ts") - F.col("event_id") % 977).cast("string")
    messages = view(spark, d, "ev").select(
        "event_id", F.col("ts").alias("received"), F.concat(sent, F.lit(",payload")).alias("value")
    )
    return routing.message_latency(messages).select("event_id", "latency_ms")
