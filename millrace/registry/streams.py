"""Stream forms of registered operators: given tables are read as streams, drained and kept as tables.

Each query is held against the SQL of its table form, so a stream and a table must agree row by row.
"""

from __future__ import annotations

import time

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.bounded import plan_bytes
from millrace.operators.folds import fold_groups, fold_windows
from millrace.plans import markov
from millrace.registry.core import query
from millrace.registry.sources import _COUNTS, trained
from millrace.registry.stateful import _PENALTIES, _book_steps, _local_score, _PER_ORDER, _sessions, _tumbling
from millrace.registry import user_folds
from millrace.registry.views import BASE_TABLES, VIEWS, references, table, view
from millrace.session import shared_path
from millrace.streaming import stateful as S
from millrace.streaming.monitor import ThroughputListener, observed, stage_throughput
from millrace.streaming.windows import session_count, tumbling_count

HOURS_6 = 6 * 3600.0
#: Bytes of input for which a stream has a task with a store of its own, up to so many tasks.
STORE_BYTES, MOST_STORES = 1 << 18, 200


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or derived view as a stream."""
    if name in BASE_TABLES:
        # As a pattern, so that a table may be one file as well as a folder of files.
        schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
        return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")
    sql = VIEWS[name]
    return spark.sql(sql, **{r: stream(spark, sf_dir, r) for r in references(sql)})


def size_of(spark: SparkSession, sf_dir: str, *names: str) -> int:
    """Bytes of base tables or derived views, as the optimiser estimates them from their files; nothing is run."""
    return sum(plan_bytes(view(spark, sf_dir, name)) for name in names)


def stores(spark: SparkSession, size: int) -> int:
    """Tasks of a stream over ``size`` bytes, each with a store of its own.

    All rows of a key meet in one task, so a few dozen keys need many more tasks than keys, or some tasks get
    several of them. A small input has no more tasks than run at once.
    """
    few = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(2, spark.sparkContext.defaultParallelism))
    return max(few, min(MOST_STORES, -(-size // STORE_BYTES)))


def drained(df: DataFrame, size: int, complete: bool = False) -> DataFrame:
    """Run a stream over all that is there, ``size`` bytes, into a table of the shared folder, and read that table.

    ``complete`` keeps the last full result of an aggregate; otherwise rows are appended.
    """
    spark = df.sparkSession
    base = shared_path(spark, "stream")
    table = f"{base}/table"
    writer = df.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    if complete:
        kept = writer.outputMode("complete").foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(table))
    else:
        kept = writer.outputMode("append").format("parquet").option("path", table)
    _run(spark, kept, size)
    return spark.read.schema(df.schema).parquet(table)


def _run(spark: SparkSession, writer, size: int) -> StreamingQuery:
    """Start a stream over ``size`` bytes in all and wait for its end."""
    # State has one store for each shuffle partition; the number is fixed when a stream first starts.
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(stores(spark, size)))
    try:
        run = writer.start()
        run.awaitTermination()
    finally:
        spark.conf.set(name, before)
    return run


@query("t1_stream_tumbling_count", _tumbling("{bids_ev}", "auction", 60))
def _(spark, d):
    return drained(tumbling_count(stream(spark, d, "bids_ev"), "auction"), size_of(spark, d, "bids_ev"), complete=True)


@query("t5_stream_session_count", _sessions("{bids_ev}", "bidder", 21600))
def _(spark, d):
    return drained(session_count(stream(spark, d, "bids_ev"), "bidder", HOURS_6), size_of(spark, d, "bids_ev"), complete=True)


@query(
    "j0b_stream_latest_join",
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
    pairs = S.latest_join_stream(
        stream(spark, d, "page_views"), stream(spark, d, "ad_clicks"), "page_id", 3 * 3600.0, tie="event_id"
    )
    return drained(pairs, size_of(spark, d, "page_views", "ad_clicks")).select(
        "page_id",
        F.get_json_object("left", "$.event_id").cast("bigint").alias("view_id"),
        F.get_json_object("right", "$.event_id").cast("bigint").alias("click_id"),
        "arrived_side",
    )


@query(
    "w1_stream_running_sum",
    """SELECT sec_code, trade_no, round(sum(trade_price) OVER w, 4) AS running_sum, count(*) OVER w AS running_count
       FROM {stock_trades} WINDOW w AS (PARTITION BY sec_code ORDER BY ts, trade_no ROWS UNBOUNDED PRECEDING)""",
)
def _(spark, d):
    sums = S.running_sum_stream(stream(spark, d, "stock_trades"), "sec_code", "trade_price", ["ts", "trade_no"])
    return drained(sums, size_of(spark, d, "stock_trades")).select(
        "sec_code", "trade_no", F.round("running_sum", 4).alias("running_sum"), "running_count"
    )


# The book without sessions: it is kept over the whole run.
_WHOLE = """o AS (
    SELECT sec_code, 'all' AS session, order_no AS no, tran_maint_code AS code, trade_dir AS dir, order_price AS p,
           CAST(order_vol AS BIGINT) AS v, row_number() OVER (PARTITION BY sec_code ORDER BY ts, order_no) AS n
    FROM {stock_orders} WHERE tran_maint_code NOT IN ('X', ''))"""


@query(
    "m1_stream_match_orders_book",
    f"""WITH RECURSIVE {_WHOLE}, {_book_steps('(SELECT DISTINCT sec_code, session FROM o)')},
        r AS ({_PER_ORDER}) SELECT sec_code, order_no, volume, price, fills FROM r""",
)
def _(spark, d):
    return drained(S.match_orders_stream(stream(spark, d, "stock_orders")), size_of(spark, d, "stock_orders"))


def _penalties(spark, d) -> dict:
    """The penalties of the trained model: one number per pair of the five states."""
    rows = markov._penalties(trained(spark, d), "missProbability").collect()
    return {(r["from_state"], r["to_state"]): r["penalty"] for r in rows}


def _shown(scored: DataFrame) -> DataFrame:
    return scored.select("entity", "event_id", F.round("score", 6).alias("score"), "outlier")


@query("m5_stream_markov_score", _local_score("miss_probability"))
def _(spark, d):
    scored = S.markov_score_stream(stream(spark, d, "fraud_records"), _penalties(spark, d))
    return _shown(drained(scored, size_of(spark, d, "fraud_records")))


@query(
    "m6_stream_markov_score_global",
    f"""WITH {_COUNTS}, {_PENALTIES},
        w AS (SELECT entity, event_id, coalesce(sum(miss_probability) OVER x / nullif(count(before) OVER x, 0), 0.0) AS score
              FROM priced WINDOW x AS (PARTITION BY entity ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
        SELECT entity, event_id, round(score, 6) AS score, score > 0.96 AS outlier FROM w""",
)
def _(spark, d):
    scored = S.markov_score_stream(stream(spark, d, "fraud_records"), _penalties(spark, d), whole=True)
    return _shown(drained(scored, size_of(spark, d, "fraud_records")))


@query("t8_stream_upsert_store", "SELECT DISTINCT line AS message FROM {word_lines}")
def _(spark, d):
    return drained(S.upsert_store(stream(spark, d, "word_lines"), "line"), size_of(spark, d, "word_lines"))


@query(
    "f1_stream_user_fold",
    """SELECT entity, event_id, max(event_id) OVER w AS largest, count(*) OVER w AS seen FROM {fraud_records}
       WINDOW w AS (PARTITION BY entity ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""",
)
def _(spark, d):
    def step(key, batch, kept):
        largest, seen = kept if kept is not None else (-1, 0)
        tops = batch["event_id"].cummax().clip(lower=largest)
        out = batch[["entity", "event_id"]].assign(largest=tops, seen=range(seen + 1, seen + len(batch) + 1))
        return out, (int(tops.iloc[-1]), seen + len(batch))

    folded = S.fold_stream(
        stream(spark, d, "fraud_records").select("entity", "event_id", "ts"), ["entity"], step,
        "largest bigint, seen bigint", "entity string, event_id bigint, largest bigint, seen bigint", ["ts", "event_id"],
    )
    return drained(folded, size_of(spark, d, "fraud_records"))


# A watermark runs along and every key's rows leave the store once they can meet no other.
@query(
    "t7_stream_expiring_join",
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
    pairs = S.latest_join_stream(
        stream(spark, d, "page_views"), stream(spark, d, "ad_clicks"), "page_id", 3 * 3600.0, tie="event_id", late="1 hour"
    )
    return drained(pairs, size_of(spark, d, "page_views", "ad_clicks")).select(
        "page_id",
        F.get_json_object("left", "$.event_id").cast("bigint").alias("view_id"),
        F.get_json_object("right", "$.event_id").cast("bigint").alias("click_id"),
        "arrived_side",
    )


# --- user folds ------------------------------------------------------------------------------


@query("f3_user_average", "SELECT event_type, round(avg(value), 6) AS average, count(value) AS n FROM events GROUP BY 1")
def _(spark, d):
    found = fold_groups(table(spark, d, "events"), ["event_type"], ["value"], user_folds.AVERAGE, "average double, n bigint")
    return found.withColumn("average", F.round("average", 6))


@query(
    "f3_longest_word",
    """WITH w AS (SELECT lang, unnest(string_split(text, ' ')) AS word FROM documents)
       SELECT lang, min(word) AS word, CAST(length(word) AS INT) AS letters
       FROM (SELECT * FROM w WHERE word IS NOT NULL QUALIFY length(word) = max(length(word)) OVER (PARTITION BY lang))
       GROUP BY lang, length(word)""",
)
def _(spark, d):
    words = table(spark, d, "documents").select("lang", F.explode(F.split("text", " ")).alias("word"))
    return fold_groups(words, ["lang"], ["word"], user_folds.LONGEST_WORD, "word string, letters int")


@query("f3_distinct_users", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def _(spark, d):
    return fold_groups(table(spark, d, "events"), ["event_type"], ["user_id"], user_folds.DISTINCT, "users bigint")


_PANES = """SELECT event_type, date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end,
                   round(avg(value), 6) AS average, count(value) AS n FROM {ev} GROUP BY 1, 2, 3"""
DAY = 86_400.0


@query("f4_window_fold", _PANES)
def _(spark, d):
    found = fold_windows(view(spark, d, "ev"), ["event_type"], DAY, ["value"], user_folds.AVERAGE, "average double, n bigint")
    return found.withColumn("average", F.round("average", 6))


@query("f4_stream_window_fold", f"SELECT * FROM ({_PANES}) WHERE window_end <= (SELECT max(ts) - INTERVAL 1 HOUR FROM {{ev}})")
def _(spark, d):
    rows = stream(spark, d, "ev").withWatermark("ts", "1 hour")
    found = S.fold_windows_stream(rows, ["event_type"], DAY, ["value"], user_folds.AVERAGE, "average double, n bigint")
    return drained(found, size_of(spark, d, "ev")).withColumn("average", F.round("average", 6))


# --- runs in several pieces ------------------------------------------------------------------

PIECES = 4
#: The piece an event arrives in: its quarter of the ids; one in 97 comes a piece later.
_PIECE = "CAST(least(event_id * 4 // (SELECT max(event_id) + 1 FROM events) + CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END, 3) AS INT)"


def in_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The events with the piece they arrive in."""
    events = view(spark, d, "ev")
    last = events.agg(F.max("event_id") + 1).scalar()
    quarter = F.floor(F.col("event_id") * PIECES / last) + F.when(F.col("event_id") % 97 == 0, 1).otherwise(0)
    return events.withColumn("piece", F.least(quarter, F.lit(PIECES - 1)).cast("int"))


def run_in_pieces(spark: SparkSession, d: str, operator, named: str | None = None) -> tuple[str, list]:
    """Let the pieces arrive one after the other; each is one run, which goes on from the checkpoint of the last.

    Returns the folder of the output and the progress of every micro-batch.
    """
    base = shared_path(spark, "pieces")
    source, out = f"{base}/source", f"{base}/out"
    arriving, progress = in_pieces(spark, d), []
    size = plan_bytes(arriving)
    for piece in range(PIECES):
        arriving.where(F.col("piece") == piece).write.mode("append").parquet(source)
        rows = spark.readStream.schema(arriving.schema).parquet(source)
        writer = operator(rows).writeStream.option("checkpointLocation", f"{base}/checkpoint")
        writer = writer.outputMode("append").format("parquet").option("path", out).trigger(availableNow=True)
        progress += [(piece, p) for p in _run(spark, writer, size).recentProgress]
    return out, progress


@query(
    "t9_late_rows",
    f"""WITH a AS (SELECT event_type, ts, value, {_PIECE} AS piece FROM {{ev}}),
             m AS (SELECT piece, max(max(ts)) OVER (ORDER BY piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                          - INTERVAL 1 HOUR AS mark FROM a GROUP BY piece),
             j AS (SELECT a.*, coalesce(ts <= mark, false) AS late FROM a JOIN m USING (piece))
        SELECT 'kept' AS kind, event_type, date_trunc('day', ts) AS window_start, count(*) AS n FROM j
        WHERE NOT late AND date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM a) GROUP BY ALL
        UNION ALL SELECT 'late', NULL, NULL, count(*) FROM j WHERE late""",
)
def _(spark, d):
    def folded(rows):
        panes = S.fold_windows_stream(
            rows.withWatermark("ts", "1 hour"), ["event_type"], DAY, ["event_id"], user_folds.COUNT, "n bigint"
        )
        return panes.select("event_type", "window_start", "n")

    out, progress = run_in_pieces(spark, d, folded)
    late = sum(s.numRowsDroppedByWatermark for _, p in progress for s in p.stateOperators)
    kept = spark.read.schema("event_type string, window_start timestamp, n bigint").parquet(out)
    dropped = spark.range(1).select(
        F.lit("late").alias("kind"), F.lit(None).cast("string").alias("event_type"),
        F.lit(None).cast("timestamp").alias("window_start"), F.lit(late).cast("bigint").alias("n"),
    )
    return kept.select(F.lit("kept").alias("kind"), "event_type", "window_start", "n").unionByName(dropped)


@query(
    "f8_counters",
    f"""SELECT {_PIECE} AS piece, count(*) AS rows, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS errors,
               max(event_id) AS largest FROM {{ev}} GROUP BY 1""",
)
def _(spark, d):
    def counted(rows):
        failed = F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0))
        return observed(rows, "events", errors=failed, largest=F.max("event_id")).select("event_id")

    _, progress = run_in_pieces(spark, d, counted)
    seen = [(piece, p.observedMetrics["events"]) for piece, p in progress if p.numInputRows]
    rows = [(piece, m["rows"], m["errors"], m["largest"]) for piece, m in seen]
    return spark.createDataFrame(rows, "piece int, rows bigint, errors bigint, largest bigint")


# What a listener writes down of every stage and micro-batch of the four runs.
@query(
    "s15_stage_throughput",
    f"""WITH a AS (SELECT {_PIECE} AS batch FROM {{ev}})
        SELECT CAST(batch AS BIGINT) AS batch, stage, count(*) AS rows FROM a, (VALUES ('input'), ('events')) t(stage) GROUP BY ALL""",
)
def _(spark, d):
    path = shared_path(spark, "throughput")
    listener = ThroughputListener(spark, path)
    spark.streams.addListener(listener)
    try:
        run_in_pieces(spark, d, lambda rows: observed(rows, "events").select("event_id"))
        # Progress reaches a listener a little after the run has ended.
        for _ in range(300):
            if listener.records and stage_throughput(spark, path).where("stage = 'events' AND rows > 0").count() >= PIECES:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    return stage_throughput(spark, path).where("rows > 0").select("batch", "stage", "rows")


# A run that fails in its third micro-batch, after that batch was written, and goes on from the checkpoint: each
# message is stored once per line and reported once.
@query("s14_resumed_run", "SELECT line AS message, count(*) AS puts, CAST(1 AS BIGINT) AS reported FROM {word_lines} GROUP BY 1")
def _(spark, d):
    base = shared_path(spark, "resumed")
    source, out, checkpoint = f"{base}/source", f"{base}/out", f"{base}/checkpoint"
    messages = view(spark, d, "word_lines").select("line")
    messages.repartition(8).write.parquet(source)

    def run(stops: bool) -> None:
        def keep(rows, batch):
            rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")
            if stops and batch == 2:
                raise RuntimeError("stopped half-way")

        rows = spark.readStream.schema(messages.schema).option("maxFilesPerTrigger", 2).parquet(source)
        writer = S.upsert_store(rows, "line").writeStream.foreachBatch(keep)
        writer = writer.option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
        _run(spark, writer, plan_bytes(messages))

    try:
        run(stops=True)
    except StreamingQueryException as failed:
        if "stopped half-way" not in str(failed):
            raise
    run(stops=False)
    stored = S.read_store(spark, checkpoint).select("value.message", "value.puts")
    reported = spark.read.schema("message string").parquet(out).groupBy("message").agg(F.count(F.lit(1)).alias("reported"))
    return stored.join(reported, "message", "left")
