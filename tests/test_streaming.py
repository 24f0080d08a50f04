"""Streams give what the table form gives, survive a restart and drop late rows."""

import os
import time

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from millrace.operators import joins as J
from millrace.operators import matching as M
from millrace.operators.analytic import ewma, running_sum
from millrace.plans import markov, wiki
from millrace.registry.sources import STATES
from millrace.registry.views import view
from millrace.streaming import stateful as S
from millrace.streaming.monitor import ThroughputListener, checkpointed, observed, stage_throughput
from millrace.streaming.windows import session_count, tumbling_count


def closed(df, column, events, delay_seconds=1):
    """Windows that the last watermark has passed."""
    last = events.agg(F.max("ts")).collect()[0][0]
    limit = F.lit(last) - F.expr(f"INTERVAL {delay_seconds} SECONDS")
    return df.filter(F.col(column) <= limit)


def test_tumbling_stream_equals_table(spark, data, drain):
    bids = view(spark, data, "bids_ev")
    got = drain(bids, lambda s: tumbling_count(s, "auction", 86_400), watermark="1 second")
    want = closed(tumbling_count(bids, "auction", 86_400), "window_end", bids)
    assert rows_of(got) == rows_of(want) and got.count() > 500


def test_session_stream_equals_table(spark, data, drain):
    bids = view(spark, data, "bids_ev")
    got = drain(bids, lambda s: session_count(s, "bidder", 6 * 3600), watermark="1 second")
    want = closed(session_count(bids, "bidder", 6 * 3600), "session_end", bids)
    assert rows_of(got) == rows_of(want) and got.count() > 100


def test_wiki_stats_stream_equals_table(spark, data, drain):
    events = view(spark, data, "wiki_events")
    got = drain(events, lambda s: wiki.wiki_window_stats(wiki.parse_edits(s), 86_400), watermark="1 second")
    want = wiki.wiki_window_stats(wiki.parse_edits(events), 86_400)
    flat = lambda df: df.withColumn("counts", F.map_entries("counts").cast("string"))
    # A chained aggregate needs the watermark to pass one more step: the two newest windows are still open.
    newest = sorted(r["window_start"] for r in want.collect())[-2:]
    closed_ones = want.filter(~F.col("window_start").isin(newest))
    assert rows_of(flat(got.filter(~F.col("window_start").isin(newest)))) == rows_of(flat(closed_ones))
    assert set(rows_of(flat(got))) <= set(rows_of(flat(want)))


def test_interval_join_stream_equals_table(spark, data, drain):
    people = view(spark, data, "persons").withColumn("kind", F.lit("p"))
    offers = view(spark, data, "auctions").withColumn("kind", F.lit("a"))
    both = people.unionByName(offers, allowMissingColumns=True)

    def split(s):
        return J.q8_new_sellers(s.filter("kind = 'p'"), s.filter("kind = 'a'"), 6 * 3600)

    got = drain(both, split, watermark="1 second")
    want = J.q8_new_sellers(people, offers, 6 * 3600)
    assert rows_of(got) == rows_of(want) and want.count() > 0


def test_latest_join_stream_equals_table(spark, data, drain):
    views, clicks = view(spark, data, "page_views"), view(spark, data, "ad_clicks")
    both = views.withColumn("k", F.lit("v")).unionByName(clicks.withColumn("k", F.lit("c")), allowMissingColumns=True)

    def split(s):
        return S.latest_join_stream(
            s.filter("k = 'v'").select(*views.columns), s.filter("k = 'c'").select(*clicks.columns),
            "page_id", 3 * 3600.0, tie="event_id",
        )

    got = drain(both, split)
    ident = lambda c: F.get_json_object(c, "$.event_id").cast("bigint")
    table = J.latest_join(views, clicks, ["page_id"], 3 * 3600.0, tie="event_id")
    want = table.select("page_id", F.col("left.event_id").alias("l"), F.col("right.event_id").alias("r"), "arrived_side")
    assert rows_of(got.select("page_id", ident("left").alias("l"), ident("right").alias("r"), "arrived_side")) == rows_of(want)


def test_running_sum_stream_equals_table(spark, data, drain):
    rows = view(spark, data, "ev").select("user_id", "ts", "event_id", "value")
    got = drain(rows, lambda s: S.running_sum_stream(s, "user_id", "value", ["ts", "event_id"]))
    want = running_sum(rows, ["user_id"], ["ts", "event_id"], "value")
    pick = ["event_id", F.round("running_sum", 6).alias("s"), "running_count"]
    assert rows_of(got.select(*pick)) == rows_of(want.select(*pick))


def test_ewma_stream_equals_table(spark, data, drain):
    rows = view(spark, data, "ev").select("user_id", "ts", "event_id", "value")
    got = drain(rows, lambda s: S.ewma_stream(s, "user_id", "value", ["ts", "event_id"]))
    want = ewma(rows, ["user_id"], ["ts", "event_id"], "value")
    pick = ["event_id", F.round("ewma", 6).alias("e")]
    assert rows_of(got.select(*pick)) == rows_of(want.select(*pick))


@pytest.mark.parametrize("whole", [False, True])
def test_markov_stream_equals_table(spark, data, drain, whole):
    records = view(spark, data, "fraud_records")
    model = markov.train_markov(records, STATES, "entity", ["ts", "event_id"], "state")
    costs = {(r[0], r[1]): r[2] for r in markov._penalties(model, "missProbability").collect()}
    table = markov.markov_score_global if whole else markov.markov_score
    want = table(records, model).select("event_id", F.round("score", 6).alias("s"), "outlier")
    got = drain(records, lambda s: S.markov_score_stream(s, costs, whole=whole))
    assert rows_of(got.select("event_id", F.round("score", 6).alias("s"), "outlier")) == rows_of(want)


def test_book_stream_equals_table(spark, data, drain):
    orders = view(spark, data, "stock_orders")
    got = drain(orders, S.match_orders_stream, order=["ts", "order_no"])
    assert rows_of(got) == rows_of(M.match_orders_book(orders)) and got.count() > 100


def test_single_slot_stream_equals_table(spark, data, drain):
    orders = view(spark, data, "stock_orders")
    got = drain(orders, S.match_single_stream, order=["ts", "order_no"])
    assert rows_of(got) == rows_of(M.match_orders_single(orders)) and got.count() > 100


def test_upsert_store_and_read_back(spark, data, drain, tmp_path):
    lines = view(spark, data, "word_lines")
    checkpoint = str(tmp_path / "upsert")
    got = drain(lines, lambda s: S.upsert_store(s, "line"), checkpoint=checkpoint)
    want = S.upsert_store(lines, "line")
    assert rows_of(got) == rows_of(want, "message")
    stored = S.read_store(spark, checkpoint).select("value.message", "value.puts")
    assert rows_of(stored) == rows_of(want)


def test_restart_from_checkpoint(spark, data, tmp_path, drain):
    """The second half arrives after a stop; the state of the first half is still there."""
    orders = view(spark, data, "stock_orders").orderBy("ts", "order_no")
    numbered = orders.withColumn("n", F.unix_micros("ts"))
    half = numbered.approxQuantile("n", [0.5], 0.0)[0]
    source, checkpoint = str(tmp_path / "src"), str(tmp_path / "chk")
    for part in (numbered.filter(F.col("n") <= half), numbered.filter(F.col("n") > half)):
        part.drop("n").coalesce(1).write.mode("append").parquet(source)
        got = drain(None, S.match_orders_stream, source=source, checkpoint=checkpoint)
    assert rows_of(got) == rows_of(M.match_orders_book(orders))


def test_late_rows_are_dropped(spark, drain, tmp_path):
    source, checkpoint = str(tmp_path / "late"), str(tmp_path / "late-chk")
    batches = (["2024-01-01 00:00:10", "2024-01-01 00:05:00"], ["2024-01-01 00:00:20"], ["2024-01-01 00:09:00"])
    for times in batches:
        rows = spark.createDataFrame([(t, "k") for t in times], "t string, key string")
        rows.select(F.col("t").cast("timestamp").alias("ts"), "key").coalesce(1).write.mode("append").parquet(source)
        got = drain(
            None, lambda s: tumbling_count(s, "key", 60), source=source, checkpoint=checkpoint, watermark="1 minute"
        )
    first = got.filter(F.col("window_start") == F.lit("2024-01-01 00:00:00").cast("timestamp"))
    assert [r["count"] for r in first.collect()] == [1]


def test_stage_throughput(spark, data, tmp_path):
    table = str(tmp_path / "throughput")
    listener = ThroughputListener(spark, table)
    spark.streams.addListener(listener)
    try:
        view(spark, data, "word_lines").coalesce(1).write.parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("event_id bigint, line string, ts timestamp").parquet(str(tmp_path / "in"))
        seen = observed(stream, "lines", longest=F.max(F.length("line")))
        query = checkpointed(seen, str(tmp_path / "chk"), sink="parquet", path=str(tmp_path / "out"))
        query.awaitTermination(120)
        for _ in range(100):
            if os.path.exists(table) and stage_throughput(spark, table).where("stage = 'lines'").count():
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    stages = {r["stage"]: r["rows"] for r in stage_throughput(spark, table).where("rows > 0").collect()}
    assert stages["input"] == 1000 and stages["lines"] == 1000


def _arrive(spark, source, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)


def test_state_of_a_silent_key_goes_when_the_watermark_has_passed_it(spark, drain, tmp_path):
    source, checkpoint = str(tmp_path / "pairs"), str(tmp_path / "pairs-chk")
    schema = "k string, side string, id string, t bigint"

    def join(s):
        s = s.withColumn("ts", F.timestamp_seconds(F.col("t") + 10_000))
        return S.latest_join_stream(
            s.filter("side = 'l'").select("k", "id", "ts"), s.filter("side = 'r'").select("k", "id", "ts"), "k", 60.0, late="10 seconds"
        )

    def held():
        parts = [S.read_store(spark, checkpoint, name) for name in ("left_side", "right_side")]
        return sorted(r[0] for p in parts for r in p.select("key.k").collect())

    batches = [[("a", "l", "1", 0), ("a", "r", "2", 30), ("b", "l", "3", 40)], [("c", "r", "4", 500)], [("d", "l", "5", 2000)]]
    states = []
    for rows in batches:
        _arrive(spark, source, rows, schema)
        got = drain(None, join, source=source, checkpoint=checkpoint)
        states.append(held())
    # The last row's own watermark is ten seconds behind it: nothing of the keys that fell silent is left.
    assert states == [["a", "a", "b"], ["c"], ["d"]]
    assert rows_of(got.select("k", "arrived_side")) == [("a", 1)]


def test_a_small_batch_rewrites_only_the_levels_it_trades_with():
    from millrace.operators.matching import Book

    class Handle(dict):
        """What the state store keeps, with its reads and writes counted."""

        def __init__(self):
            self.reads, self.writes = [], []

        def getValue(self, key):
            self.reads.append(key)
            return self[key]

        def updateValue(self, key, value):
            self.writes.append(key)
            self[key] = value

        def removeKey(self, key):
            self.writes.append(key)
            del self[key]

    class Value:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, value):
            self.held = value

        def clear(self):
            self.held = None

    import random

    import pandas as pd

    rng = random.Random(1)
    names = ["tran_maint_code", "trade_dir", "order_price", "order_no", "order_vol", "ts"]

    def orders(n, start):
        rows = []
        for i in range(start, start + n):
            side = rng.choice("BS")
            price = round(rng.uniform(1, 100) * 0.9 if side == "B" else 100 + rng.uniform(-12, 100), 2)
            rows.append(("A", side, price, f"o{i:06}", rng.randint(1, 9), i))
        return rows

    keeper, plain, levels = S.BookKeeper(), Book(), Handle()
    keeper.levels, keeper.prices = levels, Value()
    for size in (3000, 10, 10, 10, 500, 10):
        rows = orders(size, len(levels) * 7 + rng.randrange(10**6))
        levels.reads, levels.writes = [], []
        got = [tuple(r) for f in keeper.handleInputRows(("1",), iter([pd.DataFrame(rows, columns=names)]), None) for r in f.itertuples(index=False)]
        want = []
        for code, side, price, no, volume, _ in sorted(rows, key=lambda r: (r[5], r[3])):
            fills = plain.apply(code, side, price, no, volume)
            if fills:
                want.append(("1", no, sum(f[3] for f in fills), fills[-1][2], len(fills)))
        assert got == want
        if size == 10:
            assert len(levels.writes) <= 10 + sum(w[4] for w in want) and len(levels) > 1000
        assert {k: list(zip(*v)) for k, v in levels.items()} == {
            (d, p): [(i[0], v) for i, v in q.items()] for d, s in (("B", plain.buys), ("S", plain.sells)) for p, q in s.levels.items()
        }


def test_a_million_rows_of_one_key_are_sorted_in_pieces():
    import tracemalloc

    import numpy as np
    import pandas as pd

    n, rng = 1_000_000, np.random.default_rng(1)
    order = rng.permutation(n)

    def frames():
        for at in range(0, n, 10_000):
            part = order[at : at + 10_000]
            yield pd.DataFrame({"ts": part // 3, "id": part, "name": [f"row {i}" for i in part]})

    tracemalloc.start()
    seen, largest = -1, 0
    for piece in S.in_order(frames(), ["ts", "id"]):
        assert piece["id"].iloc[0] == seen + 1 and (np.diff(piece["id"]) == 1).all()
        seen, largest = int(piece["id"].iloc[-1]), max(largest, len(piece))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # Python's own objects are those of a piece; the columns lie in Arrow's memory, about 30 bytes a row.
    assert seen == n - 1 and largest <= S.PIECE_ROWS and peak < 60e6


def test_user_folds_merge_over_tasks_panes_and_batches(spark, drain, tmp_path):
    from millrace.operators import folds
    from millrace.registry import user_folds

    rows = [(None if i % 7 == 0 else f"k{i % 3}", float(i) if i % 5 else None, i * 40) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, v double, t bigint").withColumn("ts", F.timestamp_seconds("t")).repartition(5)
    got = {r["k"]: (r["average"], r["n"]) for r in folds.fold_groups(df, ["k"], ["v"], user_folds.AVERAGE, "average double, n bigint").collect()}
    for key in {r[0] for r in rows}:
        values = [r[1] for r in rows if r[0] == key and r[1] is not None]
        assert got[key] == (pytest.approx(sum(values) / len(values)), len(values))
    assert folds.fold_groups(df, [], ["v"], user_folds.DISTINCT, "n bigint").collect()[0]["n"] == len({r[1] for r in rows} - {None})
    assert folds.fold_groups(df.limit(0), ["k"], ["v"], user_folds.COUNT, "n bigint").count() == 0
    table = folds.fold_windows(df, ["k"], 3600, ["v"], user_folds.AVERAGE, "average double, n bigint")

    def panes(s):
        return S.fold_windows_stream(s.withWatermark("ts", "1 second"), ["k"], 3600, ["v"], user_folds.AVERAGE, "average double, n bigint")

    got = drain(df, panes)
    want = closed(table, "window_end", df)
    pick = ["k", "window_start", "window_end", F.round("average", 6).alias("a"), "n"]
    assert rows_of(got.select(*pick)) == rows_of(want.select(*pick)) and got.count() >= 12


def test_a_stored_queue_finds_its_first_order_at_once():
    from collections import OrderedDict

    from millrace.operators.matching import Book
    from millrace.streaming.stateful import BookKeeper

    class Levels:
        def getValue(self, at):
            return [str(i) for i in range(50)], [5] * 50

    keeper, book = BookKeeper(), Book()
    keeper.levels = Levels()
    keeper._open(book.sells, "S", [10.0])
    book.rest("S", 11.0, "last", 5)
    # A plain dict walks over all that has left its front.
    assert all(type(book.sells.levels[p]) is OrderedDict for p in (10.0, 11.0))
    assert [f[1] for f in book.apply("A", "B", 11.0, "b", 255)] == [*map(str, range(50)), "last"]


def test_a_large_stream_has_more_tasks_than_keys(spark, data, monkeypatch, tmp_path):
    from millrace import registry
    from millrace.registry import streams

    few = min(2, max(2, spark.sparkContext.defaultParallelism))
    assert streams.stores(spark, 0) == streams.stores(spark, streams.STORE_BYTES) == few
    assert streams.stores(spark, 50 * streams.STORE_BYTES) == 50
    assert streams.stores(spark, 10**12) == streams.MOST_STORES
    query = registry.queries()["w1_stream_running_sum"]
    want = rows_of(query(spark, data))
    size = streams.size_of(spark, data, "stock_trades")
    monkeypatch.setattr(streams, "STORE_BYTES", size // 15)
    monkeypatch.setattr(streams, "shared_path", lambda spark, purpose: str(tmp_path / purpose))
    assert rows_of(query(spark, data)) == want
    state = spark.read.format("state-metadata").load(str(tmp_path / "stream" / "checkpoint"))
    assert {r["numPartitions"] for r in state.collect()} <= {15, 16}
    assert spark.conf.get("spark.sql.shuffle.partitions") == "2"


def test_sorted_runs_of_a_key_leave_memory():
    import numpy as np
    import pandas as pd
    import pyarrow as pa

    n, rng = 800_000, np.random.default_rng(1)
    order, before, largest = rng.permutation(n), pa.total_allocated_bytes(), 0

    def seen():
        nonlocal largest
        largest = max(largest, pa.total_allocated_bytes() - before)

    def frames():
        for at in range(0, n, 10_000):
            part = order[at : at + 10_000]
            yield pd.DataFrame({"ts": part // 3, "id": part, "name": [f"row {i:70}" for i in part]})
            seen()

    last = -1
    for piece in S.in_order(frames(), ["ts", "id"]):
        seen()
        assert piece["id"].iloc[0] == last + 1 and (np.diff(piece["id"]) == 1).all() and len(piece) <= S.PIECE_ROWS
        assert piece["name"].iloc[0] == f"row {last + 1:70}"
        last = int(piece["id"].iloc[-1])
    # All rows are 76 MB.
    assert last == n - 1 and largest < 40e6


def test_ties_in_sorted_runs_keep_their_order(monkeypatch):
    import numpy as np
    import pandas as pd

    monkeypatch.setattr(S, "RUN_BYTES", 3000, raising=False)
    rng = np.random.default_rng(2)
    for n, order in ((0, ["ts"]), (5, ["ts"]), (900, ["ts", "name"]), (901, ["part"]), (902, ["name"])):
        rows = pd.DataFrame({"ts": pd.to_datetime(rng.integers(0, 20, n), unit="s"), "id": np.arange(n)})
        rows["name"] = [f"n{i % 7}" if i % 3 else None for i in range(n)]
        rows["part"] = np.where(rng.random(n) < 0.1, np.nan, rng.integers(0, 9, n))
        for piece in (1, 40, 10_000):
            got = list(S.in_order((rows.iloc[i : i + 7] for i in range(0, n, 7)), order, piece))
            assert n <= piece or max(map(len, got)) <= piece
            if n:
                want = rows.sort_values(order, kind="stable").reset_index(drop=True)
                pd.testing.assert_frame_equal(pd.concat(got, ignore_index=True), want)


class _Levels(dict):
    def getValue(self, key):
        return self[key]

    def updateValue(self, key, value):
        self[key] = value

    def removeKey(self, key):
        del self[key]


class _Prices:
    held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value

    def clear(self):
        self.held = None


_ORDER = ["tran_maint_code", "trade_dir", "order_price", "order_no", "order_vol", "ts"]


def test_a_deep_book_leaves_memory(monkeypatch):
    import random
    import tracemalloc

    import pandas as pd

    class Sizes(_Levels):
        def updateValue(self, key, value):
            self[key] = len(value[0])

    monkeypatch.setattr(S, "HELD_ROWS", 20_000, raising=False)
    n, rng = 150_000, random.Random(3)

    def frames():
        for at in range(0, n, 10_000):
            rows = []
            for i in range(at, at + 10_000):
                side = "BS"[i % 2]
                rows.append(("A", side, rng.randrange(500) / 10 + (100 if side == "S" else 0), f"order number {i:09}", 300 + i, i))
            yield pd.DataFrame(rows, columns=_ORDER)

    keeper, levels = S.BookKeeper(), Sizes()
    keeper.levels, keeper.prices = levels, _Prices()
    monkeypatch.setattr(S.in_order, "__defaults__", (10_000,))
    tracemalloc.start()
    assert list(keeper.handleInputRows(("1",), frames(), None)) == []
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # All held as queues they take 36 MB.
    assert sum(levels.values()) == n and len(levels) == 1000 and peak < 30e6


@pytest.mark.parametrize("held", [1, 20, 10**6])
def test_a_book_put_into_a_file_trades_like_one_in_memory(monkeypatch, held):
    import random

    import pandas as pd

    from millrace.operators.matching import Book

    monkeypatch.setattr(S, "HELD_ROWS", held, raising=False)
    monkeypatch.setattr(S.in_order, "__defaults__", (5,))
    for seed in range(40):
        rng = random.Random(seed)
        keeper, plain, levels = S.BookKeeper(), Book(), _Levels()
        keeper.levels, keeper.prices = levels, _Prices()
        spread, numbers, ts = rng.choice([3, 30]), rng.choice([10, 200]), 0
        for size in (rng.choice([3, 60, 200]) for _ in range(rng.choice([1, 4]))):
            rows = []
            for ts in range(ts + 1, ts + 1 + size):
                no = f"o{rng.randrange(numbers)}"
                rows.append((rng.choice("AAAD"), rng.choice("BSBSBSX"), float(rng.randint(1, spread)), no, rng.randint(0, 9), ts))
            want = []
            for code, side, price, no, volume, _ in rows:
                fills = plain.apply(code, side, price, no, volume)
                if fills:
                    want.append(("1", no, sum(f[3] for f in fills), fills[-1][2], len(fills)))
            rng.shuffle(rows)
            frames = (pd.DataFrame(rows[i : i + 7], columns=_ORDER) for i in range(0, size, 7))
            assert [tuple(r) for f in keeper.handleInputRows(("1",), frames, None) for r in f.itertuples(index=False)] == want
            sides = {"B": plain.buys, "S": plain.sells}
            assert {k: list(zip(*v)) for k, v in levels.items()} == {
                (d, p): [(i[0], v) for i, v in q.items()] for d, s in sides.items() for p, q in s.levels.items()
            }
            assert (keeper.prices.held or ([], [])) == tuple(sorted(s.levels) for s in sides.values())
            # Equal order numbers of a level are counted anew when it is read from the store.
            plain = Book()
            for d, s in sides.items():
                for price, no, volume in s.rows():
                    plain.rest(d, price, no, volume)
