"""Hand-computed values, invariants, and hot keys against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from millrace.functions import projections as P
from millrace.functions import scalars as X
from millrace.operators import aggregates as A
from millrace.operators import matching as M
from millrace.operators import ordered, stats
from millrace.operators.analytic import ewma, sliding_median
from millrace.operators.joins import interval_join, latest_join, nearest_centroid
from millrace.operators.medians import running_median, with_running_median
from millrace.operators.selection import select_kth
from millrace.plans import markov, text
from millrace.plans.wiki import count_drops, parse_edits, wiki_window_stats
from millrace.registry.views import view
from millrace.sources import kafka, routing
from millrace.sources import text as T
from millrace.streaming.windows import session_count

ORDER = "order_no string, tran_maint_code string, trade_dir string, order_price double, order_vol int, s int"


def orders(spark, rows):
    df = spark.createDataFrame(rows, ORDER)
    return df.withColumn("sec_code", F.lit("1")).withColumn("ts", F.timestamp_seconds("s"))


def test_order_book_by_hand(spark):
    book = orders(
        spark,
        [("a", "A", "B", 10.0, 5, 1), ("b", "A", "S", 10.5, 3, 2), ("c", "A", "S", 9.9, 2, 3),
         ("d", "A", "B", 10.6, 4, 4), ("a", "D", "B", 10.0, 5, 5)],
    )
    got = rows_of(M.match_orders_book(book), "order_no", "volume", "price", "fills")
    assert got == [("c", 2, 9.9, 1), ("d", 3, 10.5, 1)]
    assert rows_of(M.resting_orders(book), "trade_dir", "order_price", "order_vol") == [("B", 10.6, 1)]


def test_books_of_fifty_securities_are_spread_over_tasks(spark):
    orders = spark.range(400).select(
        (F.col("id") % 50).cast("string").alias("sec_code"), F.lit("A").alias("tran_maint_code"),
        F.when(F.col("id") % 100 < 50, "S").otherwise("B").alias("trade_dir"), F.lit(10.0).alias("order_price"),
        F.col("id").cast("string").alias("order_no"), F.lit(5).alias("order_vol"), F.timestamp_seconds("id").alias("ts"),
    )
    for df in (M.match_orders_book(orders), M.resting_orders(orders.where("trade_dir = 'S'"))):
        held = df.select("sec_code", F.spark_partition_id().alias("task")).distinct().groupBy("task").count().collect()
        assert sum(r["count"] for r in held) == 50 and max(r["count"] for r in held) <= 3


def test_values_cross_to_python_unchanged():
    import pyarrow as pa

    for kept in ([2**62 + 1, None], [2**62 + 1, 5], [0.5, None], ["a", None], [True, None], [], [float("inf"), -0.0]):
        column = pa.array(kept)
        assert ordered.python_values(column) == kept
        assert [type(v) for v in ordered.python_values(column)] == [type(v) for v in kept]


def test_single_slot_by_hand(spark):
    slots = orders(spark, [("s", "A", "S", 10.0, 5, 1), ("b", "A", "B", 11.0, 3, 2), ("c", "A", "B", 12.0, 2, 3)])
    got = rows_of(M.match_orders_single(slots), "buy_order_no", "sell_order_no", "volume")
    assert got == [("b", "s", 3), ("c", "s", 2)]


def test_call_auction_both_ways(spark):
    standing = orders(
        spark,
        [("b1", "A", "B", 12.0, 5, 1), ("b2", "A", "B", 10.0, 4, 2), ("s1", "A", "S", 9.0, 3, 3), ("s2", "A", "S", 11.0, 4, 4)],
    )
    columns = ["buy_order_no", "sell_order_no", "volume"]
    assert rows_of(M.call_auction(standing), *columns) == [("b1", "s1", 3), ("b1", "s2", 2)]
    assert rows_of(M.call_auction(standing, sell_order="desc"), *columns) == [
        ("b1", "s1", 1), ("b1", "s2", 4), ("b2", "s1", 2),
    ]


def test_matching_invariants(spark, data):
    book = view(spark, data, "stock_orders")
    fills = M.book_fills(book)
    assert fills.filter("volume <= 0").count() == 0
    rest = M.resting_orders(book)
    assert rest.filter("order_vol <= 0").count() == 0
    top = rest.groupBy("sec_code").agg(
        F.max(F.when(F.col("trade_dir") == "B", F.col("order_price"))).alias("bid"),
        F.min(F.when(F.col("trade_dir") == "S", F.col("order_price"))).alias("ask"),
    )
    assert top.filter("ask <= bid").count() == 0
    total = fills.agg(F.sum("volume")).collect()[0][0]
    assert total == M.match_orders_book(book).agg(F.sum("volume")).collect()[0][0]
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    one = rows_of(fills)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert one == rows_of(M.book_fills(book))


def test_laplace_and_scale(spark):
    counts = spark.createDataFrame([("a", "a", 2), ("b", "a", 1), ("b", "b", 3)], "from_state string, to_state string, count bigint")
    fractions = rows_of(markov.transition_probability(counts, ["a", "b"]), "from_no", "to_no", "p")
    assert fractions == [(0, 0, 0.75), (0, 1, 0.25), (1, 0, 0.25), (1, 1, 0.75)]
    whole = rows_of(markov.transition_probability(counts, ["a", "b"], 100), "from_no", "to_no", "p")
    assert whole == [(0, 0, 75), (0, 1, 25), (1, 0, 25), (1, 1, 75)]


def test_miss_probability_by_hand(spark):
    model = spark.createDataFrame(
        [(0, "a", 0, "a", 0.75), (0, "a", 1, "b", 0.25), (1, "b", 0, "a", 0.25), (1, "b", 1, "b", 0.75)],
        "from_no int, from_state string, to_no int, to_state string, p double",
    )
    records = spark.createDataFrame(
        [("e", i, s) for i, s in enumerate("aabbb")], "entity string, event_id bigint, state string"
    ).withColumn("ts", F.timestamp_seconds(F.col("event_id") * 90_000))
    got = [r["score"] for r in markov.markov_score(records, model).orderBy("event_id").collect()]
    assert got == [0, 0, 0, 0, 0.375]


def test_model_with_bad_width_fails(spark):
    lines = spark.createDataFrame([(0, "a,b"), (1, "0.5")], "line_no int, value string")
    with pytest.raises(Exception, match="row width differs"):
        T.load_markov_model(lines).collect()


def test_wiki_line_by_hand(spark):
    raw = ["[[Talk:X]] MB http://d * bob * (-12) fix", "no edit", "[[A]] \x1e http://d * b * (+3) c"]
    events = spark.createDataFrame([(r, "c", "s") for r in raw], "raw string, channel string, source string")
    got = rows_of(parse_edits(events), "title", "flags", "user", "byte_diff", F.col("flag_map")["is-talk"], "summary")
    assert got == [("A", "\x1e", "b", 3, False, "c"), ("Talk:X", "MB", "bob", -12, True, "fix")]
    assert rows_of(count_drops(events)) == [("c", 2, 1)]
    timed = parse_edits(events.withColumn("ts", F.timestamp_seconds(F.lit(0))))
    plain, compat = (wiki_window_stats(timed, 10, c).collect()[0]["counts"] for c in (False, True))
    assert plain["is-talk"] == 1 and compat["is-talk"] == 0


def test_split_tokens_like_the_jvm(spark):
    texts = ["a b", "a b  ", " a", "", " ", "a  b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(X.split_tokens(F.col("t"), " ")).collect()]
    assert got == [["a", "b"], ["a", "b"], ["", "a"], [""], [], ["a", "", "b"]]


def test_tweet_time_with_offset(spark):
    df = spark.createDataFrame([("Mon May 06 10:00:00 -0530 2019",), ("bad",)], "t string")
    got = [str(r[0]) for r in df.select(X.parse_tweet_time(F.col("t")).cast("string")).collect()]
    assert got == ["2019-05-06 15:30:00", "None"]


def test_sentiment_words(spark):
    words = spark.createDataFrame([("good", 3), ("bad", -3)], "word string, score int")
    tweets = spark.createDataFrame([("1", "Good, good!\nBAD."), ("2", "\tbad "), ("3", None)], "id_str string, text string")
    got = rows_of(text.sentiment_score(tweets, words))
    assert got == [("1", 3, "Positive"), ("2", -3, "Negative"), ("3", 0, "Neutral")]
    with pytest.raises(ValueError):
        text.classify("other", tweets, words)


def test_a_word_that_is_everywhere_meets_a_large_lexicon_once_a_text(spark, data, monkeypatch):
    from millrace.operators import joins

    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").where("doc_id % 4 = 0")
    words = spark.createDataFrame([("the", 2), ("de", -3), ("a", 1)], "word string, score int")
    short = rows_of(text.sentiment_score(rows, F.broadcast(words), "doc_id"))
    monkeypatch.setattr(joins, "MAX_BROADCAST_BYTES", 0)
    monkeypatch.setattr(text, "MAX_BROADCAST_BYTES", 0)
    assert rows_of(text.sentiment_score(rows, words, "doc_id")) == short
    tokens = rows.select(F.explode(F.split("text", " ")).alias("word"))
    plain = tokens.join(words, "word").groupBy("word").count()
    found = joins.lexicon_join(tokens, words, number="n")
    assert found.count() == 3
    assert rows_of(found, "word", "n") == rows_of(plain, "word", "count")


def test_histogram_confidence_single_bin(spark):
    df = spark.createDataFrame([(5, 1), (6, 1)], "v int, w int")
    bins = stats.histogram(df, [], "v", 10)
    assert rows_of(stats.histogram_confidence(bins, [], 10, 50)) == [(-5, 15)]


def test_page_view_country_and_options(spark):
    views = spark.createDataFrame([("p", "u", None, "CN"), ("p", "u", "US", None)], "pageId string, userId string, countryId string, country string")
    assert rows_of(kafka.page_view_country(views), "country") == [("CN",), ("US",)]
    assert kafka.topic_options("h:1", ["a", "b"], "latest")["startingOffsets"] == "latest"


def test_opening_book_files(spark, tmp_path):
    line = "o1|A|20190101|09:00:00|0.123|x|x|x|10.5|0|7|600000|" + "|".join("x" * 10) + "|B"
    (tmp_path / "600000").mkdir()
    (tmp_path / "600000" / "B.txt").write_text(line + "\n" + line.replace("o1", "o2") + "\n")
    (tmp_path / "600000" / "S.txt").write_text(line.replace("10.5", "11.0") + "\n")
    book = T.book_levels(T.load_opening_book(spark, str(tmp_path)))
    assert rows_of(book) == [("600000", "B", 10.5, 14, 2), ("600000", "S", 11.0, 7, 1)]


def test_first_seen_partition_runs_over(spark):
    df = spark.createDataFrame([(k, i) for i, k in enumerate([7, 9, 7, 4, 5])], "k bigint, seq bigint")
    got = rows_of(routing.partition_first_seen(df, "k", "seq", 2), "k", "partition")
    assert got == [(4, 0), (5, 1), (7, 0), (9, 1)]


def test_nearest_centroid_long_list_equals_short(spark):
    points = spark.range(50).select((F.col("id") * 7 % 31).alias("x"), (F.col("id") * 5 % 17).alias("y"))
    few = [(i, float(i * 3), float(i)) for i in range(20)]
    short = rows_of(nearest_centroid(points, few))
    far = [(100 + i, 1e6, 1e6) for i in range(100)]
    assert rows_of(nearest_centroid(points, few + far)) == short
    # Any number of centroids, in blocks of any size; a tie goes to the smallest id.
    many = few + [(100 + i, 1e6 + i, 1e6) for i in range(11_000)] + [(-1, 0.0, 0.0)]
    table = spark.createDataFrame(many, "id long, x double, y double")
    tied = rows_of(nearest_centroid(points, table, block=1000))
    assert [r[:2] + ((0 if r[2] == -1 else r[2]), r[3]) for r in tied] == short
    plain = rows_of(nearest_centroid(points, table))
    assert rows_of(nearest_centroid(points, table, block=1000)) == plain
    gone = spark.createDataFrame([(None, 1.0)], "x double, y double")
    assert rows_of(nearest_centroid(gone, few)) == [(None, 1.0, None, None)]


@pytest.mark.parametrize("linear", [False, True])
def test_many_centroids_by_a_tree_equal_brute_force(spark, linear):
    from millrace.operators.nearest import nearest_of_many

    rng = random.Random(4)
    # One far outlier, one dense cluster, repeated places and a line.
    places = [(0, 1e7, -1e7)] + [(i, rng.gauss(3, 0.01), rng.gauss(4, 0.01)) for i in range(1, 300)]
    places += [(i, float(i % 40), 2.0) for i in range(300, 420)] + [(999, 3.0, None), (998, float("nan"), 1.0)]
    points = [(i, rng.uniform(-50, 50), rng.uniform(-50, 50)) for i in range(150)] + [(900 + i, 3.0, 4.0) for i in range(20)]
    points += [(2000, 1e9, 1e9), (2001, None, 1.0), (2002, float("inf"), 1.0), (2003, 5.0, 2.0)]
    p = spark.createDataFrame(points, "n long, a double, b double")
    c = spark.createDataFrame(places, "id long, x double, y double")
    got = {r["n"]: (r["centroid_id"], r["distance"]) for r in nearest_of_many(p, c, "a", "b", linear, fan=4).collect()}
    assert len(got) == len(points)
    for n, a, b in points:
        if a is None or abs(a) == float("inf"):
            assert got[n] == (None, None)
            continue
        best = min(
            ((a - x) * (a - x) + ((b - y) if linear else (b - y) * (b - y)), i) for i, x, y in places if y is not None and x == x
        )
        assert got[n] == (best[1], best[0])


def test_far_points_copy_few_places(spark, monkeypatch):
    from millrace.operators import nearest

    # All points lie right of a grid of places, so every leaf on its right side is nearly as close as the others.
    places = spark.range(5000).select("id", (F.col("id") % 100).alias("x"), F.floor(F.col("id") / 100).alias("y"))
    points = spark.range(3000).select((1e6 + F.col("id")).alias("a"), (F.col("id") % 50).cast("double").alias("b"))
    plain, copied = nearest._under_nodes, []

    def counting(met, linear, leaf):
        copied.append(met.agg(F.sum(F.size("under"))).first()[0])
        return plain(met, linear, leaf)

    monkeypatch.setattr(nearest, "_under_nodes", counting)
    got = nearest.nearest_of_many(points, places, "a", "b", fan=16).collect()
    assert {(r["b"], r["centroid_id"]) for r in got} == {(float(y), y * 100 + 99) for y in range(50)}
    assert len(got) == 3000 and sum(copied) < 10 * 3000, copied


# --- one hot key holding most rows, spread over many buckets -----------------------------------


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(5)
    rows = []
    for i in range(900):
        key = "hot" if rng.random() < 0.6 else rng.choice(["a", "b", None])
        rows.append((key, i, rng.choice([0, 0, 0, 1, 40, 400]) + i * 30, round(rng.uniform(-5, 5), 1)))
    df = spark.createDataFrame(rows, "key string, id bigint, s bigint, v double")
    return df.withColumn("ts", F.timestamp_seconds("s")).cache(), rows


def by_key(rows):
    groups = {}
    for r in sorted(rows, key=lambda r: (r[2], r[1])):
        groups.setdefault(r[0], []).append(r)
    return groups


@pytest.fixture(params=[40, 150, None])
def depth(request, monkeypatch):
    """Rows of a bucket: the hot key is cut into many, into a few, or left whole."""
    if request.param:
        monkeypatch.setattr(ordered, "BUCKET_ROWS", request.param)
    return request.param


def test_cuts_have_equal_depth_and_never_go_back(spark, skewed, depth):
    df, rows = skewed
    bucketed, several = ordered.cut(df, ["key"], ["ts", "id"])
    assert several == bool(depth)
    found = {}
    for key, bucket, i in bucketed.orderBy("ts", "id").select("key", ordered.BUCKET, "id").collect():
        found.setdefault(key, []).append(bucket)
    assert sum(map(len, found.values())) == len(rows)
    for buckets in found.values():
        assert buckets == sorted(buckets)
        assert not depth or max(buckets.count(b) for b in set(buckets)) <= depth


def test_a_million_rows_of_one_key_in_an_hour_are_cut(spark):
    rows = spark.range(1_000_000).select(F.lit("k").alias("k"), F.timestamp_seconds(F.col("id") % 3600).alias("ts"), "id")
    bucketed, several = ordered.cut(rows, ["k"], ["ts", "id"])
    sizes = [r["count"] for r in bucketed.groupBy(ordered.BUCKET).count().collect()]
    assert several and sum(sizes) == 1_000_000 and max(sizes) <= ordered.BUCKET_ROWS and len(sizes) < 16
    # All at one instant: the tie decides.
    bucketed, _ = ordered.cut(rows.withColumn("ts", F.timestamp_seconds(F.lit(1))), ["k"], ["ts", "id"])
    assert bucketed.groupBy(ordered.BUCKET).count().agg(F.max("count")).first()[0] <= ordered.BUCKET_ROWS


def test_lookback_copies_only_what_is_missing(spark, skewed, monkeypatch):
    df, _ = skewed
    monkeypatch.setattr(ordered, "BUCKET_ROWS", 40)
    seen = ordered.with_lookback(df, ["key"], ["ts", "id"], 50)
    halo = seen.filter(ordered.HALO).groupBy("key", ordered.BUCKET).count().collect()
    # Each bucket has 32 rows or the rest: before the second are the 31 of the first, before all others 50.
    assert {(r[ordered.BUCKET], r["count"]) for r in halo if r["key"] == "hot"} == {
        (b, 31 if b == 1 else 50) for b in {r[ordered.BUCKET] for r in halo if r["key"] == "hot"}
    }
    assert len({r[ordered.BUCKET] for r in halo if r["key"] == "hot"}) > 5


def test_ordered_helpers_on_a_hot_key(spark, skewed, depth):
    df, rows = skewed
    order = ["ts", "id"]
    totals = ordered.running_totals(df, ["key"], order, {"t": F.col("v"), "n": F.lit(1)})
    latest = ordered.latest_before(df, ["key"], order, {"l": F.when(F.col("v") > 4, F.col("v"))})
    previous = ordered.previous_row(df, ["key"], order, {"v": "p"})
    got = {r["id"]: (round(r["t"], 6), r["n"]) for r in totals.collect()}
    got_l = {r["id"]: r["l"] for r in latest.collect()}
    got_p = {r["id"]: r["p"] for r in previous.collect()}
    assert len(got) == len(rows) == totals.count()
    for group in by_key(rows).values():
        total, last, before = 0.0, None, None
        for n, (_, i, _, v) in enumerate(group, 1):
            total += v
            last = v if v > 4 else last
            assert got[i] == (round(total, 6), n) and got_l[i] == last and got_p[i] == before
            before = v


def test_medians_on_a_hot_key(spark, skewed, depth):
    import statistics

    df, rows = skewed
    run = {r["id"]: r["running_median"] for r in running_median(df, ["key"], ["ts", "id"], "v").collect()}
    slide = {r["id"]: r["sliding_median"] for r in sliding_median(df, ["key"], ["ts", "id"], "v", 5).collect()}
    assert len(run) == len(slide) == len(rows)
    for group in by_key(rows).values():
        values = [r[3] for r in group]
        for n, r in enumerate(group, 1):
            assert run[r[1]] == pytest.approx(statistics.median(values[:n]))
            assert slide[r[1]] == pytest.approx(statistics.median(values[max(0, n - 5) : n]))


def test_ewma_and_sessions_on_a_hot_key(spark, skewed, depth):
    df, rows = skewed
    got = {r["id"]: r["ewma"] for r in ewma(df, ["key"], ["ts", "id"], "v").collect()}
    sessions = rows_of(session_count(df, "key", 35).select("key", F.unix_seconds("session_start"), "count"))
    want, decay = [], 2 / 31
    for key, group in by_key(rows).items():
        level = 0.0
        for n, r in enumerate(group, 1):
            if n == 11:
                level = sum(x[3] for x in group[:10]) / 10
            elif n > 11:
                level = r[3] * decay + level * (1 - decay)
            assert got[r[1]] == pytest.approx(level if n > 10 else 0.0)
            if n == 1 or r[2] - group[n - 2][2] > 35:
                want.append([key, r[2], 0])
            want[-1][2] += 1
    assert sessions == sorted(map(tuple, want), key=repr)


def test_missing_number_key_is_one_key(spark, skewed):
    df, rows = skewed
    number = F.when(F.col("key") == "hot", 1).when(F.col("key") == "a", 2)
    got = ewma(df.select(number.alias("k"), "ts", "id", "v"), ["k"], ["ts", "id"], "v")
    shown = {r["k"]: r["n"] for r in got.filter("ewma <> 0").groupBy("k").agg(F.count("*").alias("n")).collect()}
    others = sum(1 for r in rows if r[0] not in ("hot", "a"))
    assert got.count() == len(rows) and shown[None] == others - 10


def test_secondary_sort_keeps_keys_in_order(spark, skewed):
    from millrace.operators.selection import secondary_sort

    df, rows = skewed
    got = [tuple(r) for r in secondary_sort(df.filter("key IS NOT NULL"), "key", ["v", "id"], 4).select("key", "v", "id").collect()]
    assert got == sorted((r[0], r[3], r[1]) for r in rows if r[0] is not None)


def test_joins_on_a_hot_key(spark, skewed, depth):
    df, rows = skewed
    left = df.filter("id % 2 = 0").select("key", F.col("id").alias("l"), "ts")
    right = df.filter("id % 2 = 1").select(F.col("key").alias("k2"), F.col("id").alias("r"), "ts")
    got = rows_of(interval_join(left, right, [("key", "k2")], 100.0), "l", "r")
    want = [
        (a[1], b[1]) for a in rows for b in rows
        if a[1] % 2 == 0 and b[1] % 2 == 1 and a[0] is not None and a[0] == b[0] and abs(a[2] - b[2]) < 100
    ]
    assert got == sorted(want, key=repr)
    pairs = latest_join(df.filter("id % 2 = 0"), df.filter("id % 2 = 1"), ["key"], 60.0)
    found = rows_of(pairs.select("left.id", F.col("right.id").alias("r")))
    expected, newest = [], {}
    for r in sorted(rows, key=lambda r: (r[2], r[1] % 2, r[1])):
        side = newest.setdefault(r[0], [None, None])
        side[r[1] % 2] = r
        other = side[1 - r[1] % 2]
        if other is not None and r[2] - other[2] < 60:
            expected.append((side[0][1], side[1][1]))
    assert found == sorted(expected, key=repr)


def test_kth_and_group_lines_on_a_hot_key(spark, skewed, depth):
    df, rows = skewed
    for k in (0, 57):
        got = {r["key"]: r["v"] for r in select_kth(df.filter("key IS NOT NULL"), ["key"], "v", k, ["id"]).collect()}
        for key, group in by_key(rows).items():
            if key is not None:
                assert got[key] == sorted(r[3] for r in group)[k]
    text_rows = df.filter("key = 'hot'").withColumn("line", F.concat_ws(",", F.col("id").cast("string"), F.lit("x")))
    (line,) = A.group_concat(text_rows, "key", [0], "line", ["ts", "id"]).collect()
    assert line["line"].split(",")[1:] == [str(r[1]) for r in by_key(rows)["hot"]]
    items = A.group_items(text_rows, "key", [0], "line", ["ts", "id"]).orderBy("position").collect()
    assert [r["item"] for r in items] == line["line"].split(",")[1:]


def test_no_cross_joins_and_pruned_scans(spark, data):
    from millrace import registry

    for name in ("m9_fraud_nearest_cluster", "m3_call_auction", "j4_unkeyed_band_join", "g11_histogram_confidence", "w1_running_price_sum"):
        plan = registry.queries()[name](spark, data)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
    plan = registry.queries()["p2_q2_selection"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "l_suppkey" not in plan.split("ReadSchema")[1]


def test_filters_and_format(spark):
    alarm = spark.createDataFrame([("1", 9.5), ("2", 10.0)], "sec_code string, trade_price double")
    assert [r["value"] for r in P.price_alarm(alarm).orderBy("key").collect()] == [P.LOW_PRICE_TEXT, P.NORMAL_TEXT]


# --- values that must stay exact beside nulls ----------------------------------------------------

BIG = 2**53 + 1


def test_large_ids_stay_exact_beside_null_keys(spark):
    rows = [(BIG + i, "k" if i % 3 else None, float(i), i) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, key string, v double, t long")
    smooth = ewma(df, ["key"], ["t", "id"], "v")
    assert sorted(r["id"] for r in smooth.collect()) == [r[0] for r in rows]
    medians = running_median(df, ["key"], ["t", "id"], "v")
    assert sorted(r["id"] for r in medians.collect()) == [r[0] for r in rows]


def test_large_integer_keys_do_not_meet_in_a_book(spark):
    orders = [
        (2**60 + 1, "A", "S", 10.0, "s1", 5), (2**60 + 2, "A", "B", 10.0, "b1", 5), (None, "A", "B", 9.0, "b2", 1),
        (None, "A", "S", 9.0, "s2", 1),
    ]
    df = spark.createDataFrame(orders, "sec_code long, tran_maint_code string, trade_dir string, order_price double, order_no string, order_vol int")
    df = df.withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    assert rows_of(M.book_fills(df)) == [(None, "b2", "s2", 9.0, 1)]
    assert {r["sec_code"] for r in M.resting_orders(df).collect()} == {2**60 + 1, 2**60 + 2}


def test_nan_is_the_largest_value_of_a_median(spark):
    values = [5.0, float("nan"), 1.0, 2.0, 3.0, float("inf")]
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(values)], "key string, t long, v double")
    for rows in (2, 4, 100):
        got = running_median(df, ["key"], ["t"], "v", rows=rows).orderBy("t").collect()
        assert [repr(r["running_median"]) for r in got] == ["5.0", "nan", "5.0", "3.5", "3.0", "4.0"]


def test_null_keys_and_labels_are_kept(spark):
    df = spark.createDataFrame([(None, "x", 1.0), ("a", None, 2.0), ("a", "x", 3.0)], "k string, c string, v double")
    assert rows_of(A.contingency_table(df, "k", "c")) == rows_of(
        spark.createDataFrame([(None, "x", 1, 1, 2), ("a", None, 1, 2, 1), ("a", "x", 1, 2, 2)], "a string, b string, c int, d int, e int")
    )
    assert len(stats.histogram(df, ["k"], "v", 1).collect()) == 3
    assert {r["k"] for r in select_kth(df, ["k"], "v", 0).collect()} == {None, "a"}
    orders = spark.createDataFrame(
        [(None, "A", "B", 10.0, "b", 5), (None, "A", "S", 9.0, "s", 3), (None, "A", "S", 9.0, "n", None)],
        "sec_code string, tran_maint_code string, trade_dir string, order_price double, order_no string, order_vol int",
    ).withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    standing = M.standing_orders(orders)
    assert len(M.auction_depth(standing).collect()) == 2
    trades = M.call_auction(standing)
    assert [r["volume"] for r in trades.collect()] == [3]
    assert rows_of(M.after_call(standing, trades), "order_no", "order_vol") == [("b", 2)]
    assert rows_of(M.rejected_orders(orders)) == [(None, 1)]


def test_a_missing_volume_trades_nothing_and_a_missing_code_is_kept(spark):
    rows = [("1", None, "B", 10.0, "b", 5), ("1", "A", "S", 9.0, "s", None), ("1", "X", "S", 9.0, "x", 5), ("1", "A", "S", 9.5, "t", 2)]
    df = spark.createDataFrame(
        rows, "sec_code string, tran_maint_code string, trade_dir string, order_price double, order_no string, order_vol int"
    ).withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    assert rows_of(M.match_orders_single(df), "buy_order_no", "sell_order_no", "volume") == [("b", "t", 2)]
    assert rows_of(M.book_fills(df), "buy_order_no", "sell_order_no", "volume") == [("b", "t", 2)]
    assert {r["order_no"] for r in P.drop_inactive_orders(df).collect()} == {"b", "s", "t"}


def test_an_edit_line_may_hold_newlines(spark):
    line = "[[T]] M http://x * u * (+5) text"
    df = spark.createDataFrame([(f"a\nb {line}\nmore",), (line,)], "raw string")
    got = [r[0] for r in df.select(X.parse_wiki_line(F.col("raw"))).collect()]
    assert got[0] == got[1] and got[0][0] == "T" and got[0][4] == "5"


def test_unknown_states_score_nothing_and_fail_training(spark):
    rows = [("e", i, "zz") for i in range(6)]
    df = spark.createDataFrame(rows, "entity string, event_id long, state string").withColumn("ts", F.timestamp_seconds("event_id"))
    model = markov.transition_probability(
        spark.createDataFrame([("a", "b", 3)], "from_state string, to_state string, count long"), ["a", "b"]
    )
    assert {(r["score"], r["outlier"]) for r in markov.markov_score(df, model).collect()} == {(0.0, False)}
    with pytest.raises(Exception, match="unknown states"):
        markov.train_markov(df, ["a", "b"], "entity", ["ts", "event_id"], "state").collect()


def test_a_cluster_without_a_shared_folder_is_refused(monkeypatch):
    from millrace import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default=None):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session())


def test_tables_without_keys_are_cut_too(spark, skewed, monkeypatch):
    df, rows = skewed
    want = {r["id"]: r["position"] for r in ordered.with_position(df, [], ["ts", "id"]).collect()}
    monkeypatch.setattr(ordered, "BUCKET_ROWS", 40)
    placed = ordered.with_position(df, [], ["ts", "id"])
    assert {r["id"]: r["position"] for r in placed.collect()} == want and len(want) == len(rows)


@pytest.mark.parametrize("rows", [None, 3000])
def test_weighted_average_over_many_blocks(spark, rows):
    rng = random.Random(3)
    values = [rng.uniform(-9, 9) for _ in range(9000)] + [0.0] * 4000 + [1e-3] * 10
    df = spark.createDataFrame(list(enumerate(values)), "t long, v double")
    for age in (30.0, 3.0, 1.0):
        decay, level, want = 2 / (age + 1), 0.0, []
        for n, v in enumerate(values, 1):
            level = sum(values[:10]) / 10 if n == 11 else v * decay + level * (1 - decay) if n > 11 else 0.0
            want.append(level)
        got = [r["ewma"] for r in ewma(df, [], ["t"], "v", age, rows=rows).orderBy("t").collect()]
        assert got == pytest.approx(want, rel=1e-9, abs=1e-12)
    spoiled = ewma(df.withColumn("v", F.when(F.col("t") != 50, F.col("v"))), [], ["t"], "v", rows=rows)
    assert spoiled.filter(F.isnan("ewma")).count() == len(values) - 50


def test_missing_values_do_not_count_in_medians(spark):
    import statistics

    rng = random.Random(6)
    rows = [("k" if i % 4 else None, i, None if 100 < i < 190 or rng.random() < 0.3 else rng.uniform(-5, 5)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, t long, v double")
    for depth in (40, None):
        slide = {r["t"]: r["sliding_median"] for r in sliding_median(df, ["k"], ["t"], "v", 9, depth).collect()}
        before = {r["t"]: r["m"] for r in with_running_median(df, ["k"], ["t"], "v", "m", False, depth).collect()}
        for key in ("k", None):
            group = [r for r in rows if r[0] == key]
            for n, (_, t, _) in enumerate(group):
                last = [r[2] for r in group[max(0, n - 8) : n + 1] if r[2] is not None]
                past = [r[2] for r in group[:n] if r[2] is not None]
                assert slide[t] == (pytest.approx(statistics.median(last)) if last else None)
                assert before[t] == (pytest.approx(statistics.median(past)) if past else None)


def test_log_lines_keep_their_order_over_blocks_and_files(spark, tmp_path):
    from millrace.sources.logs import read_log_lines

    for name in ("one", "two"):
        folder = tmp_path / f"container={name}"
        folder.mkdir()
        for part in range(2):
            lines = [f"{name} {part} line {i}" for i in range(40 * (part + 1))]
            (folder / f"part-{part}.txt").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = read_log_lines(spark, str(tmp_path), r"container=([^/]+)/[^/]+$").orderBy("container", "line_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = [(n, 40 * p + i, f"{n} {p} line {i}") for n in ("one", "two") for p in (0, 1) for i in range(40 * (p + 1))]
    assert [tuple(r) for r in got] == want


def test_a_lexicon_file_is_read_without_regular_expressions(spark, data):
    from millrace.registry import sources

    plan = sources.lexicon(spark, data, every_line=True)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "regexp" not in plan and "rlike" not in plan and "lambda" not in plan
    # A line is trimmed at both ends once.
    assert plan.count("(trim(") == 1
    lines = [
        (1, " good \t 1 \r"), (2, "good\t2"), (3, "\t\tbad\t \t-3\tx"), (4, "alone"), (5, " \t\x0b "), (6, ""), (7, None),
        (8, "\x0c\x0btwo words\t\t4\n"), (9, "one\t "), (10, "ä世\U0001f600 \t+7"),
        (None, "late\t5"), (11, "\xa0w\xa0\t6"),
    ]
    shown = spark.createDataFrame(lines, "line_no bigint, value string")
    got = {r["word"]: r["score"] for r in T.load_lexicon(shown).collect()}
    assert got == {"good": 2, "bad": -3, "two words": 4, "ä世\U0001f600": 7, "late": None, "\xa0w\xa0": 6}
