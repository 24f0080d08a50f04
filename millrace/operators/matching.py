"""Order matching: a price-time book, a one-slot matcher and the opening call auction.

A book is sequential by nature, so its unit of work is one security in one trading session
(``keys``). Rows stream through in order and a task holds only the orders that rest in the
book. The call auction is not sequential: matching two sorted queues is an overlap of their
cumulative volume intervals, which is a hash join.
"""

from __future__ import annotations

import heapq
from collections import OrderedDict
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.projections import drop_inactive_orders, drop_non_new_orders
from millrace.operators.ordered import fold_sorted, latest_before, running_totals

DELETE = "D"


class Side:
    """Resting orders of one direction: a queue per price and a heap of prices.

    A queue is an ``OrderedDict``: a plain one walks over all that has left its front to find the first.
    """

    def __init__(self, sign: int):
        self.sign = sign
        self.levels: dict[float, OrderedDict] = {}
        self.heap: list[float] = []
        self.twins = 0

    def add(self, price: float, order_no: str, volume: int) -> None:
        queue = self.levels.get(price)
        if queue is None:
            queue = self.levels[price] = OrderedDict()
            heapq.heappush(self.heap, self.sign * price)
        self.join(queue, order_no, volume)

    def join(self, queue: OrderedDict, order_no: str, volume: int) -> None:
        ident = (order_no, 0)
        while ident in queue:
            self.twins += 1
            ident = (order_no, ident[1] + 1)
        queue[ident] = volume

    def leave(self, queue: OrderedDict, order_no: str) -> bool:
        ident = (order_no, 0)
        if ident not in queue and self.twins:
            ident = next((i for i in queue if i[0] == order_no), ident)
        return queue.pop(ident, None) is not None

    def remove(self, price: float, order_no: str) -> bool:
        queue = self.levels.get(price)
        if queue is None or not self.leave(queue, order_no):
            return False
        if not queue:
            del self.levels[price]
        return True

    def best(self) -> float | None:
        heap, sign, levels = self.heap, self.sign, self.levels
        while heap:
            price = sign * heap[0]
            if price in levels:
                return price
            heapq.heappop(heap)
        return None

    def head(self, price: float):
        return next(iter(self.levels[price].items()))

    def take(self, price: float, ident, volume: int) -> None:
        queue = self.levels[price]
        left = queue[ident] - volume
        if left > 0:
            queue[ident] = left
        else:
            del queue[ident]
            if not queue:
                del self.levels[price]

    def rows(self):
        for price in sorted(self.levels, key=lambda p: self.sign * p):
            for (order_no, _), volume in self.levels[price].items():
                yield price, order_no, volume


class Book:
    """Buys and sells of one security; an arriving order trades at the best sell price."""

    def __init__(self):
        self.buys, self.sells = Side(-1), Side(1)

    def side(self, direction: str) -> Side | None:
        return self.buys if direction == "B" else self.sells if direction == "S" else None

    def rest(self, direction: str, price: float, order_no: str, volume: int) -> None:
        side = self.side(direction)
        if side is not None and volume > 0:
            side.add(price, order_no, volume)

    def apply(self, code: str, direction: str, price: float, order_no: str, volume: int):
        """Trades caused by one order: (buy order, sell order, price, volume)."""
        side = self.side(direction)
        if side is None:
            return []
        if code == DELETE:
            side.remove(price, order_no)
            return []
        if volume > 0:
            side.add(price, order_no, volume)
        fills = []
        bid, ask = self.buys.best(), self.sells.best()
        while bid is not None and ask is not None and ask <= bid:
            buy, buy_volume = self.buys.head(bid)
            sell, sell_volume = self.sells.head(ask)
            traded = min(buy_volume, sell_volume)
            self.buys.take(bid, buy, traded)
            self.sells.take(ask, sell, traded)
            fills.append((buy[0], sell[0], ask, traded))
            bid, ask = self.buys.best(), self.sells.best()
        return fills


_INPUT = ["tran_maint_code", "trade_dir", "order_price", "order_no", "order_vol", "__seed"]


def with_volume(orders: DataFrame) -> DataFrame:
    """Orders that have a volume and a price; the others can neither rest nor trade."""
    return orders.filter(F.col("order_vol").isNotNull() & F.col("order_price").isNotNull())


def rejected_orders(orders: DataFrame, keys: Sequence[str] = ("sec_code",)) -> DataFrame:
    """How many orders of each key were left out for want of a volume or a price."""
    missing = F.col("order_vol").isNull() | F.col("order_price").isNull()
    return orders.filter(missing).groupBy(*keys).agg(F.count(F.lit(1)).alias("rejected"))


def _keys_schema(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)


def _book_input(orders: DataFrame, opening: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    columns = [*keys, "tran_maint_code", "trade_dir", "order_price", "order_no", "order_vol", "ts"]
    # A deletion names its order and price; only it may come without a volume.
    usable = F.col("order_price").isNotNull() & (F.col("order_vol").isNotNull() | (F.col("tran_maint_code") == DELETE))
    rows = drop_inactive_orders(orders).filter(usable).select(*columns).withColumn("__seed", F.lit(0))
    if opening is not None:
        seeds = with_volume(opening).select(*columns).withColumn("__seed", F.lit(1))
        rows = rows.unionByName(seeds)
    return rows.withColumn("__late", 1 - F.col("__seed"))


def _advance(book: Book, row: tuple, n: int):
    code, direction, price, order_no, volume, seed = row[n:]
    if seed:
        book.rest(direction, price, order_no, volume)
        return []
    return book.apply(code, direction, price, order_no, volume)


def match_orders_book(
    orders: DataFrame, keys: Sequence[str] = ("sec_code",), opening: DataFrame | None = None
) -> DataFrame:
    """One row per order that traded: total volume and last price.

    ``opening`` rows rest in the book before the first order and do not trade with each other.
    Name the session column in ``keys`` when books start anew each session.
    """
    rows = _book_input(orders, opening, keys)
    n = len(keys)

    def step(book, row):
        fills = _advance(book, row, n)
        if not fills:
            return []
        return [(*row[:n], row[n + 3], sum(f[3] for f in fills), fills[-1][2], len(fills))]

    schema = f"{_keys_schema(rows, keys)}, order_no string, volume bigint, price double, fills int"
    return fold_sorted(rows, keys, ["__late", "ts", "order_no"], Book, step, None, schema, _INPUT)


def book_fills(
    orders: DataFrame, keys: Sequence[str] = ("sec_code",), opening: DataFrame | None = None
) -> DataFrame:
    """Every single trade: buy order, sell order, price and volume."""
    rows = _book_input(orders, opening, keys)
    n = len(keys)

    def step(book, row):
        return [(*row[:n], *fill) for fill in _advance(book, row, n)]

    schema = f"{_keys_schema(rows, keys)}, buy_order_no string, sell_order_no string, price double, volume bigint"
    return fold_sorted(rows, keys, ["__late", "ts", "order_no"], Book, step, None, schema, _INPUT)


def resting_orders(
    orders: DataFrame, keys: Sequence[str] = ("sec_code",), opening: DataFrame | None = None
) -> DataFrame:
    """What is left in the book after the last order."""
    rows = _book_input(orders, opening, keys)
    n = len(keys)

    def step(book, row):
        _advance(book, row, n)
        return []

    def finish(book, key):
        return [
            (*key, direction, price, order_no, volume)
            for direction, side in (("B", book.buys), ("S", book.sells))
            for price, order_no, volume in side.rows()
        ]

    schema = f"{_keys_schema(rows, keys)}, trade_dir string, order_price double, order_no string, order_vol bigint"
    return fold_sorted(rows, keys, ["__late", "ts", "order_no"], Book, step, finish, schema, _INPUT)


def book_balance(orders: DataFrame, keys: Sequence[str] = ("sec_code",)) -> DataFrame:
    """Per key: volume placed, whether it all was filled, deleted or still rests, and whether the book is uncrossed."""
    rows = _book_input(orders, None, keys)
    n = len(keys)

    def start():
        return {"book": Book(), "placed": 0, "filled": 0, "deleted": 0}

    def resting(book):
        return sum(v for side in (book.buys, book.sells) for _, _, v in side.rows())

    def step(state, row):
        code, direction, price, order_no, volume, _ = row[n:]
        book = state["book"]
        if code == DELETE:
            side = book.side(direction)
            gone = side.levels.get(price, {}) if side else {}
            held = sum(gone.values())
            _advance(book, row, n)
            left = sum(side.levels.get(price, {}).values()) if side else 0
            state["deleted"] += held - left
            return []
        if volume > 0:
            state["placed"] += volume
        state["filled"] += 2 * sum(f[3] for f in _advance(book, row, n))
        return []

    def finish(state, key):
        book = state["book"]
        bid, ask = book.buys.best(), book.sells.best()
        total = state["filled"] + state["deleted"] + resting(book)
        return [(*key, state["placed"], total == state["placed"], bid is None or ask is None or bid < ask)]

    schema = f"{_keys_schema(rows, keys)}, placed bigint, balanced boolean, uncrossed boolean"
    return fold_sorted(rows, keys, ["__late", "ts", "order_no"], start, step, finish, schema, _INPUT)


class Slots:
    """At most one resting order per direction; a newer one replaces it."""

    def __init__(self):
        self.resting: dict[str, tuple] = {}

    def apply(self, direction: str, price: float, order_no: str, volume: float):
        """The trade caused by one order, or None."""
        if direction == "":
            return None
        mine, other = ("S", "B") if direction == "S" else ("B", "S")
        self.resting[mine] = (price, order_no, volume)
        if other not in self.resting:
            return None
        buy, sell = self.resting["B"], self.resting["S"]
        if buy[0] < sell[0]:
            return None
        traded = min(buy[2], sell[2])
        for name, order in (("B", buy), ("S", sell)):
            if order[2] > traded:
                self.resting[name] = (order[0], order[1], order[2] - traded)
            else:
                del self.resting[name]
        return (buy[1], sell[1], buy[0], sell[0], traded)


def match_orders_single(orders: DataFrame, keys: Sequence[str] = ("sec_code",)) -> DataFrame:
    """Trades of the one-slot matcher; deleted, voided and uncoded orders take no part."""
    columns = ["trade_dir", "order_price", "order_no", "order_vol"]
    rows = with_volume(drop_non_new_orders(orders)).select(*keys, *columns, "ts")
    n = len(keys)

    def step(slots, row):
        trade = slots.apply(*row[n:])
        return [] if trade is None else [(*row[:n], *trade)]

    schema = (
        f"{_keys_schema(rows, keys)}, buy_order_no string, sell_order_no string, "
        "buy_price double, sell_price double, volume bigint"
    )
    return fold_sorted(rows, keys, ["ts", "order_no"], Slots, step, None, schema, columns)


def relay_orders(orders: DataFrame) -> DataFrame:
    """Accepted orders keyed by their security."""
    return drop_non_new_orders(orders).select(F.col("sec_code").alias("key"), F.struct("*").alias("value"))


def standing_orders(orders: DataFrame, keys: Sequence[str] = ("sec_code",)) -> DataFrame:
    """Orders still standing at the end of the call phase: the last word on each order number."""
    live = drop_inactive_orders(orders)
    last = F.max_by(
        F.struct("tran_maint_code", "order_price", "order_vol", "ts"), F.struct("ts", "tran_maint_code")
    )
    final = live.groupBy(*keys, "trade_dir", "order_no").agg(last.alias("o"))
    deleted = F.coalesce(F.col("o.tran_maint_code") == DELETE, F.lit(False))
    return final.filter(~deleted & (F.col("o.order_vol") > 0) & F.col("o.order_price").isNotNull()).select(
        *keys, "trade_dir", "order_no", "o.tran_maint_code", "o.order_price", "o.order_vol", "o.ts"
    )


def call_auction(
    standing: DataFrame,
    keys: Sequence[str] = ("sec_code",),
    sell_order: str = "asc",
) -> DataFrame:
    """Match standing orders, buys from the highest price down.

    ``asc`` takes the cheapest sell first. Both queues are laid out on a common volume axis; a
    trade is an overlap of a buy and a sell interval whose prices agree. Every overlap begins
    where one of the two begins, so it is found by looking, at each beginning, at the newest
    interval of either side: no pairs are formed. ``desc`` takes the dearest sell that the buy
    still accepts, which depends on every earlier step.
    """
    if sell_order == "desc":
        return _call_auction_desc(standing, keys)
    price = F.col("order_price")
    queued = running_totals(
        standing.withColumn("__rank", F.when(F.col("trade_dir") == "B", -price).otherwise(price)),
        [*keys, "trade_dir"],
        ["__rank", "ts", "order_no"],
        {"__end": F.col("order_vol").cast("bigint")},
    ).withColumn("__start", F.col("__end") - F.col("order_vol"))
    interval = F.struct("order_no", "order_price", "__start", "__end")
    newest = {
        "buy": F.when(F.col("trade_dir") == "B", interval),
        "sell": F.when(F.col("trade_dir") == "S", interval),
    }
    columns = [*keys, "trade_dir", "order_no", "order_price", "__start", "__end"]
    met = latest_before(queued.select(*columns), keys, ["__start", "trade_dir", "order_no"], newest)
    low = F.greatest("buy.__start", "sell.__start")
    high = F.least("buy.__end", "sell.__end")
    agreed = F.col("buy.order_price") >= F.col("sell.order_price")
    # The filter on the two sides keeps greatest/least from skipping a missing one.
    both = F.col("buy").isNotNull() & F.col("sell").isNotNull()
    return met.filter(both & agreed & (low < high)).select(
        *keys,
        F.col("buy.order_no").alias("buy_order_no"),
        F.col("sell.order_no").alias("sell_order_no"),
        F.col("buy.order_price").alias("buy_price"),
        F.col("sell.order_price").alias("sell_price"),
        (high - low).alias("volume"),
    )


def _call_auction_desc(standing: DataFrame, keys: Sequence[str]) -> DataFrame:
    import bisect
    from collections import deque

    columns = ["trade_dir", "order_price", "order_no", "order_vol"]
    rows = standing.select(*keys, *columns, "ts").withColumn(
        "__turn", F.when(F.col("trade_dir") == "S", 0).otherwise(1)
    )
    rank = F.when(F.col("trade_dir") == "B", -F.col("order_price")).otherwise(F.col("order_price"))
    n = len(keys)

    def start():
        return {"prices": [], "queues": {}}

    def step(state, row):
        direction, price, order_no, volume = row[n:]
        prices, queues = state["prices"], state["queues"]
        if direction == "S":
            if price not in queues:
                prices.append(price)
                queues[price] = deque()
            queues[price].append([order_no, volume])
            return []
        fills = []
        at = bisect.bisect_right(prices, price) - 1
        while volume > 0 and at >= 0:
            queue = queues[prices[at]]
            while queue and volume > 0:
                traded = min(volume, queue[0][1])
                fills.append((*row[:n], order_no, queue[0][0], price, prices[at], traded))
                volume -= traded
                queue[0][1] -= traded
                if queue[0][1] == 0:
                    queue.popleft()
            if not queue:
                del queues[prices[at]], prices[at]
            at -= 1
        return fills

    schema = (
        f"{_keys_schema(standing, keys)}, buy_order_no string, sell_order_no string, "
        "buy_price double, sell_price double, volume bigint"
    )
    ranked = rows.withColumn("__rank", rank)
    return fold_sorted(ranked, keys, ["__turn", "__rank", "ts", "order_no"], start, step, None, schema, columns)


def after_call(standing: DataFrame, trades: DataFrame, keys: Sequence[str] = ("sec_code",)) -> DataFrame:
    """Standing orders with what the call auction left of them."""
    used = trades.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.lit("B").alias("trade_dir"), F.col("buy_order_no").alias("order_no"), "volume"),
                F.struct(F.lit("S").alias("trade_dir"), F.col("sell_order_no").alias("order_no"), "volume"),
            )
        ).alias("f"),
    ).select(*keys, "f.trade_dir", "f.order_no", F.col("f.volume").alias("__used"))
    per_order = used.groupBy(*keys, "trade_dir", "order_no").agg(F.sum("__used").alias("__used"))
    names = [*keys, "trade_dir", "order_no"]
    per_order = per_order.select(*[F.col(c).alias(f"__{c}") for c in names], "__used")
    same_order = F.lit(True)
    for c in names:
        same_order = same_order & F.col(c).eqNullSafe(F.col(f"__{c}"))
    left = standing.join(per_order, same_order, "left").withColumn(
        "order_vol", F.col("order_vol") - F.coalesce(F.col("__used"), F.lit(0))
    )
    return left.filter(F.col("order_vol") > 0).select(*standing.columns)


def match_orders_continuous(
    orders: DataFrame, opening: DataFrame, keys: Sequence[str] = ("sec_code",)
) -> DataFrame:
    """Continuous trading on a book that already holds the ``opening`` orders."""
    return match_orders_book(orders, keys, opening)


def auction_depth(
    standing: DataFrame, keys: Sequence[str] = ("sec_code",)
) -> DataFrame:
    """Per price: volume offered to buy at it or above, to sell at it or below, and what could clear."""
    levels = with_volume(standing).groupBy(*keys, "order_price").agg(
        F.sum(F.when(F.col("trade_dir") == "B", F.col("order_vol")).otherwise(0)).alias("__b"),
        F.sum(F.when(F.col("trade_dir") == "S", F.col("order_vol")).otherwise(0)).alias("__s"),
    )
    up = running_totals(
        levels, keys, ["order_price"], {"ask_depth": F.col("__s"), "__b_upto": F.col("__b")}
    )
    # Over the price levels, which are few: no second read, and a null key keeps its levels.
    return (
        up.withColumn("__b_all", F.sum("__b").over(Window.partitionBy(*keys)))
        .withColumn("bid_depth", F.col("__b_all") - F.col("__b_upto") + F.col("__b"))
        .select(*keys, "order_price", "bid_depth", "ask_depth", F.least("bid_depth", "ask_depth").alias("cleared"))
    )


def uniform_price(depth: DataFrame, keys: Sequence[str] = ("sec_code",)) -> DataFrame:
    """The price that clears most, the lowest one among equals."""
    best = F.max(F.struct("cleared", (-F.col("order_price")).alias("__p")))
    return (
        depth.groupBy(*keys)
        .agg(best.alias("b"))
        .select(*keys, (-F.col("b.__p")).alias("clearing_price"), F.col("b.cleared").alias("cleared_volume"))
    )
