"""Keyed state on streams: one processor per sequential operator.

State is kept per key in the state store, so a micro-batch touches only the keys it carries.
Rows of a key are sorted within a micro-batch; across micro-batches they count in arrival
order. ``ttl_ms`` bounds how long an idle key is kept (0 keeps it for ever); where event time
decides, a timer lets state go once the watermark has passed it.

A key's rows of one micro-batch are worked on in pieces of ``PIECE_ROWS``. A task holds ``RUN_BYTES`` of
them as Arrow columns; more are sorted in runs that go through a file of the executor's own folder.
"""

from __future__ import annotations

import heapq
import os
import pickle
import tempfile
from collections import OrderedDict
from collections.abc import Callable, Iterator, MutableMapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from millrace.operators.folds import Fold
from millrace.operators.matching import Book, Side, Slots

PIECE_ROWS = 50_000
#: Bytes of a key's rows that a task holds as Arrow columns before it sorts them into a file, and orders of a book
#: that it holds before it puts them into one.
RUN_BYTES, HELD_ROWS = 16 << 20, 100_000


def _schema(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


def keyed(
    df: DataFrame,
    keys: Sequence[str],
    processor: StatefulProcessor,
    schema: str,
    mode: str = "append",
    event_time: bool = False,
) -> DataFrame:
    """Run a processor per key; its ``ttl_ms`` decides whether idle state expires.

    ``event_time`` gives the processor timers on the watermark. Without either the query has no clock of
    its own, so a drained input lets it stop.
    """
    clock = "EventTime" if event_time else "ProcessingTime" if processor.ttl_ms else "None"
    return df.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=_schema(schema), outputMode=mode, timeMode=clock
    )


def scratch_file():
    """A file without a name in the executor's own folder; it goes when it is closed or the worker ends."""
    folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
    return tempfile.TemporaryFile(dir=folder if os.path.isdir(folder) else None)


class Runs:
    """Rows of one key as sorted runs in a file, given back in order over all runs.

    A run is cut into ``CUTS`` batches, of which the first rows are kept. A row may go out when it comes
    before the first row of every batch not yet read, so about one batch of a run is held at a time.
    """

    CUTS = 64

    def __init__(self, order: Sequence[str]):
        self.order, self.rows = [*order, "__arrived"], 0
        self.file, self.batches, self.firsts = None, [], []

    def sorted(self, parts: list):
        """The rows of some tables as one table in order; rows that tie keep the order of their arrival."""
        import numpy as np
        import pyarrow as pa

        table = pa.concat_tables(parts, promote_options="permissive")
        if "__arrived" not in table.column_names:
            table = table.append_column("__arrived", pa.array(np.arange(self.rows, self.rows + len(table))))
            self.rows += len(table)
        # In one piece: picking rows from a column of many would put the whole of it together for every pick.
        table = table.combine_chunks()
        return table.take(self.places(table))

    def places(self, table):
        import pyarrow.compute as pc

        return pc.sort_indices(table.select(self.order), sort_keys=[(c, "ascending") for c in self.order])

    def add(self, parts: list) -> None:
        if self.file is None:
            self.file = scratch_file()
        table = self.sorted(parts)
        step = max(1, -(-len(table) // self.CUTS))
        self.firsts.append(table.select(self.order).take(list(range(0, len(table), step))))
        for at in range(0, len(table), step):
            data = table.slice(at, step).to_batches()[0].serialize()
            self.batches.append((self.file.tell(), data.size, table.schema))
            self.file.write(data)

    def read(self, number: int):
        import pyarrow as pa

        at, size, schema = self.batches[number]
        self.file.seek(at)
        return pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(self.file.read(size)), schema)])

    def merged(self, piece: int) -> Iterator:
        """All rows in order, as tables of at most ``piece`` rows."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        firsts = pa.concat_tables(self.firsts, promote_options="permissive").combine_chunks()
        turns, at, held = self.places(firsts), 0, []
        while at < len(turns) or held:
            fresh = 0
            while at < len(turns) and fresh < piece:
                held.append(self.read(turns[at].as_py()))
                fresh += len(held[-1])
                at += 1
            table = self.sorted(held)
            ready = len(table)
            if at < len(turns):
                both = pa.concat_tables(
                    [table.select(self.order), firsts.take(turns.slice(at, 1))], promote_options="permissive"
                ).combine_chunks()
                ready = pc.index(self.places(both), len(table)).as_py()
            for start in range(0, ready, piece):
                yield table.slice(start, min(piece, ready - start)).drop_columns(["__arrived"])
            # A copy, so that what has gone out is let go.
            held = [table.take(np.arange(ready, len(table)))] if ready < len(table) else []

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def in_order(frames: Iterator, order: Sequence[str], piece: int = PIECE_ROWS) -> Iterator:
    """The rows of all frames in order, as frames of at most ``piece`` rows.

    What does not fit in one piece is kept as Arrow columns; beyond ``RUN_BYTES`` it is sorted and put into a
    file, and the sorted runs are merged as they are read back.
    """
    import pandas as pd
    import pyarrow as pa

    held, parts, n, size = [], [], 0, 0
    runs = Runs(order)
    try:
        for frame in frames:
            held.append(frame)
            n += len(frame)
            if n > piece:
                fresh = [pa.Table.from_pandas(f, preserve_index=False) for f in held]
                size += sum(t.nbytes for t in fresh)
                parts += fresh
                held, n, fresh = [], 0, None
            if size > RUN_BYTES:
                runs.add(parts)
                parts, size = [], 0
        if not parts and not runs.batches:
            if held:
                yield pd.concat(held, ignore_index=True).sort_values(list(order), kind="stable")
            return
        parts += [pa.Table.from_pandas(f, preserve_index=False) for f in held]
        held = None
        if not runs.batches:
            table = runs.sorted(parts).drop_columns(["__arrived"])
            parts = None
            for at in range(0, len(table), piece):
                yield table.slice(at, piece).to_pandas()
            return
        if parts:
            runs.add(parts)
            parts = None
        for table in runs.merged(piece):
            yield table.to_pandas()
    finally:
        runs.close()


class SortedProcessor(StatefulProcessor):
    """Base: goes through a key's rows of the micro-batch in order and keeps one state row per key."""

    state_schema = "value double"
    order: Sequence[str] = ("ts",)

    def __init__(self, ttl_ms: int = 0):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", self.state_schema, self.ttl_ms or None)

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        kept = self.state.get() if self.state.exists() else None
        for batch in in_order(rows, self.order):
            out, kept = self.run(key, batch, kept)
            if len(out):
                yield out
        if kept is None:
            self.state.clear()
        else:
            self.state.update(kept)

    def run(self, key, batch, kept):
        raise NotImplementedError

    def close(self) -> None:
        pass


class RunningSum(SortedProcessor):
    """Running sum, count and average per key."""

    state_schema = "total double, n bigint"

    def __init__(self, keys: Sequence[str], value: str, order: Sequence[str], ttl_ms: int = 0):
        super().__init__(ttl_ms)
        self.keys, self.value, self.order = list(keys), value, list(order)

    def run(self, key, batch, kept):
        total, n = kept if kept is not None else (0.0, 0)
        sums = batch[self.value].astype(float).cumsum() + total
        counts = range(n + 1, n + len(batch) + 1)
        out = batch[[*self.keys, *self.order]].assign(
            running_sum=sums, running_count=list(counts), running_avg=sums / list(counts)
        )
        return out, (float(sums.iloc[-1]), n + len(batch))


def running_sum_stream(
    df: DataFrame, key: str, value: str, order: Sequence[str] = ("ts",), ttl_ms: int = 0
) -> DataFrame:
    fields = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in [key, *order])
    schema = f"{fields}, running_sum double, running_count bigint, running_avg double"
    return keyed(df.select(key, *order, value), [key], RunningSum([key], value, order, ttl_ms), schema)


class Ewma(SortedProcessor):
    """Exponentially weighted average with a warm-up mean."""

    state_schema = "average double, n bigint"

    def __init__(self, key: str, value: str, order: Sequence[str], age: float, warmup: int, ttl_ms: int = 0):
        super().__init__(ttl_ms)
        self.key, self.value, self.order = key, value, list(order)
        self.decay, self.warmup = 2.0 / (age + 1.0), warmup

    def run(self, key, batch, kept):
        average, n = kept if kept is not None else (0.0, 0)
        shown = []
        for v in batch[self.value].tolist():
            n += 1
            if n <= self.warmup:
                average += v
            elif n == self.warmup + 1:
                average /= self.warmup
            else:
                average = v * self.decay + average * (1 - self.decay)
            shown.append(average if n > self.warmup else 0.0)
        return batch[[self.key, *self.order]].assign(ewma=shown), (float(average), n)


def ewma_stream(
    df: DataFrame, key: str, value: str, order: Sequence[str] = ("ts",), age: float = 30.0, warmup: int = 10,
    ttl_ms: int = 0,
) -> DataFrame:
    fields = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in [key, *order])
    processor = Ewma(key, value, order, age, warmup, ttl_ms)
    return keyed(df.select(key, *order, value), [key], processor, f"{fields}, ewma double")


class MarkovWindow(SortedProcessor):
    """Mean change penalty over the last ``n`` states of an entity, or over all of them."""

    state_schema = "recent array<string>, cost double, steps bigint"

    def __init__(self, penalties: dict, n: int, threshold: float, whole: bool, order: Sequence[str], ttl_ms: int = 0):
        super().__init__(ttl_ms)
        self.penalties, self.n, self.threshold = penalties, n, threshold
        self.whole, self.order = whole, list(order)

    def run(self, key, batch, kept):
        recent, cost, steps = (list(kept[0]), kept[1], kept[2]) if kept is not None else ([], 0.0, 0)
        scores = []
        for state in batch["state"].tolist():
            if recent:
                cost += self.penalties.get((recent[-1], state), 0.0)
                steps += 1
            recent = [*recent, state][-self.n :]
            if self.whole:
                score = cost / steps if steps else 0.0
            elif len(recent) == self.n:
                score = sum(self.penalties.get(p, 0.0) for p in zip(recent, recent[1:])) / (self.n - 1)
            else:
                score = 0.0
            scores.append(score)
        out = batch[["entity", *self.order]].assign(score=scores, outlier=[s > self.threshold for s in scores])
        return out, (recent, float(cost), steps)


def markov_score_stream(
    records: DataFrame,
    penalties: dict[tuple[str, str], float],
    n: int = 5,
    threshold: float = 0.96,
    whole: bool = False,
    order: Sequence[str] = ("ts", "event_id"),
    ttl_ms: int = 0,
) -> DataFrame:
    """Score a stream of (entity, order..., state); ``penalties`` covers the short state alphabet."""
    fields = ", ".join(f"{c} {records.schema[c].dataType.simpleString()}" for c in ["entity", *order])
    processor = MarkovWindow(penalties, n, threshold, whole, order, ttl_ms)
    wanted = records.select("entity", *order, "state")
    return keyed(wanted, ["entity"], processor, f"{fields}, score double, outlier boolean")


class StoredLevels(MutableMapping):
    """The queues of one side of a book by price; a queue is put together when it is first needed.

    ``near`` has what is in memory: a queue, or what has happened to one that was not needed yet, a list of the
    place of the rest of it and then order and volume in turn, volume 0 for an order deleted. ``far`` has the
    place of what is not: ``STORE``, or where it begins in a file of what memory did not hold.
    """

    STORE = -1

    def __init__(self, prices: Sequence[float], read: Callable[[float], dict], side=None, file=None):
        self.read, self.side, self.file = read, side, file
        self.far: dict[float, int] = dict.fromkeys(prices, self.STORE)
        self.near: dict[float, OrderedDict | list] = {}
        self.stored = frozenset(self.far)
        self.unchanged: set[float] = set()
        self.loaded = 0

    def __contains__(self, price):
        return price in self.near or price in self.far

    def __getitem__(self, price):
        queue = self.near.get(price)
        if type(queue) is not OrderedDict:
            if queue is None and price not in self.far:
                raise KeyError(price)
            queue = self.near[price] = self._whole(price)
            self.loaded += len(queue)
        return queue

    def __setitem__(self, price, queue):
        self.far.pop(price, None)
        self.near[price] = queue

    def __delitem__(self, price):
        self.near.pop(price, None)
        self.far.pop(price, None)
        self.unchanged.discard(price)

    def __iter__(self):
        yield from self.near
        yield from self.far

    def __len__(self):
        return len(self.near) + len(self.far)

    def log(self, price: float, order_no: str, volume: int) -> None:
        """Note what happens to a queue that is not in memory, or that is new."""
        queue = self.near.get(price)
        if queue is None:
            queue = self.near[price] = [self.far.pop(price, None)]
        queue.append(order_no)
        queue.append(volume)

    def _whole(self, price: float) -> OrderedDict:
        """A queue put together from the store, the file and what was noted since; it leaves ``far``."""
        noted = self.near.get(price)
        logs = [] if noted is None else [noted]
        place = self.far.pop(price, None) if noted is None else noted[0]
        if noted is None and place == self.STORE:
            self.unchanged.add(price)
        queue = None
        while place is not None and place != self.STORE:
            self.file.seek(place)
            kind, part = pickle.load(self.file)
            if kind == "queue":
                queue, place = OrderedDict(part), None
            else:
                logs.append(part)
                place = part[0]
        if queue is None:
            queue = self.read(price) if place == self.STORE else OrderedDict()
        for part in reversed(logs):
            for order_no, volume in zip(part[1::2], part[2::2]):
                if volume:
                    self.side.join(queue, order_no, volume)
                else:
                    self.side.leave(queue, order_no)
        return queue

    def spill(self) -> None:
        """Let memory go; what changed goes into the file."""
        place = self.file.seek(0, os.SEEK_END)
        for price, queue in self.near.items():
            if price in self.unchanged:
                self.far[price] = self.STORE
                continue
            self.far[price] = place
            part = ("queue", list(queue.items())) if type(queue) is OrderedDict else ("log", queue)
            place += self.file.write(pickle.dumps(part, pickle.HIGHEST_PROTOCOL))
        self.near, self.loaded = {}, 0
        self.unchanged.clear()

    def changed(self) -> Iterator[tuple[float, dict]]:
        """The queues to write, one at a time; one that turns out empty is gone."""
        for price in [p for p in self if self.far.get(p) != self.STORE and p not in self.unchanged]:
            queue = self.near.get(price)
            if type(queue) is not OrderedDict:
                queue = self._whole(price)
            # All that matters from here on is that the price is there.
            self.near.pop(price, None)
            if queue:
                self.far[price] = self.STORE
                yield price, queue

    def gone(self) -> list[float]:
        return [p for p in self.stored if p not in self]


class StoredSide(Side):
    """A side over stored levels: orders join and leave a queue that does not trade without its being read."""

    def add(self, price: float, order_no: str, volume: int) -> None:
        levels = self.levels
        queue = levels.near.get(price)
        if type(queue) is OrderedDict:
            levels.unchanged.discard(price)
            self.join(queue, order_no, volume)
            return
        if queue is None and price not in levels.far:
            heapq.heappush(self.heap, self.sign * price)
        levels.log(price, order_no, volume)

    def remove(self, price: float, order_no: str) -> bool:
        levels = self.levels
        queue = levels.near.get(price)
        if type(queue) is OrderedDict:
            levels.unchanged.discard(price)
            return super().remove(price, order_no)
        if queue is None and price not in levels.far:
            return False
        levels.log(price, order_no, 0)
        return True

    def best(self) -> float | None:
        heap, sign, levels = self.heap, self.sign, self.levels
        while heap:
            price = sign * heap[0]
            if price in levels:
                if levels[price]:
                    return price
                del levels[price]
            heapq.heappop(heap)
        return None

    def take(self, price: float, ident, volume: int) -> None:
        self.levels.unchanged.discard(price)
        super().take(price, ident, volume)

    def spill(self) -> None:
        self.levels.spill()
        # Prices that have gone and come again are in the heap more than once.
        self.heap = [self.sign * p for p in self.levels]
        heapq.heapify(self.heap)


class BookKeeper(StatefulProcessor):
    """A price-time book per security, one state row per price level.

    A micro-batch reads and writes the levels that its orders join, leave or trade with; the prices of
    either side are one row, from which the best is known. Of the book ``HELD_ROWS`` orders or so are in
    memory besides the queues at its front; the others wait in the store or in a file.
    """

    def __init__(self, ttl_ms: int = 0):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = self.ttl_ms or None
        self.levels = handle.getMapState(
            "levels", "trade_dir string, order_price double", "order_nos array<string>, volumes array<bigint>", ttl
        )
        self.prices = handle.getValueState("prices", "buys array<double>, sells array<double>", ttl)

    def _open(self, side, direction: str, prices: Sequence[float], file=None) -> None:
        """Let a side of a fresh book read its levels from the store."""

        def read(price):
            queue = OrderedDict()
            names, volumes = self.levels.getValue((direction, price))
            for order_no, volume in zip(names, volumes):
                side.join(queue, order_no, int(volume))
            return queue

        side.levels = StoredLevels(prices, read, side, file)
        side.heap = [side.sign * p for p in prices]
        heapq.heapify(side.heap)

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        with scratch_file() as file:
            yield from self._matched(key, rows, file)

    def _matched(self, key, rows: Iterator, file) -> Iterator:
        import pandas as pd

        book = Book()
        book.buys, book.sells = StoredSide(-1), StoredSide(1)
        sides = {"B": book.buys, "S": book.sells}
        known = self.prices.get() if self.prices.exists() else ([], [])
        for (direction, side), prices in zip(sides.items(), known):
            self._open(side, direction, [float(p) for p in prices], file)
        held = 0
        for batch in in_order(rows, ["ts", "order_no"]):
            out = []
            for code, direction, price, order_no, volume in zip(
                batch["tran_maint_code"], batch["trade_dir"], batch["order_price"], batch["order_no"], batch["order_vol"]
            ):
                fills = book.apply(code, direction, price, order_no, volume)
                if fills:
                    out.append((key[0], order_no, sum(f[3] for f in fills), fills[-1][2], len(fills)))
            if out:
                yield pd.DataFrame(out, columns=["sec_code", "order_no", "volume", "price", "fills"])
            held += len(batch)
            if held + sum(side.levels.loaded for side in sides.values()) > HELD_ROWS:
                for side in sides.values():
                    side.spill()
                held = 0
        for direction, side in sides.items():
            for price, queue in side.levels.changed():
                level = ([i[0] for i in queue], [int(v) for v in queue.values()])
                self.levels.updateValue((direction, float(price)), level)
            for price in side.levels.gone():
                self.levels.removeKey((direction, price))
        left = [sorted(map(float, side.levels)) for side in sides.values()]
        if not any(left):
            self.prices.clear()
        elif any(side.levels.keys() != side.levels.stored for side in sides.values()) or self.ttl_ms:
            self.prices.update(tuple(left))

    def close(self) -> None:
        pass


def match_orders_stream(orders: DataFrame, ttl_ms: int = 0) -> DataFrame:
    """Order-book matching on a stream; one row per order that traded."""
    from millrace.functions.projections import drop_inactive_orders

    columns = ["sec_code", "tran_maint_code", "trade_dir", "order_price", "order_no", "order_vol", "ts"]
    rows = drop_inactive_orders(orders).select(*columns)
    schema = "sec_code string, order_no string, volume bigint, price double, fills int"
    return keyed(rows, ["sec_code"], BookKeeper(ttl_ms), schema)


class SlotKeeper(SortedProcessor):
    """The one-slot matcher; both slots are one state row."""

    state_schema = (
        "b_price double, b_order string, b_volume bigint, s_price double, s_order string, s_volume bigint"
    )
    order = ("ts", "order_no")

    def run(self, key, batch, kept):
        import pandas as pd

        slots = Slots()
        if kept is not None:
            for name, part in (("B", kept[:3]), ("S", kept[3:])):
                if part[1] is not None:
                    slots.resting[name] = tuple(part)
        out = []
        for direction, price, order_no, volume in zip(
            batch["trade_dir"], batch["order_price"], batch["order_no"], batch["order_vol"]
        ):
            trade = slots.apply(direction, float(price), order_no, int(volume))
            if trade is not None:
                out.append((key[0], *trade))
        names = ["sec_code", "buy_order_no", "sell_order_no", "buy_price", "sell_price", "volume"]
        empty = (None, None, None)
        after = (*slots.resting.get("B", empty), *slots.resting.get("S", empty)) if slots.resting else None
        return pd.DataFrame(out, columns=names), after


def match_single_stream(orders: DataFrame, ttl_ms: int = 0) -> DataFrame:
    """One-slot matching on a stream."""
    from millrace.functions.projections import drop_non_new_orders

    rows = drop_non_new_orders(orders).select("sec_code", "trade_dir", "order_price", "order_no", "order_vol", "ts")
    schema = (
        "sec_code string, buy_order_no string, sell_order_no string, buy_price double, sell_price double, "
        "volume bigint"
    )
    return keyed(rows, ["sec_code"], SlotKeeper(ttl_ms), schema)


class LatestPair(StatefulProcessor):
    """The newest row of each side per key; each arrival is paired with the other side's.

    With ``timers`` a key's rows leave the store when the watermark is ``ttl_seconds`` past them.
    """

    def __init__(self, key: str, ttl_seconds: float, ttl_ms: int = 0, timers: bool = False):
        self.key, self.ttl, self.ttl_ms, self.timers = key, ttl_seconds, ttl_ms, timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        one = "body string, micros bigint"
        self.handle = handle
        self.newest = [handle.getValueState(n, one, self.ttl_ms or None) for n in ("left_side", "right_side")]

    def _ends(self, micros: int) -> int:
        """The first millisecond at which a row can meet none that follows."""
        return -(-(micros + round(self.ttl * 1_000_000)) // 1000)

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        newest = [s.get() if s.exists() else None for s in self.newest]
        first = True
        for batch in in_order(rows, ["micros", "side", "tie"]):
            if first:
                # What is too old for the first arrival can meet none that follows.
                oldest, first = batch["micros"].iloc[0] - self.ttl * 1_000_000, False
                newest = [n if n is None or n[1] > oldest else None for n in newest]
            out = []
            for micros, side, body in zip(batch["micros"].tolist(), batch["side"].tolist(), batch["body"].tolist()):
                newest[side] = (body, micros)
                other = newest[1 - side]
                if other is not None and micros - other[1] < self.ttl * 1_000_000:
                    out.append((key[0], newest[0][0], newest[1][0], side, micros))
            if out:
                yield pd.DataFrame(out, columns=[self.key, "left", "right", "arrived_side", "micros"])
        for state, row in zip(self.newest, newest):
            if row is not None:
                state.update(tuple(row))
            elif state.exists():
                state.clear()
        # One timer a key; it looks at what is there when it ends.
        if self.timers and next(iter(self.handle.listTimers()), None) is None:
            self.handle.registerTimer(self._ends(max(row[1] for row in newest if row is not None)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        now, left = timerValues.getCurrentWatermarkInMs(), []
        for state in self.newest:
            if state.exists():
                ends = self._ends(state.get()[1])
                if ends <= now:
                    state.clear()
                else:
                    left.append(ends)
        if left:
            self.handle.registerTimer(max(left))
        return iter([])

    def close(self) -> None:
        pass


def latest_join_stream(
    left: DataFrame,
    right: DataFrame,
    key: str,
    ttl: float,
    ts: str = "ts",
    tie: str = "id",
    idle_ms: int = 0,
    late: str | None = None,
) -> DataFrame:
    """Stream form of ``latest_join``; the two rows come back as JSON.

    ``ttl`` is event time. With ``late``, how far rows may lag behind, a watermark runs along and the state
    of a silent key goes once it is ``ttl`` past; older rows are dropped. ``idle_ms`` drops the state of keys
    that were silent that long by the clock of the machine.
    """

    def side(df: DataFrame, number: int) -> DataFrame:
        return df.select(
            key,
            F.col(ts).alias("at"),
            F.unix_micros(ts).alias("micros"),
            F.lit(number).alias("side"),
            F.col(tie).cast("string").alias("tie"),
            F.to_json(F.struct(*[c for c in df.columns if c != key])).alias("body"),
        )

    both = side(left, 0).unionByName(side(right, 1))
    both = both.withWatermark("at", late) if late else both.drop("at")
    kind = left.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, left string, right string, arrived_side int, micros bigint"
    paired = keyed(both, [key], LatestPair(key, ttl, idle_ms, bool(late)), schema, event_time=bool(late))
    return paired.withColumn("arrived_at", F.timestamp_micros("micros")).drop("micros")


class Upsert(StatefulProcessor):
    """Stores each message under itself and reports the ones that are new."""

    def __init__(self, ttl_ms: int = 0):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stored = handle.getValueState("stored", "message string, puts bigint", self.ttl_ms or None)

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        puts = sum(len(batch) for batch in rows)
        before = self.stored.get()[1] if self.stored.exists() else 0
        self.stored.update((key[0], before + puts))
        if before == 0:
            yield pd.DataFrame({"message": [key[0]]})

    def close(self) -> None:
        pass


def upsert_store(messages: DataFrame, column: str = "value", ttl_ms: int = 0) -> DataFrame:
    """Keep every distinct message; a table gives the store's content, a stream its new entries."""
    rows = messages.select(F.col(column).alias("message"))
    if not messages.isStreaming:
        return rows.groupBy("message").agg(F.count(F.lit(1)).alias("puts"))
    return keyed(rows, ["message"], Upsert(ttl_ms), "message string")


def read_store(spark, checkpoint: str, state: str = "stored") -> DataFrame:
    """The stored rows of a stopped query."""
    return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", state).load()


def fold_stream(
    df: DataFrame,
    keys: Sequence[str],
    step: Callable,
    state_schema: str,
    schema: str,
    order: Sequence[str],
    ttl_ms: int = 0,
) -> DataFrame:
    """A user-defined fold: ``step(key, rows, state) -> (output rows, new state)``.

    ``ttl_ms`` lets the state of idle keys go.
    """

    class Custom(SortedProcessor):
        def run(self, key, batch, kept):
            return step(key, batch, kept)

    Custom.state_schema, Custom.order = state_schema, list(order)
    return keyed(df, keys, Custom(ttl_ms), schema)


class PaneFold(StatefulProcessor):
    """The state of a user's fold for one key and window; a timer on the window's end gives its result."""

    ttl_ms = 0

    def __init__(self, fold: Fold, names: Sequence[str], columns: Sequence[str], size: int, outputs: Sequence[str]):
        self.fold, self.names, self.columns, self.size, self.outputs = fold, list(names), list(columns), size, list(outputs)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("pane", "state binary", None)

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        fold, state = self.fold, self.fold.init()
        for frame in rows:
            frame = frame.astype(object).where(frame.notna(), None)
            for row in zip(*[frame[c] for c in self.columns]):
                state = fold.fold(state, *row)
        if self.state.exists():
            state = fold.merge(pickle.loads(self.state.get()[0]), state)
        else:
            self.handle.registerTimer(-(-(key[-1] + self.size) // 1000))
        self.state.update((pickle.dumps(state),))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        values = self.fold.finish(pickle.loads(self.state.get()[0]))
        self.state.clear()
        yield pd.DataFrame([(*key, *values)], columns=[*self.names, *self.outputs])

    def close(self) -> None:
        pass


def fold_windows_stream(
    df: DataFrame, keys: Sequence[str], seconds: float, columns: Sequence[str], fold: Fold, schema: str, ts: str = "ts"
) -> DataFrame:
    """Stream form of ``folds.fold_windows``; ``df`` has a watermark on ``ts``.

    A micro-batch folds its rows of a window and merges them into the stored state; the result comes when
    the watermark passes the end of the window.
    """
    size = round(seconds * 1_000_000)
    pane = (F.floor(F.unix_micros(ts) / size) * size).alias("pane")
    rows = df.select(*keys, pane, *[c for c in dict.fromkeys([*columns, ts]) if c not in keys])
    outputs = _schema(schema)
    fields = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)
    processor = PaneFold(fold, [*keys, "pane"], columns, size, outputs.names)
    found = keyed(rows, [*keys, "pane"], processor, f"{fields}pane bigint, {schema}", event_time=True)
    return found.select(
        *keys,
        F.timestamp_micros("pane").alias("window_start"),
        F.timestamp_micros(F.col("pane") + size).alias("window_end"),
        *outputs.names,
    )
