"""Latency-objective report over executor logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.bounded import in_any_interval
from millrace.operators.ordered import with_position
from millrace.session import cut_lineage

# Fixed values of the report: limit in ms, slot length in ms, first and last slot, peak slots.
LATENCY_LIMIT = 1000.0
SLOT_MS = 1000
INTERVAL = (120, 720)
PEAKS = ((0, 120), (7200, 7290))


def compact_log(log: DataFrame) -> DataFrame:
    """The log with the ground-truth lines of one executor, substream and time as one line.

    Everything in this module gives the same on it. It is written to the shared folder once, so a
    report reads the log itself a single time, whatever it is asked for.
    """
    gt = F.col("kind") == "gt"
    keys = ["container", "kind", "ts_ms", "substream", "host"]
    own = F.when(~gt, F.col("line_no")).alias("__line")
    summed = log.groupBy(*keys, own).agg(
        F.max("line_no").alias("line_no"), F.sum("n").alias("n"), F.sum("latency_ms").alias("latency_ms")
    )
    return cut_lineage(summed.drop("__line"))


def run_start(log: DataFrame) -> Column:
    """Earliest non-zero ground-truth time, as a scalar subquery."""
    times = log.filter((F.col("kind") == "gt") & (F.col("ts_ms") != 0))
    return times.agg(F.min("ts_ms")).scalar()


def slo_window_latency(log: DataFrame, slot_ms: int = SLOT_MS) -> DataFrame:
    """Count, latency sum and mean per (substream, slot)."""
    slot = F.floor((F.col("ts_ms") - run_start(log)) / slot_ms).alias("slot")
    gt = log.filter(F.col("kind") == "gt")
    sums = gt.groupBy("substream", slot).agg(F.sum("n").alias("n"), F.sum("latency_ms").alias("latency_ms"))
    return sums.withColumn("avg_latency", F.when(F.col("n") > 0, F.col("latency_ms") / F.col("n")))


def _violates(limit: float) -> Column:
    return F.coalesce(F.col("avg_latency") > limit, F.lit(False))


def slo_success_rate(
    latency: DataFrame, interval: tuple[int, int] = INTERVAL, limit: float = LATENCY_LIMIT
) -> DataFrame:
    """Violating slots and success rate of each substream."""
    slots = interval[1] - interval[0] + 1
    bad = _violates(limit) & F.col("slot").between(*interval)
    per = latency.groupBy("substream").agg(F.sum(bad.cast("bigint")).alias("violations"))
    return per.withColumn("slots", F.lit(slots).cast("bigint")).withColumn(
        "success_rate", 1 - F.col("violations") / slots
    )


def slo_overall(rates: DataFrame) -> DataFrame:
    return rates.agg(
        F.sum("violations").alias("violations"),
        F.sum("slots").alias("slots"),
        (1 - F.sum("violations") / F.sum("slots")).alias("success_rate"),
    )


def slo_peak_split(
    latency: DataFrame,
    peaks: Sequence[tuple[int, int]] = PEAKS,
    interval: tuple[int, int] = INTERVAL,
    limit: float = LATENCY_LIMIT,
) -> DataFrame:
    """Violations inside each peak, and the success rate outside all peaks."""
    bad = _violates(limit)
    slots = interval[1] - interval[0] + 1
    in_peak = [
        F.sum((bad & in_any_interval(F.col("slot"), [p])).cast("bigint")).alias(f"peak_{i}_violations")
        for i, p in enumerate(peaks)
    ]
    per = latency.groupBy("substream").agg(
        F.sum((bad & F.col("slot").between(*interval)).cast("bigint")).alias("__v"), *in_peak
    )
    total = per.agg(
        F.sum("__v").alias("violations"),
        F.count(F.lit(1)).alias("__n"),
        *[F.sum(f"peak_{i}_violations").alias(f"peak_{i}_violations") for i in range(len(peaks))],
    )
    inside = sum((F.col(f"peak_{i}_violations") for i in range(len(peaks))), F.lit(0))
    peak_slots = sum(b - a + 1 for a, b in peaks)
    any_bad = F.col("violations") > 0
    rest = F.when(any_bad, F.col("violations") - inside).otherwise(F.col("violations"))
    rest_slots = F.when(any_bad, F.col("__n") * (slots - peak_slots)).otherwise(F.col("__n") * slots)
    return total.withColumn("off_peak_success_rate", 1 - rest / rest_slots).drop("__n")


def violation_intervals(
    latency: DataFrame,
    interval: tuple[int, int] = INTERVAL,
    limit: float = LATENCY_LIMIT,
) -> DataFrame:
    """Runs of neighbouring violating slots of a substream."""
    bad = latency.filter(_violates(limit) & F.col("slot").between(*interval)).select("substream", "slot")
    placed = with_position(bad, ["substream"], ["slot"])
    runs = placed.groupBy("substream", (F.col("slot") - F.col("position")).alias("__run")).agg(
        F.min("slot").alias("start_slot"), F.max("slot").alias("end_slot")
    )
    return runs.drop("__run")


def violation_histogram(rates: DataFrame) -> DataFrame:
    """Substreams per share of violating slots: steps of 1% below 20%, of 5% from there on."""
    share = F.floor(F.col("violations") * 100 / F.col("slots"))
    low = F.when(share < 20, share).otherwise(F.least(F.floor(share / 5) * 5, F.lit(95)))
    return rates.groupBy(low.cast("int").alias("percent_from")).agg(F.count(F.lit(1)).alias("substreams"))


def executor_lifetimes(log: DataFrame, interval: tuple[int, int] = INTERVAL) -> DataFrame:
    """Live time in ms of each executor inside the interval, with its host."""
    kind, ts, line = F.col("kind"), F.col("ts_ms"), F.col("line_no")

    def pick(which, name: str, column: Column = ts) -> Column:
        return which(F.when(kind == name, column), F.when(kind == name, line))

    per = log.groupBy("container").agg(
        pick(F.min_by, "restore").alias("restore"),
        pick(F.max_by, "gt").alias("last_gt"),
        pick(F.max_by, "shutdown").alias("last_end"),
        pick(F.max_by, "host", F.col("host")).alias("host"),
    )
    start = run_start(log)
    low, high = interval[0] * 1000, interval[1] * 1000
    begin = F.greatest(F.col("restore") - start, F.lit(low))
    shown = F.coalesce(F.col("last_gt") + 1000 - start, F.col("begin"))
    end = F.least(F.greatest(shown, F.col("last_end") - start), F.lit(high))
    return (
        per.filter(F.col("restore").isNotNull())
        .withColumn("begin", begin)
        .withColumn("end", end)
        .select("container", "host", F.greatest(F.col("end") - F.col("begin"), F.lit(0)).alias("live_ms"))
    )


def host_live_time(lifetimes: DataFrame) -> DataFrame:
    known = lifetimes.filter(F.col("host").isNotNull())
    return known.groupBy("host").agg(F.sum("live_ms").alias("live_ms"))


def migration_spans(
    log: DataFrame, interval: tuple[int, int] = INTERVAL
) -> DataFrame:
    """Restarts of each executor: the n-th stop to the next entry into its run loop, in ms.

    Number 0 goes from the first start to the first run loop. Lines are paired by their number
    within (executor, kind), so one grouping brings the ends of a span together.
    """
    marks = log.filter(F.col("kind").isin("restore", "enter", "shutting", "shutdown")).select(
        "container", "kind", "line_no", "ts_ms"
    )
    placed = with_position(marks, ["container", "kind"], ["line_no"])
    kind, at = F.col("kind"), F.col("position")
    number = F.when(kind == "enter", at - 1).when(kind == "restore", at - 1).otherwise(at)
    first = (kind != "restore") | (at == 1)
    spans = (
        placed.filter(first)
        .groupBy("container", number.alias("number"))
        .agg(
            F.max(F.when(kind.isin("restore", "shutting"), F.col("ts_ms"))).alias("left"),
            F.max(F.when(kind == "enter", F.col("ts_ms"))).alias("entered"),
            F.max(F.when(kind == "shutdown", F.col("ts_ms"))).alias("stopped"),
        )
    )
    started = log.filter(kind == "restore").select("container").distinct()
    start = run_start(log)
    low, high = F.lit(interval[0] * 1000), F.lit(interval[1] * 1000)
    used = spans.filter((F.col("number") == 0) | F.col("stopped").isNotNull()).join(started, "container", "left_semi")
    left = F.greatest(F.col("left") - start, low)
    right = F.least(F.coalesce("entered", "stopped", F.lit(0)) - start, high)
    clipped = used.filter(F.col("left").isNotNull()).select(
        "container", "number", left.alias("left_ms"), right.alias("right_ms")
    )
    inside = ~((F.col("right_ms") <= low) | (F.col("left_ms") >= high))
    return clipped.filter(inside).withColumn("span_ms", F.col("right_ms") - F.col("left_ms"))


def longest_restart(log: DataFrame) -> DataFrame:
    """The longest time from a stop to the next run loop over the whole run, with its executor.

    Of equally long ones the first executor by name is given; without a restart there is no row.
    """
    marks = log.filter(F.col("kind").isin("enter", "shutdown")).select("container", "kind", "line_no", "ts_ms")
    placed = with_position(marks, ["container", "kind"], ["line_no"])
    entered = F.col("kind") == "enter"
    number = F.when(entered, F.col("position") - 1).otherwise(F.col("position"))
    pairs = placed.groupBy("container", number.alias("number")).agg(
        F.max(F.when(entered, F.col("ts_ms"))).alias("entered"),
        F.max(F.when(~entered, F.col("ts_ms"))).alias("stopped"),
    )
    spans = pairs.select("container", (F.col("entered") - F.col("stopped")).alias("longest_ms"))
    best = F.min(F.struct((-F.col("longest_ms")).alias("less"), "container"))
    top = spans.filter(F.col("longest_ms").isNotNull()).agg(best.alias("b")).filter(F.col("b").isNotNull())
    return top.select(F.col("b.container").alias("container"), (-F.col("b.less")).alias("longest_ms"))


def migration_time(spans: DataFrame, lifetimes: DataFrame) -> DataFrame:
    """Number, total, shortest and longest restart, and their share of the live time."""
    live = lifetimes.agg(F.sum("live_ms")).scalar()
    totals = spans.agg(
        F.count(F.lit(1)).alias("migrations"),
        F.coalesce(F.sum("span_ms"), F.lit(0)).alias("total_ms"),
        F.min("span_ms").alias("min_ms"),
        F.max("span_ms").alias("max_ms"),
    )
    return totals.withColumn("live_ms", live).withColumn("ratio", F.col("total_ms") / F.col("live_ms"))


def slo_report(
    log: DataFrame, interval: tuple[int, int] = INTERVAL, peaks: Sequence[tuple[int, int]] = PEAKS
) -> DataFrame:
    """All single figures of the report as (section, item, value).

    All of them come from the compacted log, so the log is read once.
    """
    log = compact_log(log)
    slots = slo_window_latency(log)
    rates = slo_success_rate(slots, interval)
    lifetimes = executor_lifetimes(log, interval)

    def unpivot(df: DataFrame, section: str) -> DataFrame:
        pairs = F.array(
            *[F.struct(F.lit(c).alias("item"), F.col(c).cast("double").alias("value")) for c in df.columns]
        )
        return df.select(F.lit(section).alias("section"), F.explode(pairs).alias("p")).select(
            "section", "p.item", "p.value"
        )

    per_stream = rates.select(
        F.lit("substream").alias("section"),
        F.col("substream").cast("string").alias("item"),
        F.col("success_rate").alias("value"),
    )
    per_host = host_live_time(lifetimes).select(
        F.lit("host").alias("section"), F.col("host").alias("item"), F.col("live_ms").cast("double").alias("value")
    )
    parts = [
        unpivot(slo_overall(rates), "overall"),
        unpivot(slo_peak_split(slots, peaks, interval), "peak"),
        unpivot(migration_time(migration_spans(log, interval), lifetimes), "migration"),
        per_stream,
        per_host,
    ]
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report
