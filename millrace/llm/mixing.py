"""Mixing sources to target weights.

Every row gets a hash-random key. The rows of each source are sorted by range of that key, a prefix sum of
their sizes is computed over all ranges, and the source is cut where the sum reaches its budget. Where a
budget is larger than the source, the whole source is taken once or more and the cut is made in its last
round. A (source, range of keys) is the unit of work, so a source that holds a third of all rows is spread
over as many tasks as its rows fill.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import same, stored

WORD = r"[^\x20\x09-\x0D]+"
#: Rows in one range of keys, about.
RANGE_ROWS = 10_000
KEY_BITS = 60


def random_key(name: Column, seed: int = 0) -> Column:
    """A random number below ``2**KEY_BITS`` that depends on the name and the seed alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(name.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def words_in(text: str) -> Column:
    """The number of words of a text, 0 for a null one."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size) of every row."""
    return docs.select("doc_id", "source", words_in("text").alias("size"))


def numbered(rows: DataFrame, column: str, name: str) -> DataFrame:
    """The rows with their place (from 0) in the order of ``column``, null last.

    Range partitions are written once; a place is that inside the partition and the rows of those before.
    """
    order = F.col(column).asc_nulls_last()
    parts = stored(rows.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "ranges")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition.
    sums = parts.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy(order)
    placed = parts.join(sums, "part").withColumn(name, F.col("before") + F.row_number().over(inside) - 1)
    return placed.drop("part", "before")


def targets(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size): ``share`` of all sizes, split by weight.

    The sources in the order of their names, null last, have the ``weights``, which repeat. No target is
    above ``most`` times its source's size: what a source cannot take is shared among the others by weight
    until none is above. One total of the sources is made a round.
    """
    ranked = numbered(sources, "source", "rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    held = stored(
        ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("cap")),
        "sources",
    )
    total = held.agg(F.sum("source_size")).first()[0] or 0
    goal, rate, full = share * total, 0.0, -1
    while True:
        above = F.col("weight") * F.lit(rate) > F.col("cap")
        taken, rest, n = held.agg(
            F.sum(F.when(above, F.col("cap")).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))),
            F.count(F.when(above, 1)),
        ).first()
        if n == full or not rest:
            break
        # The first round has no source above: every target is its plain share.
        full, rate = n, (goal - taken) / rest
    plain = F.col("weight") * F.lit(rate)
    return held.select("source", "source_size", F.least("cap", plain).alias("target") if rest else F.col("cap").alias("target"))


def mixed(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 0,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every row: how many of its words the mix takes.

    The taken words of a source add up to its target, rounded to a whole word: all rows as often as the
    target holds the source, then the rows in the order of their keys, the last one in part. The result
    depends on the rows and the seed alone. Null and blank texts have size 0 and nothing is taken; null
    sources are one source; null ids are one name. Rows equal in id, source and size are counted first and
    share a key, so any number of copies costs one row of the sort; they are taken one after the other. Other
    columns are ignored; an empty table gives an empty result.
    """
    rows = stored(sized(docs).withColumn("key", random_key(F.col("doc_id"), seed)), "sizes")
    total = rows.count()
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = stored(targets(sources, weights, share, most), "targets")

    ranges = max(1, -(-total // range_rows))
    place = F.floor(F.col("key") / F.lit(float(1 << KEY_BITS)) * F.lit(ranges))
    entries = rows.groupBy("source", "key", "doc_id", "size").agg(F.count(F.lit(1)).alias("copies"))
    entries = entries.withColumn("range", place).withColumn("words", F.col("size") * F.col("copies"))

    sums = entries.groupBy("source", "range").agg(F.sum("words").alias("words"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "range", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("words"))
    # One row in front of each range holds what the ranges before it add up to.
    front = sums.select("source", "range", "words", F.lit(0).alias("turn"))
    both = entries.withColumn("turn", F.lit(1)).unionByName(front, allowMissingColumns=True)
    so_far = Window.partitionBy("source", "range").orderBy("turn", "key", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, -1
    )
    summed = both.withColumn("before", F.sum("words").over(so_far)).where("turn = 1")

    known = goal.withColumnRenamed("source", "named")
    budget = F.floor(F.col("target") + 0.5)
    rounds = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    last = budget - F.col("rounds") * F.col("source_size") - (F.col("before") + F.col("copy") * F.col("size"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), last))
    return (
        summed.join(known, same(F.col("source"), F.col("named")))
        .withColumn("rounds", rounds)
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        .select(
            "doc_id", "source", "size", "source_size", "target",
            (F.col("rounds") * F.col("size") + part).cast("long").alias("taken"),
        )
    )


def drawn(docs: DataFrame, mix: DataFrame) -> DataFrame:
    """The mixed rows: every row of ``docs`` once per round, with ``epoch`` and its text as far as it is taken.

    ``mix`` is the result of ``mixed``. A row that is cut keeps its first words, joined by one space; the rows
    of equal id, source and size are matched in the order of their texts and of what is taken of them.
    """
    names = ["doc_id", "source", "size"]
    held = docs.select(F.struct("*").alias("doc"), F.col("doc_id"), F.col("source"), words_in("text").alias("size"))
    a = held.withColumn("n", F.row_number().over(Window.partitionBy(*names).orderBy(F.xxhash64("doc.text"))))
    b = mix.select(*[F.col(c).alias(f"m_{c}") for c in names], "taken")
    b = b.withColumn("m_n", F.row_number().over(Window.partitionBy("m_doc_id", "m_source", "m_size").orderBy(F.desc("taken"))))
    match = F.col("n") == F.col("m_n")
    for c in names:
        match = match & same(F.col(c), F.col(f"m_{c}"))
    rounds = F.ceil(F.col("taken") / F.col("size"))
    epochs = a.join(b, match).where("taken > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), rounds)))
    words = F.least(F.col("size"), F.col("taken") - (F.col("epoch") - 1) * F.col("size"))
    cut = F.concat_ws(" ", F.slice(F.regexp_extract_all("doc.text", F.lit(WORD), F.lit(0)), F.lit(1), words.cast("int")))
    text = F.when(words < F.col("size"), cut).otherwise(F.col("doc.text"))
    fields = [text.alias("text") if c == "text" else F.col(f"doc.{c}").alias(c) for c in docs.columns]
    return epochs.select(*fields, F.col("epoch").alias("mix_epoch"))
