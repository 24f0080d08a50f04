"""Readers of delimited text; each takes a DataFrame with a ``value`` column, table or stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.scalars import WHITESPACE, parse_order_time
from millrace.schemas import ORDER_FIELDS, TRADE_FIELDS

MIN_FIELDS = 10


def _records(lines: DataFrame, column: str) -> DataFrame:
    """Split lines; marker lines and short lines are dropped."""
    parts = lines.withColumn("__f", F.split(column, r"\|"))
    return parts.filter((F.col(column) != "end") & (F.size("__f") >= MIN_FIELDS))


def _field(fields: dict[str, int], name: str) -> Column:
    return F.get("__f", F.lit(fields[name]))


def parse_orders(lines: DataFrame, column: str = "value") -> DataFrame:
    """Typed orders keyed by security, with their event time."""
    f = lambda name: _field(ORDER_FIELDS, name)
    return _records(lines, column).select(
        f("sec_code").alias("key"),
        f("order_no").alias("order_no"),
        f("tran_maint_code").alias("tran_maint_code"),
        f("order_price").try_cast("double").alias("order_price"),
        f("order_exec_vol").try_cast("double").cast("int").alias("order_exec_vol"),
        f("order_vol").try_cast("double").cast("int").alias("order_vol"),
        f("sec_code").alias("sec_code"),
        f("trade_dir").alias("trade_dir"),
        parse_order_time(f("order_date"), f("order_time"), f("order_time_fraction")).alias("ts"),
    )


def parse_trades(lines: DataFrame, column: str = "value") -> DataFrame:
    """Typed trades keyed by security."""
    f = lambda name: _field(TRADE_FIELDS, name)
    when = F.concat(f("trade_date"), F.lit(" "), f("trade_time"))
    return _records(lines, column).select(
        f("sec_code").alias("key"),
        f("trade_no").alias("trade_no"),
        f("order_no").alias("order_no"),
        f("trade_price").try_cast("double").alias("trade_price"),
        f("trade_amt").try_cast("double").alias("trade_amt"),
        f("trade_vol").try_cast("bigint").alias("trade_vol"),
        f("sec_code").alias("sec_code"),
        f("acct_id").alias("acct_id"),
        f("trade_dir").alias("trade_dir"),
        F.try_to_timestamp(when, F.lit("yyyyMMdd HH:mm:ss")).alias("ts"),
    )


def load_opening_book(spark: SparkSession, path: str) -> DataFrame:
    """Orders from ``<path>/<security>/<side file>``; the first letter of the file is the side.

    A folder per side, as ``write_opening_book`` makes it, is read as well. The result has the columns of ``parse_orders``; a security or side without a file has no rows.
    """
    lines = (
        spark.read.option("recursiveFileLookup", "true").text(path).withColumn("__path", F.col("_metadata.file_path"))
    )
    fields = lines.withColumn("__f", F.split("value", r"\|")).filter(F.size("__f") > ORDER_FIELDS["trade_dir"])
    f = lambda name: _field(ORDER_FIELDS, name)
    in_folders = r"sec_code=([^/]+)/trade_dir=([^/])[^/]*/[^/]+$"
    in_files = r"([^/]+)/([^/])[^/]*$"

    def place(group: int) -> Column:
        named = F.regexp_extract("__path", in_folders, group)
        return F.when(named != "", named).otherwise(F.regexp_extract("__path", in_files, group))

    return fields.select(
        place(1).alias("sec_code"),
        place(2).alias("trade_dir"),
        f("order_no").alias("order_no"),
        f("tran_maint_code").alias("tran_maint_code"),
        f("order_price").try_cast("double").alias("order_price"),
        f("order_vol").try_cast("double").cast("int").alias("order_vol"),
        parse_order_time(f("order_date"), f("order_time"), f("order_time_fraction")).alias("ts"),
    )


def write_opening_book(orders: DataFrame, path: str) -> None:
    """One folder of order lines per security and side; the fields stand where ``load_opening_book`` looks."""
    text = {
        "order_date": F.date_format("ts", "yyyyMMdd"),
        "order_time": F.date_format("ts", "HH:mm:ss"),
        "order_time_fraction": F.format_string("0.%06d", F.unix_micros("ts") % 1_000_000),
    }
    places = {n: i for n, i in ORDER_FIELDS.items()}
    named = {i: text.get(n, F.col(n) if n in orders.columns else F.lit("")) for n, i in places.items()}
    parts = [F.coalesce(named.get(i, F.lit("")).cast("string"), F.lit("")) for i in range(max(named) + 1)]
    lines = orders.select("sec_code", "trade_dir", F.concat_ws("|", *parts).alias("value"))
    lines.repartition("sec_code", "trade_dir").write.partitionBy("sec_code", "trade_dir").text(path)


def book_levels(orders: DataFrame) -> DataFrame:
    """Opening orders grouped by price."""
    return orders.groupBy("sec_code", "trade_dir", "order_price").agg(
        F.sum("order_vol").cast("bigint").alias("volume"), F.count(F.lit(1)).alias("orders")
    )


def load_markov_model(lines: DataFrame, line_no: str = "line_no", column: str = "value") -> DataFrame:
    """A header line of states and one line of probabilities per state, as (from, to, p).

    ``line_no`` counts from 0. A row whose width differs from the header fails the query.
    """
    split = lines.select(F.col(line_no).alias("line_no"), F.split(column, ",").alias("items"))
    # A model has one line per state, so all its lines fit a window; the header is the first.
    whole = Window.partitionBy(F.lit(1))
    header = F.max(F.when(F.col("line_no") == 0, F.col("items"))).over(whole)
    headers = F.sum((F.col("line_no") == 0).cast("int")).over(whole)
    one = F.when(headers == 1, header).otherwise(F.raise_error(F.lit("a model has one header line")))
    rows = split.withColumn("states", one).filter(F.col("line_no") > 0)
    cells = F.when(F.size("items") == F.size("states"), F.arrays_zip("states", "items")).otherwise(
        F.raise_error(F.lit("row width differs from the number of states"))
    )
    return rows.select("line_no", "states", F.posexplode(cells).alias("to_no", "cell")).select(
        (F.col("line_no") - 1).alias("from_no"),
        F.element_at("states", F.col("line_no").cast("int")).alias("from_state"),
        F.col("to_no"),
        F.col("cell.states").alias("to_state"),
        F.col("cell.items").cast("double").alias("p"),
    )


def number_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of one small text file with their number, read as a single record."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "value")).filter(
        F.col("value") != ""
    )


def load_lexicon(lines: DataFrame, line_no: str = "line_no", column: str = "value") -> DataFrame:
    """Tab-separated word and score; trimmed, blank lines skipped, the last entry of a word wins."""
    blank = F.lit(WHITESPACE)
    # Blank fields are tabs among other white space, so trimming drops them: a trimmed line begins and ends with a
    # field that is not blank. Trimmed once per row: as a generated column, so that the filter does not do it again.
    trimmed = F.explode(F.array(F.trim(F.col(column), blank)))
    rows = lines.select(F.col(line_no).alias("n"), trimmed.alias("line")).filter(F.contains("line", F.lit("\t")))
    rest = F.ltrim(F.substr("line", F.instr("line", "\t") + 1), blank)
    fields = rows.select("n", F.rtrim(F.substring_index("line", "\t", 1), blank).alias("word"), rest.alias("rest"))
    score = F.rtrim(F.substring_index("rest", "\t", 1), blank).cast("int")
    return fields.groupBy("word").agg(F.max_by(score, "n").alias("score"))
