"""Column expressions; each takes and returns a Column and stays inside generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The six groups of a wiki edit line.
WIKI_LINE = r"\[\[(.*)\]\]\s(.*)\s(.*)\s\*\s(.*)\s\*\s\(\+?(.\d*)\)\s(.*)"
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
#: The characters that ``\s`` stands for in a regular expression.
WHITESPACE = " \t\n\x0b\f\r"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SPACES = "\t\n\x0b\x0c\r \x85\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2008\u2009\u200a\u2028\u2029\u205f\u3000"


def split_tokens(text: Column, pattern: str = " ") -> Column:
    """Split on a regular expression and drop the empty tokens at the end of the list."""
    parts = F.split(text, pattern)
    last_full = F.array_position(F.transform(F.reverse(parts), lambda x: x != ""), True)
    kept = F.when(last_full == 0, 0).otherwise(F.size(parts) - last_full + 1)
    # An empty input is one empty token, as it has nothing to split.
    return F.when((F.element_at(parts, -1) != "") | (text == ""), parts).otherwise(
        F.slice(parts, F.lit(1), kept.cast("int"))
    )


def trim_token(token: Column) -> Column:
    """Surrounding whitespace of any kind removed."""
    return F.btrim(token, F.lit(SPACES))


def clean_text(text: Column) -> Column:
    """ASCII punctuation and newlines become spaces; the rest is lowered."""
    marks = PUNCTUATION + "\n"
    return F.lower(F.translate(text, marks, " " * len(marks)))


WIKI_PARTS = ("title", "flags", "diff_url", "user", "byte_diff", "summary")


def parse_wiki_line(raw: Column) -> Column:
    """The six parts of an edit line as an array, or null where the line does not match.

    The expression is matched once and its groups are split apart; a line that already holds
    the separator is matched group by group.
    """
    mark = "\x1e"
    marked = mark + mark.join(f"${i}" for i in range(1, 7))
    once = F.split(F.regexp_replace(raw, r"\A[\s\S]*?" + WIKI_LINE + r"[\s\S]*\z", marked), mark)
    fast = F.filter(F.array(once), lambda parts: F.size(parts) == 7)
    fast = F.slice(F.get(fast, F.lit(0)), 2, 6)
    slow = F.when(raw.rlike(WIKI_LINE), F.array(*[F.regexp_extract(raw, WIKI_LINE, i) for i in range(1, 7)]))
    return F.when(F.contains(raw, F.lit(mark)), slow).otherwise(fast)


def wiki_flags(title: Column, flags: Column) -> Column:
    """Map of flag name to whether the edit carries it."""
    return F.create_map(
        F.lit("is-minor"), F.contains(flags, F.lit("M")),
        F.lit("is-new"), F.contains(flags, F.lit("N")),
        F.lit("is-unpatrolled"), F.contains(flags, F.lit("!")),
        F.lit("is-bot-edit"), F.contains(flags, F.lit("B")),
        F.lit("is-special"), F.startswith(title, F.lit("Special:")),
        F.lit("is-talk"), F.startswith(title, F.lit("Talk:")),
    )


WIKI_FLAG_NAMES = ("is-minor", "is-new", "is-unpatrolled", "is-bot-edit", "is-special", "is-talk")


def parse_tweet_time(text: Column) -> Column:
    """``Mon Jan 01 10:00:00 +0000 2024`` as a timestamp; the weekday name is not needed."""
    shape = r"^\w{3} (\w{3}) (\d{2}) (\d{2}:\d{2}:\d{2}) ([+-]\d{2})(\d{2}) (\d{4})$"
    part = [F.regexp_extract(text, shape, i) for i in range(7)]
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), part[1])
    iso = F.concat(
        part[6], F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), part[2], F.lit(" "),
        part[3], part[4], F.lit(":"), part[5],
    )
    return F.try_to_timestamp(iso, F.lit("yyyy-MM-dd HH:mm:ssXXX"))


def parse_order_time(date: Column, time: Column, fraction: Column) -> Column:
    """Fields ``yyyyMMdd``, ``HH:mm:ss`` and ``0.fraction``; the time is kept to the millisecond."""
    millis = F.substring(F.element_at(F.split(fraction, r"\."), 2), 1, 3)
    return F.try_to_timestamp(F.concat(date, F.lit(" "), time, F.lit(","), millis), F.lit("yyyyMMdd HH:mm:ss,SSS"))


def time_to_int(time: Column) -> Column:
    """``09:25:00`` becomes 92500."""
    return F.translate(time, ":", "").cast("int")


def text_to_map(text: Column, item_delim: str = "&", key_delim: str = ":") -> Column:
    return F.str_to_map(text, F.lit(item_delim), F.lit(key_delim))


def normalize_ws(text: Column) -> Column:
    """Lower case with every whitespace run as one space; none is left at the end."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"\s+$", ""), r"\s+", " ")


def _split_fields(text: Column, delim: str) -> Column:
    return split_tokens(text, delim)


def remove_fields(text: Column, ordinals: Sequence[int], delim: str = ",") -> Column:
    gone = [F.lit(i) for i in ordinals]
    return F.array_join(F.filter(_split_fields(text, delim), lambda x, i: ~i.isin(*gone)), delim)


def keep_fields(text: Column, ordinals: Sequence[int], delim: str = ",", sort: bool = False) -> Column:
    parts = _split_fields(text, delim)
    kept = F.array(*[F.get(parts, F.lit(i)) for i in ordinals])
    return F.array_join(F.array_sort(kept) if sort else kept, delim)


def remove_items(items: Column, removed: Column) -> Column:
    """Items that are not in ``removed``; duplicates stay and so does the order."""
    return F.filter(items, lambda x: ~F.array_contains(removed, x))


def parse_num_array(text: Column, kind: str = "int", delim: str = ",") -> Column:
    return F.transform(_split_fields(text, delim), lambda x: x.cast(kind))


def join_list(items: Column, delim: str = ",") -> Column:
    return F.array_join(items, delim)


def is_integer(text: Column) -> Column:
    return F.coalesce(text.rlike("^-?[0-9]+$"), F.lit(False))


# Names of the element types a typed field may have.
FIELD_TYPES = {
    "byte": "tinyint",
    "boolean": "boolean",
    "int": "int",
    "long": "bigint",
    "float": "float",
    "double": "double",
    "string": "string",
    "bytes": "binary",
}


def typed_cast(text: Column, kind: str) -> Column:
    """Parse text as one of the field types; text that does not parse gives null."""
    return text.try_cast(FIELD_TYPES[kind])


def prefix_key(fields: Sequence[Column], length: int) -> Column:
    """The first ``length`` fields as one ordered, comparable struct."""
    return F.struct(*[f.alias(f"f{i}") for i, f in enumerate(fields[:length])])


def prefix_hash(fields: Sequence[Column], length: int) -> Column:
    return F.xxhash64(*fields[:length])


def tuple_compare(left: Column, right: Column) -> Column:
    """-1, 0 or 1 for two structs of the same shape, field by field."""
    return F.when(left < right, -1).when(left > right, 1).otherwise(0)


def squared_distance(
    price: Column, volume: Column, center_price: Column, center_volume: Column, compat_linear_vol: bool = False
) -> Column:
    """Squared distance; ``compat_linear_vol`` adds the volume difference unsquared."""
    d_price, d_volume = price - center_price, volume - center_volume
    return d_price * d_price + (d_volume if compat_linear_vol else d_volume * d_volume)


def uniform_int(low: int, high: int, seed: int) -> Column:
    """A random integer between both ends, ends included."""
    return (F.lit(low) + F.floor(F.rand(seed) * (high - low + 1))).cast("int")


def uniform_double(low: float, high: float, seed: int) -> Column:
    """A random double from ``low`` up to, but not including, ``high + 1``."""
    return F.lit(low) + F.rand(seed) * (high - low + 1)


def blank_to_null(text: Column) -> Column:
    return F.when(F.trim(F.regexp_replace(text, r"\s", " ")) != "", text)
