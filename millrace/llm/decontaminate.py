"""Benchmark decontamination with one Aho-Corasick automaton.

Test items are normalised (A-Z lower-cased, words of letters and digits) and cut into windows of ten
words; the automaton holds every window, and each document is scanned once in its normalised form.
Word numbers lead from a match back to the original text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import kept_in_process, map_columns

WINDOW = 10
#: UTF-8 bytes of test text in one automaton; more items go in further passes over the documents.
PASS_BYTES = 16 << 20

# Word bytes are 0-9, a-z and all bytes beyond ASCII; A-Z is lower-cased, the rest parts words.
NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(NORMAL).split() if text else []


def windows(words: list[bytes], size: int = WINDOW) -> set[bytes]:
    """The distinct windows of an item; a short item is one window, an item without words has none."""
    if not words:
        return set()
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def automaton(items: list[tuple[int | None, str | None]], size: int = WINDOW):
    """Automaton over blank-bounded windows; each ends in (window words, ids of its items)."""
    import ahocorasick

    owners: dict[bytes, set] = {}
    for item, text in items:
        for w in windows(words_of(text), size):
            owners.setdefault(w, set()).add(item)
    found = ahocorasick.Automaton()
    for w, ids in owners.items():
        found.add_word(f" {w.decode('latin-1')} ", (w.count(b" ") + 1, tuple(ids)))
    if owners:
        found.make_automaton()
    return found


def scan(found, text: str | None) -> tuple[int, list[tuple]]:
    """Number of words, and (item, first word, last word) of every occurrence of a window."""
    import numpy as np

    words = words_of(text)
    if not words or not len(found):
        return len(words), []
    line = b" " + b" ".join(words) + b" "
    matches = list(found.iter(line.decode("latin-1")))
    if not matches:
        return len(words), []
    ends = np.nonzero(np.frombuffer(line, np.uint8) == 32)[0]
    out = []
    for at, (size, ids) in matches:
        last = int(np.searchsorted(ends, at)) - 1
        out += [(i, last - size + 1, last) for i in ids]
    return len(words), out


def original_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code-point offsets (end exclusive) in the original text of runs of words (first, last)."""
    import re

    places = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    return [(places[a][0], places[b][1]) for a, b in runs]


def merged_runs(hits: list[tuple]) -> list[tuple[int, int]]:
    """Runs of hit words: overlapping or adjoining windows are joined."""
    out: list[list[int]] = []
    for first, last in sorted({(h[1], h[2]) for h in hits}):
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return [(a, b) for a, b in out]


def automata(spark: SparkSession, items: DataFrame, size: int, pass_bytes: int) -> Callable[[], list]:
    """A function that gives a task its automata; they are built once per worker from broadcast items.

    The test set is the stated query set. Its size is checked, and it is broadcast in blocks of about
    ``pass_bytes``, each with an automaton of its own.
    """
    known = items.select("item_id", "text").where("text is not null").distinct()
    total = known.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = max(1, -(-total // pass_bytes))
    number = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    held = []
    for k in range(blocks):
        rows = known.where(number == k).select("item_id", "text").toLocalIterator()
        held.append((uuid.uuid4().hex, spark.sparkContext.broadcast([tuple(r) for r in rows])))

    def tools():
        return [
            kept_in_process(f"automaton {k}", name, lambda b=b: automaton(b.value, size))
            for k, (name, b) in enumerate(held)
        ]

    return tools


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, item_list, spans, contaminated) of every row of ``docs``.

    ``docs`` has (doc_id, text), ``items`` (item_id, text); other columns are ignored. ``items`` are
    the distinct ids of items with a window in the document, ``spans`` the hit passages as code-point
    offsets in the original text. Null texts have no words. An item without words matches nothing; an
    item with a null id is an item named by the empty string. Rows that repeat give equal rows; items
    that repeat an id count once. Empty tables are fine on either side.

    A scan over several automata merges their hits.
    """
    tools = automata(docs.sparkSession, items, size, pass_bytes)

    def step(tools, ids, texts):
        out = {"doc_id": ids, "n_words": [], "n_hit": [], "items": [], "spans": []}
        for text in texts:
            hits = []
            for found in tools:
                n, more = scan(found, text)
                hits += more
            runs = merged_runs(hits)
            out["n_words"].append(n)
            out["n_hit"].append(sum(b - a + 1 for a, b in runs))
            out["items"].append(sorted({"" if h[0] is None else str(h[0]) for h in hits}))
            spans = original_spans(text, runs) if runs else []
            out["spans"].append([{"start": a, "end": b} for a, b in spans])
        return out

    schema = (
        "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start: long, end: long>>"
    )
    rows = map_columns(docs, ["doc_id", "text"], step, schema, tools)
    return rows.withColumns(
        {
            "n_items": F.size("items").cast("long"),
            "item_list": F.array_join("items", ","),
            "contaminated": F.col("n_hit") > 0,
        }
    )


def clean(docs: DataFrame, items: DataFrame, size: int = WINDOW, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The rows of ``docs`` without a window of any item, with all their columns; nothing is shuffled."""
    tools = automata(docs.sparkSession, items, size, pass_bytes)

    @F.pandas_udf("boolean")
    def hit(text: pd.Series) -> pd.Series:
        found = tools()
        return pd.Series([any(scan(f, t)[1] for f in found) for t in text], dtype="bool")

    return docs.where(~hit(docs["text"]))
