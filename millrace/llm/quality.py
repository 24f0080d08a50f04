"""Quality rules with host-level verdicts.

Every document is measured and put to a few rules. The failures are added up by host, the failure
rate of each host is shrunk towards the corpus by a beta prior fitted to all hosts, and a host whose
shrunken rate is too high is rejected with all its documents. A host with few documents stays close
to the prior, so it is not rejected for one bad page.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_columns, same, stored

MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
)
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Rules beyond the base: symbols per word, share of repeated lines, mean word length.
MAX_SYMBOL_PERCENT = 20
MAX_DUP_LINE_PERCENT = 50
WORD_LENGTH = (2, 15)
#: A host is rejected when its shrunken failure rate is above this.
MAX_HOST_RATE = 0.6


def measure_text(text: str | None) -> tuple[int, int, int, int, int, int]:
    """Counts of one text, in the order of MEASURES; a null text has none."""
    import numpy as np

    if not text:
        return (0, 0, 0, 0, 0, 0)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    blanks = len(raw) - len(raw.translate(None, b" \t\n\x0b\x0c\r"))
    symbols = len(raw) - len(raw.translate(None, b"#*$%&|<>"))
    seen, lines, repeats = set(), 0, 0
    for line in raw.split(b"\n"):
        if line.strip():
            lines += 1
            repeats += line in seen
            seen.add(line)
    covered = 0
    n = len(words)
    if n > 3:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
        size = len(number)
        # Pairs are renumbered before the third word is added, so the key stays below n squared.
        pair = np.unique(ids[:-1] * size + ids[1:], return_inverse=True)[1]
        window = pair[:-1] * size + ids[2:]
        _, back, count = np.unique(window, return_inverse=True, return_counts=True)
        twice = count[back] > 1
        hit = np.zeros(n, bool)
        for k in range(3):
            hit[k : n - 2 + k] |= twice
        covered = int(hit.sum())
    return (n, len(text) - blanks, symbols, lines, repeats, covered)


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, source, measures) of every row."""
    names = [m.split()[0] for m in MEASURES.split(", ")]

    def step(_, ids, hosts, texts):
        rows = [measure_text(t) for t in texts]
        cols = list(zip(*rows)) if rows else [()] * len(names)
        return {"doc_id": ids, "source": hosts, **{n: list(c) for n, c in zip(names, cols)}}

    return map_columns(docs, ["doc_id", "source", "text"], step, f"doc_id long, source string, {MEASURES}")


def base_failed() -> Column:
    few = F.col("n_words") < MIN_WORDS
    return few | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def rule_failed() -> Column:
    """Any rule failed: the base or one of the further ones."""
    words, lines = F.col("n_words"), F.col("n_lines")
    low, high = WORD_LENGTH
    return (
        base_failed()
        | (100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * words)
        | (100 * F.col("n_dup_lines") > MAX_DUP_LINE_PERCENT * lines)
        | (F.col("word_chars") < low * words)
        | (F.col("word_chars") > high * words)
    )


def host_verdicts(failures: DataFrame) -> DataFrame:
    """(source, docs, failed, rate, rejected) per host from (source, failed).

    The prior is beta(mean * s, (1 - mean) * s). Its mean is the corpus failure rate and its strength
    s follows by moments: the spread of host rates beyond what binomial noise explains. No excess
    spread means a strong prior (all hosts alike). The moments are one row of sums; the hosts are
    aggregated before they are shuffled, so a host with a third of all rows is no hot spot.
    """
    hosts = failures.groupBy("source").agg(
        F.count("*").alias("docs"), F.sum(F.col("failed").cast("long")).alias("failed")
    )
    total = hosts.agg(
        F.sum("docs").alias("n"),
        F.sum("failed").alias("k"),
        F.count("*").alias("h"),
        F.sum(F.col("docs") * F.col("docs")).alias("n2"),
        F.sum(F.col("failed") * F.col("failed") / F.col("docs")).alias("k2"),
    )
    mean = F.col("k") / F.col("n")
    noise = mean * (1 - mean)
    # Weighted variance of host rates, its expectation under equal rates, and the excess.
    spread = F.col("k2") - F.col("k") * mean
    excess = (spread - noise * (F.col("h") - 1)) / (F.col("n") - F.col("n2") / F.col("n"))
    strength = F.when((noise > 0) & (excess > 0), F.greatest(noise / excess - 1, F.lit(1.0))).otherwise(F.lit(1e6))
    size = F.when(F.col("h") > 1, F.least(strength, F.lit(1e6))).otherwise(F.lit(1e6))
    # One row of moments, as a scalar subquery.
    prior = total.select(F.struct(mean.alias("mean"), size.alias("s"))).scalar()
    weight = F.col("prior.s")
    rate = (F.col("failed") + F.col("prior.mean") * weight) / (F.col("docs") + weight)
    return (
        hosts.withColumn("prior", prior)
        .withColumn("rate", rate)
        .select("source", "docs", "failed", "rate", (F.col("rate") > MAX_HOST_RATE).alias("rejected"))
    )


def rejected_hosts(failures: DataFrame) -> DataFrame:
    """(host) of the rejected hosts.

    The table is written first, so that its size is known when it is joined: a small one is broadcast
    and the documents stay where they are; only a large one makes them move.
    """
    bad = host_verdicts(failures).where("rejected").select(F.col("source").alias("host"))
    return stored(bad, "rejected-hosts")


def host_quality(docs: DataFrame) -> DataFrame:
    """(doc_id, source, measures, base_failed, rule_failed, host_rejected, kept) of every row.

    ``docs`` has (doc_id, source, text); other columns are ignored. A document is kept if it fails no
    rule and its host is not rejected. Null and empty texts have no words and fail the base. A null
    source is a host of its own. Rows that repeat are judged one by one and count each time. An empty
    table gives an empty result.
    """
    rows = stored(
        measured(docs).withColumns({"base_failed": base_failed(), "rule_failed": rule_failed()}), "measures"
    )
    bad = rejected_hosts(rows.select("source", F.col("rule_failed").alias("failed")))
    bad = bad.withColumn("host_rejected", F.lit(True))
    out = rows.join(bad, same(F.col("source"), F.col("host")), "left").drop("host")
    out = out.withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False)))
    return out.withColumn("kept", ~F.col("rule_failed") & ~F.col("host_rejected"))


def passing(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``host_quality`` keeps, with all their columns.

    Texts are measured again here rather than sent through a shuffle; only the rejected hosts are joined.
    """
    names = [m.split()[0] for m in MEASURES.split(", ")]

    @F.pandas_udf(MEASURES)
    def measures(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure_text(t) for t in text], columns=names, dtype="int64")

    held = docs.select(F.struct("*").alias("doc"))
    judged = held.withColumn("m", measures("doc.text")).select("doc", "m.*")
    judged = judged.select("doc", F.col("doc.source").alias("source"), rule_failed().alias("failed"))
    bad = rejected_hosts(judged.select("source", "failed"))
    kept = judged.where("not failed").join(bad, same(F.col("source"), F.col("host")), "left_anti")
    return kept.select("doc.*")
