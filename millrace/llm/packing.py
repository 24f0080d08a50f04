"""Best-fit packing of tokenised documents by non-negative least squares over length patterns.

Only the histogram of piece lengths (at most 1024 numbers) reaches the driver. Patterns of one to
three lengths that fill a sequence exactly are enumerated, their repeat counts are fitted to the
histogram by non-negative least squares, rounded down to what the histogram holds, and the residual
lengths are packed best-fit, longest first. The plan is a short list of runs "the r-th to s-th piece
of length n goes to sequence q + rank at offset o"; the pieces are ranked within their length and
joined to it.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import kept_in_process, map_columns, stored

CAPACITY = 1024
END_ID = 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Steps of the least-squares fit.
FIT_STEPS = 400


class Encoder:
    """Token ids of a text, as the tokenizers file gives them.

    The rank file of the same vocabulary is several times faster; texts that hold the string of a
    special token, or that it cannot handle, go to the tokenizers library.
    """

    def __init__(self, name: str = "byte_bpe_50k"):
        import base64
        import os

        import public_tokenizers
        import tiktoken

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding(
            name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.path = public_tokenizers.path(f"{name}.json")
        self.exact = None

    def slow(self, text: str):
        import numpy as np
        from tokenizers import Tokenizer

        if self.exact is None:
            self.exact = Tokenizer.from_file(self.path)
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)

    def __call__(self, text: str):
        if "<|endoftext|>" in text:
            return self.slow(text)
        try:
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
        except BaseException as e:  # the library panics on some very long runs of blanks
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return self.slow(text)


def pieces_of(ids, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``ids``; only the first may be shorter than the capacity."""
    n = len(ids)
    first = n % capacity or min(n, capacity)
    if n <= capacity:
        return [(0, n)]
    return [(0, first), *[(s, capacity) for s in range(first, n, capacity)]]


def token_pieces(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of every document; a null text is empty and has the end id alone."""

    def step(encode, ids, texts):
        import zlib

        import numpy as np

        out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
        end = np.array([END_ID], "<u4")
        for doc, text in zip(ids, texts):
            tokens = np.concatenate([encode(text), end]).astype("<u4", copy=False) if text else end
            for i, (start, length) in enumerate(pieces_of(tokens, capacity)):
                row = (doc, i, start, length, zlib.crc32(tokens[start : start + length].tobytes()))
                for k, v in zip(out, row):
                    out[k].append(v)
        return out

    return map_columns(docs, ["doc_id", "text"], step, PIECES, lambda: kept_in_process("encoder", "byte_bpe_50k", Encoder))


def patterns(capacity: int):
    """All multisets of two or three lengths that sum to the capacity, as three index columns (0: none)."""
    import numpy as np

    half = np.arange(1, capacity // 2 + 1)
    pairs = np.stack([capacity - half, half, np.zeros_like(half)], axis=1)
    b, c = np.meshgrid(np.arange(1, capacity // 2 + 1), np.arange(1, capacity // 3 + 1), indexing="ij")
    a = capacity - b - c
    ok = (a >= b) & (b >= c)
    return np.concatenate([pairs, np.stack([a[ok], b[ok], c[ok]], axis=1)])


def fitted(histogram, chosen, capacity: int, steps: int = FIT_STEPS):
    """Non-negative repeat counts x of the patterns: least squares of (histogram - A x) weighted by length.

    Projected gradient with momentum; A has at most three ones in a column, so A x and its transpose
    are sums by index.
    """
    import numpy as np

    weight = np.zeros(capacity + 1)
    weight[1:] = np.arange(1, capacity + 1) / capacity + 0.1
    use = histogram[chosen]
    possible = ((chosen == 0) | (use > 0)).all(axis=1)
    cols = chosen[possible]
    x = np.zeros(len(chosen))
    if not len(cols):
        return x
    load = np.bincount(cols.ravel(), minlength=capacity + 1)
    rate = 1.0 / (3.0 * max(1, load[1:].max()))
    y = prev = np.zeros(len(cols))
    for k in range(steps):
        made = np.zeros(capacity + 1)
        for j in range(3):
            made += np.bincount(cols[:, j], weights=y, minlength=capacity + 1)
        rest = (histogram - made) * weight
        rest[0] = 0
        step = np.maximum(0.0, y + rate * rest[cols].sum(axis=1))
        y = np.maximum(0.0, step + (k / (k + 3)) * (step - prev))
        prev = step
    x[possible] = prev
    return x


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, end rank, sequence of the first, offset) that place every piece."""
    import numpy as np

    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    taken = np.zeros(capacity + 1, np.int64)
    runs: list[tuple[int, int, int, int, int]] = []
    sequence = 0

    def place(length: int, n: int, first: int, offset: int) -> None:
        runs.append((length, int(taken[length]), int(taken[length]) + n, first, offset))
        taken[length] += n
        left[length] -= n

    if left[capacity]:
        n = int(left[capacity])
        place(capacity, n, 0, 0)
        sequence += n
    chosen = patterns(capacity)
    repeat = np.floor(fitted(left.astype(float), chosen, capacity) + 1e-6).astype(np.int64)
    for k in np.argsort(-repeat, kind="stable").tolist():
        if not repeat[k]:
            break
        lengths = [int(v) for v in chosen[k] if v]
        n = min([int(repeat[k]), *[int(left[v]) // lengths.count(v) for v in set(lengths)]])
        if n <= 0:
            continue
        offset = 0
        for v in lengths:
            place(v, n, sequence, offset)
            offset += v
        sequence += n
    # Best fit for what is left, longest first, on groups of sequences with equal free space.
    free: list[int] = []
    groups: dict[int, list[tuple[int, int]]] = {}

    def open_group(space: int, first: int, n: int) -> None:
        if space not in groups:
            bisect.insort(free, space)
            groups[space] = []
        groups[space].append((first, n))

    for length in range(capacity, 0, -1):
        while left[length]:
            at = bisect.bisect_left(free, length)
            if at == len(free):
                # New sequences: each takes as many pieces of this length as fit.
                per = capacity // length
                n = int(left[length])
                whole = n // per
                for count, size in ((whole, per), (1 if n % per else 0, n % per)):
                    if count:
                        for j in range(size):
                            place(length, count, sequence, j * length)
                        if capacity - size * length:
                            open_group(capacity - size * length, sequence, count)
                        sequence += count
                continue
            space = free[at]
            first, n = groups[space].pop()
            if not groups[space]:
                del groups[space], free[at]
            use = min(n, int(left[length]))
            place(length, use, first, capacity - space)
            if space - length:
                open_group(space - length, first, use)
            if n > use:
                open_group(space, first + use, n - use)
    return runs


def packed(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece and its place.

    ``docs`` has (doc_id, text); other columns are ignored. Documents longer than the capacity are cut
    into whole sequences and a shorter first piece. Null and empty texts are one token. Rows that
    repeat are packed each; equal pieces may change places. A null doc_id is kept. An empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    pieces = stored(token_pieces(docs, capacity), "pieces")
    counts = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}
    runs = spark.createDataFrame(
        plan(counts, capacity) or [],
        "run_length long, first long, end long, sequence long, offset long",
    )
    # Rank within the length: position in a salted part plus the sizes of the earlier parts, so that a
    # length that very many pieces share is ranked in many tasks.
    salts = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")
    sizes = sizes.select("length", "salt", before.alias("before"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("at", F.row_number().over(order) - 1).join(sizes, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("at"))
    # The plan has at most a few runs per pattern and length: a bound that does not grow with the data.
    placed = ranked.join(
        F.broadcast(runs),
        (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")),
    )
    return placed.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"),
        "offset",
    )
