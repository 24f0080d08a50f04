"""Language-model scores from a log-frequency Bloom filter.

The filter holds n-grams (single words and word pairs) with quantised counts: an n-gram counted c
times is entered once for each level 1 .. 1 + floor(log2 c). A query probes level after level until
one is missing; the last level found gives the count back, within a factor of two and with a small
one-sided error from false positives. Smoothed probabilities come from these probes alone.

Building: training tokens are hashed and counted per batch, n-grams are dealt to segments by hash, and
each segment becomes a filter of its own, sized to what it holds: 8 bits an entry, whatever the corpus.
There are as many segments as the texts' bytes ask for. As many of them as ``MAX_FILTER_BYTES`` admits are
broadcast together. A filter beyond that is probed in several passes over the texts, a group of segments
each, and every token keeps the level it has found; the scores are the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import LOWER, kept_in_process, let_go, map_columns, shared_folder, stored

#: Documents whose id hashes to this remainder are held out.
HELD_OUT, PARTS = 2, 7
#: Bits of an entry in its 64-bit filter word.
PROBES = 4
#: Bits of the filter per entry.
BITS_PER_ENTRY = 8
#: Segments have a multiple of so many words.
WORD_STEP = 1 << 10
#: Bound of what is broadcast of the filter at a time.
MAX_FILTER_BYTES = 256 << 20
#: Bytes of text whose n-grams make a segment, about; there are 32 segments at least.
SEGMENT_TEXT_BYTES, LEAST_SEGMENTS = 32 << 20, 32
#: Words counted more often than (all tokens) / HEAVY_WORDS are broadcast with their exact count; there
#: can be no more than HEAVY_WORDS of them. All other words are looked up by a join.
HEAVY_WORDS = 1 << 20
#: Weights tried for the shorter n-gram in the smoothed probability of a word.
PRIORS = tuple(4.0**k for k in range(12))
#: Tokens that are counted at once.
PIECE_TOKENS = 1 << 19
#: Keys of a row on its way to a segment; an Arrow batch of 2000 such rows takes 24 MB.
ROW_KEYS = 1 << 10
#: Keys of a segment that are gathered, at least, before they are added up.
GATHERED_KEYS = 1 << 19
#: Keys that are entered into a filter at once.
ENTERED_KEYS = 1 << 18
#: Texts that are scored at once.
SCORE_ROWS = 200
#: The end of a text, counted as a token; no word holds a line end.
END = b"\n"

PAIR = 0x9E3779B97F4A7C15
LEVEL = 0xD1B54A32D192ED03


def mixed(x):
    """A 64-bit finaliser over an array of unsigned longs."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def token_hashes(text: str | None):
    """Hashes of the words of a text and of its end."""
    import numpy as np
    import xxhash

    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
    words.append(END)
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def pair_hashes(tokens):
    """Hashes of (word before, word) for every token; the first follows the end of a text."""
    import numpy as np

    before = np.concatenate([token_hashes(None), tokens[:-1]])
    return mixed(before * np.uint64(PAIR) + tokens)


def entry_places(keys, level: int, words):
    """Filter word and bit mask of the entries (key, level) in filters of ``words`` words."""
    import numpy as np

    h = mixed(keys + np.uint64(level * LEVEL & (2**64 - 1)))
    mask = np.zeros(len(keys), np.uint64)
    for i in range(PROBES):
        mask |= np.uint64(1) << ((h >> np.uint64(6 * i)) & np.uint64(63))
    return (h >> np.uint64(6 * PROBES)) % np.asarray(words, np.uint64), mask


def built(keys, counts):
    """Filter words that hold the keys with their quantised counts."""
    import numpy as np

    levels = np.floor(np.log2(counts)).astype(np.uint8) + np.uint8(1)
    entries = int(levels.sum(dtype=np.int64))
    words = max(1, -(-entries * BITS_PER_ENTRY // (64 * WORD_STEP))) * WORD_STEP
    bits = np.zeros(words, np.uint64)
    for i in range(0, len(keys), ENTERED_KEYS):
        some, up_to = keys[i : i + ENTERED_KEYS], levels[i : i + ENTERED_KEYS]
        for level in range(1, int(up_to.max()) + 1):
            at, mask = entry_places(some[up_to >= level], level, words)
            np.bitwise_or.at(bits, at.astype(np.int64), mask)
    return bits


class Filter:
    """Neighbouring segments of a filter, for probing: ``first`` and the following ones of ``parts``."""

    def __init__(self, packed: bytes, sizes: list[int], first: int = 0, parts: int | None = None):
        import numpy as np

        self.first, self.parts = first, parts or len(sizes)
        self.sizes = np.array(sizes, np.uint64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        # The bytes of the broadcast are used as they are; a worker holds them once.
        self.bits = np.frombuffer(packed, np.uint64)

    @staticmethod
    def packed(segments: dict[int, bytes], parts: range) -> tuple[bytes, list[int]]:
        """Segments in one piece with their sizes in words; a missing segment is an empty word."""
        rows = [segments.get(i) or bytes(8) for i in parts]
        return b"".join(rows), [len(r) // 8 for r in rows]

    def levels(self, keys):
        """The last level of each key: 0 for a key that is not there or belongs to another segment."""
        import numpy as np

        level = np.zeros(len(keys), np.uint8)
        part = (keys % np.uint64(self.parts)).astype(np.int64) - self.first
        alive, k = np.nonzero((part >= 0) & (part < len(self.sizes)))[0], 0
        while len(alive):
            k += 1
            p = part[alive]
            place, mask = entry_places(keys[alive], k, self.sizes[p])
            at = self.starts[p] + place.astype(np.int64)
            alive = alive[(self.bits[at] & mask) == mask]
            level[alive] = k
            if k >= 62:
                break
        return level

    def counts(self, keys):
        """Quantised counts: 0 for a key that is not there, else the middle of its level."""
        return count_of(self.levels(keys))


def count_of(levels):
    """The count that stands for a level: the middle of those that are cut to it."""
    import numpy as np

    return np.where(levels > 0, 1.5 * np.exp2(levels - 1.0) - 0.5, 0.0)


def added(pairs):
    """The sorted keys of some (keys, counts), each once, with their sums."""
    import numpy as np

    keys = np.concatenate([k for k, _ in pairs])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    counts = np.concatenate([c for _, c in pairs])[order]
    order = None
    first = np.flatnonzero(np.concatenate([np.ones(len(keys[:1]), bool), keys[1:] != keys[:-1]]))
    if not len(first):
        return keys, counts.astype(np.int64)
    return keys[first], np.add.reduceat(counts, first, dtype=np.int64)


def counted_texts(texts: list, parts: int) -> dict:
    """Rows of each segment (part, keys, counts, words): the words and pairs of the texts, each once, words first.

    Texts are counted some ``PIECE_TOKENS`` at a time and added up segment by segment, so beside the keys
    themselves only the arrays of a piece are held. A row has at most ``ROW_KEYS`` keys, ``words`` of them words.
    """
    import numpy as np

    out = {"part": [], "keys": [], "counts": [], "words": []}
    held, piece, n = ([], []), ([], []), 0
    for i, text in enumerate(texts, 1):
        tokens = token_hashes(text)
        piece[0].append(tokens)
        piece[1].append(pair_hashes(tokens))
        n += len(tokens)
        if n < PIECE_TOKENS and i < len(texts):
            continue
        for kind, arrays in zip(held, piece):
            keys, counts = np.unique(np.concatenate(arrays), return_counts=True)
            arrays.clear()
            where = (keys % np.uint64(parts)).astype(np.int64)
            order = np.argsort(where, kind="stable")
            edges = np.searchsorted(where[order], np.arange(parts + 1))
            kind.append((keys[order], counts[order].astype("<u4"), edges))
        n = 0
    if not texts:
        return out
    for p in range(parts):
        cut = [added([(k[e[p] : e[p + 1]], c[e[p] : e[p + 1]]) for k, c, e in kind]) for kind in held]
        keys = np.concatenate([k for k, _ in cut])
        counts = np.concatenate([c for _, c in cut]).astype("<u4")
        for i in range(0, len(keys), ROW_KEYS):
            out["part"].append(p)
            out["keys"].append(keys[i : i + ROW_KEYS].tobytes())
            out["counts"].append(counts[i : i + ROW_KEYS].tobytes())
            out["words"].append(min(max(len(cut[0][0]) - i, 0), ROW_KEYS))
    return out


def gathered(rows):
    """(part, words and counts, pairs and counts) of every segment, from rows (part, keys, counts, words) sorted by segment.

    One segment is held at a time, and what it has gathered is added up whenever it has grown by half.
    """
    import numpy as np

    now, sets, n, limit = None, ([], []), 0, GATHERED_KEYS
    for part, keys, counts, words in rows:
        if part != now:
            if now is not None:
                yield now, added(sets[0]), added(sets[1])
            now, sets, n, limit = part, ([], []), 0, GATHERED_KEYS
        k, c = np.frombuffer(keys, np.uint64), np.frombuffer(counts, "<u4")
        sets[0].append((k[:words], c[:words]))
        sets[1].append((k[words:], c[words:]))
        n += len(k)
        if n > limit:
            for held in sets:
                held[:] = [added(held)]
            n = sum(len(held[0][0]) for held in sets)
            limit = n + max(GATHERED_KEYS, n // 2)
    if now is not None:
        yield now, added(sets[0]), added(sets[1])


def counted(docs: DataFrame, parts: int) -> DataFrame:
    """(part, words, word_counts, n_entries, bits): exact word counts and the filter of every segment.

    N-grams are counted within a batch first, so a frequent one reaches its segment as one number per
    batch. They travel as packed numbers in rows of bounded size, so an Arrow batch of them is bounded as well.
    """
    schema = "part int, keys binary, counts binary, words int"

    def count_batch(_, texts):
        # No task probes while texts are counted; a worker may still hold the model of an earlier run.
        let_go("language model")
        return counted_texts(texts, parts)

    def build(batches):
        import numpy as np
        import pyarrow as pa

        def rows():
            for batch in batches:
                columns = [batch.column(c) for c in ("part", "keys", "counts", "words")]
                for i in range(batch.num_rows):
                    yield [c[i].as_py() for c in columns]

        # Rows come sorted by segment.
        for part, (wk, wc), (pk, pc) in gathered(rows()):
            bits = built(np.concatenate([wk, pk]), np.concatenate([wc, pc]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([wk.view(np.int64)], pa.list_(pa.int64())),
                    pa.array([wc], pa.list_(pa.int64())),
                    pa.array([bits.tobytes()], pa.binary()),
                ],
                names=["part", "words", "word_counts", "bits"],
            )

    batches = map_columns(docs, ["text"], count_batch, schema)
    dealt = batches.repartition(parts, "part").sortWithinPartitions("part")
    return dealt.mapInArrow(build, "part int, words array<long>, word_counts array<long>, bits binary")


class Model:
    """Broadcast parts of the model, as used in a task."""

    def __init__(self, filled: Filter, tokens, distinct, heavy):
        import numpy as np

        self.filter = filled
        self.tokens, self.distinct = tokens, distinct
        order = np.argsort(heavy[0], kind="stable") if len(heavy[0]) else np.zeros(0, np.int64)
        self.heavy, self.heavy_counts = heavy[0][order], heavy[1][order]

    def heavy_count(self, keys):
        """Exact counts of frequent words, -1 for all others."""
        import numpy as np

        if not len(self.heavy):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(self.heavy, keys), len(self.heavy) - 1)
        return np.where(self.heavy[at] == keys, self.heavy_counts[at], -1)

    def levels(self, tokens, pairs):
        """Levels of every token and of every pair with the word before."""
        import numpy as np

        words, back = np.unique(tokens, return_inverse=True)
        return self.filter.levels(words)[back], self.filter.levels(pairs)

    def log_probability(self, levels, ends, prior: float, leave_out: int = 0):
        """log10 of the smoothed probability of every token after the one before it.

        ``levels`` are those of texts one after the other, the last token of each at ``ends`` - 1. The word
        before a first one is the end of a text, which is the last of every text. ``leave_out`` 1 takes one
        occurrence away from each count, as for a text that was trained on.
        """
        import numpy as np

        single, both = (count_of(v) for v in levels)
        last = np.concatenate([single[ends[0] - 1 : ends[0]], single[:-1]])
        both = np.minimum(both, np.minimum(single, last))
        single, last, both = (np.maximum(c - leave_out, 0.0) for c in (single, last, both))
        alone = (single + 1.0) / (self.tokens + self.distinct + 1.0)
        return np.log10((both + prior * alone) / (last + prior))


class Texts:
    """A few texts as arrays: their tokens one after the other, where each ends, and their levels."""

    def __init__(self, model: Model, texts: list, levels: list | None):
        import numpy as np

        parts = [token_hashes(t) for t in texts]
        self.sizes = np.array([len(t) for t in parts])
        self.ends = np.cumsum(self.sizes)
        self.tokens = np.concatenate(parts)
        if levels is None:
            self.levels = model.levels(self.tokens, np.concatenate([pair_hashes(t) for t in parts]))
        else:
            held = [np.frombuffer(v, np.uint8).reshape(2, -1) for v in levels]
            self.levels = tuple(np.concatenate([h[i] for h in held]) for i in (0, 1))


def with_levels(rows: DataFrame, tool) -> DataFrame:
    """The rows with ``levels`` raised to what one group of segments says: a byte a token and a byte a pair."""

    def step(model, ids, flags, texts, before):
        import numpy as np

        out = []
        for text, known in zip(texts, before):
            tokens = token_hashes(text)
            levels = np.stack(model.levels(tokens, pair_hashes(tokens)))
            if known is not None:
                levels = np.maximum(levels, np.frombuffer(known, np.uint8).reshape(2, -1))
            out.append(levels.tobytes())
        return {"doc_id": ids, "held_out": flags, "text": texts, "levels": out}

    columns = ["doc_id", "held_out", "text", "levels"]
    return map_columns(rows, columns, step, "doc_id long, held_out boolean, text string, levels binary", tool)


def chosen_prior(training: DataFrame, tool) -> float:
    """The weight of PRIORS that gives the training rows (text, levels) the highest leave-one-out score."""

    def step(model, texts, levels):
        import numpy as np

        sums = np.zeros(len(PRIORS))
        for i in range(0, len(texts), SCORE_ROWS):
            part = levels[i : i + SCORE_ROWS]
            read = Texts(model, texts[i : i + SCORE_ROWS], None if part[0] is None else part)
            sums += [model.log_probability(read.levels, read.ends, p, 1).sum() for p in PRIORS]
        return {"prior": list(PRIORS), "score": sums.tolist()} if texts else {"prior": [], "score": []}

    tried = map_columns(training, ["text", "levels"], step, "prior double, score double", tool)
    sums = tried.groupBy("prior").agg(F.sum("score").alias("score")).collect()
    return max(sums, key=lambda r: (r["score"], r["prior"]))["prior"] if sums else PRIORS[0]


def groups_of(sizes: dict[int, int], parts: int, most: int) -> list[range]:
    """Neighbouring segments that hold at most ``most`` bytes together; a larger one stands alone."""
    out, start, held = [], 0, 0
    for i in range(parts):
        size = sizes.get(i, 8)
        if i > start and held + size > most:
            out.append(range(start, i))
            start, held = i, 0
        held += size
    return [*out, range(start, parts)]


def scored(docs: DataFrame, max_filter_bytes: int = MAX_FILTER_BYTES, heavy_words: int = HEAVY_WORDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``.

    ``docs`` has (doc_id, text); other columns are ignored. Null and empty texts have one token, their
    end. A null doc_id counts as the empty text in the split (it trains). Rows that repeat count and
    are scored each. An empty table gives an empty result; with no training row every count is zero.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    part = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % PARTS
    rows = docs.select("doc_id", "text", (part == HELD_OUT).alias("held_out"))
    training = rows.where("not held_out")
    text_bytes = training.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(LEAST_SEGMENTS, -(-text_bytes // SEGMENT_TEXT_BYTES))
    segments = stored(counted(training, parts), "lm-segments")
    counts = segments.select(F.explode(F.arrays_zip("words", "word_counts")).alias("w")).select(
        F.col("w.words").alias("word"), F.col("w.word_counts").alias("c")
    )
    total, distinct = counts.agg(F.sum("c"), F.count("*")).first()
    total = total or 0
    # The pigeonhole bounds the frequent words. The driver gets one size a segment, and the filter by groups.
    heavy = counts.where(F.col("c") * heavy_words > total)
    sizes = {r[0]: r[1] for r in segments.select("part", F.octet_length("bits")).collect()}
    frequent = heavy.toArrow()
    words, numbers = (frequent.column(c).to_numpy().astype("int64") for c in ("word", "c"))

    def tool_of(group: range):
        held = segments.where(F.col("part").between(group.start, group.stop - 1)).select("part", "bits")
        packed, lengths = Filter.packed({r[0]: bytes(r[1]) for r in held.toLocalIterator()}, group)
        shared = sc.broadcast((packed, lengths, words, numbers))
        name = shared_folder(spark, "lm-model")

        def tool():
            import numpy as np

            def make():
                filled, in_words, keys, values = shared.value
                probed = Filter(filled, in_words, group.start, parts)
                return Model(probed, total, distinct, (keys.view(np.uint64), values))

            return kept_in_process("language model", name, make)

        return tool

    groups = groups_of(sizes, parts, max_filter_bytes)
    rows = rows.withColumn("levels", F.lit(None).cast("binary"))
    for group in groups:
        tool = tool_of(group)
        if len(groups) > 1:
            rows = stored(with_levels(rows, tool), "lm-levels")
    prior = chosen_prior(rows.where("not held_out"), tool)

    def step(model, ids, ranks, flags, texts, levels):
        out = {"rank": ranks, "doc_id": ids, "held_out": flags}
        out |= {c: [] for c in ("n_tokens", "n_known", "heavy_score", "score", "rest")}
        # A few texts at a time, which bounds the arrays beside the filter.
        for i in range(0, len(texts), SCORE_ROWS):
            part = levels[i : i + SCORE_ROWS]
            for c, values in scored_texts(model, texts[i : i + SCORE_ROWS], None if part[0] is None else part).items():
                out[c] += values
        return out

    def scored_texts(model, texts, levels):
        import numpy as np

        read = Texts(model, texts, levels)
        flat, sizes, ends = read.tokens, read.sizes, read.ends
        out = {"n_tokens": sizes.tolist()}
        owner = np.repeat(np.arange(len(sizes)), sizes)
        logs = model.log_probability(read.levels, ends, prior)
        words, back = np.unique(flat, return_inverse=True)
        exact = model.heavy_count(words)[back]
        known = exact >= 0
        base = np.where(known, np.log10((np.maximum(exact, 0) + 1.0) / (total + distinct + 1.0)), 0.0)
        out["n_known"] = np.bincount(owner[known], minlength=len(sizes)).tolist()
        out["heavy_score"] = np.bincount(owner, weights=base, minlength=len(sizes)).tolist()
        out["score"] = np.bincount(owner, weights=logs, minlength=len(sizes)).tolist()
        rest = [flat[e - n : e][~known[e - n : e]] for e, n in zip(ends, sizes)]
        out["rest"] = [r.view(np.int64) for r in rest]
        return out

    numbered = rows.select(F.monotonically_increasing_id().alias("rank"), "doc_id", "held_out", "text", "levels")
    schema = (
        "rank long, doc_id long, held_out boolean, n_tokens long, n_known long, heavy_score double, score double, "
        "rest array<long>"
    )
    passed = map_columns(numbered, ["doc_id", "rank", "held_out", "text", "levels"], step, schema, tool)
    # The document itself and each of its rare words travel in one stream, so texts are read once. The
    # key of a document row is its number, which spreads these rows and matches no word.
    kinds = F.concat(
        F.array(F.struct(F.lit(0).alias("kind"), F.col("rank").alias("word"))),
        F.transform("rest", lambda w: F.struct(F.lit(1).alias("kind"), w.alias("word"))),
    )
    doc = ("doc_id", "held_out", "n_tokens", "n_known", "heavy_score", "score")
    stream = passed.select("rank", *doc, F.explode(kinds).alias("at")).select(
        "rank", F.col("at.kind").alias("kind"), F.col("at.word").alias("word"),
        *[F.when(F.col("at.kind") == 0, F.col(c)).alias(c) for c in doc],
    )
    found = stream.join(counts.withColumn("kind", F.lit(1)), ["kind", "word"], "left")
    floor = F.lit(float(total + distinct + 1))
    rare = F.when(F.col("kind") == 1, F.log10((F.coalesce("c", F.lit(0)) + 1) / floor))
    known = F.when(F.col("kind") == 1, (F.coalesce("c", F.lit(0)) > 0).cast("long"))
    return (
        found.withColumns({"rare": rare, "known": known})
        .groupBy("rank")
        .agg(
            *[F.max(c).alias(c) for c in doc],
            F.coalesce(F.sum("rare"), F.lit(0.0)).alias("rare"),
            F.coalesce(F.sum("known"), F.lit(0)).alias("known"),
        )
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("n_known") + F.col("known")).alias("n_known"),
            F.lit(total).cast("long").alias("train_tokens"),
            (F.col("heavy_score") + F.col("rare")).alias("base_score"),
            "score",
        )
    )
