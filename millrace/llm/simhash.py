"""SimHash near-duplicates by anchor-point covering.

A fingerprint is one or more 64-bit SimHash words. Each word is cut into two blocks of 32 bits.
The anchors of a block are the code words of a covering code on 32 bits: the perfect Hamming code
on 31 bits, which has covering radius 1, with one free bit. So every block lies within 1 of exactly
one nearest anchor, and 2**27 anchors spread the fingerprints.

Two fingerprints that differ in at most ``t`` bits differ in at most ``t // blocks`` bits in some
block. Each class is held under its nearest anchor and replicated to every anchor within covering
radius plus that block threshold; classes that meet under an anchor are compared on the whole
fingerprint. For one word and ``t = 3`` the block threshold is 1: 17 anchors a block, and no link
within the threshold is missed.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import repeat

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import LOWER, components, map_columns, same, stored

BLOCK_BITS = 32
RADIUS = 1
#: Classes of one anchor that are compared in one task; larger anchors are cut into pairs of parts.
ANCHOR_PART = 4096


def fingerprint_words(text: str | None, shingle: int, words: int) -> list[int]:
    """SimHash words of a text as signed 64-bit numbers; a text without words has zeros.

    The features are all shingles of ``shingle`` words, repeats included.
    """
    import numpy as np
    import xxhash

    tokens = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
    if not tokens:
        return [0] * words
    n = max(1, len(tokens) - shingle + 1)
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
    out = []
    for k in range(words):
        grams = (
            iter([b" ".join(tokens)]) if len(tokens) < shingle
            else map(b" ".join, zip(*[tokens[i:] for i in range(shingle)]))
        )
        h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42 + k)), np.uint64, n)
        parts = h.view(np.uint8).reshape(n, 8)
        ones = np.concatenate([np.bincount(parts[:, i], minlength=256) @ bits for i in range(8)])
        out.append(int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0]))
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, words: int = 1, also: Sequence[str] = ()) -> DataFrame:
    """(doc_id, fp) of every row and the columns ``also``; ``fp`` is an array of ``words`` longs. Null text counts as empty."""

    def step(_, ids, texts, *more):
        prints = [fingerprint_words(t, shingle, words) for t in texts]
        return {"doc_id": ids, "fp": prints} | dict(zip(also, more))

    kinds = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in also)
    return map_columns(docs, ["doc_id", "text", *also], step, f"doc_id long, fp array<long>{kinds}")


def anchors_in_reach(block):
    """All anchors within covering radius + 1 of each 32-bit block: (n, 17) code words, the nearest first.

    Where a block is itself a code word it has two of them only; the other places repeat the nearest.
    """
    import numpy as np

    one, places = np.uint64(1), np.arange(1, BLOCK_BITS, dtype=np.uint64)
    # The syndrome is the number of the bit to flip to reach the nearest code word of the low 31 bits.
    syndrome = np.zeros(len(block), np.uint64)
    for j in range(5):
        check = np.uint64(sum(1 << (i - 1) for i in range(1, BLOCK_BITS) if i >> j & 1))
        syndrome |= (np.bitwise_count(block & check).astype(np.uint64) & one) << np.uint64(j)
    # For a syndrome s, the code words two flips away differ in bits i and i xor s; each pair once.
    single = np.concatenate([[np.uint64(0)], one << (places - one)])
    pairs = np.zeros((BLOCK_BITS, 15), np.uint64)
    for s in range(1, BLOCK_BITS):
        found = [single[i] | single[i ^ s] for i in range(1, BLOCK_BITS) if i < i ^ s]
        # The pair that holds bit s itself would need bit 0: it is the nearest code word and not listed.
        pairs[s] = found[:15]
    nearest = block ^ single[syndrome.astype(np.int64)]
    two = block[:, None] ^ pairs[syndrome.astype(np.int64)]
    two[syndrome == 0] = nearest[syndrome == 0, None]
    return np.concatenate([nearest[:, None], (nearest ^ (one << np.uint64(BLOCK_BITS - 1)))[:, None], two], axis=1)


def placed(classes: DataFrame, words: int, homes_only: bool = False) -> DataFrame:
    """(anchor, home, rep, w0..): every class (rep, fp) under all anchors in reach of each block.

    The number of the block is part of the anchor; ``home`` is 1 under the nearest anchor.
    """
    fields = ", ".join(f"w{i} long" for i in range(words))
    names = ["anchor", "home", "rep", *[f"w{i}" for i in range(words)]]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            rep = batch.column("rep").to_numpy()
            fp = np.stack([batch.column(f"w{i}").to_numpy() for i in range(words)], axis=1)
            for at in range(0, len(rep), 2000):
                for i in range(2 * words):
                    part, mine = fp[at : at + 2000], rep[at : at + 2000]
                    word = part[:, i // 2].view(np.uint64) if words == 1 else part[:, i // 2].copy().view(np.uint64)
                    block = word >> np.uint64(BLOCK_BITS) if i % 2 else word & np.uint64(2**BLOCK_BITS - 1)
                    keys = anchors_in_reach(block)
                    home = np.zeros(keys.shape, np.int8)
                    home[:, 0] = 1
                    used = keys != keys[:, :1]
                    used[:, 0] = True
                    if homes_only:
                        used &= home == 1
                    row = np.nonzero(used)[0]
                    out = [(keys[used] + np.uint64(i << BLOCK_BITS)).view(np.int64), home[used], mine[row]]
                    out += [np.ascontiguousarray(part[row, j]) for j in range(words)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=names)

    flat = classes.select("rep", *[F.col("fp")[i].alias(f"w{i}") for i in range(words)])
    return flat.mapInArrow(run, f"anchor long, home byte, rep long, {fields}")


def spanning(links: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """A minimum spanning forest of links (a, b, distance): as connected, and fewer than its nodes."""
    root: dict[int, int] = {}

    def find(x):
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = root[x]
        return x

    out = []
    for link in sorted(links, key=lambda x: x[2]):
        a, b = find(link[0]), find(link[1])
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append(link)
    return out


def compare_per_anchor(rows: DataFrame, words: int, threshold: int) -> DataFrame:
    """(a, b, distance): links between classes that share an anchor, thinned to a spanning forest.

    ``rows`` has (anchor, part, home, rep, w0..). The rows of an anchor part arrive one after the other,
    home rows first. All others are compared with these as they stream by, which finds each link; a
    task holds the home rows of one part, one batch, and the forest of the links so far. A group of n
    classes so sends on fewer than n links and loses no connection.
    """
    columns = ["anchor", "part", "home", "rep", *[f"w{i}" for i in range(words)]]

    def against(home, fp, rep, hrep, hfp, within=True):
        """Links of rows with home rows; two home rows ``within`` one batch are compared once."""
        import numpy as np

        out = []
        for i in range(len(hrep)):
            d = np.bitwise_count(fp ^ hfp[i]).sum(axis=1, dtype=np.int64)
            hit = np.nonzero((d <= threshold) & (rep != hrep[i]) & ((home == 0) | (rep > hrep[i]) | (not within)))[0]
            out += zip([int(hrep[i])] * len(hit), rep[hit].tolist(), d[hit].tolist())
        return out

    def run(batches):
        import numpy as np
        import pyarrow as pa

        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("distance", pa.int32())])

        def packed(links):
            return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*links)], names=schema.names).cast(schema)

        # The run that may go on in the next batch: its key, home rows and links.
        key, hrep, hfp, links = None, None, None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor, part, home, rep, *w = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
            fp = np.stack(w, axis=1).view(np.uint64)
            change = np.nonzero((np.diff(anchor) != 0) | (np.diff(part) != 0))[0] + 1
            edges = np.concatenate([[0], change, [len(rep)]])
            homes = np.add.reduceat(home.astype(np.int64), edges[:-1])
            sizes = np.diff(edges)
            out = []
            first, last = 0, len(sizes) - 1
            for k in dict.fromkeys((first, last)):
                # First and last run of the batch: they may belong to a longer one.
                a, b = edges[k], edges[k + 1]
                now = (int(anchor[a]), int(part[a]))
                if now != key:
                    out += spanning(links)
                    key, hrep, hfp, links = now, rep[:0], fp[:0], []
                own = home[a:b] == 1
                links += against(home[a:b], fp[a:b], rep[a:b], hrep, hfp, within=False)
                links += against(home[a:b], fp[a:b], rep[a:b], rep[a:b][own], fp[a:b][own])
                hrep, hfp = np.concatenate([hrep, rep[a:b][own]]), np.concatenate([hfp, fp[a:b][own]])
                if len(links) > 100_000:
                    links = spanning(links)
            inner = np.zeros(len(sizes), bool)
            inner[1:-1] = True
            # One home row: every other row of the run is held against it, all runs at once.
            lone = np.nonzero(inner & (homes == 1) & (sizes > 1))[0]
            if len(lone):
                row = np.concatenate([np.arange(edges[k] + 1, edges[k + 1]) for k in lone])
                at = np.repeat(edges[lone], sizes[lone] - 1)
                d = np.bitwise_count(fp[row] ^ fp[at]).sum(axis=1, dtype=np.int64)
                hit = d <= threshold
                out += zip(rep[at[hit]].tolist(), rep[row[hit]].tolist(), d[hit].tolist())
            for k in np.nonzero(inner & (homes > 1))[0].tolist():
                a, b = edges[k], edges[k + 1]
                n = a + homes[k]
                out += spanning(against(home[a:b], fp[a:b], rep[a:b], rep[a:n], fp[a:n]))
            if out:
                yield packed(out)
        if links:
            yield packed(spanning(links))

    return (
        rows.select(*columns)
        .repartition("anchor", "part")
        .sortWithinPartitions("anchor", "part", F.desc("home"))
        .mapInArrow(run, "a long, b long, distance int")
    )


def class_links(classes: DataFrame, words: int, threshold: int, part: int = ANCHOR_PART) -> DataFrame:
    """Links between fingerprint classes (rep, fp) at ``threshold`` or fewer differing bits.

    With fewer than ``4 * words`` bits allowed every pair is found; beyond that a pair is found if some
    block differs in at most one bit.
    """
    # Anchors that are home to very many classes: their home rows are cut into parts, each of which
    # all rows of the anchor go to, so that no task holds them whole.
    large = (
        placed(classes, words, homes_only=True)
        .groupBy("anchor")
        .count()
        .where(F.col("count") > part)
        .select("anchor", F.ceil(F.col("count") / part).cast("int").alias("parts"))
    )
    large = stored(large, "large-anchors")
    rows = placed(classes, words)
    if large.isEmpty():
        cut = rows.withColumn("part", F.lit(0))
    else:
        mine = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
        targets = F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(
            F.sequence(F.lit(0), F.col("parts") - 1)
        )
        cut = (
            rows.join(large, "anchor", "left")
            .withColumn("mine", mine)
            .withColumn("part", F.explode(targets))
            .withColumn("home", F.when(F.coalesce(F.col("mine") == F.col("part"), F.lit(True)), F.col("home")).otherwise(F.lit(0)).cast("byte"))
        )
    return compare_per_anchor(cut, words, threshold)


def near_duplicates(
    docs: DataFrame, shingle: int = 3, words: int = 1, threshold: int = 3, also: Sequence[str] = ()
) -> DataFrame:
    """(doc_id, fp, also.., component_id): classes of documents linked by near-equal SimHash fingerprints.

    ``docs`` has (doc_id, text) and the columns named in ``also``, which are carried through; others are
    ignored. Equal fingerprints form one class before anything is compared, so copies are never paired;
    rows that repeat a doc_id stay rows of their own. A null doc_id takes its class's component (null if
    all its class has none). Null or blank texts have fingerprint zero and link like any other. An empty
    table gives an empty result.
    """
    prints = stored(fingerprints(docs, shingle, words, also), "fingerprints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    known = stored(classes.where("rep is not null"), "classes")
    merged = components(class_links(known, words, threshold).select("a", "b").distinct())
    named = classes.join(merged, F.col("rep") == F.col("node"), "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id")
    )
    return prints.join(named, "fp").select("doc_id", "fp", *also, "component_id")


def one_of_each(docs: DataFrame, shingle: int = 3, threshold: int = 3) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of every component the row with the smallest doc_id.

    Rows are told apart by doc_id and text. Of repeated rows, and of a class whose ids are all null, one
    stays. All columns are passed on, also those whose names clash with ones used inside.
    """
    text_key = F.xxhash64("text")
    found = near_duplicates(
        docs.select("doc_id", "text", text_key.alias("text_key")), shingle, 1, threshold, ["text_key"]
    )
    # A class without any id has no component; its fingerprint names it.
    group = ["component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("lone")]
    rows = found.select(*group, "doc_id", "text_key")
    rows = stored(rows.groupBy("component_id", "lone", "doc_id", "text_key").count(), "rows")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    first = rows.groupBy("component_id", "lone").agg(F.min(order).alias("first"))
    # A null component equals no other; such rows are compared with the groups of null components alone.
    match = same(rows["component_id"], first["component_id"]) & same(rows["lone"], first["lone"])
    judged = rows.join(first, match).select(
        rows["doc_id"], rows["text_key"], "count",
        (same(F.col("first.doc_id"), rows["doc_id"]) & (F.col("first.text_key") == rows["text_key"])).alias("stays"),
    )
    judged = stored(judged.where("not stays or `count` > 1"), "judged")

    held = docs.select(F.struct("*").alias("doc"), text_key.alias("held_key"))

    def joined(other: DataFrame, how: str) -> DataFrame:
        return held.join(other, same(F.col("doc.doc_id"), other["doc_id"]) & (F.col("held_key") == other["text_key"]), how)

    kept = joined(judged, "left_anti")
    repeated = judged.where("stays")
    if not repeated.isEmpty():
        kept = kept.unionByName(
            joined(repeated, "left_semi").groupBy(F.col("doc.doc_id").alias("i"), "held_key").agg(F.first("doc").alias("doc")).select("doc", "held_key")
        )
    return kept.select("doc.*")
