"""SimHash near-duplicates against brute force over all pairs."""

import random

import numpy as np
import xxhash
from llm_tables import documents, odd  # noqa: F401
from millrace.llm import simhash
from millrace.llm.common import components


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    root = {i: i for i in range(len(prints))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_fingerprints_and_components_match_brute_force(documents):
    rng = random.Random(1)
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(200)) for _ in range(12)]
    texts = []
    for b in base:
        texts.append(b)
        for _ in range(6):
            words = b.split(" ")
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = "Zz"
            texts.append(" ".join(words))
    texts += ["", None, "one", "ONE", "two words", " \n"]
    out = {r[0]: (r[1][0] % 2**64, r[2]) for r in simhash.near_duplicates(documents(texts)).collect()}
    prints = [plain_fingerprint(t) for t in texts]
    assert [out[i][0] for i in range(len(texts))] == prints
    assert [out[i][1] for i in range(len(texts))] == plain_components(prints)


def test_links_within_three_bits_are_all_found_also_in_cut_anchors(spark):
    rng = np.random.default_rng(3)
    fps = [int(x) for x in rng.integers(0, 2**63, 40)]
    for f in fps[:20]:
        for _ in range(4):
            bits = rng.choice(64, rng.integers(0, 5), replace=False)
            fps.append(f ^ sum(1 << int(b) for b in bits))
    fps = sorted({f - 2**64 if f >= 2**63 else f for f in fps})
    rows = spark.createDataFrame([(i, [f]) for i, f in enumerate(fps)], "rep long, fp array<long>")
    expected = plain_components([f % 2**64 for f in fps])
    for part in (4096, 2):
        links = simhash.class_links(rows, 1, 3, part=part)
        got = {r[0]: r[1] for r in components(links.select("a", "b")).collect()}
        assert [got.get(i, i) for i in range(len(fps))] == expected


def test_anchors_are_code_words_within_reach():
    rng = np.random.default_rng(8)
    blocks = np.concatenate([[0, 1, 2**31, 2**32 - 1], rng.integers(0, 2**32, 200)]).astype(np.uint64)
    for b, anchors in zip(blocks.tolist(), simhash.anchors_in_reach(blocks).tolist()):
        reach = set(anchors)
        assert len(reach) in (2, 17)
        assert (anchors[0] ^ b).bit_count() <= simhash.RADIUS
        assert all((a ^ b).bit_count() <= simhash.RADIUS + 1 for a in reach)
        # Any block one bit away has its nearest anchor among them.
        near = np.array([b ^ 1 << i for i in range(32)], np.uint64)
        assert set(simhash.anchors_in_reach(near)[:, 0].tolist()) <= reach


def test_a_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(5000, i) for i in range(4000, 4400)], "a long, b long")
    out = {r[0]: r[1] for r in components(links).collect()}
    assert all(out[i] == 0 for i in range(301))
    assert all(out[i] == 4000 for i in [*range(4000, 4400), 5000])


def test_odd_rows_and_empty_table(odd, spark):
    out = simhash.near_duplicates(odd).collect()
    assert len(out) == 10
    empty_ids = sorted(r["doc_id"] for r in out if r["fp"] == [0] and r["doc_id"] is not None)
    assert empty_ids[:3] == [0, 1, 2]
    assert all(r["component_id"] is not None for r in out)
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_home_rows_of_one_anchor_meet_across_batches(spark):
    rng = np.random.default_rng(11)
    high = [int(x) for x in rng.integers(0, 2**31, 30)]
    # Pairs that differ in three bits of one block only, so they meet under the anchor of the other block.
    fps = [(h << 32) | 77 for h in high] + [((h ^ 0b111) << 32) | 77 for h in high]
    rows = spark.createDataFrame([(60 - i, [f]) for i, f in enumerate(fps)], "rep long, fp array<long>").repartition(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        found = {tuple(sorted(r[:2])) for r in simhash.class_links(rows, 1, 3).select("a", "b").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == {(30 - i, 60 - i) for i in range(30)}


def test_one_row_of_each_component_stays(documents):
    rng = random.Random(3)
    base = [" ".join(f"g{g}w{rng.randrange(10**6)}" for _ in range(300)) for g in range(8)]
    texts = [t if k % 2 else t.replace(t.split(" ")[100 + k], "z") for t in base for k in range(5)]
    # Null ids, a repeated row, and one id on two different texts.
    texts += ["alone without id " + "q " * 40] * 2 + [texts[3], "its own text " + "r s t " * 30]
    ids = [*range(40), None, None, 3, 3]
    docs = documents(texts, ids=ids)
    expected = plain_components([plain_fingerprint(t) for t in texts])
    out = simhash.one_of_each(docs)
    assert out.columns == docs.columns
    rows = out.select("doc_id", "text").collect()
    place = {}
    for i, t in enumerate(texts):
        place.setdefault(t, expected[i])
    assert sorted(place[r["text"]] for r in rows) == sorted(set(expected))
    for r in rows:
        ids_there = [i for i, c in zip(ids, expected) if c == place[r["text"]] and i is not None]
        assert r["doc_id"] == (min(ids_there) if ids_there else None)
    assert simhash.one_of_each(docs.limit(0)).count() == 0


def test_rows_that_share_one_id_or_none_are_judged_by_their_text(odd):
    # Null, empty and blank texts are one class; of equal texts one stays.
    out = simhash.one_of_each(odd).select("text").collect()
    prints = [plain_fingerprint(r["text"]) for r in odd.select("text").collect()]
    assert len(out) == len(set(plain_components(prints)))
