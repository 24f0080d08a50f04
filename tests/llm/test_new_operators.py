"""Whitening, mixing and periodic runs against brute force."""

import hashlib
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
from llm_tables import documents, odd  # noqa: F401
from millrace.llm import mixing, periodic, queries, whitening


# Periodic runs


def plain_runs(words, least=12):
    """All maximal stretches of every period, without those that have a smaller one."""
    n, found = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i < n - p:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j < n - p and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(least, 2 * p) and (i, j + p - i) not in found:
                found[i, j + p - i] = p
            i = j
    return sorted((s, length, p) for (s, length), p in found.items())


def word_sequences():
    rng = random.Random(5)
    for letters in (1, 2, 2, 3, 5):
        for n in (0, 1, 11, 12, 40, 97, 160):
            yield [rng.choice("abcdefg"[:letters]) for _ in range(n)]
    for _ in range(60):
        words = []
        while len(words) < 150:
            block = [rng.choice("abcd") for _ in range(rng.randint(1, 30))]
            words += (block * 6)[: rng.randint(1, 5 * len(block))] + [rng.choice("abxyz")]
        yield words
    a, b = "a", "ab"
    for _ in range(7):
        a, b = b, b + a
        yield list(b)
    yield list("abababaabababab" * 3)
    yield list("a" * 50 + "b" + "a" * 50 + "b" + "a" * 50)


def test_runs_match_brute_force():
    for words in word_sequences():
        assert periodic.text_runs(words) == plain_runs(words), "".join(words)
        assert periodic.text_runs(words, 2) == plain_runs(words, 2), "".join(words)


def test_words_appended_in_pieces_give_the_same_runs():
    words = [1, 2, 3] * 9 + [4] + [1, 2] * 20 + [5] * 13
    pieces = periodic.SquareCatcher()
    for i in range(0, len(words), 7):
        pieces.append(words[i : i + 7])
    assert pieces.runs() == plain_runs(words)


@pytest.mark.parametrize("text", ["a " * 100_000, "a b c " * 30_000, ("a " * 3000 + "b ") * 30, "x y " * 20_000 + "z " + "x y " * 20_000])
def test_very_long_repeats_take_no_square_time(text):
    words, begin = text.split(), time.perf_counter()
    runs = periodic.text_runs(words)
    assert runs and time.perf_counter() - begin < 30


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_row(doc, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc).encode())
    if doc is not None and h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    dropped = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    milli = 1000 * best[1] // best[2] if runs else None
    lines = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc, len(runs), *best, milli, digest(lines), digest(kept))


def test_the_query_matches_brute_force(spark, documents, tmp_path):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 90))) for _ in range(60)]
    texts += [None, "", " \t\n", "é ü " * 14, "x\x0by\x0c" * 12]
    docs = documents(texts)
    docs.coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.QUERIES["op13_periodic_runs"](spark, str(tmp_path))
    got = {r[0]: tuple(r) for r in out.collect()}
    assert got == {i: plain_row(i, t) for i, t in enumerate(texts)}
    assert any(r[1] and zlib.crc32(str(i).encode()) % 10 == 0 for i, r in got.items())
    assert [t for _, t in out.dtypes] == ["bigint"] * 6 + ["string"] * 2


def test_periodic_runs_of_odd_rows(odd):
    out = periodic.periodic_runs(odd).collect()
    assert len(out) == 10 and sum(len(r["runs"]) for r in out) == 1
    long = next(r for r in out if r["runs"])
    assert tuple(long["runs"][0]) == (0, 60_000, 3) and long["collapsed"] == "lorem ipsum dolor"
    assert periodic.periodic_runs(odd.limit(0)).count() == 0


# Mixing


def plain_targets(sizes, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None), key=str.encode) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    goal, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = sum(weight[s] for s in names if s not in full)
        rate = (goal - sum(2 * sizes[s] for s in full)) / rest if rest else 0
        more = {s for s in names if s not in full and weight[s] * rate > 2 * sizes[s]}
        if not more:
            return {s: 2 * sizes[s] if s in full else weight[s] * rate for s in names}
        full |= more


def mixture_rows():
    rng = random.Random(2)
    texts = ["w " * rng.randint(0, 40) for _ in range(400)]
    sources = [rng.choice(["a", "hot", "hot", "hot", "z", "é", "\U0001f600", "", None, ""]) for _ in texts]
    texts += ["only " * 3, "w " * 5000]
    sources += ["small", "long"]
    return texts, sources


@pytest.mark.parametrize("range_rows", [7, 50_000])
def test_every_source_is_cut_at_its_budget(documents, range_rows):
    texts, sources = mixture_rows()
    ids = [*range(len(texts) - 40), *[3] * 20, *[None] * 20]
    rows = mixing.mixed(documents(texts, sources=sources, ids=ids), range_rows=range_rows).collect()
    sizes = defaultdict(int)
    for t, s in zip(texts, sources):
        sizes[s] += len(t.split())
    goal, taken = plain_targets(sizes), defaultdict(int)
    for r in rows:
        assert r["target"] == pytest.approx(goal[r["source"]], rel=1e-12) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(taken[s] == int(goal[s] + 0.5) for s in sizes)
    assert sorted(r["size"] for r in rows) == sorted(len(t.split()) for t in texts)
    # At most one row of a source is taken in part.
    parts = defaultdict(int)
    for r in rows:
        parts[r["source"]] += r["taken"] % r["size"] != 0 if r["size"] else 0
    assert max(parts.values()) <= 1


def test_cutting_into_ranges_and_partitions_changes_nothing(documents):
    texts, sources = mixture_rows()
    docs = documents(texts, sources=sources)
    first = sorted(map(tuple, mixing.mixed(docs, range_rows=11).collect()), key=repr)
    assert first == sorted(map(tuple, mixing.mixed(docs.repartition(7)).collect()), key=repr)
    assert first != sorted(map(tuple, mixing.mixed(docs, seed=1).collect()), key=repr)


def test_the_drawn_texts_hold_the_taken_words(documents):
    texts, sources = mixture_rows()
    docs = documents(texts, sources=sources)
    mix = mixing.mixed(docs)
    want = {r["doc_id"]: r["taken"] for r in mix.collect() if r["taken"]}
    got = defaultdict(int)
    for r in mixing.drawn(docs, mix).collect():
        got[r["doc_id"]] += len(r["text"].split())
        assert texts[r["doc_id"]].split()[: len(r["text"].split())] == r["text"].split()
    assert got == want


def test_mixing_of_odd_rows(odd, documents):
    assert len(mixing.mixed(odd).collect()) == 10
    assert mixing.mixed(odd.limit(0)).count() == 0
    assert [r["taken"] for r in mixing.mixed(documents([None, "", " "])).collect()] == [0, 0, 0]


# Whitening


def embeddings(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, n string, v int")


def check_whitening(rows, vectors):
    x = np.floor(64 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 1_000_000
    n, d = x.shape
    count, total = min(32, d), x.sum(axis=0)
    apart = n * x.astype(object) - total
    covariance = (apart.T @ apart / n**3).astype(float)
    values = np.linalg.eigvalsh(covariance)[::-1]
    table = defaultdict(dict)
    for r in rows:
        table[r["vec_id"]][r["component"]] = r
    assert len(rows) == n * count and len({r["identity_error"] for r in rows}) == 1
    z = np.array([[table[i][c]["whitened"] for c in range(1, count + 1)] for i in sorted(table)])
    spread = values[:count] > d * np.finfo(float).eps * values[0]
    assert np.abs(z.T @ z / n - np.diag(spread.astype(float))).max() < 1e-9
    # The projection back on the components gives the variance each explains.
    for c in range(count):
        assert table[min(table)][c + 1]["explained"] == pytest.approx(values[c] / values.sum(), abs=1e-12)
    for k, i in enumerate(sorted(table)):
        assert {r["deviation"] for r in table[i].values()} == {int((apart[k] ** 2).sum())}
        assert {r["n"] for r in table[i].values()} == {n}
    # Whitened rows have the Mahalanobis distances, whatever the signs.
    if count == d and spread.all():
        a = (apart / n).astype(float)
        assert np.allclose((z**2).sum(axis=1), (a @ np.linalg.inv(covariance) * a).sum(axis=1))
    error = rows[0]["identity_error"]
    assert error < 1e-9 if spread.all() else error == 1


@pytest.mark.parametrize("d,n", [(1, 9), (5, 300), (40, 900)])
def test_whitening_matches_plain_algebra(spark, d, n):
    rng = np.random.default_rng(d)
    vectors = (rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) + 3).tolist()
    out = whitening.whitened(embeddings(spark, list(enumerate(vectors))).repartition(5)).collect()
    check_whitening(out, vectors)


def test_sums_are_exact_for_wild_and_constant_dimensions(spark):
    rng = np.random.default_rng(1)
    y = np.stack([rng.integers(0, 1 << 50, 5000), rng.integers(0, 3, 5000), np.full(5000, 7), rng.integers(0, 1 << 20, 5000)], axis=1)
    bits = [50, 2, 1, 20]
    y[:, 2] = 1
    sums = [np.zeros((4, 4), np.int64) for _ in range(5)]
    for part in (y[:4096], y[4096:]):
        whitening.cross_products(whitening.bit_planes(part, bits), bits, sums)
    exact = y.astype(object).T @ y.astype(object)
    for i in range(4):
        for j in range(i, 4):
            assert sum(int(s[i, j]) << (32 * k) for k, s in enumerate(sums)) == exact[i, j]
    # Dimensions of very different size, through Spark: the loadings stay finite.
    vectors = (rng.normal(size=(200, 3)) * [1e6, 1, 1e-9]).tolist()
    out = whitening.whitened(embeddings(spark, list(enumerate(vectors)))).collect()
    assert len(out) == 600 and all(np.isfinite(r["whitened"]) for r in out)


def test_rows_without_a_whole_vector_are_left_out(spark):
    rng = np.random.default_rng(4)
    good = rng.normal(size=(50, 3)).tolist()
    rows = list(enumerate(good)) + [
        (90, None), (91, []), (92, [1.0, None, 2.0]), (93, [1.0, float("nan"), 2.0]), (94, [float("inf"), 0.0, 1.0]), (95, [1.0, 2.0]),
    ]
    out = whitening.whitened(embeddings(spark, rows)).collect()
    check_whitening(out, good)
    copies = whitening.whitened(embeddings(spark, [(None, [1.0, 2.0])] * 4 + [(1, [2.0, 0.0])])).collect()
    assert len(copies) == 10 and sum(r["vec_id"] is None for r in copies) == 8
    alone = whitening.whitened(embeddings(spark, [(1, [1.0, 2.0])])).collect()
    assert [(r["deviation"], r["whitened"], r["explained"]) for r in alone] == [(0, 0.0, 0.0)] * 2
    assert whitening.whitened(embeddings(spark, [(1, None)])).count() == 0
    assert whitening.whitened(embeddings(spark, [(1, None)]).limit(0)).count() == 0
    huge = whitening.whitened(embeddings(spark, [(1, [3e38, 1.0]), (2, [-3e38, 2.0])])).collect()
    assert len(huge) == 4


def test_texts_are_counted_in_pieces(monkeypatch):
    import tracemalloc
    from collections import Counter

    import numpy as np

    from millrace.llm import lm_score

    texts = [" ".join(f"w{(i % 5 * j) % 997}" for j in range(2000)) for i in range(200)] + [None, ""]
    monkeypatch.setattr(lm_score, "PIECE_TOKENS", 20_000)
    tracemalloc.start()
    rows = lm_score.counted_texts(texts, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # Tokens and pairs of all texts take 6.4 MB as hashes alone.
    assert peak < 6e6, peak
    got, words = Counter(), 0
    for part, keys, counts, n in zip(rows["part"], rows["keys"], rows["counts"], rows["words"]):
        keys = np.frombuffer(keys, np.uint64)
        assert (keys % np.uint64(4) == part).all()
        got.update(dict(zip(keys.tolist(), np.frombuffer(counts, "<u4").tolist())))
        words += n
    tokens = [lm_score.token_hashes(t) for t in texts]
    wanted = Counter(int(k) for t in tokens for k in (*t, *lm_score.pair_hashes(t)))
    assert got == wanted and words == len({int(k) for t in tokens for k in t})
    assert lm_score.counted_texts([], 4)["part"] == []


def test_counts_travel_in_rows_of_bounded_size_and_add_up(monkeypatch):
    from collections import Counter

    import numpy as np

    from millrace.llm import lm_score
    from millrace.llm.common import kept_in_process, let_go

    monkeypatch.setattr(lm_score, "ROW_KEYS", 100)
    monkeypatch.setattr(lm_score, "GATHERED_KEYS", 300)
    texts = [" ".join(f"w{(i * j) % 1009}" for j in range(500)) for i in range(1, 61)] + [None]
    rows = []
    for i in range(0, len(texts), 20):
        out = lm_score.counted_texts(texts[i : i + 20], 3)
        rows += zip(out["part"], out["keys"], out["counts"], out["words"])
    assert max(len(r[1]) for r in rows) == 800 and len(rows) > 100
    got = {p: (dict(zip(*words)), dict(zip(*pairs))) for p, words, pairs in lm_score.gathered(sorted(rows, key=lambda r: r[0]))}
    for kind, hashes in enumerate((lambda t: t, lm_score.pair_hashes)):
        wanted = Counter(int(k) for t in texts for k in hashes(lm_score.token_hashes(t)))
        assert {int(k): int(c) for v in got.values() for k, c in v[kind].items()} == wanted
        assert all(int(k) % 3 == p for p, v in got.items() for k in v[kind])
    assert list(lm_score.gathered([])) == []
    # A filter is entered piece by piece and is the same.
    keys = np.arange(1, 2001, dtype=np.uint64)
    whole = lm_score.built(keys, keys.astype(np.int64))
    monkeypatch.setattr(lm_score, "ENTERED_KEYS", 64)
    assert (lm_score.built(keys, keys.astype(np.int64)) == whole).all()
    assert len(lm_score.built(keys[:0], keys[:0].astype(np.int64))) == lm_score.WORD_STEP
    # A model of an earlier run is not kept beside the counting.
    kept_in_process("language model", "earlier", lambda: 1)
    let_go("language model")
    let_go("language model")
    assert kept_in_process("language model", "earlier", lambda: 2) == 2
    let_go("language model")
