"""Pages, archives, licences, language model, packing and the pipeline."""

import gzip
import hashlib
import io
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F
from llm_tables import documents, odd  # noqa: F401
from millrace.llm import html, license_scan, lm_score, packing, warc
from test_dedup import plain_components, plain_fingerprint

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a="</p>";</script></head><body>
<nav><ul><li><a href="/a">A</a></li><li><a>B</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy this now. It is good.</div>
<header>Site header</header><aside>Side, bar.</aside><div class="cookie-notice">We use cookies, and more of them.</div>
<article><h1>T &amp; t</h1><p><b>First</b> para&shy;graph, with   text&nbsp;here.<br><p>Second &lt;one&gt;<a href=x>link</a>, longer, longer, longer.
<ul><li>item one<li>item two</ul><form>Name <input></form><div class="comments"><p>A reader says, well, much, much, much.</p></div></article>
<footer>&copy; host &middot; Words, words, words.</footer></body></html>"""


def test_main_text_of_a_page():
    text = html.main_text(PAGE)
    assert text == "T & t First para\xadgraph, with text here. Second <one>link, longer, longer, longer. item one item two"


@pytest.mark.parametrize("page", [None, "", "<", "<p", "plain words", "<script>x", "<!-- x", "<a b='", "<p>" * 3000, "</p></div>", "<title>x"])
def test_broken_pages_do_not_fail(page):
    assert html.main_text(page) == ("plain words" if page == "plain words" else html.main_text(page))


def test_content_without_an_article_element_is_found_by_its_ratios():
    body = "".join(f"<p>Sentence {i}, with a good many words in it, and some marks.</p>" for i in range(8))
    menu = "".join(f"<li><a href=/{i}>go {i}</a></li>" for i in range(30))
    page = f"<body><div class=x1><ul>{menu}</ul></div><div class=x2><h2>Head</h2>{body}</div><div class=x3><ul>{menu}</ul></div></body>"
    text = html.main_text(page)
    assert text.startswith("Head Sentence 0") and text.endswith("some marks.") and "go 3" not in text


ARTICLE = "".join(f"<p>Sentence {i}, with a good many words in it, and some marks.</p>" for i in range(12))
ARTICLE_TEXT = " ".join(f"Sentence {i}, with a good many words in it, and some marks." for i in range(12))
MENU = "<nav><ul>" + "".join(f"<li><a href=/{i}>Section {i}</a></li>" for i in range(15)) + "</ul></nav>"
REMARKS = "".join(f"<p>Reader {i} says that, well, much, much of this is so.</p>" for i in range(6))

#: Pages and the text a reader would take as the article.
GOLD = [
    (f"<body class='single has-sidebar'>{MENU}{ARTICLE}</body>", ARTICLE_TEXT),
    (f"<body><main class='no-sidebar'>{ARTICLE}</main><aside>Other news.</aside></body>", ARTICLE_TEXT),
    (f"<body><article class='post ad-free'>{ARTICLE}</article><footer>All rights.</footer></body>", ARTICLE_TEXT),
    (f"<body>{MENU}<div id='search-results'>{ARTICLE}</div></body>", ARTICLE_TEXT),
    (f"<body><div class='comment-free'>{ARTICLE}</div></body>", ARTICLE_TEXT),
    (f"<body><header><h1>Site</h1></header><main><header><h1>Title</h1></header>{ARTICLE}</main></body>", f"Title {ARTICLE_TEXT}"),
    (f"<body><div class='story'>{ARTICLE}</div><div class='comments-area'>{REMARKS}</div></body>", ARTICLE_TEXT),
    (f"<body><article>{ARTICLE}<section id='comments'>{REMARKS}</section></article></body>", ARTICLE_TEXT),
    (f"<body><article>{ARTICLE}<div class='cookie-notice'>We use cookies, and more.</div></article></body>", ARTICLE_TEXT),
    (f"<body><article>{ARTICLE}<div class='widget sidebar-left'>Most read, this week.</div></article></body>", ARTICLE_TEXT),
    (f"<body><article><h2>A &amp; b</h2>{ARTICLE}<table><tr><td>1<td>2</table></article></body>", f"A & b {ARTICLE_TEXT} 1 2"),
    (f"<body><div class=page><div class=left>{MENU}</div><div class=mid>{ARTICLE}</div></div></body>", ARTICLE_TEXT),
    (f"<body><article class='advertisement'>{ARTICLE}</article></body>", ARTICLE_TEXT),
]


@pytest.mark.parametrize("number", range(len(GOLD)))
def test_the_text_of_pages_with_known_articles(number):
    page, text = GOLD[number]
    assert html.main_text(page) == text


def test_very_long_and_very_deep_pages_take_linear_time():
    from time import perf_counter

    begin = perf_counter()
    page = "<body><article>" + "".join(f"<p id=p{i}>Sentence {i}, with words.</p>" for i in range(20_000)) + "</article>"
    assert html.main_text(page).endswith("Sentence 19999, with words.")
    assert html.main_text("<div>" * 20_000 + "<p>some text, here.</p>" + "</div>" * 20_000) == "some text, here."
    assert html.main_text("".join(f"<div class=c{i}>word, word. " for i in range(5_000))) is not None
    assert perf_counter() - begin < 8


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")


def test_extraction_of_odd_rows(spark):
    out = html.extracted(pages(spark, [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, "v", "")])).collect()
    assert len(out) == 4 and sorted(r["n_chars"] for r in out)[:2] == [0, 0]
    assert html.extracted(pages(spark, []).limit(0)).count() == 0


def test_archives_round_trip(spark):
    big, small = "é" * 600, "x" * 999
    rows = [(1, "http://a/\n b", big), (5, "b", big), (3, None, big), (4, "c", small), (6, "c", small), (None, None, None), (7, "d", ""), (5, "b", big)]
    out = warc.archived(pages(spark, rows)).collect()
    got = sorted((r["page_id"] or 0, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out)
    expected = []
    for i, _, h in rows:
        data = (h or "").encode()
        copy = len(data) >= 1000 and i != 5
        expected.append((i or 0, len(data), hashlib.sha1(data).hexdigest(), "revisit" if copy else "response", 5 if copy else None))
    assert got == sorted(expected, key=lambda r: r[:4])
    assert warc.archived(pages(spark, []).limit(0)).count() == 0


def salvaged(data):
    return list(warc.salvage(io.BytesIO(data), len(data)))


@pytest.mark.parametrize("pack", [lambda b: gzip.compress(b, mtime=0), lambda b: b])
def test_damage_is_quarantined_and_later_records_are_read(pack):
    parts = [pack(warc.record_bytes(i, "u", f"payload {i} ".encode() * 200, None)) for i in range(5)]
    assert [r[3]["warc-record-id"] for r in salvaged(b"".join(parts))] == [f"<urn:page:{i}>" for i in range(5)]
    broken = bytearray(parts[1])
    broken[len(broken) // 2] ^= 0xFF
    data = b"".join([parts[0], bytes(broken), parts[2], b"junk WARC/1. junk\x1f\x8b\x08junk", parts[3], parts[4][:-20]])
    out = salvaged(data)
    assert [r[3]["warc-record-id"] for r in out if r[0] == "record"] == [f"<urn:page:{i}>" for i in (0, 2, 3)]
    gaps = [(r[1], r[2]) for r in out if r[0] == "gap"]
    a = len(parts[0])
    b = a + len(broken) + len(parts[2])
    c = b + 24 + len(parts[3])
    assert gaps == [(a, a + len(broken)), (b, b + 24), (c, len(data))]
    # Records and gaps cover the file without holes.
    assert sorted({(r[1], r[2]) for r in out})[0][0] == 0 and out[-1][2] == len(data)


def test_licences_match_and_are_inherited(spark):
    rows = [
        ("a/LICENSE", "Released under the MIT License."), ("a/b/c.py", "no notice"), ("a/b/d.py", "x\nLicensed under CC BY-NC 4.0.\ny"),
        ("a/b/COPYING", "Licensed under the Apache License, Version 2.0."), ("a/e/f.py", None), ("g/h.py", ""), ("LICENSE.x", "this is a license"),
        (None, "Released under the MIT License."), (None, None), ("a/b/c.py", "no notice"),
    ]
    files = spark.createDataFrame([(i, p, t, "x") for i, (p, t) in enumerate(rows)], "id long, path string, text string, folder string")
    out = {r["id"]: (r["licence"], r["origin"], r["licence_dir"]) for r in license_scan.licences(files).collect()}
    assert out == {
        0: ("MIT", "own", None), 1: ("Apache-2.0", "inherited", "a/b"), 2: ("CC-BY-NC-4.0", "own", None), 3: ("Apache-2.0", "own", None),
        4: ("MIT", "inherited", "a"), 5: (None, "none", None), 6: (None, "none", None), 7: ("MIT", "own", None), 8: (None, "none", None),
        9: ("Apache-2.0", "inherited", "a/b"),
    }
    assert license_scan.licences(files.limit(0)).count() == 0


def test_licence_scores_match_plain_cosine(spark):
    import re

    token = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
    vectors = [Counter(token.findall(t.lower())) for _, t in license_scan.TEMPLATES]
    df = Counter(w for v in vectors for w in v)
    idf = lambda w: math.log((1 + len(vectors)) / (1 + df.get(w, 0))) + 1
    lines = ["Licensed under the Apache License, Version 2.0 or later", "license", "All rights reserved, copyright me", "Licensed under CC BY 4.0"]
    files = spark.createDataFrame([(i, "p", t) for i, t in enumerate(lines)], "id long, path string, text string")
    for r in license_scan.own_licences(files, least=0.0).collect():
        mine = {w: n * idf(w) for w, n in Counter(token.findall(lines[r["id"]].lower())).items()}
        best = 0.0
        for v in vectors:
            theirs = {w: n * idf(w) for w, n in v.items()}
            dot = sum(mine[w] * theirs.get(w, 0) for w in mine)
            best = max(best, dot / math.sqrt(sum(x * x for x in mine.values()) * sum(x * x for x in theirs.values())))
        assert abs(r["score"] - best) < 1e-5


def split(ids):
    return {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in ids}


def test_base_scores_match_brute_force_and_the_model_prefers_what_it_saw(documents):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(50)]
    texts = [" ".join(rng.choice(words, 30)) if i % 9 else "the same known sentence again and again" for i in range(120)]
    texts += [None, "", "Never Seen BEFORE", "the again and same sentence known again"]
    docs = documents(texts)
    held = split(range(len(texts)))
    tokens = {i: ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in (t or "").split()] + ["\n"] for i, t in enumerate(texts)}
    counts = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(counts.values()), len(counts)
    for heavy in (lm_score.HEAVY_WORDS, 20):
        out = {r["doc_id"]: r for r in lm_score.scored(docs, heavy_words=heavy).collect()}
        for i, t in tokens.items():
            r = out[i]
            assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held[i], len(t), n)
            assert r["n_known"] == sum(counts[w] > 0 for w in t)
            assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
    seen = next(i for i in range(0, 120, 9))
    assert out[seen]["score"] / out[seen]["n_tokens"] > out[123]["score"] / out[123]["n_tokens"] + 0.3
    # A filter that is probed in many passes gives the very same scores.
    passes = {r["doc_id"]: r["score"] for r in lm_score.scored(docs, max_filter_bytes=100_000).collect()}
    assert passes == {i: r["score"] for i, r in out.items()} and all(s < 0 for s in passes.values())


def test_the_filter_never_loses_an_entry_and_rarely_invents_one():
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 2**63, 20_000).astype(np.uint64))
    counts = rng.geometric(0.2, len(keys)) ** 2
    parts = 4
    held = {}
    for p in range(parts):
        mine = keys % np.uint64(parts) == p
        held[p] = lm_score.built(keys[mine], counts[mine]).tobytes()
    model = lm_score.Filter(*lm_score.Filter.packed(held, range(parts)))
    got = model.counts(keys)
    assert (got >= np.exp2(np.floor(np.log2(counts))) - 0.5).all()
    assert (got <= 2 * counts).mean() > 0.95
    other = np.setdiff1d(rng.integers(0, 2**63, 20_000).astype(np.uint64), keys)
    assert (model.counts(other) > 0).mean() < 0.05
    # Groups of segments together say what the whole filter says.
    groups = [range(0, 1), range(1, 3), range(3, 4)]
    found = [lm_score.Filter(*lm_score.Filter.packed(held, g), g.start, parts).levels(keys) for g in groups]
    assert (np.max(found, axis=0) == model.levels(keys)).all()


@pytest.mark.parametrize("times", [1, 10, 100])
def test_the_error_of_the_filter_does_not_grow_with_its_entries(times):
    rng = np.random.default_rng(9)
    keys = np.unique(rng.integers(0, 2**63, 3_000 * times).astype(np.uint64))
    counts = rng.geometric(0.5, len(keys))
    sizes = {p: lm_score.built(keys[keys % np.uint64(5) == p], counts[keys % np.uint64(5) == p]).tobytes() for p in range(5)}
    groups = lm_score.groups_of({p: len(b) for p, b in sizes.items()}, 5, 60_000)
    assert [i for g in groups for i in g] == list(range(5)) and (times == 1 or len(groups) > 1)
    other = np.setdiff1d(rng.integers(0, 2**63, 20_000).astype(np.uint64), keys)
    levels = [lm_score.Filter(*lm_score.Filter.packed(sizes, g), g.start, 5).levels(other) for g in groups]
    assert (np.max(levels, axis=0) > 0).mean() < 0.05


def test_language_model_of_odd_rows(odd):
    out = lm_score.scored(odd).collect()
    assert len(out) == 10 and all(r["score"] < 0 and r["n_tokens"] >= 1 for r in out)
    assert lm_score.scored(odd.limit(0)).count() == 0


def check_packing(rows, capacity=1024):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:]))
        assert sum(n for _, n in places) <= capacity
    return len(by), sum(r["length"] for r in rows)


def test_the_plan_places_every_length_once_and_tightly():
    rng = np.random.default_rng(2)
    shapes = [
        {1024: 3}, {1: 5000}, {513: 100}, {}, {700: 10, 324: 7, 300: 9, 20: 4}, {1023: 4, 1: 2},
        dict(Counter(np.clip(rng.lognormal(5.5, 1, 20_000).astype(int), 1, 1024).tolist())),
    ]
    for counts in shapes:
        runs = packing.plan(counts)
        rows, seen = [], defaultdict(list)
        for length, first, end, sequence, offset in runs:
            seen[length] += range(first, end)
            rows += [{"sequence_id": sequence + i, "offset": offset, "length": length} for i in range(end - first)]
        assert {k: sorted(v) for k, v in seen.items()} == {k: list(range(n)) for k, n in counts.items()}
        used, tokens = check_packing(rows) if rows else (0, 0)
        least = max(-(-tokens // 1024), sum(n for k, n in counts.items() if k > 512))
        assert used <= least * 1.01 + 2


def test_pieces_and_ids_match_the_tokenizers_library(documents, spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = ["Hello world", None, "", "naïve café \U0001f600", "a b " * 3000, "<|endoftext|> x", " " * 5000, "x\n\n\ty  z", "word " * 1023, "\u0001\x00"]
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = packing.packed(documents(texts)).collect()
    check_packing(out)
    by = defaultdict(dict)
    for r in out:
        by[r["doc_id"]][r["piece"]] = r
    for i, t in enumerate(texts):
        ids = np.array([*own.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        pieces = [by[i][k] for k in range(len(by[i]))]
        assert [p["start"] for p in pieces] == np.cumsum([0, *[p["length"] for p in pieces[:-1]]]).tolist()
        assert sum(p["length"] for p in pieces) == len(ids) and all(p["length"] == 1024 for p in pieces[1:])
        assert len(pieces) == -(-len(ids) // 1024)
        assert all(p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) for p in pieces)


def test_packing_of_odd_rows(odd):
    out = packing.packed(odd).collect()
    check_packing(out)
    assert sum(r["piece"] == 0 for r in out) == 10
    assert packing.packed(odd.limit(0)).count() == 0


def test_pipeline_stages_on_a_small_table(spark, data, tmp_path, documents, odd):
    import corpus_pipeline as pipeline

    items = [r["text"] for r in spark.read.parquet(f"{data}/benchmark.parquet").limit(3).collect()]
    good = [" ".join(f"word{i}n{j}" for j in range(120)) for i in range(12)]
    texts = [*good, good[0], good[1], good[2] + " " + items[0], good[3][:300] + " mail x.y@mail.example.com " + good[4][:300], "short"]
    docs = documents(texts, sources=["s"] * len(texts))
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, data)
        if name != "packing":
            assert out.columns == docs.columns, name
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if name == "near_dedup":
            # Whatever the stage before kept is one row a component, by brute force.
            kept = [r["text"] for r in docs.select("text").collect()]
            assert len(kept) == len(set(plain_components([plain_fingerprint(t) for t in before]))) == 14
        before = [r["text"] for r in docs.select("text").collect()] if name == "quality_rules" else None
        if name == "personal_data":
            kept = [r["text"] for r in docs.select("text").collect()]
            assert len(kept) == 13 and not any(items[0] in t for t in kept)
            assert sum("mail [EMAIL] " in t for t in kept) == 1
    rows = docs.collect()
    assert len({r["doc_id"] for r in rows}) == 13
    check_packing(rows)
    for name, stage in pipeline.STAGES:
        assert stage(spark, odd.limit(0), data).count() == 0, name
        path = str(tmp_path / f"odd-{name}")
        stage(spark, odd, data).write.parquet(path)


def test_a_very_long_url_is_archived_and_read_back():
    url = "data:" + "x" * 200_000
    data = b"".join(gzip.compress(warc.record_bytes(i, u, b"page", None), mtime=0) for i, u in ((1, "u"), (2, url), (3, "v")))
    out = list(warc.salvage(io.BytesIO(data), len(data)))
    assert [r[0] for r in out] == ["record"] * 3
    assert out[1][3]["warc-target-uri"] == url


class Counted(io.BytesIO):
    """A file that counts what is read of it."""

    fetched = 0

    def read(self, n=-1):
        out = super().read(n)
        self.fetched += len(out)
        return out


@pytest.mark.parametrize("compressed", [True, False])
def test_an_archive_is_fetched_about_once(compressed):
    records = [warc.record_bytes(i, f"u{i}", bytes([65 + i % 7]) * 1500 + str(i).encode(), None) for i in range(4000)]
    data = b"".join(gzip.compress(r, 1, mtime=0) if compressed else r for r in records)
    # Damage in the middle: salvage goes on at the next record.
    place = len(data) // 2
    data = data[:place] + b"damaged" * 30 + data[place:]
    file = Counted(data)
    out = list(warc.salvage(file, len(data)))
    assert sum(r[0] == "record" for r in out) >= 3999 and sum(r[0] == "gap" for r in out) == 1
    assert file.fetched <= 1.1 * len(data) + warc.WINDOW_BYTES


def test_a_plain_record_may_have_a_header_of_any_length():
    url = "data:" + "x" * 300_000
    data = b"".join(warc.record_bytes(i, u, b"page", None) for i, u in ((1, "u"), (2, url), (3, "v")))
    assert [r[0] for r in warc.salvage(io.BytesIO(data), len(data))] == ["record"] * 3
    # A version line inside other bytes is no record, and the records after it are found.
    torn = data[:200] + warc.VERSION + b"\r\nno field here\r\n" + data
    found = [r[3]["warc-record-id"] for r in warc.salvage(io.BytesIO(torn), len(torn)) if r[0] == "record"]
    assert found[-3:] == ["<urn:page:1>", "<urn:page:2>", "<urn:page:3>"]


def test_every_archive_is_read_by_a_task_of_its_own(spark, tmp_path):
    rows = [(i, f"u{i}", f"{i} " * 400) for i in range(300)]
    folder = str(tmp_path / "archives")
    manifest = warc.write_archives(warc.with_references(pages(spark, rows)), folder, archive_bytes=4000)
    back = warc.read_archives(manifest, folder)
    archives = manifest.count()
    tasks = back.where("kind = 'record'").select("path", F.spark_partition_id().alias("task")).distinct()
    assert archives > 8 and back.where("kind = 'record'").count() == 300
    assert tasks.select("task").distinct().count() == archives
