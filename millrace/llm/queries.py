"""The registered queries of the subpackage and their check SQL."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import (
    decontaminate,
    html,
    license_scan,
    lm_score,
    mixing,
    packing,
    periodic,
    pii,
    quality,
    secret_scan,
    simhash,
    warc,
    whitening,
)
from millrace.llm.common import table
from millrace.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}

#: Rows of an Arrow batch: a batch of documents stays within a few hundred MB even at 100 kB a text.
BATCH_ROWS = "2000"


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the settings of the library and smaller Arrow batches."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def query(name: str, check: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepared(spark), sf_dir)

        QUERIES[name] = run
        if check is not None:
            CHECKS[name] = check
        return fn

    return register


@query("op1_html_extraction")
def op1_html_extraction(spark, sf_dir):
    return html.extracted(table(spark, sf_dir, "pages", "page_id", "url", "html"))


@query("op2_simhash_near_dedup")
def op2_simhash_near_dedup(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), shingle=3, words=1, threshold=3)
    return found.select(
        "doc_id", F.lpad(F.lower(F.hex(F.col("fp")[0])), 16, "0").alias("fingerprint"), "component_id"
    )


OP5_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), lines AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
  GROUP BY r
), wins AS (
  SELECT r, i, ws[i:i+2] AS win FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM wins) WHERE c > 1
), hit AS (
  SELECT r, count(*) AS n FROM (SELECT DISTINCT r, i + k AS p FROM twice, (VALUES (0), (1), (2)) AS v(k)) GROUP BY r
), m AS (
  SELECT w.r, doc_id, source, len(ws) AS n_words,
         coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(hit.n, 0) AS n_repeat_words
  FROM w LEFT JOIN lines USING (r) LEFT JOIN hit USING (r)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
), g AS (
  SELECT *, base_failed OR 100 * n_symbols > 20 * n_words OR 100 * n_dup_lines > 50 * n_lines
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words AS rule_failed FROM f
), hosts AS (
  SELECT source, count(*)::DOUBLE AS docs, sum(rule_failed::INT)::DOUBLE AS failed FROM g GROUP BY source
), sums AS (
  SELECT sum(docs) AS n, sum(failed) AS k, count(*)::DOUBLE AS h, sum(docs * docs) AS n2,
         sum(failed * failed / docs) AS k2 FROM hosts
), fit AS (
  SELECT k / n AS mean, k / n * (1 - k / n) AS noise, h,
         (k2 - k * k / n - k / n * (1 - k / n) * (h - 1)) / nullif(n - n2 / n, 0) AS excess FROM sums
), prior AS (
  SELECT mean, CASE WHEN h > 1 AND noise > 0 AND excess > 0
                    THEN least(greatest(noise / excess - 1, 1.0), 1e6) ELSE 1e6 END AS s FROM fit
), bad AS (
  SELECT source FROM hosts, prior WHERE (failed + mean * s) / (docs + s) > 0.6
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT rule_failed AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.source IS NOT DISTINCT FROM g.source) AS kept
FROM g
"""


@query("op5_host_quality_rules", OP5_SQL)
def op5_host_quality_rules(spark, sf_dir):
    judged = quality.host_quality(table(spark, sf_dir, "documents", "doc_id", "source", "text"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


OP7_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS ws
  FROM documents
), b AS (
  SELECT DISTINCT item_id,
         regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS ws
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, k, array_to_string(ws[i:i+k-1], ' ') AS win
  FROM (SELECT item_id, ws, least(len(ws), 10) AS k, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i
        FROM b WHERE len(ws) > 0)
), sizes AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT r, k, i, array_to_string(ws[i:i+k-1], ' ') AS win
  FROM (SELECT r, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, sizes WHERE len(ws) >= k)
), m AS (SELECT dw.r, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
hit AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT r, i, k FROM m))
  GROUP BY r
), ids AS (
  SELECT r, count(*) AS n, string_agg(s, ',' ORDER BY s) AS s
  FROM (SELECT DISTINCT r, coalesce(item_id::VARCHAR, '') AS s FROM m) GROUP BY r
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(ids.n, 0)::BIGINT AS n_items,
       sha256(coalesce(ids.s, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN ids USING (r)
"""


@query("op7_benchmark_decontamination", OP7_SQL)
def op7_benchmark_decontamination(spark, sf_dir):
    found = decontaminate.contamination(
        table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text")
    )
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2("item_list", 256).alias("items_sha256"), "contaminated"
    )


OP4_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages
), k AS (
  SELECT payload_digest, max(page_id) AS kept FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, p.payload_digest,
       CASE WHEN kept IS NULL OR payload_bytes < 1000 OR page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN kept IS NULL OR payload_bytes < 1000 OR page_id = kept THEN NULL ELSE kept END AS refers_to
FROM p LEFT JOIN k USING (payload_digest)
"""


@query("op4_warc_salvage", OP4_SQL)
def op4_warc_salvage(spark, sf_dir):
    return warc.archived(table(spark, sf_dir, "pages", "page_id", "url", "html"))


@query("op10_pattern_packing")
def op10_pattern_packing(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op8_secret_scan")
def op8_secret_scan(spark, sf_dir):
    found = secret_scan.secrets(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_random"
    )


@query("op9_pii_boosted_trees")
def op9_pii_boosted_trees(spark, sf_dir):
    found = pii.personal_data(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select(
        "doc_id",
        *[_count("base", k).alias(f"n_{k}") for k in pii.BASE_KINDS],
        F.sha2(pii.span_text(F.col("base")), 256).alias("base_sha256"),
        pii.span_text(F.col("chosen")).alias("spans"),
    )


def _count(spans: str, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


@query("op6_bloom_lm_score")
def op6_bloom_lm_score(spark, sf_dir):
    return lm_score.scored(table(spark, sf_dir, "documents", "doc_id", "text"))


def file_tree(documents: DataFrame) -> DataFrame:
    """Documents as files (id, path, text): source/language/folder/number, every fiftieth a licence file.

    Licence files stand alternately in the folder of the source and in that of the language.
    """
    n = F.col("doc_id")
    top = F.concat_ws("/", "source", F.when(n % 100 == 0, F.col("lang")))
    path = F.when(n % 50 == 0, F.concat(top, F.lit("/LICENSE."), n.cast("string"))).otherwise(
        F.concat_ws("/", "source", "lang", (n % 7).cast("string"), F.concat(n.cast("string"), F.lit(".txt")))
    )
    return documents.select(n.alias("id"), path.alias("path"), "text")


_TERMS = "regexp_extract_all(lower({}), '[a-z0-9]+(?:[.-][a-z0-9]+)*')"
_TEMPLATES = ", ".join(f"({i}, '{n}', '{t}')" for i, (n, t) in enumerate(license_scan.TEMPLATES))
_N = len(license_scan.TEMPLATES)

OP3_SQL = f"""
WITH tpl(t, name, notice) AS (VALUES {_TEMPLATES}),
tf AS (SELECT t, name, term, count(*) AS tf FROM (SELECT t, name, unnest({_TERMS.format('notice')}) AS term FROM tpl) GROUP BY ALL),
idf AS (SELECT term, ln((1.0 + {_N}) / (1.0 + count(*))) + 1.0 AS idf FROM tf GROUP BY term),
w AS (SELECT t, name, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY t)) AS w FROM tf JOIN idf USING (term)),
f AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         CASE WHEN doc_id % 50 = 0
              THEN concat(source, CASE WHEN doc_id % 100 = 0 THEN concat('/', lang) ELSE '' END, '/LICENSE.', doc_id)
              ELSE concat(source, '/', lang, '/', doc_id % 7, '/', doc_id, '.txt') END AS path
  FROM documents
),
lines AS (
  SELECT r, path, text, list_filter(regexp_split_to_array(text, '\\r?\\n'),
           lambda x: regexp_matches(x, '{license_scan.NOTICE}')) AS ls FROM f
),
p AS (
  SELECT row_number() OVER () AS pid, r, notice FROM (
    SELECT r, unnest(list_concat(ls, CASE WHEN len(ls) > 0 AND regexp_matches(path, '{license_scan.LICENCE_FILE}')
                                          THEN [text] ELSE [] END)) AS notice FROM lines)
),
v AS (
  SELECT pid, r, term, count(*) * coalesce(any_value(idf), ln(1.0 + {_N}) + 1.0) AS w
  FROM (SELECT pid, r, unnest({_TERMS.format('notice')}) AS term FROM p) LEFT JOIN idf USING (term) GROUP BY pid, r, term
),
norms AS (SELECT pid, sqrt(sum(w * w)) AS norm FROM v GROUP BY pid),
hits AS (
  SELECT v.pid, v.r, w.t, w.name, sum(v.w * w.w) / any_value(norm) AS score
  FROM v JOIN w USING (term) JOIN norms ON norms.pid = v.pid GROUP BY v.pid, v.r, w.t, w.name
),
best AS (
  SELECT r, name AS own, round(score, 6) AS score FROM hits WHERE score >= {license_scan.LEAST}
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, t) = 1
),
own AS (SELECT f.r, f.doc_id, f.path, best.own, best.score, regexp_replace(f.path, '/[^/]*$', '') AS folder FROM f LEFT JOIN best USING (r)),
declared AS (
  SELECT folder AS licence_dir, own AS licence FROM own WHERE own IS NOT NULL AND regexp_matches(path, '{license_scan.LICENCE_FILE}')
  QUALIFY row_number() OVER (PARTITION BY folder ORDER BY score DESC, own) = 1
),
above AS (
  SELECT folder, n, array_to_string(string_split(folder, '/')[1:n], '/') AS up
  FROM (SELECT folder, unnest(range(0, len(string_split(folder, '/')) + 1)) AS n FROM (SELECT DISTINCT folder FROM own))
),
near AS (
  SELECT folder, licence_dir, licence FROM above JOIN declared ON up = licence_dir
  QUALIFY row_number() OVER (PARTITION BY folder ORDER BY n DESC) = 1
)
SELECT doc_id, path, own, score, coalesce(own, licence) AS licence,
       CASE WHEN own IS NOT NULL THEN 'own' WHEN licence IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
       CASE WHEN own IS NULL THEN licence_dir END AS licence_dir
FROM own LEFT JOIN near USING (folder)
"""


@query("op3_license_scan", OP3_SQL)
def op3_license_scan(spark, sf_dir):
    found = license_scan.licences(file_tree(table(spark, sf_dir, "documents", "doc_id", "source", "lang", "text")))
    return found.withColumnRenamed("id", "doc_id")


@query("op11_embedding_whitening")
def op11_embedding_whitening(spark, sf_dir):
    return whitening.whitened(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS k
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0::DOUBLE, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
  FROM d GROUP BY source
), f AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / w AS ratio FROM s
), g AS (
  SELECT *, 1.5::DOUBLE * (SELECT sum(source_size) FROM f)
            - coalesce(sum(cap) OVER (ORDER BY ratio ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(w) OVER (ORDER BY ratio ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM f
), rate AS (SELECT max(rest / ws) AS r FROM g WHERE rest / ws <= ratio),
t AS (SELECT source, source_size, least(cap, w * r) AS target, floor(least(cap, w * r) + 0.5)::BIGINT AS budget FROM f, rate),
p AS (
  SELECT d.*, t.source_size, t.target, budget,
         (sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, source, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0
            ELSE budget // source_size * size + greatest(0, least(size, budget % source_size - before)) END::BIGINT AS taken
FROM p
"""


@query("op12_source_mixing", OP12_SQL)
def op12_source_mixing(spark, sf_dir):
    return mixing.mixed(table(spark, sf_dir, "documents", "doc_id", "source", "text"))


def planted(doc: int | None, words: list[bytes]) -> list[bytes]:
    """The words of one document in ten with a period from some word on; a null id has none."""
    h, n = zlib.crc32(str(doc).encode()), len(words)
    if doc is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


@query("op13_periodic_runs")
def op13_periodic_runs(spark, sf_dir):
    found = periodic.periodic_runs(table(spark, sf_dir, "documents", "doc_id", "text"), rewrite=planted)
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    # The greatest length; of several the smallest start, then period.
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    shown = found.withColumn("lines", F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")))
    shown = shown.withColumn("best", best)
    length, start, period = F.col("best.length"), -F.col("best.col2"), -F.col("best.col3")
    return shown.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
