"""Secret scanning: fixed forms, and character Markov models for strings that have no fixed form.

Two order-1 character models are trained, one on secret values (what the fixed forms find in a
bounded sample of the corpus) and one on ordinary identifiers and words of a bounded sample. A token
is reported when its mean log-likelihood ratio per character is above a threshold that is calibrated
on the two samples.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import LOWER, bounded_sample, map_columns, stored

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "random")
LEAST = {"assign": 8, "access": 16}
#: Words that every assign match holds, for a fast look before the pattern runs.
KEYWORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")

TOKEN = re.compile(r"[A-Za-z0-9+/_=-]+")
#: Tokens shorter than this are not judged.
MIN_TOKEN = 16
#: Rows of each of the two training samples.
SAMPLE_ROWS = 4000
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"

_HEX_RUN = bytes(120 if 48 <= b <= 57 or 97 <= b <= 102 else 32 for b in range(256))
_TOKEN_RUN = bytes(120 if chr(b) in ALPHABET else 32 for b in range(256))

#: Anything a fixed form could match, as a filter for the sample.
LIKELY = r"(?i)passw(?:or)?d|secret|token|api_?key|(?-i)AKIA[A-Z0-9]{12}|[0-9a-f]{32}"


def fixed_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed forms: leftmost, without overlap within a kind, failing ones dropped."""
    raw = text.encode("utf-8", "surrogatepass")
    low = raw.translate(LOWER)
    out = []
    if any(k in low for k in KEYWORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if b"AKIA" in raw:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    if b"x" * 32 in raw.translate(_HEX_RUN):
        out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return out


def secret_values(text: str) -> list[str]:
    """The values inside the fixed forms, for training."""
    out = [m[2] for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    return out + [m[0] for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]] + HEX.findall(text)


def ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in ordered(spans))


class RatioModel:
    """Log-likelihood ratio of two order-1 character models with add-one smoothing."""

    def __init__(self, counts: dict[tuple[int, str], int]):
        import numpy as np

        n = len(ALPHABET)
        table = np.ones((2, n + 1, n))
        for (label, pair), c in counts.items():
            first = 0 if len(pair) == 1 else ALPHABET.index(pair[0]) + 1
            table[label, first, ALPHABET.index(pair[-1])] += c
        logs = np.log(table / table.sum(axis=2, keepdims=True))
        self.ratio = logs[1] - logs[0]
        self.number = {c: i for i, c in enumerate(ALPHABET)}

    def __call__(self, token: str) -> float:
        """Mean ratio per character; above zero is more like a random string."""
        total, before = 0.0, 0
        for c in token:
            i = self.number[c]
            total += self.ratio[before, i]
            before = i + 1
        return total / len(token)


class Overlaps:
    """Whether spans that come in order overlap any of the given ones: both lists are gone through once."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        self.spans, self.next, self.reach = sorted((a, b) for _, a, b in spans), 0, -1

    def __call__(self, start: int, end: int) -> bool:
        while self.next < len(self.spans) and self.spans[self.next][0] < end:
            self.reach = max(self.reach, self.spans[self.next][1])
            self.next += 1
        return self.reach > start


def training_tokens(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(label, token): secret values (1) and ordinary tokens (0) of bounded samples of rows."""
    texts = docs.select("doc_id", "text").where("text is not null")
    secret = bounded_sample(texts.where(F.col("text").rlike(LIKELY)), rows, 1)
    plain = bounded_sample(texts, rows, 2)

    def step(_, labels, texts):
        out = {"label": [], "token": []}
        for label, text in zip(labels, texts):
            if label:
                found = [t for v in secret_values(text) for t in TOKEN.findall(v)]
            else:
                taken = Overlaps(fixed_spans(text))
                found = [m[0] for m in TOKEN.finditer(text) if not taken(*m.span()) and len(m[0]) >= 4]
            out["label"] += [label] * len(found)
            out["token"] += found
        return out

    both = secret.select(F.lit(1).alias("label"), "text").unionByName(plain.select(F.lit(0).alias("label"), "text"))
    return map_columns(both, ["label", "text"], step, "label int, token string")


def trained(docs: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[RatioModel, float]:
    """The ratio model and its threshold.

    One half of the sampled tokens trains the models, the other calibrates. Counts are aggregated in
    Spark; the driver gets at most one number per label and pair of characters. The threshold lies
    half-way between the medians of ordinary and secret tokens, or higher if the upper tail of the
    ordinary ones (99.99th percentile) asks for it, but not above the fifth percentile of the secret
    ones: unlabelled secrets among the ordinary tokens cannot push it beyond that.
    """
    tokens = stored(training_tokens(docs, rows), "secret-sample")
    trains = F.pmod(F.xxhash64("token"), F.lit(2)) == 0
    pairs = F.transform(
        F.sequence(F.lit(0), F.length("token") - 1),
        lambda i: F.when(i == 0, F.substring("token", 1, 1)).otherwise(F.substring(F.col("token"), i, F.lit(2))),
    )
    counts = tokens.where(trains).select("label", F.explode(pairs).alias("pair")).groupBy("label", "pair").count()
    model = RatioModel({(r[0], r[1]): r[2] for r in counts.collect()})

    def step(_, labels, found):
        return {"label": labels, "ratio": [model(t) for t in found]}

    held = tokens.where(~trains & (F.length("token") >= MIN_TOKEN))
    scored = map_columns(held, ["label", "token"], step, "label int, ratio double")
    shares = F.array(F.lit(0.05), F.lit(0.5), F.lit(0.9999))
    at = scored.groupBy("label").agg(F.percentile_approx("ratio", shares, 10000).alias("q")).collect()
    ends = {r[0]: r[1] for r in at}
    plain = ends.get(0, [0.0] * 3)
    secret = ends.get(1, [plain[1] + 1.0] * 3)
    return model, max((plain[1] + secret[1]) / 2, min(plain[2], secret[0]))


def judged(token: str) -> bool:
    """Whether a token is put to the models: long enough, and no mere number or rule of signs."""
    return len(token) >= MIN_TOKEN and any(c.isalpha() for c in token)


def found_spans(text: str | None, model: RatioModel, threshold: float) -> list[tuple[str, int, int]]:
    """All spans of a text; a random token never overlaps a fixed form."""
    if not text:
        return []
    spans = fixed_spans(text)
    if b"x" * MIN_TOKEN in text.encode("utf-8", "surrogatepass").translate(_TOKEN_RUN):
        taken = Overlaps(spans)
        for m in TOKEN.finditer(text):
            if taken(*m.span()) or not judged(m[0]):
                continue
            if model(m[0]) > threshold:
                spans.append(("random", *m.span()))
    return spans


def secrets(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_random, base_spans, spans) of every row of ``docs`` (doc_id, text).

    Spans are kind:start:end in code points, ordered and comma-joined. Null and empty texts have none.
    Rows that repeat give equal rows; other columns are ignored; a null doc_id is kept; an empty table
    gives an empty result. Without secret samples the random model is uniform; ``rows`` bounds each
    training sample.
    """
    model, threshold = trained(docs, rows)

    def step(_, ids, texts):
        out = {k: [] for k in ("doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_spans", "spans")}
        for doc, text in zip(ids, texts):
            spans = found_spans(text, model, threshold)
            out["doc_id"].append(doc)
            for kind in KINDS:
                out[f"n_{kind}"].append(sum(s[0] == kind for s in spans))
            out["base_spans"].append(joined([s for s in spans if s[0] != "random"]))
            out["spans"].append(joined(spans))
        return out

    schema = (
        "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_spans string, spans string"
    )
    return map_columns(docs, ["doc_id", "text"], step, schema)
