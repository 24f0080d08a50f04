"""Personal data by boosted trees over candidate spans, with DataFrame and SQL functions only.

High-recall generators (regular expressions) propose spans, which may overlap. Every candidate gets
format and context features. Candidates of the base kinds that pass their strict check are always
personal data. For the further kinds a gradient-boosted tree model is fitted on a bounded sample of
candidates, labelled by the strict checks of all kinds; a span is taken if it passes its own check
and its score reaches the threshold of its kind, which is calibrated on all candidates of the kind
that did not train. A kind with few of these takes the threshold of all kinds together. Of overlapping spans of further kinds the best scored is taken.
"""

from __future__ import annotations


from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import same, stored
from millrace.operators.bounded import broadcast_if_small

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("masked_mail", "local_phone", "ssn", "iban")
KINDS = BASE_KINDS + MORE_KINDS

# Marks put around a match; texts that hold them get another control character in their place.
MARK, SPARE = "\u0001", "\u0002"

# Possessive repeats keep the matches of the plain patterns, but need neither backtracking nor stack:
# what follows a repeat can never begin with one of its characters. A run is entered at its first
# character or where the last match ended (\G), because a later start fails just as the first did.
GENERATORS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "masked_mail": r"(?i)\b[a-z0-9][a-z0-9._%+-]{0,63}\x20?(?:\(at\)|\[at\]|\{at\})\x20?[a-z0-9-]{1,63}"
    r"(?:\x20?(?:\.|\(dot\)|\[dot\]|\{dot\})\x20?[a-z0-9-]{1,63}){1,5}",
    "local_phone": r"(?<![0-9+(-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
#: Texts in which no generator can match are not searched.
LIKELY = {
    "email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]", "phone": r"\+[0-9]", "masked_mail": r"(?i)[(\[{]at[)\]}]",
    "local_phone": r"[0-9]{3}[-.)\x20]", "ssn": r"[0-9]-[0-9]{2}-", "iban": r"[A-Z]{2}[0-9]{2}",
}

#: Code points of context on either side of a candidate.
CONTEXT = 24
#: Bytes of stored spans that are broadcast to the texts.
MAX_SPAN_BYTES = 32 << 20
#: Candidates in the training sample.
SAMPLE_CANDIDATES = 20_000
#: A kind's precision is shrunk towards that of all kinds together, which counts as so many candidates.
PRIOR_CANDIDATES = 20
#: Precision that a threshold must reach on the held-out candidates of its kind.
PRECISION = 0.95
TREES, DEPTH = 12, 3

CUES = {
    "mail_cue": r"(?i)mail|contact|write|reach",
    "phone_cue": r"(?i)phone|tel|call|fax|mobile|cell|sms",
    "card_cue": r"(?i)card|visa|credit|pay|account|iban",
    "id_cue": r"(?i)ssn|social|security|tax|\bid\b|number",
    "net_cue": r"(?i)\bip\b|host|server|address|from",
}
FEATURES = (
    "n_chars", "n_digits", "digit_share", "n_separators", "n_groups", "n_letters", "has_at", "has_plus", "has_paren",
    "leading_zero", "glued_left", "glued_right", "line_start", *CUES, *[f"is_{k}" for k in KINDS],
)


def _pieces(kind: str, text: Column) -> Column:
    """The text cut at the matches of a generator: even places hold matches, odd ones what lies between."""
    cut = F.split(F.regexp_replace(text, F.lit(GENERATORS[kind]), F.lit(f"{MARK}$0{MARK}")), MARK, -1)
    parts = F.transform(
        cut,
        lambda p, i: F.struct(
            F.lit(kind).alias("kind"),
            i.alias("place"),
            F.char_length(p).cast("long").alias("size"),
            F.when(i % 2 == 1, p).alias("match"),
            # The end of what lies before a match is its context, and so is the start of what follows.
            F.when(i % 2 == 0, F.right(p, F.lit(CONTEXT))).alias("tail"),
            F.when(i % 2 == 0, F.left(p, F.lit(CONTEXT))).alias("head"),
        ),
    )
    return F.when(text.rlike(LIKELY[kind]) & (F.size(cut) > 1), parts)


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether 12 to 19 digits pass the Luhn check."""
    padded = F.lpad(digits, 19, "0")
    total = F.lit(0)
    for i in range(19):
        d = F.substring(padded, 19 - i, 1).cast("int")
        total = total + (d if i % 2 == 0 else F.when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.char_length(digits).between(12, 19) & (total % 10 == 0)


def _mod97(match: Column) -> Column:
    """Whether an account number passes its mod-97 check."""
    flat = F.regexp_replace(match, " ", "")
    turned = F.concat(F.substring(flat, 5, 64), F.substring(flat, 1, 4))
    return F.aggregate(
        F.split(turned, ""),
        F.lit(0),
        lambda acc, c: F.when(c.rlike("^[0-9]$"), (acc * 10 + F.ascii(c) - 48) % 97)
        .when(c.rlike("^[A-Z]$"), (acc * 100 + F.ascii(c) - 55) % 97)
        .otherwise(acc),
    ) == F.lit(1)


def strict(kind: Column, match: Column) -> Column:
    """The strict check of a kind."""
    digits = _digits(match)
    octet = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", match.rlike(rf"^{octet}(?:\.{octet}){{3}}$"))
        .when(kind == "card", luhn(digits))
        .when(kind == "phone", F.char_length(digits).between(9, 15))
        .when(kind == "masked_mail", match.rlike(r"(?i)(?:\.|dot[)\]}])\x20?[a-z]{2,24}$"))
        .when(kind == "local_phone", digits.rlike("^[2-9][0-9]{2}[2-9][0-9]{6}$"))
        .when(kind == "ssn", digits.rlike("^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$"))
        .otherwise((kind == "iban") & _mod97(match))
    )


def candidates(docs: DataFrame) -> DataFrame:
    """(row, doc_id, key, kind, start, end, match, left, right): every generator's spans, and one row with a
    null kind for each document without any; ``key`` is a hash of the text. Positions are running sums of piece lengths, so the
    work is linear in the number of matches."""
    text = F.translate(F.coalesce("text", F.lit("")), MARK, SPARE)
    row = F.monotonically_increasing_id().alias("row")
    rows = docs.select(row, "doc_id", F.xxhash64("text").alias("key"), text.alias("text"))
    nothing = F.array().cast(
        "array<struct<kind:string,place:int,size:bigint,match:string,tail:string,head:string>>"
    )
    cut = F.concat(*[F.coalesce(_pieces(k, F.col("text")), nothing) for k in GENERATORS])
    flat = rows.select("row", "doc_id", "key", F.explode_outer(cut).alias("c")).select("row", "doc_id", "key", "c.*")
    along = Window.partitionBy("row", "kind").orderBy("place")
    before = F.sum("size").over(along) - F.col("size")
    placed = flat.select(
        "row",
        "doc_id",
        "key",
        "kind",
        "match",
        F.when(F.col("kind").isNotNull(), before).alias("start"),
        F.when(F.col("kind").isNotNull(), F.col("size") + before).alias("end"),
        F.lag("tail").over(along).alias("left"),
        F.lead("head").over(along).alias("right"),
    )
    return placed.where("kind is null or match is not null")


def with_features(found: DataFrame) -> DataFrame:
    """Candidates with their strict check and the numeric features of the trees."""
    match = F.col("match")
    digits = _digits(match)
    left, right = F.coalesce("left", F.lit("")), F.coalesce("right", F.lit(""))

    def flag(c: Column) -> Column:
        return c.cast("double")

    columns = {
        "n_chars": F.char_length(match).cast("double"),
        "n_digits": F.char_length(digits).cast("double"),
        "digit_share": F.char_length(digits) / F.char_length(match),
        "n_separators": F.char_length(F.regexp_replace(match, r"[^\x20.()-]", "")).cast("double"),
        "n_groups": F.size(F.split(match, r"[^0-9A-Za-z]+")).cast("double"),
        "n_letters": F.char_length(F.regexp_replace(match, "[^A-Za-z]", "")).cast("double"),
        "has_at": flag(match.contains("@")),
        "has_plus": flag(match.startswith("+")),
        "has_paren": flag(match.contains("(")),
        "leading_zero": flag(match.startswith("0")),
        "glued_left": flag(left.rlike(r"[\p{L}\p{N}_]$")),
        "glued_right": flag(right.rlike(r"^[\p{L}\p{N}_]")),
        "line_start": flag((left == "") | left.endswith("\n")),
        **{name: flag(left.rlike(cue)) for name, cue in CUES.items()},
        **{f"is_{k}": flag(F.col("kind") == k) for k in KINDS},
    }
    return found.withColumn("strict", strict(F.col("kind"), match)).withColumns(
        {k: F.coalesce(v, F.lit(0.0)) for k, v in columns.items()}
    )


def _scored(model, rows: DataFrame) -> DataFrame:
    seen = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    return model.transform(seen).withColumn("score", vector_to_array("probability")[1])


def scored(found: DataFrame, rows: int = SAMPLE_CANDIDATES) -> DataFrame:
    """(row, kind, start, end, score, taken) of the candidates of the further kinds.

    Half of a bounded sample of all candidates trains the trees; all other candidates of a kind calibrate
    its threshold, the lowest at which its precision, shrunk towards that of all kinds, is reached. The
    fewer candidates a kind has, the more the others speak for it; a kind that never reaches the asked
    precision adds nothing. Without any candidate to calibrate on, strict checks alone decide.
    """
    known = found.where("kind is not null")
    n = known.count()
    more = found.where(F.col("kind").isin(*MORE_KINDS))
    if more.isEmpty():
        return more.select("row", "kind", "start", "end", F.lit(0.0).alias("score"), F.lit(False).alias("taken"))
    draw = F.pmod(F.xxhash64("doc_id", "kind", "start", "match"), F.lit(1 << 30))
    drawn = draw < int(min(1.0, rows / n) * (1 << 30))
    sample = known.where(drawn)
    sample = sample.withColumn("label", F.col("strict").cast("double"))
    half = F.pmod(F.xxhash64("match", "kind"), F.lit(2)) == 0
    labels = sample.where(half).agg(F.min("label"), F.max("label")).first()
    if labels[0] is None or labels[0] == labels[1]:
        # One class only: nothing to learn, every candidate has the score of that class.
        constant = F.lit(float(labels[0] or 0.0))
        more = more.withColumn("score", constant)
    else:
        seen = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(sample.where(half))
        trees = GBTClassifier(labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=1)
        model = trees.fit(seen.select("features", "label"))
        more = _scored(model, more)
    # One row per kind and score step: the precision of all candidates at or above the step.
    # At most 51 rows a kind come to the driver.
    steps = (
        more.where(~(drawn & half))
        .groupBy("kind", F.floor(F.col("score") * 50).alias("step"))
        .agg(F.count("*").alias("n"), F.sum(F.col("strict").cast("int")).alias("hits"))
        .collect()
    )

    def above(step: int, kind: str | None = None) -> tuple[int, int]:
        """Candidates with at least this score, of one kind or of all, and how many of them are right."""
        rows = [r for r in steps if r["step"] >= step and kind in (None, r["kind"])]
        return sum(r["n"] for r in rows), sum(r["hits"] or 0 for r in rows)

    limit = F.lit(2.0)
    for kind in MORE_KINDS:
        for step in range(51):
            (n, hits), (all_n, all_hits) = above(step, kind), above(step)
            pooled = all_hits / all_n if all_n else 1.0
            if hits + PRIOR_CANDIDATES * pooled >= PRECISION * (n + PRIOR_CANDIDATES):
                limit = F.when(F.col("kind") == kind, F.lit(step / 50)).otherwise(limit)
                break
    judged = more.withColumn("limit", limit)
    taken = F.col("strict") & (F.col("score") >= F.col("limit"))
    return judged.select("row", "kind", "start", "end", "score", taken.alias("taken"))


def _joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def personal_data(docs: DataFrame, rows: int = SAMPLE_CANDIDATES) -> DataFrame:
    """(row, doc_id, key, base, chosen) of every row of ``docs`` (doc_id, text).

    ``base`` and ``chosen`` are arrays of spans (start, rank, kind, end) in code points, ordered by
    start and then kind; ``chosen`` holds the base spans and those the method adds. Null and empty
    texts have none. ``row`` numbers the rows of the input as they were read, once; ``key`` is a hash of
    the text, by which a later read finds its row. Rows that repeat give
    equal rows; other columns are ignored; a null doc_id is kept; an empty table gives an empty
    result. The spans of one document meet in one task, never those of several.
    """
    found = stored(with_features(candidates(docs)), "pii-candidates")
    rank = F.array_position(F.lit(list(KINDS)), F.col("kind"))
    span = F.struct("start", rank.alias("rank"), "kind", "end", F.col("score").alias("score"))
    base = found.where("kind is null or (strict and kind in ('email', 'ip', 'card', 'phone'))").select(
        "row", "doc_id", "key", "kind", "start", "end", F.lit(2.0).alias("score")
    )
    rest = found.where("kind is not null and not (strict and kind in ('email', 'ip', 'card', 'phone'))")
    # Every document keeps a row even if all its candidates are dropped.
    rest = rest.select(
        "row", "doc_id", "key", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("long").alias("start"),
        F.lit(None).cast("long").alias("end"), F.lit(None).cast("double").alias("score"),
    )
    added = scored(found, rows).where("taken").select(
        "row", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("key"), "kind", "start", "end", "score"
    )
    together = base.unionByName(rest).unionByName(added)
    spans = F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), span)))
    grouped = together.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("key").alias("key"), spans.alias("spans")
    )
    fixed = F.filter("spans", lambda s: s["score"] == 2.0)
    more = F.filter("spans", lambda s: s["score"] < 2.0)

    def meets(a, b):
        return (a["start"] < b["end"]) & (b["start"] < a["end"])

    def better(a, b):
        return (a["score"] > b["score"]) | (
            (a["score"] == b["score"])
            & ((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["rank"] < b["rank"])))
        )

    grouped = grouped.withColumns({"base": fixed, "more": more})
    free = F.filter(
        "more",
        lambda s: ~F.exists("base", lambda b: meets(s, b)) & ~F.exists("more", lambda o: meets(s, o) & better(o, s)),
    )
    chosen = F.when(F.size("more") > 0, F.array_sort(F.concat("base", free))).otherwise(F.col("base"))
    return grouped.select("row", "doc_id", "key", "base", chosen.alias("chosen"))


def span_text(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return _joined(spans)


def redacted(docs: DataFrame, rows: int = SAMPLE_CANDIDATES) -> DataFrame:
    """``docs`` with every chosen span of ``text`` replaced by its kind in brackets; null texts stay null.

    Other columns, whatever their names, pass through. Overlapping spans are replaced as one, named by
    the first.
    """
    held = docs.select(F.struct("*").alias("doc"), F.xxhash64("text").alias("held_key"))
    found = personal_data(docs.select("doc_id", "text"), rows)
    pieces = F.aggregate(
        F.col("chosen"),
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["end"] <= acc["at"], acc)
        .when(s["start"] < acc["at"], F.struct(s["end"].alias("at"), acc["out"].alias("out")))
        .otherwise(
            F.struct(
                s["end"].alias("at"),
                F.concat(
                    acc["out"],
                    F.substring(F.col("doc.text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")),
                    F.lit("["), F.upper(s["kind"]), F.lit("]"),
                ).alias("out"),
            )
        ),
    )
    # Written first, so that its size is known: few spans are broadcast and the texts stay where they are.
    # Rows are found again by id and text, which hold for every read; equal rows have equal spans.
    hits = found.where(F.size("chosen") > 0).groupBy("doc_id", "key").agg(F.first("chosen").alias("chosen"))
    # The stored table's bytes are known: it is broadcast up to a bound, beyond which the texts are shuffled once.
    hits = broadcast_if_small(stored(hits, "pii-spans"), MAX_SPAN_BYTES)
    match = same(F.col("doc.doc_id"), F.col("doc_id")) & (F.col("held_key") == F.col("key"))
    both = held.join(hits, match, "left").withColumn("cut", pieces)
    rest = F.substring(F.col("doc.text"), (F.col("cut.at") + 1).cast("int"), F.char_length("doc.text"))
    text = F.when(F.col("cut").isNull(), F.col("doc.text")).otherwise(F.concat("cut.out", rest))
    return both.select(F.col("doc").withField("text", text).alias("doc")).select("doc.*")
