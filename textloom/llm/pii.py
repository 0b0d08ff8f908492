"""Personal data: candidates by generous patterns, chosen by gradient-boosted trees.

The base kinds are exact patterns with a validity test; their valid matches are
always reported.  For each of them a generator proposes wider candidates (spelt
out or bracketed addresses, numbers without a country sign, other separators),
which may overlap.  A candidate on a valid base match of its family is a known
positive; one on a match that fails its test, or on another family's match, is a
known negative.  Boosted trees learn from these by format and context, never by
the sign or checksum that made the label; candidates of neither kind count as
weak negatives.  Per family a threshold is calibrated on labelled rows kept from
learning, and unlabelled candidates above it are added; those that overlap are
joined to one span.

Everything runs in DataFrame functions and the trees of Spark's own library.
Texts are scanned once; only candidates with their surroundings move, one copy
of each text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import stored

#: The trees learn from at most this many positives, negatives and unlabelled rows each.
FIT_ROWS = 10_000
TREES, DEPTH = 20, 3
UNLABELLED_WEIGHT = 0.2
#: Share of known positives that held-out rows above a threshold must have, how many there must be, and the share of positives a threshold goes down to.
PRECISION, LEAST_ROWS, COVERED = 0.98, 20, 0.95
BINS = 50
LEFT, RIGHT, ENDING = 24, 12, 80


@dataclass(frozen=True)
class Kind:
    """A family: the exact pattern, its test, the generous pattern, and a cheap test that any match implies."""

    name: str
    pattern: str
    valid: Callable[[Column], Column]
    wide: str
    hint: str


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _n_digits(match: Column, least: int, most: int) -> Column:
    return F.length(digits(match)).between(least, most)


# What personal data looks like.  Repeats are possessive and runs
# are entered at their first character only (or where the last match ended), so
# that long runs cost no more than their length; the matches are the same.
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
_AT = r"(?:@|\x20?[\[({]\x20?(?:at|AT|@)\x20?[\])}]\x20?|\x20(?:at|AT)\x20)"
_DOT = r"(?:\.|\x20?[\[({]\x20?(?:dot|DOT|\.)\x20?[\])}]\x20?|\x20(?:dot|DOT)\x20)"
_PART = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]?)"
KINDS = (
    Kind("email", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++", lambda m: F.lit(True),
         rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++{_AT}{_HOST}++(?:{_DOT}{_HOST}++)++", "@|at|AT"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
         r"(?<![0-9])[0-9]{1,4}(?:\x20?[\[(]?[.,:][\])]?\x20?[0-9]{1,4}){3}(?![0-9])", "[0-9]"),
    Kind("card", r"[0-9](?:[\x20-]?+[0-9])++", lambda m: _n_digits(m, 13, 19) & F.call_function("luhn_check", digits(m)),
         r"(?<![0-9])[0-9]{4}(?:[\x20._/ -]{0,3}[0-9]{4}){2,3}(?:[\x20._/ -]{0,3}[0-9]{1,3})?(?![0-9])", "[0-9]"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: _n_digits(m, 9, 15),
         r"(?<![0-9A-Za-z+])(?:\+|00)?\(?[0-9]{1,4}\)?(?:[\x20./-]{1,2}\(?[0-9]{2,4}\)?){2,4}(?![0-9])", "[0-9]"),
)
# Words that speak for a family, or against all of them, before a candidate.
WORDS = {
    "email": "mail|contact|write to|reach|adresse|correo",
    "ip": r"\bip\b|host|server|address|node|ping",
    "card": "card|visa|master|amex|credit|debit|karte|carte|tarjeta",
    "phone": r"phone|call|tel\b|tel[.:]|mobile|cell|fax|dial|whatsapp|telefon|tél|móvil",
    "other": r"version|\bv$|order|isbn|page|chapter|figure|invoice|date|section|[$€£%#]\s?$",
}
NAMES = [k.name for k in KINDS]


# ---- candidates ----------------------------------------------------------------

def _found(kind: Kind, wide: bool) -> Column:
    """Per match in ``text``: what it says, its size, the characters since the last match, and what surrounds it."""
    pattern = kind.wide if wide else kind.pattern
    matches = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    pieces = F.split("text", pattern, -1)
    rows = F.arrays_zip(F.slice(pieces, 1, F.size(matches)).alias("before"), F.slice(pieces, F.lit(2), F.size(matches)).alias("after"), matches.alias("m"))
    out = F.transform(rows, lambda r, i: F.struct(
        F.lit(kind.name).alias("family"), F.lit(wide).alias("wide"), i.alias("nth"), F.length(r["before"]).alias("gap"), F.length(r["m"]).alias("size"),
        r["m"].alias("m"), F.right(r["before"], F.lit(LEFT)).alias("before"), F.left(r["after"], F.lit(RIGHT)).alias("after")))
    none = F.array().cast("array<struct<family:string,wide:boolean,nth:int,gap:int,size:int,m:string,before:string,after:string>>")
    return F.when(F.col("text").rlike(kind.hint) & F.col("text").rlike(pattern), out).otherwise(none)


def scanned(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, blob, found): matches of all patterns, and the content address of a text that has any."""
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = rows.select("doc_id", "text", F.concat(*[_found(k, wide) for k in KINDS for wide in (False, True)]).alias("found"))
    return found.select("doc_id", F.when(F.size("found") > 0, F.unhex(F.sha2("text", 256))).alias("blob"), "found")


def candidates(found: DataFrame) -> DataFrame:
    """(blob, family, wide, start, end, m, before, after, valid, failed): one copy of each text's matches, with places.

    ``failed``: the match looks like its kind but does not pass the test.
    """
    rows = found.where("blob IS NOT NULL").select("blob", F.explode("found").alias("c")).select("blob", "c.*").distinct()
    place = Window.partitionBy("blob", "family", "wide").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(place)).withColumn("start", F.col("end") - F.col("size"))
    m = F.col("m")
    passes = reduce(lambda out, k: out.when(F.col("family") == k.name, k.valid(m)), KINDS[1:], F.when(F.col("family") == KINDS[0].name, KINDS[0].valid(m)))
    plausible = F.when(F.col("family") == "card", _n_digits(m, 13, 19)).otherwise(F.lit(True))
    return placed.select(
        "blob", "family", "wide", "start", "end", "m", "before", "after",
        (~F.col("wide") & passes).alias("valid"), (~F.col("wide") & ~passes & plausible).alias("failed"))


def labelled(rows: DataFrame) -> DataFrame:
    """Candidates of the generators with ``label``: 1 on a valid base match of the family, 0 on a failed one or another family's, else null."""
    upto = Window.partitionBy("blob").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    behind = Window.partitionBy("blob").orderBy(F.desc("start")).rowsBetween(Window.unboundedPreceding, -1)  # those further on

    def touched(marked: Column) -> Column:
        reach, ahead = F.max(F.when(marked, F.col("end"))).over(upto), F.min(F.when(marked, F.col("start"))).over(behind)
        return F.coalesce(reach > F.col("start"), F.lit(False)) | F.coalesce(ahead < F.col("end"), F.lit(False))

    marks = {k.name: touched(F.col("valid") & (F.col("family") == k.name)) for k in KINDS}
    seen = rows.withColumns({f"on_{k}": v for k, v in marks.items()} | {"on_failed": touched(F.col("failed"))}).where("wide")
    own = reduce(Column.__or__, [(F.col("family") == k) & F.col(f"on_{k}") for k in NAMES])
    other = reduce(Column.__or__, [F.col(f"on_{k}") for k in NAMES])
    label = F.when(own, 1).when(other | F.col("on_failed"), 0)
    return seen.select("blob", "family", "start", "end", "m", "before", "after", label.alias("label"))


# ---- features ------------------------------------------------------------------

def features() -> dict[str, Column]:
    """Format, in plain dress, and context of a candidate.

    What tells a base match from a wider one (signs, brackets, spelt-out
    separators, a country code) and what its test looks at (a checksum) take no
    part, so that the trees cannot learn the labels' own rule.  The format is
    that of a candidate's last ENDING characters.
    """
    m, before, after = F.right(F.col("m"), F.lit(ENDING)), F.lower("before"), F.col("after")
    plain = F.regexp_replace(F.regexp_replace(m, _AT, "@"), _DOT, ".")
    runs = F.reverse(F.transform(F.filter(F.split(m, "[^0-9]+"), lambda r: r != ""), lambda r: F.length(r)))  # from the last to the first
    mail = F.col("family") == "email"
    name, host = F.regexp_extract(plain, "^([^@]*)@", 1), F.regexp_extract(plain, "@(.*)$", 1)
    out = {
        "name": F.when(mail, F.least(F.length(name), F.lit(32))), "name_digits": F.when(mail, F.least(F.length(digits(name)), F.lit(16))),
        "name_signs": F.when(mail, F.least(F.length(F.regexp_replace(name, "[A-Za-z0-9]", "")), F.lit(8))), "host": F.when(mail, F.least(F.length(host), F.lit(32))),
        "labels": F.when(mail, F.least(F.size(F.split(host, r"\.")), F.lit(8))), "ending": F.when(mail, F.least(F.length(F.regexp_extract(plain, "([A-Za-z]*)$", 1)), F.lit(16))),
        "last": F.get(runs, F.lit(0)), "second": F.get(runs, F.lit(1)), "third": F.get(runs, F.lit(2)), "longest": F.array_max(runs),
        "distinct_digits": F.least(F.size(F.array_distinct(F.split(digits(m), ""))), F.lit(6)),
        "parts_fit": m.rlike(rf"^[^0-9]*{_PART}(?:[^0-9]+{_PART})*[^0-9]*$").cast("int"),
        "after_letter": before.rlike(r"\p{L}$").cast("int"), "after_space": before.rlike(r"\s$").cast("int"), "at_start": (before == "").cast("int"),
        "before_letter": after.rlike(r"^\p{L}").cast("int"), "before_sign": after.rlike(r"^[%$€£°]").cast("int"), "before_space": after.rlike(r"^\s").cast("int"),
    }
    out |= {f"word_{k}": before.rlike(v).cast("int") for k, v in WORDS.items()}
    out |= {f"is_{k}": (F.col("family") == k).cast("int") for k in NAMES}
    return {k: F.coalesce(v, F.lit(0)).cast("double").alias(k) for k, v in out.items()}


def featured(rows: DataFrame) -> DataFrame:
    """Rows with their feature vector, and ``kept``: out of learning, a quarter of the texts, by hash."""
    columns = features()
    assembled = VectorAssembler(inputCols=[f"f_{k}" for k in columns], outputCol="features").transform(rows.withColumns({f"f_{k}": v for k, v in columns.items()}))
    held = F.pmod(F.xxhash64("blob"), F.lit(4)) == 0
    return assembled.select("blob", "family", "start", "end", "label", "features", held.alias("held"))


# ---- learning ------------------------------------------------------------------

def learn(rows: DataFrame) -> GBTClassificationModel | None:
    """Boosted trees over at most FIT_ROWS rows of each label, those whose place hashes lowest; None without both labels."""
    order = F.xxhash64("blob", "family", "start")
    groups = [rows.where(~F.col("held") & test).orderBy(order, "blob", "family", "start").limit(FIT_ROWS) for test in (F.col("label") == 1, F.col("label") == 0, F.col("label").isNull())]
    weight = F.when(F.col("label").isNull(), UNLABELLED_WEIGHT).otherwise(1.0)
    sample = reduce(DataFrame.unionByName, groups).select(F.coalesce("label", F.lit(0)).cast("double").alias("label"), weight.alias("weight"), "features")
    sample = stored(sample, "pii-sample").coalesce(8)
    if sample.select("label").distinct().count() < 2:
        return None
    return GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=1).fit(sample)


def thresholds(scored: DataFrame) -> dict[str, float]:
    """Per family the score that COVERED of the held-out positives reach, or the lowest one above which enough rows are positive.

    Counted over all held-out labelled rows, in BINS bins.  A family whose
    scores never tell positives apart gets no threshold.
    """
    step = F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).alias("bin")
    held = scored.where(F.col("held") & F.col("label").isNotNull())
    counted = held.groupBy("family", step).agg(F.sum("label").alias("good"), F.count("*").alias("n")).collect()
    out = {}
    for family in NAMES:
        bins = sorted(((r["bin"], r["good"], r["n"]) for r in counted if r["family"] == family), reverse=True)
        total, good, n = sum(b[1] for b in bins), 0, 0
        for low, more, rows in bins:
            if good >= COVERED * total:
                break
            good, n = good + more, n + rows
            if n >= LEAST_ROWS and good >= PRECISION * n:
                out[family] = low / BINS
    return out


def added(rows: DataFrame) -> DataFrame | None:
    """(blob, kind, start, end): unlabelled candidates above their family's threshold, overlapping ones joined.

    The kind is that of the best-scored candidate of a joined span, ``<family>_like``.
    """
    rows = stored(featured(labelled(rows)), "pii-features")
    model = learn(rows)
    if model is None:
        return None
    scored = model.transform(rows).withColumn("score", vector_to_array("probability")[1]).select("blob", "family", "start", "end", "label", "held", "score")
    scored = stored(scored, "pii-scores")
    least = thresholds(scored)
    if not least:
        return None
    above = reduce(Column.__or__, [(F.col("family") == k) & (F.col("score") >= v) for k, v in least.items()])
    order = Window.partitionBy("blob").orderBy("start", F.desc("end"), "family")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = scored.where(F.col("label").isNull() & above).withColumn("new", F.coalesce(F.col("start") >= reach, F.lit(True)).cast("int"))
    grouped = opened.withColumn("group", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).groupBy("blob", "group")
    return grouped.agg(F.max_by("family", F.struct("score", "family")).alias("family"), F.min("start").alias("start"), F.max("end").alias("end")).select(
        "blob", F.concat("family", F.lit("_like")).alias("kind"), "start", "end")


# ---- report ----------------------------------------------------------------------

def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: counts of the base kinds, a digest of their spans, and all spans.

    Null text counts as empty and has none.  Rows of equal text have equal
    results; repeated rows each get a row; a null key stays null.  Long texts
    are searched whole.  An empty table, or one without both kinds of labelled
    candidates, adds nothing to the base kinds.  Of candidates that tie in
    score the family last in alphabetical order names a joined span.  Further
    columns are ignored.
    """
    found = stored(scanned(docs, key, text), "pii-found")
    rows = stored(candidates(found), "pii-candidates")
    base = rows.where("valid").select("blob", F.col("family").alias("kind"), "start", "end")
    more = added(rows)
    spans = base if more is None else base.unionByName(more)
    order = F.create_map(*[F.lit(x) for i, k in enumerate([*NAMES, *(f"{k}_like" for k in NAMES)]) for x in (k, i)])
    entry = F.struct(order[F.col("kind")].alias("nth"), F.col("start"), F.concat_ws(":", "kind", "start", "end").alias("span"))

    def joined(entries: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(entries)), lambda s: s["span"]), ",")

    per_blob = spans.groupBy("blob").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in NAMES],
        F.sha2(joined(F.when(F.col("kind").isin(*NAMES), entry)), 256).alias("base_sha256"), joined(entry).alias("spans"))
    none = [F.lit(0).cast("bigint").alias(f"n_{k}") for k in NAMES] + [F.sha2(F.lit(""), 256).alias("base_sha256"), F.lit("").alias("spans")]
    columns = [f"n_{k}" for k in NAMES] + ["base_sha256", "spans"]
    without = found.where("blob IS NULL").select("doc_id", *none)
    with_any = found.where("blob IS NOT NULL").select("doc_id", "blob").join(stored(per_blob, "pii-blobs"), "blob", "left")
    return without.unionByName(with_any.select("doc_id", *[F.coalesce(F.col(c), n).alias(c) for c, n in zip(columns, none)]))
