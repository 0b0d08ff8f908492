"""Secret scans over a content-addressed ledger, with DataFrame functions alone.

Every version of a document is a blob, named by the SHA-256 of its text.  The
ledger holds which (blob, rule, version of the rule) have been scanned and what
was found.  A run names the blobs of its rows, takes off the pairs that the
ledger has, scans one text of each remaining blob for its remaining rules, and
joins the findings back to all rows, so that a text is scanned once however many
paths carry it, and again only for a rule that changed.

The texts of unseen blobs are met by a join on (doc_id, blob).  Where few are
unseen their keys are broadcast (at most ``BROADCAST_ROWS``, counted first) and
no text moves; otherwise texts shuffle once, without a sort.  A first run has
nothing to skip but copies: there the patterns are tried before the join, and
only texts with a match shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import stored

BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Rule:
    """A pattern; a match counts if its group ``group`` has at least ``least`` characters."""

    name: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


# What a secret looks like.  The first three are the base kinds.
_KEYWORDS = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "(password|passwd|secret|token|api_?key)")
RULES = (
    Rule("assign", _KEYWORDS + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
BASE = ("assign", "access", "hex")

Ledger = tuple[DataFrame, DataFrame]  # scanned (blob, rule), findings (blob, rule, start, end)


def versions(docs: DataFrame) -> DataFrame:
    """(doc_id, blob, text): each row's text under its content address; null text is empty."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.sha2(text, 256).alias("blob"), text.alias("text"))


def _matches(rule: Rule) -> Column:
    """Per match of the rule: characters between it and the match before, its length, and whether it counts."""
    pattern = F.lit(rule.pattern)
    gaps = F.transform(F.split("text", rule.pattern, -1), lambda s: F.length(s))
    whole = F.transform(F.regexp_extract_all("text", pattern, F.lit(0)), lambda s: F.length(s))
    part = whole if rule.group == 0 else F.transform(F.regexp_extract_all("text", pattern, F.lit(rule.group)), lambda s: F.length(s))
    found = F.transform(
        F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("gap"), whole.alias("size"), part.alias("part")),
        lambda m, i: F.struct(F.lit(rule.key).alias("rule"), i.alias("nth"), m["gap"].alias("gap"), m["size"].alias("size"), (m["part"] >= rule.least).alias("counts")),
    )
    wanted = F.array_contains("rules", rule.key) & F.col("text").rlike(rule.pattern)
    return F.when(wanted, found).otherwise(F.array().cast("array<struct<rule:string,nth:int,gap:int,size:int,counts:boolean>>"))


def scan(unseen: DataFrame, rules: Sequence[Rule], only_wanted: bool) -> DataFrame:
    """(blob, rule, start, end) for rows (blob, text, rules): code points, end exclusive.

    ``only_wanted`` ties each pattern to the rules that a blob still needs, so
    that no text is searched before the ledger has been asked.
    """
    tests = [F.array_contains("rules", r.key) & F.col("text").rlike(r.pattern) if only_wanted else F.col("text").rlike(r.pattern) for r in rules]
    hit = reduce(Column.__or__, tests)
    matches = unseen.where(hit).select("blob", F.explode(F.concat(*[_matches(r) for r in rules])).alias("m"))
    place = Window.partitionBy("blob", "m.rule").orderBy("m.nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = matches.select("blob", "m.*", F.sum(F.col("m.gap") + F.col("m.size")).over(place).alias("end"))
    return ends.where("counts").select("blob", "rule", (F.col("end") - F.col("size")).alias("start"), "end")


def extend(docs: DataFrame, ledger: Ledger | None = None, rules: Sequence[Rule] = RULES) -> tuple[DataFrame, Ledger]:
    """(paths, ledger): the rows' blobs, and the ledger with all their (blob, rule) pairs scanned.

    Both tables of the ledger lie in the shared folder; the caller keeps them
    for the next run by writing them where it likes.
    """
    spark = docs.sparkSession
    named = versions(docs)
    paths = stored(named.select("doc_id", "blob"), "paths")
    every = F.array(*[F.lit(r.key) for r in rules])
    # one path of each blob stands for it
    blobs = paths.groupBy("blob").agg(F.min("doc_id").alias("doc_id"))
    if ledger is None:
        scanned = spark.createDataFrame([], "blob string, rule string")
        findings = spark.createDataFrame([], "blob string, rule string, start bigint, end bigint")
        open_blobs = blobs.withColumn("rules", every)
    else:
        scanned, findings = ledger
        done = scanned.groupBy("blob").agg(F.collect_set("rule").alias("done"))
        open_blobs = blobs.join(done, "blob", "left").withColumn("rules", F.array_except(every, F.coalesce("done", F.array().cast("array<string>"))))
    open_blobs = stored(open_blobs.where(F.size("rules") > 0).select("blob", F.col("doc_id").alias("at"), "rules"), "unseen")
    few = open_blobs.count() <= BROADCAST_ROWS
    keys = F.broadcast(open_blobs.withColumnRenamed("blob", "own")) if few else open_blobs.withColumnRenamed("blob", "own").hint("shuffle_hash")
    unseen = named.join(keys, named["doc_id"].eqNullSafe(keys["at"]) & (named["blob"] == keys["own"])).select("blob", "text", "rules")
    new = stored(scan(unseen, rules, ledger is not None).distinct(), "findings")
    fresh = open_blobs.select("blob", F.explode("rules").alias("rule"))
    return paths, (scanned.unionByName(fresh), findings.unionByName(new))


def report(paths: DataFrame, findings: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Findings joined back to all paths: counts of the base kinds, a digest of their spans, and all spans."""
    order = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.key, i)])
    kind = F.create_map(*[F.lit(x) for r in rules for x in (r.key, r.name)])
    known = findings.where(F.col("rule").isin(*[r.key for r in rules])).withColumn("kind", kind[F.col("rule")])
    span = F.concat_ws(":", "kind", "start", "end")

    def joined(rows: Column) -> Column:
        # a base kind without a finding leaves a null, which the lists leave out
        return F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda s: s["span"]), ",")

    entry = F.struct(F.col("start"), order[F.col("rule")].alias("nth"), span.alias("span"))
    base = F.col("kind").isin(*BASE)
    per_blob = known.groupBy("blob").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in BASE],
        F.sha2(joined(F.when(base, entry)), 256).alias("base_sha256"), joined(entry).alias("spans"),
    )
    per_blob = stored(per_blob, "per-blob")
    none = F.sha2(F.lit(""), 256)
    return paths.join(per_blob, "blob", "left").select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("bigint").alias(f"n_{k}") for k in BASE],
        F.coalesce("base_sha256", none).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
    )


def secrets(docs: DataFrame, ledger: Ledger | None = None, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Per row: counts, digest and spans of the secrets in its text.

    Null text counts as empty and has none.  Rows of equal text share a blob
    and so a result; repeated rows each get a row; several rows of one doc_id
    are its versions.  A null doc_id stays null.  An empty table gives an empty
    result; further columns are ignored.
    """
    paths, (_, findings) = extend(docs, ledger, rules)
    return report(paths, findings, rules)


def oracle_sql(rules: Sequence[Rule] = RULES) -> str:
    """The same result in DuckDB SQL."""
    parts = []
    for n, r in enumerate(rules):
        pattern = r.pattern.replace("'", "''")
        parts.append(f"""
SELECT doc_id, {n} AS nth, '{r.name}' AS kind, unnest(range(1, len(whole) + 1)) AS i, whole, part, gaps, {r.least} AS least FROM (
  SELECT doc_id, regexp_extract_all(t, '{pattern}', 0) AS whole, regexp_extract_all(t, '{pattern}', {r.group}) AS part, string_split_regex(t, '{pattern}') AS gaps FROM d)""")
    base = ", ".join(f"'{k}'" for k in BASE)
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(parts)}),
s AS (SELECT doc_id, nth, kind, list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda w: length(w))), 0) AS a, length(whole[i]) AS n
  FROM m WHERE length(part[i]) >= least),
f AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)},
  string_agg(kind || ':' || a::BIGINT || ':' || (a + n)::BIGINT, ',' ORDER BY a, nth) FILTER (kind IN ({base})) AS b,
  string_agg(kind || ':' || a::BIGINT || ':' || (a + n)::BIGINT, ',' ORDER BY a, nth) AS spans FROM s GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in BASE)}, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN f USING (doc_id)"""
