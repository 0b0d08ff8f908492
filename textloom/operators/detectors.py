"""Data-quality detectors: one aggregate for the whole list, bounded samples."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T

# Residue patterns and gate thresholds (percent of documents).
WIKI_RESIDUE = r"-\{[^}]*\}-"
HTML_RESIDUE = r"<[^>]+>"
URL_PATTERN = r"https?://"
CONTROL_RESIDUE = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
SNIPPET_MARGIN = 25
SNIPPET_HEAD = 80


@dataclass(frozen=True)
class Detector:
    name: str
    test: Callable[[Column], Column]
    threshold_pct: float
    note: str
    pattern: str | None = None


def pattern_detector(name: str, pattern: str, threshold_pct: float, note: str) -> Detector:
    return Detector(name, lambda t: t.rlike(pattern), threshold_pct, note, pattern)


DETECTORS: tuple[Detector, ...] = (
    pattern_detector("wiki_markup", WIKI_RESIDUE, 0.5, "language-variant markup left over"),
    pattern_detector("html_residue", HTML_RESIDUE, 0.5, "HTML tags left over"),
    pattern_detector("control_chars", CONTROL_RESIDUE, 0.1, "control characters"),
    pattern_detector("url", URL_PATTERN, 5.0, "contains a URL"),
    Detector("symbol_spam", lambda t: T.symbol_ratio(t) > 0.3, 1.0, "too many symbols"),
    Detector("high_repetition", lambda t: T.repeat_ratio(t) > 0.3, 1.0, "one character dominates"),
    Detector("too_short", lambda t: F.length(T.strip_space(t)) < 50, 5.0, "shorter than 50 characters"),
)


def detector_hits(docs: DataFrame, text: str = "text", detectors: Sequence[Detector] = DETECTORS) -> DataFrame:
    """Per document one boolean column per detector; the text is dropped."""
    keep = [c for c in docs.columns if c != text]
    return docs.select(*keep, *[d.test(F.col(text)).alias(d.name) for d in detectors])


def _measured(share: Column, threshold: Column) -> list[Column]:
    return [F.round(share, 2).alias("pct"), threshold.alias("threshold_pct"), (share <= threshold).alias("pass")]


def detector_report(
    docs: DataFrame, text: str = "text", detectors: Sequence[Detector] = DETECTORS, by: Sequence[str] = ()
) -> DataFrame:
    """Hits, percentage and pass flag per detector (per ``by`` group), in one pass."""
    counts = (
        detector_hits(docs.select(*by, text), text, detectors)
        .groupBy(*by)
        .agg(F.count("*").alias("total_docs"), *[F.count_if(d.name).alias(d.name) for d in detectors])
    )
    long = counts.select(
        *by,
        "total_docs",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(d.name).alias("name"),
                        F.col(d.name).alias("hits"),
                        F.lit(float(d.threshold_pct)).alias("limit"),
                        F.lit(d.note).alias("note"),
                    )
                    for d in detectors
                ]
            )
        ),
    )
    share = F.col("hits") / F.greatest(F.col("total_docs"), F.lit(1)) * 100
    return long.select(*by, "name", "hits", "total_docs", *_measured(share, F.col("limit")), "note")


def gate(report: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``all_pass``: every detector within its threshold."""
    return report.groupBy(*by).agg(
        F.max("total_docs").alias("total_docs"), F.bool_and("pass").alias("all_pass")
    )


def _snippet(text: Column, d: Detector) -> Column:
    if d.pattern is None:
        return F.substring(F.replace(T.strip_space(text), F.lit("\n"), F.lit(" ")), 1, SNIPPET_HEAD)
    around = f"(?s).{{0,{SNIPPET_MARGIN}}}?(?:{d.pattern}).{{0,{SNIPPET_MARGIN}}}"
    hit = F.regexp_extract(text, around, 0)
    return F.concat(F.lit("…"), F.replace(hit, F.lit("\n"), F.lit(" ")), F.lit("…"))


def problem_samples(
    docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 3, detectors: Sequence[Detector] = DETECTORS
) -> DataFrame:
    """First ``n`` hits per detector in document order, with a short excerpt.

    The rank filter lets Spark cut every partition to ``n`` rows per detector
    before the shuffle, so a detector that hits everything stays cheap.
    """
    names = F.filter(
        F.array(*[F.when(d.test(F.col(text)), F.lit(d.name)) for d in detectors]), lambda v: v.isNotNull()
    )
    hits = docs.select(key, text, names.alias("names")).select(key, text, F.explode("names").alias("name"))
    rank = F.row_number().over(Window.partitionBy("name").orderBy(key))
    first = hits.select("*", rank.alias("rank")).where(F.col("rank") <= n)
    excerpt = F.coalesce(*[F.when(F.col("name") == d.name, _snippet(F.col(text), d)) for d in detectors])
    return first.select("name", "rank", key, excerpt.alias("sample"))


def report_document(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 3,
                    detectors: Sequence[Detector] = DETECTORS) -> DataFrame:
    """The whole report as one nested row: total_docs, all_pass, detectors with samples."""
    rows = detector_report(docs, text, detectors)
    samples = problem_samples(docs, key, text, n, detectors).groupBy("name").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "sample"))), lambda s: s["sample"]).alias("samples")
    )
    order = {d.name: i for i, d in enumerate(detectors)}
    position = F.coalesce(*[F.when(F.col("name") == name, F.lit(i)) for name, i in order.items()])
    joined = rows.join(samples, "name", "left").withColumn("samples", F.coalesce("samples", F.array().cast("array<string>")))
    entry = F.struct(position.alias("position"), "name", "hits", "pct", "threshold_pct", "pass", "note", "samples")
    return joined.groupBy().agg(
        F.max("total_docs").alias("total_docs"),
        F.bool_and("pass").alias("all_pass"),
        F.transform(F.array_sort(F.collect_list(entry)), lambda e: e.dropFields("position")).alias("detectors"),
    )


def history_entry(report: DataFrame, label: Column) -> DataFrame:
    """One history row: label, all_pass, percentage per detector."""
    return report.groupBy().agg(
        F.bool_and("pass").alias("all_pass"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "pct")))).alias("pct"),
    ).select(label.alias("label"), "all_pass", "pct")


def upsert_history(history: DataFrame, entry: DataFrame, keep: int = 10) -> DataFrame:
    """Replace the entry of the same label, append at the end, keep the newest ``keep``."""
    others = history.join(entry.select("label"), "label", "left_anti")
    last = history.agg(F.max("seq")).scalar()
    added = entry.select("label", (F.coalesce(last, F.lit(0)) + 1).cast("bigint").alias("seq"), "all_pass", "pct")
    return (
        others.select("label", "seq", "all_pass", "pct").unionByName(added)
        .orderBy(F.col("seq").desc()).limit(keep)
    )


def compare_labels(history: DataFrame, labels: Sequence[str], thresholds: Sequence[Detector] = DETECTORS) -> DataFrame:
    """Detector x label matrix of percentages next to each threshold."""
    limits = F.coalesce(*[F.when(F.col("name") == d.name, F.lit(float(d.threshold_pct))) for d in thresholds])
    return (
        history.groupBy("name").pivot("label", list(labels)).agg(F.first("pct"))
        .withColumn("threshold_pct", limits)
    )
