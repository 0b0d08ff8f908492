"""Held-out accuracy of the classifiers, and that nothing but text and training labels counts."""

import numpy as np
from pyspark.sql import functions as F

from textloom.llm import language, quality

SF = "/root/testdata/sf0.01"


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert len(rows) > 50
    good, bad = rows.score[rows.quality == 1].to_numpy(), rows.score[rows.quality == 0].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.98
    assert (rows.predicted == rows.quality).mean() > 0.97
    # labels of held-out rows, languages and sources change no score
    other = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.classify(docs.withColumns({"lang": F.lit("x"), "source": F.lit("x")}), other).toPandas().set_index("doc_id").score
    assert np.allclose(again.loc[rows.doc_id].to_numpy(), rows.score.to_numpy(), atol=1e-4)


def test_votes_are_exact_cosines():
    draw = np.random.default_rng(1)
    points = quality.unit(draw.standard_normal((40, 6)).astype(np.float32))
    model = {"points": points, "y": (draw.random(40) < 0.5).astype(np.float32), "vote": np.ones(40, np.float32), "prior": 0.5}
    queries = quality.unit(draw.standard_normal((700, 6)).astype(np.float32))
    got = quality.vote(queries, model, 5)
    for q, score in zip(queries[:50], got):
        near = points @ q
        top = np.argsort(-near)[:5]
        weight = near[top].clip(0).astype(float) ** 4
        assert abs(score - (weight * model["y"][top]).sum() / weight.sum()) < 1e-5


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(rows) > 100 and (rows.lang == rows.lang_pred).mean() > 0.98 and rows.score.between(0, 1).all()
    hidden = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit("xx")).otherwise(F.col("lang")))
    again = language.identify(hidden).toPandas().set_index("doc_id")
    assert (again.loc[rows.doc_id].lang_pred.to_numpy() == rows.lang_pred.to_numpy()).all()


def test_far_texts_are_rejected(spark):
    learned = [(i, "the cat sat on the mat with a hat " * 3, "en") for i in range(40)] + [(100 + i, "der hund lief durch den wald und schlief " * 3, "de") for i in range(40)]
    asked = [(1000, "the cat sat on the mat", None), (1001, "qqq zzz xxx jjj", None), (1002, "12 34", None)]
    got = {r["doc_id"]: (r["lang_pred"], r["rejected"]) for r in language.identify(spark.createDataFrame(learned + asked, "doc_id bigint, text string, lang string")).collect()}
    assert got[1001][1] and got[1002] == ("und", True) and got[1][0] == "en" and got[101][0] == "de" and not got[1][1]


def test_clusters():
    draw = np.random.default_rng(2)
    centres = quality.unit(draw.standard_normal((3, 20)).astype(np.float32))
    rows = quality.unit(np.repeat(centres, 30, axis=0) + 0.05 * draw.standard_normal((90, 20)).astype(np.float32))
    found = language.clusters(rows, 3)
    assert ((centres @ found.T).max(axis=1) > 0.98).all()


def test_language_learns_from_permitted_rows_only(spark):
    """Other texts in held-out rows and in rows without a language change no other row's result."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    off = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 7 == 0, None).otherwise(F.col("lang")))
    unseen = off | F.col("lang").isNull()
    other = docs.withColumn("text", F.when(unseen, F.concat(F.lit("zzq xxw "), F.reverse("text"))).otherwise(F.col("text")))
    learned = lambda d: {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(d).where(~F.col("held_out")).collect() if r["doc_id"] % 7}
    assert learned(docs) == learned(other)
