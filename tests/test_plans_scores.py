import __spark_entry__ as contract
import pyarrow as pa
import pytest

from textloom.catalog import evaluation
from textloom.functions import vectorized as V
from textloom.operators import scoring as H
from textloom.operators import trainsets as G

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["h09_compare_models", "h16_squared_preference_loss", "h20_clipped_surrogate"])
def test_positions_are_not_stored(spark, monkeypatch, name):
    labels = []
    keep = evaluation.materialize
    monkeypatch.setattr(evaluation, "materialize", lambda df, label="stage", **more: labels.append(label) or keep(df, label, **more))
    assert contract.queries()[name](spark, SF).count() == 1
    assert "unigrams" in labels and "tokens" not in labels


def test_models_meet_without_a_join(spark):
    rows = [("a", 1, 0, 1.0, "x"), ("a", 1, 0, 3.0, None), ("b", 1, 0, 2.0, "x"), ("b", 1, 0, None, "y"), ("a", 2, 0, 5.0, "x"),
            ("a", None, 0, 9.0, "x"), ("b", None, 0, 9.0, "x"), ("c", 1, 0, 7.0, "x")]
    scores = spark.createDataFrame(rows, "model string, seq_id bigint, pos bigint, loss double, pred string")
    met = H.compare_models(scores, "a", "b")
    # every row of one model meets every row of the other at a position: (1, 2), (1, -), (3, 2), (3, -)
    assert tuple(met.first()) == (2.0, 2.0, 0.5, 0.0, "same")
    assert "Join" not in met._jdf.queryExecution().optimizedPlan().toString()
    assert tuple(H.compare_models(scores.where("seq_id = 2"), "a", "b").first())[:3] == (None, None, None)


def test_ordinals_are_placed_once(spark, monkeypatch):
    placed = []
    keep = G.materialize
    monkeypatch.setattr(G, "materialize", lambda df, label="stage", **more: placed.append(label) or keep(df, label, **more))
    segments = spark.createDataFrame([(3, "cc"), (1, "ab"), (2, "ba")], "doc_id bigint, text string")
    rows = G.control_axes(segments).where("axis = 'noise'").collect()
    assert {(r["doc_id"], *sorted((r["chosen"], r["rejected"]))) for r in rows} == {(1, "ab", "ba"), (2, "ba", "cc"), (3, "ab", "cc")}
    assert placed.count("ordinals") == 1


def test_texts_become_python_strings_slice_by_slice():
    values = pa.array(["x"] * (V.ROWS + 1) + [None])
    assert [len(part) for part in V.text_slices(values)] == [V.ROWS, 2]
