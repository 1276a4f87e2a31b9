"""Run directories are whole or refused."""

import pytest

from conspectus.sources import runs

FIELDS = {"span_id": "string", "label": "string", "tokens": "int"}


def test_a_run_round_trips(spark, tmp_path):
    spans = spark.createDataFrame([("s1", "a"), ("s2", None)], "span_id string, label string")
    basis = spark.createDataFrame([("r1",)], "row_id string")
    runs.write_run(spark, str(tmp_path / "run"), spans, basis, 2, FIELDS, tau=0.75)
    manifest, got, rows = runs.read_run(spark, str(tmp_path / "run"))
    assert manifest["tau"] == 0.75 and manifest["expected"] == 2 and rows.first().row_id == "r1"
    assert sorted((r.span_id, r.label, r.tokens) for r in got.collect()) == [("s1", "a", None), ("s2", None, None)]


@pytest.mark.parametrize("ids", [["s1"], ["s1", "s1"], ["s1", None], []])
def test_other_spans_than_expected_are_refused(spark, tmp_path, ids):
    spans = spark.createDataFrame([(i,) for i in ids], "span_id string")
    with pytest.raises(runs.IncompleteRun):
        runs.write_run(spark, str(tmp_path / "run"), spans, spans, 2, FIELDS)
    with pytest.raises(runs.IncompleteRun):
        runs.read_run(spark, str(tmp_path / "run"))


def test_unknown_fields_are_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        runs.write_run(spark, str(tmp_path / "run"), spark.createDataFrame([("s", 1)], "span_id string, other int"), spark.range(1), 1, FIELDS)
