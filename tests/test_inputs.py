"""Readers on real files: named files of any ending, entries over several lines, missing brains."""

import json

import pytest

from dendrospark.operators.ordering import exact_percentiles
from dendrospark.sources import readers as RD


def test_named_files_of_any_ending(spark, tmp_path):
    one = {"id": "h1", "status": "done", "hypothesis": "x", "surprisal": "0.5"}
    (tmp_path / "run.txt").write_text(json.dumps([one]))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.json").write_text(json.dumps({"records": [one | {"id": "h2"}]}))
    (tmp_path / "sub" / "notes.md").write_text("not an export")
    got = RD.read_hypotheses(spark, [str(tmp_path / "run.txt"), str(tmp_path / "sub")]).select("run", "id").collect()
    assert sorted(map(tuple, got)) == [("a", "h2"), ("run.txt", "h1")]


def test_lookup_entries_over_several_lines(spark, tmp_path):
    text = ('{\\rtf1 {\\field{\\*\\fldinst{HYPERLINK\n "http://seg/111111, no.v1"}}{\\fldrslt \\cf2 123456,\n seg_1.v2}}\\par\n'
            "\\f0 654321 , seg_2\\'20x\\par 123456, late.v9}")
    (tmp_path / "lookup.rtf").write_text(text)
    got = {r["brain_id"]: r["segmentation_id"] for r in RD.read_brain_lookup(spark, str(tmp_path / "lookup.rtf")).collect()}
    assert got == {"123456": "seg_1.v2", "654321": "seg_2"}


def test_missing_brain_is_an_error(spark):
    lookup = spark.createDataFrame([("1", "s")], "brain_id string, segmentation_id string")
    wanted = spark.createDataFrame([("1",), ("2",)], "brain_id string")
    assert RD.require_brains(lookup, wanted.limit(1)).count() == 1
    with pytest.raises(Exception, match="no segmentation for brain 2"):
        RD.require_brains(lookup, wanted).collect()


def test_percentiles_with_ties(spark):
    values = [1.0] * 50 + [2.0] * 3 + [9.0] * 47
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    got = exact_percentiles(df, "v", {"p10": 0.1, "p50": 0.5, "p51": 0.51, "p100": 1.0}).first()
    assert (got["p10"], got["p50"], got["p100"]) == (1.0, 1.5, 9.0) and abs(got["p51"] - 2.0) < 1e-9
