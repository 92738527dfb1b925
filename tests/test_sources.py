"""Sources: CSV with a JSON cell, aliases, missing columns, JSON lines, synonyms, requests."""

import json
import os

from pyspark.sql import functions as F

from fieldcast.operators import answers as A
from fieldcast.sources import assessments as S

# Twelve profiles with four answers each (BH-1/BH-2 yes-no, CM-5 four grades, WQ-3 three options).
ROWS = [
    ("IN", "Wheat", "PartnerA", "True", "5", "10", ["Yes", "Yes", "Good", "Option1"]),
    ("IN", "Rice", "PartnerB", "False", "2", "5", ["No", "No", "Average", "Option2"]),
    ("US", "Corn", "PartnerA", "True", "8", "40", ["Yes", "No", "Excellent", "Option3"]),
    ("US", "Soybean", "PartnerB", "False", "3", "22", ["No", "Yes", "Poor", "Option1"]),
    ("IN", "Wheat", "PartnerB", "True", "6", "12", ["Yes", "Yes", "Good", "Option2"]),
    ("IN", "Rice", "PartnerA", "False", "1", "4", ["No", "No", "Average", "Option3"]),
    ("US", "Corn", "PartnerB", "True", "9", "35", ["Yes", "Yes", "Excellent", "Option1"]),
    ("US", "Soybean", "PartnerA", "True", "4", "18", ["Yes", "No", "Good", "Option2"]),
    ("IN", "Wheat", "PartnerA", "False", "7", "15", ["No", "Yes", "Poor", "Option3"]),
    ("IN", "Corn", "PartnerB", "True", "2", "9", ["Yes", "Yes", "Average", "Option1"]),
    ("US", "Rice", "PartnerA", "False", "5", "30", ["No", "No", "Good", "Option2"]),
    ("US", "Wheat", "PartnerB", "True", "10", "50", ["Yes", "Yes", "Excellent", "Option3"]),
]
IDS = ["BH-1", "BH-2", "CM-5", "WQ-3"]


def write_csv(folder, header="country_code,crop_name,Partner,irrigation,hired_workers,area,labelsAnswersMap",
              extra_rows=()):
    lines = [header]
    for c, crop, p, irr, hw, area, ans in ROWS:
        cell = json.dumps([{"soaId": i, "answer": a} for i, a in zip(IDS, ans)]).replace('"', '""')
        lines.append(f'{c},{crop},{p},{irr},{hw},{area},"{cell}"')
    lines.extend(extra_rows)
    path = os.path.join(folder, "assessments.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")
    return path


def test_src_assessments_reads_all_rows(spark, tmpdir_path):
    df = S.read_assessments(spark, write_csv(tmpdir_path))
    assert df.count() == 12
    assert df.select("row_id").distinct().count() == 12


def test_src_aliases(spark, tmpdir_path):
    df = S.read_assessments(spark, write_csv(tmpdir_path, header=" Country ,Crop,Partner,irrigation,hired_workers,area,"
                                                                  "labelsAnswersMap"))
    assert {"country_code", "crop_name", "partner"} <= set(df.columns)
    assert df.filter(F.col("partner") == "PartnerA").count() == 6


def test_src_missing_cols(spark, tmpdir_path):
    df = S.read_assessments(spark, write_csv(tmpdir_path))
    assert df.filter(F.col("subpartner").isNotNull() | F.col("planYear").isNotNull()).count() == 0


def test_explode_answers_48_long_rows(spark, tmpdir_path):
    raw = S.read_assessments(spark, write_csv(tmpdir_path))
    long = A.clean_indicators(A.explode_cells(raw))
    assert long.count() == 48
    assert sorted(r[0] for r in long.select("indicator").distinct().collect()) == IDS
    first = long.filter(F.col("row_id") == long.agg(F.min("row_id")).collect()[0][0]).orderBy("pos")
    assert [r["answer"] for r in first.collect()] == ["Yes", "Yes", "Good", "Option1"]


def test_explode_json_scalars_and_bad_cells(spark):
    rows = [(1, '[{"soaId": "A-1", "answer": true}, {"soaId": "A-2", "answer": 1.50}, {"soaId": "A-3", "answer": "true"}]'),
            (2, "not json"), (3, "[]"), (4, None), (5, '[{"soaId": "A-4", "answer": null}]')]
    raw = spark.createDataFrame(rows, "row_id long, labelsAnswersMap string")
    long = A.explode_cells(raw)
    got = {r["soaId"]: r["answer"] for r in long.collect()}
    assert got == {"A-1": "True", "A-2": "1.5", "A-3": "true", "A-4": None}
    assert A.bad_json_rows(raw).select("row_id").collect()[0][0] == 2


def test_clean_indicators_trims_and_drops_blank(spark):
    df = spark.createDataFrame([(" BH-1",), ("   ",), (None,), ("CM-5 ",)], "soaId string")
    assert sorted(r[0] for r in A.clean_indicators(df).select("indicator").collect()) == ["BH-1", "CM-5"]


def test_src_feedback_jsonl_drops_bad_lines(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "feedback.jsonl")
    with open(p, "w") as f:
        f.write(json.dumps({"indicator": "BH-1", "actual": "Yes", "input": {"partner": "PartnerA"}}) + "\n")
        f.write("{broken\n")
        f.write(json.dumps({"indicator": "BH-2", "actual": "No", "input": {}}) + "\n")
    df = S.read_feedback_jsonl(spark, p)
    assert sorted(r[0] for r in df.select("indicator").collect()) == ["BH-1", "BH-2"]
    out = os.path.join(tmpdir_path, "out")
    S.append_feedback_jsonl(df, out)
    S.append_feedback_jsonl(df, out)
    assert S.read_feedback_jsonl(spark, out).count() == 4


def test_src_synonyms(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "syn.json")
    with open(p, "w") as f:
        json.dump({"_usage": "note", "Weizen": "Wheat", "Wheat": "Wheat", " Mais ": "Corn"}, f)
    got = {r["local"]: r["canonical"] for r in S.read_synonyms(spark, p).collect()}
    assert got == {"Weizen": "Wheat", "Mais": "Corn"}
    assert S.read_synonyms(spark, os.path.join(tmpdir_path, "absent.json")).count() == 0


def test_request_to_profile(spark):
    req = spark.createDataFrame([(1, "IN", "Wheat", "PartnerA", None, "True", "5", 10.0, None, 2023)],
                                "request_id long, country string, crop string, partner string, subpartner string, "
                                "irrigation string, hired_workers string, area double, planYear int, plan_year int")
    r = S.request_to_profile(req).collect()[0]
    assert (r["country_code"], r["crop_name"], r["planYear"], r["area"]) == ("IN", "Wheat", 2023, 10.0)


def test_csv_end_to_end_pivot_meta_and_trainable(spark, tmpdir_path):
    from fieldcast.operators import countmodel as CM
    from fieldcast.operators import metadata as M
    raw = S.read_assessments(spark, write_csv(tmpdir_path))
    long = A.clean_indicators(A.explode_cells(raw, keep=["row_id", "country_code", "crop_name", "partner", "subpartner",
                                                         "irrigation", "hired_workers", "area", "planYear"]))
    assert A.pivot_answers(long, IDS, null_keys="drop").count() == 0       # H1: missing columns are null keys
    wide = A.pivot_answers(long, IDS)
    assert wide.count() == 12 and set(IDS) <= set(wide.columns)
    meta = {r["indicator"]: (r["type"], r["options"]) for r in M.question_meta(long, spark).collect()}
    assert meta["BH-1"] == ("radio", ["No", "Yes"])
    assert meta["CM-5"] == ("radio", ["Average", "Excellent", "Good", "Poor"])
    assert meta["WQ-3"] == ("radio", ["Option1", "Option2", "Option3"])
    first = A.first_answer(long)
    assert CM.trainable(first).count() == 0                               # v2: at least 20 samples
    assert CM.trainable(first, min_samples=10).count() == 4               # v1: at least 10


def test_only_cells_over_several_lines_need_whole_files(spark, tmpdir_path):
    from fieldcast.sources.assessments import has_line_breaks
    flat = 'country,labelsAnswersMap\nA,"[{""soaId"": ""BH-1""}]"\nB,"x, y"\n'
    for name, text, broken, rows in (("flat", flat, False, 2), ("broken", flat + 'C,"one\ntwo"\n', True, 3)):
        with open(f"{tmpdir_path}/{name}.csv", "w") as f:
            f.write(text)
        assert has_line_breaks(spark, f"{tmpdir_path}/{name}.csv") is broken
        got = S.read_assessments(spark, f"{tmpdir_path}/{name}.csv").collect()
        assert len(got) == rows and got[1].labelsAnswersMap == "x, y"
        assert not broken or got[2].labelsAnswersMap == "one\ntwo"
