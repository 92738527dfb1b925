"""Operators on inline fixtures: one test per hazard with data."""

from pyspark.sql import functions as F

from fieldcast import constants as C
from fieldcast.functions import scalar as X
from fieldcast.operators import answers as A
from fieldcast.operators import features as FE
from fieldcast.operators import metadata as M
from fieldcast.operators import predict as P
from fieldcast.operators import score as S

PROFILE = "row_id long, pos int, country_code string, crop_name string, partner string, subpartner string, " \
          "irrigation string, hired_workers string, area double, planYear int, indicator string, labelName string, " \
          "answer string"


def answers(spark, rows):
    return spark.createDataFrame(rows, PROFILE)


def _types(spark, values, ind="X-1"):
    rows = [(i, 1, "IN", "Wheat", "P", None, "True", "1", 1.0, 2024, ind, None, v) for i, v in enumerate(values)]
    r = M.infer_types(answers(spark, rows)).collect()[0]
    return r["type"], r["options"]


def test_infer_boolean_numbers_and_texts(spark):
    assert _types(spark, ["0", "1", "1"]) == ("radio", ["False", "True"])
    assert _types(spark, ["10", "2", "1.5"]) == ("radio", ["1.5", "2", "10"])
    assert _types(spark, [str(i) for i in range(76)])[0] == "number"
    assert _types(spark, [f"t{i}" for i in range(51)])[0] == "text"
    assert _types(spark, [f"t{i}" for i in range(7)])[0] == "checkbox"
    assert _types(spark, ["a" * 41, "b"])[0] == "radio"          # average length 21
    assert _types(spark, ["a" * 85, "b"])[0] == "checkbox"       # average length 43 > 40
    assert _types(spark, ["b", "a", "B"]) == ("radio", ["B", "a", "b"])
    assert _types(spark, [None, "", "None", "null"]) == ("text", [])


def test_infer_bad_number_sorts_last(spark):
    # '1-2' passes the numeric test but is not a number: sorted last, no failure (H7)
    assert _types(spark, ["3", "1-2", "1"]) == ("radio", ["1", "3", "1-2"])


def test_numeric_text_rule(spark):
    df = spark.createDataFrame([(s,) for s in ["1", "1.5", "-2", "-.5", "1..2", "--1", "-", ".", "1e3", "a1"]], "s string")
    got = {r["s"]: r["ok"] for r in df.select("s", X.is_numeric_text("s").alias("ok")).collect()}
    assert got == {"1": True, "1.5": True, "-2": True, "-.5": True, "1..2": False, "--1": False, "-": False,
                   ".": False, "1e3": False, "a1": False}


def test_section_prefix_and_default(spark):
    df = spark.createDataFrame([("BH-1",), ("zz9",), ("W-Q3",)], "indicator string")
    got = {r["indicator"]: r["section"] for r in M.with_section(df, spark).collect()}
    assert got == {"BH-1": "Biodiversity & Habitat", "zz9": "General", "W-Q3": "Water Quality"}


def test_first_answer_keeps_null_first_and_null_keys(spark):
    rows = [(1, 1, "IN", "Wheat", "P", None, "True", "1", 1.0, 2024, "A-1", None, None),
            (2, 1, "IN", "Wheat", "P", None, "True", "1", 1.0, 2024, "A-1", None, "late")]
    fa = A.first_answer(answers(spark, rows)).collect()
    assert len(fa) == 1 and fa[0]["answer"] is None          # H2: null first answer stays null
    assert A.first_answer(answers(spark, rows), null_keys="drop").count() == 0   # H1: pandas-style drop


def test_pivot_drops_all_null_profiles(spark):
    rows = [(1, 1, "IN", "Wheat", "P", "s", "True", "1", 1.0, 2024, "A-1", None, "x"),
            (2, 1, "US", "Rice", "P", "s", "True", "1", 2.0, 2024, "A-1", None, None)]
    wide = A.pivot_answers(answers(spark, rows), ["A-1"]).collect()
    assert [(r["country_code"], r["A-1"]) for r in wide] == [("IN", "x")]


def test_encoder_unknown_and_mode_tie(spark):
    prof = spark.createDataFrame([("IN", " Wheat", "B", None, "True", "1", 1.0, 2024),
                                  ("US", "Weizen", "A", None, "True", "2", 1.0, 2024)],
                                 "country_code string, crop_name string, partner string, subpartner string, "
                                 "irrigation string, hired_workers string, area double, planYear int")
    tp = FE.prepare(prof, spark)
    enc = {(r["feature"], r["value"]): r["code"] for r in FE.fit_encoders(tp).collect()}
    assert enc[("crop_name", "Unknown")] == 0 and enc[("crop_name", "Wheat")] == 1   # synonyms merged
    assert enc[("partner", "A")] == 0 and enc[("partner", "Unknown")] == 2
    modes = {r["feature"]: r["mode_value"] for r in FE.fit_modes(tp).collect()}
    assert modes["partner"] == "A" and modes["subpartner"] == "Unknown"
    new = FE.prepare(spark.createDataFrame([("FR", "Mais", "Z", None, "False", "n/a", None, None)], prof.schema), spark)
    e = FE.encode(new, FE.fit_encoders(tp), FE.fit_modes(tp), []).collect()[0]
    assert e["country_code_encoded"] == enc[("country_code", "IN")]     # unseen -> mode (v2)
    assert (e["hired_workers"], e["area"], e["planYear"]) == (0.0, 0.0, 0.0)


def test_scores_zero_weight_and_bands(spark):
    items = spark.createDataFrame([("r1", "BH-1", "Biodiversity & Habitat", 90.0, "green", 0.0),
                                   ("r2", "BH-1", "Biodiversity & Habitat", 50.0, "amber", 80.0),
                                   ("r2", "WQ-3", "Water Quality", 30.0, "red", 80.0)],
                                  "run_id string, indicator string, section string, confidence double, "
                                  "ui_status string, model_accuracy double")
    sc = {(r["run_id"], r["section"]): r["score"] for r in S.weighted_scores(items).collect()}
    assert sc[("r1", None)] == 0.0                     # zero weight -> 0
    assert abs(sc[("r2", None)] - 15.0) < 1e-9         # (30*.8 + 0) / 1.6
    pres = {r["run_id"]: (r["band"], r["score_range"]) for r in
            S.score_presentation(S.weighted_scores(items).filter("overall")).collect()}
    assert pres["r2"] == ("Poor", "8–22")


def test_score_range_ties_to_even(spark):
    df = spark.createDataFrame([(44.5 + 7,), (45.5 + 7,), (99.0,)], "s double")
    got = [r[0] for r in df.select(X.score_range("s")).collect()]
    assert got == ["44–58", "46–60", "92–100"]


def test_similarity_zero_distance(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 2.0)], "d double, m double")
    got = [round(r[0], 6) for r in df.select(X.similarity_pct("d", "m")).collect()]
    assert got == [100.0, 50.0]


def test_manual_rows_and_override(spark):
    meta = spark.createDataFrame([("A-1", "radio"), ("T-1", "text"), ("N-1", "number")], "indicator string, type string")
    keys = spark.createDataFrame([("r1",), ("r2",)], "run_id string")
    manual = P.manual_rows(keys, meta, key="run_id")
    assert manual.count() == 4
    r = manual.filter("indicator = 'T-1'").first()
    assert r["reason"] == "Open text field — AI cannot predict free-form input" and r["policy"] == "manual_entry"


def test_conditionals_follow_parents(spark):
    pred = spark.createDataFrame([("r1", "P", "Yes"), ("r1", "C", "x"), ("r1", "G", "y"),
                                  ("r2", "P", "No"), ("r2", "C", "x"), ("r2", "G", "y")],
                                 "profile_id string, indicator string, value string")
    conds = spark.createDataFrame([("C", True, "P", "Yes"), ("G", True, "C", "x")],
                                  "indicator string, conditional boolean, parent string, parent_value string")
    kept = {(r[0], r[1]) for r in P.resolve_conditionals(pred, conds).select("profile_id", "indicator").collect()}
    assert kept == {("r1", "P"), ("r1", "C"), ("r1", "G"), ("r2", "P")}   # dropped parent drops the grandchild


def test_predict_failed_v1_fill(spark):
    df = spark.createDataFrame([("A", None, None)], "indicator string, predicted_class string, confidence double")
    r = P.fill_failed(df).first()
    assert (r["predicted_class"], r["confidence"]) == ("Unknown", 0.0)


def test_rank_within_hot_groups_matches_window(spark):
    from pyspark.sql import Window
    from fieldcast.operators.util import rank_within
    rows = [("hot", i * 7 % 1001) for i in range(1001)] + [("a", 5), ("a", 3), ("b", 9)]
    df = spark.createDataFrame(rows, "g string, k long")
    want = {(r["g"], r["k"]): r["r"] for r in
            df.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("k"))).collect()}
    got = {(r["g"], r["k"]): r["r"] for r in rank_within(df, ["g"], "k", "r", hot_rows=50).collect()}
    assert got == want
