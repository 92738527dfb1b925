"""Count model invariants, streaming = batch, k-NN = brute force, plan shape, oracle agreement."""

import math
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from fieldcast.operators import countmodel as CM
from fieldcast.operators import explain as EX
from fieldcast.operators import feedback as FB
from fieldcast.operators import history as H
from fieldcast.operators import similar as SIM
from fieldcast.operators.features import FEATURE_NAMES
from fieldcast.plans.context import Ctx
from fieldcast.plans.q_model import Model

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="driver test data not present")


@pytest.fixture(scope="module")
def model(spark):
    return Model(Ctx(spark, SF))


def _rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_folding_equals_refit_on_union(spark, model):
    ctx = model.ctx
    corr = FB.correction_examples(ctx.feedback, model.model, model.modelled, spark)
    assert corr.count() > 0
    folded = FB.fold_corrections(model.model, ctx.feedback, model.modelled, spark)
    union = model.ex.select("indicator", "class", *CM.NB_FEATURES).unionByName(corr)
    refit = CM.fit(union)
    cols = ["indicator", "class", "feature", "value", "n"]
    assert _rows(folded.filter(F.col("feature") != "__class__"), cols) == _rows(refit.fv, cols)
    cls = folded.filter(F.col("feature") == "__class__").select("indicator", "class", F.col("n").alias("n_class"))
    assert _rows(cls, ["indicator", "class", "n_class"]) == _rows(refit.classes, ["indicator", "class", "n_class"])


def test_shapley_contributions_sum_to_score_gap(spark, model):
    ind = model.modelled_list[0]
    req = model.requests([ind]).filter(F.col("profile_id") == model.ctx.profiles.agg(F.min("row_id")).first()[0])
    raw = model.ctx.profiles.select(F.col("row_id").alias("profile_id"), *[c for c in model.ctx.profiles.columns
                                                                           if c != "row_id"])
    expl = EX.contributions(req, model.model, raw, "profile_id")
    pred = expl.first()["predicted_class"]
    phi = sum(r["impact"] for r in expl.collect())
    sc = CM.score(req, model.model, "profile_id").first()
    idx = sc["classes"].index(pred)
    train = model.ex.filter(F.col("indicator") == ind).select(F.col("row_key").alias("profile_id"), "indicator",
                                                              *CM.NB_FEATURES)
    bg = [r["scores"][idx] for r in CM.score(train, model.model, "profile_id").collect()]
    assert abs(phi - (sc["scores"][idx] - sum(bg) / len(bg))) < 1e-6


def test_stream_counts_equal_batch(spark):
    from __spark_entry__ import queries
    s = queries()["stream_feedback_counts"](spark, SF)
    b = H.feedback_counts(Ctx(spark, SF).feedback)
    cols = ["indicator", "total", "helpful", "not_helpful"]
    assert _rows(s, cols) == _rows(b, cols)


def test_knn_matches_brute_force(spark):
    rnd = random.Random(7)

    def vec():
        v = {f: float(rnd.randint(0, 5)) for f in FEATURE_NAMES}
        v["area"] = float(rnd.choice([10.0, 10.0, 12.5, 400.0, 1000.0, rnd.uniform(0, 2000)]))
        return v
    train = [dict(vec(), tid=i) for i in range(120)] + [dict(vec(), tid=1000 + i) for i in range(3)]
    train += [dict(train[0], tid=2000 + i) for i in range(10)]          # a hot group of identical vectors
    queries = [dict(vec(), qid=i) for i in range(40)] + [dict(train[5], qid=100)]
    tdf = spark.createDataFrame([tuple(r[c] for c in ["tid", *FEATURE_NAMES]) for r in train],
                                "tid long, " + ", ".join(f"{f} double" for f in FEATURE_NAMES))
    qdf = spark.createDataFrame([tuple(r[c] for c in ["qid", *FEATURE_NAMES]) for r in queries],
                                "qid long, " + ", ".join(f"{f} double" for f in FEATURE_NAMES))
    got = {}
    for r in SIM.nearest(qdf, tdf, "qid", "tid", k=5).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["neighbour_id"], float(r["distance"])))
    for q in queries:
        d = sorted((math.sqrt(sum((q[f] - t[f]) ** 2 for f in FEATURE_NAMES)), t["tid"]) for t in train)[:5]
        mine = sorted(got[q["qid"]])
        assert [m[1] for m in mine] == [x[1] for x in d]
        assert all(abs(m[2] - x[0]) < 1e-6 for m, x in zip(mine, d))


def test_predict_plan_is_broadcast_and_udf_free(spark, model):
    p = CM.predict(model.requests(), model.model, "profile_id")
    plan = p._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_knn_with_most_rows_in_one_spot(spark):
    """90 % of the rows, and a query among them, in a ten-thousandth of the range: cells begin narrow, the result is exact."""
    rnd = random.Random(9)
    def vec(wide):
        return [rnd.uniform(0, 1000.0) if wide else 500 + rnd.uniform(0, 0.1) for _ in FEATURE_NAMES]
    train = [(i, *vec(i % 10 == 0)) for i in range(3000)]
    asked = [(i, *vec(i % 3 == 0)) for i in range(60)]
    schema = ", ".join(f"{f} double" for f in FEATURE_NAMES)
    t, q = spark.createDataFrame(train, f"tid long, {schema}"), spark.createDataFrame(asked, f"qid long, {schema}")
    grid = t.select(*[F.col(f).alias(f"t_{f}") for f in FEATURE_NAMES])
    assert SIM._first_radius(grid, FEATURE_NAMES[:3], 200.0, 500) < 0.1
    got = {}
    for r in SIM.nearest(q, t, "qid", "tid", k=4, dense=500).collect():
        got.setdefault(r.qid, {})[r["rank"]] = r.neighbour_id
    for i, *v in asked:
        want = sorted((math.dist(v, w), j) for j, *w in train)[:4]
        assert [got[i][n] for n in range(1, 5)] == [j for _, j in want]


def test_point_lookup_filter_reaches_scan(spark):
    from __spark_entry__ import queries
    df = queries()["run_items"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_orderkey,7)" in plan


ORACLE_KEYS = ["feedback_counts", "run_summary", "question_meta", "first_answer", "nb_counts",
               "classification_metrics", "predict_batch", "score_band", "most_corrected", "explain_top_drivers",
               "model_report", "model_report_summary", "predict_published", "corrections_for_indicator"]


@pytest.mark.parametrize("key", ORACLE_KEYS)
def test_oracle_agreement(spark, key):
    duckdb = pytest.importorskip("duckdb")
    from __spark_entry__ import oracle_sql, queries
    from tools.check_oracle import TABLES, digest
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    df = queries()[key](spark, SF)
    rel = con.execute(oracle_sql()[key])
    ocols = [d[0] for d in rel.description]
    orows = rel.fetchall()
    srows = [tuple(r) for r in df.collect()]
    assert sorted(df.columns) == sorted(ocols)
    assert len(srows) == len(orows)
    assert digest(df.columns, srows)[0] == digest(ocols, orows)[0]


def test_stream_refit_equals_batch_fold(spark):
    from __spark_entry__ import queries
    cols = ["indicator", "class", "feature", "value", "n"]
    s = queries()["stream_feedback_refit"](spark, SF)
    b = queries()["apply_feedback"](spark, SF)
    assert _rows(s, cols) == _rows(b, cols)


def test_many_classes_are_scored_as_few(spark, model):
    """The blocks give what the dense vectors give, also for another smoothing and the previous year."""
    asked = model.requests(extra_prev_year=True)
    for m in (model.model, model.model.with_alpha(0.25)):
        dense, sparse = (CM.predict(asked, m, "profile_id", ("area",), "prev_year", dense_classes=k).collect() for k in (10**9, 1))
        assert len(dense) == len(sparse) == model.ctx.profiles.count() * len(model.modelled_list)
        found = {(r.profile_id, r.indicator): r for r in sparse}
        for r in dense:
            s = found[r.profile_id, r.indicator]
            assert (s.area, s.predicted_class, s.previous_class) == (r.area, r.predicted_class, r.previous_class)
            assert abs(s.confidence - r.confidence) < 1e-8 and abs(s.previous_confidence - r.previous_confidence) < 1e-8


def test_fold_models_are_the_counts_of_the_other_folds(spark, model):
    ex = model.split
    got = CM.fold_models(ex)
    copies = ex.select("*", F.explode(F.expr("filter(sequence(0, n_folds - 1), j -> j <> fold)")).alias("j"))
    want = CM.fit(copies.withColumn("indicator", F.concat_ws("#", "indicator", "j")).drop("j"))
    cols = ["indicator", "class", "feature", "value", "n"]
    assert _rows(got.fv, cols) == _rows(want.fv, cols)
    assert _rows(got.classes, cols[:2] + ["n_class"]) == _rows(want.classes, cols[:2] + ["n_class"])


@pytest.mark.parametrize("key", ["predict_batch", "yoy_compare", "yoy_chosen_year"])
def test_every_trainable_indicator_has_a_model(spark, key):
    """Whatever the number of its distinct answers."""
    duckdb = pytest.importorskip("duckdb")
    from __spark_entry__ import oracle_sql, queries
    from tools.check_oracle import TABLES, digest
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    rel = con.execute(oracle_sql()[key])
    ocols, orows = [d[0] for d in rel.description], rel.fetchall()
    df = queries()[key](spark, SF)
    srows = df.collect()
    at = df.columns.index("indicator")
    assert {"SM-5", "ZZ-7"} <= {r[at] for r in srows}
    assert key != "predict_batch" or not any(r["policy"] == "manual_entry" for r in srows if r["indicator"] in ("SM-5", "ZZ-7"))
    assert digest(df.columns, [tuple(r) for r in srows])[0] == digest(ocols, orows)[0]
