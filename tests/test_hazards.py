"""Inputs that the test tables do not hold: far and unequal neighbours, white space, quoting, shared folders, lost parts."""

import math

import pytest
from pyspark.sql import functions as F

from fieldcast import constants as C
from fieldcast import session
from fieldcast.functions import scalar as X
from fieldcast.operators import answers as A
from fieldcast.operators import predict as P
from fieldcast.operators import similar as SIM
from fieldcast.operators.features import FEATURE_NAMES
from fieldcast.sources import store


def vectors(spark, rows, name):
    """rows: (id, area, code); the other features are 0."""
    cells = [tuple([i, *(float(area) if f == "area" else float(code) if f == FEATURE_NAMES[0] else 0.0 for f in FEATURE_NAMES)]) for i, area, code in rows]
    return spark.createDataFrame(cells, f"{name} long, " + ", ".join(f"{f} double" for f in FEATURE_NAMES))


def check_nearest(spark, train, queries, k):
    got = {}
    for r in SIM.nearest(vectors(spark, queries, "q"), vectors(spark, train, "t"), "q", "t", k).collect():
        got.setdefault(r["q"], []).append((r["rank"], r["neighbour_id"], float(r["distance"])))
    for i, area, code in queries:
        want = sorted((math.hypot(a - area, c - code), t) for t, a, c in train)[:k]
        mine = sorted(got[i])
        assert [m[1] for m in mine] == [t for _, t in want], i
        assert all(abs(m[2] - d) < 1e-5 for m, (d, _) in zip(mine, want))


def test_neighbours_of_far_queries(spark):
    check_nearest(spark, [(i, i, 0) for i in range(100)], [(1, 1e6, 0), (2, -5e4, 0), (3, 50.4, 0)], 3)


def test_neighbours_over_a_wide_gap(spark):
    check_nearest(spark, [(0, 0, 0), (1, 1e9, 0)], [(1, 5e8 - 1, 0), (2, 5e8 + 1, 0)], 1)


def test_the_nearest_area_is_not_the_nearest_row(spark):
    check_nearest(spark, [(0, 0, 0), (1, 100, 163)], [(1, 165, 0)], 1)


def test_neighbours_of_equal_rows_and_of_none(spark):
    check_nearest(spark, [(i, 7, 3) for i in range(30)], [(1, 7, 3), (2, 9, 3)], 5)
    assert SIM.nearest(vectors(spark, [(1, 1, 1)], "q"), vectors(spark, [], "t"), "q", "t", 3).collect() == []


def test_strip_knows_all_white_space(spark):
    texts = ["BH-1\t", " BH-1", " BH-1\n", "　BH-1 ", "\x1cBH-1\x85", "BH-1", " B H "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(X.strip("t")).collect()] == [t.strip() for t in texts]
    blank = spark.createDataFrame([(" ",), ("\t null ",), ("x",)], "t string")
    assert [r[0] for r in blank.select(X.is_blank_answer("t")).collect()] == [True, True, False]


def test_lists_are_printed_like_pythons(spark):
    lists = [["a", "b"], ["Farmer's choice"], ["it's \"so\""], ["back\\slash", "two\nlines"], ['say "x"']]
    df = spark.createDataFrame([(x,) for x in lists], "o array<string>")
    assert [r[0] for r in df.select(X.options_repr("o")).collect()] == [repr(x) for x in lists]


def test_manual_rows_of_all_questions_without_a_model(spark):
    meta = spark.createDataFrame([("A", "radio"), ("B", "text"), ("D", "number")], "indicator string, type string")
    keys = spark.createDataFrame([(1,), (2,)], "profile_id long")
    rows = {(r.profile_id, r.indicator) for r in P.manual_rows(keys, meta, modelled=["B"]).collect()}
    assert rows == {(p, i) for p in (1, 2) for i in ("A", "D")}


def test_a_lost_part_of_a_saved_model_is_an_error(spark, tmpdir_path):
    store.save_state(spark, {"classes": spark.range(3)}, "v1", tmpdir_path)
    with pytest.raises(Exception):
        store.load_state(spark, "v1", ("classes", "fv"), tmpdir_path)
    assert set(store.load_state(spark, "v1", ("classes", "fv"), tmpdir_path, optional=("fv",))) == {"classes"}


def test_a_cluster_without_a_shared_folder_is_refused(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Conf:
        def get(self, key, default):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_planning_profiles_runs_no_job(spark):
    from fieldcast.plans.context import Ctx

    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    spark.sparkContext.setJobGroup("planning", "planning")
    Ctx(spark, "/root/testdata/sf0.001").profiles
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("planning")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # reading the tables' schemas may list a footer; nothing joins or shuffles
    assert len(jobs) <= 3 and before >= 0


def test_answers_with_odd_white_space_are_one_indicator(spark):
    raw = spark.createDataFrame([(1, "BH-1\t"), (2, " BH-1")], "row_id long, soaId string")
    assert {r.indicator for r in A.clean_indicators(raw).collect()} == {"BH-1"}
    assert C.MAX_CLASSES == 75


def test_feedback_is_kept_or_routed_with_ids_and_flags(spark, tmpdir_path):
    from fieldcast.operators.feedback import save_feedback

    posts = spark.createDataFrame([("A", "x", True), ("", "x", False), ("B", None, None), ("B", "y", None)], "indicator string, actual_value string, helpful boolean")
    accepted = save_feedback(posts, tmpdir_path).collect()
    assert sorted((r.indicator, r.was_helpful) for r in accepted) == [("A", 1), ("B", None)] and len({r.id for r in accepted}) == 2
    stored = spark.read.parquet(f"{tmpdir_path}/accepted").collect()
    assert {r.id for r in stored} == {r.id for r in accepted}
    assert spark.read.parquet(f"{tmpdir_path}/rejected").count() == 2


def test_all_inputs_of_a_correction_are_counted(spark):
    from fieldcast.operators import feedback as FB
    from fieldcast.plans.context import Ctx
    from fieldcast.plans.q_model import Model

    m = Model(Ctx(spark, "/root/testdata/sf0.001"))
    rows = FB.correction_examples(m.ctx.feedback, m.model, m.modelled, spark)
    assert rows.filter("country_code LIKE 'Country%'").count() == rows.count() > 0
    assert rows.select("planYear").distinct().collect()[0][0] not in (None, "0")


def test_a_recorded_run_has_a_row_for_every_question(spark, tmpdir_path):
    from fieldcast.plans.context import Ctx
    from fieldcast.plans.q_model import record_runs
    from fieldcast.sources import store

    ctx = Ctx(spark, "/root/testdata/sf0.001")
    record_runs(ctx, tmpdir_path, "batch-1")
    runs, items = (store.read_history(spark, tmpdir_path, f"prediction_{n}") for n in ("runs", "items"))
    questions = ctx.meta.count()
    assert runs.count() == ctx.profiles.count() == items.select("run_id").distinct().count()
    assert runs.filter(F.col("total_indicators") != questions).count() == 0
    assert runs.join(items, "run_id", "left_anti").count() == 0
