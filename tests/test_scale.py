"""Plans and results that must hold when tables grow: what is broadcast, what is shuffled, what is scored."""

import os
import random

import pytest
from pyspark.sql import functions as F

from fieldcast.operators import countmodel as CM
from fieldcast.operators import similar as SIM
from fieldcast.operators import widescore as WS
from fieldcast.operators.features import FEATURE_NAMES
from fieldcast.plans.context import Ctx
from fieldcast.plans.q_model import Model

SF = "/root/testdata/sf0.001"
data = pytest.mark.skipif(not os.path.exists(SF), reason="driver test data not present")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_neighbours_are_not_joined_by_broadcast(spark):
    """Written tables of repeated values are tiny on disk: their size must not send data-sized joins through the driver."""
    rnd = random.Random(3)
    schema = ", ".join(f"{f} double" for f in FEATURE_NAMES)
    rows = [(i, *[float(rnd.randint(0, 9)) for _ in FEATURE_NAMES]) for i in range(200)]
    t, q = spark.createDataFrame(rows, f"tid long, {schema}"), spark.createDataFrame(rows[:50], f"qid long, {schema}")
    found = SIM.nearest(q, t, "qid", "tid", k=3)
    assert "BroadcastExchange" not in plan_of(found)
    assert found.count() == 150


@data
def test_profiles_are_scored_once_per_distinct_input(spark, monkeypatch):
    """Copies of profiles add no scoring, and get the decisions that scoring every row gives; wide indicators in small blocks too."""
    m = Model(Ctx(spark, SF))
    some = m.inputs().limit(60).localCheckpoint()
    copies = some.withColumn("profile_id", F.explode(F.array(*[F.col("profile_id") + F.lit(i * 10**9) for i in range(5)])))
    monkeypatch.setattr(WS, "BLOCK_INPUTS", 7)
    monkeypatch.setattr(WS, "BLOCK_COUNTS", 300)
    monkeypatch.setattr(WS, "PIECE_COUNTS", 3000)
    scored, plain = [], CM.predict
    monkeypatch.setattr(CM, "predict", lambda rows, *a, **k: (scored.append(rows.count()), plain(rows, *a, **k))[1])
    got = CM.predict_profiles(copies, m.modelled_list, m.model, "profile_id").collect()
    assert scored == [some.select(*CM.NB_FEATURES).distinct().count() * len(m.modelled_list)]
    asked = some.withColumn("indicator", F.explode(F.array(*[F.lit(i) for i in m.modelled_list])))
    want = {(r.profile_id, r.indicator): r for r in plain(asked, m.model, "profile_id", dense_classes=10**9).collect()}
    assert len(got) == 5 * len(want)
    for r in got:
        w = want[r.profile_id % 10**9, r.indicator]
        assert r.predicted_class == w.predicted_class and abs(r.confidence - w.confidence) < 1e-6


@data
def test_split_ranks_carry_no_features(spark, monkeypatch):
    """The ranks and the counts behind the slots move keys; slots with and without features are the same."""
    m = Model(Ctx(spark, SF))
    ranked, plain = [], CM.rank_within
    monkeypatch.setattr(CM, "rank_within", lambda df, *a, **k: (ranked.append(set(df.columns)), plain(df, *a, **k))[1])
    cols = ["indicator", "row_key", "class", "is_test", "n_folds", "fold", "eval_on_train"]
    with_features = sorted(map(tuple, CM.split(m.ex).select(*cols).collect()))
    assert ranked and not any(c & set(CM.NB_FEATURES) for c in ranked)
    assert with_features == sorted(map(tuple, CM.split_keys(m.ex).select(*cols).collect()))


def test_hot_rank_shuffles_once(spark):
    from fieldcast.operators.util import distributed_rank
    rows = spark.range(3000).select((F.col("id") % 2).alias("g"), ((F.col("id") * 7919) % 3001).alias("o"))
    ranked = distributed_rank(rows, ["g"], "o", "r")
    assert "Exchange hashpartitioning" not in plan_of(ranked)  # the written rows stay where they are
    got = {}
    for r in ranked.collect():
        got.setdefault(r.g, []).append((r.o, r.r))
    assert all([n for _, n in sorted(v)] == list(range(1, len(v) + 1)) for v in got.values())
    assert sum(map(len, got.values())) == 3000


@data
def test_equal_inputs_are_explained_once(spark, monkeypatch):
    from fieldcast.operators import explain as EX
    m = Model(Ctx(spark, SF), ["BH-1"])
    raw = m.ctx.profiles.select(F.col("row_id").alias("profile_id"), *[c for c in m.ctx.profiles.columns if c != "row_id"]).limit(20).localCheckpoint()
    req = m.requests().join(raw.select("profile_id"), "profile_id").localCheckpoint()
    copied = lambda df: df.withColumn("profile_id", F.explode(F.array(F.col("profile_id"), -F.col("profile_id") - 1)))
    assert m.model.fv.count() > 0  # fitted before the calls are counted
    stacked, plain = [], CM.stack
    monkeypatch.setattr(CM, "stack", lambda df, keep: (stacked.append(df.count()), plain(df, keep))[1])
    cols = ["raw_feature", "predicted_class", "input_value"]
    once = EX.contributions(req, m.model, raw, "profile_id")
    twice = EX.contributions(copied(req), m.model, copied(raw), "profile_id")
    assert stacked[0] == stacked[-1]
    rows = lambda df: sorted((r.profile_id, *[r[c] for c in cols], round(r.impact, 9)) for r in df.collect())
    assert rows(twice.filter("profile_id >= 0")) == rows(once) and twice.count() == 2 * once.count() == 440


@data
def test_training_profiles_are_made_once(spark, monkeypatch):
    """Encoders, modes and encoding read one written table: the answers behind it are in no plan of theirs."""
    from fieldcast.operators import features as FE
    from fieldcast.plans import q_model as Q
    seen = []
    for name in ("fit_encoders", "fit_modes", "encode"):
        monkeypatch.setattr(FE, name, lambda df, *a, _plain=getattr(FE, name), **k: (seen.append(plan_of(df)), _plain(df, *a, **k))[1])
    out = Q.encode_fit_transform(Ctx(spark, SF))
    assert len(seen) == 3 and not any("lineitem" in p for p in seen) and "lineitem" not in plan_of(out)
    seen.clear()
    Q.encode_apply(Ctx(spark, SF))
    assert len(seen) == 3 and not any("lineitem" in p for p in seen)


@data
def test_first_answers_are_not_sorted_in_the_scan_of_a_written_table(spark, monkeypatch):
    """A written table of answers is tiny on disk, so its scan has few tasks. The model's own plans write neither
    it nor, where no split reads them, the training rows; with and without metadata they are the same."""
    from fieldcast.operators import answers as A
    from fieldcast.plans import q_model as Q
    from fieldcast.plans import context
    written, plain, asked = [], Q.materialize, []
    monkeypatch.setattr(Q, "materialize", lambda df, *a: (written.append(df.columns), plain(df, *a))[1])
    first = A.first_answer_rows
    monkeypatch.setattr(context.A, "first_answer_rows", lambda df, *a: (asked.append(plan_of(df)), first(df, *a))[1])
    bare = Model(Ctx(spark, SF), meta=False)
    got = sorted(map(tuple, CM.log_probs(bare.model).collect()))
    assert "lineitem" in asked[0] and not any("row_key" in c for c in written)
    assert got == sorted(map(tuple, CM.log_probs(Model(Ctx(spark, SF)).model).collect()))


def test_log_probs_leave_the_counts_where_they_are(spark):
    rows = [("i", "ab"[n % 2], n, *[str(n % 3)] * len(CM.NB_FEATURES)) for n in range(12)]
    ex = spark.createDataFrame(rows, "indicator string, class string, row_key long, " + ", ".join(f"{f} string" for f in CM.NB_FEATURES))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for counts of a size that Spark does not know
    try:
        plan = plan_of(CM.log_probs(CM.fit(ex).materialized()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_rows_are_dealt_to_as_many_tasks_as_they_ask_for(spark, monkeypatch, tmpdir_path):
    """More rows than the session's partitions hold go to more tasks, by the shuffle that the window makes anyway."""
    from pyspark.sql import Window
    from fieldcast.operators import util
    spark.range(1000).select((F.col("id") % 300).alias("k"), "id").write.parquet(f"{tmpdir_path}/t")
    t = spark.read.parquet(f"{tmpdir_path}/t")
    numbered = lambda df: df.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("id")))
    want = sorted(map(tuple, numbered(util.dealt(t, "k")).collect()))
    assert util.dealt(t, "k") is t
    monkeypatch.setattr(util, "TASK_ROWS", 50)
    many = numbered(util.dealt(t, "k"))
    assert plan_of(many).count("Exchange") == 1 and many.rdd.getNumPartitions() == 20
    assert sorted(map(tuple, many.collect())) == want


@data
def test_first_answers_are_sorted_in_tasks_of_a_size(spark, monkeypatch):
    """The session's own shuffles, which adaptive execution coalesces by compressed bytes, do not take more rows than a
    task may sort: first answers are dealt by number, each sorted once, hot profiles first aggregated where they are."""
    from fieldcast.operators import answers as A
    from fieldcast.operators import util
    rows = lambda df: sorted(map(repr, df.collect()))
    want = rows(Ctx(spark, SF).first_rows)
    monkeypatch.setattr(util, "TASK_ROWS", 500)
    some = Ctx(spark, SF)
    n = -(-some.table("lineitem").count() // 500)
    plan = plan_of(some.first_rows)
    assert f", {n}), REPARTITION_BY_NUM" in plan and rows(some.first_rows) == want
    monkeypatch.setattr(A, "HOT_PROFILE_ROWS", 1)
    profiles = Ctx(spark, SF).profiles
    hot = Ctx(spark, SF)
    hot.__dict__["profiles"] = profiles.unionByName(profiles.filter("row_id % 3 = 0"))
    assert A.hot_profiles(hot.profiles)
    assert rows(hot.first_rows) == want


def test_ranks_are_sorted_in_tasks_of_a_size(spark, monkeypatch):
    from fieldcast.operators import util
    rows = spark.range(1000).select((F.col("id") % 7).alias("g"), ((F.col("id") * 7919) % 3001).alias("o"))
    rows = rows.unionByName(spark.range(500).select(F.lit(99).cast("long"), F.col("id")).toDF("g", "o"))
    want = sorted(map(tuple, util.rank_within(rows, ["g"], "o", "r", hot_rows=400).collect()))
    monkeypatch.setattr(util, "TASK_ROWS", 50)
    ranked = util.rank_within(rows, ["g"], "o", "r", hot_rows=400, deal=True)
    assert "hashpartitioning(g" in plan_of(ranked) and ", 20), REPARTITION_BY_NUM" in plan_of(ranked)
    assert sorted(map(tuple, ranked.collect())) == want


def test_smoothings_are_scored_in_one_pass(spark, monkeypatch):
    """A grid of smoothings makes counts, inputs and blocks once, and has the accuracies of one plan for each."""
    rnd = random.Random(5)
    rows = [(i, rnd.choice("abc"), n, *[str(rnd.randint(0, 3)) for _ in CM.NB_FEATURES]) for i in ("i", "k") for n in range(90)]
    ex = spark.createDataFrame(rows, "indicator string, class string, row_key long, " + ", ".join(f"{f} string" for f in CM.NB_FEATURES))
    split = CM.split(ex).localCheckpoint()
    asked, plain = [], WS.decide_inputs
    monkeypatch.setattr(WS, "decide_inputs", lambda *a: (asked.append(a[3]), plain(*a))[1])
    got = {(r.indicator, r.alpha): (r.n_folds, round(float(r.cv_accuracy), 6)) for r in CM.cv_accuracy(split, 10, [0.25, 2.0]).collect()}
    assert asked == [[0.25, 2.0]]
    test, m = split.withColumn("indicator", F.concat_ws("#", "indicator", F.col("fold").cast("string"))), CM.fold_models(split)
    for alpha in (0.25, 2.0):
        each = CM.predict(test, m.with_alpha(alpha), "row_key", ("class",), dense_classes=10**9).collect()
        for name in ("i", "k"):
            folds = {}
            for r in each:
                if r.indicator.startswith(name):
                    folds.setdefault(r.indicator, []).append(r.predicted_class == r["class"])
            assert got[name, alpha] == (len(folds), round(sum(sum(f) / len(f) for f in folds.values()) / len(folds), 6))


def _examples(spark, seed=7, rows=90):
    """Own training rows of two indicators: a has three classes, b has two."""
    rnd = random.Random(seed)
    told = [(i, rnd.choice("abc" if i == "a" else "xy"), n, *[str(rnd.randint(0, 2)) for _ in CM.NB_FEATURES]) for i in "ab" for n in range(rows)]
    return spark.createDataFrame(told, "indicator string, class string, row_key long, " + ", ".join(f"{f} string" for f in CM.NB_FEATURES))


def test_answers_are_folded_before_they_go_back(spark):
    """Sums over an input's answers go back to its profiles, not the answers; keys may repeat and features be null."""
    m = CM.fit(_examples(spark)).materialized()
    rnd = random.Random(8)
    rows = [(n % 40, *[rnd.choice(["0", "1", "9", None]) for _ in CM.NB_FEATURES]) for n in range(60)]
    profiles = spark.createDataFrame(rows + rows[:5], "key long, " + ", ".join(f"{f} string" for f in CM.NB_FEATURES)).localCheckpoint()
    fold = [F.sum("confidence").alias("s"), F.count(F.lit(1)).alias("n")]
    folded = CM.predict_profiles(profiles, ["a", "b"], m, "key", fold=fold)
    assert folded.columns == ["key", "s", "n"] and "inline(" not in plan_of(folded)
    got = {r.key: (round(r.s, 6), r.n) for r in folded.groupBy("key").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()}
    each = CM.predict_profiles(profiles, ["a", "b"], m, "key").groupBy("key").agg(F.sum("confidence").alias("s"), F.count(F.lit(1)).alias("n"))
    assert got == {r.key: (round(r.s, 6), r.n) for r in each.collect()} and sum(n for _, n in got.values()) == 130


def test_holdout_rows_are_scored_once(spark):
    """The metrics read written confusion counts: no look-up of the model is left in their plan."""
    split = CM.split(_examples(spark)).localCheckpoint()
    preds = [tuple(r) for r in CM.holdout(split)[0].select("indicator", "actual", "predicted").collect()]
    cells, metrics = CM.evaluate(split)
    assert "lambda" not in plan_of(metrics) and "lambda" not in plan_of(cells)
    assert {tuple(r) for r in cells.collect()} == {(*p, preds.count(p)) for p in preds}
    for r in metrics.collect():
        mine = [(a, p) for i, a, p in preds if i == r.indicator]
        assert len(mine) == r.test_samples and abs(r.accuracy - sum(a == p for a, p in mine) / len(mine)) < 1e-9


def test_split_rows_are_joined_in_tasks_of_a_size(spark, monkeypatch):
    """The join that brings the features back sorts whole rows: it has as many tasks as they ask for."""
    from fieldcast.operators import util
    ex = _examples(spark)
    want = sorted(map(tuple, CM.split(ex).collect()))
    monkeypatch.setattr(util, "TASK_ROWS", 10)
    found = CM.split(ex)
    assert plan_of(found).count("18), REPARTITION_BY_NUM") >= 2
    assert sorted(map(tuple, found.collect())) == want


def test_neighbours_are_searched_where_the_rows_are(spark, monkeypatch):
    """A query meets its own block and the few that its k-th distance reaches: no copies for cells around it, no table
    of pairs; many blocks, blocks of queries in parts and a query far outside give what brute force gives."""
    import math
    rnd = random.Random(12)
    vec = lambda: [float(rnd.randint(0, 4)) for _ in FEATURE_NAMES[1:]]
    train = [(i, rnd.uniform(0, 1e5), *vec()) for i in range(600)] + [(900 + i, 5.0, *[1.0] * 10) for i in range(20)]
    asked = [(i, rnd.uniform(0, 1e5), *vec()) for i in range(150)] + [(990, 5.0, *[1.0] * 10), (991, -1e7, *[9.0] * 10), (992, 5.0, *[1.0] * 10)]
    schema = ", ".join(f"{f} double" for f in FEATURE_NAMES)
    t, q = spark.createDataFrame(train, f"tid long, {schema}"), spark.createDataFrame(asked, f"qid long, {schema}")
    met, plain = [], SIM._meet
    monkeypatch.setattr(SIM, "BLOCK_QUERIES", 9)
    monkeypatch.setattr(SIM, "_meet", lambda df, *a: (met.append(df.count()), plain(df, *a))[1])
    got = {}
    found = SIM.nearest(q, t, "qid", "tid", k=3, dense=60)
    for r in found.collect():
        got.setdefault(r.qid, {})[r["rank"]] = (r.neighbour_id, float(r.distance))
    assert met[0] == 152 and met[1] < 152  # the distinct queries, and those near the side of their block
    for i, *v in asked:
        want = sorted((math.dist(v, w), j) for j, *w in train)[:3]
        assert [got[i][n][0] for n in (1, 2, 3)] == [j for _, j in want]
        assert all(abs(got[i][n][1] - d) < 1e-5 for n, (d, _) in zip((1, 2, 3), want, strict=True))


@data
def test_answers_are_shuffled_once_by_their_row(spark):
    """The window over a row's answers and the join with its profile share one shuffle, of the table's own columns."""
    ctx = Ctx(spark, SF)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of a size
    try:
        plan = plan_of(ctx.answers)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange hashpartitioning(l_orderkey" in plan and plan.count("Exchange hashpartitioning(row_id") <= 1
    side = plan[plan.index("Window"):]
    assert "Exchange hashpartitioning(row_id" not in plan[:plan.index("Window")] and "Supplier" not in side[:side.index("FileScan")]


@data
def test_reasons_need_no_row_per_feature(spark):
    """The reasons come from lists, with no explosion after the requests' join, and are those of the long table;
    a key of several rows and a class of its own for each too."""
    from fieldcast.operators import explain as EX
    from fieldcast.plans import q_model as Q
    ctx = Ctx(spark, SF)
    ctx.__dict__["profiles"] = ctx.profiles.unionByName(ctx.profiles.filter("row_id % 5 = 0")).localCheckpoint()
    expl = Q.leading_drivers(ctx)
    plan = plan_of(expl)
    assert "inline(_all" not in plan and "WindowGroupLimit" not in plan
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(EX.reasons(expl)) == rows(EX.reasons(Q.explanations(ctx)))


def test_scoring_tasks_follow_the_work(spark):
    """An indicator with most of the profiles is scored in several slices, one with few in one: no task has it all."""
    inputs = spark.createDataFrame([("wide", b) for b in range(2)] + [("few", b) for b in range(9)], "indicator string, block int")
    profiles = spark.createDataFrame([("wide", b) for b in range(40)] + [("few", 0)], "indicator string, block int")
    got = {r.indicator: (r.blocks, r.slices) for r in WS._slices(inputs, profiles, 16).collect()}
    assert got == {"wide": (2, 8), "few": (9, 1)}


def test_nearest_classes_are_compared_at_once(monkeypatch):
    """Inputs with a class near their best one are compared after all inputs met the profiles, not in every small step;
    class, likelihood and sum are those of plain loops."""
    import numpy as np
    import pyarrow as pa
    rnd = np.random.default_rng(4)
    n, classes, alphas = 300, 40, [0.5, 1.0]
    coded = rnd.integers(-1, 6, (len(WS.FEATURES), n))
    of = lambda f, c: c + 6 * f if c >= 0 else -1
    arrays = [pa.array(np.arange(n))] + [pa.array([of(f, c) for c in coded[f]]) for f in range(len(WS.FEATURES))]
    counts = np.where(rnd.random((classes, 6 * len(WS.FEATURES))) < 0.4, rnd.integers(1, 5, (classes, 6 * len(WS.FEATURES))), 0)
    base, copies = rnd.normal(-3, 1, (2, classes)), rnd.integers(1, 3, classes).astype(float)
    monkeypatch.setattr(WS, "CELLS", 20 * classes)
    compared, plain = [], WS._Inputs._better
    monkeypatch.setattr(WS._Inputs, "_better", lambda self, a, rows, *x: (compared.append(len(rows)), plain(self, a, rows, *x))[1])
    held = WS._Inputs(0, pa.StructArray.from_arrays(arrays, ["id", *WS.FEATURES]), alphas)
    for half in (slice(0, 20), slice(20, 40)):
        at, codes = np.nonzero(counts[half])
        held.meet(np.arange(classes)[half], base[:, half], copies[half], codes, counts[half][at, codes], at)
    assert all(c == 40 for c in compared[:7]) and len(compared) < 2 * 2 * 300 // 20  # steps of 40 inputs, full ones first
    got = {(r["id"], r["a"]): r for r in held.result().to_pylist()}
    for i in range(n):
        met = [of(f, c) for f, c in enumerate(coded[:, i]) if c >= 0]
        for a, alpha in enumerate(alphas):
            p = np.exp(base[a]) * np.prod(1 + counts[:, met] / alpha, axis=1)
            r = got[i, a]
            assert r["idx"] == p.argmax() and abs(r["best"] / p.max() - 1) < 1e-9 and abs(r["total"] / (p @ copies) - 1) < 1e-9
