"""Boosted trees, published versions, the refresh stream's versions, run batches, synonyms, exports, LSH."""

import itertools
import json
import random

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from fieldcast.operators import trees as TR
from fieldcast.plans.context import Ctx
from fieldcast.plans.q_model import Model, encoded_profiles, publish_model, tree_table
from fieldcast.sources import store

SF = "/root/testdata/sf0.001"
FAST = {"n_estimators": 3, "max_depth": 2}


@pytest.fixture(scope="module")
def ctx(spark):
    return Ctx(spark, SF)


@pytest.fixture(scope="module")
def model(ctx):
    return Model(ctx)


@pytest.fixture(scope="module")
def trained(spark, ctx, model):
    table, k = tree_table(ctx, model)
    models, summary = TR.train_all(spark, table, k, FAST)
    return table, k, models, summary


# --------------------------------------------------------------------- trees
@pytest.mark.parametrize("k", [2, 3, 5, 6, 8, 13])
def test_decoding_equals_all_classes(spark, k):
    """The short expressions over the bits against the list of all class numbers."""
    rnd = random.Random(k)
    n = TR.n_parts(k)
    rows = [tuple(rnd.choice((rnd.random(), 0.0, 1.0)) for _ in range(n)) for _ in range(60)]
    df = spark.createDataFrame(rows, ", ".join(f"_p{j} double" for j in range(n)))
    idx, p, total = TR.decode(TR.TreeModel(k, (None,) * n), [f"_p{j}" for j in range(n)])
    for row, r in zip(rows, df.select("*", idx.alias("idx"), p.alias("p"), total.alias("total")).collect()):
        if k == 2:
            each = [1 - row[0], row[0]]
        elif k <= TR.ONE_VS_REST:
            each = list(row)
        else:
            each = [1.0] * k
            for c, j in itertools.product(range(k), range(n)):
                each[c] *= row[j] if c >> j & 1 else 1 - row[j]
        assert r.total == pytest.approx(sum(each))
        if sum(each) > 0:
            assert each[r.idx] == pytest.approx(max(each)) and r.p == pytest.approx(max(each) / sum(each))
        else:
            assert 0 <= r.idx < k and r.p == pytest.approx(1 / k)


def test_trees_of_every_indicator(spark, ctx, model, trained, tmpdir_path):
    table, k, models, summary = trained
    rows = {r.indicator: r for r in summary.collect()}
    assert set(rows) == set(model.modelled_list) and {r.algorithm for r in rows.values()} == {"boosted", "one_vs_rest", "binary_code"}
    assert rows["SM-5"].n_models == (k["SM-5"] - 1).bit_length()
    asked = encoded_profiles(ctx)
    out = TR.predict(asked, models, model.model.classes).collect()
    assert len(out) == asked.count() * len(k) and all(0 < r.confidence <= 100 + 1e-9 and r.predicted_class for r in out)
    TR.save(models, spark, tmpdir_path)
    again = TR.predict(asked, TR.load(spark, tmpdir_path), model.model.classes).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, out))


def test_trees_learn(spark):
    """150 classes by their bits: the class follows from the feature."""
    rows = [("A", i, float(i % 150), 1.0, Vectors.dense([float(i % 150)]), False, True, 0, 2) for i in range(600)]
    table = spark.createDataFrame(rows, ["indicator", "row_key", "label", "weight", "features", "is_test", "eval_on_train", "fold", "n_folds"])
    _, summary = TR.train_all(spark, table, {"A": 150}, {"n_estimators": 8, "learning_rate": 0.3, "subsample": 1.0, "max_depth": 8})
    r = summary.first()
    assert r.n_models == 8 and r.test_rows == 600 and r.accuracy > 0.5


def test_grid_search_over_the_stored_folds(spark):
    rows = [("A", i, float(i % 2), 1.0, Vectors.dense([float(i % 2), float(i % 7)]), False, False, i // 2 % 3, 3) for i in range(600)]
    rows += [("few", i, float(i % 2), 1.0, Vectors.dense([0.0, 0.0]), False, False, i % 2, 2) for i in range(20)]
    table = spark.createDataFrame(rows, ["indicator", "row_key", "label", "weight", "features", "is_test", "eval_on_train", "fold", "n_folds"])
    grid = {"max_depth": [1, 2], "n_estimators": [2], "learning_rate": [0.1], "subsample": [1.0]}
    got = TR.grid_search(spark, table, {"A": 2, "few": 2}, grid).collect()
    assert len(got) == 2 and {r.indicator for r in got} == {"A"} and all(r.cv_accuracy == 1.0 for r in got)
    assert [r.max_depth for r in got if r.best] == [1]


def test_refit_changes_ready_indicators_only(spark, trained):
    table, k, models, _ = trained
    two = [i for i in k if k[i] == 2][:2]
    corrections = table.filter(F.col("indicator") == two[0]).withColumn("label", F.lit(1.0))
    corrections = corrections.unionByName(corrections).unionByName(corrections)
    new = TR.refit(table, corrections, models, [two[0]], FAST)
    rows = table.filter(F.col("indicator") == two[0]).select("row_key", "features")
    mean = {n: TR.predict_one(rows, m[two[0]]).agg(F.avg("idx")).first()[0] for n, m in (("old", models), ("new", new))}
    assert mean["new"] > mean["old"] and new[two[1]] is models[two[1]]


# ------------------------------------------------------------------ versions
def answers(predictor, ctx):
    return sorted(map(repr, predictor.predict(ctx.profiles).collect()))


def test_a_rollback_predicts_as_before(spark, ctx, model, trained, tmpdir_path):
    root, registry = f"{tmpdir_path}/models", f"{tmpdir_path}/registry"
    small = {i: m for i, m in trained[2].items() if m.n_classes == 2}
    assert publish_model(ctx, model, root, "v_1", registry, small)
    assert not publish_model(ctx, model, root, "v_1", registry)
    a = store.Predictor(spark, root)
    before, trees = answers(a, ctx), sorted(map(repr, a.predict_trees(ctx.profiles).collect()))
    assert trees and a.encoders.count() and a.modes.count()
    half = Model(ctx, model.modelled_list[:2])
    assert publish_model(ctx, half, root, "v_2", registry)
    store.save_state(spark, {"classes": model.model.classes}, "v_3", root)  # broken off: never marked
    assert store.current_version(spark, root) == "v_2" and answers(store.Predictor(spark, root), ctx) != before
    store.pin(spark, root, "v_1")
    back = store.Predictor(spark, root)
    assert back.version == "v_1" and answers(back, ctx) == before
    assert sorted(map(repr, back.predict_trees(ctx.profiles).collect())) == trees
    with pytest.raises(ValueError):
        store.pin(spark, root, "v_3")
    listed = store.latest_versions(spark.read.parquet(registry)).collect()
    assert [r.version for r in listed] == ["v_2", "v_1"] and listed[1].total_models == len(model.modelled_list)


def test_the_stream_publishes_a_batch_once(spark, ctx, model, tmpdir_path):
    from fieldcast.streaming import feedback_stream as FS
    root, registry, out = (f"{tmpdir_path}/{n}" for n in ("models", "registry", "out"))
    base = {"meta": ctx.meta}
    src = FS.land_feedback(ctx.feedback, f"{tmpdir_path}/log", files=4)
    publish = FS.publisher(spark, root, registry, model.model, base)
    seen = []

    def watched(counts, fresh, batch_id):
        seen.append((batch_id, publish(counts, fresh, batch_id)))

    FS.refit_stream(spark, src, out, f"{tmpdir_path}/ckpt", model.model, model.modelled, 1, publish=watched)
    versions = store.committed(spark, root)
    assert versions and len(versions) == sum(done for _, done in seen)
    assert len(store.committed(spark, f"{out}/state")) <= 2 < len(seen)
    # all batches again, as after a lost checkpoint: the same versions, none twice
    FS.refit_stream(spark, src, out + "2", f"{tmpdir_path}/ckpt2", model.model, model.modelled, 1, publish=watched)
    assert store.committed(spark, root) == versions and spark.read.parquet(registry).count() == len(versions)
    # the newest version is base and all corrections
    newest = store.load_state(spark, versions[-1], ("fv",), root)["fv"]
    from fieldcast.operators.feedback import fold_corrections
    want = fold_corrections(model.model, ctx.feedback, model.modelled, spark).filter("feature <> '__class__'")
    cols = ["indicator", "class", "feature", "value", "n"]
    assert sorted(map(tuple, newest.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
    assert store.Predictor(spark, root).predict(ctx.profiles.limit(2)).count() == 2 * len(model.modelled_list)


# -------------------------------------------------------------------- sinks
def test_a_crash_between_items_and_runs_leaves_each_run_once(spark, tmpdir_path):
    items = spark.createDataFrame([("r1", "a"), ("r1", "b"), ("r2", "a")], "run_id string, indicator string")
    runs = items.select("run_id").distinct()
    items.write.parquet(f"{tmpdir_path}/b1/prediction_items")  # the writer died here
    assert store.read_history(spark, tmpdir_path, "prediction_runs") is None
    for _ in range(2):
        store.append_run(runs, items, tmpdir_path, "b1")
    store.append_run(runs.withColumn("run_id", F.concat("run_id", F.lit("x"))), items, tmpdir_path, "b2")
    assert store.read_history(spark, tmpdir_path, "prediction_runs").count() == 4
    assert store.read_history(spark, tmpdir_path, "prediction_items").count() == 6


def test_a_synonym_file_reaches_the_model(spark, tmpdir_path):
    from fieldcast.operators import features as FE
    from fieldcast.sources.assessments import read_synonyms
    with open(f"{tmpdir_path}/s.json", "w") as f:
        json.dump({"CROP_0": "Mine", "_note": "x", "same": "same"}, f)
    table = read_synonyms(spark, f"{tmpdir_path}/s.json")
    df = spark.createDataFrame([("CROP_0", "c", "p", None, None, "1", 1.0, 2000)], "crop_name string, country_code string, partner string, subpartner string, irrigation string, hired_workers string, area double, planYear int")
    assert FE.prepare(df, spark, table).first().crop_country == "Mine_c"
    crops = Ctx(spark, SF).profiles.select("crop_name").distinct().first()[0]
    own = spark.createDataFrame([(crops.strip(), "Own")], "local string, canonical string")
    m = Model(Ctx(spark, SF, own), ["BH-2"])
    assert m.ex.filter("crop_name = 'Own'").count() > 0


def test_export_is_csv(spark, tmpdir_path):
    from fieldcast.operators.predict import write_export
    rows = [("p", "A", 'say "yes", no', None, 81.25), ("p", "B", None, ["x", "y"], 40.0)]
    df = spark.createDataFrame(rows, "profile_id string, indicator string, value string, suggestedOptions array<string>, confidence double")
    write_export(df, f"{tmpdir_path}/csv")
    got = spark.read.option("header", True).option("escape", '"').csv(f"{tmpdir_path}/csv").orderBy("Indicator").collect()
    assert got[0].Predicted_Value == 'say "yes", no' and got[1]["Confidence_%"] == "40.0%"


def test_lsh_neighbours_are_mostly_the_exact_ones(spark, ctx, model):
    from fieldcast.operators import features as FE
    from fieldcast.operators import similar as SIM
    from fieldcast.plans.q_model import train_profiles
    tp = train_profiles(ctx)
    enc, modes = FE.fit_encoders(tp), FE.fit_modes(tp)
    rows = FE.encode(FE.prepare(ctx.profiles, spark), enc, modes, ["row_id"])
    train = rows.withColumnRenamed("row_id", "train_id")
    exact = {(r.row_id, r.neighbour_id) for r in SIM.nearest(rows, train, "row_id", "train_id").collect()}
    found = {(r.row_id, r.neighbour_id) for r in SIM.nearest_lsh(rows, train, "row_id", "train_id").collect()}
    assert len(exact & found) >= 0.9 * len(exact)
