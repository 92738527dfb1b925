"""Queries over features and the count model: encoders, counts, split, metrics,
batch prediction, year-over-year, explanations and feedback folding."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcast import constants as C
from fieldcast.functions import scalar as X
from fieldcast.operators import countmodel as CM
from fieldcast.operators import explain as EX
from fieldcast.operators import features as FE
from fieldcast.operators import history as H
from fieldcast.operators import metadata as MD
from fieldcast.operators import predict as P
from fieldcast.plans.context import PROFILE_COLS, Ctx
from fieldcast.plans.oracle_views import with_views
from fieldcast.plans.registry import query
from fieldcast.plans.q_history import SEC
from fieldcast.plans.sql import PCOLS
from fieldcast.operators.util import materialize
from fieldcast.plans.sql_model import (CATEGORICAL, NB_FEATURES, base_ctes, bucket_cols, eval_ctes,
                                       model_ctes, prepared_cols, request_ctes, score_ctes)

DEC = "decimal(18,6)"
VIEWS = ["f_profiles", "f_answers"]


class Model:
    """Lazily built model plans for one context.

    ``meta`` tells whether the question metadata is read too.  Then the answers are
    written, since both it and the first answers come from them; otherwise the first
    answers alone read them, in the tasks that made them: a written table of answers
    is so small on disk that its scan would sort millions of rows a task."""

    def __init__(self, ctx: Ctx, only: list[str] | None = None, meta: bool = True):
        self.ctx = ctx.share_answers() if meta else ctx
        self.spark = ctx.spark
        self.asked = only
        if meta:
            # question metadata is questionnaire-sized and read by several plans: write it once
            self.ctx.__dict__["meta"] = materialize(self.ctx.meta, "meta")

    @cached_property
    def first_rows(self) -> DataFrame:
        """First answers (with their row), written once: the trainable test,
        the training rows and the encoders all read them."""
        return materialize(self.ctx.first_rows)

    @cached_property
    def modelled(self) -> DataFrame:
        """Indicators that get a model: every trainable one (P7), however many
        distinct answers it has, or of these the ones that were asked for.  Every
        other question of the metadata is a manual-entry row."""
        first = self.first_rows
        return materialize(CM.trainable(first if self.asked is None else first.filter(F.col("indicator").isin(self.asked))))

    @cached_property
    def modelled_list(self) -> list[str]:
        return [r[0] for r in self.modelled.select("indicator").orderBy("indicator").collect()]

    @cached_property
    def ex(self) -> DataFrame:
        """Training rows, written once to the checkpoint folder: the model and the
        split read them, and the answer pipeline behind them (window + join +
        aggregation) must not run again for each.  ``_row`` numbers them."""
        return materialize(self._examples.withColumn("_row", F.monotonically_increasing_id()))

    @property
    def _examples(self) -> DataFrame:
        return CM.examples(self.first_rows, self.modelled, self.spark, self.ctx.synonyms)

    @cached_property
    def model(self) -> CM.CountModel:
        # the fit reads its rows once: they are written first only where the split reads them too
        return CM.fit(self.ex if "ex" in self.__dict__ else self._examples).materialized()

    @cached_property
    def split(self) -> DataFrame:
        """Training rows with their holdout slot and fold; only evaluation needs
        the ranks behind them."""
        return materialize(CM.split(self.ex))

    @cached_property
    def slots(self) -> DataFrame:
        """The keys of the training rows with their holdout slot and fold; the features
        are not asked for, so none is carried through the ranks."""
        if "split" in self.__dict__:
            return self.split.drop(*NB_FEATURES)
        return materialize(CM.split_keys(self.ex if "ex" in self.__dict__ else self._examples))

    @cached_property
    def evaluation(self) -> tuple[DataFrame, DataFrame]:
        return CM.evaluate(self.split)

    def inputs(self, extra_prev_year: bool = False, previous: int | None = None) -> DataFrame:
        """Every profile (order) with its 11 model features.  ``extra_prev_year`` adds
        ``prev_year``: the year ``previous``, or if none is given the one before the
        profile's own."""
        b = CM.bucket_features(FE.prepare(self.ctx.profiles, self.spark, self.ctx.synonyms))
        cols = [F.col("row_id").alias("profile_id"), *NB_FEATURES]
        if extra_prev_year:
            year = F.floor(F.col("planYear") - 1) if previous is None else F.lit(previous)
            cols.append(year.cast("bigint").cast("string").alias("prev_year"))
        return b.select(*cols)

    def requests(self, indicators: list[str] | None = None, extra_prev_year: bool = False, previous: int | None = None) -> DataFrame:
        """Every profile as a request, one row per modelled indicator.  The indicator
        list is questionnaire metadata, expanded with ``explode``."""
        ids = indicators if indicators is not None else self.modelled_list
        return self.inputs(extra_prev_year, previous).withColumn("indicator", F.explode(F.array(*[F.lit(i) for i in ids])))

    def predicted(self, indicators: list[str] | None = None, fold: list | None = None) -> DataFrame:
        """The class and confidence of every profile and modelled indicator, or the ``fold`` over each profile's."""
        return CM.predict_profiles(self.inputs(), indicators if indicators is not None else self.modelled_list, self.model, "profile_id", fold=fold)

    def predictions(self, indicators: list[str] | None = None) -> DataFrame:
        """M6: shaped predictions for every profile and modelled indicator."""
        self.ex  # read by the model and the evaluation
        raw = self.predicted(indicators)
        acc = self.evaluation[1].select("indicator", (F.col("accuracy") * 100).cast(DEC).alias("model_accuracy"))
        p = P.shape_values(raw, self.ctx.meta)
        p = P.add_policy(p)
        # a row per question on the right: read once, not computed again for each task of the left
        return p.join(F.broadcast(materialize(acc, "accuracy")), "indicator", "left").select(
            "profile_id", "indicator", "value", "suggestedOptions", F.col("confidence").cast(DEC).alias("confidence"),
            "policy", "ui_status", F.lit(C.SOURCE_MODEL).alias("source"), "model_accuracy")


    def all_rows(self) -> DataFrame:
        """Predictions and the manual-entry rows of all other questions."""
        p = self.predictions()
        manual = P.manual_rows(self.ctx.profiles.select(F.col("row_id").alias("profile_id")), self.ctx.meta,
                               modelled=self.modelled_list)
        return p.unionByName(manual.select("profile_id", "indicator", "value",
                                           F.lit(None).cast("array<string>").alias("suggestedOptions"),
                                           F.col("confidence").cast(DEC).alias("confidence"), "policy", "ui_status",
                                           "source", F.lit(None).cast(DEC).alias("model_accuracy")))


def _m(ctx: Ctx, only: list[str] | None = None, meta: bool = True) -> Model:
    return Model(ctx, only, meta)


def _sql(extra: list[tuple[str, str]], body: str, views: list[str] | None = None) -> str:
    return with_views(views or VIEWS, base_ctes() + extra, body)


# ---------------------------------------------------------------- features
def train_profiles(ctx: Ctx, first: DataFrame | None = None) -> DataFrame:
    """Distinct profiles with at least one answer (the pivot's rows), prepared.  They are
    written once: the encoders, the modes and the encoding each read them, and the
    answers behind them must not be made again for each.  ``first``: the first answers,
    where they are written already."""
    t = (ctx.first if first is None else first).filter(F.col("answer").isNotNull()).select(*PROFILE_COLS).distinct()
    return FE.prepare(materialize(t, "train_profiles"), ctx.spark, ctx.synonyms)


TP = f"SELECT DISTINCT {PCOLS} FROM first_rows WHERE answer IS NOT NULL"


def _tp_prepared() -> str:
    pc = prepared_cols("t")
    return "SELECT " + ", ".join(f'{v} AS "{k}"' for k, v in pc.items()) + " FROM tp t"


ENC_CTES = [("tp", TP), ("tpp", _tp_prepared()),
            ("encv", "\nUNION ".join(f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS value FROM tpp" for c in CATEGORICAL)
             + "\nUNION " + "\nUNION ".join(f"SELECT '{c}', 'Unknown'" for c in CATEGORICAL)),
            ("enc", "SELECT feature, value, CAST(row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS INT) AS code FROM encv"),
            ("encn", "\nUNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS value FROM tpp" for c in CATEGORICAL)),
            ("modes", """SELECT feature, value AS mode_value FROM (
                           SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY count(*) DESC, value) AS rn
                           FROM encn GROUP BY feature, value) t WHERE rn = 1""")]


def _encoded_select(src: str, keep: str, unseen_mode: bool = True) -> str:
    joins, cols = [], []
    for j, c in enumerate(CATEGORICAL):
        joins.append(f"LEFT JOIN enc e{j} ON e{j}.feature = '{c}' AND e{j}.value = s.\"{c}\"")
        fb = (f"(SELECT e.code FROM enc e JOIN modes m ON m.feature = e.feature AND m.mode_value = e.value "
              f"WHERE e.feature = '{c}')")
        cols.append(f"coalesce(e{j}.code, {fb}) AS {c}_encoded")
    num = [f's."{c}" AS "{c}"' for c in C.NUMERIC_COLUMNS]
    order = [f"{c}_encoded" if c in C.CATEGORY_COLUMNS else None for c in C.FEATURE_COLUMNS]
    sel = []
    enc_by = {c: cols[j] for j, c in enumerate(CATEGORICAL)}
    for c in C.FEATURE_COLUMNS:
        sel.append(enc_by[c] if c in C.CATEGORY_COLUMNS else f's."{c}" AS "{c}"')
    for name, _, _ in C.INTERACTIONS:
        sel.append(enc_by[name])
    del num, order
    return f"SELECT {keep}{', ' if keep else ''}{', '.join(sel)} FROM {src} s " + " ".join(joins)


@query("encoder_fit", oracle=_sql(ENC_CTES, "SELECT * FROM enc"))
def encoder_fit(ctx: Ctx):
    """Category dictionaries (sorted distinct + 'Unknown' -> code)."""
    return FE.fit_encoders(train_profiles(ctx))


@query("feature_modes", oracle=_sql(ENC_CTES, "SELECT * FROM modes"))
def feature_modes(ctx: Ctx):
    """A5: most frequent value per categorical feature (ties -> smallest)."""
    return FE.fit_modes(train_profiles(ctx))


@query("encode_fit_transform", oracle=_sql(ENC_CTES, _encoded_select(
    "tpp", ", ".join(f's."{c}" AS "raw_{c}"' for c in C.CATEGORY_COLUMNS))))
def encode_fit_transform(ctx: Ctx):
    """M1: training profiles with 11 encoded features (8 codes + 3 numerics)."""
    tp = train_profiles(ctx)
    keep = [F.col(c).alias(f"raw_{c}") for c in C.CATEGORY_COLUMNS]
    tp = tp.select(*[F.col(c) for c in tp.columns], *keep)
    enc = FE.fit_encoders(tp)
    modes = FE.fit_modes(tp)
    return FE.encode(tp, enc, modes, [f"raw_{c}" for c in C.CATEGORY_COLUMNS])


@query("encode_apply", oracle=_sql(ENC_CTES + [
    ("req", "SELECT p.row_id, " + ", ".join(f'{v} AS "{k}"' for k, v in prepared_cols("p").items()) + " FROM f_profiles p")],
    _encoded_select("req", "s.row_id")))
def encode_apply(ctx: Ctx):
    """New profiles encoded with the fitted dictionaries (unseen -> mode)."""
    tp = train_profiles(ctx)
    enc, modes = FE.fit_encoders(tp), FE.fit_modes(tp)
    req = FE.prepare(ctx.profiles, ctx.spark, ctx.synonyms)
    return FE.encode(req, enc, modes, ["row_id"])


# ---------------------------------------------------------------- count model
@query("nb_counts", oracle=_sql(model_ctes("m_", "ex"), "SELECT * FROM m_fv"))
def nb_counts(ctx: Ctx):
    """(indicator, class, feature, value, n) — all indicators in one aggregation."""
    return _m(ctx, meta=False).model.fv


@query("nb_model", oracle=_sql(model_ctes("m_", "ex"), """
SELECT f.indicator, f.class, f.feature, f.value,
       CAST(ln((f.n + 1) / (c.n_class + v.V)) AS DECIMAL(18,6)) AS logp
FROM m_fv f JOIN m_cls c ON c.indicator = f.indicator AND c.class = f.class
            JOIN m_voc v ON v.indicator = f.indicator AND v.feature = f.feature
UNION ALL
SELECT indicator, class, '__prior__', '', CAST(ln(n_class / n_rows) AS DECIMAL(18,6)) FROM m_cls"""))
def nb_model(ctx: Ctx):
    """Smoothed log-probabilities ln P(value | class) and class priors."""
    return CM.log_probs(_m(ctx, meta=False).model)


@query("stratified_split", oracle=_sql([], "SELECT indicator, row_key, class, is_test, eval_on_train FROM split"))
def stratified_split(ctx: Ctx):
    """Deterministic stratified 80/20 holdout slots."""
    return _m(ctx, meta=False).slots.select("indicator", "row_key", "class", "is_test", "eval_on_train")


@query("cv_folds", oracle=_sql([], "SELECT indicator, row_key, class, n_folds, fold FROM split"))
def cv_folds(ctx: Ctx):
    """Stratified fold numbers, k = max(2, min(5, smallest class))."""
    return _m(ctx, meta=False).slots.select("indicator", "row_key", "class", "n_folds", "fold")


@query("class_weights", oracle=_sql([
    ("cw0", """SELECT indicator, class, count(*) AS n_class FROM split WHERE NOT is_test OR eval_on_train
               GROUP BY indicator, class"""),
    ("cw1", """SELECT *, sum(n_class) OVER (PARTITION BY indicator) AS n, count(*) OVER (PARTITION BY indicator) AS k,
                      row_number() OVER (PARTITION BY indicator ORDER BY class) - 1 AS idx FROM cw0"""),
    ("cw2", "SELECT *, max(CASE WHEN idx = 0 THEN n_class END) OVER (PARTITION BY indicator) AS n0 FROM cw1")],
    """SELECT indicator, class, n_class,
              CAST(CASE WHEN k = 2 THEN CASE WHEN idx = 1 THEN n0 / n_class ELSE 1.0 END
                        ELSE n / (k * n_class) END AS DECIMAL(18,6)) AS weight FROM cw2"""))
def class_weights(ctx: Ctx):
    """Balanced class weights on the training slots."""
    return CM.class_weights(_m(ctx, meta=False).slots)


@query("confusion_matrix", oracle=_sql(eval_ctes(), "SELECT * FROM cm"))
def confusion_matrix(ctx: Ctx):
    """Holdout confusion counts (indicator, actual, predicted, n)."""
    return _m(ctx, meta=False).evaluation[0]


@query("classification_metrics", oracle=_sql(eval_ctes(), """
SELECT indicator, CAST(accuracy AS DECIMAL(18,6)) AS accuracy, CAST(precision AS DECIMAL(18,6)) AS precision,
       CAST(recall AS DECIMAL(18,6)) AS recall, CAST(f1_score AS DECIMAL(18,6)) AS f1_score, test_samples
FROM metrics"""))
def classification_metrics(ctx: Ctx):
    """Holdout accuracy, precision, recall, F1 (binary on the second class,
    support-weighted otherwise)."""
    m = _m(ctx, meta=False).evaluation[1]
    return m.select("indicator", *[F.col(c).cast(DEC).alias(c) for c in ["accuracy", "precision", "recall", "f1_score"]],
                    "test_samples")


FULL = ["accuracy", "f1_score", "precision", "recall"]
REPORT_CTES = [
    ("msec", f"SELECT x.*, {SEC.format(x='x.indicator')} AS section FROM metrics x"),
    ("cls", f"SELECT indicator, list(class ORDER BY class) AS classes FROM h_cls WHERE n_classes <= {C.MAX_CLASSES} GROUP BY indicator"),
    ("trained", "SELECT indicator, count(*) AS training_samples FROM tr GROUP BY indicator"),
    ("cmx", """SELECT indicator, list_sort(list(concat_ws('|', actual, predicted, n))) AS confusion
               FROM cm WHERE indicator IN (SELECT indicator FROM cls) GROUP BY indicator""")]


@query("model_report", oracle=_sql(eval_ctes() + REPORT_CTES, "SELECT m.indicator, m.section, t.training_samples, m.test_samples, "
       + ", ".join(f"CAST(m.{c} * 100 AS DECIMAL(18,6)) AS {c}" for c in FULL)
       + ", c.classes, x.confusion FROM msec m JOIN trained t USING (indicator) LEFT JOIN cls c USING (indicator) LEFT JOIN cmx x USING (indicator)"))
def model_report(ctx: Ctx):
    """Every indicator's metrics in percent, its classes and its confusion
    matrix (the cells above zero as 'actual|predicted|n').  An indicator whose classes grow with the data
    has its cells in ``confusion_matrix`` alone: a list of them would too."""
    m = _m(ctx, meta=False)
    confusion, metrics = m.evaluation
    counts = m.split.filter(~F.col("is_test") | F.col("eval_on_train")).groupBy("indicator", "class").agg(F.count(F.lit(1)).alias("n"))
    trained = materialize(counts.groupBy("indicator").agg(F.sum("n").alias("training_samples"), F.count(F.lit(1)).alias("k")), "trained")
    few = F.broadcast(trained.filter(F.col("k") <= C.MAX_CLASSES).select("indicator"))
    classes = counts.join(few, "indicator").groupBy("indicator").agg(F.sort_array(F.collect_list("class")).alias("classes"))
    cells = confusion.join(few, "indicator").groupBy("indicator") \
        .agg(F.sort_array(F.collect_list(F.concat_ws("|", "actual", "predicted", "n"))).alias("confusion"))
    out = MD.with_section(metrics, ctx.spark).join(trained, "indicator").join(classes, "indicator", "left").join(cells, "indicator", "left")
    return out.select("indicator", "section", "training_samples", "test_samples", *[(F.col(c) * 100).cast(DEC).alias(c) for c in FULL],
                      "classes", "confusion")


@query("model_report_summary", oracle=_sql(eval_ctes() + REPORT_CTES, "SELECT count(*) AS total_models, sum(t.training_samples)::BIGINT AS training_samples, "
       + ", ".join(f"CAST(coalesce(avg(round(m.{c} * 100, 2)), 0) AS DECIMAL(18,6)) AS average_{c}" for c in FULL) + " FROM msec m JOIN trained t USING (indicator)"))
def model_report_summary(ctx: Ctx):
    """Number of models, and the averages of their rounded metrics."""
    m = _m(ctx, meta=False)
    trained = m.split.filter(~F.col("is_test") | F.col("eval_on_train")).groupBy("indicator").agg(F.count(F.lit(1)).alias("training_samples"))
    average = lambda c: F.coalesce(F.avg(F.round(F.col(c) * 100, 2)), F.lit(0.0)).cast(DEC).alias(f"average_{c}")
    return m.evaluation[1].join(trained, "indicator").agg(F.count(F.lit(1)).alias("total_models"), F.sum("training_samples").cast("bigint").alias("training_samples"),
                                                          *[average(c) for c in FULL])


PRED_BODY = """
SELECT p.profile_id, p.indicator,
       CASE WHEN mt.type = 'checkbox' THEN NULL ELSE p.predicted_class END AS value,
       CASE WHEN mt.type = 'checkbox' THEN [p.predicted_class] END AS "suggestedOptions",
       CAST(p.confidence AS DECIMAL(18,6)) AS confidence,
       CASE WHEN p.confidence >= 70 THEN 'auto_fill' WHEN p.confidence >= 40 THEN 'suggest' ELSE 'suggest_low' END AS policy,
       CASE WHEN p.confidence >= 70 THEN 'green' WHEN p.confidence >= 40 THEN 'amber' ELSE 'red' END AS ui_status,
       'count_model_v1' AS source, CAST(mx.accuracy * 100 AS DECIMAL(18,6)) AS model_accuracy
FROM r_pred p LEFT JOIN meta mt ON mt.indicator = p.indicator LEFT JOIN metrics mx ON mx.indicator = p.indicator
"""


MANUAL_BODY = f"""
UNION ALL
SELECT p.row_id, q.indicator, NULL, NULL, CAST(0 AS DECIMAL(18,6)), 'manual_entry', 'red', '{C.SOURCE_NO_MODEL}', NULL
FROM f_profiles p, (SELECT indicator FROM meta WHERE indicator NOT IN (SELECT indicator FROM modelled)) q
"""


@query("predict_batch", oracle=_sql(eval_ctes() + request_ctes(), PRED_BODY + MANUAL_BODY))
def predict_batch(ctx: Ctx):
    """Every profile x every question of the metadata -> class,
    confidence, policy of the modelled ones, a manual-entry row for the others;
    scored once per distinct input, which one shuffle of the profiles joins back."""
    return _m(ctx).all_rows()


RECORD_BODY = """
SELECT profile_id, CAST(avg(confidence) AS DECIMAL(18,6)) AS mean_confidence, count(*) AS predicted
FROM r_pred GROUP BY profile_id"""


@query("record_confidence", oracle=_sql(eval_ctes() + request_ctes(), RECORD_BODY))
def record_confidence(ctx: Ctx):
    """Mean confidence of each record's model predictions.  Equal inputs have equal answers:
    these are summed once per distinct input, and the sums go back to the records."""
    sums = [F.sum("confidence").alias("_sum"), F.count("confidence").alias("_known"), F.count(F.lit(1)).alias("_n")]
    p = _m(ctx, meta=False).predicted(fold=sums)
    return p.groupBy("profile_id").agg((F.sum("_sum") / F.sum("_known")).cast(DEC).alias("mean_confidence"), F.sum("_n").alias("predicted"))


SUMMARY_BODY = f"""
SELECT profile_id, count(*) AS total_indicators, count(*) FILTER (WHERE ui_status = 'green') AS auto_filled,
       count(*) FILTER (WHERE ui_status <> 'green') AS needs_review,
       CAST(avg(CAST(confidence AS DOUBLE)) AS DECIMAL(18,6)) AS avg_confidence
FROM ({PRED_BODY}{MANUAL_BODY}) t GROUP BY profile_id"""


def run_summaries(rows: DataFrame, key: str) -> DataFrame:
    """What a prediction run stores about its items."""
    green = X.review_group("ui_status") == "auto_filled"
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("total_indicators"), F.count_if(green).alias("auto_filled"),
                                 F.count_if(~green).alias("needs_review"),
                                 F.avg(F.col("confidence").cast("double")).cast(DEC).alias("avg_confidence"))


@query("runs_from_predictions", oracle=_sql(eval_ctes() + request_ctes(), SUMMARY_BODY))
def runs_from_predictions(ctx: Ctx):
    """The summary of one prediction run per profile, from the model's own
    predictions and the manual-entry rows."""
    return run_summaries(_m(ctx).all_rows(), "profile_id")


def record_runs(ctx: Ctx, folder: str, batch: str) -> DataFrame:
    """Predict every profile as a run, and append its items and summary
    to the history in ``folder`` as one batch.  Run ids are drawn once and written
    before use; a batch that is committed already stays as it is."""
    from fieldcast.sources import store
    ids = materialize(ctx.profiles.select(F.col("row_id").alias("profile_id"), F.expr("uuid()").alias("run_id")), "run_ids")
    items = materialize(_m(ctx).all_rows().join(ids, "profile_id"), "run_items")
    runs = run_summaries(items, "run_id").join(ids, "run_id").withColumn("created_at", F.current_timestamp())
    store.append_run(runs, items.drop("profile_id"), folder, batch)
    return store.read_history(ctx.spark, f"{folder}", "prediction_runs")


def _one_indicator_ctes(ind: str) -> list[tuple[str, str]]:
    rc = request_ctes()
    rc[0] = (rc[0][0], rc[0][1].replace("CROSS JOIN modelled m", f"CROSS JOIN (SELECT indicator FROM modelled WHERE indicator = '{ind}') m"))
    return rc


@query("predict_one_indicator", oracle=_sql(eval_ctes() + _one_indicator_ctes("CM-5"), PRED_BODY))
def predict_one_indicator(ctx: Ctx, indicator: str = "CM-5"):
    """One indicator for every profile; only its rows are counted, evaluated and scored."""
    return _m(ctx, [indicator]).predictions()


def _yoy_ctes(previous: int | None = None) -> list[tuple[str, str]]:
    rc = request_ctes()
    prev_feats = dict(bucket_cols("p"))
    prev_feats["planYear"] = f"'{previous}'" if previous else "CAST(CAST(floor(" + prepared_cols("p")["planYear"] + " - 1) AS BIGINT) AS VARCHAR)"
    sel = ", ".join(f"{v} AS {k}" if k != "planYear" else f'{v} AS "planYear"' for k, v in prev_feats.items())
    return rc + [("reqprev", f"SELECT p.row_id AS profile_id, m.indicator, {sel} FROM f_profiles p CROSS JOIN modelled m"),
                 *score_ctes("y_", "m_", "reqprev", "profile_id"),
                 ("yoy", """SELECT c.profile_id, c.indicator, c.predicted_class <> p.predicted_class AS changed,
                              CASE WHEN c.predicted_class = p.predicted_class THEN 'stable'
                                   WHEN c.confidence > p.confidence THEN 'improved' ELSE 'changed' END AS direction,
                              p.predicted_class AS previous_value, c.predicted_class AS current_value,
                              CAST(p.confidence AS DECIMAL(18,6)) AS previous_confidence,
                              CAST(c.confidence AS DECIMAL(18,6)) AS current_confidence,
                              CAST(c.confidence - p.confidence AS DECIMAL(18,6)) AS confidence_delta
                            FROM r_pred c JOIN y_pred p ON p.profile_id = c.profile_id AND p.indicator = c.indicator""")]


def yoy(ctx: Ctx, previous: int | None = None, m: Model | None = None) -> DataFrame:
    """Each profile against the same profile in another plan year, by
    default the one before.  Both years are scored in the same row (the previous
    year only swaps the planYear look-up; wide indicators score the distinct
    inputs of both), so there is no second scoring pass and no join."""
    m = m or _m(ctx)
    s = CM.predict_profiles(m.inputs(True, previous), m.modelled_list, m.model, "profile_id", "prev_year")
    s = s.select("profile_id", "indicator", F.col("predicted_class").alias("cur"), F.col("confidence").alias("cconf"),
                 F.col("previous_class").alias("prev"), F.col("previous_confidence").alias("pconf"))
    return s.select("profile_id", "indicator", (F.col("cur") != F.col("prev")).alias("changed"),
                    X.yoy_direction("cur", "prev", "cconf", "pconf").alias("direction"),
                    F.col("prev").alias("previous_value"), F.col("cur").alias("current_value"),
                    F.col("pconf").cast(DEC).alias("previous_confidence"),
                    F.col("cconf").cast(DEC).alias("current_confidence"),
                    (F.col("cconf") - F.col("pconf")).cast(DEC).alias("confidence_delta"))


def yoy_all(ctx: Ctx, previous: int | None = None) -> DataFrame:
    """The comparison over all current predictions: a manual-entry row has
    no value and no confidence in either year, and is stable."""
    m = _m(ctx)
    manual = P.manual_rows(ctx.profiles.select(F.col("row_id").alias("profile_id")), ctx.meta, modelled=m.modelled_list)
    blank, none = F.lit(""), F.lit(0).cast(DEC)
    return yoy(ctx, previous, m).unionByName(manual.select(
        "profile_id", "indicator", F.lit(False).alias("changed"), F.lit("stable").alias("direction"), blank.alias("previous_value"),
        blank.alias("current_value"), none.alias("previous_confidence"), none.alias("current_confidence"), none.alias("confidence_delta")))


YOY_ALL = """
SELECT profile_id, indicator, changed, direction, previous_value, current_value, previous_confidence, current_confidence, confidence_delta FROM yoy
UNION ALL
SELECT p.row_id, q.indicator, false, 'stable', '', '', CAST(0 AS DECIMAL(18,6)), CAST(0 AS DECIMAL(18,6)), CAST(0 AS DECIMAL(18,6))
FROM f_profiles p, (SELECT indicator FROM meta WHERE indicator NOT IN (SELECT indicator FROM modelled)) q"""


@query("yoy_compare", oracle=_sql(_yoy_ctes(), YOY_ALL))
def yoy_compare(ctx: Ctx):
    """Per-question change against the previous plan year."""
    return yoy_all(ctx)


#: A plan year that the fixture's profiles have.
CHOSEN_YEAR = 1995


@query("yoy_chosen_year", oracle=_sql(_yoy_ctes(CHOSEN_YEAR), YOY_ALL))
def yoy_chosen_year(ctx: Ctx):
    """Per-question change against one chosen plan year."""
    return yoy_all(ctx, CHOSEN_YEAR)


@query("yoy_summary", oracle=_sql(_yoy_ctes(), f"""
SELECT profile_id, count(*) AS total_indicators, count(*) FILTER (WHERE changed) AS changed_count,
       count(*) FILTER (WHERE NOT changed) AS stable_count FROM ({YOY_ALL}) t GROUP BY profile_id"""))
def yoy_summary(ctx: Ctx):
    """Total / changed / stable per profile, manual-entry rows included."""
    return yoy_all(ctx).groupBy("profile_id").agg(F.count(F.lit(1)).alias("total_indicators"),
                                                  F.count_if("changed").alias("changed_count"),
                                                  F.count_if(~F.col("changed")).alias("stable_count"))


# ---------------------------------------------------------------- explanations
EXPLAIN_ID = "BH-1"


def _explain_ctes(ind: str) -> list[tuple[str, str]]:
    raw = []
    names = []
    for f in NB_FEATURES:
        name = f"{f}_encoded" if f in CATEGORICAL else f
        src = f'CAST(p."{f}" AS VARCHAR)' if f in C.FEATURE_COLUMNS else None
        iv = f"coalesce({src}, 'None')" if src else "''"
        raw.append(f"SELECT '{f}' AS feature, '{name}' AS raw_feature, {NB_FEATURES.index(f)} AS pos, "
                   f"p.row_id AS profile_id, {iv} AS input_value FROM f_profiles p")
        names.append(name)
    return _one_indicator_ctes(ind) + [
        ("mv", "SELECT indicator, feature, value, sum(n) AS m FROM m_fv GROUP BY indicator, feature, value"),
        ("ee", """SELECT c.indicator, c.class, v.feature,
                         sum(v.m / c.n_rows * ln((coalesce(f.n, 0) + 1) / (c.n_class + vo.V))) AS e
                  FROM mv v JOIN m_cls c ON c.indicator = v.indicator
                  JOIN m_voc vo ON vo.indicator = v.indicator AND vo.feature = v.feature
                  LEFT JOIN m_fv f ON f.indicator = v.indicator AND f.class = c.class AND f.feature = v.feature AND f.value = v.value
                  GROUP BY c.indicator, c.class, v.feature"""),
        ("iv", "\nUNION ALL ".join(raw)),
        ("contrib", """SELECT q.profile_id, q.indicator, p.predicted_class, q.feature,
                              ln((coalesce(f.n, 0) + 1) / (c.n_class + vo.V)) - e.e AS impact
                       FROM r_qs q JOIN r_pred p ON p.profile_id = q.profile_id AND p.indicator = q.indicator
                       JOIN m_cls c ON c.indicator = q.indicator AND c.class = p.predicted_class
                       JOIN m_voc vo ON vo.indicator = q.indicator AND vo.feature = q.feature
                       JOIN ee e ON e.indicator = q.indicator AND e.class = p.predicted_class AND e.feature = q.feature
                       LEFT JOIN m_fv f ON f.indicator = q.indicator AND f.class = p.predicted_class
                                        AND f.feature = q.feature AND f.value = q.value"""),
        ("readable", "SELECT * FROM (VALUES " + ", ".join(
            "('{}', '{}')".format(n, n.replace("_encoded", "").replace("_", " ").title()) for n in names)
            + ") t(raw_feature, feature)"),
        ("contrib2", """SELECT c.profile_id, c.indicator, c.predicted_class, i.raw_feature,
                               (SELECT r.feature FROM readable r WHERE r.raw_feature = i.raw_feature) AS feature,
                               c.impact, i.input_value, i.pos
                        FROM contrib c JOIN iv i ON i.profile_id = c.profile_id AND i.feature = c.feature"""),
    ]


def explanations(ctx: Ctx, indicator: str = EXPLAIN_ID) -> DataFrame:
    m = _m(ctx, [indicator], meta=False)
    raw = ctx.profiles.select(F.col("row_id").alias("profile_id"), *C.FEATURE_COLUMNS)
    return EX.contributions(m.requests(), m.model, raw, "profile_id")


def leading_drivers(ctx: Ctx, indicator: str = EXPLAIN_ID) -> DataFrame:
    """The drivers of the reason sentences, a list per request; the inputs as given come along with the features."""
    m = _m(ctx, [indicator], meta=False)
    told = FE.prepare(ctx.profiles.withColumn("_iv", EX.input_values()), ctx.spark, ctx.synonyms)
    asked = CM.bucket_features(told).select(F.col("row_id").alias("profile_id"), *NB_FEATURES, "_iv")
    asked = asked.withColumn("indicator", F.explode(F.array(*[F.lit(i) for i in m.modelled_list]).cast("array<string>")))
    return EX.leading(asked, m.model, "profile_id")


@query("explain_contributions", oracle=_sql(_explain_ctes(EXPLAIN_ID), """
SELECT profile_id, indicator, predicted_class, raw_feature, feature, CAST(impact AS DECIMAL(18,6)) AS impact, input_value
FROM contrib2"""))
def explain_contributions(ctx: Ctx):
    """M8: exact additive (Shapley) contributions of each feature to the predicted
    class's log-score, against the training distribution."""
    return explanations(ctx).select("profile_id", "indicator", "predicted_class", "raw_feature", "feature",
                                    F.col("impact").cast(DEC).alias("impact"), "input_value")


@query("explain_top_drivers", oracle=_sql(_explain_ctes(EXPLAIN_ID), """
SELECT profile_id, indicator, CAST(rank AS BIGINT) AS rank, feature, impact FROM (
  SELECT profile_id, indicator, feature, CAST(impact AS DECIMAL(18,4)) AS impact,
         row_number() OVER (PARTITION BY profile_id, indicator ORDER BY abs(CAST(impact AS DECIMAL(18,4))) DESC, pos) AS rank
  FROM contrib2 WHERE abs(CAST(impact AS DECIMAL(18,4))) > 0.01) t
WHERE rank <= 5"""))
def explain_top_drivers(ctx: Ctx):
    """Top-5 drivers by |impact| (rounded to 4 places, > 0.01)."""
    return EX.top_drivers(explanations(ctx)).select("profile_id", "indicator", "rank", "feature", "impact")


@query("explain_reason")
def explain_reason(ctx: Ctx):
    """Reason sentence from the top three drivers that have an input value."""
    return EX.reasons(leading_drivers(ctx))


# ---------------------------------------------------------------- feedback folding
def _fold_ctes() -> list[tuple[str, str]]:
    bc = bucket_cols("u2")
    feats = ", ".join(f"{v} AS {k}" if k != "planYear" else f'{v} AS "planYear"' for k, v in bc.items())
    return model_ctes("m_", "ex") + [
        ("usable", "SELECT * FROM f_feedback WHERE actual_value IS NOT NULL AND actual_value <> ''"),
        ("ready", """SELECT indicator FROM usable GROUP BY indicator
                     HAVING count(*) >= 10 AND indicator IN (SELECT indicator FROM modelled)"""),
        ("uc0", """SELECT u.* FROM usable u WHERE u.indicator IN (SELECT indicator FROM ready)
                   AND EXISTS (SELECT 1 FROM m_cls c WHERE c.indicator = u.indicator AND c.class = u.actual_value)"""),
        ("uc", "SELECT * FROM uc0 WHERE indicator IN (SELECT indicator FROM uc0 GROUP BY indicator HAVING count(*) >= 2)"),
        ("u2", """SELECT indicator, actual_value AS class, country_code, crop_name, partner, subpartner, irrigation,
                         hired_workers, area, "planYear" FROM uc"""),
        ("corr", f"SELECT u2.indicator, u2.class, {feats} FROM u2"),
        *[(n.replace("m_", "c_", 1), s) for n, s in model_ctes("c_", "corr")[:3]],
    ]


FOLDED = _sql(_fold_ctes(), """
SELECT indicator, class, feature, value, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT indicator, class, feature, value, n FROM m_fv
  UNION ALL SELECT indicator, class, feature, value, n FROM c_fv
  UNION ALL SELECT indicator, class, '__class__', '', n_class FROM m_cls
  UNION ALL SELECT indicator, class, '__class__', '', n_class FROM c_cls) t
GROUP BY indicator, class, feature, value""", VIEWS + ["f_feedback"])


@query("apply_feedback", oracle=FOLDED)
def apply_feedback(ctx: Ctx):
    """M7: fold usable corrections into the count model — the updated counts are
    exactly the counts of the union of training rows and corrections (no encoder
    refit, H8).  Rows with feature '__class__' hold the class counts."""
    m = _m(ctx, meta=False)
    from fieldcast.operators.feedback import fold_corrections
    return fold_corrections(m.model, ctx.feedback, m.modelled, ctx.spark)


# ---------------------------------------------------------------- R (rows only)
@query("nb_cv_accuracy")
def nb_cv_accuracy(ctx: Ctx):
    """M4: K-fold cross-validated accuracy; all fold models counted in one pass."""
    return CM.cv_accuracy(_m(ctx, meta=False).split)


# ---------------------------------------------------------------- neighbours
def _knn_ctes() -> list[tuple[str, str]]:
    from fieldcast.operators.features import FEATURE_NAMES
    tr_cols = ", ".join(f'{v} AS "{k}"' for k, v in prepared_cols("t").items())
    dist = " + ".join(f'(CAST(q."{f}" AS DOUBLE) - CAST(t."{f}" AS DOUBLE)) * (CAST(q."{f}" AS DOUBLE) - CAST(t."{f}" AS DOUBLE))'
                      for f in FEATURE_NAMES)
    return ENC_CTES + [
        ("req", "SELECT p.row_id, " + ", ".join(f'{v} AS "{k}"' for k, v in prepared_cols("p").items()) + " FROM f_profiles p"),
        ("qenc", _encoded_select("req", "s.row_id")),
        ("trn", f"SELECT min(first_row_id) AS train_id, {PCOLS} FROM first_rows WHERE answer IS NOT NULL GROUP BY {PCOLS}"),
        ("trp", f"SELECT t.train_id, {tr_cols} FROM trn t"),
        ("tenc", _encoded_select("trp", "s.train_id")),
        ("nn", f"""SELECT query_id, unnest(top) AS nb, generate_subscripts(top, 1) AS rank FROM (
                     SELECT q.row_id AS query_id,
                            arg_min({{'d': sqrt({dist}), 'id': t.train_id}}, {{'d': sqrt({dist}), 'id': t.train_id}}, 5) AS top
                     FROM qenc q, tenc t GROUP BY q.row_id) x"""),
        ("nn2", "SELECT query_id, rank, nb.id AS neighbour_id, nb.d AS distance, max(nb.d) OVER (PARTITION BY query_id) AS dmax FROM nn"),
    ]


@query("similar_farms", oracle=_sql(_knn_ctes(), """
SELECT query_id AS row_id, CAST(rank AS BIGINT) AS rank, neighbour_id, CAST(distance AS DECIMAL(18,6)) AS distance,
       CAST(greatest(0.0, (1 - distance / (CASE WHEN dmax > 0 THEN dmax ELSE 1.0 END + 1e-9)) * 100) AS DECIMAL(18,6)) AS similarity_pct,
       {neighbour}
FROM nn2 JOIN trn ON trn.train_id = nn2.neighbour_id""".replace("{neighbour}", ", ".join(f'trn."{c}" AS "neighbour_{c}"' for c in PROFILE_COLS))))
def similar_farms(ctx: Ctx):
    """The 5 most similar training farms of every profile (exact
    Euclidean k-NN on encoded features; grid search, no all-pairs join), each
    with the neighbour's profile."""
    from fieldcast.operators import similar as SIM
    first = ctx.first_rows.filter(F.col("answer").isNotNull())
    # training profiles (one row per distinct profile, id = its first row) are
    # read by the encoder fit and by the encoding: write them once
    trn = materialize(first.groupBy(*PROFILE_COLS).agg(F.min("first_row_id").alias("train_id")), "train_profiles")
    tp = FE.prepare(trn, ctx.spark, ctx.synonyms)
    enc, modes = FE.fit_encoders(tp), FE.fit_modes(tp)
    enc = materialize(enc)
    train = FE.encode(tp, enc, modes, ["train_id"])
    queries = FE.encode(FE.prepare(ctx.profiles, ctx.spark, ctx.synonyms), enc, modes, ["row_id"])
    found = SIM.nearest(queries, train, "row_id", "train_id", k=C.DEFAULT_NEIGHBOURS)
    farms = trn.select(F.col("train_id").alias("neighbour_id"), *[F.col(c).alias(f"neighbour_{c}") for c in PROFILE_COLS])
    return found.join(farms.hint("merge"), "neighbour_id")  # as many rows as the data: not through the driver


# ---------------------------------------------------------------- trees, grid, state
def encoded_examples(ctx: Ctx, m: Model) -> DataFrame:
    """Training rows with the 11 encoded features (codes + raw numerics) and split slots."""
    first = m.first_rows.filter(F.col("answer").isNotNull()).join(m.modelled.select("indicator"), "indicator",
                                                                  "left_semi")
    tp = train_profiles(ctx, m.first_rows)
    enc, modes = materialize(FE.fit_encoders(tp)), FE.fit_modes(tp)
    prepared = FE.prepare(first, ctx.spark, ctx.synonyms)
    e = FE.encode(prepared, enc, modes, ["indicator", "answer", "first_row_id"])
    slots = m.split.select("indicator", "row_key", "is_test", "eval_on_train", "fold", "n_folds")
    return e.select(F.col("first_row_id").alias("row_key"), "indicator", F.col("answer").alias("class"),
                    *FE.FEATURE_NAMES).join(slots, ["indicator", "row_key"])


def tree_table(ctx: Ctx, m: Model) -> tuple[DataFrame, dict[str, int]]:
    """The feature table of all modelled indicators, and their numbers of classes."""
    from fieldcast.operators import trees as TR
    table = TR.feature_table(encoded_examples(ctx, m), m.model.classes, CM.class_weights(m.split))
    k = {r["indicator"]: r["n_classes"] for r in m.model.classes.select("indicator", "n_classes").distinct().collect()}
    return table, k


def encoded_profiles(ctx: Ctx) -> DataFrame:
    """(profile_id, features) of every profile, by the encoders of the training profiles."""
    from fieldcast.operators import trees as TR
    tp = train_profiles(ctx)
    enc, modes = FE.fit_encoders(tp), FE.fit_modes(tp)
    return TR.features(FE.encode(FE.prepare(ctx.profiles, ctx.spark, ctx.synonyms), enc, modes, ["row_id"]).withColumnRenamed("row_id", "profile_id"), "profile_id")


@query("trees_train")
def trees_train(ctx: Ctx):
    """Boosted trees of every modelled indicator with the reference
    parameters; holdout accuracy."""
    from fieldcast.operators import trees as TR
    table, k = tree_table(ctx, _m(ctx, meta=False))
    return TR.train_all(ctx.spark, table, k)[1]


#: The indicator that ``trees_predict`` answers.
TREES_ID = "BH-1"


@query("trees_predict")
def trees_predict(ctx: Ctx):
    """M6 on M3b: class, confidence and policy of one indicator by its boosted trees, for every profile."""
    from fieldcast.operators import trees as TR
    m = _m(ctx, [TREES_ID])
    table, k = tree_table(ctx, m)
    models, _ = TR.train_all(ctx.spark, table, k)
    raw = TR.predict(encoded_profiles(ctx), models, m.model.classes)
    p = P.add_policy(P.shape_values(raw, ctx.meta))
    return p.select("profile_id", "indicator", "value", "suggestedOptions", F.col("confidence").cast(DEC).alias("confidence"), "policy", "ui_status")


@query("grid_search")
def grid_search(ctx: Ctx):
    """M5 for the count model: cross-validated accuracy over a smoothing grid;
    all fold models are counted once and only re-scored per alpha."""
    alphas = [0.25, 0.5, 1.0, 2.0]
    r = CM.cv_accuracy(_m(ctx, meta=False).split, alphas=alphas)
    from pyspark.sql import Window
    w = Window.partitionBy("indicator").orderBy(F.col("cv_accuracy").desc(), F.col("alpha").desc())
    return r.withColumn("best", F.row_number().over(w) == 1)


def publish_model(ctx: Ctx, m: Model, root: str, version: str, registry_dir: str | None = None, trees: dict | None = None) -> bool:
    """Publish the context's model with its encoders, modes and metadata."""
    from fieldcast.sources import store
    m.ex  # read by the model and the evaluation
    tp = train_profiles(ctx, m.first_rows)
    tables = {"classes": m.model.classes, "fv": m.model.fv, "vocab": m.model.vocab, "meta": ctx.meta,
              "encoders": FE.fit_encoders(tp), "modes": FE.fit_modes(tp)}
    accuracy = m.evaluation[1].agg(F.avg("accuracy")).first()[0] or 0.0
    return store.publish(ctx.spark, root, version, tables, trees, registry_dir, accuracy)


PUBLISHED_BODY = """
SELECT p.profile_id, p.indicator, CASE WHEN mt.type = 'checkbox' THEN NULL ELSE p.predicted_class END AS value,
       CASE WHEN mt.type = 'checkbox' THEN [p.predicted_class] END AS "suggestedOptions",
       CAST(p.confidence AS DECIMAL(18,6)) AS confidence,
       CASE WHEN p.confidence >= 70 THEN 'auto_fill' WHEN p.confidence >= 40 THEN 'suggest' ELSE 'suggest_low' END AS policy,
       CASE WHEN p.confidence >= 70 THEN 'green' WHEN p.confidence >= 40 THEN 'amber' ELSE 'red' END AS ui_status
FROM r_pred p LEFT JOIN meta mt ON mt.indicator = p.indicator"""


@query("predict_published", oracle=_sql(request_ctes(), PUBLISHED_BODY))
def predict_published(ctx: Ctx):
    """Publish the model as a version, register and pin it, and predict from its files alone."""
    import uuid

    from fieldcast.sources import store
    m = _m(ctx)
    root = f"{store.models_root(ctx.spark)}-{uuid.uuid4().hex[:8]}"
    version = store.version_label()
    publish_model(ctx, m, root, version, f"{root}/_registry")
    store.pin(ctx.spark, root, version)
    out = store.Predictor(ctx.spark, root).predict(ctx.profiles)
    return out.withColumnRenamed("row_id", "profile_id").withColumn("confidence", F.col("confidence").cast(DEC))


@query("params_roundtrip", oracle=_sql(model_ctes("m_", "ex"), "SELECT * FROM m_fv"))
def params_roundtrip(ctx: Ctx):
    """Save the model state as a version, load it back, return the loaded counts."""
    from fieldcast.sources import store
    m = _m(ctx)
    version = store.version_label()
    root = f"{store.models_root(ctx.spark)}-{__import__('uuid').uuid4().hex[:8]}"
    store.save_state(ctx.spark, {"classes": m.model.classes, "fv": m.model.fv, "vocab": m.model.vocab,
                                 "meta": ctx.meta}, version, root)
    loaded = store.load_state(ctx.spark, version, ("classes", "fv", "vocab", "meta"), root)
    return loaded["fv"]
