"""Count model: smoothed naive Bayes for every indicator at once (M3a, M4, M6,
M7, M8, W4, W5, A17-A19).

Training is one aggregation: answers are stacked into (indicator, class,
feature, value) and counted; no loop over indicators.  With Laplace
smoothing (alpha = 1) the log-score of class c for a profile x is

    score(c) = base(c) + sum_f ln(1 + n(c, f, x_f))
    base(c)  = ln(n_c / N) - sum_f ln(n_c + V_f)

where n(c, f, v) counts training rows of class c whose feature f is v,
n_c counts rows of class c, N all rows, and V_f is the number of distinct
values of f seen for the indicator plus one (the unseen slot).  An unseen
value adds nothing, so the model is two small tables: ``base`` per class and
``delta = ln(1 + n)`` per seen (class, feature, value).

For scoring, both are laid out as dense per-class vectors: one vector per
indicator (base) and one per (indicator, feature, value).  Scoring a profile
for an indicator is then 11 dictionary look-ups (broadcast hash joins when
the model is proven small) and an element-wise vector sum — a narrow map
over profile rows, no shuffle.  That is for indicators of few classes; one
whose answers grow with the data is scored block by block
(:mod:`fieldcast.operators.widescore`), with the same result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldcast import constants as C
from fieldcast.functions import scalar as X
from fieldcast.operators import widescore
from fieldcast.operators.util import BROADCAST_MAX_ROWS, broadcast_if_small, materialize, rank_within, spread, tasks_for

NB_FEATURES = C.FEATURE_COLUMNS + [name for name, _, _ in C.INTERACTIONS]
DEC = "decimal(18,6)"
# Dense model cells (doubles) above which the dictionaries are joined by shuffle.
DENSE_BROADCAST_MAX_CELLS = 20_000_000


def trainable(first: DataFrame, min_samples: int = C.MIN_TRAINING_SAMPLES) -> DataFrame:
    """(indicator, n_samples, n_classes) for indicators worth a model:
    not all null, more than one class, at least ``min_samples`` answers."""
    return (first.groupBy("indicator")
                 .agg(F.count("answer").alias("n_samples"),
                      F.countDistinct("answer").alias("n_classes"))
                 .filter((F.col("n_samples") >= min_samples) & (F.col("n_classes") > 1)))


def bucket_features(prepared: DataFrame) -> DataFrame:
    """The 11 model features as text: 8 categories as prepared, numerics bucketed
    (workers and year by integer part, area by floor(log2(1 + area)))."""
    def ip(c: Column) -> Column:
        return F.floor(c).cast("bigint").cast("string")
    return prepared.withColumns({
        "hired_workers": ip(F.col("hired_workers")),
        "area": ip(F.log2(1 + F.greatest(F.col("area"), F.lit(0.0)))),
        "planYear": ip(F.col("planYear")),
    })


def examples(first_rows: DataFrame, modelled: DataFrame, spark, synonyms: DataFrame | None = None) -> DataFrame:
    """Training rows: (indicator, class, row_key, <11 features>) for every answered
    (profile, indicator) of a modelled indicator.  ``row_key`` is the row id of
    the first answer, unique per profile within an indicator."""
    from fieldcast.operators.features import prepare
    ex = first_rows.filter(F.col("answer").isNotNull()).join(modelled.select("indicator"), "indicator", "left_semi")
    ex = bucket_features(prepare(ex, spark, synonyms))
    return ex.select("indicator", F.col("answer").alias("class"), F.col("first_row_id").alias("row_key"), *NB_FEATURES)


def split(ex: DataFrame) -> DataFrame:
    """Deterministic stratified holdout and K folds.

    Within each (indicator, class) rows are ranked by ``row_key``; rank 1, 6,
    11, ... (one in five) go to the test slot.  The split applies only when the
    indicator has >= 50 rows; it is stratified only with <= 20 classes that all
    have >= 2 rows, else ranked over the whole indicator.  If a class is then
    missing from training, the indicator is evaluated on its training rows
    (``eval_on_train``).  ``fold`` = (rank - 1) % k with
    k = max(2, min(5, smallest class count))."""
    # only the keys go through the ranks; a written row keeps its number, by which
    # the features come back in one join.  Exact ranks; a hot indicator or class is spread
    # over ordered range partitions instead of one window task (see util.rank_within)
    rows = ex if "_row" in ex.columns else materialize(ex.withColumn("_row", F.monotonically_increasing_id()), "split_rows")
    slots = _slots(rows.select("indicator", "class", "row_key", "_row"))
    slots = slots.drop("indicator", "class", "row_key")
    # the sides of the join sort whole rows: they are dealt to as many tasks as the rows ask for
    tasks = tasks_for(rows.sparkSession, rows.count())
    if tasks:
        rows, slots = rows.repartition(tasks, "_row"), slots.repartition(tasks, "_row")
    return rows.join(slots.hint("merge"), "_row").drop("_row")


def split_keys(ex: DataFrame) -> DataFrame:
    """The slots and folds of :func:`split` without the features: (indicator, class,
    row_key, is_test, n_folds, fold, eval_on_train)."""
    return _slots(ex.select("indicator", "class", "row_key"))


def _slots(keys: DataFrame) -> DataFrame:
    """Rows (indicator, class, row_key, ...) with their slot and fold."""
    keys = materialize(rank_within(keys, ["indicator", "class"], "row_key", "_rank_c", deal=True), "split_ranks")
    n_c = materialize(keys.groupBy("indicator", "class").agg(F.count(F.lit(1)).alias("_n_c")), "split_classes")
    stats = materialize(n_c.groupBy("indicator").agg(F.count(F.lit(1)).alias("_k"), F.min("_n_c").alias("_min_c"),
                                                     F.sum("_n_c").alias("_n")), "split_stats")
    stratify = (F.col("_k") <= C.STRATIFY_MAX_CLASSES) & (F.col("_min_c") >= 2)
    # a row per question: the row's own indicator is ranked only where that rank is used
    strata = stats.filter(stratify).select("indicator")
    within = keys.join(F.broadcast(strata), "indicator", "left_semi").withColumn("_rank", F.col("_rank_c"))
    whole = rank_within(keys.join(F.broadcast(strata), "indicator", "left_anti"), ["indicator"], "row_key", "_rank", deal=True)
    k = F.greatest(F.lit(2), F.least(F.lit(5), F.col("_min_c")))
    in_test = (F.col("_n") >= C.SPLIT_MIN_ROWS) & (((F.col("_rank") - 1) % C.TEST_FRACTION_FOLDS) == 0)
    slots = within.unionByName(whole.select(*within.columns)).join(F.broadcast(stats), "indicator") \
        .withColumn("is_test", in_test).withColumn("n_folds", k.cast("int")) \
        .withColumn("fold", ((F.col("_rank_c") - 1) % k).cast("int")).drop("_rank", "_rank_c", "_n_c", "_min_c")
    slots = materialize(slots, "split_slots")
    train_classes = slots.filter(~F.col("is_test")).select("indicator", "class").distinct() \
                         .groupBy("indicator").agg(F.count("class").alias("_kt"))
    train_classes = materialize(train_classes, "split_trained")
    slots = slots.join(F.broadcast(train_classes), "indicator", "left")
    split_ok = (F.col("_n") >= C.SPLIT_MIN_ROWS) & (F.coalesce(F.col("_kt"), F.lit(0)) == F.col("_k"))
    return slots.withColumn("eval_on_train", ~split_ok).withColumn("is_test", F.col("is_test") & split_ok) \
                .drop("_n", "_k", "_kt")


def stack(ex: DataFrame, keep: list[str]) -> DataFrame:
    """(keep..., feature, value) — one row per model feature."""
    arr = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in NB_FEATURES])
    return ex.select(*keep, F.inline(arr))


@dataclass
class CountModel:
    classes: DataFrame     # (indicator, class, n_class, idx, n_classes, n_rows)
    fv: DataFrame          # (indicator, class, feature, value, n)
    vocab: DataFrame       # (indicator, feature, V)
    alpha: float = 1.0     # Laplace smoothing

    def materialized(self) -> "CountModel":
        """The value counts written once to the checkpoint folder (model-sized);
        class counts and vocabulary are then cheap aggregates over written tables."""
        fv = materialize(self.fv, "nb_fv")
        # every row has each feature once, so one feature's counts sum to n_class
        cc = fv.filter(F.col("feature") == NB_FEATURES[0]).groupBy("indicator", "class") \
               .agg(F.sum("n").alias("n_class"))
        return from_counts(cc, fv, self.alpha)

    def with_alpha(self, alpha: float) -> "CountModel":
        """Same counts, another smoothing (the counts do not depend on it)."""
        return CountModel(self.classes, self.fv, self.vocab, alpha)

    def only(self, indicators: list[str], other: bool = False) -> "CountModel":
        """The models of these indicators, or of all others."""
        def part(t: DataFrame) -> DataFrame:
            named = F.col("indicator").isin(indicators)
            return t.filter(~named if other else named)
        return CountModel(part(self.classes), part(self.fv), part(self.vocab), self.alpha)


def fit(ex: DataFrame) -> CountModel:
    """All indicators in one pass.  The (indicator, class, feature, value)
    counts aggregate map-side, so a hot indicator or value never gathers its
    rows in one task."""
    fv = stack(ex, ["indicator", "class"]).groupBy("indicator", "class", "feature", "value") \
        .agg(F.count(F.lit(1)).alias("n"))
    return from_counts(ex.groupBy("indicator", "class").agg(F.count(F.lit(1)).alias("n_class")), fv)


def from_counts(class_counts: DataFrame, fv: DataFrame, alpha: float = 1.0) -> CountModel:
    """Model tables from class counts (indicator, class, n_class) and value counts."""
    w = Window.partitionBy("indicator")
    classes = (class_counts
               .withColumn("idx", (F.row_number().over(w.orderBy("class")) - 1).cast("int"))
               .withColumn("n_classes", F.count(F.lit(1)).over(w))
               .withColumn("n_rows", F.sum("n_class").over(w)))
    vocab = (fv.select("indicator", "feature", "value").distinct()
               .groupBy("indicator", "feature").agg((F.count(F.lit(1)) + 1).alias("V")))
    return CountModel(classes, fv, vocab, alpha)


def log_probs(m: CountModel) -> DataFrame:
    """nb_model: (indicator, class, feature, value, logp) with the smoothed
    ln P(value | class); feature '__prior__' rows hold ln P(class).  The counts stay
    where they are: a row per class is broadcast if these are few, and a row per
    question and feature."""
    classes = materialize(m.classes, "nb_classes")
    cond = (m.fv.join(broadcast_if_small(classes.select("indicator", "class", "n_class")), ["indicator", "class"])
                .join(F.broadcast(m.vocab), ["indicator", "feature"])
                .select("indicator", "class", "feature", "value",
                        F.log((F.col("n") + 1) / (F.col("n_class") + F.col("V"))).alias("logp")))
    prior = classes.select("indicator", "class", F.lit("__prior__").alias("feature"), F.lit("").alias("value"),
                             F.log(F.col("n_class") / F.col("n_rows")).alias("logp"))
    return cond.unionByName(prior).withColumn("logp", F.col("logp").cast(DEC))


def base_scores(m: CountModel) -> DataFrame:
    """(indicator, class, idx, base) with base = ln(n_c/N) - sum_f ln(n_c + a V_f)
    + F ln a (a = alpha; the last term vanishes for a = 1).  A feature with no
    vocabulary row (never seen) has V = 1."""
    feats = F.array(*[F.lit(f) for f in NB_FEATURES])
    cf = m.classes.select("indicator", "class", "idx", "n_class", "n_rows", F.explode(feats).alias("feature"))
    cf = cf.join(m.vocab, ["indicator", "feature"], "left").withColumn("V", F.coalesce("V", F.lit(1)))
    a = float(m.alpha)
    smooth = F.col("n_class") + F.col("V") if a == 1.0 else F.col("n_class") + F.lit(a) * F.col("V")
    base = F.log(F.first("n_class") / F.first("n_rows")) - F.sum(F.log(smooth))
    if a != 1.0:
        import math
        base = base + F.lit(len(NB_FEATURES) * math.log(a))
    return cf.groupBy("indicator", "class", "idx").agg(base.alias("base"))


def dense(m: CountModel) -> tuple[DataFrame, DataFrame]:
    """Dense per-class vectors, classes in code-point order:
    heads (indicator, classes, base_vec) and deltas (indicator, feature, value, vec).
    The delta grid is (seen values x classes) per indicator: the size of the
    model, not of the data."""
    base = base_scores(m)
    heads = (base.groupBy("indicator")
                 .agg(F.array_sort(F.collect_list(F.struct("idx", "class", "base"))).alias("_s"))
                 .select("indicator", F.transform("_s", lambda s: s["class"]).alias("classes"),
                         F.transform("_s", lambda s: s["base"]).alias("base_vec")))
    values = m.fv.select("indicator", "feature", "value").distinct()
    grid = values.join(m.classes.select("indicator", "class", "idx"), "indicator")
    n = F.coalesce(F.col("n"), F.lit(0)).cast("double")
    d = F.log1p(n) if float(m.alpha) == 1.0 else F.log1p(n / F.lit(float(m.alpha)))
    cell = grid.join(m.fv, ["indicator", "class", "feature", "value"], "left").withColumn("d", d)
    deltas = (cell.groupBy("indicator", "feature", "value")
                  .agg(F.array_sort(F.collect_list(F.struct("idx", "d"))).alias("_s"))
                  .select("indicator", "feature", "value", F.transform("_s", lambda s: s["d"]).alias("vec")))
    return heads, deltas


def score(rows: DataFrame, m: CountModel, key: str, extra_year: str | None = None) -> DataFrame:
    """Score every (key, indicator) row against its indicator's model.

    ``rows`` holds (key, indicator, <11 features>).  Returns (key, indicator,
    classes, scores) plus, if ``extra_year`` names a column, ``scores_alt``:
    the scores with planYear replaced by that column (one extra look-up)."""
    heads, deltas = dense(m)
    heads, deltas = materialize(heads, "nb_heads"), materialize(deltas, "nb_deltas")
    size = deltas.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("vec")).alias("cells")).first()
    small = (size["n"] or 0) <= BROADCAST_MAX_ROWS and (size["cells"] or 0) <= DENSE_BROADCAST_MAX_CELLS

    def dict_for(feature: str, alias: str) -> DataFrame:
        d = deltas.filter(F.col("feature") == feature).select(
            F.col("indicator").alias(f"_i_{alias}"), F.col("value").alias(f"_v_{alias}"), F.col("vec").alias(alias))
        return F.broadcast(d) if small else d

    out = rows.join(F.broadcast(heads) if small else heads, "indicator")
    looks = [(f, f"_d{j}") for j, f in enumerate(NB_FEATURES)]
    if extra_year:
        looks.append((extra_year, "_dalt"))
    for col, alias in looks:
        feat = "planYear" if col == extra_year else col
        d = dict_for(feat, alias)
        out = out.join(d, (out["indicator"] == d[f"_i_{alias}"]) & (out[col] == d[f"_v_{alias}"]), "left") \
                 .drop(f"_i_{alias}", f"_v_{alias}")
    zeros = F.transform("base_vec", lambda _: F.lit(0.0))
    vecs = F.array(*[F.coalesce(F.col(a), zeros) for _, a in looks[:len(NB_FEATURES)]])
    total = F.aggregate(vecs, F.col("base_vec"), lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b))
    out = out.withColumn("scores", total)
    if extra_year:
        year_idx = NB_FEATURES.index("planYear")
        cur = F.coalesce(F.col(f"_d{year_idx}"), zeros)
        alt = F.coalesce(F.col("_dalt"), zeros)
        out = out.withColumn("scores_alt", F.zip_with(F.zip_with("scores", cur, lambda a, b: a - b), alt,
                                                      lambda a, b: a + b))
    return out.drop("base_vec", *[a for _, a in looks])


def decide(scores: Column, classes: Column) -> tuple[Column, Column]:
    """Argmax class (scores snapped to 9 decimals, ties -> first class in
    code-point order) and confidence = 100 x softmax maximum."""
    snapped = F.transform(scores, lambda s: F.round(s, 9))
    best = F.array_position(snapped, F.array_max(snapped))
    cls = F.element_at(classes, best.cast("int"))
    top = F.array_max(scores)
    denom = F.aggregate(scores, F.lit(0.0), lambda acc, s: acc + F.exp(s - top))
    return cls, (F.lit(100.0) / denom)


def _decide_dense(rows: DataFrame, m: CountModel, key: str, carry: tuple, extra_year: str | None) -> DataFrame:
    s = score(rows, m, key, extra_year)
    cls, conf = decide(F.col("scores"), F.col("classes"))
    out = [key, "indicator", *carry, cls.alias("predicted_class"), conf.alias("confidence")]
    if extra_year:
        cls, conf = decide(F.col("scores_alt"), F.col("classes"))
        out += [cls.alias("previous_class"), conf.alias("previous_confidence")]
    return s.select(*out)


def predict(rows: DataFrame, m: CountModel, key: str, carry: tuple = (), extra_year: str | None = None,
            dense_classes: int = C.MAX_CLASSES) -> DataFrame:
    """(key, indicator, <carry>, predicted_class, confidence); columns of ``rows``
    named in ``carry`` come along, so nothing has to be joined back.  If
    ``extra_year`` names a column, also previous_class and previous_confidence:
    the decision with planYear replaced by it.

    Indicators with at most ``dense_classes`` classes are scored by dense
    vectors, the others in blocks of distinct inputs and of classes: two plans,
    one result."""
    wide = [r[0] for r in m.classes.filter(F.col("n_classes") > dense_classes).select("indicator").distinct().collect()]
    if not wide:
        return _decide_dense(rows, m, key, carry, extra_year)
    few = _decide_dense(rows.filter(~F.col("indicator").isin(wide)), m.only(wide, other=True), key, carry, extra_year)
    many = m.only(wide)
    return few.unionByName(widescore.decide(rows.filter(F.col("indicator").isin(wide)), many, base_scores(many), key, carry, extra_year))


def predict_profiles(profiles: DataFrame, indicators: list[str], m: CountModel, key: str, extra_year: str | None = None,
                     fold: list[Column] | None = None) -> DataFrame:
    """:func:`predict` of every profile (key, <11 features>[, extra_year]) for each of ``indicators``.

    Only the distinct inputs are scored.  Their answers to all indicators go
    back to the profiles as one list, so a profile is shuffled once, before it
    becomes a row per indicator.  The join is a sort-merge join by hint: both
    sides may grow with the data, and are small on disk.  With ``fold``, aggregates
    over an input's answers, these go back instead: a row (key, <fold>) per profile."""
    inputs = [*NB_FEATURES, *([extra_year] if extra_year else [])]
    rows = profiles.select(key, *inputs)
    asked = materialize(rows.select(*inputs).distinct().withColumn("_input", F.monotonically_increasing_id()), "nb_asked")
    # the written inputs are few files; the scores of an input are many
    each = spread(asked).withColumn("indicator", F.explode(F.array(*[F.lit(i) for i in indicators]).cast("array<string>")))
    found = predict(each, m, "_input", (), extra_year)
    out = [c for c in found.columns if c != "_input"]
    lists = found.groupBy("_input").agg(*(fold or [F.collect_list(F.struct(*out)).alias("_all")]))
    told = asked.join(lists.hint("merge"), "_input").drop("_input").withColumnsRenamed({f: f"_{f}" for f in inputs})
    same = reduce(lambda a, b: a & b, [F.col(f).eqNullSafe(F.col(f"_{f}")) for f in inputs])
    told_of = [c for c in lists.columns if c != "_input"]
    back = rows.join(told.hint("merge"), same)
    return back.select(key, *told_of) if fold else back.select(key, F.inline("_all"))


def holdout(ex_split: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M4: holdout predictions (indicator, row_key, actual, predicted), and the classes of their model.

    The training-slot model is counted from the training rows only (the count
    model needs no refit: it is just the counts of another row set)."""
    train = ex_split.filter(~F.col("is_test") | F.col("eval_on_train"))
    test = ex_split.filter(F.col("is_test") | F.col("eval_on_train"))
    m = fit(train).materialized()
    asked = test.select("row_key", "indicator", F.col("class").alias("actual"), *NB_FEATURES)
    preds = predict(asked, m, "row_key", ("actual",)) \
        .select("indicator", "row_key", "actual", F.col("predicted_class").alias("predicted"))
    return preds, m.classes


def evaluate(ex_split: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Confusion counts of the holdout predictions, and per-indicator metrics.
    The counts are written: the metrics read them three times and a report once more,
    and no row must be scored again for each."""
    preds, classes = holdout(ex_split)
    cm = materialize(confusion(preds), "confusion")
    return cm, metrics(cm, classes)


def confusion(preds: DataFrame) -> DataFrame:
    """(indicator, actual, predicted, n)."""
    return preds.groupBy("indicator", "actual", "predicted").agg(F.count(F.lit(1)).alias("n"))


def metrics(cm: DataFrame, classes: DataFrame) -> DataFrame:
    """A18, from the confusion counts: accuracy; precision / recall / F1 on the second class for two-class
    indicators, support-weighted over classes otherwise (zero division -> 0)."""
    tp = cm.filter(F.col("actual") == F.col("predicted")).groupBy("indicator", F.col("actual").alias("class")) \
           .agg(F.sum("n").alias("tp"))
    sup = cm.groupBy("indicator", F.col("actual").alias("class")).agg(F.sum("n").alias("support"))
    prd = cm.groupBy("indicator", F.col("predicted").alias("class")).agg(F.sum("n").alias("npred"))
    per = (sup.join(prd, ["indicator", "class"], "full").join(tp, ["indicator", "class"], "left")
              .fillna(0, ["tp", "support", "npred"]))
    prec = F.when(F.col("npred") > 0, F.col("tp") / F.col("npred")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0)
    per = per.select("indicator", "class", "tp", "support", prec.alias("p"), rec.alias("r"), f1.alias("f"))
    k = classes.select("indicator", "class", "idx", "n_classes")
    per = per.join(k, ["indicator", "class"], "left")
    binary = F.first("n_classes", ignorenulls=True) == 2
    wsum = F.sum("support")
    pos = lambda c: F.max(F.when(F.col("idx") == 1, F.col(c)))
    wavg = lambda c: F.sum(F.col(c) * F.col("support")) / wsum
    agg = per.groupBy("indicator").agg(
        (F.sum("tp") / wsum).alias("accuracy"),
        F.when(binary, F.coalesce(pos("p"), F.lit(0.0))).otherwise(wavg("p")).alias("precision"),
        F.when(binary, F.coalesce(pos("r"), F.lit(0.0))).otherwise(wavg("r")).alias("recall"),
        F.when(binary, F.coalesce(pos("f"), F.lit(0.0))).otherwise(wavg("f")).alias("f1_score"),
        wsum.alias("test_samples"))
    return agg


def class_weights(ex_split: DataFrame) -> DataFrame:
    """Balanced weights n / (k * n_c) on the training rows; for two-class
    indicators the positive (second) class gets neg / pos and the other 1."""
    train = ex_split.filter(~F.col("is_test") | F.col("eval_on_train"))
    c = train.groupBy("indicator", "class").agg(F.count(F.lit(1)).alias("n_class"))
    w = Window.partitionBy("indicator")
    c = (c.withColumn("n", F.sum("n_class").over(w)).withColumn("k", F.count(F.lit(1)).over(w))
          .withColumn("idx", F.row_number().over(w.orderBy("class")) - 1)
          .withColumn("n0", F.max(F.when(F.col("idx") == 0, F.col("n_class"))).over(w)))
    weight = F.when(F.col("k") == 2, F.when(F.col("idx") == 1, F.col("n0") / F.col("n_class")).otherwise(1.0)) \
              .otherwise(F.col("n") / (F.col("k") * F.col("n_class")))
    return c.select("indicator", "class", "n_class", weight.cast(DEC).alias("weight"))


def fold_models(ex: DataFrame) -> CountModel:
    """M4: the model of every fold of every indicator, named '<indicator>#<fold>'.

    Each training row is counted once, in its own fold.  The model of fold j is
    the total counts less the counts of fold j, so no row is copied."""
    keys = ["indicator", "class", "feature", "value"]
    most = C.CV_MAX_FOLDS
    # one row per count with all folds' shares beside each other
    shares = [F.count_if(F.col("fold") == j).alias(f"_f{j}") for j in range(most)]
    counts = stack(ex, ["indicator", "class", "fold", "n_folds"]).groupBy(*keys).agg(F.first("n_folds").alias("n_folds"), *shares)
    less = F.transform(F.sequence(F.lit(0), F.col("n_folds") - 1), lambda j: F.struct(
        j.alias("j"), (F.col("_all") - F.get(F.col("_each"), j)).alias("n")))
    each = counts.withColumn("_each", F.array(*[f"_f{j}" for j in range(most)])) \
                 .withColumn("_all", reduce(lambda a, b: a + b, [F.col(f"_f{j}") for j in range(most)]))
    fv = each.select(*keys, F.inline(less)).filter(F.col("n") > 0) \
             .withColumn("indicator", F.concat_ws("#", "indicator", F.col("j").cast("string"))).drop("j")
    return CountModel(None, fv, None).materialized()


def cv_accuracy(ex_split: DataFrame, min_rows: int = C.CV_MIN_ROWS, alphas: list[float] | None = None) -> DataFrame:
    """K-fold accuracy for indicators with >= ``min_rows`` rows: each row
    is scored by the model of its own fold (:func:`fold_models`), in one pass for
    all of ``alphas``.  Indicators of few classes go by blocks too: every fold has
    its own model, and rows times classes as lists cost more than the blocks."""
    n = ex_split.groupBy("indicator").agg(F.count(F.lit(1)).alias("_n"), F.countDistinct("class").alias("_k"))
    ex = ex_split.join(n.filter((F.col("_n") >= min_rows) & (F.col("_k") >= 2)).select("indicator"), "indicator",
                       "left_semi")
    test = ex.withColumn("_orig", F.col("indicator")) \
             .withColumn("indicator", F.concat_ws("#", "indicator", F.col("fold").cast("string")))
    m = fold_models(ex)
    t = materialize(test.select("row_key", "indicator", "_orig", "fold", "n_folds", F.col("class").alias("actual"),
                                *NB_FEATURES))
    each = [float(a) for a in alphas or [1.0]]
    of = [base_scores(m.with_alpha(a)).withColumnRenamed("base", f"_b{i}") for i, a in enumerate(each)]
    bases = reduce(lambda x, y: x.join(y, ["indicator", "class", "idx"]), of)
    bases = bases.select("indicator", "class", "idx", F.array(*[f"_b{i}" for i in range(len(each))]).alias("base"))
    j = widescore.decide_each(t, m, bases, each, "row_key", ("_orig", "fold", "n_folds", "actual"))
    per_fold = j.groupBy("alpha", "_orig", "fold", "n_folds").agg(
        F.avg((F.col("predicted_class") == F.col("actual")).cast("double")).alias("acc"))
    out = per_fold.groupBy(F.col("_orig").alias("indicator"), "alpha").agg(
        F.first("n_folds").alias("n_folds"), F.avg("acc").cast(DEC).alias("cv_accuracy"))
    return out.select("indicator", "n_folds", "cv_accuracy", *(["alpha"] if alphas else []))
