"""Additive explanations of count-model predictions.

The predicted class's log-score is a sum of per-feature terms
g_f(v) = ln P(v | class), so the exact interventional Shapley value of
feature f is  phi_f = g_f(x_f) - E_v[g_f(v)],  the expectation taken over
the indicator's training rows.  Everything is joins and group-bys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldcast import constants as C
from fieldcast.functions import scalar as X
from fieldcast.operators import countmodel as CM
from fieldcast.operators.util import materialize, spread

NAMES = {f: (f"{f}_encoded" if f not in C.NUMERIC_COLUMNS else f) for f in CM.NB_FEATURES}


def expected_terms(m: CM.CountModel) -> DataFrame:
    """(indicator, class, feature, e): E over training rows of ln P(v | class).

    A value that the class never has gives ln 1 - ln(n_c + V), one that it has
    ln(1 + n) - ln(n_c + V): so e is a sum over the seen counts alone and one
    closed term, and no grid of values and classes is made."""
    mv = m.fv.filter(F.col("value").isNotNull()).groupBy("indicator", "feature", "value").agg(F.sum("n").alias("m"))
    told = mv.groupBy("indicator", "feature").agg(F.sum("m").alias("told")).join(m.vocab, ["indicator", "feature"])
    seen = m.fv.join(mv, ["indicator", "feature", "value"]) \
               .groupBy("indicator", "class", "feature").agg(F.sum(F.col("m") * F.log1p(F.col("n"))).alias("s"))
    cell = m.classes.select("indicator", "class", "n_class", "n_rows").join(told, "indicator") \
                    .join(seen, ["indicator", "class", "feature"], "left")
    e = (F.coalesce("s", F.lit(0.0)) - F.col("told") * F.log(F.col("n_class") + F.col("V"))) / F.col("n_rows")
    return cell.select("indicator", "class", "feature", e.alias("e"))


def input_values() -> F.Column:
    """The input as the caller gave it: base features as text ('None' for missing), '' for interaction terms."""
    return F.array(*[F.coalesce(F.col(f).cast("string"), F.lit("None")) if f in C.FEATURE_COLUMNS else F.lit("") for f in CM.NB_FEATURES])


def _position(feature) -> F.Column:
    return F.element_at(F.create_map(*[x for i, f in enumerate(CM.NB_FEATURES) for x in (F.lit(f), F.lit(i))]), feature)


def _named(**fields: F.Column) -> F.Column:
    """A struct; inside a function over a list, an alias does not name its field."""
    return F.named_struct(*[x for name, value in fields.items() for x in (F.lit(name), value)])


def _impacts(inputs: DataFrame, m: CM.CountModel) -> DataFrame:
    """(_input, _all): the features' impacts on the class of each input (_input, indicator, predicted_class, <11 features>)."""
    st = CM.stack(inputs, ["_input", "indicator", "predicted_class"])
    fv = m.fv.select("indicator", F.col("class").alias("predicted_class"), "feature", "value", "n")
    cls = m.classes.select("indicator", F.col("class").alias("predicted_class"), "n_class")
    e = expected_terms(m).withColumnRenamed("class", "predicted_class")
    j = (st.join(fv, ["indicator", "predicted_class", "feature", "value"], "left")
           .join(cls, ["indicator", "predicted_class"])
           .join(m.vocab, ["indicator", "feature"])
           .join(e, ["indicator", "predicted_class", "feature"]))
    impact = F.log((F.coalesce(F.col("n"), F.lit(0)) + 1) / (F.col("n_class") + F.col("V"))) - F.col("e")
    return j.groupBy("_input").agg(F.collect_list(F.struct("feature", impact.alias("impact"))).alias("_all"))


def contributions(req: DataFrame, m: CM.CountModel, raw: DataFrame, key: str) -> DataFrame:
    """(key, indicator, predicted_class, raw_feature, feature, impact, input_value, pos)."""
    pred = CM.predict(req, m, key)
    asked = req.select(key, "indicator", *CM.NB_FEATURES).join(pred.select(key, "indicator", "predicted_class").hint("merge"), [key, "indicator"])
    asked = materialize(asked, "explained")
    # equal inputs have equal impacts: each distinct one is explained once, and its impacts go back as one list
    same = ["indicator", "predicted_class", *CM.NB_FEATURES]
    inputs = materialize(asked.select(*same).distinct().withColumn("_input", F.monotonically_increasing_id()), "explain_inputs")
    told = inputs.join(_impacts(inputs, m).hint("merge"), "_input").drop("_input").withColumnsRenamed({c: f"_{c}" for c in same})
    asked = asked.join(raw.select(key, input_values().alias("_iv")).hint("merge"), key)
    equal = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in same])
    j = asked.join(told.hint("merge"), equal).select(key, "indicator", "predicted_class", "_iv", F.inline("_all"))
    name = F.element_at(F.create_map(*[x for f in CM.NB_FEATURES for x in (F.lit(f), F.lit(NAMES[f]))]), F.col("feature"))
    pos = _position(F.col("feature"))
    return j.select(key, "indicator", "predicted_class", name.alias("raw_feature"),
                    X.readable_feature(name).alias("feature"), "impact", F.get("_iv", pos).alias("input_value"), pos.alias("pos"))


def leading(asked: DataFrame, m: CM.CountModel, key: str, k: int = C.REASON_DRIVERS) -> DataFrame:
    """(key, indicator, predicted_class, drivers): the first ``k`` of :func:`top_drivers` of each request as one list
    of (rank, feature, input_value), for requests (key, indicator, <11 features>, _iv) whose interactions follow from
    their base features.

    The class and the drivers are those of the distinct inputs.  A request is shuffled once to meet them, and
    once more by its key, without its features: requests of one key rank their drivers together."""
    inputs = materialize(asked.select("indicator", *CM.NB_FEATURES).distinct().withColumn("_input", F.monotonically_increasing_id()), "explain_asked")
    inputs = materialize(CM.predict(spread(inputs), m, "_input", tuple(CM.NB_FEATURES)).drop("confidence"), "explain_inputs")
    size = lambda d: F.abs(d["impact"].cast("decimal(18,4)"))
    ranked = F.array_sort(F.transform(F.filter("_all", lambda d: size(d) > C.MIN_IMPACT),
                                      lambda d: _named(less=-size(d), pos=_position(d["feature"]))))
    same = ["indicator", *C.FEATURE_COLUMNS]
    told = inputs.join(_impacts(inputs, m).hint("merge"), "_input") \
                 .select("predicted_class", F.slice(ranked, 1, k).alias("_top"), *[F.col(c).alias(f"_{c}") for c in same])
    equal = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in same])
    valued = F.transform("_top", lambda d: _named(less=d["less"], pos=d["pos"], input_value=F.get("_iv", d["pos"])))
    rows = asked.filter(F.col(key).isNotNull()).select(key, *same, "_iv").join(told.hint("merge"), equal) \
                .select(key, "indicator", F.struct("predicted_class").alias("_p"), valued.alias("_top"))
    one = rows.groupBy(key, "indicator").agg(F.collect_set("_p").alias("_p"), F.flatten(F.collect_list("_top")).alias("_all"), F.count(F.lit(1)).alias("_n"))
    # requests of one key meet each other's answers in contributions(), so each driver comes more than k times
    every = F.when(F.col("_n") > 1, F.flatten(F.transform("_all", lambda d: F.array_repeat(d, k)))).otherwise(F.col("_all"))
    names = F.array(*[X.readable_feature(F.lit(NAMES[f])) for f in CM.NB_FEATURES])
    drivers = F.transform(F.slice(F.array_sort(every), 1, k),
                          lambda d, i: _named(rank=(i + 1).cast("bigint"), feature=F.get(names, d["pos"]), input_value=d["input_value"]))
    return one.select(key, "indicator", drivers.alias("drivers"), F.inline("_p")).select(key, "indicator", "predicted_class", "drivers")


def top_drivers(expl: DataFrame, key: str = "profile_id", k: int = C.TOP_DRIVERS) -> DataFrame:
    """Drivers with |impact| > 0.01 (impact rounded to 4 places), ranked by
    |impact| then feature order; the first ``k`` per prediction."""
    r = expl.withColumn("impact", F.col("impact").cast("decimal(18,4)")).filter(F.abs("impact") > C.MIN_IMPACT)
    w = Window.partitionBy(key, "indicator").orderBy(F.abs("impact").desc(), "pos")
    return r.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k)


def reasons(expl: DataFrame, key: str = "profile_id") -> DataFrame:
    """X16: 'Predicted 'v' mainly based on: Feature (input), ...' from the top three
    drivers that have an input value; a fixed sentence when no driver stands out.
    ``expl``: a row per feature, or the lists of :func:`leading`."""
    if "drivers" not in expl.columns:
        top = top_drivers(expl, key).filter(F.col("rank") <= C.REASON_DRIVERS)
        parts = top.groupBy(key, "indicator").agg(
            F.array_sort(F.collect_list(F.struct("rank", "feature", "input_value"))).alias("drivers"))
        expl = expl.select(key, "indicator", "predicted_class").distinct().join(parts, [key, "indicator"], "left")
    named = F.transform(F.filter("drivers", lambda d: d["input_value"] != ""),
                        lambda d: F.concat(d["feature"], F.lit(" ("), d["input_value"], F.lit(")")))
    head = F.concat(F.lit("Predicted '"), F.col("predicted_class"), F.lit("'"))
    reason = F.when(F.coalesce(F.size("drivers"), F.lit(0)) <= 0, F.concat(head, F.lit(" — inputs had similar influence"))) \
              .otherwise(F.concat(head, F.lit(" mainly based on: "), F.array_join(named, ", ")))
    return expl.select(key, "indicator", "predicted_class", reason.alias("reason"))
