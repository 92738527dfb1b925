"""Scores of indicators whose classes grow with the data.

A class's likelihood is a product over the features,

    p(c, x) = exp(base(c)) * prod_f (1 + n(c, f, x_f) / alpha)

so two things shrink the work without leaving anything out:

* Classes with equal counts have equal scores for every input.  They are one
  *count profile* with a number of copies; the smallest class stands for them.
  Profiles are bounded by the distinct feature tuples, classes are not.
* Only distinct inputs are scored.  Their features split into two blocks
  (crop, country, partner and their interactions; the other five), each block's
  product is made once per distinct tuple, and a score is one multiplication.

Values are told by numbers (a dictionary of the model's vocabulary), and inputs
and profiles are both dealt in blocks.  A task meets one block of inputs with
blocks of profiles (broadcast in pieces of a checked size), keeps the best
class, its likelihood and the sum of all likelihoods of each input over them,
and returns these once.  They merge by minimum, maximum and sum, so nothing of
the size of the classes is ever shuffled per row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldcast import constants as C
from fieldcast.operators.util import broadcast_if_small, materialize

#: The features of the first block; the others are the second.
FIRST_BLOCK = ("crop_name", "country_code", "partner", "crop_country", "crop_partner", "country_partner")
#: Inputs of a block, counts of a block of profiles, and counts that are broadcast at once (8 bytes each).
BLOCK_INPUTS, BLOCK_COUNTS, PIECE_COUNTS = 32_768, 131_072, 4_194_304
#: Cells of a likelihood matrix that a task holds at once, profiles that it takes together, and cells of their factors.
CELLS, STEP_PROFILES, FACTORS = 60_000, 512, 4_000_000
#: Scores this close to the best one are compared as rounded logarithms.
NEAR = 1 - 3e-9

FEATURES = C.FEATURE_COLUMNS + [name for name, _, _ in C.INTERACTIONS]
SECOND_BLOCK = [f for f in FEATURES if f not in FIRST_BLOCK]
RESULT = "id long, a int, score double, idx int, best double, total double"


def vocabulary(fv: DataFrame) -> DataFrame:
    """(indicator, feature, value, code): the seen values of an indicator, numbered from 0; null is none."""
    seen = fv.filter(F.col("value").isNotNull()).select("indicator", "feature", "value").distinct()
    return seen.withColumn("code", F.row_number().over(Window.partitionBy("indicator").orderBy("feature", "value")) - 1)


def profiles(base: DataFrame, fv: DataFrame, codes: DataFrame) -> DataFrame:
    """(indicator, idx, base, copies, codes, ns): classes with equal counts as one row, named by the smallest."""
    told = fv.join(codes, ["indicator", "feature", "value"]).groupBy("indicator", "class") \
             .agg(F.array_sort(F.collect_list(F.struct("code", "n"))).alias("_c"))
    named = base.join(told, ["indicator", "class"], "left").withColumn("_c", F.coalesce("_c", F.expr("array()").cast("array<struct<code:int,n:bigint>>")))
    least = F.min(F.struct("idx", "base")).alias("least")
    return named.groupBy("indicator", F.col("_c.code").alias("codes"), F.col("_c.n").alias("ns")) \
                .agg(least, F.count(F.lit(1)).alias("copies")).select("indicator", "least.*", "copies", "codes", "ns")


def _blocks(table: DataFrame, weight, limit: int, *keys) -> DataFrame:
    """The table with a number ``block``, such that blocks hold about ``limit`` of ``weight`` each."""
    sizes = table.groupBy("indicator").agg(F.ceil(F.sum(weight) / F.lit(limit)).alias("_n"))
    salt = F.lit(0)
    for key in keys:  # several keys deal a grid, so that one value of a key meets several blocks
        side = F.ceil(F.pow(F.col("_n"), F.lit(1.0 / len(keys)))).cast("long")
        salt = salt * side + F.pmod(F.xxhash64(*key), side)
    return table.join(F.broadcast(sizes), "indicator").withColumn("block", salt).drop("_n")


def _tuples(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct columns of ``codes`` (features x inputs) and each input's number among them."""
    found, of = np.unique(codes, axis=1, return_inverse=True)
    return found, of.reshape(-1)


def _halves(tuples: np.ndarray) -> list:
    """The distinct halves of the tuples (features x tuples), each with the tuples' numbers among them."""
    middle = (len(tuples) + 1) // 2
    return [_tuples(half) for half in (tuples[:middle], tuples[middle:])]


def _products(factor: np.ndarray, halves: list) -> np.ndarray:
    """The product of a tuple's factors for every tuple and profile: made once per distinct half, then multiplied."""
    made = []
    for rows, of in halves:
        out = factor[rows[0]]
        for row in rows[1:]:
            out *= factor[row]
        made.append(np.take(out, of, axis=0))
    made[0] *= made[1]
    return made[0]


class _Inputs:
    """A block of inputs, and what its profiles gave so far."""

    def __init__(self, block: int, inputs: pa.StructArray, alphas: list[float]):
        self.block, self.alphas = block, alphas
        coded = np.stack([inputs.field(f).to_numpy(zero_copy_only=False) for f in FEATURES])
        # the codes that these inputs have, numbered from 1; 0 stands for values that no count has
        self.met = np.unique(coded[coded >= 0])
        coded = np.where(coded >= 0, np.searchsorted(self.met, coded) + 1, 0)
        first, a = _tuples(coded[[FEATURES.index(f) for f in FIRST_BLOCK]])
        second, b = _tuples(coded[[FEATURES.index(f) for f in SECOND_BLOCK]])
        self.left, self.right = _halves(first), _halves(second)
        # neighbours share their row of the block with more tuples: its matrix is read once in order, the smaller one stays in cache
        order = np.lexsort((b, a) if first.shape[1] > second.shape[1] else (a, b))
        self.a, self.b, self.ids = a[order], b[order], inputs.field("id").to_numpy(zero_copy_only=False)[order]
        n = (len(alphas), len(self.ids))  # a row for each smoothing
        self.score, self.idx, self.best, self.total = np.full(n, -np.inf), np.full(n, -1, np.int32), np.zeros(n), np.zeros(n)

    def meet(self, idx, bases, copies, codes, ns, of) -> None:
        """Profiles with their counts, ``of`` telling each count's profile, and a base for each smoothing."""
        at = np.minimum(np.searchsorted(self.met, codes), max(len(self.met) - 1, 0))
        hit = np.flatnonzero(self.met[at] == codes) if len(self.met) else np.zeros(0, np.int64)
        for a, alpha in enumerate(self.alphas):
            factor = np.ones((len(self.met) + 1, len(idx)))
            factor[at[hit] + 1, of[hit]] = 1.0 + ns[hit] / alpha
            self._multiply(a, idx, bases[a], copies, factor)

    def _multiply(self, a: int, idx, base, copies, factor) -> None:
        left, right = (_products(factor, halves) for halves in (self.left, self.right))
        left *= np.exp(base)
        step = max(1, CELLS // len(idx))
        work = np.empty((2, step, len(idx)))
        top = np.empty(len(self.ids))

        def products(rows_a, rows_b):
            p, other = work[:, : len(rows_a)]
            np.take(left, rows_a, axis=0, out=p, mode="clip")
            np.take(right, rows_b, axis=0, out=other, mode="clip")
            p *= other
            return p

        for at in range(0, len(self.ids), step):
            part = slice(at, at + step)
            p = products(self.a[part], self.b[part])
            self.total[a, part] += p @ copies
            p.max(axis=1, out=top[part])
        # a class further below the best one so far cannot be the best, also after rounding; few inputs have a nearer
        # one among these profiles, and theirs are made again, all at once
        near = np.flatnonzero(top >= self.best[a] * NEAR)
        for rows in np.split(near, range(step, len(near), step)):
            if len(rows):
                self._better(a, rows, products(self.a[rows], self.b[rows]), top[rows], idx)

    def _better(self, a: int, rows, p, top, idx) -> None:
        row, col = np.divmod(np.flatnonzero(p >= (top * NEAR)[:, None]), p.shape[1])  # faster than nonzero of a matrix
        log = np.round(np.log(p[row, col]), 9)
        order = np.lexsort((idx[col], -log, row))
        first = order[np.flatnonzero(np.r_[True, np.diff(row[order]) > 0])]
        score, named = log[first], idx[col[first]]
        held, at = self.score[a], self.idx[a]
        wins = (score > held[rows]) | ((score == held[rows]) & (named < at[rows]))
        held[rows[wins]], at[rows[wins]] = score[wins], named[wins]
        self.best[a, rows] = np.maximum(self.best[a, rows], top)

    def result(self) -> pa.RecordBatch:
        k, n = self.score.shape
        told = (np.tile(self.ids, k), np.repeat(np.arange(k, dtype=np.int32), n), *(x.reshape(-1) for x in (self.score, self.idx, self.best, self.total)))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in told], ["id", "a", "score", "idx", "best", "total"])


def _scored(batches: Iterator[pa.RecordBatch], alphas: list[float]) -> Iterator[pa.RecordBatch]:
    held = None
    for batch in batches:
        for i in range(batch.num_rows):
            number = batch.column("block")[i].as_py()
            if held is None or held.block != number:
                if held is not None:
                    yield held.result()
                held = _Inputs(number, batch.column("inputs").slice(i, 1).flatten(), alphas)
            block = batch.column("profiles").slice(i, 1).flatten()
            idx = block.field("idx").to_numpy(zero_copy_only=False)
            bases = block.field("base").flatten().to_numpy(zero_copy_only=False).reshape(len(idx), len(alphas)).T
            copies = block.field("copies").to_numpy(zero_copy_only=False).astype(float)
            counts = block.field("codes")
            sizes = np.diff(counts.offsets.to_numpy())
            ends = np.r_[0, np.cumsum(sizes)]
            codes, ns = (block.field(c).flatten().to_numpy(zero_copy_only=False) for c in ("codes", "ns"))
            step = min(STEP_PROFILES, max(1, FACTORS // (len(held.met) + 1)))
            for at in range(0, len(idx), step):
                part, mine = slice(at, at + step), slice(ends[at], ends[min(at + step, len(idx))])
                of = np.repeat(np.arange(len(idx[part])), sizes[part])
                held.meet(idx[part], bases[:, part], copies[part], codes[mine], ns[mine], of)
    if held is not None:
        yield held.result()


def _slices(inputs: DataFrame, profiles: DataFrame, tasks: int) -> DataFrame:
    """(indicator, blocks, slices): an indicator's blocks of inputs, and the slices of its profiles by which it has its
    share of about ``tasks`` tasks: blocks of inputs times blocks of profiles are its work."""
    of = inputs.groupBy("indicator").agg(F.count(F.lit(1)).alias("blocks")).join(
        profiles.groupBy("indicator").agg(F.count(F.lit(1)).alias("_p")), "indicator")
    whole = of.agg(F.sum(F.col("blocks") * F.col("_p"))).first()[0] or 1
    share = F.ceil(F.lit(tasks) * F.col("_p") / F.lit(whole))
    return of.select("indicator", "blocks", F.greatest(F.lit(1), F.least(share, F.col("_p"))).cast("int").alias("slices"))


def decide_inputs(asked: DataFrame, base: DataFrame, fv: DataFrame, alphas: list[float]) -> DataFrame:
    """(indicator, <11 features>, a, idx, confidence) of the distinct inputs (indicator, <11 features>) of ``asked``
    for each smoothing, ``a`` telling which; ``base`` holds an array with a base for each."""
    spark = asked.sparkSession
    codes = broadcast_if_small(materialize(vocabulary(fv), "nb_codes"))
    told = _blocks(materialize(profiles(base, fv, codes), "nb_profiles"), F.size("codes") + 1, BLOCK_COUNTS, ["codes", "ns"])
    told = told.groupBy("indicator", "block").agg(F.collect_list(F.struct("idx", "base", "copies", "codes", "ns")).alias("profiles"),
                                                  F.sum(F.size("codes") + 1).alias("n"))
    told = materialize(told, "nb_blocks")
    pieces = max(1, -(-(told.agg(F.sum("n")).first()[0] or 0) // PIECE_COUNTS))
    inputs = materialize(asked.select("indicator", *FEATURES).distinct().withColumn("id", F.monotonically_increasing_id()), "nb_inputs")
    coded = inputs
    for f in FEATURES:
        of = codes.filter(F.col("feature") == f).select("indicator", F.col("value").alias(f), F.col("code").alias(f"_{f}"))
        coded = coded.join(of, ["indicator", f], "left")
    coded = coded.select("indicator", "id", *[F.coalesce(f"_{f}", F.lit(-1)).alias(f) for f in FEATURES])
    dealt = _blocks(materialize(coded, "nb_coded"), F.lit(1), BLOCK_INPUTS, SECOND_BLOCK, list(FIRST_BLOCK)).groupBy("indicator", "block") \
        .agg(F.collect_list(F.struct("id", *FEATURES)).alias("inputs"))
    dealt = materialize(dealt.withColumn("block", F.monotonically_increasing_id()), "nb_input_blocks")
    # one block of inputs a task; an indicator with much of the work and few blocks in several slices of its profiles
    slices = F.col("slices")
    some = materialize(_slices(dealt, told, 4 * spark.sparkContext.defaultParallelism), "nb_slices")
    tasks = max(1, some.agg(F.sum(F.col("blocks") * slices)).first()[0] or 0)
    some = F.broadcast(some.select("indicator", "slices"))  # a row per question
    dealt = dealt.join(some, "indicator").select("indicator", "block", "inputs", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice")) \
                 .repartition(tasks)
    told = told.join(some, "indicator").withColumn("slice", F.pmod(F.col("block"), slices).cast("int"))
    parts = []
    for piece in range(pieces):
        here = told.filter(F.pmod(F.xxhash64("indicator", "block"), F.lit(pieces)) == piece).select("indicator", "slice", "profiles")
        cells = dealt.join(F.broadcast(here), ["indicator", "slice"]).select("block", "inputs", "profiles")
        parts.append(materialize(cells.mapInArrow(lambda batches: _scored(batches, alphas), RESULT), "nb_partial"))
    merged = reduce(DataFrame.unionByName, parts).groupBy("id", "a").agg(
        F.min(F.struct((-F.col("score")).alias("s"), "idx"))["idx"].alias("idx"),
        (F.lit(100.0) * F.max("best") / F.sum("total")).alias("confidence"))
    return inputs.join(merged, "id").drop("id")


def decide(rows: DataFrame, model, base: DataFrame, key: str, carry: tuple, extra_year: str | None) -> DataFrame:
    """(key, indicator, <carry>, predicted_class, confidence[, previous_class, previous_confidence]) of ``rows``."""
    asked = rows.select("indicator", *FEATURES)
    if extra_year:
        before = [F.col(extra_year).alias(f) if f == "planYear" else F.col(f) for f in FEATURES]
        asked = asked.unionByName(rows.select("indicator", *before))
    decided = decide_inputs(asked, base.withColumn("base", F.array("base")), model.fv, [float(model.alpha)])
    classes = model.classes.select("indicator", "idx", "class")
    decided = materialize(decided.join(classes, ["indicator", "idx"]).drop("idx", "a"), "nb_decided")

    def looked_up(df: DataFrame, year: str, cls: str, conf: str) -> DataFrame:
        named = broadcast_if_small(decided).withColumnsRenamed({"class": cls, "confidence": conf, **{f: f"_{f}" for f in FEATURES}, "indicator": "_indicator"})
        on = [F.col("indicator") == F.col("_indicator")]
        on += [F.col(year if f == "planYear" else f).eqNullSafe(F.col(f"_{f}")) for f in FEATURES]
        return df.join(named, on).drop("_indicator", *[f"_{f}" for f in FEATURES])

    out = looked_up(rows, "planYear", "predicted_class", "confidence")
    last = []
    if extra_year:
        out = looked_up(out, extra_year, "previous_class", "previous_confidence")
        last = ["previous_class", "previous_confidence"]
    return out.select(key, "indicator", *carry, "predicted_class", "confidence", *last)


def decide_each(rows: DataFrame, model, base: DataFrame, alphas: list[float], key: str, carry: tuple) -> DataFrame:
    """(key, indicator, <carry>, alpha, predicted_class, confidence) of ``rows`` for each smoothing. The counts, the
    inputs and their blocks are made once for all of them, and a row meets its answers in one join."""
    decided = decide_inputs(rows.select("indicator", *FEATURES), base, model.fv, alphas)
    named = decided.join(model.classes.select("indicator", "idx", F.col("class").alias("predicted_class")), ["indicator", "idx"])
    alpha = F.get(F.array(*[F.lit(float(a)) for a in alphas]), F.col("a")).alias("alpha")
    each = named.groupBy("indicator", *FEATURES).agg(F.collect_list(F.struct(alpha, "predicted_class", "confidence")).alias("_each"))
    each = materialize(each, "nb_decided").withColumnsRenamed({f: f"_{f}" for f in ("indicator", *FEATURES)})
    same = [F.col(f).eqNullSafe(F.col(f"_{f}")) for f in ("indicator", *FEATURES)]
    return rows.join(each.hint("merge"), same).select(key, "indicator", *carry, F.inline("_each"))
