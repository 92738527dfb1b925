"""Exact k nearest training profiles for every query profile.

Euclidean distance over the 11 encoded features, as the reference computes it.
Training rows are dealt to blocks: boxes of a tree whose splits come from a
sample of them (the splits decide who works on a row, not the result).  A query
goes to the block it lies in and finds its k nearest rows there.  A row of
another block can only be as near if the block's own box, over all its rows, is:
the query goes on to those blocks with its k-th distance, and the answers merge.
So every query is shuffled once, and once more for each further block that its
k-th distance reaches, whatever the density; no pair of rows leaves a task.

Inside a block the same kind of tree has leaves of a few rows: neighbouring
queries meet the leaves by their distance, until the next one is farther than
the k-th row of each.  Distances of boxes are sums in the order of the features,
as those of rows, so rounding cannot make a box farther than a row in it.

Identical training vectors keep only their k lowest ids (ties are broken by id),
and identical query vectors are solved once and joined back to their query ids
as one list.

Queries, training rows and results all grow with the data, so their joins are
sort-merge joins by hint: written tables of repeated values are a hundredth of
their rows on disk, by which Spark would broadcast them through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldcast import constants as C
from fieldcast.functions import scalar as X
from fieldcast.operators.features import FEATURE_NAMES
from fieldcast.operators.util import materialize

DEC = "decimal(18,6)"
#: Training rows and queries of a block, rows of a leaf, leaves that are met at once, and sampled rows of a block.
BLOCK_ROWS, BLOCK_QUERIES, LEAF_ROWS, LEAVES, SAMPLED = 50_000, 100_000, 64, 8, 64
#: Fewest rows for which a table is dealt to more blocks than its rows ask for, so that all cores have some.
LEAST_ROWS = 2_000


def _vec(prefix: str = "") -> list:
    return [F.col(f"{prefix}{f}").cast("double").alias(f) for f in FEATURE_NAMES]


def distance(q: str = "q_", t: str = "t_") -> F.Column:
    total = None
    for f in FEATURE_NAMES:
        d = F.col(f"{q}{f}") - F.col(f"{t}{f}")
        total = d * d if total is None else total + d * d
    return F.sqrt(total)


def _first_radius(t: DataFrame, grid: list[str], radius: float, dense: int) -> float:
    """The cell width of a grid over ``t``: narrower, by fours, while the fullest cell has more than ``dense`` rows and
    that helps (rows that agree in all grid features stay together at any width).  :func:`nearest` has no grid."""
    def fullest(width: float) -> int:
        cell = [F.floor(F.col(f"t_{f}") / F.lit(width)) for f in grid]
        return t.groupBy(*cell).count().agg(F.max("count")).first()[0] or 0

    most = fullest(radius) if grid else 0
    while most > dense:
        width, less = radius, most
        for _ in range(10):  # a dense spot may be a millionth of its cell
            width /= 4
            less = fullest(width)
            if less < most:
                break
        if less >= most:
            return radius
        radius, most = width, less
    return radius


class _Tree:
    """Splits of points at a middle value of the feature with the widest range, until a leaf has ``size`` points
    or all of its points are equal."""

    def __init__(self, points: np.ndarray, size: int):
        feature, value, low, high, self.leaves = [], [], [], [], []
        todo = [(np.arange(len(points)), None)]
        while todo:
            rows, at = todo.pop()
            if at is not None:
                (low if at[1] else high)[at[0]] = len(feature)
            mine = points[rows]
            span = np.ptp(mine, axis=0) if len(rows) > size else np.zeros(1)
            f = int(span.argmax())
            split = span[f] > 0
            if split:
                middle = np.median(mine[:, f])
                if not (mine[:, f] < middle).any():
                    middle = mine[mine[:, f] > middle, f].min()
                below = mine[:, f] < middle
                todo += [(rows[~below], (len(feature), False)), (rows[below], (len(feature), True))]
            feature.append(f if split else -1)
            value.append(middle if split else 0.0)
            low.append(0 if split else len(self.leaves))  # a leaf has its number here
            high.append(0)
            if not split:
                self.leaves.append(rows)
        self.feature, self.value, self.low, self.high = map(np.array, (feature, value, low, high))

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        """The number of the leaf that each point lies in."""
        node = np.zeros(len(points), int)
        while len(left := np.flatnonzero(self.feature[node] >= 0)):
            at = node[left]
            node[left] = np.where(points[left, self.feature[at]] < self.value[at], self.low[at], self.high[at])
        return self.low[node]


def _length(steps: Iterator[np.ndarray]) -> np.ndarray:
    """The root of the sum of squares, summed in the order of the features as :func:`distance` does."""
    total = None
    for d in steps:
        d = d * d
        total = d if total is None else total + d
    return np.sqrt(total)


def _apart(lo, hi, box_lo, box_hi) -> np.ndarray:
    """Distance of boxes (rows of lo, hi) from others."""
    steps = (np.maximum(np.maximum(box_lo[None, :, f] - hi[:, None, f], lo[:, None, f] - box_hi[None, :, f]), 0.0) for f in range(lo.shape[1]))
    return _length(steps)


def _search(points: np.ndarray, ids: np.ndarray, asked: np.ndarray, far: np.ndarray, k: int, blocks=None):
    """Distances and ids of the k nearest ``points`` of each query, no farther than ``far`` (endless and -1 where there
    are fewer), and with ``blocks`` (numbers, lo, hi) the pairs (query, number) of blocks that may hold nearer rows."""
    tree = _Tree(points, LEAF_ROWS)
    lo, hi = (np.array([f(points[rows], axis=0) for rows in tree.leaves]) for f in (np.min, np.max))
    found, named = np.full((len(asked), k), np.inf), np.full((len(asked), k), -1, np.int64)
    leaf = tree.leaf_of(asked)
    order = np.argsort(leaf, kind="stable")
    more = []
    for group in (g[i:i + 2 * LEAF_ROWS] for g in np.split(order, np.flatnonzero(np.diff(leaf[order])) + 1) for i in range(0, len(g), 2 * LEAF_ROWS)):
        q, best, who = asked[group], found[group], named[group]
        q_lo, q_hi = q.min(axis=0)[None], q.max(axis=0)[None]
        bound = far[group]
        gap = _apart(q_lo, q_hi, lo, hi)[0]
        gap[leaf[group[0]]] = -1.0  # the own leaf first
        near = np.argsort(gap, kind="stable")
        at, step = 0, 1
        while at < len(near) and gap[near[at]] <= bound.max():
            some = near[at:at + step]
            at, step = at + step, LEAVES
            rows = np.flatnonzero((_apart(q, q, lo[some], hi[some]) <= bound[:, None]).any(axis=1))
            if not len(rows):
                continue
            met = np.concatenate([tree.leaves[i] for i in some])
            d = _length(q[rows, f][:, None] - points[met, f][None] for f in range(q.shape[1]))
            r, c = np.nonzero(d <= bound[rows][:, None])
            # the nearest of the found and the new ones
            of = np.r_[np.repeat(np.arange(len(rows)), k), r]
            dist, name = np.r_[best[rows].reshape(-1), d[r, c]], np.r_[who[rows].reshape(-1), ids[met[c]]]
            by = np.lexsort((name, dist, of))
            of = of[by]
            first = by[np.arange(len(of)) - np.searchsorted(of, of) < k].reshape(len(rows), k)
            best[rows], who[rows] = dist[first], name[first]
            bound = np.minimum(bound, best[:, -1])
        found[group], named[group] = best, who
        if blocks is not None:
            some = np.flatnonzero(_apart(q_lo, q_hi, *blocks[1:])[0] <= bound.max())
            r, c = np.nonzero(_apart(q, q, blocks[1][some], blocks[2][some]) <= bound[:, None])
            more.append((group[r], blocks[0][some[c]]))
    return found, named, [np.concatenate(x) for x in zip(*more, strict=True)] if more else None


def _vectors(table) -> np.ndarray:
    return np.stack([table.column(f).to_numpy() if isinstance(table, pa.Table) else table.column(f).to_numpy(zero_copy_only=False) for f in FEATURE_NAMES], axis=1)


def _lists(values: np.ndarray, keep: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(keep.sum(axis=1))], pa.int32()), pa.array(values[keep]))


def _in_blocks(df: DataFrame, tree: _Tree) -> DataFrame:
    """The rows with the number of the block in which their vector lies."""
    def told(batches):
        for batch in batches:
            yield batch.append_column("_block", pa.array(tree.leaf_of(_vectors(batch)).astype(np.int32)))
    return df.mapInArrow(told, df.select("*", F.lit(0).alias("_block")).schema)


def _meet(asked: DataFrame, train: DataFrame, k: int, blocks: tuple, first: bool) -> DataFrame:
    """(_q, <11 features>, more, d, t): each query (_q, <11 features>, _block, _far) with the nearest rows of its block,
    and the other blocks that may hold nearer ones if it is the ``first`` that it meets."""
    told = asked.groupBy("_block").count().collect()  # a row per block
    parts = {r["_block"]: -(-r["count"] // BLOCK_QUERIES) for r in told}
    many = {b: n for b, n in parts.items() if n > 1}
    # a block of very many queries is met in parts, each with all of its training rows
    n = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in many.items() for x in pair]), F.col("_block")), F.lit(1)) if many else F.lit(1)
    asked = asked.withColumn("_part", F.pmod(F.xxhash64("_q"), n).cast("int"))
    train = train.withColumn("_part", F.explode(F.sequence(F.lit(0), n - 1)))
    spark, keys = asked.sparkSession, ["_block", "_part"]
    tasks = min(2 * sum(parts.values()) + spark.sparkContext.defaultParallelism, 4_000)
    schema = ", ".join(["_q long", *[f"{f} double" for f in FEATURE_NAMES], "more array<int>, d array<double>, t array<long>"])
    names = [part.split()[0] for part in schema.split(", ")][:-3] + ["more", "d", "t"]

    def solved(left: pa.Table, right: pa.Table) -> pa.Table:
        q = _vectors(left)
        if left.num_rows and right.num_rows:
            own = left.column("_block")[0].as_py()
            others = tuple(x[blocks[0] != own] for x in blocks) if first else None
            d, t, more = _search(_vectors(right), right.column("_tid").to_numpy(), q, left.column("_far").to_numpy(), k, others)
        else:
            d, t, more = np.full((len(q), k), np.inf), np.full((len(q), k), -1, np.int64), None
            if first:  # a block without training rows: all others are met
                more = (np.repeat(np.arange(len(q)), len(blocks[0])), np.tile(blocks[0], len(q)))
        rows, numbers = more if more is not None else (np.zeros(0, int), np.zeros(0, int))
        by = np.argsort(rows, kind="stable")
        ends = np.r_[0, np.cumsum(np.bincount(rows, minlength=len(q)))]
        further = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(numbers[by], pa.int32()))
        keep = np.isfinite(d)
        return pa.Table.from_arrays([left.column("_q"), *[pa.array(q[:, i]) for i in range(q.shape[1])], further, _lists(d, keep), _lists(t, keep)], names=names)

    left, right = asked.repartition(tasks, *keys), train.repartition(tasks, *keys)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(solved, schema)


def _boxes(train: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The blocks' numbers and the boxes of their rows: a row per block."""
    told = train.groupBy("_block").agg(*[f(c).alias(f"{side}_{c}") for side, f in (("lo", F.min), ("hi", F.max)) for c in FEATURE_NAMES]).collect()
    of = lambda side: np.array([[r[f"{side}_{f}"] for f in FEATURE_NAMES] for r in told])
    return np.array([r["_block"] for r in told], np.int64), of("lo"), of("hi")


def nearest(queries: DataFrame, train: DataFrame, qid: str, tid: str, k: int = C.DEFAULT_NEIGHBOURS,
            dense: int = BLOCK_ROWS) -> DataFrame:
    """(qid, rank, neighbour_id, distance, similarity_pct) — the k nearest
    training rows per query, ties by id; all of them if there are fewer than k.
    ``dense``: about as many training rows make a block."""
    k = min(k, C.MAX_NEIGHBOURS)
    t = train.select(F.col(tid).cast("long").alias("_tid"), *_vec())
    w_dup = Window.partitionBy(*FEATURE_NAMES).orderBy("_tid")
    t = t.withColumn("_r", F.row_number().over(w_dup)).filter(F.col("_r") <= k).drop("_r")
    t = materialize(t, "knn_train")
    n = t.count()
    blocks = max(-(-n // dense), min(2 * t.sparkSession.sparkContext.defaultParallelism, n // LEAST_ROWS), 1)
    some = t.filter(F.pmod(F.xxhash64("_tid"), F.lit(max(1, n // (blocks * SAMPLED)))) == 0).select(*FEATURE_NAMES).collect() if n else []
    tree = _Tree(np.array([tuple(r) for r in some], float).reshape(-1, len(FEATURE_NAMES)), -(-len(some) // blocks))
    asked = materialize(queries.select(*_vec()).distinct().withColumn("_q", F.monotonically_increasing_id()), "knn_queries")
    if not n:
        asked = asked.limit(0)
    dealt = _in_blocks(t, tree)
    boxes = _boxes(dealt)
    near = materialize(_meet(_in_blocks(asked, tree).withColumn("_far", F.lit(float("inf"))), dealt, k, boxes, True), "knn_near")
    pairs = F.arrays_zip("d", "t").alias("_all")
    settled = F.size("more") == 0
    again = near.filter(~settled).select("_q", *FEATURE_NAMES, F.explode("more").alias("_block"),
                                         F.when(F.size("d") == k, F.element_at("d", -1)).otherwise(F.lit(float("inf"))).alias("_far"))
    far = materialize(_meet(materialize(again, "knn_again"), dealt, k, boxes, False).select("_q", pairs), "knn_far")
    far = far.groupBy("_q").agg(F.flatten(F.collect_list("_all")).alias("_more"))
    merged = F.slice(F.array_sort(F.concat("_all", "_more")), 1, k).alias("_all")
    done = near.filter(settled).select(*FEATURE_NAMES, pairs).unionByName(
        near.filter(~settled).select("_q", *FEATURE_NAMES, pairs).join(far.hint("merge"), "_q").select(*FEATURE_NAMES, merged))
    done = done.select(*[F.col(f).alias(f"q_{f}") for f in FEATURE_NAMES], "_all")
    qk = queries.select(F.col(qid), *[F.col(f).cast("double").alias(f"q_{f}") for f in FEATURE_NAMES])
    back = qk.join(done.hint("merge"), [f"q_{f}" for f in FEATURE_NAMES]) \
             .select(qid, F.array_max(F.col("_all.d")).alias("_dmax"), F.posexplode("_all").alias("_at", "_n"))
    return back.select(qid, (F.col("_at") + 1).cast("bigint").alias("rank"), F.col("_n.t").alias("neighbour_id"),
                       F.col("_n.d").cast(DEC).alias("distance"), X.similarity_pct("_n.d", F.col("_dmax")).cast(DEC).alias("similarity_pct"))


def nearest_lsh(queries: DataFrame, train: DataFrame, qid: str, tid: str, k: int = C.DEFAULT_NEIGHBOURS,
                bucket: float | None = None, tables: int = 12) -> DataFrame:
    """(qid, rank, neighbour_id, distance): the option for large query sets, by random projections.

    Only rows that share a bucket of one of the ``tables`` projections with a
    query and are no farther than ``bucket`` from it are compared, so a neighbour
    can be missed and a query in an empty region can have fewer than k rows.  The
    default width is twice the median distance of the k-th neighbour, measured by
    :func:`nearest` on one query in a hundred (200 at most, a stated sample)."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH, VectorAssembler
    k = min(k, C.MAX_NEIGHBOURS)
    va = VectorAssembler(inputCols=FEATURE_NAMES, outputCol="features")
    told = materialize(train.select(F.col(tid).alias("_tid"), *_vec()), "lsh_train")
    asked = materialize(queries.select(F.col(qid).alias("_qid"), *_vec()), "lsh_queries")
    if bucket is None:
        some = asked.filter(F.pmod(F.xxhash64("_qid"), F.lit(100)) == 0).orderBy("_qid").limit(200)
        far = nearest(some if some.count() else asked.limit(20), told, "_qid", "_tid", k).filter(F.col("rank") == k)
        bucket = 2 * float(far.agg(F.percentile_approx("distance", 0.5)).first()[0] or 1.0)
    rows, points = (va.transform(x).select(i, "features") for x, i in ((told, "_tid"), (asked, "_qid")))
    index = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=max(bucket, 1e-9), numHashTables=tables, seed=7).fit(rows)
    pairs = index.approxSimilarityJoin(points, rows, bucket, "distance")
    pairs = pairs.select(F.col("datasetA._qid").alias(qid), F.col("datasetB._tid").alias("neighbour_id"), "distance")
    by_query = Window.partitionBy(qid).orderBy("distance", "neighbour_id")
    return pairs.withColumn("rank", F.row_number().over(by_query).cast("bigint")).filter(F.col("rank") <= k) \
                .select(qid, "rank", "neighbour_id", "distance")
