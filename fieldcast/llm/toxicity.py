"""Toxicity by a chain of linear classifiers (operator 4).

The categories stand in an order.  The model of a category sees the features
of the text and the log-odds of every earlier category.  While the chain is
fitted, those log-odds come from models that have not seen the row: the sample
is cut into folds, and each fold is predicted by a model of the others
(out-of-fold).  For new texts they come from the model of the whole sample.

Features are hashed words and beginnings of words, as present or absent.  The
models are logistic with an L1 penalty (fitted by FTRL-proximal steps), so
most weights are zero and long clean texts add up to nothing.

The sample is bounded (``TRAIN_ROWS`` labelled rows, taken by a hash of
doc_id); every text is judged whole.  A null text has no features and gets the
base rates; rows whose label is null are left out for that category; with no
labelled rows every probability is 0.  Of several labels of one doc_id a yes
counts, and of several texts of a labelled doc_id the one whose features come
first in their bytes' order is learned from.  Rows are judged one by one, so repeated
rows and null doc_ids just repeat.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcast.llm import hashing as H
from fieldcast.llm.common import chunks

#: Labelled rows to learn from, folds of them, passes over them.
TRAIN_ROWS, FOLDS, PASSES = 12_000, 3, 6
#: Feature space, the lengths in bytes of beginnings of words, and the rows of the sample that a feature must occur in.
BITS, STARTS, MIN_ROWS = 22, (4, 5, 6), 5
#: FTRL-proximal: step size, its smoothing, and the two penalties.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 12.0, 1.0
#: Categories in the order of the chain: name, and the label value that means yes.
CATEGORIES = (("quality", 0), ("toxic", 1))
#: Probability from which a document is of a category.
LIMIT = 0.5
_U = np.uint64
_KIND = np.zeros(256, dtype=np.uint8)  # letters stand for themselves in lower case, bytes over 127 too, all else is a space
_KIND[:] = 32
_KIND[97:123] = np.arange(97, 123)
_KIND[65:91] = np.arange(97, 123)
_KIND[128:] = np.arange(128, 256)


def features(texts: list[bytes], weighted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs in the order of the texts; only features of the mask, if one is given."""
    buf, at = H.join_texts(texts)
    buf = _KIND[buf]
    starts, ends = H.word_spans(buf)
    text = np.searchsorted(at, starts, side="right") - 1
    found, owner = [], []
    for length in (None, *STARTS):
        stop = ends if length is None else np.minimum(starts + length, ends)
        long_enough = slice(None) if length is None else ends - starts > length
        h = H.spans_hash(buf, starts[long_enough], stop[long_enough]) + _U(length or 0)
        f = (H.mix(h) >> _U(64 - BITS)).astype(np.int64)
        t = text[long_enough]
        if weighted is not None:
            t, f = t[weighted[f]], f[weighted[f]]
        found.append(f)
        owner.append(t)
    pairs = np.unique((np.concatenate(owner) << BITS) | np.concatenate(found))
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Linear:
    """Weights of some features (the others have none), of the earlier categories' log-odds, and of the constant."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, dense: np.ndarray):
        self.ids, self.values, self.dense = ids, values.astype(np.float32), dense

    def odds(self, text: np.ndarray, feature: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        weights = np.zeros(1 << BITS, dtype=np.float32)
        weights[self.ids] = self.values
        return np.bincount(text, weights=weights[feature], minlength=len(earlier)) + earlier @ self.dense[:-1] + self.dense[-1]


def fit(first: np.ndarray, feature: np.ndarray, size: int, earlier: np.ndarray, label: np.ndarray, rows: np.ndarray, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Weights by FTRL-proximal over the given rows; row i has the features feature[first[i]:first[i+1]], all below ``size``."""
    wide = earlier.shape[1] + 1
    z, n = np.zeros(size + wide), np.zeros(size + wide)
    inputs = np.hstack([earlier, np.ones((len(earlier), 1))])
    penalty = np.r_[np.full(size, L1), np.zeros(wide)]

    def weights(at: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - penalty[at], 0)
        return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    random, tail = np.random.default_rng(seed), size + np.arange(wide)
    for _ in range(PASSES):
        for batch in np.array_split(random.permutation(rows), max(1, len(rows) // 128)):
            length = first[batch + 1] - first[batch]
            own = np.repeat(np.arange(len(batch)), length)
            mine = feature[np.repeat(first[batch] - np.cumsum(length) + length, length) + np.arange(len(own))]
            at, place = np.unique(mine, return_inverse=True)
            w, d = weights(at), weights(tail)
            error = _sigmoid(np.bincount(own, weights=w[place], minlength=len(batch)) + inputs[batch] @ d) - label[batch]
            for where, now, slope in ((at, w, np.bincount(place, weights=error[own], minlength=len(at))), (tail, d, error @ inputs[batch])):
                step = (np.sqrt(n[where] + slope**2) - np.sqrt(n[where])) / ALPHA
                z[where] += slope - step * now
                n[where] += slope**2
    return weights(np.arange(size)), weights(tail)


def fit_chain(rows: list[np.ndarray], labels: np.ndarray, fold: np.ndarray, folds: int = FOLDS) -> list[Linear]:
    """One model per column of ``labels`` (1, 0, or nan for unknown), each fed with the out-of-fold log-odds of those before.

    ``rows``: the distinct features of each row of the sample."""
    length = np.array([len(r) for r in rows])
    feature = np.concatenate([*rows, np.zeros(0, np.int32)])
    often = np.bincount(feature, minlength=1 << BITS) >= MIN_ROWS
    ids, keep = np.flatnonzero(often).astype(np.int32), often[feature]
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), length)[keep]
    feature = np.searchsorted(ids, feature[keep]).astype(np.int32)
    first = np.searchsorted(owner, np.arange(len(rows) + 1))
    earlier, chain = np.zeros((len(rows), 0)), []
    for column in labels.T:
        known = np.flatnonzero(~np.isnan(column))
        weights, dense = fit(first, feature, len(ids), earlier, column, known)
        chain.append(Linear(ids[weights != 0], weights[weights != 0], dense))
        unseen = np.zeros(len(rows))
        for f in range(folds):
            weights, dense = fit(first, feature, len(ids), earlier, column, known[fold[known] != f])
            odds = np.bincount(owner, weights=weights[feature], minlength=len(rows)) + earlier @ dense[:-1] + dense[-1]
            unseen[fold == f] = odds[fold == f]
        earlier = np.hstack([earlier, unseen[:, None]])
    return chain


def _featured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the sample with their features in place of the text."""
    for batch in chunks(batches):
        text, feature = features(batch.column("text").to_pylist())
        cuts = np.searchsorted(text, np.arange(batch.num_rows + 1))
        packed = [feature[a:b].astype("<i4").tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(packed, pa.binary())], [*names, "features"])


def _judge(shared, names: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        weighted = np.zeros(1 << BITS, dtype=bool)
        weighted[np.concatenate([m.ids for m in chain])] = True
        for batch in chunks(batches):
            texts = batch.column("text").to_pylist()
            text, feature = features(texts, weighted)
            earlier = np.zeros((len(texts), 0))
            for model in chain:
                earlier = np.hstack([earlier, model.odds(text, feature, earlier)[:, None]])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(_sigmoid(earlier[:, i])) for i in range(len(chain)))], ["doc_id", *names])

    return run


def classify(docs: DataFrame, labels: DataFrame, categories: tuple = CATEGORIES, train_rows: int = TRAIN_ROWS, limit: float = LIMIT) -> DataFrame:
    """(doc_id, p_<category>..., <last category> boolean) of every document."""
    names = [f"p_{name}" for name, _ in categories]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    said = labels.filter("doc_id IS NOT NULL").select("doc_id", *(F.when(F.col(n).isNotNull(), (F.col(n) == yes).cast("double")).alias(f"is_{n}") for n, yes in categories))
    said = said.groupBy("doc_id").agg(*(F.max(f"is_{n}").alias(f"is_{n}") for n, _ in categories))
    share = train_rows / max(said.count(), 1)
    said = said.filter(F.pmod(F.xxhash64("doc_id", F.lit("learn")), F.lit(1_000_000)) < 1_000_000 * share)
    wanted = [f"is_{n}" for n, _ in categories]
    sample = texts.join(F.broadcast(said), "doc_id").select("doc_id", *wanted, "text")
    kinds = ", ".join(["doc_id long", *(f"{n} double" for n in wanted), "features binary"])
    sample = sample.mapInArrow(_featured, kinds).toPandas().sort_values(["doc_id", "features"]).drop_duplicates("doc_id")
    if len(sample):
        fold = (H.mix(sample["doc_id"].to_numpy(np.int64).view(_U)) % _U(FOLDS)).astype(np.int64)
        chain = fit_chain([np.frombuffer(x, "<i4") for x in sample["features"]], sample[wanted].to_numpy(float), fold)
    else:
        none = np.zeros(0, np.int32)
        chain = [Linear(none, none, np.r_[np.zeros(i), -30.0]) for i in range(len(categories))]
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    out = texts.mapInArrow(_judge(shared, names), ", ".join(["doc_id long", *(f"{n} double" for n in names)]))
    return out.withColumn(categories[-1][0], F.col(names[-1]) >= limit)
