"""Alignment of two tokenizations of every text by galloping intersection (operator 12).

Both tokenizers cover the same bytes, so their tokens are told by their end
offsets.  The shorter list of ends drives: each of its ends is looked up in the
longer list by steps that double, from where the last one stood, and a binary
search between the last two steps.  The common ends cut both lists into groups,
and the differences of the ranks are the range of tokens that a token overlaps.

* A batch of texts is one pair of lists: the texts' bytes follow each other.
  Its ends gallop together, from anchors a fixed number of ends apart.
* A text's links are kept as distinct id pairs with their numbers, in a table
  in the shared folder.  The corpus-wide count of a pair is a sum over the
  tasks' own sums.
* The counts go back to the texts by broadcast while they are few by a checked
  number, and by a join on the pair beyond it; both give the same result.

A text has no tokens if it is null or empty, or if the bytes of either side's
tokens are not a space and the text.  Rows are aligned one by one, so repeated
rows count repeatedly, and rows with a null doc_id keep their own results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcast.llm import tokens
from fieldcast.llm.common import chunks
from fieldcast.operators.util import materialize

#: The two vocabularies.
LEFT, RIGHT = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bits of an id of the second vocabulary in a pair.
BITS = 16
#: Ends of the driving list between two anchors.
STRIDE = 64
#: Pairs up to which the counts are broadcast (17 bytes each), and pairs that a task sums up at once.
BROADCAST_PAIRS, HELD_PAIRS = 2_000_000, 1_500_000
#: Bytes of text that are aligned at once.
BATCH_BYTES = 500_000


@lru_cache(maxsize=1)
def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Left:
    """The byte-level vocabulary: ids of a space and the text, special tokens' strings as plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.path, self.whole = path, Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        of = _byte_of()
        self.pieces = [b""] * self.whole.get_vocab_size()
        for piece, i in self.whole.get_vocab().items():
            self.pieces[i] = bytes(of[c] for c in piece) if all(c in of for c in piece) else piece.encode()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        spaced = [" " + t for t in texts]
        out = tokens.encode([t if "<|" not in t else "" for t in spaced], self.path)
        for i, t in enumerate(spaced):
            if "<|" in t:
                out[i] = np.array(self.whole.encode(t, add_special_tokens=False).ids, dtype="<u4")
        return out


class Right:
    """The vocabulary of pieces with byte fallback: ids of the text, before which it puts a space itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.pieces.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, dtype=np.int64) for ids in self.model.encode(texts, num_threads=1)]


@lru_cache(maxsize=1)
def _sides(left: str, right: str):
    sides = Left(left), Right(right)
    sizes = [np.array([len(p) for p in s.pieces], dtype=np.int64) for s in sides]
    return sides, sizes


@lru_cache(maxsize=1)
def _names(size: int) -> np.ndarray:
    return np.array([str(i) for i in range(size)], dtype=object)


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each end of ``short`` the number of ends of ``long`` before it, both ascending.

    Every ``STRIDE``-th end is an anchor, found by binary search; from there the
    others step on, 1, 2, 4, ... ends at a time, and search between the last two steps."""
    at = np.repeat(np.searchsorted(long, short[::STRIDE]), STRIDE)[: len(short)]
    low, step = at, np.ones(len(short), dtype=np.int64)
    # low: all before it are smaller; high: not smaller, or the end of the list
    high = np.minimum(low, len(long))
    open_ = np.flatnonzero((low < len(long)) & (long[np.minimum(low, len(long) - 1)] < short))
    low, high = low.copy(), high.copy()
    while len(open_):
        to = np.minimum(low[open_] + step[open_], len(long))
        smaller = (to < len(long)) & (long[np.minimum(to, len(long) - 1)] < short[open_])
        high[open_] = to
        low[open_[smaller]] = to[smaller]
        step[open_] *= 2
        open_ = open_[smaller]
    open_ = np.flatnonzero(high > low)
    while len(open_):
        middle = (low[open_] + high[open_]) >> 1
        smaller = long[middle] < short[open_]
        low[open_[smaller]] = middle[smaller] + 1
        high[open_[~smaller]] = middle[~smaller]
        open_ = open_[high[open_] > low[open_]]
    return low


def ranks(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each end of ``a`` how many ends of ``b`` are before it, and how many are not after it."""
    if len(a) <= len(b):
        before = gallop(a, b)
        return before, before + ((before < len(b)) & (b[np.minimum(before, len(b) - 1)] == a))
    at = gallop(b, a)
    same = (at < len(a)) & (a[np.minimum(at, len(a) - 1)] == b)
    return tuple(np.cumsum(np.bincount(x, minlength=len(a) + 1))[: len(a)] for x in (at + same, at))


def align(a_ids: list[np.ndarray], b_ids: list[np.ndarray], a_size: np.ndarray, b_size: np.ndarray):
    """Aligned texts of equal bytes on both sides -> (groups per text, link rows (text, a, b), group strings per text)."""
    na, nb = (np.array([len(x) for x in ids]) for ids in (a_ids, b_ids))
    a, b = (np.concatenate(ids).astype(np.int64) for ids in (a_ids, b_ids))
    ends_a, ends_b = np.cumsum(a_size[a]), np.cumsum(b_size[b])
    text_a = np.repeat(np.arange(len(na)), na)
    before, through = ranks(ends_a, ends_b)
    common = through > before
    groups = np.bincount(text_a, weights=common, minlength=len(na)).astype(np.int64)
    # a token overlaps the tokens that end after its start, as far as one that reaches its end
    first = np.r_[0, through[:-1]]
    width = before - first + 1
    link_a = np.repeat(np.arange(len(a)), width)
    link_b = np.arange(len(link_a)) - np.repeat(np.cumsum(width) - width, width) + np.repeat(first, width)
    # the strings: tokens of a group stand together, the first side's before the second's
    cut_a, cut_b = np.flatnonzero(common), before[common]
    group_a = np.cumsum(common) - common
    group_b = np.searchsorted(cut_b, np.arange(len(b)))
    names = _names(max(len(a_size), len(b_size)))
    last_a, last_b = common, np.zeros(len(b), bool)
    last_b[cut_b] = True
    final = np.zeros(len(b), bool)
    final[np.cumsum(nb) - 1] = True
    rows = np.empty(2 * (len(a) + len(b)), dtype=object)
    place_a = np.arange(len(a)) + np.r_[0, cut_b + 1][group_a]
    place_b = np.arange(len(b)) + (cut_a + 1)[group_b]
    rows[2 * place_a], rows[2 * place_b] = names[a], names[b]
    rows[2 * place_a + 1] = np.where(last_a, "|", ",")
    rows[2 * place_b + 1] = np.where(final, "", np.where(last_b, ";", ","))
    bounds = 2 * np.r_[0, np.cumsum(na + nb)]
    strings = ["".join(rows[x:y].tolist()) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
    return groups, (text_a[link_a], a[link_a], b[link_b]), strings


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<int>"


def _aligned(left: str, right: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, (a_size, b_size) = _sides(tokens.vocabulary(left), tokens.vocabulary(right))
        for batch in chunks(batches, limit=BATCH_BYTES):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            n = len(texts)
            some = [i for i, t in enumerate(texts) if t]
            ids = [s.encode([texts[i] for i in some]) for s in sides]
            good = []
            for k, i in enumerate(some):
                want = b" " + texts[i].encode()
                if all(b"".join([s.pieces[t] for t in each[k].tolist()]) == want for s, each in zip(sides, ids, strict=True)):
                    good.append(k)
            sha = [""] * n
            figures = np.zeros((4, n), dtype=np.int64)
            pair, times, size = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n, np.int64)
            if good:
                of = np.array([some[k] for k in good])
                a_ids, b_ids = ([each[k] for k in good] for each in ids)
                groups, (text, a, b), strings = align(a_ids, b_ids, a_size, b_size)
                key, times = np.unique(text << 32 | a << BITS | b, return_counts=True)
                owner, pair = key >> 32, key & 0xFFFFFFFF
                size[of] = np.bincount(owner, minlength=len(good))
                figures[0, of], figures[1, of] = [len(x) for x in a_ids], [len(x) for x in b_ids]
                figures[2, of], figures[3, of] = groups, np.bincount(text, minlength=len(good))
                for i, string in zip(of.tolist(), strings, strict=True):
                    sha[i] = hashlib.sha256(string.encode()).hexdigest()
            offsets = pa.array(np.r_[0, np.cumsum(size)], pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (pair.astype(np.uint32).view(np.int32), times)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(f) for f in figures), pa.array(sha, pa.string()), *lists], [c.split()[0] for c in ALIGNED.split(", ")])
        tokens.forget()

    return run


def _sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pairs, times) of texts -> (pair, n), a task's own sums."""
    held = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def summed() -> list[np.ndarray]:
        pair, of = np.unique(np.concatenate([held[0], *(w[0] for w in waiting)]), return_inverse=True)
        n = np.bincount(of, weights=np.concatenate([held[1], *(w[1] for w in waiting)]), minlength=len(pair))
        return [pair, n.astype(np.int64)]

    def rows(h: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(h[0].astype(np.int32)), pa.array(h[1])], ["pair", "n"])

    for batch in batches:
        waiting.append(tuple(batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("pairs", "times")))
        if sum(len(w[0]) for w in waiting) > HELD_PAIRS:
            held, waiting = summed(), []
            if len(held[0]) > HELD_PAIRS:
                yield rows(held)
                held = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
    if waiting or len(held[0]):
        yield rows(summed())


def _looked_up(counts):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = counts.value
        for batch in batches:
            size = np.diff(batch.column("pairs").offsets.to_numpy())
            owner = np.repeat(np.arange(len(size)), size)
            at = np.searchsorted(pair, batch.column("pairs").flatten().to_numpy())
            times = batch.column("times").flatten().to_numpy().astype(np.int64)
            total, tops = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            np.add.at(total, owner, times * n[at])
            np.add.at(tops, owner, times * best[at])
            kept = [c for c in batch.schema.names if c not in ("pairs", "times")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(tops), pa.array(total)], [*kept, "n_best", "count_sum"])

    return run


def alignments(docs: DataFrame, left: str = LEFT, right: str = RIGHT, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    told = materialize(rows.mapInArrow(_aligned(left, right), ALIGNED), "aligned")
    sums = told.select("pairs", "times").mapInArrow(_sums, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = materialize(sums.withColumn("b", F.expr(f"pair & {2**BITS - 1}")), "pair_counts")
    # one row for each id of the second vocabulary
    most = F.broadcast(counts.groupBy("b").agg(F.max("n").alias("most")))
    counted = counts.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    if counts.count() <= broadcast_pairs:
        table = counted.toPandas().sort_values("pair")
        sent = spark.sparkContext.broadcast((table["pair"].to_numpy(np.int32), table["n"].to_numpy(np.int64), table["best"].to_numpy(bool)))
        kept = ", ".join(ALIGNED.split(", ")[:-2])
        return told.mapInArrow(_looked_up(sent), f"{kept}, n_best long, count_sum long")
    numbered = materialize(told.withColumn("row", F.monotonically_increasing_id()), "numbered")
    links = numbered.select("row", F.inline(F.arrays_zip("pairs", "times"))).withColumnsRenamed({"pairs": "pair"})
    found = links.join(counted, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).cast("long").alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    out = numbered.drop("pairs", "times").join(found, "row", "left").drop("row")
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_best", "count_sum")})
