"""Packing documents into fixed-length sequences by cutting-stock column generation (operator 5).

A document is cut into whole sequences and a rest, and the rest at its last
multiple of ``UNIT`` tokens, so a rest is two pieces at most.  Packing them is
the cutting-stock problem over the histogram of their lengths, which has some
eighty bars at any number of documents: a linear program chooses how often to
use each pattern of lengths, and patterns are generated while they are needed,
by knapsack dynamic programming over the program's prices.  The numbers are
rounded down, the few pieces left over are packed first-fit.  The pieces of
each length are ranked, and a rank tells the pattern, the sequence and the
offset by a small table.

A null text is a document of its end id alone.  Rows are packed one by one:
repeated rows and rows with null doc_ids get places of their own.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcast.llm import tokens
from fieldcast.llm.common import chunks
from fieldcast.operators.util import materialize, rank_within

#: Tokens in a sequence, the vocabulary, and the id that ends a document.
CAPACITY, VOCABULARY, END_ID = 1024, "byte_bpe_50k.json", 0
#: A rest is cut at its last multiple of this.
UNIT = 64
#: The linear program stops this near to its lower bound, or after so many columns.
GAP, MOST_COLUMNS = 0.0005, 6000


def knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of lengths within the capacity: its value and how often it takes each length."""
    value = np.zeros(capacity + 1)
    taken = np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        fits = np.searchsorted(lengths, c, side="right")
        value[c] = value[c - 1]
        if fits:
            worth = value[c - lengths[:fits]] + prices[:fits]
            best = int(np.argmax(worth))
            if worth[best] > value[c] + 1e-12:
                value[c], taken[c] = worth[best], best
    count = np.zeros(len(lengths))
    c = capacity
    while c > 0:
        if taken[c] < 0:
            c -= 1
        else:
            count[taken[c]] += 1
            c -= int(lengths[taken[c]])
    return float(value[capacity]), count


def fractional_patterns(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and how often to use each, near the optimum of the linear program min sum(x), patterns @ x = demand.

    Revised simplex method with an explicit inverse of the basis."""
    m = len(lengths)
    copies = capacity // lengths
    patterns = np.diag(copies).astype(float)
    inverse = np.diag(1.0 / copies)
    use = demand / copies
    bound = float(lengths @ demand) / capacity
    for _ in range(MOST_COLUMNS):
        prices = inverse.sum(axis=0)
        value, column = knapsack(lengths, prices, capacity)
        bound = max(bound, use.sum() / value)  # the program cannot be better than its value over the best column's
        if value <= 1 + 1e-9 or use.sum() <= (1 + GAP) * bound:
            break
        step = inverse @ column
        positive = step > 1e-9
        ratio = np.full(m, np.inf)
        ratio[positive] = use[positive] / step[positive]
        out = int(np.argmin(ratio))
        use = np.maximum(use - ratio[out] * step, 0)
        use[out] = ratio[out]
        patterns[:, out] = column
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
    return patterns, use


def first_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """First-fit in descending order."""
    bins: list[list[int]] = []
    room: list[int] = []
    for n in sorted(lengths, reverse=True):
        for i, r in enumerate(room):
            if r >= n:
                bins[i].append(n)
                room[i] -= n
                break
        else:
            bins.append([n])
            room.append(capacity - n)
    return bins


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: copies}) of the patterns that hold exactly the documents of the histogram."""
    if not histogram:
        return []
    lengths = np.array(sorted(histogram))
    demand = np.array([histogram[n] for n in lengths.tolist()], dtype=float)
    patterns, use = fractional_patterns(lengths, demand, capacity)
    times = np.floor(use + 1e-9).astype(np.int64)
    out = [(int(t), {int(n): int(c) for n, c in zip(lengths, p, strict=True) if c}) for t, p in zip(times, patterns.T, strict=True) if t]
    rest = demand.astype(np.int64) - (patterns.astype(np.int64) @ times)
    bins = Counter(tuple(sorted(Counter(b).items())) for b in first_fit(np.repeat(lengths, rest).tolist(), capacity))
    return out + [(n, dict(b)) for b, n in sorted(bins.items())]


def _pieces(capacity: int, vocabulary: str, end_id: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokens.vocabulary(vocabulary)
        for batch in chunks(batches):
            rows: list[tuple] = []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc, ids in zip(batch.column("doc_id").to_pylist(), tokens.encode(texts, path), strict=True):
                data = np.append(ids, np.uint32(end_id)).astype("<u4").tobytes()
                n = len(data) // 4
                whole = n // capacity * capacity
                cuts = sorted({*range(0, whole + 1, capacity), whole + (n - whole) // UNIT * UNIT, n})
                rows += [(doc, a, b - a, zlib.crc32(data[4 * a : 4 * b]), n) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        tokens.forget()

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pieces(capacity, vocabulary, end_id), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
    pieces = materialize(cut.withColumn("piece", F.monotonically_increasing_id()), "pieces")
    histogram = {r.length: r.n for r in pieces.filter(F.col("length") < capacity).groupBy("length").agg(F.count("*").alias("n")).collect()}
    # for each length the ranks that a pattern takes, its first sequence, and the place of the length in it
    table, sequences, taken = [], 0, Counter()
    for times, pattern in plan(histogram, capacity):
        offset = 0
        for length, copies in sorted(pattern.items(), reverse=True):
            table.append((length, taken[length], taken[length] + times * copies, copies, sequences, offset))
            taken[length] += times * copies
            offset += length * copies
        sequences += times
    slots = spark.createDataFrame(table, "length long, first long, stop long, copies long, base long, at long")
    ranked = rank_within(pieces.filter(F.col("length") < capacity), ["length"], "piece").withColumn("nth", F.col("rank") - 1)
    placed = ranked.join(F.broadcast(slots), "length").filter("nth >= first AND nth < stop")
    within = F.col("nth") - F.col("first")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    rests = placed.select(*columns, (F.col("base") + F.floor(within / F.col("copies"))).alias("sequence_id"), (F.col("at") + within % F.col("copies") * F.col("length")).alias("offset"))
    whole = pieces.filter(F.col("length") == capacity).select(*columns, (F.lit(sequences) + F.col("piece")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return rests.unionByName(whole)
