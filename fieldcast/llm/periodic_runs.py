"""Periodic runs of words by an online sparse diagonal DP (operator 13).

A word at place i that equals an earlier word at place i - lag is a match on
the diagonal ``lag``.  Words are read in order; each earlier occurrence of a
word adds one to the match length of its diagonal, and a diagonal that the next
word does not continue ends.  One that ends with m >= max(3 * lag, 6 - lag)
matches is a stretch of m + lag words of period ``lag``, and is a run at once.

The words are read in blocks, so that the DP is a few array operations: the
matches of a block are sorted by diagonal, and only the diagonals that are
active at its end go on to the next block.  Diagonals are sparse: a lag of more
than a quarter of the text is too long for any run, and a match that continues
neither forwards nor backwards is none.  Blocks end after ``MATCHES`` matches,
so memory is bounded for any text.

Texts are read one by one, in the tasks that hold them; nothing is shuffled.  A
null text has no words.  Rows repeat as they are, also under a null doc_id.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcast.llm import hashing as H
from fieldcast.llm.common import chunks
from fieldcast.llm.quality_rules import words_of

#: A run has this many periods and this many words at least.
PERIODS, LEAST_WORDS = 4, 6
#: Matches that a block holds at once.
MATCHES = 1_000_000
RUN = "array<struct<start: long, length: long, period: long>>"


def _blocks(count: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of places with about ``limit`` matches each."""
    total = np.cumsum(count)
    begin = 0
    while begin < len(count):
        done = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, done + limit, side="right")))
        yield begin, end
        begin = end


def runs(code: np.ndarray, text: np.ndarray, limit: int = MATCHES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (both places, end included) and period of all runs of the words ``code``, whose texts are numbered by ``text``."""
    n = len(code)
    none = np.zeros(0, np.int64)
    if not n:
        return none, none, none
    # the places of each word of each text, in order
    order = np.argsort(code, kind="stable")
    group = np.cumsum(np.r_[False, (code[order][1:] != code[order][:-1]) | (text[order][1:] != text[order][:-1])])
    rank, group_of = np.empty(n, np.int64), np.empty(n, np.int64)
    rank[order], group_of[order] = np.arange(n), group
    begin = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    size = np.diff(np.r_[begin, n])
    farthest = np.repeat(size // PERIODS, size)
    place = np.arange(n)
    earliest = np.searchsorted(group * n + order, group_of * n + np.maximum(place - farthest, 0))
    count = rank - earliest
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    active = (none, none)  # lag and first match of the diagonals that the last block left active
    for x, y in _blocks(count, limit):
        here = count[x:y]
        i = np.repeat(place[x:y], here)
        j = order[np.arange(len(i)) - np.repeat(np.cumsum(here) - here, here) + np.repeat(earliest[x:y], here)]
        before = (j > 0) & (group_of[i - 1] == group_of[j - 1])
        after = (i + 1 < n) & (group_of[np.minimum(i + 1, n - 1)] == group_of[np.minimum(j + 1, n - 1)])
        keep = before | after
        i, lag = i[keep], (i - j)[keep]
        along = np.argsort(lag * n + i)
        i, lag = i[along], lag[along]
        new = np.r_[True, (lag[1:] != lag[:-1]) | (i[1:] != i[:-1] + 1)] if len(i) else np.zeros(0, bool)
        first, last = i[new], i[np.r_[new[1:], True]] if len(i) else none
        lag = lag[new]
        # an active diagonal goes on where a stretch of its lag begins with the block
        at = np.minimum(np.searchsorted(active[0], lag), max(len(active[0]) - 1, 0))
        goes_on = (first == x) & (active[0][at] == lag) if len(active[0]) else np.zeros(len(lag), bool)
        ended = np.ones(len(active[0]), bool)
        ended[at[goes_on]] = False
        out.append((active[1][ended], np.full(ended.sum(), x - 1), active[0][ended]))
        first = first.copy()
        first[goes_on] = active[1][at[goes_on]]
        stays = last == y - 1
        out.append((first[~stays], last[~stays], lag[~stays]))
        active = (lag[stays], first[stays])
    out.append((active[1], np.full(len(active[0]), n - 1), active[0]))
    first, last, lag = (np.concatenate(c) for c in zip(*out, strict=True))
    enough = last - first + 1 >= np.maximum((PERIODS - 1) * lag, LEAST_WORDS - lag)
    start, end, period = (first - lag)[enough], last[enough], lag[enough]
    # stretches over the same words have one run, that of the smallest period
    by = np.lexsort((period, end, start))
    start, end, period = start[by], end[by], period[by]
    one = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])] if len(start) else np.zeros(0, bool)
    return start[one], end[one], period[one]


def _found(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> (doc_id, n_words, runs, collapsed)."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for batch in chunks(batches):
        texts = batch.column("text").to_pylist()
        buf, at = H.join_texts(texts)
        starts, ends = H.word_spans(buf)
        code = H.spans_hash(buf, starts, ends)
        text = np.searchsorted(at, starts, side="right") - 1
        words = np.bincount(text, minlength=len(texts))
        base = np.cumsum(words) - words
        start, end, period = runs(code, text)
        owner = text[start]
        # a run keeps its first period; words of any run after that are dropped
        edge = np.zeros(len(code) + 1, np.int64)
        np.add.at(edge, start + period, 1)
        np.add.at(edge, end + 1, -1)
        kept = np.cumsum(edge[:-1]) == 0
        by = np.lexsort((period, start))
        start, end, period, owner = start[by], end[by], period[by], owner[by]
        bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
        collapsed = []
        for k, t in enumerate(texts):
            each = t.split()
            if bounds[k] < bounds[k + 1]:
                each = [w for w, good in zip(each, kept[base[k] : base[k] + words[k]].tolist(), strict=True) if good]
            collapsed.append(b" ".join(each).decode())
        parts = pa.StructArray.from_arrays([pa.array(start - base[owner], pa.int64()), pa.array(end - start + 1, pa.int64()), pa.array(period, pa.int64())], ["start", "length", "period"])
        found = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), parts)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words, pa.int64()), found.cast(kind), pa.array(collapsed, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])


def find_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row: all runs by start, and the words that stay when each run keeps one period."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(_found, f"doc_id long, n_words long, runs {RUN}, collapsed string")


def with_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of a tenth of the documents, by the checksum h of doc_id, the words from a on repeat with period p.

    a = g % n and p = 1 + (n - a) / (3 + g % 8), with g = h / 10 and n words.  A null doc_id is left as it is."""
    g = F.floor(F.crc32(F.col("doc_id").cast("string").cast("binary")) / 10)
    n = F.when(F.size("words") > 0, F.size("words").cast("long"))
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    told = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    told = told.withColumn("words", F.when(F.col("h") % 10 == 0, words_of(F.coalesce("text", F.lit("")))))
    told = told.withColumn("a", a).withColumn("p", p)
    repeated = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return told.select("doc_id", F.when(n.isNotNull(), F.concat_ws(" ", repeated)).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of ``find_runs``."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("most"), r["start"].alias("start"), r["period"].alias("period"))))
    told = found.withColumn("best", best)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    length = -F.col("best.most")
    return told.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", length.alias("length"), "best.period",
                       F.floor(1000 * length / F.col("best.period")).cast("long").alias("exponent_milli"),
                       F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words")
