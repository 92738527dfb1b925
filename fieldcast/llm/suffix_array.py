"""Substring dedup by suffix arrays built in two stages (operator 6).

In each group of byte contexts (:mod:`.repeats`) the suffixes of interest are
sorted in two stages: only those smaller than their successor are sorted
directly; one scan over the buckets of first bytes, in order, then induces the
place of the rest from the suffix that follows each of them.  Common prefixes
of neighbours in the array show which ``window``-byte strings are equal, and
all but the earliest start of each are repeats.

A null text is empty; a null doc_id sorts after all others; rows of equal
doc_id count as one document's, so repeated rows stay equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcast.llm.common import LAST_ID, chunks
from fieldcast.llm.repeats import Spec, repeated_windows, unpack, with_flags
from fieldcast.llm.suffix_tree import covered

#: Bytes in a window, and bytes in the grams that sample suffixes.
WINDOW, GRAM = 100, 32


def _next_true(mask: np.ndarray) -> np.ndarray:
    """For each place, the first place at or after it where mask holds (len(mask) if none)."""
    n = len(mask)
    return np.minimum.accumulate(np.where(mask, np.arange(n), n)[::-1])[::-1]


def two_stage_sort(text: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """Order of the wanted suffixes of ``text`` by their first ``depth`` symbols.

    ``text`` holds byte values plus one, with 0 after each context; ``wanted``
    is a mask without the zeros."""
    n = len(text)
    rises = np.zeros(n, dtype=bool)  # smaller than the successor
    differs = np.zeros(n, dtype=bool)
    differs[:-1] = text[1:] != text[:-1]
    to = np.minimum(_next_true(differs), n - 2) if n > 1 else np.zeros(n, np.int64)
    rises[:-1] = (text[to + 1] > text[to])[:-1]
    # a falling suffix is induced from its successor: take in all up to the next rising one or the end
    stop = _next_true(rises | (text == 0))
    tail = np.zeros(n + 1, dtype=np.int64)
    falling = np.flatnonzero(wanted & ~rises)
    np.add.at(tail, falling, 1)
    np.subtract.at(tail, stop[falling] + 1, 1)
    needed = wanted | (np.cumsum(tail[:-1]) > 0)
    # stage one: sort the rising suffixes
    direct = np.flatnonzero(needed & rises & (text > 0))
    raw = np.zeros(n + depth, dtype=np.uint8)
    raw[:n] = np.where(text > 0, text - 1, 0)
    ends = _next_true(text == 0)
    look = np.lib.stride_tricks.sliding_window_view(raw, depth)[direct]
    short = np.flatnonzero(ends[direct] - direct < depth)
    if len(short):
        look[short] *= np.arange(depth)[None, :] < (ends[direct[short]] - direct[short])[:, None]
    rank = np.argsort(np.ascontiguousarray(look).view(f"S{depth}").ravel(), kind="stable")
    direct = direct[rank]
    # stage two: scan the buckets in order of their symbol
    buckets: list[list[np.ndarray]] = [[] for _ in range(258)]
    bounds = np.searchsorted(text[direct], np.arange(259))
    out = []
    zeros = np.flatnonzero((text == 0) & needed)

    def induce(wave: np.ndarray, symbol: int) -> np.ndarray:
        """Put the falling predecessors of a wave into their buckets; those of the same bucket are the next wave."""
        before = wave[wave > 0] - 1
        before = before[needed[before] & ~rises[before] & (text[before] >= max(symbol, 1))]
        if not len(before):
            return before
        heads = text[before]
        order = np.argsort(heads, kind="stable")
        before, heads = before[order], heads[order]
        cuts = np.flatnonzero(np.r_[True, heads[1:] != heads[:-1]]).tolist()
        again = before[:0]
        for lo, hi in zip(cuts, [*cuts[1:], len(heads)], strict=True):
            if heads[lo] == symbol:
                again = before[lo:hi]
            else:
                buckets[int(heads[lo])].append(before[lo:hi])
        return again

    induce(zeros, 0)
    for symbol in range(1, 257):
        wave = np.concatenate(buckets[symbol]) if buckets[symbol] else np.zeros(0, np.int64)
        while len(wave):
            out.append(wave)
            wave = induce(wave, symbol)
        wave = direct[bounds[symbol] : bounds[symbol + 1]]
        if len(wave):
            out.append(wave)
            induce(wave, symbol)
    sorted_ = np.concatenate(out) if out else np.zeros(0, np.int64)
    return sorted_[wanted[sorted_]]


def common_prefixes(raw: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Length, up to ``depth``, of the common prefix of each suffix in ``order`` with the one before it."""
    out = np.zeros(len(order), dtype=np.int64)
    alive = np.arange(1, len(order))
    wide = np.lib.stride_tricks.sliding_window_view(np.r_[raw, np.zeros(8, np.uint8)], 8)
    for d in range(0, depth, 8):
        step = min(8, depth - d)
        equal = wide[order[alive] + d, :step] == wide[order[alive - 1] + d, :step]
        whole = equal.all(axis=1)
        out[alive] = d + np.where(whole, step, np.argmin(equal, axis=1))
        alive = alive[whole]
    return out


def _engine(gid, doc, start, count, contexts, spec: Spec) -> np.ndarray:
    size = np.array([len(c) for c in contexts])
    at = np.cumsum(size + 1) - size - 1
    joined = np.frombuffer(b"\0".join([*contexts, b""]), dtype=np.uint8)
    text = joined.astype(np.uint16) + 1
    text[at + size] = 0
    row = np.repeat(np.arange(len(count)), count)
    place = at[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    wanted = np.zeros(len(text), dtype=bool)
    wanted[place] = True
    order = two_stage_sort(text, wanted, spec.window)
    prefix = common_prefixes(np.r_[joined, np.zeros(spec.window, np.uint8)], order, spec.window)
    # runs of equal windows: the earliest start of each stays
    window = np.empty(len(text), dtype=np.int64)
    window[place] = np.arange(len(row))
    w = window[order]
    own_doc, own_start = doc[row[w]], (start[row] + place - at[row])[w]
    run = np.cumsum(prefix < spec.window) - 1
    by = np.lexsort((own_start, own_doc, run))
    first = by[np.r_[True, run[by][1:] != run[by][:-1]]][run]
    hit = np.zeros(len(row), dtype=bool)
    hit[w] = (own_doc > own_doc[first]) | ((own_doc == own_doc[first]) & (own_start > own_start[first]))
    return hit


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Runs of windows (doc long, tag int, start int, count int): bytes start .. start + count + window - 2 are repeated."""
    return repeated_windows(docs, Spec("byte", window, gram, within=True), _engine)


def _strip(window: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, limit=800_000):
        out = []
        for doc, text, runs in zip(batch.column("doc").to_pylist(), unpack(batch.column("text")), batch.column("runs").to_pylist(), strict=True):
            gone = covered(runs, window, len(text)) if runs else np.zeros(0, bool)
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if runs else text
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if runs else 0
            out.append((None if doc == LAST_ID else doc, len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept if runs else None))
        cols = list(zip(*out, strict=True))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): ``kept`` holds the remaining bytes, null if all remain."""
    rows = with_flags(docs, repeated_spans(docs, window, gram))
    return rows.mapInArrow(lambda batches: _strip(window, batches), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
