"""Substring dedup by prefix-partitioned suffix trees (operator 9).

Suffixes are dealt out by variable-length prefixes (:mod:`.repeats`), so each
group of suffixes fits in memory.  A group's tree is built top-down: a node is
the set of suffixes that share its prefix; the next word splits it into its
children, and nodes of one suffix are leaves.  Internal nodes as deep as
``window`` words are the repeats; the smallest doc_id below a deep node keeps
its words, and every other document under it repeats them.

Null texts have no words; a null doc_id sorts after all others; rows of equal
doc_id do not remove words from each other, so repeated rows stay equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcast.llm import hashing as H
from fieldcast.llm.common import LAST_ID, chunks
from fieldcast.llm.repeats import Spec, repeated_windows, unpack, with_flags

#: Words in a window, and words in the grams that sample suffixes.
WINDOW, GRAM = 13, 6


def deep_nodes(symbols: np.ndarray, root: np.ndarray, first: np.ndarray, doc: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Grow the subtrees of suffixes symbols[first:first+depth] below their roots, a word at a time.

    Returns the suffixes under a node of that depth with two documents or
    more, and for each of them the node's smallest document."""
    alphabet = int(symbols.max(initial=0)) + 1
    alive, node = np.arange(len(first)), root
    for d in range(depth):
        child = node[alive] * alphabet + symbols[first[alive] + d]
        order = np.argsort(child, kind="stable")
        at = np.flatnonzero(np.r_[True, child[order][1:] != child[order][:-1]]) if len(order) else order
        below = doc[alive[order]]
        branching = np.minimum.reduceat(below, at) != np.maximum.reduceat(below, at) if len(at) else at.astype(bool)
        name = np.empty(len(order), dtype=np.int64)
        name[order] = np.repeat(np.arange(len(at)), np.diff(np.r_[at, len(order)]))
        keep = branching[name]
        node = np.empty(len(first), dtype=np.int64)
        node[alive] = name
        alive = alive[keep]
        if not len(alive):
            break
    _, name = np.unique(node[alive], return_inverse=True)
    least = np.full(name.max(initial=-1) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, name, doc[alive])
    return alive, least[name]


def _engine(gid, doc, start, count, contexts, spec: Spec) -> np.ndarray:
    buf, at = H.join_texts(contexts)
    begins, ends = H.word_spans(buf)
    _, symbols = np.unique(H.spans_hash(buf, begins, ends), return_inverse=True)
    row = np.repeat(np.arange(len(count)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    first = np.searchsorted(begins, at)[row] + nth
    _, root = np.unique(gid, return_inverse=True)
    hit = np.zeros(len(row), dtype=bool)
    alive, least = deep_nodes(symbols, root[row], first, doc[row], spec.window)
    hit[alive] = doc[row[alive]] > least
    return hit


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Runs of windows (doc long, tag int, start int, count int) of ``docs`` whose words start in a smaller doc_id too.

    Word start .. start + count + window - 2 of the document are repeated."""
    return repeated_windows(docs, Spec("word", window, gram, within=False), _engine)


def covered(runs: list | None, window: int, n: int) -> np.ndarray:
    """Mask of the units that the windows of the runs cover."""
    edge = np.zeros(n + 1, dtype=np.int64)
    for r in runs or ():
        edge[r["start"]] += 1
        edge[r["start"] + r["count"] + window - 1] -= 1
    return np.cumsum(edge[:-1]) > 0


def _strip(window: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, limit=800_000):
        out = []
        for doc, text, runs in zip(batch.column("doc").to_pylist(), unpack(batch.column("text")), batch.column("runs").to_pylist(), strict=True):
            words = text.split()
            gone = covered(runs, window, len(words)) if runs else None
            kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g) if runs else b" ".join(words)
            out.append((None if doc == LAST_ID else doc, len(words), int(gone.sum()) if runs else 0, hashlib.sha256(kept).hexdigest(), kept if runs else None, f"{hashlib.md5(text).hexdigest()}-{len(text)}"))
        cols = list(zip(*out, strict=True))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "text_key"])


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept, text_key): ``kept`` is the text of the words that stay, null if all do."""
    rows = with_flags(docs, repeated_spans(docs, window, gram))
    out = rows.mapInArrow(lambda batches: _strip(window, batches), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary, text_key string")
    return out.withColumn("kept", F.col("kept").cast("string"))
