"""Brute-force versions of the llm operators, for small fixtures."""

from __future__ import annotations

import hashlib
import re
import zlib

SPACES = "[\x20\x09-\x0D]+"


def words(text):
    return [w for w in re.split(SPACES, text or "") if w]


def order(doc_id):
    return float("inf") if doc_id is None else doc_id


def byte_repeats(rows, window=100):
    """{row number: (n_bytes, n_removed, n_spans, kept_sha256)}"""
    first = {}
    data = [(t or "").encode() for _, t in rows]
    for (i, _), b in zip(rows, data):
        for p in range(len(b) - window + 1):
            w = b[p : p + window]
            first[w] = min(first.get(w, (float("inf"), 10**9)), (order(i), p))
    out = {}
    for n, ((i, _), b) in enumerate(zip(rows, data)):
        gone = bytearray(len(b))
        for p in range(len(b) - window + 1):
            if first[b[p : p + window]] < (order(i), p):
                gone[p : p + window] = b"\1" * window
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[n] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def word_repeats(rows, window=13):
    """{row number: (n_words, n_removed, kept_sha256)}"""
    first = {}
    split = [words(t) for _, t in rows]
    for (i, _), ws in zip(rows, split):
        for p in range(len(ws) - window + 1):
            k = tuple(ws[p : p + window])
            first[k] = min(first.get(k, float("inf")), order(i))
    out = {}
    for n, ((i, _), ws) in enumerate(zip(rows, split)):
        gone = [False] * len(ws)
        for p in range(len(ws) - window + 1):
            if first[tuple(ws[p : p + window])] < order(i):
                gone[p : p + window] = [True] * window
        kept = " ".join(w for w, g in zip(ws, gone) if not g)
        out[n] = (len(ws), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def shingles(text, n=5):
    ws = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(ws) < n:
        return frozenset([tuple(ws)] if ws else [])
    return frozenset(tuple(ws[i : i + n]) for i in range(len(ws) - n + 1))


def near_classes(rows):
    """{row number: (n_shingles, component_id)}; all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is None or rows[b][0] is None:
                continue
            both = len(sets[a] & sets[b])
            same = rows[a][0] == rows[b][0]
            if same or both and 100 * both >= 80 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[find(n)] = min(least.get(find(n), i), i)
    return {n: (len(sets[n]), least[find(n)] if i is not None else None) for n, (i, _) in enumerate(rows)}


def base_figures(text):
    t = text or ""
    ws = words(t)
    lines = [x for x in t.split("\n") if words(x)]
    where = {}
    for p in range(len(ws) - 2):
        where.setdefault(tuple(ws[p : p + 3]), []).append(p)
    covered = {p + o for ps in where.values() if len(ps) > 1 for p in ps for o in range(3)}
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def lowered(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def contamination(rows, items, window=10):
    """{row number: (n_words, n_hit, n_items, items_sha256, contaminated)}"""
    out = {}
    for n, (_, text) in enumerate(rows):
        ws = lowered(text)
        hit, found = set(), set()
        for item_id, t in items:
            it = lowered(t)
            k = min(window, len(it))
            if not k:
                continue
            grams = {tuple(it[q : q + k]) for q in range(len(it) - k + 1)}
            for p in range(len(ws) - k + 1):
                if tuple(ws[p : p + k]) in grams:
                    hit.update(range(p, p + k))
                    if item_id is not None:
                        found.add(str(item_id))
        out[n] = (len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def crc(ids):
    import numpy as np

    return zlib.crc32(np.array(ids, "<u4").tobytes())


def encoded(texts, name, end):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [t.encode(x or "", add_special_tokens=False).ids + [end] for x in texts]
