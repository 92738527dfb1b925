"""Finding repeated windows: the distributed frame of the two exact substring operators.

A window is ``window`` neighbouring units (bytes or words) of one document.
The frame brings together all windows that can be equal, in groups that fit
in memory, and leaves the sorting inside a group (a suffix array or a suffix
tree) to the operator:

1. ``_sampled``: every window names the least of its ``gram``-unit grams (a
   minimiser), so equal windows name equal grams.  One row per sampled suffix
   goes to the shuffle, about one unit in five (words) or forty (bytes).
2. ``_shared``: grams that only one place names cannot lie in a repeat; the
   others go back to their documents, as a table in the shared folder.
3. ``_contexts``: a document cuts out, around each shared gram, the units of
   the windows that name it.  They are dealt by the gram: a prefix of the
   sampled suffix.  A gram with more than ``hot`` suffixes is too large for
   one group: its prefix is extended to the whole window, and equal windows
   of a task meet before the shuffle, so that a passage which a third of all
   documents share sends one row per task and not one per document.
4. The operator's engine returns the runs of windows that start earlier
   elsewhere, as (doc, tag, start, count).

Nothing is dropped on the way: the first two steps leave out only windows
that have no equal.

Rows without a doc_id rank alike, after all others.  Until a row's contexts are
cut, each goes by a number of its own text (``spread_id``), so that many of
them are not one key of a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcast.llm import hashing as H
from fieldcast.llm.common import CHUNK_BYTES, LAST_ID, chunks, text_rows
from fieldcast.operators.util import materialize

#: Runs of repeated windows: units start .. start+count-1 of a text begin a window that starts earlier elsewhere.
FLAGS = "doc long, tag int, start int, count int"
#: Low two bits of a sampled row's key: a gram of one document; of CROWD documents or more of a chunk, all told
#: (with their number in place of a document); the pair of a document and such a gram; a gram twice in its document.
_ALONE, _CROWDED, _KNOWN, _TWICE = 0, 1, 2, 3
CROWD = 20
#: Rows that a crowded one stands for, at least, when suffixes are counted.
CROWD_WEIGHT = 100
_U = np.uint64


@dataclass(frozen=True)
class Spec:
    """What a window is.  unit: "byte" or "word".  within: whether a repeat inside one document counts."""

    unit: str
    window: int
    gram: int
    within: bool


class Units:
    """The units of some texts: hashes of their grams, and for each text its first unit."""

    def __init__(self, texts: list[bytes], spec: Spec):
        self.spec = spec
        if spec.unit == "byte":
            self.buf = np.frombuffer(b"".join(texts), dtype=np.uint8)
            self.first = np.zeros(len(texts) + 1, dtype=np.int64)
            np.cumsum([len(t) for t in texts], out=self.first[1:])
            self.grams = H.byte_grams(self.buf, spec.gram)
        else:
            self.buf, at = H.join_texts(texts)
            self.starts, self.ends = H.word_spans(self.buf)
            self.first = np.searchsorted(self.starts, at)
            self.grams = H.word_grams(H.spans_hash(self.buf, self.starts, self.ends), spec.gram)

    def anchored(self) -> tuple[np.ndarray, ...]:
        """Gram key, text number, first window and count of every run of windows with one anchor."""
        lengths = np.diff(self.first)
        number = np.maximum(lengths - self.spec.window + 1, 0)
        text = np.repeat(np.arange(len(lengths)), number)
        begin = np.cumsum(number) - number
        windows = np.arange(len(text)) - begin[text] + self.first[text]
        at, start, count = H.anchors(self.grams, self.spec.window - self.spec.gram + 1, windows)
        return self.grams[at] & ~_U(3), np.searchsorted(self.first, start, side="right") - 1, start, count

    def cut(self, start: int, stop: int) -> bytes:
        """Units start..stop-1 as bytes; words are parted by one space."""
        if self.spec.unit == "byte":
            return self.buf[start:stop].tobytes()
        lo, hi = self.starts[start], self.ends[stop - 1]
        return b" ".join(self.buf[lo:hi].tobytes().split())


def _sampled(spec: Spec):
    """(doc, text) -> (route, key, doc): one row per gram and document; grams of many documents of the chunk send one row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            doc = batch.column("doc").to_numpy()
            key, text, _, _ = Units(batch.column("text").to_pylist(), spec).anchored()
            if not len(key):
                continue
            key, owner = key.view(np.int64), doc[text]
            order = np.lexsort((owner, key))
            key, owner = key[order], owner[order]
            new_key = np.r_[True, key[1:] != key[:-1]]
            new_pair = new_key | np.r_[True, owner[1:] != owner[:-1]]
            group, pair = np.cumsum(new_key) - 1, np.cumsum(new_pair) - 1
            named = np.bincount(group, weights=new_pair).astype(np.int64)[group]
            crowded = named >= CROWD
            twice = (np.bincount(pair) > 1)[pair] & spec.within
            crowd, known, single = new_key & crowded, new_pair & crowded, new_pair & ~crowded
            route = np.r_[key[crowd], owner[known], key[single]]
            keys = np.r_[key[crowd] | _CROWDED, key[known] | _KNOWN, key[single] | np.where(twice[single], _TWICE, _ALONE)]
            docs = np.r_[named[crowd], owner[known], owner[single]]
            yield pa.RecordBatch.from_arrays([pa.array(route), pa.array(keys), pa.array(docs)], ["route", "key", "doc"])

    return run


def _shared(spec: Spec, hot: int):
    """Rows in the order of their keys -> (doc, key, hot) of grams that two places name; a crowded row only tells
    that its gram is hot, without a doc."""

    def told(key: np.ndarray, doc: np.ndarray, is_hot: np.ndarray, crowd: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(doc, mask=crowd), pa.array(key), pa.array(is_hot)], ["doc", "key", "hot"])

    def judge(key: np.ndarray, flag: np.ndarray, doc: np.ndarray, hot_key: int | None) -> pa.RecordBatch:
        new = np.r_[True, key[1:] != key[:-1]]
        at, group = np.flatnonzero(new), np.cumsum(new) - 1
        size = np.diff(np.r_[at, len(key)])
        shared = (np.maximum.reduceat(flag, at) > 0) | (size > 1 if spec.within else np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at))
        crowd = flag == _CROWDED
        is_hot = np.add.reduceat(np.where(crowd, np.maximum(doc, CROWD_WEIGHT), 1), at) > hot
        if hot_key is not None:
            is_hot |= key[at] == hot_key
        keep = np.where(crowd, is_hot[group], (shared | is_hot)[group])
        return told(key[keep], doc[keep], is_hot[group][keep], crowd[keep])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64)] * 3
        hot_key = None
        for batch in batches:
            key, doc = batch.column("key").to_numpy(), batch.column("doc").to_numpy()
            flag, key = key & 3, key & ~3
            known = flag == _KNOWN
            if known.any():
                yield told(key[known], doc[known], *np.zeros((2, known.sum()), bool))
            rest = [np.concatenate(x) for x in zip(rest, (key[~known], flag[~known], doc[~known]), strict=True)]
            if not len(rest[0]):
                continue
            last = int(rest[0][-1])
            cut = int(np.searchsorted(rest[0], last))  # the last key's rows may go on in the next batch
            if last == hot_key or len(rest[0]) - cut > hot:
                yield judge(*rest, hot_key)
                hot_key, rest = last, [x[:0] for x in rest]
            elif cut:
                yield judge(*(x[:cut] for x in rest), hot_key)
                rest = [x[cut:] for x in rest]
        if len(rest[0]):
            yield judge(*rest, hot_key)

    return run


def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as zstandard frames: a third of the bytes in the shuffles by document."""
    import zstandard

    press = zstandard.ZstdCompressor(level=1)
    for batch in chunks(batches, limit=8 * CHUNK_BYTES):
        packed = [press.compress(t) for t in batch.column("text").to_pylist()]
        yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(packed, pa.binary()))


def spread_id(doc_id: Column, text: Column) -> Column:
    """The doc_id, or for a null one a number near the end of its type, told by the text."""
    return F.coalesce(doc_id, F.lit(LAST_ID) - F.crc32(text))


def packed_texts(docs: DataFrame) -> DataFrame:
    return text_rows(docs).mapInArrow(pack, "doc long, text binary")


def unpack(column: pa.Array) -> list[bytes]:
    import zstandard

    press = zstandard.ZstdDecompressor()
    return [press.decompress(x) for x in column.to_pylist()]


def _contexts(spec: Spec, hot_keys):
    """(doc, text, keys) -> contexts; one of a chunk's equal hot windows goes on, the others come out with gid null."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = hot_keys.value
        for batch in chunks(batches, limit=400_000):
            texts, doc = unpack(batch.column("text")), batch.column("doc").to_numpy()
            doc = np.where(batch.column("unnamed").to_numpy(zero_copy_only=False), LAST_ID, doc)
            tags = _tags(texts)
            units = Units(texts, spec)
            key, text, start, count = units.anchored()
            if not len(key):
                continue
            keys = batch.column("keys")
            mine = np.repeat(np.arange(len(texts)), np.diff(keys.offsets.to_numpy()))
            wanted = keys.flatten().to_numpy().view(_U)
            # a gram is wanted if the pair (text, key) is on the list
            pair, listed = H.mix(key + text.astype(_U)), H.mix(wanted + mine.astype(_U))
            keep = np.isin(pair, listed)
            key, text, start, count = (x[keep] for x in (key, text, start, count))
            if not len(key):
                continue
            is_hot = np.isin(key.view(np.int64), hot)
            cold = np.flatnonzero(~is_hot)
            cuts = [units.cut(a, a + n + spec.window - 1) for a, n in zip(start[cold].tolist(), count[cold].tolist(), strict=True)]
            yield from _told(units, (key[cold] >> _U(1)).view(np.int64), doc, tags, text[cold], start[cold], count[cold], cuts)
            if is_hot.any():
                yield from _hot_windows(units, doc, tags, text[is_hot], start[is_hot], count[is_hot])

    return run


def _told(units: Units, gid, doc, tags, text, start, count, cuts: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Context rows.  Equal contexts of one text are one row: the others' starts go with it, or are decided if the first of them repeats them."""
    own = start - units.first[text]
    pair, size = np.unique(H.mix(gid.view(_U) + text.astype(_U)), return_inverse=True, return_counts=True)[1:]
    stays, others = np.ones(len(cuts), bool), {}
    first: dict[tuple[int, bytes], int] = {}
    for i in np.flatnonzero(size[pair] > 1).tolist():
        at = first.setdefault((int(text[i]), cuts[i]), i)
        if at != i:
            stays[i] = False
            others.setdefault(at, []).append(int(own[i]))
    keep = np.flatnonzero(stays)
    more = [others.get(i, ()) for i in keep.tolist()] if others and not units.spec.within else []
    yield _batch([gid[keep], doc[text[keep]], tags[text[keep]], own[keep], count[keep]], [cuts[i] for i in keep.tolist()] if others else cuts, more)
    if units.spec.within and others:
        yield _decided(doc[text[~stays]], tags[text[~stays]], own[~stays], count[~stays])


def _decided(doc, tag, start, count) -> pa.RecordBatch:
    return _batch([pa.nulls(len(doc), pa.int64()), doc, tag, start, count], [None] * len(doc))


_CONTEXT = "gid long, doc long, tag int, start int, count int, context binary, more array<int>"


def _batch(rows: list, cuts: list, more: list = ()) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
    lists = pa.array(more, pa.list_(pa.int32())) if more else pa.ListArray.from_arrays(pa.array(np.zeros(len(cuts) + 1, np.int32)), pa.array([], pa.int32()))
    columns = [x if isinstance(x, pa.Array) else pa.array(np.asarray(x), k) for x, k in zip(rows, kinds, strict=True)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(cuts, pa.binary()), lists], ["gid", "doc", "tag", "start", "count", "context", "more"])


def _hot_windows(units: Units, doc, tags, text, start, count) -> Iterator[pa.RecordBatch]:
    """Each window by itself, dealt by all its units; later equals of the chunk are decided here."""
    each = np.repeat(np.arange(len(start)), count)
    begin = np.repeat(np.cumsum(count) - count, count)
    at = start[each] + np.arange(len(each)) - begin
    owner, own_tag, own = doc[text[each]], tags[text[each]], at - units.first[text[each]]
    spec = units.spec
    cuts = np.empty(len(at), dtype=object)
    cuts[:] = [units.cut(a, a + spec.window) for a in at.tolist()]
    first: dict[bytes, tuple[int, int]] = {}
    for cut, d, p in zip(cuts, owner.tolist(), own.tolist(), strict=True):
        rank = (d, p if spec.within else 0)
        if cut not in first or rank < first[cut]:
            first[cut] = rank
    later = np.array([(d, p if spec.within else 0) > first[cut] for cut, d, p in zip(cuts, owner.tolist(), own.tolist(), strict=True)])
    one = np.ones(len(at), dtype=np.int32)
    gid = np.array([int.from_bytes(_digest(c), "little", signed=True) for c in cuts], dtype=np.int64)
    go = np.flatnonzero(~later)
    yield from _told(units, gid[go], doc, tags, text[each[go]], at[go], one[go], [cuts[i] for i in go.tolist()])
    if later.any():
        yield _decided(owner[later], own_tag[later], own[later], one[later])


def _digest(data: bytes) -> bytes:
    import xxhash

    return xxhash.xxh64_digest(data)


def _grouped(engine: Callable, spec: Spec, budget: int = 6_000_000):
    """Whole groups, many at a time -> FLAGS.

    Equal contexts hold equal windows, so one of them, the earliest, stands for
    all; groups with two contexts or more go to engine(gid, doc, start, count,
    contexts, spec), which returns for each window whether it starts earlier
    elsewhere."""

    def flagged(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        gid, doc, tag, start, count = (t.column(i).to_numpy() for i in range(5))
        contexts = t.column("context").to_pylist()
        number: dict[bytes, int] = {}
        same = np.fromiter((number.setdefault(c, len(number)) for c in contexts), dtype=np.int64, count=len(contexts))
        order = np.lexsort((start, doc, same))
        rep = order[np.r_[True, same[order][1:] != same[order][:-1]]]  # by number: the row of the earliest
        stands = rep[same]
        later = (doc > doc[stands]) | (spec.within & (doc == doc[stands]) & (start > start[stands]))
        # contexts with another one in their group
        _, group, size = np.unique(gid[rep], return_inverse=True, return_counts=True)
        sent = rep[size[group] > 1]
        begin = np.full(len(doc), -1)
        begin[sent] = np.cumsum(count[sent]) - count[sent]
        mask = engine(gid[sent], doc[sent], start[sent], count[sent], [contexts[i] for i in sent.tolist()], spec) if len(sent) else np.zeros(0, bool)
        # a row that is not later than its representative shares the representative's windows
        row = np.flatnonzero(later | (begin[stands] >= 0))
        each = np.repeat(row, count[row])
        nth = np.arange(len(each)) - np.repeat(np.cumsum(count[row]) - count[row], count[row])
        hit = later[each].copy()
        judged = begin[stands[each]] >= 0
        hit[judged] |= mask[begin[stands[each[judged]]] + nth[judged]]
        each, nth = each[hit], nth[hit]
        at = np.flatnonzero(np.r_[True, (each[1:] != each[:-1]) | (np.diff(nth) != 1)]) if len(each) else np.zeros(0, np.int64)
        length = np.diff(np.r_[at, len(each)])
        each, nth = each[at], nth[at]
        # the other starts of a context share its windows' fate
        lists = t.column("more")
        others, values = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
        if len(values):
            again = np.repeat(np.arange(len(each)), others[each])
            place = np.arange(len(again)) - np.repeat(np.cumsum(others[each]) - others[each], others[each]) + (np.cumsum(others) - others)[each[again]]
            begin = np.r_[start[each], values[place]]
            each, nth, length = (np.r_[x, x[again]] for x in (each, nth, length))
        else:
            begin = start[each]
        return pa.RecordBatch.from_arrays([pa.array(doc[each]), pa.array(tag[each]), pa.array((begin + nth).astype(np.int32)), pa.array(length.astype(np.int32))], ["doc", "tag", "start", "count"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            gid = batch.column("gid")
            decided = np.flatnonzero(gid.is_null().to_numpy(zero_copy_only=False))
            if len(decided):  # nulls sort first
                done = batch.take(pa.array(decided))
                yield pa.RecordBatch.from_arrays([done.column(n) for n in ("doc", "tag", "start", "count")], ["doc", "tag", "start", "count"])
                batch = batch.slice(len(decided))
                if not batch.num_rows:
                    continue
            for piece in chunks([batch], "context", budget):
                g = piece.column("gid").to_numpy()
                cut = int(np.searchsorted(g, g[-1])) if size > budget else 0
                if size > budget and (cut or held[-1].column("gid")[-1].as_py() != g[-1]):
                    yield flagged([*held, piece.slice(0, cut)])
                    held, size, piece = [], 0, piece.slice(cut)
                held.append(piece)
                size += piece.nbytes
        if held:
            yield flagged(held)

    return run


def repeated_windows(docs: DataFrame, spec: Spec, engine: Callable, hot: int | None = None) -> DataFrame:
    """FLAGS of every window of ``docs`` (doc_id, text) that also starts earlier.

    ``hot``: suffixes with one prefix that a group may hold.  By default 5,000
    or a ten-thousandth of the documents, so the list of longer prefixes, which
    is broadcast, stays near a million entries at any size."""
    spark = docs.sparkSession
    ids, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(spread_id(ids, text).alias("doc"), text.alias("text"), ids.isNull().alias("unnamed"))
    if hot is None:
        hot = max(5_000, docs.count() // 10_000)
    sampled = rows.drop("unnamed").mapInArrow(_sampled(spec), "route long, key long, doc long")
    shared = materialize(sampled.repartition("route").sortWithinPartitions("key").select("key", "doc").mapInArrow(_shared(spec, hot), "doc long, key long, hot boolean"), "shared")
    hot_keys = np.array([r.key for r in shared.filter("hot").select("key").distinct().toLocalIterator()], dtype=np.int64)
    told = spark.sparkContext.broadcast(hot_keys)
    keys = shared.filter("doc IS NOT NULL").groupBy("doc").agg(F.collect_set("key").alias("keys"))
    packed = rows.mapInArrow(pack, "doc long, text binary, unnamed boolean")
    contexts = packed.join(keys, "doc").mapInArrow(_contexts(spec, told), _CONTEXT)
    # decided rows (gid null) only pass through: deal them by document
    dealt = contexts.repartition(F.coalesce("gid", F.xxhash64("doc", "start"))).sortWithinPartitions("gid")
    return dealt.mapInArrow(_grouped(engine, spec), FLAGS)


def _tags(texts: list[bytes]) -> np.ndarray:
    return np.array([zlib.crc32(t) for t in texts], dtype=np.uint32).view(np.int32)


def _pack_tagged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        tag = pa.array(_tags(batch.column("text").to_pylist()))
        packed = next(pack([batch]))
        yield pa.RecordBatch.from_arrays([packed.column("doc"), tag, packed.column("text")], ["doc", "tag", "text"])


def with_flags(docs: DataFrame, flags: DataFrame) -> DataFrame:
    """(doc, text, runs): every row of ``docs``, packed text, with its runs (start, count) or null."""
    runs = flags.groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "count")).alias("runs"))
    texts = text_rows(docs).mapInArrow(_pack_tagged, "doc long, tag int, text binary")
    return texts.join(runs, ["doc", "tag"], "left").select("doc", "text", "runs")
