"""Language identification by bit-sliced Bloom filters of character n-grams (operator 1).

All languages' Bloom filters lie side by side: a slot of the table is a mask
with one bit per language.  The AND of an n-gram's slots is the mask of all
languages whose filter holds it.  For a text the set bits are counted per
language; a filter answers yes by mistake at a known rate, its share of set
slots to the power of the hash functions, and the counts are corrected for
it.  The language with the largest corrected count is the answer.

The filters are learned from a bounded sample of labelled rows
(``TRAIN_DOCS`` per language, taken by a hash of doc_id); every row is judged
by its whole text.  A text that is null or has no letter gives ``und`` with
score 0, as does every text if nothing could be learned; a text of which no
n-gram is known gives the commonest language with score 0.  Rows are judged
one by one, so repeated rows and null doc_ids just repeat.  A null doc_id
counts as not held out, and is not learned from.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldcast.llm import hashing as H
from fieldcast.llm.common import chunks

#: Code points in an n-gram; labelled rows to learn from and n-grams to keep, per language.
GRAM, TRAIN_DOCS, KEPT_GRAMS = 4, 4_000, 40_000
#: A language holds an n-gram if its rate there is at least this part of the highest rate.
RATIO = 4
#: Slots of the table (a power of two) and hash functions.
SLOT_BITS, HASHES = 20, 3
_U = np.uint64


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def text_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit n-grams of lower-cased texts with all else than letters as spaces, their text's number, and whether a text has letters."""
    padded = [f" {t.lower()}  " for t in texts]
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    is_letter = _letters()[points]
    code = np.where(is_letter, points, 0).astype(_U)
    text = np.repeat(np.arange(len(texts)), [len(p) for p in padded])
    n = max(len(code) - GRAM + 1, 0)
    gram, some = np.zeros(n, dtype=_U), np.zeros(n, dtype=bool)
    for j in range(GRAM):
        gram = (gram << _U(16)) ^ (gram >> _U(48)) ^ code[j : j + n]
        some |= is_letter[j : j + n]
    keep = some & (text[:n] == text[GRAM - 1 : GRAM - 1 + n])
    return gram[keep], text[:n][keep], np.bincount(text, weights=is_letter, minlength=len(texts)) > 0


def _slots(grams: np.ndarray) -> list[np.ndarray]:
    """The table slots of each n-gram, one array per hash function."""
    h = H.mix(grams + _U(1))
    return [((h >> _U(j * SLOT_BITS)) & _U((1 << SLOT_BITS) - 1)).astype(np.int64) for j in range(HASHES)]


class Filters:
    """Bloom filters of some languages, bit-sliced: words[slot, language // 64] has the languages' bits."""

    def __init__(self, languages: list[str]):
        self.languages = languages
        self.words = np.zeros((1 << SLOT_BITS, max(1, -(-len(languages) // 64))), dtype=_U)

    def add(self, language: int, grams: np.ndarray) -> None:
        for slots in _slots(grams):
            self.words[slots, language // 64] |= _U(1) << _U(language % 64)

    def masks(self, grams: np.ndarray) -> np.ndarray:
        first, *others = _slots(grams)
        out = self.words[first]
        for slots in others:
            out &= self.words[slots]
        return out

    def false_rates(self) -> np.ndarray:
        return np.array([((self.words[:, i // 64] >> _U(i % 64)) & _U(1)).mean() ** HASHES for i in range(len(self.languages))])


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, gram, n), summed over the chunk."""
    for batch in chunks(batches):
        lang = batch.column("lang").dictionary_encode()
        grams, text, _ = text_grams(batch.column("text").to_pylist())
        code = lang.indices.to_numpy()[text]
        for i, name in enumerate(lang.dictionary.to_pylist()):
            found, n = np.unique(grams[code == i], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


def learn(rows: DataFrame, train_docs: int = TRAIN_DOCS) -> tuple[Filters, str | None]:
    """Filters from labelled rows (doc_id, text, lang), and the language of most of them."""
    known = rows.filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    filters = Filters(sorted(sizes))
    if not sizes:
        return filters, None
    share = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, train_docs / n))))
    part = F.pmod(F.xxhash64("doc_id", F.lit("learn")), F.lit(1_000_000)) < 1_000_000 * share[F.col("lang")]
    counts = known.filter(part).select("lang", "text").mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).filter("n >= 3")
    # rates by the sample's own totals, so that a language with few rows counts as much
    rated = counts.withColumn("rate", F.col("n") / F.sum("n").over(Window.partitionBy("lang")))
    own = rated.withColumn("most", F.max("rate").over(Window.partitionBy("gram"))).filter(RATIO * F.col("rate") >= F.col("most"))
    top = own.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("nth") <= KEPT_GRAMS)
    kept = top.select("lang", "gram").toPandas()
    for lang, grams in kept.groupby("lang")["gram"]:
        filters.add(filters.languages.index(lang), grams.to_numpy(np.int64).view(_U))
    return filters, max(sizes, key=lambda k: (sizes[k], k))


def _decide(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters, commonest = shared.value
        rates = filters.false_rates()
        for batch in chunks(batches, limit=1_000_000):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            grams, text, lettered = text_grams(texts)
            total = np.bincount(text, minlength=len(texts))
            masks = filters.masks(grams)
            best, found = np.zeros(len(texts)), np.full(len(texts), -1)
            for i, rate in enumerate(rates):
                bits = (masks[:, i // 64] >> _U(i % 64)) & _U(1)
                count = np.bincount(text, weights=bits, minlength=len(texts))
                corrected = np.maximum(count - total * rate, 0) / max(1 - rate, 1e-9)
                better = corrected > best
                best[better], found[better] = corrected[better], i
            name = [(filters.languages[i] if i >= 0 else commonest) if has and commonest else "und" for i, has in zip(found.tolist(), lettered.tolist(), strict=True)]
            score = np.where(found >= 0, np.minimum(best / np.maximum(total, 1), 1.0), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(name, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; learned from the rows that are not held out."""
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", third.alias("third"))
    learned = learn(rows.filter("third <> 1"))
    shared = docs.sparkSession.sparkContext.broadcast(learned)
    asked = rows.select("doc_id", F.coalesce(F.col("third") == 1, F.lit(False)).alias("held_out"), "text")
    return asked.mapInArrow(_decide(shared), "doc_id long, held_out boolean, lang_pred string, score double")
