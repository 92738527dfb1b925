"""Benchmark decontamination by a distributed positional inverted index (operator 8), in DataFrame functions only.

* ``build_index`` stores the postings (row, position, term) of the training
  texts for every term of the test items, as a table in the shared folder.
* For every window of an item, the two terms with the fewest postings are
  looked up.  A posting at position p of the item's q-th word says that the
  item may lie at p - q: the offset-adjusted lists of the rare terms are
  intersected, and only what is left is compared with the other lists.
* A run of ``window`` matched words is an exact match of a phrase; an item of
  fewer words is one phrase.  ``proximity_matches`` returns places where the
  rare terms of an item stand near each other in any order.

Null texts have no words.  Rows are judged one by one (a posting names its
row), so repeated rows and null doc_ids keep their own results.  Items without
words never match; a null item_id marks hits but is not listed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldcast.llm.common import let, text_key
from fieldcast.operators.util import materialize

#: Words in a window.
WINDOW = 10
#: Rows up to which a lookup table is broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: What parts words before A-Z are lowered.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lowered(word: Column) -> Column:
    """A-Z in lower case and nothing else; the plain function is right for words of ASCII only."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def _words(text: Column) -> Column:
    """Words in their own case."""
    return let(F.split(F.coalesce(text, F.lit("")), BREAK), lambda w: F.filter(w, lambda x: x != ""))


def small(df: DataFrame) -> DataFrame:
    """The table with a hint to broadcast it, if it has been counted to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


@dataclass(frozen=True)
class Index:
    """postings (row, pos, term) of the items' terms; rows (row, doc_id, n_words, text_key); items (item, item_id, q, term, n_terms)."""

    postings: DataFrame
    rows: DataFrame
    items: DataFrame


def build_index(docs: DataFrame, items: DataFrame) -> Index:
    listed = items.select("item_id", F.transform(_words(F.col("text")), _lowered).alias("words")).filter(F.size("words") > 0).distinct()
    # the number of an item, and of a term, is its hash: equal in every evaluation
    listed = listed.select(F.xxhash64("item_id", "words").alias("item"), "item_id", F.size("words").alias("n_terms"), F.posexplode("words").alias("q", "word"))
    listed = materialize(listed.withColumn("term", F.xxhash64("word")), "items")
    # every row also has the empty word, in front, so that no row is without postings
    terms = listed.select("word", "term").distinct().union(docs.sparkSession.sql("SELECT '' AS word, CAST(0 AS BIGINT) AS term"))
    texts = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text_key(F.col("text")).alias("text_key"), _words(F.col("text")).alias("words"))
    places = texts.select("row", "doc_id", "text_key", F.size("words").cast("long").alias("n_words"), F.posexplode(F.concat(F.array(F.lit("")), F.col("words"))).alias("pos", "word"))
    found = places.withColumn("word", _lowered(F.col("word"))).join(small(materialize(terms, "terms")), "word")
    first = F.col("pos") == 0
    stored = materialize(found.select("row", *(F.when(first, F.col(c)).alias(c) for c in ("doc_id", "n_words", "text_key")), (F.col("pos") - 1).alias("pos"), "term"), "postings")
    return Index(stored.filter("pos >= 0").select("row", "pos", "term"), stored.filter("pos < 0").select("row", "doc_id", "n_words", "text_key"), listed)


def rare_slots(index: Index, window: int = WINDOW) -> DataFrame:
    """(item, q, term, need): the two words with the fewest postings of every window of every item; need: how many of them must agree."""
    lists = index.postings.groupBy("term").agg(F.count("*").alias("length"))
    sized = materialize(index.items.join(lists, "term", "left").select("item", "q", "term", "n_terms", F.coalesce("length", F.lit(0)).alias("length")), "sized")
    width = F.least("n_terms", F.lit(window))
    starts = F.sequence(F.greatest(F.lit(0), F.col("q") - width + 1), F.least(F.col("q"), F.col("n_terms") - width))
    each = sized.withColumn("start", F.explode(starts))
    order = F.row_number().over(Window.partitionBy("item", "start").orderBy("length", "q"))
    # a window with a word that no document has cannot occur
    can = F.min("length").over(Window.partitionBy("item", "start")) > 0
    chosen = each.select("item", "q", "term", "n_terms", order.alias("nth"), can.alias("can")).filter("can AND nth <= 2")
    return chosen.select("item", "q", "term", F.least("n_terms", F.lit(2)).alias("need")).distinct()


def _alignments(index: Index, slots: DataFrame) -> DataFrame:
    """(row, item, at): places where an item may begin, by the intersection of its rare terms' offset-adjusted lists."""
    adjusted = index.postings.join(small(materialize(slots, "slots")), "term").select("row", "item", (F.col("pos") - F.col("q")).alias("at"), "need")
    return adjusted.groupBy("row", "item", "at").agg(F.count("*").alias("agree"), F.first("need").alias("need")).filter("agree >= need").select("row", "item", "at")


def exact_matches(index: Index, window: int = WINDOW) -> DataFrame:
    """(row, item_id, pos): every document word inside an occurrence of a window."""
    aligned = materialize(_alignments(index, rare_slots(index, window)), "aligned")
    wanted = aligned.join(small(index.items), "item").select("row", "item", "item_id", "at", "n_terms", "q", "term", (F.col("at") + F.col("q")).alias("pos"))
    near = index.postings.join(small(materialize(aligned.select("row").distinct(), "near")), "row", "left_semi")
    matched = wanted.join(near, ["row", "pos", "term"])
    run = Window.partitionBy("row", "item", "at").orderBy("q")
    islands = matched.withColumn("island", F.col("q") - F.row_number().over(run))
    length = F.count("*").over(Window.partitionBy("row", "item", "at", "island"))
    return islands.withColumn("length", length).filter(F.col("length") >= F.least("n_terms", F.lit(window))).select("row", "item_id", "pos")


def proximity_matches(index: Index, window: int = WINDOW, slack: int = 5) -> DataFrame:
    """(doc_id, item_id, pos, agree): places where two or more rare terms of an item stand within ``slack`` of their places in it."""
    slots = rare_slots(index, window)
    adjusted = index.postings.join(small(materialize(slots, "slots")), "term").select("row", "item", (F.col("pos") - F.col("q")).alias("at"), "q")
    near = Window.partitionBy("row", "item").orderBy("at").rangeBetween(0, slack)
    agree = adjusted.withColumn("agree", F.size(F.collect_set("q").over(near))).filter("agree >= 2")
    ids = index.items.select("item", "item_id").distinct()
    return agree.join(ids, "item").join(index.rows.select("row", "doc_id"), "row").groupBy("doc_id", "item_id", F.greatest("at", F.lit(0)).alias("pos")).agg(F.max("agree").alias("agree"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, text_key."""
    index = build_index(docs, items)
    hits = exact_matches(index, window)
    per_row = hits.groupBy("row", "pos").agg(F.collect_set("item_id").alias("ids")).groupBy("row").agg(F.count("*").alias("n_hit"), F.array_distinct(F.flatten(F.collect_set("ids"))).alias("ids"))
    out = index.rows.join(per_row, "row", "left")
    ids = F.coalesce(F.array_sort(F.transform("ids", lambda i: i.cast("string"))), F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", ids).cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "text_key")
