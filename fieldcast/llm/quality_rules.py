"""Quality rules with cross-document line frequency (operator 3), in DataFrame functions only.

Base rules look at one text: word, symbol, line and repetition figures.  The
method looks across documents: each line is normalised and hashed, distinct
documents per host (``source``) are counted for each line, lines above the
limits are boilerplate and taken away, and a document that is depleted by it
is rejected.

A text is not boilerplate because it was copied, and removing copies is for
the dedup operators.  So equal sets of lines have one vote in these counts, of
a line and of its host, and texts without lines have none.  Near copies have
few: a text of which at least ``NEAR`` words in a hundred stand in lines that
``LINE_DOCS`` texts of its host share is taken for a copy of them, and all such
texts with the same least shared line vote once.  Only texts with content of
their own prove that a line is boilerplate.

A null text is empty: no words, no lines, ``base_failed``.  A null source is a
host of its own.  Rows are judged one by one, so repeated rows repeat in the
result, also under a null doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcast.llm.common import let, text_key
from fieldcast.operators.util import materialize

#: What parts words, and the symbols that are counted.
SPACES, WORD_BREAK, NOT_SYMBOLS = " \t\n\x0b\x0c\r", r"[\x20\x09-\x0D]+", r"[^#*$%&|<>]+"
#: Base limits: fewest words, and the most repeated words in a hundred.
MIN_WORDS, MAX_REPEATED = 50, 50
#: A line is boilerplate on a host if it has this many votes, and this part in a thousand of the host's.
LINE_DOCS, LINE_PERMILLE = 20, 50
#: A document with this many words in a hundred in shared lines is a near copy: it votes with its like.
NEAR = 80
#: A document of which less than this many words in a hundred remain is depleted.
MIN_LEFT = 50


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_BREAK))


def _repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that the text has twice or more, by sorting (window hash, place) pairs."""
    n = F.size(words)

    def from_sorted(pairs: Column) -> Column:
        same = lambda i, j: F.get(pairs, i)["h"] == F.get(pairs, j)["h"]
        again = F.filter(pairs, lambda p, i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
        places = F.array_sort(F.transform(again, lambda p: p["i"]))
        # union of [place, place + 3): each place adds three words less what the last one covered
        return F.aggregate(places, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")), lambda s, i: F.struct((s["n"] + F.least(F.lit(3), i - s["last"])).alias("n"), i.alias("last")), lambda s: s["n"])

    windows = F.transform(F.slice(words, 1, F.greatest(n - 2, F.lit(0))), lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))
    return F.when(n < 3, F.lit(0).cast("long")).otherwise(let(F.array_sort(windows), from_sorted))


def base_figures(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""

    def figures(words: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.regexp_replace(text, WORD_BREAK, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(text, NOT_SYMBOLS, "")).cast("long").alias("n_symbols"),
            let(lines, lambda each: F.size(each) - F.size(F.array_distinct(each))).cast("long").alias("n_dup_lines"),
            _repeated_words(words).alias("n_repeat_words"),
        )

    return let(words_of(text), figures)


def line_rows(text: Column) -> Column:
    """Array of (line hash, words) of the text's distinct normalised lines: lower case, digits as 0, single spaces."""

    def hashed(line: Column) -> Column:
        flat = F.regexp_replace(F.btrim(F.lower(line), F.lit(SPACES)), WORD_BREAK, " ")
        name = F.conv(F.left(F.md5(F.regexp_replace(flat, "[0-9]", "0")), F.lit(15)), 16, 10).cast("long")
        return F.struct(name.alias("line"), (F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit(""))) + 1).cast("long").alias("words"))

    return F.transform(F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")), hashed)


def judge(docs: DataFrame, line_docs: int = LINE_DOCS, line_permille: int = LINE_PERMILLE, min_left: int = MIN_LEFT) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_line_words, kept, text_key."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # a row's number ties its lines to it: two rows of one doc_id stay two
    figures = docs.select("doc_id", "source", text_key(text).alias("text_key"), base_figures(text).alias("f"), line_rows(text).alias("lines"))
    rows = materialize(figures.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", "text_key", "f.*", "lines"), "lines")
    host = F.coalesce(F.xxhash64("source"), F.lit(0)).alias("host")
    told = rows.select(host, F.array_distinct("lines").alias("lines"))
    copy = F.xxhash64(F.sort_array(F.transform("lines", lambda x: x["line"]))).alias("copy")
    apart = materialize(told.select("host", copy, F.inline("lines")).distinct(), "sets")
    shared = materialize(apart.groupBy("host", "line").agg(F.count("*").alias("docs")).filter(F.col("docs") >= line_docs).select("host", "line"), "shared")
    met = F.col("met").isNotNull()
    marked = apart.join(shared.withColumn("met", F.lit(True)), ["host", "line"], "left").groupBy("host", "copy").agg(F.sum("words").alias("words"), F.sum(F.when(met, F.col("words"))).alias("others"), F.min(F.when(met, F.col("line"))).alias("least"))
    alike = 100 * F.coalesce("others", F.lit(0)) >= NEAR * F.col("words")
    votes = materialize(marked.select("host", "copy", alike.alias("alike"), F.when(alike, F.col("least")).otherwise(F.col("copy")).alias("vote")), "votes")
    hosts = votes.select("host", "alike", "vote").distinct().groupBy("host").agg(F.count("*").alias("host_votes"))
    cast = apart.join(shared, ["host", "line"], "left_semi").select("host", "line", "copy").join(votes, ["host", "copy"])
    common = cast.select("host", "line", "alike", "vote").distinct().groupBy("host", "line").agg(F.count("*").alias("votes")).filter(F.col("votes") >= line_docs)
    common = common.join(hosts, "host").filter(1000 * F.col("votes") >= line_permille * F.col("host_votes")).select("host", "line")
    lines = rows.select("row", host, F.explode("lines").alias("l")).select("row", "host", "l.*")
    gone = lines.join(materialize(common, "common"), ["host", "line"]).groupBy("row").agg(F.sum("words").alias("gone"))
    out = rows.drop("lines", "source").join(gone, "row", "left")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("gone", F.lit(0))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), F.coalesce("gone", F.lit(0).cast("long")).alias("n_line_words"), (~failed & (100 * left >= min_left * F.col("n_words"))).alias("kept"), "text_key")
