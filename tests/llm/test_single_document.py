"""Operators that judge or write documents one by one: held-out accuracy, round trips and hard cases."""

import io
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldcast.llm import binary_tokens, files, hashing, langid, packing, tokens, toxicity, warc
from fieldcast.llm.common import LAST_ID, ship

from . import brute
from .fixtures import COLUMNS, hard_rows, hard_table

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(autouse=True)
def _ship(spark):
    ship(spark)


def test_language_of_held_out_rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = langid.identify(docs).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(truth) and {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_hard_rows(spark):
    got = langid.identify(hard_table(spark)).collect()
    assert len(got) == len(hard_rows())
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1, 2, 500, 502))
    assert by[600].lang_pred in ("en", "de") and not by[None].held_out
    assert langid.identify(hard_table(spark, [])).collect() == []
    assert {r.lang_pred for r in langid.identify(hard_table(spark).drop("lang").selectExpr("*", "CAST(NULL AS STRING) AS lang")).collect()} == {"und"}


def test_filters_hold_what_was_added_for_more_than_64_languages():
    filters = langid.Filters([f"l{i}" for i in range(70)])
    grams = hashing.mix(np.arange(1, 4001, dtype=np.uint64))
    for i in range(70):
        filters.add(i, grams[i * 40 : i * 40 + 60])
    masks = filters.masks(grams[: 70 * 40])
    for i in range(70):
        assert ((masks[i * 40 : i * 40 + 40, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).all()
    assert filters.false_rates().max() < 1e-6


def test_toxicity_on_rows_that_were_not_learned_from(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    learned, asked = labels.filter("doc_id % 3 <> 0"), labels.filter("doc_id % 3 = 0")
    truth = {r.doc_id: r.toxic for r in asked.collect()}
    got = [r for r in toxicity.classify(docs, learned).collect() if r.doc_id in truth]
    caught = sum(r.toxic for r in got if truth[r.doc_id])
    wrong = sum(r.toxic for r in got if not truth[r.doc_id])
    assert caught >= 0.8 * sum(truth.values()) and wrong <= 0.01 * len(got)


def test_toxicity_hard_rows(spark):
    labels = spark.createDataFrame([(i, i % 2, None if i == 5 else i % 3 == 0 and 1 or 0) for i in (3, 4, 5, 6, 7, 8, 9, 600)] + [(None, 1, 1), (3, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.classify(hard_table(spark), labels).collect()
    assert len(got) == len(hard_rows()) and all(0 <= r.p_toxic <= 1 and 0 <= r.p_quality <= 1 for r in got)
    assert not any(r.toxic for r in toxicity.classify(hard_table(spark), labels.limit(0)).collect())
    assert toxicity.classify(hard_table(spark, []), labels).collect() == []


def test_conflicting_labels_and_texts_have_one_outcome(spark):
    """Whatever the order of the rows, the fit is the same."""
    rows = [(i % 40, f"word{i % 7} text{i % 3} " * 5 + str(i), "en", "a", 1) for i in range(120)]
    said = [(i % 40, i % 2, int(i % 3 == 0)) for i in range(120)]
    results = []
    for seed in (1, 2):
        rnd = random.Random(seed)
        rnd.shuffle(rows)
        rnd.shuffle(said)
        docs = spark.createDataFrame(rows, COLUMNS).repartition(4)
        labels = spark.createDataFrame(said, "doc_id long, quality int, toxic int").repartition(3)
        results.append(sorted((r.doc_id, r.p_quality, r.p_toxic) for r in toxicity.classify(docs, labels).collect()))
    assert results[0] == results[1]


def test_chain_uses_what_came_before():
    """The second category follows the first; its model gets no word of its own to go by."""
    rnd = random.Random(1)
    first = [rnd.random() < 0.5 for _ in range(900)]
    texts = [((b"bad%d " % rnd.randrange(3)) if y else b"good ") + b"filler text" for y in first]
    labels = np.array([[y, y] for y in first], float)
    text, feature = toxicity.features(texts)
    rows = [feature[text == i].astype(np.int32) for i in range(900)]
    chain = toxicity.fit_chain(rows, labels, np.arange(900) % 3)
    assert chain[1].dense[0] > 0


def test_warc_round_trip_of_hard_rows(spark):
    long_, short = "x" * 1500, "y" * 20
    rows = [(1, "http://a", long_), (2, "http://b", long_), (5, "http://c", long_), (5, "http://c", long_), (3, None, None), (4, "u\r\nv", short), (6, "u", short), (None, "n", long_), (7, "é", "é" * 400 + "\r\n\r\nWARC/1.1\r\n"), (8, "big", "z" * 3_000_000), (None, "o", "q" * 1200), (None, "o", "q" * 1200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).selectExpr("*", "'x' AS payload", "'y' AS digest")
    got = warc.read_archives(warc.write_archives(pages)).collect()
    assert len(got) == len(rows)
    import hashlib
    for page, _, html in rows:
        data = (html or "").encode()
        mine = [r for r in got if r.page_id == page and r.payload_digest == hashlib.sha1(data).hexdigest()]
        assert mine and all(r.payload_bytes == len(data) for r in mine)
        for r in mine:
            revisit = html == long_ and page != 5
            assert (r.record_type, r.refers_to) == (("revisit", 5) if revisit else ("response", None))
            assert bytes(r.payload) == (b"" if revisit else data)
    assert warc.read_archives(warc.write_archives(pages.limit(0))).collect() == []


def test_warc_reader_finds_damage():
    good = warc.record(1, "u", b"payload", __import__("hashlib").sha1(b"payload").hexdigest(), None)
    assert [b for _, b in warc.records(io.BytesIO(good + good))] == [b"payload"] * 2
    with pytest.raises(ValueError, match="digest"):
        list(warc.records(io.BytesIO(warc.record(1, "u", b"payload", "0" * 40, None))))
    with pytest.raises(ValueError, match="cut off"):
        list(warc.records(io.BytesIO(good + good[:-12])))


def test_ids_equal_the_librarys(spark):
    texts = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").limit(150).collect()]
    texts += ["", "x’y​ <|endoftext|>", "  a  b \n\n c'd don't ''s !'s \t", "é\xa0b", "\x1c a", "¹² 12 a1", "İ À ﬁ", "a" * 5000, "é"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        want = brute.encoded(texts, name, 0)
        assert [ids.tolist() for ids in tokens.encode(texts, tokens.vocabulary(name))] == [w[:-1] for w in want]


def check_packing(rows, got):
    docs, sequences = {}, {}
    for r in got:
        docs.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    padding = 0
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 1024
        padding += 1024 - at
    for (doc, _), ids in zip(rows, brute.encoded([t for _, t in rows], "byte_bpe_50k.json", 0)):
        copies = rows.count((doc, next(t for d, t in rows if d == doc))) if doc is not None else 1
        pieces = {(r.start, r.length, r.ids_crc32) for r in docs[doc, len(ids)]}
        at = 0
        for start, length, crc in sorted(pieces):
            assert start == at and crc == brute.crc(ids[start : start + length])
            at += length
        assert at == len(ids) and len(docs[doc, len(ids)]) % max(copies, 1) == 0
    return padding / max(sum(r.length for r in got), 1)


def test_packing_of_hard_rows(spark):
    rows = [(r[0], r[1]) for r in hard_rows()]
    check_packing(rows, packing.pack(hard_table(spark)).collect())
    assert packing.pack(hard_table(spark, [])).collect() == []


def test_packing_leaves_little_padding(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert check_packing(rows, packing.pack(docs).collect()) < 0.005


def test_knapsack_and_plan():
    value, count = packing.knapsack(np.array([3, 5, 7]), np.array([0.3, 0.51, 0.9]), 10)
    assert value == pytest.approx(1.2) and count.tolist() == [1, 0, 1]
    histogram = {600: 10, 424: 10, 300: 7, 100: 25, 1: 3}
    held = {}
    for times, pattern in packing.plan(histogram, 1024):
        assert sum(n * c for n, c in pattern.items()) <= 1024
        for n, c in pattern.items():
            held[n] = held.get(n, 0) + times * c
    assert held == histogram


def test_token_files_of_hard_rows(spark):
    rows = [(r[0], r[1]) for r in hard_rows()]
    got = binary_tokens.read_files(binary_tokens.write_files(hard_table(spark))).collect()
    want, at = [], 0
    for (doc, _), ids in sorted(zip(rows, brute.encoded([t for _, t in rows], "word_bpe_49k.json", 2)), key=lambda x: (brute.order(x[0][0]), x[0][1] or "")):
        want.append((doc, at, len(ids), brute.crc(ids)))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert binary_tokens.read_files(binary_tokens.write_files(hard_table(spark, []))).collect() == []


def test_files_are_closed_at_a_size(spark):
    rnd = np.random.default_rng(2)
    rows = [(None if i % 3 else i, " ".join(map(str, rnd.integers(0, 50, rnd.integers(0, 40))))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    whole = sorted(map(tuple, binary_tokens.read_files(binary_tokens.write_files(docs)).collect()), key=lambda r: r[1])
    for limits, least in (({"file_ids": 500}, sum(r[2] for r in whole) // 700), ({"file_docs": 7}, 300 // 7), ({"file_ids": 1}, 300)):
        listed = binary_tokens.write_files(docs, **limits)
        assert listed.count() >= least
        assert sorted(map(tuple, binary_tokens.read_files(listed).collect()), key=lambda r: r[1]) == whole
    # a doc_id of most rows is not one range; small ranges would be put together
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        listed = binary_tokens.write_files(docs)
        assert listed.filter(F.col("first") == LAST_ID).count() > 1
        assert sorted(map(tuple, binary_tokens.read_files(listed).collect()), key=lambda r: r[1]) == whole
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_reader_decompresses_only_what_is_asked(tmp_path):
    path = str(tmp_path / "ids.zst")
    writer = binary_tokens.Writer(files.open_output(path), 2)
    rnd = np.random.default_rng(1)
    docs = [rnd.integers(0, 49_000, n).astype("<u4") for n in (100_000, 200_000, 5, 300_000, 1, 50_000)]
    for i, ids in enumerate(docs):
        writer.add(i, ids)
    writer.close()
    with files.open_input(path) as source:
        reader = binary_tokens.Reader(source)
        before = reader.frames_read
        assert reader.ids(4).tolist() == docs[4].tolist() and reader.frames_read == before + 1
        assert all(reader.ids(i).tolist() == ids.tolist() for i, ids in enumerate(docs))
    data = bytearray(open(path, "rb").read())
    data[50] ^= 1
    open(path, "wb").write(data)
    with files.open_input(path) as source, pytest.raises(Exception):
        binary_tokens.Reader(source).ids(0)
