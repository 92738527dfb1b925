"""Operators that compare documents, against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from fieldcast.llm import decontam, jaccard_join, quality_rules, repeats, suffix_array, suffix_tree
from fieldcast.llm.common import ship

from . import brute
from .fixtures import COLUMNS, compare, hard_rows, hard_table, prose


@pytest.fixture(autouse=True)
def _ship(spark):
    ship(spark)


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


@pytest.mark.parametrize("module, want, columns", [
    (suffix_array, brute.byte_repeats, ("n_bytes", "n_removed", "n_spans", "kept_sha256")),
    (suffix_tree, brute.word_repeats, ("n_words", "n_removed", "kept_sha256")),
])
@pytest.mark.parametrize("hot", [None, 2])
def test_repeats(spark, monkeypatch, module, want, columns, hot):
    rows = hard_rows(many=24)
    plain = repeats.repeated_windows
    monkeypatch.setattr(module, "repeated_windows", lambda docs, spec, engine: plain(docs, spec, engine, hot))
    got = module.remove_repeats(hard_table(spark, rows)).collect()
    compare(got, rows, want(pairs(rows)), columns)


@pytest.mark.parametrize("module, want, columns", [
    (suffix_array, brute.byte_repeats, ("n_bytes", "n_removed", "n_spans", "kept_sha256")),
    (suffix_tree, brute.word_repeats, ("n_words", "n_removed", "kept_sha256")),
])
def test_repeats_of_many_rows_without_a_doc_id(spark, module, want, columns):
    rnd = random.Random(3)
    passages = [prose(rnd, 30) for _ in range(4)]
    rows = [(None if i % 3 else i, rnd.choice(passages) + " " + prose(rnd, rnd.randrange(12)) + " " + rnd.choice(passages)) for i in range(90)]
    rows += [(None, prose(rnd, 14))] * 2 + [(2**63 - 5, passages[0]), (None, passages[1]), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    compare(module.remove_repeats(docs).collect(), rows, want(rows), columns)


def test_crowded_rows_tell_their_documents():
    spec = repeats.Spec("word", 13, 6, within=False)
    text = " ".join(map(str, range(13))).encode()
    batch = pa.RecordBatch.from_arrays([pa.array(range(500), pa.int64()), pa.array([text] * 500, pa.binary())], ["doc", "text"])
    sampled = pa.Table.from_batches(repeats._sampled(spec)([batch])).sort_by("key").select(["key", "doc"]).combine_chunks().to_batches()
    for hot, want in ((499, True), (500, False)):
        told = pa.Table.from_batches(repeats._shared(spec, hot)(sampled)).to_pylist()
        assert {r["doc"] for r in told if r["doc"] is not None} == set(range(500))
        assert any(r["hot"] for r in told) == want


@pytest.mark.parametrize("module", [suffix_array, suffix_tree])
def test_repeats_of_no_rows(spark, module):
    assert module.remove_repeats(hard_table(spark, [])).collect() == []


def test_two_stage_sort_is_the_order_of_the_suffixes():
    rnd = np.random.default_rng(5)
    for size in (1, 2, 50, 400):
        raw = rnd.integers(97, 100, size).astype(np.uint8)
        text = np.r_[raw.astype(np.uint16) + 1, 0].astype(np.uint16)
        wanted = np.r_[np.ones(size, bool), False]
        order = suffix_array.two_stage_sort(text, wanted, size)
        data = raw.tobytes()
        assert order.tolist() == sorted(range(size), key=lambda i: data[i:])
        prefix = suffix_array.common_prefixes(np.r_[raw, np.zeros(40, np.uint8)], order, 16)
        for k in range(1, size):
            a, b = data[order[k] :], data[order[k - 1] :]
            common = next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert min(prefix[k], 16) == min(common, 16)


def test_deep_nodes_are_the_repeats():
    symbols = np.array([1, 2, 3, 9, 1, 2, 3, 4, 1, 2, 4])
    alive, least = suffix_tree.deep_nodes(symbols, np.zeros(3, np.int64), np.array([0, 4, 8]), np.array([7, 5, 6]), 3)
    assert sorted(zip(alive.tolist(), least.tolist())) == [(0, 5), (1, 5)]


def test_jaccard_join(spark):
    rows = hard_rows(many=24)
    rows += [(700 + k, " ".join(f"w{i}" for i in range(100 + k)), "en", "a", 1) for k in range(12)]  # a chain of links
    rows += [(800, " ".join(f"v{i}" for i in range(13)), "en", "a", 1), (801, " ".join(f"v{i}" for i in range(11)), "en", "a", 1)]  # 7 of 9 shared
    rows += [(810, " ".join(f"u{i}" for i in range(14)), "en", "a", 1), (811, " ".join(f"u{i}" for i in range(12)), "en", "a", 1)]  # 8 of 10: linked
    got = jaccard_join.near_duplicate_classes(hard_table(spark, rows)).collect()
    compare(got, rows, brute.near_classes(pairs(rows)), ("n_shingles", "component_id"))


def test_jaccard_join_with_frequent_shingles_and_salts(spark, monkeypatch):
    import random

    rnd = random.Random(3)
    base, line = prose(rnd, 60).split(), prose(rnd, 9)
    rows = []
    for i in range(60):  # near copies of one text: some link, some do not
        text = list(base)
        for _ in range(rnd.randrange(3)):
            text[rnd.randrange(len(text))] = f"new{i}"
        rows.append((i, " ".join(text), "en", "a", 1))
    rows += [(100 + i, prose(rnd, 4) + " " + line, "en", "a", 1) for i in range(20)]
    monkeypatch.setattr(jaccard_join, "FREQUENT", 5)
    got = jaccard_join.near_duplicate_classes(spark.createDataFrame(rows, COLUMNS).repartition(4)).collect()
    compare(got, rows, brute.near_classes(pairs(rows)), ("n_shingles", "component_id"))


def test_jaccard_join_of_no_rows(spark):
    assert jaccard_join.near_duplicate_classes(hard_table(spark, [])).collect() == []


def test_quality_rules(spark):
    rows = hard_rows()
    got = quality_rules.judge(hard_table(spark, rows)).collect()
    want = {n: brute.base_figures(t) for n, (_, t) in enumerate(pairs(rows))}
    compare(got, rows, {n: (*f, f[0] < 50 or 100 * f[4] > 50 * f[0]) for n, f in want.items()}, ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
    assert all(not (r.kept and r.base_failed) for r in got)
    assert quality_rules.judge(hard_table(spark, [])).collect() == []


def test_line_frequency_rejects_depleted_documents_and_spares_copies(spark):
    import random

    rnd = random.Random(2)
    menu = "\n".join(prose(rnd, 12) for _ in range(6))
    rows = [(i, menu + "\n" + prose(rnd, 30), "en", "shop", 1) for i in range(20)]  # mostly the menu of the host
    rows += [(100 + i, menu + "\n" + prose(rnd, 200), "en", "shop", 1) for i in range(5)]  # own text prevails
    rows += [(200 + i, menu + "\n" + prose(rnd, 30), "en", "once", 1) for i in range(2)]  # rare on its host
    article = "\n".join(prose(rnd, 15) for _ in range(8))
    rows += [(300 + i, article, "en", "shop", 1) for i in range(30)]  # copies are one document
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, COLUMNS), line_docs=10, line_permille=20).collect()}
    assert not any(got[i].kept for i in range(20)) and got[0].n_line_words == 72
    assert all(got[i].kept for i in (*range(100, 105), 200, 201, *range(300, 330)))


def test_copies_and_empty_texts_do_not_hide_the_boilerplate_of_a_host(spark):
    import random

    rnd = random.Random(4)
    menu = "\n".join(prose(rnd, 12) for _ in range(6))
    rows = [(i, menu + "\n" + prose(rnd, 30), "en", "shop", 1) for i in range(401)]
    rows += [(10_000 + i, rows[0][1], "en", "shop", 1) for i in range(7_999)]
    rows += [(20_000 + i, (None, "", " \n ")[i % 3], "en", "shop", 1) for i in range(600)]
    got = quality_rules.judge(spark.createDataFrame(rows, COLUMNS)).collect()
    assert len(got) == len(rows) and not any(r.kept for r in got)
    assert all(r.n_line_words == 72 for r in got if r.doc_id < 20_000)


def near_copies(rnd, n, lines=20):
    """n texts, each with a word of another line of the first one changed."""
    base = [prose(rnd, 12) for _ in range(lines)]
    new = lambda i: "new" + "".join(chr(97 + int(c)) for c in str(i))
    return ["\n".join(" ".join([*line.split()[:-1], new(i)]) if k == i % lines else line for k, line in enumerate(base)) for i in range(n)]


def test_near_copies_are_no_boilerplate(spark):
    import random

    import duckdb

    from fieldcast.llm import sql

    rnd = random.Random(8)
    rows = [(100 + i, text, "en", "news", 1) for i, text in enumerate(near_copies(rnd, 60))]
    rows += [(1000 + i, "\n".join(prose(rnd, 12) for _ in range(20)), "en", "news", 1) for i in range(300)]
    menu = "\n".join(prose(rnd, 12) for _ in range(6))
    rows += [(2000 + i, menu + "\n" + prose(rnd, 30), "en", "shop", 1) for i in range(400)]
    rows += [(5000 + i, text, "en", "shop", 1) for i, text in enumerate(near_copies(rnd, 3000))]
    rows += [(9000 + i, text, "en", None, 1) for i, text in enumerate(near_copies(rnd, 30, 3))]
    rows += hard_rows()
    docs = spark.createDataFrame(rows, COLUMNS)
    got = quality_rules.judge(docs).drop("text_key").toPandas()
    of = dict(zip(got.doc_id, got.kept))
    assert all(of[i] for i in (*range(100, 160), *range(1000, 1300), *range(5000, 8000)))
    assert not any(of[i] for i in range(2000, 2400))
    documents = docs.toPandas()  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    want = con.sql(sql.ORACLE["op3_line_frequency_rules"]).df()[list(got.columns)]
    assert sorted(map(repr, got.astype(str).values.tolist())) == sorted(map(repr, want.astype(str).values.tolist()))


def items_table(spark, items):
    return spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' AS words", "'y' AS term")


def test_decontamination(spark):
    rows = hard_rows()
    text = rows[6][1].split()
    items = [(1, " ".join(text[3:25])), (2, "ONE"), (3, None), (4, "!!"), (10, " ".join(rows[-4][1].split()[39_990:])), (None, " ".join(text[30:45])), (5, "x y x y x y x y x y x y"), (5, "x y x y x y x y x y x y"), (6, "word that nobody has at all in any of these texts")]
    got = decontam.contamination(hard_table(spark, rows), items_table(spark, items)).collect()
    compare(got, rows, brute.contamination(pairs(rows), items), ("n_words", "n_hit", "n_items", "items_sha256", "contaminated"))
    assert any(r.contaminated for r in got) and not all(r.contaminated for r in got)


def test_decontamination_of_no_rows(spark):
    some = items_table(spark, [(1, "a b c")])
    assert decontam.contamination(hard_table(spark, []), some).collect() == []
    none = decontam.contamination(hard_table(spark), items_table(spark, [])).collect()
    assert len(none) == len(hard_rows()) and not any(r.contaminated for r in none)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "alpha x x gamma"), (3, "delta " + "x " * 50 + "alpha")], "doc_id long, text string")
    index = decontam.build_index(docs, items_table(spark, [(9, "alpha beta gamma delta")]))
    near = {r.doc_id for r in decontam.proximity_matches(index, slack=3).collect()}
    assert 1 in near and 3 not in near
