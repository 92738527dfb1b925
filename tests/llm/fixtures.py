"""Small tables with the hard cases: nulls, empty and very long texts, ties, repeated rows, clashing column names."""

from __future__ import annotations

import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Further columns with the names that operators use inside.
CLASHING = ("doc", "row", "words", "term", "node", "tag", "start", "key", "gid", "line", "kept", "text_key", "length", "offset", "_kept", "_crc", "_id", "_key")


def prose(rnd: random.Random, n: int, alphabet: int = 400) -> str:
    return " ".join(rnd.choice(("Ab", "cé", "dö", "e", "fg", "H")) + str(rnd.randrange(alphabet)) for _ in range(n))


def hard_rows(seed: int = 1, many: int = 30) -> list[tuple]:
    rnd = random.Random(seed)
    passage, line = prose(rnd, 60), "This line is on Every page, No 7."
    rows = [(1, None, "en", "a", 0), (2, "", None, "a", 0), (None, passage, "de", None, None), (None, None, None, None, None)]
    base = prose(rnd, 150)
    for i in range(3, 3 + many):
        kind = i % 6
        text = {0: base, 1: base + " tail" + str(i), 2: prose(rnd, 40) + "\n" + passage + "\n" + prose(rnd, 20), 3: (prose(rnd, 8) + "\n") * 6, 4: prose(rnd, rnd.randrange(1, 90)) + "\n" + line, 5: "x y " * i}[kind]
        rows.append((i, text, "en" if kind < 3 else "de", "a" if i % 3 else None, len(text)))
    rows.append((500, " \t\n ", "en", "a", 4))
    rows.append((501, "one", "en", "a", 3))
    rows.append((502, "!!! ### |", "en", "a", 9))
    rows.append((600, prose(rnd, 40_000) + passage, "en", "b", None))
    rows += rows[5:8]  # repeated rows
    return rows


def hard_table(spark, rows: list[tuple] | None = None):
    df = spark.createDataFrame(hard_rows() if rows is None else rows, COLUMNS).repartition(3)
    for name in CLASHING:
        df = df.selectExpr("*", f"'x' AS {name}")
    return df


def compare(got, rows, want, columns):
    """got: collected rows with doc_id; want: {row number: tuple}; as multisets of (doc_id, values)."""
    a = sorted(repr((r["doc_id"], *(r[c] for c in columns))) for r in got)
    b = sorted(repr((rows[n][0], *values)) for n, values in want.items())
    assert a == b, [x for x in zip(a, b) if x[0] != x[1]][:3]
