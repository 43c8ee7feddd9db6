import pytest
from pyspark.sql import functions as F

from paperloom.operators.packed_values import NAMES, REFERENCES, unpack

CASES = [
    ("Jane Doe", ["Jane Doe"]),
    ("Doe, Jane", ["Doe, Jane"]),
    ("Doe, Jane and Roe, Richard", ["Doe, Jane", "Roe, Richard"]),
    ("J. Doe, R. Roe & B. Poe", ["J. Doe", "R. Roe", "B. Poe"]),
    ("Doe, J., Roe, R. S., Poe, B.", ["Doe, J.", "Roe, R. S.", "Poe, B."]),
    ("Doe, J.;Roe, R.", ["Doe, J.", "Roe, R."]),
    ("Jane Doe|Richard Roe|", ["Jane Doe", "Richard Roe"]),
    ("Jane Doe / Richard Roe et al.", ["Jane Doe", "Richard Roe"]),
    ("Doe J\tRoe R", ["Doe J", "Roe R"]),
    ("Jane Doe\nRichard Roe and others", ["Jane Doe", "Richard Roe"]),
    ('"Doe, J.", "Roe, R."', ["Doe, J.", "Roe, R."]),
    ("'Doe, J.'; 'Roe, R.'", ["Doe, J.", "Roe, R."]),
    (r"Jane Z{\'i}ma, Kurt G{\"o}del", [r"Jane Z{\'i}ma", r"Kurt G{\"o}del"]),
    ("Doe, E. & KUR Collaboration & Balm, U. A.", ["Doe, E.", "KUR Collaboration", "Balm, U. A."]),
    ("The X Coll., Jane Doe, and Richard Roe", ["The X Coll.", "Jane Doe", "Richard Roe"]),
    ("S&ouml;ren Doe &amp; Bo Roe", ["S&ouml;ren Doe", "Bo Roe"]),
    ("", []),
    ("   ", []),
    (None, []),
    ("; ; ;", []),
]


def values(spark, rows, schema, fields):
    df = spark.createDataFrame(rows, schema)
    out = {}
    for r in unpack(df, "entry_id", fields).orderBy("entry_id", "field_name", "pos").collect():
        out.setdefault((r["entry_id"], r["field_name"]), []).append(r["value"])
    return out


def test_names(spark):
    got = values(spark, [(i, a) for i, (a, _) in enumerate(CASES)], "entry_id bigint, authors string", {"authors": NAMES})
    for i, (text, want) in enumerate(CASES):
        assert got.get((i, "authors"), []) == want, text


def test_references(spark):
    a, b = "A. Doe, B. Roe. A title; with a part. Journal, 3:1-9, 2001.", "C. Poe: Other (a) and (b). In: Journal, 1-2 (2002)"
    cases = [
        (a, [a]), (f"{a[:-1]}; {b}", [a[:-1], b]), (f"(a) {a} (b) {b}", [a, b]), (f"[1] {a} [2] {b}", [a, b]), (f"{a}\n{b}", [a, b]), (f"{b}; see also {a}", [b, a]),
        (f'"{a}", "{b}"', [a, b]), ('"A. Doe, ""Quoted,"" J, 2001.", "B. Roe. T. J, 2002."', ['A. Doe, "Quoted," J, 2001.', "B. Roe. T. J, 2002."]), ("A. Doe,\nB. Roe. Title. J, 2001.", ["A. Doe,; B. Roe. Title. J, 2001."]), ("", []), (None, []),
    ]
    got = values(spark, [(i, t) for i, (t, _) in enumerate(cases)], "entry_id bigint, raw_content string", {"raw_content": REFERENCES})
    for i, (text, want) in enumerate(cases):
        assert got.get((i, "raw_content"), []) == want, text


def test_repeats_extra_columns_empty_and_long(spark):
    long = "; ".join(f"J. Doe{i}" for i in range(3000))
    rows = [(1, long, 7, "x"), (1, long, 7, "x"), (2, "A. B", 7, "x")]
    df = spark.createDataFrame(rows, "entry_id bigint, authors string, pos int, value string")
    out = unpack(df, "entry_id", {"authors": NAMES})
    assert out.where("entry_id = 1").count() == 3000
    assert out.where("entry_id = 1").agg(F.max("pos")).first()[0] == 3000
    assert unpack(df.limit(0), "entry_id", {"authors": NAMES}).count() == 0
