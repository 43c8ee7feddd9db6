from paperloom.llm import format_duplicates as D

SCHEMA = "dref_id bigint, all_keys array<string>, raw_content string, class_id int, n_copies int"
BASE = "J. Doe, R. Roe. A Long-Range View of Things, Journal of Lattices, vol. 4, no. 12, pp. 33-71, 2010."


def classes(spark, records):
    rows = [(i, keys, text, 0, 0) for i, (keys, text) in enumerate(records)]
    out = {r["dref_id"]: (r["class_id"], r["n_copies"]) for r in D.record_classes(spark.createDataFrame(rows, SCHEMA), "dref_id", "raw_content", "all_keys").collect()}
    return [out[i] for i in range(len(records))]


def same(spark, a, b):
    (x, n), (y, _) = classes(spark, [(["k"], a), (["k"], b)])
    return x == y and n == 2


def test_formatting_does_not_matter(spark):
    for other in (
        BASE.upper(), BASE.replace(". ", "; ").replace(", ", ";  "), BASE.replace("Long-Range", "Long Range"), BASE.replace("Things", "Thi- ngs"), "\n" + BASE.replace("-71", "–71").replace("2010", "(2010)"),
        '"A Long-Range View of Things", J Doe, R Roe, Journal of Lattices, 2010, pp. 33 - 71, vol.4, no. 12', "A Long-Range View of Things; J. Doe; R. Roe; Journal of Lattices; 2010; no. 12; vol. 4; pp. 33-71",
    ):
        assert same(spark, BASE, other), other


def test_another_word_number_or_value_matters(spark):
    for other in (BASE.replace("33-71", "3-371"), BASE.replace("vol. 4, no. 12", "vol. 12, no. 4"), BASE.replace("Things", "Thing"), BASE.replace("J. Doe, R. Roe", "R. Roe, J. Doe"), BASE.replace("2010", "2011"), BASE.replace("View of Things", "Things of View")):
        assert not same(spark, BASE, other), other


def test_bibtex_fields_in_any_order(spark):
    a = "@article{doe2010, author = {J. Doe and R. Roe}, title = {A View}, volume = {4}, number = {12}, pages = {33-71}}"
    assert same(spark, a, '@ARTICLE{DOE2010,\n NUMBER = "12", PAGES="33–71",\n TI\nTLE={{A VIEW}},VOLUME={4}, AUTHOR={J Doe and R Roe},\n}')
    assert not same(spark, a, a.replace("volume = {4}, number = {12}", "volume = {12}, number = {4}"))


def test_keys_nulls_blanks_and_repeats(spark):
    got = classes(spark, [(["a1", "B-2"], BASE), (["b2", " A:1"], BASE), (["a1"], BASE), (None, BASE), ([], BASE), (["k"], None), (["k"], ""), (["k"], " . ")])
    assert got == [(0, 2), (0, 2), (2, 1), (3, 2), (3, 2), (5, 1), (6, 1), (7, 1)]
    twice = spark.createDataFrame([(1, ["k"], BASE, 0, 0), (1, ["k"], BASE, 0, 0), (None, ["k"], BASE, 0, 0)], SCHEMA)
    assert [tuple(r) for r in D.record_classes(twice, "dref_id", "raw_content", "all_keys").collect()] == [(1, 1, 1)]
    assert D.record_classes(twice.limit(0), "dref_id", "raw_content", "all_keys").count() == 0


def test_pairs_of_large_classes_are_whole(spark, monkeypatch):
    monkeypatch.setattr(D, "PAIR_BLOCK", 7)
    members = spark.createDataFrame([("c", i, 40) for i in range(40)] + [("d", 100, 1)], "class_id string, id int, n_copies int")
    pairs = D.class_pairs(members, "id", "a", "b")
    assert pairs.count() == pairs.distinct().count() == 40 * 39 // 2
