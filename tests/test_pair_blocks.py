import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.operators import matching as M
from paperloom.operators import metrics, model, pair_blocks
from paperloom.plans import files
from paperloom.plans import matching as plans

KEYS = ["pub_id", "bib_key", "ref_id", "ref_pos", "r_arxiv"]
COLUMNS = [*KEYS, *M.FEATURES]


@pytest.fixture(scope="module")
def sides(spark):
    """Empty and very long titles, letters outside the first plane, years that are none, repeated and empty names, ids inside raw texts, a
    publication without candidates and one without entries."""
    long = "word " * 40
    bib = spark.createDataFrame(
        [("p", "a", "", [], "", "", ""), ("p", "b", "On the 漢字 of 𝔘nicode graphs", ["A. Roe", "A. Roe", "Dr."], "2001", "2411.00222", "see 2411.00222"), ("p", "c", long, None, "n.d.", "", "x" * 300),
         ("p", "d", "Graphs, graphs and graphs", ["J. Li"], "2003", "", "arXiv:1001.00001 2411.0022"), ("q", "a", "One", ["B"], "1999", "", ""), ("only", "a", "One", [], "", "", ""), (None, "a", "One", [], "", "", "")],
        "pub_id string, bib_key string, title string, authors array<string>, year string, arxiv_id string, raw_content string")
    ref = spark.createDataFrame(
        [("p", 1, 0, "", "", [], "n.d."), ("p", 2, 1, "2411-00222", "The 漢字 of 𝔘nicode graph", ["Roe"], "2001"), ("p", 3, 2, "1001-00001", long + "more", ["", "Roe"], "2004"), ("p", 4, 3, "2411-00222", "graphs", ["J. Li", "A. Roe"], ""),
         ("p", 5, 4, "9", "A" * 63 + " b", [], "2003"), ("q", 1, 0, "", "Two", ["B"], "1998"), ("none", 1, 0, "", "Two", [], ""), (None, 1, 0, "", "One", [], "")],
        "pub_id string, ref_id long, ref_pos int, arxiv_id string, title string, authors array<string>, year string")
    return M.with_bib_side(bib), M.with_ref_side(ref)


def _rows(df):
    return sorted(map(tuple, df.select(COLUMNS).collect()))


def test_f3_blocks_equal_the_columns(sides):
    b, r = sides
    assert _rows(pair_blocks.feature_pairs(b, r)) == _rows(M.with_features(M.banded_pairs(b, r)))
    assert _rows(pair_blocks.feature_pairs(b, r, None)) == _rows(M.with_features(b.join(r, "pub_id")))
    assert pair_blocks.feature_pairs(b.limit(0), r).count() == pair_blocks.feature_pairs(b, r.limit(0)).count() == 0


def test_f3_rounds_as_spark_does(spark):
    x = [0.0078125, 0.0000005, 1.0000005, 0.1234565, 0.1234564999999999, 1 / 3, 2 / 3, 10.0, 0.0, 0.6640625, *np.random.default_rng(0).integers(0, 2**20, 300) / 2**20]
    want = [r[0] for r in spark.createDataFrame([(float(v),) for v in x], "x double").select(F.round("x", 6)).collect()]
    assert pair_blocks.rounded(np.array(x), 6).tolist() == want


def _large(spark, entries=600, candidates=2300):
    bib = spark.range(entries).selectExpr("'p' AS pub_id", "'k' || id AS bib_key", "substr(repeat(md5(cast(id as string)), 4), 1, cast(20 + id % 90 as int)) AS title", "array('A. ' || id % 7) AS authors", "cast(2000 + id % 9 as string) AS year", "'' AS arxiv_id", "'1001.' || lpad(id, 5, '0') AS raw_content")
    ref = spark.range(candidates).selectExpr("'p' AS pub_id", "id AS ref_id", "cast(id as int) AS ref_pos", "'1001-' || lpad(id, 5, '0') AS arxiv_id", "substr(repeat(md5(cast(id as string)), 4), 1, cast(20 + id % 80 as int)) AS title", "array('A. ' || id % 5, 'B') AS authors", "cast(2000 + id % 8 as string) AS year")
    return M.with_bib_side(bib), M.with_ref_side(ref)


def test_f3_a_large_publication_lies_in_many_blocks(spark):
    b, r = _large(spark)
    rows = pair_blocks.blocks(b, r)
    sizes = rows.groupBy("pub_id", "pb").agg(F.count_if(F.col("side") == 0).alias("b"), F.count_if(F.col("side") == 1).alias("r")).collect()
    assert len(sizes) == 3 and max(x["b"] for x in sizes) < 1.5 * pair_blocks.ENTRIES and {x["r"] for x in sizes} == {2300}
    got, want = pair_blocks.feature_pairs(b, r).select(COLUMNS), M.with_features(M.banded_pairs(b, r)).select(COLUMNS)
    assert got.count() == want.count() and not got.exceptAll(want).count()


def test_f3_edit_distances_of_any_length():
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("ab 漢𝔘"), n)) for n in (0, 0, 1, 2, 63, 64, 65, 127, 128, 129, 200, 64, 40)]

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[:], i
            for j, y in enumerate(b, 1):
                row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
        return row[-1]

    x, y = (z.ravel() for z in np.meshgrid(np.arange(len(texts)), np.arange(len(texts))))
    assert pair_blocks._Titles(texts).distances(x, y).tolist() == [plain(texts[i], texts[j]) for i, j in zip(x, y)]


def test_f4_the_best_are_never_left_out(spark):
    b, r = _large(spark, 300, 400)
    rank = lambda rows: sorted(map(tuple, M.top_candidates(rows.withColumn("s", F.round(M.logistic(F.col("z")), 9)), "s", 5).select("bib_key", "ref_id", "rank").collect()))
    every, some = (pair_blocks.feature_pairs(b, r, None, [], best, M.DEFAULT_WEIGHTS) for best in (None, (5, M.DEFAULT_WEIGHTS, True)))
    assert rank(every) == rank(some) and some.count() < every.count() / 4


def test_f5_ranks_as_the_window_does(spark):
    b, r = _large(spark, 300, 400)
    rank = lambda rows: sorted(map(tuple, rows.select("bib_key", "ref_id", "rank").collect()))
    window = M.top_candidates(M.with_features(M.banded_pairs(b, r)).withColumn("s", F.round("combined_score", 9)), "s", 50)
    assert rank(pair_blocks.feature_pairs(b, r, features=[], best=plans._BEST50)) == rank(window)


def test_f13_weighted_sum_is_the_score(sides):
    b, r = sides
    p = lambda rows, c: sorted(map(tuple, rows.select(*KEYS, c.alias("p")).collect()))
    assert p(pair_blocks.feature_pairs(b, r, None, [], None, M.DEFAULT_WEIGHTS), M.logistic(F.col("z"))) == p(M.with_features(b.join(r, "pub_id")), M.probability())


def test_f7_f8_f12_moments_by_tasks(spark, sides):
    for b, r in (sides, _large(spark, 100, 120)):
        rows = M.with_features(M.banded_pairs(b, r)).select(M.FEATURES).collect()
        x = np.array([[row[f] for f in M.FEATURES] for row in rows])
        found = pair_blocks.pair_moments(b, r, 0.7)
        for row in metrics.feature_statistics(found, M.FEATURES).collect():
            own = x[:, M.FEATURES.index(row["feature"])]
            assert np.allclose(list(row)[1:], [own.mean(), own.std(), own.min(), own.max()], atol=1e-6)
        corr = metrics.correlations(found, M.FEATURES).collect()
        assert len(corr) == 144
        for a, c, value in corr:
            u, v = x[:, M.FEATURES.index(a)], x[:, M.FEATURES.index(c)]
            assert (value is None) if u.std() == 0 or v.std() == 0 else np.isclose(value, np.corrcoef(u, v)[0, 1], atol=1e-6)
        assert metrics.label_correlations(found, M.FEATURES, "label").count() == 12
    nothing = pair_blocks.pair_moments(sides[0].limit(0), sides[1], 0.7)
    assert metrics.feature_statistics(nothing, M.FEATURES).count() == 0 and metrics.correlations(nothing, M.FEATURES).where("corr is null").count() == 144


def test_f11_histogram_counts_every_pair_once(spark):
    b, r = _large(spark, 100, 120)
    h = metrics.histograms(pair_blocks.pair_values(b, r, 0.7), "label")
    n = M.banded_pairs(b, r).count()
    assert {x["n"] for x in h.groupBy("feature").agg(F.sum("n").alias("n")).collect()} == {n}
    assert h.where("feature = 'arxiv_match'").agg(F.max("bucket")).first()[0] == 1


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Publications by split, one listed nowhere."""
    root = str(tmp_path_factory.mktemp("tables"))
    pubs = spark.range(6).selectExpr("'p' || id AS pub_id")
    pubs.where("pub_id <> 'p5'").selectExpr("pub_id", "CASE pub_id WHEN 'p1' THEN 'valid' WHEN 'p2' THEN 'test' WHEN 'p3' THEN 'train' END AS split_name").write.parquet(f"{root}/publications.parquet")
    n = pubs.join(spark.range(8))
    n.selectExpr("id AS entry_id", "pub_id", "'k' || id AS bib_key", "'Title ' || substr(md5(cast(id as string)), 1, 12) AS title", "'A. Roe' AS authors", "'2001' AS pub_year", "'' AS arxiv_id", "'' AS raw_content").write.parquet(f"{root}/bib_entries.parquet")
    n.selectExpr("id AS ref_id", "pub_id", "cast(id as int) AS ref_pos", "'1001-0000' || id AS arxiv_id", "'Title ' || substr(md5(cast(id as string)), 1, 12) AS title", "array('A. Roe') AS authors", "'2001-01-01' AS submission_date").write.parquet(f"{root}/ref_entries.parquet")
    spark.createDataFrame([("p1", "k1", "1001-00002", True)], "pub_id string, bib_key string, arxiv_id string, is_match boolean").write.parquet(f"{root}/labeled_pairs.parquet")
    return root


def test_f6_f14_pairs_of_one_part_only(spark, tables):
    every = plans._pair_labels(spark, tables)
    for part, pubs in (("valid", {"p1"}), ("test", {"p2"}), ("train", {"p0", "p3", "p4", "p5"})):
        got = plans._pair_labels(spark, tables, part)
        assert {x[0] for x in plans._pubs_of(spark, tables, part).collect()} == pubs
        assert sorted(map(tuple, got.select("pub_id", "bib_key", "ref_id", "label").collect())) == sorted(map(tuple, every.where(F.col("part") == part).select("pub_id", "bib_key", "ref_id", "label").collect()))


def test_f5_loss_of_the_whole(spark, tables):
    rows = plans._pair_labels(spark, tables).withColumn("p", M.probability())
    assert plans.bce_loss(spark, tables).first()[0] == round(rows.agg(metrics.log_loss(F.col("label"), F.col("p"))).first()[0], 6)


def test_f9_sink_holds_every_pair(spark, tables):
    assert files.features_sink_rt(spark, tables).count() == M.banded_pairs(plans._bib(spark, tables), plans._ref(spark, tables)).count() == 6 * 64


def test_f14_f2_f10_all_epochs_in_one_stage(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(float(a), float(b), int(a + b > 1)) for a, b in rng.random((300, 2))], "a double, b double, label int")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    w, b = model.train(df, ["a", "b"], epochs=200, max_vectors=10)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before < 20
    small_w, small_b = model.train(df, ["a", "b"], epochs=200)
    assert np.allclose(w, small_w, rtol=1e-9) and np.isclose(b, small_b, rtol=1e-9)


def test_rounding_of_the_sink_is_that_of_spark(spark):
    import random

    from paperloom.plans.files import _rounded

    rng = random.Random(3)
    some = [0.0, -0.0, 0.000005, 0.000015, 1.000005, 49.999995, 2.675005, -0.000015, 1e300, 123456789012.000005, float("nan"), float("inf"), None]
    some += [float(np.float32(rng.random())) for _ in range(3000)] + [float(np.float32((2 * rng.randrange(10**5) + 1) / 2e5)) for _ in range(1000)] + [(2 * rng.randrange(10**7) + 1) / 2e5 for _ in range(1000)]
    rows = spark.createDataFrame([(x,) for x in some], "x double").select(F.round("x", 5).cast("string").alias("a"), _rounded(F.col("x"), 5).cast("string").alias("b"))
    assert rows.where("not (a <=> b)").collect() == []
    # F.round is there for the few near a half only
    assert "CASE WHEN" in rows._jdf.queryExecution().optimizedPlan().toString()
