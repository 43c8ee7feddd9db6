import numpy as np
from pyspark.sql import functions as F

from paperloom.operators import matching as M
from paperloom.operators import metrics, model


def test_training_equals_plain_gradient_descent(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 5, (300, 2)) / 4
    y = (x[:, 0] + rng.random(300) > 0.9).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y)], "a double, b double, label int")
    w, b = np.zeros(2), 0.0
    for _ in range(200):
        e = 1 / (1 + np.exp(-(x @ w + b))) - y
        w, b = w - 0.1 * x.T @ e / 300, b - 0.1 * e.mean()
    got, bias = model.train(df, ["a", "b"], epochs=200)
    assert np.allclose(got, w) and np.isclose(bias, b)
    coarse, _ = model.train(df, ["a", "b"], epochs=200, max_vectors=10)
    assert len(coarse) == 2
    assert model.train(df.limit(0), ["a", "b"]) == ([0.0, 0.0], 0.0)
    assert model.from_json(model.to_json(got, bias, ["a", "b"])) == (got, bias)


def test_number_of_vectors_does_not_change_the_weights(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(float(a), float(b), int(a + b > 1)) for a, b in rng.random((200, 2)).round(3)], "a double, b double, label int")
    w, b = model.train(df, ["a", "b"], epochs=4)
    large_w, large_b = model.train(df, ["a", "b"], epochs=4, max_vectors=10)
    assert np.allclose(w, large_w, rtol=1e-12) and np.isclose(b, large_b, rtol=1e-12)


def test_metrics_edges(spark):
    ranks = spark.createDataFrame([(1,), (2,), (None,), (9,)], "rank int")
    r = metrics.ranking_metrics(ranks).first()
    assert (r["n_queries"], r["mrr"], r["p_at_1"], r["p_at_3"]) == (4, 0.375, 0.25, 0.5)
    assert metrics.ranking_metrics(ranks.limit(0)).first()["mrr"] == 0.0
    none = spark.createDataFrame([(0, 0)], "label int, predicted int")
    assert metrics.classification_metrics(none, "label", "predicted").first()["f1"] == 0.0


def test_feature_edges(spark):
    bib = spark.createDataFrame([("p", "k", "", [], "", "", "")], "pub_id string, bib_key string, title string, authors array<string>, year string, arxiv_id string, raw_content string")
    ref = spark.createDataFrame([("p", 1, 0, "", "", [], "n.d.")], "pub_id string, ref_id int, ref_pos int, arxiv_id string, title string, authors array<string>, year string")
    f = M.with_features(M.banded_pairs(M.with_bib_side(bib), M.with_ref_side(ref))).first()
    assert f["arxiv_in_content"] == 1.0 and f["year_diff"] == 10.0 and f["title_len_ratio"] == 0.0 and f["combined_score"] == 0.0


def test_band_is_complete(spark):
    b = spark.range(200).select(F.lit("p").alias("pub_id"), F.col("id").alias("bib_key"), F.col("id").cast("int").alias("b_len"))
    r = spark.range(200).select(F.lit("p").alias("pub_id"), F.col("id").alias("ref_id"), F.col("id").cast("int").alias("r_len"))
    got = M.banded_pairs(b, r)
    assert got.count() == got.distinct().count() == sum(abs(i - j) <= 40 for i in range(200) for j in range(200))
    assert M.refs_in_band(b.where("b_len = 0"), r).count() == 41
