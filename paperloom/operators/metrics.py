"""Evaluation and description of matches: ranking metrics, classification metrics, feature statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranking_metrics(truth_ranks: DataFrame, group: list[str] | None = None, k: int = 5) -> DataFrame:
    """(rank or null per query) -> n_queries, mrr, p_at_1, p_at_3, p_at_5. A truth outside the first k counts 0; no queries give 0."""
    rank = F.when(F.col("rank") <= k, F.col("rank"))
    hit = lambda n: F.round(F.coalesce(F.avg(F.coalesce((rank <= n).cast("double"), F.lit(0.0))), F.lit(0.0)), 6).alias(f"p_at_{n}")
    mrr = F.round(F.coalesce(F.avg(F.coalesce(F.lit(1.0) / rank, F.lit(0.0))), F.lit(0.0)), 6).alias("mrr")
    return truth_ranks.groupBy(*(group or [])).agg(F.count("*").alias("n_queries"), mrr, hit(1), hit(3), hit(5))


def classification_metrics(scored: DataFrame, label: str, predicted: str) -> DataFrame:
    """0/1 label and prediction -> tp, fp, fn, accuracy, precision, recall, f1; 0 where a denominator is 0."""
    y, p = F.col(label), F.col(predicted)
    counts = scored.agg(F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"), F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if(y == p).alias("right"), F.count("*").alias("n"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    c = F.col
    prec, rec = share(c("tp"), c("tp") + c("fp")), share(c("tp"), c("tp") + c("fn"))
    return counts.select("tp", "fp", "fn", F.round(share(c("right"), c("n")), 6).alias("accuracy"), F.round(prec, 6).alias("precision"), F.round(rec, 6).alias("recall"), F.round(share(2 * prec * rec, prec + rec), 6).alias("f1"))


def log_loss(label: Column, probability: Column, eps: float = 1e-10) -> Column:
    return -F.avg(label * F.log(probability + eps) + (1 - label) * F.log(1 - probability + eps))


#: Sums of one task: number of rows, means, products of the deviations from them (row by row), least and greatest values.
PACKED = "n bigint, mean array<double>, dev array<double>, lo array<double>, hi array<double>"
Sums = tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def summed(x: np.ndarray) -> Sums:
    """Columns of numbers as rows of ``x``."""
    mean = x.mean(axis=1)
    d = x - mean[:, None]
    return x.shape[1], mean, d @ d.T, x.min(axis=1), x.max(axis=1)


def joined(a: Sums | None, b: Sums) -> Sums:
    if a is None:
        return b
    n, d = a[0] + b[0], b[1] - a[1]
    return n, a[1] + d * (b[0] / n), a[2] + b[2] + np.outer(d, d) * (a[0] * b[0] / n), np.minimum(a[3], b[3]), np.maximum(a[4], b[4])


def packed(sums: Sums | None) -> Iterator[pa.RecordBatch]:
    if sums is not None:
        yield pa.RecordBatch.from_pylist([{"n": sums[0], "mean": sums[1].tolist(), "dev": sums[2].ravel().tolist(), "lo": sums[3].tolist(), "hi": sums[4].tolist()}])


def moments(parts: DataFrame, columns: list[str]) -> DataFrame:
    """PACKED rows -> a, b, mean, std, min, max, corr: a row per pair of columns, the figures those of a, corr null where one of them is
    constant; no rows if there were none to sum up."""
    k = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for batch in batches:
            for row in batch.to_pylist():
                sums = joined(sums, (row["n"], np.array(row["mean"]), np.array(row["dev"]).reshape(k, k), np.array(row["lo"]), np.array(row["hi"])))
        if sums is not None:
            n, mean, dev, lo, hi = sums
            flat = lo == hi
            std = np.where(flat, 0.0, np.sqrt(np.diag(dev) / n))
            whole = lambda i, j: None if flat[i] or flat[j] else float(dev[i, j] / np.sqrt(dev[i, i] * dev[j, j]))
            yield pa.RecordBatch.from_pylist([{"a": a, "b": b, "mean": mean[i], "std": std[i], "min": lo[i], "max": hi[i], "corr": whole(i, j)} for i, a in enumerate(columns) for j, b in enumerate(columns)])

    return parts.repartition(1).mapInArrow(run, "a string, b string, mean double, std double, min double, max double, corr double")


def feature_statistics(found: DataFrame, features: list[str]) -> DataFrame:
    """moments -> feature, mean, std, min, max."""
    return found.where((F.col("a") == F.col("b")) & F.col("a").isin(features)).select(F.col("a").alias("feature"), *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "max")])


def correlations(found: DataFrame, features: list[str]) -> DataFrame:
    """moments -> feature_a, feature_b, corr of all pairs, null where a feature is constant or nothing was summed up."""
    spark = found.sparkSession
    every = spark.createDataFrame([(a, b) for a in features for b in features], "a string, b string")
    return every.join(found, ["a", "b"], "left").select(F.col("a").alias("feature_a"), F.col("b").alias("feature_b"), F.round("corr", 6).alias("corr"))


def label_correlations(found: DataFrame, features: list[str], label: str) -> DataFrame:
    """moments -> feature, corr with the label, 0 where either is constant."""
    return found.where((F.col("b") == label) & F.col("a").isin(features)).select(F.col("a").alias("feature"), F.round(F.coalesce("corr", F.lit(0.0)), 6).alias("corr"))


def histograms(values: DataFrame, label: str, bins: int = 30) -> DataFrame:
    """(feature, label, value, n) -> feature, label, bucket, n, density over equal bins from the least to the greatest value of each class; the
    right edge belongs to the last bin, a constant feature fills the first."""
    own = Window.partitionBy("feature", label)
    spans = values.withColumns({"lo": F.min("value").over(own), "hi": F.max("value").over(own), "total": F.sum("n").over(own)})
    bucket = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)) + 1).otherwise(F.lit(1))
    counted = spans.groupBy("feature", label, bucket.cast("int").alias("bucket"), "lo", "hi", "total").agg(F.sum("n").alias("n"))
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(F.lit(1.0) / bins)
    return counted.select("feature", label, "bucket", "n", F.round(F.col("n") / (F.col("total") * width), 6).alias("density"))
