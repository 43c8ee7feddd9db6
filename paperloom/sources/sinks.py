"""Writers: per-publication JSON, quarantine of failed publications, models."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json_by_publication(rows: DataFrame, path: str, key: str = "pub_id", json: str = "json") -> None:
    """One folder ``key=<value>`` per publication holding its JSON text."""
    rows.select(key, F.col(json).alias("value")).repartition(key).write.mode("overwrite").partitionBy(key).text(path)


def predictions_json(rows: DataFrame) -> DataFrame:
    """(pub_id, partition, label_source, bib_key, true_id, ranked array) -> pub_id, json in the form of pred.json."""
    entries = F.array_sort(F.collect_list(F.struct("bib_key", "true_id", "ranked")))
    g = rows.groupBy("pub_id").agg(F.max("partition").alias("partition"), F.max("label_source").alias("label_source"), entries.alias("e"))
    truth = F.map_from_entries(F.transform("e", lambda x: F.struct(x["bib_key"], x["true_id"])))
    ranked = F.map_from_entries(F.transform("e", lambda x: F.struct(x["bib_key"], F.coalesce(x["ranked"], F.array().cast("array<string>")))))
    return g.select("pub_id", F.to_json(F.struct("partition", truth.alias("groundtruth"), ranked.alias("prediction"), "label_source")).alias("json"))


def quarantine(rows: DataFrame, good: DataFrame, path: str, key: str = "pub_id") -> None:
    """Rows without a good key are written aside; nothing is ever deleted from the input."""
    rows.join(good.select(key).distinct(), key, "left_anti").write.mode("overwrite").parquet(path)


def write_files(rows: DataFrame, root: str) -> int:
    """(rel_path, content string or binary) -> one file per row below ``root``, a folder all executors share; the number of files. An
    existing file is replaced, so a task that runs again does no harm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                path = f"{base.rstrip('/')}/{name}"
                store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(path) as out:
                    out.write(data if isinstance(data, bytes) else data.encode("utf-8"))
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return rows.select("rel_path", "content").where("content is not null").mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def empty_predictions(labels: DataFrame) -> DataFrame:
    """(pub_id, partition, bib_key, arxiv_id) -> pub_id, json: a pred.json with the truth and an empty prediction for each of its keys."""
    entries = F.array_sort(F.collect_list(F.struct("bib_key", "arxiv_id")))
    g = labels.groupBy("pub_id").agg(F.max("partition").alias("partition"), entries.alias("e"))
    truth = F.map_from_entries(F.transform("e", lambda x: F.struct(x["bib_key"], x["arxiv_id"])))
    empty = F.map_from_entries(F.transform("e", lambda x: F.struct(x["bib_key"], F.array().cast("array<string>"))))
    return g.select("pub_id", F.to_json(F.struct("partition", truth.alias("groundtruth"), empty.alias("prediction"))).alias("json"))


def write_extracted(bibs: DataFrame, refs: DataFrame, path: str) -> None:
    """Entries and candidates of every publication as two Parquet tables below ``path``."""
    bibs.write.mode("overwrite").parquet(f"{path}/bibs")
    refs.write.mode("overwrite").parquet(f"{path}/refs")


def write_features(pairs: DataFrame, features: list[str], path: str) -> None:
    """Pair keys and their features as single-precision numbers, one Parquet table."""
    pairs.select("pub_id", "bib_key", "ref_id", *[F.col(f).cast("float").alias(f) for f in features]).write.mode("overwrite").parquet(path)
