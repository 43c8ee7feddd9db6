"""Queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import bpe_encode, format_duplicates, leakage, markup, name_variants, sentences, soft_linkage, truncation
from paperloom.llm.oracles import ORACLES  # noqa: F401
from paperloom.operators.packed_values import NAMES, unpack
from paperloom.runtime import Scratch, table, width


def p1_classes(spark: SparkSession, sf: str) -> DataFrame:
    return format_duplicates.record_classes(table(spark, sf, "dedup_references"), "dref_id", "raw_content", "all_keys")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    classes = Scratch(spark, "p1").save(p1_classes(spark, sf), "classes")
    return format_duplicates.class_pairs(classes, "dref_id", "dref_a", "dref_b")


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return bpe_encode.encode(table(spark, sf, "documents"))


def p9_spans(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaked(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return p9_spans(spark, sf).select("doc_id", "item_id")


def p3_sentences(spark: SparkSession, sf: str) -> DataFrame:
    nodes = table(spark, sf, "hierarchy_nodes").where(F.col("node_type").isin("abstract", "paragraph")).select("node_id", "pub_id", "parsed_at", "content")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * width(spark))
    latest = nodes.repartition(tasks, "node_id").groupBy("node_id").agg(F.max(F.struct("parsed_at", "content", "pub_id")).alias("s"))  # one shuffle for both steps
    languages = table(spark, sf, "publications").groupBy("pub_id").agg(F.max("lang").alias("lang"))
    known = latest.select("node_id", "s.content", "s.pub_id").join(languages, "pub_id", "left")
    return sentences.sentences(known, "node_id", "content", "lang", even=False)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return p3_sentences(spark, sf).select("node_id", "end_char")


def p10_truncated(spark: SparkSession, sf: str) -> DataFrame:
    cut = truncation.truncated(table(spark, sf, "documents"))
    return cut.withColumns({c: F.round(c, 9) for c in ("end_share", "kind_share")})


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return p10_truncated(spark, sf).select("doc_id")


def p10_sources(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.truncation_by_source(table(spark, sf, "documents"))


def _p2_fields(spark: SparkSession, sf: str) -> DataFrame:
    bib = markup.field_rows(table(spark, sf, "bib_entries"), "bib_entries", F.col("entry_id"), "raw_content")
    return bib.unionByName(markup.field_rows(table(spark, sf, "hierarchy_nodes"), "hierarchy_nodes", F.col("node_id"), "content"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return markup.with_markup(_p2_fields(spark, sf))


def p2_clean(spark: SparkSession, sf: str) -> DataFrame:
    return markup.cleaned(_p2_fields(spark, sf))


def _author_names(spark: SparkSession, sf: str) -> DataFrame:
    """(name, weight): equal fields are taken apart once."""
    fields = table(spark, sf, "bib_entries").select("entry_id", "authors").distinct().groupBy("authors").agg(F.count("*").alias("weight"))
    bib = unpack(fields, "weight", {"authors": NAMES}).select(F.col("value").alias("name"), "weight")
    return bib.unionAll(table(spark, sf, "ref_entries").select(F.explode("authors").alias("name"), F.lit(1).cast("bigint")))


def p6_authors(spark: SparkSession, sf: str) -> DataFrame:
    return name_variants.author_of(_author_names(spark, sf))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return name_variants.variant_pairs(_author_names(spark, sf))


def p7_matches(spark: SparkSession, sf: str) -> DataFrame:
    return soft_linkage.linked(soft_linkage.matches(table(spark, sf, "bib_entries"), table(spark, sf, "ref_entries")))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return p7_matches(spark, sf).select("entry_id", "ref_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_classes, p2_found, p2_clean, p8_ids, p9_found, p9_spans, p3_found, p3_sentences, p10_found, p10_truncated, p10_sources, p6_found, p6_authors, p7_found, p7_matches)}
