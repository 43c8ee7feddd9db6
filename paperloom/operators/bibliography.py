"""The bibliography of a publication from its TeX and BibTeX files, and the flat element list of a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import latex as L
from paperloom.functions.text import content_hash
from paperloom.operators.matching import keep_first


def extracted(tex_files: DataFrame, bib_files: DataFrame) -> DataFrame:
    """(pub_id, rel_path, content) of both kinds -> pub_id, bib_key, title, authors, year, venue, arxiv_id, raw_content.

    All bibitems count; .bib entries count where some text of the publication cites them. Of equal keys the first counts, bibitems before
    .bib entries, then by path and place.
    """
    cited = tex_files.select("pub_id", F.explode(L.cited_keys_of(F.col("content"))).alias("bib_key")).distinct()
    items = tex_files.select("pub_id", "rel_path", F.posexplode(L.bibitems_of(F.col("content"))).alias("pos", "b")).select("pub_id", "rel_path", "pos", F.col("b.key").alias("bib_key"), L.bib_entry_of(F.col("b.body")).alias("e"))
    items = items.select("pub_id", F.lit(0).alias("source"), "rel_path", "pos", "bib_key", "e.title", "e.authors", "e.year", F.lit("").alias("venue"), "e.arxiv_id", "e.raw_content")
    entries = bib_files.select("pub_id", "rel_path", F.posexplode(L.bib_file_entries(F.col("content"))).alias("pos", "b"))
    people = F.when(F.col("b.author") != "", F.transform(F.split("b.author", r"\s+and\s+"), L.strip)).otherwise(F.array().cast("array<string>"))
    entries = entries.select("pub_id", F.lit(1).alias("source"), "rel_path", "pos", F.col("b.key").alias("bib_key"), "b.title", people.alias("authors"), "b.year", "b.venue", "b.arxiv_id", "b.raw_content").join(cited, ["pub_id", "bib_key"], "left_semi")
    every = items.unionByName(entries)
    return keep_first(every, ["pub_id", "bib_key"], [F.col("source"), F.col("rel_path"), F.col("pos")]).drop("source", "rel_path", "pos")


def flat_elements(docs: DataFrame) -> DataFrame:
    """(doc, content) -> doc, element_id, type, content, level, label, parent: the document, its title, abstract, headings, figures and
    displayed formulas, all directly under the document.

    An id is the type, a running number and the first eight digits of a hash. Elements that show the same are one: it has the id of their first
    and the values of their last occurrence.
    """
    cleaned = docs.select("doc", L.extractor_math(L.clean_latex(F.col("content"))).alias("c"))
    root = F.struct(F.lit("document").alias("type"), F.lit("document").alias("shown"), F.lit("").alias("content"), F.lit(0).alias("level"), F.lit("").alias("label"))
    rows = cleaned.select("doc", F.posexplode(F.concat(F.array(root), L.extractor_elements(F.col("c")))).alias("pos", "e")).select("doc", "pos", "e.*").withColumn("h", content_hash(F.col("shown"), 8))
    ones = rows.groupBy("doc", "h").agg(F.min_by("type", "pos").alias("first_type"), F.min("pos").alias("pos"), F.max_by(F.struct("type", "content", "level", "label"), "pos").alias("s"))
    n = F.row_number().over(Window.partitionBy("doc").orderBy("pos"))
    named = ones.withColumn("element_id", F.concat_ws("_", "first_type", n.cast("string"), "h"))
    root_id = F.format_string("document_1_%s", content_hash(F.lit("document"), 8))
    return named.select("doc", "element_id", "s.*", F.when(F.col("element_id") != root_id, root_id).alias("parent"))


def merged_output(merged: DataFrame, links: DataFrame) -> DataFrame:
    """dedup.merge_versions and dedup.remap_edges results -> pub_id, json with elements, hierarchy per version and element_versions."""
    e = merged.groupBy("pub_id").agg(F.array_sort(F.collect_list(F.struct("merged_id", "content", "versions"))).alias("e"))
    per_version = links.groupBy("pub_id", "version").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("child", "parent")))).alias("links"))
    h = per_version.groupBy("pub_id").agg(F.map_from_entries(F.collect_list(F.struct("version", "links"))).alias("hierarchy"))
    elements = F.map_from_entries(F.transform("e", lambda x: F.struct(x["merged_id"], x["content"])))
    versions = F.map_from_entries(F.transform("e", lambda x: F.struct(x["merged_id"], x["versions"])))
    return e.join(h, "pub_id", "left").select("pub_id", F.to_json(F.struct(elements.alias("elements"), "hierarchy", versions.alias("element_versions"))).alias("json"))
