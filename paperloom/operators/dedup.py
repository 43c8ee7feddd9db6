"""Equal contents and references across documents and versions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import latex as L
from paperloom.functions import text as X

SIMILARITY = 0.85
#: Fields of a printed reference read as BibTeX.
FIELDS = ("type", "key", "author", "title", "year", "journal", "volume", "pages", "doi", "arxiv")


def content_ids(rows: DataFrame, group: list[str], order: list[str], content: str, prefix: Column, collapsed: bool = False) -> DataFrame:
    """rows -> with element_id and is_new: equal contents of a group share the id of their first occurrence; ids count first sights."""
    key = X.collapsed_hash(F.col(content)) if collapsed else X.content_hash(F.col(content), 8)
    same = Window.partitionBy(*group, "_key").orderBy(*order)
    run = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("_key", key).withColumn("is_new", F.row_number().over(same) == 1).withColumn("_n", F.sum(F.col("is_new").cast("int")).over(run))
    return out.withColumn("element_id", F.first(F.format_string("%s_%04d", prefix, F.col("_n"))).over(same.rowsBetween(Window.unboundedPreceding, 0))).drop("_key", "_n")


def merge_versions(elements: DataFrame) -> DataFrame:
    """(pub_id, version, pos, element_id, content) -> pub_id, merged_id, content, versions, original_ids: one row per distinct content."""
    own = content_ids(elements.withColumnRenamed("element_id", "original_id"), ["pub_id"], ["version", "pos"], "content", F.substring_index("original_id", "_", 1), collapsed=True)
    return own.groupBy("pub_id", F.col("element_id").alias("merged_id")).agg(
        F.min_by("content", F.struct("version", "pos")).alias("content"), F.array_sort(F.collect_set("version")).alias("versions"),
        F.array_sort(F.collect_set(F.struct("version", F.col("original_id")))).alias("original_ids"),
    )


def remap_edges(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """(pub_id, version, pos, child, parent), (pub_id, version, original_id, merged_id) -> pub_id, version, child, parent: links between
    merged ids; of several links of one child in a version the last counts."""
    c = mapping.select("pub_id", "version", F.col("original_id").alias("child"), F.col("merged_id").alias("new_child"))
    p = mapping.select("pub_id", "version", F.col("original_id").alias("parent"), F.col("merged_id").alias("new_parent"))
    out = edges.join(c, ["pub_id", "version", "child"], "left").join(p, ["pub_id", "version", "parent"], "left")
    out = out.select("pub_id", "version", "pos", F.coalesce("new_child", "child").alias("child"), F.coalesce("new_parent", "parent").alias("parent"))
    return out.groupBy("pub_id", "version", "child").agg(F.max_by("parent", "pos").alias("parent"))


def exact_references(rows: DataFrame) -> DataFrame:
    """(pub_id, key, version, pos, raw_content) -> one row per reference hash with its keys and versions; blank contents are left out."""
    return rows.where(F.trim(F.coalesce("raw_content", F.lit(""))) != "").withColumn("content_hash", X.reference_hash(F.col("raw_content"))).groupBy("pub_id", "content_hash").agg(
        F.min_by("key", "pos").alias("canonical_key"), F.array_sort(F.collect_set("key")).alias("all_keys"), F.array_sort(F.collect_set("version")).alias("versions"), F.min_by("raw_content", "pos").alias("raw_content"),
    )


def key_features(rows: DataFrame) -> DataFrame:
    """What references are compared by, computed in the JVM once per row."""
    raw = F.col("raw_content")
    bare = F.nullif(F.regexp_extract(raw, rf"(?<![{X.WORD}])([0-9]{{4}}\.[0-9]{{4,5}})(?![{X.WORD}])", 1), F.lit(""))
    words = F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(raw), rf"[^{X.WORD}\s]", ""), r"\s+"), lambda w: w != ""))
    return rows.select("*", X.reference_hash(raw).alias("h"), F.nullif(X.doi_of(raw), F.lit("")).alias("doi"), bare.alias("arxiv"), X.year_of(raw).alias("year"), F.lower(X.first_word(raw)).alias("first"), words.alias("words"))


def greedy_clusters(rows: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """(pub_id, key, version, pos, raw_content) -> pub_id, content_hash, canonical_key, all_keys, versions, raw_content, bibtex: of
    every BibTeX field the first value that is not empty.

    References come by version descending and position; each joins the cluster of its hash, else of its key, else the first cluster whose
    representative has its DOI, its arXiv id, or its year and first word with a word similarity above ``threshold``; else it founds one. The
    fold depends on its order, so it runs per publication, streaming over sorted rows; candidates are looked up by DOI, id and (year, first
    word), so a publication costs its rows and not their square.
    """
    ready = key_features(rows.where(F.trim(F.coalesce("raw_content", F.lit(""))) != ""))
    ready = ready.withColumn("b", L.bibtex_of(F.col("key"), F.col("raw_content"))).withColumn("fields", F.array(*[F.col("b")[f] for f in FIELDS]))
    ready = ready.repartition("pub_id").sortWithinPartitions("pub_id", F.desc("version"), "pos")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pub, state = None, None
        for frame in batches:
            for r in frame.itertuples(index=False):
                if r.pub_id != pub:
                    if state:
                        yield _flush(pub, state)
                    pub, state = r.pub_id, ({}, {}, {}, {}, {})
                clusters, by_key, by_doi, by_arxiv, by_name = state
                words = set(r.words)
                hit = r.h if r.h in clusters else by_key.get(r.key)
                if hit is None:
                    named = [h for h in by_name.get((r.year, r.first), ()) if r.first and words and len(words & clusters[h]["w"]) / len(words | clusters[h]["w"]) > threshold]
                    options = [h for h in (by_doi.get(r.doi) if r.doi else None, by_arxiv.get(r.arxiv) if r.arxiv else None, *named[:1]) if h is not None]
                    hit = min(options, key=lambda h: clusters[h]["n"]) if options else None
                if hit is None:
                    hit = r.h
                    clusters[hit] = {"n": len(clusters), "key": r.key, "keys": set(), "versions": set(), "raw": r.raw_content, "w": words, "fields": list(r.fields)}
                    if r.doi:
                        by_doi.setdefault(r.doi, hit)
                    if r.arxiv:
                        by_arxiv.setdefault(r.arxiv, hit)
                    by_name.setdefault((r.year, r.first), []).append(hit)
                clusters[hit]["fields"] = [old or new for old, new in zip(clusters[hit]["fields"], r.fields)]
                clusters[hit]["keys"].add(r.key)
                clusters[hit]["versions"].add(r.version)
                by_key[r.key] = hit
        if state:
            yield _flush(pub, state)

    def _flush(pub, state) -> pd.DataFrame:
        return pd.DataFrame([(pub, h, c["key"], sorted(c["keys"]), sorted(c["versions"]), c["raw"], {f: v for f, v in zip(FIELDS, c["fields"]) if v}) for h, c in state[0].items()], columns=["pub_id", "content_hash", "canonical_key", "all_keys", "versions", "raw_content", "bibtex"])

    return ready.select("pub_id", "key", "version", "raw_content", "h", "doi", "arxiv", "year", "first", "words", "fields").mapInPandas(fold, "pub_id string, content_hash string, canonical_key string, all_keys array<string>, versions array<string>, raw_content string, bibtex map<string,string>")


def canonical_keys(clusters: DataFrame) -> DataFrame:
    return clusters.select("pub_id", F.explode("all_keys").alias("key"), "canonical_key")
