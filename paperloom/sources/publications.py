"""Publication source trees and their JSON side files as DataFrames.

Layout: ``<root>/<pub_id>/tex/<version>/**/*.tex`` and ``*.bib``, beside ``references.json``, ``metadata.json`` and ``pred.json``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.runtime import Scratch

REFERENCE = "struct<paper_title:string,authors:array<string>,submission_date:string,publication_venue:string>"
PREDICTION = "struct<partition:string,groundtruth:map<string,string>,prediction:map<string,array<string>>,label_source:string>"


def decode(c: Column) -> Column:
    """UTF-8 text with invalid bytes dropped and every line end as a line feed."""
    text = F.replace(F.make_valid_utf8(c.cast("string")), F.lit("�"), F.lit(""))
    return F.regexp_replace(text, "\r\n?", "\n")


def source_files(spark: SparkSession, root: str, suffix: str = "tex") -> DataFrame:
    """pub_id, version, rel_path, file_name, content of all ``*.suffix`` files below the version folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{suffix}").load(root)
    path = F.url_decode(F.regexp_replace("path", r"\+", "%2B"))
    part = lambda g: F.regexp_extract(path, r"/([^/]+)/tex/([^/]+)/(.+)$", g)
    return files.select(part(1).alias("pub_id"), part(2).alias("version"), part(3).alias("rel_path"), F.substring_index(path, "/", -1).alias("file_name"), decode(F.col("content")).alias("content")).where("pub_id <> ''")


def publication_ids(spark: SparkSession, root: str) -> DataFrame:
    """pub_id of every publication folder below ``root`` that holds a file; only names are read."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    inside = F.regexp_replace("path", r"^[a-z]+:/+", "/")
    base = "/" + root.split("://")[-1].strip("/") + "/"
    return names.select(F.split(F.substring(inside, F.lit(len(base) + 1), F.length(inside)), "/").alias("p")).where(F.size("p") > 1).select(F.get("p", F.lit(0)).alias("pub_id")).distinct()


def metadata(pubs: DataFrame, files: DataFrame) -> DataFrame:
    """pub_id, metadata map of every publication; a missing or broken file gives an empty map."""
    found = files.select("pub_id", F.col("json").alias("found"))
    return pubs.join(found, "pub_id", "left").select("pub_id", F.coalesce("found", F.map_from_arrays(F.array(), F.array()).cast("map<string,string>")).alias("metadata"))


def skip_reasons(pubs: DataFrame, refs: DataFrame, tex: DataFrame, bibs: DataFrame) -> DataFrame:
    """pub_id, skip_reason: what keeps a publication from being matched, the first that holds; null where nothing does. refs: (pub_id, json
    map) of references.json; tex, bibs: rows per publication."""
    r = refs.groupBy("pub_id").agg(F.max(F.coalesce(F.size("json"), F.lit(0))).alias("n_refs"))
    t, b = tex.groupBy("pub_id").agg(F.count("*").alias("n_tex")), bibs.groupBy("pub_id").agg(F.count("*").alias("n_bibs"))
    reason = F.when(F.col("n_refs").isNull(), "no_refs_file").when(F.col("n_refs") == 0, "empty_refs").when(F.col("n_tex").isNull(), "no_tex_folder").when(F.col("n_bibs").isNull(), "no_bibs")
    return pubs.join(r, "pub_id", "left").join(t, "pub_id", "left").join(b, "pub_id", "left").select("pub_id", reason.alias("skip_reason"))


def label_status(labels: DataFrame, pubs: DataFrame, refs: DataFrame) -> DataFrame:
    """(pub_id, bib_key or null, arxiv_id) -> pub_id, status, n_valid: skipped without a folder or labels, failed if no label names one of the
    publication's candidates (pub_id, arxiv_id), else success."""
    known, there = refs.select("pub_id", "arxiv_id", F.lit(True).alias("valid")).distinct(), pubs.select("pub_id", F.lit(True).alias("there")).distinct()
    rows = labels.join(known, ["pub_id", "arxiv_id"], "left").join(there, "pub_id", "left")
    out = rows.groupBy("pub_id").agg(F.count("valid").alias("n_valid"), F.count("bib_key").alias("n"), F.count("there").alias("n_there"))
    status = F.when((F.col("n_there") == 0) | (F.col("n") == 0), "skipped").when(F.col("n_valid") == 0, "failed").otherwise("success")
    return out.select("pub_id", status.alias("status"), F.when(status == "success", F.col("n_valid")).otherwise(F.lit(0)).alias("n_valid"))


def legacy_nodes(trees: DataFrame) -> DataFrame:
    """(json) of the full-tree form -> paper_id, root_id, node_id, type, content, level, hierarchy_path, parent, children."""
    node = "struct<node_id:string,type:string,content:string,level:int,hierarchy_path:array<int>,parent:string,children:array<string>,metadata:map<string,string>>"
    parsed = trees.select(F.from_json("json", f"struct<paper_id:string,root_id:string,nodes:map<string,{node}>>").alias("t"))
    # the ids go into the exploded rows: as columns beside them they would have the whole tree copied with each of its nodes
    rows = F.transform(F.map_values("t.nodes"), lambda n: F.struct(F.col("t.paper_id").alias("paper_id"), F.col("t.root_id").alias("root_id"), n.alias("n")))
    return parsed.select(F.explode(rows).alias("x")).select("x.paper_id", "x.root_id", "x.n.*")


def side_files(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """pub_id and the parsed JSON of one side file per publication; broken JSON gives null."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(root)
    return files.select(F.regexp_extract(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), r"/([^/]+)/[^/]+$", 1).alias("pub_id"), F.from_json(decode(F.col("content")), schema).alias("json"))


def reference_rows(json: DataFrame) -> DataFrame:
    """(pub_id, json map) -> pub_id, ref_pos, arxiv_id, title, authors, submission_date, venue; the order of the file is kept."""
    rows = json.where("json is not null").select("pub_id", F.posexplode(F.map_entries("json")).alias("ref_pos", "e"))
    v = F.col("e.value")
    return rows.select("pub_id", "ref_pos", F.col("e.key").alias("arxiv_id"), F.coalesce(v["paper_title"], F.lit("")).alias("title"), F.coalesce(v["authors"], F.array().cast("array<string>")).alias("authors"), F.coalesce(v["submission_date"], F.lit("")).alias("submission_date"), F.coalesce(v["publication_venue"], F.lit("")).alias("venue"))


def ground_truth(predictions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pub_id, json) of pred.json -> (pub_id, bib_key, arxiv_id) and (pub_id, partition); broken files are left out."""
    fine = predictions.where("json is not null")
    return fine.select("pub_id", F.explode("json.groundtruth").alias("bib_key", "arxiv_id")), fine.select("pub_id", F.col("json.partition").alias("partition"))


def partitions_with_default(pubs: DataFrame, predictions: DataFrame, manual: DataFrame) -> DataFrame:
    """The partition of pred.json, else the manual one, else train."""
    a = predictions.select("pub_id", F.col("json.partition").alias("p"))
    b = manual.select("pub_id", F.col("partition").alias("m"))
    return pubs.join(a, "pub_id", "left").join(b, "pub_id", "left").select("pub_id", F.coalesce("p", "m", F.lit("train")).alias("partition"))


def file_kind(file_name: Column, content: Column) -> Column:
    """main, appendix, chapter or other; the first that fits."""
    name = F.lower(file_name)
    main = name.rlike(r"^(?:main\.tex|paper\.tex|manuscript\.tex|article\.tex|[0-9]{4}\.[0-9]{5}.*\.tex)")
    return (
        F.when(main | F.contains(content, F.lit(r"\documentclass")), "main").when(F.contains(name, F.lit("appendix")) | F.contains(content, F.lit(r"\appendix")), "appendix")
        .when(name.rlike("chapter|section|intro|conclusion"), "chapter").otherwise("other")
    )


def main_files(files: DataFrame) -> DataFrame:
    """The main file of every version: the first main by path, else the longest, else the first by path. An aggregate: no sort of contents."""
    kinds = files.withColumn("kind", file_kind(F.col("file_name"), F.col("content")))
    main = F.col("kind") == "main"
    order = F.struct((~main).alias("other"), F.when(~main, -F.length("content")).alias("size"), F.col("rel_path"))
    rest = [c for c in kinds.columns if c not in ("pub_id", "version")]
    return kinds.groupBy("pub_id", "version").agg(F.min_by(F.struct(*rest), order).alias("s")).select("pub_id", "version", "s.*")


def latest_main(mains: DataFrame) -> DataFrame:
    """One main file per publication: of the last version in string order that has one of kind main, else of the last version."""
    return mains.groupBy("pub_id").agg(F.max_by(F.struct("version", "rel_path", "content"), F.struct(F.col("kind") == "main", "version")).alias("f")).select("pub_id", "f.*")


def include_edges(files: DataFrame) -> DataFrame:
    r"""pub_id, version, rel_path, target of every ``\input`` and ``\include`` that names a file of the version: as written, with .tex, without."""
    names = F.explode(F.array_distinct(F.transform(F.regexp_extract_all("content", F.lit(r"\\(?:input|include)\{([^}]+)\}"), F.lit(1)), lambda n: F.trim(n))))
    asked = files.select("pub_id", "version", "rel_path", names.alias("asked"))
    tried = asked.select("*", F.posexplode(F.array(F.col("asked"), F.concat("asked", F.lit(".tex")), F.replace("asked", F.lit(".tex"), F.lit("")))).alias("n", "target"))
    known = files.select("pub_id", "version", F.col("rel_path").alias("target"))
    return tried.join(known, ["pub_id", "version", "target"], "left_semi").groupBy("pub_id", "version", "rel_path", "asked").agg(F.min_by("target", "n").alias("target")).drop("asked").distinct()


def include_closure(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """pub_id, version, rel_path of the files reached from ``starts``, themselves included. A frontier join per step over what is new; cycles end by
    themselves."""
    scratch = Scratch(edges.sparkSession, "closure")
    keys = ["pub_id", "version", "rel_path"]
    links = scratch.save(edges, "edges")
    seen = frontier = scratch.save(starts.select(*keys).distinct(), "step0")
    step = 0
    while not frontier.isEmpty():
        step += 1
        found = frontier.join(links, keys).select("pub_id", "version", F.col("target").alias("rel_path")).distinct()
        frontier = scratch.save(found.join(seen, keys, "left_anti"), f"step{step}")
        seen = seen.unionAll(frontier)
    return seen


def compiled_files(files: DataFrame) -> DataFrame:
    """Files on the compilation path of their version: reached from its main file."""
    mains = main_files(files)
    return files.join(include_closure(include_edges(files), mains), ["pub_id", "version", "rel_path"], "left_semi")


def version_texts(files: DataFrame) -> DataFrame:
    """pub_id, version, content: the main text, then every other text that differs from it, by path, joined by blank lines."""
    main = main_files(files).select("pub_id", "version", F.col("rel_path").alias("main_path"), F.col("content").alias("main_text"))
    rows = files.join(main, ["pub_id", "version"]).where((F.col("rel_path") == F.col("main_path")) | (F.col("content") != F.col("main_text")))
    parts = F.array_sort(F.collect_list(F.struct((F.col("rel_path") != F.col("main_path")).alias("o"), "rel_path", "content")))
    return rows.groupBy("pub_id", "version").agg(F.array_join(F.transform(parts, lambda p: p["content"]), "\n\n").alias("content"))


def expand_includes(files: DataFrame, depth: int = 10) -> DataFrame:
    r"""pub_id, version, content of the main files with ``\input`` and ``\include`` replaced by the named files' texts; unknown files by nothing.

    One round per depth: the text is cut at its includes, the pieces are joined with the files by name and put together again. What is nested
    deeper than ``depth`` stays as written.
    """
    by_name = files.select("pub_id", "version", F.regexp_replace("file_name", r"\.tex$", "").alias("name"), F.col("content").alias("text"))
    by_name = by_name.groupBy("pub_id", "version", "name").agg(F.max("text").alias("text"))
    scratch = Scratch(files.sparkSession, "expand")
    state = scratch.save(main_files(files).select("pub_id", "version", "content"), "step0")
    pattern = r"\\(?:input|include)\{([^}]+)\}"
    for step in range(1, depth + 2):
        if state.where(F.col("content").rlike(pattern)).isEmpty():
            break
        cut = F.split(F.regexp_replace("content", pattern, "\ue030\ue031$1\ue030"), "\ue030")
        pieces = state.select("pub_id", "version", F.posexplode(cut).alias("n", "piece")).withColumn("name", F.when(F.startswith("piece", F.lit("\ue031")), F.regexp_replace(F.substring("piece", 2, 1 << 30), r"\.tex$", "")))
        filled = pieces.join(by_name, ["pub_id", "version", "name"], "left").withColumn("out", F.when(F.col("name").isNull(), F.col("piece")).otherwise(F.coalesce("text", F.lit(""))))
        joined = filled.groupBy("pub_id", "version").agg(F.array_sort(F.collect_list(F.struct("n", "out"))).alias("p")).select("pub_id", "version", F.array_join(F.transform("p", lambda x: x["out"]), "").alias("content"))
        state = scratch.save(joined, f"step{step}")
    return state
