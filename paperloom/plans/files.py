"""Queries on source trees: publications are rendered as folders and files, written, and read back.

The tree is written once per session and table folder, below the shared folder. Which files a publication has goes by a digit k of its id's hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import latex as L
from paperloom.operators import matching as M
from paperloom.operators import tree
from paperloom.plans.matching import _FEATS, _features, _pairs_of
from paperloom.plans.parsing import _HEADS, _tex_docs
from paperloom.runtime import Scratch, table
from paperloom.sources import publications as P
from paperloom.sources import sinks

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_ROOTS: dict[tuple[str, str], str] = {}

#: Partitions set by hand; any other publication is found by its label file or trains (fixed values).
MANUAL_PARTITIONS = {"2411-00222": "test", "2411-00223": "valid", "2411-00225": "train", "2411-00226": "train", "2411-00227": "train"}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def manual_tables(spark, partitions: dict[str, str] = MANUAL_PARTITIONS, labels: dict[str, dict[str, str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(pub_id, partition) and (pub_id, bib_key, arxiv_id) of tables written in code; a publication without labels has one row of nulls."""
    rows = [(pub, k, v) for pub, found in (labels or {}).items() for k, v in (found.items() or [(None, None)])]
    return spark.createDataFrame(list(partitions.items()), "pub_id string, partition string"), spark.createDataFrame(rows, "pub_id string, bib_key string, arxiv_id string")


_K = "ascii(substr(md5(pub_id), 1, 1)) % 7"
_PUBS = f"(SELECT pub_id, coalesce(split_name, 'train') AS part, {_K} AS k FROM publications)"
_MAIN = r"'\documentclass{article}' || chr(10) || 'T ' || pub_id || chr(10) || '\input{part} and \include{none}' || chr(10) || '\bibitem{a} A. Doe. One. 2001' || chr(10) || '\bibitem[x]{b} B. Roe. Two. 2002'"
_BIB = "'@misc{k1,' || chr(10) || ' title={One}' || chr(10) || '}' || chr(10) || '@article{k2,' || chr(10) || ' title={Two}' || chr(10) || '}' || chr(10)"
# file, the k it exists for, its text
_TEX_FILES = (("v1/main.tex", "k <> 2", _MAIN), ("v1/sec/part.tex", "k <> 2", "'Part of ' || pub_id || ' é'"), ("v10/notes.tex", "k IN (0, 3, 4)", "'Notes on ' || pub_id"), ("v2/main.tex", "k IN (4, 5)", r"'\documentclass{article} second of ' || pub_id"))
_OTHERS = (("tex/v1/refs.bib", "k <> 2", _BIB), ("references.json", "k <> 0", """CASE WHEN k = 1 THEN '{}' ELSE '{"1001-00001": {"paper_title": "One of ' || pub_id || '", "authors": ["A. Doe"]}}' END"""), ("metadata.json", "k <> 4", """CASE WHEN k = 3 THEN '{broken' ELSE '{"title": "M ' || pub_id || '"}' END"""),
           ("pred.json", "k IN (1, 5, 6)", """CASE WHEN k = 6 THEN '{broken' ELSE '{"partition": "' || part || '", "groundtruth": {"a": "1001-00001"}, "prediction": {"a": []}}' END"""))


def _root(spark, sf: str) -> str:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _ROOTS:
        root = f"{Scratch(spark, 'files').root}/pubs"
        pubs = table(spark, sf, "publications").selectExpr("pub_id", "coalesce(split_name, 'train') AS part", f"{_K} AS k")
        files = [*((f"tex/{name}", when, text) for name, when, text in _TEX_FILES), *_OTHERS]
        spark_text = lambda t: t.replace("chr(10)", "char(10)").replace("\\", "\\\\")
        rows = F.explode(F.array(*[F.struct(F.concat("pub_id", F.lit(f"/{name}")).alias("rel_path"), F.expr(when).alias("there"), F.expr(spark_text(text)).alias("text")) for name, when, text in files]))
        rows = pubs.select(rows.alias("f")).where("f.there").select("f.rel_path", F.encode("f.text", "UTF-8").alias("content"))
        # one byte that is no UTF-8 in every second file
        bad = F.when(F.endswith("rel_path", F.lit("part.tex")), F.concat("content", F.unhex(F.lit("FF")))).otherwise(F.col("content"))
        sinks.write_files(rows.select("rel_path", bad.alias("content")), root)
        _ROOTS[key] = root
    return _ROOTS[key]


_TEX_SQL = " UNION ALL ".join(f"SELECT pub_id, '{name.split('/')[0]}' AS version, '{name.split('/', 1)[1]}' AS rel_path, '{name.rsplit('/', 1)[1]}' AS file_name, {text} AS content FROM {_PUBS} WHERE {when}" for name, when, text in _TEX_FILES)


@query(f"SELECT pub_id FROM {_PUBS}")
def pub_listing_rt(spark, sf):
    return P.publication_ids(spark, _root(spark, sf))


@query(_TEX_SQL)
def source_files_rt(spark, sf):
    return P.source_files(spark, _root(spark, sf))


@query(f"SELECT pub_id, 'v1' AS version, 'refs.bib' AS rel_path, {_BIB} AS content, 2 AS n_entries FROM {_PUBS} WHERE k <> 2")
def bib_files_rt(spark, sf):
    """.bib files and the number of their raw entries, cited or not."""
    files = P.source_files(spark, _root(spark, sf), "bib")
    return files.select("pub_id", "version", "rel_path", "content", F.regexp_count("content", F.lit(r"@\w+\{")).alias("n_entries"))


@query(f"SELECT pub_id, CASE WHEN k NOT IN (3, 4) THEN 'M ' || pub_id END AS title, CASE WHEN k IN (3, 4) THEN 0 ELSE 1 END AS n_fields FROM {_PUBS}")
def metadata_rt(spark, sf):
    root = _root(spark, sf)
    m = P.metadata(P.publication_ids(spark, root), P.side_files(spark, root, "metadata.json", "map<string,string>"))
    return m.select("pub_id", F.try_element_at("metadata", F.lit("title")).alias("title"), F.size("metadata").alias("n_fields"))


@query(f"SELECT pub_id, 0 AS ref_pos, '1001-00001' AS arxiv_id, 'One of ' || pub_id AS title, 'A. Doe' AS authors FROM {_PUBS} WHERE k > 1")
def references_rt(spark, sf):
    rows = P.reference_rows(P.side_files(spark, _root(spark, sf), "references.json", f"map<string,{P.REFERENCE}>"))
    return rows.select("pub_id", "ref_pos", "arxiv_id", "title", F.array_join("authors", ";").alias("authors"))


@query(f"SELECT pub_id, 'a' AS bib_key, '1001-00001' AS arxiv_id, part FROM {_PUBS} WHERE k IN (1, 5)")
def ground_truth_rt(spark, sf):
    truth, parts = P.ground_truth(P.side_files(spark, _root(spark, sf), "pred.json", P.PREDICTION))
    return truth.join(parts, "pub_id").select("pub_id", "bib_key", "arxiv_id", F.col("partition").alias("part"))


@query(f"SELECT pub_id, CASE WHEN k = 6 THEN 'train' ELSE part END AS part FROM {_PUBS} WHERE k IN (1, 5, 6) UNION ALL SELECT * FROM (VALUES {', '.join(repr(x) for x in MANUAL_PARTITIONS.items())}) v(pub_id, part)")
def partitions_rt(spark, sf):
    """Publications with a label file take its partition, a broken one the manual or train; those set by hand follow."""
    found, (manual, _) = P.side_files(spark, _root(spark, sf), "pred.json", P.PREDICTION), manual_tables(spark)
    own = P.partitions_with_default(found.select("pub_id").distinct(), found, manual)
    return own.unionAll(manual.join(own.select("pub_id"), "pub_id", "left_anti")).select("pub_id", F.col("partition").alias("part"))


@query(f"SELECT pub_id, CASE WHEN k IN (4, 5) THEN 'v2' ELSE 'v1' END AS version, 'main.tex' AS rel_path FROM {_PUBS} WHERE k <> 2")
def latest_main_rt(spark, sf):
    """The last version in string order that has a main file: v10 stands before v2 and has none."""
    return P.latest_main(P.main_files(P.source_files(spark, _root(spark, sf)))).select("pub_id", "version", "rel_path")


@query(rf"SELECT pub_id, 'v1' AS version, replace(replace({_MAIN}, '\input{{part}}', 'Part of ' || pub_id || ' é'), '\include{{none}}', '') AS content FROM {_PUBS} WHERE k <> 2")
def include_expand_rt(spark, sf):
    return P.expand_includes(P.source_files(spark, _root(spark, sf)).where("version = 'v1'"))


@query(f"SELECT pub_id, unnest(['a', 'b']) AS bib_key FROM {_PUBS} WHERE k <> 2")
def bibitem_keys_rt(spark, sf):
    files = P.source_files(spark, _root(spark, sf))
    return files.select("pub_id", F.explode(L.bibitems_of(F.col("content"))).alias("b")).select("pub_id", F.col("b.key").alias("bib_key")).distinct()


@query(f"SELECT pub_id, CASE k WHEN 0 THEN 'no_refs_file' WHEN 1 THEN 'empty_refs' WHEN 2 THEN 'no_tex_folder' END AS skip_reason FROM {_PUBS}")
def skip_reasons_rt(spark, sf):
    root = _root(spark, sf)
    files = P.source_files(spark, root)
    bibs = files.select("pub_id", F.explode(L.bibitems_of(F.col("content"))).alias("b"))
    return P.skip_reasons(P.publication_ids(spark, root), P.side_files(spark, root, "references.json", f"map<string,{P.REFERENCE}>"), files, bibs)


@query(f"SELECT pub_id, CASE WHEN k IN (0, 1) THEN 'failed' ELSE 'success' END AS status, CASE WHEN k IN (0, 1) THEN 0 ELSE 1 END AS n_valid FROM {_PUBS} UNION ALL SELECT * FROM (VALUES ('none-1', 'skipped', 0), ('none-2', 'skipped', 0)) v(a, b, c)")
def label_status_rt(spark, sf):
    """Labels of every publication, one of two right; two publications have no folder or no labels."""
    root = _root(spark, sf)
    refs = P.reference_rows(P.side_files(spark, root, "references.json", f"map<string,{P.REFERENCE}>"))
    pubs = P.publication_ids(spark, root)
    labels = pubs.select("pub_id", F.explode(F.array(*[F.struct(F.lit(k).alias("bib_key"), F.lit(v).alias("arxiv_id")) for k, v in (("a", "1001-00001"), ("b", "none"))])).alias("x")).select("pub_id", "x.*")
    _, others = manual_tables(spark, labels={"none-1": {"a": "1001-00001"}, "none-2": {}})
    return P.label_status(labels.unionAll(others), pubs, refs)


@query("WITH t AS (SELECT DISTINCT pub_id, bib_key, arxiv_id FROM labeled_pairs WHERE is_match), p AS (SELECT pub_id, coalesce(split_name, 'train') AS part FROM publications) SELECT p.pub_id, coalesce(min(part), 'train') AS part, string_agg(bib_key || '=' || arxiv_id, ',' ORDER BY bib_key) AS pairs, count(*) AS n_labels FROM t JOIN p ON p.pub_id = t.pub_id GROUP BY 1")
def label_files_rt(spark, sf):
    """Labels written as pred.json with empty predictions, and read back as a listing."""
    labels = table(spark, sf, "labeled_pairs").where("is_match").select("pub_id", "bib_key", "arxiv_id").distinct()
    parts = table(spark, sf, "publications").select("pub_id", F.coalesce("split_name", F.lit("train")).alias("partition"))
    files = sinks.empty_predictions(labels.join(parts, "pub_id"))
    root = f"{Scratch(spark, 'labels').root}/pubs"
    sinks.write_files(files.select(F.concat("pub_id", F.lit("/pred.json")).alias("rel_path"), F.col("json").alias("content")), root)
    back = P.side_files(spark, root, "pred.json", P.PREDICTION)
    pairs = F.array_join(F.array_sort(F.transform(F.map_entries("json.groundtruth"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return back.select("pub_id", F.col("json.partition").alias("part"), pairs.alias("pairs"), F.size("json.prediction").cast("bigint").alias("n_labels"))


@query(f"SELECT pub_id, CASE WHEN k IN (0, 3) THEN 3 WHEN k = 4 THEN 4 WHEN k = 5 THEN 3 ELSE 2 END AS tex_files, 1 AS bib_files, CASE WHEN k IN (0, 3, 5) THEN 2 WHEN k = 4 THEN 3 ELSE 1 END AS versions, 2 AS original_bibitems, 2 AS dedup_bibitems FROM {_PUBS} WHERE k <> 2")
def pub_file_stats_rt(spark, sf):
    """Files, versions and bibitems of a publication, all and different ones."""
    root = _root(spark, sf)
    tex = P.source_files(spark, root)
    items = tex.select("pub_id", F.explode(L.bibitems_of(F.col("content"))).alias("b")).groupBy("pub_id").agg(F.count("*").alias("original_bibitems"), F.countDistinct("b.body").alias("dedup_bibitems"))
    bibs = P.source_files(spark, root, "bib").groupBy("pub_id").agg(F.count("*").alias("bib_files"))
    return tex.groupBy("pub_id").agg(F.count("*").alias("tex_files"), F.countDistinct("version").alias("versions")).join(items, "pub_id", "left").join(bibs, "pub_id", "left")


@query(f"SELECT count(*) AS total, count(*) FILTER (k <> 2) AS successful, count(*) FILTER (k = 2) AS failed, 2 * count(*) FILTER (k <> 2) AS total_bibitems, string_agg(pub_id, ',' ORDER BY pub_id) FILTER (k = 2) AS failed_list FROM {_PUBS}")
def run_summary_rt(spark, sf):
    """Publications without any TeX file fail; their ids are listed."""
    root = _root(spark, sf)
    items = P.source_files(spark, root).select("pub_id", F.size(L.bibitems_of(F.col("content"))).alias("n")).groupBy("pub_id").agg(F.sum("n").alias("n"))
    rows = P.publication_ids(spark, root).join(items, "pub_id", "left")
    failed = F.col("n").isNull()
    return rows.agg(F.count("*").alias("total"), F.count_if(~failed).alias("successful"), F.count_if(failed).alias("failed"), F.sum("n").alias("total_bibitems"), F.array_join(F.array_sort(F.collect_list(F.when(failed, F.col("pub_id")))), ",").alias("failed_list"))


# Trees: emitted nodes of the rendered documents, as tables, files in two forms, and statistics.
_NODES = _HEADS + """, num AS (SELECT *, sum((level=1)::INT) OVER w AS c1, sum((level=2)::INT) OVER w AS c2, max(CASE WHEN level=1 THEN pos END) OVER v AS p1, max(CASE WHEN level=2 THEN pos END) OVER v AS p2 FROM k WINDOW w AS (PARTITION BY doc ORDER BY pos), v AS (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
num3 AS (SELECT *, sum((level=3)::INT) OVER (PARTITION BY doc, c1 ORDER BY pos) AS c3 FROM num),
e AS (SELECT DISTINCT doc, -1 AS pos, 0 AS j, 'document' AS type, doc AS content, 0 AS level, '0' AS path, NULL::INT AS up FROM h
  UNION ALL SELECT doc, pos, 0, type, title, level, CASE level WHEN 1 THEN c1::VARCHAR WHEN 2 THEN c1 || '.' || c2 ELSE c1 || '.' || c2 || '.' || c3 END, CASE level WHEN 2 THEN p1 WHEN 3 THEN coalesce(p2, p1) END FROM num3
  UNION ALL SELECT doc, pos, 1, 'sentence', 'We describe entry ' || entry_id || ' in detail.', level + 1, '0', pos FROM num3
  UNION ALL SELECT doc, pos, 2, 'sentence', 'It is e.g. short.', level + 1, '0', pos FROM num3),
one AS (SELECT *, row_number() OVER (PARTITION BY doc, content, type = 'document' ORDER BY pos, j) AS r FROM e),
nn AS (SELECT *, type || '_' || lpad((row_number() OVER (PARTITION BY doc ORDER BY pos, j))::VARCHAR, 4, '0') AS node_id FROM one WHERE r = 1),
nodes AS (SELECT n.doc, n.node_id, n.type, n.content, n.level::INT AS level, n.path, CASE WHEN n.type = 'document' THEN NULL ELSE coalesce(p.node_id, 'document_0001') END AS parent FROM nn n LEFT JOIN nn p ON p.doc = n.doc AND p.pos = n.up AND p.j = 0 AND p.type <> 'document')
"""


def _rendered_nodes(spark, sf) -> DataFrame:
    return tree.nodes(_tex_docs(spark, sf))


_dotted = lambda c: F.array_join(F.transform(c, lambda p: p.cast("string")), ".")


@query(_NODES + "SELECT * FROM nodes")
def node_ids_rt(spark, sf):
    return _rendered_nodes(spark, sf).select("doc", "node_id", "type", "content", "level", _dotted("path").alias("path"), "parent")


@query(_NODES + "SELECT doc, node_id AS child, parent FROM nodes WHERE parent IS NOT NULL")
def tree_edges_rt(spark, sf):
    return tree.edges(_rendered_nodes(spark, sf))


@query(_NODES + "SELECT doc, count(*) AS total_nodes, count(*) FILTER (type='section') AS sections, count(*) FILTER (type='subsection') AS subsections, 0 AS paragraphs, 0 AS figures, 0 AS equations, 0 AS lists, 0 AS items FROM nodes GROUP BY doc")
def tree_stats_rt(spark, sf):
    return tree.statistics(_rendered_nodes(spark, sf))


@query(_NODES + "SELECT doc, node_id, content, parent FROM nodes")
def tree_json_rt(spark, sf):
    """Per-publication JSON written to files, read back and taken apart."""
    root = f"{Scratch(spark, 'trees').root}/json"
    sinks.write_json_by_publication(tree.to_json(_rendered_nodes(spark, sf)), root, key="doc")
    back = spark.read.text(root).select(F.col("doc").cast("string").alias("doc"), F.from_json("value", "struct<elements:map<string,string>,hierarchy:map<string,map<string,string>>>").alias("t"))
    return back.select("doc", F.explode("t.elements").alias("node_id", "content"), F.try_element_at("t.hierarchy", F.lit("1")).alias("links")).select("doc", "node_id", "content", F.try_element_at("links", F.col("node_id")).alias("parent"))


@query(_NODES + "SELECT n.doc AS paper_id, 'document_0001' AS root_id, n.node_id, n.type, n.content, n.level, n.path, n.parent, count(c.node_id) AS n_children FROM nodes n LEFT JOIN nodes c ON c.doc = n.doc AND c.parent = n.node_id GROUP BY ALL")
def legacy_tree_rt(spark, sf):
    """The full-tree JSON, written to files and reloaded."""
    scratch = Scratch(spark, "trees")
    root = f"{scratch.root}/legacy"
    files = tree.to_legacy_json(scratch.save(_rendered_nodes(spark, sf), "nodes"))  # read for the nodes and for their children
    sinks.write_files(files.select(F.concat(F.col("doc").cast("string"), F.lit("/tree.json")).alias("rel_path"), F.col("json").alias("content")), root)
    back = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(P.decode(F.col("content")).alias("json"))
    return P.legacy_nodes(back).select("paper_id", "root_id", "node_id", "type", "content", "level", _dotted("hierarchy_path").alias("path"), "parent", F.size("children").cast("bigint").alias("n_children"))


def _rounded(x: Column, digits: int) -> Column:
    """F.round of a double; its decimal arithmetic is only used near a half and where whole numbers don't hold the value."""
    scaled = x * F.lit(float(10**digits))
    plain = (x >= 0) & (scaled < 1e14) & (F.abs(scaled - F.floor(scaled) - 0.5) > 1e-3 + scaled * 1e-14)
    return F.when(plain, F.floor(scaled + 0.5).cast("double") / F.lit(float(10**digits))).otherwise(F.round(x, digits))


# Sinks of the matching stages.
@query(_FEATS + "SELECT pub_id, bib_key, ref_id, " + ", ".join(f"round({f}::FLOAT::DOUBLE, 5) AS {f}" for f in M.FEATURES) + " FROM feats")
def features_sink_rt(spark, sf):
    path = f"{Scratch(spark, 'features').root}/features"
    sinks.write_features(_features(spark, sf), M.FEATURES, path)
    return spark.read.parquet(path).select("pub_id", "bib_key", "ref_id", *[_rounded(F.col(f).cast("double"), 5).alias(f) for f in M.FEATURES])


@query(_FEATS.split(", feats_0")[0].rstrip().rstrip(",") + " SELECT 'bib' AS kind, pub_id, bib_key AS id, title FROM bibs UNION ALL SELECT 'ref', i.pub_id, i.ref_id::VARCHAR, r_written FROM inband i")
def extracted_sink_rt(spark, sf):
    """Entries and the candidates left by the length band, written and reloaded."""
    path = f"{Scratch(spark, 'extracted').root}/data"
    bibs, refs = _pairs_of(spark, sf)
    sinks.write_extracted(bibs, refs, path)
    a = spark.read.parquet(f"{path}/bibs").select(F.lit("bib").alias("kind"), "pub_id", F.col("bib_key").alias("id"), F.col("b_written").alias("title"))
    return a.unionAll(spark.read.parquet(f"{path}/refs").select(F.lit("ref"), "pub_id", F.col("ref_id").cast("string"), "r_written"))
