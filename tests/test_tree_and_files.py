import json

from pyspark.sql import functions as F

from paperloom.operators import dedup, tree
from paperloom.sources import publications as P
from paperloom.sources import sinks

TEX = r"""\title{A Study}
\begin{abstract} We study a thing. \end{abstract}
\section{Intro} This is the first sentence here. This is the second one here.
\subsection{Detail} This is the first sentence here. Something else is said.
\section{References} Nothing of this is kept at all.
\section{End} \begin{itemize}\item first thing \item second thing\end{itemize}
\begin{equation*}x=1\end{equation*} Closing words stand here now.
"""


def test_tree(spark):
    rows = {r["node_id"]: r for r in tree.nodes(spark.createDataFrame([("d", TEX)], "doc string, content string")).collect()}
    by = {r["content"]: r for r in rows.values()}
    assert by["Intro"]["path"] == [1] and by["Detail"]["path"] == [1, 1] and by["End"]["path"] == [2]
    assert by["Detail"]["parent"] == by["Intro"]["node_id"] and "References" not in by
    assert by["This is the first sentence here."]["parent"] == by["Intro"]["node_id"]
    assert by["first thing"]["parent"] == by["itemize (2 items)"]["node_id"] and by["second thing"]["item"] == 2
    assert by["x=1"]["type"] == "equation" and by["A Study"]["type"] == "title"
    numbers = sorted(int(i.rsplit("_", 1)[1]) for i in rows)
    assert numbers == list(range(1, len(rows) + 1))
    assert all(r["parent"] in rows and r["parent"] != r["node_id"] for r in rows.values() if r["type"] != "document")
    nodes = tree.nodes(spark.createDataFrame([("d", TEX), ("e", "")], "doc string, content string"))
    parsed = json.loads(tree.to_json(nodes).where("doc = 'd'").first()["json"])
    assert set(parsed["elements"]) == set(rows) and len(parsed["hierarchy"]["1"]) == len(rows) - 1
    stats = {r["doc"]: r for r in tree.statistics(nodes).collect()}
    assert stats["d"]["sections"] == 2 and stats["e"]["total_nodes"] == 1
    assert tree.nodes(spark.createDataFrame([], "doc string, content string")).count() == 0


def test_numbering_resets_two_levels_below(spark):
    heads = spark.createDataFrame([("d", i, v) for i, v in enumerate((1, 2, 2, 1, 2))], "doc string, pos int, level int")
    assert [r["path"] for r in tree.numbering(heads).orderBy("pos").collect()] == [[1], [1, 1], [1, 2], [2], [2, 3]]
    assert [r["path"] for r in tree.numbering(heads, reset_children=True).orderBy("pos").collect()] == [[1], [1, 1], [1, 2], [2], [2, 1]]


def test_stale_parents(spark):
    heads = spark.createDataFrame([("d", i, v) for i, v in enumerate((1, 2, 1, 3))], "doc string, pos int, level int")
    assert [r["parent_pos"] for r in tree.parents(heads).orderBy("pos").collect()] == [None, 0, None, 1]
    assert [r["parent_pos"] for r in tree.parents(heads, clear_below=True).orderBy("pos").collect()] == [None, 0, None, 2]


def test_files(spark, tmp_path):
    base = tmp_path / "pub1" / "tex" / "v1"
    (base / "sub").mkdir(parents=True)
    (base / "main.tex").write_bytes(b"\\documentclass{a}\r\n\\input{sub/a} caf\xc3\xa9 \xff")
    (base / "sub" / "a.tex").write_text(r"inner \input{sub/b.tex}")
    (base / "sub" / "b.tex").write_text(r"deep \input{sub/a}")
    (base / "lost.tex").write_text("lost")
    (base / "refs.bib").write_text("@article{k,\n title={T}\n}\n")
    (tmp_path / "pub1" / "references.json").write_text(json.dumps({"1001-00001": {"paper_title": "T", "authors": ["A"]}}))
    files = P.source_files(spark, str(tmp_path))
    assert {r["rel_path"] for r in P.compiled_files(files).collect()} == {"main.tex", "sub/a.tex", "sub/b.tex"}
    main = P.main_files(files).first()
    assert main["rel_path"] == "main.tex" and main["content"] == "\\documentclass{a}\n\\input{sub/a} café "
    assert P.source_files(spark, str(tmp_path), "bib").count() == 1
    refs = P.reference_rows(P.side_files(spark, str(tmp_path), "references.json", f"map<string,{P.REFERENCE}>")).collect()
    assert [(r["ref_pos"], r["arxiv_id"], r["title"], r["venue"]) for r in refs] == [(0, "1001-00001", "T", "")]
    assert P.version_texts(files).first()["content"].endswith("\n\nlost\n\ninner \\input{sub/b.tex}\n\ndeep \\input{sub/a}")


def test_expand_includes(spark):
    rows = [("p", "v", "main.tex", "main.tex", r"\documentclass a \input{x} b \include{none}"), ("p", "v", "x.tex", "x.tex", r"[\input{y.tex}]"), ("p", "v", "y.tex", "y.tex", "why")]
    files = spark.createDataFrame(rows, "pub_id string, version string, rel_path string, file_name string, content string")
    assert P.expand_includes(files).first()["content"] == r"\documentclass a [why] b "


def test_greedy_clusters(spark):
    rows = [("p", "k1", "v2", 0, "A. Doe. Some long title here about things. 2001."), ("p", "k2", "v2", 1, "A. Doe. Some long title here about things 2001"), ("p", "k1", "v1", 2, "quite other content"), ("p", "k3", "v1", 3, "B. Roe doi 10.1234/x"), ("p", "k4", "v1", 4, "C doi 10.1234/x."), ("p", "k5", "v1", 5, None)]
    df = spark.createDataFrame(rows, "pub_id string, key string, version string, pos int, raw_content string")
    got = {r["canonical_key"]: (r["all_keys"], r["versions"]) for r in dedup.greedy_clusters(df).collect()}
    assert got == {"k1": (["k1", "k2"], ["v1", "v2"]), "k3": (["k3", "k4"], ["v1"])}
    assert dedup.greedy_clusters(df.limit(0)).count() == 0
    more = [("p", "a", "v2", 0, 'A. Doe, "On Things", 2001. doi 10.1234/y'), ("p", "b", "v1", 1, 'A. Doe, "Other", Journal of Stuff, 12:3-9, 2002. 10.1234/y')]
    one = dedup.greedy_clusters(spark.createDataFrame(more, df.schema)).first()["bibtex"]
    assert (one["title"], one["year"], one["journal"], one["volume"], one["key"]) == ("On Things", "2001", "Journal of Stuff", "12", "a")


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("p", "test", "auto", "k", "id1", ["id1", "id2"]), ("p", "test", "auto", "l", "id3", None)], "pub_id string, partition string, label_source string, bib_key string, true_id string, ranked array<string>")
    out = sinks.predictions_json(rows)
    parsed = json.loads(out.first()["json"])
    assert parsed == {"partition": "test", "groundtruth": {"k": "id1", "l": "id3"}, "prediction": {"k": ["id1", "id2"], "l": []}, "label_source": "auto"}
    sinks.write_json_by_publication(out, str(tmp_path / "json"))
    assert len(list((tmp_path / "json" / "pub_id=p").glob("*.txt"))) == 1
    sinks.quarantine(rows, rows.where("bib_key = 'k'").select("bib_key"), str(tmp_path / "q"), "bib_key")
    assert spark.read.parquet(str(tmp_path / "q")).count() == 1


def test_streaming_matches_batch(spark, tmp_path):
    from paperloom.streaming.references import deduplicated

    rows = spark.sql("SELECT * FROM VALUES (1L, timestamp'2024-01-01 00:00:00', 'a'), (1L, timestamp'2024-01-02 00:00:00', 'a'), (2L, timestamp'2024-01-01 00:00:00', 'b') AS t(dref_id, loaded_at, raw_content)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = deduplicated(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("deduped").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("deduped").count() == 2


def test_nodes_of_a_large_tree_carry_no_copy_of_it(spark):
    node = {"node_id": "n", "type": "sentence", "content": "c", "level": 1, "hierarchy_path": [1], "parent": None, "children": []}
    trees = [json.dumps({"paper_id": p, "root_id": "n0", "nodes": {f"n{i}": node | {"node_id": f"n{i}"} for i in range(n)}}) for p, n in (("a", 2), ("b", 1), ("c", 0))]
    df = P.legacy_nodes(spark.createDataFrame([(t,) for t in (*trees, "{broken", "{}", None)], "json string"))
    assert sorted((r["paper_id"], r["root_id"], r["node_id"], r["children"]) for r in df.collect()) == [("a", "n0", "n0", []), ("a", "n0", "n1", []), ("b", "n0", "n0", [])]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" in plan and not [line for line in plan.splitlines() if "Generate explode" in line and "), [" in line]
