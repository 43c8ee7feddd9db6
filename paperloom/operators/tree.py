"""Document trees from LaTeX text: node and edge tables, numbering, statistics and JSON output.

Every element gets its place in one emission order (root, title, abstract, sections with their sentences, environments, lists with
their items); ids, parents and numbers are then window expressions over that order, per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import latex as L
from paperloom.functions.text import content_hash
from paperloom.runtime import Scratch

_EMPTY = "array<struct<pos:array<int>,type:string,content:string,level:int,owner:array<int>,item:int>>"


def _one(*pos, type: str, content: Column, level: int, owner: Column | None = None, item: Column | None = None) -> Column:
    place = F.array(*[p if isinstance(p, Column) else F.lit(p) for p in pos]).cast("array<int>")
    return F.struct(place.alias("pos"), (F.lit(type) if isinstance(type, str) else type).alias("type"), content.alias("content"), F.lit(level).cast("int").alias("level") if isinstance(level, int) else level.cast("int").alias("level"), (owner if owner is not None else F.lit(None)).cast("array<int>").alias("owner"), (item if item is not None else F.lit(None)).cast("int").alias("item"))


def sections(docs: DataFrame) -> DataFrame:
    """(doc, content) -> doc, pos, type, level, title, body, skip: the headings in order; skip marks reference sections, which last to the
    next heading of level 1."""
    rows = docs.select("doc", F.posexplode(L.sections_of(F.col("content"))).alias("pos", "s")).select("doc", "pos", "s.*")
    before = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    flag = F.last(F.when(F.col("level") == 1, L.is_reference_title(F.col("title"))), ignorenulls=True).over(before)
    return rows.withColumn("skip", F.coalesce(flag, F.lit(False)))


def numbering(heads: DataFrame, reset_children: bool = False) -> DataFrame:
    """(doc, pos, level) -> with ``path``, the heading's number.

    A heading resets the counters two and more levels below it; with ``reset_children`` also the one directly below.
    """
    w = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    reach = 1 if reset_children else 2
    out = heads
    for k in (1, 2, 3, 4):
        out = out.withColumn(f"_g{k}", F.sum((F.col("level") <= k - reach).cast("int")).over(w))
        inner = Window.partitionBy("doc", f"_g{k}").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn(f"_c{k}", F.sum((F.col("level") == k).cast("int")).over(inner))
    counters = F.array(*[F.col(f"_c{k}").cast("int") for k in (1, 2, 3, 4)])
    return out.withColumn("path", F.slice(counters, 1, F.col("level"))).drop(*[f"_{p}{k}" for p in "gc" for k in (1, 2, 3, 4)])


def parents(heads: DataFrame, clear_below: bool = False) -> DataFrame:
    """(doc, pos, level) -> with ``parent_pos``: the latest earlier heading of the greatest lower level seen so far, null under the root.

    A heading of a level stays the candidate parent until the next of its level, even across a new section; with ``clear_below`` a heading
    ends the deeper ones before it.
    """
    before = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    at = {k: F.last(F.when(F.col("level") == k, F.col("pos")), ignorenulls=True).over(before) for k in (1, 2, 3)}
    if clear_below:
        choice = F.greatest(*[F.when(F.col("level") > k, at[k]) for k in (1, 2, 3)])
    else:
        choice = F.coalesce(*[F.when(F.col("level") > k, at[k]) for k in (3, 2, 1)])
    return heads.withColumn("parent_pos", choice)


def elements(docs: DataFrame) -> DataFrame:
    """(doc, content) -> doc, pos, type, content, level, owner, item, path, parent_pos: everything that is emitted, repeats included."""
    c = F.col("content")
    heads = parents(numbering(sections(docs).where("not skip")))
    owner = lambda at: F.array(F.lit(3), F.col(at), F.lit(0), F.lit(0))
    # a heading and its sentences in one pass over the headings; the text is made in a step of its own and read as a column
    text = heads.withColumn("t", L.body_text(F.col("body"))).withColumn("s", F.when(F.length("t") >= 20, L.sentences_of(F.col("t"))).otherwise(F.array().cast("array<string>")))
    head = _one(3, F.col("pos"), 0, 0, type=F.col("type"), content=F.col("title"), level=F.col("level"), owner=F.when(F.col("parent_pos").isNotNull(), owner("parent_pos")))
    parts = F.transform("s", lambda s, j: _one(3, F.col("pos"), 1, j, type="sentence", content=s, level=F.col("level") + 1, owner=owner("pos")))
    both = text.select("doc", "path", F.explode(F.concat(F.array(head).cast(_EMPTY), F.filter(parts, lambda x: F.length(x["content"]) >= 10).cast(_EMPTY))).alias("e"))
    none = F.lit(None).cast("array<int>").alias("path")
    head_rows = both.select("doc", "e", F.when(F.get("e.pos", F.lit(2)) == 0, F.col("path")).alias("path"))
    root = F.array(_one(0, 0, 0, 0, type="document", content=F.col("doc").cast("string"), level=0))
    title = F.when(L.title_of(c).isNotNull(), F.array(_one(1, 0, 0, 0, type="title", content=L.title_of(c), level=1))).otherwise(F.array().cast(_EMPTY))
    abstract = F.when(L.abstract_of(c).isNotNull(), F.array(_one(2, 0, 0, 0, type="abstract", content=L.abstract_of(c), level=1))).otherwise(F.array().cast(_EMPTY))
    envs = F.transform(F.filter(L.environments_of(c), lambda e: F.length(e["content"]) > 0), lambda e, n: _one(4, n, 0, 0, type=e["type"], content=e["content"], level=5))
    found = L.lists_of(c)
    lists = F.transform(found, lambda e, n: _one(5, n, 0, 0, type=e["type"], content=F.concat(e["type"], F.lit(" ("), F.size(e["items"]).cast("string"), F.lit(" items)")), level=5))
    items = F.flatten(F.transform(found, lambda e, n: F.transform(e["items"], lambda x, j: _one(5, n, 1, j, type="item", content=x, level=6, owner=F.array(F.lit(5), n, F.lit(0), F.lit(0)), item=j + 1))))
    others = docs.select("doc", F.explode(F.concat(root, title, abstract, envs, lists, items)).alias("e"), none)
    return head_rows.unionByName(others).select("doc", "e.*", "path")


def nodes(docs: DataFrame) -> DataFrame:
    """(doc, content) -> doc, node_id, type, content, level, path, parent, item, pos: one row per distinct content of a document.

    Equal contents share the node of their first occurrence, whatever their types; the root and lists are always nodes of their own. A repeated
    heading takes the parent of its last occurrence, other repeats keep the first. A node is never its own parent: such a link goes to the root.
    The elements are written once, as they are needed twice.
    """
    own = F.col("type").isin("document", *L.LISTS)
    rows = elements(docs).withColumn("key", F.when(own, F.concat(F.lit("#"), F.array_join(F.transform("pos", lambda p: p.cast("string")), "."))).otherwise(content_hash(F.col("content"), 12)))
    order = Window.partitionBy("doc").orderBy("pos")
    same = Window.partitionBy("doc", "key").orderBy("pos")
    rows = rows.withColumn("new", (F.row_number().over(same) == 1).cast("int"))
    rows = rows.withColumn("n", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("node_id", F.first(F.format_string("%s_%04d", "type", "n")).over(first))
    heads = F.col("type").isin(*L.HEAD_LEVELS)
    rows = rows.withColumn("owner_used", F.when(F.max(heads.cast("int")).over(first) == 1, F.last(F.when(heads, F.struct("owner")), ignorenulls=True).over(first)["owner"]).otherwise(F.col("owner")))
    rows = Scratch(rows.sparkSession, "tree").save(rows.select("doc", "node_id", "type", "content", "level", "path", "item", "pos", "new", "owner_used"), "elements")
    firsts = rows.where("new = 1")
    places = rows.select(F.col("doc").alias("p_doc"), F.col("pos").alias("p_pos"), F.col("node_id").alias("p_id"))
    joined = firsts.join(places, (F.col("doc") == F.col("p_doc")) & (F.col("owner_used") == F.col("p_pos")), "left")
    root = F.lit("document_0001")
    parent = F.when(F.col("type") == "document", F.lit(None)).when(F.col("p_id").isNull() | (F.col("p_id") == F.col("node_id")), root).otherwise(F.col("p_id"))
    return joined.select("doc", "node_id", "type", "content", "level", F.coalesce("path", F.array(F.lit(0))).alias("path"), parent.alias("parent"), "item", "pos")


def edges(node_rows: DataFrame) -> DataFrame:
    return node_rows.where("parent is not null").select("doc", F.col("node_id").alias("child"), "parent")


def statistics(node_rows: DataFrame) -> DataFrame:
    n = lambda *t: F.count_if(F.col("type").isin(*t))
    return node_rows.groupBy("doc").agg(
        F.count("*").alias("total_nodes"), n("section").alias("sections"), n("subsection").alias("subsections"), n("paragraph").alias("paragraphs"), n("figure").alias("figures"),
        n("equation").alias("equations"), n(*L.LISTS).alias("lists"), n("item").alias("items"),
    )


def to_json(node_rows: DataFrame) -> DataFrame:
    """doc, json: the elements and the child-to-parent links of a document, in emission order."""
    by_place = F.array_sort(F.collect_list(F.struct("pos", "node_id", "content", "parent")))
    grouped = node_rows.groupBy("doc").agg(by_place.alias("n"))
    elems = F.map_from_entries(F.transform("n", lambda x: F.struct(x["node_id"], x["content"])))
    links = F.map_from_entries(F.transform(F.filter("n", lambda x: x["parent"].isNotNull()), lambda x: F.struct(x["node_id"], x["parent"])))
    return grouped.select("doc", F.to_json(F.struct(elems.alias("elements"), F.create_map(F.lit("1"), links).alias("hierarchy"))).alias("json"))


def to_legacy_json(node_rows: DataFrame) -> DataFrame:
    """doc, json: the whole tree with every node's type, level, number, parent and children."""
    kids = node_rows.where("parent is not null").groupBy("doc", F.col("parent").alias("node_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("node_id").alias("k")))), lambda x: x["k"]).alias("children"))
    rows = node_rows.join(kids, ["doc", "node_id"], "left")
    node = F.struct("node_id", "type", "content", "level", F.col("path").alias("hierarchy_path"), "parent", F.coalesce("children", F.array().cast("array<string>")).alias("children"))
    trees = rows.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("pos", node.alias("n")))).alias("ns"), F.min_by("node_id", "pos").alias("root_id"))
    nodes = F.map_from_entries(F.transform("ns", lambda x: F.struct(x["n"]["node_id"], x["n"])))
    return trees.select("doc", F.to_json(F.struct(F.col("doc").cast("string").alias("paper_id"), "root_id", nodes.alias("nodes"))).alias("json"))
