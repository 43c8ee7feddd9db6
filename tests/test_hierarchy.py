import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.operators.hierarchy import descendant_pairs, latest_links, nested_sets


def brute(links):
    out = {}
    for n in links:
        path, x = [], n
        while x not in path and links.get(x) in links:
            path.append(x)
            x = links[x]
        if x in path:
            cycle = path[path.index(x) :]
            out[n] = (min(cycle), -1)
        else:
            out[n] = (x, len(path))
    return out


def check(spark, links):
    df = spark.createDataFrame(list(links.items()), "node_id string, parent string")
    rows = {r["node_id"]: r for r in nested_sets(df).collect()}
    assert {n: (r["root_id"], r["depth"]) for n, r in rows.items()} == brute(links)
    trees = {}
    for r in rows.values():
        if r["depth"] >= 0:
            trees.setdefault(r["root_id"], []).append(r)
            assert r["path"][0] == r["root_id"] and r["path"][-1] == r["node_id"] and len(r["path"]) == r["depth"] + 1
        else:
            assert r["path"] is None and r["lft"] is None
    for members in trees.values():
        assert sorted(r["lft"] for r in members) == list(range(len(members)))
        for r in members:
            inside = {m["node_id"] for m in members if r["lft"] < m["lft"] <= r["rgt"]}
            assert inside == {m["node_id"] for m in members if r["node_id"] in m["path"][:-1]}
            assert r["n_descendants"] == len(inside)


def test_tree_cycles_and_unknown_parents(spark):
    check(spark, {"a": None, "b": "a", "c": "b", "d": "gone", "e": "e", "f": "e", "g": "h", "h": "i", "i": "g", "j": "i", "k": ""})


def test_random_links(spark):
    rng = random.Random(3)
    nodes = [f"n{i:03}" for i in range(120)]
    check(spark, {n: rng.choice([None, *nodes]) if rng.random() < 0.9 else None for n in nodes})


def test_chain_and_empty(spark):
    check(spark, {f"c{i:02}": f"c{i - 1:02}" if i else None for i in range(12)})
    assert nested_sets(spark.createDataFrame([], "node_id string, parent string")).count() == 0


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.dictionaries(st.sampled_from("abcdefgh"), st.sampled_from(["", *"abcdefghz"]), min_size=1))
def test_any_links(spark, links):
    check(spark, links)


def test_latest_and_descendants(spark):
    rows = [("a", None, 1), ("b", "x", 1), ("b", "a", 2), ("b", "a", 2), ("c", "b", None), (None, "a", 1)]
    df = spark.createDataFrame(rows, "node_id string, parent string, v int").withColumn("depth", F.lit(9))
    links = latest_links(df, "node_id", "parent", F.col("v"))
    assert {tuple(r) for r in links.collect()} == {("a", None), ("b", "a"), ("c", "b")}
    pairs = descendant_pairs(nested_sets(links))
    assert {tuple(r) for r in pairs.collect()} == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1)}


def test_long_chain(spark):
    """A chain of 100,000 nodes takes about log2 of its length in rounds; a long tail beneath a cycle too."""
    chain = spark.range(100_000).selectExpr("printf('%06d', id) AS node_id", "CASE WHEN id > 0 THEN printf('%06d', id - 1) END AS parent")
    tail = spark.range(3000).selectExpr("printf('t%05d', id) AS node_id", "CASE WHEN id = 0 THEN 't00002' ELSE printf('t%05d', id - 1) END AS parent")
    rows = nested_sets(chain.unionAll(tail), with_path=False)
    assert rows.where("depth >= 0 and (depth <> int(node_id) or lft <> depth or rgt <> 99999 or root_id <> '000000')").count() == 0
    got = rows.where("depth = -1").groupBy("in_cycle", "root_id").count().collect()
    assert sorted((r["in_cycle"], r["root_id"], r["count"]) for r in got) == [(False, "t00000", 2997), (True, "t00000", 3)]
    assert rows.count() == 103_000
