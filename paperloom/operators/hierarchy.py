"""Parent-child rows to full hierarchies by nested-set numbering.

Upward, every node hands the size of what it has gathered to the node 2^k links above it, so that subtree sizes are whole after
about log2(depth) rounds; nodes that reach no root when a round brings no node to one are on or beneath a cycle. Downward, siblings get
consecutive preorder ranges by prefix sums over their sizes, and a node's place is the sum of the offsets on its way up, again gathered in doubling
steps: nodes of a depth from 2^k to 2^(k+1) are placed in round k. ``lft``..``rgt`` then holds exactly the node's subtree.
A round reads only nodes still on their way and, downward, those already placed; ids are 64-bit numbers, names are joined once at the end.
Joins on a hot parent have a unique other side, so that adaptive planning may split them; sums are combined before their shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.runtime import Scratch

#: Siblings numbered by one task; more siblings are split into buckets of about this size.
SIBLINGS_PER_TASK = 50_000


def latest_links(rows: DataFrame, node: str, parent: str, version: Column) -> DataFrame:
    """One (node_id, parent) row per node: the row of the highest ``version`` (null is lowest) counts; equal
    versions are settled by the larger parent (null lowest). Rows with a null node are dropped; an empty parent is null."""
    links = rows.select(
        F.col(node).alias("node_id"),
        F.struct(version.alias("v"), F.when(F.trim(F.col(parent)) != "", F.col(parent)).alias("parent")).alias("s"),
    ).where(F.col("node_id").isNotNull())
    return links.groupBy("node_id").agg(F.max("s").alias("s")).select("node_id", F.col("s.parent").alias("parent"))


def nested_sets(links: DataFrame, with_path: bool = True) -> DataFrame:
    """(node_id, parent) with unique node_id -> node_id, parent, root_id, depth, path, lft, rgt, n_descendants, in_cycle.

    A parent that is null, empty or unknown makes a root: depth 0, path [node_id], lft 0. On or beneath a
    cycle depth is -1, root_id the smallest node_id of that cycle, in_cycle true for nodes on the cycle, and
    path, lft, rgt and n_descendants are null. Without ``with_path`` there is no path column, and its cost, the sum of all depths, is saved.
    An empty table gives an empty result.
    """
    spark = links.sparkSession
    scratch = Scratch(spark, "nested")
    named = scratch.save(links.select("node_id", "parent").withColumn("id", F.monotonically_increasing_id()), "named")
    known = named.select(F.col("node_id").alias("parent"), F.col("id").alias("pid"))
    base = named.where("parent is not null").join(known, "parent", "left").select("id", "node_id", "parent", "pid")
    base = scratch.save(base.unionAll(named.where("parent is null").select("id", "node_id", "parent", F.lit(None).cast("bigint"))), "base")

    # Upward: (id, anc, size), the node 2^k links above and the descendants less than 2^k links below, for nodes at least 2^k below a root.
    active = scratch.save(base.where("pid is not null").select("id", F.col("pid").alias("anc"), F.lit(1).cast("bigint").alias("size")), "up0")
    count, step, ups, looping = active.count(), 0, [], None
    while count:
        ups.append(active)
        gains = active.groupBy(F.col("anc").alias("id")).agg(F.sum("size").alias("gain"))
        ahead = active.select(F.col("id").alias("anc"), F.col("anc").alias("further"))
        on = active.join(ahead, "anc").select("id", F.col("further").alias("anc"), "size").join(gains, "id", "left")
        step += 1
        active = scratch.save(on.select("id", "anc", (F.col("size") + F.coalesce("gain", F.lit(0))).alias("size")), f"up{step}")
        left = active.count()
        if left == count:  # nobody reached a root: those of the next depths would have
            looping = active.select("id", "anc")
            break
        count = left

    gathered = reduce(DataFrame.unionAll, [u.select(F.col("anc").alias("id"), "size") for u in ups]) if ups else active.select("id", "size")
    sizes = gathered.groupBy("id").agg((F.sum("size") + 1).alias("size"))
    nodes = base.join(sizes, "id", "left").select("id", "node_id", "pid", F.coalesce("size", F.lit(1)).alias("size"))
    if looping is not None:
        looping, on_cycle = _cycles(looping, base, scratch)
        nodes = nodes.join(looping.select("id"), "id", "left_anti")
    nodes = scratch.save(nodes, "sized")
    scratch.keep("base", "sized", "looping", "labels")

    # Siblings' offsets: prefix sums inside buckets, and over the buckets of a parent.
    inner = nodes.where("pid is not null")
    fan = inner.groupBy("pid").agg(F.count("*").alias("siblings"))
    inner = inner.join(fan, "pid").withColumn("bucket", F.pmod(F.xxhash64("node_id"), F.ceil(F.col("siblings") / SIBLINGS_PER_TASK)))
    sums = inner.groupBy("pid", "bucket").agg(F.sum("size").alias("b_size"))
    over_buckets = Window.partitionBy("pid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("pid", "bucket", F.coalesce(F.sum("b_size").over(over_buckets), F.lit(0)).alias("b_start"))
    in_bucket = Window.partitionBy("pid", "bucket").orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    inner = inner.withColumn("offset", F.coalesce(F.sum("size").over(in_bucket), F.lit(0))).join(sums, ["pid", "bucket"])

    # Downward: what is on its way (id, anc, way, the sum of its last 2^k offsets) and what is placed (id, root, depth, lft).
    own = [F.array("node_id").alias("path")] if with_path else []
    moving = scratch.save(inner.select("id", F.col("pid").alias("anc"), (F.col("offset") + F.col("b_start") + 1).alias("way"), *own), "way0")
    roots = nodes.where("pid is null").select("id", F.col("id").alias("root"), F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("lft"), *own)
    placed = scratch.save(roots, "placed0")
    path_column = ", path array<string>" if with_path else ""
    steps, reach, step = ["placed0"], 1, 0
    none = lambda t: F.lit(None).cast(t)
    while moving is not None and not (step == 0 and moving.isEmpty()):
        step += 1
        path = [F.col("path").alias("above")] if with_path else []
        there = placed.select(F.col("id").alias("anc"), none("bigint").alias("further"), "root", "depth", F.col("lft").alias("sum"), *path)
        passing = moving.select(F.col("id").alias("anc"), F.col("anc").alias("further"), none("bigint").alias("root"), none("int").alias("depth"), F.col("way").alias("sum"), *path)
        met = moving.join(there.unionAll(passing), "anc").withColumn("sum", F.col("sum") + F.col("way"))
        whole = [F.concat("above", "path").alias("path")] if with_path else []
        met = met.select("id", "further", "root", (F.col("depth") + reach).alias("depth"), "sum", *whole, F.col("root").isNotNull().alias("done"))
        folder = scratch.write(met, f"down{step}", "done")
        columns = "id bigint, further bigint, root bigint, depth int, sum bigint" + path_column
        done, moving = _part(spark, folder, "done=true", columns), _part(spark, folder, "done=false", columns)
        extra = ["path"] if with_path else []
        if done is not None:
            placed = placed.unionAll(done.select("id", "root", "depth", F.col("sum").alias("lft"), *extra))
            steps.append(f"down{step}")
        if moving is not None:
            moving = moving.select("id", F.col("further").alias("anc"), F.col("sum").alias("way"), *extra)
        reach *= 2
    scratch.free("way0", *(f"down{n}" for n in range(1, step + 1) if f"down{n}" not in steps))

    extra = ["path"] if with_path else []
    names = base.join(nodes.select("id", "size"), "id")
    root_names = nodes.where("pid is null").select(F.col("id").alias("root"), F.col("node_id").alias("root_id"))
    tree = placed.join(root_names, "root").join(names.select("id", "node_id", "parent", "size"), "id")
    result = tree.select(
        "node_id", "parent", "root_id", "depth", *extra, "lft", (F.col("lft") + F.col("size") - 1).alias("rgt"), (F.col("size") - 1).alias("n_descendants"), F.lit(False).alias("in_cycle")
    )
    if looping is None:
        return result
    circle = looping.join(on_cycle.select(F.col("id").alias("anc"), F.col("label").alias("root_id")), "anc").join(on_cycle.select("id", F.lit(True).alias("on")), "id", "left").join(base, "id")
    nothing = [none("array<string>").alias("path")] if with_path else []
    return result.unionAll(circle.select("node_id", "parent", "root_id", F.lit(-1), *nothing, none("bigint"), none("bigint"), none("bigint"), F.coalesce("on", F.lit(False))))


def _cycles(looping: DataFrame, base: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(id, anc) of the nodes on or beneath cycles -> the same with an anc on the cycle, and (id, label) of the nodes on cycles.

    Every doubling moves the pointers on; what they point at shrinks until only the cycles are left."""
    targets, step = looping.select("anc").distinct().count(), 0
    while True:
        ahead = looping.select(F.col("id").alias("anc"), F.col("anc").alias("further"))
        looping = scratch.save(looping.join(ahead, "anc").select("id", F.col("further").alias("anc")), f"loop{step}")
        left = looping.select("anc").distinct().count()
        if left == targets:
            break
        targets, step = left, step + 1
    looping = scratch.save(looping, "looping")
    on = looping.select(F.col("anc").alias("id")).distinct().join(base, "id")
    links = on.select("node_id", F.col("parent"), "id")
    labels = _cycle_labels(links.select("node_id", "parent"), scratch)
    return looping, scratch.save(links.join(labels, "node_id").select("id", "label"), "labels")


def _part(spark, path: str, folder: str, schema: str) -> DataFrame | None:
    """One partition folder of a written step, or None if no row fell into it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/{folder}")
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return None
    return spark.read.schema(schema).parquet(f"{path}/{folder}")


def _cycle_labels(looping: DataFrame, scratch: Scratch) -> DataFrame:
    """(node_id, parent) rows all on cycles -> (node_id, label): the smallest node_id of the cycle, by pointer doubling.

    After r rounds the label is the least of the next 2^r nodes; when a round changes no label, every window holds its cycle.
    """
    state = scratch.save(looping.select("node_id", F.col("parent").alias("ptr"), F.least("node_id", "parent").alias("label")), "cycle0")
    step = 0
    while True:
        step += 1
        ahead = state.select(F.col("node_id").alias("a_id"), F.col("ptr").alias("a_ptr"), F.col("label").alias("a_label"))
        state = scratch.save(
            state.join(ahead, state["ptr"] == ahead["a_id"]).select("node_id", F.col("a_ptr").alias("ptr"), F.least("label", "a_label").alias("label"), (F.col("a_label") < F.col("label")).alias("moved")),
            f"cycle{step}",
        )
        if state.where("moved").isEmpty():
            return state.select("node_id", "label")
        state = state.drop("moved")


def descendant_pairs(tree: DataFrame) -> DataFrame:
    """nested_sets result -> (node_id, descendant_id, steps): every node above or equal to another, itself left out.

    The output has one row per node and ancestor (the sum of the depths); nothing larger is formed on the way.
    """
    up = tree.where("depth > 0").select(F.col("node_id").alias("descendant_id"), "depth", F.posexplode("path").alias("pos", "node_id"))
    return up.where("pos < depth").select("node_id", "descendant_id", (F.col("depth") - F.col("pos")).cast("int").alias("steps"))
