"""Queries over artifact and version graphs as joins, and closures by frontier joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tips(versions: DataFrame, parents: DataFrame) -> DataFrame:
    """Versions that are no version's parent."""
    return versions.join(parents.select(F.col("parent_id").alias("version_id")), "version_id", "left_anti")


def sources(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.col("dependent").alias("node")), "node", "left_anti")


def sinks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.col("source").alias("node")), "node", "left_anti")


def neighbors(edges: DataFrame, nodes: DataFrame, direction: str = "both", **relation: str) -> DataFrame:
    """node, neighbor along edges(source, dependent, ..) that have the given relation; both directions are two
    equi-joins, not one with an OR."""
    for k, v in relation.items():
        edges = edges.where(F.col(k) == v)
    out = edges.select(F.col("source").alias("node"), F.col("dependent").alias("neighbor")).join(nodes, "node", "left_semi")
    into = edges.select(F.col("dependent").alias("node"), F.col("source").alias("neighbor")).join(nodes, "node", "left_semi")
    return {"out": out, "in": into}.get(direction, out.union(into)).distinct()


def parents(edges: DataFrame, versions: DataFrame) -> DataFrame:
    """version_id, parent_id of each of versions(version_id) along edges(parent_id, version_id)."""
    found = neighbors(edges.select(F.col("parent_id").alias("source"), F.col("version_id").alias("dependent")), versions.select(F.col("version_id").alias("node")), "in")
    return found.select(F.col("node").alias("version_id"), F.col("neighbor").alias("parent_id"))


def partitioning(versions: DataFrame, relations: DataFrame) -> DataFrame:
    """version_id and the version that partitions it: itself where ``self_partitioning``, else the first source of its
    Partitioning relation, else null. relations(source, dependent, name)."""
    by = relations.where("name = 'Partitioning'").groupBy(F.col("dependent").alias("version_id")).agg(F.min("source").alias("by"))
    return versions.join(by, "version_id", "left").select("version_id", F.when(F.col("self_partitioning"), F.col("version_id")).otherwise(F.col("by")).alias("partitioning"))


def first_parents(at: DataFrame, edges: DataFrame, keep=lambda df: df) -> DataFrame:
    """``at`` (version_id, steps and other columns) with version_id moved ``steps`` first parents up, as ``~n`` asks;
    null beyond the first version. edges(parent_id, version_id); of several parents the smallest is the first. A join per
    step of the longest walk, over the rows that still move."""
    first = edges.groupBy("version_id").agg(F.min("parent_id").alias("up"))
    done, rest = [], keep(at)
    while True:
        done.append(rest.where("steps <= 0 or version_id is null"))
        moving = rest.where("steps > 0 and version_id is not null")
        if moving.isEmpty():
            break
        moved = moving.join(first, "version_id", "left").withColumn("version_id", F.col("up")).withColumn("steps", F.col("steps") - 1)
        rest = keep(moved.select(*at.columns))
    return reduce(DataFrame.union, done).drop("steps")


def resolve(specs: DataFrame, tips: DataFrame, edges: DataFrame, keep=lambda df: df) -> DataFrame:
    """spec and version_id for parsed specs(spec, branch, path, revision_offset): the tip that tips(branch, path,
    version_id) has for it, ``-revision_offset`` first parents up. Specs that name none, or go beyond the first
    version, are left out."""
    at = specs.join(tips.select("branch", "path", "version_id"), ["branch", "path"]).select("spec", "version_id", (-F.col("revision_offset")).alias("steps"))
    return first_parents(at, edges, keep).where("version_id is not null")


def with_prefix(versions: DataFrame, prefix: str, column: str = "uuid") -> DataFrame:
    """Versions whose id starts with ``prefix``, whatever the case."""
    return versions.where(F.lower(column).startswith(prefix.lower()))


def components(nodes: DataFrame, edges: DataFrame, keep=lambda df: df) -> DataFrame:
    """node, component (its smallest member) of nodes(node) and edges(source, dependent), directions ignored. Each
    round points every node at its smallest neighbour and contracts the graph onto the nodes pointed at."""
    live = keep(edges.where("source <> dependent").select(F.col("source").alias("a"), F.col("dependent").alias("b")).distinct())
    steps = []
    while not live.isEmpty():
        both = live.union(live.select("b", "a"))
        to = keep(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("to")))
        up = to.select(F.col("node").alias("to"), F.col("to").alias("top"))
        to = keep(to.join(up, "to", "left").select("node", F.coalesce("top", "to").alias("to")))
        steps.append(to)
        left, right = (to.select(F.col("node").alias(c), F.col("to").alias(f"to_{c}")) for c in "ab")
        live = keep(live.join(left, "a").join(right, "b").where("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct())
    roots = None
    for to in reversed(steps):
        roots = to.withColumnRenamed("to", "component") if roots is None else to.join(roots.select(F.col("node").alias("to"), "component"), "to", "left").select("node", F.coalesce("component", "to").alias("component"))
    every = nodes.select("node").distinct()
    return every.withColumn("component", F.col("node")) if roots is None else every.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def common_ancestors(pairs: DataFrame, edges: DataFrame, keep=lambda df: df, deep: int = 64) -> DataFrame:
    """a, b, ancestor: the lowest common ancestors of pairs(a, b), those that lead to no other common one. A version
    is its own ancestor. edges(source, dependent) lead away from ancestors.

    Each round moves every pair's nodes of the highest level up to their parents, marked by the ends that they were
    reached from (1, 2) and by whether a common ancestor leads to them (4). No other node of the pair leads to those, so
    their marks are final. A pair ends when no node is left that could be lowest, mostly long before the roots, so
    closures are not needed. In graphs of over ``deep`` levels, and on cycles, they are used instead."""
    pairs, edges = pairs.select("a", "b").distinct(), keep(edges.select("source", "dependent").distinct())
    try:
        nodes = edges.select(F.explode(F.array("source", "dependent")).alias("node")).union(pairs.select(F.explode(F.array("a", "b"))))
        levels = keep(topo_levels(nodes, edges, keep, deep))
    except ValueError:
        return common_ancestors_by_closure(pairs, edges, closure(edges, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), True, keep))
    up = keep(edges.select(F.col("dependent").alias("node"), F.col("source").alias("up")).join(levels.select(F.col("node").alias("up"), F.col("level").alias("up_level")), "up"))
    ends = pairs.select("a", "b", F.inline(F.array(*(F.struct(F.col(c).alias("node"), F.lit(m).alias("mark")) for c, m in (("a", 1), ("b", 2))))))
    reached, found, of_pair = ends.join(levels, "node").select("a", "b", "node", "level", "mark"), [], Window.partitionBy("a", "b")
    while True:
        marked = reached.repartition("a", "b").groupBy("a", "b", "node", "level").agg(F.bit_or("mark").alias("mark"))
        state = marked.select("*", F.max("level").over(of_pair).alias("top"), F.min("mark").over(of_pair).alias("least"), F.bit_or("mark").over(of_pair).alias("ends"))
        # All marked 7: none can be lowest any more; all 1 or all 2: none can be common.
        live = keep(state.where("least < 7 and ends >= 3").select("a", "b", "node", "level", "mark", "top"))
        if live.isEmpty():
            return reduce(DataFrame.union, [*found, live.where("false").select("a", "b", F.col("node").alias("ancestor"))])
        found.append(live.where("level = top and mark = 3").select("a", "b", F.col("node").alias("ancestor")))
        above = live.where("level = top").join(up, "node").select("a", "b", F.col("up").alias("node"), F.col("up_level").alias("level"), F.when(F.col("mark") >= 3, 7).otherwise(F.col("mark")).alias("mark"))
        reached = live.where("level < top").select("a", "b", "node", "level", "mark").union(above)


def common_ancestors_by_closure(pairs: DataFrame, edges: DataFrame, ancestors: DataFrame) -> DataFrame:
    """common_ancestors() from a closure ancestors(node, reached). All ancestors of a common one are common too, so those
    that another leads to are the parents of common ones."""
    every = ancestors.union(pairs.select(F.explode(F.array("a", "b")).alias("node")).withColumn("reached", F.col("node"))).distinct()
    both = pairs.join(every.select(F.col("node").alias("a"), F.col("reached").alias("ancestor")), "a").join(every.select(F.col("node").alias("b"), F.col("reached").alias("ancestor")), ["b", "ancestor"]).select("a", "b", "ancestor")
    above = both.join(edges.select(F.col("dependent").alias("ancestor"), F.col("source").alias("up")), "ancestor").select("a", "b", F.col("up").alias("ancestor"))
    return both.join(above, ["a", "b", "ancestor"], "left_anti")


def description_validity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph, independent, valid_payload, valid_state of descriptions: nodes(graph, node, existing, id) and edges(graph,
    source, dependent). Independent: without existing nodes. A valid payload: every new node has an id and no edge leads
    to an existing one. A valid state is both."""
    own = nodes.groupBy("graph").agg(F.bool_and(~F.col("existing")).alias("independent"), F.bool_and(F.col("existing") | F.col("id").isNotNull()).alias("ids"))
    target = nodes.select("graph", F.col("node").alias("dependent"), "existing")
    into = edges.join(target, ["graph", "dependent"]).groupBy("graph").agg(F.bool_or("existing").alias("into_existing"))
    ok = F.col("ids") & ~F.coalesce("into_existing", F.lit(False))
    return own.join(into, "graph", "left").select("graph", "independent", ok.alias("valid_payload"), (F.col("independent") & ok).alias("valid_state"))


def graph_at(hunks: DataFrame, additions: DataFrame, removals: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a graph (nodes or edges) at a version. hunks(graph, hunk, ord, representation) is its composition, newest
    first down to a state; additions and removals(hunk, *keys) are what each hunk puts in and takes out. A row is
    there if its newest hunk, of those that name it, puts it in. Values are combined before the shuffle."""
    marked = additions.select("hunk", *keys, F.lit(True).alias("there")).unionByName(removals.select("hunk", *keys, F.lit(False).alias("there")))
    rows = marked.join(hunks.select("graph", "hunk", "ord"), "hunk")
    # Of one hunk that does both, the addition holds, as removals come first.
    newest = rows.groupBy("graph", *keys).agg(F.min(F.struct("ord", (~F.col("there")).alias("gone"))).alias("x"))
    return newest.where(~F.col("x.gone")).select("graph", *keys)


def closure(edges: DataFrame, seeds: DataFrame, upward: bool = True, keep=lambda df: df) -> DataFrame:
    """node, reached: everything upstream (or downstream) of each seed(node). In round k what has been reached in less
    than 2 ** k steps meets the paths of 2 ** k steps, which are those of the round before joined with themselves, so
    a chain of length L takes about log2(L) rounds. Ends when a round reaches nothing new, also on cycles.
    ``keep`` cuts lineage of each round, e.g. materialises it in a shared folder."""
    paths = keep(edges.select(F.col("dependent" if upward else "source").alias("at"), F.col("source" if upward else "dependent").alias("reached")).distinct())
    known = keep(paths.join(seeds.select(F.col("node").alias("at")).distinct(), "at", "left_semi").select(F.col("at").alias("node"), "reached"))
    while True:
        onward = paths.select(F.col("at").alias("middle"), F.col("reached").alias("end"))
        paths = keep(paths.join(onward, F.col("reached") == F.col("middle")).select("at", F.col("end").alias("reached")).distinct())
        step = paths.select(F.col("at").alias("middle"), F.col("reached").alias("end"))
        # A seed's own paths of 2 ** k steps, and those that go on from what it has reached.
        own = paths.join(seeds.select(F.col("node").alias("at")).distinct(), "at", "left_semi").select(F.col("at").alias("node"), "reached")
        found = known.join(step, F.col("reached") == F.col("middle")).select("node", F.col("end").alias("reached")).union(own).distinct()
        new = keep(found.join(known, ["node", "reached"], "left_anti"))
        if new.isEmpty():
            return known
        known = keep(known.union(new))


def topo_levels(nodes: DataFrame, edges: DataFrame, keep=lambda df: df, most: int = 1000) -> DataFrame:
    """node, level: the length of the longest path from a source. Round k holds the nodes that a path of k steps leads
    to, and a node's level is the last round it is in. A cycle is an error."""
    nodes = nodes.select("node").distinct()
    fronts, front = [nodes.select("node", F.lit(0).alias("level"))], nodes
    for k in range(1, most + 1):
        front = keep(front.join(edges, front["node"] == edges["source"]).select(F.col("dependent").alias("node")).distinct())
        if front.isEmpty():
            return reduce(DataFrame.union, fronts).groupBy("node").agg(F.max("level").alias("level"))
        fronts.append(front.select("node", F.lit(k).alias("level")))
    raise ValueError("the graph has a cycle, or a path longer than the limit")


def uniform_partitioning(nodes: DataFrame, edges: DataFrame, partitioning) -> DataFrame:
    """Edges that give every node without a partitioning the given one."""
    have = edges.where("name = 'Partitioning'").select(F.col("dependent").alias("node"))
    return nodes.where(F.col("node") != partitioning).join(have, "node", "left_anti").select(F.lit(partitioning).alias("source"), F.col("node").alias("dependent"), F.lit("dtype").alias("edge_type"), F.lit("Partitioning").alias("name"))


def apply_graph_delta(state: DataFrame, additions: DataFrame, removals: DataFrame, key: list[str]) -> DataFrame:
    """State without removals, with additions (a key that is there stays as it is)."""
    left = state.join(removals, key, "left_anti")
    return left.unionByName(additions.join(left, key, "left_anti"))


def graph_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either graph that the other lacks, with ``side``; compares nodes or edges, as given."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def hash_level(nodes: DataFrame, edges: DataFrame, known: DataFrame) -> DataFrame:
    """node, hash of the nodes whose parents all have one in known(node, hash): sorted parent hashes, then the
    node's own ``content``."""
    edges = edges.join(nodes.select(F.col("node").alias("dependent")), "dependent", "left_semi")
    up = edges.join(known.withColumnRenamed("node", "source"), "source", "left").groupBy(F.col("dependent").alias("node")).agg(F.array_join(F.array_sort(F.collect_list("hash")), ",").alias("ph"), F.count("*").alias("n"), F.count("hash").alias("k"))
    return nodes.join(known.select("node"), "node", "left_anti").join(up, "node", "left").where("n is null or n = k").select("node", F.md5(F.concat(F.coalesce("ph", F.lit("")), F.lit("|"), "content")).alias("hash"))


def hashes(nodes: DataFrame, edges: DataFrame, keep=lambda df: df) -> DataFrame:
    """node, hash of every node(node, content), level by level from the sources: each round hashes those whose parents
    all have one. Nodes on or behind a cycle are an error."""
    done: list[DataFrame] = []
    known, left = keep(nodes.select("node", F.col("content").alias("hash")).where("false")), nodes
    while not left.isEmpty():
        level = keep(hash_level(left, edges, known).select("node", "hash"))
        if level.isEmpty():
            raise ValueError("the graph has a cycle")
        done.append(level)
        known, left = reduce(DataFrame.union, done), keep(left.join(level, "node", "left_anti"))
    return known


def latest(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Latest row of each key of an append-only log: the max of a struct, combined before the shuffle."""
    rest = [c for c in log.columns if c not in keys and c not in order]
    top = log.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("x"))
    return top.select(*keys, *(F.col(f"x.{c}").alias(c) for c in [*order, *rest]))
