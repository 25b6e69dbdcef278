"""Questions over definitions, calls and the edges between them.

Nodes, calls and edges carry repo_id and branch, which are part of every key.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelode import schemas as S
from codelode.functions import scalars as X
from codelode.session import cut

KEY = ["repo_id", "branch"]
TASKS_A_CORE = 8  # into which edges are dealt, so that the last ones don't keep the others waiting


def definitions(nodes: DataFrame, types: Sequence[str] = S.DEFINITION_TYPES) -> DataFrame:
    return nodes.where(F.col("node_type").isin(*types))


def call_edges(calls: DataFrame, nodes: DataFrame, types: Sequence[str] = S.EDGE_TARGET_TYPES) -> DataFrame:
    """repo_id, branch, caller, callee: every definition whose name is the last segment of a called name.

    Edges are a set; a name with several definitions links to each. Nothing else is checked.
    """
    named = definitions(nodes, types).where("name is not null").select(*KEY, "name", F.col("node_id").alias("callee"))
    called = calls.select(*KEY, "caller", X.last_segment("called_name").alias("name"))
    return _resolved(called, named)


def _resolved(called: DataFrame, named: DataFrame) -> DataFrame:
    """repo_id, branch, caller, callee of called (caller, name) and named (name, callee), each edge once.

    Edges are the product of both, so they are never dealt out to be made distinct: both sides are, before they meet. Only a node
    of several names can then be met twice by a caller; the edges to such nodes, which are told apart first, are made distinct.

    Both sides are dealt by name to some tasks a core: adaptive execution would merge tasks by what they read, and not by the edges
    that they make. They are merged and not hashed, so that the nodes of a name lie together while its callers pass by.
    """
    tasks = TASKS_A_CORE * called.sparkSession.sparkContext.defaultParallelism
    pairs, one = called.repartition(tasks, "name").distinct(), F.min("name").alias("name")
    by_node = named.groupBy(*KEY, "callee").agg(one, F.max("name").alias("_last"))
    single = pairs.join(by_node.where("name = _last").drop("_last").repartition(tasks, "name").hint("merge"), [*KEY, "name"]).select(*KEY, "caller", "callee")
    several = by_node.where("name <> _last").select(*KEY, "callee")
    more = pairs.join(named.join(several, [*KEY, "callee"], "left_semi"), [*KEY, "name"]).select(*KEY, "caller", "callee").distinct()
    return single.unionByName(more)


def edges_after(edges: DataFrame, gone: DataFrame, kept_calls: DataFrame, new_calls: DataFrame, kept_nodes: DataFrame, new_nodes: DataFrame, types: Sequence[str] = S.EDGE_TARGET_TYPES) -> DataFrame:
    """What call_edges gives after some files have changed, from the edges before.

    gone are the nodes that those files had, new_nodes and new_calls what they have now; kept_calls and kept_nodes are those of
    all other files. Edges of nodes that are gone go; calls that are new are resolved against all names,
    and those that stayed against new definitions only.

    A node belongs to one file. So an edge that stays has both ends in other files, and one that is made an end in a changed
    one: none is met twice, and the edges, which may be many more than nodes and calls, need not be made distinct. Ids of
    changed files that are met now but aren't in gone count as gone, since all their edges are made.
    """
    changed = gone.select(*KEY, "node_id").unionByName(new_calls.select(*KEY, F.col("caller").alias("node_id"))).unionByName(new_nodes.select(*KEY, "node_id"))
    # both columns of an edge are asked about one by one, so that the questions can be put to the sides of a join that makes edges
    ids = changed.distinct()
    stay = edges.select(*KEY, "caller", "callee").join(ids.withColumnRenamed("node_id", "caller"), [*KEY, "caller"], "left_anti").join(ids.withColumnRenamed("node_id", "callee"), [*KEY, "callee"], "left_anti")
    columns = [*KEY, "node_id", "node_type", "name"]
    now = kept_nodes.select(*columns).unionByName(new_nodes.select(*columns))
    made = call_edges(new_calls, now, types).unionByName(call_edges(kept_calls, new_nodes, types))
    return stay.select(*KEY, "caller", "callee").unionByName(made)


def dead_code(nodes: DataFrame, edges: DataFrame, types: Sequence[str] = S.DEFINITION_TYPES) -> DataFrame:
    """Definitions that nothing calls, with the reason."""
    callees = edges.select(*KEY, F.col("callee").alias("node_id"))
    return definitions(nodes, types).join(callees, [*KEY, "node_id"], "left_anti").withColumn("analysis_reason", F.lit("No incoming calls found"))


def symbol_definition(nodes: DataFrame, files: DataFrame, name: str, types: Sequence[str] = S.FIND_DEFINITION_TYPES) -> DataFrame:
    """The definitions of a name with their files."""
    found = definitions(nodes, types).where(F.col("name") == name)
    return found.join(files.select(*KEY, "relative_path", "language"), [*KEY, "relative_path"])


def symbol_references(nodes: DataFrame, edges: DataFrame, name: str, types: Sequence[str] = S.DEFINITION_TYPES) -> DataFrame:
    """The nodes that call a definition of the name, each once."""
    called = definitions(nodes, types).where(F.col("name") == name).select(*KEY, F.col("node_id").alias("callee"))
    callers = edges.join(called, [*KEY, "callee"], "left_semi").select(*KEY, F.col("caller").alias("node_id")).distinct()
    return nodes.join(callers, [*KEY, "node_id"], "left_semi")


def nodes_by_id(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes of the given ids, one per file and start line: the one with the least node_id."""
    found = nodes.join(ids, "node_id", "left_semi")
    first = F.row_number().over(Window.partitionBy(*KEY, "relative_path", "start_line").orderBy("node_id"))
    return found.withColumn("_first", first).where("_first = 1").drop("_first")


def incoming(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """All nodes with calls_in, how many edges end there."""
    n = edges.groupBy(*KEY, F.col("callee").alias("node_id")).agg(F.count("*").alias("calls_in"))
    return nodes.join(n, [*KEY, "node_id"], "left").withColumn("calls_in", F.coalesce("calls_in", F.lit(0)))


def central_nodes(nodes: DataFrame, edges: DataFrame, k: int = 5) -> DataFrame:
    """The k nodes with the most incoming edges, ties by node_id."""
    return incoming(nodes, edges).orderBy(F.desc("calls_in"), "node_id").limit(k)


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: node_count and edge_count."""
    n, e = nodes.agg(F.count("*").alias("node_count")), edges.agg(F.count("*").alias("edge_count"))
    return n.join(e)  # one row each


def file_outline(nodes: DataFrame, path: str, types: Sequence[str] = S.DEFINITION_TYPES) -> DataFrame:
    """A file's top-level definitions by where they start."""
    top = definitions(nodes, types).where((F.col("relative_path") == path) & (F.col("parent_id").isNull() | (F.col("depth") <= 1)))
    return top.orderBy("start_line", "start_column", "node_id")


def call_hierarchy(edges: DataFrame, roots: DataFrame, depth: int = 3, callers: bool = False) -> DataFrame:
    """root, node_id, level: what the roots reach over calls in at most depth steps, by the fewest steps.

    roots has repo_id, branch and node_id. With callers, edges are followed backwards. A level is a
    join with the edges; nodes met before are not followed again, so cycles end.
    """
    source, target = ("callee", "caller") if callers else ("caller", "callee")
    step = edges.select(*KEY, F.col(source).alias("node_id"), F.col(target).alias("next"))
    level = roots.select(*KEY, F.col("node_id").alias("root"), "node_id", F.lit(0).alias("level"))
    level = seen = cut(level)
    for i in range(1, depth + 1):
        reached = level.join(step, [*KEY, "node_id"]).select(*KEY, "root", F.col("next").alias("node_id"), F.lit(i).alias("level")).distinct()
        level = cut(reached.join(seen, [*KEY, "root", "node_id"], "left_anti"))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def file_dependencies(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """from_file, to_file, calls: how many edges lead from one file to another one."""
    of = nodes.select(*KEY, "node_id", "relative_path")
    both = edges.join(of.select(*KEY, F.col("node_id").alias("caller"), F.col("relative_path").alias("from_file")), [*KEY, "caller"]).join(of.select(*KEY, F.col("node_id").alias("callee"), F.col("relative_path").alias("to_file")), [*KEY, "callee"])
    return both.where("from_file <> to_file").groupBy(*KEY, "from_file", "to_file").agg(F.count("*").alias("calls"))


def tree_paths(nodes: DataFrame, depth: int | None = None) -> DataFrame:
    """node_id, level, path (names from the root): the tree that parent_id makes, level by level, down to depth if given.

    Nodes whose parent is missing are roots, as are nodes without a parent. A node has one parent, so what is reached
    from the roots has no cycle; nodes on a cycle are reached by none and have no row.
    """
    n = nodes.select(*KEY, "node_id", "parent_id", "name")
    known = n.select(*KEY, F.col("node_id").alias("parent_id"))
    level = n.where("parent_id is null").unionByName(n.where("parent_id is not null").join(known, [*KEY, "parent_id"], "left_anti").select(*KEY, "node_id", "parent_id", "name"))
    level = level.select(*KEY, "node_id", F.lit(0).alias("level"), F.coalesce("name", F.lit("")).alias("path"))
    out = level = cut(level)
    for i in itertools.count(1) if depth is None else range(1, depth + 1):
        up = level.select(*KEY, F.col("node_id").alias("parent_id"), F.col("path").alias("above"))
        level = cut(n.join(up, [*KEY, "parent_id"]).select(*KEY, "node_id", F.lit(i).alias("level"), F.concat_ws("/", "above", F.coalesce("name", F.lit(""))).alias("path")))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def node_content(nodes: DataFrame, files: DataFrame, blobs: DataFrame) -> DataFrame:
    """Each node's text, cut from its file's blob; null where the offsets don't fit."""
    text = files.select(*KEY, "relative_path", "blob_hash").join(blobs, [*KEY, "blob_hash"]).select(*KEY, "relative_path", "content")
    return nodes.join(text, [*KEY, "relative_path"]).select(*KEY, "node_id", X.slice_content("content", "start_char", "end_char").alias("content"))


def nested_trees(nodes: DataFrame) -> DataFrame:
    """relative_path and tree (JSON): a file's nodes nested by parent, siblings by where they start.

    A file's nodes are gathered in one task; a file is the largest unit that a tree can have.
    """
    import pandas as pd

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        import json

        rows = pdf.sort_values(["start_line", "start_column", "node_id"])
        made = {r.node_id: {"id": r.node_id, "type": r.node_type, "name": r.name_, "start_line": int(r.start_line), "end_line": int(r.end_line), "children": []} for r in rows.itertuples()}
        top = []
        for r in rows.itertuples():
            (made[r.parent_id]["children"] if r.parent_id in made and r.parent_id != r.node_id else top).append(made[r.node_id])
        stack = list(top)
        while stack:
            x = stack.pop()
            x["children_count"] = len(x["children"])
            stack += x["children"]
        first = rows.iloc[0]
        return pd.DataFrame([(first.repo_id, first.branch, first.relative_path, json.dumps(top))], columns=[*KEY, "relative_path", "tree"])

    return nodes.withColumnRenamed("name", "name_").groupBy(*KEY, "relative_path").applyInPandas(build, "repo_id long, branch string, relative_path string, tree string")
