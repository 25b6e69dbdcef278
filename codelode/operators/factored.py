"""The call graph as two tables that a name joins, in place of the edges between them.

A name that a definitions bear and b callers call stands for a x b edges. Here it is a + b rows: who calls which name,
and who bears it. Counts, dead code, references, centrality and reach follow from these; edges are made on
demand. Every answer equals that of operators.graph over call_edges.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode import schemas as S
from codelode.functions import scalars as X
from codelode.operators import graph
from codelode.operators.graph import KEY
from codelode.session import cut

NAME = [*KEY, "name"]


@dataclass(frozen=True)
class CallGraph:
    """called: repo_id, branch, caller, name, each once; named: repo_id, branch, name, node_id of what a call may lead to."""

    called: DataFrame
    named: DataFrame

    def sizes(self) -> DataFrame:
        """name, callers and definitions of every name that has both."""
        callers = self.called.groupBy(*NAME).agg(F.count("*").alias("callers"))
        return callers.join(self.named.groupBy(*NAME).agg(F.count("*").alias("definitions")), NAME)

    def edge_count(self) -> DataFrame:
        """repo_id, branch and edges: how many edges there are, without making them."""
        return self.sizes().groupBy(*KEY).agg(F.sum(F.col("callers") * F.col("definitions")).alias("edges"))

    def edges(self) -> DataFrame:
        """All edges: repo_id, branch, caller, callee."""
        return self.called.join(self.named.withColumnRenamed("node_id", "callee"), NAME).select(*KEY, "caller", "callee")

    def incoming(self, nodes: DataFrame) -> DataFrame:
        """nodes with calls_in: a definition's incoming edges are as many as its name has callers."""
        callers = self.called.groupBy(*NAME).agg(F.count("*").alias("_n"))
        of = self.named.join(callers, NAME).select(*KEY, "node_id", F.col("_n").alias("calls_in"))
        return nodes.join(of, [*KEY, "node_id"], "left").withColumn("calls_in", F.coalesce("calls_in", F.lit(0)))

    def outgoing(self) -> DataFrame:
        """repo_id, branch, node_id, calls_out of every caller that reaches a definition."""
        borne = self.named.groupBy(*NAME).agg(F.count("*").alias("_n"))
        return self.called.join(borne, NAME).groupBy(*KEY, F.col("caller").alias("node_id")).agg(F.sum("_n").alias("calls_out"))

    def central_nodes(self, nodes: DataFrame, k: int = 5) -> DataFrame:
        """The k nodes with the most incoming edges, ties by node_id."""
        return self.incoming(nodes).orderBy(F.desc("calls_in"), "node_id").limit(k)

    def dead_code(self, nodes: DataFrame, types: Sequence[str] = S.DEFINITION_TYPES) -> DataFrame:
        """Definitions that nothing calls, with the reason."""
        alive = self.named.join(self.called, NAME, "left_semi").select(*KEY, "node_id")
        return graph.definitions(nodes, types).join(alive, [*KEY, "node_id"], "left_anti").withColumn("analysis_reason", F.lit("No incoming calls found"))

    def references(self, nodes: DataFrame, name: str, types: Sequence[str] = S.DEFINITION_TYPES) -> DataFrame:
        """The nodes that call a definition of the name, each once."""
        borne = self.named.where(F.col("name") == name).join(graph.definitions(nodes, types).select(*KEY, "node_id"), [*KEY, "node_id"], "left_semi")
        callers = self.called.where(F.col("name") == name).join(borne, NAME, "left_semi").select(*KEY, F.col("caller").alias("node_id"))
        return nodes.join(callers, [*KEY, "node_id"], "left_semi")

    def file_dependencies(self, nodes: DataFrame) -> DataFrame:
        """from_file, to_file, calls: how many edges lead from one file to another one, from what each file calls and bears of a name."""
        of = nodes.select(*KEY, "node_id", "relative_path")
        calls = self.called.join(of.withColumnRenamed("node_id", "caller"), [*KEY, "caller"]).groupBy(*NAME, F.col("relative_path").alias("from_file")).agg(F.count("*").alias("_a"))
        borne = self.named.join(of, [*KEY, "node_id"]).groupBy(*NAME, F.col("relative_path").alias("to_file")).agg(F.count("*").alias("_b"))
        return calls.join(borne, NAME).where("from_file <> to_file").groupBy(*KEY, "from_file", "to_file").agg(F.sum(F.col("_a") * F.col("_b")).alias("calls"))

    def hierarchy(self, roots: DataFrame, depth: int | None = 3, callers: bool = False) -> DataFrame:
        """root, node_id, level: what the roots reach over calls in at most depth steps (all, if None), by the fewest steps.

        A step leads from nodes to names and from names to nodes, and a root takes each name once, so
        that it costs the rows of both tables and not their product. Cycles end. With callers, steps are followed backwards.
        """
        out, into = self.called.select(*NAME, F.col("caller").alias("node_id")), self.named.select(*NAME, "node_id")
        if callers:
            out, into = into, out
        level = seen = cut(roots.select(*KEY, F.col("node_id").alias("root"), "node_id", F.lit(0).alias("level")))
        met = None
        for i in itertools.count(1) if depth is None else range(1, depth + 1):
            names = level.join(out, [*KEY, "node_id"]).select(*KEY, "root", "name").distinct()
            names = cut(names.join(met, [*KEY, "root", "name"], "left_anti") if met is not None else names)
            met = names if met is None else met.unionByName(names)
            reached = names.join(into, NAME).select(*KEY, "root", "node_id").distinct()
            level = cut(reached.join(seen, [*KEY, "root", "node_id"], "left_anti").withColumn("level", F.lit(i)))
            if level.isEmpty():
                break
            seen = seen.unionByName(level)
        return seen


def call_graph(calls: DataFrame, nodes: DataFrame, types: Sequence[str] = S.EDGE_TARGET_TYPES) -> CallGraph:
    """The graph of calls to definitions of the given types; names without a definition stay in called and count for nothing."""
    called = calls.select(*KEY, "caller", X.last_segment("called_name").alias("name")).where("caller is not null and name is not null").distinct()
    return CallGraph(called, graph.definitions(nodes, types).where("name is not null").select(*NAME, "node_id").distinct())
