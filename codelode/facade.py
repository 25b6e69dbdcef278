"""One object with the questions that a user asks of an analysed repository; each answer is a DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode import schemas as S
from codelode.functions import scalars as X
from codelode.operators import chunking, graph, parse, partitioning, search, stats, store, tasks, textindex
from codelode.session import importable
from codelode.sources import files as file_source
from codelode.sources import git


class Analysis:
    """Questions over a store of entities. embedder: from texts to a matrix; the default is offline."""

    def __init__(self, spark: SparkSession, root: str, embedder=None):
        self.spark, self.store, self.embedder = importable(spark), store.Store(spark, root), embedder

    # --- ingestion --------------------------------------------------------------------------------

    def analyze_branch(self, folder: str, repo_id: int, branch: str, repo_uuid: str = "00000000", incremental: bool = True) -> dict[str, int]:
        """Reads a working tree into the store's tables; says how many files were parsed and how many chunks embedded."""
        return self.ingest(file_source.scan(self.spark, folder, repo_id, branch), repo_id, branch, repo_uuid, incremental)

    def ingest(self, scanned: DataFrame, repo_id: int, branch: str, repo_uuid: str = "00000000", incremental: bool = True) -> dict[str, int]:
        """As analyze_branch, for files from anywhere (the columns of files.scan).

        With incremental, only files whose content isn't known at their path are parsed and cut; edges are those before, less
        those of files that changed, with those that the change brings; a chunk whose stretch of the same content is known, at
        whatever path, keeps its embedding. All is made and written aside before the first entity is replaced.
        """
        file_key = ["repo_id", "branch", "relative_path"]
        with self.store.staged() as stage:
            found = stage.keep("found", file_source.file_rows(scanned))
            known = self._known("files", repo_id, branch) if incremental else None
            old = {e: self._known(e, repo_id, branch) for e in ("nodes", "chunks", "edges")} if known is not None else {}
            old = old if all(v is not None for v in old.values()) else {}
            fresh, same = (store.changed(found, known), found.join(known.select(*file_key, "blob_hash"), [*file_key, "blob_hash"], "left_semi").select(*file_key)) if old else (found, found.select(*file_key).limit(0))
            fresh, same = stage.keep("fresh", fresh), stage.keep("same", same)
            new_nodes = stage.keep("new_nodes", parse.parse_files(fresh))
            new_calls = parse.calls_of(new_nodes)
            made = chunking.chunks(new_nodes, fresh)
            if old:
                kept_nodes = old["nodes"].select(*new_nodes.columns).join(same, file_key, "left_semi")
                gone = old["nodes"].join(same, file_key, "left_anti")
                # calls of other files matter where they name what a changed file defines
                names = graph.definitions(new_nodes).select("repo_id", "branch", F.col("name").alias("_name")).where("_name is not null").distinct()
                calling = kept_nodes.where(F.col("node_type").isin(*S.CALL_TYPES)).withColumn("_name", X.last_segment("name")).join(names, ["repo_id", "branch", "_name"], "left_semi").select(*file_key).distinct()
                kept_calls = parse.calls_of(kept_nodes.join(calling, file_key, "left_semi"))
                edges = graph.edges_after(old["edges"], gone, kept_calls, new_calls, kept_nodes, new_nodes)
                nodes = kept_nodes.unionByName(new_nodes)
                made = stage.keep("made", chunking.reused(made, old["chunks"]))
            else:
                nodes, edges = new_nodes, graph.call_edges(new_calls, new_nodes)
                made = stage.keep("made", made.withColumn("embedding", F.lit(None).cast("array<float>")))
            columns = [c.split()[0] for c in S.CHUNKS.split(", ")]
            to_embed = made.where("embedding is null").select("chunk_id", *file_key, "start_char", "end_char").join(fresh.select(*file_key, "content"), file_key)
            text = to_embed.select("chunk_id", X.slice_content("content", "start_char", "end_char").alias("content"))
            vectors = stage.keep("vectors", search.embed(text, self.embedder, "chunk_id") if self.embedder else search.hashed_embedding(text))
            made = made.join(vectors.withColumnRenamed("embedding", "_new"), "chunk_id", "left").withColumn("embedding", F.coalesce("embedding", "_new"))
            chunks = made.withColumn("metadata", F.lit(None).cast("map<string,string>")).select(*columns)
            if old:
                chunks = old["chunks"].select(*columns).join(same, file_key, "left_semi").select(*columns).unionByName(chunks)
            chunks = stage.keep("chunks", chunks)
            parts = partitioning.partition_map(found.select("relative_path", "size"), repo_uuid)
            counts = chunks.groupBy("relative_path").agg(F.count("*").alias("chunk_count"))
            rows = found.join(parts, "relative_path").join(counts, "relative_path", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))
            entities = {
                "blobs": file_source.blobs(found), "chunks": chunks, "edges": stage.keep("edges", edges),
                "files": stage.keep("files", rows.select(*[c.split()[0] for c in S.FILES.split(", ")])), "nodes": stage.keep("nodes", nodes),
            }
            # a branch that has lost its last row of an entity must not keep the old ones
            for entity, frame in entities.items():
                self.store.replace(entity, frame, repo_id, branch)
            return {"files_parsed": fresh.count(), "chunks_embedded": vectors.count()}

    # --- repositories, tasks and usage ------------------------------------------------------------

    def add_repository(self, path: str, name: str | None = None, git_remote: str | None = None, active_branch: str = "main") -> int:
        """The id of the repository at a path, which is added if it isn't known."""
        import time
        import uuid

        known = self.list_repositories().where(F.col("path") == path).select("repo_id").head(1)
        if known:
            return known[0][0]
        one = [(time.time_ns(), str(uuid.uuid4()), path, name or path.rstrip("/").rsplit("/", 1)[-1], git_remote, active_branch)]
        rows = self.spark.createDataFrame(one, "repo_id long, uuid string, path string, name string, git_remote string, active_branch string")
        rows = rows.withColumn("created_at", F.current_timestamp()).withColumn("last_scanned", F.lit(None).cast("timestamp"))
        self.store.append("repositories", rows.select(*[c.split()[0] for c in S.REPOSITORIES.split(", ")]))
        return one[0][0]

    def list_repositories(self) -> DataFrame:
        """Repositories by name."""
        return self._log("repositories", S.REPOSITORIES).orderBy("name", "repo_id")

    def start_task(self, repo_id: int, name: str, created_by: str = "user", parent_id: int | None = None) -> int:
        """Logs that a task began, and returns its id."""
        import time

        task_id = time.time_ns()
        about = {"repo_id": str(repo_id), "name": name, "created_by": created_by} | ({"parent_id": str(parent_id)} if parent_id is not None else {})
        self.store.append("task_log", tasks.event(self.spark, task_id, "running", None, 0.0, about))
        return task_id

    def update_task(self, task_id: int, message: str | None = None, progress: float | None = None, details: dict[str, str] | None = None) -> None:
        self.store.append("task_log", tasks.event(self.spark, task_id, None, message, progress, details))

    def complete_task(self, task_id: int, error: str | None = None) -> None:
        self.store.append("task_log", tasks.event(self.spark, task_id, "failed" if error else "completed", error, None, None))

    def get_tasks(self) -> DataFrame:
        """All tasks with their state, from the log."""
        own = lambda k, kind: F.col("details")[k].cast(kind).alias(k)
        return tasks.task_state(self._log("task_log", tasks.LOG)).select("*", own("repo_id", "long"), own("parent_id", "long"), own("name", "string"), own("created_by", "string"))

    def get_task_history(self, repo_id: int, offset: int = 0, limit: int = 20) -> DataFrame:
        return tasks.history(self.get_tasks(), repo_id, offset, limit)

    def get_latest_task(self, repo_id: int) -> DataFrame:
        return tasks.latest_task(self.get_tasks().where(F.col("repo_id") == repo_id))

    def get_usage_statistics(self, billing: DataFrame) -> DataFrame:
        """One row: repositories, files and lines analysed, and the totals of billing."""
        files = self._log("files", S.FILES)
        return stats.usage_statistics(self.list_repositories(), files, billing)

    def get_database_size(self) -> str:
        return self.spark.range(1).select(X.format_bytes(F.lit(self.store.size()))).first()[0]

    def _log(self, entity: str, schema: str) -> DataFrame:
        return self.store.read(entity, schema) if self.store.exists(entity) else self.spark.createDataFrame([], schema)

    def _known(self, entity: str, repo_id: int, branch: str) -> DataFrame | None:
        if not self.store.exists(entity):
            return None
        return self.of(entity, repo_id, branch)

    def of(self, entity: str, repo_id: int, branch: str) -> DataFrame:
        """An entity's rows of one branch; partitions of others aren't read."""
        return self.store.read(entity, file_source.SCHEMAS[entity]).where((F.col("repo_id") == repo_id) & (F.col("branch") == branch))

    # --- questions --------------------------------------------------------------------------------

    def get_repository_statistics(self, repo_id: int, branch: str) -> DataFrame:
        return stats.repository_stats(self.of("files", repo_id, branch), self.of("chunks", repo_id, branch))

    def find_dead_code(self, repo_id: int, branch: str, strict_types: bool = False) -> DataFrame:
        return graph.dead_code(self.of("nodes", repo_id, branch), self.of("edges", repo_id, branch), S.OUTLINE_TYPES if strict_types else S.DEFINITION_TYPES)

    def find_duplicate_code(self, repo_id: int, branch: str, similarity_threshold: float = S.DUPLICATE_SIMILARITY, top_k: int | None = S.DUPLICATE_TOP_K) -> DataFrame:
        """Pairs of near copies, with the path, lines and content of both."""
        chunks = self.of("chunks", repo_id, branch)
        pairs = search.duplicate_pairs(chunks, similarity_threshold, top_k)
        return search.with_places(pairs, chunks, self.of("files", repo_id, branch), self.of("blobs", repo_id, branch))

    def get_code_graph_analysis(self, repo_id: int, branch: str, k: int = 5) -> DataFrame:
        return graph.central_nodes(self.of("nodes", repo_id, branch), self.of("edges", repo_id, branch), k)

    def find_symbol_definition(self, repo_id: int, branch: str, name: str) -> DataFrame:
        return graph.symbol_definition(self.of("nodes", repo_id, branch), self.of("files", repo_id, branch), name, S.DEFINITION_TYPES)

    def find_symbol_references(self, repo_id: int, branch: str, name: str) -> DataFrame:
        return graph.symbol_references(self.of("nodes", repo_id, branch), self.of("edges", repo_id, branch), name)

    def get_file_outline(self, repo_id: int, branch: str, path: str) -> DataFrame:
        return graph.file_outline(self.of("nodes", repo_id, branch), path)

    def get_call_hierarchy(self, repo_id: int, branch: str, name: str, depth: int = 3, callers: bool = False) -> DataFrame:
        roots = graph.definitions(self.of("nodes", repo_id, branch)).where(F.col("name") == name)
        return graph.call_hierarchy(self.of("edges", repo_id, branch), roots, depth, callers)

    def analyze_file_dependencies(self, repo_id: int, branch: str, path: str | None = None) -> DataFrame:
        d = graph.file_dependencies(self.of("nodes", repo_id, branch), self.of("edges", repo_id, branch))
        return d if path is None else d.where((F.col("from_file") == path) | (F.col("to_file") == path))

    def list_files_in_repository(self, repo_id: int, branch: str, prefix: str = "") -> DataFrame:
        return partitioning.list_dir(self.of("files", repo_id, branch), prefix)

    def get_file_content(self, repo_id: int, branch: str, path: str) -> DataFrame:
        f = self.of("files", repo_id, branch).where(F.col("relative_path") == path)
        return f.join(self.of("blobs", repo_id, branch), ["repo_id", "branch", "blob_hash"]).select("relative_path", "content")

    def text_index(self) -> textindex.TextIndex:
        return textindex.TextIndex(self.spark, self.store.path("text_index"))

    def index_text(self, repo_id: int, branch: str) -> None:
        """Adds a branch's contents to the text index; those that it knows are left alone."""
        self.text_index().update(self.of("blobs", repo_id, branch))

    def search_indexed_text(self, repo_id: int, branch: str, words: Sequence[str]) -> DataFrame:
        """As search_files_for_text, by the text index; only contents that it doesn't know yet are all read."""
        index, files = self.text_index(), self.of("files", repo_id, branch)
        rest = files.join(index.known(), "blob_hash", "left_anti").join(self.of("blobs", repo_id, branch), ["repo_id", "branch", "blob_hash"])
        return textindex.fulltext(index, files, words).unionByName(search.fulltext(rest, words)).orderBy("relative_path")

    def search_files_for_text(self, repo_id: int, branch: str, words: Sequence[str]) -> DataFrame:
        text = self.of("files", repo_id, branch).join(self.of("blobs", repo_id, branch), ["repo_id", "branch", "blob_hash"])
        return search.fulltext(text, words).orderBy("relative_path")

    def search_code(self, repo_id: int, branch: str, text: str, top_k: int = S.SEARCH_TOP_K) -> DataFrame:
        """The chunks nearest to a symbol's name or a snippet."""
        one = self.spark.createDataFrame([("q", text)], "chunk_id string, content string")
        q = (search.embed(one, self.embedder) if self.embedder else search.hashed_embedding(one)).first()["embedding"]
        chunks = self.of("chunks", repo_id, branch)
        return search.vector_topk(chunks, q, top_k).join(chunks.select("chunk_id", "relative_path", "start_line", "end_line"), "chunk_id")

    def get_file_ast(self, repo_id: int, branch: str, path: str) -> DataFrame:
        return graph.nested_trees(self.of("nodes", repo_id, branch).where(F.col("relative_path") == path))

    def get_git_status(self, folder: str) -> DataFrame:
        return git.status(self.spark, folder)

    def list_repository_branches(self, folder: str) -> DataFrame:
        return git.branches(self.spark, folder)

