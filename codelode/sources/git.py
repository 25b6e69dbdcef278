"""Git as a data source: format("git") reads a repository's tree, status or branches.

Options: path, table (tree, status or branches), branch. The git program runs in the reading task, so
path must be a folder that executors see.
"""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

_TABLES = {"tree": "relative_path string", "status": "code string, path string", "branches": "branch string"}


def run_git(path: str, *args: str) -> str:
    """The output of git, unstripped. Raises RuntimeError with what git says if it fails."""
    done = subprocess.run(["git", "-C", path, *args], capture_output=True, text=True, encoding="utf-8", errors="replace")
    if done.returncode:
        raise RuntimeError(done.stderr.strip() or f"git {' '.join(args)} failed")
    return done.stdout


class GitSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git"

    def schema(self) -> str:
        return _TABLES[self.options.get("table", "tree")]

    def reader(self, schema) -> DataSourceReader:
        return GitReader(dict(self.options))


class GitReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def read(self, partition):
        path, table = self.options["path"], self.options.get("table", "tree")
        if table == "tree":
            out = run_git(path, "ls-tree", "-r", "--name-only", "-z", self.options.get("branch") or "HEAD").split("\0")
        elif table == "status":
            yield from status_entries(run_git(path, "status", "--porcelain", "-z", "-u"))
            return
        else:
            out = sorted({x[2:].strip() for x in run_git(path, "branch", "--list").split("\n") if "->" not in x})
        yield from ((x,) for x in out if x)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GitSource)


def tree(spark: SparkSession, path: str, branch: str | None = None) -> DataFrame:
    register(spark)
    reader = spark.read.format("git").option("path", path).option("table", "tree")
    return (reader.option("branch", branch) if branch else reader).load()


def branches(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("git").option("path", path).option("table", "branches").load()


def status_entries(out: str) -> Iterator[tuple[str, str]]:
    """(two letters, path) of what git says with -z: paths as they are, and after a renamed or copied one the old path."""
    fields = iter(out.split("\0"))
    for x in fields:
        if x:
            yield x[:2], x[3:]
            if x[0] in "RC" or x[1] in "RC":
                next(fields, None)


def kind_of(code: Column) -> Column:
    """The kind of a change by the first of its two letters: R renamed, blank or M modified, A new, D deleted, ?? untracked. So a new
    file that was changed since (AM) is new, and one that is gone from the tree alone ( D) is modified. Null for others, as conflicts."""
    first = F.substring(code, 1, 1)
    return F.when(first == "R", "renamed").when(first.isin(" ", "M"), "modified").when(first == "A", "new").when(first == "D", "deleted").when(code == "??", "untracked")


def parse_status(lines: DataFrame) -> DataFrame:
    """kind and path (of a renamed file the new one) of status lines as git prints them without -z; other lines are left out."""
    kind, rest = kind_of(F.substring("line", 1, 2)), F.substring(F.col("line"), F.lit(4), F.lit(1 << 30))
    path = F.when(kind == "renamed", F.element_at(F.split(rest, " -> "), -1)).otherwise(rest)
    return lines.select(kind.alias("kind"), path.alias("path")).where("kind is not null")


def status(spark: SparkSession, path: str) -> DataFrame:
    """kind and paths of a working tree's changes."""
    register(spark)
    entries = spark.read.format("git").option("path", path).option("table", "status").load()
    kinds = entries.select(kind_of(F.col("code")).alias("kind"), "path").where("kind is not null")
    return kinds.groupBy("kind").agg(F.array_sort(F.collect_list("path")).alias("paths"))


def diff(path: str, file: str) -> str:
    return run_git(path, "diff", "HEAD", "--", file)


def current_branch(path: str) -> str:
    return run_git(path, "rev-parse", "--abbrev-ref", "HEAD").strip()


def repo_dir(url: str) -> str:
    last = re.sub(r"\.git$", "", url.rstrip("/").split("/")[-1])
    return re.sub(r"[^a-zA-Z0-9_.-]", "_", last)


def clone(url: str, parent: str) -> str:
    """Clones a repository below a folder and returns where it is."""
    run_git(parent, "clone", "--quiet", url, repo_dir(url))
    return f"{parent.rstrip('/')}/{repo_dir(url)}"


def fetch(path: str) -> None:
    run_git(path, "fetch", "--quiet", "--all", "--prune")


def checkout(path: str, branch: str) -> None:
    run_git(path, "checkout", branch)


def stage_all(path: str) -> None:
    run_git(path, "add", "-A")


def commit(path: str, message: str) -> None:
    run_git(path, "commit", "-m", message)


def reset_file(path: str, file: str) -> None:
    run_git(path, "checkout", "HEAD", "--", file)
