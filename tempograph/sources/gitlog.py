"""Commit logs: the relation commits_raw from a git repository or from files."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..model import COMMITS_RAW
from ..workers import importable

#: File names that are never ingested.
SKIPPED = (
    "scalable_ingest.py", "semantic_pass.py", "dump_viz.py", "level_1_parser.py", "ingestion_process.txt", "graph_mcp_server.py", "graph_tools.py",
    "_test_loop.py", "_test_queries.py", "_test_vector.py", "_test_3hop.py", "_test_bench.py",
)
COMMITS_PER_PARTITION = 200


def base_name(path: Column | str) -> Column:
    return F.substring_index(F.col(path) if isinstance(path, str) else path, "/", -1)


def python_files(df: DataFrame, path: str = "path", skipped: tuple = SKIPPED) -> DataFrame:
    return df.where(F.col(path).endswith(".py") & ~base_name(path).isin(*skipped))


def git(folder: str, *args: str) -> bytes:
    return subprocess.run(["git", "-c", "safe.directory=*", "-C", folder, *args], check=True, capture_output=True).stdout


class Commits(InputPartition):
    def __init__(self, start: int, hashes: list[str]):
        self.start, self.hashes = start, hashes


class GitLogReader(DataSourceReader):
    """Partitions are runs of commits, oldest first; each reads its own commits and blobs."""

    def __init__(self, options: dict):
        self.folder, self.branch = options["path"], options.get("branch", "master")
        self.size = int(options.get("commitsPerPartition", COMMITS_PER_PARTITION))

    def partitions(self) -> list[InputPartition]:
        found = git(self.folder, "rev-list", "--reverse", self.branch, "--").decode().split()
        return [Commits(i, found[i : i + self.size]) for i in range(0, len(found), self.size)]

    def read(self, partition: Commits) -> Iterator[tuple]:
        for seq, sha in enumerate(partition.hashes, partition.start):
            head = git(self.folder, "show", "-s", "--format=%P%x00%an%x00%cI%x00%B", sha).decode("utf-8", "replace")
            parents, author, date, msg = head.split("\0", 3)
            first = parents.split()[:1]  # merges are compared with their first parent
            change = ["diff-tree", "-r", "-z", "--name-only", "--no-commit-id", *([first[0], sha] if first else ["--root", sha])]
            paths = [p.decode("utf-8", "replace") for p in git(self.folder, *change).split(b"\0") if p]
            commit = (seq, sha, author, msg.strip(), date.replace("Z", "+00:00"))
            if not paths:
                yield (*commit, None, None, None)
            for k, path in enumerate(paths):
                yield (*commit, k, path, self.blob(sha, path) if path.endswith(".py") else None)

    def blob(self, sha: str, path: str) -> str | None:
        """The file's text; null if the commit deleted it.  Text that isn't UTF-8 is an error."""
        try:
            return git(self.folder, "cat-file", "blob", f"{sha}:{path}").decode("utf-8")
        except subprocess.CalledProcessError:
            return None


class GitLogSource(DataSource):
    """spark.read.format("gitlog").option("branch", ...).load(folder): commits_raw of a git repository that all executors see."""

    @classmethod
    def name(cls) -> str:
        return "gitlog"

    def schema(self):
        return COMMITS_RAW

    def reader(self, schema) -> DataSourceReader:
        return GitLogReader(self.options)


def read_git(spark: SparkSession, folder: str, branch: str = "master") -> DataFrame:
    importable(spark).dataSource.register(GitLogSource)
    return spark.read.format("gitlog").option("branch", branch).load(folder)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """commits_raw written as Parquet."""
    return spark.read.schema(COMMITS_RAW).parquet(path)


def incremental(commits_raw: DataFrame, after_seq: int) -> DataFrame:
    """The commits after a bookmark."""
    return commits_raw.where(F.col("commit_seq") > after_seq)
