"""Continuous ingestion of new commits: the replay's memory as keyed state and tables instead of one pass over all history."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import model as M
from ..operators.fold import replay

VERSIONS = "function_id string, state_id string, previous string, version long"


class VersionChain(StatefulProcessor):
    """Per function the latest state so far: each new state gets its predecessor and number."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "state_id string, version long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["commit_seq", "file_seq", "seq"])
        previous, version = self.last.get() if self.last.exists() else (None, 0)
        out = []
        for state in new["state_id"]:
            version += 1
            out.append((key[0], state, previous, version))
            previous = state
        self.last.update((previous, version))
        yield pd.DataFrame(out, columns=["function_id", "state_id", "previous", "version"])

    def close(self) -> None:
        pass


def version_stream(states: DataFrame) -> DataFrame:
    """A stream of states (function_id, state_id, commit_seq, file_seq, seq) with the state before each."""
    return states.groupBy("function_id").transformWithStateInPandas(VersionChain(), VERSIONS, "append", "none")


class GraphTable:
    """A graph kept as Parquet and brought up to date with each batch of commits.

    The log is the only state: a batch is appended to it once (by its commits), and the graph is replayed from it, so that
    a batch that is repeated after a failure changes nothing.
    """

    def __init__(self, folder: str):
        self.folder = folder

    def log(self, spark) -> DataFrame:
        return spark.read.schema(M.COMMITS_RAW).parquet(f"{self.folder}/log")

    def append(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        try:
            known = self.log(spark).select("hexsha").distinct()
            new = batch.join(known, "hexsha", "left_anti").select(*batch.columns)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            new = batch
        new.write.mode("append").parquet(f"{self.folder}/log")

    def graph(self, spark) -> M.Graph:
        return replay(self.log(spark))

    def start(self, commits: DataFrame, checkpoint: str, **trigger):
        """Follow a stream of commits_raw."""
        return commits.writeStream.foreachBatch(self.append).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def first_edges(stream: DataFrame) -> DataFrame:
    """A stream of edges with repeated (from, label, to) dropped."""
    return stream.dropDuplicates(["from_id", "label", "to_id"])


def status_counts(states: DataFrame) -> DataFrame:
    """Active and superseded states: one active state per function."""
    return states.groupBy("function_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("active"), (F.coalesce(F.sum("n"), F.lit(0)) - F.count("*")).alias("superseded"))
