"""Commits of several tables at once.

Each change writes new data folders, which nobody reads, and then a manifest that names them: one small file in a folder of its
own, named by its version, which Spark puts there whole or not at all. Readers put together what the manifests name, in the
order of versions. So a change that broke off leaves the former state readable, and its data folders are rubbish. A manifest
also keeps the name of the batch that made it, so that a batch that comes again can be left out, and the highest id given out.

One writer at a time: of two that start from one version the second to commit fails. Empty tables are tables like any other.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

_SCHEMA = "version long, batch string, top long, fresh boolean, whole array<string>, tables map<string,string>"


class CommitError(RuntimeError):
    """Another writer has committed since this one began."""


@dataclass
class State:
    """What the manifests of a folder amount to: its last version (-1: none), the highest id, batches and tables' folders."""

    version: int = -1
    top: int = 0
    batches: set[str] = field(default_factory=set)
    tables: dict[str, list[str]] = field(default_factory=dict)

    def read(self, spark: SparkSession, folder: str, name: str) -> DataFrame:
        return spark.read.parquet(*(f"{folder}/{p}" for p in self.tables[name]))


def _manifests(spark: SparkSession, folder: str) -> list:
    try:  # one row a commit
        return sorted(spark.read.schema(_SCHEMA).option("recursiveFileLookup", True).json(f"{folder}/manifests").collect(), key=lambda r: r.version)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def state(spark: SparkSession, folder: str) -> State:
    found = State()
    for r in _manifests(spark, folder):
        if r.fresh:
            found = State(top=0, batches=found.batches)
        found.version, found.top = r.version, max(found.top, r.top)
        found.batches |= {r.batch} - {None}
        for name, path in r.tables.items():
            found.tables[name] = [path] if name in r.whole else [*found.tables.get(name, []), path]
    return found


def stage(df: DataFrame, folder: str, name: str) -> str:
    """Writes df where no reader looks; gives the place to be named in a commit."""
    path = f"data/{name}-{uuid.uuid4().hex}.parquet"
    df.write.parquet(f"{folder}/{path}")
    return path


def commit(spark: SparkSession, folder: str, begun: State, tables: dict[str, str], top: int, batch: str | None = None, fresh: bool = False, whole: tuple[str, ...] = ()) -> None:
    """Makes staged tables part of the folder: added to what there is, in place of it for tables in `whole`, or as all there
    is (fresh). begun: the state that the writer started from."""
    version = begun.version + 1
    while True:
        row = spark.createDataFrame([(version, batch, top, fresh, list(whole), tables)], _SCHEMA)
        try:
            row.coalesce(1).write.json(f"{folder}/manifests/{version:012d}")
            return
        except AnalysisException as e:
            if e.getCondition() != "PATH_ALREADY_EXISTS":
                raise
            if any(r.version >= version for r in _manifests(spark, folder)):
                raise CommitError(f"version {version} of {folder} is there already") from None
            version += 1  # an empty folder, of a commit that broke off
