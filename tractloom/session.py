"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import SparkSession


def build_session(app: str = "tractloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and skew splitting on. Cluster settings passed in win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    On a cluster it must be set. In local mode, where all tasks share one disk, an unset folder is set once per session.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="tractloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


@dataclass
class Scratch:
    """What a piece of work has written for itself."""

    paths: list[str] = field(default_factory=list)
    tables: list[str] = field(default_factory=list)


_OPEN: list[Scratch] = []


def remove(spark: SparkSession, path: str) -> None:
    """Delete one folder of intermediate files, wherever it lies."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def recording() -> Iterator[Scratch]:
    """Notes the intermediate files and tables made within; ``discard`` removes them."""
    mine = Scratch()
    _OPEN.append(mine)
    try:
        yield mine
    finally:
        _OPEN.remove(mine)


def discard(spark: SparkSession, mine: Scratch) -> None:
    """Remove recorded files and tables. All of them were made by ``fresh_path``; nothing else is touched."""
    for table in mine.tables:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    for path in mine.paths:
        remove(spark, path)
    mine.tables, mine.paths = [], []


def reads_from(df, mine: Scratch) -> bool:
    """Whether a frame still reads recorded files."""
    names = [os.path.basename(p) for p in mine.paths]
    return any(name in file for file in df.inputFiles() for name in names) if names else False


def note_table(name: str) -> None:
    """Have a catalog table dropped with the scratch files of the work at hand."""
    for open_ in _OPEN[-1:]:
        open_.tables.append(name)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path for one job's files under the shared folder."""
    token = os.urandom(6).hex()
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{token}"
    for open_ in _OPEN[-1:]:
        open_.paths.append(path)
    return path


def stored(df, name: str, partition_by: str | None = None):
    """Write an intermediate table once to the shared folder and read it back.

    For tables that several later steps use: each step then reads only its columns, and lost executors cost a re-read
    instead of the whole lineage.
    """
    path = fresh_path(df.sparkSession, name)
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by(df, name: str, key: str, parts: int):
    """Write an intermediate table once, all rows of one key in one of ``parts`` buckets with a file each.

    Groupings, windows and joins that have the key among their own go on with these buckets: each reads its columns and
    moves no row. Rows that are already dealt by the key in as many parts are not dealt again.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    token = os.path.basename(path).replace("-", "_")
    df.repartition(parts, key).write.format("parquet").bucketBy(parts, key).option("path", path).saveAsTable(token)
    note_table(token)
    return spark.table(token)


@contextmanager
def joined_in_parts(spark: SparkSession) -> Iterator[None]:
    """Jobs run within join tables that are dealt alike by some of the join's keys where they lie.

    Spark deals both sides anew by all keys otherwise, as a few of them alone may be skewed.
    """
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)
