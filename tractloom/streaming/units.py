"""Tables of finished units of work: a unit's data counts only once its commit record is written.

A unit (a micro-batch, a state and year, a run of lookups) writes its data to a folder of its own and then one record that
names the folder. Readers follow records and never look at folders without one, so an attempt that died between two files
leaves nothing behind that counts. Running the unit again writes another folder and replaces the record.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

RECORD = "unit string, folder string, info string, replaces array<string>"


@dataclass(frozen=True)
class Record:
    unit: str
    folder: str
    info: dict
    replaces: tuple[str, ...]


class Units:
    """The units below one path. Record files are small and few: one per unit, fewer after ``compact``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, unit: str, parts: dict[str, DataFrame], info: dict | None = None, partition_by: str | None = None, replaces: tuple[str, ...] = ()) -> Record:
        """Write the named tables of a unit, then its record. An earlier attempt or record of the unit is superseded."""
        folder = f"data/{unit}-{os.urandom(6).hex()}"
        for name, df in parts.items():
            writer = df.write.mode("errorifexists")
            (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{self.path}/{folder}/{name}")
        record = Record(unit, folder, info or {}, tuple(replaces))
        row = [(unit, folder, json.dumps(record.info), list(replaces))]
        self.spark.createDataFrame(row, RECORD).coalesce(1).write.mode("overwrite").json(f"{self.path}/units/{unit}")
        return record

    def records(self) -> list[Record]:
        """Finished units that no compacted unit has replaced, by name."""
        try:
            rows = self.spark.read.schema(RECORD).option("recursiveFileLookup", "true").json(f"{self.path}/units").collect()
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        found = [Record(r["unit"], r["folder"], json.loads(r["info"]), tuple(r["replaces"] or ())) for r in rows]
        gone = {u for r in found for u in r.replaces}
        return sorted((r for r in found if r.unit not in gone), key=lambda r: r.unit)

    def folders(self, part: str, records: list[Record] | None = None) -> list[str]:
        return [f"{self.path}/{r.folder}/{part}" for r in (self.records() if records is None else records)]

    def read(self, part: str, schema, records: list[Record] | None = None) -> DataFrame:
        """One table over all finished units; empty if there is none."""
        folders = self.folders(part, records)
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders)

    def compact(self, unit: str, merge: dict[str, tuple[object, Callable[[DataFrame], DataFrame]]], info: Callable[[list[Record]], dict] = lambda r: {}) -> None:
        """Merge all units but the newest, which may still be run again, into one. ``merge`` has schema and merger of each part."""
        old = self.records()[:-1]
        if len(old) > 1:
            parts = {part: merger(self.read(part, schema, old)) for part, (schema, merger) in merge.items()}
            self.write(unit, parts, info(old), replaces=tuple(u for r in old for u in (r.unit, *r.replaces)))
