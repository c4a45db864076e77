"""Incremental roll-ups, idempotent batch tables, cached lookups and running churn.

Every job keeps its results in ``Units``: a micro-batch is one unit whose record is written after all its data. A batch that
failed half-way therefore leaves nothing behind that counts, and running it again replaces it as a whole.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cohorts import _match
from ..operators.concentration import entity_churn
from ..operators.rollups import application_counts
from ..session import fresh_path
from .units import Record, Units


def read_stream(spark: SparkSession, directory: str, pattern: str, files_per_batch: int | None = None) -> DataFrame:
    """File stream of parquet files; the schema is taken from the files already there."""
    schema = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").parquet(directory).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(directory)


def run_available(df: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Process everything that is there now, batch by batch, and stop."""
    query = (
        df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(handle).start()
    )
    query.awaitTermination()


def batch_name(batch_id: int) -> str:
    """Units of batches sort like their numbers."""
    return f"batch-{batch_id:012d}"


def latest_batch(log: DataFrame, keys: list[str]) -> DataFrame:
    """Current state of an update log with a ``batch`` column: per key the row of its latest batch."""
    values = [c for c in log.columns if c not in (*keys, "batch")]
    newest = log.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return newest.select(*keys, *[F.col(f"v.{c}").alias(c) for c in values])


def application_stream(
    applications: DataFrame, path: str, event_time: str = "ts", delay_days: int = 1, place: str = "tract_fips", compact_after: int = 50,
) -> tuple[DataFrame, DataFrame]:
    """Daily application counts and distinct lenders per place without storing raw rows, and the rows that came too late.

    The watermark is the latest day of all earlier batches less ``delay_days``. Rows of an older day are set aside as they
    came; all others are added. A batch adds its own counts and sums (mergeable) and its distinct (day, place, lender), one
    unit per batch. A batch run again sees the watermark it saw before. Rows without a time are never late. After
    ``compact_after`` units the older ones are merged. Running it again with the same ``path`` goes on where it stopped.
    """
    spark, units = applications.sparkSession, Units(applications.sparkSession, f"{path}/applications")
    keys = ["period", place]

    def split(df: DataFrame) -> dict[str, DataFrame]:
        timed = df.withColumn("period", F.to_date(event_time))
        pairs = timed.where("action is not null and trim(lender) <> ''").select(*keys, "lender").distinct()
        return {"counts": application_counts(timed, keys), "lenders": pairs}

    schemas = {name: df.schema for name, df in split(applications).items()}
    measures = [c for c in schemas["counts"].names if c not in keys]

    def added(df: DataFrame) -> DataFrame:
        return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in measures])

    def handle(batch: DataFrame, batch_id: int) -> None:
        name = batch_name(batch_id)
        earlier = [r for r in units.records() if r.unit < name]
        seen = max((dt.date.fromisoformat(r.info["high"]) for r in earlier if r.info.get("high")), default=None)
        day = F.to_date(event_time)
        late = F.coalesce(day < F.lit(seen - dt.timedelta(days=delay_days)), F.lit(False)) if seen else F.lit(False)
        batch = batch.persist()
        try:
            high, n_late = batch.agg(F.max(day), F.count_if(late)).first()
            info = {"high": max(filter(None, (high, seen)), default=None), "late": n_late}
            info["high"] = info["high"] and info["high"].isoformat()
            units.write(name, split(batch.where(~late)) | {"late": batch.where(late)}, info)
        finally:
            batch.unpersist()
        if len(earlier) >= compact_after:
            merge = {"counts": (schemas["counts"], added), "lenders": (schemas["lenders"], lambda df: df.distinct()), "late": (applications.schema, lambda df: df)}
            last = earlier[-1].unit
            units.compact(f"{last}-merged", merge, lambda old: {"high": old[-1].info.get("high"), "late": sum(r.info["late"] for r in old)})

    run_available(applications, f"{path}/checkpoint", handle)
    done = units.records()
    counts = added(units.read("counts", schemas["counts"], done))
    lenders = units.read("lenders", schemas["lenders"], done).groupBy(*keys).agg(F.count_distinct("lender").alias("n_distinct_lenders"))
    current = _match(counts, lenders, keys, "left").withColumn("n_distinct_lenders", F.coalesce("n_distinct_lenders", F.lit(0)))
    return current, units.read("late", applications.schema, done)


def pending_units(expected: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Units of work that have no committed result yet."""
    return expected.join(done.select(*keys).distinct(), keys, "left_anti")


class LookupCache:
    """Answers of an expensive lookup, one per key, kept from run to run.

    Each run adds the keys it had to resolve as one unit, failures included if ``resolve`` returns them. Two runs at once may
    resolve a key twice; readers take the answer of the first unit, and ``compact`` leaves one.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, compact_after: int = 20):
        self.units, self.key, self.schema, self.compact_after = Units(spark, path), key, f"{schema}, unit string", compact_after

    def _unique(self, df: DataFrame) -> DataFrame:
        values = [c for c in df.columns if c != self.key]
        return df.groupBy(self.key).agg(F.min_by(F.struct(*values), "unit").alias("v")).select(self.key, "v.*")

    def known(self) -> DataFrame:
        return self._unique(self.units.read("answers", self.schema)).drop("unit")

    def add(self, answers: DataFrame) -> None:
        """Keep answers, whose keys must be new or equal in meaning to what is there."""
        records = self.units.records()
        name = f"run-{1 + max((int(r.unit[4:16]) for r in records), default=-1):012d}"
        names = [c for c in answers.columns if c != "unit"]
        self.units.write(name, {"answers": answers.select(*names, F.lit(name).alias("unit")).dropDuplicates([self.key])})
        if len(records) >= self.compact_after:
            self.units.compact(f"{records[-1].unit}-merged", {"answers": (self.schema, self._unique)})

    def answer(self, requests: DataFrame, resolve: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Requests with their answers; keys the cache lacks are resolved once each and stay in it."""
        known = self.known()
        pending = requests.where(F.col(self.key).isNotNull()).join(known.select(self.key), self.key, "left_anti").dropDuplicates([self.key])
        if not pending.isEmpty():
            self.add(resolve(pending).select(*known.columns))
            known = self.known()
        return requests.join(known, self.key, "left")


def churn_stream(
    presence: DataFrame, path: str, place: str, entity: str, period: str, lags: tuple[int, ...] = (1,)
) -> DataFrame:
    """Entity arrivals and departures per period as new periods land, in any order.

    Each batch adds its (place, entity, period) rows to a presence log with a folder per period, and recomputes just the
    periods it can have changed: its own and those ``lag`` later. It reads the folders of these periods and of the periods they
    are compared with, never the rest of the log. Rows without a period take no part.
    """
    spark = presence.sparkSession
    log, results = Units(spark, f"{path}/presence"), Units(spark, f"{path}/churn")
    rows = presence.select(place, entity, period)
    reach = (0, *lags)

    def handle(batch: DataFrame, batch_id: int) -> None:
        new = batch.where(F.col(period).isNotNull()).select(place, entity, period).distinct().persist()
        try:
            here = [r[0] for r in new.select(period).distinct().collect()]  # the periods of one batch
            log.write(batch_name(batch_id), {"presence": new.withColumn("__p", F.col(period))}, {"periods": sorted(here)}, partition_by="__p")
        finally:
            new.unpersist()
        changed = sorted({p + lag for p in here for lag in reach})
        needed = {p - lag for p in changed for lag in reach}
        folders = presence_folders(log, needed)
        if not folders:
            return
        recent = spark.read.schema(rows.schema).parquet(*folders).distinct()
        churn = entity_churn(recent, place, entity, period, lags).where(F.col(period).isin(changed)).withColumn("batch", F.lit(batch_id))
        results.write(batch_name(batch_id), {"churn": churn}, {"folders": len(folders)})

    run_available(rows, f"{path}/checkpoint", handle)
    done = results.records()
    shape = entity_churn(spark.createDataFrame([], rows.schema), place, entity, period, lags).withColumn("batch", F.lit(0)).schema
    return latest_batch(results.read("churn", shape, done), [place, period])


def presence_folders(log: Units, periods: set, records: list[Record] | None = None) -> list[str]:
    """Folders of the presence log that hold rows of these periods."""
    found = log.records() if records is None else records
    return [f"{log.path}/{r.folder}/presence/__p={p}" for r in found for p in r.info["periods"] if p in periods]


def split_files(df: DataFrame, by: str, rows_per_file: int = 1_000_000, least: int = 4) -> str:
    """Write ``df`` as several files, rows of one ``by`` value in one file; returns the folder (for replays)."""
    path = fresh_path(df.sparkSession, "landing")
    df.repartition(max(least, -(-df.count() // rows_per_file)), by).write.parquet(path)
    return path


def landed_in_turn(df: DataFrame, slices: list, files: int = 1) -> str:
    """Write the rows of each condition in turn, ``files`` files each: a file stream reads them in this order."""
    path = fresh_path(df.sparkSession, "landing")
    for i, condition in enumerate(slices):
        df.where(condition).repartition(files).write.parquet(f"{path}/slice-{i}")
    return path
