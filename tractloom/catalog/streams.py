"""Queries that run a stream over everything that is there and compare its final state with SQL."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from ..functions.cleaning import address_key
from ..plans.domain import Domain, applications_from_events
from ..session import fresh_path
from ..streaming import incremental as S
from ..streaming.units import Units
from .registry import query, rounded

COUNTS = """
    SELECT period, tract_fips, count(*) AS n_applications, count(*) FILTER (action = 1) AS n_originated, count(*) FILTER (action = 3) AS n_denied, count(*) FILTER (action = 4) AS n_withdrawn,
      count(*) FILTER (action = 6) AS n_purchased, round(sum(amount) FILTER (amount > 0), 2) AS sum_amount, count(*) FILTER (amount > 0) AS n_with_amount,
      count(*) FILTER (race = 'White') AS n_white, count(*) FILTER (race = 'Black or African American') AS n_black, count(*) FILTER (race = 'Asian') AS n_asian,
      count(*) FILTER (race = 'Other') AS n_other_race, count(*) FILTER (ethnicity = 'Hispanic or Latino') AS n_hispanic, count(DISTINCT nullif(lender, '')) AS n_distinct_lenders
    FROM d_applications GROUP BY ALL"""


def _landing(d: Domain) -> str:
    days = d.table("events").withColumn("day", F.to_date("ts"))
    return S.split_files(days, "day")


@query("t01_incremental_rollup", COUNTS)
def _(d: Domain):
    stream = applications_from_events(S.read_stream(d.spark, _landing(d), "*.parquet", files_per_batch=2))
    # files are replayed in no particular order of event time, so the delay spans the whole replay
    current, _late = S.application_stream(stream, fresh_path(d.spark, "rollup"), delay_days=60)
    return rounded(current, 2)


@query("t01_late_rows", """
    WITH e AS (SELECT event_id % 3 AS batch, CAST(ts AS DATE) AS day, event_type IN ('purchase', 'view', 'error', 'click', 'signup') AS usable FROM events),
    h AS (SELECT b.batch, max(e.day) AS high FROM (SELECT DISTINCT batch FROM e) b LEFT JOIN e ON e.batch < b.batch GROUP BY b.batch),
    m AS (SELECT day, usable, coalesce(day < high - 7, false) AS late FROM e JOIN h USING (batch))
    SELECT 'late' AS side, day AS period, count(*) AS n FROM m WHERE late GROUP BY day
    UNION ALL SELECT 'kept', day, count(*) FILTER (usable) FROM m WHERE NOT late GROUP BY day HAVING count(*) FILTER (usable) > 0""")
def _(d: Domain):
    """Three batches that each span all days: what is more than a week behind the earlier batches is set aside."""
    landing = S.landed_in_turn(d.table("events"), [F.col("event_id") % 3 == i for i in range(3)])
    stream = applications_from_events(S.read_stream(d.spark, landing, "*.parquet", files_per_batch=1))
    current, late = S.application_stream(stream, fresh_path(d.spark, "rollup"), delay_days=7)
    kept = current.groupBy("period").agg(F.sum("n_applications").alias("n")).withColumn("side", F.lit("kept"))
    return kept.unionByName(late.groupBy("period").agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit("late"))).select("side", "period", "n")


@query("t02_idempotent_rerun", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def _(d: Domain):
    landing, path = _landing(d), fresh_path(d.spark, "rerun")
    units, died = Units(d.spark, f"{path}/rows"), []

    def handle(df, batch_id):
        if not died:  # the first attempt writes its data and dies before the record
            died.append(batch_id)
            df.write.parquet(f"{units.path}/data/{S.batch_name(batch_id)}-dead/rows")
            raise RuntimeError("the batch dies between its data and its record")
        units.write(S.batch_name(batch_id), {"rows": df})

    for attempt in range(3):  # the second run replays the dead batch, the third finds everything done
        stream = S.read_stream(d.spark, landing, "*.parquet", files_per_batch=2).select("event_type", "value")
        try:
            S.run_available(stream, f"{path}/checkpoint", handle)
        except StreamingQueryException:
            if attempt:
                raise
    rows = units.read("rows", d.table("events").select("event_type", "value").schema)
    return rounded(rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), 2)


@query("t03_cached_lookup", """
    SELECT o_orderkey, sha1('CUSTOMER ' || o_custkey || ', ' || o_orderpriority) AS key, CASE WHEN c_mktsegment = 'BUILDING' THEN 'cache' ELSE 'service' END AS source
    FROM orders JOIN customer ON c_custkey = o_custkey""")
def _(d: Domain):
    def keyed(df):
        return df.withColumn("key", address_key(F.concat(F.lit("Customer "), F.col("o_custkey")), F.col("o_orderpriority")))

    orders = keyed(d.table("orders").select("o_orderkey", "o_custkey", "o_orderpriority"))
    known = orders.join(d.table("customer").where("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    cache = S.LookupCache(d.spark, fresh_path(d.spark, "lookups"), "key", "key string, source string")
    cache.add(known.select("key", F.lit("cache").alias("source")))
    cache.answer(orders, lambda pending: pending.withColumn("source", F.lit("service")))
    # the second run is answered from what the first one kept
    answers = cache.answer(orders, lambda pending: pending.withColumn("source", F.lit("asked again")))
    return answers.select("o_orderkey", "key", "source")


@query("t04_running_churn", """
    WITH e AS (SELECT event_type, user_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS day FROM events),
    s AS (SELECT event_type, day, list(DISTINCT user_id) AS l FROM e GROUP BY ALL),
    j AS (SELECT c.event_type, c.day, c.l, coalesce(p.l, []) AS p FROM s c LEFT JOIN s p ON p.event_type = c.event_type AND p.day = c.day - 1)
    SELECT event_type, day, len(l) AS n_lenders, len(l) - len(list_intersect(l, p)) AS entries_1yr, len(p) - len(list_intersect(l, p)) AS exits_1yr,
      len(l) + len(p) - 2 * len(list_intersect(l, p)) AS churn_1yr, CASE WHEN len(p) > 0 THEN round(len(list_intersect(l, p)) / len(p), 6) END AS retention_1yr FROM j""")
def _(d: Domain):
    landing = _landing(d)
    stream = S.read_stream(d.spark, landing, "*.parquet", files_per_batch=1)
    presence = stream.select("event_type", "user_id", F.datediff("ts", F.lit("2024-01-01")).alias("day"))
    return rounded(S.churn_stream(presence, fresh_path(d.spark, "churn"), "event_type", "user_id", "day"))
