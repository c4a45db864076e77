"""Domain tables derived from the star-schema tables.

They give every operator a realistic input whose size follows the data: customers are places (tracts), nations are
counties, regions are states, suppliers are lenders or banks, line items are loans or branches, events are
applications. Each has an equal definition in SQL in ``tractloom.catalog.oracle``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Loans to a part where lending facts are built: a few hundred MB of a task's memory, whatever the size of the table.
LOANS_IN_PART = 150_000
MERGED_PART = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


class Domain:
    """Lazy domain tables over one directory of parquet tables."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.directory = directory.rstrip("/")
        self._n_loans: int | None = None
        # the default merges parts up to 64 compressed MB, which are gigabytes in the hash tables of a task
        if spark.conf.get(MERGED_PART, None) is None:
            spark.conf.set(MERGED_PART, "16m")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.directory}/{name}.parquet")

    def parts(self, loans: int = LOANS_IN_PART) -> int:
        """Parts of about ``loans`` loans each; counting rows reads only the footers of the files."""
        if self._n_loans is None:
            self._n_loans = self.table("lineitem").count()
        return max(1, math.ceil(self._n_loans / loans))

    def places(self) -> DataFrame:
        """One row per tract with its county, state, rurality, population and coordinates."""
        k = F.col("c_custkey")
        return (
            self.table("customer")
            .join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                k.alias("tract_fips"),
                F.col("c_nationkey").alias("county_fips"),
                F.col("n_regionkey").alias("state_fips"),
                F.col("c_mktsegment").isin("HOUSEHOLD", "MACHINERY").cast("int").alias("is_rural"),
                F.when(F.col("c_acctbal") >= 0, F.round("c_acctbal")).alias("population"),
                (F.lit(30.0) + (k * 7919 % 10000) / F.lit(1000.0)).alias("lat"),
                (F.lit(-100.0) + (k * 104729 % 20000) / F.lit(1000.0)).alias("lon"),
            )
        )

    def fact(self) -> DataFrame:
        """Tract x lender x year: loan counts and amounts by size bucket."""
        return self._lender_years().join(self.places().select("tract_fips", "county_fips", "state_fips"), "tract_fips")

    def _loans(self) -> DataFrame:
        return (
            self.table("lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice")
            .join(
                self.table("orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year")),
                F.col("l_orderkey") == F.col("o_orderkey"),
            )
        )

    def lender_totals(self) -> DataFrame:
        """Lender x year: amount of all loans to known tracts. It needs no rows per tract."""
        amounts = self._loans().join(self.places().select("tract_fips"), F.col("o_custkey") == F.col("tract_fips"))
        return amounts.groupBy(F.col("l_suppkey").alias("lender_id"), "year").agg(F.sum("l_extendedprice").alias("amount_k"))

    def _lender_years(self) -> DataFrame:
        price = F.col("l_extendedprice")
        buckets = {
            "lt_100": price < 25000, "100_250": (price >= 25000) & (price < 60000), "250_1m": price >= 60000,
        }
        # Dealt once by tract in parts of bounded size, which all groupings by tract, and tract and year, go on with: shuffles
        # that follow their bytes alone merge parts until the hash tables of one task hold gigabytes.
        loans = self._loans().repartition(self.parts(), "o_custkey")
        # aggregate before attaching place attributes: they depend on the tract only
        return loans.groupBy(
            F.col("o_custkey").alias("tract_fips"), F.col("l_suppkey").alias("lender_id"), "year"
        ).agg(
            F.count(F.lit(1)).alias("n_loans"), F.sum(price).alias("amount_k"),
            *[F.count_if(c).alias(f"count_{b}") for b, c in buckets.items()],
            *[F.coalesce(F.sum(F.when(c, price)), F.lit(0.0)).alias(f"amount_{b}") for b, c in buckets.items()],
        )

    def panel(self) -> DataFrame:
        """Tract x year: distinct lenders, loans, amount and place attributes; (tract, year) is unique."""
        # the fact has one row per lender, so counting rows counts lenders
        grouped = self._lender_years().groupBy("tract_fips", "year").agg(
            F.count(F.lit(1)).alias("n_lenders"), F.sum("n_loans").alias("n_loans"),
            F.sum("amount_k").alias("amount_k"), F.sum("count_lt_100").alias("n_small"),
        )
        return grouped.join(self.places().drop("lat", "lon"), "tract_fips")

    def branches(self) -> DataFrame:
        """Branch x year: bank, county, deposits and coordinates."""
        b = F.col("branch_id")
        return (
            self.table("lineitem")
            .groupBy(
                (F.col("l_partkey") * 5 + F.col("l_suppkey") % 5).alias("branch_id"),
                (F.col("l_suppkey") % 5).alias("bank_id"), F.year("l_shipdate").alias("year"),
            )
            .agg(F.sum("l_extendedprice").alias("deposits"), F.count(F.lit(1)).alias("n_accounts"))
            .select(
                "*", (F.floor(b / 5) % 25).cast("int").alias("county_fips"),
                (F.lit(30.0) + (b * 6151 % 10000) / F.lit(1000.0)).alias("lat"),
                (F.lit(-100.0) + (b * 3571 % 20000) / F.lit(1000.0)).alias("lon"),
            )
        )

    def demographics(self) -> DataFrame:
        """Tract x vintage: a survey estimate, with vintages 1995, 1997, 1998 and 2000."""
        y = F.year("o_orderdate")
        vintage = F.when(y <= 1996, 1995).when(y == 1997, 1997).when(y <= 1999, 1998).otherwise(2000)
        return self.table("orders").groupBy(F.col("o_custkey").alias("tract_fips"), vintage.alias("vintage")).agg(
            F.avg("o_totalprice").alias("income"), F.count(F.lit(1)).alias("households")
        )

    def _map(self, split: str, first: tuple[int, float], second: tuple[int, float], moved: str, to: int) -> DataFrame:
        k = F.col("c_custkey")

        def target(step: int, weight: float) -> Column:
            return F.struct((k + step).alias("dst"), F.lit(weight).alias("weight"))

        targets = F.when(F.col("c_mktsegment") == split, F.array(target(*first), target(*second))).when(
            F.col("c_mktsegment") == moved, F.array(target(to, 1.0))
        )
        return self.table("customer").select(k.alias("src"), F.explode(targets).alias("t")).select("src", "t.dst", "t.weight")

    def crosswalk_ab(self) -> DataFrame:
        """Boundary change: BUILDING tracts split in two, MACHINERY tracts are renumbered, the others are unmapped."""
        return self._map("BUILDING", (0, 0.6), (1, 0.4), "MACHINERY", 1)

    def crosswalk_bc(self) -> DataFrame:
        """A later boundary change with other splits."""
        return self._map("HOUSEHOLD", (0, 0.7), (2, 0.3), "BUILDING", 3)

    def overlaps(self) -> DataFrame:
        """Area x tract overlaps: areas are parts, the overlap is the quantity traded."""
        return (
            self.table("lineitem").join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
            .groupBy(F.col("l_partkey").alias("area"), F.col("o_custkey").alias("tract_fips"))
            .agg(F.sum("l_quantity").alias("overlap"))
        )

    def loans(self) -> DataFrame:
        """Loan-level rows: program, lender (blank for one priority class), amounts, area and year."""
        status = F.col("o_orderstatus")
        return (
            self.table("orders").join(self.places(), F.col("o_custkey") == F.col("tract_fips"))
            .select(
                "state_fips", F.col("o_custkey").alias("zip"), F.year("o_orderdate").alias("year"),
                F.when(status == "F", "504").otherwise("7a").alias("program"),
                F.when(F.col("o_orderpriority").startswith("5"), "  ").otherwise(F.col("o_orderpriority")).alias("lender"),
                F.col("o_totalprice").alias("gross"), (F.col("o_totalprice") * 0.75).alias("guaranteed"),
            )
        )

    def applications(self) -> DataFrame:
        return applications_from_events(self.table("events"))

    def scored(self) -> DataFrame:
        """Scored tract-years with a label, a fold and two model probabilities (with ties)."""
        return scored_from_panel(self.panel())

    def features(self) -> DataFrame:
        """Latest feature row per tract."""
        from ..operators.temporal import latest_per_key

        cols = ["year", "n_lenders", "n_loans", "amount_k", "n_small", "county_fips", "state_fips", "is_rural", "population"]
        return latest_per_key(self.panel(), ["tract_fips"], ["year"], cols)

    def risks(self) -> DataFrame:
        """Latest risk per tract and model key, long."""
        from ..operators.temporal import latest_per_key

        latest = latest_per_key(
            self.scored(), ["tract_fips"], ["year", "fold"],
            ["county_fips", "state_fips", "population", "is_rural", "y_true", "y_prob", "y_prob2"],
        )
        entries = F.array(*[
            F.struct(F.lit(m).alias("model"), e.alias("risk"))
            for m, e in {
                "m1_h3": F.col("y_prob"), "m1_h6": F.col("y_prob") * 0.5, "m2_h3": F.col("y_prob2"),
                "m2_h6": F.col("y_prob2") * 0.5,
            }.items()
        ])
        return latest.withColumn("__m", F.explode(entries)).select(
            "tract_fips", "county_fips", "state_fips", "population", "is_rural", "y_true", "__m.model", "__m.risk"
        )

    def drivers(self) -> DataFrame:
        """Attributions per tract and model key, long: four features on fixed linear scales."""
        def entry(model: str, feature: str, value: Column) -> Column:
            return F.struct(F.lit(model).alias("model"), F.lit(feature).alias("feature"), value.alias("attribution"))

        n, loans, amount, small = (F.col(c).cast("double") for c in ("n_lenders", "n_loans", "amount_k", "n_small"))
        entries = []
        for m, scale in (("m1_h3", 1.0), ("m1_h6", 0.5), ("m2_h3", 1.5), ("m2_h6", 0.75)):
            entries += [
                entry(m, "lender_hhi_tract_resid", (F.lit(8.0) - n) * (0.1 * scale)),
                entry(m, "branches_within_5mi", (F.lit(10.0) - loans) * (0.05 * scale)),
                entry(m, "pct_poverty", (amount - 300000.0) * (0.000002 * scale)),
                entry(m, "population", (small - 3.0) * (0.08 * scale)),
            ]
        return self.features().select("tract_fips", "county_fips", "state_fips", F.explode(F.array(*entries)).alias("e")).select(
            "tract_fips", "county_fips", "state_fips", "e.model", "e.feature", "e.attribution"
        )

    def reporters(self) -> DataFrame:
        """Names to be matched: one per part, blocked by brand (state) and size class (city)."""
        return self.table("part").select(
            F.col("p_partkey").alias("reporter_id"),
            F.concat(F.lit("The "), F.col("p_name"), F.lit(" "), F.col("p_type"), F.lit(" Corp.")).alias("name"),
            F.col("p_brand").alias("state"), F.concat(F.lit("C"), F.col("p_size") % 7).alias("city"),
            F.col("p_retailprice").alias("amount"),
        )

    def institutions(self) -> DataFrame:
        """Names to match against: word order, spelling and suffixes differ from the reporters'."""
        name, kind = F.col("p_name"), F.col("p_type")
        spelled = (
            F.when(F.col("p_size") % 3 == 0, F.concat(name, F.lit(" "), kind, F.lit(" Bank")))
            .when(F.col("p_size") % 3 == 1, F.concat(F.regexp_replace(name, "o", "0"), F.lit(" "), kind))
            .otherwise(F.concat(kind, F.lit(", "), name, F.lit(" Trust")))
        )
        return self.table("part").select(
            F.col("p_partkey").alias("institution_id"), spelled.alias("name"), F.col("p_brand").alias("state"),
            F.concat(F.lit("C"), F.col("p_size") % 7).alias("city"),
        )


def applications_from_events(events: DataFrame) -> DataFrame:
    """Application rows from events; works on batch and streaming frames alike."""
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k").cast("int")
    return events.select(
        F.col("event_id"), F.col("ts"), F.col("user_id").alias("tract_fips"), F.to_date("ts").alias("period"),
        F.when(kind == "purchase", 1).when(kind == "view", 2).when(kind == "error", 3).when(kind == "click", 4)
        .when(kind == "signup", 6).alias("action"),
        F.col("value").alias("amount"),
        F.when(F.col("event_id") % 37 == 0, "").otherwise(F.concat(F.lit("L"), F.col("event_id") % 37)).alias("lender"),
        F.when(k < 40, "White").when(k < 60, "Black or African American").when(k < 75, "Asian").when(k < 90, "Other")
        .otherwise("").alias("race"),
        F.when(k % 5 == 0, "Hispanic or Latino").otherwise("Not Hispanic or Latino").alias("ethnicity"),
    )


def scored_from_panel(panel: DataFrame) -> DataFrame:
    t, y, n = F.col("tract_fips"), F.col("year"), F.col("n_lenders")

    def probability(a: int, b: int) -> Column:
        return F.least(
            F.lit(0.6) * ((t * a + y * b) % 100 / F.lit(100.0)) + F.lit(0.4) / (n + 1).cast("double"), F.lit(1.0)
        )

    return panel.select(
        "*", F.concat(F.lit("F"), t % 4 + 1).alias("fold"), (n <= 2).cast("int").alias("y_true"),
        probability(7919, 31).alias("y_prob"), probability(4409, 17).alias("y_prob2"),
    )
