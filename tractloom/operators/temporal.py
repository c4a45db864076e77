"""Time logic on (place, year) panels: row lags, calendar lags, as-of vintages, forward labels, lagged sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checks import guarded_unique


def trailing_mean(df: DataFrame, place: str, year: str, columns: list[str], low: int, high: int) -> DataFrame:
    """Mean of the rows ``low``..``high`` before each row of the same place (row distance), NULLs skipped."""
    frame = Window.partitionBy(place).orderBy(year).rowsBetween(-high, -low)
    return df.select("*", *[F.avg(c).over(frame).alias(f"{c}_lag{low}to{high}_mean") for c in columns])


def by_calendar_year(
    df: DataFrame, place: str, year: str, columns: list[str], offsets: list[int]
) -> DataFrame:
    """Each column as it was ``offset`` calendar years away; NULL where that year has no row.

    One window per place carries a year -> values map, so any number of offsets costs a single shuffle. Outputs are
    named ``{column}_m{n}`` for earlier and ``{column}_p{n}`` for later years. Needs unique (place, year) rows; the
    map then holds at most one entry per year.
    """
    everything = Window.partitionBy(place).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    entry = F.struct(F.col(year).alias("k"), F.struct(*[F.col(c) for c in columns]).alias("v"))
    mapped = df.withColumn("__by_year", F.map_from_entries(F.collect_list(entry).over(everything)))
    out: list[Column] = []
    for c in columns:
        for o in offsets:
            name = f"{c}_m{-o}" if o < 0 else f"{c}_p{o}"
            out.append(F.try_element_at("__by_year", F.col(year) + o)[c].alias(name))
    return mapped.select(*df.columns, *out)


def calendar_change(
    df: DataFrame, place: str, year: str, columns: list[str], lags: tuple[int, ...] = (1, 3),
    percent: tuple[str, ...] = (),
) -> DataFrame:
    """Difference to ``lag`` calendar years earlier, plus percentage change for the columns in ``percent``."""
    history = by_calendar_year(df, place, year, columns, [-lag for lag in lags])
    out = [F.col(c) for c in df.columns]
    for c in columns:
        for lag in lags:
            before = F.col(f"{c}_m{lag}")
            out.append((F.col(c) - before).alias(f"{c}_chg{lag}yr"))
            if c in percent:
                out.append(F.when(before != 0, (F.col(c) - before) / before * 100.0).alias(f"{c}_pctchg{lag}yr"))
    return history.select(*out)


def asof_vintage(
    panel: DataFrame, vintages: DataFrame, place: str = "tract_fips", year: str = "year",
    vintage: str = "vintage", min_lag: int = 2,
) -> DataFrame:
    """Attach the newest vintage published by then: the globally latest vintage <= year - ``min_lag``.

    The vintage is chosen per year, not per place: a place missing from that vintage gets NULLs, never an older one.
    The distinct vintages (one per survey year) form a small array, so the choice is a row expression and the only
    shuffle is the equi-join on (place, vintage).
    """
    known = vintages.agg(F.sort_array(F.collect_set(vintage))).scalar()
    chosen = F.array_max(F.filter("__known", lambda v: v <= F.col(year) - min_lag))
    unique = guarded_unique(vintages, [place, vintage], "vintages")
    dated = panel.withColumn("__known", known).withColumn(vintage, chosen).drop("__known")
    return dated.join(unique, [place, vintage], "left")


def forward_labels(
    df: DataFrame, place: str, year: str, flags: list[str], horizons: list[int]
) -> DataFrame:
    """State and transition labels: the flag ``h`` calendar years ahead, and the same hidden where it is already 1."""
    ahead = by_calendar_year(df, place, year, flags, horizons)
    out = [F.col(c) for c in df.columns]
    for f in flags:
        for h in horizons:
            future = F.col(f"{f}_p{h}")
            out.append(future.alias(f"state_{f}_h{h}"))
            out.append(F.when(F.coalesce(F.col(f), F.lit(0)) != 1, future).alias(f"becomes_{f}_h{h}"))
    return ahead.select(*out)


def complete_years(df: DataFrame, place: str, year: str, first: Column, last: Column) -> DataFrame:
    """Every place with every year from ``first`` to ``last``."""
    return df.select(place).distinct().select(place, F.explode(F.sequence(first, last)).alias(year))


def lagged_sums(
    df: DataFrame, place: str, year: str, windows: dict[str, tuple[str, int, int]]
) -> DataFrame:
    """Sums over the years ``low``..``high`` earlier on a complete year grid with zero for quiet years.

    ``windows`` maps an output name to (column, low, high). The grid starts at the first year in the data so that
    early events are not lost; a sum is NULL only where no earlier grid year exists.
    """
    columns = sorted({c for c, _, _ in windows.values()})
    per_year = df.groupBy(place, year).agg(*[F.sum(c).alias(c) for c in columns])
    span = df.agg(F.struct(F.min(year).alias("a"), F.max(year).alias("b")).alias("s"))
    bounds = span.scalar()
    grid = complete_years(df, place, year, bounds["a"], bounds["b"])
    filled = grid.join(per_year, [place, year], "left").fillna(0, subset=columns)
    order = Window.partitionBy(place).orderBy(year)
    return filled.select(
        place, year, *columns,
        *[F.sum(c).over(order.rowsBetween(-high, -low)).alias(name) for name, (c, low, high) in windows.items()],
    )


def latest_per_key(df: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """Latest row per key: a map-side combinable maximum instead of a sort."""
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*keep), F.struct(*order)).alias("__row"))
        .select(*keys, *[F.col(f"__row.{c}").alias(c) for c in keep])
    )


def first_per_key(df: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """Keep-first de-duplication after a sort on ``order``."""
    return (
        df.groupBy(*keys)
        .agg(F.min_by(F.struct(*keep), F.struct(*order)).alias("__row"))
        .select(*keys, *[F.col(f"__row.{c}").alias(c) for c in keep])
    )
