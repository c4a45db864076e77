"""Roll-ups and lookup tables behind maps, state pages and driver panels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.guards import ratio
from ..functions.risk import attribution_points
from .cohorts import _match
from .concentration import top_k_rows
from .evaluation import probability_bin
from .orderstats import quantiles


def weighted_mean(value: str, weight: str) -> Column:
    """Aggregate: weighted mean over rows that have both, falling back to the plain mean where no weight exists."""
    known = F.col(value).isNotNull() & F.col(weight).isNotNull()
    w = F.sum(F.when(known, F.col(weight)))
    return F.when(w > 0, F.sum(F.when(known, F.col(value) * F.col(weight))) / w).otherwise(F.avg(value))


def county_rollup(tracts: DataFrame, by: list[str], values: list[str], weight: str = "population") -> DataFrame:
    """Population-weighted means per county with the unweighted fallback marked."""
    fallback = [
        F.when(
            (F.count(v) > 0)
            & ~(F.coalesce(F.sum(F.when(F.col(v).isNotNull(), F.col(weight))), F.lit(0)) > 0), F.lit(1)
        ).otherwise(0)
        for v in values
    ]
    return tracts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_tracts"),
        F.sum(weight).alias(weight),
        *[weighted_mean(v, weight).alias(v) for v in values],
        F.greatest(*fallback, F.lit(0)).alias("unweighted_fallback"),
    )


def wide_risks(latest: DataFrame, key: list[str], model: str, value: str, models: list[str]) -> DataFrame:
    """One row per place, one risk column per model key (the keys are given, so no extra pass finds them)."""
    return latest.groupBy(*key).pivot(model, models).agg(F.first(value))


def histogram(df: DataFrame, by: list[str], value: str, bins: int = 10) -> DataFrame:
    """Counts in equal-width bins of [0, 1] per group, empty bins included."""
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, probability_bin(value, bins).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    all_bins = F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    if by:
        frame = counts.select(*by).distinct().select(*by, all_bins)
    else:
        frame = df.sparkSession.range(1).select(all_bins)
    return frame.join(counts, [*by, "bin"], "left").select(*by, "bin", F.coalesce("n", F.lit(0)).alias("n"))


def nested_means(
    tracts: DataFrame, counties: DataFrame, state: str, values: list[str], minimum: int = 5
) -> DataFrame:
    """Means at national and state grain, over tracts and over county values; small states are skipped."""

    def at(df: DataFrame, grain: str, unit: str) -> DataFrame:
        key = F.lit("ALL") if grain == "national" else F.col(state).cast("string")
        out = df.groupBy(key.alias("area")).agg(
            F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(v) for v in values]
        )
        return out.select(F.lit(grain).alias("grain"), F.lit(unit).alias("unit"), "area", "n", *values)

    states = at(tracts, "state", "tract").where(F.col("n") >= minimum)
    county_states = at(counties, "state", "county").join(states.select("area"), "area", "left_semi")
    parts = [
        at(tracts, "national", "tract"), at(counties, "national", "county"), states,
        county_states.select("grain", "unit", "area", "n", *values),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def to_long(df: DataFrame, keys: list[str], features: list[str], name: str = "feature", value: str = "value") -> DataFrame:
    """Wide to long; NULL and NaN measures produce no row."""
    entries = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).cast("double").alias("v")) for f in features])
    return (
        df.select(*keys, F.explode(entries).alias("__e"))
        .select(*keys, F.col("__e.f").alias(name), F.col("__e.v").alias(value))
        .where(F.col(value).isNotNull() & ~F.isnan(value))
    )


def by_scope(long: DataFrame, area: str) -> DataFrame:
    """Each measurement twice: in the national scope and in its area's."""
    return long.withColumn("scope", F.explode(F.array(F.lit("ALL"), F.col(area).cast("string"))))


def percentile_catalog(
    long: DataFrame, area: str, minimum_national: int = 100, minimum_area: int = 25, cuts: int = 99
) -> DataFrame:
    """Cutpoints p1..p99 per feature, nationally and per area, as ascending arrays; thin scopes are left out."""
    probabilities = [i / (cuts + 1) for i in range(1, cuts + 1)]
    q = quantiles(by_scope(long, area), ["scope", "feature"], "value", probabilities)
    enough = F.when(F.col("scope") == "ALL", F.lit(minimum_national)).otherwise(F.lit(minimum_area))
    return (
        q.where(F.col("n") >= enough)
        .groupBy("scope", "feature")
        .agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("p", "quantile"))).alias("__q"))
        .select("scope", "feature", "n", F.transform("__q", lambda c: c["quantile"]).alias("cutpoints"))
    )


def categorical_features(long: DataFrame, max_values: int = 12, tolerance: float = 1e-8) -> DataFrame:
    """Features with few distinct values, all of them whole numbers."""
    v = F.col("value")
    return (
        long.groupBy("feature")
        .agg(F.count_distinct("value").alias("n_values"), F.bool_and(F.abs(v - F.rint(v)) <= tolerance).alias("whole"))
        .select("feature", "n_values", ((F.col("n_values") <= max_values) & F.col("whole")).cast("int").alias("is_categorical"))
    )


def category_shares(long: DataFrame, area: str) -> DataFrame:
    """Share of each value of the categorical features, nationally and per area."""
    kinds = categorical_features(long).where("is_categorical = 1").select("feature")
    counts = (
        by_scope(long.join(kinds, "feature", "left_semi"), area)
        .groupBy("scope", "feature", F.rint("value").cast("long").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    totals = counts.groupBy("scope", "feature").agg(F.sum("n").alias("__t"))
    return _match(counts, totals, ["scope", "feature"]).select(
        "scope", "feature", "value", "n", (F.col("n") / F.col("__t")).alias("share")
    )


def feature_summary(long: DataFrame) -> DataFrame:
    """Mean, population deviation, range, p10 and p90 per feature."""
    basics = long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    q = quantiles(long, ["feature"], "value", [0.1, 0.9])
    wide = q.groupBy("feature").agg(
        F.max(F.when(F.col("p") == 0.1, F.col("quantile"))).alias("p10"),
        F.max(F.when(F.col("p") == 0.9, F.col("quantile"))).alias("p90"),
    )
    return basics.join(wide, "feature", "left")


def county_feature_means(long: DataFrame, county: str, weight: str) -> DataFrame:
    """Weighted feature means per county; counties without any weight use plain means."""
    w = F.coalesce(F.col(weight), F.lit(0.0))
    grouped = long.groupBy(county, "feature").agg(
        F.sum(w).alias("__w"), F.sum(F.col("value") * w).alias("__vw"), F.avg("value").alias("__plain")
    )
    return grouped.select(
        county, "feature", F.when(F.col("__w") > 0, F.col("__vw") / F.col("__w")).otherwise(F.col("__plain")).alias("value")
    )


def county_drivers(
    drivers: DataFrame, tracts: DataFrame, county: str, place: str, k: int = 8, weight: str = "population"
) -> DataFrame:
    """Top drivers per county and model: weighted mean attribution and points over the tracts that have drivers.

    ``drivers`` is long (place, model, feature, attribution), ``tracts`` has (place, model, county, risk, weight). The
    divisor is the weight of all tracts with any driver, so a feature missing from a tract counts as zero there.
    Counties whose tracts carry no weight at all use equal weights.
    """
    usable = F.sum(F.coalesce(F.col(weight), F.lit(0.0)))
    has_weight = tracts.where("risk is not null").groupBy(county, "model").agg((usable > 0).alias("__weighted"))
    weighted = _match(tracts.where("risk is not null"), has_weight, [county, "model"]).withColumn(
        "__w", F.when(F.col("__weighted"), F.col(weight)).otherwise(F.lit(1.0))
    ).where("__w is not null")
    joined = weighted.select(place, "model", county, "risk", "__w").join(drivers, [place, "model"])
    sums = joined.groupBy(county, "model", "feature").agg(
        F.sum(F.col("attribution") * F.col("__w")).alias("__v"),
        F.sum(attribution_points("risk", "attribution") * F.col("__w")).alias("__p"),
    )
    with_any = weighted.join(drivers.select(place, "model").distinct(), [place, "model"], "left_semi")
    divisor = with_any.groupBy(county, "model").agg(F.sum("__w").alias("__t")).where("__t > 0")
    means = sums.join(divisor, [county, "model"]).select(
        county, "model", "feature",
        (F.col("__v") / F.col("__t")).alias("value"), (F.col("__p") / F.col("__t")).alias("points"),
        F.abs(F.round(F.col("__p") / F.col("__t"), 6)).alias("__size"),
    )
    return top_k_rows(means, [county, "model"], "__size", "feature", k).drop("__size")


def top_attributions(
    long: DataFrame, keys: list[str], k: int = 8, excluded: tuple[str, ...] = (), value: str = "attribution"
) -> DataFrame:
    """The ``k`` attributions of largest size per row, sign kept, without the excluded features."""
    kept = long.where(~F.col("feature").isin(list(excluded))) if excluded else long
    return top_k_rows(kept.withColumn("__size", F.abs(value)), keys, "__size", "feature", k).drop("__size")


def top_places(
    tracts: DataFrame, area: list[str], model: str, risk: str, place: str, k: int = 5, extra: tuple[str, ...] = ()
) -> DataFrame:
    """The ``k`` riskiest places per area and model key as an ordered array."""
    best = top_k_rows(tracts.where(F.col(risk).isNotNull()), [*area, model], risk, place, k)
    item = F.struct(F.col("rank"), F.col(place), F.col(risk), *[F.col(c) for c in extra])
    return best.groupBy(*area, model).agg(F.array_sort(F.collect_list(item)).alias("top"))


def importance_rollup(importance: DataFrame, by: list[str]) -> DataFrame:
    """Mean and deviation of importance over folds."""
    return importance.groupBy(*by).agg(
        F.avg("importance").alias("mean_importance"), F.stddev_samp("importance").alias("std_importance"),
        F.count_distinct("fold").alias("n_folds"),
    )


def normalized_gain(importance: DataFrame) -> DataFrame:
    """Importance as a share of its fold's total, averaged per feature over the folds that used it."""
    totals = importance.groupBy("fold").agg(F.sum("importance").alias("__t"))
    shares = _match(importance, totals, ["fold"]).withColumn("share", ratio("importance", "__t"))
    return shares.groupBy("feature").agg(
        F.avg("share").alias("mean_gain"), F.count_if(F.col("importance") > 0).alias("folds_used")
    )


def ring_bounds(geometry: Column | str) -> Column:
    """Bounding box of one polygon given as array<ring>, ring = array<[lon, lat]>."""
    g = F.col(geometry) if isinstance(geometry, str) else geometry
    points = F.flatten(g)
    lon, lat = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.struct(
        F.array_min(lon).alias("min_lon"), F.array_min(lat).alias("min_lat"),
        F.array_max(lon).alias("max_lon"), F.array_max(lat).alias("max_lat"),
    )


def geometry_bounds(geometry: Column | str) -> Column:
    """Bounding box of a GeoJSON geometry (variant) of any depth, collections included; null if it has no position.

    Positions are the innermost arrays, which are the only ones that open with a number. Those of a collection are found in
    its members; a height is left out.
    """
    g = F.col(geometry) if isinstance(geometry, str) else geometry
    text = F.coalesce(F.try_variant_get(g, "$.coordinates", "string"), F.try_variant_get(g, "$.geometries", "string"))
    position = r"\[\s*(-?\d[^\[\],\s]*)\s*,\s*(-?\d[^\[\],\s]*)"
    lon, lat = (F.regexp_extract_all(text, F.lit(position), F.lit(i)).cast("array<double>") for i in (1, 2))
    box = F.struct(
        F.array_min(lon).alias("min_lon"), F.array_min(lat).alias("min_lat"),
        F.array_max(lon).alias("max_lon"), F.array_max(lat).alias("max_lat"),
    )
    return F.when(F.size(lon) > 0, box)


def merged_bounds(df: DataFrame, by: list[str], box: str = "box") -> DataFrame:
    """Bounding box per area, merged from the boxes of its features."""
    return df.groupBy(*by).agg(
        F.min(f"{box}.min_lon").alias("min_lon"), F.min(f"{box}.min_lat").alias("min_lat"),
        F.max(f"{box}.max_lon").alias("max_lon"), F.max(f"{box}.max_lat").alias("max_lat"),
    )


def latest_with_fallback(primary: DataFrame, fallback: DataFrame, key: str, order: tuple[str, str], value: str) -> DataFrame:
    """Latest non-null value per key from the primary source, else from the fallback source."""

    def latest(df: DataFrame, o: str, name: str) -> DataFrame:
        return df.where(F.col(value).isNotNull()).groupBy(key).agg(F.max_by(value, o).alias(name))

    a, b = latest(primary, order[0], "__a"), latest(fallback, order[1], "__b")
    return a.join(b, key, "full").select(key, F.coalesce("__a", "__b").alias(value))


def merge_preferring_left(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer merge on ``key``; columns both sides have come from the left only."""
    fresh = [c for c in right.columns if c == key or c not in left.columns]
    return left.join(right.select(*fresh), key, "full")


def coverage(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Share of rows with a positive value and the median, per measure."""
    long = to_long(df, by, columns)
    positive = long.groupBy(*by, "feature").agg(F.avg((F.col("value") > 0).cast("double")).alias("share_positive"))
    middle = quantiles(long, [*by, "feature"], "value", [0.5]).select(*by, "feature", F.col("quantile").alias("median"))
    return _match(positive, middle, [*by, "feature"])


def flag_coverage(df: DataFrame, flags: list[str]) -> DataFrame:
    """Known and flagged rows per flag column."""
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("flag"), F.col(c).cast("int").alias("v")) for c in flags]))
    return df.select(stacked.alias("__f")).groupBy(F.col("__f.flag").alias("flag")).agg(
        F.count("__f.v").alias("n_known"), F.count_if(F.col("__f.v") == 1).alias("n_flagged")
    )


def renderable_only(lists: DataFrame, key: str, items: str, known: DataFrame, known_key: str) -> DataFrame:
    """Drop array entries without a known counterpart, keeping the order of the rest."""
    exploded = lists.select(key, F.posexplode(items).alias("pos", "item"))
    kept = exploded.join(known.select(F.col(known_key).alias("item")).distinct(), "item", "left_semi")
    return kept.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda e: e["item"]).alias(items)
    )


def seeded_sample(df: DataFrame, key: list[str], size: int, seed: int = 42) -> DataFrame:
    """A repeatable random sample of fixed size: the ``size`` smallest seeded key hashes."""
    return df.orderBy(F.xxhash64(*key, F.lit(seed)), *key).limit(size)
