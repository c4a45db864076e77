"""Folds and exact ranking/calibration metrics for scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.guards import ratio
from .cohorts import _match
from .orderstats import ranked_values

# Fixed values: (name, train start, train end, validation year, test start, test end) per horizon.
FOLDS = {
    1: [(f"F{i + 1}", 2009, 2014 + i, 2015 + i, 2016 + i, 2017 + i) for i in range(8)],
    3: [(f"F{i + 1}", 2009, 2012 + i, 2013 + i, 2014 + i, min(2015 + i, 2021)) for i in range(8)],
    6: [(f"F{i + 1}", 2009, 2010 + i, 2011 + i, 2012 + i, 2013 + i) for i in range(6)],
}
# Fixed values: (regime, train start, train end, validation year, test start, test end) per horizon.
REGIMES = {
    1: [("pre", 2009, 2017, 2018, 2018, 2019), ("post", 2020, 2021, 2022, 2023, 2024)],
    3: [("pre", 2009, 2014, 2015, 2015, 2016), ("post", 2018, 2019, 2020, 2020, 2021)],
    6: [("pre", 2009, 2011, 2012, 2012, 2013), ("post", 2014, 2015, 2016, 2017, 2018)],
}
Fold = tuple[str, int, int, int, int, int]


def build_folds(horizon: int) -> list[Fold]:
    if horizon not in FOLDS:
        raise ValueError(f"no folds for horizon {horizon}")
    return FOLDS[horizon]


def shifted(folds: list[Fold], years: int) -> list[Fold]:
    """The same fold shape on a panel that starts in another year."""
    return [(name, *(y + years for y in rest)) for name, *rest in folds]


def folds_frame(spark: SparkSession, folds: list[Fold]) -> DataFrame:
    names = ["fold", "train_start", "train_end", "val_year", "test_start", "test_end"]
    return spark.createDataFrame(folds, "fold string, " + ", ".join(f"{n} int" for n in names[1:]))


def assign_folds(df: DataFrame, folds: list[Fold], year: str = "year") -> DataFrame:
    """Each row once per (fold, role) it serves in. The folds are literals, so this is a map-only expansion."""
    y = F.col(year)
    roles = F.array_compact(F.array(*[
        F.when(hit, F.struct(F.lit(name).alias("fold"), F.lit(role).alias("role")))
        for name, t0, t1, v, s0, s1 in folds
        for role, hit in (("train", y.between(t0, t1)), ("val", y == v), ("test", y.between(s0, s1)))
    ]))
    return df.withColumn("__r", F.explode(roles)).select(*df.columns, "__r.fold", "__r.role")


def scores(df: DataFrame, by: list[str], label: str = "y_true", score: str = "y_prob", weight: str | None = None) -> DataFrame:
    """AUC (average ranks on ties), average precision, lift, Brier score and counts per group.

    All metrics are sums over distinct scores, so tied rows are merged before anything is ordered. AUC, precision and
    lift are NULL when only one class is present. With ``weight`` a row stands for that many rows with the same score, of
    which ``label`` are positive.
    """
    labelled = df.where(F.col(label).isNotNull()).select(
        *by, F.col(score).cast("double").alias("s"), F.col(label).cast("long").alias("pos"), *([F.col(weight).alias("__w")] if weight else [])
    )
    r = ranked_values(labelled, by, "s", ["pos"], unit_interval=True, weight="__w" if weight else None)
    neg = F.col("n") - F.col("pos")
    neg_before = F.col("n_before") - F.col("pos_before")
    precision = (F.col("pos_total") - F.col("pos_before")) / (F.col("n_total") - F.col("n_before"))
    grouped = r.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.sum("pos").alias("n_pos"),
        F.sum(F.col("pos") * (neg_before + neg * 0.5)).alias("__wins"),
        F.sum(F.col("pos") * precision).alias("__ap"),
        F.sum(F.col("pos") * F.pow(1.0 - F.col("s"), 2) + neg * F.col("s") * F.col("s")).alias("__sq"),
    )
    both = (F.col("n_pos") > 0) & (F.col("n_pos") < F.col("n"))
    rate = F.col("n_pos") / F.col("n")
    ap = F.col("__ap") / F.col("n_pos")
    return grouped.select(
        *by, "n", "n_pos", rate.alias("pos_rate"),
        F.when(both, F.col("__wins") / (F.col("n_pos") * (F.col("n") - F.col("n_pos")))).alias("auc"),
        F.when(both, ap).alias("ap"),
        F.when(both, ap / rate).alias("lift"),
        (F.col("__sq") / F.col("n")).alias("brier"),
    )


def area_scores(df: DataFrame, by: list[str], minimum: int = 100, label: str = "y_true", score: str = "y_prob") -> DataFrame:
    """Scores per area with two classes; average precision needs ``minimum`` rows; marks worse-than-random areas."""
    return (
        scores(df, by, label, score)
        .where(F.col("auc").isNotNull())
        .select(
            *by, "n", "pos_rate", "auc", F.when(F.col("n") >= minimum, F.col("ap")).alias("ap"), "brier",
            (F.col("auc") < 0.5).cast("int").alias("below_random"),
        )
    )


def probability_bin(score: Column | str, bins: int = 10) -> Column:
    """Equal-width bin number on [0, 1], the last one closed."""
    s = F.col(score) if isinstance(score, str) else score
    return F.least(F.floor(s * bins), F.lit(bins - 1)).cast("int")


def calibration(df: DataFrame, by: list[str], bins: int = 10, label: str = "y_true", score: str = "y_prob") -> DataFrame:
    """Mean predicted and observed per equal-width bin; empty bins are absent."""
    return (
        df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
        .groupBy(*by, probability_bin(score, bins).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_predicted"), F.avg(label).alias("mean_observed"))
        .withColumn("bin_low", F.col("bin") / float(bins))
        .withColumn("bin_high", (F.col("bin") + 1) / float(bins))
    )


def precision_at(
    df: DataFrame, key: list[str], sizes: tuple[int, ...] = (100, 500, 1000, 5000), label: str = "y_true",
    score: str = "y_prob",
) -> DataFrame:
    """Precision among the N best scores for each N not larger than the data; ties go by ``key``.

    Only the largest N rows are ever ordered together (a distributed top-N), whatever the data size.
    """
    total = df.agg(F.count(F.lit(1))).scalar()
    best = df.orderBy(F.col(score).desc(), *key).limit(max(sizes)).select(
        label, F.struct(-F.col(score), *key).alias("__o")
    )
    ranked = best.agg(F.transform(F.array_sort(F.collect_list(F.struct("__o", label))), lambda r: r[label]).alias("y"))
    wanted = F.filter(F.array(*[F.lit(n).cast("long") for n in sizes]), lambda n: n <= F.col("total"))
    hits = F.aggregate(F.slice("y", F.lit(1), F.col("top_n").cast("int")), F.lit(0).cast("long"), lambda a, v: a + v.cast("long"))
    return ranked.withColumn("total", total).select("y", F.explode(wanted).alias("top_n")).select(
        "top_n", hits.alias("n_true_positives"), (hits / F.col("top_n")).alias("precision")
    )


def decision_curve(df: DataFrame, by: list[str], label: str = "y_true", score: str = "y_prob") -> DataFrame:
    """Net benefit of treating scores at or above each threshold 0.01 .. 0.49.

    Rows are first counted by how many thresholds they reach (50 rows per group remain), then each threshold sums
    the counts that reach it.
    """
    thresholds = [round(0.01 * i, 2) for i in range(1, 50)]
    grid = F.array(*[F.lit(t) for t in thresholds])
    reached = F.size(F.filter(grid, lambda t: t <= F.col(score)))
    counts = (
        df.where(F.col(label).isNotNull())
        .groupBy(*by, reached.alias("reached"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(label).cast("long").alias("pos"))
    )
    indexed = F.transform(grid, lambda t, i: F.struct(t.alias("t"), (i + 1).alias("i")))
    per = counts.select(*by, "reached", "n", "pos", F.explode(indexed).alias("g")).groupBy(
        *by, F.col("g.t").alias("threshold")
    ).agg(
        F.sum("n").alias("__n"), F.sum("pos").alias("__p"),
        F.sum(F.when(F.col("reached") >= F.col("g.i"), F.col("n")).otherwise(0)).alias("n_treated"),
        F.sum(F.when(F.col("reached") >= F.col("g.i"), F.col("pos")).otherwise(0)).alias("n_caught"),
    )
    odds = F.col("threshold") / (1.0 - F.col("threshold"))
    model = (F.col("n_caught") - (F.col("n_treated") - F.col("n_caught")) * odds) / F.col("__n")
    everyone = (F.col("__p") - (F.col("__n") - F.col("__p")) * odds) / F.col("__n")
    return per.select(
        *by, "threshold", "n_treated", "n_caught", model.alias("nb_model"), everyone.alias("nb_treat_all"),
        F.lit(0.0).alias("nb_treat_none"), (model - everyone).alias("advantage_over_treat_all"),
    )


def fold_summary(per_fold: DataFrame, by: list[str], metric: str = "auc", unstable_above: float = 0.06) -> DataFrame:
    """Spread of a metric over folds, its worst fold, and whether it is unstable."""
    m = F.col(metric)
    return per_fold.where(m.isNotNull()).groupBy(*by).agg(
        F.count(m).alias("n_folds"), F.avg(m).alias("mean"), F.stddev_samp(m).alias("std"), F.min(m).alias("min"),
        F.max(m).alias("max"), F.min_by("fold", F.struct(m, F.col("fold"))).alias("worst_fold"),
        F.coalesce((F.stddev_samp(m) > unstable_above).cast("int"), F.lit(0)).alias("unstable"),
    )


def headline(per_fold: DataFrame, by: list[str]) -> DataFrame:
    """Mean and population deviation of AUC and AP over the folds that have both classes."""
    ok = per_fold.where(F.col("auc").isNotNull())
    return ok.groupBy(*by).agg(
        F.avg("auc").alias("mean_auc"), F.stddev_pop("auc").alias("std_auc"), F.avg("ap").alias("mean_ap"),
        F.stddev_pop("ap").alias("std_ap"), F.count(F.lit(1)).alias("n_folds"),
    )


def peer_deviation_overlay(
    df: DataFrame, peers: list[str], base: str, other: str, alphas: tuple[float, ...] = (0.10, 0.25, 0.50)
) -> DataFrame:
    """Re-score ``base`` by how far ``other`` sits above its peer mean: base * (1 + alpha * deviation), in [0, 1].

    One row per input row and alpha; alpha 0 is the unchanged baseline.
    """
    means = df.groupBy(*peers).agg(F.avg(other).alias("__mean"))
    shifted_rows = _match(df, means, peers).withColumn("deviation", F.col(other) - F.col("__mean")).drop("__mean")
    grid = F.array(*[F.lit(float(a)) for a in (0.0, *alphas)])
    final = F.least(F.greatest(F.col(base) * (1.0 + F.col("alpha") * F.col("deviation")), F.lit(0.0)), F.lit(1.0))
    return shifted_rows.withColumn("alpha", F.explode(grid)).withColumn("final", final)


def overlay_sweep(overlaid: DataFrame, label: str = "y_true", max_brier_growth: float | None = None) -> DataFrame:
    """Metrics per alpha with the best alpha by average precision marked.

    ``max_brier_growth`` excludes alphas whose Brier score exceeds the baseline's by more than that share.
    """
    per = scores(overlaid, ["alpha"], label, "final")
    base = per.where("alpha = 0").agg(F.max("brier")).scalar()
    eligible = F.col("alpha") > 0
    if max_brier_growth is not None:
        eligible = eligible & (F.col("brier") <= base * (1.0 + max_brier_growth))
    chosen = per.where(eligible).agg(F.max_by("alpha", F.struct(F.col("ap"), -F.col("alpha")))).scalar()
    return per.select("alpha", "auc", "ap", "brier", (F.col("alpha") == chosen).cast("int").alias("is_best"))


def elbow(sweep: DataFrame, k: str = "k", metric: str = "ap", share: float = 0.95) -> DataFrame:
    """Smallest k whose mean metric reaches ``share`` of the mean at the largest k."""
    means = sweep.groupBy(k).agg(F.avg(metric).alias("mean_metric"))
    full = means.agg(F.max_by("mean_metric", k)).scalar()
    return means.where(F.col("mean_metric") >= full * share).agg(F.min(k).alias("k"), F.max(full).alias("full_metric"))


def balance(df: DataFrame, by: list[str], labels: list[str]) -> DataFrame:
    """Positives, labelled rows and positive rate of each label column."""
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).cast("int").alias("v")) for c in labels]))
    return (
        df.select(*by, stacked.alias("__l"))
        .groupBy(*by, F.col("__l.label").alias("label"))
        .agg(F.count_if(F.col("__l.v") == 1).alias("n_pos"), F.count("__l.v").alias("n_labelled"))
        .withColumn("rate", ratio("n_pos", "n_labelled"))
    )
