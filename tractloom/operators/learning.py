"""Walk-forward model studies on MLlib.

All studies share ``walk_forward``: per fold it fits boosted trees on the training years, keeps the trees up to the best
average precision on the validation year, fits an isotonic calibration on the validation scores, and writes the scored
test years. A fold's roles are conditions on the one panel, so no fold copies it. Fits that do not depend on each other
are submitted side by side. Metrics are then computed for all runs and folds together. The loops on the driver run over
folds, groups or trials (a few dozen), never over rows.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import Bucketizer, Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import fresh_path, stored
from .evaluation import Fold, scores
from .feature_lists import leaks_label, numeric_columns
from .orderstats import quantile_columns


@dataclass(frozen=True)
class Settings:
    """Boosting settings; the defaults are the ones used for published runs.

    A fit ends ``patience`` rounds after the best one. ``first_rounds`` are grown before that is looked at for the first time.
    """

    rounds: int = 400
    depth: int = 6
    rate: float = 0.05
    subsample: float = 0.85
    feature_share: str = "0.85"
    min_rows: int = 5
    seed: int = 42
    patience: int = 25
    first_rounds: int = 40


def usable_features(df: DataFrame, allowed: list[str] | None = None, leaks: set[str] = frozenset()) -> list[str]:
    """Numeric columns that are allowed (all by default) and neither named leaks nor known to restate the label."""
    numeric = [c for c in numeric_columns(df.dtypes) if c not in leaks and not leaks_label(c)]
    return numeric if allowed is None else [c for c in allowed if c in numeric]


def common_columns(frames: list[DataFrame]) -> list[str]:
    """Columns every split has, in the order of the first."""
    shared = set.intersection(*[set(f.columns) for f in frames])
    return [c for c in frames[0].columns if c in shared]


def with_inputs(df: DataFrame, features: list[str]) -> DataFrame:
    """Model inputs: each feature as a double (``in_``) and a flag where it is missing (``na_``)."""
    doubles = [F.col(c).cast("double").alias(f"in_{c}") for c in features]
    return df.select("*", *doubles, *[F.col(c).isNull().cast("double").alias(f"na_{c}") for c in features])


#: Training rows that fits running side by side may hold in memory together (MLlib keeps some 200 bytes of each).
ROWS_AT_ONCE = 16_000_000


def room(rows: int, most: int) -> int:
    """How many fits of ``rows`` training rows run side by side: ``most`` while they are small, one when each fills the cluster."""
    return max(1, min(most, ROWS_AT_ONCE // max(1, rows)))


#: Training rows up to which a fit reads each by itself; of more rows those in the same bins are merged.
ROWS_APART = 200_000
#: Blocks that merged rows are dealt into, besides one for each kind of row, and their number in a part.
BLOCKS = 50_000
BLOCKS_IN_PART = 15_000


def held(rows: int) -> int:
    """How many rows or blocks a fit of ``rows`` training rows holds, as far as it is known before it begins."""
    return min(rows, ROWS_APART)


def side_by_side(tasks: dict[str, Callable], at_once: int = 4) -> dict:
    """Results of independent driver tasks, each of which submits Spark jobs of its own.

    Small fits wait for their own rounds most of the time; several at once fill the cluster. With spark.scheduler.mode FAIR
    they share it evenly. Properties of the calling thread (pool, job group) are passed on.
    """
    spark = SparkSession.active()

    def run(task: Callable):
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", "studies")
        return task()

    with ThreadPoolExecutor(at_once) as pool:
        running = {name: pool.submit(inheritable_thread_target(spark)(run), task) for name, task in tasks.items()}
        return {name: future.result() for name, future in running.items()}


def first_trees(model: GBTClassificationModel, n: int) -> GBTClassificationModel:
    """The model of the first ``n`` boosting rounds."""
    java, context = model._java_obj, SparkSession.active().sparkContext
    ml, given, of = context._jvm.org.apache.spark.ml, java.trees(), java.treeWeights()
    trees, weights = context._gateway.new_array(ml.regression.DecisionTreeRegressionModel, n), context._gateway.new_array(context._jvm.double, n)
    for i in range(n):
        trees[i], weights[i] = given[i], of[i]
    cut = ml.classification.GBTClassificationModel(model.uid, trees, weights, java.numFeatures(), 2)
    return GBTClassificationModel(cut).setFeaturesCol(model.getFeaturesCol())


def node_table(model: GBTClassificationModel, spark: SparkSession) -> list:
    """Nodes of all trees, read from the saved model; rounds and depth bound their number."""
    path = fresh_path(spark, "model")
    model.write().save(path)
    return spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()


def alike(
    model: GBTClassificationModel, rows: DataFrame, inputs: list[str], by: list[str], sums: list[str], nodes: list | None = None,
    least: list[str] | None = None,
) -> DataFrame:
    """One row for all rows of ``by`` that no tree can tell apart: ``by``, ``least`` (``inputs`` by default), ``sums`` and their number ``__n``.

    Trees only ask on which side of a threshold an input lies, so rows between the same thresholds get the same leaves from
    every prefix of the model. There are at most 31 thresholds to an input, so the groups stop growing where the rows go on. The
    least values of a group's inputs (or of ``least``, which they are binned from) lie between the same thresholds and stand for it.
    """
    least = least or inputs
    cuts: dict[int, set[float]] = {}
    for n in nodes or node_table(model, rows.sparkSession):
        if n["leftChild"] >= 0:
            cuts.setdefault(n["split"]["featureIndex"], set()).add(n["split"]["leftCategoriesOrThreshold"][0])

    def side(i: int) -> Column:
        x, (first, *rest) = F.col(inputs[i]), sorted(cuts[i])
        out = F.when(x <= first, 0)
        for at, cut in enumerate(rest, 1):
            out = out.when(x <= cut, at)
        return out.otherwise(len(rest) + 1).alias(f"__side{i}")

    grouped = rows.groupBy(*by, *[side(i) for i in sorted(cuts)]).agg(
        *[F.min(c).alias(c) for c in least], *[F.sum(c).alias(c) for c in sums], F.count(F.lit(1)).alias("__n")
    )
    return grouped.select(*by, *least, *sums, "__n")


def prefix_probabilities(
    model: GBTClassificationModel, rows: DataFrame, keep: list[str], after: int = 0, nodes: list | None = None
) -> DataFrame:
    """Each row's probability after every round but the first ``after``: ``keep``, prefix (from 1), y_prob.

    One pass finds the leaves of all trees.
    """
    leaves: dict[int, list[tuple[int, float]]] = {}
    for n in nodes or node_table(model, rows.sparkSession):
        if n["leftChild"] < 0:
            leaves.setdefault(n["treeID"], []).append((n["id"], n["prediction"]))
    # nodes are numbered from left to right, as leaves are
    weighted = [np.array([v for _, v in sorted(leaves[t])]) * w for t, w in enumerate(model.treeWeights)]
    starts = np.cumsum([0, *map(len, weighted)])[:-1]
    flat = np.concatenate(weighted)

    @F.pandas_udf("array<double>")
    def along(leaf: pd.Series) -> pd.Series:
        if not len(leaf):
            return pd.Series([], dtype=object)
        margins = np.cumsum(flat[np.stack(leaf.to_numpy()).astype(np.int64) + starts], axis=1)
        return pd.Series(list(1.0 / (1.0 + np.exp(-2.0 * margins[:, after:]))))

    found = model.copy({model.leafCol: "__leaf"}).transform(rows).select(*keep, along(vector_to_array("__leaf")).alias("__p"))
    return found.select(*keep, F.posexplode("__p").alias("__at", "y_prob")).select(*keep, (F.col("__at") + 1 + after).alias("prefix"), "y_prob")


def best_prefix(quality: list[float | None], patience: int) -> tuple[int, bool]:
    """Length of the best prefix (the shortest of equals), and whether ``patience`` rounds without gain followed it.

    Rounds after that point are not looked at. Unknown qualities count as no gain; if none is known, all rounds are kept.
    """
    best, value = 0, -math.inf
    for i, q in enumerate(quality, 1):
        if q is not None and q > value:
            best, value = i, q
        elif best and i - best >= patience:
            return best, True
    return best or len(quality), False


def bins(rows: DataFrame, columns: list[str], most: int = 32) -> Bucketizer:
    """Bins ``bin_`` of the columns ``im_``: one to a value where these are few, else ``most`` of equal shares of all rows.

    MLlib's trees put their thresholds between as many bins, which they set on a draw of 10,000 rows.
    """
    shares = [i / most for i in range(1, most)]
    seen = rows.agg(*[
        F.struct(F.approx_count_distinct(c).alias("n"), F.percentile_approx(c, shares, 10_000).alias("cuts")).alias(c) for c in columns
    ]).first()
    few = [c for c in columns if seen[c]["n"] <= most]
    values = rows.agg(*[F.collect_set(c).alias(c) for c in few]).first() if few else {}
    splits = []
    for c in columns:
        known = sorted(set(values[c])) if c in few else []
        cuts = [(a + b) / 2 for a, b in zip(known, known[1:])] if 0 < len(known) <= most else seen[c]["cuts"]
        splits.append([-math.inf, *(sorted({x for x in cuts if math.isfinite(x)}) or [0.0]), math.inf])
    return Bucketizer(splitsArray=splits, inputCols=columns, outputCols=[c.replace("im_", "bin_", 1) for c in columns])


def blocks(rows: DataFrame, kind: list[str], n: int) -> DataFrame:
    """The ``n`` rows, merged where they agree in ``kind``: its columns and the number of rows ``__w`` of each block.

    A kind of many rows is dealt into equal blocks, so that bagging, which takes or leaves a block, thins it about evenly. There
    are at most ``BLOCKS`` more blocks than kinds, and these are bounded by the bins, not by the rows.
    """
    kinds = stored(rows.groupBy(*kind).agg(F.count(F.lit(1)).alias("__n")), "kinds")
    parts = math.ceil((kinds.count() + BLOCKS) / BLOCKS_IN_PART)
    dealt = F.ceil(F.col("__n") * BLOCKS / n)
    each = kinds.select(*kind, (F.col("__n") / dealt).alias("__w"), F.explode(F.sequence(F.lit(1).cast("long"), dealt)).alias("__k"))
    return each.repartition(parts, *kind, "__k").sortWithinPartitions(*kind, "__k").drop("__k")


@dataclass
class Prepared:
    """Training and validation rows as fits read them: imputed with the training medians.

    Where training rows are merged, ``__w`` is a block's number of rows and ``merged`` the number of all.
    """

    prepare: Model
    assembler: VectorAssembler
    train: DataFrame
    val: DataFrame
    merged: int = 0


@contextmanager
def prepared_inputs(train: DataFrame, val: DataFrame, features: list[str], label: str) -> Iterator[Prepared]:
    """Median imputation (learned on the training rows) and missing flags, once for all fits on these rows.

    The rows are kept in memory, once, while the fits go on, and in their own parts: bagging draws by part. Above ``ROWS_APART``
    the inputs are binned as finely as the trees can split them; rows of the same bins and label have the same share in every
    round, so they are merged, and a round costs what the kinds of rows cost, however many rows there are.
    """
    flags = [f"na_{c}" for c in features]
    given = [f"in_{c}" for c in features] + flags + ["__y"]
    rows, held_out = (with_inputs(df, features).withColumn("__y", F.col(label).cast("double")).select(*given) for df in (train, val))
    imputer = Imputer(strategy="median", inputCols=[f"in_{c}" for c in features], outputCols=[f"im_{c}" for c in features])
    n, kept = rows.count(), [held_out.persist()]
    try:
        if n <= ROWS_APART:
            kept.append(rows.persist())
            prepare = imputer.fit(rows)
            assembler = VectorAssembler(inputCols=[f"im_{c}" for c in features] + flags, outputCol="__x")
            fitted = assembler.transform(prepare.transform(rows)).select("__x", "__y")
        else:
            medians = imputer.fit(rows)
            cut = bins(medians.transform(rows), [f"im_{c}" for c in features])
            prepare = PipelineModel([medians, cut])
            assembler = VectorAssembler(inputCols=cut.getOutputCols() + flags, outputCol="__x")
            # bins are numbers in their order; the Bucketizer notes them as categories, which trees would split in any order
            ordered = reduce(lambda df, c: df.withMetadata(c, {}), cut.getOutputCols(), prepare.transform(rows))
            merged = blocks(ordered, [*assembler.getInputCols(), "__y"], n).persist()
            kept.append(merged)
            fitted = assembler.transform(merged).select("__x", "__y", "__w")
        yield Prepared(prepare, assembler, fitted, prepare.transform(held_out), n if n > ROWS_APART else 0)
    finally:
        for df in kept:
            df.unpersist()


def fit_trees(train: DataFrame, val: DataFrame, features: list[str], label: str, settings: Settings) -> PipelineModel:
    """Median imputation (learned on the training rows), missing flags, boosted trees up to the best average precision on ``val``."""
    with prepared_inputs(train, val, features, label) as inputs:
        return fit_prepared(inputs, settings)


def fit_prepared(inputs: Prepared, settings: Settings) -> PipelineModel:
    """Boosted trees up to the best average precision on the validation rows.

    Rounds are grown in steps: a longer run with the same seed starts with the same trees, so the number of rounds is taken
    four times as large (40, 160, 400: 600 rounds at most) until the best one lies ``patience`` back or all are used. Each step scores its new prefixes in one pass, over groups of
    validation rows that the trees cannot tell apart.
    """
    assembler, spark = inputs.assembler, inputs.train.sparkSession
    # a leaf of merged rows is as heavy as one of so many rows
    leaf = {"minInstancesPerNode": settings.min_rows} if not inputs.merged else {
        "weightCol": "__w", "minWeightFractionPerNode": max(0.0, settings.min_rows - 0.5) / inputs.merged
    }
    found: dict[int, float | None] = {}
    rounds = min(settings.rounds, max(settings.first_rounds, settings.patience + 1))
    while True:
        trees = GBTClassifier(
            labelCol="__y", featuresCol="__x", maxIter=rounds, maxDepth=settings.depth, stepSize=settings.rate,
            subsamplingRate=settings.subsample, featureSubsetStrategy=settings.feature_share,
            seed=settings.seed, cacheNodeIds=False, **leaf,
        )
        model = trees.fit(inputs.train)
        grown = len(model.treeWeights)
        nodes = node_table(model, spark)
        groups = assembler.transform(alike(model, inputs.val, assembler.getInputCols(), [], ["__y"], nodes))
        probabilities = prefix_probabilities(model, groups, ["__y", "__n"], len(found), nodes)
        found |= {r["prefix"]: r["ap"] for r in scores(probabilities, ["prefix"], "__y", weight="__n").select("prefix", "ap").collect()}
        best, stopped = best_prefix([found.get(i) for i in range(1, grown + 1)], settings.patience)
        if stopped or rounds >= settings.rounds:
            return PipelineModel([inputs.prepare, assembler, first_trees(model, best)])
        rounds = min(settings.rounds, 4 * rounds)


def predict(model: PipelineModel, df: DataFrame, features: list[str], output: str = "y_prob") -> DataFrame:
    scored = model.transform(with_inputs(df, features))
    return scored.select(*df.columns, vector_to_array("probability")[1].alias(output))


def fit_calibration(scored_val: DataFrame, label: str, score: str = "y_prob") -> IsotonicRegressionModel:
    iso = IsotonicRegression(featuresCol=score, labelCol="__y", predictionCol="y_prob_calibrated")
    return iso.fit(scored_val.select(F.col(label).cast("double").alias("__y"), score))


def calibrated(model: IsotonicRegressionModel, scored: DataFrame) -> DataFrame:
    out = model.transform(scored)
    return out.withColumn("y_prob_calibrated", F.least(F.greatest("y_prob_calibrated", F.lit(0.0)), F.lit(1.0)))


def importances(model: PipelineModel, features: list[str], fold: str, spark) -> DataFrame:
    """Importance per feature; a missing flag's importance belongs to its feature."""
    values = model.stages[-1].featureImportances.toArray()
    n = len(features)
    return spark.createDataFrame(
        [(fold, f, float(values[i] + values[n + i])) for i, f in enumerate(features)], "fold string, feature string, importance double"
    )


@dataclass
class Study:
    """Stored test predictions and the per-fold importances of one walk-forward run."""

    predictions: DataFrame
    importance: DataFrame
    models: dict[str, PipelineModel]
    calibrations: dict[str, IsotonicRegressionModel]


Roles = dict[str, dict[str, Column]]


def fold_roles(folds: list[Fold], year: str = "year") -> Roles:
    """Per fold the conditions of its training, validation and test rows."""
    y = F.col(year)
    return {name: {"train": y.between(t0, t1), "val": y == v, "test": y.between(s0, s1)} for name, t0, t1, v, s0, s1 in folds}


def walk_forward(
    panel: DataFrame, features: list[str], label: str, folds: list[Fold] | Roles, settings: Settings = Settings(),
    keys: tuple[str, ...] = ("tract_fips", "year"), at_once: int = 8, beside: int = 1,
) -> Study:
    """Fit, calibrate and score every fold; a fold with an empty split is skipped.

    ``folds`` are year ranges, or conditions per fold and role (``spatial_splits``). ``beside`` is the number of such runs
    that go on at the same time.
    """
    roles = folds if isinstance(folds, dict) else fold_roles(folds)
    labelled = panel.where(F.col(label).isNotNull())
    counts = labelled.agg(*[F.count_if(hit).alias(f"{fold}/{role}") for fold, of in roles.items() for role, hit in of.items()]).first()
    path = fresh_path(panel.sparkSession, "predictions")
    usable = [fold for fold, of in roles.items() if all(counts[f"{fold}/{role}"] for role in of)]
    if not usable:
        raise ValueError("no fold has training, validation and test rows")

    def run(fold: str):
        part = {role: labelled.where(hit) for role, hit in roles[fold].items()}
        model = fit_trees(part["train"], part["val"], features, label, settings)
        iso = fit_calibration(predict(model, part["val"], features), label)
        scored = calibrated(iso, predict(model, part["test"], features)).withColumn("fold", F.lit(fold))
        scored.select(*keys, "fold", F.col(label).cast("int").alias("y_true"), "y_prob", "y_prob_calibrated").write.parquet(f"{path}/{fold}")
        return model, iso

    abreast = room(beside * max(held(counts[f"{fold}/train"]) for fold in usable), at_once)
    fitted = side_by_side({fold: lambda fold=fold: run(fold) for fold in usable}, abreast)
    spark = panel.sparkSession
    return Study(
        spark.read.parquet(*[f"{path}/{fold}" for fold in usable]),
        reduce(DataFrame.unionByName, [importances(model, features, fold, spark) for fold, (model, _) in fitted.items()]),
        {fold: model for fold, (model, _) in fitted.items()}, {fold: iso for fold, (_, iso) in fitted.items()},
    )


def study_metrics(runs: dict[str, Study], score: str = "y_prob") -> DataFrame:
    """Metrics of all runs and folds in one pass."""
    tagged = [s.predictions.withColumn("run", F.lit(name)) for name, s in runs.items()]
    return scores(reduce(DataFrame.unionByName, tagged), ["run", "fold"], "y_true", score)


def ablation_deltas(per_fold: DataFrame, run: str, baseline: str) -> DataFrame:
    """Mean metrics of each run minus the baseline run's."""
    means = per_fold.groupBy(run).agg(F.avg("auc").alias("auc"), F.avg("ap").alias("ap"))
    base = means.where(F.col(run) == baseline).agg(F.first(F.struct("auc", "ap"))).scalar()
    return means.where(F.col(run) != baseline).select(
        run, "auc", "ap", (F.col("auc") - base["auc"]).alias("delta_auc"), (F.col("ap") - base["ap"]).alias("delta_ap")
    )


def ablate(
    panel: DataFrame, features: list[str], groups: dict[str, list[str]], label: str, folds: list[Fold],
    settings: Settings = Settings(), score: str = "y_prob",
) -> DataFrame:
    """Refit without each feature group and compare with the full model."""
    left = {"baseline": features} | {name: [f for f in features if f not in members] for name, members in groups.items()}
    kept = {name: fs for name, fs in left.items() if fs and (name == "baseline" or len(fs) < len(features))}
    beside = room(held(panel.where(F.col(label).isNotNull()).count()), 4)
    runs = side_by_side({name: lambda fs=fs: walk_forward(panel, fs, label, folds, settings, at_once=2, beside=beside) for name, fs in kept.items()}, beside)
    return ablation_deltas(stored(study_metrics(runs, score), "ablation"), "run", "baseline")


def prune(
    panel: DataFrame, features: list[str], ks: list[int], label: str, folds: list[Fold], settings: Settings = Settings()
) -> DataFrame:
    """Metrics with only the k most important features, per k and fold."""
    full = walk_forward(panel, features, label, folds, settings)
    order = full.importance.groupBy("feature").agg(F.avg("importance").alias("i")).orderBy(F.desc("i"), "feature")
    ranked = [r["feature"] for r in order.collect()]  # one row per feature
    beside = room(held(panel.where(F.col(label).isNotNull()).count()), 4)
    shorter = {str(k): lambda k=k: walk_forward(panel, ranked[:k], label, folds, settings, at_once=2, beside=beside) for k in ks if k < len(features)}
    runs = {str(len(features)): full} | side_by_side(shorter, beside)
    return study_metrics(runs).withColumn("k", F.col("run").cast("int")).drop("run")


def permutation_importance(
    model: PipelineModel, rows: DataFrame, features: list[str], label: str, key: list[str], repeats: int = 3, seed: int = 42,
    rows_in_bucket: int = 10000,
) -> DataFrame:
    """Drop in average precision when one feature's values are permuted over all labelled rows.

    Per repeat the rows fall into hash buckets, whose number follows the rows, and each row takes the value of the next
    row of its bucket in hash order, the last one that of the first: a permutation of the whole column without numbering
    rows in one task. All variants are scored together. ``key`` must be unique for the buckets to stay small.
    """
    labelled = stored(rows.where(F.col(label).isNotNull()).select(*key, label, *[f for f in features if f not in key]), "labelled")
    buckets = max(1, math.ceil(labelled.count() / rows_in_bucket))
    given = F.struct(*features)
    variants = [labelled.select(F.lit("none").alias("feature"), F.lit(0).alias("repeat"), label, *features)]
    for r in range(repeats):
        at = labelled.withColumns({"__h": F.xxhash64(*key, F.lit(seed + r))}).withColumn("__b", F.pmod("__h", F.lit(buckets)))
        bucket = Window.partitionBy("__b").orderBy("__h", *key)
        partner = F.coalesce(F.lead(given).over(bucket), F.first(given).over(bucket))
        paired = at.select(F.col(label).alias("__label"), given.alias("__own"), partner.alias("__other"))
        moved = F.explode(F.array(*[
            F.struct(F.lit(f).alias("feature"), *[F.col(f"{'__other' if g == f else '__own'}.{g}").alias(g) for g in features]) for f in features
        ]))
        variants.append(
            paired.select("__label", moved.alias("__v"))
            .select("__v.feature", F.lit(r).alias("repeat"), F.col("__label").alias(label), *[f"__v.{g}" for g in features])
        )
    stacked = reduce(DataFrame.unionByName, variants)
    per = stored(scores(predict(model, stacked, features), ["feature", "repeat"], label), "permutation")
    base = per.where("feature = 'none'").agg(F.first("ap")).scalar()
    return per.where("feature <> 'none'").groupBy("feature").agg(
        F.avg(base - F.col("ap")).alias("ap_drop"), F.stddev_samp(base - F.col("ap")).alias("ap_drop_std")
    )


def spatial_splits(panel: DataFrame, area: str, key: list[str], folds: int = 5, seed: int = 42) -> dict[str, Roles]:
    """Roles for random k-fold and leave-one-area-out runs.

    Validation rows are a tenth of the training side, chosen by key hash, so repeated runs agree. Roles are conditions on the
    panel, which is never copied. A missing area is a place of its own.
    """
    bucket = F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(folds))
    tenth = F.pmod(F.xxhash64(*key, F.lit(seed + 1)), F.lit(10)) == 0

    def roles(is_test: Column) -> dict[str, Column]:
        return {"train": ~is_test & ~tenth, "val": ~is_test & tenth, "test": is_test}

    areas = [r[0] for r in panel.select(area).distinct().orderBy(area).collect()]  # a few dozen areas
    return {
        "random": {f"R{i}": roles(bucket == i) for i in range(folds)},
        "leave_one_out": {f"S{a}": roles(F.col(area).eqNullSafe(F.lit(a))) for a in areas},
    }


def tune(
    panel: DataFrame, features: list[str], label: str, fold: Fold, trials: int = 30, seed: int = 42,
    base: Settings = Settings(),
) -> DataFrame:
    """Random search over depth, rate, subsample and leaf size, scored on the fold's validation year."""
    rng = random.Random(seed)
    labelled, roles = panel.where(F.col(label).isNotNull()), fold_roles([fold])[fold[0]]
    train, val = labelled.where(roles["train"]), labelled.where(roles["val"])
    drawn = [
        replace(base, depth=rng.randint(2, base.depth), rate=10 ** rng.uniform(-2, -0.5), subsample=rng.uniform(0.6, 1.0), min_rows=rng.choice([1, 5, 20, 50]))
        for _ in range(trials)
    ]

    def run(t: int, s: Settings) -> DataFrame:
        model = fit_prepared(inputs, s)
        out = predict(model, val, features).select(F.col(label).alias("y_true"), "y_prob")
        given = {"trial": F.lit(t), "depth": F.lit(s.depth), "rate": F.lit(s.rate), "subsample": F.lit(s.subsample), "min_rows": F.lit(s.min_rows)}
        return stored(out.withColumns(given | {"rounds": F.lit(len(model.stages[-1].treeWeights))}), "trial")

    fits = {str(t): lambda t=t, s=s: run(t, s) for t, s in enumerate(drawn)}
    with prepared_inputs(train, val, features, label) as inputs:
        both = reduce(DataFrame.unionByName, side_by_side(fits, room(held(train.count()), 8)).values())
    names = ["trial", "depth", "rate", "subsample", "min_rows", "rounds"]
    return scores(both, names).select(*names, "auc", "ap")


def partial_dependence(
    model: PipelineModel, rows: DataFrame, features: list[str], expected: dict[str, str], points: int = 20,
) -> DataFrame:
    """Average prediction of all rows over a grid per feature, and whether its slope has the expected sign.

    The grid runs from the 5th to the 95th percentile of the non-null values. A caller who wants fewer rows draws them first.
    Rows are counted in the groups that the trees cannot tell apart, and each point of a grid is put to every group once.
    """
    kept = stored(rows.select(*features), "dependence")
    prepare, assembler, trees = model.stages
    raw = [f"{kind}_{f}" for kind in ("im", "na") for f in features]
    merged = alike(trees, prepare.transform(with_inputs(kept, features)), assembler.getInputCols(), [], [], least=raw)
    groups = stored(merged.withColumnsRenamed({f"im_{f}": f"in_{f}" for f in features}), "dependence-groups")
    variants = []
    for f in expected:
        cuts = quantile_columns(kept, [], f, {"lo": 0.05, "hi": 0.95})
        grid = cuts.select(F.explode(F.transform(
            F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / (points - 1))).alias("__g"))
        values = grid.agg(F.collect_list("__g")).scalar()
        # a value from the grid is a known one
        moved = groups.withColumn("__g", F.explode(values)).withColumns({f"in_{f}": F.col("__g"), f"na_{f}": F.lit(0.0)})
        scored = model.transform(moved)
        variants.append(scored.select(F.lit(f).alias("feature"), F.col("__g").alias("at"), vector_to_array("probability")[1].alias("y_prob"), "__n"))
    mean = F.sum(F.col("y_prob") * F.col("__n")) / F.sum("__n")
    curve = reduce(DataFrame.unionByName, variants).groupBy("feature", "at").agg(mean.alias("mean_prob"))
    slopes = curve.groupBy("feature").agg(F.count(F.lit(1)).alias("n_points"), F.regr_slope("mean_prob", "at").alias("slope"))
    want = F.lit(None).cast("string")
    for f, direction in expected.items():
        want = F.when(F.col("feature") == f, direction).otherwise(want)
    observed = F.when(F.col("slope") > 0, "up").otherwise("down")
    return slopes.select("feature", "n_points", want.alias("expected"), observed.alias("observed"), "slope", (want == observed).cast("int").alias("match"))


def final_model(
    panel: DataFrame, features: list[str], label: str, data_end: int, horizon: int, settings: Settings = Settings()
) -> tuple[PipelineModel, IsotonicRegressionModel]:
    """Deployable model: the last labelled year validates, everything earlier trains."""
    last = data_end - horizon
    labelled = panel.where(F.col(label).isNotNull())
    val = labelled.where(F.col("year") == last)
    model = fit_trees(labelled.where(F.col("year") < last), val, features, label, settings)
    return model, fit_calibration(predict(model, val, features), label)


Deployed = dict[tuple[str, int], tuple[PipelineModel, IsotonicRegressionModel]]


def final_models(
    panel: DataFrame, models: dict[str, list[str]], labels: dict[int, str], data_end: int, settings: Settings = Settings()
) -> Deployed:
    """A deployable model for each (model, horizon): ``models`` names the features, ``labels`` the label of each horizon."""
    tasks = {
        (name, h): lambda fs=fs, label=label, h=h: final_model(panel, fs, label, data_end, h, settings)
        for name, fs in models.items() for h, label in labels.items()
    }
    return side_by_side(tasks, room(held(panel.count()), 4))


def save_models(fitted: Deployed, path: str) -> None:
    """Write every model and its calibration below ``path``, one folder per (model, horizon)."""
    for (name, horizon), (model, iso) in fitted.items():
        model.write().save(f"{path}/{name}/h{horizon}/trees")
        iso.write().save(f"{path}/{name}/h{horizon}/calibration")


def load_models(path: str, keys: list[tuple[str, int]]) -> Deployed:
    return {
        (name, h): (PipelineModel.load(f"{path}/{name}/h{h}/trees"), IsotonicRegressionModel.load(f"{path}/{name}/h{h}/calibration")) for name, h in keys
    }


def score_models(rows: DataFrame, fitted: Deployed, models: dict[str, list[str]], keys: list[str]) -> DataFrame:
    """Raw and calibrated probability of every row under every model: keys, model, horizon, y_prob, y_prob_calibrated.

    The rows are scored model after model within one pass; no join brings the scores together.
    """
    inputs = sorted({f for name, _ in fitted for f in models[name]})
    wide, found = rows.select(*keys, *[f for f in inputs if f not in keys]), []
    for (name, horizon), (model, iso) in fitted.items():
        given = wide.columns
        tag = f"{name}_{horizon}"
        scored = calibrated(iso, predict(model, wide, models[name])).withColumn(f"__{tag}", F.struct("y_prob", "y_prob_calibrated"))
        wide = scored.select(*given, f"__{tag}")
        found.append(F.struct(F.lit(name).alias("model"), F.lit(horizon).alias("horizon"), F.col(f"__{tag}.y_prob"), F.col(f"__{tag}.y_prob_calibrated")))
    return wide.select(*keys, F.explode(F.array(*found)).alias("s")).select(*keys, "s.*")


def linear_attributions(df: DataFrame, keys: list[str], coefficients: dict[str, float]) -> DataFrame:
    """Exact attributions of a linear log-odds model: coefficient times distance from the mean, long."""
    means = df.agg(F.struct(*[F.avg(c).alias(c) for c in coefficients])).scalar()
    centred = df.withColumn("__m", means)
    entries = [
        F.struct(F.lit(c).alias("feature"), ((F.col(c) - F.col(f"__m.{c}")) * w).alias("attribution")) for c, w in coefficients.items()
    ]
    return centred.select(*keys, F.explode(F.array(*entries)).alias("e")).select(*keys, "e.feature", "e.attribution")


def tree_paths(model: PipelineModel, spark) -> list[tuple[float, list[tuple[int, float, float, float]]]]:
    """Leaves of all trees as (weighted value, [(input, low, high, share of rows)]), one entry per input on the path.

    Read from the model's saved node table, whose size is bounded by rounds and depth.
    """
    gbt = model.stages[-1]
    nodes = node_table(gbt, spark)
    weights = gbt.treeWeights
    by_tree: dict[int, dict[int, object]] = {}
    for n in nodes:
        by_tree.setdefault(n["treeID"], {})[n["id"]] = n
    leaves = []
    for tree, table in by_tree.items():
        stack = [(0, {})]
        while stack:
            ident, limits = stack.pop()
            node = table[ident]
            if node["leftChild"] < 0:
                leaves.append((weights[tree] * node["prediction"], [(i, *v) for i, v in limits.items()]))
                continue
            i, cut = node["split"]["featureIndex"], node["split"]["leftCategoriesOrThreshold"][0]
            for child, left in ((node["leftChild"], True), (node["rightChild"], False)):
                low, high, share = limits.get(i, (-math.inf, math.inf, 1.0))
                share *= table[child]["impurityStats"][0] / node["impurityStats"][0]  # rows, also where they are merged
                bounds = (low, min(high, cut), share) if left else (max(low, cut), high, share)
                stack.append((child, {**limits, i: bounds}))
    return leaves


def tree_attributions(model: PipelineModel, df: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """Shapley attributions of boosted trees to the log-odds, long (keys, feature, attribution), zeros included.

    Per leaf, an input on the path either follows the row (its rows satisfy the path's limits or not) or is unknown
    (the share of training rows that go that way). Averaging over all orders of the path's inputs needs only the
    elementary symmetric sums of these factors. The boosted margin counts twice in the log-odds.
    """
    spark = df.sparkSession
    leaves = spark.sparkContext.broadcast(tree_paths(model, spark))
    n_features = len(features)

    def contributions(x: np.ndarray) -> np.ndarray:
        phi = np.zeros((len(x), n_features))
        for value, path in leaves.value:
            m = len(path)
            if m == 0:
                continue
            follows = [((x[:, i] > low) & (x[:, i] <= high)).astype(float) for i, low, high, _ in path]
            for a, (i, _, _, share) in enumerate(path):
                sums = [np.ones(len(x))]
                for b, (_, _, _, z) in enumerate(path):
                    if b != a:
                        o = follows[b]
                        sums = [
                            (sums[k] * z if k < len(sums) else 0) + (sums[k - 1] * o if k > 0 else 0) for k in range(len(sums) + 1)
                        ]
                weight = sum(s * (math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m)) for k, s in enumerate(sums))
                phi[:, i % n_features] += 2.0 * value * (follows[a] - share) * weight
        return phi

    def attribute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            phi = contributions(np.stack(pdf["x"].to_numpy())) if len(pdf) else np.zeros((0, n_features))
            yield pdf[keys].assign(values=list(phi))

    inputs = PipelineModel(model.stages[:-1]).transform(with_inputs(df, features)).select(*keys, vector_to_array("__x").alias("x"))
    schema = ", ".join(f"{k} {dict(df.dtypes)[k]}" for k in keys) + ", values array<double>"
    long = inputs.mapInPandas(attribute, schema).select(*keys, F.posexplode("values").alias("i", "attribution"))
    names = F.array(*[F.lit(f) for f in features])
    return long.select(*keys, F.get(names, F.col("i")).alias("feature"), "attribution")


