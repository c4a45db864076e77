"""Queries: folds, ranking and calibration metrics, overlays."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.risk import signal_verdict
from ..operators import evaluation as E
from ..operators import serving
from ..plans.domain import Domain
from ..session import stored
from .registry import query, rounded

# the data's years start in 1995, so the fold shapes are moved there
HERE = E.shifted(E.build_folds(6)[:4], 1995 - 2009)


@query("m01_fold_table", """
    WITH p AS (SELECT min(year(o_orderdate)) AS y FROM orders), h AS (SELECT unnest([1, 3, 6]) AS h), i AS (SELECT unnest(range(8)) AS i)
    SELECT CAST(h AS INTEGER) AS horizon, 'F' || (i + 1) AS fold, CAST(y AS INTEGER) AS train_start,
      CAST(y + CASE h WHEN 1 THEN 5 WHEN 3 THEN 3 ELSE 1 END + i AS INTEGER) AS train_end, CAST(y + CASE h WHEN 1 THEN 6 WHEN 3 THEN 4 ELSE 2 END + i AS INTEGER) AS val_year,
      CAST(y + CASE h WHEN 1 THEN 7 WHEN 3 THEN 5 ELSE 3 END + i AS INTEGER) AS test_start,
      CAST(least(y + CASE h WHEN 1 THEN 8 WHEN 3 THEN 6 ELSE 4 END + i, CASE WHEN h = 3 THEN y + 12 ELSE 9999 END) AS INTEGER) AS test_end
    FROM p, h, i WHERE h < 6 OR i < 6""")
def _(d: Domain):
    first = d.table("orders").agg(F.min(F.year("o_orderdate"))).scalar()
    parts = [E.folds_frame(d.spark, E.build_folds(h)).withColumn("horizon", F.lit(h)) for h in (1, 3, 6)]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    years = ["train_start", "train_end", "val_year", "test_start", "test_end"]
    return out.select("horizon", "fold", *[(F.col(y) - 2009 + first).cast("int").alias(y) for y in years])


@query("m02_fold_assignment", """
    WITH f(fold, a, b, v, s, t) AS (VALUES ('F1', 1995, 1996, 1997, 1998, 1999), ('F2', 1995, 1997, 1998, 1999, 2000),
      ('F3', 1995, 1998, 1999, 2000, 2001), ('F4', 1995, 1999, 2000, 2001, 2002))
    SELECT tract_fips, year, f.fold, 'train' AS role FROM d_panel JOIN f ON year BETWEEN a AND b
    UNION ALL SELECT tract_fips, year, f.fold, 'val' FROM d_panel JOIN f ON year = v
    UNION ALL SELECT tract_fips, year, f.fold, 'test' FROM d_panel JOIN f ON year BETWEEN s AND t""")
def _(d: Domain):
    return E.assign_folds(d.panel().select("tract_fips", "year"), HERE)


def _auc_sql(source: str, by: str) -> str:
    """Independent definition: ranks over all rows, then sums."""
    part = f"PARTITION BY {by}" if by else ""
    comma = f"{by}, " if by else ""
    return f"""
    r AS (SELECT {comma}s, y, rank() OVER ({part} ORDER BY s) + (count(*) OVER (PARTITION BY {comma}s) - 1) / 2.0::DOUBLE AS rk,
            sum(y) OVER ({part} ORDER BY s DESC RANGE UNBOUNDED PRECEDING) AS tp, count(*) OVER ({part} ORDER BY s DESC RANGE UNBOUNDED PRECEDING) AS cnt FROM {source}),
    m AS (SELECT {comma}count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos, sum(y) / count(*) AS pos_rate,
            (sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / nullif(sum(y) * (count(*) - sum(y)), 0) AS auc,
            CASE WHEN sum(y) BETWEEN 1 AND count(*) - 1 THEN sum(tp / cnt) FILTER (y = 1) / sum(y) END AS ap, avg(pow(s - y, 2)) AS brier FROM r GROUP BY ALL)"""


@query("m05_fold_metrics", f"""
    WITH src AS (SELECT fold, y_prob AS s, y_true AS y FROM d_scored), {_auc_sql('src', 'fold')}
    SELECT fold, n, n_pos, round(pos_rate, 6) AS pos_rate, round(auc, 6) AS auc, round(ap, 6) AS ap, round(ap / pos_rate, 5) AS lift, round(brier, 6) AS brier FROM m""")
def _(d: Domain):
    return rounded(E.scores(d.scored(), ["fold"]), lift=5)


@query("m05_document_quality_metrics", f"""
    WITH src AS (SELECT lang, 1 - 1000 / (1000.0::DOUBLE + n_chars) AS s, quality AS y FROM documents JOIN labels ON documents.doc_id = labels.doc_id), {_auc_sql('src', 'lang')}
    SELECT lang, n, n_pos, round(pos_rate, 6) AS pos_rate, round(auc, 6) AS auc, round(ap, 6) AS ap, round(ap / pos_rate, 5) AS lift, round(brier, 6) AS brier FROM m""")
def _(d: Domain):
    docs = d.table("documents").select("doc_id", "lang", (F.lit(1.0) - F.lit(1000.0) / (F.col("n_chars") + 1000.0)).alias("s"))
    both = docs.join(d.table("labels").select("doc_id", "quality"), "doc_id")
    return rounded(E.scores(both, ["lang"], "quality", "s"), lift=5)


@query("m06_state_metrics", f"""
    WITH src AS (SELECT state_fips, y_prob2 AS s, y_true AS y FROM d_scored), {_auc_sql('src', 'state_fips')}
    SELECT state_fips, n, round(pos_rate, 6) AS pos_rate, round(auc, 6) AS auc, CASE WHEN n >= 100 THEN round(ap, 6) END AS ap, round(brier, 6) AS brier,
      CAST(auc < 0.5 AS INTEGER) AS below_random FROM m WHERE auc IS NOT NULL""")
def _(d: Domain):
    return rounded(E.area_scores(d.scored(), ["state_fips"], score="y_prob2"))


@query("m06_pooled_metrics", f"""
    WITH src AS (SELECT y_prob AS s, y_true AS y FROM d_scored), {_auc_sql('src', '')}
    SELECT n, n_pos, round(auc, 6) AS auc, round(ap, 6) AS ap, round(brier, 6) AS brier FROM m""")
def _(d: Domain):
    return rounded(E.scores(d.scored(), []).select("n", "n_pos", "auc", "ap", "brier"))


@query("m07_calibration", """
    SELECT fold, CAST(least(floor(y_prob * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(y_prob), 6) AS mean_predicted, round(avg(y_true), 6) AS mean_observed,
      least(floor(y_prob * 10), 9) / 10.0::DOUBLE AS bin_low, (least(floor(y_prob * 10), 9) + 1) / 10.0::DOUBLE AS bin_high FROM d_scored GROUP BY ALL""")
def _(d: Domain):
    return rounded(E.calibration(d.scored(), ["fold"]))


@query("m08_precision_at", """
    WITH r AS (SELECT y_true, row_number() OVER (ORDER BY y_prob DESC, tract_fips, year) AS rn, count(*) OVER () AS n FROM d_scored)
    SELECT CAST(t.k AS BIGINT) AS top_n, CAST(sum(y_true) AS BIGINT) AS n_true_positives, round(sum(y_true) / t.k, 6) AS precision
    FROM r, (VALUES (100), (500), (1000), (5000)) t(k) WHERE rn <= t.k AND n >= t.k GROUP BY t.k""")
def _(d: Domain):
    return rounded(E.precision_at(d.scored(), ["tract_fips", "year"]))


@query("m09_decision_curve", """
    WITH t AS (SELECT i / 100.0::DOUBLE AS threshold FROM range(1, 50) r(i)),
    c AS (SELECT fold, threshold, count(*) AS n, sum(y_true) AS p, count(*) FILTER (y_prob >= threshold) AS n_treated,
            CAST(coalesce(sum(y_true) FILTER (y_prob >= threshold), 0) AS BIGINT) AS n_caught FROM d_scored, t GROUP BY ALL)
    SELECT fold, threshold, n_treated, n_caught, round((n_caught - (n_treated - n_caught) * threshold / (1 - threshold)) / n, 6) + 0.0 AS nb_model,
      round((p - (n - p) * threshold / (1 - threshold)) / n, 6) + 0.0 AS nb_treat_all FROM c""")
def _(d: Domain):
    out = E.decision_curve(d.scored(), ["fold"])
    return rounded(out.select("fold", "threshold", "n_treated", "n_caught", "nb_model", "nb_treat_all"))


SUMMARY = f"""src AS (SELECT fold, state_fips, y_prob2 AS s, y_true AS y FROM d_scored), {_auc_sql('src', 'state_fips, fold')}"""


@query("a29_fold_summary", f"""
    WITH {SUMMARY} SELECT state_fips, count(auc) AS n_folds, round(avg(auc), 6) AS mean, round(stddev_samp(auc), 6) AS std, round(min(auc), 6) AS min,
      round(max(auc), 6) AS max, min_by(fold, auc) AS worst_fold, CAST(stddev_samp(auc) > 0.06 AS INTEGER) AS unstable FROM m WHERE auc IS NOT NULL GROUP BY 1""")
def _(d: Domain):
    return rounded(E.fold_summary(E.scores(d.scored(), ["state_fips", "fold"], score="y_prob2"), ["state_fips"]))


@query("m24_headline_metrics", f"""
    WITH {SUMMARY} SELECT state_fips, round(avg(auc), 6) AS mean_auc, round(stddev_pop(auc), 6) AS std_auc, round(avg(ap), 6) AS mean_ap, round(stddev_pop(ap), 6) AS std_ap,
      count(*) AS n_folds FROM m WHERE auc IS NOT NULL GROUP BY 1""")
def _(d: Domain):
    return rounded(E.headline(E.scores(d.scored(), ["state_fips", "fold"], score="y_prob2"), ["state_fips"]))


@query("p20_signal_verdict", f"""
    WITH {SUMMARY} SELECT state_fips, CASE WHEN avg(ap) >= 0.10 THEN 'strong' WHEN avg(ap) >= 0.05 THEN 'moderate' ELSE 'weak' END AS verdict,
      CAST(count(*) FILTER (ap >= 0.10) >= 3 AS INTEGER) AS holds_in_most_folds FROM m GROUP BY 1""")
def _(d: Domain):
    per = E.scores(d.scored(), ["state_fips", "fold"], score="y_prob2")
    return per.groupBy("state_fips").agg(signal_verdict(F.avg("ap")).alias("verdict"),
                                         (F.count_if(F.col("ap") >= 0.10) >= 3).cast("int").alias("holds_in_most_folds"))


@query("m17_overlay_sweep", f"""
    WITH o AS (SELECT y_true AS y, alpha, least(greatest(y_prob * (1 + alpha * (y_prob2 - avg(y_prob2) OVER (PARTITION BY year, is_rural))), 0), 1) AS s
      FROM d_scored, (VALUES (0.0::DOUBLE), (0.10), (0.25), (0.50)) a(alpha)),
    src AS (SELECT alpha, y, round(s, 9) AS s FROM o), {_auc_sql('src', 'alpha')}
    SELECT alpha, round(auc, 6) AS auc, round(ap, 6) AS ap, round(brier, 6) AS brier,
      CAST(alpha = (SELECT max_by(alpha, ap) FROM m WHERE alpha > 0) AS INTEGER) AS is_best FROM m""")
def _(d: Domain):
    overlaid = E.peer_deviation_overlay(stored(d.scored(), "scored"), ["year", "is_rural"], "y_prob", "y_prob2")
    # scores are cut to nine digits: means differ in the last bits between engines and would break ties differently
    return rounded(E.overlay_sweep(stored(overlaid.withColumn("final", F.round("final", 9)), "overlay")))


@query("o06_elbow_pick", f"""
    WITH src AS (SELECT k, fold, y_true AS y, y_prob * k / 10.0::DOUBLE + y_prob2 * (10 - k) / 10.0::DOUBLE AS s FROM d_scored, (VALUES (1), (2), (4), (6), (8), (10)) g(k)),
    {_auc_sql('src', 'k, fold')}, a AS (SELECT k, avg(ap) AS ap FROM m GROUP BY 1)
    SELECT CAST(min(k) AS INTEGER) AS k, round((SELECT ap FROM a WHERE k = 10), 6) AS full_metric FROM a WHERE ap >= 0.95 * (SELECT ap FROM a WHERE k = 10)""")
def _(d: Domain):
    k = F.col("k")
    grid = d.scored().withColumn("k", F.explode(F.array(*[F.lit(i) for i in (1, 2, 4, 6, 8, 10)])))
    mixed = grid.withColumn("mix", F.col("y_prob") * k / 10.0 + F.col("y_prob2") * (10 - k) / 10.0)
    return rounded(E.elbow(stored(E.scores(mixed, ["k", "fold"], score="mix"), "sweep")))


@query("m10_ablation_deltas", f"""
    WITH src AS (SELECT g, fold, y_true AS y, CASE g WHEN 'baseline' THEN y_prob WHEN 'no_lenders' THEN y_prob2 ELSE y_prob * 0.5::DOUBLE + 0.25::DOUBLE END AS s
      FROM d_scored, (VALUES ('baseline'), ('no_lenders'), ('no_scale')) x(g)), {_auc_sql('src', 'g, fold')},
    a AS (SELECT g, avg(auc) AS auc, avg(ap) AS ap FROM m GROUP BY 1)
    SELECT a.g AS lever_group, round(a.auc - b.auc, 6) + 0.0 AS delta_auc, round(a.ap - b.ap, 6) + 0.0 AS delta_ap FROM a, a b WHERE b.g = 'baseline' AND a.g <> 'baseline'""")
def _(d: Domain):
    from ..operators.learning import ablation_deltas

    p, q = F.col("y_prob"), F.col("y_prob2")
    entries = F.array(*[F.struct(F.lit(g).alias("g"), e.alias("s")) for g, e in
                        {"baseline": p, "no_lenders": q, "no_scale": p * 0.5 + 0.25}.items()])
    long = d.scored().select("fold", "y_true", F.explode(entries).alias("e")).select("fold", "y_true", "e.*")
    per = stored(E.scores(long, ["g", "fold"], score="s"), "ablation")
    return rounded(ablation_deltas(per, "g", "baseline").withColumnRenamed("g", "lever_group").select("lever_group", "delta_auc", "delta_ap"))


@query("o08_seeded_sample")
def _(d: Domain):
    return serving.seeded_sample(d.panel().select("tract_fips", "year", "n_lenders"), ["tract_fips", "year"], 5000)
