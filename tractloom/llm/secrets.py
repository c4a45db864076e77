"""Secret scan: long runs of key characters, and a random forest that removes the false positives among them.

All steps are DataFrame operations. Features of a finding: length, mix of character kinds, how often the kind changes, the
log ratio of its character transitions among true and false labelled findings, the share of its letter runs that the
corpus uses as words, its path, and the words beside it. The forest is learned from labelled findings.
"""

from __future__ import annotations

import string

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import packed, quoted

RUN = r"[A-Za-z0-9+/_=\-]{16,}"
BLANK = r"[\x20\x09-\x0D]+"
#: Names that announce a credential, and path parts that announce test data.
NAMES = "key|token|secret|passw|pwd|auth|cred|api"
TESTS = "test|mock|fixture|example|sample|demo|doc"
BUCKETS = 24
#: Characters kept on each side of a run.
NEAR = 64


def findings(docs: DataFrame, text_column: str = "text", path_column: str | None = None, carry: list[str] | None = None) -> DataFrame:
    """All candidate runs: row, path, word_at (from 0), run_at (from 0 in its word), candidate, left, right, before2, before, after.

    left and right are what the word holds beside the run, before2, before and after the words beside it, each at most NEAR
    characters next to the run: a finding has a bounded size however long its word is.
    """
    path = F.coalesce(quoted(path_column).cast("string"), F.lit("")) if path_column else F.lit("")
    said = docs.select(packed(docs, carry).alias("row"), path.alias("path"), quoted(text_column).alias("text")).filter(F.col("text").rlike(RUN))
    cut = said.select("row", "path", F.split("text", BLANK).alias("w"))
    at = lambda i: F.coalesce(F.get(F.col("w"), i), F.lit(""))
    near = lambda c: F.right(c, F.lit(NEAR))
    places = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.get(F.col("w"), i).rlike(RUN))
    # A word as gap, run, gap, ..., run, gap; NUL cuts it, so one in the text is shown as another sign.
    pieces = lambda word: F.split(F.regexp_replace(F.translate(word, "\x00", "\ufffd"), RUN, "\x00$0\x00"), "\x00")
    found = F.transform(places, lambda i: F.struct(
        i.alias("word_at"), pieces(at(i)).alias("p"), near(at(i - 2)).alias("before2"), near(at(i - 1)).alias("before"), F.left(at(i + 1), F.lit(NEAR)).alias("after")))
    each = cut.select("row", "path", F.explode(found).alias("f")).select("row", "path", "f.*")
    piece = lambda i: F.coalesce(F.get(F.col("p"), i), F.lit(""))
    runs = F.transform(F.sequence(F.lit(1), F.size("p") - 2, F.lit(2)), lambda i: F.struct(
        piece(i).alias("candidate"), near(F.concat(near(F.when(i > 1, piece(i - 2)).otherwise("")), piece(i - 1))).alias("left"),
        F.left(F.concat(piece(i + 1), F.left(piece(i + 2), F.lit(NEAR))), F.lit(NEAR)).alias("right")))
    return each.select("row", "path", "word_at", "before2", "before", "after", F.posexplode(runs).alias("run_at", "r")).select(
        "row", "path", "word_at", "run_at", "r.candidate", "r.left", "r.right", "before2", "before", "after")


def dictionary(docs: DataFrame, text_column: str = "text", least: int = 3) -> DataFrame:
    """Lower-case letter runs of three letters or more that the corpus holds at least `least` times as whole words."""
    word = F.explode(F.split(F.lower(quoted(text_column)), BLANK)).alias("w")
    plain = docs.select(word).select(F.regexp_replace("w", r"^\p{P}+|\p{P}+$", "").alias("run"))
    return plain.filter(F.col("run").rlike(r"^\p{L}{3,}$")).groupBy("run").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("run")


def _kinds(c: Column) -> Column:
    return F.translate(c, string.ascii_lowercase + string.ascii_uppercase + string.digits, "a" * 26 + "A" * 26 + "0" * 10)


def _pairs(found: DataFrame) -> DataFrame:
    spots = F.filter(F.sequence(F.lit(1), F.length("candidate") - 1), lambda i: i > 0)
    return found.select("n", F.explode(F.transform(spots, lambda i: F.substring(F.col("candidate"), i, F.lit(2)))).alias("pair"))


def featured(found: DataFrame, words: DataFrame, ratios: DataFrame) -> tuple[DataFrame, list[str]]:
    """Findings (with unique n) and their feature columns."""
    size = F.length("candidate").cast("double")
    kinds, low = _kinds(F.col("candidate")), F.lower("candidate")
    runs = found.select("n", F.explode(F.filter(F.split(low, "[^a-z]+"), lambda x: F.length(x) >= 3)).alias("run"))
    covered = runs.join(words, "run").groupBy("n").agg(F.sum(F.length("run")).alias("covered"))
    steps = _pairs(found).join(ratios, "pair", "left").groupBy("n").agg(F.avg(F.coalesce("ratio", F.lit(0.0))).alias("f_transition"))
    name = F.lower(F.concat_ws(" ", "before2", "before", F.concat("left", "candidate", "right")))
    columns = {
        "f_length": size,
        "f_digits": F.length(F.regexp_replace(kinds, "[^0]", "")) / size,
        "f_upper": F.length(F.regexp_replace(kinds, "[^A]", "")) / size,
        "f_other": F.length(F.regexp_replace(kinds, "[a-zA-Z0]", "")) / size,
        "f_changes": (F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) - 1) / size,
        "f_distinct": F.size(F.array_distinct(F.split("candidate", ""))) / size,
        "f_covered": F.coalesce(F.col("covered") / size, F.lit(0.0)),
        "f_path_depth": F.size(F.split("path", "/")).cast("double"),
        "f_path_test": F.lower("path").rlike(TESTS).cast("double"),
        "f_named": name.rlike(NAMES).cast("double"),
        "f_assigned": F.concat("before", F.lit(" "), "left").rlike("[=:]").cast("double"),
        "f_quoted": F.concat("left", "right").rlike("[\"'`]").cast("double"),
        "f_last": (F.col("after") == "").cast("double"),
    }
    for side in ("before2", "before", "after"):
        for b in range(BUCKETS // 3):
            columns[f"f_{side}_{b}"] = (F.pmod(F.xxhash64(F.lower(side)), F.lit(BUCKETS // 3)) == b).cast("double")
    wide = found.join(covered, "n", "left").join(steps, "n", "left").withColumn("f_transition", F.coalesce("f_transition", F.lit(0.0)))
    return wide.select(*found.columns, "f_transition", *[c.alias(k) for k, c in columns.items()]), ["f_transition", *columns]


def transition_ratios(labelled: DataFrame) -> DataFrame:
    """(pair, ratio): smoothed log ratio of a character pair's share among true and false findings. At most 66**2 rows."""
    counts = _pairs(labelled).join(labelled.select("n", "label"), "n").groupBy("pair").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("f"))
    sums = counts.agg(F.sum("t"), F.sum("f")).first()
    t, f = (float(x or 0) + 66**2 for x in sums)
    return counts.select("pair", (F.log((F.col("t") + 1) / t) - F.log((F.col("f") + 1) / f)).alias("ratio"))


def scan_secrets(
    docs: DataFrame, label: Column, text_column: str = "text", path_column: str | None = None, carry: list[str] | None = None,
    max_train_rows: int = 20_000, trees: int = 30, depth: int = 8, seed: int = 17,
) -> DataFrame:
    """Every candidate run of the texts with the forest's verdict: row, word_at, run_at, candidate, score, is_secret.

    label: over the finding's columns (row, path, candidate, left, right, before2, before, after, ...): 1 true, 0 false, null not
    labelled. The forest learns from at most max_train_rows labelled findings, first by a hash; every finding is scored. Labels
    of one class only: the score is their smoothed share. Null and empty texts have no findings; a null path is empty;
    repeated rows are scanned each; very long words give findings of bounded size; an empty table gives no rows.
    """
    found = stored(findings(docs, text_column, path_column, carry).withColumn("label", label.cast("int")).withColumn("n", F.monotonically_increasing_id()), "secrets-found")
    words = stored(dictionary(docs, text_column), "secrets-words")
    known = stored(
        found.filter(F.col("label").isin(0, 1)).orderBy(F.xxhash64("path", "before", "left", "candidate", "right", "after", "word_at"), "candidate", "left", "right", "n").limit(max_train_rows).select("n", "candidate", "label"), "secrets-known"
    )
    ratios = stored(transition_ratios(known), "secrets-ratios")
    wide, names = featured(found, words, ratios)
    wide = stored(wide, "secrets-features")
    seen = dict(known.groupBy("label").agg(F.count("*")).collect())
    result = ("row", "word_at", "run_at", "candidate")
    if len(seen) < 2:
        share = (seen.get(1, 0) + 1) / (sum(seen.values()) + 2)
        return wide.select(*result, F.lit(share).alias("score"), F.lit(share >= 0.5).alias("is_secret"))
    assembled = VectorAssembler(inputCols=names, outputCol="features")
    fitted = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, labelCol="label", featuresCol="features").fit(
        assembled.transform(wide.join(known.select("n"), "n", "left_semi").orderBy("n"))
    )
    scored = fitted.transform(assembled.transform(wide)).withColumn("score", vector_to_array("probability")[1])
    return scored.select(*result, "score", (F.col("score") >= 0.5).alias("is_secret"))
