from pyspark.sql import functions as F

from .brown import class_ngram_scores
from .common import in_fold, table
from .registry import query


@query("op4_brown_lm")
def op4_brown_lm(spark, sf_dir):
    scored, totals = class_ngram_scores(table(spark, sf_dir, "documents"), ~in_fold(F.col("doc_id"), 7, 2), carry=["doc_id"])
    return scored.select(
        "row.doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(totals["tokens"]).cast("long").alias("train_tokens"), "base_score", "score"
    )
