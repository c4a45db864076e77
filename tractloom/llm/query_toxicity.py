from pyspark.sql import functions as F

from .common import in_fold, table
from .registry import query
from .toxicity import toxicity, train


def model(spark, sf_dir):
    """Learned from the labels outside the held-out fold."""
    return train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~in_fold(F.col("doc_id"), 5, 0))


@query("op5_toxicity")
def op5_toxicity(spark, sf_dir):
    found = toxicity(table(spark, sf_dir, "documents"), model(spark, sf_dir), carry=["doc_id"])
    return found.select("row.doc_id", in_fold(F.col("row.doc_id"), 5, 0).alias("held_out"), "score", "predicted")
