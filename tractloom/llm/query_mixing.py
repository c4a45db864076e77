from pyspark.sql import functions as F

from .common import table
from .mixing import mix
from .registry import query

WEIGHTS = [3.0, 1.0, 2.0]


@query("op7_mixing")
def op7_mixing(spark, sf_dir):
    found = mix(table(spark, sf_dir, "documents"), WEIGHTS, carry=["doc_id"])
    return found.select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate")
