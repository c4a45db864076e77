from pyspark.sql import functions as F

from .common import table
from .registry import query
from .semicrf import KINDS, personal_data, train


def _joined(spans):
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _count(spans, kind):
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


@query("op10_semicrf_pii")
def op10_semicrf_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = personal_data(docs, train(docs), carry=["doc_id"])
    base = F.filter("found", lambda x: x["base"])
    counts = [_count(base, k).alias(f"n_{k}") for k in KINDS]
    return found.select("row.doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"), (F.size("found") - F.size(base)).cast("long").alias("n_added"))
