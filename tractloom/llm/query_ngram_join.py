from .common import table
from .ngram_join import near_duplicates
from .registry import query


@query("op3_ngram_join")
def op3_ngram_join(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return found.select("row.doc_id", "class_id", "n_links", "class_size", "kept")
