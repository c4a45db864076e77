from pyspark.sql import functions as F

from .common import table
from .packing import pack
from .registry import query


def pieces(docs):
    """Documents packed with the public word tokenizer, token ids as a checksum."""
    import public_tokenizers

    found = pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return found.select(
        F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query("op6_packing")
def op6_packing(spark, sf_dir):
    return pieces(table(spark, sf_dir, "documents"))
