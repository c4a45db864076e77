"""A corpus pipeline over `documents`: toxicity filter, exact dedup, near dedup, source mixing, packing.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of its documents.
"""

from functools import wraps

from pyspark.sql import functions as F

from tractloom.llm.exact_dedup import exact_duplicates
from tractloom.llm.mixing import mix
from tractloom.llm.ngram_join import near_duplicates
from tractloom.llm.query_mixing import WEIGHTS
from tractloom.llm.query_packing import pieces
from tractloom.llm.query_toxicity import model
from tractloom.llm.toxicity import toxicity
from tractloom.session import Scratch, discard, fresh_path, reads_from, recording, remove

#: What the stage before wrote for itself, until its output has been read again.
_LEFT: list[Scratch] = []


def release(spark, docs=None):
    """Remove what earlier stages wrote for themselves, unless `docs` still reads it."""
    for left in list(_LEFT):
        if docs is None or not reads_from(docs, left):
            discard(spark, left)
            _LEFT.remove(left)


def staged(function):
    """A stage that first removes the files its predecessor no longer needs, so that their disk is not held to the end."""

    @wraps(function)
    def run(spark, docs, sf_dir):
        release(spark, docs)
        with recording() as mine:
            found = function(spark, docs, sf_dir)
        _LEFT.append(mine)
        return found

    return run


@staged
def drop_toxic(spark, docs, sf_dir):
    """Documents that the classifier does not reject."""
    return toxicity(docs, model(spark, sf_dir)).filter("predicted = 0").select("row.*")


@staged
def drop_copies(spark, docs, sf_dir):
    """Of equal texts the row with the largest id."""
    return exact_duplicates(docs).filter("kept").select("row.*")


@staged
def drop_near_copies(spark, docs, sf_dir):
    """One document of each group of near-duplicates."""
    return near_duplicates(docs).filter("kept").select("row.*")


@staged
def mix_sources(spark, docs, sf_dir):
    """Documents as often as the mix takes them."""
    taken = mix(docs, WEIGHTS).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).select("row.*")


@staged
def pack_sequences(spark, docs, sf_dir):
    """Pieces of documents in sequences of at most 2048 tokens."""
    return pieces(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL expresses neither the classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages in turn, each written to the shared folder and read again; a stage's input goes once its output is written."""
    docs, given = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet"), None
    for name, stage in STAGES:
        output = fresh_path(spark, f"pipeline-{name}")
        found = stage(spark, docs, sf_dir)
        found.write.mode("errorifexists").parquet(output)
        docs = spark.read.schema(found.schema).parquet(output)
        if given:
            remove(spark, given)
        given = output
    release(spark, docs)
    return docs
