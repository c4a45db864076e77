from pyspark.sql import functions as F

from .common import in_fold, table
from .registry import query
from .secrets import NAMES, scan_secrets

#: A credential name and its sign of assignment, in any case, quoting and spacing; or the name alone as a word of its own.
BESIDE = rf"(?i)(?:(?:{NAMES})[a-z0-9_.\-]*[\"'`\])]*\s*(?::=|=>|=|:)|(?:^|[^a-z0-9])(?:{NAMES}|password|credential)s?)\s*(?:(?:bearer|basic)\s+)?[\"'`]?$"
#: An unquoted assignment is one run of key characters.
INSIDE = rf"(?i)^[a-z0-9_\-]*(?:{NAMES})[a-z0-9_\-]*=+(?=[^=])"
PREFIXES = r"^(?:(?:AKIA|ASIA)[A-Z0-9]{16}$|gh[pousr]_[A-Za-z0-9]{16}|github_pat_|glpat-|xox[abprs]-|sk_live_|AIza[A-Za-z0-9_\-]{30}|npm_[A-Za-z0-9]{20}|eyJ[A-Za-z0-9_\-]{12})"
#: Words, numbers and rules of a few signs.
PLAIN = r"^(?:[A-Z]?[a-z]+(?:[\-_/+=]+[A-Z]?[a-z]+)*[\-_/+=]*|[\-_/+=]*[0-9]+(?:[\-_/+=]+[0-9]+)*[\-_/+=]*)$"


def review():
    """Stands in for a reviewer, as the tables hold no labelled findings: 1, 0, or null where the rule does not know.

    Real is a mixed value beside a credential name, or one with a known prefix. False are words, numbers and repeated signs
    that no credential name stands beside.
    """
    named = F.concat_ws(" ", "before2", "before", "left").rlike(BESIDE) | F.col("candidate").rlike(INSIDE)
    value = F.regexp_replace("candidate", INSIDE, "")
    kinds = F.size(F.array_distinct(F.split(value, "")))
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.length(value) >= 12) & (kinds >= 8)
    return F.when(value.rlike(PREFIXES) | named & mixed, 1).when(~named & (F.col("candidate").rlike(PLAIN) | (kinds <= 3)), 0)


@query("op1_secret_scan")
def op1_secret_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    label = F.when(~in_fold(F.col("row.doc_id"), 5, 0), review())
    found = scan_secrets(docs, label, path_column="source", carry=["doc_id"])
    return found.select("row.doc_id", "word_at", "run_at", "candidate", "score", "is_secret")
