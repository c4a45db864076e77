"""Organisation-name normalisation and similarity, expressed with array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .guards import col, let

# Tokens that carry no identity in bank names.
DROP_TOKENS = [
    "national", "association", "the", "a", "of", "and", "&",
    "co", "company", "corp", "corporation", "inc", "incorporated",
    "fsb", "ssb", "n.a.", "na", "n.a", "nat'l", "natl",
    "trust", "tr", "tc",
    "bank", "banking", "bk",
    "savings", "savg", "sav",
    "federal", "fed", "fdl",
]


def normalize_name(raw: Column | str) -> Column:
    """Lower-case name with punctuation blanked and generic tokens removed."""
    spaced = F.regexp_replace(F.lower(F.coalesce(col(raw), F.lit(""))), r"[^\p{L}\p{N}_\s]", " ")
    tokens = F.split(F.trim(spaced), r"\s+")
    kept = F.filter(tokens, lambda t: (t != "") & ~t.isin(DROP_TOKENS))
    return F.array_join(kept, " ")


def token_set(name: Column | str) -> Column:
    """Sorted distinct tokens of a normalised name."""
    return F.sort_array(F.array_distinct(F.array_remove(F.split(col(name), " "), "")))


def similarity(a: Column, b: Column) -> Column:
    """Levenshtein similarity in 0..100; two empty strings count as different."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, 100.0 * (F.lit(1.0) - F.levenshtein(a, b) / longest)).otherwise(F.lit(0.0))


def token_set_score(tokens_a: Column | str, tokens_b: Column | str) -> Column:
    """Order-insensitive similarity of two token sets.

    With the shared tokens S, compare the strings S, S+restA and S+restB pairwise and keep the best. The shared
    part alone only takes part when it is not empty.
    """
    def parts(t: Column) -> Column:
        shared = F.array_join(F.sort_array(F.array_intersect(t["a"], t["b"])), " ")
        only_a = F.array_join(F.sort_array(F.array_except(t["a"], t["b"])), " ")
        only_b = F.array_join(F.sort_array(F.array_except(t["b"], t["a"])), " ")
        return F.struct(shared.alias("s"), only_a.alias("a"), only_b.alias("b"))

    def strings(p: Column) -> Column:
        return F.struct(
            p["s"].alias("s"),
            F.trim(F.concat_ws(" ", p["s"], p["a"])).alias("a"),
            F.trim(F.concat_ws(" ", p["s"], p["b"])).alias("b"),
        )

    def best(x: Column) -> Column:
        both = similarity(x["a"], x["b"])
        contained = F.greatest(both, similarity(x["s"], x["a"]), similarity(x["s"], x["b"]))
        return F.when(x["s"] != "", contained).otherwise(both)

    sets = F.struct(col(tokens_a).alias("a"), col(tokens_b).alias("b"))
    return let(let(let(sets, parts), strings), best)
