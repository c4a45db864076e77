"""Multi-pass matching of organisation names.

Every distinct (block, name) is scored once, however many rows carry it. Fuzzy candidates come from two exact
filters instead of pairing a block with itself:

* token filter - if the score rests on one side's tokens being contained in the other (the shared tokens alone
  against one full name), the tokens left out are short; so at least one of that side's rarest tokens, taken until
  their length exceeds what may be left out, is shared;
* edit filter - a name at most ``e`` edits away differs in at most ``2e`` padded bigrams, so the ``2e + 1`` rarest
  bigrams of both names have one in common.

Both keep every pair that can reach the threshold, and both look rare keys up first, so frequent tokens create
little work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import token_set, token_set_score
from ..session import stored

#: Names that share a lookup key in one part of the candidate join.
HOT_KEY = 1024


def _with_bigrams(df: DataFrame, tokens: str) -> DataFrame:
    """Add ``grams``: padded bigrams of all tokens; repeats are numbered so that the array behaves as a multiset."""
    padded = F.transform(tokens, lambda t: F.concat(F.lit("^"), t, F.lit("$")))
    per_token = F.transform(
        "__padded",
        lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substr(t, i, F.lit(2))),
    )
    numbered = F.transform(
        "__flat",
        lambda g, i: F.concat(
            g, F.lit("#"), F.size(F.filter(F.slice("__flat", F.lit(1), i + 1), lambda h: h == g)).cast("string")
        ),
    )
    flat = df.withColumn("__padded", padded).withColumn("__flat", F.flatten(per_token))
    return flat.withColumn("grams", numbered).drop("__padded", "__flat")


def _described(names: DataFrame, block: list[str], name: str) -> DataFrame:
    """Distinct names with their length and search keys: tokens (``t``) and padded bigrams (``g``)."""
    tokens = _with_bigrams(
        names.select(*block, name).where(F.col(name) != "").distinct().withColumn("tokens", token_set(name)), "tokens"
    )
    keys = F.concat(
        F.transform("tokens", lambda t: F.struct(F.lit("t").alias("kind"), t.alias("key"))),
        F.transform("grams", lambda g: F.struct(F.lit("g").alias("kind"), g.alias("key"))),
    )
    return tokens.select(*block, name, F.length(F.array_join("tokens", " ")).alias("length"), keys.alias("keys"))


def _by_rarity(side: DataFrame, counts: DataFrame, block: list[str], name: str) -> DataFrame:
    """Each name's keys, rarest first (a global order: frequency in the block, then the key itself)."""
    exploded = side.select(*block, name, "length", F.explode("keys").alias("k")).select(*block, name, "length", "k.*")
    return (
        exploded.join(counts, [*block, "kind", "key"])
        .groupBy(*block, name)
        .agg(
            F.first("length").alias("length"),
            F.array_sort(F.collect_list(F.struct("freq", "kind", "key"))).alias("ranked"),
        )
    )


def _probes(side: DataFrame, block: list[str], name: str, similarity: float, rare_role: str, full_role: str) -> DataFrame:
    """Lookup rows (role, key) of each name: rare tokens, all tokens, and rare bigrams."""
    tokens = F.filter("ranked", lambda r: r["kind"] == "t")
    grams = F.filter("ranked", lambda r: r["kind"] == "g")
    sized = side.withColumns({"t": tokens, "g": grams})
    may_miss = (1.0 - similarity) * F.col("length") + 1e-9
    rare = F.filter("t", lambda k, i: F.aggregate(F.slice("t", F.lit(1), i), F.lit(0), lambda acc, q: acc + F.length(q["key"])) <= may_miss)
    edits = F.floor((1.0 - similarity) / similarity * F.col("length") + 1e-9)

    def tagged(keys: Column, role: str) -> Column:
        return F.transform(keys, lambda k: F.struct(F.lit(role).alias("role"), k["key"].alias("key"), k["freq"].alias("freq")))

    probes = F.concat(
        tagged(rare, rare_role), tagged(F.col("t"), full_role),
        tagged(F.slice("g", F.lit(1), (edits * 2 + 1).cast("int")), "bigram"),
    )
    return sized.select(*block, name, "length", F.explode(probes).alias("p")).select(*block, name, "length", "p.role", "p.key", "p.freq")


def candidate_pairs(
    left: DataFrame, right: DataFrame, block: list[str], name: str, threshold: float
) -> DataFrame:
    """All distinct name pairs of a block whose token-set score can reach ``threshold`` (0..100).

    One equi-join on (block, role, key): the left's rare tokens meet all tokens of the right, the right's rare tokens
    meet all tokens of the left, and rare bigrams meet rare bigrams.
    """
    s = threshold / 100.0
    # stored once: the key counts and the lookups both read the described names
    a, b = stored(_described(left, block, name), "names"), stored(_described(right, block, name), "names")
    both = a.select(*block, F.explode("keys").alias("k")).unionAll(b.select(*block, F.explode("keys").alias("k")))
    counts = both.groupBy(*block, F.col("k.kind").alias("kind"), F.col("k.key").alias("key")).agg(
        F.count(F.lit(1)).alias("freq")
    )
    x = _probes(_by_rarity(a, counts, block, name), block, name, s, "left_rare", "right_rare")
    y = _probes(_by_rarity(b, counts, block, name), block, name, s, "right_rare", "left_rare")
    # The join makes many rows out of few: spread it by key over all shuffle partitions, because sizing its tasks by
    # the bytes that go in would leave everything to one of them. A key of many names is cut into salted parts: each name
    # of one side goes to one of them, the other side's names to all.
    keys = [*block, "role", "key", "salt"]
    parts = F.ceil(F.col("freq") / HOT_KEY)
    x = x.withColumn("salt", F.pmod(F.xxhash64(name), parts)).drop("freq")
    y = y.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("freq")
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x, y = x.repartition(tasks, *keys), y.repartition(tasks, *keys)
    met = x.join(y.withColumnsRenamed({name: "other", "length": "other_length"}), keys)
    # whole names that are alike have about the same length
    alike = F.least("length", "other_length") >= F.greatest("length", "other_length") * s - 1e-9
    return met.where((F.col("role") != "bigram") | alike).select(*block, name, "other").distinct()


def scored_pairs(left: DataFrame, right: DataFrame, block: list[str], name: str, threshold: float) -> DataFrame:
    """Distinct name pairs (name, other) of a block scoring at least ``threshold``."""
    score = token_set_score(token_set(name), token_set("other"))
    # the filter sits inside the generator so that the score is computed once per pair
    reached = F.filter(F.array(score), lambda s: s >= threshold - 1e-9)
    return candidate_pairs(left, right, block, name, threshold).select(
        *block, name, "other", F.explode(reached).alias("score")
    )


def fuzzy_best(
    left: DataFrame, right: DataFrame, block: list[str], name: str, right_id: str, threshold: float
) -> DataFrame:
    """Best right entity per distinct (block, name) at or above ``threshold``; the smallest id wins a tie."""
    scored = scored_pairs(left, right, block, name, threshold)
    ids = right.where(F.col(name) != "").groupBy(*block, F.col(name).alias("other")).agg(F.min(right_id).alias(right_id))
    best = F.max_by(F.struct(right_id, "score"), F.struct(F.col("score"), -F.col(right_id)))
    return (
        scored.join(ids, [*block, "other"])
        .groupBy(*block, name)
        .agg(best.alias("__b"))
        .select(*block, name, F.col(f"__b.{right_id}").alias(right_id), F.col("__b.score").alias("score"))
    )


def match_entities(
    left: DataFrame, right: DataFrame, left_id: str, right_id: str, name: str = "name_norm", state: str = "state",
    city: str = "city", state_threshold: float = 90.0, city_threshold: float = 85.0, review_threshold: float = 75.0,
) -> DataFrame:
    """Three passes: exact name in the state, fuzzy name in the state, fuzzy name in the same city.

    Each pass only sees what the passes before left unmatched. City matches between the review and the city
    threshold come out with ``match_method = 'review'``.
    """
    pick = right.where(F.col(name) != "")
    exact_ids = right.groupBy(state, name).agg(F.min(right_id).alias(right_id))
    exact = left.join(exact_ids, [state, name]).select(
        left_id, right_id, F.lit("exact").alias("match_method"), F.lit(100.0).alias("score"),
        F.lit(1.0).alias("confidence"),
    )
    rest = left.join(exact_ids, [state, name], "left_anti")

    # stored once: the matches and the rest of the search both use it
    by_state = stored(fuzzy_best(rest, pick, [state], name, right_id, state_threshold), "matches")
    second = rest.join(by_state, [state, name]).select(
        left_id, right_id, F.lit("fuzzy_state").alias("match_method"), "score", F.lit(0.90).alias("confidence")
    )
    rest = rest.join(by_state, [state, name], "left_anti").where(F.col(city) != "")

    by_city = fuzzy_best(rest, pick, [state, city], name, right_id, review_threshold)
    sure = F.col("score") >= city_threshold
    third = rest.join(by_city, [state, city, name]).select(
        left_id, right_id, F.when(sure, "city_fuzzy").otherwise("review").alias("match_method"), "score",
        F.when(sure, 0.85).otherwise(0.60).alias("confidence"),
    )
    return exact.unionByName(second).unionByName(third)


def best_match(matches: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """Most confident match per left entity (then best score, then smallest id)."""
    order = F.struct(F.col("confidence"), F.col("score"), -F.col(right_id))
    return matches.groupBy(left_id).agg(
        F.max_by(right_id, order).alias(right_id), F.max("confidence").alias("confidence")
    )


def volume_match_rate(volumes: DataFrame, matches: DataFrame, key: str, amount: str) -> DataFrame:
    """Share of the total amount that belongs to matched entities."""
    hit = matches.select(key).distinct().withColumn("__hit", F.lit(1))
    joined = volumes.groupBy(key).agg(F.sum(amount).alias(amount)).join(hit, key, "left")
    return joined.agg(
        F.sum(amount).alias("total_amount"),
        F.coalesce(F.sum(F.when(F.col("__hit") == 1, F.col(amount))), F.lit(0.0)).alias("matched_amount"),
    ).withColumn("match_rate", F.when(F.col("total_amount") > 0, F.col("matched_amount") / F.col("total_amount")))
