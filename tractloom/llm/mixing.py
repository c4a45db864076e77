"""Mixing sources to target weights by entropy balancing.

Among all document rates with the wanted token totals, the one closest in entropy to "each once" tilts each document
exponentially in its size: rate = min(cap, exp(lambda * size / mean size)), one lambda per source. The dual is convex and
splits by source; guarded Newton steps solve it for all sources at once, each step one aggregation over the distinct
(source, size) pairs. Rates become copies by carrying the rounding error from the largest size to the smallest.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .common import WORD, aligned, packed, quoted, with_found

TOLERANCE, MAX_STEPS = 1e-9, 100


def targets(sources: DataFrame, weights: list[float], total_share: float, cap: float) -> DataFrame:
    """Sources (source, source_size, docs) with k (rank by code point, null last), weight, target.

    Water filling: sources in the order of cap per weight; those below the common level stop at their cap.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_room = Window.orderBy("room", "k").rowsBetween(Window.unboundedPreceding, -1)
    given = (
        sources.withColumn("k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("k") - 1) % len(weights) + 1).cast("int")))
        .withColumn("room", cap * F.col("source_size") / F.col("weight"))
        .withColumn("total", total_share * F.sum("source_size").over(everything)).withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum(cap * F.col("source_size")).over(by_room), F.lit(0.0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(by_room), F.lit(0.0))))
        .withColumn("common", F.max(F.when(F.col("level") <= F.col("room"), F.col("level"))).over(everything))
    )
    # In the order of room, the first level that its room holds is the common one; the levels after it only fall.
    first = F.coalesce(F.col("common"), F.lit(float("inf")))
    return given.withColumn("target", F.least(cap * F.col("source_size"), first * F.col("weight")).cast("double")).select(
        "k", "source", "source_size", "docs", "target"
    )


def balance(cells: DataFrame, sources: DataFrame, cap: float) -> DataFrame:
    """The dual variable of each source: k, tilt (null: every document at the cap). cells: k, size, n."""
    x = F.col("size") * F.col("docs") / F.col("source_size")
    state = stored(
        sources.filter((F.col("source_size") > 0) & (F.col("target") < cap * F.col("source_size")))
        .select("k", "source_size", "docs", "target", F.lit(0.0).alias("tilt"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(False).alias("done")),
        "mixing-state",
    )
    for _ in range(MAX_STEPS):
        raised = F.exp(F.least(F.col("tilt") * x, F.lit(700.0)))
        mass = F.col("n") * F.col("size")
        sums = cells.join(state, "k").groupBy("k").agg(
            F.sum(mass * F.least(F.lit(float(cap)), raised)).alias("value"), F.sum(F.when(raised < cap, mass * x * raised).otherwise(0.0)).alias("slope")
        )
        over = F.col("value") - F.col("target")
        newton = F.when(F.col("slope") > 0, F.col("tilt") - over / F.col("slope"))
        low, high = F.when(over < 0, F.col("tilt")).otherwise(F.col("low")), F.when(over >= 0, F.col("tilt")).otherwise(F.col("high"))
        step = F.when(newton.isNotNull() & (low.isNull() | (newton > low)) & (high.isNull() | (newton < high)), newton)
        beyond = F.when(high.isNull(), 2 * F.greatest(low, F.lit(0.5))).when(low.isNull(), 2 * F.least(high, F.lit(-0.5))).otherwise((low + high) / 2)
        done = F.abs(over) <= TOLERANCE * F.greatest(F.col("target"), F.lit(1.0))
        state = stored(
            state.join(sums, "k").select(
                "k", "source_size", "docs", "target", F.when(done, F.col("tilt")).otherwise(F.coalesce(step, beyond)).alias("tilt"), low.alias("low"), high.alias("high"), done.alias("done")
            ),
            "mixing-state",
        )
        if not state.filter("not done").head(1):
            break
    return state.select("k", "tilt")


def _copies(cap: float):
    """Per source: how many of the n documents of each size get one copy more than the whole part of their rate."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size", ascending=False, ignore_index=True)
        carry, more = 0.0, []
        for size, n, rate in zip(rows["size"].tolist(), rows["n"].tolist(), rows["rate"].tolist(), strict=True):
            owed = carry + n * (rate - math.floor(rate)) * size
            extra = min(n, max(0, round(owed / size))) if size and math.floor(rate) < cap else 0
            carry = owed - extra * size
            more.append(extra)
        return pd.DataFrame({"k": rows["k"], "size": rows["size"], "whole": [math.floor(r) for r in rows["rate"]], "more": more, "all_n": rows["n"], "rate": rows["rate"]})

    return run


def mix(
    docs: DataFrame, weights: list[float], total_share: float = 1.5, cap: int = 2, source_column: str = "source",
    id_column: str = "doc_id", text_column: str = "text", carry: list[str] | None = None, rows_in_cell: int = 4096,
) -> DataFrame:
    """How often to take each document, so that sources reach their shares of `total_share` times all words.

    Weights repeat over the sources in code point order, null last. Returns one row per input row: `row` (struct of the
    carried columns), size (words), source_size, target (of its source), rate, copies (0 to cap). A null text has size 0. A
    document without words is taken once: it costs nothing. Which documents of one source and size get the extra copy is
    settled by a hash of the id, so reruns agree; rows alike in source, size and id are interchangeable. An empty table gives
    no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(quoted(text_column), F.lit(""))
    base, rows = aligned(
        docs.select(packed(docs, carry).alias("row"), quoted(id_column).alias("id"), quoted(source_column).alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size")),
        "mixing",
    )
    parts = min(4096, max(1, math.ceil(rows / rows_in_cell)))
    slim = base.select("id", "rid", "chunk", "source", "size", F.pmod(F.xxhash64("id", "size"), F.lit(parts)).alias("part"))
    sizes = stored(slim.groupBy("source", "size", "part").agg(F.count("*").alias("n")), "mixing-sizes")
    by_size = sizes.groupBy("source", "size").agg(F.sum("n").alias("n"))
    sources = stored(targets(by_size.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs")), weights, total_share, cap), "mixing-sources")
    named = F.col("c.source").eqNullSafe(F.col("s.source"))
    cells = stored(by_size.alias("c").join(sources.alias("s"), named).select("k", "size", "n"), "mixing-cells")
    tilts = balance(cells, sources, cap)
    x = F.col("size") * F.col("docs") / F.col("source_size")
    full = F.col("target") >= cap * F.col("source_size")
    rates = cells.join(sources.drop("source"), "k").join(tilts, "k", "left").select(
        "k", "size", "n",
        F.when(F.col("size") == 0, 1.0).when(full, float(cap)).otherwise(F.least(F.lit(float(cap)), F.exp(F.least(F.col("tilt") * x, F.lit(700.0))))).alias("rate"),
    )
    copies = stored(rates.groupBy("k").applyInPandas(_copies(cap), "k int, size long, whole int, more long, all_n long, rate double"), "mixing-copies")
    in_size = Window.partitionBy("k", "size").orderBy("part")
    upto = F.sum("n").over(in_size.rowsBetween(Window.unboundedPreceding, 0))
    share = lambda n: F.expr(f"cast(cast(more as decimal(19,0)) * {n} div all_n as long)")  # noqa: E731  exact: the shares of the parts add up
    dealt = (
        sizes.alias("c").join(sources.alias("s"), named).select("c.source", "k", "size", "part", "n", "source_size", "target")
        .join(copies, ["k", "size"]).withColumn("upto", upto)
        .withColumn("extra", share("upto") - share("(upto - n)"))
        .select("source", "size", "part", "source_size", "target", "rate", "whole", "extra")
    )
    in_cell = Window.partitionBy("d.source", "d.size", "d.part").orderBy(F.xxhash64("id"), "id", "rid")
    taken = (
        slim.alias("d").join(dealt.alias("e"), F.col("d.source").eqNullSafe(F.col("e.source")) & (F.col("d.size") == F.col("e.size")) & (F.col("d.part") == F.col("e.part")))
        .withColumn("place", F.row_number().over(in_cell))
        .select("chunk", "rid", "source_size", "target", "rate", (F.col("whole") + (F.col("place") <= F.col("extra")).cast("int")).cast("int").alias("copies"))
    )
    named = with_found(base.select("chunk", "rid", "row", "size"), stored(taken, "mixing-taken"), ["source_size", "target", "rate", "copies"])
    return named.select("row", "size", "found.source_size", "found.target", "found.rate", "found.copies")
