"""Sharding by jump consistent hashing: a stable key and the shard count decide the shard, without a ring table.

One shard more takes rows only into itself: a key either stays or moves to the new shard. Inside a shard, rows are numbered
from 0 in the order of a hash over key and text, so neighbours in a shard are unrelated and any layout of the input gives the
same numbers. Rows are counted per cell (shard, order hash, part of the input), cells are summed within ranges of the order
hash and the ranges within a shard: no shard, key or group of copies meets in one task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .common import aligned, joins_by_part_of_key, quoted, row_and_text, with_found

#: Bits of the hashes taken from md5: fifteen hexadecimal digits.
HASH_BITS = 60


def digest60(text: Column) -> Column:
    """The first 60 bits of the md5 of a string, as a long."""
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash (Lamping and Veach, 2014) of each 64-bit key."""
    state, shard, ahead = keys.astype(np.uint64, copy=True), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    live = np.arange(len(keys))
    while len(live):
        shard[live] = ahead[live]
        state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
        share = float(1 << 31) / ((state[live] >> np.uint64(33)).astype(np.float64) + 1.0)
        ahead[live] = ((shard[live] + 1) * share).astype(np.int64)
        live = live[ahead[live] < shards]
    return shard


def jump_column(key: Column, shards: int) -> Column:
    if shards < 1:
        raise ValueError("at least one shard is needed")

    @F.pandas_udf("int")
    def of(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64), shards).astype(np.int32))

    return of(key)


def _slots(rows: DataFrame, count: int) -> DataFrame:
    """(chunk, rid, slot) of rows (chunk, rid, shard, place): gapless numbers from 0 in each shard, by place, then part and rid."""
    bits = min(16, max(0, math.ceil(math.log2(max(1, count / 50_000)))))
    cut = rows.select("chunk", "rid", "shard", "place", F.shiftright("rid", 33).alias("part"))
    cell = ["shard", "place", "part"]
    band = F.shiftright("place", HASH_BITS - bits)
    cells = cut.groupBy(*cell).agg(F.count("*").alias("n")).withColumn("band", band)
    upto = Window.rowsBetween(Window.unboundedPreceding, -1)
    bands = cells.groupBy("shard", "band").agg(F.sum("n").alias("n"))
    starts = bands.select("shard", "band", F.coalesce(F.sum("n").over(upto.partitionBy("shard").orderBy("band")), F.lit(0)).alias("start"))
    inside = F.coalesce(F.sum("n").over(upto.partitionBy("shard", "band").orderBy("place", "part")), F.lit(0))
    first = cells.withColumn("inside", inside).join(starts, ["shard", "band"]).select(*cell, (F.col("start") + F.col("inside")).alias("first"))
    number = F.row_number().over(Window.partitionBy(*cell).orderBy("rid")) - 1
    return cut.withColumn("number", number).join(first, cell).select("chunk", "rid", (F.col("first") + F.col("number")).cast("long").alias("slot"))


def shard_rows(
    docs: DataFrame, shards: int, carry: list[str] | None = None, key_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """Every row with `shard` (0 to shards-1), `slot` and `grown_shard`, the shard if there were one more.

    Returns row (the columns in `carry`, all if None), size (UTF-8 bytes of the text plus 8), text_crc32, shard, slot,
    grown_shard. The key is hashed as its decimal or string form; a null key is hashed as the empty string and so lies in
    one shard with all null keys. A null text counts as empty. Rows with equal keys lie in one shard, whatever their texts;
    repeated rows get a slot each, in no set order among each other. Very long texts are only measured and hashed, never
    moved. An empty table gives no rows.
    """
    key, text = F.coalesce(quoted(key_column).cast("string"), F.lit("")), F.coalesce(quoted(text_column), F.lit(""))
    columns, _ = row_and_text(docs, carry, text_column)
    size, crc = F.octet_length(text) + 8, F.crc32(text)
    base, rows = aligned(
        docs.select(
            columns[0], size.cast("long").alias("size"), crc.alias("text_crc32"), jump_column(digest60(key), shards).alias("shard"),
            jump_column(digest60(key), shards + 1).alias("grown_shard"), digest60(F.concat_ws(":", key, crc.cast("string"), size.cast("string"))).alias("place"),
        ),
        "sharding",
    )
    with joins_by_part_of_key(docs.sparkSession):
        slots = stored(_slots(base, rows), "sharding-slots")
        return with_found(base, slots, ["slot"]).select("row", "size", "text_crc32", "shard", F.col("found.slot").alias("slot"), "grown_shard")


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write rows of `shard_rows` in one folder per shard. A shard is as many files as tasks hold rows of it; slots order them."""
    sharded.write.partitionBy("shard").parquet(path)
