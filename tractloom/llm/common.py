"""Helpers shared by the operators of this package."""

from __future__ import annotations

import math
import os
import string
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_path, note_table

#: One word: a run without space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows that lie together in a chunk of an aligned table (a power of two).
CHUNK_BITS = 11


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else untouched; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def in_fold(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32(doc_id as text) leaves this remainder. A null id is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")


def quoted(name: str) -> Column:
    """A column by its literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame, columns: list[str] | None = None) -> Column:
    """The named columns (all if None) as one struct, so that no helper column can clash with them."""
    return F.struct(*[quoted(c) for c in (df.columns if columns is None else columns)])


def aligned(df: DataFrame, name: str, rows_in_bucket: int = 8192) -> tuple[DataFrame, int]:
    """Write rows once, where they are, with `rid` (unique) and `chunk` (2048 neighbouring rows); return table and row count.

    The table is bucketed by chunk, so a later join on chunk moves only the other side. The bucket count follows the rows.
    """
    spark = df.sparkSession
    rows = df.count()
    buckets = int(min(50_000, max(8, math.ceil(rows / rows_in_bucket))))
    path = fresh_path(spark, name)
    token = f"{name}_{os.path.basename(path).rsplit('-', 1)[-1]}"
    (
        df.withColumn("rid", F.monotonically_increasing_id())
        .withColumn("chunk", F.shiftright("rid", CHUNK_BITS))
        .write.format("parquet").option("compression", "zstd").bucketBy(buckets, "chunk").option("path", path).saveAsTable(token)
    )
    note_table(token)
    return spark.table(token), rows


def row_and_text(df: DataFrame, carry: list[str] | None, text_column: str) -> tuple[list[Column], Column]:
    """Columns to write (`row`, and `text` only if the row lacks it) and the text read from them: each text is written once."""
    row = packed(df, carry).alias("row")
    if carry is None or text_column in carry:
        return [row], F.col("row").getField(text_column)
    return [row, quoted(text_column).alias("text")], F.col("text")


def with_found(base: DataFrame, found: DataFrame, columns: list[str]) -> DataFrame:
    """An aligned table with `found`, a struct of the columns that `found` (chunk, rid, ...) holds for each of its rows.

    Only `found` moves, one array of at most 2048 entries per chunk; the rid's low bits are the place in it. It must hold
    every row of the base exactly once.
    """
    by_chunk = found.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("rid", *columns))).alias("entries"))
    place = F.col("rid").bitwiseAND(F.lit((1 << CHUNK_BITS) - 1)).cast("int")
    return base.join(by_chunk, "chunk").withColumn("found", F.col("entries")[place]).drop("entries")


@contextmanager
def joins_by_part_of_key(spark: SparkSession):
    """Within: a join on (chunk, ...) may rely on a table that is laid out by chunk alone."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Words of a batch of texts: code of each word, row offsets (one more than rows), words by code. Null has none."""
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    coded = lists.flatten().dictionary_encode()
    codes, names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()
    offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
    if "" in names:
        some = codes != names.index("")
        offsets = np.concatenate([[0], np.cumsum(some)])[offsets]
        codes = codes[some]
    return codes, offsets, names


def hashes(names: list[str]) -> np.ndarray:
    """64-bit hashes of strings, the same in every process."""
    if not names:
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(np.array(names, dtype=object), categorize=False).astype(np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers whose every output bit depends on all input bits."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start..start+length-1 of each range, one range after the other."""
    lengths = lengths.astype(np.int64)
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts.astype(np.int64) - (ends - lengths), lengths)
