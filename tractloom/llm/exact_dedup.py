"""Exact duplicates by an exchange of Golomb-coded fingerprints.

Each chunk of documents sends, to the owner of each fingerprint range, its distinct fingerprints in order, gap-coded. The
owner answers with one bit per fingerprint: also held by another chunk or not. Only rows with such a fingerprint
(suspects) are shuffled with their text and compared byte by byte. Fingerprints have 12 bits more than the row count
needs, so about one distinct text in 4,096 is suspected wrongly and cleared by the comparison.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import aligned, joins_by_part_of_key, lower_ascii, quoted, row_and_text, with_found

SPARE_BITS = 12


def golomb(gaps: np.ndarray) -> tuple[int, bytes, bytes]:
    """Golomb code of non-negative gaps with a divisor of 2**k: k, unary quotients, k-bit remainders."""
    k = max(0, int(math.log2(max(1.0, float(gaps.mean()))))) if len(gaps) else 0
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotients + 1)
    unary = np.ones(int(ends[-1]) if len(ends) else 0, np.uint8)
    unary[ends - 1] = 0
    shifts = np.arange(k - 1, -1, -1, dtype=np.uint64)
    rest = ((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel()
    return k, np.packbits(unary).tobytes(), np.packbits(rest).tobytes()


def ungolomb(n: int, k: int, unary: bytes, rest: bytes) -> np.ndarray:
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)) == 0)[:n]
    quotients = np.diff(np.concatenate([[-1], ends])) - 1
    gaps = quotients.astype(np.uint64) << np.uint64(k)
    if k:
        bits = np.unpackbits(np.frombuffer(rest, np.uint8))[: n * k].reshape(n, k).astype(np.uint64)
        gaps |= bits @ (np.uint64(1) << np.arange(k - 1, -1, -1, dtype=np.uint64))
    return gaps


def _sorted_set(n: int, k: int, unary: bytes, rest: bytes) -> np.ndarray:
    return np.cumsum(ungolomb(n, k, unary, rest))


REQUEST = "sender long, chunk long, owner long, n int, k int, unary binary, rest binary, again binary"
REPLY = "sender long, chunk long, owner long, shared binary"


def _send(width: int):
    """For each chunk and owner the ordered fingerprints; `again` marks those the chunk itself holds more than once."""

    def run(batches):
        from pyspark import TaskContext

        held: dict[int, list[np.ndarray]] = {}
        for b in batches:
            chunk, fp = b.column("chunk").to_numpy(), b.column("fp").to_numpy().astype(np.uint64)
            order = np.argsort(chunk, kind="stable")
            cut = np.flatnonzero(np.diff(chunk[order])) + 1
            for ids, part in zip(np.split(chunk[order], cut), np.split(fp[order], cut), strict=True):
                if len(ids):
                    held.setdefault(int(ids[0]), []).append(part)
        sender, rows = TaskContext.get().partitionId(), []
        for chunk, parts in held.items():
            values, counts = np.unique(np.concatenate(parts), return_counts=True)
            owners = (values // np.uint64(width)).astype(np.int64)
            cut = np.flatnonzero(np.diff(owners)) + 1
            for own, v, c in zip(np.split(owners, cut), np.split(values, cut), np.split(counts, cut), strict=True):
                v = v - np.uint64(own[0] * width)
                k, unary, rest = golomb(np.diff(v, prepend=np.uint64(0)))
                rows.append((sender, chunk, int(own[0]), len(v), k, unary, rest, np.packbits(c > 1).tobytes()))
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*rows), [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.binary()] * 3, strict=True)],
                names=["sender", "chunk", "owner", "n", "k", "unary", "rest", "again"],
            )

    return run


def _answer(requests: pa.Table) -> pa.Table:
    """One owner: for each request a bit per fingerprint, set if another request holds it too."""
    rows = requests.to_pylist()
    sets = [_sorted_set(r["n"], r["k"], r["unary"], r["rest"]) for r in rows]
    values, counts = np.unique(np.concatenate(sets), return_counts=True)
    shared = values[counts > 1]
    return pa.table({
        "sender": pa.array([r["sender"] for r in rows], pa.int64()), "chunk": pa.array([r["chunk"] for r in rows], pa.int64()),
        "owner": pa.array([r["owner"] for r in rows], pa.int64()),
        "shared": pa.array([np.packbits(np.isin(s, shared, assume_unique=True)).tobytes() for s in sets], pa.binary()),
    })


def _suspects(width: int):
    def run(batches):
        for b in batches:
            chunks, fps = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for r in b.to_pylist():
                bits = np.frombuffer(r["shared"], np.uint8) | np.frombuffer(r["again"], np.uint8)
                hit = np.unpackbits(bits)[: r["n"]].astype(bool)
                if hit.any():
                    v = _sorted_set(r["n"], r["k"], r["unary"], r["rest"])[hit] + np.uint64(r["owner"] * width)
                    fps.append(v.astype(np.int64))
                    chunks.append(np.full(len(v), r["chunk"], np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(chunks)), pa.array(np.concatenate(fps))], names=["chunk", "fp"])

    return run


def exact_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", carry: list[str] | None = None,
    fingerprints_per_owner: int = 2_000_000,
) -> DataFrame:
    """Groups of texts that are identical after lower-casing A-Z; of each group the row with the largest id stays.

    Returns one row per input row: `row` (struct of the carried columns, all by default), keep_id, group_size, kept,
    text_sha256 (of the normalised text). Ids are integers. A null text counts as empty, and empty texts equal each other. A
    null id ranks below every other. Of rows with equal text and equal id exactly one is kept. An empty table gives no rows.
    """
    columns, text = row_and_text(docs, carry, text_column)
    norm = lower_ascii(quoted(text_column))
    base, rows = aligned(
        docs.select(*columns, quoted(id_column).alias("id"), F.xxhash64(norm).alias("fp"), F.sha2(norm, 256).alias("sha")), "dedup"
    )
    spark = docs.sparkSession
    bits = min(62, math.ceil(math.log2(max(2, rows))) + SPARE_BITS)
    owners = max(16, math.ceil(rows / fingerprints_per_owner))
    width = -(-(1 << bits) // owners)
    base = base.withColumn("fp", F.shiftrightunsigned("fp", 64 - bits))
    requests = stored(base.select("chunk", "fp").mapInArrow(_send(width), REQUEST), "dedup-requests")
    replies = requests.drop("again").groupBy("owner").applyInArrow(_answer, REPLY)
    suspects = stored(
        requests.join(replies, ["sender", "chunk", "owner"]).mapInArrow(_suspects(width), "chunk long, fp long").distinct(),
        "dedup-suspects",
    )
    with joins_by_part_of_key(spark):
        suspect = stored(base.join(suspects, ["chunk", "fp"]).select("chunk", "rid", "id", "fp", "sha", text.alias("text")), "dedup-texts")
    groups = (
        suspect.groupBy("fp", lower_ascii(F.col("text")).alias("norm")).agg(F.max(F.struct("id", "rid")).alias("keep"), F.count("*").alias("group_size"))
        .select(F.sha2("norm", 256).alias("sha"), "keep", "group_size")
    )
    grouped = suspect.select("chunk", "rid", "sha").join(groups, "sha").select("chunk", "rid", "keep", "group_size")
    with joins_by_part_of_key(spark):
        found = stored(
            base.select("chunk", "rid", "id").join(grouped, ["chunk", "rid"], "left").select(
                "chunk", "rid", F.when(F.col("keep").isNull(), F.col("id")).otherwise(F.col("keep.id")).alias("keep_id"),
                F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.coalesce(F.col("keep.rid") == F.col("rid"), F.lit(True)).alias("kept"),
            ),
            "dedup-found",
        )
    named = with_found(base.select("chunk", "rid", "row", "sha"), found, ["keep_id", "group_size", "kept"])
    return named.select("row", "found.keep_id", "found.group_size", "found.kept", F.col("sha").alias("text_sha256"))
