from pyspark.sql import functions as F

from .common import table
from .registry import query
from .sharding import shard_rows

SHARDS = 24

#: CRC-32 runs over a table of 256 entries, which the statement derives; shards follow the jump recursion on 64-bit numbers.
SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)),
given AS (SELECT row_number() OVER () AS r, doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS k, coalesce(text, '') AS text FROM documents),
texts AS (SELECT DISTINCT text FROM given),
summed AS (
  SELECT text, octet_length(encode(text)) + 8 AS size,
    xor(list_reduce([4294967295] || list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda b: CAST('0x' || b AS BIGINT)),
      lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) AS c
  FROM texts, crc),
d AS (SELECT g.*, s.size, s.c FROM given g JOIN summed s USING (text)),
j AS (
  SELECT r, CAST(CAST('0x' || left(md5(k), 15) AS BIGINT) AS HUGEINT) AS state, CAST(-1 AS BIGINT) AS b, CAST(0 AS BIGINT) AS ahead FROM d
  UNION ALL
  SELECT r, n, ahead, CAST(floor(CAST(ahead + 1 AS DOUBLE) * (CAST(2147483648 AS DOUBLE) / CAST(n // 8589934592 + 1 AS DOUBLE))) AS BIGINT)
  FROM (SELECT *, (state * 2862933555777941757 + 1) % 18446744073709551616 AS n FROM j WHERE ahead < 25)),
s AS (SELECT r, max(b) FILTER (b < 24) AS shard, max(b) AS grown FROM j GROUP BY r)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(c AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY left(md5(k || ':' || c || ':' || size), 15)) - 1 AS slot, CAST(grown AS INTEGER) AS grown_shard
FROM d JOIN s USING (r)
"""


@query("op11_sharding", SQL)
def op11_sharding(spark, sf_dir):
    found = shard_rows(table(spark, sf_dir, "documents"), SHARDS, carry=["doc_id"])
    return found.select("row.doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
