from pyspark.sql import functions as F

from .common import table
from .prefix_trie import prefix_trie
from .registry import query

#: The statement spells out every rebuilt conversation and groups its prefixes by their turns.
SQL = r"""
WITH t AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (
  SELECT c, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS said FROM t GROUP BY c),
h AS (
  SELECT *, c - c % 20 AS base, CAST(xor(list_reduce([4294967295] || list_transform(regexp_extract_all(hex(encode(CAST(c AS VARCHAR))), '..'), lambda b: CAST('0x' || b AS BIGINT)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 4 AS BIGINT) AS h
  FROM o),
r AS (SELECT h.c, list_concat(coalesce(b.said[:h.h], []), h.said[h.h + 1:]) AS said FROM h LEFT JOIN o b ON b.c = h.base),
m AS (SELECT c, d, said[:d] AS p, len(said) AS n FROM (SELECT *, unnest(range(len(said) + 1)) AS d FROM r)),
n AS (
  SELECT d, p, min(c) AS conv_id, count(*) AS n_convs, max(n) = d AS leaf, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d), '') AS ends,
    (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(any_value(p[d].text), '[^\x20\x09-\x0D]+')) END AS saved
  FROM m GROUP BY d, p),
k AS (SELECT d - 1 AS d, p[:d - 1] AS p, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
s AS (
  SELECT u.d, u.p, count(*) FILTER (v.leaf) AS n_leaves, sum(v.saved) AS saved_tokens
  FROM (SELECT d, p, leaf, saved, unnest(range(d + 1)) AS e FROM n) v JOIN n u ON u.d = v.e AND u.p = v.p[:v.e] GROUP BY u.d, u.p)
SELECT n.conv_id, n.d AS depth, q.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens,
  sha256(n.ends) AS ends_sha256
FROM n JOIN s ON s.d = n.d AND s.p = n.p LEFT JOIN k ON k.d = n.d AND k.p = n.p LEFT JOIN n q ON q.d = n.d - 1 AND q.p = n.p[:n.d - 1] AND n.d > 0
"""


@query("op12_prefix_trie", SQL)
def op12_prefix_trie(spark, sf_dir):
    conv = F.col("conv")
    found = prefix_trie(table(spark, sf_dir, "conversations"), head=F.crc32(conv.cast("string")) % 4, base=conv - conv % 20)
    return found.drop("turn_conv", "turn_position")
