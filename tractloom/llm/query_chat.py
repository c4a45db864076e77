from .chat import format_chats
from .common import table
from .registry import query

SQL = r"""
WITH d AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
c AS (
  SELECT conv_id, count(*) AS n_turns,
    list({'r': coalesce(role, chr(1)), 't': coalesce(text, chr(1))} ORDER BY turn NULLS FIRST, role, text) AS said,
    string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS text
  FROM d GROUP BY conv_id),
k AS (SELECT *, min(conv_id) OVER (PARTITION BY said) AS first, count(*) OVER (PARTITION BY said) AS alike FROM c),
f AS (SELECT * FROM k WHERE conv_id = first),
m AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.n_turns > f.n_turns AND c.said[:f.n_turns] = f.said))
SELECT m.conv_id, CAST(0 AS INTEGER) AS piece, m.n_turns, CAST(1 AS INTEGER) AS n_pieces,
  CAST(m.alike - 1 + (SELECT count(*) FROM c WHERE c.n_turns < m.n_turns AND m.said[:c.n_turns] = c.said) AS BIGINT) AS n_snapshots, m.text
FROM m
"""


@query("op2_chat_format", SQL)
def op2_chat_format(spark, sf_dir):
    return format_chats(table(spark, sf_dir, "conversations"))
