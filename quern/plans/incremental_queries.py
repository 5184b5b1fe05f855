"""Queries of problem 4."""

from quern.operators.incremental import replay_ledger
from quern.queries import query, table

P4_SQL = r"""
WITH f AS (
  SELECT replace(file_path, '\', '/') AS file_path, lower(trim(content_hash, E' \t\r\n')) AS h, indexed_at, delivery_id, arrived_at
  FROM change_feed WHERE content_hash IS NOT NULL
), r AS (
  SELECT run_id, read_upto, lag(read_upto) OVER (ORDER BY read_upto, run_id) AS prev FROM index_runs WHERE status = 'succeeded'
), now AS (
  SELECT r.run_id, f.file_path, arg_max(h, (indexed_at, delivery_id)) AS h FROM r JOIN f ON f.arrived_at <= r.read_upto
  WHERE h <> '' GROUP BY ALL
), was AS (
  SELECT r.run_id, f.file_path, arg_max(h, (indexed_at, delivery_id)) AS h FROM r JOIN f ON f.arrived_at <= r.prev
  WHERE h <> '' GROUP BY ALL
)
SELECT now.run_id, now.file_path FROM now LEFT JOIN was USING (run_id, file_path) WHERE now.h IS DISTINCT FROM was.h
"""


@query(P4_SQL)
def p4_found(spark, sf):
    return replay_ledger(table(spark, sf, "change_feed"), table(spark, sf, "index_runs"))
