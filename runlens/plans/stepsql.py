"""SQL for the step tables, shared by the checks of windows, joins and steps."""

from . import feeds
from .feeds import oracle_feed

STEP_CTE = f"""
ln AS {oracle_feed(feeds.LINES)}, stt AS {oracle_feed(feeds.STATEMENTS)}, nd AS {oracle_feed(feeds.NODES)},
io AS {oracle_feed(feeds.IO)},
cov AS (SELECT run_id, file, unnest(generate_series(line, last_line)) AS line, stmt, ord FROM stt),
fl AS (SELECT run_id, file, line, arg_min(stmt, ord) AS stmt FROM cov GROUP BY ALL),
mp AS (SELECT ln.*, fl.stmt FROM ln JOIN fl USING (run_id, file, line)),
isl AS (SELECT *, sum(chg) OVER (PARTITION BY run_id ORDER BY seq)::bigint AS island FROM
        (SELECT *, CASE WHEN lag(node) OVER w = node AND lag(stmt) OVER w = stmt THEN 0 ELSE 1 END AS chg
         FROM mp WINDOW w AS (PARTITION BY run_id ORDER BY seq))),
mg AS (SELECT run_id, island, node, stmt, min(seq) AS seq, max(seq) AS end_seq, arg_min(t_ms, seq) AS t_ms,
              arg_max(raised, seq) FILTER (WHERE raised IS NOT NULL) AS raised
       FROM isl GROUP BY run_id, island, node, stmt),
oc AS (SELECT mg.*, row_number() OVER (PARTITION BY run_id, node, mg.stmt ORDER BY seq) AS occurrence,
              kind, parent, block, grp, line, last_line, call_origin
       FROM mg JOIN stt USING (run_id, stmt)),
anc(run_id, stmt, ancestor, side, up) AS (
  SELECT s.run_id, s.stmt, s.parent, s.block, s.parent FROM stt s WHERE s.parent IS NOT NULL
  UNION ALL
  SELECT a.run_id, a.stmt, s.parent, s.block, s.parent FROM anc a JOIN stt s ON s.run_id = a.run_id AND s.stmt = a.up
  WHERE s.parent IS NOT NULL),
l1 AS (SELECT *, lead(stmt) OVER (PARTITION BY run_id, node ORDER BY seq) AS nxt FROM oc),
l2 AS (SELECT l1.* FROM l1 LEFT JOIN anc a ON a.run_id = l1.run_id AND a.stmt = l1.nxt AND a.ancestor = l1.stmt
       WHERE NOT (kind IN ('for', 'while') AND occurrence > 1 AND a.side IS NULL)),
l3 AS (SELECT *, lag(stmt) OVER (PARTITION BY run_id, node ORDER BY seq) AS prv FROM l2),
l4 AS (SELECT *, last_value(CASE WHEN prv <> stmt THEN prv END IGNORE NULLS) OVER (PARTITION BY run_id, node ORDER BY seq
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bef FROM l3),
kp AS (SELECT l4.* EXCLUDE (nxt, prv, bef) FROM l4 LEFT JOIN anc a ON a.run_id = l4.run_id AND a.stmt = l4.bef AND a.ancestor = l4.stmt
       WHERE NOT (kind = 'with' AND a.side IS NOT NULL)),
tm AS (SELECT kp.*, coalesce(lead(kp.t_ms) OVER (PARTITION BY run_id, node ORDER BY seq), nd.t_ms + nd.dur_ms) AS t_end
       FROM kp JOIN nd USING (run_id, node)),
pt(run_id, node, path, up) AS (
  SELECT run_id, node, [node], parent FROM nd
  UNION ALL SELECT p.run_id, p.node, list_prepend(n.node, p.path), n.parent FROM pt p JOIN nd n ON n.run_id = p.run_id AND n.node = p.up),
ch AS (SELECT run_id, node, path FROM pt WHERE up IS NULL)
"""


def with_steps(select: str, more: str = "") -> str:
    return f"WITH RECURSIVE {STEP_CTE}{',' + more if more else ''} {select}"
