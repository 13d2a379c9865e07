"""Version histories, with conversations as sheets and turns as versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import versions
from .registry import Tables, query

_MESSAGES = (
    "CASE (conv_id * 7 + turn * 5 + length(text)) % 9 WHEN 0 THEN 'uploaded - undo/x.csv' WHEN 1 THEN 'undo - 1/2' WHEN 2 THEN 'undo - 1/3' "
    "WHEN 3 THEN 'redo - 1/2' WHEN 4 THEN 'cleaned - 1/2' WHEN 5 THEN 'mapping - merged/x' WHEN 6 THEN 'Script execution: kpi/a' "
    "WHEN 7 THEN 'melted - 3' ELSE 'Updated by hand' END"
)


def conversation_versions(t: Tables):
    previous = F.when(F.col("turn") > 0, F.array(F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), F.col("turn") - 1)))
    return t.conversations.select(
        F.col("conv_id").alias("sheet"),
        F.col("turn").alias("ordinal"),
        F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), F.col("turn")).alias("hash"),
        F.coalesce(previous, F.array().cast("array<string>")).alias("parents"),
        F.expr(_MESSAGES).alias("message"),
    )


_VERSIONS_SQL = f"""v AS (SELECT conv_id AS sheet, turn AS ordinal, 'c' || conv_id || '-' || turn AS hash,
  CASE WHEN turn > 0 THEN 'c' || conv_id || '-' || (turn - 1) END AS parent, {_MESSAGES} AS message FROM conversations),
o AS (SELECT *, CASE string_split(message, ' ')[1] WHEN 'uploaded' THEN 'uploaded' WHEN 'undo' THEN 'undo' WHEN 'redo' THEN 'redo'
  WHEN 'cleaned' THEN 'cleaning' WHEN 'mapping' THEN 'mapping' WHEN 'Script' THEN 'script' WHEN 'melted' THEN 'melting' ELSE 'updated' END AS operation,
  row_number() OVER (PARTITION BY sheet ORDER BY ordinal) AS rn FROM v)"""


@query(f"WITH {_VERSIONS_SQL} SELECT operation, count(*) AS versions FROM o GROUP BY ALL")
def classify_operations(t: Tables):
    return versions.with_operation(conversation_versions(t)).groupBy("operation").agg(F.count("*").alias("versions"))


@query(
    f"""WITH {_VERSIONS_SQL} SELECT o.sheet, o.ordinal, o.hash, o.operation, coalesce(o.parent, '') AS parents,
  (SELECT count(*) FROM o c WHERE c.parent = o.hash) AS children FROM o"""
)
def history(t: Tables):
    listed = versions.history(conversation_versions(t))
    return listed.select(
        "sheet", "ordinal", "hash", "operation", F.array_join("parents", ",").alias("parents"), F.col("children").cast("long").alias("children")
    )


@query(
    f"""WITH {_VERSIONS_SQL} SELECT o.hash, o.message, (SELECT count(*) FROM o c WHERE c.parent = o.hash) AS children FROM o"""
)
def version_graph(t: Tables):
    graph = versions.version_graph(conversation_versions(t))
    return graph.select("hash", "message", F.col("children").cast("long").alias("children"))


@query(f"WITH {_VERSIONS_SQL} SELECT c.sheet, c.parent, c.hash AS child, c.ordinal AS child_ordinal FROM o c JOIN o p ON p.hash = c.parent")
def child_edges(t: Tables):
    return versions.child_edges(conversation_versions(t))


@query(
    f"""WITH RECURSIVE {_VERSIONS_SQL}, w AS (SELECT sheet, rn, hash, operation, parent, parent AS np FROM o WHERE rn = 1
  UNION ALL SELECT o.sheet, o.rn, o.hash, o.operation, o.parent,
    CASE WHEN o.operation = 'undo' AND o.parent = w.hash AND w.np IS NOT NULL THEN w.np ELSE o.parent END
  FROM w JOIN o ON o.sheet = w.sheet AND o.rn = w.rn + 1)
SELECT w.sheet, w.hash, w.operation, coalesce(np, '') AS parents, CASE WHEN w.operation IN ('cleaning', 'melting', 'mapping')
  THEN (SELECT count(*) FROM o s WHERE s.sheet = w.sheet AND s.operation = 'script' AND s.rn < w.rn) ELSE 0 END AS script_parents FROM w"""
)
def history_linked(t: Tables):
    linked = versions.history_linked(conversation_versions(t))
    return linked.select("sheet", "hash", "operation", F.array_join("parents", ",").alias("parents"), "script_parents")


@query(
    f"""WITH {_VERSIONS_SQL} SELECT sheet, row_number() OVER (PARTITION BY sheet ORDER BY ordinal) AS script_no, hash FROM o WHERE operation = 'script'"""
)
def numbered_scripts(t: Tables):
    return versions.numbered_scripts(conversation_versions(t))


_REPLAY_SQL = f"""{_VERSIONS_SQL}, x AS (SELECT sheet, ordinal, rn, hash, CASE WHEN operation IN ('mapping', 'script', 'updated') THEN 'other' ELSE operation END AS op FROM o),
r AS (SELECT sheet, CAST(0 AS BIGINT) AS rn, CAST([] AS VARCHAR[]) AS stack, CAST(NULL AS VARCHAR) AS popped, CAST(NULL AS VARCHAR) AS parent,
    CAST(NULL AS VARCHAR) AS hash, CAST(NULL AS VARCHAR) AS op, CAST(NULL AS BIGINT) AS ordinal FROM x WHERE rn = 1
  UNION ALL SELECT x.sheet, x.rn,
    CASE WHEN x.op = 'uploaded' THEN [x.hash] WHEN x.op = 'undo' THEN r.stack[:len(r.stack) - 1] ELSE list_append(r.stack, x.hash) END,
    CASE WHEN x.op = 'undo' AND len(r.stack) > 0 THEN r.stack[-1] ELSE r.popped END,
    CASE WHEN x.op IN ('uploaded', 'undo') THEN NULL WHEN x.op = 'redo' AND r.popped IS NOT NULL THEN r.popped WHEN len(r.stack) > 0 THEN r.stack[-1] END,
    x.hash, x.op, x.ordinal FROM r JOIN x ON x.sheet = r.sheet AND x.rn = r.rn + 1)"""


@query(
    f"""WITH RECURSIVE {_REPLAY_SQL} SELECT sheet, ordinal, hash, op AS operation, parent,
  (SELECT count(*) FROM r c WHERE c.parent = r.hash) AS children FROM r WHERE rn > 0 AND op NOT IN ('undo', 'redo')"""
)
def history_replayed(t: Tables):
    return versions.replay_history(conversation_versions(t))


@query(f"WITH RECURSIVE {_REPLAY_SQL} SELECT sheet, ordinal, op AS operation, parent FROM r WHERE rn > 0")
def replay_parents(t: Tables):
    """Same with borders of tasks inside the sheets."""
    replayed = versions.replay_parents(conversation_versions(t), partitions=7)
    return replayed.select("sheet", "ordinal", "operation", "parent")
