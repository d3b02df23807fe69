"""Conversations over the events of users: each event is a turn."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import conversations


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as turns; a turn's number may come again, and some have no field."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    names = F.array(*(F.lit(n) for n in conversations.EVENTS))
    name = F.element_at(names, ((F.col("event_id") * 7 + F.col("user_id")) % len(conversations.EVENTS) + 1).cast("int"))
    number = F.lpad((F.round(F.col("value") * 100).cast("long") % 4000).cast("string"), 4, "0")
    return e.select(F.col("user_id").alias("session_id"), number.alias("turn_id"), F.col("ts").cast("timestamp").alias("at"), name.alias("event"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("field"))


def conversation_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each user's conversation is after all turns, with pauses of a day ending sessions."""
    return conversations.states(turns(spark, sf_dir), ttl=24 * 60)


_NAMES = "[" + ", ".join(f"'{n}'" for n in conversations.EVENTS) + "]"
_MOVES = ", ".join(f"('{s}', '{e}', '{t}')" for s, m in conversations.MOVES.items() for e, t in m.items())
CONVERSATION_STATES = f"""
WITH RECURSIVE m(s, event, target) AS (VALUES {_MOVES}),
e AS (SELECT user_id AS session_id, lpad((round(value * 100)::BIGINT % 4000)::VARCHAR, 4, '0') AS turn_id, ts, ({_NAMES})[(event_id * 7 + user_id) % {len(conversations.EVENTS)} + 1] AS event, event_type <> 'view' AS has, event_id FROM events),
f AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY session_id, turn_id ORDER BY ts, event, event_id) = 1),
o AS (SELECT *, row_number() OVER w AS n, coalesce(ts - lag(ts) OVER w >= INTERVAL 1 DAY, false) AS pause FROM f WINDOW w AS (PARTITION BY session_id ORDER BY ts, turn_id)),
walk AS (
  SELECT DISTINCT session_id, 0::BIGINT AS n, 'NEW_SESSION' AS state, false AS pending, false AS expected, NULL::VARCHAR AS back, 0::BIGINT AS n_ignored, 1::BIGINT AS n_sessions FROM o
  UNION ALL
  SELECT session_id, n, CASE WHEN event = 'START_OVER_REQUESTED' THEN 'WAITING_FOR_NEED' WHEN event IN ('END_CONVERSATION_REQUESTED', 'MAX_TURNS_REACHED') THEN 'COMPLETED' WHEN event = 'PROCESSING_FAILED' THEN 'ERROR'
      WHEN event IN ('LANGUAGE_CHANGED', 'REPEAT_REQUESTED') THEN s WHEN answered THEN coalesce(b, 'WAITING_FOR_PROFILE_VALUE') WHEN target IS NULL THEN s
      WHEN target = 'WAITING_FOR_CONFIRMATION' AND NOT p2 THEN CASE WHEN s = 'WAITING_FOR_CONFIRMATION' THEN CASE WHEN e2 THEN 'WAITING_FOR_PROFILE_VALUE' ELSE 'PROCESSING_DISCOVERY' END WHEN s = 'WAITING_FOR_PROFILE_VALUE' AND NOT e2 THEN 'PROCESSING_DISCOVERY' ELSE s END
      WHEN target = 'WAITING_FOR_PROFILE_VALUE' AND NOT e2 THEN 'PROCESSING_DISCOVERY' ELSE target END,
    CASE WHEN event = 'START_OVER_REQUESTED' THEN false WHEN always OR answered OR target IS NULL THEN p ELSE p2 END,
    CASE WHEN event = 'START_OVER_REQUESTED' THEN false WHEN always OR answered OR target IS NULL THEN x ELSE e2 END,
    CASE WHEN event = 'START_OVER_REQUESTED' OR answered THEN NULL WHEN target IS NOT NULL AND NOT always AND event = 'CITIZEN_QUERY_RECEIVED' THEN s ELSE b END,
    n_ignored + (target IS NULL AND NOT always AND NOT answered)::INT, n_sessions + pause::INT
  FROM (SELECT c.*, m.target, c.event IN ('START_OVER_REQUESTED', 'END_CONVERSATION_REQUESTED', 'MAX_TURNS_REACHED', 'PROCESSING_FAILED', 'LANGUAGE_CHANGED', 'REPEAT_REQUESTED') AS always, c.s = 'HANDLING_CITIZEN_QUERY' AND c.event = 'QUERY_ANSWERED' AS answered,
      (p OR (c.event IN ('PROFILE_VALUE_EXTRACTED_CONFIRMATION_REQUIRED', 'PROFILE_VALUE_CORRECTED') AND has)) AND c.event NOT IN ('PROFILE_VALUE_CONFIRMED', 'PROFILE_VALUE_REJECTED') AS p2,
      (x OR (c.event IN ('MORE_INFO_REQUIRED', 'CLARIFICATION_PROVIDED') AND has)) AND c.event <> 'PROFILE_VALUE_EXTRACTED' AS e2
    FROM (SELECT o.session_id, o.n, o.event, o.has, o.pause, CASE WHEN o.pause THEN 'NEW_SESSION' ELSE w.state END AS s, NOT o.pause AND w.pending AS p, NOT o.pause AND w.expected AS x, CASE WHEN NOT o.pause THEN w.back END AS b, w.n_ignored, w.n_sessions
      FROM walk w JOIN o ON o.session_id = w.session_id AND o.n = w.n + 1) c LEFT JOIN m ON m.s = c.s AND m.event = c.event))
SELECT session_id, state, pending, expected, n_ignored, n_sessions FROM walk QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY n DESC) = 1
"""

QUERIES = {"conversation_states": conversation_states}
ORACLE_SQL = {"conversation_states": CONVERSATION_STATES}
