"""Registered queries: usage log and the streaming quota (§2.12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import usage as U
from ..sources.documents import read_table
from ..streaming.quota import run_quota_stream
from . import oracle as O
from .catalog import register

# Fixed value (ours): the event type that stands for a user message.
USER_EVENT = "click"


def _events(spark, sf):
    return read_table(spark, sf, "events")


@register("pseudonymise_user", "SELECT event_id, sha256(CAST(user_id AS VARCHAR)) AS user_hash, "
          "substr(sha256(CAST(user_id AS VARCHAR)), 1, 12) || '-' || strftime(ts, '%Y%m%d%H%M%S') || '-' || "
          f"CASE WHEN event_type = '{USER_EVENT}' THEN '0' ELSE '1' END AS row_key, "
          "suffix(CAST(user_id AS VARCHAR), '0') AS in_domain FROM events")
def pseudonymise_user(spark, sf):
    e = _events(spark, sf)
    role = F.when(F.col("event_type") == USER_EVENT, F.lit("user")).otherwise(F.lit("assistant"))
    return U.pseudonymise(e, "user_id", "ts", role, domain_suffix="0").select("event_id", "user_hash", "row_key", "in_domain")


@register("rolling_quota", "SELECT event_id, user_id, ts, n_24h, n_24h >= 10 AS quota_reached FROM ("
          "SELECT event_id, user_id, ts, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) "
          f"RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS n_24h FROM events WHERE event_type = '{USER_EVENT}')")
def rolling_quota(spark, sf):
    m = _events(spark, sf).filter(F.col("event_type") == USER_EVENT).select("event_id", "user_id", "ts")
    return U.rolling_quota(m)


@register("rolling_quota_stream", "SELECT window_start, window_start + INTERVAL 24 HOUR AS window_end, user_id, count(*) AS n FROM ("
          "SELECT user_id, date_trunc('hour', ts) - to_hours(k) AS window_start FROM events, range(0, 24) r(k) "
          f"WHERE event_type = '{USER_EVENT}') GROUP BY ALL")
def rolling_quota_stream(spark, sf):
    return run_quota_stream(spark, f"{sf.rstrip('/')}/events.parquet", F.col("event_type") == USER_EVENT).windows()


@register("message_intent", "SELECT conv_id, turn, CASE WHEN text IS NULL OR regexp_replace(text, '^\\s+|\\s+$', '', 'g') = '' "
          f"THEN 'none' WHEN regexp_matches(text, {O.q(U.PLOT_PATTERN)}) THEN 'plot' ELSE 'chat' END AS intent FROM conversations")
def message_intent(spark, sf):
    c = read_table(spark, sf, "conversations")
    return c.select("conv_id", "turn", U.message_intent(F.col("text")).alias("intent"))


@register("prune_thread", "SELECT conv_id, turn, role FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, "
          "row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS e, "
          "coalesce(min(turn) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id), min(turn) OVER (PARTITION BY conv_id)) AS f "
          "FROM conversations) WHERE n <= 20 OR e <= 19 OR turn = f")
def prune_thread(spark, sf):
    c = read_table(spark, sf, "conversations").select("conv_id", "turn", "role")
    return U.prune_thread(c)
