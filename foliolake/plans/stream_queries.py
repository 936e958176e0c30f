"""Queries over events, as tables and as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..streaming import events as E
from .registry import query, table


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL")
def stream_tumbling(s, d):
    out = E.tumbling(table(s, d, "events"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 3).alias("total"))


@query("SELECT start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start FROM events) GROUP BY ALL")
def stream_sliding(s, d):
    return E.sliding(table(s, d, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM a) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM b GROUP BY user_id, k""")
def stream_sessions(s, d):
    out = E.sessions(table(s, d, "events"))
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_structured(s, d):
    """The tumbling window as a Structured Streaming job over the table's files, drained."""
    like = table(s, d, "events")
    stream = E.read_stream(s, f"{d}/events.parque[t]", like)
    out = E.drain(E.tumbling(stream), f"events_{uuid.uuid4().hex[:8]}")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("SELECT count(*) AS n FROM events")
def stream_deduplicated(s, d):
    e = table(s, d, "events")
    twice = e.unionAll(e)
    return twice.withColumn("ts", F.col("ts").cast("timestamp")).dropDuplicates(["event_id"]).agg(F.count("*").alias("n"))


@query("SELECT event_type, json_extract_string(props, '$.' || k) IS NOT NULL AS has_key, count(*) AS n FROM events, (SELECT json_keys(props)[1] AS k FROM events LIMIT 1) GROUP BY ALL")
def json_properties(s, d):
    """A property of the events' JSON, as a variant."""
    e = table(s, d, "events")
    key = e.select(F.expr("json_object_keys(props)[0]")).first()[0]
    return e.groupBy("event_type", F.expr(f"variant_get(try_parse_json(props), '$.{key}') IS NOT NULL").alias("has_key")).agg(F.count("*").alias("n"))
