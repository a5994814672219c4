"""Streaming jobs run to the end of the data they find."""

import uuid

from pyspark.sql import functions as F

from ..functions.text import fingerprint
from ..registry import query
from ..session import shared_folder
from ..streaming import jobs as J


def _stream(t, name):
    """A pattern, as a stream takes no single file; it also meets a table that is a folder of files."""
    schema = t.spark.read.parquet(f"{t.folder}/{name}.parquet").schema
    return t.spark.readStream.schema(schema).parquet(f"{t.folder}/{name}.parque[t]")


def _places(t):
    base = f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"
    return base + "/out", base + "/check"


def _tasks(t):
    e = F.col("event_type")
    s = F.when(e == "view", "done").when(e == "click", "converting").when(e == "error", "error").otherwise("pending")
    return _stream(t, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("task"), s.alias("status"))


@query("stream_ingest", "T1 K1", "SELECT substr(sha256(source || chr(0) || n_chars), 1, 12) AS id, source AS scope, CAST(n_chars AS INTEGER) AS idx FROM documents GROUP BY source, n_chars")
def _(t):
    out, check = _places(t)
    batch = _stream(t, "documents").select(F.col("source").alias("scope"), F.col("n_chars").cast("int").alias("idx"))
    J.start_ingest(batch, out, check).awaitTermination()
    return t.spark.read.parquet(out).select("id", "scope", "idx")


@query("stream_distinct_texts", "T2", "SELECT md5(text) AS fingerprint FROM (SELECT lower(regexp_replace(event_type || props, '[^a-zA-Z0-9]', '', 'g')) AS text FROM events) GROUP BY 1")
def _(t):
    out, check = _places(t)
    rows = _stream(t, "events").select(F.col("ts").cast("timestamp").alias("ts"), fingerprint(F.concat("event_type", "props")).alias("fingerprint"))
    J.run_to_table(J.distinct_in_window(rows, late="3650 days"), out, check)
    return t.spark.read.parquet(out).select("fingerprint")


@query("stream_latest_state", "T3", """SELECT user_id AS task, arg_max(CASE event_type WHEN 'view' THEN 'done' WHEN 'click' THEN 'converting' WHEN 'error' THEN 'error' ELSE 'pending' END, (ts, event_id)) AS status FROM events GROUP BY 1""")
def _(t):
    out, check = _places(t)
    J.run_to_table(J.latest_state(_tasks(t)), out, check, "update")
    done = t.spark.read.parquet(out)
    return done.groupBy("task").agg(F.max_by("status", "batch").alias("status"))


@query("stream_window_counts", "T5", """WITH m AS (SELECT max(ts) - INTERVAL 1 HOUR AS w FROM events) SELECT epoch_ms(date_trunc('hour', ts)) // 1000 AS start_s, CASE event_type WHEN 'view' THEN 'done' WHEN 'click' THEN 'converting' WHEN 'error' THEN 'error' ELSE 'pending' END AS status,
 count(*) AS events FROM events, m WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= w GROUP BY 1, 2""")
def _(t):
    out, check = _places(t)
    J.run_to_table(J.window_counts(_tasks(t)), out, check)
    return t.spark.read.parquet(out).select(F.unix_seconds("start").alias("start_s"), "status", "events")


@query("stream_stale_tasks", "T4")
def _(t):
    out, check = _places(t)
    J.run_to_table(J.stale_tasks(_tasks(t)), out, check)
    return t.spark.read.schema("task long, status string, last_ms long").parquet(out)
