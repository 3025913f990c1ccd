"""Queries on the call log and the event stream; the event windows are extras of this engine."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillgrain.session import shared_dir, table
from quillgrain.streaming import log as S

from .registry import query

CALLS = "calls as (select log_id, any_value(logged_at) as logged_at, any_value(model_type) as model_type, any_value(json_valid) as json_valid from call_log group by 1)"
WINDOWS = f"with {CALLS} select date_trunc('day', logged_at)::timestamp as window_start, model_type, count(*)::bigint as n, count(*) filter (where coalesce(json_valid, false))::bigint as n_valid from calls group by all"
COLUMNS = ("log_id", "logged_at", "model_type", "json_valid")


def _calls(spark, sf_dir):
    return table(spark, sf_dir, "call_log").select(*COLUMNS).withColumn("logged_at", F.col("logged_at").cast("timestamp"))


@query(WINDOWS)
def q_call_log_windows(spark, sf_dir):
    """Valid replies a day and model; a call counts once however often it was delivered."""
    return S.validity_windows(_calls(spark, sf_dir).dropDuplicates(["log_id"])).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(WINDOWS)
def q_call_log_stream(spark, sf_dir):
    """The same from a stream over the log's files, run to the end."""
    path = f"{sf_dir}/call_log.parquet"
    schema = spark.read.parquet(path).schema
    calls = S.read_calls(spark, path, schema).select(*COLUMNS).withColumn("logged_at", F.col("logged_at").cast("timestamp"))
    at = f"{shared_dir(spark).rstrip('/')}/call-log-{uuid.uuid4().hex}"
    return S.run_to_end(S.validity_windows(S.once_per_call(calls)), f"{at}/out", f"{at}/checkpoint").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("select event_type, time_bucket(interval '1 hour', ts)::timestamp as window_start, count(*)::bigint as n, round(sum(value), 4) as total from events where ts is not null group by all")
def q_event_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).where("ts is not null")
    w = e.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n", "total")


@query("""with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval '30 minutes' then 0 else 1 end as fresh from events where ts is not null),
s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as no from g) select user_id, min(ts) as session_start, count(*)::bigint as n from s group by user_id, no""")
def q_event_sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).where("ts is not null")
    return e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("session_start"), "n")
