"""Jobs, events and conversations as tables: states from change logs, claims, retries, retention."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TERMINAL = ("completed", "failed", "cancelled")
#: States of jobs that run or are to run, what an interrupted one says, and keys whose values are content.
ACTIVE = ("processing", "running", "queued", "started")
INTERRUPTED = "Server di-restart saat analisis berjalan"
SENSITIVE = ("content", "document", "documents", "message", "messages", "prompt", "query", "raw", "response", "text", "traceback")


def latest(log: DataFrame, key: str, revision: str) -> DataFrame:
    """The row of each key with the highest revision. Rows of one key are summed up in each task first."""
    return log.groupBy(key).agg(F.max(F.struct(revision, *[c for c in log.columns if c not in (key, revision)])).alias("l")).select(key, "l.*")


def next_job(jobs: DataFrame, now: Column) -> DataFrame:
    ready = jobs.filter((F.col("status") == "queued") & ~F.coalesce("cancel_requested", F.lit(False)) & (F.coalesce("available_at", now) <= now) & (F.col("attempt") < F.col("max_attempts")))
    return ready.orderBy("created_at", "job_id").limit(1)


def retry_delay(attempt: Column) -> Column:
    return F.least(F.lit(60.0), F.pow(F.lit(2.0), F.greatest(F.lit(0), attempt - 1)))


def after_restart(jobs: DataFrame) -> DataFrame:
    """Running jobs are queued again, or cancelled if that was asked for."""
    running = F.col("status").isin("running", "processing")
    return jobs.withColumn("status", F.when(running & F.coalesce("cancel_requested", F.lit(False)), "cancelled").when(running, "queued").otherwise(F.col("status")))


def by_status(jobs: DataFrame, *statuses: str) -> DataFrame:
    return jobs.filter(F.col("status").isin(*statuses)).orderBy(F.desc("created_at"), "job_id")


def events_after(events: DataFrame, cursor: int) -> DataFrame:
    return events.filter(F.col("event_id") > cursor).orderBy("event_id")


def changes(log: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows where value differs from the row before of the same key, with the value before."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    return log.withColumn("before", before).filter(F.col("before").isNull() | (F.col("before") != F.col(value)))


def last_messages(messages: DataFrame, n: int = 10, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last n messages of each conversation, with their place in time order."""
    last = messages.withColumn("back", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter(F.col("back") <= n)
    return last.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(order))).drop("back")


def retention(rows: DataFrame, time: str, keep_until: Column) -> tuple[DataFrame, DataFrame]:
    """(what stays, how many go)."""
    gone = F.col(time) < keep_until
    return rows.filter(~gone), rows.agg(F.count_if(gone).alias("removed"))


def sanitised(payload: Column, sensitive: tuple[str, ...] = SENSITIVE, most: int = 160) -> Column:
    """A map without sensitive keys, values cut to most characters."""
    return F.transform_values(F.map_filter(payload, lambda k, _: ~F.lower(k).isin(*sensitive)), lambda _, v: F.substring(v, 1, most))


def sanitised_json(payload: Column, sensitive: tuple[str, ...] = SENSITIVE, most: int = 160) -> Column:
    """A JSON object at any depth without sensitive keys: strings cut, lists as their lengths. What is no object is null.

    Built-in functions don't recurse, so texts go by Arrow batches.
    """

    def safe(value: object) -> object:
        if isinstance(value, dict):
            return {k: safe(v) for k, v in value.items() if k.lower() not in sensitive}
        if isinstance(value, list):
            return len(value)
        return value[:most] if isinstance(value, str) else value

    def one(text: str | None) -> str | None:
        try:
            value = json.loads(text or "null")
        except ValueError:
            return None
        return json.dumps(safe(value), ensure_ascii=False) if isinstance(value, dict) else None

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return clean(payload)


def conversation(messages: DataFrame, now: Column, ttl_seconds: int, n: int = 10) -> DataFrame:
    """The last n messages of conversations that haven't expired: each message renews the time to live."""
    live = messages.groupBy("conversation_id").agg(F.max("created_at").alias("t")).filter(F.col("t") + F.make_dt_interval(secs=F.lit(ttl_seconds)) > now).select("conversation_id")
    return last_messages(messages.join(live, "conversation_id", "left_semi"), n, "conversation_id", "message_id")


def request_log(requests: DataFrame) -> DataFrame:
    """request_id (made where there is none), event, method, path, status, duration_ms of requests (request_id, method, path, status, started, ended).

    A request without a status has failed. No header or body is kept.
    """
    made = F.md5(F.concat_ws("|", "method", "path", F.col("started").cast("string")))
    ms = F.floor((F.unix_micros(F.col("ended").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))) / 1000).cast("long")
    event = F.when(F.col("status").isNull(), "request_failed").otherwise("request_completed")
    return requests.select(F.coalesce("request_id", made).alias("request_id"), event.alias("event"), "method", "path", "status", ms.alias("duration_ms"))


def legacy_jobs(raw: DataFrame, col: str = "raw", active: tuple[str, ...] = ACTIVE, status: str = "queued", message: str = INTERRUPTED) -> DataFrame:
    """job_id, status, message, error, payload of stores that are one JSON object of jobs; active ones are to run again. What is no object has no jobs."""
    jobs = F.from_json(col, "map<string,string>")
    rows = raw.select(F.explode(jobs).alias("job_id", "payload")).filter(F.ltrim("payload").startswith("{"))
    one = rows.withColumn("j", F.from_json("payload", "struct<status:string,message:string,error:string>"))
    running = F.col("j.status").isin(*active)
    return one.select("job_id", F.when(running, status).otherwise(F.col("j.status")).alias("status"), F.when(running, message).otherwise(F.col("j.message")).alias("message"), F.when(~F.coalesce(running, F.lit(False)), F.col("j.error")).alias("error"), "payload")
