"""Web access logs with a session field, as all-string tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: host, identity, time, request, status, bytes, referer, session, user agent.
LINE = r'^(\S+) (\S+) \[([^\]]+)\] "([^"]*)" (\S+) (\S+) "([^"]*)" (\S+) "([^"]*)"$'


def read_access_log(spark: SparkSession, path: str) -> DataFrame:
    """timestamp, method, path, status, bytes, referer, session_id, user_agent; lines of another form or without a session are left out."""
    line = F.trim("value")
    part = lambda i: F.regexp_extract(line, LINE, i)
    word = lambda i: F.coalesce(F.get(F.filter(F.split("request", r"\s+"), lambda w: w != ""), F.lit(i)), F.lit(""))
    parsed = spark.read.text(path).filter(line.rlike(LINE)).select(part(3).alias("timestamp"), part(4).alias("request"), part(5).alias("status"), part(6).alias("bytes"), part(7).alias("referer"), part(8).alias("session_id"), part(9).alias("user_agent"))
    sent = F.when(F.col("bytes") == "-", "").otherwise(F.col("bytes")).alias("bytes")
    return parsed.filter("session_id <> '-'").select("timestamp", word(0).alias("method"), word(1).alias("path"), "status", sent, "referer", "session_id", "user_agent")
