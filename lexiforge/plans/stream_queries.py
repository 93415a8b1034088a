"""Streams run over the events table as far as it goes, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.plans.query import query, table
from lexiforge.store import shared_dir
from lexiforge.streaming import stateful as X
from lexiforge.streaming import streams as S

_EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def _run(stream: DataFrame, mode: str) -> DataFrame:
    """All rows that a stream gives until its source is read, from a table in the shared folder."""
    spark = stream.sparkSession
    out = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    kind = "overwrite" if mode == "complete" else "append"
    q = stream.writeStream.outputMode(mode).foreachBatch(lambda b, i: b.withColumn("batch", F.lit(i)).write.mode(kind).parquet(f"{out}/data")).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{out}/data")


def _source(spark: SparkSession, d: str) -> DataFrame:
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 12 HOUR AS ended, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, session"""
)
def q_stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    stream = _source(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    return _run(S.session_counts(stream, "user_id", "ts", "12 hours"), "complete").select("user_id", "started", "ended", "n")


@query("SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id, max_by(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def q_stream_latest_state(spark: SparkSession, d: str) -> DataFrame:
    changes = _source(spark, d).select("user_id", "event_id", "value", "ts")
    return _run(S.latest_state(changes, "user_id", "ts", "event_id"), "complete").select("user_id", "event_id", "value")


_PASSED = "ceil(epoch_us(ts) / 1000.0) < (SELECT floor(epoch_us(max(ts)) / 1000.0) - 600000 FROM events)"  # what the watermark has passed


@query(
    f"""WITH g AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w > 3600000000 THEN 1 ELSE 0 END AS new FROM events WHERE {_PASSED} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id::VARCHAR)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id::VARCHAR ROWS UNBOUNDED PRECEDING) AS session FROM g)
    SELECT user_id, t AS ts, string_agg(event_type, ' ') OVER (PARTITION BY user_id, session ORDER BY t, event_id::VARCHAR ROWS 4 PRECEDING) AS history FROM s"""
)
def q_stream_history(spark: SparkSession, d: str) -> DataFrame:
    """The last five events of a user's session after each event that the watermark has passed."""
    turns = _source(spark, d).select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("text"), "event_id")
    got = _run(X.session_history(turns, "user_id", tie="event_id", ttl_ms=3_600_000, most=5), "append")
    return got.select("user_id", "ts", F.array_join("history", " ").alias("history"))


#: The state machine of a chat, one event of every user a step: versions and prompts of the turns 0 to 99, and the pending one.
_TURNS = f"""WITH RECURSIVE e AS (
  SELECT user_id, epoch_us(ts) AS t, event_id::VARCHAR AS id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, event_type AS text,
    CASE event_type WHEN 'purchase' THEN 'complete' WHEN 'signup' THEN 'fail' WHEN 'error' THEN 'retry' ELSE 'start' END AS kind,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id::VARCHAR) AS n FROM events WHERE {_PASSED}),
s AS (
  SELECT user_id, 0::BIGINT AS n, NULL::INTEGER AS pending, NULL::BIGINT AS started, list_transform(range(100), lambda x: 0) AS vers, list_transform(range(100), lambda x: NULL::VARCHAR) AS prompts,
    NULL::BIGINT AS t, NULL::VARCHAR AS id, NULL::INTEGER AS turn, NULL::INTEGER AS version, NULL::VARCHAR AS outcome, NULL::BIGINT AS x_at, NULL::INTEGER AS x_turn, NULL::INTEGER AS x_version
  FROM e WHERE n = 1
  UNION ALL
  SELECT user_id, n, CASE WHEN outcome IN ('CREATED', 'RETRIED') THEN k WHEN outcome IN ('COMPLETED', 'FAILED') THEN NULL ELSE p END, CASE WHEN outcome IN ('CREATED', 'RETRIED') THEN t ELSE started END,
    CASE WHEN outcome IN ('CREATED', 'RETRIED') THEN list_transform(vers, lambda v, i: CASE WHEN i = k + 1 THEN v + 1 ELSE v END) ELSE vers END,
    CASE WHEN outcome = 'CREATED' THEN list_transform(prompts, lambda v, i: CASE WHEN i = k + 1 THEN text ELSE v END) ELSE prompts END,
    t, id, CASE WHEN outcome IN ('COMPLETED', 'FAILED') THEN p WHEN outcome = 'IGNORED' OR (kind = 'start' AND outcome = 'CHAT_BUSY') THEN NULL ELSE k END,
    CASE WHEN outcome IN ('COMPLETED', 'FAILED') THEN vers[p + 1] WHEN outcome IN ('IGNORED', 'UNKNOWN_TURN') OR (kind = 'start' AND outcome = 'CHAT_BUSY') THEN NULL WHEN outcome IN ('CREATED', 'RETRIED') THEN vers[k + 1] + 1 ELSE vers[k + 1] END,
    outcome, CASE WHEN pending IS NOT NULL AND p IS NULL THEN started + 21600000000 END, CASE WHEN p IS NULL THEN pending END, CASE WHEN p IS NULL THEN vers[pending + 1] END
  FROM (
    SELECT *, CASE WHEN kind = 'start' THEN CASE WHEN prompts[k + 1] = text THEN 'REPLAYED' WHEN prompts[k + 1] IS NOT NULL THEN 'REQUEST_CONFLICT' WHEN p IS NOT NULL THEN 'CHAT_BUSY' ELSE 'CREATED' END
      WHEN kind = 'retry' THEN CASE WHEN vers[k + 1] = 0 THEN 'UNKNOWN_TURN' WHEN p IS NOT NULL THEN 'CHAT_BUSY' ELSE 'RETRIED' END
      WHEN p IS NULL THEN 'IGNORED' WHEN kind = 'complete' THEN 'COMPLETED' ELSE 'FAILED' END AS outcome
    FROM (SELECT e.*, s.pending, s.started, s.vers, s.prompts, CASE WHEN s.started + 21600000000 >= e.t THEN s.pending END AS p FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1) j) o),
l AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1)
SELECT user_id, t AS "at", id, turn::VARCHAR AS turn, version::BIGINT AS version, outcome FROM s WHERE n > 0
UNION ALL SELECT user_id, x_at, NULL, x_turn::VARCHAR, x_version::BIGINT, 'INTERRUPTED' FROM s WHERE x_at IS NOT NULL
UNION ALL SELECT user_id, started + 21600000000, NULL, pending::VARCHAR, vers[pending + 1]::BIGINT, 'INTERRUPTED' FROM l
  WHERE pending IS NOT NULL AND started + 21600000000 < (SELECT floor(epoch_us(max(ts)) / 1000.0) - 600001 FROM events) * 1000"""


@query(_TURNS)
def q_stream_turns(spark: SparkSession, d: str) -> DataFrame:
    """Events as requests, retries and answers of each user's chat, with what becomes of every one of them."""
    e = _source(spark, d)
    kinds = F.when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "signup", "fail").when(F.col("event_type") == "error", "retry").otherwise("start")
    k, none = F.get_json_object("props", "$.k"), F.lit(None).cast("string")
    rows = e.select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"), kinds.alias("kind"), F.when(kinds == "retry", k).otherwise(none).alias("turn"),
                    F.when(kinds == "start", k).when(kinds == "retry", F.concat(F.lit("r"), F.col("event_id"))).alias("request"), F.lit(None).cast("bigint").alias("version"), F.col("event_type").alias("text"))
    return _run(X.chat_turns(rows, "user_id", expiry_ms=21_600_000, keep_ms=10**12), "append").drop("batch")


@query(
    """WITH a AS (SELECT user_id AS subscription_id, event_id AS document_id, event_type AS topic_id, value / 100 AS score, epoch_us(ts) AS created_at FROM events WHERE event_id % 3 = 0),
    f AS (SELECT user_id AS subscription_id, event_id - event_id % 3 AS document_id, epoch_us(ts) AS ts, CASE WHEN event_id % 21 = 1 THEN 'read_all' WHEN event_id % 3 = 1 THEN 'read' ELSE 'dismiss' END AS kind FROM events WHERE event_id % 3 > 0),
    r AS (SELECT a.*, (SELECT min(ts) FROM f WHERE f.subscription_id = a.subscription_id AND f.document_id = a.document_id AND kind = 'read') AS own,
      (SELECT max(ts) FROM f WHERE f.subscription_id = a.subscription_id AND kind = 'read_all') AS whole, (SELECT min(ts) FROM f WHERE f.subscription_id = a.subscription_id AND f.document_id = a.document_id AND kind = 'dismiss') AS dismissed_at FROM a),
    t AS (SELECT topic_id, greatest(0.6, max(score) + 0.01) AS threshold FROM r WHERE dismissed_at IS NOT NULL GROUP BY topic_id)
    SELECT subscription_id, document_id, CASE WHEN whole >= created_at THEN least(own, whole) ELSE own END AS read_at, dismissed_at, round(coalesce(threshold, 0.6), 6) AS threshold FROM r LEFT JOIN t USING (topic_id)"""
)
def q_stream_feedback(spark: SparkSession, d: str) -> DataFrame:
    """A stream of reading and dismissing merged into alerts and thresholds; every third event is an alert, the others say what
    its readers did."""
    at, n = F.unix_micros(F.col("ts").cast("timestamp")), F.col("event_id")
    kinds = F.when(n % 21 == 1, "read_all").when(n % 3 == 1, "read").otherwise("dismiss")
    events = _source(spark, d).where(n % 3 > 0).select(n, F.col("user_id").alias("subscription_id"), F.when(kinds != "read_all", n - n % 3).alias("document_id"), at.alias("ts"), kinds.alias("kind"))
    out = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    X.collect_feedback(events, f"{out}/feedback", f"{out}/checkpoint").awaitTermination()
    alerts = table(spark, d, "events").where(n % 3 == 0).select(F.col("user_id").alias("subscription_id"), n.alias("document_id"), F.col("event_type").alias("topic_id"), (F.col("value") / 100).alias("score"), at.alias("created_at"))
    topics = alerts.select("topic_id").distinct().withColumn("min_score", F.lit(0.6))
    rows, after = X.with_feedback(alerts, topics, X.read_feedback(spark, f"{out}/feedback"))
    return rows.join(after, "topic_id").select("subscription_id", "document_id", "read_at", "dismissed_at", F.round("min_score", 6).alias("threshold"))
