"""Streams: incremental collection, alert scans, session histories, turn lifecycles, latest state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexiforge.streaming.stateful import new_alerts


def read_stream(spark: SparkSession, folder: str, name: str, schema: str, per_trigger: int | None = None) -> DataFrame:
    """Files of a folder whose name fits, as they land."""
    r = spark.readStream.schema(schema).option("pathGlobFilter", name)
    return (r.option("maxFilesPerTrigger", per_trigger) if per_trigger else r).parquet(folder)


def fingerprint(params: dict[str, object]) -> str:
    """One id for a set of collection filters, whatever their order."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()


def next_start(marks: DataFrame, filters: str, overlap_s: int = 300) -> DataFrame:
    """One row: where the next run of these filters starts, the mark less the overlap; no row if they never completed."""
    return marks.where(F.col("fingerprint") == filters).groupBy("fingerprint").agg((F.max("mark") - F.make_dt_interval(secs=F.lit(float(overlap_s)))).alias("start"))


def collect_batch(batch: DataFrame, store: str, key: str = "id", ts: str = "updated_at") -> None:
    """Append what the store does not have (by id and content hash): replays of the overlap add nothing, nor does a batch that
    runs again.

    Of the store only rows from the batch's own span of time are read: equal content has equal times.
    """
    spark, rows = batch.sparkSession, batch.dropDuplicates([key, "content_hash"])
    try:
        old = spark.read.schema(rows.schema).parquet(store)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    else:
        span = batch.agg(F.min(ts).alias("a"), F.max(ts).alias("b")).first()
        old = old.where(F.col(ts).isNull() if span["a"] is None else F.col(ts).isNull() | F.col(ts).between(F.lit(span["a"]), F.lit(span["b"])))
        rows = rows.join(old.select(key, "content_hash"), [key, "content_hash"], "left_anti").select(*rows.columns)
    rows.write.mode("append").parquet(store)


def commit_marks(spark: SparkSession, marks: str, filters: str, run: str) -> object:
    """Make the greatest mark of a run's batches the mark of its filters, once all of them are stored; the mark, None if there is
    none. One row under a name of its own: done twice it is the same row."""
    try:
        pending = spark.read.option("basePath", f"{marks}-pending").parquet(f"{marks}-pending/run={run}").where("mark is not null")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    last = pending.agg(F.max("batch").alias("batch"), F.max("mark").alias("mark")).first()
    if last["mark"] is not None:
        pending.agg(F.lit(filters).alias("fingerprint"), F.max("mark").alias("mark")).write.mode("overwrite").parquet(f"{marks}/run={run}/batch={last['batch']}")
    return last["mark"]


def collect_incremental(stream: DataFrame, store: str, marks: str, filters: str, checkpoint: str, key: str = "id", ts: str = "updated_at", *, overlap: str = "5 minutes") -> StreamingQuery:
    """Collect everything that has landed since the last run into the store, then advance the mark of the filters.

    What lands again within the overlap is dropped by the stream's own state (id and content hash, by the time of landing, so
    nothing is late however old it is); what comes again later is found in the store. Every batch notes its mark as
    pending; the mark itself advances by one row when the run has ended well. A run that dies leaves the old mark, and the
    next one goes on from its checkpoint, with the pending marks of the batches that it does not see again.
    """
    rows = stream.withColumn("content_hash", F.sha2(F.to_json(F.struct(*stream.columns)), 256)).withColumn("_landed", F.current_timestamp())
    rows = rows.withWatermark("_landed", overlap).dropDuplicatesWithinWatermark([key, "content_hash"])
    run = fingerprint({"checkpoint": checkpoint, "filters": filters})[:16]

    def put(batch: DataFrame, number: int) -> None:
        collect_batch(batch.drop("_landed"), store, key, ts)
        batch.agg(F.max(ts).alias("mark")).write.mode("overwrite").parquet(f"{marks}-pending/run={run}/batch={number}")

    query = rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    commit_marks(stream.sparkSession, marks, filters, run)
    return query


def scan_alerts(feed: DataFrame, topics: DataFrame, scores: Callable[[DataFrame], DataFrame], alerts: str, checkpoint: str, *, limit: int = 2, default: float = 0.6, once: bool = True) -> StreamingQuery:
    """Every batch of new documents is scored against all topics; each subscription gets at most `limit` documents that it
    never got (stateful.new_alerts), written under alerts as part=<batch>, which a batch that runs again replaces. scores
    makes scores or word hits of the stream, row by row. Without `once` it runs every two minutes."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{alerts}/part={number}")

    w = new_alerts(scores(feed), topics, limit=limit, default=default).writeStream.foreachBatch(put).outputMode("append").option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="2 minutes")).start()


def session_counts(events: DataFrame, key: str, ts: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions of each key that end after a gap without events; works on a stream and on a table."""
    s = events.withWatermark(ts, late) if events.isStreaming else events
    return s.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def _fold_turn(row: dict | None, e: dict, expiry_ms: int) -> dict | None:
    """The turn after an event: start, retry, complete, fail or tick, with its attempt's version."""
    if row and row["status"] == "PENDING" and e["ts"] > row["started"] + expiry_ms:
        row = row | {"status": "FAILED", "error": "GENERATION_INTERRUPTED"}
    if e["kind"] in ("start", "retry"):
        if row is None or (row["status"] != "PENDING" and e["version"] > row["version"]):
            return {"version": e["version"], "status": "PENDING", "text": None, "error": None, "started": e["ts"]}
    elif row and e["kind"] in ("complete", "fail") and row["status"] == "PENDING" and e["version"] == row["version"]:
        return row | ({"status": "COMPLETED", "text": e["text"]} if e["kind"] == "complete" else {"status": "FAILED", "error": e["text"]})
    return row


def turn_lifecycle(events: DataFrame, key: str, *, expiry_ms: int = 300_000, now_ms: int | None = None, keep_ms: int = 86_400_000, late: str = "10 minutes") -> DataFrame:
    """The current row of each turn: PENDING, COMPLETED or FAILED. An attempt that outlives its five minutes becomes FAILED
    with GENERATION_INTERRUPTED, whether or not its reply comes; replies of an old version change nothing; a retry needs a turn
    that is over.

    events: key, ts (epoch milliseconds), kind, version, text. On a table now_ms is the time at which silent turns are judged
    (none: they stay pending). On a stream the watermark is: a turn's row is emitted after each batch that brings it events,
    and again when its time runs out; a turn that is over is forgotten keep_ms after its last event.
    """
    kind = events.schema[key].dataType.simpleString()
    names = ["version", "status", "text", "error", "started"]
    out = f"{key} {kind}, version bigint, status string, text string, error string, started bigint"

    def run(k: tuple, f: pd.DataFrame, row: dict | None) -> dict | None:
        for e in f.sort_values(["ts", "version"], kind="stable").to_dict("records"):
            row = _fold_turn(row, e, expiry_ms)
        return row

    if not events.isStreaming:

        def whole(k: tuple, f: pd.DataFrame) -> pd.DataFrame:
            row = run(k, f, None)
            if row is not None and now_ms is not None:
                row = _fold_turn(row, {"kind": "tick", "ts": now_ms, "version": None}, expiry_ms)
            return pd.DataFrame([] if row is None else [(k[0], *[row[n] for n in names])], columns=[key, *names])

        return events.select(key, "ts", "kind", "version", "text").groupBy(key).applyInPandas(whole, out)

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *held, last = state.get if state.exists else (*[None] * len(names), 0)
        row = dict(zip(names, held, strict=True)) if held[1] is not None else None
        if state.hasTimedOut:
            if row is None or row["status"] != "PENDING":
                state.remove()
                return
            row = row | {"status": "FAILED", "error": "GENERATION_INTERRUPTED"}
        else:
            f = pd.concat(list(frames))
            row, last = run(k, f, row), max(last, int(f["ts"].max()))
        state.update((*[row[n] if row else None for n in names], last))
        due = row["started"] + expiry_ms + 1 if row and row["status"] == "PENDING" else last + keep_ms
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        if row is not None:
            yield pd.DataFrame([(k[0], *[row[n] for n in names])], columns=[key, *names])

    rows = events.withColumn("_at", F.timestamp_millis("ts")).withWatermark("_at", late).select(key, "_at", "ts", "kind", "version", "text")
    held = "version bigint, status string, text string, error string, started bigint, last bigint"
    return rows.groupBy(key).applyInPandasWithState(step, out, held, "update", GroupStateTimeout.EventTimeTimeout)


def latest_state(changes: DataFrame, key: str, *order: str) -> DataFrame:
    """The current row of each key of a change log, for tables and for streams in update mode."""
    rest = [c for c in changes.columns if c != key]
    return changes.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, "_r.*")


def embed_missing(texts: DataFrame, stored: DataFrame, embed: Callable[[list[str]], list[list[float]]], model: str, *, mock: bool = False, size: int = 64) -> DataFrame:
    """Rows (text_hash, model, mock, embedding, error) of texts without a vector stored for their hash, model and kind.

    Texts go to embed `size` at a time; where that fails each of them goes alone, and one that fails has an error and no vector.
    stored may lack the column mock: its vectors are real ones then.
    """
    have = stored if "mock" in stored.columns else stored.withColumn("mock", F.lit(False))
    have = have.where((F.col("model") == model) & (F.col("mock") == F.lit(mock)) & F.col("embedding").isNotNull()).select("text_hash")
    need = texts.select("text_hash", "text").dropDuplicates(["text_hash"]).join(have, "text_hash", "left_anti")

    def one(t: str) -> tuple[list[float] | None, str | None]:
        try:
            return embed([t])[0], None
        except Exception as e:  # one text's failure stays its own
            return None, str(e)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for lo in range(0, len(f), size):
                part = f.iloc[lo : lo + size]
                try:
                    vectors = embed(part["text"].tolist())
                    if len(vectors) != len(part):
                        raise ValueError("one vector for each text is asked for")
                    got = [(v, None) for v in vectors]
                except Exception:
                    got = [one(t) for t in part["text"]]
                yield pd.DataFrame({"text_hash": part["text_hash"].tolist(), "model": model, "mock": mock, "embedding": [v for v, _ in got], "error": [e for _, e in got]})

    return need.mapInPandas(run, "text_hash string, model string, mock boolean, embedding array<float>, error string")


def progress(df: DataFrame, name: str, done: Column) -> DataFrame:
    """df with observed counts: total rows and those done; read them with a Progress of that name."""
    return df.observe(name, F.count("*").alias("total"), F.count_if(done).alias("done"))


def observed(df: DataFrame, name: str, done: Column) -> tuple[DataFrame, Observation]:
    """As progress, for a table: the counts are in the observation once an action on df has ended."""
    seen = Observation(name)
    return df.observe(seen, F.count("*").alias("total"), F.count_if(done).alias("done")), seen


PROGRESS = "name string, batch bigint, seconds double, done bigint, failed bigint, total bigint, rate double, eta double"


def progress_row(name: str, batch: int, seconds: float, done: int, failed: int, total: int) -> tuple:
    """(name, batch, seconds, done, failed, total, rate, eta): rows gone through a second, and the seconds that the rest of total
    takes at that rate; null while nothing is known of it."""
    through = done + failed
    rate = through / seconds if seconds > 0 and through else None
    return name, batch, seconds, done, failed, total, rate, max(0, total - through) / rate if rate else None


class Progress(StreamingQueryListener):
    """Turns what progress() observes in a stream into rows: one a batch with rows, all batches so far counted together.

    total is how many rows are expected in all; unknown, it is those seen. Add it with spark.streams.addListener before the
    query starts; a query that ends in an error has it in failure. Batch actions give their row by of_table."""

    def __init__(self, name: str, total: int | None = None):
        self.name, self.total, self.rows, self.failure = name, total, [], None
        self._done = self._seen = 0
        self._seconds = 0.0

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        pass

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        got = event.progress.observedMetrics.get(self.name)
        self._seconds += event.progress.batchDuration / 1000
        if got is not None and got["total"]:
            self._done, self._seen = self._done + got["done"], self._seen + got["total"]
            self.rows.append(progress_row(self.name, event.progress.batchId, self._seconds, self._done, self._seen - self._done, max(self.total or 0, self._seen)))

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        self.failure = event.exception

    def of_table(self, seen: Observation, seconds: float) -> None:
        got = seen.get
        self._done, self._seen, self._seconds = self._done + got["done"], self._seen + got["total"], self._seconds + seconds
        self.rows.append(progress_row(self.name, len(self.rows), self._seconds, self._done, self._seen - self._done, max(self.total or 0, self._seen)))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, PROGRESS)
