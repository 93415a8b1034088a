"""Streams with state of their own: rows of a key are taken in order of time, whatever the micro-batches they come in.

All of these need the RocksDB state store (use_rocksdb): state is kept on disk, key by key, and checkpointed by its changes.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


_LOT = 256  # rows or entries that one value of a state may hold: every call of a state crosses over to the JVM and back


class InOrder(StatefulProcessor):
    """Holds rows in a ListState until the watermark has passed them, then hands them on in order of time.

    Spark drops what comes behind the watermark, so nothing can still come before a row that it has passed: results do not
    depend on how rows are dealt out over micro-batches. One timer a key wakes it for its earliest row, or for what the
    subclass waits for. Rows are tuples of whole numbers and strings whose first field is the time in microseconds; ties go
    by the other fields. They wait in lots, as JSON.
    """

    def __init__(self, names: list[str], out: list[str]):
        self.names, self.out = names, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "lot string")
        self.due = handle.getValueState("due", "at bigint")
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def release(self, key: tuple, rows: list[tuple], until: int) -> tuple[list[tuple], int | None]:
        """The output rows for the rows of a key up to a time, and when (in milliseconds) to wake next without new rows."""
        raise NotImplementedError

    def _wake(self, at: int | None, held: int | None) -> None:
        """Sets the timer of a key, which stands at `held`."""
        if held is not None and at != held:
            self.handle.deleteTimer(held)
        if at is not None and at != held:
            self.handle.registerTimer(at)
            self.due.update((at,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        if not (new := [r for f in rows for r in _tuples(f, self.names)]):
            return iter(())
        self.waiting.appendList(_lots(new))
        first, due = _millis(min(r[0] for r in new)), self.due.get()
        if due is None or first < due[0]:
            self._wake(first, due and due[0])
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() - 1  # a timer fires once the watermark is over its time
        rows = sorted((tuple(r) for lot in self.waiting.get() for r in json.loads(lot[0])), key=_order)
        ready = [r for r in rows if _millis(r[0]) <= passed]
        rest = rows[len(ready) :]
        if ready:
            self.waiting.put(_lots(rest)) if rest else self.waiting.clear()
        out, wake = self.release(key, ready, passed * 1000)
        times = ([_millis(rest[0][0])] if rest else []) + ([wake] if wake is not None else [])
        if times:
            self._wake(max(min(times), passed + 1), None)  # this timer is gone
        else:
            self.due.clear()
        if out:
            yield pd.DataFrame(out, columns=self.out)

    def close(self) -> None:
        pass


def _tuples(f: pd.DataFrame, names: list[str]) -> Iterable[tuple]:
    whole = lambda v: None if v is None or v != v else int(v) if isinstance(v, float) else v  # noqa: E731  # a column with gaps has floats
    return zip(*([whole(v) for v in f[n].tolist()] for n in names), strict=True)


def _lots(rows: list[tuple]) -> list[tuple[str]]:
    return [(json.dumps(rows[i : i + _LOT], ensure_ascii=False, separators=(",", ":")),) for i in range(0, len(rows), _LOT)]


def _millis(micros: int) -> int:
    return -(-micros // 1000)


def _order(row: tuple) -> tuple:
    return tuple((v is not None, v if v is not None else 0) for v in row)


# ---------------------------------------------------------------- session histories


class _Histories(InOrder):
    def __init__(self, ttl_us: int, most: int, key: str):
        super().__init__(["at", "tie", "text"], [key, "ts", "history"])
        self.ttl_us, self.most = ttl_us, most

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at bigint, held array<string>")

    def release(self, key: tuple, rows: list[tuple], until: int) -> tuple[list[tuple], int | None]:
        last, held = self.last.get() or (None, [])
        out = []
        for at, _, text in rows:
            if last is not None and at - last > self.ttl_us:
                held = []
            held, last = [*held, text][-self.most :], at
            out.append((key[0], at, list(held)))
        if last is None or until - last > self.ttl_us:
            self.last.clear()
            return out, None
        if rows:
            self.last.update((last, held))
        return out, _millis(last + self.ttl_us) + 1


def session_history(turns: DataFrame, key: str, *, tie: str | None = None, ttl_ms: int = 1_800_000, most: int = 20, late: str = "10 minutes") -> DataFrame:
    """Rows (key, ts, history): after each message of a chat its last `most` messages; a chat idle for more than ttl starts anew.

    turns: key, ts (a timestamp), text; tie is a column that orders messages of one time, before their text. ts comes out in
    microseconds. On a stream a message counts once the watermark, `late` behind the newest message, has passed it; then
    its chat's earlier messages are all there, so the histories are those of the table of all messages that came in time.
    State is the messages the watermark has not passed and one bounded list a chat, dropped by a timer once the chat is
    idle for ttl. On a table the same rows come from window functions.
    """
    order = F.col(tie).cast("string") if tie else F.lit(None).cast("string")
    rows = turns.select(F.col(key), F.col("ts").alias("_ts"), F.unix_micros("ts").alias("at"), order.alias("tie"), "text")
    if not turns.isStreaming:
        w = W.partitionBy(key).orderBy("at", "tie", "text")
        fresh = rows.withColumn("_new", F.coalesce((F.col("at") - F.lag("at").over(w) > ttl_ms * 1000).cast("int"), F.lit(0)))
        session = fresh.withColumn("_s", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
        said = F.collect_list(F.struct("text")).over(W.partitionBy(key, "_s").orderBy("at", "tie", "text").rowsBetween(1 - most, 0))
        return session.select(key, F.col("at").alias("ts"), F.transform(said, lambda s: s["text"]).alias("history"))
    use_rocksdb(turns.sparkSession)
    kind = turns.schema[key].dataType.simpleString()
    timed = rows.withWatermark("_ts", late)
    return timed.groupBy(key).transformWithStateInPandas(_Histories(ttl_ms * 1000, most, key), f"{key} {kind}, ts bigint, history array<string>", "Append", "EventTime")


# ---------------------------------------------------------------- turns of a chat


class _Kept:
    """A MapState with the methods of a dict that a fold needs: new entries are held by `recent` and only looked up in the state
    where it has some (`deep`)."""

    def __init__(self, state, recent: dict[str, list], deep: bool):
        self.state, self.recent, self.deep = state, recent, deep

    def get(self, key: str) -> tuple | None:
        if key in self.recent:
            return tuple(self.recent[key])
        found = self.state.getValue((key,)) if self.deep and self.state.containsKey((key,)) else None
        return tuple(found) if found is not None else None

    def __setitem__(self, key: str, value: tuple) -> None:
        self.recent[key] = value

    def settle(self) -> None:
        """Hands the recent entries over to the state."""
        for key, value in self.recent.items():
            self.state.updateValue((key,), tuple(value))
        self.recent, self.deep = {}, True


_EVENT = ["at", "id", "kind", "turn", "request", "version", "text"]


def fold_chat(event: tuple, pending: tuple | None, requests, turns) -> tuple[tuple, tuple | None]:
    """The outcome (turn, version, outcome) of an event of a chat, and its pending turn (turn, version, request, started) after it.

    requests maps a request to its turn and prompt, turns maps a turn to its version, status, text and last request. `start`
    needs a chat without a pending turn; its request, sent again, is a replay, or a conflict with another prompt. `retry`
    needs a turn whose version is the one expected. `complete` and `fail` end the pending attempt that they name (turn,
    request and version, each where given); others are ignored.
    """
    at, _, kind, turn, request, version, text = event
    if kind == "start":
        if (known := requests.get(request)) is not None:
            return (known[0], turns.get(known[0])[0], "REPLAYED" if known[1] == text else "REQUEST_CONFLICT"), pending
        if pending is not None:
            return (None, None, "CHAT_BUSY"), pending
        turn = turn if turn is not None else request
        requests[request], turns[turn] = (turn, text), (1, "PENDING", None, request)
        return (turn, 1, "CREATED"), (turn, 1, request, at)
    if kind == "retry":
        if (row := turns.get(turn)) is None:
            return (turn, None, "UNKNOWN_TURN"), pending
        if request is not None and request == row[3]:
            return (turn, row[0], "REPLAYED" if version == row[0] - 1 else "REQUEST_CONFLICT"), pending
        if version is not None and version != row[0]:
            return (turn, row[0], "STALE_GENERATION"), pending
        if pending is not None:
            return (turn, row[0], "CHAT_BUSY"), pending
        turns[turn] = (row[0] + 1, "PENDING", None, request)
        return (turn, row[0] + 1, "RETRIED"), (turn, row[0] + 1, request, at)
    fits = pending is not None and all(given is None or given == own for given, own in zip((turn, version, request), pending))
    if not fits:
        return (turn, version, "IGNORED"), pending
    status = "COMPLETED" if kind == "complete" else "FAILED"
    turns[pending[0]] = (pending[1], status, text, pending[2])
    return (pending[0], pending[1], status), None


def _fold_events(key: object, events: list[tuple], pending: tuple | None, requests, turns, expiry_us: int, until: int | None) -> tuple[list[tuple], tuple | None]:
    """Output rows of events in order, with those of attempts that outlive expiry before them, and the pending turn."""
    out = []

    def expire(now: int | None, pending: tuple | None) -> tuple | None:
        if pending is None or now is None or pending[3] + expiry_us >= now:
            return pending
        turns[pending[0]] = (pending[1], "FAILED", "GENERATION_INTERRUPTED", pending[2])
        out.append((key, pending[3] + expiry_us, None, pending[0], pending[1], "INTERRUPTED"))
        return None

    for e in events:
        pending = expire(e[0], pending)
        got, pending = fold_chat(e, pending, requests, turns)
        out.append((key, e[0], e[1], *got))
    return out, expire(until, pending)


class _Chats(InOrder):
    def __init__(self, key: str, expiry_us: int, keep_us: int):
        super().__init__(_EVENT, [key, "at", "id", "turn", "version", "outcome"])
        self.expiry_us, self.keep_us = expiry_us, keep_us

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.chat = handle.getValueState("chat", "last bigint, turn string, version bigint, request string, started bigint, deep boolean, recent string")
        self.requests = handle.getMapState("requests", "request string", "turn string, prompt string")
        self.turns = handle.getMapState("turns", "turn string", "version bigint, status string, text string, request string")

    def release(self, key: tuple, rows: list[tuple], until: int) -> tuple[list[tuple], int | None]:
        last, *before, deep, recent = self.chat.get() or (None, None, None, None, None, False, "[[], []]")
        requests, turns = (_Kept(s, dict(r), deep) for s, r in zip((self.requests, self.turns), json.loads(recent), strict=True))
        last = rows[-1][0] if rows else last
        out, pending = _fold_events(key[0], rows, tuple(before) if before[3] is not None else None, requests, turns, self.expiry_us, until)
        if last is None or (pending is None and until - last > self.keep_us):
            for state in (self.chat, self.requests, self.turns) if deep else (self.chat,):
                state.clear()
            return out, None
        if len(requests.recent) + len(turns.recent) > _LOT:
            requests.settle()
            turns.settle()
        recent = json.dumps([list(k.recent.items()) for k in (requests, turns)], ensure_ascii=False, separators=(",", ":"))
        self.chat.update((last, *(pending or (None,) * 4), turns.deep, recent))
        return out, _millis(pending[3] + self.expiry_us if pending else last + self.keep_us) + 1


def chat_turns(events: DataFrame, key: str, *, expiry_ms: int = 300_000, keep_ms: int = 86_400_000, late: str = "10 minutes", now: int | None = None) -> DataFrame:
    """What becomes of each event of a chat: rows (key, at, id, turn, version, outcome), and one without an id for each attempt
    that outlives expiry (INTERRUPTED, at the time it did).

    events: key, ts (a timestamp), id, kind (start, retry, complete, fail), turn, request, version, text; see fold_chat. A chat
    has one pending turn at most. On a stream events count once the watermark has passed them, in order of time and id, so
    late, replayed and stale ones have the same outcome however they are batched, and an attempt expires when the watermark
    says so; a chat that is silent for keep_ms is forgotten, its requests too. On a table the same rows come from one pass
    over each chat; `now` (microseconds) is when silent attempts are judged, none leaves them pending.
    """
    kind = events.schema[key].dataType.simpleString()
    out = f"{key} {kind}, at bigint, id string, turn string, version bigint, outcome string"
    rows = events.select(F.col(key), F.col("ts").alias("_ts"), F.unix_micros("ts").alias("at"), F.col("id").cast("string").alias("id"), "kind", *[F.col(c).cast("string").alias(c) for c in ("turn", "request")], F.col("version").cast("bigint").alias("version"), "text")
    if events.isStreaming:
        use_rocksdb(events.sparkSession)
        return rows.withWatermark("_ts", late).groupBy(key).transformWithStateInPandas(_Chats(key, expiry_ms * 1000, keep_ms * 1000), out, "Append", "EventTime")

    def whole(k: tuple, f: pd.DataFrame) -> pd.DataFrame:
        got = sorted(_tuples(f, _EVENT), key=_order)
        return pd.DataFrame(_fold_events(k[0], got, None, {}, {}, expiry_ms * 1000, now)[0], columns=[key, "at", "id", "turn", "version", "outcome"])

    return rows.drop("_ts").groupBy(key).applyInPandas(whole, out)


# ---------------------------------------------------------------- alerts


class _Alerts(StatefulProcessor):
    def __init__(self, limit: int, default: float, digits: int | None, out: list[str]):
        self.limit, self.default, self.digits, self.out = limit, default, digits, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.given = handle.getMapState("given", "document string", "score double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        pairs = pd.concat(list(rows)).groupby(["document_id", "topic_id"], as_index=False).agg(w=("w", "sum"), n=("n", "first"), least=("min_score", "first"))
        pairs["score"] = pairs["w"] / pairs["n"]
        if self.digits is not None:
            pairs["score"] = pairs["score"].clip(upper=1.0).round(self.digits)  # half to even
        pairs = pairs[pairs["score"] >= pairs["least"].astype("float64").fillna(self.default)]
        best = pairs.sort_values(["score", "topic_id"], ascending=[False, True]).drop_duplicates("document_id").sort_values(["score", "document_id"], ascending=[False, True])
        new = []
        for doc, topic, score in zip(best["document_id"], best["topic_id"], best["score"].tolist(), strict=True):
            if len(new) == self.limit:
                break
            if not self.given.containsKey((str(doc),)):
                self.given.updateValue((str(doc),), (score,))
                new.append((key[0], doc, topic, score))
        if new:
            yield pd.DataFrame(new, columns=self.out)

    def close(self) -> None:
        pass


def new_alerts(scores: DataFrame, topics: DataFrame, *, limit: int = 2, default: float = 0.6) -> DataFrame:
    """A stream of alerts (subscription_id, document_id, topic_id, score) from one of scores (topic_id, document_id, score): of
    each micro-batch a subscription gets at most `limit` documents that reach their topic's threshold and that it never got,
    by score and then document; the best topic of a document, the first of several, names the alert.

    What a subscription got is a MapState of its own: a batch looks up its documents one by one and reads nothing of what
    others got or when, and restarts go on with it. Removed alerts stay in it, so that they never return. scores may also
    be word hits (topic_id, document_id, w, n) as alerts.lexical_hits has them, which are summed here, since a document's
    come in one batch, and make lexical scores: an aggregate before a stateful operator could not be of one batch.
    """
    use_rocksdb(scores.sparkSession)
    hits = "w" in scores.columns
    rows = scores if hits else scores.select("topic_id", "document_id", F.col("score").alias("w"), F.lit(1).alias("n"))
    rows = rows.join(topics.select("topic_id", "subscription_id", "min_score"), "topic_id").select("subscription_id", "document_id", "topic_id", F.col("w").cast("double").alias("w"), "n", F.col("min_score").cast("double").alias("min_score"))
    names = ["subscription_id", "document_id", "topic_id"]
    out = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names) + ", score double"
    return rows.groupBy("subscription_id").transformWithStateInPandas(_Alerts(limit, default, 4 if hits else None, [*names, "score"]), out, "Append", "None")


# ---------------------------------------------------------------- feedback


def feedback(events: DataFrame) -> DataFrame:
    """What readers have done with each alert: rows (subscription_id, document_id, read_at, dismissed_at), for tables and, in
    update mode, for streams. events: event_id, ts, subscription_id, document_id, kind (read, dismiss, or read_all without a
    document).

    Both times are minima, so an event that comes twice, late or before another one changes nothing: any order and any
    batching of the same events gives the same rows. A row without a document holds the latest read_all in read_at."""
    first = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("ts")))
    every = F.max(F.when(F.col("kind") == "read_all", F.col("ts")))
    return events.groupBy("subscription_id", "document_id").agg(F.coalesce(first("read"), every).alias("read_at"), first("dismiss").alias("dismissed_at"))


def with_feedback(alerts: DataFrame, topics: DataFrame, done: DataFrame, *, default: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """Alerts with read_at and dismissed_at, and topics with their thresholds after the dismissals, from rows of feedback().

    alerts: subscription_id, document_id, topic_id, score, created_at. A read_all counts for alerts that were there by then.
    A dismissed alert stays, hidden by its dismissed_at, and its topic's threshold becomes the greater of the old one and
    the dismissed score plus 0.01."""
    whole = done.where("document_id is null").select("subscription_id", F.col("read_at").alias("_all"))
    own = done.where("document_id is not null")
    rows = alerts.join(own, ["subscription_id", "document_id"], "left").join(whole, "subscription_id", "left")
    rows = rows.withColumn("read_at", F.least("read_at", F.when(F.col("_all") >= F.col("created_at"), F.col("_all")))).select(*alerts.columns, "read_at", "dismissed_at")
    raised = rows.where("dismissed_at is not null").groupBy("topic_id").agg((F.max("score") + 0.01).alias("_s"))
    after = topics.join(raised, "topic_id", "left").withColumn("min_score", F.when(F.col("_s").isNotNull(), F.greatest(F.coalesce("min_score", F.lit(default)), F.col("_s"))).otherwise(F.col("min_score")))
    return rows, after.select(*topics.columns)


def collect_feedback(events: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Keep feedback() of a stream of events under folder, exactly once: a batch writes the rows it changed as the version of its
    number and replaces them if it runs again; read_feedback has the newest version of each row."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/version={number}")

    return feedback(events).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_feedback(spark: SparkSession, folder: str) -> DataFrame:
    keys = ["subscription_id", "document_id"]
    rows = spark.read.option("basePath", folder).parquet(f"{folder}/version=*")
    return rows.groupBy(*keys).agg(F.max_by(F.struct("read_at", "dismissed_at"), "version").alias("r")).select(*keys, "r.*")
