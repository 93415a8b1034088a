"""Streams with state: the same results however rows are batched, and after restarts."""

import datetime as dt
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from lexiforge.streaming import stateful as X
from lexiforge.streaming import streams as S

T0 = dt.datetime(2026, 9, 1, 8)


def batches(rng, rows, parts, at, late):
    """rows in `parts` lots, each row up to `late` seconds out of order."""
    moved = sorted(rows, key=lambda r: r[at] + dt.timedelta(seconds=rng.uniform(0, late)))
    n = -(-len(moved) // parts)
    return [moved[i : i + n] for i in range(0, len(moved), n)]


def run(spark, folder, schema, lots, make):
    """The rows that a stream gives for lots of input, one micro-batch each; the query is started anew for every third lot."""
    source, out = f"{folder}/in", f"{folder}/out"
    for i, lot in enumerate(lots):
        spark.createDataFrame(lot, schema).coalesce(1).write.mode("append").parquet(source)
        if i % 3 == 2 or i == len(lots) - 1:
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
            q = make(stream).writeStream.foreachBatch(lambda b, n: b.write.mode("append").parquet(out)).outputMode("append").option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start()
            q.awaitTermination()
    return sorted(map(str, spark.read.parquet(out).collect()))


def passed(rows, at, late_s):
    """The last time that the watermark has passed, in microseconds."""
    newest = max(r[at] for r in rows).replace(tzinfo=dt.timezone.utc).timestamp()
    return (int(newest * 1000) - late_s * 1000 - 1) * 1000


@pytest.mark.parametrize("parts", [1, 4, 9])
def test_histories_do_not_depend_on_batches(spark, tmp_path, parts):
    rng = random.Random(parts)
    rows = [(rng.choice("xyz"), T0 + dt.timedelta(seconds=rng.randrange(7200), microseconds=rng.choice([0, 500, 1000])), str(i)) for i in range(150)]
    rows += [("w", T0 + dt.timedelta(minutes=m), t) for m, t in ((0, "a"), (29, "b"), (60, "c"), (200, "z"))] + [("v", T0, None), ("v", T0, "same time")]
    schema = "chat string, ts timestamp, text string"
    make = lambda df: X.session_history(df, "chat", most=6)
    got = run(spark, tmp_path, schema, batches(rng, rows[:-6], parts, 1, 590) + [rows[-6:]], make) if parts > 1 else run(spark, tmp_path, schema, [rows], make)
    table = make(spark.createDataFrame(rows, schema)).where(F.col("ts") <= passed(rows, 1, 600))
    if parts > 1:  # the last lot holds rows that are late by then
        table = make(spark.createDataFrame([r for r in rows if r not in rows[-6:] or r[0] == "w" and r[1] > T0 + dt.timedelta(minutes=120)], schema)).where(F.col("ts") <= passed(rows, 1, 600))
    assert got == sorted(map(str, table.collect())) and len(got) > 140


def test_histories_of_a_table(spark):
    at = lambda minutes: T0 + dt.timedelta(minutes=minutes)
    rows = [("x", at(0), "a"), ("x", at(29), "b"), ("x", at(61), "c"), ("y", at(0), "k"), *[("z", T0 + dt.timedelta(seconds=i), str(i)) for i in range(25)], ("n", at(0), None)]
    h = {(r["chat"], r["history"][-1]): r["history"] for r in X.session_history(spark.createDataFrame(rows, "chat string, ts timestamp, text string"), "chat").collect()}
    assert h["x", "b"] == ["a", "b"] and h["x", "c"] == ["c"] and h["z", "24"] == [str(i) for i in range(5, 25)] and h["n", None] == [None]


EVENT = "chat string, ts timestamp, id string, kind string, turn string, request string, version bigint, text string"


def test_outcomes_of_a_chat(spark):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    rows = [
        ("c", at(0), "1", "start", "t1", "q1", None, "hello"), ("c", at(1), "2", "start", None, "q2", None, "again"), ("c", at(2), "3", "start", None, "q1", None, "hello"), ("c", at(2), "4", "start", None, "q1", None, "other"),
        ("c", at(3), "5", "complete", "t1", "q1", 2, "wrong version"), ("c", at(5), "6", "complete", "t1", "q1", 1, "fine"), ("c", at(6), "7", "complete", "t1", "q1", 1, "twice"),
        ("c", at(7), "8", "retry", "t1", "q3", 0, None), ("c", at(8), "9", "retry", "t1", "q3", 1, None), ("c", at(9), "10", "retry", "t1", "q3", 1, None), ("c", at(9), "11", "retry", "t9", "q4", 1, None), ("c", at(14), "12", "complete", "t1", "q3", 2, "late"),
        ("c", at(20), "13", "start", "t2", "q5", None, "x"), ("c", at(21), "14", "fail", None, None, None, "AI_UNAVAILABLE"), ("c", at(30), "15", "start", "t3", "q6", None, "silent"),
    ]
    df = spark.createDataFrame(rows, EVENT)
    got = [(r["id"], r["turn"], r["version"], r["outcome"]) for r in X.chat_turns(df, "chat").orderBy("at", F.col("id").cast("int")).collect()]
    assert got == [
        ("1", "t1", 1, "CREATED"), ("2", None, None, "CHAT_BUSY"), ("3", "t1", 1, "REPLAYED"), ("4", "t1", 1, "REQUEST_CONFLICT"), ("5", "t1", 2, "IGNORED"), ("6", "t1", 1, "COMPLETED"), ("7", "t1", 1, "IGNORED"),
        ("8", "t1", 1, "STALE_GENERATION"), ("9", "t1", 2, "RETRIED"), ("10", "t1", 2, "REPLAYED"), ("11", "t9", None, "UNKNOWN_TURN"), (None, "t1", 2, "INTERRUPTED"), ("12", "t1", 2, "IGNORED"),
        ("13", "t2", 1, "CREATED"), ("14", "t2", 1, "FAILED"), ("15", "t3", 1, "CREATED"),
    ]
    later = X.chat_turns(df, "chat", now=int(at(40).replace(tzinfo=dt.timezone.utc).timestamp() * 1e6)).where("outcome = 'INTERRUPTED'").collect()
    assert sorted(r["turn"] for r in later) == ["t1", "t3"]


@pytest.mark.parametrize("parts", [1, 5])
def test_turns_do_not_depend_on_batches(spark, tmp_path, parts):
    rng = random.Random(parts + 20)
    rows = []
    for i in range(160):
        kind = rng.choice(["start", "start", "retry", "complete", "fail"])
        rows.append((rng.choice("ab"), T0 + dt.timedelta(seconds=rng.randrange(5400)), str(i), kind, str(rng.randrange(6)) if kind == "retry" else None, str(rng.randrange(6)) if kind == "start" else f"r{i}" if kind == "retry" else None, None, rng.choice("pq")))
    rows.append(("z", T0 + dt.timedelta(hours=3), "end", "start", None, "q", None, None))
    got = run(spark, tmp_path, EVENT, batches(rng, rows[:-1], parts, 1, 590) + [rows[-1:]], lambda df: X.chat_turns(df, "chat"))
    want = X.chat_turns(spark.createDataFrame(rows[:-1], EVENT), "chat", now=passed(rows, 1, 600))
    assert got == sorted(map(str, want.collect()))


def test_alerts_by_words_never_repeat_over_restarts(spark, tmp_path):
    from lexiforge.operators import alerts as A

    topics = spark.createDataFrame([("t1", 1, None, ["road", "works"]), ("t2", 1, 0.95, ["road"]), ("t3", 2, 0.3, ["school", "meals", "menu"])], "topic_id string, subscription_id bigint, min_score double, terms array<string>")
    schema = "document_id string, title array<string>, body array<string>"
    lots = [[("d1", ["road", "works"], []), ("d2", ["road"], ["works"]), ("d3", [], ["school"])], [("d1", ["road", "works"], []), ("d4", ["works"], ["road"]), ("d5", ["road", "works"], []), ("d6", ["school"], [])], [("d2", ["road"], ["works"]), ("d7", ["road"], [])]]
    got = []
    for lot in lots:
        spark.createDataFrame(lot, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "feed"))
        S.scan_alerts(stream, topics, lambda f: A.lexical_hits(topics, f, "topic_id", "terms", "document_id", "title", "body"), str(tmp_path / "alerts"), str(tmp_path / "ck")).awaitTermination(60)
        got.append({(r["subscription_id"], r["document_id"]): (r["topic_id"], r["score"]) for r in spark.read.parquet(str(tmp_path / "alerts")).collect()})
    assert got[0] == {(1, "d1"): ("t1", 1.0), (1, "d2"): ("t2", 1.0)}
    assert got[1] == got[0] | {(1, "d5"): ("t1", 1.0), (1, "d4"): ("t1", 0.85), (2, "d6"): ("t3", 0.3333)}
    assert got[2] == got[1] | {(1, "d7"): ("t2", 1.0)}
    table = A.lexical_scores(topics, spark.createDataFrame(lots[0], schema), "topic_id", "terms", "document_id", "title", "body").collect()
    assert {(r["topic_id"], r["document_id"]): r["score"] for r in table}["t3", "d3"] == 0.2333


@pytest.mark.parametrize("order", [0, 1, 2])
def test_feedback_in_any_order_and_twice(spark, tmp_path, order):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    events = [(1, at(5), 1, "d1", "read"), (2, at(3), 1, "d1", "read"), (3, at(7), 1, "d2", "dismiss"), (4, at(6), 2, None, "read_all"), (5, at(9), 1, "d2", "dismiss"), (6, at(4), 2, None, "read_all"), (7, at(8), 2, "d1", "read")]
    schema = "event_id bigint, ts timestamp, subscription_id bigint, document_id string, kind string"
    rng = random.Random(order)
    lots = [rng.sample(events, len(events)), events[:3]] if order else [events]
    for lot in lots:
        for part in (lot[:3], lot[3:]):
            if part:
                spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        X.collect_feedback(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(90)
    alerts = spark.createDataFrame([(1, "d1", "t1", 0.7, at(0)), (1, "d2", "t1", 0.8, at(0)), (2, "d1", "t2", 0.9, at(1)), (2, "d9", "t2", 0.9, at(6)), (2, "d8", "t2", 0.9, at(7))], "subscription_id bigint, document_id string, topic_id string, score double, created_at timestamp")
    topics = spark.createDataFrame([("t1", None), ("t2", 0.7)], "topic_id string, min_score double")
    rows, after = X.with_feedback(alerts, topics, X.read_feedback(spark, str(tmp_path / "out")))
    assert {(r["subscription_id"], r["document_id"]): (r["read_at"], r["dismissed_at"]) for r in rows.collect()} == {(1, "d1"): (at(3), None), (1, "d2"): (None, at(7)), (2, "d1"): (at(6), None), (2, "d9"): (at(6), None), (2, "d8"): (None, None)}
    assert {r["topic_id"]: r["min_score"] for r in after.collect()} == {"t1": pytest.approx(0.81), "t2": 0.7}


def test_a_run_that_dies_leaves_the_old_mark_and_the_next_adds_nothing_twice(spark, tmp_path, monkeypatch):
    schema = "id string, updated_at timestamp, body string"
    at = lambda m: T0 + dt.timedelta(minutes=m)
    f, paths = S.fingerprint({"category": "mobility"}), [str(tmp_path / x) for x in ("store", "marks")]

    def land(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def collect():
        return S.collect_incremental(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), *paths, f, str(tmp_path / "ck"))

    start = lambda: [r["start"] for r in S.next_start(spark.read.parquet(paths[1]), f).collect()]
    land(("a", at(0), "x"))
    collect()
    assert start() == [at(-5)]
    land(("b", at(10), "y"), ("a", at(0), "x"))
    land(("c", at(20), "z"))
    land(("d", at(5), "old but new here"), ("b", at(10), "changed"), ("c", at(20), "z"))
    whole, calls = S.collect_batch, []

    def dies(batch, *a):
        whole(batch, *a)
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("killed")

    monkeypatch.setattr(S, "collect_batch", dies)
    with pytest.raises(StreamingQueryException):
        collect()
    assert start() == [at(-5)] and spark.read.parquet(paths[0]).count() == 5
    monkeypatch.setattr(S, "collect_batch", whole)
    collect()
    rows = sorted((r["id"], r["body"]) for r in spark.read.parquet(paths[0]).collect())
    assert rows == [("a", "x"), ("b", "changed"), ("b", "y"), ("c", "z"), ("d", "old but new here")] and start() == [at(15)]
    collect()
    assert start() == [at(15)] and S.commit_marks(spark, paths[1], f, "unknown") is None


def test_progress_of_streams_and_tables(spark, tmp_path):
    schema = "n bigint, ok boolean"
    for k in range(3):
        spark.createDataFrame([(i, i % 4 > 0) for i in range(20 * k, 20 * k + 20)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = S.Progress("rows", total=80)
    spark.streams.addListener(seen)
    stream = S.progress(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "rows", F.col("ok"))
    stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(90)
    for _ in range(100):
        if len(seen.rows) == 3:
            break
        import time

        time.sleep(0.1)
    spark.streams.removeListener(seen)
    rows = seen.table(spark).orderBy("batch").collect()
    assert [(r["done"], r["failed"], r["total"]) for r in rows] == [(15, 5, 80), (30, 10, 80), (45, 15, 80)]
    assert all(r["rate"] == pytest.approx((r["done"] + r["failed"]) / r["seconds"]) and r["eta"] == pytest.approx((80 - r["done"] - r["failed"]) / r["rate"]) for r in rows)
    df, got = S.observed(spark.read.parquet(str(tmp_path / "in")), "table", F.col("ok"))
    df.write.format("noop").mode("overwrite").save()
    batch = S.Progress("table")
    batch.of_table(got, 2.0)
    assert batch.rows == [("table", 0, 2.0, 45, 15, 60, 30.0, 0.0)] and S.progress_row("x", 0, 0.0, 0, 0, 5)[-2:] == (None, None)


class Calls:
    """A handle whose states are held here and count their calls."""

    def __init__(self):
        self.n, self.timers = 0, set()

    def _state(self, value):
        calls = self

        class State:
            def __init__(self):
                self.value = value()

            def __getattr__(self, name):
                calls.n += 1
                held = self.value
                put = lambda v: setattr(self, "value", v)
                return {
                    "exists": lambda: bool(held), "get": lambda: iter(held) if isinstance(held, list) else held, "update": put, "put": put, "appendList": lambda v: put([*held, *v]), "clear": lambda: put(value()),
                    "getValue": lambda k: held.get(k), "containsKey": lambda k: k in held, "updateValue": lambda k, v: put(held | {k: v}),
                }[name]

        return State()

    def getListState(self, *_):
        return self._state(list)

    def getValueState(self, *_):
        return self._state(lambda: None)

    def getMapState(self, *_):
        return self._state(dict)

    def registerTimer(self, at):
        self.n += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.n += 1
        self.timers.remove(at)


def drive(op, lots, names):
    """Output rows of one key for lots of input rows, each passed by the watermark before the next comes, and the calls of states."""
    import pandas as pd

    handle, out = Calls(), []
    op.init(handle)
    for lot in lots:
        list(op.handleInputRows(("k",), iter([pd.DataFrame(lot, columns=names)]), None))
        mark = max(r[0] for r in lot) // 1000 + 2
        while handle.timers and min(handle.timers) < mark:
            handle.timers.remove(min(handle.timers))
            now = type("T", (), {"getCurrentWatermarkInMs": staticmethod(lambda: mark)})
            out += [tuple(r) for f in op.handleExpiredTimer(("k",), now, None) for r in f.astype(object).where(f.notna(), None).itertuples(index=False)]
    return out, handle.n


@pytest.mark.parametrize("lots", [1, 3])
def test_a_chat_calls_its_states_a_few_times_for_many_events(lots):
    rng = random.Random(lots)
    kinds = rng.choices(["start", "complete", "fail", "retry"], k=240)
    rows = [(i * 1_000_000, f"{i:05}", k, str(rng.randrange(60)) if k == "retry" else None, str(rng.randrange(60)) if k == "start" else f"r{i}" if k == "retry" else None, None, rng.choice("pq")) for i, k in enumerate(kinds)]
    got, calls = drive(X._Chats("chat", 300_000_000, 10**15), [rows[i : i + 240 // lots] for i in range(0, 240, 240 // lots)], X._EVENT)
    want = X._fold_events("k", rows, None, {}, {}, 300_000_000, None)[0]
    assert got == want and calls <= 12 * lots


def test_a_long_chat_hands_its_entries_over_to_the_map_states():
    rows = [(n * 1_000_000, f"{n:05}", "start" if n % 2 == 0 else "complete", None, f"q{n // 2 % 700}" if n % 2 == 0 else None, None, "p") for n in range(2000)]
    got, _ = drive(X._Chats("chat", 300_000_000, 10**15), [rows[i : i + 150] for i in range(0, 2000, 150)], X._EVENT)
    want = X._fold_events("k", rows, None, {}, {}, 300_000_000, None)[0]
    assert got == want and {r[5] for r in got} == {"CREATED", "COMPLETED", "REPLAYED", "IGNORED"}


def test_versions_with_gaps_are_whole_numbers_on_a_stream(spark, tmp_path):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    rows = [("c", at(0), "1", "start", "t", "q", None, "x"), ("c", at(1), "2", "complete", "t", "q", 1, "y"), ("c", at(2), "3", "retry", "t", "r", 1, None), ("c", at(3), "4", "retry", "t", "s", 1, None), ("c", at(4), "5", "fail", "t", "r", 9, None), ("d", at(60), "6", "start", "t", "q", None, "x")]
    got = run(spark, tmp_path, EVENT, [rows], lambda df: X.chat_turns(df, "chat"))
    assert got == sorted(map(str, X.chat_turns(spark.createDataFrame(rows[:-1], EVENT), "chat", now=passed(rows, 1, 600)).collect()))
    assert [r.split("outcome='")[1][:-2] for r in sorted(got, key=lambda r: r.split("id=")[1][:4])] == ["CREATED", "COMPLETED", "RETRIED", "STALE_GENERATION", "IGNORED", "INTERRUPTED"]


def test_a_history_calls_its_states_a_few_times_for_many_messages():
    rows = [(i * 60_000_000 + (i // 50) * 3_600_000_000, f"{i:04}", f"m{i}") for i in range(200)]
    got, calls = drive(X._Histories(1_800_000_000, 5, "chat"), [rows[:120], rows[120:]], ["at", "tie", "text"])
    assert [h for _, _, h in got] == [[f"m{j}" for j in range(max(i // 50 * 50, i - 4), i + 1)] for i in range(200)] and calls <= 24
