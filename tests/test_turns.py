"""Choices, kept subjects, messages of turns, refreshes, names, run reports, prefaces."""

import datetime as dt

from pyspark.sql import functions as F

from lexiforge.functions import text as T
from lexiforge.operators import alerts as A
from lexiforge.operators import corpus as P
from lexiforge.operators import relational as R
from lexiforge.sources import feeds


def test_choices_have_labels_of_their_own(spark):
    rows = [
        ("q", "a", "doc-000001", "Buget", 0.9, False), ("q", "a", "doc-000002", "Alt buget", 0.8, False), ("q", "b", "doc-000003", "Buget", 0.88, None), ("q", None, "doc-000004", "Plan", 0.85, False), ("q", "c", "doc-000005", "Departe", 0.3, False),
        ("several", "a", "d1", "x", 0.9, True), ("several", "b", "d2", "y", 0.9, True), ("weak", "a", "d1", "x", 0.2, False), ("weak", "b", "d2", "y", 0.2, False), ("one", "a", "d1", "x", 0.9, False), ("one", "a", "d0", "z", 0.9, False),
    ]
    df = spark.createDataFrame(rows, "q string, subject string, document_id string, label string, score double, multiple_projects boolean")
    got = [tuple(r) for r in R.clarification_choices(df, "q", least=0.5, ratio=0.9).orderBy("q", "rank").collect()]
    assert got == [("q", 1, "doc-000001", "Buget"), ("q", 2, "doc-000003", "Buget (000003)"), ("q", 3, "doc-000004", "Plan")]
    assert R.clarification_choices(df.limit(0), "q", least=0.5, ratio=0.9).count() == 0


def test_only_the_chosen_subject_is_kept(spark):
    e = spark.createDataFrame([("q", "A", "one", 1), ("q", "A", "other label", 2), ("q", "B", "two", 3), ("q", None, "none", 4), ("r", "A", "one", 5), ("s", "A", "one", 6)], "q string, subject string, label string, n int")
    kept = lambda *c: sorted(r["n"] for r in R.keep_chosen(e, "q", spark.createDataFrame(c, "q string, chosen string")).collect())
    assert kept(("q", "one"), ("r", None)) == [1, 2, 5, 6] and kept(("q", "none"), ("r", "no such")) == [4, 5, 6] and kept() == [1, 2, 3, 4, 5, 6]


def test_turns_become_messages(spark):
    schema = "chat string, n int, prompt string, text string, flags array<string>, citations array<struct<document_id:string,title:string,url:string,outdated:boolean>>, documents array<struct<title:string,link:string>>"
    cite = lambda title, outdated, doc="d": (doc, title, "u", outdated)
    rows = [
        ("c", 1, "hi", "yes", ["OUTDATED_SOURCES"], [cite("t", None), cite("", None)], [("unused", None)]), ("c", 2, None, None, None, None, [("Doc", "l"), (None, None)]),
        ("c", 3, "", "x", ["OUTDATED_SOURCES"], [cite("t", False), cite(None, None, None)], None), ("c", 4, "q", "y", None, [cite("t", True)], None), ("c", 5, "q", None, None, None, None),
    ]
    got = [(r["n"], r["role"], r["content"], [tuple(s) for s in r["sources"]]) for r in R.turn_messages(spark.createDataFrame(rows, schema), "chat", "n").orderBy("n", "part").collect()]
    assert got == [
        (1, "user", "hi", []), (1, "assistant", "yes", [("t", "u", True), ("d", "u", True)]), (2, "assistant", "", [("Doc", "l", False), ("Source", "", False)]), (3, "assistant", "x", [("t", "u", False), ("Source", "u", False)]),
        (4, "user", "q", []), (4, "assistant", "y", [("t", "u", True)]), (5, "user", "q", []), (5, "assistant", "", []),
    ]


def test_refreshes_names_and_previous_turns(spark):
    at = lambda h: dt.datetime(2026, 9, 1, h)
    asked = spark.createDataFrame([("a", at(3)), ("a", at(5)), ("b", at(2)), ("c", at(1)), ("d", None)], "s string, at timestamp")
    done = spark.createDataFrame([("a", at(4)), ("b", at(2)), ("x", at(9))], "s string, at timestamp")
    assert sorted(r["s"] for r in R.needs_refresh(asked, done, "s", "at").collect()) == ["a", "c"]
    turns = spark.createDataFrame([("c", 2, "later"), ("c", 1, "  a\n b " + "x" * 60), ("d", 1, None)], "chat string, n int, text string")
    names = {r["chat"]: r["name"] for r in R.auto_names(turns, "chat", "n", "text").collect()}
    assert names == {"c": "a b " + "x" * 46, "d": None}
    assert {r["n"]: r["prev_text"] for r in R.previous(turns.where("chat = 'c'"), "chat", "n", "text").collect()}[2].startswith("  a")


def test_runs_that_fail_as_a_whole(spark):
    docs = spark.createDataFrame([("r1", "a", "READY", []), ("r1", "b", "WARNING", [("WARN", "W", 3, "m")]), ("r2", "a", "READY", []), ("r3", "a", "READY", []), ("r4", "a", "STRANGE", [])], "run_id string, document_id string, status string, issues array<struct<severity:string,code:string,stage:int,message:string>>")
    at = lambda h: dt.datetime(2026, 9, 1, h)
    runs = spark.createDataFrame([("r1", None, None, at(5)), ("r2", False, None, at(6)), ("r3", True, "disk full", at(6)), ("r5", True, "", None)], "run_id string, consistent boolean, global_error string, completed_at timestamp")
    reports, problems = feeds.review_reports(docs, runs)
    assert {r["run_id"]: r["run_status"] for r in reports.collect()} == {"r1": "PARTIAL_SUCCESS", "r2": "FAILED", "r3": "FAILED", "r4": "FAILED", "r5": "SUCCESS"}
    assert problems.count() == 1 and [tuple(r) for r in feeds.latest_run(reports).collect()] == [("r3", "FAILED")]
    alone, _ = feeds.review_reports(docs.where("run_id <> 'r4'"))
    assert {r["run_id"]: r["run_status"] for r in alone.collect()} == {"r1": "PARTIAL_SUCCESS", "r2": "SUCCESS", "r3": "SUCCESS"} and feeds.latest_run(alone).count() == 0


def test_a_preface_goes_before_the_manifest(spark):
    schema = "document_id string, title string, publisher string, published_date string, language string, url string, source_type string, document_type string, metadata map<string,string>"
    rows = [("a", "Given", "P", "2026-01-01", None, "u", "municipal_corpus_api", "unknown", {"Title": "Own", "Publisher": " ", "Main image URL": "i"}), ("b", None, None, None, "ru", None, "webpage", "decision", None), ("c", "T", None, None, "en", None, "pdf", None, {"Language": "ro", "Source URL": "s"})]
    df = P.structured_documents(spark.createDataFrame(rows, schema))
    a, b, c = df.withColumn("want", T.stable_id("passage", "document_id", F.lit("api_metadata"), F.lit("title"), "title")).orderBy("document_id").collect()
    assert (a["title"], a["publisher"], a["language"], a["image_url"], a["statistics_as_of"]) == ("Own", "P", "ro", "i", "2026-01-01")
    assert a["title_citation"]["quote"] == "Own" and a["title_citation"]["passage_id"] == a["want"] and tuple(a["title_citation"]["locator"]) == ("api_metadata", "title")
    assert (b["title"], b["language"], b["document_type"], b["title_citation"]) == (None, "ru", "decision", None) and (c["language"], c["url"], c["document_type"]) == ("ro", "s", "administrative_document")


def test_a_theta_join_in_blocks(spark):
    topics, feed = spark.range(20).select(F.col("id").alias("t")), spark.range(30).select(F.col("id").alias("f"))
    pairs = lambda n: sorted(map(tuple, A.score_join(topics, feed, F.col("f") - F.col("t"), F.lit(5), block=n).collect()))
    assert pairs(3) == pairs(4096) == sorted((t, f, f - t) for t in range(20) for f in range(30) if f - t >= 5)
