"""Case checks, suite measures, generated cases and exact ranks."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lexiforge.operators import evaluation as V
from lexiforge.operators.relational import nearest_ranks

EXPECT = "struct<status:array<string>,reasons:array<string>,max_citations:int,acceptable_document_ids:array<string>,acceptable_title_patterns:array<string>,acceptable_url_patterns:array<string>,required_document_ids:array<string>,forbidden_document_ids:array<string>,duplicate_groups:array<array<string>>,answer_pattern:string,value_pattern:string>"
REPLY = "id string, mode string, status string, answer string, reason string, reason_given boolean, flags array<string>, citations array<struct<id:string,document_id:string,title:string,url:string>>, choices array<struct<document_id:string,label:string,url:string>>, latency_ms double, error string"


def case(i, kind="answerable", **k):
    return i, kind, tuple(k.get(n) for n in ("status", "reasons", "max", "ids", "titles", "urls", "required", "forbidden", "groups", "answer", "value"))


def reply(i, status="SUPPORTED", answer="", mode="rag", reason=None, given=True, flags=None, citations=(), choices=(), ms=None, error=None):
    return i, mode, status, answer, reason, given, flags, list(citations), list(choices), ms, error


def scored(spark, *pairs):
    cases = spark.createDataFrame([c for c, _ in pairs], f"id string, kind string, expect {EXPECT}")
    replies = spark.createDataFrame([r for _, r in pairs if r], REPLY)
    return V.score_cases(cases, replies)


def failing(row):
    return {k for k in V.CHECKS if row[k] is False}


def test_checks_of_a_case(spark):
    s1, s2 = ("S1", "d1", "Road works", "https://a.md/1"), ("S2", "d2", "Other", "https://b.md/2")
    long_ = "Aceasta este o propoziție destul de lungă"
    out = {
        r["id"]: r
        for r in scored(
            spark,
            (case("fine", ids=["d1"], status=["SUPPORTED"], answer="LUNGĂ", value="lung"), reply("fine", answer=f"# Titlu fără semn, destul de lung aici\n{long_}. [S1]", citations=[s1], ms=5.0)),
            (case("unrelated", titles=["road"], max=1), reply("unrelated", answer=f"{long_} [S1]. {long_} fără semn.", citations=[s1, s2])),
            (case("by url", urls=[r"A\.MD"]), reply("by url", answer="Da [S1].", citations=[s1])),
            (case("none wanted", max=0), reply("none wanted", "NOT_FOUND", reason="X", citations=[s1], choices=[("d1", "Road", None)])),
            (case("reason", reasons=["A"]), reply("reason", "NOT_FOUND", reason="B")),
            (case("reason missing", reasons=["A"]), reply("reason missing", "NOT_FOUND", given=False)),
            (case("marks"), reply("marks", answer="x [S1] y [S3]", citations=[("x", "d", "t", "u"), ("S7", "d", "t", "u")])),
            (case("uncited"), reply("uncited", "PARTIAL", answer=f"{long_}.", citations=[s1])),
            (case("demo"), reply("demo", "OTHER", answer="text", mode="demo")),
            (case("choices", "ambiguous", groups=[["d1", "d5"], ["d9"]]), reply("choices", "NEEDS_CLARIFICATION", choices=[("d1", "Străzi", None), ("d5", "Alt", None), (None, "STRAZI!", None), (None, None, None)])),
            (case("two", "ambiguous", titles=["str[aă]z"]), reply("two", "NEEDS_CLARIFICATION", choices=[("d1", "Străzi", None), ("d2", "Parc", None)], flags=[])),
            (case("outdated", "yearly_topic", forbidden=["d1", "d2"], required=["d2", "d3"], ids=["d3"]), reply("outdated", answer="a [S1]", citations=[s1, s2], choices=[("d2", "x", None)])),
            (case("value", value=r"\d+ lei", answer="bani"), reply("value", answer="Nu știu [S1]", citations=[s1])),
            (case("error"), reply("error", error="timeout")),
            (case("silent"), None),
        ).collect()
    }
    assert {i: failing(r) for i, r in out.items()} == {
        "fine": set(), "unrelated": {"citation_count", "citation_relevance"}, "by url": set(), "none wanted": {"not_found_without_citations", "citation_count", "citation_relevance", "choice_relevance"}, "reason": {"reason"}, "reason missing": set(),
        "marks": {"no_dangling_markers"}, "uncited": {"answer_cited"}, "demo": {"answer_cited"}, "choices": {"no_duplicate_choices"}, "two": {"choice_relevance"}, "outdated": {"required_documents", "no_outdated_sources"},
        "value": {"value_present_when_answered", "answer_content"}, "error": set(), "silent": set(),
    }
    assert {i for i, r in out.items() if r["passed"]} == {"fine", "by url", "reason missing"} and all(out[i]["status"] is None and out[i]["n_citations"] is None for i in ("error", "silent"))
    n = lambda i, *names: tuple(out[i][x] for x in names)
    assert n("fine", "n_sentences", "n_uncited_sentences", "answer_bearing", "uncited_answer", "reason_reported", "flags_reported") == (1, 0, True, False, True, False)
    assert n("unrelated", "n_sentences", "n_uncited_sentences", "n_unrelated_citations", "relevance_scored") == (2, 1, 1, True)
    assert n("choices", "n_choices", "n_duplicate_choices", "choices_scored") == (4, 2, False) and n("two", "n_unrelated_choices", "flags_reported") == (1, True)
    assert n("outdated", "n_outdated_documents", "n_unrelated_citations") == (2, 0) and out["reason missing"]["reason"] is None and out["demo"]["answer_bearing"] is True

    total, kinds = V.suite_metrics(scored(spark, (case("a", ids=["d1"]), reply("a", answer="x [S1]", citations=[s1, s2], ms=10.0)), (case("b"), reply("b", "NOT_FOUND", ms=30.0, citations=[s1])), (case("c", "ambiguous"), reply("c", "NEEDS_CLARIFICATION", choices=[("d", "l", None)], ms=20.0)), (case("d", None), None)))
    t = total.first().asDict()
    want = {"cases": 4, "passed": 0, "failed": 4, "request_errors": 1, "unrelated_citations": 1, "scored_citations": 2, "unrelated_citation_rate": 0.5, "uncited_answers": 0, "answer_bearing_replies": 1, "uncited_answer_rate": 0.0, "uncited_sentence_rate": None, "false_not_found": 1, "answerable_cases": 2,
            "false_not_found_rate": 0.5, "clarification_precision": None, "scored_choices": 0, "ambiguous_clarified_rate": 1.0, "outdated_source_cases": 0, "yearly_cases": 0, "outdated_source_rate": None, "duplicate_choices": 0, "latency_p50": 20.0, "latency_p95": 30.0, "reason_reported": True, "flags_reported": False, "reason_checks_scored": 0}
    assert t == want and {(r["kind"], r["cases"], r["passed"]) for r in kinds.collect()} == {("answerable", 2, 0), ("ambiguous", 1, 0), ("?", 1, 0)}
    nothing = V.suite_metrics(scored(spark, (case("a"), None)).limit(0))[0].first()
    assert nothing["cases"] == 0 and nothing["latency_p50"] is None and nothing["unrelated_citation_rate"] is None


def test_only_approved_cases(spark):
    with pytest.raises(ValueError):
        V.approved_only(spark.createDataFrame([("DRAFT",)], "status string"))


def test_generated_cases(spark):
    docs = spark.createDataFrame([(f"d{i:03d}", None if i == 5 else f"T{i}") for i in range(70)], "id string, title string")
    rows = {r["id"]: r for r in V.evaluation_candidates(spark, docs, "id", "title").collect()}
    assert len(rows) == 100 and {k: sum(r["split"] == k for r in rows.values()) for k in ("tuning", "validation", "test")} == {"tuning": 60, "validation": 20, "test": 20}
    assert {r["kind"] for r in rows.values() if r["split"] == "test"} == set(V.CASE_KINDS) and sum(r["language"] == "ru" for r in rows.values()) == 40
    assert rows["ro-006"]["question"] == "Compară faptele din «» și «T6»." and rows["ru-076"]["question"] == "Сравните факты из «» и «T6»." and rows["ro-010"]["document_id"] is None
    with pytest.raises(ValueError):
        V.evaluation_candidates(spark, docs.limit(10), "id", "title")


@pytest.mark.parametrize("hot", [False, True])
def test_ranks_are_exact(spark, hot):
    rng = random.Random(3)
    rows = [("hot" if hot or rng.random() < 0.5 else rng.choice("ab"), rng.choice([1.5, 2.5]) if rng.random() < 0.4 else round(rng.uniform(0, 50), 1)) for _ in range(700)] + [(None, 3.0), (None, None), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    rank = lambda vs, q: sorted(vs)[max(1, math.ceil(q / 100 * len(vs))) - 1] if vs else None
    groups = {g: [v for x, v in rows if x == g and v is not None] for g, _ in rows}
    got = {r["g"]: (r["least"], r["p50"], r["p95"], r["most"]) for r in nearest_ranks(df, ["g"], "v", {"least": 0, "p50": 50, "p95": 95, "most": 100}).collect()}
    assert got == {g: tuple(rank(vs, q) for q in (0, 50, 95, 100)) for g, vs in groups.items()}
    every = [v for _, v in rows if v is not None]
    assert nearest_ranks(df, [], "v", {"p50": 50}).collect()[0]["p50"] == rank(every, 50)
    assert [r["p"] for r in nearest_ranks(df.where(F.lit(False)), [], "v", {"p": 50}).collect()] == [None]
