"""Evaluation: per-case checks, suite metrics, retrieval metrics, generated candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiforge.functions import text as T
from lexiforge.operators.relational import nearest_ranks
from lexiforge.store import materialize


def rate(part: Column, whole: Column) -> Column:
    """A share to 4 decimals, half even; null of nothing."""
    return F.bround(F.try_divide(part.cast("double"), whole.cast("double")), 4)


def retrieval_metrics(cases: DataFrame, runs: DataFrame, case: str, item: str, *, recall_at: int = 20, mrr_at: int = 10) -> DataFrame:
    """One row: cases, recall (share of cases with a relevant item in the first recall_at) and mean reciprocal rank up to
    mrr_at. cases holds relevant items (case, item), runs ranks (case, item, rank); cases without a run are misses."""
    hits = cases.join(runs, [case, item], "left").groupBy(case).agg(F.min("rank").alias("best"))
    n = F.greatest(F.lit(1), F.count("*"))
    return hits.agg(
        F.count("*").alias("cases"),
        F.round(F.count_if(F.col("best") <= recall_at) / n, 6).alias("recall"),
        F.round(F.coalesce(F.sum(F.when(F.col("best") <= mrr_at, 1.0 / F.col("best"))), F.lit(0.0)) / n, 6).alias("mrr"),
    )


def approved_only(gold: DataFrame, split: str | None = None) -> DataFrame:
    """The gold set, refused as a whole if any case is not approved; of one split if named."""
    if not gold.where(~F.col("status").eqNullSafe(F.lit("APPROVED"))).isEmpty():
        raise ValueError("the gold set has cases that are not approved")
    return gold if split is None else gold.where(F.col("split") == split)


#: Statuses of replies that answer, modes whose text answers whatever its status, kinds of cases that the corpus can
#: answer, and where an answer is cut into sentences.
ANSWERS = ("SUPPORTED", "PARTIAL", "CONTRADICTION")
ANSWERING_MODES = ("llm", "demo")
ANSWERABLE = ("answerable", "yearly_topic", "duplicate_heavy")
SENTENCE_END = r"(?<=[.!?…])\s+(?!\[S[0-9])|\n+"

#: The checks of a case, in their order.
CHECKS = (
    "status", "reason", "not_found_without_citations", "citation_count", "citation_relevance", "choice_relevance", "clarification_choices", "no_duplicate_choices",
    "required_documents", "no_outdated_sources", "answer_cited", "no_dangling_markers", "value_present_when_answered", "answer_content",
)


def _list(c: Column, kind: str = "string") -> Column:
    return F.coalesce(c, F.array().cast(f"array<{kind}>"))


def _some(patterns: Column, text: Column) -> Column:
    """Whether a pattern is found in the text, whatever its case; false without a text or a pattern."""
    return F.coalesce((F.length(text) > 0) & F.exists(_list(patterns), lambda p: F.regexp_like(text, F.concat(F.lit("(?iu)"), p))), F.lit(False))


def repeated_choices(choices: Column, groups: Column) -> Column:
    """How many choices (document_id, label) repeat an earlier one: the same document, the same label as normalised, or the same
    group of documents that count as one."""
    group = lambda d: F.array_max(F.filter(F.transform(_list(groups, "array<string>"), lambda g, i: F.when(F.array_contains(g, d), i)), lambda i: i.isNotNull()))
    filled = lambda x: F.when(F.length(x) > 0, x)
    keys = F.transform(choices, lambda c: F.struct(filled(c["document_id"]).alias("d"), filled(T.normalize_label(F.coalesce(c["label"], F.lit("")))).alias("l"), group(c["document_id"]).alias("g")))
    same = lambda a, b: F.coalesce(a["d"] == b["d"], F.lit(False)) | F.coalesce(a["l"] == b["l"], F.lit(False)) | F.coalesce(a["g"] == b["g"], F.lit(False))
    return F.size(F.filter(F.transform(keys, lambda k, i: F.exists(F.slice(keys, F.lit(1), i), lambda earlier: same(k, earlier))), lambda x: x))


def score_cases(cases: DataFrame, replies: DataFrame) -> DataFrame:
    """Each case with its checks (true, false, or null where they do not apply), its counts, and whether it passed.

    cases: id, kind, expect (a struct of status, reasons, max_citations, acceptable_document_ids, acceptable_title_patterns,
    acceptable_url_patterns, required_document_ids, forbidden_document_ids, duplicate_groups, answer_pattern, value_pattern).
    replies: id, mode, status, answer, reason, reason_given (whether the reply has one at all, even null), flags, citations
    (id, document_id, title, url), choices (document_id, label, url), latency_ms, error. A case without a reply, or with a
    request error, has request_ok false, fails, and counts nothing.
    """
    r = cases.join(replies.withColumnRenamed("id", "_rid"), cases["id"] == F.col("_rid"), "left")
    e = lambda f: F.col(f"expect.{f}")
    ok = F.col("_rid").isNotNull() & F.col("error").isNull()
    rows = r.select(
        "id", "kind", "latency_ms", "expect", ok.alias("request_ok"), F.coalesce("status", F.lit("")).alias("status"), F.coalesce("answer", F.lit("")).alias("answer"), "mode", "reason", F.coalesce("reason_given", F.lit(False)).alias("reason_given"),
        F.col("flags").isNotNull().alias("flags_given"), F.coalesce("citations", F.array().cast(replies.schema["citations"].dataType)).alias("citations"), F.coalesce("choices", F.array().cast(replies.schema["choices"].dataType)).alias("choices"),
        (F.coalesce(F.size(e("acceptable_document_ids")) > 0, F.lit(False)) | F.coalesce(F.size(e("acceptable_title_patterns")) > 0, F.lit(False)) | F.coalesce(F.size(e("acceptable_url_patterns")) > 0, F.lit(False)) | F.coalesce(e("max_citations") == 0, F.lit(False))).alias("judged"),
    )
    status, answer, judged = F.col("status"), F.col("answer"), F.col("judged")
    forbidden, none = _list(e("forbidden_document_ids")), F.coalesce(e("max_citations") == 0, F.lit(False))
    has = lambda ids, d: F.coalesce(F.array_contains(ids, d), F.lit(False))

    def unrelated(items: Column, title: str) -> Column:
        fits = lambda c: has(_list(e("acceptable_document_ids")), c["document_id"]) | _some(e("acceptable_title_patterns"), c[title]) | _some(e("acceptable_url_patterns"), c["url"])
        return F.when(judged, F.size(F.filter(items, lambda c: ~has(forbidden, c["document_id"]) & (none | ~fits(c))))).otherwise(0)

    cited = F.transform("citations", lambda c: c["document_id"])
    offered = F.array_distinct(F.concat(cited, F.transform("choices", lambda c: c["document_id"])))
    marks = F.transform(F.regexp_extract_all(answer, F.lit(r"\[S([0-9]+)\]"), F.lit(1)), lambda m: m.cast("bigint"))
    labels = F.transform("citations", lambda c, i: F.coalesce(F.nullif(F.regexp_extract(F.coalesce(c["id"], F.lit("")), r"^S([0-9]+)$", 1), F.lit("")).cast("bigint"), (i + 1).cast("bigint")))
    bearing = status.isin(*ANSWERS) | (F.coalesce(F.col("mode").isin(*ANSWERING_MODES), F.lit(False)) & answer.rlike(r"\S"))
    parts = F.transform(F.split(answer, SENTENCE_END, -1), lambda x: F.regexp_replace(F.regexp_replace(x, r"^\s+|\s+$", ""), r"^[-*•> ]+\s*", ""))
    sentences = F.filter(parts, lambda x: ~x.startswith("#") & (F.length(F.regexp_replace(F.regexp_replace(x, r"\[S[0-9]+\]", ""), r"^\s+|\s+$", "")) >= 25))
    rows = rows.select(
        "*", unrelated(F.col("citations"), "title").alias("_u"), unrelated(F.col("choices"), "label").alias("_uc"), repeated_choices(F.col("choices"), e("duplicate_groups")).alias("_dup"), F.size(F.array_intersect(offered, forbidden)).alias("_out"),
        bearing.alias("_bears"), (F.size(F.array_intersect(marks, labels)) == 0).alias("_unmarked"), F.size(F.array_except(marks, labels)).alias("_dangling"), F.size(marks).alias("_marks"), F.when(bearing, sentences).otherwise(F.array().cast("array<string>")).alias("_said"), cited.alias("_cited"),
    )
    n, m, found = F.size("citations"), F.size("choices"), status.isin("SUPPORTED", "PARTIAL")
    filled = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    uncited = F.col("_bears") & ((n == 0) | F.col("_unmarked"))
    found_in = lambda pattern: F.regexp_like(answer, F.concat(F.lit("(?iu)"), pattern))
    checks = dict(
        zip(
            CHECKS,
            (
                F.when(filled(e("status")), F.array_contains(e("status"), status)),
                F.when((status == "NOT_FOUND") & filled(e("reasons")) & F.col("reason_given"), has(e("reasons"), F.col("reason"))),
                F.when(status == "NOT_FOUND", n == 0),
                F.when(e("max_citations").isNotNull(), n <= e("max_citations")),
                F.when(judged & (n > 0), F.col("_u") == 0),
                F.when(judged & (m > 0), F.col("_uc") == 0),
                F.when(status == "NEEDS_CLARIFICATION", m - F.col("_dup") >= 2),
                F.when(m > 0, F.col("_dup") == 0),
                F.when(filled(e("required_document_ids")), F.size(F.array_except(e("required_document_ids"), F.col("_cited"))) == 0),
                F.when(F.size(forbidden) > 0, F.col("_out") == 0),
                F.when(F.col("_bears"), ~uncited),
                F.when(F.col("_bears") & (F.col("_marks") > 0), F.col("_dangling") == 0),
                F.when(e("value_pattern").isNotNull() & found, found_in(e("value_pattern"))),
                F.when(e("answer_pattern").isNotNull() & found, found_in(e("answer_pattern"))),
            ),
            strict=True,
        )
    )
    counts = {
        "n_citations": n, "relevance_scored": judged, "n_unrelated_citations": F.col("_u"), "n_choices": m, "choices_scored": judged, "n_unrelated_choices": F.col("_uc"), "n_duplicate_choices": F.col("_dup"), "n_outdated_documents": F.col("_out"),
        "answer_bearing": F.col("_bears"), "uncited_answer": uncited, "n_uncited_sentences": F.size(F.filter("_said", lambda x: ~x.rlike(r"\[S[0-9]+\]"))), "n_sentences": F.size("_said"), "reason_reported": F.col("reason_given"), "flags_reported": F.col("flags_given"),
    }
    good = F.col("request_ok")
    out = rows.select(
        "id", "kind", F.when(good, status).alias("status_given"), "latency_ms", "request_ok",
        *[F.when(good, c).alias(k) for k, c in checks.items()], *[F.when(good, c.cast("bigint") if k.startswith("n_") else c).alias(k) for k, c in counts.items()],
    )
    passed = good
    for k in CHECKS:
        passed = passed & F.coalesce(F.col(k), F.lit(True))
    return out.withColumn("passed", passed)


def suite_metrics(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row of counts, rates (4 decimals, null of nothing) and latencies (nearest rank) over the cases that had a reply; and
    cases and passes by kind. scored: rows of score_cases."""
    good = F.col("request_ok")
    total = lambda c, where=None: F.coalesce(F.sum(c if where is None else F.when(F.col(where), F.col(c))), F.lit(0))
    often = lambda cond: F.count_if(good & F.coalesce(cond, F.lit(False)))
    answerable, yearly, unclear = F.col("kind").isin(*ANSWERABLE), F.col("kind") == "yearly_topic", F.col("kind") == "ambiguous"
    c = {
        "cases": F.count("*"), "passed": F.count_if("passed"), "failed": F.count_if(~F.col("passed")), "request_errors": F.count_if(~good),
        "unrelated_citations": total("n_unrelated_citations"), "scored_citations": total("n_citations", "relevance_scored"), "uncited_answers": often(F.col("uncited_answer")), "answer_bearing_replies": often(F.col("answer_bearing")),
        "false_not_found": often(answerable & (F.col("status_given") == "NOT_FOUND")), "answerable_cases": often(answerable), "scored_choices": total("n_choices", "choices_scored"),
        "outdated_source_cases": often(yearly & (F.col("n_outdated_documents") > 0)), "yearly_cases": often(yearly), "duplicate_choices": total("n_duplicate_choices"),
        "reason_reported": F.coalesce(F.bool_or(F.col("reason_reported")), F.lit(False)), "flags_reported": F.coalesce(F.bool_or(F.col("flags_reported")), F.lit(False)), "reason_checks_scored": often(F.col("reason").isNotNull()),
        "_uncited": total("n_uncited_sentences"), "_sentences": total("n_sentences"), "_unrelated_choices": total("n_unrelated_choices"), "_clarified": often(unclear & (F.col("status_given") == "NEEDS_CLARIFICATION")), "_unclear": often(unclear),
    }
    rates = {
        "unrelated_citation_rate": ("unrelated_citations", "scored_citations"), "uncited_answer_rate": ("uncited_answers", "answer_bearing_replies"), "uncited_sentence_rate": ("_uncited", "_sentences"),
        "false_not_found_rate": ("false_not_found", "answerable_cases"), "ambiguous_clarified_rate": ("_clarified", "_unclear"), "outdated_source_rate": ("outdated_source_cases", "yearly_cases"),
    }
    sums = scored.agg(*[x.alias(k) for k, x in c.items()])
    sums = sums.withColumns({k: rate(F.col(a), F.col(b)) for k, (a, b) in rates.items()} | {"clarification_precision": rate(F.col("scored_choices") - F.col("_unrelated_choices"), F.col("scored_choices"))})
    times = nearest_ranks(scored.where(good), [], "latency_ms", {"latency_p50": 50, "latency_p95": 95})
    measures = sums.drop(*[k for k in c if k.startswith("_")]).join(F.broadcast(times), how="left")  # one row each
    return measures, scored.groupBy(F.coalesce("kind", F.lit("?")).alias("kind")).agg(F.count("*").alias("cases"), F.count_if("passed").alias("passed"))


#: Kinds of generated cases, in turn, and their questions by language; {0} and {1} are titles.
CASE_KINDS = ("direct_fact", "date", "amount", "location", "list", "comparison", "ambiguous", "title_only", "historical", "unanswerable")
CASE_QUESTIONS = {
    "ambiguous": ("Care este bugetul proiectului?", "Каков бюджет проекта?"),
    "historical": ("Ce informații erau raportate în 2022 despre «{0}»?", "Какие сведения сообщались в 2022 году о «{0}»?"),
    "unanswerable": ("Care a fost temperatura exactă la inaugurare?", "Какой была точная температура на открытии?"),
    "comparison": ("Compară faptele din «{0}» și «{1}».", "Сравните факты из «{0}» и «{1}»."),
    None: ("Ce informații verificabile oferă documentul «{0}»?", "Какие проверяемые сведения содержит документ «{0}»?"),
}


def evaluation_candidates(spark: SparkSession, documents: DataFrame, key: str, title: str, n: int = 100, *, least: int = 60) -> DataFrame:
    """n generated cases over the documents in order of id, in turn where there are fewer: rows (id, language, question, split,
    kind, answerable, document_id, clarification_expected, review_status).

    The first 60 of 100 are Romanian and for tuning, the next 20 for validation and the last 20 for testing, these two Russian.
    Kinds follow in turn; a comparison also names the next document, an unanswerable case has none. Fewer than `least`
    documents are an error. documents has one row an id: its latest version.
    """
    first = documents.select(F.col(key).alias("document_id"), F.coalesce(title, F.lit("")).alias("title")).orderBy("document_id").limit(n + 1)
    docs = materialize(first.withColumn("slot", F.row_number().over(W.orderBy("document_id")) - 1), "candidates")  # n + 1 rows at most
    have = documents.count()
    if have < least:
        raise ValueError(f"at least {least} documents are needed, there are {have}")
    no, ro = F.col("no"), F.col("no") < n * 6 // 10
    kind = F.element_at(F.array(*map(F.lit, CASE_KINDS)), (no % len(CASE_KINDS) + 1).cast("int"))
    cases = spark.range(n).select(F.col("id").alias("no"), (F.col("id") % have).alias("slot"), ((F.col("id") + 1) % have).alias("next"), kind.alias("kind"))
    other = docs.select(F.col("slot").alias("next"), F.col("title").alias("title2"))
    cases = cases.join(F.broadcast(docs), "slot").join(F.broadcast(other), "next")
    filled = lambda text: F.replace(F.replace(F.lit(text), F.lit("{0}"), F.col("title")), F.lit("{1}"), F.col("title2"))
    asked = lambda texts: F.when(ro, filled(texts[0])).otherwise(filled(texts[1]))
    question = F.coalesce(*[F.when(F.col("kind") == k, asked(t)) for k, t in CASE_QUESTIONS.items() if k], asked(CASE_QUESTIONS[None]))
    open_ = F.col("kind") != "unanswerable"
    return cases.select(
        F.concat(F.when(ro, "ro-").otherwise("ru-"), F.lpad((no + 1).cast("string"), 3, "0")).alias("id"), F.when(ro, "ro").otherwise("ru").alias("language"), question.alias("question"),
        F.when(ro, "tuning").when(no < n * 8 // 10, "validation").otherwise("test").alias("split"), "kind", F.when(open_, "ANSWERABLE").otherwise("UNANSWERABLE").alias("answerable"),
        F.when(open_, F.col("document_id")).alias("document_id"), (F.col("kind") == "ambiguous").alias("clarification_expected"), F.lit("PENDING").alias("review_status"),
    )
