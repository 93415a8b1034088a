"""Claims, their evidence and the answers made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiforge.functions import packs
from lexiforge.functions import text as T
from lexiforge.operators.search import top_per
from lexiforge.store import materialize

NUMBER = r"(?<![\p{L}\p{N}])[0-9]+(?:[.,][0-9]+)*(?![\p{L}\p{N}])"


def numbers_in(c: Column | str) -> Column:
    """Numbers of a text without separators of thousands, each once."""
    found = F.regexp_extract_all(T._col(c), F.lit(NUMBER), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"[.,](?=[0-9]{3}(?![0-9]))", "")))


def requirement_coverage(requirements: DataFrame, claims: DataFrame, key: str, claim: str) -> DataFrame:
    """Every requirement with its number of claims, their list, and ANSWERED or MISSING."""
    got = claims.groupBy(key).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(claim)).alias("list"))
    n = F.coalesce("n", F.lit(0))
    return requirements.join(got, key, "left").select(*requirements.columns, n.cast("bigint").alias("claims"), "list", F.when(n > 0, "ANSWERED").otherwise("MISSING").alias("status"))


def with_quotes(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Claims with what they cite: quotes, documents and unknown ids, as arrays in citation order."""
    cited = claims.select("question_id", "claim_no", F.posexplode("evidence_ids").alias("at", "evidence_id"))
    joined = cited.join(evidence.select("question_id", "evidence_id", "quote", "document_id"), ["question_id", "evidence_id"], "left")
    parts = joined.groupBy("question_id", "claim_no").agg(
        F.array_sort(F.collect_list(F.struct("at", "quote", "document_id"))).alias("cited"), F.count_if(F.col("document_id").isNull()).alias("unknown")
    )
    return claims.join(parts, ["question_id", "claim_no"], "left")


def deterministic_issues(claims: DataFrame, evidence: DataFrame, question: str = "question") -> DataFrame:
    """Claims with an array of issue codes; the first three kinds stand alone.

    UNKNOWN_EVIDENCE (an id that is not there, or none), CLAIM_IS_NOT_DECLARATIVE (a question), CLAIM_ECHOES_QUESTION;
    then HEADLINE_ONLY (all quotes are headings), UNSUPPORTED_NUMBER:n (no quote has it), CROSS_DOCUMENT_NUMERIC_CLAIM
    (numbers spread over documents), UNSUPPORTED_CURRENCY, UNSUPPORTED_FINANCIAL_STAGE:SPENT or ALLOCATED.
    """
    rows = with_quotes(claims, evidence)
    quotes = F.coalesce(F.transform("cited", lambda c: F.coalesce(c["quote"], F.lit(""))), F.array().cast("array<string>"))
    rows = rows.withColumn("_quotes", quotes).withColumn("_said", F.array_join("_quotes", "\n"))
    # read several times below, worked out once a row
    rows = rows.withColumns({"_mine": numbers_in("text"), "_theirs": numbers_in("_said"), "_text_folded": T.fold("text"), "_said_folded": T.fold("_said")})
    mine, theirs, text, said = (F.col(c) for c in ("_mine", "_theirs", "_text_folded", "_said_folded"))
    echo = T.normalize_label("text") == T.normalize_label(question)
    alone = F.coalesce(
        F.when((F.coalesce("unknown", F.lit(0)) > 0) | (F.size("_quotes") <= 0), "UNKNOWN_EVIDENCE"),
        F.when(F.trim("text").endswith("?"), "CLAIM_IS_NOT_DECLARATIVE"),
        F.when(echo, "CLAIM_ECHOES_QUESTION"),
    )
    headline = F.forall("_quotes", lambda q: T.is_heading(q) | (~q.rlike(r"[.!?;]") & (F.size(F.split(F.trim(q), r"\s+")) <= 12) & ~q.rlike("[0-9]")))
    docs = F.array_distinct(F.transform("cited", lambda c: c["document_id"]))
    together = F.exists("cited", lambda c: F.size(F.array_except(mine, numbers_in(c["quote"]))) == 0)
    money = r"(?i)(?<!\p{L})(lei|mdl|eur|euro|usd|dolari)(?!\p{L})"
    currency = F.lower(F.regexp_extract("text", money, 1))
    spent, allocated = r"cheltuit|executat|spent|израсходован", r"alocat|planificat|aprobat|allocated|выделен"
    missing = F.transform(F.array_except(mine, theirs), lambda n: F.concat(F.lit("UNSUPPORTED_NUMBER:"), n))
    codes = F.array_compact(
        F.array(
            F.when(headline, "HEADLINE_ONLY"),
            F.when((F.size(mine) > 1) & (F.size(docs) > 1) & (F.size(missing) == 0) & ~F.coalesce(together, F.lit(False)), "CROSS_DOCUMENT_NUMERIC_CLAIM"),
            F.when((F.length(currency) > 0) & ~F.coalesce(F.contains(said, currency), F.lit(False)), "UNSUPPORTED_CURRENCY"),
            F.when(text.rlike(spent) & ~said.rlike(spent), "UNSUPPORTED_FINANCIAL_STAGE:SPENT"),
            F.when(text.rlike(allocated) & ~said.rlike(allocated) & said.rlike(spent), "UNSUPPORTED_FINANCIAL_STAGE:ALLOCATED"),
        )
    )
    issues = F.when(alone.isNotNull(), F.array(alone)).otherwise(F.concat(codes, missing))
    return rows.withColumn("issues", issues).drop("_quotes", "_said", "_mine", "_theirs", "_text_folded", "_said_folded", "cited", "unknown")


def bind_requirements(claims: DataFrame, evidence: DataFrame, requirements: DataFrame) -> DataFrame:
    """A requirement id that is not the question's is replaced if the cited evidence implies exactly one, or there is only one."""
    valid = requirements.groupBy("question_id").agg(F.collect_set("requirement_id").alias("_valid"))
    implied = claims.select("question_id", "claim_no", F.explode("evidence_ids").alias("evidence_id")).join(evidence.select("question_id", "evidence_id", F.col("requirement_id").alias("_r")), ["question_id", "evidence_id"])
    implied = implied.groupBy("question_id", "claim_no").agg(F.collect_set("_r").alias("_implied"))
    rows = claims.join(valid, "question_id", "left").join(implied, ["question_id", "claim_no"], "left")
    new = F.when(F.array_contains("_valid", F.col("requirement_id")), F.col("requirement_id")).when(F.size("_implied") == 1, F.element_at("_implied", 1)).when(F.size("_valid") == 1, F.element_at("_valid", 1))
    return rows.withColumn("requirement_id", new).drop("_valid", "_implied")


def prune_evidence(claims: DataFrame, evidence: DataFrame, most: int = 2) -> DataFrame:
    """Rows (question_id, claim_no, evidence_id, rank): a claim with numbers keeps the best passage that has them all, if one
    does; else the `most` best by score."""
    cited = claims.select("question_id", "claim_no", numbers_in("text").alias("_n"), F.explode("evidence_ids").alias("evidence_id"))
    rows = cited.join(evidence.select("question_id", "evidence_id", "quote", "score"), ["question_id", "evidence_id"])
    rows = rows.withColumn("_all", (F.size("_n") > 0) & (F.size(F.array_except("_n", numbers_in("quote"))) == 0))
    ranked = top_per(rows, ["question_id", "claim_no"], [F.desc("_all"), F.desc("score"), F.asc("evidence_id")], most)

    holds = F.max("_all").over(W.partitionBy("question_id", "claim_no"))
    return ranked.withColumn("_any", holds).where(~F.col("_any") | ((F.col("rank") == 1) & F.col("_all"))).select("question_id", "claim_no", "evidence_id", "rank")


def atomize_claims(claims: DataFrame) -> DataFrame:
    """One row for each sentence of a claim, with its number."""
    rest = [c for c in claims.columns if c != "text"]
    return claims.select(*rest, F.posexplode(T.split_sentences("text")).alias("sentence_no", "text"))


def render_answers(claims: DataFrame, known: DataFrame) -> DataFrame:
    """Rows (question_id, answer, citations, dropped): a line for each claim that cites known evidence, in order, each of its
    sentences with the claim's marks, renumbered S1, S2 ... by first use; citations are the evidence ids in that order.

    Claims without known evidence or without a sentence are dropped. If a part of the answer is left uncited, the whole
    answer is rejected: it is null, without citations, and all claims count as dropped.
    """
    rows = claims.withColumn("_s", T.split_sentences("text", without_marks=True))
    cited = rows.where(F.size("_s") > 0).select("question_id", "claim_no", "_s", F.posexplode(F.array_distinct("evidence_ids")).alias("at", "evidence_id"))
    cited = cited.join(known.select("question_id", "evidence_id").distinct(), ["question_id", "evidence_id"])
    from lexiforge.operators.relational import renumber

    labelled = renumber(cited.withColumn("_order", F.struct("claim_no", "at")), "question_id", "evidence_id", "_order")
    one = labelled.groupBy("question_id", "claim_no").agg(F.first("_s").alias("_s"), F.array_sort(F.collect_list(F.struct("at", "label", "evidence_id"))).alias("m"))
    marks = F.array_join(F.transform("m", lambda x: F.concat(F.lit("["), x["label"], F.lit("]"))), " ")
    one = one.withColumn("_line", F.array_join(F.transform("_s", lambda s: F.concat(s, F.lit(" "), marks)), " "))
    in_order = F.array_sort(F.collect_list(F.struct("claim_no", "_line", "m")))
    out = one.groupBy("question_id").agg(in_order.alias("_claims"), F.count("*").alias("_kept"))
    used = F.array_sort(F.array_distinct(F.flatten(F.transform("_claims", lambda c: F.transform(c["m"], lambda x: F.struct(F.substring(x["label"], 2, 9).cast("int").alias("n"), x["evidence_id"].alias("id")))))))
    out = out.select("question_id", "_kept", F.array_join(F.transform("_claims", lambda c: c["_line"]), "\n").alias("answer"), F.transform(used, lambda u: u["id"]).alias("citations"))
    ids = F.transform(F.sequence(F.lit(1), F.greatest(F.size("citations"), F.lit(1))), lambda i: F.concat(F.lit("S"), i.cast("string")))
    out = out.withColumn("_ok", F.size(T.uncited_segments("answer", ids)) == 0)
    total = claims.groupBy("question_id").agg(F.count("*").alias("_total"))
    ok = F.coalesce("_ok", F.lit(False))
    return total.join(out, "question_id", "left").select(
        "question_id", F.when(ok, F.col("answer")).alias("answer"), F.when(ok, F.col("citations")).alias("citations"), (F.col("_total") - F.when(ok, F.col("_kept")).otherwise(0)).alias("dropped")
    )


def not_found_reason(in_scope: Column, relevant: Column, n_claims: Column, lacks_value: Column) -> Column:
    """Why nothing could be answered: no relevant passage (or a question out of scope), passages without the value or without a
    claim, or claims that none verified."""
    return F.when(relevant == 0, F.when(in_scope, "NO_RELEVANT_EVIDENCE").otherwise("OUT_OF_SCOPE")).when((n_claims == 0) | lacks_value, "EVIDENCE_LACKS_VALUE").otherwise("CLAIMS_UNVERIFIED")


def has_expected_value(claims: DataFrame, kinds: DataFrame, evidence: DataFrame) -> DataFrame:
    """Rows (question_id, has_value): whether some claim of the question holds a value of the kind asked for.

    kinds has one row (question_id, answer_type) for each question. Hours, dates, amounts and legal acts are looked for by
    pattern, in the claim and folded; a claim that cites a passage of a titled act holds that act. Of other kinds any claim will
    do; without claims there is none. evidence: question_id, evidence_id, title.
    """
    said = F.coalesce("text", F.lit(""))
    holds = lambda p: T.fold(said).rlike("(?iU)" + p) | said.rlike("(?iU)" + p)
    rows = claims.select("question_id", "text", "evidence_ids").join(kinds, "question_id")
    test = F.coalesce(*[F.when(F.col("answer_type") == k, holds(p)) for k, p in packs.EXPECTED_VALUES.items()], F.lit(True))
    acts = rows.where("answer_type = 'legal_act'").select("question_id", F.explode("evidence_ids").alias("evidence_id"))
    acts = acts.join(evidence.where(F.col("title").rlike("(?iU)" + packs.ACT_TITLE)), ["question_id", "evidence_id"]).select("question_id", F.lit(True).alias("v"))
    found = rows.select("question_id", test.alias("v")).unionByName(acts).groupBy("question_id").agg(F.bool_or("v").alias("v"))
    return kinds.select("question_id").join(found, "question_id", "left").select("question_id", F.coalesce("v", F.lit(False)).alias("has_value"))


def check_answer_contract(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """Answers with an array of violations of the citation contract, in the order of the checks.

    answers: question_id, status, answer, evidence_ids, limitations. evidence: question_id, evidence_id, document_id, quote.
    INVALID_STATUS, UNKNOWN_EVIDENCE (declared or in line), CITATIONS_DIFFER (in line and declared), LIMITATIONS_MISSING (of
    PARTIAL and NOT_FOUND); then of the sentences of four words or more: UNCITED_SENTENCE, DOCUMENT_CITED_TWICE,
    NUMERIC_CROSS_DOCUMENT and NUMBER_NOT_IN_QUOTE.
    """
    held = evidence.groupBy("question_id").agg(F.map_from_entries(F.collect_list(F.struct("evidence_id", F.struct("document_id", "quote")))).alias("_e"))
    rows = answers.join(held, "question_id", "left").withColumn("_e", F.coalesce("_e", F.create_map().cast("map<string,struct<document_id:string,quote:string>>")))
    number = r"\d+(?:[.,]\d+)?"
    text, declared = F.coalesce("answer", F.lit("")), F.coalesce("evidence_ids", F.array().cast("array<string>"))
    inline, valid = F.array_distinct(T.markers(text)), F.map_keys("_e")
    shielded = F.regexp_replace(F.regexp_replace(text, r"(?iU)\b(str|bd|dl|dna|nr|mun|sec)\.", "$1\u0001"), r"(?U)\b(\p{Lu}\p{Ll}{0,2})\.", "$1\u0001")
    sentences = F.transform(F.split(shielded, r"(?<=[.!?])\s+|\n+", -1), lambda s: F.replace(s, F.lit("\u0001"), F.lit(".")))
    bare = lambda s: F.regexp_replace(s, r"\[S\d+\]", "")
    long_ = F.filter(sentences, lambda s: F.size(F.regexp_extract_all(bare(s), F.lit(r"\p{L}+"), F.lit(0))) >= 4)
    known = F.filter(long_, lambda s: F.size(F.array_except(T.markers(s), valid)) == 0)
    documents = lambda s: F.transform(F.array_distinct(T.markers(s)), lambda i: F.try_element_at(F.col("_e"), i)["document_id"])
    claimed = lambda s: F.array_distinct(F.regexp_extract_all(bare(s), F.lit(number), F.lit(0)))
    quoted = lambda s: F.flatten(F.transform(T.markers(s), lambda i: F.regexp_extract_all(F.coalesce(F.try_element_at(F.col("_e"), i)["quote"], F.lit("")), F.lit(number), F.lit(0))))
    cited = lambda s: F.size(T.markers(s)) > 0
    codes = F.array_compact(
        F.array(
            F.when(~F.coalesce(F.col("status").isin("SUPPORTED", "PARTIAL", "NOT_FOUND", "CONTRADICTION"), F.lit(False)) | F.col("evidence_ids").isNull(), "INVALID_STATUS"),
            F.when((F.size(F.array_except(declared, valid)) > 0) | (F.size(F.array_except(inline, valid)) > 0), "UNKNOWN_EVIDENCE"),
            F.when(F.array_sort(inline) != F.array_sort(F.array_distinct(declared)), "CITATIONS_DIFFER"),
            F.when(F.col("status").isin("PARTIAL", "NOT_FOUND") & (F.coalesce(F.size("limitations"), F.lit(0)) <= 0), "LIMITATIONS_MISSING"),
            F.when(F.exists(long_, lambda s: ~cited(s)), "UNCITED_SENTENCE"),
            F.when(F.exists(known, lambda s: F.size(documents(s)) != F.size(F.array_distinct(documents(s)))), "DOCUMENT_CITED_TWICE"),
            F.when(F.exists(known, lambda s: (F.size(claimed(s)) > 0) & (F.size(F.array_distinct(documents(s))) > 1)), "NUMERIC_CROSS_DOCUMENT"),
            F.when(F.exists(known, lambda s: cited(s) & (F.size(F.array_except(claimed(s), quoted(s))) > 0)), "NUMBER_NOT_IN_QUOTE"),
        )
    )
    return rows.withColumn("violations", codes).drop("_e")


def verify(claims: DataFrame, evidence: DataFrame, verdicts: DataFrame, question: str = "question") -> tuple[DataFrame, DataFrame]:
    """Claims that a verifier supports, and the others with reasons. Claims with deterministic issues never reach it; one
    without a verdict is not supported. verdicts: question_id, claim_no, supported, reason."""
    checked = deterministic_issues(claims, evidence, question)
    said = verdicts.select("question_id", "claim_no", F.col("supported").alias("_supported"), F.col("reason").alias("_reason"))
    rows = checked.join(said, ["question_id", "claim_no"], "left")
    good = (F.size("issues") == 0) & F.coalesce("_supported", F.lit(False))
    reasons = F.when(F.size("issues") > 0, F.col("issues")).otherwise(F.array_compact(F.array(F.coalesce("_reason", F.lit("NO_VERDICT")))))
    rows = materialize(rows.withColumns({"_good": good, "reasons": reasons}).drop("issues", "_supported", "_reason"), "checked")  # both results are read from it
    return rows.where("_good").drop("_good", "reasons"), rows.where("not _good").drop("_good")


def answer_status(reason: Column, ambiguous: Column, contradiction: Column, n_docs: Column, n_missing: Column) -> Column:
    """NOT_FOUND with a reason, NEEDS_CLARIFICATION, CONTRADICTION (over two documents; in one the claims are unverified),
    PARTIAL while a requirement is missing, else SUPPORTED."""
    return F.when(ambiguous, "NEEDS_CLARIFICATION").when(reason.isNotNull() | (contradiction & (n_docs < 2)), "NOT_FOUND").when(contradiction, "CONTRADICTION").when(n_missing > 0, "PARTIAL").otherwise("SUPPORTED")


def needs_second_round(n_claims: Column, n_verified: Column) -> Column:
    """One more round is worth its while: nothing was claimed, or fewer than half of the claims stood."""
    return (n_claims == 0) | (n_verified * 2 < n_claims)


def better_round(rounds: DataFrame, by: str, verified: str, number: str) -> DataFrame:
    """A later round stands only if it has at least as many verified claims."""
    return top_per(rounds, [by], [F.desc(verified), F.desc(number)], 1, "_n").drop("_n")


def flags(dropped: Column, merged: Column, outdated: Column, rejected: Column, total: Column, corrected: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(dropped > 0, F.concat(F.lit("OFF_TOPIC_DROPPED:"), dropped.cast("string"))),
            F.when(merged > 0, F.concat(F.lit("DUPLICATES_MERGED:"), merged.cast("string"))),
            F.when(outdated, "OUTDATED_SOURCES"),
            F.when(rejected > 0, F.concat(F.lit("CLAIMS_REJECTED:"), rejected.cast("string"), F.lit("/"), total.cast("string"))),
            F.when(corrected, "CORRECTION_ROUND"),
        )
    )


def screen(candidates: DataFrame, verdicts: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Candidates that a verdict table calls relevant, and the others with their code; without a verdict TOPIC_ONLY."""
    rows = candidates.join(verdicts.select(*keys, "code"), keys, "left").withColumn("code", F.coalesce("code", F.lit("TOPIC_ONLY")))
    good = F.col("code").startswith("RELEVANT_")
    return rows.where(good), rows.where(~good)


def reply_contract(status: Column, reason: Column, citations: Column, statuses: list[str], reasons: list[str]) -> Column:
    """Violations of a reply: an unknown status, NOT_FOUND with citations or without a valid reason."""
    return F.array_compact(
        F.array(
            F.when(~F.coalesce(status.isin(*statuses), F.lit(False)), "UNKNOWN_STATUS"),
            F.when((status == "NOT_FOUND") & (F.coalesce(F.size(citations), F.lit(0)) > 0), "NOT_FOUND_WITH_CITATIONS"),
            F.when((status == "NOT_FOUND") & ~F.coalesce(reason.isin(*reasons), F.lit(False)), "REASON_MISSING"),
        )
    )
