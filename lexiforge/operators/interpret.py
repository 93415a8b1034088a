"""Pluggable models and the deterministic rules around them: embedders, scorers, question interpretation, topics, labels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.functions import packs
from lexiforge.functions import text as T
from lexiforge.operators.alerts import finalize_topics

REQUIREMENT = "array<struct<id:string,question:string,query:string,kind:string,answer_type:string,yearly:boolean,category:string>>"
INTERPRETATION = f"language string, standalone string, query string, category string, answer_type string, yearly boolean, in_scope boolean, streets array<string>, requirements {REQUIREMENT}"


def embed(df: DataFrame, key: str, text: str, embedder: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """Rows (key, embedding); the embedder gets batches of texts and returns as many finite vectors of one length. Anything else
    it returns fails the job."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            vectors = embedder(f[text].tolist())
            if len(vectors) != len(f) or len({len(v) for v in vectors}) > 1:
                raise ValueError("the embedder must return one vector of one length for each text")
            if not np.isfinite(np.array(vectors, dtype=np.float64)).all():
                raise ValueError("the embedder returned a number that is not finite")
            yield pd.DataFrame({key: f[key], "embedding": vectors})

    return df.select(key, text).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, embedding array<float>")


def rerank(candidates: DataFrame, scores: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates with a model's scores where it gave one in 0..1, reranked saying so; the others keep their score. Order by
    reranked and then score, both descending: what the model did not score stands below what it did."""
    good = scores.where(F.col("score").between(0, 1)).select(*keys, F.col("score").alias("_s")).dropDuplicates(keys)
    return candidates.join(good, keys, "left").withColumn("reranked", F.col("_s").isNotNull()).withColumn("score", F.coalesce("_s", "score")).drop("_s")


def lexical_rerank(query: Column, text: Column) -> Column:
    """The scorer without a model: share of the query's keywords that the text has."""
    q = T.keywords(query)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, T.keywords(text))).cast("double"), F.size(q).cast("double")), F.lit(0.0))


def answer_type(question: Column | str, hint: Column) -> Column:
    """Kind of answer: by rules on the folded question for working hours and legal acts; else the hint, if it is a kind; else other."""
    return T.first_rule(question, packs.ANSWER_RULES, F.when(hint.isin(*packs.ANSWER_TYPES), hint).otherwise("other"))


def is_yearly(question: Column | str, hint: Column | None = None) -> Column:
    """The question is about something that comes anew each year, by its words or by the hint."""
    said = F.coalesce(T.fold(question).rlike("(?U)" + packs.YEARLY), F.lit(False))
    return said if hint is None else said | F.coalesce(hint, F.lit(False))


def interpret(questions: DataFrame, model_output: str | None = None, most: int = 8, kinds: tuple[str, ...] = ("fact", "date", "amount", "procedure", "contact", "other")) -> DataFrame:
    """Questions with language, query, answer_type, yearly, years, streets, sectors, acronyms, category, historical,
    multiple_projects, in_scope, requirements and multi_intent.

    model_output names a column of JSON, of which valid parts are used; what it lacks comes from the rules, and the rules on
    language, kind of answer and years override it, for the question with its query and for each requirement by itself. A
    category that is none of the known ones is `none`; a question is in scope unless the model says that it is not. At least
    one requirement, the question itself if no other is left, at most `most`, of known kinds, numbered R1, R2 ...
    """
    m = F.from_json(F.col(model_output) if model_output else F.lit("{}"), INTERPRETATION)
    rows = questions.withColumn("_m", m)
    q, query, standalone = F.col("question"), T.first_non_blank("_m.query", "question"), T.first_non_blank("_m.standalone", "question")
    lang = T.detect_language(q, F.col("_m.language"), known=packs.LANGUAGES)
    known = lambda c: F.when(c.isin(*packs.CATEGORIES), c).otherwise("none")
    both, asked = F.concat_ws("\n", q, query), F.concat_ws("\n", standalone, query)
    kind, yearly, category = answer_type(asked, F.col("_m.answer_type")), is_yearly(asked, F.col("_m.yearly")), known(F.col("_m.category"))
    wanted = F.slice(F.filter(F.coalesce("_m.requirements", F.array().cast(REQUIREMENT)), lambda r: r["kind"].isin(*kinds) & (F.length(F.trim(r["query"])) > 0)), 1, most)

    def requirement(r: Column, i: Column) -> Column:
        said = F.coalesce(F.nullif(F.trim(r["question"]), F.lit("")), F.trim(r["query"]))
        own = (said, F.trim(r["query"]), r["kind"], answer_type(F.concat_ws("\n", said, r["query"]), r["answer_type"]), F.coalesce(r["yearly"], F.lit(False)), known(r["category"]))
        return _requirement(F.concat(F.lit("R"), (i + 1).cast("string")), *own)

    single = F.array(_requirement(F.lit("R1"), standalone, query, F.lit("other"), kind, yearly, category))
    needs = F.when(F.size(wanted) > 0, F.transform(wanted, requirement)).otherwise(single)
    found = lambda pattern: F.coalesce(standalone.rlike("(?iU)" + pattern), F.lit(False))
    return rows.select(
        *questions.columns, lang.alias("language"), standalone.alias("standalone"), query.alias("query"), kind.alias("answer_type"), yearly.alias("yearly"),
        T.years_in(both).alias("years"), T.street_keys(query, F.col("_m.streets")).alias("streets"), T.sectors_in(both).alias("sectors"), T.acronyms(q).alias("acronyms"), category.alias("category"),
        found(packs.HISTORICAL).alias("historical"), found(packs.SEVERAL_PROJECTS).alias("multiple_projects"), F.coalesce("_m.in_scope", F.lit(True)).alias("in_scope"), needs.alias("requirements"), (F.size(wanted) > 1).alias("multi_intent"),
    )


def _requirement(*values: Column) -> Column:
    names = ("id", "question", "query", "kind", "answer_type", "yearly", "category")
    return F.struct(*[v.alias(n) for v, n in zip(values, names, strict=True)])


def dense_query_text(query: Column, yearly: Column, years: Column, today: Column) -> Column:
    """The query, with the current year after it for yearly questions that name none."""
    return F.when(yearly & (F.size(years) == 0), F.concat(query, F.lit(" "), F.year(today).cast("string"))).otherwise(query)


def _at_words(patterns: tuple[str, ...]) -> str:
    """One pattern for folded text that finds any of these where a word starts."""
    return r"(?U)(?<!\w)(?:" + "|".join(T.folded(p) for p in patterns) + ")"


def extract_topics(
    questions: DataFrame, by: str, text: str, order: str, *, existing: DataFrame | None = None, themes: tuple = packs.THEMES, districts: tuple = packs.DISTRICTS, most: int = 4
) -> DataFrame:
    """Rows (by, label, query, rank): what a group of questions is about, at most `most` topics.

    Themes come by how often their patterns stand in all questions together, then in their own order; if the questions name
    one district and no other, it goes into label and query. A group without a theme gets a topic of up to five content
    words for each of its questions, in order, but for those in Cyrillic. Labels that exist (by, label) and repeats are
    dropped before the first `most` are taken.
    """
    folded = questions.select(by, T.fold(text).alias("_t"))
    counts = F.array(*[F.regexp_count("_t", F.lit(_at_words(p))).cast("bigint") for _, _, p in themes])
    named = F.array(*[F.col("_t").rlike(_at_words(p)).cast("int") for _, p in districts])
    hits = folded.select(by, F.posexplode(counts).alias("theme", "hits")).where("hits > 0").groupBy(by, "theme").agg(F.sum("hits").alias("hits"))
    said = folded.select(by, F.posexplode(named).alias("d", "is")).where("is = 1").groupBy(by).agg(F.collect_set("d").alias("d"))
    where = said.where("size(d) = 1").select(by, F.element_at(F.array(*[F.lit(name) for name, _ in districts]), F.col("d")[0] + 1).alias("district"))
    table = questions.sparkSession.createDataFrame([(i, label, query) for i, (label, query, _) in enumerate(themes)], "theme int, label string, query string")
    known = hits.join(F.broadcast(table), "theme").join(where, by, "left")  # a fixed list of themes
    inside = lambda form, plain: F.when(F.col("district").isNull(), F.col(plain)).otherwise(F.replace(F.replace(F.lit(form), F.lit("{" + plain + "}"), F.col(plain)), F.lit("{district}"), F.col("district")))
    known = known.select(by, inside(packs.TOPIC_IN_DISTRICT[0], "label").alias("label"), inside(packs.TOPIC_IN_DISTRICT[1], "query").alias("query"), F.struct((-F.col("hits")).alias("a"), F.col("theme").alias("b")).alias("_o"))
    words = F.slice(F.filter(F.regexp_extract_all(F.col(text), F.lit(r"(?U)[\p{L}\p{Nl}\p{No}][\w-]*"), F.lit(0)), lambda w: (F.length(w) >= 3) & ~T.fold(w).isin(*packs.STOPWORDS)), 1, 5)
    phrase = F.array_join(words, " ")
    alone = questions.where(~F.col(text).rlike("[\u0400-\u04ff]") & (F.size(words) > 0)).join(hits.select(by).distinct(), by, "left_anti")
    other = alone.select(by, T.capitalized(phrase).alias("label"), phrase.alias("query"), F.struct(F.col(order).cast("bigint").alias("a"), F.lit(0).alias("b")).alias("_o"))
    return finalize_topics(known.unionByName(other), by, "label", "_o", most, query="query", existing=existing).drop("_o")


MODEL_TOPICS = "struct<topics:array<struct<label:string,query:string>>>"


def topics_of(questions: DataFrame, by: str, text: str, order: str, model: DataFrame | None = None, *, existing: DataFrame | None = None, most: int = 4) -> DataFrame:
    """Rows (by, label, query, rank): a model's topics where it gave a list of them, and extract_topics for groups whose model output
    (by, output: JSON) is missing, is no such JSON or has no list. An empty list is an answer: the group has no topic."""
    if model is None:
        return extract_topics(questions, by, text, order, existing=existing, most=most)
    read = model.select(by, F.from_json("output", MODEL_TOPICS).alias("m")).where("m.topics is not null")
    given = read.select(by, F.posexplode("m.topics").alias("_o", "t")).select(by, F.coalesce("t.label", F.lit("")).alias("label"), F.coalesce("t.query", F.lit("")).alias("query"), "_o")
    ours = finalize_topics(given, by, "label", "_o", most, query="query", existing=existing).drop("_o")
    return ours.unionByName(extract_topics(questions.join(read.select(by), by, "left_anti"), by, text, order, existing=existing, most=most))


def resolve_followup(reply: Column, labels: Column) -> Column:
    """The clarification choice that a reply picks: by an ordinal; else the first label that, folded, equals the reply, holds
    it (from 8 characters on), or stands in it; null if none does."""
    key = F.regexp_replace(T.fold(reply), r"^[ .!?\"'«»-]+|[ .!?\"'«»-]+$", "")
    place = F.coalesce(*[F.when(key == T.folded(w), F.lit(n)) for w, n in packs.ORDINALS.items()])
    fits = lambda x: (T.fold(x) == key) | ((F.length(key) >= 8) & F.contains(T.fold(x), key)) | ((F.length(T.fold(x)) > 0) & F.contains(key, T.fold(x)))
    return F.coalesce(F.try_element_at(labels, place), F.when(F.length(key) > 0, F.try_element_at(F.filter(labels, fits), F.lit(1))))


def _by(texts: dict[str, str], key: Column, otherwise: str) -> Column:
    return F.coalesce(*[F.when(key == k, F.lit(t)) for k, t in texts.items()], F.lit(texts[otherwise]))


def not_found_note(reason: Column, language: Column, kind: Column | None = None) -> Column:
    """Why nothing was found, in the language, naming what was asked for; of an unknown reason or language the first."""
    lang = F.when(language.isin(*packs.LANGUAGES), language).otherwise(packs.LANGUAGES[0])
    wanted = F.coalesce(*[F.when(lang == k, _by(t, F.lit("other") if kind is None else kind, "other")) for k, t in packs.TYPE_NAMES.items()])
    text = lambda r: _by(packs.NOT_FOUND[r], lang, packs.LANGUAGES[0])
    chosen = F.coalesce(*[F.when(reason == r, text(r)) for r in packs.NOT_FOUND], text("NO_RELEVANT_EVIDENCE"))
    return F.replace(chosen, F.lit("{value}"), wanted)


def clarification(language: Column) -> Column:
    return _by(packs.CLARIFICATIONS, language, packs.LANGUAGES[0])


def outdated_note(language: Column, citations: Column) -> Column:
    """A sentence with the years of outdated citations and their marks; null if none has a year. citations: structs of id,
    published (a date) and outdated."""
    old = F.filter(citations, lambda c: F.coalesce(c["outdated"], F.lit(False)))
    years = F.array_sort(F.array_distinct(F.array_compact(F.transform(old, lambda c: F.year(c["published"]).cast("string")))))
    marks = F.array_join(F.transform(old, lambda c: F.concat(F.lit("["), c["id"], F.lit("]"))), " ")
    text = F.replace(_by(packs.OUTDATED, language, packs.LANGUAGES[0]), F.lit("{years}"), F.array_join(years, ", "))
    return F.when(F.size(years) > 0, F.concat(text, F.lit(" "), marks))


def is_unanswered(answer: Column | str) -> Column:
    return T.contains_any(answer, packs.REFUSALS)


REPLY = "status string, answer string, reason string, outdated boolean, citations array<struct<id:string,title:string,url:string,outdated:boolean>>, choices array<struct<document_id:string,label:string>>"


def parse_reply(json: Column | str) -> Column:
    """A reply's JSON as a struct: unknown fields pass, outdated is never null, choices stand under the answer as `- label`."""
    r = F.from_json(json, REPLY)
    choices = F.when(F.size(r["choices"]) > 0, F.concat(F.lit("\n"), F.array_join(F.transform(r["choices"], lambda c: F.concat(F.lit("- "), c["label"])), "\n"))).otherwise("")
    cites = F.transform(F.coalesce(r["citations"], F.array().cast("array<struct<id:string,title:string,url:string,outdated:boolean>>")), lambda c: F.struct(c["id"].alias("id"), c["title"].alias("title"), c["url"].alias("url"), F.coalesce(c["outdated"], F.lit(False)).alias("outdated")))
    return F.struct(r["status"].alias("status"), F.concat(F.coalesce(r["answer"], F.lit("")), choices).alias("answer"), r["reason"].alias("reason"), F.coalesce(r["outdated"], F.lit(False)).alias("outdated"), cites.alias("citations"))
