"""Queries of the corpus batch, rules, claims, alerts and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiforge.functions import text as T
from lexiforge.operators import alerts as A
from lexiforge.operators import claims as C
from lexiforge.operators import corpus as P
from lexiforge.operators import evaluation as V
from lexiforge.operators import rules as R
from lexiforge.operators import validation as Q
from lexiforge.operators.relational import nearest_ranks, numbered
from lexiforge.operators.search import dense_pairs, dense_topk
from lexiforge.operators.similarity import similar_sets
from lexiforge.plans.query import query, table

_LINES = "SELECT doc_id, pos AS line, regexp_replace(l[pos], '\\s+$', '') AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(generate_series(1, len(string_split(text, chr(10))))) AS pos FROM documents)"


def _line_blocks(spark: SparkSession, d: str) -> DataFrame:
    return P.split_blocks(table(spark, d, "documents"), "doc_id", "text", lines_are_blocks=True)


@query("SELECT user_id, event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS heading FROM events QUALIFY event_type <> 'purchase'")
def q_carry_forward(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("type", F.when(F.col("event_type") == "purchase", "heading").otherwise("text")).withColumn("place", F.struct("ts", "event_id"))
    return P.structure(e, "user_id", "place", "type", "event_id").select("user_id", "event_id", "heading")


@query(f"SELECT doc_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(len(regexp_extract_all(t, '[0-9]+'))) AS BIGINT) AS numbers FROM ({_LINES}) WHERE regexp_matches(t, '[0-9]') GROUP BY doc_id")
def q_line_counts(spark: SparkSession, d: str) -> DataFrame:
    b = _line_blocks(spark, d).withColumn("k", F.regexp_count("block", F.lit("[0-9]+"))).where("k > 0")
    return b.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("k").alias("numbers"))


@query(
    """WITH d AS (SELECT doc_id, doc_id % 24 AS v, source, text, string_split(text, chr(10)) AS raw FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '[\\r\\x0B\\f\\x1C-\\x1E\\x{85}\\x{2028}\\x{2029}]')),
    l AS (SELECT *, CASE WHEN raw[-1] = '' THEN raw[:-2] ELSE raw END AS lines FROM d),
    c AS (SELECT *, len(lines) AS n, regexp_replace(raw[1], '\\s+$', '') AS first, regexp_replace(array_to_string(lines[1:2], chr(10)), '^\\s+|\\s+$', '', 'g') AS two FROM l),
    o AS (SELECT doc_id, CASE v
      WHEN 0 THEN CASE WHEN n = 0 THEN 'CITATION_SOURCE_UNAVAILABLE' WHEN n < 2 THEN 'SOURCE_LINE_RANGE_OUT_OF_BOUNDS' WHEN two = '' THEN 'CITATION_TEXT_MISSING' END
      WHEN 1 THEN CASE WHEN n = 0 THEN 'CITATION_SOURCE_UNAVAILABLE' WHEN n < 2 THEN 'SOURCE_LINE_RANGE_OUT_OF_BOUNDS' ELSE 'CITATION_TEXT_SOURCE_MISMATCH' END
      WHEN 2 THEN CASE WHEN n = 0 THEN 'CITATION_SOURCE_UNAVAILABLE' ELSE 'SOURCE_LINE_RANGE_INVALID' END WHEN 3 THEN CASE WHEN n = 0 THEN 'CITATION_SOURCE_UNAVAILABLE' ELSE 'SOURCE_LINE_RANGE_OUT_OF_BOUNDS' END
      WHEN 4 THEN '' WHEN 5 THEN CASE WHEN n = 0 THEN 'CITATION_SOURCE_UNAVAILABLE' ELSE 'CITATION_LOCATOR_INVALID' END WHEN 6 THEN 'CITATION_SOURCE_UNAVAILABLE' WHEN 7 THEN '' WHEN 8 THEN ''
      WHEN 9 THEN 'CITATION_TEXT_SOURCE_MISMATCH' WHEN 10 THEN 'API_METADATA_LOCATOR_INVALID' WHEN 11 THEN CASE WHEN n < 2 THEN 'SCRAPER_TEXT_RANGE_OUT_OF_BOUNDS' WHEN two = '' THEN 'CITATION_TEXT_MISSING' END
      WHEN 12 THEN 'SCRAPER_TEXT_LOCATOR_INVALID' WHEN 13 THEN 'SCRAPER_TEXT_RANGE_OUT_OF_BOUNDS' WHEN 14 THEN CASE WHEN n < 2 THEN 'SCRAPER_TEXT_RANGE_OUT_OF_BOUNDS' ELSE 'CITATION_TEXT_SOURCE_MISMATCH' END
      WHEN 15 THEN CASE WHEN first = '' THEN 'API_BLOCK_RANGE_OUT_OF_BOUNDS,CITATION_TEXT_MISSING' END WHEN 16 THEN CASE WHEN first = '' THEN 'API_BLOCK_RANGE_OUT_OF_BOUNDS' ELSE 'CITATION_TEXT_SOURCE_MISMATCH' END
      WHEN 17 THEN 'API_PAGE_LOCATOR_INVALID' WHEN 18 THEN 'API_PAGE_TEXT_UNAVAILABLE' WHEN 19 THEN 'API_BLOCK_RANGE_OUT_OF_BOUNDS' WHEN 20 THEN 'CITATION_LOCATOR_INVALID' WHEN 21 THEN 'CITATION_TEXT_MISSING' WHEN 22 THEN 'API_PAGE_LOCATOR_INVALID' ELSE 'CITATION_LOCATOR_INVALID,CITATION_TEXT_MISSING' END AS issues FROM c)
    SELECT doc_id, coalesce(issues, '') AS issues FROM o"""
)
def q_citation_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """A passage of each document, cited in one of 24 ways, right ones and wrong ones of every kind."""
    docs = table(spark, d, "documents").where(F.col("text").isNotNull() & ~F.col("text").rlike(r"[\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"))
    v, none = F.col("doc_id") % 24, F.lit(None)
    lines = F.split("text", "\n", -1)
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)
    two, first = F.regexp_replace(F.array_join(F.slice(lines, 1, 2), "\n"), r"^\s+|\s+$", ""), F.regexp_replace(F.substring_index("text", "\n", 1), r"\s+$", "")
    kind = F.when(v < 6, "lines").when(v > 7, "api")
    sources = docs.select(F.col("doc_id").alias("document_id"), kind.alias("source_kind"), F.when(v != 12, F.col("text")).alias("text"), F.col("source").alias("title"), F.when(v != 22, F.array(F.struct(F.substring_index("text", "\n", 1).alias("text")), F.struct(none.cast("string").alias("text")))).alias("pages"))
    place = lambda kind, start=None, end=None, page=None, block=None, field=None: F.struct(F.lit(kind).alias("kind"), F.lit(start).cast("int").alias("start_line"), F.lit(end).cast("int").alias("end_line"), F.lit(page).cast("int").alias("page_index"), F.lit(block).cast("int").alias("block_index"), F.lit(field).cast("string").alias("field"))
    far = 1_000_000
    places = [
        place("source_lines", 1, 2), place("source_lines", 1, 2), place("source_lines", 2, 1), place("source_lines", 1, far), place("pdf_page"), place("api_page", page=0, block=1), place("source_lines", 1, 2), place("html_extraction"), place("api_metadata", field="title"),
        place("api_metadata", field="title"), place("api_metadata", field="lang"), place("scraper_text", 1, 2), place("scraper_text", 1, 2), place("scraper_text", 1, far), place("scraper_text", 1, 2), place("api_page", page=0, block=1), place("scraper_page", page=0, block=1),
        place("api_page", page=2, block=1), place("api_page", page=1, block=1), place("api_page", page=0, block=far), place("pdf_page"), place("api_metadata", field="title"), place("api_page", page=0, block=1), place("source_lines", 1, 1),
    ]
    cited = F.when(v.isin(0, 11), two).when(v == 15, first).when(v.isin(8, 21), F.when(v == 8, F.col("source")).otherwise(F.lit(" "))).when(v == 23, F.lit("")).otherwise(F.concat(two, F.lit("!")))
    passages = docs.select("doc_id", F.col("doc_id").alias("document_id"), cited.alias("citation_text"), F.when(v == 21, F.col("source")).alias("quote"), F.element_at(F.array(*places), (v + 1).cast("int")).alias("locator"))
    return Q.validate_citations(passages, sources).select("doc_id", F.array_join("citation_issues", ",").alias("issues"))


@query(
    f"""WITH b AS ({_LINES}), p AS (SELECT doc_id, count(*) AS passages, count(*) FILTER (WHERE length(t) >= 100) AS ready FROM b WHERE t <> '' GROUP BY doc_id)
    SELECT d.doc_id, CAST(coalesce(passages, 0) AS BIGINT) AS passages, CAST(coalesce(ready, 0) AS BIGINT) AS ready, CASE WHEN coalesce(ready, 0) > 0 AND coalesce(l.quality, 1) = 1 THEN 'PRODUCTION' ELSE 'QUARANTINE' END AS decision
    FROM documents d LEFT JOIN p USING (doc_id) LEFT JOIN labels l USING (doc_id)"""
)
def q_ready_counts(spark: SparkSession, d: str) -> DataFrame:
    p = _line_blocks(spark, d).select("doc_id", F.concat_ws(":", "doc_id", "ord").alias("passage_id"), F.when(F.length("block") >= 100, "READY").otherwise("QUARANTINED").alias("status"))
    docs = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    docs = docs.withColumn("issues", F.array_compact(F.array(F.when(F.coalesce("quality", F.lit(1)) == 0, "LOW_QUALITY"))))
    return Q.validate(docs, p, "doc_id", ["LOW_QUALITY"]).select("doc_id", "passages", "ready", "decision")


@query(
    """SELECT page_id, array_to_string(list_filter([CASE WHEN length(url) < 40 THEN 'url:TOO_SHORT' END, CASE WHEN NOT regexp_matches(url, '^https://') THEN 'url:PATTERN' END, CASE WHEN length(html) < 2000 THEN 'html:TOO_SHORT' END], lambda x: x IS NOT NULL), ',') AS violations FROM pages"""
)
def q_constraint_violations(spark: SparkSession, d: str) -> DataFrame:
    contract = {"url": {"required": True, "min_length": 40, "pattern": "^https://"}, "html": {"required": True, "min_length": 2000}}
    return Q.check_schema(table(spark, d, "pages"), contract).select("page_id", F.array_join("violations", ",").alias("violations"))


_QUALITY = """SELECT doc_id, array_to_string(list_sort(list_filter([CASE WHEN trim(text, ' ') = '' THEN 'EMPTY_PASSAGE' END,
    CASE WHEN contains(text, chr(65533)) OR length(text) - length(replace(text, '?', '')) > greatest(4.0, length(text) / 30.0) THEN 'ENCODING_NOISE' END,
    CASE WHEN trim(text, ' ') <> '' AND len(list_filter(regexp_split_to_array(trim(text, ' '), '\\s+'), lambda w: w <> '')) < 4 THEN 'FRAGMENT' END,
    CASE WHEN len(w) >= 10 AND len(list_filter(w, lambda x: length(x) = 1)) > 0.4 * len(w) THEN 'OCR_NOISE' END], lambda x: x IS NOT NULL)), ',') AS issues, n_chars
    FROM (SELECT *, regexp_extract_all(text, '\\p{L}+') AS w FROM documents)"""


@query(f"SELECT doc_id, issues FROM ({_QUALITY})")
def q_quality(spark: SparkSession, d: str) -> DataFrame:
    q = P.passage_quality(F.col("text"), F.lit(True))
    return table(spark, d, "documents").select("doc_id", F.array_join(q["issues"], ",").alias("issues"))


@query(f"SELECT doc_id FROM ({_QUALITY}) WHERE issues = '' AND n_chars >= 200")
def q_ready_chunks(spark: SparkSession, d: str) -> DataFrame:
    q = P.passage_quality(F.col("text"), F.col("n_chars") >= 200)
    return table(spark, d, "documents").where(q["status"] == "READY").select("doc_id")


@query("SELECT conv_id, min_by(role || ' ' || text, turn) AS catalog_text FROM conversations GROUP BY conv_id")
def q_catalog(spark: SparkSession, d: str) -> DataFrame:
    return P.catalog(table(spark, d, "conversations"), "conv_id", "turn", "role", "text")


@query(
    """SELECT o_orderkey, CASE WHEN year(o_orderdate) <> 1995 AND 1995 + CAST(o_orderkey % 3 AS INTEGER) <> 1995 AND year(o_orderdate) <> 1995 THEN 'DIFFERENT_PERIOD' ELSE 'none' END AS conflict FROM orders"""
)
def q_year_conflict(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    named = F.array((F.lit(1995) + F.col("o_orderkey") % 3).cast("int"))
    found = R.period_conflict(F.array(F.lit(1995)), named, F.to_date("o_orderdate"))
    return o.select("o_orderkey", F.coalesce(found, F.lit("none")).alias("conflict"))


@query(
    """SELECT s_suppkey, n_regionkey, round(CASE WHEN n_regionkey NOT IN (0, 2) THEN s_acctbal * 0.85 ELSE s_acctbal END, 4) AS score, CAST(row_number() OVER (ORDER BY CASE WHEN n_regionkey NOT IN (0, 2) THEN s_acctbal * 0.85 ELSE s_acctbal END DESC, s_suppkey) AS INTEGER) AS rank
    FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey <> 4"""
)
def q_penalty_rank(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").join(table(spark, d, "nation").withColumnRenamed("n_nationkey", "s_nationkey"), "s_nationkey")
    rows = rows.select("s_suppkey", "n_regionkey", F.col("s_acctbal").alias("score"), F.lit("r2").alias("asked"), F.when(F.col("n_regionkey") == 0, "general").otherwise(F.concat(F.lit("r"), F.col("n_regionkey"))).alias("category"))
    kept, _ = R.apply_rules(rows, F.when(F.col("n_regionkey") == 4, "DIFFERENT_ENTITY"), "asked", "category")
    ranked = numbered(kept, [F.desc("score"), F.asc("s_suppkey")], "rank")
    return ranked.select("s_suppkey", "n_regionkey", F.round("score", 4).alias("score"), "rank")


@query(
    """WITH r AS (SELECT *, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02') BETWEEN 0 AND 365 AS recent FROM orders), a AS (SELECT *, bool_or(recent) OVER (PARTITION BY o_custkey) AS any_ FROM r)
    SELECT o_custkey, o_orderkey, NOT any_ AS outdated FROM a WHERE NOT any_ OR recent"""
)
def q_recency_fallback(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("o_orderdate", F.to_date("o_orderdate"))
    return R.apply_recency(o, "o_custkey", "o_orderdate", F.lit("1998-08-02").cast("date")).select("o_custkey", "o_orderkey", "outdated")


_WORDS = "list_distinct(regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+'))"


@query(
    f"""WITH d AS (SELECT doc_id, list_sort({_WORDS}) AS w FROM documents WHERE doc_id IS NOT NULL), s AS (SELECT *, row_number() OVER (ORDER BY k, w) AS i FROM (SELECT min(doc_id) AS k, w FROM d WHERE len(w) > 0 GROUP BY w))
    SELECT a, b, round(j, 6) AS jaccard FROM (SELECT a.k AS a, b.k AS b, len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) AS j FROM s a JOIN s b ON a.i < b.i AND least(len(a.w), len(b.w)) >= 0.85 * greatest(len(a.w), len(b.w))) WHERE j >= 0.85
    UNION ALL SELECT DISTINCT k AS a, doc_id AS b, CAST(1 AS DOUBLE) AS jaccard FROM d JOIN s USING (w) WHERE k < doc_id"""
)
def q_near_dup_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Links of a similarity of 0.85 between documents' word sets of any size: pairs of different sets, each named by its smallest
    id, and beside that every other document of a set with its name (similarity 1)."""
    words = F.regexp_extract_all(T.fold("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return similar_sets(table(spark, d, "documents"), "doc_id", words, least_tokens=1, copies=True).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


_URLS = "regexp_extract(strip_accents(lower(url_decode(string_split(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*(/[^?#]*)?', 1), '/+$', ''), '/')[-1]))), '^(.{2,})$', 1)"


@query(f"SELECT page_id, min(page_id) OVER (PARTITION BY g) AS kept, CAST(count(*) OVER (PARTITION BY g) - 1 AS BIGINT) AS merged FROM (SELECT page_id, CASE WHEN k = '' THEN 'page ' || page_id ELSE k END AS g FROM (SELECT page_id, {_URLS} AS k FROM pages))")
def q_dedupe_groups(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", F.regexp_extract(T.fold(T.url_basename("url")), r"^(.{2,})$", 1).alias("k"))
    w = W.partitionBy("g")
    p = p.withColumn("g", F.when(F.col("k") == "", F.concat(F.lit("page "), F.col("page_id"))).otherwise(F.col("k")))
    return p.select("page_id", F.min("page_id").over(w).alias("kept"), (F.count("*").over(w) - 1).alias("merged"))


@query(
    """SELECT doc_id, CAST(len(list_filter(a, lambda x: NOT list_contains(b, x))) AS BIGINT) AS unsupported FROM (SELECT d.doc_id, list_distinct(regexp_extract_all(d.text, '[0-9]+')) AS a, list_distinct(regexp_extract_all(coalesce(n.text, ''), '[0-9]+')) AS b
    FROM documents d LEFT JOIN documents n ON n.doc_id = d.doc_id + 1) WHERE len(a) > 0"""
)
def q_unsupported_numbers(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)).alias("n"))
    other = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("n").alias("m"))
    rows = docs.where(F.size("n") > 0).join(other, "doc_id", "left")
    missing = F.array_except("n", F.coalesce("m", F.array().cast("array<string>")))
    return rows.select("doc_id", F.size(missing).cast("bigint").alias("unsupported"))


@query("SELECT l_orderkey, l_linenumber, verified FROM (SELECT l_orderkey, l_linenumber, l_quantity AS verified, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber DESC) AS n FROM lineitem) WHERE n = 1")
def q_best_round(spark: SparkSession, d: str) -> DataFrame:
    rounds = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("verified"))
    return C.better_round(rounds, "l_orderkey", "verified", "l_linenumber")


_LEX = """WITH t AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '\\p{L}{4,}')) AS term FROM benchmark), n AS (SELECT item_id, count(*) AS n FROM t GROUP BY item_id),
h AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(substr(text, 1, 80)), '\\p{L}{4,}')) AS term FROM documents), b AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '\\p{L}{4,}')) AS term FROM documents),
f AS (SELECT doc_id, term, 1.0 AS w FROM h UNION ALL SELECT doc_id, term, 0.7 AS w FROM (SELECT * FROM b EXCEPT SELECT * FROM h)),
s AS (SELECT item_id, doc_id, CAST(round_even(least(1.0, CAST(sum(w) AS DOUBLE) / n), 4) AS DOUBLE) AS score FROM t JOIN n USING (item_id) JOIN f USING (term) GROUP BY item_id, doc_id, n)"""


def _lexical(spark: SparkSession, d: str) -> DataFrame:
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}{4,}"), F.lit(0)))
    topics = table(spark, d, "benchmark").select("item_id", words(F.col("text")).alias("terms"))
    feed = table(spark, d, "documents").select("doc_id", words(F.substring("text", 1, 80)).alias("title"), words(F.col("text")).alias("body"))
    return A.lexical_scores(topics, feed, "item_id", "terms", "doc_id", "title", "body")


@query(_LEX + " SELECT item_id, doc_id, score FROM s WHERE score >= 0.5")
def q_lexical_scores(spark: SparkSession, d: str) -> DataFrame:
    return _lexical(spark, d).where("score >= 0.5")


@query(
    _LEX
    + """, k AS (SELECT s.*, item_id % 7 AS sub FROM s WHERE score >= CASE WHEN item_id % 3 = 0 THEN 0.3 ELSE 0.5 END AND NOT (doc_id % 50 = item_id % 7)),
    best AS (SELECT *, row_number() OVER (PARTITION BY sub, doc_id ORDER BY score DESC, item_id) AS n FROM k), r AS (SELECT *, row_number() OVER (PARTITION BY sub ORDER BY score DESC, doc_id) AS rank FROM best WHERE n = 1)
    SELECT sub, doc_id, item_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3"""
)
def q_match(spark: SparkSession, d: str) -> DataFrame:
    topics = table(spark, d, "benchmark").select("item_id", (F.col("item_id") % 7).alias("sub"), F.when(F.col("item_id") % 3 == 0, 0.3).alias("min_score"))
    docs = table(spark, d, "documents").select("doc_id")
    seen = docs.select((F.col("doc_id") % 50).alias("sub"), "doc_id").where("sub < 7")
    return A.match(_lexical(spark, d), topics, seen, "sub", "item_id", "doc_id", 3, 0.5).select("sub", "doc_id", "item_id", "score", "rank")


_DOT = "list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) * list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])))"


@query(f"SELECT q.vec_id AS topic, v.vec_id, round(greatest(0.0, least(1.0, {_DOT})), 6) AS score FROM embeddings q JOIN embeddings v ON {_DOT} >= 0.6 WHERE q.vec_id % 20 = 0")
def q_embedding_scores(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    pairs = dense_pairs(e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "topic"), e, 0.6, "topic", "vec_id")
    return pairs.select("topic", "vec_id", F.round(F.greatest(F.lit(0.0), F.col("score")), 6).alias("score"))


@query("SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 2 = 1 AND (user_id, event_type) NOT IN (SELECT user_id, event_type FROM events WHERE event_id % 7 = 0)")
def q_new_labels(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return A.new_labels(e.where("event_id % 7 = 0"), e.where("event_id % 2 = 1").select("user_id", "event_type"), "user_id", "event_type")


@query(
    """WITH t(label, pattern, position) AS (VALUES ('en', 'the ', 1), ('fr', 'le ', 2), ('es', 'que ', 3)),
    h AS (SELECT conv_id, label, position, sum(len(regexp_extract_all(text, pattern))) AS hits FROM conversations, t WHERE role = 'user' GROUP BY conv_id, label, position)
    SELECT conv_id, label, CAST(hits AS BIGINT) AS hits, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY hits DESC, position) AS INTEGER) AS rank FROM h WHERE hits > 0"""
)
def q_theme_counts(spark: SparkSession, d: str) -> DataFrame:
    themes = spark.createDataFrame([("en", "the ", 1), ("fr", "le ", 2), ("es", "que ", 3)], "label string, pattern string, position int")
    found = A.theme_counts(table(spark, d, "conversations").where("role = 'user'"), "conv_id", "text", themes)
    return found.select("conv_id", "label", "hits", "rank")


def _runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings")
    runs = dense_topk(e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "case_id"), e, 21, "case_id", "vec_id").where("case_id <> vec_id")
    labels = e.select("vec_id", "label")
    cases = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("case_id"), "label").join(labels, "label").where("case_id <> vec_id").select("case_id", "vec_id")
    return cases, runs.select("case_id", "vec_id", "rank")


_RUNS = f"""WITH s AS (SELECT q.vec_id AS case_id, v.vec_id, q.label = v.label AS good, round(round({_DOT}, 9), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, vec_id) AS rank FROM s),
b AS (SELECT case_id, min(CASE WHEN good AND case_id <> vec_id AND rank <= 21 THEN rank END) AS best FROM r GROUP BY case_id)"""


@query(_RUNS + " SELECT case_id, best <= 20 AS hit FROM b WHERE best IS NOT NULL")
def q_recall(spark: SparkSession, d: str) -> DataFrame:
    cases, runs = _runs(spark, d)
    best = cases.join(runs, ["case_id", "vec_id"]).groupBy("case_id").agg(F.min("rank").alias("best"))
    return best.select("case_id", (F.col("best") <= 20).alias("hit"))


@query(_RUNS + " SELECT CAST(count(*) AS BIGINT) AS cases, round(count(*) FILTER (WHERE best <= 20) / count(*), 6) AS recall, round(coalesce(sum(CASE WHEN best <= 10 THEN 1.0 / best END), 0) / count(*), 6) AS mrr FROM b")
def q_mrr(spark: SparkSession, d: str) -> DataFrame:
    cases, runs = _runs(spark, d)
    return V.retrieval_metrics(cases, runs, "case_id", "vec_id")


@query(
    """SELECT event_type AS kind, CAST(count(*) AS BIGINT) AS cases, CAST(count(*) FILTER (WHERE value <= 10) AS BIGINT) AS passed, round_even(count(*) FILTER (WHERE value <= 10) / count(*), 4) AS rate, CAST(quantile_disc(value, 0.95) AS DOUBLE) AS p95 FROM events GROUP BY event_type"""
)
def q_suite_metrics(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("passed", F.coalesce(F.col("value") <= 10, F.lit(False))).withColumnRenamed("event_type", "kind")
    kinds = e.groupBy("kind").agg(F.count("*").alias("cases"), F.count_if("passed").alias("passed"))
    return kinds.join(nearest_ranks(e, ["kind"], "value", {"p95": 95}), "kind").select("kind", "cases", "passed", V.rate(F.col("passed"), F.col("cases")).alias("rate"), "p95")


@query(
    """WITH d AS (SELECT doc_id, source || ' ' || doc_id AS title, row_number() OVER (ORDER BY doc_id) - 1 AS slot, count(*) OVER () AS have FROM documents),
    g AS (SELECT i, ['direct_fact', 'date', 'amount', 'location', 'list', 'comparison', 'ambiguous', 'title_only', 'historical', 'unanswerable'][i % 10 + 1] AS kind, i < 60 AS ro, a.doc_id, a.title, b.title AS second
      FROM (SELECT unnest(generate_series(0, 99)) AS i) JOIN d a ON a.slot = i % a.have JOIN d b ON b.slot = (i + 1) % b.have)
    SELECT CASE WHEN ro THEN 'ro-' ELSE 'ru-' END || lpad((i + 1)::VARCHAR, 3, '0') AS id, CASE WHEN ro THEN 'ro' ELSE 'ru' END AS language, CASE WHEN i < 60 THEN 'tuning' WHEN i < 80 THEN 'validation' ELSE 'test' END AS split, kind,
      CASE kind WHEN 'ambiguous' THEN CASE WHEN ro THEN 'Care este bugetul proiectului?' ELSE 'Каков бюджет проекта?' END
        WHEN 'historical' THEN CASE WHEN ro THEN 'Ce informații erau raportate în 2022 despre «' || title || '»?' ELSE 'Какие сведения сообщались в 2022 году о «' || title || '»?' END
        WHEN 'unanswerable' THEN CASE WHEN ro THEN 'Care a fost temperatura exactă la inaugurare?' ELSE 'Какой была точная температура на открытии?' END
        WHEN 'comparison' THEN CASE WHEN ro THEN 'Compară faptele din «' || title || '» și «' || second || '».' ELSE 'Сравните факты из «' || title || '» и «' || second || '».' END
        ELSE CASE WHEN ro THEN 'Ce informații verificabile oferă documentul «' || title || '»?' ELSE 'Какие проверяемые сведения содержит документ «' || title || '»?' END END AS question,
      CASE WHEN kind = 'unanswerable' THEN 'UNANSWERABLE' ELSE 'ANSWERABLE' END AS answerable, CASE WHEN kind <> 'unanswerable' THEN doc_id END AS document_id, kind = 'ambiguous' AS clarification_expected, 'PENDING' AS review_status FROM g"""
)
def q_eval_candidates(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.concat_ws(" ", "source", F.col("doc_id").cast("string")).alias("title"))
    return V.evaluation_candidates(spark, docs, "doc_id", "title")


@query("SELECT DISTINCT page_id, title <> '' AS has_title, lower(regexp_replace(regexp_replace(title, '&[a-z]+;', '', 'g'), '[^\\p{L}]+', '', 'g')) AS title_letters FROM (SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages)")
def q_html_title(spark: SparkSession, d: str) -> DataFrame:
    from lexiforge.sources.pages import html_blocks

    t = html_blocks(table(spark, d, "pages"), "page_id", "html").select("page_id", "title").distinct()
    return t.select("page_id", F.col("title").isNotNull().alias("has_title"), F.lower(F.regexp_replace("title", r"[^\p{L}]+", "")).alias("title_letters"))


@query()
def q_split_exact(spark: SparkSession, d: str) -> DataFrame:
    """Evidence parts of all documents under 200 tokens; greedy, so proved by properties in tests."""
    return P.split_exact(table(spark, d, "documents"), "doc_id", "text", 200).select("doc_id", "part", F.sha2("quote", 256).alias("quote_hash"), "char_start", "char_end")


@query(
    f"""WITH RECURSIVE b AS (SELECT doc_id, t, len(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]')) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS ord FROM ({_LINES}) WHERE t <> ''),
    p AS (SELECT doc_id, ord, n AS held, 0 AS chunk FROM b WHERE ord = 0
      UNION ALL SELECT b.doc_id, b.ord, CASE WHEN floor(1.25 * (held + n) + 0.5) <= 420 THEN held + n ELSE n END, CASE WHEN floor(1.25 * (held + n) + 0.5) <= 420 THEN chunk ELSE chunk + 1 END FROM p JOIN b ON b.doc_id = p.doc_id AND b.ord = p.ord + 1)
    SELECT doc_id, chunk, CAST(count(*) AS INTEGER) AS n_passages, sha256(string_agg(t, chr(10) || chr(10) ORDER BY ord)) AS text_hash FROM p JOIN b USING (doc_id, ord) GROUP BY doc_id, chunk"""
)
def q_pack_passages(spark: SparkSession, d: str) -> DataFrame:
    """Lines of all documents packed into chunks of 420 tokens."""
    b = _line_blocks(spark, d).select("doc_id", F.col("ord").alias("passage_ord"), F.lit("paragraph").alias("type"), F.lit("").alias("heading"), F.col("block").alias("citation_text"))
    return P.pack_passages(b, "doc_id", 420).select("doc_id", "chunk", F.size("passages").alias("n_passages"), F.sha2("text", 256).alias("text_hash"))


@query(
    """WITH p AS (SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN ' Own title ' || page_id WHEN page_id % 3 = 1 THEN '  ' END AS own, CASE WHEN page_id % 5 > 0 THEN 'Page ' || page_id END AS given, page_id % 2 = 0 AS api, page_id % 4 = 0 AS ru FROM pages),
    t AS (SELECT *, CASE WHEN trim(coalesce(own, '')) <> '' THEN trim(own) ELSE given END AS title FROM p)
    SELECT page_id, title, CASE WHEN ru THEN 'ru' ELSE 'ro' END AS language, '2026-01-02' AS statistics_as_of, CASE WHEN page_id % 6 = 0 THEN 'unknown page' ELSE url END AS url, CASE WHEN api THEN title END AS quote,
    CASE WHEN api AND title IS NOT NULL THEN 'passage-' || substr(sha256(concat_ws(chr(31), page_id::VARCHAR, 'api_metadata', 'title', title)), 1, 16) END AS passage_id FROM t"""
)
def q_document_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Pages as documents with a manifest and, for some, a preface that says other things."""
    k = F.col("page_id")
    own = F.when(k % 3 == 0, F.concat(F.lit(" Own title "), k)).when(k % 3 == 1, "  ")
    pairs = F.array(F.struct(F.lit("Title").alias("k"), own.alias("v")), F.struct(F.lit("Language").alias("k"), F.when(k % 4 == 0, "ru").alias("v")), F.struct(F.lit("Source URL").alias("k"), F.when(k % 6 == 0, "unknown page").alias("v")))
    docs = table(spark, d, "pages").select(
        "page_id", k.cast("string").alias("document_id"), F.when(k % 5 > 0, F.concat(F.lit("Page "), k)).alias("title"), F.lit("City").alias("publisher"), F.lit("2026-01-02").alias("published_date"), F.lit(None).cast("string").alias("language"), "url",
        F.when(k % 2 == 0, "municipal_corpus_api").otherwise("webpage").alias("source_type"), F.lit("unknown").alias("document_type"), F.map_from_entries(F.filter(pairs, lambda x: x["v"].isNotNull())).alias("metadata"),
    )
    return P.structured_documents(docs).select("page_id", "title", "language", "statistics_as_of", "url", F.col("title_citation.quote").alias("quote"), F.col("title_citation.passage_id").alias("passage_id"))
