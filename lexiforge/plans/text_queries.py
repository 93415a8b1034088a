"""Queries of the scalar text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.functions import packs
from lexiforge.functions import text as T
from lexiforge.plans.query import query, table

EN = ("the", "and", "of", "to", "in")
FR = ("le", "la", "les", "des", "et")


@query("SELECT o_orderkey, 'ord-' || substr(sha256(CAST(o_orderkey AS VARCHAR) || chr(31) || o_orderstatus || chr(31) || o_orderpriority), 1, 16) AS stable_id FROM orders")
def q_stable_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", T.stable_id("ord", "o_orderkey", "o_orderstatus", "o_orderpriority").alias("stable_id"))


@query(
    "SELECT p_partkey, CASE WHEN s = '' THEN 'item' ELSE s END AS slug FROM (SELECT p_partkey, regexp_replace(regexp_replace(strip_accents(lower(p_name)), '[^a-z0-9._-]+', '-', 'g'), '^[-._]+|[-._]+$', '', 'g') AS s FROM part)"
)
def q_slug(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", T.safe_slug("p_name").alias("slug"))


@query(
    """SELECT doc_id, sha256(array_to_string(list_filter(list_transform(string_split(regexp_replace(text, '[  ]', ' ', 'g'), chr(10)),
    lambda x: trim(regexp_replace(x, '[ \\t\\r\\f]+', ' ', 'g'), ' ')), lambda x: x <> ''), chr(10))) AS text_hash FROM documents"""
)
def q_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(T.normalize_search_text("text"), 256).alias("text_hash"))


@query("SELECT doc_id, sha256(strip_accents(lower(text))) AS folded_hash FROM documents")
def q_fold(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(T.fold("text"), 256).alias("folded_hash"))


@query(
    """SELECT doc_id, CAST(count(*) FILTER (WHERE length(t) <= 160 AND length(t) > 0 AND regexp_matches(t, '\\p{L}') AND NOT regexp_matches(t, '\\p{Ll}')) AS BIGINT) AS heading_lines
    FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10))), ' ') AS t FROM documents) GROUP BY doc_id"""
)
def q_heading_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    return lines.groupBy("doc_id").agg(F.count_if(T.is_heading("line")).alias("heading_lines"))


@query(
    "SELECT doc_id, CAST(greatest(1, floor(1.25 * len(regexp_extract_all(text, '[\\p{L}\\p{N}_\\p{M}\\p{Pc}]+|[^\\p{L}\\p{N}_\\p{M}\\p{Pc}\\s]')) + 0.5)) AS BIGINT) AS tokens FROM documents"
)
def q_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.estimate_tokens("text").alias("tokens"))


@query(
    """SELECT page_id, CASE WHEN regexp_matches(lower(url), '\\.pdf($|[?#])') THEN 'pdf' WHEN regexp_matches(lower(url), '\\.(docx?|xlsx?)($|[?#])') THEN 'office_document'
    WHEN regexp_matches(lower(url), '\\.(png|jpe?g|gif)($|[?#])') THEN 'image' WHEN regexp_matches(lower(url), '^https?://') THEN 'webpage' ELSE 'text' END AS source_kind FROM pages"""
)
def q_source_kind(spark: SparkSession, d: str) -> DataFrame:
    from lexiforge.sources.artifacts import source_kind

    return table(spark, d, "pages").select("page_id", source_kind(F.col("url")).alias("source_kind"))


@query("SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, sha256(array_to_string(w, ' ')) AS tokens_hash FROM (SELECT doc_id, regexp_extract_all(lower(text), '\\p{L}{2,}') AS w FROM documents)")
def q_tokenize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").withColumn("w", T.tokenize_stem("text")).select("doc_id", F.size("w").cast("bigint").alias("n_tokens"), F.sha2(F.array_join("w", " "), 256).alias("tokens_hash"))


_SUFFIXES = " ".join(f"WHEN ends_with(w, '{x}') AND length(w) - {len(x)} >= 4 THEN left(w, length(w) - {len(x)})" for x in packs.RO_KEYWORD_SUFFIXES)
_STOPWORDS = ", ".join(f"'{x}'" for x in packs.STOPWORDS)


@query(
    f"""SELECT item_id, array_to_string(list(k ORDER BY pos), ' ') AS keywords FROM (SELECT item_id, k, min(pos) AS pos FROM (
    SELECT item_id, substr(CASE WHEN regexp_full_match(w, '[a-z0-9]+') THEN CASE {_SUFFIXES} ELSE w END ELSE w END, 1, 7) AS k, pos FROM (SELECT item_id, words[pos] AS w, pos FROM (SELECT item_id, words, unnest(generate_series(1, len(words))) AS pos FROM (
    SELECT item_id, list_filter(regexp_extract_all(strip_accents(lower(text)), '{packs.KEYWORD_TOKEN}{{3,}}'), lambda x: NOT regexp_full_match(x, '[0-9]+') AND x NOT IN ({_STOPWORDS})) AS words FROM benchmark)))) GROUP BY item_id, k) GROUP BY item_id"""
)
def q_keywords(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", F.array_join(T.keywords("text"), " ").alias("keywords")).where("keywords <> ''")


@query(
    """WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS t FROM documents),
    h AS (SELECT doc_id, t, substr(t, 1, 79) AS h FROM t), a AS (SELECT doc_id, t, h, length(h) - length(string_split(h, ' ')[-1]) AS cut_at FROM h)
    SELECT doc_id, CASE WHEN length(t) <= 80 THEN t ELSE regexp_replace(CASE WHEN instr(h, ' ') > 0 AND cut_at > 40 THEN substr(h, 1, cut_at - 1) ELSE h END, '[\\s,.;:!?-]+$', '') || '…' END AS clipped FROM a"""
)
def q_clip(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.clip("text", 80).alias("clipped"))


@query(
    """SELECT doc_id, CAST(en AS BIGINT) AS en_hits, CAST(fr AS BIGINT) AS fr_hits, CASE WHEN en > fr THEN 'en' WHEN fr > en THEN 'fr' WHEN regexp_matches(text, '[äöüß]') THEN 'de' ELSE 'es' END AS guess FROM (
    SELECT doc_id, text, len(list_filter(w, lambda x: x IN ('the', 'and', 'of', 'to', 'in'))) AS en, len(list_filter(w, lambda x: x IN ('le', 'la', 'les', 'des', 'et'))) AS fr FROM (
    SELECT doc_id, text, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+') AS w FROM documents))"""
)
def q_language_votes(spark: SparkSession, d: str) -> DataFrame:
    guess = T.detect_language("text", F.lit(None).cast("string"), {"en": EN, "fr": FR}, {"de": "[äöüß]"}, {}, "es")
    return table(spark, d, "documents").select("doc_id", T.count_words("text", EN).cast("bigint").alias("en_hits"), T.count_words("text", FR).cast("bigint").alias("fr_hits"), guess.alias("guess"))


@query(
    """SELECT o_orderkey, array_to_string(list_sort(list_distinct(list_concat([year(o_orderdate)], generate_series(year(o_orderdate), year(o_orderdate) + CAST(o_orderkey % 4 AS INTEGER))))), ',') AS years FROM orders"""
)
def q_years(spark: SparkSession, d: str) -> DataFrame:
    y = F.year("o_orderdate")
    text = F.concat(F.lit("placed "), F.date_format("o_orderdate", "dd.MM.yyyy"), F.lit(" valid "), y.cast("string"), F.lit("-"), (y + F.col("o_orderkey") % 4).cast("string"))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(T.years_in(text), ",").alias("years"))


@query(
    """SELECT doc_id, array_to_string(list(a ORDER BY a), ' ') AS acronyms FROM (SELECT DISTINCT doc_id, a FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}\\p{M}_]+')) AS a FROM documents)
    WHERE regexp_full_match(a, '[A-ZĂÂÎȘȚ]{3,8}') AND a NOT IN ('III', 'VII', 'VIII', 'XII', 'XIV', 'XV', 'XX', 'XXI', 'ANEXA', 'NOTA', 'PDF', 'SRL', 'ORDON', 'DECIDE')) GROUP BY doc_id"""
)
def q_acronyms(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "documents").select("doc_id", F.array_sort(T.acronyms("text")).alias("a"))
    return found.where(F.size("a") > 0).select("doc_id", F.array_join("a", " ").alias("acronyms"))


@query(
    """SELECT page_id, regexp_matches(url, '^https?://[^/?#]+') AS valid, regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host,
    url_decode(string_split(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*(/[^?#]*)?', 1), '/+$', ''), '/')[-1]) AS basename FROM pages"""
)
def q_url_parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.valid_url("url").alias("valid"), F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit("")).alias("host"), T.url_basename("url").alias("basename"))


@query("SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '[.!?]+(\\s+|$)'), lambda x: trim(x, ' ') <> '')) AS BIGINT) AS sentences FROM documents")
def q_sentence_count(spark: SparkSession, d: str) -> DataFrame:
    parts = F.filter(F.split("text", r"[.!?]+(\s+|$)", -1), lambda s: F.trim(s) != "")
    return table(spark, d, "documents").select("doc_id", F.size(parts).cast("bigint").alias("sentences"))


@query(
    """SELECT page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), 'https?://\\S+', ' ', 'g'), '\\[S[0-9]+\\]', ' ', 'g'), '[*_`#>|]+', ' ', 'g'), '\\s+', ' ', 'g'), ' ')) AS speech_hash FROM pages"""
)
def q_strip_markup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.sha2(T.speech_text("html"), 256).alias("speech_hash"))


@query(
    """SELECT o_orderkey, try_cast(substr(s, 1, 10) AS DATE) AS parsed FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'undated' ELSE strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00' END AS s FROM orders)"""
)
def q_try_date(spark: SparkSession, d: str) -> DataFrame:
    s = F.when(F.col("o_orderkey") % 3 == 0, "undated").otherwise(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00")))
    return table(spark, d, "orders").select("o_orderkey", T.parse_iso_date(s).alias("parsed"))


@query(
    """SELECT conv_id, turn, contains(strip_accents(lower(text)), 'cannot') OR contains(strip_accents(lower(text)), 'sorry') OR contains(strip_accents(lower(text)), 'no se') AS unanswered FROM conversations"""
)
def q_refusals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", T.contains_any("text", ("cannot", "sorry", "no se")).alias("unanswered"))


@query(
    """SELECT bucket, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN days <= 0 THEN 'today' WHEN days = 1 THEN 'yesterday' WHEN days <= 7 THEN 'last_7_days' WHEN days <= 30 THEN 'last_30_days' ELSE 'older' END AS bucket
    FROM (SELECT date_diff('day', CAST(ts AS DATE), DATE '2024-01-31') AS days FROM events)) GROUP BY bucket"""
)
def q_recency_bucket(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(T.recency_bucket("ts", F.lit("2024-01-31").cast("date")).alias("bucket")).agg(F.count("*").alias("n"))


@query(
    """SELECT a.vec_id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) * list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 6) AS cosine
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""
)
def q_cosine(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(T.cosine("embedding", "other"), 6).alias("cosine"))


@query("SELECT event_id, json_extract_string(props, '$.' || k) AS value, k AS name FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def q_json_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("name", "value"))


@query("SELECT s_suppkey, trim(regexp_replace(strip_accents(lower(s_name)), '[^\\p{L}\\p{N}_]+', ' ', 'g'), ' ') AS label FROM supplier")
def q_label(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select("s_suppkey", T.normalize_label("s_name").alias("label"))


@query("SELECT c_custkey, coalesce(nullif(trim(CASE WHEN c_custkey % 3 = 0 THEN '  ' ELSE c_name END), ''), nullif(trim(c_mktsegment), ''), 'none') AS shown FROM customer")
def q_first_non_blank(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", T.first_non_blank(F.when(F.col("c_custkey") % 3 == 0, "  ").otherwise(F.col("c_name")), "c_mktsegment", F.lit("none")).alias("shown"))
