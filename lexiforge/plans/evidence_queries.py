"""Queries of question rules, facts, evidence rows, claims, answers and topic upkeep.

Where a table has no text of the kind that an operator reads, the text is made of the table's columns, in Spark and in SQL alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.functions import packs
from lexiforge.functions import text as T
from lexiforge.operators import alerts as A
from lexiforge.operators import claims as C
from lexiforge.operators import corpus as P
from lexiforge.operators import evaluation as V
from lexiforge.operators import facts as K
from lexiforge.operators import interpret as I
from lexiforge.operators import relational as R
from lexiforge.operators import search as S
from lexiforge.operators import validation as Q
from lexiforge.plans.query import query, table
from lexiforge.store import materialize

_MONTHS = "[" + ", ".join(f"'{m}'" for m in K.MONTHS_RO) + "]"


def _plain(kind: str) -> str:
    return "(?i)" + packs.FACTS[kind]


def _found(kind: str) -> str:
    """All matches of a family of facts in `text`."""
    return f"array_to_string(regexp_extract_all(text, '{_plain(kind)}', 0), '|')"


def _listed(values: tuple[str, ...]) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _cut_suffix(w: str, suffixes: tuple[str, ...], keep: int = 4) -> str:
    cases = " ".join(f"WHEN ends_with({w}, '{s}') AND length({w}) - {len(s)} >= {keep} THEN left({w}, length({w}) - {len(s)})" for s in suffixes)
    return f"CASE {cases} ELSE {w} END"


# ---------------------------------------------------------------- words and questions


@query(f"SELECT doc_id, sha256(array_to_string(list_transform(regexp_extract_all(lower(text), '\\p{{L}}{{2,}}'), lambda w: {_cut_suffix('w', packs.RO_SUFFIXES)}), ' ')) AS stems_hash FROM documents")
def q_stems(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(F.array_join(T.tokenize_stem("text", packs.RO_SUFFIXES), " "), 256).alias("stems_hash"))


_VOTES = "regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+')"


@query(
    f"""SELECT conv_id, turn, CASE WHEN regexp_matches(text, '{packs.SCRIPTS["ru"]}') THEN 'ru' WHEN en > ro THEN 'en' WHEN ro > en THEN 'ro' WHEN regexp_matches(text, '{packs.MARKS["ro"]}') THEN 'ro' ELSE 'ro' END AS language
    FROM (SELECT *, len(list_filter({_VOTES}, lambda x: x IN {_listed(packs.EN_WORDS)})) AS en, len(list_filter({_VOTES}, lambda x: x IN {_listed(packs.RO_WORDS)})) AS ro FROM conversations)"""
)
def q_language(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", T.detect_language("text", F.lit(None).cast("string"), known=packs.LANGUAGES).alias("language"))


_ASKED = "CASE o_orderkey % 5 WHEN 0 THEN 'Care este programul de lucru?' WHEN 1 THEN 'Ce legi sunt despre ' || o_orderpriority WHEN 2 THEN 'What are the opening hours?' WHEN 3 THEN 'Cât costă impozitul?' ELSE 'Înscrierea în clasa I' END"


@query(
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'hours' WHEN 1 THEN 'legal_act' WHEN 2 THEN 'hours' ELSE CASE WHEN o_orderstatus = 'F' THEN 'amount' ELSE 'other' END END AS answer_type, o_orderkey % 5 >= 3 AS yearly FROM orders"""
)
def q_answer_types(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("q", F.expr(_ASKED))
    hint = F.when(F.col("o_orderstatus") == "F", "amount").otherwise("nonsense")
    return o.select("o_orderkey", I.answer_type("q", hint).alias("answer_type"), I.is_yearly("q").alias("yearly"))


@query(
    "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'botanica' ELSE '' END AS sectors, string_split(p_name, ' ')[-1] AS street FROM part WHERE regexp_full_match(p_name, '[a-z]+ [a-z]{4,}')"
)
def q_places(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").where(F.col("p_name").rlike("^[a-z]+ [a-z]{4,}$"))
    text = F.concat(F.when(F.col("p_partkey") % 2 == 0, "În sectorul Botanica, ").otherwise("În centru, "), F.lit("pe str. "), F.col("p_name"), F.lit(", 5"))
    return p.select("p_partkey", F.array_join(T.sectors_in(text), ",").alias("sectors"), F.array_join(T.street_keys(text), ",").alias("street"))


@query(
    """SELECT o_orderkey, 'Ordinul nr. ' || o_orderkey || ' — plata ' || o_orderpriority || ' · primaria.md · ' || strftime(o_orderdate, '%d.%m.%Y') AS label FROM orders"""
)
def q_choice_labels(spark: SparkSession, d: str) -> DataFrame:
    title = F.concat(F.lit("ORDINUL  nr. "), F.col("o_orderkey"), F.lit(" din "), F.date_format("o_orderdate", "dd.MM.yyyy"), F.lit(" cu privire la plata "), F.col("o_orderpriority"))
    subject = T.readable_subject(title, F.lit(None).cast("string"))
    return table(spark, d, "orders").select("o_orderkey", T.choice_label(subject, F.lit("primaria.md"), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("label"))


@query(
    """SELECT p_partkey, CASE WHEN length(k) >= 30 THEN k END AS title_key, CASE WHEN p_size % 2 = 0 THEN false ELSE p_name LIKE 'anexa%' END OR p_partkey % 3 = 0 AS noise FROM (SELECT *, trim(regexp_replace(strip_accents(lower(p_name || ' ' || p_brand || ' ' || p_type || ' ' || p_size)), '[^\\p{L}\\p{N}_]+', ' ', 'g'), ' ') AS k FROM part)"""
)
def q_titles(spark: SparkSession, d: str) -> DataFrame:
    title = F.concat_ws(" ", "p_name", "p_brand", "p_type", "p_size")
    noisy = F.concat(F.when(F.col("p_partkey") % 3 == 0, "Anexa ").otherwise("Parcul "), F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", T.title_key(title).alias("title_key"), T.title_noise(noisy).alias("noise"))


@query("SELECT supplier.s_suppkey, round(CAST('0x' || substr(sha256(s_name || ':0'), 1, 8) AS UBIGINT) / 4294967295.0 * 2 - 1, 9) AS first_value FROM supplier")
def q_mock_embedding(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select("s_suppkey", F.round(F.element_at(T.hash_embedding("s_name"), 1), 9).alias("first_value"))


@query("SELECT conv_id, turn, text AS answer, false AS outdated, CAST(turn % 3 AS BIGINT) AS n_citations FROM conversations")
def q_replies(spark: SparkSession, d: str) -> DataFrame:
    cites = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), (F.col("turn") % 3).cast("int"))), lambda i: F.struct(F.concat(F.lit("S"), i).alias("id")))
    body = F.to_json(F.struct(F.lit("SUPPORTED").alias("status"), F.col("text").alias("answer"), F.when(F.col("turn") % 3 > 0, cites).otherwise(F.slice(cites, 1, 0)).alias("citations"), F.lit(1).alias("extra")))
    r = table(spark, d, "conversations").select("conv_id", "turn", I.parse_reply(body).alias("r"))
    return r.select("conv_id", "turn", "r.answer", "r.outdated", F.size("r.citations").cast("bigint").alias("n_citations"))


# ---------------------------------------------------------------- blocks, events, facts


@query(
    """WITH l AS (SELECT doc_id, pos AS line, regexp_replace(l[pos], '\\s+$', '') AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(generate_series(1, len(string_split(text, chr(10))))) AS pos FROM documents)),
    g AS (SELECT *, sum(CASE WHEN t = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS gap FROM l),
    b AS (SELECT doc_id, min(line) AS a, max(line) AS z, string_agg(t, chr(10) ORDER BY line) AS block FROM g WHERE t <> '' GROUP BY doc_id, gap)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS INTEGER) AS ord, sha256(block) AS block_hash, CAST(a AS INTEGER) AS start_line, CAST(z AS INTEGER) AS end_line FROM b"""
)
def q_blocks(spark: SparkSession, d: str) -> DataFrame:
    return P.split_blocks(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "ord", F.sha2("block", 256).alias("block_hash"), "start_line", "end_line")


@query(
    """WITH t AS (SELECT doc_id, page, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '\\s+$', '')), lambda x: x <> '')) AS block FROM (SELECT doc_id, 1 AS page, text FROM documents UNION ALL SELECT doc_id, 2, 'closing page' FROM documents))
    SELECT doc_id, CAST(count(*) FILTER (WHERE page = 2) AS BIGINT) AS closing, sum(length(block)) > 0 AS filled FROM t GROUP BY doc_id"""
)
def q_page_blocks(spark: SparkSession, d: str) -> DataFrame:
    pages = F.array(F.struct(F.lit(1).alias("page"), F.col("text").alias("text")), F.struct(F.lit(2).alias("page"), F.lit("closing page").alias("text")))
    b = P.page_blocks(table(spark, d, "documents").select("doc_id", pages.alias("pages")), "doc_id")
    return b.groupBy("doc_id").agg(F.count_if(F.col("page") == 2).alias("closing"), (F.sum(F.length("block")) > 0).alias("filled"))


@query("SELECT conv_id, CAST(count(*) AS BIGINT) AS blocks, CAST(max(turn) + 1 AS BIGINT) AS last_ord FROM conversations GROUP BY conv_id")
def q_scraper_blocks(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    line = F.regexp_replace("text", r"\s+", " ")
    docs = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("t")))), lambda x: F.struct(x["turn"].cast("int").alias("page"), x["t"].alias("text"))).alias("p"))
    docs = docs.select("conv_id", F.slice("p", F.lit(1), F.size("p") - 1).alias("pages"), F.element_at("p", -1)["text"].alias("text"))
    b = P.scraper_blocks(docs, "conv_id")
    return b.groupBy("conv_id").agg(F.count("*").alias("blocks"), (F.max("ord") + 1).cast("bigint").alias("last_ord"))


@query(
    "SELECT o_orderkey, 'Târg ' || o_orderpriority AS title, 'Piața ' || o_orderstatus AS location, strftime(o_orderdate, '%d.%m.%Y') AS period_raw, CASE WHEN o_orderkey % 2 = 0 THEN 'acces liber' ELSE '' END AS unrecognized FROM orders"
)
def q_events(spark: SparkSession, d: str) -> DataFrame:
    more = F.when(F.col("o_orderkey") % 2 == 0, "\nacces liber").otherwise("")
    text = F.concat(F.lit("Târg "), F.col("o_orderpriority"), F.lit(".\nLocația: Piața "), F.col("o_orderstatus"), F.lit(".\nPerioada: "), F.date_format("o_orderdate", "dd.MM.yyyy"), more)
    e = table(spark, d, "orders").select("o_orderkey", T.parse_event(text).alias("e"))
    return e.select("o_orderkey", "e.title", "e.location", "e.period_raw", F.array_join("e.unrecognized", "|").alias("unrecognized"))


@query(
    "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_type WHEN p_size % 3 = 1 THEN 'administrative_document' ELSE 'municipal_document' END AS doc_type, CASE WHEN p_size % 2 = 0 THEN 'table' ELSE 'headline' END AS kind FROM part"
)
def q_types(spark: SparkSession, d: str) -> DataFrame:
    declared = F.when(F.col("p_size") % 3 == 0, F.col("p_type")).otherwise("unknown")
    source = F.when(F.col("p_size") % 3 == 1, "pdf").otherwise("other")
    block = F.when(F.col("p_size") % 2 == 0, "Data_Table").otherwise("sub_heading")
    return table(spark, d, "part").select("p_partkey", T.doc_type(declared, source).alias("doc_type"), T.evidence_kind(block).alias("kind"))


def _passages(df: DataFrame, key: str, text, type_: str = "paragraph", period=None) -> DataFrame:
    return df.select(F.col(key).cast("string").alias("passage_id"), F.lit(type_).alias("type"), text.alias("search_text"), (F.lit(None).cast("string") if period is None else period).alias("period_raw"))


@query(
    "SELECT CAST(o_orderkey AS VARCHAR) AS passage_id, CAST(o_orderdate AS DATE) AS date_value, CAST(2 AS BIGINT) AS n, NULL AS warning FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT CAST(o_orderkey AS VARCHAR), NULL, CAST(0 AS BIGINT), 'INVALID_DATE_IGNORED' FROM orders WHERE o_orderkey % 7 = 0"
)
def q_date_facts(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    months = F.array(*[F.lit(m) for m in K.MONTHS_RO])
    good = F.concat(F.lit("Livrat la "), F.dayofmonth("o_orderdate"), F.lit(" "), F.element_at(months, F.month("o_orderdate")), F.lit(" "), F.year("o_orderdate"), F.lit(", plătit la "), F.date_format("o_orderdate", "dd.MM.yyyy"), F.lit(" de client"))
    bad = F.concat(F.lit("Livrat la 31 februarie "), F.year("o_orderdate"))
    facts, warnings = K.date_facts(_passages(o, "o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, bad).otherwise(good)))
    dated = facts.groupBy("passage_id", "date_value").agg(F.count("*").alias("n")).withColumn("warning", F.lit(None).cast("string"))
    return dated.unionByName(warnings.select("passage_id", F.lit(None).cast("date").alias("date_value"), F.lit(0).cast("bigint").alias("n"), "warning"))


@query(
    """SELECT CAST(o_orderkey AS VARCHAR) AS passage_id, make_date(year(o_orderdate), month(o_orderdate), 1 + o_orderkey % 20) AS start_date, make_date(year(o_orderdate), month(o_orderdate), 4 + o_orderkey % 20) AS end_date, NULL AS warning FROM orders WHERE o_orderkey % 5 <> 0
    UNION ALL SELECT CAST(o_orderkey AS VARCHAR), NULL, NULL, 'EVENT_YEAR_MISSING' FROM orders WHERE o_orderkey % 5 = 0"""
)
def q_event_intervals(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    day = lambda n: F.lpad((F.col("o_orderkey") % 20 + n).cast("string"), 2, "0")
    period = F.concat(day(1), F.lit("-"), day(4), F.date_format("o_orderdate", ".MM"), F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.date_format("o_orderdate", ".yyyy")))
    facts, warnings = K.event_intervals(_passages(o, "o_orderkey", F.lit("Târg"), "municipal_event", period))
    none = F.lit(None).cast("date")
    return facts.select("passage_id", "start_date", "end_date", F.lit(None).cast("string").alias("warning")).unionByName(warnings.select("passage_id", none.alias("start_date"), none.alias("end_date"), "warning"))


@query(
    "SELECT CAST(p_partkey AS VARCHAR) AS passage_id, 'exact' AS qualifier, 'echipe' AS unit, CAST(p_size AS BIGINT) AS int_value FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'lower_bound', 'case', CAST(p_size * 1000 AS BIGINT) FROM part"
)
def q_numeric_facts(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("Lucrează "), F.col("p_size"), F.lit(" echipe, peste "), F.col("p_size"), F.lit(" mii de case"))
    return K.numeric_facts(_passages(table(spark, d, "part"), "p_partkey", text)).select("passage_id", "qualifier", "unit", "int_value")


@query(
    f"""WITH t AS (SELECT o_orderkey, 'Costă ' || o_orderkey || ' lei din ' || strftime(o_orderdate, '%d.%m.%Y') || ' și durează 3 luni din ' || year(o_orderdate) || '.' AS text FROM orders)
    SELECT o_orderkey, {_found("amounts")} AS amount, {_found("dates")} AS dates, {_found("durations")} AS durations, CAST(len(regexp_extract_all(text, '{_plain("counts")}', 0)) AS BIGINT) AS counts FROM t"""
)
def q_fact_matches(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("Costă "), F.col("o_orderkey"), F.lit(" lei din "), F.date_format("o_orderdate", "dd.MM.yyyy"), F.lit(" și durează 3 luni din "), F.year("o_orderdate"), F.lit("."))
    f = table(spark, d, "orders").select("o_orderkey", T.fact_matches(text).alias("f"))
    return f.select("o_orderkey", F.array_join("f.amounts", "|").alias("amount"), F.array_join("f.dates", "|").alias("dates"), F.array_join("f.durations", "|").alias("durations"), F.size("f.counts").cast("bigint").alias("counts"))


# ---------------------------------------------------------------- evidence


_TURNS = """WITH t AS (SELECT conv_id, turn, role, text, 'Chat ' || conv_id || ' | ' || role || CASE WHEN conv_id % 2 = 0 THEN ' | Data publicării: 2026-01-02' ELSE '' END AS context,
array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[ \\t\\r\\f]+', ' ', 'g'), ' ')), lambda x: x <> ''), chr(10)) AS search_text FROM conversations)"""


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    name = F.concat(F.lit("Chat "), F.col("conv_id"))
    docs = c.select("conv_id").distinct().select(
        F.col("conv_id").cast("string").alias("document_id"), F.lit("v1").alias("version_id"), name.alias("title"), F.when(F.col("conv_id") % 2 == 0, "2026-01-02").alias("published_date"), F.lit(None).cast("string").alias("district")
    )
    passages = c.select(
        F.col("conv_id").cast("string").alias("document_id"), F.col("turn").cast("string").alias("passage_id"), F.lit("list_item").alias("type"), F.array(F.concat(F.lit("# "), name), F.col("role")).alias("heading_path"),
        F.col("text").alias("citation_text"), (F.col("turn") % 5 != 4).alias("validated"), F.lit(None).cast("array<string>").alias("issues"),
    )
    return P.build_evidence(docs, passages, 1 << 20)


@query(
    _TURNS
    + """ SELECT CAST(conv_id AS VARCHAR) AS document_id, CAST(turn AS VARCHAR) AS passage_id, sha256(context || chr(10) || chr(10) || search_text) AS text_sha256, 'list' AS evidence_kind,
    CASE WHEN turn % 5 <> 4 AND length(text) - length(replace(text, '?', '')) <= greatest(4.0, length(text) / 30.0) AND NOT (len(w) >= 10 AND len(list_filter(w, lambda x: length(x) = 1)) > 0.4 * len(w)) THEN 'READY' ELSE 'NEEDS_REVIEW' END AS indexing_status
    FROM (SELECT *, regexp_extract_all(text, '\\p{L}+') AS w FROM t) WHERE trim(text, ' ') <> ''"""
)
def q_build_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Every turn as a passage of its conversation, under a limit that no turn reaches: how a passage is cut is greedy, and held by
    properties in the tests."""
    return _evidence(spark, d).select("document_id", "passage_id", "text_sha256", "evidence_kind", "indexing_status")


@query(
    """WITH t AS (SELECT conv_id, turn // 3 AS chunk, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS body, count(*) AS n, max(turn) AS last FROM conversations GROUP BY conv_id, turn // 3)
    SELECT CAST(conv_id AS VARCHAR) AS document_id, CAST(chunk AS BIGINT) AS chunk, sha256('Chat ' || conv_id || ' | Publicat: 2026-01-02' || chr(10) || chr(10) || body) AS text_hash, CAST(n + 1 AS BIGINT) AS citations, CASE WHEN last % 3 = 1 THEN 'CITATION_PENDING' ELSE 'READY' END AS status FROM t"""
)
def q_merge_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    last = F.col("turn") % 3 == 1
    from pyspark.sql import Window as W

    ends = F.col("turn") == F.max("turn").over(W.partitionBy("conv_id", F.floor(F.col("turn") / 3)))
    p = c.select(
        F.col("conv_id").cast("string").alias("document_id"), F.floor(F.col("turn") / 3).alias("chunk"), F.col("turn").alias("passage_ord"), F.concat_ws("/", "conv_id", "turn").alias("passage_id"),
        F.array().cast("array<string>").alias("heading_path"), F.col("text").alias("search_text"), F.col("text").alias("citation_text"), F.lit(True).alias("data_ok"), (~(ends & last)).alias("citations_ok"),
    )
    docs = c.select("conv_id").distinct().select(
        F.col("conv_id").cast("string").alias("document_id"), F.concat(F.lit("Chat "), F.col("conv_id")).alias("title"), F.lit("2026-01-02").alias("published_date"),
        F.struct(F.lit("t").alias("passage_id"), F.lit("title").alias("quote")).alias("title_citation"), F.lit(True).alias("data_ok"), F.lit(True).alias("citations_ok"),
    )
    return P.merge_chunk(docs, p).select("document_id", "chunk", F.sha2("text", 256).alias("text_hash"), F.size("citations").cast("bigint").alias("citations"), "status")


@query(
    """WITH p AS (SELECT conv_id, turn // 2 AS passage, string_agg(text, ' ' ORDER BY turn) AS t, CASE WHEN (turn // 2) % 2 = 0 THEN 2 ELSE 1000000000 END AS page FROM conversations GROUP BY conv_id, turn // 2)
    SELECT conv_id, CAST(passage AS BIGINT) AS passage, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY page, passage) - 1 AS INTEGER) AS place, sha256(t) AS text_hash FROM p"""
)
def q_source_previews(spark: SparkSession, d: str) -> DataFrame:
    passage = F.floor(F.col("turn") / 2)
    e = table(spark, d, "conversations").select(
        F.col("conv_id").alias("document_id"), F.lit("v").alias("version_id"), passage.alias("passage_id"), F.lpad("turn", 6, "0").alias("evidence_id"), F.col("text").alias("citation_text"), F.col("turn").cast("int").alias("char_start"),
        F.when(passage % 2 == 0, 2).alias("page"), passage.cast("int").alias("start_line"), F.lit(None).cast("int").alias("block_index"),
    )
    return P.source_previews(e).select(F.col("document_id").alias("conv_id"), F.col("passage_id").alias("passage"), "place", F.sha2("text", 256).alias("text_hash"))


# ---------------------------------------------------------------- claims and answers


_LINES = "(SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_quantity) AS l_quantity, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus FROM lineitem GROUP BY l_orderkey, l_linenumber)"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """One row for each line number of an order."""
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")])


def _claims(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    li = materialize(_lines(spark, d), "lines")  # both are made of it
    named = lambda n: F.concat(F.lit("Linia are "), F.col("l_partkey") + n, F.lit(" bucăți."))
    claims = li.select(
        F.col("l_orderkey").cast("string").alias("question_id"), F.col("l_linenumber").alias("claim_no"), named(F.when(F.col("l_linestatus") == "F", 1).otherwise(0)).alias("text"), F.lit("Câte?").alias("question"),
        F.when(F.col("l_returnflag") == "R", F.array(F.lit("none"))).otherwise(F.array(F.col("l_linenumber").cast("string"))).alias("evidence_ids"),
    )
    evidence = li.select(
        F.col("l_orderkey").cast("string").alias("question_id"), F.col("l_linenumber").cast("string").alias("evidence_id"), F.concat(F.lit("Documentul spune: "), named(0)).alias("quote"),
        F.concat(F.lit("d"), F.col("l_suppkey")).alias("document_id"), F.col("l_quantity").alias("score"),
    )
    return claims, evidence


@query(
    "SELECT CAST(l_orderkey AS VARCHAR) AS question_id, l_linenumber AS claim_no, CASE WHEN l_returnflag = 'R' THEN 'UNKNOWN_EVIDENCE' WHEN l_linestatus = 'F' THEN 'UNSUPPORTED_NUMBER:' || (l_partkey + 1) ELSE '' END AS issues FROM " + _LINES
)
def q_claim_issues(spark: SparkSession, d: str) -> DataFrame:
    return C.deterministic_issues(*_claims(spark, d)).select("question_id", "claim_no", F.array_join("issues", ",").alias("issues"))


@query(
    """SELECT CAST(l_orderkey AS VARCHAR) AS question_id, CAST(count(*) FILTER (WHERE l_returnflag <> 'R' AND l_linestatus <> 'F' AND l_linenumber % 2 = 1) AS BIGINT) AS verified, CAST(count(*) FILTER (WHERE NOT (l_returnflag <> 'R' AND l_linestatus <> 'F' AND l_linenumber % 2 = 1)) AS BIGINT) AS rejected FROM """ + _LINES + " GROUP BY l_orderkey"
)
def q_verified_claims(spark: SparkSession, d: str) -> DataFrame:
    claims, evidence = _claims(spark, d)
    verdicts = claims.where("claim_no % 3 <> 0 or claim_no % 2 = 1").select("question_id", "claim_no", (F.col("claim_no") % 2 == 1).alias("supported"), F.lit("NOT_SAID").alias("reason"))
    good, bad = C.verify(claims, evidence, verdicts)
    both = good.select("question_id", F.lit(1).alias("v")).unionByName(bad.select("question_id", F.lit(0).alias("v")))
    return both.groupBy("question_id").agg(F.sum("v").alias("verified"), F.count_if(F.col("v") == 0).alias("rejected"))


@query(
    f"""WITH lines AS {_LINES}, c AS (SELECT l_orderkey, l_linenumber, l_suppkey FROM lines WHERE l_returnflag <> 'R'), f AS (SELECT l_orderkey, l_suppkey, min(l_linenumber) AS first FROM c GROUP BY l_orderkey, l_suppkey),
    n AS (SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY first) AS no FROM f),
    a AS (SELECT l_orderkey, string_agg('Linia ' || l_linenumber || ' este gata. [S' || no || ']', chr(10) ORDER BY l_linenumber) AS answer, count(*) AS kept, max(no) AS cited FROM c JOIN n USING (l_orderkey, l_suppkey) GROUP BY l_orderkey),
    t AS (SELECT l_orderkey, count(*) AS total FROM lines GROUP BY l_orderkey)
    SELECT CAST(t.l_orderkey AS VARCHAR) AS question_id, answer, CAST(cited AS BIGINT) AS citations, CAST(total - coalesce(kept, 0) AS BIGINT) AS dropped FROM t LEFT JOIN a ON a.l_orderkey = t.l_orderkey"""
)
def q_answers(spark: SparkSession, d: str) -> DataFrame:
    li = materialize(_lines(spark, d), "lines")  # claims and what is known are made of it
    cited = F.array(F.when(F.col("l_returnflag") == "R", "none").otherwise(F.col("l_suppkey").cast("string")))
    claims = li.select(F.col("l_orderkey").cast("string").alias("question_id"), F.col("l_linenumber").alias("claim_no"), F.concat(F.lit("Linia "), F.col("l_linenumber"), F.lit(" este gata.")).alias("text"), cited.alias("evidence_ids"))
    known = li.where("l_returnflag <> 'R'").select(F.col("l_orderkey").cast("string").alias("question_id"), F.col("l_suppkey").cast("string").alias("evidence_id"))
    return C.render_answers(claims, known).select("question_id", "answer", F.size("citations").cast("bigint").alias("citations"), F.col("dropped").cast("bigint").alias("dropped")).withColumn("citations", F.when(F.col("answer").isNotNull(), F.col("citations")))


@query(
    """SELECT CAST(o_orderkey AS VARCHAR) AS question_id, CASE o_orderkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN o_orderstatus = 'F' ELSE true END AS has_value FROM orders"""
)
def q_expected_values(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("question_id", F.col("o_orderkey").cast("string"))
    n = F.col("o_orderkey") % 4
    text = F.when(n == 0, F.concat(F.lit("Costă "), F.col("o_orderkey"), F.lit(" lei."))).when(n == 1, "Se achită la ghișeu.").when(n == 2, "Părinții depun cererea online.").otherwise("Oricare.")
    claims = o.select("question_id", text.alias("text"), F.array(F.lit("S1")).alias("evidence_ids"))
    kinds = o.select("question_id", F.when(n == 0, "amount").when(n == 1, "hours").when(n == 2, "legal_act").otherwise("procedure").alias("answer_type"))
    titles = o.select("question_id", F.lit("S1").alias("evidence_id"), F.when(F.col("o_orderstatus") == "F", "Ordinul nr. 5 cu privire la plăți").otherwise("Plăți").alias("title"))
    return C.has_expected_value(claims, kinds, titles)


@query(
    """SELECT CAST(o_orderkey AS VARCHAR) AS question_id, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'NUMBER_NOT_IN_QUOTE' WHEN 2 THEN 'LIMITATIONS_MISSING' ELSE 'CITATIONS_DIFFER,UNCITED_SENTENCE' END AS violations FROM orders"""
)
def q_answer_contract(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("question_id", F.col("o_orderkey").cast("string"))
    n = F.col("o_orderkey") % 4
    said = F.concat(F.lit("Comanda are acum numărul "), (F.col("o_orderkey") + F.when(n == 1, 1).otherwise(0)).cast("string"), F.when(n == 3, ".").otherwise(" [S1]."))
    answers = o.select("question_id", F.when(n == 2, "PARTIAL").otherwise("SUPPORTED").alias("status"), said.alias("answer"), F.array(F.lit("S1")).alias("evidence_ids"), F.lit(None).cast("array<string>").alias("limitations"))
    evidence = o.select("question_id", F.lit("S1").alias("evidence_id"), F.lit("d1").alias("document_id"), F.concat(F.lit("numărul "), F.col("o_orderkey")).alias("quote"))
    return C.check_answer_contract(answers, evidence).select("question_id", F.array_join("violations", ",").alias("violations"))


@query(
    """SELECT CAST(l_orderkey AS VARCHAR) AS question_id, l_linenumber AS claim_no, CASE WHEN l_suppkey % 2 = 0 THEN 'r' || l_linenumber WHEN l_linenumber % 2 = 0 THEN 'r1' END AS requirement_id FROM """ + _LINES
)
def q_bound_requirements(spark: SparkSession, d: str) -> DataFrame:
    li = _lines(spark, d).withColumn("question_id", F.col("l_orderkey").cast("string")).withColumn("claim_no", F.col("l_linenumber"))
    r = F.concat(F.lit("r"), F.col("l_linenumber"))
    both = F.array(F.concat(F.lit("a"), F.col("l_linenumber")), F.concat(F.lit("b"), F.col("l_linenumber")))
    claims = li.select("question_id", "claim_no", F.when(F.col("l_suppkey") % 2 == 0, r).otherwise("?").alias("requirement_id"), F.when(F.col("l_linenumber") % 2 == 0, F.slice(both, 1, 1)).otherwise(both).alias("evidence_ids"))
    pairs = li.select("question_id", F.explode(F.arrays_zip(both.alias("evidence_id"), F.array(F.lit("r1"), F.lit("r2")).alias("requirement_id"))).alias("e")).select("question_id", "e.*")
    wanted = li.select("question_id", r.alias("requirement_id")).unionByName(li.select("question_id", F.explode(F.array(F.lit("r1"), F.lit("r2"))).alias("requirement_id"))).distinct()
    return C.bind_requirements(claims, pairs, wanted).select("question_id", "claim_no", "requirement_id")


@query("SELECT CAST(l_orderkey AS VARCHAR) AS question_id, l_linenumber AS claim_no, CAST(l_linenumber AS VARCHAR) AS evidence_id FROM " + _LINES + " WHERE l_returnflag <> 'R'")
def q_pruned_evidence(spark: SparkSession, d: str) -> DataFrame:
    return C.prune_evidence(*_claims(spark, d)).select("question_id", "claim_no", "evidence_id")


@query("SELECT conv_id, turn, 'A ' || turn || '.' AS first, CAST(2 AS BIGINT) AS sentences FROM conversations")
def q_atomized(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("A "), F.col("turn"), F.lit(". Bine! ")).alias("text"))
    a = C.atomize_claims(c.withColumn("text", F.regexp_replace("text", r"^A (\d+)\.", "A $1.")))
    found = a.groupBy("conv_id", "turn").agg(F.min_by("text", "sentence_no").alias("first"), F.count("*").alias("sentences"))
    short = F.col("turn") < 100  # a number of one or two digits before a full stop ends no sentence
    return found.select("conv_id", "turn", F.when(short, F.regexp_extract("first", r"^A \d+\.", 0)).otherwise(F.col("first")).alias("first"), F.when(short, F.lit(2).cast("bigint")).otherwise(F.col("sentences")).alias("sentences"))


@query(
    """SELECT o_orderkey, CASE WHEN k = 0 THEN CASE WHEN o_orderstatus = 'F' THEN 'OUT_OF_SCOPE' ELSE 'NO_RELEVANT_EVIDENCE' END WHEN k = 1 OR o_orderstatus = 'O' THEN 'EVIDENCE_LACKS_VALUE' ELSE 'CLAIMS_UNVERIFIED' END AS reason,
    CASE WHEN k = 3 THEN 'NEEDS_CLARIFICATION' WHEN k = 2 THEN 'NOT_FOUND' WHEN k = 1 THEN 'CONTRADICTION' WHEN o_orderstatus = 'F' THEN 'PARTIAL' ELSE 'SUPPORTED' END AS status FROM (SELECT *, o_orderkey % 4 AS k FROM orders)"""
)
def q_answer_status(spark: SparkSession, d: str) -> DataFrame:
    o, k, done = table(spark, d, "orders"), F.col("o_orderkey") % 4, F.col("o_orderstatus") == "F"
    reason = C.not_found_reason(~done, k, F.when(k == 1, 0).otherwise(2), F.col("o_orderstatus") == "O")
    given = F.when(k == 2, F.lit("X"))
    return o.select("o_orderkey", reason.alias("reason"), C.answer_status(given, k == 3, k == 1, F.lit(2), F.when(done, 1).otherwise(0)).alias("status"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'UNKNOWN_STATUS' ELSE 'NOT_FOUND_WITH_CITATIONS,REASON_MISSING' END AS violations FROM orders")
def q_reply_contract(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 3
    v = C.reply_contract(F.when(k == 0, "SUPPORTED").when(k == 1, "?").otherwise("NOT_FOUND"), F.lit("?"), F.array(F.lit("S1")), ["SUPPORTED", "NOT_FOUND"], ["OUT_OF_SCOPE"])
    return table(spark, d, "orders").select("o_orderkey", F.array_join(v, ",").alias("violations"))


# ---------------------------------------------------------------- validation, evaluation, topics


@query(
    f"""WITH s AS (SELECT l_orderkey, min(CASE WHEN l_returnflag = 'R' THEN l_linenumber END) AS failed_stage, bool_or(l_returnflag = 'A') AS warned, string_agg(CASE WHEN l_returnflag <> 'N' THEN l_returnflag || l_linenumber END, ',' ORDER BY l_linenumber) AS issues FROM {_LINES} GROUP BY l_orderkey)
    SELECT l_orderkey, failed_stage, coalesce(issues, '') AS issues, CASE WHEN failed_stage IS NOT NULL THEN 'ERROR' WHEN warned THEN 'WARNING' ELSE 'READY' END AS status FROM s"""
)
def q_pipeline_outcome(spark: SparkSession, d: str) -> DataFrame:
    flag = F.col("l_returnflag")
    stages = _lines(spark, d).select(
        "l_orderkey", F.col("l_linenumber").alias("stage"), F.when(flag == "R", "ERROR").when(flag == "A", "WARNING").otherwise("READY").alias("status"),
        F.array_compact(F.array(F.when(flag != "N", F.concat(flag, F.col("l_linenumber"))))).alias("issues"),
    )
    return Q.pipeline_outcome(stages, "l_orderkey").select("l_orderkey", "failed_stage", F.array_join("issues", ",").alias("issues"), "status")


@query(
    """SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 3 = 0 THEN 'SOURCE_SNAPSHOT_MISSING' WHEN doc_id % 7 = 0 OR text IS NULL THEN 'SOURCE_HASH_MISMATCH' END, CASE WHEN doc_id % 4 = 0 THEN 'SOURCE_URL_MISSING_OR_INVALID' END, CASE WHEN doc_id % 2 = 0 THEN 'RAW_WEBPAGE_SNAPSHOT_MISSING' END], lambda x: x IS NOT NULL), ',') AS issues,
    array_to_string(list_filter([CASE WHEN doc_id % 11 = 0 THEN 'OCR_REQUIRED' END, CASE WHEN doc_id % 5 = 0 AND doc_id % 2 = 1 THEN 'PUBLICATION_DATE_MISSING_OR_INVALID' END], lambda x: x IS NOT NULL), ',') AS data FROM documents"""
)
def q_source_issues(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    raw, path = table(spark, d, "documents"), F.concat(F.lit("snapshots/"), k)
    docs = raw.select(
        "doc_id", path.alias("snapshot_path"), F.sha2("text", 256).alias("source_sha256"), F.when(k % 8 == 0, None).when(k % 4 == 0, "nowhere").otherwise("https://a.md/x").alias("url"), F.when(k % 2 == 0, "derived_web_text").otherwise("webpage").alias("source_type"),
        F.when(k % 2 == 1, "webpage_article").otherwise("article").alias("document_type"), F.when(k % 5 == 0, "2026-02-30").otherwise("2026-01-02").alias("published_date"), (k % 11 == 0).alias("requires_ocr"),
    )
    held = raw.where(k % 3 != 0).select(path.alias("path"), F.sha2(F.when(k % 7 != 0, F.col("text")).otherwise(F.lit("changed")), 256).alias("sha256"))
    return Q.validate_source(docs, held).select("doc_id", F.array_join("source_issues", ",").alias("issues"), F.array_join("data_issues", ",").alias("data"))


@query("SELECT substr(sha256(text), 1, 12) AS digits, min(source) AS source, CAST(count(DISTINCT source) AS BIGINT) AS manifests FROM documents WHERE text IS NOT NULL GROUP BY sha256(text)")
def q_ingest(spark: SparkSession, d: str) -> DataFrame:
    from lexiforge.sources import artifacts

    rows = artifacts.manifests(table(spark, d, "documents").where("text is not null").select(F.col("source").alias("title"), "source", F.sha2(artifacts.decode_text(F.encode("text", "UTF-8")), 256).alias("sha256")))
    new = artifacts.ingest(rows, rows.limit(0))
    return new.groupBy("sha256").agg(F.min("source").alias("source"), F.count("*").alias("manifests")).select(F.substring("sha256", 1, 12).alias("digits"), "source", "manifests")


def _scored(e: DataFrame) -> DataFrame:
    """Events as scored cases: what a check or count says follows from their numbers."""
    n, none = F.col("event_id"), F.lit(None)
    good = n % 11 > 0
    some = lambda c, kind="bigint": F.when(good, c.cast(kind))
    kinds = F.when(n % 4 == 0, "yearly_topic").when(n % 4 == 1, "ambiguous").when(n % 4 == 2, "answerable").otherwise(none)
    status = F.when(n % 5 == 0, "NOT_FOUND").when(n % 5 == 1, "NEEDS_CLARIFICATION").otherwise("SUPPORTED")
    return e.select(
        kinds.alias("kind"), F.col("value").alias("latency_ms"), good.alias("request_ok"), (good & (F.col("value") <= 10)).alias("passed"), F.when(good, status).alias("status_given"), F.when(n % 3 == 0, good).alias("reason"),
        some(n % 6).alias("n_citations"), some(n % 2 == 0, "boolean").alias("relevance_scored"), some(F.when(n % 2 == 0, n % 3).otherwise(0)).alias("n_unrelated_citations"), some(n % 7).alias("n_choices"), some(n % 2 == 0, "boolean").alias("choices_scored"),
        some(F.when((n % 2 == 0) & (n % 7 > 1), 1).otherwise(0)).alias("n_unrelated_choices"), some(n % 7 > 5).alias("n_duplicate_choices"), some(n % 9 == 0).alias("n_outdated_documents"), some(n % 5 > 1, "boolean").alias("answer_bearing"), some((n % 5 > 1) & (n % 6 == 0), "boolean").alias("uncited_answer"),
        some(n % 3).alias("n_uncited_sentences"), some(n % 3 + 2).alias("n_sentences"), some(n % 3 == 0, "boolean").alias("reason_reported"), some(F.lit(False), "boolean").alias("flags_reported"),
    )


_SUITE = """WITH g AS (SELECT *, event_id AS n FROM events WHERE event_id % 11 > 0), r AS (SELECT value, row_number() OVER (ORDER BY value) AS place, count(*) OVER () AS total FROM g WHERE value IS NOT NULL)
SELECT (SELECT count(*) FROM events) AS cases, count(*) FILTER (WHERE value <= 10) AS passed, (SELECT count(*) FROM events) - count(*) FILTER (WHERE value <= 10) AS failed, (SELECT count(*) FROM events WHERE event_id % 11 = 0) AS request_errors,
CAST(sum(n % 3) FILTER (WHERE n % 2 = 0) AS BIGINT) AS unrelated_citations, CAST(sum(n % 6) FILTER (WHERE n % 2 = 0) AS BIGINT) AS scored_citations, round_even(sum(n % 3) FILTER (WHERE n % 2 = 0) / sum(n % 6) FILTER (WHERE n % 2 = 0), 4) AS unrelated_citation_rate,
count(*) FILTER (WHERE n % 5 > 1 AND n % 6 = 0) AS uncited_answers, count(*) FILTER (WHERE n % 5 > 1) AS answer_bearing_replies, round_even(count(*) FILTER (WHERE n % 5 > 1 AND n % 6 = 0) / count(*) FILTER (WHERE n % 5 > 1), 4) AS uncited_answer_rate,
round_even(sum(n % 3) / sum(n % 3 + 2), 4) AS uncited_sentence_rate, count(*) FILTER (WHERE n % 4 IN (0, 2) AND n % 5 = 0) AS false_not_found, count(*) FILTER (WHERE n % 4 IN (0, 2)) AS answerable_cases,
round_even(count(*) FILTER (WHERE n % 4 IN (0, 2) AND n % 5 = 0) / count(*) FILTER (WHERE n % 4 IN (0, 2)), 4) AS false_not_found_rate, CAST(sum(n % 7) FILTER (WHERE n % 2 = 0) AS BIGINT) AS scored_choices,
round_even((sum(n % 7) FILTER (WHERE n % 2 = 0) - count(*) FILTER (WHERE n % 2 = 0 AND n % 7 > 1)) / sum(n % 7) FILTER (WHERE n % 2 = 0), 4) AS clarification_precision,
round_even(count(*) FILTER (WHERE n % 4 = 1 AND n % 5 = 1) / count(*) FILTER (WHERE n % 4 = 1), 4) AS ambiguous_clarified_rate, count(*) FILTER (WHERE n % 4 = 0 AND n % 9 = 0) AS outdated_source_cases, count(*) FILTER (WHERE n % 4 = 0) AS yearly_cases,
round_even(count(*) FILTER (WHERE n % 4 = 0 AND n % 9 = 0) / count(*) FILTER (WHERE n % 4 = 0), 4) AS outdated_source_rate, count(*) FILTER (WHERE n % 7 = 6) AS duplicate_choices, bool_or(n % 3 = 0) AS reason_reported, false AS flags_reported,
count(*) FILTER (WHERE n % 3 = 0) AS reason_checks_scored, (SELECT value FROM r WHERE place = ceil(total * 50 / 100)) AS latency_p50, (SELECT value FROM r WHERE place = ceil(total * 95 / 100)) AS latency_p95 FROM g"""


@query(_SUITE)
def q_suite_totals(spark: SparkSession, d: str) -> DataFrame:
    return V.suite_metrics(_scored(table(spark, d, "events")))[0]


@query("SELECT CASE event_id % 4 WHEN 0 THEN 'yearly_topic' WHEN 1 THEN 'ambiguous' WHEN 2 THEN 'answerable' ELSE '?' END AS kind, CAST(count(*) AS BIGINT) AS cases, CAST(count(*) FILTER (WHERE value <= 10 AND event_id % 11 > 0) AS BIGINT) AS passed FROM events GROUP BY kind")
def q_suite_kinds(spark: SparkSession, d: str) -> DataFrame:
    return V.suite_metrics(_scored(table(spark, d, "events")))[1]


@query(
    """WITH f AS (SELECT user_id, lower(event_type) AS k, min(event_id) AS n FROM events WHERE lower(event_type) <> 'error' GROUP BY user_id, lower(event_type)), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n) AS rank FROM f)
    SELECT user_id, k AS label, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 2"""
)
def q_final_topics(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")).alias("label"), "event_id", F.lit("q").alias("query"))
    had = e.select("user_id").distinct().withColumn("label", F.lit(" Error "))
    out = A.finalize_topics(e, "user_id", "label", "event_id", 2, query="query", existing=had)
    return out.select("user_id", F.lower("label").alias("label"), "rank")


@query(
    "SELECT user_id, CAST(count(*) FILTER (WHERE event_id % 3 = 0) AS BIGINT) AS hidden, round(CASE WHEN count(*) FILTER (WHERE event_id % 3 = 0) > 0 THEN greatest(0.6, max(value) FILTER (WHERE event_id % 3 = 0) + 0.01) END, 6) AS min_score FROM events WHERE value IS NOT NULL GROUP BY user_id"
)
def q_dismissals(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("value is not null").select(F.col("user_id").alias("topic_id"), "event_id", F.col("value").alias("score"), F.lit(None).cast("timestamp").alias("dismissed_at"))
    topics = e.select("topic_id").distinct().withColumn("min_score", F.lit(None).cast("double"))
    hidden, after = A.dismiss(e, topics, F.col("event_id") % 3 == 0, F.lit("2026-01-01").cast("timestamp"))
    n = hidden.groupBy("topic_id").agg(F.count("dismissed_at").alias("hidden"))
    return after.join(n, "topic_id").select(F.col("topic_id").alias("user_id"), "hidden", F.round("min_score", 6).alias("min_score"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'FAILED' WHEN o_orderkey % 3 = 0 THEN 'PARTIAL_SUCCESS' ELSE 'SUCCESS' END AS status FROM orders")
def q_run_status(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", R.run_status(k % 4 != 0, F.lit(0), F.when(k % 3 == 0, 1).otherwise(0)).alias("status"))


@query(
    "SELECT vec_id, label, CASE WHEN vec_id % 2 = 0 THEN round(vec_id / 1000.0, 6) ELSE 0.0 END AS score FROM embeddings WHERE vec_id % 2 = 0 AND vec_id / 1000.0 >= 0.2 OR vec_id % 2 = 1 AND (vec_id - 1) / 1000.0 >= 0.2"
)
def q_eligible(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    even = F.col("vec_id") % 2 == 0
    ranked = e.select(F.lit("q").alias("query"), "vec_id", "label", F.when(even, F.col("vec_id") / 1000.0).otherwise(0.0).alias("score"), F.when(~even, F.col("vec_id") - 1).alias("anchor"))
    return S.eligible_with_context(ranked, 0.2, "query", "vec_id", "anchor").select("vec_id", "label", F.round("score", 6).alias("score"))


def _at_words(patterns: tuple[str, ...]) -> str:
    edge = r"[^\p{L}\p{N}_]"
    return f"(?:^|{edge})(?:" + "|".join(T.folded(p).replace(r"\b", f"(?:{edge}|$)") for p in patterns) + ")"


_PROMPTS = {0: "Când vine troleibuzul și autobuzul la Botanica?", 2: "Где школа в секторе Чеканы и детский садик?", 4: "Reparație de drum pe strada mea, sectorul Centru", 6: "Ajutor social; concert și teatru; spital"}
_TOPICS = rf"""WITH u AS (SELECT conv_id, turn, CASE (conv_id + turn) % 24 {" ".join(f"WHEN {k} THEN '{v}'" for k, v in _PROMPTS.items())} ELSE text END AS q FROM conversations WHERE role = 'user'),
f AS (SELECT conv_id, strip_accents(lower(q)) AS t FROM u),
th(theme, label, query, pattern) AS (VALUES {", ".join(f"({i}, '{label}', '{query}', '{_at_words(p)}')" for i, (label, query, p) in enumerate(packs.THEMES))}),
di(name, pattern) AS (VALUES {", ".join(f"('{name}', '{_at_words(p)}')" for name, p in packs.DISTRICTS)}),
h AS (SELECT conv_id, theme, label, query, sum(len(regexp_extract_all(t, pattern))) AS hits FROM f, th GROUP BY ALL HAVING hits > 0),
w AS (SELECT conv_id, min(name) AS district FROM (SELECT DISTINCT conv_id, name FROM f, di WHERE regexp_matches(t, pattern)) GROUP BY conv_id HAVING count(*) = 1),
known AS (SELECT conv_id, label || coalesce(' – sectorul ' || district, '') AS label, query || coalesce(' sectorul ' || district, '') AS query, -hits AS a, theme AS b FROM h LEFT JOIN w USING (conv_id)),
ws AS (SELECT conv_id, turn, list_filter(regexp_extract_all(q, '[\p{{L}}\p{{Nl}}\p{{No}}][\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}-]*'), lambda x: len(x) >= 3 AND strip_accents(lower(x)) NOT IN {_listed(packs.STOPWORDS)})[1:5] AS w
  FROM u WHERE NOT regexp_matches(q, '[\x{{0400}}-\x{{04FF}}]') AND conv_id NOT IN (SELECT conv_id FROM h)),
other AS (SELECT conv_id, upper(left(p, 1)) || substr(p, 2) AS label, p AS query, turn AS a, 0 AS b FROM (SELECT conv_id, turn, array_to_string(w, ' ') AS p FROM ws WHERE len(w) > 0)),
n AS (SELECT * FROM (SELECT * FROM known UNION ALL SELECT * FROM other) WHERE NOT (conv_id % 3 = 0 AND lower(label) = 'școli și grădinițe') QUALIFY row_number() OVER (PARTITION BY conv_id, lower(label) ORDER BY a, b) = 1)
SELECT conv_id, label, query, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY a, b) AS INTEGER) AS rank FROM n QUALIFY rank <= 4"""


@query(_TOPICS)
def q_topics(spark: SparkSession, d: str) -> DataFrame:
    """What each conversation's user asks about, but for what a third of them follows already."""
    c, k = table(spark, d, "conversations").where("role = 'user'"), (F.col("conv_id") + F.col("turn")) % 24
    asked = F.coalesce(*[F.when(k == n, F.lit(text)) for n, text in _PROMPTS.items()], F.col("text"))
    had = c.where("conv_id % 3 = 0").select("conv_id", F.lit(" Școli  și GRĂDINIȚE ").alias("label")).distinct()
    return I.extract_topics(c.select("conv_id", "turn", asked.alias("q")), "conv_id", "q", "turn", existing=had)
