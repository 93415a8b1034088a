"""Snapshots, scraper records, chunk files, update feeds, versioned outputs and traces."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexiforge.functions.text import first_non_blank, first_url, stable_id, valid_url
from lexiforge.operators.relational import latest

PAGE = "array<struct<page:int,text:string,ocr:boolean,conf:double>>"
SNAPSHOT = f"""id string, updated_at string, title string, lang string, source string, category string, district string, tier int, canonical_url string,
raw_url string, doc_date string, content_type string, status string, quality_flags array<string>, ocr_pending_pages array<int>, pages {PAGE}, _bad string"""
SCRAPED = """sha1 string, source string, category string, district string, lang string, title string, doc_date string, content_type string, extracted_at string,
act_id string, urls array<string>, quality_flags array<string>, needs_ocr_pages array<int>, n_ocr_pages int, pages array<struct<page:int,text:string,ocr:boolean>>, text string, _bad string"""
FEED = "document_id string, title string, url string, source string, district string, category string, published_date string, excerpt string, embedding string"


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    read = spark.read.schema(schema).option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").option("recursiveFileLookup", True)
    return read.json(path).withColumn("file", F.col("_metadata.file_path")).withColumn("mtime", F.col("_metadata.file_modification_time"))


def read_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """One row for each snapshot file, with issue: INVALID_SNAPSHOT on all files of a document of which one is bad.

    Bad is malformed JSON, an id other than the folder's name, or an updated_at that is no time with a zone.
    """
    rows = _json(spark, root, SNAPSHOT).withColumn("folder", F.element_at(F.split("file", "/"), -2))
    zoned = F.col("updated_at").rlike(r"(?:Z|[+-][0-9]{2}:?[0-9]{2})$") & F.try_to_timestamp("updated_at").isNotNull()
    bad = F.col("_bad").isNotNull() | ~F.coalesce(F.col("id") == F.col("folder"), F.lit(False)) | ~F.coalesce(zoned, F.lit(False))
    flagged = rows.withColumn("_wrong", bad)
    folders = flagged.groupBy("folder").agg(F.max("_wrong").alias("_any"))
    return flagged.join(folders, "folder").withColumn("issue", F.when(F.col("_any"), "INVALID_SNAPSHOT")).drop("_wrong", "_any", "_bad")


def latest_snapshot(rows: DataFrame) -> DataFrame:
    """The newest good snapshot of each document by time, file time and name."""
    good = rows.where("issue is null").withColumn("_at", F.try_to_timestamp("updated_at"))
    return latest(good, ["id"], "_at", "mtime", "file").drop("_at")


def read_scraper_records(spark: SparkSession, root: str) -> DataFrame:
    """Scraper records in snapshot shape, with issue codes joined by comma where a record can't be used."""
    rows = _json(spark, root, SCRAPED)
    stem = F.regexp_extract("file", r"([^/]+)\.json$", 1)
    urls = F.coalesce(F.transform("urls", lambda u: F.struct(F.when(u.startswith("{"), F.get_json_object(u, "$.url")).otherwise(u).alias("url"), F.get_json_object(u, "$.title").alias("title"), F.get_json_object(u, "$.anchor_text").alias("anchor"))), F.array().cast("array<struct<url:string,title:string,anchor:string>>"))
    rows = rows.withColumn("links", urls).withColumn("url", first_url(F.transform("links", lambda u: u["url"])))
    lead = F.try_element_at("links", F.lit(1))
    codes = F.array_compact(
        F.array(
            F.when(F.col("_bad").isNotNull(), "MALFORMED"), F.when(~F.coalesce(F.col("sha1").rlike("^[0-9a-f]{40}$") & (F.col("sha1") == stem), F.lit(False)), "SHA1_MISMATCH"),
            F.when(F.length(F.trim(F.coalesce("source", F.lit("")))) == 0, "SOURCE_MISSING"), F.when(~valid_url(F.coalesce("url", F.lit(""))), "URL_MISSING"),
            F.when(F.col("text").isNull() & (F.coalesce(F.size("pages"), F.lit(0)) <= 0), "CONTENT_MISSING"),
        )
    )
    return rows.select(
        stable_id("municipal", "source", F.coalesce("act_id", "url"), length=24).alias("id"), "*",
        first_non_blank("title", lead["title"], lead["anchor"], F.concat(F.lit("Document "), F.substring("sha1", 1, 12))).alias("shown_title"),
        F.coalesce("extracted_at", F.date_format("mtime", "yyyy-MM-dd'T'HH:mm:ssXXX")).alias("updated_at"), F.when(F.size(codes) > 0, F.array_join(codes, ",")).alias("issue"),
    ).drop("_bad")


def discovery_errors(rows: DataFrame, key: str) -> DataFrame:
    """Bad inputs as result rows, beside the good ones: status ERROR at stage 0, may be tried again."""
    return rows.where("issue is not null").select(F.col(key).alias("document_id"), F.lit("ERROR").alias("status"), F.col("issue").alias("code"), F.lit(0).alias("stage"), F.lit(True).alias("retryable")).distinct()


def read_chunks_jsonl(spark: SparkSession, path: str, schema: str, key: str = "chunkId", text: str = "text", *, strict: bool = False) -> DataFrame:
    """Chunk records with issue DUPLICATE_ID, ID_MISSING or TEXT_MISSING; strict raises if there are any, or no rows."""
    rows = spark.read.schema(schema).json(path)
    twice = rows.groupBy(key).agg(F.count("*").alias("_n"))
    code = F.when(F.length(F.trim(F.coalesce(key, F.lit("")))) == 0, "ID_MISSING").when(F.length(F.trim(F.coalesce(text, F.lit("")))) == 0, "TEXT_MISSING").when(F.col("_n") > 1, "DUPLICATE_ID")
    out = rows.join(twice, key, "left").withColumn("issue", code).drop("_n")
    if strict and (out.isEmpty() or not out.where("issue is not null").isEmpty()):
        raise ValueError("the chunk file is empty or has unusable records")
    return out


def write_stage(df: DataFrame, root: str, stage: str, run_id: str) -> str:
    """Write an immutable version of a stage's output; writing the same version again is an error."""
    path = f"{root}/{stage}/run_id={run_id}"
    df.write.mode("errorifexists").parquet(path)
    return path


def publish_version(spark: SparkSession, path: str, name: str, root: str | None = None) -> None:
    """Switch `name` to a version that is complete: the session's view, and, with a root, the pointer that all sessions read.

    A pointer is one more row in `root`/pointers/`name`; a reader takes the newest, so it sees the old version or the new one.
    """
    spark.read.parquet(path).createOrReplaceTempView(name)
    if root is not None:
        spark.range(1).select(F.lit(path).alias("path"), F.current_timestamp().alias("at"), F.lit(uuid.uuid4().hex).alias("id")).coalesce(1).write.mode("append").parquet(f"{root}/pointers/{name}")


def read_version(spark: SparkSession, name: str, root: str) -> DataFrame:
    """The version that was published last under `name`."""
    newest = spark.read.schema("path string, at timestamp, id string").parquet(f"{root}/pointers/{name}").groupBy().agg(F.max_by("path", F.struct("at", "id")).alias("path")).first()
    return spark.read.parquet(newest["path"])


#: Columns of the service's tables.
RELATIONAL = {
    "chats": "id string, client_id string, project_id string, name string, request_id string, creation_name string, created_at timestamp, updated_at timestamp",
    "documents": "id bigint, title string, document_link string, added_at timestamp",
    "responses": """id bigint, chat_id string, prompt string, text string, request_id string, generation_status string, generation_version int, generation_request_id string,
        generation_started_at timestamp, generation_expires_at timestamp, error_code string, ai_reply string, created_at timestamp""",
    "response_documents": "response_id bigint, document_id bigint",
    "projects": "id string, client_id string, name string, created_at timestamp, updated_at timestamp",
    "alert_subscriptions": "id bigint, client_id string, project_id string, chat_id string, enabled boolean, prompted boolean, topics_refreshed_at timestamp, last_scan_at timestamp, updated_at timestamp",
    "alert_topics": "id bigint, subscription_id bigint, label string, query string, source string, removed boolean, min_score double, created_at timestamp",
    "alerts": """id bigint, client_id string, subscription_id bigint, topic_id bigint, topic_label string, document_id string, title string, url string, source string, district string, category string,
        published_date date, excerpt string, score double, created_at timestamp, read_at timestamp, dismissed_at timestamp, feedback string""",
}


def read_relational(spark: SparkSession, root: str | None = None, *, jdbc: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """The service's eight tables with their fixed columns: from Parquet folders under a root, or through JDBC with the given
    options (url, user, ...), where the numeric keys deal large tables out if the options name bounds."""
    if jdbc is not None:
        return {n: spark.read.format("jdbc").options(dbtable=n, **jdbc).load().select(*[F.col(f.name).cast(f.dataType) for f in StructType.fromDDL(c)]) for n, c in RELATIONAL.items()}
    return {n: spark.read.schema(c).parquet(f"{root}/{n}") for n, c in RELATIONAL.items()}


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """The update feed with decoded vectors; a feed that is not there is empty."""
    from pyspark.errors import AnalysisException

    from lexiforge.functions.vectors import decode_f16

    try:
        rows = spark.read.schema(FEED).json(path)
    except AnalysisException:
        rows = spark.createDataFrame([], FEED)
    return rows.withColumn("published_date", F.try_to_date("published_date", "yyyy-MM-dd")).withColumn("embedding", decode_f16(F.unbase64("embedding")))


def write_feed(feed: DataFrame, path: str) -> None:
    from lexiforge.functions.vectors import encode_f16

    out = feed.withColumn("published_date", F.date_format("published_date", "yyyy-MM-dd")).withColumn("embedding", F.base64(encode_f16(F.col("embedding"))))
    out.write.mode("overwrite").json(path)


def curation_scan(
    docs: DataFrame, labels: DataFrame, key: str, source: str, wanted: Column, chars: str, least: int = 300, most: int = 60_000, *, tier: str | None = None, tiers: tuple[int, ...] = (1, 2), date: str | None = None, since: str | None = None
) -> DataFrame:
    """Documents that are wanted, of a usable length and labelled, with the number of documents of their source; with a tier
    column those of the tiers, with a date column those from `since` on (text dates compare as they stand), newest first."""
    sizes = docs.groupBy(source).agg(F.count("*").alias("source_docs"))
    rows = docs.where(wanted & F.col(chars).between(least, most))
    if tier is not None:
        rows = rows.where(F.col(tier).isin(*tiers))
    if date is not None and since is not None:
        rows = rows.where(F.col(date) >= since)
    rows = rows.join(labels.select(key), key, "left_semi").join(sizes, source)
    return rows if date is None else rows.orderBy(F.desc(date), F.asc(key))


def append_trace(results: DataFrame, path: str) -> None:
    """Append one row a query without the question's text: its hash, language, status, time and the citations' ranks."""
    results.select(F.sha2("question", 256).alias("question_sha256"), "language", "status", "elapsed_ms", F.transform("citations", lambda c: F.struct(c["id"].alias("id"), c["ranks"].alias("ranks"))).alias("citations")).write.mode("append").json(path)


def review_reports(run_documents: DataFrame, runs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Per run: counts and status; and one row for each problem.

    runs (run_id, consistent, global_error, completed_at) says what happened to a run as a whole: an error of its own, or a
    database that it left inconsistent, makes it FAILED whatever its documents say. Runs without documents are in it too.
    """
    from lexiforge.operators.relational import run_status

    counts = run_documents.groupBy("run_id").agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("READY", "WARNING", "ERROR")])
    if runs is None:
        runs = counts.select("run_id", F.lit(None).cast("boolean").alias("consistent"), F.lit(None).cast("string").alias("global_error"), F.lit(None).cast("timestamp").alias("completed_at"))
    rows = runs.select("run_id", "consistent", "global_error", "completed_at").join(counts, "run_id", "full")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("total", "ready", "warning", "error")})
    whole = F.coalesce("consistent", F.lit(True)) & (F.col("ready") + F.col("warning") + F.col("error") == F.col("total"))
    status = run_status(whole, F.when(F.length("global_error") > 0, 1).otherwise(0), F.col("warning") + F.col("error"))
    problems = run_documents.select("run_id", "document_id", F.explode("issues").alias("i")).select("run_id", "document_id", "i.severity", "i.code", "i.stage", "i.message")
    return rows.select("run_id", "total", "ready", "warning", "error", status.alias("run_status"), "completed_at"), problems


def latest_run(reports: DataFrame) -> DataFrame:
    """One row (run_id, run_status): the run that completed last, the greatest id of several; what readers of reports open first."""
    last = reports.where("completed_at is not null").agg(F.max_by(F.struct("run_id", "run_status"), F.struct("completed_at", "run_id")).alias("r"))
    return last.where("r is not null").select("r.*")
