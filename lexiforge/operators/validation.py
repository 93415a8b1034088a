"""Validation and reporting of the corpus batch: sources, citations, schemas, outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.functions import text as T
from lexiforge.operators.corpus import split_blocks
from lexiforge.store import materialize


def validate_source(documents: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Documents with source_issues, what blocks their citations, and data_issues.

    documents: snapshot_path, source_sha256, url, source_type, document_type, published_date, requires_ocr. artifacts: path and
    sha256 of what is stored. A text derived from a web page never has its raw page; a web article needs a date.
    """
    held = artifacts.groupBy(F.col("path").alias("_path")).agg(F.collect_set("sha256").alias("_held"))
    rows = documents.join(held, documents["snapshot_path"] == held["_path"], "left")
    source = F.array_compact(
        F.array(
            F.when(F.col("_held").isNull(), "SOURCE_SNAPSHOT_MISSING").when(~F.coalesce(F.array_contains("_held", F.col("source_sha256")), F.lit(False)), "SOURCE_HASH_MISMATCH"),
            F.when(~T.valid_url("url"), "SOURCE_URL_MISSING_OR_INVALID"),
            F.when(F.col("source_type") == "derived_web_text", "RAW_WEBPAGE_SNAPSHOT_MISSING"),
        )
    )
    dated = F.coalesce(F.col("published_date").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.lit(False)) & T.parse_iso_date("published_date").isNotNull()
    data = F.array_compact(F.array(F.when(F.col("requires_ocr"), "OCR_REQUIRED"), F.when((F.col("document_type") == "webpage_article") & ~dated, "PUBLICATION_DATE_MISSING_OR_INVALID")))
    return rows.withColumns({"source_issues": source, "data_issues": data}).drop("_path", "_held")


#: What blocks a document, kinds of places that are taken as they are, and where a text's lines end.
BLOCKING = ("SOURCE_SNAPSHOT_MISSING", "SOURCE_HASH_MISMATCH", "SOURCE_URL_MISSING_OR_INVALID", "RAW_WEBPAGE_SNAPSHOT_MISSING", "SOURCE_TEXT_ENCODING_INVALID", "API_SOURCE_JSON_INVALID", "OCR_REQUIRED")
UNVERIFIED = ("pdf_page", "html_extraction")
LINE_END = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x85\u2028\u2029]"


def _lines_of(text: Column) -> Column:
    """The lines of a text; what follows its last line end is one only if it is not empty."""
    lines = F.split(text, LINE_END, -1)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def validate_citations(passages: DataFrame, documents: DataFrame) -> DataFrame:
    """passages with citation_issues: each cited text is cut anew from its source by its locator and compared exactly.

    passages: document_id, citation_text, quote (instead of it for a title), locator (kind, start_line, end_line, page_index,
    block_index, field). documents: document_id, source_kind (`lines`: text; `api`: title, text, pages of text; null: none
    that can be read), text, title, pages. Lines are cited by a range, blocks by page and place (from 1) in it, titles by
    their field; places in PDF and HTML are taken as they are. A range that is none, or goes beyond the source, has its own
    code. No source travels with its passages: they meet their lines and blocks one by one, in equijoins on the document and
    the place, and only lines that are cited come together again.
    """
    at = lambda f: F.col(f"locator.{f}")
    rows = materialize(passages.drop("citation_issues").withColumn("_row", F.monotonically_increasing_id()), "citations")
    text = F.when((F.col("source_kind") == "lines") | (F.col("source_kind") == "api"), F.col("text"))
    sources = documents.select("document_id", "source_kind", "title", text.alias("text"), F.when(F.col("source_kind") == "api", F.col("pages")).alias("pages"), _lines_of(text).alias("lines"))
    known = sources.select("document_id", F.when((F.col("source_kind") == "lines") & (F.coalesce(F.size("lines"), F.lit(0)) == 0), None).otherwise(F.col("source_kind")).alias("_kind"), "title", F.size("lines").alias("_n"), F.col("text").isNotNull().alias("_told"), F.when(F.col("pages").isNotNull(), F.size("pages")).alias("_pages"))
    paged = sources.select("document_id", F.posexplode("pages").alias("_page", "p")).select("document_id", "_page", F.col("p.text").alias("page_text"))
    blocks = split_blocks(paged.where("page_text is not null").select(F.struct("document_id", "_page").alias("_at"), "page_text"), "_at", "page_text")
    blocks = blocks.select("_at.document_id", "_at._page", (F.col("ord") + 1).alias("_block"), F.col("block").alias("_found"))
    pages = paged.select("document_id", "_page", F.col("page_text").isNotNull().alias("_readable")).join(blocks.groupBy("document_id", "_page").agg(F.count("*").alias("_blocks")), ["document_id", "_page"], "left")

    rows = rows.join(known.withColumnRenamed("title", "_title"), "document_id", "left").withColumns({"_page": at("page_index"), "_block": at("block_index")})
    rows = rows.join(pages, ["document_id", "_page"], "left").join(blocks, ["document_id", "_page", "_block"], "left")
    kind, ranged = at("kind"), F.coalesce((at("start_line") >= 1) & (at("end_line") >= at("start_line")), F.lit(False))
    api = F.when(
        kind == "api_metadata", F.when(~F.coalesce(at("field") == "title", F.lit(False)), "API_METADATA_LOCATOR_INVALID")
    ).when(
        kind == "scraper_text", F.when(~F.col("_told") | ~ranged, "SCRAPER_TEXT_LOCATOR_INVALID").when(at("end_line") > F.col("_n"), "SCRAPER_TEXT_RANGE_OUT_OF_BOUNDS")
    ).when(
        kind.isin("api_page", "scraper_page"),
        F.when(F.col("_pages").isNull() | ~F.coalesce((F.col("_page") >= 0) & (F.col("_page") < F.col("_pages")) & (F.col("_block") >= 1), F.lit(False)), "API_PAGE_LOCATOR_INVALID")
        .when(~F.coalesce("_readable", F.lit(False)), "API_PAGE_TEXT_UNAVAILABLE").when(F.col("_block") > F.coalesce("_blocks", F.lit(0)), "API_BLOCK_RANGE_OUT_OF_BOUNDS"),
    ).otherwise("CITATION_LOCATOR_INVALID")
    lines = F.when(kind == "source_lines", F.when(~ranged, "SOURCE_LINE_RANGE_INVALID").when(at("end_line") > F.col("_n"), "SOURCE_LINE_RANGE_OUT_OF_BOUNDS")).when(~F.coalesce(kind.isin(*UNVERIFIED), F.lit(False)), "CITATION_LOCATOR_INVALID")
    code = F.when(F.col("_kind") == "lines", lines).when(F.col("_kind") == "api", api).when(~F.coalesce(kind.isin(*UNVERIFIED), F.lit(False)), "CITATION_SOURCE_UNAVAILABLE")
    rows = materialize(rows.withColumn("_code", code), "located")

    by_lines = F.col("_code").isNull() & F.coalesce(((F.col("_kind") == "lines") & (kind == "source_lines")) | ((F.col("_kind") == "api") & (kind == "scraper_text")), F.lit(False))
    wanted = rows.where(by_lines).select("_row", "document_id", F.explode(F.sequence(at("start_line"), at("end_line"))).alias("_line"))
    told = sources.select("document_id", F.posexplode("lines").alias("_line", "_text")).withColumn("_line", F.col("_line") + 1)
    cut = wanted.join(told, ["document_id", "_line"]).groupBy("_row").agg(_stripped(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_line", "_text"))), lambda x: x["_text"]), "\n")).alias("_cut"))
    rows = rows.join(cut, "_row", "left")
    titled = (F.col("_kind") == "api") & (kind == "api_metadata")
    expected = F.when(by_lines, F.col("_cut")).when(titled, F.col("_title")).when((F.col("_kind") == "api") & kind.isin("api_page", "scraper_page"), F.col("_found"))
    given = F.when(titled, F.coalesce("quote", "citation_text")).otherwise(F.col("citation_text"))
    checked = by_lines | F.coalesce((F.col("_kind") == "api") & (titled | kind.isin("api_page", "scraper_page")), F.lit(False))
    differs = F.when(F.col("_code").isNull() & checked & ~expected.eqNullSafe(given), "CITATION_TEXT_SOURCE_MISMATCH")
    missing = F.when(~F.coalesce(F.col("citation_text").rlike(r"(?U)\S"), F.lit(False)), "CITATION_TEXT_MISSING")
    return rows.withColumn("citation_issues", F.array_compact(F.array("_code", differs, missing))).select(*passages.drop("citation_issues").columns, "citation_issues")


def validate(documents: DataFrame, passages: DataFrame, key: str, blocking: list[str]) -> DataFrame:
    """Per document: counts of passages, of ready ones, of repeated passage ids, and PRODUCTION or QUARANTINE: at least one
    ready passage, no repeated id, no blocking issue."""
    twice = passages.groupBy(key, "passage_id").agg(F.count("*").alias("n")).groupBy(key).agg(F.count_if(F.col("n") > 1).alias("duplicates"))
    counts = passages.groupBy(key).agg(F.count("*").alias("passages"), F.count_if(F.col("status") == "READY").alias("ready")).join(twice, key)
    rows = documents.join(counts, key, "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("passages", "ready", "duplicates")}
    rows = rows.withColumns(zero)
    blocked = F.coalesce(F.arrays_overlap("issues", F.array(*[F.lit(b) for b in blocking])), F.lit(False))
    return rows.withColumn("decision", F.when((F.col("ready") > 0) & (F.col("duplicates") == 0) & ~blocked, "PRODUCTION").otherwise("QUARANTINE"))


def check_schema(df: DataFrame, contract: dict[str, dict]) -> DataFrame:
    """df with an array of violations: for each column required, min_length, pattern and enum rules."""
    codes = []
    for column, rule in contract.items():
        c = F.col(column)
        if rule.get("required"):
            codes.append(F.when(c.isNull(), f"{column}:REQUIRED"))
        if "min_length" in rule:
            codes.append(F.when(F.length(c) < rule["min_length"], f"{column}:TOO_SHORT"))
        if "pattern" in rule:
            codes.append(F.when(~c.cast("string").rlike(rule["pattern"]), f"{column}:PATTERN"))
        if "enum" in rule:
            codes.append(F.when(~c.isin(*rule["enum"]), f"{column}:ENUM"))
    return df.withColumn("violations", F.array_compact(F.array(*codes)))


def pipeline_outcome(stages: DataFrame, key: str) -> DataFrame:
    """READY, WARNING or ERROR for each document, with its first failing stage and all its issues in stage order.

    stages: key, stage, status (READY, WARNING, ERROR), issues.
    """
    rows = stages.groupBy(key).agg(
        F.min(F.when(F.col("status") == "ERROR", F.col("stage"))).alias("failed_stage"),
        F.max(F.col("status") == "WARNING").alias("_warned"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("stage", "issues"))), lambda x: x["issues"])).alias("issues"),
    )
    return rows.withColumn("status", F.when(F.col("failed_stage").isNotNull(), "ERROR").when(F.col("_warned"), "WARNING").otherwise("READY")).drop("_warned")


def reset_retryable(documents: DataFrame, stages: tuple[int, ...] = (7, 8)) -> DataFrame:
    """Documents that failed in a late stage but were fit for production go back to READY; their issues of those stages move to
    the attempt history."""
    late = F.col("failed_stage").isin(*stages) & (F.col("pipeline_status") == "READY") & (F.col("decision") == "PRODUCTION")
    old = F.filter("issues", lambda i: i["stage"].isin(*stages))
    rest = F.filter("issues", lambda i: ~i["stage"].isin(*stages))
    return documents.select(
        *[c for c in documents.columns if c not in ("status", "issues", "history", "failed_stage")],
        F.when(late, "READY").otherwise(F.col("status")).alias("status"), F.when(late, F.concat("history", old)).otherwise(F.col("history")).alias("history"),
        F.when(late, rest).otherwise(F.col("issues")).alias("issues"), F.when(~late, F.col("failed_stage")).alias("failed_stage"),
    )


def ordered_warnings(df: DataFrame, key: str, order: str, warnings: str) -> DataFrame:
    """Each document's warnings in order of first sight."""
    lists = F.transform(F.array_sort(F.collect_list(F.struct(order, warnings))), lambda x: x[warnings])
    return df.groupBy(key).agg(F.array_distinct(F.flatten(lists)).alias("warnings"))


def severity(code: Column, blocking: list[str]) -> Column:
    return F.when(code.isin(*blocking), "ERROR").otherwise("WARNING")
