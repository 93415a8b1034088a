"""File artifacts: bytes with their hash, media type and kind, decoded text, content-addressed manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.functions.text import safe_slug

#: File endings of each kind.
KINDS = {"pdf": r"\.pdf($|[?#])", "office_document": r"\.(docx?|xlsx?)($|[?#])", "image": r"\.(png|jpe?g|gif)($|[?#])"}
MEDIA = {"txt": "text/plain", "md": "text/markdown", "csv": "text/csv", "html": "text/html", "htm": "text/html", "json": "application/json", "pdf": "application/pdf"}


def source_kind(name: Column) -> Column:
    """Kind of a file or address by its ending; other addresses are web pages, other files text."""
    low = F.lower(name)
    out = F.coalesce(*[F.when(low.rlike(p), F.lit(k)) for k, p in KINDS.items()])
    return F.coalesce(out, F.when(low.rlike("^https?://"), "webpage").otherwise("text"))


def decode_text(content: Column) -> Column:
    """UTF-16 or UTF-32 by its byte order mark, else UTF-8 with or without one; null if the bytes are not valid."""
    head4, head2 = F.hex(F.substring(content, 1, 4)), F.hex(F.substring(content, 1, 2))
    bare = F.when(F.hex(F.substring(content, 1, 3)) == "EFBBBF", F.substring(content, F.lit(4), F.length(content))).otherwise(content)
    return (
        F.when(head4.isin("0000FEFF", "FFFE0000"), F.decode(content, "UTF-32"))
        .when(head2.isin("FEFF", "FFFE"), F.decode(content, "UTF-16"))
        .otherwise(F.try_validate_utf8(bare.cast("string")))
    )


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file that is not empty (Spark's file source passes over empty ones): path, name, bytes, sha256, media
    type, source type, text of text files, and an issue code."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    media = F.coalesce(*[F.when(suffix == s, F.lit(m)) for s, m in MEDIA.items()], F.lit("application/octet-stream"))
    text = F.when(media.startswith("text/") | (media == "application/json"), decode_text(F.col("content")))
    rows = raw.select("path", "modificationTime", F.col("length").alias("bytes"), "content", name.alias("file_name"), F.sha2("content", 256).alias("sha256"), media.alias("media_type"), text.alias("text"))
    derived = F.when(F.col("text").rlike(r"(?m)^\s*https?://\S+\s*$"), "derived_web_text")
    kind = F.when(F.col("media_type") == "text/html", "webpage").otherwise(F.coalesce(derived, source_kind(F.col("file_name"))))
    issue = F.when(F.col("media_type").startswith("text/") & F.col("text").isNull(), "INVALID_ENCODING")
    return rows.withColumn("source_type", kind).withColumn("issue", issue)


def manifests(artifacts: DataFrame, title: str = "title") -> DataFrame:
    """Content-addressed manifest rows: the caller's document_id, or a slug of the title and the hash's first digits."""
    made = F.concat(safe_slug(F.col(title)), F.lit("-"), F.substring("sha256", 1, 12))
    given = F.col("document_id") if "document_id" in artifacts.columns else F.lit(None).cast("string")
    return artifacts.withColumn("document_id", F.coalesce(given, made)).withColumn("version_id", F.col("sha256"))


def ingest(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Manifest rows to add: each content of a document once, none that is there already."""
    return new.dropDuplicates(["document_id", "sha256"]).join(existing.select("document_id", "sha256"), ["document_id", "sha256"], "left_anti")
