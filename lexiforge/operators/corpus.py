"""The corpus batch: blocks, headings, passages, quality, evidence parts, previews."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udtf, udtf

from lexiforge.functions import text as T


def split_blocks(df: DataFrame, key: str, text: str, *, lines_are_blocks: bool = False) -> DataFrame:
    """Rows (key, ord, block, start_line, end_line): maximal runs of lines that are not blank, right-stripped, lines from 1.

    A run starts at a line with none or a blank one before it and stops at one with none or a blank one after it; both are
    found inside the row, so nothing is shuffled and a text costs its own length.
    """

    def runs(lines: Column) -> Column:
        if lines_are_blocks:
            at = F.array_compact(F.transform(lines, lambda x, i: F.when(x != "", i + 1)))
            return F.transform(at, lambda i: F.struct(F.element_at(lines, i).alias("block"), i.alias("start_line"), i.alias("end_line")))
        none, n = F.array(F.lit("")), F.size(lines)
        edge = lambda beside: F.array_compact(F.transform(F.zip_with(lines, beside, lambda x, y: (x != "") & (y == "")), lambda yes, i: F.when(yes, i + 1)))
        starts, stops = edge(F.concat(none, F.slice(lines, F.lit(1), n - 1))), edge(F.concat(F.slice(lines, F.lit(2), n), none))
        return F.zip_with(starts, stops, lambda a, b: F.struct(F.array_join(F.slice(lines, a, b - a + 1), "\n").alias("block"), a.alias("start_line"), b.alias("end_line")))

    lines = F.transform(F.split(F.col(text), "\n", -1), lambda x: F.regexp_replace(x, r"\s+$", ""))
    once = F.element_at(F.transform(F.array(lines), runs), 1)
    return df.select(key, F.posexplode(once).alias("ord", "b")).select(key, "ord", "b.block", "b.start_line", "b.end_line")


def parse_preface(c: Column | str, opening: str = "SOURCE METADATA", content: str = "ARTICLE CONTENT") -> Column:
    """(metadata, first_line): key: value lines between the opening and the content mark, and the mark's line number."""
    lines = F.transform(F.split(T._col(c), "\n", -1), lambda x: F.trim(x))
    start, stop = F.array_position(lines, opening), F.array_position(lines, content)
    pairs = F.filter(F.slice(lines, start + 1, F.greatest(stop - start - 1, F.lit(0))), lambda x: x.rlike(r"^[^:]+:\s*\S"))
    meta = F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)), F.trim(F.regexp_extract(x, r"^[^:]+:\s*(.*)$", 1)))))
    has = (start > 0) & (stop > start)
    return F.struct(F.when(has, meta).alias("metadata"), F.when(has, stop).otherwise(F.lit(1)).cast("int").alias("first_line"))


def text_blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """Blocks with type, search text, hash, ids, line places and the warning that text taken from a web page carries."""
    b = split_blocks(df, key, text)
    return b.select(
        T.stable_id("block", key, "ord", "block").alias("block_id"), key, F.lit("DERIVED_WEB_TEXT").alias("warning"), "ord", T.block_type("block").alias("type"), F.col("block").alias("citation_text"),
        T.normalize_search_text("block").alias("search_text"), F.sha2("block", 256).alias("content_hash"), "start_line", "end_line",
    )


def page_blocks(df: DataFrame, key: str, pages: str = "pages") -> DataFrame:
    """Blocks of page texts with page, page_index, block_index and a running order."""
    p = df.select(key, F.posexplode(pages).alias("page_index", "p")).select(key, "page_index", F.col("p.page").alias("page"), F.col("p.text").alias("text"))
    p = p.withColumn("_k", F.concat_ws(T.UNIT, F.col(key).cast("string"), F.col("page_index").cast("string")))
    b = split_blocks(p, "_k", "text").withColumnRenamed("ord", "block_index").join(p.select("_k", key, "page_index", "page"), "_k").drop("_k")
    order = F.row_number().over(W.partitionBy(key).orderBy("page_index", "block_index")) - 1
    return b.withColumn("ord", order).withColumn("block_id", T.stable_id("block", key, "page_index", "block_index", "block")).withColumn("type", T.block_type("block"))


def scraper_blocks(df: DataFrame, key: str, pages: str = "pages", text: str = "text") -> DataFrame:
    """Blocks of scraped documents: those of their pages and then those of their text, in one running order."""
    paged = page_blocks(df.where(F.size(pages) > 0), key, pages).select(key, F.lit(0).alias("_part"), "page_index", "page", "block_index", "block", "type")
    plain = split_blocks(df.where(F.length(text) > 0), key, text)
    plain = plain.select(key, F.lit(1).alias("_part"), F.lit(None).cast("int").alias("page_index"), F.lit(None).cast(paged.schema["page"].dataType).alias("page"), F.col("ord").alias("block_index"), "block", T.block_type("block").alias("type"))
    order = W.partitionBy(key).orderBy("_part", "page_index", "block_index")
    return paged.unionByName(plain).withColumn("ord", F.row_number().over(order) - 1).withColumn("block_id", T.stable_id("block", key, "ord", "block")).drop("_part")


def extraction_status(status: Column, flags: Column, pending: Column, n_ocr: Column, n_blocks: Column) -> Column:
    """OCR_REQUIRED, EMPTY or READY."""
    bad = F.coalesce(status.isin("needs_ocr", "ocr_partial", "ocr_error"), F.lit(False)) | F.coalesce(F.arrays_overlap(flags, F.array(F.lit("low_ocr_conf"), F.lit("ocr_truncated"), F.lit("ocr_timeout"))), F.lit(False))
    waiting = status.isNull() & (F.coalesce(F.size(pending), F.lit(0)) > 0) & n_ocr.isNull()
    return F.when(bad | waiting, "OCR_REQUIRED").when(n_blocks == 0, "EMPTY").otherwise("READY")


def structure(blocks: DataFrame, key: str, order: str = "ord", type_: str = "type", text: str = "citation_text") -> DataFrame:
    """Passages: blocks that are no headings, renumbered, each with the last heading before it."""
    w = W.partitionBy(key).orderBy(order)
    carried = F.last(F.when(F.col(type_) == "heading", F.col(text)), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    rows = blocks.withColumn("heading", carried).where(F.col(type_) != "heading")
    return rows.withColumn("passage_ord", F.row_number().over(w) - 1)


#: The source whose titles are cited by their field, the language where none is told, and keys of a preface.
TITLE_SOURCE, LANGUAGE = "municipal_corpus_api", "ro"
PREFACE = {"title": "Title", "publisher": "Publisher", "published_date": "Publication date", "language": "Language", "url": "Source URL"}


def structured_documents(documents: DataFrame) -> DataFrame:
    """documents with what their preface says put before what their manifest says, and what follows from it.

    documents: document_id, title, publisher, published_date, language, url, source_type, document_type, metadata (the preface's
    map, parse_preface). A key of the preface counts if it is not blank. More columns: image_url (of the preface),
    statistics_as_of (the date of publication), and title_citation (passage_id, quote, locator) for documents of the API, whose
    title is cited by its field; its passages' chunks open with it (merge_chunk).
    """
    said = {c: T.first_non_blank(F.try_element_at("metadata", F.lit(k)), F.col(c)) for c, k in PREFACE.items()}
    rows = documents.withColumns(said | {"language": F.coalesce(said["language"], F.lit(LANGUAGE)), "document_type": T.doc_type("document_type", "source_type"), "image_url": T.first_non_blank(F.try_element_at("metadata", F.lit("Main image URL")))})
    locator = F.struct(F.lit("api_metadata").alias("kind"), F.lit("title").alias("field"))
    cited = F.struct(T.stable_id("passage", "document_id", F.lit("api_metadata"), F.lit("title"), "title").alias("passage_id"), F.col("title").alias("quote"), locator.alias("locator"))
    return rows.withColumns({"statistics_as_of": F.col("published_date"), "title_citation": F.when((F.col("source_type") == TITLE_SOURCE) & F.col("title").isNotNull(), cited)})


def document_hash(df: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """SHA-256 of a document's texts in order, a blank line between them."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text])
    return df.groupBy(key).agg(F.sha2(F.array_join(texts, "\n\n"), 256).alias("document_hash"))


def reassemble(df: DataFrame, keys: list[str], order: str, text: str, glue: str = " ") -> DataFrame:
    """Sections put together from their fragments in order, with the number of fragments."""
    parts = F.array_sort(F.collect_list(F.struct(order, text)))
    return df.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x[text]), glue).alias("section"), F.count("*").alias("fragments"))


def passage_quality(text: Column, validated: Column, least_words: int = 4, kind: Column | None = None, known: Column | None = None) -> Column:
    """(issues, status): EMPTY_PASSAGE, ENCODING_NOISE, FRAGMENT (of body text, where kind is given), OCR_NOISE, and those
    known already; READY only if validated and without one."""
    t = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(t, F.lit(r"\p{L}+"), F.lit(0))
    single = F.size(F.filter(words, lambda w: F.length(w) == 1))
    marks = F.length(t) - F.length(F.regexp_replace(t, r"\?", ""))
    empty = F.length(F.trim(t)) == 0
    codes = F.array_compact(
        F.array(
            F.when(empty, "EMPTY_PASSAGE"),
            F.when(t.contains("�") | (marks > F.greatest(F.lit(4.0), F.length(t) / 30)), "ENCODING_NOISE"),
            F.when((F.lit(True) if kind is None else kind == "body") & ~empty & (F.size(F.filter(F.split(F.trim(t), r"\s+"), lambda w: w != "")) < least_words), "FRAGMENT"),
            F.when((F.size(words) >= 10) & (single > 0.4 * F.size(words)), "OCR_NOISE"),
        )
    )
    issues = F.array_sort(codes if known is None else F.array_union(codes, F.coalesce(known, F.array().cast("array<string>"))))
    return F.struct(issues.alias("issues"), F.when(validated & (F.size(issues) == 0), "READY").otherwise("QUARANTINED").alias("status"))


def exact_parts(text: str, budget: int, overlap: int = 1) -> list[tuple[str, int, int]]:
    """A text cut into parts of whole sentences under a token budget, the last `overlap` sentences of a part opening the next;
    a sentence over the budget is cut at white space. Every part equals text[start:end]. It ends with the last sentence.

    A sentence ends before white space that stands after . ! ? … and before a capital or a digit. Tokens are found once, and
    a stretch's tokens are counted by the places of its ends.
    """
    import re
    from bisect import bisect_left

    places = [m.start() for m in re.finditer(r"\w+|[^\w\s]", text)]

    def tokens(a: int, b: int) -> int:
        return max(1, int(1.25 * (bisect_left(places, b) - bisect_left(places, a)) + 0.5))

    spans: list[tuple[int, int]] = []
    at = 0
    for m in [*re.finditer(r"(?<=[.!?…])\s+(?=[A-ZĂÂÎȘȚА-ЯЁ0-9])", text), None]:
        end = m.start() if m else len(text)
        start = at + len(text[at:end]) - len(text[at:end].lstrip())
        stop = start + len(text[start:end].rstrip())
        at = m.end() if m else end
        if start >= stop:
            continue
        if tokens(start, stop) <= budget:
            spans.append((start, stop))
            continue
        lo = start
        words = [(w.start() + start, w.end() + start) for w in re.finditer(r"\S+", text[start:stop])]
        for k, (_, b) in enumerate(words):
            nxt = words[k + 1] if k + 1 < len(words) else None
            if nxt is None or tokens(lo, nxt[1]) > budget:
                spans.append((lo, b))
                lo = nxt[0] if nxt else lo
    out, i = [], 0
    while i < len(spans):
        j = i + 1
        while j < len(spans) and tokens(spans[i][0], spans[j][1]) <= budget:
            j += 1
        out.append((text[spans[i][0] : spans[j - 1][1]], spans[i][0], spans[j - 1][1]))
        if j >= len(spans):
            break
        i = max(j - overlap, i + 1)
        while i < j and tokens(spans[i][0], spans[j][1]) > budget:  # no room for the overlap beside the next sentence
            i += 1
    return out


def split_exact(df: DataFrame, key: str, text: str, budget: int | str, overlap: int = 1) -> DataFrame:
    """Rows (key, part, quote, char_start, char_end) of exact_parts: a fold whose steps depend on each other, inside one text.
    budget is a number of tokens, or a column that has each row's own."""
    schema = f"{key} {df.schema[key].dataType.simpleString()}, part int, quote string, char_start int, char_end int"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, n, *p) for k, t, limit in zip(f[key], f["_text"], f["_budget"], strict=True) for n, p in enumerate(exact_parts(t or "", limit, overlap))]
            yield pd.DataFrame(rows, columns=[key, "part", "quote", "char_start", "char_end"])

    limit = F.lit(budget) if isinstance(budget, int) else F.col(budget)
    return df.select(key, F.col(text).alias("_text"), limit.cast("int").alias("_budget")).mapInPandas(run, schema)


def evidence_budget(context: Column, limit: int) -> Column:
    """Tokens left for the quote beside its context line, at least 32."""
    return F.greatest(F.lit(32).cast("bigint"), limit - T.estimate_tokens(context) - 2)


def build_evidence(documents: DataFrame, passages: DataFrame, limit: int = 420) -> DataFrame:
    """The rows of the index: each passage cut into exact quotes that fit `limit` tokens beside their document's context.

    documents: document_id, version_id, title, published_date (text), district. passages: document_id, passage_id, type,
    heading_path, citation_text, validated, issues (known already). The context is the title, the headings but those that
    repeat it, and the date; it stands in the retrieval text and never in the quote. A passage that is not validated or has an
    issue needs review, with all its parts. Passages without text have no row.
    """
    key = lambda c: F.lower(F.regexp_replace(T.normalize_search_text(c, compose=False), "^[# ]+", ""))
    rows = passages.join(documents.select("document_id", "version_id", T.nfc("title").alias("title"), "published_date", "district"), "document_id")
    heading = F.filter(F.coalesce("heading_path", F.array().cast("array<string>")), lambda h: key(h) != key(F.col("title")))
    rows = rows.withColumn("heading", heading).withColumn("kind", T.evidence_kind("type"))
    dated = F.when(F.length("published_date") > 0, F.concat(F.lit("Data publicării: "), F.col("published_date")))
    rows = rows.withColumn("context", F.concat_ws(" | ", "title", "heading", dated)).withColumn("budget", evidence_budget(F.col("context"), limit))
    rows = rows.withColumn("q", passage_quality(F.col("citation_text"), F.coalesce("validated", F.lit(False)), kind=F.col("kind"), known=F.col("issues")))
    rows = rows.withColumn("row_id", T.stable_id("row", "document_id", "version_id", "passage_id"))
    parts = split_exact(rows, "row_id", "citation_text", "budget")
    rows = rows.join(parts, "row_id")
    retrieval = F.concat("context", F.lit("\n\n"), T.normalize_search_text("quote"))
    ready = F.col("q.status") == "READY"
    return rows.withColumn("retrieval_text", retrieval).select(
        T.stable_id("evidence", "document_id", "version_id", "passage_id", F.col("part") + 1, F.sha2("quote", 256)).alias("evidence_id"),
        "document_id", "version_id", "passage_id", (F.col("part") + 1).alias("part"), "retrieval_text", F.col("quote").alias("citation_text"), "char_start", "char_end",
        F.sha2("retrieval_text", 256).alias("text_sha256"), T.estimate_tokens("retrieval_text").alias("token_estimate"), F.col("kind").alias("evidence_kind"), "heading",
        T.fact_matches("quote").alias("facts"), F.array_compact(F.array(F.when(F.length("district") > 0, F.col("district")))).alias("locations"),
        F.col("q.issues").alias("issue_codes"), F.when(ready, "READY").otherwise("NEEDS_REVIEW").alias("indexing_status"), F.when(ready, "production").otherwise("review").alias("target_collection"),
    )


def ready_chunks(documents: DataFrame, passages: DataFrame, max_tokens: int = 420) -> DataFrame:
    """Those rows of build_evidence that may be indexed; the limit is at least 64 tokens and counts up to 420."""
    if max_tokens < 64:
        raise ValueError("max_tokens must be at least 64")
    return build_evidence(documents, passages, min(max_tokens, 420)).where("indexing_status = 'READY'")


def merge_chunk(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """Chunks of several passages: rows (document_id, chunk, chunk_id, text, citation_text, token_estimate, passage_ids,
    citations, status).

    documents: document_id, title, published_date, title_citation (struct passage_id, quote, or null), data_ok, citations_ok.
    passages: document_id, chunk, passage_ord, passage_id, heading_path, search_text, citation_text, data_ok, citations_ok.
    The text is the title, the date and the first passage's headings, and below them the passages in order; citations begin
    with the title's. A chunk needs review if its document or a passage does, before it waits for citations.
    """
    ordered = F.array_sort(F.collect_list(F.struct("passage_ord", "passage_id", "heading_path", "search_text", "citation_text")))
    rows = passages.groupBy("document_id", "chunk").agg(ordered.alias("p"), F.bool_and("data_ok").alias("_data"), F.bool_and("citations_ok").alias("_cited"))
    rows = rows.join(documents, "document_id")
    joined = lambda f: F.array_join(F.transform("p", lambda x: x[f]), "\n\n")
    ids = F.transform("p", lambda x: x["passage_id"])
    dated = F.when(F.length("published_date") > 0, F.concat(F.lit("Publicat: "), F.col("published_date")))
    text = F.concat(F.concat_ws(" | ", "title", dated, F.element_at("p", 1)["heading_path"]), F.lit("\n\n"), joined("search_text"))
    quote = lambda i, q: F.struct(i.alias("passage_id"), q.alias("quote"))
    of_title = F.array_compact(F.array(F.when(F.col("title_citation").isNotNull(), quote(F.col("title_citation.passage_id"), F.col("title_citation.quote")))))
    rows = rows.withColumn("text", text)
    return rows.select(
        "document_id", "chunk", T.stable_id("chunk", "document_id", "chunk", F.array_join(ids, T.UNIT)).alias("chunk_id"), "text", joined("citation_text").alias("citation_text"),
        T.estimate_tokens("text").alias("token_estimate"), ids.alias("passage_ids"), F.concat(of_title, F.transform("p", lambda x: quote(x["passage_id"], x["citation_text"]))).alias("citations"),
        chunk_status(F.col("data_ok") & F.col("_data"), F.col("citations_ok") & F.col("_cited")).alias("status"),
    )


def source_previews(evidence: DataFrame) -> DataFrame:
    """Rows (document_id, version_id, passage_id, place, text, evidence_ids): passages put together from their parts by
    char_start, in the order of page, line, block and id, a missing one counting as 10**9; place counts from 0.

    evidence: document_id, version_id, passage_id, evidence_id, citation_text, char_start, page, start_line, block_index.
    """
    part = F.struct(F.coalesce("char_start", F.lit(10**9)).alias("at"), "evidence_id", "citation_text")
    at = lambda c: F.coalesce(F.min(c), F.lit(10**9)).alias(c)
    rows = evidence.groupBy("document_id", "version_id", "passage_id").agg(F.array_sort(F.collect_list(part)).alias("p"), at("page"), at("start_line"), at("block_index"))
    w = W.partitionBy("document_id", "version_id").orderBy("page", "start_line", "block_index", F.element_at("p", 1)["evidence_id"])
    return rows.select(
        "document_id", "version_id", "passage_id", (F.row_number().over(w) - 1).alias("place"),
        F.array_join(F.transform("p", lambda x: x["citation_text"]), " ").alias("text"), F.transform("p", lambda x: x["evidence_id"]).alias("evidence_ids"),
    )


def _token_marks(s: str) -> int:
    """Words and punctuation marks of a text; those of texts joined by blank lines add up."""
    import re

    return sum(1 for _ in re.finditer(r"\w+|[^\w\s]", s))


def _tokens(s: str) -> int:
    return max(1, int(1.25 * _token_marks(s) + 0.5))


def packing_function(kind: str, budget: int, *, emit: int = 1024):
    """A table function for passages of one document at a time, in order: rows (document, chunk, passages, text), neighbours of one
    heading merged under a token budget, events alone. kind is the type of the document's key.

    Its input (key, passage_ord, type, heading, citation_text) is partitioned by the key and ordered by passage_ord. Passages
    come in batches of Arrow's and chunks leave `emit` at a time; only the chunk that is open is held, so a document may
    have any number of passages. In SQL, once registered: pack(TABLE(passages) PARTITION BY document ORDER BY passage_ord).
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    key_type = to_arrow_type(StructType.fromDDL(f"k {kind}").fields[0].dataType)

    def batch(rows: list[tuple]) -> pa.Table:
        kinds = (key_type, pa.int32(), pa.list_(pa.int32()), pa.string())
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["document", "chunk", "passages", "text"])

    @arrow_udtf(returnType=f"document {kind}, chunk int, passages array<int>, text string")
    class PackPassages:
        def __init__(self):
            self.done, self.chunk, self.open = [], 0, None

        def _close(self) -> None:
            if self.open is not None:
                key, places, texts, _, _ = self.open
                self.done.append((key, self.chunk, places, "\n\n".join(texts)))
                self.chunk, self.open = self.chunk + 1, None

        def eval(self, passages: pa.Table):
            for key, place, type_, heading, text in zip(*(c.to_pylist() for c in passages.itercolumns()), strict=True):
                own, n = type_ == "municipal_event", _token_marks(text or "")
                if self.open is not None and not own and self.open[3] == (heading, False) and max(1, int(1.25 * (self.open[4] + n) + 0.5)) <= budget:
                    self.open[1].append(place)
                    self.open[2].append(text or "")
                    self.open[4] += n
                else:
                    self._close()
                    self.open = [key, [place], [text or ""], (heading, own), n]
                if len(self.done) >= emit:
                    yield batch(self.done)
                    self.done = []

        def terminate(self):
            self._close()
            if self.done:
                yield batch(self.done)

    return PackPassages


def pack_passages(df: DataFrame, key: str, budget: int) -> DataFrame:
    """Neighbouring passages of one heading merged under a token budget; events stay alone. Rows (key, chunk, passages, text).

    Whether a passage fits depends on those before it, so a document's passages are walked through in order, by a table function
    that holds one chunk (packing_function); documents are dealt out by key. A null text is an empty one.
    """
    rows = df.select(key, F.col("passage_ord").cast("int").alias("passage_ord"), "type", "heading", "citation_text")
    packed = packing_function(df.schema[key].dataType.simpleString(), budget)(rows.asTable().partitionBy(key).orderBy("passage_ord"))
    return packed.withColumnRenamed("document", key)


@udtf(returnType="part int, quote string, char_start int, char_end int")
class SplitExact:
    """exact_parts as a table function: in SQL, once registered, FROM texts, LATERAL split_exact(text, budget, overlap)."""

    def eval(self, text: str, budget: int, overlap: int = 1):
        for n, part in enumerate(exact_parts(text or "", budget, overlap)):
            yield n, *part


def register_table_functions(spark: SparkSession, kind: str = "string", budget: int = 420) -> None:
    """split_exact(text, budget, overlap) and pack_passages(TABLE(...) PARTITION BY ... ORDER BY ...) for this session's SQL."""
    spark.udtf.register("split_exact", SplitExact)
    spark.udtf.register("pack_passages", packing_function(kind, budget))


def chunk_status(data_ok: Column, citations_ok: Column) -> Column:
    return F.when(~data_ok, "NEEDS_REVIEW").when(~citations_ok, "CITATION_PENDING").otherwise("READY")


def catalog(df: DataFrame, key: str, order: str, *fields: str) -> DataFrame:
    """One row for each document: its first row's fields joined."""
    first = df.groupBy(key).agg(F.min_by(F.concat_ws(" ", *fields), order).alias("catalog_text"))
    return first
