"""Search over tables of queries: postings, BM25, dense top-k, rank fusion, caps and context."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lexiforge.functions import packs
from lexiforge.functions.text import tokenize_stem
from lexiforge.store import materialize

#: Fixed values of the lexical weight: saturation, length share, nominal length.
K1, B, NOMINAL = 1.2, 0.75, 120


def term_counts(df: DataFrame, key: str, terms: Column) -> DataFrame:
    """Rows (key, term, tf, length): how often each term stands in a row, and the row's number of terms."""
    words = df.select(key, terms.alias("w"))
    exploded = words.select(key, F.size("w").alias("length"), F.explode("w").alias("term"))
    return exploded.groupBy(key, "term", "length").agg(F.count("*").alias("tf"))


def lexical_weight(tf: Column, length: Column) -> Column:
    """tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / 120)): saturated, against a fixed nominal length."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / NOMINAL))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def postings(docs: DataFrame, key: str, text: str, terms: Callable[[Column], Column] = tokenize_stem) -> DataFrame:
    """The inverted index: rows (key, term, weight)."""
    counts = term_counts(docs, key, terms(F.col(text)))
    return counts.select(key, "term", lexical_weight(F.col("tf"), F.col("length")).alias("weight"))


def corpus_stats(index: DataFrame, key: str) -> DataFrame:
    """Rows (term, df): in how many rows of the index each term stands."""
    return index.groupBy("term").agg(F.count(key).alias("df"))


def document_frequency(docs: DataFrame, terms: Column) -> DataFrame:
    """Rows (term, df): in how many rows each term stands, by one count of each row's distinct terms."""
    return docs.select(F.explode(F.array_distinct(terms)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def top_per(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark keeps at most k rows a group before the shuffle."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int, query_key: str, key: str, vector: str = "embedding", *, block: int = 4096) -> DataFrame:
    """Rows (query_key, rank, key, score): the k vectors of each query with the highest cosine; ties by key.

    Queries are taken in blocks of `block` rows, so the broadcast is bounded; every task keeps the best k of its rows for
    each query (_best_of), and only those are shuffled. Zero vectors and vectors of another length score nothing.
    """
    spark = vectors.sparkSession
    rows = queries.select(F.col(query_key).alias("q"), F.col(vector).alias("v")).where("v is not null")
    parts = max(1, -(-rows.count() // block))
    data = vectors.select(F.col(key).alias("k"), F.col(vector).alias("v")).where("v is not null")
    schema = f"{query_key} bigint, {key} bigint, score double"
    out = None
    for p in range(parts):
        mine = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("q"), F.lit(parts)) == p)
        got = mine.collect()  # about `block` rows
        ids, matrix = np.array([r["q"] for r in got], dtype=np.int64), np.array([r["v"] for r in got], dtype=np.float64)
        if not len(ids):
            continue
        norm = np.linalg.norm(matrix, axis=1)
        ids, matrix = ids[norm > 0], matrix[norm > 0] / norm[norm > 0, None]
        shared = spark.sparkContext.broadcast((ids, matrix))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            yield _best_of(batches, *shared.value, k, [query_key, key, "score"])

        found = data.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], schema)
    out = out.withColumn("score", F.round("score", 6))
    return top_per(out, [query_key], [F.desc("score"), F.asc(key)], k).select(query_key, "rank", key, "score")


def _best_of(batches: Iterator[pa.RecordBatch], ids: np.ndarray, matrix: np.ndarray, k: int, names: list[str], few: int = 256) -> pa.RecordBatch:
    """The best k of the vectors (key, vector) for each query, a row of matrix: vectors are met 512 at a time by `few` queries at
    a time, so beside the best there are never more scores than that."""
    best = [(np.zeros((len(ids[q : q + few]), 0), dtype=np.int64), np.zeros((len(ids[q : q + few]), 0))) for q in range(0, len(ids), few)]
    for batch in (b.slice(lo, 512) for b in batches for lo in range(0, b.num_rows, 512)):
        vs = [(a, v) for a, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if len(v) == matrix.shape[1]]
        if not vs:
            continue
        x = np.array([v for _, v in vs], dtype=np.float64)
        norm = np.linalg.norm(x, axis=1)
        keys = np.array([a for a, _ in vs], dtype=np.int64)[norm > 0]
        x = (x[norm > 0] / norm[norm > 0, None]).T
        for i, (best_k, best_s) in enumerate(best):
            s = np.round(matrix[i * few : (i + 1) * few] @ x, 9)
            best_k = np.concatenate([best_k, np.broadcast_to(keys, s.shape)], axis=1)
            best_s = np.concatenate([best_s, s], axis=1)
            if best_s.shape[1] > 4 * k:  # what is below the k-th score goes before the sort, ties stay
                least = -np.partition(-best_s, k - 1, axis=1)[:, k - 1]
                keep = (best_s >= least[:, None]).any(axis=0)
                best_k, best_s = best_k[:, keep], best_s[:, keep]
            order = np.lexsort((best_k, -best_s), axis=1)[:, :k]
            best[i] = np.take_along_axis(best_k, order, 1), np.take_along_axis(best_s, order, 1)
    n = best[0][0].shape[1] if best else 0
    flat = [np.concatenate([np.zeros(0, dtype), *(b[j].ravel() for b in best)]) for j, dtype in ((0, np.int64), (1, np.float64))]
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), *map(pa.array, flat)], names)


def dense_pairs(queries: DataFrame, vectors: DataFrame, least: float, query_key: str, key: str, vector: str = "embedding", *, block: int = 4096) -> DataFrame:
    """Rows (query_key, key, score): every vector whose cosine with a query reaches `least`.

    Queries are taken in blocks of `block` rows, so the broadcast is bounded; each task multiplies its vectors, 512 at a time,
    with the block and writes only what reaches the threshold: no join of all with all. Zero vectors and vectors of another
    length match nothing.
    """
    spark = vectors.sparkSession
    rows = queries.select(F.col(query_key).alias("q"), F.col(vector).alias("v")).where("v is not null")
    parts = max(1, -(-rows.count() // block))
    data = vectors.select(F.col(key).alias("k"), F.col(vector).alias("v")).where("v is not null")
    schema = f"{query_key} {queries.schema[query_key].dataType.simpleString()}, {key} {vectors.schema[key].dataType.simpleString()}, score double"
    out = spark.createDataFrame([], schema)
    for p in range(parts):
        got = (rows if parts == 1 else rows.where(F.pmod(F.xxhash64("q"), F.lit(parts)) == p)).collect()  # about `block` rows
        if not got:
            continue
        matrix = np.array([r["v"] for r in got], dtype=np.float64)
        norm = np.linalg.norm(matrix, axis=1)
        shared = spark.sparkContext.broadcast(([r["q"] for r, n in zip(got, norm, strict=True) if n > 0], matrix[norm > 0] / norm[norm > 0, None]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, matrix = shared.value
            for batch in (b.slice(lo, 512) for b in batches for lo in range(0, b.num_rows, 512)):
                vs = [(i, v) for i, v in enumerate(batch.column(1).to_pylist()) if len(v) == matrix.shape[1]]
                if not vs:
                    continue
                x = np.array([v for _, v in vs], dtype=np.float64)
                norm = np.linalg.norm(x, axis=1)
                at = np.array([i for i, _ in vs])[norm > 0]
                s = np.clip(matrix @ (x[norm > 0] / norm[norm > 0, None]).T, -1.0, 1.0)
                q, k = np.nonzero(s >= least)
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in q], to_arrow_type(q_type)), batch.column(0).take(pa.array(at[k])), pa.array(s[q, k])], [query_key, key, "score"])

        q_type = queries.schema[query_key].dataType
        out = out.unionByName(data.mapInArrow(run, schema))
    return out


def fuse_rrf(ranks: DataFrame, query_key: str, key: str, k: int = 60) -> DataFrame:
    """Rows (query_key, key, score, ranks): the sum of 1 / (k + rank) over a long table of channels, and the channels' ranks."""
    return ranks.groupBy(query_key, key).agg(F.sum(1 / (k + F.col("rank"))).alias("score"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", "rank")))).alias("ranks"))


def add_bonus(fused: DataFrame, catalog: DataFrame, query_key: str, document: str, k: int = 60) -> DataFrame:
    """Fused scores plus 1 / (k + rank) of the document's place in a catalog search, if it has one; ranks gets that place."""
    bonus = catalog.select(query_key, document, F.col("rank").alias("_rank"))
    found = fused.join(bonus, [query_key, document], "left").withColumn("score", F.col("score") + F.coalesce(1 / (k + F.col("_rank")), F.lit(0.0)))
    if "ranks" in fused.columns:
        found = found.withColumn("ranks", F.when(F.col("_rank").isNull(), F.col("ranks")).otherwise(F.map_concat("ranks", F.create_map(F.lit("catalog"), F.col("_rank")))))
    return found.drop("_rank")


def cap_per_document(df: DataFrame, query_key: str, document: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each document of a query, in rank order."""
    return top_per(df, [query_key, document], order, n, "_place").drop("_place")


def prioritize_channels(df: DataFrame, query_key: str, key: str, document: str, channels: list[str], limit: int, per_document: int) -> DataFrame:
    """At most `limit` rows of each query in their order: first the best row of each channel in turn, then by score, never
    more than per_document of one document.

    df has score and ranks (channel to rank). The choice of a row depends on those before it, so each query's candidates
    (a few hundred, as many as its channels return) are walked through in one call. Gives df's columns and place.
    """

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(_id=rows[key].astype(str)).sort_values(["score", "_id"], ascending=[False, True], kind="stable")
        taken, held = [], {}

        def take(i: object) -> bool:
            doc = rows.at[i, document]
            if i in taken or held.get(doc, 0) >= per_document or len(taken) >= limit:
                return False
            held[doc] = held.get(doc, 0) + 1
            taken.append(i)
            return True

        for channel in channels:
            ranked = sorted((dict(rows.at[i, "ranks"])[channel], rows.at[i, "_id"], i) for i in rows.index if channel in dict(rows.at[i, "ranks"]))
            any(take(i) for _, _, i in ranked)
        for i in rows.index:
            take(i)
        return rows.loc[taken].drop(columns="_id").assign(place=range(1, len(taken) + 1))

    from pyspark.sql.types import IntegerType, StructType

    return df.groupBy(query_key).applyInPandas(choose, StructType([*df.schema.fields]).add("place", IntegerType()))


def following_context(anchors: DataFrame, passages: DataFrame, query_key: str, *, per_anchor: int = 6, per_query: int = 12) -> DataFrame:
    """Rows (query_key, document, pos, score, anchor_pos, distance): passages after an anchor of the same document.

    anchors: query_key, document, pos, score. passages: document, pos (whole numbers without gaps in a document). The next
    per_anchor passages score anchor / (distance + 1). One that several anchors reach counts for the first of them in
    order of score; anchors themselves are not repeated; a query gets per_query in all.
    """
    reach = anchors.select(query_key, "document", F.col("pos").alias("anchor_pos"), F.col("score").alias("anchor_score"), F.explode(F.sequence(F.lit(1), F.lit(per_anchor))).alias("distance"))
    near = reach.withColumn("pos", F.col("anchor_pos") + F.col("distance")).join(passages.select("document", "pos"), ["document", "pos"])
    near = near.join(anchors.select(query_key, "document", "pos"), [query_key, "document", "pos"], "left_anti")
    near = top_per(near, [query_key, "document", "pos"], [F.desc("anchor_score"), F.asc("anchor_pos")], 1, "_n").drop("_n")
    near = top_per(near, [query_key], [F.desc("anchor_score"), F.asc("document"), F.asc("anchor_pos"), F.asc("distance")], per_query, "_n")
    return near.select(query_key, "document", "pos", (F.col("anchor_score") / (F.col("distance") + 1)).alias("score"), "anchor_pos", "distance")


def introduces(kind: Column | str, quote: Column | str, pattern: str = packs.INTRODUCES) -> Column:
    """A passage that what follows belongs to: a headline, one that ends with a colon, or one that speaks of steps or a list."""
    k, q = (F.col(c) if isinstance(c, str) else c for c in (kind, quote))
    said = F.trim(F.coalesce(q, F.lit("")))
    return F.coalesce(F.lower(k) == "headline", F.lit(False)) | said.endswith(":") | F.lower(said).rlike("(?U)" + pattern)


def eligible_with_context(ranked: DataFrame, least: float, query_key: str, key: str, anchor: str) -> DataFrame:
    """Rows that score `least` or more, and rows whose anchor does."""
    good = ranked.where(F.col("score") >= least).select(query_key, F.col(key).alias("_anchor")).distinct()
    held = ranked.where(F.col("score") < least).join(good, (ranked[query_key] == good[query_key]) & (ranked[anchor] == good["_anchor"]), "left_semi")
    return ranked.where(F.col("score") >= least).unionByName(held)


def hybrid_search(
    dense: DataFrame,
    sparse: DataFrame,
    requirements: dict[str, DataFrame],
    query_key: str,
    key: str,
    points: DataFrame,
    *,
    catalog: DataFrame | None = None,
    scores: DataFrame | None = None,
    limit: int = 16,
    per_document: int = 3,
    final: int = 12,
    least: float = 0.0,
    k: int = 60,
    per_anchor: int = 6,
    per_query: int = 12,
) -> DataFrame:
    """Rows (query_key, key, document, score, ranks, rerank_score, anchor, place): the whole search of a table of queries.

    dense, sparse and the requirement channels are ranks (query_key, rank, key); points maps key to document and pos (whole
    numbers without gaps in a document), kind and quote; catalog ranks documents (query_key, rank, document). Ranks are fused
    and get their document's bonus; `limit` candidates are chosen by prioritize_channels; passages that introduce something
    bring what follows them; scores (query_key, key, score in 0..1) re-rank all of these, the others standing below with their
    fused score; rows of `least` or more, and those whose anchor is one, are chosen from again, `final` of them.
    """
    ranks = None
    for name, df in {"dense": dense, "sparse": sparse, **requirements}.items():
        part = df.select(query_key, key, F.col("rank"), F.lit(name).alias("channel"))
        ranks = part if ranks is None else ranks.unionByName(part)
    fused = fuse_rrf(ranks, query_key, key, k).join(points, key)
    if catalog is not None:
        fused = add_bonus(fused, catalog, query_key, "document", k)
    names = list(requirements)
    chosen = materialize(prioritize_channels(fused, query_key, key, "document", names, limit, per_document), "candidates")
    after = following_context(chosen.where(introduces("kind", "quote")), points, query_key, per_anchor=per_anchor, per_query=per_query)
    after = after.join(points.select("document", "pos", key, "kind", "quote"), ["document", "pos"])
    after = after.join(chosen.select(query_key, key), [query_key, key], "left_anti")  # candidates that are no anchors are not repeated either
    heads = points.select("document", F.col("pos").alias("anchor_pos"), F.col(key).alias("anchor"))
    after = after.join(heads, ["document", "anchor_pos"]).withColumn("ranks", F.create_map(F.lit("contextAfter"), F.col("distance")))
    cols = [query_key, key, "document", "score", "ranks", "anchor"]
    rows = chosen.withColumn("anchor", F.lit(None).cast(points.schema[key].dataType)).select(*cols).unionByName(after.select(*cols))
    if scores is not None:
        given = scores.where(F.col("score").between(0, 1)).select(query_key, key, F.col("score").alias("rerank_score")).dropDuplicates([query_key, key])
        rows = rows.join(given, [query_key, key], "left")
    else:
        rows = rows.withColumn("rerank_score", F.col("score").cast("double"))
    rows = rows.withColumnRenamed("score", "fused").withColumn("score", F.coalesce("rerank_score", F.lit(0.0)))
    rows = eligible_with_context(rows, least, query_key, key, "anchor")
    out = prioritize_channels(rows, query_key, key, "document", names, final, final)
    return out.select(query_key, key, "document", F.col("fused").alias("score"), "ranks", "rerank_score", "anchor", "place")
