"""Packing: length buckets chosen by dynamic programming, token-budget batches inside each bucket."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiforge.llm.common import table
from lexiforge.store import materialize


def word_count(text: Column) -> Column:
    """Words of a text, runs of characters other than 0x20 and 0x09-0x0D; 0 for a null or empty text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))


def choose_buckets(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most `buckets` length buckets with the least padding in total.

    Padding is what fills each sequence up to its bucket's bound. best[b][j] is the least padding of the first j lengths in
    b buckets: the minimum over i of best[b-1][i] plus the padding of lengths i..j under the bound lengths[j]. Each step is
    one vector operation; of equal splits the one with the lower cut is taken, and fewer buckets win a tie.
    """
    lengths, counts = np.asarray(lengths, dtype=np.int64), np.asarray(counts, dtype=np.int64)
    n = len(lengths)
    if not n:
        return []
    many, mass = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * lengths)])
    far = np.iinfo(np.int64).max // 4
    best = np.full(n + 1, far)
    best[0] = 0
    cuts, finals = [], []
    for _ in range(min(buckets, n)):
        now, cut = np.full(n + 1, far), np.zeros(n + 1, dtype=np.int64)
        for j in range(1, n + 1):
            pad = best[:j] + lengths[j - 1] * (many[j] - many[:j]) - (mass[j] - mass[:j])
            cut[j] = np.argmin(pad)
            now[j] = pad[cut[j]]
        cuts.append(cut)
        finals.append(now[n])
        best = now
    b, j, out = int(np.argmin(finals)), n, []
    while j > 0:
        out.append(int(lengths[j - 1]))
        j = int(cuts[b][j])
        b -= 1
    return out[::-1]


def pack(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    *,
    max_len: int = 1024,
    buckets: int = 8,
    budget: int = 32_768,
    length: Column | None = None,
    ids: str | None = None,
    pad: int = 0,
) -> DataFrame:
    """Sequences of at most max_len tokens, each in a length bucket and a batch: rows (doc_id, segment, first_token,
    n_tokens, bucket_len, batch, slot), and with ids the column tokens.

    ids names a column of docs with token ids (an array): its size is the length, and tokens has each sequence's ids, filled
    up with pad to bucket_len; the first n_tokens of them count. Else length is a column of docs' token counts, words by
    default. A document longer than max_len becomes several segments
    that cover it whole; a null or empty text is one segment of 0 tokens in the lowest bucket. The histogram of all segment
    lengths (max_len + 1 rows at most) gives the bucket bounds. In a bucket sequences stand in the order of an md5 of id and
    segment, and batch k holds slots k * m to k * m + m - 1, m being how many padded sequences the token budget pays for.

    The place in a bucket is counted in two steps, because one bucket may hold most rows: rows are ranked inside slices of
    the md5 (their number follows the row count, about 50,000 rows each) and slices get the sum of those before them.
    Repeated rows are packed as often as they stand in docs; the md5 takes in a hash of the text, so rows without an id and
    rows that share one are spread too, and ties of it are broken by id, segment and length.
    """
    if ids is not None:
        length = F.size(F.coalesce(ids, F.array().cast(docs.schema[ids].dataType)))
    n = F.greatest(F.coalesce(length if length is not None else word_count(F.col(text)), F.lit(0)), F.lit(0)).cast("bigint")
    salt = F.xxhash64(ids if ids is not None else text)
    base = docs.select(F.col(doc_id).alias("doc_id"), n.alias("n"), salt.alias("salt"), *([F.col(ids).alias("ids")] if ids is not None else []))
    own = [F.slice("ids", (F.col("segment") * max_len + 1).cast("int"), F.lit(max_len)).alias("ids")] if ids is not None else []
    seq = base.select("doc_id", "n", "salt", *(["ids"] if ids is not None else []), F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.floor((F.col("n") - 1) / max_len), F.lit(0)).cast("bigint"))).alias("segment")).select(
        "doc_id",
        F.col("segment").cast("int").alias("segment"),
        (F.col("segment") * max_len).alias("first_token"),
        F.least(F.col("n") - F.col("segment") * max_len, F.lit(max_len)).cast("int").alias("n_tokens"),
        F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("segment").cast("string"), F.col("salt").cast("string"))).alias("mix"),
        *own,
    )
    seq = materialize(seq, "sequences")
    histogram = seq.groupBy("n_tokens").count().orderBy("n_tokens").collect()  # max_len + 1 rows at most
    bounds = choose_buckets(np.array([r["n_tokens"] for r in histogram]), np.array([r["count"] for r in histogram]), buckets)
    total = sum(r["count"] for r in histogram)
    digits = max(1, int(np.ceil(np.log(max(1, total / 50_000)) / np.log(16))))
    if not bounds:
        bounds = [0]
    bucket = F.coalesce(*[F.when(F.col("n_tokens") <= b, F.lit(b)) for b in bounds])
    placed = seq.withColumn("bucket_len", bucket.cast("int")).withColumn("slice", F.substring("mix", 1, digits))
    slices = placed.groupBy("bucket_len", "slice").count()
    before = slices.select("bucket_len", "slice", (F.sum("count").over(W.partitionBy("bucket_len").orderBy("slice")) - F.col("count")).alias("before"))
    before = materialize(before, "slices")
    in_slice = W.partitionBy("bucket_len", "slice").orderBy("mix", "doc_id", "segment", "n_tokens")
    place = F.col("before") + F.row_number().over(in_slice) - 1
    per_batch = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket_len"), F.lit(1)))).cast("bigint")
    padded = []
    if ids is not None:
        kind = docs.schema[ids].dataType
        padded = [F.concat(F.coalesce("ids", F.array().cast(kind)), F.array_repeat(F.lit(pad).cast(kind.elementType), F.col("bucket_len") - F.col("n_tokens"))).alias("tokens")]
    return (
        placed.join(before, ["bucket_len", "slice"])
        .withColumn("place", place)
        .select("doc_id", "segment", "first_token", "n_tokens", "bucket_len", F.floor(F.col("place") / per_batch).cast("bigint").alias("batch"), (F.col("place") % per_batch).cast("int").alias("slot"), *padded)
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op2_packing": op2_packing}
ORACLES: dict[str, str] = {}
