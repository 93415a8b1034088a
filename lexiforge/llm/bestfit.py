"""Best-fit packing: bulk-synchronous rounds over range-sorted documents and gaps; conflicts are resolved by rank."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm.common import table
from lexiforge.llm.tokenfile import _encoder
from lexiforge.store import materialize

_PLACE_BITS = 33  # monotonically_increasing_id: the partition stands above, the place in it below


class Intervals(NamedTuple):
    """What a sweep decided, by places in the order of the gaps (the new sequences stand after them): the bins from place
    `start` on take documents of `size`, `take` each and `docs` together, from rank `first` of that size on."""

    start: np.ndarray
    stop: np.ndarray
    size: np.ndarray
    first: np.ndarray
    take: np.ndarray
    docs: np.ndarray


def sweep(docs: np.ndarray, gaps: np.ndarray, taken: np.ndarray, max_len: int) -> tuple[Intervals, np.ndarray, int]:
    """One successor sweep over size classes: docs[s] documents of s tokens wait, gaps[g] sequences have g places free.

    From the largest size down, the documents of a size take the smallest gaps that hold them and that no larger size has
    taken in this sweep; a gap takes as many documents of the size as it holds. Where no gap is left, documents for which
    the changed gaps have no room either, however they are dealt out, open new sequences; the others wait for the next
    round. taken[s] is the rank of the first waiting document. Returns the intervals, the documents still waiting and the
    number of new sequences. All is counted by size, so the sweep takes max_len steps whatever the number of rows.
    """
    sizes = np.arange(max_len + 1)
    place = np.concatenate([[0], np.cumsum(gaps)])  # of the first gap of each size
    old, opened, waiting_larger = int(place[-1]), 0, 0
    free: list[list[int]] = []  # size, gaps left, of the sizes seen; the smallest is on top
    changed, left, rows = np.zeros(max_len + 1, dtype=np.int64), docs.copy(), []

    def give(gap: int, start: int, size: int, docs_here: int, first: int) -> int:
        take = gap // size
        bins = -(-docs_here // take)
        rows.append((start, start + bins, size, first, take, docs_here))
        changed[gap - take * size] += docs_here // take
        if docs_here % take:
            changed[gap - docs_here % take * size] += 1
        return bins

    for size in range(max_len - 1, 0, -1):
        if gaps[size]:
            free.append([size, int(gaps[size])])
        n, rank = int(docs[size]), int(taken[size])
        while n and free:
            gap, many = free[-1]
            here = min(n, many * (gap // size))
            bins = give(gap, int(place[gap] + gaps[gap]) - many, size, here, rank)
            free[-1][1] -= bins
            n, rank = n - here, rank + here
            if not free[-1][1]:
                free.pop()
        if n:
            room = int((changed[size:] * (sizes[size:] // size)).sum()) - waiting_larger
            extra = n - max(0, room)
            if extra > 0:
                take = max_len // size
                extra = min(n, -(-extra // take) * take)
                opened += give(max_len, old + opened, size, extra, rank)
                n -= extra
        waiting_larger += n
        left[size] = n
    rows.sort()
    return Intervals(*np.array(rows, dtype=np.int64).reshape(-1, 6).T), left, opened


def _ordered(df: DataFrame, size: str, key: str, name: str, max_len: int) -> tuple[DataFrame, np.ndarray]:
    """df range-sorted by (size, key) with the column place, from 0 in the order of the whole table, and the rows of each
    size. The partitions' counts by size, one row a partition and size at most more, are all that reaches the driver."""
    dealt = df.repartitionByRange(size, key).sortWithinPartitions(size, key).withColumn("at", F.monotonically_increasing_id())
    dealt = materialize(dealt.withColumn("part", F.shiftright("at", _PLACE_BITS).cast("int")), name)
    counts = dealt.groupBy("part", size).count().collect()
    parts, sizes = {}, np.zeros(max_len + 1, dtype=np.int64)
    for r in counts:
        parts[r["part"]] = parts.get(r["part"], 0) + r["count"]
        sizes[r[size]] += r["count"]
    before, total = [], 0
    for p in sorted(parts):
        before.append((p, total))
        total += parts[p]
    starts = df.sparkSession.createDataFrame(before, "part int, before bigint")
    place = (F.col("at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)) + F.col("before")).alias("place")
    return dealt.join(F.broadcast(starts), "part").select(*df.columns, place), sizes


def _matched(bins: DataFrame, found: Intervals, max_len: int) -> DataFrame:
    """Bins (bin, gap, place) after a sweep: each partition of the range-sorted bins looks its places up in the intervals.
    Rows (bin, gap, size, first, n, offset): n documents of `size`, from rank `first` on, stand from `offset` on; no size
    where the bin got none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bin_, gap, place = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            at = np.searchsorted(found.start, place, side="right") - 1
            hit = (at >= 0) & (place < found.stop[at]) if len(found.start) else np.zeros(len(place), dtype=bool)
            at = np.where(hit, at, 0)
            if len(found.start):
                k = place - found.start[at]
                n = np.minimum(found.take[at], found.docs[at] - k * found.take[at])
                size, first = found.size[at], found.first[at] + k * found.take[at]
            else:
                n = size = first = np.zeros(len(place), dtype=np.int64)
            cut = lambda x, kind: pa.array(x, kind, mask=~hit)
            yield pa.RecordBatch.from_arrays(
                [pa.array(bin_), pa.array(np.where(hit, gap - n * size, gap), pa.int32()), cut(size, pa.int32()), cut(first, pa.int64()), cut(n, pa.int32()), cut(max_len - gap, pa.int32())],
                ["bin", "gap", "size", "first", "n", "offset"],
            )

    return bins.select("bin", "gap", "place").mapInArrow(run, "bin bigint, gap int, size int, first bigint, n int, offset int")


def best_fit(lengths: DataFrame, max_len: int = 1024, *, row: str = "row", length: str = "length") -> DataFrame:
    """Places for rows of 1 to max_len - 1 tokens in as few sequences of max_len as best fit finds: (row, sequence_id, offset).

    Rows are range-sorted by length once and get a rank among those of their length; rows of one length are alike, so one
    hot length is spread over its partitions by `row`, which must be unique. Every round range-sorts the open gaps, sweeps
    the counts by size, gives each gap its documents by rank (no two gaps can want one document, no two documents one
    place), writes the changed gaps and goes on with those that still hold the shortest waiting document. A round needs no
    document row at all; these meet their sequences in one equijoin on (length, rank) in the end. On token lengths of
    prose five rounds do, and the number of sequences is that of sequential best fit decreasing (tests).
    """
    spark = lengths.sparkSession
    ranked, docs = _ordered(lengths.select(F.col(row).alias("row"), F.col(length).cast("int").alias("size")), "size", "row", "lengths", max_len)
    if docs[0] or docs[max_len]:
        raise ValueError(f"lengths must be between 1 and {max_len - 1}")
    first_of = np.concatenate([[0], np.cumsum(docs)[:-1]])
    taken, rounds, bins, n_bins = np.zeros_like(docs), [], None, 0
    while docs.any():
        gaps = np.zeros_like(docs)
        if bins is not None:
            bins, gaps = _ordered(bins, "gap", "bin", "gaps", max_len)
        found, left, opened = sweep(docs, gaps, taken, max_len)
        new = spark.range(n_bins, n_bins + opened).select(F.col("id").alias("bin"), F.lit(max_len).alias("gap"), (F.col("id") + F.lit(int(gaps.sum()) - n_bins)).alias("place"))
        n_bins += opened
        after = materialize(_matched(new if bins is None else bins.unionByName(new), found, max_len), "round")
        rounds.append(after.where("size is not null"))
        taken, docs = taken + docs - left, left
        bins = after.where(F.col("gap") >= int(np.flatnonzero(docs)[0])).select("bin", "gap") if docs.any() else None
    if not rounds:
        return spark.createDataFrame([], "row bigint, sequence_id bigint, offset bigint")
    given = rounds[0]
    for r in rounds[1:]:
        given = given.unionByName(r)
    given = given.select("size", F.col("bin").alias("sequence_id"), "first", "offset", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    given = given.select("size", (F.col("first") + F.col("k")).alias("rank"), "sequence_id", (F.col("offset") + F.col("k") * F.col("size")).cast("bigint").alias("offset"))
    starts = spark.createDataFrame(list(enumerate(first_of.tolist())), "size int, first_of bigint")
    ranked = ranked.join(F.broadcast(starts), "size").select("row", "size", (F.col("place") - F.col("first_of")).alias("rank"))
    return ranked.join(given, ["size", "rank"]).select("row", "sequence_id", "offset")


def pieces(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", *, max_len: int = 1024, end_id: int = 2, kind: str = "uint16") -> DataFrame:
    """The token ids of every text, end id last, cut where they are longer than max_len: (row, doc_id, piece, start, length, ids).

    All pieces but the first have max_len ids. row numbers the pieces of the table as it is written; ids are little-endian
    numbers of the width of `kind`. Null texts are empty: their end id alone. Rows that repeat are all kept."""
    kind_of_id = docs.schema[doc_id].dataType.simpleString()
    width, end = np.dtype(kind).itemsize, np.array([end_id], dtype=kind).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, row = _encoder(tokenizer, kind), TaskContext.get().partitionId() << _PLACE_BITS
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                of, piece, start, ids = [], [], [], []
                for i, got in enumerate(encoder.encode([t or "" for t in part.column(1).to_pylist()])):
                    got += end
                    n = len(got) // width
                    cuts = [0, *range(n % max_len or max_len, n, max_len), n]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        of.append(i)
                        piece.append(k)
                        start.append(a)
                        ids.append(got[a * width : b * width])
                m = len(of)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + m)), part.column(0).take(pa.array(of)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array([len(x) // width for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    ["row", "doc_id", "piece", "start", "length", "ids"],
                )
                row += m

    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return materialize(base.mapInArrow(run, f"row bigint, doc_id {kind_of_id}, piece int, start bigint, length bigint, ids binary"), "pieces")


def pack(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", *, max_len: int = 1024, end_id: int = 2, kind: str = "uint16") -> DataFrame:
    """All docs packed into sequences of at most max_len tokens: (doc_id, piece, start, length, ids, sequence_id, offset).

    A piece of max_len ids is a sequence by itself and moves nowhere; shorter ones are placed by best_fit and only they are
    shuffled with their ids. A sequence's ids are those of its pieces in the order of offset, without a gap from 0 on. Of
    sequence ids, those of whole pieces are negative. An empty table gives no row; null ids and repeated rows are kept.
    """
    cut = pieces(docs, tokenizer, text, doc_id, max_len=max_len, end_id=end_id, kind=kind)
    out = ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]
    whole = cut.where(F.col("length") == max_len).select("*", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")).select(*out)
    short = cut.where(F.col("length") < max_len)
    return whole.unionByName(short.join(best_fit(short.select("row", "length"), max_len), "row").select(*out))


def ids_crc32(ids: str, kind: str = "uint16"):
    """CRC-32 of ids as little-endian unsigned 32-bit integers."""

    @F.pandas_udf("bigint")
    def crc(values: pd.Series) -> pd.Series:
        return pd.Series([crc32(np.frombuffer(b, dtype=kind).astype("<u4").tobytes()) for b in values], dtype="int64")

    return crc(ids)


def op13_best_fit(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    packed = pack(table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", ids_crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


QUERIES = {"op13_best_fit": op13_best_fit}
ORACLES: dict[str, str] = {}
