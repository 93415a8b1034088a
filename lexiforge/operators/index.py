"""A kept inverted index: postings in blocks of documents with each block's greatest weight, refreshed by segments, searched
for whole tables of queries without the blocks that cannot reach a query's k-th score."""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexiforge.functions.lots import lots
from lexiforge.functions.text import tokenize_stem
from lexiforge.operators.corpus import catalog
from lexiforge.operators.search import K1, B, NOMINAL, idf, postings, top_per
from lexiforge.store import materialize, shared_dir

BLOCK_BITS = 9  # documents of a block: 512
_PART, _SEGMENT = 33, 52  # a row's number: its place in its partition, the partition, the segment
_BAND_DOCS = 1 << 21  # documents whose postings of one term may stand in one bucket

_POSTINGS = "term string, band int, block bigint, n int, top double, offsets array<int>, weights array<double>"
_GENERATION = "generation bigint, segments string, dead string, n bigint"


class Segment(NamedTuple):
    """What one build has written under `path`: documents, their terms and the bucketed postings."""

    path: str
    bands: int
    buckets: int

    def documents(self, spark: SparkSession) -> DataFrame:
        """Rows (row, key, hash, terms, weights)."""
        return spark.read.parquet(f"{self.path}/documents")

    def terms(self, spark: SparkSession) -> DataFrame:
        """Rows (term, df)."""
        return spark.read.parquet(f"{self.path}/terms")

    def postings(self, spark: SparkSession) -> DataFrame:
        """Rows (term, band, block, n, top, offsets, weights) as a table bucketed by term and band, named in this session's
        catalog if it is not there yet."""
        name = f"postings_{self.path.rpartition('-')[2]}"
        if not spark.catalog.tableExists(name):
            spark.sql(f"CREATE TABLE {name} ({_POSTINGS}) USING parquet CLUSTERED BY (term, band) SORTED BY (term, block) INTO {self.buckets} BUCKETS LOCATION '{self.path}/postings'")
        return spark.table(name)


class Index(NamedTuple):
    """A generation of an index: its segments, the table of rows that are no longer in it, and how many documents are."""

    folder: str
    generation: int
    segments: tuple[Segment, ...]
    dead: str | None
    n: int


def _live(spark: SparkSession, index: Index) -> DataFrame:
    """Rows (row, key, hash, terms, weights) of the documents of an index."""
    docs = _union([s.documents(spark) for s in index.segments])
    return docs.join(spark.read.parquet(index.dead).select("row"), "row", "left_anti") if index.dead else docs


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _counted(number: int, words: int = 1 << 17):
    """Rows (row, key, hash, terms, weights) of (key, hash, words); a task holds about `words` words as strings at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = (number << _SEGMENT) + (TaskContext.get().partitionId() << _PART)
        for batch in (lot for b in batches for lot in lots(b, words, 2)):
            terms, weights = [], []
            for said in batch.column(2).to_pylist():
                counts = sorted(Counter(said or ()).items())
                least = K1 * (1 - B + B * len(said or ()) / NOMINAL)
                terms.append([t for t, _ in counts])
                weights.append([c * (K1 + 1) / (c + least) for _, c in counts])
            at = pa.array(np.arange(row, row + batch.num_rows))
            yield pa.RecordBatch.from_arrays([at, batch.column(0), batch.column(1), pa.array(terms, pa.list_(pa.string())), pa.array(weights, pa.list_(pa.float64()))], ["row", "key", "hash", "terms", "weights"])
            row += batch.num_rows

    return run


def _write_segment(docs: DataFrame, folder: str, number: int, bands: int | None) -> tuple[Segment, int]:
    """docs: (key, hash, words). Two passes: the documents with their counted terms are written, and their postings are made
    of these. One exchange brings a block's postings of a term together, no group larger than a block."""
    spark = docs.sparkSession
    path = f"{folder}/segment-{uuid.uuid4().hex}"
    docs = docs.select("key", "hash", "words")

    kind = docs.schema["key"].dataType.simpleString()
    docs.mapInArrow(_counted(number), f"row bigint, key {kind}, hash string, terms array<string>, weights array<double>").write.parquet(f"{path}/documents")
    written = spark.read.parquet(f"{path}/documents")
    n = written.count()
    bands = bands or max(1, -(-n // _BAND_DOCS))
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    segment = Segment(path, bands, buckets)
    block = F.shiftright("row", BLOCK_BITS)
    rows = written.select("row", F.explode(F.arrays_zip("terms", "weights")).alias("t")).select(
        F.col("t.terms").alias("term"), F.pmod(F.hash(block), F.lit(bands)).alias("band"), block.alias("block"), F.col("row").bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int").alias("at"), F.col("t.weights").alias("weight")
    )
    grouped = rows.repartition(buckets, "term", "band").groupBy("term", "band", "block").agg(F.array_sort(F.collect_list(F.struct("at", "weight"))).alias("p"), F.max("weight").alias("top"))
    out = grouped.select("term", "band", "block", F.size("p").alias("n"), "top", F.col("p.at").alias("offsets"), F.col("p.weight").alias("weights"))
    out.write.bucketBy(buckets, "term", "band").sortBy("term", "block").option("path", f"{path}/postings").saveAsTable(f"postings_{path.rpartition('-')[2]}")
    segment.postings(spark).groupBy("term").agg(F.sum("n").alias("df")).write.parquet(f"{path}/terms")
    return segment, n


def _publish(spark: SparkSession, index: Index) -> Index:
    row = (index.generation, json.dumps([list(s) for s in index.segments]), index.dead, index.n)
    spark.createDataFrame([row], _GENERATION).coalesce(1).write.mode("append").parquet(f"{index.folder}/generations")
    return index


def open_index(spark: SparkSession, folder: str) -> Index | None:
    """The newest generation in a folder, of whichever session wrote it; None if there is none."""
    try:
        rows = spark.read.schema(_GENERATION).parquet(f"{folder}/generations").orderBy(F.desc("generation")).limit(1).collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return Index(folder, rows[0]["generation"], tuple(Segment(*s) for s in json.loads(rows[0]["segments"])), rows[0]["dead"], rows[0]["n"]) if rows else None


def _prepared(docs: DataFrame, key: str, texts: list[str], terms: Callable[[Column], Column], by_field: bool) -> DataFrame:
    """Rows (key, hash, words) of docs. by_field keeps the terms of each column apart, as `column:term`."""
    present = [F.nullif(F.col(t).cast("string"), F.lit("")) for t in texts]
    if by_field:
        words = F.concat(*[F.transform(F.coalesce(terms(p), F.array().cast("array<string>")), _named(t)) for p, t in zip(present, texts, strict=True)])
    else:
        words = terms(present[0] if len(present) == 1 else F.concat_ws(" | ", *present))
    told = F.to_json(F.array(*[F.coalesce(p, F.lit("")) for p in present]))
    return docs.select(F.col(key).alias("key"), F.sha2(told, 256).alias("hash"), words.alias("words"))


def _named(field: str) -> Callable[[Column], Column]:
    return lambda term: F.concat(F.lit(f"{field}:"), term)


def build_index(docs: DataFrame, folder: str, key: str, *texts: str, terms: Callable[[Column], Column] = tokenize_stem, by_field: bool = False, bands: int | None = None, spread: bool = True) -> Index:
    """Index documents anew: the terms of the columns `texts`, joined by " | " where there are several, or each column in a term
    space of its own (by_field). Keys should be unique; a document without terms counts in n and is never found. Blocks follow
    the order of docs; with spread, docs of fewer partitions than cores are dealt out first."""
    spark = docs.sparkSession
    old = open_index(spark, folder)
    if spread and docs.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:  # a few small files: their rows are dealt out over the cores
        docs = docs.select(key, *texts).repartition(spark.sparkContext.defaultParallelism)
    segment, n = _write_segment(_prepared(docs, key, list(texts), terms, by_field), folder, 0, bands)
    return _publish(spark, Index(folder, old.generation + 1 if old else 0, (segment,), None, n))


def refresh_index(index: Index, docs: DataFrame, key: str, *texts: str, terms: Callable[[Column], Column] = tokenize_stem, by_field: bool = False) -> tuple[Index, int, int]:
    """The next generation, with docs as they are now: (index, added, removed). By an anti join of (key, content hash) only
    what is new or changed is tokenised, into a segment of its own; what is gone or changed is listed as dead. Where
    nothing differs the index stays as it is. Readers of the old generation keep it."""
    spark = docs.sparkSession
    now = _prepared(docs, key, list(texts), terms, by_field)
    known = materialize(_live(spark, index).select("row", "key", "hash"), "indexed")
    changed = materialize(now.join(known.select("key", "hash"), ["key", "hash"], "left_anti"), "changed")
    gone = known.join(now.select("key", "hash"), ["key", "hash"], "left_anti").select("row")
    dead = f"{index.folder}/dead-{uuid.uuid4().hex}"
    gone.write.parquet(dead)
    removed, added = spark.read.parquet(dead).count(), changed.count()
    if not removed and not added:
        return index, 0, 0
    if index.dead:
        spark.read.parquet(index.dead).write.mode("append").parquet(dead)
    segments = index.segments
    if added:
        segments += (_write_segment(changed, index.folder, len(segments), None)[0],)
    return _publish(spark, Index(index.folder, index.generation + 1, segments, dead, index.n + added - removed)), added, removed


def search_index(
    index: Index, queries: DataFrame, k: int, query_key: str, query_text: str, key: str, *, terms: Callable[[Column], Column] = tokenize_stem, fields: tuple[str, ...] = (), probe: int = 2, group: int = 4096, stats: dict[str, int] | None = None
) -> DataFrame:
    """Rows (query_key, rank, key, score): the best k documents of each query by the sum over shared terms of query weight,
    document weight and idf; ties by key. Scores are rounded to 6 places before they are ranked; documents that share no
    term with a query are no result of it. No text of a document is read.

    The greatest weights of a block bound what any of its documents can score. The `probe` blocks of the highest bound are
    scored first; their k-th score is what a block must reach to be scored as well, so no result is lost. A block meets up
    to `group` queries at once as one sum over its postings, read once. Queries of equal terms are searched once. fields searches the term spaces of these columns
    with every word of a query. stats gets how many (query, block) pairs there were and how many were scored.
    """
    spark = queries.sparkSession
    asked = materialize(postings(queries, query_key, query_text, terms), "asked")
    bags = asked.groupBy(F.col(query_key).alias("as")).agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("term", "weight")))), 256).alias("bag"))
    bags = materialize(bags, "bags")
    alike = materialize(bags.groupBy("bag").agg(F.min("as").alias("q")), "alike")
    same = materialize(bags.join(alike, "bag").select("q", "as"), "same")
    asked = asked.join(alike.select(F.col("q").alias(query_key)), query_key, "left_semi")
    if fields:
        asked = asked.withColumn("term", F.explode(F.array(*[_named(f)(F.col("term")) for f in fields])))
    df = _union([s.terms(spark) for s in index.segments])
    if index.dead:
        gone = spark.read.parquet(index.dead)
        lost = _union([s.documents(spark) for s in index.segments]).join(gone, "row", "left_semi").select(F.explode("terms").alias("term")).groupBy("term").agg((-F.count("*")).alias("df"))
        df = df.unionByName(lost)
    df = df.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
    groups = max(1, -(-alike.count() // group))
    wanted = asked.join(df, "term").select(F.col(query_key).alias("q"), "term", (F.col("weight") * idf(F.lit(index.n), F.col("df"))).alias("w"), F.pmod(F.xxhash64(query_key), F.lit(groups)).cast("int").alias("g"))
    wanted = materialize(wanted, "wanted")

    per_segment = [(s, wanted.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(s.bands - 1)))) if s.bands > 1 else wanted.withColumn("band", F.lit(0))) for s in index.segments]
    bounds = _union([s.postings(spark).select("term", "band", "block", "top").join(w, ["term", "band"]).groupBy("q", "g", "block").agg(F.sum(F.col("w") * F.col("top")).alias("bound")) for s, w in per_segment])
    bounds = materialize(bounds, "bounds")
    placed = top_per(bounds, ["q"], [F.desc("bound"), F.asc("block")], probe, "place")
    first = materialize(_scored(index, placed.select("q", "g", "block"), wanted, k), "probed")
    least = top_per(first, ["q"], [F.desc("score")], k, "place").where(F.col("place") == k).select("q", F.col("score").alias("least"))
    rest = bounds.join(placed.select("q", "block"), ["q", "block"], "left_anti").join(least, "q", "left").where(F.col("least").isNull() | (F.col("bound") + 1e-6 >= F.col("least")))
    rest = materialize(rest.select("q", "g", "block"), "rest")
    if stats is not None:
        stats |= {"blocks": bounds.count(), "scored": rest.count() + placed.count()}
    found = first.unionByName(_scored(index, rest, wanted, k))
    near = found.withColumn("place", F.rank().over(W.partitionBy("q").orderBy(F.desc("score")))).where(F.col("place") <= k).drop("place")  # ties stay until keys are known
    named = near.join(_union([s.documents(spark).select("row", "key") for s in index.segments]), "row")
    best = top_per(named, ["q"], [F.desc("score"), F.asc("key")], k)
    return best.join(same, "q").select(F.col("as").alias(query_key), "rank", F.col("key").alias(key), "score")


def _scored(index: Index, pairs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """Rows (q, row, score) of the documents in the blocks of pairs (q, g, block): of each block those that reach the k-th score
    of a query in it."""
    spark = pairs.sparkSession
    blocks = pairs.select("g", "block").distinct()
    held = []
    for s in index.segments:
        mine = s.postings(spark).select("term", "band", "block", "offsets", "weights")
        use = wanted.select("term").distinct().join(F.broadcast(spark.range(s.bands).select(F.col("id").cast("int").alias("band"))), how="cross") if s.bands > 1 else wanted.select("term").distinct().withColumn("band", F.lit(0))
        held.append(mine.join(use, ["term", "band"], "left_semi").select("block", "term", "offsets", "weights"))
    if index.dead:
        at = F.col("row").bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")
        gone = spark.read.parquet(index.dead).groupBy(F.shiftright("row", BLOCK_BITS).alias("block")).agg(F.collect_list(at).alias("offsets"))
        held.append(gone.select("block", F.lit(None).cast("string").alias("term"), "offsets", F.transform("offsets", lambda _: F.lit(0.0)).alias("weights")))
    held = _union(held).join(blocks, "block").select("g", "block", "term", "offsets", "weights")
    needs = pairs.join(wanted.select("q", "term", "w"), "q").select(F.col("g").alias("of_g"), F.col("block").alias("of_block"), "q", "term", "w")
    kind, bits = wanted.schema["q"].dataType, BLOCK_BITS

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        return _score_block(left, right, k, bits)

    return held.groupBy("g", "block").cogroup(needs.groupBy("of_g", "of_block")).applyInArrow(score, StructType().add("q", kind).add("row", "long").add("score", "double"))


def _score_block(held: pa.Table, needs: pa.Table, k: int, bits: int, entries: int = 1 << 19) -> pa.Table:
    """The documents of one block that reach the k-th score of a query, ties included; queries are taken in runs of about
    `entries` postings."""
    kind = needs.schema.field("q").type
    if not held.num_rows or not needs.num_rows:
        return pa.table({"q": pa.array([], kind), "row": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    held, size = held.combine_chunks(), 1 << bits
    lists = [held.column(c).combine_chunks() for c in ("offsets", "weights")]
    starts = lists[0].offsets.to_numpy() - lists[0].offsets[0].as_py()
    offsets, weights = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)
    place = {t: i for i, t in enumerate(held.column("term").to_pylist())}
    needs = needs.sort_by([("q", "ascending"), ("term", "ascending")])
    of_term = np.array([place.get(t, -1) for t in needs.column("term").to_pylist()])
    names = needs.column("q").combine_chunks().dictionary_encode()
    q, ids = names.indices.to_numpy(), names.dictionary
    w = needs.column("w").to_numpy()
    known = of_term >= 0
    q, w, of_term = q[known], w[known], of_term[known]
    many = starts[of_term + 1] - starts[of_term]
    dead = offsets[starts[place[None]] : starts[place[None] + 1]] if None in place else None
    base, got = held.column("block")[0].as_py() << bits, []
    upto, lo = np.cumsum(many), 0
    while lo < len(q):
        hi = int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + entries, side="right"))
        hi = max(hi, lo + 1)
        hi = len(q) if hi >= len(q) else int(np.searchsorted(q, q[hi], side="left"))  # whole queries
        if hi <= lo:
            hi = int(np.searchsorted(q, q[lo], side="right"))
        n, first = many[lo:hi], int(q[lo])
        at = np.arange(n.sum()) + np.repeat(starts[of_term[lo:hi]] - (np.cumsum(n) - n), n)
        rows = int(q[hi - 1]) - first + 1
        scores = np.bincount(np.repeat((q[lo:hi] - first) * size, n) + offsets[at], weights=np.repeat(w[lo:hi], n) * weights[at], minlength=rows * size).reshape(rows, size).round(6)
        if dead is not None:
            scores[:, dead] = 0
        least = -np.partition(-scores, min(k, size) - 1, axis=1)[:, min(k, size) - 1 : min(k, size)]
        r, c = np.nonzero((scores >= least) & (scores > 0))
        got.append((r + first, c, scores[r, c]))
        lo = hi
    r, c, s = (np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0),)
    return pa.table({"q": ids.take(pa.array(r)), "row": pa.array(base + c.astype(np.int64)), "score": pa.array(s)})


def bm25_topk(
    queries: DataFrame, docs: DataFrame, k: int, query_key: str, query_text: str, key: str, text: str, terms: Callable[[Column], Column] = tokenize_stem, *, block: int = 4096
) -> DataFrame:
    """search_index on an index of docs that is written for this call; keep one with build_index where there are more. block is
    how many queries meet a block of documents at once."""
    index = build_index(docs, f"{shared_dir(docs.sparkSession)}/indexes/{uuid.uuid4().hex}", key, text, terms=terms)
    return search_index(index, queries, k, query_key, query_text, key, terms=terms, group=block)


def build_catalog(evidence: DataFrame, folder: str, key: str, order: str, *fields: str) -> tuple[DataFrame, Index]:
    """The catalog of evidence rows, one row a document (corpus.catalog), and its index in `folder`: built the first time, after
    that only documents whose catalog text is new, changed or gone are touched."""
    rows = materialize(catalog(evidence, key, order, *fields), "catalog")
    index = open_index(rows.sparkSession, folder)
    if index is None:
        return rows, build_index(rows, folder, key, "catalog_text")
    return rows, refresh_index(index, rows, key, "catalog_text")[0]


def catalog_ranks(index: Index, queries: DataFrame, query_key: str, query_text: str, document: str, k: int = 10) -> DataFrame:
    """Rows (query_key, rank, document): the best k documents of each query, as hybrid_search takes them for its bonus."""
    return search_index(index, queries, k, query_key, query_text, document).select(query_key, "rank", document)
