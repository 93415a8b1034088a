"""SimHash near-dedup: fingerprints of word shingles, shard BK-trees, components of linked fingerprints."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.functions.lots import LOT, lots
from lexiforge.llm.common import distinct, free_name, plus, split_by, table
from lexiforge.operators.components import connected_components
from lexiforge.store import discard, materialize

SEED = 42
_BLOCK = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


# ---------------------------------------------------------------- fingerprints


def _word_blocks(text: bytes, size: int = _BLOCK) -> Iterator[list[bytes]]:
    """The words of a text in bounded runs; every run ends at a word's end."""
    at = 0
    while at < len(text):
        end = len(text) if at + size >= len(text) else at + size
        if end < len(text):
            cut = _SPACE.search(text, end)
            end = cut.start() if cut else len(text)
        yield text[at:end].split()  # bytes.split() cuts at 0x20 and 0x09-0x0D alone
        at = end


def _hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 of every shingle of width words, as rows of 8 big-endian bytes."""
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    stop = np.cumsum(size + 1) - 1
    start = (stop - size)[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_digest
    h = b"".join([digest(joined[a:b], SEED) for a, b in zip(start, stop[width - 1 :].tolist(), strict=True)])
    return np.frombuffer(h, dtype=np.uint8).reshape(-1, 8)


def shingle_hashes(text: bytes | None, width: int) -> Iterator[np.ndarray]:
    """The hashes of a text's shingles, repeats included, in runs of about 1 MB of text; of the whole word sequence if it is
    shorter than width; nothing for a null text or one without words. A-Z are lower-cased first."""
    tail, found = [], False
    for words in _word_blocks((text or b"").lower()):
        tail += words
        if len(tail) >= width:
            found = True
            yield _hashes(tail, width)
            tail = tail[-(width - 1) :] if width > 1 else []
    if tail and not found:
        yield _hashes([b" ".join(tail)], 1)


def _bits(runs: list[np.ndarray]) -> int:
    ones, n = np.zeros(64, dtype=np.int64), 0
    for run in runs:
        n += len(run)
        for lo in range(0, len(run), 8192):
            ones += np.unpackbits(run[lo : lo + 8192], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big") if n else 0


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """64-bit SimHash as an unsigned integer.

    A-Z are lower-cased, words are runs of bytes other than 0x20 and 0x09-0x0D, shingles are width words joined by a space
    with repeats counted, each hashed by XXH64 with seed 42. A text of fewer words is one shingle; one without words, or a
    null text, has fingerprint 0. A bit is set if it is set in more than half of the shingles.
    """
    return _bits(list(shingle_hashes(text, width)))


def minima(h: np.ndarray, functions: int) -> np.ndarray:
    """The least value of a set of 64-bit hashes under each of several hash functions; all ones for an empty set."""
    turn = np.random.default_rng(64).integers(0, 1 << 32, functions, dtype=np.uint32)
    least = np.full(functions, 0xFFFFFFFF, dtype=np.uint32)
    if len(h):
        x, step = (h >> np.uint64(32)).astype(np.uint32), h.astype(np.uint32)
        for k in range(functions):  # a sum of two hashes and a constant
            least[k] = (x + turn[k]).min()
            x += step
    return least


def with_fingerprint(docs: DataFrame, text: str = "text", *, name: str = "fp", width: int = 3) -> DataFrame:
    """Every row and column of docs but the text, with its fingerprint as a signed 64-bit integer."""
    kept = [c for c in docs.columns if c != text]
    df = docs.select(F.col(text).cast("binary").alias(free_name(docs, "raw")), *kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.array([fingerprint(t, width) for t in b.column(0).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(prints)], [*b.schema.names[1:], name])

    return df.mapInArrow(run, plus(docs.select(*kept), {name: "bigint"}))


# ---------------------------------------------------------------- BK-trees


class BKTree:
    """A BK-tree over 64-bit fingerprints: a node's children are keyed by their integer Hamming distance to it.

    Building and searching move all items down level by level with numpy, so each step is one vector operation.
    """

    def __init__(self, prints: np.ndarray):
        self.prints = distinct(np.asarray(prints, dtype=np.uint64))
        n = len(self.prints)
        self.child = np.full((n, 65), -1, dtype=np.int32)
        item, node = np.arange(1, n, dtype=np.int32), np.zeros(max(n - 1, 0), dtype=np.int32)
        while item.size:
            d = np.bitwise_count(self.prints[item] ^ self.prints[node]).astype(np.int64)
            free = self.child[node, d] < 0
            slot = node.astype(np.int64) * 65 + d
            _, first = np.unique(slot[free], return_index=True)  # the lowest item takes a free edge, the others follow it
            new = np.flatnonzero(free)[first]
            self.child[node[new], d[new]] = item[new]
            node = self.child[node, d]
            stay = node != item
            item, node = item[stay], node[stay]

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Index pairs (query, node) at radius bits or fewer; from a node at distance d only edges d - radius to d + radius are followed."""
        found_q, found_n = [], []
        q = np.arange(len(queries), dtype=np.int32) if len(self.prints) else np.zeros(0, dtype=np.int32)
        node = np.zeros(len(q), dtype=np.int32)
        while q.size:
            d = np.bitwise_count(queries[q] ^ self.prints[node]).astype(np.int64)
            hit = d <= radius
            found_q.append(q[hit])
            found_n.append(node[hit])
            next_q, next_n = [], []
            for step in range(-radius, radius + 1):
                edge = d + step
                ok = (edge >= 0) & (edge <= 64)
                down = self.child[node[ok], edge[ok]]
                there = down >= 0
                next_q.append(q[ok][there])
                next_n.append(down[there])
            q, node = np.concatenate(next_q), np.concatenate(next_n)
        none = np.zeros(0, dtype=np.int32)
        return (np.concatenate(found_q), np.concatenate(found_n)) if found_q else (none, none)


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs: at most one edge for each value, each to the root that it hangs on."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y] if y in up else y
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    return [(x, root(x)) for x in up if root(x) != x]


def _link(radius: int, block: int = 512):
    """For each row (tree, queries): the links found in the shard's tree, contracted to a spanning forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int]] = []
            for shard, asked in zip(batch.column(0), batch.column(1), strict=True):
                tree = BKTree(shard.values.to_numpy().view(np.uint64))
                asked = asked.values.to_numpy().view(np.uint64)
                for lo in range(0, len(asked), block):
                    q, n = tree.within(asked[lo : lo + block], radius)
                    out += _forest(asked[lo : lo + block][q].view(np.int64), tree.prints[n].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])

    return run


def _shards(fp: Column, radius: int) -> Column:
    """The shards that a fingerprint belongs to.

    The 64 bits are cut into radius + 2 pieces. Two fingerprints within the radius agree in at least two pieces, so they
    meet in the shard named by those two pieces and their values, and a search needs no other shard.
    """
    pieces = radius + 2
    cuts = [64 * i // pieces for i in range(pieces + 1)]
    value = [F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    width = max(hi - lo for lo, hi in zip(cuts, cuts[1:], strict=False))
    return F.array(
        *[
            F.struct(F.lit(k).cast("int").alias("pair"), F.shiftleft(value[i], width).bitwiseOR(value[j]).alias("at"))
            for k, (i, j) in enumerate(combinations(range(pieces), 2))
        ]
    )


def linked(prints: DataFrame, radius: int = 2, *, tree_size: int = 2048) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp, unique): their components are those of all pairs within the radius.

    Every shard becomes BK-trees of about tree_size fingerprints; a shard with more is cut by hash into several, and each of
    its trees is sent to each of its query blocks, so neither a tree nor a block grows with the input. No pair within the
    radius is lost; only pairs that are already connected inside one search are not repeated.
    """
    rows = prints.select("fp", F.explode(_shards(F.col("fp"), radius)).alias("s")).select("fp", "s.pair", "s.at")
    full = materialize(rows.groupBy("pair", "at").agg(F.count("*").alias("n")).where("n > 1"), "shards")
    cut = F.ceil(F.col("n") / tree_size).cast("int")
    members = rows.join(full, ["pair", "at"]).withColumn("cuts", cut).withColumn("part", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("cuts")).cast("int"))
    trees = materialize(members.groupBy("pair", "at", "part").agg(F.collect_list("fp").alias("fps"), F.first("cuts").alias("cuts")), "trees")
    alone = trees.select(F.col("fps").alias("tree"), F.col("fps").alias("asked"))
    many = trees.where("cuts > 1")
    other = many.select("pair", "at", F.col("part").alias("to"), F.col("fps").alias("asked"))
    across = many.join(other, ["pair", "at"]).where("part < to").select(F.col("fps").alias("tree"), "asked")
    return alone.unionByName(across).mapInArrow(_link(radius), "a bigint, b bigint").distinct()


def components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", *, radius: int = 2, width: int = 3) -> DataFrame:
    """One row for each row of docs: doc_id, fp (signed integer) and component_id.

    component_id is the smallest doc_id reachable over links of radius bits or fewer, its own included; null only if every
    id of the component is null. Equal fingerprints are one node, so copies cost one row each. Texts that are null, empty
    or without words have fingerprint 0 and link like any other. Repeated rows come back as often as they stand in docs.
    An empty table gives an empty result; other columns of docs are not read.
    """
    fps = materialize(with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), width=width), "fingerprints")
    first = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    links = materialize(linked(first.select("fp"), radius), "links")
    return _grouped(fps, first, links)


def _grouped(fps: DataFrame, first: DataFrame, links: DataFrame) -> DataFrame:
    """component_id of every row (doc_id, fp), from the links between fingerprints and the smallest id of each of them."""
    groups = connected_components(links)
    named = first.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = materialize(named.groupBy("component").agg(F.min("first").alias("component_id")), "least")
    known = materialize(named.select("fp", "component").join(least, "component").select("fp", "component_id"), "named")
    return fps.join(known, "fp").select("doc_id", "fp", "component_id")


def _sketched(docs: DataFrame, width: int, shards: int) -> DataFrame:
    """Of rows (text, doc_id): doc_id, h (a hash of the text), node, fp, the shards' names and the shingles, all of the set of
    distinct shingles: node is its hash, fp its SimHash, a name two of its minima, shingles 32 bits of each member's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (lot for batch in batches for lot in lots(batch, LOT, 0)):
            node, prints, names, members = [], [], [], []
            for text in b.column(0).to_pylist():
                h = [np.frombuffer(r.tobytes(), dtype=">u8").astype(np.uint64) for r in shingle_hashes(text, width)]
                h = distinct(np.concatenate([np.zeros(0, dtype=np.uint64), *h]))
                node.append(xxhash.xxh64_intdigest(h.tobytes(), SEED))
                prints.append(_bits([h.astype(">u8").view(np.uint8).reshape(-1, 8)]))
                least = minima(h, 2 * shards).astype(np.int64)
                names.append((least[0::2] << 31 ^ least[1::2]).tolist())
                members.append(distinct(h.astype(np.uint32)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(1), b.column(2), *(pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (node, prints)),
                    pa.array(names, pa.list_(pa.int64())), pa.array(members, pa.binary()),
                ],
                ["doc_id", "h", "node", "fp", "names", "shingles"],
            )

    rows = docs.select(F.col("text").cast("binary").alias("text"), "doc_id", F.xxhash64("text", F.col("text").isNull()).alias("h"))
    return rows.mapInArrow(run, plus(rows.select("doc_id"), {"h": "bigint", "node": "bigint", "fp": "bigint", "names": "array<bigint>", "shingles": "binary"}))


def _common_members(sets: list[np.ndarray], q: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How many members sets[q[i]] and sets[n[i]] share, for all i together: one sorted list of (i, member) for each side."""

    def numbered(which: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0, dtype=np.uint64), *(np.uint64(i << 32) | sets[k].astype(np.uint64) for i, k in enumerate(which.tolist()))])

    both = np.sort(np.concatenate([numbered(q), numbered(n)]), kind="stable")
    return np.bincount((both[1:][both[1:] == both[:-1]] >> np.uint64(32)).astype(np.int64), minlength=len(q))


def _joined(sets: list[np.ndarray], q: np.ndarray, n: np.ndarray, least: float, run: int = 1024) -> list[tuple[int, int]]:
    """A spanning forest of those pairs (q, n) whose sets have a Jaccard similarity of least or more.

    Pairs are verified in rounds, in each the first open pair of every tree of the forest so far; what has come together is
    open no more, so a group of m copies costs about m comparisons, and only pairs that stay apart are all compared.
    """
    size = np.array([len(s) for s in sets], dtype=np.int64)
    up = np.arange(len(sets))
    short, long_ = np.minimum(size[q], size[n]), np.maximum(size[q], size[n])
    may = (short >= least * long_) & (q != n)
    q, n, links = q[may], n[may], []
    while len(q):
        while (up != (top := up[up])).any():
            up = top
        apart = up[q] != up[n]
        q, n = q[apart], n[apart]
        _, first = np.unique(up[q], return_index=True)
        for lo in range(0, len(first), run):
            i = first[lo : lo + run]
            both = _common_members(sets, q[i], n[i])
            like = i[both >= least * (size[q[i]] + size[n[i]] - both)]
            for a, b in zip(q[like].tolist(), n[like].tolist(), strict=True):
                links.append((a, b))
                a, b = _root(up, a), _root(up, b)
                up[max(a, b)] = min(a, b)
        open_ = np.ones(len(q), dtype=bool)
        open_[first] = False
        q, n = q[open_], n[open_]
    return links


def _root(up: np.ndarray, x: int) -> int:
    while up[x] != x:
        x = int(up[x])
    return x


def _link_like(radius: int, least: float, block: int = 256):
    """For each row of two blocks of (node, fp, shingles): links between nodes whose fingerprints the BK-tree of the first
    block finds within the radius and whose sets are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: set[tuple[int, int]] = set()
            for i in range(batch.num_rows):
                one, two = (batch.column(k)[i].as_py() for k in (0, 1))
                members = one + (two or [])
                sets = [np.frombuffer(m["shingles"], dtype=np.uint32) for m in members]
                fps = np.array([m["fp"] for m in members], dtype=np.int64).view(np.uint64)
                tree = BKTree(fps[: len(one)])
                # a node of the tree is a fingerprint: members with an equal one are all met there
                order = np.argsort(fps[: len(one)], kind="stable")
                lo_of, hi_of = (np.searchsorted(fps[: len(one)][order], tree.prints, side) for side in ("left", "right"))
                start = len(one) if two else 0
                for lo in range(start, len(members), block):
                    hits, node = tree.within(fps[lo : min(lo + block, len(members))], radius)
                    many = (hi_of - lo_of)[node]
                    q = np.repeat(lo + hits, many)
                    at = np.repeat(lo_of[node] - np.concatenate([[0], np.cumsum(many)[:-1]]) if len(many) else np.zeros(0, dtype=np.int64), many) + np.arange(int(many.sum()))
                    out.update((members[a]["node"], members[b]["node"]) for a, b in _joined(sets, q, order[at], least))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])

    return run


def _met(rows: DataFrame, data: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The members (shard, at, node, n) of the shards that bring nodes together, and (node, fp, shingles) of these nodes, both
    written; rows has (node, names), null for a shard that it is not in, data what a node's rows in it hold. Of data only what
    may be needed is moved: a filter of a bounded size leaves out most of the other nodes where they stand."""
    named = rows.select("node", F.posexplode("names").alias("shard", "at")).where("at is not null").distinct()
    full = named.groupBy("shard", "at").agg(F.count("*").alias("n")).where("n > 1")
    members = materialize(named.join(full, ["shard", "at"]), "shard-members")
    needed = materialize(members.select("node").distinct(), "shard-nodes")
    held, _ = split_by(needed)(data.select("node", "fp", "shingles"), "node")
    held = held.join(needed, "node", "left_semi").dropDuplicates(["node"])
    held = materialize(held, "shard-data")
    discard(needed)
    return members, held


def _near(members: DataFrame, held: DataFrame, least: float, radius: int, tree_size: int) -> DataFrame:
    """Components (node, component) over links of a similarity of least or more. Nodes that no shard brings together are not in
    it. The two tables (see _met) go when they have been read."""
    placed = members.withColumn("cuts", F.ceil(F.col("n") / tree_size).cast("int")).withColumn("part", F.pmod(F.xxhash64("node", F.lit(7)), F.col("cuts")).cast("int"))
    full_rows = placed.join(held, "node")
    trees = materialize(full_rows.groupBy("shard", "at", "part").agg(F.sort_array(F.collect_list(F.struct("node", "fp", "shingles"))).alias("m"), F.first("cuts").alias("cuts")), "trees")
    discard(full_rows)
    alone = trees.select(F.col("m").alias("t"), F.lit(None).cast(trees.schema["m"].dataType).alias("q"))
    many = trees.where("cuts > 1")
    across = many.join(many.select("shard", "at", F.col("part").alias("to"), F.col("m").alias("q")), ["shard", "at"]).where("part < to").select(F.col("m").alias("t"), "q")
    links = materialize(alone.unionByName(across).mapInArrow(_link_like(radius, least), "a bigint, b bigint").distinct(), "links")
    discard(trees)
    return connected_components(links)


def near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", *, width: int = 5, least: float = 0.8, radius: int = 20, shards: int = 8, tree_size: int = 512) -> DataFrame:
    """Rows (doc_id, fp, component_id): groups of texts whose sets of width-word shingles have a Jaccard similarity of least.

    At that similarity SimHashes of the distinct shingles differ in about 10 bits of 64, too many to be found by bits alone.
    So a shard is named by two of the text's least shingles under independent hash functions: two texts of similarity s miss
    each other in all shards with probability (1 - s * s) ** shards, 0.0003 at 0.8. In a shard the BK-tree finds the
    fingerprints within the radius (at 0.8 all but 2 in 10,000 are), and each pair found is verified by its sets, exactly but
    for equal 32-bit hashes. Texts of equal sets are one node. A shard over tree_size nodes is cut by hash into trees, each
    of which meets every other. component_id is the smallest doc_id of the group, null if all its ids are null. Texts
    without words are alike. Repeated rows come back as often as they stand in docs; an empty table gives an empty result.
    """
    rows = materialize(_sketched(docs.select(F.col(text).alias("text"), F.col(doc_id).alias("doc_id")), width, shards), "sketches")
    groups = _near(*_met(rows, rows), least, radius, tree_size)
    named = rows.select("doc_id", "fp", "node").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = materialize(named.groupBy("component").agg(F.min("doc_id").alias("component_id")), "least")
    return named.join(first, "component").select("doc_id", "fp", "component_id")


def keep_one(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", *, whole: DataFrame | None = None, width: int = 5, least: float = 0.8, radius: int = 20, shards: int = 8, tree_size: int = 512
) -> DataFrame:
    """The pipeline's filter: one document of each group of near copies (see near_copies), with the columns of docs.

    A document is a pair of id and text. The one that stays has the group's smallest id, rows without an id last, and of
    several texts with that id the smallest hash; of rows that repeat it one stays. whole may give the documents as they once
    were, with the same columns: then a row whose id stands there once is compared by that text and by what a former stage has
    left of it; two rows are near copies if their whole texts are, or what is left of them.
    """
    key, hash_ = free_name(docs, "near_id"), free_name(docs, "near_hash")
    keyed = docs.withColumn(hash_, F.xxhash64(F.col(text), F.col(text).isNull())).withColumn(key, _name(F.col(doc_id), F.col(hash_)))
    texts = keyed.select(F.col(text).alias("text"), F.col(doc_id).alias("doc_id"), F.col(key).alias("name"))
    if whole is None:
        rows = data = materialize(_sketched(texts.drop("name"), width, shards), "sketches")
        rows = rows.withColumn("own", F.lit(True))
    else:
        data = materialize(_sketched(whole.select(F.col(text).alias("text"), F.col(doc_id).alias("doc_id")), width, shards), "sketches")
        once = data.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("h").alias("was"), F.min("node").alias("node"), F.min("names").alias("names")).where("n = 1 and doc_id is not null").drop("n")
        once = materialize(once, "whole")
        mine = keyed.select(F.col(key).alias("name"), F.col(doc_id).alias("doc_id"), F.col(hash_).alias("h"))
        rows = materialize(mine.join(once, "doc_id", "left"), "sketches")
        discard(once)
        changed = materialize(rows.where("was is null or was <> h").select("name").distinct(), "changed")
        # all rows whose text is not the one in whole, and a few others, which only come twice
        own = sketches = materialize(_sketched(split_by(changed)(texts, "name")[0].drop("name"), width, shards), "sketches")
        # whole texts meet in the first shards and what is left of them in as many others, so that no row meets itself; a text
        # that is both, or that has no whole one beside it, is in all
        everywhere, left = F.concat("names", "names"), F.concat(F.array_repeat(F.lit(None).cast("bigint"), shards), F.col("names"))
        lone = rows.where("was is null").select("name").distinct().withColumn("lone", F.lit(True))
        own = own.select(_name(F.col("doc_id"), F.col("h")).alias("name"), "*").join(lone, "name", "left")
        first = rows.where("node is not null").withColumn("names", F.when(F.col("was") == F.col("h"), everywhere).otherwise(F.col("names")))
        own_rows = own.withColumn("names", F.when(F.col("lone"), everywhere).otherwise(left))
        rows = first.select("doc_id", "h", "node", "names", F.lit(False).alias("own")).unionByName(own_rows.select("doc_id", "h", "node", "names", F.lit(True).alias("own")))
        data = data.select("node", "fp", "shingles").unionByName(sketches.select("node", "fp", "shingles"))
    members, held = _met(rows, data)
    discard(data, rows)
    groups = _near(members, held, least, radius, tree_size)
    placed = rows.select(_name(F.col("doc_id"), F.col("h")).alias("name"), "doc_id", "h", "own", "node").join(groups, "node", "left")
    placed = materialize(placed.select("name", "doc_id", "h", "own", F.coalesce("component", "node").alias("component")), "near-placed")
    discard(rows)
    named = placed.groupBy("name").agg(
        F.min("doc_id").alias("doc_id"), F.min("h").alias("h"), F.min(F.struct("own", "component")).alias("first"), F.count_if(~F.col("own")).alias("n"), F.count_if("own").alias("n_own")
    )
    named = named.select("name", "doc_id", "h", F.col("first.component").alias("component"), F.when(F.col("n") > 0, F.col("n")).otherwise(F.col("n_own")).alias("n"))
    if whole is not None:
        named = materialize(named, "near-first")
        # groups that a row's two texts are in are one, but for what is left of a row and is like no other text
        several = placed.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
        left = placed.where("own").join(several, "component").select("name", F.col("component").alias("b"))
        ties = left.join(named.select("name", F.col("component").alias("a")), "name").where("a <> b").select("a", "b").distinct()
        ties = connected_components(materialize(ties, "near-ties")).select(F.col("node").alias("component"), F.col("component").alias("joined"))
        named = named.join(ties, "component", "left").withColumn("component", F.coalesce("joined", "component")).drop("joined")
    named = materialize(named, "near-named")
    discard(placed, named)
    best = named.groupBy("component").agg(F.sum("n").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "h")).alias("best"))
    best = materialize(best.select("component", "n", _name(F.col("best.doc_id"), F.col("best.h")).alias("best_name")), "kept")
    # a row that is its whole group stays where it is; only those that may have company are joined, so few texts are moved
    company = materialize(named.join(best.where("n > 1").select("component"), "component", "left_semi").select("name").distinct(), "near-company")
    split = split_by(company)
    open_, alone = split(keyed, key)
    best, _ = split(best.select("best_name"), "best_name")
    # joined and made single by the same column, so that the texts are moved once
    chosen = open_.join(best.distinct(), F.col(key) == F.col("best_name"), "left_semi").dropDuplicates([key])
    return alone.unionByName(chosen).select(*docs.columns)


def _name(doc_id: Column, text_hash: Column) -> Column:
    """64 bits that stand for a document's id and text."""
    return F.xxhash64(doc_id, doc_id.isNull(), text_hash)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op1_simhash": op1_simhash}
ORACLES: dict[str, str] = {}
