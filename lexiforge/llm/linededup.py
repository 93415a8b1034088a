"""Line dedup: fuzzy lines by MinHash of character shingles, exact Jaccard verification, union of verified links."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.functions.lots import LOT, lots
from lexiforge.llm.common import distinct, free_name, id_filter, plus, table
from lexiforge.llm.simhash import _forest
from lexiforge.operators.components import connected_components
from lexiforge.store import materialize

_CHUNK = 1 << 15
_ENTRIES = 1 << 19  # members of sets that are compared at once


@dataclass(frozen=True)
class Shape:
    """Shingles of `chars` characters; bands of `rows` minima each; links from a Jaccard similarity of `least` on."""

    chars: int = 8
    bands: int = 8
    rows: int = 4
    least: float = 0.8


def norm(line: str) -> str:
    """What two lines are compared by: lower case, runs of white space as one space, none at the ends."""
    return _squeezed(line.lower())


def _squeezed(line: str) -> str:
    """Runs of white space as one space, none at the ends."""
    if line.isprintable() and "  " not in line:  # a space is the one printable white space
        return line.strip()
    return " ".join(line.split())


def line_id(line: str) -> int:
    """64-bit id of a normalised line, as Spark's signed long."""
    h = xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), 42)
    return h - (1 << 64) if h >> 63 else h


def _roll(code: np.ndarray, chars: int) -> np.ndarray:
    """A 64-bit hash of every run of `chars` code points (of all of them if they are fewer)."""
    n = max(1, len(code) - chars + 1)
    h = np.zeros(n, dtype=np.uint64)
    for i in range(min(chars, len(code))):
        h *= np.uint64(0x100000001B3)
        h += code[i : i + n]
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def _shingles(text: str, chars: int) -> np.ndarray:
    """A 64-bit hash of every run of `chars` characters, repeats included; of the whole text if it is shorter."""
    return _roll(_codes(text), chars)


def _scrambled(h: np.ndarray, seed: int) -> np.ndarray:
    h = h ^ np.uint32(seed)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(16)
    return h


def _keys(lines: list[str], shape: Shape, level: int = 0) -> np.ndarray:
    """lines x bands: one key for each band, from minima under different hash functions; other ones on each level.

    The functions are h1 + k * h2 + c_k modulo 2**32, of two hashes of a shingle and a constant: each is uniform, any two of
    them are independent, and the constants keep a shingle with a small h2 from being least under many of them. Lines of at
    least a shingle are laid end to end, as many as fit a chunk that stays in the processor's cache; all their shingles are
    hashed at once, and each line's minima are taken over its own stretch, which ends before shingles that reach into the next
    line. A line longer than a chunk is folded piece by piece, a shorter one than a shingle alone.
    """
    turn = np.random.default_rng(1_000 + level).integers(0, 1 << 32, shape.bands * shape.rows, dtype=np.uint32)
    least = np.full((len(lines), len(turn)), 0xFFFFFFFF, dtype=np.uint32)

    def fold(parts: list[str], of: list[int]) -> None:
        code = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        n = max(1, len(code) - shape.chars + 1)
        h = np.zeros(n, dtype=np.uint32)
        for i in range(min(shape.chars, len(code))):
            h *= np.uint32(0x01000193)
            h += code[i : i + n]
        x, step = _scrambled(h, 0x9E3779B9 + level), _scrambled(h, 0x2545F491 ^ level)
        size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        start = np.cumsum(size) - size
        stop = np.minimum(start + np.maximum(size - shape.chars + 1, 1), n)
        edges = np.stack([start, stop], axis=1).ravel()
        edges = edges[:-1] if edges[-1] >= n else edges
        turned, mine = np.empty_like(x), np.empty((len(turn), len(parts)), dtype=np.uint32)
        for k in range(len(turn)):
            np.add(x, turn[k], out=turned)
            mine[k] = np.minimum.reduceat(turned, edges)[::2]
            x += step
        least[of] = np.minimum(least[of], mine.T)

    parts, of, size = [], [], 0
    for i, line in enumerate(lines):
        if len(line) < shape.chars or len(line) > _CHUNK:
            for lo in range(0, max(1, len(line) - shape.chars + 1), _CHUNK):
                fold([line[lo : lo + _CHUNK + shape.chars - 1]], [i])
            continue
        parts.append(line)
        of.append(i)
        size += len(line)
        if size >= _CHUNK:
            fold(parts, of)
            parts, of, size = [], [], 0
    if parts:
        fold(parts, of)
    out = np.zeros((len(lines), shape.bands), dtype=np.uint64)
    for b in range(shape.bands):
        key = np.full(len(lines), b + 1 + 1000 * level, dtype=np.uint64)
        for r in range(shape.rows):
            key = (key ^ least[:, b * shape.rows + r].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        out[:, b] = key
    return out.view(np.int64)


def _sketch(shape: Shape):
    """Rows (doc key columns, line_no, line, bands) for each line that is not blank; bands at a line's first sight in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in lots(batch, 2 * LOT, 2):
                of, no, ids, new, slot = [], [], [], {}, []
                for i, text in enumerate(part.column(2).to_pylist()):
                    for n, raw in enumerate((text or "").lower().split("\n")):
                        line = _squeezed(raw)
                        if line:
                            of.append(i)
                            no.append(n)
                            x = line_id(line)
                            ids.append(x)
                            slot.append(line if x not in new else None)
                            new[x] = line
                fuzzy = [k for k, line in enumerate(slot) if line is not None and len(line) >= shape.chars]
                keys = _keys([slot[k] for k in fuzzy], shape)
                held = np.zeros(len(ids), dtype=np.int32)
                held[fuzzy] = shape.bands
                bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(held)]).astype(np.int32)), pa.array(keys.ravel()))
                where = pa.array(of, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(where), part.column(1).take(where), pa.array(no, pa.int32()), pa.array(ids, pa.int64()), bands], ["doc_id", "h", "line_no", "line", "bands"]
                )

    return run


def _texts(bits: int):
    """Rows (line, text) of the lines that a one-hash filter of wanted ids lets through, once in a batch."""

    def make(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wanted = np.frombuffer(shared.value, dtype=np.uint8)
            for batch in batches:
                seen = set()
                for part in lots(batch, LOT, 0):
                    got = {}
                    for text in part.column(0).to_pylist():
                        for raw in (text or "").lower().split("\n"):
                            if line := _squeezed(raw):
                                x = line_id(line)
                                p = (x & 0xFFFFFFFFFFFFFFFF) % bits
                                if wanted[p >> 3] >> (p & 7) & 1 and x not in seen:
                                    got[x] = line
                    seen.update(got)
                    yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int64()), pa.array(list(got.values()), pa.string())], ["line", "text"])

        return run

    return make


_RUN_BITS = 12


class _Sets:
    """The sets of shingle hashes of texts, laid end to end: 52 bits of each hash."""

    def __init__(self, texts: list[str], chars: int):
        self.flat, sizes, lo = [], [], 0
        while lo < len(texts):
            hi, length = lo, 0
            while hi < len(texts) and hi - lo < 1 << _RUN_BITS and (length < 1 << 20 or hi == lo):
                length += len(texts[hi])
                hi += 1
            part = self._numbered(texts[lo:hi], chars)
            self.flat.append(part & np.uint64((1 << 64 - _RUN_BITS) - 1))
            sizes.append(np.bincount((part >> np.uint64(64 - _RUN_BITS)).astype(np.int64), minlength=hi - lo))
            lo = hi
        self.flat = np.concatenate([np.zeros(0, dtype=np.uint64), *self.flat])
        self.size = np.concatenate([np.zeros(0, dtype=np.int64), *sizes])
        self.start = np.cumsum(self.size) - self.size

    @staticmethod
    def _numbered(texts: list[str], chars: int) -> np.ndarray:
        """Of up to 2**_RUN_BITS texts one sorted set: a text's number above, the upper bits of a hash below."""
        size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        if size.min() < chars:  # a text shorter than a shingle has one hash, of its own
            return distinct(np.concatenate([np.uint64(i << 64 - _RUN_BITS) | _shingles(t, chars) >> np.uint64(_RUN_BITS) for i, t in enumerate(texts)]))
        start = np.cumsum(size) - size
        h = _roll(_codes("".join(texts)), chars)
        of = np.repeat(np.arange(len(texts)), size)[: len(h)]
        whole = np.arange(len(h)) < (start + size - chars + 1)[of]
        return distinct(of[whole].astype(np.uint64) << np.uint64(64 - _RUN_BITS) | h[whole] >> np.uint64(_RUN_BITS))

    def __getitem__(self, i: int) -> np.ndarray:
        return self.flat[self.start[i] : self.start[i] + self.size[i]]

    def _of(self, which: np.ndarray) -> np.ndarray:
        size = self.size[which]
        at = np.repeat(self.start[which] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return np.repeat(np.arange(len(which)), size).astype(np.uint64) << np.uint64(64 - _RUN_BITS) | self.flat[at]

    def jaccards(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The similarity of set a[i] with set b[i], for all i."""
        out, lo, n = np.zeros(len(a)), 0, 1 << _RUN_BITS
        total = np.cumsum(self.size[a] + self.size[b])
        while lo < len(a):
            hi = max(lo + 1, min(lo + n, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + _ENTRIES))))
            x, y = a[lo:hi], b[lo:hi]
            both = np.sort(np.concatenate([self._of(x), self._of(y)]))
            both = np.bincount((both[1:][both[1:] == both[:-1]] >> np.uint64(64 - _RUN_BITS)).astype(np.int64), minlength=len(x))
            out[lo:hi] = both / (self.size[x] + self.size[y] - both)
            lo = hi
        return out


def _verify(shape: Shape):
    """Of rows (a, b, text_a, text_b) those whose exact Jaccard similarity reaches the threshold, as (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (lot for b in batches for lot in lots(b, LOT, 2, 3)):
            sets, n = _Sets(batch.column(2).to_pylist() + batch.column(3).to_pylist(), shape.chars), batch.num_rows
            like = sets.jaccards(np.arange(n), np.arange(n, 2 * n)) >= shape.least
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(like))

    return run


def _scattered(line: np.ndarray) -> np.ndarray:
    x = line.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ x >> np.uint64(32)).view(np.int64)


def _stars_here(shape: Shape | None, level: int = 0):
    """Of rows (line, bands), or (line, text) with a shape: the buckets of one batch, rows (g, line, low).

    In each bucket the smallest line is low, with the bucket's key as g; the others name it as theirs under a g of their own,
    from which _pairs finds the key. So a bucket that holds much of the table sends one row a batch to its key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            line = batch.column(0).to_numpy()
            if shape:
                line, first = np.unique(line, return_index=True)
                key = _keys(batch.column(1).take(pa.array(first)).to_pylist(), shape, level).ravel()
                line = np.repeat(line, shape.bands)
            else:
                bands = batch.column(1)
                many = np.diff(bands.offsets.to_numpy())
                with_ = np.flatnonzero(many > 0)
                line, first = np.unique(line[with_], return_index=True)
                chosen = bands.take(pa.array(with_[first]))
                key, line = chosen.flatten().to_numpy(), np.repeat(line, np.diff(chosen.offsets.to_numpy()))
            if not len(key):
                continue
            order = np.argsort(key, kind="stable")  # lines ascend, so the first of a bucket is its smallest
            key, line = key[order], line[order]
            new = np.ones(len(key), dtype=bool)
            new[1:] = key[1:] != key[:-1]
            low = line[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
            g = np.where(new, key, key ^ _scattered(line))
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(line), pa.array(low)], ["g", "line", "low"])

    return run


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (g, line, low) sorted by g: the candidates (a, b, key), each line with the smallest of its batch's bucket, and
    each of these with the smallest of all. The last bucket's rows, one from each batch that has it, wait for what follows."""

    def stars(g: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        b = np.repeat(np.minimum.reduceat(line, start), np.diff(np.append(start, len(g))))
        on = line != b
        return line[on], b[on], g[on]

    def rows(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["a", "b", "key"])

    held = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    for batch in batches:
        g, line, low = (batch.column(i).to_numpy() for i in range(3))
        own = line != low
        out = [(line[own], low[own], g[own] ^ _scattered(line[own]))]
        g, line = np.concatenate([held[0], g[~own]]), np.concatenate([held[1], line[~own]])
        if len(g):
            last = np.searchsorted(g, g[-1])
            held = g[last:], line[last:]
            if last:
                out.append(stars(g[:last], line[:last]))
        yield rows(out)
    if len(held[0]):
        yield rows([stars(*held)])


def _common(a: list[np.ndarray], b: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """How many values each set of a shares with each of b: products of 0/1 matrices, so many distinct values at a time."""
    h = np.concatenate([*a, *b])
    row = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in [*a, *b]])
    order = np.argsort(h, kind="stable")
    h, row = h[order], row[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = h[1:] != h[:-1]
    lone = new & np.append(new[1:], True)
    column, row = np.cumsum(new & ~lone)[~lone] - 1, row[~lone]
    out = np.zeros((len(a), len(b)), dtype=np.float64)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        x, y = np.searchsorted(column, [lo, lo + columns])
        part = np.zeros((len(a) + len(b), columns), dtype=np.float32)
        part[row[x:y], column[x:y] - lo] = 1
        out += part[: len(a)] @ part[len(a) :].T
    return out


def _link_blocks(shape: Shape, few: int = 4096, lines: int = 1 << 14):
    """For each row of two blocks of (line, text), or one that meets itself: the pairs that reach the threshold, contracted to
    a spanning forest. The lines of y hang together already where together says so, and count as one.

    The rows of a batch are taken in lots of about `lines` lines. The shingles of a lot's lines are hashed once. Blocks of up to
    `few` pairs are compared pair by pair, those of the whole lot together; larger ones by matrix products.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (lot for b in batches for lot in lots(b, lines, 0, 1)):
            members = [batch.column(k).flatten() for k in (0, 1)]
            many = [np.diff(batch.column(k).offsets.to_numpy()) * batch.column(k).is_valid().to_numpy(zero_copy_only=False) for k in (0, 1)]
            texts = pa.concat_arrays([m.field(1) for m in members])
            line, first, place = np.unique(np.concatenate([m.field(0).to_numpy() for m in members]), return_index=True, return_inverse=True)
            sets = _Sets(texts.take(pa.array(first)).to_pylist(), shape.chars)
            ends = [np.cumsum(m) for m in many]
            of_x, of_y = place[: len(members[0])], place[len(members[0]) :]
            rows, a, b, links = [], [], [], set()
            for i, together in enumerate(batch.column(2).to_pylist()):
                x = of_x[ends[0][i] - many[0][i] : ends[0][i]]
                y = of_y[ends[1][i] - many[1][i] : ends[1][i]] if many[1][i] else x
                if len(x) * len(y) > few:
                    both = _common([sets[k] for k in x], [sets[k] for k in y])
                    p, q = np.nonzero(both / (sets.size[x][:, None] + sets.size[y] - both) >= shape.least)
                    p, q = x[p], y[q]
                    if together:
                        p, one = np.unique(p, return_index=True)
                        links.update(zip(p.tolist(), q[one].tolist(), strict=True))
                    else:
                        links.update(_forest(p[p != q], q[p != q]))
                    continue
                a.append(np.repeat(x, len(y)))
                b.append(np.tile(y, len(x)))
                rows.append(np.full(len(a[-1]), i if together else -1))
            if a:
                a, b, rows = np.concatenate(a), np.concatenate(b), np.concatenate(rows)
                sure = np.minimum(sets.size[a], sets.size[b]) >= shape.least * np.maximum(sets.size[a], sets.size[b])
                sure &= a != b
                a, b, rows = a[sure], b[sure], rows[sure]
                pair, at = np.unique(np.minimum(a, b) * len(line) + np.maximum(a, b), return_inverse=True)
                like = (sets.jaccards(pair // max(1, len(line)), pair % max(1, len(line))) >= shape.least)[at]
                a, b, rows = a[like], b[like], rows[like]
                own = rows >= 0
                _, one = np.unique(rows[own] * len(line) + a[own], return_index=True)
                links.update(zip(a[own][one].tolist(), b[own][one].tolist(), strict=True))
                links.update(_forest(a[~own], b[~own]))
            yield pa.RecordBatch.from_arrays([pa.array(line[np.array([x[k] for x in links], dtype=np.int64)]) for k in (0, 1)], ["a", "b"])

    return run


def _linked_inside(members: DataFrame, texts: DataFrame, shape: Shape, block: int, chars: int = 1 << 21) -> DataFrame:
    """Links (a, b) whose components, with those that stand already, are those of all like pairs inside each bucket of members
    (key, line, apart). Lines that are not apart hang together by links that stand; those apart are compared with all.

    Buckets are cut by hash into blocks of about `block` lines and `chars` characters, lines apart by themselves, and every
    block of lines apart meets every block of its bucket. Buckets of the same lines are compared once.
    """
    sized = members.join(texts, "line")
    full = sized.groupBy("key").agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("line", "apart").cast("decimal(20,0)")).alias("sum"), F.sum(F.length("text")).alias("size")
    ).where("n > 1")
    cuts = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("size") / chars)).cast("int")
    full = materialize(full.groupBy("n", "sum").agg(F.min(F.struct("key", cuts.alias("cuts"))).alias("k")).select("k.key", "k.cuts"), "line-mixed")
    part = F.pmod(F.xxhash64("line", F.lit(7)), F.col("cuts")).cast("int")
    cut = sized.join(full, "key").groupBy("key", "apart", part.alias("part")).agg(F.collect_list(F.struct("line", "text")).alias("m"))
    blocks = materialize(cut, "line-blocks")
    ones = blocks.where("apart")
    alone = ones.select(F.col("m").alias("x"), F.lit(None).cast(blocks.schema["m"].dataType).alias("y"), F.lit(False).alias("together"))
    across = ones.join(blocks.select("key", F.col("apart").alias("too"), F.col("part").alias("to"), F.col("m").alias("y")), "key").where("not too or part < to").select(F.col("m").alias("x"), "y", (~F.col("too")).alias("together"))
    return alone.unionByName(across).mapInArrow(_link_blocks(shape), "a bigint, b bigint").distinct()


def _mixed(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (key, line, apart) of the mixed buckets: those of three lines or more in which some comparison failed. A line is
    apart if it is unlike what it was compared with, or if that is unlike the bucket's smallest line."""
    failed = materialize(pairs.join(found, ["a", "b"], "left_anti"), "line-unlike")
    keys = failed.select("key").distinct()
    mine = pairs.join(keys, "key", "left_semi")
    far = failed.select("key", "a").distinct()
    mine = mine.join(far.withColumn("_own", F.lit(True)), ["key", "a"], "left").join(far.select("key", F.col("a").alias("b"), F.lit(True).alias("_low")), ["key", "b"], "left")
    mine = mine.select("key", "a", "b", F.coalesce("_own", "_low", F.lit(False)).alias("apart"))
    lines = mine.select("key", F.col("a").alias("line"), "apart").unionByName(mine.select("key", F.col("b").alias("line"), F.lit(False).alias("apart")))
    lines = lines.groupBy("key", "line").agg(F.bool_or("apart").alias("apart"))
    sizes = lines.groupBy("key").agg(F.count("*").alias("n"), F.count_if("apart").alias("n_apart")).where("n > 2")
    return materialize(lines.join(sizes, "key"), "line-mixed")


def similar_lines(docs: DataFrame, lines: DataFrame, shape: Shape, *, levels: tuple[tuple[int, int], ...] = ((24, 8), (64, 12)), block: int = 256, direct: int = 1 << 22) -> DataFrame:
    """Verified links (a, b) between different lines.

    docs has one column, the text. lines has line ids with their band keys. In every bucket each member is compared with the
    smallest id of those in its batch, and each of these with the smallest of all: a bucket costs as many rows as it has
    members, however large it is, and true groups of near copies hang together after that. A bucket of three lines or more in
    which some line is unlike what it was compared with, as lines with a common passage are, is mixed: there every line that
    stands apart is compared with all others, exactly. Where that would be more than `direct` comparisons in a bucket, its lines
    are banded again instead: levels has the number of bands and the rows of each further round, so that a round costs a fixed
    number of rows a line; after the last round all that stand apart are compared, block by block, however many they are. A pair
    at the threshold shares a bucket with probability 1 - (1 - least ** rows) ** bands: 0.985, 0.988 and 0.99 as set; one whose
    buckets are all banded twice more is found with 0.963.
    """
    spark, links, texts = docs.sparkSession, None, None
    rows, stars = lines.select("line", "bands"), _stars_here(None)
    for level in range(len(levels) + 1):
        placed = rows.mapInArrow(stars, "g bigint, line bigint, low bigint").repartition("g").sortWithinPartitions("g")
        pairs = materialize(placed.mapInArrow(_pairs, "a bigint, b bigint, key bigint"), "line-pairs")
        if texts is None:
            wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("line")).distinct(), "lines-wanted")
            bits, bitmap = id_filter(wanted)
            texts = docs.mapInArrow(_texts(bits)(spark.sparkContext.broadcast(bitmap)), "line bigint, text string").dropDuplicates(["line"]).join(wanted, "line", "left_semi")
            texts = materialize(texts, "line-texts")
        right = texts.select(F.col("line").alias("b"), F.col("text").alias("text_b"))
        left = texts.select(F.col("line").alias("a"), F.col("text").alias("text_a"))
        both = pairs.select("a", "b").distinct().join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
        found = materialize(both.mapInArrow(_verify(shape), "a bigint, b bigint"), "line-links")
        links = found if links is None else links.unionByName(found)
        mixed, last = _mixed(pairs, found), level == len(levels)
        within = F.lit(last) | (F.col("n") * F.col("n_apart") <= direct)
        links = links.unionByName(materialize(_linked_inside(mixed.where(within).select("key", "line", "apart"), texts, shape, block), "line-links"))
        mixed = mixed.where(~within)
        if last or mixed.isEmpty():
            break
        rows, stars = mixed.select("line").distinct().join(texts, "line").select("line", "text"), _stars_here(Shape(shape.chars, *levels[level], shape.least), level + 1)
    return links


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", *, shape: Shape = Shape(), removed: str | None = None) -> DataFrame:
    """All rows and columns of docs; of every group of like lines one stays in the whole table, the others leave their text.

    Lines are alike if they are equal after lower-casing and squeezing white space, or linked, over any chain, by a Jaccard
    similarity of their character shingles of shape.least or more. The line that stays is the first by document id (null
    ids first), hash of the text and place. Blank lines are left alone, lines shorter than a shingle are only compared for
    equality. removed names a column that gets the number of lines taken out. Null texts stay null. A document is a pair of
    id and text: rows that repeat one are treated as one, and all stay. Equality is that of a 64-bit hash of the line.
    """
    key, hash_ = free_name(docs, "line_doc"), free_name(docs, "line_hash")
    keyed = docs.withColumn(key, F.col(doc_id)).withColumn(hash_, F.xxhash64(F.col(text)))
    rows = keyed.select(F.col(key).alias("doc_id"), F.col(hash_).alias("h"), F.col(text).alias("text"))
    made = plus(rows.select("doc_id"), {"h": "bigint", "line_no": "int", "line": "bigint", "bands": "array<bigint>"})
    lines = materialize(rows.mapInArrow(_sketch(shape), made), "lines")
    links = similar_lines(rows.select("text"), lines.select("line", "bands"), shape)
    groups = connected_components(links)
    # only lines that stand more than once, alone or through their group, matter from here on
    repeated = lines.groupBy("line").agg(F.count("*").alias("n")).where("n > 1").select("line")
    busy = repeated.join(groups.withColumnRenamed("node", "line"), "line", "full_outer").select("line", F.coalesce("component", "line").alias("component"))
    busy = materialize(busy, "line-busy")
    place = F.struct("doc_id", "h", "line_no")
    rows = lines.select("doc_id", "h", "line_no", "line").join(busy.hint("shuffle_hash"), "line").select("component", place.alias("place"))
    rows = materialize(rows, "line-places")
    kept = materialize(rows.groupBy("component").agg(F.min("place").alias("keep")), "line-kept")
    gone = rows.join(kept, "component").where(F.col("place") != F.col("keep"))
    gone = materialize(gone.groupBy(F.col("place.doc_id").alias("of_doc"), F.col("place.h").alias("of_text")).agg(F.collect_set("place.line_no").alias("gone")), "line-gone")
    at = F.split(F.col(text), "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(at) - 1), F.col("gone"))
    # the lines are split once and then picked by place
    picked = F.transform(F.array(F.struct(at.alias("at"), left.alias("left"))), lambda s: F.array_join(F.transform(s["left"], lambda i: F.element_at(s["at"], i + 1)), "\n"))
    new = F.when(F.col("gone").isNull(), F.col(text)).otherwise(F.element_at(picked, 1))
    out = keyed.join(gone.hint("shuffle_hash"), keyed[key].eqNullSafe(gone["of_doc"]) & (keyed[hash_] == gone["of_text"]), "left")
    more = [F.coalesce(F.size("gone"), F.lit(0)).alias(removed)] if removed else []
    return out.select(*[new.alias(c) if c == text else F.col(c) for c in docs.columns], *more)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), removed="n_removed")


QUERIES = {"op8_line_dedup": op8_line_dedup}
ORACLES: dict[str, str] = {}
