"""Benchmark decontamination: spaced-seed hashes joined to the benchmark's, then overlaps verified along the diagonal."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, LongType, StructType

from lexiforge.functions.lots import LOT, lots
from lexiforge.llm.common import distinct, table

#: Fixed seeds: 1 is a word that is hashed, 0 one that is ignored. Every stretch of ten words or more of which four fifths
#: agree leaves at least one of them untouched at some place (enumerated in the tests).
MASKS = ("111011", "101000111", "1111001")
_WORDS, _SHARE = 10, Fraction(4, 5)  # what MASKS are complete for
_WORD, _EDGE = re.compile(r"\w+"), re.compile(r"\W")
_BLOCK = 1 << 20
_TABLE_BITS = 20
_KNOWN = 500_000
_RUN = 1 << 18  # hits of a text that are held at once
_FAR = 1 << 35  # added to a shift, so that it is no negative number beside its item


class _Hashes(dict):
    """word -> 64-bit hash, remembered; forgotten as a whole at a fixed size."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _KNOWN:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def word_hashes(text: str | None, known: dict[str, int]) -> np.ndarray:
    """One hash for each lower-cased run of word characters, in order; 8 bytes a word are held, the text is cut in
    blocks that end where a word ends."""
    text = text or ""
    parts, at = [np.zeros(0, dtype=np.uint64)], 0
    while at < len(text):
        edge = _EDGE.search(text, at + _BLOCK)
        end = edge.start() if edge else len(text)
        words = _WORD.findall(text[at:end].lower())
        parts.append(np.fromiter((known[w] for w in words), dtype=np.uint64, count=len(words)))
        at = end
    return np.concatenate(parts)


def _multipliers(n: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(b"offset", i) | 1 for i in range(n)], dtype=np.uint64)


def _seed_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """The hash of the words under the mask's ones, at every place where the whole mask fits."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out, by = np.zeros(n, dtype=np.uint64), _multipliers(len(mask))
    for i, c in enumerate(mask):
        if c == "1":
            out += words[i : i + n] * by[i]
    return out ^ (out >> np.uint64(29))


def _share(least_share: float) -> Fraction:
    return Fraction(least_share).limit_denominator(10_000)


def longest_stretch(same: np.ndarray, share: Fraction) -> tuple[int, int]:
    """Start and stop of the longest stretch of which a share of `share` or more is true; the first of several.

    For every stop the start is the first place whose prefix sum is not greater: the sums' running minimum never rises, so
    that place is found by bisection.
    """
    total = np.concatenate([[0], np.cumsum(np.where(same, share.denominator - share.numerator, -share.numerator))])
    start = np.searchsorted(-np.minimum.accumulate(total), -total, "left")
    stop = int(np.argmax(np.arange(len(total)) - start))
    return int(start[stop]), stop


def masks_for(n: int, share: Fraction, *, whole: bool = False) -> list[str]:
    """Masks one of which is left untouched by every stretch of n words or more (of n words alone if whole) that agrees in share.

    A stretch of 2n words or more has a part of n or more that agrees as well, so shorter ones are enough. n words of which e
    differ are cut into e + 2 pieces: two pieces are untouched, and each pair of pieces is a mask.
    """
    if not whole and n >= _WORDS and share >= _SHARE:
        return list(MASKS)
    out, least = set(), -1
    for size in range(n, n + 1 if whole else 2 * n):
        differ = size - ceil(size * share)
        if differ == least:  # holds a stretch of one word less with as many differing words
            continue
        least = differ
        pieces = min(size, differ + 2)
        cuts = [size * i // pieces for i in range(pieces + 1)]
        for on in combinations(range(pieces), max(1, pieces - differ)):
            out.add("".join(("1" if i in on else "0") * (cuts[i + 1] - cuts[i]) for i in range(pieces)).strip("0"))
    return sorted(out)


@dataclass(frozen=True)
class Seeds:
    """One block of the benchmark: its items' word hashes, and for each mask the sorted seed hashes with item and place.

    The masks are complete: an overlap of least_words words or more, or of a whole shorter item, of which least_share agree
    has a seed. Shorter items have masks for their own length.
    """

    ids: list
    words: list[np.ndarray]
    masks: list[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    @staticmethod
    def of(items: list[tuple[object, str]], least_words: int = 10, least_share: float = 0.8) -> Seeds:
        known, share = _Hashes(), _share(least_share)
        pairs = [(i, w) for i, t in items if len(w := word_hashes(t, known))]
        least = max(1, least_words)
        users: dict[str, list[int]] = {}
        for n in sorted({min(len(w), least) for _, w in pairs}):
            for mask in masks_for(n, share, whole=n < least and not (n >= _WORDS and share >= _SHARE)):
                users.setdefault(mask, []).extend(k for k, (_, w) in enumerate(pairs) if min(len(w), least) == n)
        out = []
        for mask, chosen in users.items():
            hashes = [_seed_hashes(pairs[k][1], mask) for k in chosen]
            item = np.concatenate([np.full(len(h), k, dtype=np.int32) for k, h in zip(chosen, hashes, strict=True)])
            place = np.concatenate([np.arange(len(h), dtype=np.int32) for h in hashes])
            h = np.concatenate(hashes)
            order = np.argsort(h, kind="stable")
            there = np.zeros(1 << _TABLE_BITS, dtype=bool)
            there[(h >> np.uint64(64 - _TABLE_BITS)).astype(np.intp)] = True
            out.append((mask, h[order], item[order], place[order], there))
        return Seeds([i for i, _ in pairs], [w for _, w in pairs], out)

    def diagonals(self, words: np.ndarray, run: int = _RUN) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The diagonals (item, shift) on which some seed hits, by item and shift, for one run of the text after the other: a
        run has about `run` hits of all masks, so memory does not grow with what repeats. A diagonal that leads on into the
        next run comes up there again."""
        found, many = [], np.zeros(len(words) + 1, dtype=np.int64)
        for mask, hashes, item, place, there in self.masks:
            mine = _seed_hashes(words, mask)
            at = np.flatnonzero(there[(mine >> np.uint64(64 - _TABLE_BITS)).astype(np.intp)])
            if not at.size:
                continue
            lo, hi = np.searchsorted(hashes, mine[at], "left"), np.searchsorted(hashes, mine[at], "right")
            hit = hi > lo
            if hit.any():
                found.append((at[hit], lo[hit], (hi - lo)[hit], item, place))
                many[at[hit]] += (hi - lo)[hit]
        upto, first = np.cumsum(many), 0
        while found and first < len(words) and upto[-1] > (before := int(upto[first - 1]) if first else 0):
            stop = max(int(np.searchsorted(upto, before, "right")) + 1, int(np.searchsorted(upto, before + run, "right")))
            packed = []
            for at, lo, n, item, place in found:
                a, b = np.searchsorted(at, (first, stop))
                k = n[a:b]
                entry = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(lo[a:b], k)
                packed.append((item[entry].astype(np.int64) << 36) + (np.repeat(at[a:b], k) - place[entry] + _FAR))
            packed = distinct(np.concatenate(packed))
            yield packed >> 36, (packed & (1 << 36) - 1) - _FAR
            first = stop

    def overlaps(self, words: np.ndarray, least_words: int, least_share: float) -> Iterator[tuple[object, int, int, int]]:
        """The best overlap with each item: (item id, first word in the document, words, words that agree).

        Along a hit's diagonal an overlap is the longest stretch of which a share of least_share or more agrees: a word that
        agrees counts 1 - least_share and one that doesn't counts -least_share, in whole numbers, and the stretch's sum must
        not be negative. It must have least_words words, or the whole item if that is shorter. Of an item's diagonals the one
        with most words that agree is given, the first of several; after a whole item that agrees in full no other is tried,
        since every place of such a diagonal hits and runs go forward.
        """
        best: dict[int, tuple[int, int, int]] = {}
        share, over = _share(least_share), np.zeros(len(self.words), dtype=bool)
        for items, shifts in self.diagonals(words):
            open_ = ~over[items]
            for item, shift in zip(items[open_].tolist(), shifts[open_].tolist(), strict=True):
                mine = self.words[item]
                lo, hi = max(0, -shift), min(len(mine), len(words) - shift)
                least = min(least_words, len(mine))
                if over[item] or hi - lo < max(least, 1):
                    continue
                same = mine[lo:hi] == words[lo + shift : hi + shift]
                start, stop = longest_stretch(same, share)
                n = stop - start
                if n >= least and n:
                    got = (int(same[start:stop].sum()), n, -(lo + shift + start))
                    best[item] = max(best.get(item, got), got)
                    over[item] = got[0] == len(mine)
        for item, (agree, n, at) in sorted(best.items()):
            yield self.ids[item], -at, n, agree


def blocks(benchmark: DataFrame, text: str = "text", item_id: str = "item_id", *, max_words: int = 1_000_000, least_words: int = 10, least_share: float = 0.8) -> Iterator[Seeds]:
    """The benchmark in blocks of about max_words words, so that what is broadcast is bounded however large it is."""
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).where("text is not null")
    words = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    n = max(1, ceil(words / max_words))
    for b in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        yield Seeds.of([(r["item_id"], r["text"]) for r in part.collect()], least_words, least_share)


def matches(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", *, item_text: str = "text", least_words: int = 10, least_share: float = 0.8
) -> DataFrame:
    """Rows (doc_id, item_id, start_word, n_words, n_agree): the best overlap of each document with each benchmark item.

    Words are lower-cased runs of letters, digits and underscores; an overlap tolerates substituted words. Null and empty
    texts and items overlap nothing; repeated documents and items each give their rows. Ids may be of any type that Arrow
    carries. Documents are read whole, once for each block of the benchmark, and nothing but the overlaps is moved.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    id_type = benchmark.schema[item_id].dataType
    schema = StructType([rows.schema["doc_id"]]).add("item_id", id_type).add("start_word", LongType()).add("n_words", IntegerType()).add("n_agree", IntegerType())
    out, id_kind = None, to_arrow_type(id_type)
    for seeds in blocks(benchmark, item_text, item_id, least_words=least_words, least_share=least_share):
        shared = docs.sparkSession.sparkContext.broadcast(seeds)  # a block of max_words words

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            s, known = shared.value, _Hashes()
            for batch in batches:
                found = [(i, *m) for i, t in enumerate(batch.column(1).to_pylist()) for m in s.overlaps(word_hashes(t, known), least_words, least_share)]
                ids = batch.column(0).take(pa.array([f[0] for f in found], pa.int64()))
                more = [pa.array([f[k] for f in found], t) for k, t in ((1, id_kind), (2, pa.int64()), (3, pa.int32()), (4, pa.int32()))]
                if found:
                    yield pa.RecordBatch.from_arrays([ids, *more], schema.names)

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", *, item_text: str = "text", least_words: int = 10, least_share: float = 0.8) -> DataFrame:
    """The pipeline's filter: rows and columns of docs without an overlap with any benchmark item (rules as in matches)."""
    at = docs.columns.index(text)
    for seeds in blocks(benchmark, item_text, item_id, least_words=least_words, least_share=least_share):
        shared = docs.sparkSession.sparkContext.broadcast(seeds)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            s, known = shared.value, _Hashes()
            for batch in (lot for b in batches for lot in lots(b, LOT, at)):
                clean = [next(s.overlaps(word_hashes(t, known), least_words, least_share), None) is None for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op9_decontamination": op9_decontamination}
ORACLES: dict[str, str] = {}
