"""Periodic runs of words: seed-and-extend along the diagonals of each text, from k-grams that every run must repeat."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm.common import plus, table

WORD = r"[^\x20\x09-\x0D]+"
_BATCH_WORDS = 400_000


def _names(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, int]:
    """A number for each pair of numbers that occurs more than once, equal for equal pairs, -1 for the others."""
    span = int(second.max(initial=0)) + 1
    pair = first * span + second
    order = np.argsort(pair, kind="stable")
    same = np.zeros(len(pair) + 1, dtype=bool)
    same[1:-1] = pair[order[1:]] == pair[order[:-1]]
    name = np.cumsum(~same[:-1]) - 1
    out = np.empty(len(pair), dtype=np.int64)
    out[order] = np.where(same[:-1] | same[1:], name, -1)
    return out, int(name[-1]) + 1 if len(name) else 0


class _Grams:
    """Repeated grams of 2^j words: the places where they begin, in order, and a number that is equal for equal grams.

    Places of grams that stand once in their text are left out, and so, at the next level, are all that begin there."""

    def __init__(self, at: np.ndarray, name: np.ndarray, width: int):
        self.at, self.name, self.width = at, name, width

    def joined(self, shift: int) -> _Grams:
        """Grams of width + shift words, each made of the gram at its place and the one `shift` words on, that repeat."""
        if not len(self.at):
            return _Grams(self.at, self.name, self.width + shift)
        to = np.searchsorted(self.at, self.at + shift)
        to[to == len(self.at)] = 0
        both = self.at[to] == self.at + shift
        name, _ = _names(self.name[both], self.name[to[both]])
        return _Grams(self.at[both][name >= 0], name[name >= 0], self.width + shift)

    def pairs(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Each occurrence and the next one of the same gram, at lags low <= lag < high: (place, lag)."""
        order = np.argsort(self.name, kind="stable")
        at, name = self.at[order], self.name[order]
        lag = at[1:] - at[:-1]
        keep = (name[1:] == name[:-1]) & (lag >= low) & (lag < high)
        return at[:-1][keep], lag[keep]


def _agree(words: np.ndarray, a: int, b: int, stop: int) -> int:
    """How many words from b on, up to stop, equal those from a on; doubling steps."""
    n, step = 0, 16
    while b + n < stop:
        k = min(step, stop - b - n)
        differ = words[a + n : a + n + k] != words[b + n : b + n + k]
        if differ.any():
            return n + int(differ.argmax())
        n, step = n + k, step * 2
    return n


def find_runs(words: np.ndarray, texts: np.ndarray, *, min_length: int = 6, min_exponent: int = 4) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of the texts in `words`, numbers of words, those of text t at texts[t]:texts[t + 1].

    A run is a stretch of one text with smallest period q and length >= max(min_length, min_exponent * q) that no
    neighbouring word extends. Shifted by q it agrees with itself over the rest of its length, (min_exponent - 1) * q words
    at least. So for lags from 2^j to under 2^(j+1) the grams of the overlap that the least of these lags guarantees are
    indexed, by doubling, exactly and text by text; they are no shorter than the lag, so inside a run their next
    occurrence is exactly one period on, and pairs of neighbouring occurrences seed every run and no multiple of its
    period. A seed is extended along its diagonal to both sides unless the furthest place covered at its lag lies beyond it.
    Time is O(n log n) but for the sorts of each level, however often words repeat. min_exponent must be 3 or more.
    """
    if min_exponent < 3:
        raise ValueError("min_exponent must be 3 or more")
    text_of = np.repeat(np.arange(len(texts) - 1), np.diff(texts))
    name, _ = _names(text_of, words)
    alive = np.flatnonzero(name >= 0)
    grams, runs, longest = _Grams(alive, name[alive], 1).joined(1), [], int(np.diff(texts).max(initial=0))
    low = 1
    while low * min_exponent <= longest and len(grams.at):
        high = low * 2  # grams has the repeated grams of `high` words
        overlap = min(max(min_length, min_exponent * lag) - lag for lag in range(low, min(high, min_length + low)))
        seeds = grams
        while seeds.width < overlap and len(seeds.at):
            seeds = seeds.joined(min(seeds.width, overlap - seeds.width))
        at, lag = seeds.pairs(low, high)
        order = np.lexsort((at, lag))
        at, lag = at[order], lag[order]
        first = np.ones(len(at), dtype=bool)  # of seeds next to each other on one diagonal
        first[1:] = (lag[1:] != lag[:-1]) | (at[1:] != at[:-1] + 1)
        covered: dict[int, int] = {}
        for i, q in zip(at[first].tolist(), lag[first].tolist(), strict=True):
            if i < covered.get(q, -1):
                continue
            t = text_of[i]
            begin, end = int(texts[t]), int(texts[t + 1])
            right = i + _agree(words, i, i + q, end)
            left = i - _agree_back(words, i, i + q, begin)
            covered[q] = right
            if right + q - left >= max(min_length, min_exponent * q):
                runs.append((left, right + q - left, q))
        grams, low = grams.joined(high), high
    return sorted(runs, key=lambda r: (r[0], r[2]))


def _agree_back(words: np.ndarray, a: int, b: int, begin: int) -> int:
    """How many words before a, down to begin, equal those before b; doubling steps."""
    n, step = 0, 16
    while a - n > begin:
        k = min(step, a - n - begin)
        differ = (words[a - n - k : a - n] != words[b - n - k : b - n])[::-1]
        if differ.any():
            return n + int(differ.argmax())
        n, step = n + k, step * 2
    return n


def _of_batch(texts: list[str | None], min_length: int, min_exponent: int) -> Iterator[tuple[list[tuple[int, int, int]], str]]:
    """Runs and collapsed text of each text, in order; short texts are searched many at once."""
    split = [(t or "").encode().split() for t in texts]  # bytes split at 0x20 and 0x09-0x0D and nowhere else
    known: dict[bytes, int] = {}
    lo = 0
    while lo < len(split):
        hi, total = lo, 0
        while hi < len(split) and (hi == lo or total + len(split[hi]) <= _BATCH_WORDS):
            total += len(split[hi])
            hi += 1
        known.clear()
        numbers = np.fromiter((known.setdefault(w, len(known)) for words in split[lo:hi] for w in words), dtype=np.int64, count=total)
        texts_at = np.concatenate([[0], np.cumsum([len(words) for words in split[lo:hi]])]).astype(np.int64)
        found = find_runs(numbers, texts_at, min_length=min_length, min_exponent=min_exponent)
        of = np.searchsorted(texts_at, [r[0] for r in found], side="right") - 1
        runs: list[list[tuple[int, int, int]]] = [[] for _ in range(hi - lo)]
        for t, (start, length, period) in zip(of.tolist(), found, strict=True):
            runs[t].append((start - int(texts_at[t]), length, period))
        for words, own in zip(split[lo:hi], runs, strict=True):
            kept, upto = ([], 0) if own else (words, 0)
            for start, end in _dropped(own):
                kept += words[upto:start]
                upto = end
            if own:
                kept += words[upto:]
            yield own, b" ".join(kept).decode()
        lo = hi


def _dropped(runs: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The words that stand in a run after its first period, as disjoint ranges in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted((start + period, start + length) for start, length, period in runs):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def periodic_runs(docs: DataFrame, text: str = "text", *, runs: str = "runs", collapsed: str = "collapsed", min_length: int = 6, min_exponent: int = 4) -> DataFrame:
    """docs with all periodic runs of words of each text and the text without their repetitions.

    runs: array of (start, length, period) in words, by start, then period; see find_runs. collapsed: the words that no run
    contains after its first period, joined by one space. Words are what stands between 0x20 and 0x09-0x0D. A null or empty
    text has no run and an empty collapsed text; texts are searched whole, whatever their length, each by itself, so equal
    rows get equal results and an empty table gives none. Columns of docs with one of the two names are replaced.
    """
    base = docs.drop(runs, collapsed)
    given, at = base.columns, base.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            found, left = [], []
            for own, kept in _of_batch(batch.column(at).to_pylist(), min_length, min_exponent):
                found.append([{"start": s, "length": n, "period": p} for s, n, p in own])
                left.append(kept)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind), pa.array(left, pa.string())], [*given, runs, collapsed])

    return base.mapInArrow(run, plus(base, {runs: "array<struct<start:bigint,length:bigint,period:bigint>>", collapsed: "string"}))


def greatest_run(runs: Column) -> Column:
    """The run of greatest exact length / period, the first of equals by start and period; null without runs."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.aggregate(runs, none, lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def with_planted_period(text: Column, doc_id: Column) -> Column:
    """The text, in which one document in ten, by CRC-32 of its decimal id, goes on with a repeated stretch of its own words."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def edited(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, place(i).cast("int"))), " "))

    bound = F.transform(F.array(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), edited)  # the words are found once
    return F.when(h % 10 == 0, F.coalesce(F.get(bound, F.lit(0)), text)).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", with_planted_period(F.col("text"), F.col("doc_id")).alias("text"))
    found = periodic_runs(docs).withColumn("best", greatest_run(F.col("runs")))
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    milli = 1000 * F.col("best.length")
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        ((milli - milli % F.col("best.period")) / F.col("best.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {"op12_periodic_runs": op12_periodic_runs}
ORACLES: dict[str, str] = {}
