"""Toxicity: subword-bag embeddings averaged into a linear softmax, both trained together in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm.common import Places, held_out, plus, table
from lexiforge.store import materialize

_WORD, _EDGE = re.compile(r"[^\W\d_]+"), re.compile(r"[\W\d_]")
_BLOCK = 1 << 20


@dataclass(frozen=True)
class Bag:
    """How a text becomes bags of subwords: windows of words, each word as its character n-grams with end marks and itself, hashed."""

    min_n: int = 3
    max_n: int = 5
    bits: int = 18
    window: int = 12

    def subwords(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Slots of all n-grams and of the whole word, one word after the other, and how many each word has; no word is cut."""
        mask = (1 << self.bits) - 1
        size = np.fromiter((len(w) + 2 for w in words), dtype=np.int64, count=len(words))
        code = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        start, of = np.cumsum(size) - size, np.repeat(np.arange(len(words)), size)
        left = np.repeat(start + size, size) - np.arange(len(code))  # code points up to the word's end
        slots, owner = [np.fromiter((crc32(w.encode("utf-8", "surrogatepass")) & mask for w in words), dtype=np.int64, count=len(words))], [np.arange(len(words))]
        gram = np.zeros(len(code), dtype=np.uint32)
        for n in range(1, min(self.max_n, len(code)) + 1):
            gram = gram[: len(code) - n + 1] * np.uint32(0x01000193) + code[n - 1 :]
            if n >= self.min_n:
                at = np.flatnonzero(left[: len(gram)] >= n)
                h = gram[at] * np.uint32(0x85EBCA6B)
                h ^= h >> np.uint32(15)
                slots.append((h * np.uint32(0xC2B2AE35) >> np.uint32(32 - self.bits)).astype(np.int64))
                owner.append(of[at])
        owner, slots = np.concatenate(owner), np.concatenate(slots)
        order = np.argsort(owner, kind="stable")
        return slots[order], np.bincount(owner, minlength=len(words))

    def words(self, text: str) -> Iterator[str]:
        """Lower-cased runs of letters, from blocks of the text that end where a word ends."""
        at = 0
        while at < len(text):
            edge = _EDGE.search(text, at + _BLOCK)
            end = edge.start() if edge else len(text)
            yield from _WORD.findall(text[at:end].lower())
            at = end


@dataclass(frozen=True)
class Model:
    """Logit of a window: the mean over its words of the mean of a word's subword logits, plus a bias.

    A subword's logit is its embedding times the difference of the softmax's two rows, worked out once after training.
    """

    bag: Bag
    logit: np.ndarray
    bias: float


class _Scored:
    """The logits of words, remembered while a worker reads on; forgotten as a whole when `room` words are held."""

    def __init__(self, model: Model, room: int = 400_000):
        self.model, self.room = model, room
        self.places, self.logit = Places(), np.zeros(0, dtype=np.float32)

    def values(self, texts: list[str]) -> list[np.ndarray]:
        """For each text the logits of its words, in order."""
        if len(self.places) > self.room:
            self.places, self.logit = Places(), np.zeros(0, dtype=np.float32)
        bag, at = self.model.bag, self.places.__getitem__
        ids = [np.array(list(map(at, bag.words(t))), dtype=np.int64) for t in texts]
        if self.places.new:
            slots, size = bag.subwords(self.places.new)
            mean = np.add.reduceat(self.model.logit[slots], np.cumsum(size) - size) / size
            self.logit = np.concatenate([self.logit, mean.astype(np.float32)])
            self.places.new = []
        return [self.logit[x] for x in ids]


_held: dict[str, object] = {}  # of this worker process, so that later tasks find it


def _best_window(values: np.ndarray, window: int) -> float:
    """The largest mean over windows of `window` values that start every half window; all values if they are fewer."""
    if len(values) <= window:
        return float(values.mean()) if len(values) else 0.0
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    start = np.arange(0, len(values) - window // 2, window // 2)
    stop = np.minimum(start + window, len(values))
    start = stop - window
    return float(((total[stop] - total[start]) / window).max())


def fit(
    labelled: DataFrame,
    text: str = "text",
    toxic: str = "toxic",
    *,
    bag: Bag = Bag(),
    max_rows: int = 6000,
    dim: int = 8,
    steps: int = 100,
    rate: float = 1.0,
    seed: int = 7,
    share: float | None = None,
) -> Model | None:
    """Train on at most max_rows labelled texts, taken in the order of their text hash and whole, however long.

    Up to half of max_rows are toxic and as many are not, so a rare label is seen; both weigh the same in training, and the
    bias is then moved half way to the natural share of toxic rows (share, or else that of labelled). A row with a null text
    or label teaches nothing. The driver holds the sample only: max_rows texts. Embeddings and softmax are trained together
    by gradient steps with momentum; a document's loss is that of its windows under attention that sharpens from all windows
    to the best one. None if the sample does not hold both labels.
    """
    rows = labelled.select(F.col(text).alias("text"), F.col(toxic).cast("int").alias("y")).where("text is not null and y in (0, 1)")
    order = F.xxhash64("text")
    got = [rows.where(F.col("y") == y).orderBy(order).limit(max_rows // 2).collect() for y in (1, 0)]
    if not got[0] or not got[1]:
        return None
    if share is None:
        share = rows.groupBy().agg(F.avg("y")).first()[0]
    return _train(bag, [r["text"] for part in got for r in part], np.array([r["y"] for part in got for r in part], dtype=np.float64), share, dim, steps, rate, seed)


def _train(bag: Bag, texts: list[str], y: np.ndarray, share: float, dim: int, steps: int, rate: float, seed: int) -> Model:
    known: dict[str, int] = {}
    spans, words, doc_windows = [], [], np.zeros(len(texts), dtype=np.int64)
    half = bag.window // 2
    for i, t in enumerate(texts):
        ids = [known.setdefault(w, len(known)) for w in bag.words(t)] or [known.setdefault("", len(known))]
        starts = [0] if len(ids) <= bag.window else [min(s, len(ids) - bag.window) for s in range(0, len(ids) - half, half)]
        for s in starts:
            spans.append(min(bag.window, len(ids)))
            words.extend(ids[s : s + bag.window])
        doc_windows[i] = len(starts)
    words, spans = np.array(words, dtype=np.int32), np.array(spans, dtype=np.int64)
    word_at = np.concatenate([[0], np.cumsum(spans)[:-1]])
    window_at = np.concatenate([[0], np.cumsum(doc_windows)[:-1]])
    window_doc = np.repeat(np.arange(len(texts)), doc_windows)
    flat, size = bag.subwords(list(known))
    gram_at = np.concatenate([[0], np.cumsum(size)[:-1]])
    used, flat = np.unique(flat, return_inverse=True)  # only slots that occur are trained
    flat = flat.astype(np.int32)

    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 1e-3, (len(used), dim))
    soft = rng.normal(0, 0.5, (2, dim))
    bias = 0.0
    seen = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    slow_emb, slow_soft, slow_bias = np.zeros_like(emb), np.zeros_like(soft), 0.0

    for step in range(1, steps + 1):
        direction = soft[1] - soft[0]
        word = np.add.reduceat((emb @ direction)[flat], gram_at) / size
        raw = np.add.reduceat(word[words], word_at) / spans
        sharp = min(30.0, 0.2 * step)
        top = np.maximum.reduceat(raw, window_at)
        mass = np.exp(np.clip(sharp * (raw - top[window_doc]), -60, 0))
        mass /= np.add.reduceat(mass, window_at)[window_doc]
        logit = np.add.reduceat(mass * raw, window_at) + bias
        err = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) * seen
        from_window = err[window_doc] * mass / spans
        by_word = np.bincount(words, weights=np.repeat(from_window, spans), minlength=len(known))
        by_gram = np.bincount(flat, weights=np.repeat(by_word / size, size), minlength=len(used))
        pull = by_gram @ emb
        emb_grad = by_gram[:, None] * direction[None, :]
        # one step size for all slots, so that a subword moves by how many texts agree on it, not by being rare
        slow_emb = 0.9 * slow_emb + emb_grad
        slow_soft = 0.9 * slow_soft + np.stack([-pull, pull])
        slow_bias = 0.9 * slow_bias + err.sum()
        left = rate * (1 - (step - 1) / steps)
        emb -= left * slow_emb / (np.abs(slow_emb).max() + 1e-12)
        soft -= 0.1 * left * slow_soft / (np.abs(slow_soft).max() + 1e-12)
        bias -= 0.5 * left * np.sign(slow_bias) * min(1.0, abs(slow_bias) * 4)
    logit = np.zeros(1 << bag.bits, dtype=np.float32)
    logit[used] = emb @ (soft[1] - soft[0])
    prior = np.log(max(share, 1e-4) / max(1 - share, 1e-4))
    return Model(bag, logit, float(bias + 0.5 * prior))


def predict(docs: DataFrame, model: Model | None, text: str = "text", *, score: str = "score") -> DataFrame:
    """All rows and columns of docs, then a score of 0 to 1: the softmax of the text's most toxic window.

    A null or empty text, or one without letters, gets the score of the bias alone; 0 where no model could be trained.
    Texts are read whole, in blocks; score must not be a column of docs.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits floats
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        if m and _held.get("model") is not m:
            _held["model"], _held["words"] = m, _Scored(m)
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for lo in range(0, batch.num_rows if m else 0, 512):
                texts = [t or "" for t in batch.column(at).slice(lo, 512).to_pylist()]
                raw = [_best_window(v, m.bag.window) for v in _held["words"].values(texts)]
                out[lo : lo + len(raw)] = 1 / (1 + np.exp(-np.clip(np.array(raw) + m.bias, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, score])

    return docs.mapInArrow(run, plus(docs, {score: "double"}))


def op5_toxicity(spark: SparkSession, sf_dir: str, threshold: float = 0.3, max_rows: int = 6000) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where((F.col("toxic").isin(0, 1)) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    share = labels.agg(F.avg("toxic")).first()[0]
    chosen = [labels.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows // 2) for y in (0, 1)]
    sample = docs.join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")  # max_rows ids
    sample = materialize(sample, "toxicity-sample")
    found = predict(docs, fit(sample, max_rows=max_rows, share=share))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


QUERIES = {"op5_toxicity": op5_toxicity}
ORACLES: dict[str, str] = {}
