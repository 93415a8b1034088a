"""Token counts: unigram forward scores over a trie of distinct pre-tokens, one step for each shared prefix."""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from math import log
from typing import Any

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm.common import Places, plus, single_spaced, table

_BLOCK = 1 << 20
_SLICE = 1 << 23
_LONG = 64


@dataclass(frozen=True)
class Unigram:
    """A byte-piece vocabulary with log probabilities; every single byte is a piece.

    pattern cuts a text into pre-tokens. Of a pattern is asked that a single space between two other characters begins a
    pre-token, that a single line break between two such is one, and that letters after a space make one with it.
    """

    pattern: str
    score: dict[bytes, float]
    longest: int

    @staticmethod
    def from_ranks(path: str, pattern: str, shift: float = 2.7) -> Unigram:
        """Pieces of a public rank file, with Zipf probabilities: the piece of rank r weighs 1 / (r + shift).

        The file has merge ranks only, no probabilities; pieces are merged in order of frequency, so the law stands in for
        them. Nothing is trained.
        """
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        total = log(sum(1 / (r + shift) for r in ranks.values()))
        score = {p: -log(r + shift) - total for p, r in ranks.items()}
        missing = [bytes([i]) for i in range(256) if bytes([i]) not in score]
        score |= dict.fromkeys(missing, min(score.values()))
        return Unigram(pattern, score, max(map(len, score)))


class Endings:
    """The vocabulary read backwards: from the last byte of a prefix, which pieces end there.

    States are the distinct endings of pieces; (state, byte before it) leads to the next longer ending. Edges stand sorted,
    so many prefixes are moved on at once by one search.
    """

    def __init__(self, model: Unigram):
        self.pieces = list(model.score)
        edge: dict[int, int] = {}
        piece = [-1]
        for k, p in enumerate(self.pieces):
            s = 0
            for b in reversed(p):
                down = edge.get(s << 8 | b)
                if down is None:
                    down = edge[s << 8 | b] = len(piece)
                    piece.append(-1)
                s = down
            piece[s] = k
        self.key = np.array(sorted(edge), dtype=np.int64)
        self.to = np.array([edge[int(x)] for x in self.key], dtype=np.int32)
        self.first = np.full(256, -1, dtype=np.int32)  # the edges that leave the root
        root = self.key < 256
        self.first[self.key[root]] = self.to[root]
        self.piece = np.array(piece, dtype=np.int32)
        self.score = np.array([model.score[p] for p in self.pieces])

    def longer(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The endings that are one byte longer; -1 where no piece ends so."""
        want = state.astype(np.int64) << 8 | byte
        at = np.searchsorted(self.key, want)
        at[at == len(self.key)] = 0
        return np.where(self.key[at] == want, self.to[at], np.int32(-1))


class Trie:
    """Distinct pre-tokens sharing their prefixes: a node holds the best score of its prefix and the tokens of that split.

    best(prefix) is the maximum over pieces that end the prefix of best(what stands before the piece) + the piece's score;
    of equal scores the split with fewer tokens counts. A node is worked out once, whatever number of pre-tokens share it:
    all nodes of one depth together, against all their endings of one length after the other. Where a pre-token ends, its
    node keeps how often it occurs (count).
    """

    def __init__(self, endings: Endings, words: list[bytes], counts: np.ndarray | None = None):
        """words are distinct; last[i] is the node of words[i]."""
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        order = sorted(range(len(words)), key=words.__getitem__)
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        start = np.cumsum(size) - size
        self.last = np.zeros(len(words), dtype=np.int32)
        up, byte, made, self.levels = [np.zeros(1, np.int32)], [np.zeros(1, np.uint8)], 1, []
        alive, depth = np.array(order, dtype=np.int64)[size[order] > 0] if words else np.zeros(0, np.int64), 0
        while alive.size:
            at, b = self.last[alive], flat[start[alive] + depth]
            new = np.ones(len(alive), dtype=bool)
            new[1:] = (at[1:] != at[:-1]) | (b[1:] != b[:-1])
            up.append(at[new])
            byte.append(b[new])
            self.last[alive] = made - 1 + np.cumsum(new, dtype=np.int32)
            self.levels.append((made, made := made + int(new.sum())))
            depth += 1
            alive = alive[size[alive] > depth]
        self.up, self.byte = np.concatenate(up), np.concatenate(byte)
        self.best, self.tokens = np.zeros(made), np.zeros(made, dtype=np.int32)
        self.piece, self.back = np.full(made, -1, dtype=np.int32), np.zeros(made, dtype=np.int32)
        for lo, hi in self.levels:
            self._level(endings, lo, hi)
        self.count = np.zeros(made, dtype=np.int64)
        if counts is not None:
            self.count[self.last] = counts

    def __len__(self) -> int:
        return len(self.up)

    def _level(self, e: Endings, lo: int, hi: int) -> None:
        node = np.arange(lo, hi, dtype=np.int32)
        state, above = e.first[self.byte[lo:hi]], self.up[lo:hi]
        top, fewest = np.full(hi - lo, -np.inf), np.zeros(hi - lo, dtype=np.int32)
        while node.size:
            p = e.piece[state]
            hit = p >= 0
            n, a, p = node[hit] - lo, above[hit], p[hit]
            value, many = self.best[a] + e.score[p], self.tokens[a] + 1
            better = (value > top[n]) | ((value == top[n]) & (many < fewest[n]))
            n, a, p = n[better], a[better], p[better]
            top[n], fewest[n] = value[better], many[better]
            self.piece[lo + n], self.back[lo + n] = p, a
            on = above > 0
            state = e.longer(state[on], self.byte[above[on]])
            node, above = node[on], self.up[above[on]]
            on = state >= 0
            node, above, state = node[on], above[on], state[on]
        self.best[lo:hi], self.tokens[lo:hi] = top, fewest

    def piece_counts(self) -> np.ndarray:
        """How often each piece occurs in the best splits of all pre-tokens: counts are handed back from the ends to the root."""
        out, held = np.zeros(int(self.piece.max(initial=-1)) + 1, dtype=np.int64), self.count.copy()
        for lo, hi in reversed(self.levels):
            np.add.at(out, self.piece[lo:hi], held[lo:hi])
            np.add.at(held, self.back[lo:hi], held[lo:hi])
        return out


def _forward(model: Unigram, word: bytes) -> tuple[float, int]:
    """Best score and tokens of one long word, by the same rule as the trie's, with the last `longest` prefixes at hand."""
    score, longest, best = model.score, model.longest, [(0.0, 0)]
    for i in range(1, len(word) + 1):
        top = (-1e300, 0)
        for j in range(max(0, i - longest), i):
            if (piece := score.get(word[j:i])) is not None:
                s, n = best[j - i]
                top = max(top, (s + piece, n - 1))
        best.append(top)
        if len(best) > longest:
            del best[0]
    return best[-1][0], -best[-1][1]


def _chunks(text: str, split) -> list[str]:
    """A text as chunks whose pre-tokens do not depend on what stands around them (see _spelled).

    They are the runs between single spaces and line breaks where the text has no other white space; else its pre-tokens,
    from blocks that end before a space that follows a word.
    """
    chunks = single_spaced(text)
    if chunks is not None:
        chunks[0] = "\0" + chunks[0]
        return chunks
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + _BLOCK)
        while end < len(text) and not (text[end] == " " and not text[end - 1].isspace()):
            end += 1
        out += ["\0" + p for p in split(text[at:end])]
        at = end
    return out


def _spelled(chunk: str) -> str:
    """What a chunk stands for: it follows a space that is left out, unless it begins with its line break or is marked as whole."""
    return chunk[1:] if chunk[0] == "\0" else chunk if chunk[0] == "\n" else " " + chunk


class Known:
    """What is known of chunks, kept while a worker reads on: a chunk costs one lookup after its first sight.

    Beyond `room` chunks it is begun anew, which changes no count.
    """

    def __init__(self, model: Unigram, room: int):
        self.model, self.endings, self.room = model, Endings(model), room
        self.split = regex.compile(model.pattern).findall
        self.clear()

    def clear(self) -> None:
        self.places = Places()
        self.sums = np.zeros((0, 3))  # tokens, pre-tokens and score of each chunk

    def _learn(self, new: list[str]) -> np.ndarray:
        split, place = self.split, Places()
        found = [[f" {c}"] if c.isalpha() else split(_spelled(c)) for c in new]
        which = np.array(list(map(place.__getitem__, chain.from_iterable(found))), dtype=np.int64)
        each = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        words = [p.encode("utf-8", "surrogatepass") for p in place]
        short = [i for i, w in enumerate(words) if len(w) <= _LONG]
        trie = Trie(self.endings, [words[i] for i in short])
        of = np.ones((len(words), 3))
        of[short, 0], of[short, 2] = trie.tokens[trie.last], trie.best[trie.last]
        for i in (i for i, w in enumerate(words) if len(w) > _LONG):
            of[i, 2], of[i, 0] = _forward(self.model, words[i])
        return np.add.reduceat(of[which], np.cumsum(each) - each)

    def count(self, texts: list[str]) -> np.ndarray:
        """Rows (tokens, pre-tokens, score) of the texts."""
        if len(self.places) > self.room:
            self.clear()
        at = self.places.__getitem__
        ids = [np.array(list(map(at, _chunks(t, self.split))), dtype=np.int64) for t in texts]
        if self.places.new:
            self.sums = np.concatenate([self.sums, self._learn(self.places.new)])
            self.places.new = []
        return np.array([self.sums[x].sum(axis=0) for x in ids]).reshape(len(texts), 3)


_known: dict[str, Any] = {}  # of this worker process, so that later tasks find it


def _slices(column: pa.ChunkedArray | pa.Array) -> Iterator[list[str]]:
    """A column's texts (null: empty) in runs of about 8 MB."""
    lo, size = 0, 0
    n = column.cast(pa.large_binary()).fill_null(b"")
    lengths = np.diff(np.frombuffer(n.buffers()[1], dtype=np.int64)[n.offset : n.offset + len(n) + 1]) if len(n) else []
    for i, k in enumerate(lengths):
        size += int(k)
        if size >= _SLICE or i + 1 == len(lengths):
            yield [t or "" for t in column.slice(lo, i + 1 - lo).to_pylist()]
            lo, size = i + 1, 0


def count_tokens(docs: DataFrame, model: Unigram, text: str = "text", *, room: int = 400_000) -> DataFrame:
    """All rows of docs without the text, then n_tokens, n_pretokens (longs) and score, the log probability of the best split.

    A worker remembers chunks of text with their sums, `room` of them; the distinct pre-tokens of what is new go into one
    trie for each run of about 8 MB. Rows do not depend on each other: nothing is shuffled or gathered. Null and empty texts
    have 0 tokens and score 0. Texts are read whole. Columns of docs that are named n_tokens, n_pretokens or
    score are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the vocabulary, a public file of fixed size
    made = {"n_tokens": "bigint", "n_pretokens": "bigint", "score": "double"}
    others = [c for c in docs.columns if c != text and c.lower() not in made]
    rows = docs.select(text, *others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if shared.value is not _known.get("model"):
            _known["model"], _known["state"] = shared.value, Known(shared.value, room)
        state = _known["state"]
        for batch in batches:
            out = np.concatenate([np.zeros((0, 3)), *(state.count(texts) for texts in _slices(batch.column(0)))])
            more = [pa.array(out[:, 0].astype(np.int64)), pa.array(out[:, 1].astype(np.int64)), pa.array(out[:, 2].copy())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *more], [*batch.schema.names[1:], *made])

    return rows.mapInArrow(run, plus(docs.select(*others), made))


def piece_counts(docs: DataFrame, model: Unigram, text: str = "text") -> DataFrame:
    """Rows (piece, n): how often each piece of the vocabulary occurs in the best splits of all texts.

    Each run of texts puts its distinct pre-tokens into a trie with their counts at the ends, and the counts are handed back
    along the splits; runs are added up by one shuffle of at most a vocabulary of rows each. Null and empty texts add nothing.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        endings, split = Endings(shared.value), regex.compile(shared.value.pattern).findall
        for batch in batches:
            for texts in _slices(batch.column(0)):
                seen: Counter[str] = Counter()
                for chunk, times in Counter(chain.from_iterable(_chunks(t, split) for t in texts)).items():
                    for p in split(_spelled(chunk)):
                        seen[p] += times
                trie = Trie(endings, [p.encode("utf-8", "surrogatepass") for p in seen], np.fromiter(seen.values(), dtype=np.int64, count=len(seen)))
                n = trie.piece_counts()
                used = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([endings.pieces[i] for i in used], pa.binary()), pa.array(n[used])], ["piece", "n"])

    return docs.select(text).mapInArrow(run, "piece binary, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))


def op4_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    model = Unigram.from_ranks(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    found = count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    return found.withColumn("score", F.round("score", 6))


QUERIES = {"op4_token_counts": op4_token_counts}
ORACLES: dict[str, str] = {}
