"""What a task holds at once does not grow with the rows of an Arrow batch."""

from __future__ import annotations

import tracemalloc
from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from lexiforge.functions.lots import lots


def _peak_mb(rows: Iterator[pa.RecordBatch]) -> float:
    """MB of Python objects and numpy arrays held at most while rows are made and dropped."""
    tracemalloc.start()
    try:
        for _ in rows:
            pass
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_lots_are_the_batch_in_order_and_bounded():
    texts = ["a" * n for n in (3, 0, 4, 20, 1, 1)] + [None, "bé"]
    words = [["x"] * n for n in (1, 9, 0, 2, 0, 0, 5, 1)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(words, pa.list_(pa.string()))], ["t", "w"]).slice(1)
    for size in (1, 5, 8, 100):
        for columns in ((0,), (1,), (0, 1)):
            got = list(lots(batch, size, *columns))
            assert [r for lot in got for r in lot.to_pylist()] == batch.to_pylist()
            for lot in got:
                many = sum(len((r["t"] or "").encode()) * (0 in columns) + len(r["w"]) * (1 in columns) for r in lot.to_pylist())
                assert many <= size or lot.num_rows == 1
    assert list(lots(batch.slice(0, 0), 5, 0)) == []


def _lines(n: int, length: int) -> list[str]:
    letters = np.random.default_rng(3).integers(97, 123, (n, length), dtype=np.uint8)
    return [bytes(row).decode() for row in letters]


def test_line_texts_hold_a_lot_and_give_each_line_once_a_batch():
    from lexiforge.llm.linededup import _texts, line_id

    lines = _lines(12_000, 1_000)
    texts = pa.array(["\n".join(lines[i : i + 4]) for i in range(0, len(lines), 4)] + [lines[0]])
    run = _texts(1 << 19)(SimpleNamespace(value=b"\xff" * (1 << 16)))
    batch = pa.RecordBatch.from_arrays([texts], ["text"])
    assert _peak_mb(run(iter([batch]))) < 10  # of 12 MB of text
    got = [(r["line"], r["text"]) for b in run(iter([batch])) for r in b.to_pylist()]
    assert got == [(line_id(x), x) for x in lines]


def test_verified_pairs_are_taken_in_lots():
    from lexiforge.llm.linededup import Shape, _verify

    lines = _lines(10_000, 300)
    near = [x[:-2] + "??" if i % 2 else x[::-1] for i, x in enumerate(lines)]
    ids = pa.array(range(len(lines)))
    batch = pa.RecordBatch.from_arrays([ids, ids, pa.array(lines), pa.array(near)], ["a", "b", "text_a", "text_b"])
    assert _peak_mb(_verify(Shape())(iter([batch]))) < 60
    assert [r["a"] for b in _verify(Shape())(iter([batch])) for r in b.to_pylist()] == list(range(1, len(lines), 2))


def test_an_index_build_counts_words_in_lots(monkeypatch):
    from lexiforge.operators import index as I

    monkeypatch.setattr(I, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 2)))
    said = [[f"w{(i * j) % 997}" for j in range(300)] for i in range(3_000)] + [None, []]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(said))), pa.array(["h"] * len(said)), pa.array(said, pa.list_(pa.string()))], ["key", "hash", "words"])
    del said
    assert _peak_mb(I._counted(1)(iter([batch]))) < 40  # all words together are over 60 MB of strings
    whole, parts = ([r for b in I._counted(1, words)(iter([batch])) for r in b.to_pylist()] for words in (1 << 40, 700))
    assert whole == parts and whole[5]["row"] == (1 << I._SEGMENT) + (2 << I._PART) + 5


def test_dense_queries_meet_vectors_a_few_at_a_time():
    from lexiforge.operators.search import _best_of

    rng = np.random.default_rng(5)
    x, ids, m = rng.integers(-3, 4, (1_500, 8)).astype(np.float64), np.arange(4_096), rng.integers(-3, 4, (4_096, 8)).astype(np.float64) + 0.5
    x[7] = 0  # scores nothing
    m /= np.linalg.norm(m, axis=1)[:, None]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(x))), pa.array(list(x), pa.list_(pa.float64()))], ["k", "v"])
    assert _peak_mb(_best_of(iter([b]), ids, m, 20, ["q", "k", "score"]) for b in [batch]) < 30
    got = _best_of(iter([batch.slice(0, 700), batch.slice(700)]), ids, m, 20, ["q", "k", "score"])
    keys = np.delete(np.arange(len(x)), 7)
    s = np.round(m @ (x[keys] / np.linalg.norm(x[keys], axis=1)[:, None]).T, 9)
    order = np.lexsort((np.broadcast_to(keys, s.shape), -s), axis=1)[:, :20]
    assert got.column("q").to_pylist() == np.repeat(ids, 20).tolist()
    assert np.array_equal(got.column("k").to_numpy().reshape(-1, 20), keys[order])
