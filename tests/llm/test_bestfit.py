"""Best-fit packing against sequential best fit decreasing and the tokenizer itself."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lexiforge.llm import bestfit

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def slow_best_fit_decreasing(lengths, max_len):
    """One document after the other, the longest first, each to the smallest gap that holds it."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(max_len - n)
    return len(gaps)


def check_places(rows, max_len):
    """Every document once, sequences full from 0 on without gap or overlap; the number of sequences."""
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= max_len
    return len(by)


@pytest.mark.parametrize(
    "make",
    [
        lambda rng: rng.integers(1, 64, 700),
        lambda rng: rng.integers(1, 4, 700),
        lambda rng: rng.integers(14, 26, 400),
        lambda rng: np.concatenate([np.full(300, 20), rng.integers(1, 64, 300)]),
        lambda rng: np.minimum(63, rng.geometric(0.08, 700)),
        lambda rng: np.full(500, 7),
        lambda rng: np.array([63]),
        lambda rng: np.array([], dtype=int),
    ],
)
def test_as_few_sequences_as_sequential_best_fit(spark, make):
    lengths = make(np.random.default_rng(4)).tolist()
    df = spark.createDataFrame([(i * 10, n) for i, n in enumerate(lengths)], "row bigint, length int").repartition(3)
    got = bestfit.best_fit(df, 64).join(df, "row").collect()
    assert sorted(r["row"] for r in got) == [i * 10 for i in range(len(lengths))]
    want = slow_best_fit_decreasing(lengths, 64)
    assert check_places(got, 64) <= want + want // 100 + 1


def test_sweep_gives_every_gap_once_and_every_document_at_most_once():
    rng = np.random.default_rng(5)
    for _ in range(200):
        docs, gaps = rng.integers(0, 5, 33) * rng.integers(0, 2, 33), rng.integers(0, 4, 33) * rng.integers(0, 2, 33)
        docs[[0, 32]], gaps[[0, 32]] = 0, 0
        taken = rng.integers(0, 9, 33)
        found, left, opened = bestfit.sweep(docs, gaps, taken, 32)
        size_at = np.concatenate([np.repeat(np.arange(33), gaps), np.full(opened, 32)])
        assert (found.start[1:] >= found.stop[:-1]).all() and (found.stop <= len(size_at)).all()
        given = np.zeros_like(docs)
        for start, stop, size, first, take, n in zip(*found, strict=True):
            assert (size_at[start:stop] // size == take).all() and (stop - start - 1) * take < n <= (stop - start) * take
            assert first == taken[size] + given[size]
            given[size] += n
        assert (given + left == docs).all() and (not docs.any() or given.any() or gaps.any())


def test_pack_cuts_long_texts_and_keeps_every_id(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    rng = np.random.default_rng(6)
    text = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))
    rows = [(i, text(int(rng.integers(1, 60))), 1) for i in range(60)]
    rows += [(100, text(900), 1), (101, None, 1), (102, "", 1), (103, " \n\t ", 1), (None, "no id", 1), (5, rows[5][1], 1), (5, rows[5][1], 1), (104, "ünï 😀" * 40, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, row bigint").repartition(3)
    out = bestfit.pack(docs, TOKENIZER, max_len=128).collect()
    check_places(out, 128)
    want = sorted((-1 if i is None else i, tokenizer.encode(t or "", add_special_tokens=False).ids + [2]) for i, t, _ in rows)
    got, by = [], {}
    for r in out:
        ids = np.frombuffer(r["ids"], dtype="uint16").tolist()
        assert len(ids) == r["length"] and (r["piece"] == 0 or r["length"] == 128)
        by.setdefault(-1 if r["doc_id"] is None else r["doc_id"], []).append((r["piece"], r["start"], ids))
    for i, parts in by.items():
        same = 3 if i == 5 else 1
        parts = sorted(parts)[::same]
        assert [p[1] for p in parts] == list(np.cumsum([0, *(len(p[2]) for p in parts[:-1])]))
        got += [(i, [x for p in parts for x in p[2]])] * same
    assert sorted(got) == want
    assert bestfit.pack(docs.limit(0), TOKENIZER).count() == 0


def test_lengths_out_of_range_are_refused(spark):
    with pytest.raises(ValueError):
        bestfit.best_fit(spark.createDataFrame([(1, 64)], "row bigint, length int"), 64)


def test_query(spark, tmp_path):
    spark.createDataFrame([(1, "one two", "x", 5), (2, "word " * 3000, "x", 5), (3, None, "x", 5)], "doc_id bigint, text string, ids string, length bigint").write.parquet(f"{tmp_path}/documents.parquet")
    df = bestfit.op13_best_fit(spark, str(tmp_path))
    assert dict(df.dtypes) == {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"}
    out = df.collect()
    assert check_places(out, 1024) == 3 and df.where(F.col("doc_id") == 3).first()["ids_crc32"] == zlib.crc32(b"\x02\0\0\0")
