"""Periodic runs against a search of every lag of every text."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from lexiforge.llm import periodic


def slow_runs(words, min_length=6, min_exponent=4):
    n, out = len(words), []
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            stretch = words[i : j + q]
            smallest = next(r for r in range(1, q + 1) if all(stretch[k] == stretch[k + r] for k in range(len(stretch) - r)))
            if j > i and len(stretch) >= max(min_length, min_exponent * q) and smallest == q:
                out.append((i, len(stretch), q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic_text(rng, n, letters):
    words = [rng.choice(letters) for _ in range(n)]
    if n and rng.random() < 0.6:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randint(3, 10)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


@pytest.mark.parametrize(("length", "exponent"), [(6, 4), (6, 3), (20, 4), (2, 5)])
def test_runs_equal_brute_force(length, exponent):
    rng = random.Random(1)
    for _ in range(250):
        texts = [periodic_text(rng, rng.randint(0, 70), range(rng.choice([1, 2, 2, 3, 5]))) for _ in range(rng.randint(1, 4))]
        at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        want = sorted(((s + at[i], n, q) for i, t in enumerate(texts) for s, n, q in slow_runs(t, length, exponent)), key=lambda r: (r[0], r[2]))
        assert periodic.find_runs(np.array(sum(texts, []), dtype=np.int64), at.astype(np.int64), min_length=length, min_exponent=exponent) == want


def test_very_long_and_very_repetitive_texts():
    for words, want in ((np.zeros(200_000, dtype=np.int64), [(0, 200_000, 1)]), (np.arange(200_000) % 30_000, [(0, 200_000, 30_000)]), (np.arange(200_000), [])):
        assert periodic.find_runs(words, np.array([0, 200_000])) == want
    with pytest.raises(ValueError):
        periodic.find_runs(np.zeros(3, dtype=np.int64), np.array([0, 3]), min_exponent=2)


def slow_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = slow_runs(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    gone = {i for s, n_, q in runs for i in range(s + q, s + n_)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        len(runs), *(best or (None, None, None)), None if best is None else 1000 * best[1] // best[2],
        sha("".join(f"{s},{n_},{q}\n" for s, n_, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def test_query_equals_brute_force(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    rows = [(i, (" " if i % 3 else "\n").join(periodic_text(rng, rng.randint(0, 90), ["a", "b", "ö", "d"][: rng.randint(1, 4)]))) for i in range(150)]
    planted = [i for i in range(1000, 3000) if zlib.crc32(str(i).encode()) % 10 == 0][:20]
    rows += [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(rng.randint(1, 120)))) for i in planted]
    rows += [(5000, None), (5001, ""), (5002, " \t\n"), (5003, "a\x0ba\x0ca\ra a\ta"), (None, "x " * 20), (7, rows[7][1]), (5004, "a a a a a a a a a a a a"), (planted[0], None)]
    spark.createDataFrame([(i, t, "c", [1]) for i, t in rows], "doc_id bigint, text string, collapsed string, runs array<int>").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    columns = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    df = periodic.op12_periodic_runs(spark, str(tmp_path))
    assert df.columns == ["doc_id", *columns] and {t for c, t in df.dtypes if not c.endswith("sha256")} == {"bigint"}
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    got = sorted(((r["doc_id"], *(r[c] for c in columns)) for r in df.collect()), key=key)
    assert got == sorted(((i, *slow_row(i, t)) for i, t in rows), key=key)


def test_operator_keeps_columns_and_replaces_its_own(spark, monkeypatch):
    monkeypatch.setattr(periodic, "_BATCH_WORDS", 10)
    docs = spark.createDataFrame([("k", "a b a b a b a b c", 1, 2)], "name string, body string, runs int, collapsed int")
    out = periodic.periodic_runs(docs, "body")
    assert out.columns == ["name", "body", "runs", "collapsed"]
    r = out.first()
    assert [tuple(x) for x in r["runs"]] == [(0, 8, 2)] and r["collapsed"] == "a b c"
    assert periodic.periodic_runs(docs.limit(0), "body").count() == 0
    assert [list(x) for x in periodic._of_batch(["z z z z z z", None, "q " * 30, ""], 6, 4)] == [[[(0, 6, 1)], "z"], [[], ""], [[(0, 30, 1)], "q"], [[], ""]]
