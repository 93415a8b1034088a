"""The kept inverted index against brute force: ties, skipped blocks, refreshes, fields, another session's index."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lexiforge.operators import index as I
from lexiforge.operators import search as S


def weight(words, term):
    return words.count(term) * 2.2 / (words.count(term) + 1.2 * (0.25 + 0.75 * len(words) / 120))


def slow_topk(queries, docs, k):
    """queries and docs: id -> words."""
    df, out = {}, []
    for words in docs.values():
        for t in set(words):
            df[t] = df.get(t, 0) + 1
    for q, asked in queries.items():
        scores = []
        for d, words in docs.items():
            shared = [t for t in set(asked) if t in words]
            if shared:
                scores.append((-round(sum(weight(asked, t) * math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * weight(words, t) for t in sorted(shared)), 6), d))
        out += [(q, rank, d, -s) for rank, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def texts(rng, n, letters="abcdef", most=30):
    return {i: ["".join(rng.choice(letters) for _ in range(2)) for _ in range(rng.randint(0, most))] for i in range(n)}


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, " ".join(w) or None) for i, w in rows.items()], "id bigint, text string").repartition(parts)


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(I, "BLOCK_BITS", 3)


def found(index, spark, queries, k, **kw):
    asked = spark.createDataFrame([(f"q{q}", " ".join(w)) for q, w in queries.items()], "q string, t string")
    return sorted((r["q"], r["rank"], r["id"], r["score"]) for r in I.search_index(index, asked, k, "q", "t", "id", **kw).collect())


@pytest.mark.parametrize("bands", [1, 3])
def test_search_equals_brute_force_and_reads_no_text(spark, tmp_path, small_blocks, bands):
    rng = random.Random(7)
    docs, queries = texts(rng, 150), texts(rng, 12, most=6)
    docs |= {200 + i: docs[3] for i in range(40)}  # ties, more than a block of them
    source = str(tmp_path / "docs")
    frame(spark, docs).write.parquet(source)
    index = I.build_index(spark.read.parquet(source), str(tmp_path / "index"), "id", "text", bands=bands)
    assert index.n == 190
    (tmp_path / "docs").rename(tmp_path / "gone")  # what follows can't read a text
    queries[99] = docs[3]
    want = [(f"q{q}", *rest) for q, *rest in slow_topk(queries, docs, 5)]
    for kw in ({}, {"group": 3}, {"probe": 1}):
        got = found(index, spark, queries, 5, **kw)
        assert [r[:3] for r in got] == sorted(r[:3] for r in want) and all(abs(a[3] - b[3]) < 2e-6 for a, b in zip(got, sorted(want)))
    again = I.open_index(spark, str(tmp_path / "index"))
    spark.sql(f"DROP TABLE postings_{index.segments[0].path.rpartition('-')[2]}")  # as in a session that did not write it
    assert again == index and found(again, spark, queries, 5) == got


def test_blocks_that_cannot_reach_the_kth_score_are_skipped(spark, tmp_path, small_blocks):
    rng = random.Random(8)
    docs = texts(rng, 400, most=12)
    for i in range(5):
        docs[i] = ["zz", "zy", "zx", *docs[i][:2]]
    queries = {0: ["zz", "zy", "zx", "ab", "cd"], 1: ["zz", "ee"]}
    index = I.build_index(frame(spark, docs, 1), str(tmp_path / "index"), "id", "text", spread=False)
    stats = {}
    got = found(index, spark, queries, 3, stats=stats)
    assert [r[:3] for r in got] == sorted(r[:3] for r in ((f"q{q}", *rest) for q, *rest in slow_topk(queries, docs, 3)))
    assert stats["blocks"] > 40 and stats["scored"] * 4 < stats["blocks"]


def test_postings_are_bucketed_and_searched_without_an_exchange_of_them(spark, tmp_path):
    index = I.build_index(frame(spark, texts(random.Random(9), 50)), str(tmp_path / "index"), "id", "text")
    rows = index.segments[0].postings(spark)
    plan = rows.join(rows.groupBy("term", "band").count(), ["term", "band"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    assert {c: t for c, t in rows.dtypes} == {"term": "string", "band": "int", "block": "bigint", "n": "int", "top": "double", "offsets": "array<int>", "weights": "array<double>"}


def test_refresh_indexes_what_changed_only(spark, tmp_path, small_blocks):
    rng = random.Random(10)
    docs, queries = texts(rng, 60), texts(rng, 8, most=5)
    first = I.build_index(frame(spark, docs), str(tmp_path / "index"), "id", "text")
    now = dict(docs)
    now[3], now[900] = ["new", "words", "ab"], ["ab", "cd"]
    del now[7], now[8]
    index, added, removed = I.refresh_index(first, frame(spark, now), "id", "text")
    assert (added, removed, index.n, len(index.segments), index.generation) == (2, 3, 59, 2, 1)
    assert index.segments[1].documents(spark).count() == 2
    now[900] = ["cd"]
    later, added, removed = I.refresh_index(index, frame(spark, now), "id", "text")
    assert (added, removed, later.n) == (1, 1, 59)
    assert I.refresh_index(later, frame(spark, now), "id", "text") == (later, 0, 0) and I.open_index(spark, str(tmp_path / "index")) == later
    want = sorted((f"q{q}", *rest) for q, *rest in slow_topk(queries, now, 4))
    got = found(later, spark, queries, 4)
    assert [r[:3] for r in got] == [r[:3] for r in want] and all(abs(a[3] - b[3]) < 2e-6 for a, b in zip(got, want))
    old = sorted((f"q{q}", *rest) for q, *rest in slow_topk(queries, docs, 4))
    assert [r[:3] for r in found(first, spark, queries, 4)] == [r[:3] for r in old]  # readers of the first generation keep it


def test_fields_are_term_spaces_of_their_own(spark, tmp_path):
    rows = [(1, "river park", "city hall"), (2, "city", "river office"), (3, None, "park park"), (4, "", None)]
    docs = spark.createDataFrame(rows, "id bigint, title string, publisher string")
    index = I.build_index(docs, str(tmp_path / "index"), "id", "title", "publisher", by_field=True)
    asked = spark.createDataFrame([("a", "river"), ("b", "park"), ("c", "nothing")], "q string, t string")
    top = lambda *f: sorted((r["q"], r["rank"], r["id"]) for r in I.search_index(index, asked, 5, "q", "t", "id", fields=f).collect())
    assert top("title") == [("a", 1, 1), ("b", 1, 1)]
    assert top("publisher") == [("a", 1, 2), ("b", 1, 3)]
    both = I.build_index(docs, str(tmp_path / "joined"), "id", "title", "publisher")
    got = sorted((r["q"], r["id"]) for r in I.search_index(both, asked, 5, "q", "t", "id").collect())
    assert got == [("a", 1), ("a", 2), ("b", 1), ("b", 3)]


def test_empty_index_and_empty_queries(spark, tmp_path):
    none = I.build_index(frame(spark, {}, 1), str(tmp_path / "index"), "id", "text")
    assert none.n == 0 and found(none, spark, {0: ["ab"]}, 3) == []
    some = I.build_index(frame(spark, {1: ["ab"], 2: []}), str(tmp_path / "index"), "id", "text")
    assert some.generation == 1 and found(some, spark, {0: []}, 3) == [] and found(some, spark, {0: ["ab"]}, 3)[0][:3] == ("q0", 1, 1)
    assert I.open_index(spark, str(tmp_path / "nowhere")) is None


def test_the_catalog_of_a_hybrid_search_comes_from_the_index(spark, tmp_path):
    evidence = [("e1", "d1", 0, "Road repairs", "City"), ("e2", "d1", 1, "Road repairs", "City"), ("e3", "d2", 0, "School meals", "City"), ("e4", "d3", 0, "Roads and schools", None)]
    df = spark.createDataFrame(evidence, "point string, document string, pos int, title string, publisher string").withColumns({"kind": F.lit("body"), "quote": F.lit("")})
    catalog, index = I.build_catalog(df, str(tmp_path / "catalog"), "document", "point", "title", "publisher")
    assert {r["document"]: r["catalog_text"] for r in catalog.collect()} == {"d1": "Road repairs City", "d2": "School meals City", "d3": "Roads and schools"}
    asked = spark.createDataFrame([("q", "school road")], "q string, t string")
    ranks = I.catalog_ranks(index, asked, "q", "t", "document")
    assert [(r["rank"], r["document"]) for r in ranks.orderBy("rank").collect()] == [(1, "d1"), (2, "d2")]
    dense = spark.createDataFrame([("q", 1, "e4"), ("q", 2, "e3"), ("q", 3, "e1")], "q string, rank int, point string")
    rows = S.hybrid_search(dense, dense.limit(0), {}, "q", "point", df.select("point", "document", "pos", "kind", "quote"), catalog=ranks).orderBy("place").collect()
    assert [r["point"] for r in rows] == ["e1", "e3", "e4"] and dict(rows[0]["ranks"]) == {"dense": 3, "catalog": 1}
    more = df.where("document <> 'd2'").unionByName(df.where("document = 'd2'").withColumn("title", F.lit("Road closures")))
    _, fresh = I.build_catalog(more, str(tmp_path / "catalog"), "document", "point", "title", "publisher")
    assert fresh.generation == index.generation + 1 and fresh.segments[1].documents(spark).count() == 1


def test_queries_of_equal_terms_are_searched_once(spark, tmp_path, small_blocks):
    docs = texts(random.Random(9), 60)
    index = I.build_index(frame(spark, docs), str(tmp_path / "index"), "id", "text")
    one, many = {}, {}
    first = found(index, spark, {0: ["ab", "cd", "ab"]}, 4, stats=one)
    rest = found(index, spark, {i: ["ab", "ab", "cd"] if i % 2 else ["cd", "ab", "ab"] for i in range(30)}, 4, stats=many)
    assert many == one and first and rest == sorted((f"q{i}", *r[1:]) for i in range(30) for r in first)
