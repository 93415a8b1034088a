"""The pipeline's stages, alone and together."""

import random
from pathlib import Path

from pyspark.sql import functions as F
from test_llm_operators import DOCS, words

import corpus_pipeline
from lexiforge.llm import common, simhash
from lexiforge.store import discard, materialize, shared_dir


def test_stages(spark, tmp_path):
    rng = random.Random(21)
    bench = words(rng, 30)
    rows = [(i, "\n".join(words(rng, 25) for _ in range(4)), "xx", "s", 1) for i in range(40)]
    rows += [(100, rows[0][1], "xx", "s", 1), (101, "123 456", "xx", "s", 1), (102, words(rng, 40) + " " + bench + " " + words(rng, 10), "xx", "s", 1), (103, None, None, None, None)]
    d = str(tmp_path)
    spark.createDataFrame(rows, DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(0, bench)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, d).columns == docs.columns
        assert stage(spark, docs.limit(0), d).count() == 0
    out = corpus_pipeline.run(spark, d).collect()
    assert {r["doc_id"] for r in out} == set(range(40))
    assert sum(r["n_tokens"] for r in out) == 40 * 100


def test_near_dedup_keeps_one_of_each_group(spark, tmp_path):
    rng = random.Random(22)
    base = words(rng, 300)
    rows = [(5, base, "x", "s", 1), (3, base, "x", "s", 1), (9, base + " end", "x", "s", 1), (1, words(rng, 300), "x", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.near_dedup(spark, docs, str(tmp_path))
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 3]


def test_near_copies_go_although_line_dedup_leaves_their_changed_lines(spark, tmp_path):
    rng = random.Random(23)
    rows = []
    for i in range(20):
        lines = [words(rng, 30) for _ in range(12)]
        copy = list(lines)
        for k in rng.sample(range(12), 3):
            w = copy[k].split()
            w[rng.randrange(30)] = "changed"
            w[rng.randrange(30)] = "again"
            copy[k] = " ".join(w)
        rows += [(i, "\n".join(lines), "xx", "s", 1), (100 + i, "\n".join(copy), "xx", "s", 1)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = corpus_pipeline.line_dedup(spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, left, str(tmp_path)).collect()} == set(range(20))


def _tables(spark):
    return {p.name for p in Path(shared_dir(spark).removeprefix("file:"), "tables").glob("*")}


def test_stages_leave_no_table_but_what_their_results_read(spark, tmp_path):
    rng = random.Random(24)
    base = [words(rng, 80) for _ in range(12)]
    rows = [(i, t + "\n" + words(rng, 60), "xx", "s", 1) for i, t in enumerate(base + base[:4])] + [(50 + i, t + " end", "xx", "s", 1) for i, t in enumerate(base[:3])]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for stage in (corpus_pipeline.line_dedup, corpus_pipeline.near_dedup):
        before = _tables(spark)
        out = stage(spark, docs, str(tmp_path))
        left = _tables(spark) - before
        read = {f.split("/tables/")[1].split("/")[0] for f in out.inputFiles() if "/tables/" in f}
        assert left == read
        assert out.count()


def test_discard_spares_what_is_still_read(spark):
    one, two = materialize(spark.range(3), "one"), materialize(spark.range(4), "two")
    assert discard(one.unionByName(two), two) == 1
    assert two.count() == 4 and not {t for t in _tables(spark) if t.startswith("one-")}
    assert discard(two) == 1


def test_filter_of_ids_loses_none_and_leaves_most_others_out(spark):
    ids = spark.range(0, 40000).select(F.xxhash64("id").alias("x"))
    split = common.split_by(ids)
    here, not_here = split(ids, "x")
    assert (here.count(), not_here.count()) == (40000, 0)
    others = spark.range(1 << 20, (1 << 20) + 40000).select(F.xxhash64("id").alias("x"))
    here, not_here = split(others, "x")
    assert here.count() < 40000 / 8 and here.count() + not_here.count() == 40000
    assert common.split_by(ids.limit(0))(ids, "x")[1].count() == 40000


def test_texts_without_a_near_copy_are_not_moved(spark, tmp_path, monkeypatch):
    rng = random.Random(25)
    texts = [words(rng, 400) for _ in range(300)]
    rows = [(i, t, "x", "s", 1) for i, t in enumerate(texts)]
    rows += [(1000 + i, t, "x", "s", 1) for i, t in enumerate(texts[:5])] + [(2000 + i, t + " end", "x", "s", 1) for i, t in enumerate(texts[5:8])]
    rows += [(7, texts[7], "x", "s", 1), (None, texts[9], "x", "s", 1), (None, None, "x", "s", 1), (None, None, "x", "s", 1)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    split, cuts = simhash.split_by, []

    def spy(wanted):
        return lambda df, column: cuts.append(split(wanted)(df, column)) or cuts[-1]

    monkeypatch.setattr(simhash, "split_by", spy)
    out = simhash.keep_one(docs)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out.collect()) == [(False, i) for i in range(300)] + [(True, 0)]
    moved, stay = next(c for c in cuts if "text" in c[0].columns)
    assert moved.count() < 60 and moved.count() + stay.count() == docs.count()


def test_near_copies_among_what_line_dedup_has_left_go(spark, tmp_path):
    rng = random.Random(26)
    rows, lone, common = [], [], [words(rng, 25) for _ in range(200)]
    for i in range(10):
        text = words(rng, 240).split()
        wrapped = lambda n, text=text: [" ".join(text[k : k + n]) for k in range(0, len(text), n)]
        rows += [(i, "\n".join(common[10 * i : 10 * i + 10] + wrapped(30)), "xx", "s", 1), (100 + i, "\n".join(common[100 + 10 * i : 110 + 10 * i] + wrapped(80)), "xx", "s", 1)]
        lone += [(200 + i, "\n".join([common[10 * i], words(rng, 30)]), "xx", "s", 1)]
    holders = [(k - 20, "\n".join(common[10 * k : 10 * k + 10]), "xx", "s", 1) for k in range(20)]  # of the lines that go
    spark.createDataFrame(rows + lone + holders, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = corpus_pipeline.line_dedup(spark, docs, str(tmp_path))
    texts = {r["doc_id"]: r["text"].split() for r in left.collect()}
    assert all(texts[i] == texts[100 + i] for i in range(10))
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, left, str(tmp_path)).collect()}
    assert kept == set(range(-20, 10)) | set(range(200, 210))


def test_rows_without_a_whole_text_meet_whole_texts_too(spark):
    rng = random.Random(27)
    base, other = words(rng, 200), words(rng, 200)
    schema = "doc_id bigint, text string"
    whole = spark.createDataFrame([(1, base), (2, other), (4, base + " end"), (4, "y"), (7, words(rng, 50))], schema)
    left = spark.createDataFrame([(1, words(rng, 9)), (2, other), (4, base + " end"), (9, other + " end"), (7, words(rng, 9))], schema)
    assert {r["doc_id"] for r in simhash.keep_one(left, whole=whole).collect()} == {1, 2, 7}
