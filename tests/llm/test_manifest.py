"""Merkle manifests against trees built by hand."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lexiforge.llm import manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def slow_tree(leaves, arity):
    """The root and each leaf's siblings, (before, after) a level."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        runs = [level[i : i + arity] for i in range(0, len(level), arity)]
        for k, i in enumerate(at):
            paths[k].append(("".join(runs[i // arity][: i % arity]), "".join(runs[i // arity][i % arity + 1 :])))
        at, level = [i // arity for i in at], [sha("".join(r)) for r in runs]
    return level[0], paths


def slow_manifest(rows, arity):
    """rows: (group, key, leaf); per row (group, key, leaf, subroot, path) and the root."""
    groups = sorted({r[0] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    low = {}
    for g in groups:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        low[g] = own, *slow_tree([r[2] for r in own], arity)
    root, high = slow_tree([low[g][1] for g in groups], arity)
    return [(*r, low[g][1], path + high[k]) for k, g in enumerate(groups) for r, path in zip(low[g][0], low[g][2], strict=True)], root


@pytest.mark.parametrize("arity", [2, 3, 16])
def test_trees_equal_those_built_by_hand(spark, arity):
    rng = random.Random(arity)
    rows = [(None if g == 0 else f"s{g}é", i, sha(f"{g} {i}")) for g, n in enumerate([1, 2, 16, 17, 40, 1, 5]) for i in rng.sample(range(100), n)]
    rows += [("hot", i // 2, sha(str(i % 7))) for i in range(150)] + [("hot", None, sha("n"))] * 2 + [("S", 1, sha("x"))]
    df = spark.createDataFrame([(*r, "kept") for r in rows], "source string, doc_id bigint, leaf string, path string").repartition(5)
    got = manifest.manifest(df, arity=arity)
    want, root = slow_manifest(rows, arity)
    assert got.root == root and got.trees.count() == len({r[0] for r in rows})
    out = got.rows.select("source", "doc_id", "leaf", "subroot", manifest.proof(F.col("path")), manifest.folded(F.col("leaf"), F.col("path"))).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, out), key=key) == sorted(((*r[:4], sha("".join(a + b for a, b in r[4])), root) for r in want), key=key)


def test_one_row_and_no_row(spark):
    df = spark.createDataFrame([("s", 1, sha("x"))], "source string, doc_id bigint, leaf string")
    one = manifest.manifest(df)
    r = one.rows.first()
    assert one.root == r["subroot"] == sha("x") and r["path"] == []
    none = manifest.manifest(df.limit(0))
    assert none.root is None and none.rows.count() == 0 and none.trees.count() == 0


def slow_leaf(row, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)))


def test_query_finds_tampering(spark, tmp_path):
    rng = random.Random(9)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = [(i, "".join(rng.choice("ABcdÉé 😀:\n") for _ in range(rng.randint(0, 9))), rng.choice(["en", None]), rng.choice(["s1", "s2", "", None]), i) for i in range(90)]
    rows += [(200, None, None, None, None), (None, "NULL", "x", "s1", 4), (4, rows[4][1], *rows[4][2:])]
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, leaf string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    df = manifest.op11_manifest(spark, str(tmp_path))
    assert [c for c, _ in df.dtypes] == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] and dict(df.dtypes)["verified"] == "boolean"
    tampered = {}
    for r in rows:
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None
        tampered[r[0], slow_leaf(r, r[1])] = slow_leaf(r, r[1].translate(lower) if hit else r[1])
    want, root = slow_manifest([(r[3], r[0], slow_leaf(r, r[1])) for r in rows], 16)
    expected = []
    for _, i, leaf, subroot, path in want:
        h = tampered[i, leaf]
        for a, b in path:
            h = sha(a + h + b)
        expected.append((i, leaf, subroot, root, sha("".join(a + b for a, b in path)), h, h == root))
    key = lambda r: tuple(map(str, r))
    out = sorted(map(tuple, df.collect()), key=key)
    assert out == sorted(expected, key=key) and {r[-1] for r in out} == {True, False}
