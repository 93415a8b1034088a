"""Every query of the engine's own operators against its SQL on the smallest tables."""

import glob
import os

import pytest

SF = "/root/testdata/sf0.001"


def text(v):
    return "null" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_queries_equal_their_sql(spark):
    import duckdb

    from lexiforge.plans.registry import ORACLES, QUERIES

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    wrong = []
    for name in sorted(ORACLES):
        df = QUERIES[name](spark, SF)
        cols = sorted(df.columns)
        want = con.sql(ORACLES[name])
        at = [want.columns.index(c) for c in cols]
        got = sorted(tuple(text(r[c]) for c in cols) for r in df.collect())
        if sorted(want.columns) != cols or got != sorted(tuple(text(r[i]) for i in at) for r in want.fetchall()):
            wrong.append(name)
    assert not wrong


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_jaccard_reads_the_documents_once(spark):
    from lexiforge.plans.registry import QUERIES

    plan = QUERIES["q_jaccard"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [doc_id") == 1


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", ["q_claim_issues", "q_answers"])
def test_the_lines_of_orders_are_made_once(spark, name):
    from lexiforge.plans.registry import QUERIES

    assert "l_shipdate" not in _plan(QUERIES[name](spark, SF))  # no plan of the result reads lineitem again


def test_verified_claims_are_checked_once(spark):
    from lexiforge.operators import claims as C

    claims = spark.createDataFrame([("q", 1, "Costă 5 lei.", "Cât?", ["e"]), ("q", 2, "Costă 6 lei.", "Cât?", ["e"]), ("q", 3, "Costă 5 lei.", "Cât?", ["e"])], "question_id string, claim_no int, text string, question string, evidence_ids array<string>")
    evidence = spark.createDataFrame([("q", "e", "Prețul este de 5 lei.", "d")], "question_id string, evidence_id string, quote string, document_id string")
    verdicts = spark.createDataFrame([("q", 1, True, None), ("q", 2, True, None)], "question_id string, claim_no int, supported boolean, reason string")
    good, bad = C.verify(claims, evidence, verdicts)
    assert "Join" not in _plan(good) + _plan(bad) and good.columns == claims.columns
    assert [r["claim_no"] for r in good.collect()] == [1] and {r["claim_no"]: r["reasons"] for r in bad.collect()} == {2: ["UNSUPPORTED_NUMBER:6"], 3: ["NO_VERDICT"]}


def test_topics_are_read_from_whole_texts(spark, tmp_path):
    from lexiforge.plans.registry import QUERIES

    before = "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore. "
    rows = [(1, 0, "user", before + "Orarul troleibuzelor"), (2, 1, "user", before + "и на русском"), (2, 3, "assistant", "spital")]
    spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["q_topics"](spark, str(tmp_path)).collect()
    assert [(r["conv_id"], r["label"], r["rank"]) for r in got] == [(1, "Transport public", 1)]  # a text with Cyrillic letters gives no words
