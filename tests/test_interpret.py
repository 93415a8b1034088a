"""Question rules and replies."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lexiforge.operators import interpret as I


def test_interpret(spark):
    df = spark.createDataFrame([("q1", "Care este programul de lucru al DGTPCC din sectorul Botanica în 2024?", None), ("q2", "Где находится школа?", '{"language":"ru","requirements":[{"id":"r1","query":"adresa","kind":"contact"},{"id":"r2","query":"x","kind":"nope"}]}'), ("q3", "taxa locală", "{broken")], "id string, question string, m string")
    out = {r["id"]: r for r in I.interpret(df, "m").collect()}
    assert out["q1"]["language"] == "ro" and out["q1"]["answer_type"] == "hours" and out["q1"]["years"] == [2024] and out["q1"]["sectors"] == ["botanica"] and out["q1"]["acronyms"] == ["DGTPCC"]
    assert out["q2"]["language"] == "ru" and [r["query"] for r in out["q2"]["requirements"]] == ["adresa"]
    assert out["q3"]["yearly"] and [r["query"] for r in out["q3"]["requirements"]] == ["taxa locală"]
    q = spark.range(1).select(I.dense_query_text(F.lit("taxa"), F.lit(True), F.array().cast("array<int>"), F.lit(dt.date(2026, 9, 27))).alias("x"))
    assert q.first()["x"] == "taxa 2026"


def test_rules_for_each_requirement_and_category(spark):
    model = '{"category":"mobility","in_scope":false,"standalone":"Compară orarele din 2021","requirements":[{"question":"Care este programul de lucru?","query":"program de lucru","kind":"fact","category":"nope","yearly":true},{"query":"taxa","kind":"amount","answer_type":"amount","category":"services"},{"query":" ","kind":"fact"}]}'
    df = spark.createDataFrame([(1, "și cel vechi?", model), (2, "Unde este școala?", '{"category":"unheard of"}'), (3, "x", "broken")], "id int, question string, m string")
    out = {r["id"]: r for r in I.interpret(df, "m").collect()}
    a = out[1]
    assert (a["category"], a["historical"], a["multiple_projects"], a["in_scope"], a["multi_intent"]) == ("mobility", True, True, False, True)
    assert [tuple(r) for r in a["requirements"]] == [("R1", "Care este programul de lucru?", "program de lucru", "fact", "hours", True, "none"), ("R2", "taxa", "taxa", "amount", "amount", False, "services")]
    b = out[2]
    assert (b["category"], b["historical"], b["multiple_projects"], b["in_scope"], b["multi_intent"]) == ("none", False, False, True, False)
    assert b["requirements"][0]["id"] == "R1" and b["requirements"][0]["question"] == "Unde este școala?" and out[3]["requirements"][0]["query"] == "x"


def test_answer_types_and_yearly_topics(spark):
    rows = [("vreau sa aflu despre legislatiile cum sa dau copilul la scoala", "procedure", "legal_act"), ("Care este programul de lucru al DGTPCC?", "other", "hours"), ("Какой график работы?", "other", "hours"), ("Cât costă parcarea?", "amount", "amount"), ("Ce este?", "nonsense", "other")]
    got = spark.createDataFrame(rows, "q string, h string, w string").select("w", I.answer_type("q", F.col("h")).alias("t")).collect()
    assert all(r["w"] == r["t"] for r in got)
    yearly = {"cum sa dau copilul meu la scoala": True, "Înscrierea în clasa I": True, "Care sunt impozitele locale?": True, "Ce lucrări s-au făcut pe strada Vasile Alecsandri?": False}
    got = spark.createDataFrame([(q,) for q in yearly], "q string").select("q", I.is_yearly("q").alias("y")).collect()
    assert {r["q"]: r["y"] for r in got} == yearly
    assert spark.range(1).select(I.is_yearly(F.lit("Programul de burse"), F.lit(True)).alias("y")).first()["y"]


@pytest.mark.parametrize(("reply", "want"), [("al doilea", "Ordin 278 · detsriscani.md"), ("Вторая!", "Ordin 278 · detsriscani.md"), ("vreau ordin 278 · detsriscani.md", "Ordin 278 · detsriscani.md"), ("2", "Ordin 278 · detsriscani.md"), ("Ordin 278 · detsriscani.md", "Ordin 278 · detsriscani.md"), ("hotărârea nr. 5", "Hotărârea nr. 5 · primaria.md"), ("7", None), ("altceva", None)])
def test_followups(spark, reply, want):
    labels = F.array(F.lit("Hotărârea nr. 5 · primaria.md"), F.lit("Ordin 278 · detsriscani.md"))
    assert spark.createDataFrame([(reply,)], "r string").select(I.resolve_followup(F.col("r"), labels).alias("x")).first()["x"] == want


def test_replies(spark):
    rows = ['{"status":"OK","answer":"da","extra":1,"citations":[{"id":"S1"}]}', '{"status":"NEEDS_CLARIFICATION","answer":"Care?","choices":[{"label":"A"},{"label":"B"}]}', "{broken"]
    out = [r["r"] for r in spark.createDataFrame(list(enumerate(rows)), "i int, j string").orderBy("i").select(I.parse_reply(F.col("j")).alias("r")).collect()]
    assert out[0]["outdated"] is False and out[0]["citations"][0]["outdated"] is False and out[1]["answer"] == "Care?\n- A\n- B" and out[2]["status"] is None
    assert spark.range(1).select(I.is_unanswered(F.lit("Nu am găsit informații")).alias("x")).first()["x"]
    says = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert "none of them contains the working hours." in says(I.not_found_note(F.lit("EVIDENCE_LACKS_VALUE"), F.lit("en"), F.lit("hours")))
    assert says(I.not_found_note(F.lit("?"), F.lit("xx"))).startswith("Nu am găsit în documentele")
    cites = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(d).cast("date").alias("published"), F.lit(o).alias("outdated")) for i, d, o in (("S1", "2023-02-01", True), ("S2", "2026-01-01", False), ("S3", "2021-05-05", True))])
    assert says(I.outdated_note(F.lit("en"), cites)) == "Note: the sources found date from 2021, 2023 and may be out of date. [S1] [S3]"
    assert says(I.clarification(F.lit("ru"))).startswith("Найдено несколько")


def test_topics_and_models(spark):
    q = [("p1", 1, "Când vine autobuzul la Botanica?"), ("p1", 2, "Și troleibuzul? Ce lucrări de drum sunt?"), ("p2", 1, "parcuri verzi curate"), ("p2", 2, "de la 3 la 5"), ("p2", 3, "Linii noi; linii vechi, alte linii, foarte bune"), ("p2", 4, "PARCURI verzi curate"), ("p3", 1, "вопрос"), ("p4", 1, "где школа в секторе Чеканы или Ботаника?"), ("p5", 1, "apa la Ciocana")]
    q = spark.createDataFrame(q, "p string, n int, t string")
    rows = lambda df: sorted((r["p"], r["rank"], r["label"], r["query"]) for r in df.collect())
    transport, roads = (f"transport public rute troleibuz autobuz orar circulație sectorul Botanica", "reparație străzi drumuri trafic rutier suspendare circulație sectorul Botanica")
    known = [("p1", 1, "Transport public – sectorul Botanica", transport), ("p1", 2, "Lucrări la drumuri și trafic – sectorul Botanica", roads)]
    words = [("p2", 1, "Parcuri verzi curate", "parcuri verzi curate"), ("p2", 2, "Linii linii vechi alte linii", "Linii linii vechi alte linii")]
    school = [("p4", 1, "Școli și grădinițe", "școli grădinițe educație înscriere elevi instituții de învățământ")]
    water = [("p5", 1, "Apă și canalizare – sectorul Ciocana", "apă potabilă canalizare deconectare apă Apă-Canal sectorul Ciocana")]
    assert rows(I.extract_topics(q, "p", "t", "n")) == known + words + school + water
    had = spark.createDataFrame([("p1", " transport  PUBLIC – sectorul botanica"), ("p5", "apă și canalizare – sectorul ciocana")], "p string, label string")
    assert rows(I.extract_topics(q.where("p in ('p1', 'p5')"), "p", "t", "n", existing=had)) == [("p1", 1, *known[1][2:])]
    model = spark.createDataFrame([("p1", '{"topics": [{"label": "Orar", "query": ""}, {"label": " ", "query": "x"}, {"label": "orar", "query": "y"}]}'), ("p2", '{"topics": []}'), ("p4", "no json"), ("p5", '{"other": 1}')], "p string, output string")
    assert rows(I.topics_of(q, "p", "t", "n", model)) == [("p1", 1, "Orar", "Orar"), *school, *water] and rows(I.topics_of(q, "p", "t", "n")) == rows(I.extract_topics(q, "p", "t", "n"))
    e = I.embed(spark.createDataFrame([(1, "ab"), (2, "c")], "k int, t string"), "k", "t", lambda ts: [[float(len(t)), 1.0] for t in ts])
    assert {r["k"]: r["embedding"] for r in e.collect()} == {1: [2.0, 1.0], 2: [1.0, 1.0]}
    c = spark.createDataFrame([("a", 0.1), ("b", 0.2)], "id string, score double")
    s = spark.createDataFrame([("a", 0.9), ("b", 7.0)], "id string, score double")
    assert {r["id"]: r["score"] for r in I.rerank(c, s, ["id"]).collect()} == {"a": 0.9, "b": 0.2}


def test_labels_begin_with_one_capital(spark):
    duckdb = pytest.importorskip("duckdb")
    from lexiforge.functions import text as T

    letters = [chr(c) for c in range(0x21, 0x10000) if chr(c).isalpha() and chr(c) not in "ƛɤ"]  # the capitals of these two are newer than DuckDB's tables
    got = {r["c"]: r["u"] for r in spark.createDataFrame([(c,) for c in letters], "c string").select("c", T.capitalized(F.concat("c", F.lit("x"))).alias("u")).collect()}
    con = duckdb.connect()
    want = con.execute("SELECT c, upper(c) || 'x' FROM (SELECT unnest(?) AS c)", [letters]).fetchall()
    assert [(c, u, got[c]) for c, u in want if got[c] != u] == []
    q = spark.createDataFrame([(1, 1, "ßer dieengeheitpf")], "conv int, turn int, q string")
    assert [r["label"] for r in I.extract_topics(q, "conv", "q", "turn").collect()] == ["ẞer dieengeheitpf"]
