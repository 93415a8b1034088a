"""Operators on literal fixtures and their properties."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from lexiforge.functions import text as T
from lexiforge.functions import packs
from lexiforge.functions.packs import RO_SUFFIXES
from lexiforge.operators import alerts as A
from lexiforge.operators import claims as C
from lexiforge.operators import corpus as P
from lexiforge.operators import evaluation as V
from lexiforge.operators import facts as K
from lexiforge.operators import index as I
from lexiforge.operators import relational as R
from lexiforge.operators import rules as U
from lexiforge.operators import search as S
from lexiforge.operators import validation as Q
from lexiforge.operators.components import connected_components
from lexiforge.operators.similarity import merge_duplicates, similar_sets
from lexiforge.sources import artifacts, feeds, pages
from lexiforge.streaming import streams as X


def one(spark, column, **values):
    """The value of a column expression over one row."""
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'array<string>' if isinstance(v, list) else 'int'}" for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


# ---------------------------------------------------------------- text


def test_ids(spark):
    import hashlib
    import uuid

    assert one(spark, T.stable_id("p", "a", "b"), a="x", b="ș") == "p-" + hashlib.sha256("x\u001fș".encode()).hexdigest()[:16]
    assert one(spark, T.uuid5(str(uuid.NAMESPACE_URL), "a"), a="point/ș") == str(uuid.uuid5(uuid.NAMESPACE_URL, "point/ș"))


@pytest.mark.parametrize(
    ("f", "text", "want"),
    [
        (T.fold, "Şcoală Școală ŢARĂ țara Ёлка йод", "scoala scoala tara tara елка иод"),
        (T.safe_slug, "Ordin nr. 5 / Școli!", "ordin-nr.-5-scoli"),
        (T.safe_slug, "***", "item"),
        (T.normalize_search_text, " a  b \n\n\t\n c ", "a b\nc"),
        (T.estimate_tokens, "", 1),
        (T.estimate_tokens, "Unu, doi.", 5),
        (T.is_heading, "HOTĂRÂRE NR 5", True),
        (T.is_heading, "Text normal", False),
        (T.block_type, "## Worksheet", "heading"),
        (T.block_type, "## Worksheet\nBudget municipal\nVenituri 1000 lei", "paragraph"),
        (T.block_type, "- a\n- b", "list"),
        (T.block_type, "Festival\nLocația: Parc\nPerioada: 1-2.09.2026", "municipal_event"),
        (T.years_in, "investiții 2024–2026", [2024, 2025, 2026]),
        (T.years_in, "1850 și 20261", []),
        (T.acronyms, "DGTPCC și DGETS, nu AB", ["DGTPCC", "DGETS"]),
        (T.street_keys, "pe str. Vasile Alecsandri", ["alecsandri"]),
        (T.valid_url, "ftp://x", False),
        (T.file_key, "https://a.md/files/Hot%C4%83r%C3%A2re.PDF?x=1", "hotarare.pdf"),
        (T.is_file_title, "anexa 1.pdf", False),
        (T.is_file_title, "anexa1.pdf", True),
        (T.normalize_label, "  Ordin-278: Școli ", "ordin 278 scoli"),
        (T.markers, "a [S1] b [S12][S1]", ["S1", "S12", "S1"]),
        (T.speech_text, "**A** [link](http://x) [S1] http://y z", "A link z"),
        (T.parse_iso_date, "2026-02-30", None),
        (T.parse_iso_date, "2026-02-28T10:00", dt.date(2026, 2, 28)),
        (T.split_sentences, "Conform art. 5 se aplică. Vezi str. Mare 3. Gata! Da", ["Conform art. 5 se aplică.", "Vezi str. Mare 3. Gata!", "Da"]),
    ],
)
def test_text(spark, f, text, want):
    assert one(spark, f("t"), t=text) == want


def test_clip_and_stems(spark):
    assert one(spark, T.clip("t", 20), t="unu doi trei, patru cinci") == "unu doi trei…"
    assert one(spark, T.clip("t", 20), t="scurt") == "scurt"
    assert one(spark, T.tokenize_stem("t", RO_SUFFIXES), t="școlilor casele drumurilor investiții copii 2024 x") == ["școl", "case", "drum", "investiț", "copi"]
    assert one(spark, T.keywords("t"), t="Înscrierea pentru grădinițe 2024 înscrierea Botanica2 школы в Кишиневе") == ["inscrie", "gradini", "botanic", "школы"]
    assert one(spark, T.normalize_search_text("t"), t="s\u0326coala\u00a0 nr.\u202f5  \n\n  a ") == "școala nr. 5\na"


def test_question_rules(spark):
    lang = lambda t, hint=None: one(spark, T.detect_language("t", F.lit(hint).cast("string"), known=packs.LANGUAGES), t=t)
    assert lang("vreau sa aflu cum sa dau copilul la scoala") == "ro" and lang("Какой график работы примэрии?") == "ru"
    assert lang("What are the working hours of the city hall?") == "en"
    assert lang("How much did the football pitch works at the Liviu Deleanu lyceum in Chișinău cost?") == "en"
    assert lang("DGTPCC?", "en") == "en" and lang("DGTPCC?", "xx") == "ro" and lang("DGTPCC?") == "ro"
    assert one(spark, T.sectors_in("t"), t="în sectorul Centru și la Botanica") == ["botanica", "centru"]
    assert one(spark, T.sectors_in("t"), t="în centru") == [] and one(spark, T.sectors_in("t", explicit_only=True), t="la Botanica") == []
    assert one(spark, T.street_keys("t", F.array(F.lit("Strada Mihai Eminescu"))), t="pe str. Vasile Alecsandri din Chișinău") == ["eminescu", "alecsandri"]
    assert one(spark, T.acronyms("t"), t="DGTPCC, ANEXA și SRL, NOTA, XXI, CNAS") == ["DGTPCC", "CNAS"]


def test_titles_and_labels(spark):
    subject = lambda t, u="": one(spark, T.readable_subject(F.col("t"), F.lit(u)), t=t)
    assert subject("ORDINUL nr. 278 din 12.03.2026 cu privire la înscrierea copiilor") == "Ordinul nr. 278 — înscrierea copiilor"
    assert subject("12/3 din 01.02.2026 — cu privire la buget") == "Nr. 12/3 — buget"
    assert subject("Vezi detalii", "https://a.md/files/20260101_plan-de-actiuni.pdf") == "Plan de actiuni"
    assert subject("Lista actelor necesare") == "Lista actelor necesare"
    label = one(spark, T.choice_label(F.col("t"), F.lit("primaria.md"), F.lit("2026-03-01"), detail=F.lit("Program de lucru")), t="Anunț")
    assert label == "Anunț: Program de lucru · primaria.md · 01.03.2026"
    assert len(one(spark, T.choice_label(F.col("t"), F.lit("primaria.md"), F.lit("2026-03-01")), t="cuvânt " * 60)) <= 110
    assert one(spark, T.clean_title("t"), t="Reparații  pe strada Mare - Primăria Municipiului Chișinău") == "Reparații pe strada Mare"
    assert one(spark, T.title_noise("t"), t="Anexa nr. 5") and not one(spark, T.title_noise("t"), t="Reparații pe strada Mare")
    assert one(spark, T.clean_text("t", F.lit("Un titlu")), t="# Un titlu\n\n**text** cu `semne`") == "text cu semne"


def test_events_types_and_facts(spark):
    e = one(spark, T.parse_event("t"), t="Târg de carte.\nLocația: Piața Mare.\nPerioada: 04-06.09.2026\nrând în plus")
    assert tuple(e) == ("Târg de carte", "Piața Mare", "04-06.09.2026", ["rând în plus"])
    e = one(spark, T.parse_event("t"), t="Doar titlu\nLocația:\nîncă titlu")
    assert tuple(e) == ("Doar titlu încă titlu", None, None, [])
    kinds = spark.createDataFrame([("law", "pdf"), ("unknown", "pdf"), (None, "webpage"), (None, None)], "d string, s string")
    assert [r[0] for r in kinds.select(T.doc_type("d", "s")).collect()] == ["law", "administrative_document", "webpage_article", "municipal_document"]
    assert [one(spark, T.evidence_kind("t"), t=t) for t in ("data_table", "list_item", "Heading", "paragraph", None)] == ["table", "list", "headline", "body", "body"]
    f = one(spark, T.fact_matches("t"), t="Costă 1,5 milioane lei și 200 EUR, din 01.02.2026 până în 2027, 3 luni, 12 de străzi")
    assert (f["amounts"], f["dates"], f["durations"], f["counts"]) == (["1,5 milioane lei", "200 EUR"], ["01.02.2026", "2027"], ["3 luni"], ["12 de străzi"])


def test_uncited_segments(spark):
    u = lambda t, *ids: one(spark, T.uncited_segments("t", F.array(*map(F.lit, ids))), t=t)
    assert u("Prima. A doua. [S1]", "S1") == ["Prima. A doua."] and u("Prima. [S4]", "S1") == ["Prima."] and u("Fără marker", "S1") == ["Fără marker"]
    assert u("Prima frază. [S1] [S2]\nA doua frază. [S2]", "S1", "S2") == []


def test_language(spark):
    lists = {"en": ("the", "and", "is"), "ro": ("și", "este", "la")}
    d = lambda t, hint=None: one(spark, T.detect_language("t", F.lit(hint).cast("string"), lists, {"ro": "[ăâîșț]"}, {"ru": "[а-яА-Я]"}, "ro"), t=t)
    assert [d("Где это"), d("where is the office"), d("unde este și când"), d("școli"), d("ok", "en"), d("ok")] == ["ru", "en", "ro", "ro", "en", "ro"]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    rows = df.select(T.cosine("a", "b").alias("c"), T.unit("a").alias("u")).collect()
    assert abs(rows[0]["c"] - 0.96) < 1e-9 and rows[1]["c"] is None and rows[0]["u"] == [0.6, 0.8] and rows[1]["u"] is None
    e = spark.createDataFrame([("x",), ("x",), ("y",)], "t string").select(T.hash_embedding("t").alias("v")).collect()
    assert e[0] == e[1] != e[2] and len(e[0]["v"]) == 16 and all(-1 <= v <= 1 for v in e[0]["v"])


# ---------------------------------------------------------------- sources


def test_artifacts_and_ingest(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿școală".encode("utf-8"))
    (tmp_path / "b.txt").write_bytes("ș".encode("utf-16"))
    (tmp_path / "c.txt").write_bytes(b"\xc3\x28")
    (tmp_path / "e.pdf").write_bytes(b"%PDF")
    rows = {r["file_name"]: r for r in artifacts.read_artifacts(spark, str(tmp_path)).collect()}
    assert rows["a.txt"]["text"] == "școală" and rows["b.txt"]["text"] == "ș"
    assert rows["c.txt"]["issue"] == "INVALID_ENCODING" and rows["e.pdf"]["source_type"] == "pdf"
    m = artifacts.manifests(artifacts.read_artifacts(spark, str(tmp_path)).withColumn("title", F.col("file_name")))
    assert artifacts.ingest(m, m.limit(0)).count() == 4 and artifacts.ingest(m, m).count() == 0


def test_snapshots(spark, tmp_path):
    def put(doc, name, body):
        (tmp_path / doc).mkdir(exist_ok=True)
        (tmp_path / doc / name).write_text(body if isinstance(body, str) else json.dumps(body))

    put("d1", "a.json", {"id": "d1", "updated_at": "2026-09-25T10:00:00+03:00", "pages": [{"page": 1, "text": "x"}]})
    put("d1", "b.json", {"id": "d1", "updated_at": "2026-09-26T10:00:00+03:00", "pages": []})
    put("d2", "a.json", {"id": "d2", "updated_at": "2026-09-26T10:00:00+03:00"})
    put("d2", "b.json", "{broken")
    put("d3", "a.json", {"id": "d3", "updated_at": "2026-09-26T10:00:00"})
    rows = feeds.read_snapshots(spark, str(tmp_path))
    good = feeds.latest_snapshot(rows).collect()
    assert [(r["id"], r["updated_at"][:10]) for r in good] == [("d1", "2026-09-26")]
    assert {r["document_id"] for r in feeds.discovery_errors(rows, "folder").collect()} == {"d2", "d3"}


def test_scraper_records(spark, tmp_path):
    sha = "a" * 40
    (tmp_path / f"{sha}.json").write_text(json.dumps({"sha1": sha, "source": "site", "urls": ["nope", "https://a.md/x"], "text": "t", "extracted_at": "2026-01-01T00:00:00Z"}))
    (tmp_path / "bad.json").write_text(json.dumps({"sha1": sha, "urls": []}))
    rows = {r["issue"]: r for r in feeds.read_scraper_records(spark, str(tmp_path)).collect()}
    assert rows[None]["shown_title"] == "Document " + sha[:12] and rows[None]["url"] == "https://a.md/x"
    assert any(k and "SHA1_MISMATCH" in k and "CONTENT_MISSING" in k for k in rows)


def test_versions_feeds_and_traces(spark, tmp_path):
    df = spark.createDataFrame([("d", "t", "u", "s", None, None, dt.date(2026, 1, 2), "e", [1.0, 0.5])], "document_id string, title string, url string, source string, district string, category string, published_date date, excerpt string, embedding array<float>")
    feeds.write_feed(df, str(tmp_path / "feed"))
    assert feeds.read_feed(spark, str(tmp_path / "feed")).collect() == df.collect()
    assert feeds.read_feed(spark, str(tmp_path / "none")).count() == 0
    v1 = feeds.write_stage(df, str(tmp_path / "out"), "feed", "r1")
    feeds.publish_version(spark, v1, "current_feed")
    assert spark.table("current_feed").count() == 1
    with pytest.raises(Exception, match="already exists"):
        feeds.write_stage(df, str(tmp_path / "out"), "feed", "r1")
    feeds.publish_version(spark, v1, "current_feed", str(tmp_path))
    v2 = feeds.write_stage(df.unionByName(df), str(tmp_path / "out"), "feed", "r2")
    feeds.publish_version(spark, v2, "current_feed", str(tmp_path))
    assert feeds.read_version(spark.newSession(), "current_feed", str(tmp_path)).count() == 2
    q = spark.createDataFrame([("secret words", "ro", "OK", 3, [("c1", {"dense": 1})])], "question string, language string, status string, elapsed_ms int, citations array<struct<id:string,ranks:map<string,int>>>")
    feeds.append_trace(q, str(tmp_path / "trace"))
    assert "secret" not in "".join(p.read_text() for p in (tmp_path / "trace").glob("*.json"))


def test_relational_tables(spark, tmp_path):
    for n, columns in feeds.RELATIONAL.items():
        spark.createDataFrame([], columns).write.parquet(str(tmp_path / n))
    tables = feeds.read_relational(spark, str(tmp_path))
    assert len(tables) == 8 and all(t.count() == 0 for t in tables.values()) and "ai_reply" in tables["responses"].columns
    chunks = spark.createDataFrame([("a", "h1"), ("b", "h2")], "chunk_id string, text_sha256 string")
    vectors = spark.createDataFrame([("a", "h1", [1.0], "m", False), ("b", "h2", [2.0], "m", False)], "chunk_id string, text_sha256 string, embedding array<float>, model string, mock boolean")
    assert R.join_embeddings(chunks, vectors).count() == 2
    for bad in (vectors.limit(1), vectors.withColumn("text_sha256", F.lit("x")), vectors.withColumn("model", F.col("chunk_id")), vectors.withColumn("embedding", F.when(F.col("chunk_id") == "a", F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.col("embedding")))):
        with pytest.raises(ValueError):
            R.join_embeddings(chunks, bad)
    cols = "id string, v int, request string, n int, text string"
    server, local = spark.createDataFrame([("1", 2, "r1", 5, "new"), ("2", 1, None, 6, "s")], cols), spark.createDataFrame([("1", 1, "r1", 5, "old"), ("x", 0, "r1", 3, "waits"), ("y", 0, "r9", 9, "unsent")], cols)
    got = R.merge_turns(server, local, "id", "v", "request", "n", F.col("id").isin("x", "y")).orderBy("n").collect()
    assert [(r["id"], r["n"], r["text"]) for r in got] == [("1", 3, "new"), ("2", 6, "s"), ("y", 9, "unsent")]
    subs = spark.createDataFrame([("s",), ("t",)], "sub string")
    settings = spark.createDataFrame([("s", True)], "sub string, enabled boolean")
    topics = spark.createDataFrame([("s", 2, "B", "AUTO", False, 2), ("s", 1, "A", "USER", False, 1), ("s", 3, "C", "AUTO", True, 0)], "sub string, topic_id int, label string, origin string, removed boolean, created_at int")
    view = {r["sub"]: (r["enabled"], [t["label"] for t in r["topics"]]) for r in R.settings_view(subs, settings, topics, "sub", {"enabled": F.lit(False)}).collect()}
    assert view == {"s": (True, ["A", "B"]), "t": (False, [])}
    sent = spark.createDataFrame([("r1", "a"), ("r1", "a"), ("r2", "a"), ("r2", "b"), (None, "c")], "request string, prompt string")
    assert [r["request"] for r in R.request_conflicts(sent, "request", "prompt").collect()] == ["r2"]


def test_chunks_and_pages(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text("\n".join(json.dumps(x) for x in ({"chunkId": "a", "text": "x"}, {"chunkId": "b", "text": " "}, {"chunkId": "c", "text": "y"}, {"chunkId": "c", "text": "z"})))
    rows = feeds.read_chunks_jsonl(spark, str(tmp_path / "c.jsonl"), "chunkId string, text string")
    assert sorted((r["chunkId"], r["issue"]) for r in rows.collect() if r["issue"]) == [("b", "TEXT_MISSING"), ("c", "DUPLICATE_ID"), ("c", "DUPLICATE_ID")]
    with pytest.raises(ValueError):
        feeds.read_chunks_jsonl(spark, str(tmp_path / "c.jsonl"), "chunkId string, text string", strict=True)
    html = "<html><head><title>T &amp; x</title><link rel='canonical' href='https://a.md/x'><meta property='article:published_time' content='2026-01-02'><meta property='og:image' content='i.png'><script>no()</script></head><body><nav>menu</nav><h1>Head</h1><p>One <b>two</b></p><p>One two</p></body></html>"
    b = pages.html_blocks(spark.createDataFrame([(1, html), (2, None)], "id int, h string"), "id", "h").orderBy("id", "ord").collect()
    assert [(r["tag"], r["text"]) for r in b if r["id"] == 1] == [("h1", "Head"), ("p", "One two")] and b[0]["title"] == "T & x" and (b[0]["date"], b[0]["url"], b[0]["image"]) == ("2026-01-02", "https://a.md/x", "i.png") and len([r for r in b if r["id"] == 2]) == 1


def test_unfinished_references_of_a_title_stay(spark):
    html = ["<title>A &amp; b&amp</title><p>&copy 2024</p>", "<TITLE lang=en>c &eacute; &#233 &x</TITLE>", "<title>&quo</title>", "<title>open &amp"]
    b = pages.html_blocks(spark.createDataFrame(list(enumerate(html)), "id int, h string"), "id", "h").orderBy("id").collect()
    assert [r["title"] for r in b][:3] == ["A & b&amp", "c é &#233 &x", "&quo"] and b[0]["text"] == "© 2024"


# ---------------------------------------------------------------- corpus batch


def test_blocks_structure_and_preface(spark):
    text = "SOURCE METADATA\nTitle: Ceva\nURL: https://a.md\nARTICLE CONTENT\n\nTITLU MARE\n\nprima linie  \na doua\n\n- unu\n- doi"
    pre = one(spark, P.parse_preface("t"), t=text)
    assert pre["metadata"] == {"Title": "Ceva", "URL": "https://a.md"} and pre["first_line"] == 4
    b = P.text_blocks(spark.createDataFrame([("d", text)], "document_id string, t string"), "document_id", "t")
    rows = b.orderBy("ord").collect()
    assert [(r["start_line"], r["end_line"]) for r in rows] == [(1, 4), (6, 6), (8, 9), (11, 12)]
    passages = P.structure(b, "document_id").orderBy("passage_ord").collect()
    assert [r["heading"] for r in passages][1:] == ["TITLU MARE", "TITLU MARE"] and passages[1]["citation_text"] == "prima linie\na doua"


def test_pages_and_status(spark):
    df = spark.createDataFrame([("d", [(1, "# Titlu\n\nunu\n\ndoi"), (2, "")])], "id string, pages array<struct<page:int,text:string>>")
    b = P.page_blocks(df, "id").orderBy("ord").collect()
    assert [(r["page"], r["type"]) for r in b] == [(1, "heading"), (1, "paragraph"), (1, "paragraph")]
    st = lambda status, flags, pending, n_ocr, n: spark.range(1).select(P.extraction_status(F.lit(status).cast("string"), F.lit(flags).cast("array<string>") if flags is None else F.array(*map(F.lit, flags)), F.array(*map(F.lit, pending)), F.lit(n_ocr).cast("int"), F.lit(n)).alias("s")).first()["s"]
    assert st(None, ["low_ocr_conf"], [2], None, 1) == "OCR_REQUIRED" and st("ok", ["x"], [2], 1, 1) == "READY" and st("ok", ["x"], [2], 1, 0) == "EMPTY"


def passages(spark, *rows):
    return spark.createDataFrame([(f"p{i}", t, x, p) for i, (t, x, p) in enumerate(rows)], "passage_id string, type string, search_text string, period_raw string")


def test_facts(spark):
    facts, warnings = K.enrich(
        passages(
            spark,
            ("paragraph", "În 20/ 21 și 22 august 2024, anul 2024 – 2025, lucrează 5 echipe de verificare, 31 februarie 2024", None),
            ("paragraph", "peste 10 mii de cadre didactice", None),
            ("municipal_event", "Târg", "04-06.09/11-13.09/18-20.09/25-27.09.2026"),
            ("municipal_event", "Târg", "04-06.09"),
            ("municipal_event", "Târg", "04.09.2026/mereu/05.09.2026"),
        )
    )
    rows = facts.collect()
    of = lambda p, t: [r for r in rows if r["passage_id"] == p and r["type"] == t]
    assert sorted(r["date_value"].day for r in of("p0", "date")) == [20, 21, 22]
    assert [(r["start_year"], r["end_year"]) for r in of("p0", "academic_year")] == [(2024, 2025)]
    assert [r["int_value"] for r in of("p0", "count")] == [5]
    assert [(r["int_value"], r["qualifier"]) for r in of("p1", "count")] == [(10000, "lower_bound")]
    assert sorted(str(r["start_date"]) for r in of("p2", "event_interval")) == ["2026-09-04", "2026-09-11", "2026-09-18", "2026-09-25"]
    assert not of("p3", "event_interval") and len(of("p4", "event_interval")) == 1
    assert {(r["passage_id"], r["warning"]) for r in warnings.collect()} == {("p0", "INVALID_DATE_IGNORED"), ("p3", "EVENT_YEAR_MISSING"), ("p4", "EVENT_PERIOD_UNSUPPORTED")}


@pytest.mark.parametrize("budget", [10, 40, 1000])
def test_exact_parts(budget):
    text = " ".join(f"Propoziția {i}." for i in range(100)) + " " + "cuvânt " * 90
    parts = P.exact_parts(text, budget)
    assert all(text[a:b] == q for q, a, b in parts) and all(P._tokens(q) <= budget for q, _, _ in parts)
    assert parts[0][1] == 0 and parts[-1][2] == len(text.rstrip()) and all(x[1] <= y[1] and x[2] < y[2] for x, y in zip(parts, parts[1:]))
    assert all(not text[x[2] : y[1]].strip() for x, y in zip(parts, parts[1:])) and P.exact_parts("", budget) == []


def test_pack_passages(spark):
    rows = [("d", i, "municipal_event" if i in (3, 4) else "paragraph", "H" if i < 6 else "G", f"Text numărul {i}") for i in range(9)]
    df = spark.createDataFrame(rows, "document_id string, passage_ord int, type string, heading string, citation_text string")
    out = P.pack_passages(df, "document_id", 14).orderBy("chunk").collect()
    assert [list(r["passages"]) for r in out] == [[0, 1, 2], [3], [4], [5], [6, 7, 8]]


def test_table_functions_stream_a_document(spark, monkeypatch):
    many = spark.range(30_000).select(F.lit("d").alias("document"), F.col("id").alias("passage_ord"), F.lit("paragraph").alias("type"), F.lit(None).cast("string").alias("heading"), F.when(F.col("id") % 3 > 0, F.lit("one two")).alias("citation_text"))
    out = P.pack_passages(many.repartition(4), "document", 10).orderBy("chunk").collect()
    assert [x for r in out for x in r["passages"]] == list(range(30_000)) and all(r["text"].count("one") <= 4 for r in out) and len(out) == 5000
    P.register_table_functions(spark, "string", 10)
    many.createOrReplaceTempView("passages")
    same = spark.sql("SELECT * FROM pack_passages(TABLE(SELECT document, CAST(passage_ord AS INT), type, heading, citation_text FROM passages) PARTITION BY document ORDER BY passage_ord)").orderBy("chunk").collect()
    assert [r["text"] for r in same] == [r["text"] for r in out]
    parts = spark.sql("SELECT t.n, s.* FROM VALUES (1, 'Unu doi. Trei patru.'), (2, NULL) AS t(n, x), LATERAL split_exact(x, 3, 0) s").collect()
    assert [(r["n"], r["part"], r["quote"]) for r in parts] == [(1, k, p[0]) for k, p in enumerate(P.exact_parts("Unu doi. Trei patru.", 3, 0))] and len(parts) > 1
    assert P.pack_passages(many.limit(0), "document", 10).count() == 0


def test_quality_and_validation(spark):
    q = lambda t: one(spark, P.passage_quality(F.col("t"), F.lit(True)), t=t)
    assert q("")["issues"] == ["EMPTY_PASSAGE"] and q("unu doi")["issues"] == ["FRAGMENT"] and q("a � text cu semn")["issues"] == ["ENCODING_NOISE"]
    assert q(" ".join("abcdefghij"))["issues"] == ["OCR_NOISE"] and q("un text bun de citit")["status"] == "READY"
    docs = spark.createDataFrame([("a", "f1", "s1", "https://a.md", "webpage", "webpage_article", "2026-01-01", False), ("b", "f9", "s9", None, "derived_web_text", "webpage_article", "2026-1-1", True), ("c", "f1", "s2", "x", "webpage", "article", None, None)], "id string, snapshot_path string, source_sha256 string, url string, source_type string, document_type string, published_date string, requires_ocr boolean")
    out = {r["id"]: (r["source_issues"], r["data_issues"]) for r in Q.validate_source(docs, spark.createDataFrame([("f1", "s1"), ("f1", "s1")], "path string, sha256 string")).collect()}
    assert out == {"a": ([], []), "b": (["SOURCE_SNAPSHOT_MISSING", "SOURCE_URL_MISSING_OR_INVALID", "RAW_WEBPAGE_SNAPSHOT_MISSING"], ["OCR_REQUIRED", "PUBLICATION_DATE_MISSING_OR_INVALID"]), "c": (["SOURCE_HASH_MISMATCH", "SOURCE_URL_MISSING_OR_INVALID"], [])}
    st = spark.createDataFrame([("a", 1, "READY", []), ("a", 2, "WARNING", ["w"]), ("b", 1, "READY", []), ("b", 3, "ERROR", ["e"])], "id string, stage int, status string, issues array<string>")
    assert {r["id"]: (r["status"], r["failed_stage"], r["issues"]) for r in Q.pipeline_outcome(st, "id").collect()} == {"a": ("WARNING", None, ["w"]), "b": ("ERROR", 3, ["e"])}


def test_citations_are_cut_anew(spark):
    place = "struct<kind:string,start_line:int,end_line:int,page_index:int,block_index:int,field:string>"
    docs = spark.createDataFrame([("t", "lines", "one\r\n two \u2028three\n", None, None), ("e", "lines", "", None, None), ("a", "api", None, "Title", [("first\nline\n\n second  ",), (None,)])], "document_id string, source_kind string, text string, title string, pages array<struct<text:string>>")
    cases = [
        ("t", "one\n two", ("source_lines", 1, 2, None, None, None), []), ("t", "two \nthree", ("source_lines", 2, 3, None, None, None), []), ("t", "three", ("source_lines", 3, 4, None, None, None), ["SOURCE_LINE_RANGE_OUT_OF_BOUNDS"]),
        ("t", "one", ("source_lines", 0, 1, None, None, None), ["SOURCE_LINE_RANGE_INVALID"]), ("t", "x", None, ["CITATION_LOCATOR_INVALID"]), ("e", "x", ("source_lines", 1, 1, None, None, None), ["CITATION_SOURCE_UNAVAILABLE"]), ("e", "x", ("pdf_page", None, None, None, None, None), []),
        ("a", "first\nline", ("api_page", None, None, 0, 1, None), []), ("a", " second", ("api_page", None, None, 0, 2, None), []), ("a", "second", ("api_page", None, None, 0, 2, None), ["CITATION_TEXT_SOURCE_MISMATCH"]), ("a", "x", ("scraper_text", 1, 1, None, None, None), ["SCRAPER_TEXT_LOCATOR_INVALID"]),
        ("a", "Title", ("api_metadata", None, None, None, None, "title"), []), ("a", None, ("api_page", None, None, 1, 1, None), ["API_PAGE_TEXT_UNAVAILABLE", "CITATION_TEXT_MISSING"]), ("nowhere", "x", ("source_lines", 1, 1, None, None, None), ["CITATION_SOURCE_UNAVAILABLE"]),
    ]
    rows = spark.createDataFrame([(i, d, t, None, p) for i, (d, t, p, _) in enumerate(cases)], f"n int, document_id string, citation_text string, quote string, locator {place}")
    out = Q.validate_citations(rows, docs)
    assert out.columns == [*rows.columns, "citation_issues"] and {r["n"]: r["citation_issues"] for r in out.collect()} == {i: c[3] for i, c in enumerate(cases)}
    assert Q.validate_citations(rows.limit(0), docs).count() == 0


def test_evidence_rows(spark):
    docs = spark.createDataFrame([("d", "v1", "Titlu distinct", "2026-03-01", "Botanica")], "document_id string, version_id string, title string, published_date string, district string")
    long_ = " ".join(f"Propoziția numărul {i} are destule cuvinte." for i in range(60))
    rows = [("d", "p1", "paragraph", ["# Titlu distinct", "Secțiune"], "Lucrările costă 200 EUR și durează 3 luni.", True, None), ("d", "p2", "paragraph", [], long_, True, []), ("d", "p3", "list_item", [], "unu", True, None), ("d", "p4", "paragraph", [], "unu doi", True, None), ("d", "p5", "paragraph", [], "un text bun de citit", False, ["LOW"])]
    passages = spark.createDataFrame(rows, "document_id string, passage_id string, type string, heading_path array<string>, citation_text string, validated boolean, issues array<string>")
    out = P.build_evidence(docs, passages, 64).orderBy("passage_id", "part").collect()
    first = out[0]
    assert first["retrieval_text"] == "Titlu distinct | Secțiune | Data publicării: 2026-03-01\n\nLucrările costă 200 EUR și durează 3 luni." and first["citation_text"] == rows[0][4]
    assert first["facts"]["amounts"] == ["200 EUR"] and first["facts"]["durations"] == ["3 luni"] and first["locations"] == ["Botanica"] and first["heading"] == ["Secțiune"]
    parts = [r for r in out if r["passage_id"] == "p2"]
    assert len(parts) > 3 and all(r["token_estimate"] <= 64 + 2 and long_[r["char_start"] : r["char_end"]] == r["citation_text"] for r in parts)
    of = {r["passage_id"]: r for r in out}
    assert of["p3"]["indexing_status"] == "READY" and of["p4"]["issue_codes"] == ["FRAGMENT"] and of["p5"]["issue_codes"] == ["LOW"] and of["p5"]["target_collection"] == "review"
    assert len({r["evidence_id"] for r in out}) == len(out)
    assert {r["passage_id"] for r in P.ready_chunks(docs, passages, 5000).select("passage_id").distinct().collect()} == {"p1", "p2", "p3"}
    with pytest.raises(ValueError):
        P.ready_chunks(docs, passages, 63)


def test_merged_chunks_and_previews(spark):
    docs = spark.createDataFrame([("d", "Titlu", "2026-01-02", ("p0", "Titlu"), True, True)], "document_id string, title string, published_date string, title_citation struct<passage_id:string,quote:string>, data_ok boolean, citations_ok boolean")
    rows = [("d", 0, 1, "p2", ["H"], "doi", "Doi", True, True), ("d", 0, 0, "p1", ["H"], "unu", "Unu", True, True), ("d", 1, 2, "p3", [], "trei", "Trei", True, False), ("d", 2, 3, "p4", [], "patru", "Patru", False, False)]
    passages = spark.createDataFrame(rows, "document_id string, chunk int, passage_ord int, passage_id string, heading_path array<string>, search_text string, citation_text string, data_ok boolean, citations_ok boolean")
    out = P.merge_chunk(docs, passages).orderBy("chunk").collect()
    assert out[0]["text"] == "Titlu | Publicat: 2026-01-02 | H\n\nunu\n\ndoi" and out[0]["citation_text"] == "Unu\n\nDoi" and out[0]["passage_ids"] == ["p1", "p2"]
    assert [c["passage_id"] for c in out[0]["citations"]] == ["p0", "p1", "p2"] and [r["status"] for r in out] == ["READY", "CITATION_PENDING", "NEEDS_REVIEW"]
    ev = [("d", "v", "b", "e2", "second", 20, 2, None, None), ("d", "v", "b", "e1", "first", 0, 2, None, None), ("d", "v", "a", "e3", "later", 0, None, 1, 1), ("d", "v", "c", "e4", "one", 0, 2, 5, None)]
    pre = P.source_previews(spark.createDataFrame(ev, "document_id string, version_id string, passage_id string, evidence_id string, citation_text string, char_start int, page int, start_line int, block_index int")).orderBy("place").collect()
    assert [(r["passage_id"], r["text"], r["evidence_ids"]) for r in pre] == [("c", "one", ["e4"]), ("b", "first second", ["e1", "e2"]), ("a", "later", ["e3"])]


def test_scraper_blocks(spark):
    df = spark.createDataFrame([("d", [(1, "unu\n\ndoi"), (2, "trei")], "patru\n\ncinci"), ("e", None, "doar text"), ("f", [(1, "x")], None)], "id string, pages array<struct<page:int,text:string>>, text string")
    b = P.scraper_blocks(df, "id").orderBy("id", "ord").collect()
    assert [(r["id"], r["ord"], r["page"], r["block"]) for r in b] == [("d", 0, 1, "unu"), ("d", 1, 1, "doi"), ("d", 2, 2, "trei"), ("d", 3, None, "patru"), ("d", 4, None, "cinci"), ("e", 0, None, "doar text"), ("f", 0, 1, "x")]


# ---------------------------------------------------------------- search


def test_hybrid_search_brings_what_a_heading_introduces(spark):
    quotes = ["Pașii pentru înregistrare pe platformă:", "Pasul 1: autentificați-vă", "Pasul 2: selectați instituția", "Altceva"]
    points = spark.createDataFrame([(f"p{i}", "d1", i, "body", q) for i, q in enumerate(quotes)] + [("b0", "d2", 0, "body", "Părinții consultă instrucțiunile."), ("b1", "d2", 1, "body", "Altă informație")], "point string, document string, pos int, kind string, quote string")
    rank = lambda *ids: spark.createDataFrame([("q", r, p) for r, p in enumerate(ids, 1)], "q string, rank int, point string")
    scores = spark.createDataFrame([("q", "p0", 0.8), ("q", "p1", 0.1), ("q", "p2", 0.05), ("q", "b0", 0.1)], "q string, point string, score double")
    out = S.hybrid_search(rank("p0", "b0"), rank("b0"), {"need": rank("p0")}, "q", "point", points, catalog=spark.createDataFrame([("q", 1, "d1")], "q string, rank int, document string"), scores=scores, least=0.22, per_anchor=2)
    rows = out.orderBy("place").collect()
    assert [r["point"] for r in rows] == ["p0", "p1", "p2"] and rows[1]["anchor"] == "p0" and dict(rows[2]["ranks"]) == {"contextAfter": 2}
    assert abs(rows[0]["score"] - (2 / 61 + 1 / 61)) < 1e-9  # two channels and the catalog
    plain = S.hybrid_search(rank("b0"), rank("b0"), {}, "q", "point", points)
    assert [r["point"] for r in plain.collect()] == ["b0"]


def test_bm25_in_blocks(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(2))
    docs = spark.createDataFrame([(i, " ".join(word() for _ in range(rng.randint(0, 30))) or None) for i in range(60)], "d int, t string").repartition(3)
    queries = spark.createDataFrame([(f"q{i}", " ".join(word() for _ in range(4))) for i in range(20)], "q string, t string")
    one_, many = (sorted(map(tuple, I.bm25_topk(queries, docs, 5, "q", "t", "d", "t", block=n).collect())) for n in (4096, 3))
    assert one_ == many and len(one_) > 40
    texts = {r["d"]: (r["t"] or "").split() for r in docs.collect()}
    df = lambda t: sum(t in w for w in texts.values())
    import math

    weight = lambda w, t: w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / 120))
    for q, rank, d, score in one_:
        asked = next(r["t"] for r in queries.collect() if r["q"] == q).split()
        want = {i: sum(weight(asked, t) * weight(w, t) * math.log(1 + (60 - df(t) + 0.5) / (df(t) + 0.5)) for t in set(asked) if t in w) for i, w in texts.items()}
        assert abs(score - want[d]) < 1e-5 and sum(v > want[d] + 1e-6 for v in want.values()) < rank


def test_fusion_and_channels(spark):
    ranks = spark.createDataFrame([("q", "dense", p, r) for r, p in enumerate("abc", 1)] + [("q", "sparse", p, r) for r, p in enumerate("ca", 1)], "query_id string, channel string, point_id string, rank int")
    docs = spark.createDataFrame([("a", "d1"), ("b", "d1"), ("c", "d2")], "point_id string, document string")
    fused = S.fuse_rrf(ranks, "query_id", "point_id").join(docs, "point_id")
    out = S.prioritize_channels(fused, "query_id", "point_id", "document", [], 5, 1).orderBy("place").collect()
    assert [r["point_id"] for r in out] == ["a", "c"]
    rng = random.Random(3)
    rows = [(f"q{q}", c, f"p{rng.randrange(60)}", r) for q in range(3) for c in ("dense", "sparse", "need1", "need2") for r in range(1, 12)]
    big = S.fuse_rrf(spark.createDataFrame(rows, ranks.schema).dropDuplicates(["query_id", "channel", "point_id"]), "query_id", "point_id").withColumn("document", F.expr("int(substr(point_id, 2)) % 9"))
    got = S.prioritize_channels(big, "query_id", "point_id", "document", ["need1", "need2"], 8, 2).collect()
    for q in {r["query_id"] for r in got}:
        mine = [r for r in got if r["query_id"] == q]
        assert len(mine) <= 8 and all(sum(x["document"] == d for x in mine) <= 2 for d in range(9))
        assert sum("need1" in r["ranks"] for r in mine) >= 1 and "need1" in next(r for r in mine if r["place"] == 1)["ranks"]


def test_context(spark):
    anchors = spark.createDataFrame([("q", "d", 3, 0.8)], "query_id string, document string, pos int, score double")
    pos = spark.createDataFrame([("d", i) for i in range(3, 6)], "document string, pos int")
    out = S.following_context(anchors, pos, "query_id", per_anchor=2).orderBy("pos").collect()
    assert [(r["pos"], r["distance"]) for r in out] == [(4, 1), (5, 2)] and abs(out[0]["score"] - 0.4) < 1e-9
    said = [("headline", "Titlu"), ("body", "Pașii:"), ("body", "Documentele necesare sunt"), ("body", "Un text simplu"), (None, None)]
    assert [r["x"] for r in spark.createDataFrame(said, "k string, q string").select(S.introduces("k", "q").alias("x")).collect()] == [True, True, True, False, False]
    ranked = spark.createDataFrame([("q", "h", None, 0.8), ("q", "s", "h", 0.1), ("q", "o", None, 0.1)], "query_id string, id string, anchor string, score double")
    assert sorted(r["id"] for r in S.eligible_with_context(ranked, 0.22, "query_id", "id", "anchor").collect()) == ["h", "s"]


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(6, 40)] + [(1000, 1000), (None, 4)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 5 for i in range(5, 40)}, 1000: 1000}
    assert connected_components(spark.createDataFrame([], "a int, b int")).count() == 0


# ---------------------------------------------------------------- rules and claims


def test_rules(spark):
    c = lambda asked, named, pub: one(spark, U.period_conflict(F.array(*map(F.lit, asked)), F.array(*map(F.lit, named)) if named else F.array().cast("array<int>"), F.lit(pub).cast("date")))
    assert c([2022], [2026], None) == "DIFFERENT_PERIOD" and c([2022], [], "2025-01-01") == "DIFFERENT_PERIOD"
    assert c([2022], [], "2023-05-01") is None and c([2022], [], None) is None
    e = lambda f, a, b: one(spark, f(F.col("a"), F.col("b")), a=a, b=b)
    assert e(U.entity_conflict, ["alecsandri"], ["mare"]) == "DIFFERENT_ENTITY" and e(U.entity_conflict, ["mare"], ["mare"]) is None
    assert e(U.acronym_conflict, ["DGTPCC"], ["DGETS"]) == "DIFFERENT_ENTITY" and e(U.acronym_conflict, ["DGTPCC"], ["DGTPCC", "DGETS"]) is None
    rows = spark.createDataFrame([("a", 0.81, "education", "healthcare"), ("b", 0.82, "education", "education"), ("c", 0.5, "education", "general")], "id string, score double, asked string, category string")
    kept, dropped = U.apply_rules(rows, F.lit(None).cast("string"), "asked", "category")
    assert {r["id"]: round(r["score"], 4) for r in kept.collect()} == {"a": 0.6885, "b": 0.82, "c": 0.5} and dropped.count() == 0
    rec = spark.createDataFrame([("q1", "2023-01-01"), ("q1", "2026-05-01"), ("q2", "2023-01-01"), ("q2", None)], "q string, d string").withColumn("d", F.col("d").cast("date"))
    out = U.apply_recency(rec, "q", "d", F.lit("2026-09-27").cast("date")).collect()
    assert sorted((r["q"], str(r["d"]), r["outdated"]) for r in out) == [("q1", "2026-05-01", False), ("q2", "2023-01-01", True), ("q2", "None", False)]
    ties = spark.createDataFrame([("q", s, v) for s, v in zip("abcde", (0.87, 0.86, 0.84, 0.83, 0.82))] + [("w", "a", 0.3), ("w", "b", 0.3), ("x", "a", 0.9)], "q string, s string, v double")
    assert [(r["q"], r["s"]) for r in R.close_ties(ties, "q", "s", "v", least=0.6, ratio=0.88).orderBy("rank").collect()] == [("q", "a"), ("q", "b"), ("q", "c")]


def test_claim_issues(spark):
    ev = [("q", "e1", "Alocat 370.000 lei pentru parc.", "d1"), ("q", "e2", "Costul este 0 lei.", "d1"), ("q", "e3", "În 2024 s-au plantat 50 de arbori.", "d2"), ("q", "e4", "TITLU DE ȘTIRE", "d3")]
    claims = [(1, "Costă 50 lei.", ["e2"]), (2, "S-au cheltuit 370.000 lei.", ["e1"]), (3, "Cât costă parcul?", ["e1"]), (4, "Ceva", ["e9"]), (5, "Costă 370.000 lei și 50 de arbori.", ["e1", "e3"]), (6, "Parcul are bănci.", ["e4"]), (7, "Cât costă", ["e1"]), (8, "Este alocat 370.000 lei.", ["e1"])]
    df = spark.createDataFrame([("q", n, t, None, e, "Cât costă?") for n, t, e in claims], "question_id string, claim_no int, text string, requirement_id string, evidence_ids array<string>, question string")
    evidence = spark.createDataFrame(ev, "question_id string, evidence_id string, quote string, document_id string")
    got = {r["claim_no"]: r["issues"] for r in C.deterministic_issues(df, evidence).collect()}
    assert got[1] == ["UNSUPPORTED_NUMBER:50"] and got[2] == ["UNSUPPORTED_FINANCIAL_STAGE:SPENT"] and got[3] == ["CLAIM_IS_NOT_DECLARATIVE"] and got[4] == ["UNKNOWN_EVIDENCE"]
    assert got[5] == ["CROSS_DOCUMENT_NUMERIC_CLAIM"] and got[6] == ["HEADLINE_ONLY"] and got[7] == ["CLAIM_ECHOES_QUESTION"] and got[8] == []


def test_answers(spark):
    claims = spark.createDataFrame([("q", 1, "Unu. Și încă o frază.", ["b"]), ("q", 2, "Doi.", ["c", "b", "z"]), ("q", 3, "Trei.", ["z"]), ("q", 1001, "Patru.", ["d"]), ("p", 1, "Nimic.", ["z"])], "question_id string, claim_no int, text string, evidence_ids array<string>")
    known = spark.createDataFrame([("q", "b"), ("q", "c"), ("q", "d")], "question_id string, evidence_id string")
    r = {x["question_id"]: x for x in C.render_answers(claims, known).collect()}
    assert r["q"]["answer"] == "Unu. [S1] Și încă o frază. [S1]\nDoi. [S2] [S1]\nPatru. [S3]" and r["q"]["citations"] == ["b", "c", "d"] and r["q"]["dropped"] == 1
    assert (r["p"]["answer"], r["p"]["dropped"]) == (None, 1)
    assert one(spark, T.uncited_sentences("t", F.array(F.lit("S1"))), t="Aceasta este o frază citată [S1]. Aceasta nu are nicio sursă. Scurt.") == ["Aceasta nu are nicio sursă."]
    cov = C.requirement_coverage(spark.createDataFrame([("r1",), ("r2",)], "r string"), spark.createDataFrame([("r1", "x")], "r string, c string"), "r", "c").orderBy("r").collect()
    assert [(x["claims"], x["status"]) for x in cov] == [(1, "ANSWERED"), (0, "MISSING")]
    ev = spark.createDataFrame([("q", "a", "are 5 și 6", 0.2), ("q", "b", "are 5", 0.9), ("q", "c", "nimic", 0.8)], "question_id string, evidence_id string, quote string, score double")
    cl = spark.createDataFrame([("q", 1, "5 și 6", ["a", "b", "c"]), ("q", 2, "text", ["a", "b", "c"])], "question_id string, claim_no int, text string, evidence_ids array<string>")
    assert sorted((x["claim_no"], x["evidence_id"]) for x in C.prune_evidence(cl, ev).collect()) == [(1, "a"), (2, "b"), (2, "c")]


def test_expected_values(spark):
    cases = [
        ("Programul este luni-vineri, 8:00-17:00.", "hours", True), ("Direcția are trei secții și un serviciu.", "hours", False), ("Taxa este de 150 lei.", "amount", True), ("Taxa se achită la ghișeu.", "amount", False),
        ("Trebuie asigurate patru tone de apă.", "amount", True), ("Înscrierea începe la 1 aprilie.", "date", True), ("Înscrierea este reglementată de Ordinul nr. 01/1-7/345.", "legal_act", True), ("Părinții depun cererea online.", "legal_act", False),
        ("Oricare.", "procedure", True), ("Părinții depun cererea online.", "legal_act", True),
    ]
    claims = spark.createDataFrame([(str(i), t, ["S1"]) for i, (t, _, _) in enumerate(cases)], "question_id string, text string, evidence_ids array<string>")
    kinds = spark.createDataFrame([(str(i), k) for i, (_, k, _) in enumerate(cases)] + [("none", "hours")], "question_id string, answer_type string")
    evidence = spark.createDataFrame([("9", "S1", "ORDINUL nr. 278 cu privire la înscriere"), ("7", "S1", "Înscrierea copiilor")], "question_id string, evidence_id string, title string")
    got = {r["question_id"]: r["has_value"] for r in C.has_expected_value(claims, kinds, evidence).collect()}
    assert got == {str(i): w for i, (_, _, w) in enumerate(cases)} | {"none": False}


def test_answer_contract(spark):
    ev = spark.createDataFrame([("q", "S1", "d1", "are 5 bănci"), ("q", "S2", "d1", "x"), ("q", "S3", "d2", "are 7 copaci")], "question_id string, evidence_id string, document_id string, quote string")
    rows = [
        ("SUPPORTED", "Parcul are acum 5 bănci [S1].", ["S1"], None, []), ("PARTIAL", "Parcul are acum 5 bănci [S1].", ["S1"], [], ["LIMITATIONS_MISSING"]), ("X", "Da.", [], None, ["INVALID_STATUS"]),
        ("SUPPORTED", "Parcul are acum 6 bănci [S1].", ["S1"], None, ["NUMBER_NOT_IN_QUOTE"]), ("SUPPORTED", "Parcul are multe bănci noi. Vezi [S1].", ["S1"], None, ["UNCITED_SENTENCE"]),
        ("SUPPORTED", "Parcul are acum bănci noi [S1][S2].", ["S1", "S2"], None, ["DOCUMENT_CITED_TWICE"]), ("SUPPORTED", "Are 5 bănci și 7 copaci [S1][S3].", ["S1", "S3"], None, ["NUMERIC_CROSS_DOCUMENT"]),
        ("SUPPORTED", "Parcul are bănci noi [S9].", ["S9"], None, ["UNKNOWN_EVIDENCE"]), ("SUPPORTED", "Parcul de pe str. Mare e nou [S1].", [], None, ["CITATIONS_DIFFER"]),
    ]
    df = spark.createDataFrame([(i, "q", *r[:4]) for i, r in enumerate(rows)], "i int, question_id string, status string, answer string, evidence_ids array<string>, limitations array<string>")
    assert [r["violations"] for r in C.check_answer_contract(df, ev).orderBy("i").collect()] == [r[4] for r in rows]


def test_verifier(spark):
    ev = spark.createDataFrame([("q", "e1", "Costul este 0 lei pentru toți.", "d1")], "question_id string, evidence_id string, quote string, document_id string")
    claims = spark.createDataFrame([("q", n, t, ["e1"], "Cât?") for n, t in ((1, "Costă 50 lei."), (2, "Costul este zero."), (3, "Este scump."), (4, "Este bine."))], "question_id string, claim_no int, text string, evidence_ids array<string>, question string")
    verdicts = spark.createDataFrame([("q", 1, True, None), ("q", 2, True, None), ("q", 3, False, "NOT_SAID")], "question_id string, claim_no int, supported boolean, reason string")
    good, bad = C.verify(claims, ev, verdicts)
    assert [r["claim_no"] for r in good.collect()] == [2]
    assert {r["claim_no"]: r["reasons"] for r in bad.collect()} == {1: ["UNSUPPORTED_NUMBER:50"], 3: ["NOT_SAID"], 4: ["NO_VERDICT"]}
    again = spark.createDataFrame([(0, 0), (4, 1), (4, 2)], "n int, v int").select(C.needs_second_round(F.col("n"), F.col("v")).alias("x"))
    assert [r["x"] for r in again.collect()] == [True, True, False]


def test_duplicates(spark):
    quote = "un text lung cu destule cuvinte diferite pentru comparare între copii"
    rows = [
        ("q", "a", "https://x.md/f/hotarare-12.pdf", "A", "z", "2022-01-01", 0.5), ("q", "b", "https://y.md/g/hotarare-12.pdf", "B", "w", "2023-01-01", 0.4), ("q", "c", None, "C", quote, None, 0.9), ("q", "d", None, "C", quote + " azi", None, 0.8),
        ("q", "e", None, "Alt loc", quote, None, 0.7), ("p", "f", None, "C", quote, None, 0.1),
    ]
    df = spark.createDataFrame(rows, "question_id string, id string, url string, title string, quote string, published string, score double")
    out = merge_duplicates(df, "question_id", "id", "url", "title", "quote", "published", "score").collect()
    assert sorted((r["id"], r["merged"]) for r in out) == [("b", 1), ("c", 1), ("e", 0), ("f", 0)]
    sets = spark.createDataFrame([(1, list("abcdefghij")), (2, list("abcdefghik")), (3, list("abcdefghij")), (4, list("abc"))], "k int, w array<string>")
    assert [(r["a"], r["b"], round(r["jaccard"], 4)) for r in similar_sets(sets, "k", F.col("w"), 0.8).collect()] == [(1, 2, 0.8182)]


# ---------------------------------------------------------------- alerts and streams


def test_alert_scores_and_upkeep(spark):
    kw = lambda *w: list(w)
    topics = spark.createDataFrame([(1, kw("inscrie", "gradin"))], "t int, terms array<string>")
    feed = spark.createDataFrame([("school", kw("inscrie", "gradin"), kw("inscrie")), ("bus", kw("autobuz"), kw("traseu")), ("half", kw("x"), kw("gradin"))], "d string, title array<string>, body array<string>")
    assert {r["d"]: r["score"] for r in A.lexical_scores(topics, feed, "t", "terms", "d", "title", "body").collect()} == {"school": 1.0, "half": 0.35}
    dis = spark.createDataFrame([("t", 0.61), ("t", 0.5)], "t string, score double")
    assert round(A.raised_thresholds(dis, ["t"], F.lit(0.5)).first()["threshold"], 2) == 0.62
    old = spark.createDataFrame([("s", "Transport")], "s string, label string")
    new = spark.createDataFrame([("s", " transport"), ("s", "Școli"), ("s", "școli"), ("s", " ")], "s string, label string")
    assert A.new_labels(old, new, "s", "label").count() == 1
    al = spark.createDataFrame([("p1", "c1"), ("p1", "c1"), ("p2", None)], "p string, c string")
    assert next(r["n"] for r in R.unread_counts(al, "p", "c").where("g is null and s is null").orderBy(F.desc("n")).collect()) == 3


def test_topics_dismissals_and_matchers(spark):
    rows = [("s", "Orarul troleibuzelor", "orar", 1), ("s", "orarul TROLEIBUZELOR", "dublură", 2), ("s", "Apă caldă", "apă", 3), ("s", "L" * 120, "q " * 400, 4), ("s", "Parcări", "parcare", 5), ("s", "Al cincilea", "x", 6), ("s", "Al șaselea", "y", 7), ("s", "Fără", " ", 8)]
    topics = spark.createDataFrame(rows, "s string, label string, query string, n int")
    out = A.finalize_topics(topics, "s", "label", "n", query="query", existing=spark.createDataFrame([("s", "apă CALDĂ")], "s string, label string")).orderBy("n").collect()
    assert [r["label"] for r in out][0] == "Orarul troleibuzelor" and [r["n"] for r in out] == [1, 4, 5, 6] and len(out[1]["label"]) <= 80 and len(out[1]["query"]) <= 300
    t = spark.createDataFrame([("a", "AUTO", None, None), ("b", "USER", None, 0.7), ("c", "AUTO", None, 0.9)], "topic_id string, origin string, deleted_at timestamp, min_score double")
    now = F.lit("2026-09-27 10:00:00").cast("timestamp")
    gone = A.delete_topics(t, t.where("topic_id in ('a', 'b')"), "topic_id", now).collect()
    assert {r["topic_id"]: r["deleted_at"] is not None for r in gone} == {"a": True, "c": False}
    al = spark.createDataFrame([(1, "a", 0.8, None), (2, "a", 0.7, None), (3, "c", 0.5, None), (4, "b", 0.6, None)], "id int, topic_id string, score double, dismissed_at timestamp")
    hidden, after = A.dismiss(al, t, F.col("id").isin(1, 3), now)
    assert {r["id"] for r in hidden.where("dismissed_at is not null").collect()} == {1, 3}
    assert {r["topic_id"]: round(r["min_score"], 2) for r in after.collect() if r["min_score"]} == {"a": 0.81, "b": 0.7, "c": 0.9}
    feed = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "id int, embedding array<float>")
    with_gap = feed.unionByName(spark.createDataFrame([(3, None)], feed.schema))
    pick = lambda f: A.match_with(f, lambda: f, lambda: f)[0]
    assert (pick(feed), pick(with_gap), pick(feed.limit(0))) == ("embedding", "lexical", "lexical")


def test_diverse_choice(spark):
    rng = random.Random(9)
    rows = [(f"i{n}", rng.choice("xyz"), f"Titlu {rng.choice(['apa', 'drum', 'parc'])} {n if n % 5 else 'repetat'}", n) for n in range(120)]
    pool = spark.createDataFrame(rows, "id string, source string, title string, rank int")
    buckets = {"water": (("x", "y"), "apa"), "road": (("x", "z"), "drum"), "any": (("x", "y", "z"), None)}
    out = A.select_diverse(pool, buckets, 20, 6, thrice=("z",)).orderBy("place").collect()
    got, used, keys = [], {}, set()
    by = {s: [r for r in rows if r[1] == s] for s in "xyz"}
    for name, (sources, pattern) in buckets.items():
        at, taken = dict.fromkeys(sources, 0), 0
        while taken < 7 and any(at[s] < len(by[s]) for s in sources):
            for s in sources:
                if taken >= 7:
                    break
                while at[s] < len(by[s]):
                    r = by[s][at[s]]
                    at[s] += 1
                    if r[0] in {g[0] for g in got} or used.get(s, 0) >= (18 if s == "z" else 6) or r[2].lower() in keys or (pattern and pattern not in r[2]):
                        continue
                    got.append((r[0], name))
                    used[s] = used.get(s, 0) + 1
                    keys.add(r[2].lower())
                    taken += 1
                    break
    assert [(r["id"], r["bucket"]) for r in out] == got[:20]


def test_alert_scan_never_repeats(spark, tmp_path):
    topics = spark.createDataFrame([("t1", 1, None), ("t2", 1, 0.95)], "topic_id string, subscription_id bigint, min_score double")
    (tmp_path / "feed").mkdir()
    schema = "document_id string, topic_id string, score double"
    rows = [(f"d{i}", "t1", 1 - i / 20) for i in range(1, 6)] + [("d1", "t2", 0.9)]
    got = []
    for _ in range(4):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "feed"))
        X.scan_alerts(stream, topics, lambda b: b, str(tmp_path / "alerts"), str(tmp_path / "ck")).awaitTermination(60)
        got.append(sorted(r["document_id"] for r in spark.read.parquet(str(tmp_path / "alerts")).collect()))
    assert got == [["d1", "d2"], ["d1", "d2", "d3", "d4"], ["d1", "d2", "d3", "d4", "d5"], ["d1", "d2", "d3", "d4", "d5"]]


def test_incremental_collection(spark, tmp_path):
    schema = "id string, updated_at timestamp, body string"
    f = X.fingerprint({"category": "mobility"})
    for rows in ([("a", dt.datetime(2026, 9, 25, 10), "x"), ("b", dt.datetime(2026, 9, 25, 11), "y")], [("b", dt.datetime(2026, 9, 25, 11), "y"), ("c", dt.datetime(2026, 9, 25, 11, 30), "z")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        X.collect_incremental(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "marks"), f, str(tmp_path / "ck")).awaitTermination(60)
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "store")).collect()) == ["a", "b", "c"]
    marks = spark.read.parquet(str(tmp_path / "marks"))
    assert X.next_start(marks, f).first()["start"] == dt.datetime(2026, 9, 25, 11, 25) and X.next_start(marks, X.fingerprint({"category": "education"})).count() == 0
    assert X.fingerprint({"a": 1, "b": 2}) == X.fingerprint({"b": 2, "a": 1})


def test_turns(spark):
    m = 60_000
    ev = [("a", 0, "start", 1, None), ("a", 1 * m, "complete", 1, "ok"), ("b", 0, "start", 1, None), ("b", 6 * m, "retry", 2, None), ("b", 7 * m, "complete", 1, "old"), ("b", 8 * m, "complete", 2, "Replacement"), ("c", 0, "start", 1, None), ("c", 6 * m, "complete", 1, "late"), ("d", 0, "complete", 1, "no turn")]
    df = spark.createDataFrame(ev, "turn string, ts bigint, kind string, version bigint, text string")
    out = {r["turn"]: (r["status"], r["text"], r["error"]) for r in X.turn_lifecycle(df, "turn").collect()}
    assert out == {"a": ("COMPLETED", "ok", None), "b": ("COMPLETED", "Replacement", None), "c": ("FAILED", None, "GENERATION_INTERRUPTED")}
    silent = spark.createDataFrame([("s", 0, "start", 1, None), ("t", 9 * m, "start", 1, None)], df.schema)
    at = lambda now: {r["turn"]: r["status"] for r in X.turn_lifecycle(silent, "turn", now_ms=now).collect()}
    assert at(None) == {"s": "PENDING", "t": "PENDING"} and at(10 * m) == {"s": "FAILED", "t": "PENDING"}


def test_silent_turns_of_a_stream_run_out(spark, tmp_path):
    m = 60_000
    schema = "turn string, ts bigint, kind string, version bigint, text string"
    for n, rows in enumerate([[("a", 0, "start", 1, None), ("b", 0, "start", 1, None)], [("b", 1 * m, "complete", 1, "ok")], [("z", 60 * m, "start", 1, None)], [("z", 61 * m, "complete", 1, "done")]]):
        rows = [(k, 10**12 + at, *rest) for k, at, *rest in rows]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = X.turn_lifecycle(stream, "turn", late="1 minute").withColumn("n", F.lit(n)).writeStream.foreachBatch(lambda b, i: b.write.mode("append").parquet(str(tmp_path / "out"))).outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        assert q.awaitTermination(90)
    rows = [(r["turn"], r["status"], r["error"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert ("a", "FAILED", "GENERATION_INTERRUPTED") in rows and ("b", "COMPLETED", None) in rows and ("z", "COMPLETED", None) in rows
    assert ("b", "FAILED", "GENERATION_INTERRUPTED") not in rows


def test_embed_missing(spark):
    def embed(texts):
        if "bad" in texts:
            raise ValueError("no")
        return [[float(len(t))] for t in texts]

    texts = spark.createDataFrame([("h1", "one"), ("h2", "bad"), ("h1", "one")], "text_hash string, text string")
    none = spark.createDataFrame([], "text_hash string, model string, embedding array<float>")
    out = X.embed_missing(texts, none, embed, "m")
    assert {r["text_hash"]: (r["embedding"], r["error"]) for r in out.collect()} == {"h1": ([3.0], None), "h2": (None, "no")}
    assert X.embed_missing(texts.where("text_hash = 'h1'"), out, embed, "m").count() == 0
    assert X.embed_missing(texts, out, embed, "m").count() == 1 and X.embed_missing(texts.where("text_hash = 'h1'"), out, embed, "m", mock=True).count() == 1


# ---------------------------------------------------------------- evaluation and history


def test_history_window_and_page(spark):
    turns = spark.createDataFrame([("c", i, r) for i, r in enumerate(["user", "assistant"] * 3)], "c string, n int, role string")
    assert [r["n"] for r in R.history_window(turns, "c", "n", "role", 3).orderBy("n").collect()] == [4, 5]
    p = R.page(spark.createDataFrame([("v", i) for i in range(5)], "v string, n int"), "v", [F.asc("n")], 2, focus=F.col("n") == 3).collect()
    assert [(r["n"], r["has_previous"], r["has_next"]) for r in p] == [(3, True, False), (4, True, False)]


def test_similar_sets_equal_brute_force_in_cells_of_any_size(spark, monkeypatch):
    import random

    from lexiforge.operators import similarity

    monkeypatch.setattr(similarity, "_CUT", 3)
    monkeypatch.setattr(similarity, "_BROADCAST", 0)
    rng = random.Random(5)
    sets = [[f"w{rng.randrange(400)}" for _ in range(rng.choice([5, 12, 60, 300]))] for _ in range(40)]
    for base in list(sets):
        for _ in range(rng.randrange(6)):
            sets.append([w for w in base if rng.random() > 0.06] + [f"n{rng.randrange(99)}" for _ in range(rng.randrange(3))])
    got = {(r["a"], r["b"]): r["jaccard"] for r in similar_sets(spark.createDataFrame(list(enumerate(sets)), "k int, w array<string>"), "k", F.col("w")).collect()}
    first = {}
    for k, s in enumerate(sets):
        if len(set(s)) >= 8:
            first.setdefault(frozenset(s), k)
    want = {(x, y): len(a & b) / len(a | b) for a, x in first.items() for b, y in first.items() if x < y and len(a & b) / len(a | b) >= 0.85}
    assert got == want and len(want) > 50


def test_similar_sets_lose_no_link_of_copies_short_sets_and_repeated_keys(spark):
    words = [f"w{i}" for i in range(20)]
    rows = [(4, words), (2, words[::-1]), (9, words + words[:3]), (9, words), (1, [*words[:19], "x"]), (1, words[:19]), (5, list("abcdefg")), (6, list("abcdef")), (7, list("gfedcba")), (8, []), (3, None), (None, words)]
    sets = spark.createDataFrame(rows, "k int, w array<string>")
    links = lambda **more: sorted((r["a"], r["b"], round(r["jaccard"], 4)) for r in similar_sets(sets, "k", F.col("w"), **more).collect())
    other = [(1, 1, 0.95), (1, 2, 0.9048), (1, 2, 0.95)]
    assert links() == other
    assert links(least_tokens=1, copies=True) == [*other, (2, 4, 1.0), (2, 9, 1.0), (5, 6, 0.8571), (5, 7, 1.0)]
