"""Sources, structure, retrieval, answers and tables over small corpora of our own."""

import io
import os
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import answer, chunking, citations, context, dense, fusion, hashing, keyword, rerank, tables
from quern.plans.evaluate import answer_metrics, retrieval_metrics, summary
from quern.plans.rag import RagConfig, answer_questions
from quern.sources import files
from quern.streaming.ingest import current_chunks, start_ingest

MARKDOWN = """---
title: Drying notes
author: 'A. Writer'
---
Opening words before any heading.

# Method
## Sample preparation
Mango slices are dried at 60 C. The water activity falls to 0.55. See Fig. 3 for the curve.

- first item
  goes on
- second item

| time | value |
|------|-------|
| 1 | 2 |

> quoted line

```
code   kept
```
## Results
Table 1: Drying values
Bridges are inspected every two years. Inspectors look for cracks.
"""

CHUNKS = [
    ("food:0", "food", "Mango slices are dried at 60 C until the water activity falls below 0.6. Drying takes eight hours."),
    ("food:1", "food", "Dried mango keeps for six months in sealed bags."),
    ("bridge:0", "bridge", "Steel bridges are inspected every two years for fatigue cracks."),
    ("arch:0", "arch", "Archives keep paper records in cool dry rooms."),
    ("empty:0", "empty", "   "),
]
QUESTIONS = [("q1", "At what temperature are mango slices dried?"), ("q2", "How often are steel bridges inspected?"), ("q3", "Who won the football championship?"), ("q4", "   ")]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame([(i, d, t, t, d.title()) for i, d, t in CHUNKS], "id string, document_id string, body string, embed_text string, title string")


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame(QUESTIONS, "qid string, question string")


def test_markdown_blocks_outline_and_chunks(spark):
    p = files.parse_text(MARKDOWN.encode(), True)
    assert p["title"] == "Drying notes" and p["meta"]["author"] == "A. Writer"
    assert [b["kind"] for b in p["blocks"]] == ["paragraph", "heading", "heading", "paragraph", "list_item", "list_item", "table", "quote", "code", "heading", "caption", "paragraph"]
    assert p["blocks"][6]["text"] == "| time | value |\n| 1 | 2 |" and p["blocks"][4]["text"] == "- first item goes on" and p["blocks"][8]["text"] == "code   kept"
    keys = [(s.key, s.level) for s in chunking.outline(p["blocks"], p["title"])]
    assert keys == [("drying-notes", 1), ("method", 1), ("method/sample-preparation", 2), ("method/results", 2)]
    made = chunking.chunks_of(p["blocks"], p["title"], chunking.ChunkConfig(target=55, overlap=18, minimum=12, maximum=110))
    assert [c["chunk_index"] for c in made] == list(range(len(made))) and all(c["token_count"] <= 110 for c in made)
    assert any(c["embed_text"].startswith("Section: Method > Sample preparation\n") for c in made)
    df = spark.createDataFrame([("d", p["title"], [(b["kind"], b["level"], b["page"], b["text"]) for b in p["blocks"]])], f"document_id string, title string, blocks {chunking.BLOCKS}")
    assert chunking.chunk_documents(df).count() >= 3
    rolled = {r.key: (r.n_sections, r.chars) for r in chunking.section_rollups(chunking.section_rows(df)).collect()}
    assert rolled["method"][0] == 3 and rolled["method"][1] > rolled["method/results"][1]


def test_long_text_is_packed_with_overlap_and_nothing_lost():
    sentences = [f"Sentence number {i} says something about drying." for i in range(200)]
    made = chunking.chunks_of([{"kind": "paragraph", "level": None, "page": 1, "text": " ".join(sentences)}], "T", chunking.ChunkConfig(target=60, overlap=20, minimum=10, maximum=90))
    joined = " ".join(c["body"] for c in made)
    assert all(s in joined for s in sentences) and sum(c["has_overlap"] for c in made) == len(made) - 1 and all(c["token_count"] <= 90 for c in made)
    words = chunking.chunks_of([{"kind": "paragraph", "level": None, "page": 1, "text": "run on " * 900}], "T", chunking.ChunkConfig())
    assert all(c["token_count"] <= 520 for c in words) and sum(len(c["body"].split()) for c in words) >= 1800
    assert chunking.chunks_of([], "T", chunking.ChunkConfig()) == []


def docx() -> bytes:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda text, style="Normal": f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'
    body = p("Report", "Title") + p("Method", "Heading1") + p("Dried at 60 C.") + f'<w:tbl><w:tr><w:tc>{p("a")}</w:tc><w:tc>{p("b")}</w:tc></w:tr></w:tbl>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def pdf() -> bytes:
    content = zlib.compress(b"BT (Drying \\(mango\\)) Tj 0 -14 Td [(water) -300 (activity) 20 (!)] TJ ET")
    head = b"%PDF-1.4\n1 0 obj << /Type /Page /Contents 2 0 R >> endobj\n2 0 obj << /Filter /FlateDecode >>\nstream\n"
    return head + content + b"\nendstream endobj\n"


def test_folder_of_files(spark, tmp_path):
    for name, data in (("a.md", MARKDOWN.encode()), ("b.docx", docx()), ("c.pdf", pdf()), ("d.txt", "Latin caf\xe9".encode("cp1252")), ("e.html", b"<html>"), ("f.pdf", b"not a pdf")):
        (tmp_path / name).write_bytes(data)
    got = {r.name: r for r in files.read_folder(spark, str(tmp_path)).collect()}
    assert [b.kind for b in got["b.docx"].blocks] == ["heading", "heading", "paragraph", "table"] and got["b.docx"].blocks[3].text == "| a | b |"
    assert "Drying (mango)" in got["c.pdf"].blocks[0].text and "water activity!" in " ".join(b.text for b in got["c.pdf"].blocks)
    assert got["d.txt"].blocks[0].text == "Latin caf\xe9"
    assert got["e.html"].warnings == ["blocked extension"] and got["f.pdf"].warnings == ["content does not match the extension"]
    names = spark.createDataFrame([("../../etc/passwd",), ("C:\\Windows\\notes.txt",), ("   ",), ("CON.txt",), ("a" * 500 + ".pdf",)], "n string").select(files.safe_name(F.col("n"))).collect()
    assert [r[0] for r in names[:4]] == ["passwd", "notes.txt", "document", "file_CON.txt"] and len(names[4][0]) <= files.MOST_NAME


def test_names_keep_180_characters(spark):
    long = ["a" * 140 + end + ".pdf" for end in ("x", "y")] + ["b" * 300 + ".pdf"]
    names = [r[0] for r in spark.createDataFrame([(n,) for n in long], "n string").select(files.safe_name(F.col("n"))).collect()]
    assert names[:2] == long[:2] and names[2] == "b" * 176 + ".pdf"


def test_streaming_ingest_replaces_documents(spark, tmp_path):
    src, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    src.mkdir()
    (src / "a.txt").write_text("Plain words about drying. More words follow here.")
    start_ingest(spark, str(src), out, state).awaitTermination()
    (src / "b.txt").write_text("Another document about bridges.")
    start_ingest(spark, str(src), out, state).awaitTermination()
    assert current_chunks(spark, out).select("document_id").distinct().count() == 2


def test_dense_and_approximate_search(spark, chunks, questions):
    v = hashing.hash_embed(chunks, "id", "embed_text").withColumnRenamed("vector", "v")
    norms = [sum(x * x for x in r.v) for r in v.collect()]
    assert sorted(round(n, 4) for n in norms) == [0.0, 1.0, 1.0, 1.0, 1.0]
    q = hashing.hash_embed(questions, "qid", "question").withColumnRenamed("vector", "v")
    exact = {r.qid: r.id for r in dense.exact_search(v, q, 1).collect()}
    assert exact["q1"] == "food:0" and exact["q2"] == "bridge:0"
    near = {r.qid: r.id for r in dense.hyperplane_search(v, q, 1).collect()}
    assert near["q2"] == "bridge:0"
    none = chunks.limit(0).select("id")
    assert dense.exact_search(v, q, 1, none).count() == 0


def test_hyperplane_search_recalls_what_exact_search_finds(spark):
    folder = os.environ.get("QUERN_TEST_DATA", "/root/testdata") + "/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    v = spark.read.parquet(f"{folder}/embeddings.parquet").selectExpr("cast(vec_id as string) as id", "embedding as v")
    q = v.filter("cast(id as int) % 50 = 0").withColumnRenamed("id", "qid")
    found = lambda df: {(r.qid, r.id) for r in df.collect()}
    exact = found(dense.exact_search(v, q, 10))
    assert len(exact) == 100 and len(exact & found(dense.hyperplane_search(v, q, 10))) / len(exact) >= 0.9


def test_probes_equal_all_products():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16))
    rows = np.repeat(centres, 50, axis=0) + 0.05 * rng.normal(size=(2000, 16))
    rows[7] = 0
    rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
    names = np.array([str(i) for i in range(2000)])
    asked = np.concatenate([rows[:100:3], np.zeros((1, 16))])
    for k in (1, 10, 60, 5000):
        for (a, x), (b, y) in zip(dense._all_rows(asked, rows, names, k), dense._probes(24, 7, 5)(asked, rows, names, k), strict=True):
            assert a.tolist() == b.tolist() and np.allclose(x, y, atol=1e-6)


def test_keyword_modes_fusion_and_guards(spark, chunks, questions):
    index = keyword.build_index(chunks, "id", "body")
    hits = keyword.search(index, questions, 3, matched=True).collect()
    assert {r.qid: r.id for r in hits if r.rank == 1}["q2"] == "bridge:0" and any("inspected" in r.matched for r in hits)
    gone = keyword.delete(index, spark.createDataFrame([("bridge:0",)], "id string"))
    assert "bridge:0" not in {r.id for r in keyword.search(gone, questions, 5).collect()}
    again = keyword.upsert(gone, keyword.build_index(chunks.filter("id = 'bridge:0'"), "id", "body"))
    assert "bridge:0" in {r.id for r in keyword.search(again, questions, 5).collect()}
    a = spark.createDataFrame([("q", "x", 3.0, 1), ("q", "y", 2.0, 2)], "qid string, id string, score double, rank int")
    b = spark.createDataFrame([("q", "y", 9.0, 1)], "qid string, id string, score double, rank int")
    rrf = {r.id: r.score for r in fusion.reciprocal_rank_fusion({"a": a, "b": b}).collect()}
    assert rrf["y"] == pytest.approx(1 / 62 + 1 / 61, abs=1e-6) and rrf["x"] == pytest.approx(1 / 61, abs=1e-6)
    weighted = {r.id: r.score for r in fusion.weighted_fusion({"a": a, "b": b}, {"a": 0.65, "b": 0.35}).collect()}
    assert weighted == {"x": 0.65, "y": 0.35}
    for call in (lambda: fusion.fuse("none", {"a": a}), lambda: fusion.hybrid(a, b, "other"), lambda: fusion.hybrid(a, None, "keyword"), lambda: tables.delete_where(a, {}), lambda: tables.check_fingerprint("x:y:1", "x:y:2")):
        with pytest.raises(ValueError):
            call()
    assert fusion.hybrid(a, None).count() == 2
    assert tables.filtered(a, {"id": []}).count() == 0 and tables.filtered(a, {"rank": "1"}).count() == 1


def test_context_caps_budget_and_shrinking(spark):
    rows = [("q", f"d:{i}", "d", "Doc", f"passage {i} of words", i) for i in range(1, 7)] + [("q", "e:0", "e", "Doc", " ", 7), ("q", "f:0", "f", "Doc", "more words", 8)]
    df = spark.createDataFrame(rows, "qid string, id string, document_id string, label string, text string, rank int")
    got = {r.id: (r.marker, r.drop_reason) for r in context.pack_context(df).collect()}
    assert got["d:4"] == (4, None) and got["d:5"] == (None, "per_document_cap") and got["e:0"] == (None, "empty_text") and got["f:0"] == (5, None)
    big = spark.createDataFrame([("q", "d:0", "d", "Doc", "word " * 500, 1), ("q", "d:1", "d", "Doc", "word " * 400, 2)], df.schema)
    cut = {r.id: r for r in context.pack_context(big, budget=50).collect()}
    assert cut["d:0"].truncated and cut["d:0"].marker == 1 and cut["d:1"].drop_reason == "token_budget"
    block = context.context_blocks(context.pack_context(big, budget=50), 50).first()
    assert block.token_count <= 50 and block.n_passages == 1


def test_answers_are_cited_grounded_and_refused(spark, chunks, questions):
    got = {r.qid: r for r in answer_questions(questions, chunks).collect()}
    assert got["q1"].status == "ok" and "60 C" in got["q1"].answer and "[" in got["q1"].answer and got["q1"].groundedness == 1.0 and got["q1"].coverage == 1.0
    assert got["q3"].status in ("weak_match", "no_passages", "model_refused") and got["q4"].status == "no_passages"
    assert got["q3"].answer == answer.INSUFFICIENT and got["q4"].explanation
    only = {r.qid: r.status for r in answer_questions(questions, chunks, RagConfig(mode="keyword", rerank=False)).collect()}
    assert only["q2"] == "ok"
    expected = spark.createDataFrame([("q1", True), ("q2", True), ("q3", False), ("q4", False)], "qid string, answerable boolean")
    m = answer_metrics(answer_questions(questions, chunks), expected).first()
    assert m.refusal_accuracy == 1.0 and m.answer_rate == 1.0 and m.groundedness == 1.0


def test_fabrications_and_unknown_markers_are_found(spark):
    passages = spark.createDataFrame([("q", 1, "a:0", "Mango is dried at 60 C."), ("q", 2, "b:0", "Bridges are inspected for cracks.")], "qid string, marker int, id string, body string")
    answers = spark.createDataFrame([("q", "Mango is dried at 60 C [1]. Bridges are inspected for cracks [1]. Quantum gravity explains fruit [2]. However. Penguins fly [9].")], "qid string, answer string")
    report, cited = citations.resolve(answers, passages)
    r = report.first()
    assert r.invalid_markers == [9] and r.uncited_sentences == 2 and {(x.marker, x.n) for x in cited.collect()} == {(1, 2), (2, 1)}
    s = {x.pos: x for x in answer.check_support(report.select("qid", "answer"), passages).collect()}
    assert s[0].supported and not s[1].supported and s[1].misattributed and not s[2].supported and not s[3].is_claim and s[3].supported and not s[4].supported
    g = answer.groundedness(answer.check_support(report.select("qid", "answer"), passages)).first()
    assert (g.n_claims, g.n_supported) == (4, 1) and not g.advises_refusal


def test_rerankers_of_the_caller(spark, questions):
    c = spark.createDataFrame([("q1", "a", 1, "long text", ""), ("q1", "b", 2, "short", "")], "qid string, id string, rank int, text string, heading string")
    got = [r.id for r in rerank.model_rerank(questions, c, lambda pairs: [-len(p) for _, p in pairs]).orderBy("new_rank").collect()]
    assert got == ["b", "a"]
    replies = spark.createDataFrame([("q1", 'scores: {"1": 3, "2": 12}'), ("q2", "1: 4\n2 - 7.5")], "qid string, reply string")
    assert {(r.qid, r.label): r.rating for r in rerank.parse_ratings(replies).collect()} == {("q1", "1"): 3.0, ("q1", "2"): 10.0, ("q2", "1"): 4.0, ("q2", "2"): 7.5}
    rated = rerank.rated_rerank(c, spark.createDataFrame([("q1", "b", 9.0)], "qid string, id string, rating double"))
    assert [r.id for r in rated.orderBy("new_rank").collect()] == ["a", "b"] or rated.count() == 2


def test_metrics(spark, questions):
    ranked = spark.createDataFrame([("q1", "x", 1), ("q1", "y", 2), ("q2", "z", 1)], "qid string, id string, rank int")
    relevant = spark.createDataFrame([("q1", "y"), ("q1", "w"), ("q2", "z")], "qid string, id string")
    m = {r.qid: r for r in retrieval_metrics(questions, ranked, relevant).collect()}
    assert (m["q1"].recall, m["q1"].reciprocal_rank, m["q1"].recall_at_1) == (0.5, 0.5, 0.0) and m["q2"].recall == 1.0 and m["q3"].recall == 1.0
    assert summary(retrieval_metrics(questions, ranked, relevant)).first().mrr == 0.875


def test_table_operations(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    new = spark.createDataFrame([("b", 5), ("c", 6)], "id string, v int")
    assert sorted(map(tuple, tables.upsert(old, new).collect())) == [("a", 1), ("b", 5), ("c", 6)]
    changed = tables.update_by_key(old, spark.createDataFrame([("a", None), ("b", 9)], "id string, v int"), "id")
    assert sorted(map(tuple, changed.collect())) == [("a", 1), ("b", 9)]
    left, kids = tables.cascade_delete(old, new, spark.createDataFrame([("b",)], "id string"), "id")
    assert left.count() == 1 and kids.count() == 1 and tables.orphans(new, old, "id").count() == 1 and tables.without_orphans(new, old, "id").count() == 1
