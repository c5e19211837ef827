"""Files both ways, records, prompts, settings and row scopes over small examples."""

import base64
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import chunking, fusion, keyword, prompts, records, rerank, tables
from quern.plans import config
from quern.plans.rag import RagConfig
from quern.sources import files, render


@pytest.mark.parametrize(
    "lines,want",
    [
        ("# Spans #\ntext\nmore", [("heading", 1, "Spans"), ("paragraph", None, "text\nmore")]),
        ("Piers\n=====\nOpen\n---\nx", [("heading", 1, "Piers"), ("heading", 2, "Open"), ("paragraph", None, "x")]),
        ("open words\n## Cut\nTable 2: Loads\nafter it", [("paragraph", None, "open words"), ("heading", 2, "Cut"), ("caption", None, "Table 2: Loads"), ("paragraph", None, "after it")]),
        ("1. one\n   still one\n2) two\n* three", [("list_item", None, "1. one still one"), ("list_item", None, "2) two"), ("list_item", None, "* three")]),
        ("> a\n> b\nc", [("quote", None, "a b"), ("paragraph", None, "c")]),
        ("|a|b|\n|-|:-:|\n|1|2|\nx", [("table", None, "|a|b|\n|1|2|"), ("paragraph", None, "x")]),
        ("~~~\n# no heading\n```\n~~~\nx", [("code", None, "# no heading\n```"), ("paragraph", None, "x")]),
        ("words here\n3.2 Steel Decks\nREPAIR WORK\n“quoted”", [("paragraph", None, "words here"), ("heading", 2, "3.2 Steel Decks"), ("heading", 1, "REPAIR WORK"), ("paragraph", None, '"quoted"')]),
        ("Figure 1: " + "long " * 50, [("paragraph", None, ("Figure 1: " + "long " * 50).strip())]),
    ],
)
def test_blocks(lines, want):
    assert [(b["kind"], b["level"], b["text"]) for b in files.blocks_of_text(lines, False)] == want


def stream(head: bytes, data: bytes) -> bytes:
    return b"<< " + head + b" >>\nstream\n" + data + b"\nendstream"


def obj(n: int, body: bytes) -> bytes:
    return b"%d 0 obj\n" % n + body + b"\nendobj\n"


def test_pdf_page_tree_filters_object_streams_and_code_tables():
    cmap = b"1 begincodespacerange <00> <FF> endcodespacerange 1 beginbfchar <01> <0053> endbfchar 2 beginbfrange <02> <04> <0061> <05> <06> [<0070006E> <0021>] endbfrange"
    held = b"<< /Type /Page /Parent 2 0 R /Contents 11 0 R >> << /Type /Page /Parent 2 0 R /Contents [10 0 R 13 0 R] >>"
    second = held.index(b"<<", 2)
    numbers = b"20 0 21 %d " % second
    packed = zlib.compress(numbers + held)
    data = b"%PDF-1.5\n" + b"".join([
        obj(1, b"<< /Type /Catalog /Pages 2 0 R >>"),
        obj(2, b"<< /Type /Pages /Kids [21 0 R 20 0 R] /Resources << /Font << /F1 5 0 R >> >> >>"),
        obj(5, b"<< /Type /Font /ToUnicode 6 0 R >>"), obj(6, stream(b"/Filter /FlateDecode", zlib.compress(cmap))),
        obj(7, stream(b"/Type /ObjStm /N 2 /First %d /Filter /FlateDecode" % len(numbers), packed)),
        obj(10, stream(b"/Filter /ASCIIHexDecode", b"BT /F1 12 Tf <0105> Tj ET".hex().encode() + b">")),
        obj(11, stream(b"/Filter [/ASCII85Decode /FlateDecode]", base64.a85encode(zlib.compress(b"BT (last page) Tj ET")) + b"~>")),
        obj(13, stream(b"", b"BT /F1 9 Tf <020304> Tj 0 -9 Td <06> Tj ET")),
    ])
    got = files.parse_pdf(data)
    assert [(b["page"], b["text"]) for b in got["blocks"]] == [(1, "Spn\nabc\n!"), (2, "last page")]
    with pytest.raises(ValueError, match="unpack"):
        try:
            files.MOST_UNPACKED, kept = 10, files.MOST_UNPACKED
            files.parse_pdf(data)
        finally:
            files.MOST_UNPACKED = kept


BLOCKS = [
    {"kind": "heading", "level": 1, "page": 1, "text": "Decks & Spans"}, {"kind": "paragraph", "level": None, "page": 1, "text": "Steel rusts. Paint helps <much>."}, {"kind": "list_item", "level": None, "page": 1, "text": "- one item"},
    {"kind": "table", "level": None, "page": 1, "text": "| a | b |\n| 1 | 2 |"}, {"kind": "heading", "level": 2, "page": 2, "text": "Repairs"}, {"kind": "quote", "level": None, "page": 2, "text": "as they say"}, {"kind": "code", "level": None, "page": 2, "text": "x = 1\ny = 2"},
]


def test_rendered_files_read_back(spark, tmp_path):
    bare = [(b["kind"], b["level"], b["text"]) for b in BLOCKS]
    assert [(b["kind"], b["level"], b["text"]) for b in files.parse_text(render.markdown(BLOCKS).encode(), True)["blocks"]] == bare
    got = files.parse_docx(render.docx(BLOCKS, "Spans"))
    assert [(b["kind"], b["level"], b["text"]) for b in got["blocks"]] == bare and got["title"] == "Spans" and [b["page"] for b in got["blocks"]] == [b["page"] for b in BLOCKS]
    assert [b["page"] for b in files.parse_text(render.plain(BLOCKS).encode(), False)["blocks"]][-1] == 2
    df = spark.createDataFrame([("d1", "Spans", [tuple(b.values()) for b in BLOCKS])], f"document_id string, title string, blocks {chunking.BLOCKS}")
    made = render.render(df, "docx").union(render.render(df, "md")).union(spark.createDataFrame([("x", "../x.md", bytearray(b"x")), ("y", "big.md", bytearray(99999))], "document_id string, name string, content binary"))
    folder = tmp_path / "out"
    done = {r.name: r.written for r in render.write_files(made, f"file://{folder}", 50000).collect()}
    assert done == {"d1.docx": True, "d1.md": True, "../x.md": False, "big.md": False} and sorted(p.name for p in folder.iterdir()) == ["d1.docx", "d1.md"]
    assert sorted((r.name, len(r.blocks)) for r in files.read_folder(spark, f"file://{folder}").collect()) == [("d1.docx", 7), ("d1.md", 7)]
    with pytest.raises(ValueError):
        render.render(df, "exe")


def test_records_follow_chunks_and_documents(spark):
    chunks = spark.createDataFrame([("a", 0, "h", None), ("a", 1, None, 3), ("b", 0, "x", 1)], "document_id string, chunk_index int, heading string, page_start int")
    vectors = records.embed_rows(spark.createDataFrame([("a:0", "one"), ("a:1", None), ("b:0", " two ")], "id string, text string"), lambda t: np.array([[len(x), np.nan] for x in t]), 2, batch=2)
    assert {r.id: r.v for r in vectors.collect()} == {"a:0": [1.0, 0.0], "a:1": [1.0, 0.0], "b:0": [1.0, 0.0]}
    made = records.records_from_chunks(chunks, vectors, user_id=4, extra={"lang": "en"})
    assert {r.id: r.payload for r in made.collect()}["a:1"] == {"document_id": "a", "chunk_index": "1", "page_start": "3", "user_id": "4", "lang": "en"}
    with pytest.raises(Exception, match="no chunk or no vector"):
        records.records_from_chunks(chunks, vectors.filter("id <> 'a:1'")).collect()
    with pytest.raises(Exception, match="of width 3"):
        records.embed_rows(spark.createDataFrame([("a", "x")], "id string, text string"), lambda t: np.zeros((len(t), 2)), 3).collect()
    kept, missing = records.sync_records(made.filter("id <> 'b:0'"), spark.createDataFrame([("b",), ("a",)], "document_id string").filter("document_id = 'b'"), chunks)
    assert kept.count() == 0 and [r.document_id for r in missing.collect()] == ["b"]


def test_keyword_index_is_kept_in_step(spark):
    rows = [("a:0", "a", "steel bridge"), ("b:0", "b", "paint flakes"), ("c:0", "c", "steel rust")]
    chunks = spark.createDataFrame(rows, "id string, document_id string, text string")
    index = keyword.build_index(chunks.filter("document_id <> 'c'"))
    synced = keyword.sync(index, chunks, spark.createDataFrame([("a",), ("c",)], "document_id string"))
    q = spark.createDataFrame([("q", "steel paint")], "qid string, question string")
    assert sorted(r.id for r in keyword.search(synced, q, 5).collect()) == ["a:0", "c:0"]
    fresh = keyword.build_index(chunks.filter("document_id <> 'b'"))
    for f in (keyword.term_frequencies, keyword.index_stats):
        assert sorted(map(tuple, f(synced).collect())) == sorted(map(tuple, f(fresh).collect()))
    twice = keyword.build_index(chunks.union(chunks.filter("id = 'a:0'")))
    assert {(r.term, r.tf, r.dl) for r in twice.postings.filter("id = 'a:0'").collect()} == {("steel", 2, 4), ("bridg", 2, 4)}
    words = fusion.matched_terms({"k": keyword.search(synced, q, 5, matched=True), "again": keyword.search(fresh, q, 5, matched=True)})
    assert {r.id: r.terms for r in words.collect()} == {"a:0": ["steel"], "c:0": ["steel"]}


def test_messages_and_prompts(spark):
    asked = spark.createDataFrame([("q", " why? ", 1), ("r", "now", 2)], "qid string, question string, conv_id int")
    past = spark.createDataFrame([(1, i, role, f"t{i}") for i, role in enumerate(["system", "user", "assistant", "user", "assistant"])], "conv_id int, turn int, role string, text string")
    made = prompts.build_messages(asked, spark.createDataFrame([("q", "[1] rust ")], "qid string, context string"), past, turns=3, instructions="Be exact.")
    got = {r.qid: [(m.role, m.content) for m in r.messages] for r in made.collect()}
    assert got["q"] == [("system", "Be exact."), ("assistant", "t2"), ("user", "t3"), ("assistant", "t4"), ("user", "Passages:\n\n[1] rust\n\nQuestion: why?")]
    assert len(got["r"]) == 2
    one = made.filter("qid = 'r'").select(prompts.flatten_messages(F.col("messages")).alias("t"), prompts.fold_system(F.col("messages")).alias("f")).first()
    assert one.t.startswith("Be exact.\n\nPassages:") and one.f.system == "Be exact." and [m.role for m in one.f.rest] == ["user"]
    hits = spark.createDataFrame([("q", "secret-id", 2, "b  b", "H"), ("q", "other-id", 1, "a" * 50, None)], "qid string, id string, rank int, text string, heading string")
    said = prompts.rating_prompts(asked, hits, 10).first().prompt
    assert said.endswith(f"[1] {'a' * 10}\n\n[2] (H) b b") and "-id" not in said
    labels = spark.createDataFrame([("h", ["p"]), ("", ["p", "q"]), (None, None)], "h string, p array<string>").select(rerank.heading_or_path(F.col("h"), F.col("p"))).collect()
    assert [r[0] for r in labels] == ["h", "p > q", ""]


def test_settings():
    values = config.parse_dotenv("# no\nexport RAG_TOP_N = 3 # few\nRAG_RERANK='off'\nRAG_SUPPORT=high\nAPI_KEY=\"abcdefghijkl\"\nbroken\n=x\n")
    assert values == {"RAG_TOP_N": "3", "RAG_RERANK": "off", "RAG_SUPPORT": "high", "API_KEY": "abcdefghijkl"}
    c = config.read_config(values)
    assert (c.top_n, c.rerank, c.support) == (3, False, RagConfig().support) and config.problems(c) == []
    assert len(config.problems(RagConfig(mode="x", top_n=0, support=2))) == 3
    assert config.describe(c)["top_n"] == 3 and config.redacted(values)["API_KEY"] == "********ijkl" and config.redacted(values)["RAG_TOP_N"] == "3"


def test_scopes_pages_and_outlines(spark):
    rows = spark.createDataFrame([(1, 7, 0), (1, 7, 1), (2, 8, 0), (3, None, 0)], "conv_id int, user_id int, turn int")
    assert tables.scoped(rows, 7).count() == 2 and tables.scoped(rows).count() == 4 and tables.scoped(rows, 9).count() == 0
    left = tables.delete_before(rows, spark.createDataFrame([(1, 1)], "conv_id int, before int"))
    assert sorted((r.conv_id, r.turn) for r in left.collect()) == [(1, 1), (2, 0), (3, 0)]
    docs = spark.createDataFrame([("d", "T", [tuple(b.values()) for b in BLOCKS]), ("e", "T", [("paragraph", None, 3, "one two")])], f"document_id string, title string, blocks {chunking.BLOCKS}")
    assert {tuple(r) for r in chunking.outline_stats(chunking.section_rows(docs)).collect()} == {("d", 2, 2, False), ("e", 0, 0, True)}
    stats = {r.document_id: r for r in chunking.document_stats(docs).collect()}
    assert (stats["d"].n_headings, stats["d"].pages, stats["d"].empty_pages, stats["e"].empty_pages, stats["e"].n_words) == (2, 2, 0, 2, 2)
    chunks = chunking.chunk_documents(docs)
    assert [(r.chunk_index, r.preview) for r in tables.chunk_page(chunks, "e", 5, 0, 3).collect()] == [(0, "one")]
