import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quern.llm import encode
from quern.llm.token_count import token_counts

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = encode.WordEncoder(PATH, cache_words=50)
PARTS = st.sampled_from([" ", "  ", "\n", "\t", " ", "　", "a", "Word", "don't", "'s", ",", "!!", "42", "é", "日本", "😀", "<|endoftext|>", "\x1c", "_", "'"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(PARTS, max_size=12).map("".join), min_size=1, max_size=6))
def test_ids_equal_the_library(texts):
    want = [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    counts, ids = ENCODER.encode(texts)
    assert counts.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]
    assert ENCODER.counts(texts).tolist() == counts.tolist()


def test_long_texts_are_cut_safely(monkeypatch):
    monkeypatch.setattr(encode, "SEGMENT_CHARS", 20)
    monkeypatch.setattr(encode.safe_segments, "__defaults__", (20,))
    texts = ["many words in one long text, " * 20 + "end", "x" * 300, "two  spaces \n here " * 30, ""]
    counts, ids = encode.WordEncoder(PATH).encode(texts)
    want = [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert "".join(encode.safe_segments(texts[0])) == texts[0]


def test_token_counts_of_odd_rows(spark):
    rows = [(1, "One two.", "x"), (2, None, None), (2, "", "x"), (None, "é é", "x"), (1, "One two.", "x"), (5, "long word " * 3000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(token_counts(df, PATH, batch_bytes=10).collect(), key=str)
    want = sorted(((d, len((t or "").encode()), len(LIBRARY.encode(t or "", add_special_tokens=False).ids)) for d, t, _ in rows), key=str)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_counts(df.limit(0), PATH).count() == 0


def test_sentencepiece_counts(spark):
    import sentencepiece

    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    df = spark.createDataFrame([(1, "Some words here."), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in token_counts(df, path).collect()} == {1: len(model.encode("Some words here.")), 2: 0}
