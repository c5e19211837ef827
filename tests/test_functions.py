"""Golden values of the text and score functions."""

import math

import pytest
from pyspark.sql import functions as F

from quern.functions import scores, text
from quern.functions.stem import stem_vocabulary
from quern.operators import chunking, citations


@pytest.fixture(scope="module")
def one(spark):
    base = spark.range(1)
    return lambda c: base.select(c).first()[0]


@pytest.mark.parametrize(
    "given,want",
    [
        ("Girder load (q_max) rises to HALF-SPAN at 45%?", ["girder", "load", "q_max", "rises", "to", "half", "span", "at", "45"]),
        ("Weld at 3.5 mm, e_mod 210, step 12.0 [rule 4.10.2]", ["weld", "at", "3.5", "mm", "e_mod", "210", "step", "12.0", "rule", "4.10.2"]),
        ("", []), (None, []), ("café", ["caf"]), ("日本 語", ["日本", "語"]), ("“smart” — ﬁne", ["smart", "fine"]),
    ],
)
def test_tokens(one, given, want):
    assert one(text.tokens(F.lit(given))) == want


def test_content_tokens_and_estimates(one):
    assert one(text.content_tokens(F.lit("why the paint on a bridge does flake in winter"))) == ["paint", "bridge", "flake", "winter"]
    for given, want in (("", 0), ("hello world", 2), ("a, b, c", 5), ("antimicrobial", 3)):
        assert one(text.token_estimate(F.lit(given))) == want == chunking.estimate(given)
    assert one(text.truncate_to_tokens(F.lit("one two three four"), 2)) == "one two" and one(text.truncate_to_tokens(F.lit("one"), 0)) == ""


@pytest.mark.parametrize(
    "given,want",
    [
        ("Paint flakes off. Nobody knows why! Ask", ["Paint flakes off.", "Nobody knows why!", "Ask"]),
        ("Coat 2.5 mm at 8 C. Wait.", ["Coat 2.5 mm at 8 C.", "Wait."]),
        ("As Dr. Moss said, it holds. Good.", ["As Dr. Moss said, it holds.", "Good."]),
        ("Look at no. 7. Rust grew by 0.4.", ["Look at no. 7.", "Rust grew by 0.4."]),
        ("He said \"no.\" Then (e.g. Here) it ended", ["He said \"no.", "Then (e.g. Here) it ended"]),
        ("", []),
    ],
)
def test_sentences(one, given, want):
    assert one(text.sentences(F.lit(given))) == want == chunking.sentences(given)


def test_cleaning_and_labels(one):
    assert one(text.clean_text(F.lit("two   spans\n\n\n\n\none pier"))) == "two spans\n\none pier"
    assert one(text.clean_text(F.lit("galva-\nnised steel"))) == "galvanised steel"
    assert one(text.clean_text(F.lit("\t loose  \t ends "))) == "loose ends"
    assert one(text.clean_text(F.lit("ﬀ①"), nfkc=True)) == "ff1"
    assert one(text.snippet(F.lit("aaaa bbbb cccc dddd"), 12)) == "aaaa bbbb..." and one(text.snippet(F.lit("one two three"), 20)) == "one two three"
    assert [tuple(x) for x in one(text.highlight_spans(F.lit("Rust on steel, rusty or rust"), F.array(F.lit("rust"))))] == [(0, 4), (24, 28)]
    assert one(text.strip_furniture(F.array(*map(F.lit, ["Intro", "Page 2 of 9", "Body", "  7  "])))) == ["Intro", "Body"]
    assert [one(text.page_label(F.lit(a).cast("int"), F.lit(b).cast("int"))) for a, b in ((3, 3), (3, 5), (None, None))] == ["p. 3", "pp. 3-5", ""]
    assert one(text.cite(F.lit("It is so."), F.lit(2))) == "It is so [2]." and one(text.cite(F.lit("And so on..."), F.lit(1))) == "And so on... [1]"
    assert one(text.redact(F.lit("Bearer abcdefghijkl"))) == "Bearer [REDACTED]"
    once = one(text.redact(F.lit("token=abcd1234 sk-aaaabbbbcccc")))
    assert "abcd1234" not in once and "sk-aaaa" not in once and one(text.redact(F.lit(once))) == once


def test_cleaning_of_one_text_equals_the_expression(one):
    for given in ("two   spans\r\n\n\n\none pier", "galva-\nnised  steel \n x", "\u201cq\u201d\u00a0\ufb01ne\u2026 \u2022 item\u00ad\x07", ""):
        assert text.clean(given) == one(text.clean_text(F.lit(given), nfkc=True))


def test_slugs_keep_letters_without_their_accents(one):
    for given, want in (("Über die Brücke", "uber-die-brucke"), ("  ", "section"), ("\ufb01ne \uff21\uff11 \u00e6on", "fine-a1-on"), ("Łódź 2", "odz-2"), ("a" * 70, "a" * 60)):
        assert one(text.slug(F.lit(given))) == want == chunking._slug(given)


def test_stems_of_words_equal_those_of_the_vocabulary(spark):
    from quern.functions.stem import STEP2, STEP3, STEP4, stem_word

    bases = ["a", "tr", "hop", "hopp", "relat", "rel", "yell", "sy", "ski", "fall", "control", "agre", "conflat", "troubl", "siz", "bas", "inspect", "oscill", "vietnam", "\u00e9t"]
    ends = ["", "s", "es", "ies", "sses", "ed", "eed", "ing", "y", "e", "ll", "i", *(x for x, _ in STEP2 + STEP3), *STEP4]
    words = sorted({b + e for b in bases for e in ends})
    got = {r.token: r.stem for r in stem_vocabulary(spark.createDataFrame([(w,) for w in words], "token string")).collect()}
    assert {w: stem_word(w) for w in words} == got


def test_stems(spark):
    groups = ["dry dried drying dries", "packaging packages packaged", "sterilisation sterilise", "activities activity"]
    words = " ".join(groups).split() + ["heat", "health", "a_w", "60", "ph", "mangoes", "reduces", "hopping", "hoping", "yes"]
    got = {r.token: r.stem for r in stem_vocabulary(spark.createDataFrame([(w,) for w in words], "token string")).collect()}
    assert all(len({got[w] for w in g.split()}) == 1 for g in groups) and got["dry"] == "dry"
    assert got["heat"] != got["health"] and (got["a_w"], got["60"], got["ph"]) == ("a_w", "60", "ph")
    assert (got["mangoes"], got["reduces"], got["hopping"], got["hoping"], got["activity"]) == ("mango", "reduc", "hop", "hope", "activ")


def test_scores(one):
    terms = lambda s: F.array(*map(F.lit, s.split())) if s else F.array().cast("array<string>")
    assert one(scores.bm25_idf(F.lit(100), F.lit(1))) == pytest.approx(4.2097, abs=1e-4)
    assert one(scores.bm25_tf(F.lit(1), F.lit(10), F.lit(10))) == pytest.approx(1.0)
    assert one(scores.textbook_idf(F.lit(2), F.lit(2))) == 1e-6
    assert [round(one(scores.rank_prior(F.lit(r))), 4) for r in (0, 1, 2, 3, 11, 40)] == [1.0, 1.0, 0.9091, 0.8333, 0.5, 0.2041]
    assert one(scores.term_coverage(terms("dry mango temperatur"), terms("dry mango 60"))) == 0.6667
    assert one(scores.term_coverage(terms(""), terms("dry"))) == 0.0
    assert one(scores.proximity(terms("a b"), terms("a b c"))) == 1.0 and one(scores.proximity(terms("a"), terms("x a"))) == 0.5 and one(scores.proximity(terms("a"), terms("x"))) == 0.0
    assert one(scores.proximity(terms("a b"), terms("a x b"))) == pytest.approx(0.9828)
    assert one(scores.phrase_overlap(terms("a b c"), terms("x a b"))) == 0.5
    assert one(scores.jaccard(terms("a b"), terms("b c"))) == pytest.approx(1 / 3) and one(scores.jaccard(terms(""), terms(""))) == 0.0
    assert one(scores.sentence_score(terms("a b c"), terms("a b"), F.lit(1))) == pytest.approx(0.7267, abs=1e-4)
    assert one(scores.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)))) == 0.0
    assert one(scores.sublinear_tf(F.lit(3))) == pytest.approx(1 + math.log(3)) and one(scores.band(F.lit(0.6))) == "strong"


def test_markers(one):
    assert one(citations.markers(F.lit("Dried at 60 C [1]. Water activity matters [2][1]."))) == [1, 2]
    assert one(citations.markers(F.lit("Both agree [1, 3]; also [2; 4], not [1998] or [12.5]."))) == [1, 3, 2, 4]
    assert one(citations.strip_markers(F.lit("Mango is dried at 60 C [1]. Water activity is low [2][3]."))) == "Mango is dried at 60 C. Water activity is low."
    keep = F.array(F.lit(1), F.lit(2))
    assert one(citations.normalise_markers(F.lit("Both sources agree [1, 3]."))) == "Both sources agree [1][3]."
    assert one(citations.normalise_markers(F.lit("Cited [1] and [9]."), keep)) == "Cited [1] and."
    assert one(citations.normalise_markers(F.lit("Mixed group [1, 9]."), keep)) == "Mixed group [1]."
    for given, want in (("First claim. [1] Second claim. [2]", ["First claim [1].", "Second claim [2]."]), ("Dried at 60 C. [1]", ["Dried at 60 C [1]."]), ("[1]", ["[1]"]), ("", [])):
        assert one(citations.cited_sentences(F.lit(given))) == want
