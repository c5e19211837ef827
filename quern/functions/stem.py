"""The engine's stemmer, over a vocabulary in the JVM or over lists of tokens in Arrow batches; both follow the same tables.

A Porter stemmer with British -ise forms, whole -tion and -sion in the fourth step, and y restored where i is the only
vowel. The measure of a stem is a pattern once a leading y, a consonant, is written Y.
"""

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text

# Suffix rules; in each of the first two tables the first suffix that fits decides.
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("iser", "ize"), ("abli", "able"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("isation", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("alise", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "sion", "tion", "ou", "ism", "ate", "iti", "ous", "ive", "ize", "ise")

CONSONANTS, VOWELS = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
SOME = f"^({CONSONANTS})?{VOWELS}{CONSONANTS}"
ONE = f"^({CONSONANTS})?{VOWELS}{CONSONANTS}({VOWELS})?$"
MORE = f"^({CONSONANTS})?{VOWELS}{CONSONANTS}{VOWELS}{CONSONANTS}"
VOWEL = f"^({CONSONANTS})?[aeiouy]"
SHORT = f"^{CONSONANTS}[aeiouy][^aeiouwxy]$"
DOUBLE = "([^aeiouy])\\1$"


def _cut(w: Column, n: int) -> Column:
    return F.substring(w, F.lit(1), F.greatest(F.length(w) - n, F.lit(0)))


def _plural(w: Column) -> Column:
    return F.when(w.endswith("sses") | w.endswith("ies"), _cut(w, 2)).when(w.endswith("s") & ~w.endswith("ss"), _cut(w, 1)).otherwise(w)


def _past(w: Column) -> Column:
    """A past or progressive ending that goes leaves a mark for the repairs that follow."""
    return (
        F.when(w.endswith("eed"), F.when(_cut(w, 3).rlike(SOME), _cut(w, 1)).otherwise(w))
        .when(w.endswith("ed") & _cut(w, 2).rlike(VOWEL), F.concat(_cut(w, 2), F.lit("|")))
        .when(w.endswith("ing") & _cut(w, 3).rlike(VOWEL), F.concat(_cut(w, 3), F.lit("|")))
        .otherwise(w)
    )


def _repair(w: Column) -> Column:
    bare = _cut(w, 1)
    return (
        F.when(~w.endswith("|"), w)
        .when(bare.rlike("(at|bl|iz)$"), F.concat(bare, F.lit("e")))
        .when(bare.rlike(DOUBLE) & ~bare.rlike("[lsz]$"), _cut(w, 2))
        .when(bare.rlike(ONE) & bare.rlike(SHORT), F.concat(bare, F.lit("e")))
        .otherwise(bare)
    )


def _final_y(w: Column) -> Column:
    return F.when(w.endswith("y") & _cut(w, 1).rlike(VOWEL), F.concat(_cut(w, 1), F.lit("i"))).otherwise(w)


def _table(rules: tuple[tuple[str, str], ...], measure: str):
    """The first suffix that fits decides; it is replaced if the rest has the measure."""

    def step(w: Column) -> Column:
        out = F.when(F.lit(False), w)
        for suffix, to in rules:
            base = _cut(w, len(suffix))
            out = out.when(w.endswith(suffix), F.when(base.rlike(measure), F.concat(base, F.lit(to))).otherwise(w))
        return out.otherwise(w)

    return step


def _final_e(w: Column) -> Column:
    base = _cut(w, 1)
    return F.when(w.endswith("e") & (base.rlike(MORE) | (base.rlike(ONE) & ~base.rlike(SHORT))), base).otherwise(w)


def _final_l(w: Column) -> Column:
    return F.when(w.endswith("ll") & w.rlike(MORE), _cut(w, 1)).otherwise(w)


def _restore_y(w: Column) -> Column:
    return F.when(w.endswith("i") & ~_cut(w, 1).rlike(VOWEL), F.concat(_cut(w, 1), F.lit("y"))).otherwise(w)


_STEPS = (
    _plural, _past, _repair, _final_y, _table(STEP2, SOME), _table(STEP3, SOME), _table(tuple((s, "") for s in sorted(STEP4, key=len, reverse=True)), MORE),
    _final_e, _final_l, _restore_y, lambda w: F.regexp_replace(w, "^Y", "y"),
)


def stem_of(token: Column) -> Column:
    """The stem of a lower-case token. Tokens of three characters or fewer, and those that are not all letters, stay.

    Each step is a lambda over a list of one word, so its input is a variable: the expression grows by its steps, not
    with their product, wherever the optimizer repeats it.
    """
    w = F.regexp_replace(token, "^y", "Y")
    for step in _STEPS:
        w = F.transform(F.array(w), step)[0]
    return F.when((F.length(token) > 3) & token.rlike(r"^\p{L}+$"), w).otherwise(token)


def with_stem(vocabulary: DataFrame, token: str = "token", out: str = "stem") -> DataFrame:
    return vocabulary.withColumn(out, stem_of(F.col(token)))


def stem_vocabulary(tokens: DataFrame, token: str = "token") -> DataFrame:
    """(token, stem) of every distinct token.

    Distinct tokens are dealt anew by a fixed number of parts: stemming is work for the cores, not for the few parts that so small a
    table would be merged into.
    """
    parts = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return with_stem(tokens.select(F.col(token).alias("token")).filter("token is not null").distinct().repartition(parts, "token"))


# Lists of tokens -----------------------------------------------------------------------------------------------------------

_HAS = {p: re.compile(p).search for p in (SOME, ONE, MORE, VOWEL, SHORT, DOUBLE, "(at|bl|iz)$", "[lsz]$")}


def _replaced(w: str, rules, measure: str) -> str:
    for suffix, to in rules:
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            return base + to if _HAS[measure](base) else w
    return w


_LONGEST_FIRST = tuple((s, "") for s in sorted(STEP4, key=len, reverse=True))


@lru_cache(maxsize=1 << 18)
def stem_word(token: str) -> str:
    """As :func:`stem_of`; a worker keeps the words that it has seen."""
    if len(token) <= 3 or not token.isalpha():
        return token
    w = "Y" + token[1:] if token[0] == "y" else token
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _HAS[SOME](w[:-3]) else w
    elif (cut := 2 if w.endswith("ed") else 3 if w.endswith("ing") else 0) and _HAS[VOWEL](w[:-cut]):
        w = w[:-cut]
        if _HAS["(at|bl|iz)$"](w):
            w += "e"
        elif _HAS[DOUBLE](w) and not _HAS["[lsz]$"](w):
            w = w[:-1]
        elif _HAS[ONE](w) and _HAS[SHORT](w):
            w += "e"
    if w.endswith("y") and _HAS[VOWEL](w[:-1]):
        w = w[:-1] + "i"
    w = _replaced(_replaced(_replaced(w, STEP2, SOME), STEP3, SOME), _LONGEST_FIRST, MORE)
    if w.endswith("e") and (_HAS[MORE](w[:-1]) or (_HAS[ONE](w[:-1]) and not _HAS[SHORT](w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _HAS[MORE](w):
        w = w[:-1]
    if w.endswith("i") and not _HAS[VOWEL](w[:-1]):
        w = w[:-1] + "y"
    return "y" + w[1:] if w[:1] == "Y" else w


def _offsets(lengths: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))


def _stems(lists: pa.Array) -> pa.Array:
    coded = lists.flatten().dictionary_encode()
    terms = pa.array([stem_word(t) for t in text.values(coded.dictionary)], pa.string())
    return pa.ListArray.from_arrays(_offsets(np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)), terms.take(coded.indices))


_STOPS = frozenset(text.STOP_WORDS)


def _counts(stemmed: bool, content: bool, wanted: frozenset[str] | None):
    def count(lists: pa.Array) -> pa.Array:
        coded = lists.flatten().dictionary_encode()
        lengths, words, at = np.asarray(lists.value_lengths()).astype(np.int64), text.values(coded.dictionary), np.asarray(coded.indices)
        row = np.repeat(np.arange(len(lengths)), lengths)
        held = np.array([not content or (len(w) > 1 and w not in _STOPS) for w in words], dtype=bool)
        dl = np.bincount(row[held[at]], minlength=len(lengths)).astype(np.int64)
        names = [stem_word(w) for w in words] if stemmed else words
        if wanted is not None:
            held &= np.array([x in wanted for x in names], dtype=bool)
        # Tokens with one stem are one term: number terms, not tokens.
        terms, mine = pa.array(names, pa.string()).dictionary_encode(), held[at]
        width = max(1, len(terms.dictionary))
        found, n = np.unique(row[mine] * width + np.asarray(terms.indices).astype(np.int64)[at[mine]], return_counts=True)
        per_row = np.bincount(found // width, minlength=len(lengths)).astype(np.int64)
        cells = pa.StructArray.from_arrays([terms.dictionary.take(pa.array(found % width)), pa.array(n, pa.int64())], names=["term", "tf"])
        return pa.StructArray.from_arrays([pa.array(dl), pa.ListArray.from_arrays(_offsets(per_row), cells)], names=["dl", "terms"])

    return count


def stem_list(tokens: Column) -> Column:
    """The stems of a list of tokens, in order; null is empty. Each distinct token of an Arrow batch is looked up once, and nothing is shuffled."""

    def run(lists: pa.Array) -> pa.Array:
        return _stems(lists)

    return F.arrow_udf(run, "array<string>")(tokens)


def term_counts(c: Column | str, stemmed: bool = True, content: bool = True, wanted: frozenset[str] | None = None) -> Column:
    """(dl, terms) of a text: how many terms it has, and (term, tf) of each term once, only of those ``wanted`` if given."""
    count = _counts(stemmed, content, wanted)

    def run(texts: pa.Array, lists: pa.Array) -> pa.Array:
        found = [count(few) for _, few in text.split_few(texts, lists)]
        return pa.concat_arrays(found or [count(pa.array([], pa.list_(pa.string())))])

    return F.arrow_udf(run, "struct<dl:bigint,terms:array<struct<term:string,tf:bigint>>>")(*text.unsplit(c))
