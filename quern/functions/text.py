"""Text functions as Column expressions: normalisation, tokens, estimates, sentences, labels and redaction.

Equality of terms is decided here for the whole engine: tokens are runs of ASCII letters and digits, joined by underscores, or
dotted numbers; accented letters separate. All functions treat null as the empty string unless they say otherwise.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that are folded before words are matched.
FOLD_SINGLE = {
    "‘": "'", "’": "'", "‚": "'", "‛": "'", "“": '"', "”": '"', "„": '"', "‟": '"',
    "–": "-", "—": "-", "―": "-", "−": "-", " ": " ", "⁄": "/", "×": "x",
}
FOLD_REMOVED = "​‌‍﻿­"
FOLD_LONG = {"…": "...", "•": "* ", "●": "* ", "▪": "* ", "·": "* ", "‣": "* ", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}

# Words and patterns that decide what a term is.
TOKEN = r"(?i)\d+(?:\.\d+)+|[a-z0-9]+(?:_[a-z0-9]+)*"
STOP_WORDS = (
    "a an the and or but if then than that this these those there here is are was were be been being am do does did doing done "
    "have has had having will would shall should can could may might must i we you he she it they them us our your his her its their my me "
    "of in on at to for with from by as into onto over under about not no nor so such very too also more most much many some any "
    "which who whom whose what when where why how while during it's don't doesn't isn't aren't wasn't weren't"
).split()
ABBREVIATIONS = (
    "e.g i.e etc vs cf approx fig figs eq eqs ref refs no nos vol dr mr mrs ms prof sr jr st inc ltd co corp dept univ "
    "al ca cca resp min max avg std temp conc a.w a.m p.m u.s u.k e.u"
).split()
FURNITURE = r"(?i)^\s*(?:page\s+)?\d{1,4}(?:\s*(?:/|of)\s*\d{1,4})?\s*$"
WORD_MARKS = ".,;:!?()[]{}\"'"
# Fixed value: where one sentence ends and the next begins.
BOUNDARY = r"""(?<=[.!?])["')\]]*\s+(?=["'(\[]*[A-Z0-9])"""


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _nfkc(c: Column) -> Column:
    import unicodedata

    return F.pandas_udf(lambda s: s.map(lambda x: unicodedata.normalize("NFKC", x) if x else x), "string")(c)


def fold_unicode(c: Column | str, nfkc: bool = False) -> Column:
    """Fold typographic characters to ASCII. ``nfkc`` first composes by NFKC, in an Arrow function; plain ASCII needs neither."""
    t = _text(c)
    if nfkc:
        t = F.when(t.rlike("[^\\x00-\\x7f]"), _nfkc(t)).otherwise(t)
    singles = "".join(FOLD_SINGLE) + FOLD_REMOVED
    t = F.translate(t, singles, "".join(FOLD_SINGLE.values()))
    for char, to in FOLD_LONG.items():
        t = F.replace(t, F.lit(char), F.lit(to))
    return t


def clean_text(c: Column | str, dehyphenate: bool = True, nfkc: bool = False) -> Column:
    """Normalise line ends, control characters, hyphenation and white space."""
    t = F.regexp_replace(fold_unicode(c, nfkc), "\r\n?", "\n")
    t = F.regexp_replace(t, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " ")
    if dehyphenate:
        t = F.regexp_replace(t, r"(?U)(\w)-\n(\w)", "$1$2")
    t = F.regexp_replace(t, r"[ \t\f\r]+", " ")
    t = F.regexp_replace(t, r"[ \t]+\n", "\n")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


_FOLDED = str.maketrans({**FOLD_SINGLE, **FOLD_LONG, **dict.fromkeys(FOLD_REMOVED)})


def clean(text: str, dehyphenate: bool = True) -> str:
    """As :func:`clean_text` with NFKC, of one text where files are parsed."""
    t = unicodedata.normalize("NFKC", text).translate(_FOLDED).replace("\r\n", "\n").replace("\r", "\n")
    t = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " ", t)
    if dehyphenate:
        t = re.sub(r"(\w)-\n(\w)", r"\1\2", t)
    t = re.sub(r"[ \t]+\n", "\n", re.sub(r"[ \t\f\r]+", " ", t))
    return re.sub(r"\n{3,}", "\n\n", t).strip()


def tokens(c: Column | str, lowercase: bool = True, nfkc: bool = False) -> Column:
    """All tokens in order; a text without any ASCII token falls back to runs of word characters."""
    t = fold_unicode(c, nfkc)
    found = F.regexp_extract_all(t, F.lit(TOKEN), 0)
    fallback = F.filter(F.split(t, r"(?U)\W+"), lambda x: x != "")
    # The variable of a list of one: written twice, the optimizer would search the text twice.
    found = F.transform(F.array(found), lambda x: F.when(F.size(x) > 0, x).otherwise(fallback))[0]
    return F.transform(found, F.lower) if lowercase else found


def unsplit(c: Column | str) -> list[Column]:
    """What :func:`split` makes :func:`tokens` of: the text or, where it has no ASCII letter or digit or is no UTF-8, its tokens."""
    t = _text(c)
    plain = F.is_valid_utf8(t) & t.rlike("[A-Za-z0-9]")
    # Names that no column has: inside a lambda Spark takes an alias of the same select for the column.
    return [F.when(plain, t).alias("_split_text"), F.when(~plain, tokens(t)).alias("_split_tokens")]


_TOKEN = re.compile(TOKEN.encode())
_FOLDS = re.compile(f"[{re.escape(''.join([*FOLD_SINGLE, *FOLD_LONG, *FOLD_REMOVED]))}]")


def values(array: pa.Array) -> list:
    """The strings of an array; several times as fast as ``to_pylist``."""
    return array.to_numpy(zero_copy_only=False).tolist()


def split(texts: pa.Array, lists: pa.Array) -> pa.ListArray:
    """The tokens of some texts where Python reads them. Bytes are searched: neither their case nor their classes know more than ASCII."""
    flat, ends = [], [0]
    for i, t in enumerate(values(texts.cast(pa.binary()))):
        if t is None:
            flat += lists[i].as_py()
        else:
            if not t.isascii() and _FOLDS.search(whole := t.decode()):
                t = whole.translate(_FOLDED).encode()
            flat += _TOKEN.findall(t.lower())
        ends.append(len(flat))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.string()))


def spans(sizes: np.ndarray, most_rows: int, most: int):
    """(start, stop) of rows with sizes of ``most`` together at most; a larger row stands alone."""
    start = held = 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and (held + n > most or i - start >= most_rows):
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def split_few(texts: pa.Array, lists: pa.Array, most_rows: int = 1 << 12, most_bytes: int = 1 << 20):
    """(first row, tokens) of a few rows at a time, so that what a worker holds does not grow with Arrow's batches."""
    for start, stop in spans(np.asarray(pc.fill_null(pc.binary_length(texts), 0)), most_rows, most_bytes):
        yield start, split(texts.slice(start, stop - start), lists.slice(start, stop - start))


def is_content(token: Column) -> Column:
    return (F.length(token) > 1) & ~token.isin(STOP_WORDS)


def content_tokens(c: Column | str, nfkc: bool = False) -> Column:
    """Tokens of two characters or more that are not stop words."""
    return F.filter(tokens(c, nfkc=nfkc), is_content)


def words(c: Column | str) -> Column:
    """White-space separated words."""
    return F.filter(F.split(_text(c), r"\s+"), lambda x: x != "")


def _word_cost(word: Column) -> Column:
    bare = F.btrim(word, F.lit(WORD_MARKS))
    n = F.greatest(F.length(bare), F.lit(1))
    return (1 + F.floor(F.greatest(n - 4, F.lit(0)) / 4) + (F.length(word) > F.length(bare)).cast("int")).cast("long")


def token_estimate(c: Column | str) -> Column:
    """Estimated model tokens: words by length, their attached marks, and half of the line breaks."""
    t = _text(c)
    total = F.aggregate(words(t), F.lit(0).cast("long"), lambda n, w: n + _word_cost(w))
    breaks = F.floor((F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))) / 2)
    return F.when(t == "", F.lit(0).cast("long")).otherwise(F.greatest(total + breaks, F.lit(1)).cast("long"))


def truncate_to_tokens(c: Column | str, limit: Column | int) -> Column:
    """The text if its estimate is within ``limit``, else its longest prefix of words that is, joined by spaces."""
    t, most = _text(c), limit if isinstance(limit, Column) else F.lit(limit)
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("taken"), F.lit(True).alias("open"))

    def step(s: Column, w: Column) -> Column:
        n = s["n"] + _word_cost(w)
        fits = s["open"] & (n <= most)
        return F.struct(n.alias("n"), (s["taken"] + fits.cast("int")).alias("taken"), fits.alias("open"))

    taken = F.aggregate(words(t), start, step, lambda s: s["taken"])
    return F.when(most <= 0, "").when(token_estimate(t) <= most, t).otherwise(F.array_join(F.slice(words(t), F.lit(1), taken), " "))


def raw_sentences(c: Column | str) -> Column:
    """Pieces between sentence boundaries, trimmed, empty ones left out; closing quotes at a boundary are swallowed."""
    t = F.replace(_text(c), F.lit("\n"), F.lit(" "))
    pieces = F.split(t, BOUNDARY)
    return F.filter(F.transform(pieces, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def sentences(c: Column | str, min_length: int = 2) -> Column:
    """Sentences: raw pieces, joined again after an abbreviation or a number that a full stop cut in two."""

    def step(done: Column, piece: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        final = F.lower(F.element_at(F.split(F.regexp_replace(last, r"\.+$", ""), r"\s+"), -1))
        short = last.endswith(".") & F.btrim(final, F.lit("([")).isin(ABBREVIATIONS)
        number = last.rlike(r"\b\d+\.$") & piece.rlike(r"^\d")
        joined = F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.concat_ws(" ", last, piece)))
        return F.when((F.size(done) > 0) & (short | number), joined).otherwise(F.array_append(done, piece))

    merged = F.aggregate(raw_sentences(c), F.array().cast("array<string>"), step)
    return F.filter(merged, lambda s: F.length(s) >= min_length)


def paragraphs(c: Column | str) -> Column:
    trimmed = F.transform(F.split(_text(c), r"\n\s*\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.filter(trimmed, lambda x: x != "")


def snippet(c: Column | str, limit: int = 240, suffix: str = "...") -> Column:
    """One line of at most ``limit`` characters, cut at its last space if that is past the middle."""
    flat = F.array_join(words(c), " ")
    head = F.substring(flat, 1, limit)
    space = F.length(head) - F.locate(" ", F.reverse(head))
    cut = F.when(head.contains(" ") & (space > limit * 0.5), F.substring(head, F.lit(1), space.cast("int"))).otherwise(head)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.regexp_replace(cut, r"[ ,;:.]+$", ""), F.lit(suffix)))


def highlight_spans(c: Column | str, terms: Column) -> Column:
    """Sorted (start, end) of terms longer than two characters that stand between non-alphanumerics."""
    t = F.lower(_text(c))
    wanted = F.array_distinct(F.transform(F.filter(terms, lambda x: F.length(x) > 2), F.lower))

    def of(term: Column) -> Column:
        parts = F.split(t, F.concat(F.lit("\\Q"), term, F.lit("\\E")), -1)
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        step = lambda s, p: F.struct((s["at"] + F.length(p) + F.length(term)).alias("at"), F.array_append(s["starts"], s["at"] + F.length(p)).alias("starts"))
        starts = F.aggregate(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), begin, step, lambda s: s["starts"])
        free = lambda x: ~x.rlike(r"(?U)[\p{L}\p{N}]")
        lone = F.filter(starts, lambda s: free(F.substring(F.concat(F.lit(" "), t), s + 1, F.lit(1))) & free(F.substring(t, s + F.length(term) + 1, F.lit(1))))
        return F.transform(lone, lambda s: F.struct(s.alias("start"), (s + F.length(term)).alias("end")))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(wanted, of))))


def is_furniture(line: Column) -> Column:
    """Whether a line is only a page number."""
    return _text(line).rlike(FURNITURE)


def strip_furniture(lines: Column) -> Column:
    return F.filter(lines, lambda x: ~is_furniture(x))


def legibility(c: Column | str, sample: int = 8000) -> Column:
    """Share of letters, digits, white space and common marks in the first ``sample`` characters; 0 for none."""
    head = F.substring(_text(c), 1, sample)
    prose = F.regexp_replace(head, r"""(?U)[^\p{L}\p{N}\s.,;:!?'"()%/\-]""", "")
    return F.when(head == "", 0.0).otherwise(F.length(prose) / F.length(head))


def shorten(c: Column | str, limit: int = 160) -> Column:
    flat = F.array_join(words(c), " ")
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.regexp_replace(F.substring(flat, 1, limit), r"\s+$", ""), F.lit("...")))


def _plain_letters() -> dict[str, str]:
    """By rule: letters of the Latin blocks that decompose into ASCII and marks, with what is left of them."""
    blocks = [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F)]
    found = {chr(i): unicodedata.normalize("NFKD", chr(i)).encode("ascii", "ignore").decode() for i in blocks}
    return {c: to for c, to in found.items() if to}


def slug(c: Column | str, limit: int = 60) -> Column:
    """Lower-case ASCII letters and digits joined by hyphens, accents dropped from their letters; "section" if nothing is left."""
    letters = _plain_letters()
    one = {a: b for a, b in letters.items() if len(b) == 1}
    t = F.translate(_text(c), "".join(one), "".join(one.values()))
    for a, b in letters.items():
        t = t if len(b) == 1 else F.replace(t, F.lit(a), F.lit(b))
    plain = F.lower(F.regexp_replace(t, "[^\\x00-\\x7f]", ""))
    dashed = F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    cut = F.regexp_replace(F.substring(dashed, 1, limit), "-+$", "")
    return F.when(cut == "", "section").otherwise(cut)


def section_number(c: Column | str) -> Column:
    """A leading number such as 2.1, or empty."""
    return F.regexp_extract(F.ltrim(_text(c)), r"^(\d+(?:\.\d+)*)[.)]?\s", 1)


def format_path(path: Column, separator: str = " > ") -> Column:
    return F.array_join(path, separator)


def page_label(start: Column, end: Column) -> Column:
    """p. 3 or pp. 3-5; empty without a page."""
    return F.when(start.isNull(), "").when(end.isNull() | (end <= start), F.concat(F.lit("p. "), start.cast("string"))).otherwise(F.concat(F.lit("pp. "), start.cast("string"), F.lit("-"), end.cast("string")))


def passage_label(title: Column, pages: Column, path: Column) -> Column:
    """Title, pages - path; parts that are empty are left out."""
    head = F.when(pages == "", title).otherwise(F.concat_ws(", ", title, pages))
    return F.when(_text(path) == "", head).otherwise(F.concat(head, F.lit(" - "), path))


def cite(sentence: Column, marker: Column) -> Column:
    """Put [marker] before the final mark; after the text if it ends in an ellipsis or without a mark."""
    bare = F.rtrim(sentence)
    tag = F.concat(F.lit(" ["), marker.cast("string"), F.lit("]"))
    ends = bare.rlike(r"[.!?]$") & ~bare.rlike(r"\.\.$")
    inner = F.rtrim(F.substring(bare, F.lit(1), F.length(bare) - 1))
    return F.when(ends, F.concat(inner, tag, F.right(bare, F.lit(1)))).otherwise(F.concat(bare, tag))


def human_size(n: Column) -> Column:
    """Bytes as B, KB, MB or GB, one decimal above bytes."""
    sized = lambda unit, name: F.concat(F.format_string("%.1f", F.floor(n * 10 / float(unit) + 0.5) / 10), F.lit(f" {name}"))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, sized(1024, "KB")).when(n < 1024**3, sized(1024**2, "MB")).otherwise(sized(1024**3, "GB"))


def content_type(name: Column) -> Column:
    # Media types of accepted files.
    known = {"pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "txt": "text/plain", "md": "text/markdown"}
    kind = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    found = F.lit("application/octet-stream")
    for k, v in known.items():
        found = F.when(kind == k, v).otherwise(found)
    return found


def last_question(c: Column | str) -> Column:
    """What stands after the last "Question:", trimmed."""
    return F.trim(F.substring_index(_text(c), "Question:", -1))


# Credential shapes, each with what replaces it.
REDACTED = "[REDACTED]"
CREDENTIALS = (
    (r"(?i)\b(bearer)\s+[A-Za-z0-9._~+/=-]{8,}", "$1 " + REDACTED),
    (r"""(?i)(["']?(?:api[_-]?key|apikey|secret|token|password|passwd|authorization)["']?\s*[:=]\s*["']?)[^\s"',;&\[]{4,}""", "$1" + REDACTED),
    (r"\bsk-[A-Za-z0-9_-]{8,}", REDACTED),
    (r"\bxox[abp]-[A-Za-z0-9-]{8,}", REDACTED),
    (r"\bgh[po]_[A-Za-z0-9]{8,}", REDACTED),
    (r"\bAIza[A-Za-z0-9_-]{8,}", REDACTED),
)


def redact(c: Column | str) -> Column:
    """Replace what looks like a credential; redacted text is left as it is."""
    t = _text(c)
    for pattern, to in CREDENTIALS:
        t = F.regexp_replace(t, pattern, to)
    return t
