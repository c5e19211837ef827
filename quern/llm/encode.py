"""Byte-level BPE through the tokenizers library, one encoding for each distinct word.

A byte-level vocabulary with the standard splitting pattern never joins text across a single space that has
non-space on both sides: the next token starts with that space. Texts are cut there, each distinct word is encoded
once, and ids are gathered with numpy. A single line break between two words is cut before as well (the word then starts
with it), and a comma or full stop after a letter or digit is a token of its own at a word's end. Texts with other white space (runs, or at an end) go to the library
in whole, as does everything under a vocabulary file of another kind.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

#: Counts as a space in old Unicode tables only.
_OLD_SPACE = "\u180e"
_SAFE_CUT = re.compile("(?<=[^\\s\u180e]) (?=[^\\s\u180e])")
#: Characters of a text that are split off at a time.
SEGMENT_CHARS = 1 << 20
#: Words that the cache of one Python worker holds at most; a full cache starts anew.
CACHE_WORDS = 800_000


def safe_segments(text: str, size: int = SEGMENT_CHARS) -> list[str]:
    """Cut a text at safe single spaces into parts of about ``size`` characters; each later part keeps its space.

    Where no safe space follows, the rest stays whole: the ids never change.

    >>> safe_segments("aa bb cc", 3)
    ['aa bb', ' cc']
    """
    parts, start = [], 0
    while len(text) - start > size:
        cut = _SAFE_CUT.search(text, start + size)
        if cut is None:
            break
        parts.append(text[start : cut.start()])
        start = cut.start()
    parts.append(text[start:])
    return parts


def _regular(text: str) -> bool:
    """Whether every white space is one character between two others."""
    words = text.split()
    return sum(map(len, words)) + max(0, len(words) - 1) == len(text) and _OLD_SPACE not in text


class _Index(dict):
    """Numbers words in the order met; ``fresh`` holds those that are new."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.fresh.append(word)
        return number


class WordEncoder:
    """Token ids or token counts of texts, equal to ``Tokenizer.encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens") or []
        self.by_word = (
            spec.get("normalizer") is None
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space")
            and all(not (a["lstrip"] or a["rstrip"] or a["single_word"] or " " in a["content"]) for a in added)
        )
        vocabulary = self.library.get_vocab()
        self.opens_word = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        self.opens_word[[i for token, i in vocabulary.items() if token.startswith("Ġ") or token == "Ċ"]] = True
        self.marks = {m: self._library_ids([m])[0] for m in ",."} if self.by_word else {}
        self.cache_words = cache_words
        self._reset()

    def _reset(self) -> None:
        self.index = _Index()
        self.lengths = np.zeros(0, dtype=np.int64)
        self.starts = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)

    def _library_ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self) -> None:
        """Encode the fresh words, each with a space before it, many to a call."""
        words, number = self.index.fresh, self.index.__getitem__
        # A mark at the end of a word: its stem is looked up (and learned, at the end of the list) by itself.
        marked = [(k, w[-1], number(w[:-1])) for k, w in enumerate(words) if w[-1:] in self.marks and w[-2:-1].isalnum()]
        self.index.fresh = []
        base = len(self.index) - len(words)
        is_marked = np.zeros(len(words), dtype=bool)
        is_marked[[k for k, *_ in marked]] = True
        plain = [w for w, m in zip(words, is_marked.tolist()) if not m]
        ids, lengths = [], []
        for k in range(0, len(plain), 2000):
            block = plain[k : k + 2000]
            (got,) = self._library_ids(["".join(w if w[:1] == "\n" else " " + w for w in block)])
            first = np.flatnonzero(self.opens_word[got])
            if len(first) != len(block):  # cannot happen for such vocabularies; the library decides
                each = self._library_ids([w if w[:1] == "\n" else " " + w for w in block])
                got, n = np.concatenate(each), np.array([len(x) for x in each])
            else:
                n = np.diff(np.append(first, len(got)))
            ids.append(got)
            lengths.append(n)
        # Plain words stand one after another; marked words are their stem's ids and the mark's.
        n_plain = np.concatenate([*lengths, np.zeros(0, dtype=np.int64)])
        new_lengths, new_starts = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        new_lengths[~is_marked] = n_plain
        new_starts[~is_marked] = len(self.ids) + np.cumsum(n_plain) - n_plain
        self.ids = np.concatenate([self.ids, *ids])
        self.lengths, self.starts = np.concatenate([self.lengths, new_lengths]), np.concatenate([self.starts, new_starts])
        if marked:
            at, marks, stems = (np.array(x) for x in zip(*((base + k, self.marks[m][0], stem) for k, m, stem in marked)))
            n, begin = self.lengths[stems], self.starts[stems]
            self.lengths[at] = n + 1
            ends = np.cumsum(n + 1)
            self.starts[at] = len(self.ids) + ends - n - 1
            block = np.empty(int(ends[-1]), dtype=np.uint32)
            last = np.zeros(len(block), dtype=bool)
            last[ends - 1] = True
            block[last] = marks
            block[~last] = self.ids[np.repeat(begin - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
            self.ids = np.concatenate([self.ids, block])

    def _encode(self, texts: list[str], want_ids: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """Token counts by text and, if wanted, all ids in order."""
        units: list[tuple[int, str]] = []
        whole: list[bool] = []
        for i, text in enumerate(texts):
            plain = not self.by_word or not _regular(text)
            for part in safe_segments(text) if self.by_word and len(text) > SEGMENT_CHARS else [text]:
                units.append((i, part))
                whole.append(plain)
        direct = [k for k, plain in enumerate(whole) if plain]
        direct_ids = dict(zip(direct, self._library_ids([units[k][1] for k in direct]))) if direct else {}
        heads, bodies, body_of = [], [], []
        for k, (_, part) in enumerate(units):
            if not whole[k]:
                head, *words = part.replace("\n", " \n").split(" ")
                heads.append(head)
                bodies.append(words)
                body_of.append(k)
        head_ids = self._library_ids(heads) if heads else []
        flat = [w for words in bodies for w in words]
        if len(self.index) > self.cache_words:
            self._reset()
        at = np.fromiter(map(self.index.__getitem__, flat), dtype=np.int64, count=len(flat))
        if self.index.fresh:
            self._learn()
        lengths = self.lengths[at] if len(at) else np.zeros(0, dtype=np.int64)
        counts = np.zeros(len(texts), dtype=np.int64)
        ends = np.cumsum([len(words) for words in bodies]) if bodies else np.zeros(0, dtype=np.int64)
        sums = np.concatenate([[0], np.cumsum(lengths)])
        n_units = np.zeros(len(units), dtype=np.int64)
        for j, k in enumerate(body_of):
            begin = ends[j - 1] if j else 0
            n_units[k] = len(head_ids[j]) + sums[ends[j]] - sums[begin]
        for k, got in direct_ids.items():
            n_units[k] = len(got)
        np.add.at(counts, np.array([i for i, _ in units], dtype=np.int64), n_units)
        if not want_ids:
            return counts, None
        total = int(lengths.sum())
        body_ids = self.ids[np.repeat(self.starts[at] - sums[:-1], lengths) + np.arange(total)] if total else np.zeros(0, dtype=np.uint32)
        out, j = [np.zeros(0, dtype=np.uint32)], 0
        for k in range(len(units)):
            if whole[k]:
                out.append(direct_ids[k])
            else:
                begin = ends[j - 1] if j else 0
                out += [head_ids[j], body_ids[sums[begin] : sums[ends[j]]]]
                j += 1
        return counts, np.concatenate(out)

    def counts(self, texts: list[str]) -> np.ndarray:
        return self._encode(texts, False)[0]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token counts by text, and the ids of all texts one after another (uint32)."""
        counts, ids = self._encode(texts, True)
        return counts, ids


@lru_cache(maxsize=1)
def worker_encoder(path: str) -> WordEncoder:
    """One encoder for all tasks of a Python worker, so that words stay known from task to task."""
    return WordEncoder(path)


def byte_balanced(rows: Iterable[tuple], size: int = 4 << 20, text_at: int = -1) -> Iterator[list[tuple]]:
    """Group rows so that their texts hold about ``size`` bytes of UTF-8 together, whatever their number."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        text = row[text_at]
        n += (len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))) + 64
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def text_list(column) -> list[str]:
    """The strings of an Arrow column; null is empty, bytes that are not UTF-8 become U+FFFD."""
    try:
        return [x or "" for x in column.to_pylist()]
    except UnicodeDecodeError:
        import pyarrow as pa

        return [(x or b"").decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]
