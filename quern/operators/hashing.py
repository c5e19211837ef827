"""Lexical hash vectors: features of stems, pairs and character runs, hashed with a sign into a fixed width."""

from __future__ import annotations

import math
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text
from quern.functions.scores import sublinear_tf
from quern.functions.stem import stem_word

# The feature space. Families: w content words, s stop words, b neighbouring pairs, c runs of four characters.
# Runs are of a text's first MOST_GRAM_TOKENS long words, or of all where a caller passes None.
DIM, GRAM, GRAM_TOKEN, MOST_GRAM_TOKENS = 1024, 4, 5, 400
WEIGHTS = {"w": 1.0, "s": 0.25, "b": 0.6, "c": 0.35}
#: Keys the digests of features; vectors of different keys do not compare.
KEY = b"lexical-1"
#: Tokens, rows and vector components that are worked on at a time: what a worker holds does not grow with Arrow's batches.
TOKENS_AT_ONCE, ROWS_AT_ONCE, CELLS_AT_ONCE = 1 << 17, 1 << 12, 1 << 20


def few(make, most_rows: int = ROWS_AT_ONCE):
    """What ``make`` gives of ids and lists of tokens, a few rows at a time, over batches of an id and what ``text.unsplit`` selects."""

    def run(batches):
        for batch in batches:
            for first, lists in text.split_few(batch.column(1), batch.column(2), most_rows):
                for start, stop in _spans(_lengths(lists), most_rows):
                    yield make(batch.column(0).slice(first + start, stop - start), lists.slice(start, stop - start))

    return run


def _per_row(rows: DataFrame, id_column: str, text_column: str, schema: str, make, most_rows: int = ROWS_AT_ONCE) -> DataFrame:
    """What ``make`` gives of ids and lists of tokens, a few rows at a time."""
    texts = rows.select(F.col(id_column), *text.unsplit(text_column))
    return texts.mapInArrow(few(make, most_rows), f"`{id_column}` {texts.schema[id_column].dataType.simpleString()}, {schema}")


def hash_features(rows: DataFrame, id_column: str, text_column: str, most_gram_tokens: int | None = MOST_GRAM_TOKENS) -> DataFrame:
    """(id, feature, n): the feature multiset of each row's text; features open with their family and a colon."""

    def make(ids, lists):
        found = list(_features(lists, most_gram_tokens))
        at, n = (pa.array(np.concatenate([f[i] for f in found])) for i in (1, 3))
        return pa.RecordBatch.from_arrays([ids.take(at), pa.concat_arrays([names.take(pa.array(code)) for names, _, code, _ in found]), n], names=[id_column, "feature", "n"])

    return _per_row(rows, id_column, text_column, "feature string, n bigint", make)


def weighted_features(features: DataFrame) -> DataFrame:
    """Features with their family and weight: the family's weight times 1 + ln(n)."""
    family = F.substring("feature", 1, 1)
    weight = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])[family]
    return features.withColumn("family", family).withColumn("weight", weight * sublinear_tf(F.col("n")))


def hash_embed(rows: DataFrame, id_column: str, text_column: str, dim: int = DIM, key: bytes = KEY, most_gram_tokens: int | None = MOST_GRAM_TOKENS) -> DataFrame:
    """(id, vector array<float>) of length one for each row; texts without tokens have a zero vector.

    The least bit of a feature's digest is its sign, the rest its bucket. A row's features are hashed where the row is, each once for the
    rows that are worked on together; a task keeps the digests of words and runs, and nothing is shuffled.
    """
    return _per_row(rows, id_column, text_column, "vector array<float>", vectors(id_column, dim, key, most_gram_tokens), rows_of(dim))


def rows_of(dim: int) -> int:
    return min(ROWS_AT_ONCE, max(1, CELLS_AT_ONCE // dim))


def vectors(id_column: str, dim: int, key: bytes, most_gram_tokens: int | None = MOST_GRAM_TOKENS):
    """What :func:`hash_embed` makes of ids and lists of tokens."""
    weights = {ord(family): w for family, w in WEIGHTS.items()}
    known = _Digests(key)

    def make(ids, lists):
        cells = np.zeros(len(ids) * dim, dtype=np.float64)
        for names, row, code, n in _features(lists, most_gram_tokens):
            names = text.values(names.cast(pa.binary()))
            if names and names[0][0] == ord("b"):  # pairs seldom come again
                digests = [known.digest(f) for f in names]
            else:
                digests = [known[f] for f in names]
                known.trim()
            digests = np.frombuffer(b"".join(digests), dtype="<u8").astype(np.uint64)
            place = ((digests >> np.uint64(1)) % np.uint64(dim)).astype(np.int64)
            weight = np.array([weights[f[0]] for f in names])
            weight = np.where(digests & np.uint64(1), -weight, weight)
            times = np.flatnonzero(np.bincount(n))
            damped = np.zeros(n.max(initial=0) + 1)
            damped[times] = [1 + math.log(x) for x in times.tolist()]
            np.add.at(cells, row * dim + place[code], weight[code] * damped[n])
        cells = cells.reshape(len(ids), dim)
        norm = np.sqrt((cells**2).sum(axis=1, keepdims=True))
        unit = np.divide(cells, norm, out=np.zeros_like(cells), where=norm > 0).astype(np.float32)
        return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * dim), pa.array(unit.reshape(-1)))], names=[id_column, "vector"])

    return make


_STOPS = frozenset(text.STOP_WORDS)


class _Digests(dict):
    """Digests of features by their bytes, made when first asked for."""

    def __init__(self, key: bytes):
        self.key, self.begun = key, blake2b(key=key, digest_size=8).copy

    def digest(self, feature: bytes) -> bytes:
        h = self.begun()
        h.update(feature)
        return h.digest()

    def __missing__(self, feature: bytes) -> bytes:
        self[feature] = digest = self.digest(feature)
        return digest

    def __reduce__(self):
        return _Digests, (self.key,)

    def trim(self, most: int = 1 << 18) -> None:
        if len(self) > most:
            self.clear()


def _lengths(lists: pa.Array) -> np.ndarray:
    return np.asarray(lists.value_lengths()).astype(np.int64)


def _spans(lengths: np.ndarray, most_rows: int):
    """(start, stop) of rows with ``TOKENS_AT_ONCE`` tokens together at most; a longer row stands alone."""
    return text.spans(lengths, most_rows, TOKENS_AT_ONCE)


def _counted(names, row: np.ndarray, code: np.ndarray, times: np.ndarray | None = None):
    """(names, row, code, n) of each feature of each row once, by first appearance; each counts once or as many times as ``times`` has."""
    width = max(1, len(names))
    found, first, at = np.unique(row * width + code, return_index=True, return_inverse=True)
    order = np.argsort(first)
    return names, found[order] // width, found[order] % width, np.bincount(at, times, len(found))[order].astype(np.int64)


def _features(lists: pa.Array, most_gram_tokens: int | None = MOST_GRAM_TOKENS):
    """The features of some rows' tokens as :func:`_counted` gives them: words, then pairs, then runs of characters."""
    lengths, coded = _lengths(lists), lists.flatten().dictionary_encode()
    row, at = np.repeat(np.arange(len(lengths)), lengths), np.asarray(coded.indices).astype(np.int64)
    tokens = text.values(coded.dictionary)
    stems = [stem_word(t) for t in tokens]

    words = pa.array([("s:" if t in _STOPS else "w:") + s for t, s in zip(tokens, stems)], pa.string()).dictionary_encode()
    yield _counted(words.dictionary, row, np.asarray(words.indices).astype(np.int64)[at])

    stems = pa.array(stems, pa.string()).dictionary_encode()
    code, width, inside = np.asarray(stems.indices).astype(np.int64)[at], max(1, len(stems.dictionary)), row[1:] == row[:-1]
    pairs, pair = np.unique((code[:-1] * width + code[1:])[inside], return_inverse=True)
    head, tail = (stems.dictionary.take(pa.array(x)) for x in (pairs // width, pairs % width))
    yield _counted(pc.binary_join_element_wise(pc.binary_join_element_wise("b", head, ":"), tail, " "), row[1:][inside], pair)

    long = np.fromiter((len(t) >= GRAM_TOKEN and t not in _STOPS for t in tokens), dtype=bool, count=len(tokens))[at]
    if most_gram_tokens is not None:
        before = np.concatenate([[0], np.cumsum(long)])
        long &= before[1:] - np.repeat(before[np.cumsum(lengths) - lengths], lengths) <= most_gram_tokens
    # A word's runs are made once for each row that has it, so they grow with a text's distinct words.
    _, row, at, times = _counted(tokens, row[long], at[long])
    used = np.unique(at)
    joined = "".join(f"^{tokens[t]}$" for t in used.tolist())
    size, start = np.zeros(len(tokens), np.int64), np.zeros(len(tokens), np.int64)
    size[used] = [len(tokens[t]) + 3 - GRAM for t in used.tolist()]
    start[used] = np.cumsum(size[used] + GRAM - 1) - size[used] - GRAM + 1
    points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
    # Numbers of characters, of two characters and so of four: those of two at a place and of two at the place after next.
    numbers = np.unique(points, return_inverse=True)[1].astype(np.int64)
    for step in (1, 2):
        numbers = np.unique(numbers[:-step] * (numbers.max(initial=0) + 1) + numbers[step:], return_index=True, return_inverse=True)[1:]
        first, numbers = numbers[0], numbers[1].astype(np.int64)
    runs, code = np.unique(numbers[_places(start[used], size[used])], return_inverse=True)
    begun = np.cumsum(size[used]) - size[used]
    start[used] = begun
    yield _counted(pa.array(["c:" + joined[i : i + GRAM] for i in first[runs].tolist()], pa.string()), np.repeat(row, size[at]), code[_places(start[at], size[at])], np.repeat(times, size[at]))


def _places(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size."""
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


def explain_vector(rows: DataFrame, id_column: str, text_column: str, most: int = 12) -> DataFrame:
    """(id, feature, weight, place): the heaviest features of each text, ties by name."""
    w = Window.partitionBy(id_column).orderBy(F.col("weight").desc(), "feature")
    return weighted_features(hash_features(rows, id_column, text_column)).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).select(id_column, "feature", F.bround("weight", 6).alias("weight"), "place")
