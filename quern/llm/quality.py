"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

Only the text is an input of a score. Statistics are taken once for every document; labelled rows add up normal
equations by partition, one sum for each fold, so that a model without a fold is a difference of sums. Scores of rows by the
model that has not seen them calibrate the model of all folds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.rows import located
from quern.session import materialise

#: Partitions that sum labelled rows, and bins of calibration.
SUM_PARTITIONS, BINS = 6, 400
_SYMBOLS = b"!?.,;:|$%&*#@_-+=/\\<>[]{}()\"'~^"
_GROUPS = (b"!", b"?", b".", b",", b";:", b"|", b"$", b"%", b"&", b"*", b"#", b"@", b"_-", b"+=<>^~", b"/\\", b"[]{}()", b"\"'")
NAMES = ["log_words", "log_bytes", "word_length", "word_spread", "long_words", "upper", "lower", "digit", "wide", "white", "control", "distinct_words", "top_word", "log_lines", "line_length", "distinct_lines", "open_lines", "title_words", "shout_words", "mixed_words"] + [f"sign_{g.decode()}" for g in _GROUPS]


def statistics(text: bytes) -> list[float]:
    """The statistics of one text, in the order of NAMES; shares are of bytes, words or lines.

    An empty text has zeros only.
    """
    if not text:
        return [0.0] * len(NAMES)
    seen = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    n = len(text)
    words = text.split()
    w = max(1, len(words))
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=len(words)) if words else np.zeros(1)
    counts: dict[bytes, int] = {}
    for word in words:
        counts[word] = counts.get(word, 0) + 1
    lines = [x for x in text.split(b"\n") if x.strip()]
    m = max(1, len(lines))
    titles = sum(k for x, k in counts.items() if x[:1].isupper())
    shouts = sum(k for x, k in counts.items() if x.isupper() and len(x) > 1)
    signs = sum(k for x, k in counts.items() if x[-1] in _SYMBOLS and x[-1] not in b".,?!;:\"')")
    return [
        math.log1p(len(words)), math.log1p(n), float(lengths.mean()), float(lengths.std()), float((lengths > 14).mean()),
        seen[65:91].sum() / n, seen[97:123].sum() / n, seen[48:58].sum() / n, seen[128:].sum() / n, (seen[32] + seen[9:14].sum()) / n, (seen[:9].sum() + seen[14:32].sum()) / n,
        len(counts) / w, max(counts.values(), default=0) / w, math.log1p(len(lines)), math.log1p(n / m), len(set(lines)) / m, sum(x.rstrip()[-1:] not in b".!?" for x in lines) / m,
        titles / w, shouts / w, signs / w,
        *(sum(int(seen[b]) for b in g) / w for g in _GROUPS),
    ]


def document_statistics(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, carried columns, x array<float>) of every row of whole texts; null counts as empty."""
    kinds = [docs.schema[c].dataType.simpleString() for c in (id_column, *carry)]
    names = ["id", *(f"k{i}" for i in range(len(carry)))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip((id_column, *carry), names)], F.col(text_column).cast("binary").alias("text"))

    def compute(batches):
        import pyarrow as pa

        for batch in batches:
            x = np.array([statistics(t.as_py() or b"") for t in batch.column(len(names))], dtype=np.float32).reshape(-1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(NAMES)), pa.array(x))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=[*names, "x"])

    return rows.mapInArrow(compute, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)) + ", x array<float>")


def isotonic(position: np.ndarray, weight: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the least-squares increasing function: pooled adjacent violators, each pool at its mean position."""
    pools: list[list[float]] = []
    for x, w, y in zip(position, weight, value):
        pools.append([w * x, w, w * y])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    x, w, y = np.array(pools).T
    return x / w, y / w


@dataclass(frozen=True)
class QualityModel:
    """Everything that a score needs; a few hundred kilobytes at most."""

    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        """sqrt(2 / D) cos(w . x + b), whose inner products approximate a Gaussian kernel, and a one."""
        z = np.clip((x.astype(np.float64) - self.mean) / self.scale, -6, 6)
        d = len(self.phases)
        return np.hstack([math.sqrt(2 / d) * np.cos(z @ self.frequencies + self.phases), np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated chance of label 1, from 0 to 1."""
        if not len(self.knots):
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.features(x) @ self.weights, self.knots, self.values), 0, 1)


def _stack(batch, column: int) -> np.ndarray:
    return np.asarray(batch.column(column).flatten(), dtype=np.float64).reshape(batch.num_rows, -1)


def fit(rows: DataFrame, features: int = 256, width: float = 1.0, ridge: float = 0.1, folds: int = 4, seed: int = 11, most_labels: int = 60_000) -> QualityModel:
    """Fit on rows (id, x array<float>, label double); of more than ``most_labels`` a hash sample of about that many.

    ``width`` scales the kernel's usual width, the root of the number of statistics. Without rows every score is 0.5;
    labels of one kind give that label's score.
    """
    n = rows.count()
    share = min(1.0, most_labels / max(1, n))
    ranked = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30))
    sample = rows.filter(ranked < int(share * (1 << 30))) if share < 1 else rows
    sample = materialise(sample.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(folds)).cast("int")).select("x", "label", "fold").repartition(SUM_PARTITIONS), "labelled")
    size = len(NAMES)
    sums = sample.select(F.count(F.lit(1)), *[F.avg(F.col("x")[i]) for i in range(size)], *[F.stddev_pop(F.col("x")[i]) for i in range(size)]).first()
    none = np.zeros(0)
    if not sums[0]:
        return QualityModel(np.zeros(size), np.ones(size), np.zeros((size, 1)), np.zeros(1), np.zeros(2), none, none)
    mean, scale = np.array(sums[1 : size + 1], dtype=float), np.array(sums[size + 1 :], dtype=float)
    rng = np.random.default_rng(seed)
    blank = QualityModel(mean, np.where(scale > 1e-9, scale, 1.0), rng.normal(size=(size, features)) / (width * math.sqrt(size)), rng.uniform(0, 2 * math.pi, features), none, none, none)

    def add_up(batches):
        import pyarrow as pa

        gram, right = np.zeros((folds, features + 1, features + 1)), np.zeros((folds, features + 1))
        for batch in batches:
            z, y, fold = blank.features(_stack(batch, 0)), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for k in range(folds):
                part = z[fold == k]
                gram[k] += part.T @ part
                right[k] += part.T @ y[fold == k]
        yield pa.RecordBatch.from_pydict({"fold": pa.array(range(folds), pa.int32()), "gram": [g.tobytes() for g in gram], "right": [r.tobytes() for r in right]})

    gram, right = np.zeros((folds, features + 1, features + 1)), np.zeros((folds, features + 1))
    for r in sample.mapInArrow(add_up, "fold int, gram binary, right binary").collect():  # SUM_PARTITIONS * folds rows
        gram[r.fold] += np.frombuffer(r.gram).reshape(features + 1, -1)
        right[r.fold] += np.frombuffer(r.right)

    def solve(g: np.ndarray, b: np.ndarray) -> np.ndarray:
        penalty = np.full(features + 1, ridge)
        penalty[-1] = 1e-6  # the constant is not shrunk
        return np.linalg.solve(g + np.diag(penalty), b)

    whole = solve(gram.sum(axis=0), right.sum(axis=0))
    without = np.array([solve(gram.sum(axis=0) - gram[k], right.sum(axis=0) - right[k]) for k in range(folds)])

    def unseen(batches):
        import pyarrow as pa

        hits, ones = np.zeros(BINS, dtype=np.int64), np.zeros(BINS)
        for batch in batches:
            s = (blank.features(_stack(batch, 0)) * without[batch.column(2).to_numpy()]).sum(axis=1)
            at = np.clip(((s + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
            hits += np.bincount(at, minlength=BINS)
            ones += np.bincount(at, weights=batch.column(1).to_numpy(), minlength=BINS)
        yield pa.RecordBatch.from_pydict({"bin": pa.array(range(BINS), pa.int32()), "n": hits, "ones": ones})

    bins = sample.mapInArrow(unseen, "bin int, n bigint, ones double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")).filter("n > 0").orderBy("bin").collect()
    n, ones, at = (np.array([r[c] for r in bins], dtype=float) for c in ("n", "ones", "bin"))
    knots, values = isotonic((at + 0.5) / BINS * 2 - 0.5, n, ones / n)
    return QualityModel(mean, blank.scale, blank.frequencies, blank.phases, whole, knots, values)


def score(stats: DataFrame, model: QualityModel) -> DataFrame:
    """Rows of :func:`document_statistics` with their score in the place of x."""
    kept = [f for f in stats.schema.fields if f.name != "x"]
    names = [f.name for f in kept]

    def compute(batches):
        import pyarrow as pa

        for batch in batches:
            s = model.score(_stack(batch, len(names))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s, pa.float64())], names=[*names, "score"])

    return stats.select(*names, "x").mapInArrow(compute, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", score double")


def held_out(id_column) -> F.Column:
    """Whether crc32 of the id as text leaves 0 by 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def quality_scores(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", carry: tuple[str, ...] = (), **options) -> DataFrame:
    """(id, held_out, score, predicted, carried columns as k0, k1...) of every row, by a model fitted on the labels of rows not held out.

    ``options`` are those of :func:`fit`, the bound on its labelled rows among them. Null and empty texts are scored by their (zero)
    statistics. Null labels teach nothing; an id that is labelled more than once has the mean. Null ids are scored. Repeated rows give
    repeated rows; an empty table an empty result; other columns, language and source among them, are not read.
    """
    stats = materialise(document_statistics(docs, id_column, text_column, carry), "statistics")
    taught = labels.filter(F.col(label_column).isNotNull() & F.col(id_column).isNotNull() & ~held_out(F.col(id_column)))
    taught = taught.groupBy(F.col(id_column).alias("k")).agg(F.avg(F.col(label_column).cast("double")).alias("label"))
    model = fit(stats.join(taught, F.col("id") == F.col("k")).select("id", "x", "label"), **options)
    kept = [f"k{i}" for i in range(len(carry))]
    return score(stats, model).select("id", held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), *kept)


def keep_good(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are predicted to be good, with its columns.

    Each row is judged by its own text; null and empty texts by the score of zero statistics, and repeated rows alike. Null ids are
    judged like others. An empty table gives an empty result; columns of any name are handed on.
    """
    rows, file, place = located(docs)
    scored = quality_scores(rows, labels, id_column, text_column, carry=(file, place), **options)
    bad = scored.filter("predicted = 0").select(F.col("k0").alias(file), F.col("k1").alias(place))
    return rows.join(bad, [file, place], "left_anti").select(*docs.columns)
