"""Scores and vector arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters of the scoring functions.
K1, B = 1.2, 0.75
RANK_DAMPING, PROXIMITY_HORIZON = 10, 60
RERANK_WEIGHTS = {"coverage": 0.40, "proximity": 0.20, "phrase": 0.10, "heading": 0.05, "prior": 0.25}


def _doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(_doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def l2_normalise(v: Column) -> Column:
    """A vector of length one; a zero vector stays."""
    n = norm(v)
    return F.when(n > 0, F.transform(_doubles(v), lambda x: x / n)).otherwise(_doubles(v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine, held to [-1, 1]; 0 with a zero vector."""
    n = norm(a) * norm(b)
    return F.when(n > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / n))).otherwise(0.0)


def sublinear_tf(count: Column) -> Column:
    return F.when(count > 0, 1 + F.log(count.cast("double"))).otherwise(0.0)


def confidence(similarity: Column) -> Column:
    return F.bround((similarity + 1) / 2, 6)


def band(similarity: Column) -> Column:
    return F.when(similarity >= 0.55, "strong").when(similarity >= 0.28, "moderate").otherwise("weak")


def bm25_idf(n: Column, df: Column) -> Column:
    """Never negative."""
    return F.when((n > 0) & (df > 0), F.log(1 + (n - df + 0.5) / (df + 0.5))).otherwise(0.0)


def textbook_idf(n: Column, df: Column) -> Column:
    """The classical form; what is not positive becomes 1e-6."""
    raw = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(raw > 0, raw).otherwise(1e-6)


def bm25_tf(tf: Column, length: Column, mean_length: Column, k1: float = K1, b: float = B) -> Column:
    share = F.when(mean_length > 0, length / mean_length).otherwise(0.0)
    return F.when(tf > 0, tf * (k1 + 1) / (tf + k1 * (1 - b + b * share))).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all, as sets; 0 if both are empty."""
    n = F.size(F.array_union(a, b))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(0.0)


def containment(wanted: Column, held: Column) -> Column:
    """Share of ``wanted``, as a set, that ``held`` has; 0 if nothing is wanted."""
    n = F.size(F.array_distinct(wanted))
    return F.when(n > 0, F.size(F.array_intersect(wanted, held)) / n).otherwise(0.0)


def term_coverage(query: Column, passage: Column) -> Column:
    return F.bround(containment(query, passage), 4)


def bigrams(terms: Column) -> Column:
    """Neighbouring terms as one string each."""
    return F.zip_with(F.slice(terms, F.lit(1), F.greatest(F.size(terms) - 1, F.lit(0))), F.slice(terms, F.lit(2), F.greatest(F.size(terms) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))


def phrase_overlap(query: Column, passage: Column) -> Column:
    """Share of the query's distinct neighbouring pairs that are neighbours in the passage; 0 without a pair."""
    return F.bround(containment(bigrams(query), bigrams(passage)), 4)


def let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.transform(F.array(value), body)[0]


def proximity(query: Column, passage: Column, horizon: int = PROXIMITY_HORIZON) -> Column:
    """How close together the passage holds all the query terms that it has: 1 side by side, 0 beyond the horizon.

    One pass over the matched positions keeps each term's last; the narrowest span that ends at any position is the least.
    """

    def of(wanted: Column) -> Column:
        matched = F.filter(F.transform(passage, lambda t, i: F.struct(i.alias("at"), F.array_position(wanted, t).cast("int").alias("term"))), lambda m: m["term"] > 0)
        begin = F.struct(F.transform(wanted, lambda _: F.lit(-1)).alias("last"), F.lit(1 << 30).alias("best"))

        def step(s: Column, m: Column) -> Column:
            last = F.transform(s["last"], lambda x, k: F.when(k + 1 == m["term"], m["at"]).otherwise(x))
            return let(last, lambda v: F.struct(v.alias("last"), F.least(s["best"], let(F.array_min(v), lambda low: F.when(low >= 0, m["at"] - low + 1).otherwise(1 << 30))).alias("best")))

        n = F.size(wanted)
        spread = lambda best: F.when(best <= n, 1.0).when(best >= horizon, 0.0).otherwise(F.bround(1 - (best - n) / (horizon - n).cast("double"), 4))
        return F.when(n == 0, 0.0).when(n == 1, 0.5).otherwise(let(F.aggregate(matched, begin, step, lambda s: s["best"]), spread))

    return let(F.array_intersect(query, passage), of)


def rank_prior(rank: Column, damping: int = RANK_DAMPING) -> Column:
    return F.lit(float(damping)) / (damping + F.greatest(rank, F.lit(1)) - 1)


def sentence_score(query: Column, sentence: Column, rank: Column) -> Column:
    """Share of the question's terms in a sentence, with a little for passages that rank high; 0 without terms."""
    return F.when(F.size(sentence) > 0, containment(query, sentence) + 0.06 / F.greatest(rank, F.lit(1))).otherwise(0.0)
