"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared in tiles: numpy exclusive-or and bit counts of one block of a class against a block of the
same or a neighbouring class. Classes are population counts by segment of the fingerprint (or sizes); tile pairs whose
counts differ by more than the radius are never formed.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from fractions import Fraction
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.components import connected_components
from quern.llm.rows import located
from quern.session import materialise

#: Rows of a tile's two sides, about; shingles that are hashed at a time; compared pairs at a time.
TILE_LEFT, TILE_RIGHT, SHINGLES_AT_ONCE, PAIRS_AT_ONCE = 8192, 16384, 1 << 15, 1 << 20
#: Rows and shingles of a block of sets, about.
BLOCK_SETS, BLOCK_SHINGLES = 1024, 1 << 21
#: Odd multipliers of the words after the first, by rule.
_MIXERS = np.array([(0x9E3779B97F4A7C15 * (2 * j + 3) ^ (0xC2B2AE3D27D4EB4F << j)) % (1 << 64) | 1 for j in range(31)], dtype=np.uint64)


def shingle_hashes(words: list[bytes], width: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of every run of ``width`` words joined by spaces, in blocks; of all words if they are fewer."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    if not words:
        return
    if len(words) < width:
        yield np.array([digest(b" ".join(words), 42)], dtype=np.uint64)
        return
    n = len(words) - width + 1
    for k in range(0, n, SHINGLES_AT_ONCE):
        part = words[k : min(k + SHINGLES_AT_ONCE, n) + width - 1]
        joined = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), dtype=np.int64, count=len(part)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        yield np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[: len(part) - width + 1].tolist(), ends[width - 1 :].tolist())), dtype=np.uint64, count=len(part) - width + 1)


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """The distinct shingle hashes of a text in ascending order."""
    found = list(shingle_hashes(text.lower().split(), width))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.uint64)


def fingerprint(text: bytes, width: int, bits: int = 64, distinct: bool = False) -> tuple[bytes, int]:
    """(little-endian bytes of a fingerprint, number of shingles): a bit is 1 if set in over half of the hashes.

    Bits beyond the first 64 come from the same hashes, multiplied by odd constants and folded. With ``distinct`` each
    shingle votes and counts once, however often the text repeats it.
    """
    return _vote(_slices(shingle_set(text, width)) if distinct else shingle_hashes(text.lower().split(), width), bits)


def _slices(hashes: np.ndarray) -> Iterator[np.ndarray]:
    for k in range(0, len(hashes), SHINGLES_AT_ONCE):
        yield hashes[k : k + SHINGLES_AT_ONCE]


def _vote(blocks: Iterable[np.ndarray], bits: int) -> tuple[bytes, int]:
    ones, n = np.zeros(bits, dtype=np.int64), 0
    for h in blocks:
        wide = np.empty((len(h), bits // 64), dtype="<u8")
        wide[:, 0] = h
        for j in range(1, bits // 64):
            x = h * _MIXERS[j - 1]
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            wide[:, j] = x ^ (x >> np.uint64(32))
        ones += np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        n += len(h)
    return np.packbits(ones * 2 > n, bitorder="little").tobytes(), n


def fingerprints(docs: DataFrame, width: int, bits: int = 64, id_column: str = "doc_id", text_column: str = "text", distinct: bool = False, place: tuple[str, str] | None = None) -> DataFrame:
    """(id[, file, place], word, sig binary, n[, set]) of every row; word is the first 64 bits of sig, set (only if ``distinct``) a hash of the set of shingles.

    A-Z are lower-cased, words are runs of bytes other than space and 0x09 to 0x0D. Null texts count as empty; texts
    without words have a fingerprint of zeros and no shingles. ``place`` names columns of ``docs`` that tell its rows apart.
    """
    keys = ["id", *(["file", "place"] if place else [])]
    kinds = [f"id {docs.schema[id_column].dataType.simpleString()}", *(["file string", "place bigint"] if place else [])]
    rows = docs.select(*[F.col(c).alias(k) for c, k in zip((id_column, *(place or ())), keys)], F.col(text_column).cast("binary").alias("text"))

    def compute(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            found, named = [], []
            for t in batch.column(len(keys)):
                if distinct:
                    hashes = shingle_set(t.as_py() or b"", width)
                    named.append(xxhash.xxh64_intdigest(hashes.tobytes(), 42))
                    found.append(_vote(_slices(hashes), bits))
                else:
                    found.append(fingerprint(t.as_py() or b"", width, bits))
            words = [int.from_bytes(s[:8], "little", signed=True) for s, _ in found]
            columns = [*batch.columns[:-1], pa.array(words, pa.int64()), pa.array([s for s, _ in found], pa.binary()), pa.array([n for _, n in found], pa.int64())]
            if distinct:
                columns.append(pa.array(np.array(named, dtype=np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "word", "sig", "n", "set"][: len(columns)])

    return rows.mapInArrow(compute, ", ".join(kinds) + ", word bigint, sig binary, n bigint" + ", set bigint" * distinct)


@dataclass(frozen=True)
class Rule:
    """Which fingerprints link: at most ``radius`` differing bits and, if set, sizes n of at least ``ratio`` to each other."""

    radius: int
    ratio: float = 0.0
    #: Bits of the first words (three at most) that may differ before the others are looked at.
    first_radius: int = 64
    first_words: int = 1
    #: The radius by the larger size n, if it depends on that; the last one holds beyond.
    radii: tuple[int, ...] = ()

    def near(self, differing: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether so many bits may differ between sizes x and y."""
        return differing <= (np.array(self.radii)[np.minimum(np.maximum(x, y), len(self.radii) - 1).astype(np.int64)] if self.radii else self.radius)

    def classes(self, word: Column, n: Column) -> tuple[Column, list[int]]:
        """A class number, and what to subtract from it for the classes (itself first) that a row must meet as the right side."""
        if self.ratio:
            return F.when(n > 0, F.floor(F.log(n.cast("double")) / -math.log(self.ratio)) + 1).otherwise(0).cast("long"), [0, 1]
        # Population counts of four 16-bit segments: linked fingerprints differ by at most the radius in their sum.
        base, code = 64, F.lit(0).cast("long")
        for s in range(4):
            code = code * base + F.bit_count(F.shiftrightunsigned(word, 16 * s).bitwiseAND(0xFFFF)) + 20
        steps = [d for d in product(range(-self.radius, self.radius + 1), repeat=4) if 0 < sum(map(abs, d)) <= self.radius]
        codes = sorted(((d[0] * base + d[1]) * base + d[2]) * base + d[3] for d in steps)
        return code, [0, *(c for c in codes if c > 0)]


def _merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give linked positions the smallest label that they reach."""
    while len(a):
        ra, rb = labels[a], labels[b]
        apart = ra != rb
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(labels, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while True:
            deeper = labels[labels]
            if (deeper == labels).all():
                break
            labels[:] = deeper


def tile_links(left: tuple, right: tuple, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """A forest that links what the pairs (left, right) within the rule link: no more links than rows.

    Each side is (ids, sigs as (rows, words) uint64, n).
    """
    ids = np.concatenate([left[0], right[0]])
    # Rows of both sides are one node: label by the smallest position of an id.
    _, position, inverse = np.unique(ids, return_index=True, return_inverse=True)
    labels = position[inverse]
    m = len(left[0])
    step = max(1, PAIRS_AT_ONCE // max(1, len(right[0])))
    for k in range(0, m, step):
        block = slice(k, min(k + step, m))
        differing = sum(np.bitwise_count(left[1][block, w][:, None] ^ right[1][:, w][None, :]) for w in range(rule.first_words))
        a, b = np.nonzero(differing <= min(rule.radius, rule.first_radius))
        a += k
        keep = left[0][a] != right[0][b]
        if rule.ratio:
            x, y = left[2][a], right[2][b]
            keep &= np.minimum(x, y) >= rule.ratio * np.maximum(x, y) - 1e-9
        a, b = a[keep], b[keep]
        if left[1].shape[1] > 1 and len(a):
            keep = rule.near(np.bitwise_count(left[1][a] ^ right[1][b]).sum(axis=1, dtype=np.int64), left[2][a], right[2][b])
            a, b = a[keep], b[keep]
        _merge(labels, a, b + m)
    linked = ids[labels] != ids
    return ids[linked], ids[labels[linked]]


def _tiles(batches: Iterable) -> Iterator[tuple]:
    """Sides of each tile from batches that are sorted by tile."""
    held: list = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        tile, side = batch.column("tile").to_numpy(), batch.column("side").to_numpy()
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype="<u8").reshape(len(tile), -1)
        columns = (side, batch.column("id").to_numpy(), sig, batch.column("n").to_numpy())
        cuts = [0, *(np.flatnonzero(np.diff(tile)) + 1).tolist(), len(tile)]
        for a, b in zip(cuts, cuts[1:]):
            if key is not None and tile[a] != key:
                yield _sides(held)
                held = []
            key = tile[a]
            held.append(tuple(c[a:b] for c in columns))
    if held:
        yield _sides(held)


def _sides(held: list) -> tuple:
    side, ids, sig, n = (np.concatenate(c) for c in zip(*held))
    return tuple((ids[side == s], sig[side == s], n[side == s]) for s in (0, 1))


def similar_links(nodes: DataFrame, rule: Rule) -> DataFrame:
    """(u, v): links that join nodes (id, word, sig, n) into the components of the rule.

    The number of tiles follows the classes' counts (at most 65 classes to the fourth power, or one for each step of
    sizes), so tiles stay bounded however many rows a class holds: a class with more rows is cut into blocks, and all pairs of blocks
    that could link meet. Tasks emit a forest for each tile, never all pairs of a group.
    """
    code, steps = rule.classes(F.col("word"), F.col("n"))
    nodes = nodes.withColumn("cls", code)
    counts = nodes.groupBy("cls").agg(F.count(F.lit(1)).alias("rows"))
    meets = counts.select(F.explode(F.array(*[F.col("cls") - s for s in steps])).alias("cls"), "rows").groupBy("cls").agg(F.sum("rows").alias("right_rows"))
    plan = counts.join(meets, "cls").select(
        F.col("cls").alias("meeting"), F.ceil(F.col("rows") / TILE_LEFT).cast("int").alias("lefts"), F.ceil(F.col("right_rows") / TILE_RIGHT).cast("int").alias("rights")
    )
    plan = materialise(plan, "tiles")
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    deal = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "id"), n).cast("int")
    lefts = nodes.join(plan, F.col("cls") == F.col("meeting")).select("meeting", "id", "sig", "n", F.lit(0).alias("side"), deal(1, F.col("lefts")).alias("i"), upto(F.col("rights")).alias("j"))
    reach = nodes.select("id", "sig", "n", F.explode(F.array(*[F.col("cls") - s for s in steps])).alias("target"))
    rights = reach.join(plan, F.col("target") == F.col("meeting")).select("meeting", "id", "sig", "n", F.lit(1).alias("side"), deal(2, F.col("rights")).alias("j"), upto(F.col("lefts")).alias("i"))
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tile = F.xxhash64("meeting", "i", "j").alias("tile")
    dealt = lefts.unionByName(rights).select(tile, "side", "id", "sig", "n").repartition(parts, "tile").sortWithinPartitions("tile")

    def compare(batches):
        import pyarrow as pa

        for left, right in _tiles(batches):
            u, v = tile_links(left, right, rule)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return dealt.mapInArrow(compare, "u bigint, v bigint")


def near_duplicate_components(docs: DataFrame, width: int, rule: Rule, bits: int = 64, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, word, sig, n, component_id) of every row; component_id is the smallest id reachable by links.

    Equal fingerprints (and sizes, if the rule has a ratio) are one node, so groups of copies cost one row. Null and
    empty texts share the zero fingerprint and link like any other. Null ids take part, but a component is
    named after its smallest id that is not null (null if it has none). Repeated rows give repeated rows; an empty
    table an empty result; other columns are not read.
    """
    rows = materialise(fingerprints(docs, width, bits, id_column, text_column), "fingerprints")
    # A 64-bit fingerprint names its node; longer ones, and those with sizes, are named by a hash.
    node = F.col("word") if bits == 64 and not rule.ratio else F.xxhash64("sig", "n")
    rows = rows.withColumn("node", node)
    nodes = materialise(rows.groupBy("node").agg(F.min("id").alias("least"), F.first("word").alias("word"), F.first("sig").alias("sig"), F.first("n").alias("n")), "nodes")
    roots = connected_components(similar_links(nodes.select(F.col("node").alias("id"), "word", "sig", "n"), rule)).withColumnRenamed("id", "k")
    rooted = materialise(nodes.join(roots, F.col("node") == F.col("k"), "left").select("node", "least", F.coalesce("root", "node").alias("root")), "rooted")
    named = materialise(rooted.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "r"), "named")
    # Plain scans on both sides of each join: Spark splits the nodes of a large component, and the rows of a fingerprint that many share.
    labels = materialise(rooted.join(named, F.col("root") == F.col("r")).select(F.col("node").alias("k"), "component_id"), "labels")
    return rows.join(labels, F.col("node") == F.col("k"), "left").select("id", "word", "sig", "n", "component_id")


def differing_shares(similarity: float, most: int = 64) -> list[float]:
    """By the size n of the larger set, up to ``most``: the largest chance that a bit differs between fingerprints of sets that overlap by ``similarity``.

    Exact, from the binomial votes; a last entry, the largest of the upper half, stands for all larger sets.
    """
    least = Fraction(str(similarity))
    shares = [0.0]
    votes = [[math.comb(n, i) / 2.0**n for i in range(n + 1)] for n in range(most + 1)]
    over = lambda n, need: sum(votes[n][max(0, need) :])
    for b in range(1, most + 1):
        worst = 0.0
        for a in range(math.ceil(b * least), b + 1):
            c = math.ceil(least * (a + b) / (1 + least))
            if c > a or (a == b == c):
                continue
            chances = [(over(a - c, a // 2 + 1 - s), over(b - c, b // 2 + 1 - s)) for s in range(c + 1)]
            worst = max(worst, sum(v * (x * (1 - y) + y * (1 - x)) for v, (x, y) in zip(votes[c], chances)))
        shares.append(worst)
    return [*shares, max(shares[most // 2 :])]


def candidate_rule(similarity: float, bits: int, deviations: float = 5) -> Rule:
    """Radii so many standard deviations above what sets of this overlap differ by at most, on average."""
    upper = lambda n, p: min(n, math.ceil(n * p + deviations * math.sqrt(n * p * (1 - p))))
    shares, first = differing_shares(similarity), min(2, bits // 64)
    radii = tuple(upper(bits, p) for p in shares)
    return Rule(max(radii), similarity, upper(64 * first, max(shares)), first, radii)


def shared(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many hashes of each of ``others`` the sorted set ``one`` has."""
    whole = np.concatenate([*others, one[:0]])
    cuts = np.cumsum([0, *map(len, others)])
    at = np.minimum(np.searchsorted(one, whole), max(len(one) - 1, 0))
    hits = np.concatenate([[0], np.cumsum(one[at] == whole)]) if len(one) else np.zeros(len(whole) + 1, dtype=np.int64)
    return hits[cuts[1:]] - hits[cuts[:-1]]


def overlap_links(left: tuple, right: tuple, rule: Rule, similarity: float, right_is_one: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A forest that links what the pairs (left, right) of overlap ``similarity`` or more link, among pairs near by ``rule``.

    Each side is (ids, sigs as (rows, words) uint64, n, sets of sorted hashes). Pairs that are linked already are not looked
    at again, so a group of near copies takes one comparison a row, not one a pair. ``right_is_one``: the right side is linked among itself.
    """
    least = Fraction(str(similarity))
    ids, sig, n = (np.concatenate([x, y]) for x, y in zip(left[:3], right[:3]))
    sets = [*left[3], *right[3]]
    _, position, inverse = np.unique(ids, return_index=True, return_inverse=True)
    labels = position[inverse]
    m, u, v = len(left[0]), [], []
    if right_is_one:
        labels[m:] = m
    for a in range(m):
        open_ = m + np.flatnonzero(labels[m:] != labels[a])
        x, y = np.minimum(n[open_], n[a]), np.maximum(n[open_], n[a])
        open_ = open_[x * least.denominator >= y * least.numerator]
        open_ = open_[rule.near(np.bitwise_count(sig[open_] ^ sig[a]).sum(axis=1, dtype=np.int64), n[open_], n[a])]
        # Of each group that a is not in, one member is compared, then two, four and so on until one links.
        tries = 1
        while len(open_):
            order = np.argsort(labels[open_], kind="stable")
            open_ = open_[order]
            starts = np.flatnonzero(np.diff(labels[open_], prepend=-1))
            place = np.arange(len(open_)) - np.repeat(starts, np.diff([*starts, len(open_)]))
            now = open_[place < tries]
            both = shared(sets[a], [sets[i] for i in now])
            for i in now[both * least.denominator >= least.numerator * (n[a] + n[now] - both)]:
                if labels[i] != labels[a]:
                    u.append(ids[a])
                    v.append(ids[i])
                    labels[labels == labels[i]] = labels[a]
            open_ = open_[place >= tries]
            open_ = open_[labels[open_] != labels[a]]
            tries *= 2
    return np.array(u, dtype=np.int64), np.array(v, dtype=np.int64)


def _blocks(n: Column, rows: Column) -> Column:
    """Blocks for rows and their shingles in all."""
    return F.greatest(F.ceil(rows / BLOCK_SETS), F.ceil(n / BLOCK_SHINGLES)).cast("int")


def _block_of(blocks: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(3), "node"), F.greatest(blocks, F.lit(1))).cast("int")


def verified_links(docs: DataFrame, nodes: DataFrame, rule: Rule, width: int, similarity: float, place: tuple[str, str], text_column: str) -> DataFrame:
    """(u, v): links that join nodes (node, first (file, place), word, sig, n) into the components of pairs with a true overlap of ``similarity`` or more.

    Fingerprints give candidates and their components; only rows of those are read again. In a component of more than one block every row is
    compared with one of them, the hub: a large group of near copies is settled by that, one comparison a row. Rows that the hub does not
    settle meet each other, and those that it does, in pairs of blocks of bounded size. Decided by the sets of shingles themselves.
    """
    least = Fraction(str(similarity))
    # Smaller sets overlap by so much only if they are equal, and equal sets are one node.
    able = nodes.filter(F.col("n") * (least.denominator - least.numerator) >= least.numerator)
    roots = connected_components(similar_links(able.select(F.col("node").alias("id"), "word", "sig", "n"), rule)).withColumnRenamed("id", "_k")
    members = materialise(able.join(roots, F.col("node") == F.col("_k")).select("root", "node", "first", "sig", "n"), "candidates")
    sizes = materialise(members.groupBy(F.col("root").alias("_r")).agg(_blocks(F.sum("n"), F.count(F.lit(1))).alias("blocks"), F.min("node").alias("hub")), "component-sizes")
    texts = docs.select(F.col(place[0]).alias("_f"), F.col(place[1]).alias("_p"), F.col(text_column).cast("binary").alias("text"))
    held = members.join(sizes, F.col("root") == F.col("_r")).drop("_r")
    held = held.join(texts, (F.col("first.file") == F.col("_f")) & (F.col("first.place") == F.col("_p")))
    held = materialise(held.select("root", "node", "sig", "n", "blocks", "hub", "text"), "candidate-texts")
    columns = ["tile", "side", "node", "sig", "n", "text"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    deal = lambda rows: rows.select(columns).repartition(parts, "tile").sortWithinPartitions("tile", "side")

    if sizes.filter("blocks > 1").isEmpty():
        settled = docs.sparkSession.createDataFrame([], "u bigint, v bigint")
        rest = held.select("*", F.lit(False).alias("settled"), F.col("blocks").alias("opens"), F.lit(0).alias("closed"))
    else:
        large = held.filter("blocks > 1")
        hubs = large.filter("node = hub").withColumn("i", upto(F.col("blocks"))).withColumn("side", F.lit(0))
        others = large.filter("node <> hub").withColumn("i", _block_of(F.col("blocks"))).withColumn("side", F.lit(1))
        settled = materialise(deal(hubs.unionByName(others).withColumn("tile", F.xxhash64("root", "i"))).mapInArrow(_meet_hub(width, least), "u bigint, v bigint"), "hub-links")
        known = settled.select(F.col("u").alias("_u")).unionByName(settled.select(F.col("v").alias("_u")).distinct())
        rest = materialise(held.join(known, F.col("node") == F.col("_u"), "left").withColumn("settled", F.col("_u").isNotNull()).drop("_u"), "unsettled")
        counts = rest.groupBy(F.col("root").alias("_r")).agg(*[_blocks(F.coalesce(F.sum(F.when(F.col("settled") == s, F.col("n"))), F.lit(0)), F.count_if(F.col("settled") == s)).alias(name) for s, name in ((False, "opens"), (True, "closed"))])
        rest = rest.join(materialise(counts.filter("opens > 0"), "unsettled-sizes"), F.col("root") == F.col("_r")).drop("_r")
    opens = rest.filter("not settled").withColumn("i", _block_of(F.col("opens")))
    among = opens.withColumn("j", upto(F.col("opens"))).withColumn("tile", F.xxhash64("root", F.least("i", "j"), F.greatest("i", "j"))).withColumn("side", F.when(F.col("i") < F.col("j"), 0).when(F.col("i") > F.col("j"), 1).otherwise(2))
    across = opens.filter("closed > 0").withColumn("j", upto(F.col("closed"))).withColumn("side", F.lit(0))
    across = across.unionByName(rest.filter("settled").withColumn("j", _block_of(F.col("closed"))).withColumn("i", upto(F.col("opens"))).withColumn("side", F.lit(3)))
    pairs = among.select(columns).unionByName(across.withColumn("tile", F.xxhash64("root", "i", "j", F.lit("closed"))).select(columns))

    def compare(batches):
        import pyarrow as pa

        for rows in _sets(batches, width):
            closed = rows[-1][0] == 3
            sides = [tuple(np.array(c) if k < 3 else list(c) for k, c in enumerate(zip(*(r[1:] for r in rows if r[0] in s)))) for s in ((0, 2), (1, 2, 3))]
            if all(sides):
                u, v = overlap_links(*sides, rule, similarity, closed)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return deal(pairs).mapInArrow(compare, "u bigint, v bigint").unionByName(settled)


def _meet_hub(width: int, least: Fraction):
    """Links (u, hub) of rows that overlap with the hub of their tile; a tile's hub comes first."""

    def meet(batches):
        import pyarrow as pa

        tile = hub = None
        for batch in batches:
            linked = []
            for t, side, node, _, n, text in zip(*(batch.column(c) for c in range(batch.num_columns))):
                words = shingle_set(text.as_py() or b"", width)
                if side.as_py() == 0:
                    tile, hub, of_hub = t.as_py(), node.as_py(), words
                    continue
                assert tile == t.as_py()
                both = int(shared(of_hub, [words])[0])
                if both * least.denominator >= least.numerator * (len(of_hub) + n.as_py() - both):
                    linked.append((node.as_py(), hub))
            if linked:
                u, v = zip(*linked)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return meet


def _sets(batches: Iterable, width: int) -> Iterator[list]:
    """The rows (side, node, sig, n, set) of each tile from batches that are sorted by tile."""
    held, key = [], None
    for batch in batches:
        names = ("tile", "side", "node", "sig", "n", "text")
        for tile, side, node, sig, n, text in zip(*(batch.column(c) for c in names)):
            tile = tile.as_py()
            if held and tile != key:
                yield held
                held = []
            key = tile
            held.append((side.as_py(), node.as_py(), np.frombuffer(sig.as_py(), dtype="<u8"), n.as_py(), shingle_set(text.as_py() or b"", width)))
    if held:
        yield held


def keep_one_of_each(docs: DataFrame, width: int = 5, similarity: float = 0.8, bits: int = 1024, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates, with its columns: of each component the row with the smallest id stays.

    Texts link if their sets of ``width``-word shingles overlap by ``similarity`` (Jaccard) or more. Fingerprints only find
    candidates, within five standard deviations of the most that such sets differ by on average; each link is decided by the
    sets. Texts of equal sets are one; so are null and empty texts and those without words. Null ids go last; of rows that share the
    smallest id of their component exactly one stays, whatever their other columns hold. An empty table gives an empty
    result; columns of any name are handed on.
    """
    rule = candidate_rule(similarity, bits)
    rows, *place = located(docs)
    found = fingerprints(rows, width, bits, id_column, text_column, distinct=True, place=place).withColumnRenamed("set", "node")
    found = materialise(found, "fingerprints")
    first = F.min(F.struct(F.col("id").isNull().alias("late"), "id", "file", "place")).alias("first")
    nodes = materialise(found.groupBy("node").agg(first, F.first("word").alias("word"), F.first("sig").alias("sig"), F.first("n").alias("n")), "nodes")
    roots = connected_components(verified_links(rows, nodes, rule, width, similarity, place, text_column)).withColumnRenamed("id", "_k")
    rooted = nodes.select("node", "first").join(roots, F.col("node") == F.col("_k"), "left").select(F.coalesce("root", "node").alias("root"), "first")
    stays = rooted.groupBy("root").agg(F.min("first").alias("s")).select(F.col("s.file").alias(place[0]), F.col("s.place").alias(place[1]))
    return rows.join(stays, place, "left_semi").select(*docs.columns)
