"""Mixing sources to target weights by pivotal dependent rounding over a reduction tree, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.rows import fresh, located
from quern.session import materialise

#: Items whose fractions one reducer pairs, and residuals that meet at each further level of the tree.
FAN_IN = 48


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than space and U+0009 to U+000D; null has none."""
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), "[^\\x20\\x09-\\x0D]+", "w")
    return F.length(F.regexp_replace(squeezed, "[^w]", "")).cast("long")


def _positions(sources: DataFrame) -> DataFrame:
    """Sources (source, ...) with their place from 0 by code point, null last: a range sort, and bases from prefix sums over its parts."""
    placed = sources.withColumn("_late", F.col("source").isNull()).repartitionByRange("_late", "source").sortWithinPartitions("_late", "source").drop("_late")
    placed = materialise(placed.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_row")), "sources")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    bases = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return placed.join(bases, "_part").withColumn("at", F.col("_row") + F.col("_base")).drop("_part", "_row", "_base")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_copies: int = 3) -> DataFrame:
    """(source, source_size, target, copies) by source from rows of (source, size).

    Sources by code point, null last, take the weights in turn and share the sum of all sizes. A target stops at
    ``most_copies`` times its source's size and the excess goes to the others by weight, until none is above: a target is
    min(level * weight, cap), and the level rises, a sum over the sources at a time, until no further source is capped.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("at") % len(weights) + 1).cast("int"))
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    capped = materialise(_positions(by_source).select("source", "source_size", weight.cast("double").alias("weight"), (F.col("source_size") * most_copies).alias("cap")), "caps")
    level, n_capped = 0.0, -1
    while True:
        over = F.col("cap") < F.col("weight") * level
        total = capped.agg(F.sum("source_size").alias("all"), F.sum(F.when(over, F.col("cap"))).alias("held"), F.sum(F.when(~over, F.col("weight"))).alias("open"), F.count_if(over).alias("n")).first()
        if total.n == n_capped or not total.open:
            break
        level, n_capped = (total["all"] - (total.held or 0)) / total.open, total.n
    target = F.least(F.col("cap").cast("double"), F.col("weight") * level)
    return capped.select("source", "source_size", target.alias("target")).withColumn(
        "copies", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    )


def _uniform(*columns: Column) -> Column:
    """A number in (0, 1) that depends on the columns only."""
    return (F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") + 0.5) / float(1 << 53)


def _identity(key: Column) -> list[Column]:
    """What the random numbers of an item depend on: not on how its row was dealt out."""
    return [key["id"], key["h"], key["salt"]]


def _pivot(seed: int, level: int):
    """The step of the fold: meet the residual with the next item and settle one of the two."""

    def step(state: Column, item: Column) -> Column:
        held = state["held"]
        # Masses in words: item i holds p_i * s_i of at most s_i. Moving words keeps their sum.
        to_item = F.least(held["mass"], item["size"] - item["mass"])
        to_held = F.least(item["mass"], held["size"] - held["mass"])
        u = _uniform(F.lit(seed), F.lit(level), *_identity(held["key"]), *_identity(item["key"]), F.size(state["done"]))
        move = F.when(u * (to_item + to_held) < to_held, to_item).otherwise(-to_held)
        a, b = held["mass"] - move, item["mass"] + move
        # The side that reached a bound: compare against the amount moved, not against rounded masses.
        held_settles = F.when(move >= 0, held["mass"] <= item["size"] - item["mass"]).otherwise(held["size"] - held["mass"] <= item["mass"])
        held_full, item_full = move < 0, move >= 0
        settled_held = F.struct(held["key"].alias("key"), held_full.alias("extra"))
        settled_item = F.struct(item["key"].alias("key"), item_full.alias("extra"))
        with_mass = lambda x, m: F.struct(x["key"].alias("key"), x["size"].alias("size"), F.greatest(F.lit(0.0), F.least(m, x["size"])).alias("mass"))
        return F.when(
            held.isNull(), F.struct(state["done"].alias("done"), with_mass(item, item["mass"]).alias("held"))
        ).otherwise(
            F.struct(
                F.array_append(state["done"], F.when(held_settles, settled_held).otherwise(settled_item)).alias("done"),
                F.when(held_settles, with_mass(item, b)).otherwise(with_mass(held, a)).alias("held"),
            )
        )

    return step


def pivotal_rounding(items: DataFrame, seed: int = 7, fan_in: int = FAN_IN) -> DataFrame:
    """(key, extra) for items of (grp, key, size double, mass double), 0 < mass < size: extra says which become whole.

    Within a group, the sum of sizes of whole items differs from the sum of masses by less than one item, and each
    item is whole with probability mass / size. Items are dealt by hash into reducers of about ``fan_in``; each
    reducer settles all of its items but one, and the residuals meet at the next level, ``fan_in`` at a time, until
    a group has one left, which is drawn by itself. Each level is written to the shared folder.
    """
    counts = items.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    chunks = F.greatest(F.lit(1), F.ceil(F.col("n") / fan_in)).cast("long")
    spark = items.sparkSession
    current = (
        items.join(counts.select(F.col("grp").alias("g2"), chunks.alias("chunks")), F.col("grp").eqNullSafe(F.col("g2")))
        .drop("g2")
        .withColumn("chunk", F.pmod(F.xxhash64(F.lit(seed), *_identity(F.col("key"))), F.col("chunks")))
    )
    item_type = "struct<key:struct<id:bigint,h:bigint,salt:bigint,row:bigint>,size:double,mass:double>"
    done_type = "array<struct<key:struct<id:bigint,h:bigint,salt:bigint,row:bigint>,extra:boolean>>"
    empty = F.struct(F.from_json(F.lit("[]"), done_type).alias("done"), F.lit(None).cast(item_type).alias("held"))
    settled, level = [], 0
    while True:
        gathered = current.groupBy("grp", "chunk", "chunks").agg(F.sort_array(F.collect_list(F.struct(F.xxhash64(F.lit(seed + 1), *_identity(F.col("key"))).alias("o"), "key", "size", "mass"))).alias("items"))
        state = gathered.select("grp", "chunk", "chunks", F.aggregate("items", empty, _pivot(seed, level)).alias("state"))
        state = materialise(state, f"pivotal-{level}")
        settled.append(state.select(F.explode("state.done").alias("x")).select("x.key", "x.extra"))
        open_ = state.filter("chunks > 1")
        last = state.filter("chunks <= 1 and state.held is not null").select(F.col("state.held").alias("x"))
        settled.append(last.select("x.key", (_uniform(F.lit(seed), F.lit(-1), *_identity(F.col("x.key"))) * F.col("x.size") < F.col("x.mass")).alias("extra")))
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, settled)
        current = open_.filter("state.held is not null").select(
            "grp", F.col("state.held.key").alias("key"), F.col("state.held.size").alias("size"), F.col("state.held.mass").alias("mass"),
            F.expr(f"chunk div {fan_in}").alias("chunk"), F.ceil(F.col("chunks") / fan_in).cast("long").alias("chunks"),
        )
        level += 1


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", weights: tuple[int, ...] = (1, 2, 3), most_copies: int = 3, seed: int = 7, place: tuple[str, str] | None = None) -> DataFrame:
    """Copies of every document in a mix of all sources: (key struct<id,h,salt,row>, id, size, source_size, target, copies[, file, place]).

    A document's expected copies are its source's target over its source's size, at most ``most_copies``. The whole
    part is certain; the fractions are rounded together by :func:`pivotal_rounding`, so each source's words come
    within one document of its target. Random numbers are hashes of ids and texts, so reruns agree; only rows that are
    equal in both also depend on their place in the input.
    Null and empty texts have size 0 and are drawn one by one, as they hold no words. A null source is a source; null
    ids are kept; repeated rows are separate items; an empty table gives an empty result; extra columns are not read.
    ``place`` names columns of ``docs`` that tell its rows apart; they are handed on.
    """
    named = [F.col(c).alias(n) for c, n in zip(place or (), ("file", "place"))]
    held = ["file", "place"][: len(named)]
    rows = docs.select(
        *named,
        F.struct(F.col(id_column).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_column), F.lit(""))).alias("h")).alias("k"),
        F.col(source_column).cast("string").alias("source"), word_count(F.col(text_column)).alias("size"),
    )
    rows = materialise(rows.select("k", F.monotonically_increasing_id().alias("row"), "source", "size", *held), "mix-rows")
    repeated = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("k").alias("k2"), F.lit(True).alias("many"))
    # Equal rows are told apart by a number, so that many of them spread over the reducers; others depend on nothing else.
    rows = rows.join(repeated, (F.col("k.h") == F.col("k2.h")) & F.col("k.id").eqNullSafe(F.col("k2.id")), "left").select(
        F.struct("k.id", "k.h", F.when(F.col("many"), F.col("row")).otherwise(F.lit(0)).cast("long").alias("salt"), "row").alias("key"), "source", "size", *held
    )
    targets = source_targets(rows, weights, most_copies)
    # One row for each source: Spark broadcasts it below its own threshold and splits skewed sources beyond.
    placed = rows.join(targets.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    whole = F.least(F.floor("copies"), F.lit(most_copies)).cast("long")
    placed = placed.withColumn("whole", whole).withColumn("fraction", F.col("copies") - F.col("whole"))
    open_ = (F.col("size") > 0) & (F.col("fraction") > 1e-12) & (F.col("fraction") < 1 - 1e-12)
    items = placed.filter(open_).select(F.col("source").alias("grp"), "key", F.col("size").cast("double").alias("size"), (F.col("fraction") * F.col("size")).alias("mass"))
    rounded = pivotal_rounding(items, seed).withColumnRenamed("key", "k2")
    drawn = placed.join(rounded, F.col("key.row") == F.col("k2.row"), "left")
    alone = F.when(F.col("size") > 0, F.col("fraction") >= 1 - 1e-12).otherwise(_uniform(F.lit(seed), F.col("key.id"), F.col("key.h")) < F.col("fraction"))
    return drawn.select(
        "key", F.col("key.id").alias(id_column), "size", "source_size", "target", (F.col("whole") + F.coalesce(F.col("extra"), alone).cast("long")).alias("copies"), *held
    )


def apply_mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The mixed rows of ``docs``: every row as often as the mix takes it, with the columns of ``docs``.

    Each row is an item of its own, also where ids, texts or whole rows repeat or ids are null. Null and empty texts have size 0 and are
    drawn one by one; a null source is a source. An empty table gives an empty result; columns of any name are handed on.
    """
    rows, *place = located(docs)
    copies, copy = fresh(rows, "_copies", "_copy")
    taken = mix(rows, id_column, text_column, place=place, **options).filter("copies > 0")
    taken = taken.select(F.col("file").alias(place[0]), F.col("place").alias(place[1]), F.col("copies").cast("int").alias(copies))
    return rows.join(taken, place).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)
