"""Packing documents into sequences of bounded length by bin completion.

Bins are planned for the histogram of piece lengths, which has at most as many entries as a sequence has tokens,
whatever the number of documents: a filling is chosen around the largest length left and used as often as
the counts allow. Ranks within a length, from prefix sums over partitions, then tell each piece its bin.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.encode import byte_balanced, text_list, worker_encoder
from quern.llm.token_files import _with_end
from quern.session import materialise

#: A filling as (length, how many) from large to small, and how many bins have it.
Plan = list[tuple[tuple[tuple[int, int], ...], int]]

#: Nodes that the search visits after its first descent, and fillings and steps that one node looks at.
NODES, FILLINGS, STEPS = 2000, 12, 400


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing, with bins of equal content held once with their number."""
    rooms: dict[int, list[list]] = {}  # room left -> [[content, bins]]
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            room = min((r for r in rooms if r >= size), default=None)
            if room is None:
                content, bins, room = (), -(-left // (capacity // size)), capacity
            else:
                content, bins = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
            each = room // size
            full = min(bins, left // each)
            for n, k in ((full, each), (1 if full < bins and left % each and left < each * (full + 1) else 0, left - each * full)):
                if n and k:
                    rooms.setdefault(room - k * size, []).append([content + ((size, k),), n])
                    left -= n * k
                    bins -= n
            if bins and content:
                rooms.setdefault(room, []).append([content, bins])
    return [(content, bins) for held in rooms.values() for content, bins in held]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs: by total length, and with pieces over half (which never share a bin) apart."""
    total = sum(s * n for s, n in counts.items())
    bound = -(-total // capacity)
    for small in range(0, capacity // 2 + 1, max(1, capacity // 64)):
        alone = sum(n for s, n in counts.items() if s > capacity - small)
        large = [(s, n) for s, n in counts.items() if capacity / 2 < s <= capacity - small]
        rest = sum(s * n for s, n in counts.items() if small <= s <= capacity / 2)
        n_large = sum(n for _, n in large)
        spare = n_large * capacity - sum(s * n for s, n in large)
        bound = max(bound, alone + n_large + max(0, -(-(rest - spare) // capacity)))
    return bound


def _fits_into(small: list[int], large: list[int]) -> bool:
    """Whether the pieces of ``small`` fit into those of ``large`` as bins (first fit; enough to call it dominated)."""
    rooms = sorted(large)
    for piece in sorted(small, reverse=True):
        at = next((i for i, r in enumerate(rooms) if r >= piece), None)
        if at is None:
            return False
        rooms[at] -= piece
        rooms.sort()
    return True


def fillings(sizes: list[int], counts: dict[int, int], room: int, limit: int = FILLINGS, steps: int = STEPS) -> list[list[int]]:
    """Undominated ways to fill ``room`` from the lengths left, least waste first.

    ``sizes`` is ascending. Fillings are met from large pieces to small, only those to which no piece could be added;
    the search ends at one without waste, after ``limit`` fillings or ``steps`` steps.
    """
    found: list[list[int]] = []
    smallest = sizes[0] if sizes else room + 1
    stack: list[tuple[list[int], int, int]] = [([], room, len(sizes))]
    while stack and steps and len(found) < limit:
        steps -= 1
        chosen, left, top = stack.pop()
        at = bisect_right(sizes, left, 0, top)
        options = []
        if left and at:
            exact = sizes[at - 1] == left
            for i in range(at - 1, max(-1, at - 1 - (1 if exact else 6)), -1):
                s = sizes[i]
                if counts[s] > chosen.count(s):
                    options.append((chosen + [s], left - s, i + 1))
        if options:
            stack += reversed(options)
        elif left < smallest or not any(counts[s] > chosen.count(s) for s in sizes[: bisect_right(sizes, left)]):
            found.append(chosen)
            if not left:
                break
    if not found:
        found = [[]]
    found.sort(key=lambda f: (room - sum(f), len(f), [-s for s in f]))
    kept: list[list[int]] = []
    for f in found:
        if not any(f != g and _fits_into(f, g) for g in kept):
            kept.append(f)
    return kept


def bin_completion(counts: dict[int, int], capacity: int, nodes: int = NODES) -> Plan:
    """A plan with as few bins as the search finds; best-fit decreasing is where it starts from.

    Depth first: around the largest length left, each undominated filling in turn, used as often as the counts
    allow. A branch ends where its bins and those that its rest needs at least are no fewer than the
    incumbent's, which is where its waste exceeds what the incumbent has to spare. ``nodes`` bounds the work after
    the first descent; the plan is complete whatever the bound.
    """
    counts = {s: n for s, n in counts.items() if n}
    incumbent = best_fit(counts, capacity)
    fewest, least = sum(n for _, n in incumbent), lower_bound(counts, capacity)
    if fewest <= least:
        return incumbent

    def branch(left: dict[int, int]):
        sizes = sorted(left)
        largest = sizes[-1]
        rest = dict(left)
        rest[largest] -= 1
        return [tuple((s, len(list(g))) for s, g in groupby([largest, *f])) for f in fillings([s for s in sizes if rest[s]], rest, capacity - largest)]

    total = sum(s * n for s, n in counts.items())
    path: Plan = []
    # Each level: counts, length left, bins used, fillings still to try.
    stack = [(counts, total, 0, iter(branch(counts)))]
    descended = False
    while stack and fewest > least and nodes:
        left, length, bins, options = stack[-1]
        filling = next(options, None)
        if filling is None:
            stack.pop()
            if path:
                path.pop()
            continue
        nodes -= descended
        times = min(left[s] // k for s, k in filling)
        after = dict(left)
        for s, k in filling:
            after[s] -= k * times
            if not after[s]:
                del after[s]
        used = bins + times
        rest = length - times * sum(s * k for s, k in filling)
        if used + -(-rest // capacity) >= fewest:
            descended = True
            continue
        if not after:
            incumbent, fewest = [*path, (filling, times)], used
            descended = True
            continue
        path.append((filling, times))
        stack.append((after, rest, used, iter(branch(after))))
    return incumbent


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """(part, rank, id, piece, start, length, ids_crc32[, ids]): every document's ids with the end id, cut only if longer than ``capacity``.

    The first piece takes what the others, all full, leave. ``rank`` numbers the pieces of a length within ``part``.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"part int, rank bigint, id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids

    def cut(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, encoder = TaskContext.get().partitionId(), None
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            encoder = encoder or worker_encoder(tokenizer)
            done = 0
            for group in byte_balanced(((t,) for t in text_list(batch.column(1)))):
                counts, ids = _with_end(*encoder.encode([t for (t,) in group]), end_id)
                ids = ids.astype("<u4")
                first = (counts - 1) % capacity + 1
                pieces = (counts - first) // capacity + 1
                row = np.repeat(np.arange(len(group)), pieces)
                number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                length = np.where(number == 0, first[row], capacity)
                start = np.where(number == 0, 0, first[row] + (number - 1) * capacity)
                ends = np.cumsum(length)
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), length.tolist())]
                order = np.argsort(length, kind="stable")
                sizes, at, n = np.unique(length[order], return_index=True, return_counts=True)
                rank = np.empty(len(row), dtype=np.int64)
                rank[order] = np.arange(len(row)) - np.repeat(at, n) + np.repeat(seen[sizes], n)
                seen[sizes] += n
                columns = [pa.array(np.full(len(row), part, np.int32)), pa.array(rank), batch.column(0).slice(done, len(group)).take(pa.array(row)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                names = ["part", "rank", "id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)
                done += len(group)

    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(cut, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False, nodes: int = NODES) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset[, ids]): every piece's place in sequences of ``capacity`` tokens at most.

    Null and empty texts are the end id alone. Null ids are kept and repeated rows are packed each by itself, as ids
    play no part; an empty table gives an empty result; other columns are not read. The driver gets one row for each length.
    """
    pieces = materialise(token_pieces(docs, tokenizer, capacity, end_id, id_column, text_column, with_ids), "pieces")
    by_part = materialise(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = {r.length: r.n for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = _places(bin_completion(counts, capacity, nodes))
    # Bases by part as one row a part, so that what meets the pieces has a row for each part only.
    every = by_part.select("part").distinct().select(F.col("part").alias("p"), F.explode(F.sequence(F.lit(1), F.lit(capacity))).alias("l"))
    before = Window.partitionBy("l").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    bases = every.join(by_part, (F.col("part") == F.col("p")) & (F.col("length") == F.col("l")), "left").select("p", "l", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    bases = bases.groupBy("p").agg(F.transform(F.array_sort(F.collect_list(F.struct("l", "base"))), lambda x: x["base"]).alias("bases"))
    ranked = pieces.join(materialise(bases, "bases"), F.col("part") == F.col("p")).withColumn("rank", F.col("rank") + F.get("bases", (F.col("length") - 1).cast("int")))
    columns = ["id", "piece", "start", "length", "ids_crc32"]
    kind = pieces.schema["id"].dataType.simpleString()
    schema = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint" + ", ids array<int>" * with_ids

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            sequence, offset = _locate(places, batch.column(5).to_numpy(), batch.column(3).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset), *batch.columns[6:]], names=[*columns, "sequence_id", "offset", *["ids"] * with_ids])

    return ranked.select(*columns, "rank", *["ids"] * with_ids).mapInArrow(place, schema).withColumnRenamed("id", id_column)


def _places(plan: Plan) -> dict[int, np.ndarray]:
    """By length, rows (first rank, pieces of it in a bin, first sequence, first offset) in order of ranks."""
    places: dict[int, list] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for filling, bins in plan:
        offset = 0
        for size, k in filling:
            places.setdefault(size, []).append((ranks.get(size, 0), k, sequence, offset))
            ranks[size] = ranks.get(size, 0) + k * bins
            offset += size * k
        sequence += bins
    return {size: np.array(rows, dtype=np.int64) for size, rows in places.items()}


def _locate(places: dict[int, np.ndarray], ranks: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sequence, offset = np.empty(len(ranks), dtype=np.int64), np.empty(len(ranks), dtype=np.int64)
    order = np.argsort(lengths, kind="stable")
    sizes, at = np.unique(lengths[order], return_index=True)
    for size, rows in zip(sizes.tolist(), np.split(order, at[1:])):
        table = places[size]
        hit = table[np.searchsorted(table[:, 0], ranks[rows], side="right") - 1]
        past = ranks[rows] - hit[:, 0]
        sequence[rows] = hit[:, 2] + past // hit[:, 1]
        offset[rows] = hit[:, 3] + past % hit[:, 1] * size
    return sequence, offset


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) from a result of :func:`pack` with ids: the token ids of each sequence."""
    ordered = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids"))
