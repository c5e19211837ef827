"""Repeated passages: word windows that start in an earlier document, found by super-k-mer partitioning.

Consecutive windows of a document that share a minimiser (the least hash of a few words in a row within the window)
travel together as one packed string to the bucket of that minimiser, so equal windows meet in one bucket. There windows
are sorted by hash, neighbours are compared word by word, and all but the smallest document's are marked. Windows
that repeat within a batch are settled before they travel. Minimisers that would fill a task are dealt out by whole windows instead.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import materialise

#: Words of a minimiser; windows of a packed string at most; buckets of a task; bytes of text of a task, and of a batch, about.
MINIMISER_WORDS, RUN_WINDOWS, TASK_BUCKETS, TASK_BYTES, BATCH_BYTES = 2, 2048, 12, 32 << 20, 5 << 20
_BASE = 0x9E3779B97F4A7C15
_WORD = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def run_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k codes in a row, by doubling."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    power, length, done, done_length, bits = codes.astype(np.uint64), 1, None, 0, k
    while bits:
        if bits & 1:
            m = len(codes) - length - done_length + 1
            done = power[:m] if done is None else power[:m] * np.uint64(pow(_BASE, done_length, 1 << 64)) + done[length : length + m]
            done_length += length
        bits >>= 1
        if bits:
            power = power[: len(power) - length] * np.uint64(pow(_BASE, length, 1 << 64)) + power[length:]
            length *= 2
    return _mix(done[:n])


def run_minima(values: np.ndarray, k: int) -> np.ndarray:
    """The least of every k values in a row, by doubling."""
    n = len(values) - k + 1
    if n <= 0:
        return values[:0]
    best, length = values, 1
    while length * 2 <= k:
        best = np.minimum(best[: len(best) - length], best[length:])
        length *= 2
    return np.minimum(best[:n], best[k - length : k - length + n])


class _Words:
    """The words of several texts in one buffer, one space between words, and their windows of k."""

    def __init__(self, texts: list[list[bytes]], k: int):
        self.n_words = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        words = [w for t in texts for w in t]
        self.buffer = b" ".join(words)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        self.ends = np.cumsum(lengths + 1) - 1
        self.starts = self.ends - lengths
        codes = np.fromiter(map(zlib.crc32, words), dtype=np.uint64, count=len(words))
        self.k, self.text_starts = k, np.cumsum(self.n_words) - self.n_words
        self.text_of = np.repeat(np.arange(len(texts)), self.n_words)
        first = np.arange(max(0, len(words) - k + 1))
        #: Word positions at which a window of one text starts.
        self.windows = first[self.text_of[first] == self.text_of[first + k - 1]] if len(first) else first
        self.codes = codes

    def hashes(self) -> np.ndarray:
        return run_hashes(self.codes, self.k)[self.windows]

    def minimisers(self, m: int) -> np.ndarray:
        m = min(m, self.k)
        return run_minima(run_hashes(self.codes, m), self.k - m + 1)[self.windows]

    def bytes_of(self, first: int, words: int) -> bytes:
        return self.buffer[self.starts[first] : self.ends[first + words - 1]]


def repeated_windows(words: _Words, hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which windows also start under a smaller owner; owner by window. Equal hashes count only if the words are equal."""
    marked = np.zeros(len(hashes), dtype=bool)
    if len(hashes) < 2:
        return marked
    order = np.lexsort((owner, hashes))
    h = hashes[order]
    opens = np.concatenate([[True], h[1:] != h[:-1]])
    leader = order[np.maximum.accumulate(np.where(opens, np.arange(len(h)), 0))]
    follows = np.flatnonzero(~opens)
    if not len(follows):
        return marked
    k, at, buffer = words.k, words.windows, words.buffer
    a, b = at[order[follows]], at[leader[follows]]
    spans = zip(words.starts[a].tolist(), words.ends[a + k - 1].tolist(), words.starts[b].tolist(), words.ends[b + k - 1].tolist())
    same = np.fromiter((buffer[p:q] == buffer[r:s] for p, q, r, s in spans), dtype=bool, count=len(follows))
    later = owner[order[follows]] > owner[leader[follows]]
    marked[order[follows[same & later]]] = True
    for group in np.unique(h[follows[~same]]):  # windows of different words under one hash
        least: dict[bytes, int] = {}
        members = order[np.searchsorted(h, group, "left") : np.searchsorted(h, group, "right")]
        spelt = [words.bytes_of(int(at[i]), k) for i in members]
        for i, s in zip(members, spelt):
            least[s] = min(least.get(s, owner[i]), owner[i])
        for i, s in zip(members, spelt):
            marked[i] = owner[i] > least[s]
    return marked


def _runs(cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs; cut[i] says whether item i opens one."""
    starts = np.flatnonzero(cut)
    return starts, np.diff(np.append(starts, len(cut)))


def _planes(column: np.ndarray, delta: bool) -> bytes:
    """64-bit numbers, or their steps, as eight planes of bytes: small numbers leave planes of zeros."""
    x = column.astype("<i8")
    return np.ascontiguousarray((np.diff(x, prepend=0) if delta else x).view(np.uint8).reshape(-1, 8).T).tobytes()


def _pack(columns: list[np.ndarray], payload: bytes) -> bytes:
    """Columns of 64-bit numbers (ids by their steps) and a payload, compressed."""
    import pyarrow as pa

    head = np.array([len(columns), *map(len, columns)], dtype="<i8").tobytes() + b"".join(_planes(c, i in _IDS) for i, c in enumerate(columns))
    raw = head + payload
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 5).compress(raw, asbytes=True)


#: Columns of a blob that hold ids: of strings and of runs.
_IDS = (0, 3)


def _unpack(blob: bytes) -> tuple[list[np.ndarray], bytes]:
    import pyarrow as pa

    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    sizes = np.frombuffer(raw, "<i8", n, 8)
    at, columns = 8 * (n + 1), []
    for i, size in enumerate(sizes.tolist()):
        x = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * size, at).reshape(8, size).T).view("<i8").reshape(-1)
        columns.append(np.cumsum(x) if i in _IDS else x)
        at += 8 * size
    return columns, raw[at:]


def _ranks(ids: np.ndarray, late: np.ndarray) -> np.ndarray:
    """Owners as numbers in the order of ids; rows without an id (late) come after all others."""
    _, ranks = np.unique(ids, return_inverse=True)
    return np.where(late, len(ids), ranks)


def _signed(position: np.ndarray, late: np.ndarray) -> np.ndarray:
    """Positions travel with the sign of their owner: -1 - position says that it has no id. Its own inverse, given late."""
    return np.where(late, -1 - position, position)


def _text_batches(batches, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[list[bytes]]]]:
    """(ids, whether there is none, hashes, words) of about ``size`` bytes of text at a time from batches (id, h, text binary)."""
    for batch in batches:
        ids, late, h = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_null().to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
        held, n, begin = [], 0, 0
        for i, text in enumerate(batch.column(2)):
            text = text.as_py() or b""
            held.append(text.split())
            n += len(text)
            if n >= size or i + 1 == batch.num_rows:
                yield ids[begin : i + 1], late[begin : i + 1], h[begin : i + 1], held
                held, n, begin = [], 0, i + 1


def _sizes(rows: DataFrame, k: int, tasks: int) -> tuple[int, frozenset[int]]:
    """Bytes of all texts, and the minimisers that more than 1 / (4 * tasks) of the packed strings share.

    Each batch names those that are heavy in it, so what reaches the driver is bounded by the number of tasks.
    """

    def survey(batches):
        import pyarrow as pa

        for _, _, _, texts in _text_batches(batches, BATCH_BYTES):
            words = _Words(texts, k)
            least = words.minimisers(MINIMISER_WORDS)
            cut = np.concatenate([[True], (least[1:] != least[:-1]) | (np.diff(words.windows) != 1)]) if len(least) else np.zeros(0, bool)
            value, n = np.unique(least[cut], return_counts=True)
            heavy = n > max(4, len(least[cut]) // (8 * tasks))
            yield pa.RecordBatch.from_arrays([pa.array([None, *value[heavy].astype(np.int64)], pa.int64()), pa.array([int(cut.sum()), *n[heavy]], pa.int64()), pa.array([len(words.buffer)] + [0] * int(heavy.sum()), pa.int64())], names=["m", "n", "bytes"])

    found = materialise(rows.mapInArrow(survey, "m bigint, n bigint, bytes bigint").groupBy("m").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")), "survey")
    total = found.filter("m is null").first()
    if total is None:
        return 0, frozenset()
    hot = found.filter((F.col("m").isNotNull()) & (F.col("n") > max(8, total.n // (4 * tasks)))).select("m").collect()
    return total.bytes, frozenset(r.m for r in hot)


def _scatter(k: int, buckets: int, hot: frozenset[int]):
    """Map side: (bucket, blob) rows. A blob has strings (id, h, first window, bytes) to count and runs (id, h, first, windows) already marked.

    First windows are signed, as of :func:`_signed`.
    """
    hot_values = np.array(sorted(hot), dtype=np.int64).astype(np.uint64)
    hot_values.sort()

    def scatter(batches):
        import pyarrow as pa

        for number, (ids, late, h, texts) in enumerate(_text_batches(batches, BATCH_BYTES)):
            words = _Words(texts, k)
            if not len(words.windows):
                continue
            hashes, least = words.hashes(), words.minimisers(MINIMISER_WORDS)
            text = words.text_of[words.windows]
            position = words.windows - words.text_starts[text]
            marked = repeated_windows(words, hashes, _ranks(ids, late)[text])
            position = _signed(position, late[text])
            adjacent = np.concatenate([[False], np.diff(words.windows) == 1])
            # Runs that are settled here.
            opens = marked & ~(np.concatenate([[False], marked[:-1]]) & adjacent)
            s, n = _runs(opens[marked])
            settled = np.flatnonzero(marked)[s]
            out: dict[int, list] = {}
            run_bucket = (settled + number) % buckets
            # Strings that travel: by minimiser, or by window where that is hot.
            go = np.flatnonzero(~marked)
            crowded = np.isin(least[go], hot_values) if len(hot_values) else np.zeros(len(go), bool)
            together = np.concatenate([[False], (go[1:] == go[:-1] + 1) & adjacent[go[1:]] & (least[go[1:]] == least[go[:-1]]) & ~crowded[1:]])
            together &= np.arange(len(go)) % RUN_WINDOWS != 0
            first, length = _runs(~together)
            at = go[first]
            bucket = (np.where(crowded[first], hashes[at], _mix(least[at])) % np.uint64(buckets)).astype(np.int64)
            a = words.starts[words.windows[at]].tolist()
            b = words.ends[words.windows[at] + length + k - 2].tolist()
            order = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.diff(bucket[order])) + 1
            for group in np.split(order, edges) if len(order) else []:
                t = text[at[group]]
                payload = b"\n".join([words.buffer[a[i] : b[i]] for i in group.tolist()])
                out[int(bucket[group[0]])] = [ids[t], h[t], position[at[group]], payload]
            for value in np.unique(run_bucket).tolist():
                mine = run_bucket == value
                t = text[settled[mine]]
                columns = out.setdefault(value, [np.zeros(0, np.int64)] * 3 + [b""])
                out[value] = [*columns, ids[t], h[t], position[settled[mine]], n[mine]]
            empty = [np.zeros(0, np.int64)] * 4
            rows = [(key, _pack([*c[:3], *(c[4:] or empty)], c[3])) for key, c in out.items()]
            for i in range(0, len(rows), 500):
                keys, blobs = zip(*rows[i : i + 500])
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    return scatter


def _count(k: int):
    """Reduce side: marked runs (id, h, first window, windows), a bucket at a time from rows sorted by bucket."""

    def settle(blobs: list[bytes]):
        import pyarrow as pa

        strings, passed = [], []
        texts: list[list[bytes]] = []
        for blob in blobs:
            columns, payload = _unpack(blob)
            if len(columns[0]):
                strings.append(columns[:3])
                texts += [s.split(b" ") for s in payload.split(b"\n")]
            passed.append(columns[3:])
        results = [tuple(np.concatenate(c) for c in zip(*passed))]
        if texts:
            ids, h, first = (np.concatenate(c) for c in zip(*strings))
            late = first < 0
            first = _signed(first, late)
            words = _Words(texts, k)
            text = words.text_of[words.windows]
            marked = repeated_windows(words, words.hashes(), _ranks(ids, late)[text])
            if marked.any():
                adjacent = np.concatenate([[False], text[1:] == text[:-1]])
                opens = marked & ~(np.concatenate([[False], marked[:-1]]) & adjacent)
                s, n = _runs(opens[marked])
                at = np.flatnonzero(marked)[s]
                t = text[at]
                results.append((ids[t], h[t], _signed(first[t] + words.windows[at] - words.text_starts[t], late[t]), n))
        ids, h, first, n = (np.concatenate(c) for c in zip(*results))
        if len(ids):
            late = first < 0
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=late), *(pa.array(c, pa.int64()) for c in (h, _signed(first, late), n))], names=["id", "h", "first", "windows"])

    def count(batches):
        held, key = [], None
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and bucket != key:
                    yield from settle(held)
                    held = []
                key = bucket
                held.append(blob)
        if held:
            yield from settle(held)

    return count


def _cover(k: int, with_text: bool):
    """Remove covered words: rows (id, text binary, runs) to (id, n_words, n_removed, kept_sha256[, kept])."""

    def cover(batches):
        import pyarrow as pa

        for batch in batches:
            n_words, n_removed, digests, texts = [], [], [], []
            runs = batch.column(2)
            for i, text in enumerate(batch.column(1)):
                words = (text.as_py() or b"").split()
                gone = 0
                found = runs[i].as_py()
                if found:
                    delta = np.zeros(len(words) + 1, dtype=np.int64)
                    first = np.array([r["first"] for r in found])
                    np.add.at(delta, first, 1)
                    np.add.at(delta, first + np.array([r["windows"] for r in found]) + k - 1, -1)
                    keep = np.cumsum(delta[:-1]) == 0
                    gone = len(words) - int(keep.sum())
                    kept = b" ".join([w for w, x in zip(words, keep.tolist()) if x])
                else:
                    kept = b" ".join(words)
                n_words.append(len(words))
                n_removed.append(gone)
                digests.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    texts.append(kept.decode("utf-8", "replace"))
            columns = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
            names = ["id", "n_words", "n_removed", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())] if with_text else columns, names=[*names, "kept"] if with_text else names)

    return cover


def repeated_runs(docs: DataFrame, k: int = 13, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, h, first, windows): runs of windows of ``k`` words that also start in a document with a smaller id.

    ``h`` is the text's hash. ``first`` counts words from 0.
    """
    spark = docs.sparkSession
    rows = _rows(docs, id_column, text_column)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size, hot = _sizes(rows, k, tasks)
    tasks = max(tasks, -(-size // TASK_BYTES))
    scattered = rows.mapInArrow(_scatter(k, tasks * TASK_BUCKETS, hot), "bucket bigint, blob binary")
    return scattered.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(_count(k), "id bigint, h bigint, first bigint, windows bigint")


def _rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = F.coalesce(F.col(text_column), F.lit(""))
    return docs.select(F.col(id_column).cast("long").alias("id"), F.xxhash64(text).alias("h"), text.cast("binary").alias("text"))


def drop_repeats(docs: DataFrame, k: int = 13, id_column: str = "doc_id", text_column: str = "text", with_text: bool = False) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256[, kept]) of every row without the words that repeated windows cover.

    Words are runs of bytes other than space and 0x09 to 0x0D, unchanged. A window is ``k`` words in a row of one
    document; each word that is covered by a window which also starts under a smaller id goes. Windows are judged on the input.
    Null texts have no words. Rows without an id come after all others and do not count against each other, nor do
    rows that share an id; texts of fewer than ``k`` words are kept whole; repeated rows give repeated rows; an empty
    table gives an empty result; other columns are not read.
    """
    rows = _rows(docs, id_column, text_column)
    runs = repeated_runs(docs, k, id_column, text_column).groupBy(F.col("id").alias("i"), F.col("h").alias("g")).agg(F.collect_set(F.struct("first", "windows")).alias("runs"))
    joined = rows.join(runs, F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g")), "left").select("id", "text", "runs")
    schema = "id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept string" * with_text
    return joined.mapInArrow(_cover(k, with_text), schema).withColumnRenamed("id", id_column)
