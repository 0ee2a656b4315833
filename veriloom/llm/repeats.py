"""Removal of passages that repeat across documents: exact, on bytes, over a collection's suffixes.

A column-wise construction over whole documents would pass over the collection's transform once a symbol of the longest
text.  Here it runs where repeats can be: content-defined anchors (minimisers of `gram`-byte strings) cut the
texts, as any string of `span` bytes holds an anchor that it has in every text.  Anchors with equal surroundings
settle whole runs of starts at once; what is left, the ends of repeats, are short strings round the anchors.  Those are
the collections whose transform and common prefixes are built together, one symbol of each string a round, by passes over
sequential files.  A collection that is too large for one task is split by the bytes beside its anchor, and again until
its strings are single spans.
"""

from __future__ import annotations

import bisect
import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import drop_tables, materialize

U64 = np.uint64
NONE = U64(2**64 - 1)
SPAN, GRAM = 50, 24
BLOCK_BYTES = 1 << 18
TASK_STRINGS = 20_000  # strings that one task gets
PARTS = 4  # pairs of bytes beside the core by which strings that can't repeat are told
BATCH_STRINGS, BATCH_ROWS = 4_000, 20_000  # different strings of one collection, and all of its strings, whose transform stays small enough for the processor's caches
HOT_STRINGS = 5_000  # a collection with more strings is split by the bytes beside its anchor
WINDOWS = 1 << 14  # windows whose anchors are looked up at once
CHUNK = 1 << 19  # symbols of the transform that are read at once
TASK_BYTES, TASK_BUCKETS = 1 << 24, 4  # bytes of text whose anchors a task settles, and the parts in which it does so
PACK_ROWS = 1 << 19  # rows of anchors that are packed at once
KNOWN = 50_000  # surroundings met in several documents that a task remembers
WIDE_ROWS, WIDE_SHARE = 64, 1 / 16  # anchors with so many rows in this share of the texts are dealt by their surroundings too


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(29))) * U64(0x9FB21C651E98DF25)
    return x ^ (x >> U64(32))


_BYTES = _mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


def _grams(x: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every `size` bytes: sums of strings of doubled length, then of those that the binary digits of `size` name;
    the sums are mixed once."""
    level, width, out, have = _BYTES[x], 1, None, 0
    while True:
        if size & width:
            n = len(level) - have
            out = level if out is None else out[:n] * U64(0xC2B2AE3D27D4EB4F) + level[have : have + n]
            have += width
        if have == size:
            return _mix(out[: len(x) - size + 1])
        level = level[:-width] * U64(0x165667B19E3779F9 + 2 * width) + level[width:]
        width *= 2


def _slide(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over x[i : i + width] for every full window."""
    step, out = 1, x
    while step * 2 <= width:
        out = pick(out[:-step], out[step:])
        step *= 2
    rest = width - step
    return pick(out[:-rest], out[rest:]) if rest else out


def anchors(grams: np.ndarray, size: int, ends: np.ndarray, starts: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, left, right) of the anchors in joined texts of `size` bytes: places of the first least hash in some window
    of `span` bytes of one text.  The windows whose anchor it is begin `left` bytes before it at most, and go on for `right`
    bytes behind it at most."""
    width = span - gram + 1
    empty = np.array([], dtype=np.int64)
    if size < span:
        return empty, np.array([], dtype=U64), empty, empty
    h = grams >> U64(1)
    least = _slide(h, width, np.minimum)  # a window for each start of a span
    fits = ends - starts >= span
    whole = np.zeros(len(least) + 1, dtype=np.int32)
    np.add.at(whole, starts[fits], 1)
    np.add.at(whole, ends[fits] - span + 1, -1)
    new = np.ones(len(least), dtype=bool)  # windows whose anchor the window before does not have
    new[1:] = (least[1:] != least[:-1]) | (h[: len(least) - 1] == least[:-1])
    new[starts[fits]] = True
    first = np.flatnonzero(new & (whole[:-1].cumsum() > 0))
    last = np.minimum(np.append(first[1:], len(least)) - 1, ends[np.searchsorted(ends, first, side="right")] - span)
    windows = np.lib.stride_tricks.sliding_window_view(h, width)
    at = [windows[first[i : i + WINDOWS]].argmin(axis=1) for i in range(0, len(first), WINDOWS)]
    place = first + np.concatenate([empty, *at])
    return place, h[place], place - first, last + span - place - gram


def surroundings(block: np.ndarray, grams: np.ndarray, place: np.ndarray, lo: np.ndarray, hi: np.ndarray, span: int, gram: int) -> np.ndarray:
    """Hashes of the bytes from span - gram before each place to span after it, of one text: from gram hashes that cover
    them; from single bytes where a text begins or ends within."""
    before = span - gram
    steps = [*range(-before, span - gram, gram), span - gram]
    weights = _mix(np.arange(2, before + span + 2, dtype=U64) * U64(0xD6E8FEB86659FD93)) | U64(1)
    out = np.zeros(len(place), dtype=U64)
    inner = np.flatnonzero((place - before >= lo) & (place + span <= hi))
    for k, step in enumerate(steps):
        out[inner] = _mix(out[inner] * U64(0x9E3779B97F4A7C15) + grams[place[inner] + step] * weights[k])
    edge = np.setdiff1d(np.arange(len(place)), inner, assume_unique=True)
    for some in np.split(edge, range(WINDOWS, len(edge), WINDOWS)):
        at = place[some, None] + np.arange(-before, span)
        inside = (at >= lo[some, None]) & (at < hi[some, None])
        out[some] = _mix(U64(1) + (np.where(inside, _BYTES[block[np.clip(at, 0, len(block) - 1)]], U64(1)) * weights).sum(axis=1, dtype=U64))
    return out


def _blocks(batch: pa.RecordBatch, seen: dict[bytes, int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_ids, versions, joined bytes, starts, ends) of whole texts, about BLOCK_BYTES at a time."""
    ids, versions, parts, size = [], [], [], 0
    for doc_id, version, text in zip(*(c.to_pylist() for c in batch.columns)):
        data = (text or "").encode()
        mark = hashlib.sha256(data).digest()
        if seen.get(mark, doc_id) < doc_id:
            continue  # an equal text of a smaller document went before: the whole of this one is settled by its hash
        if len(seen) > 500_000:
            seen.clear()
        seen[mark] = doc_id
        ids.append(doc_id)
        versions.append(version)
        parts.append(data)
        size += len(data)
        if size >= BLOCK_BYTES:
            yield _joined(ids, versions, parts)
            ids, versions, parts, size = [], [], [], 0
    if ids:
        yield _joined(ids, versions, parts)


def _joined(ids: list, versions: list, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes)
    return np.array(ids, dtype=np.int64), np.array(versions, dtype=np.int64), np.frombuffer(b"".join(parts), dtype=np.uint8), ends - sizes, ends


class FirstMet:
    """The least document in which a task has met surroundings that several documents have.

    Rows of greater documents are settled where they are found, so that a line which a third of all documents hold makes
    one row a task, not one a document.
    """

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.around, self.anchor, self.doc = (np.array([], dtype=np.int64) for _ in range(3))

    def later(self, anchor: np.ndarray, around: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Which rows have surroundings that a smaller document had, here or in a block before."""
        if not len(anchor):
            return np.zeros(0, dtype=bool)
        order = np.argsort(around, kind="stable")
        a, r, d = anchor[order], around[order], doc[order]
        new = np.concatenate([[True], (r[1:] != r[:-1]) | (a[1:] != a[:-1])])
        group = np.cumsum(new) - 1
        first = np.minimum.reduceat(d, np.flatnonzero(new))
        out = np.zeros(len(d), dtype=bool)
        out[order] = d > first[group]
        several = np.zeros(len(first), dtype=bool)
        several[group[d > first[group]]] = True
        if len(self.around):
            at = np.minimum(np.searchsorted(self.around, r[new]), len(self.around) - 1)
            met = (self.around[at] == r[new]) & (self.anchor[at] == a[new])
            before = np.where(met, self.doc[at], first)
            out[order] |= d > before[group]
            np.minimum.at(self.doc, at[met], first[met])
            several &= ~met
        if several.any():
            if len(self.around) > KNOWN:
                self.clear()
            at = np.searchsorted(self.around, r[new][several])
            self.around, self.anchor, self.doc = (np.insert(old, at, more[several]) for old, more in ((self.around, r[new]), (self.anchor, a[new]), (self.doc, first)))
        return out


#: place: the anchor's place, and the bytes beside it that its windows take; 2**BITS bytes are enough for them.
BITS = 10
ROWS = "anchor bigint, around bigint, doc_id bigint, ver bigint, place bigint"


def _rows_of(batches: Iterator[pa.RecordBatch], span: int, gram: int) -> Iterator[np.ndarray]:
    """Columns of ROWS, a block of texts at a time."""
    before, seen, met = span - gram, {}, FirstMet()
    for batch in batches:
        for ids, versions, block, starts, ends in _blocks(batch, seen):
            grams = _grams(block, gram) if len(block) >= span else np.array([], dtype=U64)
            place, h, left, right = anchors(grams, len(block), ends, starts, span, gram)
            doc = np.searchsorted(ends, place, side="right")
            around = surroundings(block, grams, place, starts[doc], ends[doc], span, gram).view(np.int64)
            anchor, pos = h.view(np.int64), place - starts[doc]
            gone = met.later(anchor, around, ids[doc])
            g = np.flatnonzero(gone)
            lo, hi = np.maximum(pos[g] - before, 0), np.minimum(pos[g] + span, (ends - starts)[doc[g]])
            new = np.ones(len(g), dtype=bool)
            new[1:] = (doc[g][1:] != doc[g][:-1]) | (lo[1:] > hi[:-1])
            last = np.append(np.flatnonzero(new)[1:] - 1, len(g) - 1) if len(g) else g
            k = np.flatnonzero(~gone)
            own = np.concatenate([doc[k], doc[g][new]])
            yield np.stack([np.concatenate([anchor[k], np.full(int(new.sum()), -1)]), np.concatenate([around[k], hi[last]]), ids[own], versions[own], np.concatenate([(pos << 2 * BITS | left << BITS | right)[k], lo[new]])])


def anchor_rows(texts: DataFrame, span: int, gram: int) -> DataFrame:
    """Of texts (doc_id, ver, text): a row for each anchor with the hash of its surroundings (the bytes from which all spans
    over the anchor start and end).  Runs that a smaller document of the same task settles are rows with anchor -1 and
    the bytes from place to around."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _rows_of(batches, span, gram):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows], names=["anchor", "around", "doc_id", "ver", "place"])

    return texts.select("doc_id", "ver", "text").mapInArrow(run, ROWS)


def wide_anchors(texts: DataFrame, span: int, gram: int) -> np.ndarray:
    """Anchors that very many texts have, so that their rows are dealt to tasks by their surroundings too.

    They are looked for in a seeded share of the texts and are at most four a shuffle partition.  How rows are dealt changes
    no result: rows with equal surroundings always meet, and an anchor taken as wide is only looked at more closely.
    """
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = anchor_rows(texts.sample(WIDE_SHARE, seed=5), span, gram).where("anchor >= 0").groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    rows = found.where(F.col("n") >= WIDE_ROWS).orderBy(F.desc("n"), "anchor").limit(4 * parts).collect()
    return np.array([r["anchor"] for r in rows], dtype=np.int64)


SETTLED = "anchor bigint, doc_id bigint, ver bigint, place bigint, end bigint"


def packed(columns: np.ndarray) -> bytes:
    """Columns of eight-byte numbers as bytes of like weight side by side: those that are zero compress to nothing."""
    return np.ascontiguousarray(columns).view(np.uint8).reshape(len(columns), -1, 8).transpose(0, 2, 1).tobytes()


def unpacked(data: list[bytes], columns: int) -> np.ndarray:
    parts = [np.frombuffer(x, dtype=np.uint8).reshape(columns, 8, -1).transpose(0, 2, 1) for x in data]
    return np.ascontiguousarray(np.concatenate(parts, axis=1)).view(np.int64)[:, :, 0]


def _dealt(rows: np.ndarray, wide: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed rows): rows of an anchor go to one bucket, of one that is wide by their surroundings too, and settled
    runs anywhere."""
    anchor = rows[0].view(U64)
    key = np.where(np.isin(rows[0], wide), anchor + _mix(rows[1].view(U64)), anchor)
    bucket = (_mix(key) % U64(buckets)).astype(np.int32)
    bucket = np.where(rows[0] < 0, rows[2] % buckets, bucket)
    order = np.argsort(bucket, kind="stable")
    found, at = np.unique(bucket[order], return_index=True)
    for b, part in zip(found.tolist(), np.split(order, at[1:])):
        yield b, packed(rows[:, part])


def settled(rows: np.ndarray, wide: np.ndarray, span: int, gram: int) -> np.ndarray:
    """Of all rows of some anchors, columns of SETTLED: settled runs of bytes (place, end) whose spans all start in a smaller
    document, and open anchors (end 0): rows of the first document with their surroundings, of an anchor that other
    documents have in other surroundings, or that is wide."""
    before = span - gram
    ready = rows[0] < 0
    runs, rows = rows[:, ready][[0, 2, 3, 4, 1]], rows[:, ~ready]
    order = np.argsort(rows[0])
    sorted_ = rows[0][order]
    same = sorted_[1:] == sorted_[:-1]
    order = order[np.append(same, False) | np.append(False, same) | np.isin(sorted_, wide)]  # most anchors are met once, and say nothing
    if not len(order):
        return runs
    a, c, d, v, p = rows[:, order]
    order = np.lexsort((d, c, a))
    a, c, d, v, p = (x[order] for x in (a, c, d, v, p))
    new_a = np.append(True, a[1:] != a[:-1])
    new_c = new_a | np.append(True, c[1:] != c[:-1])
    group = np.cumsum(new_a) - 1
    done = d != d[new_c][np.cumsum(new_c) - 1]
    several = np.isin(a[new_a], wide)
    several[group[~done & (d != d[new_a][group])]] = True
    out, pos = done | several[group], p >> 2 * BITS
    return np.concatenate([runs, np.stack([a, d, v, np.where(done, np.maximum(pos - before, 0), p), np.where(done, pos + span, 0)])[:, out]], axis=1)


def even_keys(spark: SparkSession, tasks: int) -> list[int]:
    """A number for each task to which repartition(tasks) takes it: buckets dealt by their hashes would leave some tasks several
    times the rows of others."""
    tried = spark.range(tasks * (tasks.bit_length() + 8)).select(F.col("id").cast("int").alias("key"))
    found = {r["task"]: r["key"] for r in tried.groupBy(F.pmod(F.hash("key"), F.lit(tasks)).alias("task")).agg(F.min("key").alias("key")).collect()}
    return [found.get(t, t) for t in range(tasks)]


def settle(texts: DataFrame, wide: np.ndarray, size: int, span: int, gram: int) -> DataFrame:
    """Settles the anchors of texts of `size` bytes.  Rows go to their buckets packed, a few thousand in one row of Spark's;
    buckets are as many as the texts ask for, so that a task holds one at a time."""
    tasks = max(1, -(-size // TASK_BYTES))
    buckets = tasks * TASK_BUCKETS
    keys = even_keys(texts.sparkSession, tasks)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            found = list(_dealt(np.concatenate(held, axis=1), wide, buckets))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([keys[b % tasks] for b, _ in found], pa.int32()), pa.array([b for b, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], names=["key", "bucket", "rows"])

        held: list[np.ndarray] = []
        for rows in _rows_of(batches, span, gram):
            held.append(rows)
            if sum(x.shape[1] for x in held) >= PACK_ROWS:
                yield flush()
        if held:
            yield flush()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            columns = settled(unpacked(held, 5), wide, span, gram)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["anchor", "doc_id", "ver", "place", "end"])

        held, last = [], None
        for batch in batches:
            for bucket, data in zip(batch.column(1).to_pylist(), batch.column(2)):
                if held and bucket != last:
                    yield flush()
                held.append(data.as_buffer())
                last = bucket
        if held:
            yield flush()

    dealt = texts.select("doc_id", "ver", "text").mapInArrow(deal, "key int, bucket int, rows binary")
    return dealt.repartition(tasks, "key").sortWithinPartitions("bucket").mapInArrow(run, SETTLED)


class _Scan:
    """What one pass over the transform must remember of each symbol from chunk to chunk."""

    def __init__(self, span: int, kind: type):
        self.span, self.kind = span, kind
        self.count = np.zeros(257, dtype=np.int64)  # places passed
        self.least = np.full(257, span, dtype=kind)  # least common prefix since the last of them
        self.waits = np.zeros(257, dtype=bool)  # a suffix is inserted by the last of them
        self.passed = False  # whether there was a chunk before

    def more(self, least: np.ndarray) -> np.ndarray:
        """Symbols that suffixes share which begin alike and share so many after that; counted up to `span`."""
        return np.minimum(least.astype(np.int64) + 1, self.span).astype(self.kind)

    def step(self, symbols: np.ndarray, common: np.ndarray, mine: np.ndarray, total: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of the places `mine` (`total` counts the symbols of all chunks): ranks among equal symbols, and the common prefix with the suffix of the equal symbol before;
        and (symbol, rank, common prefix) of the suffixes that follow an inserted one."""
        m, passed = len(symbols), self.passed
        order = np.argsort(symbols, kind="stable")
        inverse = np.empty(m, dtype=np.int32)
        inverse[order] = np.arange(m, dtype=np.int32)
        sizes = total - self.count if last else np.bincount(symbols, minlength=257)
        begin = np.cumsum(sizes) - sizes
        closed = np.append(common, self.kind(self.span))

        def between(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
            """Least of common[lo] to common[hi]; one of the two ascends, and they are taken from the last on, so that nothing
            between two is looked at."""
            pairs = np.stack([lo[::-1], hi[::-1] + 1], axis=1).ravel()
            return np.minimum.reduceat(closed, pairs)[::2][::-1] if len(lo) else closed[:0]

        k, c = inverse[mine], symbols[mine]
        rank = self.count[c] + k - begin[c]
        inner, follows = k > begin[c], k + 1 < begin[c] + sizes[c]
        after = order[np.minimum(k + 1, m - 1)][follows]
        least = np.zeros(len(mine), dtype=self.kind)
        least[inner] = between(order[k[inner] - 1] + 1, mine[inner])
        found = [c[follows]], [rank[follows] + 1], [self.more(between(mine[follows] + 1, after))]
        head = None
        if passed or not last:
            head = np.minimum.accumulate(common)
        if passed:  # the symbol before lies in a chunk before
            least[~inner] = np.minimum(self.least[c[~inner]], head[mine[~inner]])
            late = np.flatnonzero(self.waits & (sizes > 0))
            for column, more in zip(found, (late, self.count[late], self.more(np.minimum(self.least[late], head[order[begin[late]]])))):
                column.append(more)
        own = np.where(rank == 0, 0, self.more(least)).astype(self.kind)
        if not last:
            tail = np.append(np.minimum.accumulate(common[::-1])[::-1], self.kind(self.span))
            here = np.flatnonzero(sizes)
            final = order[begin[here] + sizes[here] - 1]
            inserted = np.zeros(m, dtype=bool)
            inserted[mine] = True
            self.least = np.minimum(self.least, head[-1])
            self.least[here], self.waits[here] = tail[final + 1], inserted[final]
            self.count += sizes
            self.passed = True
        return rank, own, tuple(map(np.concatenate, found))


class ColumnWise:
    """Transform and common prefixes of a collection of short strings, built by inserting one symbol of each string a round.

    After round j the transform lists the symbol before each suffix of at most j symbols, in order, and beside it how many
    symbols that suffix shares with the one before.  A string's new suffix lies at the rank of the symbol just written
    among equal symbols, behind all smaller ones; it shares one symbol more with its new neighbours than the suffixes
    from which they come share with all between them.  A round reads both files once in chunks to find places and common
    prefixes, and once more to write the next files.
    """

    def __init__(self, strings: list[bytes], span: int, folder: str):
        self.n, self.length, self.span = len(strings), np.array([len(s) for s in strings]), span
        self.width = int(self.length.max(initial=0))
        self.table = np.zeros((self.n, self.width), dtype=np.uint8)  # right-aligned, UTF-8 bytes plus 1; 0 ends a string
        inside = np.arange(self.width) >= self.width - self.length[:, None]
        self.table[inside] = np.frombuffer(b"".join(strings), dtype=np.uint8) + 1
        self.kind = np.uint8 if span < 256 else np.uint32
        self.folder = folder

    def symbol(self, rows: np.ndarray, taken: int) -> np.ndarray:
        """The symbol before the suffix of `taken` symbols."""
        return self.table[rows, self.width - 1 - taken] if taken < self.width else np.zeros(len(rows), dtype=np.uint8)

    def _path(self, what: str, taken: int) -> str:
        return os.path.join(self.folder, f"{what}-{taken}")

    def _chunks(self, taken: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        at = 0
        with open(self._path("transform", taken), "rb") as a, open(self._path("common", taken), "rb") as b:
            while len(symbols := np.fromfile(a, dtype=np.uint8, count=CHUNK)):
                yield at, symbols, np.fromfile(b, dtype=self.kind, count=CHUNK)
                at += len(symbols)

    def build(self) -> tuple[np.ndarray, np.ndarray]:
        n = self.n
        symbols = self.symbol(np.arange(n), 0)
        symbols.tofile(self._path("transform", 0))
        np.zeros(n, dtype=self.kind).tofile(self._path("common", 0))
        total, size = np.bincount(symbols, minlength=257), n
        rows = np.flatnonzero(symbols)
        at, symbols, taken = rows, symbols[rows], 0
        while len(rows):
            taken += 1
            smaller = n + np.cumsum(total) - total - total[0]
            scan, place, own, later = _Scan(self.span, self.kind), [], [], []
            for lo, chunk, common in self._chunks(taken - 1):
                a, b = np.searchsorted(at, [lo, lo + len(chunk)])
                rank, shared, (c, r, x) = scan.step(chunk, common, at[a:b] - lo, total, lo + len(chunk) == size)
                place.append(smaller[symbols[a:b]] + rank)
                own.append(shared)
                later.append((smaller[c] + r, x))
            place, own = np.concatenate(place), np.concatenate(own)
            order = np.argsort(symbols, kind="stable")  # so are their places
            rows, place, own = rows[order], place[order], own[order]
            symbols = self.symbol(rows, taken)
            follow, value = (np.concatenate(x) for x in zip(*later))
            before = np.searchsorted(place, follow)
            old = place[np.minimum(before, len(place) - 1)] != follow  # those inserted too have theirs
            follow, value = (follow - before)[old], value[old]
            sort = np.argsort(follow)
            self._write(taken, size, place - np.arange(len(place)), symbols, own, follow[sort], value[sort])
            total, size = total + np.bincount(symbols, minlength=257), size + len(rows)
            live = symbols > 0
            rows, at, symbols = rows[live], place[live], symbols[live]
        paths = self._path("transform", taken), self._path("common", taken)
        out = np.fromfile(paths[0], dtype=np.uint8), np.fromfile(paths[1], dtype=self.kind)
        for p in paths:
            os.unlink(p)
        return out

    def _write(self, taken: int, size: int, at: np.ndarray, symbols: np.ndarray, own: np.ndarray, follow: np.ndarray, value: np.ndarray) -> None:
        """The next files: symbols inserted before the old places `at`, and new common prefixes at the old places `follow`.  A new
        file a round: rewriting one would wait for the disk."""
        with open(self._path("transform", taken), "wb") as a, open(self._path("common", taken), "wb") as b:
            for lo, chunk, common in self._chunks(taken - 1):
                hi = lo + len(chunk)
                i, j = np.searchsorted(at, [lo, hi])
                j = len(at) if hi == size else j
                k, l = np.searchsorted(follow, [lo, hi])
                common[follow[k:l] - lo] = value[k:l]
                np.insert(chunk, at[i:j] - lo, symbols[i:j]).tofile(a)
                np.insert(common, at[i:j] - lo, own[i:j]).tofile(b)
        for what in ("transform", "common"):
            os.unlink(self._path(what, taken - 1))

    def classes(self) -> tuple[np.ndarray, np.ndarray]:
        """(n, width + 1) ranks of the suffixes by their length, and for each rank the class of its first `span` symbols."""
        symbols, common = self.build()
        order = np.argsort(symbols, kind="stable")[int((symbols == 0).sum()) :]  # suffix at n + k has its next suffix at order[k]
        place = np.empty(len(symbols), dtype=np.int64)
        place[order] = self.n + np.arange(len(order))
        ranks = np.zeros((self.n, self.width + 1), dtype=np.int64)
        ranks[:, 0] = np.arange(self.n)
        for taken in range(1, self.width + 1):
            has = self.length >= taken
            ranks[has, taken] = place[ranks[has, taken - 1]]
        return ranks, np.cumsum(common < self.span) - 1


def repeated_places(strings: list[bytes], docs: np.ndarray, span: int, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """(string, start), in order, of the starts whose next `span` bytes also start in a string of a smaller document.  Equal
    strings are one string of the collection, and each is judged by its own document."""
    known: dict[bytes, int] = {}
    which = np.array([known.setdefault(s, len(known)) for s in strings], dtype=np.int64)
    own = ColumnWise(list(known), span, folder)
    if own.width < span:
        return which[:0], which[:0]
    ranks, ids = own.classes()
    sizes = np.arange(own.width + 1)
    valid = (sizes >= span) & (sizes <= own.length[:, None])
    first = np.full(own.n, np.iinfo(np.int64).max)
    np.minimum.at(first, which, docs)
    least = np.full(ids[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, ids[ranks[valid]], np.broadcast_to(first[:, None], ranks.shape)[valid])
    met = np.where(valid, least[ids[ranks]], np.iinfo(np.int64).max)
    i, back = np.nonzero(met[which, :][:, ::-1] < docs[:, None])
    return i, own.length[which[i]] - own.width + back


def repeated_starts(strings: list[bytes], docs: np.ndarray, span: int, folder: str) -> Iterator[tuple[int, np.ndarray]]:
    """(string, its starts whose next `span` bytes also start in a string of a smaller document)."""
    i, start = repeated_places(strings, docs, span, folder)
    found, at = np.unique(i, return_index=True)
    yield from zip(found.tolist(), np.split(start, at[1:]))


STRINGS = "anchor bigint, doc_id bigint, ver bigint, start int, bytes binary, core int, size int, slack int"


def _strings(rows: DataFrame, texts: DataFrame, span: int, gram: int) -> DataFrame:
    """Bytes of the spans whose anchor it is, of each open anchor: at most `slack` of them to each side of a core of `size`
    bytes, which is the anchor and lies at `core`."""
    places = rows.groupBy("doc_id", "ver").agg(F.collect_list(F.struct("anchor", "place")).alias("at"))
    low = (1 << BITS) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc_id, version, text, at in zip(*(c.to_pylist() for c in batch.columns)):
                data = (text or "").encode()
                for x in at:
                    p = x["place"]
                    pos, left, right = p >> 2 * BITS, p >> BITS & low, p & low
                    for column, value in zip(out, (x["anchor"], doc_id, version, pos - left, data[pos - left : pos + gram + right], left)):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32())
            n = len(out[0])
            yield pa.RecordBatch.from_arrays([*(pa.array(x, t) for x, t in zip(out, kinds)), pa.array(np.full(n, gram, dtype=np.int32)), pa.array(np.full(n, span - gram, dtype=np.int32))], names=["anchor", "doc_id", "ver", "start", "bytes", "core", "size", "slack"])

    return texts.join(places, ["doc_id", "ver"]).select("doc_id", "ver", "text", "at").mapInArrow(run, STRINGS)


def _beside(slack: int, parts: int) -> list[tuple[int, int]]:
    """(bytes to the left, bytes to the right) of the core: each span over the core has both of exactly one of the pairs."""
    edges = [(slack + 1) * i // parts for i in range(parts + 1)]
    return [(a, slack + 1 - b) for a, b in zip(edges, edges[1:]) if a < b]


def split(strings: DataFrame) -> DataFrame:
    """Collections of half the slack: by the bytes to the left of the core, and by those to the right of it; each span over the
    core is in one of the two."""
    a = F.floor((F.col("slack") + 1) / 2).cast("int")
    b = F.col("slack") + 1 - a
    left = strings.where(F.col("core") >= a).select("*", F.lit(0).alias("side"), (F.col("core") - a).alias("c"), (F.col("size") + a).alias("n"), (F.col("slack") - a).alias("s"))
    right = strings.where(F.octet_length("bytes") >= F.col("core") + F.col("size") + b).select("*", F.lit(1).alias("side"), F.col("core").alias("c"), (F.col("size") + b).alias("n"), (F.col("slack") - b).alias("s"))
    both = left.unionByName(right).withColumn("cut", F.greatest(F.col("c") - F.col("s"), F.lit(0)))
    core, whole = (F.substring("bytes", F.col(x) + 1, F.col(n)) for x, n in (("c", "n"), ("cut", "long")))
    both = both.withColumn("long", F.col("c") + F.col("n") + F.col("s") - F.col("cut"))
    return both.select(F.xxhash64("anchor", "side", core).alias("anchor"), "doc_id", "ver", (F.col("start") + F.col("cut")).alias("start"), whole.alias("bytes"), (F.col("c") - F.col("cut")).alias("core"), F.col("n").alias("size"), F.col("s").alias("slack"))


def may_repeat(anchor: np.ndarray, docs: np.ndarray, core: np.ndarray, size: np.ndarray, slack: np.ndarray, strings: list[bytes]) -> np.ndarray:
    """Which strings can share a span over their core with another document's: the core with the bytes beside it that such a
    span has at least is then shared too."""
    out = np.zeros(len(strings), dtype=bool)
    pairs = {w: _beside(w, PARTS) for w in np.unique(slack).tolist()}
    for side in range(max(map(len, pairs.values()), default=0)):
        keys = []
        for s, c, n, w in zip(strings, core.tolist(), size.tolist(), slack.tolist()):
            left, right = pairs[w][side] if side < len(pairs[w]) else (c + 1, 0)
            keys.append(hash(s[c - left : c + n + right]) if c >= left and c + n + right <= len(s) else None)
        ok = np.array([k is not None for k in keys], dtype=bool)
        key = np.array([k or 0 for k in keys], dtype=np.int64)
        order = np.lexsort((docs, key, anchor, ~ok))
        order = order[: ok.sum()]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (anchor[order[1:]] != anchor[order[:-1]]) | (key[order[1:]] != key[order[:-1]])
        group = np.cumsum(new) - 1
        first = docs[order][new]
        many = np.zeros(group[-1] + 1 if len(group) else 0, dtype=bool)
        many[group[docs[order] != first[group]]] = True
        out[order[many[group]]] = True
    return out


FOUND = "doc_id bigint, ver bigint, lo int, hi int"


def _by_suffixes(strings: DataFrame, n: int, span: int) -> DataFrame:
    tasks = max(1, -(-n // TASK_STRINGS))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("anchor", "ascending"), ("doc_id", "ascending"), ("start", "ascending")])
        anchor, docs, versions, starts, core, size, slack = (t[c].to_numpy() for c in ("anchor", "doc_id", "ver", "start", "core", "size", "slack"))
        strings = t["bytes"].to_pylist()
        live = np.flatnonzero(may_repeat(anchor, docs, core, size, slack, strings))
        known, distinct = {}, []  # how many different strings there are up to each
        for r in live:
            known.setdefault(strings[r], None)
            distinct.append(len(known))
        new, found = np.append(True, anchor[live[1:]] != anchor[live[:-1]]), [[np.array([], dtype=np.int64)] * 4]
        with tempfile.TemporaryDirectory() as folder:  # this task's own sequential files, gone with it
            at, ends = 0, np.append(np.flatnonzero(new)[1:], len(live))  # an anchor's strings stay together
            while at < len(live):
                full = min(bisect.bisect_left(distinct, (distinct[at - 1] if at else 0) + BATCH_STRINGS), at + BATCH_ROWS - 1)
                end = int(ends[min(np.searchsorted(ends, full + 1), len(ends) - 1)])
                rows = live[at:end]
                i, start = repeated_places([strings[r] for r in rows], docs[rows], span, folder)
                head = np.append(True, (i[1:] != i[:-1]) | (start[1:] > start[:-1] + span))[: len(i)]
                tail = np.append(head[1:], True)[: len(i)]
                own = rows[i[head]]
                found.append([docs[own], versions[own], starts[own] + start[head], starts[own] + start[tail] + span])
                at = end
        d, v, lo, hi = map(np.concatenate, zip(*found))
        return pa.table({"doc_id": pa.array(d), "ver": pa.array(v), "lo": pa.array(lo.astype(np.int32)), "hi": pa.array(hi.astype(np.int32))})

    return strings.withColumn("task", F.pmod(F.xxhash64("anchor"), F.lit(tasks))).groupBy("task").applyInArrow(run, FOUND)


def _single_spans(strings: DataFrame, span: int) -> DataFrame:
    """Collections without slack are one span each: its least document, with partial sums."""
    spans = strings.where(F.octet_length("bytes") == span)
    least = spans.groupBy("bytes").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most")
    return spans.join(least, "bytes").where("doc_id > least").select("doc_id", "ver", F.col("start").alias("lo"), (F.col("start") + span).alias("hi"))


def _ends_of_repeats(strings: DataFrame, span: int, made: list[str]) -> DataFrame:
    """Repeats among the strings of each anchor; collections of over HOT_STRINGS are split until they are small or single spans."""
    found = None
    while True:
        hot = materialize(strings.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_STRINGS).select("anchor"), "repeat-hot", made)
        crowded = not hot.isEmpty()
        small = strings.join(hot, "anchor", "left_anti") if crowded else strings
        more = _by_suffixes(small, strings.count(), span)
        if crowded:
            large = strings.join(hot, "anchor", "left_semi")
            more = more.unionByName(_single_spans(large.where("slack = 0"), span))
        found = more if found is None else found.unionByName(more)
        if not crowded:
            return found
        strings = materialize(split(large.where("slack > 0")), "repeat-strings", made)


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes left, `with_text`).

    Each byte is removed that a string of `span` bytes covers which also starts in a document with a smaller doc_id;
    overlaps count, and strings are judged on the input.  Null and empty texts have no bytes.  Rows with one doc_id take
    nothing from each other, and each is judged by its own text.  A null doc_id is below all others.  Equal texts are
    settled by their hash.  Empty tables give no rows; other columns are ignored; long texts are worked on whole.
    """
    spark, kept, made = docs.sparkSession, [], []
    base = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(2**63))).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    slim = materialize(base.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2("text", 256).alias("sha"), F.xxhash64("text").alias("h")), "repeat-texts", kept)
    # a row's key is its doc_id and, where rows of different texts have that, the hash of its text
    many = materialize(slim.groupBy("doc_id").agg(F.min("sha").alias("a"), F.max("sha").alias("b")).where("a <> b").select("doc_id", F.lit(True).alias("many")), "repeat-ids", kept)
    if many.isEmpty():
        base, slim = (df.withColumn("ver", F.lit(0).cast("bigint")) for df in (base, slim))
    else:
        base, slim = (df.join(many, "doc_id", "left").withColumn("ver", F.when(F.col("many"), h).otherwise(F.lit(0).cast("bigint"))).drop("many") for df, h in ((base, F.xxhash64("text")), (slim, F.col("h"))))
    key = ["doc_id", "ver"]
    first = slim.where(F.col("n_bytes") >= span).groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    copied = materialize(first.where("first < last").select("sha", "first"), "repeat-copies", kept)
    whole = slim.join(copied, "sha").where("doc_id > first").select(*key, F.lit(0).alias("lo"), F.col("n_bytes").cast("int").alias("hi"))
    texts = base.where(F.octet_length("text") >= span)
    size = slim.agg(F.sum("n_bytes")).first()[0] or 0
    marks = materialize(settle(texts, wide_anchors(texts, span, gram), size, span, gram), "repeat-marks", made)
    done = marks.where("end > 0").select(*key, F.col("place").cast("int").alias("lo"), F.col("end").cast("int").alias("hi"))
    strings = materialize(_strings(marks.where("end = 0"), texts, span, gram), "repeat-strings", made)
    found = done.unionByName(whole).unionByName(_ends_of_repeats(strings, span, made))
    spans = materialize(found.groupBy(*key).agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("spans")), "repeat-spans", kept)
    drop_tables(spark, made)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, size, removed, runs, sha, kept = [], [], [], [], [], []
            for doc_id, text, own_spans in zip(*(c.to_pylist() for c in batch.columns)):
                data = text.encode()
                left, at, count = [], 0, 0
                for s in own_spans or []:
                    lo, hi = s["lo"], min(s["hi"], len(data))
                    if lo > at or not count:
                        left.append(data[at:lo])
                        count += 1
                    at = max(at, hi)
                left.append(data[at:])
                rest = b"".join(left)
                for column, value in zip((ids, size, removed, runs, sha, kept), (doc_id, len(data), len(data) - len(rest), count, hashlib.sha256(rest).hexdigest(), rest)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string()), pa.array(kept if with_text else [None] * len(kept), pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    shape = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    if with_text:
        out = base.join(spans, key, "left").select("doc_id", "text", "spans").mapInArrow(cut, shape)
    else:  # texts are read again only where a part of them goes
        gone = whole.select(*key).distinct()
        out = base.join(spans.join(gone, key, "left_anti"), key).select("doc_id", "text", "spans").mapInArrow(cut, shape)
        all_gone = slim.join(gone, key).select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("bigint").alias("n_spans"), F.sha2(F.lit(""), 256).alias("kept_sha256"))
        untouched = slim.join(spans.select(*key), key, "left_anti").select("doc_id", "n_bytes", F.lit(0).cast("bigint").alias("n_removed"), F.lit(0).cast("bigint").alias("n_spans"), F.col("sha").alias("kept_sha256"))
        out = out.drop("kept").unionByName(all_gone).unionByName(untouched)
    return out.withColumn("doc_id", F.when(F.col("doc_id") > -(2**63), F.col("doc_id")))


ORACLE_SQL = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
g AS (SELECT doc_id, i, substring(h, 2 * i + 1, 100) AS w FROM (SELECT doc_id, h, unnest(range(n - 49)) AS i FROM t WHERE n >= 50)),
f AS (SELECT w, min(doc_id) AS first FROM g GROUP BY w),
hit AS (SELECT g.doc_id, g.i FROM g JOIN f USING (w) WHERE g.doc_id > f.first),
o AS (SELECT doc_id, i, CASE WHEN i - 50 > lag(i) OVER (PARTITION BY doc_id ORDER BY i) OR lag(i) OVER (PARTITION BY doc_id ORDER BY i) IS NULL THEN 1 ELSE 0 END AS starts FROM hit),
k AS (SELECT doc_id, i, sum(starts) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM o),
sp AS (SELECT doc_id, span, min(i) AS lo, max(i) + 50 AS hi FROM k GROUP BY doc_id, span),
gap AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before, lead(lo) OVER (PARTITION BY doc_id ORDER BY lo) AS next FROM sp),
cut AS (SELECT doc_id, count(*) AS n_spans, sum(hi - lo) AS n_removed, string_agg(substring(h, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) || any_value(substring(h, 2 * hi + 1)) FILTER (WHERE next IS NULL) AS kept FROM gap JOIN t USING (doc_id) GROUP BY doc_id)
SELECT t.doc_id, t.n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM t LEFT JOIN cut USING (doc_id)
"""
