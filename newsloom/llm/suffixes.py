"""Repeated byte strings across documents, by bucket-pointer refinement of sampled suffixes.

Every byte that a string of ``length`` bytes covers goes, if the string also starts earlier (smaller
doc_id, or earlier in the same document).  Strings are judged on the input and never cross documents.

Suffixes are sampled: of each window of ``length`` bytes the 32-gram with the least hash is its anchor,
so equal windows have equal anchors at the same distance, and about one suffix in 35 is an anchor.
Windows that share an anchor stand on end; together they are a stretch.

1. Anchors get the bucket of their 32-gram.  Within a bucket they are sorted by the identifier of their
   whole stretch.  Of equal stretches all but the earliest go.
2. Where a bucket still has different stretches, their bytes are fetched, and all positions in them are
   refined: buckets of 8-grams first, then by the bucket pointer 8, 16, 32 and at last 36 bytes on, so that
   each round doubles the depth by what earlier rounds have found.  Positions that are alone in their
   bucket are final and take no further part.  After 100 bytes, all but the earliest go.

Step 2 compares bytes; step 1 needs two independent 64-bit hashes to agree.  Copies within an Arrow batch
collapse before anything is shuffled, stretches and windows alike.  Buckets of very many rows are counted
first: their stretches are dealt by bucket and identifier, then split into single windows under their own
hash.  So of one bucket at most ``split_from`` stretches meet in a task of step 1, and one more for each task
that had a single one, which is not counted; and one window of a kind for each batch of step 2.  Tasks
read rows sorted by bucket and hold a few megabytes, or twice the largest bucket.

Cases with a defined result: a null or empty text has no bytes; shorter texts than ``length`` keep all;
of rows with one doc_id the hash of the text decides which is earlier; rows repeated whole are one document
and get equal results; a null doc_id comes first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .storage import stored


@dataclass(frozen=True)
class RepeatParams:
    length: int = 100
    gram: int = 32  # bytes of an anchor
    split_from: int = 20_000  # different stretches of a bucket; larger buckets are split by window


_NULL_ID = np.iinfo(np.int64).min
_POSITION = np.uint64(0xFFFFFFFF)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    reach, out = 1, x
    while 2 * reach <= width:
        out = np.minimum(out[:-reach], out[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def _merged(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of the intervals of each owner; those that touch become one."""
    if not len(owner):
        return owner, start, end
    order = np.lexsort((start, owner))
    owner, start, end = owner[order], start[order], end[order]
    group = np.concatenate([[0], np.cumsum(owner[1:] != owner[:-1])])
    room = int(end.max()) + 2
    reach = np.maximum.accumulate(end + group * room)  # owners lie apart
    new = np.concatenate([[True], start[1:] + group[1:] * room > reach[:-1]])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(new)]]) - 1
    return owner[first], start[first], reach[last] - group[last] * room


def stretches(block: words.Block, params: RepeatParams):
    """Document, first start, number of starts, anchor hash and identifier of each stretch of a block."""
    length, gram = params.length, params.gram
    size = len(block.data)
    if size < length:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    rolling = words.rolling(block, fold=False)
    at = np.arange(size - gram + 1)
    grams = rolling.of(at, at + gram)
    least = _sliding_min((grams & ~_POSITION) | at.astype(np.uint64), length - gram + 1)
    anchor = (least & _POSITION).astype(np.int64)  # of the window that starts here; the first of equal ones
    starts = np.arange(len(anchor))
    room = np.repeat(block.offsets[1:], np.diff(block.offsets))[:len(anchor)] - starts
    whole = room >= length
    new = whole.copy()
    new[1:] &= ~whole[:-1] | (anchor[1:] != anchor[:-1])
    low = np.flatnonzero(new)
    # a stretch ends before the next one begins, or where windows no longer fit into the document
    document = np.searchsorted(block.offsets, low, side="right") - 1
    high = np.minimum(np.concatenate([low[1:], [len(anchor)]]), block.offsets[document + 1] - length + 1)
    count = high - low
    place = (anchor[low] - low).astype(np.uint64)
    name = words.mix(rolling.of(low, high - 1 + length) + place * np.uint64(0x9FB21C651E98DF25) + count.astype(np.uint64))
    return document, low - block.offsets[document], count, grams[anchor[low]], name


_ROW = pa.schema([("bucket", pa.int64()), ("name", pa.int64()), ("doc_id", pa.int64()), ("twin", pa.int64()),
                  ("start", pa.int64()), ("count", pa.int64()), ("gone", pa.bool_())])
_ROW_SQL = "bucket long, name long, doc_id long, twin long, start long, count long, gone boolean"


def _not_first(group: np.ndarray, ids: np.ndarray, twins: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Marks all rows of a group but the earliest; the same place again is no later one."""
    later = np.zeros(len(group), dtype=bool)
    if len(group):
        order = np.lexsort((starts, twins, ids, group))
        sorted_group = group[order]
        first = np.concatenate([[True], sorted_group[1:] != sorted_group[:-1]])
        earliest = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
        later[order] = (ids[order] != ids[earliest]) | (twins[order] != twins[earliest]) | (starts[order] != starts[earliest])
    return later


def _groups(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Dense numbers of the distinct pairs."""
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.concatenate([[0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))]) if len(order) else []
    return number


def _keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    ids = pc.fill_null(batch.column("doc_id"), _NULL_ID).to_numpy(zero_copy_only=False)
    return ids, batch.column("twin").to_numpy(zero_copy_only=False)


def _intervals(ids, twins, starts, ends) -> pa.RecordBatch:
    """Intervals that go, as rows without a bucket of their own."""
    spread = words.mix(ids.astype(np.uint64) + starts.astype(np.uint64)).view(np.int64)
    return pa.record_batch([pa.array(spread), pa.array(np.zeros(len(ids), np.int64)), pa.array(ids), pa.array(twins),
                            pa.array(starts), pa.array(ends - starts), pa.array(np.ones(len(ids), bool))], schema=_ROW)


def _of_batch(batch: pa.RecordBatch, params: RepeatParams) -> tuple[np.ndarray, ...] | None:
    """:func:`stretches` of all documents of a batch."""
    parts = []
    for block in words.blocks(batch.column("text")):
        document, start, count, bucket, name = stretches(block, params)
        parts.append((document + block.rows.start, start, count, bucket.view(np.int64), name.view(np.int64)))
    return tuple(np.concatenate(c) for c in zip(*parts)) if parts else None


_HAD_BITS = 24
_BROADCAST_ROWS = 200_000


def _large(docs: DataFrame, params: RepeatParams) -> DataFrame:
    """The buckets of at least ``split_from`` rows of :func:`_anchors`; a task's only one of a bucket doesn't count.

    Which buckets a task had is remembered by a hash, so some that are not its first of the hash count, too.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        had = np.zeros(1 << _HAD_BITS, dtype=bool)
        for batch in batches:
            found = _of_batch(batch, params)
            if found is None:
                continue
            *_, bucket, name = found
            group = _groups(bucket, name)
            first = np.unique(group, return_index=True)[1]
            own, rows = np.unique(bucket[first], return_counts=True)
            slot = (words.mix(own.view(np.uint64)) >> np.uint64(64 - _HAD_BITS)).astype(np.int64)
            again = (rows > 1) | had[slot]
            had[slot] = True
            yield pa.record_batch({"large": pa.array(own[again]), "n": pa.array(rows[again].astype(np.int64))})

    return (docs.mapInArrow(read, "large long, n long").groupBy("large").agg(F.sum("n").alias("n"))
            .filter(F.col("n") >= params.split_from).select("large"))


def _anchors(docs: DataFrame, params: RepeatParams) -> DataFrame:
    """A row per stretch that may be the earliest of its kind, and the intervals known to go."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, twins = _keys(batch)
            found = _of_batch(batch, params)
            if found is None:
                continue
            document, start, count, bucket, name = found
            later = _not_first(_groups(bucket, name), ids[document], twins[document], start)
            stay = ~later
            owner, low, high = _merged(document[later], start[later], start[later] + count[later] - 1 + params.length)
            yield pa.record_batch([pa.array(c[stay]) for c in (bucket, name, ids[document], twins[document], start, count)]
                                  + [pa.array(np.zeros(int(stay.sum()), bool))], schema=_ROW)
            yield _intervals(ids[owner], twins[owner], low, high)

    return docs.mapInArrow(read, _ROW_SQL)


def whole_buckets(batches: Iterator[pa.RecordBatch], room: int) -> Iterator[pa.Table]:
    """Tables of whole buckets from batches in the order of their column bucket.

    Held are ``room`` bytes, or twice the largest bucket, which keeps the work linear in its size.
    """
    held, size, wait = [], 0, room
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size < wait:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        bucket = table.column("bucket").to_numpy()
        cut = int(np.searchsorted(bucket, bucket[-1]))  # the last one may go on
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).to_batches()
        size = sum(b.nbytes for b in held)
        wait = max(room, 2 * size)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


_SORTED = 32_000_000  # bytes of rows sorted at once; a bucket is never cut
_FOUND = "doc_id long, twin long, start long, count long, bucket long, state int"
GONE, OPEN, WIDE = 0, 1, 2  # an interval that goes; a stretch to compare; the same in a large bucket


def _dealt(anchors: DataFrame, large: DataFrame) -> DataFrame:
    """Anchors by bucket, those of large buckets by identifier too, in the order of buckets.

    ``large`` has at most a row for ``split_from`` anchors, and is broadcast only while these are few.
    """
    if large.count() <= _BROADCAST_ROWS:
        large = F.broadcast(large)
    marked = anchors.join(large, anchors.bucket == F.col("large"), "left")
    return (marked.select(*_ROW.names, F.col("large").isNotNull().alias("wide"))
            .repartition("bucket", F.when(F.col("wide"), F.col("name"))).sortWithinPartitions("bucket"))


def _buckets(dealt: DataFrame, params: RepeatParams) -> DataFrame:
    """Sort each bucket by the identifiers of its stretches."""
    def sort(table: pa.Table) -> Iterator[pa.RecordBatch]:
        bucket, name, ids, twins, start, count, known, wide = (table.column(c).to_numpy() for c in (*_ROW.names, "wide"))
        later = np.zeros(len(bucket), dtype=bool)
        live = np.flatnonzero(~known)
        bucket_of, size = np.unique(bucket[live], return_inverse=True, return_counts=True)[1:]
        several = (size[bucket_of] > 1) | wide[live]  # others are final
        live, bucket_of = live[several], bucket_of[several]
        later[live] = _not_first(_groups(bucket[live], name[live]), ids[live], twins[live], start[live])
        different = live[~later[live]]
        kinds = np.bincount(bucket_of[~later[live]], minlength=len(size))[bucket_of[~later[live]]]
        kinds = np.where(wide[different], max(params.split_from, 2), kinds)  # others may be in other tasks
        open_, kinds = different[kinds > 1], kinds[kinds > 1]
        gone = np.flatnonzero(known | later)
        span = np.where(known, count, count - 1 + params.length)
        for rows, size_, state in ((gone, span[gone], np.full(len(gone), GONE)),
                                   (open_, count[open_], np.where(kinds >= params.split_from, WIDE, OPEN))):
            if len(rows):
                yield pa.record_batch({
                    "doc_id": pa.array(ids[rows]), "twin": pa.array(twins[rows]), "start": pa.array(start[rows]),
                    "count": pa.array(size_), "bucket": pa.array(bucket[rows]), "state": pa.array(state, pa.int32())})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_buckets(batches, _SORTED):
            yield from sort(table)

    return dealt.mapInArrow(read, _FOUND)


_BYTES = "bucket long, doc_id long, twin long, start long, count long, bytes binary"


def _windows(pieces: list[tuple], params: RepeatParams) -> Iterator[pa.RecordBatch]:
    """The windows of stretches (doc_id, twin, start, bytes) under their own hash; of equal ones the earliest, others go."""
    length = params.length
    ids, twins, start = (np.array(c, dtype=np.int64) for c in list(zip(*pieces))[:3])
    sizes = np.array([len(p[3]) for p in pieces], dtype=np.int64)
    data = np.frombuffer(b"".join(p[3] for p in pieces), np.uint8)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    count = sizes - length + 1
    row = np.repeat(np.arange(len(pieces)), count)
    step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    at = offsets[row] + step
    own = words.rolling(words.Block(slice(0, len(pieces)), data, offsets), fold=False).of(at, at + length).view(np.int64)
    place = (ids[row], twins[row], start[row] + step)
    order = np.lexsort((*place[::-1], own))
    first = np.concatenate([[True], own[order][1:] != own[order][:-1]])
    earliest = np.empty(len(order), dtype=np.int64)
    earliest[order] = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
    bytes_ = np.lib.stride_tricks.sliding_window_view(data, length)[at]
    equal = (bytes_ == bytes_[earliest]).all(axis=1)
    moved = np.zeros(len(row), dtype=bool)
    for column in place:
        moved |= column != column[earliest]
    later = equal & moved
    stay = np.flatnonzero(~equal | (earliest == np.arange(len(row))))
    kept = pa.FixedSizeBinaryArray.from_buffers(pa.binary(length), len(stay), [None, pa.py_buffer(bytes_[stay].tobytes())])
    yield pa.record_batch([pa.array(c[stay]) for c in (own, *place, np.ones(len(row), np.int64))] + [kept.cast(pa.binary())],
                          schema=_BYTES_ROW)
    owner, low, high = _merged(row[later], place[2][later], place[2][later] + length)
    spread = words.mix(ids[owner].astype(np.uint64) + low.astype(np.uint64)).view(np.int64)
    yield pa.record_batch([pa.array(c) for c in (spread, ids[owner], twins[owner], low, high - low)]
                          + [pa.nulls(len(owner), pa.binary())], schema=_BYTES_ROW)


_BYTES_ROW = pa.schema([("bucket", pa.int64()), ("doc_id", pa.int64()), ("twin", pa.int64()), ("start", pa.int64()),
                        ("count", pa.int64()), ("bytes", pa.binary())])
_HELD = 20_000_000  # bytes of windows held at once, or those of one stretch


def _fetched(docs: DataFrame, found: DataFrame, params: RepeatParams) -> DataFrame:
    """The bytes of the stretches to compare; those of large buckets window by window, equal ones of a batch once.

    Rows without bytes are intervals that go: ``count`` bytes each.
    """
    wanted = (found.filter(F.col("state") != GONE)
              .groupBy("doc_id", "twin").agg(F.collect_list(F.struct("start", "count", "bucket", "state")).alias("wanted")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in _BYTES_ROW.names}
            pieces, held = [], 0
            for doc_id, twin, text, wanted_ in zip(*(batch.column(c) for c in ("doc_id", "twin", "text", "wanted"))):
                raw = memoryview(text.as_buffer())
                for w in wanted_.as_py():
                    piece = bytes(raw[w["start"]:w["start"] + w["count"] - 1 + params.length])
                    if w["state"] == WIDE:
                        pieces.append((doc_id.as_py(), twin.as_py(), w["start"], piece))
                        held += w["count"] * params.length
                        if held >= _HELD:
                            yield from _windows(pieces, params)
                            pieces, held = [], 0
                    else:
                        for k, v in zip(rows, (w["bucket"], doc_id.as_py(), twin.as_py(), w["start"], w["count"], piece)):
                            rows[k].append(v)
            yield pa.record_batch([pa.array(rows[f.name], f.type) for f in _BYTES_ROW], schema=_BYTES_ROW)
            if pieces:
                yield from _windows(pieces, params)

    return _with(docs, wanted).filter("wanted IS NOT NULL").mapInArrow(read, _BYTES)


def _with(docs: DataFrame, small: DataFrame) -> DataFrame:
    """Documents with the columns of ``small``; both uses of it deal the texts alike, so they are dealt once."""
    named = small.withColumnsRenamed({"doc_id": "_id", "twin": "_twin"}).hint("shuffle_hash")
    return docs.join(named, (docs.doc_id == named["_id"]) & (docs.twin == named["_twin"]), "left")


def refine(data: np.ndarray, depths: tuple[int, ...]) -> np.ndarray:
    """Bucket of every position of ``data`` by its next bytes, as exact as ``depths`` go.

    The first bucket is by 8 bytes; each depth d sorts by the pointer d bytes on.  Positions near the end
    are compared as though zeros followed.
    """
    padded = np.concatenate([data, np.zeros(8 + sum(depths), np.uint8)])
    value = np.zeros(len(data), dtype=np.uint64)
    for k in range(8):
        value |= padded[k:k + len(data)].astype(np.uint64) << np.uint64(8 * k)
    pointer, size = np.unique(value, return_inverse=True, return_counts=True)[1:]
    next_name = len(size)
    shared = size[pointer] > 1
    pointer = np.concatenate([pointer.astype(np.int64), np.full(sum(depths), -1)])
    for depth in depths:
        at = np.flatnonzero(shared)
        pair = ((pointer[at] + 1).astype(np.uint64) << np.uint64(32)) | (pointer[at + depth] + 1).astype(np.uint64)
        new, size = np.unique(pair, return_inverse=True, return_counts=True)[1:]
        pointer[at] = next_name + new
        next_name += len(size)
        shared[at] = size[new] > 1
    return pointer[:len(data)]


def _depths(length: int) -> tuple[int, ...]:
    depths, done = [], 8
    while done < length:
        step = min(done, length - done)
        depths.append(step)
        done += step
    return tuple(depths)


_CHUNK = 2_000_000  # bytes refined at once; a bucket is never cut


def _compared(fetched: DataFrame, params: RepeatParams) -> DataFrame:
    """Intervals that go, after comparing the bytes of all stretches of a bucket."""
    depths = _depths(params.length)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_buckets(batches, _CHUNK):
            known = pc.is_null(table.column("bytes"))
            yield from table.filter(known).select(["doc_id", "twin", "start", "count"]).to_batches()
            part = table.filter(pc.invert(known))
            if not part.num_rows:
                continue
            part = part.combine_chunks()
            raw = part.column("bytes").to_pylist()
            base = np.concatenate([[0], np.cumsum([len(r) for r in raw])[:-1]]).astype(np.int64)
            pointer = refine(np.frombuffer(b"".join(raw), np.uint8), depths)
            ids, twins, start, count = (part.column(c).to_numpy() for c in ("doc_id", "twin", "start", "count"))
            row = np.repeat(np.arange(len(count)), count)
            step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            later = _not_first(pointer[base[row] + step], ids[row], twins[row], start[row] + step)
            begin = (start[row] + step)[later]
            owner, low, high = _merged(row[later], begin, begin + params.length)
            yield pa.record_batch({"doc_id": pa.array(ids[owner]), "twin": pa.array(twins[owner]),
                                   "start": pa.array(low), "count": pa.array(high - low)})

    return (fetched.repartition("bucket").sortWithinPartitions("bucket")
            .mapInArrow(read, "doc_id long, twin long, start long, count long"))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, twin, text; twin is 0 unless ids repeat, then the hash of the text.  Null ids get the smallest one."""
    plain = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("doc_id"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    unique = plain.groupBy("doc_id").count().filter("count > 1").isEmpty()
    return plain.select("doc_id", (F.lit(0).cast("long") if unique else F.xxhash64("text")).alias("twin"), "text")


def repeated_spans(keyed: DataFrame, params: RepeatParams) -> DataFrame:
    """(doc_id, twin, spans): the byte intervals (start, count) of a document that go, overlapping ones too."""
    large = stored(_large(keyed, params), "large")
    found = stored(_buckets(_dealt(_anchors(keyed, params), large), params), "buckets")
    compared = _compared(_fetched(keyed, found, params), params)
    gone = found.filter(F.col("state") == GONE).select("doc_id", "twin", "start", "count").unionByName(compared)
    return gone.groupBy("doc_id", "twin").agg(F.collect_list(F.struct("start", "count")).alias("spans"))


def remove_repeats(docs: DataFrame, params: RepeatParams = RepeatParams()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, spans, kept) of each row of ``docs`` (doc_id, text).

    ``spans`` are the maximal runs of removed bytes as (start, count); ``kept`` is what is left, which
    may cut characters, and so is binary.
    """
    keyed = _keyed(docs)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, n_removed, spans, kept = [], [], [], []
            for text, found in zip(batch.column("text"), batch.column("spans")):
                raw = text.as_buffer().to_pybytes()
                runs = []
                if found.is_valid:
                    pairs = found.values.flatten()
                    start, count = (p.to_numpy() for p in pairs)
                    _, low, high = _merged(np.zeros(len(start), np.int64), start, start + count)
                    runs = list(zip(low.tolist(), high.tolist()))
                n_bytes.append(len(raw))
                n_removed.append(sum(b - a for a, b in runs))
                spans.append([{"start": a, "count": b - a} for a, b in runs])
                edges = [0, *(x for run in runs for x in run), len(raw)]
                kept.append(b"".join(raw[edges[i]:edges[i + 1]] for i in range(0, len(edges), 2)) if runs else raw)
            pair = pa.struct([("start", pa.int64()), ("count", pa.int64())])
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "n_bytes": pa.array(n_bytes, pa.int64()),
                "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array([len(s) for s in spans], pa.int64()),
                "spans": pa.array(spans, pa.list_(pair)), "kept": pa.array(kept, pa.binary())})

    done = _with(keyed, repeated_spans(keyed, params)).select("doc_id", "text", "spans").mapInArrow(
        read, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,count:long>>, kept binary")
    return done.withColumn("doc_id", F.nullif("doc_id", F.lit(_NULL_ID)))
