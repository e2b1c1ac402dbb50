"""Exact duplicates: immutable snapshots, each with static binary-fuse filters.

A snapshot is a table of distinct digests in buckets of bounded size, and one filter per bucket.
Incoming digests are grouped among themselves first, so that copies within a batch, however
many, are one row; then the filter of their bucket screens them.  What a filter lets pass joins
the exact bucket, where the whole key is compared: SHA-256, byte length and an independent
BLAKE2b digest of the normalised bytes.  What it holds back is new for certain.

Texts that met another one are then compared byte by byte: per key the least and the greatest of the
normalised texts are found, in the map tasks first, so a text that a third of all rows have is sent once
per task.  Texts that met none aren't sent.  If texts of one key differ, their bytes become part of
the key and the groups are made anew.

Cases with a defined result: a null text counts as empty, and empty texts equal one another and
texts of white space only; of rows with equal texts and lengths that with the smallest doc_id stays,
a null doc_id comes last; of rows that are repeated whole exactly one is kept.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import decontamination, words
from .storage import stored

KEY = ("digest", "check", "n_bytes", "apart")
DIGESTS_A_BUCKET = 100_000


def _normalised(texts: pa.Array) -> Iterator[bytes]:
    """The UTF-8 of each text without ASCII white space; a null is empty."""
    for text in pc.fill_null(texts, ""):
        yield text.as_buffer().to_pybytes().translate(None, words.WHITE_SPACE)


def sha256(raw: bytes) -> bytes:
    return hashlib.sha256(raw).digest()


def blake2b(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def digests(docs: DataFrame, differing: frozenset[bytes] = frozenset(), strong=sha256, second=blake2b) -> DataFrame:
    """(doc_id, n_chars_all, digest, check, n_bytes, apart) of each row of ``docs`` (doc_id, text); narrow.

    The digests are of the text without ASCII white space, n_chars_all counts the code points of
    the whole text.  ``apart`` is empty; for digests that different texts have, it is the text.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest, check, size, apart = [], [], [], []
            for raw in _normalised(batch.column("text")):
                digest.append(strong(raw))
                check.append(second(raw))
                size.append(len(raw))
                apart.append(raw if digest[-1] in differing else b"")
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"),
                "n_chars_all": pc.utf8_length(pc.fill_null(batch.column("text"), "")).cast(pa.int64()),
                "digest": pa.array(digest, pa.binary()), "check": pa.array(check, pa.binary()),
                "n_bytes": pa.array(size, pa.int64()), "apart": pa.array(apart, pa.binary())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        read, "doc_id long, n_chars_all long, digest binary, check binary, n_bytes long, apart binary")


def differing_texts(docs: DataFrame, met: DataFrame, strong=sha256, second=blake2b) -> DataFrame:
    """The digests (digest) of ``met`` that texts of unequal bytes have, their second digest and length being equal.

    A bit table of a fixed size, made of the digests of ``met``, tells which texts are sent; some more
    than are wanted may pass, and the more digests there are the more do.  Each is compared all the same.
    """
    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch({"key": pa.array(_keys(batch.column("digest")).view(np.int64))})

    shared = docs.sparkSession.sparkContext.broadcast(
        decontamination.screen(met.select("digest").mapInArrow(key, "key long")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = list(_normalised(batch.column("text")))
            digest = [strong(raw) for raw in texts]
            wanted = np.flatnonzero(decontamination._passes(shared.value, _keys(pa.array(digest, pa.binary()))))
            once = list({(digest[i], texts[i]): None for i in wanted})
            yield pa.record_batch({
                "digest": pa.array([d for d, _ in once], pa.binary()),
                "check": pa.array([second(raw) for _, raw in once], pa.binary()),
                "n_bytes": pa.array([len(raw) for _, raw in once], pa.int64()),
                "raw": pa.array([raw for _, raw in once], pa.binary())})

    texts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(
        read, "digest binary, check binary, n_bytes long, raw binary")
    return (texts.groupBy("digest", "check", "n_bytes").agg(F.min("raw").alias("least"), F.max("raw").alias("greatest"))
            .filter("least <> greatest").select("digest").distinct())


def groups(rows: DataFrame) -> DataFrame:
    """One row per distinct text: its key, group_size, and ``best``, the row that stays."""
    return rows.groupBy(*KEY).agg(
        F.count("*").alias("group_size"),
        F.min(F.struct((-F.col("n_chars_all")).alias("shorter"), F.col("doc_id").isNull().alias("nameless"),
                       "doc_id", "row")).alias("best"))


class Fuse(NamedTuple):
    """Three-wise binary-fuse filter with 16-bit fingerprints."""
    seed: int
    segment: int  # slots, a power of two
    segments: int  # that a first slot can be in
    prints: np.ndarray

    @staticmethod
    def _places(keys: np.ndarray, seed: int, segment: int, segments: int):
        h = words.mix(keys + np.uint64(seed))
        first = ((h >> np.uint64(32)) * np.uint64(segments * segment)) >> np.uint64(32)
        low = np.uint64(segment - 1)
        second = (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & low)
        third = (first + np.uint64(2 * segment)) ^ (h & low)
        prints = (words.mix(h) & np.uint64(0xFFFF)).astype(np.uint16)
        return np.stack([first, second, third]).astype(np.int64), prints

    @classmethod
    def build(cls, keys: np.ndarray) -> Fuse:
        """Filter of distinct keys; tries other seeds until all keys can be peeled."""
        n = max(2, len(keys))
        segment = 1 << max(2, int(math.log(n) / math.log(3.33) + 2.25))
        room = n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n))
        segments = max(1, math.ceil(room / segment) - 2)
        for seed in range(1, 200):
            places, prints = cls._places(keys, seed, segment, segments)
            rounds = cls._peel(places, (segments + 2) * segment)
            if rounds is not None:
                break
            if seed % 20 == 0:
                segments += 1 + segments // 8
        else:
            raise RuntimeError("no binary-fuse filter found; are the keys distinct?")
        table = np.zeros((segments + 2) * segment, dtype=np.uint16)
        for chosen, slots in reversed(rounds):
            table[slots] = 0  # free until now
            table[slots] = prints[chosen] ^ np.bitwise_xor.reduce(table[places[:, chosen]], axis=0)
        return cls(seed, segment, segments, table)

    @staticmethod
    def _peel(places: np.ndarray, size: int):
        """Rounds of (keys, their slots): slots that one remaining key has to itself."""
        count = np.bincount(places.ravel(), minlength=size)
        owner = np.zeros(size, dtype=np.int64)
        every = np.arange(places.shape[1])
        for row in places:
            np.bitwise_xor.at(owner, row, every)
        left, rounds = places.shape[1], []
        slots = np.flatnonzero(count == 1)
        while len(slots):
            chosen, at = np.unique(owner[slots], return_index=True)
            rounds.append((chosen, slots[at]))
            left -= len(chosen)
            for row in places:
                np.subtract.at(count, row[chosen], 1)
                np.bitwise_xor.at(owner, row[chosen], chosen)
            touched = np.unique(places[:, chosen])
            slots = touched[count[touched] == 1]
        return None if left else rounds

    def has(self, keys: np.ndarray) -> np.ndarray:
        places, prints = self._places(keys, self.seed, self.segment, self.segments)
        return np.bitwise_xor.reduce(self.prints[places], axis=0) == prints


def _keys(digest: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(d[:8] for d in digest.to_pylist()), dtype=np.uint64)


class Snapshot(NamedTuple):
    """Distinct digests of earlier rows, and the filters of their buckets."""
    known: DataFrame  # bucket, key, group_size, best
    filters: DataFrame  # bucket, seed, segment, segments, prints
    buckets: int


def _bucketed(grouped: DataFrame, buckets: int) -> DataFrame:
    # digests are spread evenly, and each is there once: no bucket can be hot
    return grouped.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int"))


def write_snapshot(grouped: DataFrame) -> Snapshot:
    """Write the distinct digests and build a filter for each bucket."""
    grouped = stored(grouped, "digests")
    buckets = grouped.count() // DIGESTS_A_BUCKET + 1
    known = stored(_bucketed(grouped, buckets), "snapshot")

    def build(table: pa.Table) -> pa.Table:
        keys = np.unique(_keys(table.column("digest")))
        fuse = Fuse.build(keys)
        return pa.table({"bucket": table.column("bucket").slice(0, 1), "seed": [fuse.seed], "segment": [fuse.segment],
                         "segments": [fuse.segments], "prints": pa.array([fuse.prints.tobytes()], pa.binary())})

    filters = (known.select("bucket", "digest").groupBy("bucket")
               .applyInArrow(build, "bucket int, seed long, segment long, segments long, prints binary"))
    return Snapshot(known, stored(filters, "filters"), buckets)


def screen(grouped: DataFrame, snapshot: Snapshot) -> DataFrame:
    """The groups of a new batch with ``maybe``: the filter of their bucket lets them pass.

    A batch that is larger than the snapshot is dealt over parts of its buckets, each with a copy of
    the bucket's filter.
    """
    grouped = stored(grouped, "incoming")
    parts = grouped.count() // (snapshot.buckets * DIGESTS_A_BUCKET) + 1
    incoming = _bucketed(grouped, snapshot.buckets)
    part = F.pmod(F.xxhash64("digest", F.lit(1)), F.lit(parts)).cast("int")
    filters = snapshot.filters.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    fields = "digest binary, maybe boolean"

    def test(digest: pa.Table, fuse: pa.Table) -> pa.Table:
        rows = fuse.to_pylist()
        maybe = np.zeros(len(digest), dtype=bool)
        if rows and len(digest):
            r = rows[0]
            maybe = Fuse(r["seed"], r["segment"], r["segments"],
                         np.frombuffer(r["prints"], dtype=np.uint16)).has(_keys(digest.column("digest")))
        return pa.table({"digest": digest.column("digest").cast(pa.binary()), "maybe": pa.array(maybe)})

    said = (incoming.select("bucket", part.alias("part"), "digest").distinct().groupBy("bucket", "part")
            .cogroup(filters.groupBy("bucket", "part")).applyInArrow(test, fields))
    return incoming.join(said, "digest")


def add_batch(grouped: DataFrame, snapshot: Snapshot) -> DataFrame:
    """All groups after a batch: key, group_size, best; a text of both sides is one group."""
    screened = stored(screen(grouped, snapshot), "screened")
    fields = [*KEY, "group_size", "best"]
    positives = screened.filter("maybe").select("bucket", *fields)
    fresh = screened.filter("NOT maybe").select(*fields)
    known = snapshot.known.select("bucket", *KEY, F.col("group_size").alias("known_size"), F.col("best").alias("known_best"))
    both = known.join(positives, ["bucket", *KEY], "full")  # the exact check: equal in all of the key
    met = both.select(*KEY, (F.coalesce("group_size", F.lit(0)) + F.coalesce("known_size", F.lit(0))).alias("group_size"),
                      F.least("best", "known_best").alias("best"))
    return met.unionByName(fresh)


def _grouped(docs: DataFrame, first_batch: str, differing: frozenset[bytes], strong, second) -> tuple[DataFrame, DataFrame]:
    """The digests of all rows with a number each, and the groups of equal keys; both written."""
    # the number tells apart rows that are repeated whole; it is written, so it stays as it is
    rows = stored(digests(docs, differing, strong, second).withColumn("row", F.monotonically_increasing_id()), "digests-of-rows")
    first = F.coalesce(F.expr(first_batch), F.lit(False))
    snapshot = write_snapshot(groups(rows.filter(first)))
    return rows, stored(add_batch(groups(rows.filter(~first)), snapshot), "groups")


def exact_duplicates(docs: DataFrame, first_batch: str = "pmod(xxhash64(doc_id), 2) = 0",
                     strong=sha256, second=blake2b) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Rows for which ``first_batch`` holds make the snapshot, the others are the batch that it screens;
    the split changes nothing in the result.  ``strong`` and ``second`` are the digests of a text's bytes.
    """
    rows, found = _grouped(docs, first_batch, frozenset(), strong, second)
    # no two texts are known that agree in both digests; were there any, they would be few
    differing = differing_texts(docs, found.filter("group_size > 1"), strong, second).collect()
    if differing:
        rows, found = _grouped(docs, first_batch, frozenset(bytes(r.digest) for r in differing), strong, second)
    return rows.join(found, list(KEY)).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))
