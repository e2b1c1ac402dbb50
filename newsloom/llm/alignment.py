"""Alignment of two tokenizers, with corpus-wide pair counts by external spill counting.

Every document is cut at the byte offsets at which tokens of both sides end; the two tokens that end there
are linked.  How often a pair of ids is linked in the corpus says which id of side A goes with an id of
side B, and every document gets the sums over its own links.

Pairs are counted outside of memory.  The documents of a stretch of the corpus make one run per radix of
the B id: their records (pair, document, links) sorted by side B, then side A, packed as zstd frames,
and a shorter run of the sums per pair.  Runs are tables in the shared folder, so a lost executor costs
its own task.  The sums of a radix are merged by a heap over blocks of the runs, a bounded number of runs
at a time, level by level, until one is left; as it is in the order of side B, the highest count of an
id is known when its last pair has passed.  Then the records stream past the counts of their radix and
give each document its part.  A frequent pair is one sum per run, however often it occurs; records
of a radix are dealt over tasks by run, so no task holds all of them.

Cases with a defined result: texts that are null or empty, or whose tokens don't spell a blank and the text
(normalised, or with U+2581 in them), have no tokens: zeros, and '' for the digest; rows are judged by
place, so repeated rows and null ids count one by one.  Other columns are not read.  Memory is bounded by
a stretch or by the longest document, and by the pairs of a radix, which the vocabularies bound.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .storage import settings, stored, stored_by_batches


# fixed value: how a byte-level tokenizer cuts words
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_STABLE = "\u0240"  # characters below are of the same class in all versions of Unicode that libraries have

_MOST_TASKS = 10_000  # of a shuffle; more groups share them


@dataclass(frozen=True)
class SpillParams:
    radix: int = 16  # runs of a stretch; a power of two
    stretch: int = 4 << 20  # bytes of text whose records make one run per radix
    fan_in: int = 32  # runs that one heap merges
    frame: int = 1 << 14  # pairs of a block


class Side(NamedTuple):
    """A tokenizer: ids of texts, and the bytes of every id."""
    encode: Callable[[list[str]], list[np.ndarray]]
    data: np.ndarray  # uint8, all ids one after the other
    offsets: np.ndarray

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.offsets)


def _table(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return (np.frombuffer(b"".join(pieces), np.uint8),
            np.concatenate([[0], np.cumsum([len(p) for p in pieces], dtype=np.int64)]))


def _byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary writes for each byte: itself if it prints, else the next one past 255."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def byte_level(path: str) -> Side:
    """A byte-level tokenizer file (.json); it is given a blank and the text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
    from tokenizers import Tokenizer
    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True  # their strings are plain text
    made.no_truncation()
    letters = _byte_letters()
    pieces = [b""] * (made.get_vocab_size(with_added_tokens=True))
    for piece, number in made.get_vocab(with_added_tokens=True).items():
        known = all(c in letters for c in piece)
        pieces[number] = bytes(letters[c] for c in piece) if known else piece.encode()

    quick = _ranked(made, path, letters)

    def encode(texts: list[str]) -> list[np.ndarray]:
        spaced = [" " + t for t in texts]
        easy = [quick is not None and (t.isascii() or max(t) < _STABLE) for t in spaced]
        rest = iter(made.encode_batch_fast([t for t, e in zip(spaced, easy) if not e], add_special_tokens=False))
        return [quick.encode_to_numpy(t, disallowed_special=()) if e else np.array(next(rest).ids, dtype=np.uint32)
                for t, e in zip(spaced, easy)]

    return Side(encode, *_table(pieces))


def _ranked(made, path: str, letters: dict[str, int]):
    """The same tokenizer as a table of ranks, several times as fast; None if it isn't one.

    Merging the pair whose union has the lowest id is merging the first pair of the list if pairs are
    listed in the order of ids, every id has one pair, and every id's own bytes end as that id: then, id
    by id, no other two neighbours can make it.
    """
    import tiktoken
    with open(path, encoding="utf-8") as file:
        rules = json.load(file)
    model, before = rules["model"], rules["pre_tokenizer"] or {}
    vocabulary = model["vocab"]
    pairs = [pair if isinstance(pair, list) else pair.split(" ") for pair in model.get("merges", ())]
    known = [vocabulary.get(x + y) for x, y in pairs]
    special = {t["content"] for t in rules["added_tokens"]}
    plain = {piece: i for piece, i in vocabulary.items() if piece not in special}
    fits = (rules["normalizer"] is None and before == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
            and model["type"] == "BPE" and not any(model.get(k) for k in (
                "dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
            and known == list(range(256, 256 + len(pairs))) and sorted(plain.values()) == list(range(256 + len(pairs)))
            and all(len(made.model.tokenize(piece)) == 1 for piece in plain))
    if not fits:
        return None
    ranks = {bytes(letters[c] for c in piece): i for piece, i in plain.items()}
    return tiktoken.Encoding("ranks", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={})


def sentence_pieces(path: str) -> Side:
    """A sentencepiece model; it adds the blank itself."""
    import sentencepiece
    made = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = []
    for number in range(made.vocab_size()):
        piece = made.id_to_piece(number)
        pieces.append(bytes([int(piece[3:-1], 16)]) if made.is_byte(number) else piece.replace("▁", " ").encode())

    def encode(texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, dtype=np.uint32) for ids in made.encode(texts, num_threads=1)]

    return Side(encode, *_table(pieces))


@lru_cache(maxsize=4)  # of a worker
def side_of(path: str) -> Side:
    return sentence_pieces(path) if path.endswith(".model") else byte_level(path)


def _gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Stretches of ``data`` one after the other."""
    ends = np.cumsum(lengths)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)
    return data[at]


class Tokens(NamedTuple):
    ids: np.ndarray
    first: np.ndarray  # index of each document's first token; one more than documents
    ends: np.ndarray  # bytes up to each token's end, counted over all documents


def tokens(side: Side, texts: list[str], spelled: np.ndarray, offsets: np.ndarray) -> tuple[Tokens, np.ndarray]:
    """Tokens of ``texts``, and which of them spell the stretches of ``spelled`` between ``offsets``."""
    made = side.encode(texts)
    counts = np.array([len(m) for m in made], dtype=np.int64)
    ids = np.concatenate([np.empty(0, np.uint32), *made]).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(counts)])
    lengths = side.lengths[ids]
    sums = np.concatenate([[0], np.cumsum(lengths)])
    size = sums[first[1:]] - sums[first[:-1]]
    good = size == np.diff(offsets)
    good[np.searchsorted(first, np.flatnonzero(lengths == 0), side="right") - 1] = False  # an empty token ends nowhere
    # the bytes themselves, of the texts with the right number of them
    taken = np.repeat(good, counts)
    mine = _gather(side.data, side.offsets[ids[taken]], lengths[taken])
    theirs = spelled[np.repeat(good, np.diff(offsets))]
    wrong = np.flatnonzero(mine != theirs)
    if len(wrong):
        kept = np.flatnonzero(good)
        bounds = np.cumsum(size[kept])
        good[kept[np.unique(np.searchsorted(bounds, wrong, side="right"))]] = False
    return Tokens(ids, first, sums[1:]), good


def _only(found: Tokens, good: np.ndarray, lengths: np.ndarray) -> Tokens:
    counts = np.where(good, np.diff(found.first), 0)
    ids = found.ids[np.repeat(good, np.diff(found.first))]
    return Tokens(ids, np.concatenate([[0], np.cumsum(counts)]), np.cumsum(lengths[ids]))


def _listed(a: Tokens, b: Tokens, group_a: np.ndarray, group_b: np.ndarray) -> tuple[bytes, np.ndarray]:
    """All groups written out, each with a mark behind it, and the bytes up to the end of each group."""
    ids = np.concatenate([a.ids, b.ids])
    group = np.concatenate([group_a, group_b])
    of_b = np.concatenate([np.zeros(len(a.ids), bool), np.ones(len(b.ids), bool)])
    order = np.argsort(2 * group + of_b, kind="stable")
    ids, group, of_b = ids[order], group[order], of_b[order]
    last = np.append((group[1:] != group[:-1]) | (of_b[1:] != of_b[:-1]), True)[:len(ids)]
    mark = np.where(last, np.where(of_b, ord(";"), ord("|")), ord(","))
    width = len(str(int(ids.max()))) if len(ids) else 1
    digits = np.empty((len(ids), width + 1), dtype=np.uint8)
    shown = np.empty(digits.shape, dtype=bool)
    rest = ids
    for k in range(width - 1, -1, -1):
        shown[:, k] = (rest > 0) | (k == width - 1)
        digits[:, k] = 48 + rest % 10
        rest = rest // 10
    digits[:, width], shown[:, width] = mark, True
    ends = np.cumsum(shown.sum(axis=1))
    return digits[shown].tobytes(), ends[last & of_b]


class Aligned(NamedTuple):
    """Tokens and groups of each document, and its links as distinct records by document."""
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    digest: list[str]
    pair: np.ndarray  # uint64: B id, then A id
    document: np.ndarray
    links: np.ndarray


def align(side_a: Side, side_b: Side, texts: list[str]) -> Aligned:
    """Groups and links of ``texts``."""
    count = len(texts)
    raw = [(b" " + t.encode()) if t else b"" for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw], dtype=np.int64)])
    spelled = np.frombuffer(b"".join(raw), np.uint8)
    given = [t or "" for t in texts]
    a, good_a = tokens(side_a, given, spelled, offsets)
    b, good_b = tokens(side_b, given, spelled, offsets)
    good = good_a & good_b & (np.diff(offsets) > 0)
    a, b = _only(a, good, side_a.lengths), _only(b, good, side_b.lengths)
    total = int(a.ends[-1]) if len(a.ends) else 0
    mark = np.zeros(total + 1, dtype=bool)
    mark[a.ends] = True
    common = np.zeros(total + 1, dtype=bool)
    common[b.ends] = mark[b.ends]
    until = np.cumsum(common)  # groups that end up to a byte
    group_a, group_b = (until[x.ends] - common[x.ends] for x in (a, b))
    closing_a, closing_b = common[a.ends], common[b.ends]
    size = np.where(good, np.diff(offsets), 0)
    document = np.searchsorted(np.cumsum(size), a.ends[closing_a], side="left")  # of each group
    groups = np.bincount(document, minlength=count)
    listed, ends = _listed(a, b, group_a, group_b)
    bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(groups)])]
    digest = [hashlib.sha256(listed[x:y - 1]).hexdigest() if y > x else ""
              for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
    # no token is empty, so one of each side ends where a group does
    pair = (b.ids[closing_b].astype(np.uint64) << np.uint64(32)) | a.ids[closing_a].astype(np.uint64)
    order = np.lexsort((document, pair))
    pair, document = pair[order], document[order]
    new = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (document[1:] != document[:-1])])[:len(pair)])
    return Aligned(np.diff(a.first), np.diff(b.first), groups, digest, pair[new], document[new],
                   np.diff(np.append(new, len(pair))))


# ---- runs: columns of numbers as zstd frames of a bounded number of rows


def _packed(columns: list[np.ndarray], frame: int) -> bytes:
    """A run.  Each frame is its length, then differences of the first column and the others, all little-endian."""
    squeeze = zstandard.ZstdCompressor(level=1)
    out = []
    for i in range(0, len(columns[0]), frame):
        part = [c[i:i + frame] for c in columns]
        step = np.diff(part[0], prepend=np.uint64(0)).astype("<u8")
        # equal bytes of neighbours side by side: differences are small
        planes = step.view(np.uint8).reshape(-1, 8).T
        body = squeeze.compress(planes.tobytes() + b"".join(c.astype("<u4").tobytes() for c in part[1:]))
        out.append(np.array([len(part[0]), len(body)], "<u4").tobytes() + body)
    return b"".join(out)


def _frames(run: bytes, columns: int) -> Iterator[list[np.ndarray]]:
    """Blocks of a run, in order."""
    unsqueeze = zstandard.ZstdDecompressor()
    at = 0
    while at < len(run):
        rows, size = np.frombuffer(run, "<u4", 2, at).tolist()
        body = unsqueeze.decompress(run[at + 8:at + 8 + size], max_output_size=rows * (4 + 4 * columns))
        first = np.frombuffer(body, np.uint8, rows * 8).reshape(8, rows).T.copy().view("<u8").ravel()
        rest = [np.frombuffer(body, "<u4", rows, rows * 8 + 4 * rows * k) for k in range(columns - 1)]
        yield [np.cumsum(first, dtype=np.uint64), *rest]
        at += 8 + size


def _wide(counts: np.ndarray) -> list[np.ndarray]:
    """64-bit numbers as two columns of a run."""
    return [counts & np.uint64(0xFFFFFFFF), counts >> np.uint64(32)]


def _sums(pair: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums per pair of sorted pairs."""
    new = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])[:len(pair)])
    return pair[new], (np.add.reduceat(n, new) if len(new) else n[:0])


def merged(runs: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(pairs, sums) of runs of sums, in order: a heap of their next blocks, by last pair.

    Everything up to the smallest last pair is complete and leaves; the block that ends there is
    followed by the next one of its run.
    """
    sources = [_frames(run, 3) for run in runs]
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    heap: list[tuple[int, int]] = []

    def pull(i: int) -> None:
        block = next(sources[i], None)
        if block is not None:
            held[i] = block[0], block[1].astype(np.uint64) | block[2].astype(np.uint64) << np.uint64(32)
            heapq.heappush(heap, (int(block[0][-1]), i))

    for i in range(len(runs)):
        pull(i)
    while heap:
        limit = heap[0][0]
        pairs, counts = [], []
        for i, (pair, n) in list(held.items()):
            upto = int(np.searchsorted(pair, np.uint64(limit), side="right"))
            pairs.append(pair[:upto])
            counts.append(n[:upto])
            held[i] = pair[upto:], n[upto:]
        while heap and heap[0][0] == limit:
            i = heapq.heappop(heap)[1]
            del held[i]
            pull(i)
        pair, n = np.concatenate(pairs), np.concatenate(counts)
        order = np.argsort(pair, kind="stable")
        yield _sums(pair[order], n[order])


def _merged_run(runs: list[bytes], frame: int) -> bytes:
    """One run of the sums of ``runs``."""
    return b"".join(_packed([pair, *_wide(n)], frame) for pair, n in merged(runs))


def _aligned_runs(a: str, b: str, params: SpillParams):
    """Rows of documents (kind 0) and of runs (kind 1) of every stretch of a task's texts."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side_a, side_b = side_of(a), side_of(b)
        task = TaskContext.get().partitionId() << 32
        number = 0
        held: list[tuple[pa.Array, Aligned]] = []
        size = 0

        def flushed():
            run = task + number
            parts = [x for _, x in held]
            counts = [len(x.n_a) for x in parts]
            base = np.concatenate([[0], np.cumsum(counts)])
            n = int(base[-1])
            pair, document, links = (np.concatenate([f(x, k) for k, x in zip(base.tolist(), parts)]) for f in (
                lambda x, k: x.pair, lambda x, k: x.document + k, lambda x, k: x.links))
            nothing = pa.nulls(n, pa.binary())
            yield pa.record_batch({
                "run": pa.array(np.full(n, run)), "place": pa.array(np.arange(n, dtype=np.int32)),
                "doc_id": pa.concat_arrays([x for x, _ in held]),
                **{c: pa.array(np.concatenate([getattr(x, c) for x in parts]), pa.int64()) for c in ("n_a", "n_b", "n_groups")},
                "groups_sha256": pa.array([d for x in parts for d in x.digest], pa.string()),
                "radix": pa.nulls(n, pa.int32()), "sums": nothing, "records": nothing})
            radix = ((pair >> np.uint64(32)) & np.uint64(params.radix - 1)).astype(np.int64)
            order = np.lexsort((document, pair, radix))
            pair, document, links, radix = pair[order], document[order], links[order], radix[order]
            edges = np.searchsorted(radix, np.arange(params.radix + 1))
            some = [r for r in range(params.radix) if edges[r] < edges[r + 1]]
            cut = [slice(edges[r], edges[r + 1]) for r in some]
            sums = [_sums(pair[s], links[s].astype(np.uint64)) for s in cut]
            none = {c: pa.nulls(len(some), pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups")}
            yield pa.record_batch({
                "run": pa.array(np.full(len(some), run)), "place": pa.nulls(len(some), pa.int32()), **none,
                "groups_sha256": pa.nulls(len(some), pa.string()), "radix": pa.array(some, pa.int32()),
                "sums": pa.array([_packed([p, *_wide(c)], params.frame) for p, c in sums], pa.binary()),
                "records": pa.array([_packed([pair[s], document[s], links[s]], params.frame) for s in cut], pa.binary())})

        for batch in batches:
            for block in words.blocks(batch.column("text")):
                here = slice(block.rows.start, block.count)
                texts = pc.fill_null(batch.column("text").slice(here.start, here.stop), "").to_pylist()
                held.append((batch.column("doc_id").slice(here.start, here.stop), align(side_a, side_b, texts)))
                size += len(block.data)
                if size >= params.stretch:
                    yield from flushed()
                    held, size, number = [], 0, number + 1
        if held:
            yield from flushed()

    return read


_SPILLED = ("run long, place int, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, "
            "radix int, sums binary, records binary")


def _merge_level(params: SpillParams):
    """One run of sums for each (radix, lot), whose rows come one after the other."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        now = None

        def done():
            return pa.record_batch({"radix": pa.array([now[0]], pa.int32()), "lot": pa.array([now[1]], pa.int64()),
                                    "sums": pa.array([_merged_run(held, params.frame)], pa.binary())})

        for batch in batches:
            for radix, lot, run in zip(*(batch.column(c).to_pylist() for c in ("radix", "lot", "sums"))):
                if held and (radix, lot) != now:
                    yield done()
                    held = []
                now = (radix, lot)
                held.append(run)
        if held:
            yield done()

    return read


def _contributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(run, place, n_best, count_sum) of the runs of a radix, which come behind its counts."""
    pair = count = best = None
    for batch in batches:
        for run, sums, records in zip(*(batch.column(c).to_pylist() for c in ("run", "sums", "records"))):
            if sums is not None:  # the counts of the next radix; in the order of side B, so an id's pairs stand together
                pair, count = (np.concatenate(x) for x in zip(*merged([sums])))
                b_id = pair >> np.uint64(32)
                first = np.flatnonzero(np.concatenate([[True], b_id[1:] != b_id[:-1]]))
                highest = np.maximum.reduceat(count, first)
                best = count == np.repeat(highest, np.diff(np.append(first, len(b_id))))
                continue
            places, n_best, total = [], [], []
            for mine, place, links in _frames(records, 3):
                at = np.searchsorted(pair, mine)
                places.append(place)
                n_best.append(np.where(best[at], links, 0).astype(np.int64))
                total.append(links.astype(np.int64) * count[at].astype(np.int64))
            place = np.concatenate(places)
            known, at = np.unique(place, return_inverse=True)
            sums_of = np.zeros((2, len(known)), dtype=np.int64)
            np.add.at(sums_of[0], at, np.concatenate(n_best))
            np.add.at(sums_of[1], at, np.concatenate(total))
            yield pa.record_batch({"run": pa.array(np.full(len(known), run)), "place": pa.array(known.astype(np.int32)),
                                   "n_best": pa.array(sums_of[0]), "count_sum": pa.array(sums_of[1])})


def pair_counts(runs: DataFrame, params: SpillParams) -> DataFrame:
    """(radix, sums): one run of all pairs of a radix, by levels of merges of about ``fan_in`` runs."""
    runs_of = runs.groupBy("radix").count().agg(F.max("count")).first()[0] or 0
    lots = max(1, -(-runs_of // params.fan_in))
    level = runs.select("radix", F.pmod(F.xxhash64("run"), F.lit(lots)).alias("lot"), "sums")
    while True:
        to = F.pmod(F.col("radix") * lots + F.col("lot"), F.lit(_MOST_TASKS)).cast("int")
        level = stored_by_batches(
            level.repartitionById(min(params.radix * lots, _MOST_TASKS), to).sortWithinPartitions("radix", "lot")
            .mapInArrow(_merge_level(params), "radix int, lot long, sums binary"), "merged", 8)
        if lots == 1:
            return level.select("radix", "sums")
        lots = -(-lots // params.fan_in)
        level = level.withColumn("lot", F.pmod("lot", F.lit(lots)))


def aligned(docs: DataFrame, a: str, b: str, params: SpillParams = SpillParams()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): tokens, groups and links of the tokenizers ``a`` and ``b``.

    ``n_best`` counts links whose pair is as frequent in the corpus as any of its B id; ``count_sum`` adds
    up the counts of all links.  ``a`` and ``b`` are paths that exist on every executor.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spilled = stored(texts.mapInArrow(_aligned_runs(a, b, params), _SPILLED), "spilled")
    runs = spilled.filter("radix IS NOT NULL")
    with settings(docs.sparkSession, {"spark.sql.parquet.columnarReaderBatchSize": "64"}):  # runs are large values
        counts = pair_counts(runs.select("radix", "run", "sums"), params)
        # runs of a radix are dealt by number; each task gets the counts of the radix once
        salts = max(1, -(-runs.agg(F.countDistinct("run")).first()[0] // (4 * params.fan_in)))
        empty = F.lit(None).cast("binary")
        rows = (counts.select("radix", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"),
                              F.lit(-1).cast("long").alias("run"), "sums", empty.alias("records"))
                .unionByName(runs.select("radix", F.pmod(F.xxhash64("run"), F.lit(salts)).alias("salt"), "run",
                                         empty.alias("sums"), "records")))
        to = F.pmod(F.col("radix") * salts + F.col("salt"), F.lit(_MOST_TASKS)).cast("int")
        dealt = rows.repartitionById(min(params.radix * salts, _MOST_TASKS), to).sortWithinPartitions("radix", "salt", "run")
        parts = stored_by_batches(dealt.select("run", "sums", "records").mapInArrow(
            _contributions, "run long, place int, n_best long, count_sum long"), "contributions", 16)
    own = parts.groupBy("run", "place").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = F.lit(0).cast("long")
    return (spilled.filter("radix IS NULL").drop("radix", "sums", "records").join(own, ["run", "place"], "left")
            .select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"),
                    F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256"))
