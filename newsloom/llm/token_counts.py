"""Counts of greedy word pieces by a linear longest-match automaton.

The trie of the vocabulary has a failure link per node: where the text leaves the trie, the longest
pieces of what has been read are popped, and matching goes on at the node of the rest.  How many
pieces are popped is known beforehand, so counting needs one step per byte and builds no piece.
Links are folded into a complete table of transitions, and all words of a block take their steps
together.

Cases with a defined result: a null or empty text has no words and no tokens; bytes that no piece has
are pieces of their own; words of any length are counted whole; rows are counted one by one, so
repeated rows get equal counts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words

WORD_START = "▁"
_LONG_WORD = 2_000  # bytes; longer words are walked one by one, not in step with others


class Automaton(NamedTuple):
    steps: np.ndarray  # [state, byte class]: the next state, above ``shift`` bits of popped pieces
    shift: int
    ends: np.ndarray  # pieces popped at the end of a word
    classes: np.ndarray  # of each byte
    start: int  # state after the mark of a word's start
    start_pops: int

    def count(self, data: bytes) -> int:
        """Pieces of one word."""
        state, total = self.start, self.start_pops
        steps, classes, shift = self.steps, self.classes, self.shift
        popped = (1 << shift) - 1
        for byte in data:
            step = int(steps[state, classes[byte]])
            state, total = step >> shift, total + (step & popped)
        return total + int(self.ends[state])


def build(pieces: list[bytes], mark: str = WORD_START) -> Automaton:
    """Automaton of a vocabulary; all single bytes are added to it."""
    vocabulary = {p for p in pieces if p} | {bytes([b]) for b in range(256)}
    children: list[dict[int, int]] = [{}]
    final = [False]
    for piece in sorted(vocabulary):
        node = 0
        for byte in piece:
            if byte not in children[node]:
                children[node][byte] = len(children)
                children.append({})
                final.append(False)
            node = children[node][byte]
        final[node] = True
    # bytes that only stand alone act alike but for their own node, which fails to the root
    inner = sorted({b for node in children[1:] for b in node} | {p[0] for p in vocabulary if len(p) > 1})
    classes = np.full(256, len(inner), dtype=np.int64)
    classes[inner] = np.arange(len(inner))
    width = len(inner) + 1
    lonely = [b for b in range(256) if classes[b] == len(inner)]
    for byte in lonely[1:]:
        del children[0][byte]
    fail, pops = np.zeros(len(children), np.int64), np.zeros(len(children), np.int64)
    # a state never pops more pieces than it has bytes
    shift = max(map(len, vocabulary)).bit_length()
    popped = (1 << shift) - 1
    kind = np.uint32 if len(children).bit_length() + shift <= 32 else np.uint64
    steps = np.zeros((len(children), width), dtype=kind)
    ends = np.zeros(len(children), dtype=np.int64)
    level = [0]
    for byte, child in children[0].items():
        steps[0, classes[byte]] = child << shift
    while level:
        following = []
        for node in level:
            for byte, child in children[node].items():
                if final[child]:
                    fail[child], pops[child] = 0, 1
                else:  # what the parent pops, then on from where it fails to
                    step = int(steps[fail[node], classes[byte]])
                    fail[child], pops[child] = step >> shift, pops[node] + (step & popped)
                following.append(child)
        for child in following:
            steps[child] = steps[fail[child]] + kind(pops[child])
            for byte, grandchild in children[child].items():
                steps[child, classes[byte]] = grandchild << shift
            ends[child] = pops[child] + ends[fail[child]]
        level = following
    state, total = 0, 0
    for byte in mark.encode():
        step = int(steps[state, classes[byte]])
        state, total = step >> shift, total + (step & popped)
    return Automaton(steps, shift, ends, classes, state, total)


def vocabulary_of(path: str) -> list[bytes]:
    """Pieces of a sentencepiece model (.model), or of a tokenizer file (.json) as they are written there."""
    if path.endswith(".model"):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return [model.id_to_piece(i).encode() for i in range(model.vocab_size())
                if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i))]
    with open(path, encoding="utf-8") as file:
        return [piece.encode() for piece in json.load(file)["model"]["vocab"]]


_BUILT: dict[tuple, Automaton] = {}  # of this worker, the last one


def count_block(block: words.Block, automaton: Automaton) -> tuple[np.ndarray, np.ndarray]:
    """Words and tokens of each document of a block."""
    found = words.words(block, words.WHITE_SPACE)
    length = found.ends - found.starts
    totals = np.full(len(length), automaton.start_pops, dtype=np.int64)
    order = np.argsort(-np.minimum(length, _LONG_WORD + 1), kind="stable")
    long = int((length > _LONG_WORD).sum())
    for i in order[:long]:
        totals[i] = automaton.count(block.data[found.starts[i]:found.ends[i]].tobytes())
    order = order[long:]
    sorted_length, start = length[order], found.starts[order]
    state = np.full(len(order), automaton.start, dtype=np.int64)
    total = totals[order]
    flat, width = automaton.steps.reshape(-1), automaton.steps.shape[1]
    shift, popped = flat.dtype.type(automaton.shift), flat.dtype.type((1 << automaton.shift) - 1)
    classes = automaton.classes[block.data]
    live = len(order)
    for position in range(int(sorted_length[0]) if len(order) else 0):
        live = int(np.searchsorted(-sorted_length[:live], -position, side="left"))
        step = flat[state[:live] * width + classes[start[:live] + position]]
        state[:live] = step >> shift
        total[:live] += (step & popped).astype(np.int64)
    totals[order] = total + automaton.ends[state]
    sums = np.concatenate([[0], np.cumsum(totals)])
    return found.counts, sums[found.first[1:]] - sums[found.first[:-1]]


def token_counts(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """(doc_id, n_words, n_tokens) of each row of ``docs`` (doc_id, text); narrow.

    ``vocabulary`` is sent to the tasks (its size doesn't grow with the data); each worker builds
    the automaton once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (len(shared.value), hash(tuple(shared.value)))
        if key not in _BUILT:
            _BUILT.clear()
            _BUILT[key] = build(shared.value)
        automaton = _BUILT[key]
        for batch in batches:
            for block in words.blocks(batch.column("text")):
                n_words, n_tokens = count_block(block, automaton)
                yield pa.record_batch({
                    "doc_id": batch.column("doc_id").slice(block.rows.start, block.count),
                    "n_words": pa.array(n_words, pa.int64()), "n_tokens": pa.array(n_tokens, pa.int64())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        read, "doc_id long, n_words long, n_tokens long")
