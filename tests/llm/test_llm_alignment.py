import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_tools import ODD_TEXTS, documents, docs

from newsloom.llm import alignment as al
from newsloom.llm.queries import BYTE_PAIRS, PIECES

pytestmark = pytest.mark.skipif(not os.path.exists(PIECES), reason="no tokenizer files")


def plain(rows):
    """Every text by itself, with loops over tokens."""
    import sentencepiece
    from tokenizers import Tokenizer, decoders
    byte_pairs = Tokenizer.from_file(BYTE_PAIRS)
    byte_pairs.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    letters = {v: k for k, v in al._byte_letters().items()}
    assert decoders.ByteLevel().decode([letters[0x20] + letters[0xC3] + letters[0xA9]]) == " é"

    def parts(text):
        a = byte_pairs.encode(" " + text, add_special_tokens=False)
        back = {v: k for k, v in letters.items()}
        yield [(i, bytes(back[c] for c in t)) for i, t in zip(a.ids, a.tokens)]
        yield [(i, bytes([int(p[3:5], 16)]) if p.startswith("<0x") and p.endswith(">") and len(p) == 6 else p.replace("▁", " ").encode())
               for i, p in ((i, pieces.id_to_piece(i)) for i in pieces.encode(text))]

    links, out = [], []
    for doc_id, text in rows:
        sides = list(parts(text)) if text else [[], []]
        if any(b"".join(b for _, b in s) != b" " + (text or "").encode() for s in sides):
            links.append([])
            out.append((doc_id, 0, 0, 0, 0, ""))
            continue
        ends = []
        for s in sides:
            at, mine = 0, {}
            for i, b in s:
                at += len(b)
                mine[at] = i
            ends.append(mine)
        both = sorted(set(ends[0]) & set(ends[1]))
        links.append([(ends[0][e], ends[1][e]) for e in both])
        groups, low = [], 0
        for e in both:
            groups.append("|".join(",".join(str(i) for x, i in mine.items() if low < x <= e) for mine in ends))
            low = e
        out.append((doc_id, len(sides[0]), len(sides[1]), len(both), len(both), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    count = Counter(p for found in links for p in found)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    return sorted([str(x) for x in (*row[:5], sum(count[p] == best[p[1]] for p in found), sum(count[p] for p in found), row[5])]
                  for row, found in zip(out, links))


TEXTS = [*ODD_TEXTS, "Hello, world! It's <|endoftext|> and </s> <s> <unk> <0x41>.", "▁ in a text", "tabs\tand\r\nlines\n\n  and   blanks ",
         " leading", "trailing ", "emoji 🎉👩‍👩‍👧 ​﻿", " 　", "naïve café — “quotes”", "à é", "x\x00y", "١٢٣ ½ ²",
         "the the the the of of", "hello world hello world", "日本語のテキスト。", "1234567890 " * 20, "∑∫√ \U0001F600", "�"]


def rows_of(rng, n=60):
    base = ["the", "of", "world", "Hello", "été", "日本", "running", "unbelievable", ",", "  ", "\n", "42", "zqx"]
    return [(i - 5, " ".join(rng.choice(base) for _ in range(rng.randrange(0, 60)))) for i in range(n)]


@pytest.mark.parametrize("given", [{}, {"radix": 4, "stretch": 200, "fan_in": 2, "frame": 3}, {"radix": 1, "stretch": 1, "fan_in": 3, "frame": 1}])
def test_equals_loops(spark, given):
    rows = [(100 + i, t) for i, t in enumerate(TEXTS)] + rows_of(random.Random(2)) + [(None, "of the world"), (3, "of"), (3, "of")]
    got = al.aligned(docs(spark, rows), BYTE_PAIRS, PIECES, al.SpillParams(**given)).collect()
    assert sorted([str(x) for x in r] for r in got) == plain(rows)


def test_columns_and_nothing(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    got = al.aligned(documents(spark, rows, extra=True), BYTE_PAIRS, PIECES)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted([str(x) for x in r] for r in got.collect()) == plain(rows)
    for rows in ([], [(1, None), (2, "")]):
        got = al.aligned(docs(spark, rows), BYTE_PAIRS, PIECES).collect()
        assert sorted(tuple(r) for r in got) == [(i, 0, 0, 0, 0, 0, 0, "") for i, _ in rows]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 40) | st.integers(2**40, 2**40 + 9), st.integers(1, 2**40), max_size=30), max_size=7),
       st.integers(1, 9))
def test_merges_are_sums(runs, frame):
    total = Counter()
    packed = []
    for run in runs:
        total.update(run)
        pair = np.array(sorted(run), dtype=np.uint64)
        packed.append(al._packed([pair, *al._wide(np.array([run[int(p)] for p in pair], dtype=np.uint64))], frame))
    blocks = list(al.merged([p for p in packed if p]))
    got = [(int(p), int(n)) for pair, n in blocks for p, n in zip(pair, n)]
    assert got == sorted(total.items())


def test_ranks_are_the_tokenizer():
    from tokenizers import Tokenizer
    made = Tokenizer.from_file(BYTE_PAIRS)
    quick = al._ranked(made, BYTE_PAIRS, al._byte_letters())
    rng = random.Random(4)
    letters = [chr(c) for c in range(0x240)]
    texts = [pattern.replace("x", c) for c in letters for pattern in ("x", " x", "x ", "axa", "1x1", ".x.", " xx", "x'sx", "\nx\n ", "é x x")]
    texts += ["".join(rng.choice(letters if rng.random() < 0.5 else "abcdeths  '.1") for _ in range(200)) for _ in range(400)]
    texts += ["".join(rng.choice("aeionst ") for _ in range(300)) for _ in range(400)] + ["a" * 3000, " " * 300, "ab" * 900]
    same = [e.ids for e in made.encode_batch_fast(texts, add_special_tokens=False)]
    assert [quick.encode_to_numpy(t, disallowed_special=()).tolist() for t in texts] == same
    word = "/opt/tokenizers/word_bpe_49k.json"  # not byte pairs of this kind
    assert al._ranked(Tokenizer.from_file(word), word, al._byte_letters()) is None


def test_frames_are_bounded_zstd():
    pair = np.arange(10, dtype=np.uint64) << np.uint64(30)
    run = al._packed([pair, np.arange(10), np.arange(10) * 2], 4)
    assert [len(x[0]) for x in al._frames(run, 3)] == [4, 4, 2]
    assert zstandard.frame_content_size(run[8:]) == 4 * 16
    assert (np.concatenate([x[0] for x in al._frames(run, 3)]) == pair).all()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\téß日🎉'.,1▁", max_size=30), min_size=1, max_size=5))
def test_tokens_spell_their_texts(texts):
    found = al.align(al.side_of(BYTE_PAIRS), al.side_of(PIECES), texts)
    for text, a, b, groups, digest in zip(texts, found.n_a, found.n_b, found.n_groups, found.digest):
        fine = bool(text) and "▁" not in text
        assert (a > 0) == (b > 0) == (groups > 0) == bool(digest) == fine
