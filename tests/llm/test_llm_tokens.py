import random
import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_tools import ODD_TEXTS, docs

from newsloom.llm import token_counts, words

VOCABULARY = [p.encode() for p in ("▁", "▁a", "▁ab", "abc", "b", "bc", "bcd", "cdefg", "é", "▁é", "da", "abcdx", "日本")]


def greedy(word, pieces):
    text, count, at = "▁".encode() + word, 0, 0
    while at < len(text):
        at += max(n for n in range(1, min(12, len(text) - at) + 1) if n == 1 or text[at:at + n] in pieces)
        count += 1
    return count


def plain(text, pieces=frozenset(VOCABULARY)):
    found = [w for w in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode()) if w]
    return len(found), sum(greedy(w, pieces) for w in found)


def counted(texts, vocabulary=VOCABULARY):
    automaton = token_counts.build(vocabulary)
    out = []
    for block in words.blocks(pa.array(texts, pa.string()), 64):
        n_words, n_tokens = token_counts.count_block(block, automaton)
        out += list(zip(n_words.tolist(), n_tokens.tolist()))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abcdefgxé日本▁ \n", max_size=40), min_size=1, max_size=6))
def test_counts_equal_greedy_matching(texts):
    assert counted(texts) == [plain(t) for t in texts]


def test_random_vocabularies():
    rng = random.Random(6)
    for _ in range(20):
        pieces = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 7))).encode() for _ in range(12)]
        texts = ["".join(rng.choice("ab ") for _ in range(50)) for _ in range(10)]
        assert counted(texts, pieces) == [plain(t, frozenset(pieces)) for t in texts]


def test_long_pieces():
    for size in (255, 256, 257, 300, 5000):
        pieces = [b"a" * size, b"ab", b"c" * (size - 1) + b"d"]
        texts = ["a" * (size - 1) + "b", "a" * (2 * size - 1), "c" * (size - 1), "c" * (size - 1) + "da", "c" * 3 * size]
        automaton = token_counts.build(pieces)
        for text in texts:
            at, want, word = 0, 0, "▁".encode() + text.encode()
            while at < len(word):
                at += max([len(p) for p in pieces if word.startswith(p, at)], default=1)
                want += 1
            assert automaton.count(text.encode()) == want
            block = next(words.blocks(pa.array([text])))
            assert token_counts.count_block(block, automaton)[1].tolist() == [want]


def test_rows(spark):
    rows = list(enumerate(ODD_TEXTS)) + [(None, "abc abc"), (3, "abc")]
    got = token_counts.token_counts(docs(spark, rows), VOCABULARY).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_tokens) for r in got) == sorted((str(i), *plain(t)) for i, t in rows)
    assert token_counts.token_counts(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY).count() == 0
