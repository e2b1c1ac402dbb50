"""Licence scan: one automaton for notice phrases and identifier tags, a parser for expressions.

Words are maximal runs of ASCII letters and digits and of non-ASCII characters, A-Z folded.  A
single Aho-Corasick automaton over the words of a text, joined by one blank each, finds notice
phrases wherever their words stand on end, whatever stands between them.  It finds identifier tags in
the same way; from where a tag's last word ends in the raw text the expression is read, turned into
postfix order by a shunting yard and evaluated.  It ends where no token follows that fits, at the next
tag, or at the end of the line; inside parentheses lines go on, behind the comment signs that they may
begin with.  Names of known families of licences and LicenseRef names are licences; other words
behind a tag give no label and are counted as unknown.

Cases with a defined result: a null or empty text has no words, no labels and score 0; a tag
without a readable expression adds no label; rows are scanned one by one, so repeated rows get
equal results, and a text of any length is scanned whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The phrases and labels of the contract: fixed values.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Further notices, by the words that only they have.
NOTICE_PHRASES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license": "apache-2",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "redistribution and use in source and binary forms": "bsd",
    "bsd 3 clause": "bsd-3",
    "bsd 2 clause": "bsd-2",
    "isc license": "isc",
    "boost software license": "bsl",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution": "cc-by",
    "cc0": "cc0",
    "dedicated to the public domain": "public-domain",
    "released into the public domain": "public-domain",
    "this is free and unencumbered software": "unlicense",
    "all rights reserved": "all-rights-reserved",
}
TAG = "spdx license identifier"
PERMISSIVE = frozenset({"mit", "apache-2", "apache-2.0", "bsd", "bsd-2", "bsd-2-clause", "bsd-3", "bsd-3-clause", "isc",
                        "bsl", "bsl-1.0", "zlib", "cc0", "cc0-1.0", "cc-by", "cc-by-4.0", "unlicense", "0bsd", "public-domain"})

# What the names of licences begin with, up to the first hyphen.
FAMILIES = frozenset(
    "0bsd aal afl agpl apache apsl artistic beerware blueoak bsd bsl busl bzip2 cal catosl cc cc0 cddl cecill cpl curl ecl epl "
    "eupl fsfap ftl gfdl gpl hpnd icu ijg imagemagick intel ipl isc jasper lgpl libpng lppl mit mpl ms mulanpsl ncsa "
    "nist odbl odc ofl openssl osl pddl php postgresql psf python qpl ruby sgi sissl sleepycat sspl tcl unicode unlicense "
    "upl vim w3c wtfpl x11 xnet zend zlib zpl".split())

_FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")
_BEFORE = re.compile(r"\s*:?\s*", re.ASCII)  # between a tag and its expression
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:\-]+")
_BLANKS = re.compile(r"[ \t]*")
_LINES = re.compile(r"[ \t]*(?:\r?\n[ \t]*(?:[#*/;%!]+|-{2,})?[ \t]*)*")
_RANK = {"or": 1, "and": 2, "with": 3}


def is_licence(name: str) -> bool:
    """Whether a lower-case name is that of a licence."""
    return name.split("-", 1)[0].rstrip("+") in FAMILIES or "licenseref-" in name


class Expression(NamedTuple):
    licences: tuple[str, ...]  # in the order of the text, distinct
    allowed: bool  # some choice of its alternatives uses permitted licences only


def _tokens(text: str, at: int, end: int) -> Iterator[str]:
    """The tokens of ``text`` from ``at`` to ``end``, as far as nothing else stands between them."""
    depth = 0
    while True:
        at = (_LINES if depth > 0 else _BLANKS).match(text, at, end).end()
        found = _TOKEN.match(text, at, end)
        if found is None:
            return
        at = found.end()
        depth += {"(": 1, ")": -1}.get(found[0], 0)
        yield found[0]


def postfix(text: str, at: int = 0, end: int | None = None) -> list[str]:
    """Shunting yard: the longest readable expression at ``at`` in ``text``, in postfix order.

    Raises ValueError if none starts there.
    """
    out: list[str] = []
    stack: list[str] = []
    best: tuple[int, list[str]] | None = None  # tokens of ``out``, and what follows them
    operand_next = True
    for token in _tokens(text, at, len(text) if end is None else end):
        word = token.lower()
        if operand_next and word == "(":
            stack.append(word)
        elif operand_next and word not in _RANK and word != ")":
            out.append(word)
            operand_next = False
        elif not operand_next and word in _RANK:
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[word]:
                out.append(stack.pop())
            stack.append(word)
            operand_next = True
        elif not operand_next and word == ")" and "(" in stack:
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        else:
            break
        if not operand_next and "(" not in stack:
            best = len(out), stack[::-1]
    if best is None:
        raise ValueError("no licence expression")
    return out[:best[0]] + best[1]


def evaluate(text: str, permitted: frozenset[str] = PERMISSIVE, at: int = 0, end: int | None = None) -> Expression:
    """Licences of an and/or/with expression, and whether it can be used under permitted ones.

    ``or`` is a choice, ``and`` needs both; ``with`` adds an exception, which leaves the licence as it is.
    """
    names: list[str] = []
    values: list[tuple[int, bool]] = []  # where its names begin; they go on to those of the next value
    for token in postfix(text, at, end):
        if token not in _RANK:
            values.append((len(names), token.rstrip("+") in permitted))
            names.append(token)
            continue
        (right, right_ok), (left, left_ok) = values.pop(), values.pop()
        if token == "with":
            exception = names[right]
            del names[right:]
            if right - left == 1:
                names[left] += f"-with-{exception}"
            values.append((left, left_ok))
        else:
            values.append((left, (left_ok or right_ok) if token == "or" else (left_ok and right_ok)))
    return Expression(tuple(dict.fromkeys(names)), values[0][1])


class Scanner:
    """The automaton; one per task."""

    def __init__(self, base: dict[str, str] = BASE_PHRASES, notices: dict[str, str] = NOTICE_PHRASES):
        self.automaton = ahocorasick.Automaton()
        kinds: dict[str, list[tuple[str, str]]] = {}
        for kind, phrases in (("base", base), ("notice", notices), ("tag", {TAG: ""})):
            for phrase, label in phrases.items():
                kinds.setdefault(phrase, []).append((kind, label))
        for phrase, entries in kinds.items():
            # blanks around a phrase keep its first and last word whole; bytes stand as characters
            self.automaton.add_word(f" {phrase} ".encode().decode("latin-1"), (len(phrase) + 1, entries))
        self.automaton.make_automaton()

    def scan(self, raw: bytes) -> dict:
        found = raw.translate(_FOLD).split()
        joined = b" " + b" ".join(found) + b" "
        starts: list[int] = []
        base: set[str] = set()
        labels: set[str] = set()
        score = 0.0
        tags: list[int] = []  # index of each tag's first word
        words_before = counted = 0
        for end, (length, entries) in self.automaton.iter(joined.decode("latin-1")):
            for kind, label in entries:
                if kind == "base":
                    starts.append(end - length)
                    base.add(label)
                elif kind == "notice":
                    labels.add(label)
                else:
                    words_before += joined.count(b" ", counted, end - length)
                    counted = end - length
                    tags.append(words_before)
        expressions, unknown = [], 0
        if tags:
            text = raw.decode("latin-1")  # a character for each byte; what is read is ASCII
            spans = [match.span() for match in _WORD.finditer(raw.translate(_FOLD))]
            for number, next_tag in zip(tags, [*tags[1:], None]):
                at = _BEFORE.match(text, spans[number + 2][1]).end()
                end = len(text) if next_tag is None else spans[next_tag][0]
                try:
                    expression = evaluate(text, at=at, end=end)
                except ValueError:
                    continue
                known = [x for x in expression.licences if is_licence(x)]
                unknown += len(expression.licences) - len(known)
                if known:
                    expressions.append(expression)
                    labels.update(known)
        if expressions:
            score = 1.0
        elif base:
            score = 0.9
        elif labels:
            score = 0.7 if labels != {"all-rights-reserved"} else 0.5
        # a start's word index is the number of blanks before it
        at = [joined.count(b" ", 0, s) for s in (min(starts), max(starts))] if starts else [None, None]
        return {"n_words": len(found), "n_base": len(starts), "first_word": at[0], "last_word": at[1],
                "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | labels)), "score": score,
                "n_expressions": len(expressions), "n_unknown": unknown,
                "permitted": all(e.allowed for e in expressions) if expressions else None}


_SCHEMA = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
           "score double, n_expressions long, n_unknown long, permitted boolean")
_ARROW = pa.schema([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
                    ("n_expressions", pa.int64()), ("n_unknown", pa.int64()), ("permitted", pa.bool_())])


def scan(docs: DataFrame, base: dict[str, str] = BASE_PHRASES, notices: dict[str, str] = NOTICE_PHRASES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): words, places of base phrases, labels, score.

    ``n_expressions`` counts readable tag expressions with a known licence, ``n_unknown`` the other
    names behind tags; ``permitted`` says whether all of them can be
    met by permissive licences (null without any).  Narrow: no shuffle.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, notices)
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            rows = [scanner.scan(t.as_buffer().to_pybytes()) for t in texts]
            out = pa.RecordBatch.from_pylist(rows, _ARROW)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *out.columns],
                                             names=["doc_id", *out.schema.names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        read, f"doc_id long, {_SCHEMA}")
