"""3-grams of texts and terms: which short pieces a string holds, and which ones a pattern needs.

A string that matches a pattern holds every 3-gram of the literal pieces of the pattern.  So the lists of
these grams, intersected, hold all matches; what they hold besides is found out by the pattern itself.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAM = 3
# ends of a term; characters that no term has
FIRST, LAST = "\u0002", "\u0003"


def text_grams(text) -> Column:
    """Distinct 3-grams of a text in lower case."""
    every = F.regexp_extract_all(F.lower(text), F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1))
    return F.array_distinct(F.coalesce(every, F.array().cast("array<string>")))


def term_grams(term: str) -> Column:
    """Distinct 3-grams of a term with its ends marked."""
    return text_grams(F.concat(F.lit(FIRST), F.col(term), F.lit(LAST)))


def gram_bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(gram.cast("binary")), F.lit(buckets)).cast("int")


def piece_grams(pieces: list[str]) -> list[str]:
    """Distinct 3-grams of literal pieces, in order."""
    found = [p[i:i + GRAM] for p in pieces for i in range(len(p) - GRAM + 1)]
    return list(dict.fromkeys(found))


def like_pieces(pattern: str) -> list[str]:
    """Literal pieces of a LIKE pattern, whose backslash takes the meaning off a mark."""
    pieces, at = [""], 0
    while at < len(pattern):
        letter = pattern[at]
        if letter in "%_":
            pieces.append("")
        else:
            if letter == "\\" and at + 1 < len(pattern):
                at += 1
                letter = pattern[at]
            pieces[-1] += letter
        at += 1
    return [p for p in pieces if p]


def wildcard_pieces(pattern: str) -> list[str]:
    """Literal pieces of a pattern of whole terms with * and ?, with marks where it begins or ends literally."""
    out = FIRST + pattern + LAST
    for mark in "*?":
        out = out.replace(mark, "\0")
    return [p for p in out.split("\0") if p]


def literal_prefix(pattern: str) -> str:
    """What a pattern with * and ? begins with."""
    return pattern[:min((pattern.index(mark) for mark in "*?" if mark in pattern), default=len(pattern))]


def after_prefix(prefix: str) -> str | None:
    """The smallest string above all that begin with ``prefix``, in code-point order; None if there is none."""
    while prefix:
        last = ord(prefix[-1]) + 1
        if last <= 0x10FFFF:
            return prefix[:-1] + chr(0xE000 if last == 0xD800 else last)
        prefix = prefix[:-1]
    return None
