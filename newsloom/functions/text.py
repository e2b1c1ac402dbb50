"""Text preparation as column expressions; all of it stays in the JVM.

Order inside :func:`clean_text` matters and is part of the definition: text that
is glued to ``http`` or ``www`` goes with the address, a tag that is broken over
two lines survives, punctuation disappears without leaving a blank.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .wordlists import ENGLISH_STOP_WORDS, FUSED_WORDS, QUOTE_MARKS, SEARCH_STOP_WORDS

# (?U) gives Unicode classes; the four separators U+001C..U+001F count as white
# space too, which the Unicode property leaves out.
_BLANK = r"[\s\x1c-\x1f]"
_INK = r"[^\s\x1c-\x1f]"

_CLEANING_STEPS = (
    (rf"(?U)http{_INK}+|www{_INK}+|https{_INK}+", ""),   # addresses
    (r"<[^\n]*?>", ""),                                  # tags, one line only
    # e-mail; a match always reaches back to the start of its run of characters, and
    # trying only there keeps long runs linear
    (rf"(?U)(?<!{_INK}){_INK}+@{_INK}+", ""),
    (r"[!-/:-@\[-`{-~]", ""),                            # the 32 ASCII marks
    (rf"(?U){_BLANK}+", " "),                            # white space
)


def _as_col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def combine(title, text, trim: bool = False) -> Column:
    """``title`` + blank + ``text``; nulls count as empty."""
    joined = F.concat(F.coalesce(_as_col(title), F.lit("")), F.lit(" "),
                      F.coalesce(_as_col(text), F.lit("")))
    if not trim:
        return joined
    return F.regexp_replace(joined, rf"(?U)^{_BLANK}+|{_BLANK}+$", "")


def clean_text(text) -> Column:
    """Lower case without addresses, tags, e-mail, punctuation, extra blanks."""
    out = F.lower(F.coalesce(_as_col(text), F.lit("")))
    for pattern, replacement in _CLEANING_STEPS:
        out = F.regexp_replace(out, pattern, replacement)
    return F.trim(out)


def word_tokens(clean) -> Column:
    """Tokens of an already cleaned text.

    Without ASCII punctuation what is left to do is to split on blanks, to cut
    the fused words in two and to set quotation marks apart.
    """
    fused = "|".join(rf"{head}(?={tail}\b)" for head, tail in FUSED_WORDS)
    out = F.regexp_replace(_as_col(clean), rf"(?U)\b({fused})", "$1 ")
    out = F.regexp_replace(out, f"([{QUOTE_MARKS}])", " $1 ")
    return F.filter(F.split(out, " "), lambda t: t != "")


def keep_content_words(tokens, stop_words=ENGLISH_STOP_WORDS, min_length: int = 3) -> Column:
    """Drop stop words and short tokens; both are tested before stemming."""
    stop = list(stop_words)
    return F.filter(_as_col(tokens),
                    lambda t: (F.length(t) >= min_length) & ~t.isin(stop))


def search_tokens(text: str) -> Column:
    """Tokens of the search analyser: words, dots allowed inside, lower case.

    Positions are counted after the stop words are gone, so "state of art" holds
    the phrase "state art".
    """
    stop = ", ".join(f"'{w}'" for w in SEARCH_STOP_WORDS)
    return F.expr(rf"""filter(
        regexp_extract_all(lower(coalesce({text}, '')), r'(?U)\w++(?:\.\w++)*+', 0),
        t -> length(t) >= 2 AND t NOT IN ({stop}))""")


def preview(text, size: int, always_dots: bool = False) -> Column:
    """First ``size`` characters, with dots when something was cut."""
    text = _as_col(text)
    head = F.concat(F.substring(text, 1, size), F.lit("..."))
    return head if always_dots else F.when(F.length(text) > size, head).otherwise(text)


def join_tags(tags) -> Column:
    return F.array_join(F.coalesce(_as_col(tags), F.array().cast("array<string>")), ",")


def split_tags(joined) -> Column:
    """Comma separated text to tags: trimmed, blanks dropped."""
    parts = F.transform(F.split(F.coalesce(_as_col(joined), F.lit("")), ","), lambda t: F.trim(t))
    return F.filter(parts, lambda t: t != "")


def keyword_terms(value, mode: str = "value") -> Column:
    """Index terms of a keyword field.

    ``token`` splits on white space, so a value of several words can only be hit
    word by word; ``value`` keeps the whole lower-cased value as one term.
    """
    low = F.lower(F.coalesce(_as_col(value), F.lit("")))
    if mode == "token":
        return F.filter(F.split(low, r"(?U)\s+"), lambda t: t != "")
    if mode == "value":
        return F.filter(F.array(low), lambda t: t != "")
    raise ValueError(f"unknown keyword mode {mode!r}")


def like_contains(value, needle: str, escape: bool = False) -> Column:
    """Case-insensitive "contains".  ``%`` and ``_`` act as wildcards unless escaped."""
    if escape:
        for mark in ("\\", "%", "_"):
            needle = needle.replace(mark, "\\" + mark)
    return _as_col(value).ilike(f"%{needle}%")
