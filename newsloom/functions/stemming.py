"""Porter stemming (M. F. Porter, 1980) for Spark columns.

The one step of text preparation that SQL functions cannot express well.  It
runs as an Arrow function over whole batches.  Every Python worker remembers the
stems it has seen, so the cost is one stemming per distinct word and worker and a
dictionary look-up per token; no token is shuffled for it.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .slices import by_bytes

# Suffix rules of steps 2, 3 and 4 of the published algorithm, with
# its author's later changes (bli, logi).
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize",
    "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive",
    "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
    "logi": "log"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic",
         "ful": "", "ness": ""}
STEP4 = dict.fromkeys(
    "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split(), "")

# letters that a word must end with if any step is to change it
_ENDS = frozenset("sdgye" + "l" + "".join(suffix[-1] for suffix in (*STEP2, *STEP3, *STEP4)))

# Irregular forms of the extended variant.
IRREGULAR = {
    "skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "news": "news", "innings": "inning", "inning": "inning", "outings": "outing",
    "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe",
    "proceed": "proceed", "exceed": "exceed", "succeed": "succeed"}

_MEMO_LIMIT = 200_000


def _shape(word: str) -> str:
    """``word`` with every letter replaced by c (consonant) or v (vowel)."""
    out = ""
    for letter in word:
        vowel = letter in "aeiou" or (letter == "y" and out[-1:] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _has_vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _double_consonant(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short_end(word: str, extended: bool) -> bool:
    shape = _shape(word)
    if shape[-3:] == "cvc":
        return word[-1] not in "wxy"
    return extended and shape == "vc"


def _longest_rule(word: str, rules: dict):
    for size in range(min(7, len(word)), 1, -1):
        if word[-size:] in rules:
            return word[-size:]
    return None


def _plural(word: str, extended: bool) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith("ies"):
        return word[:-1] if extended and len(word) == 4 else word[:-2]
    if word.endswith("s") and not word.endswith("ss"):
        return word[:-1]
    return word


def _past(word: str, extended: bool) -> str:
    if extended and word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    suffix = next((s for s in ("ed", "ing") if word.endswith(s)), None)
    if suffix is None or not _has_vowel(word[:-len(suffix)]):
        return word
    stem = word[:-len(suffix)]
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if _double_consonant(stem):
        return stem if stem[-1] in "lsz" else stem[:-1]
    if _measure(stem) == 1 and _short_end(stem, extended):
        return stem + "e"
    return stem


def _final_y(word: str, extended: bool) -> str:
    if not word.endswith("y"):
        return word
    stem = word[:-1]
    turn = (len(stem) > 1 and _shape(stem)[-1] == "c") if extended else _has_vowel(stem)
    return stem + "i" if turn else word


def _step2(word: str, extended: bool) -> str:
    rules = {**STEP2, "fulli": "ful"} if extended else STEP2
    if extended and word.endswith("alli") and _measure(word[:-4]) > 0:
        return _step2(word[:-2], extended)
    suffix = _longest_rule(word, rules)
    if suffix is None:
        return word
    stem = word[:-len(suffix)]
    tested = word[:-3] if extended and suffix == "logi" else stem
    return stem + rules[suffix] if _measure(tested) > 0 else word


def _step3(word: str) -> str:
    suffix = _longest_rule(word, STEP3)
    if suffix is None or _measure(word[:-len(suffix)]) == 0:
        return word
    return word[:-len(suffix)] + STEP3[suffix]


def _step4(word: str) -> str:
    suffix = _longest_rule(word, STEP4)
    if suffix is None:
        return word
    stem = word[:-len(suffix)]
    if _measure(stem) <= 1 or (suffix == "ion" and stem[-1] not in "st"):
        return word
    return stem


def _tidy(word: str, extended: bool) -> str:
    if word.endswith("e"):
        stem = word[:-1]
        m = _measure(stem)
        if m > 1 or (m == 1 and not _short_end(stem, extended)):
            word = stem
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def porter_stem(word: str, extended: bool = True) -> str:
    """Stem of one lower-case word.

    ``extended`` adds the irregular forms and the small changes of the variant
    the classifier was defined with; without it the result is the published one,
    which search uses.
    """
    if extended and word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) < 3 or word[-1] not in _ENDS:
        return word
    word = _final_y(_past(_plural(word, extended), extended), extended)
    return _tidy(_step4(_step3(_step2(word, extended))), extended)


class _Memo(dict):
    """Word to stem, filled on demand and emptied when it grows too large."""

    def __init__(self, extended: bool):
        super().__init__()
        self.extended = extended

    def __missing__(self, word):
        if len(self) >= _MEMO_LIMIT:
            self.clear()
        self[word] = out = porter_stem(word, self.extended)
        return out

    def __reduce__(self):
        return (_Memo, (self.extended,))


def word_memo(extended: bool) -> dict[str, str]:
    """Stems of single words, remembered up to a limit."""
    return _Memo(extended)


def _line_stemmer(extended: bool):
    memo = _Memo(extended)

    @F.arrow_udf("string")
    def stem_line(lines: pa.Array) -> pa.Array:
        look_up = memo.__getitem__
        # words repeat: each distinct word of a text is looked up once
        def stemmed(line):
            if not line:
                return line
            words = line.split(" ")
            own = {w: look_up(w) for w in set(words)}
            return " ".join([own[w] for w in words])

        # only a few texts at a time are Python objects
        return pa.chunked_array([pa.array([stemmed(x) for x in part.to_pylist()], pa.string()) for part in by_bytes(lines)],
                                pa.string()).combine_chunks()

    return stem_line


def stem_words(joined, extended: bool = True, once: bool = False) -> Column:
    """Stem every word of a blank-joined text.

    A worker remembers the stems of at most 200,000 words and then starts anew; results do
    not depend on it.  With ``once`` Spark may not move a filter on the result below the projection that
    makes it: there the column would be made a second time, in workers of its own and of rows that a join drops.
    """
    stemmer = _line_stemmer(extended)
    return (stemmer.asNondeterministic() if once else stemmer)(F.col(joined) if isinstance(joined, str) else joined)
