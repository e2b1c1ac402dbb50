"""Common parts of the oracle SQL: the views of ``sources.driver_views`` and tokens."""

from __future__ import annotations

from ..functions.stemming import IRREGULAR, STEP2, STEP3, STEP4
from ..functions.wordlists import ENGLISH_STOP_WORDS, SEARCH_STOP_WORDS

RAW = """raw AS (
  SELECT md5(concat(split_part(text, chr(10), 1), 'https://example.org/', md5(text))) AS article_id,
         doc_id, split_part(text, chr(10), 1) AS title, substr(text, 1, 300) AS summary,
         text AS content, concat('https://example.org/', md5(text)) AS link,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS published,
         source, lang AS category, source AS feed_key,
         concat('Writer ', CAST(length(text) % 97 AS VARCHAR)) AS author, [lang, source] AS tags,
         TIMESTAMP '2024-06-01 00:00:00' + to_seconds(doc_id * 7919 % 86400) AS created_at
  FROM documents)"""

ART = RAW + """, art AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY published, link, doc_id) AS rn FROM raw)
  WHERE rn = 1)"""

FEEDS = """feeds AS (
  SELECT source AS key, concat('Feed ', source) AS name,
         concat('https://', source, '.example.org/rss') AS url, min(lang) AS category,
         CAST(substr(source, 4) AS INT) % 5 <> 0 AS active
  FROM documents GROUP BY source)"""

LOGS = """logs AS (
  SELECT event_id AS log_id, concat('src', CAST(user_id % 20 AS VARCHAR)) AS feed_key, ts AS started_at,
         CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status,
         CAST(floor(value) AS INT) AS articles_found, CAST(floor(value / 2) AS INT) AS articles_new,
         CASE WHEN event_type = 'error' THEN concat('code ', CAST(event_id % 7 AS VARCHAR)) END AS error_message
  FROM events)"""

LABELLED = """labelled AS (
  SELECT d.doc_id, split_part(text, chr(10), 1) AS title, text, quality AS label
  FROM documents d JOIN labels l USING (doc_id))"""

PREDICTIONS = """pred AS (
  SELECT doc_id, quality AS label,
         CASE WHEN doc_id % 7 = 0 THEN 1 - quality ELSE quality END AS prediction,
         CAST(0.5 AS DOUBLE) + CAST(doc_id * 37 % 50 AS DOUBLE) / 100 AS confidence
  FROM labels)"""


def _quoted(words):
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def clean(text: str) -> str:
    out = f"lower(coalesce({text}, ''))"
    for pattern, to in (("http\\S+|www\\S+|https\\S+", ""), ("<[^\\n]*?>", ""), ("\\S+@\\S+", ""),
                        ("[!-/:-@\\[-`{-~]", ""), ("\\s+", " ")):
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    return f"trim({out})"


def content_word_list(text: str) -> str:
    """List of tokens of a raw text without stop words and short tokens."""
    out = clean(text)
    for a, b in (("can", "not"), ("gim", "me"), ("gon", "na"), ("got", "ta"), ("lem", "me"), ("wan", "na")):
        out = f"regexp_replace({out}, '\\b({a})({b})\\b', '\\1 \\2', 'g')"
    out = f"regexp_replace({out}, '([«“‘„»”’])', ' \\1 ', 'g')"
    return (f"list_filter(string_split({out}, ' '), "
            f"lambda t: length(t) > 2 AND t NOT IN ({_quoted(ENGLISH_STOP_WORDS)}))")


def search_word_list(text: str) -> str:
    return ("list_filter(regexp_extract_all(lower(coalesce(" + text + ", '')), "
            "'[\\p{L}\\p{M}\\p{N}_]+(?:\\.[\\p{L}\\p{M}\\p{N}_]+)*'), "
            f"lambda t: length(t) >= 2 AND t NOT IN ({_quoted(SEARCH_STOP_WORDS)}))")


# tokens of the three default fields, with positions after the stop words are gone
TOKENS = ART + f""", lists AS (
  SELECT article_id, published, category, source, 'title' AS field, {search_word_list('title')} AS toks FROM art
  UNION ALL
  SELECT article_id, published, category, source, 'summary', {search_word_list('summary')} FROM art
  UNION ALL
  SELECT article_id, published, category, source, 'content', {search_word_list('content')} FROM art),
e AS (
  SELECT article_id, published, category, source, field, unnest(toks) AS term,
         unnest(range(len(toks))) AS pos, len(toks) AS field_length FROM lists),
tf AS (
  SELECT field, article_id, term, any_value(published) AS published, any_value(category) AS category,
         any_value(source) AS source, any_value(field_length) AS field_length, count(*) AS tf
  FROM e GROUP BY field, article_id, term),
st AS (
  SELECT field, CAST(count(*) AS DOUBLE) AS n, sum(len(toks)) / CAST(count(*) AS DOUBLE) AS mean_length
  FROM lists GROUP BY field),
df AS (SELECT field, term, count(*) AS df FROM tf GROUP BY field, term),
w AS (
  SELECT tf.*, (ln(n / (df + 1.0)) + 1) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * field_length / mean_length)) AS weight
  FROM tf JOIN df USING (field, term) JOIN st USING (field))"""


def _shape(word: str) -> str:
    """A word with C for consonants and V for vowels; y is a vowel behind a consonant."""
    out = f"regexp_replace(regexp_replace({word}, '[aeiou]', 'V', 'g'), '[^Vy]', 'C', 'g')"
    for _ in range(4):  # a pass settles the first y of every run of them, and the one behind it
        out = f"replace(replace(regexp_replace({out}, '^y', 'C'), 'Cy', 'CV'), 'Vy', 'VC')"
    return out


def _measure(word: str) -> str:
    return f"(len(string_split({_shape(word)}, 'VC')) - 1)"


def _short_end(word: str, extended: bool) -> str:
    shape = _shape(word)
    return (f"(CASE WHEN ends_with({shape}, 'CVC') THEN right({word}, 1) NOT IN ('w', 'x', 'y') "
            f"ELSE {f'{shape} = {chr(39)}VC{chr(39)}' if extended else 'FALSE'} END)")


def _cut(word: str, n: int) -> str:
    return f"left({word}, length({word}) - {n})"


def _suffix_step(source: str, target: str, rules: dict, condition: str, tested: str = "stem") -> str:
    """A step that replaces the longest suffix of the rules where the condition holds."""
    ordered = sorted(rules, key=lambda r: (-len(r), r))
    suffix = " ".join(f"WHEN ends_with(w, '{r}') THEN '{r}'" for r in ordered)
    put = " ".join(f"WHEN '{r}' THEN '{rules[r]}'" for r in ordered)
    return f"""{target}a AS (SELECT word, w, CASE {suffix} END AS suf FROM {source}),
{target}b AS (SELECT *, left(w, length(w) - length(suf)) AS stem FROM {target}a),
{target} AS (SELECT word, CASE WHEN suf IS NULL THEN w WHEN {condition.format(m=_measure(tested))} THEN concat(stem, CASE suf {put} END)
  ELSE w END AS w FROM {target}b)"""


def porter(words: str, extended: bool) -> str:
    """CTEs that end in ``stems`` (word, stem) of the distinct column ``word`` of ``words``."""
    ext = "TRUE" if extended else "FALSE"
    irregular = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in IRREGULAR.items()) if extended else "WHEN '' THEN ''"
    step2 = {**STEP2, "fulli": "ful"} if extended else STEP2
    ali = f"CASE WHEN {ext} AND ends_with(w, 'alli') AND {_measure(_cut('w', 4))} > 0 THEN {_cut('w', 2)} ELSE w END"
    past = f"""CASE WHEN {ext} AND ends_with(w, 'ied') THEN CASE WHEN length(w) = 4 THEN {_cut('w', 1)} ELSE {_cut('w', 2)} END
  WHEN ends_with(w, 'eed') THEN CASE WHEN {_measure(_cut('w', 3))} > 0 THEN {_cut('w', 1)} ELSE w END
  WHEN stem IS NULL OR NOT contains({_shape('stem')}, 'V') THEN w
  WHEN right(stem, 2) IN ('at', 'bl', 'iz') THEN concat(stem, 'e')
  WHEN length(stem) > 1 AND right(stem, 1) = left(right(stem, 2), 1) AND right({_shape('stem')}, 1) = 'C'
    THEN CASE WHEN right(stem, 1) IN ('l', 's', 'z') THEN stem ELSE {_cut('stem', 1)} END
  WHEN {_measure('stem')} = 1 AND {_short_end('stem', extended)} THEN concat(stem, 'e') ELSE stem END"""
    before_y = _cut("w", 1)
    turn = (f"length({before_y}) > 1 AND right({_shape(before_y)}, 1) = 'C'" if extended else f"contains({_shape(before_y)}, 'V')")
    return f"""p1 AS (SELECT word, CASE WHEN ends_with(word, 'sses') THEN {_cut('word', 2)}
  WHEN ends_with(word, 'ies') THEN CASE WHEN {ext} AND length(word) = 4 THEN {_cut('word', 1)} ELSE {_cut('word', 2)} END
  WHEN ends_with(word, 's') AND NOT ends_with(word, 'ss') THEN {_cut('word', 1)} ELSE word END AS w FROM {words}),
p2a AS (SELECT *, CASE WHEN ends_with(w, 'ed') THEN {_cut('w', 2)} WHEN ends_with(w, 'ing') THEN {_cut('w', 3)} END AS stem FROM p1),
p2 AS (SELECT word, {past} AS w FROM p2a),
p3 AS (SELECT word, CASE WHEN ends_with(w, 'y') AND {turn} THEN concat({before_y}, 'i') ELSE w END AS w FROM p2),
p4 AS (SELECT word, {ali} AS w FROM p3),
{_suffix_step('p4', 'p5', step2, "{m} > 0", f"CASE WHEN {ext} AND suf = 'logi' THEN concat(stem, 'l') ELSE stem END")},
{_suffix_step('p5', 'p6', STEP3, "{m} > 0")},
{_suffix_step('p6', 'p7', STEP4, "{m} > 1 AND (suf <> 'ion' OR right(stem, 1) IN ('s', 't'))")},
p8 AS (SELECT word, CASE WHEN ends_with(w, 'e') AND ({_measure(before_y)} > 1
  OR ({_measure(before_y)} = 1 AND NOT {_short_end(before_y, extended)})) THEN {before_y} ELSE w END AS w FROM p7),
p9 AS (SELECT word, CASE WHEN ends_with(w, 'll') AND {_measure(before_y)} > 1 THEN {before_y} ELSE w END AS w FROM p8),
stems AS (SELECT word, CASE word {irregular} ELSE CASE WHEN length(word) < 3 THEN word ELSE w END END AS stem FROM p9)"""


# the tokens as stems
STEMMED_TOKENS = TOKENS.replace("e AS (\n  SELECT article_id", "e0 AS (\n  SELECT article_id").replace(
    "tf AS (\n", f"""words AS (SELECT DISTINCT term AS word FROM e0),
{porter('words', False)},
e AS (SELECT article_id, published, category, source, field, stem AS term, pos, field_length FROM e0 JOIN stems ON e0.term = stems.word),
tf AS (\n""", 1)


def stemmed_list(text: str) -> str:
    """CTEs that end in ``stemmed`` (doc_id, processed_text) of all documents: what the classifier sees of ``text``."""
    return f"""tok AS (SELECT doc_id, {content_word_list(text)} AS toks FROM documents),
pos AS (SELECT doc_id, unnest(toks) AS word, unnest(range(len(toks))) AS place FROM tok),
words AS (SELECT DISTINCT word FROM pos),
{porter('words', True)},
line AS (SELECT doc_id, string_agg(stem, ' ' ORDER BY place) AS processed_text FROM pos JOIN stems USING (word) GROUP BY doc_id),
stemmed AS (SELECT doc_id, coalesce(processed_text, '') AS processed_text FROM tok LEFT JOIN line USING (doc_id))"""
