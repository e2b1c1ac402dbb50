"""Repeated runs of lines, found by winnowing; DataFrame functions only.

From every line with words a window goes to the right, and another one to the left, over lines with words
until it has ``min_words``.  Of each window the least line hash is selected as a fingerprint, and the
distinct (fingerprint, place) are kept: a repeated run of at least that many words has windows, and so
fingerprints, in both places.  Places whose fingerprint is nowhere else are done with.  Around the others
the lines are read again, and the windows that selected them are compared by the hashes of all their
lines; a window whose lines all stand on end earlier too (smaller doc_id, or earlier in the same text) is
a match.  Matches that touch extend one another both ways, to the first and the last line of the repeated
run (its first lines by windows to the right, its last ones by windows to the left), and the run's lines
go.  The first place of a run stays.  Windows are grouped instead of pairs of places, so a fingerprint
that is in a third of all texts costs a row for each of its windows and no pairs.

Only hashes of lines are shuffled; texts meet the few rows of their runs once, at the end.

Words are runs of characters other than ASCII white space.  Cases with a defined result: a null text stays null,
an empty one empty; windows that end before they have ``min_words`` are no windows; of rows with one
doc_id, the order of their texts' hashes decides which is earlier; rows repeated whole are one document and
get equal results; a null doc_id comes first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rows import unused
from .storage import stored

MIN_WORDS = 50


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, twin, pos, h, before, until) of every line with words: its hash, and the words before and up to its end."""
    lines = F.transform(F.split("text", "\n"), lambda line, i: F.struct(
        i.alias("pos"), F.xxhash64(line).alias("h"), F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+")).alias("w")))
    hashed = (docs.filter("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("twin"), lines.alias("lines"))
              .groupBy("doc_id", "twin").agg(F.any_value("lines").alias("lines"))  # rows repeated whole
              .select("doc_id", "twin", F.inline("lines")).filter("w > 0"))
    text = Window.partitionBy("doc_id", "twin").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return hashed.withColumn("until", F.sum("w").over(text).cast("long")).select(
        "doc_id", "twin", "pos", "h", (F.col("until") - F.col("w")).alias("before"), "until")


def _windows(lines: DataFrame, min_words: int, whole: bool) -> DataFrame:
    """(doc_id, twin, print, print_pos) of every window; if ``whole`` also pos, last, k1, k2: its extent and contents."""
    text = Window.partitionBy("doc_id", "twin")

    def window(kind, reach):
        least = F.min(F.struct("h", "pos")).over(reach)
        parts = [(F.max("until").over(reach) - F.min("before").over(reach)).alias("n"),
                 least["h"].alias("print"), least["pos"].alias("print_pos")]
        if whole:
            hs = F.collect_list("h").over(reach)
            parts += [F.min("pos").over(reach).alias("pos"), F.max("pos").over(reach).alias("last"),
                      F.xxhash64(F.lit(kind), hs).alias("k1"), F.xxhash64(F.lit(kind + 2), F.reverse(hs)).alias("k2")]
        return F.struct(*parts)

    # the lines that start less than min_words words after this one does, or end less than that before its end
    right = window(0, text.orderBy("before").rangeBetween(0, min_words - 1))
    left = window(1, text.orderBy("until").rangeBetween(1 - min_words, 0))
    return (lines.select("doc_id", "twin", right.alias("right"), left.alias("left"))
            .select("doc_id", "twin", F.inline(F.array("right", "left")))
            .filter(F.col("n") >= min_words).drop("n"))


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, twin, runs): the runs of lines to delete, an array of (first, last) in order.

    ``twin`` is the text's hash, which tells rows of one doc_id apart.
    """
    lines = stored(_lines(docs), "lines")
    selected = stored(_windows(lines, min_words, False).distinct(), "selected")
    place = F.struct("doc_id", "twin", "print_pos")
    prints = selected.groupBy("print").agg(F.min(place).alias("low"), F.max(place).alias("high")).filter("low <> high").select("print")
    # selected minima that stand elsewhere too, and the texts that have any
    shared = stored(selected.join(prints, "print"), "shared")
    texts = shared.select(F.col("doc_id").alias("id"), F.col("twin").alias("own")).distinct()
    near = lines.join(texts, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("twin") == F.col("own")), "left_semi")
    marks = shared.select(F.col("doc_id").alias("id"), F.col("twin").alias("own"), F.col("print_pos").alias("at"))
    around = (_windows(near, min_words, True)
              .join(marks, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("twin") == F.col("own"))
                    & (F.col("print_pos") == F.col("at")), "left_semi")
              .select("doc_id", "twin", "pos", "last", "k1", "k2"))
    around = stored(around, "windows")
    earliest = (around.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "twin", "pos")).alias("source"), F.count("*").alias("n"))
                .filter("n > 1").select("k1", "k2", "source"))
    later = (around.join(earliest, ["k1", "k2"])
             .filter(~(F.struct("doc_id", "twin", "pos").eqNullSafe(F.col("source")))).select("doc_id", "twin", "pos", "last"))
    text = Window.partitionBy("doc_id", "twin").orderBy("pos")
    reached = F.max("last").over(text.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(F.col("pos") <= reached + 1, 0).otherwise(1)
    return (later.withColumn("starts", starts).withColumn("run", F.sum("starts").over(text))
            .groupBy("doc_id", "twin", "run").agg(F.min("pos").alias("first"), F.max("last").alias("last"))
            .groupBy("doc_id", "twin").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs")))


def delete_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, counts: str = "line_counts") -> DataFrame:
    """All columns of ``docs`` (doc_id, text, ...), with the text that is left, and ``counts``.

    ``counts`` is a struct: n_lines of the input, n_removed of them, n_runs.
    """
    own, id_, twin, runs, lines = (unused(docs, n) for n in ("own_twin", "run_doc_id", "run_twin", "runs_of_lines", "all_lines"))
    found = repeated_runs(docs.select("doc_id", "text"), min_words).select(
        F.col("doc_id").alias(id_), F.col("twin").alias(twin), F.col("runs").alias(runs))
    joined = docs.withColumn(own, F.xxhash64("text")).join(
        found, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(twin)), "left")
    joined = joined.withColumn(lines, F.split("text", "\n"))
    # what stands before, between and behind the runs
    kept = F.expr(f"""flatten(transform(sequence(0, size({runs})), i -> slice(
        {lines}, if(i = 0, 0, get({runs}, i - 1).last + 1) + 1,
        if(i = size({runs}), size({lines}), get({runs}, i).first) - if(i = 0, 0, get({runs}, i - 1).last + 1))))""")
    removed = F.aggregate(runs, F.lit(0), lambda total, r: total + r["last"] - r["first"] + 1)
    left = F.when(F.col(runs).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))

    def number(value):
        return F.coalesce(value, F.lit(0)).cast("long")

    return joined.select(*(left.alias(c) if c == "text" else c for c in docs.columns), F.struct(
        number(F.size(lines)).alias("n_lines"), number(removed).alias("n_removed"),
        number(F.size(runs)).alias("n_runs")).alias(counts))


def without_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The columns of ``docs`` (doc_id, text, ...) after the deletion; n_chars, if there, follows the text.

    Documents of which the deletion leaves no word go.
    """
    counts = unused(docs, "line_counts")
    done = delete_repeated_lines(docs, min_words, counts)
    changed = F.col(counts)["n_removed"] > 0
    done = done.filter(~(changed & (F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]")) == 0)))
    if "n_chars" in docs.columns:
        size = F.length("text").cast(docs.schema["n_chars"].dataType)
        done = done.withColumn("n_chars", F.when(changed, size).otherwise(F.col("n_chars")))
    return done.select(*docs.columns)
