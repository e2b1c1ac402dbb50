"""Registered queries of the operators, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.driver_views import table
from . import (alignment, decontamination, embeddings, exact_dedup, licenses, line_dedup, minhash, packing, periodic_runs,
               suffixes, token_counts, toxicity, warc)


PIECES = "/opt/tokenizers/piece_bpe_32k.model"
BYTE_PAIRS = "/opt/tokenizers/byte_bpe_50k.json"


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of all documents, lengths in words."""
    return packing.best_fit(packing.word_lengths(table(spark, sf_dir, "documents")))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices and expressions of every document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to an archive and read back."""
    return warc.summary(warc.records(warc.archived(table(spark, sf_dir, "pages"))))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate group of every document, on shingles of two words."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), minhash.NearDuplicateParams(shingle=2))


def op5_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = PIECES) -> DataFrame:
    """Words and greedy word pieces of every document."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), token_counts.vocabulary_of(vocabulary))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in every document."""
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of repeated strings of 100 bytes."""
    done = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its later repeated runs of lines."""
    done = line_dedup.delete_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "line_counts.n_lines", "line_counts.n_removed", "line_counts.n_runs",
                       F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score and prediction of every document."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of equal texts of every document."""
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and near-duplicate group of every vector."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op12_alignment(spark: SparkSession, sf_dir: str, a: str = BYTE_PAIRS, b: str = PIECES) -> DataFrame:
    """Groups and links of two tokenizers in every document."""
    return alignment.aligned(table(spark, sf_dir, "documents"), a, b)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeating words in every document, one in ten made periodic before."""
    return periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), weave=True)


QUERIES = {"op1_packing": op1_packing, "op2_licenses": op2_licenses, "op3_warc": op3_warc,
           "op4_minhash": op4_minhash,
           "op5_token_counts": op5_token_counts, "op6_decontamination": op6_decontamination,
           "op7_suffix_dedup": op7_suffix_dedup, "op8_line_dedup": op8_line_dedup,
           "op9_toxicity": op9_toxicity, "op10_exact_dedup": op10_exact_dedup,
           "op11_embedding_dedup": op11_embedding_dedup, "op12_alignment": op12_alignment,
           "op13_periodic_runs": op13_periodic_runs}

# SHA-1 has no function there; it is put together from the 160 bits only in the tests
ORACLES: dict[str, str] = {
    "op10_exact_dedup": r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS k FROM documents),
g AS (SELECT k, count(*) AS group_size, first(doc_id ORDER BY n DESC, doc_id) AS keep_id FROM t GROUP BY k)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(k) AS text_sha256
FROM t JOIN g USING (k)""",
    "op8_line_dedup": r"""
WITH a AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM a),
c AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM l),
b AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS until,
             (sum(w) OVER (PARTITION BY doc_id ORDER BY pos) - w)::BIGINT AS before FROM c WHERE w > 0),
win AS (SELECT doc_id, 'right' AS kind, pos, max(pos) OVER r AS last, sum(w) OVER r AS n, list(line) OVER r AS k FROM b
        WINDOW r AS (PARTITION BY doc_id ORDER BY before RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
        UNION ALL
        SELECT doc_id, 'left', min(pos) OVER l, pos, sum(w) OVER l, list(line) OVER l FROM b
        WINDOW l AS (PARTITION BY doc_id ORDER BY until RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
f AS (SELECT *, row_number() OVER (PARTITION BY kind, k ORDER BY doc_id, pos, last) AS rn FROM win WHERE n >= 50),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, last + 1)) AS pos FROM f WHERE rn > 1),
isl AS (SELECT doc_id, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM gone),
runs AS (SELECT doc_id, count(DISTINCT g) AS n_runs, count(*) AS n_removed FROM isl GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS t FROM l ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, coalesce(len(ls), 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs,
       sha256(coalesce(t, '')) AS kept_sha256
FROM a LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)""",
}
