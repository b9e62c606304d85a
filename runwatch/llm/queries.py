"""The registered queries of this folder: one for each operator, and the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    fingerprints, hmm, langid, minhash, mixing, multiindex, packing, periodic, quality, repetition,
    tokens, toxicity, whitening,
)
from .shared import documents, labels


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language(documents(spark, sf_dir))


def op3_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(documents(spark, sf_dir), labels(spark, sf_dir))
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("offending").alias("n_offending"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


def op6_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.language_model(documents(spark, sf_dir))


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = fingerprints.edit_report(documents(spark, sf_dir))
    return report.join(fingerprints.near_counts(report.select("fingerprint")), "fingerprint")


def op8_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir), labels(spark, sf_dir))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(documents(spark, sf_dir))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    whitened = whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return whitened.withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ruled = repetition.quality_rules(documents(spark, sf_dir))
    return ruled.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        "base_failed", "kept", "n_lines", "dup_line_chars")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_report(periodic.with_planted_runs(documents(spark, sf_dir)))


QUERIES = {
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "op2_language_id": op2_language_id,
    "op3_toxicity_mil": op3_toxicity_mil,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_hmm_scoring": op6_hmm_scoring,
    "op7_document_fingerprints": op7_document_fingerprints,
    "op8_quality_pu": op8_quality_pu,
    "op9_token_counts": op9_token_counts,
    "op10_source_mixing": op10_source_mixing,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_repetition_rules": op12_repetition_rules,
    "op13_periodic_runs": op13_periodic_runs,
}
_REACH = """reach AS (SELECT id AS a, id AS b FROM nodes UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
groups AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"



def _windows_sql(width: int) -> str:
    """Windows of ``width`` words of table p: which equal an earlier one of their text, which any."""
    return f"""g{width} AS (SELECT doc_id, i, n, string_agg(x, ' ') OVER (PARTITION BY doc_id ORDER BY i
  ROWS BETWEEN CURRENT ROW AND {width - 1} FOLLOWING) AS g FROM p),
m{width} AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, g ORDER BY i) > 1 AS later,
  count(*) OVER (PARTITION BY doc_id, g) > 1 AS twice FROM g{width} WHERE i <= n - {width})"""


def _covered_sql(width: int) -> str:
    """Word characters of each text inside windows that equal an earlier one."""
    return f"""c{width} AS (SELECT doc_id, sum(length(x)) AS c FROM p JOIN (SELECT DISTINCT doc_id, i + k AS i
  FROM m{width}, range({width}) AS r(k) WHERE later) USING (doc_id, i) GROUP BY doc_id)"""


_WIDTHS = sorted(repetition.LIMITS)
_REPETITION_SQL = f"""WITH w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'),
  lambda t: t <> '') AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n, unnest(range(len(w))) AS i, unnest(w) AS x FROM w),
{", ".join(_windows_sql(k) for k in (3, *_WIDTHS))},
{", ".join(_covered_sql(k) for k in _WIDTHS)},
r AS (SELECT doc_id, count(*) AS n_repeat_words FROM (SELECT DISTINCT doc_id, i + k FROM m3, range(3) AS r(k) WHERE twice)
  GROUP BY doc_id),
l AS (SELECT doc_id, unnest(range(len(s))) AS i, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
k AS (SELECT *, length(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g')) AS c,
  row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS again FROM l),
q AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (again) AS n_dup_lines,
  coalesce(sum(c) FILTER (again), 0) AS dup_line_chars FROM k WHERE c > 0 GROUP BY doc_id),
f AS (SELECT w.doc_id, coalesce(len(w), 0) AS n_words,
  coalesce(length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')), 0) AS word_chars,
  coalesce(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')), 0) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
  CAST(coalesce(dup_line_chars, 0) AS BIGINT) AS dup_line_chars, {", ".join(f"coalesce(c{k}.c, 0) AS v{k}" for k in _WIDTHS)}
  FROM w LEFT JOIN r USING (doc_id) LEFT JOIN q USING (doc_id) {" ".join(f"LEFT JOIN c{k} USING (doc_id)" for k in _WIDTHS)}),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
NOT base_failed AND 100 * n_dup_lines <= {repetition.LINES} * n_lines AND 100 * dup_line_chars <= {repetition.LINE_CHARS} * word_chars
{" ".join(f"AND 100 * v{k} <= {repetition.LIMITS[k]} * word_chars" for k in _WIDTHS)} AS kept, n_lines, dup_line_chars
FROM b"""

#: the same results by brute force, where SQL can express them
ORACLE_SQL: dict[str, str] = {
    "op1_embedding_near_dedup": f"""WITH RECURSIVE v AS (SELECT DISTINCT vec_id, label, CAST(embedding AS DOUBLE[]) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL),
nodes AS (SELECT DISTINCT vec_id AS id FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.93e0),
{_REACH}, n AS (SELECT a AS id, count(*) AS n_links FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n_links, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN groups ON groups.id = e.vec_id LEFT JOIN n ON n.id = e.vec_id""",
    "op5_minhash_near_dedup": f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(
  translate(text, '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda t: t <> '') AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5
  THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
nodes AS (SELECT DISTINCT doc_id AS id FROM documents),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
{_REACH}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN groups ON groups.id = d.doc_id LEFT JOIN sizes ON sizes.doc_id = d.doc_id""",
    "op12_repetition_rules": _REPETITION_SQL,
}
