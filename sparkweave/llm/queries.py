"""Thin queries over the operators: whole tables, production parameters, columns as their contracts name them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import best_fit, common, decontaminate, fim, html_text, licenses, line_dedup, near_dup, packing, quality, substring_dedup, token_align, token_counts, tokens, toxicity

VOCABULARY, BYTE_LEVEL, PIECES = "word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.passages(common.read(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.hits(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.read(spark, sf_dir, "documents"), tokens.vocabulary(VOCABULARY))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.links(common.read(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(common.read(spark, sf_dir, "documents"), tokens.vocabulary(VOCABULARY))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.rules(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))
    return out.select("doc_id", "_quality.*")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(common.read(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(common.read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("_lines.n_lines"), F.col("_lines.n_dropped"), F.sha2(F.col("_lines.kept"), 256).alias("kept_sha256"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(common.read(spark, sf_dir, "pages")).select("page_id", "url", F.col("_main").alias("text"), F.length("_main").cast("long").alias("n_chars"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack(common.read(spark, sf_dir, "documents"), tokens.vocabulary(BYTE_LEVEL))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.align(common.read(spark, sf_dir, "documents"), tokens.vocabulary(BYTE_LEVEL), tokens.vocabulary(PIECES))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.transform(common.read(spark, sf_dir, "documents"))
    back = fim.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def op7_sql() -> str:
    """The same rules in SQL with patterns of its own; the known texts are canonicalised there too, line by line."""
    x = "lower(text)"
    for a, b in licenses.SPELLINGS:
        x = f"replace({x}, {_quoted(a)}, {_quoted(b)})" if a != "\r" else f"replace({x}, chr(13), ' ')"
    known = ", ".join(f"({i}, {_quoted(name)}, {_quoted(text)})" for i, (name, text) in enumerate(licenses.KNOWN))
    digests = ", ".join(f"({_quoted(name)}, {_quoted(digest)})" for name, digest in licenses.DIGESTS)
    no, word, titles = r"[^\p{L}\p{N}]", r"[\p{L}\p{N}]", ", ".join(map(_quoted, licenses.TITLES))
    holder = rf"""(regexp_matches(line, '^{no}*copyright{no}+{word}') AND NOT regexp_matches(line, '^{no}*copyright{no}+({'|'.join(licenses.PROSE)})({no}|$)'))
      OR regexp_matches(line, '^{no}*\(c\){no}*[0-9]{{4}}') OR regexp_matches(line, '^{no}*all rights reserved{no}*$')"""
    mark, ended = r"[(]?(?:[0-9][0-9]?|[a-z]|[ivx][ivx][ivx]?[ivx]?)[.)]+", r"(\p{L}\p{L}\p{L}\p{L}[.;:] |[:;] )"
    item = rf"regexp_replace(line, '^{no}*{mark}[ \t]+({no}*{word})', ' \1')"
    item = rf"regexp_replace({item}, '{ended}{mark}[ \t]+({no}*{word})', '\1 \2', 'g')"
    item = rf"CASE WHEN i < n THEN regexp_replace({item}, '{ended}{mark}[ \t]*$', '\1') ELSE {item} END"
    said = f"coalesce(string_agg(c, ' ' ORDER BY i) FILTER (WHERE c <> '' AND c NOT IN ({titles})), '')"
    for a, b in licenses.PHRASES:
        said = f"replace({said}, {_quoted(a)}, {_quoted(b)})"
    return rf"""
WITH known(id, license, text) AS (VALUES {known}),
texts AS (SELECT 'k' AS kind, id, {x} AS text FROM known UNION ALL SELECT 'd', doc_id, coalesce({x}, '') FROM documents),
lines AS (
  SELECT kind, id, u.i AS i, len(string_split(text, chr(10))) AS n, string_split(text, chr(10))[u.i] AS line
  FROM texts, LATERAL (SELECT unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i) u
),
canon AS (
  SELECT kind, id, i, CASE WHEN {holder} THEN '' ELSE trim(regexp_replace({item}, '{no}+', ' ', 'g')) END AS c FROM lines
),
whole AS (
  SELECT kind, id, sha256({said}) AS digest,
    coalesce(string_agg(c, ' ' ORDER BY i) FILTER (WHERE c <> ''), '') AS said
  FROM canon GROUP BY kind, id
),
tab AS (
  SELECT digest, min(license) AS license FROM (SELECT digest, license FROM whole JOIN known USING (id) WHERE kind = 'k' UNION ALL SELECT d, n FROM (VALUES {digests}) v(n, d))
  WHERE digest <> sha256('') GROUP BY digest
),
tab_lines AS (SELECT said, min(license) AS license FROM whole JOIN known USING (id) WHERE kind = 'k' AND said <> '' GROUP BY said),
noted AS (
  SELECT id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices
  FROM canon JOIN tab_lines ON said = c WHERE kind = 'd' GROUP BY id
)
SELECT w.id AS doc_id, w.digest, t.license AS license_id, coalesce(n.notices, '') AS notices
FROM whole w LEFT JOIN tab t ON t.digest = w.digest LEFT JOIN noted n ON n.id = w.id WHERE w.kind = 'd'
"""


OP8_SQL = r"""
WITH lines AS (
  SELECT doc_id, u.i AS i, string_split(coalesce(text, ''), chr(10))[u.i] AS line
  FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i) u
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), repeats AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
), marked AS (
  SELECT k.doc_id, k.i, k.line, r.key IS NOT NULL AND k.doc_id > r.first AS gone FROM keyed k LEFT JOIN repeats r USING (key)
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


OP13_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS h FROM documents
), cut AS (
  SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS units, len(regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]')) AS n,
    CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM texts
), formed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM cut
), parts AS (
  SELECT *, array_to_string(units[1:lo], '') AS p, array_to_string(units[lo + 1:hi], '') AS m, array_to_string(units[hi + 1:], '') AS s FROM formed
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_decontamination, op3_packing, op4_ngram_jaccard_join, op5_token_counts, op6_quality_rules, op7_license_scan, op8_line_dedup, op9_html_extraction, op10_toxicity, op11_best_fit_packing, op12_token_alignment, op13_fill_in_middle)}


def oracle_sql() -> dict[str, str]:
    return {"op7_license_scan": op7_sql(), "op8_line_dedup": OP8_SQL, "op13_fill_in_middle": OP13_SQL}
