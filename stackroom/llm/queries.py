"""Queries of the text operators over the whole tables of a folder, and SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession, functions as F

from stackroom.llm import bpe, exact, infill, langid, lines, media, merkle, near, packing, quality, sentence, substring, toxicity
from stackroom.llm.common import table
from stackroom.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(function):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(table(prepare(spark), sf_dir, "documents"), sf_dir)

    QUERIES[function.__name__] = run
    return function


@query
def op1_packing(docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


@query
def op2_bpe(docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs)


@query
def op6_substring_dedup(docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring.drop_repeats(docs)


@query
def op10_near_dedup(docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.classes(docs).select("doc_id", "class_id", "class_size", "kept")


ORACLE_SQL["op10_near_dedup"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-]+') AS w
  FROM documents WHERE text IS NOT NULL
), starts AS (
  SELECT doc_id, w, UNNEST(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle FROM starts
), sizes AS (
  SELECT doc_id, count(*) AS size FROM shingles GROUP BY doc_id
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n
  FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b
  WHERE 5 * n >= 4 * (s.size + t.size - n)
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT doc_id, b FROM reached JOIN both_ways ON a = other
), classes AS (
  SELECT doc_id, min(other) AS class_id FROM reached GROUP BY doc_id
)
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size, doc_id = class_id AS kept FROM classes
"""


@query
def op9_line_dedup(docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = lines.drop_runs(docs)
    digest = F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    return kept.select("doc_id", "n_lines", "n_removed", "n_runs", "longest_run", digest)


ORACLE_SQL["op9_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, UNNEST(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE text IS NOT NULL
), runs AS (
  SELECT doc_id, i, line, lead(line, 1) OVER d AS second, lead(line, 2) OVER d AS third
  FROM lines WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), copies AS (
  SELECT doc_id, i, 3 AS length, row_number() OVER (PARTITION BY line, second, third ORDER BY doc_id, i) AS copy
  FROM runs WHERE third IS NOT NULL
  UNION ALL
  SELECT doc_id, i, 2, row_number() OVER (PARTITION BY line, second ORDER BY doc_id, i)
  FROM runs WHERE length(line) + length(second) >= 120
  UNION ALL
  SELECT doc_id, i, 1, row_number() OVER (PARTITION BY line ORDER BY doc_id, i) FROM runs WHERE length(line) >= 120
  UNION ALL
  SELECT doc_id, 1, len(string_split(text, chr(10))), row_number() OVER (PARTITION BY text ORDER BY doc_id)
  FROM documents WHERE text <> '' AND len(string_split(text, chr(10))) < 3
), gone AS (
  SELECT DISTINCT doc_id, i + UNNEST(range(length)) AS i FROM copies WHERE copy > 1
), marked AS (
  SELECT lines.doc_id, lines.i, line, gone.i IS NOT NULL AS removed,
         coalesce(lag(gone.i) OVER (PARTITION BY lines.doc_id ORDER BY lines.i) IS NOT NULL, FALSE) AS removed_before
  FROM lines LEFT JOIN gone ON gone.doc_id = lines.doc_id AND gone.i = lines.i
), stretches AS (
  SELECT doc_id, count(*) AS length
  FROM (SELECT doc_id, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS stretch FROM gone)
  GROUP BY doc_id, stretch
), longest AS (
  SELECT doc_id, max(length) AS length FROM stretches GROUP BY doc_id
)
SELECT documents.doc_id, count(marked.i) AS n_lines, count(*) FILTER (removed) AS n_removed,
       count(*) FILTER (removed AND NOT removed_before) AS n_runs, coalesce(any_value(longest.length), 0) AS longest_run,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY marked.i) FILTER (NOT removed), '')) AS kept_sha256
FROM documents LEFT JOIN marked ON marked.doc_id = documents.doc_id
LEFT JOIN longest ON longest.doc_id = documents.doc_id
GROUP BY documents.doc_id
"""


@query
def op4_exact_dedup(docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.groups(docs)


ORACLE_SQL["op4_exact_dedup"] = """
WITH texts AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS same
  FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(same) AS text_sha256
FROM texts WINDOW g AS (PARTITION BY same)
"""


@query
def op7_language_id(docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.identify(docs)


@query
def op8_media(docs: DataFrame, sf_dir: str) -> DataFrame:
    return media.round_trip(docs)


@query
def op3_toxicity(docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.classify(docs, table(docs.sparkSession, sf_dir, "labels"))


@query
def op5_quality(docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.classify(docs, table(docs.sparkSession, sf_dir, "labels"))


@query
def op11_fill_in_middle(docs: DataFrame, sf_dir: str) -> DataFrame:
    return infill.fill_in_middle(docs)


ORACLE_SQL["op11_fill_in_middle"] = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '(?s)[A-Za-z]+|[^A-Za-z]') AS units,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), drawn AS (
  SELECT *, len(units) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(units) + 1) AS one,
         CAST('0x' || h[9:16] AS BIGINT) % (len(units) + 1) AS two,
         CAST('0x' || h[17:24] AS BIGINT) % 100 AS three, CAST('0x' || h[25:32] AS BIGINT) % 100 AS four
  FROM cut
), parts AS (
  SELECT doc_id, text, n, array_to_string(units[1:least(one, two)], '') AS prefix,
         array_to_string(units[least(one, two) + 1:greatest(one, two)], '') AS middle,
         array_to_string(units[greatest(one, two) + 1:], '') AS suffix,
         CASE WHEN text = '' OR three >= 90 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
              THEN 'plain' WHEN four < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""


@query
def op12_sentencepiece(docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentence.encode(docs)


@query
def op13_merkle(docs: DataFrame, sf_dir: str) -> DataFrame:
    return merkle.audit(docs)


ORACLE_SQL["op13_merkle"] = r"""
WITH RECURSIVE rows AS (
  SELECT doc_id, lang, '-' AS nothing, text,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
         CASE WHEN xor(4294967295, list_reduce(
                list_concat([4294967295], flatten(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1),
                  lambda i: [ascii(CAST(doc_id AS VARCHAR)[i]), 0, 0, 0, 0, 0, 0, 0]))),
                lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1)))) % 3 = 0
              THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS later
  FROM documents
), digests AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(later) || ':' || later, '-')) AS changed
  FROM rows
), leaves AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i
  FROM digests
), within AS (
  SELECT tree, 0 AS level, i, leaf AS digest, count(*) OVER (PARTITION BY tree) AS size FROM leaves
  UNION ALL
  SELECT tree, any_value(level) + 1, i // 8, sha256(string_agg(digest, '' ORDER BY i)), any_value((size + 7) // 8)
  FROM within WHERE size > 1 GROUP BY tree, i // 8
), over_all AS (
  SELECT 0 AS level, tree AS i, digest, count(*) OVER () AS size FROM within WHERE size = 1
  UNION ALL
  SELECT any_value(level) + 1, i // 8, sha256(string_agg(digest, '' ORDER BY i)), any_value((size + 7) // 8)
  FROM over_all WHERE size > 1 GROUP BY i // 8
), nodes AS (
  SELECT tree, level, i, digest, size FROM within WHERE size > 1
  UNION ALL SELECT -1, level, i, digest, size FROM over_all WHERE size > 1
), siblings AS (
  SELECT n.tree, n.level, n.i, coalesce(string_agg(s.digest, '' ORDER BY s.i) FILTER (s.i < n.i), '') AS before,
         coalesce(string_agg(s.digest, '' ORDER BY s.i) FILTER (s.i > n.i), '') AS after
  FROM nodes n JOIN nodes s ON n.tree = s.tree AND n.level = s.level AND n.i // 8 = s.i // 8
  GROUP BY n.tree, n.level, n.i
), heights AS (
  SELECT tree, max(level) AS height FROM within GROUP BY tree
), paths AS (
  SELECT l.tree AS leaf_tree, l.i AS leaf_i, s.level AS step, s.before, s.after
  FROM leaves l JOIN siblings s ON s.tree = l.tree AND s.i = l.i >> (3 * s.level)
  UNION ALL
  SELECT l.tree, l.i, h.height + s.level, s.before, s.after
  FROM leaves l JOIN heights h ON h.tree = l.tree JOIN siblings s ON s.tree = -1 AND s.i = l.tree >> (3 * s.level)
), climb AS (
  SELECT tree, i, 0 AS step, changed AS folded, '' AS proof FROM leaves
  UNION ALL
  SELECT c.tree, c.i, c.step + 1, sha256(before || folded || after), proof || before || after
  FROM climb c JOIN paths p ON p.leaf_tree = c.tree AND p.leaf_i = c.i AND p.step = c.step
), arrived AS (
  SELECT tree, i, arg_max(folded, step) AS folded, arg_max(proof, step) AS proof FROM climb GROUP BY tree, i
)
SELECT doc_id, leaf, w.digest AS subroot, o.digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root,
       folded = o.digest AS verified
FROM leaves l JOIN arrived a ON a.tree = l.tree AND a.i = l.i JOIN within w ON w.tree = l.tree AND w.size = 1
JOIN over_all o ON o.size = 1
"""


QUERIES["pipeline"] = corpus_pipeline.run


ORACLE_SQL["op6_substring_dedup"] = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), words AS (
  SELECT doc_id, UNNEST(words) AS word, generate_subscripts(words, 1) AS i FROM split
), windows AS (
  SELECT doc_id, i, word, string_agg(word, ' ') OVER reach AS content, count(*) OVER reach AS size
  FROM words WINDOW reach AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)
), judged AS (
  SELECT doc_id, i, word, size = 20 AND row_number() OVER (PARTITION BY size = 20, content ORDER BY doc_id, i) > 1 AS again
  FROM windows
), marked AS (
  SELECT doc_id, i, word,
         bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS removed
  FROM judged
)
SELECT documents.doc_id, count(marked.i) AS n_words, count(*) FILTER (removed) AS n_removed,
       sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT removed), '')) AS kept_sha256
FROM documents LEFT JOIN marked ON marked.doc_id = documents.doc_id
GROUP BY documents.doc_id
"""
