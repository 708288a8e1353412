"""The pN_ queries and their SQL, where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veilspark.llm import bpe, lookalike, mixing, neardup, overlap, personal, quota, sentences
from veilspark.session import read_table, spread

#: Key of the surrogates in the queries below, whose tables are invented. Operators take the key of their caller.
KEY = "key of the invented tables"

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "p1_found": lambda s, d: overlap.found(read_table(s, d, "holdout", "id", "text"), read_table(s, d, "es_1", "id", "text")),
        "p1_report": lambda s, d: overlap.report(read_table(s, d, "holdout", "id", "text", "split", "source"), read_table(s, d, "es_1", "id", "text")),
        "p2_found": lambda s, d: lookalike.found(read_table(s, d, "holdout", "id", "text", "expected")),
        "p2_texts": lambda s, d: lookalike.consistent(read_table(s, d, "holdout", "id", "text", "expected")),
        "p3_found": lambda s, d: quota.out_of_reach(read_table(s, d, "es_1"), read_table(s, d, "coverage_targets")),
        "p3_counts": lambda s, d: quota.counts(read_table(s, d, "es_1"), read_table(s, d, "coverage_targets")),
        "p3_sample": lambda s, d: quota.sample(read_table(s, d, "es_1"), read_table(s, d, "coverage_targets")),
        "p3_gaps": lambda s, d: quota.gaps(read_table(s, d, "es_1"), read_table(s, d, "coverage_targets")),
        "p4_found": lambda s, d: neardup.found(read_table(s, d, "es_1", "id", "text")),
        "p4_groups": lambda s, d: neardup.groups(read_table(s, d, "es_1", "id", "text")),
        "p5_found": lambda s, d: personal.found({t: read_table(s, d, t, "id", "text") for t in ("es_1", "holdout")}, KEY),
        "p5_texts": lambda s, d: personal.replaced({t: read_table(s, d, t, "id", "text") for t in ("es_1", "holdout")}, KEY),
        "p6_ids": lambda s, d: bpe.token_ids(spread(read_table(s, d, "documents", "doc_id", "text"))),
        "p7_found": lambda s, d: mixing.out_of_reach(read_table(s, d, "documents"), read_table(s, d, "mix_weights")),
        "p7_mixture": lambda s, d: mixing.mixture(read_table(s, d, "documents"), read_table(s, d, "mix_weights")),
        "p7_shares": lambda s, d: mixing.shares(read_table(s, d, "documents"), read_table(s, d, "mix_weights")),
        "p8_found": lambda s, d: sentences.found(read_table(s, d, "documents", "doc_id", "text")),
    }


_COUNTS = """
WITH ids AS (
  SELECT id, min(lower(trim(lang))) AS lang, min(lower(trim(sensitivity))) AS sensitivity,
         min(regexp_replace(lower(trim(cell)), '[ -]', '_', 'g')) AS cell
  FROM es_1 WHERE id IS NOT NULL GROUP BY id),
per AS (
  SELECT 'lang' AS field_name, lang AS category, count(*) AS ids FROM ids GROUP BY lang
  UNION ALL SELECT 'sensitivity', sensitivity, count(*) FROM ids GROUP BY sensitivity
  UNION ALL SELECT 'cell', cell, count(*) FROM ids GROUP BY cell),
wanted AS (
  SELECT t.field_name, t.category, t.target_share, t.min_count, coalesce(p.ids, 0) AS ids,
         greatest(t.min_count::DOUBLE, t.target_share * (SELECT count(*) // 5 FROM ids)) AS wanted
  FROM (SELECT DISTINCT field_name, category, target_share, min_count FROM coverage_targets) t LEFT JOIN per p USING (field_name, category))
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": _COUNTS + "SELECT field_name, category FROM wanted WHERE ids < wanted",
        "p3_counts": _COUNTS + "SELECT field_name, category, target_share, min_count, ids, wanted, ids < wanted AS short FROM wanted",
    }
