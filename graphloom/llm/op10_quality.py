"""op10: quality rules over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import common as C
from . import quality as Q


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    return Q.judge(docs).drop("text")


def _sql() -> str:
    ns = sorted(Q.NGRAM_LIMITS)
    grams = ", ".join("concat_ws(' ', word" + "".join(f", lead(word, {k}) OVER o" for k in range(1, n)) + f") AS g{n}" for n in (3, *ns))
    dups = ", ".join(f"CASE WHEN i + {n - 1} <= n AND count(*) OVER (PARTITION BY doc_id, g{n}, i + {n - 1} <= n) > 1 THEN 1 ELSE 0 END AS d{n}" for n in (3, *ns))
    covers = ", ".join(f"max(d{n}) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS c{n}" for n in (3, *ns))
    sums = ", ".join(f"sum(CASE WHEN c{n} = 1 THEN chars ELSE 0 END)::BIGINT AS dup_{n}_chars" for n in ns)
    outs = ", ".join(f"coalesce(dup_{n}_chars, 0) AS dup_{n}_chars" for n in ns)
    limits = " AND ".join(f"100 * dup_{n}_chars <= {p} * word_chars" for n, p in Q.NGRAM_LIMITS.items())
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM t),
g AS (SELECT doc_id, n, i, length(word) AS chars, {grams} FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
d AS (SELECT doc_id, i, chars, {dups} FROM g),
c AS (SELECT doc_id, chars, {covers} FROM d),
s AS (SELECT doc_id, sum(chars)::BIGINT AS word_chars, sum(c3)::BIGINT AS n_repeat_words, {sums} FROM c GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t),
lg AS (SELECT doc_id, line, count(*) - 1 AS again FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line),
ls AS (SELECT doc_id, sum(again)::BIGINT AS n_dup_lines, sum(again * length(line))::BIGINT AS dup_line_chars FROM lg GROUP BY doc_id),
a AS (SELECT t.doc_id, len(ws)::BIGINT AS n_words, coalesce(word_chars, 0) AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(dup_line_chars, 0) AS dup_line_chars, {outs}
  FROM t LEFT JOIN s USING (doc_id) LEFT JOIN ls USING (doc_id))
SELECT *, n_words < {Q.MIN_WORDS} OR 100 * n_repeat_words > {Q.MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {Q.MIN_WORDS} OR 100 * n_repeat_words > {Q.MAX_REPEAT_PERCENT} * n_words)
  AND 100 * dup_line_chars <= {Q.LINE_LIMIT} * word_chars AND {limits} AS kept
FROM a"""


ORACLE = _sql()
