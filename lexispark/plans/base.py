"""A table of queries: each has a name, a function of (spark, sf_dir), and SQL for DuckDB where it can be said in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: White space as DuckDB's regular expressions write it.
SPACE = r"\t\n\x0b\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
CORPUS = "corpus AS (SELECT doc_id AS doc_ord, lang AS author, source AS title, (1700 + doc_id % 115)::INTEGER AS year, text FROM documents)"
WORDS = rf"len(regexp_extract_all(text, '[^{SPACE}]+'))::BIGINT"
META = rf"{CORPUS}, meta AS (SELECT doc_ord, author, title, year, {WORDS} AS word_count, text FROM corpus)"
SPLIT = rf"""{CORPUS},
works AS (SELECT author, title, md5('42:' || author || '|' || title) AS k FROM corpus GROUP BY author, title),
work_rank AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY k, title) AS rk, count(*) OVER (PARTITION BY author) AS n FROM works),
split AS (SELECT author, title, CASE WHEN rk <= CASE WHEN n > 1 THEN greatest(1, floor(n * 0.2::DOUBLE)) ELSE 0 END THEN 'test' ELSE 'train' END AS split FROM work_rank),
docs AS (SELECT c.*, s.split FROM corpus c JOIN split s USING (author, title))"""
TOKENS = r"list_filter(regexp_extract_all(lower({t}), '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]+'))"


def counts_sql(source: str) -> str:
    return rf"""tok AS MATERIALIZED (SELECT doc_ord, {TOKENS.format(t="text")} AS t FROM {source}),
words AS (SELECT doc_ord, unnest(t) AS word, unnest(range(len(t))) AS pos FROM tok),
wc AS MATERIALIZED (SELECT doc_ord, word, count(*) AS cnt, min(pos) AS pos FROM words GROUP BY doc_ord, word)"""


def vocab_sql(source: str, n: int) -> str:
    return f"""vocab AS MATERIALIZED (SELECT word, sum(cnt)::BIGINT AS cnt, row_number() OVER (ORDER BY sum(cnt) DESC, min({{'d': doc_ord, 'p': pos}})) AS rank
  FROM {source} GROUP BY word QUALIFY rank <= {n})"""


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function under a name, with its SQL."""

    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep
