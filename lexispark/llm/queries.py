"""The queries of this subpackage; each runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexispark.llm import bpe, embedding_dedup, exact_dedup, licenses, mixing, periodic_runs, pii, quality_classifier, quality_rules, simhash, spelling_variants, toxicity, warc
from lexispark.session import spread

#: Where the tokenizer's file is; a parameter of the operator.
TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": lambda s, d: warc.round_trip(table(s, d, "pages")),
        "op2_quality_classifier": lambda s, d: quality_classifier.digest(table(s, d, "documents"), table(s, d, "labels")),
        "op3_toxicity": lambda s, d: toxicity.digest(table(s, d, "documents"), table(s, d, "labels")),
        "op4_simhash": lambda s, d: simhash.digest(table(s, d, "documents")),
        "op5_licenses": lambda s, d: licenses.digest(table(s, d, "documents")),
        "op6_bpe": lambda s, d: bpe.digest(table(s, d, "documents"), tokenizer_path()),
        "op7_quality_rules": lambda s, d: quality_rules.digest(table(s, d, "documents"), table(s, d, "labels")),
        "op8_pii": lambda s, d: pii.digest(table(s, d, "documents")),
        "op9_embeddings": lambda s, d: embedding_dedup.near_duplicates(table(s, d, "embeddings")),
        "op10_mixing": lambda s, d: mixing.digest(table(s, d, "documents")),
        "op11_spelling_variants": lambda s, d: spelling_variants.digest(table(s, d, "documents")),
        "op12_periodic_runs": lambda s, d: periodic_runs.digest(table(s, d, "documents")),
        "op13_exact_dedup": lambda s, d: exact_dedup.digest(s, f"{d}/documents.parquet"),
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_mixing": MIXING, "op11_spelling_variants": VARIANTS, "op12_periodic_runs": RUNS, "op13_exact_dedup": COPIES}


#: One ordered pass over all offers, where the operator uses lanes.
MIXING = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS key
  FROM documents),
sized AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sized),
weighed AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM ranked),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(source_size * 2) OVER filling, 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER filling, 0)) AS level
  FROM weighed
  WINDOW filling AS (ORDER BY (source_size * 2)::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, rank, source_size, least((source_size * 2)::DOUBLE, max(level) OVER () * weight) AS target FROM levels),
queued AS (
  SELECT d.doc_id, d.size, d.key, t.rank, t.source_size, t.target,
         row_number() OVER (ORDER BY d.doc_id, d.key, d.size) AS row_id,
         sum(d.size) OVER (PARTITION BY t.rank ORDER BY d.key, d.size ROWS UNBOUNDED PRECEDING) AS cum
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
offers AS (
  SELECT row_id, size, key, rank, epoch, (cum + source_size * (epoch - 1))::DOUBLE / target AS finish,
         (cum - size + source_size * (epoch - 1))::DOUBLE / target AS began
  FROM queued, (VALUES (1), (2)) e(epoch) WHERE size > 0),
summed AS (
  SELECT *, sum(size) OVER (ORDER BY finish, rank, epoch, key, size ROWS UNBOUNDED PRECEDING) AS total FROM offers
  WHERE finish <= 1 OR began < 1),
times AS (
  SELECT row_id, count(*) AS n FROM summed
  WHERE finish <= 1 OR total <= (SELECT sum(size) * 1.5::DOUBLE FROM docs) GROUP BY row_id)
SELECT doc_id, size, source_size, target, size * coalesce(n, 0)::BIGINT AS taken FROM queued LEFT JOIN times USING (row_id)
"""

#: CRC-32 by bytes: c of the rows (id, s) of a table `hashed`.
CRC = r"""
bits AS (SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
crc AS (
  SELECT id, s, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(s))), lambda i: ('0x' || substr(hex(encode(s)), (2 * i + 1)::INTEGER, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
  FROM hashed, bits)"""

#: Near words by their spellings without one character, where the operator scans dictionaries.
VARIANTS = rf"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
each AS MATERIALIZED (SELECT doc_id, run, count(*) AS k FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (SELECT DISTINCT run AS id, coalesce(doc_id::VARCHAR, 'null') || ':' || run AS s FROM each),
{CRC.strip()},
lost AS (SELECT *, h % length(id) AS i FROM crc),
spelt AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, i) || substr(run, i + 2) ELSE run END AS word, k
  FROM each JOIN lost ON id = run AND s = coalesce(doc_id::VARCHAR, 'null') || ':' || run),
words AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM spelt WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
places AS (SELECT word, unnest(range(length(word))) AS i FROM words),
without AS MATERIALIZED (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS d FROM places),
pairs AS MATERIALIZED (
  SELECT a.word AS a, b.word AS b FROM without a JOIN without b ON a.i = b.i AND a.d = b.d AND a.word <> b.word
  UNION SELECT a.word, w.word FROM without a JOIN words w ON w.word = a.d
  UNION SELECT w.word, a.word FROM without a JOIN words w ON w.word = a.d),
best AS (SELECT p.a AS word, count(*) AS n_near, min({{'n': -w.n, 'w': w.word}}) AS m FROM pairs p JOIN words w ON w.word = p.b GROUP BY p.a),
found AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -m.n >= 10 * w.n THEN m.w END AS form, CASE WHEN -m.n >= 10 * w.n THEN -m.n END AS form_n
  FROM words w LEFT JOIN best USING (word)),
steps AS (SELECT word, word AS root, form AS next FROM found UNION ALL SELECT s.word, f.word, f.form FROM steps s JOIN found f ON f.word = s.next)
SELECT f.word, f.form, s.root, f.n, f.n_near, f.form_n::BIGINT AS form_n FROM found f JOIN steps s ON s.word = f.word AND s.next IS NULL
"""

#: Runs as stretches of equal words one period apart.
RUNS = rf"""
WITH hashed AS (SELECT DISTINCT doc_id AS id, doc_id::VARCHAR AS s FROM documents WHERE doc_id IS NOT NULL),
{CRC.strip()},
docs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce(h, 1) AS h, coalesce(h, 1) // 10 AS g, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, len(w) AS n
  FROM documents LEFT JOIN crc ON id = doc_id),
planted AS MATERIALIZED (
  SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n ELSE n END AS a, CASE WHEN h % 10 = 0 AND n > 0 THEN 1 + (n - g % n) // (3 + g % 8) ELSE 1 END AS p FROM docs),
places AS (SELECT r, a, p, w, unnest(range(n)) AS i FROM planted),
words AS MATERIALIZED (SELECT r, i, w[CASE WHEN i >= a THEN a + (i - a) % p ELSE i END + 1] AS word FROM places),
equal AS (SELECT x.r, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.r = y.r AND x.word = y.word AND x.i < y.i),
islands AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS b FROM equal),
stretches AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY r, q, b),
runs AS MATERIALIZED (SELECT r, start, length, min(q) AS period FROM stretches WHERE length >= greatest(12, 2 * q) GROUP BY r, start, length),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (r, i) GROUP BY r),
listed AS (
  SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t,
         min({{'l': -length, 's': start, 'p': period}}) AS best
  FROM runs GROUP BY r)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, (-best.l)::BIGINT AS length, best.p::BIGINT AS period,
       (1000 * -best.l // best.p)::BIGINT AS exponent_milli, sha256(coalesce(listed.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM docs d LEFT JOIN listed USING (r) LEFT JOIN kept USING (r)
"""

COPIES = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
