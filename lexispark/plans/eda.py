"""Queries for corpus statistics, joins, sorts and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexispark.functions import text as tx
from lexispark.operators import features
from lexispark.plans.base import CORPUS, META, TOKENS, counts_sql, query, vocab_sql
from lexispark.session import cut, spread
from lexispark.sources import corpus as src


def meta(s: SparkSession, d: str) -> DataFrame:
    return src.corpus(s, d).withColumn("word_count", tx.word_count(F.col("text")))


@query("a01_a05_totals", f"WITH {META} SELECT count(*) AS texts, sum(word_count)::BIGINT AS words, count(DISTINCT author) AS authors, count(DISTINCT (author, title)) AS works, min(year) AS first_year, max(year) AS last_year, round(avg(word_count), 6) AS mean, median(word_count)::DOUBLE AS median FROM meta")
def totals(s: SparkSession, d: str) -> DataFrame:
    w = F.col("word_count")
    return meta(s, d).agg(F.count(F.lit(1)).alias("texts"), F.sum(w).alias("words"), F.countDistinct("author").alias("authors"), F.count_distinct(F.struct("author", "title")).alias("works"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.round(F.avg(w), 6).alias("mean"), F.median(w).alias("median"))


@query("a06_by_author", f"WITH {META} SELECT author, sum(word_count)::BIGINT AS total_words, count(*) AS num_texts FROM meta GROUP BY author ORDER BY total_words DESC, author")
def by_author(s: SparkSession, d: str) -> DataFrame:
    return meta(s, d).groupBy("author").agg(F.sum("word_count").alias("total_words"), F.count(F.lit(1)).alias("num_texts")).orderBy(F.desc("total_words"), "author")


@query("a07_share", f"WITH {META}, g AS (SELECT author, sum(word_count)::BIGINT AS words FROM meta GROUP BY author) SELECT author, words, round_even(words * 100.0::DOUBLE / sum(words) OVER (), 1) AS pct FROM g")
def share(s: SparkSession, d: str) -> DataFrame:
    g = meta(s, d).groupBy("author").agg(F.sum("word_count").alias("words"))
    return g.withColumn("pct", F.bround(F.col("words") * 100.0 / F.sum("words").over(Window.partitionBy()), 1))


@query("a08_works", f"WITH {META} SELECT author, title, year, sum(word_count)::BIGINT AS words FROM meta GROUP BY author, title, year")
def works(s: SparkSession, d: str) -> DataFrame:
    return meta(s, d).groupBy("author", "title", "year").agg(F.sum("word_count").alias("words"))


@query("a09_summary", f"WITH {META} SELECT author, count(*) AS texts, sum(word_count)::BIGINT AS total, round(avg(word_count), 6) AS mean, min(word_count) AS least, max(word_count) AS most, min(year) AS first_year, max(year) AS last_year FROM meta GROUP BY author ORDER BY total DESC, author")
def summary(s: SparkSession, d: str) -> DataFrame:
    w = F.col("word_count")
    g = meta(s, d).groupBy("author").agg(F.count(F.lit(1)).alias("texts"), F.sum(w).alias("total"), F.round(F.avg(w), 6).alias("mean"), F.min(w).alias("least"), F.max(w).alias("most"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    return g.orderBy(F.desc("total"), "author")


_WC = f"{CORPUS}, {counts_sql('corpus')}"


@query("a10_word_frequency", f"WITH {_WC} SELECT word, sum(cnt)::BIGINT AS cnt FROM wc GROUP BY word")
def word_frequency(s: SparkSession, d: str) -> DataFrame:
    return features.word_counts(src.corpus(s, d)).groupBy("word").agg(F.sum("cnt").alias("cnt"))


@query("a11_document_words", f"WITH {_WC} SELECT doc_ord, word, cnt FROM wc")
def document_words(s: SparkSession, d: str) -> DataFrame:
    return features.word_counts(src.corpus(s, d)).select("doc_ord", "word", "cnt")


@query("k01_top_mfw", f"WITH {_WC}, {vocab_sql('wc', 100)} SELECT rank, word, cnt FROM vocab")
def top_mfw(s: SparkSession, d: str) -> DataFrame:
    return features.vocabulary(features.word_counts(src.corpus(s, d)), 100).withColumn("rank", F.col("rank").cast("long"))


@query(
    "a12_relative_frequency",
    f"WITH {_WC}, {vocab_sql('wc', 50)} SELECT t.doc_ord, v.word, round(CASE WHEN len(t.t) > 0 THEN coalesce(wc.cnt, 0) * 1000.0::DOUBLE / len(t.t) ELSE 0 END, 6) AS freq FROM tok t CROSS JOIN vocab v LEFT JOIN wc ON wc.doc_ord = t.doc_ord AND wc.word = v.word",
)
def relative_frequency(s: SparkSession, d: str) -> DataFrame:
    docs = src.corpus(s, d)
    vocab = cut(features.vocabulary(features.word_counts(docs), 50))
    f = features.frequencies(docs.select("doc_ord", "text"), vocab).select("doc_ord", F.posexplode("freq").alias("i", "freq"))
    words = F.broadcast(vocab.select((F.col("rank") - 1).alias("i"), "word"))  # 50 rows
    return f.join(words, "i").select("doc_ord", "word", F.round("freq", 6).alias("freq"))


@query("a13_histogram", f"WITH {META}, r AS (SELECT min(word_count) AS lo, max(word_count) AS hi FROM meta) SELECT least(floor((word_count - lo) * 20::DOUBLE / (hi - lo)) + 1, 20)::BIGINT AS bin, count(*) AS n FROM meta, r GROUP BY 1")
def histogram(s: SparkSession, d: str) -> DataFrame:
    """20 bins of equal width, the last one with its right edge."""
    m = meta(s, d).select("word_count")
    r = m.agg(F.min("word_count").cast("double").alias("lo"), F.max("word_count").cast("double").alias("hi"))
    b = F.least(F.width_bucket(F.col("word_count").cast("double"), F.col("lo"), F.col("hi"), F.lit(20)), F.lit(20).cast("long"))
    return m.join(F.broadcast(r), F.lit(True)).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("a14_box_plot", f"""WITH {META}, q AS (SELECT author, quantile_cont(word_count::DOUBLE, 0.25) AS q1, quantile_cont(word_count::DOUBLE, 0.5) AS q2, quantile_cont(word_count::DOUBLE, 0.75) AS q3 FROM meta GROUP BY author)
SELECT author, q1, q2, q3, min(word_count) FILTER (WHERE word_count >= q1 - 1.5::DOUBLE * (q3 - q1)) AS low, max(word_count) FILTER (WHERE word_count <= q3 + 1.5::DOUBLE * (q3 - q1)) AS high,
  count(*) FILTER (WHERE word_count < q1 - 1.5::DOUBLE * (q3 - q1) OR word_count > q3 + 1.5::DOUBLE * (q3 - q1)) AS beyond FROM meta JOIN q USING (author) GROUP BY author, q1, q2, q3""")
def box_plot(s: SparkSession, d: str) -> DataFrame:
    """Quartiles, whiskers (the last values within one and a half box lengths) and how many values lie beyond."""
    m = cut(meta(s, d).select("author", "word_count"))
    q = m.groupBy("author").agg(F.percentile("word_count", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    q = q.select("author", *(F.col("q")[i].alias(f"q{i + 1}") for i in range(3)))
    reach, w = (F.col("q3") - F.col("q1")) * 1.5, F.col("word_count")
    within = (w >= F.col("q1") - reach) & (w <= F.col("q3") + reach)
    g = m.join(q, "author").groupBy("author", "q1", "q2", "q3")
    return g.agg(F.min(F.when(w >= F.col("q1") - reach, w)).alias("low"), F.max(F.when(w <= F.col("q3") + reach, w)).alias("high"), F.count(F.when(~within, 1)).alias("beyond"))


@query("p01_p03_k05_subset", f"WITH {META} SELECT title, year, word_count AS words FROM meta WHERE author = 'fr' ORDER BY year, doc_ord")
def subset(s: SparkSession, d: str) -> DataFrame:
    return meta(s, d).where("author = 'fr'").orderBy("year", "doc_ord").select("title", "year", F.col("word_count").alias("words"))


@query("p05_least_tokens", f"WITH {META} SELECT doc_ord, word_count FROM meta WHERE word_count >= 64")
def least_tokens(s: SparkSession, d: str) -> DataFrame:
    return meta(s, d).where("word_count >= 64").select("doc_ord", "word_count")


@query("k04_sorted_works", f"WITH {CORPUS} SELECT DISTINCT author, title FROM corpus ORDER BY author, title")
def sorted_works(s: SparkSession, d: str) -> DataFrame:
    return src.corpus(s, d).select("author", "title").distinct().orderBy("author", "title")


@query("k06_first_row", f"WITH {META} SELECT author, doc_ord, title, word_count FROM meta QUALIFY row_number() OVER (PARTITION BY author ORDER BY doc_ord) = 1")
def first_row(s: SparkSession, d: str) -> DataFrame:
    """The first document of each author, by a minimum that is combined before the shuffle."""
    first = meta(s, d).groupBy("author").agg(F.min(F.struct("doc_ord", "title", "word_count")).alias("r"))
    return first.select("author", "r.doc_ord", "r.title", "r.word_count")


@query("k10_head", f"WITH {META} SELECT doc_ord, author, title, year, word_count FROM meta ORDER BY doc_ord LIMIT 5")
def head(s: SparkSession, d: str) -> DataFrame:
    return meta(s, d).select("doc_ord", "author", "title", "year", "word_count").orderBy("doc_ord").limit(5)


def _works_and_files(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All documents as works, and the texts of all but the last one as the files that are there."""
    docs = spread(s.read.parquet(f"{d}/documents.parquet"))
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_path")
    last = docs.agg(F.max("doc_id")).first()[0]
    return docs.select("doc_id", F.col("lang").alias("author"), path), docs.where(F.col("doc_id") < last).select(path, "text")


_LISTED = "works AS (SELECT doc_id, lang AS author, source || '/' || doc_id || '.txt' AS file_path FROM documents), files AS (SELECT source || '/' || doc_id || '.txt' AS file_path, text FROM documents WHERE doc_id < (SELECT max(doc_id) FROM documents))"


@query("s16_j02_present", f"WITH {_LISTED} SELECT file_path, doc_id, author FROM works SEMI JOIN files USING (file_path)")
def present(s: SparkSession, d: str) -> DataFrame:
    return src.present(*_works_and_files(s, d)).select("file_path", "doc_id", "author")


_LABELLED = "works AS (SELECT doc_id, lang AS author, source || '/' || doc_id || '.txt' AS file_path FROM documents), files AS (SELECT source || '/' || doc_id || '.txt' AS file_path, text FROM documents SEMI JOIN labels USING (doc_id))"


@query("p04_missing", f"WITH {_LABELLED} SELECT file_path, doc_id, author FROM works ANTI JOIN files USING (file_path)")
def missing(s: SparkSession, d: str) -> DataFrame:
    """Works whose file isn't there; the files are those of the documents with labels."""
    docs = spread(s.read.parquet(f"{d}/documents.parquet"))
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_path")
    files = docs.join(s.read.parquet(f"{d}/labels.parquet").select("doc_id"), "doc_id", "left_semi").select(path)
    works = docs.select("doc_id", F.col("lang").alias("author"), path)
    return src.missing(works, files).select("file_path", "doc_id", "author")


@query("s06_metadata", f"WITH {_LISTED} SELECT file_path, doc_id, author, len(regexp_extract_all(text, '\\S+'))::INTEGER AS word_count FROM works JOIN files USING (file_path)")
def metadata(s: SparkSession, d: str) -> DataFrame:
    return src.metadata_of(*_works_and_files(s, d)).select("file_path", "doc_id", "author", "word_count")


@query("set_union", "SELECT lang AS label FROM documents UNION SELECT source FROM documents")
def union(s: SparkSession, d: str) -> DataFrame:
    """Union of two label sets."""
    docs = spread(s.read.parquet(f"{d}/documents.parquet"))
    return docs.select(F.col("lang").alias("label")).union(docs.select("source")).distinct()


_FUNCTION_WORDS = ("the", "of", "and", "to", "in", "a", "that", "it", "is", "was")
_STYLE = r"""WITH t AS (SELECT doc_id, text, len(regexp_extract_all(text, '\S+')) AS w, {tokens} AS k FROM documents)
SELECT doc_id, round(len(regexp_extract_all(text, '[.!?]')) * 1000.0::DOUBLE / w, 6) AS stops, round(len(regexp_extract_all(text, ',')) * 1000.0::DOUBLE / w, 6) AS commas, round(w::DOUBLE / greatest(1, len(regexp_extract_all(text, '[.!?]+'))), 6) AS sentence, {words} FROM t WHERE w > 0"""


@query("x03_style", _STYLE.format(tokens=TOKENS.format(t="text"), words=", ".join(f"round(len(list_filter(k, lambda x: x = '{w}')) * 1000.0::DOUBLE / w, 6) AS word_{w}" for w in _FUNCTION_WORDS)))
def style(s: SparkSession, d: str) -> DataFrame:
    """Punctuation and function words per 1,000 words, and mean words in a sentence."""
    c = lambda p: F.regexp_count("text", F.lit(p))
    t = spread(s.read.parquet(f"{d}/documents.parquet")).withColumn("w", c(r"\S+")).where("w > 0").withColumn("k", tx.letter_tokens(F.col("text")))
    words = lambda w: F.size(F.filter("k", lambda x: x == F.lit(w)))
    share = [F.round(words(w) * 1000.0 / F.col("w"), 6).alias(f"word_{w}") for w in _FUNCTION_WORDS]
    return t.select("doc_id", F.round(c("[.!?]") * 1000.0 / F.col("w"), 6).alias("stops"), F.round(c(",") * 1000.0 / F.col("w"), 6).alias("commas"), F.round(F.col("w").cast("double") / F.greatest(F.lit(1), c("[.!?]+")), 6).alias("sentence"), *share)
