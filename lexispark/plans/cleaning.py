"""Queries for cleaning, tokens and text scalars. Documents are wrapped in the same noise in both engines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexispark.functions import text as tx
from lexispark.plans.base import META, SPACE, TOKENS, WORDS, query
from lexispark.session import spread
from lexispark.sources.corpus import corpus

_HEAD = "\ufeffFront matter\r\n*** Start of the Project Gutenberg eBook {} ***\r\n 12 \n12\n13\nXIV\nMCM\n"
_TAIL = "\n\n\n\n7\n_it_ `was`  \t done´ \r\n*** END OF THE PROJECT GUTENBERG EBOOK {} ***\nLicense text"
_HEAD2 = "Front matter\n*** START OF THE PROJECT {} *** more\n"
_TAIL2 = "\n\x0b end \u00a0\n*** END OF THE PROJECT {} ***\nLicense text"


def _literal(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _noise(head: str = _HEAD, tail: str = _TAIL) -> Column:
    """The text in noise that names its source."""
    (h1, h2), (t1, t2) = head.split("{}"), tail.split("{}")
    return F.concat(F.lit(h1), "source", F.lit(h2), "text", F.lit(t1), "source", F.lit(t2))


def _noise_sql(head: str = _HEAD, tail: str = _TAIL) -> str:
    (h1, h2), (t1, t2) = head.split("{}"), tail.split("{}")
    return f"{_literal(h1)} || source || {_literal(h2)} || text || {_literal(t1)} || source || {_literal(t2)}"


NOISE_SQL, NOISE2_SQL = _noise_sql(), _noise_sql(_HEAD2, _TAIL2)


def _start(t: str) -> str:
    hits = [f"regexp_extract({t}, '(?i){p}')" for p in tx.START_PATTERNS]
    return "CASE " + " ".join(f"WHEN {h} <> '' THEN strpos({t}, {h}) - 1 + length({h})" for h in hits) + " ELSE 0 END"


def _end(t: str) -> str:
    hits = [f"regexp_extract({t}, '(?i){p}')" for p in tx.END_PATTERNS]
    return "CASE " + " ".join(f"WHEN {h} <> '' THEN strpos({t}, {h}) - 1" for h in hits) + f" ELSE length({t}) END"


def _trim(t: str) -> str:
    return rf"regexp_replace(regexp_replace({t}, '\A[{SPACE}]+', ''), '[{SPACE}]+\z', '')"


def _strip(t: str) -> str:
    return _trim(f"substring({t}, ({_start(t)}) + 1, greatest(({_end(t)}) - ({_start(t)}), 0))")


def _replace(pattern: str, new: str) -> Callable[[str], str]:
    return lambda t: f"regexp_replace({t}, '{pattern}', {new}, 'g')"


_STEPS: dict[str, tuple[Callable[[Column], Column], Callable[[str], str]]] = {
    "c01_strip_markers": (tx.strip_boilerplate, _strip),
    "c03_quotes": (tx.normalize_quotes, lambda t: f"translate({t}, '`´', '''''')"),
    "c04_line_feeds": (tx.line_feeds, _replace(r"\r\n?", "chr(10)")),
    "c05_blanks": (tx.collapse_blanks, _replace(r"[ \t]+", "' '")),
    "c06_line_ends": (tx.strip_line_ends, _replace(r" +\n", "chr(10)")),
    "c07_empty_lines": (tx.collapse_line_feeds, _replace(r"\n{3,}", "chr(10) || chr(10)")),
    "c08_trim": (tx.trim_unicode, _trim),
    "c09_digit_lines": (tx.drop_digit_lines, _replace(r"\n\p{Nd}+\n", "chr(10)")),
    "c10_roman_lines": (tx.drop_roman_lines, _replace(r"\n[IVXLCDM]+\n", "chr(10)")),
    "c11_underscores": (tx.drop_underscores, lambda t: f"replace({t}, '_', '')"),
    "c13_collapse": (tx.collapse_space, lambda t: f"trim(regexp_replace({t}, '[{SPACE}]+', ' ', 'g'))"),
    "s02_byte_order_mark": (tx.strip_bom, lambda t: f"regexp_replace({t}, '\\A\ufeff', '')"),
}
_ORDER = ("c01_strip_markers", "c03_quotes", "c09_digit_lines", "c10_roman_lines", "c11_underscores", "c04_line_feeds", "c05_blanks", "c06_line_ends", "c07_empty_lines", "c08_trim")


def _chain_sql() -> str:
    steps = ["s0 AS (SELECT doc_id, source, " + NOISE_SQL + " AS t FROM documents)"]
    for n, k in enumerate(_ORDER):
        steps.append(f"s{n + 1} AS (SELECT doc_id, source, {_STEPS[k][1]('t')} AS t FROM s{n})")
    return ", ".join(steps)


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(spark.read.parquet(f"{d}/documents.parquet"))


def _digest(t: Column) -> list[Column]:
    return [F.col("doc_id"), F.md5(t.cast("binary")).alias("digest"), F.length(t).cast("long").alias("n")]


def _register(name: str, step: Callable[[Column], Column], sql: Callable[[str], str]) -> None:
    query(name, f"SELECT doc_id, md5(o) AS digest, length(o)::BIGINT AS n FROM (SELECT doc_id, {sql('t')} AS o FROM (SELECT doc_id, {NOISE_SQL} AS t FROM documents))")(
        lambda s, d: _docs(s, d).select("doc_id", _noise().alias("t")).select(*_digest(step(F.col("t"))))
    )


for _name, (_f, _sql) in _STEPS.items():
    _register(_name, _f, _sql)


@query(
    "c02_literal_markers",
    f"""WITH n AS (SELECT doc_id, {NOISE2_SQL} AS t FROM documents),
    a AS (SELECT doc_id, CASE WHEN strpos(t, '*** START OF') > 0 THEN substring(t, strpos(t, '*** START OF')) ELSE t END AS t FROM n),
    b AS (SELECT doc_id, substring(t, strpos(t, chr(10)) + 1) AS t FROM a),
    c AS (SELECT doc_id, CASE WHEN strpos(t, '*** END OF') > 0 THEN substring(t, 1, strpos(t, '*** END OF') - 1) ELSE t END AS t FROM b)
    SELECT doc_id, md5(t) AS digest, length(t)::BIGINT AS n FROM c""",
)
def literal_markers(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", _noise(_HEAD2, _TAIL2).alias("t")).select(*_digest(tx.strip_literal_markers(F.col("t"))))


@query("c12_clean", f"WITH {_chain_sql()} SELECT doc_id, md5(t) AS digest, length(t)::BIGINT AS n FROM s{len(_ORDER)}")
def cleaned(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", _noise().alias("t")).select(*_digest(tx.clean(F.col("t"))))


_SIZES = f"sizes AS (SELECT s0.source, s0.doc_id, length(s0.t)::BIGINT AS before_chars, length(e.t)::BIGINT AS after_chars FROM s0 JOIN s{len(_ORDER)} e USING (doc_id))"


def _sizes(s: SparkSession, d: str) -> DataFrame:
    own = _docs(s, d).select("doc_id", _noise().alias("t"))
    return own.select("doc_id", F.length("t").cast("long").alias("before_chars"), F.length(tx.clean(F.col("t"))).cast("long").alias("after_chars"))


@query("c14_reduction", f"WITH {_chain_sql()}, {_SIZES} SELECT doc_id, before_chars, after_chars, round(CASE WHEN before_chars > 0 THEN (before_chars - after_chars) * 100.0::DOUBLE / before_chars ELSE 0 END, 6) AS pct FROM sizes")
def reduction(s: SparkSession, d: str) -> DataFrame:
    pct = F.coalesce(F.try_divide((F.col("before_chars") - F.col("after_chars")) * 100.0, F.col("before_chars")), F.lit(0.0))
    return _sizes(s, d).withColumn("pct", F.round(pct, 6))


@query("a21_total_reduction", f"WITH {_chain_sql()}, {_SIZES} SELECT count(*) AS texts, sum(before_chars)::BIGINT AS before_chars, sum(after_chars)::BIGINT AS after_chars FROM sizes")
def total_reduction(s: SparkSession, d: str) -> DataFrame:
    return _sizes(s, d).agg(F.count(F.lit(1)).alias("texts"), F.sum("before_chars").alias("before_chars"), F.sum("after_chars").alias("after_chars"))


@query("t01_tokens", f"WITH t AS (SELECT doc_id, {TOKENS.format(t='text')} AS t FROM documents) SELECT doc_id, len(t)::BIGINT AS n, md5(array_to_string(t, ' ')) AS digest FROM t")
def tokens(s: SparkSession, d: str) -> DataFrame:
    t = _docs(s, d).select("doc_id", tx.letter_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


@query("t02_word_count", f"SELECT doc_id, {WORDS} AS n FROM documents")
def words(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", tx.word_count(F.col("text")).alias("n"))


@query("t03_sample", f"SELECT doc_id, array_to_string(list_slice(regexp_extract_all(text, '[^{SPACE}]+'), 1, 150), ' ') AS sample FROM documents")
def samples(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", tx.sample(F.col("text"), 150).alias("sample"))


_SPACED = f"WITH t AS (SELECT doc_id, regexp_extract_all(text, '[^{SPACE}]+') AS t FROM documents)"


@query("t04_encode", f"{_SPACED} SELECT doc_id, unnest(range(len(t))) AS ix, unnest(t) AS token FROM t")
def encode(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", F.posexplode(tx.space_tokens(F.col("text"))).alias("ix", "token")).withColumn("ix", F.col("ix").cast("long"))


@query("t05_decode", f"{_SPACED} SELECT doc_id, md5(array_to_string(t, ' ')) AS digest FROM t")
def decode(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", F.md5(F.array_join(tx.space_tokens(F.col("text")), " ").cast("binary")).alias("digest"))


@query("t06_truncate", f"{_SPACED} SELECT doc_id, least(len(t), 512)::BIGINT AS n, (512 - least(len(t), 512))::BIGINT AS padding, md5(array_to_string(list_slice(t, 1, 512), ' ')) AS digest FROM t")
def truncate(s: SparkSession, d: str) -> DataFrame:
    """Model input: at most 512 tokens, and how much padding they need."""
    t = _docs(s, d).select("doc_id", F.slice(tx.space_tokens(F.col("text")), 1, 512).alias("t"))
    n = F.size("t").cast("long")
    return t.select("doc_id", n.alias("n"), (F.lit(512) - n).alias("padding"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


_ODD = rf"len(regexp_extract_all(t, '[^a-zA-Z0-9{SPACE}.,;:!?''\"\-]'))"


@query(
    "t07_t08_scalars",
    f"SELECT doc_id, contains(lower(t), 'gutenberg') AS marked, round({_ODD} / length(t)::DOUBLE, 9) AS ratio FROM (SELECT doc_id, {NOISE_SQL} AS t FROM documents)",
)
def scalars(s: SparkSession, d: str) -> DataFrame:
    t = F.col("t")
    return _docs(s, d).select("doc_id", _noise().alias("t")).select("doc_id", tx.has_marker(t).alias("marked"), F.round(tx.special_ratio(t), 9).alias("ratio"))


@query(
    "t09_t11_formats",
    rf"WITH {META} SELECT array_to_string(list_transform(regexp_extract_all(title || '''s ' || meta.author || '-x2y é', '\p{{L}}+|\P{{L}}+'), lambda w: upper(w[1]) || lower(w[2:])), '') AS label, upper(author) AS author, format('{{:,}}', sum(word_count)::BIGINT) AS total, format('{{:,}}', trunc(avg(word_count))::BIGINT) AS mean, printf('%.2f%%', count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY meta.author)) AS pct FROM meta GROUP BY title, meta.author",
)
def formats(s: SparkSession, d: str) -> DataFrame:
    g = _meta(s, d).groupBy("title", "author").agg(F.sum("word_count").alias("t"), F.avg("word_count").alias("m"), F.count(F.lit(1)).alias("n"))
    name, share = F.concat("title", F.lit("'s "), "author", F.lit("-x2y é")), F.col("n") / F.sum("n").over(Window.partitionBy("author"))
    return g.select(tx.title(name).alias("label"), F.upper("author").alias("author"), tx.thousands(F.col("t")).alias("total"), tx.thousands(F.col("m")).alias("mean"), tx.percent(share).alias("pct"))


def _meta(s: SparkSession, d: str) -> DataFrame:
    return corpus(s, d).withColumn("word_count", tx.word_count(F.col("text")))


_ISSUES = f"""issues AS (
  SELECT doc_id, unnest(list_filter([
    CASE WHEN contains(lower(t), 'gutenberg') THEN 'Contains Gutenberg text' END,
    CASE WHEN {_ODD} / length(t)::DOUBLE > 0.01::DOUBLE THEN 'High special char ratio: ' || printf('%.2f%%', {_ODD} / length(t)::DOUBLE * 100) END,
    CASE WHEN {WORDS.replace("text", "t")} < 20000 THEN 'Short text: ' || format('{{:,}}', {WORDS.replace("text", "t")}) || ' words' END], lambda x: x IS NOT NULL)) AS issue
  FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN {NOISE_SQL} ELSE text END AS t FROM documents))"""


def _issues(s: SparkSession, d: str) -> DataFrame:
    t = F.when(F.col("doc_id") % 3 == 0, _noise()).otherwise(F.col("text"))
    own = _docs(s, d).select("doc_id", t.alias("t"))
    found = own.select("doc_id", tx.has_marker(F.col("t")).alias("marked"), tx.special_ratio(F.col("t")).alias("share"), tx.word_count(F.col("t")).alias("count"))
    return found.select("doc_id", F.explode(tx.issues(F.col("marked"), F.col("share"), F.col("count"))).alias("issue"))


@query("p06_q1_issues", f"WITH {_ISSUES} SELECT * FROM issues")
def all_issues(s: SparkSession, d: str) -> DataFrame:
    return _issues(s, d)


@query("p07_issue_count", f"WITH {_ISSUES} SELECT split_part(issue, ':', 1) AS kind, count(*) AS n FROM issues GROUP BY 1")
def issue_count(s: SparkSession, d: str) -> DataFrame:
    return _issues(s, d).groupBy(F.substring_index("issue", ":", 1).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


