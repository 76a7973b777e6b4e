"""Queries for splits, labels, features, distances, chunks, scoring, metrics and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexispark.operators import chunks as ch
from lexispark.operators import features, metrics, ranking, scoring, splits
from lexispark.plans.base import CORPUS, SPACE, SPLIT, TOKENS, counts_sql, query, vocab_sql
from lexispark.plans.base import SQL as QUERIES_SQL
from lexispark.session import cut
from lexispark.sources.corpus import corpus


def split_docs(s: SparkSession, d: str) -> DataFrame:
    return splits.split_works(corpus(s, d))


# Splits and labels.


@query("sp1_split_works", f"WITH {SPLIT} SELECT author, title, split, count(*) AS docs FROM docs GROUP BY author, title, split")
def by_work(s: SparkSession, d: str) -> DataFrame:
    return split_docs(s, d).groupBy("author", "title", "split").agg(F.count(F.lit(1)).alias("docs"))


def _chunks_sql(source: str, size: int, stride: int, least: int, name: str = "chunks") -> str:
    """DuckDB CTEs: a loop-free form by generate_series, one row per window."""
    return rf"""{name}_tok AS (SELECT doc_ord, author, title, regexp_extract_all(text, '[^{SPACE}]+') AS t FROM {source}),
{name}_all AS (SELECT doc_ord, author, title, k * {stride} AS start_pos, t[k * {stride} + 1 : k * {stride} + {size}] AS tokens
  FROM {name}_tok, unnest(generate_series(0, greatest(0, ceil((len(t) - {size}) / {stride}::DOUBLE)::BIGINT))) g(k)),
{name} AS (SELECT doc_ord, author, title, (row_number() OVER (PARTITION BY doc_ord ORDER BY start_pos) - 1)::INTEGER AS chunk_ix, start_pos, len(tokens)::INTEGER AS n_tokens, tokens
  FROM {name}_all WHERE len(tokens) >= {least})"""


def _chunked(s: SparkSession, d: str, size: int, stride: int, least: int) -> DataFrame:
    return ch.chunk(corpus(s, d), size, stride, least)


_THREE = f"""WITH {CORPUS}, {_chunks_sql("corpus", 128, 64, 16)},
keyed AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY md5('42:' || doc_ord || '|' || chunk_ix), doc_ord, chunk_ix) AS rk, count(*) OVER (PARTITION BY author) AS n FROM chunks),
cut AS (SELECT *, CASE WHEN rk <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN rk <= floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM keyed)"""


def _three(s: SparkSession, d: str) -> DataFrame:
    c = ch.spans(corpus(s, d), 128, 64, 16).select("doc_ord", "author", "chunk_ix")
    return splits.split_three(c.withColumn("key", ranking.md5_key(42, F.col("doc_ord"), F.col("chunk_ix"))), "key", "doc_ord", "chunk_ix")


@query("sp2_split_chunks", f"{_THREE} SELECT doc_ord, chunk_ix, author, split FROM cut")
def by_chunk(s: SparkSession, d: str) -> DataFrame:
    return _three(s, d).select("doc_ord", "chunk_ix", "author", "split")


@query("a20_class_distribution", f"{_THREE} SELECT split, author, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY split), 6) AS pct FROM cut GROUP BY split, author")
def class_distribution(s: SparkSession, d: str) -> DataFrame:
    g = _three(s, d).groupBy("split", "author").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("split")), 6))


@query("d2_overlap_leaks", f"{_THREE} SELECT a.split AS split, b.split AS next_split, count(*) AS n FROM cut a JOIN cut b ON a.doc_ord = b.doc_ord AND b.chunk_ix = a.chunk_ix + 1 WHERE a.split <> b.split GROUP BY a.split, b.split")
def overlap_leaks(s: SparkSession, d: str) -> DataFrame:
    """Neighbouring windows, which share half of their tokens, that fell into different splits."""
    after = F.lead("split").over(Window.partitionBy("doc_ord").orderBy("chunk_ix"))
    c = _three(s, d).withColumn("next_split", after).where("split <> next_split")
    return c.groupBy("split", "next_split").agg(F.count(F.lit(1)).alias("n"))


_LABELS = "label_ids AS (SELECT author, (row_number() OVER (ORDER BY author) - 1)::INTEGER AS label FROM (SELECT DISTINCT author FROM corpus))"


@query("l01_labels", f"WITH {CORPUS}, {_LABELS} SELECT * FROM label_ids")
def labels(s: SparkSession, d: str) -> DataFrame:
    return splits.label_ids(corpus(s, d))


@query("l02_j03_labelled_chunks", f"WITH {CORPUS}, {_LABELS}, {_chunks_sql('corpus', 512, 256, 64)} SELECT doc_ord, chunk_ix, label, author, title, md5(array_to_string(tokens, ' ')) AS digest FROM chunks JOIN label_ids USING (author)")
def labelled(s: SparkSession, d: str) -> DataFrame:
    c = _chunked(s, d, 512, 256, 64).select("doc_ord", "chunk_ix", "author", "title", F.md5(F.array_join("tokens", " ").cast("binary")).alias("digest"))
    # Labels are as few as authors; by a shuffle all windows of an author would meet in one task.
    return c.join(F.broadcast(splits.label_ids(corpus(s, d))), "author").select("doc_ord", "chunk_ix", "label", "author", "title", "digest")


# Windows.


def _windows(name: str, size: int, stride: int, least: int) -> None:
    sql = f"WITH {CORPUS}, {_chunks_sql('corpus', size, stride, least)} SELECT doc_ord, chunk_ix, start_pos, start_pos + n_tokens AS end_pos, n_tokens, md5(array_to_string(tokens, ' ')) AS digest FROM chunks"
    query(name, sql)(lambda s, d: _chunked(s, d, size, stride, least).select("doc_ord", "chunk_ix", "start_pos", (F.col("start_pos") + F.col("n_tokens")).alias("end_pos"), "n_tokens", F.md5(F.array_join("tokens", " ").cast("binary")).alias("digest")))


_windows("w01_windows", 512, 256, 64)
_windows("w02_windows_min100", 512, 256, 100)
_windows("w03_corpus_chunks", 128, 64, 16)

_SWEEP = f"WITH {CORPUS}, " + ", ".join(_chunks_sql("corpus", n, n // 2, 100, f"c{n}") for n in (512, 256, 128))


@query("w04_k07_sweep", _SWEEP + " " + " UNION ALL ".join(f"SELECT {n} AS size, author, count(*) AS chunks, sum(n_tokens)::BIGINT AS tokens FROM c{n} WHERE chunk_ix < 100 GROUP BY author" for n in (512, 256, 128)))
def sweep(s: SparkSession, d: str) -> DataFrame:
    """Chunks of three sizes, the first 100 of each document."""
    parts = [_chunked(s, d, n, n // 2, 100).where("chunk_ix < 100").groupBy("author").agg(F.count(F.lit(1)).alias("chunks"), F.sum("n_tokens").alias("tokens")).select(F.lit(n).alias("size"), "*") for n in (512, 256, 128)]
    return parts[0].union(parts[1]).union(parts[2])


# Word-frequency distances.

_TRAIN = f"""{SPLIT}, {counts_sql("docs")},
train_wc AS (SELECT wc.* FROM wc JOIN docs USING (doc_ord) WHERE split = 'train'),
{vocab_sql("train_wc", 100)},
fx AS MATERIALIZED (SELECT t.doc_ord, v.rank, CASE WHEN len(t.t) > 0 THEN coalesce(wc.cnt, 0) * 1000.0::DOUBLE / len(t.t) ELSE 0 END AS freq
  FROM tok t CROSS JOIN vocab v LEFT JOIN wc ON wc.doc_ord = t.doc_ord AND wc.word = v.word),
stats AS MATERIALIZED (SELECT rank, avg(freq) AS mu, CASE WHEN stddev_pop(freq) = 0 THEN 1 ELSE stddev_pop(freq) END AS sd FROM fx JOIN docs USING (doc_ord) WHERE split = 'train' GROUP BY rank),
z AS MATERIALIZED (SELECT doc_ord, split, rank, (freq - mu) / sd AS z FROM fx JOIN stats USING (rank) JOIN docs USING (doc_ord)),
vec AS (SELECT doc_ord, split, list(z ORDER BY rank) AS v FROM z GROUP BY doc_ord, split)"""
_NEAR = f"""{_TRAIN},
dist AS (SELECT a.doc_ord, b.doc_ord AS neighbour, round(list_sum(list_transform(list_zip(a.v, b.v), lambda p: abs(p[1] - p[2]))) / len(a.v), 9) AS delta
  FROM vec a, vec b WHERE a.split = 'test' AND b.split = 'train'),
near AS (SELECT *, row_number() OVER (PARTITION BY doc_ord ORDER BY delta, neighbour) AS place FROM dist QUALIFY place <= 3),
rows_ AS (SELECT n.doc_ord, t.title, t.author AS truth, r.author AS pred, n.delta FROM near n JOIN docs t ON t.doc_ord = n.doc_ord JOIN docs r ON r.doc_ord = n.neighbour WHERE n.place = 1)"""


@query("f01_train_vocabulary", f"WITH {_TRAIN} SELECT rank, word, cnt FROM vocab")
def train_vocabulary(s: SparkSession, d: str) -> DataFrame:
    train = split_docs(s, d).where("split = 'train'")
    return features.vocabulary(features.word_counts(train), 100).withColumn("rank", F.col("rank").cast("long"))


def _freq(s: SparkSession, d: str) -> DataFrame:
    docs = split_docs(s, d)
    vocab = features.vocabulary(features.word_counts(docs.where("split = 'train'")), 100)
    return features.frequencies(docs.select("doc_ord", "split", "text"), vocab)


@query("f02_j06_test_features", f"WITH {_TRAIN} SELECT doc_ord, rank, round(freq, 6) AS freq FROM fx JOIN docs USING (doc_ord) WHERE split = 'test'")
def test_features(s: SparkSession, d: str) -> DataFrame:
    out = _freq(s, d).where("split = 'test'").select("doc_ord", F.posexplode("freq").alias("i", "freq"))
    return out.select("doc_ord", (F.col("i") + 1).cast("long").alias("rank"), F.round("freq", 6).alias("freq"))


@query("f03_scaler", f"WITH {_TRAIN} SELECT rank, round(mu, 6) AS mu, round(sd, 6) AS sd FROM stats")
def scaler(s: SparkSession, d: str) -> DataFrame:
    st = features.scaler(_freq(s, d).where("split = 'train'"))
    return st.select((F.col("i") + 1).cast("long").alias("rank"), F.round("mu", 6).alias("mu"), F.round("sd", 6).alias("sd"))


@query("f04_scores", f"WITH {_TRAIN} SELECT doc_ord, rank, round(z, 6) AS z FROM z WHERE split = 'test'")
def standard_scores(s: SparkSession, d: str) -> DataFrame:
    test, _, _ = features.delta_vectors(split_docs(s, d))
    return test.select("doc_ord", F.posexplode("z").alias("i", "z")).select("doc_ord", (F.col("i") + 1).cast("long").alias("rank"), F.round("z", 6).alias("z"))


def _near(s: SparkSession, d: str, k: int = 1) -> DataFrame:
    test, train, _ = features.delta_vectors(split_docs(s, d))
    return features.nearest(test, train, k)


@query("d01_x04_neighbours", f"WITH {_NEAR} SELECT doc_ord, place, neighbour, round(delta, 6) AS delta FROM near")
def neighbours(s: SparkSession, d: str) -> DataFrame:
    """The three nearest train documents of each test document."""
    return _near(s, d, 3).select("doc_ord", F.col("place").cast("long").alias("place"), "neighbour", F.round("delta", 6).alias("delta"))


def nearest_authors(s: SparkSession, d: str) -> DataFrame:
    docs = corpus(s, d).select("doc_ord", "author", "title")
    out = _near(s, d).join(docs.select("doc_ord", F.col("author").alias("truth"), "title"), "doc_ord")
    pred = docs.select(F.col("doc_ord").alias("neighbour"), F.col("author").alias("pred"))
    return out.join(pred, "neighbour").select("doc_ord", "title", "truth", "pred", F.round("delta", 6).alias("delta"))


@query("d03_k08_e05_predictions", f"WITH {_NEAR} SELECT doc_ord, title, truth, pred, round(delta, 6) AS delta FROM rows_")
def predictions(s: SparkSession, d: str) -> DataFrame:
    return nearest_authors(s, d)


@query("e01_delta_accuracy", f"WITH {_NEAR} SELECT count(*) AS total, sum((truth = pred)::INTEGER)::BIGINT AS correct, round(avg((truth = pred)::INTEGER), 6) AS accuracy, CASE WHEN avg((truth = pred)::INTEGER) > 0.8::DOUBLE THEN 'better' WHEN avg((truth = pred)::INTEGER) < 0.8::DOUBLE THEN 'worse' ELSE 'same' END AS verdict FROM rows_")
def delta_accuracy(s: SparkSession, d: str) -> DataFrame:
    a = metrics.accuracy(nearest_authors(s, d))
    return a.select("total", "correct", F.round("accuracy", 6).alias("accuracy"), metrics.against_baseline(F.col("accuracy")).alias("verdict"))


# Scoring of chunks: model on train works, chunks of 128 tokens of test works.

_SCORE = rf"""{SPLIT}, {counts_sql("docs")},
train_wc AS (SELECT wc.*, author FROM wc JOIN docs USING (doc_ord) WHERE split = 'train'),
{vocab_sql("train_wc", 200)},
authors AS (SELECT DISTINCT author FROM docs WHERE split = 'train'),
by_author AS (SELECT author, word, sum(train_wc.cnt) AS cnt FROM train_wc JOIN vocab USING (word) GROUP BY author, word),
grid AS (SELECT a.author, v.word, coalesce(b.cnt, 0) + 1 AS cnt FROM authors a CROSS JOIN vocab v LEFT JOIN by_author b ON b.author = a.author AND b.word = v.word),
model AS (SELECT author, word, ln(cnt / (sum(cnt) OVER (PARTITION BY author))::DOUBLE) AS logp FROM grid),
test_docs AS (SELECT * FROM docs WHERE split = 'test')"""


def _scored_sql(size: int, stride: int, least: int, first: int = 0) -> str:
    return rf"""{_SCORE}, {_chunks_sql("test_docs", size, stride, least, "every")},
chunks AS (SELECT * FROM every {f"WHERE chunk_ix < {first}" if first else ""}),
cw AS (SELECT doc_ord, chunk_ix, word, count(*) AS cnt FROM (SELECT doc_ord, chunk_ix, unnest({TOKENS.format(t="array_to_string(tokens, ' ')")}) AS word FROM chunks) GROUP BY doc_ord, chunk_ix, word),
hits AS (SELECT doc_ord, chunk_ix, author, sum(cnt * logp) / sum(cnt) AS logit FROM cw JOIN model USING (word) GROUP BY doc_ord, chunk_ix, author),
lg AS (SELECT c.doc_ord, c.chunk_ix, a.author AS author_pred, coalesce(h.logit, 0) AS logit FROM chunks c CROSS JOIN authors a LEFT JOIN hits h ON h.doc_ord = c.doc_ord AND h.chunk_ix = c.chunk_ix AND h.author = a.author),
ex AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY doc_ord, chunk_ix)) AS e FROM lg),
pr AS (SELECT *, e / sum(e) OVER (PARTITION BY doc_ord, chunk_ix) AS prob FROM ex),
best AS (SELECT doc_ord, chunk_ix, author_pred AS pred, prob AS confidence FROM pr QUALIFY row_number() OVER (PARTITION BY doc_ord, chunk_ix ORDER BY round(prob, 9) DESC, author_pred) = 1),
rows_ AS (SELECT b.*, t.author AS truth, t.title FROM best b JOIN test_docs t USING (doc_ord))"""


def _probs(s: SparkSession, d: str, size: int = 128, stride: int = 64, least: int = 16, first: int = 0) -> tuple[DataFrame, DataFrame]:
    """Probabilities of the windows of the works held out, with truth and title, and these works."""
    docs = split_docs(s, d)
    test = docs.where("split = 'test'").withColumn("truth", F.col("author"))
    model = cut(scoring.multinomial(docs.where("split = 'train'")))
    return scoring.probabilities(scoring.logits(test, model, size, stride, least, first, ("truth", "title"))), test


def _rows(s: SparkSession, d: str, *window: int) -> DataFrame:
    return scoring.predictions(_probs(s, d, *window)[0])


_S = _scored_sql(128, 64, 16)


@query("m01_model", f"WITH {_SCORE} SELECT author, word, round(logp, 6) AS logp FROM model")
def model(s: SparkSession, d: str) -> DataFrame:
    return scoring.multinomial(split_docs(s, d).where("split = 'train'")).select("author", "word", F.round("logp", 6).alias("logp"))


@query("m04_m06_probabilities", f"WITH {_S} SELECT doc_ord, chunk_ix, author_pred, round(prob, 6) AS prob FROM pr")
def probabilities(s: SparkSession, d: str) -> DataFrame:
    return scoring.probability_rows(_probs(s, d)[0]).select("doc_ord", "chunk_ix", "author_pred", F.round("prob", 6).alias("prob"))


@query("m05_k09_j04_predictions", f"WITH {_S}, label_ids AS (SELECT author AS pred, (row_number() OVER (ORDER BY author) - 1)::INTEGER AS label FROM authors) SELECT doc_ord, chunk_ix, pred, label, truth, round(confidence, 6) AS confidence FROM rows_ JOIN label_ids USING (pred)")
def chunk_predictions(s: SparkSession, d: str) -> DataFrame:
    ids = splits.label_ids(split_docs(s, d).where("split = 'train'")).withColumnRenamed("author", "pred")
    return _rows(s, d).join(ids, "pred").select("doc_ord", "chunk_ix", "pred", "label", "truth", F.round("confidence", 6).alias("confidence"))


_REPORT = """, labs AS (SELECT truth AS label FROM rows_ UNION SELECT pred FROM rows_),
rep AS (SELECT label, (SELECT count(*) FROM rows_ WHERE truth = label AND pred = label) AS tp, (SELECT count(*) FROM rows_ WHERE pred = label) AS g, (SELECT count(*) FROM rows_ WHERE truth = label) AS support FROM labs),
report AS (SELECT label, coalesce(tp::DOUBLE / nullif(g, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(support, 0), 0) AS recall, coalesce(2.0::DOUBLE * tp / nullif(g + support, 0), 0) AS f1, support FROM rep)"""


@query("e03_report", f"WITH {_S}{_REPORT} SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM report")
def report(s: SparkSession, d: str) -> DataFrame:
    r = metrics.report(_rows(s, d))
    return r.select("label", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")), "support")


@query(
    "e02_averages",
    f"""WITH {_S}{_REPORT} SELECT 'macro' AS kind, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1, sum(support)::BIGINT AS support FROM report
    UNION ALL SELECT 'weighted', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM report""",
)
def averages(s: SparkSession, d: str) -> DataFrame:
    return metrics.averages(_rows(s, d)).select("kind", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")), "support")


@query("e04_confusion", f"WITH {_S}{_REPORT} SELECT a.label AS truth, b.label AS pred, (SELECT count(*) FROM rows_ r WHERE r.truth = a.label AND r.pred = b.label) AS cnt FROM labs a, labs b")
def confusion(s: SparkSession, d: str) -> DataFrame:
    return metrics.confusion(_rows(s, d)).select("truth", "pred", "cnt")


@query("p08_correct", f"WITH {_S} SELECT doc_ord, chunk_ix, truth = pred AS correct FROM rows_")
def correct(s: SparkSession, d: str) -> DataFrame:
    return _rows(s, d).select("doc_ord", "chunk_ix", (F.col("truth") == F.col("pred")).alias("correct"))


@query("a15_k03_counts", f"WITH {_S} SELECT truth, title, pred, count(*) AS cnt, row_number() OVER (PARTITION BY truth, title ORDER BY count(*) DESC, min({{'d': doc_ord, 'c': chunk_ix}})) AS place FROM rows_ GROUP BY truth, title, pred")
def counts(s: SparkSession, d: str) -> DataFrame:
    return metrics.vote(_rows(s, d), ["truth", "title"], ["doc_ord", "chunk_ix"]).select("truth", "title", "pred", "cnt", F.col("place").cast("long").alias("place"))


@query("a19_k02_vote", f"WITH {_S} SELECT truth, title, pred, count(*) AS cnt, row_number() OVER (PARTITION BY truth, title ORDER BY count(*) DESC, min({{'d': doc_ord, 'c': chunk_ix}})) AS place, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY truth, title), 6) AS pct FROM rows_ GROUP BY truth, title, pred QUALIFY place <= 3")
def vote(s: SparkSession, d: str) -> DataFrame:
    v = metrics.vote(_rows(s, d), ["truth", "title"], ["doc_ord", "chunk_ix"]).where("place <= 3")
    return v.select("truth", "title", "pred", "cnt", F.col("place").cast("long").alias("place"), F.round("pct", 6).alias("pct"))


_ANALYSIS = "SELECT truth, title, count(*) AS total, sum((truth = pred)::INTEGER)::BIGINT AS correct, avg((truth = pred)::INTEGER) AS accuracy, avg(confidence) AS avg_confidence, coalesce(avg(confidence) FILTER (WHERE truth = pred), 0) AS avg_confidence_correct FROM rows_ GROUP BY truth, title"


@query("r01_a16_a18_analysis", f"WITH {_S}, an AS ({_ANALYSIS}) SELECT truth, title, total, correct, round(accuracy, 6) AS accuracy, round(avg_confidence, 6) AS avg_confidence, round(avg_confidence_correct, 6) AS avg_confidence_correct FROM an")
def analysis(s: SparkSession, d: str) -> DataFrame:
    a = metrics.analysis(_rows(s, d))
    return a.select("truth", "title", "total", "correct", *(F.round(c, 6).alias(c) for c in ("accuracy", "avg_confidence", "avg_confidence_correct")))


@query("r02_p09_attribution", f"WITH {_scored_sql(512, 256, 100)}, an AS ({_ANALYSIS}) SELECT truth, title, total, correct, round(accuracy, 6) AS accuracy, CASE WHEN accuracy > 0.8::DOUBLE THEN 'YES' WHEN accuracy > 0.5::DOUBLE THEN 'PARTIAL' ELSE 'NO' END AS verdict FROM an")
def attribution(s: SparkSession, d: str) -> DataFrame:
    """Works attributed by chunks of 512 tokens, with a verdict."""
    a = metrics.analysis(_rows(s, d, 512, 256, 100))
    return a.select("truth", "title", "total", "correct", F.round("accuracy", 6).alias("accuracy"), metrics.attribution_verdict(F.col("accuracy")).alias("verdict"))


_UNKNOWN = f"""WITH {_scored_sql(128, 64, 16, 50)},
top AS (SELECT title, pred, count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY title) AS pct FROM rows_ GROUP BY title, pred QUALIFY row_number() OVER (PARTITION BY title ORDER BY count(*) DESC, min({{'d': doc_ord, 'c': chunk_ix}})) = 1),
sure AS (SELECT title, avg(confidence) AS confidence FROM rows_ GROUP BY title)"""


@query("r03_p10_unknown", f"{_UNKNOWN} SELECT title, pred AS top_author, round(pct, 6) AS pct, round(confidence, 6) AS confidence, CASE WHEN confidence > 0.8::DOUBLE THEN 'WARN_CONF' WHEN pct > 80 THEN 'WARN_ONE' ELSE 'GOOD' END AS verdict FROM top JOIN sure USING (title)")
def unknown(s: SparkSession, d: str) -> DataFrame:
    """Works taken as of unknown authors: the first 50 chunks of each document."""
    top, sure = _unknown(s, d)
    out = top.join(sure, "title")
    return out.select("title", F.col("pred").alias("top_author"), F.round("pct", 6).alias("pct"), F.round("confidence", 6).alias("confidence"), metrics.unknown_verdict(F.col("confidence"), F.col("pct")).alias("verdict"))


def _unknown(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = _rows(s, d, 128, 64, 16, 50)
    return metrics.vote(rows, ["title"], ["doc_ord", "chunk_ix"]).where("place = 1"), rows.groupBy("title").agg(F.avg("confidence").alias("confidence"))


@query("r06_p11_summary", f"{_UNKNOWN} SELECT title, CASE WHEN confidence < 0.8::DOUBLE THEN 'ok' ELSE 'warn' END AS flag FROM sure")
def robustness_summary(s: SparkSession, d: str) -> DataFrame:
    return _unknown(s, d)[1].select("title", metrics.summary_flag(F.col("confidence")).alias("flag"))


@query("r04_p12_debut", f"WITH {_scored_sql(512, 256, 100)} SELECT title, count(*) AS total, round(avg((truth = pred)::INTEGER), 6) AS accuracy, round(avg(confidence), 6) AS confidence, CASE WHEN avg((truth = pred)::INTEGER) > 0.8::DOUBLE THEN 'YES' ELSE 'NO' END AS verdict FROM rows_ GROUP BY title")
def debut(s: SparkSession, d: str) -> DataFrame:
    a = F.avg((F.col("truth") == F.col("pred")).cast("double"))
    return _rows(s, d, 512, 256, 100).groupBy("title").agg(F.count(F.lit(1)).alias("total"), F.round(a, 6).alias("accuracy"), F.round(F.avg("confidence"), 6).alias("confidence"), metrics.debut_verdict(a).alias("verdict"))


def _degradation(size: int) -> None:
    """Accuracy on chunks of a size, the first 100 of each document."""
    sql = f"WITH {_scored_sql(size, size // 2, 100, 100)} SELECT {size} AS size, count(*) AS total, round(avg((truth = pred)::INTEGER), 6) AS accuracy, round(avg(confidence), 6) AS confidence FROM rows_"

    def run(s: SparkSession, d: str) -> DataFrame:
        a = F.avg((F.col("truth") == F.col("pred")).cast("double"))
        return _rows(s, d, size, size // 2, 100, 100).agg(F.lit(size).alias("size"), F.count(F.lit(1)).alias("total"), F.round(a, 6).alias("accuracy"), F.round(F.avg("confidence"), 6).alias("confidence"))

    query(f"r05_chunk_size_{size}", sql)(run)


for _size in (512, 256, 128):
    _degradation(_size)


@query(
    "x06_strategies",
    f"""WITH {_S}, p AS (SELECT pr.*, t.author AS truth, t.title FROM pr JOIN test_docs t USING (doc_ord)), b AS (SELECT doc_ord, chunk_ix, confidence FROM best)
    SELECT truth, title, author_pred, round(avg(prob), 6) AS mean_prob, round(sum(prob * confidence) / sum(confidence), 6) AS weighted_prob, count(*) FILTER (WHERE prob >= 0.7::DOUBLE) AS sure_chunks
    FROM p JOIN b USING (doc_ord, chunk_ix) GROUP BY truth, title, author_pred""",
)
def strategies(s: SparkSession, d: str) -> DataFrame:
    """Mean, confidence-weighted and threshold aggregates beside the vote."""
    p = _probs(s, d)[0].select("truth", "title", F.array_max("probs.prob").alias("confidence"), F.inline("probs"))
    return p.groupBy("truth", "title", "author_pred").agg(F.round(F.avg("prob"), 6).alias("mean_prob"), F.round(F.sum(F.col("prob") * F.col("confidence")) / F.sum("confidence"), 6).alias("weighted_prob"), F.count(F.when(F.col("prob") >= 0.7, 1)).alias("sure_chunks"))


@query("x09_calibration", f"WITH {_S} SELECT least(floor(round(confidence, 9) * 10), 9)::BIGINT AS bucket, count(*) AS n, round(avg((truth = pred)::INTEGER), 6) AS accuracy, round(avg(confidence), 6) AS confidence FROM rows_ GROUP BY 1")
def calibration(s: SparkSession, d: str) -> DataFrame:
    b = F.least(F.floor(F.round("confidence", 9) * 10), F.lit(9).cast("long")).alias("bucket")
    return _rows(s, d).groupBy(b).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("truth") == F.col("pred")).cast("double")), 6).alias("accuracy"), F.round(F.avg("confidence"), 6).alias("confidence"))


