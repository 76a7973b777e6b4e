"""Queries for the trained classifier and for windows of subwords."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.functions import subwords
from lexispark.operators import chunks as ch
from lexispark.operators import classifier, explanations
from lexispark.plans.attribution import _chunks_sql, split_docs
from lexispark.plans.base import SPLIT, query
from lexispark.session import cut
from lexispark.sources.corpus import corpus

#: Windows that are trained on, and the file of the pieces; both are parameters.
WINDOW = (128, 64, 16)
PIECES = "word_bpe_49k.json"


def training_rows(s: SparkSession, d: str) -> DataFrame:
    """Windows (doc_ord, chunk_ix, author, title, split, tokens): works held out are test, an eighth of the other documents is validation."""
    docs = split_docs(s, d)
    held = F.md5(F.concat(F.lit("validation:"), F.col("doc_ord").cast("string")).cast("binary")) < "2"
    split = F.when((F.col("split") == "train") & held, "validation").otherwise(F.col("split"))
    return ch.chunk(docs.withColumn("split", split).select("doc_ord", "author", "title", "split", "text"), *WINDOW).select("doc_ord", "chunk_ix", "author", "title", "split", "tokens")


@query("m01_m03_training")
def training(s: SparkSession, d: str) -> DataFrame:
    """What each epoch of a training run gives: losses, accuracy, F1, rows, seconds."""
    history = classifier.train(training_rows(s, d), ["doc_ord", "chunk_ix"]).report(s)
    return history.withColumn("samples_per_second", F.col("samples") / F.col("seconds"))


@query("m02_trained_predictions")
def trained_predictions(s: SparkSession, d: str) -> DataFrame:
    """The trained model's predictions for the windows of works held out."""
    rows = cut(training_rows(s, d))
    model = classifier.train(rows, ["doc_ord", "chunk_ix"])
    out = model.scored(rows.where("split = 'test'").drop("split"))
    return out.select("doc_ord", "chunk_ix", F.col("author").alias("truth"), "title", "pred", F.round("confidence", 6).alias("confidence"))


@query("x12_explanations")
def explained(s: SparkSession, d: str) -> DataFrame:
    """The five words that count most for each prediction of the trained model on works held out: Shapley values."""
    rows = cut(training_rows(s, d))
    model = classifier.train(rows, ["doc_ord", "chunk_ix"])
    out = explanations.explained(model, rows.where("split = 'test'"), ["doc_ord", "chunk_ix"])
    return out.select("doc_ord", "chunk_ix", "pred", "word", *(F.round(c, 6).alias(c) for c in ("value", "spread", "worth")))


@query(
    "e06_training_samples",
    f"""WITH {SPLIT}, {_chunks_sql("train_docs", *WINDOW).replace("chunks_tok AS", "train_docs AS (SELECT * FROM docs WHERE split = 'train' AND md5('validation:' || doc_ord) >= '2'), chunks_tok AS", 1)}
SELECT 1 AS epoch, {classifier.Config.batches} AS steps, count(*) AS samples, sum(2 * n_tokens - 1)::BIGINT AS features FROM chunks""",
)
def training_samples(s: SparkSession, d: str) -> DataFrame:
    """What the counters of one epoch say that the tasks have worked on."""
    model = classifier.train(training_rows(s, d), ["doc_ord", "chunk_ix"], classifier.Config(epochs=1))
    return model.report(s).select("epoch", "steps", "samples", "features")


@lru_cache(maxsize=2)
def pieces(name: str = PIECES) -> subwords.WordPiece:
    """The pieces of a public vocabulary; they are read where they are installed."""
    import public_tokenizers

    return subwords.WordPiece(subwords.read_vocabulary(public_tokenizers.path(name)))


@query("t04_subwords")
def subword_tokens(s: SparkSession, d: str) -> DataFrame:
    """Numbers and digests of the word pieces of each document."""
    t = corpus(s, d).select("doc_ord", pieces().tokenizer(s)(F.col("text")).alias("t"))
    return t.select("doc_ord", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


@query("t05_subword_texts")
def subword_texts(s: SparkSession, d: str) -> DataFrame:
    """Digests of the texts that the pieces give again."""
    t = corpus(s, d).select("doc_ord", subwords.decode(pieces().tokenizer(s)(F.col("text"))).alias("t"))
    return t.select("doc_ord", F.length("t").cast("long").alias("n"), F.md5(F.col("t").cast("binary")).alias("digest"))


@query("w01_subword_windows")
def subword_windows(s: SparkSession, d: str) -> DataFrame:
    """Windows of 512 pieces every 256, decoded."""
    w = ch.chunk(corpus(s, d), 512, 256, 64, pieces().tokenizer(s))
    return w.select("doc_ord", "chunk_ix", "start_pos", (F.col("start_pos") + F.col("n_tokens")).alias("end_pos"), "n_tokens", F.md5(subwords.decode(F.col("tokens")).cast("binary")).alias("digest"))
