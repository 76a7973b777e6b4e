"""Splits by work and by chunk, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexispark import session
from lexispark.operators import ranking

#: Most works whose splits are broadcast.
MOST_WORKS = 1_000_000


def split_works(docs: DataFrame, share: float = 0.2, seed: int = 42) -> DataFrame:
    """docs with split train or test. Works (author, title) are shuffled by a keyed hash; an author with several
    works gives max(1, floor(n * share)) of them to test, one with a single work gives none."""
    works = docs.select("author", "title").distinct()
    works = works.withColumn("key", ranking.md5_key(seed, F.col("author"), F.col("title")))
    r = ranking.ranked(works, ["author"], "key", "title")
    n_test = F.when(F.col("n") > 1, F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(share)))).otherwise(0)
    cut = r.select("author", "title", F.when(F.col("rk") <= n_test, "test").otherwise("train").alias("split"))
    # Texts stay where they are: the table of works has short rows, and is sent to them unless it is very long.
    cut = session.cut(cut)
    return docs.join(F.broadcast(cut) if cut.count() <= MOST_WORKS else cut, ["author", "title"])


def split_three(works_or_chunks: DataFrame, key: str, *ties: str, train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """Rows with split train, validation or test within each author: floor(n * train), floor(n * validation), the rest."""
    r = ranking.ranked(works_or_chunks, ["author"], key, *ties)
    a, b = F.floor(F.col("n") * F.lit(train)), F.floor(F.col("n") * F.lit(validation))
    split = F.when(F.col("rk") <= a, "train").when(F.col("rk") <= a + b, "validation").otherwise("test")
    return r.withColumn("split", split).drop("rk", "n")


def label_ids(df: DataFrame) -> DataFrame:
    """(author, label): ids from 0 in ascending order of the authors."""
    authors = df.select("author").where("author is not null").distinct()
    return authors.select("author", (F.row_number().over(Window.orderBy("author")) - 1).alias("label"))
