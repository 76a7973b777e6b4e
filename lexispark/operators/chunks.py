"""Sliding windows over the tokens of a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.functions import text as tx
from lexispark.operators import ranking


def bounds(n: str, size: int, stride: int, least: int) -> str:
    """SQL for an array of (start_pos, n_tokens) of the windows of a text with n tokens.

    Windows start at 0, stride, 2 stride, ... up to the first that reaches the end; those with fewer than
    least tokens (1 at least) are left out.
    """
    return f"""filter(transform(
      sequence(0L, greatest(0L, cast(ceil(({n} - {size}) / {stride}D) as bigint))),
      k -> named_struct('start_pos', k * {stride}, 'n_tokens', cast(least({size}, {n} - k * {stride}) as int))),
      w -> w.n_tokens >= greatest({least}, 1))"""


def windows(tokens: str, size: int, stride: int, least: int) -> Column:
    """Array of (chunk_ix, start_pos, n_tokens, tokens) of the windows; chunk_ix counts those that stay."""
    return F.expr(f"""transform({bounds(f"size({tokens})", size, stride, least)}, (w, i) -> named_struct(
      'chunk_ix', i, 'start_pos', w.start_pos, 'n_tokens', w.n_tokens, 'tokens', slice({tokens}, cast(w.start_pos + 1 as int), {size})))""")


def spans(docs: DataFrame, size: int = 512, stride: int = 256, least: int = 64, tokenizer=tx.space_tokens) -> DataFrame:
    """(chunk_ix, start_pos, n_tokens) for each window of each document, without its tokens, beside the document's other columns."""
    keep = [c for c in docs.columns if c != "text"]
    counted = docs.select(*keep, F.size(tokenizer(F.col("text"))).cast("long").alias("_n"))
    found = F.expr(f"transform({bounds('_n', size, stride, least)}, (w, i) -> named_struct('chunk_ix', i, 'start_pos', w.start_pos, 'n_tokens', w.n_tokens))")
    return counted.select(*keep, F.inline(found))


def chunk(docs: DataFrame, size: int = 512, stride: int = 256, least: int = 64, tokenizer=tx.space_tokens) -> DataFrame:
    """A row for each window of each document, with the document's other columns; tokenizer makes an array column of text."""
    keep = [c for c in docs.columns if c != "text"]
    cut = docs.select(*keep, tokenizer(F.col("text")).alias("_tokens"))
    return cut.select(*keep, F.inline(windows("_tokens", size, stride, least)))


def across(docs: DataFrame, work: list[str], volume: str, size: int = 512, stride: int = 256, least: int = 64, tokenizer=tx.space_tokens) -> DataFrame:
    """(work, chunk_ix, start_pos, n_tokens, tokens): windows over the works' texts, whose volumes follow one another.

    A volume's place in its work is a running total of token counts. Each volume cuts its own part out of the windows
    that it touches; windows that lie in one volume are done with that, and only the parts of the others are shuffled.
    No work is gathered in a row. A volume's number should be unique in its work.
    """
    counted = docs.select(*work, volume, F.size(tokenizer(F.col("text"))).cast("long").alias("_n"))
    placed = ranking.running(counted, work, [F.col(volume)], {"_end": F.col("_n")})
    own = docs.select(*work, volume, tokenizer(F.col("text")).alias("_tokens")).join(placed, [*work, volume])
    at = F.col("_end") - F.col("_n")
    last = F.greatest(F.lit(0), F.ceil((F.col("_end_total") - size) / F.lit(float(stride)))).cast("long")
    first = F.greatest(F.lit(0), F.floor((at - size) / F.lit(float(stride))).cast("long") + 1)
    final = F.least(last, F.floor((F.col("_end") - 1) / F.lit(float(stride))).cast("long"))
    met = own.where("_n > 0").withColumn("_at", at).withColumn("_k", F.explode(F.when(first <= final, F.sequence(first, final))))
    start = F.col("_k") * stride
    held = F.least(F.lit(size), F.col("_end_total") - start)
    low = F.greatest(F.lit(0), start - F.col("_at"))
    part = F.slice("_tokens", (low + 1).cast("int"), (F.least(F.col("_n"), start + size - F.col("_at")) - low).cast("int"))
    parts = met.select(*work, volume, F.col("_k").cast("int").alias("chunk_ix"), start.alias("start_pos"), held.cast("int").alias("n_tokens"), part.alias("tokens")).where(F.col("n_tokens") >= max(least, 1))
    key = [*work, "chunk_ix", "start_pos", "n_tokens"]
    whole = parts.where(F.size("tokens") == F.col("n_tokens")).select(*key, "tokens")
    edges = parts.where(F.size("tokens") < F.col("n_tokens")).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(volume, "tokens"))).alias("_parts"))
    return whole.unionByName(edges.select(*key, F.flatten(F.col("_parts.tokens")).alias("tokens")))
