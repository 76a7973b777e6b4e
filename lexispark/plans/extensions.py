"""Queries for planned extensions: votes, positions, rates, curves, splits by work, ablation, groups, markup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.functions import tei
from lexispark.functions import text as tx
from lexispark.operators import chunks as ch
from lexispark.operators import components, features, metrics, ranking, scoring, splits, voices
from lexispark.plans.attribution import _NEAR, _S, _chunks_sql, _probs, _rows, nearest_authors, split_docs
from lexispark.plans.base import CORPUS, SPACE, counts_sql, query, vocab_sql
from lexispark.session import cut
from lexispark.sources.corpus import corpus


@query("x01_tei_body", r"SELECT doc_id, md5(regexp_replace(replace(text, 'e ', 'e-' || chr(10) || ' ' || chr(9)), '-\n[ \t]*', '', 'g') || '<&]') AS digest, CASE WHEN doc_id = (SELECT max(doc_id) FROM documents) THEN 1 ELSE 0 END AS broken FROM documents")
def tei_bodies(s: SparkSession, d: str) -> DataFrame:
    """Documents wrapped in TEI markup that sets traps: bodies in comments and headers, prefixes, CDATA, numeric references; the last one isn't closed."""
    docs = corpus(s, d)
    inner = F.col("text")
    for c, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&#x3E;"), ("e ", "e-\n \t"), ("o ", "o<lb n='1'/> "), ("a ", "<hi rend='>'>a</hi><!-- <body> --> ")):
        inner = F.replace(inner, F.lit(c), F.lit(entity))
    head = """<?xml version="1.0"?><!DOCTYPE TEI [<!ENTITY x "</body>">]><!-- <body>no</body> --><tei:TEI xmlns:tei="u"><tei:teiHeader><body>x</body></tei:teiHeader><tei:text><tei:front>y</tei:front><tei:body rend="a>b"><p>"""
    last = docs.agg(F.max("doc_ord")).first()[0]
    end = F.when(F.col("doc_ord") == last, F.lit("</p>")).otherwise(F.lit("</p></tei:body><back>y</back></tei:text></tei:TEI>"))
    wrapped = F.concat(F.lit(head), inner, F.lit("<![CDATA[<&]]]>"), end)
    found = docs.select(F.col("doc_ord").alias("doc_id"), tei.tei_text(s, wrapped).alias("t"))
    return found.select("doc_id", F.md5(F.col("t.body").cast("binary")).alias("digest"), F.col("t.error").isNotNull().cast("int").alias("broken"))


_WORKS = rf"""vol AS (SELECT author, title, string_agg(text, ' ' ORDER BY doc_ord) AS text FROM corpus GROUP BY author, title),
tok AS (SELECT author, title, regexp_extract_all(text, '[^{SPACE}]+') AS t FROM vol),
win AS (SELECT author, title, k::INTEGER AS chunk_ix, k * 256 AS start_pos, t[k * 256 + 1 : k * 256 + 512] AS tokens FROM tok, unnest(generate_series(0, greatest(0, ceil((len(t) - 512) / 256::DOUBLE)::BIGINT))) g(k))"""


@query("x02_volume_windows", f"WITH {CORPUS}, {_WORKS} SELECT author, title, chunk_ix, start_pos, len(tokens)::INTEGER AS n_tokens, md5(array_to_string(tokens, ' ')) AS digest FROM win WHERE len(tokens) >= 64")
def volume_windows(s: SparkSession, d: str) -> DataFrame:
    """Windows over works, whose documents are their volumes."""
    w = ch.across(corpus(s, d).select("author", "title", "doc_ord", "text"), ["author", "title"], "doc_ord")
    return w.select("author", "title", "chunk_ix", "start_pos", "n_tokens", F.md5(F.array_join("tokens", " ").cast("binary")).alias("digest"))


@query(
    "x04_d2_vote",
    f"WITH {_NEAR}, v AS (SELECT n.doc_ord, r.author AS pred, count(*) AS votes, min(place) AS place FROM near n JOIN docs r ON r.doc_ord = n.neighbour GROUP BY n.doc_ord, r.author) SELECT doc_ord, pred, votes FROM v QUALIFY row_number() OVER (PARTITION BY doc_ord ORDER BY votes DESC, place) = 1",
)
def neighbour_vote(s: SparkSession, d: str) -> DataFrame:
    """The classifier object: fitted on the train works, votes of three neighbours for the others."""
    docs = cut(split_docs(s, d))
    return features.Delta(100).fit(docs.where("split = 'train'")).predict(docs.where("split = 'test'"), 3).select("doc_ord", "pred", "votes")


@query("x07_positions", f"WITH {_S} SELECT doc_ord, chunk_ix, c.start_pos, c.start_pos + c.n_tokens AS end_pos, pred, round(confidence, 6) AS confidence FROM best JOIN chunks c USING (doc_ord, chunk_ix)")
def positions(s: SparkSession, d: str) -> DataFrame:
    """Predictions with the places of their windows."""
    probs, test = _probs(s, d)
    spans = ch.spans(test.select("doc_ord", "text"), 128, 64, 16)
    own = scoring.predictions(probs).join(spans, ["doc_ord", "chunk_ix"])
    return own.select("doc_ord", "chunk_ix", "start_pos", (F.col("start_pos") + F.col("n_tokens")).alias("end_pos"), "pred", F.round("confidence", 6).alias("confidence"))


@query(
    "x08_false_positives",
    f"""WITH {_S}, labs AS (SELECT truth AS label FROM rows_ UNION SELECT pred FROM rows_)
SELECT label, (SELECT count(*) FROM rows_ WHERE truth <> label) AS others, (SELECT count(*) FROM rows_ WHERE truth <> label AND pred = label) AS wrong,
  round(coalesce((SELECT avg((pred = label)::INTEGER) FROM rows_ WHERE truth <> label), 0), 6) AS rate FROM labs""",
)
def false_positives(s: SparkSession, d: str) -> DataFrame:
    return metrics.false_positives(_rows(s, d)).withColumn("rate", F.round("rate", 6))


@query("x09_threshold_curve", f"WITH {_S} SELECT t::INTEGER AS step, count(*) AS n, round(avg((truth = pred)::INTEGER), 6) AS accuracy FROM rows_, generate_series(0, 9) g(t) WHERE least(floor(round(confidence, 9) * 10), 9) >= t GROUP BY t")
def threshold_curve(s: SparkSession, d: str) -> DataFrame:
    return metrics.threshold_curve(_rows(s, d)).withColumn("accuracy", F.round("accuracy", 6))


@query(
    "x10_split_by_work",
    f"""WITH {CORPUS}, works AS (SELECT DISTINCT author, title FROM corpus),
r AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY md5('42:' || author || '|' || title), title) AS rk, count(*) OVER (PARTITION BY author) AS n FROM works)
SELECT author, title, CASE WHEN rk <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN rk <= floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM r""",
)
def split_by_work(s: SparkSession, d: str) -> DataFrame:
    """Whole works in three parts, so that no window has a neighbour in another part."""
    works = corpus(s, d).select("author", "title").distinct()
    return splits.split_three(works.withColumn("key", ranking.md5_key(42, F.col("author"), F.col("title"))), "key", "title").select("author", "title", "split")


_ABLATION = [(size, size * (100 - overlap) // 100, overlap) for size in (256, 512, 1024) for overlap in (0, 50, 75)]


@query(
    "x11_ablation",
    f"WITH {CORPUS}, " + ", ".join(_chunks_sql("corpus", n, stride, 64, f"c{n}_{o}") for n, stride, o in _ABLATION) + " " + " UNION ALL ".join(f"SELECT {n} AS size, {o} AS overlap, author, count(*) AS chunks, sum(n_tokens)::BIGINT AS tokens FROM c{n}_{o} GROUP BY author" for n, _, o in _ABLATION),
)
def ablation(s: SparkSession, d: str) -> DataFrame:
    """Windows of three sizes and overlaps by author; the texts are cut into tokens once."""
    counted = corpus(s, d).select("author", F.size(tx.space_tokens(F.col("text"))).cast("long").alias("n"))
    each = [F.expr(f"named_struct('size', {n}, 'overlap', {o}, 'w', transform({ch.bounds('n', n, stride, 64)}, w -> cast(w.n_tokens as bigint)))") for n, stride, o in _ABLATION]
    rows = counted.select("author", "n").select("author", F.explode(F.array(*each)).alias("_")).select("author", "_.*")
    sums = rows.groupBy("size", "overlap", "author").agg(F.sum(F.size("w")).alias("chunks"), F.sum(F.aggregate("w", F.lit(0).cast("long"), lambda a, b: a + b)).alias("tokens"))
    return sums.where("chunks > 0")


@query(
    "x14_two_methods",
    f"""SELECT doc_ord, truth, delta_pred, vote_pred FROM (WITH {_NEAR} SELECT doc_ord, truth, pred AS delta_pred FROM rows_) a
JOIN (WITH {_S} SELECT doc_ord, pred AS vote_pred FROM rows_ GROUP BY doc_ord, pred QUALIFY row_number() OVER (PARTITION BY doc_ord ORDER BY count(*) DESC, min(chunk_ix)) = 1) b USING (doc_ord)""",
)
def two_methods(s: SparkSession, d: str) -> DataFrame:
    """The nearest neighbour and the vote of the windows, on one split."""
    one = nearest_authors(s, d).select("doc_ord", "truth", F.col("pred").alias("delta_pred"))
    other = metrics.vote(_rows(s, d), ["doc_ord"], ["chunk_ix"]).where("place = 1").select("doc_ord", F.col("pred").alias("vote_pred"))
    return one.join(other, "doc_ord")


_GROUPS = {"en": "north", "de": "north"}


@query(
    "x15_groups",
    f"WITH {_S}, g AS (SELECT CASE WHEN truth IN ('en', 'de') THEN 'north' ELSE 'south' END AS truth, CASE WHEN pred IN ('en', 'de') THEN 'north' ELSE 'south' END AS pred, truth = pred AS same FROM rows_) SELECT truth, count(*) AS n, round(avg((truth = pred)::INTEGER), 6) AS accuracy, round(avg((truth = pred AND NOT same)::INTEGER), 6) AS within, round(avg((truth <> pred)::INTEGER), 6) AS between_ FROM g GROUP BY truth",
)
def groups(s: SparkSession, d: str) -> DataFrame:
    """Authors by group: accuracy of the group, and mistakes within and between groups."""
    group = lambda c: F.when(F.col(c).isin(list(_GROUPS)), "north").otherwise("south")
    rows = _rows(s, d).select(group("truth").alias("truth"), group("pred").alias("pred"), (F.col("truth") == F.col("pred")).alias("same"))
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    hit = F.col("truth") == F.col("pred")
    return rows.groupBy("truth").agg(F.count(F.lit(1)).alias("n"), share(hit).alias("accuracy"), share(hit & ~F.col("same")).alias("within"), share(~hit).alias("between_"))


@query(
    "x16_leave_one_work_out",
    f"""WITH {CORPUS}, {counts_sql("corpus")}, {vocab_sql("wc", 200)},
own AS (SELECT c.author, c.title, wc.word, sum(wc.cnt) AS cnt FROM wc JOIN vocab USING (word) JOIN corpus c USING (doc_ord) GROUP BY c.author, c.title, wc.word),
whole AS (SELECT author, word, sum(cnt) AS cnt FROM own GROUP BY author, word),
works AS (SELECT DISTINCT author, title FROM corpus), authors AS (SELECT DISTINCT author AS pred FROM corpus),
grid AS (SELECT w.author, w.title, a.pred, v.word, coalesce(o.cnt, 0) AS own, coalesce(t.cnt, 0) - CASE WHEN a.pred = w.author THEN coalesce(o.cnt, 0) ELSE 0 END + 1 AS rest
  FROM works w CROSS JOIN authors a CROSS JOIN (SELECT word FROM vocab) v LEFT JOIN own o ON o.author = w.author AND o.title = w.title AND o.word = v.word LEFT JOIN whole t ON t.author = a.pred AND t.word = v.word),
summed AS (SELECT *, sum(rest) OVER (PARTITION BY author, title, pred) AS total FROM grid),
scored AS (SELECT author, title, pred, round(sum(own * ln(rest / total::DOUBLE)), 6) AS score FROM summed GROUP BY author, title, pred)
SELECT author, title, pred FROM scored QUALIFY row_number() OVER (PARTITION BY author, title ORDER BY score DESC, pred) = 1""",
)
def leave_one_work_out(s: SparkSession, d: str) -> DataFrame:
    return scoring.leave_one_work_out(cut(corpus(s, d)))


#: Tokens of a window, cost of a change of author, in log-probability.
VOICE, COST = 64, 8.0


@query("x08_mixed_voices")
def mixed_voices(s: SparkSession, d: str) -> DataFrame:
    """Held-out documents spliced two and two, and the passages that are found in them, with the true boundary."""
    docs = cut(split_docs(s, d))
    model = cut(scoring.multinomial(docs.where("split = 'train'")))
    order = F.md5(F.concat(F.lit("voices:"), F.col("doc_ord").cast("string")).cast("binary"))
    held = docs.where("split = 'test'").withColumn("key", order)
    ranks = ranking.running(held.select("doc_ord", "key"), [], [F.col("key"), F.col("doc_ord")], {"rank": F.lit(1)}).select("doc_ord", F.col("rank") - 1)
    mixed = cut(voices.spliced(held.join(ranks.toDF("doc_ord", "rank"), "doc_ord"), "rank"))
    scored = scoring.logits(mixed.select("doc_ord", "text"), model, VOICE, VOICE, 1)
    # A mean by word, times the words that a window may hold.
    sums = scored.select("doc_ord", "chunk_ix", F.transform("scores", lambda x: x["logit"] * VOICE).alias("logps"))
    found = voices.passages(sums, scoring.authors_of(model), COST, VOICE)
    return found.join(mixed.drop("text"), "doc_ord").select("doc_ord", "first_author", "second_author", "boundary", "passage", "author", "first_chunk", "last_chunk", "first_token")


_SCORES = f"{_S}, sc AS (SELECT pr.author_pred AS author, round(prob, 9) AS k, t.author = pr.author_pred AS pos FROM pr JOIN test_docs t USING (doc_ord)), pt AS (SELECT author, k, sum(pos::INTEGER)::BIGINT AS p, sum((NOT pos)::INTEGER)::BIGINT AS n FROM sc GROUP BY author, k), run AS (SELECT *, sum(p) OVER w AS hits, sum(n) OVER w AS misses, sum(p) OVER (PARTITION BY author) AS np, sum(n) OVER (PARTITION BY author) AS nn FROM pt WINDOW w AS (PARTITION BY author ORDER BY k DESC ROWS UNBOUNDED PRECEDING))"


def _truths(s: SparkSession, d: str) -> DataFrame:
    """(author, score, positive): each author's probability of each window of works held out."""
    rows = _probs(s, d)[0].select("truth", F.inline("probs"))
    return rows.select(F.col("author_pred").alias("author"), F.col("prob").alias("score"), (F.col("truth") == F.col("author_pred")).alias("positive"))


@query("x09_roc", f"WITH {_SCORES} SELECT author, count(*) AS points, sum(hits)::BIGINT AS hits, sum(misses)::BIGINT AS misses, round(sum(coalesce(hits / nullif(np, 0)::DOUBLE, 0)), 5) AS tpr, round(sum(coalesce(misses / nullif(nn, 0)::DOUBLE, 0)), 5) AS fpr FROM run GROUP BY author")
def roc_curve(s: SparkSession, d: str) -> DataFrame:
    """The curve of each author against the others, summed up over its points, as scores of equal rank differ in their last places."""
    r = metrics.roc(_truths(s, d), ["author"])
    return r.groupBy("author").agg(F.count(F.lit(1)).alias("points"), F.sum("hits").alias("hits"), F.sum("misses").alias("misses"), F.round(F.sum("tpr"), 5).alias("tpr"), F.round(F.sum("fpr"), 5).alias("fpr"))


@query("x09_auc", f"WITH {_SCORES} SELECT author, sum(p)::BIGINT AS positives, sum(n)::BIGINT AS negatives, round(sum(n * (2 * (hits - p) + p))::DOUBLE / nullif(2.0::DOUBLE * sum(p) * sum(n), 0), 6) AS auc FROM run GROUP BY author")
def areas(s: SparkSession, d: str) -> DataFrame:
    """The area under each author's curve."""
    return metrics.area(_truths(s, d), ["author"]).withColumn("auc", F.round("auc", 6))


def _frequencies(s: SparkSession, d: str) -> DataFrame:
    """Relative frequencies of the 100 most frequent words, with author and year."""
    docs = corpus(s, d)
    vocab = features.vocabulary(features.word_counts(docs), 100)
    return cut(features.frequencies(docs.select("doc_ord", "author", "year", "text"), vocab))


@query("x13_components")
def principal_components(s: SparkSession, d: str) -> DataFrame:
    """Documents on the two leading components of their word frequencies, and the shares of variance of these."""
    freq = _frequencies(s, d)
    c = components.Components.fit(freq, "freq", 2)
    place = c.project(F.col("freq"))
    share = [float(v / c.total) if c.total else 0.0 for v in (*c.variances, 0.0, 0.0)][:2]
    return freq.select("doc_ord", "author", F.round(F.get(place, F.lit(0)), 6).alias("first"), F.round(F.get(place, F.lit(1)), 6).alias("second"), F.lit(share[0]).alias("first_share"), F.lit(share[1]).alias("second_share"))


@query(
    "x13_similarity_over_time",
    f"""WITH {CORPUS}, {counts_sql("corpus")}, {vocab_sql("wc", 100)},
fx AS (SELECT t.doc_ord, v.rank, CASE WHEN len(t.t) > 0 THEN coalesce(wc.cnt, 0) * 1000.0::DOUBLE / len(t.t) ELSE 0 END AS freq FROM tok t CROSS JOIN vocab v LEFT JOIN wc ON wc.doc_ord = t.doc_ord AND wc.word = v.word),
cen AS MATERIALIZED (SELECT author, (year // 10 * 10)::INTEGER AS decade, rank, avg(freq) AS x FROM fx JOIN corpus USING (doc_ord) GROUP BY ALL),
nx AS (SELECT author, decade, lead(decade) OVER (PARTITION BY author ORDER BY decade) AS next_decade FROM (SELECT DISTINCT author, decade FROM cen))
SELECT author, decade, next_decade, round(sum(a.x * b.x) / nullif(sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x)), 0), 6) AS similarity
FROM nx JOIN cen a USING (author, decade) JOIN (SELECT author, decade AS next_decade, rank, x FROM cen) b USING (author, next_decade, rank) GROUP BY author, decade, next_decade""",
)
def similarity_over_time(s: SparkSession, d: str) -> DataFrame:
    """Cosines of an author's word frequencies in a decade and in the next one."""
    rows = _frequencies(s, d).withColumn("decade", (F.floor(F.col("year") / 10) * 10).cast("int"))
    out = components.over_time(components.centroids(rows, ["author", "decade"], "freq"), ["author"], "decade")
    return out.select("author", "decade", F.col("next_period").alias("next_decade"), F.round("similarity", 6).alias("similarity"))
