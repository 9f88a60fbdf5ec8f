"""Inverted index and ranking by words."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions.text import tokens
from lorespark.operators.wordsearch import best_documents
from lorespark.session import materialise

#: Weights of the ranking formula (fixed values).
K1, B = 1.2, 0.75
#: Different words of all queries up to which every task is sent them.
ASKED_TERMS = 500_000


def term_frequencies(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, term, tf)"""
    words = docs.select(F.col(id_col).alias("id"), F.explode(tokens(F.col(text_col))).alias("term"))
    return words.groupBy("id", "term").agg(F.count("*").alias("tf"))


def document_lengths(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, dl) of every document, also of those without words."""
    return docs.select(F.col(id_col).alias("id"), F.size(tokens(F.col(text_col))).cast("bigint").alias("dl"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row (n_docs, total_len, avgdl); the average is 0 without documents."""
    return lengths.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total_len"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def document_frequencies(tf: DataFrame) -> DataFrame:
    """(term, df)"""
    return tf.groupBy("term").agg(F.count("*").alias("df"))


def ranked(scores: DataFrame, k: int | None = None, by: str = "qid", score: str = "score", id_col: str = "id") -> DataFrame:
    """Adds ``rank`` from 1: higher scores first, then smaller ids; keeps the first k."""
    out = scores.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), id_col)))
    return out if k is None else out.filter(F.col("rank") <= k)


@dataclass
class Bm25:
    """Tables of an index: postings (id, term, tf), lengths (id, dl) and one row of statistics.

    With ``texts`` (id, text) a search makes only the postings it needs, from the texts.
    """

    postings: DataFrame
    lengths: DataFrame
    stats: DataFrame
    texts: DataFrame | None = None

    @classmethod
    def index(cls, docs: DataFrame, id_col: str = "id", text_col: str = "text") -> Bm25:
        lengths = document_lengths(docs, id_col, text_col)
        return cls(term_frequencies(docs, id_col, text_col), lengths, corpus_stats(lengths), docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))

    def scores(self, queries: DataFrame, id_col: str = "id", text_col: str = "question") -> DataFrame:
        """(qid, id, score); a word that a query holds twice counts twice.

        The words of the queries prune the postings before frequencies and lengths are joined.
        """
        asked = queries.select(F.col(id_col).alias("qid"), F.explode(tokens(F.col(text_col))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("times"))
        asked = materialise(asked)
        names = asked.select("term").distinct()
        small = names.count() <= ASKED_TERMS
        names = F.broadcast(names) if small else names
        if self.texts is None:
            held = self.postings.join(names, "term", "left_semi")
        else:  # only asked words leave a task
            held = self.texts.select("id", F.explode(tokens(F.col("text"))).alias("term")).join(names, "term", "left_semi").groupBy("id", "term").agg(F.count("*").alias("tf"))
        held = materialise(held)
        row = self.stats.first()  # one row
        n, avgdl = float(row.n_docs), max(float(row.avgdl), 1.0)
        df = document_frequencies(held)
        df = F.broadcast(df) if small else df  # no more rows than words asked
        idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        part = F.col("times") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / avgdl))
        hits = held.join(df, "term").join(self.lengths, "id").join(asked, "term")
        return hits.groupBy("qid", "id").agg(F.round(F.sum(part), 6).alias("score"))

    def search(self, queries: DataFrame, k: int, id_col: str = "id", text_col: str = "question") -> DataFrame:
        """(qid, id, score, rank) of the k best documents of each query; with texts, pairs that can't be among them get no score."""
        if self.texts is not None:
            return best_documents(self.texts, queries, k, "id", "text", id_col, text_col, K1, B)
        return ranked(self.scores(queries, id_col, text_col), k)


def reciprocal_ranks(rankings: list[DataFrame], base: int, depth: int, k: int) -> DataFrame:
    """(qid, id, score, rank): fused rankings, the sum of 1 / (60 + rank + base - 1) over those within ``depth``.

    ``base`` is 1 where the first rank counts as 1, and 0 where it counts as 0.
    """
    parts = [r.filter(F.col("rank") <= depth).select("qid", "id", (1.0 / (60 + F.col("rank") + base - 1)).alias("part")) for r in rankings]
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    return ranked(both.groupBy("qid", "id").agg(F.round(F.sum("part"), 9).alias("score")), k)


def idf(n: Column | float, df: Column) -> Column:
    """How telling a phrase of a graph is."""
    return F.log(n / F.greatest(df, F.lit(1))) + 1
