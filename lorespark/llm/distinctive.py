"""How much a word sets a record apart: adjusted residuals of the table of records by words.

Of a record with r words, a word with c places and N places in all, r*c/N would be expected.  The
difference from what is there, over the root of the expectation, is the residual of correspondence
analysis; dividing by sqrt((1 - r/N) * (1 - c/N)) gives it variance 1 whatever the margins.
Where only the words of some questions count, only their cells are formed, with the margins of all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.llm.frequency import words
from lorespark.session import materialise

#: Records up to which a word is telling; words of questions up to which all tasks are sent them.
TELLING, ASKED_WORDS = 5, 500_000


def word_counts(rows: DataFrame, id_col: str, text_col: str, id_as: str) -> DataFrame:
    """(id, word, n) of the words of each record; rows with the same id are one record, a null id is none."""
    exploded = rows.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias(id_as), F.explode(words(F.col(text_col))).alias("word"))
    return exploded.groupBy(id_as, "word").agg(F.count("*").alias("n"))


def residual(n: Column, r: Column, c: Column, total: Column) -> Column:
    """The adjusted residual of a cell with n, in a row of r and a column of c; 0 without variance."""
    expected = r * c / total
    variance = expected * (1 - r / total) * (1 - c / total)
    return F.when(variance > 0, (n - expected) / F.sqrt(variance)).otherwise(0.0)


def scores(counts: DataFrame, id_col: str = "entry_id") -> DataFrame:
    """(id, word, n, n_entries, score) for a table (id, word, n) of counts.

    The counts are written once; both margins are sums over them.  A table with a single record or a
    single word has residuals without variance, they count as 0.
    """
    counts = materialise(counts)
    by_word = counts.groupBy("word").agg(F.sum("n").alias("c"), F.count("*").alias("n_entries"))
    by_id = counts.groupBy(id_col).agg(F.sum("n").alias("r"))
    total = F.lit(float(counts.agg(F.sum("n")).first()[0] or 0))
    score = F.round(residual(F.col("n"), F.col("r"), F.col("c"), total), 6)
    return counts.join(by_word, "word").join(by_id, id_col).select(id_col, "word", "n", "n_entries", score.alias("score"))


def question_words(queries: DataFrame) -> DataFrame:
    """(query_id, word) once for each word of a question."""
    return word_counts(queries, "id", "question", "query_id").drop("n")


def asked_cells(entries: DataFrame, asked: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(entry_id, word, n, n_entries, score, present, few): the cells of the words of questions.

    ``score`` is as in `scores`, from the margins of all texts; only cells of asked words leave a
    task.  ``present`` is the residual of the cell in the table that has each word of a record once,
    and ``few`` what it would be there for a word of TELLING records.  As a word stands in more
    records its residual in a given record falls, so the one is at least the other just for words
    of at most TELLING records.  That table is taken TELLING + 1 places larger than it is, so that
    no margin is all of it.
    """
    kept = entries.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("entry_id"), words(F.col(text_col)).alias("words"))
    margins = materialise(kept.groupBy("entry_id").agg(F.sum(F.size("words")).alias("r"), F.sum(F.size(F.array_distinct("words"))).alias("d")))
    whole = margins.agg(F.sum("r").alias("r"), F.sum("d").alias("d")).first()
    total, different = F.lit(float(whole.r or 0)), F.lit(float((whole.d or 0) + TELLING + 1))
    names = asked.select("word").distinct()
    small = names.limit(ASKED_WORDS + 1).count() <= ASKED_WORDS
    held = kept.select("entry_id", F.explode("words").alias("word")).join(F.broadcast(names) if small else names, "word", "left_semi")
    cells = materialise(held.groupBy("entry_id", "word").agg(F.count("*").alias("n")))
    by_word = cells.groupBy("word").agg(F.sum("n").alias("c"), F.count("*").alias("n_entries"))
    rows = cells.join(F.broadcast(by_word) if small else by_word, "word").join(margins, "entry_id")
    present = lambda count: residual(F.lit(1.0), F.col("d"), count, different)
    score = F.round(residual(F.col("n"), F.col("r"), F.col("c"), total), 6)
    return rows.select("entry_id", "word", "n", "n_entries", score.alias("score"), present(F.col("n_entries")).alias("present"), present(F.lit(float(TELLING))).alias("few"))


def found(cells: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, entry_id, score): entries that hold all telling words of a question.

    A word is telling if 1 to TELLING entries hold it; residuals of presence tell, and the count
    itself is checked after that.  Questions without such a word have no rows.
    """
    own = cells.filter((F.col("present") >= F.col("few") - 1e-9) & (F.col("n_entries") <= TELLING))
    hits = asked.join(own, "word")
    need = asked.join(own.select("word").distinct(), "word", "left_semi").groupBy("query_id").agg(F.count("*").alias("need"))
    held = hits.groupBy("query_id", "entry_id").agg(F.count("*").alias("held"), whole_sum("score").alias("score"))
    return held.join(need, "query_id").filter("held = need").select("query_id", "entry_id", "score")


def whole_sum(column: str, places: int = 6) -> Column:
    """The sum of numbers rounded to so many places, by whole numbers, so that no order of adding changes it."""
    return F.sum(F.round(F.col(column) * 10**places).cast("bigint")) / float(10**places)


def search(scored: DataFrame, asked: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, entry_id, score, rank): the k entries whose shared words score highest.

    Only words that an entry holds more often than expected count, so everyday words that are as
    frequent there as anywhere weigh nothing.  Ties go to the smaller entry.
    """
    total = asked.join(scored.filter("score > 0"), "word").groupBy("query_id", "entry_id").agg(whole_sum("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "entry_id"))
    return total.withColumn("rank", rank).filter(F.col("rank") <= k)
