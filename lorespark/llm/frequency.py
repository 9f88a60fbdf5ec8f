"""How often each word, run of words or string occurs, and in how many records.

Each task builds the suffix array of its own records, numbered terms that are sorted by prefix
doubling to whatever depth tells them apart, with the number of terms that neighbours share.  All
places of one n-gram lie side by side there, as an interval in which neighbours share at least n
terms; the interval's length is the n-gram's occurrences, and its length less the neighbours that
lie in the same record is its number of records.  No n-gram of a record lies in two tasks, so the
counts of all tasks add up, and only one row for each distinct n-gram of a task is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Terms that a task sorts at a time.
BLOCK_TERMS = 1_000_000


def words(text: Column) -> Column:
    """The lower-cased longest runs of letters and digits with at least 2 bytes, in order."""
    runs = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.transform(F.filter(runs, lambda w: F.octet_length(w) >= 2), F.lower)


def suffix_array(terms: np.ndarray, record: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, shared): the suffixes of all records in order, of equal ones by record, and how many
    terms each shares with the one before it.

    ``terms`` are numbers, record by record; a suffix ends with its record.  In each round the
    suffixes that still tie are told apart by twice as many terms.
    """
    total = len(terms)
    place = np.arange(total)
    ends = np.flatnonzero(np.r_[record[1:] != record[:-1], True]) if total else place
    left = np.repeat(ends, np.diff(np.r_[-1, ends])) - place + 1
    order = np.argsort(terms, kind="stable")
    new = np.r_[True, terms[order][1:] != terms[order][:-1]][:total]
    rank = np.empty(total, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, place, 0))
    levels, reach = [rank.copy()], 1
    while True:
        alive = np.flatnonzero(np.bincount(rank, minlength=total)[rank] > 1)
        if not len(alive):
            break
        further = np.where(left[alive] > reach, rank[np.minimum(alive + reach, total - 1)] + 1, 0)
        again = np.lexsort((further, rank[alive]))
        some, old, further = alive[again], rank[alive][again], further[again]
        fresh = np.r_[True, old[1:] != old[:-1]]
        parts = fresh | np.r_[True, further[1:] != further[:-1]]
        if parts.sum() == fresh.sum():
            break
        at = np.arange(len(some))
        rank[some] = old + np.maximum.accumulate(np.where(parts, at, 0)) - np.maximum.accumulate(np.where(fresh, at, 0))
        reach *= 2
        levels.append(rank.copy())
    order = np.lexsort((record, rank))
    shared = np.zeros(total, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    for step, level in reversed(list(enumerate(levels))):  # level: ranks by the first 2 ** step terms
        inside = shared[1:] < np.minimum(left[order[:-1]], left[order[1:]])
        same = inside & (level[np.minimum(a, total - 1)] == level[np.minimum(b, total - 1)])
        shared[1:] += np.where(same, 1 << step, 0)
        a, b = a + (same << step), b + (same << step)
    if total > 1:
        shared[1:] = np.minimum(shared[1:], np.minimum(left[order[:-1]], left[order[1:]]))
        whole = rank[order[:-1]] == rank[order[1:]]  # equal to their ends
        shared[1:] = np.where(whole, left[order[1:]], shared[1:])
    return order, shared


def suffix_intervals(terms: np.ndarray, record: np.ndarray, max_n: int | None = None, times: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each n: n, a place of each distinct n-gram, its occurrences and its records.

    Goes up to ``max_n`` or to the longest record.  ``times`` is how often each place counts, once
    if it isn't given.
    """
    order, shared = suffix_array(terms, record)
    owner = record[order]
    ends = np.flatnonzero(np.r_[record[1:] != record[:-1], True]) if len(terms) else order
    left = (np.repeat(ends, np.diff(np.r_[-1, ends])) - np.arange(len(terms)) + 1)[order]
    n = 0
    while max_n is None or n < max_n:
        n += 1
        there = left >= n
        if not there.any():
            return
        # Suffixes that are too short stand before all that go on from them, so intervals stay whole.
        interval, holder, place = np.cumsum(shared < n)[there], owner[there], order[there]
        again = np.lexsort((holder, interval))  # a record's places side by side
        interval, holder, place = interval[again], holder[again], place[again]
        first = np.flatnonzero(np.r_[True, interval[1:] != interval[:-1]])
        twice = np.r_[False, (interval[1:] == interval[:-1]) & (holder[1:] == holder[:-1])]
        length = np.diff(np.r_[first, len(interval)])
        yield n, place[first], length if times is None else np.add.reduceat(times[place], first), length - np.add.reduceat(twice.astype(np.int64), first)


def _grams(flat: np.ndarray, owner: np.ndarray, max_n: int, times: np.ndarray | None = None) -> Iterator[pd.DataFrame]:
    codes, names = pd.factorize(flat)
    for n, place, occurrences, held in suffix_intervals(codes.astype(np.int64), owner, max_n, times):
        grams = names[codes[place]]
        for k in range(1, n):
            grams = grams + " " + names[codes[place + k]]
        yield pd.DataFrame({"n": n, "term": grams, "occurrences": occurrences, "records": held})


def _counts(max_n: int, block_terms: int):
    def of(records: list, sizes: list[int]) -> Iterator[pd.DataFrame]:
        return _grams(np.concatenate(records), np.repeat(np.arange(len(sizes)), sizes), max_n)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        records, sizes, held = [], [], 0
        for batch in batches:
            for terms in batch.iloc[:, 0]:
                if len(terms):
                    records.append(np.asarray(terms, dtype=object))
                    sizes.append(len(terms))
                    held += len(terms)
                    if held >= block_terms:
                        yield from of(records, sizes)
                        records, sizes, held = [], [], 0
        if records:
            yield from of(records, sizes)

    return run


def ngram_counts(records: DataFrame, terms_col: str, max_n: int = 1, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(n, term, occurrences, records) of all n-grams of up to ``max_n`` terms.

    Each row of ``records`` is one record.  Null and empty arrays and null elements hold no terms.
    A record is held whole in a task, however long.
    """
    terms = records.select(F.filter(F.col(terms_col), lambda t: t.isNotNull()).alias("terms")).filter(F.size("terms") > 0)
    parts = terms.mapInPandas(_counts(max_n, block_terms), "n int, term string, occurrences bigint, records bigint")
    return parts.groupBy("n", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def mark(counts: DataFrame, total: Column, rare: int = 2, common: float = 0.1) -> DataFrame:
    """Adds ``mark``: rare for a term in at most ``rare`` records, else common for one in more than
    the share ``common`` of all, else null."""
    return counts.withColumn("mark", F.when(F.col("records") <= rare, "rare").when(F.col("records") > total * common, "common"))


def text_terms(entries: DataFrame, max_n: int = 1, text_col: str = "text") -> DataFrame:
    """(n, term, occurrences, records, mark) of the words of texts and of runs of them.

    Every row with a text is a record, repeated rows too; null texts are none, blank ones hold no words.
    """
    texts = entries.filter(F.col(text_col).isNotNull())
    counts = ngram_counts(texts.select(words(F.col(text_col)).alias("terms")), "terms", max_n)
    return mark(counts, _scalar(texts.agg(F.count("*").alias("x"))))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, term, times) of each batch of (id, array), so that repeats within a batch are one row."""
    for batch in batches:
        terms, owner = pc.list_flatten(batch.column(1)), pc.list_parent_indices(batch.column(1))
        rows = pa.table([batch.column(0).take(owner), terms], names=["id", "term"]).filter(pc.greater(pc.fill_null(pc.binary_length(terms), 0), 0))
        counts = rows.group_by(["id", "term"]).aggregate([("term", "count")]).select(["id", "term", "term_count"]).rename_columns(["id", "term", "times"])
        yield from counts.to_batches()


def _record_counts(block_terms: int):
    """As `_counts`, of rows (id, term, times) that come in order of id and term."""

    def of(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        return _grams(rows.term.to_numpy(object), pd.factorize(rows.id)[0], 1, rows.times.to_numpy())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            if size >= block_terms and len(batch):
                last, head = held[-1].iloc[-1], 0
                while head < len(batch) and batch.id.iloc[head] == last.id and batch.term.iloc[head] == last.term:
                    head += 1  # a record's term goes on from the batch before
                held.append(batch.iloc[:head])
                if head < len(batch):
                    yield from of(pd.concat(held))
                    held, size = [], 0
                    batch = batch.iloc[head:]
                else:
                    continue
            if len(batch):
                held.append(batch)
                size += len(batch)
        if held:
            yield from of(pd.concat(held))

    return run


def string_terms(extractions: DataFrame, id_col: str = "entry", array_col: str = "entities", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(term, occurrences, records, mark) of the strings of arrays, exactly as stored.

    All rows of one ``id_col`` are one record.  Repeats are taken together batch by batch where they
    lie; then a record's places of one string come to one task, so a record of very many strings
    is spread over tasks, and the suffix array of the task subtracts those places that are neighbours
    in the same record.  Null and empty strings and rows without an id hold no terms; records are
    the distinct ids.
    """
    rows = extractions.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(array_col).alias("terms"))
    pairs = rows.filter("size(terms) > 0").mapInArrow(_pairs, f"id {dict(rows.dtypes)['id']}, term string, times bigint")
    placed = pairs.repartition("id", "term").sortWithinPartitions("id", "term")
    parts = placed.mapInPandas(_record_counts(block_terms), "n int, term string, occurrences bigint, records bigint")
    counts = parts.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    return mark(counts, _scalar(rows.agg(F.countDistinct("id").alias("x"))))


def _scalar(one_row: DataFrame) -> Column:
    """The value of a one-row result as a literal; the row is computed when this is called."""
    return F.lit(one_row.first()[0])
