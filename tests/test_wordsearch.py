import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lorespark.operators import lexical, wordsearch


@pytest.fixture
def small(monkeypatch):
    """Few documents a chunk and few of a rare word, so that cores and chunks are met."""
    monkeypatch.setattr(wordsearch, "RARE", 3)
    seen = []
    write = wordsearch.materialise
    monkeypatch.setattr(wordsearch, "materialise", lambda df: (seen.append(write(df)), seen[-1])[1])
    return seen


def tables(spark):
    pick = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join("the" if pick.random() < 0.3 else words[min(int(pick.expovariate(0.12)), 59)] for _ in range(n))
    docs = [(i, text(pick.randrange(1, 30))) for i in pick.sample(range(10_000), 900)] + [(-1, None), (-2, ""), (-3, "the the the")]
    asked = [(i, text(pick.randrange(1, 9)) + (" w59" if i % 3 else "")) for i in range(60)] + [(98, None), (99, "nothing there"), (100, "the"), (101, "THE the w1"), (102, "the the w1")]
    return spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(asked, "id int, question string"), docs, asked


@pytest.mark.parametrize("k", [1, 4, 1000])
def test_bm25_finds_what_scoring_all_pairs_finds(spark, small, k):
    docs, asked, _, _ = tables(spark)
    index = lexical.Bm25.index(docs)
    every = lexical.Bm25(index.postings, index.lengths, index.stats)
    want = {(r.qid, r.rank): (r.id, round(r.score, 5)) for r in every.search(asked, k).collect()}
    found = index.search(asked, k)
    assert found.dtypes == every.search(asked, k).dtypes
    assert {(r.qid, r.rank): (r.id, round(r.score, 5)) for r in found.collect()} == want


@pytest.mark.parametrize("k", [2, 50])
def test_overlap_breaks_ties_by_id(spark, small, k):
    docs, asked, texts, questions = tables(spark)
    words = lambda t: {w for w in (t or "").lower().split() if len(w) > 1}
    want = {}
    for q, question in questions:
        shared = Counter({d: len(words(t) & words(question)) for d, t in texts})
        for n, (d, s) in enumerate(sorted(((d, s) for d, s in shared.items() if s), key=lambda x: (-x[1], x[0]))[:k]):
            want[q, n + 1] = (d, s)
    got = wordsearch.best_documents(docs, asked, k, "id", "text", "id", "question", None)
    assert {(r.qid, r.rank): (r.id, r.score) for r in got.collect()} == want


def test_pairs_that_share_a_common_word_only_are_not_scored(spark, small):
    docs = spark.range(3000).select("id", F.concat(F.lit("the "), F.col("id").cast("string"), F.lit(" x")).alias("text")).coalesce(1)
    asked = spark.range(100, 400).select("id", F.concat(F.lit("the "), F.col("id").cast("string")).alias("question"))
    found = lexical.Bm25.index(docs).search(asked, 5)
    first = {r.qid: r.id for r in found.filter("rank = 1").collect()}
    assert first == {i: i for i in range(100, 400)}
    assert sum(df.count() for df in small) < 3000  # and not 3000 * 300


def test_chunks_of_a_task_are_merged(spark, small):
    from numpy import array, int32, int64, log, ones, zeros

    bags = [(array([0, 1]), ones(2))]
    asked = wordsearch.Asked(2, log(array([3.0, 2.0])), bags, array([True, True]), None, 0.75, 1.0)
    rows = lambda ids, term: (array(ids, int64), ones(len(ids), int32), array(range(len(ids)), int32), array(term, int32), ones(len(ids), int32))
    chunk = wordsearch._Chunk(asked, [rows([5, 3, 4], [0, 1, 0]), rows([2], [0])])
    ids, scores = chunk.best(*asked.cores[0], 2, 0.0)
    assert ids.tolist() == [2, 4] and scores[0] == scores[1]
    assert chunk.best(*asked.cores[0], 2, 9.0)[0].size == 0
    assert wordsearch.top(zeros(0, int64), zeros(0), 2)[0].size == 0
