import os
import random

import numpy as np

import pytest
from pyspark.sql import functions as F

from lorespark.llm import distinctive, frequency, mixing, splitting, tokens

HAVE = os.path.exists(os.path.join(tokens.TOKENIZERS, f"{tokens.NAME}.tiktoken"))
needs_vocabulary = pytest.mark.skipif(not HAVE, reason="no vocabulary files")
DOC = "doc_id long, text string, source string"


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


# Token ids


@needs_vocabulary
def test_ids_equal_one_go():
    pick = random.Random(1)
    enc = tokens.encoder()
    for letters in ("ab", "thequickbrown", "äöü漢字かな", "aB1!?_'s", "a\x1c\x85 　'll 123\n", "don't we've  "):
        for n in (1, 60, 700, 4000):
            text = "".join(pick.choice(letters) for _ in range(n))
            assert tokens.encode_text(enc, text, 50, 16) == enc.encode_ordinary(text)
    long = "x" * 50_000 + " y" * 3000 + "é" * 9000
    assert tokens.encode_text(enc, long) == enc.encode_ordinary(long)


@needs_vocabulary
def test_ids_equal_the_other_library():
    tokenizers = pytest.importorskip("tokenizers")
    whole = tokenizers.Tokenizer.from_file(os.path.join(tokens.TOKENIZERS, "byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    for text in ("<|endoftext|> a", "  two  spaces\t\n", "ﬁ ½ ² ⅷ", "​﻿x", "مرحبا بالعالم", "😀👩‍👩‍👧"):
        assert tokens.encode_text(tokens.encoder(), text, 2, 2) == whole.encode(text, add_special_tokens=False).ids


@needs_vocabulary
def test_ids_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "hi", "b"), (3, "hi", "b"), (None, "x", None), (4, " \n", "c")], DOC).withColumns({"ids": F.lit("clash"), "n_tokens": F.lit(1)})
    got = rows(tokens.encode_ids(docs))
    assert len(got) == 6 and (1, []) in got and (2, []) in got and got.count((3, tokens.encoder().encode_ordinary("hi"))) == 2
    assert tokens.encode_ids(docs.limit(0)).count() == 0
    assert tokens.encode_ids(docs).columns == ["doc_id", "ids"]


# Mixing


def best_sum(lengths, counts, budget):
    reach = 1
    for n, c in zip(lengths, counts):
        for _ in range(c):
            reach |= (reach << n) & ((1 << budget + 1) - 1)
    return reach.bit_length() - 1


def test_fit_is_near_the_best():
    pick = random.Random(2)
    for _ in range(200):
        lengths = sorted(pick.sample(range(1, 300), pick.randint(1, 40)))
        counts = [pick.randint(1, 8) for _ in lengths]
        budget = pick.randint(0, sum(a * b for a, b in zip(lengths, counts)) + 5)
        taken = mixing.fit_subset(lengths, counts, budget)
        assert all(0 <= k <= c for k, c in zip(taken, counts))
        got = sum(a * b for a, b in zip(lengths, taken))
        assert got <= budget
        assert best_sum(lengths, counts, budget) - got <= max(lengths)
    assert mixing.fit_subset([3, 5], [2, 2], 8) in ([1, 1],)
    assert mixing.fit_subset([], [], 5) == []


def test_mix_reaches_shares_within_repeats(spark):
    pick = random.Random(3)
    sizes = [(i, "big", pick.randint(1, 60)) for i in range(3000)] + [(5000 + i, "small", pick.randint(1, 60)) for i in range(60)] + [(9000, "other", 5)]
    df = spark.createDataFrame(sizes, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("big", 0.7, 1), ("small", 0.3, 4), ("none", 0.0, 2), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(df, targets)
    report = {r.source: r for r in mixing.shares(mixed, targets).collect()}
    assert abs(report["big"].actual_share - 0.7) < 0.002 and abs(report["small"].actual_share - 0.3) < 0.002
    assert report["small"].most_repeats == 4 and report["big"].most_repeats == 1 and report["none"].tokens == 0
    assert mixed.filter("source = 'other'").count() == 0
    assert rows(mixed) == rows(mixing.mix(df, targets))
    capped = {r.source: r for r in mixing.shares(mixing.mix(df, targets, total_tokens=1_000_000), targets).collect()}
    assert capped["big"].tokens == sum(n for _, s, n in sizes if s == "big")
    assert mixing.mix(df.limit(0), targets).count() == 0
    assert mixing.mix(df, targets.limit(0)).count() == 0


def test_mix_of_a_hot_length(spark):
    df = spark.createDataFrame([(i, "a", 7) for i in range(5000)] + [(i, "b", 3) for i in range(9000, 9100)], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 3)], "source string, target_share double, max_repeats int")
    got = mixing.mix(df, targets)
    assert got.filter("source = 'a'").count() == 900 * 1 // 7
    assert got.filter("source = 'b'").agg(F.sum(F.col("n_tokens") * F.col("repeats"))).first()[0] == 900


@needs_vocabulary
def test_documents_without_tokens_are_left_out(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "hi there", "a"), (4, "x", None)], DOC)
    assert rows(mixing.token_sizes(docs)) == [(3, "a", 2)]


# Splitting


def check(data, limit=2000, overlap=200):
    spans = splitting.cut(data, limit, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == len(data)
    assert all(0 < b - a <= limit for a, b in spans)
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert a < c <= b < d and b - c <= overlap
    return spans


def test_pieces_cover_any_bytes():
    pick = random.Random(4)
    for letters in ("ab", "漢字", "a b", "é. ", "ab. \n", "😀", "x😀 ."):
        for n in (1, 1999, 2000, 2001, 5000, 30_000):
            data = "".join(pick.choice(letters) for _ in range(n)).encode()
            for a, b in check(data):
                data[a:b].decode()
            check(bytes(pick.randrange(256) for _ in range(n)))
    assert splitting.cut(b"") == [] and splitting.cut(b"x") == [(0, 1)]


def test_cut_at_the_change_of_topic():
    one = "The boat sails over the sea with the wind. " * 28
    two = "Bread needs flour yeast salt and an oven. " * 28
    spans = check((one + two).encode())
    assert spans[0][1] == len(one)


def test_items(spark):
    long = "Word here. " * 400
    events = spark.createDataFrame([(1, long), (2, "short"), (3, None), (4, ""), (None, long)], "event_id long, text string").withColumn("item_id", F.lit(0))
    units = spark.createDataFrame([(1, 1, 0, 4000), (2, 1, 0, 2000), (3, 1, 0, 9999), (4, 1, 50, None), (5, 7, 0, 4000), (6, 1, -1, 4000), (7, 1, 3000, 100), (1, 1, 0, 4000)], "unit_id long, event_id long, byte_start int, byte_end int")
    assert {r.item_id for r in splitting.split_items(splitting.event_items(events)).collect()} == {1}
    pieces = splitting.split_items(splitting.unit_items(units, events)).collect()
    assert {r.item_id for r in pieces} == {1} and sum(r.piece_no == 0 for r in pieces) == 2
    assert all(r.text.encode() == long.encode()[r.byte_start : r.byte_end] for r in pieces)
    assert splitting.split_items(splitting.event_items(events.limit(0))).count() == 0


# Frequency


def brute(records, max_n):
    count, held = {}, {}
    for i, terms in enumerate(records):
        for n in range(1, max_n + 1):
            for at in range(len(terms) - n + 1):
                g = n, " ".join(terms[at : at + n])
                count[g] = count.get(g, 0) + 1
                held.setdefault(g, set()).add(i)
    return sorted((n, t, c, len(held[n, t])) for (n, t), c in count.items())


@pytest.mark.parametrize("block", [7, 100_000])
def test_ngrams_against_brute_force(spark, block):
    pick = random.Random(5)
    records = [[pick.choice("abcd") for _ in range(pick.randint(0, 12))] for _ in range(80)]
    df = spark.createDataFrame([(r,) for r in records], "t array<string>").repartition(3)
    assert rows(frequency.ngram_counts(df, "t", 3, block)) == sorted(brute(records, 3), key=repr)


def test_term_marks(spark):
    entries = spark.createDataFrame([(i, "Common über_x") for i in range(30)] + [(40, "rare RARE a"), (41, ""), (42, None), (42, "tea"), (42, "tea"), (42, "tea")], "id long, text string")
    got = {r.term: (r.occurrences, r.records, r.mark) for r in frequency.text_terms(entries).collect()}
    assert got == {"common": (30, 30, "common"), "über": (30, 30, "common"), "rare": (2, 1, "rare"), "tea": (3, 3, None)}
    assert frequency.text_terms(entries.limit(0)).count() == 0


def test_strings_of_an_entry_count_once(spark):
    log = spark.createDataFrame([(1, ["A", "A", None, ""]), (1, ["A", "a"]), (2, ["A"]), (None, ["A"]), (3, None)], "entry long, entities array<string>")
    got = {r.term: (r.occurrences, r.records) for r in frequency.string_terms(log).collect()}
    assert got == {"A": (4, 2), "a": (1, 1)}


def test_suffix_intervals_of_every_length():
    rng = np.random.default_rng(0)
    for trial in range(60):
        records = [rng.integers(0, 3, rng.integers(1, 12)).tolist() for _ in range(rng.integers(1, 8))]
        records += records[: trial % 3]
        terms, owner = np.concatenate(records), np.repeat(np.arange(len(records)), [len(r) for r in records])
        want = {}
        for r, x in enumerate(records):
            for i in range(len(x)):
                for n in range(1, len(x) - i + 1):
                    want.setdefault(tuple(x[i : i + n]), []).append(r)
        got = {tuple(terms[p : p + n].tolist()): (o, h) for n, places, occurrences, held in frequency.suffix_intervals(terms, owner) for p, o, h in zip(places, occurrences, held)}
        assert got == {k: (len(v), len(set(v))) for k, v in want.items()}


def test_strings_of_a_record_in_many_rows(spark):
    log = spark.createDataFrame([(1, ["a", "a", "b"])] * 40 + [(2, ["b", None, ""]), (None, ["a"]), (3, None), (4, [])], "entry long, entities array<string>").repartition(6)
    got = {r.term: (r.occurrences, r.records, r.mark) for r in frequency.string_terms(log, block_terms=1).collect()}
    assert got == {"a": (80, 1, "rare"), "b": (41, 2, "rare")}
    assert frequency.string_terms(log.limit(0)).count() == 0


# Distinctive words


def test_residuals(spark):
    entries = spark.createDataFrame([(1, "tea tea cup"), (2, "cup of"), (2, "of"), (3, None), (None, "tea")], "id long, text string")
    got = {(r.entry_id, r.word): r.score for r in distinctive.scores(distinctive.word_counts(entries, "id", "text", "entry_id")).collect()}
    e = 3 * 2 / 6
    assert got[1, "tea"] == round((2 - e) / (e * (1 - 3 / 6) * (1 - 2 / 6)) ** 0.5, 6)
    assert got[1, "cup"] == 0
    assert distinctive.scores(distinctive.word_counts(entries.limit(0), "id", "text", "entry_id")).count() == 0


def test_found_needs_all_telling_words(spark):
    entries = spark.createDataFrame([(i, "plain words") for i in range(8)] + [(10, "zig zag plain"), (11, "zig"), (12, "zag")], "id long, text string")
    asked = spark.createDataFrame([(1, "where is ZIG zag plain"), (2, "plain"), (3, None), (4, "zag zag nowhere")], "id int, question string")
    scored = distinctive.asked_cells(entries, distinctive.question_words(asked))
    found = distinctive.found(scored, distinctive.question_words(asked))
    assert rows(found, "query_id", "entry_id") == [(1, 10), (4, 10), (4, 12)]
    best = [r for r in distinctive.search(scored, distinctive.question_words(asked), 3).collect() if r.query_id == 1]
    assert {r.entry_id for r in best} == {10, 11, 12} and all(r.score > 0 for r in best)
