import math

from pyspark.sql import functions as F

from lorespark.functions import stats, text, vector


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def test_tokens(spark):
    assert one(spark, text.tokens(F.col("t")), t="Ab, c é 12_x ÄÖ") == ["ab", "é", "12", "äö"]
    assert one(spark, text.tokens(F.lit(None).cast("string"))) == []


def test_sentences_cover_the_text(spark):
    for value, want in {"One. Two! x": ["One.", " Two!", " x"], "a.b": ["a.b"], "": [], "Hm?\n": ["Hm?", "\n"], "é! ü": ["é!", " ü"], "end.": ["end."]}.items():
        assert one(spark, text.sentences(F.col("t")), t=value) == want


def test_byte_slice_counts_bytes(spark):
    assert one(spark, text.byte_slice(F.col("t"), F.lit(2), F.lit(5)), t="éabcd") == "abc"


def test_contains_word_needs_bounds(spark):
    rows = spark.createDataFrame([("the tea.", "tea"), ("team", "tea"), ("чай", "ча"), ("c++ x", "c++"), ("a tea2", "tea")], ["t", "n"])
    assert [r.x for r in rows.select(text.contains_word(F.col("t"), F.col("n")).alias("x")).collect()] == [True, False, False, True, False]


def test_names_sizes_and_dates(spark):
    assert one(spark, text.normalised_name(F.col("t")), t=" Anna's ") == "anna"
    assert one(spark, text.estimated_tokens(F.col("t")), t="12345678") == 4
    assert str(one(spark, text.date_of_day(F.lit(31)))) == "2018-02-01"


def test_hash_tells_null_from_empty(spark):
    null, empty = F.lit(None).cast("string"), F.lit("")
    values = [one(spark, text.content_hash(*c)) for c in ((null,), (empty,), (F.lit("ab"), F.lit("c")), (F.lit("a"), F.lit("bc")))]
    assert len(set(values)) == 4


def test_vectors(spark):
    v = F.array(F.lit(3.0), F.lit(4.0), F.lit(0.0))
    assert one(spark, vector.norm(v)) == 5
    assert one(spark, vector.normalised(v)) == [0.6, 0.8, 0.0]
    assert one(spark, vector.shortened(v, 1)) == [1.0]
    assert one(spark, vector.normalised(F.array(F.lit(0.0)))) == [0.0]
    assert one(spark, vector.popcount_and(F.array(F.lit(7), F.lit(1)), F.array(F.lit(5), F.lit(2)))) == 2


def test_binomial_tail_equals_the_sum(spark):
    for n, k, q in ((5, 2, 0.3), (10, 10, 0.9), (4, 0, 0.5), (3, 4, 0.5), (60, 7, 0.05), (2, 1, 0.0)):
        p = min(max(q, 1e-9), 1 - 1e-9)
        want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))
        assert abs(one(spark, stats.binomial_tail(F.lit(n), F.lit(k), F.lit(q))) - want) < 1e-9
