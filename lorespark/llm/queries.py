"""The queries of the operators for training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.llm import abuse, clusters, distinctive, frequency, linkage, mixing, names, neighbours, splitting, tokens
from lorespark.session import materialise, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of strings that name the same person or organisation."""
    return names.name_pairs(p1_names(spark, sf_dir))


def p1_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.linked(names.all_names(table(spark, sf_dir, "extractions"), table(spark, sf_dir, "fact_edges")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats of notes, each with the earliest event of its note."""
    return linkage.repeats(table(spark, sf_dir, "events_l0"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of groups of similar vectors, each with the first of its group."""
    return clusters.grouped(table(spark, sf_dir, "vectors"), degrees=False).filter("vec_id != first_vec_id").select("first_vec_id", "vec_id")


def p3_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.grouped(table(spark, sf_dir, "vectors"))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.described(materialise(p3_members(spark, sf_dir)))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar pairs of which one is among the five nearest of the other."""
    return neighbours.similar_pairs(p4_nearest(spark, sf_dir)).select("vec_id_a", "vec_id_b")


def p4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "vectors"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that are cut: those with a first piece."""
    return p5_pieces(spark, sf_dir).filter("piece_no = 0").select("item_kind", F.col("item_id").cast("bigint").alias("item_id"))


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events_l0")
    items = splitting.event_items(events).unionByName(splitting.unit_items(table(spark, sf_dir, "units"), events))
    return splitting.split_items(items)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms too rare or too common, of texts and of extracted entities."""
    text = frequency.text_terms(table(spark, sf_dir, "entries")).select(F.lit("text").alias("field"), "term", "mark")
    entities = frequency.string_terms(table(spark, sf_dir, "extractions")).select(F.lit("entities").alias("field"), "term", "mark")
    return text.unionByName(entities).filter("mark is not null")


def p6_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences and records of all runs of one to three words."""
    return frequency.text_terms(table(spark, sf_dir, "entries"), 3).select("n", "term", "occurrences", "records", "mark")


def p6_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.string_terms(table(spark, sf_dir, "extractions"))


def _cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    asked = distinctive.question_words(table(spark, sf_dir, "recall_queries"))
    return distinctive.asked_cells(table(spark, sf_dir, "entries"), asked), asked


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that hold all telling words of a question."""
    return distinctive.found(*_cells(spark, sf_dir)).select("query_id", "entry_id")


def p7_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinctive.scores(distinctive.word_counts(table(spark, sf_dir, "entries"), "id", "text", "entry_id"))


def p7_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinctive.search(*_cells(spark, sf_dir))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_ids(table(spark, sf_dir, "documents"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(p9_mix(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def _abuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_labels"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with abusive, hateful or sexual content."""
    return _abuse(spark, sf_dir).filter(F.col("score") >= abuse.THRESHOLD).select("doc_id")


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _abuse(spark, sf_dir)


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.rates(_abuse(spark, sf_dir))


def queries() -> dict:
    named = [p1_found, p1_names, p2_found, p3_found, p3_members, p3_groups, p4_found, p4_nearest, p5_found, p5_pieces, p6_found, p6_ngrams, p6_entities, p7_found, p7_scores, p7_search, p8_ids, p9_mix, p9_shares, p10_found, p10_scores, p10_rates]
    return {f.__name__: f for f in named}
