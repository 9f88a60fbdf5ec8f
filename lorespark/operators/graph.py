"""Mentions, typed relations and walks over them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespark.operators.lexical import idf

#: Phrases in more entries than this are hubs; days between meeting and advice, at most.
HUB, DAYS = 64, 90
#: Phrases that are matched in one pass over the texts.
PHRASES_AT_ONCE = 200_000


def mentions(entries: DataFrame, phrases: DataFrame, phrase_col: str = "phrase", least_bytes: int = 3) -> DataFrame:
    """(entry, phrase): phrases that an entry's text holds anywhere, whatever the case.

    Each pass matches a bounded part of the phrases with one automaton; texts are read once for
    each part, never compared with phrases one by one.
    """
    names = phrases.select(F.lower(phrase_col).alias("phrase")).filter(F.octet_length("phrase") >= least_bytes).distinct()
    total = names.count()
    parts = max(1, -(-total // PHRASES_AT_ONCE))
    out = None
    for part in range(parts):
        some = [r.phrase for r in names.filter(F.pmod(F.xxhash64("phrase"), F.lit(parts)) == part).toLocalIterator()]
        found = _matched(entries, some)
        out = found if out is None else out.unionByName(found)
    return out


def _matched(entries: DataFrame, phrases: list[str]) -> DataFrame:
    held = entries.sparkSession.sparkContext.broadcast(sorted(phrases))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for p in held.value:
            automaton.add_word(p, p)
        if held.value:
            automaton.make_automaton()
        for batch in batches:
            rows = [(e, p) for e, t in batch.itertuples(index=False) if t and held.value for p in sorted({p for _, p in automaton.iter(t)})]
            yield pd.DataFrame(rows, columns=["entry", "phrase"])

    kind = dict(entries.dtypes)["id"]
    return entries.select("id", F.lower("text").alias("text")).filter("text is not null").mapInPandas(run, f"entry {kind}, phrase string")


def without_hubs(edges: DataFrame, most: int = HUB, phrase: str = "phrase") -> DataFrame:
    """Edges of phrases in at most ``most`` entries, with ``df``."""
    df = edges.groupBy(phrase).agg(F.count("*").alias("df")).filter(F.col("df") <= most)
    return edges.join(df, phrase)


def comention_hop(seeds: DataFrame, edges: DataFrame, asked: DataFrame, n_entries: int, most: int = HUB) -> DataFrame:
    """(qid, id, score) one hop on from seeds (qid, id, score).

    A seed entry mentions another phrase, which isn't one that the query asks for and is no hub;
    each other entry that mentions it gets half of its idf times the seed's score.
    """
    few = without_hubs(edges, most)
    bridge = seeds.withColumnRenamed("id", "entry").join(few, "entry").join(asked, ["qid", "phrase"], "left_anti")
    bridge = bridge.withColumn("part", 0.5 * idf(float(n_entries), F.col("df")) * F.col("score")).select("qid", "phrase", F.col("entry").alias("seed"), "part")
    hops = bridge.join(few.select("phrase", F.col("entry").alias("id")), "phrase").filter("id != seed")
    return hops.groupBy("qid", "id").agg(F.round(F.sum("part"), 6).alias("score"))


def introduced_then_advised(edges: DataFrame, weight: float = 3.0) -> DataFrame:
    """(asked, other, intro_entry, advice_entry, score): whom one person introduced, and what that one advised elsewhere.

    ``edges`` has (entry, subj, rel, obj).
    """
    intro = edges.filter("rel = 'introduced'").select(F.col("subj").alias("asked"), F.col("obj").alias("other"), F.col("entry").alias("intro_entry")).distinct()
    advice = edges.filter("rel = 'recommended'").select(F.col("subj").alias("other"), F.col("entry").alias("advice_entry")).distinct()
    return intro.filter("asked != other").join(advice, "other").filter("intro_entry != advice_entry").select("asked", "other", "intro_entry", "advice_entry", F.lit(weight).alias("score"))


def met_then_advised(edges: DataFrame, entries: DataFrame, days: int = DAYS) -> DataFrame:
    """(venue, intro_entry, advice_entry, score): an introduction and advice at the same place within ``days``.

    Days are joined by blocks of ``days``: a pair lies in the same block or the next, so the join has
    equal keys and the range is only checked within a block.
    """
    day = entries.filter("day is not null").select(F.col("id").alias("entry"), "day").distinct()
    at = edges.filter("rel = 'was_at' and obj is not null").select("entry", F.lower("obj").alias("venue")).distinct().join(day, "entry")
    first = at.join(edges.filter("rel = 'introduced'").select("entry").distinct(), "entry", "left_semi").select("venue", F.col("entry").alias("intro_entry"), F.col("day").alias("d1"))
    later = at.join(edges.filter("rel = 'recommended'").select("entry").distinct(), "entry", "left_semi").select("venue", F.col("entry").alias("advice_entry"), F.col("day").alias("d2"))
    width = days + 1
    blocks = first.withColumn("block", F.explode(F.array(F.floor(F.col("d1") / width), F.floor(F.col("d1") / width) + 1)))
    pairs = blocks.join(later.withColumn("block", F.floor(F.col("d2") / width)), ["venue", "block"])
    gap = F.col("d2") - F.col("d1")
    return pairs.filter((gap >= 0) & (gap <= days) & (F.col("intro_entry") != F.col("advice_entry"))).select("venue", "intro_entry", "advice_entry", F.round(3.0 / (1 + gap / 30.0), 6).alias("score"))


def triple_ends(edges: DataFrame) -> DataFrame:
    """(name, other, entry) along facts in both directions, names normalised."""
    clean = edges.select(F.lower(F.trim("subj")).alias("a"), F.lower(F.trim("obj")).alias("b"), "entry").filter("a != '' and b != '' and a != b")
    return clean.select(F.col("a").alias("name"), F.col("b").alias("other"), "entry").union(clean.select("b", "a", "entry")).distinct()


def fact_hops(edges: DataFrame, anchors: DataFrame, n_entries: int, most: int = HUB) -> DataFrame:
    """(name, entry, score): entries with a fact about what a fact joins to an anchor (name).

    Entries that mention the anchor itself are left out; bridges in more than ``most`` entries too.
    """
    ends = triple_ends(edges)
    asserting = ends.select(F.col("name").alias("bridge"), "entry").distinct()
    df = asserting.groupBy("bridge").agg(F.count("*").alias("df")).filter(F.col("df") <= most)
    bridges = ends.join(anchors.select("name").distinct(), "name", "left_semi").select("name", F.col("other").alias("bridge")).distinct().join(df, "bridge")
    hops = bridges.join(asserting, "bridge").join(ends.select("name", "entry").distinct(), ["name", "entry"], "left_anti")
    return hops.groupBy("name", "entry").agg(F.round(F.sum(0.5 * idf(float(n_entries), F.col("df"))), 6).alias("score"))


def prefix_forms(names: DataFrame, column: str = "name", least_bytes: int = 3, longer: int = 2) -> DataFrame:
    """(name, canonical): for each form the longest other that begins with it and is at least
    ``longer`` bytes longer, ties to the first in order; forms without one stand for themselves.

    Every form is joined on its own prefixes as keys.
    """
    forms = names.select(F.col(column).alias("name")).filter(F.octet_length("name") >= least_bytes).distinct()
    prefixes = forms.select(F.col("name").alias("whole"), F.explode(F.sequence(F.lit(1), F.length("name"))).alias("n")).select("whole", F.expr("substring(whole, 1, n)").alias("name")).filter(F.octet_length("name") + longer <= F.octet_length("whole")).filter(F.octet_length("name") >= least_bytes)
    best = forms.join(prefixes, "name").groupBy("name").agg(F.min(F.struct((-F.octet_length("whole")).alias("size"), "whole")).alias("best"))
    return forms.join(best, "name", "left").select("name", F.coalesce("best.whole", "name").alias("canonical"))


def typed_edges(mention: DataFrame, entries: DataFrame, persons: DataFrame, venues: DataFrame, intro_cues: list[str], advice_cues: list[str]) -> tuple[DataFrame, DataFrame]:
    """Introductions (entry, persons, venue, day) and advice (entry, by, venue, day) read off texts.

    An introduction needs a cue, a venue and a person; of several venues the first in order counts.
    Advice needs a cue only.  One entry can be both.
    """
    cue = lambda cues: F.exists(F.array(*map(F.lit, cues)), lambda c: F.contains(F.lower("text"), c))
    who = mention.join(persons.select(F.lower("phrase").alias("phrase")).distinct(), "phrase", "left_semi").groupBy("entry").agg(F.array_sort(F.collect_set("phrase")).alias("persons"))
    where = mention.join(venues.select(F.lower("phrase").alias("phrase")).distinct(), "phrase", "left_semi").groupBy("entry").agg(F.min("phrase").alias("venue"))
    rows = entries.select(F.col("id").alias("entry"), "day", cue(intro_cues).alias("intro"), cue(advice_cues).alias("advice")).filter("intro or advice").join(who, "entry", "left").join(where, "entry", "left")
    none = F.array().cast("array<string>")
    intros = rows.filter("intro and venue is not null and persons is not null").select("entry", "persons", "venue", "day")
    return intros, rows.filter("advice").select("entry", F.coalesce("persons", none).alias("by"), "venue", "day")


def resolved(advice: DataFrame, log: DataFrame) -> DataFrame:
    """Advice with persons that a replayed log (entry, resolved_by) adds, once each and in order."""
    more = log.groupBy("entry").agg(F.flatten(F.collect_list("resolved_by")).alias("more"))
    return advice.join(more, "entry", "left").withColumn("by", F.array_sort(F.array_distinct(F.concat("by", F.coalesce("more", F.array().cast("array<string>")))))).drop("more")


def context_prefix(ranked: DataFrame, entries: DataFrame, budget: int) -> DataFrame:
    """(qid, id, rank, est, total): the first entries of each ranking whose estimated size fits."""
    from lorespark.functions.text import estimated_tokens

    texts = entries.select("id", (estimated_tokens(F.coalesce("date", F.lit(""))) + estimated_tokens(F.coalesce("text", F.lit("")))).alias("est"))
    total = F.sum("est").over(Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return ranked.join(texts, "id").withColumn("total", total).filter(F.col("total") <= budget).select("qid", "id", "rank", "est", "total")
