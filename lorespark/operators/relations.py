"""Search along relations and facts, fused with a ranking by words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.operators.graph import DAYS, HUB, comention_hop, triple_ends
from lorespark.operators.lexical import idf, ranked, reciprocal_ranks

#: Weights of an introduction, of advice one step on, and of advice by a person asked for (fixed values).
FOUND, STEP, DIRECT = 3.0, 3.0, 2.0
#: All of a ranking.
WHOLE = (1 << 31) - 1


def exact_sum(part: Column, places: int = 9) -> Column:
    """A sum of numbers rounded to so many places, the same in whatever order they are added."""
    return F.sum(F.round(part * 10**places).cast("bigint")) / float(10**places)


def typed_facts(edges: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Introductions (entry, persons, venue, day) and advice (entry, by, venue, day) of facts.

    An introduction needs a venue, the first of its entry's; advice may have none.
    """
    low = lambda c: F.lower(F.trim(c))
    day = entries.select(F.col("id").alias("entry"), "day")
    venue = edges.filter("rel = 'was_at' and obj is not null").groupBy("entry").agg(F.min(low("obj")).alias("venue"))
    who = edges.filter("rel = 'introduced'").select("entry", F.explode(F.array(low("subj"), low("obj"))).alias("p")).filter("p != ''").groupBy("entry").agg(F.array_sort(F.collect_set("p")).alias("persons"))
    by = edges.filter("rel = 'recommended'").groupBy("entry").agg(F.array_sort(F.collect_set(low("subj"))).alias("by"))
    return who.join(venue, "entry").join(day, "entry"), by.join(venue, "entry", "left").join(day, "entry")


def relational(question: Column, cues: list[str]) -> Column:
    """Whether a question asks for a relation: it holds one of the cues."""
    return F.exists(F.array(*map(F.lit, cues)), lambda c: F.contains(F.lower(question), c))


def relation_scores(asked: DataFrame, intros: DataFrame, advice: DataFrame, days: int = DAYS) -> DataFrame:
    """(qid, id, score) for the persons that questions name (qid, person).

    Counts advice by such a person, introductions by one, advice by whom else an introduction names,
    and advice at its place within ``days`` after it, less the later it came.  The last join has the
    venue and a block of days as keys.
    """
    persons = asked.select("qid", "person").distinct()
    by = advice.select(F.explode("by").alias("person"), F.col("entry").alias("id"))
    direct = persons.join(by, "person").select("qid", "id", F.lit(DIRECT).alias("part"))
    met = persons.join(intros.select(F.explode(F.array_distinct("persons")).alias("person"), "entry", "persons", "venue", "day"), "person")
    first = met.select("qid", F.col("entry").alias("id"), F.lit(FOUND).alias("part"))
    others = met.select("qid", "entry", F.explode("persons").alias("other")).join(persons.withColumnRenamed("person", "other"), ["qid", "other"], "left_anti")
    told = others.join(by.withColumnRenamed("person", "other"), "other").filter("entry != id").select("qid", "id", F.lit(STEP).alias("part"))
    width = days + 1
    later = advice.filter("venue is not null and day is not null").select("venue", F.col("entry").alias("id"), F.col("day").alias("on"), F.floor(F.col("day") / width).alias("block"))
    begun = met.filter("day is not null").select("qid", "venue", "entry", "day", F.explode(F.array(F.floor(F.col("day") / width), F.floor(F.col("day") / width) + 1)).alias("block"))
    gap = F.col("on") - F.col("day")
    near = begun.join(later, ["venue", "block"]).filter((gap >= 0) & (gap <= days) & (F.col("entry") != F.col("id"))).select("qid", "id", (STEP / (1 + gap / 30.0)).alias("part"))
    return direct.unionByName(first).unionByName(told).unionByName(near).groupBy("qid", "id").agg(exact_sum(F.col("part")).alias("score"))


def anchors(asked: DataFrame, edges: DataFrame, n_entries: int) -> DataFrame:
    """(qid, phrase, df): phrases of questions (qid, phrase) in at most a quarter of all entries."""
    df = edges.groupBy("phrase").agg(F.count("*").alias("df")).filter(F.col("df") <= max(n_entries // 4, 1))
    return asked.select("qid", "phrase").distinct().join(df, "phrase").select("qid", "phrase", "df")


def seeds(anchored: DataFrame, edges: DataFrame, n_entries: int) -> DataFrame:
    """(qid, id, score): entries that mention a phrase asked for, by how telling it is."""
    return anchored.join(edges.select("phrase", F.col("entry").alias("id")), "phrase").groupBy("qid", "id").agg(exact_sum(idf(float(max(n_entries, 1)), F.col("df"))).alias("score"))


def entity_walk(anchored: DataFrame, edges: DataFrame, n_entries: int) -> DataFrame:
    """(qid, id, score): seeds and what is one shared mention from them."""
    begun = seeds(anchored, edges, n_entries)
    hops = comention_hop(begun, edges, anchored.select("qid", "phrase"), max(n_entries, 1))
    return begun.unionByName(hops).groupBy("qid", "id").agg(exact_sum(F.col("score")).alias("score"))


def fact_walk(anchored: DataFrame, edges: DataFrame, facts: DataFrame, n_entries: int, most: int = HUB) -> DataFrame:
    """(qid, id, score): seeds, and other entries with a fact about what a fact joins to a phrase asked for."""
    begun = seeds(anchored, edges, n_entries)
    ends = triple_ends(facts)
    asserting = ends.select(F.col("name").alias("bridge"), F.col("entry").alias("id")).distinct()
    df = asserting.groupBy("bridge").agg(F.count("*").alias("df")).filter(F.col("df") <= most)
    bridges = anchored.select("qid", F.col("phrase").alias("name")).join(ends.select("name", F.col("other").alias("bridge")).distinct(), "name").join(df, "bridge")
    hops = bridges.join(asserting, "bridge").join(begun.select("qid", "id"), ["qid", "id"], "left_anti")
    scored = hops.groupBy("qid", "id").agg(exact_sum(0.5 * idf(float(max(n_entries, 1)), F.col("df"))).alias("score"))
    return begun.unionByName(scored)


def fused(walk: DataFrame, words: DataFrame, k: int) -> DataFrame:
    """(qid, id, score, rank): a walk's whole ranking and one by words, fused from rank 0."""
    return reciprocal_ranks([ranked(walk), words], 0, WHOLE, k)


def tier_selected(texts: DataFrame, persons: DataFrame, venues: DataFrame, cues: list[str]) -> DataFrame:
    """(id): entries that an expensive reader should see: a cue and a venue, but no person named.

    ``persons`` and ``venues`` have (entry, phrase) of mentions.
    """
    cued = texts.filter(relational(F.col("text"), cues)).select("id")
    return cued.join(venues.select(F.col("entry").alias("id")).distinct(), "id", "left_semi").join(persons.select(F.col("entry").alias("id")).distinct(), "id", "left_anti")


def gazetteer(names: DataFrame, venues: DataFrame) -> DataFrame:
    """(phrase, kind, name): names and venues by lower-cased phrase; of equal ones a name, the first in order, wins."""
    both = names.select("name", F.lit(0).alias("nth")).unionByName(venues.select("name", F.lit(1).alias("nth"))).filter("name is not null and name != ''")
    best = both.groupBy(F.lower("name").alias("phrase")).agg(F.min(F.struct("nth", "name")).alias("first"))
    return best.select("phrase", F.when(F.col("first.nth") == 0, "entity").otherwise("venue").alias("kind"), F.col("first.name").alias("name"))
