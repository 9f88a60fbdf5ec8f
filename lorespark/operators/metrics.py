"""How good rankings and findings are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def judged(queries: DataFrame, id_col: str = "id", relevant: str = "relevant_entries") -> DataFrame:
    """(qid, id): one row for each different relevant entry of a judged query."""
    return queries.select(F.col(id_col).alias("qid"), F.explode(relevant).alias("id")).filter("id is not null").distinct()


def at_k(rankings: DataFrame, queries: DataFrame, k: int, id_col: str = "id", relevant: str = "relevant_entries") -> DataFrame:
    """(qid, recall, precision, ndcg) of each judged query for its first k.

    Precision divides by k even if fewer came out.  A query judged to have no relevant entry has
    recall 0 and ndcg 0; one without judgement has no row.
    """
    all_ = queries.filter(F.col(relevant).isNotNull()).select(F.col(id_col).alias("qid"))
    qrels = judged(queries, id_col, relevant)
    wanted = qrels.groupBy("qid").agg(F.count("*").alias("wanted"))
    hits = rankings.filter(F.col("rank") <= k).join(qrels, ["qid", "id"]).groupBy("qid").agg(F.count("*").alias("hits"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("gain"))
    rows = all_.join(wanted, "qid", "left").join(hits, "qid", "left").fillna(0)
    ideal = F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.greatest(F.least(F.col("wanted"), F.lit(k)), F.lit(1))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    some = F.col("wanted") > 0
    return rows.select(
        "qid",
        F.round(F.when(some, F.col("hits") / F.col("wanted")).otherwise(0.0), 6).alias("recall"),
        F.round(F.col("hits") / float(k), 6).alias("precision"),
        F.round(F.when(some, F.col("gain") / ideal).otherwise(0.0), 6).alias("ndcg"),
    )


def answered(rankings: DataFrame, queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(qid, hit): whether a text among the first k holds the answer, whatever the case."""
    asked = queries.filter("answer is not null and answer != ''").select(F.col("id").alias("qid"), F.lower("answer").alias("answer"))
    found = rankings.filter(F.col("rank") <= k).join(docs.select("id", F.lower("text").alias("text")), "id").join(asked, "qid")
    hits = found.groupBy("qid").agg(F.max(F.contains("text", F.col("answer"))).alias("hit"))
    return asked.select("qid").join(hits, "qid", "left").select("qid", F.coalesce("hit", F.lit(False)).alias("hit"))


def jaccard(a: Column, b: Column) -> Column:
    """The share of elements that two arrays have in common; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def staleness_scores(flagged: Column, truth: Column) -> tuple[Column, Column]:
    """Recall of stale outputs (1 if there are none) and the share flagged in vain (0 if none is)."""
    f, t = F.array_distinct(flagged), F.array_distinct(truth)
    recall = F.when(F.size(t) > 0, F.size(F.array_intersect(f, t)) / F.size(t)).otherwise(1.0)
    over = F.when(F.size(f) > 0, F.size(F.array_except(f, t)) / F.size(f)).otherwise(0.0)
    return recall, over


def nearest_rank(values: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Percentiles by nearest rank: of n values in order the one at round(share * (n - 1)).

    Values are ranked by a window over (by, value) counts, so equal values are aggregated first.
    """
    counts = values.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    order = Window.partitionBy(*by).orderBy(value)
    upto = counts.withColumn("upto", F.sum("n").over(order)).withColumn("total", F.sum("n").over(Window.partitionBy(*by)))
    place = {name: F.floor(share * (F.col("total") - 1) + 0.5) for name, share in shares.items()}
    picks = [F.min(F.when(F.col("upto") > p, F.col(value))).alias(name) for name, p in place.items()]
    return upto.groupBy(*by).agg(F.max("total").alias("n"), *picks, F.max(value).alias("most"))


def insight_scores(found: DataFrame, truth: DataFrame, traps: DataFrame, least: float = 0.3) -> DataFrame:
    """One row (surfaced, matched, precision, recall, false_rate, trap_hits).

    ``found`` and ``truth`` hold (id, entity, evidence).  A finding matches a truth with the same
    entity or with evidence at least ``least`` alike.  Candidates of a match share an entity or a
    piece of evidence, so both are joined on those instead of all with all.
    """
    f = found.select(F.col("id").alias("fid"), F.col("entity").alias("fe"), F.col("evidence").alias("fv"))
    t = truth.select(F.col("id").alias("tid"), F.col("entity").alias("te"), F.col("evidence").alias("tv"))
    same = f.join(t, F.col("fe") == F.col("te")).select("fid", "tid")
    shared = f.withColumn("x", F.explode("fv")).join(t.withColumn("x", F.explode("tv")), "x").drop("x").dropDuplicates(["fid", "tid"])
    matches = same.unionByName(shared.filter(jaccard(F.col("fv"), F.col("tv")) >= least).select("fid", "tid")).distinct()
    sizes = found.select(F.lit("f").alias("what")).union(truth.select(F.lit("t"))).union(found.join(traps.select("entity").distinct(), "entity", "left_semi").select(F.lit("x"))).groupBy("what").count()
    n = {r.what: r["count"] for r in sizes.collect()}  # three numbers
    surfaced, truths = n.get("f", 0), n.get("t", 0)
    precision = F.col("right") / float(surfaced) if surfaced else F.lit(None).cast("double")
    return matches.agg(F.countDistinct("fid").alias("right"), F.countDistinct("tid").alias("matched")).select(
        F.lit(surfaced).alias("surfaced"),
        "matched",
        precision.alias("precision"),
        (F.col("matched") / float(truths) if truths else F.lit(0.0)).alias("recall"),
        F.coalesce(1 - precision, F.lit(0.0)).alias("false_rate"),
        F.lit(n.get("x", 0)).alias("trap_hits"),
    )
