"""Evaluation jobs: how systems, codecs and detectors do on tables with known answers."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.operators import graph, insight, metrics, search
from lorespark.plans.service import Retrieval
from lorespark.session import materialise


def retrieval(systems: dict[str, Retrieval], queries: DataFrame, entries: DataFrame, k: int = 10, by: str | None = None) -> DataFrame:
    """(system, by, n, recall, precision, ndcg, answered) of each system; over all and by a column."""
    parts = []
    for name, system in systems.items():
        found = materialise(system.search(queries, k))
        rows = metrics.at_k(found, queries, k).join(metrics.answered(found, queries, entries, k), "qid", "left")
        if by:
            rows = rows.join(queries.select(F.col("id").alias("qid"), F.col(by)), "qid")
        means = [F.round(F.avg(c), 6).alias(c) for c in ("recall", "precision", "ndcg")]
        hit = F.round(F.avg(F.col("hit").cast("double")), 6).alias("answered")
        grouped = rows.rollup(by) if by else rows.groupBy()
        parts.append(grouped.agg(F.count("*").alias("n"), *means, hit).withColumn("system", F.lit(name)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def context_sufficiency(system: Retrieval, queries: DataFrame, entries: DataFrame, budget: int = 512) -> DataFrame:
    """One row: the share of queries whose budgeted context holds the answer."""
    kept = graph.context_prefix(system.search(queries, 64), entries, budget)
    return metrics.answered(kept, queries, entries, 64).agg(F.round(F.avg(F.col("hit").cast("double")), 6).alias("sufficient"))


def codecs(vectors: DataFrame, k: int = 10, id_col: str = "vec_id", v_col: str = "embedding") -> DataFrame:
    """(codec, recall, bytes_per_vector) against exact search, for the rows with ids divisible by 20."""
    queries = search.queries_of(vectors, id_col, v_col)
    truth = materialise(search.exact_nearest(vectors, queries, k, id_col, v_col))
    dim = vectors.select(F.size(v_col)).first()[0]
    ranges = search.dimension_range(vectors, v_col)
    int8 = search.int8_codes(vectors, ranges, id_col, v_col).select(F.col("id").alias(id_col), search.decoded(F.col("codes"), ranges).alias(v_col))
    found = {
        "float": (truth, 4.0 * dim),
        "int8": (search.exact_nearest(int8, queries, k, id_col, v_col), float(dim)),
        "product": (search.product_two_stage(vectors, queries, k, 20 * k, max(1, dim // 4), 256, id_col, v_col), dim / 4.0),
        "sign_two_stage": (search.two_stage(vectors, queries, k, 20 * k, id_col, v_col), dim / 8.0 + 4),
    }
    parts = [search.recall(f, truth).select(F.lit(name).alias("codec"), F.round("recall", 6).alias("recall"), F.lit(size).alias("bytes_per_vector")) for name, (f, size) in found.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def lead_scores(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: the share of planted leads that were found with the right direction."""
    hits = truth.join(found.select(F.col("a").alias("leading"), F.col("b").alias("trailing"), F.lit(1).alias("hit")).distinct(), ["leading", "trailing"], "left")
    return hits.agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("recall"))


def reversal_scores(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: the share of planted reversals of which both entries are cited."""
    cited = truth.join(found.select(F.col("entity").alias("topic"), "evidence"), "topic", "left")
    good = F.array_contains("evidence", F.col("entry_before")) & F.array_contains("evidence", F.col("entry_after"))
    return cited.agg(F.round(F.avg(F.coalesce(good, F.lit(False)).cast("double")), 6).alias("recall"))


def detectors(tables: dict[str, DataFrame], topics: dict[str, list[str]], tools: list[str], praise: list[str], regret: list[str]) -> dict[str, DataFrame]:
    """Leads and reversals that the detectors find in generated tables; cues and lexicon are parameters."""
    entries = tables["entries"]
    spark = entries.sparkSession
    named = graph.mentions(entries, spark.createDataFrame([(t,) for t in tools], "phrase string"))
    days = named.select(F.col("phrase").alias("entity"), "entry").join(entries.select(F.col("id").alias("entry"), "day"), "entry")
    text = entries.select(F.col("id").alias("entry"), F.lower("text").alias("t"))
    said = lambda cues: days.join(text, "entry").filter(F.exists(F.array(*map(F.lit, cues)), lambda c: F.contains("t", F.concat("entity", F.lit(" "), c)) | F.contains("t", F.concat(c, F.lit(" "), "entity")))).select("entity", "day", "entry")
    cluster = spark.createDataFrame([(w, c) for c, ws in topics.items() for w in ws], "phrase string, cluster string")
    about = graph.mentions(entries, cluster).join(cluster, "phrase").select("entry", "cluster")
    return {"leads": insight.temporal_leads(days), "reversals": insight.reversals(said(praise), said(regret)), "topics": about}


def timed(spark: SparkSession, jobs: dict) -> DataFrame:
    """(job, rows, seconds) of functions that return a DataFrame."""
    rows = []
    for name, job in jobs.items():
        began = time.time()
        rows.append((name, job().count(), round(time.time() - began, 3)))
    return spark.createDataFrame(rows, "job string, rows bigint, seconds double")
