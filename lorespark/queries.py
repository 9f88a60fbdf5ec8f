"""One query for each of the engine's operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorespark.functions import text as tx
from lorespark.functions.stats import binomial_tail
from lorespark.functions.vector import shortened
from lorespark.operators import graph, insight, ledger, lexical, metrics, search, store
from lorespark.operators.wordsearch import best_documents
from lorespark.plans import scheduler
from lorespark.session import materialise, table
from lorespark.sources.readers import pooled

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
K = 10


def query(f):
    QUERIES[f.__name__] = f
    return f


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "entries")


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "recall_queries")


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "fact_edges").distinct()


# Words and ranking


@query
def tokenize_tf(spark, sf):
    return lexical.term_frequencies(_entries(spark, sf))


@query
def doc_freq(spark, sf):
    return lexical.document_frequencies(lexical.term_frequencies(_entries(spark, sf)))


@query
def corpus_stats(spark, sf):
    s = lexical.corpus_stats(lexical.document_lengths(_entries(spark, sf)))
    return s.select("n_docs", "total_len", F.round("avgdl", 6).alias("avgdl"))


@query
def bm25_topk(spark, sf):
    return lexical.Bm25.index(_entries(spark, sf)).search(_asked(spark, sf), K)


def overlap_ranking(spark, sf, k):
    """Entries by how many different words they share with the question."""
    return best_documents(_entries(spark, sf), _asked(spark, sf), k, "id", "text", "id", "question", None)


@query
def overlap_topk(spark, sf):
    return overlap_ranking(spark, sf, K)


def _fused(spark, sf, base):
    depth = max(5 * K, 50)
    return lexical.reciprocal_ranks([lexical.Bm25.index(_entries(spark, sf)).search(_asked(spark, sf), depth), overlap_ranking(spark, sf, depth)], base, depth, K)


@query
def rrf_one_based(spark, sf):
    return _fused(spark, sf, 1)


@query
def rrf_zero_based(spark, sf):
    return _fused(spark, sf, 0)


# Metrics


@query
def recall_at_k(spark, sf):
    return metrics.at_k(bm25_topk(spark, sf), _asked(spark, sf), K).select("qid", "recall")


@query
def precision_at_k(spark, sf):
    return metrics.at_k(bm25_topk(spark, sf), _asked(spark, sf), K).select("qid", "precision")


@query
def ndcg_at_k(spark, sf):
    return metrics.at_k(bm25_topk(spark, sf), _asked(spark, sf), K).select("qid", "ndcg")


@query
def answer_in_topk(spark, sf):
    return metrics.answered(bm25_topk(spark, sf), _asked(spark, sf), _entries(spark, sf), K)


@query
def jaccard_match(spark, sf):
    """How alike the first ten of two rankings are, for each query."""
    a = bm25_topk(spark, sf).groupBy("qid").agg(F.collect_set("id").alias("a"))
    b = overlap_ranking(spark, sf, K).groupBy("qid").agg(F.collect_set("id").alias("b"))
    return a.join(b, "qid").select("qid", F.round(metrics.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


@query
def metrics_by_type_rollup(spark, sf):
    """Mean metrics by the first word of the question, and over all."""
    m = metrics.at_k(bm25_topk(spark, sf), _asked(spark, sf), K)
    kind = F.coalesce(F.lower(F.regexp_extract("question", r"^([A-Za-z]+)", 1)), F.lit(""))
    typed = m.join(_asked(spark, sf).select(F.col("id").alias("qid"), kind.alias("type")), "qid")
    return typed.rollup("type").agg(F.count("*").alias("n"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("ndcg"), 6).alias("ndcg"))


@query
def latency_percentiles(spark, sf):
    return metrics.nearest_rank(table(spark, sf, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


# Store


@query
def sentence_units(spark, sf):
    return store.sentence_units(table(spark, sf, "events_l0"))


@query
def event_dedup(spark, sf):
    return store.distinct_events(table(spark, sf, "events_l0"))


@query
def append_batch(spark, sf):
    """Events of later batches that the first doesn't hold."""
    events = table(spark, sf, "events_l0")
    return store.append_events(events.filter("batch_id = 0"), events.filter("batch_id > 0")).select("event_id", "batch_id")


@query
def unit_validation(spark, sf):
    return store.unit_status(table(spark, sf, "units"), table(spark, sf, "events_l0"))


@query
def unit_texts(spark, sf):
    return store.unit_texts(table(spark, sf, "units"), table(spark, sf, "events_l0")).select("unit_id", "event_id", F.octet_length("text").alias("n_bytes"))


@query
def last_wins_log(spark, sf):
    """The newest run of each entry's extraction."""
    log = table(spark, sf, "extractions").select("entry", "v", "model", F.coalesce(F.size("entities"), F.lit(-1)).alias("n_entities"))
    return store.last_wins(log.withColumn("n_entities", F.greatest("n_entities", F.lit(0))), ["entry"], ["v", "model", "n_entities"])


@query
def id_assignment(spark, sf):
    """Entries numbered by day, then id."""
    rows = _entries(spark, sf).filter("day is not null").select("id", "day")
    return store.dense_ids(rows, ["day", "id"])


@query
def pooled_offsets(spark, sf):
    """Entries of each kind numbered one after another."""
    rows = _entries(spark, sf).select(F.coalesce("kind", F.lit("")).alias("instance"), F.col("id").alias("entry"))
    numbered = rows.withColumn("id", F.row_number().over(Window.partitionBy("instance").orderBy("entry")) - 1)
    return pooled(numbered).select("instance", "entry", "global_id")


@query
def dates_of_days(spark, sf):
    return _entries(spark, sf).select("id", F.date_format(tx.date_of_day(F.col("day")), "yyyy-MM-dd").alias("iso"), F.floor(F.col("day") / 365).alias("year"))


# Graph


def places(spark, sf):
    return _edges(spark, sf).filter("rel = 'was_at'").select(F.lower(F.trim("obj")).alias("phrase")).filter("phrase like 'the %'").distinct()


@query
def gazetteer_mentions(spark, sf):
    return graph.mentions(_entries(spark, sf), places(spark, sf))


@query
def word_bounded_mentions(spark, sf):
    """Entries that hold the word of a topic, with no letter or number beside it."""
    topics = ["coffee", "sleep", "chess", "budget", "soup"]
    rows = _entries(spark, sf).select("id", F.lower("text").alias("t"), F.explode(F.array(*map(F.lit, topics))).alias("topic"))
    return rows.filter(tx.contains_word(F.col("t"), F.col("topic"))).select("id", "topic")


def _entity_edges(spark, sf):
    rows = table(spark, sf, "extractions").select("entry", F.explode("entities").alias("e")).select("entry", F.lower(F.trim("e")).alias("phrase"))
    return rows.filter("octet_length(phrase) >= 2").distinct()


@query
def hub_guard(spark, sf):
    return graph.without_hubs(_entity_edges(spark, sf))


@query
def comention_one_hop(spark, sf):
    n = _entries(spark, sf).count()
    seeds = bm25_topk(spark, sf).select("qid", "id", "score")
    asked = _asked(spark, sf).select(F.col("id").alias("qid"), F.explode(tx.tokens(F.col("question"))).alias("phrase")).distinct()
    return graph.comention_hop(seeds, _entity_edges(spark, sf), asked, n)


@query
def intro_rec_person_join(spark, sf):
    return graph.introduced_then_advised(_edges(spark, sf))


@query
def venue_interval_join(spark, sf):
    return graph.met_then_advised(_edges(spark, sf), _entries(spark, sf))


@query
def triple_two_hop(spark, sf):
    edges = _edges(spark, sf)
    anchors = edges.filter("rel = 'introduced'").select(F.lower(F.trim("subj")).alias("name"))
    return graph.fact_hops(edges, anchors, _entries(spark, sf).count())


@query
def prefix_canon(spark, sf):
    names = table(spark, sf, "fact_edges").select(tx.normalised_name(F.col("subj")).alias("name"))
    return graph.prefix_forms(names)


@query
def context_budget(spark, sf):
    return graph.context_prefix(bm25_topk(spark, sf), _entries(spark, sf), 120)


# Insight


def _topics(spark, sf):
    return _edges(spark, sf).filter("rel in ('talked_about', 'thinks_about', 'works_on', 'likes') and subj is not null and obj is not null").select(F.col("subj").alias("entity"), F.col("obj").alias("cluster"), "entry")


@query
def entity_cluster_profile(spark, sf):
    return insight.cluster_profile(_topics(spark, sf))


@query
def structural_bridge(spark, sf):
    return insight.structural_bridges(_topics(spark, sf))


@query
def naive_comention(spark, sf):
    return insight.naive_bridges(_topics(spark, sf))


@query
def binomial_tails(spark, sf):
    """The tail of each person's share of each topic."""
    p = insight.cluster_profile(_topics(spark, sf))
    total = p.groupBy("entity").agg(F.sum("n").alias("total"))
    return p.join(total, "entity").select("entity", "cluster", F.round(binomial_tail(F.col("total"), F.col("n"), F.lit(0.1)), 5).alias("tail"))


@query
def bh_fdr(spark, sf):
    return insight.false_discovery(insight.structural_bridges(_topics(spark, sf)).select(F.col("entity").alias("id"), "p_value"), 0.2)


@query
def bh_fdr_per_kind(spark, sf):
    c = insight.structural_bridges(_topics(spark, sf)).select(F.col("entity").alias("id"), "p_value", (F.col("spread") > 2).alias("kind"))
    return insight.false_discovery(c, 0.2, "kind")


def _place_days(spark, sf):
    at = _edges(spark, sf).filter("rel = 'was_at' and lower(obj) like 'the %'").select(F.lower("obj").alias("entity"), "entry").distinct()
    return at.join(_entries(spark, sf).select(F.col("id").alias("entry"), "day"), "entry")


@query
def lag_alignment(spark, sf):
    return insight.lag_counts(_place_days(spark, sf))


@query
def best_lag(spark, sf):
    return insight.best_lags(insight.lag_counts(_place_days(spark, sf)))


@query
def circular_shift_p(spark, sf):
    return insight.temporal_leads(_place_days(spark, sf))


@query
def circular_shift_loose(spark, sf):
    """The same for pairs of which fewer mentions need to be followed."""
    return insight.temporal_leads(_place_days(spark, sf), min_ratio=0.05)


@query
def lead_evidence(spark, sf):
    rows = _place_days(spark, sf)
    return insight.lead_evidence(insight.best_lags(insight.lag_counts(rows)), rows)


@query
def contradiction_reversal(spark, sf):
    day = _entries(spark, sf).select(F.col("id").alias("entry"), "day")
    said = lambda rels: _edges(spark, sf).filter(F.col("rel").isin(rels) & F.col("obj").isNotNull()).select(F.col("obj").alias("entity"), "entry").join(day, "entry").distinct()
    found = insight.reversals(said(["works_with", "joins", "congratulated"]), said(["avoids", "disagrees_with", "complains_to"]))
    return found.select("entity", "praised", "regretted", F.size("evidence").alias("n_evidence"))


@query
def citation_check(spark, sf):
    """Answers of rankings checked against judged entries: all cited must be judged relevant."""
    judged = _asked(spark, sf).filter("relevant_entries is not null").select("id", F.col("relevant_entries").alias("evidence"))
    top = bm25_topk(spark, sf).filter("rank = 1").select(F.col("qid").alias("id"), F.lit("").alias("text"), F.array("id").alias("citations"))
    return insight.cited(top, judged).select("id", F.col("citations")[0].alias("cited"))


# Ledger


def _derivations(spark, sf):
    """Orders are derived from their lines, customers from orders, nations from customers, regions from nations."""
    key = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    line = F.concat(F.lit("l"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
    parts = [
        table(spark, sf, "lineitem").select(key("o", "l_orderkey").alias("output"), line.alias("input")),
        table(spark, sf, "orders").select(key("c", "o_custkey").alias("output"), key("o", "o_orderkey").alias("input")),
        table(spark, sf, "customer").select(key("n", "c_nationkey").alias("output"), key("c", "c_custkey").alias("input")),
        table(spark, sf, "nation").select(key("r", "n_regionkey").alias("output"), key("n", "n_nationkey").alias("input")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _changes(spark, sf):
    return table(spark, sf, "lineitem").filter("l_quantity >= 50 and l_discount >= 0.1").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("change"), F.concat(F.lit("l"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("item"))


@query
def stale_closure(spark, sf):
    return ledger.stale_outputs(_derivations(spark, sf), _changes(spark, sf))


@query
def staleness_score(spark, sf):
    """How well direct dependents alone tell what is stale."""
    truth = materialise(stale_closure(spark, sf)).groupBy("change").agg(F.collect_set("output").alias("truth"))
    direct = _changes(spark, sf).join(_derivations(spark, sf).withColumnRenamed("input", "item"), "item").groupBy("change").agg(F.collect_set("output").alias("flagged"))
    recall, over = metrics.staleness_scores(F.col("flagged"), F.col("truth"))
    return truth.join(direct, "change").select("change", F.round(recall, 6).alias("recall"), F.round(over, 6).alias("over"))


@query
def fan_out(spark, sf):
    by = stale_closure(spark, sf).groupBy("change").agg(F.count("*").alias("n"))
    return by.agg(F.round(F.avg("n"), 6).alias("mean"), F.max("n").alias("most"))


@query
def scheduler_order(spark, sf):
    jobs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("queue"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), F.col("o_orderkey").alias("seq"))
    return scheduler.run_order(jobs).select("job_id", "queue", "position")


# Vectors


def _vectors(spark, sf):
    return table(spark, sf, "embeddings")


@query
def exact_knn(spark, sf):
    return search.exact_nearest(_vectors(spark, sf), search.queries_of(_vectors(spark, sf)), K)


@query
def matryoshka_knn(spark, sf):
    short = _vectors(spark, sf).select("vec_id", shortened(F.col("embedding"), 32).alias("embedding"))
    return search.exact_nearest(short, search.queries_of(short), K)


@query
def int8_knn(spark, sf):
    v = _vectors(spark, sf)
    ranges = search.dimension_range(v)
    codes = search.int8_codes(v, ranges).select(F.col("id").alias("vec_id"), search.decoded(F.col("codes"), ranges).alias("embedding"))
    return search.exact_nearest(codes, search.queries_of(v), K)


@query
def mean_pool(spark, sf):
    return search.mean_vectors(_vectors(spark, sf), "label").select("label", F.posexplode("mean").alias("pos", "x")).select("label", "pos", F.round("x", 6).alias("x"))


@query
def coarse_to_fine(spark, sf):
    return search.coarse_to_fine(_vectors(spark, sf), search.queries_of(_vectors(spark, sf)), "label", 3, K)


@query
def two_stage_knn(spark, sf):
    return search.two_stage(_vectors(spark, sf), search.queries_of(_vectors(spark, sf)), K, 20 * K)


@query
def ivf_knn(spark, sf):
    v = _vectors(spark, sf)
    return search.by_lists(v, search.queries_of(v), K, 32, 16)


@query
def product_knn(spark, sf):
    v = _vectors(spark, sf)
    return search.product_two_stage(v, search.queries_of(v), K, 20 * K, 16)


@query
def ann_recall(spark, sf):
    """Recall of the searches that are not exact."""
    truth = materialise(exact_knn(spark, sf))
    parts = [search.recall(f(spark, sf), truth).select(F.lit(name).alias("system"), F.round("recall", 6).alias("recall")) for name, f in (("two_stage", two_stage_knn), ("lists", ivf_knn), ("product", product_knn), ("int8", int8_knn))]
    return reduce(DataFrame.unionByName, parts)


@query
def semantic_topk(spark, sf):
    """Entries by the hashed embedding of their words."""
    v = search.hash_embedding(_entries(spark, sf))
    q = search.hash_embedding(_asked(spark, sf).select("id", F.col("question").alias("text"))).select(F.col("id").cast("bigint").alias("qid"), F.col("embedding").alias("q"))
    return search.exact_nearest(v, q, K, "id", "embedding")


@query
def hybrid_topk(spark, sf):
    """The flagship: words and hashed embeddings, fused."""
    depth = 50
    v = search.hash_embedding(_entries(spark, sf))
    q = search.hash_embedding(_asked(spark, sf).select("id", F.col("question").alias("text"))).select(F.col("id").cast("bigint").alias("qid"), F.col("embedding").alias("q"))
    dense = search.exact_nearest(v, q, depth, "id", "embedding").select(F.col("qid").cast("int").alias("qid"), "id", "score", "rank")
    return lexical.reciprocal_ranks([lexical.Bm25.index(_entries(spark, sf)).search(_asked(spark, sf), depth), dense], 1, depth, K)


@query
def scheduler_simulation(spark, sf):
    """Two jobs over a timeline that is blocked for a while."""
    jobs = [scheduler.Job("a", 5, 30), scheduler.Job("b", 3, 20)]
    return scheduler.simulate(spark, jobs, [(0, 2, True, True, True), (2, 4, False, True, True), (4, 9, True, True, True)], 10)
