import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorespark.operators import graph, insight, ledger, lexical, metrics, search, store
from lorespark.operators.components import connected_components
from lorespark.plans import scheduler


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


DOCS = [(0, 0, "tea and tea"), (1, 1, "coffee at noon"), (2, 2, None), (3, 3, "")]


def test_bm25_counts_words_twice_and_breaks_ties_by_id(spark):
    docs = spark.createDataFrame([*DOCS, (4, 4, "coffee at noon")], "id long, day int, text string")
    asked = spark.createDataFrame([(1, "tea"), (2, "tea tea"), (3, "noon"), (4, None), (5, "nothing")], "id int, question string")
    got = {(r.qid, r.rank): (r.id, r.score) for r in lexical.Bm25.index(docs).search(asked, 3).collect()}
    assert abs(got[2, 1][1] - 2 * got[1, 1][1]) < 1e-5
    assert (got[3, 1][0], got[3, 2][0]) == (1, 4)
    assert {q for q, _ in got} == {1, 2, 3}


def test_empty_index(spark):
    docs = spark.createDataFrame([], "id long, text string")
    asked = spark.createDataFrame([(1, "tea")], "id int, question string")
    index = lexical.Bm25.index(docs)
    assert index.search(asked, 3).count() == 0
    assert rows(index.stats) == [(0, 0, 0.0)]


def test_fusion_bases(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "qid int, id int, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 9)], "qid int, id int, rank int")
    got = rows(lexical.reciprocal_ranks([a, b], 1, 5, 9), "id", "score", "rank")
    assert got == [(10, round(1 / 61, 9), 2), (11, round(1 / 62 + 1 / 61, 9), 1)]
    assert rows(lexical.reciprocal_ranks([a, b], 0, 5, 1), "id", "score") == [(11, round(1 / 61 + 1 / 60, 9))]


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, 7, 1), (1, 8, 2), (2, 9, 1)], "qid int, id long, rank int")
    asked = spark.createDataFrame([(1, [8, 5], "x"), (2, [], "y"), (3, None, "z"), (4, [1], None)], "id int, relevant_entries array<bigint>, answer string")
    got = {r.qid: (r.recall, r.precision, r.ndcg) for r in metrics.at_k(ranked, asked, 2).collect()}
    ideal = 1 + 1 / np.log2(3)
    assert got == {1: (0.5, 0.5, round(1 / np.log2(3) / ideal, 6)), 2: (0, 0, 0), 4: (0, 0, 0)}
    docs = spark.createDataFrame([(7, "an X here"), (9, "no")], "id long, text string")
    assert rows(metrics.answered(ranked, asked, docs, 1)) == [(1, True), (2, False), (3, False)]


def test_percentiles_by_nearest_rank(spark):
    values = [5.0, 1.0, 3.0, 3.0, 9.0, None]
    got = rows(metrics.nearest_rank(spark.createDataFrame([("a", v) for v in values], "g string, v double"), ["g"], "v", {"p50": 0.5, "p95": 0.95}))
    assert got == [("a", 5, 3.0, 9.0, 9.0)]


def test_insight_scores(spark):
    schema = "id int, entity long, evidence array<bigint>"
    found = spark.createDataFrame([(1, 10, [1, 2]), (2, None, [5, 6]), (3, 30, [99])], schema)
    truth = spark.createDataFrame([(1, 10, [7]), (2, 20, [5, 6, 7]), (3, 40, [1000])], schema)
    traps = spark.createDataFrame([(30,)], "entity long")
    got = metrics.insight_scores(found, truth, traps).first()
    assert (got.surfaced, got.matched, got.trap_hits) == (3, 2, 1)
    assert abs(got.precision - 2 / 3) < 1e-9 and abs(got.recall - 2 / 3) < 1e-9


def test_store_keeps_events_once(spark):
    schema = "event_id long, created_utc_secs long, source string, text string"
    held = spark.createDataFrame([(1, 5, "text", "a"), (2, None, None, None)], schema)
    new = spark.createDataFrame([(3, 5, "text", "a"), (4, 5, "text", "b"), (5, 5, "text", "b"), (6, None, None, None), (7, None, "", None)], schema)
    assert rows(store.append_events(held, new), "event_id") == [(4,), (7,)]
    assert rows(store.distinct_events(new)) == [(3, 1), (4, 2), (6, 1), (7, 1)]


def test_units(spark):
    events = spark.createDataFrame([(1, "Hé. Yo"), (2, None)], "event_id long, text string")
    assert rows(store.sentence_units(events)) == [(1, 0, 0, 4), (1, 1, 4, 7)]
    units = spark.createDataFrame([(1, 1, 0, 4), (2, 1, 4, 9), (3, 1, 3, 3), (4, 9, 0, 1), (5, 2, 0, 1), (6, 1, 0, None), (7, 1, -1, 2)], "unit_id long, event_id long, byte_start int, byte_end int")
    assert [s for _, s in rows(store.unit_status(units, events))] == ["ok", "bad_span", "bad_span", "unknown_event", "bad_span", "bad_span", "bad_span"]
    assert rows(store.unit_texts(units, events)) == [(1, 1, "Hé.")]


def test_ids_without_one_task(spark):
    data = [(i, random.Random(i).randrange(50)) for i in range(400)]
    got = store.dense_ids(spark.createDataFrame(data, "id int, day int"), ["day", "id"]).collect()
    assert [r.new_id for r in sorted(got, key=lambda r: (r.day, r.id))] == list(range(400))


def test_last_wins(spark):
    log = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 2, "c"), (2, 1, None)], "entry long, v long, model string")
    assert rows(store.last_wins(log, ["entry"], ["v", "model"])) == [(1, 2, "c"), (2, 1, None)]


def test_components_match_union_find(spark):
    pick = random.Random(3)
    links = [(pick.randrange(300), pick.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5)]
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    got = dict(connected_components(spark.createDataFrame([*links, (None, 1)], "a long, b long").repartition(4)).collect())
    assert got == {x: find(x) for ab in links for x in ab if ab[0] != ab[1]}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    words = connected_components(spark.createDataFrame([("b", "a"), ("c", "b")], "a string, b string"))
    assert rows(words) == [("a", "a"), ("b", "a"), ("c", "a")]


def test_mentions_and_hubs(spark):
    entries = spark.createDataFrame([(1, "At The Mill"), (2, "the millpond"), (3, None), (4, "x")], "id long, text string")
    phrases = spark.createDataFrame([("the mill",), ("The Mill",), ("x",), (None,)], "phrase string")
    edges = graph.mentions(entries, phrases)
    assert rows(edges) == [(1, "the mill"), (2, "the mill")]
    assert graph.without_hubs(edges, 1).count() == 0
    assert graph.mentions(entries, phrases.limit(0)).count() == 0


def test_comention_hop_leaves_out_asked_phrases(spark):
    edges = spark.createDataFrame([(1, "anna"), (1, "mill"), (2, "mill"), (3, "anna")], "entry long, phrase string")
    seeds = spark.createDataFrame([(9, 1, 2.0)], "qid int, id long, score double")
    asked = spark.createDataFrame([(9, "anna")], "qid int, phrase string")
    got = rows(graph.comention_hop(seeds, edges, asked, 4))
    assert got == [(9, 2, round(0.5 * (np.log(4 / 2) + 1) * 2, 6))]


def test_meeting_then_advice(spark):
    edges = spark.createDataFrame([(1, "anna", "introduced", "mark"), (1, "anna", "was_at", "The Mill"), (2, "mark", "recommended", "dune"), (2, "mark", "was_at", "the mill"), (3, "mark", "was_at", "the mill"), (3, "x", "recommended", "y")], "entry long, subj string, rel string, obj string")
    entries = spark.createDataFrame([(1, 5), (2, 95), (3, 96)], "id long, day int")
    assert rows(graph.introduced_then_advised(edges)) == [("anna", "mark", 1, 2, 3.0)]
    assert rows(graph.met_then_advised(edges, entries)) == [("the mill", 1, 2, round(3 / (1 + 90 / 30), 6))]


def test_typed_edges(spark):
    entries = spark.createDataFrame([(1, 0, "Anna introduced me to Mark at the mill"), (2, 3, "the person from the mill suggested Dune")], "id long, day int, text string")
    mention = graph.mentions(entries, spark.createDataFrame([("anna",), ("mark",), ("the mill",)], "phrase string"))
    persons, venues = spark.createDataFrame([("Anna",), ("Mark",)], "phrase string"), spark.createDataFrame([("the mill",)], "phrase string")
    intro, advice = graph.typed_edges(mention, entries, persons, venues, ["introduced"], ["suggested"])
    assert rows(intro) == [(1, ["anna", "mark"], "the mill", 0)]
    log = spark.createDataFrame([(2, ["mark"]), (7, ["x"])], "entry long, resolved_by array<string>")
    assert rows(graph.resolved(advice, log), "entry", "by") == [(2, ["mark"])]


def test_fact_hops_and_prefixes(spark):
    edges = spark.createDataFrame([(1, "Anna", "met", "Mark"), (2, "mark", "likes", "dune"), (3, "Anna", "likes", None)], "entry long, subj string, rel string, obj string")
    anchors = spark.createDataFrame([("anna",)], "name string")
    assert [r[:2] for r in rows(graph.fact_hops(edges, anchors, 3))] == [("anna", 2)]
    names = spark.createDataFrame([("mark",), ("mark twain",), ("mark twin",), ("marks",), ("ab",), (None,)], "name string")
    assert dict(rows(graph.prefix_forms(names))) == {"mark": "mark twain", "mark twain": "mark twain", "mark twin": "mark twin", "marks": "marks"}


def test_context_stops_at_the_budget(spark):
    ranked = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3)], "qid int, id long, rank int")
    entries = spark.createDataFrame([(1, "d", "x" * 40), (2, None, "y" * 400), (3, "d", None)], "id long, date string, text string")
    assert rows(graph.context_prefix(ranked, entries, 20), "id") == [(1,)]


def bh(p, q):
    order = sorted(p)
    cut = max((x for i, x in enumerate(order, 1) if x <= i / len(order) * q), default=None)
    return [cut is not None and x <= cut for x in p]


def test_false_discovery_with_ties(spark):
    pick = random.Random(1)
    p = [round(pick.random() ** 3, 2) for _ in range(60)]
    data = [(i, x, i % 2) for i, x in enumerate(p)]
    df = spark.createDataFrame(data, "id int, p_value double, kind int")
    assert [r.accepted for r in sorted(insight.false_discovery(df, 0.2).collect(), key=lambda r: r.id)] == bh(p, 0.2)
    by = {r.id: r.accepted for r in insight.false_discovery(df, 0.2, "kind").collect()}
    for kind in (0, 1):
        assert [by[i] for i, _, k in data if k == kind] == bh([x for _, x, k in data if k == kind], 0.2)
    assert insight.false_discovery(df.limit(0), 0.2).count() == 0


def test_bridge_beats_hub(spark):
    data = [("bridge", "a", i) for i in range(4)] + [("bridge", "b", 10 + i) for i in range(4)] + [("hub", c, 20 + i) for i, c in enumerate("abcde")] + [("one", "a", 30)] + [("filler", "cde"[i % 3], 100 + i) for i in range(60)]
    got = {r.entity: r for r in insight.structural_bridges(spark.createDataFrame(data, "entity string, cluster string, entry int")).collect()}
    assert got["bridge"].surprise == 1 and got["bridge"].p_value < 0.01 < got["hub"].p_value
    assert "one" not in got


def naive_lags(a, b, max_lag):
    out = {}
    for lag in range(max_lag + 1):
        for nth, d in enumerate(a):
            if any(d + max(lag - 1, 0) <= x <= d + lag + 1 for x in b):
                out.setdefault(lag, [0, 0])[0 if nth % 2 else 1] += 1
    return out


def test_leads_match_a_loop(spark):
    pick = random.Random(5)
    days = {"a": sorted(pick.sample(range(300), 12)), "c": sorted(pick.sample(range(300), 9))}
    days["b"] = sorted({d + 4 for d in days["a"]})
    data = [(e, d, i) for e, ds in days.items() for i, d in enumerate(ds)]
    df = spark.createDataFrame(data, "entity string, day int, entry int")
    for r in insight.lag_counts(df, 10).collect():
        assert [r.selected, r.held_out] == naive_lags(days[r.a], days[r.b], 10)[r.lag]
    lead = {(r.a, r.b): r for r in insight.temporal_leads(df, 10).collect()}
    assert abs(lead["a", "b"].lag - 4) <= 1 and lead["a", "b"].p_value < 0.05
    period = max(d for _, d, _ in data) + 1
    smear = {(d + o) % period for d in days["b"] for o in (-1, 0, 1)}
    held = days["a"][::2]
    seen = naive_lags(days["a"], days["b"], 10)[lead["a", "b"].lag][1]
    want = sum(sum((d + s) % period in smear for d in held) >= seen for s in range(period)) / period
    assert lead["a", "b"].p_value == round(want, 6)
    evidence = insight.lead_evidence(spark.createDataFrame([("a", "b", 4)], "a string, b string, lag int"), df)
    assert evidence.count() == 12


def test_reversal_needs_order(spark):
    schema = "entity string, day int, entry int"
    praise = spark.createDataFrame([("x", 5, 1), ("y", 9, 2)], schema)
    regret = spark.createDataFrame([("x", 7, 3), ("y", 9, 4), ("z", 1, 5)], schema)
    assert rows(insight.reversals(praise, regret)) == [("x", 5, 7, [1, 3])]


def test_citations(spark):
    told = spark.createDataFrame([(1, "t", [1]), (2, "t", []), (3, "t", [9])], "id int, text string, citations array<int>")
    known = spark.createDataFrame([(1, [1, 2]), (2, [1]), (3, [1])], "id int, evidence array<int>")
    assert rows(insight.cited(told, known), "id") == [(1,)]


def test_stale_closure(spark):
    links = [("a", "p", 1, 1), ("c", "a", 1, 1), ("b", "q", 2, 1), ("c", "b", 1, 1), ("e", "d", 3, 5), ("p", "c", 1, 1)]  # with a cycle
    df = spark.createDataFrame(links, "output string, input string, method_id int, method_version long")
    changed = spark.createDataFrame([("one", "p"), ("two", "b"), ("none", "zz")], "change string, item string")
    got = rows(ledger.stale_outputs(df, changed))
    assert [o for c, o in got if c == "one"] == ["a", "c", "p"]
    assert [o for c, o in got if c == "two"] == ["a", "c", "p"]
    methods = spark.createDataFrame([(3, 6), (1, 1)], "method_id int, version long")
    assert ("none", "e") in rows(ledger.stale_outputs(df, changed, methods))
    assert ledger.stale_outputs(df, changed.limit(0)).count() == 0


def blobs(n, dim=64, seed=0):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((12, dim))[rng.integers(12, size=n)] + 0.35 * rng.standard_normal((n, dim))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def test_searches_against_brute_force(spark):
    v = blobs(600)
    df = spark.createDataFrame([(i, [float(y) for y in x], i % 3) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int").repartition(3)
    asked = search.queries_of(df)
    exact = search.exact_nearest(df, asked, 5)
    s = np.round(v.astype(np.float64) @ v.astype(np.float64).T, 6)
    for r in exact.collect():
        order = np.lexsort((np.arange(600), -s[r.qid]))
        assert order[r["rank"] - 1] == r.id
    for found in (search.two_stage(df, asked, 5, 100), search.by_lists(df, asked, 5, 8, 6)):
        assert search.recall(found, exact).first().recall >= 0.9
    codes, books = search.product_codes(df, 16, 32)
    assert search.recall(search.product_search(codes, books, asked, 50), exact).first().recall >= 0.9
    assert search.coarse_to_fine(df, asked, "label", 1, 5).count() == 30 * 5
    assert search.exact_nearest(df.limit(0), asked, 5).count() == 0
    assert search.exact_nearest(df, asked.limit(0), 5).count() == 0


def test_hash_embedding_is_stable(spark):
    df = spark.createDataFrame([(1, "tea coffee"), (2, "coffee tea"), (3, ""), (4, None)], "id int, text string")
    got = {r.id: r.embedding for r in search.hash_embedding(df, 16).collect()}
    assert np.allclose(got[1], got[2]) and np.allclose(got[3], got[4])


def test_scheduler(spark, tmp_path):
    jobs = [scheduler.Job("a", 5, 30), scheduler.Job("b", 3, 20)]
    line = [(0, 2, True, True, True), (2, 4, True, False, True), (4, 9, True, True, True)]
    trace = scheduler.simulate(spark, jobs, line, 10)
    assert [r.action for r in trace.orderBy("tick").collect()] == ["ran"] * 2 + ["blocked"] * 2 + ["ran"] * 3 + ["drained"] * 2
    assert all(scheduler.gate(trace, 10).first())
    s = scheduler.Scheduler()
    s.submit(scheduler.Job("x", 1, 5))
    s.tick(True, 3)
    s.save(str(tmp_path / "jobs"))
    assert scheduler.Scheduler.load(str(tmp_path / "jobs")).pending == 2
    with pytest.raises(RuntimeError):
        scheduler.Scheduler(restored=False).submit(scheduler.Job("x", 1, 5))


def test_product_codes_ranked_again_find_the_nearest(spark):
    v = blobs(600)
    df = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    asked = search.queries_of(df)
    exact = search.exact_nearest(df, asked, 5)
    assert search.recall(search.product_two_stage(df, asked, 5, 100, 16), exact).first().recall >= 0.9
