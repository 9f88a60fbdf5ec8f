"""Small fixtures of operators that the queries don't reach."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorespark.functions import random as numbers
from lorespark.functions import text as tx
from lorespark.operators import insight, ledger, relations, search, store
from lorespark.operators.vector_index import LevelCodes, ListIndex, auto_lists, plane_estimate, resident_bytes
from lorespark.plans import service
from lorespark.sources import readers
from lorespark.sources.generator import synthetic_vectors


def test_splitmix_is_the_public_sequence():
    assert [hex(x) for x in numbers.splitmix(0, 2).tolist()] == ["0xe220a8397b1dcdaf", "0x6e789e6aa1b965f4"]
    u, z = numbers.units(3, 10_000), numbers.normals(3, 10_000)
    assert 0 <= u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.02
    assert abs(z.mean()) < 0.05 and abs(z.std() - 1) < 0.05


def test_codes_estimate_products():
    rng = np.random.default_rng(1)
    v, q = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (rng.standard_normal((400, 64)), rng.standard_normal((5, 64))))
    signs = search.SignCodes.fit(v)
    bits, factor = signs.encode(v)
    plain = signs.estimate(q, bits, factor)
    packed = np.packbits(bits, axis=1, bitorder="little")
    assert np.abs(plane_estimate(signs, q, packed, factor) - plain).mean() < 0.02  # a query has 16 levels
    errors = []
    for count in (1, 3, 5, 7):
        codec = LevelCodes(signs, count)
        errors.append(np.abs(codec.estimate(q, *codec.encode(v)) - q @ v.T).mean())
    assert errors == sorted(errors, reverse=True) and errors[-1] < 0.01


def test_list_index_is_written_opened_and_pruned(spark, tmp_path):
    v = synthetic_vectors(spark, 3000, 32)
    asked = search.queries_of(v)
    ListIndex.build(v, str(tmp_path / "i"), 40)
    index = ListIndex.open(spark, str(tmp_path / "i"))
    found = index.search(v, asked, 10, 4, 100)
    assert search.recall(found, search.exact_nearest(v, asked, 10)).first().recall >= 0.95
    assert "PartitionFilters: [isnotnull(list_id" in index.rows([1, 2])._jdf.queryExecution().toString() or "list_id" in index.rows([1, 2])._jdf.queryExecution().executedPlan().toString()
    assert index.rows([1, 2]).count() < 3000 / 4
    spark.read.parquet(str(tmp_path / "i/centres")).withColumn("version", F.lit(9)).write.parquet(str(tmp_path / "j/centres"))
    with pytest.raises(ValueError):
        ListIndex.open(spark, str(tmp_path / "j"))
    assert [auto_lists(n) for n in (0, 10_000, 10**12)] == [64, 400, 65_536] and resident_bytes(1, 8) > 0


def test_raw_vectors_go_on_from_file_to_file(spark, tmp_path):
    rows = np.arange(60, dtype="<f4").reshape(15, 4)
    (tmp_path / "a.bin").write_bytes(rows[:10].tobytes())
    (tmp_path / "b.bin").write_bytes(rows[10:].tobytes())
    got = {r.vec_id: r.embedding for r in readers.raw_vectors(spark, str(tmp_path), 4, rows_at_once=3).collect()}
    assert [got[i] for i in range(15)] == rows.tolist()
    assert sorted(r.vec_id for r in readers.raw_vectors(spark, str(tmp_path), 4, limit=12).collect()) == list(range(12))
    entries = spark.createDataFrame([(i * 7,) for i in range(15)], "id long")
    back = {r.id: r.embedding for r in readers.replayed_vectors(readers.raw_vectors(spark, str(tmp_path), 4), entries, 4).collect()}
    assert back[14] == rows[2].tolist()
    with pytest.raises(ValueError):
        readers.replayed_vectors(readers.raw_vectors(spark, str(tmp_path), 4), entries.limit(3), 4)
    (tmp_path / "c.bin").write_bytes(b"123")
    with pytest.raises(ValueError):
        readers.raw_vectors(spark, str(tmp_path), 4)


def test_relations_by_hand(spark):
    entries = spark.createDataFrame([(1, 0), (2, 30), (3, 200), (4, 10)], "id long, day int")
    edges = spark.createDataFrame([(1, "Ann", "introduced", "Bo"), (1, "Ann", "was_at", "The Pier"), (2, "Cy", "recommended", "Dune"), (2, "Cy", "was_at", "the pier"), (3, "Cy", "recommended", "Emma"), (3, "Cy", "was_at", "the pier"), (4, "Bo", "recommended", "Lolita")], "entry long, subj string, rel string, obj string")
    intros, advice = relations.typed_facts(edges, entries)
    got = {r.id: r.score for r in relations.relation_scores(spark.createDataFrame([(0, "ann")], "qid int, person string"), intros, advice).collect()}
    assert got == {1: 3.0, 4: 3.0, 2: 1.5}
    direct = {r.id: r.score for r in relations.relation_scores(spark.createDataFrame([(0, "cy")], "qid int, person string"), intros, advice).collect()}
    assert direct == {2: 2.0, 3: 2.0}


def test_findings_keep_to_their_evidence(spark):
    mentions = spark.createDataFrame([("p", "a", 1), ("p", "a", 2), ("p", "b", 3), ("p", "b", 4)] + [(f"o{i}", "c", 10 + i) for i in range(60)] + [(f"o{i}", "c", 100 + i) for i in range(60)], "entity string, cluster string, entry long")
    found = insight.discovered(insight.bridge_candidates(mentions), {"bridge": 0.05})
    row = found.first()
    assert found.count() == 1 and row.entity == "p" and row.citations == [1, 2, 3, 4] and row.id == 1 << 56
    told = lambda cites: spark.createDataFrame([(1 << 56, "told", cites)], "id long, text string, citations array<long>")
    assert insight.discovered(insight.bridge_candidates(mentions), {"bridge": 0.05}, told([1, 3])).first().text == "told"
    assert insight.discovered(insight.bridge_candidates(mentions), {"bridge": 0.05}, told([9])).count() == 0
    entries = spark.createDataFrame([(i, f"t{i % 2}") for i in range(5)], "id long, text string")
    assert insight.finding_derivations(found, entries).count() == 2


def test_outdated_methods_make_all_that_follows_stale(spark):
    rows = spark.createDataFrame([("b", "a", 1, 1), ("c", "b", 2, 1), ("d", "x", 2, 1)], "output string, input string, method_id int, method_version long")
    current = spark.createDataFrame([(1, 2), (2, 1)], "method_id int, version long")
    changed = spark.createDataFrame([("k", "x"), ("m", "nothing")], "change string, item string")
    got = sorted(tuple(r) for r in ledger.stale_outputs(rows, changed, current).collect())
    assert got == [("k", "b"), ("k", "c"), ("k", "d"), ("m", "b"), ("m", "c")]
    assert [tuple(r) for r in ledger.stale_outputs(rows, changed).collect()] == [("k", "d")]


def test_store_helpers(spark):
    rows = spark.createDataFrame([(i,) for i in (3, 1, 2, 2, None)], "id int")
    assert sorted(r.id for r in store.tail(rows, "id", 2).collect()) == [2, 2, 3]
    counts = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "k string, n long")
    assert sorted(tuple(r) for r in store.parted(counts, 10, "k", "n").collect()) == [("a", 4), ("b", 3), ("c", 3)]
    runs = [spark.createDataFrame([("h", i)], "hash string, event_id int") for i in range(9)]
    assert len(store.merged_runs(runs[:8])) == 8 and store.merged_runs(runs)[0].first().event_id == 0
    short = spark.createDataFrame([(bytearray(b"abc"),)], "r binary").select(*(c.alias(f"c{i}") for i, c in enumerate(tx.record_fields(F.col("r"))))).first()
    assert list(short) == [None, None, None]


def test_service_checks_arguments(spark):
    entries = spark.createDataFrame([(1, "2018-01-01", "tea at the pier"), (2, None, "a boat")], "id long, date string, text string")
    asked = service.Service(entries, service.Lexical(entries))
    call = lambda name, **arguments: asked.handle({"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": name, "arguments": arguments}})
    good = call("assemble_context", query="tea", token_budget=100)["result"]
    assert good["isError"] is False and "tea at the pier" in good["content"][0]["text"]
    for bad in (call("search"), call("search", query=3), call("search", query="x", k=0), call("search", query="x", other=1)):
        assert bad["error"]["code"] == service.PARAMS
    assert asked.handle({"id": 5})["error"]["code"] == service.REQUEST and asked.handle([])["error"]["code"] == service.REQUEST
    assert asked.handle({"id": 1, "method": "initialize", "params": {"protocolVersion": "2025-03-26"}})["result"]["protocolVersion"] == "2025-03-26"
    tools = asked.handle({"id": 1, "method": "tools/list"})["result"]["tools"]
    assert {t["name"]: t["inputSchema"]["required"] for t in tools} == {"search": ["query"], "assemble_context": ["query"], "discover_insights": []}
