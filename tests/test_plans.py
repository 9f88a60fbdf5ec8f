import json

import numpy as np
from pyspark.sql import functions as F

from lorespark.__main__ import main
from lorespark.functions.embedders import Encoder, StaticTable, embedded
from lorespark.functions.hashing import fnv1a_hex
from lorespark.functions.subwords import Unigram, WordPiece, pieces
from lorespark.operators import graph
from lorespark.plans import evaluate, service
from lorespark.sources.generator import PEOPLE, PLACES, TOOLS, TOPICS, generate, synthetic_vectors

ENTRIES = [(1, 0, "2018-01-01", "Anna introduced me to Mark at the mill"), (2, 5, "2018-01-06", "advice from the mill: read Dune"), (3, 6, None, None), (4, 7, "2018-01-08", "tea")]


def entries(spark):
    return spark.createDataFrame(ENTRIES, "id long, day int, date string, text string")


def test_wordpiece(spark):
    v = {"[UNK]": 0, "un": 1, "##able": 2, "##a": 3, "able": 4, ",": 5}
    t = WordPiece(v)
    assert t.split("Unable, able xyz") == ["un", "##able", ",", "able", "[UNK]"]
    assert t.ids("unable") == [1, 2]
    got = {r.id: r.pieces for r in pieces(spark.createDataFrame([(1, "able"), (2, None)], "id int, text string"), t).collect()}
    assert got == {1: ["able"], 2: []}


def test_unigram():
    t = Unigram({"▁a": -1.0, "b": -2.0, "▁ab": -2.5, "c": -3.0})
    assert t.split("ab") == ["▁ab"]
    assert t.split("a c") == ["▁a", "<unk>", "c"]
    assert t.split("zz") == ["<unk>"] and t.split("  ") == []


def test_static_table_and_encoder(spark):
    v = {"[UNK]": 0, "[CLS]": 1, "[SEP]": 2, "tea": 3, "cup": 4}
    t = WordPiece(v)
    static = StaticTable(t, np.eye(5), np.array([1, 1, 1, 1, 3.0]))
    assert np.allclose(static.embed("tea cup"), np.array([0, 0, 0, 1, 3]) / np.sqrt(10))
    assert not static.embed("unknown").any()
    rng = np.random.default_rng(0)
    d, up = 8, 16
    w = {"words": rng.normal(size=(5, d)), "positions": rng.normal(size=(6, d)), "types": rng.normal(size=(1, d)), "gain": np.ones(d), "bias": np.zeros(d)}
    for n in "qkvo":
        w |= {f"0.{n}": rng.normal(size=(d, d)), f"0.b{n}": np.zeros(d)}
    w |= {"0.up": rng.normal(size=(d, up)), "0.bup": np.zeros(up), "0.down": rng.normal(size=(up, d)), "0.bdown": np.zeros(d)}
    w |= {f"0.{n}{i}": np.ones(d) if n == "gain" else np.zeros(d) for n in ("gain", "bias") for i in (1, 2)}
    encoder = Encoder(t, w, 1, 2)
    a = encoder.embed("tea cup")
    assert abs(np.linalg.norm(a) - 1) < 1e-6 and not np.allclose(a, encoder.embed("cup tea"))
    assert encoder.embed("tea " * 50).shape == (d,)
    got = embedded(spark.createDataFrame([(1, "tea cup"), (2, None)], "id int, text string"), encoder).collect()
    assert np.allclose({r.id: r.embedding for r in got}[1], a)


def test_fnv(spark):
    df = spark.createDataFrame([("",), ("a",), (None,)], "t string")
    assert [r.h for r in df.select(fnv1a_hex("t").alias("h")).collect()] == ["cbf29ce484222325", "af63dc4c8601ec8c", None]


def test_service_and_evaluation(spark):
    rows = entries(spark)
    words = service.Lexical(rows)
    edges = graph.mentions(rows, spark.createDataFrame([("the mill",), ("anna",)], "phrase string"))
    walk = service.Comention(words, edges)
    asked = spark.createDataFrame([(1, "whom did Anna meet", "dune", [2, 1])], "id int, question string, answer string, relevant_entries array<bigint>")
    assert {r.id for r in walk.search(asked, 5).collect()} == {1, 2}
    got = {r.system: r for r in evaluate.retrieval({"words": words, "walk": walk}, asked, rows, 5).collect()}
    assert got["words"].recall == 0.5 < got["walk"].recall == 1 and got["walk"].answered == 1
    assert evaluate.context_sufficiency(walk, asked, rows, 100).first().sufficient == 1
    s = service.Service(rows, words)
    call = lambda name, **a: s.handle({"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": name, "arguments": a}})
    assert call("search", query="Dune", k=3)["result"]["content"][0]["text"].startswith("[2] 2018-01-06: advice")
    assert call("assemble_context", query="nothing")["result"]["content"][0]["text"] == "No results."
    assert call("discover_insights")["result"]["content"][0]["text"] == "No results."
    assert call("other")["error"]["code"] == service.PARAMS and call("search")["error"]["code"] == service.PARAMS
    assert s.handle({"id": 1, "method": "x"})["error"]["code"] == service.METHOD
    assert s.handle({"method": "notifications/initialized"}) is None
    assert len(s.handle({"id": 1, "method": "tools/list"})["result"]["tools"]) == 3


def test_generated_tables_and_detectors(spark):
    tables = generate(spark, 7, 2, 1)
    assert [r.text for r in generate(spark, 7, 2, 1)["entries"].collect()] == [r.text for r in tables["entries"].collect()]
    assert [r.id for r in tables["entries"].orderBy("day", "id").collect()] == list(range(tables["entries"].count()))
    found = evaluate.detectors(tables, TOPICS, TOOLS, ["is a joy"], ["i regret buying the"])
    assert evaluate.reversal_scores(found["reversals"], tables["contradictions"]).first().recall == 1
    assert evaluate.lead_scores(found["leads"], tables["temporal"]).first().recall is not None
    words = service.Lexical(tables["entries"])
    assert evaluate.retrieval({"words": words}, tables["recall"], tables["entries"], 10).first().recall > 0.9
    assert PEOPLE and PLACES and found["topics"].filter(F.col("cluster") == "sea").count() > 0


def test_codecs(spark):
    got = {r.codec: r.recall for r in evaluate.codecs(synthetic_vectors(spark, 600, 64, 8), 5).collect()}
    assert got["float"] == 1 and got["int8"] >= 0.95 and got["sign_two_stage"] >= 0.95
    assert evaluate.timed(spark, {"x": lambda: spark.range(3)}).first().rows == 3


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    assert main(["list"]) == 0 and "bm25_topk" in capsys.readouterr().out
    assert main(["run", str(tmp_path), "nothing"]) == 2
    entries(spark).write.parquet(str(tmp_path / "entries.parquet"))
    assert main(["run", str(tmp_path), "doc_freq", "--out", str(tmp_path / "out")]) == 0
    assert spark.read.parquet(str(tmp_path / "out")).filter("term = 'mill'").first().df == 2
    message = {"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": "search", "arguments": {"query": "tea"}}}
    monkeypatch.setattr("sys.stdin", iter([json.dumps(message) + "\n", "{\n"]))
    assert main(["serve", str(tmp_path)]) == 0
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert "[4]" in lines[0]["result"]["content"][0]["text"] and lines[1]["error"]["code"] == service.PARSE
